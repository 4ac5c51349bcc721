"""HIST kernel and the tree learners MLlib lacks.

**HIST** ``hist(df, node, binned features, stats)`` returns, per
(node, feature, bin), the sums of a few statistics -- (1, y, y^2, x, x^2, xy)
for inference trees, (g, h) for second-order boosting, residual sums for
componentwise boosting.  Features are binned once (all distinct values when
few, approximate quantiles otherwise); every task folds its Arrow batches into
``bincount`` arrays and Spark adds the partial sums, so the shuffle and the driver
see ``nodes x features x bins`` numbers whatever the row count.  y and x are taken
about their means, so a large mean costs no digits.

Trees grow level by level (one HIST job per level) or best-first (one job per
split, sibling histogram by subtraction).  A row's current node is a nested
``CASE`` over the splits so far, recomputed each level -- no lineage growth
inside a tree.  Boosting keeps the running margin as a column and cuts the
lineage with a reliable checkpoint every few rounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform, poisson_weight
from ..functions.stats import chi2_sf
from ..session import cut_lineage, snapshot
from .trees import bin_features

MAX_HIST_ROWS = 1_000_000  # histogram rows of one pass; more nodes take more passes
CHECKPOINT_EVERY = 5
MAX_LEVELS = 1000


# ------------------------------------------------------------- binning ---

@dataclass
class Bins:
    features: list[str]
    cuts: dict            # feature -> sorted thresholds; bin k means x <= cuts[k] (k = len: above all)
    materialized: dict = field(default_factory=dict)

    def index(self, f: str) -> Column:
        """Bin of ``f``: the number of cuts below the value (plain comparisons,
        so it stays inside generated code); a materialised bin column is used
        when present (``materialize``)."""
        if f in self.materialized:
            return F.col(self.materialized[f])
        cuts = self.cuts[f]
        if not cuts:
            return F.lit(0)
        x = F.col(f).cast("double")
        e = F.lit(0)
        for c in cuts:
            e = e + (x > F.lit(float(c))).cast("int")
        return e

    def materialize(self, df: DataFrame) -> tuple[DataFrame, "Bins"]:
        """Add one int bin column per feature; returns the frame and bins that read them."""
        names = {f: f"_bin{i}" for i, f in enumerate(self.features)}
        out = df.withColumns({names[f]: self.index(f) for f in self.features})
        return out, Bins(self.features, self.cuts, names)

    def threshold(self, f: str, b: int) -> float:
        return float(self.cuts[f][b])


def make_bins(df: DataFrame, features: list[str], max_bins: int = 64) -> Bins:
    return Bins(list(features), bin_features(df, features, max_bins))


def bin_of(cuts: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Number of cuts below every value; NaN is above all."""
    if len(cuts) > 4:
        return np.searchsorted(cuts, x, side="left")
    b = np.zeros(len(x), np.int64)
    for c in cuts:
        b += ~(x <= c)
    return b


def hist(df: DataFrame, node: Column, bins: Bins, stats: dict[str, Column], with_x: bool = False,
         nodes: list[int] | None = None, centers: dict | None = None, route=None) -> pd.DataFrame:
    """Sums of ``stats`` per (node, feature index, bin), collected.

    Each task folds its Arrow batches into dense ``bincount`` arrays and emits
    one row per non-empty (node, feature, bin); Spark adds those up.  Rows are
    read once, whatever the number of features.  ``nodes`` are the node ids
    counted (rows of others are skipped); when nodes x bins passes
    ``MAX_HIST_ROWS`` the nodes are counted in several passes.

    With ``with_x`` the per-bin weighted sums of x, x^2 and x*y are added for
    association tests (``n`` must be the weight stat and ``y`` the weighted y);
    x is taken relative to ``centers[feature]``.  A NULL predictor falls in the
    last bin (it goes right) and adds nothing to the sums of x.  With ``route`` the tasks find the node of a row
    from its features (by number) instead of reading it from ``node``.
    """
    ids = np.array(sorted(nodes or [1]), dtype=np.int64)
    width = sum(len(bins.cuts[f]) + 1 for f in bins.features)
    step = max(1, MAX_HIST_ROWS // width)
    if len(ids) > step:
        return pd.concat([hist(df, node, bins, stats, with_x, ids[k:k + step].tolist(), centers, route)
                          for k in range(0, len(ids), step)], ignore_index=True)
    names, mid = list(stats), centers or {}
    extra = ["sx", "sxx", "sxy"] if with_x else []
    binned = [f in bins.materialized for f in bins.features]
    cuts = [np.asarray(bins.cuts[f], dtype=float) for f in bins.features]
    shift = [float(mid.get(f, 0.0)) for f in bins.features]
    cols = [F.col(bins.materialized[f]).cast("double").alias(f"_b{i}") for i, f in enumerate(bins.features) if binned[i]]
    cols += [F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(bins.features) if with_x or not binned[i]]
    sel = df.select(node.cast("bigint").alias("_node"), *[c.cast("double").alias(k) for k, c in stats.items()], *cols)

    def fold(batches):
        acc = [np.zeros((len(ids) * (len(c) + 1), 1 + len(names) + len(extra))) for c in cuts]
        for pdf in batches:
            nd = route([pdf[f"_x{i}"].to_numpy(dtype=float) for i in range(len(cuts))]) if route else pdf["_node"].to_numpy()
            pos = np.minimum(np.searchsorted(ids, nd), len(ids) - 1)
            use = ids[pos] == nd
            if not use.all():
                pdf, pos = pdf[use], pos[use]
            if not len(pdf):
                continue
            st = [pdf[k].to_numpy(dtype=float) for k in names]
            for i, c in enumerate(cuts):
                nb = len(c) + 1
                if with_x or not binned[i]:
                    x = pdf[f"_x{i}"].to_numpy(dtype=float)
                b = pdf[f"_b{i}"].to_numpy().astype(np.int64) if binned[i] else bin_of(c, x)
                at = pos * nb + b
                w = [None, *st]
                if with_x:
                    xc = np.nan_to_num(x - shift[i])
                    n, yv = pdf["n"].to_numpy(dtype=float), pdf["y"].to_numpy(dtype=float)
                    w += [n * xc, n * xc * xc, yv * xc]
                for k, v in enumerate(w):
                    acc[i][:, k] += np.bincount(at, v, minlength=len(ids) * nb)
        out = []
        for i, c in enumerate(cuts):
            hit = np.flatnonzero(acc[i][:, 0])
            part = pd.DataFrame(acc[i][hit, 1:], columns=names + extra)
            part.insert(0, "b", (hit % (len(c) + 1)).astype(np.int32))
            part.insert(0, "f", np.int32(i))
            part.insert(0, "_node", ids[hit // (len(c) + 1)])
            out.append(part)
        yield pd.concat(out, ignore_index=True)

    schema = "_node bigint, f int, b int, " + ", ".join(f"{k} double" for k in names + extra)
    return (sel.mapInPandas(fold, schema).groupBy("_node", "f", "b")
            .agg(*[F.sum(k).alias(k) for k in names + extra]).toPandas())


# ---------------------------------------------------------------- trees ---

@dataclass
class HNode:
    id: int
    depth: int
    value: float = 0.0
    n: float = 0.0
    feature: str | None = None
    cut: float | None = None
    left: int | None = None
    right: int | None = None
    gain: float = 0.0
    stat: dict = field(default_factory=dict)

    @property
    def is_leaf(self) -> bool:
        return self.left is None


@dataclass
class HTree:
    nodes: dict = field(default_factory=dict)

    def leaves(self):
        return [i for i, n in self.nodes.items() if n.is_leaf]

    def node_expr(self) -> Column:
        def build(i):
            nd = self.nodes[i]
            if nd.is_leaf:
                return F.lit(int(i))
            return F.when(self._goes_left(nd), build(nd.left)).otherwise(build(nd.right))
        return build(1)

    @staticmethod
    def _goes_left(nd: HNode) -> Column:
        if "left" in nd.stat:
            return F.col(nd.feature).cast("double").isin([float(v) for v in nd.stat["left"]])
        return F.col(nd.feature) <= F.lit(nd.cut)

    def expr(self) -> Column:
        def build(i):
            nd = self.nodes[i]
            if nd.is_leaf:
                return F.lit(float(nd.value))
            return F.when(self._goes_left(nd), build(nd.left)).otherwise(build(nd.right))
        return build(1)

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        if len(self.nodes) > 200 and not any("left" in n.stat for n in self.nodes.values()):
            return df.withColumn(out, sum_of_trees([self], 1.0))  # a CASE of so many leaves is too long to compile
        return df.withColumn(out, self.expr())

    def router(self, features: list[str]):
        """A function from columns (by number in ``features``) to the leaf of every row, by steps over node arrays."""
        ids = sorted(self.nodes)
        pos, no = {i: k for k, i in enumerate(ids)}, {f: k for k, f in enumerate(features)}
        nd = [self.nodes[i] for i in ids]
        feature = np.array([-1 if n.is_leaf else no[n.feature] for n in nd])
        cut = np.array([np.nan if n.cut is None else n.cut for n in nd], float)
        left, right = (np.array([k if n.is_leaf else pos[getattr(n, side)] for k, n in enumerate(nd)]) for side in ("left", "right"))
        sets = {k: np.array(n.stat["left"], float) for k, n in enumerate(nd) if not n.is_leaf and "left" in n.stat}
        names = np.array(ids, np.int64)

        def find(cols: list[np.ndarray]) -> np.ndarray:
            x = np.stack(cols)
            at = np.full(x.shape[1], pos[1])
            live = np.flatnonzero(feature[at] >= 0)
            while len(live):
                here = at[live]
                v = x[feature[here], live]
                below = v <= cut[here]
                for k, some in sets.items():
                    mine = here == k
                    below[mine] = np.isin(v[mine], some)
                at[live] = np.where(below, left[here], right[here])
                live = live[feature[at[live]] >= 0]
            return names[at]

        return find

    def depth(self) -> int:
        return max(self.nodes[i].depth for i in self.leaves())


def _flat(trees: list) -> tuple:
    """Node arrays of a list of trees: feature number, cut, left, right, value, roots."""
    feats = sorted({n.feature for t in trees for n in t.nodes.values() if not n.is_leaf})
    no, at = {f: k for k, f in enumerate(feats)}, 0
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    for t in trees:
        ids = sorted(t.nodes)
        pos = {i: at + k for k, i in enumerate(ids)}
        roots.append(pos[1])
        for i in ids:
            n = t.nodes[i]
            feature.append(-1 if n.is_leaf else no[n.feature])
            cut.append(0.0 if n.is_leaf else n.cut)
            left.append(pos[i] if n.is_leaf else pos[n.left])
            right.append(pos[i] if n.is_leaf else pos[n.right])
            value.append(n.value)
        at += len(ids)
    return feats, tuple(np.array(v) for v in (feature, cut, left, right, value, roots))


def sum_of_trees(trees: list, scale: float, base: float = 0.0) -> Column:
    """``base + scale * sum of the trees`` by vectorised steps over node arrays, for any number of trees.

    The plan holds one Arrow UDF instead of one nested CASE per tree.  NULL goes right.
    """
    feats, (feature, cut, left, right, value, roots) = _flat(trees)
    if not feats:
        return F.lit(float(base + scale * sum(t.nodes[1].value for t in trees)))

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(dtype=float) for c in cols], 1)
        rows, out = np.arange(len(x)), np.full(len(x), float(base))
        for r in roots:
            at = np.full(len(x), r)
            while (feature[at] >= 0).any():
                f = feature[at]
                at = np.where(x[rows, np.where(f >= 0, f, 0)] <= cut[at], left[at], right[at])
            out += scale * value[at]
        return pd.Series(out)

    return score(*[F.col(f).cast("double") for f in feats])


def _split_children(t: HTree, i: int, feature: str, cut: float | None, gain: float, lv: float, rv: float,
                    ln: float, rn: float) -> None:
    nd = t.nodes[i]
    nd.feature, nd.cut, nd.gain = feature, cut, gain
    nd.left, nd.right = len(t.nodes) + 1, len(t.nodes) + 2  # ids by creation: any depth
    t.nodes[nd.left] = HNode(nd.left, nd.depth + 1, lv, ln)
    t.nodes[nd.right] = HNode(nd.right, nd.depth + 1, rv, rn)


def _assoc(hf: pd.DataFrame):
    """(n-1) r^2 of x and y from one feature's per-bin sums (None if x or y is constant)."""
    n = hf["n"].sum()
    sx, sxx = hf["sx"].sum(), hf["sxx"].sum()
    sy, syy, sxy = hf["y"].sum(), hf["yy"].sum(), hf["sxy"].sum()
    vx = sxx - sx * sx / n
    vy = syy - sy * sy / n
    if vx <= 1e-12 * max(1.0, abs(sxx)) or vy <= 0:
        return None
    return (n - 1) * (sxy - sx * sy / n) ** 2 / (vx * vy)


def _nominal(hf: pd.DataFrame, levels: int):
    """Statistic and degrees of freedom of y and a nominal column from its levels' sums (None if there is nothing to test).

    The linear statistic is the vector of the levels' sums of y.  With its permutation mean and covariance
    ``V / (n - 1) * (n diag(n_k) - n n')`` the quadratic form has the closed value ``(n - 1) * between / total`` sum of
    squares, and the covariance has rank ``levels - 1``.  Rows without a level (the last bin) take no part.
    """
    hf = hf[(hf["b"] < levels) & (hf["n"] > 0)]
    n, s = hf["n"].sum(), hf["y"].sum()
    total = hf["yy"].sum() - s * s / n if n else 0.0
    if len(hf) < 2 or total <= 0:
        return None
    between = (hf["y"] ** 2 / hf["n"]).sum() - s * s / n
    return (n - 1) * between / total, len(hf) - 1


def with_levels(df: DataFrame, bins: Bins, nominal) -> Bins:
    """``bins`` with one bin per level of the ``nominal`` columns and a last one for NULL."""
    cuts = dict(bins.cuts)
    for f in nominal:
        got = [r[0] for r in df.select(F.col(f).cast("double")).where(F.col(f).isNotNull()).distinct().limit(MAX_LEVELS + 1).collect()]
        if len(got) > MAX_LEVELS:
            raise ValueError(f"{f} has more than {MAX_LEVELS} levels")
        cuts[f] = sorted(got)
    return Bins(bins.features, cuts, {f: c for f, c in bins.materialized.items() if f not in nominal})


def association_tests(df: DataFrame, y: str, features: list[str], nominal=(), max_bins: int = 64) -> dict:
    """``{feature: (statistic, degrees of freedom, p)}`` at the root, one HIST pass."""
    bins = with_levels(df, make_bins(df, features, max_bins), nominal)
    mid = _means(df, [y, *features], F.lit(1.0))
    d = df.select(*features, (F.col(y).cast("double") - F.lit(mid[y])).alias("_y")).where("_y is not null")
    h = hist(d, F.lit(1), bins, {"n": F.lit(1.0), "y": F.col("_y"), "yy": F.col("_y") * F.col("_y")}, with_x=True, centers=mid)
    out = {}
    for fi, hf in h.groupby("f"):
        got = _tested(hf, bins, bins.features[fi], nominal)
        if got:
            out[bins.features[fi]] = (*got, chi2_sf(*got))
    return out


def _tested(hf: pd.DataFrame, bins: Bins, f: str, nominal):
    """``(statistic, degrees of freedom)`` of one feature's histogram."""
    if f in nominal:
        return _nominal(hf, len(bins.cuts[f]))
    stat = _assoc(hf)
    return None if stat is None else (stat, 1)


def _means(df: DataFrame, cols: list[str], w: Column) -> dict:
    """Weighted means, so that sums of squares are taken about them (large means cost no digits)."""
    r = df.agg(*[(F.sum(w * F.col(c).cast("double")) / F.sum(F.when(F.col(c).isNotNull(), w))).alias(f"m{i}")
                 for i, c in enumerate(cols)]).first()
    return {c: float(r[i] or 0.0) for i, c in enumerate(cols)}


def association_statistics(df: DataFrame, y: str, features: list[str], max_bins: int = 64) -> dict:
    """Root-node statistics of the inference tree, one HIST pass."""
    bins = make_bins(df, features, max_bins)
    mid = _means(df, [y, *features], F.lit(1.0))
    d = df.select(*features, (F.col(y).cast("double") - F.lit(mid[y])).alias("_y"))
    h = hist(d, F.lit(1), bins, {"n": F.lit(1.0), "y": F.col("_y"), "yy": F.col("_y") * F.col("_y")}, with_x=True, centers=mid)
    out = {}
    for fi, hf in h.groupby("f"):
        st = _assoc(hf)
        if st is not None:
            out[bins.features[fi]] = st
    return out


def ctree(df: DataFrame, y: str, features: list[str], mincriterion: float = 0.95, minsplit: int = 20,
          minbucket: int = 7, maxdepth: int = 30, bins: Bins | None = None, weight: Column | None = None,
          max_bins: int = 64, nominal=()) -> HTree:
    """Conditional inference tree.

    At each node the variable is chosen by a permutation-test association
    statistic (``(n-1) r^2``, asymptotically chi-square(1)) with Bonferroni
    adjustment ``1 - (1-p)^m``; the node splits only when
    ``1 - p_adj > mincriterion``.  The cut on the chosen variable maximises
    the two-sample statistic, i.e. the RSS reduction, subject to
    ``minbucket``.  One HIST job per level.

    A ``nominal`` column is tested by the quadratic form of its levels' sums, with
    ``levels - 1`` degrees of freedom, and split into two sets of levels
    (levels by mean, the best cut); its NULLs go right.
    """
    bins = with_levels(df, bins or make_bins(df, features, max_bins), nominal)
    w = weight if weight is not None else F.lit(1.0)
    yc, w = F.col(y).cast("double"), w.cast("double")
    base = float(df.filter(w > 0).agg(F.sum(w * yc) / F.sum(F.when(yc.isNotNull(), w))).first()[0] or 0.0)
    return _grow_inference(equal_rows(df, yc, features, w, base), base, features, bins, mincriterion, minsplit, minbucket, maxdepth, nominal)


def equal_rows(df: DataFrame, y: Column, features: list[str], w: Column, base: float) -> DataFrame:
    """One row for all rows of equal ``features``, written: weight ``_n``, and the weighted sums ``_s`` and ``_ss`` of y - base and its square.

    A test or a split needs no more of the outcome, so all levels read this table.
    """
    d = df.select(*features, (y - F.lit(base)).alias("_yc"), w.alias("_w")).filter(F.col("_w") > 0)
    wy = F.col("_w") * F.col("_yc")
    return snapshot(d.groupBy(*features).agg(F.sum("_w").alias("_n"), F.sum(wy).alias("_s"), F.sum(wy * F.col("_yc")).alias("_ss")))


def _grow_inference(sums: DataFrame, base: float, features: list[str], bins: Bins, mincriterion: float, minsplit: int,
                    minbucket: int, maxdepth: int, nominal=()) -> HTree:
    """The tree of ``ctree`` from the sums of ``equal_rows`` about ``base``."""
    count = F.col("_n")
    row = sums.agg(F.sum("_s").alias("s"), F.sum("_n").alias("n"),
                   *[(F.sum(count * F.col(c).cast("double")) / F.sum(F.when(F.col(c).isNotNull(), count))).alias(f"m{i}") for i, c in enumerate(features)]).first()
    mid = {c: float(row[f"m{i}"] or 0.0) for i, c in enumerate(features)}
    n_all = row["n"]
    move = float(row["s"] / n_all) if n_all and row["s"] is not None else 0.0  # about the mean, so that sums of squares keep their digits
    base = base + move
    t = HTree({1: HNode(1, 0, base, n_all)})
    stats = {"n": count, "y": F.col("_s") - count * F.lit(move), "yy": F.col("_ss") - F.lit(2 * move) * F.col("_s") + count * F.lit(move * move)}
    bins = Bins(bins.features, bins.cuts)
    splits = lambda i: not (t.nodes[i].n < minsplit or t.nodes[i].depth >= maxdepth)
    frontier = [1] if n_all and splits(1) else []
    while frontier:
        h = hist(sums, F.lit(1), bins, stats, with_x=True, nodes=frontier, centers=mid, route=t.router(bins.features))
        h = h.sort_values(["_node", "f", "b"], ignore_index=True)
        at = h["_node"].to_numpy()
        nxt = []
        for i in frontier:
            nd = t.nodes[i]
            hi = h.iloc[np.searchsorted(at, i):np.searchsorted(at, i, side="right")]
            best_p, best_f, per_f = 1.0, None, {}
            edge = np.flatnonzero(np.diff(hi["f"].to_numpy(), prepend=-1, append=-1))
            assoc = _assocs(hi, edge[:-1]) if len(hi) else []
            for a, b, test in zip(edge, edge[1:], assoc):
                fi = int(hi["f"].iat[a])
                if bins.features[fi] in nominal:
                    test = _nominal(hi.iloc[a:b], len(bins.cuts[bins.features[fi]]))
                if test is not None:
                    per_f[fi] = chi2_sf(*test)
            m = len(per_f)
            for fi, p in per_f.items():
                adj = 1.0 - (1.0 - p) ** m
                if adj < best_p or (adj == best_p and best_f is not None and fi < best_f):
                    best_p, best_f = adj, fi
            if best_f is None or 1.0 - best_p <= mincriterion:
                continue
            hf, f = hi[hi["f"] == best_f], bins.features[best_f]
            if f in nominal:  # levels by mean, NULL last
                rank = np.where(hf["b"] < len(bins.cuts[f]), hf["y"] / hf["n"], np.inf)
                hf = hf.iloc[np.argsort(rank, kind="stable")]
            cn, cy = hf["n"].cumsum().to_numpy(), hf["y"].cumsum().to_numpy()
            n, s = cn[-1], cy[-1]
            ok = (cn >= minbucket) & (n - cn >= minbucket)
            ok[-1] = False
            if not ok.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = cy ** 2 / cn + (s - cy) ** 2 / (n - cn) - s * s / n
            gain = np.where(ok, gain, -np.inf)
            k = int(np.argmax(gain))
            b = int(hf["b"].to_numpy()[k])
            if b >= len(bins.cuts[f]):
                continue
            _split_children(t, i, f, None if f in nominal else bins.threshold(f, b), float(gain[k]), base + cy[k] / cn[k],
                            base + (s - cy[k]) / (n - cn[k]), float(cn[k]), float(n - cn[k]))
            t.nodes[i].stat = {"p_adj": best_p}
            if f in nominal:
                t.nodes[i].stat["left"] = [bins.cuts[f][q] for q in hf["b"].to_numpy()[:k + 1]]
            nxt += [c for c in (nd.left, nd.right) if splits(c)]
        frontier = nxt
    return t


def _assocs(hi: pd.DataFrame, starts: np.ndarray) -> list:
    """``(_assoc, 1)`` of every feature of one node's histogram (sorted; a feature's bins from ``starts`` on), None without a test."""
    n, y, yy, sx, sxx, sxy = (np.add.reduceat(hi[c].to_numpy(dtype=float), starts) for c in ("n", "y", "yy", "sx", "sxx", "sxy"))
    vx, vy = sxx - sx * sx / n, yy - y * y / n
    with np.errstate(divide="ignore", invalid="ignore"):
        stat = (n - 1) * (sxy - sx * y / n) ** 2 / (vx * vy)
    none = (vx <= 1e-12 * np.maximum(1.0, np.abs(sxx))) | (vy <= 0)
    return [None if no else (float(v), 1) for v, no in zip(stat, none)]


# --------------------------------------------------- second-order boosting ---

@dataclass
class BoostModel:
    base: float
    trees: list
    eta: float

    def expr(self) -> Column:
        e = F.lit(float(self.base))
        for t in self.trees:
            e = e + F.lit(self.eta) * t.expr()
        return e

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, sum_of_trees(self.trees, self.eta, self.base))


def _margin_loop(df: DataFrame, y: str, key: str, rounds: int, eta: float, grow_one, seed: int,
                 subsample: float = 1.0, valid_col: str | None = None, patience: int | None = None,
                 bins: "Bins | None" = None):
    """Shared boosting loop on squared loss: g = f - y, h = 1.

    The frame (with materialised bin columns) is checkpointed once up front
    and again every ``CHECKPOINT_EVERY`` rounds as the margin column grows.
    """
    base = df.filter(~F.col(valid_col)) if valid_col else df
    f0 = base.agg(F.avg(y)).first()[0]
    d = df.select(key, y, *[c for c in df.columns if c not in (key, y)]).withColumn("_f", F.lit(float(f0)))
    if bins is not None:
        d, mb = bins.materialize(d)
        bins.materialized = mb.materialized
    d = cut_lineage(d)
    trees, curve = [], []
    best, best_round = math.inf, 0
    for r in range(rounds):
        train = d.filter(~F.col(valid_col)) if valid_col else d
        if subsample < 1.0:
            train = train.filter(hash_uniform(seed, key, F.lit(r)) < F.lit(subsample))
        t = grow_one(train, r)
        trees.append(t)
        d = d.withColumn("_f", F.col("_f") + F.lit(eta) * t.expr())
        if (r + 1) % CHECKPOINT_EVERY == 0:
            d = cut_lineage(d)
        if valid_col:
            v = d.filter(F.col(valid_col)).agg(F.sqrt(F.avg(F.pow(F.col(y) - F.col("_f"), 2)))).first()[0]
            curve.append(v)
            if v < best - 1e-12:
                best, best_round = v, r + 1
            elif patience is not None and r + 1 - best_round >= patience:
                break
    if valid_col and patience is not None:
        trees = trees[:best_round]  # rounds after the best one are not part of the model
    return BoostModel(f0, trees, eta), curve, best_round


def xgb(df: DataFrame, y: str, features: list[str], key: str, rounds: int = 50, max_depth: int = 3,
        eta: float = 0.3, gamma: float = 0.0, lam: float = 1.0, min_child_weight: float = 1.0,
        subsample: float = 1.0, colsample: float = 1.0, seed: int = 1, max_bins: int = 64,
        valid_col: str | None = None, patience: int | None = None):
    """Regularised second-order boosting (squared loss), level-wise trees.

    Leaf weight ``-G / (H + lambda)``; split gain
    ``1/2 [GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l)] - gamma``; child hessian
    at least ``min_child_weight``; row and column sampling by hash.
    Returns ``(model, validation curve, best round)``.
    """
    from .boost import GridBoost, Spec
    spec = Spec(0, max_depth, eta, lam, gamma, max(min_child_weight, 0.0), subsample, colsample)
    return GridBoost(df, y, features, key, [spec], seed, max_bins, valid_col).fit(rounds, patience)[0]


def _feature_draw(seed: int, r: int, f: str) -> float:
    import hashlib
    h = hashlib.md5(f"{seed}:{r}:{f}".encode()).hexdigest()
    return int(h[:8], 16) / 4294967296.0


def leafwise_boost(df: DataFrame, y: str, features: list[str], key: str, rounds: int = 50, num_leaves: int = 31,
                   max_depth: int = -1, learning_rate: float = 0.1, lam: float = 0.0,
                   min_child_weight: float = 1e-3, min_data_in_leaf: int = 20, subsample: float = 1.0,
                   colsample: float = 1.0, max_bin: int = 40, seed: int = 1, valid_col: str | None = None,
                   patience: int | None = None, categorical=()):
    """Binned best-leaf-first boosting (squared loss), with native ``categorical`` features.

    Each tree splits the leaf with the largest gain next until ``num_leaves``.
    """
    from .boost import GridBoost, Spec
    spec = Spec(num_leaves, max_depth, learning_rate, lam, 0.0, max(min_child_weight, float(min_data_in_leaf)), subsample, colsample)
    return GridBoost(df, y, features, key, [spec], seed, max_bin, valid_col, categorical).fit(rounds, patience)[0]


def early_stop(curve: list[float], patience: int = 10) -> tuple[int, int]:
    """(best round, stopping round) -- stop after ``patience`` rounds without a new minimum."""
    best, best_r = math.inf, 0
    for r, v in enumerate(curve, start=1):
        if v < best:
            best, best_r = v, r
        elif r - best_r >= patience:
            return best_r, r
    return best_r, len(curve)


# ------------------------------------------------- inference-tree boosting ---

def inference_boost(df: DataFrame, y: str, features: list[str], key: str, mstop: int = 20, nu: float = 0.1,
                    maxdepth: int = 2, mincriterion: float = 0.95, seed: int = 1):
    """Boosting with conditional inference trees fitted to the residuals.

    The margin depends on the features only, so the sums of rows of equal features give those of the residuals in every round.
    """
    bins = make_bins(df, features, 64)
    f0 = df.agg(F.avg(y)).first()[0]
    sums = equal_rows(df, F.col(y).cast("double"), features, F.lit(1.0), float(f0))
    trees: list = []
    for _ in range(mstop):
        f, n = F.col("_f"), F.col("_n")
        d = sums.withColumn("_f", sum_of_trees(trees, nu))
        d = d.select(*features, n, (F.col("_s") - n * f).alias("_s"), (F.col("_ss") - F.lit(2.0) * f * F.col("_s") + n * f * f).alias("_ss"))
        trees.append(_grow_inference(d, 0.0, features, bins, mincriterion, 20, 7, maxdepth))
    return BoostModel(f0, trees, nu)


# --------------------------------------------------- conditional forest ---

def conditional_forest(df: DataFrame, y: str, features: list[str], key: str, trees: int = 10, mtry: int = 5,
                       maxdepth: int = 4, mincriterion: float = 0.0, seed: int = 1) -> list[HTree]:
    """Bag of inference trees on Poisson(1) bootstrap weights and random feature subsets."""
    bins = make_bins(df, features, 64)
    d, mb = bins.materialize(df.select(key, y, *features))
    d = cut_lineage(d)
    out = []
    for t in range(trees):
        cols = sorted(features, key=lambda f: _feature_draw(seed, t, f))[:mtry]
        sub = Bins(cols, {f: bins.cuts[f] for f in cols}, {f: mb.materialized[f] for f in cols})
        w = poisson_weight(hash_uniform(seed, key, F.lit(t)))
        out.append(ctree(d, y, cols, mincriterion=mincriterion, maxdepth=maxdepth, bins=sub, weight=w))
    return out


def forest_expr(trees: list[HTree]) -> Column:
    return sum_of_trees(trees, 1.0 / len(trees))


# --------------------------------------------- componentwise boosting ---

@dataclass
class ComponentwiseModel:
    base: float
    steps: list          # (feature, {bin: value})
    bins: Bins
    nu: float

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        agg: dict = {}
        for f, table in self.steps:
            cur = agg.setdefault(f, {})
            for b, v in table.items():
                cur[b] = cur.get(b, 0.0) + self.nu * v
        e = F.lit(float(self.base))
        for f, table in agg.items():
            m = F.create_map(*chain.from_iterable((F.lit(int(b)), F.lit(float(v))) for b, v in table.items()))
            e = e + F.coalesce(m[self.bins.index(f)], F.lit(0.0))
        return df.withColumn(out, e)


def componentwise_boost(df: DataFrame, y: str, features: list[str], key: str, mstop: int = 100, nu: float = 0.1,
                        penalty: float = 1.0, max_bins: int = 20) -> ComponentwiseModel:
    """Each round fits the best single-feature smooth term to the residuals.

    A term is a shrunken per-bin mean of the residual (``sum r / (n + penalty)``);
    the feature with the largest RSS reduction wins.  One HIST job per round;
    the running fit is a column, checkpointed every few rounds.
    """
    bins = make_bins(df, features, max_bins)
    f0 = df.agg(F.avg(y)).first()[0]
    d, mb = bins.materialize(df.select(key, y, *features).withColumn("_f", F.lit(float(f0))))
    d = cut_lineage(d)
    model = ComponentwiseModel(f0, [], bins, nu)
    for r in range(mstop):
        h = hist(d, F.lit(1), mb, {"n": F.lit(1.0), "r": F.col(y) - F.col("_f")})
        best = None
        for fi, hf in h.groupby("f"):
            vals = hf["r"] / (hf["n"] + penalty)
            red = float((2 * vals * hf["r"] - vals * vals * hf["n"]).sum())
            if best is None or red > best[0]:
                best = (red, fi, dict(zip(hf["b"].astype(int), vals.astype(float))))
        _, fi, table = best
        f = bins.features[fi]
        model.steps.append((f, table))
        m = F.create_map(*chain.from_iterable((F.lit(int(b)), F.lit(float(v))) for b, v in table.items()))
        d = d.withColumn("_f", F.col("_f") + F.lit(nu) * F.coalesce(m[mb.index(f)], F.lit(0.0)))
        if (r + 1) % CHECKPOINT_EVERY == 0:
            d = cut_lineage(d)
    return model
