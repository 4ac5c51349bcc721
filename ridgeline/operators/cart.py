"""CART growth with rpart's complexity rule.

A split is made only if it lowers the residual sum of squares by at least
``cp`` times that of the root.  Every split takes that much off, so a tree
has at most ``1 / cp`` splits, whatever the number of rows: node table,
frontier and pruning are bounded by the parameter, not by the data.

One pass of the histogram kernel per level counts all open nodes; splits are
at the midpoints or quantile cuts of the binned features.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hist import Bins, hist, make_bins
from .trees import Node, Tree


def _router(t: Tree, features: list[str]) -> Column:
    """Node id of every row, by vectorised steps over node arrays."""
    ids = sorted(t.nodes)
    if len(ids) == 1:
        return F.lit(int(ids[0])).cast("bigint")
    pos, no = {i: k for k, i in enumerate(ids)}, {f: k for k, f in enumerate(features)}
    nd = [t.nodes[i] for i in ids]
    feature = np.array([-1 if n.is_leaf else no[n.feature] for n in nd])
    cut = np.array([0.0 if n.is_leaf else n.cut for n in nd])
    left = np.array([pos[n.id] if n.is_leaf else pos[n.left] for n in nd])
    right = np.array([pos[n.id] if n.is_leaf else pos[n.right] for n in nd])
    names, root = np.array(ids), pos[t.root]

    @F.pandas_udf("bigint")
    def route(*cols: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(dtype=float) for c in cols], 1)
        rows, at = np.arange(len(x)), np.full(len(x), root)
        while (feature[at] >= 0).any():
            f = feature[at]
            at = np.where(x[rows, np.where(f >= 0, f, 0)] <= cut[at], left[at], right[at])
        return pd.Series(names[at])

    return route(*[F.col(c).cast("double") for c in features])


def grow_cart(df: DataFrame, y: str, features: list[str], cp: float, minsplit: int = 20, minbucket: int | None = None,
              maxdepth: int = 30, max_bins: int = 256, weight: str | None = None, bins: Bins | None = None) -> Tree:
    """The unpruned tree of the complexity rule; ``cp`` must be positive.

    Ties go to the feature named first, then to the lower cut.  A NULL predictor goes right.
    """
    if cp <= 0:
        raise ValueError("cp must be positive: it bounds the size of the tree")
    minbucket = minbucket if minbucket is not None else max(1, round(minsplit / 3))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    d = df.select(*features, F.col(y).cast("double").alias("_y"), w.alias("_w")).filter(F.col("_w") > 0)
    base = d.agg((F.sum(F.col("_w") * F.col("_y")) / F.sum("_w"))).first()[0]
    t = Tree({}, 0)
    if base is None:
        t.nodes[0] = Node(0, 0.0, 0.0, 0.0, 0)
        return t
    yc = F.col("_y") - F.lit(float(base))
    stats = {"n": F.col("_w"), "y": F.col("_w") * yc, "yy": F.col("_w") * yc * yc}
    r = d.agg(*[F.sum(c) for c in stats.values()]).first()
    t.nodes[0] = Node(0, float(r[0]), float(r[1]), float(r[2]), 0, shift=float(base))
    least = cp * t.nodes[0].dev
    bins = bins or make_bins(d, features, max_bins)
    frontier = [0] if t.nodes[0].n >= minsplit and maxdepth > 0 else []
    while frontier:
        h = hist(d, _router(t, features), bins, stats, nodes=frontier)
        nxt = []
        for i, hi in h.groupby("_node"):
            nd, best = t.nodes[int(i)], None
            for fi, hf in hi.groupby("f"):
                hf = hf.sort_values("b")
                n, s, q = (hf[k].to_numpy().cumsum() for k in ("n", "y", "yy"))
                ok = (n >= minbucket) & (n[-1] - n >= minbucket)
                ok[-1] = False
                if not ok.any():
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ok, s**2 / n + (s[-1] - s)**2 / (n[-1] - n) - s[-1]**2 / n[-1], -np.inf)
                k = int(np.argmax(gain))
                if best is None or gain[k] > best[0]:
                    best = (float(gain[k]), bins.features[int(fi)], int(hf["b"].to_numpy()[k]), n[k], s[k], q[k])
            if best is None or best[0] < least or best[0] <= 0:
                continue
            gain, f, b, n, s, q = best
            nd.feature, nd.cut, nd.gain = f, bins.threshold(f, b), gain
            nd.left, nd.right = len(t.nodes), len(t.nodes) + 1
            for j, v in ((nd.left, (n, s, q)), (nd.right, (nd.n - n, nd.sy - s, nd.syy - q))):
                t.nodes[j] = Node(j, *map(float, v), nd.depth + 1, shift=nd.shift)
                if t.nodes[j].n >= minsplit and nd.depth + 1 < maxdepth:
                    nxt.append(j)
        frontier = nxt
    return t


def _null_bins(d: DataFrame, features: list[str], max_bins: int) -> Bins:
    """Bins whose last one holds the NULLs only."""
    bins = make_bins(d, features, max_bins)
    top = d.agg(*[F.max(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(features)]).first()
    return Bins(bins.features, {c: [*bins.cuts[c], *([float(top[f"m{i}"])] if top[f"m{i}"] is not None else [])] for i, c in enumerate(features)})


def _known_split(hf: pd.DataFrame, last: int, minbucket: int):
    """``(gain, bin, left count, left sum)`` among the rows that have the feature."""
    hf = hf[hf["b"] < last].sort_values("b")
    if len(hf) < 2:
        return None
    n, s = (hf[k].to_numpy().cumsum() for k in ("n", "y"))
    ok = (n >= minbucket) & (n[-1] - n >= minbucket)
    ok[-1] = False
    if not ok.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, s**2 / n + (s[-1] - s)**2 / (n[-1] - n) - s[-1]**2 / n[-1], -np.inf)
    k = int(np.argmax(gain))
    return float(gain[k]), int(hf["b"].to_numpy()[k]), float(n[k]), float(n[-1] - n[k])


def _best_surrogate(hf: pd.DataFrame, last: int):
    """``(agreement above the majority, rows agreed, bin, left where below)`` of one feature with the split's directions."""
    hf = hf[hf["b"] < last].sort_values("b")
    if len(hf) < 2:
        return None
    n, left = hf["n"].to_numpy(), hf["l"].to_numpy()
    cn, cl = n.cumsum()[:-1], left.cumsum()[:-1]
    agree = cl + (n.sum() - left.sum()) - (cn - cl)  # "<=" goes left
    best = np.maximum(agree, n.sum() - agree)
    k = int(np.argmax(best))
    major = max(left.sum(), n.sum() - left.sum())
    return float(best[k] - major), float(best[k]), int(hf["b"].to_numpy()[k]), bool(agree[k] >= n.sum() - agree[k])


def grow_surrogate_cart(df: DataFrame, y: str, features: list[str], cp: float, minsplit: int = 20, minbucket: int | None = None,
                        maxdepth: int = 30, max_bins: int = 256, maxsurrogate: int = 5) -> Tree:
    """T2 with T8 inside: rows whose split value is NULL follow the surrogates, then the majority.

    A split is judged by the rows that have its feature, and must take off ``cp`` times the root's deviance.
    Its surrogates are the best cuts, in either direction, of the other features: those that send more rows the same way
    than the majority rule would, ranked by the rows they agree on (ties: the feature named first).
    Two histogram passes and one sum a level.
    """
    if cp <= 0:
        raise ValueError("cp must be positive: it bounds the size of the tree")
    minbucket = minbucket if minbucket is not None else max(1, round(minsplit / 3))
    d = df.where(F.col(y).isNotNull()).select(*features, F.col(y).cast("double").alias("_y"))
    base = d.agg(F.avg("_y")).first()[0]
    t = Tree({}, 0)
    if base is None:
        t.nodes[0] = Node(0, 0.0, 0.0, 0.0, 0)
        return t
    yc = F.col("_y") - F.lit(float(base))
    stats = {"n": F.lit(1.0), "y": yc, "yy": yc * yc}
    sums = [F.sum(c).alias(k) for k, c in stats.items()]
    t.nodes[0] = Node(0, *map(float, d.agg(*sums).first()), 0, shift=float(base))
    least = cp * t.nodes[0].dev
    bins = _null_bins(d, features, max_bins)
    last = [len(bins.cuts[f]) for f in features]
    frontier = [0] if t.nodes[0].n >= minsplit and maxdepth > 0 else []
    while frontier:
        h = hist(d, t.node_expr(), bins, stats, nodes=frontier)
        made = []
        for i, hi in h.groupby("_node"):
            found = [(got, -fi, fi) for fi, hf in hi.groupby("f") if (got := _known_split(hf, last[fi], minbucket))]
            if not found:
                continue
            (gain, b, nl, nr), _, fi = max(found, key=lambda g: (g[0][0], g[1]))
            if gain < least or gain <= 0:
                continue
            nd = t.nodes[int(i)]
            nd.feature, nd.cut, nd.gain, nd.majority_left = features[fi], bins.threshold(features[fi], b), gain, nl >= nr
            nd.surrogates = []
            made.append(nd)
        if not made:
            break
        # directions of the rows that have the split's value, by bin of every other feature
        at = t.node_expr()
        side, known = F.lit(None).cast("double"), F.lit(0.0)
        for nd in made:
            here = at == F.lit(nd.id)
            side = F.when(here, (F.col(nd.feature) <= F.lit(nd.cut)).cast("double")).otherwise(side)
            known = F.when(here, F.col(nd.feature).isNotNull().cast("double")).otherwise(known)
        marked = d.withColumn("_at", at).withColumn("_l", F.coalesce(side, F.lit(0.0))).withColumn("_k", known)
        h = hist(marked, F.col("_at"), bins, {"n": F.col("_k"), "l": F.col("_l")}, nodes=[nd.id for nd in made])
        for nd in made:
            ranked = []
            for fi, hf in h[h["_node"] == nd.id].groupby("f"):
                got = _best_surrogate(hf[hf["n"] > 0], last[fi]) if features[fi] != nd.feature else None
                if got and got[0] > 0:
                    ranked.append((-got[1], fi, got))
            nd.surrogates = [(features[fi], bins.threshold(features[fi], got[2]), got[3]) for _, fi, got in sorted(ranked)[:maxsurrogate]]
            nd.left, nd.right = len(t.nodes), len(t.nodes) + 1
            for j in (nd.left, nd.right):
                t.nodes[j] = Node(j, 0.0, 0.0, 0.0, nd.depth + 1, shift=nd.shift)
        kids = [j for nd in made for j in (nd.left, nd.right)]
        for r in d.groupBy(t.node_expr().alias("_node")).agg(*sums).where(F.col("_node").isin(kids)).collect():
            k = t.nodes[r["_node"]]
            k.n, k.sy, k.syy = float(r["n"]), float(r["y"]), float(r["yy"])
        frontier = [j for j in kids if t.nodes[j].n >= minsplit and t.nodes[j].depth < maxdepth]
    return t
