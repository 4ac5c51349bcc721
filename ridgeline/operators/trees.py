"""Single regression trees.

* Split search (T1), competitor splits (T7) and surrogate splits (T8) are
  exact DataFrame aggregates: features are stacked to ``(feature, value)``,
  aggregated per value (map-side combined), and the sums over the distinct
  values run across range partitions (``ranking.running_sums``), so a feature
  may have any number of values.
* A CART tree (T2) is grown by ``cart.grow_cart`` with rpart's complexity
  rule, which bounds its size by 1 / cp.  Cost-complexity pruning (T3) uses
  the weakest-link sequence (a heap, n log n) with cp relative to the root
  deviance.  The pruned tree scores as one nested ``CASE`` column expression.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path, snapshot
from .ranking import running_sums

FOLD_PARALLELISM = 4


def parallel_map(fn, items, workers: int = FOLD_PARALLELISM):
    """Run independent Spark fits from a few driver threads (like CrossValidator's parallelism)."""
    from concurrent.futures import ThreadPoolExecutor
    if len(items) <= 1 or workers <= 1:
        return [fn(i) for i in items]
    with ThreadPoolExecutor(max_workers=min(workers, len(items))) as ex:
        return list(ex.map(fn, items))


def value_stats(df: DataFrame, y: str, features: list[str], weight: str | None = None) -> DataFrame:
    """Per (feature, value): n, sum and sum of squares of y about its mean (one aggregate over the stacked frame)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    # about the mean of y: gains are differences of sums of squares and lose their digits with a large mean
    mean = df.agg(F.sum(w * F.col(y).cast("double")) / F.sum(F.when(F.col(y).isNotNull(), w))).first()[0] or 0.0
    st = df.select((F.col(y).cast("double") - F.lit(float(mean))).alias("_y"), w.alias("_w"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features
    ])).alias("_s")).select("_y", "_w", "_s.feature", "_s.value")
    agg = st.groupBy("feature", "value").agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("_y")).alias("sy"),
                                             F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("syy"))
    return agg


def split_search(df: DataFrame, y: str, features: list[str], weight: str | None = None,
                 min_bucket: int = 1) -> DataFrame:
    """RSS reduction of every (feature, cut) -- best first.

    A cut sends ``value <= cut_value`` left; ``cut`` is the midpoint to the next
    distinct value (the printed split point).  ``gain`` is the drop in the
    residual sum of squares.
    """
    vs = value_stats(df, y, features, weight).select("feature", "value", "n", "sy")
    d = (running_sums(vs, "feature", "value", {"n": "nl", "sy": "sl"}).filter(F.col("next_value").isNotNull())
         .withColumnsRenamed({"nl_total": "nt", "sl_total": "st"}))
    gain = (F.col("sl") * F.col("sl") / F.col("nl")
            + (F.col("st") - F.col("sl")) * (F.col("st") - F.col("sl")) / (F.col("nt") - F.col("nl"))
            - F.col("st") * F.col("st") / F.col("nt"))
    out = d.select("feature", F.col("value").alias("cut_value"),
                   ((F.col("value") + F.col("next_value")) / 2).alias("cut"),
                   F.col("nl").alias("n_left"), (F.col("nt") - F.col("nl")).alias("n_right"), gain.alias("gain"))
    return out.filter((F.col("n_left") >= min_bucket) & (F.col("n_right") >= min_bucket))


def competitor_splits(df: DataFrame, y: str, features: list[str], k: int = 4) -> DataFrame:
    """Best cut of each feature, ranked; the first is the primary split."""
    s = split_search(df, y, features)
    best = s.groupBy("feature").agg(F.max_by(F.struct("gain", "cut_value", "cut", "n_left", "n_right"),
                                             F.struct(F.col("gain"), -F.col("cut_value"))).alias("b")) \
        .select("feature", "b.*")
    return best.orderBy(F.col("gain").desc(), "feature").limit(k) \
        .withColumn("rank", F.row_number().over(Window.orderBy(F.col("gain").desc(), "feature")).cast("int"))


def surrogate_splits(df: DataFrame, goes_left: Column, features: list[str], k: int = 5) -> DataFrame:
    """For a primary split (``goes_left``), the cut of each other feature that
    agrees most with it, either direction, against the majority-direction rule.

    ``agree`` = rows sent the same way; ``adj_agree`` = (agree - majority) /
    (n - majority).  Only features that beat the majority rule are kept.
    """
    st = df.select(goes_left.cast("int").alias("_l"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features
    ])).alias("_s")).select("_l", "_s.feature", "_s.value")
    vs = st.groupBy("feature", "value").agg(F.sum("_l").alias("nl"), F.count("*").alias("n"))
    d = (running_sums(vs, "feature", "value", {"nl": "cl", "n": "cn"}).filter(F.col("next_value").isNotNull())
         .withColumnsRenamed({"cl_total": "tl", "cn_total": "tn"}))
    # direction "<=" goes left: agree = left rows at or below + right rows above
    a1 = F.col("cl") + ((F.col("tn") - F.col("tl")) - (F.col("cn") - F.col("cl")))
    a2 = F.col("tn") - a1
    d = d.select("feature", F.col("value").alias("cut_value"), ((F.col("value") + F.col("next_value")) / 2).alias("cut"),
                 F.when(a1 >= a2, F.lit("<=")).otherwise(F.lit(">")).alias("direction"),
                 F.greatest(a1, a2).alias("agree"), "tn", "tl")
    major = F.greatest(F.col("tl"), F.col("tn") - F.col("tl"))
    d = d.withColumn("adj_agree", (F.col("agree") - major) / (F.col("tn") - major))
    best = d.groupBy("feature").agg(F.max_by(F.struct("agree", "cut_value", "cut", "direction", "adj_agree"),
                                             F.struct(F.col("agree"), -F.col("cut_value"))).alias("b")) \
        .select("feature", "b.*").filter(F.col("adj_agree") > 0)
    return best.orderBy(F.col("agree").desc(), "feature").limit(k)


def bin_features(df: DataFrame, features: list[str], max_bins: int = 40, rel_err: float = 1e-3) -> dict:
    """Cut points per feature: all its distinct values when these are at most ``max_bins``, else ``max_bins`` quantiles.

    The number of distinct values is exact.  Returns ``{feature: sorted cut list}``.
    """
    out = {}
    names = list(features)

    def lowest(batches):
        # a task's lowest max_bins + 1 distinct values per feature: enough to decide, and all of them when there are few
        seen = [np.zeros(0)] * len(names)
        for pdf in batches:
            for k, c in enumerate(names):
                v = pdf[c].to_numpy(dtype=float)
                seen[k] = np.unique(np.concatenate([seen[k], v[~np.isnan(v)]]))[:max_bins + 1]
        yield pd.DataFrame({"feature": np.repeat(names, [len(v) for v in seen]), "v": np.concatenate(seen)})

    parts = df.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(lowest, "feature string, v double")
    vals = {r["feature"]: sorted(r["vs"]) for r in parts.groupBy("feature").agg(F.collect_set("v").alias("vs")).collect()}
    need_q = [c for c in features if len(vals.get(c, ())) > max_bins]
    for c in features:
        if c not in need_q:
            out[c] = [float(v) for v in vals.get(c, ())][:-1]
    if need_q:
        probs = [i / max_bins for i in range(1, max_bins)]
        qs = df.approxQuantile(need_q, probs, rel_err)
        for c, q in zip(need_q, qs):
            out[c] = sorted(set(q))
    return out


# ----------------------------------------------------------- CART tree ---

@dataclass
class Node:
    id: int
    n: float
    sy: float
    syy: float
    depth: int
    feature: str | None = None
    cut: float | None = None
    left: int | None = None
    right: int | None = None
    gain: float = 0.0
    shift: float = 0.0  # sy and syy are sums of y - shift
    surrogates: list | None = None  # (feature, cut, left where "<=") in the order they are asked where the split's value is NULL
    majority_left: bool = False     # where those are NULL too

    def goes_left(self) -> Column:
        """Whether a row goes left; without surrogates a NULL goes right."""
        first = F.col(self.feature) <= F.lit(self.cut)
        if self.surrogates is None:
            return first
        out = F.lit(self.majority_left)
        for f, cut, below in reversed(self.surrogates):
            side = F.col(f) <= F.lit(cut) if below else F.col(f) > F.lit(cut)
            out = F.coalesce(side, out)
        return F.coalesce(first, out)

    @property
    def value(self) -> float:
        return self.shift + (self.sy / self.n if self.n else 0.0)

    @property
    def dev(self) -> float:
        return max(self.syy - self.sy * self.sy / self.n, 0.0) if self.n else 0.0

    @property
    def is_leaf(self) -> bool:
        return self.left is None


@dataclass
class Tree:
    nodes: dict = field(default_factory=dict)
    root: int = 0

    def copy(self) -> "Tree":
        return Tree({k: Node(**vars(v)) for k, v in self.nodes.items()}, self.root)

    def children(self, i: int) -> list[int]:
        n = self.nodes[i]
        return [] if n.is_leaf else [n.left, n.right]

    def subtree(self, i: int) -> list[int]:
        out, stack = [], [i]
        while stack:
            j = stack.pop()
            out.append(j)
            stack += self.children(j)
        return out

    def leaves(self, i: int | None = None) -> list[int]:
        return [j for j in self.subtree(self.root if i is None else i) if self.nodes[j].is_leaf]

    def collapse(self, i: int) -> None:
        n = self.nodes[i]
        for j in self.subtree(i)[1:]:
            del self.nodes[j]
        n.left = n.right = n.feature = n.cut = None
        n.gain = 0.0

    def depth(self) -> int:
        return max(self.nodes[j].depth for j in self.leaves())

    def expr(self, leaf_value=None) -> Column:
        """Nested CASE over the splits; leaves give ``leaf_value(node)`` (default mean)."""
        lv = leaf_value or (lambda nd: nd.value)

        def build(i):
            nd = self.nodes[i]
            if nd.is_leaf:
                return F.lit(float(lv(nd)))
            return F.when(nd.goes_left(), build(nd.left)).otherwise(build(nd.right))
        return build(self.root)

    def node_expr(self) -> Column:
        def build(i):
            nd = self.nodes[i]
            if nd.is_leaf:
                return F.lit(int(i))
            return F.when(nd.goes_left(), build(nd.left)).otherwise(build(nd.right))
        return build(self.root)

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.expr())

    def path_expr(self) -> Column:
        """Array of node ids from the root to the row's leaf."""
        def build(i, anc):
            nd = self.nodes[i]
            here = anc + [i]
            if nd.is_leaf:
                return F.array(*[F.lit(int(a)) for a in here])
            return F.when(nd.goes_left(), build(nd.left, here)).otherwise(build(nd.right, here))
        return build(self.root, [])

    def parents(self) -> dict:
        out = {}
        for i, nd in self.nodes.items():
            if not nd.is_leaf:
                out[nd.left] = i
                out[nd.right] = i
        return out

    def truncate(self, max_depth: int) -> "Tree":
        t = self.copy()
        for i in [j for j, nd in t.nodes.items() if nd.depth == max_depth and not nd.is_leaf]:
            if i in t.nodes:
                t.collapse(i)
        return t


def tree_from_mllib(model, features: list[str], spark: SparkSession) -> Tree:
    """Read the node table of a fitted MLlib tree (via its saved parquet)."""
    path = scratch_path(spark, "tree_model")
    model.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data").collect()
    t = Tree()
    by_id = {r["id"]: r for r in rows}
    depth = {0: 0}
    order = sorted(by_id)
    for i in order:
        r = by_id[i]
        if r["leftChild"] >= 0:
            depth[r["leftChild"]] = depth[i] + 1
            depth[r["rightChild"]] = depth[i] + 1
    for i in order:
        r = by_id[i]
        st = r["impurityStats"]
        nd = Node(int(i), float(st[0]), float(st[1]), float(st[2]), depth.get(i, 0))
        if r["leftChild"] >= 0:
            sp = r["split"]
            nd.feature = features[sp["featureIndex"]]
            nd.cut = float(sp["leftCategoriesOrThreshold"][0])
            nd.left, nd.right = int(r["leftChild"]), int(r["rightChild"])
        t.nodes[int(i)] = nd
    t.root = 0
    for nd in t.nodes.values():
        if not nd.is_leaf:
            l, r = t.nodes[nd.left], t.nodes[nd.right]
            nd.gain = nd.dev - l.dev - r.dev
    return t


def apply_minsplit(t: Tree, minsplit: int) -> Tree:
    t = t.copy()
    for i in sorted(t.nodes):
        if i in t.nodes and not t.nodes[i].is_leaf and t.nodes[i].n < minsplit:
            t.collapse(i)
    return t


def prune_sequence(t: Tree) -> list[tuple[float, int]]:
    """Weakest-link sequence: ``[(alpha, node collapsed)]`` in increasing alpha.

    alpha of an internal node = (R(node) - R(subtree)) / (leaves - 1); the
    node with the smallest alpha is collapsed first (CART, Breiman et al. 1984).
    Subtree risk and leaf counts are computed bottom-up once and, after each
    collapse, updated only along the collapsed node's ancestors.
    """
    parents = t.parents()
    r_sub, n_leaves, internal = {}, {}, set()
    for i in sorted(t.nodes, key=lambda j: -t.nodes[j].depth):
        nd = t.nodes[i]
        if nd.is_leaf:
            r_sub[i], n_leaves[i] = nd.dev, 1
        else:
            r_sub[i] = r_sub[nd.left] + r_sub[nd.right]
            n_leaves[i] = n_leaves[nd.left] + n_leaves[nd.right]
            internal.add(i)
    def alpha(i):
        return (t.nodes[i].dev - r_sub[i]) / (n_leaves[i] - 1)

    seq, cur = [], 0.0
    heap = [(alpha(i), -i) for i in internal]
    heapq.heapify(heap)
    while heap:
        a, i = heapq.heappop(heap)
        i = -i
        # collapsed meanwhile, or an entry from before its subtree changed
        if i not in internal or a != alpha(i):
            continue
        cur = max(cur, a)
        seq.append((cur, i))
        stack = [i]
        while stack:
            j = stack.pop()
            internal.discard(j)
            stack += [c for c in (t.nodes[j].left, t.nodes[j].right) if c in internal]
        d_r, d_l = t.nodes[i].dev - r_sub[i], 1 - n_leaves[i]
        r_sub[i], n_leaves[i] = t.nodes[i].dev, 1
        j = i
        while j in parents:
            j = parents[j]
            r_sub[j] += d_r
            n_leaves[j] += d_l
            heapq.heappush(heap, (alpha(j), -j))
    return seq


def prune(t: Tree, cp: float, seq: list | None = None) -> Tree:
    """Collapse every weakest link whose alpha <= cp * R(root)."""
    seq = prune_sequence(t) if seq is None else seq
    root_dev = t.nodes[t.root].dev
    gone = {i for a, i in seq if a <= cp * root_dev + 1e-12 * root_dev}
    out, todo = Tree({}, t.root), [t.root]
    while todo:
        nd = Node(**vars(t.nodes[todo.pop()]))
        if nd.id in gone and not nd.is_leaf:
            nd.left = nd.right = nd.feature = nd.cut = None
            nd.gain = 0.0
        out.nodes[nd.id] = nd
        todo += [] if nd.is_leaf else [nd.left, nd.right]
    return out


def cp_table(t: Tree) -> list[tuple[float, int, float]]:
    """(cp, splits, rel_error) for every subtree of the weakest-link sequence.

    Root first.  A row's cp is where that subtree becomes optimal, so
    ``prune(t, cp)`` returns exactly that subtree; the full tree has cp 0.
    Splits and deviance are updated per collapse: one pass over the sequence.
    """
    seq = prune_sequence(t)
    root_dev = t.nodes[t.root].dev
    leaves = t.leaves()
    splits, dev = len(leaves) - 1, sum(t.nodes[j].dev for j in leaves)
    rows, gone = [(0.0, splits, dev / root_dev if root_dev else 1.0)], set()
    for k, (a, i) in enumerate(seq):
        stack = [i]
        while stack:
            j = stack.pop()
            nd = t.nodes[j]
            if nd.is_leaf or j in gone:
                dev -= nd.dev
                continue
            gone.add(j)
            splits -= 1
            stack += [nd.left, nd.right]
        dev += t.nodes[i].dev
        if k + 1 == len(seq) or seq[k + 1][0] > a:
            rows.append((a / root_dev, splits, dev / root_dev))
    return rows[::-1]


def assembled(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out).transform(df)


def grow(df: DataFrame, y: str, features: list[str], minbucket: int = 7, maxdepth: int = 30,
         max_bins: int = 256, weight: str | None = None, seed: int = 1, min_info_gain: float = 0.0):
    """A tree grown by MLlib: full growth to ``minbucket``, for rows that are few enough that their nodes fit the driver."""
    if maxdepth > 30:
        raise ValueError("MLlib trees have at most 30 levels")
    dt = DecisionTreeRegressor(featuresCol="features", labelCol=y, maxDepth=maxdepth,
                               minInstancesPerNode=minbucket, minInfoGain=min_info_gain, maxBins=max_bins,
                               seed=seed, cacheNodeIds=maxdepth > 8, checkpointInterval=10)
    if weight:
        dt = dt.setWeightCol(weight)
    return dt.fit(assembled(df.select(y, *features, *([weight] if weight else [])), features))


def regression_tree(df: DataFrame, y: str, features: list[str], cp: float = 0.01, minsplit: int = 20,
                    minbucket: int | None = None, maxdepth: int = 30, max_bins: int = 256,
                    weight: str | None = None) -> Tree:
    """Rpart-style tree = grow with the complexity rule, then prune at cp."""
    from .cart import grow_cart
    return prune(grow_cart(df, y, features, cp, minsplit, minbucket, maxdepth, max_bins, weight), cp)


def tree_nodes(t: Tree, spark: SparkSession) -> DataFrame:
    """Node table -- id, parent rule, n, deviance, value, leaf flag."""
    rules = {t.root: "root"}
    for i in sorted(t.nodes):
        nd = t.nodes[i]
        if not nd.is_leaf:
            rules[nd.left] = f"{nd.feature} <= {nd.cut:g}"
            rules[nd.right] = f"{nd.feature} > {nd.cut:g}"
    rows = [(int(i), int(nd.depth), rules.get(i), nd.feature, nd.cut, float(nd.n), float(nd.dev), float(nd.value),
             bool(nd.is_leaf)) for i, nd in sorted(t.nodes.items())]
    return spark.createDataFrame(rows, "node int, depth int, rule string, split_feature string, split_cut double, "
                                       "n double, deviance double, value double, is_leaf boolean")


def importance_gain(t: Tree, spark: SparkSession) -> DataFrame:
    """Summed RSS reduction of the primary splits per feature."""
    acc: dict = {}
    for nd in t.nodes.values():
        if not nd.is_leaf:
            acc[nd.feature] = acc.get(nd.feature, 0.0) + nd.gain
    rows = sorted(acc.items(), key=lambda kv: -kv[1])
    return spark.createDataFrame([(k, float(v)) for k, v in rows], "feature string, importance double")


def _tree_arrays(t: Tree, features: list[str]):
    ids = sorted(t.nodes)
    pos = {i: k for k, i in enumerate(ids)}
    feat = np.array([features.index(t.nodes[i].feature) if not t.nodes[i].is_leaf else -1 for i in ids])
    cut = np.array([t.nodes[i].cut if not t.nodes[i].is_leaf else 0.0 for i in ids], dtype=float)
    left = np.array([pos[t.nodes[i].left] if not t.nodes[i].is_leaf else k for k, i in enumerate(ids)])
    right = np.array([pos[t.nodes[i].right] if not t.nodes[i].is_leaf else k for k, i in enumerate(ids)])
    return np.array(ids), feat, cut, left, right, pos[t.root]


def held_out_leaf_stats(t: Tree, held: DataFrame, y: str) -> dict:
    """(n, sum, sum of squares) of y - shift of held-out rows per leaf of ``t`` -- one aggregate.

    Rows are routed through the tree with vectorised numpy steps (one array
    step per level) inside ``mapInPandas``, so deep, wide trees never become
    a giant expression; partitions emit per-leaf partial sums only.
    """
    feats = sorted({nd.feature for nd in t.nodes.values() if not nd.is_leaf})
    held = held.withColumn(y, F.col(y).cast("double") - F.lit(t.nodes[t.root].shift))
    if not feats:
        r = held.agg(F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("syy")).first()
        return {t.root: (float(r["n"]), float(r["sy"] or 0.0), float(r["syy"] or 0.0))} if r["n"] else {}
    ids, feat, cut, left, right, root = _tree_arrays(t, feats)
    depth = t.depth()

    def route(batches):
        acc = {}
        for pdf in batches:
            if pdf.empty:
                continue
            X = pdf[feats].to_numpy(dtype=np.float64)
            yv = pdf[y].to_numpy(dtype=np.float64)
            node = np.full(len(pdf), root)
            rows = np.arange(len(pdf))
            for _ in range(depth):
                f = feat[node]
                go = f >= 0
                xv = X[rows, np.where(go, f, 0)]
                node = np.where(go, np.where(xv <= cut[node], left[node], right[node]), node)
            for leaf in np.unique(node):
                m = node == leaf
                a = acc.setdefault(int(ids[leaf]), [0.0, 0.0, 0.0])
                a[0] += m.sum()
                a[1] += yv[m].sum()
                a[2] += (yv[m] ** 2).sum()
        yield pd.DataFrame({"_leaf": list(acc), "n": [v[0] for v in acc.values()],
                            "sy": [v[1] for v in acc.values()], "syy": [v[2] for v in acc.values()]})

    out = (held.select(*feats, F.col(y).cast("double").alias(y))
           .mapInPandas(route, "_leaf long, n double, sy double, syy double")
           .groupBy("_leaf").agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy"))
           .collect())
    return {r["_leaf"]: (float(r["n"]), float(r["sy"]), float(r["syy"])) for r in out}


def variant_sse(full: Tree, variant: Tree, stats: dict) -> float:
    """Held-out SSE of a pruned/truncated ``variant`` of ``full`` from per-leaf sums.

    Each full-tree leaf maps to its nearest ancestor that is a leaf of the
    variant; that node's training mean is the prediction for all its rows.
    """
    parents = full.parents()
    sse = 0.0
    for leaf, (n, sy, syy) in stats.items():
        node = leaf
        while not (node in variant.nodes and variant.nodes[node].is_leaf):
            node = parents[node]
        pred = variant.nodes[node].value - variant.nodes[node].shift
        sse += syy - 2.0 * pred * sy + pred * pred * n
    return sse


def cv_cp(df: DataFrame, y: str, features: list[str], fold_col: str, cps: list[float], minsplit: int = 20,
          minbucket: int | None = None, maxdepth: int = 30, max_bins: int = 256):
    """T4/T5: per fold one deep tree, pruned at every cp (no refit per cp).

    Returns ``{cp: (mean fold RMSE, sd of fold RMSE, xerror, xstd)}`` where
    xerror is the pooled held-out SSE over the root deviance (rpart units).
    """
    from .cart import grow_cart
    from .hist import make_bins
    df = snapshot(df.select(*features, y, fold_col))  # every level of every fold reads it
    folds = sorted(r[0] for r in df.select(fold_col).distinct().collect())
    least = min(c for c in cps if c > 0)  # the smallest positive cp bounds the trees; cp 0 is the tree grown with it
    bins = make_bins(df, features, max_bins)

    def one(f):
        tr = df.filter(F.col(fold_col) != f)
        te = df.filter(F.col(fold_col) == f)
        t = grow_cart(tr, y, features, least, minsplit, minbucket, maxdepth, max_bins, bins=bins)
        seq = prune_sequence(t)
        stats = held_out_leaf_stats(t, te, y)
        return [variant_sse(t, prune(t, cp, seq), stats) for cp in cps], sum(v[0] for v in stats.values())

    res = parallel_map(one, folds)
    per_fold = [r[0] for r in res]
    sizes = [r[1] for r in res]
    E = np.array(per_fold)
    n = np.array(sizes, dtype=float)
    rmse = np.sqrt(E / n[:, None])
    tot = df.agg(F.count("*").alias("n"), F.var_pop(y).alias("v")).first()
    root_dev = tot["n"] * tot["v"]
    out = {}
    for k, cp in enumerate(cps):
        xerr = E[:, k].sum() / root_dev
        out[cp] = (float(rmse[:, k].mean()), float(rmse[:, k].std(ddof=1)) if len(folds) > 1 else 0.0,
                   float(xerr), float(E[:, k].std(ddof=1) * math.sqrt(len(folds)) / root_dev) if len(folds) > 1
                   else 0.0)
    return out
