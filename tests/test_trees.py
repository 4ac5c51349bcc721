import numpy as np
import pyspark.sql.functions as F

from ridgeline.operators import hist as hs
from ridgeline.operators import trees as tr

X = ["members", "rooms", "head_age", "head_educ", "prov"]
Y = "log_income_pc"


def _best_split_numpy(pdf):
    y = pdf[Y].to_numpy()
    best = (-1, None, None)
    for f in X:
        x = pdf[f].to_numpy(float)
        for c in np.unique(x)[:-1]:
            L = x <= c
            g = (y.sum() ** 2 * 0 + y[L].sum() ** 2 / L.sum() + y[~L].sum() ** 2 / (~L).sum()
                 - y.sum() ** 2 / len(y))
            if g > best[0] + 1e-12:
                best = (g, f, c)
    return best


def test_split_search_matches_brute_force(spark, hh, hh_pd):
    s = tr.split_search(hh, Y, X).orderBy(F.col("gain").desc()).first()
    g, f, c = _best_split_numpy(hh_pd)
    assert s["feature"] == f and s["cut_value"] == c and abs(s["gain"] - g) < 1e-8


def test_cart_root_split_is_t1_best_and_pruning(spark, hh, hh_pd):
    m = tr.grow(hh, Y, X, minbucket=1, maxdepth=6)
    t = tr.tree_from_mllib(m, X, spark)
    g, f, c = _best_split_numpy(hh_pd)
    root = t.nodes[t.root]
    assert root.feature == f
    assert sum(t.nodes[i].n for i in t.leaves()) == len(hh_pd)
    assert tr.prune(t, 1.0).nodes[t.root].is_leaf
    p = tr.prune(t, 0.01)
    assert len(p.leaves()) <= len(t.leaves())
    seq = tr.prune_sequence(t)
    alphas = [a for a, _ in seq]
    assert alphas == sorted(alphas)


def test_pruned_tree_predictions_are_leaf_means(spark, hh):
    t = tr.regression_tree(hh, Y, X, cp=0.02, minsplit=20)
    p = t.transform(hh)
    per_leaf = p.groupBy("prediction").agg(F.avg(Y).alias("m")).collect()
    for r in per_leaf:
        assert abs(r["prediction"] - r["m"]) < 1e-9


def test_surrogate_of_itself_agrees_fully(spark, hh):
    s = tr.surrogate_splits(hh.withColumn("copy", F.col("rooms")), F.col("rooms") <= 3, ["copy"], k=1).first()
    assert s["agree"] == hh.count() and abs(s["adj_agree"] - 1.0) < 1e-12


def test_leafwise_two_leaves_is_best_stump(spark, hh, hh_pd):
    m, _, _ = hs.leafwise_boost(hh, Y, X, "hhid", rounds=1, num_leaves=2, learning_rate=1.0,
                                min_data_in_leaf=1, min_child_weight=1.0, max_bin=255)
    t = m.trees[0]
    g, f, c = _best_split_numpy(hh_pd)
    assert t.nodes[1].feature == f and t.nodes[1].cut == c


def test_ctree_stops_on_noise(spark, hh):
    noisy = hh.withColumn("noise", (F.col("hhid") * 7919 % 101).cast("double"))
    t = hs.ctree(noisy, "noise", ["prov", "computer"], mincriterion=0.999)
    assert len(t.leaves()) <= 3


def test_cp_table_rows_are_prunable(spark, hh):
    t = tr.tree_from_mllib(tr.grow(hh, Y, X, minbucket=5, maxdepth=6), X, spark)
    table = tr.cp_table(t)
    assert table[0][1] == 0 and abs(table[0][2] - 1.0) < 1e-12
    assert table[-1][0] == 0.0 and table[-1][1] == len(t.leaves()) - 1
    for cp, nsplit, rel in table:
        p = tr.prune(t, cp)
        assert len(p.leaves()) - 1 == nsplit


def test_variant_sse_matches_scoring(spark, hh):
    t = tr.tree_from_mllib(tr.grow(hh, Y, X, minbucket=5, maxdepth=6), X, spark)
    stats = tr.held_out_leaf_stats(t, hh, Y)
    for variant in (tr.prune(t, 0.01), t.truncate(2)):
        want = variant.transform(hh).agg(F.sum(F.pow(F.col(Y) - F.col("prediction"), 2))).first()[0]
        assert abs(tr.variant_sse(t, variant, stats) - want) < 1e-6 * want


def test_leafwise_subtraction_gives_leaf_means(spark, hh):
    m, _, _ = hs.leafwise_boost(hh, Y, X, "hhid", rounds=1, num_leaves=4, learning_rate=1.0, lam=0.0,
                                min_data_in_leaf=1, min_child_weight=1.0, max_bin=255)
    t = m.trees[0]
    assert len(t.leaves()) == 4
    p = hh.withColumn("_leaf", t.node_expr()).groupBy("_leaf").agg(F.avg(Y).alias("m")).collect()
    for r in p:
        assert abs(m.base + t.nodes[r["_leaf"]].value - r["m"]) < 1e-9


def test_cart_grower_equals_brute_force_root_and_bounds_its_size(spark, hh, hh_pd):
    from ridgeline.operators import cart as ca
    t = ca.grow_cart(hh, Y, X, cp=0.002)
    best = tr.competitor_splits(hh, Y, X, k=1).first()
    root = t.nodes[t.root]
    assert root.feature == best["feature"] and abs(root.gain - best["gain"]) < 1e-6 * best["gain"]
    assert len(t.leaves()) - 1 <= 1 / 0.002
    assert all(nd.gain >= 0.002 * root.dev - 1e-9 for nd in t.nodes.values() if not nd.is_leaf)
    again = ca.grow_cart(hh.repartition(7), Y, X, cp=0.002)
    assert {i: (n.feature, n.cut) for i, n in t.nodes.items()} == {i: (n.feature, n.cut) for i, n in again.nodes.items()}


def test_large_means_do_not_change_splits(spark):
    from ridgeline.operators import hist as hs
    d = spark.range(20000).selectExpr("id", "cast(id % 10 as double) as a", "cast((id * 7919) % 13 as double) as b",
                                      "1e9 + cast(id % 10 > 4 as int) as y")
    top = tr.competitor_splits(d, "y", ["a", "b"], k=1).first()
    assert (top["feature"], top["cut"]) == ("a", 4.5) and abs(top["gain"] - 5000) < 1e-3
    t = hs.ctree(d, "y", ["a", "b"])
    assert len(t.leaves()) == 2 and t.nodes[1].feature == "a"
    r = tr.regression_tree(d, "y", ["a", "b"])
    assert r.nodes[0].feature == "a" and abs(r.nodes[r.nodes[0].right].value - (1e9 + 1)) < 1e-6


def test_weakest_link_is_nearly_linear_and_matches_the_table(spark):
    import random
    import time
    rnd = random.Random(1)
    t = tr.Tree({0: tr.Node(0, 2.0 ** 14, 0.0, 1e6, 0)}, 0)
    todo = [0]
    while todo:
        i = todo.pop()
        nd = t.nodes[i]
        if nd.depth == 14:
            continue
        share, left = rnd.uniform(0.6, 0.95), rnd.uniform(0.3, 0.7)
        nd.feature, nd.cut, nd.left, nd.right = "x", 0.0, len(t.nodes), len(t.nodes) + 1
        for j, p in ((nd.left, left), (nd.right, 1 - left)):
            t.nodes[j] = tr.Node(j, nd.n / 2, 0.0, nd.syy * share * p, nd.depth + 1)
            todo.append(j)
    t0 = time.time()
    table = tr.cp_table(t)
    assert time.time() - t0 < 5 and table[-1][1] == 2 ** 14 - 1 and table[0][1] == 0
    for cp, splits, err in table[::max(1, len(table) // 5)]:
        p = tr.prune(t, cp)
        assert len(p.leaves()) - 1 == splits
        assert abs(sum(p.nodes[j].dev for j in p.leaves()) / t.nodes[0].dev - err) < 1e-9


def test_nominal_statistic_is_the_quadratic_form():
    import pandas as pd
    rnd = np.random.default_rng(3)
    g, y = rnd.integers(0, 5, 80), rnd.normal(size=80)
    e = np.eye(6)[g]  # the last level has no rows
    n, t = e.sum(0), e.T @ y
    cov = y.var() / 79 * (80 * np.diag(n) - np.outer(n, n))
    off = t - n * y.mean()
    want, rank = off @ np.linalg.pinv(cov, rcond=1e-10) @ off, np.linalg.matrix_rank(cov, tol=1e-8)
    hf = pd.DataFrame({"b": range(6), "n": n, "y": t, "yy": e.T @ y ** 2})
    stat, df = hs._nominal(hf, 6)
    assert abs(stat - want) < 1e-9 and df == rank == 4
    assert hs._nominal(hf[:1], 6) is None


def test_inference_tree_splits_sets_of_levels(spark, hh, hh_pd):
    d = hh.withColumn("odd", F.when(F.col("prov") % 2 == 0, 5.0).otherwise(0.0) + F.col(Y) * 0.01)
    t = hs.ctree(d, "odd", ["rooms", "prov"], mincriterion=0.95, maxdepth=1, nominal=["prov"])
    want = sorted({float(p) for p in hh_pd["prov"] if p % 2 == 1})
    assert t.nodes[1].feature == "prov" and sorted(t.nodes[1].stat["left"]) == want
    two = t.transform(d).groupBy("prediction").agg(F.avg("odd").alias("m")).collect()
    assert len(two) == 2 and all(abs(r["prediction"] - r["m"]) < 1e-9 for r in two)
    holes = d.withColumn("prov", F.when(F.col("hhid") % 10 > 0, F.col("prov")))
    t = hs.ctree(holes, "odd", ["prov"], maxdepth=1, nominal=["prov"])
    right = holes.where("prov is null").select(t.node_expr().alias("k")).distinct().collect()
    assert [r["k"] for r in right] == [t.nodes[1].right] and sorted(t.nodes[1].stat["left"]) == want


def _surrogate_brute(x, y, cp, minsplit, minbucket, maxdepth):
    """rpart's rules on rows: splits by known values, surrogates by agreement, then the majority.  Leaf of every row."""
    p = x.shape[1]
    dev = lambda r: ((y[r] - y[r].mean()) ** 2).sum()
    least, leaf, todo = cp * dev(np.arange(len(y))), np.full(len(y), np.nan), [(np.arange(len(y)), 0)]
    while todo:
        rows, depth = todo.pop()
        best = (0.0,)
        if len(rows) >= minsplit and depth < maxdepth:
            for f in range(p):
                have = rows[~np.isnan(x[rows, f])]
                for c in np.unique(x[have, f])[:-1]:
                    a, b = have[x[have, f] <= c], have[x[have, f] > c]
                    if min(len(a), len(b)) >= minbucket and (g := dev(have) - dev(a) - dev(b)) > best[0] + 1e-9:
                        best = (g, f, c, len(a) >= len(b))
        if best[0] < least or best[0] <= 0:
            leaf[rows] = y[rows].mean()
            continue
        _, f, c, majority = best
        left = np.where(np.isnan(x[rows, f]), np.nan, x[rows, f] <= c)
        ranked = []
        for g in range(p):
            both = ~np.isnan(left) & ~np.isnan(x[rows, g])
            if g == f or not both.any():
                continue
            v, l = x[rows[both], g], left[both] == 1
            options = [(max(k := ((v <= q) == l).sum(), len(l) - k), -q, 2 * k >= len(l)) for q in np.unique(v)[:-1]]
            if options and max(options)[0] > max(l.sum(), len(l) - l.sum()):
                top = max(options)
                ranked.append((-top[0], g, -top[1], top[2]))
        for _, g, q, below in sorted(ranked)[:5]:
            side = np.where(np.isnan(x[rows, g]), np.nan, (x[rows, g] <= q) == below)
            left = np.where(np.isnan(left), side, left)
        left = np.where(np.isnan(left), majority, left).astype(bool)
        todo += [(rows[left], depth + 1), (rows[~left], depth + 1)]
    return leaf


def test_surrogate_tree_equals_brute_force(spark):
    from ridgeline.operators import cart as ca
    rnd = np.random.default_rng(12)
    n = 400
    z = rnd.normal(size=n)
    x = np.stack([np.round(z * 2), np.round(z * 2 + rnd.normal(size=n)), rnd.integers(0, 6, n).astype(float), np.round(-z * 3)], 1)
    y = np.where(x[:, 0] > 0, 3.0, 0.0) + (x[:, 2] > 2) + rnd.normal(size=n) * 0.3
    x[rnd.uniform(size=x.shape) < 0.25] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, y double")
    for d in (df.repartition(1), df.repartition(7)):
        t = ca.grow_surrogate_cart(d, "y", ["a", "b", "c", "d"], cp=0.01, minsplit=20, minbucket=7, maxdepth=4)
        got = [r["prediction"] for r in t.transform(d).orderBy("id").collect()]
        assert len(t.leaves()) > 3 and any(nd.surrogates for nd in t.nodes.values())
        assert np.allclose(got, _surrogate_brute(x, y, 0.01, 20, 7, 4), atol=1e-9)


def test_surrogate_tree_without_nulls_is_the_plain_tree(spark, hh):
    from ridgeline.operators import cart as ca
    a, b = ca.grow_surrogate_cart(hh, Y, X, cp=0.01), ca.grow_cart(hh, Y, X, cp=0.01)
    cuts = lambda t: sorted((n.depth, n.feature, n.cut, n.n) for n in t.nodes.values() if not n.is_leaf)
    assert cuts(a) == cuts(b)
    assert ca.grow_surrogate_cart(hh.limit(0), Y, X, cp=0.01).nodes[0].n == 0
