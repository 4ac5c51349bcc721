import numpy as np
import pyspark.sql.functions as F

from ridgeline.operators import neighbors as nb
from ridgeline.operators import tuning as tu
from ridgeline.operators import linear as lin
from ridgeline.plans import fixtures as fx
from sf_dirs import SF_SMALL

Y = "log_income_pc"


def test_knn_matches_brute_force(spark):
    v = fx.vec(spark, SF_SMALL)
    pdf = v.toPandas().sort_values("vec_id")
    q = v.filter(F.col("vec_id") % 4 == 0)
    t = v.filter(F.col("vec_id") % 4 != 0)
    got = {r["vec_id"]: r["prediction"] for r in nb.knn_regress(t, q, "vec_id", "embedding", "label", k=3,
                                                                 block_rows=16).collect()}
    T = pdf[pdf.vec_id % 4 != 0]
    E = np.stack(T.embedding.to_numpy()).astype(float)
    for _, row in pdf[pdf.vec_id % 4 == 0].iterrows():
        d = np.sqrt(((E - np.asarray(row.embedding, float)) ** 2).sum(1))
        order = np.lexsort((T.vec_id.to_numpy(), d))[:3]
        assert abs(got[row.vec_id] - T.label.to_numpy()[order].mean()) < 1e-12


def _knn_brute(train, query, k):
    ids, E, y = (np.array(v) for v in zip(*[(r[0], r[1], r[2]) for r in train if r[1] is not None and r[2] is not None]))
    out = {}
    for i, x, *_ in query:
        if x is None:
            out[i] = None
            continue
        d = np.sqrt(((E - np.asarray(x, float)) ** 2).sum(1))
        out[i] = float(y[np.lexsort((ids, d))[:k]].mean())
    return out


def test_knn_by_cells_on_clusters_ties_and_nulls(spark):
    rnd = np.random.default_rng(3)
    centers = rnd.normal(size=(6, 8)) * 20
    rows = [(i, (centers[i % 6] + rnd.normal(size=8)).round(2).tolist(), float(i % 17)) for i in range(900)]
    rows += [(1000 + i, [1.0] * 8, float(i)) for i in range(500)]  # a third of all rows are one vector
    rows += [(2000, None, 1.0), (2001, [0.0] * 8, None)]
    schema = "id bigint, v array<double>, y double"
    queries = rows[::9] + [(5000, [1.0] * 8, None), (5001, None, None), (5002, [500.0] * 8, None)]
    t, q = spark.createDataFrame(rows, schema), spark.createDataFrame(queries, schema)
    for k, block, parts in ((1, 16, 1), (5, 64, 7), (7, 2048, 3)):
        got = {r["id"]: r["prediction"] for r in nb.knn_regress(t.repartition(parts), q, "id", "v", "y", k=k, block_rows=block).collect()}
        want = _knn_brute(rows, queries, k)
        assert got.keys() == want.keys()
        assert all((got[i] is None) == (want[i] is None) and (got[i] is None or abs(got[i] - want[i]) < 1e-9) for i in want)
    few = nb.knn_regress(t.limit(3), q, "id", "v", "y", k=5)
    assert few.count() == len(queries) and nb.knn_regress(t.limit(0), q, "id", "v", "y").count() == len(queries)


def test_knn_prunes_cells_that_are_far(spark):
    rnd = np.random.default_rng(3)
    centers = rnd.normal(size=(6, 4)) * 1000
    rows = [(i, (centers[i % 6] + rnd.normal(size=4)).tolist(), 1.0) for i in range(1200)]
    t = spark.createDataFrame(rows, "id bigint, v array<double>, y double")
    pivots = centers + 0.1
    blocks = nb._blocks(t, pivots, 3, 64)
    between, reach = nb._bounds(blocks, pivots, 3)
    assert blocks.agg(F.sum("n")).first()[0] == 1200 and blocks.count() >= 18
    far = blocks.groupBy("cell").agg(F.max("far").alias("far")).collect()
    assert all(between[i, r["cell"]] - 2 * r["far"] > reach[i] + r["far"] for r in far for i in range(6) if i != r["cell"])


def test_permutation_importance_of_unused_feature_is_zero(spark, hh):
    m = lin.ols(hh, Y, ["members"])
    imp = {r["feature"]: r["importance"] for r in
           tu.importance_permutation(m, hh, Y, "hhid", ["members", "rooms"], seed=3).collect()}
    assert abs(imp["rooms"]) < 1e-12 and imp["members"] > 0


def test_permutation_keeps_values_whatever_the_partitions(spark, hh):
    a = tu.permutation(hh, "hhid", ["rooms", "members"], seed=4)
    b = tu.permutation(hh.repartition(7), "hhid", ["rooms", "members"], seed=4)
    rows = sorted(map(tuple, a.select("hhid", "rooms", "members", Y).collect()))
    assert rows == sorted(map(tuple, b.select("hhid", "rooms", "members", Y).collect()))
    was = sorted(map(tuple, hh.select("hhid", "rooms", "members", Y).collect()))
    assert [r[0] for r in rows] == [r[0] for r in was] and [r[3] for r in rows] == [r[3] for r in was]
    assert sorted(r[1:3] for r in rows) == sorted(r[1:3] for r in was) and [r[1] for r in rows] != [r[1] for r in was]


def test_partial_dependence_of_linear_model(spark, hh, hh_pd):
    m = lin.ols(hh, Y, ["members", "rooms"])
    pd_ = {r["value"]: r["yhat"] for r in tu.partial_dependence(m, hh, "members", [1, 3]).collect()}
    want = m.coef[0] + m.coef[1] * 3 + m.coef[2] * hh_pd["rooms"].mean()
    assert abs(pd_[3.0] - want) < 1e-9


def test_model_tree_at_root_is_ols(spark, hh):
    from ridgeline.operators import model_trees as mt
    x = ["members", "rooms", "head_age"]
    m = mt.model_tree(hh, Y, x, cp=1.0, smoothed=False)
    assert len(m.tree.leaves()) == 1
    ols = lin.ols(hh, Y, x)
    assert np.allclose(m.coefs[m.tree.root], ols.coef, atol=1e-8)
    c = mt.rule_committee(hh, Y, x, committees=1, cp=1.0)
    a = c.transform(hh).select(F.sum("prediction")).first()[0]
    b = m.transform(hh).select(F.sum("prediction")).first()[0]
    assert abs(a - b) < 1e-8 * abs(b)


def test_xgb_stump_leaf_values_are_child_means(spark, hh, hh_pd):
    from ridgeline.operators import hist as hs
    m, _, _ = hs.xgb(hh, Y, ["members", "rooms"], "hhid", rounds=1, max_depth=1, eta=1.0, lam=0.0,
                     min_child_weight=1.0, max_bins=255)
    t = m.trees[0]
    root = t.nodes[1]
    left = hh_pd[hh_pd[root.feature] <= root.cut][Y]
    right = hh_pd[hh_pd[root.feature] > root.cut][Y]
    assert abs(m.base + t.nodes[2].value - left.mean()) < 1e-9
    assert abs(m.base + t.nodes[3].value - right.mean()) < 1e-9
