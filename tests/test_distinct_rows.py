import numpy as np
import pyspark.sql.functions as F

from ridgeline.functions.hashing import hash_uniform, poisson_weight
from ridgeline.operators import forest as fo
from ridgeline.operators import hist as hs
from ridgeline.operators import mars
from ridgeline.operators import neighbors as nb
from ridgeline.operators import tuning as tu
from ridgeline.operators.gram import gram


def frame(spark, n=600):
    u = lambda k, m: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(m)).cast("double")
    d = spark.range(n).withColumns({"a": u(1, 5), "b": u(2, 30), "c": u(3, 2), "d": u(4, 2), "e": u(5, 2), "f": u(6, 2), "g": u(7, 2)})
    return d.withColumn("a", F.when(F.col("id") % 17 != 0, F.col("a"))).withColumn("y", F.col("b") * (F.col("c") + 1) - F.coalesce("a", F.lit(9.0)) + u(8, 100) / 50)


X = list("abcdefg")


def test_features_of_two_bins_are_counted_together():
    r = np.random.default_rng(2)
    widths = (6, 2, 2, 1, 40, 2, 2, 2, 2)
    x = np.stack([r.integers(0, k, 900) for k in widths]).astype(np.uint8)
    y, w = x[0] * np.int64(500) + x[2] * np.int64(900) + r.integers(-700, 700, 900), r.integers(1, 4, 900).astype(np.uint8)
    for mtry, child in ((9, 1), (3, 4)):
        a, b = (fo.grow_local(x, y, w, 1, 1, 0, fo.Plan(9, 40, mtry, min_child=child, seed=5, widths=v)).pack(9) for v in ((), widths))
        assert a.pop("gains") == b.pop("gains") and a == b and a["nodes"] > 50
    columns = fo._together(x, fo.Plan(9, 40, 9, widths=widths))[0]
    assert len(columns) == 4  # two wide features, six binary ones in two bytes


def test_equal_rows_are_scored_once_and_upper_leaves_where_they_are_read(spark):
    df = frame(spark).select(*X, "y", "id")
    df = df.unionByName(df).withColumn("k", F.monotonically_increasing_id())
    m = fo.fit_forest(df, "y", X, "k", trees=4, mtry=3, max_depth=3, local_rows=30)
    want = {r["k"]: r["prediction"] for r in m.transform(df).collect()}
    assert len(want) == df.count() and len(set(want.values())) > 5
    sent = fo._deal([0, 1, 2, 3], [u.frozen() for u in m.batches[0][1]], m.plan, False)
    packed = fo._pack(df, X, m.bins, F.col("k"), F.lit(0))
    dealt = packed.mapInArrow(sent, fo.BLOB).select("tree", "node").distinct().collect()
    state = [np.array(u.state) for u in m.batches[0][1]]
    assert any((s == 2).any() for s in state) and all(state[r["tree"]][r["node"]] == 1 for r in dealt)
    flat = fo.fit_forest(df, "y", X, "k", trees=4, mtry=3, max_depth=3)  # every tree is one lower node
    assert np.allclose([want[r["k"]] for r in flat.transform(df).orderBy("k").collect()], [want[k] for k in sorted(want)])


def test_partial_dependence_of_a_forest_is_the_mean_of_its_predictions(spark):
    df = frame(spark)
    for local in (40, fo.LOCAL_ROWS):
        m = fo.fit_forest(df, "y", X, "id", trees=5, mtry=3, local_rows=local)
        grid = [0, 1, 1, 2.5, 99]
        rows = df.withColumn("a", F.explode(F.array(*[F.lit(float(v)) for v in set(grid)])))
        want = {r["a"]: r["v"] for r in m.transform(rows).groupBy("a").agg(F.avg("prediction").alias("v")).collect()}
        got = {r["value"]: r["yhat"] for r in tu.partial_dependence(m, df, "a", grid).collect()}
        assert set(got) == set(want) == {0.0, 1.0, 2.5, 99.0} and all(abs(got[v] - want[v]) < 1e-9 for v in got)


def test_blocks_of_vectors_are_not_shuffled_by_pairs(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(500, 6))
    df = spark.createDataFrame([(i, v[i].tolist(), float(i % 7)) for i in range(500)], "id long, v array<double>, y double")
    t, q = df.where("id % 5 > 0"), df.where("id % 5 = 0")
    near = nb.nearest(t, q, "id", "v", "y", 3, block_rows=16)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan
    got = {}
    for row in near.collect():
        got.setdefault(row["_q"], []).append((row["_d"], row["_t"]))
    ids = [i for i in range(500) if i % 5]
    for i in range(0, 500, 5):
        assert [k for _, k in sorted(got[i])] == sorted(ids, key=lambda j: (((v[i] - v[j]) ** 2).sum(), j))[:3]


def test_inference_trees_read_equal_rows_once(spark, monkeypatch):
    df = frame(spark, 3000).select("c", "d", "e", "y", "id")
    seen, plain = [], hs.hist
    monkeypatch.setattr(hs, "hist", lambda d, *a, **k: seen.append(d.count()) or plain(d, *a, **k))
    t = hs.ctree(df, "y", ["c", "d", "e"])
    assert seen and max(seen) <= 8
    means = {r["c"]: r["v"] for r in df.groupBy("c").agg(F.avg("y").alias("v")).collect()}
    root = t.nodes[1]
    assert root.feature == "c" and abs(t.nodes[root.left].value - means[0.0]) < 1e-9 and abs(t.nodes[root.right].value - means[1.0]) < 1e-9
    b = hs.inference_boost(df, "y", ["c", "d", "e"], "id", mstop=3, nu=0.5, maxdepth=1)
    first, second = (b.trees[k].nodes for k in (0, 1))
    left = means[0.0] - b.base
    assert max(seen) <= 8 and abs(first[2].value - left) < 1e-9 and abs(second[2].value - left / 2) < 1e-9


def test_long_trees_route_rows_as_their_expression(spark):
    df = frame(spark, 2000)
    t = hs.ctree(df, "y", X, mincriterion=-1.0, minsplit=4, minbucket=1)
    assert len(t.nodes) > 200
    pdf = df.withColumn("_leaf", t.node_expr()).withColumn("_v", t.expr()).transform(t.transform).toPandas()
    assert (t.router(X)([pdf[c].to_numpy(float) for c in X]) == pdf["_leaf"].to_numpy()).all() and np.allclose(pdf["prediction"], pdf["_v"])


def test_draws_of_hinge_regression_from_one_row_each(spark):
    df = frame(spark)
    terms = mars._terms(df, ["a", "b"], ["c"], 3)
    basis, _ = mars._basis(terms)
    got = mars._draw_grams(df, "y", terms, [n for n, _ in basis], "id", 3, 1)
    ex = (df.select("id", "y", *[c.alias(f"t{i}") for i, (_, c) in enumerate(basis)]).withColumn("_draw", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
          .withColumn("_w", poisson_weight(hash_uniform(1, "id", F.col("_draw")))).where("_w > 0"))
    want = gram(ex, [*[f"t{i}" for i in range(len(basis))], "y"], by=["_draw"], weight="_w")
    assert np.allclose(got.shift, want.shift) and set(got.mats) == set(want.mats)
    assert all(np.allclose(got.mats[k], want.mats[k]) for k in got.mats)


def test_rows_of_equal_bins_grow_as_one(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 3), float(i % 4), float((i * 7) % 11) + i % 3) for i in range(900)], "k int, a double, b double, y double")
    held, grow = [], fo.grow_local
    monkeypatch.setattr(fo, "grow_local", lambda *a: held.append(a) or grow(*a))
    plan = fo.Plan(2, 4, 2, widths=(3, 4))
    base, bins, center, scale, rows = fo._integer_table(df, "y", ["a", "b"], "k", 64, 1, together=True)
    batches = list(fo._deal([0], [fo.Upper().frozen()], plan, True)(base.toArrow().to_batches()))
    w = np.concatenate([np.frombuffer(v, np.uint32) for b in batches for v in b["w"].to_pylist()])
    assert len(w) <= 24 and rows == 900  # 12 kinds, each cut once at most by the two batches' edges
    raw = base.toPandas()
    want = plan.draws(raw["h"].to_numpy().astype(np.int64).view(np.uint64), 0)
    assert w.sum() == want.sum()
    wy = np.concatenate([np.frombuffer(v, np.int64) for b in batches for v in b["y"].to_pylist()])
    assert wy.sum() == (want.astype(np.int64) * raw["y"].to_numpy()).sum()
    x = np.stack([np.frombuffer(v, np.uint8) for v in raw["x"]]).T.copy()
    kinds = np.concatenate([np.frombuffer(v, np.uint8).reshape(-1, 2) for b in batches for v in b["x"].to_pylist()]).T.copy()
    one, all_ = (fo.grow_local(*a).pack(2) for a in ((kinds, None, w, 0, 1, 0, plan, wy), (x, raw["y"].to_numpy(), want, 0, 1, 0, plan)))
    assert one == all_


def test_whole_trees_are_those_with_upper_nodes(spark):
    df = spark.createDataFrame([(i, float(i % 5), float(i % 7), float((i * 7) % 11) + i % 5) for i in range(700)], "k int, a double, b double, y double")
    base, bins, _, _, rows = fo._integer_table(df, "y", ["a", "b"], "k", 64, 1, together=True)
    plan = fo.Plan(2, 8, 1, seed=3, widths=fo._widths(bins, ["a", "b"]))
    a, b = (fo._grow(base, plan, 3, rows, 50, whole) for whole in (True, False))
    assert all(len(u.state) == 1 for u in a[0][1]) and all(len(u.state) > 1 for u in b[0][1])
    assert np.allclose(fo._tree_gains(a, 3, 2), fo._tree_gains(b, 3, 2), rtol=1e-12)
