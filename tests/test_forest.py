import duckdb
import numpy as np
import pyspark.sql.functions as F

from ridgeline.operators import forest as fo
from ridgeline.operators import ranking as rk
from ridgeline.operators import trees as tr
from ridgeline.operators import tuning as tu

X = ["members", "rooms", "head_age", "head_educ", "prov"]
Y = "log_income_pc"


def leaves(m):
    return sorted(map(tuple, m.leaves().collect()))


def brute(x, y, w, tree, plan):
    """The same tree, node by node: exact sums, first feature and lowest cut win ties."""
    out, todo = [], [(np.arange(len(y)), 1, 0)]
    while todo:
        rows, heap, depth = todo.pop()
        n, s = int(w[rows].sum()), int((w[rows].astype(object) * y[rows]).sum())
        best = (0.0, None)
        if n > plan.min_node and depth < plan.max_depth:
            tried = plan.tried(np.array([heap], np.uint64), tree)[0]
            for f in np.flatnonzero(tried):
                for c in np.unique(x[f, rows])[:-1]:
                    a = rows[x[f, rows] <= c]
                    nl, sl = int(w[a].sum()), int((w[a].astype(object) * y[a]).sum())
                    g = float(sl) ** 2 / nl + float(s - sl) ** 2 / (n - nl) - float(s) ** 2 / n
                    if g > best[0] * (1 + 1e-12):
                        best = (g, (f, c))
        if best[1] is None:
            out.append((n, s / n))
            continue
        f, c = best[1]
        go = x[f, rows] > c
        todo += [(rows[~go], 2 * heap, depth + 1), (rows[go], 2 * heap + 1, depth + 1)]
    return sorted(out)


def test_tree_in_a_task_equals_brute_force():
    rnd = np.random.default_rng(4)
    x = rnd.integers(0, 12, (5, 300)).astype(np.uint8)
    y = (x[0].astype(np.int64) * 1000 + x[3] * 77 + rnd.integers(-900, 900, 300))
    w = rnd.integers(1, 4, 300).astype(np.uint8)
    for tree, plan in enumerate([fo.Plan(5, 12, 5), fo.Plan(5, 12, 2, seed=9), fo.Plan(5, 12, 3, min_node=40), fo.Plan(5, 12, 5, max_depth=3)]):
        got = fo.grow_local(x, y, w, tree, 1, 0, plan)
        f, n, v = (np.concatenate(a) for a in (got.feature, got.n, got.value))
        assert np.allclose(sorted(zip(n[f < 0], v[f < 0])), brute(x, y, w, tree, plan))


def test_partitions_and_local_rows_do_not_matter(spark, hh):
    a = fo.fit_forest(hh, Y, X, "hhid", trees=6, mtry=2)
    assert a.size() > 100
    for df, local in ((hh.repartition(7), fo.LOCAL_ROWS), (hh, 40), (hh.repartition(1), 150)):
        b = fo.fit_forest(df, Y, X, "hhid", trees=6, mtry=2, local_rows=local)
        assert leaves(b) == leaves(a) and b.size() == a.size() and np.allclose(a.gains(), b.gains())
        assert (sum(len(u.heap) for _, ups, _ in b.batches for u in ups) > 20) == (local < len(hh.columns) * 100)
        p, q = (sorted(map(tuple, m.transform(hh).select("hhid", F.round("prediction", 9)).collect())) for m in (a, b))
        assert p == q


def test_batches_of_trees(spark, hh, monkeypatch):
    a = fo.fit_forest(hh, Y, X, "hhid", trees=5)
    monkeypatch.setattr(fo, "MAX_UPPER_NODES", 2)
    b = fo.fit_forest(hh, Y, X, "hhid", trees=5)
    assert len(b.batches) == 3 > len(a.batches) and leaves(a) == leaves(b)


def test_draws_are_a_bootstrap():
    h = np.random.default_rng(1).integers(0, 2 ** 63, 200_000).astype(np.uint64)
    w = np.stack([fo.Plan(3, 8, 1).draws(h, t) for t in range(3)])
    assert np.allclose(w.mean(1), 1, atol=0.01) and np.allclose(w.var(1), 1, atol=0.02) and abs(np.corrcoef(w)[0, 1]) < 0.01
    tried = fo.Plan(9, 8, 3).tried(np.arange(1, 60_001, dtype=np.uint64), 5)
    assert (tried.sum(1) == 3).all() and np.allclose(tried.mean(0), 1 / 3, atol=0.01)


def test_odd_rows(spark):
    rows = [(1, 1.0, 2.0, 5.0), (2, None, 2.0, 5.0), (3, 3.0, None, 9.0), (3, 3.0, None, 9.0), (None, 4.0, 1.0, None), (5, 9.0, 1.0, 1.0)] * 3
    df = spark.createDataFrame(rows, "k int, a double, b double, y double")
    m = fo.fit_forest(df, "y", ["a", "b"], "k", trees=3, min_node=1, bootstrap=False)
    got = m.transform(df).collect()
    assert len(got) == len(rows) and all(r["y"] is None or abs(r["y"] - r["prediction"]) < 1e-6 for r in got)
    flat = fo.fit_forest(df.withColumn("y", F.lit(2.5)), "y", ["a", "b"], "k", trees=2)
    assert {round(r["prediction"], 9) for r in flat.transform(df).collect()} == {2.5}
    hot = fo.fit_forest(df.withColumn("a", F.lit(1.0)), "y", ["a"], "k", trees=2, local_rows=2)  # an upper node that nothing splits
    assert {r["prediction"] for r in hot.transform(df).collect()} != {None} and len(leaves(hot)) == 2


def test_importances_and_predictions_beat_the_mean(spark, hh):
    m = fo.fit_forest(hh, Y, X, "hhid", trees=20, mtry=2)
    imp = {r["feature"]: r["importance"] for r in m.importances(spark).collect()}
    assert set(imp) == set(X) and min(imp.values()) >= 0
    r = m.transform(hh).agg(F.avg(F.pow(F.col(Y) - F.col("prediction"), 2)).alias("mse"), F.var_pop(Y).alias("v")).first()
    assert r["mse"] < 0.6 * r["v"]


def test_shadow_selection_keeps_correlated_features(spark):
    u = lambda k: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1000)) / 1000
    df = (spark.range(1500).withColumn("a", u(1)).withColumn("b", F.col("a") + u(2) * 0.05).withColumn("c", u(3)).withColumn("d", u(4))
          .withColumn("y", F.col("a") * 3 + u(5)))
    got = {r["feature"]: r["decision"] for r in tu.shadow_selection(df, "y", "id", ["a", "b", "c", "d"], rounds=9, trees=12).collect()}
    assert got["a"] == got["b"] == "confirmed" and got["c"] != "confirmed" and got["d"] != "confirmed"


def test_shadows_are_permutations(spark, hh):
    n = hh.count()
    at = hh.sparkSession.range(n).select(*[rk.shuffled(n, s, F.col("id")).alias(f"s{s}") for s in (1, 2)]).toPandas()
    assert sorted(at.s1) == sorted(at.s2) == list(range(n)) and (at.s1 != at.s2).any()


def test_running_sums_of_many_values(spark):
    n = 400_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("g"), "id")
    df = df.withColumn("y", F.sin(F.col("id") * 0.001) + (F.col("x") > 0.37 * n).cast("int")).repartition(7)
    best = tr.competitor_splits(df, "y", ["x", "g"], k=2).collect()
    i = np.arange(n)
    x = i * 7919 % n
    y = np.sin(i * 0.001) + (x > 0.37 * n)
    c = np.cumsum((y - y.mean())[np.argsort(x)])[:-1]
    gain = c * c / np.arange(1, n) + c * c / (n - np.arange(1, n))
    assert best[0]["feature"] == "x" and best[0]["cut_value"] == gain.argmax() and abs(best[0]["gain"] / gain.max() - 1) < 1e-9
    s = tr.surrogate_splits(df, F.col("x") <= 100_000, ["x", "g"], k=2).first()
    assert (s["feature"], s["cut_value"], s["agree"]) == ("x", 100_000, n)


def test_numbers_by_group(spark):
    df = spark.createDataFrame([(g, v % 7) for g in (None, "a", "b") for v in range(50)] + [("c", None)], "g string, v int").repartition(5)
    got = rk.number_rows(df, ["v"], ["g"]).collect()
    for g in (None, "a", "b", "c"):
        mine = sorted((r["pos"], r["v"]) for r in got if r["g"] == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted((v for _, v in mine), key=lambda v: v or 0)
    assert rk.number_rows(df.limit(0), ["v"]).count() == 0


def test_closed_form_queries(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("customer", "orders", "nation", "lineitem", "events", "supplier", "part", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("b1_one_tree_leaves", "b2_forest_predictions"):
        df = E.queries()[name](spark, sf)
        want = con.execute(E.oracle_sql()[name]).df()[sorted(df.columns)]
        got = df.select(sorted(df.columns)).toPandas()
        assert len(got) == len(want) > 3
        assert np.allclose(np.array(sorted(map(tuple, got.to_numpy()))), np.array(sorted(map(tuple, want.to_numpy()))), atol=2e-4)
