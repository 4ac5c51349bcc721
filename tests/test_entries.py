"""Rows of equal bins are one entry of the boosting engine; a task grows whole models from them."""

import math

import numpy as np
import pyspark.sql.functions as F
import pytest

from ridgeline.operators import boost as bo

X = ["members", "rooms", "head_age", "head_educ", "prov"]
Y = "log_income_pc"


def shape(m):
    return [[(i, n.feature, n.cut, n.stat.get("left"), n.left, n.right, n.n, n.value) for i, n in sorted(t.nodes.items())] for t in m.trees]


def _never(*a, **b):
    raise AssertionError("a pass per round")


def test_tasks_grow_what_passes_grow(spark, hh, monkeypatch):
    d = hh.withColumn("_v", F.pmod(F.xxhash64("hhid"), F.lit(4)) == 0)
    specs = [bo.Spec(9, k, 0.4, min_child=3, subsample=s, colsample=0.7) for k in (3, 40, 64) for s in (1.0, 0.7)] + [bo.Spec(0, 2, 0.9, 1.0, min_child=1)]
    fit = lambda **k: bo.GridBoost(d, Y, X, "hhid", specs, valid_col="_v", categorical=["prov"], **k).fit(7, 3)
    passes = fit(local_rows=60)
    monkeypatch.setattr(bo.GridBoost, "_round", _never)
    tasks = fit()
    for (a, ca, ra), (b, cb, rb) in zip(tasks, passes):
        assert shape(a) == shape(b) and ra == rb
        assert len(ca) == len(cb) and np.allclose(ca, cb, rtol=0, atol=1e-10)
    curves = bo.GridBoost(d, Y, X, "hhid", specs, valid_col="_v", categorical=["prov"]).fit(7, 3, models=False)
    assert all(m is None for m, _, _ in curves) and [c for _, c, _ in curves] == [c for _, c, _ in tasks]


@pytest.mark.parametrize("share", [1.0, 0.8])
def test_equal_rows_are_one_entry(spark, share):
    rows = [(i, float(i % 3), float(i % 4), float((i * 7) % 11) + (i % 3), i % 5 == 0) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, a double, b double, y double, v boolean")
    spec = bo.Spec(6, -1, 0.5, min_child=4, subsample=share)
    e = bo.GridBoost(df, "y", ["a", "b"], "k", [spec], valid_col="v")
    assert e.rows == 600 and e.entries <= 12
    m, curve, _ = e.fit(3)[0]
    p = m.transform(df.where("v")).agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)))).first()[0]
    assert abs(p - curve[-1]) < 1e-9 and m.trees[0].nodes[1].n == (480 if share == 1.0 else pytest.approx(480 * share, rel=0.15))


def test_sums_stay_exact_beyond_53_bits():
    g = np.array([2 ** 60 + 1, -(2 ** 60) + 5, 3, 2 ** 55 + 7], np.int64)
    at = np.array([0, 0, 1, 1])
    assert len(bo.exact_parts(g)) == 2 and bo.summed(at, bo.exact_parts(g), 2).tolist() == [6, 2 ** 55 + 10]


def test_one_partition_per_team(spark):
    for n in (1, 7, 40):
        keys = bo._spread(spark, n)
        got = spark.createDataFrame([(k,) for k in keys], "team int").repartition(n, "team").withColumn("p", F.spark_partition_id()).collect()
        assert len(keys) == len(set(keys)) == n and {r["team"]: r["p"] for r in got} == {k: i for i, k in enumerate(keys)}
    assert math.prod(bo.joint_bins(bo.Coder(["a"], {"a": [1.0]}, {}))) == 2


def test_rows_as_entries_give_the_same_tree(spark, hh):
    spec = bo.Spec(0, 4, min_child=5.0)
    trees = [bo.GridBoost(hh, Y, X, "hhid", [spec], merge=merge).grow_tree() for merge in (True, False)]
    a, b = ([(i, n.feature, n.cut, n.n, n.value) for i, n in sorted(t.nodes.items())] for t in trees)
    assert a == b and len(a) > 5
