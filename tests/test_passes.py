"""Frames that are read many times are written once, and passes that can be shared are."""

import numpy as np
from pyspark.sql import functions as F

from ridgeline.operators import boost
from ridgeline.operators import cart as ca
from ridgeline.operators import hist as hs
from ridgeline.operators import model_trees as mt
from ridgeline.operators import neighbors as nb
from ridgeline.operators import resampling as rs
from ridgeline.operators import trees as tr
from ridgeline.operators import tuning as tu


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _grouped(spark, n=200):
    return (spark.range(n * 2).groupBy((F.col("id") % n).alias("k")).agg(F.sum("id").cast("double").alias("x"))
            .withColumn("y", F.col("x") * 2 + F.col("k") % 7))


def test_tuning_reads_a_written_frame(spark):
    seen = []

    class Mean:
        def transform(self, df):
            seen.append(_plan(df))
            return df.withColumn("prediction", F.lit(0.0))

    def fit(df, a):
        seen.append(_plan(df))
        return Mean()

    d = rs.kfold(_grouped(spark), 3, "k")
    rows, _, _ = tu.cv_tune(d, "y", fit, [{"a": 1}, {"a": 2}], refit=False)
    assert len(rows) == 2 and len(seen) == 12
    assert not any("Aggregate" in p for p in seen)


def test_validation_split_reads_a_written_frame(spark):
    d = rs.train_valid_test(_grouped(spark), "y", 0.75, 0.2, "k")
    assert "Aggregate" not in _plan(d)
    assert d.count() == 200


def test_cv_of_trees_reads_a_written_frame(spark, monkeypatch):
    seen, grow = [], ca.grow_cart
    monkeypatch.setattr(ca, "grow_cart", lambda d, *a, **b: seen.append(_plan(d)) or grow(d, *a, **b))
    tr.cv_cp(rs.kfold(_grouped(spark), 2, "k"), "y", ["x"], "fold", [0.1])
    assert len(seen) == 2 and not any("Aggregate" in p for p in seen)


def test_bins_by_comparison_are_the_searched_ones():
    x = np.array([np.nan, -1.0, 0.0, 0.5, 1.0, 2.0, 9.0])
    for cuts in ([], [0.0], [0.0, 1.0, 2.0]):
        assert (hs.bin_of(np.array(cuts), x) == np.searchsorted(np.array(cuts), x, side="left")).all()


def test_errors_share_a_pass(spark, monkeypatch):
    rng = np.random.default_rng(3)
    d = spark.createDataFrame([(i, float(a), float(b), float(2 * a - b), i % 4 == 0) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))],
                              "k long, a double, b double, y double, v boolean")
    calls, whole = [], boost.GridBoost._errors
    monkeypatch.setattr(boost.GridBoost, "_errors", lambda self: calls.append(1) or whole(self))
    model, curve, _ = boost.GridBoost(d, "y", ["a", "b"], "k", [boost.Spec(4, min_child=5.0)], 1, 16, "v").fit(10)[0]
    assert len(curve) == 10 and len(calls) == 3
    p = model.transform(d.where("v")).select(F.sqrt(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)))).first()[0]
    assert abs(p - curve[-1]) < 1e-9


def test_joint_counts_are_the_histograms():
    rng = np.random.default_rng(4)
    coder = boost.Coder(["a", "b", "c", "d"], {"a": list(range(39)), "b": [0.5], "c": list(range(25))}, {"d": [1.0, 2.0, 3.0]})
    x = np.stack([rng.integers(0, k, 5000) for k in coder.sizes]).astype(np.uint8)
    g, slot = rng.integers(-2 ** 35, 2 ** 35, 5000), rng.integers(0, 3, 5000)
    assert len(coder.bundles) < 4 and sorted(sum(coder.bundles, [])) == [0, 1, 2, 3]
    both = [boost.joint_counts(c, g.astype(float), slot, 3, b) for c, b in zip(boost.joint_codes(x, coder), boost.joint_bins(coder))]
    n, s = (boost.by_feature(list(v), 3, coder) for v in zip(*both))
    cells = x.T.astype(np.int32) + np.arange(4, dtype=np.int32) * coder.width
    for k in range(3):
        want = boost.histograms(cells[slot == k], g[slot == k], 4, coder.width)
        assert (n[k] == want[0]).all() and (s[k] == want[1]).all()


def test_walks_agree():
    rng = np.random.default_rng(5)
    mask = rng.random((7, 8)) < 0.5
    x = rng.integers(0, 8, (2, 1000)).astype(np.uint8)
    feature, left = np.array([0, 1, 0, -1, -1, -1, -1]), np.array([1, 3, 5, 0, 0, 0, 0])
    few = np.concatenate([boost.walk(x[:, k:k + 50], feature, left, mask) for k in range(0, 1000, 50)])
    assert (boost.walk(x, feature, left, mask) == few).all()
    at = np.zeros(1000, int)
    for r in range(1000):
        while feature[at[r]] >= 0:
            at[r] = left[at[r]] + (not mask[at[r], x[feature[at[r]], r]])
    assert (at == few).all()


def test_one_search_for_every_number_of_neighbors(spark, monkeypatch):
    rng = np.random.default_rng(6)
    d = spark.createDataFrame([(i, float(a), float(b), float(a + b * b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))],
                              "k long, a double, b double, y double")

    class Zero:
        def transform(self, df, out="prediction"):
            return df.withColumn(out, F.col("a"))

    train, te = d.where("k >= 60"), d.where("k < 60")
    calls, search = [], nb.nearest
    monkeypatch.setattr(nb, "nearest", lambda *a, **b: calls.append(1) or search(*a, **b))
    got = {r["k"]: r for r in mt.neighbor_corrections(Zero(), train, te, "y", "k", ["a", "b"], 4).collect()}
    assert len(got) == 60 and len(calls) == 1
    for k in range(5):
        for r in mt.neighbor_correction(Zero(), train, te, "y", "k", ["a", "b"], k).collect():
            assert abs(r["prediction"] - got[r["k"]][f"prediction{k}"]) < 1e-9
