import math

import numpy as np
import pyspark.sql.functions as F

from ridgeline.operators import resampling as rs


def _train_keys(df):
    return sorted(r["hhid"] for r in df.filter("in_train").select("hhid").collect())


def test_stratified_split_exact_counts(spark, hh, hh_pd):
    d = rs.stratified_split(hh, "log_income_pc", 0.75, "hhid", seed=7)
    s = rs.outcome_strata(d, "log_income_pc").groupBy("_stratum").agg(
        F.count("*").alias("n"), F.sum(F.col("in_train").cast("int")).alias("k")).collect()
    for r in s:
        assert r["k"] == math.ceil(0.75 * r["n"])


def test_split_is_partition_invariant(spark, hh):
    a = _train_keys(rs.stratified_split(hh.repartition(1), "log_income_pc", 0.6, "hhid", seed=3))
    b = _train_keys(rs.stratified_split(hh.repartition(7, "prov"), "log_income_pc", 0.6, "hhid", seed=3))
    assert a == b


def test_complement_and_folds(spark, hh):
    d = rs.stratified_split(hh, "log_income_pc", 0.75, "hhid", seed=7)
    te = rs.complement(d, d.filter("in_train"), "hhid")
    assert te.count() + d.filter("in_train").count() == hh.count()
    f = rs.kfold(hh, 5, "hhid", seed=1).groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in f) == [0, 1, 2, 3, 4]
    assert sum(r["count"] for r in f) == hh.count()


def test_bootstrap_weights_mean_one(spark, hh):
    b = rs.bootstrap(hh, "hhid", draws=25, seed=5)
    m = b.agg(F.avg("weight")).first()[0]
    assert abs(m - 1.0) < 0.05
    assert b.filter("weight < 0").count() == 0


def test_random_design_within_bounds(spark):
    bounds = spark.range(1).select(F.lit(30).alias("hi"))
    d = rs.random_design(bounds, {"a": ("int", 1, "hi"), "b": ("num", 0.5, 1.0)}, 50, seed=2).toPandas()
    assert d["a"].between(1, 30).all() and d["b"].between(0.5, 1.0).all()
    assert len(d) == 50 and np.unique(d["a"]).size > 5
