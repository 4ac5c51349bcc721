import duckdb
import numpy as np
import pyspark.sql.functions as F

from ridgeline.functions.hashing import hash_uniform, hash_uniform_sql, poisson_thresholds
from ridgeline.operators import quantiles as q


def test_hash_uniform_matches_sql(spark):
    df = spark.range(200).select(F.col("id").alias("k"))
    got = {r["k"]: r["u"] for r in df.select("k", hash_uniform(7, "k").alias("u")).collect()}
    con = duckdb.connect()
    rows = con.execute(f"SELECT k, {hash_uniform_sql(7, 'k')} AS u FROM range(200) t(k)").fetchall()
    for k, u in rows:
        assert got[k] == u
    assert all(0 <= v < 1 for v in got.values())


def test_poisson_thresholds_are_cdf():
    th = poisson_thresholds(1.0, 5)
    assert abs(th[0] - np.exp(-1)) < 1e-15
    assert abs(th[1] - 2 * np.exp(-1)) < 1e-15


def test_kth_values_refinement_matches_sort(spark, hh, hh_pd):
    y = np.sort(hh_pd["log_income_pc"].to_numpy())
    ks = [0, 17, len(y) // 2, len(y) - 1]
    # tiny max_collect forces several histogram passes
    got = q.kth_values(hh, "log_income_pc", {(): ks}, max_collect=8)
    for k in ks:
        v, n_less = got[((), k)]
        assert v == y[k]
        assert n_less == int((y < v).sum())


def test_quantiles_type7(spark, hh, hh_pd):
    y = hh_pd["log_income_pc"].to_numpy()
    got = q.quantiles(hh, "log_income_pc", [0.1, 0.25, 0.5, 0.9], max_collect=16)[()]
    want = np.quantile(y, [0.1, 0.25, 0.5, 0.9])  # numpy "linear" == R type 7
    assert np.allclose(got, want, rtol=0, atol=1e-12)


def test_grouped_quantiles(spark, hh, hh_pd):
    got = q.quantiles(hh, "log_income_pc", [0.5], by=["computer"], max_collect=4)
    for g, sub in hh_pd.groupby("computer"):
        assert abs(got[(g,)][0] - np.quantile(sub["log_income_pc"], 0.5)) < 1e-12
