import numpy as np
import pyspark.sql.functions as F

from ridgeline.functions.fixed_values import EDUCATION_POSITION_RULES, UNINFORMATIVE_LABELS
from ridgeline.operators import filters as flt
from ridgeline.operators import recode as rc
from ridgeline.operators import tables as tb
from ridgeline.plans import fixtures as fx
from ridgeline.session import scratch_path
from ridgeline.sources import survey as src
from sf_dirs import SF_SMALL


def test_level_position_is_dense_rank(spark):
    raw = fx.hh_raw(spark, SF_SMALL).select("hhid", "head_age")
    got = rc.level_position(raw, "head_age", out="pos").toPandas().sort_values("hhid")
    want = got["head_age"].rank(method="dense").astype(int)
    assert (got["pos"].to_numpy() == want.to_numpy()).all()


def test_levels_by_first_seen(spark):
    raw = fx.hh_raw(spark, SF_SMALL)
    got = [r["level"] for r in rc.levels_by_first_seen(raw, "district_label", "hhid").orderBy("position").collect()]
    pdf = raw.select("hhid", "district_label").toPandas().sort_values("hhid")
    assert got == list(dict.fromkeys(pdf["district_label"]))


def test_dummies_full_and_design_matrix(spark, hh):
    d = rc.dummies_full(hh, ["prov"])
    cols = [c for c in d.columns if c.startswith("prov_")]
    assert d.select(sum(F.col(c) for c in cols).alias("s")).distinct().collect()[0]["s"] == 1
    m = rc.design_matrix(hh, ["prov"])
    assert len([c for c in m.columns if c.startswith("prov_")]) == len(cols) - 1


def test_dummies_omit_constants(spark):
    raw = fx.hh_raw(spark, SF_SMALL).select("head_gender", "const_flag")
    d = rc.dummies_full(raw, ["head_gender", "const_flag"], omit_constants=True)
    assert "const_flag_1" not in d.columns and "head_gender_1" in d.columns


def test_recode_ranges_matches_python(spark):
    raw = fx.hh_raw(spark, SF_SMALL).select("head_educ")
    got = raw.select("head_educ", rc.recode_ranges(F.col("head_educ"), EDUCATION_POSITION_RULES).alias("y")).collect()

    def py(x):
        for lo, hi, v in EDUCATION_POSITION_RULES:
            if (lo is None or x >= lo) and x <= hi:
                return None if v is None else (x - v[1] if isinstance(v, tuple) else v)
        return x
    assert all(r["y"] == py(r["head_educ"]) for r in got)


def test_near_zero_variance_matches_pandas(spark):
    raw = fx.hh_raw(spark, SF_SMALL)
    cols = ["hhsizer", "h_dwltyp", "const_flag", "head_gender"]
    got = {r["variable"]: r for r in tb.near_zero_variance(raw, cols).collect()}
    pdf = raw.select(*cols).toPandas()
    for c in cols:
        vc = pdf[c].value_counts()
        ratio = 0.0 if len(vc) <= 1 else vc.iloc[0] / vc.iloc[1]
        assert abs(got[c]["freq_ratio"] - ratio) < 1e-12
        assert abs(got[c]["percent_unique"] - 100 * len(vc) / len(pdf)) < 1e-12
    assert got["const_flag"]["nzv"] and got["const_flag"]["zero_var"]


def test_decode_and_null_labels(spark):
    raw = fx.hh_raw(spark, SF_SMALL)
    d = rc.decode_labels(raw, fx.value_labels(spark), ["h_owncom"])
    d = flt.null_labels(d.select("hhid", "h_owncom"), UNINFORMATIVE_LABELS, ["h_owncom"])
    vals = {r[0] for r in d.select("h_owncom").distinct().collect()}
    assert vals <= {"yes", "no", None} and "Refused" not in vals


def test_snapshot_roundtrip(spark, hh):
    path = scratch_path(spark, "t")
    back = src.write_snapshot(hh, path)
    assert back.count() == hh.count() and back.columns == hh.columns
    one = src.write_best_params(hh.agg(F.count("*").alias("n")), scratch_path(spark, "bp"))
    assert one.first()["n"] == hh.count()


def test_corr_matrix_matches_numpy(spark, hh, hh_pd):
    cols = ["members", "rooms", "log_income_pc"]
    got = {(r["var1"], r["var2"]): r["r"] for r in tb.corr_matrix(hh, cols).collect()}
    R = np.corrcoef(hh_pd[cols].to_numpy(float).T)
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            assert abs(got[(a, b)] - R[i, j]) < 1e-10


def test_assemble_keeps_rows_with_nulls(spark):
    from ridgeline.operators import projections as pj
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, None, 3.0)], "y double, a double, b double")
    got = [[str(float(v)) for v in r["features"]] for r in pj.assemble(df, "y").orderBy("a").collect()]
    assert got == [["nan", "3.0"], ["2.0", "3.0"]]


def test_near_zero_variance_counts_ties_and_single_values(spark):
    from ridgeline.operators import tables as tb
    rows = [(1, "a" if i < 20 else "b" if i < 40 else f"v{i}", i % 2, None if i % 3 else 1) for i in range(60)]
    df = spark.createDataFrame(rows, "one int, tie string, half int, holes int").repartition(5)
    got = {r["variable"]: (r["freq_ratio"], round(r["percent_unique"], 6), r["zero_var"]) for r in
           tb.near_zero_variance(df, ["one", "tie", "half", "holes"]).collect()}
    assert got == {"one": (0.0, round(100 / 60, 6), True), "tie": (1.0, round(2200 / 60, 6), False), "half": (1.0, round(200 / 60, 6), False),
                   "holes": (0.0, round(100 / 60, 6), True)}
