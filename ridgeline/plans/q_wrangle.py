"""Registered queries: sources, projections, filters and recoding (S, P, F, R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed_values import (DISTRICT_LABEL_PATTERNS, EDUCATION_CODE_NULL, EDUCATION_CODE_RULES,
                                      EDUCATION_POSITION_RULES, SENTINEL_CODES, UNINFORMATIVE_LABELS)
from ..operators import filters as flt
from ..operators import projections as prj
from ..operators import recode as rc
from ..session import scratch_path
from ..sources import survey as src
from . import fixtures as fx
from .fixture_sql import EARN, HH, HH_RAW, VALUE_LABELS, VALUE_LABELS_FULL, with_ctes
from .registry import r4, r4s, register

HH_RAW_COLS = ["hhid", "hhincome", "hhsizer", "h_dwlrms", "head_age", "head_educ", "h_dwltyp", "hhprov",
               "h_owncom", "h_ownwsh", "head_gender", "district_label", "const_flag"]
EARN_COLS = ["pid", "age", "educ", "occupation", "union_code", "wave", "hours", "tenure", "wages"]
HH_COLS = ["hhid", "log_income_pc", "members", "rooms", "head_age", "head_educ", "dwelling", "prov",
           "computer", "washer", "head_gender"]


def _hh_sql_cols(alias=""):
    p = f"{alias}." if alias else ""
    return ", ".join([f"{p}hhid", r4s(f"{p}log_income_pc") + " AS log_income_pc"]
                     + [f"{p}{c}" for c in HH_COLS[2:]])


# ------------------------------------------------------------------ S ---

@register("s1_read_survey", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def s1_read_survey(spark, sf_dir):
    schema = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string"
    return src.read_survey(spark, f"{sf_dir}/orders.parquet", schema=schema)


@register("s2_read_survey_filtered",
          "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 10")
def s2_read_survey_filtered(spark, sf_dir):
    return src.read_survey(spark, f"{sf_dir}/events.parquet",
                           where=(F.col("event_type") == "purchase") & (F.col("value") > 10),
                           columns=["event_id", "user_id", "value"])


@register("s3_read_snapshot", with_ctes(HH_RAW, HH) + f"SELECT {_hh_sql_cols()} FROM hh")
def s3_read_snapshot(spark, sf_dir):
    path = scratch_path(spark, "hh_snapshot")
    fx.hh(spark, sf_dir).write.mode("overwrite").parquet(path)
    return r4(src.read_snapshot(spark, path))


@register("s4_write_snapshot", with_ctes(HH_RAW) + "SELECT * FROM hh_raw")
def s4_write_snapshot(spark, sf_dir):
    return src.write_snapshot(fx.hh_raw(spark, sf_dir), scratch_path(spark, "hh_raw"))


@register("s5_write_subset", with_ctes(HH_RAW, HH) + "SELECT hhid, " + r4s("log_income_pc")
          + " AS log_income_pc, members FROM hh")
def s5_write_subset(spark, sf_dir):
    return r4(src.write_subset(fx.hh(spark, sf_dir), scratch_path(spark, "hh_small"), first=3))


@register("s6_write_best_params")
def s6_write_best_params(spark, sf_dir):
    """One-row summary of the model frame written as a single CSV and read back."""
    hh = fx.hh(spark, sf_dir)
    row = hh.agg(F.count("*").alias("n"), F.avg("log_income_pc").alias("mean_y"),
                 F.max("members").alias("max_members"))
    return src.write_best_params(row, scratch_path(spark, "best_params"))


@register("s7_read_value_labels", with_ctes(VALUE_LABELS, VALUE_LABELS_FULL)
          + "SELECT variable, code, label, CAST(row_number() OVER (PARTITION BY variable ORDER BY code) AS INT)"
            " AS position FROM value_labels_full")
def s7_read_value_labels(spark, sf_dir):
    path = scratch_path(spark, "value_labels")
    src.write_value_labels(fx.value_labels(spark, sf_dir), path)
    return src.read_value_labels(spark, path)


# ------------------------------------------------------------------ P ---

@register("p1_select_first", with_ctes(HH_RAW) + "SELECT head_age, head_educ, * EXCLUDE (head_age, head_educ) "
                                                 "FROM hh_raw")
def p1_select_first(spark, sf_dir):
    return prj.select_first(fx.hh_raw(spark, sf_dir), ["head_age", "head_educ"])


@register("p2_drop_cols", with_ctes(EARN) + "SELECT pid, age, educ, union_code, wages FROM earn")
def p2_drop_cols(spark, sf_dir):
    return prj.drop_cols(fx.earn(spark, sf_dir), names=["occupation"], ranges=[("wave", "tenure")])


@register("p3_rename_map", with_ctes(HH_RAW) + "SELECT hhid, hhincome, hhsizer AS members, h_dwlrms AS rooms, "
          "head_age, head_educ, h_dwltyp AS dwelling, hhprov AS prov, h_owncom AS computer, h_ownwsh AS washer, "
          "head_gender, district_label, const_flag FROM hh_raw")
def p3_rename_map(spark, sf_dir):
    return prj.rename_map(fx.hh_raw(spark, sf_dir), fx.HH_RENAME)


@register("p4_cast_range", with_ctes(EARN) + "SELECT pid, CAST(age AS DOUBLE) AS age, CAST(educ AS DOUBLE) AS educ, "
          "occupation, union_code, wave, hours, tenure, wages FROM earn")
def p4_cast_range(spark, sf_dir):
    return prj.cast_range(fx.earn(spark, sf_dir), 1, 2, "double")


_INT_COLS = ["hhsizer", "h_dwlrms", "head_age", "head_educ", "h_dwltyp", "hhprov", "h_owncom", "h_ownwsh",
             "head_gender", "const_flag"]


@register("p5_map_by_type", with_ctes(HH_RAW) + "SELECT hhid, hhincome, district_label, "
          + ", ".join(f"CASE WHEN {c} >= 1 THEN {c} END AS {c}" for c in _INT_COLS) + " FROM hh_raw")
def p5_map_by_type(spark, sf_dir):
    return prj.map_by_type(fx.hh_raw(spark, sf_dir), "integer", lambda c: F.when(c >= 1, c))


@register("p6_log_ratio", with_ctes(HH_RAW) + "SELECT hhid, " + r4s("ln(CAST(hhincome AS DOUBLE) / hhsizer)")
          + " AS log_income_pc FROM hh_raw")
def p6_log_ratio(spark, sf_dir):
    d = prj.log_ratio(fx.hh_raw(spark, sf_dir), "hhincome", "hhsizer", "log_income_pc")
    return r4(d.select("hhid", "log_income_pc"))


@register("p7_log_cols", with_ctes(EARN) + "SELECT pid, " + r4s("ln(wages)") + " AS log_wages, "
          + r4s("ln(hours)") + " AS log_hours FROM earn WHERE wages > 0 AND hours > 0")
def p7_log_cols(spark, sf_dir):
    d = flt.filter_valid(fx.earn(spark, sf_dir), positive=["wages", "hours"])
    return r4(prj.log_cols(d, {"log_wages": "wages", "log_hours": "hours"}).select("pid", "log_wages", "log_hours"))


@register("p8_offset", with_ctes(HH_RAW) + "SELECT hhid, head_gender - 1 AS head_gender FROM hh_raw")
def p8_offset(spark, sf_dir):
    return prj.offset(fx.hh_raw(spark, sf_dir), "head_gender", 1).select("hhid", "head_gender")


@register("p9_slice_cols", with_ctes(HH_RAW) + "SELECT hhid, hhincome, hhsizer, head_educ, h_dwltyp FROM hh_raw")
def p9_slice_cols(spark, sf_dir):
    return prj.slice_cols(fx.hh_raw(spark, sf_dir), [(0, 2), (5, 6)])


@register("p10_assemble")
def p10_assemble(spark, sf_dir):
    """Vector column of every non-outcome column of the cleaned frame."""
    hh = fx.hh(spark, sf_dir)
    return prj.assemble(hh, "log_income_pc", exclude=["hhid"]).select("hhid", "log_income_pc", "features")


# ------------------------------------------------------------------ F ---

@register("f1_filter_eq", with_ctes(EARN) + "SELECT * FROM earn WHERE wave = 15")
def f1_filter_eq(spark, sf_dir):
    return flt.filter_eq(fx.earn(spark, sf_dir), "wave", 15)


@register("f2_filter_valid", with_ctes(EARN) + "SELECT * FROM earn WHERE wages IS NOT NULL AND tenure > 0")
def f2_filter_valid(spark, sf_dir):
    return flt.filter_valid(fx.earn(spark, sf_dir), not_null=["wages"], positive=["tenure"])


_NULLED = ("SELECT hhid, hhincome, hhsizer, CASE WHEN h_dwlrms >= 1 THEN h_dwlrms END AS h_dwlrms, "
           "CASE WHEN head_age >= 1 THEN head_age END AS head_age, head_educ FROM hh_raw")


@register("f3_complete_cases", with_ctes(HH_RAW) + f"SELECT * FROM ({_NULLED}) t "
          "WHERE h_dwlrms IS NOT NULL AND head_age IS NOT NULL")
def f3_complete_cases(spark, sf_dir):
    d = flt.null_below(fx.hh_raw(spark, sf_dir), ["h_dwlrms", "head_age"], 1)
    return flt.complete_cases(d.select("hhid", "hhincome", "hhsizer", "h_dwlrms", "head_age", "head_educ"))


@register("f4_complete_subset", with_ctes(HH_RAW) + f"SELECT * FROM ({_NULLED}) t WHERE h_dwlrms IS NOT NULL")
def f4_complete_subset(spark, sf_dir):
    d = flt.null_below(fx.hh_raw(spark, sf_dir), ["h_dwlrms", "head_age"], 1)
    d = d.select("hhid", "hhincome", "hhsizer", "h_dwlrms", "head_age", "head_educ")
    return flt.complete_cases(d, subset=["h_dwlrms"])


_SENT = ", ".join(str(c) for c in SENTINEL_CODES)


@register("f5_exclude_codes", with_ctes(HH_RAW) + "SELECT * FROM hh_raw WHERE NOT (h_dwltyp IN (" + _SENT
          + ") OR h_owncom IN (" + _SENT + ") OR h_ownwsh IN (" + _SENT + ", 9))")
def f5_exclude_codes(spark, sf_dir):
    codes = {"h_dwltyp": SENTINEL_CODES, "h_owncom": SENTINEL_CODES, "h_ownwsh": SENTINEL_CODES + [9]}
    return flt.exclude_codes(fx.hh_raw(spark, sf_dir), codes)


@register("f6_null_below", with_ctes(HH_RAW) + "SELECT hhid, CASE WHEN hhsizer >= 1 THEN hhsizer END AS hhsizer, "
          "CASE WHEN h_dwlrms >= 1 THEN h_dwlrms END AS h_dwlrms, "
          "CASE WHEN head_age >= 1 THEN head_age END AS head_age FROM hh_raw")
def f6_null_below(spark, sf_dir):
    d = flt.null_below(fx.hh_raw(spark, sf_dir), ["hhsizer", "h_dwlrms", "head_age"], 1)
    return d.select("hhid", "hhsizer", "h_dwlrms", "head_age")


_LABELLED = ["h_dwltyp", "h_owncom", "h_ownwsh"]
_UNINF = ", ".join("'" + s.replace("'", "''") + "'" for s in UNINFORMATIVE_LABELS)


def _decode_sql(cols, null_uninformative=False):
    sel, joins = ["r.hhid"], []
    for i, c in enumerate(cols):
        lab = f"v{i}.label"
        if null_uninformative:
            lab = f"CASE WHEN {lab} IN ({_UNINF}) THEN NULL ELSE {lab} END"
        sel.append(f"{lab} AS {c}")
        joins.append(f"LEFT JOIN value_labels v{i} ON v{i}.variable = '{c}' AND v{i}.code = r.{c}")
    return f"SELECT {', '.join(sel)} FROM hh_raw r {' '.join(joins)}"


@register("f7_null_labels", with_ctes(HH_RAW, VALUE_LABELS) + _decode_sql(_LABELLED, True))
def f7_null_labels(spark, sf_dir):
    d = rc.decode_labels(fx.hh_raw(spark, sf_dir), fx.value_labels(spark), _LABELLED)
    return flt.null_labels(d.select("hhid", *_LABELLED), UNINFORMATIVE_LABELS, _LABELLED)


@register("f8_null_codes", with_ctes(HH_RAW) + "SELECT hhid, CASE WHEN head_educ < 0 THEN NULL ELSE head_educ END "
          "AS head_educ FROM hh_raw")
def f8_null_codes(spark, sf_dir):
    return flt.null_codes(fx.hh_raw(spark, sf_dir), "head_educ", lambda c: c < 0).select("hhid", "head_educ")


# ------------------------------------------------------------------ R ---

def _rules_sql(x, rules):
    parts = []
    for lo, hi, v in rules:
        if lo is None:
            t = f"{x} <= {hi}"
        elif lo == hi:
            t = f"{x} = {lo}"
        else:
            t = f"{x} >= {lo} AND {x} <= {hi}"
        if v is None:
            val = "NULL"
        elif isinstance(v, tuple):
            val = f"{x} - {v[1]}"
        else:
            val = str(v)
        parts.append(f"WHEN {t} THEN {val}")
    return f"CAST(CASE {' '.join(parts)} ELSE {x} END AS INT)"


@register("r1_recode_ranges", with_ctes(HH_RAW) + "SELECT hhid, "
          + _rules_sql("head_educ", EDUCATION_POSITION_RULES) + " AS educ_years FROM hh_raw")
def r1_recode_ranges(spark, sf_dir):
    d = fx.hh_raw(spark, sf_dir)
    return d.select("hhid", rc.recode_ranges(F.col("head_educ"), EDUCATION_POSITION_RULES).alias("educ_years"))


_R2 = _rules_sql("head_educ", EDUCATION_CODE_RULES)


@register("r2_recode_nested", with_ctes(HH_RAW) + f"SELECT hhid, CASE WHEN {_R2} < 0 OR {_R2} IN ("
          + ", ".join(map(str, EDUCATION_CODE_NULL)) + f") THEN NULL ELSE {_R2} END AS educ_years FROM hh_raw")
def r2_recode_nested(spark, sf_dir):
    d = fx.hh_raw(spark, sf_dir)
    return d.select("hhid", rc.recode_nested(F.col("head_educ"), EDUCATION_CODE_RULES,
                                             EDUCATION_CODE_NULL).alias("educ_years"))


@register("r3_binary_recode", with_ctes(EARN) + "SELECT pid, CAST(CASE WHEN union_code IS NULL THEN NULL "
          "WHEN union_code = 6 THEN 0 ELSE 1 END AS INT) AS union_member FROM earn")
def r3_binary_recode(spark, sf_dir):
    d = fx.earn(spark, sf_dir)
    return d.select("pid", rc.binary_recode(F.col("union_code"), 6).alias("union_member"))


_DECODED = ["h_dwltyp", "hhprov", "h_owncom", "h_ownwsh"]


@register("r4_decode_labels", with_ctes(HH_RAW, VALUE_LABELS) + _decode_sql(_DECODED))
def r4_decode_labels(spark, sf_dir):
    d = rc.decode_labels(fx.hh_raw(spark, sf_dir), fx.value_labels(spark), _DECODED)
    return d.select("hhid", *_DECODED)


def _replace_chain(x):
    for p in DISTRICT_LABEL_PATTERNS:
        x = f"replace({x}, '{p}', '')"
    return x


@register("r5_clean_label_text", with_ctes(HH_RAW) + "SELECT hhid, " + _replace_chain("district_label")
          + " AS district_label FROM hh_raw")
def r5_clean_label_text(spark, sf_dir):
    d = fx.hh_raw(spark, sf_dir).select("hhid", "district_label")
    return rc.clean_label_text(d, DISTRICT_LABEL_PATTERNS, "district_label")


@register("r6_levels_by_first_seen", with_ctes(HH_RAW) + "SELECT district_label AS level, "
          "CAST(row_number() OVER (ORDER BY min(hhid), district_label) AS INT) AS position "
          "FROM hh_raw GROUP BY district_label")
def r6_levels_by_first_seen(spark, sf_dir):
    return rc.levels_by_first_seen(fx.hh_raw(spark, sf_dir), "district_label", "hhid")


@register("r7_drop_unused_levels", with_ctes(HH_RAW, VALUE_LABELS) + " UNION ALL ".join(
    f"SELECT variable, code, label FROM value_labels WHERE variable = '{c}' AND code IN (SELECT {c} FROM hh_raw)"
    for c in _DECODED))
def r7_drop_unused_levels(spark, sf_dir):
    raw = fx.hh_raw(spark, sf_dir)
    labels = fx.value_labels(spark)
    parts = [rc.drop_unused_levels(labels.filter(F.col("variable") == c), raw, c).select("variable", "code", "label")
             for c in _DECODED]
    return src.union_all(parts)


_DWELLING_MAP = {c: lab for v, c, lab in fx.VALUE_LABEL_ROWS if v == "h_dwltyp"}


@register("r8_relabel_levels", with_ctes(HH_RAW) + "SELECT dwelling, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE "
          + " ".join(f"WHEN h_dwltyp = {c} THEN '{lab}'" for c, lab in _DWELLING_MAP.items())
          + " END AS dwelling FROM hh_raw) t GROUP BY dwelling")
def r8_relabel_levels(spark, sf_dir):
    d = rc.relabel_levels(fx.hh_raw(spark, sf_dir), {"h_dwltyp": _DWELLING_MAP})
    return d.groupBy(F.col("h_dwltyp").alias("dwelling")).agg(F.count("*").alias("n"))


@register("r9_factor_index", with_ctes(HH_RAW) + "SELECT r.hhid, CAST(i.idx AS INT) AS prov_index FROM hh_raw r "
          "JOIN (SELECT hhprov, row_number() OVER (ORDER BY count(*) DESC, CAST(hhprov AS VARCHAR)) - 1 AS idx "
          "FROM hh_raw GROUP BY hhprov) i ON i.hhprov = r.hhprov")
def r9_factor_index(spark, sf_dir):
    d = fx.hh_raw(spark, sf_dir).select("hhid", F.col("hhprov").cast("string").alias("hhprov"))
    return rc.factor_index(d, "hhprov", out="prov_index").select("hhid", "prov_index")


@register("r10_level_position", with_ctes(HH_RAW) + "SELECT hhid, CAST(dense_rank() OVER (ORDER BY hhincome) AS BIGINT)"
          " AS income_position FROM hh_raw")
def r10_level_position(spark, sf_dir):
    d = fx.hh_raw(spark, sf_dir).select("hhid", "hhincome")
    return rc.level_position(d, "hhincome", out="income_position").select("hhid", "income_position")


_LEVELS = {"dwelling": [1, 2, 3, 4, 5], "prov": [1, 2, 3, 4, 5], "computer": [1, 2], "washer": [1, 2],
           "head_gender": [1, 2]}


def _dummy_sql(levels, drop_first=False):
    out = []
    for c, lv in levels.items():
        for v in (lv[1:] if drop_first else lv):
            out.append(f"CAST(CASE WHEN {c} = {v} THEN 1 ELSE 0 END AS INT) AS {c}_{v}")
    return ", ".join(out)


@register("r11_dummies_full", with_ctes(HH_RAW, HH) + "SELECT hhid, " + r4s("log_income_pc")
          + " AS log_income_pc, members, rooms, head_age, head_educ, " + _dummy_sql(_LEVELS) + " FROM hh")
def r11_dummies_full(spark, sf_dir):
    return r4(rc.dummies_full(fx.hh(spark, sf_dir), fx.HH_NOMINAL))


@register("r12_dummies_omit_constants", with_ctes(HH_RAW) + "SELECT hhid, "
          "CAST(CASE WHEN head_gender = 1 THEN 1 ELSE 0 END AS INT) AS head_gender_1, "
          "CAST(CASE WHEN head_gender = 2 THEN 1 ELSE 0 END AS INT) AS head_gender_2 FROM hh_raw")
def r12_dummies_omit_constants(spark, sf_dir):
    d = fx.hh_raw(spark, sf_dir).select("hhid", "head_gender", "const_flag")
    return rc.dummies_full(d, ["head_gender", "const_flag"], sep="_", omit_constants=True)


@register("r13_design_matrix", with_ctes(HH_RAW, HH) + "SELECT hhid, " + r4s("log_income_pc")
          + " AS log_income_pc, members, rooms, head_age, head_educ, " + _dummy_sql(_LEVELS, True) + " FROM hh")
def r13_design_matrix(spark, sf_dir):
    return r4(rc.design_matrix(fx.hh(spark, sf_dir), fx.HH_NOMINAL))
