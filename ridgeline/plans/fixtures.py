"""Survey-shaped frames derived from the driver's tables.

``hh_raw`` has the shape of a coded household wave (key ``hhid``),
``value_labels`` its code dictionary, ``hh`` the cleaned modelling frame,
``earn`` an earnings panel and ``vec`` a numeric design.  These builders only
reshape the given tables into those schemas; every modelling step runs on
them through the library's operators.  The SQL twins in ``oracle_sql`` build
the same frames for the DuckDB check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import SENTINEL_CODES
from ..operators import filters, projections
from ..sources.survey import read_table

HH_KEY = "hhid"
HH_Y = "log_income_pc"
HH_NUMERIC = ["members", "rooms", "head_age", "head_educ"]
HH_NOMINAL = ["dwelling", "prov", "computer", "washer", "head_gender"]
HH_RENAME = {"members": "hhsizer", "rooms": "h_dwlrms", "dwelling": "h_dwltyp", "prov": "hhprov",
             "computer": "h_owncom", "washer": "h_ownwsh"}


def hh_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    li = read_table(spark, sf_dir, "lineitem")
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    lines = li.groupBy("l_orderkey").agg(
        F.count("*").alias("n_lines"), F.countDistinct("l_linenumber").alias("n_numbers"),
        F.max("l_quantity").alias("max_qty"))
    k = F.col("o_orderkey")
    d = (o.join(lines, o.o_orderkey == lines.l_orderkey)
         .join(c, c.c_custkey == o.o_custkey)
         .join(n, n.n_nationkey == c.c_nationkey))
    return d.select(
        k.alias("hhid"),
        (F.col("o_totalprice") * (F.lit(1.0) + F.lit(0.04) * ((k * 7 + F.col("o_custkey")) % 29))
         * F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(1.5)).otherwise(F.lit(1.0))
         * (F.lit(1.0) + F.lit(0.2) * F.col("n_regionkey"))).alias("hhincome"),
        F.col("n_lines").cast("int").alias("hhsizer"),
        F.when(k % 89 == 0, -3).otherwise(F.col("n_numbers")).cast("int").alias("h_dwlrms"),
        F.when(k % 97 == 0, -8).otherwise(F.lit(17) + F.col("max_qty")).cast("int").alias("head_age"),
        ((k * 7 + F.col("o_custkey")) % 29 - 3).cast("int").alias("head_educ"),
        F.when(k % 101 == 0, -5).otherwise(F.substring("o_orderpriority", 1, 1).cast("int"))
        .cast("int").alias("h_dwltyp"),
        (F.col("n_regionkey") + 1).cast("int").alias("hhprov"),
        F.when(k % 53 == 0, -8).when(F.col("o_orderstatus") == "F", 1).otherwise(2).cast("int").alias("h_owncom"),
        F.when(k % 59 == 0, -8).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(2)
        .cast("int").alias("h_ownwsh"),
        F.when(F.col("c_acctbal") < 0, 2).otherwise(1).cast("int").alias("head_gender"),
        F.concat(F.col("n_name"), F.lit(" District Municipality")).alias("district_label"),
        F.lit(1).cast("int").alias("const_flag"),
    )


# Code dictionary for the coded columns of ``hh_raw`` (fixture values).
VALUE_LABEL_ROWS = [
    ("h_dwltyp", -5, "Not Applicable"), ("h_dwltyp", 1, "house"), ("h_dwltyp", 2, "hut"),
    ("h_dwltyp", 3, "flat"), ("h_dwltyp", 4, "na"), ("h_dwltyp", 5, "na"),
    ("hhprov", 1, "Western.Cape"), ("hhprov", 2, "Eastern.Cape"), ("hhprov", 3, "Northern.Cape"),
    ("hhprov", 4, "Free.State"), ("hhprov", 5, "KwaZulu.Natal"),
    ("h_owncom", -8, "Refused"), ("h_owncom", 1, "yes"), ("h_owncom", 2, "no"),
    ("h_ownwsh", -8, "Missing"), ("h_ownwsh", 1, "yes"), ("h_ownwsh", 2, "no"),
    ("h_ownwsh", 9, "Don't Know"),
]


def value_labels(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """The dictionary; with ``sf_dir`` the district codes come from ``nation``."""
    fixed = spark.createDataFrame(VALUE_LABEL_ROWS, "variable string, code int, label string")
    if sf_dir is None:
        return fixed
    n = read_table(spark, sf_dir, "nation")
    district = n.select(F.lit("district").alias("variable"), F.col("n_nationkey").cast("int").alias("code"),
                        F.concat(F.col("n_name"), F.lit(" District Municipality")).alias("label"))
    return fixed.unionByName(district)


def clean_hh(raw: DataFrame) -> DataFrame:
    """F5 sentinels out, F6/F8 invalid to NULL, P6 outcome, P3 names, F3 complete cases."""
    d = filters.exclude_codes(raw, {c: SENTINEL_CODES for c in ["h_dwltyp", "h_owncom", "h_ownwsh"]})
    d = filters.null_below(d, ["hhsizer", "h_dwlrms", "head_age"], 1)
    d = filters.null_codes(d, "head_educ", lambda c: c < 0)
    d = projections.log_ratio(d, "hhincome", "hhsizer", HH_Y)
    d = projections.rename_map(d, HH_RENAME)
    d = d.select(HH_KEY, HH_Y, *HH_NUMERIC, *HH_NOMINAL)
    return filters.complete_cases(d)


def hh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_hh(hh_raw(spark, sf_dir))


def earn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("pid"),
        (F.lit(16) + F.col("user_id") % 50).cast("int").alias("age"),
        ((F.col("user_id") * 3) % 16).cast("int").alias("educ"),
        F.col("event_type").alias("occupation"),
        (F.col("user_id") % 9).cast("int").alias("union_code"),
        F.dayofmonth("ts").cast("int").alias("wave"),
        F.hour("ts").cast("double").alias("hours"),
        F.when(F.col("event_id") % 11 == 0, 0).otherwise(F.col("user_id") % 20).cast("double").alias("tenure"),
        F.col("value").alias("wages"),
    )


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings")
