"""Query registry: each entry is a Spark plan plus (optionally) its SQL oracle.

A query takes ``(spark, sf_dir)`` and returns a DataFrame.  Oracle strings
run in DuckDB over the same parquet tables; computed doubles are rounded to
4 decimals on both sides (``r4`` / ``r4s``) so the value hashes compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r4(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double column (and turn -0.0 into 0.0) for hashing."""
    out = {}
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            out[f.name] = F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)
    return df.withColumns(out) if out else df


def r4s(expr: str, digits: int = 4) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"
