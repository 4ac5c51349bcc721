"""Filters and missing-data handling (F1-F8).

Plain predicates and ``CASE`` expressions, so Catalyst can push the
row filters into the scan and keep the NULL-outs in generated code.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_eq(df: DataFrame, col: str, value) -> DataFrame:
    """keep rows where ``col == value`` (one survey wave)."""
    return df.filter(F.col(col) == F.lit(value))


def filter_valid(df: DataFrame, not_null: list[str] = (), positive: list[str] = ()) -> DataFrame:
    """not NULL and strictly positive."""
    conds = [F.col(c).isNotNull() for c in not_null] + [F.col(c) > 0 for c in positive]
    return df.filter(reduce(lambda a, b: a & b, conds)) if conds else df


def complete_cases(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """listwise deletion (all columns or the model's columns).

    Unlike the reference's ``-which()`` idiom, an empty match keeps every row.
    """
    return df.na.drop(how="any", subset=subset)


def exclude_codes(df: DataFrame, codes: dict[str, list[int]]) -> DataFrame:
    """drop a row if any listed column holds one of its codes.

    A NULL in a listed column makes the predicate NULL, so that row drops too.
    """
    hit = reduce(or_, [F.col(c).isin(list(v)) for c, v in codes.items()])
    return df.filter(~hit)


def null_below(df: DataFrame, cols: list[str], minimum) -> DataFrame:
    """values under ``minimum`` become NULL."""
    return df.withColumns({c: F.when(F.col(c) >= F.lit(minimum), F.col(c)) for c in cols})


def null_labels(df: DataFrame, labels: list[str], cols: list[str] | None = None) -> DataFrame:
    """a fixed set of uninformative labels becomes NULL in every label column."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    return df.withColumns({c: F.when(~F.col(c).isin(list(labels)), F.col(c)) for c in cols})


def null_codes(df: DataFrame, col: str, predicate: Callable[[Column], Column]) -> DataFrame:
    """F8: codes matching ``predicate`` become NULL."""
    c = F.col(col)
    return df.withColumn(col, F.when(~predicate(c), c))
