"""Projections (P1-P10): column selection, renaming, casts and derived columns.

All of these are plan-time rewrites of the projection list: names and
positions are resolved against ``df.schema`` when the plan is built, so the
scan only reads the columns that survive (column pruning) and every
expression stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def select_first(df: DataFrame, first: list[str]) -> DataFrame:
    """Move ``first`` to the front, keep the rest in order."""
    rest = [c for c in df.columns if c not in first]
    return df.select(*first, *rest)


def name_range(df: DataFrame, first: str, last: str) -> list[str]:
    cols = df.columns
    a, b = cols.index(first), cols.index(last)
    return cols[a:b + 1]


def drop_cols(df: DataFrame, names: list[str] = (), ranges: list[tuple[str, str]] = ()) -> DataFrame:
    """Drop by name and by inclusive ``first:last`` name ranges."""
    resolved = list(names)
    for a, b in ranges:
        resolved += name_range(df, a, b)
    return df.drop(*resolved)


def rename_map(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """``{new: old}`` renames (the reference's dplyr order)."""
    return df.withColumnsRenamed({old: new for new, old in mapping.items()})


def cast_range(df: DataFrame, first: int, last: int | None, dtype: DataType | str) -> DataFrame:
    """Cast the columns at positions ``first..last`` (0-based, inclusive)."""
    cols = df.columns[first:(None if last is None else last + 1)]
    return df.withColumns({c: F.col(c).cast(dtype) for c in cols})


def map_by_type(df: DataFrame, type_name: str, fn: Callable[[Column], Column]) -> DataFrame:
    """P5: apply ``fn`` to every column whose type is ``type_name``."""
    hit = [f.name for f in df.schema.fields if f.dataType.typeName() == type_name]
    return df.withColumns({c: fn(F.col(c)) for c in hit})


def log_ratio(df: DataFrame, num: str, den: str, out: str) -> DataFrame:
    """``ln(num / den)``; a non-positive ratio gives NULL (dropped later)."""
    return df.withColumn(out, F.log(F.col(num).cast("double") / F.col(den)))


def log_cols(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """``{out: col}`` natural logs of positive columns."""
    return df.withColumns({out: F.log(F.col(c).cast("double")) for out, c in mapping.items()})


def offset(df: DataFrame, col: str, k: int) -> DataFrame:
    """Shift a coded column (e.g. 1/2 to 0/1)."""
    return df.withColumn(col, F.col(col) - F.lit(k))


def slice_cols(df: DataFrame, slices: list[tuple[int, int]]) -> DataFrame:
    """Positional column slices ``[(a, b), ...]`` (0-based, inclusive) glued together."""
    cols = df.columns
    keep = []
    for a, b in slices:
        keep += cols[a:b + 1]
    return df.select(*keep)


def feature_columns(df: DataFrame, y: str, exclude: list[str] = ()) -> list[str]:
    """'Outcome against everything else': every other column, in order."""
    return [c for c in df.columns if c != y and c not in exclude]


def assemble(df: DataFrame, y: str, exclude: list[str] = (), out: str = "features") -> DataFrame:
    """P10: vector column of all non-outcome columns (MLlib input); a NULL is NaN in it, so that no row is lost."""
    cols = feature_columns(df, y, exclude)
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)
