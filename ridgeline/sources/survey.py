"""Sources and sinks for coded survey tables.

All readers are lazy scans; filters and column lists are handed to Catalyst,
which pushes them into the parquet reader (``PushedFilters`` / ``ReadSchema``).
Writers write with ``overwrite`` and hand back a fresh scan of what was
written, so downstream work reads the persisted table and not the lineage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_survey(spark: SparkSession, path: str, schema: StructType | str | None = None,
                fmt: str = "parquet", where: Column | str | None = None,
                columns: list[str] | None = None) -> DataFrame:
    """Scan a coded table with a declared schema, optional filter and column list."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.load(path)
    if where is not None:
        df = df.filter(where)
    if columns is not None:
        df = df.select(*columns)
    return df


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """S3: reload a cleaned table."""
    return spark.read.parquet(path)


def write_snapshot(df: DataFrame, path: str) -> DataFrame:
    """Persist a table as parquet and return a scan of the written copy."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_subset(df: DataFrame, path: str, first: int | None = None,
                 cols: list[str] | None = None) -> DataFrame:
    """Persist only the first ``first`` columns (or a named list)."""
    keep = cols if cols is not None else df.columns[:first]
    return write_snapshot(df.select(*keep), path)


def write_best_params(df: DataFrame, path: str) -> DataFrame:
    """A one-row result table as a single CSV file with a header.

    ``coalesce(1)`` is only safe because the input is a result row; the row
    count is checked so a data-sized frame can never be funnelled into one task.
    """
    n = df.limit(2).count()
    if n > 1:
        raise ValueError("write_best_params expects a one-row result table")
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return (df.sparkSession.read.option("header", True)
            .schema(df.schema).csv(path))


def write_value_labels(labels: DataFrame, path: str) -> None:
    labels.select("variable", "code", "label").write.mode("overwrite") \
        .option("header", True).csv(path)


def read_value_labels(spark: SparkSession, path: str) -> DataFrame:
    """Code-to-label dictionary with each code's position in its variable."""
    df = (spark.read.option("header", True)
          .schema("variable STRING, code INT, label STRING").csv(path))
    w = Window.partitionBy("variable").orderBy("code")
    return df.withColumn("position", F.row_number().over(w).cast("int"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
