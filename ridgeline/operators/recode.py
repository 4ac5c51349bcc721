"""Recoding and categorical features.

Level dictionaries are small by nature (a survey question has tens of
answers, not millions), but the library never trusts that: every level list
is read with a hard row cap and the call fails loudly past it, so no
data-sized set is ever pulled to the driver.  Level lookups become map
literals inside the projection, which keeps them in generated code with no
join at all.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import snapshot

MAX_LEVELS = 5000


def _rule_value(c: Column, value) -> Column:
    if value is None:
        return F.lit(None).cast("int")
    if isinstance(value, tuple) and value[0] == "minus":
        return (c - F.lit(value[1])).cast("int")
    return F.lit(value).cast("int")


def _rule_test(c: Column, lo, hi) -> Column:
    if lo is None:
        return c <= F.lit(hi)
    if hi is None:
        return c >= F.lit(lo)
    if lo == hi:
        return c == F.lit(lo)
    return (c >= F.lit(lo)) & (c <= F.lit(hi))


def recode_ranges(c: Column, rules, otherwise: Column | None = None) -> Column:
    """Ordered ``(lo, hi, value)`` rules; the first match wins."""
    expr = None
    for lo, hi, value in rules:
        t, v = _rule_test(c, lo, hi), _rule_value(c, value)
        expr = F.when(t, v) if expr is None else expr.when(t, v)
    return expr.otherwise(c if otherwise is None else otherwise)


def recode_nested(c: Column, rules, null_codes=()) -> Column:
    """R2: nested if/else on raw codes, then listed/negative codes to NULL."""
    out = recode_ranges(c, rules)
    bad = out < 0
    if null_codes:
        bad = bad | out.isin(list(null_codes))
    return F.when(~bad, out)


def binary_recode(c: Column, ref) -> Column:
    """``ref`` to 0, anything else to 1, NULL stays NULL."""
    return F.when(c.isNull(), F.lit(None).cast("int")).when(c == F.lit(ref), 0).otherwise(1)


def _bounded_collect(df: DataFrame, what: str, cap: int = MAX_LEVELS) -> list:
    rows = df.limit(cap + 1).collect()
    if len(rows) > cap:
        raise ValueError(f"{what}: more than {cap} rows; not a level dictionary")
    return rows


def _map_literal(pairs) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pairs))


def decode_labels(df: DataFrame, labels: DataFrame, cols: list[str],
                  suffix: str = "") -> DataFrame:
    """Replace codes by label text, one map literal per column."""
    rows = _bounded_collect(labels.filter(F.col("variable").isin(cols))
                            .select("variable", "code", "label"), "value labels")
    out = {}
    for c in cols:
        pairs = [(r["code"], r["label"]) for r in rows if r["variable"] == c]
        out[c + suffix] = _map_literal(pairs)[F.col(c)] if pairs else F.lit(None).cast("string")
    return df.withColumns(out)


def clean_label_text(labels: DataFrame, patterns: list[str], col: str = "label") -> DataFrame:
    """Remove each literal pattern from the label text, in order."""
    c = F.col(col)
    for p in patterns:
        c = F.replace(c, F.lit(p), F.lit(""))
    return labels.withColumn(col, c)


def levels_by_first_seen(df: DataFrame, col: str, order_by: str) -> DataFrame:
    """Level order = order of first appearance by an explicit row key.

    Pre-aggregated to one row per level before ranking, so the ranking window
    sees at most ``MAX_LEVELS`` rows whatever the table size.
    """
    first = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.min(order_by).alias("_first"))
    n = first.limit(MAX_LEVELS + 1).count()
    if n > MAX_LEVELS:
        raise ValueError(f"{col}: more than {MAX_LEVELS} levels")
    w = Window.orderBy("_first", col)
    return (first.withColumn("position", F.row_number().over(w).cast("int"))
            .select(F.col(col).alias("level"), "position"))


def drop_unused_levels(levels: DataFrame, df: DataFrame, col: str,
                       level_col: str = "code") -> DataFrame:
    """Keep only dictionary levels that occur in the data."""
    used = df.select(F.col(col).alias(level_col)).distinct()
    return levels.join(used, on=level_col, how="left_semi")


def relabel_levels(df: DataFrame, mapping: dict[str, dict]) -> DataFrame:
    """``{col: {code: label}}``; codes sharing a label merge into one level."""
    return df.withColumns({c: _map_literal(m.items())[F.col(c)] for c, m in mapping.items()})


def factor_index(df: DataFrame, col: str, levels: list | None = None,
                 out: str | None = None) -> DataFrame:
    """Label to integer code (0-based).

    With ``levels`` the given order is used; without, frequency order with
    ties broken by label (the ``StringIndexer`` convention).
    """
    if levels is None:
        counts = _bounded_collect(df.groupBy(col).count().filter(F.col(col).isNotNull()),
                                  f"levels of {col}")
        levels = [r[col] for r in sorted(counts, key=lambda r: (-r["count"], r[col]))]
    pairs = [(lv, i) for i, lv in enumerate(levels)]
    return df.withColumn(out or col, _map_literal(pairs)[F.col(col)].cast("int"))


def level_position(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """1-based position of each value among the sorted distinct values.

    The distinct values are dealt by range and numbered inside their range; the
    ranges' sizes (one number each) give the offsets.  No task sees all values and
    nothing leaves the JVM.  The join back is a normal shuffle join; AQE turns it into a
    broadcast only when the distinct set is measured small at run time.
    """
    distinct = df.select(col).filter(F.col(col).isNotNull()).distinct()
    # written once: the ranges must be the same for the sizes and for the numbers
    dealt = snapshot(distinct.repartitionByRange(col).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["count"]) for r in dealt.groupBy("_part").count().collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    start = _map_literal(offsets)[F.col("_part")] if offsets else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(col))
    ranks = dealt.select(col, (start + place).cast("bigint").alias("_pos"))
    joined = df.join(ranks, on=col, how="left")
    target = out or col
    return joined.withColumn(target, F.col("_pos")).drop("_pos") \
        .select(*[c for c in df.columns] + ([target] if target not in df.columns else []))


def level_counts(df: DataFrame, cols: list[str], cap: int = MAX_LEVELS) -> dict[str, dict]:
    """Counts per (column, level) in one aggregate; capped read to the driver."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level"))
        for c in cols])).alias("s")).select("s.*")
    rows = _bounded_collect(stacked.filter(F.col("level").isNotNull())
                            .groupBy("variable", "level").count(), "level counts", cap)
    out: dict[str, dict] = {c: {} for c in cols}
    for r in rows:
        out[r["variable"]][r["level"]] = r["count"]
    return out


def _sorted_levels(df: DataFrame, col: str, levels: list[str]) -> list:
    t = df.schema[col].dataType.typeName()
    if t in ("integer", "long", "short", "byte"):
        return sorted(int(v) for v in levels)
    if t in ("double", "float"):
        return sorted(float(v) for v in levels)
    return sorted(levels)


def dummies_full(df: DataFrame, cols: list[str], sep: str = "_",
                 omit_constants: bool = False) -> DataFrame:
    """One 0/1 column per level (none dropped), replacing the factor.

    Name is ``column + sep + level``.  With ``omit_constants`` a dummy that is
    1 on every row is removed (the factor had a single level).
    """
    counts = level_counts(df, cols)
    n = df.count() if omit_constants else None
    new_by_col = {}
    for c in cols:
        items = []
        for lv in _sorted_levels(df, c, list(counts[c])):
            if omit_constants and counts[c][str(lv)] == n:
                continue
            items.append(F.when(F.col(c).isNull(), F.lit(None).cast("int"))
                         .otherwise((F.col(c) == F.lit(lv)).cast("int")).alias(f"{c}{sep}{lv}"))
        new_by_col[c] = items
    keep = []
    for c in df.columns:
        if c in new_by_col:
            keep += new_by_col[c]
        else:
            keep.append(F.col(c))
    return df.select(*keep)


def design_matrix(df: DataFrame, cols: list[str], levels: dict[str, list] | None = None,
                  sep: str = "_") -> DataFrame:
    """Treatment coding, first level is the reference and gets no column."""
    counts = level_counts(df, cols) if levels is None else None
    keep = []
    for c in df.columns:
        if c not in cols:
            keep.append(F.col(c))
            continue
        lv = levels[c] if levels is not None else _sorted_levels(df, c, list(counts[c]))
        for level in lv[1:]:
            keep.append(F.when(F.col(c).isNull(), F.lit(None).cast("int"))
                        .otherwise((F.col(c) == F.lit(level)).cast("int")).alias(f"{c}{sep}{level}"))
    return df.select(*keep)


class Standardizer:
    """centre/scale learnt on one frame (sample sd, n - 1), applied to any."""

    def __init__(self, cols: list[str], center: bool = True, scale: bool = True):
        self.cols, self.center, self.scale = cols, center, scale
        self.means: dict[str, float] = {}
        self.sds: dict[str, float] = {}

    def fit(self, df: DataFrame) -> "Standardizer":
        aggs = []
        for c in self.cols:
            aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}")]
        row = df.agg(*aggs).first()
        self.means = {c: row[f"m_{c}"] for c in self.cols}
        self.sds = {c: row[f"s_{c}"] or 0.0 for c in self.cols}
        return self

    def params(self, spark) -> DataFrame:
        return spark.createDataFrame([(c, float(self.means[c]), float(self.sds[c]))
                                      for c in self.cols], "variable string, mean double, sd double")

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c in self.cols:
            e = F.col(c).cast("double")
            if self.center:
                e = e - F.lit(self.means[c])
            if self.scale:
                # a constant column (or one row) has no spread: it is centred and not scaled
                e = e / F.lit(float(self.sds[c] or 1.0))
            out[c] = e
        return df.withColumns(out)


def standardize(train: DataFrame, cols: list[str], center: bool = True,
                scale: bool = True) -> Standardizer:
    return Standardizer(cols, center, scale).fit(train)
