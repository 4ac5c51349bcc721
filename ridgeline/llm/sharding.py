"""Range sharding by sampled splitters (DataFrame functions only).

Law: ``bytes`` - all shards get nearly the same number of bytes.

Records are ordered by a 64-bit hash of their text.  A size-weighted sample of
keys (a row is drawn with probability proportional to its load - its size plus the mean size,
which bounds a range in rows, too - by a hash, so every run draws the same rows) gives quantile boundaries for many more ranges
than shards.  The ranges' true sizes are measured in one aggregate; overfull
ranges are sampled again inside and subdivided.  Runs of neighbouring ranges
then fill the shards.

Equal texts share a key, so a group of copies stays in one range.  A group larger
than a range would hold is a unit of its own (heavy key): it is cut by a hash of
the row into pieces of a quarter of a range, and its pieces go to one shard unless it
is larger than what a shard has room for; only then it spans shards.

The driver sees the sample, the ranges and the heavy keys only: their number is
fixed by ``shards`` and by one range per ``ROWS_PER_RANGE`` rows.  ``slot`` is the
row's place in its shard, from the measured row counts of the units before its
own plus its place within the unit; no task ever orders a whole shard.

Nulls: a null text counts as empty (size 1); a null id is a value like another.
Repeated rows are separate records.  An empty table gives an empty result.
Extra columns are dropped.
Very long texts are values like others: they are read whole.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, local_table, table

SHARDS = 16
RANGES_PER_SHARD = 128
ROWS_PER_RANGE = 1 << 20
SAMPLE_PER_RANGE = 24
PIECES_PER_RANGE = 4  # small pieces, as many equal rows of little size would otherwise make the fullest units
CELL_BITS = 10


def _uniform(*cols) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(97), *cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _cell(key) -> F.Column:
    return F.shiftright(key, 64 - CELL_BITS).cast("int")


def _with_range(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """``rows`` with ``rng`` = number of bounds <= key, looked up by the key's top bits."""
    spark, half = rows.sparkSession, 1 << (CELL_BITS - 1)
    cells = []
    for c in range(-half, half):
        lo, hi = c << (64 - CELL_BITS), (c + 1) << (64 - CELL_BITS)
        i, j = bisect.bisect_left(bounds, lo), bisect.bisect_left(bounds, hi)
        cells.append((c, i, bounds[i:j]))
    lookup = local_table(spark, cells, "cell int, base int, inner array<bigint>")
    return (rows.withColumn("cell", _cell(F.col("key"))).join(F.broadcast(lookup), "cell")
            .withColumn("rng", F.col("base") + F.size(F.filter("inner", lambda b: b <= F.col("key"))))
            .drop("cell", "base", "inner"))


def _quantiles(sample: list[tuple[int, float]], n: int) -> list[int]:
    """Up to n-1 distinct keys that cut the weighted sample into n nearly equal parts."""
    sample = sorted(sample)
    total, acc, out, k = sum(w for _, w in sample), 0.0, [], 1
    for key, w in sample:
        while k < n and acc + w >= total * k / n:
            if not out or key > out[-1]:
                out.append(key)
            k += 1
        acc += w
    return out


def units_of(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every record (``id, size, crc, key, rid``) with its unit ``(ukey, piece)``: a range (piece -1) or a piece of a heavy key."""
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    base = cut_lineage(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(t) + 1).cast("bigint").alias("size"),
        F.crc32(t).alias("crc"), F.xxhash64(t).alias("key"), F.xxhash64(F.col(id_col), t).alias("rid")))
    total, rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    n_ranges = max(shards * RANGES_PER_SHARD, -(-rows // ROWS_PER_RANGE))
    # a row's load is its size plus the mean size, so that a unit is bounded in bytes and in rows
    mean = max(1, round(total / max(1, rows)))
    load, whole = F.col("size") + F.lit(mean), total + rows * mean
    target = max(1, whole // n_ranges)
    # heavy keys: at most n_ranges of them can reach the target size
    heavy = (base.groupBy("key").agg(F.sum(load).alias("s")).where(F.col("s") >= target)
             .select("key", F.ceil(PIECES_PER_RANGE * F.col("s") / F.lit(target)).cast("int").alias("pieces")))
    heavy = local_table(spark, [tuple(r) for r in heavy.collect()], "key bigint, pieces int")
    tagged = base.join(F.broadcast(heavy), "key", "left")
    light = tagged.where(F.col("pieces").isNull())
    # size-weighted draws: a row above the sampling step is always drawn and keeps its own weight
    step = max(1.0, whole / float(n_ranges * SAMPLE_PER_RANGE))

    def draw(df, every):
        return (df.where(_uniform("rid", "key") < load / F.lit(float(every)))
                .select("key", F.greatest(load.cast("double"), F.lit(float(every))).alias("w")))

    bounds = _quantiles([tuple(r) for r in draw(light, step).collect()], n_ranges)
    while True:  # until no range is overfull, or those that are hold one key each
        sizes = {r[0]: r[1] for r in _with_range(light, bounds).groupBy("rng").agg(F.sum(load)).collect()}
        over = {r: s for r, s in sizes.items() if s > 2 * target}
        if not over:
            break
        inside = _with_range(light, bounds).join(
            F.broadcast(local_table(spark, [(r, float(s)) for r, s in over.items()], "rng int, over double")), "rng")
        again = (inside.where(_uniform("rid", "key", F.lit(1)) < load * (8 * SAMPLE_PER_RANGE) / F.col("over"))
                 .select("rng", "key", F.greatest(load.cast("double"), F.col("over") / (8 * SAMPLE_PER_RANGE))).collect())
        more = {b for r, s in over.items() for b in _quantiles([(k, w) for q, k, w in again if q == r], math.ceil(s / target))}
        if more <= set(bounds):
            break
        bounds = sorted(set(bounds) | more)
    # units: ranges 0.., and pieces of heavy keys as (key, piece)
    piece = F.pmod(F.xxhash64("rid", F.lit(3)), F.col("pieces")).cast("int")
    light_units = _with_range(light, bounds).withColumn("piece", F.lit(-1)).withColumn("ukey", F.col("rng").cast("bigint"))
    heavy_units = (tagged.where(F.col("pieces").isNotNull()).withColumn("piece", piece)
                   .withColumn("ukey", F.col("key")))
    cols = ["id", "size", "crc", "key", "rid", "ukey", "piece"]
    return light_units.select(cols).unionByName(heavy_units.select(cols))


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per record: ``id, size, text_crc32, law, shard, slot, grown_shard``."""
    spark, units = docs.sparkSession, units_of(docs, shards, id_col, text)
    measured = units.groupBy("ukey", "piece").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    plan = local_table(spark, _fill([tuple(r) for r in measured], shards), "ukey bigint, piece int, shard int, first bigint")
    place = F.row_number().over(Window.partitionBy("ukey", "piece").orderBy("key", "rid", "id"))
    return (units.join(F.broadcast(plan), ["ukey", "piece"])
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                    "shard", (F.col("first") + place - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))


def _fill(measured: list[tuple[int, int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Shard and first slot of every unit ``(ukey, piece, bytes, rows)``.

    Heavy keys go first, largest first, whole into the emptiest shard while they
    fit a shard's fair share, else piece by piece.  Then the ranges, in key order,
    fill the shards up to the fair share.
    """
    fair = sum(m[2] for m in measured) / shards if measured else 0.0
    load, rows, out = [0] * shards, [0] * shards, []

    def put(m, s):
        out.append((m[0], m[1], s, rows[s]))
        load[s] += m[2]
        rows[s] += m[3]

    groups: dict[int, list] = {}
    for m in measured:
        if m[1] >= 0:
            groups.setdefault(m[0], []).append(m)
    for _, parts in sorted(groups.items(), key=lambda g: (-sum(m[2] for m in g[1]), g[0])):
        s = min(range(shards), key=lambda i: (load[i], i))
        if load[s] + sum(m[2] for m in parts) <= fair * (1 + 1 / RANGES_PER_SHARD):
            for m in sorted(parts):
                put(m, s)
        else:
            for m in sorted(parts):
                put(m, min(range(shards), key=lambda i: (load[i], i)))
    s = 0
    left = sum(m[2] for m in measured if m[1] < 0)
    room = [max(0.0, fair - x) for x in load]
    scale = left / sum(room) if sum(room) else 1.0
    edge = [scale * sum(room[:i + 1]) for i in range(shards)]
    filled = 0.0
    for m in sorted(m for m in measured if m[1] < 0):
        # the shard where the middle of the range falls: errors do not add up
        while s < shards - 1 and filled + m[2] / 2 > edge[s]:
            s += 1
        put(m, s)
        filled += m[2]
    return out


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards of nearly equal bytes by sampled splitters."""
    return assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
