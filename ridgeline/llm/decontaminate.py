"""Benchmark decontamination by spaced seeds (DataFrame functions only).

Tokens are the letter/digit runs of the lower-cased text.  A spaced seed is a
fixed mask laid over consecutive tokens; only the positions marked ``1`` are
hashed, so a substitution at a ``0`` does not break the hit.  Hashes of all test
and training positions are joined; each hit fixes a diagonal (document position
minus item position), and the tokens along that diagonal are compared one by one.

A document is contaminated by an item when some window of ``W = min(13, item
tokens)`` tokens on one diagonal has at least 80 % equal tokens.  The three masks
were chosen so that *every* such window of 8 to 13 tokens contains at least one
hit, so nothing is lost by seeding.  Items of fewer than ``min_tokens`` (8) tokens
are too short to prove a leak and never match.

Everything depends on the text alone, so rows are keyed by a 128-bit hash of the
text: repeated rows, null ids and copies each get their own row back, with equal
verdicts.  Null and empty texts have no tokens and are clean; an empty benchmark
contaminates nothing; extra columns are ignored here and kept by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, table

MASKS = ("11111", "110111", "11001011")
WINDOW = 13
MIN_TOKENS = 8
SIMILARITY_PERCENT = 80
BROADCAST_SEEDS = 1_000_000  # seeds of the benchmark sent to every executor at most (about 32 MB)
BROADCAST_TEXTS = 1_000_000  # keys of texts with a hit sent to every executor at most (about 32 MB)


def _tokens(text) -> F.Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _keys(text) -> list:
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("_k1"), F.xxhash64(F.lit(7), t).alias("_k2")]


def _seeds(h, masks=MASKS) -> F.Column:
    """All ``(pos, seed)`` of an array of token hashes; the mask number is part of the hash."""
    def at(k, ones):
        return lambda p: F.struct(p.alias("pos"), F.xxhash64(F.lit(k), *[F.get(h, p + i) for i in ones]).alias("seed"))

    parts = []
    for k, m in enumerate(masks):
        last = F.size(h) - len(m)
        spots = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), at(k, [i for i, c in enumerate(m) if c == "1"]))
        parts.append(F.when(last >= 0, spots).otherwise(F.array().cast("array<struct<pos:int,seed:bigint>>")))
    return F.concat(*parts)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text",
                  item_id: str = "item_id", window: int = WINDOW, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Verified overlaps ``(_k1, _k2, item_id, item_row, start, matched, best, needed)`` by text key.

    ``start``: document token that lies under the item's first token (may be
    negative); ``matched``: equal tokens along the whole diagonal; ``best``: equal
    tokens in the best window, ``needed`` of which make a leak.
    """
    spark = docs.sparkSession
    items = (benchmark.select(F.col(item_id).alias("item_id"), _tokens(F.col(item_text)).alias("it"))
             .where(F.size("it") >= min_tokens)
             .withColumn("item_row", F.xxhash64("item_id", "it")).dropDuplicates(["item_row"]))
    items = cut_lineage(items)
    seeds = (items.withColumn("h", F.transform("it", lambda w: F.xxhash64(w)))
             .select("item_row", F.inline(_seeds(F.col("h"))))
             .select("item_row", F.col("pos").alias("ipos"), "seed"))
    n_seeds = seeds.count()
    words = docs.select(*_keys(F.col(text)), _tokens(F.col(text)).alias("dt"))
    spots = (words.withColumn("h", F.transform("dt", lambda w: F.xxhash64(w)))
             .select("_k1", "_k2", F.inline(_seeds(F.col("h")))))
    small = n_seeds <= BROADCAST_SEEDS
    hits = (spots.join(F.broadcast(seeds) if small else seeds, "seed")
            .select("_k1", "_k2", "item_row", (F.col("pos") - F.col("ipos")).alias("start")).distinct())
    hits = cut_lineage(hits)
    hit_texts = cut_lineage(hits.select("_k1", "_k2").distinct())
    if hit_texts.count() <= BROADCAST_TEXTS:
        hit_texts = F.broadcast(hit_texts)
    body = words.join(hit_texts, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
    pairs = hits.join(F.broadcast(items) if small else items, "item_row").join(body, ["_k1", "_k2"])
    eq = F.transform("it", lambda w, j: F.coalesce((F.get("dt", j + F.col("start")) == w).cast("int"), F.lit(0)))
    w = F.least(F.lit(window), F.size("it"))
    sums = F.transform(F.sequence(F.lit(0), F.size("m") - F.col("w")),
                       lambda s: F.aggregate(F.slice("m", s + 1, F.col("w")), F.lit(0), lambda a, x: a + x))
    return (pairs.withColumn("m", eq).withColumn("w", w)
            .withColumn("best", F.array_max(sums))
            .withColumn("needed", F.ceil(F.col("w") * SIMILARITY_PERCENT / F.lit(100)).cast("int"))
            .withColumn("matched", F.aggregate("m", F.lit(0), lambda a, x: a + x))
            .where(F.col("best") >= F.col("needed"))
            .select("_k1", "_k2", "item_id", "item_row", "start", "matched", F.size("it").alias("item_tokens"), "best", "needed"))


def flag(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``contaminated``, ``n_items``, ``item_ids`` (sorted) and ``n_spans`` added, row for row."""
    found = (find_overlaps(docs, benchmark, text).groupBy("_k1", "_k2")
             .agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"),
                  F.count_distinct("item_row").alias("n_items"), F.count(F.lit(1)).alias("n_spans"),
                  F.max("matched").alias("best_matched")))
    keyed = docs.select("*", *_keys(F.col(text)))
    return (keyed.join(found, ["_k1", "_k2"], "left")
            .withColumn("contaminated", F.col("n_items").isNotNull())
            .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_items", "n_spans", "best_matched")})
            .withColumn("item_ids", F.coalesce("item_ids", F.array().cast(dict(found.dtypes)["item_ids"])))
            .drop("_k1", "_k2"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows, columns unchanged."""
    found = cut_lineage(find_overlaps(docs, benchmark, text).select("_k1", "_k2").distinct())
    if found.count() <= BROADCAST_TEXTS:
        found = F.broadcast(found)
    return (docs.select("*", *_keys(F.col(text))).join(found, ["_k1", "_k2"], "left_anti")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item: verdict, items and number of leaked spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = flag(docs, table(spark, sf_dir, "benchmark")).drop("text")
    return out.withColumn("item_ids", F.array_join(F.transform("item_ids", lambda i: i.cast("string")), ","))
