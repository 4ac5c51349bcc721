"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import json

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.session import cut_lineage, scratch_path


MASK64 = (1 << 64) - 1


BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound on an Arrow batch to ``BATCH_BYTES``, unless it is lower already.

    Rows are whole texts and sets: at Spark's 64 MB, the batches in and out of two tasks take half a GB of an executor.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(now[-1:], 0)
    if int(now.rstrip("kmg")) << unit > BATCH_BYTES or int(now.rstrip("kmg")) <= 0:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8 bytes (null: none).

    ``bytes.split`` cuts at exactly the six ASCII white-space characters.
    """
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """As :func:`words_of`, with A-Z lower-cased (``bytes.lower`` touches ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash per word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, by position; the whole sequence if shorter."""
    if not len(h):
        return h
    n = min(n, len(h))
    m = len(h) - n + 1
    acc = mix(h[:m] + np.uint64(n))
    for i in range(1, n):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i:i + m])
    return acc


def text_key(text: str | None) -> bytes:
    """128-bit digest of a text (null counts as empty)."""
    return xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass"))


def local_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small driver-side table as a JVM relation (no Python on the executors)."""
    t = T.ArrayType(T._parse_datatype_string(schema))
    names = t.elementType.fieldNames()
    body = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(body), t)))


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Connected components of the edge list ``(a, b)``: rows ``(node, comp)``.

    ``comp`` is the smallest node of the component.  Every round each node takes
    the smallest label among itself and its neighbours, then the label of that
    label (pointer jump), until nothing changes; stars settle in two rounds.
    Only aggregates with map-side combine and joins; every round is written.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stash(both.where("a <> b").distinct())
    lab = stash(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                      .select("node", F.least("node", "m").alias("comp")))
    for _ in range(max_rounds):
        near = (both.join(lab.select(F.col("node").alias("b"), "comp"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m")))
        step = lab.join(near, "node").select("node", F.least("comp", "m").alias("l"), F.col("comp").alias("old"))
        jump = lab.select(F.col("node").alias("l"), F.col("comp").alias("j"))
        new = stash(step.join(jump, "l", "left").select(
            "node", F.coalesce(F.least("l", "j"), "l").alias("comp"), "old"))
        changed = new.where("comp <> old").limit(1).count()
        lab = new.select("node", "comp")
        if not changed:
            return lab
    raise RuntimeError("components did not settle")


def flat_lists(col) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of an Arrow list column."""
    if hasattr(col, "combine_chunks"):
        col = col.combine_chunks()
    off = col.offsets.to_numpy()
    return col.values.to_numpy(zero_copy_only=False), off


def give_back() -> None:
    """Hand the freed memory of a Python worker back to the system: workers outlive their tasks, idle ones too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def parts(batches, rows: int = 256):
    """Arrow batches in slices of few rows, so that a task never holds the results of thousands of texts.

    What earlier tasks left free in the worker is given back before the first batch, and after the last.
    """
    give_back()
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
    b = None
    give_back()


def stash(df: DataFrame) -> DataFrame:
    """``df`` written once as parquet in the shared folder and read back (compressed, lineage cut)."""
    small_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, "t")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
