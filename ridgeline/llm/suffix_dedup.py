"""Removal of repeated long strings by distributed doubling on sampled suffixes.

Removed is every byte covered by a string of ``threshold`` (400) bytes that also
starts somewhere else in the corpus, the same document included.  All texts are
judged as given.

Sampled suffixes.  A full suffix array has one row per byte and round (README: why it
does not fit).  Here only *anchors* take part: positions whose 16-byte hash is the minimum
of a window of ``WINDOW`` positions.  Whether a position is an anchor depends on the bytes
around it alone, so every 400-byte string starting at x has, wherever it occurs, the same
*first anchor at x + WINDOW - 1 or later*.  x is addressed by that anchor and its offset to it.

Rounds of doubling.  The rows are (rank, position) pairs.  Ranks are names: equal strings
have equal hashes, so Spark's shuffle and sort finds the unique ones without numbering
the rest, and they leave.  The strings grow from round to round: a node is a run of
offsets of an anchor, its *core* the bytes that all of its 400-byte strings have in common.
Nodes are all offsets of an anchor, then runs of ``WIDTH`` offsets, then single offsets; the
distance of core to threshold shrinks tenfold and more each round, and the last cores are the 400-byte strings.

A node whose *hull* (all of its 400-byte strings together) is repeated is past the threshold:
all its offsets are starts of repeated strings.  One node per hull goes on, as partner only, while
some node with the same core is still open.  So every node that is open meets
all strings that could equal its own.

Each round counts names by aggregates with map-side combine and joins the counts
back (one row per name against many: a skewed join that Spark can split), so a group of
copies never meets in one task.  Only texts with open nodes are read again.
Names are 64-bit hashes within the groups of 64-bit hashes of their cores; texts are told
apart by 64-bit hashes.

Null and empty texts have 0 bytes; nothing is removed from texts under 400 bytes.
Repeated rows (same id or null ids included) are separate occurrences: both lose the repeated
bytes.  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, stash, table

THRESHOLD = 400
WINDOW, GRAM = 128, 16  # 3 * WINDOW + GRAM - 2 <= THRESHOLD: the first anchor is decided inside the string
WIDTH = 10
BROADCAST_TEXTS = 1_000_000  # text hashes sent to every executor at most, 16 MB
WHOLE = 1 << 10  # offsets of an anchor are below WINDOW


def anchors(raw: bytes) -> np.ndarray:
    """Positions whose gram hash is the minimum of some window of ``WINDOW`` gram starts."""
    if len(raw) < WINDOW + GRAM - 1:
        return np.zeros(0, np.int64)
    h = np.frombuffer(raw, np.uint8).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    step = 1
    while step < GRAM:
        h = h[:-step] * np.uint64(0xD6E8FEB86659FD93 + 2 * step) + h[step:]
        step *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)

    def slide(v, op):
        size, out = 1, v
        while 2 * size <= WINDOW:
            out = op(out[:-size], out[size:])
            size *= 2
        rest = WINDOW - size
        return op(out[:-rest], out[rest:]) if rest else out

    low = slide(h, np.minimum)
    pad = np.zeros(WINDOW - 1, np.uint64)
    return np.flatnonzero(slide(np.concatenate([pad, low, pad]), np.maximum) == h)


def spans(n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, lowest offset, highest offset)`` of anchors that own a 400-byte string; x = anchor - (WINDOW - 1) - offset."""
    if n < THRESHOLD or not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z
    top = np.minimum(np.diff(at, prepend=-(1 << 40)) - 1, at - (WINDOW - 1))
    low = np.maximum(0, at - (WINDOW - 1) - (n - THRESHOLD))
    keep = low <= top
    return at[keep], low[keep], top[keep]


def _pack(p: int, a: int, b: int) -> int:
    return (p * WHOLE + a) * WHOLE + b


def _unpack(v: int) -> tuple[int, int, int]:
    return v // (WHOLE * WHOLE), v // WHOLE % WHOLE, v % WHOLE


def _names(raw: bytes, node: int, width: int) -> tuple[int, int]:
    """``(core, hull)`` of a node; the core's grid run is the one that holds the node's offsets."""
    p, a, b = _unpack(node)
    lo = a // width * width
    base = p - (WINDOW - 1)
    core = xxhash.xxh3_64_intdigest(raw[base - lo:base - lo - width + 1 + THRESHOLD], lo)
    if width == 1:
        return core, core
    return core, xxhash.xxh3_64_intdigest(raw[base - b:base - a + THRESHOLD], 1 + a * WHOLE + b)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


_ROWS = "core bigint, hull bigint, tid bigint, node bigint, w int"


def _first_rows(texts: DataFrame) -> DataFrame:
    """Names of all anchors' nodes; texts ``tid, text``."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for tid, t in zip(b.column(0).to_pylist(), b.column(1)):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                if len(raw) < THRESHOLD:
                    continue
                nodes = [_pack(*v) for v in zip(*map(np.ndarray.tolist, spans(len(raw), anchors(raw))))]
                names = [_names(raw, v, WINDOW) for v in nodes]
                k = len(nodes)
                if k:
                    yield pa.RecordBatch.from_arrays(
                        [_signed([x[0] for x in names]), _signed([x[1] for x in names]), pa.array(np.full(k, tid, np.int64)),
                         pa.array(nodes, pa.int64()), pa.array(np.ones(k, np.int32))], names=["core", "hull", "tid", "node", "w"])

    return texts.mapInArrow(run, _ROWS)


def _next_rows(texts: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Names of the nodes' runs of ``width`` offsets; nodes ``tid, node, w``."""
    lists = nodes.groupBy("tid").agg(F.collect_list(F.struct("node", "w")).alias("nodes"))
    given = _some(texts, lists).groupBy("tid").agg(F.first("text").alias("text")).join(lists, "tid")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for tid, t, vs in zip(b.column("tid").to_pylist(), b.column("text"), b.column("nodes")):
                raw, nodes, ws = t.as_py().encode("utf-8", "surrogatepass"), [], []
                for v in vs.as_py():
                    p, lo, hi = _unpack(v["node"])
                    for k in range(lo // width * width, hi + 1, width):
                        nodes.append(_pack(p, max(lo, k), min(hi, k + width - 1)))
                        ws.append(v["w"])
                names = [_names(raw, v, width) for v in nodes]
                yield pa.RecordBatch.from_arrays(
                    [_signed([x[0] for x in names]), _signed([x[1] for x in names]), pa.array(np.full(len(nodes), tid, np.int64)),
                     pa.array(nodes, pa.int64()), pa.array(ws, pa.int32())], names=["core", "hull", "tid", "node", "w"])

    return given.mapInArrow(run, _ROWS)


def _some(texts: DataFrame, keyed: DataFrame) -> DataFrame:
    """The texts whose ``tid`` is in ``keyed``."""
    tids = cut_lineage(keyed.select("tid").distinct())
    return texts.join(F.broadcast(tids) if tids.count() <= BROADCAST_TEXTS else tids, "tid", "left_semi")


def _round(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(starts, nodes)``: nodes proven to be repeated, and those that go on with their weight (partners: 2)."""
    shared = stash(rows.groupBy("core").agg(F.sum("w").alias("n")).where("n > 1").select("core"))
    alive = stash(rows.join(shared, "core", "left_semi"))
    hulls = stash(alive.groupBy("core", "hull").agg(F.sum("w").alias("n"), F.min(F.struct("tid", "node")).alias("one")))
    sure = hulls.where("n > 1").select("core", "hull")
    starts = alive.where("w = 1").join(sure, ["core", "hull"], "left_semi").select("tid", "node").distinct()
    still = hulls.where("n = 1").select("core").distinct()
    nodes = hulls.join(still, "core", "left_semi").select("one.tid", "one.node", F.least(F.col("n"), F.lit(2)).cast("int").alias("w"))
    return stash(starts), stash(nodes)


def repeated_starts(texts: DataFrame) -> DataFrame:
    """``tid, node`` of all offsets of anchors where a repeated string starts; texts ``tid, text``."""
    found, nodes = _round(_first_rows(texts))
    more, nodes = _round(_next_rows(texts, nodes, WIDTH))
    rows = stash(_next_rows(texts, nodes, 1).select("core", "tid", "node", "w"))
    shared = rows.groupBy("core").agg(F.sum("w").alias("n")).where("n > 1").select("core")
    last = rows.where("w = 1").join(shared, "core", "left_semi").select("tid", "node").distinct()
    return found.union(more).union(last)


def cut(raw: bytes, nodes: list[int]) -> tuple[bytes, int, int]:
    """``(kept bytes, removed bytes, removed runs)`` of a text and its nodes."""
    edge = np.zeros(len(raw) + 1, np.int64)
    for v in nodes:
        p, a, b = _unpack(v)
        edge[p - (WINDOW - 1) - b] += 1
        edge[p - (WINDOW - 1) - a + THRESHOLD] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return kept, int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``id, n_bytes, n_removed, n_spans, kept_sha256``."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = docs.select(F.xxhash64(body).alias("tid"), body.alias("text"))
    lists = stash(repeated_starts(texts).groupBy("tid").agg(F.collect_list("node").alias("nodes")))
    given = _some(texts, lists).groupBy("tid").agg(F.first("text").alias("text")).join(lists, "tid")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            got = [cut(t.as_py().encode("utf-8", "surrogatepass"), v.as_py()) for t, v in zip(b.column("text"), b.column("nodes"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("tid"), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()),
                 pa.array([hashlib.sha256(g[0]).hexdigest() for g in got], pa.string())], names=["tid", "n_removed", "n_spans", "sha"])

    cuts = stash(given.mapInArrow(run, "tid bigint, n_removed bigint, n_spans bigint, sha string"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.octet_length(body).cast("bigint").alias("n_bytes"),
                       F.xxhash64(body).alias("tid"), F.sha2(body, 256).alias("whole"))
    return (rows.join(cuts, "tid", "left")
            .select(F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
                    F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256")))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 400-byte strings removed from every document: counts and digest of what is left."""
    return remove_repeats(table(spark, sf_dir, "documents"))
