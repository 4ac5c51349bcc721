"""Merkle manifest of a dataset, its subtrees stored in van Emde Boas order.

Every record is a leaf: the hash of its fields.  The leaves of a group (``source``)
ascend by id; while several nodes remain, every ``ARITY`` consecutive ones become their
hash.  The groups' subroots, ordered by group (null first, UTF-8 bytewise), give the
root the same way.  A digest goes into the next hash as 64 hex characters.

*Manifest.*  Positions come from a range partition by (group, id): a row's place in its
partition plus the counts of the partitions before it, so that a group of any size is
spread over tasks.  Aligned runs of ``ARITY ** BLOCK_LEVELS`` positions are blocks.  A
block is one row of the manifest: its whole subtree in one binary, laid out by
:func:`address` (the subtree is split at half height, the upper part first, then the
lower subtrees one after the other, each split again).  Construction and the reading of
siblings use that arithmetic alone.  The block roots are the positions of the next
level, which is blocked again until each group has one node, and the subroots are
blocked in the same way.

*Proofs.*  From the top down every block hands its nodes the siblings above them, one
level of blocks at a time.  A proof is the siblings (the run's others) level by level.
Folding a leaf with them gives the root it stands for.

A task holds one block at a time.  The driver sees the number of levels only.

Nulls: a null field is ``-`` in the leaf; a null group is the first group, a null id
comes before all others; null text is not changed by tampering.  Empty and very long texts are values
like others (hashed whole by Spark).  Ties: rows of one id are ordered by their leaf, so
repeated rows are leaves of their own and interchangeable.  An empty table has
no root and gives an empty result.  Columns other than those hashed are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

ARITY_BITS = 4
ARITY = 1 << ARITY_BITS
BLOCK_LEVELS = 3
BLOCK_BITS = ARITY_BITS * BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: str) -> str:
    """Lowercase hex sha256 of digests in their hex form."""
    return sha256(parts.encode()).hexdigest()


def leaf_hash(*cols: F.Column) -> F.Column:
    """sha256 over each field as ``-`` or byte count, ``:``, value."""
    s = [c.cast("string") for c in cols]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in s]), 256)


# ------------------------------------------------------------ van Emde Boas layout

def tree_size(levels: int) -> int:
    """Nodes of a full tree with ``levels`` levels of nodes."""
    return ((1 << (ARITY_BITS * levels)) - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Place of the nodes ``index`` at ``depth`` (the root has 0) in a tree of ``levels`` levels of nodes.

    The tree is cut at half height.  The upper half comes first; below it hang subtrees,
    stored one after the other; both are laid out in the same way again.
    """
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    low, shift = levels - top, ARITY_BITS * (depth - top)
    sub = index >> shift
    return tree_size(top) + sub * tree_size(low) + address(low, depth - top, index & ((1 << shift) - 1))


def block_levels(n_in_block: int, n_in_tree: int) -> int:
    """Levels of edges of a block: all of them where its tree has further blocks, else until one node remains."""
    if n_in_tree > 1 << BLOCK_BITS:
        return BLOCK_LEVELS
    k = 0
    while n_in_block > 1 << (ARITY_BITS * k):
        k += 1
    return k


def widths(n: int, height: int) -> list[int]:
    """Number of nodes by level, leaves first."""
    out = [n]
    for _ in range(height):
        out.append(-(-out[-1] // ARITY))
    return out


def build(leaves: list[bytes], height: int) -> bytes:
    """The subtree over ``leaves`` (32 bytes each) as one binary in van Emde Boas order."""
    nodes = np.zeros((tree_size(height + 1), 32), np.uint8)
    below = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, 32)
    nodes[address(height + 1, height, np.arange(len(below)))] = below
    for depth in range(height - 1, -1, -1):
        n = -(-len(below) // ARITY)
        kids = address(height + 1, depth + 1, np.arange(len(below)))
        here = address(height + 1, depth, np.arange(n))
        for i in range(n):
            run = nodes[kids[i * ARITY:(i + 1) * ARITY]].tobytes()
            nodes[here[i]] = np.frombuffer(sha256(run.hex().encode()).digest(), np.uint8)
        below = nodes[here]
    return nodes.tobytes()


class Subtree:
    """A stored block: its nodes by level and the siblings on a leaf's way up."""

    def __init__(self, data: bytes, n: int, height: int):
        hexed = data.hex()
        at = [address(height + 1, height - k, np.arange(w)).tolist() for k, w in enumerate(widths(n, height))]
        self.level = [[hexed[64 * a:64 * a + 64] for a in line] for line in at]
        self.height = height
        self.around: dict[tuple[int, int], tuple[str, str]] = {}

    def siblings(self, k: int, i: int) -> tuple[str, str]:
        """The run's other nodes, left and right of node ``i`` of level ``k``."""
        got = self.around.get((k, i))
        if got is None:
            lo = i & ~(ARITY - 1)
            line = self.level[k]
            got = "".join(line[lo:i]), "".join(line[i + 1:lo + ARITY])
            if k:  # a leaf's are used once
                self.around[k, i] = got
        return got

    def path(self, i: int) -> list[tuple[str, str]]:
        """Siblings of leaf ``i``, level by level."""
        return [self.siblings(k, i >> (ARITY_BITS * k)) for k in range(self.height)]


# ------------------------------------------------------------ Spark side

def positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (place in its group by ``order``) and ``n`` (rows of the group), both long.

    A range partition sorts by (group, order); equal rows are told apart by a random
    column, so that many copies of one row are still split.
    """
    keys = [group, *order, "_tie"]
    placed = stash(rows.withColumn("_tie", F.rand(11)).repartitionByRange(*keys).sortWithinPartitions(*keys)
                   .drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(group, "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
                       F.sum("_rows").over(Window.partitionBy(group)).alias("n"))
    return (placed.join(runs, [group, "_part"])
            .withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_before"))


def _build_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``nodes`` (the stored subtree) and ``top`` (its root) to rows of ``leaves``."""
    for batch in batches:
        for r in range(batch.num_rows):
            row = batch.slice(r, 1)
            leaves = row.column("leaves")[0].as_py()
            data = build(leaves, block_levels(len(leaves), row.column("n")[0].as_py()))
            keep = [row.column(c) for c in ("g", "block", "n", "ids", "bad")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array([len(leaves)], pa.int64()), pa.array([data], pa.binary()), pa.array([data[:32]], pa.binary())],
                ["g", "block", "n", "ids", "bad", "size", "nodes", "top"])


def blocks(nodes: DataFrame) -> DataFrame:
    """Manifest rows of one level from rows ``(g, pos, n, leaf, id, bad)``: one row per block of positions."""
    items = F.sort_array(F.collect_list(F.struct("pos", "leaf", "id", "bad")))
    grouped = (nodes.withColumn("block", F.shiftright("pos", BLOCK_BITS)).groupBy("g", "block")
               .agg(F.first("n").alias("n"), items.alias("it"))
               .select("g", "block", "n", F.col("it.leaf").alias("leaves"), F.col("it.id").alias("ids"), F.col("it.bad").alias("bad")))
    return stash(grouped.mapInArrow(_build_blocks, "g string, block bigint, n bigint, ids array<bigint>, bad array<binary>, "
                                                   "size bigint, nodes binary, top binary"))


def levels(nodes: DataFrame) -> list[DataFrame]:
    """Manifest levels from the leaves up; in the last one every group has a single block."""
    out = [blocks(nodes)]
    while out[-1].where(F.col("n") > 1 << BLOCK_BITS).limit(1).count():
        up = out[-1].where(F.col("n") > 1 << BLOCK_BITS).select(
            "g", F.col("block").alias("pos"), F.ceil(F.col("n") / F.lit(float(1 << BLOCK_BITS))).cast("bigint").alias("n"),
            F.col("top").alias("leaf"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("binary").alias("bad"))
        out.append(blocks(up))
    return out


def subtrees(batches: Iterator[pa.RecordBatch]):
    """Every manifest row as ``(row, its subtree)``."""
    for batch in batches:
        for r in range(batch.num_rows):
            row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
            yield row, Subtree(row["nodes"], row["size"], block_levels(row["size"], row["n"]))


PATH = "above array<string>, subroot string, root string"


def _hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every node of a block: the siblings on its way to the root (left and right parts by level)."""
    for row, tree in subtrees(batches):
        first = row["block"] << BLOCK_BITS
        out = {"g": [], "pos": [], "above": []}
        for i in range(row["size"]):
            out["g"].append(row["g"])
            out["pos"].append(first + i)
            out["above"].append([s for pair in tree.path(i) for s in pair] + row["above"])
        k = row["size"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["g"], pa.string()), pa.array(out["pos"], pa.int64()), pa.array(out["above"], pa.list_(pa.string())),
             pa.array([row["subroot"]] * k, pa.string()), pa.array([row["root"]] * k, pa.string())],
            ["g", "pos", "above", "subroot", "root"])


def hand_down(manifest: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Manifest rows of the lowest level with the way up of their roots; ``tops``: ``(g, above, subroot, root)`` of the trees."""
    known = tops.withColumn("pos", F.lit(0).cast("bigint"))
    single = known  # trees that end at a level below the highest
    for k in range(len(manifest) - 1, -1, -1):
        level = manifest[k]
        if k < len(manifest) - 1:
            known = known.unionByName(single.join(level.where(F.col("n") <= 1 << BLOCK_BITS).select("g"), "g"))
        joined = level.join(known.withColumnRenamed("pos", "block"), ["g", "block"])
        if k == 0:
            return joined
        known = stash(joined.select("g", "block", "n", "size", "nodes", "above", "subroot", "root")
                      .mapInArrow(_hand_down, f"g string, pos bigint, {PATH}"))
    raise AssertionError("a manifest has a level")


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per leaf: proof digest, and the root folded from the leaf at hand and its original siblings."""
    for row, tree in subtrees(batches):
        upper = row["above"]
        tail = "".join(upper)
        out = {"leaf": [], "proof_sha256": [], "folded_root": []}
        for i in range(row["size"]):
            path = tree.path(i)
            leaf = tree.level[0][i]
            bad = row["bad"][i]
            node = bad.hex() if bad is not None else leaf
            for left, right in path:
                node = digest(left + node + right)
            for k in range(0, len(upper), 2):
                node = digest(upper[k] + node + upper[k + 1])
            out["leaf"].append(leaf)
            out["proof_sha256"].append(digest("".join(s for pair in path for s in pair) + tail))
            out["folded_root"].append(node)
        k = row["size"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(row["ids"], pa.int64()), pa.array(out["leaf"], pa.string()), pa.array([row["subroot"]] * k, pa.string()),
             pa.array([row["root"]] * k, pa.string()), pa.array(out["proof_sha256"], pa.string()),
             pa.array(out["folded_root"], pa.string())],
            ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])


def manifest(leaves: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Stored levels of the groups' trees and of the tree of their subroots.

    ``leaves``: ``id bigint, g string`` (sortable group key), ``leaf binary`` and ``bad
    binary`` (a digest to prove in the leaf's place, else null).
    """
    low = levels(positions(leaves, "g", ["id", "leaf"]))
    tops = None
    for level in low:
        one = level.where(F.col("n") <= 1 << BLOCK_BITS).select(F.col("g").alias("key"), F.col("top").alias("leaf"))
        tops = one if tops is None else tops.unionByName(one)
    tops = tops.select(F.lit("").alias("g"), "key", "leaf", F.lit(None).cast("bigint").alias("id"),
                       F.lit(None).cast("binary").alias("bad"))
    placed = stash(positions(tops, "g", ["key"]))
    return low, [placed, *levels(placed)]


def prove(leaves: DataFrame) -> DataFrame:
    """Per leaf: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``."""
    low, (placed, *high) = manifest(leaves)
    root = F.lower(F.hex("top"))
    whole = high[-1].select("g", F.array().cast("array<string>").alias("above"), F.lit(None).cast("string").alias("subroot"),
                            root.alias("root"))
    ways = hand_down(high, whole).select("g", "block", "n", "size", "nodes", "above", "subroot", "root")
    ways = ways.mapInArrow(_hand_down, f"g string, pos bigint, {PATH}").drop("g", "subroot")
    tops = placed.join(ways, "pos").select(F.col("key").alias("g"), "above", F.lower(F.hex("leaf")).alias("subroot"), "root")
    rows = hand_down(low, stash(tops)).select("g", "block", "n", "size", "nodes", "ids", "bad", "above", "subroot", "root")
    out = rows.mapInArrow(_prove, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def leaves_of(docs: DataFrame, tampered: F.Column | None = None, text: F.Column | None = None) -> DataFrame:
    """Leaves of ``docs`` over :data:`FIELDS`; where ``tampered`` holds, ``bad`` is the leaf with ``text`` in place of the text."""
    f = [F.col(c) for c in FIELDS]
    bad = F.lit(None).cast("binary") if tampered is None else F.when(tampered, F.unhex(leaf_hash(*f[:-1], text)))
    return docs.select(F.col("doc_id").cast("bigint").alias("id"),
                       F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("g"),
                       F.unhex(leaf_hash(*f)).alias("leaf"), bad.alias("bad"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proofs of all documents; of every fifth id (by crc32) the text is lower-cased behind the manifest's back."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return prove(leaves_of(docs, hit, F.translate("text", _UPPER, _LOWER)))
