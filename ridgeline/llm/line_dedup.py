"""Line dedup by pairwise alignment.

Lines are compared with their white space collapsed; lines without a word do not count.  A
*run* is a line with as many following lines, or as many lines before it, as it takes to reach
``min_words`` (50) words, so
that a frequent short line is only ever looked at together with its rarer neighbours: the
hash of a run is the rare hash by which overlapping documents are found.  Runs of both directions
cover every line of a common block: the run from its first line those up to 50 words, and the
runs that end at them the rest.  No run is left out for being frequent.  Documents are ordered by id (nulls last, then by
text); every shared run points from a later document to its first holder, one pair per document
and holder, so a group of copies gives pairs linear in its size.

Each pair is aligned by patience diff: lines that occur once on both sides, their
longest increasing chain, recursion between the links, common heads and tails; what
is left of the later document is aligned again until nothing is found, so moved blocks count.  Where a
chain of scattered lines passed a block over, the runs that both still share are aligned in the same way,
without those lines, until no shared run is left.  Only the
lines inside shared runs travel, with their places.  Aligned blocks of neighbouring lines with at
least ``min_words`` words are deleted from the later document.  Every deleted line stays
in an earlier one, because blocks are judged on the input and point to earlier documents only.

Nulls and empty texts have no lines and stay.  A document given twice (same id, same text)
gets the same result twice; null ids come last in the order.  Extra columns are kept by
``drop_common_blocks``, which also drops the documents of which no word is left.
Very long texts are values like others: they are read whole.
"""

from __future__ import annotations

from collections import Counter
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, parts, stash, table

MIN_WORDS = 50
BROADCAST_KEYS = 1_000_000  # document keys (id, text hash) sent to every executor at most


def read_lines(text: str | None) -> tuple[list[int], list[int], list[int]]:
    """``(places, hashes, words)`` of the lines with a word; a place is the number of the line in the text."""
    at, h, n = [], [], []
    for k, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        words = line.split()
        if words:
            at.append(k)
            h.append(xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63))
            n.append(len(words))
    return at, h, n


def runs(h: list[int], n: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """``(hash, first, last)`` of the shortest run that has ``min_words`` words from every line on, then up to every line."""
    spans, end, total = [], 0, 0
    for k in range(len(h)):
        while end < len(h) and total < min_words:
            total += n[end]
            end += 1
        if total < min_words:
            break
        spans.append((k, end - 1))
        total -= n[k]
    start, total = 0, 0
    for k in range(len(h)):
        total += n[k]
        while total - n[start] >= min_words:
            total -= n[start]
            start += 1
        if total >= min_words:
            spans.append((start, k))
    lines = np.array(h, np.int64)
    return [(xxhash.xxh3_64_intdigest(lines[p:q + 1].tobytes()) - (1 << 63), p, q) for p, q in dict.fromkeys(spans)]


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain increasing in both, of pairs sorted by the first (patience sorting)."""
    tops, piles, back = [], [], []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[p], piles[p] = j, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Matched places ``(i, j)`` of ``a[a0:a1]`` and ``b[b0:b1]`` by patience diff, sorted."""
    out, todo = [], [(a0, a1, b0, b1)]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        once = {a[i]: i for i in range(a0, a1) if na[a[i]] == 1 and nb.get(a[i]) == 1}
        links = _chain(sorted((once[b[j]], j) for j in range(b0, b1) if b[j] in once))
        if links:
            p, q = a0, b0
            for i, j in [*links, (a1, b1)]:
                todo.append((p, i, q, j))
                if i < a1 or j < b1:
                    out.append((i, j))
                p, q = i + 1, j + 1
            continue
        # only repeated lines in common: walk b, extending from the first place in a
        first: dict[int, list[int]] = {}
        for i in range(a0, a1):
            first.setdefault(a[i], []).append(i)
        i, j = a0, b0
        while j < b1:
            here = first.get(b[j], ())
            k = bisect_left(here, i) if here else 0
            if k < len(here):
                i = here[k]
                while i < a1 and j < b1 and a[i] == b[j]:
                    out.append((i, j))
                    i, j = i + 1, j + 1
            else:
                j += 1
    return sorted(out)


def common_blocks(pa_: list[int], a: list[int], pb: list[int], b: list[int], n: list[int], min_words: int) -> list[tuple[int, int]]:
    """``(first, last)`` indexes into b of aligned blocks with ``min_words`` words.

    ``pa_``, ``pb`` are the numbers of the lines among their documents' lines with a word: a block's lines
    are neighbours in both documents.
    """
    found, todo = [], [(0, len(b))]
    while todo:
        lo, hi = todo.pop()
        if sum(n[lo:hi]) < min_words:
            continue
        block: list[tuple[int, int]] = []
        blocks = []
        for i, j in [*patience(a, b, 0, len(a), lo, hi), (-1, -1)]:
            if block and i >= 0 and pa_[i] == pa_[block[-1][0]] + 1 and pb[j] == pb[block[-1][1]] + 1 and j == block[-1][1] + 1:
                block.append((i, j))
                continue
            if block and sum(n[q] for _, q in block) >= min_words:
                blocks.append((block[0][1], block[-1][1]))
            block = [(i, j)]
        at = lo
        for p, q in blocks:
            found.append((p, q))
            todo.append((at, p))
            at = q + 1
        if blocks:
            todo.append((at, hi))
    return sorted(found)


def realigned(pa_: list[int], a: list[int], pb: list[int], b: list[int], n: list[int], min_words: int,
              gone: frozenset | set = frozenset()) -> set[int]:
    """Indexes into b of the lines in blocks that the chain of single lines passed over.

    Patience diff once more, now of the runs that both have and that ``gone`` does not cover: a matched run is a
    block of ``min_words`` words by itself, so scattered lines cannot outbid it.  Matched runs leave both
    sides and the rest is aligned again, until no shared run is left; each pass takes one at least.
    """
    words = dict(zip(b, n))

    def spots(at, lines):
        start, out = 0, []
        for k in range(1, len(lines) + 1):
            if k == len(lines) or at[k] != at[k - 1] + 1:
                out += [(r, start + p, start + q) for r, p, q in runs(lines[start:k], [words.get(x, 0) for x in lines[start:k]], min_words)]
                start = k
        return sorted(out, key=lambda s: s[1:])

    x, y = spots(pa_, a), [s for s in spots(pb, b) if not gone.issuperset(range(s[1], s[2] + 1))]
    both = {s[0] for s in x} & {s[0] for s in y}
    x, y = ([s for s in side if s[0] in both] for side in (x, y))
    out: set[int] = set()
    while y:
        taken = {y[j][0] for _, j in patience([s[0] for s in x], [s[0] for s in y], 0, len(x), 0, len(y))}
        if not taken:
            break
        for r, p, q in y:
            if r in taken:
                out.update(range(p, q + 1))
        x, y = ([s for s in side if s[0] not in taken] for side in (x, y))
    return out


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = F.struct(F.col(f"`{id_col}`").isNull().alias("late"), F.col(f"`{id_col}`").alias("id"), F.md5(body).alias("tid"))
    return docs.withColumn("_key", key)


def find_blocks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``key, lines, from_ids``: the numbers of the lines to delete from every later document, and its earlier partners."""
    keyed = _keyed(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")), id_col, text).select(F.col("_key").alias("key"), F.col(f"`{text}`").alias("t"))
    key_type = dict(keyed.dtypes)["key"]

    def read(batches: Iterator[pa.RecordBatch]):
        for b in parts(batches):
            got = [read_lines(t.as_py()) for t in b.column(1)]
            rs = [runs(h, n, min_words) for _, h, n in got]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.int64())),
                 pa.array([g[2] for g in got], pa.list_(pa.int32())),
                 pa.array([[{"run": r, "i": i, "j": j} for r, i, j in x] for x in rs],
                          pa.list_(pa.struct([("run", pa.int64()), ("i", pa.int32()), ("j", pa.int32())])))],
                names=["key", "at", "h", "n", "runs"])

    lines = stash(keyed.mapInArrow(read, f"key {key_type}, at array<int>, h array<bigint>, n array<int>, runs array<struct<run:bigint,i:int,j:int>>"))
    spots = lines.select("key", F.inline("runs"))
    holders = (spots.groupBy("run").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("run", "first"))
    shared = stash(spots.join(holders, "run").groupBy("key").agg(
        F.collect_set(F.struct("i", "j")).alias("spots"), F.collect_set("first").alias("firsts")))
    body = lines.select("key", "at", "h", "n").dropDuplicates(["key"]).join(shared, "key")

    def shorten(batches: Iterator[pa.RecordBatch]):
        for b in parts(batches):
            out = []
            for at, h, n, spots in zip(*(b.column(c).to_pylist() for c in ("at", "h", "n", "spots"))):
                use = sorted({k for s in spots for k in range(s["i"], s["j"] + 1)})
                out.append((use, [at[k] for k in use], [h[k] for k in use], [n[k] for k in use]))
            i32 = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array([o[0] for o in out], i32), pa.array([o[1] for o in out], i32),
                 pa.array([o[2] for o in out], pa.list_(pa.int64())), pa.array([o[3] for o in out], i32), b.column("firsts")],
                names=["key", "no", "at", "h", "n", "firsts"])

    short = stash(body.mapInArrow(shorten, f"key {key_type}, no array<int>, at array<int>, h array<bigint>, n array<int>, firsts array<{key_type}>"))
    pairs = short.select("key", F.explode("firsts").alias("first")).where("first < key")
    both = (pairs.join(short.select(F.col("key").alias("first"), F.col("no").alias("no_a"), F.col("h").alias("h_a")), "first")
            .join(short.select("key", "no", "at", "h", "n"), "key"))

    def align(batches: Iterator[pa.RecordBatch]):
        for b in parts(batches):
            out = []
            for no_a, h_a, no, at, h, n in zip(*(b.column(c).to_pylist() for c in ("no_a", "h_a", "no", "at", "h", "n"))):
                gone = {k for p, q in common_blocks(no_a, h_a, no, h, n, min_words) for k in range(p, q + 1)}
                if len(gone) < len(h):
                    gone |= realigned(no_a, h_a, no, h, n, min_words, gone)
                out.append([at[k] for k in sorted(gone)])
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("first"), pa.array(out, pa.list_(pa.int32()))], names=["key", "first", "lines"])

    found = both.mapInArrow(align, f"key {key_type}, first {key_type}, lines array<int>").where("size(lines) > 0")
    return stash(found.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"),
                                          F.array_sort(F.collect_set("first.id")).alias("from_ids")))


def delete_lines(text: str, lines: list[int]) -> str:
    """A text without the numbered lines; wordless lines between two deleted neighbours go too."""
    rows, gone = text.split("\n"), set(lines)
    solid = [k for k, r in enumerate(rows) if r.strip(" \t\x0b\x0c\r")]
    for p, q in zip(solid, solid[1:]):
        if p in gone and q in gone:
            gone.update(range(p, q))
    return "\n".join(r for k, r in enumerate(rows) if k not in gone)


def _changed(docs: DataFrame, blocks: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows without and with deleted lines (the latter with ``lines``, ``from_ids`` and the shortened ``text``)."""
    keyed = _keyed(docs, id_col, text)
    keys = blocks.select(F.col("key").alias("_key"))
    few = keys.count() <= BROADCAST_KEYS
    same = F.col("_key.tid").eqNullSafe(F.col("k.tid")) & F.col("_key.id").eqNullSafe(F.col("k.id"))
    k = cut_lineage(keys.select("_key.id", "_key.tid"))
    k = (F.broadcast(k) if few else k).alias("k")
    rest = keyed.join(k, same, "left_anti")

    @F.pandas_udf("string")
    def shorter(t, lines):
        import pandas as pd
        return pd.Series([delete_lines(x or "", v) for x, v in zip(t, lines)], dtype=object)

    hit = (keyed.join(k, same, "left_semi").join(
        blocks.select(F.col("key.id").alias("_id"), F.col("key.tid").alias("_tid"), F.col("lines").alias("_lines"), F.col("from_ids").alias("_from")),
        F.col("_key.tid").eqNullSafe(F.col("_tid")) & F.col("_key.id").eqNullSafe(F.col("_id")))
        .withColumn("_before", F.col(f"`{text}`")).withColumn(text, shorter(F.col(f"`{text}`"), "_lines")))
    return rest, hit


def drop_common_blocks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", chars: str = "n_chars",
                       min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the blocks deleted; rows of which no word is left go; ``n_chars`` is brought up to date."""
    name = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    safe = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in name.items()])
    rest, hit = _changed(safe, find_blocks(safe, name[id_col], name[text], min_words), name[id_col], name[text])
    hit = hit.where(F.col(name[text]).rlike(r"[^\x20\x09-\x0D]"))
    if chars in name:
        hit = hit.withColumn(name[chars], F.length(name[text]).cast(dict(safe.dtypes)[name[chars]]))
    cols = list(name.values())
    return rest.select(cols).unionByName(hit.select(cols)).select(*[F.col(n).alias(c) for c, n in name.items()])


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines deleted from every document: number, partners, words left and digest of the text left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rest, hit = _changed(docs, find_blocks(docs), "doc_id", "text")
    body = F.coalesce(F.col("text"), F.lit(""))
    cols = ["doc_id", F.length(body).cast("bigint").alias("kept_chars"), F.sha2(body, 256).alias("kept_sha256")]
    none = F.array().cast("array<bigint>").alias("from_ids")
    return (rest.select(*cols, F.lit(0).cast("bigint").alias("n_removed"), none)
            .unionByName(hit.select(*cols, F.size("_lines").cast("bigint").alias("n_removed"), F.col("_from").alias("from_ids"))))


