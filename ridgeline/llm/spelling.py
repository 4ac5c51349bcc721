"""Grouping of spelling variants with a bit-sliced position index.

*Words.*  Every run of letters of a text is lower-cased (A-Z only).  Where ``ONE_IN``
divides the crc32 of ``<id>:<run>``, one code point of the run is deleted.  The words are
the distinct results of at least ``MIN_LEN`` code points that occur ``MIN_COUNT`` times.

*Near words* differ by exactly one inserted, deleted or replaced code point.  For a pair, let
``m`` be the shorter length and ``d`` the first place where the words differ.  Either the
first ``ceil(m/2)`` code points agree (``d`` lies behind them) or the last ``floor(m/2)`` do
(``d`` lies before them), so each pair meets in exactly one of two blocks: a block is the
length ``m``, a common prefix, a common suffix and the free place between them, in which
``d`` must lie.  A word is in the blocks of its own length (short) and of one less (long).
A block of more than ``BLOCK_WORDS`` words is cut: its free place is halved, each half makes
a block with a longer prefix or suffix, until the free place is one code point (then the
alphabet bounds the block).  Nothing is left out.

*Index.*  A task takes whole blocks, about ``BATCH_WORDS`` words at a time.  For every (position,
code point) of the free parts a bitset over these words tells which of them have it there.
All short words are searched at once; with ``e`` the set that agrees so far, ``s`` the set
with one replaced and ``i`` with one inserted code point, step ``p`` is

    i = (i | e & ~bit(p, q)) & bit(p + 1, q)
    s = s & bit(p, q) | e & ~bit(p, q)
    e = e & bit(p, q)

64 words at a time.  Deletions are the insertions seen from the longer word.  Every block
gives each of its words one row: near words counted, the most frequent one kept.

*Roots.*  A word's form has at least twice its count, so chains are short; they are
followed by pointer doubling.

Nulls: a null text has no words; a null id counts as empty text in the hash.  Empty texts
have no words; texts and runs of any length are read whole.  Ties of the count go to
the smaller word in code-point order.  Repeated rows count again.  An empty table gives
no rows.  Columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

MIN_LEN, MIN_COUNT = 5, 3
ONE_IN = 97
BLOCK_WORDS = 4096
BATCH_WORDS = 1024
BATCH_CELLS = 1 << 22
FLUSH = 200_000
_RUN = re.compile("[A-Za-zÀ-ÿ]+")


# ------------------------------------------------------------ words

def variants(doc_id, text: str | None) -> Counter:
    """The words of one document with their counts, after the deletions; one byte per code point (Latin-1)."""
    out: Counter = Counter()
    if not text:
        return out
    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    runs: Counter = Counter()
    for run, k in Counter(_RUN.findall(text)).items():
        runs[run.encode("latin-1").lower()] += k  # bytes.lower leaves all but A-Z alone
    for run, k in runs.items():
        if len(run) < MIN_LEN:  # a deletion makes it shorter still
            continue
        crc = crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if crc % ONE_IN == 0:
            cut = crc % len(run)
            run = run[:cut] + run[cut + 1:]
            if len(run) < MIN_LEN:
                continue
        out[run] += k
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush():
        return pa.RecordBatch.from_arrays(
            [pa.array([w.decode("latin-1") for w in acc], pa.string()), pa.array(list(acc.values()), pa.int64())], ["word", "n"])

    acc: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            acc.update(variants(doc_id.as_py(), text.as_py()))
            if len(acc) > FLUSH:
                yield flush()
                acc.clear()
    if acc:
        yield flush()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n`` of all words of ``docs``."""
    return (docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(_count, "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT))


# ------------------------------------------------------------ blocks

def block_rows(words: DataFrame) -> DataFrame:
    """Every word in its blocks: ``m, a, b, last, key, free, n, word``.

    ``a`` and ``b`` are the lengths of prefix and suffix, ``last`` whether the free
    place reaches the end (then the first difference may lie behind the shorter word).
    """
    m = F.explode(F.array(F.length("word"), F.length("word") - 1))
    sides = F.explode(F.array(
        F.struct(F.ceil(F.col("m") / 2).cast("int").alias("a"), F.lit(0).alias("b"), F.lit(True).alias("last")),
        F.struct(F.lit(0).alias("a"), F.floor(F.col("m") / 2).cast("int").alias("b"), F.lit(False).alias("last"))))
    rows = words.select("word", "n", m.alias("m")).where(F.col("m") >= MIN_LEN).select("*", sides.alias("x"))
    return _with_key(rows.select("word", "n", "m", "x.a", "x.b", "x.last"))


def _with_key(rows: DataFrame) -> DataFrame:
    key = F.concat(F.col("word").substr(F.lit(1), F.col("a")), F.lit("-"),
                   F.when(F.col("b") > 0, F.expr("right(word, b)")).otherwise(""))
    return rows.withColumn("key", key)


_BLOCK = ["m", "a", "b", "key"]


def refine(rows: DataFrame, limit: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Blocks that may stay, and the rows of the overfull ones in the blocks of their two halves."""
    sizes = rows.groupBy(*_BLOCK).agg(F.count(F.lit(1)).alias("k"))
    free = F.col("m") - F.col("a") - F.col("b")
    over = sizes.where((F.col("k") > limit) & (free > 1)).select(*_BLOCK)
    stay = rows.join(over, _BLOCK, "left_anti")
    half = F.ceil(free / 2).cast("int")
    sides = F.explode(F.array(
        F.struct((F.col("a") + half).alias("a"), F.col("b"), F.col("last")),
        F.struct(F.col("a"), (F.col("b") + free - half).alias("b"), F.lit(False).alias("last"))))
    cut = rows.join(over, _BLOCK, "left_semi").select("word", "n", "m", sides.alias("x"))
    return stay, _with_key(cut.select("word", "n", "m", "x.a", "x.b", "x.last"))


def blocks(words: DataFrame, limit: int = BLOCK_WORDS) -> DataFrame:
    """All blocks that can hold a pair: ``m, a, b, last, key, items`` (words with counts)."""
    kept, rows = None, block_rows(words)
    while True:
        stay, cut = refine(rows, limit)
        kept = stay if kept is None else kept.unionByName(stay)
        cut = stash(cut)
        if not cut.limit(1).count():
            break
        rows = cut
    short = F.max((F.length("word") == F.col("m")).cast("int"))
    return (kept.groupBy(*_BLOCK, "last").agg(F.collect_list(F.struct("word", "n")).alias("items"), short.alias("short"))
            .where((F.col("short") > 0) & (F.size("items") > 1)).drop("short"))


# ------------------------------------------------------------ bit-sliced search

def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit sets."""
    rows, n = flags.shape
    out = np.zeros((rows, -(-n // 64) * 8), np.uint8)
    packed = np.packbits(flags, axis=1, bitorder="little")
    out[:, :packed.shape[1]] = packed
    return out.view(np.uint64)


def near_pairs(block: np.ndarray, short: np.ndarray, last: np.ndarray, free: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(short word, word)`` of one block that differ once, first inside the free place.

    ``free`` are the free parts; ``block`` numbers the block of each word, ``last`` tells whether
    its free place reaches the end.
    """
    size = np.fromiter(map(len, free), np.int64, len(free))
    width = int(size.max(initial=0)) + 1
    codes = np.zeros((len(free), width + 1), np.uint8)  # 0: behind the end
    flat = np.frombuffer(b"".join(free), np.uint8)
    row = np.repeat(np.arange(len(free)), size)
    codes[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    q = np.flatnonzero(short)
    if not len(q):
        return q, q
    ids, of = np.unique(block, return_inverse=True)
    same = _bits(of[None, :] == np.arange(len(ids))[:, None])[of[q]]
    shorts = _bits(short[None, :])
    end = size[q]  # free length of the shorter word
    # a first difference is allowed inside the free place, behind it only at a word's end
    stop = np.where(last[q], end + 1, end)

    def index(p):
        letters, at = np.unique(codes[:, p], return_inverse=True)
        return letters, _bits(at[None, :] == np.arange(len(letters))[:, None])

    def having(slot, want):
        letters, sets = slot
        k = np.searchsorted(letters, want)
        k[k == len(letters)] = 0
        found = letters[k] == want
        out = sets[k]
        out[~found] = 0
        return out

    e, s, i = same, np.zeros_like(same), np.zeros_like(same)
    here = index(0)
    for p in range(width):
        ahead = index(p + 1)
        want = codes[q, p]
        agree = having(here, want)
        differ = e & ~agree
        differ[stop <= p] = 0
        i = (i | differ) & having(ahead, want)
        s = (s & agree) | differ
        e = e & agree
        here = ahead
    found = (s & shorts) | (i & ~shorts)
    at, cell = np.nonzero(found)
    hit, bit = np.nonzero(np.unpackbits(found[at, cell][:, None].view(np.uint8), axis=1, bitorder="little"))
    return q[at[hit]], cell[hit] * 64 + bit


def best_near(words: list[bytes], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(word, near words, the most frequent of them)`` from pairs; ties go to the smaller word."""
    if not len(a):
        return
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    yield from zip(a[first].tolist(), np.diff(np.r_[first, len(a)]).tolist(), b[first].tolist())


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per word of a block that has near words in it."""

    def flush():
        sub = np.array(blk)
        x, y = near_pairs(sub, np.array(is_short), np.array(is_last), free)
        n = np.array(count, np.int64)
        # a pair of short words is found from both sides, a longer word only from the shorter one
        long = ~np.array(is_short)[y]
        x, y = np.r_[x, y[long]], np.r_[y, x[long]]
        got = list(best_near(words, n, x, y))
        return pa.RecordBatch.from_arrays(
            [pa.array([words[w].decode("latin-1") for w, _, _ in got], pa.string()), pa.array([k for _, k, _ in got], pa.int64()),
             pa.array([count[v] for _, _, v in got], pa.int64()), pa.array([words[v].decode("latin-1") for _, _, v in got], pa.string())],
            ["word", "n_near", "best_n", "best"])

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("m", "a", "b", "last")]
        order = sorted(range(batch.num_rows), key=lambda r: (cols[0][r] - cols[1][r] - cols[2][r], r))
        blk, is_short, is_last, free, words, count = [], [], [], [], [], []
        for r in order:
            m, a, b, last = (c[r] for c in cols)
            items = batch.column("items")[r].as_py()
            cells = (len(words) + len(items)) * (m + 2 - a - b)
            if words and (len(words) + len(items) > BATCH_WORDS or cells > BATCH_CELLS):
                yield flush()
                blk, is_short, is_last, free, words, count = [], [], [], [], [], []
            for it in items:
                w = it["word"].encode("latin-1")
                blk.append(r)
                is_short.append(len(w) == m)
                is_last.append(last)
                free.append(w[a:len(w) - b])
                words.append(w)
                count.append(it["n"])
        if words:
            yield flush()


def near_words(words: DataFrame, limit: int = BLOCK_WORDS) -> DataFrame:
    """``word, n_near, best_n, best`` of every word that has near words."""
    part = blocks(words, limit).mapInArrow(_search, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w")))
    return (part.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x"))
            .select("word", "n_near", (-F.col("x.k")).alias("best_n"), F.col("x.w").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: chains followed to their end, twice as far in every round."""
    at = stash(forms.select("word", F.col("form").alias("root")))
    while True:
        jump = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = stash(at.join(jump, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                         F.col("next").isNotNull().alias("moved")))
        at = far.select("word", "root")
        if not far.where("moved").limit(1).count():
            return at


def group(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of ``docs``."""
    words = stash(vocabulary(docs, id_col, text))
    near = near_words(words)
    ok = F.col("best_n") >= 2 * F.col("n")
    out = stash(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(ok, F.col("best")).alias("form"), F.when(ok, F.col("best_n")).alias("form_n")))
    chains = roots(out.where(F.col("form").isNotNull()))
    return out.join(chains, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents."""
    return group(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
