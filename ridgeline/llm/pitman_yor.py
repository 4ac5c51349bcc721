"""Language-model scoring with a hierarchical Pitman-Yor model of word pairs.

Tokens are the lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` of a text and one end token.
The context of a token is the word before it (its 64-bit hash; ``START`` at the start).  Restaurants
fall back in three levels: the word before; its last byte (256 at the start, at most 257 *ends*),
shared by all words that end alike; the unigram restaurant.  The base is uniform over the known words
and one unknown.  Every table of a restaurant is a customer of its parent.

Layout.  Texts are read once into *units* of tokens; every unit sends its distinct pairs of word and word before to the
*blocks* of words, ranges of their hashes, a row with arrays per block.  A dish is a word after one word before, counted over all
training documents.  A dish of one customer has one table; those of more (live, ``l...``) are seated anew in every sweep, given
the parent's counts of the word, which the block has, and the tables of their restaurant, for which blocks of words ask the
blocks of words before (``contexts``).  Above that, a word has its dishes
in all ends: the customers ``c`` (tables of the dishes below) and tables ``t``, and its tables ``t0`` in the
unigram restaurant.  Given the totals per restaurant, words are independent, so a Gibbs sweep is one pass over
the live dishes and one over the words; totals are those of the pass before.  Within a word its ends are taken in
two halves: a dish's tables are removed from the parent, its customers are seated again one by one (join with weight
``c - d t``, a new table with ``(theta + d T) P_parent``), and of ``CANDIDATES`` such seatings one is drawn by
its importance weight (the product of the normalisers), the conditional of the seating given
everything else.  After 32 customers they come in blocks of a 32nd of those seated, seated
with the probabilities at the block's start: work per dish grows with log c, at every size.
Draws are hashes of word, context, sweep and step: no result depends on the partitioning.

Discounts come from the counts of counts, n1 / (n1 + 2 n2), one per level.  Averaged over the ``SAMPLES`` sweeps after
``BURN_IN``: the probabilities of the ends, and a context's discounted counts and weight of its parent, which are then added up.

Scoring.  Blocks answer every unit for its pairs, ends and words with counts, blocks of words before with theirs; the unit
makes probabilities of them and adds up its tokens.  Pairs of held-out texts only are sent with no customers.  What is
shuffled for a written table is let go with it, and tables are deleted when they have done their work.

Null texts count as empty: one end token.  A null id is in the training part (remainder of the empty string).
Repeated rows train and score like any other row.  Without training tokens every probability is 1 (one unknown word).
Words are told apart by 64-bit hashes.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import MASK64, give_back, lower_words, mix, small_batches, stash, table, word_hashes

CONTEXTS = 257
END, START = np.uint64(1), np.uint64(2)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
STRENGTH = 1.0
BURN_IN, SAMPLES = 2, 3
CANDIDATES = 4
FREQUENT = 1_000_000  # rows that `frequent` gives at most
CHUNK = 4_000_000  # tokens of a unit
BLOCK = 1_000_000  # tokens per block of words
SEATED = 4096  # dishes seated at a time
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tokens(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word hashes, hashes of the words before, ends)`` of a text, the end token last; an end is the last byte of the word before."""
    words = lower_words(text)
    h = word_hashes(words)
    last = np.fromiter(map(itemgetter(-1), words), np.int64, len(words))
    return np.append(h, END), np.append(START, h), np.append(256, last)


def _salted(h: np.ndarray, salt: int) -> np.ndarray:
    """``mix`` of the hashes and a salt, in one new array and one to work with."""
    h = h + np.uint64((salt * 2 + 1) * 0x9E3779B97F4A7C15 & MASK64)
    x = h >> np.uint64(30)
    for shift, factor in ((27, 0xBF58476D1CE4E5B9), (31, 0x94D049BB133111EB)):
        h ^= x
        h *= np.uint64(factor)
        np.right_shift(h, np.uint64(shift), out=x)
    h ^= x
    return h


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _uniform(key: np.ndarray, *salt: int) -> np.ndarray:
    h = key
    for s in salt:
        h = _salted(h, s)
    return _unit(h)


def seat(c: np.ndarray, p: np.ndarray, other: np.ndarray, theta: float, d: float, key: np.ndarray, sweep: int,
         candidates: int = CANDIDATES) -> np.ndarray:
    """Tables of dishes with ``c`` customers, given the parent's ``p`` and the ``other`` tables of their restaurants."""
    # dishes with the most customers first, a few at a time: those that still have some to seat are the first ones at every step
    order, out = np.argsort(-c, kind="stable"), np.empty(len(c), np.int64)
    for i in range(0, len(c), SEATED):
        at = order[i:i + SEATED]
        out[at] = _seat_sorted(c[at], p[at], other[at], theta, d, key[at], sweep, candidates)
    return out


def _seat_sorted(c: np.ndarray, p: np.ndarray, other: np.ndarray, theta: float, d: float, key: np.ndarray, sweep: int, k: int) -> np.ndarray:
    n = len(c)
    cc, pp, oo = np.repeat(c, k), np.repeat(p, k), np.repeat(other, k).astype(np.float64)
    kk = np.repeat(key, k) + np.tile(np.arange(k, dtype=np.uint64), n) * np.uint64(0xD1B54A32D192ED03)
    kk = _salted(mix(kk), sweep)
    t, weight = np.ones(n * k), np.zeros(n * k)
    j, step, live = 1, 0, int(np.searchsorted(-cc, -1))
    while live:
        tt, full = t[:live], max(1, j // 32)
        new = (theta + d * (oo[:live] + tt)) * pp[:live]
        z = np.maximum(j - d * tt, 0.0) + new
        q = np.minimum(1.0, new / z)
        h = _salted(kk[:live], step)
        if full == 1:
            weight[:live] += np.log(z)
            tt += _unit(h) < q
        else:
            block = np.minimum(full, cc[:live] - j)
            weight[:live] += block * np.log(z)
            u, v = _unit(h), _unit(_salted(h, 7))
            noise = np.sqrt(np.maximum(block * q * (1 - q), 0)) * np.sqrt(-2 * np.log(np.maximum(v, 1e-300))) * np.cos(2 * np.pi * u)
            many = np.floor(block * q + noise + _unit(_salted(h, 11)))
            tt += np.where(block == 1, u < q, np.clip(many, 0, block))
        j, step = j + full, step + 1
        live = int(np.searchsorted(-cc[:live], -j))
    w = weight.reshape(n, k)
    w = np.exp(w - w.max(1, keepdims=True))
    pick = (np.cumsum(w, 1) < (_uniform(key, sweep, 1 << 20) * w.sum(1))[:, None]).sum(1)
    return t.reshape(n, k)[np.arange(n), np.minimum(pick, k - 1)].astype(np.int64)


class Totals:
    """What all words share: customers and tables per restaurant, sizes, discounts."""

    def __init__(self, customers, tables, root_tables, vocabulary, d, d0, theta=STRENGTH):
        self.customers, self.tables, self.root_tables = customers, tables, root_tables
        self.root_customers, self.vocabulary = int(tables.sum()), vocabulary
        self.d, self.d0, self.theta = d, d0, theta

    def root(self, n: np.ndarray, t0: np.ndarray) -> np.ndarray:
        """The parent's predictive probability of words with n customers at t0 tables."""
        base = (self.theta + self.d0 * self.root_tables) / (self.vocabulary + 1)
        return (np.maximum(n - self.d0 * t0, 0.0) + base) / (self.theta + self.root_customers)

    def back(self) -> np.ndarray:
        """Weight of the parent per context."""
        return (self.theta + self.d * self.tables) / (self.theta + self.customers)


def _ragged(col) -> tuple[np.ndarray, np.ndarray]:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    off = col.offsets.to_numpy()
    return col.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]].astype(np.int64), np.diff(off)


def _sweep(word: np.ndarray, n: np.ndarray, ctx: np.ndarray, c: np.ndarray, t: np.ndarray, t0: np.ndarray, tot: Totals, sweep: int):
    """New ``(t, t0)`` of a block of words; ctx, c and t are the concatenated dishes, n per word."""
    owner = np.repeat(np.arange(len(n)), n)
    rank = np.arange(len(c)) - np.repeat(np.cumsum(n) - n, n)
    t = t.copy()
    root = np.bincount(owner, t, len(n)).astype(np.int64)
    # two halves of a word's contexts, one after the other
    for half in (0, 1):
        at = np.flatnonzero((c > 1) & (rank % 2 == half))
        o = owner[at]
        left = root[o] - t[at]
        p = tot.root(left, np.minimum(t0[o], left))
        fresh = seat(c[at], p, tot.tables[ctx[at]] - t[at], tot.theta, tot.d, mix(word[o] + ctx[at].astype(np.uint64)), sweep)
        t[at] = fresh
        root = np.bincount(owner, t, len(n)).astype(np.int64)
    base = np.full(len(n), 1.0 / (tot.vocabulary + 1))
    return t, seat(root, base, tot.root_tables - t0, tot.theta, tot.d0, mix(word + np.uint64(CONTEXTS)), sweep)


def _lists(values, n: np.ndarray, kind) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), values)


def pair_keys(w: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word and word before."""
    return mix(w + mix(u + GOLDEN))


def _packed(v: np.ndarray) -> bytes:
    """An array as its size in bytes and its bytes compressed (small ones: -1 and the bytes)."""
    raw = v.tobytes()
    if len(raw) < 256:
        return b"\xff" * 8 + raw
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(cell: bytes, kind) -> np.ndarray:
    size = int.from_bytes(cell[:8], "little", signed=True)
    return np.frombuffer(cell[8:] if size < 0 else pa.decompress(cell[8:], size, "zstd", asbytes=True), kind)


def _row(schema: pa.Schema, **values) -> list:
    """The cells of a row; arrays are packed."""
    cell = lambda v: _packed(v) if isinstance(v, np.ndarray) else v
    return [cell(values.get(f.name)) for f in schema]


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _schema(names: str, binary: str = "") -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in names.split(", "))] + [(n, pa.binary()) for n in binary.split()])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if pa.types.is_int32(f.type) else 'bigint' if pa.types.is_int64(f.type) else 'binary'}" for f in schema)


def _table(rows: list[list], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([_batch(rows, schema)])


def _get(t, name: str, kind, row: int = 0) -> np.ndarray:
    return _unpacked(t.column(name)[row].as_py(), kind)


def _all(t: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """The arrays of all rows one after the other, and their lengths."""
    got = [_unpacked(v, kind) for v in t.column(name).to_pylist()]
    return np.concatenate([np.zeros(0, kind), *got]), np.array([len(x) for x in got], np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    give_back()
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1)


def _bounds(hashes: np.ndarray, blocks: int) -> list[tuple[int, int, int]]:
    """``(block, from, to)`` of sorted hashes; a block is a range of hashes."""
    b = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    at = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
    return list(zip(b[at].tolist(), at.tolist(), np.append(at[1:], len(b)).tolist()))


def _units(given: DataFrame) -> DataFrame:
    """The texts of ``id, held_out, text`` as units of about ``CHUNK`` tokens: distinct hashes, their last bytes, the tokens' places among them, by byte."""
    id_type = dict(given.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]):
        held, size, number = [], 0, TaskContext.get().partitionId() << 32

        def out():
            n = np.array([len(h) for _, h, _ in held], np.int32)
            words, tok = np.unique(np.concatenate([START[None], *(h for _, h, _ in held)]), return_inverse=True)
            last = np.empty(len(words), np.int16)
            last[tok] = np.concatenate([[256], *(x for *_, x in held)])
            ids, out = (pa.concat_arrays([r.column(c) for r, *_ in held]) for c in ("id", "held_out"))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (ids, out)]
            # the most frequent words first: most bytes of the places are small
            order = np.argsort(-np.bincount(tok[1:], minlength=len(words)), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            tok = place[tok[1:]].astype("<u4").view(np.uint8).reshape(-1, 4).T
            cells = [pa.array([_packed(v)]) for v in (n, words[order], last[order], tok)]
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([int(n.sum())]), *lists, *cells],
                                              names=["unit", "tokens", "ids", "held", "size", "words", "last", "tok"])

        for b in _rows(batches):
            h, _, x = tokens(b.column("text")[0].as_py())
            held.append((b.select(["id", "held_out"]), h, np.append(x[1:], 0).astype(np.int16)))
            size += len(h)
            if size >= CHUNK:
                yield out()
                held, size, number = [], 0, number + 1
        if held:
            yield out()
        give_back()

    return _put(given.mapInArrow(run, f"unit bigint, tokens bigint, ids array<{id_type}>, held array<boolean>, size binary, words binary, last binary, tok binary"))


def _pairs(t) -> tuple[np.ndarray, ...]:
    """Of a unit: its words, their last bytes, the places of word and word before of its distinct pairs (by word, end, word before), the pair of every token."""
    size, words, last = _get(t, "size", np.int32), _get(t, "words", np.uint64), _get(t, "last", np.int16)
    v, order = len(words), np.argsort(words)
    place = np.empty(v, np.int64)
    place[order] = np.arange(v)
    words, last = words[order], last[order]
    tok = place[_get(t, "tok", np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()]
    before = np.append(0, tok[:-1])
    before[np.cumsum(size) - size] = np.searchsorted(words, START)
    order = np.argsort(last, kind="stable")
    rank = np.empty(v, np.int64)
    rank[order] = np.arange(v)
    pairs, of = np.unique(tok * v + rank[before], return_inverse=True)
    return words, last, pairs // v, order[pairs % v], of


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin."""
    differ = np.zeros(max(len(keys[0]) - 1, 0), bool)
    for k in keys:
        differ |= k[1:] != k[:-1]
    return np.flatnonzero(np.append(True, differ)) if len(keys[0]) else np.zeros(0, np.int64)


def _lengths(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(first, n))


_SENT = _schema("b int, unit bigint", "w k u x c")
_MERGED = _schema("kind int, b int, unit bigint", "w n m ctx k u c code end known")


def _send(units: DataFrame, blocks: int) -> DataFrame:
    """The distinct pairs of every unit, dealt by word: words, pairs of each, words before, their ends, training customers (0: held-out texts only)."""
    def run(batches: Iterator[pa.RecordBatch]):
        for t in _rows(batches):
            words, last, w, u, of = _pairs(t)
            train = ~np.repeat(t.column("held")[0].values.to_numpy(zero_copy_only=False), _get(t, "size", np.int32))
            c = np.bincount(of, train, len(w)).astype(np.int32)
            out = []
            for b, lo, hi in _bounds(words[w], blocks):
                first = lo + _runs(w[lo:hi])
                out.append(_row(_SENT, b=b, unit=t.column("unit")[0].as_py(), w=words[w[first]], k=_lengths(first, hi).astype(np.int32),
                           u=words[u[lo:hi]], x=last[u[lo:hi]], c=c[lo:hi]))
            yield _batch(out, _SENT)

    return units.mapInArrow(run, _ddl(_SENT))


def _merge(t: pa.Table) -> pa.Table:
    """A block of words with all its dishes (kind 0), and per unit the places of its pairs in that block (kind 1)."""
    words, _ = _all(t, "w", np.uint64)
    k, sent_words = _all(t, "k", np.int32)
    w, (u, size), (x, _), (c, _) = np.repeat(words, k), _all(t, "u", np.uint64), _all(t, "x", np.int16), _all(t, "c", np.int32)
    order = np.lexsort((u, x, w))
    w, u, x, c = w[order], u[order], x[order], c[order]
    first = _runs(w, x, u)
    pair = np.empty(len(order), np.int64)
    pair[order] = np.repeat(np.arange(len(first)), _lengths(first, len(order)))
    c = np.add.reduceat(c.astype(np.int64), first)
    w, u, x = w[first], u[first], x[first]
    ends, heads = _runs(w, x), _runs(w)
    end_of, word_of = (np.repeat(np.arange(len(f)), _lengths(f, len(w))) for f in (ends, heads))
    trained = c > 0
    n = np.add.reduceat(c, heads)
    k_end = np.add.reduceat(trained.astype(np.int64), ends)
    place = lambda known: np.where(known, np.cumsum(known) - 1, -1)
    end_at, word_at = place(k_end > 0), place(n > 0)
    live = c[trained] > 1
    code = np.zeros(len(c), np.int64)
    code[~trained] = -1
    code[np.flatnonzero(trained)[live]] = 1 + np.arange(live.sum())
    b = t.column("b")[0].as_py()
    some = ends[k_end > 0]
    m = np.bincount(word_at[word_of[some]], minlength=int((n > 0).sum()))
    out = [_row(_MERGED, kind=0, b=b, w=w[heads][n > 0], n=n[n > 0], m=m.astype(np.int32), ctx=x[some], k=k_end[k_end > 0], u=u[trained], c=c[trained])]
    start = 0
    for row in range(t.num_rows):
        p = pair[start:start + size[row]]
        start += size[row]
        e = end_of[p]
        e = e[_runs(e)]
        h = word_of[p]
        out.append(_row(_MERGED, kind=1, b=b, unit=t.column("unit")[row].as_py(), code=code[p].astype(np.int32), end=end_at[e].astype(np.int32), known=word_at[h[_runs(h)]].astype(np.int32)))
    return _table(out, _MERGED)


_CONTEXTS = _schema("ub int", "u one cu")
_STATE = pa.schema([*_schema("b int", "w n m ctx one c t t0 past le lu lc lt lpast"), ("sums", pa.list_(pa.int64()))])
_STATE_DDL = _ddl(pa.schema(list(_STATE)[:-1])) + ", sums array<bigint>"
_ASK = _schema("ub int, b bigint", "u s")
_ANSWER = _schema("b int, ub int", "tu")
_WEIGHTS = _schema("ub int", "u cu tables")
_REPLY = _schema("unit bigint, kind int, part int", "x y z")


def _contexts(merged: DataFrame, blocks: int) -> DataFrame:
    """Per block of words before: them, their dishes of one customer, their customers."""
    def ask(batches: Iterator[pa.RecordBatch]):
        for t in _rows(batches):
            c = _get(t, "c", np.int64)
            u, at = np.unique(_get(t, "u", np.uint64), return_inverse=True)
            one, cu = np.bincount(at, c == 1, len(u)).astype(np.int64), np.bincount(at, c, len(u)).astype(np.int64)
            yield _batch([_row(_CONTEXTS, ub=b, u=u[lo:hi], one=one[lo:hi], cu=cu[lo:hi]) for b, lo, hi in _bounds(u, blocks)], _CONTEXTS)

    def add(t: pa.Table) -> pa.Table:
        u, at = np.unique(_all(t, "u", np.uint64)[0], return_inverse=True)
        one, cu = (np.bincount(at, _all(t, c, np.int64)[0], len(u)).astype(np.int64) for c in ("one", "cu"))
        return _table([_row(_CONTEXTS, ub=t.column("ub")[0].as_py(), u=u, one=one, cu=cu)], _CONTEXTS)

    return _put(merged.select("u", "c").mapInArrow(ask, _ddl(_CONTEXTS)).groupBy("ub").applyInArrow(add, _ddl(_CONTEXTS)))


def _by_end(ctx: np.ndarray, *counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.bincount(ctx, v, CONTEXTS) for v in counts]).astype(np.int64)


def _first_state(batches: Iterator[pa.RecordBatch]):
    """One table per dish; ``sums``: customers and tables by end, tables of the unigram restaurant, then the counts of counts."""
    for r in _rows(batches):
        n, m, ctx, k, u, c = (_get(r, f, t) for f, t in (("n", np.int64), ("m", np.int32), ("ctx", np.int16), ("k", np.int64), ("u", np.uint64), ("c", np.int64)))
        owner = np.repeat(np.arange(len(k)), k)
        live = np.flatnonzero(c > 1)
        one = np.bincount(owner[c == 1], minlength=len(k)).astype(np.int64)
        t, lt = np.ones(len(k), np.int64), np.ones(len(live), np.int64)
        sums = [*_by_end(ctx, k, t), len(n), *((v == x).sum() for v in (c, k, m) for x in (1, 2)), len(n), n.sum()]
        yield _batch([_row(_STATE, b=r.column("b")[0].as_py(), w=_get(r, "w", np.uint64), n=n, m=m, ctx=ctx, one=one, c=k, t=t, t0=np.ones(len(n), np.int64), past=np.zeros(0, np.int64),
                   le=owner[live].astype(np.int32), lu=u[live], lc=c[live], lt=lt, lpast=np.zeros(len(live), np.int64), sums=[int(v) for v in sums])], _STATE)


def _asked(state: DataFrame, column: str, blocks: int) -> DataFrame:
    """The sums of a live dishes' column by word before, dealt by it."""
    def run(batches: Iterator[pa.RecordBatch]):
        for t in _rows(batches):
            u, at = np.unique(_get(t, "lu", np.uint64), return_inverse=True)
            s = np.bincount(at, _get(t, column, np.int64), len(u)).astype(np.int64)
            own = t.column("b")[0].as_py()
            yield _batch([_row(_ASK, ub=b, b=own, u=u[lo:hi], s=s[lo:hi]) for b, lo, hi in _bounds(u, blocks)], _ASK)

    return state.select("b", "lu", column).mapInArrow(run, _ddl(_ASK))


def _tables(key, asked: pa.Table, contexts: pa.Table) -> pa.Table:
    """The tables of the restaurants asked for."""
    u, size = _all(asked, "u", np.uint64)
    at, one = np.searchsorted(_get(contexts, "u", np.uint64), u), _get(contexts, "one", np.int64)
    tu = (one + np.bincount(at, _all(asked, "s", np.int64)[0], len(one)).astype(np.int64))[at]
    start = np.cumsum(size) - size
    return _table([_row(_ANSWER, b=b, ub=key[0].as_py(), tu=tu[i:i + n]) for b, i, n in zip(asked.column("b").to_pylist(), start, size)], _ANSWER)


def _parts(t: pa.Table, order: str, *names: tuple[str, type]) -> list[np.ndarray]:
    """Arrays of all rows one after the other, by the column ``order``."""
    t = t.sort_by(order)
    return [_all(t, n, k)[0] for n, k in names]


def _sweep_block(r: pa.Table, answers: pa.Table, tot: Totals, d2: float, sweep: int, keep: bool) -> pa.Table:
    """A block after one sweep: its live dishes, given the tables of the pass before, then its words."""
    word, ctx, m = _get(r, "w", np.uint64), _get(r, "ctx", np.int16).astype(np.int64), _get(r, "m", np.int32)
    c, t, t0, one = (_get(r, f, np.int64) for f in ("c", "t", "t0", "one"))
    at, lu, lc, lt, lpast = (_get(r, f, k) for f, k in (("le", np.int32), ("lu", np.uint64), ("lc", np.int64), ("lt", np.int64), ("lpast", np.int64)))
    owner = np.repeat(np.arange(len(m)), m)
    tu = _parts(answers, "ub", ("tu", np.int64))[0][np.unique(lu, return_inverse=True)[1]]
    n0, o = np.bincount(owner, t, len(m)).astype(np.int64), owner[at]
    left = c[at] - lt  # the parent's customers without this dish
    p = (np.maximum(left - tot.d * np.minimum(t[at], left), 0.0) + (tot.theta + tot.d * tot.tables[ctx[at]]) * tot.root(n0[o], t0[o])) / (tot.theta + tot.customers[ctx[at]])
    lt = seat(lc, p, tu - lt, tot.theta, d2, pair_keys(word[o], lu), sweep)
    # customers: the tables of the level below
    c = one + np.bincount(at, lt, len(c)).astype(np.int64)
    t, t0 = _sweep(word, m, ctx, c, np.where(c == 1, 1, t), t0, tot, sweep)
    past = _get(r, "past", np.int64)
    same = {f: r.column(f)[0].as_py() for f in ("b", "w", "n", "m", "ctx", "one", "le", "lu", "lc")}
    return _table([_row(_STATE, **same, c=c, t=t, t0=t0, past=np.concatenate([past, c, t, t0]) if keep else past, lt=lt,
                        lpast=lpast + lt if keep else lpast, sums=[int(v) for v in (*_by_end(ctx, c, t), t0.sum())])], _STATE)


def _sweep_with(shared, d2: float, sweep: int, keep: bool):
    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        return _sweep_block(state, answers, shared.value, d2, sweep, keep)

    return run


def _put(df: DataFrame) -> DataFrame:
    """``df`` written and read back; rows are whole blocks, so row groups stay small."""
    return Version(df).df


class Version:
    """A written table that the next sweep's takes the place of; ``by`` names a column with a folder per value."""

    def __init__(self, df: DataFrame, *by: str):
        self.spark, self.path, self.by = df.sparkSession, None, by
        self.put(df)

    def put(self, df: DataFrame) -> None:
        """Write ``df``, which may read the version before, then delete that one; what was shuffled for it goes at once."""
        small_batches(self.spark)
        old, self.path = self.path, scratch_path(self.spark, "t")
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            # the cells are compressed already
            df.write.partitionBy(*self.by).option("compression", "none").option("parquet.block.size", 32 << 20).parquet(self.path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        if old:
            self._delete(old)

    def delete(self, folder: str = "") -> None:
        """Delete all rows, or those of a folder."""
        self._delete(f"{self.path}/{folder}".rstrip("/"))

    def _delete(self, path: str) -> None:
        gone = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)


def weight(cu: np.ndarray, tables: np.ndarray, theta: float, d2: float) -> np.ndarray:
    """Averaged weight of the parent of contexts with ``cu`` customers at ``tables``, summed over the samples; 1 where there are none."""
    return (theta + d2 * (tables / SAMPLES)) / (theta + cu)


class Fitted:
    """A trained model: blocks of words (``state``), totals of the samples, training tokens; ``merged`` has all dishes, ``contexts`` the words before."""

    def __init__(self, state, samples, n_tokens, merged, contexts, blocks, d2, theta=STRENGTH):
        self.written, self.state = (state, merged), state.df
        self.samples, self.n_tokens, self.d2, self.theta = samples, n_tokens, d2, theta
        self.merged, self.contexts, self.blocks = merged, contexts, blocks

    def drop(self) -> None:
        """Delete what is written of the words and dishes."""
        for table in self.written:
            table.delete()

    def weight_blocks(self) -> DataFrame:
        """Blocks of words before: them, their customers, their tables summed over the samples."""
        def run(key, asked: pa.Table, contexts: pa.Table) -> pa.Table:
            u, one = _get(contexts, "u", np.uint64), _get(contexts, "one", np.int64)
            past = np.bincount(np.searchsorted(u, _all(asked, "u", np.uint64)[0]), _all(asked, "s", np.int64)[0], len(u))
            return _table([_row(_WEIGHTS, ub=key[0].as_py(), u=u, cu=_get(contexts, "cu", np.int64), tables=one * SAMPLES + past.astype(np.int64))], _WEIGHTS)

        asked = _asked(self.state, "lpast", self.blocks)
        return asked.groupBy("ub").cogroup(self.contexts.groupBy("ub")).applyInArrow(run, _ddl(_WEIGHTS))

    def weights(self) -> DataFrame:
        """``u, cu, back``: customers of every context and the averaged weight of its parent."""
        theta, d2 = self.theta, self.d2

        def run(batches: Iterator[pa.RecordBatch]):
            for r in _rows(batches):
                cu, tables = _get(r, "cu", np.int64), _get(r, "tables", np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(_get(r, "u", np.int64)), pa.array(cu), pa.array(weight(cu, tables, theta, d2))], names=["u", "cu", "back"])

        return self.weight_blocks().mapInArrow(run, "u bigint, cu bigint, back double")

    def counts(self) -> DataFrame:
        """``w, u, ctx, c, m``: customers of every dish and its averaged tables."""
        def out(w, u, ctx, c, m):
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (w, u, ctx.astype(np.int32), c, m)], names=["w", "u", "ctx", "c", "m"])

        def rare(batches: Iterator[pa.RecordBatch]):
            for r in _rows(batches):
                m, k, c = _get(r, "m", np.int32), _get(r, "k", np.int64), _get(r, "c", np.int64)
                one = c == 1
                w, ctx = np.repeat(np.repeat(_get(r, "w", np.int64), m), k), np.repeat(_get(r, "ctx", np.int16), k)
                yield out(w[one], _get(r, "u", np.int64)[one], ctx[one], c[one], np.ones(one.sum()))

        def live(batches: Iterator[pa.RecordBatch]):
            for r in _rows(batches):
                at = _get(r, "le", np.int32)
                w = np.repeat(_get(r, "w", np.int64), _get(r, "m", np.int32))
                yield out(w[at], _get(r, "lu", np.int64), _get(r, "ctx", np.int16)[at], _get(r, "lc", np.int64), _get(r, "lpast", np.int64) / SAMPLES)

        kind = "w bigint, u bigint, ctx int, c bigint, m double"
        return self.merged.df.where("kind = 0").mapInArrow(rare, kind).unionByName(self.state.mapInArrow(live, kind))


def fit(texts: DataFrame) -> Fitted:
    """The model of ``texts``, which has the one column ``text``."""
    return _fit(_units(texts.select(F.lit(0).alias("id"), F.lit(False).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))))


def _fit(units: DataFrame) -> Fitted:
    spark = units.sparkSession
    blocks = 1 + (units.agg(F.sum("tokens")).first()[0] or 0) // BLOCK
    merged = Version(_send(units, blocks).groupBy("b").applyInArrow(_merge, _ddl(_MERGED)), "kind")
    own = merged.df.where("kind = 0")
    contexts = _contexts(own, blocks)
    state = Version(own.mapInArrow(_first_state, _STATE_DDL))

    def sums() -> np.ndarray:
        got = np.zeros(2 * CONTEXTS + 9, np.int64)
        for k, n in state.df.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col")).collect():
            got[k] = n
        return got

    def discount(a, b):
        return float(min(0.95, max(0.1, a / (a + 2 * b)))) if a + b else 0.5

    now = sums()
    k1, k2, n1, n2, m1, m2, v, n_tokens = (int(x) for x in now[2 * CONTEXTS + 1:])
    d, d0, d2 = discount(n1, n2), discount(m1, m2), discount(k1, k2)
    totals = lambda s: Totals(s[:CONTEXTS], s[CONTEXTS:2 * CONTEXTS], int(s[2 * CONTEXTS]), v, d, d0)
    tot, samples = totals(now), []
    for sweep in range(BURN_IN + SAMPLES):
        keep = sweep >= BURN_IN
        shared = spark.sparkContext.broadcast(tot)
        answers = _asked(state.df, "lt", blocks).groupBy("ub").cogroup(contexts.groupBy("ub")).applyInArrow(_tables, _ddl(_ANSWER))

        state.put(state.df.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(_sweep_with(shared, d2, sweep, keep), _STATE_DDL))
        tot = totals(sums())
        if keep:
            samples.append(tot)
    return Fitted(state, samples, n_tokens, merged, contexts, blocks, d2)


def train(texts: DataFrame) -> tuple[DataFrame, list[Totals], int]:
    """``(state, totals of the samples, training tokens)`` of the levels above the word pairs; texts has the one column ``text``."""
    m = fit(texts)
    return m.state, m.samples, m.n_tokens


def _past(r, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a block, by sample: customers and tables of its ends; customers and tables of its words in the unigram restaurant."""
    m, past = _get(r, "m", np.int32), _get(r, "past", np.int64).reshape(samples, -1)
    owner, e = np.repeat(np.arange(len(m)), m), int(m.sum())
    t = past[:, e:2 * e]
    n = [np.bincount(owner, v, len(m)).astype(np.int64) for v in t]
    return np.stack([past[:, :e], t], 1), np.stack([np.array(n), past[:, 2 * e:]], 1)


def _predict(ends: np.ndarray, words: np.ndarray, ctx: np.ndarray, owner: np.ndarray, samples: list[Totals]) -> tuple[np.ndarray, np.ndarray]:
    """Averaged probabilities of ends (of a word ``owner``), and the unigram restaurant's by word and sample."""
    prob, roots = np.zeros(len(ctx)), []
    for (c, t), (n, t0), tot in zip(ends, words, samples):
        root = tot.root(n, t0)
        prob += np.maximum(c - tot.d * t, 0) / (tot.theta + tot.customers[ctx]) + tot.back()[ctx] * root[owner]
        roots.append(root)
    return prob / len(samples), np.stack(roots, 1)


def predictive(state: DataFrame, samples: list[Totals]) -> DataFrame:
    """``w, c, roots, ctx, prob``: averaged probabilities of the seen ends and the unigram restaurant's in every sample."""
    shared = state.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]):
        for r in _rows(batches):
            m = _get(r, "m", np.int32)
            prob, roots = _predict(*_past(r, len(shared.value)), _get(r, "ctx", np.int16), np.repeat(np.arange(len(m)), m), shared.value)
            out = [pa.array(_get(r, "w", np.int64)), pa.array(_get(r, "n", np.int64)),
                   _lists(roots.reshape(-1), np.full(len(m), roots.shape[1]), pa.float64()), _lists(_get(r, "ctx", np.int16).astype(np.int32), m, pa.int32()), _lists(prob, m, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, names=["w", "c", "roots", "ctx", "prob"])

    return stash(state.mapInArrow(run, "w bigint, c bigint, roots array<double>, ctx array<int>, prob array<double>"))


class HashIndex:
    """Open addressing over distinct 64-bit hashes: the row of a hash in one or two array reads."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot, self.row = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, pos = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(left):
            p = pos[left]
            _, first = np.unique(p, return_index=True)
            first = first[self.row[p[first]] < 0]
            self.slot[p[first]], self.row[p[first]] = keys[left[first]], left[first]
            left = np.delete(left, first)
            pos[left] = (pos[left] + 1) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of every hash, -1 where there is none."""
        pos = (h >> self.shift).astype(np.int64)
        row = self.row[pos]
        wrong = np.flatnonzero((row >= 0) & (self.slot[pos] != h))
        while len(wrong):
            pos[wrong] = (pos[wrong] + 1) & self.mask
            row[wrong] = self.row[pos[wrong]]
            wrong = wrong[(row[wrong] >= 0) & (self.slot[pos[wrong]] != h[wrong])]
        return row


class Lookup:
    """Words above the level of word pairs: counts, and log10 probabilities after every end seen in training (and one column for all others).

    ``back`` holds the parent's weight per sample and end.  The table is bounded by ``FREQUENT`` words
    times the contexts seen, at most 258, times four bytes.
    """

    def __init__(self, t: pa.Table, back: np.ndarray, seen: np.ndarray):
        w = t.column("w").combine_chunks().to_numpy().view(np.uint64) if t.num_rows else np.zeros(0, np.uint64)
        self.words, self.c = HashIndex(w), t.column("c").to_numpy()
        used = np.flatnonzero(seen)
        self.column = np.full(CONTEXTS, len(used))
        self.column[used] = np.arange(len(used))
        weight = np.append(back[:, used], np.ones((len(back), 1)), 1)
        self.table = np.zeros((len(w), len(used) + 1), np.float32)
        for k in range(0, len(w), 10_000):
            part = t.slice(k, 10_000).combine_chunks()
            roots = part.column("roots").combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1)
            p = roots @ weight / len(back)
            ctx, n = _ragged(part.column("ctx"))
            p[np.repeat(np.arange(len(n)), n), self.column[ctx]] = part.column("prob").combine_chunks().flatten().to_numpy()
            self.table[k:k + 10_000] = np.log10(p)

    def log10(self, row: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """Averaged log10 probabilities of known words."""
        return self.table[row, self.column[ctx]]


def frequent(model: DataFrame, bound: int = FREQUENT) -> tuple[DataFrame, int]:
    """The rows above a count ``c``, at most ``bound`` of them, and their number."""
    bucket = F.floor(8 * F.log2(F.col("c").cast("double"))).cast("int")
    sizes = sorted(((r[0], r[1]) for r in model.groupBy(bucket).count().collect()), reverse=True)
    least, total = None, 0
    for b, n in sizes:
        if total + n > bound:
            break
        least, total = b, total + n
    some = model.where(bucket >= least) if least is not None else model.limit(0)
    return some, total


def score_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", held_remainder: int = 2, modulus: int = 7) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % modulus == held_remainder
    given = docs.select(F.col(f"`{id_col}`").alias("id"), held.alias("held_out"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    units = _units(given)
    fitted = _fit(units)
    n_tokens, theta, d2, blocks = fitted.n_tokens, fitted.theta, fitted.d2, fitted.blocks
    total = float(n_tokens + fitted.samples[-1].vocabulary + 1)
    shared = spark.sparkContext.broadcast(fitted.samples)

    def by_word(state: pa.Table, asked: pa.Table) -> pa.Table:
        """Per unit and block of words: discounted counts of its pairs; counts of its ends and words in the samples, after those of its words in the texts."""
        ends, words = _past(state, SAMPLES)
        # a place of -1, the last one: not in the model
        ends, words = (np.concatenate([v.reshape(2 * SAMPLES, -1), np.zeros((2 * SAMPLES, 1), np.int64)], 1) for v in (ends, words))
        words = np.concatenate([np.append(_get(state, "n", np.int64), 0)[None], words])
        own = np.concatenate([[1.0 - d2], _get(state, "lc", np.int64) - d2 * (_get(state, "lpast", np.int64) / SAMPLES), [0.0]])
        return _table([_row(_REPLY, unit=asked.column("unit")[k].as_py(), kind=0, part=asked.column("b")[k].as_py(), x=own[_get(asked, "code", np.int32, k)],
                            y=ends[:, _get(asked, "end", np.int32, k)], z=words[:, _get(asked, "known", np.int32, k)]) for k in range(asked.num_rows)], _REPLY)

    def ask(batches: Iterator[pa.RecordBatch]):
        for t in _rows(batches):
            words, unit = np.sort(_get(t, "words", np.uint64)), t.column("unit")[0].as_py()
            yield _batch([_row(_ASK, ub=b, b=unit, u=words[lo:hi]) for b, lo, hi in _bounds(words, blocks)], _ASK)

    def by_context(asked: pa.Table, weights: pa.Table) -> pa.Table:
        """Per unit and block of words before: their customers and tables (0: not in the model)."""
        u, cu, tables = (_all(weights, c, k)[0] for c, k in (("u", np.uint64), ("cu", np.int64), ("tables", np.int64)))
        out = []
        for k in range(asked.num_rows):
            want = _get(asked, "u", np.uint64, k)
            at = np.searchsorted(u, want)
            hit = np.append(u, END)[at] == want
            hit &= at < len(u)
            x, y = np.zeros((2, len(want)), np.int64)
            x[hit], y[hit] = cu[at[hit]], tables[at[hit]]
            out.append(_row(_REPLY, unit=asked.column("b")[k].as_py(), kind=1, part=asked.column("ub")[k].as_py(), x=x, y=y))
        return _table(out, _REPLY)

    def score(t: pa.Table, replies: pa.Table) -> pa.Table:
        words, last, w, u, of = _pairs(t)
        first, second = (replies.filter(pc.equal(replies.column("kind"), k)).sort_by("part") for k in (0, 1))
        cells = lambda c, rows: np.concatenate([_unpacked(v, np.int64).reshape(rows, -1) for v in first.column(c).to_pylist()], 1)
        in_ends, in_words = cells("y", 2 * SAMPLES), cells("z", 2 * SAMPLES + 1)
        ends, heads = _runs(w, last[u]), _runs(w)
        owner = np.repeat(np.arange(len(heads)), _lengths(heads, len(w)))
        prob, _ = _predict(in_ends.reshape(SAMPLES, 2, -1), in_words[1:].reshape(SAMPLES, 2, -1), last[u[ends]], owner[ends], shared.value)
        cu, tables = (_all(second, c, np.int64)[0] for c in ("x", "y"))
        p = np.log10(_all(first, "x", float)[0] / (theta + cu[u]) + weight(cu, tables, theta, d2)[u] * np.repeat(prob, _lengths(ends, len(w))))
        n = in_words[0][owner]
        size = _get(t, "size", np.int32)
        doc = np.repeat(np.arange(len(size)), size)
        add = lambda v: np.bincount(doc, v[of], len(size))
        return pa.Table.from_arrays([t.column("ids").combine_chunks().flatten(), t.column("held").combine_chunks().flatten(), pa.array(size.astype(np.int64)),
                                     pa.array(add(n > 0).astype(np.int64)), pa.array(add(np.log10((n + 1) / total))), pa.array(add(p))],
                                    names=[id_col, "held_out", "n_tokens", "n_known", "base_score", "score"])

    fitted.merged.delete("kind=0")  # the state has all that is needed of the dishes
    asked = fitted.merged.df.where("kind = 1").select("b", "unit", "code", "end", "known")
    state = fitted.state.select("b", "m", "past", "n", "lc", "lpast")
    replies = state.groupBy("b").cogroup(asked.groupBy("b")).applyInArrow(by_word, _ddl(_REPLY))
    wanted = units.select("unit", "words").mapInArrow(ask, _ddl(_ASK))
    replies = replies.unionByName(wanted.groupBy("ub").cogroup(fitted.weight_blocks().groupBy("ub")).applyInArrow(by_context, _ddl(_REPLY)))
    replies = _put(replies)
    fitted.drop()
    id_type = dict(given.dtypes)["id"]
    out = units.drop("tokens").groupBy("unit").cogroup(replies.groupBy("unit")).applyInArrow(
        score, f"`{id_col}` {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select(id_col, "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
                      F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of six sevenths of them."""
    return score_texts(table(spark, sf_dir, "documents"))
