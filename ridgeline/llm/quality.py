"""Quality rules: boosted trees over document statistics.

``statistics`` of a text are counted in one vectorised pass.  A small gradient
boosting model (logistic loss, histogram splits, monotonic constraints) is fitted
on labelled documents and flattened into numpy node arrays, which score whole
Arrow batches level by level.

Training reads at most ``max_labelled`` (documented bound, default 20,000)
labelled rows, those with the smallest hash of their id; scoring covers every row.
The constraints: the score may never rise with the share of symbols, duplicate
lines, repeated words, capitals, ``!`` or ``|``, and never fall with the share of distinct words.

Words are ``[^\\x20\\x09-\\x0D]+`` (null text: none).  Base rules, before the model:
fewer than 20 words, or more than 30 % of the words in 8-word windows found twice
or more, reject a text.  Scores depend on the text alone: repeated rows and null
ids are scored like any other; extra columns are kept by ``keep_good``.  Labels
that are null or whose document is missing are not used; with labels of one class
only (or none) the model has no trees and keeps all that passes the base rules.
Very long texts are values like others: they are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, shingle_hashes, table, word_hashes, words_of

MAX_LABELLED = 20_000
SYMBOLS = "#*$%&|<>"
FEATURES = ("log_words", "mean_word", "symbols", "dup_lines", "repeats", "distinct", "capitals", "bangs", "bars",
            "digits", "short_lines", "top_word", "stops", "mean_line")
#: +1: never falls with the feature, -1: never rises, 0: free
CONSTRAINTS = (0, 0, -1, -1, -1, 1, -1, -1, -1, 0, 0, 0, 0, 0)
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
THRESHOLD = 0.5
_SPACES = " \t\n\x0b\x0c\r"


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text."""
    return _counts(text)[0]


def _counts(text: str | None):
    text = text or ""
    words = words_of(text)
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    dups = len(lines) - len(set(lines))
    h, repeats = word_hashes(words), 0
    if n > WINDOW:
        runs = shingle_hashes(h, WINDOW)
        order = np.sort(runs)
        again = order[1:][order[1:] == order[:-1]]
        if len(again):
            twice = np.flatnonzero(np.isin(runs, again))
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, twice, 1)
            np.add.at(edge, twice + WINDOW, -1)
            repeats = int((np.cumsum(edge)[:n] > 0).sum())
    return (n, chars, symbols, dups, repeats), lines, h


def features(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """The base counts and the model's features of a text."""
    base, lines, h = _counts(text)
    n, chars, symbols, dups, repeats = base
    t = text or ""
    k, c, m = max(1, n), max(1, chars), max(1, len(lines))
    order = np.sort(h)
    cnt = np.diff(np.flatnonzero(np.r_[True, order[1:] != order[:-1], True])) if n else order
    raw = t.encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8)
    hist = np.bincount(b, minlength=256) if len(b) else np.zeros(256, int)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    return base, [
        float(np.log1p(n)), chars / k, symbols / c, dups / m, repeats / k, len(cnt) / k, hist[65:91].sum() / c, hist[33] / c,
        hist[124] / k, hist[48:58].sum() / c, float((sizes < 30).sum()) / m, (cnt.max() if len(cnt) else 0) / k,
        (hist[46] + hist[63]) / k, float(np.log1p(sizes.mean() if len(sizes) else 0.0)),
    ]


class Forest:
    """Boosted trees as flat node arrays: feature, threshold, left, right, value, roots."""

    def __init__(self, feature, threshold, left, right, value, roots, base):
        self.feature, self.threshold, self.left, self.right, self.value = feature, threshold, left, right, value
        self.roots, self.base = roots, base

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row; all rows step down all trees at once."""
        out = np.full(len(x), self.base)
        if not len(self.roots) or not len(x):
            return out
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[rows, np.where(inner, f, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, constraints=CONSTRAINTS, rounds: int = 60, depth: int = 4, rate: float = 0.2,
        bins: int = 64, l2: float = 1.0, min_rows: int = 20) -> Forest:
    """Second-order boosting on one bounded sample.

    A split is allowed only if its two leaf values have the order its feature's
    constraint asks for; both children then inherit the middle value as a bound, so
    the whole tree, and the sum of trees, is monotonic.
    """
    nodes: list[list] = []
    roots, n, p = [], len(x), x.shape[1] if x.ndim == 2 else 0
    good = float(y.mean()) if n else 1.0
    if n == 0 or good in (0.0, 1.0):
        return Forest(*[np.zeros(0, t) for t in (int, float, int, int, float)], np.zeros(0, int), 10.0)
    base = float(np.log(good / (1 - good)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(p)]
    code = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(p)], 1)
    margin = np.full(n, base)

    def grow(rows, g, h, lo, hi, d):
        me = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        nodes.append([-1, 0.0, -1, -1, rate * float(np.clip(-gs / (hs + l2), lo, hi))])
        if d == 0 or len(rows) < 2 * min_rows:
            return me
        top = (1e-6, None)
        for j in range(p):
            if not len(edges[j]):
                continue
            m = len(edges[j]) + 1
            cj = code[rows, j]
            gl = np.cumsum(np.bincount(cj, g[rows], m))[:-1]
            hl = np.cumsum(np.bincount(cj, h[rows], m))[:-1]
            nl = np.cumsum(np.bincount(cj, minlength=m))[:-1]
            vl, vr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-(gs - gl) / (hs - hl + l2), lo, hi)
            gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
            ok = (nl >= min_rows) & (len(rows) - nl >= min_rows)
            if constraints[j]:
                ok &= constraints[j] * (vr - vl) >= 0
            gain = np.where(ok, gain, -np.inf)
            b = int(gain.argmax())
            if gain[b] > top[0]:
                top = (gain[b], (j, b, float(vl[b]), float(vr[b])))
        if top[1] is None:
            return me
        j, b, vl, vr = top[1]
        left = code[rows, j] <= b
        mid = (vl + vr) / 2
        c = constraints[j]
        a = grow(rows[left], g, h, max(lo, mid) if c < 0 else lo, min(hi, mid) if c > 0 else hi, d - 1)
        z = grow(rows[~left], g, h, max(lo, mid) if c > 0 else lo, min(hi, mid) if c < 0 else hi, d - 1)
        nodes[me][:4] = [j, float(edges[j][b]), a, z]
        return me

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        first = len(nodes)
        roots.append(grow(np.arange(n), q - y, q * (1 - q), -np.inf, np.inf, depth))
        part = _arrays(nodes, [first], 0.0)
        margin = margin + part.margin(x)
    return _arrays(nodes, roots, base)


def _arrays(nodes, roots, base) -> Forest:
    f, t, a, z, v = zip(*nodes)
    return Forest(np.array(f), np.array(t), np.array(a), np.array(z), np.array(v), np.array(roots), base)


def measure(docs: DataFrame, cols: list[str], text: str = "text") -> DataFrame:
    """``cols`` of ``docs`` with ``base`` (counts) and ``x`` (features) of the text."""
    given = docs.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{text}`").alias("_measured"))
    schema = given.drop("_measured").withColumns(
        {"base": F.lit(None).cast("array<bigint>"), "x": F.lit(None).cast("array<double>")}).schema

    def run(batches: Iterator[pa.RecordBatch]):
        for b in parts(batches):
            got = [features(t.as_py()) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.float64()))],
                names=schema.names)

    return given.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Forest:
    """The model of a bounded sample of labelled documents (smallest id hashes)."""
    lab = (labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    # the sample is bounded, so it goes to the documents and no text is shuffled
    known = measure(docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id"), ["doc_id", "quality"])
    # documents may share an id; one row per id keeps the bound
    rows = known.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("v")).select("v.*", "doc_id").collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([float(r["quality"] > 0) for r in rows]))


def judge(docs: DataFrame, forest: Forest, cols: list[str], threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``cols`` with the base counts, ``base_failed``, ``quality_score`` and ``kept`` of every row."""
    add = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
           "base_failed": "boolean", "quality_score": "double", "kept": "boolean"}
    given = docs.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{text}`").alias("_measured"))
    clash = set(add) & set(cols)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are already there")
    schema = given.drop("_measured").withColumns({c: F.lit(None).cast(t) for c, t in add.items()}).schema

    def run(batches: Iterator[pa.RecordBatch]):
        for b in parts(batches):
            got = [features(t.as_py()) for t in b.column(b.num_columns - 1)]
            base = np.array([g[0] for g in got], np.int64).reshape(len(got), 5)
            failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > REPEAT_PERCENT * base[:, 0])
            score = forest.score(np.array([g[1] for g in got], float).reshape(len(got), len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], *[pa.array(base[:, k]) for k in range(5)], pa.array(failed), pa.array(score),
                 pa.array(~failed & (score >= threshold))], names=schema.names)

    return given.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rejected rows, columns unchanged."""
    forest = train(docs, labels)
    name = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    safe = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in name.items()])
    kept = judge(safe, forest, list(name.values()), text=name[text]).where("kept")
    return kept.select(*[F.col(n).alias(c) for c, n in name.items()])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the model's verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
