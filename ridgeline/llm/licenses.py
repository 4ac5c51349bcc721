"""License scans: winnowed fingerprints pick templates, banded alignment proves them.

Template tokens (lower-cased runs of letters, digits and inner ``.+-``) are hashed in
runs of ``K`` tokens and winnowed (the smallest hash of every ``WINNOW`` consecutive
runs).  The inverted index hash -> (template, position) is bounded by the templates
and broadcast.  Every run of a text is looked up (a short notice has one run only); any
``WINNOW + K - 1`` tokens that agree with a template share a fingerprint.  Hits of one template whose diagonals lie
within the band are one candidate.  Each candidate is aligned (global for the template,
free ends in the text) inside a band around its diagonals; unit costs for
substitution, insertion and deletion.  A match is reported when at least
``MIN_COVERAGE`` of the template's tokens are matched.

Where matches of several templates overlap, the one with more matched tokens stays (ties:
higher coverage, then template order); the others are part of it.  Null and empty
texts have no matches.  Every row is scanned on its own, so repeated rows, null ids and
copies need no rule; extra columns are ignored.  No templates give no matches.
Very long texts are values like others: they are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, parts, shingle_hashes, table, word_hashes
from .license_texts import TEMPLATES

K, WINNOW = 3, 2
BAND = 6
MIN_COVERAGE = 0.8
_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+(?:[.+-][0-9a-z\x80-\xff]+)*")
INDEX_LIMIT = 2_000_000


def tokens(text: str | None) -> list[bytes]:
    """Tokens of a text."""
    return _TOKEN.findall((text or "").encode("utf-8", "surrogatepass").lower())


def token_spans(text: str) -> list[tuple[int, int]]:
    """UTF-8 byte span of every token."""
    return [m.span() for m in _TOKEN.finditer(text.encode("utf-8", "surrogatepass").lower())]


def least_hits(n: int, min_coverage: float = MIN_COVERAGE, k: int = K, w: int = WINNOW) -> int:
    """Fingerprints that any match of ``min_coverage`` of ``n`` template tokens must share, at least 1.

    ``e`` lost tokens break at most ``e*k`` runs and leave ``e+1`` stretches, each of
    which shares a fingerprint for every ``w`` of its runs, rounded down.
    """
    e = n - int(np.ceil(min_coverage * n))
    return max(1, (n - k + 1 - e * k - (e + 1) * (w - 1)) // w)


def fingerprints(h: np.ndarray, k: int = K, w: int = WINNOW) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed ``(hashes, positions)`` of a token hash sequence: the rightmost minimum of each window."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = mix(shingle_hashes(h, k) + np.uint64(1))
    w = min(w, len(g))
    win = np.lib.stride_tricks.sliding_window_view(g[::-1], w)[::-1]
    at = np.unique(np.arange(len(win)) + w - 1 - win.argmin(1))
    return g[at], at


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates=TEMPLATES):
        self.names = [n for n, _ in templates]
        self.hashes = [word_hashes(tokens(t)) for _, t in templates]
        rows = [(f, t, p) for t, h in enumerate(self.hashes) for f, p in zip(*map(np.ndarray.tolist, fingerprints(h)))]
        if len(rows) > INDEX_LIMIT:
            raise ValueError(f"{len(rows)} fingerprints; the broadcast index is bounded by {INDEX_LIMIT}")
        rows.sort()
        self.least = [least_hits(len(h)) for h in self.hashes]
        self.f = np.array([r[0] for r in rows], np.uint64)
        self.t = np.array([r[1] for r in rows], np.int64)
        self.p = np.array([r[2] for r in rows], np.int64)

    def candidates(self, h: np.ndarray, band: int = BAND) -> list[tuple[int, int, int]]:
        """``(template, lowest diagonal, highest diagonal)`` of hits whose diagonals chain within the band."""
        f, at = fingerprints(h, w=1)
        if not len(f) or not len(self.f):
            return []
        lo, hi = np.searchsorted(self.f, f, "left"), np.searchsorted(self.f, f, "right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            return []
        pairs = Counter((int(self.t[j]), int(at[i] - self.p[j])) for i in hit for j in range(lo[i], hi[i]))
        out = []
        for t, d in sorted(pairs):
            if out and out[-1][0] == t and d - out[-1][2] <= band and d - out[-1][1] <= 4 * band:
                out[-1][2] = d
                out[-1][3] += pairs[t, d]
            else:
                out.append([t, d, d, pairs[t, d]])
        return [tuple(c[:3]) for c in out if c[3] >= self.least[c[0]]]

    def align(self, t: int, h: np.ndarray, d0: int, d1: int, band: int = BAND) -> tuple[int, int, int, int]:
        """``(matched, edits, start, end)`` of the best banded alignment; the span is in text tokens."""
        a = self.hashes[t]
        lo, width = d0 - band, d1 - d0 + 2 * band + 1
        n = len(h)
        cols = lo + np.arange(width)  # text position before which row 0 stands
        cost = np.where((cols >= 0) & (cols <= n), 0, 1 << 30).astype(np.int64)
        start, match = cols.copy(), np.zeros(width, np.int64)
        for i in range(len(a)):
            j = cols + i  # text token of a diagonal step
            inside = (j >= 0) & (j < n)
            same = inside & (h[np.clip(j, 0, max(n - 1, 0))] == a[i]) if n else inside
            # diagonal step keeps the offset; skipping the template's token moves one left
            diag = np.where(inside, cost + ~same, 1 << 30)
            skip = np.append(cost[1:], 1 << 30) + 1
            use = skip < diag
            nc = np.where(use, skip, diag)
            ns = np.where(use, np.append(start[1:], 0), start)
            nm = np.where(use, np.append(match[1:], 0), match + same)
            # extra text tokens: move right one by one
            for q in range(1, width):
                if nc[q - 1] + 1 < nc[q] and cols[q] + i + 1 <= n:
                    nc[q], ns[q], nm[q] = nc[q - 1] + 1, ns[q - 1], nm[q - 1]
            cost, start, match = nc, ns, nm
        ends = cols + len(a)
        ok = (cost < 1 << 29) & (ends >= 0) & (ends <= n)
        if not ok.any():
            return 0, len(a), 0, 0
        best = int(np.lexsort((ends, -match, np.where(ok, cost, 1 << 40)))[0])
        return int(match[best]), int(cost[best]), max(0, int(start[best])), int(ends[best])

    def scan(self, text: str | None, min_coverage: float = MIN_COVERAGE) -> list[dict]:
        """Matches of one text, by start."""
        h = word_hashes(tokens(text))
        found = []
        for t, d0, d1 in self.candidates(h):
            matched, edits, a, b = self.align(t, h, d0, d1)
            cover = matched / len(self.hashes[t])
            if b > a and cover >= min_coverage:
                found.append((matched, cover, t, edits, a, b))
        out, spans = [], token_spans(text) if found else []
        for m, c, t, e, a, b in sorted(found, key=lambda r: (-r[0], -r[1], r[2], r[4])):
            if all(b <= x["_a"] or a >= x["_b"] for x in out):
                out.append({"license": self.names[t], "coverage": c, "matched": m, "edits": e,
                            "start_byte": spans[a][0], "end_byte": spans[b - 1][1], "_a": a, "_b": b})
        out.sort(key=lambda x: x["_a"])
        return [{k: v for k, v in x.items() if k[0] != "_"} for x in out]


_MATCH = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("edits", pa.int64()),
                             ("start_byte", pa.int64()), ("end_byte", pa.int64())]))


def scan_licenses(docs: DataFrame, cols: list[str], text: str = "text", templates=TEMPLATES) -> DataFrame:
    """``cols`` with ``n_licenses`` and ``matches`` (license, coverage, matched, edits, byte span) of every row."""
    given = docs.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{text}`").alias("_scanned"))
    schema = given.drop("_scanned").withColumns({"n_licenses": F.lit(None).cast("bigint"), "matches": F.lit(None).cast(
        "array<struct<license:string,coverage:double,matched:bigint,edits:bigint,start_byte:bigint,end_byte:bigint>>")}).schema
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates))

    def run(batches: Iterator[pa.RecordBatch]):
        index = shared.value
        for b in parts(batches):
            got = [index.scan(t.as_py()) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([len(g) for g in got], pa.int64()), pa.array(got, _MATCH)],
                                             names=schema.names)

    return given.mapInArrow(run, schema)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document, with coverage and spans."""
    return scan_licenses(table(spark, sf_dir, "documents"), ["doc_id"])
