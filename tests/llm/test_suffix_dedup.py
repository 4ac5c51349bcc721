import hashlib
from collections import Counter

from ridgeline.llm import suffix_dedup as S


def brute(texts, t=400):
    raw = [(x or "").encode() for x in texts]
    seen = Counter(r[i:i + t] for r in raw for i in range(len(r) - t + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - t + 1):
            if seen[r[i:i + t]] > 1:
                gone[i:i + t] = b"\1" * t
        runs = sum(1 for k in range(len(r)) if gone[k] and not (k and gone[k - 1]))
        out.append((len(r), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def check(df, rows):
    want = Counter((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows])))
    got = Counter(tuple(r) for r in S.remove_repeats(df).collect())
    assert got == want


def test_equals_brute_force(docs, rows, none):
    check(docs, rows)
    assert S.remove_repeats(none).count() == 0


def test_shifted_overlaps_and_runs(spark):
    """Overlaps of 390 to 420 bytes at odd places, runs of one letter, self overlaps, several partners of one passage."""
    import random
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    p = word(1500)
    texts = [word(300) + p[a:a + n] + word(rnd.randint(0, 300)) for a, n in
             [(0, 399), (1, 400), (0, 401), (500, 420), (480, 410), (505, 400), (900, 600), (901, 400), (1099, 401), (0, 1500)]]
    texts += ["a" * 399, "a" * 400, "b" * 401, "b" * 900, "xy" * 500, p, p, word(3000), "é" * 260, "é" * 200]
    rows = list(enumerate(texts))
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6), rows)


def test_every_string_has_its_anchor():
    import numpy as np
    for raw in (b"a" * 700, bytes(np.random.default_rng(1).integers(97, 101, 5000, np.uint8)), b"abc" * 400, b"q" * 399):
        p, lo, hi = S.spans(len(raw), S.anchors(raw))
        starts = sorted(x for a, l, h in zip(p, lo, hi) for x in range(a - S.WINDOW + 1 - h, a - S.WINDOW + 2 - l))
        assert starts == list(range(max(0, len(raw) - 399)))
        assert not len(hi) or hi.max() < S.WINDOW
