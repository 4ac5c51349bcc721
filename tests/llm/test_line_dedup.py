import random
from collections import Counter

from ridgeline.llm import line_dedup as L


def brute(rows, min_words):
    """Kept text per row when every line run that an earlier document has is deleted."""
    import hashlib
    order = sorted({(r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest(), r[1]) for r in rows}, key=lambda r: r[:3])
    seen, out = {}, {}
    for late, i, tid, text in order:
        at, h, n = L.read_lines(text)
        rs = L.runs(h, n, min_words)
        gone = sorted({at[q] for k, a, b in rs if k in seen for q in range(a, b + 1)})
        out[(None if late else i, text)] = L.delete_lines(text or "", gone) if gone else text
        for k, _, _ in rs:
            seen.setdefault(k, i)
    return out


def test_equals_brute_force(docs, rows, none):
    want = brute(rows, 50)
    kept = L.drop_common_blocks(docs)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    left = [(r[0], want[r[0], r[1]], r[1]) for r in rows]
    expect = Counter((i, t) for i, t, before in left if (t or "").split() or not (before or "").split())
    assert got == expect
    assert all(r["n_chars"] == len(r["text"]) for r in kept.where("doc_id is not null and text is not null").collect())
    assert L.drop_common_blocks(none).count() == 0


def test_patience_finds_moved_and_repeated_blocks():
    a = list(range(100, 160))
    b = a[30:50] + [1, 2] + a[0:20] + [3] + [7, 7, 7]
    n = [10] * len(b)
    got = L.common_blocks(list(range(60)), a, list(range(len(b))), b, n, 50)
    assert got == [(0, 19), (22, 41)]
    assert L.common_blocks([0, 1], [7, 7], [0, 1, 2], [7, 7, 7], [30, 30, 30], 50) == [(0, 1)]
    assert L.common_blocks([], [], [0], [1], [60], 50) == []


def test_patience_matches_are_increasing_and_equal():
    rnd = random.Random(2)
    for _ in range(200):
        a = [rnd.randint(0, 12) for _ in range(rnd.randint(0, 25))]
        b = [rnd.randint(0, 12) for _ in range(rnd.randint(0, 25))]
        m = L.patience(a, b, 0, len(a), 0, len(b))
        assert all(a[i] == b[j] for i, j in m)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:]))


def test_runs_cover_blocks():
    h, n = [1, 2, 3, 4], [10, 45, 60, 3]
    # the shortest run from every line on, then the shortest one up to every line
    assert [(a, b) for _, a, b in L.runs(h, n, 50)] == [(0, 1), (1, 2), (2, 2), (2, 3)]


def test_query_at_small_scale(spark):
    out = L.op1_lines(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(rows, L.MIN_WORDS)
    got = {r["doc_id"]: r["kept_chars"] for r in out.collect()}
    assert got == {i: len(want[i, t] or "") for i, t in rows}


def blocks_brute(rows, min_words):
    """Kept text per (id, text) when every line of a maximal common line block with an earlier document goes."""
    import hashlib
    order = sorted({(r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest(), r[1]) for r in rows}, key=lambda r: r[:3])
    read = [(late, i, text, *L.read_lines(text)) for late, i, _, text in order]
    out = {}
    for k, (late, i, text, at, h, n) in enumerate(read):
        gone = set()
        for *_, other, _ in read[:k]:
            for d in range(-len(other) + 1, len(h)):  # diagonals: h[j] against other[j - d]
                j = max(d, 0)
                while j < min(len(h), len(other) + d):
                    q = j
                    while q < min(len(h), len(other) + d) and h[q] == other[q - d]:
                        q += 1
                    if sum(n[j:q]) >= min_words:
                        gone.update(at[j:q])
                    j = max(q, j + 1)
        out[(None if late else i, text)] = L.delete_lines(text or "", sorted(gone)) if gone else text
    return out


def _text(*lines):
    return "\n".join(" ".join(f"{name}{k}" for k in range(words)) for name, words in lines)


def test_ends_of_blocks_go(spark):
    copy = _text(("a", 10), ("b", 22), ("c", 93), ("d", 2))
    rows = [(4, copy), (5, copy), (6, _text(("x", 60))), (7, _text(("x", 60), ("t", 3), ("u", 4))), (8, _text(("z", 5), ("x", 60), ("t", 3), ("v", 70))),
            (9, _text(("e", 30), ("f", 10), ("g", 30))), (10, _text(("h", 9), ("e", 30), ("f", 10), ("g", 30), ("i", 1)))]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id bigint, text string, n_chars bigint").repartition(3)
    got = {r["doc_id"]: r["text"] for r in L.drop_common_blocks(df).collect()}
    want = blocks_brute(rows, 50)
    assert got == {i: want[i, t] for i, t in rows if want[i, t].split()}
    assert 5 not in got and got[7] == _text(("t", 3), ("u", 4)) and got[8] == _text(("z", 5), ("v", 70))


def test_query_equals_maximal_blocks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = blocks_brute(rows, L.MIN_WORDS)
    got = {r["doc_id"]: r["kept_chars"] for r in L.op1_lines(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: len(want[i, t] or "") for i, t in rows}


def test_runs_of_both_directions_cover_every_line():
    h, n = [1, 2, 3, 4], [10, 22, 93, 2]
    assert [(a, b) for _, a, b in L.runs(h, n, 50)] == [(0, 2), (1, 2), (2, 2), (2, 3)]


def test_blocks_passed_over_by_the_chain():
    a, b, n = [1, 2, 9], [9, 1, 5, 2], [60, 3, 2, 3]
    assert L.common_blocks([0, 1, 2], a, [0, 1, 2, 3], b, n, 50) == []
    assert L.realigned([0, 1, 2], a, [0, 1, 2, 3], b, n, 50) == {0}
    assert L.realigned(list(range(5)), [1, 2, 1, 2, 3], [0, 1, 2], [1, 2, 3], [20, 20, 20], 50) == {0, 1, 2}
    assert L.realigned([0, 2], [1, 2], [0, 1], [1, 2], [30, 30], 50) == set()


def test_moved_block_behind_scattered_lines_goes(spark):
    s1, s2, block, v, w, x = ("s", 3), ("t", 4), ("p", 60), ("v", 50), ("w", 50), ("x", 50)
    rows = [(0, _text(v, s1, s2)), (1, _text(s1, x)), (2, _text(s2, w)), (3, _text(v, s1, s2, block)), (4, _text(block, s1, x, s2, w))]
    assert L.common_blocks([0, 1, 2, 3], [1, 2, 3, 4], list(range(5)), [4, 2, 5, 3, 6], [60, 3, 50, 4, 50], 50) == []
    df = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id bigint, text string, n_chars bigint").repartition(3)
    got = {r["doc_id"]: r["text"] for r in L.drop_common_blocks(df).collect()}
    want = blocks_brute(rows, 50)
    assert got == {i: want[i, t] for i, t in rows if want[i, t].split()}
    assert 4 not in got


def test_nothing_goes_without_an_alignment(monkeypatch):
    a, b, n = [1, 2, 9], [9, 1, 5, 2], [60, 3, 2, 3]
    assert L.realigned([0, 1, 2], a, [0, 1, 2, 3], b, n, 50, {0}) == set()
    monkeypatch.setattr(L, "patience", lambda *_: [])
    assert L.common_blocks([0, 1, 2], a, [0, 1, 2, 3], b, n, 50) == []
    assert L.realigned([0, 1, 2], a, [0, 1, 2, 3], b, n, 50) == set()


def test_alignment_leaves_no_shared_run():
    rnd = random.Random(5)
    for _ in range(400):
        a = [rnd.randint(0, 9) for _ in range(rnd.randint(0, 20))]
        b = [rnd.randint(0, 9) for _ in range(rnd.randint(0, 20))]
        words = [rnd.randint(1, 40) for _ in range(10)]
        n = [words[x] for x in b]
        got = {k for p, q in L.common_blocks(list(range(len(a))), a, list(range(len(b))), b, n, 50) for k in range(p, q + 1)}
        got |= L.realigned(list(range(len(a))), a, list(range(len(b))), b, n, 50, got)
        want = set()
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                    k += 1
                if sum(n[j:j + k]) >= 50:
                    want.update(range(j, j + k))
        assert got == want
