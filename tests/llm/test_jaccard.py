from collections import Counter

import pytest

from ridgeline.llm import jaccard as J


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, percent, n):
    """(id, text) -> (size, smallest id of the component), by all pairs."""
    s = [shingles(r[1], n) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                up[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(s[i]), min(ids) if ids and s[i] else (r[0])))
    return Counter(out)


@pytest.mark.parametrize("percent,n", [(85, 4), (60, 2), (80, 5)])
def test_components_equal_brute_force(docs, rows, percent, n):
    got = Counter((r["id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_groups(docs, percent, n).collect())
    assert got == brute(rows, percent, n)


def test_hot_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*base[:k % 50], f"new{k}", *base[k % 50 + 1:]]) if k else " ".join(base)) for k in range(120)]
    rows += [(200 + k, " ".join([*base[:20], *[f"q{k}_{i}" for i in range(15)], *base[35:]])) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = Counter((r["id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_groups(df, 85, 4).collect())
    assert got == brute(rows, 85, 4)


def test_keep_one(docs, rows, none):
    kept = J.keep_one(docs, 80, 5)
    assert kept.columns == docs.columns
    want = brute(rows, 80, 5)
    left = Counter(r["doc_id"] for r in kept.collect())
    ids = {i: c for (i, n, c), _ in want.items() if n}
    assert all(left[i] == (1 if ids[i] == i else 0) for i in ids if i is not None)
    assert {r["doc_id"] for r in kept.collect() if not (r["text"] or "").split()} >= {44, 45, 46}
    assert J.keep_one(none).count() == 0


def test_keep_one_with_shared_and_null_ids(spark):
    words = lambda p: " ".join(f"{p}{i}" for i in range(40))
    near = words("n").replace("n39", "other")
    rows = [(1, words("a"), "x"), (1, words("b"), "y"), (None, words("n"), "p"), (None, words("n"), "q"), (None, near, "r"),
            (7, words("c"), "s"), (7, words("c"), "t"), (9, words("c"), "u"), (None, words("c"), "v"), (None, None, "w"), (None, "", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, tag string")
    kept = [(r["doc_id"], r["text"]) for r in J.keep_one(df.repartition(5), 80, 5).collect()]
    assert Counter(kept) == Counter([(1, words("a")), (1, words("b")), (7, words("c")), (None, None), (None, ""), *[k for k in kept if k[0] is None and k[1]]])
    assert sum(i is None and bool(t) for i, t in kept) == 1


def test_prefix_size():
    for n in range(1, 200):
        assert 1 <= J.prefix_size(n, 85) <= n and 100 * (n - J.prefix_size(n, 85) + 1) >= 85 * n


def links_brute(rows, percent, n):
    """(id, size, rows linked with) per row, by all pairs."""
    s = [shingles(r[1], n) for r in rows]
    near = lambda x, y: bool(x and y) and 100 * len(x & y) >= percent * len(x | y)
    return Counter((r[0], len(s[i]), sum(near(s[i], s[j]) for j in range(len(rows)) if j != i)) for i, r in enumerate(rows))


@pytest.mark.parametrize("percent,n", [(85, 4), (60, 2)])
def test_links_equal_all_pairs(docs, rows, none, percent, n):
    got = Counter((r["id"], r["n_shingles"], r["n_links"]) for r in J.jaccard_links(docs, percent, n).collect())
    assert got == links_brute(rows, percent, n)
    assert J.jaccard_links(none, percent, n).count() == 0


def test_links_inside_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 16)
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*base[:k % 50], f"new{k}", *base[k % 50 + 1:]]) if k else " ".join(base)) for k in range(120)]
    rows += [(300 + k, rows[k % 3][1]) for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = J.jaccard_links(df, 85, 4).collect()
    assert Counter((r["id"], r["n_shingles"], r["n_links"]) for r in got) == links_brute(rows, 85, 4)
    assert Counter((r["id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows, 85, 4)
    assert sum(r["n_links"] for r in got) > 2 * len(rows)
