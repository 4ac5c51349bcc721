import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from ridgeline.llm import spelling as S
from ridgeline.llm.twins import SPELLING


def brute(docs):
    """The contract word by word."""
    c = Counter()
    for i, t in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(x.lower() if "A" <= x <= "Z" else x for x in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 97 == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            c[r] += 1
    v = {w: n for w, n in c.items() if len(w) >= 5 and n >= 3}
    near = {w: {u for u in v if one_edit(w, u)} for w in v}
    return sorted(rows_of(v, near), key=str)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def rows_of(v, near):
    form = {}
    for w in v:
        if near[w]:
            x = min(near[w], key=lambda u: (-v[u], u))
            if v[x] >= 2 * v[w]:
                form[w] = x
    for w in v:
        r = w
        while r in form:
            r = form[r]
        yield w, form.get(w), r, v[w], len(near[w]), v[form[w]] if w in form else None


def out(df):
    return sorted((tuple(r) for r in S.group(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def texts(seed, n):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abÉé") for _ in range(rnd.randint(4, 9))) for _ in range(40)]
    docs = []
    for i in range(n):
        words = []
        for _ in range(60):
            w = rnd.choice(stems)
            k = rnd.randrange(len(w))
            w = rnd.choice([w, w, w.upper(), w[:k] + w[k + 1:], w[:k] + rnd.choice("abz") + w[k:], w[:k] + rnd.choice("abz") + w[k + 1:]])
            words.append(w)
        docs.append((i, rnd.choice([" ", "-", "\n"]).join(words)))
    return docs


def test_equals_brute_force_on_odd_rows(spark):
    docs = texts(3, 60) + [(None, "Straßes straßes Straßes STRAßES"), (None, None), (7, ""), (7, "a b c"), (8, "x" * 40000 + " ") ,
                           (9, ("y" * 30000 + " ") * 4), (10, ("y" * 29999 + " ") * 9)]
    docs += docs[:5]
    want = brute(docs)
    assert sum(r[1] is not None for r in want) > 20 and max(len(r[0]) for r in want) == 30000
    df = spark.createDataFrame([(*r, "w", 1, "k") for r in docs], "doc_id bigint, text string, word string, n int, key string")
    assert out(df) == out(df.repartition(7)) == want


@pytest.mark.parametrize("limit", [3, 20])
def test_overfull_blocks_are_cut_without_loss(spark, limit):
    rnd = random.Random(9)
    v = {"pre" + "".join(rnd.choice("abc") for _ in range(rnd.randint(2, 5))) + "post": rnd.randint(3, 99) for _ in range(400)}
    words = spark.createDataFrame(list(v.items()), "word string, n bigint")
    got = {r["word"]: (r["n_near"], r["best"]) for r in S.near_words(words, limit).collect()}
    near = {w: [u for u in v if one_edit(w, u)] for w in v}
    assert got == {w: (len(x), min(x, key=lambda u: (-v[u], u))) for w, x in near.items() if x}
    whole, cut = S.block_rows(words), S.blocks(words, limit)
    assert cut.selectExpr("max(size(items)) AS k").first().k < whole.groupBy("m", "a", "b", "key").count().selectExpr("max(count) AS k").first().k


def test_bitsets_find_each_pair_once_in_its_place():
    words = [b"abcde", b"abxde", b"abcdef", b"aabcde", b"abcdd", b"zbcde", b"abcde"]
    short = np.array([len(w) == 5 for w in words])
    block = np.array([0, 0, 0, 0, 0, 0, 1])
    seen = defaultdict(int)
    for a, b, last in ((3, 0, True), (0, 2, False)):
        members = [k for k, w in enumerate(words) if (w[:a], w[len(w) - b:]) == (words[0][:a], words[0][5 - b:])]
        x, y = S.near_pairs(block[members], short[members], np.array([last] * len(members)), [words[k][a:len(words[k]) - b] for k in members])
        for i, j in zip(x, y):
            seen[members[i], members[j]] += 1
    # words that share the prefix or the suffix of the first one only
    assert {p for p in seen if p[0] == 0} == {(0, 1), (0, 2), (0, 3), (0, 4), (0, 5)} and set(seen.values()) == {1}


def test_empty(spark):
    assert S.group(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_roots_follow_long_chains(spark):
    chain = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(21)], "word string, form string")
    assert {tuple(r) for r in S.roots(chain).collect()} == {(f"w{k}", "w21") for k in range(21)}


def test_sql_twin(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted((tuple(r) for r in S.op11_spelling(spark, sf).collect()), key=str)
    assert got == sorted(con.execute(SPELLING).fetchall(), key=str)
