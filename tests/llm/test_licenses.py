import random

import numpy as np

from ridgeline.llm import licenses as L
from ridgeline.llm.common import word_hashes
from ridgeline.llm.license_texts import TEMPLATES


def test_templates_inside_noise():
    rnd = random.Random(1)
    index, noise = L.Index(), lambda n: " ".join(rnd.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(n))
    for name, text in TEMPLATES:
        doc = "é " + noise(30) + "\n" + text + "\n" + noise(20)
        got = [m for m in index.scan(doc) if m["license"] == name]
        assert len(got) == 1 and got[0]["coverage"] == 1.0 and got[0]["edits"] == 0
        cut = doc.encode()[got[0]["start_byte"]:got[0]["end_byte"]].decode()
        assert L.tokens(cut) == L.tokens(text)


def test_edits_are_tolerated_up_to_the_coverage():
    index = L.Index()
    text = dict(TEMPLATES)["MIT"].split(" ")
    for every, found in ((12, True), (2, False)):
        words = [w if k % every else "changed" for k, w in enumerate(text)]
        got = [m for m in index.scan("start " + " ".join(words) + " end") if m["license"] == "MIT"]
        assert bool(got) == found
    dropped = " ".join(w for k, w in enumerate(text) if k % 15 != 3)
    got = [m for m in index.scan(dropped) if m["license"] == "MIT"][0]
    assert got["matched"] == len(L.tokens(dropped)) and got["coverage"] < 1


def test_alignment_equals_full_matrix():
    """Best cost over all text spans, by the whole dynamic programme."""
    rnd = random.Random(5)
    for _ in range(60):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(4, 9))]
        pre = [rnd.choice("xyz") for _ in range(rnd.randint(0, 5))]
        body = [rnd.choice("abcdq") if rnd.random() < 0.2 else w for w in a if rnd.random() > 0.1]
        b = pre + body + [rnd.choice("xyz") for _ in range(rnd.randint(0, 5))]
        index = L.Index([("t", " ".join(a))])
        h = word_hashes([x.encode() for x in b])
        m, cost, s, e = index.align(0, h, len(pre), len(pre), band=6)
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        d[:, 0] = range(len(a) + 1)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1)
        assert cost == d[-1].min() and 0 <= s <= e <= len(b)


def test_odd_rows(docs, rows, none, spark):
    out = L.scan_licenses(docs, ["doc_id"])
    assert out.count() == len(rows) and out.where("n_licenses > 0").count() == 0
    assert L.scan_licenses(none, ["doc_id"]).count() == 0
    assert L.scan_licenses(docs, ["doc_id"], templates=()).where("n_licenses > 0").count() == 0


def test_every_planted_line_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = [t for _, t in TEMPLATES[:8]]
    want = {r["doc_id"] for r in docs.collect() if any(x in r["text"] for x in lines)}
    got = {r["doc_id"] for r in L.op2_licenses(spark, "/root/testdata/sf0.01").where("n_licenses > 0").collect()}
    assert want and got >= want
