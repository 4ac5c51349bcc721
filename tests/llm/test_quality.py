import re
from collections import Counter

import numpy as np

from ridgeline.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = {k for i in range(len(words) - 7) if win[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
    lines, seen, dup = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_base_counts(rows, spark):
    texts = [r[1] for r in rows] + ["a b c d e f g h " * 3 + "z", "a\n\na\n b", "#*|<>&%$ é x", "one\x0btwo\x0cthree\rfour"]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in texts:
        assert Q.base_counts(t) == brute(t)


def test_model_is_monotonic_and_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] - x[:, 1] ** 2 + 0.3 * rng.normal(size=3000) > -0.5).astype(float)
    f = Q.fit(x, y, constraints=(1, 0, -1), rounds=40)
    assert ((f.score(x) > 0.5) == y).mean() > 0.9
    for j, sign in ((0, 1), (2, -1)):
        z = np.repeat(x[:200], 30, 0)
        z[:, j] = np.tile(np.linspace(-3, 3, 30), 200)
        assert (sign * np.diff(f.margin(z).reshape(200, 30), axis=1) >= -1e-12).all()


def test_arrays_equal_recursion():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    f = Q.fit(x, (x.sum(1) > 0).astype(float), constraints=(0, 0), rounds=5, min_rows=5)

    def walk(r):
        out = f.base
        for at in f.roots:
            while f.feature[at] >= 0:
                at = f.left[at] if r[f.feature[at]] <= f.threshold[at] else f.right[at]
            out += f.value[at]
        return out

    assert np.allclose(f.margin(x), [walk(r) for r in x])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    forest = Q.train(docs, labels.where("doc_id % 2 = 0"))
    out = Q.judge(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"), forest, ["doc_id", "quality"]).where("not base_failed")
    rows = out.select("quality", "kept").collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in rows]) > 0.98


def test_odd_rows(docs, rows, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (999, 0), (1, 1)], "doc_id bigint, quality int")
    kept = Q.keep_good(docs.withColumn("kept", docs.key), labels)
    assert kept.columns == [*docs.columns, "kept"]
    fine = Counter(r[0] for r in rows if (c := brute(r[1]))[0] >= 20 and 100 * c[4] <= 30 * c[0])
    assert Counter(r["doc_id"] for r in kept.collect()) == fine
    assert Q.keep_good(none, labels).count() == 0 and Q.keep_good(docs, labels.limit(0)).count() == sum(fine.values())
