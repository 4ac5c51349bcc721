import re
from collections import Counter

from ridgeline.llm import decontaminate as D


def toks(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def leaks(text, item):
    d, i = toks(text), toks(item)
    if len(i) < 8:
        return False
    w = min(13, len(i))
    for s in range(-len(i), len(d)):
        m = [0 <= s + k < len(d) and d[s + k] == i[k] for k in range(len(i))]
        if any(5 * sum(m[k:k + w]) >= 4 * w for k in range(len(i) - w + 1)):
            return True
    return False


ITEMS = [(0, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"),
         (1, "one two three four five six seven eight"), (2, "too short item"), (3, None), (4, ""), (5, "ja " * 20),
         (1, "one two three four five six seven eight"), (None, "red orange yellow green blue indigo violet black white")]


def test_verdicts_equal_brute_force(spark):
    a = ITEMS[0][1].split()
    texts = [" ".join(a), "x " * 50 + " ".join(a[2:15]) + " y" * 9, " ".join([*a[:5], "q", *a[6:9], "r", *a[10:]]), " ".join(a[:9]),
             "One, two; THREE four five six seven eight!", "one two three four x six seven eight", "one x three four x six seven eight",
             "one two three four five six seven", None, "", "ja ja ja", "ja " * 13, "red orange yellow green blue indigo violet black white",
             " ".join(a[:6] + ["k"] * 3 + a[6:]), "too short item"]
    rows = [(k, t, "c", k) for k, t in enumerate(texts)] + [(0, texts[0], "c", 0), (None, texts[0], "c", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string, seed int").repartition(3)
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = Counter((r[0], any(leaks(r[1], i[1]) for i in ITEMS)) for r in rows)
    assert Counter((r["doc_id"], r["contaminated"]) for r in D.flag(df.drop("item_id"), bench).select("doc_id", "contaminated").collect()) == want
    left = D.decontaminate(df, bench)
    assert left.columns == df.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(i for i, bad in want.elements() if not bad)
    assert D.decontaminate(df, bench.limit(0)).count() == len(rows)
    assert D.decontaminate(df.limit(0), bench).count() == 0


def test_masks_lose_no_window():
    """Every placement of the allowed substitutions in a window of 8 to 13 tokens leaves a hit."""
    from itertools import combinations
    for w in range(8, 14):
        for bad in combinations(range(w), w - -(-8 * w // 10)):
            assert any(all(m[e - s] == "0" for e in bad if 0 <= e - s < len(m)) for m in D.MASKS for s in range(w - len(m) + 1))


def test_no_python_on_the_main_path(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plan = D.flag(df, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
