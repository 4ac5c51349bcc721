import random

import pytest

SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, rid string, key int"


def corpus(seed=5, n=40):
    """Small documents with copies, near copies, shared blocks, odd rows and long texts."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(160)]
    line = lambda k: " ".join(rnd.choice(vocab) for _ in range(k)).capitalize() + "."
    docs = ["\n".join(line(rnd.randint(6, 30)) for _ in range(rnd.randint(1, 9))) for _ in range(n)]
    block = "\n".join(line(20) for _ in range(4))
    for k in (3, 9, 15):
        docs[k] = docs[k] + "\n" + block + "\n" + line(9)
    near = docs[4].split(" ")
    near[len(near) // 2] = "changed"
    texts = [*docs, docs[1], docs[1], " ".join(near), docs[2].upper(), "", None, "   \n\t", "one two", "ONE two", "x",
             "ab " * 3000, "é▁ü 日本 \u0000 z", "\n".join(docs[:6]), "\n".join([docs[7], docs[7]])]
    rows = [(i, t, f"s{i % 3}", None if t is None else len(t), "r", i) for i, t in enumerate(texts)]
    return rows + [rows[1], (None, docs[5], None, None, None, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
