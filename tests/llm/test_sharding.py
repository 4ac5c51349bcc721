import re
import zlib
from collections import Counter, defaultdict

from ridgeline.llm import sharding as S


def check(df, rows, shards=16):
    out = S.assign(df, shards).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in out:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return out


def test_odd_rows(docs, rows, none):
    check(docs, rows)
    assert S.assign(none).count() == 0


def test_near_equal_bytes_whole_groups_and_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    out = S.assign(df).collect()
    size, home = Counter(), defaultdict(set)
    for r in out:
        size[r["shard"]] += r["size"]
        home[r["text_crc32"], r["size"]].add(r["shard"])
    mean = sum(size.values()) / 16
    assert max(size.values()) < 1.03 * mean and min(size.values()) > 0.97 * mean
    assert all(len(v) == 1 for v in home.values())
    again = S.assign(df.repartition(13)).collect()
    assert Counter((r["doc_id"], r["shard"]) for r in out) == Counter((r["doc_id"], r["shard"]) for r in again)


def test_hot_group_is_split(spark):
    rows = [(k, "copy of one text" if k % 3 == 0 else f"text number {k}") for k in range(3000)]
    out = check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows, 8)
    size = Counter()
    for r in out:
        size[r["shard"]] += r["size"]
    assert max(size.values()) < 1.1 * sum(size.values()) / 8


def test_no_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert not re.search("Python|Pandas|Arrow", S.assign(df)._jdf.queryExecution().executedPlan().toString())


def test_units_are_bounded_in_rows(spark):
    """95 % empty texts: the windows that number the slots stay near the mean unit."""
    df = spark.range(400_000).selectExpr("id AS doc_id", "CASE WHEN id % 20 > 0 THEN '' ELSE repeat(concat('text ', id, ' '), 60) END AS text").repartition(8)
    shards = S.assign(df).groupBy("shard").agg({"size": "sum", "slot": "max", "*": "count"}).toPandas()
    assert shards["count(1)"].sum() == 400_000 and (shards["max(slot)"] + 1 == shards["count(1)"]).all()
    assert shards["sum(size)"].max() <= 1.02 * shards["sum(size)"].min()
    units = S.units_of(df).groupBy("ukey", "piece").count().toPandas()["count"]
    assert units.max() <= 2 * units.mean()
