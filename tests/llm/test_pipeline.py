import __spark_entry__ as E
import corpus_pipeline as C

from ridgeline.llm import decontaminate, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in C.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "pieces"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, before = docs.columns, docs.count()
    kept = docs
    for name, stage in C.STAGES[:-1]:
        kept = C.stash(stage(spark, kept, SF))
        assert kept.columns == cols and kept.count() <= before
        before = kept.count()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.flag(kept, bench).where("contaminated").count() == 0
    last = C.STAGES[-1][1](spark, kept, SF)
    assert last.count() == before and last.where("not round_trip").count() == 0
    assert {r["doc_id"] for r in C.run(spark, SF).collect()} == {r["doc_id"] for r in last.collect()}


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.judge(docs, quality.train(docs, labels), ["doc_id"]).join(labels, "doc_id")
    assert out.where("quality = 1 and not kept and not base_failed").count() <= 1


def test_entry_lists_all(spark):
    q = E.queries()
    assert "pipeline" in q and all(any(k.startswith(f"op{n}_") for k in q) for n in range(1, 11))
    assert {"op4_chat_format", "op5_decontamination", "op8_jaccard_join"} <= set(E.oracle_sql())
