import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_copies", "personal_data", "packing"]
    now, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialise(stage(spark, now, SF), name)
        assert after.columns == docs.columns
        counts.append(after.count())
        now = after
    assert counts == sorted(counts, reverse=True)
    assert counts[1] >= 0.97 * counts[0]  # clean documents stay
    assert counts[3] < counts[2] and counts[4] == counts[3]
    text = " ".join(r["text"] for r in now.select("text").collect())
    assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]", text) and "<EMAIL>" in text
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    per_doc = pieces.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(per_doc) == counts[4] and all(r["sum(length)"] == r["max(doc_tokens)"] for r in per_doc)


def test_empty_documents_pass_through(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.materialise(stage(spark, now, SF), name)
        assert now.count() == 0


def test_the_same_rows_again(spark):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    a, b = ({tuple(r[n] for n in names) for r in corpus_pipeline.run(spark, SF).collect()} for _ in range(2))
    # which cuts a document gets follows how rows are dealt out; which ids it has doesn't
    ends = lambda rows: {(r[0], r[4]) for r in rows}
    assert ends(a) == ends(b)
