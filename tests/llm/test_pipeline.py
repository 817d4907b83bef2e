"""Stages of the pipeline on odd rows, tables without rows, and columns of clashing names."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from tests.llm.test_operators import DOCS, EDGE, prose, row

import corpus_pipeline
from tessera.llm.words import small_batches

STAGES = dict(corpus_pipeline.STAGES)
CLASHING = ["component_id", "kept", "class_id", "values", "size", "code", "spans", "found", "added", "lang_pred", "ids", "item_id", "node", "u", "v", "key", "uid", "__pii_key", "__near_dup_id", "__decontam_code"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    item = prose(1, 30)
    near = prose(2, 60).split()
    rows = [row(i, t) for i, t in EDGE] + [row(5, "Hello, world! 12345 it's"), row(5, "another text with the number five")]
    rows += [row(100, f"{prose(3, 20)} {item} {prose(4, 20)}"), row(101, " ".join(near)), row(102, " ".join([*near, "end"])), row(103, "write to ann@mail.example now", lang=None), row(104, prose(5, 40), source=None)]
    frame = spark.createDataFrame(rows, DOCS).drop("code").withColumns({c: F.lit(k) for k, c in enumerate(CLASHING)})
    frame.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item, 1), (2, None, 1), (None, "x", 1)], "item_id long, text string, code int").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def ids(df):
    return Counter(r["doc_id"] for r in df.collect())


def test_stages_on_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = ids(docs)
    out = {name: STAGES[name](spark, docs, folder) for name in ("language_id", "near_duplicates", "decontamination", "pii")}
    for frame in out.values():
        assert frame.columns == docs.columns and frame.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert before - ids(out["language_id"]) == Counter([1, 2, 3])
    gone = before - ids(out["near_duplicates"])
    assert gone == Counter({5: 3, 102: 1})  # 4 and 5 hold one text, and rows of 5 are one document
    assert before - ids(out["decontamination"]) == Counter([100])
    assert ids(out["pii"]) == before
    masked = {r["doc_id"]: r for r in out["pii"].collect()}
    assert masked[103]["text"] == "write to [EMAIL] now" and masked[103]["n_chars"] == 20 and masked[1]["text"] is None
    assert masked[104]["text"] == prose(5, 40) and masked[104]["key"] == CLASHING.index("key")


def test_the_run_on_odd_rows(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert set(ids(got)) == {4, 6, 7, 8, 9, 10, None, 12, 101, 103, 104}


def test_tables_without_rows(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_batches_are_made_small_but_not_larger(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for set_, want in (("10000", "1000"), ("0", "1000"), ("50", "50")):
            spark.conf.set(name, set_)
            small_batches(spark)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)
