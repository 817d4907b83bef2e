"""Operator 1 on items that many documents repeat."""

import pytest
from tests.llm import test_brute_force
from tests.llm.test_operators import DOCS, prose, row

from tessera.llm import decontam


def test_edited_copies_of_a_repeated_item_are_found(spark):
    item = prose(7100, 30)
    words = item.split()
    for at in range(5, 30, 6):  # the same place of each stretch, so that whole runs are the frequent ones
        words[at] = f"edit{at}"
    edited = " ".join(words)
    docs = [row(k, f"{prose(8000 + k, 20)} {item} {prose(8100 + k, 20)}") for k in range(40)]
    docs += [row(100 + k, f"{prose(8200 + k, 20)} {edited} {prose(8300 + k, 20)}") for k in range(30)]
    docs += [row(200 + k, prose(8400 + k, 60)) for k in range(30)]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r["doc_id"]: r["score"] for r in decontam.contaminated(spark.createDataFrame(docs, DOCS), benchmark).collect()}
    assert set(found) == set(range(40)) | set(range(100, 130))
    assert all(found[k] == 1 for k in range(40)) and all(found[100 + k] >= 20 / 30 for k in range(30))


@pytest.mark.parametrize("rare", [0, 3])
def test_frequent_runs_lose_no_pair(spark, monkeypatch, rare):
    monkeypatch.setattr(decontam, "RARE", rare)
    test_brute_force.test_alignments_equal_plain_smith_waterman(spark)
    test_edited_copies_of_a_repeated_item_are_found(spark)


@pytest.mark.parametrize("least", [0.3, 0.5, 0.7])
def test_every_share_is_found_by_words(spark, monkeypatch, least):
    docs = spark.createDataFrame([row(k, " ".join(w if (j * 7 + k) % (2 + k % 5) else f"x{j}" for j, w in enumerate(prose(k % 6, 24).split()))) for k in range(90)], DOCS)
    items = spark.createDataFrame([(k, prose(k, 24)) for k in range(6)], "item_id long, text string")
    want = {(r["doc_id"], r["item_id"], r["score"]) for r in decontam.contaminated(docs, items, least).collect()}
    monkeypatch.setattr(decontam, "RARE", 0)
    assert {(r["doc_id"], r["item_id"], r["score"]) for r in decontam.contaminated(docs, items, least).collect()} == want and want


def test_a_common_phrase_makes_no_pairs(spark):
    docs = spark.createDataFrame([row(k, f"a{k} in order to b{k} c{k} d{k}") for k in range(400)] + [row(1000, " ".join(f"q7w{j}" for j in range(12)) + " in order to")], DOCS)
    items = spark.createDataFrame([(k, " ".join(f"q{k}w{j}" for j in range(12)) + " in order to") for k in range(40)], "item_id long, text string")
    coded = decontam._with_code(docs)
    assert decontam._pairs(coded, items, 0.5).count() == 1
    assert [tuple(r)[:3] for r in decontam.contaminated(docs, items).select("doc_id", "item_id", "score").collect()] == [(1000, 7, 1.0)]


def test_items_in_a_very_long_text(spark):
    item = prose(1, 40)
    docs = spark.createDataFrame([row(1, "word " * 150_000 + item + " other" * 150_000), row(2, "word " * 300_000)], DOCS)
    items = spark.createDataFrame([(1, item), (2, "word " * 30)], "item_id long, text string")
    assert {tuple(r) for r in decontam.contaminated(docs, items).select("doc_id", "item_id", "score").collect()} == {(1, 1, 1.0), (1, 2, 1.0), (2, 2, 1.0)}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([row(1, prose(1, 30))], DOCS), spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        assert decontam.contaminated(d, i).count() == 0
