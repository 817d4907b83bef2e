"""Operator 12 against the libraries, and what its cache saves."""

import public_tokenizers
import pytest
from tests.llm.test_alignment import odd_texts

from tessera.llm import token_counts
from tessera.llm.libraries import library_tokenizer, pieces_model
from tessera.plans.staging import new_path


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(spark, sf, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = pieces_model(path)
        count = lambda t: len(model.encode(t))
    else:
        whole = library_tokenizer(path, plain=False)
        count = lambda t: len(whole.encode(t, add_special_tokens=False).ids)
    texts = odd_texts(600) + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.createDataFrame([(k, t, b"x", 7) for k, t in enumerate(texts)], "doc_id long, text string, Content binary, n_tokens int").repartition(4)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs, tokenizer=path).collect()}
    want = [(len((t or "").encode()), n := count(t or ""), n > 512) for t in texts]
    assert [got[k] for k in range(len(texts))] == want


def encoded(monkeypatch):
    """Numbers of texts that went to be encoded, by call."""
    seen, own = [], token_counts.CountCache.append

    def append(self, counts, tokenizer):
        out = own(self, counts, tokenizer)
        seen.append(out.count())
        return out

    monkeypatch.setattr(token_counts.CountCache, "append", append)
    return seen


def test_only_distinct_misses_are_encoded(spark, monkeypatch):
    cache, seen = token_counts.CountCache(spark, new_path(spark, "cache")), encoded(monkeypatch)
    first = spark.createDataFrame([(1, "one"), (2, "one"), (3, None), (4, ""), (5, "two words"), (None, "one")], "doc_id long, text string")
    second = spark.createDataFrame([(1, "two words"), (2, "three more words"), (3, "three more words"), (4, None)], "doc_id long, text string")
    for docs, new, counts in ((first, 3, [1, 1, 0, 0, 2, 1]), (first, 0, [1, 1, 0, 0, 2, 1]), (second, 1, [2, 3, 3, 0])):
        got = token_counts.count_tokens(docs, cache)
        assert sorted(r["n_tokens"] for r in got.collect()) == sorted(counts) and seen.pop() == new
    # another tokenizer has counts of its own, and the first one's stay
    got = token_counts.count_tokens(first, cache, public_tokenizers.path("piece_bpe_32k.model"), limit=1)
    assert seen.pop() == 3 and {r["doc_id"]: r["over_limit"] for r in got.collect()}[5]
    token_counts.count_tokens(second, cache)
    assert seen.pop() == 0


def test_counts_appended_twice_give_a_row_each(spark, monkeypatch):
    cache, version = token_counts.CountCache(spark, new_path(spark, "cache")), token_counts.tokenizer_digest(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(1, "same"), (2, "same")], "doc_id long, text string")
    token_counts.count_tokens(docs, cache)
    cache.append(cache.read(version), version)  # as two jobs at the same time would
    assert sorted(r["n_tokens"] for r in token_counts.count_tokens(docs, cache).collect()) == [1, 1]


def test_empty_table(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
