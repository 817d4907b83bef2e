"""Operator 4 on short texts."""

import itertools

import numpy as np
from tests.llm.test_operators import DOCS, prose, row

from tessera.llm import near_dup


def test_short_texts_at_the_threshold_equal_brute_force(spark):
    texts = []
    for k in range(40):
        words = prose(9000 + k, 8 + k % 4).split()
        texts += [" ".join(words), " ".join([*words, f"end{k}"]), " ".join([f"start{k}", *words]), " ".join([*words, f"some{k}", f"more{k}"])]
    frame = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(frame).collect()}
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t in texts]
    root, exact = list(range(len(texts))), 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        value = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
        exact += value == 0.8
        if value >= 0.8:
            a, b = sorted((root[i], root[j]))
            root = [a if x == b else x for x in root]
    assert exact >= 20 and [got[i] for i in range(len(texts))] == root


def test_values_without_one_shingle():
    labels = np.random.default_rng(4).integers(0, 1 << 64, 7, dtype=np.uint64)
    own = near_dup.short_values(labels)
    assert len(set(own.tolist())) == 8
    for j in range(7):
        assert own[1 + j] == near_dup.short_values(np.delete(labels, j))[0]


def components(texts, least=0.8):
    labels, root = [near_dup._labels(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if root[i] != root[j] and near_dup.similarity(labels[i], labels[j], least) > 0:
            a, b = sorted((root[i], root[j]))
            root = [a if x == b else x for x in root]
    return root


def test_large_buckets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", 6)
    draw, texts = np.random.default_rng(8), []
    for group in range(2):  # copies with edits from none to many around one text, so that buckets are large and some links hang on others
        base = prose(9500 + group, 240).split()
        for k in range(100):
            words = list(base)
            for at in draw.choice(240, k % 8, replace=False):
                words[at] = f"edit{group}x{k}x{at}"
            texts.append(" ".join(words))
    frame = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(frame).collect()}
    want = components(texts)
    lost = sum(got[i] != want[i] for i in range(len(texts)))
    assert len(set(want)) < 60 and lost <= 0.03 * len(texts)
    # nothing is joined that isn't linked
    assert all(want[i] == want[got[i]] for i in range(len(texts)))


def test_large_bucket_that_no_centre_settles_is_compared_whole(spark, monkeypatch):
    """Pairs of like texts in one bucket, unlike all others: further centres alone find few of them."""
    monkeypatch.setattr(near_dup, "SMALL", 4)
    monkeypatch.setattr(near_dup, "_with_centre", lambda member, *_: member.selectExpr("v as u", "v").limit(0))
    bucket = near_dup._buckets
    monkeypatch.setattr(near_dup, "_buckets", lambda firsts: bucket(firsts.withColumn("values", near_dup.F.transform("values", lambda _: near_dup.F.lit(7).cast("long")))))
    texts = []
    for k in range(30):
        words = prose(9700 + k, 60).split()
        texts += [" ".join(words), " ".join([*words[:-1], f"end{k}"])]
    frame = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(frame).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts) == [i - i % 2 for i in range(len(texts))]


def test_rarest_shingles_make_few_pairs_of_a_group_and_lose_none(spark):
    """Copies with edits around one text, most of them too far from each other, and further copies of some."""
    draw, texts = np.random.default_rng(11), []
    base = prose(9900, 200).split()
    for k in range(120):
        words = list(base)
        for at in draw.choice(200, 5 + k % 4, replace=False):
            words[at] = f"edit{k}x{at}"
        words = words[: 200 - k % 7]
        texts.append(" ".join(words))
        if k % 10 == 0:
            longer = [*words, *(f"more{k}x{j}" for j in range(k % 40))]
            texts.append(" ".join(longer))
    labels = [near_dup._labels(t) for t in texts]
    member = spark.createDataFrame([(i, i, len(s)) for i, s in enumerate(labels)], "v long, c long, size long")
    frame = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], DOCS).select("doc_id", "text")
    rows = [tuple(r) for r in near_dup._by_rarest(member, frame, 0.8).collect()]
    linked = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if near_dup.similarity(labels[i], labels[j]) > 0}
    assert len(linked) >= 9 and linked <= set(rows)
    # all pairs of the group would be 8,646
    assert len(set(rows)) <= 1000
    # a component's own pairs are none
    together = member.selectExpr("v", "0L as c", "size")
    assert near_dup._by_rarest(together, frame, 0.8).isEmpty()


def test_ranked_shingles_of_one_component_are_no_rows(spark, monkeypatch):
    """Edits that no other text has keep their places, but only shingles that two components have go on."""
    made, stage = {}, near_dup.staged
    monkeypatch.setattr(near_dup, "staged", lambda df, name, *more: made.setdefault(name, stage(df, name, *more)))
    base = prose(9950, 100).split()
    texts = [" ".join([*base[:50], f"edit{k}", *base[51:]]) for k in range(40)]
    member = spark.createDataFrame([(i, i, len(near_dup._labels(t))) for i, t in enumerate(texts)], "v long, c long, size long")
    frame = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], DOCS).select("doc_id", "text")
    near_dup._by_rarest(member, frame, 0.8).collect()
    # of the 20 rarest shingles of a text 5 are its own (4 or more after hashes that fall together)
    first = [len(s) - int(np.ceil(len(s) * 0.8 - 2e-9)) + 1 for s in map(near_dup._labels, texts)]
    assert made["rarest"].count() <= sum(first) - 4 * len(texts)
    assert made["rarest"].groupBy("key").count().where("count < 2").isEmpty()
