"""Operator 13 against a plain alignment by sets of ends."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import alignment
from tessera.llm.libraries import library_tokenizer, pieces_model

NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tools():
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return library_tokenizer(paths[0], plain=True), pieces_model(paths[1]), alignment.tool(*paths)


def groups_of(text, tools):
    """[(ids of A, ids of B)] of a text's groups, or None."""
    a_tool, b_tool, own = tools
    if not text:
        return None
    a, b, raw = a_tool.encode(" " + text, add_special_tokens=False).ids, b_tool.encode(text), (" " + text).encode()
    sides = [[own.a.bytes[k] for k in a], [own.pieces[k] for k in b]]
    if any(b"".join(side) != raw for side in sides):
        return None
    ends = [np.cumsum([len(x) for x in side]).tolist() for side in sides]
    out, at = [], [0, 0]
    for cut in sorted(set(ends[0]) & set(ends[1])):
        upto = [side.index(cut) + 1 for side in ends]
        out.append((a[at[0] : upto[0]], b[at[1] : upto[1]]))
        at = upto
    return out


def plain(texts, tools):
    found = [groups_of(t, tools) for t in texts]
    links = [[(x, y) for a, b in g or [] for x in a for y in b] for g in found]
    counts = Counter(pair for own in links for pair in set(own))
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    for g, own in zip(found, links, strict=True):
        if g is None:
            yield (0, 0, 0, 0, 0, 0, "")
            continue
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        yield (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(own), sum(counts[p] == most[p[0]] for p in own), sum(counts[p] for p in own), hashlib.sha256(said.encode()).hexdigest())


def odd_texts(n):
    rng = random.Random(13)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "漢", "😀", "'s", "1", "23", "<s>", "<|endoftext|>", "</s>", "▁", "　", "ﬁ", "́", "​", "\x00", "\x1c", ".", "zz"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(n)] + [None, "", " ", "x" * 5000, "漢" * 3000, "<unk>", "a▁b c d", "the same", "the same"]


def test_equals_plain_alignment(spark, sf, tools, monkeypatch):
    texts = odd_texts(300) + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(80).collect()]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, pairs string, BATCH int").repartition(5)
    monkeypatch.setattr(alignment, "BATCH_BYTES", 20_000)
    got, counts = alignment.aligned(docs)
    found = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in got.collect()}
    assert [found[k] for k in range(len(texts))] == list(plain(texts, tools)) and len(found) == len(texts)
    assert counts.groupBy("a").agg({"docs": "max"}).count() == counts.where("best").select("a").distinct().count()


def test_wide_groups_count_every_link(tools, monkeypatch):
    texts = odd_texts(60)
    want = alignment.aligned_batch(tools[2], [t or "" for t in texts])
    monkeypatch.setattr(alignment, "WIDE", 0)
    got = alignment.aligned_batch(tools[2], [t or "" for t in texts])
    for batch in (want, got):
        a, b, times = batch["pair_a"][batch["places"]], batch["pair_b"][batch["places"]], batch["times"]
        batch["sum"] = sorted(zip(a.tolist(), b.tolist(), times.tolist(), strict=True))
    assert got["sum"] == want["sum"] and (got["pair_docs"] == want["pair_docs"]).all()


@pytest.mark.parametrize("seed", range(30))
def test_divided_finds_every_common_end(seed):
    rng = np.random.default_rng(seed)
    sizes, a, b, a_stop, b_stop = rng.integers(1, 60, rng.integers(1, 8)), [], [], [], []
    start = 0
    for n in sizes.tolist():
        inner = np.arange(start + 1, start + n)
        for side, stop in ((a, a_stop), (b, b_stop)):
            side += [*inner[rng.random(n - 1) < rng.random()].tolist(), start + n]
            stop.append(len(side))
        start += n
    a, b = np.array(a), np.array(b)
    at, other = alignment.divided(a, b, np.array(a_stop), np.array(b_stop))
    assert a[at].tolist() == np.intersect1d(a, b).tolist() == b[other].tolist()


def test_rows_without_tokens(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "▁")], "doc_id long, text string")
    assert sorted(map(str, alignment.aligned(docs)[0].collect())) == sorted(map(str, spark.createDataFrame([(k, 0, 0, 0, 0, 0, 0, "") for k in (None, 1, 1, 2)], ["doc_id", *NAMES]).collect()))
    assert alignment.aligned(docs.limit(0))[0].count() == 0
