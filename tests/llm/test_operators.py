"""The ten operators against brute force, exact round trips and held-out labels."""

import base64
import hashlib
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import bpe, chat, decontam, near_dup, pii, token_files
from tessera.llm.registry import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, code long"
EDGE = [
    (1, None), (2, ""), (3, "   \n\t"), (4, "Hello, world! 12345 it's"), (5, "Hello, world! 12345 it's"), (6, "ÄÖ ß 日本語 😀 ́x İi"), (7, "a" * 3000),
    (8, "mail bob.x@ex-ample.co.uk and 10.0.0.255 or 256.1.1.1, +49 (30) 1234-5678, 4111 1111 1111 1111."), (9, "word " * 20000), (10, "\x00   nul </s>[INST] <|endoftext|>"), (None, "text without a number"), (12, "x"),
]
WORDS = [f"{a}{b}o" for a in ("ka", "lu", "mi", "ne", "pro", "sta", "vi", "zu") for b in ("ra", "te", "si", "no", "ful", "ga", "ber", "dan")]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def row(doc_id, text, lang="en", source="web"):
    return (doc_id, text, lang, source, len(text or ""), 0.5, "d", 7)


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("edge")
    spark.createDataFrame([row(i, t) for i, t in EDGE], DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def texts(spark, folder):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def result(spark, name, folder):
    return queries()[name](spark, folder).collect()


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables(spark, empty, name):
    assert len(result(spark, name, empty)) == (1 if name.startswith("op6") else 0)


@pytest.mark.parametrize("name", [n for n in sorted(queries()) if not n.startswith(("op1_", "op3_", "op6_", "op11_"))])
def test_edge_rows_keep_their_place(spark, edge, name):
    rows = result(spark, name, edge)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in EDGE)


@pytest.mark.parametrize("folder", ["sf", "edge"])
def test_byte_bpe_equals_the_library(spark, request, folder):
    folder = request.getfixturevalue(folder)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in texts(spark, folder):
        ids = library.encode_ordinary(t)
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:4]) for r in result(spark, "op5_byte_bpe", folder)) == sorted(want)


@pytest.mark.parametrize("folder", ["sf", "edge"])
def test_token_files_equal_the_library(spark, request, folder):
    folder = request.getfixturevalue(folder)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True  # strings of special tokens are plain text
    at, want = 0, {}
    for i, t in sorted(((i, t) for i, t in texts(spark, folder) if i is not None)):
        ids = library.encode(t, add_special_tokens=False).ids + [1]
        want[i] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    rows = sorted(result(spark, "op9_token_files", folder), key=lambda r: r["start"])
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
        if r["doc_id"] is not None:
            assert (r["n_tokens"], r["ids_crc32"]) == want[r["doc_id"]]
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert ids == sorted(ids) and set(ids) == set(want)


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31])
def test_bits_are_packed_and_unpacked(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001)
    packed = token_files.pack(ids, bits)
    assert len(packed) == -(-1001 * bits // 8) and token_files.unpack(packed, 1001, bits).tolist() == ids.tolist()


def plain_spans(text):
    found = [(0, m.start(), m.end()) for m in regex.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, m.start(), m.end()) for m in regex.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in regex.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            found.append((2, m.start(), m.end()))
    found += [(3, m.start(), m.end()) for m in regex.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


@pytest.mark.parametrize("folder", ["sf", "edge"])
def test_base_spans_equal_plain_patterns(spark, request, folder):
    folder = request.getfixturevalue(folder)
    names = ("email", "ip", "card", "phone")
    want = []
    for i, t in texts(spark, folder):
        spans = plain_spans(t)
        listed = ",".join(f"{names[k]}:{a}:{b}" for k, a, b in spans)
        counts = Counter(k for k, _, _ in spans)
        want.append((str(i), *(counts[k] for k in range(4)), hashlib.sha256(listed.encode()).hexdigest()))
    rows = result(spark, "op8_pii", folder)
    assert sorted((str(r[0]), *r[1:6]) for r in rows) == sorted(want)


def test_patterns_find_unseen_identifiers(spark):
    seeds = [row(i, f"{prose(i, 12)} contact me under user{i}@mail{i}.example for more {prose(i + 500, 12)}") for i in range(200)]
    unseen = [row(900 + i, f"{prose(i + 900, 12)} contact me under ZX{i}-99{i}7 for more {prose(i + 1900, 12)}") for i in range(8)]
    clean = [row(2000 + i, f"{prose(i + 4000, 40)} in 1{i}84 {prose(i + 5000, 20)}") for i in range(8)]
    rows = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(seeds + unseen + clean, DOCS)).collect()}
    assert all(len(rows[900 + i]["spans"]) == 1 for i in range(8))
    assert all(len(rows[2000 + i]["spans"]) == 0 for i in range(8))


def test_found_identifiers_induce_patterns_and_are_marked_elsewhere(spark):
    rows = [row(i, f"{prose(i, 12)} contact me under user{i}@mail{i}.example for more {prose(i + 500, 12)}") for i in range(60)]
    rows += [row(900 + i, f"{prose(i + 900, 12)} contact me under ZX{i}-99{i}7 for more {prose(i + 1900, 12)}") for i in range(8)]
    # the same ones in a second context, others in that context alone, and in a third one that only those share
    rows += [row(1000 + i, f"{prose(i + 1000, 12)} badge shown was ZX{i}-99{i}7 at noon {prose(i + 2900, 12)}") for i in range(8)]
    rows += [row(1100 + i, f"{prose(i + 1100, 12)} badge shown was QY{i}-55{i}3 at noon {prose(i + 3900, 12)}") for i in range(4)]
    rows += [row(1200 + i, f"{prose(i + 1200, 12)} parcel left for QY{i}-55{i}3 by hand {prose(i + 4900, 12)}") for i in range(4)]
    rows += [row(1300, f"{prose(1300, 12)} parcel left for WV8-1234 by hand {prose(5900, 12)}")]
    rows += [row(1400 + i, f"{prose(i + 1400, 12)} ZX{i}-99{i}7 {prose(i + 6900, 12)}") for i in range(8)]
    clean = [row(2000 + i, f"{prose(i + 4000, 40)} AB{i}-77{i}1 {prose(i + 5000, 20)}") for i in range(8)]
    frame = spark.createDataFrame(rows + clean, DOCS)
    got = {r["doc_id"]: len(r["spans"]) for r in pii.find_personal_data(frame).collect()}
    assert {i: n for i, n in got.items() if n != (i < 2000)} == {}
    masked = {r["doc_id"]: r["text"] for r in pii.mask(frame).collect()}
    assert {i for i, t in masked.items() if "[ID]" in t} == {r[0] for r in rows[60:]}


def test_masking_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([row(i, t) for i, t in EDGE], DOCS)
    out = pii.mask(docs)
    assert out.columns == docs.columns and out.count() == len(EDGE)
    assert "bob" not in out.where("doc_id = 8").first()["text"]


def test_near_duplicates_equal_brute_force(spark):
    rows, at = [], 0
    for k in range(25):
        base = prose(k, 60 + 10 * k).split()
        for edits in (0, 0, 1, 3, 12):
            words = list(base)
            for j in np.random.default_rng(at).choice(len(words), edits, replace=False):
                words[j] = "other"
            rows.append(row(at, " ".join(words)))
            at += 1
    rows += [row(9000, None), row(9001, ""), row(9002, "short one"), row(9003, "short one")]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == len(rows)
    sets = {r[0]: {tuple(r[1].split()[j : j + 5]) for j in range(len(r[1].split()) - 4)} for r in rows if r[1] and len(r[1].split()) >= 5}
    together = lost = 0
    for a, b in itertools.combinations(sets, 2):
        jaccard = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if jaccard >= 0.85:
            together += 1
            lost += got[a] != got[b]
    assert together > 100 and lost <= 0.03 * together
    for i in sets:
        assert got[i] == i or max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in sets if j != i) >= 0.7
    assert got[9002] == got[9003] == 9002
    kept = near_dup.keep_first(spark.createDataFrame(rows, DOCS))
    assert len(kept.columns) == 8 and {r["doc_id"] for r in kept.collect()} >= {v for k, v in got.items() if k < 9000}


def test_embedding_links_equal_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 64))
    x = np.repeat(base, 5, 0) + rng.normal(size=(300, 64)) * rng.choice([0.0, 0.15, 0.3, 0.5], (300, 1))
    x[299] = 0
    rows = [(i, [float(v) for v in x[i].astype(np.float32)], int(i // 100)) for i in range(300)]
    rows += [(300, None, 0), (301, [float("nan")] * 64, 0), (302, rows[0][1], None), (303, rows[0][1], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r for r in result(spark, "op3_embedding_dedup", str(tmp_path))}
    m = np.array([r[1] if r[1] and np.isfinite(r[1]).all() else [0] * 64 for r in rows], float)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    cosine = (m / np.where(n > 0, n, 1)) @ (m / np.where(n > 0, n, 1)).T
    label = [r[2] for r in rows]
    links = {i: [j for j in range(304) if j != i and label[i] is not None and label[i] == label[j] and cosine[i, j] >= 0.93] for i in range(304)}
    want = sum(map(len, links.values()))
    assert all(got[i]["n_links"] <= len(links[i]) for i in links)
    assert sum(got[i]["n_links"] for i in links) >= 0.97 * want > 0
    for i in (299, 300, 301, 302):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[303]["component_id"] == 0 and not got[303]["kept"]


def test_planted_items_are_found_and_clean_texts_left(spark):
    items = [(k, prose(7000 + k, 30)) for k in range(20)]
    docs = []
    for k, (_, text) in enumerate(items):
        words = text.split()
        words[7], words[19] = "changed", "edited"
        docs.append(row(k, f"{prose(100 + k, 80)} {text} {prose(200 + k, 50)}"))
        docs.append(row(100 + k, f"{prose(300 + k, 80)} {' '.join(words)} {prose(400 + k, 50)}"))
        docs.append(row(200 + k, prose(500 + k, 160)))
    docs += [row(300, None), row(301, "")]
    benchmark = spark.createDataFrame([*items, (50, None), (51, ""), (52, "two words")], "item_id long, text string")
    frame = spark.createDataFrame(docs, DOCS)
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame, benchmark).collect()}
    assert found == {(k + d, k) for k in range(20) for d in (0, 100)}
    assert {r["doc_id"] for r in decontam.drop_contaminated(frame, benchmark).collect()} == {200 + k for k in range(20)} | {300, 301}


def test_chat_digests(spark, sf):
    turns = [(r["conv_id"], r["turn"], r["role"], r["text"] or "") for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    turns += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in result(spark, "op6_chat_format", sf)}
    for conv, rows in itertools.groupby(sorted(turns, key=lambda t: t[:2]), key=lambda t: t[0]):
        rows = list(rows)
        said = "".join(t[3] for t in rows if t[2] == "assistant")
        whole = "".join(f"{t[2]}\n{t[3]}\n" for t in rows)
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"]) == (len(rows), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_each_assistant_turn_is_an_example(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b</s>"), (1, 2, "user", "c"), (1, 3, "assistant", "d")], "conv_id long, turn long, role string, text string")
    rows = chat.expanded(chat.format_conversations(turns)).orderBy("example").collect()
    assert len(rows) == 2 and rows[1]["text"].startswith(rows[0]["text"][: rows[0]["loss_end"]])
    assert [chat.unescaped(r["text"][r["loss_start"] : r["loss_end"]]) for r in rows] == ["b</s>", "d"]


def test_languages_of_held_out_documents(spark, sf):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in result(spark, "op7_language_id", sf) if r["held_out"] and truth[r["doc_id"]] is not None and r["lang_pred"] != "und"]
    assert len(rows) > 30 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) >= 0.95 * len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)


def test_base_scores_and_perplexity(spark, sf):
    docs = texts(spark, sf)
    split = {i: regex.findall(r"[^\x20\x09-\x0D]+", regex.sub("[A-Z]", lambda m: m[0].lower(), t)) + [None] for i, t in docs}
    train = Counter(w for i, _ in docs if zlib.crc32(str(i).encode()) % 7 != 2 for w in split[i])
    n, v = sum(train.values()), len(train)
    rows = result(spark, "op2_class_lm", sf)
    held = [0.0, 0.0]
    for r in rows:
        words = split[r["doc_id"]]
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words)
        assert r["train_tokens"] == n and r["n_tokens"] == len(words) and r["n_known"] == sum(train[w] > 0 for w in words)
        assert abs(r["base_score"] - base) <= 1e-9 * abs(base) and r["score"] < 0
        if r["held_out"]:
            held[0] += r["base_score"]
            held[1] += r["score"]
    assert held[1] > held[0]


def test_shards_hold_equal_counts_of_each_source(spark, sf):
    rows = result(spark, "op10_sharding", sf)
    whole = {r["doc_id"]: (r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    for r in rows:
        data = (whole[r["doc_id"]][0] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    per = Counter((r["shard"], whole[r["doc_id"]][1]) for r in rows)
    total = Counter(w[1] for w in whole.values())
    assert all(abs(per[s, source] - total[source] / 16) <= 2 for s in range(16) for source in total)


def test_pipeline_keeps_columns_and_clean_documents(spark, sf, edge):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    assert 100 < corpus_pipeline.run(spark, sf).count() < docs.count()
