"""Operator 1: benchmark decontamination by rare seeds and local alignment.

Seeds are runs of ``SEED_WORDS`` words that a benchmark item and a document share. A run is rare
if at most ``RARE`` pairs of a document and an item hang on it; rare runs join documents to items.

A pair may share frequent runs only, of a phrase that everybody uses or of a passage with very many
copies. Joining by these would pair all that have the phrase, so such a pair is found by the
rarest words of its item. An alignment of M matches and E edits scores M - E, has E + 1
stretches of matches at most, and so shares r >= M - 2 (E + 1) runs. For a score of s of the
L words of an item that leaves M >= max(s L, 2 s L - r - 2): of any L - M + 1 places of the item one is
matched, so also of those with the rarest words. r is at most the number of frequent runs that
the item has and that the document has. So a document with one such run is joined to an item only by
one of its 4 rarest words (for s = 0.5), one with more runs by a few more: no pair is lost,
and a phrase alone joins nothing.

Each pair that shares a run is scored by a Smith-Waterman alignment of the item's words with the
document around the shared runs, unless too few of the item's words occur there for any
alignment; the score is the alignment's, as a share of the item's words, so edited copies
count as well as exact ones.

Tasks get bit maps of bounded size of what they look for; equi-joins settle what these let through."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.bitmaps import in_map, sized_map
from tessera.llm.words import CHUNK, PLACES, Words, chunked, lowered, mixed, released, signed, slices, split, unused
from tessera.plans.staging import staged

SEED_WORDS = 3
#: Pairs of a document and an item that may hang on a run that counts as rare.
RARE = 1000
#: Bytes of text that a stage looks at together, which takes some 100 times as much memory.
PIECE = 1 << 18
#: Least share of an item's words that the best alignment has to score.
SCORE = 0.5
MATCH, MISMATCH, GAP = 1, -1, -1


def runs_of(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and word position of the n-word runs of each text."""
    many = len(w.hash) - n + 1
    if many <= 0:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none
    row, code = w.row, np.zeros(many, np.uint64)
    for j in range(n):
        code += w.hash[j : j + many] * PLACES[j]
    at = np.flatnonzero(row[:many] == row[n - 1 :])
    return mixed(code[at] + np.uint64(n)), row[at], at - w.first[row[at]]


def _with_code(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("code"))


def _item_words(items: DataFrame) -> DataFrame:
    """``item_id, item_at, word, key``: each word of an item, and the run that starts there (null at the end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunked(lowered(batch.column("text"))):
                w = split(data, offsets, True)
                code, row, at = runs_of(w, SEED_WORDS)
                key, there = np.zeros(len(w.hash), np.uint64), np.zeros(len(w.hash), bool)
                key[w.first[row] + at], there[w.first[row] + at] = code, True
                ids = batch.column("item_id").slice(lo, hi - lo).take(pa.array(w.row))
                place = np.arange(len(w.hash)) - w.first[w.row]
                yield pa.RecordBatch.from_arrays([ids, pa.array(place.astype(np.int32)), pa.array(signed(w.hash)), pa.array(signed(key), mask=~there)], ["item_id", "item_at", "word", "key"])

    return items.mapInArrow(released(run), "item_id long, item_at int, word long, key long")


def _document_seeds(docs: DataFrame, runs: np.ndarray, words: np.ndarray, chunk: int) -> DataFrame:
    """``key, code, n``: each place of a document where an item's run may start (n is 1), and, without
    a code, how often each word that an item may have occurs in a part of the documents."""
    sent = docs.sparkSession.sparkContext.broadcast((runs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, words = sent.value
        for batch in batches:
            for lo, hi, data, offsets in chunked(lowered(batch.column("text")), chunk):
                w = split(data, offsets, True)
                code, row, _ = runs_of(w, SEED_WORDS)
                hit = in_map(runs, code)
                owner = batch.column("code").slice(lo, hi - lo).take(pa.array(row[hit]))
                known, n = np.unique(w.hash[in_map(words, w.hash)], return_counts=True)
                keys = pa.array(np.concatenate((signed(code[hit]), signed(known))))
                owner = pa.concat_arrays([owner, pa.nulls(len(known), pa.int64())])
                yield pa.RecordBatch.from_arrays([keys, owner, pa.array(np.concatenate((np.ones(int(hit.sum()), np.int64), n)))], ["key", "code", "n"])

    return docs.select("text", "code").mapInArrow(released(run), "key long, code long, n long")


def _document_words(docs: DataFrame, codes: np.ndarray, words: np.ndarray, chunk: int) -> DataFrame:
    """``code, word``: of documents that the one map lets through, the words that the other one does."""
    sent = docs.sparkSession.sparkContext.broadcast((codes, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, words = sent.value
        for batch in batches:
            batch = batch.filter(pa.array(in_map(codes, batch.column("code").to_numpy().view(np.uint64))))
            for lo, _, data, offsets in chunked(lowered(batch.column("text")), chunk):
                w = split(data, offsets, True)
                hit = np.flatnonzero(in_map(words, w.hash))
                row, word = w.row[hit], signed(w.hash)[hit]
                order = np.lexsort((word, row))
                row, word = row[order], word[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
                yield pa.RecordBatch.from_arrays([batch.column("code").take(pa.array(lo + row[new])), pa.array(word[new])], ["code", "word"])

    return docs.select("text", "code").mapInArrow(released(run), "code long, word long")


def _pairs(docs: DataFrame, items: DataFrame, least: float, chunk: int = CHUNK) -> DataFrame:
    """``code, item_id`` of the pairs that may align: all that share a rare run, and of those that
    share frequent runs only the ones that share enough for the score."""
    words = staged(_item_words(items), "item_words")
    grams = words.where("key is not null").select("item_id", "key")
    seeds = staged(_document_seeds(docs, sized_map(grams.select("key").distinct()), sized_map(words.select(F.col("word").alias("key")).distinct()), chunk), "document_seeds")
    hits = seeds.where("code is not null").select("key", "code")
    holders = grams.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("items"))
    keys = staged(hits.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).join(holders, "key").select("key", (F.col("docs") * F.col("items") > RARE).alias("frequent")), "keys")
    rare = grams.join(keys.where("not frequent").select("key"), "key")
    found = hits.join(rare, "key").select("code", "item_id").distinct()
    frequent = keys.where("frequent").select("key")
    shared = staged(grams.join(frequent, "key").groupBy("item_id").agg(F.count(F.lit(1)).alias("runs")), "shared")
    most = shared.agg(F.max("runs")).first()[0]
    if most is None:
        return staged(found, "pairs")
    # documents and items meet at the smallest power of 2 that is not below the document's runs
    tiers = range(int(most - 1).bit_length() + 1)
    tier = F.least(F.lit(tiers[-1]), F.ceil(F.log2("runs")).cast("int"))
    owners = staged(hits.join(frequent, "key").groupBy("code").agg(F.count(F.lit(1)).alias("runs")).select("code", tier.alias("tier")), "tiers")
    counts = seeds.where("code is null").groupBy("key").agg(F.sum("n").alias("n")).select(F.col("key").alias("word"), "n")
    own, order = Window.partitionBy("item_id"), Window.partitionBy("item_id").orderBy("n", "word", "item_at")
    ranked = words.join(shared, "item_id").join(counts, "word", "left").na.fill(0, ["n"])
    ranked = ranked.withColumns({"rank": F.row_number().over(order), "length": F.count(F.lit(1)).over(own)}).withColumn("tier", F.explode(F.array(*map(F.lit, tiers))))
    matched = lambda share: F.ceil(F.col("length") * share - 1e-9)
    needed = F.greatest(matched(least), matched(2 * least) - F.least(F.pow(F.lit(2), "tier"), "runs").cast("long") - 2)
    signs = staged(ranked.where(F.col("rank") <= F.col("length") - needed + 1).select("word", "tier", "item_id").distinct(), "signs")
    texts = _document_words(docs, sized_map(owners.select(F.col("code").alias("key"))), sized_map(signs.select(F.col("word").alias("key")).distinct()), chunk)
    others = texts.join(owners, "code").join(signs, ["word", "tier"]).select("code", "item_id")
    return staged(found.union(others).distinct(), "pairs")


def aligned(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and the word of the text after it."""
    best, end = 0, 0
    places = np.arange(len(text) + 1)
    above = np.zeros(len(text) + 1, np.int64)
    for word in item:
        now = np.maximum(above + GAP, 0)
        np.maximum(now[1:], above[:-1] + np.where(text == word, MATCH, MISMATCH), out=now[1:])
        now = np.maximum.accumulate(now - GAP * places) + GAP * places
        if (top := int(now.max())) > best:
            best, end = top, int(now.argmax())
        above = now
    return best, end


def windows(diagonals: list[int], length: int, words: int) -> list[tuple[int, int]]:
    """Stretches of a text of ``words`` words around seeds' diagonals, merged where they meet."""
    pad, out = max(4, length // 2), []
    for d in sorted(set(diagonals)):
        a, b = max(0, d - pad), min(words, d + length + pad)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _one(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Words and runs of one text."""
    data, offsets = next(iter(chunked(lowered(pa.array([text])))))[2:]
    w = split(data, offsets, True)
    return w.hash, runs_of(w, SEED_WORDS)[0]


def shared_diagonals(item: np.ndarray, text: np.ndarray) -> list[int]:
    """Places of shared runs in a text less those in the item; runs of both in their order."""
    order = np.argsort(text, kind="stable")
    first, last = (np.searchsorted(text, item, side, sorter=order) for side in ("left", "right"))
    many = last - first
    at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
    return np.unique(order[at] - np.repeat(np.arange(len(item)), many)).tolist()


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SCORE, chunk: int = CHUNK) -> DataFrame:
    """``docs(doc_id, text)``, ``benchmark(item_id, text)`` -> ``code, doc_id, item_id, score,
    first_word, end_word``, a row for each document row and item it holds.

    ``code`` tells rows of one doc_id by their text; the words are those of the best
    alignment's window and its end. Words are runs of letters and digits, lower case.
    Null and empty texts, and items or texts of fewer than ``SEED_WORDS`` words,
    match nothing; very long texts are aligned around their seeds; a text is in one task with the
    items that it may hold, as many as there are at most; a null doc_id is carried; items with a null item_id are skipped;
    equal document rows give equal rows; items of equal text all match. Empty tables
    give no rows; other columns are ignored."""
    docs = _with_code(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    pairs = _pairs(docs, items, least, chunk)
    wanted = docs.sparkSession.sparkContext.broadcast(sized_map(pairs.select(F.col("code").alias("key")).distinct()))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_map(wanted.value, batch.column("code").to_numpy().view(np.uint64))))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["code", "doc_id", "item_id", "score", "first_word", "end_word"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
        for batch in slices(batches):
            out = []
            for code, doc_id, text, found in zip(*(batch.column(c).to_pylist() for c in ("code", "doc_id", "text", "found")), strict=True):
                words, runs = _one(text)
                for x in found:
                    (item, own), best = _one(x["item"]), (0, 0, 0)
                    for a, b in windows(shared_diagonals(own, runs), len(item), len(words)):
                        if np.isin(item, words[a:b]).sum() * MATCH < least * MATCH * len(item):
                            continue  # no alignment has more matches
                        score, end = aligned(item, words[a:b])
                        best = max(best, (score, -a, a + end))
                    if best[0] >= least * MATCH * len(item):
                        out.append((code, doc_id, x["item_id"], best[0] / (MATCH * len(item)), -best[1], best[2]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 6, kinds, strict=True)], names)

    texts = docs.mapInArrow(released(pick), docs.schema)
    listed = pairs.join(items.withColumnRenamed("text", "item"), "item_id").groupBy("code").agg(F.collect_list(F.struct("item_id", "item")).alias("found"))
    return texts.join(listed, "code").mapInArrow(released(align), "code long, doc_id long, item_id long, score double, first_word int, end_word int")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SCORE) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    code = unused(docs.columns, "__decontam_code")
    bad = staged(contaminated(docs, benchmark, least, PIECE).select(F.col("code").alias(code)).distinct(), "contaminated")
    keyed = docs.withColumn(code, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return keyed.join(bad, code, "left_anti").drop(code)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with each item's best score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contaminated(docs, benchmark).drop("code")
