"""Operator 7: language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from a generator seeded by its
code point; a run of characters that are no letters counts as one more letter. The
vector of a three-letter sequence binds those of its letters by multiplication,
the first rotated by two places and the second by one. A text's vector is the sum
over its sequences; a language's prototype is the sum over its training texts of
their vectors at unit length. A text is given the language whose prototype has
the largest cosine with the text's vector (ties: the first name)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.words import CHUNK, chunked, released, utf8

DIMENSIONS = 512
SEED = 70707
UNKNOWN = "und"
#: Largest number of counts in one dense block, and of letters with a table of sequences.
CELLS, TABLED = 1_000_000, 100


class Sequences:
    """Counts of three-letter sequences and their vectors; one for each worker."""

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        #: Of each code point the number of its letter; 0: no letter, -1: not seen yet.
        self.letter = np.full(0x110000, -1, np.int32)
        self.vectors = [self._random(0)]
        self.rotated: tuple[np.ndarray, ...] = ()
        self.place = np.full(TABLED**3, -1, np.int32)
        self.keys: list[np.ndarray] = []
        self.n_keys = 0

    def _random(self, code: int) -> np.ndarray:
        return np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        found = self.letter[codes]
        if (found < 0).any():
            for c in np.unique(codes[found < 0]).tolist():
                low = chr(c).lower()[0] if chr(c).isalpha() else ""
                if not low or not unicodedata.category(low).startswith("L"):
                    self.letter[c] = 0
                    continue
                if self.letter[ord(low)] < 0:
                    self.letter[ord(low)] = len(self.vectors)
                    self.vectors.append(self._random(ord(low)))
                self.letter[c] = self.letter[ord(low)]
            found = self.letter[codes]
        if not self.rotated or len(self.rotated[0]) != len(self.vectors):
            all_ = np.stack(self.vectors)
            self.rotated = (np.roll(all_, 2, axis=1), np.roll(all_, 1, axis=1), all_)
        return found

    def blocks(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, vectors of the rows, which have letters) of the texts."""
        text = data.tobytes()
        parts = [text[a:b].decode() for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
        codes = np.frombuffer(" ".join(["", *parts, ""]).encode("utf-32-le"), np.uint32)
        found = self._letters(codes)
        row = np.zeros(len(codes), np.int32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes + 1)
        row[ends[:-1]] = 1
        row = np.cumsum(row)  # the blank before a text belongs to it
        keep = np.ones(len(codes), bool)
        keep[1:] = (found[1:] > 0) | (found[:-1] > 0)
        keep[np.concatenate(([0], ends))] = True  # each text has its own blank, whatever the one before ends with
        found, row = found[keep].astype(np.int64), row[keep]
        whole = (row[2:] == row[:-2]) & (found[1:-1] > 0)
        # a text's last letter is followed by the blank of the next text
        last = (row[2:] == row[:-2] + 1) & (row[1:-1] == row[:-2]) & (found[1:-1] > 0)
        at = np.flatnonzero(whole | last)
        a, b, c, row = found[at], found[at + 1], found[at + 2], row[at]
        letters = np.bincount(row, minlength=len(parts)) > 0
        n = len(self.vectors)
        if n <= TABLED:
            key = (a * TABLED + b) * TABLED + c
            place = self.place[key]
            if (place < 0).any():
                new = np.unique(key[place < 0])
                self.place[new] = self.n_keys + np.arange(len(new))
                self.n_keys += len(new)
                self.keys.append(new)
                place = self.place[key]
            keys, base = np.concatenate(self.keys) if self.keys else np.empty(0, np.int64), TABLED
        else:
            keys, place = np.unique((a * n + b) * n + c, return_inverse=True)
            base = n
        if not len(keys):
            yield 0, len(parts), np.zeros((len(parts), self.dimensions), np.float32), letters
            return
        first = np.searchsorted(row, np.arange(len(parts) + 1))
        lo, most = 0, max(1, CELLS // len(keys))
        vectors = None
        while lo < len(parts):
            hi = min(len(parts), lo + most)
            own = slice(first[lo], first[hi])
            used, where = keys, place[own]
            if len(keys) > CELLS:
                ids, where = np.unique(where, return_inverse=True)
                used, vectors = keys[ids], None
            if vectors is None:
                vectors = np.empty((len(used), self.dimensions), np.float32)
                for k in range(0, len(used), 4096):
                    part = used[k : k + 4096]
                    vectors[k : k + 4096] = self.rotated[0][part // base // base] * self.rotated[1][part // base % base] * self.rotated[2][part % base]
            counts = np.bincount((row[own] - lo) * len(used) + where, minlength=(hi - lo) * len(used)).reshape(hi - lo, -1)
            yield lo, hi, counts.astype(np.float32) @ vectors, letters[lo:hi]
            lo = hi


_tools: dict[tuple[int, int], Sequences] = {}


def sequences(dimensions: int, seed: int) -> Sequences:
    if (dimensions, seed) not in _tools:
        _tools[dimensions, seed] = Sequences(dimensions, seed)
    return _tools[dimensions, seed]


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def learn(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED, chunk: int = CHUNK) -> tuple[list[str], np.ndarray]:
    """Prototypes from ``docs(text, lang)``: the names, sorted, and a unit row each.

    Rows without a text, a letter or a lang teach nothing. Each task sums its
    rows, so ``dimensions`` numbers for each language and task are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, sums = sequences(dimensions, seed), {}
        for batch in batches:
            langs = np.asarray(batch.column("lang").to_pylist(), object)
            for lo, _, data, offsets in chunked(batch.column("text"), chunk):
                for a, b, x, letters in tool.blocks(data, offsets):
                    own, x = langs[lo + a : lo + b], _unit(x)
                    for lang in set(own[letters].tolist()):
                        sums[lang] = sums.get(lang, 0) + x[(own == lang) & letters].sum(axis=0)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(total)], ["lang", "k", "x"])

    rows = docs.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sums = rows.mapInArrow(released(run), "lang string, k int, x double").groupBy("lang", "k").agg(F.sum("x").alias("x"))
    found = sums.toPandas()  # a row for each language and dimension
    names = sorted(found["lang"].unique())
    table = np.zeros((len(names), dimensions))
    table[found["lang"].map(names.index).to_numpy(int), found["k"].to_numpy(int)] = found["x"]
    return names, _unit(table) if names else table


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray, seed: int = SEED) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, lang_pred, score``, a row per row.

    ``score`` is the cosine with the prototype, 0 if negative. ``und`` and 0 where
    the text is null, empty or without letters, or nothing was learned."""
    dimensions = prototypes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = sequences(dimensions, seed)
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, _, data, offsets in chunked(batch.column("text")):
                for a, b, x, letters in tool.blocks(data, offsets):
                    best, score = np.full(b - a, UNKNOWN, object), np.zeros(b - a)
                    if names:
                        cosine = _unit(x) @ prototypes.T
                        at = cosine.argmax(axis=1)
                        best = np.where(letters, np.asarray(names, object)[at], UNKNOWN)
                        score = np.where(letters, np.clip(cosine[np.arange(b - a), at], 0, 1), 0)
                    yield pa.RecordBatch.from_arrays([ids[lo + a : lo + b], pa.array(best.tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, lang_pred string, score double")


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 3; 0 for a null one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))


def identify(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang)`` -> ``doc_id, held_out, lang_pred, score``; learned
    from the rows of :func:`fold` 0 and 2."""
    names, prototypes = learn(docs.where(fold(F.col("doc_id")) != 1))
    return predict(docs, names, prototypes).select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))


#: A text whose best cosine is below this resembles no language. Unrelated vectors are some 0.04
#: apart from 0, so of texts with letters only odd ones go: of 61,282 in two test tables none, the
#: least score of a text (of ten characters) being 0.029.
LEAST_SCORE = 0.02
#: Bytes of text that a stage looks at together, which takes some 250 times as much memory.
PIECE = 1 << 18


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text has a language with a score of ``least`` or more.

    Rows pass or go with their own text, also where doc_ids repeat or are null. Where nothing
    was learned, each text with a letter passes."""
    names, prototypes = learn(docs.where(fold(F.col("doc_id")) != 1), chunk=PIECE)
    dimensions, schema = prototypes.shape[1], docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = sequences(dimensions, SEED)
        for batch in batches:
            for lo, hi, data, offsets in chunked(batch.column("text"), PIECE):
                for a, b, x, letters in tool.blocks(data, offsets):
                    good = letters & ((_unit(x) @ prototypes.T).max(axis=1) >= least) if names else letters
                    yield batch.slice(lo + a, b - a).filter(pa.array(good))

    return docs.mapInArrow(released(run), schema)
