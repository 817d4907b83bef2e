"""Operator 12: token counts with a cache of digests.

A text's count depends on its content and on the tokenizer alone. So the cache is a table of
content digests and counts for each digest of a tokenizer (its file, library and
release). A table of documents is joined to it by the digest of its texts; only the
different texts that it lacks are encoded, one of each group of copies, and their counts are
appended to it for later tables.

Content is normalised as far as that changes no count: null is the empty text, and a text stands for
its UTF-8 bytes. Case, white space or Unicode forms can't be folded, as tokenizers see them.
Texts that have to be encoded are compressed by the task that reads them, and one of each digest
is kept before and after the shuffle, so a group of copies is a row for each task."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bitmaps import in_map, sized_map
from tessera.llm.bpe import LONGEST, Memory, chunks
from tessera.llm.libraries import ByteLevelChunks, byte_level, library_tokenizer, pieces_model
from tessera.llm.words import chunked, released, slices, utf8
from tessera.plans.staging import new_path, staged

#: Tokens above which a text is over the limit.
LIMIT = 512
#: Bytes of text that are encoded at a time (a longer text goes alone).
CHUNK_BYTES = 2 << 20


def tokenizer_digest(path: str) -> str:
    """Digest of what a tokenizer's counts depend on: its file, and its library's name and release."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as file:
        return hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + file.read()).hexdigest()


class CountCache:
    """Counts by tokenizer and content, in a folder that all executors reach.

    Each append is a folder of its own, so jobs may append at the same time. A row is right by
    itself: what a job left that failed can be used, and rows that two jobs appended are equal."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, tokenizer: str) -> str:
        return f"{self.path}/tokenizer={tokenizer}"

    def read(self, tokenizer: str) -> DataFrame | None:
        """``content binary, n_tokens`` of a tokenizer's digest; None where there is nothing yet."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._folder(tokenizer))
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.schema("content binary, n_tokens long").parquet(self._folder(tokenizer)).select("content", "n_tokens")

    def append(self, counts: DataFrame, tokenizer: str) -> DataFrame:
        """Write ``counts(content, n_tokens)``; what is returned is read from there."""
        path = f"{self._folder(tokenizer)}/batch={uuid.uuid4().hex}"
        counts.write.parquet(path)
        return self.spark.read.schema(counts.schema).parquet(path)


class WholeCounter:
    """Counts of whole texts by a library's function, which gives the ids of each."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode = encode

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.encode(texts)]

    def forget(self) -> None:
        pass


class ChunkCounter:
    """Counts of texts by a byte-level vocabulary, from the counts of their chunks; those of recent chunks are remembered."""

    def __init__(self, path: str):
        self.library, self.memory = ByteLevelChunks(path, plain=False), Memory()

    def counts(self, texts: list[str]) -> list[int]:
        cut = [chunks(t) for t in texts]
        known = self.memory.turn()
        fresh = self.memory.missing(set(chain.from_iterable(own[1:] for own in cut)))
        found = dict(zip(fresh, self.library.encode(fresh)[1].tolist(), strict=True))
        known.update((c, n) for c, n in found.items() if len(c) <= LONGEST)
        of = (known if all(len(c) <= LONGEST for c in fresh) else known | found).__getitem__
        return [len(self.library.encode_text(own[0])) + sum(map(of, own[1:])) for own in cut]

    def forget(self) -> None:
        self.memory = Memory()


_counters: dict[str, WholeCounter | ChunkCounter] = {}


def counter(path: str) -> WholeCounter | ChunkCounter:
    """The worker's counter of the tokens that the library for the file gives."""
    if path not in _counters:
        if path.endswith(".model"):
            model = pieces_model(path)
            _counters[path] = WholeCounter(lambda texts: model.encode(texts, num_threads=1))
        elif byte_level(path):
            _counters[path] = ChunkCounter(path)
        else:
            whole = library_tokenizer(path, plain=False)
            _counters[path] = WholeCounter(lambda texts: [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)])
    return _counters[path]


def _packed(texts: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """``content, text`` -> ``content, packed``: texts compressed, without those that the map of wanted ones excludes."""
    sent = None if wanted is None else texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, 1024):
            if sent is not None:
                batch = batch.filter(pa.array(in_map(sent.value, batch.column("key").to_numpy().view(np.uint64))))
            packed = [tool.compress(x) for x in utf8(batch.column("text")).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(packed, pa.binary())], ["content", "packed"])

    return texts.select("content", "text", F.xxhash64("content").alias("key")).mapInArrow(released(run), "content binary, packed binary")


def _encoded(packed: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, own = zstandard.ZstdDecompressor(), counter(path)
        for batch in slices(batches, 1024):
            texts = pa.array([tool.decompress(x) for x in batch.column("packed").to_pylist()], pa.large_binary()).cast(pa.large_string())
            for lo, hi, *_ in chunked(texts, CHUNK_BYTES):
                n = own.counts(texts[lo:hi].to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("content")[lo:hi], pa.array(n, pa.int64())], ["content", "n_tokens"])
        own.forget()

    return packed.mapInArrow(released(run), "content binary, n_tokens long")


def count_tokens(docs: DataFrame, cache: CountCache | None = None, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_bytes, n_tokens, over_limit``, a row per row.

    Counts are those of the tokenizer's library (``.json``: tokenizers, ``.model``: sentencepiece)
    without begin, end or added special tokens; strings of special tokens inside a text are what
    the library takes them for. A null text is the empty one, which has no tokens; null and repeated
    doc_ids and repeated rows stay as they are; other columns are ignored; an empty table gives no rows.
    Without a cache one is made in the shared folder for this call."""
    spark, path = docs.sparkSession, tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    cache, version = cache or CountCache(spark, new_path(spark, "token_counts")), tokenizer_digest(path)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    content = F.unhex(F.sha2(text, 256)).alias("content")
    keyed = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), content), "contents")
    texts, known, wanted = docs.select(content, text.alias("text")), cache.read(version), None
    if known is not None:
        known = keyed.select("content").distinct().join(known, "content", "left").groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
        known = staged(known, "known")
        missing = known.where("n_tokens is null").select("content")
        wanted = sized_map(missing.select(F.xxhash64("content").alias("key")))
    rows = _packed(texts, wanted).dropDuplicates(["content"])
    if known is not None:
        rows = rows.join(missing, "content", "left_semi")
    counts = cache.append(_encoded(rows, path), version)
    if known is not None:
        counts = staged(counts.union(known.where("n_tokens is not null")), "counts")
    return keyed.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, by a cache that is empty at first."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
