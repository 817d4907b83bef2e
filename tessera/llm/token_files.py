"""Operator 9: token ids in bit-packed files.

A file holds the ids of consecutive documents. Every id takes the bits that the
largest id of the vocabulary needs. Ids are packed in blocks; the footer has the
offset of each block and the first id of each document, so that any range of ids
is read with one seek and unpacked by numpy. Layout, integers little-endian:

    payload   the packed blocks, one after the other
    footer    u64 offsets of the blocks and of their end
              u64 first id of each document, and the number of ids
              i64 doc_id of each document, then u8 "doc_id is null" flags
    tail      u64 blocks, u64 documents, u32 ids a block, u32 bits, 8 bytes "TBPACK01"

Executors write and read these files in a folder that all of them reach, by
pyarrow's file systems (a path, or a file:, s3:, gs: or hdfs: address). Each try
of a task writes a file of its own name; only the files that finished tasks
report belong to the result."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.words import chunked, released, utf8
from tessera.plans.staging import new_path

END_ID = 1
BLOCK = 1 << 15
#: Bytes of text that are encoded at a time (a longer text goes alone).
CHUNK_BYTES = 8 << 20
#: Words that a task remembers, and words in a call of the library.
REMEMBERED, GROUP = 250_000, 512
_MAGIC = b"TBPACK01"
_TAIL = struct.Struct("<QQII8s")


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids in ``bits`` bits each: of 64 ids at a time, ``bits`` words of 64 bits."""
    rows = -(-len(ids) // 64)
    wide = np.zeros((rows, 64), np.uint64)
    wide.reshape(-1)[: len(ids)] = ids
    wide, words = np.ascontiguousarray(wide.T), np.zeros((bits, rows), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        words[word] |= wide[k] << np.uint64(shift)
        if shift + bits > 64:
            words[word + 1] |= wide[k] >> np.uint64(64 - shift)
    return words.T.astype("<u8").tobytes()[: -(-len(ids) * bits // 8)]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    rows = -(-n // 64)
    words = np.ascontiguousarray(np.frombuffer(data.ljust(rows * bits * 8, b"\0"), "<u8").reshape(rows, bits).T.astype(np.uint64))
    wide = np.empty((64, rows), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        wide[k] = words[word] >> np.uint64(shift)
        if shift + bits > 64:
            wide[k] |= words[word + 1] << np.uint64(64 - shift)
    return (wide & np.uint64((1 << bits) - 1)).T.astype("<u4").reshape(-1)[:n]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class TokenWriter:
    """Writes one file; holds a block of ids and the documents' starts."""

    def __init__(self, path: str, bits: int, block: int = BLOCK):
        system, place = _open(path)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        self.file, self.bits, self.block = system.open_output_stream(place), bits, block
        self.offsets, self.starts, self.docs, self.nulls = [0], [0], [], []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, lengths: list[int]) -> None:
        """Documents, the ids of all of them, and how many each has."""
        self.docs += [x or 0 for x in doc_ids]
        self.nulls += [x is None for x in doc_ids]
        self.starts += (self.starts[-1] + np.cumsum(lengths)).tolist()
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= 8 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"an id needs more than {self.bits} bits")
        upto = len(ids) if last else len(ids) // self.block * self.block
        for at in range(0, upto, self.block):
            self.offsets.append(self.offsets[-1] + self.file.write(pack(ids[at : min(at + self.block, upto)], self.bits)))
        self.waiting, self.n_waiting = [ids[upto:]], len(ids) - upto

    def close(self) -> int:
        self._flush(True)
        for values, kind in ((self.offsets, "<u8"), (self.starts, "<u8"), (self.docs, "<i8"), (self.nulls, "u1")):
            self.file.write(np.asarray(values, kind).tobytes())
        self.file.write(_TAIL.pack(len(self.offsets) - 1, len(self.docs), self.block, self.bits, _MAGIC))
        self.file.close()
        return self.starts[-1]


class TokenReader:
    """Random access to the ids of one file."""

    def __init__(self, path: str):
        system, place = _open(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        blocks, docs, self.block, self.bits, magic = _TAIL.unpack(self.file.read_at(_TAIL.size, size - _TAIL.size))
        if magic != _MAGIC:
            raise ValueError(f"{path} is no token file")
        kinds = (("<u8", blocks + 1), ("<u8", docs + 1), ("<i8", docs), ("u1", docs))
        length = sum(np.dtype(k).itemsize * n for k, n in kinds)
        raw, at, parts = self.file.read_at(length, size - _TAIL.size - length), 0, []
        for kind, n in kinds:
            parts.append(np.frombuffer(raw, kind, n, at))
            at += parts[-1].nbytes
        self.offsets, self.starts, self.doc_ids, self.nulls = parts

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids of positions start..stop of the file, stop excluded."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block + 1
        base, out = int(self.offsets[first]), []
        raw = self.file.read_at(int(self.offsets[last]) - base, base)
        for b in range(first, last):
            n = min(self.block, int(self.starts[-1]) - b * self.block)
            out.append(unpack(raw[int(self.offsets[b]) - base : int(self.offsets[b + 1]) - base], n, self.bits))
        return np.concatenate(out)[start - first * self.block : stop - first * self.block]

    def close(self) -> None:
        self.file.close()


class WordEncoder:
    """The tokenizers library on the different words of many texts.

    Text is cut at ASCII white space, which the tokenizer drops; each piece's ids are
    those it has within the text. The tokenizer parts letters from marks, so a piece of
    letters and then marks is looked up as these two. Words go to the library many
    at a time; the last token of a word says that it ends there. Strings of special
    tokens are plain text. Words of the texts before are remembered, ``REMEMBERED`` at most
    beside those of the last texts."""

    MARKS = ".,;:!?)]}*&$%#@+=/|\\^~_-"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(self.vocabulary, bool)
        self.ends[[k for token, k in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.forget()

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _each(self, strings: list[str]) -> list[np.ndarray]:
        """The ids of each string, on its own."""
        return [np.concatenate([self._ids(x), np.empty(0, "<u4")]) for x in strings]

    def _letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of letters, one after the other, and how many each has."""
        flat, sizes = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        starts = [*range(0, len(words), GROUP), len(words)]
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words)
        for k, text in enumerate(pc.binary_join(lists, pa.scalar(" ", words.type)).to_pylist()):
            ids = self._ids(text)
            n = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(n) != starts[k + 1] - starts[k]:  # the normal form of a letter is not always one letter
                each = self._each(words[starts[k] : starts[k + 1]].to_pylist())
                ids, n = np.concatenate(each), np.array([len(x) for x in each], np.int64)
            flat.append(ids)
            sizes.append(n)
        return np.concatenate(flat), np.concatenate(sizes)

    def _strings(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of strings, few of them repeated, one after the other, and how many each has."""
        known = pc.index_in(strings, value_set=self.words)
        new = strings.filter(known.is_null())
        easy = pc.utf8_is_alpha(new)
        letters, odd = new.filter(easy), new.filter(pc.invert(easy))
        flat, sizes = self._letters(letters)
        each = self._each(odd.to_pylist())
        words = pa.concat_arrays([self.words, letters, odd])
        flat = np.concatenate([self.flat, flat, *each])
        sizes = np.concatenate([self.sizes, sizes, np.array([len(x) for x in each], np.int64)])
        at = np.empty(len(strings), np.int64)
        fresh = known.is_null().to_numpy(zero_copy_only=False)
        at[~fresh] = known.drop_null().to_numpy()
        easy = easy.to_numpy(zero_copy_only=False)
        rest = np.where(easy, np.cumsum(easy) - 1, len(letters) + np.cumsum(~easy) - 1)
        at[fresh] = len(self.words) + rest
        own_flat, own_sizes = flat[spread(sizes, at)], sizes[at]
        if len(words) <= REMEMBERED:
            self.words, self.flat, self.sizes = words, flat, sizes
        else:
            self.words, self.flat, self.sizes = strings, own_flat, own_sizes
        return own_flat, own_sizes

    def encode(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one after the other, and how many each has."""
        small = pc.ascii_lower(texts)
        if (np.frombuffer(texts.buffers()[2] or b"", np.uint8) == 0xCC).any():
            # a capital letter before a combining mark isn't always composed as the small one is
            small = pc.if_else(pc.match_substring_regex(texts, "[\u0300-\u033f]"), texts, small)
        split = pc.ascii_split_whitespace(small)
        pieces = split.flatten().dictionary_encode()
        heads = pc.utf8_rtrim(pieces.dictionary, self.MARKS)
        # marks alone, and letters with others among them, stay whole
        heads = pc.if_else(pc.utf8_is_alpha(heads), heads, pieces.dictionary)
        heads, tails = heads.dictionary_encode(), self._tails(pieces.dictionary, heads).dictionary_encode()
        flat, sizes = self._strings(pa.concat_arrays([heads.dictionary, tails.dictionary]))
        head, tail = heads.indices.to_numpy(), tails.indices.to_numpy() + len(heads.dictionary)
        # of each piece, its head and its tail; of each token of a text, its piece
        both = np.stack((head, tail), axis=1)
        at = both[pieces.indices.to_numpy()].reshape(-1)
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes[at])))
        cuts = ends[2 * (np.asarray(split.offsets) - split.offsets[0].as_py())]
        return flat[spread(sizes, at)], np.diff(cuts)

    @staticmethod
    def _tails(pieces: pa.Array, heads: pa.Array) -> pa.Array:
        """What follows the heads in the pieces."""
        ends = np.cumsum(np.asarray(pc.binary_length(pieces)))
        n = np.asarray(pc.binary_length(pieces)) - np.asarray(pc.binary_length(heads))
        data = np.frombuffer(pa.concat_arrays([pieces]).buffers()[2] or b"", np.uint8)
        offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
        at = np.repeat(ends - offsets[1:], n) + np.arange(offsets[-1])
        return pa.Array.from_buffers(pa.large_string(), len(pieces), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at])])

    def forget(self) -> None:
        self.words, self.flat, self.sizes = pa.array([], pa.large_string()), np.empty(0, "<u4"), np.empty(0, np.int64)


def spread(sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the items of lists ``at``, where lists of such sizes follow each other."""
    n = sizes[at]
    ends = np.cumsum(n)
    first = np.cumsum(sizes) - sizes
    return np.repeat(first[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> list[tuple[str, int, int]]:
    """Write the ids of ``docs(doc_id, text)`` in ascending doc_id order, ``end_id``
    after each text; returns (path, documents, ids) of each file, in order.

    A null text is empty; a null doc_id comes first; rows of one doc_id are ordered
    by text. An empty table gives no file. The list has an entry per task."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, writer = encoder(path), None
        number = TaskContext.get().partitionId()
        name = f"{folder}/tokens-{number:06d}-{uuid.uuid4().hex}.tbp"
        for batch in batches:
            texts, doc_ids = utf8(batch.column("text")), batch.column("doc_id").to_pylist()
            for lo, hi, *_ in chunked(texts, CHUNK_BYTES):
                ids, n = tool.encode(pa.concat_arrays([texts[lo:hi]]))
                writer = writer or TokenWriter(name, bits_for(tool.vocabulary))
                writer.add(doc_ids[lo:hi], np.insert(ids, np.cumsum(n), end_id), (n + 1).tolist())
        tool.forget()
        if writer:
            n = len(writer.docs)
            yield pa.RecordBatch.from_pydict({"part": [number], "path": [name], "docs": [n], "ids": [writer.close()]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    done = rows.mapInArrow(released(write), "part long, path string, docs long, ids long").collect()
    return [(r["path"], r["docs"], r["ids"]) for r in sorted(done, key=lambda r: r["part"])]


def read_token_files(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, as its file has it;
    start counts the ids in the files and documents before it."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    before = np.concatenate(([0], np.cumsum([n for *_, n in files])))
    listed = spark.createDataFrame([(p, int(b)) for (p, *_), b in zip(files, before, strict=False)], "path string, base long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                file = TokenReader(path)
                starts, lo, most = file.starts.astype(np.int64), 0, 1 << 20
                while lo < len(starts) - 1:
                    hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + most, "right")) - 1)
                    sums = []
                    if hi == lo + 1:
                        crc = 0
                        for at in range(int(starts[lo]), int(starts[hi]), most):
                            crc = zlib.crc32(file.ids(at, min(at + most, int(starts[hi]))).tobytes(), crc)
                        sums.append(crc)
                    else:
                        raw = file.ids(int(starts[lo]), int(starts[hi])).astype("<u4").tobytes()
                        cuts = ((starts[lo : hi + 1] - starts[lo]) * 4).tolist()
                        sums = [zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                    ids = pa.array(file.doc_ids[lo:hi], mask=file.nulls[lo:hi].astype(bool))
                    n = np.diff(starts[lo : hi + 1])
                    yield pa.RecordBatch.from_arrays([ids, pa.array(starts[lo:hi] + base), pa.array(n), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    lo = hi
                file.close()

    return listed.repartition(len(files)).mapInArrow(released(read), schema)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written in the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_token_files(spark, write_token_files(docs, new_path(spark, "tokens")))
