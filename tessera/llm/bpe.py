"""Operator 5: byte-level BPE encoding and decoding.

A text is cut by the vocabulary's pattern; the bytes of each match are merged
until no neighbouring pair is in the vocabulary, always the leftmost pair of the
lowest rank. A segment tree over the byte positions holds, at the position where
its left part starts, the rank of each live pair; the root gives the leftmost
minimum. A merge changes two or three leaves, each by a walk to the root, so a
match of n bytes costs O(n log n) also where it is very long.

Matches repeat, so each task remembers the ids of recent ones. The trees of
all new matches of up to LONGEST bytes are built and updated together as numpy
arrays, one merge in each tree at a time; a longer match has a tree of its own."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.words import released, utf8

#: Strings in each of the two generations of what a task remembers, and the most bytes
#: of a match among them: some 50 MB in all. A task forgets them when it ends.
REMEMBERED, LONGEST = 120_000, 64
#: What the vocabulary's own engine takes for white space in the pattern.
WHITE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def compile_pattern(pattern: str) -> regex.Pattern:
    """The pattern with its white-space class spelled out, as engines differ there."""
    out, inside = [], False
    for part in regex.findall(r"\\.|.", pattern, flags=regex.S):
        if part == r"\s":
            out.append(WHITE if inside else f"[{WHITE}]")
        elif part == r"\S":
            out.append(f"[^{WHITE}]")
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return regex.compile("".join(out))


class Memory:
    """What was found for recent strings: two generations of a given size."""

    def __init__(self, most: int = REMEMBERED):
        self.most = most
        self.known: dict = {}
        self.older: dict = {}

    def turn(self) -> dict:
        """The generation to fill; the one before becomes the older one where it is full."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        return self.known

    def missing(self, keys: set) -> list:
        """Those of the keys that neither generation has; older ones become known."""
        fresh = keys.difference(self.known)
        again = fresh.intersection(self.older)
        self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
        return list(fresh.difference(again))


_ODD = re.compile(r"  |^ | $| [^\S ]|[^\S ] ")


def chunks(text: str) -> list[str]:
    """The text cut at each space between two characters that are no white space."""
    parts = text.split(" ")
    if not _ODD.search(text):
        return parts
    out, open_ = [], True
    for p in parts:
        odd = not p or p[0].isspace()
        if out and (odd or open_):
            out[-1] += " " + p
        else:
            out.append(p)
        open_ = not p or p[-1].isspace()
    return out


class BytePairEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, compile_pattern(pattern)
        self.none = max(ranks.values()) + 1  # above any rank: no pair starts here
        self.piece, self.chunk = Memory(), Memory()
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    pairs[a * (self.none + 1) + b] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, ``none`` where there is none."""
        key = a * (self.none + 1) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.none)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of matches of up to LONGEST bytes."""
        out = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        low = 0
        for size in (2, 4, 8, 16, 32, 64):
            own = np.flatnonzero((lengths > low) & (lengths <= size))
            low = size
            for lo in range(0, len(own), 1 << 13):
                part = own[lo : lo + (1 << 13)]
                for k, ids in zip(part.tolist(), self._merge_class([pieces[k] for k in part.tolist()], lengths[part], size), strict=True):
                    out[k] = ids
        return out

    def _merge_class(self, pieces: list[bytes], n: np.ndarray, size: int) -> Iterator[bytes]:
        """Matches whose trees have ``size`` leaves; leaf i: rank of the pair that starts at byte i.

        The tables are kept flat: tree t starts at ``2 * size * t``, its text at ``size * t``."""
        none, rows, places = self.none, len(pieces), np.arange(size)
        text = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(rows, size)
        token = self.single[text]
        live = places < n[:, None]
        after = np.tile(places + 1, rows)
        before = np.tile(np.arange(-1, size), rows)
        tree = np.full((rows, 2 * size), none, np.int32)
        tree[:, size : 2 * size - 1] = np.where(live[:, 1:], self._pair(token[:, :-1], token[:, 1:]), none)
        for k in range(size - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        tree, token, alive = tree.ravel(), token.ravel(), live.ravel()
        row, depth = np.arange(rows), size.bit_length() - 1
        while len(row):
            root = row * (2 * size)
            least = tree[root + 1]
            going = least < none
            if not going.all():
                row, root, least = row[going], root[going], least[going]
                if not len(row):
                    break
            k = np.ones(len(row), np.int64)
            for _ in range(depth):
                k += k
                k += tree[root + k] != least  # the left child where both have it
            i, base = k - size, row * size
            gone = after[base + i]
            end = after[base + gone]
            after[base + i] = end
            before[base + row + end] = i
            alive[base + gone] = False
            token[base + i] = least
            left, inside = before[base + row + i], end < n[row]
            right = np.where(inside, self._pair(least, token[base + np.minimum(end, size - 1)]), none)
            tree[root + size + gone] = none
            tree[root + k] = right
            has = left >= 0
            some, at = root[has], left[has]
            tree[some + size + at] = self._pair(token[base[has] + at], least[has])
            for own, k in ((root, gone + size), (root, k), (some, at + size)):
                for _ in range(depth):
                    k = k >> 1
                    child = own + k + k
                    tree[own + k] = np.minimum(tree[child], tree[child + 1])
        flat = token[alive].astype("<i4").tobytes()
        ends = (4 * live.sum(axis=1).cumsum()).tolist()
        return (flat[a:b] for a, b in zip([0, *ends], ends, strict=False))

    def merge(self, piece: bytes) -> bytes:
        """The ids of one match of any length."""
        ranks, none, n = self.ranks, self.none, len(piece)
        size = 1 << max(0, (n - 1).bit_length())
        tree = [none] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = ranks.get(piece[i : i + 2], none)
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a <= b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # live neighbours
        while (least := tree[1]) < none:
            k = 1
            while k < size:
                k *= 2
                if tree[k] != least:
                    k += 1
            i = k - size
            gone = after[i]
            end = after[i] = after[gone]
            if end < n:
                before[end] = i
            changes = [(gone, none), (i, ranks.get(piece[i : after[end]], none) if end < n else none)]
            if (left := before[i]) >= 0:
                changes.append((left, ranks.get(piece[left:end], none)))
            for at, rank in changes:
                k = size + at
                tree[k] = rank
                while k > 1:
                    k //= 2
                    a, b = tree[2 * k], tree[2 * k + 1]
                    value = a if a <= b else b
                    if tree[k] == value:
                        break
                    tree[k] = value
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return np.array(out, "<i4").tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit integers.

        A match ends before a space between two characters that are no white space, so
        texts are cut there first, and the ids of these chunks are remembered too."""
        cut = [chunks(t) for t in texts]
        known = self.chunk.turn()
        fresh = self.chunk.missing(set().union(*(own[1:] for own in cut)))
        found = self.encode_chunks([own[0] for own in cut] + [" " + c for c in fresh])
        long_ = {}
        for c, ids in zip(fresh, found[len(cut) :], strict=True):
            (known if len(c) <= LONGEST else long_)[c] = ids
        if long_:
            return [b"".join([head, *(known[c] if c in known else long_[c] for c in own[1:])]) for head, own in zip(found, cut, strict=False)]
        of = known.__getitem__
        return [b"".join([head, *map(of, own[1:])]) for head, own in zip(found, cut, strict=False)]

    def encode_chunks(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, by the pattern's matches."""
        found = list(map(self.pattern.findall, texts))
        known, new, long_ = self.piece.turn(), [], {}
        for piece in self.piece.missing(set().union(*found)):
            raw = piece.encode()
            if raw in self.ranks:  # a whole token is what its own merges end in
                known[piece] = np.array([self.ranks[raw]], "<i4").tobytes()
            elif len(raw) <= LONGEST:
                new.append((piece, raw))
            else:
                long_[piece] = self.merge(raw)
        if new:
            known.update(zip([p for p, _ in new], self.merge_all([raw for _, raw in new]), strict=True))
        if long_:
            return [b"".join([known[p] if p in known else long_[p] for p in own]) for own in found]
        of = known.__getitem__
        return [of(own[0]) if len(own) == 1 else b"".join(map(of, own)) for own in found]

    def forget(self) -> None:
        self.piece, self.chunk = Memory(), Memory()


class BytePairDecoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.decimal = {v: str(v) for v in ranks.values()}

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_encoders: dict[tuple[str, str], BytePairEncoder] = {}


def encoder(path: str, pattern: str) -> BytePairEncoder:
    """The worker's encoder."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = BytePairEncoder(load_ranks(path), pattern)
    return _encoders[path, pattern]


_decoders: dict[str, BytePairDecoder] = {}


def decoder(path: str) -> BytePairDecoder:
    if path not in _decoders:
        _decoders[path] = BytePairDecoder(load_ranks(path))
    return _decoders[path]


def _encoded(tool: BytePairEncoder, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, where each text's ids end) of slices of a column of texts."""
    texts = utf8(column)
    for lo in range(0, len(texts), 512):
        found = tool.encode_all(texts[lo : lo + 512].to_pylist())
        yield lo, lo + len(found), np.frombuffer(b"".join(found), "<i4"), np.cumsum([len(x) // 4 for x in found])


def _digests(tool: BytePairDecoder, flat: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    """Of lists of ids: their lengths, and digests of the ids and of what they decode to."""
    decimal, n, a, b, ends = tool.decimal.__getitem__, [], [], [], ends.tolist()
    for lo, hi in zip([0, *ends], ends, strict=False):
        ids = flat[lo:hi].tolist()
        n.append(len(ids))
        a.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
        b.append(hashlib.sha256(tool.decode(ids)).hexdigest())
    return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]


_DIGESTED = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
_DIGESTED_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_documents(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, ids array<int>``, a row per row.

    A null text is empty and gives no ids; nothing in a text is a special token;
    repeated rows and null doc_ids stay as they are; other columns are ignored."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, pattern)
        for batch in batches:
            for lo, hi, flat, ends in _encoded(tool, batch.column("text")):
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], ids], ["doc_id", "ids"])
        tool.forget()

    return _texts(docs).mapInArrow(released(run), "doc_id long, ids array<int>")


def digests(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids`` -> ``doc_id, n_tokens, ids_sha256, decoded_sha256``: the ids
    in decimal joined by a space, and the bytes that they decode to. Null ids are none."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = decoder(path)
        for batch in batches:
            column = batch.column("ids")
            columns = _digests(tool, column.flatten().to_numpy(), column.value_lengths().fill_null(0).to_numpy().cumsum())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], _DIGESTED)

    return encoded.mapInArrow(released(run), _DIGESTED_SCHEMA)


def round_trip(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``digests(encode_documents(docs))`` in one pass: a task has one Python worker, and the ids
    don't leave it."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, back = encoder(path, pattern), decoder(path)
        for batch in batches:
            for lo, hi, flat, ends in _encoded(tool, batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], *_digests(back, flat, ends)], _DIGESTED)
        tool.forget()

    return _texts(docs).mapInArrow(released(run), _DIGESTED_SCHEMA)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids, and of the bytes decoded from them, of every document."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
