"""Operator 13: alignment of two tokenizers' tokens, and how often their ids are linked.

Two vocabularies cut the same bytes into tokens. An interval of bytes whose ends both share
is divided at a common end near its middle, found by bisecting in the one's ends and the
other's in turn, first to the right of the middle and then to the left; both halves are divided
likewise, and an interval without a common end inside is a leaf group. All intervals of a batch of
texts are divided at once, a level after the other, as numpy arrays. Every token of the one in
a group is linked with every token of the other.

Both vocabularies begin a token at a space between two characters that are no white space, so texts are
cut there first, and a batch aligns each of its different chunks once.

Links are counted over the corpus by pairs of ids. A batch of texts is a row with a
dictionary of its pairs. Dictionaries are summed before and after a shuffle; the
counts go back to each dictionary by a join on the pair, in which a pair that every text
has is a row for each batch, not for each text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import LONGEST, Memory, chunks
from tessera.llm.libraries import ByteLevelChunks, pieces_model
from tessera.llm.token_files import spread
from tessera.llm.words import chunked, released, utf8
from tessera.plans.staging import staged

#: Bytes of text in a batch (a longer text is one of its own).
BATCH_BYTES = 3 << 20
#: Chunks in each of the two generations of what a task remembers: some 50 MB in all.
REMEMBERED = 120_000
#: Links of one group from which its repeated ids are counted before they are linked.
WIDE = 1 << 16


def divided(a: np.ndarray, b: np.ndarray, a_stop: np.ndarray, b_stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places, rising, of the last tokens of the leaf groups in ``a`` and in ``b``.

    ``a`` and ``b`` are rising byte ends of two vocabularies' tokens; ``a_stop`` and ``b_stop``
    are the places after intervals whose ends both share, one interval after the other."""
    open_ = [np.concatenate(([0], a_stop[:-1])), a_stop, np.concatenate(([0], b_stop[:-1])), b_stop]
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    while len(open_[0]):
        a0, a1, b0, b1 = open_
        whole = (a1 - a0 == 1) | (b1 - b0 == 1)
        leaves.append((a1[whole] - 1, b1[whole] - 1))
        a0, a1, b0, b1 = (x[~whole] for x in open_)
        start = np.where(a0 > 0, a[a0 - 1], 0)
        middle = (start + a[a1 - 1]) // 2
        at, other, found = np.zeros(len(a0), np.int64), np.zeros(len(a0), np.int64), np.zeros(len(a0), bool)
        from_right = np.zeros(len(a0), bool)
        # to the right: an end of a, the first end of b not before it, the first end of a not before that ...
        go = np.arange(len(a0))
        i = np.maximum(np.searchsorted(a, middle), a0)
        while True:
            inside = i < a1[go] - 1
            go, i = go[inside], i[inside]
            if not len(go):
                break
            j = np.searchsorted(b, a[i])
            hit = b[j] == a[i]
            at[go[hit]], other[go[hit]], found[go[hit]] = i[hit], j[hit], True
            go, i = go[~hit], np.searchsorted(a, b[j[~hit]])
        from_right[:] = found
        # to the left, where there was none
        go = np.flatnonzero(~found)
        i = np.searchsorted(a, middle[go]) - 1
        while True:
            inside = i >= a0[go]
            go, i = go[inside], i[inside]
            if not len(go):
                break
            j = np.searchsorted(b, a[i])
            hit = b[j] == a[i]
            at[go[hit]], other[go[hit]], found[go[hit]] = i[hit], j[hit], True
            go, j = go[~hit], j[~hit] - 1
            back = j >= b0[go]
            go, j = go[back], j[back]
            i = np.searchsorted(a, b[j], "right") - 1
        leaves.append((a1[~found] - 1, b1[~found] - 1))
        # what is right of a cut from the left has no further one
        left = found & ~from_right
        leaves.append((a1[left] - 1, b1[left] - 1))
        low, high = found, from_right
        open_ = [np.concatenate(x) for x in ((a0[low], at[high] + 1), (at[low] + 1, a1[high]), (b0[low], other[high] + 1), (other[low] + 1, b1[high]))]
    ends = np.sort(np.concatenate([x for x, _ in leaves])) if leaves else np.empty(0, np.int64)
    return ends, np.searchsorted(b, a[ends])


class Vocabularies:
    """The two libraries on chunks; ids of recent chunks are remembered."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevelChunks(a_path, plain=True), pieces_model(b_path)
        n = self.b.get_piece_size()
        self.pieces = [bytes([int(self.b.id_to_piece(k)[3:5], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace("▁", " ").encode() for k in range(n)]
        self.tables = [(np.frombuffer(b"".join(t), np.uint8), np.array([len(x) for x in t], np.int64)) for t in (self.a.bytes, self.pieces)]
        self.kind = "<u4"
        self.forget()

    def ids(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each string with a space before it: ids of both vocabularies, one string after the other, and how many each has."""
        known, fresh = self.memory.turn(), self.memory.missing(set(strings))
        a, na = self.a.encode(fresh)
        other = self.b.encode(fresh, num_threads=1)
        nb = np.fromiter(map(len, other), np.int64, len(other))
        b = np.fromiter(chain.from_iterable(other), np.int64, int(nb.sum()))
        # of each string the number of its ids of a, these, and those of b
        n = 1 + na + nb
        ends = np.cumsum(n)
        flat = np.empty(int(n.sum()), self.kind)
        flat[ends - n] = na
        flat[np.repeat(ends - n + 1 - np.cumsum(na) + na, na) + np.arange(len(a))] = a
        flat[np.repeat(ends - np.cumsum(nb), nb) + np.arange(len(b))] = b
        raw, cut, long_ = flat.tobytes(), (ends * flat.itemsize).tolist(), {}
        for c, lo, hi in zip(fresh, [0, *cut], cut, strict=False):
            (known if len(c) <= LONGEST else long_)[c] = raw[lo:hi]
        of = (known | long_ if long_ else known).__getitem__
        own = list(map(of, strings))
        n = np.fromiter(map(len, own), np.int64, len(own)) // flat.itemsize
        flat, starts = np.frombuffer(b"".join(own), self.kind).astype(np.int64), np.cumsum(n) - n
        na = flat[starts] if len(own) else np.empty(0, np.int64)
        nb = n - 1 - na
        first = np.repeat(starts + 1 - np.cumsum(na) + na, na) + np.arange(na.sum())
        second = np.repeat(starts + 1 + na - np.cumsum(nb) + nb, nb) + np.arange(nb.sum())
        return flat[first], na, flat[second], nb

    def same(self, k: int, ids: np.ndarray, many: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of each string whether the bytes of its ids are its own (``data``, ``sizes`` bytes each)."""
        table, lengths = self.tables[k]
        ends = np.concatenate(([0], np.cumsum(lengths[ids])))
        stops = np.cumsum(many)
        good = ends[stops] - ends[stops - many] == sizes
        token = good.repeat(many)
        own, want = table[spread(lengths, ids[token])], data[good.repeat(sizes)]
        owner = np.flatnonzero(good).repeat(sizes[good])
        good[owner[own != want]] = False
        return good

    def forget(self) -> None:
        self.memory = Memory(REMEMBERED)


_tools: dict[tuple[str, str], Vocabularies] = {}


def tool(a_path: str, b_path: str) -> Vocabularies:
    if (a_path, b_path) not in _tools:
        _tools[a_path, b_path] = Vocabularies(a_path, b_path)
    return _tools[a_path, b_path]


def _sums(values: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of values that end before the stops."""
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)))
    return np.diff(total[stops], prepend=0)


def _strings(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, groups: np.ndarray) -> list[str]:
    """Groups as text, joined for each chunk: places after the tokens of groups, and numbers of groups of chunks."""

    def join(strings: pa.Array, ends: np.ndarray, by: str) -> pa.Array:
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), strings)
        return pc.binary_join(lists, pa.scalar(by, strings.type))

    texts = [pa.array(ids).cast(pa.large_string()) for ids in (a, b)]
    both = pc.binary_join_element_wise(join(texts[0], a_ends, ","), join(texts[1], b_ends, ","), pa.scalar("|", pa.large_string()))
    return join(both, np.cumsum(groups), ";").to_pylist()


def _linked(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, ids of both and number of the links of each group: p and q tokens, one group after the other."""
    a_at, b_at, wide = np.cumsum(p) - p, np.cumsum(q) - q, p * q > WIDE
    narrow = np.flatnonzero(~wide)
    tokens = spread(p, narrow)  # of a
    of = narrow.repeat(p[narrow])
    partners = spread(q, of)
    out = [(owner[of].repeat(q[of]), a[tokens].repeat(q[of]), b[partners], np.ones(len(partners), np.int64))]
    for g in np.flatnonzero(wide).tolist():
        x, nx = np.unique(a[a_at[g] : a_at[g] + p[g]], return_counts=True)
        y, ny = np.unique(b[b_at[g] : b_at[g] + q[g]], return_counts=True)
        out.append((np.full(len(x) * len(y), owner[g]), x.repeat(len(y)), np.tile(y, len(x)), np.outer(nx, ny).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


_BATCH = "batch long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, starts binary, chunks binary, firsts binary, places binary, times binary, pairs array<struct<a: int, b: int, docs: long>>"


def aligned_batch(own: Vocabularies, texts: list[str]) -> dict:
    """What :data:`_BATCH` has of a batch of texts, but its number and doc_ids."""
    cut = [chunks(t) if t else [] for t in texts]
    strings = list(set(chain.from_iterable(cut)))
    a, na, b, nb, good, sizes = _read(own, strings)
    if not good.all():  # texts whose bytes don't come back chunk by chunk are looked at as a whole
        bad = {strings[k] for k in np.flatnonzero(~good).tolist()}
        cut = [[t] if not bad.isdisjoint(c) else c for t, c in zip(texts, cut, strict=True)]
        strings = list(set(chain.from_iterable(cut)))
        a, na, b, nb, good, sizes = _read(own, strings)
        bad = {strings[k] for k in np.flatnonzero(~good).tolist()}
        cut = [[] if not bad.isdisjoint(c) else c for c in cut]
        keep = good.repeat(na), good.repeat(nb)
        a, b, strings = a[keep[0]], b[keep[1]], [s for s, g in zip(strings, good.tolist(), strict=True) if g]
        na, nb, sizes = na[good], nb[good], sizes[good]
    place = dict(zip(strings, range(len(strings)), strict=True))
    starts = np.concatenate(([0], np.cumsum([len(c) for c in cut]))).astype(np.int64)
    flat = np.fromiter(map(place.__getitem__, chain.from_iterable(cut)), np.int64, int(starts[-1]))

    a_stop, b_stop = np.cumsum(na), np.cumsum(nb)
    a_ends, b_ends = (np.cumsum(own.tables[k][1][ids]) for k, ids in enumerate((a, b)))
    last_a, last_b = divided(a_ends, b_ends, a_stop, b_stop)
    chunk = np.searchsorted(a_stop, last_a, "right")
    p, q = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    groups = np.bincount(chunk, minlength=len(strings))
    group_stop = np.cumsum(groups)
    said = _strings(a, b, last_a + 1, last_b + 1, groups)

    owner, link_a, link_b, times = _linked(a, b, p, q, chunk)
    wide = len(own.pieces)
    codes, code = np.unique(link_a.astype(np.int64) * wide + link_b, return_inverse=True)
    keys, at = np.unique(owner * len(codes) + code, return_inverse=True)
    times = np.bincount(at, weights=times, minlength=len(keys)).astype(np.int64)
    firsts, places = np.searchsorted(keys, np.arange(len(strings) + 1) * len(codes)), keys % max(1, len(codes))
    # documents of this batch that hold a pair
    docs = np.repeat(np.arange(len(texts)), np.diff(starts))
    seen = np.unique(docs * max(1, len(strings)) + flat)
    doc, held = seen // max(1, len(strings)), seen % max(1, len(strings))
    many = np.diff(firsts)
    holds = np.unique(doc.repeat(many[held]) * max(1, len(codes)) + places[spread(many, held)])
    counts = np.bincount(holds % max(1, len(codes)), minlength=len(codes))

    def total(values: np.ndarray) -> np.ndarray:
        return _sums(values[flat], starts[1:])

    sha = [hashlib.sha256(";".join([said[k] for k in flat[lo:hi].tolist()]).encode()).hexdigest() if hi > lo else "" for lo, hi in zip(starts.tolist(), starts[1:].tolist(), strict=False)]
    return {
        "n_a": total(na), "n_b": total(nb), "n_groups": total(groups), "n_links": total(_sums(p * q, group_stop)), "sha": sha, "starts": starts, "chunks": flat,
        "firsts": firsts, "places": places, "times": times, "pair_a": (codes // wide).astype(np.int32), "pair_b": (codes % wide).astype(np.int32), "pair_docs": counts,
    }


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers, compressed, as narrow as the largest needs them; their width comes first."""
    wide = len(values) and int(values.max()) >= 1 << 31
    return (b"8" if wide else b"4") + zstandard.compress(values.astype("<i8" if wide else "<i4").tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw[1:]), f"<i{raw[:1].decode()}").astype(np.int64)


def _read(own: Vocabularies, strings: list[str]) -> tuple[np.ndarray, ...]:
    """Ids of both vocabularies, whether both give a string's own bytes, and the bytes' numbers."""
    a, na, b, nb = own.ids(strings)
    raw = [(" " + s).encode() for s in strings]
    data, sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
    return a, na, b, nb, own.same(0, a, na, data, sizes) & own.same(1, b, nb, data, sizes), sizes


def _batches(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = tool(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = utf8(batch.column("text"))
            for lo, hi, *_ in chunked(texts, BATCH_BYTES):
                found = aligned_batch(own, texts[lo:hi].to_pylist())
                one = lambda values, n=hi - lo: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values)
                raw = lambda name, found=found: pa.array([_packed(found[name])], pa.binary())
                pairs = pa.StructArray.from_arrays([pa.array(found["pair_a"]), pa.array(found["pair_b"]), pa.array(found["pair_docs"], pa.int64())], ["a", "b", "docs"])
                columns = [pa.array([number]), one(pa.concat_arrays([batch.column("doc_id")[lo:hi]])), *(one(pa.array(found[c], pa.int64())) for c in ("n_a", "n_b", "n_groups", "n_links")), one(pa.array(found["sha"], pa.string()))]
                columns += [*map(raw, ("starts", "chunks", "firsts", "places", "times")), one(pairs, len(pairs))]
                yield pa.RecordBatch.from_arrays(columns, [c.strip().split(" ")[0] for c in ("batch", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "sha", "starts", "chunks", "firsts", "places", "times", "pairs")])
                number += 1
        own.forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(run), _BATCH)


def aligned(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, text)`` -> ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256``, a row per row, and the counts ``a, b, docs, best`` of linked ids over all rows.

    A is a byte-level vocabulary of the tokenizers library, which gets a space and the text; B one of
    sentencepiece, which adds the space itself; strings of special tokens are plain text. Texts that
    are null or empty, or that the bytes of either's tokens don't give back, have no tokens: zeros
    and an empty digest. Null and repeated doc_ids and repeated rows stay, each row counts as a
    document; a very long text is a batch of its own; other columns are ignored; an empty table gives no rows."""
    a_path, b_path = byte_level or public_tokenizers.path("byte_bpe_50k.json"), pieces or public_tokenizers.path("piece_bpe_32k.model")
    batches = staged(_batches(docs, a_path, b_path), "aligned")
    pairs = batches.select("batch", F.posexplode("pairs").alias("at", "pair")).select("batch", "at", "pair.a", "pair.b", "pair.docs")
    counts = staged(pairs.groupBy("a", "b").agg(F.sum("docs").alias("docs")), "pair_counts")
    # a row for each id of the vocabulary at most
    best = F.broadcast(counts.groupBy("a").agg(F.max("docs").alias("most")))
    counts = counts.join(best, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))
    told = pairs.drop("docs").join(counts, ["a", "b"]).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("at", "docs", "best"))).alias("told"))
    told = told.select("batch", F.col("told.docs").alias("docs"), F.col("told.best").alias("best"))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for k in range(part.num_rows):
                values = lambda name: part.column(name)[k].values  # noqa: E731, B023
                starts, flat, firsts, places, times = (_unpacked(part.column(c)[k].as_py()) for c in ("starts", "chunks", "firsts", "places", "times"))
                docs_, best_ = (values(c).to_numpy(zero_copy_only=False).astype(np.int64) if values(c) is not None else np.empty(0, np.int64) for c in ("docs", "best"))
                sums = [_sums(_sums(times * v[places], firsts[1:])[flat], starts[1:]) for v in (best_, docs_)]
                yield pa.RecordBatch.from_arrays([values("doc_ids"), *map(values, ("n_a", "n_b", "n_groups", "n_links")), *map(pa.array, sums), values("sha")], names)

    rows = batches.drop("pairs").join(told, "batch", "left")
    return rows.mapInArrow(released(run), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"), counts


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of all documents' tokens, and how often their pairs occur in the corpus."""
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))[0]
