"""Operator 2: Brown class-based n-grams.

Every training word has a class, found by the exchange criterion: a word moves to the
class that raises the likelihood of the class bigrams most, and
P(word | word before) = P(class | class before) * P(word | class).

The exchange has two parts. The ``FREQUENT`` most frequent words, and ``SHAPES`` groups
of all other words by their last bytes, are exchanged one after the other over
their bigram counts until a sweep moves nothing (or ``SWEEPS`` are done); that is a
table of fixed size on the driver. Then each of the other words, however rare, is
exchanged by itself in one distributed sweep, as all words of a sweep may be at once
when they see the counts that it began with: Spark sums a word's counts of classes before
and after it over the corpus, and it takes the class of the largest gain, to first order
in the counts that one word moves.

Transitions are interpolated with the classes' frequencies; emissions are counts
less a discount, whose mass is the probability of an unseen word of the class. So
the probabilities of all words of the vocabulary and of an unseen word of each class
sum to 1 after any word. A text starts as after the end of another one. A word that no
training text has takes the class of its shape.

Words are counted and looked up by 64-bit hashes of their bytes. Texts are kept in
blocks, each with its own list of different words and the places of its texts' tokens in
that list; counts and classes of the corpus are joined to the lists. So no task or
driver holds the vocabulary, and texts are cut into words once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.words import Words, chunked, mixed, released, signed, split
from tessera.plans.staging import staged

FREQUENT, SHAPES, CLASSES, SWEEPS = 1024, 512, 64, 8
#: Share of the bigram estimate in a transition, and the discount of a word's count.
BIGRAM, DISCOUNT = 0.95, 0.75
#: Bytes of text in a block.
BLOCK_BYTES = 14 << 20
#: The hash that stands for the end of a text; its class is the last one.
END = np.uint64(0x5EED0E0D)
#: In a block, a word below this share of the tokens isn't proposed as a frequent one.
LEAST_SHARE = 1e-5


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 7; 0 for a null one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7, F.lit(0))


def shapes(w: Words) -> np.ndarray:
    """Shape type of each word: its last three bytes, hashed."""
    out = np.zeros(len(w.start), np.uint64)
    for back in range(1, 4):
        at = w.end - back
        out = out * np.uint64(257) + np.where(at >= w.start, w.data[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (mixed(out) % np.uint64(SHAPES)).astype(np.int64)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape of each token, ends included, and the first token of each text."""
    w = split(data, offsets, False)
    rows = len(offsets) - 1
    first = w.first + np.arange(rows + 1)
    code, shape = np.empty(len(w.hash) + rows, np.uint64), np.empty(len(w.hash) + rows, np.int64)
    ends = first[1:] - 1
    word = np.ones(len(code), bool)
    word[ends] = False
    code[word], shape[word] = w.hash, shapes(w)
    code[ends], shape[ends] = END, SHAPES
    return code, shape, first


class Block:
    """Texts as places of their tokens in a list of different words."""

    SCHEMA = "block long, doc_ids array<long>, held array<boolean>, sizes array<long>, places binary, words binary, shapes binary, counts binary"
    NAMES = ["block", "doc_ids", "held", "sizes", "places", "words", "shapes", "counts"]

    def __init__(self, batch: pa.RecordBatch | pa.Table, row: int = 0):
        """From a row of some of the columns."""
        raw = {n: batch.column(n)[row] for n in batch.schema.names}
        of = lambda n, kind: np.frombuffer(raw[n].as_buffer(), kind)
        if "block" in raw:
            self.block = raw["block"].as_py()
        if "doc_ids" in raw:
            self.doc_ids = raw["doc_ids"].values
        if "sizes" in raw:
            self.held, self.sizes = np.asarray(raw["held"].values), raw["sizes"].values.to_numpy()
            self.first = np.concatenate(([0], np.cumsum(self.sizes)))
            self.places = of("places", "<u4")
        if "shapes" in raw:
            self.shapes = of("shapes", "<u2").astype(np.int64)
        if "counts" in raw:
            self.counts = of("counts", "<i8")
        self.words = of("words", "<u8")

    @property
    def train(self) -> np.ndarray:
        """Whether each token is of a training text."""
        return np.repeat(~self.held, self.sizes)

    def before(self, kind: np.ndarray, end: int) -> np.ndarray:
        """Of each token the kind of the one before it, an end where it is a text's first."""
        out = np.concatenate(([0], kind[:-1]))
        out[self.first[:-1]] = end
        return out


def _packed(number: int, parts: list) -> pa.RecordBatch:
    code, shape, sizes, ids, held = zip(*parts, strict=True)
    shape, sizes, held = np.concatenate(shape), np.concatenate(sizes), np.concatenate(held)
    parts.clear()
    words, at, place = np.unique(np.concatenate(code), return_index=True, return_inverse=True)
    order = np.argsort(-np.bincount(place, minlength=len(words)), kind="stable")  # small places for frequent words
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    place = rank[place]
    counts = np.bincount(place[np.repeat(~held, sizes)], minlength=len(words))
    row = [number, pa.concat_arrays(ids), pa.array(held), pa.array(sizes, pa.int64())]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
    columns = [pa.array([row[0]])] + [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x).cast(k) for x, k in zip(row[1:], kinds[1:], strict=True)]
    columns += [pa.array([x.tobytes()], pa.binary()) for x in (place.astype("<u4"), words[order].astype("<u8"), shape[at][order].astype("<u2"), counts.astype("<i8"))]
    return pa.RecordBatch.from_arrays(columns, Block.NAMES)


def blocks_of(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, held_out, text`` -> blocks of about ``block_bytes`` of text, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ids, held = batch.column("doc_id"), np.asarray(batch.column("held_out"))
            for lo, hi, data, offsets in chunked(batch.column("text")):
                code, shape, first = tokens(data, offsets)
                parts.append((code, shape.astype(np.uint16), np.diff(first), ids[lo:hi], held[lo:hi]))
                size += len(data)
                if size >= block_bytes:
                    yield _packed(number, parts)
                    number, parts, size = number + 1, [], 0
        if parts:
            yield _packed(number, parts)

    return docs.select("doc_id", "held_out", "text").mapInArrow(released(run), Block.SCHEMA)


def _each_block(blocks: DataFrame, of, needs: str, schema: str, columns: list[str]) -> DataFrame:
    """``of`` a block its columns, as rows; it ``needs`` some of the block's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in of(Block(batch, k))], columns)

    return blocks.select(*needs.split()).mapInArrow(released(run), schema)


def type_of(code: np.ndarray, shape: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Types: 0.. the frequent words (sorted by hash), then shapes, then the end."""
    if not len(frequent):
        return shape.astype(np.int64)
    at = np.minimum(np.searchsorted(frequent, code), len(frequent) - 1)
    return np.where(frequent[at] == code, at, shape + len(frequent))


def _frequent(blocks: DataFrame) -> np.ndarray:
    def some(b: Block) -> tuple:
        keep = (b.counts >= max(1, LEAST_SHARE * b.counts.sum())) & (b.words != END)
        return signed(b.words[keep]), b.counts[keep]

    top = _each_block(blocks, some, "words counts", "word long, n long", ["word", "n"]).groupBy("word").agg(F.sum("n").alias("n"))
    rows = top.orderBy(F.desc("n"), "word").select("word").limit(FREQUENT).collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def _table(pairs: DataFrame, size: int) -> np.ndarray:
    """``a, b, n`` summed into a square table of fixed size."""
    out, found = np.zeros((size, size)), pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    out[found["a"].to_numpy(), found["b"].to_numpy()] = found["n"].to_numpy()
    return out


def _pair_rows(counts: np.ndarray, size: int) -> pa.RecordBatch:
    some = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array((some // size).astype(np.int32)), pa.array((some % size).astype(np.int32)), pa.array(counts[some])], ["a", "b", "n"])


def _type_pairs(blocks: DataFrame, frequent: np.ndarray) -> np.ndarray:
    """How often a training token of type b follows one of type a."""
    types = len(frequent) + SHAPES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(types * types, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                b = Block(batch, k)
                kind = type_of(b.words, b.shapes, frequent)[b.places]
                pair = (b.before(kind, types - 1) * types + kind)[b.train]
                counts += np.bincount(pair, minlength=types * types)
        yield _pair_rows(counts, types)

    return _table(blocks.select("held", "sizes", "places", "words", "shapes").mapInArrow(released(run), "a int, b int, n long"), types)


def exchange(counts: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Class of each type by the exchange algorithm on its bigram counts. The end, the
    last type, has the last class for itself."""
    types = len(counts)
    total = counts.sum(axis=0) + counts.sum(axis=1)
    free = max(1, classes - 1)
    out = np.empty(types, np.int64)
    out[np.argsort(-total[:-1], kind="stable")] = np.arange(types - 1) % free
    out[-1] = classes - 1
    hot = np.zeros((types, classes))
    hot[np.arange(types), out] = 1
    to, from_ = counts @ hot, counts.T @ hot  # of a type, the classes after and before it
    table = hot.T @ to

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    for _ in range(sweeps):
        moved = 0
        for t in np.argsort(-total[:-1], kind="stable").tolist():
            if not total[t]:
                continue
            old, self_ = out[t], counts[t, t]
            row, col = to[t].copy(), from_[t].copy()
            row[old] -= self_
            col[old] -= self_
            # without t: its row and column leave the old class
            table[old] -= row
            table[:, old] -= col
            table[old, old] -= self_
            sums_a, sums_b = table.sum(axis=1), table.sum(axis=0)
            gain = f(table + row[None, :]).sum(axis=1) - f(table).sum(axis=1) + (f(table + col[:, None]) - f(table)).sum(axis=0)
            corner = np.diag(table)
            gain += f(corner + row + col + self_) - f(corner + row) - f(corner + col) + f(corner)
            n_row, n_col = row.sum() + self_, col.sum() + self_
            gain -= f(sums_a + n_row) - f(sums_a) + f(sums_b + n_col) - f(sums_b)
            gain[-1] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            table[new] += row
            table[:, new] += col
            table[new, new] += self_
            if new != old:
                moved += 1
                out[t] = new
                to[:, old] -= counts[:, t]
                to[:, new] += counts[:, t]
                from_[:, old] -= counts[t]
                from_[:, new] += counts[t]
        if not moved:
            break
    return out


def gains(before: np.ndarray, after: np.ndarray, table: np.ndarray) -> np.ndarray:
    """What the likelihood of the class bigrams gains, to first order, by a word in each
    class: a row per word, from its counts of classes before and after it."""
    classes = len(table)
    smooth = table + 0.5
    into = np.log(smooth / smooth.sum(axis=0))  # [class before, own class]
    out_of = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T  # [class after, own class]
    value = before @ into + after @ out_of
    value[:, classes - 1] = -np.inf  # the end's
    return value


#: Values of a byte that names the side and the class of a neighbour.
_SIDES = 2 * CLASSES


def _neighbours(blocks: DataFrame, frequent: np.ndarray, class_of: np.ndarray) -> DataFrame:
    """``word, n, near``: of each training word of a block its count and, unless it is a
    frequent one or the end, pairs of bytes: side and class of neighbours, and their number."""

    def of(b: Block) -> tuple:
        kind = type_of(b.words, b.shapes, frequent)
        own = class_of[kind].astype(np.int32)
        fixed = (kind < len(frequent)) | (b.words == END)
        at = b.places.astype(np.int32 if len(b.words) < 1 << 24 else np.int64)
        cls = own[at]
        free = b.train & ~fixed[at]
        left, right = b.before(cls, CLASSES - 1), np.concatenate((cls[1:], [0]))
        key = np.concatenate(((at * _SIDES + left)[free], (at * _SIDES + CLASSES + right)[free]))
        key, n = np.unique(key, return_counts=True)
        times = (n + 254) // 255
        key, n = np.repeat(key, times), np.repeat(n, times)
        n = np.where(np.concatenate((key[1:] == key[:-1], [False])), 255, n - 255 * (np.repeat(times, times) - 1))
        entries = np.stack((key % _SIDES, n), axis=1).astype(np.uint8)
        some = np.flatnonzero(b.counts)
        ends = np.searchsorted(key, (some + 1) * _SIDES)
        starts = np.searchsorted(key, some * _SIDES)
        # the words in between have no entries, so the entries of ``some`` follow each other
        offsets = 2 * np.concatenate((starts[:1], ends))
        near = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(entries.tobytes())])
        return signed(np.ascontiguousarray(b.words[some])), b.counts[some], near

    return _each_block(blocks, of, "held sizes places words shapes counts", "word long, n long, near binary", ["word", "n", "near"])


def _classes(near: DataFrame, frequent: np.ndarray, class_of: np.ndarray, table: np.ndarray) -> DataFrame:
    """``word, n, near`` -> ``word, n, class``: each training word's count and class."""

    def settle(word: np.ndarray, n: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        code = word.view(np.uint64)
        value = gains(counts[:, :CLASSES], counts[:, CLASSES:], table).argmax(axis=1)
        kind = type_of(code, np.zeros(len(code), np.int64), frequent)
        value = np.where(kind < len(frequent), class_of[kind], value)
        value[code == END] = CLASSES - 1
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(n), pa.array(value.astype(np.int32))], ["word", "n", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, n, counts = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, _SIDES))
        for batch in batches:
            for lo in range(0, batch.num_rows, 10_000):
                part = batch.slice(lo, 10_000)
                near = pa.concat_arrays([part.column("near")])
                offsets = np.frombuffer(near.buffers()[1], np.int32)[: len(near) + 1]
                entries = np.frombuffer(near.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].reshape(-1, 2).astype(np.int64)
                own = np.concatenate((word, part.column("word").to_numpy()))
                group = np.cumsum(np.concatenate(([0], (own[1:] != own[:-1]).astype(np.int64))))
                row = np.repeat(group[len(word) :], np.diff(offsets) // 2)
                new = np.bincount(row * _SIDES + entries[:, 0], entries[:, 1], (group[-1] + 1) * _SIDES).astype(np.float64).reshape(-1, _SIDES)
                new[: len(word)] += counts
                total = np.bincount(group, np.concatenate((n, part.column("n").to_numpy()))).astype(np.int64)
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
                if len(own) > 1:  # the last word may go on in the next rows
                    yield settle(own[:-1], total[:-1], new[:-1])
                word, n, counts = own[-1:], total[-1:], new[-1:]
        if len(word):
            yield settle(word, n, counts)

    return near.repartition("word").sortWithinPartitions("word").mapInArrow(released(run), "word long, n long, class int")


def _classed(blocks: DataFrame, words: DataFrame, parts: int, frequent: np.ndarray, class_of: np.ndarray, n_tokens: int, n_words: int) -> DataFrame:
    """What each text's score needs: ``doc_id, held_out, n_tokens, n_known, base_score,
    seen, classes``; seen sums log10(count - DISCOUNT), and classes has a byte per token: the
    class, and 128 more if no training text has the word."""

    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "seen", "classes"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
        out = []
        for k in range(left.num_rows):
            b = Block(left.combine_chunks(), k)
            n, cls = np.zeros(len(b.words), np.int64), class_of[type_of(b.words, b.shapes, frequent)]
            at = right.column("at").to_numpy()
            told = right.column("told").to_numpy()
            n[at], cls[at] = told // CLASSES, told % CLASSES
            known = n > 0
            per_word = (known.astype(np.int64), np.log10((n + 1.0) / (n_tokens + n_words + 1)), np.where(known, np.log10(np.where(known, n - DISCOUNT, 1)), 0))
            sums = [np.add.reduceat(x[b.places], b.first[:-1]) for x in per_word]
            coded = (cls + np.where(known, 0, 128)).astype(np.uint8)[b.places]
            classes = pa.Array.from_buffers(pa.binary(), len(b.sizes), [None, pa.py_buffer(b.first.astype(np.int32)), pa.py_buffer(coded)])
            columns = [b.doc_ids, pa.array(b.held), pa.array(b.sizes), *map(pa.array, sums), classes]
            out.append(pa.Table.from_arrays([c.cast(t) for c, t in zip(columns, kinds, strict=True)], names))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in zip(names, kinds, strict=True)})

    listed = _each_block(blocks, lambda b: (np.full(len(b.words), b.block), np.arange(len(b.words), dtype=np.int32), signed(b.words)), "block words", "block long, at int, word long", ["block", "at", "word"])
    told = listed.join(words, "word").select("block", "at", (F.col("n") * CLASSES + F.col("class")).alias("told")).repartition(parts, "block")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, seen double, classes binary"
    return blocks.drop("counts").repartition(parts, "block").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(of, schema)


def _tokens_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Class bytes of the texts of a batch, and the first one of each text."""
    column = pa.concat_arrays([batch.column("classes")])
    offsets = np.frombuffer(column.buffers()[1], np.int32)[: len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _steps(coded: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each token its class pair, as one number."""
    own = (coded & 127).astype(np.int64)
    before = np.concatenate(([0], own[:-1]))
    before[first[:-1]] = CLASSES - 1
    return before * CLASSES + own


def _transitions(classed: DataFrame) -> np.ndarray:
    """How often a training token of class b follows one of class a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            if batch.num_rows:
                counts += np.bincount(_steps(*_tokens_of(batch)), minlength=CLASSES * CLASSES)
        yield _pair_rows(counts, CLASSES)

    return _table(classed.where("not held_out").select("classes").mapInArrow(released(run), "a int, b int, n long"), CLASSES)


def probabilities(table: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From class bigrams and the number of different words of each class: log10 of
    P(class | class before), of what divides a word's count, and of P(unseen word | class)."""
    words = table.sum(axis=0)
    share = (words + 0.5) / (words + 0.5).sum()
    after = table.sum(axis=1, keepdims=True)
    bigram = np.where(after > 0, table / np.maximum(after, 1), share[None, :])
    return np.log10(BIGRAM * bigram + (1 - BIGRAM) * share[None, :]), np.log10(words + 1), np.log10((DISCOUNT * kinds + 1) / (words + 1))


def score_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, perplexity``, a row per row; learned from the rows of :func:`fold` other than 2.

    A null text is empty, and so its end alone; a null doc_id trains; repeated rows
    count as often as they are there. With no training rows each word is unseen. No
    rows give no rows; other columns are ignored."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", fold(F.col("doc_id")) == 2)
    blocks = staged(blocks_of(rows, block_bytes), "blocks", compression="zstd")
    frequent = _frequent(blocks)
    counts = _type_pairs(blocks, frequent)
    class_of = exchange(counts, CLASSES, SWEEPS)
    hot = np.zeros((len(counts), CLASSES))
    hot[np.arange(len(counts)), class_of] = 1
    words = staged(_classes(_neighbours(blocks, frequent, class_of), frequent, class_of, hot.T @ counts @ hot), "words")
    kinds, n_tokens = np.zeros(CLASSES), 0
    for r in words.groupBy("class").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n")).collect():  # a row per class
        kinds[r["class"]] = r["kinds"]
        n_tokens += r["n"]
    classed = staged(_classed(blocks, words, max(1, blocks.count()), frequent, class_of, n_tokens, int(kinds.sum())), "classed")
    transition, divided, unseen = probabilities(_transitions(classed), kinds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emitted = np.concatenate((-divided, np.zeros(128 - CLASSES), unseen, np.zeros(128 - CLASSES)))
        for batch in batches:
            if not batch.num_rows:
                continue
            coded, first = _tokens_of(batch)
            sums = np.add.reduceat(transition.reshape(-1)[_steps(coded, first)] + emitted[coded], first[:-1])
            value = sums + batch.column("seen").to_numpy()
            columns = [batch.column(n) for n in ("doc_id", "held_out", "n_tokens", "n_known")]
            columns += [pa.array(np.full(len(value), n_tokens)), batch.column("base_score"), pa.array(value), pa.array(10 ** (-value / np.diff(first)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return classed.mapInArrow(released(score), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and class-model scores of every document."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
