"""Operator 4: near-duplicate documents by Order MinHash.

A document is the sequence of its five-word shingles, each labelled with its number
among equal ones. For each of ``SKETCHES`` hash functions the ``TAKEN`` labelled
shingles of the least hash are kept in text order and hashed to one value, so two
texts share a value if they hold the same shingles there in the same order.
Candidates share a value; they are verified by aligning the two sequences within
the band that the threshold leaves. The similarity is ``a / (m + n - a)`` for ``a``
aligned shingles of ``m`` and ``n``: the Jaccard similarity of the shingles as far as
they are in the same order.

Texts of few shingles also get values of their whole sequence and of it without each
one of its shingles (:func:`short_values`), so those of up to 17 shingles together
that reach ``SIMILARITY`` are candidates for certain.

Equal texts are one class with one sketch. Documents that share a value form a
bucket. Its members are first compared with its centre, the one that shares values with
most documents (in a group of edited copies that is the least edited one), so a large
group is settled by as many comparisons as it has members. Where a bucket's members
are then in different components, they are compared across components: all pairs in a
bucket of up to ``SMALL`` members, in a larger one each member with further centres (two
of the bucket, and one of those that share another value too), in rounds until one
brings no link. So the comparisons grow with the members, not with their squares.

What is then still apart in large buckets gets an exact pass (:func:`_by_rarest`): two sequences that
reach the similarity share one of their rarest shingles, at places that their numbers of shingles tell, so
only members of different components that share one there are compared, and no pair of a bucket is left out."""

from __future__ import annotations

import itertools
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bitmaps import in_map, sized_map
from tessera.llm.words import PLACES, chunked, lowered, mixed, released, shingles, signed, slices, split, unused
from tessera.plans.components import connected_components
from tessera.plans.staging import staged

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, TAKEN = 32, 5
#: Members of a bucket that are compared in all pairs, and sketches between a value and the
#: other one that parts a large bucket.
SMALL, BETWEEN = 32, 7
#: Classes of sizes for each factor of e, where members are joined by their rarest shingles.
SIZES = 20
#: Counts of shingles in the table by which these are ranked (8 MB at most).
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 21
#: Numbers of shingles of the texts that have values beside their sketches.
SHORT = range(4, 11)
_FACTORS = np.random.default_rng(40404).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def labelled(words: np.ndarray) -> np.ndarray:
    """The shingles of a word sequence, each hashed with its number among equal ones."""
    code = shingles(words, SHINGLE)
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    new = np.ones(len(code), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return code
    places = np.arange(len(code))
    number = np.empty(len(code), np.uint64)
    number[order] = places - np.maximum.accumulate(np.where(new, places, 0))
    return np.where(number > 0, mixed(code + number * PLACES[7]), code)


def sketch(labels: np.ndarray, sketches: int = SKETCHES, taken: int = TAKEN) -> np.ndarray:
    """The order-aware values of a labelled sequence."""
    n, out = len(labels), np.zeros(sketches, np.uint64)
    taken = min(taken, n)
    step = max(1, (1 << 20) // n)
    for lo in range(0, sketches, step):
        hashed = labels[None, :] * _FACTORS[lo : min(lo + step, sketches), None]
        hashed ^= hashed >> np.uint64(32)
        at = np.argpartition(hashed, taken - 1, axis=1)[:, :taken] if taken < n else np.broadcast_to(np.arange(n), hashed.shape)
        at = np.sort(at, axis=1)
        out[lo : lo + step] = (labels[at] * PLACES[:taken]).sum(axis=1, dtype=np.uint64)
    return mixed(out + np.arange(sketches, dtype=np.uint64) * PLACES[9])


def short_values(labels: np.ndarray) -> np.ndarray:
    """Of a sequence of few shingles, values of the whole and of it without each one.

    A pair of ``m + n`` shingles leaves at most ``(m + n) / 9`` out at a similarity of
    0.8: below 9 it is equal, and below 18 one is the other without one shingle."""
    if len(labels) not in SHORT:
        return np.empty(0, np.uint64)
    code = labels * PLACES[: len(labels)]
    whole = code.sum(dtype=np.uint64)
    # behind the shingle that is left out, the others move up
    up = np.concatenate((np.zeros(1, np.uint64), labels[1:] * PLACES[: len(labels) - 1]))
    ahead, behind = np.cumsum(code, dtype=np.uint64) - code, up.sum(dtype=np.uint64) - np.cumsum(up, dtype=np.uint64)
    sizes = np.full(len(labels) + 1, len(labels) - 1, np.uint64)
    sizes[0] += np.uint64(1)
    return mixed(np.concatenate((np.array([whole], np.uint64), ahead + behind)) + sizes * PLACES[10])


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two labelled sequences, or 0 where it is below ``least``.

    At ``least``, the alignment leaves at most ``(m + n)(1 - least) / (1 + least)``
    shingles out, so no aligned pair is further from the diagonal than that. Labels are
    unique in a sequence, so the alignment in the band is a longest rising run of the
    positions of equal labels."""
    total = len(a) + len(b)
    need = least * total / (1 + least)
    if min(len(a), len(b)) < need - 1e-9:
        return 0.0
    _, at, of = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(at) < need - 1e-9:
        return 0.0
    order = np.argsort(at)
    at, of = at[order], of[order]
    of = of[np.abs(at - of) <= total * (1 - least) / (1 + least) + 1e-9]
    if (np.diff(of) > 0).all():
        length = len(of)
    else:
        tails: list[int] = []
        for x in of.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        length = len(tails)
    value = length / (total - length) if length else 0.0
    return value if value >= least - 1e-12 else 0.0


def _sketched(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunked(lowered(batch.column("text"))):
                words, out, sizes = split(data, offsets, True), [], []
                first = words.first.tolist()
                for a, b in zip(first, first[1:], strict=False):
                    labels = labelled(words.hash[a:b])
                    out.append(signed(np.concatenate((sketch(labels), short_values(labels)))) if b > a else None)
                    sizes.append(max(1, b - a - SHINGLE + 1))
                values = pa.array(out, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], values, pa.array(sizes, pa.int64())], ["doc_id", "digest", "values", "size"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("digest"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, digest string, values array<long>, size long")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs(u, v)`` whose texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, np.ndarray] = ("", labelled(np.empty(0, np.uint64)))
        for batch in slices(batches):
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                if last[0] != a:
                    last = (a, _labels(a))
                keep.append(similarity(last[1], _labels(b), least) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    # the join on u comes last, so that rows of one u follow each other
    both = pairs.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("b")), "v").join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("a")), "u")
    return both.select("u", "v", "a", "b").mapInArrow(released(run), "u long, v long")


def _labels(text: str) -> np.ndarray:
    data, offsets = next(iter(chunked(lowered(pa.array([text])))))[2:]
    return labelled(split(data, offsets, True).hash)


def _picked(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``doc_id, text`` of the documents in ``nodes(doc_id, digest)``."""
    sent = docs.sparkSession.sparkContext.broadcast(sized_map(nodes.select(F.col("doc_id").alias("key"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_map(sent.value, batch.column("doc_id").to_numpy().view(np.uint64))))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    rows = rows.mapInArrow(released(run), "doc_id long, text string").withColumn("digest", F.md5("text"))
    return rows.join(nodes, ["doc_id", "digest"], "left_semi").select("doc_id", "text").dropDuplicates(["doc_id"])


def _alike(a: str, b: str, least: float) -> Column:
    """Whether texts of so many shingles can reach the similarity: it is at most the
    smaller number by the larger."""
    return F.least(a, b) >= F.greatest(a, b) * F.lit(least) - F.lit(1e-9)


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``found(node, component)`` after more ``links(u, v)``, contracted
    to links between components."""
    for end in ("u", "v"):
        links = links.join(found.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    moved = staged(connected_components(links.select(F.col("cu").alias("u"), F.col("cv").alias("v"))), "moved")
    kept = found.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return staged(kept.union(moved.join(found, "node", "left_anti").select("node", "component")), "components")


def _buckets(firsts: DataFrame) -> DataFrame:
    """``doc_id, digest, size, values`` -> members of the values that several documents have:
    ``key, v, size, digest, other, members, pop``.

    ``pop`` counts the members of all buckets of the document, ``other`` is its value in
    another sketch."""
    turned = F.concat(F.slice("values", BETWEEN + 1, SKETCHES - BETWEEN), F.slice("values", 1, BETWEEN), F.slice("values", SKETCHES + 1, 1 << 20))
    entries = firsts.select(F.col("doc_id").alias("v"), "digest", "size", F.explode(F.arrays_zip(F.col("values").alias("key"), turned.alias("other"))).alias("e"))
    entries = entries.select("e.key", "v", "size", "digest", "e.other")
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = staged(entries.join(shared, "key").dropDuplicates(["key", "v"]), "buckets")
    return staged(buckets.join(buckets.groupBy("v").agg(F.sum("members").alias("pop")), "v"), "buckets")


def _with_centre(member: DataFrame, by: list[str], order: Column, least: float) -> DataFrame:
    """Pairs of each member of a group with its centre, the last by ``order``; only across
    components, where there is a column of them."""
    centre = member.groupBy(*by).agg(F.max(order).alias("m"))
    pairs = member.join(centre, by).where("v <> m.v").where(_alike("size", "m.size", least))
    if "c" in member.columns:
        pairs = pairs.where("c <> m.c")
    return pairs.select(F.least("v", "m.v").alias("u"), F.greatest("v", "m.v").alias("v"))


def _all_pairs(member: DataFrame, least: float) -> DataFrame:
    """Pairs of members of a bucket in different components."""
    a, b = member.select("key", F.col("v").alias("u"), F.col("c").alias("ca"), F.col("size").alias("u_size")), member.select("key", "v", F.col("c").alias("cb"), "size")
    return a.join(b, "key").where("ca <> cb and u < v").where(_alike("size", "u_size", least)).select("u", "v")


def _slots(labels: np.ndarray, slots: int) -> np.ndarray:
    return (labels & np.uint64(slots - 1)).view(np.int64)


def _by_rarest(member: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs of members (``v, c, size``) in different components that can reach the similarity.

    Sequences of ``m`` and ``n`` shingles reach it with ``need(m, n)`` aligned ones. With all shingles
    in one order, rare ones first, the first that is aligned has at least ``need(m, n) - 1`` behind it in
    both, so its place is at most ``m - need(m, n)`` in one and ``n - need(m, n)`` in the other: a ninth of
    the shingles where sizes are equal, a fifth of the longer one at most. Copies of one text with too many edits
    to be linked have only edits in those places, not the shingles that all of the group have.

    Any one order serves; rare is what a table of counts of bounded size, which
    shingles may share a count in, takes for rare. Shingles whose count is of one component's members only, as
    are those of an edit that no other text has, keep their place but are no rows.

    The shorter of two has places for partners of its own size at least (``mine``), the longer one for each
    class of sizes that it can be joined with (``asked``). Members of a component that have a shingle
    at the same place and the same size are one row of the join; a shingle of one component joins none."""

    held = staged(member.join(texts.select(F.col("doc_id").alias("v"), "text"), "v").select("v", "c", "size", "text"), "apart_texts")
    slots = LEAST_SLOTS
    while slots < min(held.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], MOST_SLOTS):
        slots *= 2

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [_slots(_labels(t), slots) for t in batch.column("text").to_pylist()]
            c = np.repeat(batch.column("c").to_numpy(), [len(x) for x in own])
            own = np.concatenate(own)
            order = np.lexsort((c, own))
            slot, start, times = np.unique(own[order], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (slot, times, c[order][start], c[order][start + times - 1])], ["slot", "times", "c0", "c1"])

    counts = held.mapInArrow(released(counted), "slot long, times long, c0 long, c1 long").groupBy("slot").agg(F.sum("times").alias("times"), F.min("c0").alias("c0"), F.max("c1").alias("c1"))
    counts, times = counts.select("slot", F.when(F.col("c0") < F.col("c1"), F.col("times")).otherwise(-F.col("times")).alias("times")).toArrow(), np.zeros(slots, np.int32)
    # a count of one component's is negative
    times[counts["slot"].to_numpy()] = np.clip(counts["times"].to_numpy(), -np.iinfo(np.int32).max, np.iinfo(np.int32).max)
    sent = held.sparkSession.sparkContext.broadcast(times)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, places = [], []
            for t in batch.column("text").to_pylist():
                labels = _labels(t)
                first = len(labels) - int(np.ceil(len(labels) * least - 2e-9)) + 1
                times = sent.value[_slots(labels, slots)]
                order = np.lexsort((labels, np.abs(times)))[:first]
                places.append(np.flatnonzero(times[order] > 0))
                keys.append(labels[order[places[-1]]])
            of = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys))), pa.array(np.concatenate(places)), *(batch.column(c).take(of) for c in ("size", "c", "v"))], ["key", "place", "size", "c", "v"])

    def need(m: Column, n: Column, scale: float = least / (1 + least)) -> Column:
        return F.ceil((m + n) * F.lit(scale) - F.lit(2e-9))

    def sizes(m: Column) -> Column:
        return F.floor(F.log(F.greatest(m, F.lit(1.0))) * F.lit(SIZES)).cast("int")

    size, place = F.col("size"), F.col("place")
    rare = staged(held.mapInArrow(released(ranked), "key long, place long, size long, c long, v long"), "rarest")
    across = rare.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key")
    rare = rare.join(across, "key").groupBy("key", "place", "size", "c").agg(F.collect_list("v").alias("v"))
    mine = rare.where(place <= size - need(size, size)).withColumn("sizes", sizes(size))
    most = F.least(size + F.lit(0.0), (size - place) * F.lit((1 + least) / least) - size + F.lit(1e-6))
    asked = rare.withColumns({"lo": F.ceil(size * F.lit(least) - F.lit(2e-9)), "hi": most}).where("lo <= hi").withColumn("sizes", F.explode(F.sequence(sizes(F.col("lo")), sizes(F.col("hi"))))).drop("lo", "hi")
    mine, asked = (side.select("key", "sizes", *(F.col(k).alias(f"{name}_{k}") for k in ("place", "size", "c", "v"))) for side, name in ((mine, "a"), (asked, "b")))
    m, n = F.col("a_size"), F.col("b_size")
    both = mine.join(asked, ["key", "sizes"]).where("a_c <> b_c and (a_size < b_size or a_size = b_size and a_c < b_c)")
    both = both.where((F.col("a_place") <= m - need(m, n)) & (F.col("b_place") <= n - need(m, n))).where(_alike("a_size", "b_size", least))
    pairs = both.select(F.explode("a_v").alias("a"), "b_v").select("a", F.explode("b_v").alias("b"))
    return pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, digest, class_id, component_id, kept``, a row per row.

    ``class_id`` is the smallest doc_id of the same text, ``component_id`` the smallest
    reachable over links; ``kept`` tells the row of that doc_id. Words are runs of
    letters and digits, lower case; fewer than five make one shingle. Null texts and
    texts without a word link with nothing (not even with each other); rows with a null
    doc_id link with nothing and are kept. Rows that share a doc_id are one document: they are
    linked, and kept together. No rows give no rows; other columns are ignored."""
    rows = staged(_sketched(docs), "sketches")
    live = rows.where("doc_id is not null and values is not null")
    classes = staged(live.groupBy("digest").agg(F.min("doc_id").alias("class_id")), "classes")
    firsts = live.join(classes.select(F.col("class_id").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi")
    buckets = _buckets(firsts)
    texts = staged(_picked(docs, buckets.select(F.col("v").alias("doc_id"), "digest").distinct()), "texts")
    central = F.struct("pop", (-F.col("v")).alias("least"), "v", "size")
    tested = staged(_with_centre(buckets, ["key"], central, least).distinct(), "pairs")
    found = staged(connected_components(staged(_verified(tested, texts, least), "links")), "components")
    for turn in itertools.count():
        member = buckets.join(found.withColumnRenamed("node", "v"), "v", "left").withColumn("c", F.coalesce("component", "v"))
        torn = member.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key")
        member = staged(member.select("key", "v", "size", "members", "pop", "other", "c").join(torn, "key"), "members")
        large = member.where(F.col("members") > SMALL)
        # other centres in each round, and other parts of the buckets
        drawn = [F.struct(F.xxhash64("v", F.lit(2 * turn + k)).alias("h"), "v", "size", "c") for k in range(2)]
        part = F.col("other") if turn == 0 else F.pmod(F.xxhash64("v", F.lit(turn)), F.lit(8))
        near = _with_centre(large.withColumn("part", part), ["key", "part"], F.struct("pop", (-F.col("v")).alias("least"), "v", "size", "c"), least)
        for order in drawn:
            near = near.union(_with_centre(large, ["key"], order, least))
        if turn == 0:
            near = near.union(_all_pairs(member.where(F.col("members") <= SMALL), least))
        near = staged(near.distinct().join(tested, ["u", "v"], "left_anti"), "pairs")
        more = staged(_verified(near, texts, least), "links")
        if more.isEmpty():
            break
        tested, found = tested.union(near), _merged(found, more)
    apart = staged(large.select("v", "c", "size").distinct(), "apart")
    if not apart.isEmpty():
        rest = staged(_by_rarest(apart, texts, least).distinct().join(tested.union(near), ["u", "v"], "left_anti"), "pairs")
        more = staged(_verified(rest, texts, least), "links")
        if not more.isEmpty():
            found = _merged(found, more)
    placed = rows.select("doc_id", "digest", F.col("values").isNotNull().alias("live")).join(classes, "digest", "left")
    own = F.when(F.col("live") & F.col("doc_id").isNotNull(), F.col("class_id")).otherwise(F.col("doc_id"))
    placed = placed.select("doc_id", "digest", own.alias("class_id"))
    joined = placed.join(found, placed["class_id"] == found["node"], "left").select("doc_id", "digest", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    return joined.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the smallest doc_id.
    Of rows that share a doc_id one stays, that of the least checksum."""
    key, least_digest = (unused(docs.columns, n) for n in ("__near_dup_id", "__near_dup_least"))
    id_, digest = F.col("doc_id").cast("long"), F.md5(F.col("text").cast("string"))
    gone = staged(near_duplicates(docs, least).where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct(), "gone")
    rest = docs.join(gone, id_ == F.col(key), "left_anti")
    again = docs.select(id_.alias(key), digest.alias("d")).where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("d").alias(least_digest)).where("n > 1").drop("n")
    again = staged(again, "again")
    if again.isEmpty():
        return rest
    once = rest.join(again, id_ == F.col(key), "left_anti")
    many = rest.join(again, (id_ == F.col(key)) & digest.eqNullSafe(F.col(least_digest)))
    return once.union(many.dropDuplicates([key]).select(*docs.columns))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "component_id", "kept")
