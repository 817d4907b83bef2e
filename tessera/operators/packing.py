"""Rows of pixels that travel as packed parts.

A pixel is some 70 bytes of a shuffle as a row, and a few as an entry of an array. So where rows go
to the task of their part (a tile, a band, an image), each task first packs what it has of a
part, batch by batch, into one row with an array for each column, and only such rows are shuffled,
sorted and joined. Spark also takes exploded rows for as few as those they come from and would
broadcast them; joins of packed rows are by merging, however small a side is taken to be.

Parts are named by ``keys``: the image's id and whole numbers. A part must fit in a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

#: Pixels that are worked on at once, but for a larger part.
AT_ONCE = 1 << 18
#: How the array of a column is held: as Arrow's stream (any type, nulls), bytes, or 32-bit integers.
ANY, BYTES, INTS = 0, 1, 2
_HELD = {BYTES: np.dtype(np.uint8), INTS: np.dtype(np.int32)}


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before it; the first row does."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        a, b = c.slice(1), c.slice(0, max(n - 1, 0))
        differs = pc.fill_null(pc.not_equal(a, b), False)
        if c.null_count:
            differs = pc.or_(differs, pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    return new


def _held(values: pa.Array, cuts: np.ndarray) -> tuple[int, pa.Array]:
    """The values, cut into an array for each part."""
    if pa.types.is_boolean(values.type):
        values = values.cast(pa.uint8())
    if pa.types.is_integer(values.type) and not values.null_count:
        plain = values.to_numpy(zero_copy_only=False)
        low, high = int(plain.min()), int(plain.max())
        kind = BYTES if low >= 0 and high < 256 else INTS if -(1 << 31) <= low and high < 1 << 31 else ANY
        if kind != ANY:
            data = np.ascontiguousarray(plain.astype(_HELD[kind]))
            offsets = (cuts * data.itemsize).astype(np.int32)
            return kind, pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    out = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        sink = pa.BufferOutputStream()
        rows = pa.RecordBatch.from_arrays([pa.concat_arrays([values.slice(lo, hi - lo)])], ["v"])
        with pa.ipc.new_stream(sink, rows.schema) as stream:
            stream.write_batch(rows)
        out.append(sink.getvalue().to_pybytes())
    return ANY, pa.array(out, pa.binary())


def _loose(held: pa.Array, kinds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The values of the parts, one after another."""
    if len(kinds) and kinds[0] != ANY and (kinds == kinds[0]).all():
        offsets = np.frombuffer(held.buffers()[1], np.int32, len(held) + 1, held.offset * 4)
        flat = np.frombuffer(held.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(_HELD[int(kinds[0])])
        return pa.array(flat).cast(kind)
    out = []
    for data, k in zip(held.to_pylist(), kinds.tolist(), strict=True):
        out.append(pa.ipc.open_stream(data).read_all().column("v").combine_chunks() if k == ANY else pa.array(np.frombuffer(data, _HELD[k])))
    return pa.concat_arrays([(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).cast(kind) for c in out]) if out else pa.array([], kind)


def _fields(n: int) -> list[str]:
    return [f"f{k}" for k in range(n)]


def _schema(df: DataFrame, columns: list[str]) -> StructType:
    return df.select(*columns).schema


def packed(rows: DataFrame, keys: list[str], columns: list[str], wide: int | None = None) -> DataFrame:
    """``keys``, ``many``, ``kinds``, ``f0, f1 ...``: of each part what a task has of it in one batch, with
    an array for each column (and empty ones up to ``wide``); ``many`` is the number of rows."""
    wide = wide or len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            start = np.flatnonzero(_changes([batch.column(k) for k in keys]))
            if len(start) * 16 > batch.num_rows > 16:  # rows of a part don't follow each other
                codes = [batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys]
                batch = batch.take(pa.array(np.lexsort(codes[::-1])))
                start = np.flatnonzero(_changes([batch.column(k) for k in keys]))
            cuts = np.append(start, batch.num_rows)
            held = [_held(batch.column(c), cuts) for c in columns]
            kinds = bytes(k for k, _ in held)
            out = [batch.column(k).take(pa.array(start)) for k in keys]
            out += [pa.array(np.diff(cuts), pa.int32()), pa.repeat(pa.scalar(kinds, pa.binary()), len(start)), *(h for _, h in held)]
            out += [pa.repeat(pa.scalar(b"", pa.binary()), len(start))] * (wide - len(columns))
            yield pa.RecordBatch.from_arrays(out, [*keys, "many", "kinds", *_fields(wide)])

    schema = _schema(rows, keys).add("many", IntegerType()).add("kinds", BinaryType())
    for f in _fields(wide):
        schema = schema.add(f, BinaryType())
    return rows.select(*keys, *(c for c in columns if c not in keys)).mapInArrow(run, schema)


def _unpacked(parts: pa.RecordBatch, names: list[str], types: list[pa.DataType]) -> list[pa.Array]:
    kinds = np.frombuffer(b"".join(parts.column("kinds").to_pylist()), np.uint8).reshape(parts.num_rows, len(names))
    return [_loose(parts.column(f), kinds[:, k], types[k]) for k, f in enumerate(_fields(len(names)))]


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of packed parts in batches that hold parts whole, of some ``AT_ONCE`` pixels."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([*kept, batch]).combine_chunks()
        start = np.flatnonzero(_changes([whole.column(k) for k in keys]))
        yield from _sliced(whole.slice(0, int(start[-1])), start[:-1])
        kept = whole.slice(int(start[-1])).to_batches()
    if kept:
        whole = pa.Table.from_batches(kept).combine_chunks()
        yield from _sliced(whole, np.zeros(1, np.int64))


def _sliced(rows: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not rows.num_rows:
        return
    ends, total = np.append(start[1:], rows.num_rows), np.append(0, np.cumsum(rows.column("many").to_numpy()))
    at = 0
    while at < len(start):
        lo = int(start[at])
        to = max(at + 1, int(np.searchsorted(total[ends], total[lo] + AT_ONCE, "right")))
        yield rows.slice(lo, int(ends[to - 1]) - lo).to_batches()[0]
        at = to


def by_part(rows: DataFrame, keys: list[str], run: Callable[[pa.Table], pa.Table], schema: str, table: DataFrame | None = None, on: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """``rows.groupBy(keys).applyInArrow(run, schema)``, with rows packed on their way. ``table`` is joined to
    the packed parts by ``on`` (keys of the rows): its columns come with each row and may be keys too."""
    more = [c for c in table.columns if c not in on] if table is not None else []
    own = [k for k in keys if k not in more]
    columns = [c for c in rows.columns if c not in own]
    types = to_arrow_schema(_schema(rows, columns)).types
    same = [*own, *more]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _whole(batches, keys):
            start = np.flatnonzero(_changes([parts.column(k) for k in keys]))
            many = parts.column("many").to_numpy()
            at = pa.array(np.repeat(np.arange(parts.num_rows), many))
            flat = pa.Table.from_arrays([*(parts.column(k).take(at) for k in same), *_unpacked(parts, columns, types)], [*same, *columns])
            total = np.append(0, np.cumsum(many))
            cuts = total[np.append(start, parts.num_rows)]
            done = [run(flat.slice(lo, hi - lo)) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield from pa.concat_tables(done).combine_chunks().to_batches()

    parts = packed(rows, own, columns)
    if table is not None:
        table = table.withColumns({k: F.col(k).cast(rows.schema[k].dataType) for k in on})
        parts = parts.join(table.hint("merge"), list(on))
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, schema)


def attached(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows.join(table, keys)``, with rows packed on their way; ``table`` has a few rows for a key."""
    columns = [c for c in rows.columns if c not in keys]
    more = [c for c in table.columns if c not in keys]
    table = table.withColumns({k: F.col(k).cast(rows.schema[k].dataType) for k in keys})
    types = to_arrow_schema(_schema(rows, columns)).types
    schema = StructType([*_schema(rows, keys), *_schema(rows, columns), *_schema(table, more)])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.append(0, np.cumsum(batch.column("many").to_numpy()))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + AT_ONCE, "right")) - 1)
                parts = batch.slice(lo, hi - lo)
                at = pa.array(np.repeat(np.arange(hi - lo), np.diff(total[lo : hi + 1])))
                same = {c: parts.column(c).take(at) for c in (*keys, *more)}
                loose = _unpacked(parts, columns, types)
                yield pa.RecordBatch.from_arrays([*(same[k] for k in keys), *loose, *(same[c] for c in more)], [*keys, *columns, *more])
                lo = hi

    parts = packed(rows, keys, columns)
    return parts.join(table.hint("merge"), keys).mapInArrow(spread, schema)


#: Values of a row's own columns and of those of one row over it -> the row's new ones.
Fold = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], dict[str, np.ndarray]]


def folded(a: DataFrame, b: DataFrame, tile: int, rank: str, fold: Fold) -> DataFrame:
    """Rows of ``a`` with ``fold`` applied to their columns for each of ``b``'s rows at the same ``image_id, y, x`` in
    turn, by ``rank``; both have the same columns (whole numbers) but for it. A row of ``a`` that ``b`` has none for is folded
    with zeros. Positions are unique in ``a``."""
    return matched(a, b.withColumn(rank, F.col(rank).cast("int")), tile, "fold", rank, fold)


def matched(a: DataFrame, b: DataFrame, tile: int, how: str = "left", rank: str | None = None, fold: Fold | None = None) -> DataFrame:
    """Rows of two rasters at the same ``image_id, y, x``: columns of ``a``, then those of ``b``, which
    differ from them. ``left``: null where ``b`` has none; ``exact``: it is an error if one of them has a
    position that the other lacks; ``stack``: all of ``b``'s rows as an array ``stack`` of structs,
    null where there is none. Positions are unique in ``a`` and, but for ``stack``, in ``b``."""
    key, place = ["image_id", "row", "col"], ["y", "x"]
    in_a, in_b = ([c for c in df.columns if c not in ("image_id", *place)] for df in (a, b))
    if how not in ("stack", "fold") and set(in_a) & set(in_b):
        raise ValueError("columns of two rasters must differ")
    kind = a.schema["image_id"].dataType
    side = lambda df: df.select(F.col("image_id").cast(kind).alias("image_id"), *(F.floor(F.col(c) / tile).cast("int").alias(k) for c, k in (("y", "row"), ("x", "col"))), *(F.col(c).cast("int").alias(c) for c in place), *(c for c in df.columns if c not in ("image_id", *place)))
    a, b = side(a), side(b)
    types = [to_arrow_schema(_schema(df, [*place, *more])).types for df, more in ((a, in_a), (b, in_b))]
    wide = 2 + max(len(in_a), len(in_b))
    both = packed(a, key, [*place, *in_a], wide).withColumn("side", F.lit(0)).union(packed(b, key, [*place, *in_b], wide).withColumn("side", F.lit(1)))
    out = StructType([*_schema(a, ["image_id", *place]), *_schema(a, in_a)])
    theirs = StructType([f for f in _schema(b, in_b)])
    out = out.add("stack", ArrayType(theirs)) if how == "stack" else out if how == "fold" else StructType([*out, *(f for f in theirs)])
    for f in out:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _whole(batches, key):
            part = np.cumsum(_changes([parts.column(k) for k in key]))
            sides, many = parts.column("side").to_numpy(), parts.column("many").to_numpy()
            loose, spots, order = [], [], []
            for s, names in enumerate((in_a, in_b)):
                mine = np.flatnonzero(sides == s)
                own = parts.take(pa.array(mine))
                flat = _unpacked(own, [*place, *names], types[s])
                y, x = (c.to_numpy().astype(np.int64) for c in flat[:2])
                spot = (np.repeat(part[mine], many[mine]) * tile + y % tile) * tile + x % tile
                loose.append((own.column("image_id").take(pa.array(np.repeat(np.arange(len(mine)), many[mine]))), flat))
                spots.append(spot)
                order.append(None if (spot[1:] >= spot[:-1]).all() else np.argsort(spot, kind="stable"))
            ids, flat = loose[0]
            sorted_b = spots[1] if order[1] is None else spots[1][order[1]]
            if how == "exact":
                sorted_a = spots[0] if order[0] is None else spots[0][order[0]]
                if not np.array_equal(sorted_a, sorted_b):
                    s = int(np.isin(spots[0], spots[1]).all())
                    at = int(np.flatnonzero(~np.isin(spots[s], spots[1 - s]))[:1].sum())
                    raise ValueError(f"images of different sizes: {loose[s][0][at]} at {loose[s][1][1][at]},{loose[s][1][0][at]}")
            lo = np.searchsorted(sorted_b, spots[0])
            if how == "stack":
                hi = np.searchsorted(sorted_b, spots[0], "right")
                n = hi - lo
                offsets = np.append(0, np.cumsum(n))
                take = np.repeat(lo - offsets[:-1], n) + np.arange(offsets[-1])
                take = take if order[1] is None else order[1][take]
                values = pa.StructArray.from_arrays([c.take(pa.array(take)) for c in loose[1][1][2:]], in_b)
                more = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(n == 0))]
            elif how == "fold":
                n = np.searchsorted(sorted_b, spots[0], "right") - lo
                theirs_at = dict(zip(in_b, (c.to_numpy(zero_copy_only=False) for c in loose[1][1][2:]), strict=True))
                turn = np.lexsort((theirs_at.pop(rank), spots[1]))
                now = {c: v.to_numpy(zero_copy_only=False).copy() for c, v in zip(in_a, flat[2:], strict=True)}
                bare, none = np.flatnonzero(n == 0), np.zeros(int((n == 0).sum()), np.int64)
                rounds = [(bare, dict.fromkeys(in_a, none))]
                rounds += [(at, {c: theirs_at[c][turn[lo[at] + k]] for c in in_a}) for k in range(n.max(initial=0)) for at in (np.flatnonzero(n > k),)]
                for at, over in rounds:
                    for c, v in fold({c: v[at] for c, v in now.items()}, over).items():
                        now[c][at] = v
                flat, more = [*flat[:2], *(pa.array(now[c], t) for c, t in zip(in_a, types[0][2:], strict=True))], []
            else:
                there = lo < len(sorted_b)
                there[there] = sorted_b[lo[there]] == spots[0][there]
                at = np.where(there, lo, 0)
                if order[1] is not None and len(order[1]):
                    at = order[1][at]
                at = pa.array(at, mask=~there)
                more = [c.take(at) for c in loose[1][1][2:]]
            yield pa.RecordBatch.from_arrays([ids, *flat, *more], [f.name for f in out])

    return both.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, out)
