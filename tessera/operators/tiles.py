"""Passes over neighbouring pixels within tasks: blur, Gaussian and components of parts of an image.

A part (a tile with what surrounds it, or a band of whole rows or columns) comes to a task by one
shuffle and is an array there, of a size that no image exceeds. What a part can't know is left to
further rounds or joins between parts, so an image may be of any size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.packing import by_part

KEY = ["image_id", "y", "x"]
#: Side of a tile, passes of a blur in one round (pixels around a tile that come with it), rows of a band.
TILE, REACH, BAND = 256, 64, 64


def _placed(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows within their part."""
    y, x = (rows.column(c).to_numpy() for c in ("y", "x"))
    return y - y.min(), x - x.min()


def _array(rows: pa.Table, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a part, and where it has rows with one."""
    shape = int(y.max()) + 1, int(x.max()) + 1
    a = rows.column("a").to_numpy()
    good = ~np.isnan(a) if a.dtype.kind == "f" else np.ones(len(a), bool)
    values, there = np.zeros(shape, np.int64), np.zeros(shape, bool)
    values[y[good], x[good]], there[y[good], x[good]] = a[good], True
    return values, there


def _mapped(rows: pa.Table, picked: np.ndarray, values: np.ndarray, there: np.ndarray) -> pa.Table:
    """The picked rows with new values, null where there is none."""
    out = rows.select(KEY).filter(pa.array(picked))
    return out.append_column("a", pa.array(values.astype(np.int32), mask=~there))


def _schema(pixels: DataFrame) -> str:
    return f"image_id {pixels.schema['image_id'].dataType.simpleString()}, y int, x int, a int"


def _plain(masks: DataFrame) -> DataFrame:
    return masks.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("a").cast("int").alias("a"))


def beside_zero(pixels: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Adds ``edge``: whether a pixel with alpha is beside (above, below, left, right) one of alpha 0. A
    tile comes with a pixel around it. ``table``'s columns for an image are joined on the way."""
    more = [f for f in table.schema if f.name != "image_id"] if table is not None else []
    columns = [*pixels.columns, *(f.name for f in more)]

    def run(rows: pa.Table) -> pa.Table:
        y, x = _placed(rows)
        values, there = _array(rows, y, x)
        zero, beside = there & (values == 0), np.zeros(values.shape, bool)
        beside[1:] |= zero[:-1]
        beside[:-1] |= zero[1:]
        beside[:, 1:] |= zero[:, :-1]
        beside[:, :-1] |= zero[:, 1:]
        own_y, own_x = (rows.column(c).to_numpy() for c in ("y", "x"))
        own = (own_y // TILE == rows.column("row")[0].as_py()) & (own_x // TILE == rows.column("col")[0].as_py())
        edge = (beside & (values > 0))[y[own], x[own]]
        return rows.select(columns).filter(pa.array(own)).append_column("edge", pa.array(edge))

    near = lambda c: F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col(c) - 1) / TILE).cast("int"), F.floor((F.col(c) + 1) / TILE).cast("int")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (*pixels.schema, *more))
    return by_part(pixels.withColumn("row", near("y")).withColumn("col", near("x")), ["image_id", "row", "col"], run, f"{schema}, edge boolean", table)


#: What a pass over a part does: values, where there are some, and where it has rows -> new values, and where there are some.
Passes = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _around(masks: DataFrame, reach: int, passes: Passes) -> DataFrame:
    """Passes over rows and columns, that look ``reach`` pixels far in all, after one shuffle: a tile comes with so many pixels
    around it. What they lack makes some around it wrong, and none of the tile's own."""

    def run(rows: pa.Table) -> pa.Table:
        y, x = _placed(rows)
        values, there = _array(rows, y, x)
        rows_at = np.zeros(values.shape, bool)
        rows_at[y, x] = True
        values, there = passes(values, there, rows_at)
        own_y, own_x = (rows.column(c).to_numpy() for c in ("y", "x"))
        own = (own_y // TILE == rows.column("row")[0].as_py()) & (own_x // TILE == rows.column("col")[0].as_py())
        return _mapped(rows, own, values[y[own], x[own]], there[y[own], x[own]])

    near = lambda c: F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col(c) - reach) / TILE).cast("int"), F.floor((F.col(c) + reach) / TILE).cast("int")))
    tiles = _plain(masks).withColumn("row", near("y")).withColumn("col", near("x"))
    return by_part(tiles, ["image_id", "row", "col"], run, _schema(masks))


def _bands(masks: DataFrame, along: str, passes: Passes) -> DataFrame:
    """A pass along rows (x) or columns (y); a task has a band of whole ones."""

    def run(rows: pa.Table) -> pa.Table:
        y, x = _placed(rows)
        at = (y, x) if along == "x" else (x, y)
        values, there = _array(rows, *at)
        rows_at = np.zeros(values.shape, bool)
        rows_at[at] = True
        values, there = passes(values, there, rows_at)
        return _mapped(rows, np.ones(len(y), bool), values[at], there[at])

    other = "y" if along == "x" else "x"
    return by_part(_plain(masks).withColumn("band", F.floor(F.col(other) / BAND)), ["image_id", "band"], run, _schema(masks))


def _both(masks: DataFrame, reach: int, passes: Passes) -> DataFrame:
    """A pass along rows, then the same along columns: on a tile and what surrounds it, or further than ``REACH`` in bands."""
    if reach > REACH:
        return _bands(_bands(masks, "x", passes), "y", passes)

    def run(values: np.ndarray, there: np.ndarray, rows_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, there = passes(values, there, rows_at)
        values, there = passes(values.T, there.T, rows_at.T)
        return values.T, there.T

    return _around(masks, reach, run)


def box_blurred(masks: DataFrame, passes: int) -> DataFrame:
    """So many passes, at most ``REACH``, of a 3-tap mean over rows and then over columns, rounded each
    time. Each pass makes one more of the pixels around a tile wrong."""

    def run(values: np.ndarray, there: np.ndarray, rows_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(passes):
            for axis in (1, 0):
                total, taps = values * there, there.astype(np.int64)
                for back in (False, True):
                    near, far = (slice(1, None), slice(None, -1))[:: -1 if back else 1]
                    here, other = ((near, slice(None)), (far, slice(None))) if axis == 0 else ((slice(None), near), (slice(None), far))
                    total[here] += values[other] * there[other]
                    taps[here] += there[other]
                values = (2 * total + taps) // np.maximum(2 * taps, 1)
                there = rows_at & (taps > 0)
        return values, there

    return _around(masks, passes, run)


def weighed(masks: DataFrame, weights: np.ndarray) -> DataFrame:
    """Each value as the mean of those along its row, then along its column, by weights around it (an odd
    number, symmetric) that are weighed anew where the image has no pixel; rounded each time."""
    k = len(weights) // 2

    def run(values: np.ndarray, there: np.ndarray, rows_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, out, whole = values * there, np.zeros(values.shape), np.convolve(np.ones(values.shape[1]), weights)[k : k + values.shape[1]]
        for j in range(len(values)):
            total = np.convolve(values[j], weights)[k : k + values.shape[1]]
            by = whole if there[j].all() else np.convolve(there[j].astype(float), weights)[k : k + values.shape[1]]
            out[j] = np.floor(total / np.where(by > 0, by, 1) + 0.5)
        return out, rows_at

    return _both(masks, k, run)


def dilated(masks: DataFrame, radius: int) -> DataFrame:
    """The largest value within ``radius`` along its row, then along its column. The line is cut into
    stretches as long as a window; a window's largest is that of the end of one and the start of the
    next, so the work doesn't grow with the radius."""
    size, low = 2 * radius + 1, np.iinfo(np.int64).min

    def run(values: np.ndarray, there: np.ndarray, rows_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = values.shape[1]
        line = np.full((len(values), -(-(n + 2 * radius) // size) * size), low)
        line[:, radius : radius + n] = np.where(there, values, low)
        parts = line.reshape(len(values), -1, size)
        starts = np.maximum.accumulate(parts, axis=2).reshape(line.shape)
        ends = np.maximum.accumulate(parts[:, :, ::-1], axis=2)[:, :, ::-1].reshape(line.shape)
        out = np.maximum(ends[:, :n], starts[:, size - 1 : size - 1 + n])
        return np.where(out == low, 0, out), rows_at & (out != low)

    return _both(masks, radius, run)


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of n nodes with links u-v the smallest node of each one's component: roots that are
    linked hang on the smaller one, and paths are shortened, until no link joins two roots."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up := root[root], root):
            root = up


def _runs(rows: pa.Table, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, ends, and component's first run of the runs of one tile, in scan order."""
    y, x = (rows.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))
    order = np.lexsort((x, y))
    y, x = y[order], x[order]
    first = np.ones(len(y), bool)
    first[1:] = (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)
    start = np.flatnonzero(first)
    row, x0, x1 = y[start], x[start], x[np.append(start[1:], len(x)) - 1]
    step = int(x.max()) + 3
    low = np.searchsorted(row * step + x1 + 1, (row + 1) * step + x0 + 1 - reach)
    many = np.maximum(np.searchsorted(row * step + x0 + 1, (row + 1) * step + x1 + 1 + reach, "right") - low, 0)
    u = np.repeat(np.arange(len(row)), many)
    v = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
    return row, x0, x1, roots(len(row), u, v)


def tile_runs(present: DataFrame, reach: int) -> DataFrame:
    """``present(image_id, y, x)`` -> ``image_id, y, x0, x1, root_y, root_x``: horizontal stretches
    within a tile, and the first pixel of their component in it (diagonals count if reach is 1)."""

    def run(rows: pa.Table) -> pa.Table:
        row, x0, x1, root = _runs(rows, reach)
        columns = [pa.array(c.astype(np.int32)) for c in (row, x0, x1, row[root], x0[root])]
        return pa.Table.from_arrays([pa.repeat(rows.column("image_id")[0], len(row)), *columns], ["image_id", "y", "x0", "x1", "root_y", "root_x"])

    side = lambda c: F.floor(F.col(c) / TILE).alias(f"tile_{c}")
    kind = present.schema["image_id"].dataType.simpleString()
    rows = present.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    return by_part(rows.select("*", side("y"), side("x")), ["image_id", "tile_y", "tile_x"], run, f"image_id {kind}, y int, x0 int, x1 int, root_y int, root_x int")


def border_links(runs: DataFrame, reach: int, node: Callable[[str], Column]) -> DataFrame:
    """``u, v``: nodes of runs of :func:`tile_runs` that touch across the border of two tiles;
    ``node(alias)`` is a run's node. Only runs at a border are joined, by row and tile."""
    tile = lambda c: F.floor(F.col(c) / TILE)
    last, start = F.col("x1") % TILE == TILE - 1, F.col("x0") % TILE == 0
    # to the right: a run that ends where its tile does, and one that starts the next tile
    near = F.array(*(F.col("y") + d for d in range(-reach, reach + 1)))
    a = runs.where(last).withColumn("at", F.explode(near)).withColumn("next", F.col("x1") + 1).alias("a")
    b = runs.where(start & (F.col("x0") > 0)).alias("b")
    right = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.at") == F.col("b.y")) & (F.col("a.next") == F.col("b.x0")))
    # below: runs of a tile's last row, and of the row after it in the tile below and those beside it
    beside = F.array(tile("x0"), *((F.when(last, tile("x0") + 1), F.when(start, tile("x0") - 1)) if reach else ()))
    c = runs.where(F.col("y") % TILE == TILE - 1).withColumn("col", F.explode(F.filter(beside, lambda k: k.isNotNull()))).alias("a")
    d = runs.where((F.col("y") % TILE == 0) & (F.col("y") > 0)).withColumn("col", tile("x0")).alias("b")
    touching = (F.col("a.x0") <= F.col("b.x1") + reach) & (F.col("b.x0") <= F.col("a.x1") + reach)
    below = c.join(d, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.y") + 1 == F.col("b.y")) & (F.col("a.col") == F.col("b.col")) & touching)
    pick = lambda rows: rows.select(node("a").alias("u"), node("b").alias("v"))
    return pick(right).union(pick(below)).distinct()
