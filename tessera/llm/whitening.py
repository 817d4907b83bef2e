"""Operator 11: whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors become whole numbers, staged in blocks of some hundred kilobytes. Their covariance V
is never formed: a pass over the blocks gives V Q for a narrow Q, as sums of centred
products that tasks add up and Spark adds over tasks, so that the driver gets no more than
one matrix of Q's size. A Chebyshev polynomial in V, worked out by its recurrence, a pass for
each degree, damps the part of the spectrum below the wanted one; QR and a Rayleigh-Ritz step
follow, until the residuals of all wanted pairs are at the level of rounding. A last pass
measures how far the covariance of the whitened vectors is from the identity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.words import released
from tessera.plans.staging import staged

#: Components that are wanted, and further columns that the iteration carries beside them.
KEPT, GUARD = 32, 16
#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Values in a block.
BLOCK = 1 << 18
#: By how much one filter should raise the last wanted component over the unwanted ones, the
#: degrees it may have, and the rounds after which the iteration is an error.
RAISED, DEGREES, ROUNDS = 1e7, (4, 24), 100
#: Residuals, as shares of the largest eigenvalue: reached, and good enough where rounding stops them.
REACHED, ENOUGH = 1e-14, 1e-12
#: Eigenvalues below this share of the largest are those of a covariance without full rank.
LEAST = 1e-12


def blocks(vectors: DataFrame) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> ``d, n, ids, x, total``: whole numbers of n vectors of d
    entries, and their sums. Vectors that are null or empty, or hold null or non-finite entries, are left out."""
    kind = pa.decimal128(38, 0)
    schema = pa.schema([("d", pa.int32()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("x", pa.binary()), ("total", pa.list_(kind))])

    def block(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        most = np.abs(x).max()
        total = x.sum(axis=0) if most < 1 << 40 else x.astype(object).sum(axis=0)
        narrow = most < 1 << 31
        own = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.concat_arrays([ids]))
        sums = pa.array([[int(s) for s in total]], pa.list_(kind))
        return pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([len(x)]), own, pa.array([x.astype("<i4" if narrow else "<i8").tobytes()]), sums], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}
        for batch in batches:
            column = batch.column("embedding")
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends, bad = np.cumsum(sizes), np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            good = (sizes > 0) & (bad[ends] == bad[ends - sizes])
            for d in np.unique(sizes[good]).tolist():
                rows = np.flatnonzero(good & (sizes == d))
                x = np.floor(values[(ends[rows] - d)[:, None] + np.arange(d)] * SCALE) + SHIFT
                if np.abs(x).max() >= 1 << 52:
                    raise ValueError("an entry of an embedding is too large to be taken as a whole number")
                waiting.setdefault(d, []).append((batch.column("vec_id").take(pa.array(rows)), x.astype(np.int64)))
                own = waiting[d]
                if sum(x.size for _, x in own) >= BLOCK:
                    yield from cut(*map(list, zip(*own, strict=True)))
                    del waiting[d]
        for own in waiting.values():
            yield from cut(*map(list, zip(*own, strict=True)))

    def cut(ids: list[pa.Array], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids, x = pa.concat_arrays(ids), np.concatenate(parts)
        step = max(1, BLOCK // x.shape[1])
        for lo in range(0, len(x), step):
            yield block(ids[lo : lo + step], x[lo : lo + step])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(released(run), "d int, n long, ids array<long>, x binary, total array<decimal(38,0)>")


class Centre:
    """Whole numbers of the fit list: n, sums, and vectors minus their mean, without cancellation."""

    def __init__(self, n: int, total: list[int]):
        self.n, self.total = n, total
        self.whole = np.array([s // n for s in total], np.int64)
        self.rest = np.array([(s % n) / n for s in total])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - S)^2 of each row, exact; null where it doesn't fit in a long."""
        most = max(abs(int(x.max())), abs(int(x.min()))) * self.n + max(map(abs, self.total))
        far = x.astype(object) * self.n - np.array(self.total, object) if most >= 1 << 62 else x * self.n - np.array(self.total, np.int64)
        if x.shape[1] * int(np.abs(far).max()) ** 2 >= 1 << 63:
            far = far.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (far * far).sum(axis=1)]


def _matrix(raw: bytes, d: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4" if len(raw) == 4 * d * n else "<i8").reshape(n, d).astype(np.int64)


def _summed(rows: DataFrame, each, cells: int) -> np.ndarray:
    """The sum over blocks of ``each(x)``, an array of so many cells; each task sends one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for d, n, raw in zip(*(batch.column(c).to_pylist() for c in ("d", "n", "x")), strict=True):
                own = each(_matrix(raw, d, n))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(total)], ["at", "value"])

    found = rows.select("d", "n", "x").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(cells)
    out[found["at"].to_numpy()] = found["value"].to_numpy()
    return out


def _filtered(times, q: np.ndarray, y: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of the interval low..high in V, times q (y is V q), scaled
    to be about 1 at the top of the spectrum: small within the interval, growing fast above it."""
    middle, half = (low + high) / 2, max((high - low) / 2, 1e-8 * top)
    first = half / max(top - middle, half)
    scale, before, now = first, q, (y - middle * q) * (first / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - scale)
        before, now = now, (times(now) - middle * now) * (2 * after / half) - scale * after * before
        scale = after
    return now


def leading(times, d: int, kept: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a positive semidefinite V, falling, and their unit vectors as columns;
    ``times(Q)`` is V Q. Fewer than ``kept`` where the rest of the spectrum is zero. An
    iteration whose residuals don't come down to rounding is an error."""
    width = min(d, kept + GUARD)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    low, last = None, np.inf
    for _ in range(ROUNDS):
        y = times(q)
        h = q.T @ y
        e, turn = np.linalg.eigh((h + h.T) / 2)
        e, turn = e[::-1], turn[:, ::-1]
        q, y = q @ turn, y @ turn
        residuals = np.linalg.norm(y - q * e, axis=0)
        wanted = int((e[:kept] > LEAST * max(e[0], 0)).sum())
        if not wanted:
            return e[:0], q[:, :0]
        worst = residuals[:wanted].max() / e[0]
        if worst <= REACHED or worst <= ENOUGH and worst > last / 2:
            return e[:wanted], q[:, :wanted]
        last = worst
        if low is None:
            low = max(0.0, float(e[-1] - residuals[-1]))
        high = max(float(e[-1]), low)
        middle, half = (low + high) / 2, max((high - low) / 2, 1e-8 * e[0])
        growth = np.arccosh(max(1 + 1e-6, (e[wanted - 1] - middle) / half))
        degree = int(np.clip(np.ceil(np.log(2 * RAISED) / growth), *DEGREES))
        q = np.linalg.qr(_filtered(times, q, y, low, high, e[0], degree))[0]
    raise RuntimeError("the residuals of the eigenvectors didn't come down to rounding")


def whitened(vectors: DataFrame, kept: int = KEPT) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> ``vec_id, component, n, deviation, whitened, explained,
    identity_error``, a row for each vector and component.

    Left out are vectors that are null or empty or hold null or non-finite entries, and those whose
    length isn't that of most vectors (of lengths as frequent the smallest). Repeated rows
    and null vec_ids stay and count. There are as many components as the covariance has
    eigenvalues that aren't zero, ``kept`` at most, so none where all vectors are equal, and then no rows,
    as for an empty table. A deviation that doesn't fit in a long is null; an entry that is no whole
    number of 52 bits after scaling is an error. Other columns are ignored."""
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = staged(blocks(vectors), "blocks")
    sizes = rows.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    d, n = sizes["d"], sizes["n"]
    rows = rows.where(F.col("d") == d)
    sums = rows.select(F.posexplode("total").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast(T.DecimalType(38, 0))).alias("s")).collect()
    centre = Centre(n, [int(s) for _, s in sorted((r["at"], r["s"]) for r in sums)])
    trace = _summed(rows, lambda x: np.array([np.square(centre.centred(x)).sum()]), 1)[0] / n

    def times(q: np.ndarray) -> np.ndarray:
        def each(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            return (c.T @ (c @ q)).ravel()

        return _summed(rows, each, q.size).reshape(q.shape) / n

    e, q = leading(times, d, kept)
    many = len(e)
    if not many:
        return spark.createDataFrame([], schema)
    to, share = q / np.sqrt(e), e / trace

    def moments(x: np.ndarray) -> np.ndarray:
        w = centre.centred(x) @ to
        return np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))

    found = _summed(rows, moments, many + many * many) / n
    error = float(np.abs(found[many:].reshape(many, many) - np.outer(found[:many], found[:many]) - np.eye(many)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, size = batch.column("ids")[k].values, batch.column("n")[k].as_py()
                whole = _matrix(batch.column("x")[k].as_py(), d, size)
                for lo in range(0, size, 2048):
                    x = whole[lo : lo + 2048]
                    far = pa.array(centre.deviations(x), pa.int64())
                    owner = pa.array(np.repeat(np.arange(len(x)), many))
                    columns = [ids[lo : lo + len(x)].take(owner), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))), pa.array(np.full(len(owner), n))]
                    columns += [far.take(owner), pa.array((centre.centred(x) @ to).ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(owner), error))]
                    yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("n", "ids", "x").mapInArrow(released(project), schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened embeddings, up to 32 components of each."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
