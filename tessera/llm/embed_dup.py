"""Operator 3: near-duplicate embeddings by collision-counting projections.

Unit vectors are projected on many random directions. A window of half-width
``WINDOW`` centred on a vector's value in one projection holds those that collide
with it there; two vectors at the threshold collide in most projections, unrelated
ones in few. Pairs that collide in at least ``collisions()`` of the ``COUNTED``
projections, a bound that a pair at the threshold misses with probability ``MISSED``,
are verified by their cosine.

A window of one projection holds a fixed share of all vectors (``share_of_window()``, some
three in ten at 0.93), so windows over whole labels would count a number of pairs that
grows with the square of the label. Therefore windows are opened within cells: each of
``TABLES`` tables cuts ``DEPTH`` further projections in steps of ``STEP`` at a random shift,
and only vectors with the same label and the same steps are compared. ``cell_recall()`` is
the probability that a pair at the threshold shares a cell. Equal vectors are one node with a count. Large cells are cut
into blocks of at most ``BLOCK`` vectors, and each pair of blocks is a task of its own
size. A pair is counted only in the first table where it shares a cell, and a
block sends back counts and a forest of its links, never its pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.words import PLACES, mixed, signed
from tessera.plans.components import connected_components
from tessera.plans.staging import staged

COSINE = 0.93
TABLES, DEPTH, STEP = 48, 16, 2.6
COUNTED, MISSED = 48, 1e-4
BLOCK = 512
SEED = 30303


def distance(cosine: float) -> float:
    """Of unit vectors with this cosine; also the deviation of their projections' difference."""
    return math.sqrt(2 - 2 * cosine)


def collisions(cosine: float = COSINE, counted: int = COUNTED, missed: float = MISSED) -> tuple[float, int]:
    """Half-width of the windows, and the least number of them that a pair shares: the
    largest that a pair at the threshold misses with probability ``missed`` at most."""
    half = 1.5 * distance(cosine)
    p = math.erf(1.5 / math.sqrt(2))
    below, least = 0.0, 0
    for k in range(counted + 1):
        below += math.comb(counted, k) * p**k * (1 - p) ** (counted - k)
        if below > missed:
            least = k
            break
    return half, least


def share_of_window(cosine: float = COSINE) -> float:
    """Share of unrelated unit vectors in a window of one projection."""
    return math.erf(collisions(cosine)[0] / 2)


def cell_recall(cosine: float = COSINE) -> float:
    """Probability that a pair of unit vectors with this cosine shares a cell of a table.

    Two values at a normal distance of deviation ``d`` fall into one step at a random shift
    with the mean of ``1 - |distance| / STEP``, as far as that is positive."""
    d = distance(cosine)
    if d == 0:
        return 1.0
    z = STEP / d
    same = math.erf(z / math.sqrt(2)) - math.sqrt(2 / math.pi) / z * (1 - math.exp(-z * z / 2))
    return 1 - (1 - same**DEPTH) ** TABLES


class Projections:
    """Directions and shifts for one dimension of vectors."""

    def __init__(self, dimension: int):
        draw = np.random.default_rng([SEED, dimension])
        self.cells = np.round(draw.standard_normal((dimension, TABLES * DEPTH)) * 2**10) / 2**10
        self.shift = draw.random(TABLES * DEPTH) * STEP
        self.windows = draw.standard_normal((dimension, COUNTED))

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Cell of each vector in each table: the same number wherever it is worked out, as
        the products are multiples of 2**-30 whose sums a double holds exactly."""
        unit = np.round(unit * 2**20) / 2**20
        steps = np.floor((unit @ self.cells + self.shift) / STEP).astype(np.int64).view(np.uint64)
        parts = steps.reshape(len(unit), TABLES, DEPTH) * PLACES[:DEPTH]
        return mixed(parts.sum(axis=2, dtype=np.uint64) + np.arange(TABLES, dtype=np.uint64) * PLACES[DEPTH])


_tools: dict[int, Projections] = {}


def projections(dimension: int) -> Projections:
    if dimension not in _tools:
        _tools[dimension] = Projections(dimension)
    return _tools[dimension]


def unit_rows(column: pa.Array, dimension: int) -> np.ndarray:
    """Vectors in double precision at length 1."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _cells(nodes: DataFrame) -> DataFrame:
    """``node, label, vec`` -> ``label, place, cell, node``, a row for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("vec").value_lengths().to_numpy()
            for size in np.unique(sizes):
                own = batch.filter(pa.array(sizes == size))
                for lo in range(0, own.num_rows, 1024):
                    part = own.slice(lo, 1024)
                    keys = projections(int(size)).keys(unit_rows(part.column("vec"), int(size)))
                    rows = pa.array(np.repeat(np.arange(part.num_rows), TABLES))
                    places = np.tile(np.arange(TABLES, dtype=np.int32), part.num_rows)
                    columns = [part.column("label").take(rows), pa.array(places), pa.array(signed(keys.reshape(-1))), part.column("node").take(rows)]
                    yield pa.RecordBatch.from_arrays(columns, ["label", "place", "cell", "node"])

    return nodes.mapInArrow(run, "label long, place int, cell long, node long")


def block_links(a: np.ndarray, b: np.ndarray, same: bool, table: int, least_cosine: float) -> np.ndarray:
    """Which pairs of rows of two blocks in one cell of a table are links that no earlier table finds."""
    tool = projections(a.shape[1])
    live = np.ones((len(a), len(b)), bool)
    if same:
        live = np.triu(live, 1)
    half, least = collisions(least_cosine)
    of_a, of_b = (a @ tool.windows).astype(np.float32), (b @ tool.windows).astype(np.float32)
    order = np.argsort(of_b[:, 0])  # the first projection sorted: its windows are runs of it
    count = np.zeros(live.shape, np.int16)
    lo = np.searchsorted(of_b[order, 0], of_a[:, 0] - half, "left")
    hi = np.searchsorted(of_b[order, 0], of_a[:, 0] + half, "right")
    place = np.empty(len(b), np.int64)
    place[order] = np.arange(len(b))
    count += (place[None, :] >= lo[:, None]) & (place[None, :] < hi[:, None])
    for k in range(1, COUNTED):
        count += np.abs(of_a[:, k, None] - of_b[None, :, k]) <= half
    live &= count >= least
    if not live.any():
        return live
    live &= a @ b.T >= least_cosine
    if not live.any():
        return live
    keys_a, keys_b = tool.keys(a), tool.keys(b)
    for t in range(table):
        live &= keys_a[:, t, None] != keys_b[None, :, t]
    return live


def _links(blocks: DataFrame, least_cosine: float) -> DataFrame:
    """Pairs of blocks of a cell -> link counts (``u = v``) and a forest of the links."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for k in range(batch.num_rows):
                sides, same = [], not batch.column("b")[k].is_valid
                for side in ("a",) if same else ("a", "b"):
                    rows = batch.column(side)[k].values
                    vec = rows.field("vec")
                    sides.append((rows.field("node").to_numpy(), rows.field("weight").to_numpy(), unit_rows(vec, len(vec[0]))))
                (na, wa, xa), (nb, wb, xb) = sides[0], sides[-1]
                live = block_links(xa, xb, same, batch.column("place")[k].as_py(), least_cosine)
                if not live.any():
                    continue
                for nodes, counts in ((na, live @ wb), (nb, wa @ live)):
                    some = counts > 0
                    out += zip(nodes[some].tolist(), nodes[some].tolist(), counts[some].tolist(), strict=True)
                out += [(u, v, 0) for u, v in forest(na, nb, live)]
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u", "v", "n"])

    return blocks.mapInArrow(one, "u long, v long, n long")


def forest(na: np.ndarray, nb: np.ndarray, live: np.ndarray) -> list[tuple[int, int]]:
    """Links enough to join what the given ones join."""
    parent = {x: x for x in [*na.tolist(), *nb.tolist()]}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in np.flatnonzero(live.any(axis=1)).tolist():
        u = root(int(na[i]))
        for v in {root(x) for x in nb[live[i]].tolist()}:
            if u != v:
                parent[v] = u
                out.append((u, v))
    return out


def near_vectors(vectors: DataFrame, least_cosine: float = COSINE) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` -> ``vec_id, n_links, component_id, kept``, a row per row.

    Vectors are compared where labels are equal and not null, and dimensions equal;
    those that are null, empty, zero or hold null or non-finite components link
    with nothing, nor do rows with a null vec_id. Rows that repeat a vec_id are told
    apart by label and vector for links and share the component; equal vectors count
    as different vectors that are linked. No rows give no rows; other columns are ignored.

    A pair at the threshold is found with probability ``cell_recall() * (1 - MISSED)``, above
    0.999, a closer one with more; the README has measured figures."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound & F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.lit(False)))
    rows = rows.withColumn("code", F.when(F.col("sound"), F.sha2(F.to_json("vec"), 256)))
    # a node is a label's different vector: one vec_id may stand for several
    nodes = rows.where("sound").groupBy("label", "code").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight"), F.first("vec").alias("vec"))
    nodes = staged(nodes.withColumn("node", F.xxhash64("label", "code")), "nodes")
    cells = staged(_cells(nodes.select("label", "node", "vec")), "cells")
    counted = cells.groupBy("label", "place", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.expr(f"int((n + {BLOCK - 1}) div {BLOCK})"))
    # a block is a slice of a cell by hash: about BLOCK vectors, however large the cell
    kept = cells.join(counted, ["label", "place", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    kept = kept.join(nodes.select("node", "weight", "vec"), "node")
    where = ["label", "place", "cell"]

    def packed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*where, "block").agg(F.collect_list(F.struct("node", "weight", "vec")).alias("a"))

    alone = packed(kept)
    other = packed(kept.where("blocks > 1"))
    none = F.lit(None).cast(alone.schema["a"].dataType).alias("b")
    pairs = alone.where(F.size("a") > 1).select("place", "a", none).union(
        other.join(other.select(*where, F.col("block").alias("j"), F.col("a").alias("b")), where).where("block < j").select("place", "a", "b")
    )
    found = staged(_links(pairs, least_cosine), "found")
    counts = found.where("n > 0").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    # nodes that rows of one vec_id stand for have one component
    named = rows.where("sound").select("vec_id", F.xxhash64("label", "code").alias("node")).distinct()
    shared = named.groupBy("vec_id").agg(F.min("node").alias("u"), F.max("node").alias("w")).where("u < w").select("vec_id", "u")
    links = found.where("n = 0").select("u", "v").union(named.join(shared, "vec_id").where("u <> node").select("u", F.col("node").alias("v")))
    parts = staged(connected_components(links), "parts")
    own = nodes.select("label", "code", "node", "vec_id", "weight").join(counts, "node", "left").join(parts, "node", "left")
    own = staged(own.select("label", "code", "vec_id", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")), "linked")
    least = own.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    own = own.join(least, "component").select("label", "code", "weight", "links", "component_id")
    out = rows.select("vec_id", "label", "code").join(own, ["label", "code"], "left")
    out = out.select(
        "vec_id", F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


#: The same rows for DuckDB, from all pairs of a label.
OP3_SQL = f"""WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
sound AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pair AS (SELECT a.k AS a, b.k AS b, a.vec_id AS u, b.vec_id AS w FROM sound a JOIN sound b ON a.label = b.label AND a.k <> b.k AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT vec_id AS u, vec_id AS w FROM sound UNION SELECT r.u, p.w FROM reach r JOIN pair p ON p.u = r.w),
own AS (SELECT u, min(w) AS least FROM reach GROUP BY u), links AS (SELECT a, count(*) AS n FROM pair GROUP BY a)
SELECT v.vec_id, CAST(coalesce(links.n, 0) AS BIGINT) AS n_links, coalesce(CASE WHEN sound.k IS NOT NULL THEN own.least END, v.vec_id) AS component_id,
  coalesce(v.vec_id = coalesce(CASE WHEN sound.k IS NOT NULL THEN own.least END, v.vec_id), true) AS kept
FROM v LEFT JOIN links ON links.a = v.k LEFT JOIN own ON own.u = v.vec_id LEFT JOIN sound ON sound.k = v.k"""
