"""Operator 10: shards by proportional stratified interleaving.

Rows of each stratum (the source) get a rank in a seeded shuffle; all rows are
put in the order of their fractional rank ``(rank - 1/2) / rows of the stratum``,
and this order is cut into shards whose row counts are at most one apart. A run
of the order holds every stratum in proportion, so each shard has the mixture of
the whole.

No stratum is sorted in one task: ranks are counted within slices of the shuffle
hash (about ``SLICE`` rows each, however large the stratum) on top of the counts
of the slices before, and positions within slices of the fractional rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.staging import staged

SHARDS = 16
SEED = 17
SLICE = 500


def _offsets(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows before each slice of its group."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, slice_rows: int = SLICE) -> DataFrame:
    """``docs(doc_id, text, source)`` -> ``doc_id, size, text_crc32, source, shard, slot``.

    ``size`` is the UTF-8 length of the text plus 1; a null text counts as empty.
    A null source is a stratum of its own. A null doc_id is a value like others;
    rows that repeat a doc_id are separate rows, ordered by checksum and size, and
    equal rows are interchangeable. No rows give no rows. Other columns are ignored."""
    if shards < 1 or slice_rows < 1:
        raise ValueError("shards and slice_rows must be at least 1")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("h"),
    )
    total = docs.select(F.count(F.lit(1))).first()[0]
    slices = max(1, min(65536, total // slice_rows))
    rows = rows.withColumn("part", F.shiftright((F.shiftright("h", 48) + 32768) * slices, 16).cast("int"))
    keys = docs.select(
        F.col("source").cast("string").alias("source"),
        F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("h"),
    ).withColumn("part", F.shiftright((F.shiftright("h", 48) + 32768) * slices, 16).cast("int"))
    counts = keys.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"))
    sums = _offsets(counts, ["source"], "part").withColumn("of", F.sum("n").over(Window.partitionBy("source")))
    order = ["h", "doc_id", "text_crc32", "size"]
    ranked = (
        rows.withColumn("at", F.row_number().over(Window.partitionBy("source", "part").orderBy(*order)))
        .alias("r")
        .join(sums.alias("s"), F.expr("r.source <=> s.source and r.part = s.part"))
        .select("r.doc_id", "r.source", "r.size", "r.text_crc32", "r.h", ((2 * (F.col("ahead") + F.col("at")) - 1) / (2 * F.col("of"))).alias("fraction"))
        .withColumn("cut", F.floor(F.col("fraction") * slices).cast("int"))
    )
    ranked = staged(ranked, "ranked")
    cuts = _offsets(ranked.groupBy("cut").agg(F.count(F.lit(1)).alias("n")), [], "cut").select("cut", "ahead")
    within = Window.partitionBy("cut").orderBy("fraction", "source", *order)
    placed = ranked.withColumn("at", F.row_number().over(within)).join(cuts, "cut")
    position: Column = F.col("ahead") + F.col("at") - 1
    placed = placed.withColumn("position", position).withColumn("shard", F.expr(f"int(position * {shards} div {max(total, 1)})"))
    start = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}) div {shards}")
    return placed.select("doc_id", "size", "text_crc32", "source", "shard", (F.col("position") - start).alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; the law is equal row counts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return interleave(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
