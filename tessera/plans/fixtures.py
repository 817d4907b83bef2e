"""Rasters derived from the ``part`` table by integer formulas, in Spark and as SQL.

Every part gives one 32x32 image: a purple diamond (with a hole for every third part)
on a green ground whose shade varies. The cutout variant has a transparent ground with
speckles and a faint wash. ``matte`` makes 8x8 masks of embeddings."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.packing import by_part
from tessera.plans.staging import dealt, new_path
from tessera.sources.files import located, reached

SIDE = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"))


def pixels(spark: SparkSession, sf_dir: str, cutout: bool = False) -> DataFrame:
    """``image_id, y, x, r, g, b, a`` of every part."""
    k = F.col("k")
    side = F.sequence(F.lit(0), F.lit(SIDE - 1))
    rows = dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size")), "k")
    rows = rows.withColumn("y", F.explode(side)).withColumn("x", F.explode(side))
    far = F.abs(F.col("x") - (11 + k * 5 % 10)) + F.abs(F.col("y") - (11 + k * 3 % 10))
    rows = rows.withColumn("far", far).withColumn("reach", 5 + F.col("size") % 6).withColumn("n", (F.col("x") * 3 + F.col("y") * 11 + k * 2) % 13 - 6)
    rows = rows.withColumn("subject", (F.col("far") < F.col("reach")) & ~((k % 3 == 0) & (F.col("far") * 2 < F.col("reach"))))
    if cutout:
        faint = F.when((F.col("x") * 4 + F.col("y") * 9 + k) % 47 == 0, 2).otherwise(0)
        alpha = F.when(F.col("subject"), 255).when((F.col("x") * 23 + F.col("y") * 29 + k) % 89 == 0, 180).otherwise(faint)
    else:
        alpha = F.lit(255)
    ground = {"r": 24 + F.col("n"), "g": 170 + F.col("n"), "b": 36 - F.col("n")}
    subject = {"r": 150, "g": 40, "b": 120}
    return rows.select(k.alias("image_id"), "y", "x", *(F.when(F.col("subject"), subject[c]).otherwise(ground[c]).cast("int").alias(c) for c in "rgb"), alpha.cast("int").alias("a"))


def png(width: int, height: int, rgba: bytes) -> bytes:
    """A PNG file of 8-bit pixels with alpha."""
    lines = b"".join(b"\0" + rgba[y * width * 4 : (y + 1) * width * 4] for y in range(height))
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


#: Files in a folder of :func:`png_files`.
FOLDER_FILES = 20_000


def png_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with folders of PNG files, one of each part's cutout, written by tasks; every fiftieth is cut off."""
    path, many = new_path(spark, "png"), -(-images(spark, sf_dir).count() // FOLDER_FILES) or 1
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for n in range(many):
        system.mkdirs(at(path, str(n)))
    address = located(spark, path)[1][0]

    def write(rows: pa.Table) -> pa.Table:
        rows, (files, top) = rows.sort_by([("y", "ascending"), ("x", "ascending")]), reached(address)
        key, folder = rows.column("image_id")[0].as_py(), rows.column("folder")[0].as_py()
        data = png(SIDE, SIDE, np.stack([rows.column(c).to_numpy() for c in "rgba"], axis=1).astype(np.uint8).tobytes())
        with files.open_output_stream(f"{top}/{folder}/{key}.png") as out:  # a repeated task writes the same again
            out.write(data[:10] if key % 50 == 7 else data)
        return rows.select(["image_id"]).slice(0, 0)

    rows = pixels(spark, sf_dir, True).withColumn("folder", F.pmod(F.hash("image_id"), F.lit(many)))
    by_part(rows, ["image_id", "folder"], write, "image_id long").write.format("noop").mode("overwrite").save()
    return path


def matte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, y, x, a``: an 8x8 mask of each embedding."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "v"))
    value = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("v").cast("double") + 0.25) * 512)))
    return rows.select("image_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), value.cast("int").alias("a"))


#: The same tables as common table expressions: spots, px (opaque), cut (cutout).
PIXELS_SQL = """
spots AS (SELECT p_partkey AS k, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, (x * 3 + y * 11 + p_partkey * 2) % 13 - 6 AS n,
  abs(x - (11 + p_partkey * 5 % 10)) + abs(y - (11 + p_partkey * 3 % 10)) AS far, 5 + p_size % 6 AS reach FROM part CROSS JOIN range(32) AS ty(y) CROSS JOIN range(32) AS tx(x)),
marked AS (SELECT *, far < reach AND NOT (k % 3 = 0 AND far * 2 < reach) AS subject FROM spots),
px AS (SELECT k AS image_id, y, x, CAST(CASE WHEN subject THEN 150 ELSE 24 + n END AS INTEGER) AS r, CAST(CASE WHEN subject THEN 40 ELSE 170 + n END AS INTEGER) AS g,
  CAST(CASE WHEN subject THEN 120 ELSE 36 - n END AS INTEGER) AS b, 255 AS a FROM marked),
cut AS (SELECT k AS image_id, y, x, CAST(CASE WHEN subject THEN 150 ELSE 24 + n END AS INTEGER) AS r, CAST(CASE WHEN subject THEN 40 ELSE 170 + n END AS INTEGER) AS g,
  CAST(CASE WHEN subject THEN 120 ELSE 36 - n END AS INTEGER) AS b, CASE WHEN subject THEN 255 WHEN (x * 23 + y * 29 + k) % 89 = 0 THEN 180
  WHEN (x * 4 + y * 9 + k) % 47 = 0 THEN 2 ELSE 0 END AS a FROM marked)"""


def digest(df: DataFrame, channels: str = "rgba") -> DataFrame:
    """A row for each image: the number of pixels and a weighted sum of every channel."""
    at = F.col("y") * 64 + F.col("x") + 1
    return df.groupBy("image_id").agg(F.count(F.lit(1)).alias("pixels"), *(F.sum(F.col(c) * at).cast("long").alias(f"{c}_sum") for c in channels))


def digest_sql(name: str, channels: str = "rgba") -> str:
    sums = ", ".join(f"CAST(sum({c} * (y * 64 + x + 1)) AS BIGINT) AS {c}_sum" for c in channels)
    return f"SELECT image_id, count(*) AS pixels, {sums} FROM {name} GROUP BY image_id"
