"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, or the folder set on
    the context. Where neither is set, one is made in local mode, as in tests; on a
    cluster no folder of one machine would do, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet (by the session's codec, or another one) in the shared
    folder and read it back.

    What is read back survives the loss of any executor, and its plan starts at
    the written files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """The rows over as many tasks as a shuffle has: for few rows that many are made of, as a
    small file comes as one task, which would then make them all."""
    spark = rows.sparkSession
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(many, *by)


#: Rows of a batch for a Python task where only rows are counted. Packed rows hold at most as many pixels each, so
#: a batch of them is some 100 MB at most.
COUNTED_ROWS = 2048
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
_COUNTED = {_ROWS: str(COUNTED_ROWS), _BYTES: f"{(1 << 31) - 1}b"}


def counted_batches(spark: SparkSession) -> None:
    """Let the session cut what it sends to Python tasks by rows alone, for tables of small rows: Spark
    measures the batch at each row for a limit of bytes, which costs several times as much as sending a pixel. A
    limit of bytes, or fewer rows, that the session has been given stay."""
    if not 0 < int(spark.conf.get(_ROWS)) <= COUNTED_ROWS:
        spark.conf.set(_ROWS, _COUNTED[_ROWS])
    if spark.conf.get(_BYTES, None) is None:
        spark.conf.set(_BYTES, _COUNTED[_BYTES])


def measured_batches(spark: SparkSession) -> None:
    """Undo :func:`counted_batches`, for tables of texts."""
    for name, value in _COUNTED.items():
        if spark.conf.get(name, None) == value:
            spark.conf.unset(name)


def dense_numbers(df: DataFrame) -> DataFrame:
    """The rows, staged, with ``number``: 0, 1, 2 ... in no particular order. Only the numbers of
    rows of the partitions are put in order in one task."""
    at = F.col("__at")
    rows = staged(df.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumns({"__part": F.shiftright(at, 33), "__place": at.bitwiseAND((1 << 33) - 1)}).drop("__at")
    counts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = staged(counts.select("__part", ahead.alias("__ahead")), "counts")
    return rows.join(counts, "__part").withColumn("number", F.col("__ahead") + F.col("__place")).drop("__part", "__place", "__ahead")


def drop_staged(df: DataFrame) -> None:
    """Remove the files behind a frame that :func:`staged` returned."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
