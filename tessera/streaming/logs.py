"""Log feeds, as filters for tables and as streams over a folder of JSON Lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.jsonops import redact, redact_json
from tessera.sources.files import LOG_SCHEMA


def enabled(value: str | None) -> bool:
    """Whether a setting is ``1`` or ``true``, whatever its case and the blanks around it."""
    return (value or "").strip().lower() in ("1", "true")


def progress(entries: DataFrame) -> DataFrame:
    """Every entry but errors; an entry without a level counts as none."""
    return entries.where(F.coalesce("level", F.lit("")) != "error")


def persisted(entries: DataFrame, debug: str | None = None) -> DataFrame:
    """All entries, debug ones only if enabled, with the secrets in ``data`` (a struct, a map, or JSON
    text) redacted. Data that is no JSON is replaced whole; a VARIANT is an error."""
    rows = entries if enabled(debug) else entries.where(F.coalesce("level", F.lit("")) != "debug")
    if dict(entries.dtypes)["data"] == "string":
        return rows.withColumn("data", redact_json(F.col("data")))
    return redact(rows, ["data"])


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LOG_SCHEMA).json(path)


def log_progress_stream(spark: SparkSession, path: str) -> DataFrame:
    return progress(log_stream(spark, path))


def log_persist_stream(spark: SparkSession, path: str, out: str, checkpoint: str, debug: str | None = None) -> StreamingQuery:
    """Start writing the persisted feed; what is there is read, then the query ends."""
    rows = persisted(log_stream(spark, path), debug)
    return rows.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failure_notices(failures: DataFrame, delay: str = "1 hour") -> DataFrame:
    """``time, path, ...``: the first failure of each path. The stream forgets a path that failed
    last more than ``delay`` before the watermark, so its state is bounded; a stream that is started
    again from its checkpoint still knows the others."""
    return failures.withWatermark("time", delay).dropDuplicatesWithinWatermark(["path"])


def notify(entries: DataFrame, callback: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Call ``callback(batch)`` with each batch of a feed, a DataFrame; what is there is read, then the query ends.

    A stream that stops between a call and its own record of the batch has the batch again when it
    is started from its checkpoint. So each call that came back is marked by the batch's number beside
    the checkpoint, which driver and executors share, and a marked batch isn't called again. A call
    that failed, or was cut off, isn't marked and is repeated."""
    spark = entries.sparkSession

    def once(batch: DataFrame, number: int) -> None:
        mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}-calls/{number}")
        system = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(mark):
            callback(batch)
            system.create(mark, True).close()

    return entries.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
