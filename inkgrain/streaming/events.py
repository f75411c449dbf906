"""Review events as a stream (section 2.11): append-only log, latest state, cool-off."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "ts timestamp, received_at timestamp, pass_ int, idx int, action string, value string, blind string, public_label string, pass1 string, warnings array<string>"


def read_events(spark: SparkSession, path: str, fmt: str = "json", files: int = 4) -> DataFrame:
    """The log as a stream of files with an explicit schema."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).format(fmt).load(path)


def latest_state(events: DataFrame) -> DataFrame:
    """``(idx, ts, pass_, action, value)``: the last event of each row of the sheet.  A late or
    repeated event changes nothing, so no watermark is needed; the state is one row an ``idx``."""
    cols = ["pass_", "action", "value"]
    last = F.max(F.struct("ts", "received_at", *cols)).alias("x")
    return events.groupBy("idx").agg(last).select("idx", "x.ts", *[f"x.{c}" for c in cols])


def hourly_actions(events: DataFrame, late: str = "10 days") -> DataFrame:
    """Events of each hour and action; events later than *late* are not waited for."""
    fresh = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["idx", "ts", "pass_", "action"])
    return fresh.groupBy(F.window("ts", "1 hour").alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "action", "n")


def keep_state(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run until the log is read, merging every batch's latest events into the table at *path*.

    A batch writes the merged table to its own folder ``batch=N``, complete once it holds
    ``_SUCCESS``; a batch run again after a failure writes the same folder again, so a restart
    neither loses nor doubles an event.
    """
    spark = events.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        old = read_state(spark, path, before=number)
        rows = batch.select("idx", "ts", "received_at", "pass_", "action", "value")
        if old is not None:
            rows = rows.unionByName(old)
        state = rows.groupBy("idx").agg(F.max(F.struct("ts", "received_at", "pass_", "action", "value")).alias("x")).select("idx", "x.*")
        state.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The table of the last complete batch (before a given one), or None."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    done = []
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if name.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            done.append(int(name[6:]))
    done = [n for n in done if before is None or n < before]
    return spark.read.parquet(f"{path}/batch={max(done)}") if done else None
