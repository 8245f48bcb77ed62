"""Idle gaps of call activity (Z2), as a batch report and as a stream."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

WARNING_SECONDS = 90
IDLE_SECONDS = 120
TOTAL_SECONDS = 600


def _seconds(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(1_000_000.0)


def idle_gaps(activity: DataFrame, key: list[str], ts: str = "ts", block: str = "1 day") -> DataFrame:
    """Per call: activities, longest gap, warnings, and whether the idle or total limit was passed.

    Gaps inside a time block are found per (call, block); only the first and last moment of each
    block meet across blocks, so a call with very many activities is not one task.
    """
    rows = activity.select(*key, F.col(ts).alias("ts"), F.window(F.col(ts), block)["start"].alias("_b"))
    inside = Window.partitionBy(*key, "_b").orderBy("ts")
    gaps = rows.withColumn("gap", _seconds(F.lag("ts").over(inside), F.col("ts")))
    measures = lambda gap: [
        F.max(gap).alias("g_max"), F.count_if(gap >= WARNING_SECONDS).alias("g_warn"), F.count_if(gap >= IDLE_SECONDS).alias("g_idle")]
    blocks = gaps.groupBy(*key, "_b").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), *measures(F.col("gap")))
    across = Window.partitionBy(*key).orderBy("_b")
    seam = _seconds(F.lag("last").over(across), F.col("first"))
    blocks = blocks.withColumn("seam", seam)
    flag = lambda limit: F.when(F.col("seam") >= limit, 1).otherwise(0)
    total = _seconds(F.min("first"), F.max("last"))
    return blocks.groupBy(*key).agg(
        F.sum("n").alias("activities"), F.greatest(F.max("g_max"), F.max("seam")).alias("max_idle_seconds"),
        F.sum(F.col("g_warn") + flag(WARNING_SECONDS)).alias("warnings"),
        (F.sum(F.col("g_idle") + flag(IDLE_SECONDS)) > 0).alias("stream_idle"), (total >= TOTAL_SECONDS).alias("total_exceeded"))


def idle_sessions(stream: DataFrame, key: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Stream form: a session ends after IDLE_SECONDS without activity; one row per closed session.

    Null times belong to no session. A session is closed, and its row appended, when the watermark
    passes its end; what is open when a finite stream ends needs `run_to_end`.
    """
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    window = F.session_window(F.col(ts), f"{IDLE_SECONDS} seconds")
    return stream.withWatermark(ts, late).groupBy(*key, window.alias("s")).agg(F.count(F.lit(1)).alias("activities")).select(
        *key, F.col("s.start").alias("started"), (F.col("s.end") - F.expr(f"INTERVAL {IDLE_SECONDS} SECONDS")).alias("last_activity"), "activities")


def run_to_end(spark: SparkSession, source: str, work: str, key: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Sessions of the activity in `source` (Parquet files, a path or pattern), all of them, each once.

    The stream reads the activity and a folder for a closing row below `work`. It takes what is there;
    then one closing row, later than all activity, goes to that folder and the same query goes on from
    its checkpoint. The row moves the watermark past every open session, so the state store emits them by
    the same rule as all others; its own session stays open and is never written. A repeated call finds
    the row and the checkpoint and adds nothing. Activity that comes after the row is late by definition.
    """
    known = spark.read.parquet(source).select(*key, ts)
    shape, closing = known.schema, f"{work}/closing"
    spark.createDataFrame([], shape).write.mode("ignore").parquet(f"{closing}/none")
    activity = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source).select(*key, ts)
    ends = spark.readStream.schema(shape).parquet(f"{closing}/*")

    def run() -> None:
        sessions = idle_sessions(activity.unionByName(ends), key, ts, late)
        sessions.writeStream.format("parquet").option("path", f"{work}/sessions").option("checkpointLocation", f"{work}/checkpoint").trigger(
            availableNow=True).start().awaitTermination()
    run()
    last = known.agg(F.max(F.col(ts).cast("timestamp")).alias("last")).filter("last is not null")
    after = F.col("last") + F.expr(f"INTERVAL {late}") + F.expr(f"INTERVAL {2 * IDLE_SECONDS} SECONDS")
    row = last.select(*[F.lit(None).cast(shape[k].dataType).alias(k) for k in key], after.cast(shape[ts].dataType).alias(ts))
    row.coalesce(1).write.mode("ignore").parquet(f"{closing}/row")
    run()
    keys = "".join(f"{k} {shape[k].dataType.simpleString()}, " for k in key)
    return spark.read.schema(keys + "started timestamp, last_activity timestamp, activities bigint").parquet(f"{work}/sessions")
