"""Usage counters over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators.snapshots import SnapshotStore


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, event_type, n, total) for a batch or a stream of events (ts, event_type, value).

    On a stream, days are tumbling windows under a watermark; a zone-less ``ts`` is read as
    UTC. Events without a time count for no day.
    """
    at = events.where("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        at = at.withWatermark("ts", late)
    w = at.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


def run_to_end(stream: DataFrame, root: str, checkpoint: str) -> DataFrame:
    """Process all that is there and return the table of counts, kept as generations under ``root``.

    The query runs in update mode, so days older than the watermark leave the state and later
    rows of theirs are dropped. Each batch replaces the days that it changed; a batch that is
    run again after a failure changes nothing.
    """
    store = SnapshotStore(stream.sparkSession, root)

    def merge(df: DataFrame, batch: int) -> None:
        if store.current()["notes"].get("batch", -1) >= batch:
            return
        df = df.persist()
        try:
            keys = ["day", "event_type"]
            new = store.read("daily").join(df.select(*keys), keys, "left_anti").unionByName(df) if store.has("daily") else df
            store.publish({"daily": new}, notes={"batch": batch})
        finally:
            df.unpersist()

    q = stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(merge).start()
    q.awaitTermination()
    return store.read("daily")


def sessions(events: DataFrame, user: str, gap: str) -> DataFrame:
    """(user, started, ended, n): sessions of a user's events that are less than ``gap`` apart."""
    at = events.where("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    s = at.groupBy(user, F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))
    return s.select(user, "started", "ended", "n")


def record(spark: SparkSession, root: str, rows: list[tuple[str, bool, int, int]]) -> None:
    """Append usage events (command, success, duration_ms, results) with the time of writing; appends of several writers do not collide."""
    df = spark.createDataFrame(rows, "command string, success boolean, duration_ms long, results long")
    df.withColumn("ts", F.current_timestamp()).write.mode("append").parquet(root)


def history(spark: SparkSession, root: str, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(daily counters of the last ``days`` days up to the newest, lifetime counters) of recorded events by command."""
    e = spark.read.parquet(root).withColumn("day", F.to_date("ts"))
    counters = [F.count("*").alias("runs"), F.count_if("success").alias("succeeded"), F.sum("duration_ms").alias("duration_ms"), F.sum("results").alias("results")]
    newest = e.agg(F.max("day").alias("newest"))
    daily = e.join(F.broadcast(newest), F.datediff("newest", "day") < days).groupBy("day", "command").agg(*counters)  # one row
    return daily, e.groupBy("command").agg(*counters)
