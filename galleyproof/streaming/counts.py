"""Incremental counterparts: run counts over status events, and sessions of users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from galleyproof.operators.state import latest_rows


def stream_status_counts(events: DataFrame) -> DataFrame:
    """Counts of events by run and status; for update mode."""
    return events.groupBy("run_id", "status").agg(F.count("*").alias("n"))


def stream_sessions(events: DataFrame, idle_seconds: int = 1800, late: str = "1 hour") -> DataFrame:
    """``rollup.idle_sessions`` over a stream of (user_id, ts): (user_id, first_second, last_second, n_events); for append mode.

    A session comes out once the watermark, ``late`` behind the newest event, has passed its end.
    """
    timed = events.withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp"))).withWatermark("ts", late)
    # a window ends one gap after its last event, and an event at its very end still belongs to it
    counted = timed.groupBy("user_id", F.session_window("ts", f"{idle_seconds} seconds").alias("w")).agg(F.count("*").alias("n_events"))
    return counted.select("user_id", F.unix_timestamp("w.start").alias("first_second"), (F.unix_timestamp("w.end") - idle_seconds).alias("last_second"), "n_events")


def run_once(spark: SparkSession, folder: str, schema: StructType, path: str, checkpoint: str) -> DataFrame:
    """Read what is new in a folder of Parquet files, count it, and return the counts so far.

    Each batch writes the counts that it changed to its own folder under ``path``; a batch
    that is run again replaces its folder. The last count of a run and status holds.
    """

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    counts = stream_status_counts(spark.readStream.schema(schema).parquet(folder))
    query = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return latest_rows(spark.read.parquet(path), ["run_id", "status"], "batch", "batch").select("run_id", "status", "n")
