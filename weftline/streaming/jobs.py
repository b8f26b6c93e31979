"""Structured Streaming twins: tumbling counts, sessions, last-writer-wins, running counters, outbox."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_of(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling_counts(events: DataFrame, when: str, kind: str, width: str, late: str = "1 hour") -> DataFrame:
    """(start, kind, n) per window; events later than the watermark are dropped by the stream."""
    t = events.withColumn("__t", F.col(when).cast("timestamp"))
    g = t.withWatermark("__t", late).groupBy(F.window("__t", width), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), "kind", "n")


def sliding_counts(events: DataFrame, when: str, kind: str, width: str, step: str, late: str = "1 hour") -> DataFrame:
    t = events.withColumn("__t", F.col(when).cast("timestamp"))
    g = t.withWatermark("__t", late).groupBy(F.window("__t", width, step), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), "kind", "n")


def sessions(events: DataFrame, when: str, who: str, gap: str, late: str = "1 hour") -> DataFrame:
    """(who, start, n): runs of events with no pause as long as the gap."""
    t = events.withColumn("__t", F.col(when).cast("timestamp"))
    g = t.withWatermark("__t", late).groupBy(F.session_window("__t", gap), F.col(who).alias("who")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("who", F.col("session_window.start").alias("start"), "n")


def running_counts(events: DataFrame, key: str) -> DataFrame:
    """Counters that each micro-batch adds to, for update mode."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def last_writer_wins(rows: DataFrame, key: list[str], when: str) -> DataFrame:
    """The newest row of each key: late older versions change nothing."""
    rest = [c for c in rows.columns if c not in key]
    g = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(when)).alias("r"))
    return g.select(*key, "r.*")


def start(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs what is there to its end, each micro-batch through a sink that gets its number. With the
    checkpoint a batch that was committed is not seen again, so a sink keyed by the number is exactly-once."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


def outbox(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own number: a repeated batch replaces itself."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return write
