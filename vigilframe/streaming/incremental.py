"""Version-gated rescans, and streams over the event log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
VERSION = "version string, sequence long"


def rescan_summary(prior: DataFrame, after: DataFrame) -> DataFrame:
    """new_hits, cleared, kept pairs between two sets of (customer_id, entity_id)."""
    pairs = ["customer_id", "entity_id"]
    both = prior.select(*pairs).distinct().withColumn("p", F.lit(1)).join(after.select(*pairs).distinct().withColumn("a", F.lit(1)), pairs, "full")
    return both.agg(F.count_if(F.col("p").isNull()).alias("new_hits"), F.count_if(F.col("a").isNull()).alias("cleared"), F.count_if(F.col("p").isNotNull() & F.col("a").isNotNull()).alias("kept"))


def sync_watchlist(last_version: str | None, version: str, rescan: Callable[[], None], remember: Callable[[str], None]) -> bool:
    """Rescan if the version is another than the last; it is remembered only after the rescan has ended."""
    if version == last_version:
        return False
    rescan()
    remember(version)
    return True


def watch_versions(spark: SparkSession, folder: str, checkpoint: str, on_version: Callable[[str, int], None], current: Callable[[], int], every: str | None = None) -> StreamingQuery:
    """A stream over JSON version files that calls on_version for the newest of a batch, if its sequence is above the current
    one: older and repeated versions do nothing, so a batch that runs twice is harmless. Without `every` it takes what is
    there and ends."""

    def each(batch: DataFrame, _: int) -> None:
        newest = batch.orderBy(F.desc("sequence")).first()
        if newest is not None and newest["sequence"] > current():
            on_version(newest["version"], newest["sequence"])

    writer = spark.readStream.schema(VERSION).json(folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def latest_state(events: DataFrame, key: list[str], state: str, order: list[str]) -> DataFrame:
    """The last state of each key, by order."""
    return events.groupBy(*key).agg(F.max_by(state, F.struct(*order)).alias(state), F.max(F.struct(*order)).alias("last"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and values by window and type; works on a stream (late events are dropped after `late`) and on a table."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    got = source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_stream(spark: SparkSession, folder: str, per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_batch).parquet(folder)


def append_events(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The append-only log: exactly once, since the file sink's own log decides what was written."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
