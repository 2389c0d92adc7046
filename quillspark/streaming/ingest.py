"""Streaming form of ingestion: redelivered items dropped, micro-batches merged into a store, counts by sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.streaming.store import ItemStore


def once(batches: DataFrame, *, at: str = "fetched_at", late: str = "1 day", key: str = "fingerprint") -> DataFrame:
    """Each key once while redelivery can be expected: state is held until ``late`` after a key's first row, then dropped.

    A key that comes again after that counts as new, and the store settles it: merging is idempotent but for last_seen_at.
    On a batch table every key stays once, its earliest row.
    """
    if not batches.isStreaming:
        first = batches.groupBy(key).agg(F.min(F.struct(at, F.struct(*batches.columns))).alias("r"))
        return first.select("r.col2.*")
    return batches.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def merge_stream(batches: DataFrame, store: ItemStore, checkpoint: str, now: Column | None = None) -> StreamingQuery:
    """Append every micro-batch to the store as a delta; the store compacts itself now and then.

    A micro-batch writes its own rows alone, and readers of the store see a whole state. All input there is, then
    stop: an outside scheduler starts the next run.
    """

    def append(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.append(batch, now if now is not None else F.current_timestamp())

    return batches.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, *, at: str = "ts", by: str = "event_type", width: str = "7 days", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts by window, tumbling or sliding, with a watermark; the same expression serves batch and stream.

    In a stream a row goes uncounted in the windows that end before the watermark: ``late`` behind the latest row of all
    micro-batches but the present and the last one. A batch has no such rows.
    """
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return events.withWatermark(at, late).groupBy(window, by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def lookback_counts(items: DataFrame, *, at: str = "date", by: tuple[str, ...] = ("country", "domain"), late: str = "1 day") -> DataFrame:
    """Signals of the 7 days that end with each day, and of the 7 and 30 days before those, as a sliding count kept up in a stream.

    One row for each day and group: the day, last7, previous7, previous30. Every row counts in the days that look back to it.
    """
    day = F.col(at).cast("timestamp")
    rows = items.withColumn("__at", day).withWatermark("__at", late)
    # The window of a day is the 37 days that end with it; a row of its last 7, the 7 before or the 30 before is told by its age.
    spread = rows.select(*by, "__at", F.window("__at", "37 days", "1 day").alias("__w"))
    back = F.datediff(F.date_sub(F.col("__w.end"), 1), F.to_date("__at"))
    counted = spread.withColumn("__b", back).groupBy("__w", *by).agg(F.count_if(F.col("__b") < 7).alias("last7"), F.count_if((F.col("__b") >= 7) & (F.col("__b") < 14)).alias("previous7"), F.count_if(F.col("__b") >= 7).alias("previous30"))
    return counted.select(F.date_sub(F.col("__w.end"), 1).alias("day"), *by, "last7", "previous7", "previous30")
