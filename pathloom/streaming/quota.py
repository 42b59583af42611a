"""Quotas, costs and sessions over time, as batch plans and as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sliding_counts(events: DataFrame, key: str = "user_id", time: str = "ts") -> DataFrame:
    """Every event with the number of its key's events in the hour and the day up to it; an
    event exactly that long ago no longer counts.  A key's events stream through a window
    whose buffer spills, in the order of time."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("__at")
    hour, day = 3_600_000_000, 86_400_000_000
    return (
        events.withColumn("__at", at)
        .withColumn("n_hour", F.count(F.lit(1)).over(w.rangeBetween(-hour + 1, 0)))
        .withColumn("n_day", F.count(F.lit(1)).over(w.rangeBetween(-day + 1, 0)))
        .drop("__at")
    )


def over_quota(events: DataFrame, per_hour: int, per_day: int, key: str = "user_id", time: str = "ts") -> DataFrame:
    counted = sliding_counts(events, key, time)
    return counted.withColumn("limited", (F.col("n_hour") > per_hour) | (F.col("n_day") > per_day))


#: Dollars for a million tokens.
PRICES = {"input": 3.0, "output": 15.0, "cache_write": 3.75, "cache_read": 0.30}


def cost(input_tokens: Column, output_tokens: Column, cache_write: Column | None = None, cache_read: Column | None = None) -> Column:
    total = input_tokens * PRICES["input"] + output_tokens * PRICES["output"]
    if cache_write is not None:
        total = total + cache_write * PRICES["cache_write"]
    if cache_read is not None:
        total = total + cache_read * PRICES["cache_read"]
    return total / 1_000_000


def daily_cost(events: DataFrame, amount: Column, time: str = "ts") -> DataFrame:
    """day, n, cost: a tumbling window of a day, of event time."""
    return events.groupBy(F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("cost"))


def sessions(events: DataFrame, gap_minutes: int = 30, key: str = "user_id", time: str = "ts") -> DataFrame:
    """key, session, start, end, n: runs of events no further apart than the gap."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("__at", "event_id")
    new = F.when(F.col("__at") - F.lag("__at").over(w) <= gap_minutes * 60_000_000, 0).otherwise(1)
    marked = events.withColumn("__at", at).withColumn("__new", new).withColumn("session", F.sum("__new").over(w))
    return marked.groupBy(key, "session").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n"))


# --- streams ---------------------------------------------------------------------


def windowed_counts(stream: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes", key: str = "event_type", time: str = "ts") -> DataFrame:
    """Counts and sums per window of event time and key; events later than ``late`` are
    dropped, and a window's row is final once the watermark has passed it."""
    s = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return s.groupBy(w, key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "value")


def session_counts(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id", time: str = "ts") -> DataFrame:
    s = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return s.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def distinct_events(stream: DataFrame, late: str = "10 minutes", key: str = "event_id", time: str = "ts") -> DataFrame:
    """Events once each, as far as the watermark reaches back."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write all that is there now to Parquet, exactly once, and stop."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
