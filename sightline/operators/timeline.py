"""Appearance intervals: gap sessions of each identity, padded, clamped, merged.

All identities of all videos are computed at once with window functions partitioned by
identity.  An identity's rows are first reduced to its distinct times, and spans to
their bounds, so both windows run over few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import clamp

GAP_SAMPLES = 2.0
PADDING_SAMPLES = 0.5


def settings(sample_interval: float, gap: float | None = None, padding: float | None = None) -> tuple[float, float]:
    """Gap tolerance and padding in seconds, checked; defaults are 2 and 0.5 samples."""
    if sample_interval <= 0:
        raise ValueError(f"samples lie more than 0 seconds apart, not {sample_interval}")
    gap = GAP_SAMPLES * sample_interval if gap is None else gap
    padding = PADDING_SAMPLES * sample_interval if padding is None else padding
    if gap < 0:
        raise ValueError(f"a gap can't be negative: {gap}")
    if padding < 0:
        raise ValueError(f"a padding can't be negative: {padding}")
    return float(gap), float(padding)


def raw_spans(times: DataFrame, keys: list[str], gap: float, ts: str = "ts") -> DataFrame:
    """``keys, span_no, first_ts, last_ts, n``: rows at most ``gap`` apart are one span."""
    per_time = times.where(F.col(ts).isNotNull()).groupBy(*keys, F.col(ts).alias("__t")).agg(F.count("*").alias("__n"))
    order = Window.partitionBy(*keys).orderBy("__t")
    fresh = F.when(F.col("__t") - F.lag("__t").over(order) <= F.lit(gap), 0).otherwise(1)
    marked = per_time.withColumn("__fresh", fresh)
    numbered = marked.withColumn("span_no", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "span_no").agg(F.min("__t").alias("first_ts"), F.max("__t").alias("last_ts"), F.sum("__n").alias("n"))


def padded_spans(spans: DataFrame, padding: float, duration) -> DataFrame:
    """Spans with ``start_time`` and ``end_time``, padded and cut to [0, duration]."""
    end = duration if not isinstance(duration, (int, float)) else F.lit(float(duration))
    return spans.withColumns({"start_time": clamp(F.col("first_ts") - F.lit(padding), 0.0, end), "end_time": clamp(F.col("last_ts") + F.lit(padding), 0.0, end)})


def merged_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, appearance_no, start_time, end_time``: overlapping or touching spans are one."""
    order = Window.partitionBy(*keys).orderBy("start_time", "end_time")
    before = F.max("end_time").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__fresh", F.when(F.col("start_time") <= before, 0).otherwise(1))
    numbered = marked.withColumn("appearance_no", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return numbered.groupBy(*keys, "appearance_no").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))


def appearance_intervals(times: DataFrame, keys: list[str], duration, sample_interval: float, gap: float | None = None, padding: float | None = None, ts: str = "ts") -> DataFrame:
    """Intervals of every identity; ``duration`` is seconds or the name of one of ``keys``' columns.

    Null times are ignored; an identity without times has no interval; a detection past
    the duration gives an interval of length 0 at its end.
    """
    gap, padding = settings(sample_interval, gap, padding)
    if isinstance(duration, (int, float)):
        if duration < 0:
            raise ValueError(f"a duration can't be negative: {duration}")
    else:
        duration = F.col(duration)
    return merged_spans(padded_spans(raw_spans(times, keys, gap, ts), padding, duration), keys)


def with_duration(videos: DataFrame, frames: DataFrame, key: str = "video_id", ts: str = "ts") -> DataFrame:
    """Videos with ``duration`` filled from the last sampled time where it is null."""
    last = frames.groupBy(key).agg(F.max(ts).alias("__last"))
    return videos.join(last, key, "left").withColumn("duration", F.coalesce("duration", "__last")).drop("__last")
