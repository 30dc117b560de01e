"""Stand-ins for videos in tables without any: events as timelines, embeddings as faces.

Every formula is integer or exact decimal arithmetic, so that SQL says the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import box

#: Seconds since 1970 of the first event's day.
EPOCH = 1704067200.0
PER_FRAME = 4
FRAMES_PER_VIDEO = 50


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, user_id, event_type, t`` with ``t`` in seconds."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / F.lit(1e6) - F.lit(EPOCH)
    return rows.select("event_id", "user_id", "event_type", "value", t.alias("t"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four boxes a frame from ``embeddings``; 50 frames are a video of 2000 x 400 pixels."""
    v = F.col("vec_id")
    x0, y0 = (v % 4) * 220 + (v * 7) % 60, (v * 11) % 50
    frame = F.floor(v / PER_FRAME)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(
        F.floor(frame / FRAMES_PER_VIDEO).cast("string").alias("video_id"), v.alias("obs_id"), (frame % FRAMES_PER_VIDEO).alias("frame_index"), (v % PER_FRAME).cast("int").alias("det_index"),
        ((frame % FRAMES_PER_VIDEO) * F.lit(0.25)).alias("ts"), box(x0, y0, x0 + 120 + (v * 13) % 40, y0 + 120 + (v * 5) % 40).alias("box"),
        (F.lit(0.5) + ((v * 29) % 50) / F.lit(100.0)).alias("confidence"), "embedding", "label")


def videos(obs: DataFrame) -> DataFrame:
    """A row per video; duration one sample past its last frame."""
    return obs.groupBy("video_id").agg((F.max("ts") + 0.25).alias("duration")).withColumns({"width": F.lit(2000), "height": F.lit(400)})
