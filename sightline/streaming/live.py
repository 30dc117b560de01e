"""Structured Streaming: open-ended sessions of sightings and an incremental tracker."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tracking import LinkState, TrackerSettings, flat_observations, fold_frames


def live_spans(sightings: DataFrame, keys: list[str], gap_seconds: float, lateness: str = "1 minute", ts: str = "ts") -> DataFrame:
    """Raw spans of a stream (or a table): ``keys, first_ts, last_ts, n``.

    ``ts`` is a timestamp.  Sightings exactly ``gap_seconds`` apart share a span.  A span
    is emitted when the watermark passes its last sighting by the gap.
    """
    window = F.session_window(ts, f"{int(gap_seconds * 1_000_000)} microseconds")
    spans = sightings.withWatermark(ts, lateness).groupBy(*keys, window).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))
    return spans.drop("session_window")


def live_tracks(observations: DataFrame, settings: TrackerSettings | None = None) -> DataFrame:
    """``video_id, track_id, seq, obs_id`` as frames arrive, state per video.

    Frames of a video must arrive in order from batch to batch, whole frames at a time;
    inside a batch they are sorted.  The state is the live tracks, bounded by the gap.
    Nulls are taken as ``track_members`` takes them.
    """
    settings = settings or TrackerSettings()

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        links = pickle.loads(state.get[0]) if state.exists else LinkState()
        rows = pd.concat(list(batches)).sort_values(["frame_index", "det_index"], kind="stable")
        out = fold_frames(links, rows, settings)
        state.update((pickle.dumps(links),))
        yield out.assign(video_id=key[0])[["video_id", "track_id", "seq", "obs_id"]]

    flat = flat_observations(observations)
    return flat.groupBy("video_id").applyInPandasWithState(step, "video_id string, track_id bigint, seq bigint, obs_id bigint", "links binary", "append", "NoTimeout")
