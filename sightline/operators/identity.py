"""Identities: tracks grouped online by similarity to running centroids.

A track joins the most similar group if that clears the similarity threshold and leads
the runner-up by the margin; else it starts one.  The result depends on the order of
tracks (start time, then number), so this too is a fold, one per video.  A group keeps
the sum and count of its vectors: its centroid needs no second look at its members.
Rows are exchanged by video and sorted once, then streamed: a task holds one Arrow
batch, one track and the centroids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import quality
from .filters import MIN_CONFIDENCE, MIN_SIDE, is_reliable
from .tracking import keys_of, runs, whole_runs


@dataclass(frozen=True)
class GrouperSettings:
    similarity_threshold: float = 0.45
    margin_threshold: float = 0.05
    min_confidence: float = MIN_CONFIDENCE
    min_side: int = MIN_SIDE

    def __post_init__(self):
        if not -1.0 <= self.similarity_threshold <= 1.0:
            raise ValueError(f"a similarity threshold lies between -1 and 1, not at {self.similarity_threshold}")
        if self.margin_threshold < 0.0:
            raise ValueError(f"a margin can't be negative: {self.margin_threshold}")


def unit_mean(total: np.ndarray, count: int) -> np.ndarray:
    mean = total / count
    length = float(np.linalg.norm(mean))
    return (mean / length if length > 0 else mean).astype(np.float32)


class Leaders:
    """Groups as rows of a growing matrix of centroids."""

    def __init__(self, settings: GrouperSettings):
        self.settings, self.used = settings, 0
        self.centroids = self.sums = None
        self.counts: list[int] = []

    def add(self, vector: np.ndarray) -> int:
        """Group number of a single reliable vector."""
        return self.place(np.asarray(vector, np.float32)[None])

    def place(self, vectors: np.ndarray) -> int:
        """Group number (from 1) of a unit of reliable vectors, matched by their mean."""
        total, query = vectors.sum(axis=0, dtype=np.float64), unit_mean(vectors.sum(axis=0, dtype=np.float64), len(vectors))
        best = -1
        if self.used:
            scores = self.centroids[: self.used] @ query
            lead = int(np.argmax(scores))
            second = float(np.partition(scores, -2)[-2]) if self.used > 1 else -1.0
            if scores[lead] >= self.settings.similarity_threshold and float(scores[lead]) - second >= self.settings.margin_threshold:
                best = lead
        if best < 0:
            if self.centroids is None:
                self.centroids, self.sums = np.zeros((16, len(query)), np.float32), np.zeros((16, len(query)))
            elif self.used == len(self.centroids):
                self.centroids, self.sums = (np.vstack((m, np.zeros_like(m))) for m in (self.centroids, self.sums))
            best, self.used = self.used, self.used + 1
            self.counts.append(0)
        self.sums[best] += total
        self.counts[best] += len(vectors)
        self.centroids[best] = unit_mean(self.sums[best], self.counts[best])
        return best + 1


def _grouped(rows: DataFrame, settings: GrouperSettings, video: str, unit: list[str]) -> DataFrame:
    """The online grouping of units (rows equal in ``unit``) of observations, in their order."""
    id_type, video_type, track_type = (rows.schema[c].dataType.simpleString() for c in ("obs_id", video, "track_id"))
    of_video, of_unit = keys_of(video), keys_of(video, *unit)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaders, filed, now = Leaders(settings), {}, None
        for piece in whole_runs(batches, of_unit):
            videos, units, ok = of_video(piece), of_unit(piece), piece["ok"].to_numpy(bool)
            group, seq, status = np.full(len(piece), np.nan), np.full(len(piece), np.nan), np.empty(len(piece), object)
            for a, b in runs(units):
                if videos[a] != now:
                    leaders, filed, now = Leaders(settings), {}, videos[a]
                good = np.flatnonzero(ok[a:b]) + a
                status[a:b] = "dropped" if len(good) else "unassigned"
                if len(good):
                    g = leaders.place(np.stack([np.asarray(piece["embedding"].iloc[k], np.float32) for k in good]))
                    group[good], seq[good], status[good] = g, filed.get(g, 0) + np.arange(len(good)), "grouped"
                    filed[g] = filed.get(g, 0) + len(good)
            yield pd.DataFrame({video: piece[video], "track_id": piece["track_id"], "obs_id": piece["obs_id"], "group_id": pd.array(group, "Int64"), "seq": pd.array(seq, "Int64"), "status": status})

    return rows.mapInPandas(fold, f"`{video}` {video_type}, track_id {track_type}, obs_id {id_type}, group_id bigint, seq bigint, status string")


def group_members(observations: DataFrame, members: DataFrame, settings: GrouperSettings | None = None, video: str = "video_id") -> DataFrame:
    """``video, track_id, obs_id, group_id, seq, status`` for every tracked observation.

    ``status`` is ``grouped``, ``unassigned`` (nothing of its track was reliable) or
    ``dropped`` (it was not, but others of its track were).  ``seq`` is the order of
    filing within a group.  An observation with a null confidence, box or embedding isn't
    reliable; tracks without a time come last; null videos are one video; ties of start
    go by track number; embeddings of other lengths than the video's first are an error;
    an empty table gives an empty result.
    """
    settings = settings or GrouperSettings()
    ok = F.coalesce(is_reliable(F.col("embedding"), F.col("confidence"), F.col("box"), settings.min_confidence, settings.min_side), F.lit(False))
    on = F.col(f"m.{video}").eqNullSafe(F.col(f"o.{video}")) & (F.col("m.obs_id") == F.col("o.obs_id"))
    rows = members.alias("m").join(observations.select(video, "obs_id", "ts", "confidence", "box", "embedding").alias("o"), on).select("m.*", "o.ts", "o.confidence", "o.box", "o.embedding")
    # One exchange by video serves the window, the sort and the fold.
    start = F.min("ts").over(Window.partitionBy(video, "track_id"))
    flat = rows.repartition(video).select(video, "track_id", "obs_id", "seq", start.alias("start_time"), ok.alias("ok"), F.when(ok, F.col("embedding")).alias("embedding"))
    return _grouped(flat.sortWithinPartitions(video, F.col("start_time").asc_nulls_last(), "track_id", "seq"), settings, video, ["track_id"])


def group_observations(observations: DataFrame, settings: GrouperSettings | None = None, video: str = "video_id") -> DataFrame:
    """The online grouping of single observations, without tracks, in order of time, then ``obs_id``.

    ``video, obs_id, group_id, seq, status``; nulls as in ``group_members``.
    """
    settings = settings or GrouperSettings()
    ok = F.coalesce(is_reliable(F.col("embedding"), F.col("confidence"), F.col("box"), settings.min_confidence, settings.min_side), F.lit(False))
    flat = observations.repartition(video).select(video, F.col("obs_id").alias("track_id"), "obs_id", "ts", ok.alias("ok"), F.when(ok, F.col("embedding")).alias("embedding"))
    return _grouped(flat.sortWithinPartitions(video, F.col("ts").asc_nulls_last(), "obs_id"), settings, video, ["obs_id"]).drop("track_id")


def person_cards(observations: DataFrame, grouped: DataFrame, video: str = "video_id") -> DataFrame:
    """One row an identity, ranked by size (then creation): ``card_index`` from 0.

    ``grouped`` has group_id, obs_id and seq; the representative is the first of the
    highest quality (confidence times area; the lowest where either is null).  Rows
    without a group are left out; null times don't count.
    """
    on = F.col(f"g.{video}").eqNullSafe(F.col(f"o.{video}")) & (F.col("g.obs_id") == F.col("o.obs_id"))
    rows = grouped.where(F.col("group_id").isNotNull()).alias("g").join(observations.select(video, "obs_id", "ts", "confidence", "box").alias("o"), on).select("g.*", "o.ts", "o.confidence", "o.box")
    score = F.coalesce(quality(F.col("confidence"), F.col("box")), F.lit(float("-inf")))
    cards = rows.groupBy(video, "group_id").agg(
        F.count("*").alias("detection_count"), F.max("confidence").alias("best_confidence"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.min_by("obs_id", F.struct(-score, F.col("seq"))).alias("rep_obs_id"))
    order = Window.partitionBy(video).orderBy(F.col("detection_count").desc(), F.col("group_id"))
    return cards.withColumn("card_index", F.row_number().over(order) - 1)


def select_card(cards: DataFrame, index: int, video: str = "video_id") -> DataFrame:
    """The card at an index of every video; ``IndexError`` for a negative index or one no video has."""
    if index < 0:
        raise IndexError(f"no person card has the index {index}, it is out of range")
    found = cards.where(F.col("card_index") == index)
    if found.isEmpty():
        raise IndexError(f"no person card has the index {index}, it is out of range")
    return found
