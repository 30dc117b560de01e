"""Face tracks: detections of consecutive frames linked by overlap.

Whether a detection continues a track depends on what earlier frames were assigned, so
the tracker is a fold over a video's frames.  Videos are independent.  Rows are
exchanged by video and sorted by frame once; a task then streams them, holding one
Arrow batch, the rows of one frame and the live tracks, however long a video is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import mean_embedding

#: Frame number of detections without one: further from any other than a gap reaches.
NO_FRAME = -(1 << 62)


@dataclass(frozen=True)
class TrackerSettings:
    iou_threshold: float = 0.3
    max_frame_gap: int = 1
    contradiction_floor: float = 0.25

    def __post_init__(self):
        if not 0.0 <= self.iou_threshold <= 1.0:
            raise ValueError(f"an overlap threshold lies between 0 and 1, not at {self.iou_threshold}")
        if self.max_frame_gap < 0:
            raise ValueError(f"a frame gap can't be negative: {self.max_frame_gap}")
        if not -1.0 <= self.contradiction_floor <= 1.0:
            raise ValueError(f"a similarity floor lies between -1 and 1, not at {self.contradiction_floor}")


@dataclass
class LinkState:
    """What the fold keeps between frames: a row per live track, in order of creation."""

    track: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    frame: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    size: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    box: np.ndarray = field(default_factory=lambda: np.empty((0, 4), np.int64))
    placed: np.ndarray = field(default_factory=lambda: np.empty(0, bool))
    vector: list = field(default_factory=list)
    started: int = 0


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of every box of ``a`` with every one of ``b``."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    common = np.prod(np.maximum(0, high - low), axis=2)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = area(a)[:, None] + area(b)[None, :] - common
    return np.where(union > 0, common / np.where(union > 0, union, 1), 0.0)


def contradicts(a: np.ndarray | None, b: np.ndarray | None, floor: float) -> bool:
    """Whether two embeddings speak against one face; a missing one says nothing, like one that isn't a number."""
    return a is not None and b is not None and float(np.dot(a, b)) < floor


def link_frame(state: LinkState, frame: int, boxes: np.ndarray, vectors: list, settings: TrackerSettings, placed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Track number and place in the track of each detection of a frame; updates ``state``.

    ``placed`` says which detections have a box; the others overlap nothing.
    """
    placed = np.ones(len(boxes), bool) if placed is None else placed
    alive = frame - state.frame - 1 <= settings.max_frame_gap
    if not alive.all():
        state.track, state.frame, state.size, state.box, state.placed = (x[alive] for x in (state.track, state.frame, state.size, state.box, state.placed))
        state.vector = [v for v, a in zip(state.vector, alive) if a]
    tracks, places = np.full(len(boxes), -1, np.int64), np.zeros(len(boxes), np.int64)
    if len(boxes) and len(state.track):
        shared = np.where(state.placed[:, None] & placed[None, :], overlaps(state.box, boxes), -1.0)
        near = np.nonzero(shared >= settings.iou_threshold)
        found = [(shared[i, j], i, j) for i, j in zip(*near) if not contradicts(state.vector[i], vectors[j], settings.contradiction_floor)]
        used: set[int] = set()
        for _, i, j in sorted(found, reverse=True):
            if i in used or tracks[j] >= 0:
                continue
            used.add(i)
            tracks[j], places[j] = state.track[i], state.size[i]
            state.frame[i], state.box[i], state.vector[i] = frame, boxes[j], vectors[j]
            state.size[i] += 1
    new = np.flatnonzero(tracks < 0)
    if len(new):
        numbers = np.arange(state.started + 1, state.started + 1 + len(new))
        tracks[new] = numbers
        state.started += len(new)
        state.track, state.frame = np.append(state.track, numbers), np.append(state.frame, np.full(len(new), frame))
        state.size, state.box = np.append(state.size, np.ones(len(new), np.int64)), np.vstack((state.box, boxes[new]))
        state.placed = np.append(state.placed, placed[new])
        state.vector += [vectors[j] for j in new]
    return tracks, places


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """First and one past the last place of each run of equal values."""
    if not len(values):
        return []
    cuts = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]))
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def whole_runs(batches: Iterator[pd.DataFrame], key: Callable[[pd.DataFrame], np.ndarray]) -> Iterator[pd.DataFrame]:
    """Sorted batches, cut anew so that rows equal by ``key`` come in one piece."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = key(batch)
        start = runs(keys)[-1][0]
        if held and keys[0] != key(held[0].iloc[:1])[0]:
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held = []
        if start:
            yield pd.concat([*held, batch.iloc[:start]], ignore_index=True)
            held = []
        held.append(batch.iloc[start:])
    if held:
        yield pd.concat(held, ignore_index=True)


def keys_of(*columns: str) -> Callable[[pd.DataFrame], np.ndarray]:
    """A comparable value per row, nulls included."""
    return lambda rows: np.fromiter(map(repr, zip(*(rows[c] for c in columns))), object, len(rows))


def fold_frames(state: LinkState, rows: pd.DataFrame, settings: TrackerSettings) -> pd.DataFrame:
    """Fold detections, sorted by (frame, det_index), into ``track_id`` and ``seq``."""
    boxes = rows[["x_min", "y_min", "x_max", "y_max"]].to_numpy(np.int64)
    placed = rows["placed"].to_numpy(bool)
    vectors = [None if v is None else np.asarray(v, np.float32) for v in rows["embedding"]]
    frames = rows["frame_index"].to_numpy(np.int64)
    tracks, places = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for a, b in runs(frames):
        tracks[a:b], places[a:b] = link_frame(state, int(frames[a]), boxes[a:b], vectors[a:b], settings, placed[a:b])
    return rows[["obs_id"]].assign(track_id=tracks, seq=places)


def flat_observations(observations: DataFrame, video: str = "video_id") -> DataFrame:
    """What the fold reads, without nulls but in the embedding."""
    box = F.col("box")
    edges = ("x_min", "y_min", "x_max", "y_max")
    placed = box.isNotNull() & F.forall(F.array(*(box[e] for e in edges)), lambda x: x.isNotNull())
    frame = F.coalesce(F.col("frame_index").cast("long"), F.lit(NO_FRAME))
    return observations.select(video, "obs_id", frame.alias("frame_index"), "det_index", *(F.coalesce(box[e].cast("long"), F.lit(0)).alias(e) for e in edges), F.coalesce(placed, F.lit(False)).alias("placed"), "embedding")


def track_members(observations: DataFrame, settings: TrackerSettings | None = None, video: str = "video_id") -> DataFrame:
    """``video, track_id, seq, obs_id`` for every observation.

    ``observations``: video, obs_id, frame_index, det_index, box, embedding.  Frames
    without rows need none: staleness follows from frame numbers.  A null embedding
    contradicts nothing; a detection without a box or frame number overlaps nothing and is a
    track of its own; null videos are one video.  Ties of frame and det_index go
    by obs_id; repeated rows are detections each; other columns are ignored; an
    empty table gives an empty result.
    """
    settings = settings or TrackerSettings()
    id_type, video_type = observations.schema["obs_id"].dataType.simpleString(), observations.schema[video].dataType.simpleString()
    of_video = keys_of(video)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, now = LinkState(), None
        for rows in whole_runs(batches, keys_of(video, "frame_index")):
            ids = of_video(rows)
            for a, b in runs(ids):
                if ids[a] != now:
                    state, now = LinkState(), ids[a]
                out = fold_frames(state, rows.iloc[a:b], settings)
                yield out.assign(**{video: rows[video].iloc[a:b]})[[video, "track_id", "seq", "obs_id"]]

    flat = flat_observations(observations, video).repartition(video).sortWithinPartitions(video, "frame_index", F.col("det_index").asc_nulls_last(), "obs_id")
    return flat.mapInPandas(fold, f"`{video}` {video_type}, track_id bigint, seq bigint, obs_id {id_type}")


def tracks(observations: DataFrame, members: DataFrame, video: str = "video_id") -> DataFrame:
    """One row a track: ``size, start_time, end_time, rep_obs_id, embedding`` and its order by start.

    The representative is the first of the highest confidence (null: the lowest); null
    times and embeddings don't count, a track with no other has a null there, and comes
    last in order if it is the time.  ``obs_id`` names one observation of a video.
    """
    from pyspark.sql import Window

    on = F.col(f"m.{video}").eqNullSafe(F.col(f"o.{video}")) & (F.col("m.obs_id") == F.col("o.obs_id"))
    rows = members.alias("m").join(observations.select(video, "obs_id", "ts", "confidence", "embedding").alias("o"), on).select("m.*", "o.ts", "o.confidence", "o.embedding")
    keys = [video, "track_id"]
    confidence = F.coalesce(F.col("confidence").cast("double"), F.lit(float("-inf")))
    facts = rows.groupBy(*keys).agg(
        F.count("*").alias("size"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
        F.min_by("obs_id", F.struct(-confidence, F.col("seq"))).alias("rep_obs_id"))
    order = Window.partitionBy(video).orderBy(F.col("start_time").asc_nulls_last(), "track_id")
    means = mean_embedding(rows, keys).withColumnsRenamed({k: f"__{k}" for k in keys})
    joined = facts.join(means, F.col(video).eqNullSafe(F.col(f"__{video}")) & (F.col("track_id") == F.col("__track_id")), "left").drop(*(f"__{k}" for k in keys))
    return joined.withColumn("track_order", F.row_number().over(order) - 1)
