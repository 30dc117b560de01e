"""Representative galleries: confident detections without near repeats.

Greedy suppression by priority (confidence, time, input order): a candidate is kept
unless a kept one of its video lies at most ``gap`` seconds away and overlaps
enough.  A video's gallery has at most ``max_items``, so the fold over a video's sorted
candidates holds the kept ones only and passes over the rest once it is full.

A window numbers the sorted candidates: only an operator that requires a video in one
task holds it there.  ``repartition`` is left out by the planner behind a join on the
same key, whose exchange adaptive execution may then read without moving rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import padded_crop
from .filters import usable_crops

MAX_ITEMS = 24
GAP_SECONDS = 1.0
DUPLICATE_IOU = 0.6


def candidates(detections: DataFrame, videos: DataFrame, padding: float = 0.08, video: str = "video_id") -> DataFrame:
    """Detections with ``crop_box``; those without a crop are left out."""
    sized = detections.join(videos.select(video, "width", "height"), video)
    return usable_crops(sized.withColumn("crop_box", padded_crop(F.col("box"), F.col("width"), F.col("height"), padding))).drop("width", "height")


def select_representatives(rows: DataFrame, max_items: int = MAX_ITEMS, gap: float = GAP_SECONDS, iou: float = DUPLICATE_IOU, video: str = "video_id", order: list[str] | None = None) -> DataFrame:
    """The gallery of every video with ``item_index``; at least one item where there is a candidate.

    ``order`` names the columns that give input order (default: frame_index, det_index).
    Null confidences come last; a candidate without a time or box repeats nothing; null
    videos are one video; an empty table gives an empty result; a column ``item_index``
    is replaced.
    """
    most = max(1, max_items)
    sort = [F.col("confidence").desc_nulls_last(), F.col("ts"), *(order or ["frame_index", "det_index"])]
    plain = rows.drop("item_index")
    box = F.array(*(F.col("box")[e].cast("double") for e in ("x_min", "y_min", "x_max", "y_max")))
    rank = F.row_number().over(Window.partitionBy(video).orderBy(*sort))
    sent = plain.select(*plain.columns, rank.alias("__rank"), F.col("ts").cast("double").alias("__ts"), box.alias("__box"))
    width = len(plain.columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, count = [], 0
        for batch in batches:
            places, numbers = [], []
            ranks, times, boxes = (batch.column(width + k).to_pylist() for k in range(3))
            for k, of_video in enumerate(ranks):
                if of_video == 1:
                    kept, count = [], 0
                if count >= most or _repeats(times[k], boxes[k], kept, gap, iou):
                    continue
                kept.append((times[k], boxes[k]))
                places.append(k), numbers.append(count)
                count += 1
            if places:
                chosen = [batch.column(k).take(pa.array(places)) for k in range(width)]
                yield pa.RecordBatch.from_arrays([*chosen, pa.array(numbers, pa.int32())], names=[*batch.schema.names[:width], "item_index"])

    return sent.mapInArrow(fold, T.StructType([*plain.schema.fields, T.StructField("item_index", T.IntegerType())]))


def _repeats(ts: float | None, box: list, kept: list, gap: float, iou: float) -> bool:
    """Whether a kept (time, box) is near in time and overlaps enough."""
    if ts is None or None in box:
        return False
    for t, b in kept:
        if t is None or None in b or abs(ts - t) > gap:
            continue
        common = max(0.0, min(box[2], b[2]) - max(box[0], b[0])) * max(0.0, min(box[3], b[3]) - max(box[1], b[1]))
        union = (box[2] - box[0]) * (box[3] - box[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common
        if (common / union if union > 0 else 0.0) >= iou:
            return True
    return False


def select_item(items: DataFrame, index: int) -> DataFrame:
    """The item at an index of every video; ``IndexError`` where no video has it."""
    found = items.where(F.col("item_index") == index)
    if index < 0 or found.isEmpty():
        raise IndexError(f"no gallery item has the index {index}, it is out of range")
    return found


def gallery_counts(detections: DataFrame, usable: DataFrame, items: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(detections, "detections").crossJoin(one(usable, "candidates")).crossJoin(one(items, "items"))
