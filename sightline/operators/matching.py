"""Pairwise matching: link candidates, one-to-one assignment, nearest centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import intersection_over_union
from ..functions.vectors import dot


def overlapping_pairs(detections: DataFrame, max_frame_gap: int = 0, iou_threshold: float = 0.3, video: str = "video_id") -> DataFrame:
    """Detections of nearby frames whose boxes overlap: ``video, frame_index, prev_frame, prev_det, det_index, iou``.

    The frame distance is an equality on ``frame_index``, so the join hashes on (video,
    frame) and never compares distant frames.  A detection without a video, frame or box
    pairs with nothing; repeated rows pair each; an empty table gives an empty result.
    """
    if not 0 <= iou_threshold <= 1 or max_frame_gap < 0:
        raise ValueError("an overlap threshold lies between 0 and 1, and a frame gap isn't negative")
    later = detections.select(F.col(video), "frame_index", "det_index", F.col("box").alias("__b"), *(["embedding"] if "embedding" in detections.columns else []))
    earlier = detections.select(F.col(video), F.col("frame_index").alias("prev_frame"), F.col("det_index").alias("prev_det"), F.col("box").alias("__a"), *([F.col("embedding").alias("__e")] if "embedding" in detections.columns else []))
    earlier = earlier.withColumn("frame_index", F.explode(F.sequence(F.col("prev_frame") + 1, F.col("prev_frame") + 1 + max_frame_gap)))
    pairs = later.join(earlier, [video, "frame_index"]).withColumn("iou", intersection_over_union(F.col("__a"), F.col("__b")))
    return pairs.where(F.col("iou") >= F.lit(float(iou_threshold))).drop("__a", "__b")


def link_candidates(observations: DataFrame, max_frame_gap: int = 0, iou_threshold: float = 0.3, contradiction_floor: float = 0.25, video: str = "video_id", digits: int | None = None) -> DataFrame:
    """Overlapping pairs whose embeddings don't contradict: kept unless ``similarity < floor``.

    A null embedding contradicts nothing, as in the tracker; its similarity is null.
    With ``digits`` similarities are rounded to as many before they meet the floor; one
    that comes to zero from below is -0.0, which no floor of zero leaves out.
    """
    if not -1 <= contradiction_floor <= 1:
        raise ValueError("a similarity floor lies between -1 and 1")
    pairs = overlapping_pairs(observations, max_frame_gap, iou_threshold, video)
    similarity = dot(F.col("__e"), F.col("embedding"))
    if digits is not None:  # in a list of one, so that the product is taken once
        similarity = F.get(F.transform(F.array(similarity), lambda s: F.when((s < 0) & (F.round(s, digits) == 0), F.lit(-0.0)).otherwise(F.round(s, digits))), F.lit(0))
    scored = pairs.withColumn("similarity", similarity).drop("__e", "embedding")
    return scored.where(~F.coalesce(F.col("similarity") < F.lit(float(contradiction_floor)), F.lit(False)))


def assign_one_to_one(pairs: DataFrame, group: list[str], left: str, right: str, score: str, materialize=None) -> DataFrame:
    """Greedy assignment by (score, left, right), all descending, within each group.

    Rounds of mutual best: a pair that is the best of both its sides is what greedy
    takes next for them; it and all pairs touching it leave.  Rounds are few (each
    removes the best pair of every group); ``materialize`` writes a round's rest to
    cut lineage, by default a table in ``spark.checkpoint.dir``.  Pairs with a null in
    the group, either side or the score are left out; of equal rows all are taken; an
    empty table gives an empty result.
    """
    materialize = materialize or _checkpointed
    whole = F.lit(True)
    for c in (*group, left, right, score):
        whole = whole & F.col(c).isNotNull()
    taken, rest = None, materialize(pairs.where(whole))
    while True:
        rank = F.struct(score, left, right)
        of_left, of_right = Window.partitionBy(*group, left), Window.partitionBy(*group, right)
        best = rest.withColumns({"__l": F.max(rank).over(of_left), "__r": F.max(rank).over(of_right)})
        won = materialize(best.where((F.col("__l") == rank) & (F.col("__r") == rank)).drop("__l", "__r"))
        taken = won if taken is None else taken.unionByName(won)
        rest = rest.join(won.select(*group, left), [*group, left], "left_anti").join(won.select(*group, right), [*group, right], "left_anti")
        rest = materialize(rest)
        if rest.isEmpty():
            return taken


def _checkpointed(df: DataFrame) -> DataFrame:
    from ..sources.scratch import materialize

    return materialize(df, "round")


#: Of centroids sent to every worker at a time, and of scores a worker holds.
BLOCK_BYTES = 64 << 20
SCORE_BYTES = 32 << 20


def nearest_centroids(queries: DataFrame, centroids: DataFrame, query_id: str, group_id: str = "group_id", similarity_threshold: float = 0.45, margin_threshold: float = 0.05, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each query's best and second-best centroid and whether the match is accepted.

    ``query_id, group_id, best, second, accepted``.  A snapshot against fixed centroids,
    not the online clustering of ``identity``.  Centroids are broadcast in blocks of
    ``block_bytes``, as many as their bytes ask for; a worker multiplies a batch of
    queries with a block and keeps the best two.  Equal similarities go to the lowest
    group; a lone centroid has the second-best similarity -1; a query without a vector, or
    without any centroid, matches nothing (null group); null centroids are left out; all
    vectors are of one length.
    """
    if not -1 <= similarity_threshold <= 1 or margin_threshold < 0:
        raise ValueError("a similarity threshold lies between -1 and 1, and a margin isn't negative")
    spark = queries.sparkSession
    small = centroids.select(F.col(group_id).alias("g"), F.col("embedding").alias("c")).where(F.col("c").isNotNull())
    size = small.agg(F.sum(F.size("c") * 8 + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    id_type, group_type = queries.schema[query_id], small.schema["g"].dataType
    found = T.StructType([T.StructField("n", T.DoubleType()), T.StructField("g", group_type)])
    parts = []
    for k in range(blocks):
        block = (small if blocks == 1 else small.where(F.pmod(F.xxhash64("g"), F.lit(blocks)) == k)).orderBy("g").toArrow().combine_chunks()
        parts.append(_best_two(queries.select(query_id, "embedding"), spark.sparkContext.broadcast(block), T.StructType([id_type, T.StructField("__top", T.ArrayType(found))])))
    top = parts[0]
    if len(parts) > 1:
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        top = both.groupBy(query_id).agg(F.slice(F.array_sort(F.flatten(F.collect_list("__top"))), 1, 2).alias("__top"))
    first, second = F.get("__top", F.lit(0)), F.get("__top", F.lit(1))
    best = -first["n"]
    out = top.select(query_id, first["g"].alias(group_id), best.alias("best"), F.when(best.isNotNull(), F.coalesce(-second["n"], F.lit(-1.0))).alias("second"))
    accepted = (F.col("best") >= F.lit(float(similarity_threshold))) & (F.col("best") - F.col("second") >= F.lit(float(margin_threshold)))
    return out.withColumn("accepted", F.coalesce(accepted, F.lit(False)))


def _best_two(queries: DataFrame, block, schema: T.StructType) -> DataFrame:
    """The id and up to two (minus similarity, group) of a block, best first."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = block.value
        groups = table.column("g").combine_chunks() if isinstance(table.column("g"), pa.ChunkedArray) else table.column("g")
        matrix = np.array(table.column("c").to_pylist(), np.float64).T
        step = max(1, SCORE_BYTES // max(8, 8 * len(groups)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                vectors = piece.column(1).to_pylist()
                good = [k for k, v in enumerate(vectors) if v is not None and len(groups)]
                counts, places, values = np.zeros(len(vectors), np.int64), [], []
                if good:
                    scores = np.array([vectors[k] for k in good], np.float64) @ matrix
                    rows = np.arange(len(good))
                    for _ in range(min(2, len(groups))):
                        lead = scores.argmax(axis=1)  # the first of equal ones: the lowest group
                        places.append(lead), values.append(scores[rows, lead].copy())
                        scores[rows, lead] = -np.inf
                    counts[good] = len(places)
                order = np.stack(places, axis=1).reshape(-1) if places else np.empty(0, np.int64)
                similar = np.stack(values, axis=1).reshape(-1) if values else np.empty(0)
                pairs = pa.StructArray.from_arrays([pa.array(-similar, pa.float64()), groups.take(pa.array(order, pa.int64()))], names=["n", "g"])
                ends = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(ends, pairs)], names=schema.names)

    return queries.mapInArrow(score, schema)
