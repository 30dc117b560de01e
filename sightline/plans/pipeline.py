"""The end-to-end plans: gallery, identity groups, appearance timestamps.

All start from ``observations`` (or ``detections``), so decoding and inference stay at
the edge.  Tables that several steps read are written once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gallery as g
from ..operators.filters import confident, usable_crops
from ..operators.identity import GrouperSettings, group_members, person_cards, select_card
from ..operators.timeline import appearance_intervals
from ..operators.tracking import TrackerSettings, track_members
from ..functions.geometry import padded_crop
from ..sources.scratch import materialize


@dataclass
class Identities:
    observations: DataFrame
    members: DataFrame
    grouped: DataFrame
    cards: DataFrame


def identities(observations: DataFrame, videos: DataFrame, confidence: float = 0.6, padding: float = 0.08, tracker: TrackerSettings | None = None, grouper: GrouperSettings | None = None) -> Identities:
    """Track and group confident observations that have a crop and an embedding."""
    if padding < 0:
        raise ValueError(f"a padding can't be negative: {padding}")
    sized = confident(observations, confidence).join(videos.select("video_id", "width", "height"), "video_id")
    kept = usable_crops(sized.withColumn("crop_box", padded_crop(F.col("box"), F.col("width"), F.col("height"), padding))).where(F.col("embedding").isNotNull()).drop("width", "height")
    kept = materialize(kept, "observations")
    members = materialize(track_members(kept, tracker), "track-members")
    grouped = materialize(group_members(kept, members, grouper), "group-members")
    return Identities(kept, members, grouped, person_cards(kept, grouped))


def timestamps(found: Identities, videos: DataFrame, sample_interval: float, gap: float | None = None, padding: float | None = None, select_index: int | None = None) -> DataFrame:
    """Intervals of all identities, or of the one at a card index, with its ``card_index``."""
    cards = found.cards if select_index is None else select_card(found.cards, select_index)
    ids = found.grouped.where(F.col("group_id").isNotNull()).join(cards.select("video_id", "group_id", "card_index"), ["video_id", "group_id"])
    times = ids.join(found.observations.select("video_id", "obs_id", "ts"), ["video_id", "obs_id"]).join(videos.select("video_id", "duration"), "video_id")
    keys = ["video_id", "group_id", "card_index", "duration"]
    return appearance_intervals(times, keys, "duration", sample_interval, gap, padding).drop("duration")


def face_gallery(detections: DataFrame, videos: DataFrame, confidence: float = 0.6, padding: float = 0.08, max_items: int = g.MAX_ITEMS) -> DataFrame:
    return g.select_representatives(g.candidates(confident(detections, confidence), videos, padding), max_items)


def report(detections: DataFrame, found: Identities) -> DataFrame:
    """One row: how many detections, tracks, identities, and what became of each observation.

    ``dropped`` are unreliable members of tracks that had reliable ones.
    """
    n = F.count("*")
    by_status = found.grouped.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("grouped", "unassigned", "dropped")))
    one = [
        detections.agg(n.alias("detections")), found.observations.agg(n.alias("observations")),
        found.members.select("video_id", "track_id").distinct().agg(n.alias("tracks")), found.cards.agg(n.alias("identities")), by_status]
    out = one[0]
    for part in one[1:]:
        out = out.crossJoin(part)  # single rows
    return out
