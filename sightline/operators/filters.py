"""Predicates on detections and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import height, width
from ..functions.vectors import is_valid

MIN_CONFIDENCE = 0.7
MIN_SIDE = 40


def confident(detections: DataFrame, threshold: float = 0.6, confidence: str = "confidence") -> DataFrame:
    """Rows at or above the threshold."""
    return detections.where(F.col(confidence) >= F.lit(float(threshold)))


def is_reliable(embedding: Column, confidence: Column, box: Column, min_confidence: float = MIN_CONFIDENCE, min_side: int = MIN_SIDE) -> Column:
    """A usable embedding, enough confidence, and a shorter side that is long enough."""
    return is_valid(embedding) & (confidence >= F.lit(float(min_confidence))) & (F.least(width(box), height(box)) >= F.lit(min_side))


def usable_crops(rows: DataFrame, crop: str = "crop_box") -> DataFrame:
    """Rows whose crop exists and has an area."""
    c = F.col(crop)
    return rows.where(c.isNotNull() & (width(c) > 0) & (height(c) > 0))
