"""Boxes, letterboxes and crops as Column expressions.

A box is a struct of four BIGINTs ``x_min, y_min, x_max, y_max``.  Rounding is half to
even, as everywhere in this engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = ("x_min", "y_min", "x_max", "y_max")
LANDMARKS = ("right_eye", "left_eye", "nose_tip", "mouth_right", "mouth_left")


def box(x_min, y_min, x_max, y_max) -> Column:
    return F.struct(*(F.lit(v).cast("bigint").alias(n) if not isinstance(v, Column) else v.cast("bigint").alias(n) for n, v in zip(EDGES, (x_min, y_min, x_max, y_max))))


def clamp(value: Column, lower, upper) -> Column:
    lower, upper = (v if isinstance(v, Column) else F.lit(v) for v in (lower, upper))
    return F.greatest(lower, F.least(upper, value))


def rounded(value: Column) -> Column:
    return F.rint(value).cast("bigint")


def width(b: Column) -> Column:
    return b["x_max"] - b["x_min"]


def height(b: Column) -> Column:
    return b["y_max"] - b["y_min"]


def intersection_over_union(a: Column, b: Column) -> Column:
    """Overlap ratio; 0 where the union has no area.  Areas of inverted boxes keep their sign."""
    zero = F.lit(0).cast("bigint")
    w = F.greatest(zero, F.least(a["x_max"], b["x_max"]) - F.greatest(a["x_min"], b["x_min"]))
    h = F.greatest(zero, F.least(a["y_max"], b["y_max"]) - F.greatest(a["y_min"], b["y_min"]))
    common = w * h
    union = width(a) * height(a) + width(b) * height(b) - common
    return F.when(union <= 0, F.lit(0.0)).otherwise(common.cast("double") / F.when(union > 0, union).cast("double"))


def quality(confidence: Column, b: Column) -> Column:
    """Confidence times area, sides clipped at 0."""
    zero = F.lit(0).cast("bigint")
    return confidence * (F.greatest(zero, width(b)) * F.greatest(zero, height(b)))


def letterbox(frame_width: Column, frame_height: Column, target_width: int = 640, target_height: int = 640) -> Column:
    """``scale, width, height, pad_x, pad_y`` of a frame fitted inside a target."""
    if target_width <= 0 or target_height <= 0:
        raise ValueError(f"a target needs a width and a height, not {target_width} x {target_height}")
    scale = F.least(F.lit(float(target_width)) / frame_width, F.lit(float(target_height)) / frame_height)
    one = F.lit(1).cast("bigint")
    w, h = F.greatest(one, rounded(frame_width * scale)), F.greatest(one, rounded(frame_height * scale))
    half = lambda free: F.floor(free / F.lit(2))
    return F.struct(scale.alias("scale"), w.alias("width"), h.alias("height"), half(F.lit(target_width) - w).alias("pad_x"), half(F.lit(target_height) - h).alias("pad_y"))


def map_point(x: Column, y: Column, fit: Column) -> Column:
    """A point of the letterboxed frame in pixels of the source frame."""
    return F.struct(((x - fit["pad_x"]) / fit["scale"]).alias("x"), ((y - fit["pad_y"]) / fit["scale"]).alias("y"))


def map_landmarks(row: Column, fit: Column) -> Column:
    """The five points in places 4..13 of a model row."""
    return F.struct(*(map_point(F.get(row, F.lit(4 + 2 * k)), F.get(row, F.lit(5 + 2 * k)), fit).alias(n) for k, n in enumerate(LANDMARKS)))


def map_box(x: Column, y: Column, w: Column, h: Column, fit: Column, frame_width: Column, frame_height: Column) -> Column:
    """A model box in source pixels, rounded and clamped; null where it collapses."""
    zero = F.lit(0).cast("bigint")
    edge = lambda v, pad, most: clamp(rounded((v - pad) / fit["scale"]), zero, most.cast("bigint"))
    x0, y0 = edge(x, fit["pad_x"], frame_width), edge(y, fit["pad_y"], frame_height)
    x1, y1 = edge(x + w, fit["pad_x"], frame_width), edge(y + h, fit["pad_y"], frame_height)
    return F.when((x0 < x1) & (y0 < y1), box(x0, y0, x1, y1))


def flatten_landmarks(marks: Column) -> Column:
    return F.array(*(marks[n][a].cast("double") for n in LANDMARKS for a in ("x", "y")))


def model_row(b: Column, marks: Column, confidence: Column) -> Column:
    """The 15 floats an aligner expects; null without landmarks."""
    head = F.array(b["x_min"].cast("float"), b["y_min"].cast("float"), width(b).cast("float"), height(b).cast("float"))
    row = F.concat(head, flatten_landmarks(marks).cast("array<float>"), F.array(confidence.cast("float")))
    return F.when(marks.isNotNull(), row)


def padded_crop(b: Column, frame_width: Column, frame_height: Column, padding: float = 0.08) -> Column:
    """The box grown by at least one pixel a side and cut to the frame.

    Null for boxes without positive sides and for crops that collapse.
    """
    if padding < 0:
        raise ValueError(f"a padding can't be negative: {padding}")
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    px, py = (F.greatest(one, rounded(side * F.lit(float(padding)))) for side in (width(b), height(b)))
    x0, y0 = F.greatest(zero, b["x_min"] - px), F.greatest(zero, b["y_min"] - py)
    x1, y1 = F.least(frame_width.cast("bigint"), b["x_max"] + px), F.least(frame_height.cast("bigint"), b["y_max"] + py)
    return F.when((width(b) > 0) & (height(b) > 0) & (x0 < x1) & (y0 < y1), box(x0, y0, x1, y1))


def grid_cell(index: Column, columns: int = 4, tile: int = 192, padding: int = 12, label: int = 56) -> Column:
    """Where a montage shows its tile: row, column, top and left pixel of the cell."""
    if columns <= 0:
        raise ValueError(f"a grid needs a column at least, not {columns}")
    row, column = F.floor(index / F.lit(columns)), F.pmod(index, F.lit(columns))
    return F.struct(row.alias("row"), column.alias("column"), (row * (tile + label + 2 * padding)).alias("top"), (column * (tile + 2 * padding)).alias("left"))
