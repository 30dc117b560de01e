"""Interval sampling of frame timelines.

The schedule advances by one interval per emitted frame, so after a jump in time
consecutive frames are emitted until it has caught up.  Frames between two thresholds
are a cell, ``k`` thresholds lie at or below each of its ``n`` frames, and the
cell emits its first frames until ``k`` are out: of ``c`` emitted so far there are
``min(c + n, k)`` after it.  That recurrence is a running sum and minimum over cells, so
only the table of cells (one row per threshold) is ordered as a whole; frames are
ordered inside their cell, in parallel, even where there is one timeline only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_frames(frames: DataFrame, interval: float = 1.0, keys: list[str] | None = None, ts: str = "ts", order: list[str] | None = None, exact: bool = False) -> DataFrame:
    """The sampled rows of ``frames`` with ``frame_index`` from 0 per ``keys``.

    ``order`` breaks ties of time.  ``exact`` counts thresholds made by repeated
    addition, as a running program would, by table lookup; else they are multiples
    of the interval, which is the same for integers and binary fractions.  Negative
    and null times never emit; null keys are a timeline; equal frames are frames each; an
    empty table gives an empty result; a column ``frame_index`` is replaced.
    """
    if interval <= 0:
        raise ValueError(f"a sampling interval is longer than 0 seconds, not {interval}")
    keys = keys or []
    rows = frames.where(F.col(ts) >= 0)
    if exact:
        rows = _thresholds_below(rows, interval, ts)
    else:
        rows = rows.withColumn("__need", F.floor(F.col(ts) / F.lit(float(interval))) + 1)
    cells = rows.groupBy(*keys, "__need").agg(F.count("*").alias("__n"))
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # of cells: one row per threshold
    by = by.orderBy("__need").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("__s", F.sum("__n").over(by))
    cells = cells.withColumn("__c", F.col("__s") + F.least(F.lit(0), F.min(F.col("__need") - F.col("__s")).over(by)))
    before = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    cells = cells.withColumn("__b", F.lag("__c", 1, 0).over(before.orderBy("__need"))).where(F.col("__c") > F.col("__b"))
    of_cell = cells.select(*(F.col(k).alias(f"__{n}") for n, k in enumerate([*keys, "__need"])), "__b", (F.col("__c") - F.col("__b")).alias("__e"))
    same = F.lit(True)
    for n, k in enumerate([*keys, "__need"]):
        same = same & F.col(k).eqNullSafe(F.col(f"__{n}"))
    met = rows.join(of_cell, same).drop(*(f"__{n}" for n in range(len(keys) + 1)))
    within = Window.partitionBy(*keys, "__need").orderBy(ts, *(order or []))
    numbered = met.withColumn("__i", F.row_number().over(within)).where(F.col("__i") <= F.col("__e"))
    return numbered.withColumn("frame_index", F.col("__b") + F.col("__i") - 1).drop("__need", "__i", "__b", "__e")


def _thresholds_below(rows: DataFrame, interval: float, ts: str) -> DataFrame:
    """``__need`` from the repeated sum 0, s, s + s, ...: one pass in Python per batch of times."""
    @F.pandas_udf("bigint")
    def need(times: pd.Series) -> pd.Series:
        top = float(times.max()) if len(times) else 0.0
        steps = np.full(int(top / interval) + 3, float(interval))
        steps[0] = 0.0
        return pd.Series(np.searchsorted(np.cumsum(steps), times.to_numpy(), side="right"))

    return rows.withColumn("__need", need(F.col(ts).cast("double")))
