"""Text for reports.  Numbers are the results; these strings are for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_timestamp(seconds: Column) -> Column:
    """``MM:SS.ss`` from whole centiseconds; minutes have no upper limit; negative gives null."""
    cs = F.rint(seconds * 100).cast("bigint")
    minutes, rest = F.floor(cs / F.lit(6000)), F.pmod(cs, F.lit(6000))
    digits = minutes.cast("string")
    text = F.concat(F.lpad(digits, F.greatest(F.lit(2), F.length(digits)), F.lit("0")), F.lit(":"), F.lpad(F.floor(rest / F.lit(100)).cast("string"), 2, "0"), F.lit("."), F.lpad(F.pmod(rest, F.lit(100)).cast("string"), 2, "0"))
    return F.when(seconds >= 0, text)


def check_timestamp(seconds: float) -> str:
    """The same for one number; raises ``ValueError`` for a negative one."""
    if seconds < 0:
        raise ValueError(f"a time can't be negative: {seconds}")
    minutes, rest = divmod(round(seconds * 100), 6000)
    return f"{minutes:02d}:{rest // 100:02d}.{rest % 100:02d}"


# The layout of the texts below.
def item_label(row, index: int) -> tuple[str, ...]:
    """The lines under a gallery item."""
    b = row["box"]
    return f"#{index + 1}  t={row['ts']:.2f}s", f"conf={row['confidence']:.2f}", f"[{b['x_min']}, {b['y_min']}]-{b['x_max']}, {b['y_max']}"


def card_label(row, index: int) -> tuple[str, ...]:
    """The lines under a person card."""
    return f"Person #{index + 1}  ({row['detection_count']} detections)", f"seen {row['first_seen']:.1f}s - {row['last_seen']:.1f}s", f"best conf={row['best_confidence']:.2f}"


def run_report(title: str, frames: int, counts: dict[str, object], seconds: float) -> str:
    """What a run did, how long it took and how many frames a second that is (0 without a duration)."""
    rate = frames / seconds if seconds > 0 else 0.0
    lines = {"Frames processed": frames, **counts, "Total processing time": f"{seconds:.2f} seconds", "Processing speed": f"{rate:.2f} frames/sec"}
    return "\n".join((f"--- {title} ---", *(f"{k}: {v}" for k, v in lines.items()), "--- End Report ---"))


def describe_item(row: dict, index: int | None = None) -> str:
    head = "Selected gallery item" + (f" #{index + 1}" if index is not None else "")
    b = row["box"]
    return "\n".join((f"{head}:", f"  timestamp = {row['ts']:.2f}", f"  confidence = {row['confidence']:.2f}", f"  box = ({b['x_min']}, {b['y_min']}, {b['x_max']}, {b['y_max']})"))


def describe_card(row: dict, index: int | None = None) -> str:
    head = "Selected person" + (f" #{index + 1}" if index is not None else "")
    parts = (("group_id", str(row["group_id"])), ("detections", str(row["detection_count"])), ("best_confidence", f"{row['best_confidence']:.2f}"), ("first_seen", f"{row['first_seen']:.2f}s"), ("last_seen", f"{row['last_seen']:.2f}s"))
    return "\n".join((f"{head}:", *(f"  {k} = {v}" for k, v in parts)))
