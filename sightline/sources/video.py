"""Video files as tables.

Listing and validation are Spark's ``binaryFile`` source, of which only paths and lengths
are read.  Decoding needs a library that isn't bundled: a ``Decoder`` is handed in, and
runs inside Python workers, which open a video by its path, so files of any size pass.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from typing import Protocol
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The accepted suffixes.
SUFFIXES = (".mp4", ".mov")

INFO_SCHEMA = "width int, height int, codec string, frames bigint, duration double, fps double"
FRAME_SCHEMA = "video_id string, source_index bigint, ts double, frame_index bigint, image struct<height: int, width: int, channels: int, data: binary>"


class VideoLoadError(Exception):
    """A video can't be found, is of another kind, or can't be read."""


class FrameExtractionError(Exception):
    """A container has no video stream to take frames from."""


class Decoder(Protocol):
    """What a decoding library has to offer; videos are opened by path, on any machine."""

    def info(self, path: str) -> dict | None:
        """``width, height, codec, frames, duration, fps`` of the first video stream; None without one."""

    def frames(self, path: str) -> Iterable[tuple[float, object]] | None:
        """(seconds, handle) in decode order; None without a video stream."""

    def pixels(self, handle: object) -> tuple[int, int, int, bytes]:
        """Height, width, channels and RGB bytes of a frame; called for sampled frames only."""


def list_videos(spark: SparkSession, path: str) -> DataFrame:
    """``video_id, path, length`` of all videos under a path; other files are left out."""
    globs = "*.{" + ",".join(f"{a}{b}{c}" for s in ("mp4", "mov") for a in {s[0], s[0].upper()} for b in {s[1], s[1].upper()} for c in {s[2], s[2].upper()}) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", globs).option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.where(suffix.isin(*SUFFIXES)).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("video_id"), "path", "length")


def load_video(spark: SparkSession, path: str, decoder: Decoder | None = None) -> DataFrame:
    """One validated video as a one-row table; ``VideoLoadError`` says what is wrong.

    With a ``decoder`` the container is opened too, on the driver.
    """
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        raise VideoLoadError(f"no such video exists: {path}")
    if not fs.getFileStatus(target).isFile():
        raise VideoLoadError(f"not a file: {path}")
    suffix = os.path.splitext(path)[1]
    if suffix.lower() not in SUFFIXES:
        raise VideoLoadError(f"Unsupported kind of video {suffix!r}; known are {' and '.join(SUFFIXES)}")
    found = list_videos(spark, path)
    if decoder is not None:
        opened = open_video(decoder, fs.makeQualified(target).toString())
        if isinstance(opened, str):
            raise VideoLoadError(f"{opened}: {path}")
    return found


def local_path(path: str) -> str:
    """A path as a decoding library takes it; other schemes than ``file:`` stay."""
    return unquote(path.removeprefix("file://").removeprefix("file:")) if path.startswith("file:") else path


def open_video(decoder: Decoder, path: str) -> dict | str:
    """The facts of the first video stream, or what is wrong."""
    try:
        return decoder.info(local_path(path)) or "no video stream in the file"
    except Exception as e:  # whatever the library raises
        return f"Could not open the video ({e})"


def video_info(videos: DataFrame, decoder: Decoder) -> DataFrame:
    """``video_id``, the stream's facts and ``error``; null duration and rate stay null."""
    import pandas as pd

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for video, path in zip(batch["video_id"], batch["path"]):
                blank = dict.fromkeys(("width", "height", "codec", "frames", "duration", "fps"))
                found = open_video(decoder, path)  # a broken file is a row, not a failed job
                facts, error = ({}, found) if isinstance(found, str) else (found, None)
                rows.append({"video_id": video, **blank, **facts, "error": error})
            out = pd.DataFrame(rows, columns=["video_id", *blank, "error"])
            yield out.astype({"width": "Int32", "height": "Int32", "frames": "Int64", "duration": "Float64", "fps": "Float64"})

    return videos.select("video_id", "path").mapInPandas(probe, f"video_id string, {INFO_SCHEMA}, error string")


def sampled_frames(videos: DataFrame, decoder: Decoder, interval: float = 1.0) -> DataFrame:
    """Decode and sample: a frame's pixels are converted only if the schedule takes it."""
    import pandas as pd

    if interval <= 0:
        raise ValueError(f"a sampling interval is longer than 0 seconds, not {interval}")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for video, path in zip(batch["video_id"], batch["path"]):
                frames = decoder.frames(local_path(path))
                if frames is None:
                    raise FrameExtractionError(f"no video stream to take frames from: {path}")
                due, taken = 0.0, 0
                for k, (ts, handle) in enumerate(frames):
                    if ts >= due:
                        h, w, c, data = decoder.pixels(handle)
                        yield pd.DataFrame({"video_id": [video], "source_index": [k], "ts": [float(ts)], "frame_index": [taken], "image": [{"height": h, "width": w, "channels": c, "data": data}]})
                        due += interval
                        taken += 1

    return videos.select("video_id", "path").mapInPandas(decode, FRAME_SCHEMA)


def resolve_model(path: str | None, default: str, hint: str = "") -> str:
    """A model file's path, or ``FileNotFoundError`` with a hint where to get it."""
    chosen = path or default
    if not os.path.isfile(chosen):
        raise FileNotFoundError(f"model not found at '{chosen}'. {hint}".strip())
    return chosen


def ship_model(spark: SparkSession, path: str) -> str:
    """Send a model file to every executor; returns the name for ``SparkFiles.get``."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def write_table(df: DataFrame, path: str) -> None:
    """Overwrite a Parquet table, making folders as needed."""
    df.write.mode("overwrite").parquet(path)
