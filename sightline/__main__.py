"""The commands, for one video: info, extract, detect, gallery, group, timestamps.

    python -m sightline gallery clip.mp4 --decoder my_av:Decoder --detector my_faces:Detector

Decoders, detectors and embedders aren't bundled: each is named as ``module:factory``, a
callable without arguments (see ``sources.video`` and ``operators.inference``).  What can't
be loaded or chosen ends the program with a message and status 1.
"""

from __future__ import annotations

import argparse
import importlib
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.formatting import check_timestamp, describe_card, describe_item, run_report
from .functions.pixels import save_png
from .operators import gallery, inference
from .operators.filters import MIN_CONFIDENCE, MIN_SIDE
from .operators.identity import GrouperSettings, select_card
from .plans import pipeline
from .sources import video
from .sources.scratch import materialize

#: Observations of a frame are numbered within so many.
PER_FRAME = 1 << 20


def named(spec: str | None, what: str):
    """The factory that ``module:name`` stands for."""
    if not spec:
        raise video.VideoLoadError(f"this command needs --{what} module:factory")
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sightline", description="Find faces in a video and when each person appears.")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, folder: str | None = None) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=about)
        p.add_argument("video_path")
        p.add_argument("--decoder", required=True, help="module:factory of a video decoder")
        if name != "info":
            p.add_argument("--interval", type=float, default=1.0, help="seconds between sampled frames")
        if name not in ("info", "extract"):
            p.add_argument("--detector", required=True, help="module:factory of a face detector")
        if folder:
            p.add_argument("--output-dir", default=folder)
        return p

    def faces(p: argparse.ArgumentParser) -> None:
        p.add_argument("--confidence-threshold", type=float, default=0.6)
        p.add_argument("--padding", type=float, default=0.08, help="share of a face's box added around its crop")

    def people(p: argparse.ArgumentParser) -> None:
        faces(p)
        defaults = GrouperSettings()
        p.add_argument("--embedder", required=True, help="module:factory of a face embedder")
        p.add_argument("--similarity-threshold", type=float, default=defaults.similarity_threshold)
        p.add_argument("--margin-threshold", type=float, default=defaults.margin_threshold)
        p.add_argument("--min-confidence", type=float, default=MIN_CONFIDENCE)
        p.add_argument("--min-face-size", type=int, default=MIN_SIDE)

    command("info", "facts of the video stream")
    command("extract", "sample frames and count them")
    command("detect", "save sampled frames with their faces outlined", "output/detected-faces")
    p = command("gallery", "a montage of representative faces", "output/face-gallery")
    faces(p)
    p.add_argument("--max-items", type=int, default=gallery.MAX_ITEMS)
    p.add_argument("--select-index", type=int)
    p = command("group", "a montage of the people", "output/face-groups")
    people(p)
    p.add_argument("--select-index", type=int)
    p = command("timestamps", "when one person appears")
    people(p)
    p.add_argument("--gap-tolerance", type=float)
    p.add_argument("--appearance-padding", type=float)
    p.add_argument("--select-index", type=int, required=True)
    return out


class Run:
    """One video's tables, each made when first asked for."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.spark, self.args, self.start = spark, args, time.monotonic()
        decoder = named(args.decoder, "decoder")()
        self.videos = video.load_video(spark, args.video_path, decoder)
        self.decoder = decoder

    def info(self) -> dict:
        row = video.video_info(self.videos, self.decoder).first()
        if row.error:
            raise video.VideoLoadError(row.error)
        return {k: row[k] for k in ("width", "height", "codec", "frames", "duration", "fps")}

    def frames(self) -> DataFrame:
        return materialize(video.sampled_frames(self.videos, self.decoder, self.args.interval), "frames")

    def detections(self, frames: DataFrame) -> DataFrame:
        settings = inference.DetectorSettings(confidence_threshold=getattr(self.args, "confidence_threshold", 0.6))
        found = inference.detect_faces(frames, named(self.args.detector, "detector"), settings)
        return materialize(found.withColumn("obs_id", F.col("frame_index") * F.lit(PER_FRAME) + F.col("det_index")), "detections")

    def sizes(self, frames: DataFrame) -> DataFrame:
        """Of the video its frames' size and its duration; without one, the last sampled time."""
        duration = self.info()["duration"]
        rows = frames.groupBy("video_id").agg(F.max("image.width").alias("width"), F.max("image.height").alias("height"), F.max("ts").alias("last"))
        return rows.withColumn("duration", F.coalesce(F.lit(duration).cast("double"), "last"))

    def crops(self, rows: DataFrame, frames: DataFrame, order: str) -> list:
        """Rows (few) with the pixels of their ``crop_box``, in order."""
        met = rows.join(frames.select("video_id", "frame_index", "image"), ["video_id", "frame_index"])
        return met.withColumn("crop", inference.crop_pixels("image", "crop_box")).drop("image").orderBy(order).collect()

    def report(self, title: str, frames: int, counts: dict) -> None:
        print(run_report(title, frames, counts, time.monotonic() - self.start))

    def identities(self, frames: DataFrame, detections: DataFrame):
        a = self.args
        observations = materialize(inference.embed_detections(frames, detections, named(a.embedder, "embedder")), "embedded")
        grouper = GrouperSettings(a.similarity_threshold, a.margin_threshold, a.min_confidence, a.min_face_size)
        return pipeline.identities(observations, self.sizes(frames), a.confidence_threshold, a.padding, grouper=grouper)


def detect(run: Run, frames: DataFrame, n: int) -> None:
    found = run.detections(frames)
    paths = inference.write_frames(inference.annotate_frames(frames, found), run.args.output_dir).count()
    run.report("Detection Report", n, {"Total faces detected": found.count(), "Annotated frames saved": paths})


def make_gallery(run: Run, frames: DataFrame, n: int) -> None:
    a, found = run.args, run.detections(frames)
    usable = gallery.candidates(found, run.sizes(frames), a.padding)
    items = materialize(gallery.select_representatives(usable, a.max_items), "gallery")
    path = save_png(inference.gallery_montage(run.crops(items, frames, "item_index")), f"{a.output_dir}/face-gallery.png")
    run.report("Gallery Report", n, {"Detections received": found.count(), "Gallery candidates": usable.count(), "Gallery items": items.count(), "Gallery montage": path})
    if a.select_index is not None:
        print(describe_item(gallery.select_item(items, a.select_index).first().asDict(), a.select_index))


def group(run: Run, frames: DataFrame, n: int) -> None:
    a, found = run.args, run.detections(frames)
    people = run.identities(frames, found)
    facts = pipeline.report(found, people).first()
    chosen = people.cards.join(people.observations.select("video_id", F.col("obs_id").alias("rep_obs_id"), "frame_index", "crop_box"), ["video_id", "rep_obs_id"])
    path = save_png(inference.identity_montage(run.crops(chosen, frames, "card_index")), f"{a.output_dir}/identity-gallery.png")
    run.report("Grouping Report", n, {"Detections received": facts.detections, "Face tracks built": facts.tracks, "Identity groups found": facts.identities, "Observations grouped": facts.grouped, "Unassigned detections": facts.unassigned, "Identity gallery montage": path})
    if a.select_index is not None:
        print(describe_card(select_card(people.cards, a.select_index).first().asDict(), a.select_index))


def timestamps(run: Run, frames: DataFrame, n: int) -> None:
    a, found = run.args, run.detections(frames)
    people = run.identities(frames, found)
    if people.cards.isEmpty():
        print("No identity groups found; there is nothing to time.")
        return
    sizes = run.sizes(frames)
    card = select_card(people.cards, a.select_index).first()
    spans = pipeline.timestamps(people, sizes, a.interval, a.gap_tolerance, a.appearance_padding, a.select_index).orderBy("appearance_no").collect()
    print(f"Person #{a.select_index + 1}: {card.detection_count} detections, video of {sizes.first().duration:.2f} seconds, {len(spans)} appearances")
    for s in spans:
        print(f"Appearance {s.appearance_no}: {check_timestamp(s.start_time)} ({s.start_time:.2f}s) to {check_timestamp(s.end_time)} ({s.end_time:.2f}s)")
    facts = pipeline.report(found, people).first()
    run.report("Timestamps Report", n, {"Detections received": facts.detections, "Face tracks built": facts.tracks})


COMMANDS = {"detect": detect, "gallery": make_gallery, "group": group, "timestamps": timestamps}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sightline").getOrCreate()
    try:
        run = Run(spark, args)
        if args.command == "info":
            print(run.info())
            return 0
        frames = run.frames()
        n = frames.count()
        if args.command == "extract":
            print(f"Extracted {n} frames.")
        elif not n:
            print("No frames extracted.")
        else:
            COMMANDS[args.command](run, frames, n)
    except (video.VideoLoadError, video.FrameExtractionError, IndexError, ValueError, FileNotFoundError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
