"""Sources, inference wrappers and streaming, with stand-ins for libraries that aren't bundled."""

import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import pixels
from sightline.operators import inference, tracking
from sightline.sources import video
from sightline.streaming.live import live_spans, live_tracks


class FakeDecoder:
    """A 'video' is text: a rate and a number of frames; 'audio' has no video stream."""

    def _parse(self, path):
        text = Path(path).read_text()
        return None if text == "audio" else tuple(map(int, text.split()))

    def info(self, path):
        found = self._parse(path)
        return found and {"width": 8, "height": 4, "codec": "fake", "frames": found[1], "duration": None if found[1] == 0 else found[1] / found[0], "fps": float(found[0])}

    def frames(self, path):
        found = self._parse(path)
        return found and ((k / found[0], k) for k in range(found[1]))

    def pixels(self, handle):
        return 4, 8, 3, bytes([handle % 256]) * 96


@pytest.fixture
def folder(tmp_path):
    for name, text in {"a.mp4": "10 45", "B.MOV": "2 6", "c.Mp4": "audio", "notes.txt": "x", "broken.mov": "what"}.items():
        (tmp_path / name).write_text(text)
    return tmp_path


def test_listing_and_loading(spark, folder):
    assert {r.video_id for r in video.list_videos(spark, str(folder)).select("video_id").collect()} == {"a.mp4", "B.MOV", "c.Mp4", "broken.mov"}
    assert video.load_video(spark, str(folder / "B.MOV")).count() == 1
    for bad, words in (("none.mp4", "exist"), ("", "not a file"), ("notes.txt", "Unsupported")):
        with pytest.raises(video.VideoLoadError, match=words):
            video.load_video(spark, str(folder / bad) if bad else str(folder))
    assert video.load_video(spark, str(folder / "a.mp4"), FakeDecoder()).count() == 1
    for bad, words in (("broken.mov", "Could not open"), ("c.Mp4", "video stream")):
        with pytest.raises(video.VideoLoadError, match=words):
            video.load_video(spark, str(folder / bad), FakeDecoder())
    with pytest.raises(FileNotFoundError, match="get it"):
        video.resolve_model(None, str(folder / "model.onnx"), "get it")
    assert video.resolve_model(str(folder / "a.mp4"), "x").endswith("a.mp4")


def test_info_and_sampling(spark, folder):
    videos = video.list_videos(spark, str(folder))
    info = {r.video_id: r for r in video.video_info(videos, FakeDecoder()).collect()}
    assert (info["a.mp4"].frames, info["a.mp4"].duration, info["a.mp4"].fps, info["a.mp4"].error) == (45, 4.5, 10.0, None)
    assert "video stream" in info["c.Mp4"].error and "Could not open" in info["broken.mov"].error
    good = videos.where(F.col("video_id").isin("a.mp4", "B.MOV"))
    frames = video.sampled_frames(good, FakeDecoder(), 1.0).orderBy("video_id", "frame_index").collect()
    assert [(f.video_id, f.frame_index, f.ts) for f in frames] == [("B.MOV", k, float(k)) for k in range(3)] + [("a.mp4", k, float(k)) for k in range(5)]
    with pytest.raises(Exception, match="video stream"):
        video.sampled_frames(videos.where("video_id = 'c.Mp4'"), FakeDecoder()).collect()
    with pytest.raises(ValueError):
        video.sampled_frames(good, FakeDecoder(), 0)


class FakeDetector:
    def detect(self, bgr, settings):
        assert bgr.shape == (640, 640, 3)
        rows = np.zeros((4, 15))
        rows[0, :4], rows[0, 14] = (10, 200, 100, 80), 0.7
        rows[1, :4], rows[1, 14] = (300, 200, 100, 80), 0.9
        rows[2, :4], rows[2, 14] = (300, 200, 100, 80), 0.59
        rows[3, :4], rows[3, 14] = (-90, 200, 50, 80), 0.99
        return rows

    def close(self):
        pass


class FakeEmbedder:
    def embed(self, bgr, row):
        if row[0, 14] < 0.8:
            raise ValueError("no")
        return np.array([3.0, 4.0])

    def close(self):
        pass


def frames_table(spark):
    grey = {"height": 360, "width": 640, "channels": 1, "data": bytes(360 * 640)}
    rgb = {"height": 360, "width": 640, "channels": 3, "data": bytes(360 * 640 * 3)}
    return spark.createDataFrame([("v", 0, 0.0, rgb), ("v", 1, 0.5, grey), ("v", 2, 1.0, None)], "video_id string, frame_index bigint, ts double, image struct<height: int, width: int, channels: int, data: binary>")


def test_detect_embed_crop(spark, tmp_path):
    frames = frames_table(spark)
    found = inference.detect_faces(frames, FakeDetector)
    rows = found.orderBy("det_index").collect()
    assert [(r.frame_index, r.det_index, r.confidence, tuple(r.box)) for r in rows] == [(0, 0, 0.9, (300, 60, 400, 140)), (0, 1, 0.7, (10, 60, 110, 140))]
    embedded = inference.embed_detections(frames, found, FakeEmbedder).collect()
    assert [(r.det_index, r.embedding) for r in embedded] == [(0, pytest.approx([0.6, 0.8]))]
    crop = found.join(frames.select("frame_index", "image"), "frame_index").select(inference.crop_pixels("image", "box").alias("c")).first().c
    assert (crop.height, crop.width, len(crop.data)) == (80, 100, 24_000)
    drawn = inference.annotate_frames(frames, found).collect()
    assert [d.name for d in drawn] == ["frame_0000_ts_0.00.png"] and b"\xff\x00\x00" in bytes(drawn[0].image.data)
    paths = [r.path for r in inference.write_frames(inference.annotate_frames(frames, found), str(tmp_path / "out dir")).collect()]
    assert [Path(p).name for p in paths] == ["frame_0000_ts_0.00.png"] and unpng(Path(paths[0]).read_bytes()).shape == (360, 640, 3)
    with pytest.raises(ValueError):
        inference.DetectorSettings(input_size=(0, 5))


def unpng(data):
    """The pixels of a PNG without filters."""
    at, kinds = 8, {}
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        kinds[kind] = data[at + 8 : at + 8 + n]
        assert zlib.crc32(data[at + 4 : at + 8 + n]) == struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]
        at += 12 + n
    w, h = struct.unpack(">II", kinds[b"IHDR"][:8])
    return np.frombuffer(zlib.decompress(kinds[b"IDAT"]), np.uint8).reshape(h, 1 + 3 * w)[:, 1:].reshape(h, w, 3)


def test_resampling():
    flat = np.full((7, 11, 3), 200, np.uint8)
    for kind, size in (("linear", (30, 5)), ("cubic", (40, 40)), ("area", (3, 2))):
        assert (pixels.resize(flat, *size, kind) == 200).all() and np.allclose(pixels.weights(9, 4, kind).sum(axis=1), 1)
    ramp = np.repeat(np.arange(0, 160, 10, dtype=np.uint8)[None, :, None], 3, axis=2).repeat(4, axis=0)
    assert pixels.resize(ramp, 4, 2, "area")[0, :, 0].tolist() == [15, 55, 95, 135]
    assert pixels.resize(ramp, 32, 4, "linear")[0, :6, 0].tolist() == [0, 2, 8, 12, 18, 22]
    assert np.array_equal(pixels.resize(ramp, 16, 4, "cubic"), ramp)
    with pytest.raises(ValueError):
        pixels.resize(ramp, 4, 4, "sharp")


def test_thumbnails_and_montage(tmp_path):
    tile = inference.thumbnail(np.full((50, 100, 3), 9, np.uint8))
    assert tile.shape == (192, 192, 3) and tile[0].max() == 0 and tile[96].min() == 9
    assert inference.montage([]).shape == (272, 216, 3)
    assert inference.montage([tile] * 5).shape == (544, 864, 3)
    box = {"x_min": 1, "y_min": 2, "x_max": 30, "y_max": 40}
    crop = {"height": 50, "width": 100, "channels": 3, "data": bytes([9]) * 15_000}
    items = [{"crop": crop, "ts": 1.5, "confidence": 0.75, "box": box}] * 5
    labelled = inference.gallery_montage(items)
    assert labelled.shape == (544, 864, 3) and (labelled[204:272] == 235).any() and (labelled[476:544, 216:] == 24).all()
    cards = [{"crop": crop, "detection_count": 3, "first_seen": 0.0, "last_seen": 9.5, "best_confidence": 0.9}]
    people = inference.identity_montage(cards)
    assert people.shape == (272, 864, 3) and not np.array_equal(people[204:, :216], labelled[204:272, :216])
    assert np.array_equal(unpng(Path(pixels.save_png(people, str(tmp_path / "new" / "m.png"))).read_bytes()), people)
    for bad in (lambda: inference.montage([], 0), lambda: inference.thumbnail(np.zeros((2, 2))), lambda: inference.thumbnail(tile, (0, 1))):
        with pytest.raises(ValueError):
            bad()


def test_streams_equal_batch(spark, tmp_path):
    rows = [("v" if k % 3 else "w", k, k // 4, k % 4, (10 * (k % 4), 0, 10 * (k % 4) + 9, 50), [1.0, 0.0]) for k in range(80)]
    schema = "video_id string, obs_id bigint, frame_index bigint, det_index int, box struct<x_min: bigint, y_min: bigint, x_max: bigint, y_max: bigint>, embedding array<float>"
    table = spark.createDataFrame(rows, schema)
    for part in range(2):  # two micro-batches of whole frames, in order
        table.where(F.floor(F.col("frame_index") / 10) == part).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = live_tracks(stream).writeStream.format("memory").queryName("tracks").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("tracks").collect())) == sorted(map(tuple, tracking.track_members(table).collect()))


def test_live_spans_are_inclusive(spark):
    rows = spark.createDataFrame([(1, t) for t in (0.0, 6.0, 12.0, 18.5)], "person int, t double").select("person", F.timestamp_micros((F.col("t") * 1e6).cast("bigint")).alias("ts"))
    got = live_spans(rows, ["person"], 6.0).orderBy("first_ts").select("n").collect()
    assert [r.n for r in got] == [3, 1]
