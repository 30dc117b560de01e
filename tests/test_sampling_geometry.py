import math
import random

import pytest
from pyspark.sql import functions as F

from sightline.functions import geometry as geo
from sightline.functions import vectors
from sightline.operators.filters import confident, is_reliable
from sightline.operators.sampling import sample_frames


@pytest.mark.parametrize("interval, count", [(0.25, 94), (0.5, 47), (1.0, 24), (10.0, 3), (30.0, 1)])
def test_sampling_of_a_plain_timeline(spark, interval, count):
    rows = spark.range(701).select((F.col("id") / 30.0).alias("ts"))
    got = sample_frames(rows, interval)
    assert got.count() == count
    assert [r.frame_index for r in got.orderBy("ts").collect()] == list(range(count))


def schedule(times, interval):
    due, out = 0.0, []
    for t in times:
        if t >= due:
            out.append(t)
            due += interval
    return out


@pytest.mark.parametrize("interval, exact", [(0.5, False), (1.0, False), (0.1, True), (1 / 3, True)])
def test_sampling_catches_up_after_jumps(spark, interval, exact):
    rng = random.Random(3)
    videos = {}
    for v in range(20):
        t, times = 0.0, []
        for _ in range(60):
            t += rng.choice([0.0, 0.1, 0.25, 0.3, 5.0])
            times.append(t)
        videos[v] = times
    rows = spark.createDataFrame([(v, k, t) for v, ts in videos.items() for k, t in enumerate(ts)], "v int, k int, ts double")
    got = sample_frames(rows, interval, ["v"], order=["k"], exact=exact).orderBy("v", "frame_index").collect()
    assert [(r.v, r.ts) for r in got] == [(v, t) for v, ts in videos.items() for t in schedule(ts, interval)]


def test_sampling_edges(spark):
    rows = spark.createDataFrame([(-1.0,), (None,), (0.5,)], "ts double")
    assert [r.ts for r in sample_frames(rows, 1.0).collect()] == [0.5]
    with pytest.raises(ValueError):
        sample_frames(rows, 0)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit_box(*edges):
    return geo.box(*edges)


def test_overlap(spark):
    a = lit_box(0, 0, 10, 10)
    assert one(spark, geo.intersection_over_union(a, lit_box(0, 0, 10, 10))) == 1.0
    assert one(spark, geo.intersection_over_union(a, lit_box(5, 0, 15, 10))) == pytest.approx(1 / 3)
    assert one(spark, geo.intersection_over_union(a, lit_box(20, 20, 30, 30))) == 0.0
    assert one(spark, geo.intersection_over_union(lit_box(5, 5, 5, 5), lit_box(5, 5, 5, 5))) == 0.0
    big = 3_000_000_000
    assert one(spark, geo.intersection_over_union(lit_box(0, 0, big, 2), lit_box(0, 0, big, 1))) == 0.5


def test_letterbox_and_back(spark):
    fit = one(spark, geo.letterbox(F.lit(1280), F.lit(720)))
    assert (fit.scale, fit.width, fit.height, fit.pad_x, fit.pad_y) == (0.5, 640, 360, 0, 140)
    back = one(spark, geo.map_box(F.lit(10.0), F.lit(150.0), F.lit(100.0), F.lit(50.0), geo.letterbox(F.lit(1280), F.lit(720)), F.lit(1280), F.lit(720)))
    assert tuple(back) == (20, 20, 220, 120)
    out = geo.map_box(F.lit(-50.0), F.lit(0.0), F.lit(10.0), F.lit(10.0), geo.letterbox(F.lit(640), F.lit(640)), F.lit(640), F.lit(640))
    assert one(spark, out) is None
    assert one(spark, geo.letterbox(F.lit(10000), F.lit(1))).height == 1
    with pytest.raises(ValueError):
        geo.letterbox(F.lit(1), F.lit(1), 0, 5)


def test_rounding_is_half_to_even(spark):
    assert [one(spark, geo.rounded(F.lit(x))) for x in (0.5, 1.5, 2.5, -0.5)] == [0, 2, 2, 0]


def test_crops(spark):
    crop = lambda b, p=0.08: one(spark, geo.padded_crop(b, F.lit(100), F.lit(100), p))
    assert tuple(crop(lit_box(10, 10, 60, 60))) == (6, 6, 64, 64)
    assert tuple(crop(lit_box(10, 10, 60, 60), 0.0)) == (9, 9, 61, 61)
    assert tuple(crop(lit_box(0, 0, 100, 100))) == (0, 0, 100, 100)
    assert crop(lit_box(10, 10, 10, 20)) is None
    assert crop(lit_box(200, 10, 220, 20)) is None
    with pytest.raises(ValueError):
        geo.padded_crop(lit_box(0, 0, 1, 1), F.lit(1), F.lit(1), -0.1)


def test_model_row(spark):
    marks = F.struct(*(F.struct(F.lit(float(k)).alias("x"), F.lit(float(k + 100)).alias("y")).alias(n) for k, n in enumerate(geo.LANDMARKS)))
    row = one(spark, geo.model_row(lit_box(1, 2, 11, 22), marks, F.lit(0.5)))
    assert row == [1, 2, 10, 20, 0, 100, 1, 101, 2, 102, 3, 103, 4, 104, 0.5]
    assert one(spark, geo.model_row(lit_box(1, 2, 3, 4), F.lit(None).cast(spark.range(1).select(marks.alias("m")).schema["m"].dataType), F.lit(0.5))) is None


def vector(*values):
    return F.array(*(F.lit(float(v)).cast("float") for v in values))


def test_vectors(spark):
    assert one(spark, vectors.dot(vector(1, 0), vector(0, 1))) == 0.0
    assert one(spark, vectors.dot(vector(0.6, 0.8), vector(0.6, 0.8))) == pytest.approx(1.0)
    assert one(spark, vectors.normalized(vector(3, 4))) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.normalized(vector(0, 0))) == [0, 0]
    good = {"ok": vector(1, 2), "zero": vector(0, 0), "nan": vector(math.nan, 1), "inf": vector(math.inf, 1), "empty": F.array().cast("array<float>"), "null": F.lit(None).cast("array<float>")}
    assert {k: one(spark, vectors.is_valid(v)) for k, v in good.items()} == {"ok": True, "zero": True, "nan": False, "inf": False, "empty": False, "null": False}
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (1, [1.0, 1.0, 0.0])], "k int, embedding array<float>")
    mean = vectors.mean_embedding(rows, ["k"]).first().embedding
    assert sum(x * x for x in mean) == pytest.approx(1.0) and mean[0] > mean[1] > 0


def test_predicates(spark):
    rows = spark.createDataFrame([(0.6,), (0.59,)], "confidence double")
    assert confident(rows, 0.6).count() == 1
    ok = lambda c, side, v=vector(1): one(spark, is_reliable(v, F.lit(c), lit_box(0, 0, side, 200)))
    assert [ok(0.7, 40), ok(0.69, 40), ok(0.9, 39), ok(0.9, 50, vector(math.nan))] == [True, False, False, False]


def test_montage_cells(spark):
    cells = [one(spark, geo.grid_cell(F.lit(k))) for k in (0, 3, 4)]
    assert [(c.row, c.column, c.top, c.left) for c in cells] == [(0, 0, 0, 0), (0, 3, 0, 648), (1, 0, 272, 0)]
    with pytest.raises(ValueError):
        geo.grid_cell(F.lit(0), 0)
