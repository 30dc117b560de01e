import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.functions.formatting import check_timestamp, format_timestamp
from sightline.operators import timeline
from pyspark.sql import functions as F

# name, times, duration, sample interval, gap, padding, intervals
CASES = [
    ("nearby", [4.23, 4.57, 5.10, 5.63], 30, 1, None, None, [(3.73, 6.13)]),
    ("separated", [4.23, 4.57, 5.10, 20.43, 20.77], 30, 1, None, None, [(3.73, 5.60), (19.93, 21.27)]),
    ("gap at its edge", [0, 2.0], 30, 1, None, None, [(0, 2.5)]),
    ("gap past its edge", [0, 2.1], 30, 1, None, None, [(0, 0.5), (1.6, 2.6)]),
    ("short gap", [0, 3], 30, 1, 1, None, [(0, 0.5), (2.5, 3.5)]),
    ("long gap", [0, 3], 30, 1, 5, None, [(0, 3.5)]),
    ("no touch", [0, 10, 10.5], 30, 1, 0.6, 2, [(0, 2), (8, 12.5)]),
    ("padding merges", [0, 3.5, 4], 30, 1, 0.6, 2, [(0, 6)]),
    ("unordered", [31, 32, 2, 3, 15, 16], 40, 1, None, None, [(1.5, 3.5), (14.5, 16.5), (30.5, 32.5)]),
    ("clamped", [0.05, 59.9], 60, 1, 1000, 5, [(0, 60)]),
    ("single", [12], 30, 1, None, None, [(11.5, 12.5)]),
    ("irregular", [0.033, 4.9, 19.97], 30, 1, None, None, [(0, 0.533), (4.4, 5.4), (19.47, 20.47)]),
    ("fine", [10], 30, 0.5, None, None, [(9.75, 10.25)]),
    ("coarse", [10], 30, 2, None, None, [(9, 11)]),
    ("documented", [10.5, 12.0, 12.5, 17.0], 30, 0.5, None, None, [(10.25, 10.75), (11.75, 12.75), (16.75, 17.25)]),
    ("past the end", [40], 30, 1, None, None, [(30, 30)]),
    ("repeated times", [5, 5, 5], 30, 1, None, None, [(4.5, 5.5)]),
]


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_intervals(spark, case):
    _, times, duration, step, gap, padding, want = case
    rows = spark.createDataFrame([(1, float(t)) for t in times], "person bigint, ts double")
    got = timeline.appearance_intervals(rows, ["person"], duration, step, gap, padding).orderBy("appearance_no").collect()
    assert [(pytest.approx(a), pytest.approx(b)) for a, b in want] == [(r.start_time, r.end_time) for r in got]


def test_empty_and_null_times(spark):
    rows = spark.createDataFrame([(1, None)], "person bigint, ts double")
    assert timeline.appearance_intervals(rows, ["person"], 10, 1.0).count() == 0


@pytest.mark.parametrize("arguments", [(-1, 1, None, None), (10, 0, None, None), (10, 1, -1, None), (10, 1, None, -1)])
def test_bad_settings(spark, arguments):
    duration, step, gap, padding = arguments
    rows = spark.createDataFrame([(1, 1.0)], "person bigint, ts double")
    with pytest.raises(ValueError):
        timeline.appearance_intervals(rows, ["person"], duration, step, gap, padding)


def plain(times, gap, padding, duration):
    spans = []
    for t in sorted(times):
        if spans and t - spans[-1][1] <= gap:
            spans[-1][1] = t
        else:
            spans.append([t, t])
    out = []
    for a, b in ((max(0, min(duration, a - padding)), max(0, min(duration, b + padding))) for a, b in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(map(float, x)) for x in out]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(0, 400), min_size=1, max_size=25), min_size=1, max_size=6), st.integers(0, 20), st.integers(0, 20), st.integers(0, 300))
def test_many_people_against_a_loop(spark, people, gap, padding, duration):
    rows = spark.createDataFrame([(k, t / 4) for k, times in enumerate(people) for t in times], "person bigint, ts double")
    found = {}
    for r in timeline.appearance_intervals(rows, ["person"], duration / 4, 1.0, gap / 4, padding / 4).orderBy("person", "appearance_no").collect():
        found.setdefault(r.person, []).append((r.start_time, r.end_time))
    assert found == {k: plain([t / 4 for t in times], gap / 4, padding / 4, duration / 4) for k, times in enumerate(people)}


def test_timestamps(spark):
    shown = {0.0: "00:00.00", 4.23: "00:04.23", 65.5: "01:05.50", 59.999: "01:00.00", 6000.0: "100:00.00", 600000.5: "10000:00.50"}
    rows = spark.createDataFrame([(k,) for k in shown], "t double").select("t", format_timestamp(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == shown == {k: check_timestamp(k) for k in shown}
    assert spark.createDataFrame([(-1.0,)], "t double").select(format_timestamp(F.col("t")).alias("s")).first().s is None
    with pytest.raises(ValueError):
        check_timestamp(-1)


def test_duration_fallback(spark):
    videos = spark.createDataFrame([("a", 9.0), ("b", None), ("c", None)], "video_id string, duration double")
    frames = spark.createDataFrame([("a", 3.0), ("b", 4.0), ("b", 5.5)], "video_id string, ts double")
    got = {r.video_id: r.duration for r in timeline.with_duration(videos, frames).collect()}
    assert got == {"a": 9.0, "b": 5.5, "c": None}
