import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import gallery, identity, matching, tracking
from sightline.operators.identity import GrouperSettings
from sightline.operators.tracking import TrackerSettings
from sightline.plans import pipeline

SCHEMA = "video_id string, obs_id bigint, frame_index bigint, det_index int, ts double, box struct<x_min: bigint, y_min: bigint, x_max: bigint, y_max: bigint>, confidence double, embedding array<float>"


def unit(*v):
    a = np.array(v, float)
    return [float(x) for x in a / (np.linalg.norm(a) or 1)]


def observations(spark, rows, video="v"):
    """rows: (frame, box, vector[, confidence])"""
    out, seen = [], {}
    for k, (frame, b, v, *c) in enumerate(rows):
        d = seen[frame] = seen.get(frame, -1) + 1
        out.append((video, k, frame, d, frame * 0.25, tuple(b), float(c[0]) if c else 0.9, v))
    return spark.createDataFrame(out, SCHEMA)


def sizes(spark, rows, settings=None):
    obs = observations(spark, rows)
    t = tracking.tracks(obs, tracking.track_members(obs, settings)).orderBy("track_order").collect()
    return [r["size"] for r in t], t


A, B, X = (0, 0, 100, 100), (500, 500, 600, 600), unit(1, 0, 0)


def test_tracker_cases(spark):
    got, t = sizes(spark, [(f, (5 * f, 0, 100 + 5 * f, 100), X) for f in range(4)])
    assert got == [4] and (t[0].start_time, t[0].end_time) == (0.0, 0.75)
    assert sizes(spark, [(0, A, X), (1, B, X)])[0] == [1, 1]
    assert sizes(spark, [(f, b, v) for f in range(3) for b, v in ((A, X), (B, unit(0, 1, 0)))])[0] == [3, 3]
    assert sizes(spark, [(0, A, X), (1, A, unit(0, 1, 0))])[0] == [1, 1]  # the veto
    assert sizes(spark, [(0, A, X), (2, A, X)])[0] == [2]  # one frame missed
    assert sizes(spark, [(0, A, X), (3, A, X)])[0] == [1, 1]
    assert sizes(spark, [(0, A, X), (5, A, X)])[0] == [1, 1]
    _, t = sizes(spark, [(0, A, X, 0.75), (1, A, X, 0.95)])
    assert t[0].rep_obs_id == 1
    _, t = sizes(spark, [(0, A, X, 0.95), (1, A, X, 0.95)])
    assert t[0].rep_obs_id == 0
    _, t = sizes(spark, [(0, A, unit(1, 0, 0)), (1, A, unit(1, 1, 0))])
    assert np.linalg.norm(t[0].embedding) == pytest.approx(1, abs=1e-6) and t[0].embedding[0] > t[0].embedding[1] > 0


@pytest.mark.parametrize("bad", [(1.5, 1, 0.25), (0.3, -1, 0.25), (0.3, 1, 2)])
def test_tracker_settings(bad):
    with pytest.raises(ValueError):
        TrackerSettings(*bad)


def loop_tracker(rows, gap, floor=-1.0, least=0.3):
    """Frame by frame with lists; equal overlaps prefer the later live track, then the later detection."""
    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        c = max(0, w) * max(0, h)
        u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - c
        return c / u if u > 0 else 0.0

    live, made, out = [], 0, {}
    for f in sorted({r[0] for r in rows}):
        live = [t for t in live if f - t["f"] - 1 <= gap]
        now = [(k, r) for k, r in enumerate(rows) if r[0] == f]
        scored = sorted(((iou(t["b"], r[1]), i, j) for i, t in enumerate(live) for j, (_, r) in enumerate(now) if iou(t["b"], r[1]) >= least), reverse=True)
        ti, tj = set(), {}
        for _, i, j in scored:
            if i not in ti and j not in tj:
                ti.add(i)
                tj[j] = live[i]
        for j, (k, r) in enumerate(now):
            t = tj.get(j)
            if t is None:
                made += 1
                t = {"id": made}
                live.append(t)
            t["f"], t["b"] = f, r[1]
            out[k] = t["id"]
    return out


@pytest.mark.parametrize("gap", [0, 1])
def test_tracker_against_a_loop(spark, gap):
    rng = random.Random(gap)
    rows = []
    for f in range(30):
        for _ in range(rng.randrange(5)):
            x, y = rng.randrange(0, 60, 10), rng.randrange(0, 60, 10)
            rows.append((f, (x, y, x + 40, y + 40), X))
    obs = observations(spark, rows)
    got = {r.obs_id: r.track_id for r in tracking.track_members(obs.repartition(3), TrackerSettings(0.3, gap, -1)).collect()}
    assert got == loop_tracker(rows, gap)


def grouped(spark, vectors, settings, box=A, confidences=None):
    rows = [(10 * k, box, v, (confidences or {}).get(k, 0.9)) for k, v in enumerate(vectors)]
    obs = observations(spark, rows)
    members = tracking.track_members(obs)
    found = identity.group_members(obs, members, settings).orderBy("obs_id").collect()
    return [r.group_id for r in found], found


HALF = GrouperSettings(0.5, 0.05, 0.7, 40)
E1, E2, E3 = unit(1, 0, 0, 0), unit(0, 1, 0, 0), unit(0, 0, 1, 0)


def test_grouper_cases(spark):
    assert grouped(spark, [E1, unit(0.97, 0.1, 0.1, 0.1), unit(0.95, 0.12, 0.1, 0.12)], HALF)[0] == [1, 1, 1]
    assert grouped(spark, [E1, E2, E3], HALF)[0] == [1, 2, 3]
    assert grouped(spark, [E1, E2, unit(1, 1, 0, 0)], HALF)[0] == [1, 2, 3]
    assert grouped(spark, [E1, E2, unit(1.05, 1, 0, 0)], GrouperSettings(0.5, 0.1))[0] == [1, 2, 3]
    assert grouped(spark, [E1, E2, unit(0.98, 0.1, 0, 0), unit(0.1, 0.98, 0, 0)], HALF)[0] == [1, 2, 1, 2]
    ids, rows = grouped(spark, [E1, E2], HALF, confidences={1: 0.5})
    assert ids == [1, None] and rows[1].status == "unassigned"
    assert grouped(spark, [E1], HALF, box=(0, 0, 20, 20))[1][0].status == "unassigned"
    assert grouped(spark, [[float("nan"), 0.0]], HALF)[1][0].status == "unassigned"
    for bad in ({"similarity_threshold": 1.5}, {"margin_threshold": -0.1}):
        with pytest.raises(ValueError):
            GrouperSettings(**bad)


def test_nulls_in_pairs(spark):
    box = "struct<x_min: bigint, y_min: bigint, x_max: bigint, y_max: bigint>"
    rows = [("v", 0, 0, A, E1), ("v", 1, 0, A, None), ("v", 2, 0, None, E1), (None, 0, 0, A, E1), (None, 1, 0, A, E1), ("v", None, 0, A, E1)]
    table = spark.createDataFrame(rows, f"video_id string, frame_index bigint, det_index int, box {box}, embedding array<float>")
    got = matching.link_candidates(table, 1).collect()
    assert [(r.prev_frame, r.frame_index, r.similarity) for r in got] == [(0, 1, None)]
    pairs = spark.createDataFrame([(None, 1, 1, 0.5), ("g", None, 1, 0.9), ("g", 1, 1, None), ("g", 1, 2, 0.4), ("g", 1, 2, 0.4)], "g string, l int, r int, s double")
    assert [tuple(r) for r in matching.assign_one_to_one(pairs, ["g"], "l", "r", "s").collect()] == [("g", 1, 2, 0.4)] * 2


def test_link_candidates_are_filtered_by_the_shown_similarity(spark, tmp_path):
    """As in its SQL: one that is zero as shown stays, from below as -0.0; one below that or without a similarity goes."""
    import duckdb
    from sightline.plans import queries

    turned = lambda x: [x, 1.0]
    vectors = {4: E1[:2], 8: turned(-4.9e-6), 12: turned(-5.1e-6), 1: E1[:2], 5: turned(-4e-6), 9: turned(4e-6), 2: E1[:2], 6: turned(0.25), 10: None}
    table = spark.createDataFrame([(k, v, 0) for k, v in vectors.items()], "vec_id bigint, embedding array<float>, label int")
    table.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.link_candidates(spark, str(tmp_path)).collect()
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = db.sql(queries.oracle_sql()["link_candidates"]).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {(r.prev_frame, r.frame_index, r.det_index, repr(r.similarity)) for r in got} >= {(1, 2, 0, "-0.0"), (0, 1, 1, "-0.0"), (0, 2, 1, "0.0"), (0, 1, 2, "0.25")}
    assert not {(1, 3, 0), (0, 2, 2), (1, 2, 2)} & {(r.prev_frame, r.frame_index, r.det_index) for r in got}


def test_nulls_in_the_folds(spark):
    """Missing boxes, vectors, times and videos are neither an error nor lost."""
    box = "struct<x_min: bigint, y_min: bigint, x_max: bigint, y_max: bigint>"
    rows = [
        ("v", 0, 0, 0, 0.0, A, 0.9, E1), ("v", 1, 1, 0, 0.25, A, 0.9, None), ("v", 2, 2, 0, 0.5, None, 0.9, E1), ("v", 3, 3, 0, None, A, None, E1),
        ("v", 4, None, 0, None, A, 0.9, E2), (None, 5, 0, None, 0.0, A, 0.9, E1), (None, 6, 1, 0, None, A, 0.9, E1), ("w", 7, 0, 0, None, B, 0.9, E1),
    ]
    obs = spark.createDataFrame(rows, f"video_id string, obs_id bigint, frame_index bigint, det_index int, ts double, box {box}, confidence double, embedding array<float>")
    members = tracking.track_members(obs)
    track = {r.obs_id: r.track_id for r in members.collect()}
    assert len(track) == 8 and track[0] == track[1] == track[3] and len({track[0], track[2], track[4]}) == 3 and track[5] == track[6]
    facts = {(r.video_id, r.track_id): r for r in tracking.tracks(obs, members).collect()}
    assert len(facts) == 5 and facts["v", track[0]].rep_obs_id == 0 and facts["w", 1].start_time is None and facts["v", track[4]].track_order == 2
    found = {r.obs_id: r for r in identity.group_members(obs, members).collect()}
    assert {k: r.status for k, r in found.items()} == {0: "grouped", 1: "dropped", 2: "unassigned", 3: "dropped", 4: "grouped", 5: "grouped", 6: "grouped", 7: "grouped"}
    assert found[0].group_id == 1 and found[4].group_id == 2 and found[5].group_id == found[6].group_id == 1
    cards = identity.person_cards(obs, identity.group_members(obs, members))
    assert cards.count() == 4 and cards.where("video_id is null").first().detection_count == 2
    assert tracking.track_members(obs.limit(0)).count() == 0 and identity.group_members(obs.limit(0), members.limit(0)).count() == 0


def test_single_observations_are_grouped_in_time_order(spark):
    obs = observations(spark, [(0, A, E1, 0.9), (1, B, E2, 0.9), (2, A, unit(0.98, 0.1, 0, 0), 0.9), (3, A, E1, 0.3)])
    got = {r.obs_id: (r.group_id, r.seq, r.status) for r in identity.group_observations(obs, HALF).collect()}
    ids = [r.obs_id for r in obs.orderBy("frame_index").collect()]
    assert [got[i] for i in ids] == [(1, 0, "grouped"), (2, 0, "grouped"), (1, 1, "grouped"), (None, None, "unassigned")]
    leaders = identity.Leaders(HALF)
    assert [leaders.add(v) for v in (E1, E2, E1)] == [1, 2, 1]


def test_batches_may_cut_frames_and_tracks(spark):
    rng = random.Random(4)
    rows = [(f, (x, 0, x + 40, 40), unit(rng.random(), rng.random(), 1, 0)) for f in range(40) for x in (0, 15, 200, 210)]
    obs = observations(spark, rows)
    settings, name = TrackerSettings(0.3, 1, -1.0), "spark.sql.execution.arrow.maxRecordsPerBatch"
    whole = sorted(map(tuple, tracking.track_members(obs, settings).collect()))
    groups = sorted(map(tuple, identity.group_members(obs, tracking.track_members(obs, settings)).collect()), key=str)
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        assert sorted(map(tuple, tracking.track_members(obs, settings).collect())) == whole
        assert sorted(map(tuple, identity.group_members(obs, tracking.track_members(obs, settings)).collect()), key=str) == groups
    finally:
        spark.conf.set(name, before)


def test_tracks_into_groups(spark):
    obs = observations(spark, [(0, A, E1, 0.95), (1, A, E1, 0.2), (2, A, E1, 0.95)])
    got = {r.obs_id: r.status for r in identity.group_members(obs, tracking.track_members(obs)).collect()}
    assert got == {0: "grouped", 1: "dropped", 2: "grouped"}
    obs = observations(spark, [(0, A, E1), (9, B, unit(0.99, 0.05, 0, 0))])
    members = tracking.track_members(obs)
    assert members.select("track_id").distinct().count() == 2
    assert {r.group_id for r in identity.group_members(obs, members).collect()} == {1}


def test_cards_rank_and_select(spark):
    obs = observations(spark, [(0, A, E1, 0.75), (1, (0, 0, 300, 300), E1, 0.97), (2, B, E2), (3, B, E3)])
    ids = spark.createDataFrame([("v", 0, 1, 0), ("v", 1, 1, 1), ("v", 2, 2, 0), ("v", 3, 3, 0)], "video_id string, obs_id bigint, group_id bigint, seq bigint")
    cards = identity.person_cards(obs, ids)
    got = cards.orderBy("card_index").collect()
    assert [(c.group_id, c.detection_count, c.rep_obs_id) for c in got] == [(1, 2, 1), (2, 1, 2), (3, 1, 3)]
    assert identity.select_card(cards, 1).first().group_id == 2
    for index in (-1, 3):
        with pytest.raises(IndexError):
            identity.select_card(cards, index)


def test_assignment_equals_greedy(spark):
    rng = random.Random(5)
    rows = [(g, l, r, rng.randrange(1, 6) / 5) for g in range(20) for l in range(4) for r in range(4) if rng.random() < 0.6]
    got = matching.assign_one_to_one(spark.createDataFrame(rows, "g int, l int, r int, s double"), ["g"], "l", "r", "s").collect()
    want = set()
    for g in range(20):
        left, right = set(), set()
        for _, a, b in sorted(((s, a, b) for k, a, b, s in rows if k == g), reverse=True):
            if a not in left and b not in right:
                left.add(a), right.add(b), want.add((g, a, b))
    assert {(r.g, r.l, r.r) for r in got} == want


def test_centroids_in_blocks(spark):
    q = spark.createDataFrame([(k, unit(*np.random.default_rng(k).normal(size=4))) for k in range(20)], "id int, embedding array<float>")
    c = spark.createDataFrame([(k, unit(*np.random.default_rng(100 + k).normal(size=4))) for k in range(9)], "group_id int, embedding array<float>")
    rows = lambda n: sorted((r.id, r.group_id, round(r.best, 9), round(r.second, 9), r.accepted) for r in matching.nearest_centroids(q, c, "id", block_bytes=n).collect())
    assert rows(1 << 20) == rows(100) and len(rows(100)) == 20
    alone = matching.nearest_centroids(q, c.limit(1), "id").collect()
    assert all(r.second == -1.0 for r in alone)
    odd = spark.createDataFrame([(1, None), (2, [1.0, 0.0, 0.0, 0.0])], "id int, embedding array<float>")
    ties = spark.createDataFrame([(5, [1.0, 0.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0, 0.0]), (1, None)], "group_id int, embedding array<float>")
    assert sorted(map(tuple, matching.nearest_centroids(odd, ties, "id").collect())) == [(1, None, None, None, False), (2, 3, 1.0, 1.0, False)]
    assert [r.group_id for r in matching.nearest_centroids(odd, ties.limit(0), "id").collect()] == [None, None]


def loop_gallery(cands, gap, iou_least, most):
    from sightline.operators.tracking import overlaps

    chosen = []
    for k, c in sorted(enumerate(cands), key=lambda e: (-e[1][2], e[1][0])):
        if not any(abs(c[0] - o[0]) <= gap and overlaps(np.array([c[1]]), np.array([o[1]]))[0, 0] >= iou_least for _, o in chosen):
            chosen.append((k, c))
            if len(chosen) >= most:
                break
    return [k for k, _ in chosen]


def test_gallery_against_a_loop(spark):
    rng = random.Random(8)
    cands = []
    for _ in range(150):
        x, y = rng.randrange(0, 40, 5), rng.randrange(0, 40, 5)
        cands.append((rng.randrange(0, 40) / 4, (x, y, x + 40, y + 40), rng.randrange(60, 100) / 100))
    rows = spark.createDataFrame([("v", k, t, b, c) for k, (t, b, c) in enumerate(cands)], "video_id string, k int, ts double, box struct<x_min: bigint, y_min: bigint, x_max: bigint, y_max: bigint>, confidence double")
    for most in (1000, 5, 0):
        got = gallery.select_representatives(rows, most, 1.0, 0.6, order=["k"]).orderBy("item_index").collect()
        assert [r.k for r in got] == loop_gallery(cands, 1.0, 0.6, max(1, most))
    with pytest.raises(IndexError):
        gallery.select_item(gallery.select_representatives(rows, 3, order=["k"]), 3)


def test_exactly_one_second_apart_still_conflicts(spark):
    rows = spark.createDataFrame([("v", 0, 0.0, A, 0.9), ("v", 1, 1.0, A, 0.8), ("v", 2, 2.001, A, 0.7)], "video_id string, k int, ts double, box struct<x_min: bigint, y_min: bigint, x_max: bigint, y_max: bigint>, confidence double")
    assert [r.k for r in gallery.select_representatives(rows, order=["k"]).orderBy("item_index").collect()] == [0, 2]


def test_gallery_behind_a_join_turned_broadcast(spark):
    """A video stays in one task where the join's exchange by video is read without moving rows."""
    box = "struct<x_min: bigint, y_min: bigint, x_max: bigint, y_max: bigint>"
    rng = random.Random(9)
    cands = {f"v{v}": [(rng.randrange(0, 40) / 4, (x, 0, x + 40, 40), rng.randrange(60, 100) / 100) for x in (rng.randrange(1, 80) for _ in range(60))] for v in range(5)}
    rows = [(v, k, t, b, c) for v, of in cands.items() for k, (t, b, c) in enumerate(of)]
    rng.shuffle(rows)
    table = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), f"video_id string, k int, ts double, box {box}, confidence double")
    videos = spark.createDataFrame([(v, 1000, 1000) for v in cands], "video_id string, width int, height int").groupBy("video_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    limits = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "8KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for name, value in limits.items():
            spark.conf.set(name, value)
        got = gallery.select_representatives(gallery.candidates(table, videos), 12, 1.0, 0.6, order=["k"]).collect()
    finally:
        for name in limits:
            spark.conf.unset(name)
    for v, of in cands.items():
        assert [r.k for r in sorted((r for r in got if r.video_id == v), key=lambda r: r.item_index)] == loop_gallery(of, 1.0, 0.6, 12)


def test_end_to_end(spark):
    obs = observations(spark, [(f, A, E1) for f in range(4)] + [(f, B, E2) for f in range(2)] + [(20, A, E1)])
    videos = spark.createDataFrame([("v", 1000, 1000, 30.0)], "video_id string, width int, height int, duration double")
    found = pipeline.identities(obs, videos)
    report = pipeline.report(obs, found).first()
    assert (report.detections, report.tracks, report.identities, report.grouped) == (7, 3, 2, 7)
    got = pipeline.timestamps(found, videos, 0.25, select_index=0).orderBy("appearance_no").collect()
    assert [(r.start_time, r.end_time) for r in got] == [(0.0, 0.875), (4.875, 5.125)]
    assert pipeline.timestamps(found, videos, 0.25).select("group_id").distinct().count() == 2
    assert pipeline.face_gallery(obs, videos).count() == 3
