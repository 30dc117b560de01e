"""SQL of the queries that depend on order: the folds, replayed a step a row by recursive queries."""

from __future__ import annotations

_IOU = """CASE WHEN (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) > c THEN c::DOUBLE / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - c) ELSE 0.0::DOUBLE END"""
_COMMON = "(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)))"


def _tracks(least_confidence: str) -> str:
    """``l`` (accepted links) and ``m`` (video_id, obs_id, track_id, seq) of the tracker, gap 1, overlap 0.3, no veto.

    A pair is taken if neither its earlier end goes on already nor its later end is
    continued; pairs come by later frame, then by overlap.
    """
    return f"""w AS (SELECT * FROM o WHERE confidence >= {least_confidence}::DOUBLE),
    p0 AS (SELECT a.video_id, a.obs_id AS a_id, b.obs_id AS b_id, a.frame_index AS af, b.frame_index AS bf, a.det_index AS ad, b.det_index AS bd, {_IOU} AS iou
      FROM w a JOIN w b ON a.video_id = b.video_id AND b.frame_index - a.frame_index BETWEEN 1 AND 2, LATERAL (SELECT {_COMMON} AS c)),
    p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY bf, iou DESC, af DESC, ad DESC, bd DESC) AS k FROM p0 WHERE iou >= 0.3),
    r AS (SELECT video_id, 0::BIGINT AS k, []::BIGINT[] AS ls, []::BIGINT[] AS rs, NULL::BIGINT AS a_id, NULL::BIGINT AS b_id FROM (SELECT DISTINCT video_id FROM p) UNION ALL
      SELECT p.video_id, p.k, CASE WHEN free THEN list_append(r.ls, p.a_id) ELSE r.ls END, CASE WHEN free THEN list_append(r.rs, p.b_id) ELSE r.rs END, CASE WHEN free THEN p.a_id END, CASE WHEN free THEN p.b_id END
      FROM r JOIN p ON p.video_id = r.video_id AND p.k = r.k + 1, LATERAL (SELECT NOT list_contains(r.ls, p.a_id) AND NOT list_contains(r.rs, p.b_id) AS free)),
    l AS (SELECT video_id, a_id, b_id FROM r WHERE a_id IS NOT NULL),
    c AS (SELECT video_id, obs_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_index, det_index) AS track_id, 0::BIGINT AS seq
        FROM w WHERE obs_id NOT IN (SELECT b_id FROM l) UNION ALL
      SELECT c.video_id, l.b_id, c.track_id, c.seq + 1 FROM c JOIN l ON l.a_id = c.obs_id),
    m AS (SELECT * FROM c),
    t AS (SELECT m.video_id, track_id, count(*) AS size, min(ts) AS start_time, max(ts) AS end_time, arg_min(m.obs_id, (-confidence * 1000000 + seq)::DOUBLE) AS rep_obs_id FROM m JOIN w ON w.obs_id = m.obs_id GROUP BY ALL),
    tt AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_time, track_id) - 1 AS track_order FROM t)"""


_GROUPS = """v AS (SELECT m.video_id, m.track_id, m.obs_id, m.seq, tt.track_order, w.ts, w.confidence, w.embedding, (w.x1 - w.x0) * (w.y1 - w.y0) AS area,
      w.confidence >= 0.7::DOUBLE AND least(w.x1 - w.x0, w.y1 - w.y0) >= 40 AS ok
      FROM m JOIN w ON w.obs_id = m.obs_id JOIN tt ON tt.video_id = m.video_id AND tt.track_id = m.track_id),
    s AS (SELECT video_id, track_id, track_order, i, sum(x) AS x FROM (SELECT video_id, track_id, track_order, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM v WHERE ok) GROUP BY ALL),
    u AS (SELECT video_id, track_id, list(x ORDER BY i) AS total, row_number() OVER (PARTITION BY video_id ORDER BY track_order) AS k FROM s GROUP BY video_id, track_id, track_order),
    g AS (SELECT video_id, 0::BIGINT AS k, NULL::BIGINT AS track_id, []::DOUBLE[][] AS sums, NULL::BIGINT AS group_id FROM (SELECT DISTINCT video_id FROM u) UNION ALL
      SELECT u.video_id, u.k, u.track_id,
        CASE WHEN near THEN list_transform(range(1, len(g.sums) + 1), lambda i: CASE WHEN i = spot THEN list_transform(range(1, len(u.total) + 1), lambda j: g.sums[i][j] + u.total[j]) ELSE g.sums[i] END) ELSE list_append(g.sums, u.total) END,
        CASE WHEN near THEN spot ELSE len(g.sums) + 1 END
      FROM g JOIN u ON u.video_id = g.video_id AND u.k = g.k + 1,
        LATERAL (SELECT list_transform(g.sums, lambda x: list_cosine_similarity(x, u.total)) AS scores) z1,
        LATERAL (SELECT list_max(scores) AS top, coalesce(list_reverse_sort(scores)[2], -1.0) AS second, list_position(scores, list_max(scores))::BIGINT AS spot) z2,
        LATERAL (SELECT coalesce(top >= 0.2 AND top - second >= 0.05, false) AS near) z3),
    f AS (SELECT v.video_id, v.track_id, v.obs_id, CASE WHEN ok THEN g.group_id END AS group_id, CASE WHEN ok THEN row_number() OVER (PARTITION BY v.video_id, g.group_id, ok ORDER BY track_order, v.seq) - 1 END AS seq,
      CASE WHEN ok THEN 'grouped' WHEN g.group_id IS NULL THEN 'unassigned' ELSE 'dropped' END AS status, ts, confidence FROM v LEFT JOIN g ON g.video_id = v.video_id AND g.track_id = v.track_id),
    cards AS (SELECT video_id, group_id, row_number() OVER (PARTITION BY video_id ORDER BY count(*) DESC, group_id) - 1 AS card_index FROM f WHERE group_id IS NOT NULL GROUP BY video_id, group_id)"""

_TIMES = """d AS (SELECT video_id, max(ts) + 0.25 AS dur FROM o GROUP BY video_id),
    x1 AS (SELECT f.video_id, f.group_id, ts, obs_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY f.video_id, f.group_id ORDER BY ts, obs_id) <= 0.5 THEN 0 ELSE 1 END AS fresh FROM f WHERE group_id IS NOT NULL),
    x2 AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id, group_id ORDER BY ts, obs_id) AS span FROM x1),
    x3 AS (SELECT x2.video_id, group_id, greatest(0.0, least(dur, min(ts) - 0.125)) AS a, greatest(0.0, least(dur, max(ts) + 0.125)) AS b FROM x2 JOIN d ON d.video_id = x2.video_id GROUP BY x2.video_id, group_id, span, dur),
    x4 AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY video_id, group_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM x3),
    x5 AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id, group_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS num FROM x4)"""


def fold_sql(observations: str) -> dict[str, str]:
    """``observations``: the common table ``o`` of the stand-in detections."""
    start = f"WITH RECURSIVE {observations}"
    return {
        "face_tracks": f"{start}, {_tracks('0.0')} SELECT video_id, track_id, track_order::INTEGER AS track_order, size, start_time, end_time, rep_obs_id FROM tt",
        "identity_groups": f"{start}, {_tracks('0.0')}, {_GROUPS} SELECT video_id, track_id, obs_id, group_id, seq, status FROM f",
        "identity_timestamps": f"""{start}, {_tracks('0.6')}, {_GROUPS}, {_TIMES}
          SELECT x5.video_id, x5.group_id, card_index::INTEGER AS card_index, num::INTEGER AS appearance_no, min(a) AS start_time, max(b) AS end_time FROM x5 JOIN cards ON cards.video_id = x5.video_id AND cards.group_id = x5.group_id GROUP BY x5.video_id, x5.group_id, card_index, num""",
        "pipeline_report": f"""{start}, {_tracks('0.6')}, {_GROUPS}
          SELECT (SELECT count(*) FROM o) AS detections, (SELECT count(*) FROM w) AS observations, (SELECT count(*) FROM t) AS tracks, (SELECT count(*) FROM cards) AS identities,
            count(*) FILTER (status = 'grouped') AS grouped, count(*) FILTER (status = 'unassigned') AS unassigned, count(*) FILTER (status = 'dropped') AS dropped FROM f""",
        "gallery_select": f"""{start}, q AS (SELECT video_id, obs_id, {{'ts': ts, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} AS b, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, ts, frame_index, det_index) AS k FROM o),
          e AS (SELECT video_id, 0::BIGINT AS k, NULL::BIGINT AS obs_id, [q.b] AS kept, 0::BIGINT AS n FROM q WHERE k = 1 UNION ALL
            SELECT q.video_id, q.k, CASE WHEN free THEN q.obs_id END, CASE WHEN free AND q.k > 1 THEN list_append(e.kept, q.b) ELSE e.kept END, e.n + free::BIGINT
            FROM e JOIN q ON q.video_id = e.video_id AND q.k = e.k + 1,
              LATERAL (SELECT e.n < 24 AND (q.k = 1 OR len(list_filter(e.kept, lambda a: abs(a.ts - q.b.ts) <= 1.0 AND
                1.3 * (greatest(0, least(a.x1, q.b.x1) - greatest(a.x0, q.b.x0)) * greatest(0, least(a.y1, q.b.y1) - greatest(a.y0, q.b.y0)))
                >= 0.3 * ((a.x1 - a.x0) * (a.y1 - a.y0) + (q.b.x1 - q.b.x0) * (q.b.y1 - q.b.y0)))) = 0) AS free))
          SELECT video_id, obs_id, n - 1 AS item_index FROM e WHERE obs_id IS NOT NULL""",
    }
