"""Queries over a calibrated log in several clips, whose frames all begin at 0: detections, votes, clicks and drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchflow.operators import detections as D
from pitchflow.operators import render as R
from pitchflow.operators import tracks as T
from pitchflow.plans.catalog import _VOTE, BASE, QUERIES, SQL, _clicks, _sightings, log_of
from pitchflow.plans.pixels import CLIP_FRAMES, _CLIPS
from pitchflow.sources.files import stored
from pitchflow.sources.position_log import in_clips
from pitchflow.streaming.association import BOX, associate

# The pixel queries' tables in metres, and boxes
_METRES = (
    _CLIPS.replace("pixel_x AS x, pixel_y AS y,", "pitch_x AS x, pitch_y AS y, pixel_x, pixel_y, is_predicted,")
    .replace("WHERE class_name = 'sports ball')", "WHERE class_name = 'sports ball' AND b.x BETWEEN -10 AND 115 AND b.y BETWEEN -10 AND 78)")
    .replace("WHERE dist <= scale * 0.6::DOUBLE)", "WHERE dist <= 3.0)")
)
_TABLES = f"""{_METRES},
cboxes AS (SELECT clip_id, frame, log_seq AS det_seq, track_id, class_name, pixel_x - floor(bbox_height / 2) / 2 AS x1, pixel_y - bbox_height AS y1, pixel_x + floor(bbox_height / 2) / 2 AS x2, pixel_y AS y2, (log_seq * 37 % 100) / 100.0::DOUBLE AS confidence FROM c),
cpasses AS (SELECT m.clip_id, m.start_frame AS event_frame, m.prev_track_id AS from_track, m.track_id AS to_track, a.pixel_x AS from_x, a.pixel_y AS from_y, b.pixel_x AS to_x, b.pixel_y AS to_y
FROM cmade m JOIN c a ON a.clip_id = m.clip_id AND a.track_id = m.prev_track_id AND a.frame = m.prev_end_frame JOIN c b ON b.clip_id = m.clip_id AND b.track_id = m.track_id AND b.frame = m.start_frame)"""


def over_clips(name: str, sql: str | None, *columns: str):
    """Registers a query over the log in clips."""

    def add(f):
        def query(spark, sf_dir: str) -> DataFrame:
            out = f(in_clips(log_of(spark, sf_dir), CLIP_FRAMES))
            return out.select(*columns) if columns else out

        QUERIES[name] = query
        if sql:
            SQL[name] = BASE + _TABLES + sql
        return f

    return add


def _passes(log: DataFrame) -> DataFrame:
    return T.pass_events(log, T.possession_runs(T.possessors(log)))


def pass_overlay(log: DataFrame) -> DataFrame:
    """Rings and passes come from one possession, made once."""
    possession = stored(T.possessors(log), "possessors")
    return R.pass_overlay(log, possession, stored(T.pass_events(log, T.possession_runs(possession)), "passes"))


over_clips("clips_singletons", " SELECT clip_id, det_seq FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, frame, class_name ORDER BY confidence DESC, det_seq) AS k FROM cboxes) WHERE k = 1 OR class_name NOT IN ('sports ball', 'ref')", T.CLIP, "det_seq")(
    lambda log: D.best_of_singletons(D.boxes(log), ("sports ball", "ref"))
)
_ONE = "{'det_seq': r.det_seq, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}"
_IOU = "greatest(0.0, least(k.x2, r.x2) - greatest(k.x1, r.x1)) * greatest(0.0, least(k.y2, r.y2) - greatest(k.y1, r.y1))"
over_clips(
    "clips_detect",
    f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame, class_name ORDER BY confidence DESC, det_seq) AS rn FROM cboxes WHERE confidence >= CASE WHEN class_name = 'sports ball' THEN 0.1 ELSE 0.3 END),
nms AS (SELECT clip_id, frame, class_name, rn, [{_ONE}] AS kept FROM ranked r WHERE rn = 1
        UNION ALL SELECT r.clip_id, r.frame, r.class_name, r.rn, CASE WHEN len(list_filter(n.kept, lambda k: {_IOU} > 0.5 * ((k.x2 - k.x1) * (k.y2 - k.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - {_IOU}))) > 0 THEN n.kept ELSE list_append(n.kept, {_ONE}) END
        FROM nms n JOIN ranked r ON r.clip_id = n.clip_id AND r.frame = n.frame AND r.class_name = n.class_name AND r.rn = n.rn + 1),
final AS (SELECT clip_id, frame, class_name, arg_max(kept, rn) AS kept FROM nms GROUP BY ALL)
SELECT clip_id, unnest(CASE WHEN class_name = 'sports ball' THEN kept[1:1] ELSE kept END).det_seq AS det_seq FROM final""",
    T.CLIP, "det_seq",
)(lambda log: D.detect(D.boxes(log), "sports ball"))
over_clips("clips_first_ball", " SELECT clip_id, frame, min(det_seq) AS det_seq FROM cboxes WHERE class_name = 'sports ball' GROUP BY ALL")(lambda log: D.boxes(log).filter("class_name = 'sports ball'").groupBy(*D.FRAME).agg(F.min("det_seq").alias("det_seq")))
over_clips(
    "clips_click_box",
    """, k AS (SELECT clip_id, frame, log_seq AS click_id, pixel_x AS cx, pixel_y - CASE WHEN class_name <> 'sports ball' THEN bbox_height / 2 ELSE 0 END AS cy FROM c WHERE class_name = 'sports ball' OR log_seq % 3 = 0),
q AS (SELECT k.clip_id, k.frame, click_id, b.det_seq, NOT (cx BETWEEN x1 AND x2 AND cy BETWEEN y1 AND y2) AS far, sqrt((cx - (x1 + x2) / 2) * (cx - (x1 + x2) / 2) + (cy - (y1 + y2) / 2) * (cy - (y1 + y2) / 2)) AS d, (x2 - x1) * (y2 - y1) AS area FROM k JOIN cboxes b ON b.clip_id = k.clip_id AND b.frame = k.frame AND b.class_name = 'person')
SELECT clip_id, frame, click_id, det_seq, far AS by_centre FROM (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY far, CASE WHEN far THEN d ELSE area END, det_seq) AS k FROM q WHERE NOT far OR d <= 80) WHERE k = 1""",
)(lambda log: D.click_boxes(_clicks(log), D.boxes(log).filter("class_name = 'person'")))
over_clips(
    "clips_topdown",
    """ SELECT clip_id, frame, 'ball' AS kind, CAST(-1 AS BIGINT) AS track_id, CAST(trunc((x + 4) * 10) AS INTEGER) AS px, CAST(trunc((y + 4) * 10) AS INTEGER) AS py, 'ball' AS color, NOT was_interpolated AS filled FROM cball
UNION ALL SELECT clip_id, frame, 'player', track_id, CAST(trunc((x + 4) * 10) AS INTEGER), CAST(trunc((y + 4) * 10) AS INTEGER), coalesce('team_' || team, 'none'), true FROM cp""",
)(lambda log: R.topdown(log, T.clean_ball(log)))
over_clips("clips_overlay", " SELECT p.clip_id, p.frame, p.track_id, p.team, l.pixel_x, l.pixel_y FROM cposs p LEFT JOIN c l ON l.clip_id = p.clip_id AND l.track_id = p.track_id AND l.frame = p.frame")(lambda log: R.overlay(log, T.possessors(log)))
over_clips("clips_annotate", " SELECT clip_id, log_seq, frame, CASE WHEN class_name = 'sports ball' THEN 'ball' ELSE '#' || track_id || coalesce(' T' || team, '') END AS label, coalesce('team_' || team, 'none') AS color FROM c")(R.annotations)
over_clips("clips_running_pass_count", " SELECT clip_id, event_frame, CAST(sum(count(*)) OVER (PARTITION BY clip_id ORDER BY event_frame) AS BIGINT) AS passes FROM cpasses GROUP BY clip_id, event_frame")(lambda log: R.running_passes(_passes(log)))
over_clips(
    "clips_pass_overlay",
    """, z AS (SELECT clip_id, max(frame) AS last FROM c GROUP BY clip_id), spine AS (SELECT clip_id, unnest(generate_series(0, last)) AS frame FROM z)
SELECT p.clip_id, p.frame, 'ring' AS kind, p.track_id, NULL::BIGINT AS to_track, CAST(trunc(l.pixel_x) AS INTEGER) AS x, CAST(trunc(l.pixel_y) AS INTEGER) AS y, NULL::INTEGER AS to_x, NULL::INTEGER AS to_y, 1.0::DOUBLE AS alpha, NULL::BIGINT AS passes
FROM cposs p JOIN c l ON l.clip_id = p.clip_id AND l.frame = p.frame AND l.track_id = p.track_id
UNION ALL SELECT clip_id, event_frame + age, 'arrow', from_track, to_track, CAST(trunc(from_x) AS INTEGER), CAST(trunc(from_y) AS INTEGER), CAST(trunc(to_x) AS INTEGER), CAST(trunc(to_y) AS INTEGER), round(1 - age / 40.0::DOUBLE, 6), NULL
FROM cpasses JOIN z USING (clip_id), (SELECT unnest(range(40)) AS age) WHERE event_frame + age <= last
UNION ALL SELECT clip_id, frame, 'count', NULL, NULL, 20, 40, NULL, NULL, 1.0, (SELECT count(*) FROM cpasses e WHERE e.clip_id = spine.clip_id AND e.event_frame <= spine.frame) FROM spine""",
)(pass_overlay)
# No SQL: tests/test_association.py holds it against permutations, tests/test_clips.py each clip against itself alone
over_clips("clips_bytetrack", None)(lambda log: associate(D.boxes(log).select(T.CLIP, "frame", "det_seq", *BOX, "confidence")))

# Votes: tracks of three clips share their numbers
_SPLIT = _VOTE.replace("CASE event_type WHEN 'click'", "'clip' || (event_id % 3) AS clip_id, CASE event_type WHEN 'click'").replace("PARTITION BY track_id", "PARTITION BY clip_id, track_id").replace("SELECT a.track_id", "SELECT a.clip_id, a.track_id").replace("ON a.track_id", "ON a.clip_id = b.clip_id AND a.track_id").replace("SELECT track_id, seq, label AS team", "SELECT clip_id, track_id, seq, label AS team")


def _of_clips(spark, sf_dir: str) -> DataFrame:
    return _sightings(spark, sf_dir).withColumn(T.CLIP, F.concat(F.lit("clip"), (F.col("seq") % 3).cast("string")))


QUERIES["clips_team_vote"], SQL["clips_team_vote"] = lambda s, d: D.team_votes(_of_clips(s, d)), _SPLIT
QUERIES["clips_track_majority"] = lambda s, d: D.track_majority(_of_clips(s, d))
SQL["clips_track_majority"] = """WITH s AS (SELECT 'clip' || (event_id % 3) AS clip_id, user_id AS track_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE -1 END AS label, event_id AS seq FROM events WHERE event_type IN ('click', 'view', 'purchase'))
SELECT clip_id, track_id, label FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, track_id ORDER BY n DESC, first) AS k FROM (SELECT clip_id, track_id, label, count(*) AS n, min(seq) AS first FROM s GROUP BY ALL)) WHERE k = 1"""
