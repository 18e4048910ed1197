"""Queries over a log without calibration, in several clips: the ball, possession, passes and the network in pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchflow.operators import tracks as T
from pitchflow.plans.catalog import _KALMAN, BASE, QUERIES, SQL, log_of
from pitchflow.sources.position_log import in_clips, uncalibrated
from pitchflow.streaming import state as K

CLIP_FRAMES = 100

_CLIPS = f""", c AS (SELECT 'clip' || (frame // {CLIP_FRAMES}) AS clip_id, frame % {CLIP_FRAMES} AS frame, log_seq, track_id, class_name, team, pixel_x AS x, pixel_y AS y, bbox_height FROM log),
cp AS (SELECT * FROM c WHERE class_name = 'person'),
cs AS (SELECT clip_id, frame, median(bbox_height) AS scale FROM cp GROUP BY ALL), cg AS (SELECT clip_id, median(scale) AS g FROM cs GROUP BY clip_id),
cb AS (SELECT b.*, CASE WHEN s.frame IS NULL OR s.scale = 0 THEN coalesce(g, 1.0) ELSE s.scale END AS scale, row_number() OVER (PARTITION BY b.clip_id ORDER BY b.frame) AS rn FROM c b LEFT JOIN cs s USING (clip_id, frame) LEFT JOIN cg USING (clip_id) WHERE class_name = 'sports ball'),
cf AS (SELECT clip_id, rn, frame, x, y, true AS ok, frame AS lf, x AS lx, y AS ly FROM cb WHERE rn = 1
       UNION ALL SELECT b.clip_id, b.rn, b.frame, b.x, b.y, q.ok, CASE WHEN q.ok THEN b.frame ELSE f.lf END, CASE WHEN q.ok THEN b.x ELSE f.lx END, CASE WHEN q.ok THEN b.y ELSE f.ly END FROM cf f JOIN cb b ON b.clip_id = f.clip_id AND b.rn = f.rn + 1,
       LATERAL (SELECT NOT sqrt((b.x - f.lx) * (b.x - f.lx) + (b.y - f.ly) * (b.y - f.ly)) > 5.0 * b.scale * greatest(b.frame - f.lf, 1) AS ok) q),
ck AS (SELECT clip_id, frame, x, y FROM cf WHERE ok),
cd AS (SELECT t.clip_id, t.frame, ck.x, ck.y, CASE WHEN ck.x IS NOT NULL THEN t.frame END AS here FROM (SELECT clip_id, unnest(generate_series(a, z)) AS frame FROM (SELECT clip_id, min(frame) AS a, max(frame) AS z FROM ck GROUP BY clip_id)) t LEFT JOIN ck USING (clip_id, frame)),
ca AS (SELECT *, last_value(here IGNORE NULLS) OVER a AS pf, last_value(x IGNORE NULLS) OVER a AS px, last_value(y IGNORE NULLS) OVER a AS py, first_value(here IGNORE NULLS) OVER z AS nf, first_value(x IGNORE NULLS) OVER z AS nx, first_value(y IGNORE NULLS) OVER z AS ny FROM cd
       WINDOW a AS (PARTITION BY clip_id ORDER BY frame ROWS UNBOUNDED PRECEDING), z AS (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
cball AS (SELECT clip_id, frame, CASE WHEN here IS NOT NULL THEN x ELSE px + (nx - px) * (frame - pf) / (nf - pf) END AS x, CASE WHEN here IS NOT NULL THEN y ELSE py + (ny - py) * (frame - pf) / (nf - pf) END AS y, here IS NULL AS was_interpolated FROM ca WHERE here IS NOT NULL OR frame - pf <= 10),
cn AS (SELECT p.*, sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)) AS dist FROM cp p JOIN cball b USING (clip_id, frame)),
cposs AS (SELECT clip_id, frame, track_id, team FROM (SELECT n.*, row_number() OVER (PARTITION BY clip_id, frame ORDER BY dist, log_seq) AS k FROM cn n JOIN cs USING (clip_id, frame) WHERE dist <= scale * 0.6::DOUBLE) WHERE k = 1),
cm AS (SELECT *, CASE WHEN track_id = lag(track_id) OVER (PARTITION BY clip_id ORDER BY frame) THEN 0 ELSE 1 END AS new FROM cposs), cr AS (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY frame) AS run FROM cm),
cruns AS (SELECT clip_id, min(track_id) AS track_id, first(team ORDER BY frame) FILTER (WHERE team IS NOT NULL) AS team, count(*) AS length, min(frame) AS start_frame, max(frame) AS end_frame FROM cr GROUP BY clip_id, run HAVING count(*) >= 3),
cmade AS (SELECT * FROM (SELECT *, lag(track_id) OVER w AS prev_track_id, lag(team) OVER w AS prev_team, lag(end_frame) OVER w AS prev_end_frame FROM cruns WINDOW w AS (PARTITION BY clip_id ORDER BY start_frame)) WHERE team = prev_team AND track_id <> prev_track_id)"""
_OBS = "obs AS (SELECT f.clip_id, f.frame, l.x AS ox, l.y AS oy FROM (SELECT clip_id, unnest(generate_series(0, z)) AS frame FROM (SELECT clip_id, max(frame) AS z FROM c GROUP BY clip_id)) f LEFT JOIN c l ON l.clip_id = f.clip_id AND l.frame = f.frame AND l.class_name = 'sports ball'),"
_CLIP_KALMAN = f", {_OBS}\n" + _KALMAN.split("\n", 1)[1].replace("k(frame, live", "k(clip_id, frame, live").replace("SELECT frame, ox", "SELECT clip_id, frame, ox").replace("SELECT o.frame,", "SELECT o.clip_id, o.frame,").replace("ON o.frame = k.frame + 1", "ON o.clip_id = k.clip_id AND o.frame = k.frame + 1")


def over_clips(name: str, sql: str, *columns: str):
    """Registers a query over the uncalibrated log in clips."""

    def add(f):
        def query(spark, sf_dir: str) -> DataFrame:
            out = f(uncalibrated(in_clips(log_of(spark, sf_dir), CLIP_FRAMES)))
            return out.select(*columns) if columns else out

        QUERIES[name], SQL[name] = query, BASE + _CLIPS + sql
        return f

    return add


def _runs(log: DataFrame) -> DataFrame:
    return T.possession_runs(T.possessors(log, space="pixel"))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in "xy"})


over_clips("px_space_select", " SELECT log_seq, x, y FROM c", "log_seq", "x", "y")(T.space_of)
over_clips("px_ball_jump_filter", " SELECT * FROM ck")(lambda log: T.jump_filter(T.ball_with_scale(log, "pixel")))
over_clips("px_clean_ball_track", " SELECT clip_id, frame, round(x, 6) AS x, round(y, 6) AS y, was_interpolated FROM cball")(lambda log: _rounded(T.clean_ball(log, "pixel")))
over_clips("px_possessor", " SELECT * FROM cposs")(lambda log: T.possessors(log, space="pixel"))
over_clips("px_possession_runs", " SELECT * FROM cruns")(_runs)
over_clips("px_pass_edges", " SELECT clip_id, least(track_id, prev_track_id) AS a, greatest(track_id, prev_track_id) AS b, count(*) AS weight FROM cmade GROUP BY ALL")(lambda log: T.pass_edges(_runs(log)))
over_clips(
    "px_pass_events",
    """ SELECT m.clip_id, m.start_frame AS event_frame, m.prev_track_id AS from_track, m.track_id AS to_track, m.team, a.x AS from_x, a.y AS from_y, b.x AS to_x, b.y AS to_y
FROM cmade m JOIN c a ON a.clip_id = m.clip_id AND a.track_id = m.prev_track_id AND a.frame = m.prev_end_frame JOIN c b ON b.clip_id = m.clip_id AND b.track_id = m.track_id AND b.frame = m.start_frame""",
)(lambda log: T.pass_events(log, _runs(log)))
over_clips(
    "px_passing_network",
    """ SELECT r.clip_id, r.track_id, first(r.team ORDER BY r.start_frame) AS team, count(*) AS touches, any_value(p.x) AS x, any_value(p.y) AS y FROM cruns r
LEFT JOIN (SELECT clip_id, track_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM cp GROUP BY ALL) p USING (clip_id, track_id) GROUP BY r.clip_id, r.track_id""",
)(lambda log: T.network_nodes(log, _runs(log), "pixel"))
over_clips("px_kalman_ball", _CLIP_KALMAN + " SELECT clip_id, frame, round(round(x, 6), 4) AS x, round(round(y, 6), 4) AS y, seen AS is_observed FROM k WHERE live")(lambda log: _rounded(K.kalman(K.observations(log), max_coast=10), 4))
