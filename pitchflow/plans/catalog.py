"""Every operator as a query over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchflow import schema as S
from pitchflow.functions import geometry as G
from pitchflow.operators import detections as D
from pitchflow.operators import formation as M
from pitchflow.operators import render as R
from pitchflow.operators import tactics as A
from pitchflow.operators import tracks as T
from pitchflow.sources import files, position_log
from pitchflow.sources.position_log import from_events
from pitchflow.streaming import state as K
from pitchflow.streaming.association import BOX, associate
from pitchflow.streaming.jobs import in_parts, setting
from pitchflow.streaming.votes import PROVIDER, team_vote_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BASE = """
WITH RECURSIVE ev AS (SELECT event_id AS log_seq, event_id // 24 AS frame, event_id % 24 AS slot, user_id, CAST(round(value * 100) AS BIGINT) AS v FROM events),
ev2 AS (SELECT *, v % 401 - 200 AS jx, (user_id * 37 + v) % 401 - 200 AS jy, CASE WHEN slot = 0 THEN 1 + ((frame // 5) * 7) % 22 ELSE slot END AS s FROM ev
        WHERE NOT (slot = 0 AND (frame % 40 BETWEEN 20 AND 33 OR frame % 13 = 5))),
ev3 AS (SELECT *, s % 11 AS k, CASE WHEN s % 11 = 1 THEN 500 WHEN s % 11 BETWEEN 2 AND 5 THEN 2000 WHEN s % 11 BETWEEN 6 AND 9 THEN 4500 ELSE 7000 END AS depth FROM ev2),
ev4 AS (SELECT *, CASE WHEN s >= 12 THEN 10500 - depth ELSE depth END AS bx, CASE WHEN k = 1 THEN 3400 WHEN k BETWEEN 2 AND 9 THEN 1000 + 1600 * ((k - 2) % 4) ELSE 2500 + 1800 * (k // 10) END AS by_ FROM ev3),
ev5 AS (SELECT *, CASE WHEN slot = 23 THEN 5250 + jx WHEN slot = 0 THEN bx + jx // 2 + CASE WHEN frame % 29 = 11 THEN 30000 ELSE 0 END ELSE bx + jx END AS xc,
               CASE WHEN slot = 23 THEN 3400 + jy WHEN slot = 0 THEN by_ + jy // 2 ELSE by_ + jy END AS yc FROM ev4),
log AS (SELECT log_seq, frame, CAST(CASE WHEN slot = 0 THEN -1 WHEN slot % 7 = 3 THEN slot + 100 * (frame // 100) ELSE slot END AS BIGINT) AS track_id,
               CASE WHEN slot = 0 THEN 'sports ball' WHEN slot = 23 THEN 'ref' ELSE 'person' END AS class_name,
               CAST(CASE WHEN slot BETWEEN 1 AND 11 THEN 0 WHEN slot BETWEEN 12 AND 22 THEN 1 END AS INTEGER) AS team,
               xc / 10.0::DOUBLE AS pixel_x, yc / 10.0::DOUBLE AS pixel_y, xc / 100.0::DOUBLE AS pitch_x, yc / 100.0::DOUBLE AS pitch_y,
               CAST(60 + v % 61 AS DOUBLE) AS bbox_height, false AS is_predicted FROM ev5),
players AS (SELECT * FROM log WHERE class_name = 'person' AND pitch_x IS NOT NULL),
teamed AS (SELECT * FROM log WHERE class_name <> 'sports ball' AND pitch_x IS NOT NULL AND team IS NOT NULL),
scale AS (SELECT frame, median(bbox_height) AS scale FROM players GROUP BY frame),
rawball AS (SELECT frame, pitch_x AS x, pitch_y AS y, row_number() OVER (ORDER BY frame) AS rn, (SELECT median(scale) FROM scale) AS g
            FROM log WHERE class_name = 'sports ball' AND pitch_x BETWEEN -10 AND 115 AND pitch_y BETWEEN -10 AND 78),
scaled AS (SELECT b.frame, x, y, rn, CASE WHEN s.frame IS NULL OR s.scale = 0 THEN g ELSE s.scale END AS scale FROM rawball b LEFT JOIN scale s USING (frame)),
fold AS (SELECT rn, frame, x, y, true AS ok, frame AS lf, x AS lx, y AS ly FROM scaled WHERE rn = 1
         UNION ALL SELECT b.rn, b.frame, b.x, b.y, q.ok, CASE WHEN q.ok THEN b.frame ELSE f.lf END, CASE WHEN q.ok THEN b.x ELSE f.lx END, CASE WHEN q.ok THEN b.y ELSE f.ly END
         FROM fold f JOIN scaled b ON b.rn = f.rn + 1,
         LATERAL (SELECT NOT sqrt((b.x - f.lx) * (b.x - f.lx) + (b.y - f.ly) * (b.y - f.ly)) > 5.0 * b.scale * greatest(b.frame - f.lf, 1) AS ok) q),
kept AS (SELECT frame, x, y FROM fold WHERE ok),
dense AS (SELECT t.frame, kept.x, kept.y, CASE WHEN kept.x IS NOT NULL THEN t.frame END AS here FROM (SELECT unnest(generate_series((SELECT min(frame) FROM kept), (SELECT max(frame) FROM kept))) AS frame) t LEFT JOIN kept USING (frame)),
around AS (SELECT *, last_value(here IGNORE NULLS) OVER a AS pf, last_value(x IGNORE NULLS) OVER a AS px, last_value(y IGNORE NULLS) OVER a AS py,
                  first_value(here IGNORE NULLS) OVER z AS nf, first_value(x IGNORE NULLS) OVER z AS nx, first_value(y IGNORE NULLS) OVER z AS ny FROM dense
           WINDOW a AS (ORDER BY frame ROWS UNBOUNDED PRECEDING), z AS (ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
ball AS (SELECT frame, CASE WHEN here IS NOT NULL THEN x ELSE px + (nx - px) * (frame - pf) / (nf - pf) END AS x, CASE WHEN here IS NOT NULL THEN y ELSE py + (ny - py) * (frame - pf) / (nf - pf) END AS y, here IS NULL AS was_interpolated
         FROM around WHERE here IS NOT NULL OR frame - pf <= 10),
near AS (SELECT p.*, b.x AS ball_x, b.y AS ball_y, sqrt((pitch_x - b.x) * (pitch_x - b.x) + (pitch_y - b.y) * (pitch_y - b.y)) AS dist FROM players p JOIN ball b USING (frame)),
possession AS (SELECT frame, track_id, team FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY dist, log_seq) AS rn FROM near WHERE dist <= 3.0) WHERE rn = 1),
marked AS (SELECT *, CASE WHEN track_id = lag(track_id) OVER (ORDER BY frame) THEN 0 ELSE 1 END AS new FROM possession),
numbered AS (SELECT *, sum(new) OVER (ORDER BY frame) AS run FROM marked),
runs AS (SELECT min(track_id) AS track_id, first(team ORDER BY frame) FILTER (WHERE team IS NOT NULL) AS team, count(*) AS length, min(frame) AS start_frame, max(frame) AS end_frame FROM numbered GROUP BY run HAVING count(*) >= 3),
pairs AS (SELECT *, lag(track_id) OVER w AS prev_track_id, lag(team) OVER w AS prev_team, lag(end_frame) OVER w AS prev_end_frame FROM runs WINDOW w AS (ORDER BY start_frame)),
made AS (SELECT * FROM pairs WHERE team = prev_team AND track_id <> prev_track_id),
passes AS (SELECT m.start_frame AS event_frame, m.prev_track_id AS from_track, m.track_id AS to_track, m.team, a.pixel_x AS from_x, a.pixel_y AS from_y, b.pixel_x AS to_x, b.pixel_y AS to_y
           FROM made m JOIN log a ON a.track_id = m.prev_track_id AND a.frame = m.prev_end_frame JOIN log b ON b.track_id = m.track_id AND b.frame = m.start_frame),
pool AS (SELECT team, track_id, median(pitch_x) AS x, median(pitch_y) AS y, count(*) AS n_frames FROM players WHERE team IS NOT NULL AND pitch_x BETWEEN -5 AND 110 AND pitch_y BETWEEN -5 AND 73 GROUP BY ALL HAVING count(*) >= 5),
strict AS (SELECT team, track_id, median(pitch_x) AS x, median(pitch_y) AS y, count(*) AS n_frames FROM players WHERE team IS NOT NULL AND pitch_x BETWEEN 0 AND 105 AND pitch_y BETWEEN 0 AND 68 GROUP BY ALL HAVING count(*) >= 5),
sides AS (SELECT DISTINCT team FROM players WHERE team IS NOT NULL),
means AS (SELECT team, avg(x) AS m FROM pool GROUP BY team),
direction AS (SELECT team, CASE WHEN f THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS direction, CASE WHEN f THEN 0.0::DOUBLE ELSE 105.0::DOUBLE END AS own_goal_x
              FROM (SELECT s.team, round(coalesce(a.m, 52.5), 9) <= round(coalesce(b.m, 52.5), 9) AS f FROM sides s LEFT JOIN means a ON a.team = s.team LEFT JOIN means b ON b.team = 1 - s.team)),
keeper AS (SELECT team, CASE WHEN d <= 20 THEN track_id END AS gk, d AS gk_distance FROM (SELECT team, track_id, d, row_number() OVER (PARTITION BY team ORDER BY d, track_id) AS rn
           FROM (SELECT team, track_id, CASE WHEN own_goal_x = 0 THEN x ELSE 105 - x END AS d FROM strict JOIN direction USING (team))) WHERE rn = 1),
persistent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY n_frames DESC, track_id) AS rank FROM pool JOIN keeper USING (team) WHERE gk IS NULL OR track_id <> gk) WHERE rank <= 10),
deep AS (SELECT p.*, CASE WHEN own_goal_x = 0 THEN x ELSE 105 - x END AS depth FROM persistent p JOIN direction USING (team)),
gaps AS (SELECT team, track_id, depth, t.threshold, CASE WHEN depth - lag(depth) OVER (PARTITION BY team, t.threshold ORDER BY depth, track_id) <= t.threshold THEN 0 ELSE 1 END AS new
         FROM deep, (SELECT unnest([4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 12.0])::DOUBLE AS threshold) t),
lines AS (SELECT *, CAST(sum(new) OVER (PARTITION BY team, threshold ORDER BY depth, track_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line FROM gaps),
sized AS (SELECT team, threshold, count(*) AS n_lines, sum(n) AS total, max(n) AS most, first(n ORDER BY line) AS back, string_agg(n, '-' ORDER BY line) AS label FROM (SELECT team, threshold, line, count(*) AS n FROM lines GROUP BY ALL) GROUP BY ALL),
nextd AS (SELECT *, lead(label) OVER (PARTITION BY team ORDER BY threshold) AS nxt FROM sized),
teamnear AS (SELECT frame, team, min(dist) AS dist FROM near WHERE team IS NOT NULL GROUP BY ALL),
phase AS (SELECT frame, first(team ORDER BY dist, team) AS team FROM teamnear GROUP BY frame HAVING count(*) = 2),
boxes AS (SELECT frame, log_seq AS det_seq, track_id, class_name, pixel_x - floor(bbox_height / 2) / 2 AS x1, pixel_y - bbox_height AS y1, pixel_x + floor(bbox_height / 2) / 2 AS x2, pixel_y AS y2, (log_seq * 37 % 100) / 100.0::DOUBLE AS confidence FROM log),
sightings AS (SELECT user_id AS track_id, event_id AS seq, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 END AS label FROM events WHERE event_type IN ('click', 'view', 'purchase'))
"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(_events(spark, sf_dir))


def _flat(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns) if columns else df.drop(T.CLIP)


def over_log(name: str, sql: str | None, *columns: str):
    """Registers a query over the derived position log."""

    def add(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: _flat(f(log_of(spark, sf_dir)), *columns)
        if sql:
            SQL[name] = BASE + sql
        return f

    return add


LOG = ("log_seq", "frame", "track_id", "class_name", "team", "pitch_x", "pitch_y")
_LOG = ", ".join(LOG)
ball = T.clean_ball
runs = lambda log: T.possession_runs(T.possessors(log))

# Scans, filters and projections
over_log("src_position_log", "SELECT * FROM log")(lambda log: log)
over_log("src_frame_random", f"SELECT {_LOG} FROM log WHERE frame = greatest(0, least(100000, (SELECT max(frame) FROM log)))", *LOG)(lambda log: log.join(log.groupBy(T.CLIP).agg(F.greatest(F.lit(0), F.least(F.lit(100_000), F.max("frame"))).alias("frame")), [T.CLIP, "frame"]))
over_log("flt_players", f"SELECT {_LOG} FROM players", *LOG)(T.players)
over_log("flt_team_positions", f"SELECT {_LOG} FROM teamed", *LOG)(T.team_positions)
over_log("flt_heatmap", f"SELECT {_LOG} FROM teamed WHERE team = 1 AND track_id = 13", *LOG)(lambda log: T.team_positions(log).filter("team = 1 AND track_id = 13"))
over_log("flt_bounds_ball", "SELECT frame, pitch_x, pitch_y FROM log WHERE class_name = 'sports ball' AND pitch_x BETWEEN -10 AND 115 AND pitch_y BETWEEN -10 AND 78", "frame", "pitch_x", "pitch_y")(lambda log: log.filter((F.col("class_name") == S.BALL) & T.within(S.BALL_MARGIN)))
over_log("flt_bounds_candidates", f"SELECT {_LOG} FROM players WHERE pitch_x BETWEEN -5 AND 110 AND pitch_y BETWEEN -5 AND 73", *LOG)(lambda log: T.players(log).filter(T.within(S.TRACK_MARGIN)))
over_log("flt_bounds_gk", f"SELECT {_LOG} FROM players WHERE pitch_x BETWEEN 0 AND 105 AND pitch_y BETWEEN 0 AND 68", *LOG)(lambda log: T.players(log).filter(T.within(0.0)))
over_log("flt_has_calibration", "SELECT bool_or(pitch_x IS NOT NULL) AS calibrated FROM log")(T.is_calibrated)
over_log("prj_space_select", "SELECT log_seq, pitch_x AS x, pitch_y AS y FROM log", "log_seq", "x", "y")(T.space_of)
over_log("prj_foot_point", "SELECT det_seq, (x1 + x2) / 2 AS foot_x, y2 AS foot_y FROM boxes", "det_seq", "foot_x", "foot_y")(lambda log: D.foot_points(D.boxes(log)))
over_log("prj_bbox_height", "SELECT det_seq, y2 - y1 AS height FROM boxes", "det_seq", "height")(lambda log: D.foot_points(D.boxes(log)))
H = np.array([[0.1, 0.002, -1.0], [0.001, 0.11, -2.0], [0.00001, 0.0002, 1.0]])
over_log("prj_homography", "SELECT log_seq, round((0.1::DOUBLE * pixel_x + 0.002::DOUBLE * pixel_y + -1.0::DOUBLE) / (0.00001::DOUBLE * pixel_x + 0.0002::DOUBLE * pixel_y + 1.0::DOUBLE), 6) AS u, round((0.001::DOUBLE * pixel_x + 0.11::DOUBLE * pixel_y + -2.0::DOUBLE) / (0.00001::DOUBLE * pixel_x + 0.0002::DOUBLE * pixel_y + 1.0::DOUBLE), 6) AS v FROM log")(
    lambda log: log.select("log_seq", *(F.round(c, 6).alias(n) for c, n in zip(G.project(H, F.col("pixel_x"), F.col("pixel_y")), "uv", strict=True)))
)
over_log("prj_m2px", "SELECT log_seq, CAST(trunc((pitch_x + 4) * 10) AS INTEGER) AS px, CAST(trunc((pitch_y + 4) * 10) AS INTEGER) AS py FROM log")(lambda log: log.select("log_seq", G.metres_to_canvas(F.col("pitch_x")).alias("px"), G.metres_to_canvas(F.col("pitch_y")).alias("py")))
over_log("prj_torso_box", """, b AS (SELECT det_seq, CAST(trunc(x1) AS INTEGER) AS a1, CAST(trunc(y1) AS INTEGER) AS b1, CAST(trunc(x2) AS INTEGER) AS a2, CAST(trunc(y2) AS INTEGER) AS b2 FROM boxes),
c AS (SELECT *, CAST(trunc(b1 + (b2 - b1) * 0.15::DOUBLE) AS INTEGER) AS t, CAST(trunc(b1 + (b2 - b1) * 0.55::DOUBLE) AS INTEGER) AS l FROM b)
SELECT det_seq, a1 AS tx1, CASE WHEN l <= t OR a2 <= a1 THEN b1 ELSE t END AS ty1, a2 AS tx2, CASE WHEN l <= t OR a2 <= a1 THEN b2 ELSE l END AS ty2 FROM c""")(lambda log: D.boxes(log).select("det_seq", *G.torso_box("x1", "y1", "x2", "y2")))
over_log("prj_class_remap", "SELECT det_seq, CASE class_name WHEN 'ref' THEN 'referee' WHEN 'person' THEN 'player' ELSE class_name END AS class_name FROM boxes", "det_seq", "class_name")(lambda log: D.remap_classes(D.boxes(log), {"ref": "referee", "person": "player"}))

# Ball, possession and passes
over_log("agg_player_scale", "SELECT * FROM scale")(T.player_scale)
over_log("agg_player_scale_all", "SELECT frame, median(bbox_height) AS scale FROM log WHERE class_name = 'person' GROUP BY frame")(lambda log: log.filter("class_name = 'person'").groupBy(T.CLIP, "frame").agg(F.median("bbox_height").alias("scale")))
over_log("agg_global_scale", "SELECT median(scale) AS global_scale FROM scale")(lambda log: T.global_scale(T.player_scale(log)))
over_log("jn_scale_lookup", "SELECT frame, x, y, scale FROM scaled")(T.ball_with_scale)
over_log("win_ball_jump_filter", "SELECT * FROM kept")(lambda log: T.jump_filter(T.ball_with_scale(log)))
_BALL = "SELECT frame, round(x, 6) AS x, round(y, 6) AS y, was_interpolated FROM ball"
_round = lambda df: df.withColumns({c: F.round(c, 6) for c in "xy"})
over_log("win_ball_interpolate", _BALL)(lambda log: _round(T.interpolate(T.raw_ball(log))))
over_log("win_clean_ball_track", _BALL)(lambda log: _round(ball(log)))
over_log("jn_player_ball", "SELECT log_seq, frame, round(dist, 6) AS dist FROM near", "log_seq", "frame", "dist")(lambda log: T.player_ball(log, ball(log)).withColumn("dist", F.round("dist", 6)))
over_log("jn_radius_lookup", "SELECT p.log_seq, coalesce(s.scale, (SELECT median(scale) FROM scale)) * 0.6::DOUBLE AS radius FROM players p LEFT JOIN scale s USING (frame)", "log_seq", "radius")(
    lambda log: T.players(log).join(T.player_scale(log), [T.CLIP, "frame"], "left").join(T.global_scale(T.player_scale(log)), T.CLIP, "left").withColumn("radius", F.coalesce("scale", "global_scale") * S.RADIUS_SCALE)
)
over_log("win_possessor", "SELECT * FROM possession")(T.possessors)
over_log("win_possession_runs", "SELECT * FROM runs")(runs)
over_log("jn_consecutive", "SELECT track_id, prev_track_id, team, prev_team, start_frame, prev_end_frame FROM pairs WHERE prev_track_id IS NOT NULL", "track_id", "prev_track_id", "team", "prev_team", "start_frame", "prev_end_frame")(lambda log: T.run_pairs(runs(log)))
over_log("win_pass_events", "SELECT * FROM passes")(lambda log: T.pass_events(log, runs(log)))
over_log("jn_pass_positions", "SELECT event_frame, from_x, from_y, to_x, to_y FROM passes", "event_frame", "from_x", "from_y", "to_x", "to_y")(lambda log: T.pass_events(log, runs(log)))
over_log("agg_pass_edges", "SELECT least(track_id, prev_track_id) AS a, greatest(track_id, prev_track_id) AS b, count(*) AS weight FROM made GROUP BY ALL")(lambda log: T.pass_edges(runs(log)))
over_log("agg_touches", "SELECT track_id, count(*) AS touches FROM runs GROUP BY ALL")(lambda log: T.touches(runs(log)))
over_log("agg_node_position", "SELECT track_id, round(avg(pitch_x), 6) AS x, round(avg(pitch_y), 6) AS y FROM players GROUP BY ALL")(T.node_positions)
_NODES = ", pos AS (SELECT track_id, round(avg(pitch_x), 6) AS x, round(avg(pitch_y), 6) AS y FROM players GROUP BY ALL) SELECT r.track_id, first(r.team ORDER BY r.start_frame) AS team, count(*) AS touches, any_value(p.x) AS x, any_value(p.y) AS y FROM runs r LEFT JOIN pos p USING (track_id) GROUP BY r.track_id"
over_log("win_passing_network", _NODES)(lambda log: T.network_nodes(log, runs(log)))
over_log("jn_avg_pos", "SELECT r.start_frame, r.track_id, p.x, p.y FROM runs r JOIN (SELECT track_id, round(avg(pitch_x), 6) AS x, round(avg(pitch_y), 6) AS y FROM players GROUP BY ALL) p USING (track_id)", "start_frame", "track_id", "x", "y")(lambda log: runs(log).join(T.node_positions(log), [T.CLIP, "track_id"], "left"))
over_log("win_running_pass_count", "SELECT event_frame, CAST(sum(count(*)) OVER (ORDER BY event_frame) AS BIGINT) AS passes FROM passes GROUP BY event_frame")(lambda log: R.running_passes(T.pass_events(log, runs(log))))

# Team shape
over_log("agg_team_centroid", "SELECT frame, team, round(avg(pitch_x), 6) AS x, round(avg(pitch_y), 6) AS y FROM teamed GROUP BY ALL")(A.centroid)
over_log("agg_team_width_depth", "SELECT frame, team, max(pitch_y) - min(pitch_y) AS width, max(pitch_x) - min(pitch_x) AS depth FROM teamed GROUP BY ALL")(A.width_depth)
_HULL = """, pts AS (SELECT DISTINCT frame, team, pitch_x AS x, pitch_y AS y FROM teamed),
edges AS (SELECT p.frame, p.team, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM pts p JOIN pts q ON p.frame = q.frame AND p.team = q.team AND (p.x <> q.x OR p.y <> q.y)
          WHERE NOT EXISTS (SELECT 1 FROM pts r WHERE r.frame = p.frame AND r.team = p.team AND ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < -1e-9
                OR (abs((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)) <= 1e-9 AND (r.x - p.x) * (q.x - p.x) + (r.y - p.y) * (q.y - p.y) > (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + 1e-9)
                OR (abs((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)) <= 1e-9 AND (r.x - p.x) * (q.x - p.x) + (r.y - p.y) * (q.y - p.y) < -1e-9)))),
area AS (SELECT frame, team, round(sum(px * qy - qx * py) / 2, 6) AS area FROM edges GROUP BY ALL)"""
over_log("agg_team_compactness", _HULL + " SELECT * FROM area")(A.compactness)
over_log("udf_hull", _HULL + " SELECT team, round(max(area), 6) AS widest FROM area GROUP BY team")(lambda log: A.compactness(log).groupBy(T.CLIP, "team").agg(F.max("area").alias("widest")))
_PAIR = ", tp AS (SELECT a.frame, a.team, a.log_seq AS log_seqa, b.log_seq AS log_seqb, sqrt((a.pitch_x - b.pitch_x) * (a.pitch_x - b.pitch_x) + (a.pitch_y - b.pitch_y) * (a.pitch_y - b.pitch_y)) AS dist FROM teamed a JOIN teamed b ON a.frame = b.frame AND a.team = b.team AND a.log_seq < b.log_seq)"
over_log("jn_teammate_pairs", _PAIR + " SELECT log_seqa, log_seqb, round(dist, 6) AS dist FROM tp", "log_seqa", "log_seqb", "dist")(lambda log: A.teammate_pairs(log).withColumn("dist", F.round("dist", 6)))
over_log("agg_teammate_distance", _PAIR + " SELECT frame, team, round(avg(dist), 6) AS mean_distance FROM tp GROUP BY ALL")(A.teammate_distance)
over_log("agg_tactical_summary", _HULL + _PAIR + """ SELECT team, round(avg(area), 4) AS area, any_value(width) AS width, any_value(depth) AS depth, any_value(mean_distance) AS mean_distance FROM area
JOIN (SELECT team, round(avg(w), 4) AS width, round(avg(d), 4) AS depth FROM (SELECT frame, team, max(pitch_y) - min(pitch_y) AS w, max(pitch_x) - min(pitch_x) AS d FROM teamed GROUP BY ALL) GROUP BY team) USING (team)
JOIN (SELECT team, round(avg(m), 4) AS mean_distance FROM (SELECT frame, team, round(avg(dist), 6) AS m FROM tp GROUP BY ALL) GROUP BY team) USING (team) GROUP BY team""")(A.summary)
over_log("agg_heatmap", "SELECT team, CAST(least(floor(pitch_x * 21 / 105.0::DOUBLE), 20) AS BIGINT) AS bx, CAST(least(floor(pitch_y * 17 / 68.0::DOUBLE), 16) AS BIGINT) AS by, count(*) AS n FROM teamed WHERE pitch_x BETWEEN 0 AND 105 AND pitch_y BETWEEN 0 AND 68 GROUP BY ALL")(A.heatmap_bins)
over_log("agg_team_counts", "SELECT team, count(*) AS n FROM log WHERE class_name = 'person' AND team IS NOT NULL GROUP BY team")(A.team_counts)
over_log("agg_ball_coverage", "SELECT count(*) FILTER (WHERE class_name = 'sports ball' AND NOT is_predicted) AS real, count(*) FILTER (WHERE class_name = 'sports ball') AS balls, max(frame) + 1 AS frames FROM log")(A.ball_coverage)
over_log("srt_teams", "SELECT DISTINCT team FROM log WHERE team IS NOT NULL")(lambda log: log.filter("team IS NOT NULL").select("team").distinct().orderBy("team"))
over_log("set_label_membership", "SELECT bool_or(team = 0) AND bool_or(team = 1) AS both_labels FROM log")(lambda log: log.groupBy(T.CLIP).agg((F.array_contains(F.collect_set("team"), 0) & F.array_contains(F.collect_set("team"), 1)).alias("both_labels")))

# Formations
over_log("agg_candidate_pool", "SELECT * FROM pool")(M.candidate_pool)
over_log("frm_direction", "SELECT * FROM direction")(M.directions)
over_log("jn_team_pair", "SELECT s.team, round(a.m, 6) AS own, round(b.m, 6) AS other FROM sides s LEFT JOIN means a ON a.team = s.team LEFT JOIN means b ON b.team = 1 - s.team")(
    lambda log: (lambda m: m.join(m.select(T.CLIP, (1 - F.col("team")).alias("team"), F.col("own").alias("other")), [T.CLIP, "team"], "left"))(M.candidate_pool(log).groupBy(T.CLIP, "team").agg(F.round(F.avg("x"), 6).alias("own")))
)
over_log("frm_goalkeeper", "SELECT * FROM keeper")(M.goalkeepers)
over_log("top_gk", "SELECT team, gk FROM keeper", "team", "gk")(M.goalkeepers)
_outfield = lambda log: M.candidate_pool(log).join(M.goalkeepers(log), [T.CLIP, "team"]).filter("gk IS NULL OR track_id <> gk")
_included = lambda log: M.with_depth(M.most_persistent(_outfield(log)), M.directions(log))
over_log("jn_goalkeeper_anti", "SELECT team, track_id FROM pool JOIN keeper USING (team) WHERE gk IS NULL OR track_id <> gk", "team", "track_id")(_outfield)
over_log("top_k_persistent", "SELECT team, track_id, n_frames, CAST(rank AS INTEGER) AS rank FROM persistent", "team", "track_id", "n_frames", "rank")(lambda log: M.most_persistent(_outfield(log)))
over_log("top_boundary", ", r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY n_frames DESC, track_id) AS k FROM pool JOIN keeper USING (team) WHERE gk IS NULL OR track_id <> gk) SELECT team, max(n_frames) FILTER (WHERE k = 10) AS last_in, max(n_frames) FILTER (WHERE k = 11) AS first_out FROM r WHERE k <= 11 GROUP BY team")(
    lambda log: M.most_persistent(_outfield(log), 11).groupBy(T.CLIP, "team").agg(F.max(F.when(F.col("rank") == 10, F.col("n_frames"))).alias("last_in"), F.max(F.when(F.col("rank") == 11, F.col("n_frames"))).alias("first_out"))
)
over_log("win_gap_cluster", "SELECT team, track_id, threshold, line FROM lines", "team", "track_id", "threshold", "line")(lambda log: M.gap_lines(_included(log), S.LINE_GAPS))
over_log("frm_plausible", "SELECT team, threshold, label, n_lines BETWEEN 2 AND 5 AND most <= 6 AND most / total <= 0.7 AND back BETWEEN 3 AND 5 AS plausible FROM sized", "team", "threshold", "label", "plausible")(lambda log: M.line_sizes(M.gap_lines(_included(log), S.LINE_GAPS)))
over_log("frm_threshold_search", "SELECT team, threshold, label, CASE WHEN coalesce(nxt, label) = label THEN 'high' ELSE 'medium' END AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY threshold) AS k FROM nextd WHERE n_lines BETWEEN 2 AND 5 AND most <= 6 AND most / total <= 0.7 AND back BETWEEN 3 AND 5) WHERE k = 1")(lambda log: M.threshold_search(_included(log)))
_SHAPES = "[" + ", ".join("{'ord': %d, 'shape': '%s', 'n': %d, 'ends': %s}" % (i, s, sum(z), [sum(z[: k + 1]) for k in range(len(z))]) for i, s in enumerate(S.SHAPES) for z in [list(map(int, s.split("-")))]) + "]"
over_log("frm_best_fit", f""", ranked AS (SELECT team, depth, row_number() OVER (PARTITION BY team ORDER BY depth, track_id) AS at, count(*) OVER (PARTITION BY team) AS n FROM deep),
tried AS (SELECT r.team, s.ord, s.shape, depth, len(list_filter(s.ends, lambda e: e < r.at)) AS line FROM ranked r, (SELECT unnest({_SHAPES}) AS s) q WHERE r.n = s.n),
parts AS (SELECT team, ord, shape, line, sum(depth * depth) - count(*) * avg(depth) * avg(depth) AS sse FROM tried GROUP BY ALL), total AS (SELECT team, ord, shape, round(sum(sse), 6) AS sse FROM parts GROUP BY ALL)
SELECT team, shape, sse FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY sse, ord) AS k FROM total) WHERE k = 1""")(lambda log: M.best_fit(_included(log)))
over_log("agg_min_ball_distance", "SELECT frame, team, round(dist, 6) AS dist FROM teamnear")(lambda log: M.team_ball_distance(log, ball(log)).withColumn("dist", F.round("dist", 6)))
over_log("jn_ball_frame_semi", "SELECT frame, team, count(*) AS n FROM players WHERE team IS NOT NULL AND frame IN (SELECT frame FROM ball) GROUP BY ALL")(lambda log: T.players(log).filter("team IS NOT NULL").join(ball(log), [T.CLIP, "frame"], "left_semi").groupBy(T.CLIP, "frame", "team").agg(F.count("*").alias("n")))
over_log("win_phase_possession", "SELECT * FROM phase")(lambda log: M.phase_possession(log, ball(log)))
_PHASE = ", own AS (SELECT s.team, p.frame FROM sides s JOIN phase p ON p.team <> s.team), cnt AS (SELECT s.team, (SELECT count(*) FROM own o WHERE o.team = s.team) AS frames, (SELECT count(*) FROM log l JOIN own o ON o.frame = l.frame AND o.team = l.team WHERE l.team = s.team AND l.class_name = 'person') AS rows FROM sides s)"
over_log("frm_defensive_phase", _PHASE + " SELECT team, frames, rows, frames >= 50 AND rows >= 50 AS by_phase, CASE WHEN NOT (frames >= 50 AND rows >= 50) THEN 'few_defensive_frames' END AS caveat FROM cnt")(lambda log: M.defensive_phase(log, ball(log))[1])
over_log("jn_defensive_semi", _PHASE + " SELECT l.log_seq, l.team FROM log l JOIN cnt c ON c.team = l.team WHERE l.class_name = 'person' AND (NOT (frames >= 50 AND rows >= 50) OR EXISTS (SELECT 1 FROM own o WHERE o.team = l.team AND o.frame = l.frame))", "log_seq", "team")(lambda log: M.defensive_phase(log, ball(log))[0])

# Detections, clicks and labels
_SINGLE = ("sports ball", "ref")
over_log("top_singleton", "SELECT det_seq FROM (SELECT *, row_number() OVER (PARTITION BY frame, class_name ORDER BY confidence DESC, det_seq) AS k FROM boxes) WHERE k = 1 OR class_name NOT IN ('sports ball', 'ref')", "det_seq")(lambda log: D.best_of_singletons(D.boxes(log), _SINGLE))
over_log("top_ball_fallback", "SELECT frame, det_seq FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY confidence DESC, det_seq) AS k FROM boxes WHERE class_name = 'person') WHERE k = 1", "frame", "det_seq")(lambda log: D.best_of_singletons(D.boxes(log), ("person",)).filter("class_name = 'person'"))
over_log("top_first_ball", "SELECT frame, min(det_seq) AS det_seq FROM boxes WHERE class_name = 'sports ball' GROUP BY frame")(lambda log: D.boxes(log).filter("class_name = 'sports ball'").groupBy(*D.FRAME).agg(F.min("det_seq").alias("det_seq")))
over_log("set_union_detections", "SELECT det_seq, pass FROM (SELECT det_seq, 0 AS pass FROM boxes WHERE class_name = 'sports ball' UNION ALL SELECT det_seq, 1 FROM boxes WHERE class_name = 'person')")(lambda log: (lambda b: b.filter("class_name = 'sports ball'").select("det_seq", F.lit(0).alias("pass")).unionByName(b.filter("class_name = 'person'").select("det_seq", F.lit(1).alias("pass"))))(D.boxes(log)))
# A click on the ball of each frame, and one on the shirt of every third row: several a frame
_clicks = lambda log: log.filter("class_name = 'sports ball' OR log_seq % 3 = 0").select(T.CLIP, "frame", F.col("log_seq").alias("click_id"), F.col("pixel_x").alias("cx"), (F.col("pixel_y") - F.when(F.col("class_name") != "sports ball", F.col("bbox_height") / 2).otherwise(0)).alias("cy"))
over_log("jn_click_box", """, c AS (SELECT frame, log_seq AS click_id, pixel_x AS cx, pixel_y - CASE WHEN class_name <> 'sports ball' THEN bbox_height / 2 ELSE 0 END AS cy FROM log WHERE class_name = 'sports ball' OR log_seq % 3 = 0),
q AS (SELECT c.frame, click_id, b.det_seq, NOT (cx BETWEEN x1 AND x2 AND cy BETWEEN y1 AND y2) AS far, sqrt((cx - (x1 + x2) / 2) * (cx - (x1 + x2) / 2) + (cy - (y1 + y2) / 2) * (cy - (y1 + y2) / 2)) AS d, (x2 - x1) * (y2 - y1) AS area FROM c JOIN boxes b ON b.frame = c.frame AND b.class_name = 'person')
SELECT frame, click_id, det_seq, far AS by_centre FROM (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY far, CASE WHEN far THEN d ELSE area END, det_seq) AS k FROM q WHERE NOT far OR d <= 80) WHERE k = 1""")(lambda log: D.click_boxes(_clicks(log), D.boxes(log).filter("class_name = 'person'")))

# Drawing
over_log("rnd_topdown", """SELECT frame, 'ball' AS kind, CAST(-1 AS BIGINT) AS track_id, CAST(trunc((x + 4) * 10) AS INTEGER) AS px, CAST(trunc((y + 4) * 10) AS INTEGER) AS py, 'ball' AS color, NOT was_interpolated AS filled FROM ball
UNION ALL SELECT frame, 'player', track_id, CAST(trunc((pitch_x + 4) * 10) AS INTEGER), CAST(trunc((pitch_y + 4) * 10) AS INTEGER), 'team_' || team, true FROM players""")(lambda log: R.topdown(log, ball(log)))
over_log("jn_topdown", "SELECT s.frame, b.frame IS NOT NULL AS has_ball, coalesce(n, 0) AS players FROM (SELECT unnest(generate_series(0, (SELECT max(frame) FROM log))) AS frame) s LEFT JOIN ball b ON b.frame = s.frame LEFT JOIN (SELECT frame, count(*) AS n FROM players GROUP BY frame) p ON p.frame = s.frame", "frame", "has_ball", "players")(
    lambda log: log.groupBy(T.CLIP).agg(F.max("frame").alias("z")).select(T.CLIP, F.explode(F.sequence(F.lit(0).cast("bigint"), "z")).alias("frame")).join(ball(log).select(T.CLIP, "frame", F.lit(True).alias("b")), [T.CLIP, "frame"], "left").join(T.players(log).groupBy(T.CLIP, "frame").agg(F.count("*").alias("n")), [T.CLIP, "frame"], "left").select("frame", F.coalesce("b", F.lit(False)).alias("has_ball"), F.coalesce("n", F.lit(0)).alias("players"))
)
over_log("jn_overlay", "SELECT p.frame, p.track_id, p.team, l.pixel_x, l.pixel_y FROM possession p LEFT JOIN log l ON l.track_id = p.track_id AND l.frame = p.frame")(lambda log: R.overlay(log, T.possessors(log)))
over_log("rnd_annotate", "SELECT log_seq, frame, CASE WHEN class_name = 'sports ball' THEN 'ball' ELSE '#' || track_id || coalesce(' T' || team, '') END AS label, coalesce('team_' || team, 'none') AS color FROM log")(R.annotations)

# State over frames
_KALMAN = """, obs AS (SELECT f.frame, l.pixel_x AS ox, l.pixel_y AS oy FROM (SELECT unnest(generate_series(0, (SELECT max(frame) FROM log))) AS frame) f LEFT JOIN log l ON l.frame = f.frame AND l.class_name = 'sports ball'),
k(frame, live, x, y, vx, vy, a, b, c, missed, seen) AS (
SELECT frame, ox IS NOT NULL, ox, oy, 0.0::DOUBLE, 0.0::DOUBLE, 10.0::DOUBLE, 0.0::DOUBLE, 10.0::DOUBLE, 0, ox IS NOT NULL FROM obs WHERE frame = 0
UNION ALL SELECT o.frame, CASE WHEN o.ox IS NOT NULL THEN true ELSE k.live AND k.missed + 1 <= 10 END,
 CASE WHEN NOT k.live THEN o.ox WHEN o.ox IS NULL THEN k.x + k.vx ELSE k.x + k.vx + p.a / (p.a + 10) * (o.ox - k.x - k.vx) END,
 CASE WHEN NOT k.live THEN o.oy WHEN o.ox IS NULL THEN k.y + k.vy ELSE k.y + k.vy + p.a / (p.a + 10) * (o.oy - k.y - k.vy) END,
 CASE WHEN NOT k.live THEN 0 WHEN o.ox IS NULL THEN k.vx ELSE k.vx + p.b / (p.a + 10) * (o.ox - k.x - k.vx) END,
 CASE WHEN NOT k.live THEN 0 WHEN o.ox IS NULL THEN k.vy ELSE k.vy + p.b / (p.a + 10) * (o.oy - k.y - k.vy) END,
 CASE WHEN NOT k.live THEN 10 WHEN o.ox IS NULL THEN p.a ELSE (1 - p.a / (p.a + 10)) * p.a END,
 CASE WHEN NOT k.live THEN 0 WHEN o.ox IS NULL THEN p.b ELSE (1 - p.a / (p.a + 10)) * p.b END,
 CASE WHEN NOT k.live THEN 10 WHEN o.ox IS NULL THEN p.c ELSE p.c - p.b / (p.a + 10) * p.b END,
 CASE WHEN o.ox IS NOT NULL THEN 0 ELSE k.missed + 1 END, o.ox IS NOT NULL
FROM k JOIN obs o ON o.frame = k.frame + 1, LATERAL (SELECT k.a + 2 * k.b + k.c + 5 AS a, k.b + k.c AS b, k.c + 5 AS c) p)"""
over_log("st_kalman_ball", _KALMAN + " SELECT frame, round(round(x, 6), 4) AS x, round(round(y, 6), 4) AS y, seen AS is_observed FROM k WHERE live")(lambda log: K.kalman(K.observations(log), max_coast=10).withColumns({c: F.round(c, 4) for c in "xy"}))
#: Ten pixels a metre, as in the derived log.
LOG_H = np.diag([0.1, 0.1, 1.0])


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1)
    return _events(spark, sf_dir).filter(F.col("event_type").isin("click", "view", "purchase")).select(F.lit("clip").alias(T.CLIP), F.col("user_id").alias("track_id"), F.col("event_id").alias("seq"), label.alias("label"))


def plain(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


_VOTE = BASE + """, o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seq) AS rn FROM sightings),
t AS (SELECT a.track_id, a.seq, a.rn, b.label, count(*) AS n, min(b.rn) AS first FROM o a JOIN o b ON a.track_id = b.track_id AND b.rn <= least(a.rn, 5) GROUP BY ALL)
SELECT track_id, seq, label AS team, rn >= 5 AS locked FROM (SELECT *, row_number() OVER (PARTITION BY track_id, seq ORDER BY n DESC, first) AS k FROM t) WHERE k = 1"""
plain("win_team_vote", lambda s, d: D.team_votes(_sightings(s, d)).drop(T.CLIP), _VOTE)


def _vote_parts(s: SparkSession, d: str, parts: int = 5) -> DataFrame:
    """The votes of a stream that gets the sightings in ``parts``, in order, and is started anew for each."""
    seen = _sightings(s, d)
    last = seen.agg(F.max("seq")).first()[0] or 0
    part = F.floor(F.col("seq") * parts / (last + 1))
    with setting(s, *PROVIDER):
        return in_parts([seen.filter(part == k) for k in range(parts)], team_vote_stream, "team-votes")


plain("st_team_vote", lambda s, d: _vote_parts(s, d).drop(T.CLIP), _VOTE)
plain("agg_track_majority", lambda s, d: D.track_majority(_sightings(s, d)).drop(T.CLIP), BASE + " SELECT track_id, label FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY n DESC, first) AS k FROM (SELECT track_id, coalesce(label, -1) AS label, count(*) AS n, min(seq) AS first FROM sightings GROUP BY ALL)) WHERE k = 1")
_KEYPOINTS = "VALUES " + ", ".join(f"({i}, '{n}', {x!r}D, {y!r}D)" for i, n, x, y in S.keypoints())
keypoint_table = lambda s: s.sql(f"SELECT * FROM ({_KEYPOINTS}) AS k(id, name, x, y)")
_KP_SQL = "SELECT * FROM (" + _KEYPOINTS.replace("D,", "::DOUBLE,").replace("D)", "::DOUBLE)") + ") AS k(id, name, x, y)"
plain("jn_keypoint", lambda s, d: _events(s, d).select("event_id", (F.col("user_id") % 29).cast("int").alias("id")).join(F.broadcast(keypoint_table(s)), "id").select("event_id", "x", "y"), f"SELECT event_id, x, y FROM events JOIN ({_KP_SQL}) k ON k.id = user_id % 29")


def _nearest(s: SparkSession, d: str) -> DataFrame:
    v = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.transform("embedding", lambda x: F.round(x.cast("double") * 1e6).cast("bigint")).alias("vec"))
    anchors = v.groupBy("label").agg(F.min_by("vec", "vec_id").alias("anchor")).select(F.col("label").alias("anchor_label"), "anchor")
    return D.nearest_anchor(v.select("vec_id", "vec"), anchors)


_NEAREST = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 1e6) AS BIGINT)) AS vec FROM embeddings), a AS (SELECT label, arg_min(vec, vec_id) AS anchor FROM v GROUP BY label),
q AS (SELECT vec_id, a.label, CAST(list_sum(list_transform(list_zip(vec, anchor), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d2 FROM v, a) SELECT vec_id, label, d2 FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, label) AS k FROM q) WHERE k = 1"""
plain("jn_nearest_anchor", _nearest, _NEAREST)
plain("udf_classify", lambda s, d: _nearest(s, d).groupBy("label").agg(F.count("*").alias("n")), f"SELECT label, count(*) AS n FROM ({_NEAREST}) GROUP BY label")

_LINES = "SELECT user_id % 20 AS job, event_id AS seq, CASE event_type WHEN 'click' THEN 'frame ' || event_id || ': ok' WHEN 'signup' THEN 'Team ' || (user_id % 2) || ': 4-4-2 (confidence=high)' WHEN 'view' THEN 'caveat: gap ' || event_id ELSE 'other' END AS line FROM events"


def _job_lines(s: SparkSession, d: str) -> DataFrame:
    e, text = _events(s, d), lambda c: F.col(c).cast("string")
    line = F.when(F.col("event_type") == "click", F.concat(F.lit("frame "), text("event_id"), F.lit(": ok"))).when(F.col("event_type") == "signup", F.concat(F.lit("Team "), (F.col("user_id") % 2).cast("string"), F.lit(": 4-4-2 (confidence=high)"))).when(F.col("event_type") == "view", F.concat(F.lit("caveat: gap "), text("event_id"))).otherwise("other")
    return e.select((F.col("user_id") % 20).alias("job"), F.col("event_id").alias("seq"), line.alias("line"))


plain("fn_parse_job_output", lambda s, d: D.parse_job_output(_job_lines(s, d)), f"""WITH l AS ({_LINES}), p AS (SELECT job, seq, CAST(nullif(regexp_extract(line, 'frame (\\d+):', 1), '') AS BIGINT) AS frame, CAST(nullif(regexp_extract(line, 'Team (\\d+): (.+?) \\(confidence=(\\w+)\\)', 1), '') AS INTEGER) AS t,
nullif(regexp_extract(line, 'Team (\\d+): (.+?) \\(confidence=(\\w+)\\)', 2), '') AS label, nullif(regexp_extract(line, 'Team (\\d+): (.+?) \\(confidence=(\\w+)\\)', 3), '') AS confidence, nullif(regexp_extract(line, 'caveat: (.+)', 1), '') AS caveat FROM l)
SELECT job, seq, frame, label, confidence, caveat, last_value(t IGNORE NULLS) OVER (PARTITION BY job ORDER BY seq ROWS UNBOUNDED PRECEDING) AS team FROM p""")


def _yolo(s: SparkSession, d: str) -> DataFrame:
    t = lambda c: F.col(c).cast("string")
    e = _events(s, d)
    return e.select(F.when(F.col("user_id") % 5 == 0, "valid").otherwise("train").alias("split"), F.concat(F.lit("img"), (F.col("event_id") % 97).cast("string")).alias("image"), F.concat_ws(" ", (F.col("event_id") % 4).cast("string"), t("user_id"), t("event_id"), F.lit("2"), F.lit("3")).alias("line"))


_YOLO = "SELECT CASE WHEN user_id % 5 = 0 THEN 'valid' ELSE 'train' END AS split, 'img' || (event_id % 97) AS image, CASE event_id % 4 WHEN 1 THEN '0' ELSE '1' END || ' ' || user_id || ' ' || event_id || ' 2 3' AS line FROM events WHERE event_id % 4 IN (1, 3)"
plain("jn_class_map", lambda s, d: D.curate_labels(_yolo(s, d), {1: 0, 3: 1}), _YOLO)
plain("agg_curation_counts", lambda s, d: D.curate_labels(_yolo(s, d), {1: 0, 3: 1}).groupBy("split").agg(F.countDistinct("image").alias("images"), F.count("*").alias("boxes")), f"SELECT split, count(DISTINCT image) AS images, count(*) AS boxes FROM ({_YOLO}) GROUP BY split")
_H = ((0.1, 0.002, 1.0), (0.001, 0.09, -2.0), (0.00001, 0.00002, 1.0))


def _reprojection(s: SparkSession, d: str) -> DataFrame:
    pu, pv = G.project(np.array(_H), (F.col("event_id") % 1920).cast("double"), (F.col("user_id") % 1080).cast("double"))
    dx, dy = pu - F.expr("(event_id % 1050) / 10.0D"), pv - F.expr("(user_id % 680) / 10.0D")
    e = F.sqrt(dx * dx + dy * dy)
    return _events(s, d).groupBy("event_type").agg(F.round(F.avg(e), 6).alias("mean_error_m"), F.round(F.max(e), 6).alias("max_error_m"), F.count("*").alias("n"))


plain("agg_reproj_error", _reprojection, f"""WITH p AS (SELECT event_type, (event_id % 1920)::DOUBLE AS x, (user_id % 1080)::DOUBLE AS y, (event_id % 1050) / 10.0::DOUBLE AS u, (user_id % 680) / 10.0::DOUBLE AS v FROM events),
q AS (SELECT *, {_H[2][0]}::DOUBLE * x + {_H[2][1]}::DOUBLE * y + {_H[2][2]}::DOUBLE AS w FROM p),
e AS (SELECT event_type, ({_H[0][0]}::DOUBLE * x + {_H[0][1]}::DOUBLE * y + {_H[0][2]}::DOUBLE) / w - u AS dx, ({_H[1][0]}::DOUBLE * x + {_H[1][1]}::DOUBLE * y + ({_H[1][2]})::DOUBLE) / w - v AS dy FROM q)
SELECT event_type, round(avg(sqrt(dx * dx + dy * dy)), 6) AS mean_error_m, round(max(sqrt(dx * dx + dy * dy)), 6) AS max_error_m, count(*) AS n FROM e GROUP BY event_type""")
plain("lim_clamp", lambda s, d: _events(s, d).select("event_id", F.greatest(F.lit(0), F.least(F.col("event_id") - 5, F.lit(99))).alias("i")), "SELECT event_id, greatest(0, least(event_id - 5, 99)) AS i FROM events")
over_log("st_bytetrack", None, "frame", "det_seq", "track_id")(lambda log: associate(D.boxes(log).select("clip_id", "frame", "det_seq", *BOX, "confidence")))

over_log("srt_frame", "SELECT " + _LOG + " FROM log", *LOG)(lambda log: log.orderBy("frame", "log_seq"))
_STORED = ("log_seq", "frame", "track_id", "class_name", "team", "pixel_x", "pixel_y", "pitch_x", "pitch_y", "bbox_height", "is_predicted")


def _stored_log(s: SparkSession, d: str) -> DataFrame:
    path = files.scratch(s, "log")
    position_log.write_csv(from_events(_events(s, d)), path)
    return position_log.read_csv(s, path).select(*_STORED)


def _stored_clips(s: SparkSession, d: str) -> DataFrame:
    path = files.scratch(s, "clips")
    position_log.write_csv(position_log.in_clips(from_events(_events(s, d)), 100), path, by_clip=True)
    return position_log.read_csv(s, path).select(T.CLIP, *_STORED)


def _stored_pairs(s: SparkSession, d: str) -> DataFrame:
    path = files.scratch(s, "pairs")
    pairs = _events(s, d).selectExpr("'v' || (event_id div 400) AS video", "event_id div 8 AS frame", "'p' || event_id AS name", "user_id / 2.0D AS pixel_x", "event_id / 4.0D AS pixel_y", "(user_id % 105) / 2.0D AS pitch_x", "(event_id % 68) / 2.0D AS pitch_y")
    whole = pairs.join(pairs.groupBy("video", "frame").count().filter("count >= 4").drop("count"), ["video", "frame"], "left_semi")
    files.write_correspondences(whole, path)
    return files.read_correspondences(s, path, lines=True)


_PAIRS = """WITH p AS (SELECT 'v' || (event_id // 400) AS video, event_id // 8 AS frame, 'p' || event_id AS name, user_id / 2.0::DOUBLE AS pixel_x, event_id / 4.0::DOUBLE AS pixel_y, (user_id % 105) / 2.0::DOUBLE AS pitch_x, (event_id % 68) / 2.0::DOUBLE AS pitch_y FROM events)
SELECT * FROM p WHERE (video, frame) IN (SELECT (video, frame) FROM p GROUP BY video, frame HAVING count(*) >= 4)"""


def _stored_labels(s: SparkSession, d: str) -> DataFrame:
    path = files.scratch(s, "labels")
    for split in ("train", "valid"):
        D.curate_labels(_yolo(s, d), {1: 0, 3: 1}).filter(F.col("split") == split).select("line").write.text(f"{path}/{split}/labels")
    return files.read_labels(s, path).select("split", "line")


plain("sink_position_log", _stored_log, f"{BASE} SELECT row_number() OVER (ORDER BY log_seq) - 1 AS log_seq, {', '.join(_STORED[1:])} FROM log")
plain("src_clip_logs", _stored_clips, f"""{BASE}, c AS (SELECT * REPLACE (frame % 100 AS frame), 'clip' || (frame // 100) AS clip_id FROM log)
SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY log_seq) - 1 AS log_seq, {', '.join(_STORED[1:])} FROM c""")
plain("src_correspondences", _stored_pairs, _PAIRS)
plain("sink_correspondences", lambda s, d: _stored_pairs(s, d).groupBy("video", "frame").agg(F.count("*").alias("n")), f"SELECT video, frame, count(*) AS n FROM ({_PAIRS}) GROUP BY video, frame")
plain("src_yolo_labels", _stored_labels, f"SELECT split, line FROM ({_YOLO})")
