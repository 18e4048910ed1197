"""Queries of drawing tables, quality checks, detections and the tracked ball's rows, with SQL from the rules themselves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchflow import schema as S
from pitchflow.operators import detections as D
from pitchflow.operators import formation as M
from pitchflow.operators import render as R
from pitchflow.operators import tactics as A
from pitchflow.operators import tracks as T
from pitchflow.plans.catalog import _KALMAN, _LINES as _JOB_LINES, _NODES, _job_lines, over_log, plain, runs
from pitchflow.streaming import state as K
from pitchflow.streaming.association import BOX


def _px(v: str) -> str:
    return f"CAST(trunc(({v} + 4) * 10) AS INTEGER)"


def _events(log: DataFrame) -> DataFrame:
    return T.pass_events(log, runs(log))


# Passes over the picture
_ENDS = ", ".join(f"CAST(trunc({c}) AS INTEGER) AS {c}" for c in ("from_x", "from_y", "to_x", "to_y"))
_FADE = f"SELECT event_frame + age AS frame, from_track, to_track, round(1 - age / 40.0::DOUBLE, 6) AS alpha, {_ENDS} FROM passes, (SELECT unnest(range(40)) AS age)"
over_log("win_fade", _FADE, "frame", "from_track", "to_track", "alpha", "from_x", "from_y", "to_x", "to_y")(lambda log: R.fading_passes(_events(log)))
over_log(
    "rnd_pass_overlay",
    f""", fade AS ({_FADE}), spine AS (SELECT unnest(generate_series(0, (SELECT max(frame) FROM log))) AS frame)
SELECT p.frame, 'ring' AS kind, p.track_id, NULL::BIGINT AS to_track, CAST(trunc(l.pixel_x) AS INTEGER) AS x, CAST(trunc(l.pixel_y) AS INTEGER) AS y, NULL::INTEGER AS to_x, NULL::INTEGER AS to_y, 1.0::DOUBLE AS alpha, NULL::BIGINT AS passes
FROM possession p JOIN log l ON l.frame = p.frame AND l.track_id = p.track_id
UNION ALL SELECT frame, 'arrow', from_track, to_track, from_x, from_y, to_x, to_y, alpha, NULL FROM fade WHERE frame <= (SELECT max(frame) FROM log)
UNION ALL SELECT frame, 'count', NULL, NULL, 20, 40, NULL, NULL, 1.0, (SELECT count(*) FROM passes WHERE event_frame <= spine.frame) FROM spine""",
)(lambda log: R.pass_overlay(log, T.possessors(log), _events(log)))

# The passing network on the pitch
_POSITIONS, _TOUCHES = _NODES.split(") SELECT ", 1)
_CIRCLES = f"""{_POSITIONS}), nodes AS (SELECT {_TOUCHES}),
circles AS (SELECT track_id, team, touches, 200 + 100 * touches AS size, CASE team WHEN 0 THEN '#e63946' WHEN 1 THEN '#457b9d' ELSE '#999999' END AS color, {_px("coalesce(x, 0)")} AS px, {_px("coalesce(y, 0)")} AS py FROM nodes)"""
_LINES = """SELECT m.a, m.b, 1 + m.weight AS width, p.px AS ax, p.py AS ay, q.px AS bx, q.py AS by
FROM (SELECT least(track_id, prev_track_id) AS a, greatest(track_id, prev_track_id) AS b, count(*) AS weight FROM made GROUP BY ALL) m JOIN circles p ON p.track_id = m.a JOIN circles q ON q.track_id = m.b"""


def _network(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    made = runs(log)
    return R.network_drawing(T.network_nodes(log, made), T.pass_edges(made))


over_log("rnd_network", f"{_CIRCLES} SELECT * FROM circles")(lambda log: _network(log)[0])
over_log("rnd_network_edges", f"{_CIRCLES} {_LINES}")(lambda log: _network(log)[1])

# Quality checks on the log and on logs with one thing wrong each
_WRONG = {
    "as_is": ("true", 1.5),
    "no_error": ("true", 0.0),
    "one_team": ("coalesce(team <> 1, true)", 0.0),
    "lopsided": ("coalesce(team <> 1, true) OR frame % 10 = 0", 0.0),
    "no_ball": ("class_name <> 'sports ball'", 0.0),
    "rare_ball": ("class_name <> 'sports ball' OR frame % 20 = 0", 0.0),
}


def _checks(log: DataFrame) -> DataFrame:
    out = None
    for name, (rows, error) in _WRONG.items():
        one = A.quality_checks(log.filter(rows), mean_error_m=error).select(F.lit(name).alias("variant"), F.concat_ws(",", "warnings").alias("warnings"))
        out = one if out is None else out.unionByName(one)
    return out


over_log(
    "qa_quality_checks",
    ", v AS (" + " UNION ALL ".join(f"SELECT '{n}' AS variant, {e}::DOUBLE AS error, * FROM log WHERE {w}" for n, (w, e) in _WRONG.items()) + """),
t AS (SELECT variant, count(*) AS teams, min(n) AS least, sum(n) AS total FROM (SELECT variant, team, count(*) AS n FROM v WHERE class_name = 'person' AND team IS NOT NULL GROUP BY ALL) GROUP BY variant),
b AS (SELECT variant, max(error) AS error, count(*) FILTER (WHERE class_name = 'sports ball' AND NOT is_predicted) AS real, count(*) FILTER (WHERE class_name = 'sports ball') AS balls, max(frame) + 1 AS frames FROM v GROUP BY variant)
SELECT variant, concat_ws(',', CASE WHEN coalesce(teams, 0) < 2 THEN 'teams_not_separated' WHEN least / total < 0.15 THEN 'team_split_lopsided' END,
       CASE WHEN balls = 0 THEN 'no_ball' WHEN real / frames < 0.15 THEN 'ball_rarely_detected' END, CASE WHEN error > 1.0 THEN 'calibration_error' END) AS warnings FROM b LEFT JOIN t USING (variant)""",
)(_checks)

# The tracked ball among others: every tenth frame has a second ball, which keeps its row and id
LOG_H = np.diag([0.1, 0.1, 1.0])  # ten pixels a metre, as in the derived log
_ALL = ("log_seq", "frame", "track_id", "class_name", "team", "pixel_x", "pixel_y", "pitch_x", "pitch_y", "bbox_height", "is_predicted")


def _balls(log: DataFrame) -> DataFrame:
    second = log.filter("class_name = 'sports ball' AND frame % 10 = 3")
    return log.unionByName(second.withColumns({"log_seq": F.col("log_seq") + 1_000_000_000, "track_id": F.lit(77).cast("bigint"), "pixel_x": F.col("pixel_x") + 50, "pitch_x": F.col("pitch_x") + 5}))


def _ball_log(h: np.ndarray | None):
    def make(log: DataFrame) -> DataFrame:
        both = _balls(log)
        rows = K.ball_rows(both, K.kalman(K.observations(both), max_coast=10), h)
        return rows.withColumns({c: F.round(c, 4) for c in ("pixel_x", "pixel_y", "pitch_x", "pitch_y")})

    return make


def _ball_sql(pitch: bool, where: str = "true") -> str:
    x, y = (f"round(round({c}, 6) * 0.1::DOUBLE, 4)" if pitch else "NULL::DOUBLE" for c in "xy")
    kept = ", ".join(f"round({c}, 4) AS {c}" if c[:5] in ("pixel", "pitch") else c for c in _ALL)
    return f"""{_KALMAN}, every AS (SELECT * FROM log UNION ALL SELECT log_seq + 1000000000, frame, 77, class_name, team, pixel_x + 50, pixel_y, pitch_x + 5, pitch_y, bbox_height, is_predicted FROM log WHERE class_name = 'sports ball' AND frame % 10 = 3),
tracked AS (SELECT l.log_seq, k.frame, CAST(-1 AS BIGINT) AS track_id, 'sports ball' AS class_name, CAST(NULL AS INTEGER) AS team, round(round(x, 6), 4) AS pixel_x, round(round(y, 6), 4) AS pixel_y, {x} AS pitch_x, {y} AS pitch_y, l.bbox_height, NOT k.seen AS is_predicted
            FROM k LEFT JOIN log l ON l.frame = k.frame AND l.class_name = 'sports ball' AND k.seen WHERE live),
rows AS (SELECT {kept} FROM every WHERE log_seq NOT IN (SELECT log_seq FROM tracked WHERE log_seq IS NOT NULL) UNION ALL SELECT * FROM tracked)
SELECT * FROM rows WHERE {where}"""


over_log("st_ball_log", _ball_sql(True), *_ALL)(_ball_log(LOG_H))
over_log("set_append_predicted", _ball_sql(False), *_ALL)(_ball_log(None))
over_log("st_ball_selection", _ball_sql(True, "class_name = 'sports ball'"), *_ALL)(lambda log: _ball_log(LOG_H)(log).filter("class_name = 'sports ball'"))
over_log("st_coast_rows", _ball_sql(True, "is_predicted"), *_ALL)(lambda log: _ball_log(LOG_H)(log).filter("is_predicted"))

# What is taken of a model's boxes
_IOU = "greatest(0.0, least(k.x2, r.x2) - greatest(k.x1, r.x1)) * greatest(0.0, least(k.y2, r.y2) - greatest(k.y1, r.y1))"
_ONE = "{'det_seq': r.det_seq, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}"
over_log(
    "udf_detect",
    f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY frame, class_name ORDER BY confidence DESC, det_seq) AS rn FROM boxes WHERE confidence >= CASE WHEN class_name = 'sports ball' THEN 0.1 ELSE 0.3 END),
nms AS (SELECT frame, class_name, rn, [{_ONE}] AS kept FROM ranked r WHERE rn = 1
        UNION ALL SELECT r.frame, r.class_name, r.rn, CASE WHEN len(list_filter(n.kept, lambda k: {_IOU} > 0.5 * ((k.x2 - k.x1) * (k.y2 - k.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - {_IOU}))) > 0 THEN n.kept ELSE list_append(n.kept, {_ONE}) END
        FROM nms n JOIN ranked r ON r.frame = n.frame AND r.class_name = n.class_name AND r.rn = n.rn + 1),
final AS (SELECT frame, class_name, arg_max(kept, rn) AS kept FROM nms GROUP BY ALL)
SELECT class_name, unnest(CASE WHEN class_name = 'sports ball' THEN kept[1:1] ELSE kept END).det_seq AS det_seq FROM final""",
    "det_seq", "class_name",
)(lambda log: D.detect(D.boxes(log), S.BALL))

# Following a player from box to box, and the colour of what was followed
_WALK = """, people AS (SELECT *, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my FROM boxes WHERE class_name = 'person'),
reach AS (SELECT a.det_seq, b.det_seq AS next, NOT (a.mx BETWEEN b.x1 AND b.x2 AND a.my BETWEEN b.y1 AND b.y2) AS far, sqrt((a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my)) AS d, (b.x2 - b.x1) * (b.y2 - b.y1) AS area FROM people a JOIN people b ON b.frame = a.frame + 1),
step AS (SELECT det_seq, next FROM (SELECT *, row_number() OVER (PARTITION BY det_seq ORDER BY far, CASE WHEN far THEN d ELSE area END, next) AS rn FROM reach WHERE NOT far OR d <= 40) WHERE rn = 1),
starts AS (%s), walk AS (SELECT det_seq AS start_id, det_seq, 0 AS k FROM starts UNION ALL SELECT w.start_id, s.next, w.k + 1 FROM walk w JOIN step s ON s.det_seq = w.det_seq WHERE w.k < 19)"""


def _boxes(log: DataFrame) -> DataFrame:
    return D.boxes(log).filter("class_name = 'person'").select("clip_id", "frame", "det_seq", "track_id", *BOX)


def _starts(boxes: DataFrame) -> DataFrame:
    return boxes.select(F.col("det_seq").alias("start_id"), "clip_id", "frame", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))


over_log("win_track_forward", _WALK % "SELECT det_seq FROM people" + " SELECT w.start_id, p.frame, w.det_seq FROM walk w JOIN people p USING (det_seq) WHERE k > 0", "start_id", "frame", "det_seq")(lambda log: (lambda b: K.follow(b, _starts(b)))(_boxes(log)))
_LAST = 5000
plain(
    "st_progress", lambda s, d: D.progress(_job_lines(s, d), F.lit(_LAST)),
    f"SELECT job, max(frame) AS frame, round(0.05::DOUBLE + CASE WHEN max(frame) > {_LAST} THEN 1.0 ELSE max(frame) / {_LAST} END * {0.7 - 0.05!r}::DOUBLE, 6) AS progress FROM (SELECT job, CAST(nullif(regexp_extract(line, 'frame (\\d+):', 1), '') AS BIGINT) AS frame FROM ({_JOB_LINES})) GROUP BY job",
)

# Formations over the defensive phase, in so far as a threshold gives plausible lines
_FOUND = """, own AS (SELECT s.team, p.frame FROM sides s JOIN phase p ON p.team <> s.team),
told AS (SELECT *, frames >= 50 AND rows >= 50 AS by_phase FROM (SELECT s.team, (SELECT count(*) FROM own o WHERE o.team = s.team) AS frames, (SELECT count(*) FROM log l JOIN own o ON o.frame = l.frame AND o.team = l.team WHERE l.team = s.team AND l.class_name = 'person') AS rows FROM sides s)),
seen AS (SELECT p.* FROM players p JOIN told t USING (team) WHERE NOT t.by_phase OR EXISTS (SELECT 1 FROM own o WHERE o.team = p.team AND o.frame = p.frame)),
dpool AS (SELECT team, track_id, median(pitch_x) AS x, median(pitch_y) AS y, count(*) AS n_frames FROM seen WHERE pitch_x BETWEEN -5 AND 110 AND pitch_y BETWEEN -5 AND 73 GROUP BY ALL HAVING count(*) >= 5),
ranked AS (SELECT d.*, k.gk, row_number() OVER (PARTITION BY team ORDER BY n_frames DESC, track_id) AS rank FROM dpool d LEFT JOIN keeper k USING (team) WHERE k.gk IS NULL OR d.track_id <> k.gk),
indeep AS (SELECT r.*, CASE WHEN own_goal_x = 0 THEN x ELSE 105 - x END AS depth FROM ranked r JOIN direction USING (team) WHERE rank <= 10),
dgaps AS (SELECT team, track_id, depth, x, y, t.threshold, CASE WHEN depth - lag(depth) OVER (PARTITION BY team, t.threshold ORDER BY depth, track_id) <= t.threshold THEN 0 ELSE 1 END AS new FROM indeep, (SELECT unnest([4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 12.0])::DOUBLE AS threshold) t),
dlines AS (SELECT *, CAST(sum(new) OVER (PARTITION BY team, threshold ORDER BY depth, track_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line FROM dgaps),
dsized AS (SELECT team, threshold, count(*) AS n_lines, sum(n) AS total, max(n) AS most, first(n ORDER BY line) AS back, string_agg(n, '-' ORDER BY line) AS label FROM (SELECT team, threshold, line, count(*) AS n FROM dlines GROUP BY ALL) GROUP BY ALL),
dnext AS (SELECT *, lead(label) OVER (PARTITION BY team ORDER BY threshold) AS nxt FROM dsized),
best AS (SELECT team, threshold, label, CASE WHEN coalesce(nxt, label) = label THEN 'high' ELSE 'medium' END AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY threshold) AS k FROM dnext WHERE n_lines BETWEEN 2 AND 5 AND most <= 6 AND most / total <= 0.7 AND back BETWEEN 3 AND 5) WHERE k = 1)"""
_DETECT = f"""{_FOUND}, sizes AS (SELECT team, count(*) AS n_candidates FROM dpool GROUP BY team), cut AS (SELECT team, max(n_frames) FILTER (WHERE rank = 10) AS last_in, max(n_frames) FILTER (WHERE rank = 11) AS first_out, count(*) FILTER (WHERE rank <= 10) AS n_included FROM ranked GROUP BY team)
SELECT b.team, b.label, b.confidence, b.threshold, k.gk AS goalkeeper, d.direction, d.own_goal_x, n_candidates, n_included,
       concat_ws(',', CASE WHEN k.gk IS NULL THEN 'goalkeeper_not_found' END, CASE WHEN NOT by_phase THEN 'few_defensive_frames' END, CASE WHEN n_candidates > 12 THEN 'track_fragmentation' WHEN n_candidates < 10 THEN 'tracks_missing' END,
                 CASE WHEN (last_in - first_out) / last_in < 0.15 THEN 'cutoff_ambiguous' END) AS caveats
FROM best b JOIN direction d USING (team) JOIN told USING (team) JOIN sizes USING (team) JOIN cut USING (team) LEFT JOIN keeper k USING (team)"""
_TOLD = ("team", "label", "confidence", "threshold", "goalkeeper", "direction", "own_goal_x", "n_candidates", "n_included", "caveats")
over_log("frm_detect", _DETECT, *_TOLD)(lambda log: M.detect(log, T.clean_ball(log)).withColumn("caveats", F.concat_ws(",", "caveats")))
over_log("frm_roles", f"""{_FOUND}, lined AS (SELECT l.*, max(line) OVER (PARTITION BY l.team) AS n FROM dlines l JOIN best b ON b.team = l.team AND b.threshold = l.threshold)
SELECT team, CASE WHEN line = 1 THEN 'defense' WHEN line = n THEN 'attack' WHEN n <= 3 THEN 'midfield' ELSE 'line_' || line END AS role, track_id FROM lined""", "team", "role", "track_id")(
    lambda log: M.detect(log, T.clean_ball(log)).select("team", F.explode("lines").alias("l")).select("team", "l.role", F.explode("l.track_ids").alias("track_id"))
)
over_log("rnd_formation", f"""{_FOUND}, lined AS (SELECT l.* FROM dlines l JOIN best b ON b.team = l.team AND b.threshold = l.threshold)
SELECT team, 'player' AS kind, CAST(track_id AS VARCHAR) AS label, {_px("x")} AS px, {_px("y")} AS py FROM lined
UNION ALL SELECT team, 'line', 'L' || line, {_px("round(avg(x), 6)")}, {_px("round(avg(y), 6) - 6")} FROM lined GROUP BY team, line
UNION ALL SELECT k.team, 'goalkeeper', CAST(gk AS VARCHAR), {_px("s.x")}, {_px("s.y")} FROM keeper k JOIN best USING (team) JOIN strict s ON s.team = k.team AND s.track_id = k.gk
UNION ALL SELECT b.team, 'no_goalkeeper', '', greatest({_px("own_goal_x")} - 60, 5), {_px("34.0")} - 20 FROM best b JOIN direction USING (team) LEFT JOIN keeper k ON k.team = b.team WHERE k.gk IS NULL""")(lambda log: R.formation_drawing(M.detect(log, T.clean_ball(log))))

# Density of a team's positions
over_log("rnd_heatmap", """, bins AS (SELECT team, (CAST(least(floor(pitch_x * 21 / 105.0::DOUBLE), 20) AS BIGINT) + 0.5) * 105.0::DOUBLE / 21 AS px, (CAST(least(floor(pitch_y * 17 / 68.0::DOUBLE), 16) AS BIGINT) + 0.5) * 68.0::DOUBLE / 17 AS py, count(*) AS n FROM teamed WHERE pitch_x BETWEEN 0 AND 105 AND pitch_y BETWEEN 0 AND 68 GROUP BY ALL),
cov AS (SELECT team, count(*) AS total, var_samp(pitch_x) * pow(count(*), -1.0::DOUBLE / 3) AS vx, var_samp(pitch_y) * pow(count(*), -1.0::DOUBLE / 3) AS vy, covar_samp(pitch_x, pitch_y) * pow(count(*), -1.0::DOUBLE / 3) AS vxy FROM teamed GROUP BY team),
cells AS (SELECT *, (cell % 21 + 0.5) * 105.0::DOUBLE / 21 AS gx, (cell // 21 + 0.5) * 68.0::DOUBLE / 17 AS gy FROM (SELECT unnest(range(357)) AS cell)),
dense AS (SELECT b.team, cell, gx, gy, round(sum(n * exp(-0.5 * (vy * (gx - px) * (gx - px) - 2 * vxy * (gx - px) * (gy - py) + vx * (gy - py) * (gy - py)) / (vx * vy - vxy * vxy))) / any_value(total * 2 * pi() * sqrt(vx * vy - vxy * vxy)), 9) AS density FROM bins b JOIN cov c ON c.team = b.team, cells GROUP BY ALL)
SELECT team, gx, gy, density, round(sum(density) OVER (PARTITION BY team ORDER BY density, cell ROWS UNBOUNDED PRECEDING) / sum(density) OVER (PARTITION BY team), 4) AS share FROM dense""".replace("dense AS", "thick AS").replace("FROM dense", "FROM thick"))(A.heatmap_density)
