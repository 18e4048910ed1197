"""Queries of images, data sets, uploads, calibrations of many videos, heat-map bands and readable warnings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchflow.functions import geometry as G
from pitchflow.operators import detections as D
from pitchflow.operators import render as R
from pitchflow.operators import tactics as A
from pitchflow.operators import tracks as T
from pitchflow.plans.catalog import _H, _KP_SQL, _events, keypoint_table, over_log, plain
from pitchflow.plans.drawing import _WALK, _boxes, _px, _starts
from pitchflow.sources import dataset, files, images
from pitchflow.sources.position_log import in_clips
from pitchflow.streaming import state as K

#: Events of an image; their pixels are 8 to a row, or one row if they don't fill rows.
PER_IMAGE, ROW = 64, 8
#: Neighbouring images that are drawn in one call.
AT_ONCE = 256
_VALUE = "CAST(round(value * 100) AS BIGINT)"
#: Channels of an event's pixel: factors of its number, its user and its value.
_BGR = {"b": (1, 0, 3), "g": (7, 5, 1), "r": (2, 13, 7)}
_channel = lambda c: "(event_id * {} + user_id * {} + {} * {}) % 256".format(*_BGR[c][:2], _VALUE, _BGR[c][2])


def _event_images(s: SparkSession, d: str) -> DataFrame:
    """``image``, ``number`` and ``content``: PNGs whose pixels are those of the events table's rows."""
    rows = _events(s, d).selectExpr(f"event_id div {PER_IMAGE} AS number", "event_id", *(f"CAST({_channel(c)} AS INT) AS {c}" for c in "bgr"))

    def draw(p: pd.DataFrame) -> pd.DataFrame:
        made = {}
        for number, one in p.sort_values("event_id").groupby("number"):
            pixels = one[["b", "g", "r"]].to_numpy()
            made[number] = images.encode_png(pixels.reshape((-1, ROW, 3) if len(pixels) % ROW == 0 else (1, -1, 3)))
        return pd.DataFrame({"image": [f"img{n}" for n in made], "number": list(made), "content": list(made.values())})

    return files.stored(rows.groupBy(F.expr(f"number div {AT_ONCE}")).applyInPandas(draw, "image string, number bigint, content binary"), "images")


def _hue(rows: str) -> str:
    """SQL for the rows of a query with b, g and r, and their hue and saturation."""
    turn = "CASE WHEN v = lo THEN 0.0 WHEN v = r THEN 30 * (g - b) / (v - lo) WHEN v = g THEN 60 + 30 * (b - r) / (v - lo) ELSE 120 + 30 * (r - g) / (v - lo) END"
    return f"SELECT * EXCLUDE (v, lo, turn), CAST(floor(CASE WHEN turn < 0 THEN turn + 180 ELSE turn END + 0.5) AS BIGINT) % 180 AS h, CASE WHEN v = 0 THEN 0 ELSE CAST(floor(255 * (v - lo) / v + 0.5) AS BIGINT) END AS s FROM (SELECT *, {turn} AS turn FROM (SELECT *, greatest(b, g, r)::DOUBLE AS v, least(b, g, r)::DOUBLE AS lo FROM ({rows})))"


_EVENT_PIXELS = "SELECT event_id, event_id // 64 AS crop, " + ", ".join(f"{_channel(c)} AS {c}" for c in "bgr") + " FROM events"
_CLEAR = "NOT (h BETWEEN 35 AND 95 AND s >= 60)"
plain("prj_hue_saturation", lambda s, d: images.with_hue(images.image_pixels(_event_images(s, d), "number")).select("number", "x", "y", "h", "s"), f"""WITH p AS ({_hue(_EVENT_PIXELS)}), z AS (SELECT *, count(*) OVER (PARTITION BY crop) AS n, row_number() OVER (PARTITION BY crop ORDER BY event_id) - 1 AS k FROM p)
SELECT crop AS number, CAST(CASE WHEN n % {ROW} = 0 THEN k % {ROW} ELSE k END AS INTEGER) AS x, CAST(CASE WHEN n % {ROW} = 0 THEN k // {ROW} ELSE 0 END AS INTEGER) AS y, CAST(h AS INTEGER) AS h, CAST(s AS INTEGER) AS s FROM z""")
plain(
    "agg_mean_color", lambda s, d: D.mean_colors(images.with_hue(images.image_pixels(_event_images(s, d).withColumnRenamed("number", "crop"), "crop"))),
    f"WITH p AS ({_hue(_EVENT_PIXELS)}), c AS (SELECT crop, count(*) AS n, count(*) FILTER (WHERE {_CLEAR}) AS k, " + ", ".join(f"sum({x}) AS {x}a, sum({x}) FILTER (WHERE {_CLEAR}) AS {x}k" for x in "bgr")
    + " FROM p GROUP BY crop) SELECT crop, " + ", ".join(f"round(CASE WHEN k < greatest(3.0, 0.05 * n) THEN {x}a / n ELSE {x}k / k END, 6) AS {x}" for x in "bgr") + " FROM c",
)


# A data set of images, labels and a description, written as one and read back
def _dataset(s: SparkSession, d: str) -> str:
    path = files.scratch(s, "dataset")
    e = _events(s, d).withColumn("number", F.expr(f"event_id div {PER_IMAGE}"))
    text = F.concat_ws(" ", (F.col("event_id") % 4).cast("string"), F.col("user_id").cast("string"), F.col("event_id").cast("string"), F.lit("2"), F.lit("3"))
    split = F.when(F.col("number") % 5 == 0, "valid").otherwise("train")
    lines = D.curate_labels(e.select(split.alias("split"), F.col("number").alias("image"), text.alias("line")), {1: 0, 3: 1})
    lines = lines.groupBy("image").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    rows = _event_images(s, d).join(lines.withColumnRenamed("image", "number"), "number", "left").select(split.alias("split"), "image", "content", "lines")
    dataset.write_dataset(rows, path, ["ball", "player"])
    return path


_SPLIT = "CASE WHEN (event_id // 64) % 5 = 0 THEN 'valid' ELSE 'train' END"
_LABELS = f"SELECT {_SPLIT} AS split, 'img' || (event_id // 64) AS image, CASE event_id % 4 WHEN 1 THEN '0' ELSE '1' END || ' ' || user_id || ' ' || event_id || ' 2 3' AS line FROM events WHERE event_id % 4 IN (1, 3)"
plain("sink_dataset", lambda s, d: files.read_labels(s, _dataset(s, d)), _LABELS)
plain(
    "sink_dataset_description", lambda s, d: dataset.read_description(s, _dataset(s, d)),
    f"""WITH i AS (SELECT DISTINCT {_SPLIT} AS split, event_id // 64 AS image FROM events)
SELECT split AS key, split || '/images' AS value FROM i GROUP BY split UNION ALL SELECT 'nc', '2' UNION ALL SELECT 'names', '["ball", "player"]' UNION ALL SELECT split || '_images', CAST(count(*) AS VARCHAR) FROM i GROUP BY split
UNION ALL SELECT split || '_lines', CAST(count(*) AS VARCHAR) FROM ({_LABELS}) GROUP BY split""",
)


def _anchor_images(s: SparkSession, d: str) -> DataFrame:
    raw = files.read_binary(s, f"{_dataset(s, d)}/*/images", "*.png")
    return images.image_pixels(raw, "name", "number").groupBy("name", "number").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.sum("b").alias("b"), F.sum("g").alias("g"), F.sum("r").alias("r"))


plain("src_anchor_images", _anchor_images, f"SELECT 'img' || crop || '.png' AS name, crop AS number, CAST(CASE WHEN count(*) % 8 = 0 THEN 8 ELSE count(*) END AS INTEGER) AS width, CAST(CASE WHEN count(*) % 8 = 0 THEN count(*) // 8 ELSE 1 END AS INTEGER) AS height, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in "bgr") + f" FROM ({_EVENT_PIXELS}) GROUP BY crop")


def _uploads(s: SparkSession, d: str) -> DataFrame:
    """Files of the events' rows, landed and read back."""
    path = files.scratch(s, "uploads")
    line = F.concat_ws(":", F.col("event_id").cast("string"), F.col("event_type"))
    made = _events(s, d).groupBy(F.expr("event_id div 100").alias("number")).agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"])).alias("text"))
    images.write_files(made.select(F.concat(F.lit("job"), F.col("number").cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content")), path).write.format("noop").mode("overwrite").save()
    return files.read_binary(s, path, "*.txt").select("name", "number", "length", F.sha2("content", 256).alias("sha256"))


plain("src_upload", _uploads, "SELECT 'job' || n || '.txt' AS name, n AS number, CAST(strlen(t) AS BIGINT) AS length, sha256(t) AS sha256 FROM (SELECT event_id // 100 AS n, string_agg(event_id || ':' || event_type, chr(10) ORDER BY event_id) AS t FROM events GROUP BY ALL)")

# Colours of clicked players, from a picture of each frame: every row of the log has two of its columns
_HIGH = 20
#: A pixel's channels: factors of the row's height, of its column and line, and of its number.
_SHIRT = {"b": (7, 31, 13, 1), "g": (11, 5, 29, 3), "r": (3, 17, 7, 5)}


def _pictures(log: DataFrame) -> DataFrame:
    rows = log.select(T.CLIP, "frame", "log_seq", F.col("bbox_height").cast("bigint").alias("h"))

    def draw(p: pd.DataFrame) -> pd.DataFrame:
        frames, of = np.unique(p["frame"].to_numpy(), return_inverse=True)
        pictures = np.zeros((len(frames), _HIGH, 48, 3), dtype=np.int64)
        y, dx = np.indices((_HIGH, 2))
        n, h = (p[c].to_numpy()[:, None, None] for c in ("log_seq", "h"))
        for c, (fh, fx, fy, fn) in enumerate(_SHIRT.values()):
            pictures[of[:, None, None], y, 2 * (n % 24) + dx, c] = (h * fh + dx * fx + y * fy + n * fn) % 256
        return pd.DataFrame({T.CLIP: p[T.CLIP].iloc[0], "frame": frames, "content": [images.encode_png(x) for x in pictures]})

    return rows.groupBy(T.CLIP, F.expr(f"frame div {AT_ONCE}")).applyInPandas(draw, f"{T.CLIP} string, frame bigint, content binary")


def _anchor_colors(log: DataFrame) -> DataFrame:
    boxes = _boxes(log)
    clicks = boxes.groupBy("clip_id", "track_id").agg(F.min_by(F.struct("det_seq", "frame", *D_BOX), "det_seq").alias("b")).select("clip_id", "track_id", "b.*")
    seen = K.follow(boxes, _starts(clicks)).select("start_id", F.col("det_seq").alias("crop")).unionByName(clicks.select(F.col("det_seq").alias("start_id"), F.col("det_seq").alias("crop")))
    seen = files.stored(seen, "followed")
    strip = boxes.select(T.CLIP, "frame", F.col("det_seq").alias("crop"), (F.col("det_seq") % 24 * 2).alias("x1"), F.lit(0).alias("y1"), (F.col("det_seq") % 24 * 2 + 2).alias("x2"), F.lit(_HIGH).alias("y2"))
    torso = strip.select(T.CLIP, "frame", "crop", *G.torso_box("x1", "y1", "x2", "y2")).select(T.CLIP, "frame", "crop", *(F.col(f"t{c}").alias(c) for c in D_BOX))
    wanted = files.stored(torso.join(seen.select("crop").distinct(), "crop", "left_semi"), "wanted")
    shown = log.join(wanted.select(T.CLIP, "frame").distinct(), [T.CLIP, "frame"], "left_semi")  # other pictures have no box to read
    pixels = images.with_hue(images.crop_pixels(_pictures(shown), wanted, [T.CLIP, "frame"]))
    return D.anchor_colors(seen, pixels).join(clicks.select(F.col("det_seq").alias("start_id"), "track_id"), "start_id").select("track_id", *"bgr")


D_BOX = ["x1", "y1", "x2", "y2"]
_STRIP = "SELECT det_seq AS crop, " + ", ".join(f"(CAST(bbox_height AS BIGINT) * {a} + dx * {b} + y * {c} + det_seq * {n}) % 256 AS {k}" for k, (a, b, c, n) in _SHIRT.items()) + " FROM (SELECT p.det_seq, l.bbox_height FROM people p JOIN log l ON l.log_seq = p.det_seq), (SELECT unnest(range(2)) AS dx), (SELECT unnest(range(3, 11)) AS y)"
over_log(
    "agg_anchor_color",
    _WALK % "SELECT min(det_seq) AS det_seq FROM people GROUP BY track_id" + f""",
pix AS ({_hue(_STRIP)}),
crops AS (SELECT crop, count(*) AS n, count(*) FILTER (WHERE {_CLEAR}) AS ok, {", ".join(f"sum({c}) AS {c}a, sum({c}) FILTER (WHERE {_CLEAR}) AS {c}k" for c in "bgr")} FROM pix GROUP BY crop)
SELECT any_value(p.track_id) AS track_id, {", ".join(f"round(sum(CASE WHEN ok < greatest(3.0, 0.05 * n) THEN {c}a ELSE {c}k END) / sum(CASE WHEN ok < greatest(3.0, 0.05 * n) THEN n ELSE ok END), 6) AS {c}" for c in "bgr")}
FROM walk w JOIN crops c ON c.crop = w.det_seq JOIN people p ON p.det_seq = w.start_id GROUP BY w.start_id""",
)(_anchor_colors)


# Calibrations of many videos: the points fit a homography without error, so a right fit maps each onto its mate
def _pairs(s: SparkSession, d: str) -> DataFrame:
    px, py = F.expr("(event_id * 37 % 1920) * 1.0D"), F.expr("(user_id * 91 + event_id * 53) % 1080 * 1.0D")
    u, v = G.project(np.array(_H), px, py)
    return _events(s, d).select(F.expr("event_id div 20").alias("video"), px.alias("pixel_x"), py.alias("pixel_y"), u.alias("pitch_x"), v.alias("pitch_y"))


_FITTED = "SELECT event_id // 20 AS video, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 20"


def _whole(fits: DataFrame) -> DataFrame:
    return fits.filter("n >= 20")


plain("udf_homography_fit", lambda s, d: _whole(G.fit_homographies(_pairs(s, d))).select("video", "n", F.round("mean_error_m", 6).alias("mean_error_m"), F.round("max_error_m", 6).alias("max_error_m")), f"SELECT video, n, 0.0::DOUBLE AS mean_error_m, 0.0::DOUBLE AS max_error_m FROM ({_FITTED})")


def _stored_homographies(s: SparkSession, d: str) -> DataFrame:
    path = files.scratch(s, "homographies")
    _whole(G.fit_homographies(_pairs(s, d))).select("video", *(f"h{i}" for i in range(9))).write.parquet(path)
    back = s.read.parquet(path)
    return back.select("video", F.posexplode(F.array(*(F.round(f"h{i}", 5) for i in range(9)))).alias("i", "v"))


plain("src_homography", _stored_homographies, f"SELECT video, i, v FROM ({_FITTED}), (VALUES " + ", ".join(f"({i}, round(({v})::DOUBLE, 5))" for i, v in enumerate(v for row in _H for v in row)) + ") t(i, v)")


def _stored_options(s: SparkSession, d: str) -> DataFrame:
    """Options of each job, written as files of lines and read back, with the defaults of what they don't set."""
    path = files.scratch(s, "options")
    jobs = _events(s, d).groupBy(F.expr("event_id div 100").alias("job")).agg(F.count("*").alias("n"))
    text = F.concat(F.lit("# a job\nmax_coast_frames: "), F.col("n").cast("string"), F.lit("  # frames\n\nball_confidence: 0.2\nother: x\n"))
    images.write_files(jobs.select(F.concat(F.lit("job"), F.col("job").cast("string"), F.lit(".yaml")).alias("name"), text.cast("binary").alias("content")), path).write.format("noop").mode("overwrite").save()
    return files.read_all_options(s, path)


plain("src_config", _stored_options, "SELECT 'job' || (event_id // 100) AS job, count(*) AS max_coast_frames, 5.0::DOUBLE AS process_noise, 10.0::DOUBLE AS measurement_noise, 0.3::DOUBLE AS person_confidence, 0.2::DOUBLE AS ball_confidence FROM events GROUP BY 1")


def _stored_sections(s: SparkSession, d: str) -> str:
    """Where each job's options lie, written in nested sections."""
    path = files.scratch(s, "sections")
    jobs = _events(s, d).groupBy(F.expr("event_id div 100").alias("job")).agg(F.count("*").alias("n"), F.count_if(F.col("event_id") % 2 == 0).alias("even"))
    text = F.format_string("device: cpu  # where\n\ndetection:\n  # lower bars\n  ball_confidence_threshold: 0.2\n  classes: null\n\nball_tracking:\n    enabled: true\n    max_coast_frames: %d\n    process_noise: %d.5\npaths:\n  log:\n    csv: \"a b: c#%d\"\n  max_coast_frames: 3\n", "n", "even", "job")
    images.write_files(jobs.select(F.concat(F.lit("job"), F.col("job").cast("string"), F.lit(".yaml")).alias("name"), text.cast("binary").alias("content")), path).write.format("noop").mode("overwrite").save()
    return path


_JOBS = "SELECT event_id // 100 AS job, count(*) AS n, count(*) FILTER (WHERE event_id % 2 = 0) AS even FROM events GROUP BY 1"
plain("src_config_sections", lambda s, d: files.read_sections(s, _stored_sections(s, d)),
      f"SELECT 'job' || job AS job, path, value FROM ({_JOBS}), LATERAL (VALUES ('device', 'cpu'), ('detection.ball_confidence_threshold', '0.2'), ('detection.classes', 'null'), ('ball_tracking.enabled', 'true'), ('ball_tracking.max_coast_frames', CAST(n AS VARCHAR)), ('ball_tracking.process_noise', even || '.5'), ('paths.log.csv', 'a b: c#' || job), ('paths.max_coast_frames', '3')) t(path, value)")
plain("src_config_sectioned", lambda s, d: files.read_sectioned_options(s, _stored_sections(s, d)),
      f"SELECT 'job' || job AS job, n AS max_coast_frames, even + 0.5::DOUBLE AS process_noise, 10.0::DOUBLE AS measurement_noise, 0.3::DOUBLE AS person_confidence, 0.2::DOUBLE AS ball_confidence FROM ({_JOBS})")

# Landmarks with how often each was clicked, and the empty pitch that each clip is drawn on
plain("src_keypoints", lambda s, d: keypoint_table(s).join(_events(s, d).groupBy((F.col("user_id") % 29).cast("int").alias("id")).agg(F.count("*").alias("clicks")), "id", "left").select("id", "name", "x", "y", F.coalesce("clicks", F.lit(0)).alias("clicks")),
      f"SELECT k.id, name, x, y, coalesce(n, 0) AS clicks FROM ({_KP_SQL}) k LEFT JOIN (SELECT user_id % 29 AS id, count(*) AS n FROM events GROUP BY 1) e ON e.id = k.id")


def _pitch(log: DataFrame) -> DataFrame:
    shapes = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(("kind", "x", "y", "u", "v"), row, strict=True))) for row in R.pitch_shapes()))
    rows = in_clips(log, 100).select(T.CLIP).distinct().select(T.CLIP, F.explode(shapes).alias("p")).select(T.CLIP, "p.*")
    line, at = F.col("kind") == "line", G.metres_to_canvas
    radius = F.when(~line, F.when(F.col("u") > 0, (F.col("u") * 10).cast("int")).otherwise(3))
    return rows.select(T.CLIP, "kind", at(F.col("x")).alias("x1"), at(F.col("y")).alias("y1"), F.when(line, at(F.col("u"))).alias("x2"), F.when(line, at(F.col("v"))).alias("y2"), radius.alias("radius"))


_CORNERS = "(VALUES ('top_left', 'top_right'), ('top_right', 'bottom_right'), ('bottom_right', 'bottom_left'), ('bottom_left', 'top_left')) e(f, t)"
over_log("rnd_pitch", f""", k AS ({_KP_SQL}),
named AS (SELECT 'corner_' || f AS a, 'corner_' || t AS b FROM {_CORNERS} UNION ALL SELECT 'halfway_top', 'halfway_bottom'
          UNION ALL SELECT side || '_' || box || '_' || f, side || '_' || box || '_' || t FROM (VALUES ('left'), ('right')) s(side), (VALUES ('penalty_area'), ('six_yard')) z(box), {_CORNERS}),
shapes AS (SELECT 'line' AS kind, {_px("a.x")} AS x1, {_px("a.y")} AS y1, {_px("b.x")} AS x2, {_px("b.y")} AS y2, NULL::INTEGER AS radius FROM named n JOIN k a ON a.name = n.a JOIN k b ON b.name = n.b
UNION ALL SELECT 'circle', {_px("x")}, {_px("y")}, NULL, NULL, 91 FROM k WHERE name = 'center_spot'
UNION ALL SELECT 'circle', {_px("x")}, {_px("y")}, NULL, NULL, 3 FROM k WHERE name IN ('center_spot', 'left_penalty_spot', 'right_penalty_spot'))
SELECT clip_id, shapes.* FROM (SELECT DISTINCT 'clip' || (frame // 100) AS clip_id FROM log), shapes""", T.CLIP, "kind", "x1", "y1", "x2", "y2", "radius")(_pitch)

# Contours of the density: rows for 100 levels
_DENSE = """, bins AS (SELECT team, (CAST(least(floor(pitch_x * 21 / 105.0::DOUBLE), 20) AS BIGINT) + 0.5) * 105.0::DOUBLE / 21 AS px, (CAST(least(floor(pitch_y * 17 / 68.0::DOUBLE), 16) AS BIGINT) + 0.5) * 68.0::DOUBLE / 17 AS py, count(*) AS n FROM teamed WHERE pitch_x BETWEEN 0 AND 105 AND pitch_y BETWEEN 0 AND 68 GROUP BY ALL),
cov AS (SELECT team, count(*) AS total, var_samp(pitch_x) * pow(count(*), -1.0::DOUBLE / 3) AS vx, var_samp(pitch_y) * pow(count(*), -1.0::DOUBLE / 3) AS vy, covar_samp(pitch_x, pitch_y) * pow(count(*), -1.0::DOUBLE / 3) AS vxy FROM teamed GROUP BY team),
cells AS (SELECT *, (cell % 21 + 0.5) * 105.0::DOUBLE / 21 AS gx, (cell // 21 + 0.5) * 68.0::DOUBLE / 17 AS gy FROM (SELECT unnest(range(357)) AS cell)),
thick AS (SELECT b.team, cell, CAST(round(1e9 * round(sum(n * exp(-0.5 * (vy * (gx - px) * (gx - px) - 2 * vxy * (gx - px) * (gy - py) + vx * (gy - py) * (gy - py)) / (vx * vy - vxy * vxy))) / any_value(total * 2 * pi() * sqrt(vx * vy - vxy * vxy)), 9)) AS BIGINT) AS d FROM bins b JOIN cov c ON c.team = b.team, cells GROUP BY ALL)"""
_IN = {c: f"{c} >= lv" for c in "abcd"}
_at_x, _at_y = (lambda v: f"round((({v}) + 0.5) * 105.0::DOUBLE / 21, 6)"), (lambda v: f"round((({v}) + 0.5) * 68.0::DOUBLE / 17, 6)")
_part = lambda p, q: f"(lv - {p})::DOUBLE / ({q} - {p})"
_cut = lambda p, q, x, y: f"CASE WHEN ({_IN[p]}) <> ({_IN[q]}) THEN {{'x': {_at_x(x)}, 'y': {_at_y(y)}}} END"
over_log("rnd_heatmap_bands", f"""{_DENSE}, summed AS (SELECT *, sum(d) OVER (PARTITION BY team ORDER BY d DESC, cell ROWS UNBOUNDED PRECEDING) AS upto, sum(d) OVER (PARTITION BY team) AS total FROM thick),
lv AS (SELECT team, k + 1 AS level, max(d) AS lv FROM summed, (SELECT unnest(range(100)) AS k) WHERE upto * 9900000 >= total * (9900000 - 5000 * 99 - k * 95000) GROUP BY ALL),
sq AS (SELECT t.team, t.cell % 21 AS i, t.cell // 21 AS j, t.d AS a, u.d AS b, v.d AS c, w.d AS d FROM thick t JOIN thick u ON u.team = t.team AND u.cell = t.cell + 1 JOIN thick v ON v.team = t.team AND v.cell = t.cell + 22 JOIN thick w ON w.team = t.team AND w.cell = t.cell + 21 WHERE t.cell % 21 < 20),
cuts AS (SELECT team, level, lv, a, ({_IN["a"]}) = (a + b + c + d >= 4 * lv) AS apart, {_cut("a", "b", "i + " + _part("a", "b"), "j")} AS low, {_cut("b", "c", "i + 1", "j + " + _part("b", "c"))} AS rgt, {_cut("d", "c", "i + " + _part("d", "c"), "j + 1")} AS top, {_cut("a", "d", "i", "j + " + _part("a", "d"))} AS lft FROM sq JOIN lv USING (team)),
seen AS (SELECT *, list_filter([low, rgt, top, lft], lambda p: p IS NOT NULL) AS ps FROM cuts),
segs AS (SELECT team, level, lv, unnest(CASE WHEN len(ps) = 4 AND apart THEN [[low, rgt], [top, lft]] WHEN len(ps) = 4 THEN [[low, lft], [rgt, top]] ELSE [ps] END) AS s FROM seen WHERE len(ps) > 0)
SELECT team, CAST(level AS INTEGER) AS level, lv / 1e9 AS at, s[1].x AS x1, s[1].y AS y1, s[2].x AS x2, s[2].y AS y2 FROM segs""")(lambda log: A.level_bands(A.heatmap_density(log)))

# Warnings as sentences: of the log, and with one thing wrong each
_WRONG = {"as_is": ("true", 1.5), "one_team": ("coalesce(team <> 1, true)", 0.0), "lopsided": ("coalesce(team <> 1, true) OR frame % 10 = 0", 0.0), "no_ball": ("class_name <> 'sports ball'", 0.0), "rare_ball": ("class_name <> 'sports ball' OR frame % 20 = 0", 0.0)}


def _messages(log: DataFrame) -> DataFrame:
    out = None
    for name, (rows, error) in _WRONG.items():
        one = A.quality_messages(log.filter(rows), mean_error_m=error).select(F.lit(name).alias("variant"), F.explode(F.arrays_zip("warnings", "messages")).alias("w")).select("variant", F.col("w.warnings").alias("code"), F.col("w.messages").alias("message"))
        out = one if out is None else out.unionByName(one)
    return out


_SAY = {k: "'" + v.replace("'", "''").replace("%.0f", "%d").replace("%.2f", "%.2f") + "'" for k, v in A.SENTENCES.items()}
over_log("qa_quality_messages", ", v AS (" + " UNION ALL ".join(f"SELECT '{n}' AS variant, {e}::DOUBLE AS error, * FROM log WHERE {w}" for n, (w, e) in _WRONG.items()) + f"""),
t AS (SELECT variant, count(*) AS teams, 100 * min(n) / sum(n) AS least FROM (SELECT variant, team, count(*) AS n FROM v WHERE class_name = 'person' AND team IS NOT NULL GROUP BY ALL) GROUP BY variant),
b AS (SELECT variant, max(error) AS error, count(*) FILTER (WHERE class_name = 'sports ball' AND NOT is_predicted) AS real, count(*) FILTER (WHERE class_name = 'sports ball') AS balls, max(frame) + 1 AS frames FROM v GROUP BY variant),
m AS (SELECT b.*, coalesce(teams, 0) AS teams, least, 100 * real / frames AS seen FROM b LEFT JOIN t USING (variant))
SELECT variant, 'teams_not_separated' AS code, {_SAY["teams_not_separated"]} AS message FROM m WHERE teams < 2
UNION ALL SELECT variant, 'team_split_lopsided', printf({_SAY["team_split_lopsided"]}, CAST(round(least) AS BIGINT)) FROM m WHERE teams >= 2 AND least < 15
UNION ALL SELECT variant, 'no_ball', {_SAY["no_ball"]} FROM m WHERE balls = 0
UNION ALL SELECT variant, 'ball_rarely_detected', printf({_SAY["ball_rarely_detected"]}, CAST(round(seen) AS BIGINT)) FROM m WHERE balls > 0 AND seen < 15
UNION ALL SELECT variant, 'calibration_error', printf({_SAY["calibration_error"]}, error) FROM m WHERE error > 1.0""")(_messages)
