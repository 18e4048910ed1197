"""Detections, team labels, clicks, label curation and parsed job output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchflow.operators.chunks import CLIP
from pitchflow.schema import VOTES

#: What a frame is named by: numbers of frames, boxes and tracks mean nothing without their clip.
FRAME = [CLIP, "frame"]

#: Anchors that a row is compared with at once.
ANCHORS = 1000


def boxes(log: DataFrame) -> DataFrame:
    """Boxes standing on each row's foot point, half as wide as high."""
    half = F.floor(F.col("bbox_height") / 2) / 2
    out = log.select(*FRAME, F.col("log_seq").alias("det_seq"), "track_id", "class_name", (F.col("pixel_x") - half).alias("x1"), (F.col("pixel_y") - F.col("bbox_height")).alias("y1"), (F.col("pixel_x") + half).alias("x2"), F.col("pixel_y").alias("y2"))
    return out.withColumn("confidence", (F.col("det_seq") * 37 % 100) / 100.0)


def foot_points(b: DataFrame) -> DataFrame:
    return b.select(CLIP, "det_seq", ((F.col("x1") + F.col("x2")) / 2).alias("foot_x"), F.col("y2").alias("foot_y"), (F.col("y2") - F.col("y1")).alias("height"))


def remap_classes(b: DataFrame, names: dict[str, str]) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return b.withColumn("class_name", F.coalesce(F.element_at(table, F.col("class_name")), "class_name"))


def best_of_singletons(b: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """One detection per frame of each singleton class: the surest, then the first."""
    w = Window.partitionBy(*FRAME, "class_name").orderBy(F.desc("confidence"), "det_seq")
    one = b.filter(F.col("class_name").isin(*classes)).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    return b.filter(~F.col("class_name").isin(*classes)).unionByName(one)


def click_boxes(clicks: DataFrame, b: DataFrame, reach: float = 80.0) -> DataFrame:
    """For each of ``clicks(clip_id, frame, click_id, cx, cy)``: the smallest box that contains it, else the box with the
    nearest centre within ``reach``; ties go to the first box. Clicks without either are left out.

    Clicks and boxes meet in cells of a grid of ``reach``: a click is in one, a box in all from which it can be chosen.
    """
    cell = lambda v: F.floor(v / reach).cast("bigint")
    middle = lambda c: (F.col(f"{c}1") + F.col(f"{c}2")) / 2
    cells = lambda c: F.explode(F.sequence(cell(F.least(F.col(f"{c}1"), middle(c) - reach)), cell(F.greatest(F.col(f"{c}2"), middle(c) + reach))))
    near = b.filter("x1 <= x2 AND y1 <= y2").select(*FRAME, "det_seq", "x1", "y1", "x2", "y2", cells("x").alias("cell_x")).withColumn("cell_y", cells("y"))
    asked = clicks.select(*FRAME, "click_id", "cx", "cy", cell(F.col("cx")).alias("cell_x"), cell(F.col("cy")).alias("cell_y"))
    both = asked.join(near, [*FRAME, "cell_x", "cell_y"])
    inside = F.col("cx").between(F.col("x1"), F.col("x2")) & F.col("cy").between(F.col("y1"), F.col("y2"))
    dx, dy = F.col("cx") - middle("x"), F.col("cy") - middle("y")
    both = both.withColumns({"out": ~inside, "d": F.sqrt(dx * dx + dy * dy), "area": (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))}).filter(~F.col("out") | (F.col("d") <= reach))
    key = F.struct("out", F.when(F.col("out"), F.col("d")).otherwise(F.col("area")), "det_seq")
    best = both.groupBy(*FRAME, "click_id").agg(F.min_by(F.struct("det_seq", F.col("out").alias("by_centre")), key).alias("p"))
    return best.select(*FRAME, "click_id", "p.*")


def team_votes(sightings: DataFrame, votes: int = VOTES) -> DataFrame:
    """Label of a track of a clip at each sighting: the commonest of its first ``votes`` so far, ties to the earliest; null is a vote.

    A track is sorted by its sightings, but only the first ``votes`` are gathered: later rows take what those say.
    """
    w = Window.partitionBy(CLIP, "track_id").orderBy("seq")
    label = F.coalesce("label", F.lit(-1))
    rows = sightings.withColumn("rn", F.row_number().over(w)).withColumn("seen", F.collect_list(F.when(F.col("rn") <= votes, label)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tally = F.transform(F.array_distinct("seen"), lambda x: F.struct(F.size(F.filter("seen", lambda y: y == x)).alias("n"), (-F.array_position("seen", x)).alias("p"), x.alias("label")))
    won = F.array_max(tally)["label"]
    return rows.select(CLIP, "track_id", "seq", F.when(won >= 0, won).alias("team"), (F.col("rn") >= votes).alias("locked"))


def track_majority(sightings: DataFrame) -> DataFrame:
    counts = sightings.groupBy(CLIP, "track_id", F.coalesce("label", F.lit(-1)).alias("label")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return counts.groupBy(CLIP, "track_id").agg(F.max_by("label", F.struct("n", -F.col("first"))).alias("label"))


def nearest_anchor(vectors: DataFrame, anchors: DataFrame) -> DataFrame:
    """Label of the nearest anchor; ties to the lowest label. ``anchors`` has one row a label.

    A vector is compared with a block of ANCHORS anchors at a time in its own row. With one block, as with
    colours of teams, nothing is shuffled. Without anchors the result is empty.
    """
    n = anchors.count()
    blocks = -(-n // ANCHORS)
    told = anchors.groupBy(F.pmod(F.xxhash64("anchor_label"), F.lit(max(1, blocks))).alias("block")).agg(F.collect_list(F.struct("anchor_label", "anchor")).alias("anchors"))
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))
    each = vectors.withColumn("block", F.explode(places)) if blocks > 1 else vectors.withColumn("block", F.lit(0).cast("bigint"))
    far = lambda anchor: F.aggregate(F.zip_with("vec", anchor, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    least = F.array_min(F.transform("anchors", lambda a: F.struct(far(a["anchor"]).alias("d2"), a["anchor_label"].alias("label"))))
    found = each.join(F.broadcast(told) if blocks <= 1 else told, "block").select("vec_id", least.alias("p"))
    if blocks > 1:
        found = found.groupBy("vec_id").agg(F.min("p").alias("p"))
    return found.select("vec_id", "p.label", "p.d2")


def suppress(b: DataFrame, overlap: float = 0.5) -> DataFrame:
    """Without the boxes that overlap a surer box of their clip's frame and class, that stays, by more than ``overlap``."""
    size = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
    side = lambda p, q, c: F.greatest(F.lit(0.0), F.least(p[f"{c}2"], q[f"{c}2"]) - F.greatest(p[f"{c}1"], q[f"{c}1"]))
    both = lambda p, q: side(p, q, "x") * side(p, q, "y")
    covers = lambda p, q: both(p, q) > overlap * (size(p) + size(q) - both(p, q))
    box = F.struct((-F.col("confidence")).alias("doubt"), "det_seq", "track_id", "x1", "y1", "x2", "y2")
    found = b.groupBy(*FRAME, "class_name").agg(F.sort_array(F.collect_list(box)).alias("boxes"))  # a frame's boxes are few
    stays = F.aggregate("boxes", F.slice("boxes", 1, 0), lambda kept, x: F.when(F.exists(kept, lambda k: covers(k, x)), kept).otherwise(F.concat(kept, F.array(x))))
    rows = found.select(*FRAME, "class_name", F.explode(stays).alias("x")).select(*FRAME, "class_name", "x.*")
    return rows.select(*FRAME, "det_seq", "track_id", "class_name", "x1", "y1", "x2", "y2", (-F.col("doubt")).alias("confidence"))


def detect(b: DataFrame, ball: str, sure: float = 0.3, ball_sure: float = 0.1, overlap: float = 0.5) -> DataFrame:
    """What is taken of a model's boxes: sure enough for their class, not suppressed, and of balls the surest of a frame."""
    enough = F.col("confidence") >= F.when(F.col("class_name") == ball, ball_sure).otherwise(sure)
    return best_of_singletons(suppress(b.filter(enough), overlap), (ball,))


def crop_sums(pixels: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Sums of the b, g and r of a crop's pixels without grass (hue 35 to 95, saturation from 60), and their number ``n``;
    of all pixels if under 3 or 5 percent are left. ``pixels(crop, b, g, r, h, s)``."""
    ok = ~(F.col("h").between(35, 95) & (F.col("s") >= 60))
    c = pixels.groupBy("crop", *extra).agg(F.count("*").alias("every"), F.count_if(ok).alias("kept"), *(F.sum(x).alias(f"{x}_all") for x in "bgr"), *(F.sum(F.when(ok, F.col(x))).alias(f"{x}_kept") for x in "bgr"))
    few = F.col("kept") < F.greatest(F.lit(3.0), 0.05 * F.col("every"))
    return c.select("crop", *extra, F.when(few, F.col("every")).otherwise(F.col("kept")).alias("n"), *(F.when(few, F.col(f"{x}_all")).otherwise(F.col(f"{x}_kept")).alias(x) for x in "bgr"))


def mean_colors(pixels: DataFrame) -> DataFrame:
    return crop_sums(pixels).select("crop", *(F.round(F.col(x) / F.col("n"), 6).alias(x) for x in "bgr"))


def anchor_colors(sightings: DataFrame, pixels: DataFrame) -> DataFrame:
    """Mean colour of each clicked player over the crops of the boxes that it was followed through. ``sightings(start_id, crop)``."""
    pooled = sightings.join(crop_sums(pixels), "crop").groupBy("start_id").agg(*(F.sum(c).alias(c) for c in (*"bgr", "n")))
    return pooled.select("start_id", *(F.round(F.col(x) / F.col("n"), 6).alias(x) for x in "bgr"))


def parse_job_output(lines: DataFrame) -> DataFrame:
    """Formation lines and the caveats under them, each with the team named last."""
    get = lambda pattern, k: F.nullif(F.regexp_extract("line", pattern, k), F.lit(""))
    team, label, sure = (get(r"Team (\d+): (.+?) \(confidence=(\w+)\)", k) for k in (1, 2, 3))
    rows = lines.select("job", "seq", get(r"frame (\d+):", 1).cast("bigint").alias("frame"), team.cast("int").alias("t"), label.alias("label"), sure.alias("confidence"), get(r"caveat: (.+)", 1).alias("caveat"))
    return rows.withColumn("team", F.last("t", True).over(Window.partitionBy("job").orderBy("seq"))).drop("t")


def progress(lines: DataFrame, frame_count: Column, low: float = 0.05, high: float = 0.7) -> DataFrame:
    """How far a job is, from the frames that its output names, between ``low`` and ``high``; null before the first."""
    done = F.when(F.max("frame") > frame_count, 1.0).otherwise(F.max("frame") / frame_count)
    return parse_job_output(lines).groupBy("job").agg(F.max("frame").alias("frame"), F.round(low + done * (high - low), 6).alias("progress"))


def parse_class_map(text: str) -> dict[int, int]:
    """``a:b,c:d`` as a map of class numbers; blanks are passed over, anything else is an error."""
    return {int(a): int(b) for a, b in (pair.split(":") for pair in text.replace(" ", "").split(",") if pair)}


def curate_labels(lines: DataFrame, classes: dict[int, int]) -> DataFrame:
    """Label lines ``class x y w h`` with the classes mapped; others are dropped. ``lines(split, image, line)``."""
    table = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    parts = F.split("line", " ")
    kept = lines.withColumn("new", F.element_at(table, F.try_element_at(parts, F.lit(1)).try_cast("int"))).filter("new IS NOT NULL")
    return kept.select("split", "image", F.concat_ws(" ", F.col("new").cast("string"), F.concat_ws(" ", F.slice(parts, 2, 4))).alias("line"))
