"""Drawing as tables: what to draw, where and in which colour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchflow.functions.geometry import metres_to_canvas
from pitchflow.operators.chunks import running_sum
from pitchflow.operators.tracks import CLIP, players
from pitchflow.schema import BALL, CIRCLE, FADE, LENGTH, TEAM_COLORS, UNKNOWN_COLOR, WIDTH, keypoints


def topdown(log: DataFrame, ball: DataFrame) -> DataFrame:
    """Per clip and frame the ball (hollow where it is inferred) and the players by team."""
    guessed = log.filter(F.col("class_name") == BALL).groupBy(CLIP, "frame").agg(F.max("is_predicted").alias("is_predicted"))
    b = ball.filter("frame >= 0").join(guessed, [CLIP, "frame"], "left")  # a ball's frames lie between frames of the log
    hollow = F.coalesce("was_interpolated", F.lit(False)) | F.coalesce("is_predicted", F.lit(False))
    balls = b.select(CLIP, "frame", F.lit("ball").alias("kind"), F.lit(-1).cast("bigint").alias("track_id"), metres_to_canvas(F.col("x")).alias("px"), metres_to_canvas(F.col("y")).alias("py"), F.lit("ball").alias("color"), (~hollow).alias("filled"))
    people = players(log).select(CLIP, "frame", F.lit("player").alias("kind"), "track_id", metres_to_canvas(F.col("pitch_x")).alias("px"), metres_to_canvas(F.col("pitch_y")).alias("py"), F.coalesce(F.concat(F.lit("team_"), F.col("team").cast("string")), F.lit("none")).alias("color"), F.lit(True).alias("filled"))
    return balls.unionByName(people)


def fading_passes(events: DataFrame, life: int = FADE) -> DataFrame:
    """Each pass on every frame of its life, fading."""
    lived = events.withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(life - 1))))
    ends = [F.col(c).cast("int").alias(c) for c in ("from_x", "from_y", "to_x", "to_y")]
    return lived.select(CLIP, (F.col("event_frame") + F.col("age")).alias("frame"), "from_track", "to_track", F.round(1 - F.col("age") / life, 6).alias("alpha"), *ends)


def running_passes(events: DataFrame) -> DataFrame:
    n = events.groupBy(CLIP, "event_frame").agg(F.count("*").alias("n"))
    return running_sum(n, F.col("n"), "passes", order="event_frame").select(CLIP, "event_frame", "passes")


def overlay(log: DataFrame, possession: DataFrame) -> DataFrame:
    spot = log.groupBy(CLIP, "track_id", "frame").agg(F.min_by(F.struct("pixel_x", "pixel_y"), "log_seq").alias("p"))
    return possession.join(spot, [CLIP, "track_id", "frame"], "left").select(CLIP, "frame", "track_id", "team", "p.pixel_x", "p.pixel_y")


def annotations(log: DataFrame) -> DataFrame:
    """``ball``, or the track's number and, where it is known, its team."""
    team = F.coalesce(F.concat(F.lit(" T"), F.col("team").cast("string")), F.lit(""))
    label = F.when(F.col("class_name") == BALL, F.lit("ball")).otherwise(F.concat(F.lit("#"), F.col("track_id").cast("string"), team))
    return log.select(CLIP, "log_seq", "frame", label.alias("label"), F.coalesce(F.concat(F.lit("team_"), F.col("team").cast("string")), F.lit("none")).alias("color"))


def team_color(team: Column) -> Column:
    """The drawing colour of a team; grey for none."""
    table = F.create_map(*[F.lit(x) for kv in TEAM_COLORS.items() for x in kv])
    return F.coalesce(F.element_at(table, team), F.lit(UNKNOWN_COLOR))


def pass_overlay(log: DataFrame, possession: DataFrame, events: DataFrame) -> DataFrame:
    """What goes over each frame: a ring round the possessor, arrows of passes that fade, and the count of passes so far."""
    none = lambda kind: F.lit(None).cast(kind)
    spot = log.groupBy(CLIP, "track_id", "frame").agg(F.max_by(F.struct("pixel_x", "pixel_y"), "log_seq").alias("p"))
    ring = possession.join(spot, [CLIP, "track_id", "frame"])
    ring = ring.select(CLIP, "frame", F.lit("ring").alias("kind"), "track_id", none("bigint").alias("to_track"), F.col("p.pixel_x").cast("int").alias("x"), F.col("p.pixel_y").cast("int").alias("y"), none("int").alias("to_x"), none("int").alias("to_y"), F.lit(1.0).alias("alpha"), none("bigint").alias("passes"))
    last = log.groupBy(CLIP).agg(F.max("frame").alias("last"))
    arrows = fading_passes(events).join(last, CLIP).filter("frame <= last")
    arrows = arrows.select(CLIP, "frame", F.lit("arrow"), "from_track", "to_track", "from_x", "from_y", "to_x", "to_y", "alpha", none("bigint"))
    spine = last.select(CLIP, F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("frame"))
    made = events.groupBy(CLIP, F.col("event_frame").alias("frame")).agg(F.count("*").alias("n"))
    count = running_sum(spine.join(made, [CLIP, "frame"], "left"), F.coalesce("n", F.lit(0)), "upto")
    count = count.select(CLIP, "frame", F.lit("count"), none("bigint"), none("bigint"), F.lit(20), F.lit(40), none("int"), none("int"), F.lit(1.0), "upto")
    return ring.union(arrows).union(count)


def network_drawing(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Circles by touches and team, and lines by weight, of a passing network in metres."""
    at = lambda c: metres_to_canvas(F.coalesce(c, F.lit(0.0)))
    circles = nodes.select(CLIP, "track_id", "team", "touches", (200 + 100 * F.col("touches")).alias("size"), team_color(F.col("team")).alias("color"), at("x").alias("px"), at("y").alias("py"))
    end = lambda t: circles.select(CLIP, F.col("track_id").alias(t), F.col("px").alias(f"{t}x"), F.col("py").alias(f"{t}y"))
    lines = edges.join(end("a"), [CLIP, "a"]).join(end("b"), [CLIP, "b"]).select(CLIP, "a", "b", (1 + F.col("weight")).alias("width"), "ax", "ay", "bx", "by")
    return circles, lines


def formation_drawing(found: DataFrame) -> DataFrame:
    """Players of each line, the line's number above its middle, and the goalkeeper or that none was found."""
    lines = found.select(CLIP, "team", F.posexplode("lines").alias("i", "l"))
    each = lines.select(CLIP, "team", F.explode(F.arrays_zip("l.track_ids", "l.xs", "l.ys")).alias("p"))
    people = each.select(CLIP, "team", F.lit("player").alias("kind"), F.col("p.track_ids").cast("string").alias("label"), metres_to_canvas(F.col("p.xs")).alias("px"), metres_to_canvas(F.col("p.ys")).alias("py"))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    names = lines.select(CLIP, "team", F.lit("line"), F.concat(F.lit("L"), (F.col("i") + 1).cast("string")), metres_to_canvas(F.round(mean("l.xs"), 6)), metres_to_canvas(F.round(mean("l.ys"), 6) - 6))
    keeper = found.filter("goalkeeper IS NOT NULL").select(CLIP, "team", F.lit("goalkeeper"), F.col("goalkeeper").cast("string"), metres_to_canvas(F.col("gk_x")), metres_to_canvas(F.col("gk_y")))
    none = found.filter("goalkeeper IS NULL").select(CLIP, "team", F.lit("no_goalkeeper"), F.lit(""), F.greatest(metres_to_canvas(F.col("own_goal_x")) - 60, F.lit(5)), metres_to_canvas(F.lit(WIDTH / 2)) - 20)
    return people.union(names).union(keeper).union(none)


def pitch_shapes() -> list[tuple[str, float, float, float, float]]:
    """Lines (two ends) and circles (centre, radius in metres, 0 for a spot) of the empty pitch."""
    at = {name: (x, y) for _, name, x, y in keypoints()}
    rings = [[(0.0, 0.0), (LENGTH, 0.0), (LENGTH, WIDTH), (0.0, WIDTH)]]
    rings += [[at[f"{side}_{box}_{corner}"] for corner in ("top_left", "top_right", "bottom_right", "bottom_left")] for side in ("left", "right") for box in ("penalty_area", "six_yard")]
    lines = [("line", *a, *b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    lines.append(("line", *at["halfway_top"], *at["halfway_bottom"]))
    spots = [("circle", *at[name], 0.0, 0.0) for name in ("center_spot", "left_penalty_spot", "right_penalty_spot")]
    return [*lines, ("circle", *at["center_spot"], CIRCLE, 0.0), *spots]
