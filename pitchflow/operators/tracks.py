"""Filters, the ball track, possession, touches, passes and the passing network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchflow.functions.geometry import distance
from pitchflow.operators import jumps
from pitchflow.operators.chunks import CLIP, nearest, split_clips
from pitchflow.schema import BALL, BALL_MARGIN, LENGTH, MAX_GAP, MAX_JUMP, MIN_RUN, PERSON, RADIUS_M, RADIUS_SCALE, WIDTH
from pitchflow.sources.files import stored


def within(margin: float, x: str = "pitch_x", y: str = "pitch_y") -> Column:
    return F.col(x).between(-margin, LENGTH + margin) & F.col(y).between(-margin, WIDTH + margin)


def players(log: DataFrame, space: str = "pitch") -> DataFrame:
    """Persons with coordinates: no ball and no referee class, but persons without a team too."""
    return log.filter(F.col("class_name") == PERSON).dropna(subset=[f"{space}_x", f"{space}_y"])


def team_positions(log: DataFrame) -> DataFrame:
    return log.filter((F.col("class_name") != BALL) & F.col("pitch_x").isNotNull() & F.col("pitch_y").isNotNull() & F.col("team").isNotNull())


def is_calibrated(log: DataFrame) -> DataFrame:
    return log.groupBy(CLIP).agg(F.max(F.col("pitch_x").isNotNull()).alias("calibrated"))


def space_of(log: DataFrame) -> DataFrame:
    """One pair of coordinates for a whole clip: metres if any row has them, else pixels."""
    both = log.join(stored(is_calibrated(log), "calibrated"), CLIP)  # a small file: Spark broadcasts it below its threshold
    return both.withColumns({c: F.when(F.col("calibrated"), F.col(f"pitch_{c}")).otherwise(F.col(f"pixel_{c}")) for c in "xy"})


def player_scale(log: DataFrame, space: str = "pitch") -> DataFrame:
    """Exact median box height of each frame's players."""
    return players(log, space).groupBy(CLIP, "frame").agg(F.median("bbox_height").alias("scale"))


def global_scale(scale: DataFrame) -> DataFrame:
    return scale.groupBy(CLIP).agg(F.coalesce(F.median("scale"), F.lit(1.0)).alias("global_scale"))


def raw_ball(log: DataFrame, space: str = "pitch") -> DataFrame:
    """One ball row per frame: the tracked ball (track -1) first, then log order; in pitch space within bounds."""
    rows = log.filter(F.col("class_name") == BALL).dropna(subset=[f"{space}_x", f"{space}_y"])
    if space == "pitch":
        rows = rows.filter(within(BALL_MARGIN))
    first = F.struct((F.col("track_id") != -1).alias("other"), "log_seq")
    return rows.groupBy(CLIP, "frame").agg(F.min_by(F.struct(F.col(f"{space}_x").alias("x"), F.col(f"{space}_y").alias("y")), first).alias("p")).select(CLIP, "frame", "p.x", "p.y")


def ball_with_scale(log: DataFrame, space: str = "pitch") -> DataFrame:
    """A frame without players, or with scale 0, takes the clip's scale; a null scale of a frame stays null."""
    scale = player_scale(log, space).withColumn("known", F.lit(True))
    rows = raw_ball(log, space).join(scale, [CLIP, "frame"], "left").join(global_scale(scale), CLIP, "left")
    use = F.when(F.col("known").isNull() | (F.col("scale") == 0), F.coalesce("global_scale", F.lit(1.0))).otherwise(F.col("scale"))
    return rows.select(CLIP, "frame", "x", "y", use.alias("scale"))


def jump_filter(rows: DataFrame, max_jump: float = MAX_JUMP) -> DataFrame:
    """Drops ball rows too far from the last one kept, for the frames between, chunk by chunk."""
    return jumps.jump_filter(rows, max_jump)


def interpolate(track: DataFrame, max_gap: int = MAX_GAP, strict_gaps: bool = False) -> DataFrame:
    """Every frame from the first to the last: gaps get at most their first ``max_gap`` frames filled linearly
    (with ``strict_gaps``, longer gaps stay wholly empty); frames without a position are left out.

    A gap is filled from the row after it, so that only the row before has to be known.
    """
    at = nearest(track.select(CLIP, "frame", "x", "y"), F.struct("frame", "x", "y"), "p", own=False)
    gap = F.col("frame") - F.col("p.frame")
    last = F.least(F.col("frame") - 1, F.col("p.frame") + max_gap)
    open_ = (gap > 1) & (gap - 1 <= max_gap) if strict_gaps else gap > 1
    between = lambda f, c: (F.col(f"p.{c}") + (F.col(c) - F.col(f"p.{c}")) * (f - F.col("p.frame")) / gap).alias(c)
    own = F.array(F.struct("frame", "x", "y", F.lit(False).alias("was_interpolated")))
    filled = F.transform(F.sequence(F.col("p.frame") + 1, last), lambda f: F.struct(f.alias("frame"), between(f, "x"), between(f, "y"), F.lit(True).alias("was_interpolated")))
    return at.select(CLIP, F.explode(F.when(open_, F.concat(own, filled)).otherwise(own)).alias("r")).select(CLIP, "r.*")


def clean_ball(log: DataFrame, space: str = "pitch", max_gap: int = MAX_GAP, max_jump: float = MAX_JUMP) -> DataFrame:
    return interpolate(jump_filter(ball_with_scale(log, space), max_jump), max_gap)


def player_ball(log: DataFrame, ball: DataFrame, space: str = "pitch") -> DataFrame:
    b = ball.select(CLIP, "frame", F.col("x").alias("ball_x"), F.col("y").alias("ball_y"))
    return players(log, space).join(b, [CLIP, "frame"]).withColumn("dist", distance(f"{space}_x", f"{space}_y", "ball_x", "ball_y"))


def possessors(log: DataFrame, ball: DataFrame | None = None, space: str = "pitch", radius: float = RADIUS_M, radius_scale: float = RADIUS_SCALE) -> DataFrame:
    """The nearest player within the radius in each frame; ties go to the first row of the log."""
    near = player_ball(log, clean_ball(log, space) if ball is None else ball, space)
    if space == "pitch":
        near = near.filter(F.col("dist") <= radius)
    else:
        scale = player_scale(log, space)
        near = near.join(scale, [CLIP, "frame"], "left").join(global_scale(scale), CLIP, "left").filter(F.col("dist") <= F.coalesce("scale", "global_scale") * radius_scale)
    return near.groupBy(CLIP, "frame").agg(F.min_by(F.struct("track_id", "team"), F.struct("dist", "log_seq")).alias("p")).select(CLIP, "frame", "p.*")


def possession_runs(possession: DataFrame, min_frames: int = MIN_RUN) -> DataFrame:
    """Touches: neighbouring possession rows of one player, whatever frames lie between, if there are enough.

    A run is named by the frame that it starts on, which rows of later chunks are told by one row a chunk.
    """
    possession = stored(possession, "possession")
    split = split_clips(possession)
    rows = nearest(possession, F.struct("track_id"), "before", own=False, split=split)
    begins = F.col("before").isNull() | (F.col("track_id") != F.col("before.track_id"))
    rows = nearest(rows, F.when(begins, F.col("frame")), "run", split=split)
    team = F.min_by("team", F.when(F.col("team").isNotNull(), F.col("frame")))
    runs = rows.groupBy(CLIP, "run").agg(F.min("track_id").alias("track_id"), team.alias("team"), F.count("*").alias("length"), F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"))
    return runs.filter(F.col("length") >= min_frames).drop("run")


def run_pairs(runs: DataFrame) -> DataFrame:
    """Each run with the one before it."""
    w = Window.partitionBy(CLIP).orderBy("start_frame")
    prev = {f"prev_{c}": F.lag(c).over(w) for c in ("track_id", "team", "end_frame")}
    return runs.withColumns(prev).filter("prev_track_id IS NOT NULL")


def passes(runs: DataFrame) -> DataFrame:
    return run_pairs(runs).filter("team = prev_team AND track_id <> prev_track_id")


def pass_events(log: DataFrame, runs: DataFrame) -> DataFrame:
    """Passes with the pixel positions where the ball left and arrived."""
    spot = log.groupBy(CLIP, "track_id", "frame").agg(F.min_by(F.struct("pixel_x", "pixel_y"), "log_seq").alias("p"))
    a = spot.select(CLIP, F.col("track_id").alias("from_track"), F.col("frame").alias("prev_end_frame"), F.col("p.pixel_x").alias("from_x"), F.col("p.pixel_y").alias("from_y"))
    b = spot.select(CLIP, F.col("track_id").alias("to_track"), F.col("frame").alias("event_frame"), F.col("p.pixel_x").alias("to_x"), F.col("p.pixel_y").alias("to_y"))
    made = passes(runs).select(CLIP, F.col("start_frame").alias("event_frame"), F.col("prev_track_id").alias("from_track"), F.col("track_id").alias("to_track"), "team", "prev_end_frame")
    return made.join(a, [CLIP, "from_track", "prev_end_frame"]).join(b, [CLIP, "to_track", "event_frame"]).select(CLIP, "event_frame", "from_track", "to_track", "team", "from_x", "from_y", "to_x", "to_y")


def pass_edges(runs: DataFrame) -> DataFrame:
    return passes(runs).groupBy(CLIP, F.least("track_id", "prev_track_id").alias("a"), F.greatest("track_id", "prev_track_id").alias("b")).agg(F.count("*").alias("weight"))


def touches(runs: DataFrame) -> DataFrame:
    return runs.groupBy(CLIP, "track_id").agg(F.count("*").alias("touches"))


def node_positions(log: DataFrame, space: str = "pitch") -> DataFrame:
    return players(log, space).groupBy(CLIP, "track_id").agg(F.round(F.avg(f"{space}_x"), 6).alias("x"), F.round(F.avg(f"{space}_y"), 6).alias("y"))


def network_nodes(log: DataFrame, runs: DataFrame, space: str = "pitch") -> DataFrame:
    """Players with a touch: team of their first run, mean position over the whole log, touches."""
    team = runs.groupBy(CLIP, "track_id").agg(F.min_by("team", "start_frame").alias("team"))
    return touches(runs).join(team, [CLIP, "track_id"]).join(node_positions(log, space), [CLIP, "track_id"], "left")
