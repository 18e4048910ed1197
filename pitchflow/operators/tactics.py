"""Team shape, heat maps and quality checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from pitchflow.functions.geometry import distance
from pitchflow.operators.tracks import CLIP, team_positions
from pitchflow.schema import BALL, LENGTH, PERSON, WIDTH

BY = [CLIP, "frame", "team"]


def centroid(log: DataFrame) -> DataFrame:
    return team_positions(log).groupBy(*BY).agg(F.round(F.avg("pitch_x"), 6).alias("x"), F.round(F.avg("pitch_y"), 6).alias("y"))


def width_depth(log: DataFrame) -> DataFrame:
    return team_positions(log).groupBy(*BY).agg((F.max("pitch_y") - F.min("pitch_y")).alias("width"), (F.max("pitch_x") - F.min("pitch_x")).alias("depth"))


def hull_area(xs: np.ndarray, ys: np.ndarray) -> float:
    """Area of the convex hull by Andrew's monotone chain; 0 for points on a line."""
    points = sorted(set(zip(map(float, xs), map(float, ys), strict=True)))
    if len(points) < 3:
        return 0.0

    def chain(ps) -> list:
        out: list = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    hull = chain(points) + chain(points[::-1])
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, hull[1:] + hull[:1], strict=True))) / 2


@F.pandas_udf(DoubleType())
def _areas(xs: pd.Series, ys: pd.Series) -> pd.Series:
    return pd.Series([hull_area(x, y) for x, y in zip(xs, ys, strict=True)], dtype="float64")


def compactness(log: DataFrame) -> DataFrame:
    """Hull area of each team with at least three players in a frame; a frame's players are few, so lists are short."""
    points = team_positions(log).groupBy(*BY).agg(F.collect_list("pitch_x").alias("xs"), F.collect_list("pitch_y").alias("ys")).filter(F.size("xs") >= 3)
    return points.select(*BY, F.round(_areas("xs", "ys"), 6).alias("area"))


def teammate_pairs(log: DataFrame) -> DataFrame:
    p = team_positions(log).select(*BY, "log_seq", "pitch_x", "pitch_y")
    a, b = (p.select(*BY, *(F.col(c).alias(c + s) for c in ("log_seq", "pitch_x", "pitch_y"))) for s in "ab")
    return a.join(b, BY).filter("log_seqa < log_seqb").withColumn("dist", distance("pitch_xa", "pitch_ya", "pitch_xb", "pitch_yb"))


def teammate_distance(log: DataFrame) -> DataFrame:
    """Mean distance between teammates in a frame, from the short list of its players, without a join."""
    team = team_positions(log).groupBy(*BY).agg(F.collect_list(F.struct("pitch_x", "pitch_y")).alias("p")).withColumn("n", F.size("p"))
    apart = lambda a, b: F.sqrt(F.pow(a["pitch_x"] - b["pitch_x"], 2) + F.pow(a["pitch_y"] - b["pitch_y"], 2))
    after = lambda a, i: F.aggregate(F.slice("p", i + 2, F.col("n")), F.lit(0.0), lambda s, b: s + apart(a, b))
    total = F.aggregate(F.transform("p", after), F.lit(0.0), lambda s, x: s + x)
    return team.filter("n > 1").select(*BY, F.round(total / (F.col("n") * (F.col("n") - 1) / 2), 6).alias("mean_distance"))


def summary(log: DataFrame) -> DataFrame:
    """Means over frames, for each team."""
    mean = lambda df, *cols: df.groupBy(CLIP, "team").agg(*(F.round(F.avg(c), 4).alias(c) for c in cols))
    return mean(compactness(log), "area").join(mean(width_depth(log), "width", "depth"), [CLIP, "team"]).join(mean(teammate_distance(log), "mean_distance"), [CLIP, "team"])


def heatmap_bins(log: DataFrame, nx: int = 21, ny: int = 17) -> DataFrame:
    """Counts on a grid over the pitch; positions outside it are left out."""
    rows = team_positions(log).filter(F.col("pitch_x").between(0, LENGTH) & F.col("pitch_y").between(0, WIDTH))
    bx = F.least(F.floor(F.col("pitch_x") * nx / LENGTH), F.lit(nx - 1)).cast("bigint")
    by = F.least(F.floor(F.col("pitch_y") * ny / WIDTH), F.lit(ny - 1)).cast("bigint")
    return rows.groupBy(CLIP, "team", bx.alias("bx"), by.alias("by")).agg(F.count("*").alias("n"))


def heatmap_density(log: DataFrame, nx: int = 21, ny: int = 17) -> DataFrame:
    """Gaussian density at the cells' centres from the binned counts, with the positions' covariance by Scott's factor.

    ``share`` is how much of the density lies in cells no denser than this one: what is under 0.05 isn't drawn.
    Positions on a line have no density.
    """
    bins = heatmap_bins(log, nx, ny).select(CLIP, "team", ((F.col("bx") + 0.5) * LENGTH / nx).alias("px"), ((F.col("by") + 0.5) * WIDTH / ny).alias("py"), "n")
    stats = team_positions(log).groupBy(CLIP, "team").agg(F.count("*").alias("all"), F.var_samp("pitch_x").alias("vx"), F.var_samp("pitch_y").alias("vy"), F.covar_samp("pitch_x", "pitch_y").alias("vxy"))
    factor = F.pow("all", F.lit(-1.0 / 3))
    stats = stats.withColumns({c: F.col(c) * factor for c in ("vx", "vy", "vxy")}).withColumn("det", F.col("vx") * F.col("vy") - F.col("vxy") * F.col("vxy")).filter("det > 1e-9")
    grid = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(nx * ny - 1))).alias("cell")).withColumns({"gx": (F.col("cell") % nx + 0.5) * LENGTH / nx, "gy": (F.expr(f"cell div {nx}") + 0.5) * WIDTH / ny})
    dx, dy = F.col("gx") - F.col("px"), F.col("gy") - F.col("py")
    far = (F.col("vy") * dx * dx - 2 * F.col("vxy") * dx * dy + F.col("vx") * dy * dy) / F.col("det")
    near = grid.join(bins, [CLIP, "team"]).groupBy(CLIP, "team", "cell", "gx", "gy").agg((F.sum(F.col("n") * F.exp(-0.5 * far)) / F.first(F.col("all") * 2 * np.pi * F.sqrt("det"))).alias("density"))
    near = near.withColumn("density", F.round("density", 9))
    team = Window.partitionBy(CLIP, "team")
    upto = F.sum("density").over(team.orderBy("density", "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return near.withColumn("share", F.round(upto / F.sum("density").over(team), 4)).select(CLIP, "team", "gx", "gy", "density", "share")


def level_bands(density: DataFrame, nx: int = 21, ny: int = 17, levels: int = 100, least: float = 0.05) -> DataFrame:
    """Contours of ``heatmap_density``: ``level`` (from 1), its density ``at``, and segments from ``x1``, ``y1`` to ``x2``, ``y2``.

    Level k of ``levels`` bounds the fewest cells that hold 1 - q of the density, q rising evenly from ``least`` to 1. Segments
    come from marching squares over the cells' centres; where corners inside lie crosswise, the mean of the four decides. A
    team has one row of arrays over the grid, so that nothing is joined.
    """
    unit = 1_000_000_000  # densities have nine digits: sums of whole numbers are exact
    cell = F.floor(F.col("gx") * nx / LENGTH) + nx * F.floor(F.col("gy") * ny / WIDTH)
    grid = density.groupBy(CLIP, "team").agg(F.sort_array(F.collect_list(F.struct(cell.cast("int").alias("cell"), F.round(F.col("density") * unit).cast("bigint").alias("d")))).alias("g"))
    grid = grid.withColumn("v", F.transform("g", lambda c: c["d"])).withColumn("falling", F.sort_array("v", asc=False))
    total = F.aggregate("v", F.lit(0).cast("bigint"), lambda s, d: s + d)
    grid = grid.withColumn("total", total).filter("total > 0")
    # Share 1 - q of level k, in parts of a hundred thousand levels.
    parts = 100_000 * (levels - 1)
    need = lambda k: F.lit(parts) - F.lit(round(least * 100_000) * (levels - 1)) - k.cast("bigint") * F.lit(100_000 - round(least * 100_000))
    rising = F.aggregate("falling", F.struct(F.lit(0).cast("bigint").alias("s"), F.expr("CAST(array() AS array<bigint>)").alias("c")), lambda a, d: F.struct((a["s"] + d).alias("s"), F.concat(a["c"], F.array(a["s"] + d)).alias("c")))
    grid = grid.withColumn("sums", rising["c"]).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    enough = F.size(F.filter("sums", lambda s: s.cast("decimal(38,0)") * parts < F.col("total").cast("decimal(38,0)") * need(F.col("k"))))
    at = F.element_at("falling", F.least(enough, F.size("falling") - 1) + 1)
    each = grid.select(CLIP, "team", "v", (F.col("k") + 1).alias("level"), at.alias("lv")).withColumn("sq", F.explode(F.sequence(F.lit(0), F.lit((nx - 1) * (ny - 1) - 1))))
    i, j = F.col("sq") % (nx - 1), F.floor(F.col("sq") / (nx - 1)).cast("int")
    corner = lambda di, dj: F.element_at("v", (i + di + nx * (j + dj) + 1).cast("int"))
    each = each.withColumns({"i": i, "j": j, "a": corner(0, 0), "b": corner(1, 0), "c": corner(1, 1), "d": corner(0, 1)})
    inside = {c: F.col(c) >= F.col("lv") for c in "abcd"}
    each = each.filter(~((inside["a"] == inside["b"]) & (inside["b"] == inside["c"]) & (inside["c"] == inside["d"])))
    x, y = lambda v: F.round((v + 0.5) * LENGTH / nx, 6), lambda v: F.round((v + 0.5) * WIDTH / ny, 6)
    part = lambda p, q: (F.col("lv") - F.col(p)) / (F.col(q) - F.col(p))
    cut = lambda p, q, px, py: F.when(inside[p] != inside[q], F.struct(x(px).alias("x"), y(py).alias("y")))
    low, right, top, left = cut("a", "b", F.col("i") + part("a", "b"), F.col("j")), cut("b", "c", F.col("i") + 1, F.col("j") + part("b", "c")), cut("d", "c", F.col("i") + part("d", "c"), F.col("j") + 1), cut("a", "d", F.col("i"), F.col("j") + part("a", "d"))
    segment = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    each = each.withColumns({"low": low, "right": right, "top": top, "left": left})
    crossed = F.array_compact(F.array("low", "right", "top", "left"))
    four, corners_apart = F.size(crossed) == 4, inside["a"] == (F.col("a") + F.col("b") + F.col("c") + F.col("d") >= 4 * F.col("lv"))
    two = F.when(corners_apart, F.array(segment(F.col("low"), F.col("right")), segment(F.col("top"), F.col("left")))).otherwise(F.array(segment(F.col("low"), F.col("left")), segment(F.col("right"), F.col("top"))))
    lines = each.withColumn("s", F.explode(F.when(four, two).otherwise(F.array(segment(crossed[0], crossed[1])))))
    return lines.select(CLIP, "team", "level", (F.col("lv") / unit).alias("at"), *(F.col(f"s.{e}.{c}").alias(f"{c}{n}") for n, e in ((1, "p"), (2, "q")) for c in "xy"))


def team_counts(log: DataFrame) -> DataFrame:
    return log.filter((F.col("class_name") == PERSON) & F.col("team").isNotNull()).groupBy(CLIP, "team").agg(F.count("*").alias("n"))


def ball_coverage(log: DataFrame) -> DataFrame:
    """Ball rows really detected against frames; rows count, not distinct frames."""
    return log.groupBy(CLIP).agg(F.count_if((F.col("class_name") == BALL) & ~F.col("is_predicted")).alias("real"), F.count_if(F.col("class_name") == BALL).alias("balls"), (F.max("frame") + 1).alias("frames"))


#: Sentences of the warnings' codes, with the numbers that they tell.
SENTENCES = {
    "teams_not_separated": "Fewer than two teams were told apart, so nothing that goes by team can be relied on.",
    "team_split_lopsided": "The smaller team has %.0f percent of the labelled rows; players may have been given to the wrong side.",
    "no_ball": "The ball was never seen: there is no ball track and no pass.",
    "ball_rarely_detected": "The ball was really seen in %.0f percent of the frames only, so passes and positions of the ball are doubtful.",
    "calibration_error": "Calibration points miss their places by %.2f m on average; more points, further apart, would help.",
}


def quality_messages(log: DataFrame, mean_error_m: float = 0.0, **limits: float) -> DataFrame:
    """``quality_checks`` with a sentence for each code, in the same order."""
    teams = team_counts(log).groupBy(CLIP).agg((100 * F.min("n") / F.sum("n")).alias("least"))
    seen = ball_coverage(log).select(CLIP, (100 * F.col("real") / F.col("frames")).alias("seen"))
    told = quality_checks(log, mean_error_m, **limits).join(teams, CLIP, "left").join(seen, CLIP, "left")
    number = {"team_split_lopsided": F.col("least"), "ball_rarely_detected": F.col("seen"), "calibration_error": F.lit(float(mean_error_m))}

    def sentence(code):
        out = F.lit(None).cast("string")
        for name, text in SENTENCES.items():
            out = F.when(code == name, F.format_string(text, number[name]) if name in number else F.lit(text)).otherwise(out)
        return out

    return told.select(CLIP, "warnings", F.transform("warnings", sentence).alias("messages"))


def quality_checks(log: DataFrame, mean_error_m: float = 0.0, min_minority: float = 0.15, min_ball: float = 0.15, max_error: float = 1.0) -> DataFrame:
    """The warnings of each clip, as codes in a fixed order."""
    teams = team_counts(log).groupBy(CLIP).agg(F.count("*").alias("teams"), F.min("n").alias("least"), F.sum("n").alias("all"))
    c = ball_coverage(log).join(teams, CLIP, "left")
    codes = [
        F.when(F.coalesce("teams", F.lit(0)) < 2, "teams_not_separated").when(F.col("least") / F.col("all") < min_minority, "team_split_lopsided"),
        F.when(F.col("balls") == 0, "no_ball").when(F.col("real") / F.col("frames") < min_ball, "ball_rarely_detected"),
        F.when(F.lit(mean_error_m) > max_error, "calibration_error"),
    ]
    return c.select(CLIP, F.array_compact(F.array(*codes)).alias("warnings"))
