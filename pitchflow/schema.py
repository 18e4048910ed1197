"""The position log's schema and the pitch's fixed values."""

from pyspark.sql import types as T

POSITION_LOG = T.StructType([
    T.StructField("clip_id", T.StringType()), T.StructField("log_seq", T.LongType()), T.StructField("frame", T.LongType()), T.StructField("track_id", T.LongType()),
    T.StructField("class_name", T.StringType()), T.StructField("team", T.IntegerType()), T.StructField("pixel_x", T.DoubleType()), T.StructField("pixel_y", T.DoubleType()),
    T.StructField("pitch_x", T.DoubleType()), T.StructField("pitch_y", T.DoubleType()), T.StructField("bbox_height", T.DoubleType()), T.StructField("is_predicted", T.BooleanType()),
])

# The pitch in metres, and the parameters that results depend on.
LENGTH, WIDTH = 105.0, 68.0
PENALTY_DEPTH, PENALTY_WIDTH = 16.5, 40.32
SIX_YARD_DEPTH, SIX_YARD_WIDTH = 5.5, 18.32
SPOT, CIRCLE = 11.0, 9.15
BALL, PERSON, REF = "sports ball", "person", "ref"
BALL_MARGIN, TRACK_MARGIN = 10.0, 5.0
RADIUS_M, RADIUS_SCALE, MIN_RUN = 3.0, 0.6, 3
MAX_GAP, MAX_JUMP = 10, 5.0
MIN_TRACK_FRAMES, GK_REACH, OUTFIELD, MIN_PHASE_FRAMES = 5, 20.0, 10, 50
LINE_GAPS = (4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 12.0)
SHAPES = ("4-4-2", "4-3-3", "4-2-3-1", "4-1-4-1", "4-5-1", "4-1-3-2", "4-3-1-2", "3-5-2", "3-4-3", "3-4-1-2", "5-3-2", "5-4-1", "5-2-3")
VOTES, FADE = 5, 40


# Drawing colours of the two teams, and of players without one.
TEAM_COLORS, UNKNOWN_COLOR = {0: "#e63946", 1: "#457b9d"}, "#999999"
#: The 29 landmarks in metres; a landmark's number is its place in this table.
KEYPOINTS = (
    ("corner_top_left", 0.0, 0.0),
    ("corner_bottom_left", 0.0, 68.0),
    ("corner_top_right", 105.0, 0.0),
    ("corner_bottom_right", 105.0, 68.0),
    ("halfway_top", 52.5, 0.0),
    ("halfway_bottom", 52.5, 68.0),
    ("center_spot", 52.5, 34.0),
    ("center_circle_top", 52.5, 24.85),
    ("center_circle_bottom", 52.5, 43.15),
    ("center_circle_left", 43.35, 34.0),
    ("center_circle_right", 61.65, 34.0),
    ("left_penalty_area_top_left", 0.0, 13.84),
    ("left_penalty_area_top_right", 16.5, 13.84),
    ("left_penalty_area_bottom_left", 0.0, 54.16),
    ("left_penalty_area_bottom_right", 16.5, 54.16),
    ("left_six_yard_top_left", 0.0, 24.84),
    ("left_six_yard_top_right", 5.5, 24.84),
    ("left_six_yard_bottom_left", 0.0, 43.16),
    ("left_six_yard_bottom_right", 5.5, 43.16),
    ("left_penalty_spot", 11.0, 34.0),
    ("right_penalty_area_top_left", 88.5, 13.84),
    ("right_penalty_area_top_right", 105.0, 13.84),
    ("right_penalty_area_bottom_left", 88.5, 54.16),
    ("right_penalty_area_bottom_right", 105.0, 54.16),
    ("right_six_yard_top_left", 99.5, 24.84),
    ("right_six_yard_top_right", 105.0, 24.84),
    ("right_six_yard_bottom_left", 99.5, 43.16),
    ("right_six_yard_bottom_right", 105.0, 43.16),
    ("right_penalty_spot", 94.0, 34.0),
)


def keypoints() -> list[tuple[int, str, float, float]]:
    return [(i, *k) for i, k in enumerate(KEYPOINTS)]
