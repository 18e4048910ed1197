"""The entry module, and a few queries against their SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ("src_position_log", "agg_player_scale", "win_clean_ball_track", "agg_pass_edges", "agg_team_compactness", "frm_threshold_search", "win_team_vote", "st_kalman_ball", "jn_click_box", "fn_parse_job_output")


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("events", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
