"""The driver contract, and a sample of queries against their SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, compare

PATH = "/root/testdata/sf0.001"
SAMPLE = [
    "c2_point_in_time", "d1_multi_window", "e5_rfm_segments", "d21_winsorize", "i6_monthly_table", "k11_best_per_month",
    "k31_clusters", "h1_month_folds", "h5_stratified_folds", "g10_interactions", "a3_submission_glob",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    return c


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    msg, ok, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], PATH)
    assert ok, msg


@pytest.mark.parametrize("name", ["i6_monthly_table", "k30_spearman_matrix", "d37_below_peer", "h7_forward_tiles", "e6_rank_in_segment"])
def test_query_matches_sql_on_many_ranges(spark, con, ranged, name):
    msg, ok, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], PATH)
    assert ok, msg
