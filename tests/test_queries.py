"""Registered queries against DuckDB on the smallest tables (a spread over the modules)."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = ["lineitem", "part", "orders", "events", "embeddings"]
PICK = [
    "A5_read_motifs", "C1_overlap_join", "C4_multi_depth", "C11_nearest_join", "D10_binding_prob", "D15_scatter_stats",
    "D16_read_category_counts", "D17_dynamic_static_by_k", "D20_cond_prob_bound", "P3_metaprofile_labeled",
    "P7_track_stat", "W7_dwell_next", "X2_drift_correct", "X9_occupancy_sd", "S4_bh_adjust", "C22_nearest_index", "W11_top_peaks",
    "A1_layout_overlap", "A1_layout_overlap_stored", "A20_layout_region", "S1B_macro_profile", "S1E_class_profiles",
    "H4_score_windows", "S3_rank_test_values", "R1B_scatter_stats", "R1B_mappability_by_sites", "P10_region_matrix",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype).startswith("str"):
            df[c] = df[c].map(lambda v: None if v is None or v != v else str(v))
        else:
            df[c] = df[c].astype("float64")
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", PICK)
def test_query_matches_sql(spark, sf, duck, name):
    got = canon(entry.queries()[name](spark, sf).toPandas())
    want = canon(duck.execute(entry.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=2e-6)


def test_catalog_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["zf", "n", "mean", "sd", "sem"]
