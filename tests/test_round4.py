"""Findings of round 3."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from test_queries import canon

import __spark_entry__ as entry
from strandlight.operators import hmm, signals, traces
from strandlight.sources import adapters as ad
from strandlight.sources import genome as g


def _files(root, texts):
    root.mkdir()
    for i, t in enumerate(texts):
        (root / f"part-{i:05d}.txt").write_text(t)
    return str(root)


def test_lines_of_many_files_are_numbered_in_file_order(spark, tmp_path):
    # the largest file is the last one: Spark deals splits to partitions by size
    n = [2, 40, 5, 400]
    at = [sum(n[:i]) for i in range(len(n))]
    m = _files(tmp_path / "m", ["".join(f"{at[i] + k}\t0.5\n" for k in range(c)) for i, c in enumerate(n)])
    r = _files(tmp_path / "r", ["".join(f"chr1\t{at[i] + k}\t{at[i] + k + 1}\t+\n" for k in range(c)) for i, c in enumerate(n)])
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")  # the last file is split
    try:
        rows = g.read_matrix_tab(spark, m).filter("bin = 0").collect()
        assert len(rows) == sum(n) and all(x["region_id"] == x["value"] for x in rows)
        rows = g.read_regions(spark, r).collect()
        assert len(rows) == sum(n) and all(x["region_id"] == x["start"] for x in rows)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_curve_numbers_longer_than_three_digits_match_the_sql(spark, tmp_path):
    users = [5, 42, 999, 1006, 123456]
    rows = [(u, i) for i, u in enumerate(users * 12)]
    spark.createDataFrame(rows, "user_id long, event_id long").coalesce(1).write.parquet(str(tmp_path / "e"))
    (tmp_path / "events.parquet").symlink_to(next((tmp_path / "e").glob("*.parquet")))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = canon(entry.queries()["B28_curve_keys"](spark, str(tmp_path)).toPandas())
    pd.testing.assert_frame_equal(got, canon(con.execute(entry.oracle_sql()["B28_curve_keys"]).df()), check_dtype=False)
    assert set(got["curve"]) == {"05", "42", "999", "100", "123"}


def _moved(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    return [p for p in plan.split("\n") if "Exchange hashpartitioning" in p]


def test_a_regions_overlaps_do_not_travel(spark):
    track = spark.range(300_000).selectExpr("'chr1' AS chrom", "id * 10 AS start", "id * 10 + 10 AS end", "id % 7 / 2 AS value")
    spots = [("a", "+", "chr1", 1000), ("a", "+", "chr1", 1000), ("a", "-", "chr1", 1000), ("b", "-", "chr1", 40_960), ("c", "+", "chr9", 50), ("d", "+", None, 50)]
    regions = spark.createDataFrame(spots, "region_id string, strand string, chrom string, center long")
    m = signals.region_matrix(regions, track, 100, 100, 50)
    assert len(_moved(m)) == 3  # regions (once for copies), regions and track for the join
    got = sorted((r["region_id"], r["bin"], r["value"] is None) for r in m.collect())
    assert got == sorted((s[0], b, s[2] != "chr1") for s in spots for b in range(4))
    left, right = (sorted(r["value"] for r in m.filter(f"region_id = 'b' AND bin = {b}").collect()) for b in (0, 3))
    assert left == [sum(i % 7 / 2 for i in range(4101, 4106)) / 5] and right == [sum(i % 7 / 2 for i in range(4086, 4091)) / 5]


@pytest.mark.parametrize("batch", [3, 10_000])
def test_chains_of_many_traces_at_once(spark, batch):
    rng = np.random.default_rng(0)
    rows = [(t, b, rng.normal(size=4).tolist()) for t in range(40) for b in range(1 + t % 5 * 3)]
    mats = spark.createDataFrame(rows, "trace_id long, blk long, mat array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for schema, one, many in (
            ("a_in array<double>, b_out array<double>, ll double", hmm._chain_sum, hmm._chain_sum_many),
            ("z_prev long, z_end long", hmm._chain_max, hmm._chain_max_many),
        ):
            schema = f"trace_id long, blk long, {schema}"
            quick = traces.scan_blocks(mats, ["trace_id"], schema, one(2, hmm.KEY), many=many(2, hmm.KEY))
            assert "FlatMapGroupsInPandas" not in quick._jdf.queryExecution().toString()
            got, want = (d.orderBy("trace_id", "blk").collect() for d in (quick, traces.scan_blocks(mats, ["trace_id"], schema, one(2, hmm.KEY))))
            assert len(got) == len(rows)
            for g, w in zip(got, want):
                for x, y in zip(g, w):
                    np.testing.assert_allclose(x, y, rtol=1e-12)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_task_is_called_once_a_trace(spark, sf):
    blocks = hmm.blocks_of(ad.traces(spark, sf), size=8)
    plan = hmm.log_likelihood(blocks, hmm.Model.of([1.0], [[1.0]], [5.0], [9.0]))._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan


def test_samples_are_numbered_alike_in_windows_and_chunks(spark, sf, monkeypatch):
    tr = ad.traces(spark, sf)
    cols = ["trace_id", "ev", "idx", "n_rows"]
    whole = traces.indexed(tr).select(cols)
    monkeypatch.setattr(traces, "WHOLE_ROWS", 0)
    assert sorted(whole.collect()) == sorted(traces.indexed(tr).select(cols).collect())
