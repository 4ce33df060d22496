"""Readers that feed operators, loud failures instead of silent drops, skewed values, shipping to workers."""

import itertools
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlight.functions import tails
from strandlight.operators import binding, hmm, intervals, lookups, signals, traces, unzip
from strandlight.session import cut_lineage, scratch
from strandlight.sources import genome, traces as trace_files

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def trace_root(tmp_path_factory):
    """Two conditions, one nested, with a file of the same name each."""
    root = tmp_path_factory.mktemp("formatted")
    r = np.random.default_rng(0)
    for cond, level in (("alpha", 5.0), ("beta/inner", 9.0)):
        (root / cond).mkdir(parents=True)
        for name in ("tr1", "tr2"):
            state = (np.arange(400) // 40) % 2
            rows = [f"{i / 100},{level + 3 * s + r.normal() * 0.2}" for i, s in enumerate(state)]
            (root / cond / f"{name}.csv").write_text("time (seconds),force (pN)\n" + "\n".join(rows) + "\n")
    return str(root)


def test_traces_of_equal_names_stay_apart(spark, trace_root):
    t = trace_files.read_traces(spark, trace_root)
    got = {(r["condition"], r["trace_id"]): r["n"] for r in t.groupBy("condition", "trace_id").agg(F.count("*").alias("n")).collect()}
    assert got == {(c, f"{c}/{f}"): 400 for c in ("alpha", "beta/inner") for f in ("tr1", "tr2")}
    rows = t.filter("trace_id = 'alpha/tr1'").orderBy("ev").select("t").collect()
    assert [r["t"] for r in rows] == [i / 100 for i in range(400)]


def test_trace_files_feed_the_operators(spark, trace_root):
    t = trace_files.read_traces(spark, trace_root)
    flat = traces.drift_correct(t, 50, 12.0)
    assert flat.select("trace_id").distinct().count() == 4 and flat.count() == 1600
    m, _ = hmm.hmm_fit(t.filter("condition = 'alpha'"), 2, max_iter=20)
    d = hmm.hmm_decode(t.filter("condition = 'alpha'"), m.ordered())
    dwell = traces.dwell_next(d).groupBy("trace_id").count().collect()
    assert len(dwell) == 2 and all(7 <= r["count"] <= 12 for r in dwell)


def test_trace_files_with_another_header_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time (seconds),force (pN)\n0,1\n")
    (tmp_path / "b.csv").write_text("force (pN),time (seconds)\n1,0\n")
    with pytest.raises(Exception, match="header"):
        trace_files.read_traces(spark, str(tmp_path)).collect()


def test_worker_functions_run_from_any_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
from strandlight.session import local_session
s = local_session(2, "elsewhere")
e.entry(s)
from pyspark.sql import functions as F
from strandlight.functions.tails import pearson_p
print("ROWS", s.range(3).select(pearson_p(F.lit(0.5), F.lit(10)).alias("p")).filter("p > 0").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 3" in out.stdout, out.stderr[-2000:]


def test_track_with_a_bad_line_fails(spark, tmp_path):
    p = tmp_path / "a.bedgraph"
    p.write_text("track type=bedGraph\n#c\nbrowser position\nchr1\t0\t10\t1.5\n")
    assert genome.read_track(spark, str(p)).collect()[0]["value"] == 1.5
    p.write_text("chr1\t0\t10\t1.5\nchr1\tx\t10\t1\n")
    with pytest.raises(Exception):
        genome.read_track(spark, str(p)).collect()


def test_curves_without_baseline_stay_and_without_calibration_fail(spark):
    c = spark.createDataFrame([("1",), ("2",)], "curve string")
    w = spark.createDataFrame([("1",)], "`9` string")
    assert {(r["curve"], r["baseline_curve"]) for r in lookups.attach_baseline(c, w).collect()} == {("1", "9"), ("2", None)}
    c = spark.createDataFrame([("d", 1), ("d", 2)], "date string, curve long")
    k = spark.createDataFrame([("d", 1, "1x", 0.1), ("d", 1, "2x", 0.2)], "date string, curve long, channel string, kappa double")
    assert lookups.attach_calibration(c.filter("curve = 1"), k).count() == 1
    with pytest.raises(Exception, match="no calibration"):
        lookups.attach_calibration(c, k).collect()


def test_too_many_tiles_raise():
    assert binding.bit_of(-19) == 59
    with pytest.raises(ValueError):
        binding.bit_of(-20)


def test_exact_rank_sum_by_enumeration():
    for n1, n2 in ((2, 3), (4, 3), (5, 5)):
        us = [sum(x) - n1 * (n1 + 1) // 2 for x in itertools.combinations(range(1, n1 + n2 + 1), n1)]
        for u in range(n1 * n2 + 1):
            want = min(1.0, 2 * sum(v >= max(u, n1 * n2 - u) for v in us) / len(us))
            assert abs(tails.rank_sum_exact(u, n1, n2) - want) < 1e-12
    assert 0 < tails.rank_sum_exact(300_000, 8, 100_000) < 1


def test_chunks_of_skewed_values_are_even(spark):
    d = spark.range(60_000).select(F.exp(3 * F.randn(7)).alias("v"), F.pow(F.rand(8), 6).alias("u"))
    for c in ("v", "u"):
        n = [r["count"] for r in signals.value_chunks(d, c, rows=2_000).groupBy("_chunk").count().collect()]
        assert len(n) >= 20 and max(n) < 4 * 2_000
    e = cut_lineage(d.select("v"))
    got = signals.average_ranks(e, "v", rows=2_000).orderBy("v").select("rank").toPandas()["rank"]
    assert (got.to_numpy() == np.arange(1, 60_001)).all()


def test_one_long_interval_does_not_widen_the_bins(spark):
    a = spark.createDataFrame([("c", 0, 10_000_000, 0)] + [("c", i * 50, i * 50 + 5, i + 1) for i in range(2_000)], "chrom string, start long, end long, i long")
    b = spark.createDataFrame([("c", 103, 104), ("c", 9_999_999, 10_000_000)], "chrom string, start long, end long")
    assert sorted(r["i"] for r in intervals.overlap_semi(a, b).collect()) == [0, 3]


def test_first_valley_added(spark):
    c = spark.createDataFrame([(k, i, i * 1.0, float(v)) for k in (1, 2) for i, v in enumerate([5, 1, 6, 2, 7, 0, 8][: 7 if k == 1 else 3])], "trace_id long, ev long, t double, f double")
    e = unzip.block_extrema(c, "f", 2, "-", ["trace_id"])
    n = {r["trace_id"]: r["count"] for r in unzip.first_valley(e, c, "f", 3, ["trace_id"]).groupBy("trace_id").count().collect()}
    assert n == {1: 3, 2: 2}


def test_matrix_and_regions_of_other_length_fail(spark, tmp_path):
    (tmp_path / "m").write_text("#c\n1\tx\t2\n\n1,5\t3\n")
    (tmp_path / "r").write_text("chr1\t0\t5\ta\n")
    m, r = genome.read_matrix_tab(spark, str(tmp_path / "m")), genome.read_regions(spark, str(tmp_path / "r"))
    assert [tuple(x) for x in m.orderBy("region_id", "bin").collect()] == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0)]
    assert r.collect()[0]["strand"] == "+"
    with pytest.raises(ValueError):
        genome.matrix_with_regions(m, r)


def test_scratch_tables_are_removed(spark):
    with scratch(spark):
        d = cut_lineage(spark.range(5))
        path = d.inputFiles()[0].replace("file://", "")
        assert d.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)


def test_relative_stop_rule_and_unlabelled_samples(spark, trace_root):
    t = trace_files.read_traces(spark, trace_root).filter("condition = 'alpha'")
    _, long = hmm.hmm_fit(t, 2, tol=-1e9, max_iter=8)
    _, short = hmm.hmm_fit(t, 2, max_iter=8, rel_tol=0.5)
    assert len(short) < len(long) == 8
    m = {"low": hmm.Model.of(np.array([1.0]), np.ones((1, 1)), np.array([5.0]), np.array([1.0])), "high": hmm.Model.of(np.array([1.0]), np.ones((1, 1)), np.array([8.0]), np.array([1.0]))}
    gaps = t.withColumn("signal", F.when(F.col("ev") % 97 == 0, F.lit(None)).otherwise(F.col("signal")))
    a = hmm.annotate_regimes(gaps, m, "low", win=10, step=20, delta=1.0, min_windows=1)
    n = {r["regime"]: r["count"] for r in a.groupBy("regime").count().collect()}
    assert sum(n.values()) == 800 and n[None] == gaps.filter("signal IS NULL").count() and n["high"] > 100
