"""Chains of blocks in several levels, profiles of many sets from one pass, the stored call layout."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlight.functions import calls as fc
from strandlight.operators import hmm, intervals, lookups, profiles, traces
from strandlight.plans import recipes
from strandlight.sources import adapters, layout

TWO = hmm.Model.of([0.7, 0.3], [[0.95, 0.05], [0.1, 0.9]], [0.0, 3.0], [1.0, 1.0])


@pytest.fixture(scope="module")
def tr(spark):
    r = np.random.default_rng(5)
    rows = []
    for tid, n in ((1, 700), (2, 9), (3, 260)):
        s = (np.arange(n) // 30) % 2
        rows += [("c", tid, i / 100, i, float(3 * s[i] + r.normal())) for i in range(n)]
    return spark.createDataFrame(rows, "condition string, trace_id long, t double, ev long, signal double")


def test_levels():
    assert [traces.levels_of(n, 4) for n in (0, 3, 4, 15, 16, 63, 64)] == [1, 1, 2, 2, 3, 3, 4]


def test_sums_of_a_chain_of_many_levels(spark, tr):
    whole, ll = hmm.expectation(hmm.blocks_of(tr, size=1000), TWO, levels=0)
    blocks = hmm.blocks_of(tr, size=7).persist()  # 100 blocks in the longest trace
    n = hmm.chain_levels(blocks, 4)
    assert n == 4
    parts, lp = hmm.expectation(blocks, TWO, levels=n, fan=4)
    np.testing.assert_allclose(parts, whole, rtol=1e-9)
    assert lp == pytest.approx(ll, rel=1e-12)
    flat = hmm.log_likelihood(blocks, TWO, levels=1).toPandas().sort_values("trace_id")["ll"].to_numpy()
    deep = hmm._boundaries(blocks, TWO, hmm.KEY, n, 4).filter("blk = 0").toPandas().sort_values("trace_id")["ll"].to_numpy()
    np.testing.assert_allclose(deep, flat, rtol=1e-12)
    many = hmm.expectation_all(blocks, {"a": (TWO, None), "b": (TWO.ordered(), None)}, levels=n, fan=4)
    np.testing.assert_allclose(many["a"][0], whole, rtol=1e-9)
    assert many["b"][1] == pytest.approx(ll, rel=1e-12)
    blocks.unpersist()


def test_best_path_of_a_chain_of_many_levels(spark, tr):
    def states(**kw):
        return hmm.hmm_decode(tr, TWO, **kw).orderBy("trace_id", "idx").toPandas()["state"].tolist()

    assert states(size=7, fan=4) == states(size=1000)


def test_the_chain_of_one_trace_is_several_groups(spark, tr):
    """No group of any level holds more than ``fan`` rows."""
    seen = []
    blocks = hmm.blocks_of(tr.filter("trace_id = 1"), size=7)
    mats = hmm._transfers(blocks, TWO, hmm.KEY, False)
    run = hmm._chain_sum(2, hmm.KEY)
    out = traces.scan_blocks(
        mats, hmm.KEY, mats.schema.simpleString()[7:-1].replace(":", " ").replace("mat array<double>", "a_in array<double>, b_out array<double>, ll double, rows long"),
        lambda p: run(p).assign(rows=len(p)), hmm._product(hmm.KEY, False), ["a_in", "b_out", "ll"], 4, 4)
    seen = out.toPandas()
    assert len(seen) == 100 and seen["rows"].max() <= 4 and seen["ll"].nunique() == 1


def test_hysteresis_over_many_levels(spark):
    r = np.random.default_rng(3)
    walk = r.normal(size=(300, 3)).cumsum(axis=0) * 4
    w = spark.createDataFrame([("c", 1, i, *map(float, v)) for i, v in enumerate(walk)], "condition string, trace_id long, w long, a double, b double, c double")
    one = traces.hysteresis(w, ["a", "b", "c"]).orderBy("w").toPandas()["label"].tolist()
    many = traces.hysteresis(w, ["a", "b", "c"], block=5, fan=3).orderBy("w").toPandas()["label"].tolist()
    assert one == many and len(set(one)) > 1


# ---------------------------------------------------------------- profiles


def _scans(df, name):
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_sets_share_one_pass(spark, sf):
    calls, m = adapters.calls(spark, sf), adapters.motifs(spark, sf)
    sets = {"plus": m.filter("strand = '+'"), "low": m.filter("center < 2500"), "none": m.limit(0)}
    masks, names = profiles.set_masks({n: fc.window_at(d, "center", 200, 0) for n, d in sets.items()})
    j = intervals.overlap_join(calls, masks, a_max_len=2)
    assert _scans(j, "l_linenumber") > 0 and j.columns.count("b_in_set") == 1
    got = recipes.s1b(calls, sets, 200).drop("smooth").toPandas()
    want = []
    for name, d in sets.items():
        cm = recipes.with_motif(calls, fc.window_at(d, "center", 200, 0))
        want.append(profiles.metaprofile_macro(cm, None, 200).withColumn("label", F.lit(name)).toPandas())
    by, cols = ["label", "rel_bin"], ["label", "rel_bin", "mean", "sd", "n_motifs"]
    want = pd.concat(want)
    pd.testing.assert_frame_equal(got.sort_values(by)[cols].reset_index(drop=True), want.sort_values(by)[cols].reset_index(drop=True), check_dtype=False)
    assert set(got["label"]) == {"plus", "low"}


def test_class_profiles_equal_the_two_step_way(spark, sf):
    calls, m = adapters.calls(spark, sf), adapters.motifs(spark, sf)
    cm = recipes.with_nearest(calls, m, 1500)
    s = recipes.bd.pair_states(recipes.bd.pair_masks(cm, recipes.NARROW), recipes.bd.Filters(exclude_up=True, exclude_down=True))
    want = lookups.complete_bins(profiles.metaprofile_labeled(cm, recipes.bd.global_classes(s), 600, 5), 600, 5, ["label"]).toPandas()
    got = recipes.s1e(calls, m).toPandas()
    by = ["label", "rel_bin"]
    pd.testing.assert_frame_equal(got.sort_values(by)[[*by, "frac_u"]].reset_index(drop=True), want.sort_values(by)[[*by, "frac_u"]].reset_index(drop=True))


def test_cells_of_repeated_calls_stay_bounded(spark):
    cm = spark.createDataFrame([("m", "r", "U" if i % 3 else "M", i % 9 - 4) for i in range(3000)], "motif_id string, read_id string, status string, rel_pos long")
    r = profiles.pair_cells(cm, recipes.NARROW, 600, 5).collect()
    assert len(r) == 1 and sorted((c["rel_bin"], c["n"]) for c in r[0]["cells"]) == [(-5, 1335), (0, 1665)]


def test_more_than_62_sets_fail(spark):
    with pytest.raises(ValueError, match="62"):
        profiles.set_masks({str(i): None for i in range(63)})


# ---------------------------------------------------------------- layout

CALLS = "chrom string, start long, end long, call_pos long, read_id string"


@pytest.fixture(scope="module")
def small(spark):
    r = np.random.default_rng(1)
    pos = [int(v) for v in r.integers(1, 9000, 400)] + [4100] * 200  # a crowded bin
    calls = spark.createDataFrame([(f"chr{i % 2 + 1}", p - 1, p + 1, p, f"r{i % 7}") for i, p in enumerate(pos)] + [(None, 5, 6, 5, "x"), ("chr1", None, 3, 2, "y")], CALLS)
    m = [("chr1", 4000, 4200, "+"), ("chr1", 4000, 4200, "+"), ("chr2", 2040, 2060, "-"), ("chr1", 0, 9000, "+"), ("chr3", 1, 5, "+"), (None, 1, 5, "+")]
    return calls, spark.createDataFrame(m, "chrom string, start long, end long, strand string")


def _rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("hot_rows", [10_000, 100])
def test_layout_gives_the_rows_of_the_overlap_join(spark, small, hot_rows):
    calls, motifs = small
    lay = layout.write_calls(calls, 4, 1024, hot_rows=hot_rows)
    assert (lay.hot is not None) == (hot_rows == 100)
    want = _rows(intervals.overlap_join(calls, motifs, a_max_len=2))
    assert _rows(layout.overlap(spark, lay, motifs)) == want and len(want) > 500
    assert _rows(layout.overlap(spark, lay, layout.write_motifs(motifs, lay))) == want
    got = layout.region(spark, lay, "chr1", 4000, 4200)
    assert _rows(got) == _rows(lookups.calls_in_region(calls.filter("start IS NOT NULL"), "chr1", 4000, 4200))


def _exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0].count("Exchange hashpartitioning")


def test_layout_moves_only_the_motifs(spark, small, monkeypatch):
    calls, motifs = small
    lay = layout.write_calls(calls, 16, 1024)
    assert _exchanges(layout.overlap(spark, lay, layout.write_motifs(motifs, lay))) == 0
    monkeypatch.setattr(layout, "is_small", lambda df: False)
    assert _exchanges(layout.overlap(spark, lay, motifs)) == 1


def test_layout_of_nothing_and_of_long_calls(spark, small):
    calls, motifs = small
    lay = layout.write_calls(calls.limit(0), 2)
    assert layout.overlap(spark, lay, motifs).count() == 0 and lay.hot is None
    with pytest.raises(Exception, match="interval longer"):
        layout.write_calls(spark.createDataFrame([("chr1", 1, 50, 2, "r")], CALLS), 2)
