"""Hand-computed rows for the quirks, and property checks against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlight.functions import calls as fc
from strandlight.functions import fits, tails
from strandlight.operators import binding as bd
from strandlight.operators import intervals as iv
from strandlight.operators import signals as sg
from strandlight.operators import stats as st
from strandlight.operators import traces as tr
from strandlight.ordered import centred_mean, chunk_by, value_chunks, with_index


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_bins_status_and_positions(spark):
    d = spark.createDataFrame([(i, v) for i, v in enumerate([-16, -15, -1, 0, 17, 18])], "i int, rel_pos int")
    assert [r[1] for r in rows(d.select("i", fc.zf_bin("rel_pos")), "i")] == [0, 1, 5, 6, 11, 12]
    s = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 0.99, -1.0, -0.99])], "i int, llr double")
    assert [r[1] for r in rows(s.select("i", fc.call_status("llr")), "i")] == ["M", "N", "U", "N"]
    k = spark.createDataFrame([(100, "AGMTC"), (100, "AGTC")], "start int, kmer string")
    assert [r["call_pos"] for r in fc.realign_c_pos(k).orderBy("kmer").collect()] == [100, 98]
    c = spark.createDataFrame([(i, v) for i, v in enumerate([-10, -9, -5, 0, 5, 10])], "i int, rel_pos int")
    assert [r[1] for r in rows(c.select("i", fc.pos_bin_rc("rel_pos", 5, 10)), "i")] == [None, -10, -10, -5, 0, 5]
    w = spark.createDataFrame([(50,)], "center int")
    assert fc.window_at(w, "center", 65).select("start", "end").first() == (0, 115)


def test_overlap_join_equals_brute_force(spark):
    rnd = random.Random(3)
    mk = lambda n: [("chr" + str(rnd.randint(1, 2)), (s := rnd.randint(0, 900)), s + rnd.randint(1, 90), i) for i in range(n)]
    a, b = mk(120), mk(80)
    A, B = (spark.createDataFrame(x, "chrom string, start long, end long, id int") for x in (a, b))
    want = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and x[2] > y[1])
    for kw in (dict(bin_size=64), dict(bin_size=64, a_max_len=90)):
        assert rows(iv.overlap_join(A, B, **kw).select("a_id", "b_id"), "a_id", "b_id") == want
    semi = rows(iv.overlap_semi(A, B, bin_size=64).select("id"), "id")
    assert semi == sorted({(i,) for i, _ in want})
    touch = spark.createDataFrame([("c", 0, 10), ("c", 0, 11)], "chrom string, start long, end long")
    other = spark.createDataFrame([("c", 10, 20)], "chrom string, start long, end long")
    assert iv.overlap_join(touch, other).count() == 1


def test_long_interval_breaks_the_bound(spark):
    a = spark.createDataFrame([("c", 0, 10)], "chrom string, start long, end long")
    with pytest.raises(Exception, match="longer than 2"):
        iv.overlap_join(a, a, a_max_len=2).collect()


def test_nearest_ties_and_gap_filter(spark):
    m = spark.createDataFrame([("c", 0, 0, "+"), ("c", 0, 10, "+"), ("c", 0, 20, "+"), ("c", 1, 20, "-")], "chrom string, start long, center long, strand string")
    c = spark.createDataFrame([("c", p) for p in (5, 10, 15, 500, -7)], "chrom string, call_pos long")
    got = dict(rows(iv.nearest_join(c, m).select("call_pos", "m_center")))
    assert got == {5: 0, 10: 10, 15: 10, 500: 20, -7: 0}
    assert {r["m_start"] for r in iv.nearest_join(c, m).filter("m_center = 20").collect()} == {1}
    assert set(dict(rows(iv.nearest_join(c, m, 5).select("call_pos", "m_center")))) == {5, 10, 15}
    g = spark.createDataFrame([("c", v) for v in (100, 135, 171, 171, 300)], "chrom string, center long")
    assert rows(iv.drop_close(g).select("center")) == [(300,)]


def calls_frame(spark, spec):
    """spec: {read: [(rel, status), ...]} on one motif."""
    return spark.createDataFrame([("m", r, rel, s) for r, v in spec.items() for rel, s in v],
                                 "motif_id string, read_id string, rel_pos int, status string")


def test_classes_flags_and_masks_agree(spark):
    cm = calls_frame(spark, {
        "st": [(0, "U"), (3, "U")], "dy": [(0, "U"), (3, "M")], "nk": [(0, "M")],
        "nu": [(0, "U"), (30, "U"), (31, "U")], "no": [(0, "U"), (30, "U"), (31, "M")], "far": [(40, "M")]})
    w = bd.Windows(ndr=(20, 60), nuc=(20, 60))
    s = bd.pair_states(bd.pair_masks(cm, w), bd.Filters(exclude_up=True, exclude_down=True))
    assert {r["read_id"] for r in s.filter("nuc").collect()} == {"nu"}
    cls = dict(rows(bd.pair_class(bd.binding_table(cm).unionByName(bd.window_bins(cm, w))).select("read_id", "cls")))
    assert cls == {"st": "static", "dy": "dynamic", "nk": "naked", "nu": "static", "no": "static", "far": "missing"}
    long = {(r["read_id"], r["zf"], r["bound"]) for r in bd.binding_table(cm).collect() if r["read_id"] != "nu"}
    fin = {(r["read_id"], r["zf"], r["bound"]) for r in bd.final_rows(s, bd.Windows()).collect()}
    assert fin == long
    two = {(r["motif_id"], r["read_id"]) for r in bd.pair_masks(calls_frame(spark, {"a": [(0, "U"), (1, "M")], "b": [(0, "U")]}), min_calls=2).collect()}
    assert two == {("m", "a")}


def test_rolling_mean_even_window_and_prefix_sums(spark):
    d = spark.createDataFrame([(1, float(i), i) for i in range(1, 8)], "trace_id int, t double, ev int").withColumn("signal", F.col("t"))
    i = with_index(chunk_by(d, "t", 3), ["trace_id"], ["t"])
    got = [r["m"] for r in centred_mean(i, ["trace_id"], "idx", "signal", 4, "m").orderBy("idx").collect()]
    assert got == [1.5, 2, 2.5, 3.5, 4.5, 5.5, 6]
    rng = np.random.default_rng(0)
    x = pd.Series(rng.normal(size=500))
    e = spark.createDataFrame(pd.DataFrame({"trace_id": 1, "t": np.arange(500.0), "ev": range(500), "signal": x}))
    i = with_index(chunk_by(e, "t", 37), ["trace_id"], ["t"])
    got = [r["m"] for r in centred_mean(i, ["trace_id"], "idx", "signal", 33, "m").orderBy("idx").collect()]
    np.testing.assert_allclose(got, x.rolling(33, center=True, min_periods=1).mean(), atol=1e-9)


def test_downsample_anchor_and_dwells(spark):
    d = spark.createDataFrame([(1, t, i, float(i + 1)) for i, t in enumerate([0.0032, 0.0049, 0.008, 0.0101])], "trace_id int, t double, ev int, signal double")
    got = rows(tr.downsample(d, 5000).select("bucket", "signal"), "bucket")
    assert got == [(0, 2.0), (1, 4.0)]
    s = spark.createDataFrame([(1, 0.0, 0, "A"), (1, 1.0, 1, "A"), (1, 2.0, 2, "B")], "trace_id int, t double, ev int, state string")
    assert rows(tr.dwell_next(s).select("state", "dwell"), "state") == [("A", 2.0), ("B", 0.0)]
    assert rows(tr.dwell_last(s).select("state", "dwell"), "state") == [("A", 1.0)]


def test_hysteresis_threshold_and_min_run(spark):
    w = spark.createDataFrame([(1, 0, 10.0, 0.0), (1, 1, 0.0, 7.9), (1, 2, 0.0, 8.0), (1, 3, 5.0, 0.0)], "trace_id int, w long, a double, b double")
    for block in (1, 2, 100):
        assert [r[1] for r in rows(tr.hysteresis(w, ["a", "b"], 8.0, block=block).select("w", "label"), "w")] == ["a", "a", "b", "b"]
    lab = "aabbbacccc"
    d = spark.createDataFrame([(1, i, c) for i, c in enumerate(lab)], "trace_id int, w long, label string")
    assert rows(tr.min_run(d, 3).select("w_first", "w_last", "label"), "w_first") == [(0, 5, "b"), (6, 9, "c")]


def test_quantiles(spark):
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1, 2, 3, 4, 5, 6, 7, 8, 9])], "i int, v double")
    assert [r[1] for r in rows(sg.quantile_cut(d, "v", 4).select("i", "quantile"), "i")] == [1, 1, 1, 2, 2, 3, 3, 4, 4, 4]
    assert [r[1] for r in rows(sg.quantile_rank(d, "v", 4).select("i", "quantile"), "i")] == [1, 1, 2, 2, 2, 3, 3, 4, 4, 4]


def test_bh_and_tails(spark):
    d = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03])], "i int, p double")
    assert [round(r[1], 9) for r in rows(st.bh_adjust(d, "p").select("i", "p_adj"), "i")] == [0.03, 0.04, 0.04]
    assert tails.gamma_q(1.5, 1.5) == pytest.approx(0.3916251762710876)
    assert tails.gamma_q(0.5, 3.841458820694124 / 2) == pytest.approx(0.05)
    assert tails.pearson_p_value(0.5, 4) == pytest.approx(0.5)
    assert tails.signed_rank_exact(0, 5) == pytest.approx(2 / 32)
    assert tails.rank_sum_exact(0, 2, 3) == pytest.approx(0.2)


def test_hodges_lehmann_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    x, y = np.round(rng.normal(0, 1, 60), 2), np.round(rng.normal(0.4, 1, 50), 2)
    df = spark.createDataFrame([("k", 1, float(v)) for v in x] + [("k", 2, float(v)) for v in y], "key string, side int, v double")
    got = st.hodges_lehmann(df, "key", "side", "v", enough=100).first()
    d = np.sort((y[None, :] - x[:, None]).ravel())
    assert got["hl"] == pytest.approx(np.median(d))
    m = st.mann_whitney(df, ["key"], "side", "v").first()
    assert m["u1"] + m["u2"] == 60 * 50
    k = int(np.floor(60 * 50 / 2 - st.Z95 * m["sd_u"]))
    assert (got["hl_low"], got["hl_high"]) == pytest.approx((d[k], d[len(d) - k - 1]))


@pytest.mark.parametrize("w", [1, 7])
def test_region_bins_equal_bases(spark, w):
    """Bins against a plain array of bases: overlapping, touching and missing intervals, both strands, repeated regions."""
    rng = np.random.default_rng(8)
    iv_ = [(int(a), int(a + n), float(v)) for a, n, v in zip(rng.integers(0, 900, 60), rng.integers(1, 60, 60), np.round(rng.normal(0, 3, 60), 3))]
    iv_ += [(1000, 1010, float("nan")), (1010, 1020, float("inf")), (1020, 1030, 1e12), (1030, 1400, 1.0)]
    track = spark.createDataFrame([("c", a, b, v) for a, b, v in iv_] + [("c", 5, 50, None), ("d", 0, 9, 1.0)], "chrom string, start long, end long, value double")
    spots = [("r1", "+", "c", 300), ("r2", "-", "c", 305), ("r3", "+", "c", 5000), ("r4", "-", "e", 10), ("r5", "+", "c", 1015), ("r5", "+", "c", 1015), ("r6", "-", "c", -20), ("r6", "-", "c", 40)]
    got = sg.region_matrix(spark.createDataFrame(spots, "region_id string, strand string, chrom string, center long"), track, 50, 48, w).collect()
    n = -(-98 // w)
    assert len(got) == len(spots) * n
    want = []
    for r, strand, chrom, c in spots:
        for k in range(n):
            s, m = 0.0, 0
            for p in range(c - 50 + k * w, min(c + 48, c - 50 + (k + 1) * w)):
                vs = [v for a, b, v in iv_ if chrom == "c" and a <= p < b]
                s, m = s + sum(vs), m + len(vs)
            want.append((r, n - 1 - k if strand == "-" else k, s / m if m else None))
    order = lambda t: (t[0], t[1], t[2] is None, str(t[2]) if t[2] is None or t[2] != t[2] else "", t[2] or 0)
    for g, x in zip(sorted(map(tuple, got), key=order), sorted(want, key=order)):
        assert g[:2] == x[:2] and (g[2] is None) == (x[2] is None)
        if x[2] is not None:
            assert g[2] == pytest.approx(x[2], rel=1e-9, abs=1e-9, nan_ok=True)


def test_binding_tables_share_one_scan(spark, sf):
    """Every table of the recipe reads the pair table, none the calls again."""
    from strandlight.plans import recipes as rc
    from strandlight.sources import adapters as ad

    out = rc.r1b(ad.calls_motif(spark, sf))
    assert len(out) == 12
    for name, df in out.items():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "lineitem" not in plan and "l_orderkey" not in plan and "sites" in df._jdf.queryExecution().analyzed().toString(), name


@pytest.mark.parametrize("rows", [40, 50_000])
def test_nearest_index_of_crowded_values(spark, monkeypatch, rows):
    """Dense, equal and far values, a key that holds most rows, keys without y, null values, repeated x."""
    monkeypatch.setattr(iv, "value_chunks", lambda d, v: value_chunks(d, v, rows))
    rng = np.random.default_rng(9)
    y = [("a", round(float(v), 3), int(i)) for i, v in enumerate(np.r_[rng.normal(0, 1e-2, 150), rng.normal(1e6, 1, 50), 0.5, 0.5])]
    y += [("b", 1.0, 7), ("b", 3.0, 2), ("b", None, 0)]
    x = [("a", i, round(float(v), 3)) for i, v in enumerate(np.r_[rng.normal(0, 2e-2, 200), rng.normal(5e5, 3e5, 60)])]
    x += [("b", 1000, 2.0), ("b", 1001, -50.0), ("b", 1002, None), ("b", 1000, 2.0), ("c", 1003, 1.0)]
    got = iv.nearest_index(spark.createDataFrame(x, "key string, ev long, value double"), spark.createDataFrame(y, "key string, value double, idx long"))
    want = []
    for k, ev, v in x:
        at = [(abs(v - w), i) for kk, w, i in y if kk == k and w is not None] if v is not None else []
        if at:
            want.append((k, ev, v, min(at)[1]))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_close_peaks_merge_between_gaps(spark):
    """Equal to one sweep over the whole curve, from right to left."""
    from strandlight.operators import unzip as uz

    rng = np.random.default_rng(10)
    rows = []
    for c in range(3):
        t = np.cumsum(rng.choice([0.3, 0.9, 1.9, 2.0, 7.0], 120))
        rows += [(c, i, i * 10, float(t[i]), float(v)) for i, v in enumerate(np.round(rng.normal(0, 1, 120), 1))]
    df = spark.createDataFrame(rows, "curve int, block long, idx long, t double, value double")
    for sign in "+-":
        want = set()
        for c in range(3):
            own = [r for r in rows if r[0] == c]
            cur = own[-1]
            for r in reversed(own[:-1]):
                if cur[3] - r[3] >= 2.0:
                    want.add(cur)
                    cur = r
                elif (cur[4] > r[4]) if sign == "-" else (cur[4] < r[4]):
                    cur = r
            want.add(cur)
        assert {tuple(r) for r in uz.merge_close(df, sign, ["curve"], chunk_s=30.0).collect()} == want


def test_model_scores_report_rows_without_spread(spark):
    """Rows that cannot be scored change nothing but their count."""
    m = st.two_barrier([0.2, 0.5, 0.3], 0.7, 0.5)
    kind = "force double, force_se double, p_obs double, p_se double"
    good = [(12.0, 0.1, 0.3, 0.05), (12.5, 0.2, 0.2, 0.1), (11.0, 0.1, 0.5, 0.2)]
    bad = [(12.0, 0.1, 0.3, 0.0), (12.0, None, 0.3, 0.1), (None, 0.1, 0.3, 0.1), (12.0, 0.1, None, 0.1), (12.0, 0.1, 0.3, None)]
    a, b = (sorted(st.score_models(spark.createDataFrame(t, kind), m, 0.2).collect(), key=lambda r: r["model"]) for t in (good, good + bad))
    assert [r["n_left_out"] for r in a] == [0, 0] and [r["n_left_out"] for r in b] == [5, 5]
    for x, y in zip(a, b):
        assert [x[c] for c in ("model", "dof")] == [y[c] for c in ("model", "dof")]
        assert [x[c] for c in ("chi2", "log_lik", "aic", "bic")] == pytest.approx([y[c] for c in ("chi2", "log_lik", "aic", "bic")])


def _shift(x, y):
    """Median and interval of all y - x from the listed differences."""
    d = np.sort((y[None, :] - x[:, None]).ravel())
    both = np.r_[x, y]
    c = np.unique(both, return_counts=True)[1].astype(float)
    n = len(both)
    sd = np.sqrt(len(x) * len(y) / 12 * ((n + 1) - ((c**3 - c).sum() / (n * (n - 1)) if n > 1 else 0)))
    k = int(np.floor(len(d) / 2 - st.Z95 * sd))
    return np.median(d), d[max(1, k + 1) - 1], d[min(len(d), len(d) - k) - 1]


def test_hodges_lehmann_of_many_keys(spark):
    """Ten thousand keys in a handful of jobs; sides of one value, missing sides, null values and keys."""
    rng = np.random.default_rng(2)
    data = {k: (np.round(rng.normal(0, 1, rng.integers(1, 6)), 1), np.round(rng.normal(0.5, 1, rng.integers(1, 6)), 1)) for k in range(10_000)}
    p = pd.DataFrame([(k, s + 1, v) for k, two in data.items() for s, vs in enumerate(two) for v in vs], columns=["key", "side", "v"])
    p = pd.concat([p, pd.DataFrame({"key": [20_000, 20_001, 0], "side": [1, 2, 1], "v": [1.0, 2.0, None]})])
    df = spark.createDataFrame(p).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    df = df.union(spark.createDataFrame([(None, 1, 1.0), (None, 2, 1.0)], df.schema))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    got = {r["key"]: (r["hl"], r["hl_low"], r["hl_high"]) for r in st.hodges_lehmann(df, "key", "side", "v").collect()}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before) < 60
    assert set(got) == set(data)
    for k, (x, y) in data.items():
        assert got[k] == pytest.approx(_shift(x, y))


def test_hodges_lehmann_narrows(spark):
    """Brackets of several keys of unlike size narrow to few differences or to one repeated one."""
    rng = np.random.default_rng(3)
    data = {"wide": (rng.normal(0, 1, 300), rng.normal(1, 2, 200)), "ties": (rng.integers(0, 3, 400) * 0.5, rng.integers(0, 4, 300) * 0.5),
            "far": (np.r_[rng.normal(0, 1e-3, 150), 1e6], rng.normal(0, 1e-3, 100)), "one": (np.array([2.0]), np.array([5.0])), "flat": (np.full(90, 1.0), np.full(80, 1.5))}
    df = spark.createDataFrame([(k, s + 1, float(v)) for k, two in data.items() for s, vs in enumerate(two) for v in vs], "key string, side int, v double")
    got = {r["key"]: (r["hl"], r["hl_low"], r["hl_high"]) for r in st.hodges_lehmann(df, "key", "side", "v", fan=8, enough=50).collect()}
    for k, (x, y) in data.items():
        assert got[k] == pytest.approx(_shift(x, y), abs=1e-9)


def test_fits_recover_parameters(spark):
    x = np.linspace(0, 4, 30)
    p = pd.DataFrame({"g": "a", "x": x, "cdf": 1 - np.exp(-1.7 * x), "count": 10, "density": 1.7 * np.exp(-1.7 * x)})
    d = spark.createDataFrame(p)
    assert fits.fit_exp_cdf(d, ["g"]).first()["rate"] == pytest.approx(1.7)
    assert fits.fit_exp_pdf(d, ["g"]).first()["rate"] == pytest.approx(1.7)
    k = np.arange(1, 6.0)
    c = spark.createDataFrame(pd.DataFrame({"g": "a", "k": k, "den_pairs": 10, "frac_dynamic": 0.6 * (1 - np.exp(-0.4 * k))}))
    r = fits.fit_saturation(c, ["g"]).first()
    assert (r["alpha"], r["beta"]) == pytest.approx((0.6, 0.4), abs=1e-6)
