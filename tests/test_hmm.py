"""Hidden-state models: recovery, monotone likelihood, exhaustive path search, block invariance."""

import itertools

import numpy as np
import pandas as pd
import pytest

from strandlight.operators import hmm

TRUE = hmm.Model.of([0.6, 0.3, 0.1], [[0.95, 0.04, 0.01], [0.05, 0.9, 0.05], [0.02, 0.08, 0.9]], [12.0, 8.0, 3.0], [0.3, 0.4, 0.5])


def simulate(seed, n):
    rng = np.random.default_rng(seed)
    s, a, m, v = TRUE.arrays()
    z = [rng.choice(3, p=s)]
    for _ in range(n - 1):
        z.append(rng.choice(3, p=a[z[-1]]))
    return np.array(z), rng.normal(m[z], np.sqrt(v[z]))


@pytest.fixture(scope="module")
def traces(spark):
    parts, states = [], {}
    for i, n in enumerate([700, 400, 523, 64, 1]):
        z, x = simulate(i, n)
        states[i] = z
        parts.append(pd.DataFrame({"trace_id": i, "t": np.arange(n) / 100.0, "ev": np.arange(n), "signal": x}))
    return spark.createDataFrame(pd.concat(parts)), states, {i: p["signal"].to_numpy() for i, p in enumerate(parts)}


def direct_ll(x, m):
    s, a, mu, v = m.arrays()
    e = -0.5 * (np.log(2 * np.pi * v) + (x[:, None] - mu) ** 2 / v)
    f = np.log(s) + e[0]
    for t in range(1, len(x)):
        f = np.logaddexp.reduce(f[:, None] + np.log(a), axis=0) + e[t]
    return np.logaddexp.reduce(f)


def test_likelihood_does_not_depend_on_blocks(traces):
    tr, _, xs = traces
    for size in (64, 4096):
        got = {r["trace_id"]: r["ll"] for r in hmm.log_likelihood(hmm.blocks_of(tr, size=size), TRUE).collect()}
        for i, x in xs.items():
            assert got[i] == pytest.approx(direct_ll(x, TRUE), abs=1e-6)


def test_expectation_does_not_depend_on_blocks(traces):
    tr, _, _ = traces
    a, la = hmm.expectation(hmm.blocks_of(tr, size=5000), TRUE, chained=False)
    b, lb = hmm.expectation(hmm.blocks_of(tr, size=13), TRUE)
    np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)
    assert la == pytest.approx(lb)
    assert a[9 + 3 : 9 + 6].sum() == pytest.approx(700 + 400 + 523 + 64 + 1)
    assert a[3:12].sum() == pytest.approx(699 + 399 + 522 + 63)


def test_fit_recovers_parameters_and_never_loses_likelihood(traces):
    tr, _, _ = traces
    m, hist = hmm.hmm_fit(tr, 3, tol=1e-2, max_iter=12)
    assert all(b >= a - 1e-6 for a, b in zip(hist, hist[1:]))
    m = m.ordered()
    np.testing.assert_allclose(m.means, TRUE.means, atol=0.15)
    np.testing.assert_allclose(m.vars, TRUE.vars, atol=0.15)


def test_decode_matches_exhaustive_search(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(4):
        x = rng.normal(7, 4, 7)
        rows.append(pd.DataFrame({"trace_id": i, "t": np.arange(7.0), "ev": np.arange(7), "signal": x}))
    df = spark.createDataFrame(pd.concat(rows))
    s, a, mu, v = TRUE.arrays()
    for size in (3, 100):
        got = hmm.hmm_decode(df, TRUE, size=size).orderBy("trace_id", "idx").toPandas()
        for i, p in enumerate(rows):
            x = p["signal"].to_numpy()
            e = -0.5 * (np.log(2 * np.pi * v) + (x[:, None] - mu) ** 2 / v)
            def score(z):
                return np.log(s[z[0]]) + e[0, z[0]] + sum(np.log(a[z[t - 1], z[t]]) + e[t, z[t]] for t in range(1, 7))
            best = max(itertools.product(range(3), repeat=7), key=score)
            assert tuple(got[got.trace_id == i]["state"]) == best


@pytest.mark.parametrize("size", [50, 4096])
def test_models_side_by_side_equal_single_fits(traces, size):
    tr, _, _ = traces
    blocks = hmm.blocks_of(tr, size=size).persist()
    start = {k: hmm.initial_model(tr, k) for k in (1, 2, 3)}
    models, history = hmm.em_all(blocks, {k: (m, None) for k, m in start.items()}, 1e-2, 3)
    for k, m in start.items():
        one, h = hmm.em(blocks, m, 1e-2, 3)
        np.testing.assert_allclose(history[k], h, rtol=1e-9)
        np.testing.assert_allclose(models[k].means, one.means, rtol=1e-7)
        np.testing.assert_allclose(models[k].trans, one.trans, atol=1e-7)
    blocks.unpersist()


def direct_em(seqs, m, rounds):
    """Plain forward-backward EM over whole sequences."""
    for _ in range(rounds):
        s, a, mu, v = m.arrays()
        k = m.k
        s0, xi, w, wx, wxx = np.zeros(k), np.zeros((k, k)), np.zeros(k), np.zeros(k), np.zeros(k)
        for x in seqs:
            e = np.exp(-0.5 * (np.log(2 * np.pi * v) + (x[:, None] - mu) ** 2 / v))
            f, b = np.zeros((len(x), k)), np.ones((len(x), k))
            f[0] = s * e[0]
            f[0] /= f[0].sum()
            for t in range(1, len(x)):
                f[t] = (f[t - 1] @ a) * e[t]
                f[t] /= f[t].sum()
            for t in range(len(x) - 2, -1, -1):
                b[t] = a @ (e[t + 1] * b[t + 1])
                b[t] /= b[t].sum()
            g = f * b
            g /= g.sum(1, keepdims=True)
            for t in range(1, len(x)):
                j = f[t - 1][:, None] * a * (e[t] * b[t])[None]
                xi += j / j.sum()
            s0, w, wx, wxx = s0 + g[0], w + g.sum(0), wx + (g * x[:, None]).sum(0), wxx + (g * x[:, None] ** 2).sum(0)
        m = hmm.maximization(np.concatenate([s0, xi.ravel(), w, wx, wxx]), m)
    return m


def test_held_out_folds_equal_brute_force(traces):
    """Models of the other folds and their likelihood of the fold, by plain recursions over the cut sequences."""
    tr, _, xs = traces
    n, splits = sum(map(len, xs.values())), 4
    out = hmm.hmm_cross_validate(tr, 2, 3, n_splits=splits, tol=-1e9, max_iter=2, size=64)
    wide = [n // splits + (f < n % splits) for f in range(splits)]
    edges = np.cumsum([0, *wide])
    place, at = {}, 0
    for i in sorted(xs):
        place[i] = np.searchsorted(edges, np.arange(at, at + len(xs[i])), side="right") - 1
        at += len(xs[i])

    def cut(fold, inside):
        seqs = []
        for i, x in xs.items():
            keep = (place[i] == fold) == inside
            runs = np.flatnonzero(np.diff(np.r_[False, keep, False].astype(int)))
            seqs += [x[a:b] for a, b in zip(runs[::2], runs[1::2])]
        return seqs

    assert [(k, f, m) for k, f, m, _ in out["folds"]] == [(k, f, wide[f]) for k in (2, 3) for f in range(splits)]
    for k, f, _, ll in out["folds"]:
        m = direct_em(cut(f, False), hmm.initial_model(tr, k), 2)
        np.testing.assert_allclose(out["models"][k, f].means, m.means, rtol=1e-7)
        assert ll == pytest.approx(sum(direct_ll(x, m) for x in cut(f, True)), rel=1e-8)
    for k, aic, bic, mean in out["summary"]:
        assert mean == pytest.approx(np.mean([v for kk, _, _, v in out["folds"] if kk == k]))
        assert aic == pytest.approx(2 * (k * k + 2 * k - 1) - 2 * mean) and bic == pytest.approx(np.log(n) * (k * k + 2 * k - 1) - 2 * mean)


def test_more_folds_than_some_traces_have_samples(traces, spark):
    tr, _, _ = traces
    few = tr.filter("trace_id >= 3 AND t < 0.05")
    out = hmm.hmm_cross_validate(few, 1, 1, n_splits=6, max_iter=1)
    assert [r[2] for r in out["folds"]] == [1] * 6
    assert hmm.cross_validation_tables(spark, out)[1].count() == 6


@pytest.mark.parametrize("win, step", [(50, 7), (30, 30), (20, 45)])
def test_window_scores_across_block_borders(traces, win, step):
    tr, _, xs = traces
    got = {(r["trace_id"], r["w"]): r["true"] for r in hmm.score_windows(tr, {"true": TRUE}, win, step, block=64).collect()}
    want = {(i, s // step): direct_ll(x[s : s + win], TRUE) for i, x in xs.items() for s in range(0, max(len(x) - win, 0) + 1, step)}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-8)


def test_sweep_stops_and_picks_lowest_bic(traces, spark):
    tr, _, _ = traces
    out = hmm.hmm_sweep(tr, 1, 3, threshold=1e-2, max_iter=5, refit_iter=2)
    bics = {r[0]: r[2] for r in out["summary"]}
    assert out["best_k"] == min(bics, key=bics.get) == 3
    summary, history = hmm.sweep_tables(spark, out)
    assert summary.count() == 3 and history.count() >= 6


def test_adapt_freezes_and_shrinks(traces):
    tr, _, _ = traces
    base = hmm.Model.of(TRUE.start, TRUE.trans, [13.0, 7.0, 2.0], TRUE.vars)
    m = hmm.hmm_adapt(tr, base, flags="m", shrink=0.2, max_iter=3)
    assert m.vars == base.vars and m.trans == base.trans
    free = hmm.hmm_adapt(tr, base, flags="m", shrink=0.0, max_iter=3)
    np.testing.assert_allclose(m.means, 0.8 * np.array(free.means) + 0.2 * np.array(base.means), atol=1e-9)


def test_model_table_round_trip(spark):
    assert hmm.models_from(hmm.model_table(spark, {"a": TRUE})) == {"a": TRUE}


def test_regimes_cover_every_sample(traces):
    tr, _, _ = traces
    other = hmm.Model.of([0.5, 0.5], [[0.9, 0.1], [0.1, 0.9]], [20.0, 1.0], [4.0, 4.0])
    out = hmm.annotate_regimes(tr, {"base": TRUE, "other": other}, "base", win=50, step=10)
    p = out.toPandas()
    assert len(p) == 1688
    assert (p[p.trace_id < 3].regime == "base").mean() > 0.95
