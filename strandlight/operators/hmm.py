"""Gaussian hidden-state models as Spark jobs (H1-H6).

A trace is stored as blocks of at most ``BLOCK`` samples. What a block does to the state vector
is a K x K matrix, and such matrices chain, so each pass over the data works on blocks in
parallel and only one small row per block is chained, a bounded number of rows at a time:

  transfer (all blocks)  ->  chain (products of FAN rows, level by level, and back down)  ->  apply (all blocks)

With sums this gives the forward-backward sums of EM, with maxima the most likely path. Both are
exact; a single very long trace spreads over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlight.operators.signals import exact_percentiles
from strandlight.ordered import halo_blocks, value_chunks, with_running
from strandlight.session import broadcast_if_small, cut_lineage, scratch
from strandlight.operators.traces import (
    CHUNK_S, FAN, KEY, collapse_spikes, hysteresis, indexed, levels_of, min_run, scan_blocks, steps_of,
)

BLOCK = 1024
COVAR_PRIOR = 1e-2  # fixed value: added to each state's sum of squares
STICKY = 0.7  # fixed value: initial self-transition probability
BATCH = 512  # blocks handled at once inside a task


@dataclass(frozen=True)
class Model:
    """K states: start and transition probabilities, means and variances."""

    start: tuple
    trans: tuple
    means: tuple
    vars: tuple

    @property
    def k(self) -> int:
        return len(self.means)

    @staticmethod
    def of(start, trans, means, vars) -> "Model":
        t = lambda a: tuple(float(x) for x in np.ravel(a))
        return Model(t(start), tuple(t(r) for r in np.asarray(trans)), t(means), t(vars))

    def arrays(self):
        return np.array(self.start), np.array(self.trans), np.array(self.means), np.array(self.vars)

    def ordered(self) -> "Model":
        """states by descending mean, parameters permuted alike."""
        s, a, m, v = self.arrays()
        o = np.argsort(-m, kind="stable")
        return Model.of(s[o], a[np.ix_(o, o)], m[o], v[o])


def model_table(spark: SparkSession, models: dict[str, Model]) -> DataFrame:
    """Models as rows."""
    rows = [(n, m.k, list(m.start), [list(r) for r in m.trans], list(m.means), list(m.vars)) for n, m in models.items()]
    return spark.createDataFrame(
        rows, "model_id string, k int, startprob array<double>, transmat array<array<double>>, means array<double>, vars array<double>")


def models_from(table: DataFrame) -> dict[str, Model]:
    """Rows back to models (a handful)."""
    return {r["model_id"]: Model.of(r["startprob"], r["transmat"], r["means"], r["vars"]) for r in table.collect()}


def blocks_of(tr: DataFrame, keys: list[str] = KEY, size: int = BLOCK, chunk_s: float = CHUNK_S) -> DataFrame:
    """(keys, blk, xs): samples in order, missing ones dropped, ``size`` per block."""
    d = indexed(tr.filter(F.col("signal").isNotNull() & ~F.isnan("signal")).drop("idx", "n_rows"), keys, chunk_s)
    return d.groupBy(*keys, F.floor(F.col("idx") / size).alias("blk")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "signal"))).alias("r")
    ).select(*keys, "blk", F.col("r.signal").alias("xs"))


# ---------------------------------------------------------------- inside a task


def _pad(rows: list) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(r) for r in rows])
    x = np.zeros((len(rows), n.max()))
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    return x, n


def _log(a: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(a)


def _emission(x: np.ndarray, m: Model) -> np.ndarray:
    """Log density of every sample under every state: (..., K)."""
    _, _, mu, var = m.arrays()
    return -0.5 * (np.log(2 * np.pi * var) + (x[..., None] - mu) ** 2 / var)


def _transfer(x, n, first, m: Model, best: bool) -> np.ndarray:
    """Log transfer matrices (B, K, K): from the state before a block to its last state.

    The rows of a trace's first block all hold the start vector. ``best`` chains maxima."""
    start, trans, _, _ = m.arrays()
    e = _emission(x, m)
    k = m.k
    lead = np.where(first[:, None, None], _log(start)[None, None, :], _log(trans)[None])
    a = np.broadcast_to(lead, (len(x), k, k)) + e[:, 0][:, None, :]
    lt = _log(trans)
    for t in range(1, x.shape[1]):
        if best:
            nxt = (a[:, :, :, None] + lt).max(axis=2)
        else:
            top = a.max(axis=2, keepdims=True)
            top = np.where(np.isfinite(top), top, 0.0)
            nxt = _log(np.exp(a - top) @ trans) + top
        a = np.where((t < n)[:, None, None], nxt + e[:, t][:, None, :], a)
    return a


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    return np.squeeze(_log(np.exp(a - top).sum(axis=axis, keepdims=True)) + top, axis=axis)


def _statistics(x, n, first, a_in, b_out, m: Model) -> np.ndarray:
    """EM sums of a batch: start, transitions, state weights with first two moments, and the
    log-likelihood (of the batch's traces when no trace has a second block)."""
    start, trans, _, _ = m.arrays()
    B, L, k = len(x), x.shape[1], m.k
    e = _emission(x, m)
    shift = e.max(axis=2, keepdims=True)
    em = np.exp(e - shift)
    prior = np.exp(a_in - a_in.max(axis=1, keepdims=True))
    alpha = np.zeros((B, L, k))
    alpha[:, 0] = np.where(first[:, None], start, prior @ trans) * em[:, 0]
    lead = alpha[:, 0].sum(axis=1, keepdims=True)
    ll = np.log(lead[:, 0]) + shift[:, 0, 0]
    alpha[:, 0] /= lead
    for t in range(1, L):
        a = (alpha[:, t - 1] @ trans) * em[:, t]
        s = a.sum(axis=1, keepdims=True)
        alpha[:, t] = np.where((t < n)[:, None], a / np.where(s > 0, s, 1.0), alpha[:, t - 1])
        ll += np.where(t < n, np.log(s[:, 0]) + shift[:, t, 0], 0.0)
    beta = np.exp(b_out - b_out.max(axis=1, keepdims=True))
    gamma = np.zeros((B, L, k))
    xi = np.zeros((k, k))
    for t in range(L - 1, -1, -1):
        live = t < n
        g = alpha[:, t] * beta
        g = np.where(live[:, None], g / g.sum(axis=1, keepdims=True), 0.0)
        gamma[:, t] = g
        right = em[:, t] * beta
        if t > 0:
            left, use = alpha[:, t - 1], live
        else:
            p = prior / prior.sum(axis=1, keepdims=True)
            left, use = p, live & ~first
        joint = left[:, :, None] * trans[None] * right[:, None, :]
        z = joint.sum(axis=(1, 2), keepdims=True)
        xi += np.where(use[:, None, None], joint / np.where(z > 0, z, 1.0), 0.0).sum(axis=0)
        nb = right @ trans.T
        nb = nb / nb.sum(axis=1, keepdims=True)
        beta = np.where(live[:, None], nb, beta)
    s0 = gamma[first, 0].sum(axis=0)
    w = gamma.sum(axis=(0, 1))
    return np.concatenate([s0, xi.ravel(), w, (gamma * x[..., None]).sum(axis=(0, 1)), (gamma * (x**2)[..., None]).sum(axis=(0, 1)), [ll.sum()]])


def _best_path(x, n, first, z_prev, z_end, m: Model) -> np.ndarray:
    """Most likely states of each block between its fixed neighbours."""
    start, trans, _, _ = m.arrays()
    lt, e = _log(trans), _emission(x, m)
    B, L, k = len(x), x.shape[1], m.k
    d = np.where(first[:, None], _log(start)[None], lt[z_prev]) + e[:, 0]
    back = np.zeros((B, L, k), dtype=np.int8)
    for t in range(1, L):
        s = d[:, :, None] + lt[None]
        back[:, t] = s.argmax(axis=1)
        d = np.where((t < n)[:, None], s.max(axis=1) + e[:, t], d)
    path = np.zeros((B, L), dtype=np.int64)
    cur = z_end.copy()
    rows = np.arange(B)
    for t in range(L - 1, -1, -1):
        path[:, t] = cur
        cur = np.where((t < n) & (t > 0), back[rows, t, cur], cur)
    return path


def _slices(p: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for i in range(0, len(p), BATCH):
        yield p.iloc[i : i + BATCH]


# ---------------------------------------------------------------- passes


def _kdef(df: DataFrame, keys: list[str]) -> str:
    t = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"{k} {t[k]}" for k in keys)


def _transfers(blocks: DataFrame, m: Model, keys: list[str], best: bool) -> DataFrame:
    def run(it):
        for p in it:
            for q in _slices(p):
                x, n = _pad(list(q["xs"]))
                a = _transfer(x, n, (q["blk"] == 0).to_numpy(), m, best)
                yield q[[*keys, "blk"]].assign(mat=[r.ravel().tolist() for r in a])

    return blocks.mapInPandas(run, f"{_kdef(blocks, keys)}, blk long, mat array<double>")


def _product(keys: list[str], best: bool):
    """The transfer matrix of neighbouring blocks from those of each."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        k = int(round(len(p["mat"].iloc[0]) ** 0.5))
        mats = np.array(p["mat"].tolist()).reshape(-1, k, k)
        while len(mats) > 1:  # pairs of neighbours, all at once
            odd = mats[-1:] if len(mats) % 2 else mats[:0]
            s = mats[: len(mats) - len(odd) : 2, :, :, None] + mats[1 : len(mats) : 2, None, :, :]
            mats = np.concatenate([s.max(axis=2) if best else _lse(s, 2), odd])
        return p[[*keys, "blk"]].iloc[:1].assign(mat=[mats[0].ravel().tolist()])

    return run


def _chain_sum(k: int, keys: list[str]):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        mats = [np.array(v).reshape(k, k) for v in p["mat"]]
        inner = "in_a_in" in p
        a, ins = np.array(p["in_a_in"].iloc[0]) if inner else np.where(np.arange(k) == 0, 0.0, -np.inf), []
        for m in mats:
            ins.append(a)
            a = _lse(a[:, None] + m, 0)
        ll = float(p["in_ll"].iloc[0]) if inner else float(_lse(a, 0))
        b, outs = np.array(p["in_b_out"].iloc[0]) if inner else np.zeros(k), []
        for m in reversed(mats):
            outs.append(b)
            b = _lse(m + b[None, :], 1)
            b = b - b.max()
        out = p[[*keys, "blk"]].copy()
        out["a_in"] = [v.tolist() for v in ins]
        out["b_out"] = [v.tolist() for v in reversed(outs)]
        out["ll"] = ll
        return out

    return run


def _chain_max(k: int, keys: list[str]):
    """States at the borders of blocks; within a group they lie between those of the group's own borders."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        mats = [np.array(v).reshape(k, k) for v in p["mat"]]
        inner = "in_z_end" in p
        enter = int(p["in_z_prev"].iloc[0]) if inner else 0
        a, froms = np.where(np.arange(k) == enter, 0.0, -np.inf), []
        for m in mats:
            s = a[:, None] + m
            froms.append(s.argmax(axis=0))
            a = s.max(axis=0)
        z, prev, end = int(p["in_z_end"].iloc[0]) if inner else int(a.argmax()), [], []
        for f in reversed(froms):
            end.append(z)
            z = int(f[z])
            prev.append(z)
        out = p[[*keys, "blk"]].copy()
        out["z_prev"], out["z_end"] = prev[::-1], end[::-1]
        return out

    return run


def _mats(p: pd.DataFrame, k: int) -> np.ndarray:
    return np.stack(p["mat"].to_numpy()).reshape(-1, k, k)


def _chain_sum_many(k: int, keys: list[str]):
    """``_chain_sum`` of many whole traces at once."""

    def run(p: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        mats, steps = _mats(p, k), list(steps_of(starts, len(p)))
        a = np.tile(np.where(np.arange(k) == 0, 0.0, -np.inf), (len(starts), 1))
        b, ins, outs = np.zeros((len(starts), k)), np.zeros((len(p), k)), np.zeros((len(p), k))
        for live, rows in steps:
            ins[rows] = a[live]
            a[live] = _lse(a[live][:, :, None] + mats[rows], 1)
        for live, rows in reversed(steps):
            outs[rows] = b[live]
            v = _lse(mats[rows] + b[live][:, None, :], 2)
            b[live] = v - v.max(axis=1, keepdims=True)
        ll = np.repeat(_lse(a, 1), np.diff(np.append(starts, len(p))))
        return p[[*keys, "blk"]].assign(a_in=list(ins), b_out=list(outs), ll=ll)

    return run


def _chain_jobs_many(keys: list[str]):
    """``_chain_jobs`` of many whole traces and jobs at once; jobs of as many states go together."""

    def run(p: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        size, bounds = p["mat"].str.len().to_numpy(), np.append(starts, len(p))
        parts = []
        for kk in np.unique(size):
            mine = size[starts] == kk
            n = np.diff(bounds)[mine]
            first = np.cumsum(n) - n
            out = _chain_sum_many(int(round(kk**0.5)), keys)(p[size == kk], first)
            parts.append(out.assign(head=np.isin(np.arange(len(out)), first)))
        return pd.concat(parts, ignore_index=True)

    return run


def _chain_max_many(k: int, keys: list[str]):
    """``_chain_max`` of many whole traces at once."""

    def run(p: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        mats, steps = _mats(p, k), list(steps_of(starts, len(p)))
        a, froms = np.tile(np.where(np.arange(k) == 0, 0.0, -np.inf), (len(starts), 1)), np.zeros((len(p), k), np.int64)
        for live, rows in steps:
            s = a[live][:, :, None] + mats[rows]
            froms[rows], a[live] = s.argmax(axis=1), s.max(axis=1)
        z, prev, end = a.argmax(axis=1), np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        for live, rows in reversed(steps):
            end[rows] = z[live]
            z[live] = prev[rows] = froms[rows, z[live]]
        return p[[*keys, "blk"]].assign(z_prev=prev, z_end=end)

    return run


def _boundaries(blocks: DataFrame, m: Model, keys: list[str], levels: int = 1, fan: int = FAN) -> DataFrame:
    kd = _kdef(blocks, keys)
    return scan_blocks(
        _transfers(blocks, m, keys, False), keys, f"{kd}, blk long, a_in array<double>, b_out array<double>, ll double",
        _chain_sum(m.k, keys), _product(keys, False), ["a_in", "b_out", "ll"], levels, fan, _chain_sum_many(m.k, keys))


def expectation(blocks: DataFrame, m: Model, keys: list[str] = KEY, chained: bool = True, levels: int = 1,
                fan: int = FAN) -> tuple[np.ndarray, float]:
    """One E-step: additive sums of all blocks and the total log-likelihood.

    With ``chained`` False (or no ``levels``, see ``chain_levels``) no trace has a second block: nothing needs
    chaining and the step is one narrow pass and one sum.
    """
    chained = chained and levels > 0
    names = [f"s{i}" for i in range(m.k * m.k + 4 * m.k)]
    k = m.k

    def run(it):
        for p in it:
            for q in _slices(p):
                x, n = _pad(list(q["xs"]))
                first = (q["blk"] == 0).to_numpy()
                if chained:
                    a_in, b_out = np.array(q["a_in"].tolist()), np.array(q["b_out"].tolist())
                else:
                    a_in = b_out = np.zeros((len(q), k))
                s = _statistics(x, n, first, a_in, b_out, m).tolist()
                if chained:
                    s[-1] = float(q["ll"][first].sum())
                yield pd.DataFrame([s], columns=[*names, "ll"])

    with scratch(blocks.sparkSession):
        src = blocks.join(_boundaries(blocks, m, keys, levels, fan), [*keys, "blk"]) if chained else blocks
        part = src.mapInPandas(run, ", ".join(f"{c} double" for c in [*names, "ll"]))
        r = part.agg(*[F.sum(c).alias(c) for c in [*names, "ll"]]).first()
    return np.array([r[c] for c in names]), float(r["ll"])


def chain_levels(blocks: DataFrame, fan: int = FAN) -> int:
    """Levels of the chain over the longest trace, 0 when no trace has a second block."""
    last = blocks.agg(F.max("blk")).first()[0] or 0
    return levels_of(last, fan) if last else 0


def maximization(s: np.ndarray, m: Model, flags: str = "stmc") -> Model:
    """M-step for the chosen blocks: s start, t transitions, m means, c variances."""
    k = m.k
    s0, xi, w, wx, wxx = s[:k], s[k : k + k * k].reshape(k, k), *np.split(s[k + k * k :], 3)
    start, trans, mu, var = m.arrays()
    if "s" in flags:
        start = s0 / (s0.sum() or 1.0)
    if "t" in flags:
        rows = xi.sum(axis=1, keepdims=True)
        trans = np.where(rows > 0, xi / np.where(rows > 0, rows, 1.0), trans)
    if "m" in flags:
        mu = np.where(w > 0, wx / np.where(w > 0, w, 1.0), mu)
    if "c" in flags:
        var = (COVAR_PRIOR + wxx - 2 * mu * wx + mu**2 * w) / np.maximum(w, 1e-5)
    return Model.of(start, trans, mu, var)


# ---------------------------------------------------------------- operators


def signal_facts(tr: DataFrame) -> tuple[float, float, float]:
    """Least, largest and variance of the signal: what every start model needs."""
    v = tr.filter(F.col("signal").isNotNull() & ~F.isnan("signal"))
    return tuple(v.agg(F.min("signal"), F.max("signal"), F.var_pop("signal")).first())


def initial_model(tr: DataFrame, k: int, init: str = "linspace", facts: tuple[float, float, float] | None = None) -> Model:
    """H1: uniform start, sticky diagonal, means by range or quantiles, variance / K."""
    v = tr.filter(F.col("signal").isNotNull() & ~F.isnan("signal"))
    lo, hi, var = facts or signal_facts(tr)
    means = np.linspace(lo, hi, k) if init == "linspace" else np.array(exact_percentiles(v, "signal", list(np.linspace(0, 1, k))))
    trans = np.full((k, k), (1.0 - STICKY) / (k - 1)) if k > 1 else np.ones((1, 1))
    if k > 1:
        np.fill_diagonal(trans, STICKY)
    return Model.of(np.full(k, 1.0 / k), trans, means, np.full(k, var / k))


def cached_blocks(tr: DataFrame, keys: list[str] = KEY, size: int = BLOCK) -> DataFrame:
    """Blocks laid out by (trace, block), kept for the iterations of a fit."""
    return blocks_of(tr, keys, size).repartition(*keys, "blk").persist()


def em(blocks: DataFrame, model: Model, tol: float, max_iter: int, flags: str = "stmc", keys: list[str] = KEY,
       rel_tol: float | None = None) -> tuple[Model, list[float]]:
    """H1: EM until the gain in log-likelihood falls below ``tol`` or, where ``rel_tol`` is given
    instead, until its change relative to the previous value falls below that."""
    history: list[float] = []
    levels = chain_levels(blocks)
    for _ in range(max_iter):
        s, ll = expectation(blocks, model, keys, levels=levels)
        model = maximization(s, model, flags)
        history.append(ll)
        if len(history) > 1:
            gain = history[-1] - history[-2]
            if gain < tol if rel_tol is None else abs(gain) < rel_tol * abs(history[-2]):
                break
    return model, history


def hmm_fit(tr: DataFrame, k: int, init: str = "linspace", tol: float = 1e-2, max_iter: int = 300,
            keys: list[str] = KEY, size: int = BLOCK, rel_tol: float | None = None) -> tuple[Model, list[float]]:
    """H1: fit over many traces without transitions between them; model and LL history."""
    blocks = cached_blocks(tr, keys, size)
    try:
        return em(blocks, initial_model(tr, k, init), tol, max_iter, keys=keys, rel_tol=rel_tol)
    finally:
        blocks.unpersist()


def log_likelihood(blocks: DataFrame, m: Model, keys: list[str] = KEY, levels: int | None = None) -> DataFrame:
    """H4: log-likelihood of each trace."""
    n = max(chain_levels(blocks), 1) if levels is None else levels
    return _boundaries(blocks, m, keys, n).filter("blk = 0").select(*keys, "ll")


def hmm_sweep(tr: DataFrame, kmin: int = 1, kmax: int = 6, threshold: float = 1e-2, max_iter: int = 300,
              refit_tol: float = 1e-4, refit_iter: int = 1000, keys: list[str] = KEY) -> dict:
    """H2: fit K = kmin..kmax side by side (one job per round for all of them), report up to the K where
    BIC settles, refit the K of lowest BIC strictly."""
    blocks = cached_blocks(tr, keys)
    try:
        n = blocks.agg(F.sum(F.size("xs"))).first()[0]
        facts = signal_facts(tr)
        start = {k: (initial_model(tr, k, facts=facts), None) for k in range(kmin, kmax + 1)}
        models, history = em_all(blocks, start, threshold, max_iter, keys)
        final_ll = expectation_all(blocks, {k: (m, None) for k, m in models.items()}, keys, levels=chain_levels(blocks))
        rows, hist = [], []
        for k in range(kmin, kmax + 1):
            ll = final_ll[k][1]
            rows.append((k, *criteria(k, ll, n), ll, ll - rows[-1][3] if rows else None))
            hist += [(k, i + 1, v) for i, v in enumerate(history[k])]
            if len(rows) > 1 and abs(rows[-2][2] - rows[-1][2]) < threshold:
                break
        best = min(rows, key=lambda r: r[2])[0]
        final, fh = em(blocks, initial_model(tr, best, "quantile", facts), refit_tol, refit_iter, keys=keys)
    finally:
        blocks.unpersist()
    return dict(summary=rows, history=hist, models={r[0]: models[r[0]] for r in rows}, best_k=best, final=final, final_history=fh)


def criteria(k: int, ll: float, n: int) -> tuple[float, float]:
    """AIC and BIC of K states with full transitions, start, means and variances."""
    p = k * k + 2 * k - 1
    return 2.0 * p - 2 * ll, float(np.log(n)) * p - 2 * ll


# ---- several models in one pass, with held-out folds


def fold_blocks(tr: DataFrame, n_splits: int, keys: list[str] = KEY, size: int = BLOCK, chunk_s: float = CHUNK_S) -> DataFrame:
    """(keys, blk, xs, lead, fold, prev_fold): blocks that no fold border crosses.

    The folds are ``n_splits`` contiguous stretches of all samples, traces laid end to end in key order; the
    first (samples mod n_splits) folds hold one sample more. ``lead`` marks the first block of a trace,
    ``prev_fold`` is the fold of the sample before the block (-1 at the start of a trace).
    """
    d = indexed(tr.filter(F.col("signal").isNotNull() & ~F.isnan("signal")).drop("idx", "n_rows"), keys, chunk_s)
    d = cut_lineage(d, "indexed")
    per = d.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_k", F.struct(*keys)).withColumn("_all", F.lit(1))
    per = with_running(value_chunks(per, "_k"), ["_all"], ["_k"], {"_upto": F.col("_n")}, totals=True)
    per = per.select(*keys, (F.col("_upto") - F.col("_n")).alias("_base"), F.col("_upto_total").alias("_total"))
    d = d.join(broadcast_if_small(per), keys)
    small, more = F.floor(F.col("_total") / n_splits), F.col("_total") % n_splits
    wide = more * (small + 1)  # samples of the folds that hold one more

    def fold(g):
        return F.when(g < wide, F.floor(g / (small + 1))).otherwise(more + F.floor((g - wide) / F.greatest(small, F.lit(1))))

    g = F.col("_base") + F.col("idx")
    d = d.withColumn("fold", fold(g).cast("int")).withColumn("_before", F.when(F.col("idx") > 0, fold(g - 1)).otherwise(-1).cast("int"))
    b = d.groupBy(*keys, (F.floor(F.col("idx") / size) * n_splits + F.col("fold")).alias("blk"), "fold").agg(
        F.sort_array(F.collect_list(F.struct("idx", "signal"))).alias("r"), F.min_by("_before", "idx").alias("prev_fold"))
    return b.select(*keys, "blk", F.col("r.signal").alias("xs"), (F.col("prev_fold") < 0).alias("lead"), "fold", "prev_fold")


def _taken(q: pd.DataFrame, hold: int | None, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Blocks that a job sees and which of them start a sequence: all blocks, those outside fold ``hold``
    or those inside it; what a removed fold parts is two sequences."""
    if hold is None:
        return np.ones(len(q), bool), (q["lead"] if "lead" in q else q["blk"] == 0).to_numpy()
    fold, before, lead = q["fold"].to_numpy(), q["prev_fold"].to_numpy(), q["lead"].to_numpy()
    if inside:
        return fold == hold, lead | (before != hold)
    return fold != hold, lead | (before == hold)


def _chain_jobs(keys: list[str]):
    """Like the chain of one model, for any number of states, with a mark on the first row."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        k = int(round(len(p["mat"].iloc[0]) ** 0.5))
        out = _chain_sum(k, keys)(p)
        out["head"] = (np.arange(len(out)) == 0) & (bool(p["in_head"].iloc[0]) if "in_head" in p else True)
        return out

    return run


def expectation_all(blocks: DataFrame, jobs: dict, keys: list[str] = KEY, inside: bool = False, levels: int = 1, fan: int = FAN) -> dict:
    """One E-step of several models at once: job -> (additive sums, log-likelihood).

    ``jobs`` maps a name to (model, fold to leave out or None); with ``inside`` the fold is what is scored. The
    statistics are keyed by job, so all models share one scan of the blocks and one aggregate. ``levels`` as in
    ``expectation``; blocks of folds need at least 1.
    """
    names, chained = list(jobs), levels > 0
    given = list(jobs.values())
    kd = _kdef(blocks, keys)

    def transfers(it):
        for p in it:
            for q in _slices(p):
                x, n = _pad(list(q["xs"]))
                for j, (m, hold) in enumerate(given):
                    use, first = _taken(q, hold, inside)
                    if use.any():
                        mat = _transfer(x[use], n[use], first[use], m, False)
                        yield q.loc[use, [*keys, "blk"]].assign(job=j, mat=[r.ravel().tolist() for r in mat])

    def sums(it):
        for p in it:
            acc: dict[int, np.ndarray] = {}
            for q in _slices(p):
                x, n = _pad(list(q["xs"]))
                edges = [{int(e["job"]): e for e in es} for es in q["edges"]] if chained else None
                for j, (m, hold) in enumerate(given):
                    use, first = _taken(q, hold, inside)
                    if not use.any():
                        continue
                    if chained:
                        e = [edges[i][j] for i in np.flatnonzero(use)]
                        a_in, b_out = (np.array([list(r[c]) for r in e]) for c in ("a_in", "b_out"))
                    else:
                        a_in = b_out = np.zeros((int(use.sum()), m.k))
                    s = _statistics(x[use], n[use], first[use], a_in, b_out, m)
                    if chained:
                        s[-1] = sum(r["ll"] for r in e if r["head"])
                    acc[j] = acc[j] + s if j in acc else s
            for j, s in acc.items():
                yield pd.DataFrame({"job": j, "i": np.arange(len(s)), "v": s})

    with scratch(blocks.sparkSession):
        src = blocks
        if chained:
            by = [*keys, "job"]
            mats = blocks.mapInPandas(transfers, f"{kd}, blk long, job int, mat array<double>")
            edge = scan_blocks(mats, by, f"{kd}, job int, blk long, a_in array<double>, b_out array<double>, ll double, head boolean",
                               _chain_jobs(by), _product(by, False), ["a_in", "b_out", "ll", "head"], levels, fan, _chain_jobs_many(by))
            edge = edge.groupBy(*keys, "blk").agg(F.collect_list(F.struct("job", "a_in", "b_out", "ll", "head")).alias("edges"))
            src = blocks.join(edge, [*keys, "blk"])
        part = src.mapInPandas(sums, "job int, i int, v double").groupBy("job", "i").agg(F.sum("v").alias("v"))
        sums_of = part.collect()  # a few dozen sums per model
    out = {name: np.zeros(m.k * m.k + 4 * m.k + 1) for name, (m, _) in jobs.items()}
    for r in sums_of:
        out[names[r["job"]]][r["i"]] = r["v"]
    return {name: (v[:-1], float(v[-1])) for name, v in out.items()}


def em_all(blocks: DataFrame, jobs: dict, tol: float, max_iter: int, keys: list[str] = KEY) -> tuple[dict, dict]:
    """H2: EM of several models side by side, one job per round; a model rests once its gain falls below ``tol``."""
    models, history = {n: m for n, (m, _) in jobs.items()}, {n: [] for n in jobs}
    live = list(jobs)
    levels = max(chain_levels(blocks), int("fold" in blocks.columns))
    for _ in range(max_iter):
        step = expectation_all(blocks, {n: (models[n], jobs[n][1]) for n in live}, keys, levels=levels)
        for n in list(live):
            s, ll = step[n]
            models[n] = maximization(s, models[n])
            history[n].append(ll)
            if len(history[n]) > 1 and history[n][-1] - history[n][-2] < tol:
                live.remove(n)
        if not live:
            break
    return models, history


def hmm_cross_validate(tr: DataFrame, kmin: int = 1, kmax: int = 6, n_splits: int = 5, tol: float = 1e-2, max_iter: int = 200,
                       keys: list[str] = KEY, size: int = BLOCK) -> dict:
    """H2 with held-out folds: for every K and contiguous fold a model of the other folds scores the fold.

    All (K, fold) models share one job per round. ``folds``: (k, fold, samples, held-out log-likelihood);
    ``summary``: (k, aic, bic, mean held-out log-likelihood), the criteria taken at that mean over all samples.
    Traces never join; a trace that a fold cuts gives one sequence on either side of it. Start models come
    from the range and variance of all samples.
    """
    blocks = fold_blocks(tr, n_splits, keys, size).repartition(*keys, "blk").persist()
    try:
        size_of = {r["fold"]: r["n"] for r in blocks.groupBy("fold").agg(F.sum(F.size("xs")).alias("n")).collect()}  # one row per fold
        facts = signal_facts(tr)
        first = {k: initial_model(tr, k, facts=facts) for k in range(kmin, kmax + 1)}
        jobs = {(k, f): (m, f) for k, m in first.items() for f in sorted(size_of)}
        models, history = em_all(blocks, jobs, tol, max_iter, keys)
        held = expectation_all(blocks, {j: (models[j], j[1]) for j in jobs}, keys, inside=True, levels=max(chain_levels(blocks), 1))
    finally:
        blocks.unpersist()
    n = sum(size_of.values())
    folds = [(k, f, size_of[f], held[k, f][1]) for k, f in jobs]
    summary = []
    for k in first:
        ll = float(np.mean([v for kk, _, _, v in folds if kk == k]))
        summary.append((k, *criteria(k, ll, n), ll))
    return dict(summary=summary, folds=folds, models=models, history=history)


def cross_validation_tables(spark: SparkSession, cv: dict) -> tuple[DataFrame, DataFrame]:
    """H2: criteria per K, and held-out log-likelihood per K and fold."""
    return (
        spark.createDataFrame(cv["summary"], "k int, aic double, bic double, log_likelihood double"),
        spark.createDataFrame(cv["folds"], "k int, fold int, samples long, log_likelihood double"),
    )


def sweep_tables(spark: SparkSession, sweep: dict) -> tuple[DataFrame, DataFrame]:
    """H2: the criterion table and the per-iteration history."""
    return (
        spark.createDataFrame(sweep["summary"], "k int, aic double, bic double, log_likelihood double, ll_ratio double"),
        spark.createDataFrame(sweep["history"], "k int, iteration int, log_likelihood double"),
    )


def hmm_decode(tr: DataFrame, m: Model, keys: list[str] = KEY, size: int = BLOCK, chunk_s: float = CHUNK_S,
               fan: int = FAN) -> DataFrame:
    """H3: the samples with their most likely ``state``."""
    d = indexed(tr.filter(F.col("signal").isNotNull() & ~F.isnan("signal")).drop("idx", "n_rows"), keys, chunk_s)
    d = cut_lineage(d, "indexed")  # read by both passes and by the final join
    blocks = d.groupBy(*keys, F.floor(F.col("idx") / size).alias("blk")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "signal"))).alias("r")).select(*keys, "blk", F.col("r.signal").alias("xs"))
    kd = _kdef(blocks, keys)
    last = d.agg(F.max("idx")).first()[0] or 0
    edge = scan_blocks(_transfers(blocks, m, keys, True), keys, f"{kd}, blk long, z_prev long, z_end long", _chain_max(m.k, keys),
                       _product(keys, True), ["z_prev", "z_end"], levels_of(last // size, fan), fan, _chain_max_many(m.k, keys))

    def run(it):
        for p in it:
            for q in _slices(p):
                x, n = _pad(list(q["xs"]))
                z = _best_path(x, n, (q["blk"] == 0).to_numpy(), q["z_prev"].to_numpy(), q["z_end"].to_numpy(), m)
                yield q[[*keys, "blk"]].assign(path=[z[i, : n[i]].tolist() for i in range(len(n))])

    paths = blocks.join(edge, [*keys, "blk"]).mapInPandas(run, f"{kd}, blk long, path array<long>")
    states = paths.select(*keys, "blk", F.posexplode("path").alias("off", "state"))
    states = states.select(*keys, (F.col("blk") * size + F.col("off")).alias("idx"), F.col("state").cast("int").alias("state"))
    base = d.drop("state") if "state" in d.columns else d
    return base.join(states, [*keys, "idx"])


def hmm_score(tr: DataFrame, models: dict[str, Model], baseline: str, keys: list[str] = KEY) -> DataFrame:
    """H4: log-likelihood of each trace under each model, the best one and its gain over the
    baseline model."""
    blocks = cut_lineage(blocks_of(tr, keys), "blocks")  # read once a model
    levels = max(chain_levels(blocks), 1)
    out = None
    for name, m in models.items():
        t = log_likelihood(blocks, m, keys, levels).withColumnRenamed("ll", f"ll_{name}")
        out = t if out is None else out.join(t, keys)
    names = list(models)
    best = F.greatest(*[F.col(f"ll_{n}") for n in names]) if len(names) > 1 else F.col(f"ll_{names[0]}")
    pick = F.coalesce(*[F.when(F.col(f"ll_{n}") == best, F.lit(n)) for n in names])
    return out.withColumn("best_model", pick).withColumn("gain", best - F.col(f"ll_{baseline}"))


def score_windows(tr: DataFrame, models: dict[str, Model], win: int = 500, step: int = 100, keys: list[str] = KEY,
                  block: int = 8192) -> DataFrame:
    """H4: (keys, w, <one column per model>): log-likelihood of each sliding window.

    Samples travel in blocks with a halo of one window, so each is sent once (twice near a border) whatever
    win / step is; the windows are views of the block inside the task. A trace shorter than a window has one
    window of all its samples.
    """
    size = -(-max(block, win) // step) * step
    d = indexed(tr.filter(F.col("signal").isNotNull() & ~F.isnan("signal")).drop("idx", "n_rows"), keys)
    d = halo_blocks(d.select(*keys, "idx", "n_rows", "signal"), "idx", 0, win - 1, size, "blk")
    g = d.groupBy(*keys, "blk").agg(
        F.max("n_rows").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "signal"))).alias("r")).select(*keys, "blk", "n", F.col("r.signal").alias("xs"))
    names = list(models)

    def run(it):
        for p in it:
            for row in p.itertuples(index=False):
                lo, x = row.blk * size, np.asarray(row.xs)
                starts = np.arange(lo, min(lo + size, max(row.n - win, 0) + 1), step)
                if not len(starts):
                    continue
                views = np.lib.stride_tricks.sliding_window_view(x, min(win, len(x)))[starts - lo]
                for i in range(0, len(views), BATCH):
                    v = views[i : i + BATCH]
                    n, first = np.full(len(v), v.shape[1]), np.ones(len(v), bool)
                    out = pd.DataFrame({k: [getattr(row, k)] * len(v) for k in keys} | {"w": starts[i : i + BATCH] // step})
                    for name in names:
                        out[name] = _lse(_transfer(v, n, first, models[name], False)[:, 0], 1)
                    yield out

    return g.mapInPandas(run, f"{_kdef(g, keys)}, w long, " + ", ".join(f"`{n}` double" for n in names))


def hmm_adapt(tr: DataFrame, base: Model, flags: str = "stm", shrink: float = 0.2, tol: float = 1e-2, max_iter: int = 100,
              keys: list[str] = KEY) -> Model:
    """H5: EM from a base model with some blocks frozen, then means pulled towards the base."""
    blocks = cached_blocks(tr, keys)
    try:
        m, _ = em(blocks, base, tol, max_iter, flags, keys)
    finally:
        blocks.unpersist()
    m = m.ordered()
    if shrink and "m" in flags:
        mixed = (1 - shrink) * np.array(m.means) + shrink * np.array(base.ordered().means)
        m = replace(m, means=tuple(float(v) for v in mixed)).ordered()
    return m


def annotate_regimes(tr: DataFrame, models: dict[str, Model], baseline: str, win: int = 500, step: int = 100, delta: float = 8.0,
                     min_windows: int = 3, keys: list[str] = KEY) -> DataFrame:
    """H6: each sample's regime: window scores, hysteresis, spike removal, minimum run, expansion
    (a later run overwrites; samples that no window covers carry the baseline name). Samples without a
    signal keep their row, without a regime."""
    d = cut_lineage(indexed(tr.filter(F.col("signal").isNotNull() & ~F.isnan("signal")), keys), "indexed")
    scores = cut_lineage(score_windows(d, models, win, step, keys), "scores")
    lab = cut_lineage(hysteresis(scores, list(models), delta, keys), "labels")
    runs = cut_lineage(min_run(collapse_spikes(lab, keys), min_windows, keys), "regimes")
    # a run owns the samples of its windows up to the start of the next run
    nxt = runs.select(*keys, (F.col("w_first") - 1).alias("w_last"), F.col("w_first").alias("_nw"))
    r = runs.join(nxt, [*keys, "w_last"], "left").select(
        *keys, F.col("label").alias("regime"), (F.col("w_first") * step).alias("lo"),
        F.least(F.col("_nw") * step, F.col("w_last") * step + win).alias("hi"))
    size = 8192
    r = r.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))))
    l, q = d.withColumn("_b", F.floor(F.col("idx") / size)).alias("l"), r.alias("q")
    cond = (F.col("l._b") == F.col("q._b")) & (F.col("l.idx") >= F.col("q.lo")) & (F.col("l.idx") < F.col("q.hi"))
    for k in keys:
        cond = cond & (F.col(f"l.{k}") == F.col(f"q.{k}"))
    cols = [F.col(f"l.{c}") for c in d.columns]
    out = l.join(q, cond, "left").select(*cols, F.coalesce("q.regime", F.lit(baseline)).alias("regime"))
    mute = tr.filter(F.col("signal").isNull() | F.isnan("signal"))
    return out.unionByName(mute.withColumn("regime", F.lit(None).cast("string")), allowMissingColumns=True)
