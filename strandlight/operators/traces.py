"""Force traces: conditioning, occupancy, transitions, dwells, labels.

Traces carry (condition, trace_id, t, ev, signal[, state]); ``ev`` breaks ties of ``t``. Ordered
work runs in time chunks of a trace, so one very long trace spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlight.operators.stats import order_statistics
from strandlight.session import cut_lineage
from strandlight.ordered import centred_mean, chunk_by, with_index, with_neighbors, with_running

KEY = ["trace_id"]
ORDER = ["t", "ev"]
CHUNK_S = 600.0  # seconds per chunk; at 2.5 kHz 1.5 million samples


WHOLE_ROWS = 200_000  # samples of the longest trace up to which a trace is one window


def indexed(tr: DataFrame, keys: list[str] = KEY, chunk_s: float = CHUNK_S) -> DataFrame:
    """Sample index ``idx`` and length ``n_rows`` of each trace.

    While the longest trace has at most ``WHOLE_ROWS`` samples, a trace is one window and moves once; beyond that
    all traces are numbered in time chunks.
    """
    if "idx" in tr.columns:
        return tr
    longest = tr.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if longest > WHOLE_ROWS:
        return with_index(chunk_by(tr, "t", chunk_s), keys, ORDER).drop("_chunk")
    w = Window.partitionBy(*keys)
    return tr.withColumn("idx", F.row_number().over(w.orderBy(*ORDER)).cast("long") - 1).withColumn("n_rows", F.count(F.lit(1)).over(w))


def _per_trace(tr: DataFrame, aggs: list, keys: list[str] = KEY) -> DataFrame:
    """Rows with per-trace aggregates joined back; no trace is gathered in one task."""
    return tr.join(tr.groupBy(*keys).agg(*aggs), keys)


# ---------------------------------------------------------------- conditioning


def downsample(tr: DataFrame, period_us: int, keys: list[str] = KEY) -> DataFrame:
    """Bucket means, buckets anchored at the trace's first sample, empty buckets absent."""
    t = _per_trace(tr, [F.min("t").alias("_t0")], keys)
    b = F.floor(F.round((F.col("t") - F.col("_t0")) * 1e6, 3) / period_us)
    return t.groupBy(*keys, b.alias("bucket")).agg(F.avg("t").alias("t"), F.avg("signal").alias("signal"), F.count("*").alias("n"))


def sampling_report(tr: DataFrame, down: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Samples, mean rates before and after, and the reduction factor per trace."""
    def rate(d: DataFrame, s: str) -> DataFrame:
        return d.groupBy(*keys).agg(
            F.count("*").alias(f"n_{s}"),
            F.try_divide((F.count("*") - 1).cast("double"), F.max("t") - F.min("t")).alias(f"rate_{s}"))
    j = rate(tr, "before").join(rate(down, "after"), keys)
    return j.withColumn("factor", F.col("n_before") / F.col("n_after"))


def crop_time(tr: DataFrame, lo: float, hi: float) -> DataFrame:
    """Open interval (lo, hi)."""
    return tr.filter((F.col("t") > lo) & (F.col("t") < hi))


def drift_correct(tr: DataFrame, n: int, target: float = 12.0, keys: list[str] = KEY) -> DataFrame:
    """Remove the slope of the smoothed trace and move the fitted intercept to ``target``.

    Subtracting the smoothed fit, adding the first value, refitting and shifting is linear, so it
    reduces to signal - slope(smoothed) * t - intercept(raw) + target: one aggregate per trace.
    """
    s = centred_mean(indexed(tr, keys), keys, "idx", "signal", n, "_smooth")
    s = _per_trace(s, [F.regr_slope("_smooth", "t").alias("_b"), F.regr_intercept("signal", "t").alias("_a")], keys)
    return s.withColumn("corrected", F.col("signal") - F.col("_b") * F.col("t") - F.col("_a") + target).drop(
        "_smooth", "_a", "_b")


def shift_to_intercept(
    tr: DataFrame, n: int, target: float, t0: float | None = None, t1: float | None = None, keys: list[str] = KEY
) -> DataFrame:
    """Shift so that the intercept of the smoothed fit (on [t0, t1] if given) is ``target``."""
    s = centred_mean(indexed(tr, keys), keys, "idx", "signal", n, "_smooth")
    use = F.lit(True)
    if t0 is not None:
        use = use & (F.col("t") >= t0)
    if t1 is not None:
        use = use & (F.col("t") <= t1)
    s = _per_trace(s, [F.regr_intercept(F.when(use, F.col("_smooth")), F.when(use, F.col("t"))).alias("_a")], keys)
    return s.withColumn("corrected", F.col("signal") + target - F.col("_a")).drop("_smooth", "_a")


def shift_to_state(tr: DataFrame, target: float, keys: list[str] = KEY) -> DataFrame:
    """Shift so that the highest state mean of the trace is ``target``."""
    top = tr.groupBy(*keys, "state").agg(F.avg("signal").alias("m")).groupBy(*keys).agg(F.max("m").alias("_m"))
    return tr.join(top, keys).withColumn("shift", target - F.col("_m")).withColumn(
        "corrected", F.col("signal") + F.col("shift")).drop("_m")


def normalize_initial(tr: DataFrame, seconds: float = 5.0, keys: list[str] = KEY) -> DataFrame:
    """Subtract the mean of the samples with t <= seconds (0 when none)."""
    t = _per_trace(tr, [F.coalesce(F.avg(F.when(F.col("t") <= seconds, F.col("signal"))), F.lit(0.0)).alias("_m")], keys)
    return t.withColumn("normalized", F.col("signal") - F.col("_m")).drop("_m")


def median_step(tr: DataFrame, keys: list[str] = KEY, chunk_s: float = CHUNK_S) -> DataFrame:
    """Median time step per trace by distributed order statistics, with the sample count."""
    d = with_neighbors(chunk_by(tr, "t", chunk_s), keys, ORDER, prev={"_pt": "t"})
    d = d.select(*keys, (F.col("t") - F.col("_pt")).alias("dt"))
    n = d.groupBy(*keys).agg(F.count("dt").alias("m"), F.count("*").alias("n"))
    picks = n.filter("m > 0").select(*keys, F.explode(F.array(
        F.struct(F.lit("m1").alias("name"), F.floor((F.col("m") + 1) / 2).alias("k")),
        F.struct(F.lit("m2").alias("name"), (F.floor(F.col("m") / 2) + 1).alias("k")))).alias("x")).select(*keys, "x.*")
    med = order_statistics(d, keys, "dt", picks).groupBy(*keys).agg(F.avg("v").alias("step"))
    return n.join(med, keys, "left").select(*keys, "n", "step")


def concat_time(tr: DataFrame, group: str = "condition") -> DataFrame:
    """One time axis per group: trace after trace in id order, steps of the trace's median."""
    steps = median_step(tr, [group, "trace_id"])
    before = Window.partitionBy(group).orderBy("trace_id").rowsBetween(Window.unboundedPreceding, -1)
    offs = steps.withColumn("offset", F.coalesce(F.sum(F.col("n") * F.col("step")).over(before), F.lit(0.0)))
    j = indexed(tr).join(offs.select(group, "trace_id", "step", "offset"), [group, "trace_id"])
    return j.withColumn("t_chain", F.col("idx") * F.col("step") + F.col("offset")).drop("step", "offset", "n_rows")


def zero_offset(df: DataFrame, cols: list[str], n: int = 399, target: float = 0.1, start: DataFrame | None = None,
                keys: list[str] = KEY) -> DataFrame:
    """Move the mean of the first ``n`` samples (from a per-trace start index) to ``target``."""
    d = indexed(df, keys)
    s0 = F.lit(0)
    if start is not None:
        d = d.join(start.select(*keys, F.col("start_idx").alias("_s")), keys)
        s0 = F.col("_s")
    use = (F.col("idx") >= s0) & (F.col("idx") < s0 + n)
    d = _per_trace(d, [F.avg(F.when(use, F.col(c))).alias(f"_m_{c}") for c in cols], keys)
    return d.withColumns({c: F.col(c) - F.col(f"_m_{c}") + target for c in cols}).drop("_s", *[f"_m_{c}" for c in cols])


# ---------------------------------------------------------------- states


def relabel_states(tr: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """states renumbered by descending mean signal (per key, else over everything)."""
    keys = keys or []
    m = tr.groupBy(*keys, "state").agg(F.avg("signal").alias("m"))
    w = Window.partitionBy(*keys).orderBy(F.desc("m"), "state") if keys else Window.orderBy(F.desc("m"), "state")
    rank = m.withColumn("new_state", (F.row_number().over(w) - 1).cast("int")).drop("m")  # one row per state
    return tr.join(F.broadcast(rank) if not keys else rank, [*keys, "state"])


def transitions(tr: DataFrame, keys: list[str] = KEY, chunk_s: float = CHUNK_S) -> DataFrame:
    """Samples whose state differs from the previous one of the trace."""
    d = with_neighbors(chunk_by(tr, "t", chunk_s), keys, ORDER, prev={"prev_state": "state"}).drop("_chunk")
    return d.filter("prev_state <> state")


def transition_matrix(tr: DataFrame, k: int, by: list[str] | None = None, keys: list[str] = KEY) -> DataFrame:
    """Off-diagonal transition counts and row shares; empty rows 0, diagonal null."""
    by = by or []
    c = transitions(tr, keys).groupBy(*by, F.col("prev_state").alias("i"), F.col("state").alias("j")).agg(F.count("*").alias("n"))
    base = tr.select(*by).distinct() if by else tr.sparkSession.range(1).select()
    ks = F.sequence(F.lit(0), F.lit(k - 1))
    grid = base.withColumn("i", F.explode(ks)).withColumn("j", F.explode(ks))
    full = grid.join(c, [*by, "i", "j"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    row = F.sum("n").over(Window.partitionBy(*by, "i"))  # k cells per row
    p = F.when(F.col("i") == F.col("j"), F.lit(None)).otherwise(F.coalesce(F.try_divide(F.col("n").cast("double"), row.cast("double")), F.lit(0.0)))
    return full.withColumn("p", p)


def _segments(tr: DataFrame, keys: list[str], chunk_s: float) -> DataFrame:
    """Runs of one state: (keys, seg, state, t_first, t_last)."""
    d = chunk_by(tr, "t", chunk_s)
    d = with_neighbors(d, keys, ORDER, prev={"_ps": "state"})
    flag = (F.col("_ps").isNull() | (F.col("_ps") != F.col("state"))).cast("long")
    d = with_running(d, keys, ORDER, {"seg": flag})
    return d.groupBy(*keys, "seg", "state").agg(F.min("t").alias("t_first"), F.max("t").alias("t_last"), F.count("*").alias("n"))


def dwell_next(tr: DataFrame, keys: list[str] = KEY, chunk_s: float = CHUNK_S) -> DataFrame:
    """A dwell ends at the first sample of the next state, the last one at the last sample."""
    # the segment table is far smaller than the samples and is read twice below
    s = chunk_by(cut_lineage(_segments(tr, keys, chunk_s), "segments"), "seg", 4096)
    s = with_neighbors(s, keys, ["seg"], next={"_nt": "t_first"}).drop("_chunk")
    d = F.coalesce("_nt", "t_last") - F.col("t_first")
    return s.select(*keys, "seg", "state", "t_first", d.alias("dwell")).filter("dwell >= 0")


def dwell_last(tr: DataFrame, keys: list[str] = KEY, chunk_s: float = CHUNK_S) -> DataFrame:
    """A dwell ends at the last sample of its state; positive ones only."""
    s = _segments(tr, keys, chunk_s)
    return s.select(*keys, "seg", "state", "t_first", (F.col("t_last") - F.col("t_first")).alias("dwell")).filter("dwell > 0")


def cumulative_occupancy(tr: DataFrame, k: int, keys: list[str] = KEY, chunk_s: float = CHUNK_S) -> DataFrame:
    """Running share of each state's samples over distinct times, 1 at the end."""
    d = tr.groupBy(*keys, "t").agg(F.min_by("state", "ev").alias("state"))
    d = with_running(chunk_by(d, "t", chunk_s), keys, ["t"], {f"c{s}": (F.col("state") == s).cast("long") for s in range(k)}, totals=True)
    return d.select(*keys, "t", *[F.try_divide(F.col(f"c{s}").cast("double"), F.col(f"c{s}_total").cast("double")).alias(f"occ_{s}") for s in range(k)])


def occupancy(tr: DataFrame, by: list[str], weight: str = "samples", keys: list[str] = KEY, chunk_s: float = CHUNK_S) -> DataFrame:
    """Share of samples, or of time until the next sample, spent in each state."""
    if weight == "samples":
        w = tr.withColumn("_w", F.lit(1.0))
    else:
        w = with_neighbors(chunk_by(tr, "t", chunk_s), keys, ORDER, next={"_nt": "t"})
        w = w.withColumn("_w", F.coalesce(F.col("_nt") - F.col("t"), F.lit(0.0)))
    g = w.groupBy(*by, "state").agg(F.sum("_w").alias("weight"))
    tot = F.sum("weight").over(Window.partitionBy(*by)) if by else F.sum("weight").over(Window.partitionBy(F.lit(1)))
    return g.withColumn("occupancy", F.try_divide(F.col("weight"), tot))  # one row per state


def occupancy_sd(tr: DataFrame, k: int, blocks: int = 10, keys: list[str] = KEY) -> DataFrame:
    """Population sd over index blocks of the time-weighted occupancy; durations stay inside
    a block and are divided by its time span."""
    d = indexed(tr, keys)
    # edges floor(n*b/blocks): the block of i is the largest b with floor(n*b/blocks) <= i
    guess = F.floor(((F.col("idx") + 1) * blocks - 1) / F.col("n_rows"))
    d = d.withColumn("block", F.least(guess, F.lit(blocks - 1)))
    d = with_neighbors(d.withColumn("_chunk", F.floor(F.col("idx") / 65_536)), keys, ["idx"], next={"_nt": "t", "_nb": "block"})
    span = d.groupBy(*keys, "block").agg((F.max("t") - F.min("t")).alias("span"))
    dur = d.filter("_nb = block").groupBy(*keys, "block", "state").agg(F.sum(F.col("_nt") - F.col("t")).alias("dur"))
    grid = span.withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    f = grid.join(dur, [*keys, "block", "state"], "left").withColumn("f", F.try_divide(F.coalesce("dur", F.lit(0.0)), F.col("span")))
    return f.groupBy(*keys, "state").agg(F.stddev_pop("f").alias("sd"), F.avg("f").alias("mean"))


def state_signal(tr: DataFrame, by: list[str]) -> DataFrame:
    """X11: mean and population sd of the signal per state."""
    return tr.groupBy(*by, "state").agg(F.avg("signal").alias("mean"), F.stddev_pop("signal").alias("sd"), F.count("*").alias("n"))


def _histogram(v: DataFrame, keys: list[str], value: str, bins_expr) -> DataFrame:
    """Equal-width counts between min and max per key, every bin present."""
    ext = v.groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_b"), F.count("*").alias("_n"))
    flat = F.col("_a") == F.col("_b")
    ext = ext.select(*keys, "_n", F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_a"),
                     F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_b"), bins_expr.alias("_k"))
    j = v.join(ext, keys)
    b = F.least(F.floor((F.col(value) - F.col("_a")) / (F.col("_b") - F.col("_a")) * F.col("_k")), F.col("_k") - 1).cast("int")
    cnt = j.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("count"))
    grid = ext.withColumn("bin", F.explode(F.sequence(F.lit(0), (F.col("_k") - 1).cast("int"))))
    w = (F.col("_b") - F.col("_a")) / F.col("_k")
    return grid.join(cnt, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("_a") + (F.col("bin") + 0.5) * w).alias("x"), w.alias("width"), F.coalesce("count", F.lit(0)).alias("count"), F.col("_n").alias("total"))


def state_hist(tr: DataFrame, nb: int = 35, by: list[str] | None = None) -> DataFrame:
    """X11: density histogram of the signal per state with the fitted normal at bin centres."""
    keys = [*(by or []), "state"]
    h = _histogram(tr.select(*keys, "signal"), keys, "signal", F.lit(nb))
    h = h.withColumn("density", F.col("count") / (F.col("total") * F.col("width")))
    s = state_signal(tr, by or []).select(*keys, "mean", "sd")
    z = (F.col("x") - F.col("mean")) / F.col("sd")
    normal = F.when(F.col("sd") > 0, F.exp(-0.5 * z * z) / (F.col("sd") * F.sqrt(2 * F.pi())))
    return h.join(s, keys).withColumn("normal", normal).select(*keys, "bin", "x", "width", "count", "density", "normal")


def dwell_cdf(dwells: DataFrame, by: list[str], max_s: float = 5.0, min_bins: int = 1) -> DataFrame:
    """Binned empirical CDF of dwells below ``max_s`` with (0, 0) in front."""
    d = dwells.filter(F.col("dwell") < max_s).select(*by, "dwell")
    k = F.greatest(F.least(F.floor(F.sqrt("_n")), F.lit(50)), F.lit(min_bins))
    h = _histogram(d, by, "dwell", k)
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most 50 rows
    h = h.withColumn("cdf", F.sum("count").over(w) / F.col("total")).select(*by, (F.col("bin") + 1).alias("bin"), "x", "cdf", "count")
    zero = h.filter("bin = 1").select(*by, F.lit(0).alias("bin"), F.lit(0.0).alias("x"), F.lit(0.0).alias("cdf"), "count")
    return h.unionByName(zero)


# ---------------------------------------------------------------- model selection tables


def ic_table(ll: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """AIC, BIC and gain from rows (by, k, log_likelihood, n); K^2 + 2K - 1 parameters."""
    p = F.col("k") * F.col("k") + 2 * F.col("k") - 1
    t = ll.withColumn("aic", 2.0 * p - 2 * F.col("log_likelihood")).withColumn("bic", F.log(n) * p - 2 * F.col("log_likelihood"))
    w = Window.partitionBy(*by).orderBy("k")  # one row per K
    return t.withColumn("ll_ratio", F.col("log_likelihood") - F.lag("log_likelihood").over(w))


def clean_bic(t: DataFrame, by: str, cap: int) -> DataFrame:
    """Usable rows up to ``cap``, the lowest BIC per (by, K)."""
    return t.filter(F.col("k").isNotNull() & F.col("bic").isNotNull() & (F.col("k") <= cap)).groupBy(by, "k").agg(F.min("bic").alias("bic"))


def bic_consensus(t: DataFrame, by: str, cap: int = 5, elbow: float = 10.0) -> DataFrame:
    """K of lowest BIC per condition, of lowest mean BIC, and the first K whose mean gain
    falls below ``elbow``."""
    c = clean_bic(t, by, cap)
    per = c.groupBy(by).agg(F.min_by("k", F.struct("bic", "k")).alias("best_k"))
    mean = c.groupBy("k").agg(F.avg("bic").alias("m"))
    cons = mean.agg(F.min_by("k", F.struct("m", "k")).alias("consensus_k"))
    g = delta_prev_on_grid(c, by)
    mg = g.groupBy("k").agg(F.avg("gain").alias("g"))
    el = mg.filter(F.col("g") < elbow).agg(F.min("k").alias("elbow_k"))
    one = cons.withColumn("_k", F.lit(1)).join(el.withColumn("_k", F.lit(1)), "_k")
    return per.withColumn("_k", F.lit(1)).join(one, "_k").drop("_k")


def delta_prev_on_grid(c: DataFrame, by: str) -> DataFrame:
    """Previous minus current BIC on the shared K grid; a missing neighbour gives null."""
    ks = c.select("k").distinct()
    nxt = ks.select("k", F.lead("k").over(Window.orderBy("k")).alias("next_k"))  # one row per K
    prev = c.join(nxt, "k").filter("next_k IS NOT NULL").select(by, F.col("next_k").alias("k"), F.col("bic").alias("prev_bic"))
    return c.join(prev, [by, "k"], "left").select(by, "k", (F.col("prev_bic") - F.col("bic")).alias("gain"))


def ll_gain(t: DataFrame, by: str, cap: int = 5) -> DataFrame:
    """Log-likelihood gain per data point between consecutive K."""
    w = Window.partitionBy(by).orderBy("k")  # one row per K
    d = t.filter(F.col("k") <= cap).withColumn("prev_k", F.lag("k").over(w)).withColumn(
        "gain", (F.col("log_likelihood") - F.lag("log_likelihood").over(w)) / F.col("n"))
    return d.filter("prev_k IS NOT NULL").select(by, "prev_k", "k", "gain")


# ---------------------------------------------------------------- windows and labels


def sliding_windows(tr: DataFrame, win: int, step: int, keys: list[str] = KEY) -> DataFrame:
    """Every sample once per analysis window holding it; windows start at 0, step, ... and
    only a trace shorter than ``win`` has a truncated one."""
    d = indexed(tr, keys)
    i, n = F.col("idx"), F.col("n_rows")
    lo = F.greatest(F.ceil((i - win + 1) / step), F.lit(0))
    hi = F.least(F.floor(i / step), F.floor(F.greatest(n - win, F.lit(0)) / step))
    d = d.withColumn("_lo", lo).withColumn("_hi", hi).filter("_lo <= _hi")
    return d.withColumn("window", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


FAN = 1024  # blocks that one step of a chain folds into one row


def levels_of(last: int, fan: int = FAN) -> int:
    """Levels of a chain whose last block has the number ``last``: 1 while a key fits into one group."""
    n = 1
    while last >= fan:
        last, n = last // fan, n + 1
    return n


def whole_groups(df: DataFrame, keys: list[str], order: str, schema: str, many) -> DataFrame:
    """``many(rows, starts)`` over runs of whole groups: rows sorted by key and order, the first row of each group.

    A task goes through its sorted rows batch by batch and holds back the last group of a batch, so short groups
    cost no call each and no task holds more than a batch and one group. Rows without a key are left out.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for p in it:
            p = p if rest is None else pd.concat([rest, p], ignore_index=True)
            if not len(p):
                continue
            new = (p[keys] != p[keys].shift()).any(axis=1).to_numpy()
            new[0] = True
            starts = np.flatnonzero(new)
            cut = starts[-1]
            if cut:
                yield many(p.iloc[:cut], starts[:-1])
            rest = p.iloc[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield many(rest, np.zeros(1, np.int64))

    return df.dropna(subset=keys).repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)


def steps_of(starts: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(groups, rows) of the first, second, ... row of all groups that have one."""
    sizes = np.diff(np.append(starts, n))
    for t in range(sizes.max()):
        live = np.flatnonzero(sizes > t)
        yield live, starts[live] + t


def scan_blocks(summaries: DataFrame, keys: list[str], schema: str, fn, fold=None, carry: list[str] = (), levels: int = 1,
                fan: int = FAN, many=None) -> DataFrame:
    """Apply a sequential function to one small row per block, in block order, per key.

    With one level all rows of a key are one group. Beyond it ``fold`` turns each ``fan`` neighbouring rows into one
    row of the same columns, level by level, until a key has one group left; ``fn`` runs on that and its results go
    back down: on a lower group it also sees the columns ``carry`` of the group's own result, as ``in_<name>``. No
    task sees more than ``fan`` rows of a key, and the groups of a level run in parallel. ``many`` is ``fn`` for the
    rows of many keys at once (see ``whole_groups``); the top level, which has a row or more of every key, runs on it.
    """
    up = [cut_lineage(summaries, "chain") if levels > 1 else summaries]
    for _ in range(levels - 1):
        g = up[-1].withColumn("_g", F.floor(F.col("blk") / fan))
        rows = g.groupBy(*keys, "_g").applyInPandas(
            lambda p: fold(p.sort_values("blk", ignore_index=True)).assign(blk=p["_g"].iloc[0]), summaries.schema)
        up.append(cut_lineage(rows, "chain"))
    in_order = lambda p: fn(p.sort_values("blk", ignore_index=True))
    if many is not None:
        out = whole_groups(up[-1], keys, "blk", schema, many)
    else:
        out = up[-1].groupBy(*keys).applyInPandas(in_order, schema)
    for lower in reversed(up[:-1]):
        given = out.select(*keys, F.col("blk").alias("_g"), *[F.col(c).alias(f"in_{c}") for c in carry])
        g = lower.withColumn("_g", F.floor(F.col("blk") / fan)).join(given, [*keys, "_g"])
        out = g.groupBy(*keys, "_g").applyInPandas(in_order, schema)
    return out


def hysteresis(windows: DataFrame, models: list[str], delta: float = 8.0, keys: list[str] = KEY, block: int = 2048,
               fan: int = FAN) -> DataFrame:
    """Start at the best model; switch only when best - current >= delta.

    ``windows`` has (keys, w, <one column per model>). The rule is a function from the label
    before a block to the label after it, so blocks are folded independently for every possible
    start, the folds are chained per trace (one row per block, ``fan`` rows at a time), and labels are then written.
    """
    types = {f.name: f.dataType.simpleString() for f in windows.schema.fields}
    kdef = ", ".join(f"{k} {types[k]}" for k in keys)
    m = len(models)
    rows = F.sort_array(F.collect_list(F.struct(F.col("w").cast("long").alias("w"), F.array(*models).alias("s"))))
    blocks = windows.groupBy(*keys, F.floor(F.col("w") / block).alias("blk")).agg(rows.alias("rows"))

    def fold(scores: np.ndarray, cur: int) -> np.ndarray:
        out = np.empty(len(scores), dtype=np.int64)
        best = scores.argmax(axis=1)
        top = scores[np.arange(len(scores)), best]
        for i in range(len(scores)):
            if top[i] - scores[i, cur] >= delta:
                cur = best[i]
            out[i] = cur
        return out

    def ends(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            sc = [np.array([r["s"] for r in rs], dtype=float) for rs in p["rows"]]
            q = p[[*keys, "blk"]].copy()
            q["ends"] = [[int(fold(s, c)[-1]) for c in range(m)] for s in sc]
            q["first"] = [int(s[0].argmax()) for s in sc]
            yield q

    def fold_ends(p: pd.DataFrame) -> pd.DataFrame:
        to = np.arange(m)
        for e in p["ends"]:
            to = np.asarray(e)[to]
        return p[[*keys, "blk", "ends", "first"]].iloc[:1].assign(ends=[to.tolist()])

    def chain(p: pd.DataFrame) -> pd.DataFrame:
        cur, starts = int(p["in_start" if "in_start" in p else "first"].iloc[0]), []
        for e in p["ends"]:
            starts.append(cur)
            cur = int(e[cur])
        return p[[*keys, "blk"]].assign(start=starts)

    def chain_many(p: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        ends_of, cur = np.stack(p["ends"].to_numpy()), p["first"].to_numpy()[starts].astype(np.int64)
        enter = np.zeros(len(p), np.int64)
        for live, rows in steps_of(starts, len(p)):
            enter[rows] = cur[live]
            cur[live] = ends_of[rows, cur[live]]
        return p[[*keys, "blk"]].assign(start=enter)

    def label(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            parts = []
            for r in p.itertuples(index=False):
                s = np.array([x["s"] for x in r.rows], dtype=float)
                q = pd.DataFrame({k: getattr(r, k) for k in keys} | {"w": [x["w"] for x in r.rows]})
                q["label"] = [models[c] for c in fold(s, int(r.start))]
                parts.append(q)
            if parts:
                yield pd.concat(parts, ignore_index=True)

    last = windows.agg(F.max("w")).first()[0]
    starts = scan_blocks(
        blocks.mapInPandas(ends, f"{kdef}, blk long, ends array<long>, first long"), keys, f"{kdef}, blk long, start long", chain,
        fold_ends, ["start"], levels_of((last or 0) // block, fan), fan, chain_many)
    return blocks.join(starts, [*keys, "blk"]).mapInPandas(label, f"{kdef}, w long, label string")


def collapse_spikes(labels: DataFrame, keys: list[str] = KEY, block: int = 4096) -> DataFrame:
    """A single window between two equal neighbours takes their label (raw labels tested)."""
    d = with_neighbors(chunk_by(labels, "w", block), keys, ["w"], prev={"_p": "label"}, next={"_n": "label"}).drop("_chunk")
    spike = (F.col("_p") == F.col("_n")) & (F.col("label") != F.col("_p"))
    return d.withColumn("label", F.when(spike, F.col("_p")).otherwise(F.col("label"))).drop("_p", "_n")


def label_runs(labels: DataFrame, keys: list[str] = KEY, block: int = 4096) -> DataFrame:
    """Runs of equal labels: (keys, run, label, w_first, w_last, n)."""
    d = with_neighbors(chunk_by(labels, "w", block), keys, ["w"], prev={"_p": "label"})
    d = with_running(d, keys, ["w"], {"run": (F.col("_p").isNull() | (F.col("_p") != F.col("label"))).cast("long")})
    return d.groupBy(*keys, "run", "label").agg(F.min("w").alias("w_first"), F.max("w").alias("w_last"), F.count("*").alias("n"))


def min_run(labels: DataFrame, m: int = 3, keys: list[str] = KEY, block: int = 4096) -> DataFrame:
    """Runs shorter than ``m`` join the run before them, a short first run the one after it.

    Going left to right, every run ends up with the label of the last run that kept its own;
    run 2 keeps its own in any case after a short run 1 has taken it. Equal neighbours are
    merged again: (keys, w_first, w_last, label). Each step reads the table before it twice, so
    the small run tables are written to the shared folder in between.
    """
    runs = cut_lineage(label_runs(cut_lineage(labels, "labels"), keys, block), "runs")
    r = chunk_by(runs, "run", block)
    r = with_neighbors(r, keys, ["run"], prev={"_pn": "n"}, next={"_nl": "label"})
    first = F.col("run") == 1
    own = (F.col("n") >= m) | (first & F.col("_nl").isNull()) | ((F.col("run") == 2) & (F.col("_pn") < m))
    anchor = F.when(first & (F.col("n") < m) & F.col("_nl").isNotNull(), F.col("_nl")).when(own, F.col("label"))
    r = r.withColumn("_a", anchor)
    r = with_running(r, keys, ["run"], {"_g": F.col("_a").isNotNull().cast("long")})
    g = r.groupBy(*keys, "_g").agg(F.max("_a").alias("label"), F.min("w_first").alias("w_first"), F.max("w_last").alias("w_last"))
    g = chunk_by(cut_lineage(g, "merged"), "_g", block)
    g = with_neighbors(g, keys, ["_g"], prev={"_p": "label"})
    g = with_running(g, keys, ["_g"], {"_s": (F.col("_p").isNull() | (F.col("_p") != F.col("label"))).cast("long")})
    return g.groupBy(*keys, "_s", "label").agg(F.min("w_first").alias("w_first"), F.max("w_last").alias("w_last")).drop("_s")


def regime_summary(tr: DataFrame, regimes: list[str], by: list[str] = KEY, chunk_s: float = CHUNK_S) -> DataFrame:
    """Samples, switches and share of each regime per trace."""
    d = with_neighbors(chunk_by(tr, "t", chunk_s), by, ORDER, prev={"_p": "regime"})
    return d.groupBy(*by).agg(
        F.count("*").alias("n_samples"), F.count_if(F.col("_p") != F.col("regime")).alias("switches"),
        *[F.avg((F.col("regime") == r).cast("int")).alias(f"frac_{r}") for r in regimes])
