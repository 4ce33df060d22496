"""Correlations, rank tests, corrections and model scores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlight.functions.tails import chi2_p, norm_p, pearson_p, rank_sum_p, signed_rank_p
from strandlight.ordered import value_chunks, with_index, with_running
from strandlight.session import broadcast_if_small, cut_lineage

Z95 = 1.959963984540054  # fixed value: 97.5% normal quantile


def corr_tracks(bp: DataFrame, signals: DataFrame, bins: list[int]) -> DataFrame:
    """D23 + C21: Pearson r and n per (track, bin) over motifs with both values."""
    b = bp.filter(F.col("zf").isin(bins) & F.col("binding_prob").isNotNull()).select("motif_id", "zf", "binding_prob")
    j = b.join(signals.filter("signal IS NOT NULL"), "motif_id")
    x, y = F.col("binding_prob"), F.col("signal")
    g = j.groupBy("track", "zf").agg(
        F.count("*").alias("n"), F.corr("binding_prob", "signal").alias("r0"), F.min(x).alias("x0"), F.max(x).alias("x1"),
        F.min(y).alias("y0"), F.max(y).alias("y1"),
    )
    ok = (F.col("n") >= 2) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
    return g.select("track", "zf", "n", F.when(ok, F.col("r0")).alias("r"))


def corr_table(bp: DataFrame, signals: DataFrame, bins: list[int]) -> DataFrame:
    """D23 with p-values and Benjamini-Hochberg over all cells, missing p excluded."""
    r = corr_tracks(bp, signals, bins)
    p = pearson_p(F.col("r"), F.col("n"))
    t = r.withColumn("p", F.when(F.col("r").isNotNull(), p))
    t = t.withColumn("p", F.when(~F.isnan("p"), F.col("p")))
    return bh_adjust(t, "p", missing="exclude")


def bh_adjust(df: DataFrame, p: str, out: str = "p_adj", missing: str = "exclude") -> DataFrame:
    """Step-up adjustment over all rows; a missing p is left out or counts as 1."""
    base = df.withColumn("_p", F.coalesce(F.col(p), F.lit(1.0)) if missing == "one" else F.col(p))
    # ranks per distinct p: every row of a tie takes the highest rank, as the running minimum would
    cnt = base.filter("_p IS NOT NULL").groupBy("_p").agg(F.count("*").alias("_c"))
    run = with_running(value_chunks(cnt, "_p").withColumn("_all", F.lit(1)), ["_all"], ["_p"], {"_k": F.col("_c")}, totals=True)
    run = run.withColumn("_q", F.least(F.col("_p") * F.col("_k_total") / F.col("_k"), F.lit(1.0)))
    per = run.groupBy("_chunk").agg(F.min("_q").alias("_m"))
    # from the top down: a frame that ends with the window is summed anew for every row
    after = Window.orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
    per = per.select("_chunk", F.min("_m").over(after).alias("_m"))
    inner = Window.partitionBy("_chunk").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    run = run.withColumn("_q", F.min("_q").over(inner)).join(per, "_chunk")
    run = run.select("_p", F.least("_q", F.coalesce("_m", F.lit(1.0))).alias(out))
    return base.join(run, "_p", "left").drop("_p")


def _ranked_counts(cnt: DataFrame, keys: list[str], value: str, parts: list[str]) -> DataFrame:
    """Adds to rows (keys, value) with the counts ``parts`` their sum ``c`` and the tie-averaged ``rank`` of the value
    in its key. ``cnt`` is read several times and should be a table."""
    cnt = value_chunks(cnt.withColumn("c", F.expr(" + ".join(parts))), value)
    return with_running(cnt, keys, [value], {"_run": F.col("c")}).withColumn("rank", F.col("_run") - (F.col("c") - 1) / 2.0)


def _tie_term():
    """Sum over groups of ties of (c^3 - c), from their counts."""
    c = F.col("c").cast("double")
    return F.sum(c * (c * c - 1))


def pairwise_wilcoxon(bp: DataFrame, bins: list[int]) -> DataFrame:
    """Paired signed-rank statistic for every bin pair over shared motifs.

    A motif contributes one row per pair of reported bins (a fixed short list). Equal pairs of values are counted in the
    one pass over the motifs; everything else comes from the counts.
    """
    v = bp.filter(F.col("zf").isin(bins) & F.col("binding_prob").isNotNull())
    wide = v.groupBy("motif_id").agg(*[F.max(F.when(F.col("zf") == z, F.col("binding_prob"))).alias(f"v{i}") for i, z in enumerate(bins)])
    both = [F.struct(F.lit(a).alias("bin1"), F.lit(b).alias("bin2"), F.col(f"v{i}").alias("x"), F.col(f"v{j}").alias("y"))
            for i, a in enumerate(bins) for j, b in enumerate(bins) if i < j]
    d = wide.filter("motif_id IS NOT NULL").select(F.explode(F.array(*both)).alias("p")).select("p.*").filter("x IS NOT NULL AND y IS NOT NULL")
    keys = ["bin1", "bin2"]
    d = cut_lineage(d.groupBy(*keys, "x", "y").agg(F.count("*").alias("n")), "pairs").withColumn("d", F.col("x") - F.col("y"))
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    means = d.groupBy(*keys).agg(
        F.sum("n").alias("n_paired"), mean("x").alias("mean1"), mean("y").alias("mean2"),
        count(F.col("d") == 0).alias("n_zero"), F.max(F.abs("d")).alias("top"),
    )
    ad = d.filter("d <> 0").groupBy(*keys, F.abs("d").alias("ad")).agg(
        count(F.col("d") > 0).alias("n_plus"), count(F.col("d") < 0).alias("n_minus"))
    w = _ranked_counts(ad, keys, "ad", ["n_plus", "n_minus"]).groupBy(*keys).agg(
        F.sum(F.col("n_plus") * F.col("rank")).alias("w_plus"), F.sum(F.col("n_minus") * F.col("rank")).alias("w_minus"),
        F.sum("c").alias("n_used"), _tie_term().alias("tie_term"),
    )
    out = means.join(w, keys, "left")
    flat = F.col("top") <= 1e-8
    return out.select(
        *keys, "n_paired", F.coalesce("n_used", F.lit(0)).alias("n_used"), "n_zero", "mean1", "mean2",
        (F.col("mean1") - F.col("mean2")).alias("delta_mean"),
        F.when(flat, 0.0).otherwise(F.least("w_plus", "w_minus")).alias("stat"),
        F.coalesce("tie_term", F.lit(0.0)).alias("tie_term"), flat.alias("flat"),
    )


def pairwise_tests(bp: DataFrame, bins: list[int], method: str = "wilcoxon", alpha: float = 0.05, p_method: str = "auto") -> DataFrame:
    """Statistics with p, Benjamini-Hochberg (missing p counts as 1) and the verdict.

    ``p_method``: ``normal`` (tie-corrected), ``exact`` (null where ties or zeros rule it out), or
    ``auto``, the rule of the common statistics library: exact without ties or zeros for at most 50
    differences (signed ranks) or at most 8 values in the smaller sample (rank sums), else normal.
    """
    if p_method not in ("auto", "exact", "normal"):
        raise ValueError(p_method)
    if method == "wilcoxon":
        t = pairwise_wilcoxon(bp, bins)
        p = signed_rank_p(F.col("stat"), F.col("n_used"), F.col("tie_term"), F.col("n_zero"), F.lit(p_method))
        t = t.withColumn("p_value", F.when(F.col("flat"), 1.0).otherwise(p)).drop("flat")
    else:
        v = bp.filter(F.col("zf").isin(bins) & F.col("binding_prob").isNotNull())
        v = cut_lineage(v.groupBy("zf", "binding_prob").agg(F.count("*").alias("n")), "values")
        order = {z: i for i, z in enumerate(bins)}
        pairs = [(a, b) for a in bins for b in bins if order[a] < order[b]]
        hits = F.array_compact(F.array(*[
            F.when(F.col("zf").isin(a, b), F.struct(F.lit(a).alias("bin1"), F.lit(b).alias("bin2"))) for a, b in pairs]))
        rows = v.select("zf", "binding_prob", "n", F.explode(hits).alias("k")).select("k.*", "zf", "binding_prob", "n")
        rows = rows.groupBy("bin1", "bin2", "binding_prob").agg(*[
            F.sum(F.when(F.col("zf") == F.col(b), F.col("n")).otherwise(0)).alias(c) for b, c in (("bin1", "c1"), ("bin2", "c2"))])
        t = _rank_sums(rows, ["bin1", "bin2"], "binding_prob").withColumn("stat", F.col("u1"))
        t = t.withColumn("p_value", rank_sum_p(F.col("u1"), F.col("n1"), F.col("n2"), F.col("tie_term"), F.lit(p_method)))
    t = cut_lineage(t.withColumn("p_value", F.when(~F.isnan("p_value"), F.col("p_value"))), "tests")  # read several times below
    return bh_adjust(t, "p_value", missing="one").withColumn("significant", (F.col("p_adj") < alpha).cast("int"))


def rank_sums(
    df: DataFrame, keys: list[str], side: str, value: str
) -> DataFrame:
    """Tie-averaged rank sums and U of sides 1 and 2 per key, with the tie term.

    The rows are read once, for the counts of each value. Rows without a side belong to no sample; a null key has no row.
    """
    one = F.col(side) == 1
    cnt = df.filter(F.col(value).isNotNull() & F.col(side).isNotNull()).groupBy(*keys, value).agg(
        F.count_if(one).alias("c1"), F.count_if(~one).alias("c2"))
    return _rank_sums(cut_lineage(cnt, "values"), keys, value)


def _rank_sums(cnt: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rank_sums`` from the counts ``c1`` and ``c2`` of each value on the two sides."""
    g = _ranked_counts(cnt, keys, value, ["c1", "c2"]).groupBy(*keys).agg(
        F.sum("c1").alias("n1"), F.sum("c2").alias("n2"),
        *[F.sum(F.col(f"c{i}") * F.col("rank")).alias(f"r{i}") for i in (1, 2)], _tie_term().alias("tie_term"),
        *[F.try_divide(F.sum(F.when(F.col(f"c{i}") > 0, F.col(f"c{i}") * F.col(value))), F.sum(f"c{i}").cast("double")).alias(f"mean{i}") for i in (1, 2)],
    )
    n1 = F.col("n1")
    g = g.withColumn("u1", F.col("r1") - n1 * (n1 + 1) / 2.0).withColumn("u2", n1 * F.col("n2") - F.col("u1"))
    return g.withColumn("u", F.least("u1", "u2"))


def _sd_u():
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    inner = (n + 1) - F.try_divide(F.col("tie_term"), (n * (n - 1)).cast("double"))
    return F.sqrt(n1 * n2 / 12.0 * inner)


def mann_whitney(
    df: DataFrame, keys: list[str], side: str, value: str
) -> DataFrame:
    """With the tie-corrected normal p, no continuity correction."""
    return _normal_p(rank_sums(df, keys, side, value))


def _normal_p(g: DataFrame) -> DataFrame:
    g = g.withColumn("sd_u", _sd_u())
    z = F.when(F.col("sd_u") > 0, (F.col("u") - F.col("n1") * F.col("n2") / 2.0) / F.col("sd_u")).otherwise(0.0)
    return g.withColumn("z", z).withColumn("p_value", norm_p(F.col("z")))


def order_statistics(df: DataFrame, keys: list[str], value: str, picks: DataFrame) -> DataFrame:
    """The values at 1-based positions ``picks`` (keys, name, k) of each key's sorted values."""
    return _order_statistics(_value_counts(df, keys, value), keys, value, picks)


def _value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    cnt = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    return cut_lineage(cnt, "values")


def _order_statistics(cnt: DataFrame, keys: list[str], value: str, picks: DataFrame) -> DataFrame:
    run = with_running(value_chunks(cnt, value), keys, [value], {"_hi": F.col("_c")})
    j = run.join(F.broadcast(picks), keys).filter("k <= _hi AND k > _hi - _c")  # a few positions per key
    return j.select(*keys, "name", F.col(value).alias("v"))


def median_ci(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """S3: median and the order-statistic 95% interval per key."""
    return _median_ci(_value_counts(df, keys, value), keys, value)


def _median_ci(cnt: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``median_ci`` from the counts ``_c`` of each value."""
    n = cnt.groupBy(*keys).agg(F.sum("_c").alias("n"))
    rad = 0.5 * Z95 * F.sqrt("n")
    pos = {
        "m1": F.floor((F.col("n") + 1) / 2), "m2": F.floor(F.col("n") / 2) + 1,
        "lo": F.greatest(F.lit(1), F.floor(F.col("n") * 0.5 - rad)),
        "hi": F.least(F.col("n"), F.ceil(F.col("n") * 0.5 + rad)),
    }
    picks = n.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(k).alias("name"), e.cast("long").alias("k")) for k, e in pos.items()])).alias("x")).select(*keys, "x.*")
    s = _order_statistics(cnt, keys, value, picks)
    pick = lambda k: F.max(F.when(F.col("name") == k, F.col("v")))
    out = s.groupBy(*keys).agg(((pick("m1") + pick("m2")) / 2).alias("median"), pick("lo").alias("ci_low"), pick("hi").alias("ci_high"))
    return out.join(n, keys)


def _pairs_below(x: DataFrame, y: DataFrame, cuts: DataFrame) -> DataFrame:
    """For each (key, cut) the number of pairs with y <= x + cut, by one merged running count."""
    cuts = broadcast_if_small(cuts)
    none = F.lit(0).cast("long")
    xs = x.join(cuts, "key").select("key", "cut", (F.col("v") + F.col("cut")).alias("v"), F.col("c").alias("cx"), none.alias("cy"))
    ys = y.join(cuts, "key").select("key", "cut", "v", none.alias("cx"), F.col("c").alias("cy"))
    both = xs.unionByName(ys).groupBy("key", "cut", "v").agg(F.sum("cx").alias("cx"), F.sum("cy").alias("cy"))
    run = with_running(value_chunks(both, "v"), ["key", "cut"], ["v"], {"below": F.col("cy")})
    return run.groupBy("key", "cut").agg(F.sum(F.col("cx") * F.col("below")).alias("n_below"))


def _shift_facts(cnt: DataFrame) -> DataFrame:
    """Per key with both sides: the number of differences and the positions of the median and the interval."""
    both = cnt.groupBy("key", "v").agg(*[
        F.sum(F.when(F.col("s") == i, F.col("c")).otherwise(0)).alias(f"c{i}") for i in (1, 2)])
    c = (F.col("c1") + F.col("c2")).cast("double")
    ext = both.groupBy("key").agg(
        F.sum("c1").alias("n1"), F.sum("c2").alias("n2"), F.sum(c * c * c - c).alias("tie_term"),
        *[f(F.when(F.col(f"c{i}") > 0, F.col("v"))).cast("double").alias(f"{n}{e}")
          for i, n in ((1, "x"), (2, "y")) for e, f in ((0, F.min), (1, F.max))])
    n, k = F.col("n_pairs"), F.col("_k")
    ext = ext.filter("n1 > 0 AND n2 > 0").withColumn("n_pairs", F.col("n1") * F.col("n2"))
    ext = ext.withColumn("_k", F.floor(n / 2.0 - Z95 * F.coalesce(_sd_u(), F.lit(0.0))))
    return ext.select(
        "key", "n_pairs", *[F.col(f"{a}{b}") for a in "xy" for b in (0, 1)],
        F.floor((n + 1) / 2).alias("m1"), (F.floor(n / 2) + 1).alias("m2"),
        F.greatest(F.lit(1), k + 1).alias("low"), F.least(n, n - k).alias("high"),
        (1 + sum(F.abs(F.col(f"{a}{b}")) for a in "xy" for b in (0, 1))).alias("span"))


def _narrow(x: DataFrame, y: DataFrame, b: DataFrame, fan: int, enough: int) -> DataFrame:
    """Brackets (key, q, span, lo, n_lo, hi, n_hi) around the q-th difference, narrowed until each holds at most
    ``enough`` differences or has shrunk to one repeated difference. All keys and positions move in one job per
    round; they stay in the table and only whether one is still wide comes back."""
    while True:
        wide = b.filter((F.col("n_hi") - F.col("n_lo") > enough) & (F.col("hi") - F.col("lo") > 1e-10 * F.col("span")))
        if wide.isEmpty():
            return b
        step = (F.col("hi") - F.col("lo")) / fan
        cuts = wide.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.lit(fan - 1)), lambda i: F.col("lo") + step * i)).alias("cut")).distinct()
        seen = wide.join(_pairs_below(x, y, cuts), "key")
        at = F.struct("cut", "n_below")
        moved = seen.groupBy("key", "q").agg(
            F.max(F.when((F.col("n_below") < F.col("q")) & (F.col("cut") > F.col("lo")), at)).alias("_up"),
            F.min(F.when((F.col("n_below") >= F.col("q")) & (F.col("cut") < F.col("hi")), at)).alias("_down"))
        b = cut_lineage(b.join(moved, ["key", "q"], "left").select(
            "key", "q", "span", F.coalesce("_up.cut", "lo").alias("lo"), F.coalesce("_up.n_below", "n_lo").alias("n_lo"),
            F.coalesce("_down.cut", "hi").alias("hi"), F.coalesce("_down.n_below", "n_hi").alias("n_hi")), "brackets")


def hodges_lehmann(df: DataFrame, key: str, side: str, value: str, fan: int = 64, enough: int = 50_000) -> DataFrame:
    """S3: median of all differences y - x (side 2 minus side 1) and its 95% interval, exactly, per key.

    The n1*n2 differences are the entries of a matrix sorted both ways and are never listed: brackets around the
    wanted order statistics live in a DataFrame and narrow by counting pairs below trial shifts; what a bracket
    still holds at the end (few, or one value many times) is then listed as distinct value pairs. Keys with few
    differences are listed at once. Keys without one of the sides have no row; a null key has none either.
    """
    return _hodges_lehmann(_side_counts(df, key, side, value), key, fan, enough)


def _side_counts(df: DataFrame, key: str, side: str, value: str) -> DataFrame:
    cnt = df.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("key"), F.col(side).alias("s"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    return cut_lineage(cnt, "values")


def _hodges_lehmann(cnt: DataFrame, key: str, fan: int = 64, enough: int = 50_000) -> DataFrame:
    """``hodges_lehmann`` from the counts ``c`` of each (key, side s, value v)."""
    x, y = cnt.filter("s = 1").drop("s"), cnt.filter("s = 2").drop("s")
    facts = cut_lineage(_shift_facts(cnt), "shifts")
    pad = 1e-9 * F.col("span")
    start = facts.select("key", "span", (F.col("y0") - F.col("x1") - pad).alias("lo"), F.lit(0).cast("long").alias("n_lo"),
                         (F.col("y1") - F.col("x0") + pad).alias("hi"), F.col("n_pairs").alias("n_hi"),
                         F.explode(F.array_distinct(F.array("m1", "m2", "low", "high"))).alias("q"))
    b = _narrow(x, y, start.select("key", "q", "span", "lo", "n_lo", "hi", "n_hi"), fan, enough)
    spans = broadcast_if_small(b.select("key", "q", "lo", "hi", (F.col("q") - F.col("n_lo")).alias("pick")))
    width = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12))
    xs = x.join(spans, "key").withColumn("b", F.explode(F.sequence(
        F.floor((F.col("v") + F.col("lo")) / width), F.floor((F.col("v") + F.col("hi")) / width))))
    ys = y.join(spans.select("key", "q", "lo", "hi"), "key").select(
        "key", "q", F.floor(F.col("v") / width).alias("b"), F.col("v").alias("yv"), F.col("c").alias("yc"))
    near = xs.join(ys, ["key", "q", "b"]).filter("yv <= v + hi AND NOT yv <= v + lo").select(
        "key", "q", "pick", (F.col("yv") - F.col("v")).alias("d"), (F.col("c") * F.col("yc")).alias("w"))
    near = near.groupBy("key", "q", "pick", "d").agg(F.sum("w").alias("w"))
    run = with_running(value_chunks(near, "d"), ["key", "q"], ["d"], {"hi_": F.col("w")})
    got = run.filter("pick <= hi_ AND pick > hi_ - w").select("key", "q", "d")
    names = ("m1", "m2", "low", "high")
    wanted = facts.select("key", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("q")) for n in names])).alias("w"))
    at = wanted.select("key", "w.*").join(got, ["key", "q"]).groupBy("key").agg(
        *[F.max(F.when(F.col("name") == n, F.col("d"))).alias(n) for n in names])
    return at.select(F.col("key").alias(key), ((F.col("m1") + F.col("m2")) / 2).alias("hl"), F.col("low").alias("hl_low"), F.col("high").alias("hl_high"))


def rank_test_table(df: DataFrame, key: str, side: str, value: str) -> DataFrame:
    """S3: one row per key: medians with intervals, Low - High difference, shift, U, p, marks.

    The rows are read once, for the counts of each value; all parts come from these.
    """
    from strandlight.functions.calls import stars

    cnt = _side_counts(df, key, side, value)
    of = lambda i: cnt.filter(F.col("s") == i).select(F.col("key").alias(key), "v", F.col("c").alias("_c"))
    a, b = _median_ci(of(1), [key], "v"), _median_ci(of(2), [key], "v")
    ren = lambda t, s: t.select(key, *[F.col(c).alias(f"{c}_{s}") for c in ("median", "ci_low", "ci_high")])
    both = cnt.filter("s IS NOT NULL").groupBy(F.col("key").alias(key), "v").agg(*[
        F.sum(F.when(on, F.col("c")).otherwise(0)).alias(n) for n, on in (("c1", F.col("s") == 1), ("c2", F.col("s") != 1))])
    m = _normal_p(_rank_sums(both, [key], "v")).select(key, "n1", "n2", "r1", "r2", "u", "p_value")
    t = m.join(ren(a, "high"), key).join(ren(b, "low"), key).join(_hodges_lehmann(cnt, key), key)
    return t.withColumn("difference", F.col("median_low") - F.col("median_high")).withColumn("stars", stars("p_value"))


def chi2_gof(df: DataFrame, keys: list[str], observed: str, expected: str) -> DataFrame:
    """Chi-square with the expected counts rescaled to the observed total."""
    o, e = F.col(observed), F.col(expected)
    # sum (o - e*s)^2/(e*s) with s = O/E equals sum(o^2/e) * E/O - O
    g = df.groupBy(*keys).agg(F.sum(o).alias("_o"), F.sum(e).alias("_e"), F.sum(o * o / e).alias("_q"), F.count("*").alias("_n"))
    g = g.select(*keys, (F.col("_q") * F.col("_e") / F.col("_o") - F.col("_o")).alias("chi2"), (F.col("_n") - 1).alias("dof"))
    return g.withColumn("p_value", chi2_p(F.col("chi2"), F.col("dof")))


def two_barrier(occ: list[float], x12: float, x23: float, kT: float = 4.1, force: float | None = 12.0) -> dict[str, float]:
    """Energies of a three-state Boltzmann model from occupancies at ``force``; with ``force``
    None the force term is left out."""
    d12 = -kT * math.log(occ[1] / occ[0])
    d23 = -kT * math.log(occ[2] / occ[1])
    f = force or 0.0
    return dict(g12=d12 + f * x12, g23=d23 + f * x23, x12=x12, x23=x23, kT=kT)


def score_models(occ: DataFrame, m: dict[str, float], constant: float, k_model: int = 2) -> DataFrame:
    """Model value and slope per trace summed to chi-square, log-likelihood, AIC and BIC.

    ``occ`` has force, force_se, p_obs and p_se, one row per trace. Rows that lack a value or have no positive p_se
    cannot be scored; ``n_left_out`` says how many.
    """
    ok = (F.col("p_se") > 0) & ~F.isnan("p_se") & F.col("p_obs").isNotNull() & F.col("force").isNotNull() & F.col("force_se").isNotNull()
    occ = occ.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumns({c: F.when(F.col("_ok"), F.col(c)) for c in ("p_obs", "p_se")})
    f, kT = F.col("force"), m["kT"]
    e12 = F.exp(-(m["g12"] - f * m["x12"]) / kT)
    e23 = F.exp(-(m["g12"] - f * m["x12"] + m["g23"] - f * m["x23"]) / kT)
    den = 1 + e12 + e23
    slope = (-m["x12"] * e12 - (m["x12"] + m["x23"]) * e23) / (kT * den * den)
    t = occ.withColumn("p_model", 1 / den).withColumn("slope", slope)
    comb = F.sqrt(F.col("p_se") ** 2 + (F.col("slope") * F.col("force_se")) ** 2)
    ll = lambda p: -0.5 * F.sum(((F.col("p_obs") - p) / F.col("p_se")) ** 2 + F.log(2 * math.pi * F.col("p_se") ** 2))
    g = t.agg(
        F.count_if("_ok").alias("n"), F.count_if(~F.col("_ok")).alias("n_left_out"),
        F.sum(((F.col("p_obs") - F.col("p_model")) / comb) ** 2).alias("chi_model"),
        F.sum(((F.col("p_obs") - constant) / F.col("p_se")) ** 2).alias("chi_const"),
        ll(F.col("p_model")).alias("ll_model"), ll(F.lit(constant)).alias("ll_const"),
    )
    row = lambda name, k, chi, l, dof: F.struct(
        F.lit(name).alias("model"), F.col(chi).alias("chi2"), (F.col("n") - dof).alias("dof"), F.col(l).alias("log_lik"),
        (2.0 * k - 2 * F.col(l)).alias("aic"), (k * F.log("n") - 2 * F.col(l)).alias("bic"), F.col("n_left_out"))
    g = g.select(F.explode(F.array(row("two_barrier", k_model, "chi_model", "ll_model", 2), row("constant", 1, "chi_const", "ll_const", 1))).alias("x")).select("x.*")
    return g.withColumn("p_value", chi2_p(F.col("chi2"), F.col("dof")))
