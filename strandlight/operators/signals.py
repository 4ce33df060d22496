"""Signal tracks, region matrices and quantile bins."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlight.operators.intervals import overlap_join
from strandlight.ordered import chunk_by, value_chunks, with_index, with_running
from strandlight.session import broadcast_if_small, cut_lineage


def clamp_interval(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """Clamp to [0, chromosome length); unknown chromosomes and empty results become null."""
    j = df.join(broadcast_if_small(sizes.select("chrom", "length")), "chrom", "left")
    s = F.greatest(F.col("start"), F.lit(0))
    e = F.least("end", "length")
    ok = F.col("length").isNotNull() & (e > s)
    return j.withColumn("_s", F.when(ok, s)).withColumn("_e", F.when(ok, e)).drop("start", "end", "length").withColumnsRenamed(
        {"_s": "start", "_e": "end"}
    )


def track_stat(
    motifs: DataFrame, track: DataFrame, half: int, sizes: DataFrame | None = None, id_col: str = "motif_id",
    bin_size: int = 2048,
) -> DataFrame:
    """Mean, median and max over the bases of [c-half, c+half) (the base at c when half = 0).

    Per-base statistics come from interval overlaps weighted by their length; the median uses
    the frequency argument of the exact percentile. Sites without signal keep nulls.
    """
    c = F.col("center")
    win = motifs.select(id_col, "chrom", (c - half).alias("start"), (c + (half if half > 0 else 1)).alias("end"))
    if sizes is not None:
        win = clamp_interval(win, sizes)
    j = overlap_join(
        win.filter("start IS NOT NULL"), track.filter("value IS NOT NULL AND NOT isnan(value)"), bin_size=bin_size
    )
    n = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    # equal values of a site share a row, so each percentile buffer holds distinct values only
    per = j.groupBy(F.col(f"a_{id_col}").alias(id_col), F.col("b_value").alias("v")).agg(F.sum(n).alias("n"))
    st = per.groupBy(id_col).agg(
        F.expr("sum(v * n) / sum(n) AS mean"), F.expr("percentile(v, 0.5D, n) AS median"), F.max("v").alias("max")
    )
    return win.select(id_col).join(st, id_col, "left")


def missing_as_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sites without signal count as zero."""
    return df.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in cols})


def no_data_sites(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sites where every statistic is missing."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNull()
    return df.filter(cond)


def quantile_counts(df: DataFrame, q: str = "quantile") -> DataFrame:
    """Sites per quantile, null included."""
    return df.groupBy(q).agg(F.count("*").alias("n"))


def exact_percentiles(df: DataFrame, value: str, ps: list[float]) -> list[float] | None:
    """Linear-interpolated percentiles of a whole column by distributed ranking: only the two
    neighbours of each position reach the driver."""
    cnt = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    run = with_running(value_chunks(cnt, value).withColumn("_all", F.lit(1)), ["_all"], [value],
                       {"_hi": F.col("_c")}, totals=True).persist()
    try:
        top = run.agg(F.max("_hi_total")).first()[0]
        if not top:
            return None
        pos = [(top - 1) * p for p in ps]
        want = sorted({math.floor(x) for x in pos} | {math.ceil(x) for x in pos})
        hit = F.filter(F.array(*[F.lit(w).cast("long") for w in want]),
                       lambda w: (w < F.col("_hi")) & (w >= F.col("_hi") - F.col("_c")))
        at = {r[0]: r[1] for r in run.select(F.explode(hit).alias("w"), value).collect()}
    finally:
        run.unpersist()
    out = []
    for x in pos:
        lo, hi = at[math.floor(x)], at[math.ceil(x)]
        out.append(lo + (hi - lo) * (x - math.floor(x)))
    return out


def average_ranks(
    df: DataFrame, value: str, keys: list[str] | None = None, out: str = "rank",
    rows: int = 50_000,
) -> DataFrame:
    """Tie-averaged ranks (1-based) per key, through counts of distinct values.

    The values are counted first, the running count goes over distinct values in chunks, and the
    ranks are joined back by value: no task sees all rows of a key.
    """
    keys = keys or []
    base = df.filter(F.col(value).isNotNull())
    cnt = base.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    cnt = value_chunks(cnt, value, rows)
    tagged = cnt if keys else cnt.withColumn("_all", F.lit(1))
    kk = keys or ["_all"]
    run = with_running(tagged, kk, [value], {"_run": F.col("_c")}, totals=True)
    run = run.select(*keys, value, (F.col("_run") - (F.col("_c") - 1) / 2.0).alias(out), F.col("_c").alias("ties"),
                     F.col("_run_total").alias("n_key"))
    return df.join(run, [*keys, value], "left")


def quantile_rank(df: DataFrame, value: str, q: int, out: str = "quantile") -> DataFrame:
    """ceil(rank * q / max rank) of tie-averaged ranks, within 1..q."""
    r = average_ranks(df, value, out="_rank")
    cnt = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    n, last = cnt.agg(F.sum("_c"), F.max_by("_c", value)).first()
    top = n - (last - 1) / 2.0 if n else 1.0  # rank of the highest value
    e = F.greatest(F.least(F.ceil(F.col("_rank") * q / top), F.lit(q)), F.lit(1)).cast("int")
    return r.withColumn(out, F.when(F.col("_rank").isNotNull(), e)).drop("_rank", "ties", "n_key")


def quantile_cut(df: DataFrame, value: str, q: int, out: str = "quantile") -> DataFrame:
    """Right-closed bins between exact percentiles, lowest included; rank bins when edges
    repeat."""
    edges = exact_percentiles(df, value, [i / q for i in range(q + 1)])
    if edges is None:
        return df.withColumn(out, F.lit(None).cast("int"))
    if len(set(edges)) < len(edges):
        return quantile_rank(df, value, q, out)
    inner = edges[1:-1]
    b = F.lit(1)
    for e in inner:
        b = b + (F.col(value) > F.lit(e)).cast("int")
    return df.withColumn(out, F.when(F.col(value).isNotNull(), b))


# ---------------------------------------------------------------- region matrices (long form)


def bin_means(lo: np.ndarray, hi: np.ndarray, v: np.ndarray, n_bins: int, w: int) -> np.ndarray:
    """Length-weighted mean of weighted intervals [lo, hi) per bin of width ``w``, NaN where nothing lies.

    Running sums of length and of value x length bend only where an interval begins or ends; between such
    points they are lines, so each bin is a difference of two looked-up sums, however wide the intervals are.
    """
    at = np.concatenate([lo, hi])
    order = np.argsort(at, kind="stable")
    at = at[order]
    edges = np.arange(n_bins + 1) * w
    size = np.abs(v)
    typical = np.median(size[np.isfinite(v) & (v != 0)]) if (np.isfinite(v) & (v != 0)).any() else 1.0
    plain = size <= 1e4 * typical  # running sums keep their digits among values of like size

    def sums(weight: np.ndarray) -> np.ndarray:
        slope = np.cumsum(np.concatenate([weight, -weight])[order])[:-1]
        return np.diff(np.interp(edges, at, np.r_[0.0, np.cumsum(slope * np.diff(at))]))

    n, total = np.rint(sums(np.ones(len(v)))), sums(np.where(plain, v, 0.0))
    for k in np.flatnonzero(~plain):  # huge, infinite or undefined: added to the bins it touches and no other
        bins = np.arange(lo[k] // w, (hi[k] - 1) // w + 1)
        total[bins] += v[k] * (np.minimum(hi[k], (bins + 1) * w) - np.maximum(lo[k], bins * w))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, total / n, np.nan)


def region_matrix(regions: DataFrame, track: DataFrame, before: int, after: int, w: int, bin_size: int = 4096) -> DataFrame:
    """P10: mean track value per bin of [c-before, c+after), reversed on the minus strand.

    A bin's value is the length-weighted mean of the bases that have signal, null when none has. Every bin of
    every region is present. A region meets all its overlaps in the bin of its start, and they are gathered there:
    only regions and track rows travel, no overlap does. A region's bins come from running sums of its overlaps,
    all at once, so narrow bins cost no row per base before the result itself.
    """
    c = F.col("center")
    n_bins = math.ceil((before + after) / w)
    win = regions.select("region_id", "strand", "chrom", (c - before).alias("start"), (c + after).alias("end"))
    at = F.floor(F.col("start") / bin_size)
    a = win.groupBy(*win.columns).agg(F.count(F.lit(1)).alias("copies")).withColumn("_bin", at)
    b = track.filter("value IS NOT NULL").select(
        F.col("chrom").alias("b_chrom"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("value").cast("double").alias("b_value"),
        F.explode(F.sequence(F.floor((F.col("start") - (before + after)) / bin_size), F.greatest(F.floor((F.col("end") - 1) / bin_size), F.floor(F.col("start") / bin_size)))).alias("b__bin"))
    hit = (F.col("chrom") == F.col("b_chrom")) & (F.col("_bin") == F.col("b__bin")) & (F.col("start") < F.col("b_end")) & (F.col("end") > F.col("b_start"))
    lo = F.greatest("start", "b_start") - F.col("start")
    hi = F.least("end", "b_end") - F.col("start")
    piece = F.when(F.col("b_start").isNotNull(), F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), F.col("b_value").alias("v")))
    # merged, not broadcast: the join leaves a region's overlaps in one place, so the grouping moves nothing
    full = a.join(b.hint("merge"), hit, "left").groupBy("chrom", "_bin", "region_id", "strand", "start", "copies").agg(F.collect_list(piece).alias("o"))
    full = full.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("region_id", "strand", "o.lo", "o.hi", "o.v")
    kind = {f.name: f.dataType.simpleString() for f in full.schema.fields}

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y, v in zip(b.column("lo"), b.column("hi"), b.column("v")):
                if not len(x):
                    out.append(np.full(n_bins, np.nan))
                    continue
                out.append(bin_means(*(t.values.to_numpy() for t in (x, y, v)), n_bins, w))
            flat = np.concatenate([*out, np.zeros(0)])
            some = np.concatenate([*[_touched(x, y, n_bins, w) for x, y in zip(b.column("lo"), b.column("hi"))], np.zeros(0, bool)])
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * n_bins, pa.int32()), pa.array(flat, mask=~some))
            yield pa.RecordBatch.from_pydict({"region_id": b.column("region_id"), "strand": b.column("strand"), "vals": values})

    mat = full.mapInArrow(means, f"region_id {kind['region_id']}, strand {kind['strand']}, vals array<double>")
    mat = mat.select("region_id", "strand", F.posexplode("vals").alias("bin", "value")).withColumn("bin", F.col("bin").cast("long"))
    return orient(mat, n_bins).select("region_id", "bin", "value")


def _touched(lo: pa.ListScalar, hi: pa.ListScalar, n_bins: int, w: int) -> np.ndarray:
    """Bins that hold at least one base of an interval."""
    step = np.zeros(n_bins + 1, np.int64)
    if len(lo):
        np.add.at(step, lo.values.to_numpy() // w, 1)
        np.add.at(step, (hi.values.to_numpy() - 1) // w + 1, -1)
    return np.cumsum(step)[:n_bins] > 0


def orient(mat: DataFrame, n_bins: int | None = None, bin: str = "bin") -> DataFrame:
    """Reverse the bins of minus-strand regions."""
    n = F.lit(n_bins) if n_bins else F.max(bin).over(Window.partitionBy("region_id")) + 1
    return mat.withColumn(bin, F.when(F.col("strand") == "-", n - 1 - F.col(bin)).otherwise(F.col(bin)))


def count_flipped(mat: DataFrame) -> DataFrame:
    """Number of regions on the minus strand."""
    return mat.groupBy("region_id").agg(F.max((F.col("strand") == "-").cast("int")).alias("f")).agg(
        F.sum("f").alias("n_flipped")
    )


def matrix_profile(mat: DataFrame, n_bins: int, binsize: int = 1, sd: str = "samp") -> DataFrame:
    """Mean, sd, sem and n per bin with centred x."""
    dev = {"samp": F.stddev_samp, "pop": F.stddev_pop}[sd]
    g = mat.groupBy("bin").agg(F.avg("value").alias("mean"), dev("value").alias("sd"), F.count("value").alias("n"))
    x = (F.col("bin") - (n_bins - 1) / 2.0) * binsize
    return g.select("bin", x.alias("x"), "mean", "sd", (F.col("sd") / F.sqrt(F.greatest("n", F.lit(1)))).alias("sem"), "n")


def crop_x(profile: DataFrame, left: float, right: float) -> DataFrame:
    """Keep left <= x <= right."""
    return profile.filter(F.col("x").between(left, right))


def crop_columns(profile: DataFrame, left: float, right: float, n_bins: int, binsize: int = 1) -> DataFrame:
    """Crop by column index with clipping, at least two columns."""
    half = int(round((n_bins - 1) / 2.0 * binsize))
    lo = int(min(max((left + half) / binsize, 0), n_bins - 1))
    hi = int(min(max((right + half) / binsize, 0), n_bins - 1))
    if hi <= lo:
        hi = min(n_bins - 1, lo + 1)
    return profile.filter(F.col("bin").between(lo, hi))


def mirror_x(profile: DataFrame, n_bins: int) -> DataFrame:
    """Values read from the mirrored bin, x grid unchanged (symmetric)."""
    return profile.withColumn("bin", F.lit(n_bins - 1) - F.col("bin")).withColumn("x", -F.col("x"))


def scale_profiles(profiles: DataFrame, ref: DataFrame, mode: str = "none") -> DataFrame:
    """Curves (column ``track``) as they are, to maximum 1, or to the reference's peak; sd
    scales along. A curve on another x grid fails the job."""
    grid = ref.select(F.col("x").alias("rx"), F.col("bin").alias("rb"))
    bad = profiles.join(broadcast_if_small(grid), F.col("bin") == F.col("rb"), "left").groupBy("track").agg(
        F.max("mean").alias("peak"),
        F.max(F.when(F.col("rx").isNull() | (F.abs(F.col("rx") - F.col("x")) > 1e-6), 1).otherwise(0)).alias("bad"),
    )
    ref_peak = ref.agg(F.max("mean")).first()[0]
    s = profiles.join(bad, "track")
    factor = {
        "none": F.lit(1.0),
        "max": F.when(F.col("peak") > 0, 1.0 / F.col("peak")).otherwise(1.0),
        "refmax": F.when(F.col("peak") > 0, F.lit(ref_peak) / F.col("peak")).otherwise(1.0),
    }[mode]
    f = F.when(F.col("bad") == 1, F.raise_error(F.lit("x grids differ")).cast("double")).otherwise(factor)
    return s.withColumn("mean", F.col("mean") * f).withColumn("sd", F.col("sd") * f).drop("peak", "bad")


def order_by_center(mat: DataFrame, n_bins: int, half_bins: int, stat: str = "mean", ascending: bool = False) -> DataFrame:
    """Regions ranked by a statistic of their central bins."""
    agg = {"mean": F.avg, "max": F.max, "median": F.median}[stat]
    c = n_bins // 2
    lo, hi = max(0, c - half_bins), min(n_bins - 1, c + half_bins)
    s = mat.groupBy("region_id").agg(agg(F.when(F.col("bin").between(lo, hi), F.col("value"))).alias("score"))
    sign = F.col("score") if ascending else -F.col("score")
    s = s.withColumn("_key", sign)
    return with_index(
        value_chunks(s, "_key").withColumn("_all", F.lit(1)), ["_all"], ["_key", "region_id"], "ord"
    ).select("region_id", "score", "ord")


def moving_average_edge(df: DataFrame, keys: list[str], order: str, value: str, n: int, out: str) -> DataFrame:
    """Centred moving average with edge-value padding, for profiles (one row per bin)."""
    if n <= 1:
        return df.withColumn(out, F.col(value))
    h1, h2 = n // 2, n - 1 - n // 2
    w = Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    f = w.rowsBetween(-h1, h2)
    i = F.row_number().over(w) - 1
    left = F.greatest(F.lit(h1) - i, F.lit(0))
    right = F.greatest(i + h2 - (F.count(F.lit(1)).over(whole) - 1), F.lit(0))
    tot = F.sum(value).over(f) + left * F.first(value).over(whole) + right * F.last(value).over(whole)
    return df.withColumn(out, tot / n)


# ---------------------------------------------------------------- distributions per bin


def box_stats(bp: DataFrame) -> DataFrame:
    """Quartiles (linear interpolation) and whiskers inside 1.5 IQR, per bin."""
    v = bp.filter("binding_prob IS NOT NULL")
    q = v.groupBy("zf").agg(F.expr("percentile(binding_prob, array(0.25D, 0.5D, 0.75D))").alias("q"), F.count("*").alias("n"))
    q = q.selectExpr("zf", "n", "q[0] AS q1", "q[1] AS q2", "q[2] AS q3")
    j = v.join(F.broadcast(q), "zf")  # one row per bin code
    x = F.col("binding_prob")
    iqr = F.col("q3") - F.col("q1")
    return j.groupBy("zf", "n", "q1", "q2", "q3").agg(
        F.min(F.when(x >= F.col("q1") - 1.5 * iqr, x)).alias("lo"),
        F.max(F.when(x <= F.col("q3") + 1.5 * iqr, x)).alias("hi"),
    )


def density_table(bp: DataFrame, ny: int = 180, lo: float = -0.05, hi: float = 1.05, sigma: float = 1.2) -> DataFrame:
    """P20: per bin a histogram of values over ny equal cells, normalised, smoothed along y with
    a Gaussian (edges replicated, radius 4 sigma) and scaled to the column maximum.

    Each occupied cell adds its kernel-weighted share to its neighbours; replicated edges mean
    the first and last cell also stand in for the cells beyond them.
    """
    x = F.col("binding_prob")
    step = (hi - lo) / ny
    v = bp.filter(x.between(lo, hi)).withColumn("y", F.least(F.floor((x - lo) / step), F.lit(ny - 1)).cast("int"))
    cnt = v.groupBy("zf", "y").agg(F.count("*").alias("c"))
    tot = cnt.groupBy("zf").agg(F.sum("c").alias("t"))
    h = cnt.join(F.broadcast(tot), "zf").select("zf", "y", (F.col("c") / F.col("t")).alias("h"))  # per bin code
    grid = tot.select("zf", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("y"))
    full = grid.join(h, ["zf", "y"], "left").select("zf", "y", F.coalesce("h", F.lit(0.0)).alias("h"))
    if sigma > 0:
        rad = int(4.0 * sigma + 0.5)
        raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-rad, rad + 1)]
        total = sum(raw)
        ker = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r / total).alias("w")) for k, r in zip(range(-rad, rad + 1), raw)])
        t = full.select("zf", "y", F.explode(ker).alias("e")).select(
            "zf", F.col("y").alias("to"), F.greatest(F.least(F.col("y") + F.col("e.k"), F.lit(ny - 1)), F.lit(0)).alias("y"),
            F.col("e.w").alias("w"))
        full = t.join(full, ["zf", "y"]).groupBy("zf", F.col("to").alias("y")).agg(F.sum(F.col("h") * F.col("w")).alias("h"))
    mx = full.groupBy("zf").agg(F.max("h").alias("m"))
    return full.join(F.broadcast(mx), "zf").select(
        "zf", "y", F.when(F.col("m") > 0, F.col("h") / F.col("m")).otherwise(F.lit(0.0)).alias("density"))
