"""Named analyses: each composes operators with the parameters of one published analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlight.functions import calls as fc
from strandlight.functions import fits
from strandlight.operators import binding as bd
from strandlight.operators import hmm
from strandlight.operators import intervals as iv
from strandlight.operators import lookups as lk
from strandlight.operators import profiles as pf
from strandlight.operators import signals as sg
from strandlight.operators import stats as st
from strandlight.operators import traces as tr
from strandlight.operators import unzip as uz
from strandlight.ordered import centred_mean, chunk_by, with_index
from strandlight.session import cut_lineage
from strandlight.streaming.ingest import wide_from_raw

# Cluster bins and windows of the analyses.
CLUSTERS = {"I": [1, 2], "II": [3, 4, 5, 6, 7, 8], "III": [9, 10, 11]}
WIDE_NDR = bd.Windows(ndr=(20, 60), nuc=(20, 60))
NARROW = bd.Windows(nuc=(40, 60))


def with_motif(calls: DataFrame, motifs: DataFrame, a_max_len: int = 2) -> DataFrame:
    """Calls joined to the motif windows they overlap."""
    j = iv.overlap_join(calls, motifs, a_max_len=a_max_len)
    return j.select(
        fc.motif_id("b_chrom", "b_start", "b_end", "b_strand").alias("motif_id"), F.col("a_read_id").alias("read_id"),
        F.col("a_status").alias("status"), fc.rel_pos("a_call_pos", "b_center", "b_strand").alias("rel_pos"),
        F.col("a_chrom").alias("chrom"), F.col("a_call_pos").alias("call_pos"))


def with_nearest(calls: DataFrame, motifs: DataFrame, tol: int = 0) -> DataFrame:
    """Calls joined to their nearest motif centre; unknown strands count as plus one."""
    j = iv.nearest_join(calls, motifs, tol)
    return j.select(
        fc.motif_id("m_chrom", "m_start", "m_end", "m_strand").alias("motif_id"), "read_id", "status",
        fc.rel_pos("call_pos", "m_center", "m_strand", "plus").alias("rel_pos"), "chrom", "call_pos")


def prepare_consensus(peaks: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R0, peaks: summits in at least two replicates with their best score; +-25 windows of them
    that touch reference peaks."""
    cons = iv.multi_depth(peaks, 2)
    scored = iv.overlap_map(cons, peaks, {"score": F.max("b_score")}, bin_size=256)
    return scored, iv.overlap_semi(fc.slop(cons, 25, 25, 0), reference)


def prepare_calls(raw: DataFrame, hits: DataFrame, dedup: bool = False) -> DataFrame:
    """R0, calls: raw calls within ~1 kb of shifted hits (once per overlapping window unless
    ``dedup``), then filter, status, realignment and the ten wide columns in the same stage."""
    near = fc.slop(fc.shift_interval(hits, 1), 991, 991, 1)
    kept = iv.overlap_semi(raw, near, a_max_len=64) if dedup else iv.overlap_a(raw, near, a_max_len=64)
    return wide_from_raw(kept)


def prepare_motifs(hits: DataFrame) -> DataFrame:
    """R0, motifs: centres, distinct, standard chromosomes, +-65 windows."""
    m = fc.standard_chroms(fc.motif_center(fc.shift_interval(hits, 1)).distinct())
    return fc.window_at(m, "center", 65, 0)


def prepare_isolated(motifs: DataFrame) -> DataFrame:
    """Motifs at least 36 bp from their neighbours, with +-1 kb windows."""
    return fc.slop(iv.drop_close(motifs, 36), 935, 935, 0)


def prepare_flanks(motifs: DataFrame, calls: DataFrame) -> DataFrame:
    """The four flanking windows of every motif joined to calls, one table with ``region``."""
    out = None
    for name, off, side in (("NUC_N", 155, "N"), ("NUC_C", 155, "C"), ("NDR_N", 50, "N"), ("NDR_C", 50, "C")):
        w = fc.offset_window(motifs, off, side).withColumn("region", F.lit(name))
        out = w if out is None else out.unionByName(w)
    j = iv.overlap_join(calls, out, a_max_len=2)
    return j.select("b_region", "a_chrom", "a_call_pos", "a_read_id", "a_status", "b_offset_center").toDF(
        "region", "chrom", "call_pos", "read_id", "status", "offset_center")


def r1b(cm: DataFrame, mappable: int = 1) -> dict[str, DataFrame]:
    """R1B: binding probability per bin with every table around it, from one scan of the calls.

    One aggregate leaves a row per (motif, read): two masks over the bins and one over the called positions. It is
    written to the shared folder once; the three snapshots and all twelve tables are views of it. ``mappable`` is
    the number of reads from which a bin counts as mappable."""
    pairs = cut_lineage(bd.pair_masks(cm, WIDE_NDR, 1, sites=True), "pairs")
    s = bd.pair_states(pairs, bd.Filters(mol_threshold=1, exclude_up=True, exclude_down=True))
    spec = bd.bin_spec(WIDE_NDR, hide5=True)
    bins = [z for z, _ in spec]
    bp = bd.binding_prob(s, WIDE_NDR, "kept")
    used = bp.filter(F.col("zf").isin(bins))
    reads = bd.motif_reads(pairs, mappable)
    return dict(
        states=s, binding_prob=bp, bin_stats=bd.bin_stats(used), matrix=bd.matrix_export(bp, spec),
        points=bd.points_export(bp, spec), scatter_stats=bd.scatter_stats(s, WIDE_NDR, bins),
        category_counts=bd.read_category_counts(s), by_k=bd.dynamic_static_by_k(s), category_summary=bd.category_summary(s, WIDE_NDR),
        mappability=bd.mappability_table(reads), mappability_by_sites=bd.sites_table(reads), balance=bd.balance_table(reads, mappable))


def r1c(calls: DataFrame, motifs: DataFrame, half: int = 18, w: int = 5) -> dict[str, DataFrame]:
    """R1C / S1D: read rasters around every nearest motif: categories, cells filled two bins wide,
    mean profile."""
    cm = with_nearest(calls, motifs)
    reads = pf.prepare_reads(cm, half, 0, 0, w)
    return dict(
        categories=pf.raster_categories(cm.filter(F.abs("rel_pos") <= max(half, 60)), 2, (20, 60)),
        raster=pf.extend_calls(pf.raster(reads), 2, half, w), profile=pf.u_profile(reads))


def extreme_deciles(motifs: DataFrame, track: DataFrame, sizes: DataFrame) -> DataFrame:
    """First half of R1E: motifs of the top (side 1) and bottom (side 2) decile of the median
    signal within 200 bp, missing as zero."""
    m = motifs.withColumn("motif_id", fc.motif_id("chrom", "start", "end", "strand"))
    s = sg.missing_as_zero(sg.track_stat(m, track, 200, sizes), ["median"])
    q = sg.quantile_rank(cut_lineage(s.select("motif_id", "median"), "signals"), "median", 10)  # ranks read it several times
    return q.filter("quantile IN (1, 10)").selectExpr("motif_id", "CASE WHEN quantile = 10 THEN 1 ELSE 2 END AS side")


def r1e(cm: DataFrame, motifs: DataFrame, track: DataFrame, sizes: DataFrame, dynamic: bool = False) -> DataFrame:
    """R1E (fully bound pairs dropped) / R3C (dynamic pairs only): cluster means of the two
    extreme deciles, ready for the rank tests."""
    dec = extreme_deciles(motifs, track, sizes)
    f = bd.Filters(mol_threshold=1, drop_all_bound=not dynamic, exclude_up=True, exclude_down=True,
                   pair_mode="dynamic" if dynamic else "all")
    bp = bd.binding_prob(bd.pair_states(bd.pair_masks(cm, WIDE_NDR, 1), f), WIDE_NDR, "kept")
    return bd.cluster_means(bp, CLUSTERS).join(dec, "motif_id")


def r3b(cm: DataFrame, signals: DataFrame, dynamic: bool = True) -> tuple[DataFrame, DataFrame]:
    """R3B and its siblings: correlation of binding with signal tracks per bin, tracks ordered."""
    f = bd.Filters(mol_threshold=1, exclude_up=True, exclude_down=True, pair_mode="dynamic" if dynamic else "all")
    bp = bd.binding_prob(bd.pair_states(bd.pair_masks(cm, NARROW, 1), f), denom="kept", total_from_class=True)
    bins = [z for z, _ in bd.bin_spec(hide5=True)]
    t = st.corr_table(bp, signals, bins)
    return t, lk.order_tracks(t, bins)


def s1b(calls: DataFrame, motif_sets: dict[str, DataFrame], half: int = 1000, w: int = 5) -> DataFrame:
    """S1B: macro-averaged profiles of several motif sets, smoothed over five bins. The calls are read once for all
    sets: a motif carries a mask of the sets that hold it."""
    m, names = pf.set_masks({n: fc.window_at(d, "center", half, 0) for n, d in motif_sets.items()})
    j = iv.overlap_join(calls, m, a_max_len=2)
    cm = j.select(
        fc.motif_id("b_chrom", "b_start", "b_end", "b_strand").alias("motif_id"), F.col("a_status").alias("status"),
        fc.rel_pos("a_call_pos", "b_center", "b_strand").alias("rel_pos"), F.col("b_in_set").alias("in_set"))
    out = cut_lineage(pf.metaprofile_sets(cm, names, half, w), "profiles")  # bins x sets; smoothing reads it twice
    i = with_index(chunk_by(out, "rel_bin", 100_000), ["label"], ["rel_bin"])
    return centred_mean(i, ["label"], "idx", "mean", 5, "smooth").drop("idx", "n_rows", "_chunk")


def s1c(cm: DataFrame) -> DataFrame:
    """S1C: dynamic fraction against the number of measured bins, with its saturation fit."""
    s = bd.pair_states(bd.pair_masks(cm, WIDE_NDR, 1), bd.Filters(mol_threshold=1, exclude_up=True, exclude_down=True))
    return bd.dynamic_curve(s, "eq", 5, 1)


def s1e(calls: DataFrame, motifs: DataFrame, half: int = 600, w: int = 5) -> DataFrame:
    """S1E: profiles of the four exclusive read classes around the nearest motif. The nearest join runs once: one
    aggregate holds the masks that give a pair its class and the counts per bin, which are labelled afterwards."""
    pairs = pf.pair_cells(with_nearest(calls, motifs, 1500), NARROW, half, w)
    s = bd.pair_states(pairs, bd.Filters(exclude_up=True, exclude_down=True))
    prof = cut_lineage(pf.metaprofile_cells(bd.global_classes(s, ["cells"])), "profiles")  # bins x classes; its labels are read again
    return lk.complete_bins(prof, half, w, ["label"])


def s1f(cm: DataFrame) -> DataFrame:
    """S1F: conditional binding between bins of pairs with two or more bound bins."""
    bins = [z for z, _ in bd.bin_spec(hide5=True)]
    s = bd.cond_states(cm, bins, bd.Windows(nuc=(20, 60)), 1, 2, exclude_up=True, exclude_down=True, drop_all_bound=True)
    return bd.cond_prob(s, bins, 1)


def s21(motifs: DataFrame, tracks: dict[str, DataFrame], ref: str, half: int = 500, w: int = 1) -> DataFrame:
    """Strand-flipped region matrices per track, mean profiles, scaled to the
    reference track's peak."""
    regions = fc.flip_strand(motifs).withColumn("region_id", fc.motif_id("chrom", "start", "end", "strand"))
    n = 2 * half // w
    prof = None
    for name, t in tracks.items():
        p = sg.matrix_profile(sg.region_matrix(regions, t, half, half, w), n, w).withColumn("track", F.lit(name))
        prof = p if prof is None else prof.unionByName(p)
    prof = cut_lineage(prof, "profiles")  # bins x tracks; the scaling reads it again
    return sg.scale_profiles(prof, prof.filter(F.col("track") == ref), "refmax")


def rt1(traces: DataFrame, period_us: int, lo: float, hi: float, n: int, target: float = 12.0) -> DataFrame:
    """RT1: downsample, crop, drift-correct."""
    d = tr.downsample(traces, period_us).withColumn("ev", F.col("bucket")).drop("bucket", "n")
    return tr.drift_correct(tr.crop_time(d, lo, hi), n, target)


def rt2(traces: DataFrame, k: int = 4, max_iter: int = 300, max_dwell: float = 5.0) -> dict[str, DataFrame]:
    """RT2: fit, decode, order states, then occupancy, transitions, signal, dwells and lifetimes."""
    m, _ = hmm.hmm_fit(traces, k, max_iter=max_iter)
    d = cut_lineage(hmm.hmm_decode(traces, m.ordered()).withColumn("grp", F.lit("all")), "decoded")
    cdf = tr.dwell_cdf(tr.dwell_next(d), ["state"], max_dwell)
    return dict(
        decoded=d, occupancy=tr.occupancy(d, ["grp"]), transitions=tr.transition_matrix(d, k, ["grp"]), signal=tr.state_signal(d, []),
        dwell_cdf=cdf, lifetimes=fits.fit_exp_cdf(cdf, ["state"]))


def pure_segments(annotated: DataFrame, m: hmm.Model, regime: str, max_dwell: float = 5.0) -> dict[str, DataFrame]:
    """The samples of one regime, decoded; occupancy, transitions, dwells (last-sample rule),
    mean signal and lifetimes in the order of descending state mean."""
    d = hmm.hmm_decode(annotated.filter(F.col("regime") == regime).drop("idx", "n_rows"), m.ordered()).withColumn("grp", F.lit(regime))
    d = cut_lineage(d, "decoded")
    dw = tr.dwell_last(d)
    enough = dw.filter(F.col("dwell") < max_dwell).groupBy("state").agg(F.count("*").alias("c")).filter("c >= 3").select("state")
    cdf = tr.dwell_cdf(dw.join(F.broadcast(enough), "state", "left_semi"), ["state"], max_dwell, 5)  # at most K rows
    fitted = fits.fit_exp_cdf(cdf, ["state"])
    states = d.select("state").distinct()  # a state with fewer dwells keeps its row, without a lifetime
    return dict(occupancy=tr.occupancy(d, ["grp"]), transitions=tr.transition_matrix(d, m.k, ["grp"]), signal=tr.state_signal(d, ["grp"]),
                dwells=dw, lifetimes=states.join(fitted, "state", "left"))


def rt3(conditions: dict[str, DataFrame], base: hmm.Model, baseline: str, win: int = 500, step: int = 100, max_iter: int = 100,
        delta: float = 8.0) -> dict:
    """RT3: adapt the base model per condition, score and annotate every trace, summarise."""
    models = {n: hmm.hmm_adapt(t, base, flags="stm", max_iter=max_iter) for n, t in conditions.items()}
    both = None
    for t in conditions.values():
        both = t if both is None else both.unionByName(t)
    ann = cut_lineage(hmm.annotate_regimes(both, models, baseline, win, step, delta), "annotated")
    return dict(models=models, scores=hmm.hmm_score(both, models, baseline), annotated=ann, summary=tr.regime_summary(ann, list(models)))


def rt4(traces: DataFrame, m: hmm.Model, levels: list[float], target: float = 12.75) -> DataFrame:
    """RT4: decode, shift the highest state to ``target``, decode again, time-weighted occupancy
    with its block spread, and the occupancy-weighted level per trace."""
    first = cut_lineage(hmm.hmm_decode(traces, m.ordered()), "decoded")
    moved = tr.shift_to_state(first, target).withColumn("signal", F.col("corrected")).drop("corrected", "shift", "state", "idx", "n_rows")
    d = tr.relabel_states(hmm.hmm_decode(moved, m.ordered()), ["trace_id"]).withColumn("state", F.col("new_state")).drop("new_state")
    d = cut_lineage(d, "shifted")
    occ = tr.occupancy(d, ["trace_id"], "time").join(tr.occupancy_sd(d, m.k), ["trace_id", "state"])
    lv = F.element_at(F.array(*[F.lit(float(v)) for v in levels]), F.col("state") + 1)
    w = occ.groupBy("trace_id").agg(F.sum(F.col("occupancy") * lv).alias("force"), F.sqrt(F.sum((F.col("sd") * lv) ** 2)).alias("force_se"))
    one = occ.filter("state = 0").select("trace_id", F.col("occupancy").alias("p_obs"), F.col("sd").alias("p_se"))
    return w.join(one, "trace_id")


def unzip(curves: DataFrame, base: DataFrame, cal: DataFrame, n: int = 399, deg: int = 7) -> DataFrame:
    """RU: subtract baselines, zero, attach stiffness, extension and mean force.

    ``curves``: curve, date, t, ev, trap, f1, f2, baseline_curve."""
    d = uz.subtract_baseline(curves, base, ["f1", "f2"], deg=deg)
    d = tr.zero_offset(d, ["f1_base", "f2_base"], n, 0.1, keys=["curve"])
    d = lk.attach_calibration(d, cal)
    return d.withColumn("extension", fc.extension(F.col("trap"), F.col("f1_base"), F.col("f2_base"), F.col("kappa_1x"), F.col("kappa_2x"))).withColumn(
        "force_mean", (F.col("f1_base") + F.col("f2_base")) / 2)
