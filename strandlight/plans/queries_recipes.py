"""Queries for hidden-state models (H1-H6, X14) and the named recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlight.functions import calls as fc
from strandlight.functions import fits
from strandlight.operators import hmm
from strandlight.operators import stats as st
from strandlight.operators import traces as tr
from strandlight.plans import recipes as rc
from strandlight.plans.oracle import sql
from strandlight.plans.queries_binding import _CBINS, _CVIEWS, _cond_sql
from strandlight.plans.queries_genome import _DEPTH, _LABELS
from strandlight.plans.queries_stats import _M
from strandlight.plans.queries_traces import _CURVE, calibration, curves
from strandlight.plans.registry import ORACLE, query
from strandlight.sources import adapters as ad

# A fixed three-state model on the scale of the event values.
BASE = hmm.Model.of([0.3, 0.3, 0.4], [[0.6, 0.2, 0.2], [0.2, 0.6, 0.2], [0.1, 0.2, 0.7]], [140.0, 60.0, 15.0], [4000.0, 600.0, 120.0])
OTHER = hmm.Model.of([0.5, 0.5], [[0.9, 0.1], [0.1, 0.9]], [60.0, 20.0], [2500.0, 400.0])
ITER = 4  # EM rounds of the registered fits


def _fit(s, d):
    m, hist = hmm.hmm_fit(ad.traces(s, d), 3, max_iter=ITER)
    return hmm.model_table(s, {"fit": m.ordered()}).withColumn("log_likelihood", F.lit(hist[-1])).withColumn("rounds", F.lit(len(hist)))


query("H1_hmm_fit")(_fit)


def _sweep(s, d):
    out = hmm.hmm_sweep(ad.traces(s, d), 1, 3, max_iter=3, refit_iter=3)
    return hmm.sweep_tables(s, out)[0].withColumn("best_k", F.lit(out["best_k"]))


query("H2_hmm_sweep")(_sweep)


def _forward_sql(xs: str, start: list, trans: list, means: list, vars: list) -> str:
    """SQL of the log-likelihood of a list of samples under a model whose parameters are SQL numbers."""
    k = range(len(means))
    dens = [f"exp(-0.5 * (x - ({means[i]})) * (x - ({means[i]})) / ({vars[i]})) / sqrt(2 * pi() * ({vars[i]}))" for i in k]
    z0 = " + ".join(f"({start[i]}) * y.e{i}" for i in k)
    one = ", ".join([f"'e{i}': y.e{i}" for i in k] + [f"'f{i}': ({start[i]}) * y.e{i} / ({z0})" for i in k] + [f"'ll': ln({z0})"])
    g = ["(" + " + ".join(f"p.f{i} * ({trans[i][j]})" for i in k) + f") * z.e{j}" for j in k]
    z = " + ".join(g)
    step = ", ".join([f"'e{i}': z.e{i}" for i in k] + [f"'f{i}': {g[i]} / ({z})" for i in k] + [f"'ll': p.ll + ln({z})"])
    e = ", ".join(f"'e{i}': {dens[i]}" for i in k)
    return f"list_reduce(list_transform(list_transform({xs}, lambda x: {{{e}}}), lambda y: {{{one}}}), lambda p, z: {{{step}}}).ll"


def _model_sql(xs: str, m: hmm.Model) -> str:
    return _forward_sql(xs, *(list(a) for a in (m.start, m.trans, m.means, m.vars)))


def _start_sql(xs: str, k: int) -> str:
    """Of the start model of K states, from columns lo, hi and var."""
    t = [[hmm.STICKY if i == j else f"{1 - hmm.STICKY} / {k - 1}" for j in range(k)] for i in range(k)] if k > 1 else [[1.0]]
    return _forward_sql(xs, [f"1.0 / {k}"] * k, t, [f"lo + (hi - lo) * {i} / {max(1, k - 1)}" for i in range(k)], [f"var / {k}"] * k)


SPLITS = 4
_SAMPLES = "SELECT trace_id, t, ev, signal, row_number() OVER (PARTITION BY trace_id ORDER BY t, ev) - 1 AS idx FROM traces WHERE signal IS NOT NULL"
# contiguous folds over all samples, traces in order of their id
_FOLDS = f"""SELECT *, CASE WHEN g < m * (q + 1) THEN g // (q + 1) ELSE m + (g - m * (q + 1)) // q END AS fold FROM
    (SELECT *, row_number() OVER (ORDER BY trace_id, idx) - 1 AS g, count(*) OVER () // {SPLITS} AS q, count(*) OVER () % {SPLITS} AS m FROM sm)"""
_FACTS = "SELECT min(signal) AS lo, max(signal) AS hi, var_pop(signal) AS var FROM sm"
_SEQ = "SELECT trace_id, fold, count(*) AS n, list(signal ORDER BY idx) AS xs FROM fo GROUP BY trace_id, fold"


def _held_out(s, d, kmin, kmax, rounds):
    cv = hmm.hmm_cross_validate(ad.traces(s, d).select("trace_id", "t", "ev", "signal"), kmin, kmax, SPLITS, max_iter=rounds, size=32)
    return hmm.cross_validation_tables(s, cv)[1]


query("H2_heldout_start_models", sql(" UNION ALL ".join(
    f"SELECT {k} AS k, CAST(fold AS INTEGER) AS fold, CAST(sum(n) AS BIGINT) AS samples, sum({_start_sql('xs', k)}) AS log_likelihood FROM sq, fa GROUP BY fold" for k in (1, 2, 3)),
    "traces", sm=_SAMPLES, fo=_FOLDS, fa=_FACTS, sq=_SEQ), dbl="log_likelihood", ints="k fold", digits=4)(lambda s, d: _held_out(s, d, 1, 3, 0))
query("H2_heldout_one_state", sql(f"""SELECT 1 AS k, CAST(o.fold AS INTEGER) AS fold, count(*) AS samples, sum(-0.5 * (ln(2 * pi() * v) + (signal - mu) * (signal - mu) / v)) AS log_likelihood
    FROM fo o JOIN (SELECT f.fold, avg(signal) AS mu, ({hmm.COVAR_PRIOR} + var_pop(signal) * count(*)) / count(*) AS v
      FROM (SELECT DISTINCT fold FROM fo) f JOIN fo x ON x.fold <> f.fold GROUP BY f.fold) m ON m.fold = o.fold GROUP BY o.fold""",
    "traces", sm=_SAMPLES, fo=_FOLDS), dbl="log_likelihood", ints="k fold", digits=4)(lambda s, d: _held_out(s, d, 1, 1, 2))
query("H3_hmm_decode")(lambda s, d: hmm.hmm_decode(ad.traces(s, d), BASE).select("trace_id", "ev", "state"))
_TWO = {"base": BASE, "other": OTHER}
_LLS = ", ".join(f"{_model_sql('xs', m)} AS ll_{n}" for n, m in _TWO.items())
query("H4_hmm_score", sql(f"""SELECT trace_id, ll_base, ll_other, CASE WHEN ll_base >= ll_other THEN 'base' ELSE 'other' END AS best_model, greatest(ll_base, ll_other) - ll_base AS gain
    FROM (SELECT trace_id, {_LLS} FROM (SELECT trace_id, list(signal ORDER BY idx) AS xs FROM sm GROUP BY trace_id))""", "traces", sm=_SAMPLES),
    dbl="ll_base ll_other gain", digits=4)(lambda s, d: hmm.hmm_score(ad.traces(s, d), _TWO, "base"))
query("H4_score_windows", sql(f"""SELECT trace_id, w, {_LLS.replace('ll_', '')} FROM (SELECT trace_id, k AS w, list(signal ORDER BY idx) AS xs FROM
    (SELECT *, count(*) OVER (PARTITION BY trace_id) AS n_rows FROM sm) CROSS JOIN LATERAL (SELECT unnest(range(n_rows)) AS k)
    WHERE k * 5 <= idx AND idx < k * 5 + 20 AND k * 5 <= greatest(n_rows - 20, 0) GROUP BY trace_id, k)""", "traces", sm=_SAMPLES),
    dbl="base other", digits=4)(lambda s, d: hmm.score_windows(ad.traces(s, d), _TWO, 20, 5))
query("H5_hmm_adapt")(lambda s, d: hmm.model_table(s, {"adapted": hmm.hmm_adapt(ad.traces(s, d), BASE, max_iter=3)}))


def _annotated(s, d):
    return hmm.annotate_regimes(ad.traces(s, d), {"base": BASE, "other": OTHER}, "base", 20, 5, 2.0)


query("H6_annotate_regimes")(lambda s, d: _annotated(s, d).select("trace_id", "ev", "regime"))
query("X14_pure_segments")(lambda s, d: rc.pure_segments(_annotated(s, d), BASE, "other", 200000.0)["occupancy"])

# ---- genome recipes

_H = """SELECT chrom, center - 9 AS "start", center + 10 AS "end", strand, seq FROM motifs"""


def hits(s, d):
    return ad.motifs(s, d).selectExpr("chrom", "center - 9 AS start", "center + 10 AS end", "strand", "seq")


query("R0_prepare_consensus", sql("""SELECT chrom, greatest("start" - 25, 0) AS "start", "end" + 25 AS "end", depth FROM dep d WHERE EXISTS (SELECT 1 FROM motifs m
    WHERE m.strand = '+' AND m.chrom = d.chrom AND m."start" < d."end" + 25 AND m."end" > greatest(d."start" - 25, 0))""", "peaks", "motifs", **dict(_DEPTH, iv='SELECT chrom, "start", "end", replicate FROM peaks')))(
    lambda s, d: rc.prepare_consensus(ad.peaks(s, d), ad.motifs(s, d).filter("strand = '+'"))[1])
query("R0_prepare_calls", sql("""SELECT c.chrom, pos - 1 AS "start", pos + 1 AS "end", pos AS call_pos, c.strand, read_id, llr, ll_met AS llr_met, ll_unmet AS llr_unmet,
    CASE WHEN llr >= 1 THEN 'M' WHEN llr <= -1 THEN 'U' ELSE 'N' END AS status FROM (SELECT *, "start" + greatest(instr(kmer, 'M'), 1) - 3 AS pos FROM raw WHERE n_motifs = 1) c
    JOIN (SELECT chrom, greatest("start" + 1 - 991, 1) AS s, "end" + 1 + 991 AS e FROM h) k ON k.chrom = c.chrom AND c."start" < e AND c."end" > s""", "raw", "motifs", h=_H), dbl="llr llr_met llr_unmet")(
    lambda s, d: rc.prepare_calls(ad.raw_calls(s, d), hits(s, d)))
_PM = """SELECT DISTINCT chrom, greatest(c - 65, 0) AS "start", c + 65 AS "end", strand, seq, c AS center FROM
    (SELECT *, "start" + 1 + CASE WHEN strand = '-' THEN 10 ELSE 8 END AS c FROM h)"""
query("R0_prepare_motifs", sql(_PM, "motifs", h=_H))(lambda s, d: rc.prepare_motifs(hits(s, d)))
query("R0_prepare_isolated", sql("""SELECT chrom, greatest("start" - 935, 0) AS "start", "end" + 935 AS "end", strand, seq, center FROM (
    SELECT *, center - lag(center) OVER w AS g1, lead(center) OVER w - center AS g2 FROM pm WINDOW w AS (PARTITION BY chrom ORDER BY center))
    WHERE coalesce(g1, 36) >= 36 AND coalesce(g2, 36) >= 36""", "motifs", h=_H, pm=_PM))(lambda s, d: rc.prepare_isolated(rc.prepare_motifs(hits(s, d))))
query("R0_prepare_flanks", sql("""SELECT region, c.chrom, call_pos, read_id, status, oc AS offset_center FROM calls c JOIN (
      SELECT region, chrom, CASE WHEN (strand = '+') = (side = 'N') THEN center - off ELSE center + off END AS oc
      FROM motifs CROSS JOIN (VALUES ('NUC_N', 155, 'N'), ('NUC_C', 155, 'C'), ('NDR_N', 50, 'N'), ('NDR_C', 50, 'C')) v(region, off, side)) w
    ON c.chrom = w.chrom AND c."start" < oc + 32 AND c."end" > greatest(oc - 32, 0)""", "motifs", "calls"))(
    lambda s, d: rc.prepare_flanks(ad.motifs(s, d), ad.calls(s, d)))
query("R1B_bin_stats", sql("""SELECT zf, count(*) AS n, avg(binding_prob) AS mean, coalesce(stddev_samp(binding_prob), 0) AS sd,
    coalesce(stddev_samp(binding_prob), 0) / sqrt(count(*)) AS sem FROM bp WHERE binding_prob IS NOT NULL AND zf <> 5 GROUP BY zf""", "bp"), dbl="mean sd sem")(
    lambda s, d: rc.r1b(ad.calls_motif(s, d))["bin_stats"])
# the other outputs of the recipe, each against the SQL of the table by itself
for _out, _same in dict(
    binding_prob="D10_binding_prob", matrix="D25_matrix_export", points="D25_points_export", scatter_stats="D15_scatter_stats",
    category_counts="D16_read_category_counts", category_summary="D18_category_summary", mappability="D12_mappability",
    mappability_by_sites="D13_mappability_by_sites", balance="D14_bin_balance",
).items():
    query(f"R1B_{_out}", ORACLE[_same])(lambda s, d, o=_out: rc.r1b(ad.calls_motif(s, d), 2)[o])
query("R1B_by_k", ORACLE["D17_dynamic_static_by_k"])(
    lambda s, d: rc.r1b(ad.calls_motif(s, d))["by_k"].filter("n_motifs_total > 0"))
query("R1B_states", sql("""SELECT motif_id, read_id, count(*) AS n_measured, sum(bound) AS n_bound, coalesce(any_value(k.kept), 0) AS kept FROM total
    LEFT JOIN (SELECT DISTINCT motif_id, read_id, 1 AS kept FROM kept) k USING (motif_id, read_id) GROUP BY motif_id, read_id""", "total", "kept"),
    ints="n_measured n_bound kept")(
    lambda s, d: rc.r1b(ad.calls_motif(s, d))["states"].filter("in_total").selectExpr("motif_id", "read_id", "n_measured", "n_bound", "int(in_kept) AS kept"))
_NR = """SELECT m.chrom || '_' || m."start" || '_' || m."end" || '_' || m.strand AS motif_id, read_id, status,
    (call_pos - m.center) * CASE WHEN m.strand = '+' THEN -1 ELSE 1 END AS rel_pos FROM (SELECT chrom, call_pos, read_id, status, center FROM (
      SELECT c.*, m.center, row_number() OVER (PARTITION BY c.id ORDER BY abs(c.call_pos - m.center), m.center) AS rn
      FROM (SELECT *, row_number() OVER () AS id FROM calls) c JOIN motifs m ON c.chrom = m.chrom {w}) WHERE rn = 1) c
    JOIN (SELECT chrom, center, max("start") AS "start", max("end") AS "end", arg_max(strand, strand) AS strand FROM motifs GROUP BY chrom, center) m USING (chrom, center)"""
query("R1C_profile", sql("""SELECT motif_id, rel_bin, avg(f) AS mean, stddev_pop(f) AS sd, count(*) AS n FROM (
    SELECT motif_id, read_id, CAST(floor(rel_pos / 5) AS BIGINT) * 5 AS rel_bin, avg(CASE WHEN status = 'U' THEN 1 ELSE 0 END) AS f FROM nr
    WHERE status <> 'N' AND rel_pos BETWEEN -18 AND 18 GROUP BY ALL) GROUP BY motif_id, rel_bin""", "calls", "motifs", nr=_NR.format(w="")), dbl="mean sd")(
    lambda s, d: rc.r1c(ad.calls(s, d), ad.motifs(s, d))["profile"])
query("R1C_raster")(lambda s, d: rc.r1c(ad.calls(s, d), ad.motifs(s, d))["raster"])
query("R1E_decile_clusters")(lambda s, d: rc.r1e(ad.calls_motif(s, d), ad.motifs(s, d), ad.track(s, d), ad.chrom_sizes(s, d)))
query("R1E_rank_test")(lambda s, d: st.mann_whitney(
    rc.r1e(ad.calls_motif(s, d), ad.motifs(s, d), ad.track(s, d), ad.chrom_sizes(s, d)), ["cluster"], "side", "value"))
query("R3C_decile_clusters")(lambda s, d: rc.r1e(ad.calls_motif(s, d), ad.motifs(s, d), ad.track(s, d), ad.chrom_sizes(s, d), dynamic=True))
query("R3B_correlation")(lambda s, d: rc.r3b(ad.calls_motif(s, d), ad.signals(s, d))[0])
query("S1B_macro_profile", sql("""SELECT rel_bin, mean, sd, n_motifs, label, avg(mean) OVER (PARTITION BY label ORDER BY rel_bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM (
    SELECT label, rel_bin, avg(f) AS mean, stddev_samp(f) AS sd, count(*) AS n_motifs FROM (
      SELECT w.label, w.mid, CAST(ceil(rel / 5) AS BIGINT) * 5 - 5 AS rel_bin, avg(CASE WHEN status = 'U' THEN 1 ELSE 0 END) AS f FROM (
        SELECT m.strand AS label, m.chrom || '_' || m.center || m.strand AS mid, c.status, (c.call_pos - m.center) * CASE WHEN m.strand = '+' THEN -1 ELSE 1 END AS rel
        FROM calls c JOIN motifs m ON c.chrom = m.chrom AND c."start" < m.center + 200 AND c."end" > greatest(m.center - 200, 0)) w
      WHERE rel > -200 AND rel <= 200 GROUP BY ALL) GROUP BY label, rel_bin)""", "calls", "motifs"), dbl="mean sd smooth")(
    lambda s, d: (lambda m: rc.s1b(ad.calls(s, d), {"+": m.filter("strand = '+'"), "-": m.filter("strand = '-'")}, 200))(ad.motifs(s, d)))
query("S1C_dynamic_curve_fit")(lambda s, d: fits.fit_saturation(rc.s1c(ad.calls_motif(s, d)).withColumn("grp", F.lit("all")), ["grp"]))
query("S1E_class_profiles", sql(f"""SELECT label, rel_bin, frac_u FROM (SELECT DISTINCT label FROM pr) CROSS JOIN (SELECT unnest(range(-600, 601, 5)) AS rel_bin) LEFT JOIN pr USING (label, rel_bin)""",
    "calls", "motifs", cm=_NR.format(w="AND abs(c.call_pos - m.center) <= 1500"),
    mu="SELECT *, 6 + CAST(floor(rel_pos / 3) AS BIGINT) AS zf, CASE WHEN status = 'U' THEN 1 ELSE 0 END AS is_u FROM cm WHERE status <> 'N'",
    psum="SELECT motif_id, read_id, sum(b) AS n_bound, count(*) AS n_measured FROM (SELECT motif_id, read_id, zf, max(is_u) AS b FROM mu WHERE zf BETWEEN 1 AND 11 GROUP BY ALL) GROUP BY motif_id, read_id",
    nuc40="""SELECT motif_id, read_id FROM mu WHERE rel_pos BETWEEN -60 AND -40 GROUP BY ALL HAVING min(is_u) = 1 UNION ALL
             SELECT motif_id, read_id FROM mu WHERE rel_pos BETWEEN 40 AND 60 GROUP BY ALL HAVING min(is_u) = 1""",
    lab=_LABELS, pr="""SELECT label, CAST(floor(rel_pos / 5) AS BIGINT) * 5 AS rel_bin, avg(is_u) AS frac_u FROM mu JOIN lab USING (motif_id, read_id)
                       WHERE rel_pos BETWEEN -600 AND 600 GROUP BY 1, 2"""), dbl="frac_u")(lambda s, d: rc.s1e(ad.calls(s, d), ad.motifs(s, d)))
query("S1F_conditional", sql(_cond_sql(1), "b", "nuc20", **_CVIEWS), dbl="p_bound", ints="zf_j")(lambda s, d: rc.s1f(ad.calls_motif(s, d)))


def _two_tracks(s, d):
    t = ad.track(s, d)
    return {"ref": t, "half": t.withColumn("value", F.col("value") / 2)}


query("S21_region_profiles", sql("""SELECT track, bin, mean FROM (
    SELECT 'ref' AS track, bin, avg(v) AS mean FROM rm GROUP BY bin UNION ALL SELECT 'half', bin, avg(v) FROM rm GROUP BY bin)""", "motifs", "track", rm="""
    SELECT region_id, bin, avg(v) AS v FROM (SELECT g.chrom || '_' || center || strand AS region_id, CASE WHEN strand = '+' THEN 9 - bin ELSE bin END AS bin, v FROM
      (SELECT chrom, strand, center, unnest(range(10)) AS bin FROM motifs) g LEFT JOIN
      (SELECT chrom, base, value AS v FROM (SELECT chrom, value, unnest(range("start", "end")) AS base FROM track)) t
      ON g.chrom = t.chrom AND base >= center - 500 + bin * 100 AND base < center - 400 + bin * 100) GROUP BY ALL"""), dbl="mean")(
    lambda s, d: rc.s21(ad.motifs(s, d), _two_tracks(s, d), "ref", 500, 100).select("track", "bin", "mean"))

# ---- trace recipes

query("RT1_condition_traces", sql("""SELECT trace_id, bucket, signal - regr_slope(sm, t) OVER (PARTITION BY trace_id) * t - regr_intercept(signal, t) OVER (PARTITION BY trace_id) + 12.0 AS corrected FROM (
    SELECT *, avg(signal) OVER (PARTITION BY trace_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS sm FROM (
      SELECT trace_id, bucket, avg(t) AS t, avg(signal) AS signal FROM
        (SELECT *, CAST(floor(round((t - min(t) OVER (PARTITION BY trace_id)) * 1e6, 3) / 43200000000) AS BIGINT) AS bucket FROM traces) GROUP BY trace_id, bucket)
    WHERE t > 100000 AND t < 2400000)""", "traces"), dbl="corrected")(
    lambda s, d: rc.rt1(ad.traces(s, d), 43_200_000_000, 100000, 2400000, 6).select("trace_id", F.col("ev").alias("bucket"), "corrected"))


def _kinetics(s, d):
    r = rc.rt2(ad.traces(s, d).withColumn("t", F.col("t") / 10000), 3, ITER, 20.0)
    return r["lifetimes"].join(r["signal"], "state")


query("RT2_kinetics")(_kinetics)


def _conditions(s, d):
    t = ad.traces(s, d)
    return {"base": t.filter("condition IN ('0', '1')"), "mixed": t.filter("condition IN ('2', '3')")}


query("RT3_regimes")(lambda s, d: rc.rt3(_conditions(s, d), BASE, "base", 20, 5, 2, 2.0)["summary"])
query("RT4_force_dependence")(lambda s, d: st.score_models(rc.rt4(ad.traces(s, d), BASE, [12.7, 12.0, 11.0], 140.0), _M, 0.2))


def _unzip(s, d, deg):
    c = curves(s, d).drop("idx", "n_rows")
    base = c.filter("trace_id < 7").withColumnRenamed("trace_id", "curve")
    c = c.withColumn("baseline_curve", F.expr("CASE WHEN trace_id % 3 = 0 THEN NULL ELSE trace_id % 7 END")).withColumn(
        "date", (F.col("trace_id") % 4).cast("string")).withColumnRenamed("trace_id", "curve")
    return rc.unzip(c, base, calibration(s, d), 20, deg).select("curve", "ev", "extension", "force_mean")


query("RU_unzip", sql("""SELECT curve, ev, trap - g1 / ((0.2 + (curve % 17) * 0.01) * 1000) - g2 / ((0.2 + (curve % 17) * 0.02) * 1000) AS extension, (g1 + g2) / 2 AS force_mean FROM (
    SELECT *, b1 - avg(b1) FILTER (WHERE idx < 20) OVER (PARTITION BY curve) + 0.1 AS g1, b2 - avg(b2) FILTER (WHERE idx < 20) OVER (PARTITION BY curve) + 0.1 AS g2 FROM (
      SELECT trace_id AS curve, ev, idx, trap, CASE WHEN s1 IS NULL THEN f1 ELSE f1 - (i1 + s1 * trap) END AS b1, CASE WHEN s2 IS NULL THEN f2 ELSE f2 - (i2 + s2 * trap) END AS b2
      FROM cu LEFT JOIN (SELECT trace_id AS bc, regr_slope(f1, trap) AS s1, regr_intercept(f1, trap) AS i1, regr_slope(f2, trap) AS s2, regr_intercept(f2, trap) AS i2
        FROM cu WHERE trace_id < 7 AND trap > 2.3 GROUP BY trace_id) ON bc = CASE WHEN trace_id % 3 = 0 THEN NULL ELSE trace_id % 7 END))""", "traces", cu=_CURVE), dbl="extension force_mean")(
    lambda s, d: _unzip(s, d, 1))
query("RU_unzip_degree_seven")(lambda s, d: _unzip(s, d, 7))
