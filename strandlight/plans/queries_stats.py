"""Queries on correlations, rank tests, corrections and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlight.functions import calls as fc
from strandlight.functions import fits, tails
from strandlight.operators import binding as bd
from strandlight.operators import lookups as lk
from strandlight.operators import stats as st
from strandlight.plans.oracle import sql
from strandlight.plans.queries_binding import BINS, CL, CL_MEANS, NDR, r1b_states
from strandlight.plans.registry import query
from strandlight.sources import adapters as ad

_IN = ", ".join(map(str, BINS))
_POS = "CASE zf " + " ".join(f"WHEN {z} THEN {i}" for i, z in enumerate(BINS)) + " END"


def bp(s, d):
    return bd.binding_prob(r1b_states(s, d), NDR)


_CORR = f"""SELECT track, zf, count(*) AS n,
    CASE WHEN count(*) >= 2 AND min(binding_prob) < max(binding_prob) AND min(signal) < max(signal) THEN corr(binding_prob, signal) END AS r
    FROM bp JOIN signals USING (motif_id) WHERE binding_prob IS NOT NULL AND signal IS NOT NULL AND zf IN ({_IN}) GROUP BY track, zf"""
query("D23_corr_tracks", sql(_CORR, "bp", "signals"), dbl="r")(lambda s, d: st.corr_tracks(bp(s, d), ad.signals(s, d), BINS))
query("C21_bin_track_join", sql(f"""SELECT track, zf, count(*) AS n, avg(binding_prob * signal) AS m FROM bp JOIN signals USING (motif_id)
    WHERE binding_prob IS NOT NULL AND zf IN ({_IN}) GROUP BY track, zf""", "bp", "signals"), dbl="m")(
    lambda s, d: bp(s, d).filter(F.col("zf").isin(BINS) & F.col("binding_prob").isNotNull()).join(ad.signals(s, d), "motif_id").groupBy(
        "track", "zf").agg(F.count("*").alias("n"), F.avg(F.col("binding_prob") * F.col("signal")).alias("m")))
query("T2_pearson_p")(lambda s, d: st.corr_table(bp(s, d), ad.signals(s, d), BINS))
query("F3_order_tracks", sql(f"SELECT track, avg(r) AS mean_r FROM ({_CORR}) WHERE zf BETWEEN 1 AND 11 GROUP BY track", "bp", "signals"), dbl="mean_r")(
    lambda s, d: lk.order_tracks(st.corr_tracks(bp(s, d), ad.signals(s, d), BINS), list(range(1, 12))))

_WIL = dict(
    v=f"SELECT motif_id, zf, {_POS} AS ps, binding_prob AS x FROM bp WHERE binding_prob IS NOT NULL AND zf IN ({_IN})",
    pr="SELECT a.zf AS bin1, b.zf AS bin2, a.x, b.x AS y, a.x - b.x AS d FROM v a JOIN v b USING (motif_id) WHERE a.ps < b.ps",
    rk="""SELECT bin1, bin2, d, rank() OVER (PARTITION BY bin1, bin2 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY bin1, bin2, abs(d)) - 1) / 2.0 AS r,
          count(*) OVER (PARTITION BY bin1, bin2, abs(d)) AS c FROM pr WHERE d <> 0""",
    w="""SELECT bin1, bin2, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS wp, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS wm, count(*) AS n_used,
         sum(CAST(c * c - 1 AS DOUBLE)) AS tie_term FROM rk GROUP BY ALL""",
    m="""SELECT bin1, bin2, count(*) AS n_paired, count(*) FILTER (WHERE d = 0) AS n_zero, avg(x) AS mean1, avg(y) AS mean2, max(abs(d)) AS top FROM pr GROUP BY ALL""",
)
query("S1_pairwise_wilcoxon", sql("""SELECT bin1, bin2, n_paired, coalesce(n_used, 0) AS n_used, n_zero, mean1, mean2, mean1 - mean2 AS delta_mean,
    CASE WHEN top <= 1e-8 THEN 0 ELSE least(wp, wm) END AS stat, coalesce(tie_term, 0) AS tie_term FROM m LEFT JOIN w USING (bin1, bin2)""", "bp", **_WIL),
    dbl="mean1 mean2 delta_mean stat tie_term")(lambda s, d: st.pairwise_wilcoxon(bp(s, d), BINS).drop("flat"))
query("S1_pairwise_tests")(lambda s, d: st.pairwise_tests(bp(s, d), BINS))
query("S1_pairwise_mannwhitney")(lambda s, d: st.pairwise_tests(bp(s, d), BINS, "mannwhitney"))


def sides(s, d):
    """Cluster means of motifs on '+' (side 1) and '-' (side 2)."""
    return bd.cluster_means(bp(s, d), CL).withColumn("side", F.when(F.col("motif_id").endswith("+"), 1).otherwise(2))


_SIDES = dict(
    cv=f"SELECT motif_id, cluster, CASE WHEN motif_id LIKE '%+' THEN 1 ELSE 2 END AS side, value FROM ({CL_MEANS}) WHERE value IS NOT NULL",
    rk="""SELECT *, rank() OVER (PARTITION BY cluster ORDER BY value) + (count(*) OVER (PARTITION BY cluster, value) - 1) / 2.0 AS r,
          CAST(count(*) OVER (PARTITION BY cluster, value) AS DOUBLE) AS c FROM cv""",
    g="""SELECT cluster, count(*) FILTER (WHERE side = 1) AS n1, count(*) FILTER (WHERE side = 2) AS n2, sum(r) FILTER (WHERE side = 1) AS r1,
         sum(r) FILTER (WHERE side = 2) AS r2, sum(c * c - 1) AS tie_term FROM rk GROUP BY cluster""",
    u="""SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u1, n1 * n2 - (r1 - n1 * (n1 + 1) / 2.0) AS u2,
         sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tie_term / ((n1 + n2) * (n1 + n2 - 1)))) AS sd_u FROM g""",
)
query("S2_mann_whitney", sql("""SELECT cluster, n1, n2, r1, r2, tie_term, u1, u2, least(u1, u2) AS u, sd_u, (least(u1, u2) - n1 * n2 / 2.0) / sd_u AS z FROM u""", "bp", **_SIDES),
      dbl="r1 r2 tie_term u1 u2 u sd_u z")(
    lambda s, d: st.mann_whitney(sides(s, d), ["cluster"], "side", "value").drop("mean1", "mean2", "p_value"))
_MCI = """SELECT cluster, side, median(value) AS median, any_value(n) AS n, max(value) FILTER (WHERE rn = greatest(1, floor(n / 2.0 - 0.5 * 1.959963984540054 * sqrt(n)))) AS ci_low,
    max(value) FILTER (WHERE rn = least(n, ceil(n / 2.0 + 0.5 * 1.959963984540054 * sqrt(n)))) AS ci_high FROM
    (SELECT *, row_number() OVER (PARTITION BY cluster, side ORDER BY value) AS rn, count(*) OVER (PARTITION BY cluster, side) AS n FROM cv) GROUP BY cluster, side"""
query("S3_median_ci", sql(_MCI, "bp", **_SIDES), dbl="median ci_low ci_high")(lambda s, d: st.median_ci(sides(s, d), ["cluster", "side"], "value"))
_HL = """SELECT cluster, median(dv) AS hl, max(dv) FILTER (WHERE rn = greatest(1, k + 1)) AS hl_low, max(dv) FILTER (WHERE rn = least(nn, nn - k)) AS hl_high FROM
    (SELECT a.cluster, b.value - a.value AS dv, row_number() OVER (PARTITION BY a.cluster ORDER BY b.value - a.value) AS rn, count(*) OVER (PARTITION BY a.cluster) AS nn,
     CAST(floor(n1 * n2 / 2.0 - 1.959963984540054 * sd_u) AS BIGINT) AS k
     FROM cv a JOIN cv b ON a.cluster = b.cluster AND a.side = 1 AND b.side = 2 JOIN u ON u.cluster = a.cluster) GROUP BY cluster"""
query("S3_hodges_lehmann", sql(_HL, "bp", **_SIDES), dbl="hl hl_low hl_high")(
    lambda s, d: st.hodges_lehmann(sides(s, d), "cluster", "side", "value"))
query("S3_rank_test_values", sql("""SELECT u.cluster, n1, n2, r1, r2, least(u1, u2) AS u, a.median AS median_high, a.ci_low AS ci_low_high, a.ci_high AS ci_high_high,
    b.median AS median_low, b.ci_low AS ci_low_low, b.ci_high AS ci_high_low, hl, hl_low, hl_high, b.median - a.median AS difference
    FROM u JOIN mc a ON a.cluster = u.cluster AND a.side = 1 JOIN mc b ON b.cluster = u.cluster AND b.side = 2 JOIN hl ON hl.cluster = u.cluster""",
    "bp", **_SIDES, mc=_MCI, hl=_HL), dbl="r1 r2 u median_high ci_low_high ci_high_high median_low ci_low_low ci_high_low hl hl_low hl_high difference")(
    lambda s, d: st.rank_test_table(sides(s, d), "cluster", "side", "value").drop("p_value", "stars"))
query("S3_rank_test_table")(lambda s, d: st.rank_test_table(sides(s, d), "cluster", "side", "value"))

# p-values of orders: a deterministic pseudo-p with ties and gaps
_PV = "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_custkey % 997 + 1) / 1000.0 END"
_BH = f"""WITH t AS (SELECT o_orderkey, {_PV} AS p FROM orders), v AS (SELECT *, {{pe}} AS q FROM t), r AS (
    SELECT *, least(q * (SELECT count(q) FROM v) / rank_hi, 1.0) AS a FROM
      (SELECT *, CASE WHEN q IS NOT NULL THEN count(q) OVER (ORDER BY q RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS rank_hi FROM v))
    SELECT o_orderkey, p, CASE WHEN q IS NOT NULL THEN min(a) OVER (ORDER BY q DESC NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS p_adj FROM r"""


def _pvals(s, d):
    return ad.table(s, d, "orders").selectExpr("o_orderkey", f"CAST({_PV} AS DOUBLE) AS p")


query("S4_bh_adjust", _BH.format(pe="p"), dbl="p p_adj")(lambda s, d: st.bh_adjust(_pvals(s, d), "p"))
query("S4_bh_adjust_missing_one", _BH.format(pe="coalesce(p, 1.0)"), dbl="p p_adj")(lambda s, d: st.bh_adjust(_pvals(s, d), "p", missing="one"))
query("B25_neglog10p_stars", f"""SELECT o_orderkey, -log10(greatest(least(p, 1.0), 1e-300)) AS nlp,
    CASE WHEN p < 1e-4 THEN '****' WHEN p < 1e-3 THEN '***' WHEN p < 1e-2 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS mark
    FROM (SELECT o_orderkey, pow(o_custkey % 997 / 1000.0, 4) AS p FROM orders)""", dbl="nlp")(
    lambda s, d: ad.table(s, d, "orders").selectExpr("o_orderkey", "pow(o_custkey % 997 / 1000D, 4) AS p").select(
        "o_orderkey", fc.neglog10p("p").alias("nlp"), fc.stars("p").alias("mark")))
query("S5_chi2_gof", """SELECT l_returnflag, sum((o - e * s) * (o - e * s) / (e * s)) AS chi2, count(*) - 1 AS dof FROM
    (SELECT *, sum(o) OVER (PARTITION BY l_returnflag) / sum(e) OVER (PARTITION BY l_returnflag) AS s FROM
     (SELECT l_returnflag, l_linenumber, CAST(count(*) AS DOUBLE) AS o, sum(l_quantity) AS e FROM lineitem GROUP BY ALL)) GROUP BY l_returnflag""", dbl="chi2")(
    lambda s, d: st.chi2_gof(ad.table(s, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(
        F.count("*").cast("double").alias("o"), F.sum("l_quantity").alias("e")), ["l_returnflag"], "o", "e").drop("p_value"))
query("T1_norm_p")(lambda s, d: ad.table(s, d, "orders").selectExpr("o_orderkey", "(o_totalprice - 250000D) / 100000D AS z").withColumn("p", tails.norm_p("z")))
query("T3_chi2_p")(lambda s, d: st.chi2_gof(ad.table(s, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(
    F.count("*").cast("double").alias("o"), F.sum("l_quantity").alias("e")), ["l_returnflag"], "o", "e"))
query("T4_fit_saturation")(lambda s, d: fits.fit_saturation(
    bd.dynamic_curve(r1b_states(s, d), "eq", 5).withColumn("grp", F.lit("all")), ["grp"]))

# one row per trace: occupancy of state 0 with errors, against the mean signal as force
_OCC = """SELECT trace_id, 10 + avg(signal) / 25 AS force, 0.05 + stddev_samp(signal) / 1000 AS force_se,
    avg(CASE WHEN state = 0 THEN 1.0 ELSE 0.0 END) AS p_obs, 0.02 + 1.0 / count(*) AS p_se FROM states GROUP BY trace_id"""
_M = st.two_barrier([0.2, 0.5, 0.3], 0.7, 0.5)
_E12 = f"exp(-({_M['g12']!r} - force * 0.7) / 4.1)"
_E23 = f"exp(-({_M['g12']!r} - force * 0.7 + {_M['g23']!r} - force * 0.5) / 4.1)"


def occ_table(s, d):
    return ad.states(s, d).groupBy("trace_id").agg(
        (10 + F.avg("signal") / 25).alias("force"), (0.05 + F.stddev_samp("signal") / 1000).alias("force_se"),
        F.avg((F.col("state") == 0).cast("double")).alias("p_obs"), (0.02 + 1.0 / F.count("*")).alias("p_se"))


query("S6_score_models", sql("""SELECT model, chi2, n - k_dof AS dof, ll AS log_lik, 2 * k - 2 * ll AS aic, k * ln(n) - 2 * ll AS bic FROM (
    SELECT 'two_barrier' AS model, 2 AS k, 2 AS k_dof, count(*) AS n, sum(pow((p_obs - pm) / sqrt(p_se * p_se + sl * sl * force_se * force_se), 2)) AS chi2,
           -0.5 * sum(pow((p_obs - pm) / p_se, 2) + ln(2 * pi() * p_se * p_se)) AS ll FROM q
    UNION ALL SELECT 'constant', 1, 1, count(*), sum(pow((p_obs - 0.2) / p_se, 2)), -0.5 * sum(pow((p_obs - 0.2) / p_se, 2) + ln(2 * pi() * p_se * p_se)) FROM q)""",
    "states", occ=_OCC, q=f"""SELECT *, 1 / (1 + a + b) AS pm, (-0.7 * a - 1.2 * b) / (4.1 * (1 + a + b) * (1 + a + b)) AS sl
    FROM (SELECT *, {_E12} AS a, {_E23} AS b FROM occ)"""), dbl="chi2 log_lik aic bic")(
    lambda s, d: st.score_models(occ_table(s, d), _M, 0.2).drop("p_value", "n_left_out"))
