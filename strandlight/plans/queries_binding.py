"""Queries on binding tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlight.functions import calls as fc
from strandlight.operators import binding as bd
from strandlight.operators import lookups as lk
from strandlight.plans.oracle import sql
from strandlight.plans.registry import query
from strandlight.sources import adapters as ad
from strandlight.util import bit

NDR = bd.Windows(ndr=(20, 60), nuc=(20, 60))
PROFILE = bd.Windows(nuc=(40, 60))
R1B_FILTERS = bd.Filters(mol_threshold=1, exclude_up=True, exclude_down=True)
BINS = [z for z, _ in bd.bin_spec(NDR, hide5=True)]
_P = "motif_id, read_id"


def r1b_states(spark, sf_dir):
    cm = ad.calls_motif(spark, sf_dir)
    return bd.pair_states(bd.pair_masks(cm, NDR, 1), R1B_FILTERS)


def b_table(spark, sf_dir, n=0):
    return bd.binding_table(ad.calls_motif(spark, sf_dir), n)


# ---- projections

query(
    "B14_rel_pos",
    sql("SELECT motif_id, read_id, call_pos, center, rel_pos FROM cm", "cm"),
)(lambda s, d: ad.calls_motif(s, d).select("motif_id", "read_id", "call_pos", "center", "rel_pos"))

query(
    "B14_rel_pos_lenient",
    sql("""SELECT m.chrom, m.center, c.call_pos,
           (c.call_pos - m.center) * CASE WHEN m.strand = '-' THEN 1 ELSE 1 END AS rel_pos
           FROM calls c JOIN motifs m ON c.chrom = m.chrom AND c."start" < m."end" AND c."end" > m."start"
           WHERE m.strand = '-'
           UNION ALL
           SELECT m.chrom, m.center, c.call_pos, c.call_pos - m.center
           FROM calls c JOIN motifs m ON c.chrom = m.chrom AND c."start" < m."end" AND c."end" > m."start"
           WHERE m.strand = '+'""", "calls", "motifs"),
)(
    lambda s, d: ad.calls_with_motifs(
        ad.calls(s, d),
        ad.motifs(s, d).withColumn("strand", F.when(F.col("strand") == "+", "?").otherwise(F.col("strand"))),
        on_bad="plus",
    ).select("chrom", "center", "call_pos", "rel_pos")
)

query(
    "B15_zf_bin",
    sql("SELECT zf, count(*) AS n, min(rel_pos) AS lo, max(rel_pos) AS hi FROM mu GROUP BY zf", "mu"),
)(
    lambda s, d: ad.calls_motif(s, d)
    .filter(F.col("status") != "N")
    .groupBy(fc.zf_bin("rel_pos").alias("zf"))
    .agg(F.count("*").alias("n"), F.min("rel_pos").alias("lo"), F.max("rel_pos").alias("hi"))
)

query(
    "B16_pos_bin",
    sql("""SELECT CAST(floor(rel_pos / 5) AS BIGINT) * 5 AS rel_bin, count(*) AS n FROM cm
           WHERE rel_pos BETWEEN -50 AND 50 GROUP BY 1""", "cm"),
)(
    lambda s, d: ad.calls_motif(s, d)
    .filter(F.col("rel_pos").between(-50, 50))
    .groupBy(fc.pos_bin("rel_pos", 5).alias("rel_bin"))
    .agg(F.count("*").alias("n"))
)

query(
    "B17_pos_bin_right_closed",
    sql("""SELECT CAST(ceil(rel_pos / 5) AS BIGINT) * 5 - 5 AS rel_bin, count(*) AS n FROM cm
           WHERE rel_pos > -50 AND rel_pos <= 50 GROUP BY 1""", "cm"),
)(
    lambda s, d: ad.calls_motif(s, d)
    .withColumn("rel_bin", fc.pos_bin_rc("rel_pos", 5, 50))
    .filter("rel_bin IS NOT NULL")
    .groupBy("rel_bin")
    .agg(F.count("*").alias("n"))
)

query(
    "B18_binary_calls",
    sql(f"SELECT {_P}, rel_pos, status, is_u AS bound FROM mu", "mu"),
)(lambda s, d: fc.binary_calls(ad.calls_motif(s, d)).select("motif_id", "read_id", "rel_pos", "status", "bound"))


def _remap(scheme):
    case = " ".join(
        f"WHEN zf IN ({', '.join(map(str, m))}) THEN {t}" for t, m in bd.SCHEMES[scheme].items()
    )
    return sql(
        f"SELECT {_P}, CASE {case} ELSE zf END AS zf, max(bound) AS bound FROM a GROUP BY ALL",
        "b", "ndr", a=f"SELECT {_P}, zf, bound FROM b UNION ALL SELECT {_P}, zf, bound FROM ndr",
    )


def _with_ndr(s, d):
    cm = ad.calls_motif(s, d)
    return bd.binding_table(cm).unionByName(bd.window_bins(cm, bd.Windows(ndr=(20, 60))))


query("B19_remap_three_clusters", _remap("3"))(lambda s, d: bd.remap_bins(_with_ndr(s, d), "3"))
query("B19_remap_five_clusters", _remap("5"))(lambda s, d: bd.remap_bins(_with_ndr(s, d), "5"))

_W_ALL = bd.Windows(ndr=(20, 60), near=(16, 30), flank_bins=8)
_TILES = [(-i, -(18 + 3 * i - 1), -(18 + 3 * (i - 1))) for i in range(1, 9)]
_TILES += [(20 + i, 18 + 3 * (i - 1), 18 + 3 * i - 1) for i in range(1, 9)]
_ALLWIN = [(0, -60, -20), (12, 20, 60), (13, -30, -16), (14, 16, 30)] + _TILES
_WIN_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({c}, {lo}, {hi})" for c, lo, hi in _ALLWIN) + ") v(zf, lo, hi)"


def _b20(s, d):
    """Rows per reported bin, in axis order with labels."""
    spec = s.createDataFrame(
        [(i, z, lab) for i, (z, lab) in enumerate(bd.bin_spec(_W_ALL, hide5=True))], "ord int, zf int, label string"
    )
    cm = ad.calls_motif(s, d)
    rows = bd.binding_table(cm).unionByName(bd.window_bins(cm, _W_ALL)).groupBy("zf").agg(F.count("*").alias("n"))
    return spec.join(rows, "zf", "left").select("ord", "label", F.coalesce("n", F.lit(0)).alias("n"))


_SPEC_ROWS = (
    [(-i, str(-i)) for i in range(8, 0, -1)] + [(0, "N_NDR"), (13, "N_COH")]
    + [(z, f"ZF{z}") for z in range(1, 12) if z != 5] + [(14, "C_COH"), (12, "C_NDR")]
    + [(20 + i, f"+{i}") for i in range(1, 9)]
)
query(
    "B20_bin_spec",
    sql("""SELECT s.ord, s.label, count(r.zf) AS n FROM spec s LEFT JOIN
           (SELECT zf FROM b UNION ALL SELECT zf FROM w) r USING (zf) GROUP BY ALL""", "b", "mu",
        win=_WIN_SQL,
        w=f"SELECT DISTINCT {_P}, win.zf FROM mu JOIN win ON rel_pos BETWEEN lo AND hi",
        spec="SELECT * FROM (VALUES " + ", ".join(
            f"({i}, {z}, '{lab}')" for i, (z, lab) in enumerate(_SPEC_ROWS)) + ") v(ord, zf, label)"),
    ints="ord",
)(_b20)

# ---- binding tables and filters

query("D1_binding_table", sql(f"SELECT {_P}, zf, bound FROM b", "b"))(
    lambda s, d: b_table(s, d).select("motif_id", "read_id", "zf", "bound")
)
query("D2_min_calls", sql(f"SELECT {_P}, zf, bound, n_calls FROM b WHERE n_calls >= 2", "b"))(
    lambda s, d: bd.min_calls(b_table(s, d), 2)
)
query("D3_mol_threshold", sql(
    f"SELECT {_P}, zf, bound FROM b JOIN psum USING ({_P}) WHERE n_bound >= 2", "psum"))(
    lambda s, d: bd.mol_threshold(b_table(s, d), 2).drop("n_calls")
)
query("D3_mol_threshold_exact", sql(
    f"SELECT {_P}, zf, bound FROM b JOIN psum USING ({_P}) WHERE n_bound = 1", "psum"))(
    lambda s, d: bd.mol_threshold(b_table(s, d), 1, exact=True).drop("n_calls")
)
query("D4_focus_filter", sql(
    f"""SELECT {_P}, zf, bound FROM b SEMI JOIN (SELECT {_P} FROM b WHERE zf IN (4, 5, 6, 7) AND bound = 1
        GROUP BY ALL HAVING count(*) >= 1) f USING ({_P})""", "b"))(
    lambda s, d: bd.focus_filter(b_table(s, d), [4, 5, 6, 7], 1).drop("n_calls")
)
query("D5_drop_all_bound", sql(
    f"SELECT {_P}, zf, bound FROM b JOIN psum USING ({_P}) WHERE n_bound < n_measured", "psum"))(
    lambda s, d: bd.drop_all_bound(b_table(s, d)).drop("n_calls")
)
query("D6_window_bins", sql(
    f"""SELECT {_P}, win.zf, max(is_u) AS bound, count(*) AS n_calls FROM mu JOIN win
        ON rel_pos BETWEEN lo AND hi GROUP BY ALL""", "mu", win=_WIN_SQL), ints="zf")(
    lambda s, d: bd.window_bins(ad.calls_motif(s, d), _W_ALL)
)
query("D7_nucleosome_pairs", sql(f"SELECT {_P}, side FROM nuc20", "nuc20"))(
    lambda s, d: bd.nucleosome_pairs(ad.calls_motif(s, d), 20, 60)
)
_CLS = """CASE WHEN coalesce(n_measured, 0) = 0 THEN 'missing' WHEN n_bound = 0 THEN 'naked'
          WHEN n_bound = n_measured THEN 'static' ELSE 'dynamic' END"""
query("D8_pair_class", sql(f"""
    SELECT {_P}, coalesce(n_bound, 0) AS n_bound, coalesce(n_measured, 0) AS n_measured, {_CLS} AS cls
    FROM (SELECT DISTINCT {_P} FROM a) p LEFT JOIN psum USING ({_P})""", "psum", "ndr",
    a=f"SELECT {_P} FROM b UNION ALL SELECT {_P} FROM ndr"), ints="n_bound n_measured")(
    lambda s, d: bd.pair_class(_with_ndr(s, d))
)
for _mode, _sel in (("dynamic", "n_bound > 0 AND n_bound < n_measured"), ("static", "n_bound = n_measured")):
    query(f"D9_pair_filter_{_mode}", sql(
        f"SELECT {_P}, zf, bound FROM b JOIN psum USING ({_P}) WHERE {_sel} AND n_measured >= 2", "psum"))(
        lambda s, d, m=_mode: bd.pair_filter(b_table(s, d), m, 2).drop("n_calls")
    )

# ---- binding probability and summaries

query("D10_binding_prob", sql("SELECT * FROM bp", "bp"), dbl="binding_prob")(
    lambda s, d: bd.binding_prob(r1b_states(s, d), NDR)
)
query("D10_binding_prob_total", sql("""
    SELECT motif_id, zf, num_bound_kept, den_kept, greatest(den_total, den_kept) AS den_total,
           num_bound_kept / nullif(greatest(den_total, den_kept), 0) AS binding_prob FROM bp""", "bp"),
    dbl="binding_prob")(lambda s, d: bd.binding_prob(r1b_states(s, d), NDR, denom="total"))

_C3 = " ".join(f"WHEN zf IN ({', '.join(map(str, m))}) THEN {t}" for t, m in bd.CLUSTERS3.items())
query("D10_binding_prob_clusters", sql(f"""
    SELECT motif_id, zf, coalesce(num, 0) AS num_bound_kept, coalesce(den, 0) AS den_kept,
           coalesce(dt, 0) AS den_total, num / nullif(den, 0) AS binding_prob
    FROM (SELECT motif_id, zf, sum(bound) AS num, count(*) AS den FROM
          (SELECT {_P}, CASE {_C3} ELSE zf END AS zf, max(bound) AS bound FROM fin GROUP BY ALL) GROUP BY ALL)
    FULL JOIN (SELECT motif_id, CASE {_C3} ELSE zf END AS zf, count(DISTINCT read_id) AS dt FROM total GROUP BY ALL)
    USING (motif_id, zf)""", "fin", "total"), dbl="binding_prob", ints="num_bound_kept")(
    lambda s, d: bd.binding_prob(r1b_states(s, d), NDR, scheme="3")
)
query("D2_min_calls_masks", sql(f"""
    SELECT motif_id, zf, sum(bound) AS num_bound_kept, count(*) AS den_kept, count(*) AS den_total,
           avg(bound) AS binding_prob FROM b WHERE n_calls >= 2 GROUP BY ALL""", "b"),
    dbl="binding_prob", ints="num_bound_kept")(
    lambda s, d: bd.binding_prob(bd.pair_states(bd.pair_masks(ad.calls_motif(s, d), min_calls=2), bd.Filters()))
)
query("D11_bin_stats", sql("""
    SELECT zf, count(*) AS n, avg(binding_prob) AS mean, coalesce(stddev_samp(binding_prob), 0) AS sd,
           coalesce(stddev_samp(binding_prob), 0) / sqrt(count(*)) AS sem
    FROM bp WHERE binding_prob IS NOT NULL GROUP BY zf""", "bp"), dbl="mean sd sem")(
    lambda s, d: bd.bin_stats(bd.binding_prob(r1b_states(s, d), NDR))
)
_MAPW = ", ".join(f"count(DISTINCT read_id) FILTER (WHERE zf = {k}) AS zf{k}_reads" for k in range(1, 12))
_NMAP = " + ".join(f"CAST(zf{k}_reads >= 2 AS INT)" for k in range(1, 12))
_MAP = f"SELECT *, {_NMAP} AS n_zf_mappable FROM (SELECT motif_id, {_MAPW} FROM b GROUP BY motif_id)"
query("D12_mappability", sql(f"SELECT *, n_zf_mappable / 11.0 AS fraction_zf_mappable FROM ({_MAP})", "b"),
      dbl="fraction_zf_mappable", ints="n_zf_mappable")(
    lambda s, d: bd.mappability(ad.calls_motif(s, d), 2)
)
query("D13_mappability_by_sites", sql(f"""
    SELECT n_sites_called, count(*) AS n_motifs, avg(n_zf_mappable) AS mean_zf_mappable,
           median(n_zf_mappable) AS median_zf_mappable
    FROM ({_MAP}) JOIN (SELECT motif_id, count(DISTINCT call_pos) AS n_sites_called FROM mu
                        WHERE zf BETWEEN 1 AND 11 GROUP BY motif_id) USING (motif_id)
    GROUP BY n_sites_called""", "b"), dbl="mean_zf_mappable median_zf_mappable")(
    lambda s, d: bd.mappability_by_sites(ad.calls_motif(s, d), 2)
)
query("D14_bin_balance", sql("""
    SELECT zf, sites_tested, sites_tested / (SELECT count(DISTINCT motif_id) FROM b) AS frac_sites_tested,
           reads_tested, reads_tested / (SELECT sum(reads_tested) FROM t) AS frac_reads_tested FROM t""", "b",
    per="SELECT motif_id, zf, count(DISTINCT read_id) AS n FROM b GROUP BY ALL",
    t="""SELECT k AS zf, count(motif_id) AS sites_tested, coalesce(sum(n), 0) AS reads_tested
         FROM (SELECT unnest(range(1, 12)) AS k) LEFT JOIN (SELECT * FROM per WHERE n >= 2) ON k = zf GROUP BY k"""),
    dbl="frac_sites_tested frac_reads_tested", ints="reads_tested")(
    lambda s, d: bd.bin_balance(ad.calls_motif(s, d), 2)
)

_BINV = ", ".join(f"({z})" for z in BINS)
_SCATTER = dict(
    bins=f"SELECT * FROM (VALUES {_BINV}) v(bin)",
    kp=f"SELECT {_P}, sum(bound) AS nb, count(*) AS nm FROM kept GROUP BY ALL",
    mi="SELECT zf AS bin, count(DISTINCT motif_id) AS motifs_in_bin FROM bp WHERE binding_prob IS NOT NULL GROUP BY zf",
    ri="SELECT zf AS bin, count(DISTINCT read_id) AS reads_in_bin FROM fin GROUP BY zf",
    ex=f"""SELECT bin, sum(CASE WHEN side = 'up' THEN n ELSE 0 END) AS up, sum(CASE WHEN side = 'down' THEN n ELSE 0 END) AS dn
           FROM (SELECT zf AS bin, side, count(*) AS n FROM total JOIN nuc20 USING ({_P}) GROUP BY ALL
                 UNION ALL SELECT 0, side, count(*) FROM nuc20 WHERE side = 'up' GROUP BY side
                 UNION ALL SELECT 12, side, count(*) FROM nuc20 WHERE side = 'down' GROUP BY side) GROUP BY bin""",
    j="""SELECT bin, coalesce(motifs_in_bin, 0) AS motifs_in_bin, coalesce(reads_in_bin, 0) AS reads_in_bin,
         coalesce(up, 0) AS excluded_up_pairs, coalesce(dn, 0) AS excluded_down_pairs
         FROM bins LEFT JOIN mi USING (bin) LEFT JOIN ri USING (bin) LEFT JOIN ex USING (bin)""",
)
query("D15_scatter_stats", sql("""
    SELECT bin, motifs_in_bin, motifs_in_bin / (SELECT count(DISTINCT motif_id) FROM bp) AS frac_motifs_in_bin,
           reads_in_bin, reads_in_bin / (SELECT sum(reads_in_bin) FROM j) AS frac_reads_in_bin,
           excluded_up_pairs, excluded_down_pairs, (SELECT count(DISTINCT motif_id) FROM bp) AS total_motifs,
           (SELECT sum(reads_in_bin) FROM j) AS total_reads_bins,
           (SELECT count(DISTINCT read_id) FROM fin) AS unique_reads,
           (SELECT count(*) FROM kp WHERE nb > 0 AND nb < nm) AS dynamic_pairs,
           (SELECT count(*) FROM kp WHERE nb = nm) AS static_pairs,
           (SELECT count(DISTINCT read_id) FROM kp WHERE nb > 0 AND nb < nm) AS dynamic_unique_reads,
           (SELECT count(DISTINCT read_id) FROM kp WHERE nb = nm) AS static_unique_reads
    FROM j""", "bp", "fin", "nuc20", **_SCATTER),
    dbl="frac_motifs_in_bin frac_reads_in_bin",
    ints="bin motifs_in_bin reads_in_bin excluded_up_pairs excluded_down_pairs total_reads_bins")(
    lambda s, d: bd.scatter_stats(r1b_states(s, d), NDR, BINS)
)
query("D26_qc_summary", sql("""
    SELECT bin, motifs_in_bin, reads_in_bin, (SELECT count(DISTINCT motif_id) FROM bp) AS total_motifs,
           (SELECT count(*) FROM nuc20 WHERE side = 'up') AS excluded_up,
           (SELECT count(*) FROM nuc20 WHERE side = 'down') AS excluded_down FROM j""",
    "bp", "fin", "nuc20", **_SCATTER), ints="bin motifs_in_bin reads_in_bin")(
    lambda s, d: bd.qc_summary(r1b_states(s, d), NDR, BINS)
)


def _cat_sql(pairs: str, cat: str, side: str) -> str:
    return f"""SELECT category, coalesce(n, 0) AS n_pairs_{side}, coalesce(n, 0) / (SELECT count(*) FROM {pairs}) AS frac_pairs_{side},
        nm AS n_motifs_{side}, mean AS mean_{side}, sd AS sd_{side}
        FROM (SELECT category, count(*) AS nm, avg(f) AS mean, stddev_samp(f) AS sd, sum(c) AS n FROM (
            SELECT m.motif_id, k.category, count(p.read_id) AS c, count(p.read_id) / any_value(m.n) AS f
            FROM (SELECT motif_id, count(*) AS n FROM {pairs} GROUP BY motif_id) m
            CROSS JOIN (VALUES ('bound'), ('nucleosome'), ('nothing')) k(category)
            LEFT JOIN (SELECT *, {cat} AS cat FROM {pairs}) p ON p.motif_id = m.motif_id AND p.cat = k.category
            GROUP BY ALL) GROUP BY category)"""


_PAIRVIEWS = dict(
    nucp=f"SELECT DISTINCT {_P}, 1 AS is_nuc FROM nuc20",
    tp=f"""SELECT {_P}, max(bound) AS anyb, sum(bound) AS nb, count(*) AS nm, coalesce(any_value(is_nuc), 0) AS is_nuc
           FROM total LEFT JOIN nucp USING ({_P}) GROUP BY ALL""",
    kp=f"SELECT {_P}, max(bound) AS anyb, sum(bound) AS nb, count(*) AS nm, 0 AS is_nuc FROM kept GROUP BY ALL",
)
_CAT16 = "CASE WHEN is_nuc = 1 THEN 'nucleosome' WHEN anyb = 1 THEN 'bound' ELSE 'nothing' END"
query("D16_read_category_counts", sql(f"""
    SELECT *, sd_total / sqrt(n_motifs_total) AS sem_total, sd_kept / sqrt(n_motifs_kept) AS sem_kept
    FROM ({_cat_sql('tp', _CAT16, 'total')}) JOIN ({_cat_sql('kp', _CAT16, 'kept')}) USING (category)""",
    "total", "kept", "nuc20", **_PAIRVIEWS),
    dbl="frac_pairs_total mean_total sd_total sem_total frac_pairs_kept mean_kept sd_kept sem_kept",
    ints="n_pairs_total n_pairs_kept")(lambda s, d: bd.read_category_counts(r1b_states(s, d)))


def _dyn_sql(pairs: str, side: str) -> str:
    return f"""SELECT k, rule, kind, CAST(sum(v) AS BIGINT) AS n_pairs_{side}, sum(den) AS den_pairs_{side},
        count(*) AS n_motifs_{side}, avg(v / den) AS mean_{side}, coalesce(stddev_samp(v / den), 0) AS sd_{side},
        sum(v) / sum(den) AS frac_pairs_{side}, coalesce(stddev_samp(v / den), 0) / sqrt(count(*)) AS sem_{side}
        FROM (SELECT k, rule, kind, motif_id, count(*) AS den,
                     sum(CASE WHEN (nb = nm) = (kind = 'static') THEN 1 ELSE 0 END) AS v
              FROM {pairs} CROSS JOIN (VALUES (2), (3), (4), (5)) a(k) CROSS JOIN (VALUES ('ge'), ('eq')) r(rule)
              CROSS JOIN (VALUES ('dynamic'), ('static')) t(kind)
              WHERE anyb = 1 AND is_nuc = 0 AND (CASE WHEN rule = 'ge' THEN nm >= k ELSE nm = k END)
              GROUP BY ALL) GROUP BY ALL"""


query("D17_dynamic_static_by_k", sql(f"""
    SELECT * FROM ({_dyn_sql('tp', 'total')}) FULL JOIN ({_dyn_sql('kp', 'kept')}) USING (k, rule, kind)""",
    "total", "kept", "nuc20", **_PAIRVIEWS),
    dbl="mean_total sd_total frac_pairs_total sem_total mean_kept sd_kept frac_pairs_kept sem_kept",
    ints="k n_pairs_total n_pairs_kept den_pairs_total den_pairs_kept")(
    lambda s, d: bd.dynamic_static_by_k(r1b_states(s, d)).filter("n_motifs_total > 0")
)
_CAT18 = "CASE WHEN anyb = 1 THEN 'bound' WHEN is_nuc = 1 THEN 'nucleosome' ELSE 'nothing' END"
query("D18_category_summary", sql(f"""
    SELECT category, mean_total, sd_total, n_motifs_total, mean_kept, sd_kept, n_motifs_kept
    FROM ({_cat_sql('tp', _CAT18, 'total')}) JOIN ({_cat_sql('fp', _CAT18, 'kept')}) USING (category)""",
    "total", "fin", "nuc20", **_PAIRVIEWS,
    fp=f"""SELECT {_P}, max(CASE WHEN zf NOT IN (0, 12) THEN bound ELSE 0 END) AS anyb, 0 AS is_nuc
           FROM fin GROUP BY ALL"""), dbl="mean_total sd_total mean_kept sd_kept")(
    lambda s, d: bd.category_summary(r1b_states(s, d), NDR)
)
for _m, _c in (("eq", "nm = k"), ("ge", "nm >= k")):
    query(f"D19_dynamic_curve_{_m}", sql(f"""
        SELECT k, count(*) FILTER (WHERE {_c} AND nb > 0) AS den_pairs,
               count(*) FILTER (WHERE {_c} AND nb > 0 AND nb < nm) AS num_dynamic,
               count(*) FILTER (WHERE {_c} AND nb > 0 AND nb < nm) / nullif(count(*) FILTER (WHERE {_c} AND nb > 0), 0) AS frac_dynamic
        FROM kp CROSS JOIN (VALUES (1), (2), (3), (4), (5)) a(k) GROUP BY k
        UNION ALL SELECT 0, count(*) FILTER (WHERE nb > 0), 0, 0.0 FROM kp""", "kept", "total", "nuc20", **_PAIRVIEWS),
        dbl="frac_dynamic", ints="k num_dynamic")(
        lambda s, d, m=_m: bd.dynamic_curve(r1b_states(s, d), m)
    )

# ---- conditional probabilities

_CBINS = [k for k in range(1, 12) if k != 5]
_CIN = ", ".join(map(str, _CBINS))
_CVIEWS = dict(
    ch=f"""SELECT b.* FROM b ANTI JOIN nuc20 n USING ({_P})""",
    cth=f"""SELECT ch.* FROM ch SEMI JOIN (SELECT {_P} FROM ch GROUP BY ALL HAVING sum(bound) >= 2) q USING ({_P})
            WHERE zf IN ({_CIN})""",
    crow=f"""SELECT cth.* FROM cth SEMI JOIN (SELECT {_P} FROM cth GROUP BY ALL HAVING sum(bound) < count(*)) q USING ({_P})""",
)


def cond_rows(s, d):
    return bd.cond_states(ad.calls_motif(s, d), _CBINS, bd.Windows(nuc=(20, 60)), 1, mol_threshold=2,
                          exclude_up=True, exclude_down=True, drop_all_bound=True)


def _cond_sql(v: int, where: str = "") -> str:
    return f"""SELECT i.zf AS zf_i, any_value(r.n) AS n_row, jj.zf AS zf_j, count(j.zf) AS n_cell, avg(j.bound) AS p_bound
        FROM (SELECT * FROM crow WHERE bound = {v} {where}) i
        JOIN (SELECT zf, count(*) AS n FROM crow WHERE bound = {v} {where} GROUP BY zf) r ON r.zf = i.zf
        CROSS JOIN (SELECT DISTINCT zf FROM (VALUES {', '.join(f'({k})' for k in _CBINS)}) v(zf)) jj
        LEFT JOIN crow j ON j.motif_id = i.motif_id AND j.read_id = i.read_id AND j.zf = jj.zf
        GROUP BY i.zf, jj.zf"""


query("D20_cond_prob_bound", sql(_cond_sql(1), "b", "nuc20", **_CVIEWS), dbl="p_bound", ints="zf_j")(
    lambda s, d: bd.cond_prob(cond_rows(s, d), _CBINS, 1)
)
query("D20_cond_prob_unbound", sql(_cond_sql(0), "b", "nuc20", **_CVIEWS), dbl="p_bound", ints="zf_j")(
    lambda s, d: bd.cond_prob(cond_rows(s, d), _CBINS, 0)
)


def _cond_diff(s, d):
    rows = cond_rows(s, d)
    a = bd.cond_prob(rows.filter(F.col("motif_id").endswith("+")), _CBINS, 1)
    c = bd.cond_prob(rows.filter(F.col("motif_id").endswith("-")), _CBINS, 1)
    return bd.cond_diff(a, c)


query("D21_cond_diff", sql(f"""
    SELECT zf_i, zf_j, a.p_bound AS p_a, c.p_bound AS p_b, a.p_bound - c.p_bound AS delta
    FROM ({_cond_sql(1, "AND motif_id LIKE '%+'")}) a FULL JOIN ({_cond_sql(1, "AND motif_id LIKE '%-'")}) c
    USING (zf_i, zf_j)""", "b", "nuc20", **_CVIEWS), dbl="p_a p_b delta", ints="zf_j")(_cond_diff)
query("D22_cond_prob_input", sql(f"SELECT {_P}, zf, bound FROM crow", "b", "nuc20", **_CVIEWS))(
    lambda s, d: cond_rows(s, d).select("motif_id", "read_id", F.explode(F.array_compact(F.array(*[
        F.when(bit("row_meas", k) == 1, F.struct(F.lit(k).alias("zf"), bit("row_u", k).alias("bound")))
        for k in _CBINS]))).alias("x")).select("motif_id", "read_id", "x.*")
)

# ---- matrix form, clusters, selections

_BP = lambda s, d: bd.binding_prob(r1b_states(s, d), NDR)
_SPEC = bd.bin_spec(NDR, hide5=True)
_WIDE = ", ".join(f'max(binding_prob) FILTER (WHERE zf = {z}) AS "{lab}"' for z, lab in _SPEC)
query("D25_matrix_export", sql(f"SELECT motif_id, {_WIDE} FROM bp WHERE zf IN ({', '.join(map(str, BINS))}) GROUP BY motif_id", "bp"),
      dbl=" ".join(lab for _, lab in _SPEC))(lambda s, d: bd.matrix_export(_BP(s, d), _SPEC))
query("D25_points_export", sql(f"""
    SELECT motif_id, zf, CASE zf WHEN 0 THEN 'N_NDR' WHEN 12 THEN 'C_NDR' ELSE 'ZF' || zf END AS label, binding_prob,
           num_bound_kept, den_kept, den_total, 'kept' AS denominator_used
    FROM bp WHERE zf IN ({', '.join(map(str, BINS))})""", "bp"), dbl="binding_prob")(
    lambda s, d: bd.points_export(_BP(s, d), _SPEC)
)
CL = {"C1": [1, 2], "C2": list(range(3, 9)), "C3": [9, 10, 11]}
_WZ = "SELECT motif_id, " + ", ".join(f"max(binding_prob) FILTER (WHERE zf = {z}) AS z{z}" for z in range(1, 12)) + " FROM bp GROUP BY motif_id"
CL_MEANS = " UNION ALL ".join(
    f"SELECT motif_id, '{l}' AS cluster, ({' + '.join(f'coalesce(z{z}, 0)' for z in m)}) / nullif({' + '.join(f'CAST(z{z} IS NOT NULL AS INT)' for z in m)}, 0) AS value FROM ({_WZ})"
    for l, m in CL.items())
query("D24_cluster_means", sql(f"SELECT * FROM ({CL_MEANS}) WHERE value IS NOT NULL", "bp"),
    dbl="value")(lambda s, d: bd.cluster_means(_BP(s, d), CL))

_PIV = f"SELECT {_P}, " + ", ".join(f"max(bound) FILTER (WHERE zf = {k}) AS z{k}" for k in range(1, 12)) + " FROM b GROUP BY ALL"
for _g, _w in (("N_open", "(z1 = 0 OR z2 = 0) AND (z6 = 1 OR z7 = 1)"),
               ("C_open", "(z10 = 0 OR z11 = 0) AND (z6 = 1 OR z7 = 1)"),
               ("ZF2U_ZF6B", "z2 = 0 AND z6 = 1")):
    query(f"P5_select_group_{_g}", sql(f"SELECT {_P} FROM ({_PIV}) WHERE {_w}", "b"))(
        lambda s, d, g=_g: bd.select_group(bd.pair_states(bd.pair_masks(ad.calls_motif(s, d)), bd.Filters()), g)
    )

GLOBAL = bd.Filters(exclude_up=True, exclude_down=True)
query("P6_global_classes", sql(f"""
    SELECT {_P}, CASE WHEN is_nuc = 1 THEN 'Nucleosomes' WHEN n_bound = 0 THEN 'Unbound'
                      WHEN n_bound = n_measured THEN 'Static' ELSE 'Dynamic' END AS label
    FROM psum FULL JOIN (SELECT DISTINCT {_P}, 1 AS is_nuc FROM nuc40) USING ({_P})""", "psum", "nuc40"))(
    lambda s, d: bd.global_classes(bd.pair_states(bd.pair_masks(ad.calls_motif(s, d), PROFILE), GLOBAL))
)

# ---- joins and set operations on pairs

query("C12_restrict_motifs", sql("""
    SELECT cm.motif_id, cm.read_id, cm.rel_pos, cm.status FROM cm SEMI JOIN
    (SELECT * FROM motifs WHERE strand = '+') m ON cm.chrom = m.chrom AND cm.m_start = m."start" AND cm.m_end = m."end" """,
    "cm", "motifs"))(
    lambda s, d: lk.restrict_motifs(ad.calls_motif(s, d), ad.motifs(s, d).filter("strand = '+'")).select("motif_id", "read_id", "rel_pos", "status")
)
query("C13_keep_pairs", sql(f"SELECT {_P}, zf, bound FROM b SEMI JOIN nuc20 n USING ({_P})", "b", "nuc20"))(
    lambda s, d: bd.keep_pairs(b_table(s, d), bd.nucleosome_pairs(ad.calls_motif(s, d), 20, 60)).drop("n_calls")
)
query("C14_drop_pairs", sql(f"SELECT {_P}, zf, bound FROM b ANTI JOIN nuc20 n USING ({_P})", "b", "nuc20"))(
    lambda s, d: bd.drop_pairs(b_table(s, d), bd.nucleosome_pairs(ad.calls_motif(s, d), 20, 60)).drop("n_calls")
)
query("C16_three_aggregates", sql("SELECT motif_id, zf, num_bound_kept, den_kept, den_total FROM bp", "bp"))(
    lambda s, d: _BP(s, d).drop("binding_prob")
)
query("C20_bin_pairs", sql(f"""
    SELECT x.zf AS zf_i, y.zf AS zf_j, count(*) AS n, sum(x.bound * y.bound) AS n_both
    FROM b x JOIN b y USING ({_P}) WHERE x.zf < y.zf GROUP BY ALL""", "b"), ints="n_both")(
    lambda s, d: bd.bin_pair_counts(bd.pair_masks(ad.calls_motif(s, d)), list(range(1, 12)))
)
query("G1_union_rows", sql(f"SELECT {_P}, zf, bound FROM b UNION ALL SELECT {_P}, zf, bound FROM ndr", "b", "ndr"))(
    lambda s, d: _with_ndr(s, d).drop("n_calls")
)
query("G2_distinct_pairs", sql(f"SELECT DISTINCT {_P}, rel_pos FROM cm", "cm"))(
    lambda s, d: ad.calls_motif(s, d).select("motif_id", "read_id", "rel_pos").distinct()
)


def _sel(s, d):
    m = bd.pair_masks(ad.calls_motif(s, d), NDR)
    st = bd.pair_states(m, bd.Filters(exclude_up=True, exclude_down=True))
    return bd.select_group(st, "N_open"), bd.select_group(st, "C_open"), st.filter("nuc").select("motif_id", "read_id")


_N = f"SELECT {_P} FROM ({_PIV}) WHERE (z1 = 0 OR z2 = 0) AND (z6 = 1 OR z7 = 1)"
_C = f"SELECT {_P} FROM ({_PIV}) WHERE (z10 = 0 OR z11 = 0) AND (z6 = 1 OR z7 = 1)"
query("G3_union_keys", sql(f"{_N} UNION {_C}", "b"))(lambda s, d: (lambda n, c, x: n.union(c).distinct())(*_sel(s, d)))
query("G4_intersect_keys", sql(f"{_N} INTERSECT SELECT {_P} FROM nuc20", "b", "nuc20"))(
    lambda s, d: (lambda n, c, x: n.join(x, ["motif_id", "read_id"], "left_semi"))(*_sel(s, d)))
query("G5_minus_keys", sql(f"SELECT {_P} FROM nuc20 EXCEPT ({_N} UNION {_C})", "b", "nuc20"))(
    lambda s, d: (lambda n, c, x: x.join(n.union(c), ["motif_id", "read_id"], "left_anti"))(*_sel(s, d)))
