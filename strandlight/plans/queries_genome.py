"""Queries on coordinates, interval joins, profiles, rasters and signal tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlight.functions import calls as fc
from strandlight.operators import binding as bd
from strandlight.operators import intervals as iv
from strandlight.operators import lookups as lk
from strandlight.operators import profiles as pf
from strandlight.operators import signals as sg
from strandlight.ordered import centred_mean, chunk_by, with_index
from strandlight.plans.oracle import sql
from strandlight.plans.queries_binding import GLOBAL, NDR, PROFILE, r1b_states
from strandlight.plans.registry import query
from strandlight.sources import adapters as ad

_P = "motif_id, read_id"
_OV = 'a.chrom = b.chrom AND a."start" < b."end" AND a."end" > b."start"'

# ---- B: coordinates

query("B1_call_status", sql("SELECT status, count(*) AS n, min(llr) AS lo, max(llr) AS hi FROM calls GROUP BY status", "calls"),
      dbl="lo hi")(
    lambda s, d: ad.raw_calls(s, d).withColumn("status", fc.call_status("llr")).groupBy("status").agg(
        F.count("*").alias("n"), F.min("llr").alias("lo"), F.max("llr").alias("hi")))
query("B2_singleton_calls", sql('SELECT chrom, "start", read_id, kmer FROM raw WHERE n_motifs = 1', "raw"))(
    lambda s, d: fc.singleton_calls(ad.raw_calls(s, d)).select("chrom", "start", "read_id", "kmer"))
query("B3_legacy_c_pos", sql("""SELECT chrom, strand, "start", "start" + 2 + CASE WHEN strand = '-' THEN 1 ELSE 0 END AS call_pos FROM raw""", "raw"))(
    lambda s, d: fc.legacy_c_pos(ad.raw_calls(s, d)).select("chrom", "strand", "start", "call_pos"))
query("B4_realign_c_pos", sql("""
    SELECT chrom, "start", kmer, "start" + CASE WHEN instr(kmer, 'M') = 0 THEN 1 ELSE instr(kmer, 'M') END - 3 AS call_pos,
           replace(kmer, 'M', 'C') AS target_kmer FROM raw""", "raw"))(
    lambda s, d: fc.realign_c_pos(ad.raw_calls(s, d)).select("chrom", "start", "kmer", "call_pos", "target_kmer"))


def wide_from_raw(raw):
    """B2 -> B1 -> B4 -> B5 in one narrow stage."""
    c = fc.realign_c_pos(fc.singleton_calls(raw)).withColumn("status", fc.call_status("llr"))
    return fc.to_wide_calls(c.withColumnsRenamed({"ll_met": "llr_met", "ll_unmet": "llr_unmet"}))


_WIDE = """SELECT chrom, pos - 1 AS "start", pos + 1 AS "end", pos AS call_pos, strand, read_id, llr, ll_met AS llr_met,
    ll_unmet AS llr_unmet, CASE WHEN llr >= 1 THEN 'M' WHEN llr <= -1 THEN 'U' ELSE 'N' END AS status
    FROM (SELECT *, "start" + greatest(instr(kmer, 'M'), 1) - 3 AS pos FROM raw WHERE n_motifs = 1)"""
query("B5_to_wide_calls", sql(_WIDE, "raw"), dbl="llr llr_met llr_unmet")(lambda s, d: wide_from_raw(ad.raw_calls(s, d)))
query("B6_width_report", sql("SELECT count(*) AS n_rows, 0 AS n_bad FROM calls", "calls"), ints="n_bad")(
    lambda s, d: fc.width_report(ad.calls(s, d).select(F.concat_ws("\t", *fc.WIDE_COLUMNS).alias("value")), 10))
query("B7_shift_interval", sql('SELECT chrom, "start" + 1 AS "start", "end" + 1 AS "end" FROM motifs', "motifs"))(
    lambda s, d: fc.shift_interval(ad.motifs(s, d), 1).select("chrom", "start", "end"))
query("B8_slop", sql('SELECT chrom, greatest("start" - 991, 1) AS "start", "end" + 991 AS "end" FROM motifs', "motifs"))(
    lambda s, d: fc.slop(ad.motifs(s, d), 991, 991, 1).select("chrom", "start", "end"))
query("B8_window_at", sql('SELECT chrom, center, greatest(center - 1435, 0) AS "start", center + 1435 AS "end" FROM motifs', "motifs"))(
    lambda s, d: fc.window_at(ad.motifs(s, d), "center", 1435).select("chrom", "center", "start", "end"))
query("B9_motif_center", sql("""SELECT chrom, "start", strand, "start" + CASE WHEN strand = '-' THEN 10 ELSE 8 END AS center FROM motifs""", "motifs"))(
    lambda s, d: fc.motif_center(ad.motifs(s, d)).select("chrom", "start", "strand", "center"))
query("B10_standard_chroms", sql("""SELECT chrom, count(*) AS n FROM (
    SELECT CASE WHEN chrom = 'chr1' THEN 'chrY' WHEN chrom = 'chr2' THEN 'chrX' WHEN chrom = 'chr3' THEN 'chr3_alt' ELSE chrom END AS chrom
    FROM motifs) WHERE chrom NOT IN ('chrY', 'chr3_alt') GROUP BY chrom""", "motifs"))(
    lambda s, d: fc.standard_chroms(ad.motifs(s, d).withColumn("chrom", F.expr(
        "CASE chrom WHEN 'chr1' THEN 'chrY' WHEN 'chr2' THEN 'chrX' WHEN 'chr3' THEN 'chr3_alt' ELSE chrom END"))
    ).groupBy("chrom").agg(F.count("*").alias("n")))


def _offset(s, d):
    m = ad.motifs(s, d)
    out = None
    for name, off, side in (("NUC_N", 155, "N"), ("NUC_C", 155, "C"), ("NDR_N", 50, "N"), ("NDR_C", 50, "C")):
        t = fc.offset_window(m, off, side).select(F.lit(name).alias("region"), "chrom", "start", "end", "offset_center")
        out = t if out is None else out.unionByName(t)
    return out


query("B11_offset_window", sql("""
    SELECT region, chrom, greatest(c - 32, 0) AS "start", c + 32 AS "end", c AS offset_center FROM (
      SELECT region, chrom, CASE WHEN (strand = '+') = (side = 'N') THEN center - off ELSE center + off END AS c
      FROM motifs CROSS JOIN (VALUES ('NUC_N', 155, 'N'), ('NUC_C', 155, 'C'), ('NDR_N', 50, 'N'), ('NDR_C', 50, 'C')) v(region, off, side))""",
    "motifs"))(_offset)
query("B12_summits", sql("""SELECT chrom, CAST(floor(("start" * 2 + 131) / 2) AS BIGINT) - 1 AS "start",
    CAST(floor(("start" * 2 + 131) / 2) AS BIGINT) AS "end" FROM motifs""", "motifs"))(
    lambda s, d: fc.summits(ad.motifs(s, d).withColumn("region", F.expr("concat(chrom, ':', start, '-', end + 1)"))).select("chrom", "start", "end"))
query("B13_motif_id", sql("""SELECT chrom || '_' || "start" || '_' || "end" || '_' || strand AS motif_id, center FROM motifs""", "motifs"))(
    lambda s, d: ad.motifs(s, d).select(fc.motif_id("chrom", "start", "end", "strand").alias("motif_id"), "center"))
query("B22_flip_strand", sql("""SELECT chrom, center, CASE strand WHEN '+' THEN '-' ELSE '+' END AS strand FROM motifs""", "motifs"))(
    lambda s, d: fc.flip_strand(ad.motifs(s, d)).select("chrom", "center", "strand"))

# ---- C: interval joins

query("C1_overlap_join", sql(f"""SELECT a.chrom, a.call_pos, a.read_id, b."start" AS m_start, b.center
    FROM calls a JOIN motifs b ON {_OV}""", "calls", "motifs"))(
    lambda s, d: iv.overlap_join(ad.calls(s, d), ad.motifs(s, d), a_max_len=2).select(
        F.col("a_chrom").alias("chrom"), F.col("a_call_pos").alias("call_pos"), F.col("a_read_id").alias("read_id"),
        F.col("b_start").alias("m_start"), F.col("b_center").alias("center")))
query("C1_overlap_join_general", sql(f"""SELECT a.chrom, a."start" AS s1, a."end" AS e1, b."start" AS s2, b.score
    FROM motifs a JOIN peaks b ON {_OV}""", "motifs", "peaks"), dbl="score")(
    lambda s, d: iv.overlap_join(ad.motifs(s, d), ad.peaks(s, d), bin_size=256).select(
        F.col("a_chrom").alias("chrom"), F.col("a_start").alias("s1"), F.col("a_end").alias("e1"),
        F.col("b_start").alias("s2"), F.col("b_score").alias("score")))
_KB = """SELECT chrom, greatest("start" - 991, 1) AS "start", "end" + 991 AS "end" FROM motifs"""
query("C2_overlap_a", sql(f"""SELECT a.chrom, a."start", a.read_id, count(*) AS n FROM raw a JOIN kb b ON {_OV}
    GROUP BY ALL""", "raw", "motifs", kb=_KB))(
    lambda s, d: iv.overlap_a(ad.raw_calls(s, d), fc.slop(ad.motifs(s, d), 991, 991, 1), a_max_len=64).groupBy(
        "chrom", "start", "read_id").agg(F.count("*").alias("n")))
query("C3_overlap_semi", sql(f"""SELECT a.chrom, a."start", a."end", a.replicate FROM w a WHERE EXISTS
    (SELECT 1 FROM motifs b WHERE {_OV.replace('a.', 'a.')} AND b.strand = '+' AND b.center % 3 = 0)""", "motifs", "peaks",
    w="""SELECT chrom, greatest("start" - 25, 0) AS "start", "end" + 25 AS "end", replicate FROM peaks"""))(
    lambda s, d: iv.overlap_semi(fc.slop(ad.peaks(s, d), 25, 25, 0),
                                 ad.motifs(s, d).filter("strand = '+' AND center % 3 = 0")).select("chrom", "start", "end", "replicate"))
_DEPTH = dict(
    iv="""SELECT chrom, greatest("start" - 4, 0) AS "start", "end" + 4 AS "end", replicate FROM peaks""",
    pts="""SELECT DISTINCT chrom, p FROM (SELECT chrom, "start" AS p FROM iv UNION ALL SELECT chrom, "end" FROM iv)""",
    seg="""SELECT chrom, p AS "start", lead(p) OVER (PARTITION BY chrom ORDER BY p) AS "end" FROM pts""",
    dep=f"""SELECT a.chrom, a."start", a."end", count(DISTINCT b.replicate) AS depth
            FROM seg a JOIN iv b ON a.chrom = b.chrom AND b."start" <= a."start" AND b."end" >= a."end"
            WHERE a."end" IS NOT NULL GROUP BY ALL HAVING count(DISTINCT b.replicate) >= 2""",
)


def _depth(s, d):
    return iv.multi_depth(fc.slop(ad.peaks(s, d), 4, 4, 0), 2)


query("C4_multi_depth", sql('SELECT chrom, "start", "end", depth FROM dep', "peaks", **_DEPTH))(_depth)
query("C5_overlap_map", sql(f"""SELECT a.chrom, a."start", a."end", a.depth, max(b.score) AS score
    FROM dep a LEFT JOIN peaks b ON {_OV} GROUP BY ALL""", "peaks", **_DEPTH), dbl="score")(
    lambda s, d: iv.overlap_map(_depth(s, d), ad.peaks(s, d), {"score": F.max("b_score")}, bin_size=256))
_SIG = """SELECT chrom, "start", "end", strand, p_retailprice % 97 AS signal, center FROM motifs JOIN part USING (p_partkey)
          WHERE p_partkey % 3 <> 0"""


def _sigbed(s, d):
    pt = ad.table(s, d, "part").filter("p_partkey % 3 <> 0")
    m = pt.selectExpr(f"{ad._chrom('p_partkey')} AS chrom", f"{ad._CENTER} - 65 AS start", f"{ad._CENTER} + 65 AS end",
                      "p_retailprice % 97 AS signal")
    return m


query("C6_match_coords", sql("""SELECT m.chrom, m."start", m."end", m.center, g.signal FROM motifs m LEFT JOIN g
    ON m.chrom = g.chrom AND m."start" = g."start" AND m."end" = g."end" """, "motifs", g=_SIG), dbl="signal")(
    lambda s, d: lk.match_coords(ad.motifs(s, d), _sigbed(s, d)).select("chrom", "start", "end", "center", "signal"))
query("C7_match_center", sql("""SELECT m.chrom, m.center, g.signal FROM motifs m LEFT JOIN g
    ON m.chrom = g.chrom AND m.center = CAST(floor((g."start" + g."end") / 2) AS BIGINT)""", "motifs", g=_SIG), dbl="signal")(
    lambda s, d: lk.match_center(ad.motifs(s, d), _sigbed(s, d)).select("chrom", "center", "signal"))
query("C8_match_overlap", sql(f"""SELECT a.chrom, a."start", a."end", a.center, max(b.signal) AS signal
    FROM motifs a LEFT JOIN g b ON {_OV} GROUP BY ALL""", "motifs", g=_SIG), dbl="signal")(
    lambda s, d: iv.overlap_map(ad.motifs(s, d).select("chrom", "start", "end", "center"), _sigbed(s, d),
                                {"signal": F.max("b_signal")}, bin_size=256))
query("C9_signal_column", sql("SELECT chrom, center, value FROM (SELECT chrom, center, p_retailprice % 97 AS value FROM motifs JOIN part USING (p_partkey))",
      "motifs"), dbl="value")(
    lambda s, d: (lambda t: t.select("chrom", "center", F.col(lk.signal_column(t)).alias("value")))(
        ad.table(s, d, "part").selectExpr(f"{ad._chrom('p_partkey')} AS chrom", f"{ad._CENTER} AS center", "p_name",
                                          "p_retailprice % 97 AS score")))
for _pol, _e, _w in (("zero", "coalesce(signal, 0)", ""), ("keep", "signal", ""), ("drop", "signal", "WHERE signal IS NOT NULL")):
    query(f"C10_finalize_signal_{_pol}", sql(f"""SELECT chrom, "start", center, {_e} AS signal FROM (
        SELECT m.chrom, m."start", m.center, g.signal FROM motifs m LEFT JOIN g
        ON m.chrom = g.chrom AND m."start" = g."start" AND m."end" = g."end") {_w}""", "motifs", g=_SIG), dbl="signal")(
        lambda s, d, p=_pol: lk.finalize_signal(lk.match_coords(ad.motifs(s, d), _sigbed(s, d)), p).select(
            "chrom", "start", "center", "signal"))
_NEAR = """SELECT chrom, call_pos, read_id, status, center FROM (
    SELECT c.*, m.center, row_number() OVER (PARTITION BY c.id ORDER BY abs(c.call_pos - m.center), m.center, m."start" DESC) AS rn
    FROM (SELECT *, row_number() OVER () AS id FROM calls) c JOIN motifs m ON c.chrom = m.chrom {w}) WHERE rn = 1"""
query("C11_nearest_join", sql(_NEAR.format(w="AND abs(c.call_pos - m.center) <= 40"), "calls", "motifs"))(
    lambda s, d: iv.nearest_join(ad.calls(s, d), ad.motifs(s, d), 40).select(
        "chrom", "call_pos", "read_id", "status", F.col("m_center").alias("center")))
query("C11_nearest_join_unbounded", sql(_NEAR.format(w="AND m.strand = '+'"), "calls", "motifs"))(
    lambda s, d: iv.nearest_join(ad.calls(s, d), ad.motifs(s, d).filter("strand = '+'")).select(
        "chrom", "call_pos", "read_id", "status", F.col("m_center").alias("center")))
query("C15_target_motif", sql("""SELECT r.chrom AS r_chrom, r."start" AS r_start, r."end" AS r_end,
    min_by(m.center, abs(m.center - CAST(floor((r."start" + r."end") / 2) AS BIGINT)) * 1000000 + m."start") AS center
    FROM r JOIN motifs m ON m.chrom = r.chrom AND m."start" <= r."end" AND m."end" >= r."start" GROUP BY ALL""", "motifs",
    r="""SELECT chrom, 1500 AS "start", 2200 AS "end" FROM motifs GROUP BY chrom"""), ints="r_start r_end")(
    lambda s, d: lk.target_motif(ad.motifs(s, d), ad.motifs(s, d).groupBy("chrom").agg(
        F.lit(1500).alias("start"), F.lit(2200).alias("end"))).select("r_chrom", "r_start", "r_end", "center"))
query("A20_calls_in_region", sql("SELECT chrom, call_pos, read_id, status FROM calls WHERE chrom = 'chr7' AND call_pos BETWEEN 2000 AND 5000", "calls"))(
    lambda s, d: lk.calls_in_region(ad.calls(s, d), "chr7", 2000, 5000).select("chrom", "call_pos", "read_id", "status"))
query("W1_drop_close", sql("""SELECT chrom, center, strand, seq FROM (SELECT *,
    center - lag(center) OVER w AS g1, lead(center) OVER w - center AS g2 FROM motifs
    WINDOW w AS (PARTITION BY chrom ORDER BY center)) WHERE coalesce(g1, 36) >= 36 AND coalesce(g2, 36) >= 36""", "motifs"))(
    lambda s, d: iv.drop_close(ad.motifs(s, d)).select("chrom", "center", "strand", "seq"))
query("F1_sort_coords", sql('SELECT chrom, center, strand FROM motifs', "motifs"))(
    lambda s, d: ad.motifs(s, d).select("chrom", "center", "strand").orderBy("chrom", "center", "strand"))
query("F2_top_rows", sql("SELECT motif_id, read_id, n FROM (SELECT motif_id, read_id, count(*) AS n FROM cm GROUP BY ALL) ORDER BY n DESC, motif_id, read_id LIMIT 100", "cm"))(
    lambda s, d: lk.top_rows(ad.calls_motif(s, d).groupBy("motif_id", "read_id").agg(F.count("*").alias("n")),
                             [F.desc("n"), "motif_id", "read_id"], 100))

# ---- P: profiles

_SELN = f"""SELECT {_P} FROM (SELECT {_P}, """ + ", ".join(
    f"max(bound) FILTER (WHERE zf = {k}) AS z{k}" for k in (1, 2, 6, 7)) + """ FROM b GROUP BY ALL)
    WHERE (z1 = 0 OR z2 = 0) AND (z6 = 1 OR z7 = 1)"""
_BIN5 = "CAST(floor(rel_pos / 5) AS BIGINT) * 5"


def _nopen(cm):
    return bd.select_group(bd.pair_states(bd.pair_masks(cm), bd.Filters()), "N_open")


query("P1_metaprofile", sql(f"""SELECT g.rel_bin, frac_u FROM (SELECT unnest(range(-60, 61, 5)) AS rel_bin) g LEFT JOIN
    (SELECT {_BIN5} AS rel_bin, avg(is_u) AS frac_u FROM mu SEMI JOIN sel USING ({_P}) WHERE rel_pos BETWEEN -60 AND 60 GROUP BY 1) USING (rel_bin)""",
    "mu", "b", sel=_SELN), dbl="frac_u")(
    lambda s, d: (lambda cm: pf.metaprofile(cm, _nopen(cm), 60, 5))(ad.calls_motif(s, d)))
query("P2_metaprofile_stratified", sql(f"""SELECT {_BIN5} AS rel_bin, CASE WHEN n.read_id IS NOT NULL THEN 'nucleosome-flagged' ELSE 'retained' END AS label,
    avg(is_u) AS frac_u FROM mu SEMI JOIN sel USING ({_P}) LEFT JOIN (SELECT DISTINCT {_P} FROM nuc40) n USING ({_P})
    WHERE rel_pos BETWEEN -60 AND 60 GROUP BY 1, 2""", "mu", "b", "nuc40", sel=_SELN).replace("n.read_id IS NOT NULL", "n.hit = 1").replace(
    f"SELECT DISTINCT {_P} FROM nuc40", f"SELECT DISTINCT {_P}, 1 AS hit FROM nuc40"), dbl="frac_u")(
    lambda s, d: (lambda cm: pf.metaprofile_stratified(cm, _nopen(cm), bd.nucleosome_pairs(cm, 40, 60), 60, 5))(ad.calls_motif(s, d)))
_LABELS = f"""SELECT {_P}, CASE WHEN is_nuc = 1 THEN 'Nucleosomes' WHEN n_bound = 0 THEN 'Unbound'
    WHEN n_bound = n_measured THEN 'Static' ELSE 'Dynamic' END AS label
    FROM psum FULL JOIN (SELECT DISTINCT {_P}, 1 AS is_nuc FROM nuc40) USING ({_P})"""
query("P3_metaprofile_labeled", sql(f"""SELECT {_BIN5} AS rel_bin, label, avg(is_u) AS frac_u FROM mu JOIN lab USING ({_P})
    WHERE rel_pos BETWEEN -60 AND 60 GROUP BY 1, 2""", "mu", "psum", "nuc40", lab=_LABELS), dbl="frac_u")(
    lambda s, d: (lambda cm: pf.metaprofile_labeled(
        cm, bd.global_classes(bd.pair_states(bd.pair_masks(cm, PROFILE), GLOBAL)), 60, 5))(ad.calls_motif(s, d)))
query("P4_metaprofile_macro", sql("""SELECT label, rel_bin, avg(f) AS mean, stddev_samp(f) AS sd, count(*) AS n_motifs FROM (
    SELECT motif_id, m_strand AS label, CAST(ceil(rel_pos / 5) AS BIGINT) * 5 - 5 AS rel_bin, avg(CASE WHEN status = 'U' THEN 1 ELSE 0 END) AS f
    FROM cm WHERE rel_pos > -60 AND rel_pos <= 60 GROUP BY ALL) GROUP BY label, rel_bin""", "cm"), dbl="mean sd")(
    lambda s, d: pf.metaprofile_macro(ad.calls_motif(s, d), ad.motifs(s, d).select(
        fc.motif_id("chrom", "start", "end", "strand").alias("motif_id"), F.col("strand").alias("label")), 60, 5))
_READS = dict(rd=f"""SELECT {_P}, rel_pos, {_BIN5} AS rel_bin, status, is_u FROM mu WHERE rel_pos BETWEEN -60 AND 60""",
              keep=f"""SELECT {_P} FROM rd GROUP BY ALL HAVING min(rel_pos) <= -10 AND max(rel_pos) >= 10 AND count(*) >= 5""",
              pr=f"SELECT rd.* FROM rd SEMI JOIN keep USING ({_P})",
              ras=f"""SELECT c.motif_id, c.read_id, rel_bin, val, row_ord FROM
                  (SELECT {_P}, rel_bin, max(1 - is_u) AS val FROM pr GROUP BY ALL) c JOIN
                  (SELECT {_P}, row_number() OVER (PARTITION BY motif_id ORDER BY fb, read_id) AS row_ord FROM
                   (SELECT {_P}, min(rel_bin) AS fb FROM pr GROUP BY motif_id, read_id)) o
                  USING ({_P})""")


def reads_of(s, d):
    return pf.prepare_reads(ad.calls_motif(s, d), 60, 10, 5)


query("P14_prepare_reads", sql(f"SELECT {_P}, rel_pos, rel_bin, status FROM pr", "mu", **_READS))(reads_of)
query("P14_stage_counts", sql(f"""SELECT motif_id, sum(n) AS calls_in_window, count(*) AS reads_in_window,
    count(*) FILTER (WHERE sp) AS reads_spanning, count(*) FILTER (WHERE sp AND n >= 5) AS reads_after_min FROM (
    SELECT {_P}, count(*) AS n, min(rel_pos) <= -10 AND max(rel_pos) >= 10 AS sp FROM rd GROUP BY ALL) GROUP BY motif_id""", "mu", **_READS),
    ints="calls_in_window")(lambda s, d: pf.prepare_counts(ad.calls_motif(s, d), 60, 10, 5))
query("P15_raster", sql(f"SELECT {_P}, rel_bin, val, row_ord FROM ras", "mu", **_READS), ints="val")(lambda s, d: pf.raster(reads_of(s, d)))
query("P15_raster_dense", sql(f"""SELECT {_P}, row_ord, list(coalesce(val, -1) ORDER BY bin) AS cells FROM
    (SELECT DISTINCT {_P}, row_ord, bin FROM ras CROSS JOIN (SELECT unnest(range(-60, 61, 5)) AS bin)) LEFT JOIN
    (SELECT {_P}, rel_bin AS bin, val FROM ras) USING ({_P}, bin) GROUP BY ALL""", "mu", **_READS))(
    lambda s, d: pf.raster_dense(pf.raster(reads_of(s, d)), 60, 5))
_CAT = dict(
    base=f"SELECT {_P}, min(rel_pos) AS first_pos FROM mu GROUP BY ALL",
    cl=f"""SELECT {_P}, first_pos, coalesce(n_measured, 0) AS nm, CASE
        WHEN is_nuc = 1 AND coalesce(n_bound, 0) > 0 THEN 2 WHEN coalesce(n_bound, 0) = 0 THEN 3
        WHEN n_measured >= 2 AND n_bound = n_measured THEN 0 ELSE 1 END AS grp
        FROM base LEFT JOIN psum USING ({_P}) LEFT JOIN (SELECT DISTINCT {_P}, 1 AS is_nuc FROM nuc20) USING ({_P})""")
query("P16_raster_categories", sql(f"""SELECT {_P}, CASE grp WHEN 0 THEN 'static' WHEN 1 THEN 'dynamic' WHEN 2 THEN 'nucleosomal' ELSE 'naked' END AS category,
    row_number() OVER (PARTITION BY motif_id ORDER BY grp, CASE WHEN grp = 1 AND nm < 2 THEN 1 ELSE 0 END, first_pos, read_id) AS row_ord FROM cl""",
    "mu", "psum", "nuc20", **_CAT))(lambda s, d: pf.raster_categories(ad.calls_motif(s, d)))
query("P16_category_breaks", sql("""SELECT motif_id, count(*) FILTER (WHERE grp = 0) AS n_static, count(*) FILTER (WHERE grp = 1) AS n_dynamic,
    count(*) FILTER (WHERE grp = 2) AS n_nucleosomal, count(*) FILTER (WHERE grp = 3) AS n_naked FROM cl GROUP BY motif_id""", "mu", "psum", "nuc20", **_CAT))(
    lambda s, d: pf.category_breaks(pf.raster_categories(ad.calls_motif(s, d))))
query("P17_center_access", sql(f"""SELECT {_P}, CASE g WHEN 0 THEN 'open' WHEN 1 THEN 'closed' WHEN 2 THEN 'mixed' ELSE 'none' END AS access,
    row_number() OVER (PARTITION BY motif_id ORDER BY g, row_ord) AS access_ord FROM (
    SELECT {_P}, row_ord, CASE WHEN count(*) FILTER (WHERE abs(rel_bin) <= 10) = 0 THEN 3
       WHEN max(val) FILTER (WHERE abs(rel_bin) <= 10) = 0 THEN 0 WHEN min(val) FILTER (WHERE abs(rel_bin) <= 10) = 1 THEN 1 ELSE 2 END AS g
    FROM ras GROUP BY ALL)""", "mu", **_READS))(lambda s, d: pf.center_access(pf.raster(reads_of(s, d)), 10))
query("P18_u_profile", sql(f"""SELECT motif_id, rel_bin, avg(f) AS mean, stddev_pop(f) AS sd, count(*) AS n FROM (
    SELECT {_P}, rel_bin, avg(is_u) AS f FROM pr GROUP BY ALL) GROUP BY motif_id, rel_bin""", "mu", **_READS), dbl="mean sd")(
    lambda s, d: pf.u_profile(reads_of(s, d)))
query("P19_extend_calls", sql(f"""SELECT {_P}, row_ord, bin AS rel_bin, arg_min(val, rk) AS val FROM (
    SELECT {_P}, row_ord, rel_bin + k * 5 AS bin, val, abs(k) * 2 + CASE WHEN k > 0 THEN 0 ELSE 1 END AS rk
    FROM ras CROSS JOIN (SELECT unnest(range(-2, 3)) AS k)) WHERE bin BETWEEN -60 AND 60 GROUP BY ALL""", "mu", **_READS), ints="val")(
    lambda s, d: pf.extend_calls(pf.raster(reads_of(s, d)), 2, 60, 5))

# ---- signals

_MID = """chrom || '_' || "start" || '_' || "end" || '_' || strand AS motif_id"""
_BASES = """SELECT m.motif_id, t.value, least(m.hi, t."end") - greatest(m.lo, t."start") AS n FROM
    (SELECT {mid}, chrom, greatest(center - {h}, 0) AS lo, least(center + {h2}, sizes.length) AS hi FROM motifs JOIN sizes USING (chrom)) m
    JOIN track t ON m.chrom = t.chrom AND t."start" < m.hi AND t."end" > m.lo AND m.lo < m.hi"""


def _stat_sql(h, h2):
    bases = _BASES.format(mid=_MID, h=h, h2=h2)
    return sql(f"""SELECT motif_id, mean, median, max FROM (SELECT {_MID} FROM motifs) LEFT JOIN
        (SELECT motif_id, avg(value) AS mean, median(value) AS median, max(value) AS max FROM
         (SELECT motif_id, value, unnest(range(n)) FROM ({bases})) GROUP BY motif_id) USING (motif_id)""", "motifs", "track", "sizes")


def _mid(s, d):
    return ad.motifs(s, d).withColumn("motif_id", fc.motif_id("chrom", "start", "end", "strand"))


def stat200(s, d):
    return sg.track_stat(_mid(s, d), ad.track(s, d), 200, ad.chrom_sizes(s, d))


query("P7_track_stat", _stat_sql(200, 200), dbl="mean median max", digits=9)(stat200)
query("P7_track_stat_point", _stat_sql(0, 1), dbl="mean median max")(
    lambda s, d: sg.track_stat(_mid(s, d), ad.track(s, d), 0, ad.chrom_sizes(s, d)))
query("B26_clamp_interval", sql(f"""SELECT {_MID}, CASE WHEN least(center + 200, length) > greatest(center - 200, 0) THEN greatest(center - 200, 0) END AS "start",
    CASE WHEN least(center + 200, length) > greatest(center - 200, 0) THEN least(center + 200, length) END AS "end" FROM motifs LEFT JOIN sizes USING (chrom)""",
    "motifs", "sizes"))(lambda s, d: sg.clamp_interval(
        fc.window_at(_mid(s, d), "center", 200, -10**9), ad.chrom_sizes(s, d)).select("motif_id", "start", "end"))
_ST = _stat_sql(200, 200)
query("P8_missing_as_zero", f"SELECT motif_id, coalesce(mean, 0) AS mean, coalesce(median, 0) AS median, coalesce(max, 0) AS max FROM ({_ST})",
      dbl="mean median max", digits=9)(lambda s, d: sg.missing_as_zero(stat200(s, d), ["mean", "median", "max"]))
query("P8_no_data_sites", f"SELECT motif_id FROM ({_ST}) WHERE mean IS NULL")(
    lambda s, d: sg.no_data_sites(stat200(s, d), ["mean", "median", "max"]).select("motif_id"))
_RANKQ = """SELECT motif_id, median AS v, greatest(least(CAST(ceil((rank() OVER (ORDER BY median) + (count(*) OVER (PARTITION BY median) - 1) / 2.0) * 10
    / (SELECT max(rk) FROM (SELECT rank() OVER (ORDER BY median) + (count(*) OVER (PARTITION BY median) - 1) / 2.0 AS rk FROM z))) AS BIGINT), 10), 1) AS quantile FROM z"""
_Z = f"SELECT motif_id, coalesce(median, 0) AS median FROM ({_ST})"


def quant10(s, d):
    z = sg.missing_as_zero(stat200(s, d), ["median"]).select("motif_id", F.col("median").alias("v"))
    return sg.quantile_rank(z, "v", 10)


query("W4_quantile_rank", f"WITH z AS ({_Z}) {_RANKQ}", dbl="v")(quant10)
query("P9_quantile_counts", f"WITH z AS ({_Z}) SELECT quantile, count(*) AS n FROM ({_RANKQ}) GROUP BY quantile")(
    lambda s, d: sg.quantile_counts(quant10(s, d)))
query("W5_quantile_cut", f"""WITH z AS (SELECT * FROM ({_ST}) WHERE mean IS NOT NULL), e AS (
    SELECT quantile_cont(mean, [0.25, 0.5, 0.75]) AS q FROM z)
    SELECT motif_id, mean AS v, CASE WHEN mean <= q[1] THEN 1 WHEN mean <= q[2] THEN 2 WHEN mean <= q[3] THEN 3 ELSE 4 END AS quantile FROM z, e""",
    dbl="v", ints="quantile", digits=9)(
    lambda s, d: sg.quantile_cut(stat200(s, d).filter("mean IS NOT NULL").select("motif_id", F.col("mean").alias("v")), "v", 4))


def _regions(s, d):
    return _mid(s, d).withColumnRenamed("motif_id", "region_id")


query("P10_region_matrix", sql(f"""SELECT region_id, bin, avg(v) AS value FROM (
    SELECT motif_id AS region_id, CASE WHEN strand = '-' THEN 9 - bin ELSE bin END AS bin, v FROM
      (SELECT {_MID}, chrom, strand, center, unnest(range(10)) AS bin FROM motifs) g LEFT JOIN
      (SELECT chrom, base, value AS v FROM (SELECT chrom, value, unnest(range("start", "end")) AS base FROM track)) t
      ON g.chrom = t.chrom AND base >= center - 125 + bin * 25 AND base < center - 100 + bin * 25) GROUP BY ALL""", "motifs", "track"), dbl="value")(
    lambda s, d: sg.region_matrix(_regions(s, d), ad.track(s, d), 125, 125, 25))
query("B23_orient", sql("SELECT region_id, CASE WHEN strand = '-' THEN 63 - bin ELSE bin END AS bin, value FROM mat", "mat"), dbl="value")(
    lambda s, d: sg.orient(ad.matrix(s, d), 64).select("region_id", "bin", "value"))
query("B23_count_flipped", sql("SELECT count(DISTINCT region_id) AS n_flipped FROM mat WHERE strand = '-'", "mat"))(
    lambda s, d: sg.count_flipped(ad.matrix(s, d)))
_PROF = """SELECT bin, bin - 31.5 AS x, avg(value) AS mean, {sd}(value) AS sd, {sd}(value) / sqrt(count(value)) AS sem, count(value) AS n FROM
    (SELECT CASE WHEN strand = '-' THEN 63 - bin ELSE bin END AS bin, value FROM mat) GROUP BY bin"""


def prof(s, d, sd="samp"):
    return sg.matrix_profile(sg.orient(ad.matrix(s, d), 64), 64, 1, sd)


query("P11_matrix_profile_samp", sql(_PROF.format(sd="stddev_samp"), "mat"), dbl="x mean sd sem")(prof)
query("P11_matrix_profile_pop", sql(_PROF.format(sd="stddev_pop"), "mat"), dbl="x mean sd sem")(lambda s, d: prof(s, d, "pop"))
query("B24_crop_mirror", sql(f"SELECT 63 - bin AS bin, -x AS x, mean, n FROM ({_PROF.format(sd='stddev_samp')}) WHERE x BETWEEN -10 AND 5", "mat"),
      dbl="x mean")(lambda s, d: sg.mirror_x(sg.crop_x(prof(s, d), -10, 5), 64).select("bin", "x", "mean", "n"))
query("B24_crop_columns", sql(f"SELECT bin, x, mean FROM ({_PROF.format(sd='stddev_samp')}) WHERE bin BETWEEN 22 AND 37", "mat"),
      dbl="x mean")(lambda s, d: sg.crop_columns(prof(s, d), -10, 5, 64).select("bin", "x", "mean"))
_TR = """SELECT label AS track, bin, bin - 31.5 AS x, avg(value) AS mean, stddev_pop(value) AS sd FROM (
    SELECT label % 3 AS label, i - 1 AS bin, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings))
    GROUP BY ALL"""


def _tracks(s, d):
    e = ad.table(s, d, "embeddings").select((F.col("label") % 3).alias("track"), F.posexplode("embedding").alias("bin", "value"))
    return e.groupBy("track", "bin").agg(F.avg(F.col("value").cast("double")).alias("mean"),
                                         F.stddev_pop(F.col("value").cast("double")).alias("sd")).withColumn("x", F.col("bin") - 31.5)


for _mode, _f in (("max", "CASE WHEN pk > 0 THEN 1 / pk ELSE 1 END"), ("refmax", "CASE WHEN pk > 0 THEN rp / pk ELSE 1 END")):
    query(f"P12_scale_profiles_{_mode}", f"""WITH t AS ({_TR}) SELECT track, bin, x, mean * {_f} AS mean, sd * {_f} AS sd FROM
        (SELECT *, max(mean) OVER (PARTITION BY track) AS pk, (SELECT max(mean) FROM t WHERE track = 0) AS rp FROM t)""", dbl="x mean sd", ints="track")(
        lambda s, d, m=_mode: (lambda t: sg.scale_profiles(t, t.filter("track = 0"), m).select("track", "bin", "x", "mean", "sd"))(_tracks(s, d)))
for _stat in ("mean", "max", "median"):
    _fn = {"mean": "avg"}.get(_stat, _stat)
    query(f"P13_order_by_center_{_stat}", sql(f"""SELECT region_id, score, row_number() OVER (ORDER BY score DESC, region_id) - 1 AS ord FROM
        (SELECT region_id, {_fn}(value) AS score FROM mat WHERE bin BETWEEN 29 AND 35 GROUP BY region_id)""", "mat"), dbl="score")(
        lambda s, d, q=_stat: sg.order_by_center(ad.matrix(s, d), 64, 3, q))
query("W3_moving_average_edge", f"""WITH t AS ({_TR}) SELECT track, bin, (SELECT avg(m) FROM (SELECT list_extract(l, greatest(least(t.bin + k, 63), 0) + 1) AS m
    FROM (SELECT unnest(range(-3, 3)) AS k))) AS smooth FROM t JOIN (SELECT track, list(mean ORDER BY bin) AS l FROM t GROUP BY track) USING (track)""",
    dbl="smooth", ints="track")(
    lambda s, d: sg.moving_average_edge(_tracks(s, d), ["track"], "bin", "mean", 6, "smooth").select("track", "bin", "smooth"))
query("C18_complete_bins", sql(f"""SELECT m_strand, rel_bin, n FROM (SELECT DISTINCT m_strand FROM cm) CROSS JOIN (SELECT unnest(range(-98, 99, 7)) AS rel_bin)
    LEFT JOIN (SELECT m_strand, CAST(floor(rel_pos / 7) AS BIGINT) * 7 AS rel_bin, count(*) AS n FROM cm GROUP BY ALL) USING (m_strand, rel_bin)""", "cm"))(
    lambda s, d: lk.complete_bins(ad.calls_motif(s, d).groupBy("m_strand", fc.pos_bin("rel_pos", 7).alias("rel_bin")).agg(
        F.count("*").alias("n")).withColumn("rel_bin", F.col("rel_bin") + 0), 98, 7, ["m_strand"]))
query("C19_curves_wide", sql("""SELECT rel_bin, avg(u) FILTER (WHERE m_strand = '+') AS plus, avg(u) FILTER (WHERE m_strand = '-') AS minus FROM (
    SELECT m_strand, CAST(floor(rel_pos / 5) AS BIGINT) * 5 AS rel_bin, CASE WHEN status = 'U' THEN 1 ELSE 0 END AS u FROM cm) GROUP BY rel_bin""", "cm"),
    dbl="plus minus")(
    lambda s, d: (lambda c: lk.curves_wide({n: c.filter(f"m_strand = '{t}'").groupBy("rel_bin").agg(F.avg("u").alias("f"))
                                            for n, t in (("plus", "+"), ("minus", "-"))}, "rel_bin", "f"))(
        ad.calls_motif(s, d).selectExpr("m_strand", "CAST(floor(rel_pos / 5) * 5 AS INT) AS rel_bin", "CAST(status = 'U' AS INT) AS u")))
query("P21_box_stats", sql("""SELECT zf, n, q1, q2, q3, min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1)) AS lo, max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1)) AS hi FROM
    (SELECT zf, binding_prob AS v FROM bp WHERE binding_prob IS NOT NULL) JOIN (SELECT zf, count(*) AS n, quantile_cont(binding_prob, 0.25) AS q1,
     quantile_cont(binding_prob, 0.5) AS q2, quantile_cont(binding_prob, 0.75) AS q3 FROM bp WHERE binding_prob IS NOT NULL GROUP BY zf) USING (zf) GROUP BY ALL""", "bp"),
    dbl="q1 q2 q3 lo hi")(lambda s, d: sg.box_stats(bd.binding_prob(r1b_states(s, d), NDR)))
query("P20_density_table", sql("""
    SELECT zf, y, CASE WHEN max(h) OVER (PARTITION BY zf) > 0 THEN h / max(h) OVER (PARTITION BY zf) ELSE 0 END AS density FROM (
      SELECT g.zf, g.y, sum(coalesce(f.h, 0) * w) AS h FROM
        (SELECT DISTINCT zf, y FROM bp CROSS JOIN (SELECT unnest(range(60)) AS y) WHERE binding_prob IS NOT NULL) g
        CROSS JOIN (SELECT k, exp(-0.5 * (k / 1.2) * (k / 1.2)) / sum(exp(-0.5 * (k / 1.2) * (k / 1.2))) OVER () AS w FROM (SELECT unnest(range(-5, 6)) AS k))
        LEFT JOIN (SELECT zf, y, count(*) / sum(count(*)) OVER (PARTITION BY zf) AS h FROM (
            SELECT zf, least(CAST(floor((binding_prob + 0.05) / (1.1 / 60)) AS BIGINT), 59) AS y FROM bp WHERE binding_prob IS NOT NULL) GROUP BY zf, y) f
        ON f.zf = g.zf AND f.y = greatest(least(g.y + k, 59), 0) GROUP BY g.zf, g.y)""", "bp"), dbl="density")(
    lambda s, d: sg.density_table(bd.binding_prob(r1b_states(s, d), NDR), 60))
query("W2_rolling_mean_profile", sql(f"""SELECT bin, avg(mean) OVER (ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS smooth FROM
    ({_PROF.format(sd='stddev_samp')})""", "mat"), dbl="smooth")(
    lambda s, d: centred_mean(with_index(chunk_by(prof(s, d).withColumn("k", F.lit(1)), "bin", 16), ["k"], ["bin"]), ["k"], "idx", "mean", 4, "smooth").select("bin", "smooth"))
