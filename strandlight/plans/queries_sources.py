"""Queries on readers and writers: the given tables are written in a text format to the shared
folder and read back, so the work grows with them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandlight.functions import calls as fc
from strandlight.plans.oracle import sql
from strandlight.plans.queries_genome import _OV, _WIDE, wide_from_raw
from strandlight.plans.registry import query
from strandlight.session import scratch_path
from strandlight.sources import adapters as ad
from strandlight.sources import genome as g
from strandlight.sources import layout as ly
from strandlight.sources import traces as ts
from strandlight.streaming.ingest import append_to, calls_to_motifs_stream, read_raw_stream


def _out(s, name):
    return scratch_path(s, name)


def _raw_file(s, d):
    p = _out(s, "raw")
    g.write_tsv(ad.raw_calls(s, d), p, header=True)
    return p


query("A1_read_raw_calls", sql('SELECT chrom, strand, "start", "end", read_id, llr, ll_met, ll_unmet, n_motifs, kmer FROM raw', "raw"), dbl="llr ll_met ll_unmet", ints="n_motifs")(
    lambda s, d: g.read_raw_calls(s, _raw_file(s, d)).drop("field9", "field11"))


def _raw_parquet(s, d):
    p = _out(s, "raw-parquet")
    g.calls_to_parquet(wide_from_raw(ad.raw_calls(s, d)), p)
    return s.read.parquet(p).select(*fc.WIDE_COLUMNS)


def _layout(s, d):
    return ly.write_calls(ad.calls(s, d), int(s.conf.get("spark.sql.shuffle.partitions")))


def _layout_overlap(s, d, stored: bool):
    lay, m = _layout(s, d), ad.motifs(s, d)
    return ly.overlap(s, lay, ly.write_motifs(m, lay) if stored else m).selectExpr(
        "a_chrom AS chrom", "a_call_pos AS call_pos", "a_read_id AS read_id", "b_start AS m_start", "b_center AS center")


_LAYOUT = sql(f"""SELECT a.chrom, a.call_pos, a.read_id, b."start" AS m_start, b.center FROM calls a JOIN motifs b ON {_OV}""", "calls", "motifs")
query("A1_layout_overlap", _LAYOUT)(lambda s, d: _layout_overlap(s, d, False))
query("A1_layout_overlap_stored", _LAYOUT)(lambda s, d: _layout_overlap(s, d, True))
query("A20_layout_region", sql("SELECT chrom, call_pos, read_id, status FROM calls WHERE chrom = 'chr7' AND call_pos BETWEEN 2000 AND 5000", "calls"))(
    lambda s, d: ly.region(s, _layout(s, d), "chr7", 2000, 5000).select("chrom", "call_pos", "read_id", "status"))
query("A1_calls_to_parquet", sql(_WIDE, "raw"), dbl="llr llr_met llr_unmet")(_raw_parquet)


def _wide_file(s, d):
    p = _out(s, "wide")
    g.write_tsv(ad.calls(s, d), p, header=False)
    return p


query("A2_read_calls", sql("SELECT * FROM calls WHERE chrom IN ('chr1', 'chr2', 'chr22')", "calls"), dbl="llr llr_met llr_unmet")(
    lambda s, d: g.read_calls(s, _wide_file(s, d), ["chr1", "chr2", "chr22"]))


def _intersect_file(s, d):
    from strandlight.operators.intervals import overlap_join

    p = _out(s, "intersect")
    j = overlap_join(ad.calls(s, d), ad.motifs(s, d), a_max_len=2)
    g.write_tsv(j, p, header=False)
    return p


query("A3_read_calls_motif", sql("""SELECT c.read_id, c.call_pos, c.status, m.chrom AS m_chrom, m."start" AS m_start, m.strand AS m_strand, m.seq AS m_seq, m.center
    FROM calls c JOIN motifs m ON c.chrom = m.chrom AND c."start" < m."end" AND c."end" > m."start" WHERE m.chrom <> 'chr5'""", "calls", "motifs"))(
    lambda s, d: g.read_calls_motif(s, _intersect_file(s, d), [f"chr{i}" for i in range(1, 23) if i != 5]).select(
        "read_id", "call_pos", "status", "m_chrom", "m_start", "m_strand", "m_seq", "center"))
query("A4_detect_calls_format", "SELECT 'wide' AS wide_file, 'intersect' AS joined_file, (SELECT count(*) FROM lineitem) AS n")(
    lambda s, d: (lambda w, i: g.read_calls(s, w).agg(F.lit(g.detect_calls_format(s, w)).alias("wide_file"),
        F.lit(g.detect_calls_format(s, i)).alias("joined_file"), F.count("*").alias("n")))(_wide_file(s, d), _intersect_file(s, d)))


def _motif_file(s, d):
    p = _out(s, "motifs")
    m = ad.motifs(s, d).withColumn("f5", F.when(F.col("center") % 3 == 0, F.col("seq")).otherwise((F.col("center") + 1).cast("string")))
    g.write_tsv(m.select("chrom", "start", "end", "strand", "f5", "center"), p, header=False)
    return p


query("A5_read_motifs", sql('SELECT chrom, "start", "end", strand, CASE WHEN center % 3 = 0 THEN center ELSE center + 1 END AS center FROM motifs', "motifs"))(
    lambda s, d: g.read_motifs(s, _motif_file(s, d)))


def _peak_files(s, d):
    p = _out(s, "peaks")
    t = ad.peaks(s, d).select("chrom", "start", "end", "score", F.lit(".").alias("f5"), F.expr("concat(chrom, ':', start - 3, '-', end + 5)").alias("region"), "replicate")
    for r in ("A", "N", "R"):
        t.filter(F.col("replicate") == r).drop("replicate").write.option("sep", "\t").csv(f"{p}/{r}.bed")
    return p


query("A6_read_peaks", sql("""SELECT chrom, "start", "end", score, CAST(floor(("start" - 3 + "end" + 5) / 2) AS BIGINT) AS summit, 1 AS has_name FROM peaks""", "peaks"), dbl="score", ints="has_name")(
    lambda s, d: g.read_peaks(s, f"{_peak_files(s, d)}/*.bed").withColumn("s0", F.col("start")).withColumn("e0", F.col("end")).transform(fc.summits).select(
        "chrom", F.col("s0").alias("start"), F.col("e0").alias("end"), "score", F.col("end").alias("summit"), (F.col("replicate") != "").cast("int").alias("has_name")))


def _gz(s, d):
    p = _out(s, "bed-gz")
    ad.motifs(s, d).select("chrom", "start", "end").write.option("sep", "\t").option("compression", "gzip").csv(p)
    return p


query("A7_read_bed_gzip", sql('SELECT chrom, "start", "end" FROM motifs', "motifs"))(lambda s, d: g.read_bed(s, _gz(s, d)).orderBy("chrom", "start"))


def _hits_file(s, d):
    p = _out(s, "hits")
    m = ad.motifs(s, d)
    cols = ["motif_id", "motif_alt_id", "sequence_name", "start", "stop", "strand", "score", "p-value", "q-value", "matched_sequence"]
    body = m.selectExpr("'M1'", "'.'", "chrom", "start", "end", "strand", "'9.5'", "'1e-5'", "'.'", "CASE WHEN center % 7 = 0 THEN '.' ELSE seq END").toDF(*cols)
    foot = s.range(1).selectExpr("'# scanner footer'", *["CAST(NULL AS STRING)"] * 9).toDF(*cols)
    body.select(*[F.col(f"`{c}`").cast("string") for c in cols]).toDF(*cols).unionAll(foot).write.option("sep", "\t").option("header", True).csv(p)
    return p


query("A8_read_motif_hits", sql("""SELECT chrom AS sequence_name, CAST("start" AS VARCHAR) AS "start", CAST("end" AS VARCHAR) AS stop, strand, seq AS matched_sequence, 8 AS n_columns
    FROM motifs WHERE center % 7 <> 0""", "motifs"), ints="n_columns")(
    lambda s, d: (lambda h: h.select("sequence_name", "start", "stop", "strand", "matched_sequence", F.lit(len(h.columns)).alias("n_columns")))(g.read_motif_hits(s, _hits_file(s, d))))
query("A9_hit_positions", sql("""SELECT chrom AS sequence_name, "start", "end" AS stop, strand FROM motifs WHERE center % 7 <> 0""", "motifs"))(
    lambda s, d: g.hit_positions(g.read_motif_hits(s, _hits_file(s, d))))


def _track_file(s, d, fmt):
    p = _out(s, "track") + (".parquet" if fmt == "parquet" else "")
    t = ad.track(s, d)
    t.write.parquet(p) if fmt == "parquet" else t.write.option("sep", "\t").csv(p)
    return p


for _f in ("text", "parquet"):
    query(f"A10_read_track_{_f}", sql('SELECT chrom, "start", "end", value FROM track', "track"), dbl="value")(
        lambda s, d, f=_f: g.read_track(s, _track_file(s, d, f)))


def _signal_files(s, d):
    out = []
    m = ad.motifs(s, d)
    for lab, e in (("alpha", F.col("center") % 10), ("beta", F.col("center") % 7)):
        p = _out(s, f"signal-{lab}")
        m.select("chrom", "start", "end", "strand", e.cast("double").alias("signal")).write.option("sep", "\t").csv(p)
        out.append(p)
    return out


query("A11_read_signals", sql("""SELECT track, chrom || '_' || "start" || '_' || "end" || '_' || strand AS motif_id, CAST(center % k AS DOUBLE) AS signal
    FROM motifs CROSS JOIN (VALUES ('alpha', 10), ('beta', 7)) v(track, k)""", "motifs"), dbl="signal")(
    lambda s, d: g.read_signals(s, _signal_files(s, d), ["alpha", "beta"]).select("track", "motif_id", "signal"))
query("A12_to_bed6", sql("""SELECT chrom, "start", "end", 'motif' || row_number() OVER (ORDER BY chrom, "start", "end", strand) AS name, 0 AS score,
    CASE WHEN center % 4 = 0 THEN '+' ELSE strand END AS strand FROM (SELECT chrom, "start", "end", center, CASE WHEN center % 4 = 0 THEN '+' ELSE strand END AS strand FROM motifs)""", "motifs"), ints="score")(
    lambda s, d: g.to_bed6(ad.motifs(s, d).select(F.col("chrom").alias("Chromosome"), F.col("start").alias("start_motif"), F.col("end").alias("stop"),
        F.when(F.col("center") % 4 == 0, "?").otherwise(F.col("strand")).alias("strand"))))


def _matrix_file(s, d):
    p = _out(s, "matrix")
    e = ad.table(s, d, "embeddings")
    ragged = F.slice(F.transform("embedding", lambda x: F.round(x.cast("double"), 4).cast("string")), 1, (F.col("vec_id") % 5 + 60).cast("int"))
    e.select(F.array_join(F.concat(ragged, F.array(F.lit("label"))), "\t").alias("value")).write.text(p)
    return p


query("A13_read_matrix_tab", """SELECT bin, sum(v) AS total, count(v) AS n, (SELECT count(*) FROM embeddings) AS n_rows FROM
    (SELECT i - 1 AS bin, CASE WHEN i <= vec_id % 5 + 60 THEN round(CAST(embedding[i] AS DOUBLE), 4) END AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)) GROUP BY bin""",
    dbl="total", digits=4)(
    lambda s, d: g.pad_matrix(g.read_matrix_tab(s, _matrix_file(s, d))).groupBy("bin").agg(F.sum("value").alias("total"), F.count("value").alias("n"), F.count("*").alias("n_rows")))


def _region_file(s, d):
    p = _out(s, "regions")
    m = ad.motifs(s, d)
    m.select(F.expr("concat_ws('\t', chrom, start, end, seq, 0, strand)").alias("value")).unionAll(
        s.range(2).select(F.concat(F.lit("track name="), F.col("id").cast("string")).alias("value"))).write.text(p)
    return p


query("A14_read_regions", sql('SELECT chrom, "start", "end", strand FROM motifs', "motifs"))(lambda s, d: g.read_regions(s, _region_file(s, d)).drop("region_id"))


def _paired(s, d):
    """Matrix and region files of as many rows, read back, paired by number and turned by strand."""
    p, q = _out(s, "pairs-m"), _out(s, "pairs-r")
    e = ad.table(s, d, "embeddings").orderBy("vec_id")
    e.select(F.concat_ws("\t", F.lit("row"), F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double"), 4).cast("string")), "\t")).alias("value")).write.text(p)
    e.select(F.expr("concat_ws('\t', 'chr' || (vec_id % 5), vec_id * 10, vec_id * 10 + 5, if(vec_id % 3 = 0, '-', '+'))").alias("value")).write.text(q)
    m = g.matrix_with_regions(g.read_matrix_tab(s, p), g.read_regions(s, q))
    return m.withColumn("bin", F.when(F.col("strand") == "-", 63 - F.col("bin")).otherwise(F.col("bin")))


# values have four digits, so their weighted sum is exact in ten-thousandths, in any order
query("A13_A14_paired_profile", """SELECT CASE WHEN vec_id % 3 = 0 THEN 64 - i ELSE i - 1 END AS bin,
      CAST(sum(vec_id * CAST(round(CAST(embedding[i] AS DOUBLE) * 10000) AS BIGINT)) AS DOUBLE) / 10000 AS weighted, count(*) AS n
    FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1""", dbl="weighted", ints="bin", digits=4)(
    lambda s, d: _paired(s, d).groupBy("bin").agg(
        (F.expr("sum(CAST(start DIV 10 AS DECIMAL(20)) * CAST(round(value * 10000) AS DECIMAL(10)))").cast("double") / 10000).alias("weighted"), F.count("*").alias("n")))


def _mixed_motifs(s, d):
    p = _out(s, "mixed")
    ad.motifs(s, d).select(F.expr("concat_ws('\t', chrom, start, end, strand, if(start % 3 = 0, 'text', cast(center AS string)))").alias("value")).write.text(p)
    return p


query("A5_read_motifs_all_or_nothing", sql('SELECT chrom, "start", "end", strand, CAST(floor(("start" + "end") / 2) AS BIGINT) AS center FROM motifs', "motifs"))(
    lambda s, d: g.read_motifs(s, _mixed_motifs(s, d), all_or_nothing=True))
query("A12_to_bed6_priority", sql("""SELECT chrom, "start", "end", 'id' || center AS name, 0 AS score, strand FROM motifs""", "motifs"), ints="score")(
    lambda s, d: g.to_bed6(ad.motifs(s, d).select(F.lit("x").alias("chrom"), F.col("chrom").alias("chr_motif"), F.lit(1).alias("start"), F.col("start").alias("start_motif"),
        F.lit(2).alias("end"), F.col("end").alias("end_motif"), F.lit("n").alias("name"), F.concat(F.lit("id"), F.col("center")).alias("motif_id"), F.lit("?").alias("strand"), F.col("strand").alias("strand_motif"))))


def _trace_files(s, d):
    p = _out(s, "traces")
    t = ad.traces(s, d).select("condition", F.col("trace_id").cast("string").alias("tid"), F.col("t").alias("time (seconds)"), F.col("signal").alias("force (pN)"), "ev")
    # one folder per trace; the reader takes ids from the last folder and file, so name both
    t.repartition("condition").write.option("header", True).partitionBy("condition").csv(p)
    return p


query("A15_read_traces", """SELECT 'condition=' || (user_id % 4) AS condition, count(*) AS n, sum(value) AS total FROM events GROUP BY 1""", dbl="total")(
    lambda s, d: ts.read_traces(s, _trace_files(s, d)).groupBy("condition").agg(F.count("*").alias("n"), F.sum("signal").alias("total")))


def _single_trace_files(s, d):
    """A file per trace, below condition and trace folders."""
    p = _out(s, "single-traces")
    t = ad.traces(s, d).select("condition", F.col("trace_id").alias("tid"), F.col("t").alias("time (seconds)"), F.col("signal").alias("force (pN)"), "ev")
    t.repartition("condition", "tid").sortWithinPartitions("condition", "tid", "ev").drop("ev").write.option("header", True).partitionBy("condition", "tid").csv(p)
    return ts.read_traces(s, p)


query("A15_read_traces_keys", """SELECT 'condition=' || (user_id % 4) || '/tid=' || user_id AS condition, count(*) AS n, sum(value) AS total, CAST(1 AS BIGINT) AS ids, CAST(0 AS BIGINT) AS back FROM events GROUP BY user_id""", dbl="total")(
    lambda s, d: (lambda t: t.withColumn("b", F.when(F.col("t") < F.lag("t").over(Window.partitionBy("trace_id").orderBy("ev")), 1).otherwise(0)).groupBy("condition").agg(
        F.count("*").alias("n"), F.sum("signal").alias("total"), F.countDistinct("trace_id").alias("ids"), F.sum("b").alias("back")))(_single_trace_files(s, d)))


def _history_files(s, d):
    p = _out(s, "histories")
    h = ad.traces(s, d).groupBy((F.col("trace_id") % 6 + 1).alias("k"), (F.col("ev") % 5 + 1).cast("int").alias("iteration")).agg((-F.sum("signal")).alias("log_likelihood"))
    for k in range(1, 7):
        h.filter(F.col("k") == k).select("iteration", "log_likelihood").write.option("header", True).csv(f"{p}/loglikelihood_{k}_states.csv")
    return p


def _histories(s, d):
    return ts.read_fit_histories(s, f"{_history_files(s, d)}/loglikelihood_*_states.csv", 5)


query("A16_read_fit_histories", """SELECT user_id % 6 + 1 AS k, -sum(value) AS log_likelihood FROM events WHERE user_id % 6 + 1 <= 5 AND event_id % 5 = 4 GROUP BY 1""", dbl="log_likelihood")(_histories)


def _cal_files(s, d):
    from strandlight.plans.queries_traces import calibration

    p = _out(s, "calibration")
    c = calibration(s, d).select("date", "curve", F.col("kappa").alias("kappa (pN/nm)"), (F.col("kappa") * 4).alias("Bead diameter (um)"), "channel")
    for ch in ("1x", "2x"):
        c.filter(F.col("channel") == ch).drop("channel").write.option("header", True).csv(f"{p}/cal_{ch}")
    return p


query("A18_read_calibration", """SELECT date, count(*) AS n, sum(kappa) AS kappa, sum(kappa * 2) AS radius FROM (SELECT DISTINCT CAST(user_id % 4 AS VARCHAR) AS date, user_id AS curve FROM events)
    CROSS JOIN (VALUES (1), (2)) v(c), LATERAL (SELECT 0.2 + (curve % 17) * 0.01 * c AS kappa) GROUP BY date""", dbl="kappa radius")(
    lambda s, d: ts.read_calibration(s, f"{_cal_files(s, d)}/*").groupBy("date").agg(F.count("*").alias("n"), F.sum("kappa").alias("kappa"), F.sum("radius").alias("radius")))


def _quantile_files(s, d):
    from strandlight.operators.signals import quantile_rank

    p = _out(s, "quantiles")
    m = quantile_rank(ad.motifs(s, d).withColumn("v", F.col("center").cast("double")), "v", 4)
    g.quantile_beds(m.select("chrom", "start", "end", "center", "v", "quantile"), p, 4)
    out = None
    for i in range(1, 5):
        t = s.read.schema("chrom string, start long, end long, center long, v double").option("sep", "\t").csv(f"{p}/quantile={i}").withColumn("quantile", F.lit(i))
        out = t if out is None else out.unionByName(t)
    return out


query("A19_quantile_beds", sql("""SELECT chrom, "start", "end", center, CAST(center AS DOUBLE) AS v, CAST(ceil(rk * 4 / max(rk) OVER ()) AS BIGINT) AS quantile FROM
    (SELECT *, rank() OVER (ORDER BY center) + (count(*) OVER (PARTITION BY center) - 1) / 2.0 AS rk FROM motifs)""", "motifs"), dbl="v")(_quantile_files)


def _bed_sink(s, d):
    p = _out(s, "bed")
    g.write_bed(ad.motifs(s, d).select("chrom", "start", "end"), p)
    return g.read_bed(s, p)


query("A19_write_bed", sql('SELECT chrom, "start", "end" FROM motifs', "motifs"))(_bed_sink)


def _stream(s, d):
    src, dst, chk = _raw_file(s, d), _out(s, "stream-out"), _out(s, "stream-checkpoint")
    q = append_to(calls_to_motifs_stream(read_raw_stream(s, src), ad.motifs(s, d)), dst, chk).trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(dst)


query("L1_calls_to_motifs_stream", sql("""SELECT m.chrom || '_' || m."start" || '_' || m."end" || '_' || m.strand AS motif_id, c.read_id, c.status,
    (c.call_pos - m.center) * CASE WHEN m.strand = '+' THEN -1 ELSE 1 END AS rel_pos, c.chrom, c.call_pos
    FROM w c JOIN motifs m ON c.chrom = m.chrom AND c."start" < m."end" AND c."end" > m."start" """, "raw", "motifs", w=_WIDE))(_stream)
