"""Readers and writers of genome tables (A1-A14, A19). Schemas are explicit; nothing is inferred
on large inputs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlight.session import cut_lineage

# Field order of the text formats.
RAW_SCHEMA = (
    "chrom string, strand string, start long, end long, read_id string, llr double, ll_met double, ll_unmet double, "
    "field9 string, n_motifs int, field11 string, kmer string"
)
WIDE_SCHEMA = (
    "chrom string, start long, end long, call_pos long, strand string, read_id string, llr double, llr_met double, "
    "llr_unmet double, status string"
)
INTERSECT_SCHEMA = WIDE_SCHEMA + (
    ", m_chrom string, m_start long, m_end long, m_strand string, m_seq string, center long"
)
PEAK_SCHEMA = "chrom string, start long, end long, score double, field5 string, region string"
SIGNAL_SCHEMA = "chrom string, start long, end long, strand string, signal double"
TRACK_SCHEMA = "chrom string, start long, end long, value double"
# Column aliases, the first that is there wins; names after the fourth (third for name, start, end) are additions.
NAME_ALIASES = ["motif_id", "name", "id", "motif_name"]
COLUMN_ALIASES = {
    "chrom": ["chr_motif", "chrom", "chr", "seqname", "chromosome", "seqnames"],
    "start": ["start_motif", "start", "chromstart"],
    "end": ["end_motif", "end", "chromend", "stop"],
    "strand": ["strand_motif", "strand"],
}


def _tsv(spark: SparkSession, path, schema: str, header: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", header).csv(path)


def read_raw_calls(spark: SparkSession, path) -> DataFrame:
    """A1: twelve-field calls behind one header line."""
    return _tsv(spark, path, RAW_SCHEMA, header=True)


def calls_to_parquet(calls: DataFrame, path: str, chrom: str = "chrom") -> None:
    """A1: one-time conversion, partitioned by chromosome and sorted for row-group pruning.

    The range shuffle on (chromosome, position) splits a large chromosome over many files.
    """
    pos = "call_pos" if "call_pos" in calls.columns else "start"
    calls.repartitionByRange(chrom, pos).sortWithinPartitions(chrom, pos).write.partitionBy(chrom).parquet(path)


def read_calls(spark: SparkSession, path, chroms: list[str] | None = None, max_rows: int = 0) -> DataFrame:
    """A2: wide calls, optionally some chromosomes or a trial number of rows."""
    df = _tsv(spark, path, WIDE_SCHEMA)
    if chroms:
        df = df.filter(F.col("chrom").isin(chroms))
    return df.limit(max_rows) if max_rows else df


def read_calls_motif(spark: SparkSession, path, chroms: list[str] | None = None) -> DataFrame:
    """A3: calls already joined to motifs (the first sixteen fields)."""
    df = _tsv(spark, path, INTERSECT_SCHEMA)
    return df.filter(F.col("m_chrom").isin(chroms)) if chroms else df


def detect_calls_format(spark: SparkSession, path) -> str:
    """A4: 'intersect' or 'wide' from the field count of the first row."""
    n = spark.read.text(path).select(F.size(F.split("value", "\t"))).first()[0]
    if n >= 16:
        return "intersect"
    return "wide" if n <= 12 else "intersect"


def read_motifs(spark: SparkSession, path, all_or_nothing: bool = False) -> DataFrame:
    """A5: chrom, start, end, strand, then the centre: the fifth field where it is a number, else
    the floor midpoint. With ``all_or_nothing`` one row whose fifth field is text gives every row
    its midpoint (an empty fifth field is only missing)."""
    df = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    s, e = F.get("f", F.lit(1)).cast("long"), F.get("f", F.lit(2)).cast("long")
    c = F.expr("CAST(try_cast(get(f, 4) AS DOUBLE) AS BIGINT)")
    if all_or_nothing:
        bad = df.filter("trim(get(f, 4)) <> '' AND try_cast(get(f, 4) AS DOUBLE) IS NULL")
        if not bad.isEmpty():
            c = F.lit(None).cast("long")
    return df.select(
        F.get("f", F.lit(0)).alias("chrom"), s.alias("start"), e.alias("end"), F.get("f", F.lit(3)).alias("strand"),
        F.coalesce(c, F.floor((s + e) / 2)).alias("center"),
    )


def read_peaks(spark: SparkSession, glob) -> DataFrame:
    """Replicate peak files, the replicate taken from the file name."""
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.bed(\.gz)?$", "")
    return _tsv(spark, glob, PEAK_SCHEMA).select("*", name.alias("replicate"))


def read_bed(spark: SparkSession, path) -> DataFrame:
    """First three fields of a BED file (plain or gzip)."""
    f = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    return f.select(F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).cast("long").alias("start"),
                    F.get("f", F.lit(2)).cast("long").alias("end"))


def read_motif_hits(spark: SparkSession, path) -> DataFrame:
    """Scanner hits: '#' lines dropped, '.' missing, empty columns dropped, then rows with
    anything missing."""
    df = spark.read.option("sep", "\t").option("header", True).option("comment", "#").option("nullValue", ".").csv(path)
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    keep = [c for c in df.columns if filled[c] > 0]
    return df.select(*[F.col(f"`{c}`") for c in keep]).na.drop("any")


def hit_positions(hits: DataFrame) -> DataFrame:
    """Sequence name, start, stop, strand in (name, start) order."""
    return hits.select(
        "sequence_name", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "strand"
    ).orderBy("sequence_name", "start")


def read_track(spark: SparkSession, path) -> DataFrame:
    """A10: signal intervals from bedGraph text or Parquet. Header lines (comments, track, browser)
    are skipped; any other line must parse, or the read fails."""
    if str(path).endswith(".parquet"):
        return spark.read.schema(TRACK_SCHEMA).parquet(path)
    t = spark.read.text(path).filter("NOT (trim(value) = '' OR value LIKE '#%' OR value LIKE 'track%' OR value LIKE 'browser%')")
    f = F.split("value", "\t")
    return t.select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("start"),
                    F.get(f, F.lit(2)).cast("long").alias("end"), F.get(f, F.lit(3)).cast("double").alias("value")).filter(
        F.when(F.col("start").isNull() | F.col("end").isNull(), F.raise_error(F.lit("track line without coordinates")).cast("boolean")).otherwise(True))


def read_chrom_sizes(spark: SparkSession, path) -> DataFrame:
    return _tsv(spark, path, "chrom string, length long")


def read_signals(spark: SparkSession, paths: list[str], labels: list[str]) -> DataFrame:
    """Several five-field signal files as one long table with a ``track`` label."""
    if len(paths) != len(labels):
        raise ValueError("one label per file")
    out = None
    for p, lab in zip(paths, labels):
        t = _tsv(spark, p, SIGNAL_SCHEMA).withColumn("track", F.lit(lab))
        out = t if out is None else out.unionByName(t)
    return out.withColumn("motif_id", F.concat_ws("_", "chrom", "start", "end", "strand"))


def to_bed6(df: DataFrame) -> DataFrame:
    """Columns found by alias; name defaults to motifN in (chrom, start, end) order, strand
    to '+', score 0."""
    from strandlight.ordered import chunk_by, with_index

    lower = {re.sub(r"^#", "", c).lower(): c for c in df.columns}

    def find(names: list[str]) -> str | None:
        return next((lower[n] for n in names if n in lower), None)

    c = {k: find(v) for k, v in COLUMN_ALIASES.items()}
    missing = [k for k in ("chrom", "start", "end") if c[k] is None]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    name = find(NAME_ALIASES)
    strand = F.when(F.col(c["strand"]).isin("+", "-"), F.col(c["strand"])).otherwise("+") if c["strand"] else F.lit("+")
    out = df.select(
        F.col(c["chrom"]).alias("chrom"), F.col(c["start"]).cast("long").alias("start"), F.col(c["end"]).cast("long").alias("end"),
        (F.col(name) if name else F.lit(None).cast("string")).alias("name"), F.lit(0).alias("score"), strand.alias("strand"),
    )
    if name:
        return out
    # file-wide numbering: chunks are (chromosome rank, position block)
    ranks = {r[0]: i for i, r in enumerate(out.select("chrom").distinct().orderBy("chrom").collect())}  # chromosomes
    rank = F.create_map(*[x for k, i in ranks.items() for x in (F.lit(k), F.lit(i))]) if ranks else F.create_map()
    t = chunk_by(out.withColumn("_g", F.lit(1)), "start", 1 << 22)
    t = t.withColumn("_chunk", F.element_at(rank, F.col("chrom")).cast("long") * (1 << 20) + F.col("_chunk"))
    t = with_index(t, ["_g"], ["chrom", "start", "end", "strand"], "_i")
    return t.withColumn("name", F.concat(F.lit("motif"), (F.col("_i") + 1).cast("string"))).select(*out.columns)


def _lines(spark: SparkSession, path) -> DataFrame:
    """Lines of a text input with the file (``_file``) and the split (``_at``, its first byte) they come from."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"))


def _numbered(lines: DataFrame, row_col: str) -> DataFrame:
    """Lines of one text input (``_lines``) numbered 0.. in file order: by path, then by place.

    Spark packs splits into partitions by size, so partition ids do not follow file order; the file and
    the split do. One small row per split carries the offsets.
    """
    split = ["_file", "_at"]
    t = cut_lineage(lines.withColumn("_m", F.monotonically_increasing_id()), "lines")
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = t.groupBy(*split).agg(F.count(F.lit(1)).alias("_n")).select(*split, before.alias("_b"))
    at = t.withColumn("_k", F.row_number().over(Window.partitionBy(*split).orderBy("_m")) - 1)
    return at.join(per, split).withColumn(row_col, (F.col("_b") + F.col("_k")).cast("long")).drop("_m", "_k", "_b", *split)


def read_matrix_tab(spark: SparkSession, path, row_col: str = "region_id") -> DataFrame:
    """Numeric text rows in long form (row, bin, value): comment and blank lines, and tab-separated
    tokens that are not numbers, skipped; rows are numbered 0.. among the numeric ones, in file order."""
    t = _lines(spark, path).filter("trim(value) <> '' AND NOT value LIKE '#%'")
    vals = F.expr("filter(transform(split(value, '\t'), x -> try_cast(trim(x) AS DOUBLE)), x -> x IS NOT NULL)")
    t = _numbered(t.select(vals.alias("v"), "_file", "_at").filter("size(v) > 0"), row_col)
    return t.select(row_col, F.posexplode("v").alias("bin", "value")).withColumn(
        "value", F.when(~F.isnan("value"), F.col("value")))


def matrix_with_regions(matrix: DataFrame, regions: DataFrame, row_col: str = "region_id") -> DataFrame:
    """A13 + A14: matrix rows with the region of the same number; different numbers of rows fail."""
    m, r = matrix.select(row_col).distinct().count(), regions.count()
    if m != r:
        raise ValueError(f"{m} matrix rows, {r} regions")
    return matrix.join(regions, row_col)


def pad_matrix(mat: DataFrame, row_col: str = "region_id") -> DataFrame:
    """Every row padded with nulls to the widest one."""
    n = mat.agg(F.max("bin")).first()[0]
    grid = mat.select(row_col).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n))))
    return grid.join(mat, [row_col, "bin"], "left")


def read_regions(spark: SparkSession, path, strand_col: int | None = None, row_col: str = "region_id") -> DataFrame:
    """Region rows without comment, track and browser lines, numbered 0.. in file order; the strand
    from the given 0-based column or the detected one, '+' where there is none."""
    t = _lines(spark, path).filter(
        "trim(value) <> '' AND NOT value LIKE '#%' AND NOT value LIKE 'track%' AND NOT value LIKE 'browser%'"
    ).select(F.split("value", "\t").alias("f"), "_file", "_at")
    if strand_col is None:
        strand_col = detect_strand_col(t)
    s = F.coalesce(F.get("f", F.lit(strand_col)), F.lit("+")) if strand_col is not None else F.lit("+")
    t = _numbered(t, row_col)
    return t.select(row_col, F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).cast("long").alias("start"),
                    F.get("f", F.lit(2)).cast("long").alias("end"), s.alias("strand"))


def detect_strand_col(rows: DataFrame) -> int | None:
    """The sixth field, else the fourth, else any that holds a strand in the first row."""
    first = rows.first()
    f = first["f"] if first else []
    for i in [5, 3, *range(len(f))]:
        if i < len(f) and f[i] in ("+", "-"):
            return i
    return None


# ---------------------------------------------------------------- sinks


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.option("sep", "\t").option("header", header).csv(path)


def write_bed(df: DataFrame, path: str) -> None:
    """Headerless, sorted within files by coordinates."""
    df.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start").write.option("sep", "\t").csv(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    (df.write.partitionBy(*by) if by else df.write).parquet(path)


def quantile_beds(df: DataFrame, path: str, q: int, quantile: str = "quantile") -> None:
    """One folder per quantile (``<quantile>=<i>``), written in one pass; empty quantiles get an empty folder."""
    df.filter(F.col(quantile).between(1, q)).write.partitionBy(quantile).option("sep", "\t").csv(path)
    have = {r[0] for r in df.filter(F.col(quantile).between(1, q)).select(quantile).distinct().collect()}  # at most q
    for i in sorted(set(range(1, q + 1)) - have):
        df.drop(quantile).limit(0).write.option("sep", "\t").csv(f"{path}/{quantile}={i}")
