"""Column expressions and row operators on calls, windows and motifs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlight.util import col

# 3-bp bins, core bins 1..11 around the centre; standard chromosomes.
BIN_WIDTH = 3
CENTER_BIN = 6
CORE_BINS = list(range(1, 12))
STANDARD_CHROM = "^chr([1-9]|1[0-9]|2[0-2]|X)$"

WIDE_COLUMNS = [
    "chrom", "start", "end", "call_pos", "strand", "read_id", "llr", "llr_met", "llr_unmet", "status",
]


def call_status(llr: Column | str, thr: float = 1.0) -> Column:
    """B1: M at or above ``thr``, U at or below ``-thr``, else N."""
    x = col(llr)
    return F.when(x >= thr, "M").when(x <= -thr, "U").otherwise("N")


def singleton_calls(df: DataFrame) -> DataFrame:
    """B2: k-mers holding one motif only."""
    return df.filter(F.col("n_motifs") == 1)


def legacy_c_pos(df: DataFrame) -> DataFrame:
    """Start + 2, one more on the minus strand."""
    return df.withColumn("call_pos", F.col("start") + 2 + F.when(F.col("strand") == "-", 1).otherwise(0))


def realign_c_pos(df: DataFrame) -> DataFrame:
    """Position from the 1-based place of ``M`` in the k-mer (1 when there is none)."""
    p = F.greatest(F.instr("kmer", "M"), F.lit(1))
    return df.withColumn("call_pos", F.col("start") + p - 3).withColumn(
        "target_kmer", F.replace("kmer", F.lit("M"), F.lit("C"))
    )


def to_wide_calls(df: DataFrame) -> DataFrame:
    """Ten-column calls with a 2-bp half-open window around the position."""
    p = F.col("call_pos")
    return df.select(
        "chrom", (p - 1).alias("start"), (p + 1).alias("end"), p.alias("call_pos"), "strand", "read_id",
        "llr", "llr_met", "llr_unmet", "status",
    )


def width_report(df: DataFrame, n: int, value: str = "value", sep: str = "\t") -> DataFrame:
    """Number of text rows and of rows whose field count differs from ``n``."""
    bad = F.size(F.split(value, sep)) != n
    return df.agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_bad"))


def assert_width(df: DataFrame, n: int, value: str = "value", sep: str = "\t") -> DataFrame:
    """Rows unchanged; the job fails on a row with another field count."""
    ok = F.size(F.split(value, sep)) == n
    return df.withColumn(
        value, F.when(ok, F.col(value)).otherwise(F.raise_error(F.lit(f"row does not have {n} fields")))
    )


def shift_interval(df: DataFrame, k: int) -> DataFrame:
    """B7."""
    return df.withColumn("start", F.col("start") + k).withColumn("end", F.col("end") + k)


def slop(df: DataFrame, left: int, right: int, floor: int = 0) -> DataFrame:
    """Extend both ends, the start clamped below."""
    return df.withColumn("start", F.greatest(F.col("start") - left, F.lit(floor))).withColumn(
        "end", F.col("end") + right
    )


def window_at(df: DataFrame, center: str, half: int, floor: int = 0) -> DataFrame:
    """Window of +-half around a centre, the start clamped below."""
    return df.withColumn("start", F.greatest(F.col(center) - half, F.lit(floor))).withColumn(
        "end", F.col(center) + half
    )


def motif_center(df: DataFrame) -> DataFrame:
    """Start + 10 on the minus strand, else start + 8."""
    return df.withColumn("center", F.col("start") + F.when(F.col("strand") == "-", 10).otherwise(8))


def standard_chroms(df: DataFrame, chrom: str = "chrom") -> DataFrame:
    """Chromosomes 1-22 and X."""
    return df.filter(F.col(chrom).rlike(STANDARD_CHROM))


def offset_window(df: DataFrame, offset: int, side: str, width: int = 65) -> DataFrame:
    """``width``-bp window at a strand-aware offset; side 'N' lies upstream on '+'."""
    sign = {"N": -1, "C": 1}[side]
    step = F.when(F.col("strand") == "+", sign * offset).otherwise(-sign * offset)
    half = width // 2
    c = F.col("center") + step
    return df.withColumn("offset_center", c).withColumn("start", F.greatest(c - half, F.lit(0))).withColumn(
        "end", c + half
    )


def summits(df: DataFrame) -> DataFrame:
    """1-bp interval at the midpoint of the ``chr:a-b`` region field."""
    a = F.regexp_extract("region", r":(\d+)-(\d+)$", 1).cast("long")
    b = F.regexp_extract("region", r":(\d+)-(\d+)$", 2).cast("long")
    s = F.floor((a + b) / 2)
    return df.withColumn("start", s - 1).withColumn("end", s)


def motif_id(chrom="m_chrom", start="m_start", end="m_end", strand="m_strand") -> Column:
    """B13."""
    return F.concat_ws("_", chrom, start, end, strand)


def rel_pos(call_pos="call_pos", center="center", strand="m_strand", on_bad: str = "error") -> Column:
    """Offset from the centre, negated on '+'; other strands raise or count as '-'."""
    s = F.col(strand)
    other = {
        "error": F.raise_error(F.concat(F.lit("unexpected strand "), s)).cast("int"),
        "plus": F.lit(1),
    }[on_bad]
    return (F.col(call_pos) - F.col(center)) * F.when(s == "+", -1).when(s == "-", 1).otherwise(other)


def zf_bin(rel: Column | str = "rel_pos") -> Column:
    """3-bp bin; floor division, so -1 falls in bin 5."""
    return (F.floor(col(rel) / BIN_WIDTH) + CENTER_BIN).cast("int")


def pos_bin(rel: Column | str, w: int) -> Column:
    """Left-closed position bin named by its left edge."""
    return (F.floor(col(rel) / w) * w).cast("int")


def pos_bin_rc(rel: Column | str, w: int, W: int) -> Column:
    """Right-closed bin of (-W, W] named by its left edge; null outside."""
    x = col(rel)
    return F.when((x > -W) & (x <= W), F.ceil(x / w) * w - w).cast("int")


def binary_calls(df: DataFrame) -> DataFrame:
    """M/U calls with ``bound`` = 1 for U."""
    return df.filter(F.col("status").isin("M", "U")).withColumn("bound", (F.col("status") == "U").cast("int"))


def flip_strand(df: DataFrame, strand: str = "strand") -> DataFrame:
    """Swap strands; anything else fails the job."""
    s = F.col(strand)
    return df.withColumn(
        strand,
        F.when(s == "+", "-").when(s == "-", "+").otherwise(F.raise_error(F.concat(F.lit("bad strand "), s))),
    )


def neglog10p(p: Column | str) -> Column:
    """-log10 of p clipped to [1e-300, 1]."""
    return -F.log10(F.greatest(F.least(col(p), F.lit(1.0)), F.lit(1e-300))) + F.lit(0.0)


def stars(p: Column | str) -> Column:
    """Significance marks."""
    x = col(p)
    return F.when(x < 1e-4, "****").when(x < 1e-3, "***").when(x < 1e-2, "**").when(x < 0.05, "*").otherwise("")


def curve_keys(df: DataFrame, name: str = "file_name") -> DataFrame:
    """Curve and cycle numbers (two digits), date parts and the compact target name."""
    n = F.col(name)

    def number(word: str) -> Column:
        d = F.regexp_extract(n, word + r" \s*(\d{1,3})", 1)
        return F.when(F.length(d) == 1, F.concat(F.lit("0"), d)).when(d != "", d)

    curve, cycle = number("Curve"), number("Cycle")
    yy, mm, dd = (F.regexp_extract(n, r"(\d\d)_(\d\d)_(\d\d)", i) for i in (1, 2, 3))
    return (
        df.withColumn("curve", curve)
        .withColumn("cycle", cycle)
        .withColumn("date", F.concat_ws("_", yy, mm, dd))
        .withColumn("target", F.concat(dd, mm, yy, F.lit("N"), curve, F.coalesce(cycle, F.lit(""))))
    )


def extension(trap: Column, f1: Column, f2: Column, k1: Column, k2: Column) -> Column:
    """Trap distance minus bead displacements, stiffness given per nm."""
    return trap - f1 / (k1 * 1000.0) - f2 / (k2 * 1000.0)
