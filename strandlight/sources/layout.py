"""The call table stored by position bin, so overlap joins leave it where it lies.

Calls are written once, bucketed by (chrom, bin) and sorted by position inside a bucket. A join with a motif table
then moves only the motif side, or nothing when that side has the same layout. Buckets cannot be split by the
engine at run time, so bins with more than ``hot_rows`` calls are kept in an ordinary table beside the buckets and
take the usual overlap join, where adaptive execution splits them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlight.operators.intervals import LEFT, RIGHT, overlap_join
from strandlight.session import broadcast_if_small, is_small, scratch_path

HOT_ROWS = 5_000_000  # calls of one bin from which it does not go into a bucket


@dataclass(frozen=True)
class CallLayout:
    """Where a call table lies: the bucketed table, the path of its hot bins (None without any) and its measures."""

    table: str
    hot: str | None
    buckets: int
    bin_size: int
    max_len: int


def _bucketed(df: DataFrame, buckets: int, path: str, sort: list[str]) -> str:
    name = f"strandlight_{uuid.uuid4().hex}"
    # one task a bucket, so a bucket is one file
    (df.repartition(buckets, "chrom", "bin").write.bucketBy(buckets, "chrom", "bin").sortBy("chrom", "bin", *sort)
     .option("path", path).format("parquet").saveAsTable(name))
    return name


def write_calls(calls: DataFrame, buckets: int, bin_size: int = 2048, max_len: int = 2, hot_rows: int = HOT_ROWS) -> CallLayout:
    """Store ``calls`` (chrom, start, end, call_pos, ...) by (chrom, bin of the start); ``bin`` joins the schema.

    A call longer than ``max_len``, or with a position further than that from its start, fails the write. Calls
    without a chromosome, start or end overlap nothing and are not stored; an empty table gives an empty layout.
    ``buckets`` should leave a few hundred megabytes a bucket.
    """
    spark = calls.sparkSession
    near = F.coalesce(F.abs(F.col("call_pos") - F.col("start")) <= max_len, F.lit(True))
    where = F.when((F.col("end") - F.col("start") <= max_len) & near, F.floor(F.col("start") / bin_size)).otherwise(
        F.raise_error(F.lit(f"interval longer than {max_len}, or its position that far away")).cast("long"))
    rows = calls.filter("chrom IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL").withColumn("bin", where)
    dense = rows.groupBy("chrom", "bin").count().filter(F.col("count") > hot_rows).select("chrom", "bin")
    hot = None
    if not dense.isEmpty():
        hot = scratch_path(spark, "hot-calls")
        dense.write.parquet(hot + "-bins")
        dense = broadcast_if_small(spark.read.parquet(hot + "-bins"))
        rows.join(dense, ["chrom", "bin"], "left_semi").write.parquet(hot)
        rows = rows.join(dense, ["chrom", "bin"], "left_anti")
    return CallLayout(_bucketed(rows, buckets, scratch_path(spark, "calls"), ["call_pos"]), hot, buckets, bin_size, max_len)


def _spread(motifs: DataFrame, lay: CallLayout) -> DataFrame:
    """A motif once per bin whose calls can touch it; a motif without an extent touches none."""
    lo = F.floor((F.col("start") - lay.max_len) / lay.bin_size)
    hi = F.greatest(F.floor((F.col("end") - 1) / lay.bin_size), lo)
    return motifs.withColumn("bin", F.explode(F.sequence(lo, hi)))


def write_motifs(motifs: DataFrame, lay: CallLayout) -> str:
    """Store motifs in the layout of the calls: a table for ``overlap`` whose join then moves neither side."""
    return _bucketed(_spread(motifs, lay), lay.buckets, scratch_path(motifs.sparkSession, "motifs"), ["start"])


def overlap(spark: SparkSession, lay: CallLayout, motifs: DataFrame | str) -> DataFrame:
    """C1 on a stored call table; ``motifs`` is a motif table or the name that ``write_motifs`` gave.

    The same rows and prefixed columns as ``overlap_join``. A motif table is broadcast behind a row check;
    beyond it only the motifs are shuffled, to the buckets of the calls.
    """
    stored = isinstance(motifs, str)
    wide = spark.table(motifs) if stored else _spread(motifs, lay)
    a = spark.table(lay.table)
    A = a.select(*[F.col(c).alias(LEFT + c) for c in a.columns])
    B = wide.select(*[F.col(c).alias(RIGHT + c) for c in wide.columns])
    B = F.broadcast(B) if not stored and is_small(B) else B.hint("merge")
    hit = (F.col("a_chrom") == F.col("b_chrom")) & (F.col("a_bin") == F.col("b_bin"))
    hit = hit & (F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start"))
    out = A.join(B, hit).drop("a_bin", "b_bin")
    if lay.hot is None:
        return out
    first = F.floor((F.col("start") - lay.max_len) / lay.bin_size)
    plain = wide.filter(F.col("bin") == first).drop("bin") if stored else motifs  # each motif as often as it was given
    rest = overlap_join(spark.read.parquet(lay.hot).drop("bin"), plain, bin_size=lay.bin_size, a_max_len=lay.max_len)
    return out.unionByName(rest)


def region(spark: SparkSession, lay: CallLayout, chrom: str, lo: int, hi: int) -> DataFrame:
    """A20 on a stored call table: calls of one locus. The bin bounds reach the row groups of the sorted buckets."""
    def part(df: DataFrame) -> DataFrame:
        near = F.col("bin").between((lo - lay.max_len) // lay.bin_size, (hi + lay.max_len) // lay.bin_size)
        return df.filter((F.col("chrom") == chrom) & near & F.col("call_pos").between(lo, hi)).drop("bin")

    out = part(spark.table(lay.table))
    return out if lay.hot is None else out.unionByName(part(spark.read.parquet(lay.hot)))
