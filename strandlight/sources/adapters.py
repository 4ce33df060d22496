"""Genomic and trace views derived by arithmetic from the given star-schema tables.

Only floors of double divisions, ``%`` on non-negative integers and string building: any SQL
engine evaluates them alike, so every operator can be checked on the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlight.functions.calls import motif_id, rel_pos
from strandlight.operators.intervals import overlap_join


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CENTER = "CAST(1000 + floor(p_partkey / 22) * 150 + (p_size % 40) * 4 AS BIGINT)"
_POS = f"({_CENTER} + (l_orderkey * 7 + l_linenumber * 13) % 131 - 65)"
_LLR = "(round(l_discount * 100) - 5)"
_STRAND = "CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END"


def _chrom(key: str) -> str:
    return f"concat('chr', {key} % 22 + 1)"


def _items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    )


def motifs(spark, sf_dir) -> DataFrame:
    """chrom, start, end, strand, seq, center: +-65 windows from part."""
    return table(spark, sf_dir, "part").selectExpr(
        f"{_chrom('p_partkey')} AS chrom", f"{_CENTER} - 65 AS start", f"{_CENTER} + 65 AS end",
        "CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand", "p_brand AS seq", f"{_CENTER} AS center",
    )


def calls(spark, sf_dir) -> DataFrame:
    """Ten-column wide calls from lineitem and part."""
    return _items(spark, sf_dir).selectExpr(
        f"{_chrom('p_partkey')} AS chrom", f"{_POS} - 1 AS start", f"{_POS} + 1 AS end", f"{_POS} AS call_pos",
        f"{_STRAND} AS strand", "concat('r', l_suppkey % 5) AS read_id", f"{_LLR} AS llr",
        "-l_quantity AS llr_met", f"-l_quantity - {_LLR} AS llr_unmet",
        f"CASE WHEN {_LLR} >= 1 THEN 'M' WHEN {_LLR} <= -1 THEN 'U' ELSE 'N' END AS status",
    )


def raw_calls(spark, sf_dir) -> DataFrame:
    """Twelve-field raw calls: k-mers carry M at a varying place, or none."""
    return _items(spark, sf_dir).selectExpr(
        f"{_chrom('p_partkey')} AS chrom", f"{_STRAND} AS strand", f"{_POS} AS start",
        f"{_POS} + l_linenumber % 5 + 4 AS end", "concat('r', l_suppkey % 5) AS read_id", f"{_LLR} AS llr",
        "-l_quantity AS ll_met", "-l_tax AS ll_unmet", "1 AS field9", "CAST(l_orderkey % 3 AS INT) AS n_motifs",
        "'.' AS field11",
        "concat(repeat('A', l_linenumber % 5 + 1), CASE WHEN l_orderkey % 7 = 0 THEN 'GTC' ELSE 'GMTC' END) AS kmer",
    )


def calls_with_motifs(calls_df: DataFrame, motif_df: DataFrame, on_bad: str = "error") -> DataFrame:
    """Calls joined to the motif windows they overlap: the fact input of the binding operators."""
    j = overlap_join(calls_df, motif_df, bin_size=2048, a_max_len=2)
    return j.select(
        motif_id("b_chrom", "b_start", "b_end", "b_strand").alias("motif_id"),
        F.col("a_read_id").alias("read_id"),
        F.col("a_status").alias("status"),
        rel_pos("a_call_pos", "b_center", "b_strand", on_bad).alias("rel_pos"),
        F.col("a_chrom").alias("chrom"),
        F.col("a_call_pos").alias("call_pos"),
        F.col("a_llr").alias("llr"),
        F.col("b_start").alias("m_start"),
        F.col("b_end").alias("m_end"),
        F.col("b_strand").alias("m_strand"),
        F.col("b_center").alias("center"),
    )


def calls_motif(spark, sf_dir) -> DataFrame:
    return calls_with_motifs(calls(spark, sf_dir), motifs(spark, sf_dir))


def peaks(spark, sf_dir) -> DataFrame:
    """1-bp summits per replicate with the best score."""
    rows = _items(spark, sf_dir).selectExpr(
        f"{_chrom('p_partkey')} AS chrom", f"{_CENTER} + l_orderkey % 16 AS summit", "l_returnflag AS replicate",
        "l_quantity",
    )
    return rows.groupBy("chrom", "summit", "replicate").agg(F.max("l_quantity").alias("score")).selectExpr(
        "chrom", "summit - 1 AS start", "summit AS end", "score", "replicate"
    )


def track(spark, sf_dir) -> DataFrame:
    """10-bp signal tiles covering part of the motif range."""
    return table(spark, sf_dir, "orders").selectExpr(
        f"{_chrom('o_orderkey')} AS chrom", "CAST(floor(o_orderkey / 22) * 10 AS BIGINT) AS start",
        "CAST(floor(o_orderkey / 22) * 10 + 10 AS BIGINT) AS end", "o_totalprice / 1000 AS value",
    )


def chrom_sizes(spark, sf_dir) -> DataFrame:
    return track(spark, sf_dir).groupBy("chrom").agg(F.max("end").alias("length"))


def signals(spark, sf_dir) -> DataFrame:
    """Two signal tracks on the motifs, the second with gaps."""
    mid = (
        f"concat_ws('_', {_chrom('p_partkey')}, {_CENTER} - 65, {_CENTER} + 65, "
        "CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END) AS motif_id"
    )
    p = table(spark, sf_dir, "part")
    one = p.selectExpr(mid, "'price' AS track", "p_retailprice % 97 AS signal")
    two = p.filter("p_partkey % 5 <> 0").selectExpr(mid, "'size' AS track", "CAST(p_size AS DOUBLE) AS signal")
    return one.unionByName(two)


def traces(spark, sf_dir) -> DataFrame:
    """condition, trace_id, t (seconds), ev (tie-break), signal from events."""
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(user_id % 4 AS STRING) AS condition", "user_id AS trace_id",
        "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) / 1e6D AS t",
        "event_id AS ev", "value AS signal",
    )


def states(spark, sf_dir) -> DataFrame:
    """Traces with a thresholded state 0..3 in place of a decoded path."""
    return traces(spark, sf_dir).selectExpr(
        "*", "CASE WHEN signal >= 70 THEN 0 WHEN signal >= 35 THEN 1 WHEN signal >= 15 THEN 2 ELSE 3 END AS state"
    )


def matrix(spark, sf_dir) -> DataFrame:
    """Region x bin values in long form with a strand."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("region_id"),
        F.when(F.col("label") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.posexplode("embedding").alias("bin", "value"),
    ).withColumn("value", F.col("value").cast("double"))
