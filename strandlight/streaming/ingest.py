"""L1: the calls -> binding input step as a Structured Streaming job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from strandlight.functions import calls as fc
from strandlight.operators.intervals import overlap_join
from strandlight.sources.genome import RAW_SCHEMA


def wide_from_raw(raw: DataFrame) -> DataFrame:
    """Single-motif filter, status, realigned position, ten wide columns: one narrow stage."""
    c = fc.realign_c_pos(fc.singleton_calls(raw)).withColumn("status", fc.call_status("llr"))
    return fc.to_wide_calls(c.withColumnsRenamed({"ll_met": "llr_met", "ll_unmet": "llr_unmet"}))


def read_raw_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(RAW_SCHEMA).option("sep", "\t").option("header", True).csv(folder)


def calls_to_motifs_stream(raw: DataFrame, motifs: DataFrame) -> DataFrame:
    """Stateless: each micro-batch joins the static motif table; works on batch frames alike."""
    j = overlap_join(wide_from_raw(raw), motifs, a_max_len=2)
    return j.select(
        fc.motif_id("b_chrom", "b_start", "b_end", "b_strand").alias("motif_id"), F.col("a_read_id").alias("read_id"),
        F.col("a_status").alias("status"), fc.rel_pos("a_call_pos", "b_center", "b_strand").alias("rel_pos"),
        F.col("a_chrom").alias("chrom"), F.col("a_call_pos").alias("call_pos"))


def append_to(cm: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append-mode Parquet sink; the checkpoint belongs in a shared folder."""
    return cm.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
