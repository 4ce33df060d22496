"""Readers of trace, fit-history and calibration files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F


def _first_file(spark: SparkSession, root: str) -> str | None:
    """Some file with content below ``root``, found without listing the others; None where there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    above = fs.makeQualified(path).toUri().getPath().rstrip("/")
    files = fs.listFiles(path, True)
    while files.hasNext():
        f = files.next()
        below = f.getPath().toUri().getPath()[len(above):].strip("/").split("/")
        if f.getLen() > 0 and not any(p.startswith(("_", ".")) for p in below):
            return f.getPath().toString()
    return None


def read_traces(spark: SparkSession, root: str, time: str = "time (seconds)", value: str = "force (pN)",
                extra: list[str] | None = None) -> DataFrame:
    """One CSV per trace below a condition path: condition, trace_id, ev, t, signal.

    ``condition`` is the whole path between the root and the file, so equal file names under several
    conditions stay apart; ``trace_id`` is ``condition/file`` and thus unique. ``ev`` grows with the sample's
    place in its file. All files must have the header of the first one, or the read fails.
    """
    def files() -> DataFrameReader:
        return spark.read.option("header", True).option("recursiveFileLookup", True)

    first = _first_file(spark, root)  # listing all files for the header of one would double what the driver gets
    names = files().csv(first or root).columns  # of one file; every other file must have the same header
    schema = ", ".join(f"`{c}` string" for c in names)
    df = files().schema(schema).option("enforceSchema", False).csv(root)
    base = root.rstrip("/").split("://")[-1]
    below = F.element_at(F.split(F.url_decode("_metadata.file_path"), re.escape(base) + "/"), -1)
    # rows of a block number less than its bytes, so the sum grows along a file and across its blocks
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return df.select(
        F.regexp_replace(below, "/?[^/]*$", "").alias("condition"), F.regexp_replace(below, "\\.csv$", "").alias("trace_id"), place.alias("ev"),
        F.col(f"`{time}`").cast("double").alias("t"), F.col(f"`{value}`").cast("double").alias("signal"),
        *[F.col(f"`{c}`").cast("double").alias(c) for c in extra or []],
    )


def read_fit_histories(spark: SparkSession, path: str, max_states: int | None = None) -> DataFrame:
    """Final log-likelihood per K from files (or folders) loglikelihood_<K>_states.csv."""
    df = spark.read.schema("iteration int, log_likelihood double").option("header", True).csv(path)
    k = F.regexp_extract(F.col("_metadata.file_path"), r"loglikelihood_(\d+)_states\.csv(/|$)", 1)
    df = df.select("iteration", "log_likelihood", k.alias("_k")).filter("_k <> ''").withColumn("k", F.col("_k").cast("int"))
    if max_states is not None:
        df = df.filter(F.col("k") <= max_states)
    return df.groupBy("k").agg(F.max_by("log_likelihood", "iteration").alias("log_likelihood"))


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Date, curve, channel (from the file name), stiffness and bead radius."""
    df = spark.read.option("header", True).csv(path)
    ch = F.regexp_extract(F.col("_metadata.file_name"), r"([12][xy])", 1)
    return df.select("date", F.col("curve").cast("long").alias("curve"), ch.alias("channel"),
                     F.col("`kappa (pN/nm)`").cast("double").alias("kappa"), (F.col("`Bead diameter (um)`").cast("double") / 2).alias("radius"))
