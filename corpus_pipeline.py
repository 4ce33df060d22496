"""From documents to training sequences.

Stages, in order: language identification (documents without a language go), n-gram Jaccard join (one
document of each group of near copies stays, the one of the smallest id), benchmark decontamination (the
words of benchmark phrases are cut out), personal data (each span becomes its kind in brackets), packing.

All but the last return the columns of documents. Null texts have no language and go in the first stage;
an empty table passes through all stages; rows with a null id are kept by every stage but cannot be
matched with others; repeated rows of one id stay once after the second stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlight.llm import fm_decontam, jaccard_metric, lang_cnn, pack_bounded, pii_semicrf
from strandlight.llm.common import crc_mod, free_name, prepare, table
from strandlight.session import cut_lineage, scratch

VOCABULARY = "byte_bpe_50k.json"
NEAR_WIDTH = 5  # words of a shingle of the second stage
NEAR_THRESHOLD = (4, 5)  # similarity from which it links documents


def _with_text(docs: DataFrame, text) -> DataFrame:
    """docs with another text and the length that goes with it."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    net = lang_cnn.train(docs, F.coalesce(crc_mod("doc_id", 5) != 0, F.lit(False)))
    p = free_name(docs, "_p")
    seen = docs.withColumn(p, lang_cnn.language_column(F.col("text"), net))
    return seen.filter(F.col(p)["lang"] != "und").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    groups = jaccard_metric.join(docs.select("doc_id", "text"), width=NEAR_WIDTH, threshold=NEAR_THRESHOLD)
    keep = groups.filter("component_id = doc_id").select("doc_id").distinct()
    one = docs.join(keep, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return one.union(docs.filter("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    h = free_name(docs, "_hits")
    seen = fm_decontam.find_hits(spark, docs, table(spark, sf_dir, "benchmark"), out=h)
    cut = fm_decontam.remove_column(F.col("text"), F.col(h))
    return _with_text(seen, cut).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    w = pii_semicrf.train(docs)
    p = free_name(docs, "_p")
    seen = docs.withColumn(p, pii_semicrf.spans_column(F.col("text"), w))
    masked = pii_semicrf.masked_column(F.col("text"), F.concat(F.col(p)["base"], F.col(p)["added"]))
    return _with_text(seen, masked).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pack_bounded.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("pack", pack),
]

# Trained models and tokenizers are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again; what a stage wrote on its way goes with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}", outer=True)
    return docs
