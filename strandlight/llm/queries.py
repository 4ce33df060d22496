"""The queries opN_<name> over the given tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlight.llm import embed_ego, fm_decontam, jaccard_metric, lang_cnn, lattice_lm, license_rules, pack_bounded, pii_semicrf, slot_negatives, suffix_dedup, toxic_crf, url_templates, whiten_charpoly
from strandlight.llm.common import crc_mod, prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return fn

    return wrap


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = lang_cnn.train(docs, crc_mod("doc_id", 5) != 0)
    p = lang_cnn.language_column(F.col("text"), net)
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    out = docs.select("doc_id", held.alias("held_out"), p.alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[k : k + 9], ' ') AS x
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT size FROM p),
h AS (SELECT doc_id, k, d.size, item FROM (SELECT doc_id, k, size, array_to_string(w[k : k + size - 1], ' ') AS x
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, s)) d JOIN p ON p.x = d.x AND p.size = d.size),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS pos FROM (SELECT DISTINCT doc_id, k, size FROM h)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
"""


@query("op6_decontaminate", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    h = fm_decontam.find_hits(spark, docs.select("doc_id", "text"), items)
    return h.select(
        "doc_id",
        F.col("_hits.n_words").alias("n_words"),
        F.col("_hits.n_hit").alias("n_hit"),
        F.size("_hits.items").cast("long").alias("n_items"),
        fm_decontam.digest(F.col("_hits.items")).alias("items_sha256"),
        (F.col("_hits.n_hit") > 0).alias("contaminated"),
    )


@query("op9_pack")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_bounded.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    w = pii_semicrf.train(docs)
    out = docs.select("doc_id", pii_semicrf.spans_column(F.col("text"), w).alias("p"))
    kinds = F.transform("p.base", lambda x: x["kind"])
    count = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in pii_semicrf.KINDS]
    return out.select(
        "doc_id", *count,
        F.sha2(pii_semicrf.in_order(F.col("p.base")), 256).alias("base_sha256"),
        pii_semicrf.in_order(F.concat("p.base", "p.added")).alias("spans"),
        F.size("p.added").cast("long").alias("n_added"),
    )


OP4_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT i.a, i.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL) i
  JOIN n u ON u.doc_id = i.a JOIN n v ON v.doc_id = i.b WHERE 100 * c >= 90 * (u.n + v.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT r.a AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""


@query("op4_jaccard_join", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_metric.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP1_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
g AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, g.component_id, v.vec_id = g.component_id AS kept
FROM embeddings v JOIN g ON g.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""


@query("op1_embedding_links", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_ego.join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


@query("op8_lattice_score")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lattice_lm.score(docs, crc_mod("doc_id", 10) == 0, public_tokenizers.path("piece_bpe_32k.model"))


@query("op5_url_templates", url_templates.oracle())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_templates.judge(pages, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


@query("op3_license_rules", license_rules.oracle())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op11_toxic_spans")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = toxic_crf.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), crc_mod("doc_id", 5) != 0)
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return toxic_crf.detect(docs, field).select(
        "doc_id",
        F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("spans").cast("long").alias("n_spans"),
        spans.alias("spans"),
    )


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten_charpoly.whitening(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select(
        "vec_id", "component", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "whitened", "explained", "identity_error")


OP13_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 3
"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return slot_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=label)
