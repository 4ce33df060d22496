"""URL verdicts from host rules and a path-template tree per host, in DataFrame operations only.

Fixed rules come first: a rule (host, path) fits its host and all subdomains when the path starts with the
rule's path; the longest wins. For all other URLs the tree decides. Segments lose their variable parts by
shape (digit runs and long hexadecimal runs become ``#``). Then, level by level under each host, segments
of fewer than ``MIN_PAGES`` pages become ``*``, and branches without labels or whose labelled rate does not
differ statistically from that of their siblings merge into ``*`` as well, however large or small. A template is rejected when its purity, the share of
good labelled pages, smoothed towards its host's and the corpus's, is below a share of the corpus's purity.

Levels beyond ``DEPTH`` are one wildcard ``**``. Null URLs and URLs without ``://`` have an empty host and
path and share one template. Without labels nothing is rejected. Repeated labels of a page count as one
(worst value); a page without id gets a verdict but no label. All counts cover all pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlight.session import cut_lineage

# Rules by contract.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
DEPTH = 4
MIN_PAGES = 5  # a segment stays itself from so many pages
MIN_SHARE = 0.01  # of the SQL counterpart only: it also merges smaller shares of the parent's pages
Z = 1.96  # branches within so many standard errors of their siblings merge
WEIGHT = 20.0  # pages that the smoothing counts for
REJECT = 0.5  # share of the corpus's purity below which a template is rejected


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The text and verdict of the longest fitting rule (nulls when none fits)."""
    text = verdict = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # later ones win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, act).otherwise(verdict)
    return text, verdict


def shape(path: Column, depth: int = DEPTH) -> Column:
    """Segments without their variable parts, the rest beyond ``depth`` as one."""
    plain = F.regexp_replace(F.regexp_replace(path, "[0-9A-Fa-f]{16,}", "#"), "[0-9]+", "#")
    segs = F.filter(F.split(plain, "/"), lambda s: s != "")
    return F.when(F.size(segs) > depth, F.concat(F.slice(segs, 1, depth - 1), F.array(F.lit("**")))).otherwise(segs)


def _level(t: DataFrame, k: int) -> DataFrame:
    """Give level k of every path its branch: itself, or ``*``."""
    seg = F.when(F.size("segs") > k, F.get("segs", F.lit(k))).otherwise(F.lit(""))
    t = t.withColumn("seg", seg)
    sums = [F.sum(c).alias(c) for c in ("n", "lab", "good")]
    child = t.groupBy("host", "template", "seg").agg(*sums)
    parent = child.groupBy("host", "template").agg(*[F.sum(c).alias(f"p_{c}") for c in ("n", "lab", "good")])
    c = child.join(parent, ["host", "template"])
    other = F.col("p_lab") - F.col("lab")
    p = F.col("p_good") / F.nullif(F.col("p_lab"), F.lit(0))
    error = F.sqrt(p * (1 - p) * (1 / F.nullif(F.col("lab"), F.lit(0)) + 1 / F.nullif(other, F.lit(0))))
    gap = F.abs(F.col("good") / F.nullif(F.col("lab"), F.lit(0)) - (F.col("p_good") - F.col("good")) / F.nullif(other, F.lit(0)))
    rare = F.col("n") < MIN_PAGES
    differs = F.coalesce(gap > Z * error, F.lit(False))
    branch = F.when(F.col("seg") == "", "").when(F.col("n") == F.col("p_n"), F.col("seg")).when(rare | ~differs, "*").otherwise(F.col("seg"))
    c = c.select("host", "template", "seg", branch.alias("branch"))
    t = t.join(c, ["host", "template", "seg"])
    grown = F.when(F.col("branch") == "", F.col("template")).otherwise(F.concat_ws("/", "template", "branch"))
    return cut_lineage(t.select("host", "segs", "n", "lab", "good", grown.alias("template")), "url-level")


def templates(pages: DataFrame, labels: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, segs) of all pages -> template, smoothed purity and verdict.

    pages: page_id, host, segs; labels: doc_id (a page's id), quality, toxic.
    """
    lab = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x"))
    good = F.when((F.col("q") == 1) & (F.col("x") == 0), 1).otherwise(0)
    t = pages.join(lab, pages["page_id"] == lab["doc_id"], "left").groupBy("host", "segs").agg(
        F.count(F.lit(1)).alias("n"), F.count("q").alias("lab"), F.sum(F.when(F.col("q").isNull(), 0).otherwise(good)).alias("good"))
    t = cut_lineage(t.withColumn("template", F.lit("")), "url-paths")
    for k in range(depth):
        t = _level(t, k)
    whole = t.agg(F.sum("good").alias("good"), F.sum("lab").alias("lab")).first()  # two numbers
    base = F.lit(whole["good"] / whole["lab"] if whole["lab"] else None).cast("double")
    per_host = t.groupBy("host").agg(F.sum("good").alias("h_good"), F.sum("lab").alias("h_lab"))
    per = t.groupBy("host", "template").agg(F.sum("good").alias("t_good"), F.sum("lab").alias("t_lab"))
    host = (F.col("h_good") + WEIGHT * base) / (F.col("h_lab") + WEIGHT)
    purity = (F.col("t_good") + WEIGHT * host) / (F.col("t_lab") + WEIGHT)
    scored = per.join(per_host, "host").select("host", "template", purity.alias("purity"))
    verdict = F.when(F.coalesce(F.col("purity") < REJECT * base, F.lit(False)), "block").otherwise("allow")
    scored = scored.select("host", "template", "purity", verdict.alias("tree"))
    return cut_lineage(t.select("host", "segs", "template").join(scored, ["host", "template"]), "url-templates")


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity."""
    host, path = host_and_path(F.col(url_col))
    p = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    p = p.withColumn("segs", shape(F.col("path")))
    tree = templates(p, labels)
    rule, fixed = rule_of(F.col("host"), F.col("path"), rules)
    return p.join(tree, ["host", "segs"], "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(fixed, "tree").alias("verdict"), "template", F.round("purity", 9).alias("purity"))


def level_sql(k: int) -> str:
    """One level of the tree for DuckDB: from t{k} to t{k + 1}."""
    return f"""
s{k} AS (SELECT *, CASE WHEN len(segs) > {k} THEN segs[{k + 1}] ELSE '' END AS seg FROM t{k}),
c{k} AS (SELECT host, template, seg, sum(n) AS n, sum(lab) AS lab, sum(good) AS good FROM s{k} GROUP BY ALL),
p{k} AS (SELECT host, template, sum(n) AS p_n, sum(lab) AS p_lab, sum(good) AS p_good FROM c{k} GROUP BY ALL),
b{k} AS (SELECT host, template, seg, CASE WHEN seg = '' THEN '' WHEN n = p_n THEN seg
  WHEN n < {MIN_PAGES} OR n < {MIN_SHARE} * p_n OR NOT coalesce(
    abs(good / nullif(lab, 0) - (p_good - good) / nullif(p_lab - lab, 0))
      > {Z} * sqrt(p_good / nullif(p_lab, 0) * (1 - p_good / nullif(p_lab, 0)) * (1 / nullif(lab, 0) + 1 / nullif(p_lab - lab, 0))), false)
  THEN '*' ELSE seg END AS branch FROM c{k} JOIN p{k} USING (host, template)),
t{k + 1} AS (SELECT host, segs, n, lab, good, CASE WHEN branch = '' THEN template ELSE template || '/' || branch END AS template
  FROM s{k} JOIN b{k} USING (host, template, seg))"""


def oracle() -> str:
    fits = "(u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)"
    values = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
    return f"""
WITH u0 AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
u1 AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u0),
u2 AS (SELECT *, list_filter(string_split(regexp_replace(regexp_replace(path, '[0-9A-Fa-f]{{16,}}', '#', 'g'), '[0-9]+', '#', 'g'), '/'), lambda s: s <> '') AS g FROM u1),
u AS (SELECT *, CASE WHEN len(g) > {DEPTH} THEN list_append(g[1:{DEPTH - 1}], '**') ELSE g END AS segs FROM u2),
l AS (SELECT doc_id, min(quality) AS q, max(coalesce(toxic, 0)) AS x FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
t0 AS (SELECT host, segs, count(*) AS n, count(q) AS lab, sum(CASE WHEN q = 1 AND x = 0 THEN 1 ELSE 0 END) AS good, '' AS template
  FROM u LEFT JOIN l ON l.doc_id = u.page_id GROUP BY host, segs),
{",".join(level_sql(k) for k in range(DEPTH))},
w AS (SELECT sum(good) / nullif(sum(lab), 0) AS base FROM t{DEPTH}),
h AS (SELECT host, sum(good) AS h_good, sum(lab) AS h_lab FROM t{DEPTH} GROUP BY host),
per AS (SELECT host, template, (sum(good) + {WEIGHT} * (any_value(h_good) + {WEIGHT} * any_value(base)) / (any_value(h_lab) + {WEIGHT})) / (sum(lab) + {WEIGHT}) AS purity, any_value(base) AS base
  FROM t{DEPTH} JOIN h USING (host), w GROUP BY host, template),
r AS (SELECT * FROM (VALUES {values}) v(act, h, p)),
best AS (SELECT page_id, host, path, max_by(struct_pack(act := r.act, txt := r.h || r.p), length(r.h || r.p)) AS b FROM (SELECT DISTINCT page_id, host, path FROM u) u JOIN r ON {fits} GROUP BY ALL)
SELECT u.page_id, u.host, u.path, best.b.txt AS rule, coalesce(best.b.act, CASE WHEN coalesce(per.purity < {REJECT} * per.base, false) THEN 'block' ELSE 'allow' END) AS verdict,
  per.template, round(per.purity, 9) AS purity
FROM u LEFT JOIN t{DEPTH} t ON t.host = u.host AND t.segs = u.segs LEFT JOIN per ON per.host = t.host AND per.template = t.template
LEFT JOIN best ON best.page_id IS NOT DISTINCT FROM u.page_id AND best.host = u.host AND best.path = u.path
"""
