"""SQL texts that define the adapter views and shared sub-results for the correctness check."""

from __future__ import annotations

_CENTER = "(1000 + CAST(floor(p_partkey / 22) AS BIGINT) * 150 + (p_size % 40) * 4)"
_POS = f"({_CENTER} + (l_orderkey * 7 + l_linenumber * 13) % 131 - 65)"
_LLR = "(round(l_discount * 100) - 5)"

CTE: dict[str, tuple[list[str], str]] = {
    "motifs": ([], f"""
        SELECT 'chr' || (p_partkey % 22 + 1) AS chrom, {_CENTER} - 65 AS "start", {_CENTER} + 65 AS "end",
               CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, p_brand AS seq,
               {_CENTER} AS center, p_partkey
        FROM part"""),
    "calls": ([], f"""
        SELECT 'chr' || (p_partkey % 22 + 1) AS chrom, {_POS} - 1 AS "start", {_POS} + 1 AS "end",
               {_POS} AS call_pos, CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS strand,
               'r' || (l_suppkey % 5) AS read_id, {_LLR} AS llr, -l_quantity AS llr_met,
               -l_quantity - {_LLR} AS llr_unmet,
               CASE WHEN {_LLR} >= 1 THEN 'M' WHEN {_LLR} <= -1 THEN 'U' ELSE 'N' END AS status
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "raw": ([], f"""
        SELECT 'chr' || (p_partkey % 22 + 1) AS chrom,
               CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS strand,
               {_POS} AS "start", {_POS} + l_linenumber % 5 + 4 AS "end", 'r' || (l_suppkey % 5) AS read_id,
               {_LLR} AS llr, -l_quantity AS ll_met, -l_tax AS ll_unmet, 1 AS field9,
               CAST(l_orderkey % 3 AS INTEGER) AS n_motifs, '.' AS field11,
               repeat('A', l_linenumber % 5 + 1) || CASE WHEN l_orderkey % 7 = 0 THEN 'GTC' ELSE 'GMTC' END AS kmer
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "cm": (["motifs", "calls"], """
        SELECT m.chrom || '_' || m."start" || '_' || m."end" || '_' || m.strand AS motif_id, c.read_id, c.status,
               (c.call_pos - m.center) * CASE WHEN m.strand = '+' THEN -1 ELSE 1 END AS rel_pos,
               c.chrom, c.call_pos, c.llr, m."start" AS m_start, m."end" AS m_end, m.strand AS m_strand, m.center
        FROM calls c JOIN motifs m ON c.chrom = m.chrom AND c."start" < m."end" AND c."end" > m."start" """),
    "mu": (["cm"], """
        SELECT *, 6 + CAST(floor(rel_pos / 3) AS BIGINT) AS zf, CASE WHEN status = 'U' THEN 1 ELSE 0 END AS is_u
        FROM cm WHERE status IN ('M', 'U')"""),
    "b": (["mu"], """
        SELECT motif_id, read_id, zf, max(is_u) AS bound, count(*) AS n_calls
        FROM mu WHERE zf BETWEEN 1 AND 11 GROUP BY ALL"""),
    "psum": (["b"], """
        SELECT motif_id, read_id, sum(bound) AS n_bound, count(*) AS n_measured FROM b GROUP BY ALL"""),
    "ndr": (["mu"], """
        SELECT motif_id, read_id, 0 AS zf, max(is_u) AS bound, count(*) AS n_calls FROM mu
        WHERE rel_pos BETWEEN -60 AND -20 GROUP BY motif_id, read_id
        UNION ALL
        SELECT motif_id, read_id, 12 AS zf, max(is_u) AS bound, count(*) AS n_calls FROM mu
        WHERE rel_pos BETWEEN 20 AND 60 GROUP BY motif_id, read_id"""),
    # nucleosome-like sides, windows 20..60 and 40..60
    "nuc20": (["mu"], """
        SELECT motif_id, read_id, 'up' AS side FROM mu WHERE rel_pos BETWEEN -60 AND -20
        GROUP BY motif_id, read_id HAVING min(is_u) = 1
        UNION ALL
        SELECT motif_id, read_id, 'down' AS side FROM mu WHERE rel_pos BETWEEN 20 AND 60
        GROUP BY motif_id, read_id HAVING min(is_u) = 1"""),
    "nuc40": (["mu"], """
        SELECT motif_id, read_id, 'up' AS side FROM mu WHERE rel_pos BETWEEN -60 AND -40
        GROUP BY motif_id, read_id HAVING min(is_u) = 1
        UNION ALL
        SELECT motif_id, read_id, 'down' AS side FROM mu WHERE rel_pos BETWEEN 40 AND 60
        GROUP BY motif_id, read_id HAVING min(is_u) = 1"""),
    # snapshots of the binding-probability recipe: >=1 bound core bin, exclusion 20..60
    "total": (["b", "psum"], """
        SELECT b.* FROM b JOIN psum USING (motif_id, read_id) WHERE n_bound >= 1"""),
    "kept": (["total", "nuc20"], """
        SELECT t.* FROM total t ANTI JOIN nuc20 n USING (motif_id, read_id)"""),
    "ndrkept": (["ndr", "nuc20"], """
        SELECT t.* FROM ndr t ANTI JOIN nuc20 n USING (motif_id, read_id)"""),
    "fin": (["kept", "ndrkept"], """
        SELECT motif_id, read_id, zf, bound FROM kept UNION ALL
        SELECT motif_id, read_id, zf, bound FROM ndrkept"""),
    "bp": (["fin", "total"], """
        SELECT motif_id, zf, coalesce(num, 0) AS num_bound_kept, coalesce(den, 0) AS den_kept,
               coalesce(dt, 0) AS den_total, num / nullif(den, 0) AS binding_prob
        FROM (SELECT motif_id, zf, CAST(sum(bound) AS BIGINT) AS num, count(*) AS den FROM fin GROUP BY ALL)
        FULL JOIN (SELECT motif_id, zf, count(DISTINCT read_id) AS dt FROM total GROUP BY ALL)
        USING (motif_id, zf)"""),
    "peaks": ([], f"""
        SELECT 'chr' || (p_partkey % 22 + 1) AS chrom, {_CENTER} + l_orderkey % 16 - 1 AS "start",
               {_CENTER} + l_orderkey % 16 AS "end", max(l_quantity) AS score, l_returnflag AS replicate
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"""),
    "track": ([], """
        SELECT 'chr' || (o_orderkey % 22 + 1) AS chrom, CAST(floor(o_orderkey / 22) AS BIGINT) * 10 AS "start",
               CAST(floor(o_orderkey / 22) AS BIGINT) * 10 + 10 AS "end", o_totalprice / 1000 AS value
        FROM orders"""),
    "sizes": (["track"], """SELECT chrom, max("end") AS length FROM track GROUP BY chrom"""),
    "signals": (["motifs"], """
        SELECT m.chrom || '_' || m."start" || '_' || m."end" || '_' || m.strand AS motif_id, 'price' AS track,
               p_retailprice % 97 AS signal
        FROM motifs m JOIN part USING (p_partkey)
        UNION ALL
        SELECT m.chrom || '_' || m."start" || '_' || m."end" || '_' || m.strand, 'size', CAST(p_size AS DOUBLE)
        FROM motifs m JOIN part USING (p_partkey) WHERE p_partkey % 5 <> 0"""),
    "traces": ([], """
        SELECT CAST(user_id % 4 AS VARCHAR) AS condition, user_id AS trace_id,
               date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS t, event_id AS ev, value AS signal
        FROM events"""),
    "states": (["traces"], """
        SELECT *, CASE WHEN signal >= 70 THEN 0 WHEN signal >= 35 THEN 1 WHEN signal >= 15 THEN 2 ELSE 3 END AS state
        FROM traces"""),
    "mat": ([], """
        SELECT vec_id AS region_id, CASE WHEN label % 2 = 0 THEN '+' ELSE '-' END AS strand,
               i - 1 AS bin, CAST(embedding[i] AS DOUBLE) AS value
        FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"""),
}


def _need(names: list[str], seen: list[str]) -> list[str]:
    for n in names:
        if n not in seen:
            _need(CTE[n][0], seen)
            seen.append(n)
    return seen


def sql(body: str, *names: str, **extra: str) -> str:
    """``body`` behind the named views and their dependencies; ``extra`` adds local views."""
    parts = [f"{n} AS ({CTE[n][1]})" for n in _need(list(names), [])]
    parts += [f"{n} AS ({t})" for n, t in extra.items()]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
