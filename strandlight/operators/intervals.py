"""Interval joins and neighbour filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlight.ordered import chunk_by, value_chunks, with_neighbors, with_running
from strandlight.session import broadcast_if_small, cut_lineage

LEFT, RIGHT = "a_", "b_"


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def _bins(start: Column, end: Column, size: int) -> Column:
    """Position bins touched by [start, end); empty intervals touch the bin of their start."""
    lo = F.floor(start / size)
    return F.sequence(lo, F.greatest(F.floor((end - 1) / size), lo))


def overlap_join(
    a: DataFrame,
    b: DataFrame,
    bin_size: int = 2048,
    how: str = "inner",
    a_max_len: int | None = None,
    chrom: str = "chrom",
) -> DataFrame:
    """Pairs with ``a.start < b.end AND a.end > b.start``; columns prefixed a_ / b_.

    Both sides are keyed by (chrom, position bin), so no chromosome is compared as a whole.
    When ``a`` is the large side and no interval exceeds ``a_max_len``, each ``a`` row keeps
    one bin (that of its start) and only ``b`` is expanded; a longer ``a`` row fails the job.
    Otherwise both sides expand and a pair is emitted in the bin of the later start only.
    ``b`` is broadcast behind a row check; beyond it the join shuffles on (chrom, bin), where
    AQE splits a hot bin.
    """
    A, B = _prefixed(a, LEFT), _prefixed(b, RIGHT)
    a_s, a_e, b_s, b_e = (F.col(x) for x in ("a_start", "a_end", "b_start", "b_end"))
    hit = (a_s < b_e) & (a_e > b_s)
    same = F.col(f"a_{chrom}") == F.col(f"b_{chrom}")
    if a_max_len is not None:
        guarded = F.when(a_e - a_s <= a_max_len, F.floor(a_s / bin_size)).otherwise(
            F.raise_error(F.lit(f"interval longer than {a_max_len}")).cast("long")
        )
        A = A.withColumn("a__bin", guarded)
        B = B.withColumn("b__bin", F.explode(_bins(b_s - a_max_len, b_e, bin_size)))
        cond = same & (F.col("a__bin") == F.col("b__bin")) & hit
    else:
        A = A.withColumn("a__bin", F.explode(_bins(a_s, a_e, bin_size)))
        B = B.withColumn("b__bin", F.explode(_bins(b_s, b_e, bin_size)))
        owner = F.floor(F.greatest(a_s, b_s) / bin_size)
        cond = same & (F.col("a__bin") == F.col("b__bin")) & hit & (F.col("a__bin") == owner)
    if how != "inner":
        raise ValueError("use overlap_map / overlap_semi for other join kinds")
    if not a.isStreaming:
        B = broadcast_if_small(B)
    return A.join(B, cond).drop("a__bin", "b__bin")


def _a_only(joined: DataFrame, a: DataFrame) -> DataFrame:
    return joined.select(*[F.col(LEFT + c).alias(c) for c in a.columns])


def overlap_a(a: DataFrame, b: DataFrame, dedup: bool = False, **kw) -> DataFrame:
    """``a`` rows once per overlapping ``b`` row (``dedup`` gives distinct rows)."""
    out = _a_only(overlap_join(a, b.select("chrom", "start", "end"), **kw), a)
    return out.distinct() if dedup else out


def overlap_semi(a: DataFrame, b: DataFrame, bin_size: int = 2048, a_max_len: int | None = None) -> DataFrame:
    """``a`` rows that touch any ``b`` row, each once.

    With a length bound ``a`` keeps a single bin, so a plain left-semi join is exact and ``a`` is never
    regrouped. Without one, rows of ``a`` are looked up in every bin they touch and then kept once, so
    one long row does not widen the bins of all others.
    """
    B = _prefixed(b.select("chrom", "start", "end").distinct(), RIGHT)
    cond = (
        (F.col("chrom") == F.col("b_chrom"))
        & (F.col("_bin") == F.col("b__bin"))
        & (F.col("start") < F.col("b_end"))
        & (F.col("end") > F.col("b_start"))
    )
    if a_max_len is None:
        B = B.withColumn("b__bin", F.explode(_bins(F.col("b_start"), F.col("b_end"), bin_size)))
        A = a.withColumn("_row", F.monotonically_increasing_id()).withColumn("_bin", F.explode(_bins(F.col("start"), F.col("end"), bin_size)))
        return A.join(broadcast_if_small(B), cond, "left_semi").dropDuplicates(["_row"]).select(*a.columns)
    size = max(bin_size, 1 << (a_max_len - 1).bit_length())
    B = B.withColumn("b__bin", F.explode(_bins(F.col("b_start") - a_max_len, F.col("b_end"), size)))
    A = a.withColumn("_bin", F.floor(F.col("start") / size))
    return A.join(broadcast_if_small(B), cond, "left_semi").drop("_bin")


def overlap_map(
    a: DataFrame, b: DataFrame, aggs: dict[str, Column], bin_size: int = 2048, a_max_len: int | None = None
) -> DataFrame:
    """Every ``a`` row with aggregates over the ``b`` rows it overlaps, null when none.

    One left join and one aggregate by row number: ``a`` is read once.

    ``aggs`` maps output names to aggregate expressions over ``b_``-prefixed columns.
    """
    A = _prefixed(a, LEFT).withColumn("_row", F.monotonically_increasing_id())
    B = _prefixed(b, RIGHT)
    a_s, a_e, b_s, b_e = (F.col(x) for x in ("a_start", "a_end", "b_start", "b_end"))
    cond = (F.col("a_chrom") == F.col("b_chrom")) & (F.col("a__bin") == F.col("b__bin")) & (a_s < b_e) & (a_e > b_s)
    if a_max_len is None:  # a pair meets in the bin of the later start only
        A = A.withColumn("a__bin", F.explode(_bins(a_s, a_e, bin_size)))
        B = B.withColumn("b__bin", F.explode(_bins(b_s, b_e, bin_size)))
        cond = cond & (F.col("a__bin") == F.floor(F.greatest(a_s, b_s) / bin_size))
    else:
        long = F.raise_error(F.lit(f"interval longer than {a_max_len}")).cast("long")
        A = A.withColumn("a__bin", F.when(a_e - a_s <= a_max_len, F.floor(a_s / bin_size)).otherwise(long))
        B = B.withColumn("b__bin", F.explode(_bins(b_s - a_max_len, b_e, bin_size)))
    rows = A.join(broadcast_if_small(B), cond, "left").groupBy("_row", *[LEFT + c for c in a.columns])
    met = F.count("b_chrom") > 0
    return rows.agg(*[F.when(met, e).alias(n) for n, e in aggs.items()]).select(
        *[F.col(LEFT + c).alias(c) for c in a.columns], *aggs)


def multi_depth(
    beds: DataFrame, min_k: int, label: str = "replicate", chunk_bp: int = 1 << 18, rows: int = 1_000_000
) -> DataFrame:
    """C4: elementary segments covered by at least ``min_k`` labels, with the count ``depth``.

    The intervals are written once. Their endpoints move once, by chunk of the chromosome, to as many partitions as
    leave about ``rows`` of them in a task whatever the size of the input; there they become one row per (chrom, pos)
    and are summed in order. What crosses a chunk travels in one summary row. The labels are file names: a short list.
    """
    beds = cut_lineage(beds.select("chrom", "start", "end", label), "intervals")
    counts = beds.groupBy(label).count().collect()
    labels = sorted(r[0] for r in counts)
    n = max(1, -(-2 * sum(r["count"] for r in counts) // rows))
    end = lambda c, d: F.struct(F.col(c).alias("pos"), F.lit(d).alias("d"))
    ends = beds.select("chrom", label, F.explode(F.array(end("start", 1), end("end", -1))).alias("e")).select("chrom", label, "e.*")
    pts = chunk_by(ends, "pos", chunk_bp).repartition(n, "chrom", "_chunk").groupBy("chrom", "_chunk", "pos").agg(
        *[F.sum(F.when(F.col(label) == v, F.col("d")).otherwise(0)).alias(f"d{i}") for i, v in enumerate(labels)]
    )
    per = pts.groupBy("chrom", "_chunk").agg(F.min("pos").alias("first"), *[F.sum(f"d{i}").alias(f"s{i}") for i in range(len(labels))])
    outer = Window.partitionBy("chrom").orderBy("_chunk")
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "chrom", "_chunk", F.lead("first").over(outer).alias("beyond"),
        *[F.coalesce(F.sum(f"s{i}").over(before), F.lit(0)).alias(f"o{i}") for i in range(len(labels))])
    inner = Window.partitionBy("chrom", "_chunk").orderBy("pos")
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    run = pts.select(
        "chrom", "_chunk", "pos", F.lead("pos").over(inner).alias("next"), *[F.sum(f"d{i}").over(upto).alias(f"c{i}") for i in range(len(labels))])
    depth = sum((F.col(f"c{i}") + F.col(f"o{i}") > 0).cast("int") for i in range(len(labels))) if labels else F.lit(0)
    seg = run.join(per, ["chrom", "_chunk"]).select(
        "chrom", F.col("pos").alias("start"), F.coalesce("next", "beyond").alias("end"), depth.alias("depth"))
    return seg.filter((F.col("depth") >= min_k) & F.col("end").isNotNull())


def drop_close(df: DataFrame, gap: int = 36, chrom: str = "chrom", center: str = "center",
               chunk_bp: int = 1 << 22) -> DataFrame:
    """Rows whose distance to both neighbouring centres is at least ``gap``."""
    order = [center] + [c for c in df.columns if c not in (chrom, center)]
    d = chunk_by(df, center, chunk_bp)
    d = with_neighbors(d, [chrom], order, prev={"_pc": center}, next={"_nc": center})
    far = (F.coalesce(F.col(center) - F.col("_pc"), F.lit(gap)) >= gap) & (
        F.coalesce(F.col("_nc") - F.col(center), F.lit(gap)) >= gap
    )
    return d.filter(far).select(*df.columns)


def territories(motifs: DataFrame, tol: int, last_by: str) -> DataFrame:
    """Positions nearest to each distinct centre: [lo, hi], ties to the lower centre."""
    order = F.struct(*[F.col(c) for c in [last_by] + [c for c in motifs.columns if c != last_by]])
    row = F.struct(*[F.col(c) for c in motifs.columns])
    uniq = motifs.groupBy("chrom", "center").agg(F.max_by(row, order).alias("m")).select("m.*")
    t = with_neighbors(
        chunk_by(uniq, "center", 1 << 22), ["chrom"], ["center"], prev={"_p": "center"}, next={"_n": "center"}
    ).drop("_chunk")
    c = F.col("center")
    lo = F.floor((F.col("_p") + c) / 2) + 1
    hi = F.floor((c + F.col("_n")) / 2)
    if tol > 0:
        lo = F.greatest(F.coalesce(lo, c - tol), c - tol)
        hi = F.least(F.coalesce(hi, c + tol), c + tol)
    return t.withColumn("t_lo", lo).withColumn("t_hi", hi).drop("_p", "_n")


def nearest_join(
    calls: DataFrame, motifs: DataFrame, tol: int = 0, last_by: str = "start", bin_size: int | None = None
) -> DataFrame:
    """C11: each call with its nearest motif centre on the chromosome (inner).

    Centres are turned into disjoint territories once, on the small side, so a call meets at
    most one row per bin and never needs a group of its own. ``tol <= 0`` means no limit: the
    first and last territory of a chromosome are then open, and call bins are clamped to the
    bins between the outermost centres. The bin width follows the span of the motif table, so
    that the expanded table stays near 100,000 rows plus two per motif. Motif columns come back
    with an ``m_`` prefix.
    """
    t = territories(motifs, tol, last_by)
    if bin_size is None:
        span = motifs.groupBy("chrom").agg((F.max("center") - F.min("center")).alias("s")).agg(F.sum("s")).first()[0]
        bin_size = max(512, 1 << (int(span or 0) // 100_000).bit_length())
    m = t.select(*[F.col(c).alias(f"m_{c}") for c in motifs.columns], "t_lo", "t_hi")
    pos_bin = F.floor(F.col("call_pos") / bin_size)
    if tol > 0:
        m = m.withColumn("m__bin", F.explode(_bins(F.col("t_lo"), F.col("t_hi") + 1, bin_size)))
        left = calls.withColumn("_bin", pos_bin)
    else:
        cb = F.floor(F.col("m_center") / bin_size)
        ext = m.groupBy(F.col("m_chrom").alias("x_chrom")).agg(F.min(cb).alias("b0"), F.max(cb).alias("b1"))
        m = m.join(broadcast_if_small(ext), F.col("m_chrom") == F.col("x_chrom"))
        m = m.withColumn("_lo", F.coalesce(F.floor(F.col("t_lo") / bin_size), F.col("b0")))
        m = m.withColumn("_hi", F.coalesce(F.floor(F.col("t_hi") / bin_size), F.col("b1")))
        m = m.withColumn("m__bin", F.explode(F.sequence(F.greatest("_lo", "b0"), F.least("_hi", "b1"))))
        m = m.drop("x_chrom", "b0", "b1", "_lo", "_hi")
        left = calls.join(broadcast_if_small(ext), F.col("chrom") == F.col("x_chrom"))
        left = left.withColumn("_bin", F.greatest(F.least(pos_bin, F.col("b1")), F.col("b0")))
        left = left.drop("x_chrom", "b0", "b1")
    m = cut_lineage(m, "territories")  # counted for the broadcast check, then joined
    p = F.col("call_pos")
    cond = (
        (F.col("chrom") == F.col("m_chrom"))
        & (F.col("_bin") == F.col("m__bin"))
        & (F.col("t_lo").isNull() | (p >= F.col("t_lo")))
        & (F.col("t_hi").isNull() | (p <= F.col("t_hi")))
    )
    return left.join(broadcast_if_small(m), cond).drop("_bin", "m__bin", "t_lo", "t_hi")


def nearest_index(x: DataFrame, y: DataFrame) -> DataFrame:
    """For each row of x the index of the closest y.value of its key, lowest index on ties.

    Both sides are merged in value order, in range chunks of like row counts; within a chunk each x sees the last
    y before it and the first after it, and what lies beyond a chunk comes from one summary row per chunk. Neither
    a frequent key nor crowded values make a task larger. Of equal y values the lowest index counts; every row of x
    with a value stays unless its key has no y.
    """
    ys = y.filter("value IS NOT NULL").groupBy("key", "value").agg(F.min("idx").alias("idx"))
    ys = ys.select("key", "value", F.struct("value", "idx").alias("_y"), F.lit(None).cast(x.schema).alias("_x"))
    xs = x.filter("value IS NOT NULL").select("key", "value", F.lit(None).cast(ys.schema["_y"].dataType).alias("_y"), F.struct(*x.columns).alias("_x"))
    both = value_chunks(ys.unionByName(xs), "value")
    per = both.groupBy("key", "_chunk").agg(F.max("_y").alias("_l"), F.min("_y").alias("_f"))
    # what comes after is looked up in falling order: a frame that ends with the window is summed anew for every row
    seen = lambda c, w, end: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, end))
    outer = Window.partitionBy("key")
    per = per.select(
        "key", "_chunk", seen("_l", outer.orderBy("_chunk"), -1).alias("_before"), seen("_f", outer.orderBy(F.desc("_chunk")), -1).alias("_after"))
    inner = Window.partitionBy("key", "_chunk")
    both = both.withColumn("_p", seen("_y", inner.orderBy("value", F.col("_x").isNotNull()), 0))
    both = both.withColumn("_n", seen("_y", inner.orderBy(F.desc("value"), F.col("_x").isNotNull()), 0))
    both = both.filter("_x IS NOT NULL").join(per, ["key", "_chunk"])

    def off(c: Column) -> Column:
        return F.when(c.isNotNull(), F.struct(F.abs(F.col("value") - c["value"]).alias("d"), c["idx"].alias("i")))

    best = F.least(off(F.coalesce("_p", "_before")), off(F.coalesce("_n", "_after")))
    return both.withColumn("_b", best).filter("_b IS NOT NULL").select("_x.*", F.col("_b.i").alias("nearest_idx"))
