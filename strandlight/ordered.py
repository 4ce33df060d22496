"""Ordered operations that never put a whole trace or chromosome in one task.

Rows are windowed inside ``keys + [chunk]``; what crosses a chunk border travels in a
summary with one row per chunk. ``chunk`` must be monotone in the order columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlight.session import cut_lineage

CHUNK = "_chunk"


def _order_struct(order: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])


def chunk_by(df: DataFrame, col: str, width: float, name: str = CHUNK) -> DataFrame:
    """Fixed-width chunks of a numeric order column."""
    return df.withColumn(name, F.floor(F.col(col) / F.lit(width)).cast("long"))


def with_neighbors(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    prev: dict[str, str] | None = None,
    next: dict[str, str] | None = None,
    chunk: str = CHUNK,
) -> DataFrame:
    """Add the previous / next row's values; ``prev`` and ``next`` map new name -> column."""
    prev, next = prev or {}, next or {}
    cols = sorted(set(prev.values()) | set(next.values()))
    vals = F.struct(*[F.col(c) for c in cols])
    inner = Window.partitionBy(*keys, chunk).orderBy(*order)
    edges = df.groupBy(*keys, chunk).agg(
        F.min_by(vals, _order_struct(order)).alias("_first"),
        F.max_by(vals, _order_struct(order)).alias("_last"),
    )
    outer = Window.partitionBy(*keys).orderBy(chunk)
    edges = edges.select(
        *keys,
        chunk,
        F.lag("_last").over(outer).alias("_plast"),
        F.lead("_first").over(outer).alias("_nfirst"),
    )
    out = df.withColumn("_prow", F.lag(vals).over(inner)).withColumn("_nrow", F.lead(vals).over(inner))
    out = out.join(edges, [*keys, chunk])
    p = F.coalesce("_prow", "_plast")
    n = F.coalesce("_nrow", "_nfirst")
    add = [p.getField(c).alias(a) for a, c in prev.items()]
    add += [n.getField(c).alias(a) for a, c in next.items()]
    return out.select(*df.columns, *add)


def with_running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column],
    totals: bool = False,
    chunk: str = CHUNK,
) -> DataFrame:
    """Add inclusive running sums (and key totals as ``<name>_total``)."""
    names = list(sums)
    base = df.select("*", *[sums[n].alias(f"_v_{n}") for n in names])
    per = base.groupBy(*keys, chunk).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    outer = Window.partitionBy(*keys).orderBy(chunk)
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offs = per.select(
        *keys,
        chunk,
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names],
        *([F.sum(f"_s_{n}").over(whole).alias(f"{n}_total") for n in names] if totals else []),
    )
    inner = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = base.select("*", *[F.sum(f"_v_{n}").over(inner).alias(f"_r_{n}") for n in names])
    out = out.join(offs, [*keys, chunk])
    add = [(F.coalesce(F.col(f"_r_{n}"), F.lit(0)) + F.col(f"_o_{n}")).alias(n) for n in names]
    add += [F.col(f"{n}_total") for n in names] if totals else []
    return out.select(*df.columns, *add)


def with_index(df: DataFrame, keys: list[str], order: list[str], name: str = "idx", chunk: str = CHUNK) -> DataFrame:
    """0-based row number within each key and the row count ``n_rows``."""
    out = with_running(df, keys, order, {name: F.lit(1).cast("long")}, totals=True, chunk=chunk)
    return out.withColumn(name, F.col(name) - 1).withColumnRenamed(f"{name}_total", "n_rows")


def value_chunks(df: DataFrame, value: str, rows: int = 50_000) -> DataFrame:
    """Chunks of about ``rows`` rows each, monotone in the value, whatever its distribution.

    A range partition on the value gives the edges; the table is written so that they stay.
    """
    n = df.count()
    if n <= rows:
        return df.withColumn("_chunk", F.lit(0).cast("long"))
    laid = df.repartitionByRange(-(-n // rows), value).withColumn("_chunk", F.spark_partition_id().cast("long"))
    return cut_lineage(laid, "chunks")


def halo_blocks(df: DataFrame, idx: str, before: int, after: int, size: int, name: str = "_blk") -> DataFrame:
    """Copy each row into every index block whose halo it touches; ``_core`` marks the owner.

    With ``size >= before + after`` a row gets at most two copies, so data grows by under 2x.
    """
    i, b = F.col(idx), F.lit(size)
    lo = F.greatest(F.floor((i - after) / b), F.lit(0))
    hi = F.floor((i + before) / b)
    out = df.withColumn(name, F.explode(F.sequence(lo, hi)))
    return out.withColumn("_core", F.col(name) == F.floor(i / b))


def centred_mean(
    df: DataFrame, keys: list[str], idx: str, value: str, n: int, out: str, n_rows: str = "n_rows"
) -> DataFrame:
    """Centred rolling mean with shrinking edges: rows ``i - n//2 .. i + (n-1)//2``.

    Prefix sums inside halo blocks make the cost per row independent of ``n``.
    """
    if n <= 1:
        return df.withColumn(out, F.col(value))
    h1, h2 = n // 2, (n - 1) // 2
    size = max(2 * n, 65_536)
    blk = halo_blocks(df, idx, h1, h2, size)
    w = Window.partitionBy(*keys, "_blk").orderBy(idx)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    blk = blk.withColumn("_cs", F.sum(value).over(run)).withColumn("_last", F.last("_cs").over(
        w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    hi = F.coalesce(F.lead("_cs", h2).over(w), F.col("_last")) if h2 else F.col("_cs")
    lo = F.coalesce(F.lag("_cs", h1 + 1).over(w), F.lit(0.0))
    i = F.col(idx)
    cnt = F.least(i + h2, F.col(n_rows) - 1) - F.greatest(i - h1, F.lit(0)) + 1
    return blk.withColumn(out, (hi - lo) / cnt).filter("_core").drop("_blk", "_core", "_cs", "_last")
