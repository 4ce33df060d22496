"""Equi and lookup joins (C6, C7, C9, C10, C12, C15, C17-C19) and extra reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlight.session import broadcast_if_small


def calls_in_region(calls: DataFrame, chrom: str, lo: int, hi: int) -> DataFrame:
    """One locus; the predicate reaches the scan (partition column and row-group statistics)."""
    return calls.filter((F.col("chrom") == chrom) & F.col("call_pos").between(lo, hi))


def match_coords(m: DataFrame, bed: DataFrame, signal: str = "signal") -> DataFrame:
    """Left join on exact (chrom, start, end)."""
    return m.join(bed.select("chrom", "start", "end", F.col(signal).alias("signal")), ["chrom", "start", "end"], "left")


def match_center(m: DataFrame, bed: DataFrame, signal: str = "signal") -> DataFrame:
    """Left join on (chrom, centre); the bed side uses its floor midpoint."""
    b = bed.select(
        "chrom", F.floor((F.col("start") + F.col("end")) / 2).alias("center"), F.col(signal).alias("signal")
    )
    return m.join(b, ["chrom", "center"], "left")


def signal_column(df: DataFrame, index: int | None = None) -> str:
    """The column at ``index``, else the last numeric one."""
    if index is not None:
        return df.columns[index]
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if not numeric:
        raise ValueError("no numeric column")
    return numeric[-1]


def finalize_signal(df: DataFrame, policy: str = "drop", signal: str = "signal", order: str | None = None) -> DataFrame:
    """After a left join fill missing with 0, keep them as null, or drop them."""
    finite = F.when(~F.isnan(signal) & (F.abs(F.col(signal)) != float("inf")), F.col(signal))
    out = df.withColumn(signal, finite)
    if policy == "zero":
        out = out.withColumn(signal, F.coalesce(signal, F.lit(0.0)))
    elif policy == "drop":
        out = out.filter(F.col(signal).isNotNull())
    elif policy != "keep":
        raise ValueError(policy)
    return out.orderBy(order) if order else out


def restrict_motifs(cm: DataFrame, motifs: DataFrame, with_strand: bool = False) -> DataFrame:
    """Calls of the given motif instances."""
    keys = ["m_start", "m_end"] + (["m_strand"] if with_strand else [])
    m = motifs.select("chrom", *[F.col(k[2:]).alias(k) for k in keys]).distinct()
    return cm.join(broadcast_if_small(m), ["chrom", *keys], "left_semi")


def target_motif(motifs: DataFrame, regions: DataFrame, idx: int | None = None) -> DataFrame:
    """Per region the overlapping motif (inclusive ends) closest to its midpoint, or the
    ``idx``-th in (start, end) order.

    The bucketed overlap join keys by position, so no chromosome is one key.
    """
    from strandlight.operators.intervals import overlap_join

    r = regions.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    # half-open intervals, one longer on the region's side, meet exactly where closed ones do
    wide = r.withColumn("start", F.col("r_start")).withColumn("end", F.col("r_end") + 1)
    m = motifs.select(F.struct(*motifs.columns).alias("m"), "chrom", "start", (F.col("end") + 1).alias("end"))
    j = overlap_join(m, wide.distinct())
    j = j.select(F.col("a_m").alias("m"), F.col("b_chrom").alias("r_chrom"), F.col("b_r_start").alias("r_start"), F.col("b_r_end").alias("r_end"))
    keys = ["r_chrom", "r_start", "r_end"]
    mid = F.floor((F.col("r_start") + F.col("r_end")) / 2)
    if idx is None:
        pick = j.groupBy(*keys).agg(F.min_by("m", F.struct(F.abs(F.col("m.center") - mid), "m.start", "m.end")).alias("m"))
    else:
        w = Window.partitionBy(*keys).orderBy("m.start", "m.end")
        pick = j.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == idx + 1)
    return pick.select(*keys, "m.*")


def complete_bins(df: DataFrame, W: int, w: int, keys: list[str] | None = None, name: str = "rel_bin") -> DataFrame:
    """Every bin of -W..W step w (per key), values null where unseen."""
    spark = df.sparkSession
    if keys:
        grid = df.select(*keys).distinct()
    else:
        grid = spark.range(1).select()
    grid = grid.withColumn(name, F.explode(F.sequence(F.lit(-W), F.lit(W), F.lit(w))))
    return grid.join(df, [*(keys or []), name], "left")


def curves_wide(curves: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """Several curves side by side by key, one column per name, missing cells null."""
    out = None
    for n, d in curves.items():
        t = d.select(key, F.lit(n).alias("_n"), F.col(value).alias("_v"))
        out = t if out is None else out.unionByName(t)
    return out.groupBy(key).pivot("_n", list(curves)).agg(F.first("_v", ignorenulls=True))


def attach_baseline(curves: DataFrame, wide_map: DataFrame) -> DataFrame:
    """C17: map each curve to its baseline, null where the map has none; the wide map (header = baseline,
    cells = curves) is unpivoted first."""
    cols = wide_map.columns
    long = wide_map.select([F.col(f"`{c}`").cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "baseline_curve", "curve"
    ).filter("curve IS NOT NULL")
    return curves.join(broadcast_if_small(long), "curve", "left")


def attach_calibration(curves: DataFrame, cal: DataFrame, value: str = "kappa") -> DataFrame:
    """C17: stiffness of both channels per (date, curve); a curve without calibration fails the job."""
    k = cal.groupBy("date", "curve").pivot("channel", ["1x", "2x"]).agg(F.first(value))
    k = k.withColumnRenamed("1x", f"{value}_1x").withColumnRenamed("2x", f"{value}_2x")
    out = curves.join(broadcast_if_small(k.withColumn("_has", F.lit(True))), ["date", "curve"], "left")
    lost = F.raise_error(F.concat(F.lit("no calibration for curve "), F.col("curve").cast("string"))).cast("boolean")
    return out.filter(F.coalesce("_has", lost)).drop("_has")


def order_tracks(r: DataFrame, bins: list[int]) -> DataFrame:
    """tracks by mean r over chosen bins, descending."""
    return (
        r.filter(F.col("zf").isin(bins)).groupBy("track").agg(F.avg("r").alias("mean_r")).orderBy(F.desc("mean_r"), "track")
    )


def top_rows(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """the first n rows of an order."""
    return df.orderBy(*order).limit(n)


def best_by(df: DataFrame, group: list[str], key: str, smallest: bool = True, tie: list[str] | None = None) -> DataFrame:
    """the row with the extreme key per group; ties go to the smallest ``tie`` columns."""
    row = F.struct(*[F.col(c) for c in df.columns if c not in group])
    k = F.col(key) if smallest else -F.col(key)
    order = F.struct(k, *[F.col(c) for c in (tie or [])])
    return df.groupBy(*group).agg(F.min_by(row, order).alias("r")).select(*group, "r.*")
