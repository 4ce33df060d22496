"""Metaprofiles and read rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlight.operators.binding import CORE_MASK, PAIR, Windows, offset_bits, pair_masks
from strandlight.operators.lookups import complete_bins
from strandlight.ordered import with_index
from strandlight.session import cut_lineage


def _windowed(cm: DataFrame, W: int, w: int) -> DataFrame:
    return cm.filter(f"status IN ('M', 'U') AND rel_pos BETWEEN {-W} AND {W}").selectExpr(
        *PAIR, f"CAST(floor(rel_pos / {w}) * {w} AS INT) AS rel_bin", "CAST(status = 'U' AS INT) AS u"
    )


def metaprofile(cm: DataFrame, pairs: DataFrame, W: int = 1000, w: int = 5) -> DataFrame:
    """Pooled fraction U per bin over the selected pairs, all bins present."""
    rows = _windowed(cm, W, w).join(pairs.select(*PAIR), PAIR, "left_semi")
    return complete_bins(rows.groupBy("rel_bin").agg(F.avg("u").alias("frac_u")), W, w)


def metaprofile_labeled(cm: DataFrame, labels: DataFrame, W: int = 1000, w: int = 5) -> DataFrame:
    """One pass over a pair -> label table."""
    rows = _windowed(cm, W, w).join(labels.select(*PAIR, "label"), PAIR)
    return rows.groupBy("rel_bin", "label").agg(F.avg("u").alias("frac_u"))


def metaprofile_stratified(cm: DataFrame, pairs: DataFrame, nuc: DataFrame, W: int = 1000, w: int = 5) -> DataFrame:
    """Retained against nucleosome-flagged among the selected pairs."""
    flag = nuc.select(*PAIR).distinct().withColumn("_n", F.lit(True))
    lab = pairs.select(*PAIR).distinct().join(flag, PAIR, "left").selectExpr(
        *PAIR, "CASE WHEN _n THEN 'nucleosome-flagged' ELSE 'retained' END AS label"
    )
    return metaprofile_labeled(cm, lab, W, w)


def metaprofile_macro(cm: DataFrame, sets: DataFrame | None, W: int = 1000, w: int = 5) -> DataFrame:
    """Per motif the fraction U of right-closed bins (N calls in the denominator), then mean
    and sample sd over motifs, per motif set. ``sets`` maps motif_id to ``label``."""
    rows = cm.filter(f"rel_pos > {-W} AND rel_pos <= {W}").selectExpr(
        "motif_id", f"CAST(ceil(rel_pos / {w}) * {w} - {w} AS INT) AS rel_bin", "CAST(status = 'U' AS INT) AS u"
    )
    per = rows.groupBy("motif_id", "rel_bin").agg(F.avg("u").alias("f"))
    keys = ["rel_bin"]
    if sets is not None:
        per = per.join(sets.select("motif_id", "label"), "motif_id")
        keys = ["label", "rel_bin"]
    return per.groupBy(*keys).agg(
        F.avg("f").alias("mean"), F.stddev_samp("f").alias("sd"), F.count("*").alias("n_motifs")
    )


def set_masks(motif_sets: dict[str, DataFrame]) -> tuple[DataFrame, list[str]]:
    """Every motif of the sets once, with ``in_set``: bit i marks the i-th set of the returned names."""
    names = list(motif_sets)
    if len(names) > 62:
        raise ValueError("a membership mask holds 62 sets")
    cols = ["chrom", "start", "end", "strand", "center"]
    rows = None
    for i, name in enumerate(names):
        m = motif_sets[name].select(*cols, F.lit(1 << i).cast("long").alias("in_set"))
        rows = m if rows is None else rows.unionByName(m)
    return rows.groupBy(*cols).agg(F.expr("bit_or(in_set)").alias("in_set")), names


def metaprofile_sets(cm: DataFrame, names: list[str], W: int = 1000, w: int = 5) -> DataFrame:
    """P4 for many motif sets from one pass: ``cm`` carries the mask ``in_set`` of its motif.

    The fraction U of a (motif, bin) is taken once and counted in each set that holds the motif; sets may overlap.
    """
    rows = cm.filter(f"rel_pos > {-W} AND rel_pos <= {W}").selectExpr(
        "motif_id", "in_set", f"CAST(ceil(rel_pos / {w}) * {w} - {w} AS INT) AS rel_bin", "CAST(status = 'U' AS INT) AS u")
    per = rows.groupBy("motif_id", "rel_bin").agg(F.avg("u").alias("f"), F.expr("bit_or(in_set)").alias("in_set"))
    held = F.expr(f"filter(sequence(0, {len(names) - 1}), i -> getbit(in_set, i) = 1)")
    per = per.select("rel_bin", "f", F.explode(held).alias("_i"))
    out = per.groupBy("_i", "rel_bin").agg(F.avg("f").alias("mean"), F.stddev_samp("f").alias("sd"), F.count("*").alias("n_motifs"))
    return out.select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_i") + 1).alias("label"), "rel_bin", "mean", "sd", "n_motifs")


def pair_cells(cm: DataFrame, windows: Windows, W: int, w: int) -> DataFrame:
    """One row per (motif, read) from one pass over the calls: the masks ``u`` and ``m`` of ``pair_masks`` and
    ``cells``, the calls and U calls of each occupied bin within +-W.

    Calls first combine per (pair, bin), so a list holds at most 2 W / w + 1 bins however often a call repeats.
    """
    rows = cm.filter("status IN ('M', 'U')").selectExpr(
        *PAIR, "status = 'U' AS is_u", f"{offset_bits(windows)} AS bits",
        f"CASE WHEN rel_pos BETWEEN {-W} AND {W} THEN CAST(floor(rel_pos / {w}) * {w} AS INT) END AS rel_bin").filter("bits <> 0 OR rel_bin IS NOT NULL")
    per = rows.groupBy(*PAIR, "rel_bin").agg(
        F.count("*").alias("n"), F.count_if("is_u").alias("n_u"),
        F.expr("bit_or(CASE WHEN is_u THEN bits ELSE 0L END) AS u"), F.expr("bit_or(CASE WHEN is_u THEN 0L ELSE bits END) AS m"))
    cell = F.when(F.col("rel_bin").isNotNull(), F.struct("rel_bin", "n", "n_u"))  # collect_list skips nulls
    return per.groupBy(*PAIR).agg(F.expr("bit_or(u) AS u"), F.expr("bit_or(m) AS m"), F.collect_list(cell).alias("cells"))


def metaprofile_cells(labelled: DataFrame) -> DataFrame:
    """P3 on pairs that carry a ``label`` and their ``cells``: pooled fraction U per label and bin."""
    c = labelled.select("label", F.explode("cells").alias("c")).select("label", "c.*")
    return c.groupBy("rel_bin", "label").agg((F.sum("n_u") / F.sum("n")).alias("frac_u"))


# ---------------------------------------------------------------- rasters


def prepare_reads(cm: DataFrame, W: int, core_span: int = 0, min_calls: int = 0, w: int = 5) -> DataFrame:
    """M/U calls within +-W with their bin, of reads that span +-core_span and carry enough
    calls. All motifs at once: a read counts per motif.

    The calls are joined and moved once: a read at a motif is one window, and what follows per pair stays in place.
    """
    rows = cm.filter(f"status IN ('M', 'U') AND rel_pos BETWEEN {-W} AND {W}").selectExpr(
        *PAIR, "rel_pos", f"CAST(floor(rel_pos / {w}) * {w} AS INT) AS rel_bin", "status"
    )
    if core_span <= 0 and min_calls <= 0:
        return rows
    pair = Window.partitionBy(*PAIR)
    ok = []
    if core_span > 0:
        rows = rows.withColumns({"_lo": F.min("rel_pos").over(pair), "_hi": F.max("rel_pos").over(pair)})
        ok.append(f"_lo <= {-core_span} AND _hi >= {core_span}")
    if min_calls > 0:
        rows = rows.withColumn("_n", F.count("*").over(pair))
        ok.append(f"_n >= {min_calls}")
    return rows.filter(" AND ".join(ok)).filter("motif_id IS NOT NULL AND read_id IS NOT NULL").drop("_lo", "_hi", "_n")


def prepare_counts(cm: DataFrame, W: int, core_span: int = 0, min_calls: int = 0) -> DataFrame:
    """Stage counters per motif, all from one per-read aggregate."""
    per = cm.filter(f"status IN ('M', 'U') AND rel_pos BETWEEN {-W} AND {W}").groupBy(*PAIR).agg(
        F.min("rel_pos").alias("lo"), F.max("rel_pos").alias("hi"), F.count("*").alias("n")
    )
    span = f"(lo <= {-core_span} AND hi >= {core_span})" if core_span > 0 else "true"
    return per.groupBy("motif_id").agg(
        F.sum("n").alias("calls_in_window"),
        F.count("*").alias("reads_in_window"),
        F.expr(f"count_if({span})").alias("reads_spanning"),
        F.expr(f"count_if({span} AND n >= {min_calls})").alias("reads_after_min"),
    )


def _row_order(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """1-based rank within a motif; ``_chunk`` splits a motif with very many reads."""
    return with_index(df, ["motif_id"], order, name).withColumn(name, F.col(name) + 1).drop("n_rows", "_chunk")


def raster(reads: DataFrame, status: str = "M") -> DataFrame:
    """Per (motif, read, bin) 1 when any call has the chosen status, else 0; absent cells are
    the -1 of a dense matrix. ``row_ord`` follows the first occupied bin, then the read id.

    The calls are read once: a pair is written as one row with its cells, numbered, and unfolded."""
    cell = reads.groupBy(*PAIR, "rel_bin").agg(F.max((F.col("status") == status).cast("int")).alias("val"))
    pairs = cell.groupBy(*PAIR).agg(F.min("rel_bin").alias("first_bin"), F.collect_list(F.struct("rel_bin", "val")).alias("cells"))
    pairs = cut_lineage(pairs.filter("motif_id IS NOT NULL AND read_id IS NOT NULL"), "cells")
    order = _row_order(pairs.withColumn("_chunk", F.col("first_bin").cast("long")), ["first_bin", "read_id"], "row_ord")
    return order.select(*PAIR, "row_ord", F.explode("cells").alias("c")).select(*PAIR, "c.rel_bin", "c.val", "row_ord")


def raster_dense(r: DataFrame, W: int, w: int) -> DataFrame:
    """Dense rows for display, one array per read with -1 for no call."""
    bins = list(range(-W, W + 1, w))
    vals = F.map_from_entries(F.collect_list(F.struct("rel_bin", "val")))
    g = r.groupBy(*PAIR, "row_ord").agg(vals.alias("m"))
    arr = F.transform(F.array(*[F.lit(b) for b in bins]), lambda b: F.coalesce(F.element_at("m", b), F.lit(-1)))
    return g.select(*PAIR, "row_ord", arr.alias("cells"))


def raster_categories(
    cm: DataFrame, k: int = 2, nuc: tuple[int, int] = (20, 60), up: bool = True, down: bool = True,
    no_core: str = "naked",
) -> DataFrame:
    """Category and order of each read of each motif.

    Static needs at least ``k`` measured core bins, all bound; a nucleosome-like read is
    nucleosomal unless it has no bound core bin and ``no_core`` is 'naked'; other bound reads
    are dynamic, those with fewer than ``k`` measured bins last. Base order: first occupied bin.
    """
    lo, hi = sorted(nuc)
    base = cm.filter("status IN ('M', 'U')").groupBy(*PAIR).agg(F.min("rel_pos").alias("first_pos"))
    m = pair_masks(cm, Windows(nuc=(lo, hi)))
    s = base.join(m, PAIR, "left").selectExpr(
        *PAIR, "first_pos", f"bit_count(coalesce(u | m, 0L) & {CORE_MASK}L) AS n_measured",
        f"bit_count(coalesce(u, 0L) & {CORE_MASK}L) AS n_bound",
        "coalesce(" + " OR ".join(
            f"(u & {1 << p}L <> 0 AND m & {1 << p}L = 0)" for p, on in ((60, up), (61, down)) if on
        ) + ", false) AS nuc",
    )
    nuc_wins = "nuc" if no_core != "naked" else "(nuc AND n_bound > 0)"
    s = s.selectExpr(
        *PAIR, "first_pos", "n_measured",
        f"CASE WHEN {nuc_wins} THEN 'nucleosomal' WHEN n_bound = 0 THEN 'naked' "
        f"WHEN n_measured >= {k} AND n_bound = n_measured THEN 'static' ELSE 'dynamic' END AS category",
    )
    s = s.selectExpr(
        "*", "CASE category WHEN 'static' THEN 0 WHEN 'dynamic' THEN 1 WHEN 'nucleosomal' THEN 2 ELSE 3 END AS grp",
        f"CASE WHEN category = 'dynamic' AND n_measured < {k} THEN 1 ELSE 0 END AS extra",
    )
    s = s.withColumn("_chunk", (F.col("grp") * 2 + F.col("extra")) * (1 << 20) + F.col("first_pos"))
    return _row_order(s, ["grp", "extra", "first_pos", "read_id"], "row_ord").select(*PAIR, "category", "row_ord")


def category_breaks(cats: DataFrame) -> DataFrame:
    """Reads per category of each motif."""
    names = ["static", "dynamic", "nucleosomal", "naked"]
    return cats.groupBy("motif_id").agg(*[F.expr(f"count_if(category = '{n}') AS n_{n}") for n in names])


def center_access(r: DataFrame, c: int, status: str = "M") -> DataFrame:
    """Reads ordered by centre access: all U, all M, mixed, none within +-c."""
    acc = 1 if status == "U" else 0
    g = r.groupBy(*PAIR, "row_ord").agg(
        F.expr(f"count_if(abs(rel_bin) <= {c}) AS n_obs"),
        F.expr(f"count_if(abs(rel_bin) <= {c} AND val = {acc}) AS n_acc"),
    )
    g = g.selectExpr(
        *PAIR, "row_ord",
        "CASE WHEN n_obs = 0 THEN 3 WHEN n_acc = n_obs THEN 0 WHEN n_acc = 0 THEN 1 ELSE 2 END AS grp",
    )
    g = g.withColumn("_chunk", F.col("grp") * (1 << 40) + F.floor(F.col("row_ord") / 50_000))
    return _row_order(g, ["grp", "row_ord"], "access_ord").select(
        *PAIR, F.expr("element_at(array('open', 'closed', 'mixed', 'none'), grp + 1)").alias("access"), "access_ord"
    )


def u_profile(reads: DataFrame) -> DataFrame:
    """Per-read mean U per bin, then mean, population sd and read count, per motif."""
    per = reads.groupBy(*PAIR, "rel_bin").agg(F.avg((F.col("status") == "U").cast("int")).alias("f"))
    return per.groupBy("motif_id", "rel_bin").agg(
        F.avg("f").alias("mean"), F.stddev_pop("f").alias("sd"), F.count("*").alias("n")
    )


def extend_calls(r: DataFrame, L: int, W: int, w: int) -> DataFrame:
    """Fill empty bins from the nearest observed bin at most L bins away, ties to the left.

    ``r`` is a raster of bins ``w`` wide, one row a cell. An observed cell owns the bins up to the middle of the gap
    to its neighbours, so a row moves once, unfilled. The work follows the observed cells, not the width of the raster.
    """
    b = F.col("rel_bin")
    read = Window.partitionBy(*PAIR, "row_ord").orderBy("rel_bin")
    before, after = F.lag(b).over(read), F.lead(b).over(read)
    # of the bins between two cells the middle one goes to the left cell
    lo = F.greatest(F.lit(-L), F.coalesce(-F.floor((b - before - w) / (2 * w)), F.lit(-L)), F.ceil((F.lit(-W) - b) / w))
    hi = F.least(F.lit(L), F.coalesce(F.floor((after - b) / (2 * w)), F.lit(L)), F.floor((F.lit(W) - b) / w))
    own = r.withColumns({"_lo": lo, "_hi": hi}).filter("_lo <= _hi")
    own = own.withColumn("_d", F.explode(F.sequence("_lo", "_hi")))
    return own.select(*PAIR, "row_ord", (b + F.col("_d") * w).cast("int").alias("rel_bin"), "val")
