"""Per-read binding tables and everything computed from them.

Central idea: one ``groupBy(motif_id, read_id)`` with two ``bit_or`` aggregates turns all calls
of a pair into two 64-bit masks, ``u`` (bins with a U call) and ``m`` (bins with an M call).
Measured = u|m, bound = u, all-U = u & ~m. Bits combine map-side, so a hot motif or read
shrinks before the only shuffle, and every filter, class and count below is integer
arithmetic on one row per pair.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlight.functions.calls import BIN_WIDTH, CENTER_BIN, CORE_BINS, zf_bin

PAIR = ["motif_id", "read_id"]

# Bin codes, default windows, cluster schemes and axis labels.
FLANK_UP, FLANK_DOWN = 0, 12
NEAR_UP, NEAR_DOWN = 13, 14
CLUSTERS3 = {1: [1, 2, 3], 2: [4, 5, 6, 7, 8], 3: [9, 10, 11]}
CLUSTERS5 = {1: [1, 2], 2: [3, 4], 3: [5, 6, 7], 4: [8, 9], 5: [10, 11]}
SCHEMES = {"3": CLUSTERS3, "5": CLUSTERS5}
CLUSTER_LABELS = {
    "3": {1: "Cluster_I", 2: "Cluster_II", 3: "Cluster_III"},
    "5": {1: "ZF1-2", 2: "ZF3-4", 3: "ZF5-7", 4: "ZF8-9", 5: "ZF10-11"},
}
SPECIAL_LABELS = {0: "N_NDR", 12: "C_NDR", 13: "N_COH", 14: "C_COH"}

CORE_MASK = sum(1 << k for k in CORE_BINS)
NUC_UP_BIT, NUC_DOWN_BIT = 60, 61


def bit_of(code: int) -> int:
    """Bit position of a bin code: 0..14 and 21..39 as they are, -1..-19 at 41..59."""
    if not -19 <= code <= 39:
        raise ValueError(f"bin code {code}: a mask holds at most 19 flank tiles per side")
    return code if code >= 0 else 40 - code


@dataclass(frozen=True)
class Windows:
    """Extra bins on top of the core (D6). Windows are inclusive and may overlap."""

    ndr: tuple[int, int] | None = None
    near: tuple[int, int] | None = None
    flank_bins: int = 0
    flank_width: int = 3
    flank_start: int = 18
    nuc: tuple[int, int] | None = None

    def spec(self) -> list[tuple[int, int, int]]:
        """(code, lo, hi) rows of every extra bin."""
        out = []
        if self.ndr:
            lo, hi = sorted(self.ndr)
            out += [(FLANK_UP, -hi, -lo), (FLANK_DOWN, lo, hi)]
        if self.near:
            lo, hi = sorted(self.near)
            out += [(NEAR_UP, -hi, -lo), (NEAR_DOWN, lo, hi)]
        for i in range(1, self.flank_bins + 1):
            near = self.flank_start + (i - 1) * self.flank_width
            far = near + self.flank_width - 1
            out += [(-i, -far, -near), (20 + i, near, far)]
        return out

    def codes(self) -> list[int]:
        return [c for c, _, _ in self.spec()]


def bin_spec(windows: Windows = Windows(), hide5: bool = False, scheme: str | None = None) -> list[tuple[int, str]]:
    """The reported bins in axis order with their labels."""
    core = sorted(SCHEMES[scheme]) if scheme else list(CORE_BINS)
    if hide5:
        core = [c for c in core if c != (3 if scheme == "5" else 5)]
    k = windows.flank_bins
    bins = [-i for i in range(k, 0, -1)]
    bins += [FLANK_UP] if windows.ndr else []
    bins += [NEAR_UP] if windows.near else []
    bins += core
    bins += [NEAR_DOWN] if windows.near else []
    bins += [FLANK_DOWN] if windows.ndr else []
    bins += [20 + i for i in range(1, k + 1)]

    def label(z: int) -> str:
        if z in SPECIAL_LABELS:
            return SPECIAL_LABELS[z]
        if z < 0:
            return str(z)
        if z > 20:
            return f"+{z - 20}"
        return CLUSTER_LABELS[scheme][z] if scheme else f"ZF{z}"

    return [(z, label(z)) for z in bins]


# ---------------------------------------------------------------- long-form operators


def binding_table(cm: DataFrame, min_calls: int = 0, lo: int = 1, hi: int = 11) -> DataFrame:
    """D1 + D2: bound = any U per (motif, read, bin), with the call count; HAVING on the count."""
    b = (
        cm.filter(F.col("status").isin("M", "U"))
        .withColumn("zf", zf_bin("rel_pos"))
        .filter(F.col("zf").between(lo, hi))
        .groupBy(*PAIR, "zf")
        .agg(F.max((F.col("status") == "U").cast("int")).alias("bound"), F.count("*").alias("n_calls"))
    )
    return b.filter(F.col("n_calls") >= min_calls) if min_calls > 0 else b


def window_bins(cm: DataFrame, windows: Windows, min_calls: int = 0) -> DataFrame:
    """Binding rows of the extra bins, all windows in one pass."""
    rel = F.col("rel_pos")
    hits = F.array_compact(
        F.array(*[F.when(rel.between(lo, hi), F.lit(c)) for c, lo, hi in windows.spec()])
    )
    b = (
        cm.filter(F.col("status").isin("M", "U"))
        .withColumn("zf", F.explode(hits))
        .groupBy(*PAIR, "zf")
        .agg(F.max((F.col("status") == "U").cast("int")).alias("bound"), F.count("*").alias("n_calls"))
    )
    return b.filter(F.col("n_calls") >= min_calls) if min_calls > 0 else b


def min_calls(b: DataFrame, n: int) -> DataFrame:
    """D2 on a table that carries ``n_calls``."""
    return b.filter(F.col("n_calls") >= n)


def remap_bins(b: DataFrame, scheme: str) -> DataFrame:
    """Merge core bins into clusters and collapse again with max."""
    z = F.col("zf")
    e = z
    for target, members in SCHEMES[scheme].items():
        e = F.when(z.isin(members), target).otherwise(e)
    return b.withColumn("zf", e.cast("int")).groupBy(*PAIR, "zf").agg(F.max("bound").alias("bound"))


def keep_pairs(b: DataFrame, keys: DataFrame) -> DataFrame:
    """C13."""
    return b.join(keys.select(*PAIR), PAIR, "left_semi")


def drop_pairs(b: DataFrame, keys: DataFrame) -> DataFrame:
    """C14."""
    return b.join(keys.select(*PAIR), PAIR, "left_anti")


def _pair_sums(b: DataFrame) -> DataFrame:
    core = F.col("zf").between(1, 11)
    return b.groupBy(*PAIR).agg(
        F.sum(F.when(core, F.col("bound")).otherwise(0)).alias("n_bound"),
        F.sum(core.cast("int")).alias("n_measured"),
        F.sum("bound").alias("all_bound"),
        F.count("*").alias("all_measured"),
    )


def mol_threshold(b: DataFrame, n: int, exact: bool = False) -> DataFrame:
    """D3: pairs with at least (or exactly) ``n`` bound core bins."""
    k = F.col("n_bound")
    return keep_pairs(b, _pair_sums(b).filter(k == n if exact else k >= n))


def focus_filter(b: DataFrame, bins: list[int], m: int) -> DataFrame:
    """Pairs with at least ``m`` bound bins of a set."""
    hit = (F.col("zf").isin(bins) & (F.col("bound") == 1)).cast("int")
    return keep_pairs(b, b.groupBy(*PAIR).agg(F.sum(hit).alias("k")).filter(F.col("k") >= m))


def drop_all_bound(b: DataFrame) -> DataFrame:
    """D5."""
    return keep_pairs(b, _pair_sums(b).filter("all_bound < all_measured"))


def nucleosome_pairs(cm: DataFrame, lo: int, hi: int, up: bool = True, down: bool = True) -> DataFrame:
    """(pair, side) whose window has calls, all of them U."""
    lo, hi = sorted((lo, hi))
    rel = F.col("rel_pos")
    sides = []
    if up:
        sides.append(F.when(rel.between(-hi, -lo), "up"))
    if down:
        sides.append(F.when(rel.between(lo, hi), "down"))
    return (
        cm.filter(F.col("status").isin("M", "U"))
        .withColumn("side", F.explode(F.array_compact(F.array(*sides))))
        .groupBy(*PAIR, "side")
        .agg(F.bool_and(F.col("status") == "U").alias("all_u"))
        .filter("all_u")
        .select(*PAIR, "side")
    )


def _class(n_bound: Column, n_measured: Column) -> Column:
    return (
        F.when(n_measured == 0, "missing")
        .when(n_bound == 0, "naked")
        .when(n_bound == n_measured, "static")
        .otherwise("dynamic")
    )


def pair_class(b: DataFrame) -> DataFrame:
    """Static / dynamic / naked / missing per pair from its core bins."""
    s = _pair_sums(b)
    return s.select(*PAIR, "n_bound", "n_measured", _class(F.col("n_bound"), F.col("n_measured")).alias("cls"))


def pair_filter(b: DataFrame, mode: str, k: int = 0, exact: bool = False) -> DataFrame:
    """Keep static or dynamic pairs, optionally with >= k or == k measured core bins."""
    if mode == "all":
        return b
    c = pair_class(b).filter(F.col("cls") == mode)
    if k > 0:
        c = c.filter(F.col("n_measured") == k if exact else F.col("n_measured") >= k)
    return keep_pairs(b, c)


# ---------------------------------------------------------------- mask form
# Expressions are SQL text: one parser call instead of a column tree per bin.


def _bit(mask: str, pos: int) -> str:
    return f"(shiftrightunsigned({mask}, {pos}) & 1L)"


def _ratio(num: str, den: str) -> str:
    return f"try_divide(CAST({num} AS DOUBLE), CAST({den} AS DOUBLE))"


def _exprs(items: list[str]) -> list[Column]:
    return [F.expr(e) for e in items]


def _unpivot(one: DataFrame, keys: list[str], fields: list[str], rows: list[list[str]]) -> DataFrame:
    """One output row per entry of ``rows``, each a list of expressions for ``fields``."""
    structs = [f"named_struct({', '.join(f'{repr(f)}, {e}' for f, e in zip(fields, r))})" for r in rows]
    return one.selectExpr(*keys, f"inline(array({', '.join(structs)}))")


def offset_bits(windows: Windows, rel: str = "rel_pos") -> str:
    """Mask of every bin that holds an offset: one lookup in a table over the widest window."""
    spec = [(1 << k, BIN_WIDTH * (k - CENTER_BIN), BIN_WIDTH * (k - CENTER_BIN) + BIN_WIDTH - 1) for k in CORE_BINS]
    spec += [(1 << bit_of(c), lo, hi) for c, lo, hi in windows.spec()]
    if windows.nuc:
        lo, hi = sorted(windows.nuc)
        spec += [(1 << NUC_UP_BIT, -hi, -lo), (1 << NUC_DOWN_BIT, lo, hi)]
    w = max(max(abs(lo), abs(hi)) for _, lo, hi in spec)
    table = [0] * (2 * w + 1)
    for mask, lo, hi in spec:
        for x in range(lo, hi + 1):
            table[x + w] |= mask
    lookup = "array(" + ", ".join(f"{v}L" for v in table) + ")"
    return f"coalesce(get({lookup}, CASE WHEN {rel} BETWEEN {-w} AND {w} THEN CAST({rel} + {w} AS INT) END), 0L)"


CORE_LO, CORE_HI = BIN_WIDTH * (CORE_BINS[0] - CENTER_BIN), BIN_WIDTH * (CORE_BINS[-1] - CENTER_BIN) + BIN_WIDTH - 1
_SITES = f"CASE WHEN rel_pos BETWEEN {CORE_LO} AND {CORE_HI} THEN shiftleft(1L, CAST(rel_pos - ({CORE_LO}) AS INT)) ELSE 0L END"


def pair_masks(cm: DataFrame, windows: Windows = Windows(), min_calls: int = 0, sites: bool = False) -> DataFrame:
    """One row per (motif, read) with the masks ``u`` and ``m`` over all bins; with ``sites`` also a mask of the
    called positions of the core bins (one bit per base), from the same aggregate.

    ``min_calls`` > 1 needs counts per bin, so it first groups by (pair, bin); the nucleosome
    windows (bits 60/61) always count from one call.
    """
    if sites and min_calls > 1:
        raise ValueError("positions are counted from one call on")
    rows = (
        cm.filter("status IN ('M', 'U')")
        .selectExpr(*PAIR, "status = 'U' AS is_u", f"{offset_bits(windows)} AS bits", *([f"{_SITES} AS at"] if sites else []))
        .filter("bits <> 0")
    )
    if min_calls <= 1:
        return rows.groupBy(*PAIR).agg(
            F.expr("bit_or(CASE WHEN is_u THEN bits ELSE 0L END) AS u"),
            F.expr("bit_or(CASE WHEN is_u THEN 0L ELSE bits END) AS m"),
            *([F.expr("bit_or(at) AS sites")] if sites else []),
        )
    codes = [bit_of(c) for c in CORE_BINS + windows.codes()] + [NUC_UP_BIT, NUC_DOWN_BIT]
    each = f"explode(filter(array({', '.join(map(str, codes))}), c -> {_bit('bits', 'c')} = 1)) AS pos"
    per_bin = (
        rows.selectExpr(*PAIR, "is_u", "bits", each)
        .groupBy(*PAIR, "pos")
        .agg(F.expr("count(*) AS n"), F.expr("bool_or(is_u) AS any_u"), F.expr("bool_or(NOT is_u) AS any_m"))
        .filter(f"n >= {min_calls} OR pos >= {NUC_UP_BIT}")
    )
    return per_bin.groupBy(*PAIR).agg(
        F.expr("bit_or(CASE WHEN any_u THEN shiftleft(1L, pos) ELSE 0L END) AS u"),
        F.expr("bit_or(CASE WHEN any_m THEN shiftleft(1L, pos) ELSE 0L END) AS m"),
    )


@dataclass(frozen=True)
class Filters:
    """Molecule filters in their fixed order: threshold, focus, all-bound, nucleosome, class."""

    mol_threshold: int = 0
    exact: bool = False
    focus: list[int] = field(default_factory=list)
    focus_min: int = 1
    drop_all_bound: bool = False
    exclude_up: bool = False
    exclude_down: bool = False
    pair_mode: str = "all"
    pair_k: int = 0
    pair_exact: bool = False


_CLASS_SQL = (
    "CASE WHEN n_measured = 0 THEN 'missing' WHEN n_bound = 0 THEN 'naked' "
    "WHEN n_bound = n_measured THEN 'static' ELSE 'dynamic' END"
)
_DYNAMIC = "(n_bound > 0 AND n_bound < n_measured)"


def pair_states(masks: DataFrame, f: Filters) -> DataFrame:
    """Flags per pair: ``in_total`` (before exclusion), ``nuc_up``/``nuc_down``, ``in_kept``.

    The three snapshots are views of this one table: total = in_total core bins,
    kept core = in_kept core bins, final = kept core plus the extra bins of every pair that
    is not excluded.
    """
    ok = ["n_measured > 0"]
    if f.mol_threshold > 0:
        ok.append(f"n_bound {'=' if f.exact else '>='} {f.mol_threshold}")
    if f.focus:
        ok.append(f"bit_count(u & {sum(1 << c for c in f.focus)}L) >= {f.focus_min}")
    if f.drop_all_bound:
        ok.append("n_bound < n_measured")
    cls = ["true"]
    if f.pair_mode != "all":
        cls.append(f"{_CLASS_SQL} = '{f.pair_mode}'")
        if f.pair_k > 0:
            cls.append(f"n_measured {'=' if f.pair_exact else '>='} {f.pair_k}")

    def nuc(on: bool, pos: int) -> str:
        return f"({_bit('u', pos)} = 1 AND {_bit('m', pos)} = 0)" if on else "false"

    more = [c for c in masks.columns if c not in (*PAIR, "u", "m", "sites")]  # whatever else a pair carries
    s = masks.selectExpr(
        *PAIR, "u", "m", *more, "u | m AS meas", f"bit_count((u | m) & {CORE_MASK}L) AS n_measured",
        f"bit_count(u & {CORE_MASK}L) AS n_bound",
    )
    s = s.selectExpr(
        "*", f"{' AND '.join(ok)} AS in_total", f"{nuc(f.exclude_up, NUC_UP_BIT)} AS nuc_up",
        f"{nuc(f.exclude_down, NUC_DOWN_BIT)} AS nuc_down", f"({' AND '.join(cls)}) AS class_ok",
    )
    return s.selectExpr(
        "*", "nuc_up OR nuc_down AS nuc", "in_total AND NOT (nuc_up OR nuc_down) AND class_ok AS in_kept"
    )


def _cluster_masks(df: DataFrame, scheme: str | None) -> tuple[DataFrame, list[int]]:
    """Masks recoded to clusters: a cluster bit is set when any member bit is."""
    if not scheme:
        return df, list(CORE_BINS)
    groups = SCHEMES[scheme]

    def recode(c: str) -> str:
        parts = [f"({c} & {~CORE_MASK}L)"]
        parts += [
            f"(CASE WHEN {c} & {sum(1 << k for k in members)}L <> 0 THEN {1 << t}L ELSE 0L END)"
            for t, members in groups.items()
        ]
        return " | ".join(parts)

    rest = [c for c in df.columns if c not in ("u", "m", "meas")]
    return df.selectExpr(
        *rest, f"{recode('u')} AS u", f"{recode('m')} AS m", f"{recode('meas')} AS meas"
    ), sorted(groups)


def final_rows(states: DataFrame, windows: Windows, scheme: str | None = None) -> DataFrame:
    """The final snapshot in long form: (motif, read, zf, bound)."""
    s, core = final_mask(states, windows, scheme)
    bits = [(c, bit_of(c)) for c in core + windows.codes()]
    arr = ", ".join(f"named_struct('zf', {c}, 'p', {p})" for c, p in bits)
    s = s.selectExpr(*PAIR, "u", f"explode(filter(array({arr}), x -> {_bit('fin', 'x.p')} = 1)) AS x")
    return s.selectExpr(*PAIR, "x.zf AS zf", f"CAST({_bit('u', 'x.p')} AS INT) AS bound")


def binding_prob(
    states: DataFrame,
    windows: Windows = Windows(),
    denom: str = "kept",
    scheme: str | None = None,
    total_from_class: bool = False,
    total_has_near_and_tiles: bool = False,
) -> DataFrame:
    """Per (motif, bin) numerator, both denominators and the binding probability.

    Sums of bits per motif, then one unpivot: no per-bin rows are shuffled. With
    ``total_from_class`` a kept denominator restricts the total to the selected class;
    ``total_has_near_and_tiles`` adds the near-flank and tile bins to the total universe.
    """
    s, core = _cluster_masks(states, scheme)
    total_in = "in_total"
    if total_from_class and denom == "kept":
        total_in = "(in_total AND NOT nuc AND class_ok)"
    aggs, rows = [], []
    for c in core + windows.codes():
        p, is_core = bit_of(c), c in core and c not in windows.codes()
        keep = "in_kept" if is_core else "NOT nuc"
        if is_core:
            tot = f"CASE WHEN {total_in} THEN {_bit('meas', p)} ELSE 0L END"
        elif total_has_near_and_tiles and c not in (FLANK_UP, FLANK_DOWN):
            tot = _bit("meas", p)
        else:
            tot = "0L"
        aggs += [
            f"sum(CASE WHEN {keep} THEN {_bit('u', p)} ELSE 0L END) AS n{p}",
            f"sum(CASE WHEN {keep} THEN {_bit('meas', p)} ELSE 0L END) AS k{p}",
            f"sum({tot}) AS t{p}",
        ]
        rows.append([str(c), f"n{p}", f"k{p}", f"t{p}"])
    wide = s.groupBy("motif_id").agg(*_exprs(aggs))
    long = _unpivot(wide, ["motif_id"], ["zf", "num_bound_kept", "den_kept", "den_total"], rows)
    long = long.filter("den_kept > 0 OR den_total > 0")
    if denom == "total":
        long = long.withColumn("den_total", F.greatest("den_total", "den_kept"))
    den = "den_total" if denom == "total" else "den_kept"
    return long.selectExpr(
        "*",
        f"CASE WHEN num_bound_kept > {den} THEN CAST(raise_error('numerator exceeds denominator') AS DOUBLE) "
        f"ELSE {_ratio('num_bound_kept', den)} END AS binding_prob",
    )


def bin_stats(bp: DataFrame) -> DataFrame:
    """N, mean, sd (sample; 0 when n = 1) and sem per bin."""
    g = bp.filter("binding_prob IS NOT NULL").groupBy("zf").agg(*_exprs([
        "count(*) AS n", "avg(binding_prob) AS mean", "coalesce(stddev_samp(binding_prob), 0D) AS sd"]))
    return g.selectExpr("*", "sd / sqrt(n) AS sem")


def motif_reads(pairs: DataFrame, thr: int = 1) -> DataFrame:
    """What D12-D14 need of a pair table with ``sites``: per motif the reads of each core bin, bins at threshold
    and distinct call positions."""
    p = pairs.selectExpr("motif_id", "u | m AS meas", "sites").filter(f"meas & {CORE_MASK}L <> 0")
    w = p.groupBy("motif_id").agg(
        *_exprs([f"sum({_bit('meas', k)}) AS zf{k}_reads" for k in CORE_BINS]), F.expr("CAST(bit_count(bit_or(sites)) AS BIGINT) AS n_sites_called"))
    n = " + ".join(f"CAST(zf{k}_reads >= {thr} AS INT)" for k in CORE_BINS)
    return w.selectExpr("*", f"{n} AS n_zf_mappable")


def mappability_table(reads: DataFrame) -> DataFrame:
    """D12 from ``motif_reads``."""
    return reads.drop("n_sites_called").selectExpr("*", "n_zf_mappable / 11D AS fraction_zf_mappable")


def sites_table(reads: DataFrame) -> DataFrame:
    """D13 from ``motif_reads``."""
    return reads.groupBy("n_sites_called").agg(*_exprs([
        "count(n_zf_mappable) AS n_motifs", "avg(n_zf_mappable) AS mean_zf_mappable",
        "median(n_zf_mappable) AS median_zf_mappable"]))


def balance_table(reads: DataFrame, thr: int = 1) -> DataFrame:
    """D14 from ``motif_reads``."""
    aggs = ["count(*) AS total_sites"]
    for k in CORE_BINS:
        aggs.append(f"count_if(zf{k}_reads >= {thr}) AS s{k}")
        aggs.append(f"coalesce(sum(CASE WHEN zf{k}_reads >= {thr} THEN zf{k}_reads END), 0L) AS r{k}")
    one = reads.agg(*_exprs(aggs))
    total = "(" + " + ".join(f"r{k}" for k in CORE_BINS) + ")"
    return _unpivot(
        one, [], ["zf", "sites_tested", "frac_sites_tested", "reads_tested", "frac_reads_tested"],
        [[str(k), f"s{k}", _ratio(f"s{k}", "total_sites"), f"r{k}", _ratio(f"r{k}", total)] for k in CORE_BINS],
    )


def mappability(cm: DataFrame, thr: int = 1) -> DataFrame:
    """Distinct reads per core bin (11 columns), bins at threshold and their fraction."""
    return mappability_table(motif_reads(pair_masks(cm, sites=True), thr))


def mappability_by_sites(cm: DataFrame, thr: int = 1) -> DataFrame:
    """Mappable bins by the number of distinct call positions of the motif."""
    return sites_table(motif_reads(pair_masks(cm, sites=True), thr))


def bin_balance(cm: DataFrame, thr: int = 1) -> DataFrame:
    """Motifs and reads tested per core bin at threshold, with fractions."""
    return balance_table(motif_reads(pair_masks(cm, sites=True), thr), thr)


def final_mask(states: DataFrame, windows: Windows, scheme: str | None) -> tuple[DataFrame, list[int]]:
    """Measured bits that survive into the final snapshot, as column ``fin``."""
    s, core = _cluster_masks(states, scheme)
    cm_ = sum(1 << k for k in core)
    xm = sum(1 << bit_of(c) for c in windows.codes())
    fin = f"(CASE WHEN in_kept THEN meas & {cm_}L ELSE 0L END) | (CASE WHEN NOT nuc THEN meas & {xm}L ELSE 0L END)"
    return s.selectExpr("*", f"{fin} AS fin"), core


def scatter_stats(
    states: DataFrame, windows: Windows, bins: list[int], scheme: str | None = None, denom: str = "kept"
) -> DataFrame:
    """Motifs, distinct reads and would-be excluded pairs per bin, with the run's totals.

    Distinct reads per bin = bits of the per-read OR of the final masks, so the only shuffles
    are one by motif and one by read. Bins 0 / 12 report the whole excluded set of their side.
    The attribution of excluded pairs uses the unclustered bins.
    """
    s, _ = final_mask(states, windows, scheme)
    pos = {z: bit_of(z) for z in bins}
    defined = "fin" if denom == "kept" else "known"
    mot = (
        s.groupBy("motif_id")
        .agg(*_exprs(["bit_or(fin) AS fin",
                      f"bit_or(fin | CASE WHEN in_total THEN meas & {CORE_MASK}L ELSE 0L END) AS known"]))
        .filter("known <> 0")
        .agg(*_exprs(["count(*) AS total_motifs"] + [f"sum({_bit(defined, p)}) AS m{p}" for p in pos.values()]))
    )
    rd = (
        s.groupBy("read_id")
        .agg(*_exprs(["bit_or(fin) AS fin", f"bool_or(in_kept AND {_DYNAMIC}) AS dyn",
                      "bool_or(in_kept AND n_bound = n_measured) AS sta"]))
        .agg(*_exprs(["count_if(fin <> 0) AS unique_reads", "count_if(dyn) AS dynamic_unique_reads",
                      "count_if(sta) AS static_unique_reads"]
                     + [f"sum({_bit('fin', p)}) AS r{p}" for p in pos.values()]))
    )
    ex = []
    for z, p in pos.items():
        meas = f"(in_total AND {_bit('meas', p)} = 1)" if 1 <= z <= 11 else "false"
        up = {FLANK_UP: "nuc_up", FLANK_DOWN: "false"}.get(z, f"nuc_up AND {meas}")
        dn = {FLANK_UP: "false", FLANK_DOWN: "nuc_down"}.get(z, f"nuc_down AND {meas}")
        ex += [f"count_if({up}) AS u{p}", f"count_if({dn}) AS d{p}"]
    pr = states.agg(*_exprs([f"count_if(in_kept AND {_DYNAMIC}) AS dynamic_pairs",
                             "count_if(in_kept AND n_bound = n_measured) AS static_pairs"] + ex))
    one = _side_by_side(mot, rd, pr)
    tot_r = "(" + " + ".join(f"r{p}" for p in pos.values()) + ")"
    fields = ["bin", "motifs_in_bin", "frac_motifs_in_bin", "reads_in_bin", "frac_reads_in_bin", "excluded_up_pairs",
              "excluded_down_pairs", "total_motifs", "total_reads_bins", "unique_reads", "dynamic_pairs",
              "static_pairs", "dynamic_unique_reads", "static_unique_reads"]
    rows = [
        [str(z), f"m{p}", _ratio(f"m{p}", "total_motifs"), f"r{p}", _ratio(f"r{p}", tot_r), f"u{p}", f"d{p}",
         "total_motifs", tot_r, "unique_reads", "dynamic_pairs", "static_pairs", "dynamic_unique_reads",
         "static_unique_reads"]
        for z, p in pos.items()
    ]
    return _unpivot(one, [], fields, rows)


def _side_by_side(*ones: DataFrame) -> DataFrame:
    """One-row aggregates joined on a constant key."""
    out = None
    for t in ones:
        t = t.withColumn("_k", F.lit(1))
        out = t if out is None else out.join(t, "_k")
    return out.drop("_k")


def qc_summary(states: DataFrame, windows: Windows, bins: list[int], scheme: str | None = None) -> DataFrame:
    """Motifs and reads per bin, motif total and excluded pairs per side."""
    st = scatter_stats(states, windows, bins, scheme).select(
        "bin", "motifs_in_bin", "reads_in_bin", "total_motifs"
    )
    ex = states.agg(*_exprs(["count_if(nuc_up) AS excluded_up", "count_if(nuc_down) AS excluded_down"]))
    return _side_by_side(st, ex)


CATEGORIES = ["bound", "nucleosome", "nothing"]


def _category_side(pairs: DataFrame, side: str) -> DataFrame:
    """Counts and per-motif fraction moments of ``category`` for one denominator."""
    w = pairs.groupBy("motif_id").agg(
        *_exprs(["count(*) AS n"] + [f"count_if(category = '{c}') AS {c}" for c in CATEGORIES])
    )
    aggs = ["count(*) AS n_motifs", "sum(n) AS N"]
    for c in CATEGORIES:
        aggs += [f"coalesce(sum({c}), 0L) AS n_{c}", f"avg({c} / n) AS mean_{c}", f"stddev_samp({c} / n) AS sd_{c}"]
    fields = ["category"] + [f"{x}_{side}" for x in ("n_pairs", "frac_pairs", "n_motifs", "mean", "sd")]
    return _unpivot(
        w.agg(*_exprs(aggs)), [], fields,
        [[f"'{c}'", f"n_{c}", _ratio(f"n_{c}", "N"), "n_motifs", f"mean_{c}", f"sd_{c}"] for c in CATEGORIES],
    )


def read_category_counts(states: DataFrame) -> DataFrame:
    """Exclusive categories, nucleosome > bound > nothing, on total and kept pairs."""
    s = states.selectExpr(
        "*", "CASE WHEN nuc THEN 'nucleosome' WHEN n_bound > 0 THEN 'bound' ELSE 'nothing' END AS category"
    )
    out = None
    for side, flag in (("total", "in_total"), ("kept", "in_kept")):
        t = _category_side(s.filter(flag), side)
        rest = [c for c in t.columns if c != f"sd_{side}"]
        t = t.selectExpr(*rest, f"CASE WHEN n_motifs_{side} = 1 THEN 0D ELSE sd_{side} END AS sd_{side}")
        t = t.selectExpr("*", f"sd_{side} / sqrt(nullif(n_motifs_{side}, 0)) AS sem_{side}")
        out = t if out is None else out.join(t, "category")
    return out


def category_summary(states: DataFrame, windows: Windows) -> DataFrame:
    """Bound > nucleosome > nothing; a kept pair is any pair with a final row, bound when
    a bin other than 0 / 12 is; nucleosome pairs are gone from kept."""
    s, _ = final_mask(states, windows, None)
    ndr = (1 << FLANK_UP) | (1 << FLANK_DOWN)
    tot = s.filter("in_total").selectExpr(
        "motif_id", "CASE WHEN n_bound > 0 THEN 'bound' WHEN nuc THEN 'nucleosome' ELSE 'nothing' END AS category"
    )
    kept = s.filter("fin <> 0").selectExpr(
        "motif_id", f"CASE WHEN fin & u & {~ndr}L <> 0 THEN 'bound' ELSE 'nothing' END AS category"
    )
    a = _category_side(tot, "total").select("category", "mean_total", "sd_total", "n_motifs_total")
    b = _category_side(kept, "kept").select("category", "mean_kept", "sd_kept", "n_motifs_kept")
    return a.join(b, "category")


def dynamic_static_by_k(states: DataFrame, ks: list[int] | None = None) -> DataFrame:
    """Dynamic and static shares among bound pairs for >= K and == K measured bins."""
    rules = [(k, r) for k in (ks or [2, 3, 4, 5]) for r in ("ge", "eq")]
    out = None
    for side, flag in (("total", "in_total"), ("kept", "in_kept")):
        bound = states.filter(f"{flag} AND NOT nuc AND n_bound > 0")
        aggs, rows = [], []
        for k, r in rules:
            sel = f"n_measured {'>=' if r == 'ge' else '='} {k}"
            aggs += [f"count_if({sel}) AS d_{r}{k}", f"count_if({sel} AND n_bound = n_measured) AS s_{r}{k}"]
            rows.append([str(k), f"'{r}'", "'static'", f"d_{r}{k}", f"s_{r}{k}"])
            rows.append([str(k), f"'{r}'", "'dynamic'", f"d_{r}{k}", f"d_{r}{k} - s_{r}{k}"])
        per = bound.groupBy("motif_id").agg(*_exprs(aggs))
        long = _unpivot(per, [], ["k", "rule", "kind", "den", "num"], rows)
        t = long.groupBy("k", "rule", "kind").agg(*_exprs([
            f"sum(num) AS n_pairs_{side}", f"sum(den) AS den_pairs_{side}", f"count_if(den > 0) AS n_motifs_{side}",
            f"avg(try_divide(num, den)) AS mean_{side}", "stddev_samp(try_divide(num, den)) AS sd"]))
        t = t.selectExpr(
            "k", "rule", "kind", f"n_pairs_{side}", f"den_pairs_{side}", f"n_motifs_{side}", f"mean_{side}",
            f"CASE WHEN n_motifs_{side} = 1 THEN 0D ELSE sd END AS sd_{side}",
            f"{_ratio(f'n_pairs_{side}', f'den_pairs_{side}')} AS frac_pairs_{side}",
        ).selectExpr("*", f"sd_{side} / sqrt(nullif(n_motifs_{side}, 0)) AS sem_{side}")
        out = t if out is None else out.join(t, ["k", "rule", "kind"], "full")
    return out


def dynamic_curve(
    states: DataFrame, mode: str = "eq", kmax: int = 5, min_measured: int = 1, use: str = "kept",
    exclude_bins: list[int] | None = None,
) -> DataFrame:
    """Share of dynamic among bound pairs by number of measured bins, with the K=0 anchor."""
    mask = CORE_MASK & ~sum(1 << k for k in (exclude_bins or []))
    p = states.filter("in_kept" if use == "kept" else "in_total").selectExpr(
        f"bit_count(u & {mask}L) AS n", f"bit_count(meas & {mask}L) AS k"
    ).filter(f"k >= {min_measured} AND n > 0")
    ks = range(max(1, min_measured), kmax + 1)
    aggs, rows = ["count(*) AS d0"], [["0", "d0", "0L", "0D"]]
    for q in ks:
        sel = f"k {'=' if mode == 'eq' else '>='} {q}"
        aggs += [f"count_if({sel}) AS d{q}", f"count_if({sel} AND n < k) AS y{q}"]
        rows.append([str(q), f"d{q}", f"y{q}", _ratio(f"y{q}", f"d{q}")])
    return _unpivot(p.agg(*_exprs(aggs)), [], ["k", "den_pairs", "num_dynamic", "frac_dynamic"], rows)


# ---------------------------------------------------------------- conditional probabilities


def cond_states(
    cm: DataFrame,
    bins: list[int],
    windows: Windows = Windows(),
    min_calls: int = 1,
    mol_threshold: int = 0,
    exact: bool = False,
    exclude_up: bool = False,
    exclude_down: bool = False,
    drop_all_bound: bool = False,
    drop_ndr_bound: bool = False,
) -> DataFrame:
    """Exclusion first, then the molecule threshold on the core, then the matrix columns
    ``bins``, then the optional drops, which look at those columns only.

    Adds ``row_meas`` / ``row_u``: the bits of the pair's row in the matrix. Extra bins of a
    pair that fails the threshold stay, as their rows are added after it.
    """
    f = Filters(mol_threshold=mol_threshold, exact=exact, exclude_up=exclude_up, exclude_down=exclude_down)
    s = pair_states(pair_masks(cm, windows, min_calls), f).filter("NOT nuc")
    xm = sum(1 << bit_of(c) for c in windows.codes())
    cols = sum(1 << bit_of(c) for c in bins)
    row = f"((CASE WHEN in_total THEN meas & {CORE_MASK}L ELSE 0L END) | (meas & {xm}L)) & {cols}L"
    s = s.selectExpr(*PAIR, "u", f"{row} AS row_meas").selectExpr(*PAIR, "row_meas", "row_meas & u AS row_u")
    s = s.filter("row_meas <> 0")
    if drop_ndr_bound:
        s = s.filter(f"row_u & {(1 << FLANK_UP) | (1 << FLANK_DOWN)}L = 0")
    if drop_all_bound:
        # a row without any measured core bin counts as all bound
        s = s.filter(f"bit_count(row_u & {CORE_MASK}L) < bit_count(row_meas & {CORE_MASK}L)")
    return s


def cond_prob(s: DataFrame, bins: list[int], v: int) -> DataFrame:
    """D20 + D21: for every ordered bin pair, P(j bound | i = v), the cell count (j measured)
    and the row count of i.

    One row per set bit of i, then sums of bits for all j: at most len(bins) rows per pair
    before map-side combine, len(bins) groups after it.
    """
    arr = ", ".join(f"named_struct('zf', {i}, 'p', {bit_of(i)})" for i in bins)
    hit = f"{_bit('row_meas', 'x.p')} = 1 AND {_bit('row_u', 'x.p')} = {v}"
    rows = s.selectExpr("row_meas", "row_u", f"explode(filter(array({arr}), x -> {hit})) AS i")
    pos = [bit_of(j) for j in bins]
    g = rows.groupBy("i.zf").agg(*_exprs(
        ["count(*) AS n_row"] + [f"sum({_bit('row_meas', p)}) AS n{p}" for p in pos]
        + [f"sum({_bit('row_u', p)}) AS b{p}" for p in pos])).withColumnRenamed("zf", "zf_i")
    return _unpivot(
        g, ["zf_i", "n_row"], ["zf_j", "n_cell", "p_bound"],
        [[str(j), f"n{bit_of(j)}", _ratio(f"b{bit_of(j)}", f"n{bit_of(j)}")] for j in bins],
    )


def cond_diff(a: DataFrame, c: DataFrame) -> DataFrame:
    """Difference of two conditional tables, null where either cell is missing."""
    l = a.select("zf_i", "zf_j", F.col("p_bound").alias("p_a"))
    r = c.select("zf_i", "zf_j", F.col("p_bound").alias("p_b"))
    return l.join(r, ["zf_i", "zf_j"], "full").withColumn("delta", F.col("p_a") - F.col("p_b"))


def bin_pair_counts(masks: DataFrame, bins: list[int]) -> DataFrame:
    """C20: for i < j the pairs with both bins measured, and with both bound.

    One row per measured i of a pair, then sums over all later bins: no self join.
    """
    arr = ", ".join(map(str, bins))
    rows = masks.selectExpr("u", "u | m AS meas", f"explode(filter(array({arr}), k -> {_bit('(u | m)', 'k')} = 1)) AS zf_i")
    g = rows.groupBy("zf_i").agg(*_exprs(
        [f"sum({_bit('meas', j)}) AS n{j}" for j in bins]
        + [f"sum({_bit('u', j)} * {_bit('u', 'zf_i')}) AS b{j}" for j in bins]))
    out = _unpivot(g, ["zf_i"], ["zf_j", "n", "n_both"], [[str(j), f"n{j}", f"b{j}"] for j in bins])
    return out.filter("zf_i < zf_j AND n > 0")


# ---------------------------------------------------------------- selections and exports

# Named bin patterns, (any of these unbound) and (any of these bound).
GROUPS = {"N_open": ([1, 2], [6, 7]), "C_open": ([10, 11], [6, 7]), "ZF2U_ZF6B": ([2], [6])}


def select_group(states: DataFrame, name: str) -> DataFrame:
    """P5: pairs with an unbound bin of one set and a bound bin of another."""
    lo, hi = (sum(1 << k for k in x) for x in GROUPS[name])
    return states.filter(f"(meas & ~u & {lo}L) <> 0 AND (u & {hi}L) <> 0").select(*PAIR)


def global_classes(states: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One exclusive label per pair; ``nuc`` pairs leave static / dynamic / unbound.

    States must carry nucleosome flags; 'mix' = Static + Dynamic and 'all' = every label. ``keep`` names further
    columns of the pairs that stay.
    """
    label = (
        f"CASE WHEN nuc THEN 'Nucleosomes' ELSE element_at(map('static', 'Static', 'dynamic', 'Dynamic', "
        f"'naked', 'Unbound'), {_CLASS_SQL}) END AS label"
    )
    return states.selectExpr(*PAIR, *keep, label).filter("label IS NOT NULL")


def matrix_export(bp: DataFrame, bins: list[tuple[int, str]]) -> DataFrame:
    """Motif x bin matrix in axis order."""
    cells = [f"max(CASE WHEN zf = {z} THEN binding_prob END) AS `{lab}`" for z, lab in bins]
    return bp.filter(F.col("zf").isin([z for z, _ in bins])).groupBy("motif_id").agg(*_exprs(cells))


def points_export(bp: DataFrame, bins: list[tuple[int, str]], denom: str = "kept") -> DataFrame:
    """Long points with counts and the denominator used."""
    lab = F.create_map(*[x for z, l in bins for x in (F.lit(z), F.lit(l))])
    return bp.filter(F.col("zf").isin([z for z, _ in bins])).select(
        "motif_id", "zf", F.element_at(lab, F.col("zf")).alias("label"), "binding_prob", "num_bound_kept",
        "den_kept", "den_total", F.lit(denom).alias("denominator_used"),
    )


def cluster_means(bp: DataFrame, clusters: dict[str, list[int]]) -> DataFrame:
    """Per motif and cluster the mean of its non-null bins, added in bin order so that equal
    inputs give equal means whatever the partitioning."""
    codes = sorted({z for m in clusters.values() for z in m})
    wide = bp.filter(F.col("zf").isin(codes)).groupBy("motif_id").agg(
        *_exprs([f"max(CASE WHEN zf = {z} THEN binding_prob END) AS z{z}" for z in codes]))
    rows = []
    for label, m in clusters.items():
        total = " + ".join(f"coalesce(z{z}, 0D)" for z in m)
        n = " + ".join(f"CAST(z{z} IS NOT NULL AS INT)" for z in m)
        rows.append([f"'{label}'", f"try_divide({total}, {n})"])
    return _unpivot(wide, ["motif_id"], ["cluster", "value"], rows).filter("value IS NOT NULL")
