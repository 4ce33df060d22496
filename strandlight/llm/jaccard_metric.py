"""Exact Jaccard self-join of word-shingle sets in metric space, with the connected groups of its links.

Jaccard distance is a metric on sets. Pivots cut the space into Voronoi regions, documents near a
border are copied into the neighbouring regions as far as the triangle inequality demands, and the
regions are joined recursively. Two levels of pivots are used, because document pivots alone do not
separate unrelated texts (nearly all of their distances are 1, within any window):

1. Pivots that are one-shingle sets {s}. d(x, {s}) is 1 - 1/|x| when s is in x and 1 otherwise, so the
   nearest pivots of x are its own shingles; ties go by one global order (how common its rarest word is
   in a bounded sample, then hash: a shingle is at most as common as its rarest word). A linked pair differs in at most |x| - ceil(t|x|) shingles of x, so x belongs to
   the regions of that many pivots and one more, and no link can lie outside a common region. The
   window of the empty set as a pivot (sizes within the threshold) cuts regions into bands.
2. Document pivots inside a region. A set's shingle counts in 128 hash classes are a contraction: their
   L1 distance never exceeds the size of the symmetric difference. Farthest-first pivots, Voronoi cells
   and windows of twice the largest linkable difference recurse until a cell is small or stops shrinking.
   A second contraction, the parities of the counts in 2,048 further classes, drops pairs that the counts leave
   open: differences cancel in a count, but a class of odd difference always shows.

Regions with equal members are one region. Every document then tries its nearest candidates first,
exactly, on the whole sets; links merge groups, and pairs inside a group need no further look. Rounds try
ever more candidates until no untried pair between two groups is left, so no link between groups is lost
and a crowd of near copies costs a few comparisons per document, not all pairs.

Equal sets are one class before the join. Null or wordless texts have an empty set and link with nothing;
texts with fewer than ``width`` words have their whole sequence as one shingle. A null id keeps its row
with a null group. Shingles are 64-bit hashes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlight.llm.common import components
from strandlight.session import broadcast_if_small, cut_lineage, scratch

WIDTH = 3
THRESHOLD = (9, 10)
CLASSES = 128  # counts above 255 are held at 255, which keeps the map a contraction
PARITY = 2048  # bits: a differing shingle flips one, so sets never differ in fewer shingles than in bits
LEAF = 256  # cells of at most this size are compared at once
PIVOTS = 8
RUN = 200_000  # rows a task holds while it forms regions; only a shingle of more documents is named otherwise
HOT = 20_000  # rows of a region joined in one task; larger regions are dealt in block pairs
SAMPLE_DOCS = 20_000  # bound: documents whose words fix the global order of shingles
COMMON = 300_000  # bound: words known as common
KEY = 6  # bytes of a shingle's hash that name it as a pivot; shingles that share them share a region, no more
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_HASH = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def words(text: str) -> list[bytes]:
    """Words [^ \\t-\\r]+ after lower-casing A-Z: what bytes.lower and bytes.split do."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hashes(text: str | None) -> np.ndarray:
    w = words(text) if text else []
    return np.array([_HASH[x] for x in w], np.uint64)


def _shingle_hashes(a: np.ndarray, width: int) -> np.ndarray:
    k = min(width, len(a))
    h = np.full(len(a) - k + 1, k, np.uint64)
    for j in range(k):
        h = _mix(h * _M1 + a[j : len(a) - k + 1 + j])
    return h


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    a = word_hashes(text)
    return np.unique(_shingle_hashes(a, width)) if len(a) else np.zeros(0, np.uint64)


def ranked(text: str | None, width: int, common: np.ndarray, commonness: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles, ascending, and how common the rarest word of each is."""
    a = word_hashes(text)
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, first = np.unique(_shingle_hashes(a, width), return_index=True)
    if not len(common):
        return h, np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(common, a), len(common) - 1)
    often = np.where(common[at] == a, commonness[at], 0)
    k = min(width, len(a))
    least = np.minimum.reduce([often[j : len(a) - k + 1 + j] for j in range(k)])
    return h, least[first]


def least_overlap(total, num: int, den: int):
    """Smallest intersection of two linked sets whose sizes add up to ``total``."""
    return -(-num * total // (num + den))


def _sketch(h: np.ndarray) -> bytes:
    """Shingle counts of the classes, then the parities of the counts of other, finer classes."""
    counts = np.bincount((h & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)
    odd = np.bincount(((h >> np.uint64(32)) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + np.packbits(odd.astype(np.uint8)).tobytes()


def _features(width: int, num: int, den: int, common: np.ndarray, commonness: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"doc": [], "n": [], "fp": [], "sketch": [], "prefix": []}
            for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
                h, often = ranked(t.as_py(), width, common, commonness)
                n = len(h)
                keep = n - -(-num * n // den) + 1 if n else 0
                top = h[np.lexsort((h, often))[:keep]]
                out["doc"].append(doc)
                out["n"].append(n)
                out["fp"].append(xxhash.xxh3_128_digest(h.tobytes()))
                out["sketch"].append(_sketch(h))
                out["prefix"].append(np.ascontiguousarray(top.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY]).tobytes())
            types = {"doc": pa.int64(), "n": pa.int64(), "fp": pa.binary(), "sketch": pa.binary(), "prefix": pa.binary()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, types[k]) for k, v in out.items()})

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, n, prefix) -> one row (doc, n, s) per pivot, in batches of bounded size whatever the texts' lengths."""
    for b in batches:
        held, size = [], 0
        for doc, n, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            raw = np.frombuffer(p.as_buffer(), np.uint8).reshape(-1, KEY)
            for at in range(0, len(raw), RUN):
                held.append((doc, n, raw[at : at + RUN]))
                size += len(held[-1][2])
                if size >= RUN:
                    yield _pivots(held)
                    held, size = [], 0
        if held:
            yield _pivots(held)


def _pivots(held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    many = [len(r) for _, _, r in held]
    s = np.zeros((sum(many), 8), np.uint8)
    s[:, :KEY] = np.concatenate([r for _, _, r in held])
    doc, n = (np.repeat(np.array([h[k] for h in held], np.int64), many) for k in (0, 1))
    return pa.RecordBatch.from_pydict({"doc": doc, "n": n, "s": s.view("<i8").ravel()})


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text) -> the text compressed: a third of the bytes of its shingle hashes."""
    z = zstandard.ZstdCompressor()
    for b in batches:
        body = [z.compress(t.as_py().encode("utf-8", "surrogatepass")) for t in b.column(1)]
        yield pa.RecordBatch.from_pydict({"doc": b.column(0), "body": pa.array(body, pa.binary())})


def _runs(batches: Iterator[pa.RecordBatch], cols: list[str], key: list[str], rows: int, pieces: bool) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """Rows sorted by ``key``, as (columns, whole): runs of whole groups of about ``rows`` rows. With ``pieces`` a
    group that alone is longer comes in parts (whole = False), so what is held depends on no partition or group."""

    def part(t: dict[str, np.ndarray], a: int, b: int | None = None) -> dict[str, np.ndarray]:
        return {c: v[a:b] for c, v in t.items()}

    def like(t: dict[str, np.ndarray], values: tuple) -> np.ndarray:
        return np.logical_and.reduce([t[c] == v for c, v in zip(key, values)])

    held, n, given = [], 0, None  # given: key of a group of which parts are out
    for b in itertools.chain(batches, [None]):
        if b is not None:
            if b.num_rows:
                held.append({c: b.column(c).to_numpy(zero_copy_only=False) for c in cols})
                n += b.num_rows
            if n < rows:
                continue
        if not n:
            return
        t = {c: np.concatenate([h[c] for h in held]) for c in cols}
        if given is not None:
            m = int(like(t, given).sum())
            if m:
                yield part(t, 0, m), False
                t, n = part(t, m), n - m
            given = given if not n else None
        if n and b is None:
            yield t, True
        elif n:
            last = like(t, tuple(t[c][-1] for c in key))
            start = n - int(last.sum())
            if start:
                yield part(t, 0, start), True
                t, n = part(t, start), n - start
            elif pieces and n >= rows:
                given = tuple(t[c][-1] for c in key)
                yield t, False
                n = 0
        held = [t] if n else []


def _regions(num: int, den: int, rows: int):
    """(s, doc, n), dealt and sorted by s, -> members (r1, r2, doc, home) of bands that hold a pair.

    A region is named by a hash of its members, so equal regions are one; a shingle of more than ``rows``
    documents names its bands itself, as its members are never held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, whole in _runs(batches, ["s", "doc", "n"], ["s"], rows, True):
            s, doc, n = t["s"], t["doc"], t["n"]
            if whole:
                new = np.r_[True, s[1:] != s[:-1]]
                many = ~(new & np.r_[new[1:], True])
                s, doc, n = s[many], doc[many], n[many]
            band = np.floor(np.log(n) / (np.log(den / num) * 1.000001)).astype(np.int64)
            s, doc, band = np.r_[s, s], np.r_[doc, doc], np.r_[band, band + 1]
            home = np.r_[np.ones(len(n), bool), np.zeros(len(n), bool)]
            if not len(s):
                continue
            if not whole:
                r1, r2 = _mix(s.view(np.uint64) ^ _M3), _mix(_mix(s.view(np.uint64) + _M3) + band.view(np.uint64))
                yield pa.RecordBatch.from_pydict({"r1": r1.view(np.int64), "r2": r2.view(np.int64), "doc": doc, "home": home})
                continue
            order = np.lexsort((band, s))
            s, doc, band, home = s[order], doc[order], band[order], home[order]
            start = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (band[1:] != band[:-1])])
            size = np.diff(np.r_[start, len(s)])
            good = (size > 1) & (np.add.reduceat(home.astype(np.int64), start) > 0)
            d = doc.view(np.uint64) * np.uint64(2) + home
            r1 = np.add.reduceat(_mix(d + _M1), start).view(np.int64)
            r2 = np.add.reduceat(_mix(_mix(d ^ _M2)), start).view(np.int64)
            g = np.repeat(np.arange(len(start)), size)
            k = np.flatnonzero(good[g])
            yield pa.RecordBatch.from_pydict({"r1": r1[g[k]], "r2": r2[g[k]], "doc": doc[k], "home": home[k]})

    return run


def widest(big: int, num: int, den: int) -> int:
    """Largest symmetric difference of two linked sets of at most ``big`` shingles.

    It has the parity of the sizes' total and grows along each parity, so the two largest totals decide.
    """
    return max(t - 2 * least_overlap(t, num, den) for t in (2 * big, 2 * big - 1))


def voronoi(sk: np.ndarray, reach: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Cells (own rows, window rows) of L1 vectors, so that rows at most ``reach`` apart share a cell."""
    out, todo = [], [(np.arange(len(sk)), np.zeros(0, np.int64))]
    while todo:
        own, win = todo.pop()
        if len(own) + len(win) <= LEAF or len(own) < 2 * PIVOTS:
            out.append((own, win))
            continue
        x = np.r_[own, win]
        pivots = [own[0]]
        dist = [np.abs(sk[x] - sk[own[0]]).sum(1, dtype=np.int32)]
        for _ in range(PIVOTS - 1):  # farthest first
            far = int(np.minimum.reduce(dist)[: len(own)].argmax())
            pivots.append(own[far])
            dist.append(np.abs(sk[x] - sk[own[far]]).sum(1, dtype=np.int32))
        d = np.stack(dist, 1)
        cell, least = d.argmin(1), d.min(1)
        parts = []
        for q in range(PIVOTS):
            mine = np.flatnonzero(cell[: len(own)] == q)
            near = np.flatnonzero(d[:, q] <= least + 2 * reach)
            near = np.setdiff1d(near, mine)
            if len(mine):
                parts.append((x[mine], x[near]))
        if max(len(a) + len(b) for a, b in parts) > 0.7 * len(x):
            out.append((own, win))  # the pivots do not separate these rows
        else:
            todo += parts
    return out


def region_pairs(doc, n, sk, group, home, block, lo: int, hi: int, num: int, den: int, bits=None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Candidate pairs of one region whose rank for one of the two documents is in [lo, hi). ``bits`` are the parities,
    as 64-bit words; a pair passes or fails by them in every round alike, so ranks stay."""
    sk = sk.astype(np.int16)
    reach = widest(int(n.max()), num, den)
    xs, ys, more = [], [], False
    for own, win in voronoi(sk, reach):
        cols = np.r_[own, win]
        step = max(1, 4_000_000 // (CLASSES * len(cols)))
        for i in range(0, len(own), step):
            rows = own[i : i + step]
            gap = np.abs(sk[rows][:, None] - sk[cols][None]).sum(2, dtype=np.int32)
            total = n[rows][:, None] + n[cols][None]
            room = total - 2 * least_overlap(total, num, den)
            ok = (gap <= room) & (home[rows][:, None] | home[cols][None])
            ok &= den * np.minimum(n[rows][:, None], n[cols][None]) >= num * np.maximum(n[rows][:, None], n[cols][None])
            ok &= doc[rows][:, None] != doc[cols][None]
            if block is not None:
                ok &= block[rows][:, None] != block[cols][None]
            if bits is not None:
                r, c = np.nonzero(ok)
                ok[r, c] = np.bitwise_count(bits[rows[r]] ^ bits[cols[c]]).sum(1, dtype=np.int32) <= room[r, c]
            if not ok.any():
                continue
            order = np.argsort(np.where(ok, gap, 1 << 30), axis=1, kind="stable")
            open_ = np.take_along_axis(ok & (group[rows][:, None] != group[cols][None]), order, 1)
            more = more or bool(open_[:, hi:].any())
            r, c = np.nonzero(open_[:, lo:hi])
            xs.append(doc[rows[r]])
            ys.append(doc[cols[order[r, c + lo]]])
    if not xs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), False
    return np.concatenate(xs), np.concatenate(ys), more


def _join_regions(lo: int, hi: int, num: int, den: int):
    """Rows (r1, r2, i, j, block, doc, home, n, sketch, grp), dealt and sorted by region and document, -> pairs
    (x, y); (-1, -1) when more are left. A task holds some regions at a time, each of at most two blocks."""
    key = ["r1", "r2", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = False
        for col, _ in _runs(batches, [*key, "block", "doc", "home", "n", "grp", "sketch"], key, 2 * HOT, False):
            sk = np.frombuffer(b"".join(col.pop("sketch")), np.uint8).reshape(-1, CLASSES + PARITY // 8)
            sk, bits = sk[:, :CLASSES], np.ascontiguousarray(sk[:, CLASSES:]).view(np.uint64)
            ks = np.stack([col[k] for k in key], 1)
            cut = np.flatnonzero(np.r_[True, (ks[1:] != ks[:-1]).any(1), True])
            xs, ys = [], []
            for a, b in zip(cut[:-1], cut[1:]):
                if b - a < 2 or (col["grp"][a:b] == col["grp"][a]).all():
                    continue
                block = col["block"][a:b] if ks[a, 2] != ks[a, 3] else None
                x, y, more = region_pairs(col["doc"][a:b], col["n"][a:b], sk[a:b], col["grp"][a:b], col["home"][a:b], block, lo, hi, num, den, bits[a:b])
                left = left or more
                xs.append(np.minimum(x, y))
                ys.append(np.maximum(x, y))
            if xs:
                pairs = np.unique(np.stack([np.concatenate(xs), np.concatenate(ys)], 1), axis=0)
                yield pa.RecordBatch.from_pydict({"x": pairs[:, 0], "y": pairs[:, 1]})
        if left:
            yield pa.RecordBatch.from_pydict({"x": pa.array([-1], pa.int64()), "y": pa.array([-1], pa.int64())})

    return run


def _linked(num: int, den: int, width: int):
    """(x, y, bx, by) -> the pairs whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()

        def whole(body: bytes) -> np.ndarray:
            return shingles(z.decompress(body).decode("utf-8", "surrogatepass"), width)

        last, q = None, np.zeros(0, np.uint64)  # rows come sorted by y
        for b in batches:
            keep = []
            for bx, by in zip(b.column(2), b.column(3)):
                if by.as_py() != last:
                    last = by.as_py()
                    q = whole(last)
                p = whole(bx.as_py())
                both = np.sort(np.concatenate([p, q]), kind="stable")
                k = int((both[1:] == both[:-1]).sum())
                keep.append(den * k >= num * (len(p) + len(q) - k))
            m = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_pydict({"u": b.column(0).filter(m), "v": b.column(1).filter(m)})

    return run


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words (hashes) that several of the sampled documents hold, and in how many."""
    few = rows.filter("doc IS NOT NULL").select("doc").orderBy(F.xxhash64("doc"), "doc").limit(SAMPLE_DOCS).distinct()
    held = rows.join(F.broadcast(few), "doc", "left_semi").mapInArrow(_distinct_words, "w long")
    got = held.groupBy("w").count().filter("count > 1").orderBy(F.desc("count"), "w").limit(COMMON).toPandas()
    h, c = got["w"].to_numpy(np.int64).view(np.uint64), got["count"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = [np.unique(word_hashes(t.as_py())) for t in b.column(1)]
        yield pa.RecordBatch.from_pydict({"w": np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)})


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
         threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    num, den = threshold
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("t"))
    common = _common(rows)
    made = rows.mapInArrow(_features(width, num, den, *common), "doc long, n long, fp binary, sketch binary, prefix binary")
    made = cut_lineage(made, "jaccard-f")
    reps = made.filter("n > 0 AND doc IS NOT NULL").groupBy("fp").agg(F.min("doc").alias("rep"))
    reps = cut_lineage(reps, "jaccard-rep")
    one = made.join(reps.select(F.col("rep").alias("doc"), "fp"), ["doc", "fp"], "left_semi")
    spread = one.select("doc", "n", "prefix").mapInArrow(_spread, "doc long, n long, s long")
    spread = spread.repartition("s").sortWithinPartitions("s")
    member = spread.mapInArrow(_regions(num, den, RUN), "r1 long, r2 long, doc long, home boolean").distinct()
    member = cut_lineage(member, "jaccard-r")
    near = member.select("doc").distinct()
    facts = cut_lineage(one.join(near, "doc", "left_semi").select("doc", "n", "sketch").dropDuplicates(["doc"]), "jaccard-d")
    hot = member.groupBy("r1", "r2").count().filter(F.col("count") > HOT)
    hot = cut_lineage(hot.select("r1", "r2", F.ceil(F.col("count") / HOT).cast("int").alias("nb")), "jaccard-h")
    one_block = [F.lit(0).cast("int").alias(c) for c in ("block", "i", "j")]
    dealt = member.select("r1", "r2", "doc", "home", *one_block)
    if not hot.isEmpty():
        large = member.join(hot, ["r1", "r2"]).withColumn("block", F.pmod(F.xxhash64("doc"), "nb").cast("int"))
        large = large.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        pair = [F.least("block", "o").cast("int").alias("i"), F.greatest("block", "o").cast("int").alias("j")]
        large = large.select("r1", "r2", "doc", "home", "block", *pair)
        dealt = dealt.join(hot.select("r1", "r2"), ["r1", "r2"], "left_anti").union(large)

    groups: DataFrame | None = None  # (doc, g) of documents with a link
    lo, hi = 0, 2
    while True:
        d = facts.withColumn("grp", F.col("doc"))
        if groups is not None:
            d = facts.join(groups, "doc", "left").select("doc", "n", "sketch", F.coalesce("g", "doc").alias("grp"))
        with scratch(docs.sparkSession):  # the tables of a round go with it
            cand = dealt.join(d, "doc").repartition("r1", "r2", "i", "j")
            cand = cand.sortWithinPartitions("r1", "r2", "i", "j", "doc").mapInArrow(_join_regions(lo, hi, num, den), "x long, y long")
            cand = cut_lineage(cand, "jaccard-c")
            left = not cand.filter("x = -1 AND y = -1").isEmpty()
            both = _with_texts(cand.filter("NOT (x = -1 AND y = -1)").distinct(), rows)
            new = cut_lineage(both.mapInArrow(_linked(num, den, width), "u long, v long"), "jaccard-l")
            if not new.isEmpty():
                groups = cut_lineage(_merge(groups, new), "jaccard-g", outer=True)
        if not left:
            break
        lo, hi = hi, hi * 16
    if groups is None:
        groups = facts.limit(0).select("doc", F.col("doc").alias("g"))
    out = made.select("doc", "n", "fp").join(reps, "fp", "left")
    out = out.join(groups.withColumnRenamed("doc", "rep"), "rep", "left")
    group = F.when(F.col("doc").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc")).otherwise(F.coalesce("g", "rep"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), group.alias("component_id"))


def _merge(groups: DataFrame | None, links: DataFrame) -> DataFrame:
    """Groups after further links: components of the groups that the links join."""
    if groups is None:
        return components(links, "jaccard-cc").toDF("doc", "g")
    for c in ("u", "v"):
        links = links.join(groups.toDF(c, f"g{c}"), c, "left").withColumn(c, F.coalesce(f"g{c}", c))
    comps = cut_lineage(components(links.select("u", "v"), "jaccard-cc").toDF("g", "to"), "jaccard-to")
    old = groups.join(comps, "g", "left").select("doc", F.coalesce("to", "g").alias("g"))
    fresh = comps.toDF("doc", "g").join(groups, "doc", "left_anti")
    return old.union(fresh)


def _with_texts(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs with both whole texts, compressed; only documents of a pair are read again."""
    used = pairs.select(F.col("x").alias("doc")).union(pairs.select(F.col("y").alias("doc")))
    used = cut_lineage(used.distinct(), "jaccard-u")
    # ids alone, broadcast behind a count of them; beyond it the texts are shuffled by id
    body = rows.join(broadcast_if_small(used), "doc", "left_semi").mapInArrow(_packed, "doc long, body binary")
    body = cut_lineage(body, "jaccard-s")
    return pairs.join(body.toDF("x", "bx"), "x").join(body.toDF("y", "by"), "y").select("x", "y", "bx", "by")
