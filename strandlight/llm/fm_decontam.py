"""Benchmark decontamination with an FM-index per training shard.

A shard is an Arrow batch of documents. Its words become integers: words of the phrases keep their
id, any other word is a break, since no phrase can run across it; stretches too short for the
shortest phrase are left out. The shard's suffixes are sorted, the Burrows-Wheeler transform is put
into a wavelet tree (one bit vector with rank blocks per level), all phrases are searched backwards
at once, and occurrences are located by walking to sampled suffix positions. Located words merge
into removal spans.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A phrase is every run of
``size`` words of an item, or the whole item when it has fewer (but some). Null or wordless texts
have no words and no hits; null or wordless items give no phrase; repeated items count each by its
own id, rows of the same id once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 10
SAMPLE = 16  # every SAMPLE-th suffix position is kept
BLOCK_WORDS = 2_000_000  # phrase words searched (and sent to the workers) at once
RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
_TABLE = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Phrases:
    """Distinct phrases as rows of word ids (padded with 0 on the left) and the items that hold them."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = SIZE):
        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 2) for x in words(text)]
            for i in range(max(1, len(w) - size + 1) if w else 0):
                found.setdefault(tuple(w[i : i + size]), set()).add(item)
        keys = sorted(found)
        self.owners = [sorted(found[k]) for k in keys]
        self.length = np.array([len(k) for k in keys], np.int64)
        self.rows = np.zeros((len(keys), size), np.int64)
        for i, k in enumerate(keys):
            self.rows[i, size - len(k) :] = k
        self.shortest = int(self.length.min()) if keys else 0
        self.sigma = len(self.ids) + 2


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; groups that are settled take no further part."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    head = np.r_[True, s[order][1:] != s[order][:-1]]
    rank = np.empty(n, np.int64)
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = first
    h = 1
    while True:
        last = np.r_[head[1:], True]
        open_ = np.flatnonzero(~(head & last))  # slots in groups of two and more
        if not len(open_):
            return order
        own = order[open_]
        nxt = own + h
        key = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        group = rank[own]
        by = np.lexsort((key, group))
        own, key, group = own[by], key[by], group[by]
        order[open_] = own
        new = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])]
        head[open_] = new
        rank[own] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        h *= 2


class Wavelet:
    """Bit vectors of the levels with cumulative ones; rank(c, i) counts c before position i."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (s >> level) & 1
            c = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=c[1:])
            self.ones.append(c)
            self.zeros.append(len(s) - int(c[-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros_like(i)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one, up = self.ones[k], ((c >> level) & 1) == 1
            a, b = one[start], one[i]
            start, i = np.where(up, self.zeros[k] + a, start - a), np.where(up, self.zeros[k] + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i and its rank there."""
        c, start = np.zeros_like(i), np.zeros_like(i)
        for k in range(self.bits):
            one = self.ones[k]
            up = one[i + 1] > one[i]
            c = 2 * c + up
            a, b = one[start], one[i]
            start, i = np.where(up, self.zeros[k] + a, start - a), np.where(up, self.zeros[k] + b, i - b)
        return c, i - start


class FmIndex:
    """Backward search and location over one integer sequence (symbols >= 1; 0 ends it)."""

    def __init__(self, s: np.ndarray, sigma: int, sample: int = SAMPLE):
        s = np.r_[s, 0]
        order = suffix_order(s)
        self.n = len(s)
        self.tree = Wavelet(s[order - 1], sigma)
        self.first = np.r_[0, np.cumsum(np.bincount(s, minlength=sigma))]
        keep = order % sample == 0
        self.kept = np.r_[0, np.cumsum(keep)]
        self.at = order[keep]

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [lo, hi) of right-aligned patterns padded with 0."""
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), self.n, np.int64)
        for j in range(rows.shape[1] - 1, -1, -1):
            live = np.flatnonzero((rows[:, j] > 0) & (lo < hi))
            c = rows[live, j]
            both = self.tree.rank(np.r_[c, c], np.r_[lo[live], hi[live]]) + np.r_[self.first[c], self.first[c]]
            lo[live], hi[live] = both[: len(live)], both[len(live) :]
        return lo, hi

    def locate(self, slots: np.ndarray) -> np.ndarray:
        """Text positions of suffix slots: step backwards until a sampled position is met."""
        out, walk = np.zeros(len(slots), np.int64), slots.copy()
        open_ = np.arange(len(slots))
        steps = 0
        while len(open_):
            hit = self.kept[walk + 1] > self.kept[walk]
            out[open_[hit]] = self.at[self.kept[walk[hit]]] + steps
            open_, walk = open_[~hit], walk[~hit]
            c, r = self.tree.access(walk)
            walk = self.first[c] + r
            steps += 1
        return out


def shard_hits(texts: list[str | None], ph: Phrases) -> list[tuple[int, int, list[str], list[tuple[int, int]]]]:
    """Per document: number of words, of hit words, items found, merged [start, end) word spans."""
    get = ph.ids.get
    counts, parts, where = [], [], []
    for d, t in enumerate(texts):
        w = words(t)
        counts.append(len(w))
        if len(w) < ph.shortest or not ph.shortest:
            continue
        a = np.fromiter((get(x, 0) for x in w), np.int64, len(w))
        edge = np.flatnonzero(np.diff(np.r_[False, a > 0, False].astype(np.int8)))
        for lo, hi in zip(edge[::2], edge[1::2]):
            if hi - lo >= ph.shortest:
                parts.append(np.r_[a[lo:hi], 1])  # 1 ends a stretch
                where.append((d, lo, hi - lo + 1))
    found: dict[int, list[tuple[int, int, int]]] = {}
    if parts:
        index = FmIndex(np.concatenate(parts), ph.sigma)
        lo, hi = index.search(ph.rows)
        got = np.flatnonzero(hi > lo)
        n = (hi - lo)[got]
        which = np.repeat(got, n)
        slots = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[got], n)
        pos = index.locate(slots)
        starts = np.cumsum([0] + [w[2] for w in where])
        part = np.searchsorted(starts, pos, "right") - 1
        for p, k, x in zip(which.tolist(), part.tolist(), pos.tolist()):
            d, first, _ = where[k]
            at = int(first) + x - int(starts[k])
            found.setdefault(d, []).append((at, at + int(ph.length[p]), p))
    out = []
    for d, n in enumerate(counts):
        spans: list[list[int]] = []
        items: set[str] = set()
        for a, b, p in sorted(found.get(d, [])):
            items.update(ph.owners[p])
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        out.append((n, sum(b - a for a, b in spans), sorted(items), [(a, b) for a, b in spans]))
    return out


def phrase_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int = BLOCK_WORDS) -> list[DataFrame]:
    """The items dealt into blocks of about ``block_words`` words, each small enough to be sent out."""
    rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("i IS NOT NULL")
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-size // (4 * block_words)))
    return [rows.filter(F.pmod(F.xxhash64("i"), F.lit(n)) == k) for k in range(n)]


def hits_column(text: Column, items: list[tuple[str, str | None]], size: int = SIZE) -> Column:
    ph = Phrases(items, size)

    @F.pandas_udf(RESULT)
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            rows = shard_hits([None if t is None or t != t else t for t in s], ph)
            spans = [[{"start": a, "end": b} for a, b in r[3]] for r in rows]
            yield pd.DataFrame({"n_words": [r[0] for r in rows], "n_hit": [r[1] for r in rows], "items": [r[2] for r in rows], "spans": spans})

    return run(text)


def merge_spans(blocks: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(x for spans in blocks for x in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def find_hits(spark: SparkSession, docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
              item_text: str = "text", size: int = SIZE, block_words: int = BLOCK_WORDS, out: str = "_hits") -> DataFrame:
    """docs with a column ``out``: struct(n_words, n_hit, items, spans).

    Phrases go out in blocks of bounded size; several blocks add one column each, and their spans
    and items are merged per row, so no shuffle is needed.
    """
    blocks = phrase_blocks(items, item_col, item_text, block_words)
    names = [f"{out}_{k}" for k in range(len(blocks))]
    df = docs
    for name, b in zip(names, blocks):
        df = df.withColumn(name, hits_column(F.col(text_col), [(r["i"], r["t"]) for r in b.collect()], size))
    if len(names) == 1:
        return df.withColumnRenamed(names[0], out)

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def union(s: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in merge_spans([[(x["start"], x["end"]) for x in v]])] for v in s])

    spans = union(F.flatten(F.array(*[F.col(f"{n}.spans") for n in names])))
    df = df.withColumn(f"{out}_s", spans)
    n_hit = F.aggregate(f"{out}_s", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    every = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{n}.items") for n in names]))))
    all_ = F.struct(F.col(f"{names[0]}.n_words").alias("n_words"), n_hit.alias("n_hit"), every.alias("items"), F.col(f"{out}_s").alias("spans"))
    return df.withColumn(out, all_).drop(*names, f"{out}_s")


def digest(items: Column) -> Column:
    """Lowercase hex sha256 of the item ids in order, comma-joined."""
    return F.sha2(F.concat_ws(",", items), 256)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (and what stands between them)."""
    at = [m.span() for m in WORD.finditer(_lower(text))]
    out, k = [], 0
    for a, b in spans:
        out.append(text[k : at[a][0]])
        k = at[b - 1][1]
    return "".join(out) + text[k:]


def _lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def remove_column(text: Column, hits: Column) -> Column:
    """Texts with their removal spans cut out; texts without spans stay as they are."""

    @F.pandas_udf("string")
    def run(t: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([
            x if x is None or v is None or not len(v) else without_spans(x, [(int(y["start"]), int(y["end"])) for y in v])
            for x, v in zip(t, s)
        ])

    return run(text, hits["spans"])


def sha(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
