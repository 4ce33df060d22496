"""Packing documents into sequences with a bounded number of open windows per partition.

A partition keeps ``open_windows`` windows. A document is cut into full windows plus a rest; the rest
goes to the open window it fills best. When it fits in none, the fullest window is emitted: if its gap
is larger than ``tolerance`` the rest is cut to fill it first. What is open at the end of a partition
are leftovers; they are merged, as whole windows, by the same rule in ever fewer groups until one group
is left. Only (window, used length) rows take part in the merge.

Null text counts as empty: it has the end id alone. Repeated rows are packed as often as they occur. An
empty table gives no pieces. Sequence ids are unique; offsets in a sequence are gapless from 0.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlight.session import cut_lineage

LENGTH = 2048
OPEN_WINDOWS = 32
TOLERANCE = 16  # gaps up to this are padded, larger ones filled by a cut
MERGE = 64  # partitions whose leftovers meet in one group
END = 1
# Fixed value: the split pattern of the byte-level vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

class Encoder:
    """Ids of a byte-level vocabulary file (tokenizers JSON). Its merges are applied by rank, which
    gives the ids of the file's own tokenizer; texts that hold a special token's string go to that
    tokenizer itself."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
        raw = {c: b for b, c in shown.items()}
        ranks = {bytes(raw[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(path)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")

@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)

class Windows:
    """The open windows of one partition: best fit, emit the fullest when none fits."""

    def __init__(self, base: int, count: int, length: int):
        self.base, self.count, self.length = base, count, length
        self.used: dict[int, int] = {}
        self.next = 0

    def _new(self) -> int:
        self.next += 1
        self.used[self.base + self.next - 1] = 0
        return self.base + self.next - 1

    def full(self) -> int:
        """A window of its own, for a piece that fills it."""
        self.next += 1
        return self.base + self.next - 1

    def best(self, n: int) -> int | None:
        fits = [(u, -w) for w, u in self.used.items() if u + n <= self.length]
        if fits:
            return -max(fits)[1]
        return self._new() if len(self.used) < self.count else None

    def fullest(self) -> int:
        return max(self.used, key=lambda w: (self.used[w], -w))

    def put(self, w: int, n: int) -> int:
        at = self.used[w]
        self.used[w] += n
        if self.used[w] == self.length:
            del self.used[w]
        return at

def place(n: int, win: Windows, tolerance: int) -> list[tuple[int, int, int, int]]:
    """(start, length, window, offset) of the pieces of a document of n tokens."""
    out = []
    start = 0
    while n - start >= win.length:
        out.append((start, win.length, win.full(), 0))
        start += win.length
    while start < n:
        w = win.best(n - start)
        size = n - start
        if w is None:
            w = win.fullest()
            gap = win.length - win.used[w]
            if gap <= tolerance:
                del win.used[w]
                continue
            size = gap
        out.append((start, size, w, win.put(w, size)))
        start += size
    return out

def _cut_partition(path: str, length: int, count: int, tolerance: int, id_end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path)
        win = Windows(TaskContext.get().partitionId() << 36, count, length)
        rows: list[tuple] = []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(enc.ids(text.as_py()), np.uint32(id_end)).astype("<u4")
                for s, n, w, at in place(len(ids), win, tolerance):
                    rows.append((doc, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids), w, at))

            yield _batch(rows)
            rows = []
        yield _batch([(None, 0, u, 0, 0, w, -1) for w, u in win.used.items()])

    return run

def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 7
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset"]
    return pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(names, cols)})

def _merge_group(length: int, count: int):
    """Leftover windows (window, used) of a group -> (window, target, base), and the new leftovers."""

    def run(pdf):
        win = Windows(0, count, length)
        name: dict[int, int] = {}  # a merged window is named after the first window it holds
        out = []
        for w, u in sorted(zip(pdf["window"].tolist(), pdf["used"].tolist()), key=lambda x: (-x[1], x[0])):
            k = win.best(u)
            if k is None:
                del win.used[win.fullest()]
                k = win.best(u)
            at = win.put(k, u)
            out.append((w, name.setdefault(k, w), at, k))
        left = {name[k]: u for k, u in win.used.items() if k in name}
        import pandas as pd

        return pd.DataFrame(
            {"window": [x[0] for x in out], "target": [x[1] for x in out], "base": [x[2] for x in out],
             "used": [left.get(x[1], -1) if x[2] == 0 else -1 for x in out]},
        ).astype("int64")

    return run

def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
         open_windows: int = OPEN_WINDOWS, tolerance: int = TOLERANCE, merge: int = MERGE, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    made = rows.mapInArrow(
        _cut_partition(path, length, open_windows, tolerance, end),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long",
    )
    made = cut_lineage(made, "pieces")
    pieces = made.filter("offset >= 0")
    left = made.filter("offset < 0").select("window", F.col("length").alias("used"))
    moves: list[DataFrame] = []
    while left.count() > open_windows or not moves:
        group = F.shiftright("window", 36) if not moves else F.pmod(F.xxhash64("window"), F.lit(1 << 30))
        n = left.count()
        groups = max(1, n // (merge * open_windows))
        g = left.withColumn("g", F.pmod(F.xxhash64(group), F.lit(groups)))
        step = g.groupBy("g").applyInPandas(_merge_group(length, open_windows), "window long, target long, base long, used long")
        step = cut_lineage(step, "merge")
        moves.append(step.select("window", "target", "base"))
        left = step.filter("used >= 0").select(F.col("target").alias("window"), "used")
        if groups == 1:
            break
    to = moves[0]
    for nxt in moves[1:]:
        n = nxt.select(F.col("window").alias("target"), F.col("target").alias("t2"), F.col("base").alias("b2"))
        to = to.join(n, "target", "left").select(
            "window", F.coalesce("t2", "target").alias("target"), (F.col("base") + F.coalesce("b2", F.lit(0))).alias("base"))
    out = pieces.join(to, "window", "left")
    return out.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.coalesce("target", "window").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )
