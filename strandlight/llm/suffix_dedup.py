"""Exact removal of repeated byte strings by sorted suffixes (deep-shallow sorting).

A byte goes when a string of ``length`` bytes that covers it also starts earlier: in a document of a
smaller id, or earlier in the same one. Not every suffix needs sorting. Any ``length`` bytes hold an
anchor, the k-gram of the lowest hash, at the same place wherever they occur, so only anchors that occur
twice matter:

1. Anchors meet by hash. An occurrence whose whole surroundings (all strings of ``length`` bytes that
   hold the anchor) equal those of an earlier one is repeated as a whole; the first of each kind of
   surroundings is looked at further if there are several kinds.
2. For those, the suffixes from the anchor and the reversed prefixes before it are sorted by deep-shallow
   sorting: multikey sorting by 8-byte words to a shallow depth, then a blind trie for each group that is
   still tied. The common-prefix lengths of the two orders give, for every offset, the classes of equal
   strings; the first of a class stays.

Anchor groups that are too large for a task are dealt by the strings themselves: one row per string and a
minimum, which combines before the shuffle. Texts are UTF-8 bytes, null is empty, and matches never cross
documents. A null id takes no part: its row stays whole. Rows of one id are one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlight.session import cut_lineage

LENGTH = 100
GRAM = 32
SHALLOW = 48  # bytes sorted by words before the tries
HOT = 200_000  # kinds of surroundings of one anchor sorted in one task
_B = np.uint64(0x9E3779B97F4A7C15)
_M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ANCHOR = np.dtype([("kh", "<i8"), ("ch", "<i8"), ("doc", "<i8"), ("pos", "<i4")])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_INV = np.uint64(pow(int(_B), -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_POW[0]) < n:
        for k, b in ((0, _B), (1, _INV)):
            p = np.full(2 * n, b, np.uint64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0][:n], _POW[1][:n]


class Rolling:
    """Hashes of any substring from prefix sums; ``twice`` adds a second, independent one."""

    def __init__(self, data: np.ndarray, twice: bool = False):
        p, self.inv = _powers(len(data) + 1)
        d = data.astype(np.uint64) + np.uint64(1)
        self.one = np.r_[np.uint64(0), np.cumsum(d * p[:-1])]
        self.two = np.r_[np.uint64(0), np.cumsum(_mix(d) * p[:-1])] if twice else None

    def spans(self, lo: np.ndarray, hi: np.ndarray, second: bool = False) -> np.ndarray:
        s = self.two if second else self.one
        return _mix((s[hi] - s[lo]) * self.inv[lo] + (hi - lo).astype(np.uint64))


def _slide(h: np.ndarray, w: int, f) -> np.ndarray:
    """f over all windows of w values (doubling steps)."""
    n = len(h) - w + 1
    out, size = h, 1
    while size * 2 <= w:
        out = f(out[:-size], out[size:])
        size *= 2
    return f(out[:n], out[w - size : w - size + n])


def anchors(data: np.ndarray, roll: Rolling, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that are lowest in some window of ``length`` bytes."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(data) - gram + 1)
    h = roll.spans(at, at + gram)
    w = length - gram + 1
    low = _slide(h, w, np.minimum)
    pad = np.zeros(w - 1, np.uint64)
    top = _slide(np.concatenate([pad, low, pad]), w, np.maximum)
    got = np.flatnonzero(top == h)
    return got, h[got]


def _anchor_rows(length: int, gram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
                if doc is None or not t.is_valid:
                    continue
                data = np.frombuffer(t.as_buffer(), np.uint8)
                if len(data) < length:
                    continue
                roll = Rolling(data)
                at, h = anchors(data, roll, length, gram)
                lo, hi = np.maximum(at - (length - gram), 0), np.minimum(at + length, len(data))
                side = ((at - lo) * 1024 + (hi - at)).astype(np.uint64)
                rows = np.zeros(len(at), _ANCHOR)
                rows["kh"] = h.view(np.int64)
                rows["ch"] = _mix(roll.spans(lo, hi) ^ _mix(side)).view(np.int64)
                rows["doc"], rows["pos"] = doc, at
                held.append(rows)
                size += len(rows)
            if size > 400_000:
                yield _dealt(held, buckets)
                held, size = [], 0
        if held:
            yield _dealt(held, buckets)

    return run


def _dealt(held: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Blocks of rows by bucket of their anchor hash."""
    rows = np.concatenate(held)
    bucket = (rows["kh"].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    return pa.RecordBatch.from_pydict(
        {"bucket": pa.array(bucket[cut[:-1]], pa.int32()), "rows": pa.array([rows[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())}
    )


def _by_bucket(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[np.ndarray]:
    """The blocks of a partition, joined bucket by bucket."""
    held: dict[int, list[bytes]] = {}
    for b in batches:
        for k, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.setdefault(k, []).append(r)
    for k in sorted(held):
        yield np.frombuffer(b"".join(held.pop(k)), kind)


def _first(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """True where a row of the sorted order begins a new key."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return new


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchor occurrences -> (doc, pos, kh, need): repeated as a whole, or first of several kinds."""
    for a in _by_bucket(batches, _ANCHOR):
        order = np.argsort(a["kh"], kind="stable")
        new = _first(order, a["kh"])
        a = a[np.sort(order[~(new & np.r_[new[1:], True])])]
        if not len(a):
            continue
        order = np.lexsort((a["pos"], a["doc"], a["ch"], a["kh"]))
        a = a[order]
        a = a[_first(np.arange(len(a)), a["kh"], a["ch"], a["doc"], a["pos"])]
        i = np.arange(len(a))
        group, kind = _first(i, a["kh"]), _first(i, a["kh"], a["ch"])
        g = np.cumsum(group) - 1
        kinds = np.bincount(g, weights=kind)[g]
        keep = ~kind | (kinds > 1)
        a, kind = a[keep], kind[keep]
        for k in np.array_split(np.arange(len(a)), max(1, len(a) // 200_000)):
            yield pa.RecordBatch.from_pydict({"doc": a["doc"][k], "pos": a["pos"][k], "kh": a["kh"][k], "need": kind[k]})


def _context(length: int, gram: int) -> np.dtype:
    return np.dtype([("kh", "<i8"), ("doc", "<i8"), ("pos", "<i4"), ("ll", "u1"), ("rl", "u1"), ("left", "u1", (length - gram,)), ("right", "u1", (length,))])


def surroundings(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Reversed bytes before, bytes from the anchor on (zero padded), and how many of each are real."""
    side = length - gram
    pad = np.concatenate([np.zeros(side, np.uint8), data, np.zeros(length, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(pad, side + length)[at]
    return view[:, side - 1 :: -1] if side else view[:, :0], view[:, side:], np.minimum(at, side), np.minimum(len(data) - at, length)


def _context_rows(length: int, gram: int, buckets: int):
    kind = _context(length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for doc, t, want in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                data = np.frombuffer(t.as_buffer(), np.uint8)
                pos = want.values.field("pos").to_numpy().astype(np.int64)
                if len(pos) and pos.max() + gram > len(data):
                    pos = pos[pos + gram <= len(data)]
                rows = np.zeros(len(pos), kind)
                rows["kh"] = want.values.field("kh").to_numpy()[: len(pos)]
                rows["doc"], rows["pos"] = doc, pos
                rows["left"], rows["right"], rows["ll"], rows["rl"] = surroundings(data, pos, length, gram)
                held.append(rows)
                size += len(rows)
            if size > 100_000:
                yield _dealt(held, buckets)
                held, size = [], 0
        if held:
            yield _dealt(held, buckets)

    return run


class BlindTrie:
    """Orders byte strings of one length by inserting them; an inner node is [depth, {byte: child}]."""

    def __init__(self, strings: list[bytes]):
        self.s, self.width = strings, len(strings[0])
        self.num = [int.from_bytes(x, "big") for x in strings]
        self.root: list | int | None = None
        self.same: dict[int, list[int]] = {}
        for i in range(len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        if self.root is None:
            self.root, self.same[i] = i, [i]
            return
        s, node = self.s[i], self.root
        while type(node) is list:
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else next(iter(node[1].values()))
        x = self.num[i] ^ self.num[node]
        if not x:
            self.same[node].append(i)
            return
        common, leaf = self.width - (x.bit_length() + 7) // 8, node
        self.same[i] = [i]
        up, node = None, self.root
        while type(node) is list and node[0] < common:
            up, node = node, node[1][s[node[0]]]
        if type(node) is list and node[0] == common:
            node[1][s[common]] = i
            return
        made = [common, {self.s[leaf][common]: node, s[common]: i}]
        if up is None:
            self.root = made
        else:
            up[1][s[up[0]]] = made

    def order(self) -> tuple[list[int], list[int]]:
        """The strings in order, and the common prefix of each with the one before it (0 for the first)."""
        out: list[int] = []
        lcp: list[int] = []
        todo: list[tuple] = [(self.root, 0)]
        while todo:
            node, depth = todo.pop()
            if type(node) is list:
                kids = [node[1][c] for c in sorted(node[1])]
                todo += [(k, node[0]) for k in reversed(kids[1:])] + [(kids[0], depth)]
            else:
                out += self.same[node]
                lcp += [depth] + [self.width] * (len(self.same[node]) - 1)
        return out, lcp


def deep_shallow(rows: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of equal-length byte rows inside their groups, and common prefixes with the row before."""
    n, width = rows.shape
    words = -(-width // 8)
    wide = np.zeros((n, words * 8), np.uint8)
    wide[:, :width] = rows
    key = wide.view(">u8")
    order, lcp = np.argsort(group, kind="stable"), np.zeros(n, np.int64)
    tied = np.arange(n)  # slots whose row is not yet told from its neighbours
    run = group[order]
    for w in range(min(words, shallow // 8)):
        if not len(tied):
            break
        k = key[order[tied], w].astype(np.uint64)
        by = np.lexsort((k, run))
        k, run = k[by], run[by]
        order[tied] = order[tied[by]]
        first = np.r_[True, run[1:] != run[:-1]]
        x = np.r_[np.uint64(0), k[1:] ^ k[:-1]]
        differ = ~first & (x > 0)
        lcp[tied[differ]] = np.minimum(w * 8 + _leading(x[differ]), width)
        new = first | differ
        alone = new & np.r_[new[1:], True]
        run = np.cumsum(new)
        lcp[tied[~new]] = min(w * 8 + 8, width)
        tied, run = tied[~alone], run[~alone]
    done = min(words, shallow // 8) * 8
    if len(tied) and done < width:
        cut = np.flatnonzero(np.r_[True, run[1:] != run[:-1], True])
        for a, b in zip(cut[:-1], cut[1:]):
            at = tied[a:b]
            own = order[at]
            o, c = BlindTrie([rows[i, done:].tobytes() for i in own]).order()
            order[at] = own[o]
            lcp[at[1:]] = done + np.array(c[1:], np.int64)
    return order, lcp


def _leading(x: np.ndarray) -> np.ndarray:
    """Zero bytes at the head of big-endian words."""
    out = np.zeros(len(x), np.int64)
    for k in range(1, 8):
        out += x < (np.uint64(1) << np.uint64(64 - 8 * k))
    return out


def repeated(a: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context rows of whole anchor groups -> rows with a repeated string, and the bytes [lo, hi) around the anchor."""
    a = a[np.lexsort((a["pos"], a["doc"]))]
    n = len(a)
    _, group = np.unique(a["kh"], return_inverse=True)
    side = length - gram
    most, least = np.full(n, -1, np.int64), np.full(n, length, np.int64)
    ro, rc = deep_shallow(a["right"], group)
    lo, lc = deep_shallow(a["left"], group)
    rnew, lnew = _first(ro, group), _first(lo, group)
    cls_r, cls_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(side + 1):
        cls_r[ro] = np.cumsum(rnew | (rc < length - o))
        cls_l[lo] = np.cumsum(lnew | (lc < o))
        use = np.flatnonzero((a["ll"] >= o) & (a["rl"] >= length - o))
        if len(use) < 2:
            continue
        key = cls_r[use] * (n + 1) + cls_l[use]
        _, first = np.unique(key, return_index=True)
        again = np.ones(len(use), bool)
        again[first] = False
        hit = use[again]
        most[hit] = np.maximum(most[hit], o)
        least[hit] = np.minimum(least[hit], o)
    got = np.flatnonzero(most >= 0)
    return a[got], -most[got], length - least[got]


def _compare(length: int, gram: int):
    kind = _context(length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a in _by_bucket(batches, kind):
            a = a[_first(np.arange(len(a)), a["kh"], a["doc"], a["pos"])] if len(a) else a
            a, lo, hi = repeated(a, length, gram)
            if len(a):
                yield pa.RecordBatch.from_pydict({"doc": a["doc"], "lo": a["pos"] + lo, "hi": a["pos"] + hi})

    return run


def _strings(length: int, gram: int):
    """Every string of ``length`` bytes around the wanted anchors, as two hashes: the way of hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, t, want in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                data = np.frombuffer(t.as_buffer(), np.uint8)
                pos = want.values.field("pos").to_numpy().astype(np.int64)
                at = np.unique((pos[:, None] - np.arange(length - gram + 1)[None]).ravel())
                at = at[(at >= 0) & (at + length <= len(data))]
                roll = Rolling(data, True)
                yield pa.RecordBatch.from_pydict({
                    "h1": roll.spans(at, at + length).view(np.int64), "h2": roll.spans(at, at + length, True).view(np.int64),
                    "doc": np.full(len(at), doc, np.int64), "lo": at,
                })

    return run


def _finish(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"doc_id": b.column(0).to_pylist(), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": []}
            for t, s in zip(b.column(1), b.column(2)):
                data = t.as_buffer().to_pybytes() if t.is_valid else b""
                spans = []
                if s.is_valid:
                    lo, hi = s.values.field("lo").to_numpy(), s.values.field("hi").to_numpy()
                    lo, hi = np.maximum(lo, 0), np.minimum(hi, len(data))
                    order = np.argsort(lo[hi - lo >= length], kind="stable")
                    lo, hi = lo[hi - lo >= length][order], hi[hi - lo >= length][order]
                    if len(lo):
                        top = np.maximum.accumulate(hi)
                        new = np.r_[True, lo[1:] > top[:-1]]
                        spans = list(zip(lo[new].tolist(), top[np.r_[new[1:], True]].tolist()))
                kept, at = hashlib.sha256(), 0
                for x, y in spans:
                    kept.update(data[at:x])
                    at = y
                kept.update(data[at:])
                out["n_bytes"].append(len(data))
                out["n_removed"].append(sum(y - x for x, y in spans))
                out["n_spans"].append(len(spans))
                out["kept_sha256"].append(kept.hexdigest())
                out["spans"].append([{"start": x, "end": y} for x, y in spans])
            kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(),
                     "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in out.items()})

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed runs)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("t"))
    buckets = 4 * max(128, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.mapInArrow(_anchor_rows(length, gram, buckets), "bucket int, rows binary").repartition("bucket")
    seen = cut_lineage(dealt.mapInArrow(_resolve, "doc long, pos int, kh long, need boolean"), "anchors")
    need = seen.filter("need")
    crowd = cut_lineage(need.groupBy("kh").count().filter(F.col("count") > hot).select("kh"), "hot-anchors")
    parts = [seen.filter("NOT need").select("doc", (F.col("pos") - (length - gram)).alias("lo"), (F.col("pos") + length).alias("hi"))]

    def wanted(n: DataFrame) -> DataFrame:
        by_doc = n.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", "kh"))).alias("want"))
        return rows.filter("t IS NOT NULL").join(by_doc, "doc").select("doc", "t", "want")

    usual = need
    if not crowd.isEmpty():
        usual = need.join(crowd, "kh", "left_anti")
        s = wanted(need.join(crowd, "kh", "left_semi")).mapInArrow(_strings(length, gram), "h1 long, h2 long, doc long, lo long")
        s = cut_lineage(s, "hot-strings")
        first = s.groupBy("h1", "h2").agg(F.min(F.struct("doc", "lo")).alias("first"))
        again = s.join(first, ["h1", "h2"]).filter(F.struct("doc", "lo") > F.col("first"))
        parts.append(again.select("doc", "lo", (F.col("lo") + length).alias("hi")))
    dealt = wanted(usual).mapInArrow(_context_rows(length, gram, buckets), "bucket int, rows binary").repartition("bucket")
    parts.append(cut_lineage(dealt.mapInArrow(_compare(length, gram), "doc long, lo long, hi long"), "repeats"))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.union(p)
    spans = all_.groupBy("doc").agg(F.collect_list(F.struct(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))).alias("s"))
    out = rows.join(spans, "doc", "left").select("doc", "t", "s").mapInArrow(
        _finish(length, gram),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>",
    )
    return out
