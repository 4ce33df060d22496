"""Document likelihood under a subword lattice, next to a smoothed word-unigram base.

A word's lattice has the pieces of an existing public vocabulary, all single bytes, and, for words of the
training texts, one edge over the whole word. Whole-word edges score their count less a discount; what the
discounts leave is the score of entering the pieces. Piece scores start from the vocabulary's own order and
are fitted by expectation maximisation on what the pieces have to explain: the discounted part of every
training word. All segmentations count: a forward recursion in log space gives a word's marginal
probability, and a document's is the product over its words and an end mark. Words are independent given
the scores, so each distinct word is scored once.

Word counts cover all training documents. The most frequent words (a bounded number) travel to the tasks;
all others, which no key can crowd, are joined by word and summed per document. Null or empty texts consist
of the end mark. Without training documents all counts are 0 and pieces keep their starting scores.
Scores are log10. Rows of one id are one document when the id is used as key; a null id is never trained on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlight.session import cut_lineage

FREQUENT = 200_000  # bound: words that travel to the tasks
MAX_PIECE = 16  # bytes of a piece, blank included
EM_ROUNDS = 2
DISCOUNT = 0.75  # of a training word's count, left to its pieces
FLOOR = 0.1  # added to every expected piece count
ALPHA = 0.1
HELD = 500_000  # distinct words that a task counts before it hands them on
_B = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def words(text: str | None) -> list[bytes]:
    """Words [^ \\t-\\r]+ after lower-casing A-Z: what bytes.lower and bytes.split do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Pieces:
    """Vocabulary pieces with natural-log scores, found by hash."""

    def __init__(self, names: list[bytes]):
        names = list(dict.fromkeys([*names, *(bytes([b]) for b in range(256))]))
        self.names = [n for n in names if 0 < len(n) <= MAX_PIECE]
        self.longest = max(len(n) for n in self.names)
        self.set_scores(1 / (np.arange(len(self.names)) + 10.0))
        size = 1 << max(12, (16 * len(self.names)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.ids, self.probes = np.zeros(size, np.uint64), np.full(size, -1, np.int32), 1
        for i, n in enumerate(self.names):
            h = self._hash(n)
            at, k = int(_slot(h) & self.mask), 1
            while self.ids[at] >= 0:
                at, k = (at + 1) & int(self.mask), k + 1
            self.keys[at], self.ids[at] = h, i
            self.probes = max(self.probes, k)

    @staticmethod
    def _hash(n: bytes) -> np.uint64:
        h = 0
        for k, b in enumerate(n):
            h += (b + 1) * pow(int(_B), k, 1 << 64)
        return np.uint64(h & (1 << 64) - 1)

    def set_scores(self, weight: np.ndarray) -> None:
        self.logp = np.log(weight / weight.sum())

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 where there is none."""
        at = _slot(h) & self.mask
        out = np.where(self.keys[at] == h, self.ids[at], -1)
        for _ in range(self.probes - 1):
            at = (at + np.uint64(1)) & self.mask
            out = np.where((out < 0) & (self.keys[at] == h), self.ids[at], out)
        return out


def _slot(h):
    with np.errstate(over="ignore"):
        return (h * _MIX) >> np.uint64(40)


def _lattice(m: np.ndarray, ps: Pieces) -> tuple[dict[tuple[int, int], np.ndarray], np.ndarray]:
    """Edges (end, length) -> piece ids per row, and forward log sums, of equally long words."""
    n, size = m.shape
    pw = np.r_[np.uint64(1), np.multiply.accumulate(np.full(size, _B, np.uint64))]
    inv = np.r_[np.uint64(1), np.multiply.accumulate(np.full(size, _INV, np.uint64))]
    pre = np.zeros((size + 1, n), np.uint64)
    np.cumsum((m.T.astype(np.uint64) + np.uint64(1)) * pw[:size, None], axis=0, out=pre[1:])
    edges: dict[tuple[int, int], np.ndarray] = {}
    a = np.zeros((size + 1, n))
    lp = np.r_[ps.logp, -1e30]  # id -1
    for j in range(1, size + 1):
        most = min(j, ps.longest)
        ids = np.stack([ps.find((pre[j] - pre[j - k]) * inv[j - k]) for k in range(1, most + 1)])
        for k in range(1, most + 1):
            edges[j, k] = ids[k - 1]
        x = lp[ids] + a[j - most : j][::-1]
        top = x.max(0)
        a[j] = top + np.log(np.exp(x - top).sum(0))
    return edges, a


def _by_length(ws: list[bytes], cells: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Equally long words (blank in front) as byte matrices, with their places."""
    size = np.array([len(w) + 1 for w in ws])
    order = np.argsort(size, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(size[order]) > 0, True])
    for a, b in zip(cut[:-1], cut[1:]):
        step = max(1, cells // int(size[order[a]]))
        for i in range(a, b, step):
            at = order[i : min(b, i + step)]
            yield np.frombuffer(b"".join(b" " + ws[k] for k in at), np.uint8).reshape(len(at), -1), at


def marginals(ws: list[bytes], ps: Pieces) -> np.ndarray:
    """Natural-log marginal probability of each word."""
    out = np.zeros(len(ws))
    for m, at in _by_length(ws) if ws else ():
        out[at] = _lattice(m, ps)[1][-1]
    return out


def expected(ws: list[bytes], counts: np.ndarray, ps: Pieces) -> np.ndarray:
    """Expected piece counts of the words, each taken ``counts`` times."""
    out = np.zeros(len(ps.names) + 1)  # the last is for id -1
    lp = np.r_[ps.logp, -1e30]
    for m, at in _by_length(ws) if ws else ():
        edges, a = _lattice(m, ps)
        size = m.shape[1]
        b = np.zeros_like(a)
        for i in range(size - 1, -1, -1):
            most = min(size - i, ps.longest)
            x = np.stack([lp[edges[i + k, k]] + b[i + k] for k in range(1, most + 1)])
            top = x.max(0)
            b[i] = top + np.log(np.exp(x - top).sum(0))
        for (j, k), ids in edges.items():
            p = np.exp(a[j - k] + lp[ids] + b[j] - a[-1]) * counts[at]
            out += np.bincount(np.where(ids < 0, len(out) - 1, ids), weights=p, minlength=len(out))
    return out[:-1]


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a sentencepiece vocabulary file in its order, blanks for their marks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    keep = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return [sp.id_to_piece(i).replace("▁", " ").encode() for i in keep]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, train) -> (word, count in training texts); words of held-out texts come with 0."""
    seen: Counter = Counter()
    other: set[bytes] = set()

    def flush() -> pa.RecordBatch:
        ws = list(seen) + [w for w in other if w not in seen]
        c = list(seen.values()) + [0] * (len(ws) - len(seen))
        seen.clear()
        other.clear()
        return pa.RecordBatch.from_pydict({"w": pa.array(ws, pa.binary()), "c": pa.array(c, pa.int64())})

    for b in batches:
        for t, train in zip(b.column(0), b.column(1).to_pylist()):
            if train:
                seen.update(words(t.as_py()))
            else:
                other.update(words(t.as_py()))
            if len(seen) + len(other) > HELD:
                yield flush()
    yield flush()


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.Table]:
    """Batches joined to tables of about ``rows`` rows: lattices of many equally long words run as one."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _sum_pieces(ps: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ps.names))
        for b in _gathered(batches):
            total += expected(b.column(0).to_pylist(), np.minimum(b.column(1).to_numpy(), DISCOUNT), ps)
        got = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(got, pa.int64()), "n": pa.array(total[got], pa.float64())})

    return run


def whole_word(ws: list[bytes], counts: np.ndarray, n: int, enter: float, ps: Pieces) -> np.ndarray:
    """log10 marginal of each word: its whole-word edge together with all piece paths (``enter``: their share)."""
    pieces = marginals(ws, ps) + np.log(enter)
    edge = np.maximum(counts - DISCOUNT, 0) / max(n, 1)
    return np.logaddexp(pieces, np.log(np.maximum(edge, 1e-300))) / np.log(10)


def _score_words(ps: Pieces, n: int, enter: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches):
            p = whole_word(b.column(0).to_pylist(), b.column(1).to_numpy(), n, enter, ps)
            yield from b.append_column("p", pa.array(p, pa.float64())).to_batches()

    return run


def most_frequent(scored: DataFrame, most: int) -> pa.Table:
    """w, b, p of the words with the highest training counts, at most ``most`` in all.

    Words are counted by step of their count (eight to a doubling) and by 64 shares of each step, and whole shares are
    taken from the top. So the driver gets that small table and the chosen rows, however many partitions there are.
    """
    scored = scored.filter("c > 0").withColumn("key", F.floor(F.log2("c") * 8) * 64 + F.pmod(F.xxhash64("w"), F.lit(64)))
    cut, left = 1 << 62, most
    for r in sorted(scored.groupBy("key").agg(F.count("*").alias("n")).collect(), reverse=True):
        if r["n"] > left:
            break
        cut, left = r["key"], left - r["n"]
    return scored.filter(F.col("key") >= cut).select("w", "b", "p").toArrow().combine_chunks()


def _frequent_part(frequent: pa.Table):
    """(row, text) -> sums over its frequent words, and its other words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, p = (x.to_pylist() for x in frequent.columns)
        get = dict(zip(w, zip(b, p))).get
        for b in batches:
            n, base, score, hit, ws, cs = [], [], [], [], [], []
            for t in b.column("t"):
                tf = Counter(words(t.as_py()))
                s0 = s1 = 0.0
                k, rest, rc = 0, [], []
                for w, c in tf.items():
                    x = get(w)
                    if x is None:
                        rest.append(w)
                        rc.append(c)
                    else:
                        s0 += c * x[0]
                        s1 += c * x[1]
                        k += c
                n.append(tf.total())
                base.append(s0)
                score.append(s1)
                hit.append(k)
                ws.append(rest)
                cs.append(rc)
            yield pa.RecordBatch.from_pydict({
                "row": b.column("row"), "doc_id": b.column("doc_id"), "held": b.column("held"), "n": pa.array(n, pa.int64()),
                "base": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64()), "known": pa.array(hit, pa.int64()),
                "ws": pa.array(ws, pa.list_(pa.binary())), "cs": pa.array(cs, pa.list_(pa.int32())),
            })

    return run


def score(docs: DataFrame, held_out: Column, path: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = EM_ROUNDS,
          frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from rows that are not held out."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"),
        F.coalesce(held_out, F.lit(False)).alias("held"), (F.col(id_col).isNotNull() & F.coalesce(~held_out, F.lit(False))).alias("train"))
    counts = rows.select("t", "train").mapInArrow(_count, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))
    counts = cut_lineage(counts, "lm-counts")
    total = counts.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    ends = rows.filter("train").count()
    n, v = (total["n"] or 0) + ends, total["v"] + (ends > 0)

    ps = Pieces(vocabulary(path))
    for _ in range(rounds):
        got = counts.filter("c > 0").mapInArrow(_sum_pieces(ps), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        weight = np.full(len(ps.names), FLOOR)
        for r in got:
            weight[r["piece"]] += r["n"]
        ps.set_scores(weight)
    # discounts, and half a count each for the end mark and for pieces when nothing was seen
    enter = (DISCOUNT * total["v"] + 0.5) / (n + 1)
    end_score = float(np.log10((ends + 0.5) / (n + 1)))

    scored = cut_lineage(counts.mapInArrow(_score_words(ps, n + 1, enter), "w binary, c long, p double"), "lm-words")

    def base(c):
        return F.log10((c + ALPHA) / F.lit(n + ALPHA * (v + 1)))

    scored = scored.select("w", F.when(F.col("c") > 0, 1).otherwise(0).alias("k"), base(F.col("c")).alias("b"), "p", "c")
    parts = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held", "t").mapInArrow(
        _frequent_part(most_frequent(scored, frequent)),
        "row long, doc_id long, held boolean, n long, base double, score double, known long, ws array<binary>, cs array<int>")
    parts = cut_lineage(parts, "lm-parts")
    rare = parts.filter(F.size("ws") > 0).select("row", F.explode(F.arrays_zip("ws", "cs")).alias("x"))
    rare = rare.select("row", F.col("x.ws").alias("w"), F.col("x.cs").alias("f")).join(scored, "w")
    rare = rare.groupBy("row").agg(F.sum(F.col("f") * F.col("b")).alias("b"), F.sum(F.col("f") * F.col("p")).alias("p"), F.sum(F.col("f") * F.col("k")).alias("k"))
    end_base = float(np.log10((ends + ALPHA) / (n + ALPHA * (v + 1))))
    zero = F.lit(0.0)
    return parts.drop("ws", "cs").join(rare, "row", "left").select(
        "doc_id", F.col("held").alias("held_out"), (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("k", F.lit(0)) + (1 if ends else 0)).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero) + end_base).alias("base_score"), (F.col("score") + F.coalesce("p", zero) + end_score).alias("score"))
