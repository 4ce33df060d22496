"""Toxic spans by a linear-chain conditional random field; documents by the marginals of their tokens.

Tokens are runs of letters, compared in lower case; a chain has two tags, outside and toxic. Labels exist for
documents only, so tokens are labelled first: words and word beginnings that stand out in labelled toxic
documents (log-likelihood ratio beyond what chance gives among that many candidates, and nearly absent from
clean ones) mark the toxic tokens of toxic documents; every token of a clean document is outside. The field is
trained on these tags by exact forward-backward gradients, on windows of a bounded sample of documents.

A text's score is the largest toxic marginal of its tokens, so a long clean text does not add up to a toxic one;
runs of tokens whose marginal is at least one half are its spans (code points, end exclusive).

Forward and backward messages run over whole texts, however long: the tokens of many texts form one chain with
restarts, cut into blocks whose 2 x 2 transfer matrices chain, so no step is a Python loop over tokens.

Null text, empty text or text without a letter: score 0, no spans. No usable label of either kind: score 0
everywhere. A document with labels of both kinds counts as toxic. Repeated rows get equal answers; further
columns are left alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOXIC_DOCS = 2500  # bound: labelled toxic documents that train the field
CLEAN_DOCS = 7500  # bound: labelled clean documents that do
WINDOWS = 3  # bound: training windows around tokens of the lexicon per document; a clean one gives one more
SIDE = 12  # tokens on either side of the middle of a training window
BUCKETS = 1 << 18  # hashed features
PURITY = 0.9  # share of toxic documents (classes weighted alike) from which a feature can label tokens
LEXICON = 20_000  # bound: features that label tokens
GROUP = 400_000  # tokens whose messages are held at once
RESULT = "score double, spans array<struct<start: int, end: int>>"
TOKEN = re.compile(r"[^\W\d_]+")


def stems(word: str) -> list[str]:
    """The features that can label a token: the word and its beginnings."""
    return [f"={word}", *[f"{word[:k]}-" for k in (4, 5, 6) if len(word) >= k]]


def features(word: str) -> list[int]:
    """Hashed features of a token by itself."""
    own = [f"={word}", *[f"{word[:k]}-" for k in (3, 4, 5, 6) if len(word) >= k], *[f"-{word[-k:]}" for k in (3, 4) if len(word) >= k]]
    return [zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in own]


def beside(word: str | None, side: str) -> int:
    """Hashed feature of a neighbour (None: border of the text)."""
    return zlib.crc32(f"{side}{word}".encode("utf-8", "replace")) % BUCKETS if word is not None else zlib.crc32(side.encode()) % BUCKETS


# ------------------------------------------------------------------ messages


def _scan(ratio: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Forward messages (toxic against outside), each with its own emission, over texts laid end to end.

    ``ratio`` is the emission of the toxic tag against the outside one; ``first`` marks where a text starts.
    """
    n = len(ratio)
    length = max(1, min(256, int(n**0.5)))
    blocks = -(-n // length)
    pad = blocks * length - n
    em = np.ascontiguousarray(np.concatenate([ratio, np.ones(pad)]).reshape(blocks, length).T)
    new = np.ascontiguousarray(np.concatenate([first, np.zeros(pad, bool)]).reshape(blocks, length).T)
    some = new.any(1)
    begin = start[1] / start[0]

    # what a block does to either pure message; sizes are kept as logarithms every few steps
    m = np.zeros((2, 2, blocks))  # pure message, tag, block
    m[0, 0] = m[1, 1] = 1
    size = np.zeros((2, blocks))
    for t in range(length):
        out, bad = m[:, 0] * trans[0, 0] + m[:, 1] * trans[1, 0], m[:, 0] * trans[0, 1] + m[:, 1] * trans[1, 1]
        if some[t]:
            whole = m.sum(1)
            out, bad = np.where(new[t], whole * start[0], out), np.where(new[t], whole * start[1], bad)
        m[:, 0], m[:, 1] = out, bad * em[t]
        if t % 4 == 3 or t == length - 1:
            z = m.sum(1)
            size += np.log(z)
            m /= z[:, None]
    lead = np.empty(blocks)
    scale = np.exp(size - size.max(0))
    m *= scale[:, None]
    (a0, b0), (a1, b1) = ((m[k, 0].tolist(), m[k, 1].tolist()) for k in range(2))
    x, y = 0.5, 0.5
    for i in range(blocks):  # one small step per block
        lead[i] = y / x if x > 0 else 1e300
        x, y = x * a0[i] + y * a1[i], x * b0[i] + y * b1[i]
        s = x + y
        x, y = x / s, y / s
    r = lead
    res = np.empty((length, blocks))
    for t in range(length):  # all blocks at once
        r = (trans[0, 1] + r * trans[1, 1]) / (trans[0, 0] + r * trans[1, 0])
        if some[t]:
            r = np.where(new[t], begin, r)
        r = r * em[t]
        res[t] = r
    return res.T.reshape(-1)[:n]


def marginals(e: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Toxic marginal of every token and, on request, the joint of each token that is not the first of a text
    and the one before it (N, 2, 2). ``e``: log emission of toxic against outside; trans, start: positive weights."""
    n = len(e)
    ratio = np.exp(np.clip(e, -40, 40))
    alpha = _scan(ratio, first, trans, start)
    last = np.r_[first[1:], True]
    # backward message with its own emission: the same walk from the other end; a text starts from (1, 1)
    rev = _scan(ratio[::-1], last[::-1], np.ascontiguousarray(trans.T), np.ones(2))[::-1]
    odds = alpha / ratio * rev
    post = odds / (1 + odds)
    if not pairs:
        return post, None
    a, b = (np.stack([1 / (1 + v), v / (1 + v)], 1) for v in (alpha, rev))
    joint = np.zeros((n, 2, 2))
    joint[1:] = a[:-1, :, None] * trans * b[1:, None, :]
    joint /= np.maximum(joint.sum((1, 2), keepdims=True), 1e-300)
    joint[first] = 0
    return post, joint


# ------------------------------------------------------------------ the field


class Field:
    """Weights of hashed features (toxic against outside), log transitions and log start."""

    def __init__(self):
        self.w = np.zeros(BUCKETS, np.float64)
        self.bias, self.trans, self.start = -3.0, np.zeros((2, 2)), np.zeros(2)

    def fit(self, texts: list[list[str]], tags: list[list[int]], rounds: int = 60, rate: float = 0.3, ridge: float = 1e-6) -> "Field":
        """Gradient steps with per-weight scale on the mean log-likelihood of the tags. Every other step hides
        the words themselves, so that beginnings and endings learn to stand alone for words never seen."""
        words: dict[str, int] = {}
        ids = np.array([words.setdefault(w, len(words)) for t in texts for w in t], np.int64)
        y = np.array([v for t in tags for v in t], np.float64)
        first = np.zeros(len(ids), bool)
        first[np.cumsum([0, *[len(t) for t in texts[:-1]]])] = True
        last = np.r_[first[1:], True]
        prev, nxt = np.r_[-1, ids[:-1]], np.r_[ids[1:], -1]
        prev[first], nxt[last] = len(words), len(words)
        own = [features(w) for w in words]
        of_all = np.repeat(np.arange(len(own)), [len(f) for f in own])
        flat_all = np.array([x for f in own for x in f], np.int64)
        part = np.r_[False, of_all[1:] == of_all[:-1]]  # the first feature is the word
        left = np.array([*[beside(w, "<") for w in words], beside(None, "<")])
        right = np.array([*[beside(w, ">") for w in words], beside(None, ">")])
        n_w, n = len(words), len(ids)
        used = np.unique(np.concatenate([flat_all, left, right]))
        squares = np.zeros(BUCKETS) + 1e-8
        other = np.zeros(7) + 1e-8
        yi = y.astype(np.int64)
        want = np.zeros((2, 2))
        np.add.at(want, (yi[:-1][~first[1:]], yi[1:][~first[1:]]), 1)
        for k in range(rounds):
            flat, of = (flat_all[part], of_all[part]) if k % 2 else (flat_all, of_all)
            cur = np.bincount(of, self.w[flat], n_w)
            e = self.bias + cur[ids] + self.w[left][prev] + self.w[right][nxt]
            p, joint = marginals(e, first, np.exp(self.trans), np.exp(self.start), True)
            d = y - p
            g = np.zeros(BUCKETS)
            per_word = np.bincount(ids, d, n_w)
            np.add.at(g, flat, per_word[of])
            np.add.at(g, left, np.bincount(prev, d, n_w + 1))
            np.add.at(g, right, np.bincount(nxt, d, n_w + 1))
            g = g[used] / n - ridge * self.w[used]
            squares[used] += g * g
            self.w[used] += rate * g / np.sqrt(squares[used])
            dt = ((want - joint.sum(0)) / n).ravel()
            ds = np.array([((1 - y) - (1 - p))[first].sum(), (y - p)[first].sum()]) / n
            db = np.r_[dt, ds, d.sum() / n]
            other += db * db
            step = rate * 0.5 * db / np.sqrt(other)
            self.trans += step[:4].reshape(2, 2)
            self.start += step[4:6]
            self.bias += step[6]
        return self

    def slim(self) -> "Field":
        """The weights as they travel to the workers."""
        self.w = self.w.astype(np.float32)
        return self


class _Known(dict):
    """Token as written -> its number; numbers index the scores that it lends to itself and its neighbours."""

    def __init__(self, field: Field):
        super().__init__()
        self.field, self.cur, self.left, self.right = field, [], [], []

    def __missing__(self, raw: str) -> int:
        w = raw.lower()
        f = self.field.w
        self[raw] = k = len(self.cur)
        self.cur.append(float(f[features(w)].sum()))
        self.left.append(float(f[beside(w, "<")]))
        self.right.append(float(f[beside(w, ">")]))
        return k


def emissions(texts: list[list[str]], known: _Known) -> tuple[np.ndarray, np.ndarray]:
    """Log emissions of the tokens of several texts (none empty), laid end to end, and the first-token marks."""
    ids = np.fromiter(map(known.__getitem__, (w for t in texts for w in t)), np.int64)
    first = np.zeros(len(ids), bool)
    first[np.cumsum([0, *[len(t) for t in texts[:-1]]])] = True
    last = np.r_[first[1:], True]
    f = known.field
    e = f.bias + np.array(known.cur)[ids]
    left, right = np.array(known.left)[ids], np.array(known.right)[ids]
    e[1:] += left[:-1] * ~first[1:]
    e[:-1] += right[1:] * ~last[:-1]
    e[first] += f.w[beside(None, "<")]
    e[last] += f.w[beside(None, ">")]
    return e, first


def spans_of(text: str, p: np.ndarray) -> list[tuple[int, int]]:
    """Runs of tokens of marginal one half or more as offsets."""
    hot = p >= 0.5
    edge = np.flatnonzero(np.diff(np.r_[False, hot, False].astype(np.int8)))
    if not len(edge):
        return []
    begins, ends = dict.fromkeys(edge[::2].tolist()), dict.fromkeys((edge[1::2] - 1).tolist())
    out, at = [], 0
    for k, m in enumerate(TOKEN.finditer(text)):
        if k in begins:
            at = m.start()
        if k in ends:
            out.append((at, m.end()))
    return out


def judge(texts: list[str | None], field: Field | None, known: _Known | None = None) -> tuple[list[float], list[list[tuple[int, int]]]]:
    """Score and spans of each whole text."""
    score, spans = [0.0] * len(texts), [[] for _ in texts]
    if field is None:
        return score, spans
    known = _Known(field) if known is None else known
    trans, start = np.exp(field.trans), np.exp(field.start)
    held: list[tuple[int, list[str]]] = []

    def flush() -> None:
        e, first = emissions([t for _, t in held], known)
        p, _ = marginals(e, first, trans, start)
        cut = np.flatnonzero(first)
        top = np.maximum.reduceat(p, cut)
        for (i, t), a, s in zip(held, cut, top):
            score[i] = float(min(1.0, s))
            if s >= 0.5:
                spans[i] = spans_of(texts[i], p[a : a + len(t)])
        held.clear()

    total = 0
    for i, text in enumerate(texts):
        t = TOKEN.findall(text) if text else []
        if not t:
            continue
        held.append((i, t))
        total += len(t)
        if total >= GROUP:
            flush()
            total = 0
    if held:
        flush()
    return score, spans


def toxicity_column(text: Column, field: Field | None) -> Column:
    """struct(score, spans) of a text column."""

    @F.pandas_udf(RESULT)
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _Known(field) if field is not None else None
        for s in it:
            if known is not None and len(known) > 400_000:
                known = _Known(field)
            score, spans = judge([t if isinstance(t, str) else None for t in s], field, known)
            yield pd.DataFrame({"score": score, "spans": [[{"start": a, "end": b} for a, b in x] for x in spans]})

    return run(text)


# ------------------------------------------------------------------ training


def _chosen(marks: DataFrame, y: int, bound: int) -> DataFrame:
    """At most ``bound`` ids of a class, by a hash: first a share known from a count, then the least hashes."""
    rows = marks.filter(F.col("y") == y).select("i")
    n = rows.count()
    h = F.pmod(F.xxhash64("i"), F.lit(1 << 30))
    if n > 2 * bound:
        rows = rows.filter(h < F.lit(int((1 << 30) * 1.5 * bound / n)))
    return rows.orderBy(h, "i").limit(bound).withColumn("y", F.lit(y))


def _stem_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, text) -> the distinct stems of each document."""
    for b in batches:
        ys, fs = [], []
        for y, t in zip(b.column(0).to_pylist(), b.column(1)):
            got = {f for w in set(TOKEN.findall(t.as_py())) for f in stems(w.lower())}
            ys += [y] * len(got)
            fs += got
        yield pa.RecordBatch.from_pydict({"y": pa.array(ys, pa.int32()), "f": pa.array(fs, pa.string())})


def lexicon(rows: DataFrame) -> dict[str, float]:
    """Features that label tokens, from (y, text): those of toxic documents far beyond chance."""
    size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return {}
    c = rows.select("y", "text").mapInArrow(_stem_rows, "y int, f string").groupBy("f").agg(
        F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b")).persist()
    try:
        bar = 2 * np.log(max(2, c.count())) + 2
        a, b = F.col("a"), F.col("b")
        seen = a + b
        ea, eb = seen * n1 / (n1 + n0), seen * n0 / (n1 + n0)
        part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
        g2 = 2 * (part(a, ea) + part(b, eb))
        pure = (a / n1) / (a / n1 + b / n0)
        top = c.filter((g2 > bar) & (pure > PURITY)).select("f", g2.alias("g")).orderBy(F.desc("g"), "f").limit(LEXICON)
        return {r["f"]: r["g"] for r in top.collect()}
    finally:
        c.unpersist()


def _windows(lex: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"i": [], "words": [], "tags": []}
            for y, t, i in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                w = [x.lower() for x in TOKEN.findall(t.as_py())]
                hit = [any(f in lex for f in stems(x)) for x in w]
                mid = [k for k, h in enumerate(hit) if h]  # in clean documents too: what the lexicon gets wrong there
                if y == 0:
                    mid = mid[:WINDOWS] + [len(w) // 2] * bool(w)
                upto = done = 0
                for m in sorted(mid):
                    lo, hi = max(upto, m - SIDE), min(len(w), m + SIDE)
                    if done == WINDOWS + 1 - y or m < upto or lo >= hi:
                        continue
                    out["i"].append(i)
                    out["words"].append(" ".join(w[lo:hi]))
                    out["tags"].append("".join("1" if h and y else "0" for h in hit[lo:hi]))
                    upto, done = hi, done + 1
            kinds = {"i": pa.int64(), "words": pa.string(), "tags": pa.string()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in out.items()})

    return run


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> Field | None:
    """Fit on at most ``toxic_docs`` and ``clean_docs`` documents whose label row satisfies ``usable``.

    ``usable`` is a column over ``labels``. Ids and labels alone take part in the choice; the texts of the
    chosen are read afterwards, and a few windows of each (``WINDOWS``) reach the driver.
    """
    marks = labels.filter(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("i"), F.col(label_col).alias("l"))
    marks = marks.filter("i IS NOT NULL AND l IS NOT NULL").groupBy("i").agg(F.max(F.when(F.col("l") == 1, 1).otherwise(0)).alias("y"))
    few = _chosen(marks, 1, toxic_docs).union(_chosen(marks, 0, clean_docs))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL AND i IS NOT NULL")
    rows = rows.join(F.broadcast(few), "i").select("y", "text", "i").persist()
    try:
        lex = lexicon(rows)
        if not lex:
            return None
        got = rows.mapInArrow(_windows(lex), "i long, words string, tags string").collect()
    finally:
        rows.unpersist()
    got = sorted((r["i"], r["words"], r["tags"]) for r in got if r["words"])
    if not any("1" in t for _, _, t in got):
        return None
    return Field().fit([w.split(" ") for _, w, _ in got], [[int(v) for v in t] for _, _, t in got]).slim()


def detect(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score and the offsets of its toxic spans."""
    seen = docs.select(F.col(id_col), toxicity_column(F.col(text_col), field).alias("_p"))
    return seen.select(F.col(id_col), F.col("_p.score").alias("score"), F.col("_p.spans").alias("spans"))
