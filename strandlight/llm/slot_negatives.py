"""Hard negatives by slot-decomposed selection.

An anchor's positives are its best rows of the same label. A positive of score p admits the negatives (rows of
another label) whose score s satisfies low * p <= 100 * s <= high * p. The windows of one anchor overlap, so they
are not searched one by one: the distinct upper limits of its positives cut the scores into disjoint slots, every
negative falls into at most one of them, combiners keep the first k of a slot wherever rows meet (in a block, and
again before and after the shuffle), and one descending merge of suffixes (slot, then all lower slots) holds the
first k below each upper limit. The lower limit is checked last: it only shortens that list.

Anchors against rows is a search of a stated query set, done in blocks: a cell pairs one block of anchors with
one block of rows, whatever the labels, so neither a frequent label nor a frequent anchor makes a task larger.
Cells hand on at most k rows per anchor and slot.

Scores are integer inner products of floor(256 x) and come first by (higher score, smaller id). Left out: rows
with a null id or label, a null or empty vector or a null or non-finite component, and vectors whose squared norm
reaches 2^62 (their scores would leave 64 bits). Vectors of different lengths are not compared. An id that occurs
in several rows counts once, with its least (label, vector). Anchors without positives and positives without
negatives give no rows; neither does an empty table. Further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlight.session import cut_lineage

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # per cent of the positive's score
ANCHOR_BLOCK = 4096
ROW_BLOCK = (2048, 65_536)  # least and most rows of a block; between them about a 64th of the table
PART = 8_000_000  # scores held at once in a task
NONE = np.iinfo(np.int64).min
ROW = "id long, label long, dim int, x binary"


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, vector) -> rows with an integer vector."""
    for b in batches:
        out: dict[str, list] = {"id": [], "label": [], "dim": [], "x": []}
        for i, y, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if i is None or y is None or not e.is_valid or e.values.null_count or not len(e.values):
                continue
            c = e.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(c).all():
                continue
            with np.errstate(over="ignore"):
                f = np.floor(SCALE * c)
                big = not (f * f).sum() < 2.0**62
            if big:
                continue
            out["id"].append(i)
            out["label"].append(y)
            out["dim"].append(len(f))
            out["x"].append(f.astype("<i4" if np.abs(f).max() < 2**31 else "<i8").tobytes())
        kinds = {"id": pa.int64(), "label": pa.int64(), "dim": pa.int32(), "x": pa.binary()}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in out.items()})


def _matrix(xs: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(xs), dim), np.int64)
    for k, b in enumerate(xs):
        out[k] = np.frombuffer(b, "<i4" if len(b) == 4 * dim else "<i8")
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    if a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max()) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def first_k(s: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest allowed scores of each row; columns stand in ascending id, so ties go left."""
    n = s.shape[1]
    top = int(np.abs(s[ok]).max()) if ok.any() else 0
    if (top + 1) * n < 1 << 62:
        key = np.where(ok, s * n + (n - 1 - np.arange(n)), NONE)
        take = min(k, n)
        at = np.argpartition(key, n - take, axis=1)[:, n - take :]
        r, c = np.nonzero(np.take_along_axis(key, at, 1) > NONE)
        return r, at[r, c]
    rows, cols = [], []
    for r in range(len(s)):
        c = np.flatnonzero(ok[r])
        c = c[np.argsort(-s[r, c], kind="stable")[:k]]
        rows.append(np.full(len(c), r))
        cols.append(c)
    return np.concatenate(rows), np.concatenate(cols)


def limits(p: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and largest score of the window of a positive of score p."""
    return -(-low * p // 100), high * p // 100


def slots(uppers: list[int]) -> list[int]:
    """The distinct upper limits, falling: slot j holds scores up to the j-th and above the next."""
    return sorted(set(uppers), reverse=True)


def suffix_merge(per_slot: list[list[tuple[int, int]]], k: int) -> list[list[tuple[int, int]]]:
    """First k (score, id) of each slot and all slots below it; slots fall, and each is in order."""
    out: list[list[tuple[int, int]]] = [[] for _ in per_slot]
    below: list[tuple[int, int]] = []
    for j in range(len(per_slot) - 1, -1, -1):
        below = out[j] = (per_slot[j] + below)[:k]  # every score of a slot exceeds those of the slots below
    return out


def _cells(table: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int, cols: list[str]) -> DataFrame:
    """Rows packed into blocks of ids, one copy of a block for each block of the other side."""
    b = table.groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(own_blocks)).alias(own)).agg(
        F.sort_array(F.collect_list(F.struct("id", *cols))).alias(f"{own}s"))
    return b.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_blocks - 1).cast("long"))))


def _in_parts(b: pa.RecordBatch) -> Iterator[tuple]:
    """Each cell of a batch in parts of bounded size: anchors as they are, scores, and the rows."""
    for dim, ans, rws in zip(b.column("dim").to_pylist(), b.column("as"), b.column("rs")):
        ans, rws = ans.as_py(), rws.as_py()
        rid, rlab = np.array([r["id"] for r in rws]), np.array([r["label"] for r in rws])
        rx = _matrix([r["x"] for r in rws], dim)
        step = max(1, PART // len(rws))
        for i in range(0, len(ans), step):
            some = ans[i : i + step]
            yield some, _scores(_matrix([a["x"] for a in some], dim), rx), rid, rlab


def _positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some, s, rid, rlab in _in_parts(b):
                aid, alab = np.array([a["id"] for a in some]), np.array([a["label"] for a in some])
                r, c = first_k(s, (alab[:, None] == rlab) & (aid[:, None] != rid), k)
                yield pa.RecordBatch.from_pydict({"anchor": aid[r], "id": rid[c], "score": s[r, c]})

    return run


def _negatives(k: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some, s, rid, rlab in _in_parts(b):
                aid, alab = np.array([a["id"] for a in some]), np.array([a["label"] for a in some])
                windows = [[limits(p["score"], low, high) for p in a["pos"]] for a in some]
                upper = [slots([w[1] for w in ws]) for ws in windows]
                least = np.array([min(w[0] for w in ws) for ws in windows])
                ok = (alab[:, None] != rlab) & (s >= least[:, None])  # below every lower limit: in no window
                for j in range(max(map(len, upper))):
                    hi = np.array([u[j] if j < len(u) else NONE for u in upper])
                    lo = np.array([u[j + 1] if j + 1 < len(u) else NONE for u in upper])
                    r, c = first_k(s, ok & (s <= hi[:, None]) & (s > lo[:, None]), k)
                    yield pa.RecordBatch.from_pydict(
                        {"anchor": aid[r], "slot": np.full(len(r), j, np.int32), "id": rid[c], "score": s[r, c]})

    return run


def _answer(k: int, low: int, high: int):
    """(anchor, pos, neg) -> the negatives of every positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("anchor", "positive", "rank", "negative", "ps", "ns")}
            for anchor, pos, neg in zip(*(b.column(i).to_pylist() for i in range(3))):
                upper = slots([limits(p["score"], low, high)[1] for p in pos])
                per = [[] for _ in upper]
                for x in sorted(neg, key=lambda x: (-x["score"], x["id"])):
                    per[x["slot"]].append((x["score"], x["id"]))
                merged = suffix_merge(per, k)
                for p in pos:
                    lo, hi = limits(p["score"], low, high)
                    got = [x for x in merged[upper.index(hi)] if x[0] >= lo]
                    for rank, (score, i) in enumerate(got, 1):
                        for c, v in zip(out, (anchor, p["id"], rank, i, p["score"], score)):
                            out[c].append(v)
            kinds = {"rank": pa.int32()}
            yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    return run


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows of each key; Spark keeps k per key on either side of the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k")


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label: Column | None = None, vec_col: str = "embedding",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``is_anchor`` is a column over ``id``."""
    if not 0 <= low <= high:
        raise ValueError("limits need 0 <= low <= high")
    label = F.col("label") if label is None else label
    x = rows.select(F.col(id_col).cast("long"), label.cast("long"), F.col(vec_col).cast("array<double>")).mapInArrow(_usable, ROW)
    x = x.groupBy("id").agg(F.min(F.struct("label", "dim", "x")).alias("v")).select("id", "v.*")
    x = cut_lineage(x, "negatives-x")
    n, n_a = x.agg(F.count("*"), F.count_if(is_anchor)).first()
    size = min(ROW_BLOCK[1], max(ROW_BLOCK[0], n // 64))
    blocks_r, blocks_a = max(1, -(-n // size)), max(1, -(-n_a // ANCHOR_BLOCK))
    anchors = x.filter(is_anchor)
    right = _cells(x, "r", blocks_r, "a", blocks_a, ["label", "x"])

    def cells(table: DataFrame, cols: list[str]) -> DataFrame:
        left = _cells(table, "a", blocks_a, "r", blocks_r, cols)
        return left.join(right, ["dim", "a", "r"]).select("dim", "as", "rs")

    pos = cells(anchors, ["label", "x"]).mapInArrow(_positives(positives), "anchor long, id long, score long")
    pos = _first(pos, ["anchor"], positives)
    pos = pos.groupBy("anchor").agg(F.collect_list(F.struct("id", "score")).alias("pos"))
    pos = cut_lineage(pos, "negatives-p")
    asked = anchors.join(pos.withColumnRenamed("anchor", "id"), "id")
    neg = cells(asked, ["label", "x", "pos"]).mapInArrow(_negatives(negatives, low, high), "anchor long, slot int, id long, score long")
    neg = _first(neg, ["anchor", "slot"], negatives)
    neg = neg.groupBy("anchor").agg(F.collect_list(F.struct("slot", "id", "score")).alias("neg"))
    out = pos.join(neg, "anchor").select("anchor", "pos", "neg").mapInArrow(
        _answer(negatives, low, high), "anchor long, positive long, rank int, negative long, ps long, ns long")
    return out.toDF("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
