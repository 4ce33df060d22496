"""Exact cosine self-join of embeddings by epsilon grid order.

Cosine >= t means that unit vectors are at most eps = sqrt(2 - 2t) apart. Unit vectors are projected on
leading principal axes (fitted on a bounded sample; they steer the work, never the result), laid on a grid
of width eps and sorted by label and cells. The sorted sequence is cut into intervals. Two intervals are
joined when their boxes are at most eps apart on every axis; inside the join, intervals are halved
recursively and halves whose boxes are too far apart are skipped. Leaves compare the original vectors in
double precision, blockwise, and hand on counts and a spanning forest, never their pairs.

Equal vectors of a label are one class with a multiplicity before the join. Vectors with a null label, null
or no components, null, NaN or infinite components or norm 0 link with nothing. Only vectors of the same
label and length are compared. A row without an id takes no part (component null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlight.llm.common import components
from strandlight.session import cut_lineage

THRESHOLD = 0.98
AXES = 6
SAMPLE = 4000  # bound: vectors that fit the axes
INTERVAL = 4096
LEAF = 256


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, vector) -> usable vectors with a fingerprint."""
    for b in batches:
        out: dict[str, list] = {"vec": [], "label": [], "dim": [], "fp": [], "v": []}
        for i, lab, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if i is None or lab is None or not e.is_valid or e.values.null_count or not len(e.values):
                continue
            v = e.values.to_numpy().astype("<f8")
            if not np.isfinite(v).all() or not v.any():
                continue
            out["vec"].append(i)
            out["label"].append(lab)
            out["dim"].append(len(v))
            out["fp"].append(xxhash.xxh3_128_digest(v.tobytes()))
            out["v"].append(v.tobytes())
        kinds = {"vec": pa.int64(), "label": pa.string(), "dim": pa.int32(), "fp": pa.binary(), "v": pa.binary()}
        yield pa.RecordBatch.from_pydict({k: pa.array(x, kinds[k]) for k, x in out.items()})


def fit_axes(rows: DataFrame, axes: int = AXES) -> dict[int, np.ndarray]:
    """Per vector length: leading principal axes of the unit vectors of a bounded sample."""
    got = rows.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("dim", "v").collect()
    out = {}
    for dim in {r["dim"] for r in got}:
        x = np.stack([np.frombuffer(r["v"], "<f8") for r in got if r["dim"] == dim])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        out[dim] = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:axes]
    return out


def project(v: np.ndarray, axes: dict[int, np.ndarray], n: int = AXES) -> np.ndarray:
    """Coordinates on the axes (plain coordinates for lengths that the sample lacks), padded with 0."""
    a = axes.get(v.shape[1])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    p = u @ a.T if a is not None else u[:, :n]
    return np.pad(p, ((0, 0), (0, n - p.shape[1])))


def _cells(axes: dict[int, np.ndarray], eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            cells = np.zeros((b.num_rows, AXES), np.int64)
            vs = b.column("v").to_pylist()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.frombuffer(b"".join(vs[i] for i in at), "<f8").reshape(-1, d)
                cells[at] = np.floor(project(x, axes) / eps)
            cols = {f.name: b.column(f.name) for f in b.schema}
            yield pa.RecordBatch.from_pydict(cols | {f"c{k}": cells[:, k] for k in range(AXES)})

    return run


def _intervals(axes: dict[int, np.ndarray], size: int):
    """Sorted rows of a partition -> intervals: id, label, dim, box, members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, k = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal k
            v = np.frombuffer(b"".join(r[4] for r in held), "<f8").reshape(len(held), -1)
            p = project(v, axes)
            k += 1
            one = {
                "iv": [base + k - 1], "label": [held[0][0]], "dim": [held[0][1]], "lo": [p.min(0).tolist()], "hi": [p.max(0).tolist()],
                "reps": [np.array([r[2] for r in held], "<i8").tobytes()], "mult": [np.array([r[3] for r in held], "<i8").tobytes()], "vs": [v.tobytes()],
            }
            held.clear()
            kinds = {"iv": pa.int64(), "label": pa.string(), "dim": pa.int32(), "lo": pa.list_(pa.float64()), "hi": pa.list_(pa.float64()),
                     "reps": pa.binary(), "mult": pa.binary(), "vs": pa.binary()}
            return pa.RecordBatch.from_pydict({n: pa.array(x, kinds[n]) for n, x in one.items()})

        for b in batches:
            for r in zip(*(b.column(n).to_pylist() for n in ("label", "dim", "rep", "mult", "v"))):
                if held and (len(held) >= size or held[-1][:2] != r[:2]):
                    yield flush()
                held.append(r)
        if held:
            yield flush()

    return run


def _apart(p: np.ndarray, q: np.ndarray, eps: float) -> bool:
    return bool(((p.min(0) > q.max(0) + eps) | (q.min(0) > p.max(0) + eps)).any())


class Forest:
    """Union of node indexes; edges() is a spanning forest."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def link_labels(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row and column of a link matrix, the smallest row that it reaches (rows + 1 when none)."""
    n = len(m)
    row, col = np.arange(n), np.full(m.shape[1], n)
    while True:
        col = np.minimum(col, np.where(m, row[:, None], n).min(0))
        new = np.minimum(row, np.where(m, col[None], n).min(1))
        if (new == row).all():
            return row, col
        row = new


def join_intervals(a: tuple, b: tuple, same: bool, axes: dict[int, np.ndarray], t: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of a to b and of b to a (with multiplicities), and forest edges between representatives."""
    (ra, ma, va), (rb, mb, vb) = a, b
    eps = (2 - 2 * t) ** 0.5 + 1e-9
    pa_, pb_ = project(va, axes), project(vb, axes)
    na, nb = np.linalg.norm(va, axis=1), np.linalg.norm(vb, axis=1)
    da, db = np.zeros(len(ra), np.int64), np.zeros(len(rb), np.int64)
    shift = 0 if same else len(ra)
    forest = Forest(len(ra) + (0 if same else len(rb)))
    todo = [(0, len(ra), 0, len(rb))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if i0 >= i1 or j0 >= j1 or same and j1 <= i0 or _apart(pa_[i0:i1], pb_[j0:j1], eps):
            continue
        if max(i1 - i0, j1 - j0) > LEAF:
            i, j = (i0 + i1) // 2, (j0 + j1) // 2
            if same and (i0, i1) == (j0, j1):
                todo += [(i0, i, i0, i), (i0, i, i, i1), (i, i1, i, i1)]
            elif i1 - i0 >= j1 - j0:
                todo += [(i0, i, j0, j1), (i, i1, j0, j1)]
            else:
                todo += [(i0, i1, j0, j), (i0, i1, j, j1)]
            continue
        m = (va[i0:i1] @ vb[j0:j1].T) / (na[i0:i1, None] * nb[None, j0:j1]) >= t
        if same and i0 == j0:
            np.fill_diagonal(m, False)
        if not m.any():
            continue
        da[i0:i1] += m @ mb[j0:j1]
        if not (same and i0 == j0):
            (da if same else db)[j0:j1] += ma[i0:i1] @ m
        row, col = link_labels(m)
        for k in np.flatnonzero(row < np.arange(len(row))):
            forest.join(i0 + int(k), i0 + int(row[k]))
        for k in np.flatnonzero(col < len(row)):
            forest.join(shift + j0 + int(k), i0 + int(col[k]))
    names = ra if same else np.r_[ra, rb]
    edges = [(int(names[x]), int(names[r])) for x in range(len(names)) if (r := forest.find(x)) != x]
    return da, db, edges


def _join(axes: dict[int, np.ndarray], t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                dim = r["dim"]
                a, c = (
                    (np.frombuffer(r["reps" + s], "<i8"), np.frombuffer(r["mult" + s], "<i8"), np.frombuffer(r["vs" + s], "<f8").reshape(-1, dim))
                    for s in "ab"
                )
                same = r["a"] == r["b"]
                da, db, edges = join_intervals(a, c, same, axes, t)
                u = [x for x, _ in edges] + a[0][da > 0].tolist() + c[0][db > 0].tolist()
                v = [y for _, y in edges] + [None] * int((da > 0).sum() + (db > 0).sum())
                n = [0] * len(edges) + da[da > 0].tolist() + db[db > 0].tolist()
                yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def join(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    eps = (2 - 2 * threshold) ** 0.5 + 1e-9
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("e"))
    ok = rows.mapInArrow(_valid, "vec long, label string, dim int, fp binary, v binary")
    reps = ok.groupBy("label", "dim", "fp").agg(F.min("vec").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("v").alias("v"))
    reps = cut_lineage(reps, "ego-reps")
    axes = fit_axes(reps)
    cells = ", ".join(f"c{k} long" for k in range(AXES))
    laid = reps.select("label", "dim", "rep", "mult", "v").mapInArrow(_cells(axes, eps), f"label string, dim int, rep long, mult long, v binary, {cells}")
    order = ["label", "dim", *[f"c{k}" for k in range(AXES)], "rep"]
    n = max(1, -(-reps.count() // INTERVAL))
    box = "lo array<double>, hi array<double>"
    iv = laid.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        _intervals(axes, INTERVAL), f"iv long, label string, dim int, {box}, reps binary, mult binary, vs binary")
    iv = cut_lineage(iv, "ego-intervals")

    def slots(reach: int, name: str) -> DataFrame:
        df = iv.select(F.col("iv").alias(name), "label", "dim", F.col("lo").alias(f"lo{name}"), F.col("hi").alias(f"hi{name}"))
        for k in range(2):
            lo, hi = F.floor(F.col(f"lo{name}")[k] / eps), F.floor(F.col(f"hi{name}")[k] / eps)
            df = df.withColumn(f"s{k}", F.explode(F.sequence(lo - reach, hi + reach)))
        return df

    near = F.forall(
        F.sequence(F.lit(1), F.lit(AXES)),
        lambda k: (F.element_at("loa", k) <= F.element_at("hib", k) + eps) & (F.element_at("lob", k) <= F.element_at("hia", k) + eps),
    )
    pairs = slots(1, "a").join(slots(0, "b"), ["label", "dim", "s0", "s1"]).filter((F.col("a") <= F.col("b")) & near).select("a", "b").distinct()
    body = iv.select("iv", "dim", "reps", "mult", "vs")
    pairs = pairs.join(body.toDF("a", "dim", "repsa", "multa", "vsa"), "a").join(body.drop("dim").toDF("b", "repsb", "multb", "vsb"), "b")
    found = cut_lineage(pairs.repartition(F.xxhash64("a", "b")).mapInArrow(_join(axes, threshold), "u long, v long, n long"), "ego-links")
    degree = found.filter("v IS NULL").groupBy("u").agg(F.sum("n").alias("deg")).withColumnRenamed("u", "rep")
    groups = components(found.filter("v IS NOT NULL").select("u", "v"), "ego-cc").toDF("rep", "g")
    facts = reps.select("label", "dim", "fp", "rep", "mult").join(degree, "rep", "left").join(groups, "rep", "left")
    facts = facts.select("label", "dim", "fp", (F.coalesce("deg", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("g", "rep").alias("grp"))
    linked = ok.select("vec", "label", "dim", "fp").join(facts, ["label", "dim", "fp"]).select("vec", "n_links", "grp")
    every = rows.select("vec").join(linked.dropDuplicates(["vec"]), "vec", "left")
    group = F.coalesce("grp", "vec")
    return every.select(
        F.col("vec").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), group.alias("component_id"),
        F.coalesce(F.col("vec") == group, F.lit(False)).alias("kept"))
