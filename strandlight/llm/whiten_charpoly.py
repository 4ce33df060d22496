"""Whitening of embeddings through the exact characteristic polynomial of their integer scatter.

Entries become integers x = floor(256 c). Over the distinct x-vectors (the fit list, n of them with sums S)
the scatter n * sum(x x') - S S' is an integer matrix, n^2 times the covariance. Its sums are aggregated on
Spark; its characteristic polynomial comes from Hessenberg reductions modulo primes (one Spark task handles
some primes) joined by Chinese remaindering under an exact bound of the coefficients; leading roots are
isolated by counting sign changes of shifted polynomials (exact, as all roots are real) and halved to 160
bits; null-space inverse iteration in integer fixed-point arithmetic gives unit vectors to double precision.

Vectors of different lengths have fit lists of their own. Rows whose vector is null or holds null or
non-finite entries go, and so do rows whose x leaves 64 bits; an empty vector has no component. A component of
eigenvalue 0 (one distinct vector, or dependent dimensions) has explained 0 and no whitened value, and does
not count in identity_error. Equal eigenvalues have any orthonormal basis, the same for all rows. Repeated
rows and null ids stay, each with its rows. deviation is null beyond 38 digits. An empty table gives no rows;
further columns are left alone.

What reaches the driver has d * d numbers for vectors of length d, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce
from math import comb, gcd, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlight.session import cut_lineage

SCALE = 256
COMPONENTS = 4
BITS = 160  # bits of a root, relative to the trace
WORK = 448  # fractional bits of inverse iteration
_WIDTHS = ("<i1", "<i2", "<i4", "<i8")
FIT = "id long, dim int, x binary"
OUT = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, dim int"


# ------------------------------------------------------------------ integer vectors


def pack(x: np.ndarray) -> bytes:
    """An int64 vector in the least common width, which makes equal vectors equal bytes."""
    for k, t in enumerate(_WIDTHS):
        i = np.iinfo(t)
        if not len(x) or (x.min() >= i.min and x.max() <= i.max):
            return bytes([k]) + x.astype(t).tobytes()
    raise AssertionError


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, _WIDTHS[b[0]], offset=1).astype(np.int64)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) -> usable rows (id, dim, x)."""
    for b in batches:
        out: dict[str, list] = {"id": [], "dim": [], "x": []}
        for i, e in zip(b.column(0).to_pylist(), b.column(1)):
            if not e.is_valid or e.values.null_count:
                continue
            c = e.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(c).all():
                continue
            with np.errstate(over="ignore"):
                f = np.floor(SCALE * c)
            if not (np.abs(f) < 2.0**63).all():
                continue
            out["id"].append(i)
            out["dim"].append(len(f))
            out["x"].append(pack(f.astype(np.int64)))
        kinds = {"id": pa.int64(), "dim": pa.int32(), "x": pa.binary()}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in out.items()})


def integer_rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, dim, x) of the usable rows."""
    return vectors.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>")).mapInArrow(_whole, FIT)


def _products(x: np.ndarray) -> np.ndarray:
    """Exact x' x of int64 rows."""
    top = int(max(abs(int(x.max())), abs(int(x.min())))) if x.size else 0
    if top * top * len(x) < 1 << 53:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if top * top * len(x) < 1 << 63:
        return (x.T @ x).astype(object)
    o = x.astype(object)
    return o.T @ o


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fit rows (dim, x) of a partition -> its sums, d + 1 rows of d numbers, in base 2^48 so that Spark adds them."""
    acc: dict[int, list] = {}
    for b in batches:
        dims = b.column("dim").to_numpy()
        for d in np.unique(dims).tolist():
            if not d:
                continue
            at = np.flatnonzero(dims == d)
            x = np.stack([unpack(b.column("x")[int(k)].as_py()) for k in at])
            one = [len(x), x.astype(object).sum(0), _products(x)]
            acc[d] = [p + q for p, q in zip(acc[d], one)] if d in acc else one
    for d, (n, s, p) in acc.items():
        rows: dict[str, list] = {"dim": [], "i": [], "j": [], "digit": [], "v": []}
        for i, j, v in [(-2, 0, n), *[(-1, j, s[j]) for j in range(d)], *[(i, j, p[i, j]) for i in range(d) for j in range(i, d)]]:
            sign, v, k = (1 if v >= 0 else -1), abs(int(v)), 0
            while v or k == 0:
                for name, val in zip(rows, (d, i, j, k, sign * (v & (1 << 48) - 1))):
                    rows[name].append(val)
                v, k = v >> 48, k + 1
        kinds = {"dim": pa.int32(), "i": pa.int32(), "j": pa.int32(), "digit": pa.int32(), "v": pa.int64()}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in rows.items()})


def scatter(fit: DataFrame) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """Per vector length: n, the sums S and the integer scatter n * sum(x x') - S S'."""
    parts = fit.select("dim", "x").mapInArrow(_sums, "dim int, i int, j int, digit int, v long")
    got = parts.groupBy("dim", "i", "j", "digit").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # d * d / 2 entries
    raw: dict[int, dict] = {}
    for r in got:
        cell = raw.setdefault(r["dim"], {})
        cell[r["i"], r["j"]] = cell.get((r["i"], r["j"]), 0) + (int(r["v"]) << 48 * r["digit"])
    out = {}
    for d, c in raw.items():
        n, s = c[-2, 0], [c[-1, j] for j in range(d)]
        out[d] = (n, s, [[n * c[min(i, j), max(i, j)] - s[i] * s[j] for j in range(d)] for i in range(d)])
    return out


# ------------------------------------------------------------------ characteristic polynomial


def is_prime(m: int) -> bool:
    return m > 1 and all(m % k for k in range(2, isqrt(m) + 1)) if m < 100 else (
        all(m % k for k in (2, 3, 5, 7)) and all(_strong(m, a) for a in (2, 3, 5, 7)))


def _strong(m: int, a: int) -> bool:
    """Strong test; the four bases decide every m below 3.2e9."""
    d, s = m - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    x = pow(a, d, m)
    return x in (1, m - 1) or any((x := x * x % m) == m - 1 for _ in range(s - 1))


def primes(product: int) -> list[int]:
    """Primes just below 2^31 whose product exceeds ``product``."""
    out, p, have = [], (1 << 31) - 1, 1
    while have <= product:
        if is_prime(p):
            out.append(p)
            have *= p
        p -= 2
    return out


def charpoly_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(t I - a) modulo p, highest first, by reduction to Hessenberg form."""
    h = a.copy()
    d = len(h)
    for k in range(d - 2):
        low = np.flatnonzero(h[k + 1 :, k])
        if not len(low):
            continue
        q = k + 1 + int(low[0])
        if q != k + 1:
            h[[k + 1, q]] = h[[q, k + 1]]
            h[:, [k + 1, q]] = h[:, [q, k + 1]]
        inv = pow(int(h[k + 1, k]), -1, p)
        f = h[k + 2 :, k] * inv % p
        h[k + 2 :] = (h[k + 2 :] - f[:, None] * h[k + 1] % p) % p
        gain = np.zeros(d, np.int64)
        for r in range(0, len(f)):  # products stay below 2^62, so they are reduced one column at a time
            gain = (gain + h[:, k + 2 + r] * f[r]) % p
        h[:, k + 1] = (h[:, k + 1] + gain) % p
    polys = [np.array([1], np.int64)]  # lowest first
    for m in range(d):
        nxt = np.zeros(m + 2, np.int64)
        nxt[1:] = polys[m]
        nxt[:-1] = (nxt[:-1] - polys[m] * h[m, m] % p) % p
        t = 1
        for i in range(m - 1, -1, -1):
            t = t * int(h[i + 1, i]) % p
            if not t:
                break
            c = t * int(h[i, m]) % p
            nxt[: i + 1] = (nxt[: i + 1] - polys[i] * c % p) % p
        polys.append(nxt % p)
    return polys[d][::-1]


def charpoly(spark: SparkSession | None, g: list[list[int]]) -> list[int]:
    """Exact coefficients of det(t I - g), highest first, of a symmetric positive semidefinite integer matrix."""
    d = len(g)
    tr = sum(g[i][i] for i in range(d))
    # the elementary symmetric functions of d non-negative numbers of sum tr are largest when all are equal
    bound = max((comb(d, k) * tr**k) // d**k + 1 for k in range(d + 1))
    ps = primes(2 * bound)

    def residues(some: list[int]) -> list[list[int]]:
        return [charpoly_mod(np.array([[v % p for v in row] for row in g], np.int64), p).tolist() for p in some]

    if spark is None or d < 2:
        got = list(zip(ps, residues(ps)))
    else:
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for q in it:
                some = [int(v) for v in q["p"]]
                yield pd.DataFrame({"p": some, "r": residues(some)})

        rows = spark.createDataFrame([(p,) for p in ps], "p long").repartition(min(len(ps), 64), "p")
        got = [(r["p"], r["r"]) for r in rows.mapInPandas(run, "p long, r array<long>").collect()]
    whole, mod = [0] * (d + 1), 1
    for p, r in got:
        inv = pow(mod, -1, p) if mod > 1 else 1
        whole = [w + mod * ((v - w) * inv % p) for w, v in zip(whole, r)]
        mod *= p
    return [w - mod if w > mod // 2 else w for w in whole]


# ------------------------------------------------------------------ roots


def roots_above(c: list[int], num: int, shift: int) -> int:
    """How many roots (with multiplicity) exceed num / 2^shift: the sign changes of the polynomial moved there,
    which count exactly because all roots are real."""
    a = [v << (shift * k) for k, v in enumerate(c)]  # roots times 2^shift
    d = len(a) - 1
    for k in range(d):
        for j in range(1, d - k + 1):
            a[j] += num * a[j - 1]
    signs = [v > 0 for v in a if v]
    return sum(p != q for p, q in zip(signs, signs[1:]))


def leading_roots(c: list[int], count: int, bits: int = BITS) -> list[Fraction]:
    """The largest ``count`` roots, falling, each to within trace * 2^-bits; a root of 0 is exactly 0."""
    trace = -c[1] if len(c) > 1 else 0
    shift = max(0, bits - trace.bit_length())
    step = max(1, trace >> bits)
    top = (trace // step << shift) // 1 + 2 if step == 1 else trace // step + 2
    scale = step if step > 1 else 1

    def above(v: int) -> int:
        return roots_above(c, v * scale, 0) if scale > 1 else roots_above(c, v, shift)

    positive = above(0)
    out: list[Fraction] = []
    known = {0: positive, top: 0}
    for k in range(1, count + 1):
        if k > positive:
            out.append(Fraction(0))
            continue
        lo = max(v for v, n in known.items() if n >= k)
        hi = min(v for v, n in known.items() if n < k)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            n = known[mid] = above(mid)
            lo, hi = (mid, hi) if n >= k else (lo, mid)
        out.append(Fraction((2 * lo + 1) * scale, 2 << shift))
    return out


# ------------------------------------------------------------------ components


def null_vector(g: list[list[int]], root: Fraction, earlier: list[np.ndarray], seed: int) -> np.ndarray:
    """Unit vector (fixed point, WORK bits) of the null space of g - root, orthogonal to ``earlier``."""
    d = len(g)
    one = 1 << WORK
    trace = max(1, sum(g[i][i] for i in range(d)))
    a = np.array([[(v << WORK) // trace for v in row] for row in g], object)
    mu = (root.numerator << WORK) // (root.denominator * trace)
    for i in range(d):
        a[i, i] -= mu
    perm, low = [], np.zeros((d, d), object)
    for k in range(d):
        q = k + max(range(d - k), key=lambda r: abs(a[k + r, k]))
        a[[k, q]], low[[k, q]] = a[[q, k]], low[[q, k]]
        perm.append(q)
        if a[k, k] == 0:
            a[k, k] = 1  # exactly singular: the least amount that can be divided by
        if k + 1 < d:
            f = (a[k + 1 :, k] << WORK) // a[k, k]
            low[k + 1 :, k] = f
            a[k + 1 :, k:] -= f[:, None] * a[k, k:] >> WORK

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for k, q in enumerate(perm):
            y[[k, q]] = y[[q, k]]
        for k in range(d):
            if k:
                y[k] -= int((low[k, :k] * y[:k]).sum()) >> WORK
        for k in range(d - 1, -1, -1):
            s = y[k] - (int((a[k, k + 1 :] * y[k + 1 :]).sum()) >> WORK if k + 1 < d else 0)
            y[k] = (s << WORK) // a[k, k]
        return y

    def unit(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for e in earlier:
                v = v - (int((v * e).sum()) >> WORK) * e // one
            size = isqrt(int((v * v).sum()))
            if not size:
                return v
            v = v * one // size
        return v

    rng = np.random.default_rng(seed)
    v = unit(np.array([int(x) << WORK - 30 for x in rng.integers(-(1 << 30), 1 << 30, d)], object))
    for _ in range(60):
        w = unit(solve(v))
        close = min(int(np.abs(w - v).max()), int(np.abs(w + v).max()))
        v = w
        if close >> (WORK - 80) == 0:  # agrees to 80 bits
            break
    return v


@dataclass(frozen=True)
class Fit:
    """What whitening needs of one vector length: n, sums, roots of the scatter, unit vectors, shares of the trace."""

    n: int
    sums: tuple
    roots: tuple
    units: tuple
    explained: tuple


def fit_one(spark: SparkSession | None, n: int, sums: list[int], g: list[list[int]], count: int = COMPONENTS) -> Fit:
    """Leading components of one scatter."""
    d = len(g)
    shared = reduce(gcd, (v for row in g for v in row), 0)  # a common factor only scales the roots
    g = [[v // shared for v in row] for row in g] if shared > 1 else g
    trace = sum(g[i][i] for i in range(d))
    k = min(count, d)
    if not trace:
        return Fit(n, tuple(sums), (0.0,) * k, tuple(map(tuple, np.eye(d)[:k])), (0.0,) * k)
    roots = leading_roots(charpoly(spark, g), k)
    found: list[np.ndarray] = []
    for i, r in enumerate(roots):
        found.append(null_vector(g, r, found, 17 + i) if r else np.zeros(d, object))
    units = tuple(tuple(float(Fraction(int(x), 1 << WORK)) for x in v) for v in found)
    return Fit(n, tuple(sums), tuple(float(r * max(1, shared)) for r in roots), units, tuple(float(r / trace) for r in roots))


def whiten(x: np.ndarray, fit: Fit) -> tuple[np.ndarray, list[int]]:
    """(rows, components) whitened values (NaN for a root of 0) and exact deviations of int64 rows of one length."""
    s = np.array(fit.sums, object)
    top = fit.n * max(1, int(np.abs(x).max()) if x.size else 1) + max([1, *map(abs, fit.sums)])
    if top < 1 << 62 and top * top * max(1, x.shape[1]) < 1 << 63:
        c = fit.n * x - s.astype(np.int64)
        dev = (c * c).sum(1).tolist()
    else:
        c = fit.n * x.astype(object) - s
        dev = (c * c).sum(1).tolist()
    r = np.array(fit.roots)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = c.astype(np.float64) @ np.array(fit.units).T / np.sqrt(np.where(r > 0, r, np.nan))
    return w, dev


def _identity(fits: dict[int, Fit]):
    """Fit rows -> per partition sums of whitened products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                if d not in fits:
                    continue
                x = np.stack([unpack(b.column("x")[int(k)].as_py()) for k in np.flatnonzero(dims == d)])
                w, _ = whiten(x, fits[d])
                acc[d] = acc.get(d, 0) + w.T @ w
        rows = [(d, i, j, float(a[i, j])) for d, a in acc.items() for i in range(len(a)) for j in range(len(a))]
        kinds = (("dim", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64()))
        yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(kinds)})

    return run


def _apply(fits: dict[int, Fit]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import decimal

        with decimal.localcontext() as ctx:
            ctx.prec = 40
            for b in batches:
                dims, ids = b.column("dim").to_numpy(), b.column("id").to_pylist()
                out: dict[str, list] = {k: [] for k in ("id", "component", "n", "deviation", "whitened", "explained", "dim")}
                for d in np.unique(dims).tolist():
                    f = fits.get(d)
                    if f is None:
                        continue
                    at = np.flatnonzero(dims == d)
                    w, dev = whiten(np.stack([unpack(b.column("x")[int(k)].as_py()) for k in at]), f)
                    dev = [decimal.Decimal(int(v)) if v < 10**38 else None for v in dev]
                    for k in range(len(f.roots)):
                        out["id"] += [ids[i] for i in at]
                        out["component"] += [k + 1] * len(at)
                        out["n"] += [f.n] * len(at)
                        out["deviation"] += dev
                        out["whitened"] += [None if v != v else v for v in w[:, k].tolist()]
                        out["explained"] += [f.explained[k]] * len(at)
                        out["dim"] += [d] * len(at)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.float64(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_pydict({n: pa.array(v, t) for (n, v), t in zip(out.items(), kinds)})

    return run


def whitening(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, dim, identity_error) for up to ``count`` components."""
    spark = vectors.sparkSession
    rows = integer_rows(vectors, id_col, vec_col)
    fit = cut_lineage(rows.select("dim", "x").distinct(), "whiten-fit")  # equal copies shrink before the shuffle
    fits = {d: fit_one(spark, n, s, g, count) for d, (n, s, g) in scatter(fit).items()}
    seen = fit.mapInArrow(_identity(fits), "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect()
    error = [(d, 0.0) for d in fits]
    for r in seen:  # count * count entries for each length
        if r["v"] == r["v"]:
            error.append((r["dim"], abs(r["v"] / fits[r["dim"]].n - (r["i"] == r["j"]))))
    worst = {d: max(v for e, v in error if e == d) for d in fits}
    out = rows.mapInArrow(_apply(fits), OUT)
    err = F.lit(None).cast("double")
    for d, v in worst.items():
        err = F.when(F.col("dim") == d, F.lit(v)).otherwise(err)
    return out.withColumnRenamed("id", id_col).withColumn("identity_error", err)
