"""Operators 11 to 13 against enumeration, numpy and brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlight.llm import queries, slot_negatives, toxic_crf, whiten_charpoly
from strandlight.llm.common import crc_mod, prepare

DOC = "doc_id long, text string, _p string, score string, i string, y string"
VEC = "vec_id long, embedding array<float>, label int, x string, dim string, id string"


def docs_frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], DOC)


def vec_frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(i, e, y, "x", "x", "x") for i, e, y in rows], VEC)


# 11


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    for trial in range(4):
        lens = rng.integers(1, 7, 6)
        n = int(lens.sum())
        e, first = rng.normal(0, 3, n), np.zeros(n, bool)
        first[np.cumsum(np.r_[0, lens[:-1]])] = True
        trans, start = np.exp(rng.normal(0, 1, (2, 2))), np.exp(rng.normal(0, 1, 2))
        p, joint = toxic_crf.marginals(e, first, trans, start, True)
        at = 0
        for size in lens.tolist():
            z, m, two = 0.0, np.zeros(size), np.zeros((size, 2, 2))
            for y in itertools.product((0, 1), repeat=size):
                w = start[y[0]] * math.prod(trans[a, b] for a, b in zip(y, y[1:])) * math.exp(sum(e[at + k] for k in range(size) if y[k]))
                z += w
                for k in range(size):
                    m[k] += w * y[k]
                    if k:
                        two[k, y[k - 1], y[k]] += w
            assert np.allclose(m / z, p[at : at + size]) and np.allclose(two / z, joint[at : at + size])
            at += size


def test_marginals_of_a_long_text():
    """A text of many blocks equals the plain recursion."""
    rng = np.random.default_rng(2)
    n = 70_000
    e, first = rng.normal(-2, 4, n), np.zeros(n, bool)
    first[[0, 50]] = True
    trans, start = np.array([[2.0, 0.1], [0.7, 1.5]]), np.array([1.0, 0.4])
    f = np.empty((n, 2))
    for t in range(n):
        m = (start if first[t] else f[t - 1] @ trans) * [1, math.exp(e[t])]
        f[t] = m / m.sum()
    b, want = np.ones(2), np.empty(n)
    for t in range(n - 1, -1, -1):
        p = f[t] * b
        want[t] = p[1] / p.sum()
        b = np.ones(2) if first[t] else trans @ (b * [1, math.exp(e[t])])
        b = b / b.sum()
    assert np.allclose(toxic_crf.marginals(e, first, trans, start)[0], want, atol=1e-9)


def toxic_rows():
    r = random.Random(5)
    plain = ["".join(r.choice(["ba", "lo", "mi", "ru", "te", "so"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    bad = ["vilexa", "vilexo", "vilexum", "grunk"]
    rows, marks = [], []
    for i in range(400):
        w = [r.choice(plain) for _ in range(r.randint(15, 60))]
        if i % 4 == 0:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w)))
        marks.append((i, int(i % 4 == 0)))
    return rows, marks


@pytest.fixture(scope="module")
def field(spark):
    rows, marks = toxic_rows()
    labels = spark.createDataFrame(marks + [marks[0], (None, 1), (7, None)], "doc_id long, toxic int")
    return toxic_crf.train(docs_frame(spark, rows + [rows[0]]), labels, crc_mod("doc_id", 5) != 0)


def test_toxic_spans(spark, field):
    long = "lomi ruso " * 60_000
    odd = [(1000, None), (1001, ""), (1002, " \n 12 !"), (1003, long), (1004, long + "GRUNK*** " + long), (1005, "lomi ruso teba vilexine, batelo mite"), (None, "grunk"), (1005, "lomi ruso teba vilexine, batelo mite")]
    rows, marks = toxic_rows()
    got = toxic_crf.detect(docs_frame(spark, odd + rows).repartition(3), field).collect()
    by = {x["doc_id"]: x for x in got}
    assert len(got) == len(odd) + len(rows)
    assert all(by[i]["score"] == 0 and by[i]["spans"] == [] for i in (1000, 1001, 1002)) and by[1003]["score"] < 0.5
    assert [tuple(s) for s in by[1004]["spans"]] == [(len(long), len(long) + 5)]
    assert by[1005]["score"] > 5 * by[1003]["score"]  # a word never seen stands out by its beginning
    assert by[None]["score"] >= 0.5
    assert sum((by[i]["score"] >= 0.5) == bool(y) for i, y in marks) >= 396
    text = dict(rows)
    for i, y in marks:
        assert y or not by[i]["spans"]
        for s in by[i]["spans"]:
            assert text[i][s["start"] : s["end"]].startswith(("vilex", "grunk"))


def test_toxic_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    d = docs_frame(spark, [(1, "some text"), (2, None)])
    assert toxic_crf.train(d, labels, F.lit(True)) is None
    assert [x["score"] for x in toxic_crf.detect(d, None).collect()] == [0.0, 0.0]
    assert toxic_crf.detect(d.limit(0), None).count() == 0


# 12


def det(m):
    """Determinant by fractions, for the characteristic polynomial at a point."""
    from fractions import Fraction

    a, out = [[Fraction(v) for v in r] for r in m], Fraction(1)
    for k in range(len(a)):
        q = next((r for r in range(k, len(a)) if a[r][k]), None)
        if q is None:
            return Fraction(0)
        if q != k:
            a[k], a[q], out = a[q], a[k], -out
        out *= a[k][k]
        for r in range(k + 1, len(a)):
            f = a[r][k] / a[k][k]
            a[r] = [x - f * y for x, y in zip(a[r], a[k])]
    return out


@pytest.mark.parametrize("d", [1, 2, 3, 5, 9])
def test_characteristic_polynomial(d):
    r = np.random.default_rng(d)
    x = r.integers(-10**6, 10**6, (d + 2, d))
    x[:, -1] = x[:, 0]  # a dependent column
    g = (x.astype(object).T @ x.astype(object)).tolist()
    c = whiten_charpoly.charpoly(None, g)
    for t in range(-3, d):
        want = det([[t * (i == j) - g[i][j] for j in range(d)] for i in range(d)])
        assert sum(v * t ** (d - k) for k, v in enumerate(c)) == want
    eig = np.sort(np.linalg.eigvalsh(np.array(g, float)))[::-1]
    roots = whiten_charpoly.leading_roots(c, min(4, d))
    assert np.allclose([float(v) for v in roots], eig[: len(roots)], atol=1e-9 * eig[0])


def test_repeated_roots():
    g = [[2, 0, 0, 0], [0, 2, 0, 0], [0, 0, 2, 0], [0, 0, 0, 0]]
    f = whiten_charpoly.fit_one(None, 5, [0] * 4, g)
    u = np.array(f.units)[:3]
    assert f.roots == (2.0, 2.0, 2.0, 0.0) and np.allclose(u @ u.T, np.eye(3), atol=1e-15) and np.allclose(u[:, 3], 0)


def test_close_roots():
    """Roots that differ in the 15th digit have their own vectors."""
    q = np.array([[3, 4], [-4, 3]], object)  # 5 times a rotation
    g = (q.T @ np.diag([10**15, 10**15 + 1]).astype(object) @ q).tolist()
    f = whiten_charpoly.fit_one(None, 2, [0, 0], g)
    assert np.allclose(np.abs(np.array(f.units) @ q.T.astype(float) / 5), [[0, 1], [1, 0]], atol=1e-14)


def test_whitening(spark):
    r = np.random.default_rng(0)
    base = (r.normal(0, 1, (60, 7)) @ r.normal(0, 1, (7, 7))).astype(np.float32)
    rows = [(i, base[i].tolist(), 0) for i in range(60)]
    rows += [(100, base[3].tolist(), 1), (3, base[3].tolist(), 0), (None, base[4].tolist(), 0)]  # copies, in one id and another
    rows += [(200, None, 0), (201, [], 0), (202, [1.0, None], 0), (203, [1.0, float("nan")], 0), (204, [float("inf")] * 7, 0)]
    rows += [(300, [0.5, 0.25], 0), (301, [0.5, 0.25], 0), (302, [1e30, 1.0], 0), (400, [1.0] * 3, 0), (401, [2.0, 1.0, 1.0], 0)]
    got = whiten_charpoly.whitening(vec_frame(spark, rows).repartition(3)).toPandas()
    x = np.floor(256 * base.astype(float)).astype(np.int64)
    n, s = 60, x.sum(0)
    v = np.cov(x.T, bias=True)
    e, u = np.linalg.eigh(v)
    seven = got[got.dim == 7]
    assert len(seven) == 63 * 4 and set(seven.n) == {60}
    w = {}
    for t in seven.itertuples():
        k = -1 if t.vec_id != t.vec_id else int(t.vec_id)
        i = {100: 3, -1: 4}.get(k, k)
        assert int(t.deviation) == int(((n * x[i] - s) ** 2).sum())
        want = (x[i] - s / n) @ u[:, -t.component] / math.sqrt(e[-t.component])
        assert math.isclose(abs(t.whitened), abs(want), rel_tol=1e-9, abs_tol=1e-11) and math.isclose(t.explained, e[-t.component] / e.sum(), rel_tol=1e-10)
        w[i, t.component] = t.whitened
    m = np.array([[w[i, c] for c in range(1, 5)] for i in range(60)])
    assert np.abs(np.cov(m.T, bias=True) - np.eye(4)).max() < 1e-12 and seven.identity_error.max() < 1e-12
    two = got[got.dim == 2]
    assert len(two) == 4 and set(two.n) == {1} and two.whitened.isna().all() and (two.explained == 0).all() and set(two.identity_error) == {0.0}
    three = got[got.dim == 3].sort_values(["vec_id", "component"])
    assert three.whitened.notna().tolist() == [True, False, False] * 2 and np.allclose(np.abs(three.whitened.dropna()), 1)
    assert set(got.dim) == {2, 3, 7}
    assert whiten_charpoly.whitening(vec_frame(spark, rows[:1]).limit(0)).count() == 0


def test_whitening_of_huge_entries(spark):
    rows = [(i, [float(v) * 1e13, 1.0], 0) for i, v in enumerate([1, 2, 4])]
    got = whiten_charpoly.whitening(vec_frame(spark, rows)).collect()
    x = [int(math.floor(256 * float(np.float32(v * 1e13)))) for v in (1, 2, 4)]
    for r in got:
        assert int(r["deviation"]) == (3 * x[r["vec_id"]] - sum(x)) ** 2
    first = np.array([r["whitened"] for r in sorted(got, key=lambda r: r["vec_id"]) if r["component"] == 1])
    assert np.allclose(first.var(), 1)


# 13


def brute(rows, anchor, k_pos, k_neg, low, high):
    use = {}
    for i, e, y in rows:
        if i is None or y is None or not e or any(v is None or not math.isfinite(v) for v in e):
            continue
        x = tuple(math.floor(256 * float(np.float32(v))) for v in e)
        if sum(v * v for v in x) >= 2**62:
            continue
        use[i] = min(use.get(i, (y, x)), (y, x))
    out = set()
    for a, (y, x) in use.items():
        if not anchor(a):
            continue
        s = sorted((-sum(p * q for p, q in zip(x, z)), i) for i, (_, z) in use.items() if i != a and len(z) == len(x))
        pos = [t for t in s if use[t[1]][0] == y][:k_pos]
        for ps, p in pos:
            neg = [t for t in s if use[t[1]][0] != y and low * -ps <= 100 * -t[0] <= high * -ps][:k_neg]
            out |= {(a, p, r, i, -ps, -ns) for r, (ns, i) in enumerate(neg, 1)}
    return out


@pytest.mark.parametrize("block", [3, 50])
def test_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(slot_negatives, "ANCHOR_BLOCK", block)
    monkeypatch.setattr(slot_negatives, "ROW_BLOCK", (block, block))
    monkeypatch.setattr(slot_negatives, "PART", 40)
    r = np.random.default_rng(4)
    e = (np.abs(r.normal(0, 1, (150, 4))) * 0.05).astype(np.float32)  # coarse: many ties
    e[60:90] = e[0]
    rows = [(i, e[i].tolist(), 0 if i % 3 else int(i % 5)) for i in range(150)]  # two thirds share a label
    rows += [(1000, None, 1), (1001, [], 1), (1002, [1.0, None, 1.0, 1.0], 1), (1003, [1.0, float("inf"), 0.0, 0.0], 1), (1010, e[1].tolist(), None),
             (None, e[2].tolist(), 1), (10, e[10].tolist(), 0), (20, e[21].tolist(), 3), (1020, [1.0, 2.0], 1), (1021, [1.0, 2.0], 2), (1030, [-0.5] * 4, 4),
             (1040, [1e15] * 4, 0)]
    d = vec_frame(spark, rows).repartition(4)
    got = slot_negatives.mine(d, F.col("id") % 10 == 0).collect()
    want = brute(rows, lambda a: a % 10 == 0, 5, 3, 50, 95)
    assert len(got) == len(want) and {tuple(x) for x in got} == want and len(want) > 50
    assert slot_negatives.mine(d.limit(0), F.col("id") % 10 == 0).count() == 0


def test_large_scores():
    """Scores beyond 53 bits stay exact, ties included."""
    a = np.array([[2**30, 1], [2**30, -5]])
    b = np.array([[2**30, 0], [2**30, 1], [2**30, 0], [0, 2**30]])
    s = slot_negatives._scores(a, b)
    assert s.tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    r, c = slot_negatives.first_k(s, np.ones(s.shape, bool), 2)
    assert sorted(zip(r.tolist(), c.tolist())) == [(0, 0), (0, 1), (1, 0), (1, 2)]


def test_slots_and_suffixes():
    assert slot_negatives.slots([9, 4, 9, 7]) == [9, 7, 4]
    per = [[(9, 1), (8, 2)], [(6, 5)], [(4, 1), (3, 3), (2, 2)]]
    assert slot_negatives.suffix_merge(per, 3) == [[(9, 1), (8, 2), (6, 5)], [(6, 5), (4, 1), (3, 3)], [(4, 1), (3, 3), (2, 2)]]
    assert slot_negatives.limits(-7) == (-3, -7) and slot_negatives.limits(0) == (0, 0) and slot_negatives.limits(7) == (4, 6)


@pytest.mark.parametrize("name", ["op11_toxic_spans", "op12_embedding_whitening", "op13_hard_negatives"])
def test_registered(spark, sf, name):
    prepare(spark)
    assert queries.QUERIES[name](spark, sf).count() > 0
