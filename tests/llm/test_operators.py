"""Corpus operators against brute force on small tables with awkward rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

import corpus_pipeline
from strandlight.llm import (
    embed_ego, fm_decontam, jaccard_metric, lang_cnn, lattice_lm, license_rules, pack_bounded, pii_semicrf, suffix_dedup, url_templates,
)
from strandlight.session import cut_lineage
from strandlight.llm.common import components, crc_mod, prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _p string, _hits string, doc string, t string, n string, v string"
RNG = random.Random(3)
WORDS = ["".join(RNG.choice(["th", "er", "an", "ing", "ou", "st", "re"]) for _ in range(RNG.randint(1, 4))) for _ in range(800)]
PLAIN = [f"{a}{b}" for a, b in itertools.product("bcdfglmnprstvz", ["aro", "ilu", "emi", "osa", "ute"])]


def prose(n: int, seed: int, pool=WORDS) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(pool) for _ in range(n)) + "."


BASE = prose(300, 1)
PASSAGE = prose(60, 2)
LONG = prose(6000, 4)
ROWS = [
    (1, None, "aa"), (2, "", "aa"), (3, " \t\n", None), (4, "one", "aa"), (5, "one two", "aa"), (6, BASE, "aa"), (7, BASE, "aa"),
    (8, BASE.replace(BASE.split()[100], "changedword", 1), "aa"), (9, LONG, "aa"), (10, PASSAGE + " " + prose(50, 5), "aa"),
    (11, prose(40, 6) + " " + PASSAGE, "aa"), (12, "ab" * 400, "aa"), (None, "no id here at all", "aa"), (13, "É è ü 東京 " + prose(80, 7), "aa"),
    (14, "1234 5678", "aa"), (15, "ONE two", "aa"),
] + [(100 + i, prose(60, 50 + i, WORDS if i % 2 else PLAIN), "aa" if i % 2 else "bb") for i in range(40)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", "x", "x", "x", "x", "x") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return frame(spark, ROWS + [ROWS[5]]).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    prepare(spark)
    return frame(spark, []).select("*")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", low(t))


def groups(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    prepare(spark)
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 300)] + [(r.randint(400, 500), r.randint(400, 500)) for _ in range(70)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()}
    want = groups({x for e in edges for x in e}, edges)
    assert all(got.get(i, i) == c for i, c in want.items())
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# 1


def test_embeddings(spark):
    prepare(spark)
    r = np.random.default_rng(0)
    base = r.normal(size=(30, 16))
    rows = [(i, [float(x) for x in np.float32(base[i % 30] + (i >= 30) * r.normal(size=16) * r.choice([0.01, 0.1, 0.2]))], i % 3) for i in range(300)]
    rows += [(300, rows[0][1], rows[0][2]), (301, rows[0][1], rows[0][2]), (302, None, 1), (303, [], 1), (304, [0.0] * 16, 1), (305, [float("nan")] * 16, 1),
             (306, [None] + [1.0] * 15, 1), (307, rows[0][1], None), (308, rows[0][1][:8], rows[0][2])]
    df = spark.createDataFrame([(*x, "c", "c") for x in rows], "vec_id long, embedding array<float>, label int, v string, rep string").repartition(4)
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in embed_ego.join(df).collect()}
    ok = [x for x in rows if x[0] < 302 or x[0] == 308]
    links = []
    for a, b in itertools.combinations(ok, 2):
        if a[2] == b[2] and len(a[1]) == len(b[1]):
            p, q = np.float32(a[1]).astype(float), np.float32(b[1]).astype(float)
            if p @ q / (np.linalg.norm(p) * np.linalg.norm(q)) >= 0.98:
                links.append((a[0], b[0]))
    n, g = collections.Counter(x for e in links for x in e), groups([x[0] for x in rows], links)
    assert len(links) > 100
    assert got == {i: (n[i], g[i], g[i] == i) for i in g}
    assert embed_ego.join(df.limit(0)).count() == 0


def test_embedding_recursion():
    """Large intervals give the same links as one comparison of all."""
    r = np.random.default_rng(1)
    v = np.repeat(r.normal(size=(20, 8)), 40, 0) + r.normal(size=(800, 8)) * 0.05
    v = v[np.argsort(v[:, 0])]
    ids, mult = np.arange(800), np.ones(800, np.int64)
    axes = {8: np.eye(8)[:6]}
    d, _, edges = embed_ego.join_intervals((ids, mult, v), (ids, mult, v), True, axes, 0.98)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    m = (u @ u.T >= 0.98) & ~np.eye(800, dtype=bool)
    assert (d == m.sum(1)).all()
    assert groups(ids.tolist(), edges) == groups(ids.tolist(), list(zip(*np.nonzero(m))))
    a, b = slice(0, 500), slice(500, 800)
    d1, d2, _ = embed_ego.join_intervals((ids[a], mult[a], v[a]), (ids[b], mult[b], v[b]), False, axes, 0.98)
    assert (d1 == m[a, b].sum(1)).all() and (d2 == m[a, b].sum(0)).all()


# 2

PII = [
    "mail me at a.b+c@mail.example.com or x@y or @z.com, 10.0.0.255 and 1.2.3.256 and 1.2.3.4.5.6.7.8",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 then +1 (974) 555-3436 and +12 3", "é 東 +49 30 1234567890 00012.1.1.1 a@b.c@d.e",
    "+1+2+3 (((( 5" + "1" * 300 + ".1.1.1", "x" * 3000 + "@" + "y" * 3000 + ".zz", "-" * 500 + "1-1" * 40,
]


def base_by_patterns(t):
    rx = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(rx):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = [True, k != 1 or all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and pii_semicrf.luhn(d), 10 <= len(d) <= 15]
            if ok[k]:
                out.append((m.start(), k, m.end()))
    return [(pii_semicrf.KINDS[k], a, b) for a, k, b in sorted(out)]


def test_pii_base_and_field(spark, docs):
    for t in [*PII, None, "", LONG]:
        assert pii_semicrf.base_spans(t) == base_by_patterns(t)
    r = random.Random(2)
    texts = [f"{prose(5, i)} {r.choice(['mail%d@host.example.com' % i, '+1 (9%02d) 555-%04d' % (i % 100, i), '10.1.%d.7' % (i % 200), '4111111111111111'])} {prose(4, i)}" for i in range(150)]
    w = pii_semicrf.fit(texts)
    added = pii_semicrf.find("call (974) 555-3436 or write to bob at mail dot example dot com", w)[1]
    assert ("phone", 5, 19) in added and any(k == "email" for k, _, _ in added)
    assert pii_semicrf.find("order 1234567890123456 of 2021 rooms", w) == ([], [])
    assert pii_semicrf.fit(["nothing here"]) is None and pii_semicrf.find("a@b.cd", None)[0] == [("email", 0, 6)]
    assert pii_semicrf.mask("a 10.0.0.1 b", [("ip", 2, 10)]) == "a [IP] b"
    out = docs.select("doc_id", pii_semicrf.spans_column(F.col("text"), w).alias("z")).collect()
    assert len(out) == len(ROWS) + 1
    assert pii_semicrf.train(docs.limit(0)) is None


def test_pii_written_at():
    """Addresses with a written "at" and real dots, or in capitals, are candidates and are found."""
    r = random.Random(4)
    texts = [f"{prose(5, i)} {r.choice(['mail%d@host.example.com' % i, '+1 (9%02d) 555-%04d' % (i % 100, i), '10.1.%d.7' % (i % 200)])} {prose(4, i)}" for i in range(150)]
    w = pii_semicrf.fit(texts)
    for x in ("jane.roe (at) example.com", "jane [at] example.com", "jane.roe (AT) example.com", "jane.roe AT mail DOT example DOT com", "jane @ example.com"):
        t = f"write to us: {x} or come by"
        assert any(a <= 13 and b >= 13 + len(x) for a, b in pii_semicrf.islands(t)), x
        assert ("email", 13, 13 + len(x)) in pii_semicrf.find(t, w)[1], x
    for t in ("come at noon. Then go", "at @ . dot", "we met at the house", "a@b", "x (at) y"):
        assert pii_semicrf.islands(t) == []


def test_semi_markov_sums():
    """Forward-backward equals the sum over all segmentations of a short island."""
    t = "555 123 4567"
    lat = pii_semicrf.Lattice(t, 0, len(t))
    w = np.random.default_rng(0).normal(size=(len(pii_semicrf.KINDS), pii_semicrf.WIDTH))
    score = lat.f @ w.T
    paths = collections.defaultdict(list)
    paths[0] = [(0.0, ())]
    for j in range(1, lat.n + 1):
        paths[j] = list(paths[j - 1])
        for k, (i, e, s, x) in enumerate(lat.segs):
            if e == j:
                paths[j] += [(v + score[k, y], (*p, (pii_semicrf.KINDS[y], s, x))) for v, p in paths[i] for y in range(len(pii_semicrf.KINDS))]
    z = np.logaddexp.reduce([v for v, _ in paths[lat.n]])
    v, p = max(paths[lat.n])
    assert lat.best(w) == list(p) or math.isclose(v, 0)
    ll, g = lat.gradient(w, set(p))
    assert math.isclose(ll, v - z, rel_tol=1e-9)
    step = np.zeros_like(w)
    step[2, 0] = 1e-6
    assert math.isclose((lat.gradient(w + step, set(p))[0] - ll) / 1e-6, g[2, 0], rel_tol=1e-3, abs_tol=1e-5)


# 3


def test_license_rules(spark):
    mit = "\n".join(license_rules.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-warranty", "mit-liability"))
    wrapped = license_rules.SENTENCES["mit-grant"].replace("free of charge, to any", "free of charge, to\nany")
    rows = [(1, None), (2, ""), (3, "Text. Released under the MIT License.\nMore"), (4, mit), (5, "\n".join(reversed(mit.split("\n")))), (6, wrapped + " x"),
            (7, "all  RIGHTS\treserved!\nAll rights reserved."), (8, "not all rights reserved"), (9, LONG + "\nLicensed under CC BY-NC 4.0.\n" + LONG)]
    df = spark.createDataFrame([(*x, "c", "c") for x in rows], "doc_id long, text string, ids string, hit string")
    got = {x["doc_id"]: x for x in license_rules.scan(df).collect()}
    assert [got[i]["primary_license"] for i in range(1, 10)] == [None, None, "MIT", "MIT", None, None, "All-rights-reserved", None, "CC-BY-NC-4.0"]
    assert got[4]["n_sentences"] == 4 and got[5]["n_sentences"] == 4 and got[7]["sentence_ids"] == "reserved,reserved"
    assert license_rules.scan(df.limit(0)).count() == 0


GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
APACHE = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_license_wrappings(spark):
    """The published wrappings, bare and as comments, and texts that only look like them."""
    want = {"GPL-3.0": GPL, "Apache-2.0": APACHE, "MIT": MIT, "BSD-3-Clause": BSD}
    signs = ["", "# ", " * ", "// ", "REM ", "dnl ", ";; "]
    rows = [(name, f"{name}{k}", "".join(f"{p}{x}{e}" for x in t.split("\n"))) for name, t in want.items() for k, (p, e) in enumerate(itertools.product(signs, ("\n", "\r\n")))]
    rows += [(None, "not", "not\nall rights reserved"), (None, "free", "\n" * 9000 + " \n" * 9000), ("All-rights-reserved", "marks", "a\1b\2\n\n\nAll rights\n  RESERVED")]
    df = spark.createDataFrame([(i, t, "c", "c") for _, i, t in rows], "doc_id string, text string, ids string, hit string")
    got = {x["doc_id"]: x for x in license_rules.scan(df).collect()}
    assert {i: got[i]["primary_license"] for _, i, _ in rows} == {i: name for name, i, _ in rows}
    assert got["Apache-2.00"]["sentence_ids"] == "apache-head,apache-copy,apache-basis,apache-see"
    assert got["BSD-3-Clause2"]["sentence_ids"] == "reserved,bsd-use,bsd-source,bsd-binary,bsd-names"


# 4


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = split(t)
        out[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    return out


def jaccard_brute(rows):
    s = shingle_sets(rows)
    links = [(a, b) for a, b in itertools.combinations(s, 2) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 90 * len(s[a] | s[b])]
    return {i: (len(s[i]), c) for i, c in groups(list(s), links).items()}


def test_jaccard_edges(spark, docs, none):
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_metric.join(docs).collect()}
    want = jaccard_brute([(i, t) for i, t, _ in ROWS if i is not None])
    assert {k: v for k, v in got.items() if k is not None} == want
    assert got[None][1] is None and got[15][1] == 5
    assert jaccard_metric.join(none).count() == 0


def test_jaccard_crowd(spark, monkeypatch):
    """A crowd of near copies around a centre, chains, a shared passage; cells and blocks made small."""
    prepare(spark)
    for k, v in {"LEAF": 8, "PIVOTS": 3, "HOT": 30}.items():
        monkeypatch.setattr(jaccard_metric, k, v)
    r = random.Random(9)
    rows, i = [], 0

    def edited(w, n):
        w = list(w)
        for k in r.sample(range(len(w)), n):
            w[k] = f"edit{r.random()}"
        return w

    base = prose(120, 77).split()
    for _ in range(70):
        rows.append((i := i + 1, " ".join(edited(base, r.randint(0, 4)))))
    for c in range(6):
        w = prose(100, 300 + c).split()
        for _ in range(6):
            rows.append((i := i + 1, " ".join(w)))
            w = edited(w, 1)
    for k in range(40):
        rows.append((i := i + 1, PASSAGE + " " + prose(r.randint(3, 60), 900 + k)))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_metric.join(df).collect()}
    want = jaccard_brute(rows)
    assert len({c for _, c in want.values()}) < len(rows) - 60
    assert got == want


def test_regions_in_pieces():
    """Groups longer than a run name their regions themselves; every other group is met whole."""
    r = np.random.default_rng(6)
    s = np.sort(np.r_[np.zeros(500, np.int64), r.integers(1, 60, 400), np.full(300, 60)])
    doc, n = np.arange(len(s)), r.integers(5, 40, len(s)).astype(np.int64)
    batches = [pa.RecordBatch.from_pydict({"s": s[i : i + 37], "doc": doc[i : i + 37], "n": n[i : i + 37]}) for i in range(0, len(s), 37)]

    def met(rows):
        by = collections.defaultdict(dict)
        for b in jaccard_metric._regions(4, 5, rows)(iter(batches)):
            for r1, r2, d, h in zip(*(c.to_pylist() for c in b.columns)):
                by[r1, r2].setdefault(d, h)
        return {(x, y) for g in by.values() for x, y in itertools.combinations(sorted(g), 2) if g[x] or g[y]}

    assert met(100) == met(10_000)


def test_voronoi_windows():
    """Every close pair shares a cell in which one of the two is at home."""
    r = np.random.default_rng(2)
    sk = np.repeat(r.integers(0, 40, (60, 128)), 20, 0) + r.integers(0, 2, (1200, 128))
    sk = sk.astype(np.int16)
    cells = jaccard_metric.voronoi(sk, 60)
    assert max(len(a) + len(b) for a, b in cells) < 900
    assert sorted(np.concatenate([a for a, _ in cells])) == list(range(1200))
    for i in r.choice(1200, 60, replace=False):
        near = set(np.flatnonzero(np.abs(sk - sk[i]).sum(1) <= 60))
        own = next(c for c in cells if i in c[0])
        assert near <= set(own[0]) | set(own[1])


def test_short_sets_of_one_region():
    """No link of distinct short sets is lost between cells of the production size, at odd totals either."""
    for num, den in ((9, 10), (4, 5)):
        for big in range(1, 400):
            most = max(t - 2 * -(-num * t // (num + den)) for t in range(2 * big + 1))
            assert jaccard_metric.widest(big, num, den) == most
    r = np.random.default_rng(8)
    sets = set()
    while len(sets) < 900:  # one shingle in common
        x = [0, *(1 + r.choice(30, r.integers(8, 18), replace=False)).tolist()]
        sets |= {frozenset(x), frozenset(x[:-1])}
    sets = sorted(sets, key=sorted)
    n, doc = np.array([len(x) for x in sets]), np.arange(len(sets))
    sk = np.zeros((len(sets), jaccard_metric.CLASSES), np.uint8)
    for i, x in enumerate(sets):
        sk[i, list(x)] = 1
    assert len(jaccard_metric.voronoi(sk.astype(np.int16), jaccard_metric.widest(18, 9, 10))) > 1
    both = sk.astype(int) @ sk.T.astype(int)
    want = {(a, b) for a, b in zip(*np.nonzero(10 * both >= 9 * (n[:, None] + n[None] - both))) if a < b}
    x, y, _ = jaccard_metric.region_pairs(doc, n, sk, doc, np.ones(len(n), bool), None, 0, len(n), 9, 10)
    assert {(min(p), max(p)) for p in zip(x.tolist(), y.tolist())} == want and len(want) == 405


# 5


def test_url_parts_and_rules(spark):
    prepare(spark)
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1?x#y", "https://example.org/en/12", "x://org/", "https://www.shop.com/de/1", "https://shop.com/fr/#a",
            "http://dotcom/fr/", "http://h.net?/a", "http://h.net#/a", "a://b://c/d", "http://h.net/" + "/".join(["p"] * 3000)]
    df = spark.createDataFrame([(i, u, "x", "x", "x") for i, u in enumerate(urls)] + [(0, None, "x", "x", "x")], "page_id long, url string, host string, segs string, template string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in url_templates.judge(df, lab).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[5][2:] == ("example.org/en/1", "block") and got[6][2:] == ("org/", "allow")
    assert got[7][2:] == ("com/de/", "block") and got[8][2:] == ("com/fr/", "allow") and got[9][2] is None
    assert got[10][:2] == got[11][:2] == ("h.net", "") and got[12][:2] == ("b:", "//c/d")
    assert url_templates.judge(df.limit(0), lab).count() == 0


def test_url_tree(spark):
    """A bad branch is rejected, its like-minded siblings are merged, variable segments vanish."""
    prepare(spark)
    rows, lab = [], []
    for k in range(900):
        branch = ("news", "blog", "spam")[k % 3]
        rows.append((k, f"http://h.net/{branch}/item-{k}.html"))
        lab.append((k, 0 if branch == "spam" and k % 30 else 1, 0))
    df, lb = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
    got = url_templates.judge(df, lb).groupBy("template", "verdict").count().collect()
    assert {(x["verdict"], x["count"]) for x in got if "spam" in x["template"]} == {("block", 300)}
    assert {x["verdict"] for x in got if "spam" not in x["template"]} == {"allow"} and len(got) <= 3


def test_url_small_bad_section(spark):
    """A bad section of 0.9 % of a hot host is rejected apart from its small good siblings."""
    prepare(spark)
    names = [f"big{'abc'[k % 3]}" for k in range(5400)] + [f"small{'abcdefghijklmnopqrs'[k % 19]}" for k in range(1140)] + ["bad"] * 60
    df = spark.createDataFrame([(k, f"http://hot.net/{x}/item-{k}") for k, x in enumerate(names)], "page_id long, url string")
    lb = spark.createDataFrame([(k, int(x != "bad"), 0) for k, x in enumerate(names)], "doc_id long, quality int, toxic int")
    got = {(names[x["page_id"]] == "bad", x["verdict"]) for x in url_templates.judge(df, lb).collect()}
    assert got == {(True, "block"), (False, "allow")}


# 6


def hits_brute(t, items):
    rx = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    w, hit, found = re.findall(rx, low(t)), set(), set()
    for i, x in items:
        p = re.findall(rx, low(x))
        for k in range(max(1, len(p) - 9) if p else 0):
            for a in range(len(w) - len(p[k : k + 10]) + 1):
                if w[a : a + len(p[k : k + 10])] == p[k : k + 10]:
                    hit.update(range(a, a + len(p[k : k + 10])))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark, docs, none):
    items = [(1, PASSAGE), (2, " ".join(BASE.split()[20:45])), (3, "one, TWO"), (4, None), (5, ""), (6, "absent words only here"), (7, PASSAGE), (10, " ".join(LONG.split()[-12:])), (None, "one")]
    bench = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, i string")
    for block in (fm_decontam.BLOCK_WORDS, 20):
        got = fm_decontam.find_hits(spark, docs, bench, block_words=block, out="z").select("doc_id", "text", "z", fm_decontam.remove_column(F.col("text"), F.col("z")).alias("cut")).collect()
        for x in got:
            n, hit, found = hits_brute(x["text"], [i for i in items if i[0] is not None])
            assert (x["z"]["n_words"], x["z"]["n_hit"], list(x["z"]["items"])) == (n, hit, found)
            assert hits_brute(x["cut"], [(1, PASSAGE)])[1] == 0 and (hit or x["cut"] == x["text"])
    assert fm_decontam.find_hits(spark, none, bench, out="z").count() == 0
    assert fm_decontam.find_hits(spark, docs, bench.limit(0), out="z").filter("z.n_hit > 0").count() == 0


def test_fm_index():
    r = np.random.default_rng(0)
    s = r.integers(1, 5, 500)
    s[200:300] = s[50:150]
    ix = fm_decontam.FmIndex(s, 5, sample=7)
    order = sorted(range(501), key=lambda i: list(s[i:]) + [0])
    assert fm_decontam.suffix_order(np.r_[s, 0]).tolist() == order
    for m in (1, 3, 6, 9):
        for a in range(0, 480, 13):
            p = s[a : a + m]
            lo, hi = ix.search(np.r_[np.zeros(9 - m, np.int64), p][None])
            got = sorted(ix.locate(np.arange(lo[0], hi[0])))
            assert got == [i for i in range(501 - m) if (s[i : i + m] == p).all()]


# 7


def dedup_brute(rows, size):
    seen, out = {}, {}
    for i, t in sorted((i, t) for i, t in rows):
        b = (t or "").encode()
        c = np.zeros(len(b), bool)
        for k in range(len(b) - size + 1):
            if seen.setdefault(b[k : k + size], (i, k)) != (i, k):
                c[k : k + size] = True
        out[i] = (len(b), int(c.sum()), int((np.diff(np.r_[0, c.astype(int)]) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~c])).hexdigest())
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_suffix_dedup(spark, docs, none, hot):
    got = {x["doc_id"]: tuple(x)[1:5] for x in suffix_dedup.dedup(docs, hot=hot).collect()}
    want = dedup_brute([(i, t) for i, t, _ in ROWS if i is not None], 100)
    assert {k: v for k, v in got.items() if k is not None} == want
    assert got[None][1] == 0 and want[12][1] > 0 and want[11][1] >= 300
    if hot > 2:
        assert suffix_dedup.dedup(none).count() == 0


def test_deep_shallow_order():
    r = np.random.default_rng(0)
    rows = r.integers(97, 99, (400, 40)).astype(np.uint8)
    rows[100:200, :30] = rows[0, :30]
    rows[200:260] = rows[0]
    group = r.integers(0, 3, 400)
    order, lcp = suffix_dedup.deep_shallow(rows, group, shallow=16)
    keys = [(int(group[i]), rows[i].tobytes()) for i in order]
    assert keys == sorted(keys)
    for a, b, c in zip(keys, keys[1:], lcp[1:]):
        if a[0] == b[0]:
            assert c == next((k for k in range(40) if a[1][k] != b[1][k]), 40)


# 8


def test_lattice_marginals():
    ps = lattice_lm.Pieces([b" th", b"th", b"the", b" the", b"he", b"er", b"ing", b" "])
    p = {n: math.exp(x) for n, x in zip(ps.names, ps.logp)}
    assert math.isclose(sum(p.values()), 1)

    def brute(w):
        a = [1.0] + [0.0] * len(w)
        for j in range(1, len(w) + 1):
            a[j] = sum(a[i] * p.get(w[i:j], 0) for i in range(j))
        return math.log(a[-1])

    ws = [b"the", b"thering", b"x", "é東".encode(), b"q" * 20]
    assert np.allclose(lattice_lm.marginals(ws, ps), [brute(b" " + w) for w in ws])
    e = lattice_lm.expected(ws, np.ones(5), ps)
    assert math.isclose(sum(x * len(n) for x, n in zip(e, ps.names)), sum(len(w) + 1 for w in ws))  # every byte is covered once


def test_lattice_scores(spark, docs, none):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {x["doc_id"]: x for x in lattice_lm.score(docs.dropDuplicates(["doc_id"]), crc_mod("doc_id", 10) == 0, path, rounds=1, frequent=50).collect()}
    rows = [(i, t) for i, t, _ in ROWS]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c, ends = collections.Counter(), 0
    for i, t in rows:
        if i is not None and not held[i]:
            c.update(split(t))
            ends += 1
    n, v = c.total() + ends, len(c) + 1
    for i, t in rows:
        w = split(t)
        base = sum(math.log10((k + 0.1) / (n + 0.1 * (v + 1))) for k in [*(c[x] for x in w), ends])
        x = got[i]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (held[i], len(w) + 1, sum(c[y] > 0 for y in w) + 1, n)
        assert math.isclose(x["base_score"], base, rel_tol=1e-9) and x["score"] < 0
    assert math.isclose(got[1]["score"], math.log10((ends + 0.5) / (n + 1)))
    assert lattice_lm.score(none, crc_mod("doc_id", 10) == 0, path, rounds=1).count() == 0


def test_lattice_frequent_words_are_bounded(spark):
    """The driver gets at most the bounded number of words, not that many of every partition."""
    import public_tokenizers

    def sent() -> int:
        sc, jvm = spark.sparkContext, spark._jvm
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return max(stages.apply(i).resultSize() for i in range(stages.size()) if stages.apply(i).stageId() > last)

    last = max(spark.sparkContext.parallelize([0]).mapPartitions(lambda _: [TaskContext.get().stageId()]).collect())
    texts = spark.createDataFrame([(i, " ".join(f"word-{i}-{k}-{'x' * 80}" for k in range(500))) for i in range(100)], "doc_id long, text string")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # eight tasks hold words
    try:
        n = lattice_lm.score(texts, F.lit(False), public_tokenizers.path("piece_bpe_32k.model"), rounds=0, frequent=5000).agg(F.sum("n_known")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert n == 100 * 501
    assert sent() < 1_000_000  # 5,000 words of about 100 bytes with two scores; eight times that before
    scored = spark.range(1, 3001).select(F.encode(F.col("id").cast("string"), "utf-8").alias("w"), F.lit(0.0).alias("b"), F.lit(0.0).alias("p"), (3000 / F.col("id")).cast("long").alias("c"))
    for most in (0, 50, 1000, 3000):
        got = {int(w) for w in lattice_lm.most_frequent(scored, most)["w"].to_pylist()}
        assert 0.9 * most <= len(got) <= most and all(3000 // max(got) > 0.9 * (3000 // i) for i in range(1, max(got, default=0)) if i not in got)
    same = scored.withColumn("c", F.lit(7).cast("long"))  # equal counts are split, not dropped as a whole
    assert 1800 <= lattice_lm.most_frequent(same, 2000).num_rows <= 2000


# 9


def test_packing(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = docs.dropDuplicates(["doc_id"])
    got = pack_bounded.pack(own, path, length=256, open_windows=4, merge=1).toPandas()
    tok = Tokenizer.from_file(path)
    texts = {i: t for i, t, _ in ROWS}
    for i, g in got.groupby("doc_id", dropna=False):
        i = None if i != i else int(i)
        ids = np.array(tok.encode(texts[i] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for x in g.sort_values("start").itertuples():
            assert (x.start, x.doc_tokens, x.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + x.length].tobytes()))
            at += x.length
        assert at == len(ids)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == np.r_[0, g.length.cumsum()[:-1]]).all() and g.length.sum() <= 256
    assert got.sequence_id.nunique() * 256 < 1.1 * got.length.sum() + 5 * 256
    assert pack_bounded.pack(none, path).count() == 0


def test_token_ids_equal_the_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), pack_bounded.encoder(path)
    for t in [None, "", "a", " \n\n  x", "it's  we'll\t\tÉè 東京 12 345", LONG, "a<|endoftext|>b", "x" * 5000, "\u00a0\u2003 end  "]:
        assert enc.ids(t).tolist() == (tok.encode(t, add_special_tokens=False).ids if t else [])


# 10


def test_languages(spark, docs, none):
    net = lang_cnn.train(docs, crc_mod("doc_id", 5) != 0)
    out = docs.select("doc_id", "lang", lang_cnn.language_column(F.col("text"), net).alias("z")).collect()
    got = {x["doc_id"]: (x["z"]["lang"], x["z"]["score"]) for x in out}
    assert len(out) == len(ROWS) + 1
    for i in (1, 2, 3, 14):
        assert got[i] == ("und", 0.0)
    far = [i for i in range(100, 140) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i][0] == ("aa" if i % 2 else "bb") for i in far) >= 0.9 * len(far)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert lang_cnn.train(none, crc_mod("doc_id", 5) != 0) is None
    assert lang_cnn.languages(["text", None], None) == (["und", "und"], [0.0, 0.0])


def test_network_gradient():
    net = lang_cnn.ByteCnn(["a", "b"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = np.stack([lang_cnn.windows(b"hello there")[0], lang_cnn.windows(b"bonjour vous")[0]]), np.array([0, 1])
    g = net._grad(x, y)

    def loss():
        return -np.log(net.forward(x)[0][np.arange(2), y]).mean()

    for k, at in (("d", (3, 1)), ("k3", (5, 2)), ("emb", (ord("e"), 1)), ("c2", (4,))):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-5
        up = loss()
        net.p[k][at] = old - 1e-5
        down = loss()
        net.p[k][at] = old
        assert math.isclose((up - down) / 2e-5, g[k][at], rel_tol=1e-2, abs_tol=1e-5)


# pipeline


def test_pipeline(spark, docs, none, tmp_path):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    extra = frame(spark, [(200, "Write to jo.do@mail.example.com, or +1 (974) 555-3436. " + prose(60, 999), "aa")])
    at = docs.union(extra)
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, at, str(tmp_path))
        if name != "pack":
            assert got.columns == docs.columns
        at = cut_lineage(got)
        rows = {x["doc_id"]: x for x in at.collect()} if name != "pack" else {}
        sizes.append(at.count())
        if name == "language":
            assert not {1, 2, 3, 14} & set(rows) and 4 in rows
        if name == "near_copies":
            want = jaccard_brute([(i, t) for i, t, _ in ROWS if i not in (1, 2, 3, 14, None)])
            assert set(rows) - {None, 200} == {i for i, (_, c) in want.items() if i == c} and None in rows
        if name == "decontaminate":
            assert hits_brute(rows[10]["text"], [(1, PASSAGE)])[1] == 0 and rows[9]["text"] == LONG
        if name == "personal_data":
            assert "[EMAIL]" in rows[200]["text"] and "[PHONE]" in rows[200]["text"] and rows[200]["n_chars"] == len(rows[200]["text"])
    assert sizes[0] == len(ROWS) + 2 - 4 and sizes[-1] >= sizes[-2]
    at = none
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
    assert at.count() == 0


def test_near_copies_five_words(spark):
    """The stage equals brute force on five-word shingles at 0.8, also where three words at 0.9 find no link."""
    prepare(spark)
    r = random.Random(21)
    rows, i = [], 0
    for c in range(25):
        w = [f"w{r.randint(0, 5000)}" for _ in range(r.choice((51, 80, 110)))]
        for edits in range(r.randint(1, 5)):
            x = list(w)
            for k in range(edits):
                x[(k + 1) * len(x) // (edits + 1)] = f"edit{c}-{edits}-{k}"
            rows.append((i := i + 1, " ".join(x), "aa"))
    s = {i: {tuple(split(t)[k : k + 5]) for k in range(len(split(t)) - 4)} for i, t, _ in rows}
    links = [(a, b) for a, b in itertools.combinations(s, 2) if 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])]
    want = {i for i, c in groups(list(s), links).items() if i == c}
    loose = {i for i, (_, c) in jaccard_brute([(i, t) for i, t, _ in rows]).items() if i == c}
    assert len(want) < len(loose)
    got = [x["doc_id"] for x in corpus_pipeline.near_copies(spark, frame(spark, rows).repartition(4), "").collect()]
    assert sorted(got) == sorted(want)
