"""Candidates of the Jaccard join: texts that share much but link with nothing stay few, linked ones all pass."""

import random

import numpy as np
import pyarrow as pa

from strandlight.llm import jaccard_metric as jm


def test_unlinked_texts_of_a_region_are_no_candidates():
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(1200)]
    texts = []
    for k in range(60):  # about 60 shared of 100 shingles: far from a similarity of 0.8
        w = [f"x{k}_{i}" if rnd.random() < 0.05 else x for i, x in enumerate(base)]
        texts.append(" ".join(w))
        if k % 3 == 0:  # and a copy with a few words changed, which links
            texts.append(" ".join(f"y{k}_{i}" if i % 100 == 0 else x for i, x in enumerate(w)))
    none = np.zeros(0, np.uint64)
    made = pa.RecordBatch.from_pydict({"doc": pa.array(range(len(texts)), pa.int64()), "t": texts})
    f = next(jm._features(5, 4, 5, none, none.view(np.int64))(iter([made]))).to_pydict()
    m = len(texts)
    rows = pa.RecordBatch.from_pydict({k: [0] * m for k in ("r1", "r2", "i", "j", "block")} | {
        "doc": f["doc"], "home": [True] * m, "n": f["n"], "sketch": pa.array(f["sketch"], pa.binary()), "grp": f["doc"]})
    got = {p for b in jm._join_regions(0, m, 4, 5)(iter([rows])) for p in zip(*b.to_pydict().values())}
    sets = [set(jm.shingles(t, 5).tolist()) for t in texts]
    linked = {(x, y) for x in range(m) for y in range(x + 1, m) if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])}
    assert len(linked) == 20 and linked <= got
    assert len(got) <= 30  # 3,160 pairs share the region


def test_parities_never_exceed_the_difference():
    rnd = np.random.default_rng(4)
    for n in (1, 5, 80, 900, 6000):
        a = np.unique(rnd.integers(0, 1 << 63, n, np.uint64))
        for cut in (0, n // 9, n):
            b = np.unique(np.r_[a[cut:], rnd.integers(0, 1 << 63, cut, np.uint64)])
            x, y = (np.frombuffer(jm._sketch(s), np.uint8) for s in (a, b))
            d = len(np.setxor1d(a, b))
            assert np.bitwise_count(x[jm.CLASSES :] ^ y[jm.CLASSES :]).sum() <= d
            assert np.abs(x[: jm.CLASSES].astype(int) - y[: jm.CLASSES]).sum() <= d
