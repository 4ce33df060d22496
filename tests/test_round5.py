"""Operators read their input once, move it once and keep their windows linear; results against plain loops."""

import random

from pyspark.sql import functions as F

from strandlight.operators import intervals as iv
from strandlight.operators import profiles as pf
from strandlight.operators import stats as st
from strandlight.operators import unzip as uz
from strandlight.sources import traces as ts


def plan(df):
    return df._jdf.queryExecution().toString().lower()


def counted(spark, df, name):
    """df and a counter of how often one of its rows has been computed."""
    seen = spark.sparkContext.accumulator(0)

    def touch(v):
        seen.add(1)
        return v

    return df.withColumn(name, F.udf(touch, "double").asNondeterministic()(F.col(name))), seen


def read_rows(spark, n=400):
    rnd = random.Random(3)
    rows = [(f"m{rnd.randrange(6)}", f"r{rnd.randrange(5)}", rnd.randrange(-60, 61), rnd.choice("MU")) for _ in range(n)]
    return spark.createDataFrame(rows, "motif_id string, read_id string, rel_pos int, status string"), rows


def test_f22_prepared_reads_are_joined_with_nothing(spark):
    df, rows = read_rows(spark)
    out = pf.prepare_reads(df, 60, 10, 12)
    assert "join" not in plan(out)
    group = {}
    for m, r, p, _ in rows:
        group.setdefault((m, r), []).append(p)
    ok = {k for k, v in group.items() if min(v) <= -10 and max(v) >= 10 and len(v) >= 12}
    assert 0 < len(ok) < len(group)
    want = sorted((m, r, p, p // 5 * 5, s) for m, r, p, s in rows if (m, r) in ok)
    assert sorted(tuple(x) for x in out.collect()) == want


def test_f6_cells_own_the_bins_around_them(spark):
    df, rows = read_rows(spark, 120)
    r = pf.raster(pf.prepare_reads(df, 60))
    cells = {}
    for x in r.collect():
        cells.setdefault((x.motif_id, x.read_id, x.row_ord), {})[x.rel_bin] = x.val
    first = sorted((m, min(c), rd, o) for (m, rd, o), c in cells.items())
    seen = {}
    for m, _, _, o in first:
        seen[m] = seen.get(m, 0) + 1
        assert o == seen[m]
    for L in (2, 3):
        want = set()
        for key, c in cells.items():
            for b in range(-60, 61, 5):
                near = min(((abs(b - o) // 5, 0 if o <= b else 1, o) for o in c), default=None)
                if near and near[0] <= L:
                    want.add((*key, b, c[near[2]]))
        out = pf.extend_calls(r, L, 60, 5)
        assert {tuple(x) for x in out.collect()} == want
        assert plan(out).split("== physical plan ==")[1].index("generate explode(sequence") >= 0
        assert "min_by" not in plan(out)  # no cell is offered to others and shuffled


def test_f8_f12_f16_f17_f21_rank_tests_read_their_rows_once(spark):
    rnd = random.Random(5)
    n = 600
    rows = [(rnd.choice("ab"), rnd.choice([1, 2]), rnd.randrange(40) / 8) for _ in range(n)]
    for run in (lambda d: st.mann_whitney(d, ["grp"], "s", "v"), lambda d: st.rank_test_table(d, "grp", "s", "v"),
                lambda d: st.median_ci(d, ["grp"], "v")):
        df, seen = counted(spark, spark.createDataFrame(rows, "grp string, s int, v double"), "v")
        assert run(df).count() == 2
        assert seen.value == n
    bp = [(f"m{i}", z, rnd.choice([None, rnd.randrange(5) / 4])) for i in range(50) for z in (1, 2, 3)]
    for method in ("wilcoxon", "mannwhitney"):
        df, seen = counted(spark, spark.createDataFrame(bp, "motif_id string, zf int, binding_prob double"), "binding_prob")
        assert st.pairwise_tests(df, [1, 2, 3], method).count() == 3
        assert seen.value == len(bp)


def test_f12_rank_sums_of_counted_values(spark):
    rnd = random.Random(7)
    rows = [("a", rnd.choice([1, 2]), rnd.randrange(9) / 4) for _ in range(200)] + [("b", 2, 1.0), ("c", None, 1.0), ("a", None, 0.0), ("a", 1, None)]
    got = {x.k: x for x in st.rank_sums(spark.createDataFrame(rows, "k string, s int, v double"), ["k"], "s", "v").collect()}
    a = [(s, v) for k, s, v in rows if k == "a" and s and v is not None]
    rank = lambda v: sum(w < v for _, w in a) + (sum(w == v for _, w in a) + 1) / 2
    for i in (1, 2):
        mine = [v for s, v in a if s == i]
        assert got["a"][f"n{i}"] == len(mine) and got["a"][f"r{i}"] == sum(map(rank, mine))
        assert abs(got["a"][f"mean{i}"] - sum(mine) / len(mine)) < 1e-12
    assert got["a"].tie_term == sum(c**3 - c for c in (sum(w == v for _, w in a) for v in {w for _, w in a}))
    assert (got["b"].n1, got["b"].n2, got["b"].mean1, got["b"].mean2) == (0, 1, None, 1.0) and "c" not in got


def test_f13_runs_share_a_task(spark):
    rnd = random.Random(11)
    rows = [(c, i, i, float(t), rnd.choice([1.0, 2.0, 3.0, None])) for c in range(40)
            for i, t in enumerate(sorted(rnd.sample(range(300), 25)))]
    df = spark.createDataFrame(rows, "curve long, block long, idx long, t double, value double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # runs go across batches
    try:
        out = uz.merge_close(df, "+", ["curve"], 9.0, chunk_s=50.0)
        assert "flatmapgroups" not in plan(out)
        got = {(x.curve, x.idx) for x in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for c in range(40):
        cur = None
        for r in reversed([r for r in rows if r[0] == c]):
            if cur is not None and cur[3] - r[3] < 9.0:
                if None not in (cur[4], r[4]) and cur[4] < r[4]:
                    cur = r
            else:
                want |= {(c, cur[2])} if cur else set()
                cur = r
        want.add((c, cur[2]))
    assert got == want


def test_f14_files_are_listed_once(spark, tmp_path):
    for i in range(40):
        d = tmp_path / f"c{i}"
        d.mkdir()
        (d / "a.csv").write_text(f"time (seconds),force (pN)\n0,{i}\n1,2\n")
        (d / "_started").write_text("x\n")
    (tmp_path / "c0" / "0.csv").write_text("")
    sc = spark.sparkContext
    sc.setJobGroup("f14", "listing")
    try:
        df = ts.read_traces(spark, str(tmp_path))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("f14")) == 2  # the header of one file, one listing
    assert df.count() == 80 and df.select("trace_id").distinct().count() == 40
    assert ts._first_file(spark, str(tmp_path)).endswith("/a.csv") and ts._first_file(spark, str(tmp_path / "no")) is None


def test_f15_windows_never_sum_to_the_end_anew(spark):
    x = spark.createDataFrame([(0, float(i), i) for i in range(30)], "key int, value double, id int")
    y = spark.createDataFrame([(0, float(3 * i), i) for i in range(9)], "key int, value double, idx int")
    p = spark.createDataFrame([(i / 50,) for i in range(40)], "p double")
    for df in (iv.nearest_index(x, y), st.bh_adjust(p, "p")):
        whole = "unboundedpreceding$(), unboundedfollowing$()"  # such a frame is summed once
        assert "unboundedfollowing" not in plan(df).replace(whole, "")
    want = {(i, min(range(9), key=lambda j: (abs(i - 3 * j), j))) for i in range(30)}
    assert {(r.id, r.nearest_idx) for r in iv.nearest_index(x, y).collect()} == want


def test_f20_partitions_follow_the_intervals(spark):
    rnd = random.Random(13)
    rows = [(rnd.choice(["c1", "c2"]), s, s + rnd.randrange(1, 60), rnd.choice("xyz")) for s in (rnd.randrange(900) for _ in range(250))]
    out = iv.multi_depth(spark.createDataFrame(rows, "chrom string, start long, end long, replicate string"), 2, chunk_bp=64, rows=100)
    assert ", 5), repartition_by_num" in plan(out)
    want = set()
    for c in ("c1", "c2"):
        mine = [r for r in rows if r[0] == c]
        pts = sorted({p for r in mine for p in r[1:3]})
        for a, b in zip(pts, pts[1:]):
            k = len({r[3] for r in mine if r[1] <= a and r[2] >= b})
            if k >= 2:
                want.add((c, a, b, k))
    assert {tuple(r) for r in out.collect()} == want
