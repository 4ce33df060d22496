"""Unzipping curves: baselines, extrema, cycles."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlight.operators.traces import CHUNK_S, indexed
from strandlight.ordered import chunk_by, with_neighbors, with_running


def select_curves(files: DataFrame, file_type: str, selections: list | None = None) -> DataFrame:
    """Files holding the type token and no other one, of the chosen curves or
    (curve, cycle) pairs, sorted by name. Needs file_name, curve and cycle columns."""
    types = ["h5", "down", "calibration"]  # fixed values: file type tokens
    n = F.col("file_name")
    ok = n.contains(file_type) if file_type else F.lit(True)
    if file_type:
        for t in types:
            if t != file_type:
                ok = ok & ~n.contains(t)
    if selections and file_type:
        hit = F.lit(False)
        for s in selections:
            c = F.col("curve").cast("int")
            hit = hit | ((c == s[0]) & (F.col("cycle").cast("int") == s[1]) if isinstance(s, tuple) else c == s)
        ok = ok & hit
    return files.filter(ok).orderBy("file_name")


def poly_fit(df: DataFrame, keys: list[str], x: str, ys: list[str], deg: int = 7) -> DataFrame:
    """Least-squares polynomial of each y over x per key.

    The fit uses Chebyshev polynomials of x scaled to [-1, 1]: products T_i T_j reduce to sums of
    T_0..T_2deg, so one map-side-combined aggregate of 2 deg + 1 + (deg + 1) len(ys) sums per key
    carries everything; only an 8 x 8 system per key is solved in Python. Coefficients are
    returned lowest power first in the scaled variable (x - mid) / half.
    """
    ext = df.groupBy(*keys).agg(
        ((F.max(x) + F.min(x)) / 2).alias("mid"), F.greatest((F.max(x) - F.min(x)) / 2, F.lit(1e-12)).alias("half"))
    u = F.greatest(F.least((F.col(x) - F.col("mid")) / F.col("half"), F.lit(1.0)), F.lit(-1.0))
    j = df.join(F.broadcast(ext) if not keys else ext, keys).withColumn("_a", F.acos(u))
    T = lambda k: F.cos(F.col("_a") * k)
    sums = [F.sum(T(k)).alias(f"t{k}") for k in range(2 * deg + 1)]
    sums += [F.sum(T(k) * F.col(y)).alias(f"y{i}_{k}") for i, y in enumerate(ys) for k in range(deg + 1)]
    g = j.groupBy(*keys, "mid", "half").agg(*sums)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def solve(it):
        for p in it:
            out = {k: p[k] for k in [*keys, "mid", "half"]}
            coefs = {y: [] for y in ys}
            for r in p.to_dict("records"):
                t = np.array([r[f"t{k}"] for k in range(2 * deg + 1)])
                i, k = np.indices((deg + 1, deg + 1))
                gram = 0.5 * (t[i + k] + t[np.abs(i - k)])
                for q, y in enumerate(ys):
                    b = np.array([r[f"y{q}_{k}"] for k in range(deg + 1)])
                    c = np.linalg.lstsq(gram, b, rcond=None)[0]
                    full = np.zeros(deg + 1)
                    power = np.polynomial.chebyshev.cheb2poly(c)
                    full[: len(power)] = power
                    coefs[y].append(full.tolist())
            yield pd.DataFrame(out | {f"coef_{y}": coefs[y] for y in ys})

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", mid double, half double, " + ", ".join(
        f"coef_{y} array<double>" for y in ys)
    return g.mapInPandas(solve, schema)


def horner(coef: str, u: Column) -> Column:
    """Value of a polynomial given as an array, lowest power first."""
    return F.aggregate(F.reverse(F.col(coef)), F.lit(0.0), lambda acc, c: acc * u + c)


def subtract_baseline(df: DataFrame, base: DataFrame, ys: list[str], x: str = "trap", deg: int = 7, min_x: float = 2.3) -> DataFrame:
    """Subtract the polynomial of the mapped baseline curve (points with x > min_x) from each
    force channel; curves without a baseline stay as they are.

    ``df`` has baseline_curve (null = none); ``base`` has curve, x and the channels.
    """
    fit = poly_fit(base.filter(F.col(x) > min_x), ["curve"], x, ys, deg).withColumnRenamed("curve", "baseline_curve")
    j = df.join(fit, "baseline_curve", "left")
    u = (F.col(x) - F.col("mid")) / F.col("half")
    new = {f"{y}_base": F.when(F.col("mid").isNull(), F.col(y)).otherwise(F.col(y) - horner(f"coef_{y}", u)) for y in ys}
    return j.withColumns(new).drop("mid", "half", *[f"coef_{y}" for y in ys])


def block_extrema(df: DataFrame, value: str, n: int, sign: str, keys: list[str], below: tuple[str, float] | None = None) -> DataFrame:
    """The extreme value of each block of n rows with its first index; the last row of a
    curve is never looked at. ``below`` keeps extrema where a column is under a bound."""
    d = indexed(df, keys)
    d = d.filter(F.col("idx") < F.col("n_rows") - 1).withColumn("block", F.floor(F.col("idx") / n))
    v = F.col(value) if sign == "+" else -F.col(value)
    row = F.struct("idx", "t", F.col(value).alias("value"), *([F.col(below[0]).alias("_b")] if below else []))
    g = d.groupBy(*keys, "block").agg(F.min_by(row, F.struct(-v, F.col("idx"))).alias("r"))
    if below:
        g = g.filter(F.col("r._b") < below[1])
    return g.select(*keys, "block", "r.idx", "r.t", "r.value")


def merge_close(ext: DataFrame, sign: str, keys: list[str], seconds: float = 2.0, chunk_s: float = CHUNK_S) -> DataFrame:
    """Right to left, of two candidates closer than ``seconds`` the more extreme stays.

    Where neighbours lie ``seconds`` or more apart nothing on one side can meet the other, so a curve is cut there
    into runs that are merged independently, each over one candidate per block of rows. A task merges many
    runs one after another.
    """
    types = {f.name: f.dataType.simpleString() for f in ext.schema.fields}
    cols = [*keys, "block", "idx", "t", "value"]

    n = len(keys) + 1

    def merge(batches):
        """Rows come run by run, each from right to left; only the candidate that still stands is held."""
        def number(v):
            return float("nan") if v is None else v

        cur = None
        for b in batches:
            keep = []
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if cur is not None and cur[:n] == row[:n] and abs(number(cur[n]) - number(row[n])) < seconds:
                    y, z = number(cur[n + 1]), number(row[n + 1])
                    if (y > z) if sign == "-" else (y < z):
                        cur = row
                else:
                    keep += [cur] if cur is not None else []
                    cur = row
            yield pa.RecordBatch.from_pylist([dict(zip(b.schema.names, r)) for r in keep], schema=b.schema)
            last = b.schema
        if cur is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(last.names, cur))], schema=last)

    d = with_neighbors(chunk_by(ext.select(*cols), "t", chunk_s), keys, ["idx"], prev={"_pt": "t"})
    d = with_running(d, keys, ["idx"], {"_run": F.coalesce((F.col("t") - F.col("_pt") >= seconds).cast("long"), F.lit(0).cast("long"))})
    d = d.select(*keys, "_run", "t", "value", "block", "idx").repartition(*keys, "_run").sortWithinPartitions(*keys, "_run", F.desc("idx"))
    return d.mapInArrow(merge, ", ".join(f"{c} {(types | {'_run': 'bigint'})[c]}" for c in d.columns)).select(*cols)


def first_valley(ext: DataFrame, curves: DataFrame, value: str, k: int, keys: list[str]) -> DataFrame:
    """Where a curve has fewer than k minima, its first sample becomes one more candidate."""
    few = ext.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    first = curves.groupBy(*keys).agg(F.min_by(F.struct("t", F.col(value).alias("value")), "ev").alias("_f"))
    first = first.join(few, keys, "left").filter(F.coalesce("_n", F.lit(0)) < k)
    add = first.select(*keys, F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("idx"), "_f.t", "_f.value")
    return ext.select(*add.columns).unionByName(add)


def top_peaks(ext: DataFrame, k: int, sign: str, keys: list[str]) -> DataFrame:
    """The k most extreme candidates per curve, numbered in position order (for minima, add
    ``first_valley`` before)."""
    v = F.desc("value") if sign == "+" else F.asc("value")
    pos = F.desc("idx") if sign == "+" else F.asc("idx")
    a = ext.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(v, pos))).filter(F.col("_r") <= k)
    return a.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("idx"))).drop("_r")


def split_cycles(df: DataFrame, peaks: DataFrame, valleys: DataFrame, keys: list[str]) -> DataFrame:
    """Forward rows valley i -> peak i, reverse rows peak i -> valley i+1."""
    p = peaks.select(*keys, "n", F.col("idx").alias("p"))
    v = valleys.select(*keys, "n", F.col("idx").alias("v"))
    nxt = v.select(*keys, (F.col("n") - 1).alias("n"), F.col("v").alias("v_next"))
    c = p.join(v, [*keys, "n"]).join(nxt, [*keys, "n"], "left")
    spans = c.select(*keys, F.col("n").alias("cycle"), F.lit("F").alias("direction"), F.col("v").alias("lo"), F.col("p").alias("hi")).unionByName(
        c.filter("v_next IS NOT NULL").select(*keys, F.col("n").alias("cycle"), F.lit("R").alias("direction"), F.col("p").alias("lo"), F.col("v_next").alias("hi")))
    # spans of a curve lie one after another, so position blocks keep the join an equi-join
    size = 8192
    s = spans.filter("lo < hi").withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))))
    d = indexed(df, keys).withColumn("_b", F.floor(F.col("idx") / size))
    return d.join(s, [*keys, "_b"]).filter("idx >= lo AND idx < hi").drop("_b", "lo", "hi")
