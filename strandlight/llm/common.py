"""Helpers shared by the corpus operators: session settings, tables, hot-safe components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlight.session import cut_lineage, ship_package

# Rows of an Arrow batch: texts can be long, and a batch is what a Python worker holds at once.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Ship the package and keep Arrow batches small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, m: int):
    """crc32 of the column as text, modulo m (null stays null)."""
    return F.crc32(F.col(col).cast("string")) % m


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition -> a spanning forest of them (at most one edge per node)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def flush() -> pa.RecordBatch:
        rows = [(x, find(x)) for x in list(parent) if find(x) != x]
        parent.clear()
        return pa.RecordBatch.from_pydict(
            {"u": pa.array([r[0] for r in rows], pa.int64()), "v": pa.array([r[1] for r in rows], pa.int64())}
        )

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ru, rv = find(u), find(v)
            if ru != rv:
                parent[max(ru, rv)] = min(ru, rv)
        if len(parent) > 2_000_000:
            yield flush()
    yield flush()


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Connected components of edges (u, v: long) as (node, component = smallest node).

    Each round every node joins its neighbour of the lowest random rank and the graph is
    contracted, so a round leaves a fraction of the nodes whatever the shape; within a partition
    edges first shrink to a forest. Rounds are tables in the shared folder; nothing goes to the
    driver but one count a round.
    """
    def thin(e: DataFrame) -> DataFrame:
        return e.mapInArrow(_forest, "u long, v long")

    e = cut_lineage(thin(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v")), f"{label}-e")
    steps: list[DataFrame] = []
    while not e.isEmpty():
        k = len(steps)

        def rank(c: str, k: int = k) -> F.Column:
            return F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("id"))

        both = e.union(e.select("v", "u")).toDF("node", "near")
        low = both.groupBy("node").agg(F.min(rank("near")).alias("b"))
        low = low.select("node", F.least(F.col("b"), rank("node"))["id"].alias("to"))
        low = cut_lineage(low, f"{label}-m")
        steps.append(low)
        a = e.join(low.toDF("u", "tu"), "u").join(low.toDF("v", "tv"), "v")
        e = cut_lineage(thin(a.select(F.col("tu").alias("u"), F.col("tv").alias("v")).filter("u <> v").distinct()), f"{label}-e")
    if not steps:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = steps[0]
    for low in steps[1:]:
        out = out.join(low.toDF("to", "next"), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    least = out.groupBy("to").agg(F.min("node").alias("component"))
    return out.join(least, "to").select("node", "component")
