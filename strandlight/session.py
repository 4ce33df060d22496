"""Session defaults, shared scratch folders and size-checked broadcasts."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when a count proves it holds at most this many rows;
# every table that qualifies here has a handful of fixed-width columns (< 200 B/row).
BROADCAST_ROWS = 250_000


def local_session(cpus: int | str = "*", app: str = "strandlight") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once per application: functions are pickled by name, so a
    worker must be able to import them whatever its working folder is."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="strandlight-"), "strandlight.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("strandlight", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    It must be reachable from every executor. Only a single-process local session that names none
    (tests, benchmarks) gets a temporary folder of its own; any cluster must set it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), "strandlight", f"{label}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame, label: str = "cut", outer: bool = False) -> DataFrame:
    """Write to the shared folder and read back: survives executor loss, ends the lineage.

    The tables belong to the innermost open ``scratch`` block, which removes them; without one they stay
    until the owner of the folder clears it. With ``outer`` the table outlives the innermost block and belongs
    to the one around it.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    owners = _OWNERS[:-1] if outer else _OWNERS
    if owners:
        owners[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_OWNERS: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Owner of the tables that ``cut_lineage`` writes inside the block: they are removed at its end, so
    results that read them must be written or collected before."""
    _OWNERS.append([])
    try:
        yield
    finally:
        for path in _OWNERS.pop():
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when the table provably holds at most ``max_rows`` rows."""
    if df.isStreaming:
        return False
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only behind a row check; otherwise the join shuffles under AQE."""
    return F.broadcast(df) if is_small(df, max_rows) else df
