"""The table of runnable queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles (six digits unless told otherwise) and widen integers, so results compare
    by value; adding zero removes a negative zero."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append((F.round(F.col(f"`{f.name}`").cast("double"), digits) + F.lit(0.0)).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            cols.append(F.col(f"`{f.name}`").cast("long").alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def rounded(text: str, dbl: str = "", ints: str = "", digits: int = 6) -> str:
    """Wrap an SQL text so the named columns are rounded doubles / 64-bit integers."""
    rep = [f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in dbl.split()]
    rep += [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
    return f"SELECT * REPLACE ({', '.join(rep)}) FROM ({text})" if rep else text


def query(
    name: str, oracle: str | None = None, dbl: str = "", ints: str = "", digits: int = 6
) -> Callable[[Query], Query]:
    """Register a query; doubles are rounded and integers widened on both sides."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir), digits)
        if oracle is not None:
            ORACLE[name] = rounded(oracle, dbl, ints, digits)
        return fn

    return wrap
