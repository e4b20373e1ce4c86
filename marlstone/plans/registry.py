"""Registered queries over the driver's tables, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_SPARK = {"l": "bigint", "s": "string", "d": "double"}
_SQL = {"l": "BIGINT", "s": "VARCHAR", "d": "DOUBLE"}


class Tables:
    """Tables of one directory, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, columns: str, sql: str | None = None):
    """Register a function of Tables.  columns: "name:l name:d name:s" (long, double to six digits, string) on both sides."""
    spec = [c.split(":") for c in columns.split()]

    def spark_column(c: str, kind: str):
        value = F.col(c).cast(_SPARK[kind])
        return (F.round(value, 6) + F.lit(0.0) if kind == "d" else value).alias(c)

    def sql_column(c: str, kind: str) -> str:
        value = f"CAST({c} AS {_SQL[kind]})"
        return f"round({value}, 6) + 0.0 AS {c}" if kind == "d" else f"{value} AS {c}"

    def register(f):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder)).select(*[spark_column(c, k) for c, k in spec])
        if sql:
            ORACLE[name] = f"SELECT {', '.join(sql_column(c, k) for c, k in spec)} FROM ({sql}) AS result"
        return f

    return register


def h(seed: str, *keys: str) -> str:
    """SQL for functions.hashing.keyed_hash."""
    text = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"CAST('0x' || substr(md5('{seed}:' || {text}), 1, 15) AS BIGINT)"
