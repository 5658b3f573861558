"""Queries over the given tables and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import SETTINGS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The given tables by name, read when first used."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")


def query(key: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` under ``key`` with the SQL that gives the same rows."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, root: str) -> DataFrame:
            for name, value in SETTINGS.items():
                if spark.conf.get(name, None) != value:
                    spark.conf.set(name, value)
            return f(Tables(spark, root))

        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = run
        if sql is not None:
            SQL[key] = sql
        return f

    return register


def rounded(value: Column, places: int = 6) -> Column:
    return F.round(value, places)
