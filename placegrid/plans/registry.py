"""Registered queries: a Spark callable and, where SQL can say it, the DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from placegrid.plans.views import view, with_views

Run = Callable[[SparkSession, str], DataFrame]


class Tables:
    """Views and base tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, f"v_{name}")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under its name; `covers` lists survey ids."""
    def add(fn: Callable[[Tables], DataFrame]):
        name = fn.__name__
        QUERIES[name] = Query(
            name, tuple(covers.split()), lambda spark, sf_dir: fn(Tables(spark, sf_dir)),
            None if sql is None else with_views(sql),
        )
        return fn

    return add
