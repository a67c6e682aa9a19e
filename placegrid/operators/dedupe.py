"""First-seen rows and anti joins against known ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placegrid.functions.values import blank, strip


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of every key.

    Spark limits each map task to one row per key before the shuffle, so copies
    of a hot key stay where they are read.
    """
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def with_id(df: DataFrame, column: str = "place_id") -> DataFrame:
    return df.filter(blank(column) != "")


def distinct_ids(df: DataFrame, column: str = "place_id") -> DataFrame:
    return with_id(df.select(strip(column).alias(column)), column).distinct()


def anti_known(df: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose id is neither blank nor known already."""
    return with_id(df).join(known.select("place_id"), "place_id", "left_anti")


def survivors(
    df: DataFrame, known: DataFrame, scraped: DataFrame, order: Sequence[str | Column]
) -> DataFrame:
    """First discovery of each id that is in neither history nor this run's output."""
    fresh = first_seen(with_id(df), ["place_id"], order)
    return anti_known(anti_known(fresh, known), scraped)
