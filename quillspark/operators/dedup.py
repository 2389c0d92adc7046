"""Deduplication of batches by key, in window form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(items: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The last row of each key by ``order``."""
    back = [(F.col(o) if isinstance(o, str) else o).desc() for o in order]
    return items.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*back))).filter("__n = 1").drop("__n")


def keep_first(items: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first row of each key by ``order``."""
    return items.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def cap_per(items: DataFrame, group: str, most: int, *order: str | Column) -> DataFrame:
    """At most ``most`` rows of each group by ``order``; filter before to cap what was accepted, after to cap what was read."""
    return items.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__n") <= most).drop("__n")
