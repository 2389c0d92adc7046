"""Deep pages of a long listing: rows sorted once into ranges, whose counts say which of them a page lies in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a range, and rows that a task sorts and cuts into ranges, about.
RANGE_ROWS, TASK_ROWS = 100_000, 10_000


def newest_first() -> list[Column]:
    return [F.col("date").desc_nulls_last(), F.col("first_seen_at").desc(), F.col("id").asc()]


def write_ranges(items: DataFrame, root: str, *, order: list[Column] | None = None, range_rows: int = RANGE_ROWS) -> None:
    """``items`` at ``root``/rows in folders by range, sorted inside, and at ``root``/ranges how many rows lie before each.

    A sample cuts the rows into stretches, a task each; tasks cut theirs into ranges of ``range_rows`` rows, the last
    one smaller. So tasks, and the keys sampled for them, are as many as the rows ask for, however small a range is.
    """
    order = order or newest_first()
    held = items.count()
    tasks = max(1, -(-held // max(range_rows, TASK_ROWS)))
    spark = items.sparkSession
    place = items.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    # The upper bits of a place number the task, the lower 33 its rows. Folders by task keep the listing of many ranges to few calls.
    task = F.shiftright("__at", 33)
    number = task * (held // range_rows + 1) + F.floor(F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) / range_rows)
    ranged = place.withColumns({"task": task, "range": number.cast("long")}).drop("__at").sortWithinPartitions("task", "range", *order)
    ranged.write.partitionBy("task", "range").parquet(f"{root}/rows")
    ranged.limit(0).write.parquet(f"{root}/schema")
    counts = spark.read.schema(_shape(spark, root)).parquet(f"{root}/rows").groupBy("task", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("range")) - F.col("n")  # a row a range
    counts.withColumn("before", before).write.parquet(f"{root}/ranges")


def _shape(spark: SparkSession, root: str) -> T.StructType:
    return spark.read.parquet(f"{root}/schema").schema


def page(spark: SparkSession, root: str, *, limit: int, offset: int, order: list[Column] | None = None) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the listing, in order. Only the ranges that they lie in are read."""
    order = order or newest_first()
    met = spark.read.parquet(f"{root}/ranges").filter((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).orderBy("range").collect()
    if not met:
        return spark.createDataFrame([], _shape(spark, root)).drop("task", "range")
    folders = [f"{root}/rows/task={r['task']}/range={r['range']}" for r in met]
    rows = spark.read.schema(_shape(spark, root)).option("basePath", f"{root}/rows").parquet(*folders).filter(F.col("range").isin([r["range"] for r in met])).drop("task", "range")
    return rows.orderBy(*order).offset(offset - met[0]["before"]).limit(limit)
