"""One-pass statistics and run health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped_counts(items: DataFrame) -> DataFrame:
    """Totals, by country and by category in one pass: kind, name, n."""
    sets = items.groupingSets([[], ["country"], ["category"]], "country", "category").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    return sets.select(F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "country").otherwise("category").alias("kind"), F.coalesce("country", "category").alias("name"), "n")


def overview(items: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """One row: total, new within 24 hours, last scan, counts by country and category as maps."""
    as_map = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.struct("name", "n")))))
    counts = grouped_counts(items).agg(F.max(F.when(F.col("kind") == "total", F.col("n"))).alias("total"), as_map("country").alias("by_country"), as_map("category").alias("by_category"))
    fresh = items.agg(F.count_if(F.col("first_seen_at") >= now - F.expr("INTERVAL 24 HOURS")).alias("new_24h"))
    return counts.crossJoin(fresh).crossJoin(runs.agg(F.max("fetched_at").alias("last_scan")))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest run of each source: a semi-join on the largest id."""
    return runs.join(runs.groupBy("source_id").agg(F.max("id").alias("id")), ["source_id", "id"], "left_semi")


def run_health(runs: DataFrame, registry: DataFrame, items: DataFrame) -> DataFrame:
    """Latest runs of registered sources, with access basis; a failed run of a source that has items is stale.

    A stale run counts the items held before, and its message says so; a blank message becomes the error's class
    (column error_type, if there is one), else 'Error'.
    """
    held = items.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("held"))
    known = registry.select(F.col("id").alias("source_id"), "name", F.when(F.col("official"), "official").when(F.col("source_type") == "rss", "public feed").otherwise("public page").alias("access_basis"))
    joined = latest_runs(runs).join(known, "source_id").join(held, "name", "left")
    stale = (F.col("status") == "error") & (F.coalesce("held", F.lit(0)) > 0)
    message = F.coalesce(F.nullif(F.trim("error"), F.lit("")), *([F.col("error_type")] if "error_type" in runs.columns else []), F.lit("Error"))
    return joined.select(
        "source_id",
        "name",
        "access_basis",
        F.when(stale, "stale").otherwise(F.col("status")).alias("status"),
        F.when(stale, F.col("held")).otherwise(F.col("item_count")).alias("item_count"),
        F.when(stale, F.concat(F.lit("Showing stored items. Last error: "), F.substring(message, 1, 600))).when(F.col("status") == "error", F.substring(message, 1, 700)).alias("error"),
    )


def public_stats(issues: DataFrame) -> DataFrame:
    """What the public sees: how many published issues there are, and when the last one was."""
    shown = issues.filter((F.col("status") == "published") & F.col("published_at").isNotNull())
    return shown.agg(F.count("*").alias("published"), F.max("published_at").alias("last_published"))


def official_sources(items: DataFrame, registry: DataFrame) -> DataFrame:
    """One row: registered sources that gave items, official ones among them, and the items of either."""
    held = items.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))
    official = F.coalesce("official", F.lit(False))
    return registry.join(held, "name").agg(F.count("*").alias("sources"), F.count_if(official).alias("official"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.coalesce(F.sum(F.when(official, F.col("n"))), F.lit(0)).alias("official_items"))


def share_of_top(items: DataFrame, by: str) -> DataFrame:
    """Counts by a column with bar widths: percent of the largest, at least 8."""
    counts = items.groupBy(by).agg(F.count("*").alias("n"))
    return counts.withColumn("width", F.greatest(F.lit(8), F.floor(F.col("n") * 100 / F.max("n").over(Window.partitionBy(F.lit(1))) + 0.5).cast("int")))


def facet_values(items: DataFrame, column: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Distinct values of a column (arrays are exploded): listed ones in their order, then the rest by name."""
    values = items.select((F.explode(column) if items.schema[column].dataType.typeName() == "array" else F.col(column)).alias("value")).distinct()
    rank = F.array_position(F.array(*[F.lit(v) for v in order]), F.col("value")) if order else F.lit(0)
    return values.filter(F.col("value").isNotNull()).withColumn("rank", F.when(rank == 0, len(order) + 1).otherwise(rank).cast("int")).orderBy("rank", "value")
