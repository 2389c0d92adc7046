"""Merging batches into stored tables: one full outer join for each merge, no table format needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.classify import stored_category
from quillspark.operators.dedup import keep_last


def merge_items(stored: DataFrame, batch: DataFrame, now: Column, *, key: str = "fingerprint", overwrite: tuple[str, ...] = ("source_tab",), recategorise: bool = True) -> DataFrame:
    """``stored`` after the batch, with ``action`` (inserted, updated or kept).

    New keys are inserted with first_seen_at = last_seen_at = now. Known keys keep title, country, source and
    first_seen_at; the columns in ``overwrite`` are replaced, nulls included; summary and link are replaced unless the new
    one is empty; a new date wins unless null; last_seen_at becomes now. Of equal keys in a batch the last counts.
    """
    new = keep_last(batch, key, "seq").drop("seq")
    old, new = stored.alias("o"), new.alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    is_old, is_new = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    both = is_old & is_new

    def pick(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c == "first_seen_at":
            return F.when(is_old, o).otherwise(now)
        if c == "last_seen_at":
            return F.when(is_new, now).otherwise(o)
        if c in overwrite:
            return F.when(is_new, n).otherwise(o)
        if c in ("summary", "link"):
            return F.when(both, F.when(F.coalesce(n, F.lit("")) == "", o).otherwise(n)).when(is_new, n).otherwise(o)
        if c == "date":
            return F.coalesce(n, o)
        if c == "category":
            return F.when(is_new, n).otherwise(o)
        return F.when(is_old, o).otherwise(n)

    out = joined.select(*[pick(c).alias(c) for c in stored.columns], F.when(both, "updated").when(is_new, "inserted").otherwise("kept").alias("action"))
    if recategorise:
        out = out.withColumn("category", F.when(F.col("action") == "kept", F.col("category")).otherwise(stored_category(F.col("category"), F.col("title"), F.col("summary"))))
    return out


def merge_counts(merged: DataFrame) -> DataFrame:
    """inserted and updated rows of a merge."""
    return merged.agg(F.count_if(F.col("action") == "inserted").alias("inserted"), F.count_if(F.col("action") == "updated").alias("updated"))


def upsert_issues(stored: DataFrame, batch: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """Issues (newsletters, digests) by key: the batch's row replaces the stored one but for created_at.

    published_at defaults to now where the status is published; item_count, if there is one, to the number of entries.
    """
    new = batch
    if "entries" in batch.columns:
        new = new.withColumn("item_count", F.coalesce("item_count", F.size("entries")))
    new = new.withColumn("published_at", F.coalesce("published_at", F.when(F.col("status") == "published", now)))
    old, new = stored.alias("o"), new.alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    has_new = F.col(f"n.{key}").isNotNull()
    pick = {"created_at": F.coalesce(F.col("o.created_at"), now), "updated_at": F.when(has_new, now).otherwise(F.col("o.updated_at"))}
    return joined.select(*[pick.get(c, F.when(has_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).alias(c) for c in stored.columns])


def delete_by_key(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``stored`` without the keys; compare counts to learn whether any went."""
    return stored.join(keys.select(key), key, "left_anti")


def append_runs(log: DataFrame, runs: DataFrame) -> DataFrame:
    """The run log with new runs, errors cut at 700 characters."""
    return log.unionByName(runs.withColumn("error", F.substring("error", 1, 700)))


def migrate_items(old: DataFrame, registry: DataFrame) -> DataFrame:
    """Old rows in the present shape: category recomputed, a registered source's tab and forced category applied.

    Of rows with one fingerprint the smallest id stays.
    """
    known = registry.select(F.col("name").alias("source"), F.col("source_tab").alias("__tab"), F.when(F.col("force_category"), F.col("category")).alias("__forced"))
    joined = old.join(known, "source", "left")
    fixed = joined.withColumn("category", F.coalesce("__forced", stored_category(F.col("category"), F.col("title"), F.col("summary")))).withColumn("source_tab", F.coalesce("__tab", "source_tab"))
    first = fixed.groupBy("fingerprint").agg(F.min("id").alias("id"))
    return fixed.drop("__tab", "__forced").join(first, ["fingerprint", "id"], "left_semi").select(old.columns)


def bounded_history(history: DataFrame, new: DataFrame, most: int = 30) -> DataFrame:
    """Newest first, a new record replacing the one of its id, at most ``most`` records."""
    kept = history.join(new.select("id"), "id", "left_anti").unionByName(new)
    return kept.orderBy(F.col("created_at").desc(), "id").limit(most)
