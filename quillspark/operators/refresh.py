"""Ingestion as one job: scanned entries to gated, merged items, a run for each source, and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.classify import with_registry
from quillspark.operators.dedup import cap_per, keep_last
from quillspark.operators.gates import gate_items
from quillspark.operators.merge import merge_items
from quillspark.session import written

IDLE_METHODS = ("manual", "pending", "api")


def accepted_items(entries: DataFrame, registry: DataFrame, *, most: int | None = None, **gates) -> DataFrame:
    """Items of scanned entries (source, title, summary, date, link, seq) that pass the gates, in the stored shape.

    ``most`` keeps the first so many accepted ones of each source, in the order of ``seq``: what gates turn away does not count.
    """
    gated = gate_items(with_registry(entries.withColumns({c: F.lit(None).cast("string") for c in ("country", "category", "source_tab") if c not in entries.columns}), registry), **gates)
    kept = gated.filter(F.col("reject_reason").isNull())
    if most:
        kept = cap_per(kept, "source", most, "seq")
    return kept.select(
        "fingerprint", F.col("item_country").alias("country"), "source", F.coalesce("r_source_tab", "source_tab").alias("source_tab"), F.col("clean_title").alias("title"), F.col("clean_summary").alias("summary"), "date",
        F.col("clean_link").alias("link"), F.col("item_category").alias("category"), "seq",
    )


def scan_runs(registry: DataFrame, scans: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """One run for each source: idle for methods that fetch nothing, error with its message, else ok with its items.

    ``scans`` has a source's name and error (null: none). Items are counted as the source gave them, repeats included.
    """
    held = items.groupBy("source").agg(F.count("*").alias("n"))
    failed = scans.filter(F.col("error").isNotNull()).groupBy("source").agg(F.first("error").alias("error"))
    method = F.col("ingestion_method") if "ingestion_method" in registry.columns else F.col("source_type")
    rows = registry.select(F.col("id").alias("source_id"), F.col("name").alias("source"), method.alias("method")).join(held, "source", "left").join(failed, "source", "left")
    status = F.when(F.col("method").isin(*IDLE_METHODS), "idle").when(F.col("error").isNotNull(), "error").otherwise("ok")
    shown = F.when(status == "ok", F.coalesce("n", F.lit(0))).otherwise(0).cast("long")
    return rows.select("source_id", "source", status.alias("status"), shown.alias("item_count"), F.when(status == "error", F.substring("error", 1, 700)).alias("error"), now.alias("fetched_at"))


def of_fetched(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """Entries of sources that are fetched: those of idle ones, should there be any, are left out."""
    method = F.col("ingestion_method") if "ingestion_method" in registry.columns else F.col("source_type")
    return entries.join(registry.filter(method.isin(*IDLE_METHODS)).select(F.col("name").alias("source")), "source", "left_anti")


def refresh(entries: DataFrame, scans: DataFrame, registry: DataFrame, stored: DataFrame, now: Column, **gates) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The merged store, the runs, and one row of counters (sources, seen, inserted, updated, failed).

    Entries of sources whose scan failed, or that are not fetched, are left out. Of items with one fingerprint the last by ``seq`` is merged.
    """
    failed = scans.filter(F.col("error").isNotNull()).select("source").distinct()
    # Runs, counters and the merge all read what was accepted: the gates are passed once.
    seen = written(accepted_items(of_fetched(entries, registry).join(failed, "source", "left_anti"), registry, **gates))
    merged = merge_items(stored, keep_last(seen, "fingerprint", "seq"), now)
    runs = scan_runs(registry, scans, seen, now)
    changed = merged.agg(F.count_if(F.col("action") == "inserted").alias("inserted"), F.count_if(F.col("action") == "updated").alias("updated"))
    counted = runs.agg(F.count("*").alias("sources"), F.coalesce(F.sum("item_count"), F.lit(0)).alias("seen"), F.count_if(F.col("status") == "error").alias("failed"))
    return merged, runs, counted.crossJoin(changed)
