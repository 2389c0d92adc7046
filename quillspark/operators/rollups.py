"""Statistics kept up with batches: partial aggregates that changed items are added to and subtracted from.

A partial aggregate is a small table of counts and sums by key and time; adding the rows of a batch and taking away the
rows that they replace gives the aggregate of the whole, which is then never read again. Nothing in it depends on the
present moment, so days pass without a refresh: what is new, recent or recurring is read from the times of the cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexicon
from quillspark.functions.dates import age_days
from quillspark.operators.heatmap import _rank_when, grid_of

#: What cells of time are cut to: ages are exact at moments on this grain.
GRAIN = "hour"


def item_cells(items: DataFrame) -> DataFrame:
    """Items by country, category and hour first seen: n."""
    return items.groupBy("country", "category", F.date_trunc(GRAIN, "first_seen_at").alias("at")).agg(F.count("*").alias("n"))


def signal_cells(signals: DataFrame) -> DataFrame:
    """Signals (as ``heatmap.signals`` gives them) by country, domain, authority and time: n, and the sum of their scores without recency.

    The parts of a score stay below its bound of 100 together, so scores add up.
    """
    at = F.date_trunc(GRAIN, F.coalesce(F.col("date").cast("timestamp"), F.col("first_seen_at")))
    keys = ["country", "domain", "authority_label", at.alias("at"), F.col("date").isNotNull().alias("dated")]
    return signals.groupBy(*keys).agg(F.count("*").alias("n"), F.sum((F.col("score") - F.col("recency")).cast("long")).alias("base"))


def changed(cells: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """``cells`` with the cells of new rows added and those of replaced rows subtracted; empty cells go."""
    sums = [c for c in ("n", "base") if c in cells.columns]
    minus = removed.withColumns({c: -F.col(c) for c in sums})
    keys = [c for c in cells.columns if c not in sums]
    every = cells.unionByName(added).unionByName(minus)
    return every.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).filter("n <> 0")


def grouped_counts(cells: DataFrame) -> DataFrame:
    """Totals, by country and by category, from cells: kind, name, n."""
    sets = cells.groupingSets([[], ["country"], ["category"]], "country", "category").agg(F.grouping_id().alias("g"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return sets.select(F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "country").otherwise("category").alias("kind"), F.coalesce("country", "category").alias("name"), "n")


def new_since(cells: DataFrame, since: Column) -> DataFrame:
    """One row: items first seen since a moment on the grain."""
    return cells.agg(F.coalesce(F.sum(F.when(F.col("at") >= since, F.col("n"))), F.lit(0)).alias("n_new"))


def grid(cells: DataFrame, now: Column, domains=lexicon.RISK_DOMAINS, jurisdictions=lexicon.JURISDICTIONS) -> DataFrame:
    """The risk grid from signal cells, as ``heatmap.grid`` gives it from the signals."""
    at, n = F.when(F.col("dated"), F.col("at")), F.col("n")
    age = age_days(F.col("at"), now)
    recency = _rank_when([(age.isNull(), 4), (age <= 7, 10), (age <= 30, 6), (age <= 90, 3)], 1)
    days = lambda k: now - F.expr(f"INTERVAL {k} DAYS")
    held = lambda condition: F.coalesce(F.sum(F.when(condition, n)), F.lit(0))
    weight = F.create_map(*[x for k, v in lexicon.AUTHORITY_WEIGHTS.items() for x in (F.lit(k), F.lit(v).cast("decimal(10,2)"))])[F.col("authority_label")]
    sums = cells.groupBy("country", "domain").agg(
        F.sum("n").alias("n"),
        held((at >= days(7)) & (at <= now)).alias("last7"),
        held((at >= days(14)) & (at < days(7))).alias("previous7"),
        held((at >= days(37)) & (at < days(7))).alias("previous30"),
        F.bround(F.sum(weight * n.cast("decimal(18,0)")), 1).cast("decimal(20,1)").alias("weighted"),
        F.bround(F.sum(F.col("base") + recency * n).cast("decimal(20,0)") / F.sum("n"), 0).cast("long").alias("mean"),
        *[held(F.col("authority_label") == k).alias(f"a_{k}") for k in lexicon.AUTHORITY_WEIGHTS],
    )
    return grid_of(sums, domains, jurisdictions)
