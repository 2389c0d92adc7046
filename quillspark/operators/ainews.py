"""AI news: a source registry of its own, gated items, topics and their form as routing items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import wordings
from quillspark.functions.labels import region_label
from quillspark.functions.text import any_term, canonical_url, clean_text, normal_key
from quillspark.operators.frame import settled
from quillspark.operators.heatmap import _rank_when
from quillspark.operators.merge import merge_items
from quillspark.operators.refresh import scan_runs
from quillspark.session import written

#: Ways of ingestion that fetch something.
FETCHED = ("rss", "scraper")


def ai_fingerprint(source_id: Column, title: Column, link: Column, group: str = wordings.AI_GROUP) -> Column:
    """sha-256 of the group, the source and the normalised title, or the link where the title normalises to nothing."""
    key = normal_key(title)
    return F.sha2(F.concat_ws("|", F.lit(group), source_id, F.when(key != "", key).otherwise(F.coalesce(canonical_url(link), F.lit("")))).cast("binary"), 256)


def feed_urls(registry: DataFrame, feeds=wordings.AI_FEEDS) -> DataFrame:
    """Registry with the address to fetch: the feed's own where one is known, else the source's."""
    known = F.create_map(*[x for k, v in feeds.items() for x in (F.lit(k), F.lit(v))])
    return registry.withColumn("fetch_url", F.coalesce(known[F.col("id")], "url"))


def ai_items(entries: DataFrame, registry: DataFrame, *, terms=wordings.AI_TERMS, focused=wordings.AI_FOCUSED_SOURCES) -> DataFrame:
    """Gated items of entries (source_id, title, summary, date, link): short titles and other subjects go.

    Items of focused sources always pass; a missing link is the source's own address. Other columns of ``entries`` stay,
    unless the registry gives one of that name.
    """
    known = registry.select(F.col("id").alias("source_id"), F.col("name").alias("source"), "region", "source_type", "category", "tags", F.col("url").alias("__url"))
    own = [c for c in entries.columns if c == "source_id" or c not in known.columns]
    rows = entries.select(own).join(known, "source_id")
    rows = settled(rows, {"title": clean_text(F.col("title"), 260), "summary": clean_text(F.col("summary"), 520), "link": canonical_url(F.coalesce(F.nullif(F.col("link"), F.lit("")), "__url"))})
    relevant = (F.col("source_id").isin(*focused) if focused else F.lit(False)) | any_term(F.lower(clean_text(F.concat_ws(" ", "title", "summary"))), terms)
    kept = rows.filter((F.length("title") >= 8) & relevant).drop("__url")
    return kept.withColumn("fingerprint", ai_fingerprint(F.col("source_id"), F.col("title"), F.col("link")))


def refresh_ai(entries: DataFrame, scans: DataFrame, registry: DataFrame, stored: DataFrame, now: Column, *, terms=wordings.AI_TERMS, focused=wordings.AI_FOCUSED_SOURCES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """AI news ingested as one job: the merged store, a run for each source, and one row of counters.

    ``entries`` (source_id, title, summary, date, link, seq) come from feeds and pages alike; ``scans`` has a source_id
    and its error (null: none). Only sources that are fetched (rss, scraper) count as scanned; the others are idle. Of items
    with one fingerprint the last by ``seq`` is merged; a merge also replaces region, source type, category and tags.
    """
    fetched = registry.filter(F.col("ingestion_method").isin(*FETCHED))
    failed = scans.filter(F.col("error").isNotNull()).select("source_id").distinct()
    known = entries.join(failed, "source_id", "left_anti").join(fetched.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    seen = written(ai_items(known, registry, terms=terms, focused=focused))
    names = registry.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    runs = scan_runs(registry, scans.join(names, "source_id").select("source", "error"), seen, now)
    kept = [c for c in stored.columns if c not in ("first_seen_at", "last_seen_at")]
    merged = merge_items(stored, seen.select(*kept, "seq"), now, overwrite=("region", "source_type", "category", "tags"), recategorise=False)
    changed = merged.agg(F.count_if(F.col("action") == "inserted").alias("inserted"), F.count_if(F.col("action") == "updated").alias("updated"))
    counted = runs.agg(F.count_if(F.col("status") != "idle").alias("sources"), F.coalesce(F.sum("item_count"), F.lit(0)).alias("seen"), F.count_if(F.col("status") == "error").alias("failed"))
    return merged, runs, counted.crossJoin(changed)


def ai_topic(text: Column, patterns=wordings.AI_TOPIC_PATTERNS) -> Column:
    """The first topic whose pattern stands anywhere in a lower-case text."""
    return _rank_when([(text.rlike(p), topic) for p, topic in patterns], wordings.AI_TOPIC_OTHERWISE)


def ai_routing_items(items: DataFrame, registry: DataFrame, now: Column, patterns=wordings.AI_TOPIC_PATTERNS, generic=wordings.AI_GENERIC_TITLES) -> DataFrame:
    """AI items as routing items; index pages by title are left out. Source addresses go by id, else name, else link."""
    by_id = registry.select(F.col("id").alias("source_id"), F.col("url").alias("__u1"))
    by_name = registry.groupBy(F.col("name").alias("source")).agg(F.min_by("url", "id").alias("__u2"))
    rows = items.filter(~F.coalesce(F.trim("title").isin(*generic), F.lit(False))).join(by_id, "source_id", "left").join(by_name, "source", "left")
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    rows = settled(rows, {"topic": ai_topic(F.lower(F.concat_ws(" ", "title", "summary", "source_type", "category", F.array_join(tags, " "))), patterns)})
    vendor = (F.col("category") == "Vendor") | F.array_contains(tags, "competitor_intelligence")
    return rows.select(
        F.concat(F.lit("legal-ai-"), F.col("id").cast("string")).alias("id"), "title", "source", F.lit("Legal AI News").alias("source_tab"), F.coalesce(region_label(F.col("region")), F.lit("Global")).alias("country"),
        F.coalesce(F.col("date").cast("timestamp"), "first_seen_at").alias("date"), "topic", F.coalesce(F.nullif("summary", F.lit("")), "title").alias("summary"),
        F.when(F.col("category").isin(*wordings.AI_STRATEGIC_CATEGORIES), "STRATEGIC").otherwise("WATCH").alias("urgency"), F.when(vendor, 88).when(F.col("category") == "Official", 84).otherwise(76).alias("impact"),
        F.when(F.col("first_seen_at") >= now - F.expr("INTERVAL 24 HOURS"), "New").otherwise("Reviewed").alias("status"), F.concat(F.array(F.regexp_replace(F.lower("topic"), "[^a-z0-9]+", "_")), tags).alias("tags"),
        "link", F.coalesce("__u1", "__u2", "link").alias("source_url"), F.coalesce("category", "source_type").alias("category"),
    )


def recipient_group(department: Column, name: Column) -> Column:
    """struct<department, group_name, email, channel>: who a department's digest goes to where no group is registered for it."""
    team = F.coalesce(F.nullif(department, F.lit("")), F.lit("team"))
    return F.struct(name.alias("department"), F.concat(name, F.lit(" Intelligence")).alias("group_name"), F.concat(team, F.lit("-intelligence@example.invalid")).alias("email"), F.lit("Email").alias("channel"))


def recipients(teams: DataFrame, groups: DataFrame) -> DataFrame:
    """Departments (department, name) with their registered group (team, group_name, email, channel), else the default one."""
    own = groups.select(F.col("team").alias("department"), F.struct(F.col("name").alias("department"), "group_name", "email", "channel").alias("__own"))
    return teams.join(own, "department", "left").select("department", F.coalesce("__own", recipient_group(F.col("department"), F.col("name"))).alias("g")).select(F.col("department").alias("team"), "g.*")


def for_department(department: str, general: DataFrame, ai: DataFrame) -> DataFrame:
    """What a department reads: sales the AI items, where there are any; all others the general ones."""
    if department != "sales":
        return general
    return or_else(ai, general.select(ai.columns))


def or_else(rows: DataFrame, otherwise: DataFrame) -> DataFrame:
    """``rows``, or ``otherwise`` where there are none."""
    none = rows.limit(1).agg((F.count("*") == 0).alias("__none"))
    return rows.unionByName(otherwise.crossJoin(F.broadcast(none)).filter("__none").drop("__none"))
