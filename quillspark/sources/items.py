"""Item-shaped views of the driver's tables, in Spark and in SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.lexicon import CATEGORIES, JURISDICTIONS

#: The present moment of all catalogue queries.
NOW = "2024-01-31 12:00:00"
TABS = ("News Sources", "Judiciary Updates", "Gazettes")


def now():
    return F.lit(NOW).cast("timestamp")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, their whole texts, as items: id, country, source, source_tab, title, summary, category, date, first_seen_at, link."""
    d, n = read(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        n.alias("id"),
        _pick(JURISDICTIONS, n % 6).alias("country"),
        "source",
        F.when(n % 4 < 3, _pick(TABS, n % 4 % 3)).alias("source_tab"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("summary"),
        _pick(CATEGORIES, F.floor(n / 6) % 6).alias("category"),
        F.when(n % 7 != 0, F.date_add(F.lit("2024-02-01").cast("date"), -(n % 61).cast("int"))).alias("date"),
        (F.lit("2024-01-31 00:00:00").cast("timestamp") - F.make_dt_interval(days=(n % 40).cast("int"), hours=(n % 24).cast("int"))).alias("first_seen_at"),
        F.concat(F.lit("https://News.Example/"), "source", F.lit("/"), (n % 500).cast("string"), F.lit("?utm_source=feed&a="), (n % 3).cast("string")).alias("link"),
    )


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


ITEMS_SQL = f"""items AS (
  SELECT doc_id AS id, {_sql_list(JURISDICTIONS)}[doc_id % 6 + 1] AS country, source,
    CASE WHEN doc_id % 4 < 3 THEN {_sql_list(TABS)}[doc_id % 4 % 3 + 1] END AS source_tab,
    string_split(text, chr(10))[1] AS title, text AS summary,
    {_sql_list(CATEGORIES)}[(doc_id // 6) % 6 + 1] AS category,
    CASE WHEN doc_id % 7 <> 0 THEN DATE '2024-02-01' - CAST(doc_id % 61 AS INTEGER) END AS date,
    TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(doc_id % 40 AS INTEGER)) - to_hours(doc_id % 24) AS first_seen_at,
    'https://News.Example/' || source || '/' || (doc_id % 500) || '?utm_source=feed&a=' || (doc_id % 3) AS link
  FROM documents)"""


def registry(spark: SparkSession) -> DataFrame:
    """Twenty sources: id, name, country, category, source_type, official, source_tab, force_category, include_all, require_date, terms."""
    return spark.createDataFrame(REGISTRY, "id string, name string, country string, category string, source_type string, official boolean, source_tab string, force_category boolean, include_all boolean, require_date boolean, required_terms array<string>, excluded_terms array<string>, country_detection boolean, url string")


REGISTRY = [
    (
        f"s{i}",
        f"src{i}",
        JURISDICTIONS[i % 6],
        CATEGORIES[i % 6],
        ("rss", "html")[i % 2],
        i % 5 == 0,
        TABS[0] if i % 3 == 0 else None,
        i % 7 == 3,
        i % 2 == 0,
        i % 4 == 1,
        ["the", "der"] if i % 6 == 2 else [],
        ["license"] if i % 5 == 4 else [],
        i % 9 == 8,
        f"https://src{i}.example/feed",
    )
    for i in range(20)
]


def _sql_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, list):
        return f"CAST({_sql_list(v)} AS VARCHAR[])"
    return "'" + v.replace("'", "''") + "'"


REGISTRY_SQL = (
    "registry(id, name, country, category, source_type, official, source_tab, force_category, include_all, require_date, required_terms, excluded_terms, country_detection, url) AS (VALUES\n  "
    + ",\n  ".join("(" + ", ".join(_sql_value(v) for v in row) + ")" for row in REGISTRY)
    + ")"
)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as source runs: id, source_id, status, fetched_at, item_count, error."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("s"), (F.col("user_id") % 25).cast("string")).alias("source_id"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.col("ts").alias("fetched_at"),
        F.floor(F.abs("value")).cast("long").alias("item_count"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
    )


RUNS_SQL = """runs AS (
  SELECT event_id AS id, 's' || (user_id % 25) AS source_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
    ts AS fetched_at, CAST(floor(abs(value)) AS BIGINT) AS item_count, CASE WHEN event_type = 'error' THEN props END AS error
  FROM events)"""
