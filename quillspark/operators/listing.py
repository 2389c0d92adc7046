"""Filtered listings: visibility rules, search, recency flag, null-last order, clamped pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import lexicon
from quillspark.operators.search_index import search

# What hides an item.
GAZETTE_SOURCE = "Gazette of India"
GAZETTE_TITLES = ("Recent Extra Ordinary Gazettes%", "Recent Weekly Gazettes%", "This Gazette may contains Multiple%")
GAZETTE_SUMMARIES = ("%Gazettes on Demand Bills & Acts Election%", "%Directorate of Printing Department of Publication%", "%State Gazettes Important Links%")
POLITICAL = {"source": "Free Malaysia Today - Nation", "category": "Legislation News", "actors": ("%DAP%", "%PH meeting%"), "places": ("%legislative assembly%", "%state assembly%")}
EDITORIAL = {"tab": "News Sources", "titles": ("%: Opinion", "%: Forum"), "summaries": ("%says the writer%",)}


def ilike_any(column: str, patterns) -> Column:
    return reduce(lambda a, b: a | b, [F.col(column).ilike(p) for p in patterns])


def retired_rule(names=lexicon.RETIRED_SOURCES) -> Column:
    return ~F.col("source").isin(*names)


def gazette_rule(source=GAZETTE_SOURCE, titles=GAZETTE_TITLES, summaries=GAZETTE_SUMMARIES) -> Column:
    return ~((F.col("source") == source) & ((F.col("title") == "Department of Publication") | ilike_any("title", titles) | ilike_any("summary", summaries)))


def political_rule(rule=POLITICAL) -> Column:
    either = lambda patterns: ilike_any("title", patterns) | ilike_any("summary", patterns)
    return ~((F.col("source") == rule["source"]) & (F.col("category") == rule["category"]) & either(rule["actors"]) & either(rule["places"]))


def editorial_rule(rule=EDITORIAL) -> Column:
    """A null tab leaves a matching title unknown, and so hidden: three-valued logic is kept on purpose."""
    return ~((ilike_any("title", rule["titles"]) | ilike_any("summary", rule["summaries"])) & (F.col("source_tab") == rule["tab"]))


def visible(items: DataFrame, **rules: Column) -> DataFrame:
    """Items that no rule hides. Rules are retired, gazette, political and editorial; each can be replaced."""
    own = {"retired": retired_rule(), "gazette": gazette_rule(), "political": political_rule(), "editorial": editorial_rule()} | rules
    return items.filter(reduce(lambda a, b: a & b, own.values()))


def clamp_page(limit: int, offset: int, most: int) -> tuple[int, int]:
    return max(1, min(limit, most)), max(0, offset)


def list_items(items: DataFrame, now: Column, *, country: str | None = None, category: str | None = None, q: str | None = None, limit: int = 50, offset: int = 0, most: int = 200, index: str | None = None) -> DataFrame:
    """A page of visible items, newest first, undated last; ``is_new`` marks those first seen within 24 hours.

    A query matches title, summary or source anywhere, without case; % and _ in it are wildcards. With ``index``, the
    folder of a trigram index of these columns, only the rows that its postings name are searched.
    """
    out = items
    for column, value in (("country", country), ("category", category)):
        if value and value != "All":
            out = out.filter(F.col(column) == value)
    if q and index:
        out = search(out, index, q.strip())
    elif q:
        out = out.filter(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{q.strip()}%") for c in ("title", "summary", "source")]))
    limit, offset = clamp_page(limit, offset, most)
    flagged = out.withColumn("is_new", F.col("first_seen_at") >= now - F.expr("INTERVAL 24 HOURS"))
    return flagged.orderBy(F.col("date").desc_nulls_last(), F.col("first_seen_at").desc(), "id").offset(offset).limit(limit)


def list_tagged(items: DataFrame, *, region: str | None = None, category: str | None = None, tag: str | None = None, q: str | None = None, limit: int = 50) -> DataFrame:
    """A page of tagged items by region, category, exact tag and search over five columns."""
    out = items
    for column, value in (("region", region), ("category", category)):
        if value and value != "All":
            out = out.filter(F.col(column) == value)
    if tag and tag != "All":
        out = out.filter(F.array_contains("tags", tag))
    if q:
        out = out.filter(F.concat_ws(" ", "title", "summary", "source", "category", F.array_join("tags", " ")).ilike(f"%{q.strip()}%"))
    return out.orderBy(F.col("date").desc_nulls_last(), F.col("first_seen_at").desc(), "id").limit(clamp_page(limit, 0, 200)[0])


def many_pages(items: DataFrame, now: Column, pages: list[dict], key: str = "id") -> DataFrame:
    """Several listings as one: each row once, by its key."""
    rows = reduce(lambda a, b: a.unionByName(b), [list_items(items, now, **page) for page in pages])
    return rows.dropDuplicates([key])


def public_view(rows: DataFrame, public: bool) -> DataFrame:
    """Raw rows, but none of them where the site is public."""
    return rows.limit(0) if public else rows


def search_issues(issues: DataFrame, q: str) -> DataFrame:
    """Issues with the words of ``q`` in title, summary or text body, letter case aside; all of them for a blank one."""
    wanted = q.strip().lower()
    columns = [c for c in ("title", "summary", "text_body") if c in issues.columns]
    return issues.filter(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(wanted))) if wanted else issues


def published(issues: DataFrame, limit: int = 50) -> DataFrame:
    """Published issues, newest first."""
    return issues.filter((F.col("status") == "published") & F.col("published_at").isNotNull()).orderBy(F.col("published_at").desc(), F.col("updated_at").desc(), "id").limit(clamp_page(limit, 0, 100)[0])


def pages_by(items: DataFrame, column: str, values: tuple[str, ...], *, limit: int = 200) -> DataFrame:
    """The first page of each value's own listing, one after the other in the order of ``values``: item columns and ``place`` from 0.

    One ranking that drops all but ``limit`` rows a value before it shuffles, not a scan for each. A value given twice counts once.
    """
    values = tuple(dict.fromkeys(values))
    newest = [F.col("date").desc_nulls_last(), F.col("first_seen_at").desc(), "id"]
    own = items.filter(F.col(column).isin(*values)).withColumn("__at", F.row_number().over(Window.partitionBy(column).orderBy(*newest))).filter(F.col("__at") <= limit)
    turn = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))
    return own.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(turn, "__at")) - 1).drop("__at")


def merged_pages(pages: DataFrame, key: str = "id") -> DataFrame:
    """Pages of several listings as one: each row once, the later of equal ones, by the day or else the time first seen, newest first."""
    last = pages.groupBy(key).agg(F.max("place").alias("place"))
    when = F.coalesce(F.col("date").cast("timestamp"), F.col("first_seen_at"))
    return pages.join(last, [key, "place"], "left_semi").orderBy(when.desc_nulls_last(), F.col("first_seen_at").desc_nulls_last(), key)
