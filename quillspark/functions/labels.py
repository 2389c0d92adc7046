"""Labels and relative times as readers see them, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import wordings


def _looked_up(value: Column, table: dict[str, str], otherwise: Column) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[value], otherwise)


def title_case(value: Column) -> Column:
    """Underscores and slashes become spaces; every word's first letter is a capital, the others stay."""
    words = F.split(F.regexp_replace(value, "[_/]+", " "), " ")
    raised = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))
    return F.array_join(F.transform(words, lambda w: F.array_join(F.transform(F.split(w, "-"), raised), "-")), " ")


def topic_label(value: Column) -> Column:
    return _looked_up(value, wordings.TOPIC_LABELS, title_case(value))


def region_label(value: Column) -> Column:
    return _looked_up(value, wordings.REGION_LABELS, value)


def date_range_label(value: Column) -> Column:
    return _looked_up(value, wordings.DATE_RANGE_LABELS, value)


def source_type_label(value: Column) -> Column:
    """HTML and RSS in capitals; others in title case, parts by slashes kept apart."""
    parts = F.array_join(F.transform(F.split(value, "/"), title_case), " / ")
    return F.when(F.lower(value).isin("html", "rss"), F.upper(value)).otherwise(parts)


def day_label(at: Column) -> Column:
    """Day, short month and year; a null is pending."""
    return F.coalesce(F.date_format(at, "dd MMM yyyy"), F.lit("Date pending"))


def time_ago(at: Column, now: Column) -> Column:
    """Minutes under an hour, hours under 48, else the day; a null has not been scanned."""
    minutes = F.greatest(F.lit(1), F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / F.lit(60.0) + 0.5)).cast("long")
    hours = F.floor(minutes / F.lit(60.0) + 0.5).cast("long")
    ago = F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago"))).when(hours < 48, F.concat(hours.cast("string"), F.lit("h ago"))).otherwise(day_label(at))
    return F.when(at.isNull(), "No scan yet").otherwise(ago)


def counted(n: Column, word: str) -> Column:
    """'1 word' or 'n words'."""
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
