"""Date functions. The present moment is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and abbreviations in order.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def month_number(name: Column) -> Column:
    """1 to 12 for an English month name or its first three letters (sept too), else null."""
    lower = F.lower(name)
    out = F.lit(None).cast("int")
    for i, month in enumerate(MONTHS):
        known = [month, month[:3], *(["sept"] if month == "september" else [])]
        out = F.when(lower.isin(*known), i + 1).otherwise(out)
    return out


def _whole(year: Column, month: Column, day: Column) -> Column:
    full = F.when(F.length(year) == 2, F.when(year.try_cast("int") < 70, year.try_cast("int") + 2000).otherwise(year.try_cast("int") + 1900)).otherwise(year.try_cast("int"))
    return F.concat_ws("-", F.lpad(full.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")).try_cast("date")


def publication_date(text: Column) -> Column:
    """A date in a text, as year-month-day, day month-name year or day/month/year; two-digit years turn at 70.

    The first layout that gives a real date wins; null if none does.
    """
    # The three layouts, in the order in which they are tried.
    ymd, dmy_name, dmy = (
        r"(?<!\d)(20\d{2}|19\d{2})[./-](\d{1,2})[./-](\d{1,2})(?!\d)",
        r"(?<!\d)(\d{1,2})[\s./-]([A-Za-z]{3,9})[\s,./-]+(20\d{2}|19\d{2}|\d{2})(?!\d)",
        r"(?<!\d)(\d{1,2})[./-](\d{1,2})[./-](20\d{2}|19\d{2}|\d{2})(?!\d)",
    )
    part = lambda p, i: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    named = month_number(part(dmy_name, 2))
    real = lambda y, m, d: F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), _whole(y, m, d))
    return F.coalesce(real(part(ymd, 1), part(ymd, 2), part(ymd, 3)), real(part(dmy_name, 3), named, part(dmy_name, 1)), real(part(dmy, 3), part(dmy, 2), part(dmy, 1)))


def feed_date(text: Column) -> Column:
    """A feed's date: mail layout (time zone heeded, in UTC), ISO, or any publication date."""
    mail = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(mail, r"\b(?:GMT|UTC|Z)$", "+0000")
    return F.coalesce(F.to_date(F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z"))), F.to_date(F.try_to_timestamp(F.trim(text))), publication_date(text))


def instant(text: Column) -> Column:
    """An ISO date or time as an instant; without an offset it is in UTC, the session's zone. Others are null."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "Z$", "+00:00"))


def relative_date(text: Column, now: Column) -> Column:
    """``today`` or a day and month without a year; more than 14 days ahead means last year's."""
    lower = F.lower(F.trim(text))
    day, month = F.regexp_extract(lower, r"^(\d{1,2})\s+([a-z]{3,9})", 1), month_number(F.regexp_extract(lower, r"^(\d{1,2})\s+([a-z]{3,9})", 2))
    this = F.when(month.isNotNull(), F.concat_ws("-", F.year(now), F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")).try_cast("date"))
    return F.when(lower.startswith("today"), F.to_date(now)).otherwise(F.when(F.datediff(this, now) > 14, F.add_months(this, -12)).otherwise(this))


def age_days(when: Column, now: Column) -> Column:
    """Whole days from ``when`` to ``now``, none below 0."""
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(now) - F.unix_timestamp(when)) / 86400).cast("int"))
