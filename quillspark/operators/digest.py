"""Digests and feedback: rendering, selection by id, summaries beside entries, feedback counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import wordings
from quillspark.functions.text import cut_short, escape_html, safe_href, squeeze


def selected_entries(candidates: DataFrame, ids: DataFrame) -> DataFrame:
    """Candidates by an ordered selection (pos, id); missing ids drop out."""
    return candidates.join(ids, "id").orderBy("pos")


def with_summaries(entries: DataFrame, summaries: DataFrame) -> DataFrame:
    """Entries with their content summary where its status is ok."""
    own = summaries.select("id", F.when(F.col("status") == "ok", F.col("text")).alias("content_summary"))
    return entries.join(own, "id", "left")


def digest_counts(entries: DataFrame, order: str = "rank") -> DataFrame:
    """One row: entries, urgent ones, and the first three topics by first appearance."""
    topics = entries.groupBy("topic").agg(F.min(order).alias("p")).orderBy("p").limit(3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "topic"))), lambda x: x["topic"]), ", ").alias("topics"))
    n = entries.agg(F.count("*").alias("n"), F.count_if(F.col("urgency").isin("ACTION REQUIRED", "STRATEGIC")).alias("urgent"))
    return n.crossJoin(topics)


def render_digest(entries: DataFrame, title: Column, order: str = "rank") -> DataFrame:
    """One row: text and html bodies of an ordered, bounded list of entries."""
    number = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order))
    lines = entries.withColumn("k", number)
    plain = F.concat(F.col("k").cast("string"), F.lit(". "), F.col("title"), F.lit(" ["), F.coalesce("country", F.lit("-")), F.lit("]\n   "), F.coalesce("link", F.lit("")))
    html = F.concat(F.lit('<li><a href="'), escape_html(safe_href(F.col("link"))), F.lit('">'), escape_html(F.col("title")), F.lit("</a> "), escape_html(F.coalesce("country", F.lit(""))), F.lit("</li>"))
    joined = lines.agg(F.array_sort(F.collect_list(F.struct("k", plain.alias("p"), html.alias("h")))).alias("x"))
    head = F.concat(title, F.lit("\n\n"))
    return joined.select(
        F.concat(head, F.array_join(F.transform("x", lambda e: e["p"]), "\n")).alias("text_body"),
        F.concat(F.lit("<h1>"), escape_html(title), F.lit("</h1><ol>"), F.array_join(F.transform("x", lambda e: e["h"]), ""), F.lit("</ol>")).alias("html_body"),
    )


def mix_line(entries: DataFrame, by: str) -> DataFrame:
    """One row: counts by a column, most common first, as 'name (n), ...'."""
    counts = entries.groupBy(by).agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(by).alias("name"), "n")))
    return counts.agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["name"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ").alias("mix"))


def mail_encoded(text: Column) -> Column:
    """Percent encoding for mail links: letters, digits and - _ . ! ~ * ' ( ) stay, all else becomes UTF-8 escapes."""
    out = F.url_encode(text)
    for escape, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(escape), F.lit(char))
    return out


def mail_link(subject: Column, body: Column) -> Column:
    return F.concat(F.lit("mailto:?subject="), mail_encoded(F.coalesce(subject, F.lit(""))), F.lit("&body="), mail_encoded(F.coalesce(body, F.lit(""))))


def mail_draft(subject: Column, body: Column, most: int = 1800) -> Column:
    """struct<mode, url, clipboard>: a mail link; where it would pass ``most`` characters, one that asks to paste the clipboard."""
    full = mail_link(subject, body)
    fits = F.length(full) <= most
    return F.struct(F.when(fits, "mailto").otherwise("copy").alias("mode"), F.when(fits, full).otherwise(mail_link(subject, F.lit(wordings.PASTE_BODY))).alias("url"), F.when(fits, "").otherwise(F.coalesce(body, F.lit(""))).alias("clipboard"))


def mail_section(number: Column) -> Column:
    """One item of a mail: its number and title, where it is from, its summary cut short, its link. Empty parts drop out."""
    own = lambda c: F.nullif(squeeze(F.coalesce(c, F.lit(""))), F.lit(""))
    about = F.nullif(F.concat_ws(" / ", own("country"), own("category"), own("source")), F.lit(""))
    summary = F.nullif(cut_short(F.col("summary"), 320), F.lit(""))
    return F.concat_ws("\n", F.concat(number.cast("string"), F.lit(". "), own("title")), F.concat(F.lit("   "), about), F.concat(F.lit("   Summary: "), summary), F.concat(F.lit("   Link: "), own("link")))


def compose_mails(items: DataFrame, day: Column, *, by: tuple[str, ...] = ("country",), most: int = 200) -> DataFrame:
    """One mail for each group of items: ``by``, n, subject, body of the first ``most`` items by id, a page of the listing.

    Items without a title or a link are left out, as in listings of the day. The first of each group are found by a
    ranking that drops the rest before it shuffles, so a large group fills no task.
    """
    told = items.filter((F.length(squeeze(F.coalesce("title", F.lit("")))) > 0) & (F.length(squeeze(F.coalesce("link", F.lit("")))) > 0))
    first = told.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).filter(F.col("__k") <= most)
    lines = first.select(*by, "__k", mail_section(F.col("__k")).alias("__s"))
    made = lines.groupBy(*by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("__k", "__s"))).alias("__l"))
    intro = F.when(F.col("n") == 1, wordings.MAIL_ONE).otherwise(F.replace(F.lit(wordings.MAIL_MANY), F.lit("{n}"), F.col("n").cast("string")))
    body = F.concat(F.lit("Dear team,\n\n"), intro, F.lit("\n\n"), F.array_join(F.transform("__l", lambda x: x["__s"]), "\n"), F.lit("\n\nBest regards,"))
    return made.select(*by, "n", F.concat(F.lit(wordings.MAIL_SUBJECT), F.date_format(day, "dd MMM yyyy")).alias("subject"), body.alias("body"))


def of_today(items: DataFrame, today: Column) -> DataFrame:
    """Items with a title and a link, dated, first seen or last seen on the day."""
    days = [F.coalesce(F.to_date(c) == today, F.lit(False)) for c in ("date", "first_seen_at", "last_seen_at") if c in items.columns]
    return items.filter(reduce(lambda a, b: a | b, days) & (F.length(F.trim("title")) > 0) & (F.length(F.trim("link")) > 0))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """Counts of feedback by value, by department and by topic (topics exploded): kind, name, n."""
    sets = feedback.groupingSets([["value"], ["department"]], "value", "department").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    one = sets.select(F.when(F.col("g") == 1, "value").otherwise("department").alias("kind"), F.coalesce("value", "department").alias("name"), "n")
    topics = feedback.select(F.explode("topics").alias("name")).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name").limit(5)
    return one.unionByName(topics.select(F.lit("topic").alias("kind"), "name", "n"))


def ignored_topics(topics: DataFrame, feedback: DataFrame, most: int = 5) -> DataFrame:
    """Topics that no feedback names, the first by name."""
    seen = feedback.select(F.explode("topics").alias("topic")).distinct()
    return topics.join(seen, "topic", "left_anti").orderBy("topic").limit(most)


def kept_selection(selection: DataFrame, candidates: DataFrame) -> DataFrame:
    """Selected ids that still are candidates."""
    return selection.join(candidates.select("id").distinct(), "id", "left_semi")
