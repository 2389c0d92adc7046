"""Briefings: why an item matters to a department, intake cards, digests and their sentences, shapes of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import wordings
from quillspark.functions.labels import counted
from quillspark.functions.text import clean_text, cut_at_word, safe_href, sentence_trim, squeeze
from quillspark.functions.urls import public_url
from quillspark.operators.gates import useful_paragraph
from quillspark.operators.routing import source_registry_lookup


def implications(spark: SparkSession, matrix=wordings.IMPLICATIONS) -> DataFrame:
    """The matrix of departments and topics as a small dimension: department, topic, why."""
    return spark.createDataFrame([(d, t, why) for d, row in matrix.items() for t, why in row.items()], "department string, topic string, why string")


def advised_action(department: Column, urgency: Column, table=wordings.ACTIONS) -> Column:
    """A department's action for an urgency, else its default, else one for all."""
    flat = F.create_map(*[x for d, row in table.items() for u, text in row.items() for x in (F.lit(f"{d}|{u}"), F.lit(text))])
    return F.coalesce(flat[F.concat_ws("|", department, urgency)], flat[F.concat(department, F.lit("|"))], F.lit(wordings.ACTION_OTHERWISE))


def explained_routes(scores: DataFrame, matrix: DataFrame) -> DataFrame:
    """Route scores with why the item matters to the department, and what it should do."""
    joined = scores.join(F.broadcast(matrix), ["department", "topic"], "left")
    return joined.withColumns({"why": F.coalesce("why", F.lit(wordings.IMPLICATION_OTHERWISE)), "action": advised_action(F.col("department"), F.col("urgency"))})


def intake_cards(scores: DataFrame, least: int = 52) -> DataFrame:
    """One row for each item: its departments of ``least`` points or more, best first, as text, and its top route."""
    entry = F.struct((-F.col("route_score")).alias("o"), "d_ord", "short_name", "route_score")
    cards = scores.groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("r"))
    shown = F.transform(F.filter("r", lambda r: r["route_score"] >= least), lambda r: r["short_name"])
    return cards.select("id", F.when(F.size(shown) > 0, F.array_join(shown, ", ")).otherwise("No route").alias("departments"), F.col("r")[0]["short_name"].alias("top_route"), F.col("r")[0]["route_score"].alias("top_score"))


def department_digest(scores: DataFrame, department: str, name: str, cadence: str, most: int = 6) -> DataFrame:
    """One row: the best routed items of a department (52 points or more) as ids, with subject and summary."""
    order = [F.col("route_score").desc(), F.col("impact").desc(), "id"]
    best = scores.filter((F.col("department") == department) & (F.col("route_score") >= 52)).orderBy(*order).limit(most or 6)
    rows = best.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("pos", "id", "topic"))).alias("r"))
    topics = F.array_join(F.slice(F.array_distinct(F.transform("r", lambda x: x["topic"])), 1, 3), ", ")
    some = F.concat(F.size("r").cast("string"), F.lit(f" priority signals for {name}, led by "), topics, F.lit(". Highest urgency items should be reviewed before external or leadership distribution."))
    return one.select(
        F.lit(f"{cadence} Legal Intelligence Briefing - {name}").alias("subject"),
        F.array_join(F.transform("r", lambda x: x["id"].cast("string")), ",").alias("ids"),
        F.when(F.size("r") > 0, some).otherwise(f"No priority signals currently meet the routing threshold for {name}.").alias("summary"),
    )


def digest_sentence(entries: Column, urgent: Column, topics: Column, name: str, kind: str) -> Column:
    """The summary of a selected digest: how many signals, led by which topics, how many of high priority."""
    led = F.when(F.coalesce(topics, F.lit("")) == "", "core APAC intelligence").otherwise(topics)
    should = F.concat(counted(urgent, "high-priority item"), F.lit(" should be reviewed before wider distribution."))
    some = F.concat(entries.cast("string"), F.lit(f" selected {kind.lower()} signal"), F.when(entries == 1, "").otherwise("s"), F.lit(f" for {name}, led by "), led, F.lit(". "), should)
    return F.when(entries > 0, some).otherwise(f"No selected intelligence signals are currently available for {name}.")


def executive_summary(title: Column, summary: Column, source: Column, topic: Column, country: Column) -> Column:
    """The item's own summary, or a sentence made for it, cut at a word after 182 characters."""
    own = squeeze(F.coalesce(F.nullif(summary, F.lit("")), title, F.lit("")))
    made = F.concat(F.coalesce(source, F.lit("A monitored source")), F.lit(" reported a "), F.lower(F.coalesce(topic, F.lit("legal intelligence"))), F.lit(" development in "), F.coalesce(country, F.lit("")), F.lit("."))
    return cut_at_word(F.when((own != "") & (own != F.coalesce(title, F.lit(""))), own).otherwise(made), 185, 182)


def trend_line(n: Column, delta: Column) -> Column:
    """Signals of a cell and their change against the seven days before."""
    n, delta = F.coalesce(n, F.lit(0)), F.coalesce(delta, F.lit(0))
    arrow = F.when(delta > 0, "↑").when(delta < 0, "↓").otherwise("→")
    return F.concat(counted(n, "signal"), F.lit(" · "), arrow, F.lit(" "), F.when(delta >= 0, "+").otherwise(""), delta.cast("string"), F.lit(" vs prior 7d"))


def authority_mix_text(mix: Column) -> Column:
    """Counts by authority as 'label: n / label: n'."""
    parts = F.transform(F.map_entries(mix), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string")))
    return F.when(F.coalesce(F.size(mix), F.lit(0)) > 0, F.array_join(parts, " / ")).otherwise("No authority mix yet")


def dashboard_counts(scored: DataFrame, signals: DataFrame, now: Column) -> DataFrame:
    """One row: items, signals, suppressed ones, and routes of the signals dated in the last seven days.

    ``scored`` is only counted, so the items themselves, before they are scored, will do.
    """
    recent = F.coalesce(F.col("date").cast("timestamp") >= now - F.expr("INTERVAL 7 DAYS"), F.lit(False))
    shown = signals.agg(F.count("*").alias("signals"), F.coalesce(F.sum(F.when(recent, F.col("n_routes")).otherwise(0)), F.lit(0)).alias("routed_this_week"))
    both = scored.agg(F.count("*").alias("items")).crossJoin(shown)
    return both.withColumn("suppressed", F.greatest(F.lit(0).cast("long"), F.col("items") - F.col("signals")))


def digest_choice(candidates: DataFrame, *, approved: bool = False, countries: tuple[str, ...] = (), topic: str | None = None) -> DataFrame:
    """Digest candidates that are approved (if asked), of the countries and of the topic; none or 'All' lets all pass."""
    out = candidates.filter(F.col("status") == "Approved") if approved else candidates
    out = out.filter(F.col("country").isin(*countries)) if countries and "All" not in countries else out
    return out.filter(F.col("topic") == topic) if topic not in (None, "All") else out


def selected_or_balanced(candidates: DataFrame, ids: DataFrame, balanced: DataFrame, most: int) -> DataFrame:
    """Entries selected by (pos, id), the first ``most``; where none of them is a candidate, the balanced ones."""
    chosen = candidates.join(ids, "id").select("id", "pos").orderBy("pos").limit(most)
    none = chosen.agg((F.count("*") == 0).alias("none"))
    fallback = balanced.crossJoin(F.broadcast(none)).filter("none").select("id", F.col("turn").alias("pos"))
    return chosen.select("id", F.col("pos").cast("int")).unionByName(fallback.select("id", F.col("pos").cast("int")))


def issue_as_item(issues: DataFrame) -> DataFrame:
    """Published issues in the shape of items."""
    text = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("")) if c in issues.columns else F.lit("")
    return issues.select(
        F.concat(F.lit("newsletter-"), F.col("id").cast("string")).alias("id"), F.lit("APAC").alias("country"), F.lit("APAC Legal Updates").alias("source"), F.lit("Published Newsletter").alias("source_tab"), "title",
        F.when(text("summary") != "", text("summary")).otherwise(text("text_body")).alias("summary"), F.coalesce("published_at", "updated_at").alias("date"), F.lit("#").alias("link"), F.lit("Published Newsletter").alias("category"),
        F.coalesce("published_at", "created_at").alias("first_seen_at"), F.col("updated_at").alias("last_seen_at"), F.lit(False).alias("is_new"),
    )


def issue_as_digest(issues: DataFrame) -> DataFrame:
    """Issues in the shape of weekly digests without entries."""
    return issues.select(
        "id", F.concat(F.lit("newsletter-"), F.col("id").cast("string")).alias("digest_id"), "title", F.coalesce("status", F.lit("published")).alias("status"), "published_at", "created_at", "updated_at",
        F.lit(0).alias("item_count"), F.lit("APAC Legal Updates").alias("department"), F.lit("Weekly Digest").alias("digest_type"), F.array().cast("array<string>").alias("entries"),
    )


def decoded_entries(digests: DataFrame, shape: str, column: str = "entries_json") -> DataFrame:
    """Digests with their entries as rows of ``shape`` (array<struct<...>>); malformed and null JSON give none."""
    parsed = F.from_json(F.coalesce(F.col(column), F.lit("[]")), shape)
    return digests.withColumn("entries", F.coalesce(parsed, F.array().cast(shape))).drop(column)


def rebuilt(current: DataFrame, bodies: DataFrame) -> DataFrame:
    """Digests with new bodies by id, all else kept; digests without a new body stay as they are."""
    fields = [c for c in bodies.columns if c != "id" and c in current.columns]
    joined = current.join(bodies.select("id", *[F.col(c).alias(f"__{c}") for c in fields]), "id", "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in fields}).select(current.columns)


def summary_payload(entries: DataFrame, registry: DataFrame, most: int = 12) -> DataFrame:
    """What a summariser is asked for: the first ``most`` entries by rank whose source has a safe link."""
    sourced = source_registry_lookup(entries, registry)
    safe = sourced.filter(safe_href(F.col("source_link")) != "#")
    return safe.orderBy("rank").limit(most).select(F.col("id").alias("item_id"), "title", "summary", F.col("source_link").alias("link"), F.col("source_name").alias("source"), F.col("country").alias("jurisdiction"), "category")


def summary_input(row: dict[str, Column], content: Column) -> Column:
    """The text that a summariser reads: the item's fields, one a line, then the content of its source."""
    lines = [F.concat(F.lit(f"{name}: "), clean_text(F.coalesce(F.nullif(row[key].cast("string"), F.lit("")), F.lit(missing)), most)) for name, key, missing, most in wordings.SUMMARY_FIELDS]
    return F.concat_ws("\n", *lines, F.concat(F.lit("URL: "), F.coalesce(row["link"], F.lit(""))), F.lit(""), F.lit("Source content:"), content)


def fallback_content(title: Column, summary: Column) -> Column:
    """The item's own text where its source gives none, if it is long enough and no boilerplate."""
    both = F.concat_ws(" ", F.nullif(clean_text(title, 260), F.lit("")), F.nullif(clean_text(summary, 1400), F.lit("")))
    return F.when(useful_paragraph(both), sentence_trim(both, 12_000)).otherwise("")


def provider_text(reply: Column) -> Column:
    """The text of a provider's JSON reply: its output_text, else all texts of its output's contents; others give ''."""
    shape = "output_text string, output array<struct<content:array<struct<text:string>>>>"
    parsed = F.from_json(reply, shape)
    contents = F.flatten(F.transform(F.filter(F.coalesce(parsed["output"], F.array().cast("array<struct<content:array<struct<text:string>>>>")), lambda o: o["content"].isNotNull()), lambda o: o["content"]))
    parts = F.filter(F.transform(contents, lambda c: c["text"]), lambda t: t.isNotNull())
    return clean_text(F.coalesce(parsed["output_text"], F.array_join(parts, " "), F.lit("")))


def summarisable(link: Column) -> Column:
    """Whether a link may be fetched for a summary."""
    return public_url(link)
