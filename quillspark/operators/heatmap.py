"""Risk grid: jurisdiction by domain, from authority, severity, recency, confidence and velocity of signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import lexicon
from quillspark.functions.dates import age_days
from quillspark.functions.matching import TERM, Lexicons
from quillspark.functions.text import any_substring, clean_text
from quillspark.operators.frame import settled

LEVELS = (("Critical", 86), ("Elevated", 71), ("Active", 51), ("Watch", 26))


def _rank_when(pairs, otherwise):
    """A chain of conditions, the first that holds wins."""
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for condition, value in reversed(pairs):
        out = F.when(condition, value).otherwise(out)
    return out


def authority(source: Column, official: Column, is_news: Column, source_type: Column) -> Column:
    """struct<points, label> of a source by its registry row and its name; ``is_news`` is null for unregistered sources."""
    name = F.lower(F.coalesce(source, F.lit("")))
    specialist, tier_one = any_substring(name, lexicon.SPECIALIST_NAMES), any_substring(name, lexicon.TIER_ONE_NAMES)
    grade = lambda points, label: F.struct(F.lit(points).alias("points"), F.lit(label).alias("label"))
    news = F.coalesce(is_news, F.lit(False))
    return _rank_when(
        [
            (F.coalesce(official, F.lit(False)), grade(25, "High")),
            (news & specialist, grade(19, "Medium-High")),
            (news & tier_one, grade(15, "Medium")),
            (news, grade(10, "Medium-Low")),
            (any_substring(name, lexicon.OFFICIAL_NAMES), grade(23, "High")),
            (specialist | F.contains(name, F.lit("legal")), grade(19, "Medium-High")),
            (tier_one, grade(15, "Medium")),
            (F.coalesce(source_type, F.lit("")).isin("rss", "html") | F.contains(name, F.lit("news")), grade(10, "Medium-Low")),
        ],
        grade(6, "Low"),
    )


def signals(items: DataFrame, registry: DataFrame, now: Column, domains=lexicon.RISK_DOMAINS, jurisdictions=lexicon.JURISDICTIONS) -> DataFrame:
    """One row for each item and matching domain: domain, terms, authority, authority_label, severity, recency, confidence, business, score."""
    known = registry.select(
        F.col("name").alias("source"),
        F.col("official").alias("__official"),
        ((F.col("category") == "Legal News") | (F.coalesce("source_tab", F.lit("")) == "News Sources")).alias("__news"),
        F.col("source_type").alias("__type"),
    )
    rows = items.filter(F.col("country").isin(*jurisdictions)).join(known, "source", "left")
    category, title, name = F.lower(F.coalesce("category", F.lit(""))), F.lower(clean_text(F.col("title"))), F.lower(F.coalesce("source", F.lit("")))
    text = F.lower(clean_text(F.concat_ws(" ", "title", "summary", "category", "source")))
    lexicons = Lexicons(TERM, **{d[0]: d[3] for d in domains})
    rows = settled(rows, {"__text": text, "__title": title, "__cat": category})
    rows = settled(rows, {"__words": lexicons.words(F.col("__text")), "__tw": lexicons.words(F.col("__title"))})

    def of_domain(key: str, label: str, weight: int, terms) -> Column:
        matched = lexicons.which(key, F.col("__words"), F.col("__text"))
        if key == "litigation_spikes":
            extra = F.array_compact(F.array(F.when(F.col("__cat").isin("recent judgments", "case summary"), F.col("__cat")), F.when(any_substring(name, ("court", "judiciary", "tribunal")), F.lit("court source"))))
            matched = F.array_distinct(F.concat(matched, extra))
        return F.struct(F.lit(key).alias("domain"), F.lit(weight).alias("business"), matched.alias("terms"), lexicons.any(key, F.col("__tw"), F.col("__title")).alias("in_title"))

    every = rows.withColumn("__d", F.explode(F.array(*[of_domain(*d) for d in domains]))).filter(F.size("__d.terms") > 0)
    severity = 10 + _rank_when([(F.col("__cat").isin("recent judgments", "case summary"), 10), (F.col("__cat") == "legislation news", 12), (F.col("__cat") == "press release/judiciary updates", 8)], 0) + F.when(F.col("__d.in_title"), 5).otherwise(0)
    age = age_days(F.coalesce(F.col("date").cast("timestamp"), F.col("first_seen_at")), now)
    recency = _rank_when([(age.isNull(), 4), (age <= 7, 10), (age <= 30, 6), (age <= 90, 3)], 1)
    n = F.size("__d.terms")
    out = every.withColumns(
        {
            "domain": F.col("__d.domain"),
            "terms": F.col("__d.terms"),
            "business": F.col("__d.business"),
            "__a": authority(F.col("source"), F.col("__official"), F.col("__news"), F.col("__type")),
            "severity": F.least(severity, F.lit(30)),
            "recency": recency,
            "confidence": _rank_when([(n >= 3, 15), (n == 2, 11), (n == 1, 7)], 0),
        }
    ).withColumns({"authority": F.col("__a.points"), "authority_label": F.col("__a.label")})
    total = reduce(lambda a, b: a + b, [F.col(c) for c in ("severity", "authority", "recency", "confidence", "business")])
    return out.withColumn("score", F.least(F.lit(100), total)).drop("__d", "__a", "__text", "__title", "__words", "__tw", "__cat", "__official", "__news", "__type")


def level_of(score: Column) -> Column:
    return _rank_when([(score <= 0, "No Signals"), *[(score >= least, name) for name, least in LEVELS]], "Low")


def _capped(n: Column, high: Column) -> Column:
    pick = lambda a, b: F.when(high > 0, a).otherwise(b)
    return F.when(n <= 0, 0).when(n == 1, pick(70, 60)).when(n <= 3, pick(85, 75)).otherwise(pick(100, 85))


def grid(found: DataFrame, now: Column, domains=lexicon.RISK_DOMAINS, jurisdictions=lexicon.JURISDICTIONS) -> DataFrame:
    """Every cell of the grid, empty ones too, from ``signals``: one grouped pass, one window over 30 rows, one small join."""
    at = F.col("date").cast("timestamp")
    days = lambda n: now - F.expr(f"INTERVAL {n} DAYS")
    weight = F.create_map(*[x for k, v in lexicon.AUTHORITY_WEIGHTS.items() for x in (F.lit(k), F.lit(v).cast("decimal(10,2)"))])[F.col("authority_label")]
    cells = found.groupBy("country", "domain").agg(
        F.count("*").alias("n"),
        F.count_if((at >= days(7)) & (at <= now)).alias("last7"),
        F.count_if((at >= days(14)) & (at < days(7))).alias("previous7"),
        F.count_if((at >= days(37)) & (at < days(7))).alias("previous30"),
        F.bround(F.sum(weight), 1).cast("decimal(20,1)").alias("weighted"),
        F.bround(F.sum("score").cast("decimal(20,0)") / F.count("*"), 0).cast("long").alias("mean"),
        *[F.count_if(F.col("authority_label") == k).alias(f"a_{k}") for k in lexicon.AUTHORITY_WEIGHTS],
    )
    return grid_of(cells, domains, jurisdictions)


def grid_of(cells: DataFrame, domains, jurisdictions) -> DataFrame:
    """The grid from the sums of its cells: n, last7, previous7, previous30, weighted, mean, and a count of each authority."""
    spark = cells.sparkSession
    top = F.max("n").over(Window.partitionBy("domain"))
    delta = F.col("last7") - F.col("previous7")
    parts = F.col("mean").cast("decimal(10,0)") * F.lit("0.55").cast("decimal(4,2)") + F.least(F.lit(30), F.col("n") * 7) + F.greatest(F.lit(-8), F.least(F.lit(18), delta * 5)) + F.bround(F.col("n").cast("decimal(20,0)") * 8 / top, 0)
    mix = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in lexicon.AUTHORITY_WEIGHTS]), F.array(*[F.col(f"a_{k}") for k in lexicon.AUTHORITY_WEIGHTS])), lambda _, v: v > 0)
    scored = cells.withColumns({"delta7": delta, "uncapped": F.greatest(F.lit(1), F.least(F.lit(100), F.bround(parts, 0).cast("int"))), "cap": _capped(F.col("n"), F.col("a_High")), "authority_mix": mix})
    trend = F.when(F.col("previous7") > 0, F.when(F.col("delta7") > 0, "rising").when(F.col("delta7") == 0, "stable").otherwise("falling")).when(F.col("last7") > 0, "new activity").otherwise("insufficient historical data")
    scored = scored.withColumns({"score": F.least("uncapped", "cap"), "trend": trend})
    frame = [(j, i, d[0], k, d[1]) for i, j in enumerate(jurisdictions) for k, d in enumerate(domains)]
    full = F.broadcast(spark.createDataFrame(frame, "country string, j_ord int, domain string, d_ord int, label string")).join(scored, ["country", "domain"], "left")
    zero = lambda c, kind="long": F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    explained = F.concat(zero("n").cast("string"), F.when(F.coalesce("n", F.lit(0)) == 1, " raw signal; ").otherwise(" raw signals; "), F.coalesce("weighted", F.lit(0)).cast("string"), F.lit(" weighted; delta "), F.coalesce("delta7", F.lit(0)).cast("string"))
    return full.select(
        "country", "domain", "label", "j_ord", "d_ord", zero("score", "int"), level_of(F.coalesce("score", F.lit(0))).alias("level"), zero("uncapped", "int"), zero("cap", "int"), zero("n"),
        zero("weighted", "decimal(20,1)"), zero("last7"), zero("previous7"), zero("previous30"), zero("delta7"), F.coalesce("trend", F.lit("insufficient historical data")).alias("trend"),
        F.coalesce("authority_mix", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))).alias("authority_mix"), F.when(F.col("n") > 0, explained).otherwise("No signals in selected period.").alias("rationale"),
    )


def top_signals(found: DataFrame, most: int = 8) -> DataFrame:
    """The latest, strongest signals of each cell, numbered from 1."""
    order = Window.partitionBy("country", "domain").orderBy(F.col("date").desc_nulls_last(), F.col("score").desc(), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def kpis(cells: DataFrame, items: DataFrame, now: Column, jurisdictions=lexicon.JURISDICTIONS) -> DataFrame:
    """One row: the highest cell, the hottest domain, the fastest riser, displayed signals, items of the week. Ties: grid order."""
    active = cells.filter("score > 0")
    back = lambda *c: F.struct(*c)
    ordinal = -(F.col("j_ord") * 100 + F.col("d_ord"))
    rises = (F.col("delta7") > 0) | (F.col("last7") > 0)
    one = active.agg(
        F.max_by("country", back(F.col("score"), ordinal)).alias("highest_country"),
        F.max_by("domain", back(F.col("score"), ordinal)).alias("highest_domain"),
        F.max_by(F.concat_ws(" / ", "country", "domain"), F.when(rises, back(F.col("delta7"), F.col("last7"), F.col("weighted"), ordinal))).alias("rising"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("displayed"),
    )
    hot = active.groupBy("domain", "d_ord").agg(F.sum("weighted").alias("w")).agg(F.max_by("domain", back(F.col("w"), -F.col("d_ord"))).alias("hottest"))
    at = F.coalesce(F.col("date").cast("timestamp"), F.col("first_seen_at"))
    week = items.filter(F.col("country").isin(*jurisdictions)).agg(F.count_if((at >= now - F.expr("INTERVAL 7 DAYS")) & (at <= now)).alias("ingested_week"))
    return one.crossJoin(hot).crossJoin(week)


def filtered_cells(cells: DataFrame, top: DataFrame, *, level: str | None, since: Column) -> DataFrame:
    """Cells of a level with the signals shown since a date; cells left without any count zero."""
    shown = top.filter(F.col("date") >= since).groupBy("country", "domain").agg(F.count("*").alias("shown"))
    out = cells.join(shown, ["country", "domain"], "left").withColumn("shown", F.coalesce("shown", F.lit(0)))
    out = out.withColumn("score", F.when(F.col("shown") == 0, 0).otherwise(F.col("score"))).withColumn("level", F.when(F.col("shown") == 0, "No Signals").otherwise(F.col("level")))
    return out.filter(F.col("level") == level) if level and level != "All" else out
