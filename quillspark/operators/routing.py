"""Routing: topics, urgency and impact of items, department scores, strategic signals, balanced digests."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import lexicon
from quillspark.functions.matching import PATTERN, Lexicons
from quillspark.functions.text import any_substring, any_word, executive_title
from quillspark.operators.frame import settled
from quillspark.operators.heatmap import _rank_when


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit("0.5").cast("decimal(2,1)")).cast("int")


def routing_text(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *columns))


#: Every word pattern of routine, strategic and alertable texts, and the v of a case's name.
SAYINGS = {
    "court": lexicon.COURT_TOPIC_WORDS, "cause": lexicon.CAUSE_LIST_WORDS, "outcome": lexicon.ROUTINE_OUTCOME_WORDS, "strategic": lexicon.STRATEGIC_COURT_WORDS, "precedent": lexicon.PRECEDENT_WORDS,
    "notice": lexicon.NOTICE_WORDS, "excuse": lexicon.NOTICE_EXCUSE_WORDS, "unless": lexicon.ANALYSIS_EXCUSE_WORDS, "versus": "v",
}


def _lexicons(topics=(), action: str = "", signals=()) -> Lexicons:
    """Topics, action and signals, and what routine and alertable texts say, as one set of lexicons."""
    return Lexicons(PATTERN, action=action, **SAYINGS, **{f"topic{i}": t[1] for i, t in enumerate(topics)}, **{f"rule{i}": r[2] for i, r in enumerate(signals)})


def topic_of(text: Column, category: Column, rules=lexicon.TOPIC_RULES) -> Column:
    lexicons = _lexicons(rules)
    return lexicons.found(text, lambda words, t: _topic(lexicons, words, t, category, rules))


def _topic(lexicons: Lexicons, words: Column, text: Column, category: Column, rules) -> Column:
    pairs = [(lexicons.any(f"topic{i}", words, text) | (category.isin(*cats) if cats else F.lit(False)), topic) for i, (topic, _, cats) in enumerate(rules)]
    return _rank_when([*pairs, (category == "Press Release/Judiciary Updates", "Judiciary Modernization")], "Legislative Development")


def urgency_of(acts: Column, topic: Column, category: Column) -> Column:
    """``acts`` is whether the text asks for action."""
    return _rank_when(
        [(acts, "ACTION REQUIRED"), (topic.isin(*lexicon.STRATEGIC_TOPICS), "STRATEGIC"), (category.isin("Legislation News", "Recent Judgments"), "WATCH"), (category == "Legal News", "INFORMATIONAL")], "WATCH"
    )


def impact_of(urgency: Column, topic: Column, category: Column, is_new: Column, source_text: Column) -> Column:
    score = 52 + _rank_when([(urgency == "ACTION REQUIRED", 28), (urgency == "STRATEGIC", 20), (urgency == "WATCH", 10)], 0)
    score = score + F.when(topic.isin("AI Regulation", "Privacy/Data Protection", "API/Data Licensing"), 10).otherwise(0)
    score = score + F.when(category.isin("Recent Judgments", "Legislation News", "Case Summary"), 8).otherwise(0) + F.when(is_new, 5).otherwise(0)
    return F.greatest(F.lit(35), F.least(F.lit(98), score + F.when(source_text.rlike(lexicon.OFFICIAL_SOURCE_PATTERN), 4).otherwise(0)))


def routing_items(items: DataFrame, now: Column, topic_rules=lexicon.TOPIC_RULES, action=lexicon.ACTION_PATTERN, signal_rules=lexicon.SIGNAL_RULES) -> DataFrame:
    """Items with topic, urgency, impact, status, tags, and words: those of all routing lexicons that their texts have.

    A text is cut into words here, once; strategic scores of the same rules read ``words``.
    """
    text = routing_text("title", "summary", "category", "source", "source_tab")
    out = settled(items, {"__text": text, "is_new": F.col("first_seen_at") >= now - F.expr("INTERVAL 24 HOURS")})
    lexicons = _lexicons(topic_rules, action, signal_rules)
    words, said = F.col("words"), F.col("__text")
    out = settled(out, {"words": lexicons.words(said)})
    out = settled(out, {"topic": _topic(lexicons, words, said, F.col("category"), topic_rules), "__acts": lexicons.any("action", words, said)})
    out = settled(out.drop("__text"), {"urgency": urgency_of(F.col("__acts"), F.col("topic"), F.col("category"))})
    out = out.withColumn("impact", impact_of(F.col("urgency"), F.col("topic"), F.col("category"), F.col("is_new"), routing_text("source", "source_tab")))
    tags = F.array_compact(F.array(F.regexp_replace(F.lower("topic"), "[^a-z0-9]+", "_"), "category", "source_tab"))
    return out.withColumns({"status": F.when(F.col("is_new"), "New").otherwise("Reviewed"), "tags": tags}).drop("__acts")


def departments(spark: SparkSession, profiles=lexicon.DEPARTMENTS) -> DataFrame:
    """Department profiles as a small dimension: department, d_ord, name, short_name, topics, places."""
    return spark.createDataFrame([(d[0], i, d[1], d[2], dict(d[3]), list(d[4])) for i, d in enumerate(profiles)], "department string, d_ord int, name string, short_name string, topics map<string,int>, places array<string>")


def _score(topic_weight: Column, place_match: Column) -> Column:
    """The route score of an item with urgency and impact, 0 to 100, rounded half up on decimals."""
    urgency = F.create_map(*[x for k, v in lexicon.URGENCY_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    exact = lambda x: F.lit(x).cast("decimal(4,2)")
    raw = topic_weight * exact("0.45") + F.when(place_match, 18).otherwise(5) + F.coalesce(urgency[F.col("urgency")], F.lit(20)) * exact("0.18") + F.col("impact") * exact("0.19")
    return F.greatest(F.lit(0), F.least(F.lit(100), half_up(raw)))


def route_score(department: str, profiles=lexicon.DEPARTMENTS) -> Column:
    """The score of a routing item for one department, as a column: no pairs are made."""
    profile = next(p for p in profiles if p[0] == department)
    weights = F.create_map(*[x for k, v in dict(profile[3]).items() for x in (F.lit(k), F.lit(v))])
    return _score(F.coalesce(weights[F.col("topic")], F.lit(0)), F.coalesce(F.col("country").isin(*profile[4]), F.lit(False)))


def route_count(profiles=lexicon.DEPARTMENTS, least: int = 58, from_ai: Column | None = None) -> Column:
    """How many departments an item is routed to; sales counts only for items ``from_ai``, the AI news."""
    routed = {p[0]: F.when(route_score(p[0], profiles) >= least, 1).otherwise(0) for p in profiles}
    if "sales" in routed:
        routed["sales"] = F.when(from_ai, routed["sales"]).otherwise(0) if from_ai is not None else F.lit(0)
    return reduce(lambda a, b: a + b, routed.values()).cast("long")


def route_scores(routed: DataFrame, teams: DataFrame) -> DataFrame:
    """Every item against every department, scored and ranked: departments, a handful, are one row that meets each item.

    Ranking is a sort of those few scores beside the item, so nothing is shuffled.
    """
    one = teams.agg(F.collect_list(F.struct("department", "d_ord", "name", "short_name", "topics", "places")).alias("__teams"))
    both = routed.crossJoin(F.broadcast(one))

    def scored(t: Column) -> Column:
        topic, match = F.coalesce(t["topics"][F.col("topic")], F.lit(0)), F.array_contains(t["places"], F.col("country"))
        s = _score(topic, match)
        # Ordered by score, best first, then by the departments' order.
        return F.struct((-s).alias("minus"), *[t[c].alias(c) for c in ("d_ord", "department", "name", "short_name")], topic.alias("topic_weight"), match.alias("place_match"), s.alias("route_score"))

    ranked = both.select(*routed.columns, F.posexplode(F.array_sort(F.transform("__teams", scored))).alias("__p", "__r"))
    s = F.col("route_score")
    out = ranked.select(*routed.columns, "__r.department", "__r.d_ord", "__r.name", "__r.short_name", "__r.topic_weight", "__r.place_match", "__r.route_score", (F.col("__p") + 1).alias("route_rank"))
    return out.withColumns({"routed": s >= 58, "confidence": _rank_when([(s >= 82, "High"), (s >= 66, "Medium-High"), (s >= 48, "Medium")], "Low")})


def _text(with_tags: bool = True) -> Column:
    return F.lower(F.concat_ws(" ", "title", "summary", "topic", "category", "source", "source_tab", *([F.array_join("tags", " ")] if with_tags else [])))


#: The alternatives of the intake pattern that are plain, and a part that each of the others needs.
_INTAKE_PLAIN = tuple(p for p in lexicon.ROUTINE_INTAKE_PATTERN.split("|") if re.fullmatch("[a-z ]+", p))
_INTAKE_PARTS = ("agms and egms", "in memoriam", "download ministry")


def routine_intake(text: Column) -> Column:
    return any_substring(text, _INTAKE_PLAIN) | any_substring(text, _INTAKE_PARTS) & text.rlike(lexicon.ROUTINE_INTAKE_PATTERN)


def _routine_judgment(lexicons: Lexicons, words: Column, text: Column, topic: Column) -> Column:
    has = lambda name: lexicons.any(name, words, text)
    listed = has("cause") | has("versus") & text.rlike(r"\sv\.?\s")
    return (topic.isin("Precedent-Setting Judgment", "Judiciary Modernization") | has("court")) & (listed | has("outcome")) & ~has("strategic")


def routine_judgment(text: Column, topic: Column) -> Column:
    lexicons = Lexicons(PATTERN, **SAYINGS)
    return lexicons.found(text, lambda words, t: _routine_judgment(lexicons, words, t, topic))


def _alertable(title: Column, unless: Column, intake: Column, routine: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    lexicons = Lexicons(PATTERN, opinion=lexicon.OPINION_WORDS, analysis=lexicon.ANALYSIS_WORDS)
    quiet = lexicons.found(low, lambda words, t: ~lexicons.any("opinion", words, t) & ~(lexicons.any("analysis", words, t) & ~unless))
    return ~intake & ~routine & quiet


def alertable(title: Column, text: Column, topic: Column) -> Column:
    """Not opinion, not mere analysis, not routine."""
    return _alertable(title, any_word(text, lexicon.ANALYSIS_EXCUSE_WORDS), routine_intake(text), routine_judgment(text, topic))


def strategic_scores(routed: DataFrame, scores: DataFrame | None = None, rules=lexicon.SIGNAL_RULES) -> DataFrame:
    """Routed items with n_routes, signal_score, reasons, headline and alertable; caps apply in order.

    Without ``scores`` routes are counted from the default profiles, in the same pass. ``words`` of routed items must be
    those of the same signal rules; items without that column are cut into words here. Where there is a column
    ``from_ai``, routes to sales count for the items that it marks.
    """
    from_ai = F.coalesce(F.col("from_ai"), F.lit(False)) if "from_ai" in routed.columns else None
    if scores is None:
        out = routed.withColumn("n_routes", route_count(from_ai=from_ai))
    else:
        sales = F.col("department") == "sales"
        counts = ~sales | F.coalesce(F.col("from_ai"), F.lit(False)) if from_ai is not None else ~sales
        routes = scores.filter(F.col("routed") & counts).groupBy("id").agg(F.count("*").alias("n_routes"))
        out = routed.join(routes, "id", "left").withColumn("n_routes", F.coalesce("n_routes", F.lit(0)))
    # Points, caps, reasons and alerts read the words that were found, and those of what routing has added.
    lexicons = _lexicons(signals=rules)
    added = F.lower(F.concat_ws(" ", "topic", F.array_join("tags", " ")))
    out = settled(out, {"__t": _text()})
    out = settled(out, {"__w": F.array_union("words", lexicons.words(added)) if "words" in out.columns else lexicons.words(F.col("__t"))})
    t, w, topic, n, urgency = F.col("__t"), F.col("__w"), F.col("topic"), F.col("n_routes"), F.col("urgency")
    has = lambda name: lexicons.any(name, w, t)
    tests = {f"hit{i}": has(f"rule{i}") | topic.isin(*topics) for i, (_, _, _, topics) in enumerate(rules)}
    tests |= {
        "intake": routine_intake(t),
        "plain": (topic == "Precedent-Setting Judgment") & ~has("precedent"),
        "routine": _routine_judgment(lexicons, w, t, topic),
        "notice": has("notice") & ~has("excuse"),
        "unless": has("unless"),
    }
    out = settled(out, {"__s": F.struct(*[c.alias(k) for k, c in tests.items()])}).drop("__t", "__w")
    said = F.col("__s")
    score = _rank_when([(n >= 3, 24), (n == 2, 14), (n == 1, 6)], 0)
    reasons = [F.when(n >= 3, "multi-department relevance").when(n == 2, "cross-team relevance")]
    for i, (points, reason, _, _) in enumerate(rules):
        hit = said[f"hit{i}"]
        score = score + F.when(hit, points).otherwise(0)
        reasons.append(F.when(hit, reason))
    for name, (points, reason) in lexicon.URGENCY_POINTS.items():
        score = score + F.when(urgency == name, points).otherwise(0)
        if reason:
            reasons.append(F.when(urgency == name, reason))
    score = score + F.least(F.lit(10), F.greatest(F.lit(0), F.floor((F.col("impact") - 65) / F.lit(3.0) + 0.5).cast("int")))
    caps = [
        (said["intake"], 38, "suppressed routine intake item"),
        (said["plain"], 64, "ordinary judgment without clear strategic significance"),
        (said["routine"], 58, "ordinary judgment/procedural item without strategic significance"),
        (said["notice"], 45, "low-impact administrative notice"),
    ]
    for condition, most, reason in caps:
        score = F.when(condition, F.least(score, F.lit(most))).otherwise(score)
        reasons.append(F.when(condition, reason))
    made = {"signal_score": F.greatest(F.lit(0), F.least(F.lit(100), score)), "__why": F.array(*reasons), "alertable": _alertable(F.col("title"), said["unless"], said["intake"], said["routine"])}
    return settled(out, made).withColumns({"reasons": F.array_distinct(F.array_compact("__why")), "headline": executive_title(F.col("title"))}).drop("__s", "__why")


def strategic_signals(scored: DataFrame, threshold: int = 72) -> DataFrame:
    """Items of ``threshold`` points or more, best first.

    A global sort samples its input before it sorts it; the exchange before it makes it read what was scored, not score twice.
    """
    return scored.filter(F.col("signal_score") >= threshold).hint("rebalance").orderBy(F.col("signal_score").desc(), F.col("impact").desc(), F.col("date").desc_nulls_last(), "id")


def digest_candidates(scored: DataFrame, scores: DataFrame | None, department: str, most: int = 12) -> DataFrame:
    """Alertable items of a department (route score 52 or more) in digest order, numbered by ``rank``.

    ``most`` keeps the first of each country, which is all that a digest of so many entries can need. Without
    ``scores`` the default profiles score the items in the same pass.
    """
    order = F.array(*[F.lit(c) for c in lexicon.PRODUCT_CATEGORY_ORDER])
    place = F.when(F.array_position(order, F.col("category")) > 0, F.array_position(order, F.col("category"))) if department == "product" else F.lit(0)
    if scores is None:
        own = settled(scored, {"route_score": route_score(department)}).filter("route_score >= 52")
    else:
        own = scored.join(scores.filter((F.col("department") == department) & (F.col("route_score") >= 52)).select("id", "route_score"), "id")
    out = own.withColumn("category_rank", place.cast("int")).filter(F.col("category_rank").isNotNull() & F.col("alertable"))
    order = ["category_rank", F.col("signal_score").desc(), F.col("route_score").desc(), F.col("impact").desc(), "id"]
    # No country gives a digest more entries than it has in all, so the first of each are enough; ranks count those alone.
    best = out.withColumn("__n", F.row_number().over(Window.partitionBy("country").orderBy(*order))).filter(F.col("__n") <= most).drop("__n")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def balanced(entries: DataFrame, most: int, by: str = "country", order: tuple[str, ...] = ("rank",)) -> DataFrame:
    """A round-robin over groups: everyone's first before anyone's second. Entries without a group are always first."""
    turn = F.when(F.coalesce(F.col(by), F.lit("")) == "", 1).otherwise(F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return entries.withColumn("turn", turn).orderBy("turn", *order).limit(max(3, min(12, most)))


def breakdown(signals_: DataFrame) -> DataFrame:
    """Counts of signals by urgency, country and topic: one pass over grouping sets."""
    sets = signals_.groupingSets([["urgency"], ["country"], ["topic"]], "urgency", "country", "topic").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    return sets.select(F.when(F.col("g") == 3, "urgency").when(F.col("g") == 5, "country").otherwise("topic").alias("kind"), F.coalesce("urgency", "country", "topic").alias("name"), "n")


def source_registry_lookup(items: DataFrame, registry: DataFrame) -> DataFrame:
    """source_name and source_link of items, by the first of: own link, source name, country with the topic as category, country, '#'."""
    first = lambda keys, as_: registry.groupBy(*keys).agg(F.min_by(F.struct("name", "url"), "id").alias(as_))
    by_name = first([F.col("name").alias("source")], "__s1")
    by_topic = first(["country", F.lower("category").alias("__topic")], "__s2")
    by_place = first(["country"], "__s3")
    own = F.when(F.length(F.trim(F.coalesce("link", F.lit("")))) > 0, F.struct(F.coalesce("source", F.lit("Collected legal update")).alias("name"), F.col("link").alias("url")))
    none = F.struct(F.coalesce("source", F.lit("Source registry")).alias("name"), F.lit("#").alias("url"))
    joined = items.withColumn("__topic", F.lower("topic")).join(by_name, "source", "left").join(by_topic, ["country", "__topic"], "left").join(by_place, "country", "left")
    found = F.coalesce(own, "__s1", "__s2", "__s3", none)
    return joined.withColumns({"source_name": found["name"], "source_link": found["url"]}).drop("__topic", "__s1", "__s2", "__s3")


def source_lookup(items: DataFrame, registry: DataFrame) -> DataFrame:
    """source_url by prioritised lookup: the source's name, else the first of its country and category, else the link."""
    by_name = registry.groupBy(F.col("name").alias("source")).agg(F.min_by("url", "id").alias("__u1"))
    by_place = registry.groupBy("country", "category").agg(F.min_by("url", "id").alias("__u2"))
    joined = items.join(by_name, "source", "left").join(by_place, ["country", "category"], "left")
    return joined.withColumn("source_url", F.coalesce("__u1", "__u2", "link")).drop("__u1", "__u2")
