"""Catalogue queries on briefings, AI news, ingestion as one job, labels and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import dates, labels, lexicon, text, urls, wordings
from quillspark.operators import ainews, briefing, dedup, digest, listing, refresh, routing, summarize
from quillspark.plans import insight_queries as insight
from quillspark.plans.items_queries import _CLEAN, _COUNTRY_SQL, _CUT, _SCORES as _COUNTRY_SCORES, CATEGORY_RULES, COUNTRY_SIGNALS, GATE_COMMERCIAL, GATE_NOISE, GATE_POLITICAL, GATE_STRONG, GATED_SQL, LEGAL_TERMS
from quillspark.plans.sqlparts import KEY_SQL, NOW_SQL, URL_SQL, has_any, quoted, with_items
from quillspark.sources import scans
from quillspark.sources.items import REGISTRY_SQL, RUNS_SQL, items, now, read, registry, runs

AI_REGISTRY = [
    ("ai_src0", "src0", "global", "editorial/legal_ai_news", "Editorial", ["legal_ai", "legal_tech"], "https://ai0.example/", "rss"),
    ("ai_src1", "src1", "us", "official/policy", "Official", ["ai_governance"], "https://ai1.example/", "scraper"),
    ("ai_src2", "src2", "eu", "vendor/product", "Vendor", ["legal_market"], "https://ai2.example/", "manual"),
    ("ai_src3", "src3", "apac", "market/analysis", "Market Intelligence", ["competitor_intelligence"], "https://ai3.example/", "scraper"),
    ("ai_src4", "src4", "elsewhere", "html", "Editorial", [], "https://ai4.example/", "api"),
]
AI_TERMS, AI_FOCUSED = ("ai", "license", "und"), ("ai_src0",)
AI_TOPICS = ((r"licen[cs]|ation", "Legal Tech Market Intelligence"), (r"und|que", "AI Regulation"), (r"mit|tion", "Privacy/Data Protection"), (r"the", "API/Data Licensing"))
AI_GENERIC = ("All rights reserved.", "Anble anes.")


def ai_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AI_REGISTRY, "id string, name string, region string, source_type string, category string, tags array<string>, url string, ingestion_method string")


_AI_VALUES = ",\n".join("(" + ", ".join(f"[{quoted(v)}]::VARCHAR[]" if isinstance(v, list) else quoted([v]) for v in row) + ")" for row in AI_REGISTRY)
AI_SQL = f"""air(source_id, name, region, source_type, ai_category, tags, u, method) AS (VALUES {_AI_VALUES}),
ai0 AS (SELECT i.id, i.first_seen_at, i.date, air.*, {_CLEAN.format('i.title')} AS c1, {_CLEAN.format('i.summary')} AS c2, {URL_SQL.replace('source ', 'i.source ').replace('id %', 'i.id %')} AS link FROM items i JOIN air ON air.name = i.source),
ai1 AS (SELECT *, {_CUT.format('c1', 260, 259)} AS title, {_CUT.format('c2', 520, 519)} AS summary FROM ai0),
ai AS (SELECT *, sha256('{wordings.AI_GROUP}|' || source_id || '|' || CASE WHEN {KEY_SQL.format('title')} <> '' THEN {KEY_SQL.format('title')} ELSE link END) AS fingerprint FROM ai1
  WHERE len(title) >= 8 AND (source_id IN ({quoted(AI_FOCUSED)}) OR {has_any("lower(title || ' ' || summary)", AI_TERMS)}))"""
_AI_TOPIC = "CASE " + " ".join(f"WHEN regexp_matches(words, '{p}') THEN '{t}'" for p, t in AI_TOPICS) + f" ELSE '{wordings.AI_TOPIC_OTHERWISE}' END"
_REGION = "CASE region " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in wordings.REGION_LABELS.items()) + " ELSE region END"
AI_ROUTED_SQL = f"""ait AS (SELECT *, lower(concat_ws(' ', title, nullif(summary, ''), source_type, ai_category, array_to_string(tags, ' '))) AS words FROM ai WHERE trim(title) NOT IN ({quoted(AI_GENERIC)})),
airouted AS (SELECT 'legal-ai-' || id AS id, {_AI_TOPIC} AS topic, {_REGION} AS country, CASE WHEN ai_category IN ({quoted(wordings.AI_STRATEGIC_CATEGORIES)}) THEN 'STRATEGIC' ELSE 'WATCH' END AS urgency,
  CASE WHEN ai_category = 'Vendor' OR list_contains(tags, 'competitor_intelligence') THEN 88 WHEN ai_category = 'Official' THEN 84 ELSE 76 END AS impact, CASE WHEN first_seen_at >= {NOW_SQL} - INTERVAL 24 HOUR THEN 'New' ELSE 'Reviewed' END AS status, u AS source_url, tags AS own_tags FROM ait)"""


def _ai(spark, sf) -> DataFrame:
    sources = ai_registry(spark).select(F.col("name").alias("source"), F.col("id").alias("source_id"))
    return ainews.ai_items(items(spark, sf).join(sources, "source"), ai_registry(spark), terms=AI_TERMS, focused=AI_FOCUSED)


def ai_items(spark, sf):
    return _ai(spark, sf).select("id", "source_id", "region", "category", F.array_join("tags", ",").alias("tags"), "title", F.md5("summary").alias("summary_md5"), "link", "fingerprint")


def _ai_routed(spark, sf) -> DataFrame:
    return ainews.ai_routing_items(_ai(spark, sf), ai_registry(spark), now(), AI_TOPICS, AI_GENERIC)


def ai_routing(spark, sf):
    return _ai_routed(spark, sf).select("id", "topic", "country", "urgency", "impact", "status", "source_url", F.array_join("tags", ",").alias("tags"))


def sales_items(spark, sf):
    """What sales reads: AI items, since there are some; with none it would be the general ones."""
    general = insight._routed(spark, sf).select(F.col("id").cast("string").alias("id"), "topic", "country", "urgency", "impact", "status")
    ai = _ai_routed(spark, sf).select("id", "topic", "country", "urgency", "impact", "status")
    some = ainews.for_department("sales", general, ai).withColumn("reader", F.lit("sales"))
    none = ainews.for_department("sales", general, ai.filter("urgency = 'none'")).withColumn("reader", F.lit("without"))
    return some.unionByName(none).groupBy("reader", "urgency").agg(F.count("*").alias("n"), F.sum("impact").alias("impact"))


def ai_route_counts(spark, sf):
    """How many departments AI items are routed to; sales is one of them, as it is not for others."""
    items_ = _ai_routed(spark, sf).withColumn("from_ai", F.col("id").like("%2"))
    return items_.select("id", routing.route_count(from_ai=F.col("from_ai")).alias("n_routes"))


def department_recipients(spark, sf):
    """Who gets the digest of each source's team: groups are registered for some."""
    teams = items(spark, sf).select(F.col("source").alias("department"), F.concat(F.lit("Team "), "source").alias("name")).distinct()
    groups = registry(spark).filter("official").select(F.col("name").alias("team"), F.col("category").alias("name"), F.concat("name", F.lit(" desk")).alias("group_name"), F.concat("name", F.lit("@example.invalid")).alias("email"), F.lit("Chat").alias("channel"))
    return ainews.recipients(teams, groups)


def explained_routes(spark, sf):
    scores = insight._scores(spark, sf)
    return briefing.explained_routes(scores, briefing.implications(spark)).select("id", "department", "why", "action")


def intake_cards(spark, sf):
    return briefing.intake_cards(insight._scores(spark, sf))


def department_digest(spark, sf):
    return briefing.department_digest(insight._scores(spark, sf), "editorial", "Editorial", "Weekly", 9)


def digest_sentence(spark, sf):
    one = digest.digest_counts(insight._digest(spark, sf))
    return one.select(briefing.digest_sentence(F.col("n"), F.col("urgent"), F.col("topics"), "Legislation Team", "Weekly Executive Digest").alias("sentence"))


def executive_summaries(spark, sf):
    r = insight._routed(spark, sf)
    return r.select("id", briefing.executive_summary(F.col("title"), F.when(F.col("id") % 3 > 0, F.col("summary")), F.col("source"), F.col("topic"), F.col("country")).alias("text"))


def dashboard_counts(spark, sf):
    # Scores are of the items that are read once, for the signals; the count of all asks for none.
    return briefing.dashboard_counts(items(spark, sf), routing.strategic_signals(insight._scored(spark, sf), 60), now())


CHOSEN = (lexicon.JURISDICTIONS[0], lexicon.JURISDICTIONS[1], lexicon.JURISDICTIONS[4])


def digest_choice(spark, sf):
    """Candidates of two countries and one topic, and those of a selection that they hold."""
    routed = insight._routed(spark, sf).withColumn("status", F.when(F.col("id") % 2 == 0, "Approved").otherwise(F.col("status")))
    return briefing.digest_choice(routed, approved=True, countries=CHOSEN, topic="API/Data Licensing").select("id", "country")


def selected_digest(spark, sf):
    """A selection in its own order, ids that are no candidates dropped, and the balanced entries where it is empty."""
    candidates = insight._routed(spark, sf).filter("urgency = 'ACTION REQUIRED'").select("id", "country", (F.col("id") + 1).cast("int").alias("rank"))
    ids = items(spark, sf).filter("id % 97 = 5").select("id", (-F.col("id")).cast("int").alias("pos"))
    balanced = routing.balanced(candidates, 12)
    chosen = briefing.selected_or_balanced(candidates, ids, balanced, 5).withColumn("how", F.lit("selected"))
    return chosen.unionByName(briefing.selected_or_balanced(candidates, ids.limit(0), balanced, 5).withColumn("how", F.lit("balanced")))


def _issues(spark, sf) -> DataFrame:
    d, n = read(spark, sf, "documents"), F.col("doc_id")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return d.select(n.alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("about "), "source")).alias("summary"), F.lit("body").alias("text_body"), F.when(n % 2 == 0, "published").alias("status"), F.when(n % 2 == 0, at).alias("published_at"), at.alias("created_at"), F.date_add(at, 1).cast("timestamp").alias("updated_at"))


def issues_as_items(spark, sf):
    return briefing.issue_as_item(_issues(spark, sf)).select("id", "country", "source_tab", "title", "summary", "date", "first_seen_at", "is_new")


def issues_as_digests(spark, sf):
    return briefing.issue_as_digest(_issues(spark, sf)).select("digest_id", "title", "status", "item_count", "department", "digest_type", F.size("entries").alias("entries"))


def decoded_digests(spark, sf):
    n = F.col("doc_id")
    raw = F.when(n % 3 == 0, F.concat(F.lit('[{"id": '), n.cast("string"), F.lit('}, {"id": 2}]'))).when(n % 3 == 1, F.lit('[{"id": '))
    made = read(spark, sf, "documents").select(n.alias("id"), raw.alias("entries_json"))
    return briefing.decoded_entries(made, "array<struct<id:bigint>>").select("id", F.array_join(F.transform("entries", lambda e: e["id"].cast("string")), ",").alias("entries"))


def rebuilt_digests(spark, sf):
    """New bodies for a third of the digests; identity and dates stay."""
    issues = _issues(spark, sf)
    return briefing.rebuilt(issues, issues.filter("id % 3 = 1").select("id", F.concat(F.lit("New: "), "title").alias("title"))).select("id", "title", "created_at")


def summary_payload(spark, sf):
    entries = insight._digest(spark, sf).withColumn("link", F.when(F.col("rank") % 3 == 0, F.lit("")).when(F.col("rank") % 3 == 1, F.lit("ftp://x/")).otherwise(F.col("link")))
    return briefing.summary_payload(entries, registry(spark)).select("item_id", "link", "source", "jurisdiction")


def summary_inputs(spark, sf):
    row = {"title": F.col("title"), "source": F.col("source"), "jurisdiction": F.col("country"), "category": F.when(F.col("id") % 2 == 0, F.col("category")), "link": F.col("link")}
    return items(spark, sf).select("id", F.md5(briefing.summary_input(row, F.col("summary"))).alias("input_md5"))


def fallback_contents(spark, sf):
    """The items' own texts where a source gives none, by digest; short and boilerplate ones are empty."""
    return items(spark, sf).select("id", F.md5(briefing.fallback_content(F.col("title"), F.when(F.col("id") % 3 > 0, F.col("summary")))).alias("text_md5"))


def item_summaries(spark, sf):
    """Summaries by the first provider that is configured, which fails on some texts; a third way of failing is a private address."""

    def begins(text: str) -> str:
        if len(text) % 3 == 0:
            raise ValueError(f"length {len(text)}")
        return text[:20] + "!"

    link = F.when(F.col("id") % 7 == 0, F.lit("http://10.0.0.1/x")).otherwise(F.col("link"))
    rows = items(spark, sf).select("id", F.when(F.col("id") % 5 > 0, F.col("title")).alias("content"), F.when(F.col("id") % 2 == 0, F.col("summary")).alias("summary"), link.alias("link"))
    return summarize.summarize(rows, summarize.resolve({"remote": None, "local": begins}), allowed=briefing.summarisable(F.col("link")))


def provider_texts(spark, sf):
    """Replies of a provider in three shapes, read back."""
    d, n = read(spark, sf, "documents"), F.col("doc_id")
    parts = F.array(F.struct(F.array(F.struct("source")).alias("content")), F.struct(F.array(F.struct(F.lit("and").alias("source")), F.struct(F.col("lang").alias("source"))).alias("content")))
    nested = F.regexp_replace(F.to_json(F.struct(parts.alias("output"))), '"source"', '"text"')
    reply = F.when(n % 3 == 0, F.to_json(F.struct(F.substring_index("text", "\n", 1).alias("output_text")))).when(n % 3 == 1, nested).otherwise("not json")
    return d.select("doc_id", F.md5(briefing.provider_text(reply)).alias("text_md5"))


def public_urls(spark, sf):
    """Which addresses may be fetched, of pages and of made hosts."""
    hosts = ("localhost", "10.1.2.3", "127.0.0.1:80", "172.20.0.1", "172.40.0.1", "192.168.9.9", "printer.local", "8.8.8.8", "[::1]", "169.254.1.1", "224.0.0.1", "user@0.0.0.0")
    made = F.element_at(F.array(*[F.lit(h) for h in hosts]), (F.col("page_id") % len(hosts)).cast("int") + 1)
    scheme = F.when(F.col("page_id") % 7 == 6, "ftp").otherwise("http")
    return read(spark, sf, "pages").select("page_id", urls.public_url(F.col("url")).alias("own"), urls.public_url(F.concat(scheme, F.lit("://"), made, F.lit("/x"))).alias("made"))


def part_labels(spark, sf):
    p = read(spark, sf, "part")
    spelt = F.lower(F.regexp_replace("p_type", " ", "_"))
    region = F.element_at(F.array(*[F.lit(r) for r in ("apac", "eu", "mars", "us")]), (F.col("p_size") % 4).cast("int") + 1)
    return p.select("p_partkey", labels.topic_label(spelt).alias("topic"), labels.region_label(region).alias("region"), labels.source_type_label(F.concat(spelt, F.lit("/news_site"))).alias("kind"), labels.date_range_label(F.lit("30d")).alias("range"))


def scan_ages(spark, sf):
    """How long ago sources were scanned, in words."""
    r = runs(spark, sf).withColumn("at", F.when(F.col("id") % 5 > 0, F.col("fetched_at")))
    return r.select("id", labels.time_ago(F.col("at"), F.lit("2024-01-16 00:00:00").cast("timestamp")).alias("ago"), labels.day_label(F.col("at")).alias("day"))


def order_instants(spark, sf):
    """Order dates written as ISO texts with and without an offset, read as UTC instants."""
    o, n = read(spark, sf, "orders"), F.col("o_orderkey")
    written = F.when(n % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(n % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).when(n % 4 == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")
    return o.select("o_orderkey", dates.instant(written).alias("at"))


def gazette_titles(spark, sf):
    """Titles made of table cells: dates, ids, sizes and labels go, repeats count once."""
    p = read(spark, sf, "part")
    cells = F.array("p_name", F.lit("12-Jan-2024"), "p_brand", F.lit("CG-DL-E-12012024-251234"), F.lit("Download 1.25 MB"), F.lit("Gazette ID"), F.col("p_name"))
    return p.select("p_partkey", text.gazette_title(cells).alias("title"))


def routing_rows(spark, sf):
    """Several scans as one: the first 100 items of three categories and the first 200 of all, each item once."""
    return listing.many_pages(items(spark, sf), now(), [{"category": c, "limit": 100} for c in lexicon.PRODUCT_CATEGORY_ORDER] + [{"limit": 200}]).select("id")


def public_rows(spark, sf):
    """What visitors see of the raw items by country: all of them, and nothing where the site is public."""
    seen = lambda public: listing.public_view(items(spark, sf), public=public).groupBy("country").agg(F.count("*").alias("n")).withColumn("public", F.lit(public))
    return seen(False).unionByName(seen(True))


def _entries(spark, sf) -> DataFrame:
    return items(spark, sf).select("source", "title", "summary", "date", "link", F.col("id").alias("seq"), F.col("country").alias("country"), F.col("category").alias("category"), "source_tab")


_GATES = {"noise_phrases": GATE_NOISE, "commercial": GATE_COMMERCIAL, "editorial": ("licensed under",), "legal": LEGAL_TERMS, "political": GATE_POLITICAL, "strong": GATE_STRONG, "gazette_ids": ("s2",), "country_signals": COUNTRY_SIGNALS, "rules": CATEGORY_RULES}


def _refreshed(spark, sf):
    gates = _GATES
    scans = registry(spark).select(F.col("name").alias("source"), F.when(F.col("id").isin("s3", "s8"), F.concat(F.lit("timeout of "), "name")).alias("error"))
    known = registry(spark).withColumn("ingestion_method", F.when(F.col("id") == "s5", "manual").otherwise(F.col("source_type")))
    entries = _entries(spark, sf)
    accepted = refresh.accepted_items(refresh.of_fetched(entries, known), known, **gates)
    stored = dedup.keep_first(accepted.filter("seq % 2 = 0"), "fingerprint", "seq").drop("seq").withColumns({"first_seen_at": F.lit("2024-01-01").cast("timestamp"), "last_seen_at": F.lit("2024-01-01").cast("timestamp")})
    return refresh.refresh(entries, scans, known, stored, now(), **gates)


def refresh_counts(spark, sf):
    """One ingestion: sources, items seen, inserted, updated, failed scans."""
    return _refreshed(spark, sf)[2]


def refresh_runs(spark, sf):
    return _refreshed(spark, sf)[1].drop("fetched_at")


def _ai_refreshed(spark, sf):
    """Items of the AI sources as feeds and as pages of articles, read back and ingested."""
    own = ai_registry(spark)
    rows = items(spark, sf).join(F.broadcast(own.select(F.col("name").alias("source"), F.col("id").alias("source_id"), "ingestion_method")), "source")
    rows = rows.filter(F.length(text.clean_text(F.col("title"))) >= 8)
    shown = lambda c: text.escape_html(F.col(c))
    article = F.concat(F.lit('<article><h2><a href="'), shown("link"), F.lit('">'), shown("title"), F.lit('</a></h2><time datetime="'), F.date_format("first_seen_at", "yyyy-MM-dd"), F.lit('"></time><p>'), shown("summary"), F.lit("</p></article>"))
    pages = rows.filter("ingestion_method = 'scraper'").withColumn("page", F.floor(F.col("id") / 200)).groupBy("source_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", article.alias("a")))), lambda x: x["a"]), "").alias("html"))
    site = F.lit("https://news.example/")
    none = F.lit(None).cast("string")
    listing_pages = pages.select(F.struct("source_id", "page").alias("at"), "html")
    selectors = pages.select(F.struct("source_id", "page").alias("id"), site.alias("url"), F.lit("ai").alias("finder"), *[none.alias(c) for c in ("item_selector", "title_selector", "link_selector", "summary_selector", "date_selector")])
    scanned = scans.scan_pages(listing_pages.withColumnRenamed("at", "source_id"), selectors, most=None).select("source_id.source_id", "title", "summary", "date", "link", (F.col("source_id.page") * 100_000 + F.col("pos")).alias("seq"))
    fed = rows.filter("ingestion_method <> 'scraper'").select("source_id", "title", "summary", "date", "link", F.col("id").alias("seq"))
    entries = fed.unionByName(scanned)
    seen = ainews.ai_items(fed, own, terms=AI_TERMS, focused=AI_FOCUSED).filter("seq % 2 = 0 AND source_id = 'ai_src0'")
    stored = dedup.keep_first(seen, "fingerprint", "seq").select("fingerprint", "source_id", "source", "region", "source_type", "category", "tags", "title", "summary", "date", "link").withColumns({"first_seen_at": F.lit("2024-01-01").cast("timestamp"), "last_seen_at": F.lit("2024-01-01").cast("timestamp")})
    failures = own.select(F.col("id").alias("source_id"), F.when(F.col("id") == "ai_src3", "timeout").alias("error"))
    return ainews.refresh_ai(entries, failures, own, stored, now(), terms=AI_TERMS, focused=AI_FOCUSED)


def ai_refresh_counts(spark, sf):
    """One ingestion of AI news: sources scanned, items seen, inserted, updated, failed scans."""
    return _ai_refreshed(spark, sf)[2]


def ai_refresh_runs(spark, sf):
    return _ai_refreshed(spark, sf)[1].drop("fetched_at")


def ai_fetch_urls(spark, sf):
    """Where the items of AI sources would be fetched from: the feed's address where one is known, else the source's."""
    known = {"ai_src1": "https://ai1.example/feed.xml"}
    found = ainews.feed_urls(ai_registry(spark), known).select(F.col("name").alias("source"), "fetch_url")
    return items(spark, sf).join(found, "source").groupBy("source", "fetch_url").agg(F.count("*").alias("n"))


def refresh_capped(spark, sf):
    """Items that each source gives when it stops at 25 accepted ones."""
    known = registry(spark).withColumn("ingestion_method", F.col("source_type"))
    kept = refresh.accepted_items(_entries(spark, sf), known, most=25, **_GATES)
    return kept.groupBy("source").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


QUERIES = {
    f.__name__: f
    for f in (
        ai_items, ai_routing, sales_items, ai_route_counts, department_recipients, explained_routes, intake_cards, department_digest, digest_sentence, executive_summaries, dashboard_counts, digest_choice, selected_digest, issues_as_items, issues_as_digests,
        decoded_digests, rebuilt_digests, summary_payload, summary_inputs, fallback_contents, item_summaries, provider_texts, public_urls, part_labels, scan_ages, order_instants, gazette_titles, routing_rows, public_rows, refresh_counts,
        refresh_runs, refresh_capped, ai_refresh_counts, ai_refresh_runs, ai_fetch_urls,
    )
}

_ROUTED = (insight.ROUTED_SQL,)
_SCORES = (insight.ROUTED_SQL, insight.SCORES_SQL)
_SCORED = (*_SCORES, insight.SCORED_SQL)
_WHY = "(VALUES " + ", ".join(f"({quoted([d, t, why])})" for d, row in wordings.IMPLICATIONS.items() for t, why in row.items()) + ") w(department, topic, why)"
_ACTION = "CASE " + " ".join(f"WHEN department = '{d}'{f" AND urgency = '{u}'" if u else ''} THEN {quoted([v])}" for d, row in wordings.ACTIONS.items() for u, v in sorted(row.items(), reverse=True)) + f" ELSE {quoted([wordings.ACTION_OTHERWISE])} END"
_SHORT = "CASE department " + " ".join(f"WHEN '{d[0]}' THEN {quoted([d[2]])}" for d in lexicon.DEPARTMENTS) + " END"
_ISSUES_SQL = "issues AS (SELECT doc_id AS id, string_split(text, chr(10))[1] AS title, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'about ' || source END AS summary, CASE WHEN doc_id % 2 = 0 THEN 'published' END AS status, CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2024-01-01' END AS published_at, TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-02' AS updated_at FROM documents)"
_SQUEEZED = r"trim(regexp_replace({0}, '[\s ]+', ' ', 'g'))"
_TITLED = "array_to_string(list_transform(string_split(replace({0}, '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_AGO = "TIMESTAMP '2024-01-16'"
_PUBLIC = r"(regexp_matches({0}, '^https?://[^/?#]+') AND NOT regexp_matches({0}, '^https?://(?:[^/?#]*@)?(?:localhost|0\.0\.0\.0|[^/?#:]*\.local|\[::1\]|(?:10|127)\.\d+\.\d+\.\d+|169\.254\.\d+\.\d+|172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+|192\.168\.\d+\.\d+|224\.\d+\.\d+\.\d+)(?::\d*)?(?:[/?#]|$)'))"
_FIELD = "'{0}: ' || coalesce(nullif({1}, ''), '{2}') || chr(10)"
ACCEPTED_SQL = f"""told AS (SELECT *, low || ' ' || lower(link) AS t FROM gated WHERE outcome = 'accepted' AND source <> 'src5'),
placed AS (SELECT *, {_COUNTRY_SQL} AS found FROM (SELECT *, {', '.join(f'{sql} AS s{i}' for i, sql in enumerate(_COUNTRY_SCORES.values()))} FROM told)),
accepted AS (SELECT id, source, CASE WHEN r_country_detection THEN found ELSE r_country END || '|' || CASE WHEN tk <> '' THEN tk ELSE {URL_SQL} END AS fp FROM placed),
batch AS (SELECT DISTINCT fp FROM accepted WHERE source NOT IN ('src3', 'src8'))"""

AI_SEEN_SQL = f"""aiseen AS (SELECT source_id, id, sha256('{wordings.AI_GROUP}|' || source_id || '|' || CASE WHEN {KEY_SQL.format('title')} <> '' THEN {KEY_SQL.format('title')} ELSE link END) AS fp FROM (
  SELECT * FROM ai1 WHERE len(title) >= 8 AND method = 'rss' UNION ALL (SELECT * FROM ai1 WHERE len(title) >= 8 AND source_id = 'ai_src1' QUALIFY row_number() OVER (PARTITION BY id // 200, {KEY_SQL.format('title')} ORDER BY id) = 1))
  WHERE source_id IN ({quoted(AI_FOCUSED)}) OR {has_any("lower(title || ' ' || summary)", AI_TERMS)}),
aiheld AS (SELECT DISTINCT fp FROM aiseen WHERE source_id = 'ai_src0' AND id % 2 = 0), aibatch AS (SELECT DISTINCT fp FROM aiseen)"""

ORACLES = {
    "ai_route_counts": with_items("SELECT id, CAST(count(*) FILTER (routed AND (department <> 'sales' OR id LIKE '%2')) AS BIGINT) AS n_routes FROM aiscores GROUP BY id", AI_SQL, AI_ROUTED_SQL, insight.SCORES_SQL.replace("scores AS (", "aiscores AS (", 1).replace("FROM routed r", "FROM airouted r")),
    "department_recipients": with_items("SELECT t.source AS team, coalesce(r.category, 'Team ' || t.source) AS department, CASE WHEN r.name IS NULL THEN 'Team ' || t.source || ' Intelligence' ELSE r.name || ' desk' END AS group_name, t.source || CASE WHEN r.name IS NULL THEN '-intelligence' ELSE '' END || '@example.invalid' AS email, CASE WHEN r.name IS NULL THEN 'Email' ELSE 'Chat' END AS channel FROM (SELECT DISTINCT source FROM items) t LEFT JOIN registry r ON r.name = t.source AND r.official", REGISTRY_SQL),
    "refresh_capped": with_items("SELECT source, count(*) AS n, max(id) AS last FROM (SELECT source, id FROM gated WHERE outcome = 'accepted' QUALIFY row_number() OVER (PARTITION BY source ORDER BY id) <= 25) GROUP BY 1", REGISTRY_SQL, GATED_SQL),
    "ai_refresh_counts": with_items("SELECT CAST(3 AS BIGINT) AS sources, (SELECT count(*) FROM aiseen) AS seen, CAST(1 AS BIGINT) AS failed, count(*) FILTER (fp NOT IN (SELECT fp FROM aiheld)) AS inserted, count(*) FILTER (fp IN (SELECT fp FROM aiheld)) AS updated FROM aibatch", AI_SQL, AI_SEEN_SQL),
    "ai_refresh_runs": with_items("SELECT source_id, name AS source, CASE WHEN method IN ('manual', 'api') THEN 'idle' WHEN source_id = 'ai_src3' THEN 'error' ELSE 'ok' END AS status, (SELECT count(*) FROM aiseen s WHERE s.source_id = air.source_id) AS item_count, CASE WHEN source_id = 'ai_src3' THEN 'timeout' END AS error FROM air", AI_SQL, AI_SEEN_SQL),
    "ai_fetch_urls": with_items("SELECT source, CASE source_id WHEN 'ai_src1' THEN 'https://ai1.example/feed.xml' ELSE u END AS fetch_url, count(*) AS n FROM items JOIN air ON air.name = source GROUP BY 1, 2", AI_SQL),
    "refresh_counts": with_items(
        "SELECT CAST(20 AS BIGINT) AS sources, (SELECT count(*) FROM accepted WHERE source NOT IN ('src3', 'src8')) AS seen, CAST(2 AS BIGINT) AS failed, count(*) FILTER (fp NOT IN (SELECT fp FROM accepted WHERE id % 2 = 0)) AS inserted, count(*) FILTER (fp IN (SELECT fp FROM accepted WHERE id % 2 = 0)) AS updated FROM batch",
        REGISTRY_SQL, GATED_SQL, ACCEPTED_SQL,
    ),
    "refresh_runs": with_items(
        "SELECT r.id AS source_id, r.name AS source, CASE WHEN r.id = 's5' THEN 'idle' WHEN r.id IN ('s3', 's8') THEN 'error' ELSE 'ok' END AS status, CASE WHEN r.id IN ('s3', 's5', 's8') THEN 0 ELSE (SELECT count(*) FROM accepted a WHERE a.source = r.name) END AS item_count, CASE WHEN r.id IN ('s3', 's8') THEN 'timeout of ' || r.name END AS error FROM registry r",
        REGISTRY_SQL, GATED_SQL, ACCEPTED_SQL,
    ),
    "ai_items": with_items("SELECT id, source_id, region, ai_category AS category, array_to_string(tags, ',') AS tags, title, md5(summary) AS summary_md5, link, fingerprint FROM ai", AI_SQL),
    "ai_routing": with_items("SELECT id, topic, country, urgency, impact, status, source_url, concat_ws(',', regexp_replace(lower(topic), '[^a-z0-9]+', '_', 'g'), nullif(array_to_string(own_tags, ','), '')) AS tags FROM airouted", AI_SQL, AI_ROUTED_SQL),
    "sales_items": with_items("SELECT 'sales' AS reader, urgency, count(*) AS n, CAST(sum(impact) AS BIGINT) AS impact FROM airouted GROUP BY 2 UNION ALL SELECT 'without', urgency, count(*), CAST(sum(impact) AS BIGINT) FROM routed GROUP BY 2", AI_SQL, AI_ROUTED_SQL, *_ROUTED),
    "explained_routes": with_items(f"SELECT id, department, coalesce(why, {quoted([wordings.IMPLICATION_OTHERWISE])}) AS why, {_ACTION} AS action FROM scores JOIN routed USING (id) LEFT JOIN {_WHY} USING (department, topic)", *_SCORES),
    "intake_cards": with_items(f"SELECT id, coalesce(string_agg({_SHORT}, ', ' ORDER BY route_rank) FILTER (route_score >= 52), 'No route') AS departments, max({_SHORT}) FILTER (route_rank = 1) AS top_route, max(route_score) FILTER (route_rank = 1) AS top_score FROM scores GROUP BY id", *_SCORES),
    "department_digest": with_items(
        "SELECT 'Weekly Legal Intelligence Briefing - Editorial' AS subject, string_agg(CAST(id AS VARCHAR), ',' ORDER BY k) AS ids, count(*) || ' priority signals for Editorial, led by ' || (SELECT string_agg(topic, ', ' ORDER BY f) FROM (SELECT topic, min(k) AS f FROM best GROUP BY 1 ORDER BY 2 LIMIT 3)) || '. Highest urgency items should be reviewed before external or leadership distribution.' AS summary FROM best",
        *_SCORES, "best AS (SELECT id, topic, row_number() OVER (ORDER BY route_score DESC, impact DESC, id) AS k FROM scores JOIN routed USING (id) WHERE department = 'editorial' AND route_score >= 52 QUALIFY k <= 9)",
    ),
    "digest_sentence": with_items(
        "SELECT count(*) || ' selected weekly executive digest signal' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || ' for Legislation Team, led by ' || (SELECT string_agg(topic, ', ' ORDER BY p) FROM (SELECT topic, min(rank) AS p FROM chosen GROUP BY 1 ORDER BY p LIMIT 3)) || '. ' || count(*) FILTER (urgency IN ('ACTION REQUIRED', 'STRATEGIC')) || ' high-priority item' || CASE WHEN count(*) FILTER (urgency IN ('ACTION REQUIRED', 'STRATEGIC')) = 1 THEN '' ELSE 's' END || ' should be reviewed before wider distribution.' AS sentence FROM chosen",
        *_SCORED, insight.DIGEST_SQL,
    ),
    "executive_summaries": with_items(
        rf"""SELECT id, CASE WHEN len(r) <= 185 THEN r ELSE regexp_replace(substr(r, 1, 182), '\s+\S*$', '') || '...' END AS text FROM (SELECT id, CASE WHEN o <> '' AND o <> title THEN o ELSE source || ' reported a ' || lower(topic) || ' development in ' || country || '.' END AS r
  FROM (SELECT *, {_SQUEEZED.format("coalesce(nullif(CASE WHEN id % 3 > 0 THEN summary END, ''), title, '')")} AS o FROM routed))""", *_ROUTED,
    ),
    "dashboard_counts": with_items(f"SELECT (SELECT count(*) FROM scored_items) AS items, count(*) AS signals, CAST(coalesce(sum(n_routes) FILTER (CAST(date AS TIMESTAMP) >= {NOW_SQL} - INTERVAL 7 DAY), 0) AS BIGINT) AS routed_this_week, (SELECT count(*) FROM scored_items) - count(*) AS suppressed FROM scored_items WHERE signal_score >= 60", *_SCORED),
    "digest_choice": with_items("SELECT id, country FROM routed WHERE id % 2 = 0 AND country IN (" + quoted(CHOSEN) + ") AND topic = 'API/Data Licensing'", *_ROUTED),
    "selected_digest": with_items(
        "SELECT id, CAST(-id AS INTEGER) AS pos, 'selected' AS how FROM (SELECT id FROM cand WHERE id % 97 = 5 ORDER BY -id LIMIT 5) UNION ALL SELECT id, CAST(turn AS INTEGER), 'balanced' FROM (SELECT id, row_number() OVER (PARTITION BY country ORDER BY id) AS turn FROM cand ORDER BY turn, id LIMIT 12)",
        *_ROUTED, "cand AS (SELECT id, country FROM routed WHERE urgency = 'ACTION REQUIRED')",
    ),
    "issues_as_items": f"WITH {_ISSUES_SQL} SELECT 'newsletter-' || id AS id, 'APAC' AS country, 'Published Newsletter' AS source_tab, title, CASE WHEN summary <> '' THEN summary ELSE 'body' END AS summary, coalesce(published_at, updated_at) AS date, coalesce(published_at, created_at) AS first_seen_at, false AS is_new FROM issues",
    "issues_as_digests": f"WITH {_ISSUES_SQL} SELECT 'newsletter-' || id AS digest_id, title, coalesce(status, 'published') AS status, 0 AS item_count, 'APAC Legal Updates' AS department, 'Weekly Digest' AS digest_type, 0 AS entries FROM issues",
    "decoded_digests": "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN doc_id || ',2' ELSE '' END AS entries FROM documents",
    "rebuilt_digests": f"WITH {_ISSUES_SQL} SELECT id, CASE WHEN id % 3 = 1 THEN 'New: ' || title ELSE title END AS title, created_at FROM issues",
    "summary_payload": with_items(
        f"""SELECT c.id AS item_id, CASE WHEN rank % 3 = 2 THEN c.link ELSE coalesce(a.url, b.url, '#') END AS link, CASE WHEN rank % 3 = 2 THEN c.source ELSE coalesce(a.name, b.name, c.source) END AS source, c.country AS jurisdiction
FROM chosen c LEFT JOIN (SELECT name, min_by(url, id) AS url FROM registry GROUP BY 1) a ON a.name = c.source LEFT JOIN (SELECT country, min_by(url, id) AS url, min_by(name, id) AS name FROM registry GROUP BY 1) b ON b.country = c.country
WHERE rank % 3 <> 1 AND (rank % 3 = 2 OR a.url IS NOT NULL OR b.url IS NOT NULL)""", *_SCORED, insight.DIGEST_SQL, REGISTRY_SQL,
    ),
    "summary_inputs": with_items(
        "SELECT id, md5(" + " || ".join([_FIELD.format("Title", _CUT.format("c", 220, 219), "Selected legal update"), _FIELD.format("Source", "source", "Unknown source"), _FIELD.format("Jurisdiction", "country", "Unknown"), _FIELD.format("Category", "CASE WHEN id % 2 = 0 THEN category END", "Unknown")]) + f" || 'URL: ' || link || chr(10) || chr(10) || 'Source content:' || chr(10) || summary) AS input_md5 FROM (SELECT *, {_CLEAN.format('title')} AS c FROM items)"
    ),
    "fallback_contents": with_items(f"SELECT id, md5(CASE WHEN len(c) >= 45 AND NOT regexp_matches(lower(c), '{'|'.join(wordings.PARAGRAPH_BOILERPLATE)}') THEN trim(regexp_replace(c, '{text.SPACE}', ' ', 'g')) ELSE '' END) AS text_md5 FROM (SELECT id, concat_ws(' ', nullif({_CUT.format('c0', 260, 259)}, ''), nullif({_CUT.format('c1', 1400, 1399)}, '')) AS c FROM (SELECT id, {_CLEAN.format('title')} AS c0, {_CLEAN.format("CASE WHEN id % 3 > 0 THEN summary ELSE '' END")} AS c1 FROM items))"),
    "provider_texts": f"SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN {_CLEAN.format('string_split(text, chr(10))[1]')} WHEN doc_id % 3 = 1 THEN source || ' and ' || lang ELSE '' END) AS text_md5 FROM documents",
    "public_urls": f"SELECT page_id, {_PUBLIC.format('url')} AS own, {_PUBLIC.format('made')} AS made FROM (SELECT page_id, url, CASE WHEN page_id % 7 = 6 THEN 'ftp' ELSE 'http' END || '://' || ['localhost', '10.1.2.3', '127.0.0.1:80', '172.20.0.1', '172.40.0.1', '192.168.9.9', 'printer.local', '8.8.8.8', '[::1]', '169.254.1.1', '224.0.0.1', 'user@0.0.0.0'][page_id % 12 + 1] || '/x' AS made FROM pages)",
    "part_labels": f"SELECT p_partkey, {_TITLED.format('s')} AS topic, ['APAC', 'EU', 'mars', 'US'][p_size % 4 + 1] AS region, {_TITLED.format('s')} || ' / News Site' AS kind, 'Last 30 days' AS range FROM (SELECT *, lower(replace(p_type, ' ', '_')) AS s FROM part)",
    "scan_ages": f"WITH {RUNS_SQL} SELECT id, CASE WHEN seen IS NULL THEN 'No scan yet' WHEN m < 60 THEN m || 'm ago' WHEN h < 48 THEN h || 'h ago' ELSE strftime(seen, '%d %b %Y') END AS ago, coalesce(strftime(seen, '%d %b %Y'), 'Date pending') AS day FROM (SELECT *, CAST(floor(m / 60.0 + 0.5) AS BIGINT) AS h FROM (SELECT *, CAST(greatest(1, floor((floor(epoch({_AGO})) - floor(epoch(seen))) / 60.0 + 0.5)) AS BIGINT) AS m FROM (SELECT id, CASE WHEN id % 5 > 0 THEN fetched_at END AS seen FROM runs)))",
    "order_instants": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN date_trunc('second', o_orderdate) WHEN 1 THEN date_trunc('second', o_orderdate) - INTERVAL 2 HOUR WHEN 2 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS at FROM orders",
    "gazette_titles": "SELECT p_partkey, p_name || ' ' || p_brand AS title FROM part",
    "routing_rows": with_items("SELECT id FROM items WHERE category IN ('Legislation News', 'Recent Judgments', 'Legal News') QUALIFY row_number() OVER (PARTITION BY category ORDER BY date DESC NULLS LAST, first_seen_at DESC, id) <= 100 UNION SELECT id FROM (SELECT id FROM items ORDER BY date DESC NULLS LAST, first_seen_at DESC, id LIMIT 200)"),
    "public_rows": with_items("SELECT country, count(*) AS n, false AS public FROM items GROUP BY 1"),
    "item_summaries": with_items("SELECT id, CASE WHEN id % 7 = 0 THEN 'error' WHEN s = '' THEN 'error' WHEN len(s) % 3 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN id % 7 = 0 OR s = '' OR len(s) % 3 = 0 THEN '' ELSE substr(s, 1, 20) || '!' END AS text, CASE WHEN id % 7 = 0 THEN 'Only public http(s) source URLs can be summarized.' WHEN s = '' THEN 'nothing to summarise' WHEN len(s) % 3 = 0 THEN 'length ' || len(s) END AS error FROM (SELECT id, coalesce(CASE WHEN id % 5 > 0 THEN title END, CASE WHEN id % 2 = 0 THEN summary END, '') AS s FROM items)"),
}
