"""Catalogue queries on items: listings, statistics, text keys, gates, classification, merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import lexicon
from quillspark.functions.text import canonical_url, fingerprint
from quillspark.operators import classify, dedup, gates, listing, merge, pages, search_index, stats
from quillspark.plans.sqlparts import KEY_SQL, NOW_SQL, URL_SQL, has_any, has_term, quoted, with_items
from quillspark.session import scratch
from quillspark.sources.items import REGISTRY_SQL, RUNS_SQL, items, now, read, registry, runs
from quillspark.streaming.runs import latest_runs_state
from quillspark.streaming.store import ItemStore

# Terms that the driver's invented prose does hold; defaults stay with the operators.
HIDDEN_SOURCES = ("src3", "src11")
CATEGORY_RULES = (("Legislation News", ("license", "licensed")), ("Policy/Regulatory News", ("ai", "und")), ("Case Summary", ("mit", "apache")), ("Press Release/Judiciary Updates", ("reserved", "que")))
COUNTRY_SIGNALS = {"Malaysia": ("ai", "en"), "Singapore": ("the", "license"), "Hong Kong": ("und", "der"), "Australia": ("que", "de"), "New Zealand": ("st",), "India": ("of", "mit")}
LEGAL_TERMS, POLICY_TERMS, TAGS = ("the", "und", "que", "ai"), ("ai", "license"), ("ai", "the", "license", "und", "que")
POLITICAL_RULE = {"source": "src4", "category": "Legal News", "actors": ("%ai%", "%mit%"), "places": ("%the %", "%und %")}
EDITORIAL_RULE = {"tab": "News Sources", "titles": ("%the.", "%en."), "summaries": ("%licensed under%",)}
GATE_NOISE, GATE_COMMERCIAL, GATE_POLITICAL, GATE_STRONG = ("all rights reserved",), ("mit license",), ("nd", "der"), ("st", "ein", "in")


def visible_items(spark: SparkSession, sf: str) -> DataFrame:
    return listing.visible(items(spark, sf), retired=listing.retired_rule(HIDDEN_SOURCES), editorial=listing.editorial_rule(EDITORIAL_RULE))


VISIBLE_SQL = """visible AS (SELECT * FROM items WHERE source NOT IN ('src3', 'src11')
  AND NOT ((title ILIKE '%the.' OR title ILIKE '%en.' OR summary ILIKE '%licensed under%') AND source_tab = 'News Sources'))"""


def list_items(spark, sf):
    page = listing.list_items(visible_items(spark, sf), now(), category="Legal News", q="the", limit=500, offset=5)
    return page.select("id", "country", "source", "title", "date", "first_seen_at", "is_new")


#: Searches: words, a phrase over a line break, two characters, one, wildcards, an escaped one, none, everything.
SEARCHES = ("license", " the ", "src7", "qu", "x", "t_e %ed", "100\\%", "nowhere to be found", "%")


def searched_items(spark, sf):
    """What each search finds, by way of the trigram index of all items."""
    rows, root = items(spark, sf), scratch(spark, "trigrams")
    search_index.build_index(rows, root)
    found = [search_index.search(rows, root, q).select(F.lit(q).alias("q"), "id") for q in SEARCHES]
    return reduce(DataFrame.unionByName, found)


def deep_page(spark, sf):
    """A page far down the listing of all items, read from the range that it lies in."""
    root = scratch(spark, "ranges")
    pages.write_ranges(items(spark, sf), root, range_rows=64)
    return pages.page(spark, root, limit=40, offset=150).select("id", "date", "first_seen_at")


COUNTRIES = ("Singapore", "Hong Kong", "India", "Singapore")


def listing_by_country(spark, sf):
    """The first pages of three countries, one after the other."""
    return listing.pages_by(visible_items(spark, sf), "country", COUNTRIES, limit=100).select("place", "country", "id")


def merged_listing(spark, sf):
    """The same pages as one listing, the first 150 of it."""
    return listing.merged_pages(listing.pages_by(visible_items(spark, sf), "country", COUNTRIES, limit=100)).select("id", "country", "date").limit(150)


def list_tagged_items(spark, sf):
    low = F.lower("summary")
    tagged = items(spark, sf).withColumn("tags", F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in TAGS]))).withColumn("region", F.col("country"))
    return listing.list_tagged(tagged, region="Singapore", tag="ai", q="en", limit=60).select("id", "region", "category", F.array_join("tags", ",").alias("tags"))


def hidden_by_rule(spark, sf):
    rules = {"retired": listing.retired_rule(HIDDEN_SOURCES), "editorial": listing.editorial_rule(EDITORIAL_RULE), "gazette": listing.gazette_rule("src2", titles=("the%", "in %"), summaries=("%reserved%",)), "political": listing.political_rule(POLITICAL_RULE)}
    return items(spark, sf).agg(*[F.count_if(~F.coalesce(r, F.lit(False))).alias(k) for k, r in rules.items()])


def stats_by_country(spark, sf):
    return visible_items(spark, sf).groupBy("country").agg(F.count("*").alias("n"), F.count_if(F.col("first_seen_at") >= now() - F.expr("INTERVAL 24 HOURS")).alias("n_new"))


def stats_grouping_sets(spark, sf):
    return stats.grouped_counts(visible_items(spark, sf))


def stats_overview(spark, sf):
    one = stats.overview(visible_items(spark, sf), runs(spark, sf), now())
    listed = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return one.select("total", "new_24h", "last_scan", listed("by_country").alias("by_country"), listed("by_category").alias("by_category"))


def latest_run_per_source(spark, sf):
    return stats.latest_runs(runs(spark, sf)).select("source_id", "id", "status", "fetched_at")


def run_health(spark, sf):
    return stats.run_health(runs(spark, sf), registry(spark), visible_items(spark, sf)).select("source_id", "name", "access_basis", "status", "item_count", "error")


def run_messages(spark, sf):
    """Errors of sources whose messages are blank: the class of the error stands for it."""
    blank = runs(spark, sf).withColumns({"status": F.lit("error"), "error": F.when(F.col("id") % 2 == 0, "  ").otherwise(F.col("error")), "error_type": F.when(F.col("id") % 4 == 0, "TimeoutError")})
    return stats.run_health(blank, registry(spark), visible_items(spark, sf).limit(0)).select("source_id", "error")


def country_mix(spark, sf):
    return stats.share_of_top(visible_items(spark, sf), "country")


def category_facets(spark, sf):
    return stats.facet_values(visible_items(spark, sf), "category", lexicon.CATEGORIES[:3])


def canonical_urls(spark, sf):
    return read(spark, sf, "pages").select("page_id", canonical_url(F.col("url")).alias("url"))


def fingerprint_dedup(spark, sf):
    rows = items(spark, sf).withColumn("fingerprint", fingerprint(F.col("country"), F.col("title"), F.col("link")))
    return dedup.keep_last(rows, "fingerprint", "id").select("id", "fingerprint")


def first_per_title(spark, sf):
    rows = items(spark, sf).withColumn("key", F.lower("title"))
    return dedup.keep_first(rows, "key", "id").select("id")


def capped_per_source(spark, sf):
    return dedup.cap_per(visible_items(spark, sf), "source", 25, "id").groupBy("source").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


def _gated(spark, sf):
    joined = classify.with_registry(items(spark, sf), registry(spark))
    return gates.gate_items(joined, noise_phrases=GATE_NOISE, commercial=GATE_COMMERCIAL, editorial=("licensed under",), legal=LEGAL_TERMS, political=GATE_POLITICAL, strong=GATE_STRONG, gazette_ids=("s2",), country_signals=COUNTRY_SIGNALS, rules=CATEGORY_RULES)


def gate_reasons(spark, sf):
    return _gated(spark, sf).select("id", F.coalesce("reject_reason", F.lit("accepted")).alias("outcome"))


def classify_category(spark, sf):
    joined = classify.with_registry(items(spark, sf), registry(spark))
    return joined.select("id", classify.detect_category(F.coalesce("r_category", "category"), F.col("r_force_category"), F.col("title"), F.col("summary"), CATEGORY_RULES).alias("category"))


def stored_categories(spark, sf):
    old = F.when(F.col("id") % 5 == 0, "Court News").when(F.col("id") % 5 == 1, "Profession").when(F.col("id") % 5 == 2, "Unheard of").otherwise(F.col("category"))
    return items(spark, sf).select("id", classify.stored_category(old, F.col("title"), F.col("summary"), POLICY_TERMS).alias("category"))


def detect_country(spark, sf):
    return items(spark, sf).select("id", classify.detect_country(F.concat_ws(" ", "title", "summary"), COUNTRY_SIGNALS).alias("country"))


def ai_gate(spark, sf):
    return gates.ai_gate(items(spark, sf), ("ai", "mit"), ("src1",)).select("id")


def _store(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The first two thirds of the items by id as stored, the last two thirds as a batch with some fields blank."""
    rows = items(spark, sf).withColumn("fingerprint", F.sha2(F.concat_ws("|", "country", (F.col("id") % 700).cast("string")).cast("binary"), 256))
    stored = dedup.keep_first(rows.filter("id % 3 < 2"), "fingerprint", "id").withColumn("last_seen_at", F.col("first_seen_at"))
    batch = rows.filter("id % 3 > 0").withColumns({"summary": F.when(F.col("id") % 4 == 0, "").otherwise(F.col("summary")), "seq": F.col("id")})
    return stored.select("fingerprint", "country", "title", "summary", "category", "source_tab", "date", "link", "first_seen_at", "last_seen_at"), batch.drop("first_seen_at", "id")


def merge_updates(spark, sf):
    merged = merge.merge_items(*_store(spark, sf), now())
    return merged.select("fingerprint", "title", F.md5("summary").alias("summary_md5"), "category", "source_tab", "date", "first_seen_at", "last_seen_at", "action")


def _as_store(spark, stored: DataFrame) -> ItemStore:
    store = ItemStore(spark, scratch(spark, "store"), stored.schema, bucket_rows=500)
    store.create(stored)
    return store


def stored_merge(spark, sf):
    """The merge in a bucketed store, which exchanges the batch alone."""
    stored, batch = _store(spark, sf)
    store = _as_store(spark, stored)
    store.merge(batch, now())
    return store.read().select("fingerprint", "title", F.md5("summary").alias("summary_md5"), "category", "source_tab", "date", "first_seen_at", "last_seen_at")


def stored_delta(spark, sf):
    """The same batch appended to the store as a delta and folded in as it is read."""
    stored, batch = _store(spark, sf)
    store = _as_store(spark, stored)
    store.append(batch, now())
    return store.read().select("fingerprint", "title", F.md5("summary").alias("summary_md5"), "category", "source_tab", "date", "first_seen_at", "last_seen_at")


def run_states(spark, sf):
    """The state that a stream of all runs ends with: latest runs, first seen, runs, and whether a source is stale."""
    return latest_runs_state(runs(spark, sf), now(), stale_after_hours=12)


def merge_summary(spark, sf):
    return merge.merge_counts(merge.merge_items(*_store(spark, sf), now()))


def _issues(spark, sf, part: str, months: int = 0) -> DataFrame:
    """A part of the documents as issues: the stored ones are two thirds of all, as are the new ones."""
    d, n = read(spark, sf, "documents").filter(part), F.col("doc_id")
    status = F.when((n + months) % 3 == 0, "draft").otherwise("published")
    start = F.add_months(F.lit("2024-01-01").cast("date"), months).cast("timestamp")
    at = F.when(n % 2 == 0, start + F.make_dt_interval(hours=n.cast("int")))
    created = start + F.make_dt_interval(hours=(n % 997).cast("int"))
    return d.select(n.alias("id"), F.substring_index("text", "\n", 1).alias("title"), status.alias("status"), at.alias("published_at"), created.alias("created_at"), F.lit("2024-01-02 00:00:00").cast("timestamp").alias("updated_at"))


STORED, NEW = "doc_id % 3 < 2", "doc_id % 3 > 0"


def published_issues(spark, sf):
    merged = merge.upsert_issues(_issues(spark, sf, STORED), _issues(spark, sf, NEW, 1), now())
    return listing.published(merged, 100)


def upserted_issues(spark, sf):
    """All issues after the batch, with their dates."""
    return merge.upsert_issues(_issues(spark, sf, STORED), _issues(spark, sf, NEW, 1), now())


def upserted_digests(spark, sf):
    """Weekly digests: their item count is the number of entries where none is given."""
    e = F.transform(F.sequence(F.lit(1), (F.col("id") % 5).cast("int") + 1), lambda k: F.struct(k.alias("item")))
    with_entries = lambda df: df.withColumns({"entries": e, "item_count": F.when(F.col("id") % 4 == 0, 99)})
    return merge.upsert_issues(with_entries(_issues(spark, sf, STORED)), with_entries(_issues(spark, sf, NEW, 1)), now()).select("id", "status", "item_count", "created_at")


def deleted_issues(spark, sf):
    kept = merge.delete_by_key(_issues(spark, sf, STORED), _issues(spark, sf, NEW), "id")
    return kept.agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def public_stats(spark, sf):
    return stats.public_stats(_issues(spark, sf, STORED))


def found_issues(spark, sf):
    """Issues that a search finds in their titles."""
    return listing.search_issues(_issues(spark, sf, STORED), "the").select("id")


def official_sources(spark, sf):
    return stats.official_sources(items(spark, sf), registry(spark))


def merge_tagged(spark, sf):
    """The merge of tagged items, which also overwrites region and tags."""
    tag = lambda df: df.withColumns({"region": F.concat(F.lit("r"), F.length("title").cast("string")), "tags": F.array("category")})
    stored, batch = _store(spark, sf)
    batch = batch.withColumn("title", F.concat("title", F.lit("!")))
    merged = merge.merge_items(tag(stored), tag(batch), now(), overwrite=("source_tab", "category", "region", "tags"))
    return merged.select("fingerprint", "region", F.array_join("tags", ",").alias("tags"), "title", "action")


def migrated_items(spark, sf):
    old = items(spark, sf).withColumns({"category": F.when(F.col("id") % 2 == 0, "Judgment").otherwise("Court News/Legal News"), "source_tab": F.lit(None).cast("string"), "fingerprint": F.sha2((F.col("id") % 400).cast("string").cast("binary"), 256)})
    return merge.migrate_items(old, registry(spark)).select("id", "category", "source_tab", "fingerprint")


def issue_history(spark, sf):
    return merge.bounded_history(_issues(spark, sf, STORED), _issues(spark, sf, NEW, 1)).select("id", "created_at")


def run_log(spark, sf):
    r = runs(spark, sf).select("source_id", "status", "error")
    log = merge.append_runs(r.limit(0), r)
    return log.groupBy("source_id", "status").agg(F.count("*").alias("n"), F.max(F.length("error")).alias("longest"))


def weekly_velocity(spark, sf):
    weekly = runs(spark, sf).groupBy("source_id", F.date_trunc("week", "fetched_at").alias("week")).agg(F.count("*").alias("n"))
    return weekly.withColumn("delta", F.col("n") - F.lag("n").over(Window.partitionBy("source_id").orderBy("week")))


QUERIES = {
    f.__name__: f
    for f in (
        list_items, list_tagged_items, hidden_by_rule, stats_by_country, stats_grouping_sets, stats_overview, latest_run_per_source, run_health, run_messages, country_mix, category_facets, canonical_urls, fingerprint_dedup,
        searched_items, deep_page, listing_by_country, merged_listing, first_per_title, capped_per_source, gate_reasons, classify_category, stored_categories, detect_country, ai_gate, merge_updates, stored_merge, stored_delta, run_states, merge_summary, merge_tagged, published_issues, upserted_issues, upserted_digests, found_issues, public_stats, official_sources, deleted_issues, migrated_items, issue_history,
        run_log, weekly_velocity,
    )
}


def _rules_sql(text: str, rules) -> str:
    return "\n".join(f"WHEN {has_any(text, terms)} THEN '{name}'" for name, terms in rules)


_SCORES = {c: " + ".join(f"CASE WHEN {has_term('t', s)} THEN {3 if s == c.lower() else 1} ELSE 0 END" for s in terms) for c, terms in COUNTRY_SIGNALS.items()}
_COUNTRY_SQL = "CASE " + " ".join(f"WHEN s{i} > 0 AND s{i} = greatest({', '.join(f's{k}' for k in range(6))}) THEN '{c}'" for i, c in enumerate(COUNTRY_SIGNALS)) + " END"
_CLEAN = r"trim(regexp_replace({0}, '[\s]+', ' ', 'g'), ' ' || chr(9) || chr(13) || chr(10) || '-•|')"
_CUT = "CASE WHEN len({0}) > {1} THEN rtrim(substr({0}, 1, {2})) || '...' ELSE {0} END"
_STORE_SQL = """rows AS (SELECT *, sha256(country || '|' || (id % 700)) AS fingerprint FROM items),
stored AS (SELECT *, first_seen_at AS last_seen_at FROM rows WHERE id % 3 < 2 QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY id) = 1),
batch AS (SELECT * REPLACE (CASE WHEN id % 4 = 0 THEN '' ELSE summary END AS summary) FROM rows WHERE id % 3 > 0 QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY id DESC) = 1),
merged AS (
  SELECT coalesce(o.fingerprint, n.fingerprint) AS fingerprint, coalesce(o.title, n.title) AS title,
    CASE WHEN o.id IS NULL THEN n.summary WHEN n.id IS NULL OR n.summary = '' THEN o.summary ELSE n.summary END AS summary,
    CASE WHEN n.id IS NULL THEN o.category ELSE n.category END AS category, CASE WHEN n.id IS NULL THEN o.source_tab ELSE n.source_tab END AS source_tab,
    coalesce(n.date, o.date) AS date, CASE WHEN o.id IS NULL THEN {now} ELSE o.first_seen_at END AS first_seen_at, CASE WHEN n.id IS NULL THEN o.last_seen_at ELSE {now} END AS last_seen_at,
    CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'kept' ELSE 'updated' END AS action
  FROM stored o FULL JOIN batch n ON o.fingerprint = n.fingerprint)""".replace("{now}", NOW_SQL)
_ISSUE = """SELECT doc_id AS id, string_split(text, chr(10))[1] AS title, CASE WHEN (doc_id + {1}) % 3 = 0 THEN 'draft' ELSE 'published' END AS status,
  CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2024-0{2}-01' + to_hours(doc_id) END AS published_at, TIMESTAMP '2024-0{2}-01' + to_hours(doc_id % 997) AS created_at, TIMESTAMP '2024-01-02' AS updated_at
  FROM documents WHERE {0}"""
_OLD, _NEW = _ISSUE.format(STORED, 0, 1), _ISSUE.format(NEW, 1, 2)
_UPSERTED = f"""o AS ({_OLD}), n AS ({_NEW}),
m AS (SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.title ELSE n.title END AS title, CASE WHEN n.id IS NULL THEN o.status ELSE n.status END AS status,
  CASE WHEN n.id IS NULL THEN o.published_at ELSE coalesce(n.published_at, CASE WHEN n.status = 'published' THEN {NOW_SQL} END) END AS published_at, coalesce(o.created_at, {NOW_SQL}) AS created_at, CASE WHEN n.id IS NULL THEN o.updated_at ELSE {NOW_SQL} END AS updated_at
  FROM o FULL JOIN n ON o.id = n.id)"""
_POLICY = f"CASE WHEN c = 'Legal News' AND {{0}} THEN 'Policy/Regulatory News' ELSE c END"

GATED_SQL = f"""gated AS (SELECT *, CASE WHEN len(ct) < 8 THEN 'short title' WHEN tk IN ({quoted(lexicon.NOISE_TITLES)}) THEN 'noise title'
  WHEN contains(tk, 'all rights reserved') OR contains(sk, 'all rights reserved') THEN 'noise phrase'
  WHEN starts_with(tk, 'adv ') OR starts_with(tk, 'advertisement ') OR contains(tk || ' ' || sk, 'mit license') THEN 'commercial'
  WHEN tk LIKE '% opinion' OR tk LIKE '% forum' OR contains(tk || ' ' || sk, 'licensed under') THEN 'editorial'
  WHEN r_require_date AND date IS NULL THEN 'no date'
  WHEN len(r_required_terms) > 0 AND NOT {has_any('low', ('the', 'der'))} THEN 'required terms'
  WHEN len(r_excluded_terms) > 0 AND {has_any('low', ('license',))} THEN 'excluded terms'
  WHEN NOT coalesce(r_include_all, false) AND NOT ({has_any('low', LEGAL_TERMS)} AND NOT ({has_any('low', GATE_POLITICAL)} AND NOT {has_any('low', GATE_STRONG)}) AND (NOT {has_any('low', lexicon.ENFORCEMENT_TERMS)} OR {has_any('low', lexicon.COURT_CONTEXT_TERMS)})) THEN 'not legal'
  WHEN r_country_detection AND NOT {has_any("low || ' ' || lower(link)", [t for ts in COUNTRY_SIGNALS.values() for t in ts])} THEN 'no country' ELSE 'accepted' END AS outcome
FROM (SELECT *, {KEY_SQL.format('ct')} AS tk, {KEY_SQL.format('cs')} AS sk, lower(ct || ' ' || cs) AS low FROM (
  SELECT i.*, {_CUT.format('c1', 260, 259)} AS ct, {_CUT.format('c2', 520, 519)} AS cs FROM (
    SELECT i.*, {_CLEAN.format('i.title')} AS c1, {_CLEAN.format('i.summary')} AS c2, r.require_date AS r_require_date, r.required_terms AS r_required_terms, r.excluded_terms AS r_excluded_terms, r.include_all AS r_include_all, r.country_detection AS r_country_detection, r.country AS r_country
    FROM items i LEFT JOIN registry r ON r.name = i.source) i)))"""

_PAGES_SQL = f"""pages_by AS (SELECT *, row_number() OVER (ORDER BY turn, k) - 1 AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY country ORDER BY date DESC NULLS LAST, first_seen_at DESC, id) AS k, list_position([{quoted(COUNTRIES[:3])}], country) AS turn FROM visible WHERE country IN ({quoted(COUNTRIES)})) WHERE k <= 100)"""

ORACLES = {
    "searched_items": with_items(" UNION ALL ".join("SELECT {0} AS q, id FROM items WHERE title ILIKE {1} ESCAPE '\\' OR summary ILIKE {1} ESCAPE '\\' OR source ILIKE {1} ESCAPE '\\'".format(quoted([q]), quoted([f"%{q}%"])) for q in SEARCHES)),
    "deep_page": with_items("SELECT id, date, first_seen_at FROM items ORDER BY date DESC NULLS LAST, first_seen_at DESC, id LIMIT 40 OFFSET 150"),
    "listing_by_country": with_items("SELECT CAST(place AS INTEGER) AS place, country, id FROM pages_by", VISIBLE_SQL, _PAGES_SQL),
    "merged_listing": with_items("SELECT id, country, date FROM pages_by ORDER BY coalesce(CAST(date AS TIMESTAMP), first_seen_at) DESC, first_seen_at DESC, id LIMIT 150", VISIBLE_SQL, _PAGES_SQL),
    "list_items": with_items(f"SELECT id, country, source, title, date, first_seen_at, first_seen_at >= {NOW_SQL} - INTERVAL 24 HOUR AS is_new FROM visible WHERE category = 'Legal News' AND (title ILIKE '%the%' OR summary ILIKE '%the%' OR source ILIKE '%the%') ORDER BY date DESC NULLS LAST, first_seen_at DESC, id LIMIT 200 OFFSET 5", VISIBLE_SQL),
    "list_tagged_items": with_items(
        f"SELECT id, country AS region, category, array_to_string(tags, ',') AS tags FROM (SELECT *, list_filter({list(TAGS)}, lambda x: contains(lower(summary), x)) AS tags FROM items) WHERE country = 'Singapore' AND list_contains(tags, 'ai') AND concat_ws(' ', title, summary, source, category, array_to_string(tags, ' ')) ILIKE '%en%' ORDER BY date DESC NULLS LAST, first_seen_at DESC, id LIMIT 60"
    ),
    "hidden_by_rule": with_items(
        "SELECT count(*) FILTER (source IN ('src3', 'src11')) AS retired, count(*) FILTER (coalesce((title ILIKE '%the.' OR title ILIKE '%en.' OR summary ILIKE '%licensed under%') AND source_tab = 'News Sources', (title ILIKE '%the.' OR title ILIKE '%en.' OR summary ILIKE '%licensed under%'))) AS editorial, count(*) FILTER (source = 'src2' AND (title = 'Department of Publication' OR title ILIKE 'the%' OR title ILIKE 'in %' OR summary ILIKE '%reserved%')) AS gazette, count(*) FILTER (source = 'src4' AND category = 'Legal News' AND (title ILIKE '%ai%' OR title ILIKE '%mit%' OR summary ILIKE '%ai%' OR summary ILIKE '%mit%') AND (title ILIKE '%the %' OR title ILIKE '%und %' OR summary ILIKE '%the %' OR summary ILIKE '%und %')) AS political FROM items"
    ),
    "stats_by_country": with_items(f"SELECT country, count(*) AS n, count(*) FILTER (first_seen_at >= {NOW_SQL} - INTERVAL 24 HOUR) AS n_new FROM visible GROUP BY 1", VISIBLE_SQL),
    "stats_grouping_sets": with_items("SELECT CASE grouping(country, category) WHEN 3 THEN 'total' WHEN 1 THEN 'country' ELSE 'category' END AS kind, coalesce(country, category) AS name, count(*) AS n FROM visible GROUP BY GROUPING SETS ((), (country), (category))", VISIBLE_SQL),
    "stats_overview": with_items(f"SELECT count(*) AS total, count(*) FILTER (first_seen_at >= {NOW_SQL} - INTERVAL 24 HOUR) AS new_24h, (SELECT max(fetched_at) FROM runs) AS last_scan, (SELECT string_agg(k || ':' || n, ',' ORDER BY k) FROM (SELECT country AS k, count(*) AS n FROM visible GROUP BY 1)) AS by_country, (SELECT string_agg(k || ':' || n, ',' ORDER BY k) FROM (SELECT category AS k, count(*) AS n FROM visible GROUP BY 1)) AS by_category FROM visible", VISIBLE_SQL, RUNS_SQL),
    "latest_run_per_source": f"WITH {RUNS_SQL} SELECT source_id, id, status, fetched_at FROM runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY id DESC) = 1",
    "run_health": with_items(
        "SELECT l.source_id, r.name, CASE WHEN r.official THEN 'official' WHEN r.source_type = 'rss' THEN 'public feed' ELSE 'public page' END AS access_basis, CASE WHEN l.status = 'error' AND h.n > 0 THEN 'stale' ELSE l.status END AS status, CASE WHEN l.status = 'error' AND h.n > 0 THEN h.n ELSE l.item_count END AS item_count, CASE WHEN l.status = 'error' AND h.n > 0 THEN 'Showing stored items. Last error: ' || substr(coalesce(nullif(trim(l.error), ''), 'Error'), 1, 600) WHEN l.status = 'error' THEN substr(coalesce(nullif(trim(l.error), ''), 'Error'), 1, 700) END AS error FROM (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY id DESC) = 1) l JOIN registry r ON r.id = l.source_id LEFT JOIN (SELECT source, count(*) AS n FROM visible GROUP BY 1) h ON h.source = r.name",
        VISIBLE_SQL, RUNS_SQL, REGISTRY_SQL,
    ),
    "run_messages": f"WITH {RUNS_SQL}, {REGISTRY_SQL} SELECT source_id, substr(coalesce(nullif(trim(CASE WHEN id % 2 = 0 THEN '  ' ELSE error END), ''), CASE WHEN id % 4 = 0 THEN 'TimeoutError' END, 'Error'), 1, 700) AS error FROM runs WHERE source_id IN (SELECT id FROM registry) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY id DESC) = 1",
    "country_mix": with_items("SELECT country, count(*) AS n, CAST(greatest(8, floor(count(*) * 100 / max(count(*)) OVER () + 0.5)) AS INTEGER) AS width FROM visible GROUP BY 1", VISIBLE_SQL),
    "category_facets": with_items(f"SELECT value, CAST(coalesce(list_position([{quoted(lexicon.CATEGORIES[:3])}], value), 4) AS INTEGER) AS rank FROM (SELECT DISTINCT category AS value FROM visible)", VISIBLE_SQL),
    "canonical_urls": r"""SELECT page_id, s || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url FROM (
  SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS h,
    regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#;]*)', 1), '/+$', '') AS p,
    array_to_string(list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND string_split(x, '=')[1] NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid')), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') AS q
  FROM pages)""",
    "fingerprint_dedup": with_items("SELECT id, fingerprint FROM (SELECT id, sha256(country || '|' || CASE WHEN k <> '' THEN k ELSE " + URL_SQL + " END) AS fingerprint FROM (SELECT *, " + KEY_SQL.format("title") + " AS k FROM items)) QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY id DESC) = 1"),
    "first_per_title": with_items("SELECT min(id) AS id FROM items GROUP BY lower(title)"),
    "capped_per_source": with_items("SELECT source, count(*) AS n, max(id) AS last_id FROM (SELECT source, id FROM visible QUALIFY row_number() OVER (PARTITION BY source ORDER BY id) <= 25) GROUP BY 1", VISIBLE_SQL),
    "gate_reasons": with_items("SELECT id, outcome FROM gated", REGISTRY_SQL, GATED_SQL),
    "classify_category": with_items(
        f"SELECT id, CASE WHEN coalesce(f, false) OR c IN ({quoted(lexicon.PINNED_CATEGORIES)}) THEN c {_rules_sql('t', CATEGORY_RULES)} WHEN c IN ({quoted(lexicon.CATEGORIES)}) THEN c ELSE 'Legal News' END AS category FROM (SELECT i.id, r.force_category AS f, coalesce(r.category, i.category) AS c, lower(i.title || ' ' || i.summary) AS t FROM items i LEFT JOIN registry r ON r.name = i.source)",
        REGISTRY_SQL,
    ),
    "stored_categories": with_items(
        f"SELECT id, {_POLICY.format(has_any('t', POLICY_TERMS))} AS category FROM (SELECT id, lower(title || ' ' || summary) AS t, CASE id % 5 WHEN 0 THEN 'Press Release/Judiciary Updates' WHEN 1 THEN 'Legal News' WHEN 2 THEN 'Legal News' ELSE category END AS c FROM items)"
    ),
    "detect_country": with_items(f"SELECT id, {_COUNTRY_SQL} AS country FROM (SELECT id, {', '.join(f'{sql} AS s{i}' for i, sql in enumerate(_SCORES.values()))} FROM (SELECT id, lower(title || ' ' || summary) AS t FROM items))"),
    "ai_gate": with_items(f"SELECT id FROM items WHERE source = 'src1' OR {has_any(chr(40) + 'lower(title || chr(32) || summary)' + chr(41), ('ai', 'mit'))}"),
    "merge_updates": with_items(
        f"SELECT fingerprint, title, md5(summary) AS summary_md5, CASE WHEN action <> 'kept' AND category = 'Legal News' AND {has_any('lower(title || chr(32) || summary)', lexicon.POLICY_TERMS)} THEN 'Policy/Regulatory News' ELSE category END AS category, source_tab, date, first_seen_at, last_seen_at, action FROM merged",
        _STORE_SQL,
    ),
    **dict.fromkeys(("stored_merge", "stored_delta"), with_items(
        f"SELECT fingerprint, title, md5(summary) AS summary_md5, CASE WHEN action <> 'kept' AND category = 'Legal News' AND {has_any('lower(title || chr(32) || summary)', lexicon.POLICY_TERMS)} THEN 'Policy/Regulatory News' ELSE category END AS category, source_tab, date, first_seen_at, last_seen_at FROM merged",
        _STORE_SQL,
    )),
    "run_states": f"WITH {RUNS_SQL} SELECT source_id, max(id) AS id, arg_max(status, id) AS status, arg_max(fetched_at, id) AS fetched_at, min(fetched_at) AS first_seen, count(*) AS runs, arg_max(fetched_at, id) + INTERVAL 12 HOUR <= {NOW_SQL} AS stale FROM runs GROUP BY source_id",
    "merge_summary": with_items("SELECT count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'updated') AS updated FROM merged", _STORE_SQL),
    "published_issues": f"WITH {_UPSERTED} SELECT * FROM m WHERE status = 'published' AND published_at IS NOT NULL ORDER BY published_at DESC, updated_at DESC, id LIMIT 100",
    "upserted_issues": f"WITH {_UPSERTED} SELECT * FROM m",
    "upserted_digests": f"WITH {_UPSERTED} SELECT id, status, CAST(CASE WHEN id % 4 = 0 THEN 99 WHEN id % 3 = 0 THEN NULL ELSE id % 5 + 1 END AS INTEGER) AS item_count, created_at FROM m",
    "deleted_issues": f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM o WHERE id NOT IN (SELECT id FROM n)",
    "public_stats": f"SELECT count(*) AS published, max(published_at) AS last_published FROM ({_OLD}) WHERE status = 'published' AND published_at IS NOT NULL",
    "found_issues": f"SELECT id FROM ({_OLD}) WHERE contains(lower(title), 'the')",
    "official_sources": with_items("SELECT count(*) AS sources, count(*) FILTER (official) AS official, CAST(sum(n) AS BIGINT) AS items, CAST(sum(n) FILTER (official) AS BIGINT) AS official_items FROM registry JOIN (SELECT source AS name, count(*) AS n FROM items GROUP BY 1) USING (name)", REGISTRY_SQL),
    "merge_tagged": with_items(
        "SELECT coalesce(o.fingerprint, n.fingerprint) AS fingerprint, 'r' || len(CASE WHEN n.id IS NULL THEN o.title ELSE n.title || '!' END) AS region, CASE WHEN n.id IS NULL THEN o.category ELSE n.category END AS tags, coalesce(o.title, n.title || '!') AS title, CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'kept' ELSE 'updated' END AS action FROM stored o FULL JOIN batch n ON o.fingerprint = n.fingerprint",
        _STORE_SQL,
    ),
    "migrated_items": with_items(
        f"""SELECT id, coalesce(forced, {_POLICY.format(has_any('t', lexicon.POLICY_TERMS))}) AS category, source_tab, fingerprint FROM (
  SELECT i.id, lower(i.title || ' ' || i.summary) AS t, CASE WHEN i.id % 2 = 0 THEN 'Recent Judgments' ELSE 'Legal News' END AS c, CASE WHEN r.force_category THEN r.category END AS forced, r.source_tab, sha256(CAST(i.id % 400 AS VARCHAR)) AS fingerprint
  FROM items i LEFT JOIN registry r ON r.name = i.source QUALIFY row_number() OVER (PARTITION BY i.id % 400 ORDER BY i.id) = 1)""",
        REGISTRY_SQL,
    ),
    "issue_history": f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT id, created_at FROM (SELECT * FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n) ORDER BY created_at DESC, id LIMIT 30",
    "run_log": f"WITH {RUNS_SQL} SELECT source_id, status, count(*) AS n, CAST(max(len(substr(error, 1, 700))) AS INTEGER) AS longest FROM runs GROUP BY 1, 2",
    "weekly_velocity": f"WITH {RUNS_SQL} SELECT source_id, CAST(week AS TIMESTAMP) AS week, n, n - lag(n) OVER (PARTITION BY source_id ORDER BY week) AS delta FROM (SELECT source_id, date_trunc('week', fetched_at) AS week, count(*) AS n FROM runs GROUP BY 1, 2)",
}
