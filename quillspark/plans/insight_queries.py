"""Catalogue queries on insight: risk grid, routing, signals, digests, movements, feedback, scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import dates, labels, lexicon, text, wordings
from quillspark.operators import briefing, digest, heatmap, movements, positional, rollups, routing, summarize
from quillspark.plans.sqlparts import NOW_SQL, has_term, has_word, with_items
from quillspark.session import written
from quillspark.sources import markup, scans
from quillspark.sources.items import REGISTRY_SQL, items, now, read, registry
from quillspark.streaming import ingest

# Terms that the driver's invented prose does hold; defaults stay with the operators.
DOMAINS = tuple((d[0], d[1], d[2], t) for d, t in zip(lexicon.RISK_DOMAINS, (("tion", "or", "der"), ("ai", "en"), ("license", "licensed", "mit"), ("und", "der", "das"), ("que", "de", "la")), strict=True))
TOPIC_RULES = tuple((t[0], p, t[2]) for t, p in zip(lexicon.TOPIC_RULES, ("ai|enai", "licensed?", "mit|apache", "und|von", "que|une", "thor|thand", "ofre|onre", "th|an"), strict=True))
ACTION, MOVE_KEYWORDS = "nd|st|tion", {"retirement": ("er the", "der die"), "honour": ("reserved",), "leadership_change": ("in the",), "elevation": ("of the", "que la"), "appointment": ("and the", "on the", "ing the", "und der")}


def _signals(spark, sf) -> DataFrame:
    return heatmap.signals(items(spark, sf), registry(spark), now(), DOMAINS)


def risk_signals(spark, sf):
    return _signals(spark, sf).select("id", "domain", F.size("terms").alias("n_terms"), "authority", "severity", "recency", "confidence", "score")


def risk_heatmap_cells(spark, sf):
    cells = heatmap.grid(_signals(spark, sf), now(), DOMAINS).drop("j_ord", "d_ord")
    return cells.withColumn("authority_mix", briefing.authority_mix_text(F.col("authority_mix"))).withColumn("trend_line", briefing.trend_line(F.col("n"), F.col("delta7")))


def _kept_up(rows: DataFrame, cells_of):
    """Cells of ``rows`` as three batches leave them: a half, then the others, some of them first in another shape."""
    wrong = lambda df: df.withColumns({"country": F.lit("India"), "first_seen_at": F.col("first_seen_at") - F.expr("INTERVAL 9 DAYS")})
    first, second, third = rows.filter("id % 2 = 0"), rows.filter("id % 4 = 1"), rows.filter("id % 4 = 3")
    none = cells_of(rows.limit(0))
    cells = rollups.changed(cells_of(first), cells_of(wrong(second)), none)
    cells = rollups.changed(cells, cells_of(wrong(third)), none)
    return rollups.changed(cells, cells_of(second.unionByName(third)), cells_of(wrong(second).unionByName(wrong(third))))


def risk_cells_kept_up(spark, sf):
    """The risk grid from partial aggregates after three batches, of which the last replaces what the others brought."""
    cells = rollups.grid(_kept_up(_signals(spark, sf), rollups.signal_cells), now(), DOMAINS).drop("j_ord", "d_ord")
    return cells.withColumn("authority_mix", briefing.authority_mix_text(F.col("authority_mix"))).withColumn("trend_line", briefing.trend_line(F.col("n"), F.col("delta7")))


def counts_kept_up(spark, sf):
    """Counts by country and category, and new items, from partial aggregates after the same batches."""
    cells = _kept_up(items(spark, sf), rollups.item_cells)
    fresh = rollups.new_since(cells, now() - F.expr("INTERVAL 24 HOURS")).select(F.lit("new").alias("kind"), F.lit(None).cast("string").alias("name"), F.col("n_new").alias("n"))
    return rollups.grouped_counts(cells).unionByName(fresh)


def risk_heatmap_top_signals(spark, sf):
    return heatmap.top_signals(_signals(spark, sf)).select("country", "domain", "place", "id", "score")


def risk_kpis(spark, sf):
    return heatmap.kpis(heatmap.grid(_signals(spark, sf), now(), DOMAINS), items(spark, sf), now())


def risk_cells_filtered(spark, sf):
    found = _signals(spark, sf)
    cells = heatmap.filtered_cells(heatmap.grid(found, now(), DOMAINS), heatmap.top_signals(found), level="All", since=F.lit("2024-01-25").cast("date"))
    return cells.select("country", "domain", "score", "shown", "level")


def _routed(spark, sf) -> DataFrame:
    return routing.routing_items(items(spark, sf), now(), TOPIC_RULES, ACTION)


def _scores(spark, sf) -> DataFrame:
    return routing.route_scores(_routed(spark, sf), routing.departments(spark))


def routing_topics(spark, sf):
    return _routed(spark, sf).select("id", "topic", "urgency", "impact", "status", F.array_join("tags", ",").alias("tags"))


def route_scores(spark, sf):
    return _scores(spark, sf).select("id", "department", "route_score", "routed", "confidence", "route_rank")


def _scored(spark, sf) -> DataFrame:
    return routing.strategic_scores(_routed(spark, sf))


def signal_scores(spark, sf):
    return _scored(spark, sf).select("id", "n_routes", "signal_score")


def strategic_signals(spark, sf):
    return routing.strategic_signals(_scored(spark, sf), 60).select("id", "signal_score", "impact")


def routing_breakdown(spark, sf):
    return routing.breakdown(routing.strategic_signals(_scored(spark, sf), 60))


def _digest(spark, sf, department: str = "legislation") -> DataFrame:
    return routing.balanced(routing.digest_candidates(_scored(spark, sf), None, department), 12)


def balanced_digest(spark, sf):
    return _digest(spark, sf).select("id", "country", "rank", "turn")


def digest_summary(spark, sf):
    return digest.digest_counts(_digest(spark, sf))


def digest_bodies(spark, sf):
    return digest.render_digest(_digest(spark, sf), F.lit("Weekly <briefing>"))


def digest_with_summaries(spark, sf):
    # Twelve entries at most, which the digest and the summaries both read: items are scored once.
    chosen = written(_digest(spark, sf).select("id", "title", "summary", F.col("summary").alias("content")))
    return digest.with_summaries(chosen, summarize.summarize(chosen)).select("id", "content_summary")


def source_urls(spark, sf):
    known = registry(spark).filter("id <> 's4' AND id <> 's7'")
    return routing.source_lookup(items(spark, sf), known).select("id", "source_url")


def detected_movements(spark, sf):
    return movements.detect_movements(items(spark, sf), MOVE_KEYWORDS).select("id", "movement_type", "judge_name", "court", "new_role", "confidence", "status", F.array_join("keywords", ",").alias("keywords"))


def movement_funnel(spark, sf):
    # The funnel and the reviews both read what was detected: texts are read once.
    found = written(movements.detect_movements(items(spark, sf), MOVE_KEYWORDS).select("id", "status"))
    reviews = found.filter("id % 3 = 0").select("id", F.lit("approved").alias("status"))
    return movements.funnel(movements.hydrate(found, reviews))


def movement_bands(spark, sf):
    """Movements of one country and confidence band, each with a label and a short id."""
    found = movements.filtered(movements.detect_movements(items(spark, sf), MOVE_KEYWORDS), country="India", band="Medium")
    return found.select("id", movements.confidence_label(F.col("confidence")).alias("band"), movements.fallback_id(F.col("link")).alias("short_id"), labels.title_case(F.col("movement_type")).alias("label"))


def movement_drafts(spark, sf):
    return movements.draft(movements.detect_movements(items(spark, sf), MOVE_KEYWORDS)).select("id", "subject", "body", F.array_join("missing", ",").alias("missing"), "can_approve")


def _feedback(spark, sf) -> DataFrame:
    e = read(spark, sf, "events")
    topics = F.array_compact(F.array(F.when(F.col("event_id") % 2 == 0, F.col("event_type")), F.when(F.col("event_id") % 5 == 0, F.lit("citation"))))
    return e.select(F.when(F.col("value") > 50, "useful").otherwise("noise").alias("value"), F.element_at(F.array(*[F.lit(d[0]) for d in lexicon.DEPARTMENTS]), (F.col("user_id") % 4).cast("int") + 1).alias("department"), topics.alias("topics"), "event_id")


def feedback_topics(spark, sf):
    return digest.feedback_counts(_feedback(spark, sf))


def ignored_topics(spark, sf):
    every = read(spark, sf, "part").select(F.lower(F.split("p_type", " ")[0]).alias("topic")).union(read(spark, sf, "events").select("event_type")).distinct()
    return digest.ignored_topics(every, _feedback(spark, sf))


def kept_selection(spark, sf):
    return digest.kept_selection(items(spark, sf).filter("id % 4 = 0").select("id"), _routed(spark, sf).filter(F.col("urgency") == "ACTION REQUIRED"))


def todays_items(spark, sf):
    return digest.of_today(items(spark, sf), F.to_date(now())).select("id")


def country_line(spark, sf):
    return digest.mix_line(items(spark, sf), "country")


def mail_drafts(spark, sf):
    """Mail links of all items; texts too long for a link are to be copied."""
    d = digest.mail_draft(F.col("title"), text.cut_short(F.col("summary"), 320))
    return items(spark, sf).select("id", d["mode"].alias("mode"), d["url"].alias("url"), d["clipboard"].alias("clipboard"))


def day_mails(spark, sf):
    """The mail of the day for each country and category, with how it is launched."""
    made = digest.compose_mails(digest.of_today(items(spark, sf), F.lit("2024-01-31").cast("date")), now(), by=("country", "category"))
    d = digest.mail_draft(F.col("subject"), F.col("body"))
    return made.select("country", "category", "n", "subject", "body", d["mode"].alias("mode"), d["url"].alias("url"))


def carried_lines(spark, sf):
    """Lines of documents as nodes: numbers in a line date it, capitals head it, a license line stops."""
    lines = read(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    day = F.when(F.length("line") % 5 == 0, F.length("line"))
    out = positional.carry_forward(lines, date=day, heading=F.when(F.length("line") % 3 == 0, F.substring("line", 1, 20)), stop=F.contains(F.lower("line"), F.lit("license")))
    return out.select("page_id", "pos", F.col("current_date").alias("day"), F.col("current_heading").alias("heading"))


def page_nodes(spark, sf):
    return markup.page_nodes(read(spark, sf, "pages")).select("page_id", "pos", "tag", "class", "text", "href", "datetime")


def page_list_items(spark, sf):
    return markup.node_items(markup.page_nodes(read(spark, sf, "pages")), tags=("p", "li"))


def scanned_pages(spark, sf):
    """Every page as a listing of its articles, by selectors of its own."""
    p, none = read(spark, sf, "pages"), F.lit(None).cast("string")
    own = p.select(F.col("page_id").cast("string").alias("id"), "url", F.lit("selector").alias("finder"), F.lit("article").alias("item_selector"), F.lit("h1").alias("title_selector"), none.alias("link_selector"), F.lit("h1").alias("summary_selector"), none.alias("date_selector"))
    found = scans.scan_pages(p.select(F.col("page_id").cast("string").alias("source_id"), "html"), own)
    return found.select("source_id", "pos", "title", F.length("summary").alias("summary_chars"), "link")


def scanned_listings(spark, sf):
    """Parts as listing pages of three kinds, scanned by their finders: gazette tables, marked judgments, AI articles with links of two sites."""
    p = read(spark, sf, "part").withColumn("page", F.floor(F.col("p_partkey") / 50))
    key = F.col("p_partkey").cast("string")
    name, brand = text.escape_html(F.col("p_name")), text.escape_html(F.col("p_brand"))
    cell = lambda *x: F.concat(F.lit("<td>"), *x, F.lit("</td>"))
    day = F.date_add(F.lit("2019-01-01").cast("date"), (F.col("p_partkey") % 300).cast("int"))
    number = F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit("AB-C-"), F.lpad(key, 8, "0"), F.lit("-123456"))).otherwise("")
    row = F.concat(F.lit("<tr>"), cell(name), cell(brand), cell(F.date_format(day, "dd-MMM-yyyy")), cell(number), F.lit("<td>1.5 MB</td></tr>"))
    marks = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit(", diary number "), key, F.lit(", uploaded on "), F.date_format(day, "dd-MM-yyyy"))).otherwise("")
    entry = F.concat(F.lit('<li><a href="j'), key, F.lit('">'), name, marks, F.lit("</a></li>"))
    post = F.concat(F.lit('<div class="post"><a href="https://other.example/'), key, F.lit('">A longer text of somebody else on '), name, F.lit('</a><a href="/p'), key, F.lit('">News of the part '), name, F.lit('</a><time datetime="'), day.cast("string"), F.lit('">x</time><p>About '), brand, F.lit("</p></div>"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", c.alias("h")))), lambda x: x["h"]), "")
    pages = p.groupBy("page").agg(listed(row).alias("gazette"), listed(entry).alias("judgments"), listed(post).alias("ai"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("finder"), html.alias("html")) for k, html in (("gazette", F.concat(F.lit("<table>"), F.col("gazette"), F.lit("</table>"))), ("judgments", F.concat(F.lit("<h3>Judgments</h3><ul>"), F.col("judgments"), F.lit("</ul>"))), ("ai", F.col("ai")))]))
    made = pages.select("page", kinds.alias("k")).select(F.concat_ws("/", "k.finder", F.col("page").cast("string")).alias("source_id"), "k.finder", "k.html")
    none = F.lit(None).cast("string")
    sources = made.select(F.col("source_id").alias("id"), F.lit("https://site.example/list/").alias("url"), "finder", *[none.alias(c) for c in ("item_selector", "title_selector", "link_selector", "summary_selector", "date_selector")])
    found = scans.scan_pages(made.select("source_id", "html"), sources, most=None)
    title = F.when(F.col("source_id").startswith("gazette"), text.gazette_title(F.col("cells"))).otherwise(F.col("title"))
    return found.select(F.substring_index("source_id", "/", 1).alias("finder"), title.alias("title"), "date", "link", F.when(F.col("source_id").startswith("ai"), F.col("summary")).alias("summary"))


def summary_contents(spark, sf):
    """Texts of pages for summaries; every third page is served as something else."""
    p = read(spark, sf, "pages").withColumn("kind", F.when(F.col("page_id") % 3 == 0, "application/pdf; q=1").otherwise("text/html"))
    return scans.page_contents(p, type_col="kind").select("page_id", "error", F.length("content").alias("chars"))


def page_contents(spark, sf):
    return markup.page_text(markup.page_nodes(read(spark, sf, "pages")))


def rss_entries(spark, sf):
    """Items written as feeds of at most 50 entries, read back, and the first 25 of each source."""
    d = items(spark, sf).withColumn("feed", F.floor(F.col("id") / 50))
    entry = F.concat(F.lit("<item><title>"), text.escape_html(F.col("title")), F.lit("</title><link>"), F.col("link"), F.lit("</link><pubDate>"), F.date_format("first_seen_at", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"))
    entries = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", entry.alias("e")))), lambda x: x["e"]), "")
    feeds = d.groupBy("source", "feed").agg(F.concat(F.lit("<rss><channel>"), entries, F.lit("</channel></rss>")).alias("xml"))
    found = markup.rss_items(feeds.select(F.struct("source", "feed").alias("at"), "xml"), source_col="at", most=50)
    order = Window.partitionBy("source").orderBy("feed", "pos")
    numbered = found.select("at.source", "at.feed", "pos", "link", "date").withColumn("n", F.row_number().over(order)).filter("n <= 25")
    return numbered.select("source", (F.col("n") - 1).alias("pos"), "link", "date")


def publication_dates(spark, sf):
    """Order dates written in three layouts and read back."""
    o = read(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))
    written = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("d", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("d", "d MMM yyyy")).otherwise(F.date_format("d", "dd/MM/yyyy"))
    return o.select("o_orderkey", dates.publication_date(F.concat(F.lit("Filed on "), written, F.lit(" in court"))).alias("d"))


def headlines(spark, sf):
    return items(spark, sf).select("id", text.executive_title(F.col("title")).alias("headline"), text.sentence_trim(F.col("summary"), 120).alias("lead"), text.slug(F.col("category")).alias("slug"))


def cleaned_texts(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.clean_text(text.repair_encoding(F.col("html"))).alias("text"))


def event_windows(spark, sf):
    return ingest.windowed_counts(read(spark, sf, "events"))


def sliding_windows(spark, sf):
    """Events of any three days by type, a window a day."""
    return ingest.windowed_counts(read(spark, sf, "events"), width="3 days", slide="1 day")


def risk_lookbacks(spark, sf):
    """Dated signals of the 7 days up to each day, the 7 and the 30 before, by country and domain."""
    return ingest.lookback_counts(_signals(spark, sf).filter("date IS NOT NULL"))


QUERIES = {
    f.__name__: f
    for f in (
        risk_signals, risk_heatmap_cells, risk_cells_kept_up, counts_kept_up, risk_heatmap_top_signals, risk_kpis, risk_cells_filtered, routing_topics, route_scores, signal_scores, strategic_signals, routing_breakdown, balanced_digest, digest_summary,
        digest_bodies, digest_with_summaries, source_urls, detected_movements, movement_funnel, movement_bands, movement_drafts, feedback_topics, ignored_topics, kept_selection, todays_items, country_line, mail_drafts, day_mails, carried_lines,
        page_nodes, page_list_items, scanned_pages, scanned_listings, summary_contents, page_contents, rss_entries, publication_dates, headlines, cleaned_texts, event_windows, sliding_windows, risk_lookbacks,
    )
}

_N_TERMS = "CASE d.domain " + " ".join("WHEN '{}' THEN {}".format(d[0], " + ".join(f"CASE WHEN {has_term('t', x)} THEN 1 ELSE 0 END" for x in d[3])) for d in DOMAINS) + " END"
_IN_TITLE = "CASE d.domain " + " ".join("WHEN '{}' THEN {}".format(d[0], " OR ".join(has_term("lt", x) for x in d[3])) for d in DOMAINS) + " END"
_DOMAINS = "(VALUES " + ", ".join(f"('{d[0]}', {d[2]}, {i})" for i, d in enumerate(DOMAINS)) + ") d(domain, business, d_ord)"
_COUNTRIES = "(VALUES " + ", ".join(f"('{c}', {i})" for i, c in enumerate(lexicon.JURISDICTIONS)) + ") j(country, j_ord)"
SIGNALS_SQL = f"""base AS (
  SELECT i.*, lower(concat_ws(' ', i.title, i.summary, i.category, i.source)) AS t, lower(i.title) AS lt, lower(i.category) AS lc, r.official, r.category = 'Legal News' OR coalesce(r.source_tab, '') = 'News Sources' AS news, r.source_type
  FROM items i LEFT JOIN registry r ON r.name = i.source
), hit AS (
  SELECT b.*, d.domain, d.business, {_N_TERMS} + CASE WHEN d.domain = 'litigation_spikes' AND lc IN ('recent judgments', 'case summary') THEN 1 ELSE 0 END AS n_terms, {_IN_TITLE} AS in_title FROM base b, {_DOMAINS}
), graded AS (
  SELECT *, CASE WHEN official THEN 25 WHEN news THEN 10 WHEN source_type IN ('rss', 'html') THEN 10 ELSE 6 END AS authority,
    least(30, 10 + CASE WHEN lc IN ('recent judgments', 'case summary') THEN 10 WHEN lc = 'legislation news' THEN 12 WHEN lc = 'press release/judiciary updates' THEN 8 ELSE 0 END + CASE WHEN in_title THEN 5 ELSE 0 END) AS severity,
    greatest(0, CAST(floor((epoch({NOW_SQL}) - epoch(coalesce(CAST(date AS TIMESTAMP), first_seen_at))) / 86400) AS INTEGER)) AS age, CASE WHEN n_terms >= 3 THEN 15 WHEN n_terms = 2 THEN 11 ELSE 7 END AS confidence
  FROM hit WHERE n_terms > 0
), sig AS (
  SELECT *, CASE WHEN age <= 7 THEN 10 WHEN age <= 30 THEN 6 WHEN age <= 90 THEN 3 ELSE 1 END AS recency, least(100, severity + authority + CASE WHEN age <= 7 THEN 10 WHEN age <= 30 THEN 6 WHEN age <= 90 THEN 3 ELSE 1 END + confidence + business) AS score FROM graded
)"""
CELLS_SQL = f"""raw AS (
  SELECT country, domain, count(*) AS n, count(*) FILTER (CAST(date AS TIMESTAMP) BETWEEN {NOW_SQL} - INTERVAL 7 DAY AND {NOW_SQL}) AS last7,
    count(*) FILTER (CAST(date AS TIMESTAMP) >= {NOW_SQL} - INTERVAL 14 DAY AND CAST(date AS TIMESTAMP) < {NOW_SQL} - INTERVAL 7 DAY) AS previous7, count(*) FILTER (CAST(date AS TIMESTAMP) >= {NOW_SQL} - INTERVAL 37 DAY AND CAST(date AS TIMESTAMP) < {NOW_SQL} - INTERVAL 7 DAY) AS previous30,
    round_even(sum(CASE authority WHEN 25 THEN 1.0::DECIMAL(10,2) WHEN 10 THEN 0.5::DECIMAL(10,2) ELSE 0.35::DECIMAL(10,2) END), 1) AS weighted, CAST(round_even(avg(score), 0) AS BIGINT) AS mean, count(*) FILTER (authority = 25) AS high, count(*) FILTER (authority = 10) AS middle, count(*) FILTER (authority = 6) AS low
  FROM sig GROUP BY 1, 2
), scored AS (
  SELECT *, last7 - previous7 AS delta7, greatest(1, least(100, CAST(round_even(CAST(mean * 0.55 AS DECIMAL(20,2)) + least(30, n * 7) + greatest(-8, least(18, (last7 - previous7) * 5)) + round_even(n * 8 / max(n) OVER (PARTITION BY domain), 0), 0) AS INTEGER))) AS uncapped,
    CASE WHEN n = 1 THEN CASE WHEN high > 0 THEN 70 ELSE 60 END WHEN n <= 3 THEN CASE WHEN high > 0 THEN 85 ELSE 75 END WHEN high > 0 THEN 100 ELSE 85 END AS cap FROM raw
), cells AS (
  SELECT j.country, d.domain, j_ord, d_ord, coalesce(least(uncapped, cap), 0) AS score, coalesce(uncapped, 0) AS uncapped, coalesce(cap, 0) AS cap, coalesce(n, 0) AS n, coalesce(weighted, 0) AS weighted, coalesce(last7, 0) AS last7, coalesce(previous7, 0) AS previous7,
    coalesce(previous30, 0) AS previous30, coalesce(delta7, 0) AS delta7, coalesce(high, 0) AS high, coalesce(middle, 0) AS middle, coalesce(low, 0) AS low, CASE WHEN previous7 > 0 THEN CASE WHEN delta7 > 0 THEN 'rising' WHEN delta7 = 0 THEN 'stable' ELSE 'falling' END WHEN last7 > 0 THEN 'new activity' ELSE 'insufficient historical data' END AS trend
  FROM {_COUNTRIES} CROSS JOIN {_DOMAINS} LEFT JOIN scored s ON s.country = j.country AND s.domain = d.domain
), leveled AS (SELECT *, CASE WHEN score <= 0 THEN 'No Signals' WHEN score >= 86 THEN 'Critical' WHEN score >= 71 THEN 'Elevated' WHEN score >= 51 THEN 'Active' WHEN score >= 26 THEN 'Watch' ELSE 'Low' END AS level FROM cells),
top AS (SELECT *, row_number() OVER (PARTITION BY country, domain ORDER BY date DESC NULLS LAST, score DESC, id) AS place FROM sig QUALIFY place <= 8)"""
_TOPIC = "CASE " + " ".join("WHEN {}{} THEN '{}'".format(has_word("t", p), "".join(f" OR category = '{c}'" for c in cats), t) for t, p, cats in TOPIC_RULES) + " WHEN category = 'Press Release/Judiciary Updates' THEN 'Judiciary Modernization' ELSE 'Legislative Development' END"
ROUTED_SQL = f"""topical AS (SELECT *, {_TOPIC} AS topic, first_seen_at >= {NOW_SQL} - INTERVAL 24 HOUR AS is_new FROM (SELECT *, lower(concat_ws(' ', title, summary, category, source, source_tab)) AS t FROM items)),
urgent AS (SELECT *, CASE WHEN {has_word('t', ACTION)} THEN 'ACTION REQUIRED' WHEN topic IN ('AI Regulation', 'API/Data Licensing', 'Legal Tech Market Intelligence', 'Precedent-Setting Judgment') THEN 'STRATEGIC' WHEN category IN ('Legislation News', 'Recent Judgments') THEN 'WATCH' WHEN category = 'Legal News' THEN 'INFORMATIONAL' ELSE 'WATCH' END AS urgency FROM topical),
routed AS (SELECT *, greatest(35, least(98, 52 + CASE urgency WHEN 'ACTION REQUIRED' THEN 28 WHEN 'STRATEGIC' THEN 20 WHEN 'WATCH' THEN 10 ELSE 0 END + CASE WHEN topic IN ('AI Regulation', 'Privacy/Data Protection', 'API/Data Licensing') THEN 10 ELSE 0 END
  + CASE WHEN category IN ('Recent Judgments', 'Legislation News', 'Case Summary') THEN 8 ELSE 0 END + CASE WHEN is_new THEN 5 ELSE 0 END + CASE WHEN regexp_matches(lower(concat_ws(' ', source, source_tab)), '{lexicon.OFFICIAL_SOURCE_PATTERN}') THEN 4 ELSE 0 END)) AS impact,
  list_filter([regexp_replace(lower(topic), '[^a-z0-9]+', '_', 'g'), category, source_tab], lambda x: x IS NOT NULL) AS tags FROM urgent)"""
_WEIGHT = "CASE d.department " + " ".join("WHEN '{}' THEN CASE topic {} ELSE 0 END".format(d[0], " ".join(f"WHEN '{k}' THEN {v}" for k, v in d[3].items())) for d in lexicon.DEPARTMENTS) + " END"
_PLACE = "CASE d.department " + " ".join("WHEN '{}' THEN country IN ({})".format(d[0], ", ".join(f"'{c}'" for c in d[4])) for d in lexicon.DEPARTMENTS) + " END"
_DEPARTMENTS = "(VALUES " + ", ".join(f"('{d[0]}', {i})" for i, d in enumerate(lexicon.DEPARTMENTS)) + ") d(department, d_ord)"
SCORES_SQL = f"""scores AS (SELECT *, CASE WHEN route_score >= 82 THEN 'High' WHEN route_score >= 66 THEN 'Medium-High' WHEN route_score >= 48 THEN 'Medium' ELSE 'Low' END AS confidence, route_score >= 58 AS routed, row_number() OVER (PARTITION BY id ORDER BY route_score DESC, d_ord) AS route_rank FROM (
  SELECT r.id, d.department, d_ord, greatest(0, least(100, CAST(floor({_WEIGHT} * 0.45::DECIMAL(4,2) + CASE WHEN {_PLACE} THEN 18 ELSE 5 END + CASE urgency WHEN 'ACTION REQUIRED' THEN 100 WHEN 'STRATEGIC' THEN 86 WHEN 'WATCH' THEN 62 WHEN 'INFORMATIONAL' THEN 38 WHEN 'LOW PRIORITY' THEN 18 ELSE 20 END * 0.18::DECIMAL(4,2) + impact * 0.19::DECIMAL(4,2) + 0.5::DECIMAL(2,1)) AS INTEGER))) AS route_score
  FROM routed r, {_DEPARTMENTS}))"""
_SIGNAL_POINTS = " + ".join("CASE WHEN {}{} THEN {} ELSE 0 END".format(has_word("x", p), "".join(f" OR topic = '{t}'" for t in topics), n) for n, _, p, topics in lexicon.SIGNAL_RULES)
_INTAKE = "regexp_matches(x, '{}')".format(lexicon.ROUTINE_INTAKE_PATTERN.replace("(?<![a-z0-9_])", r"\b").replace("(?![a-z0-9_])", r"\b"))
_JUDGED = f"((topic IN ('Precedent-Setting Judgment', 'Judiciary Modernization') OR {has_word('x', lexicon.COURT_TOPIC_WORDS)}) AND ({has_word('x', lexicon.CAUSE_LIST_WORDS)} OR regexp_matches(x, '\\sv\\.?\\s') OR {has_word('x', lexicon.ROUTINE_OUTCOME_WORDS)}) AND NOT {has_word('x', lexicon.STRATEGIC_COURT_WORDS)})"
SCORED_SQL = f"""texted AS (SELECT r.*, coalesce(n.n, 0) AS n_routes, lower(concat_ws(' ', title, summary, topic, category, source, source_tab, array_to_string(tags, ' '))) AS x FROM routed r LEFT JOIN (SELECT id, count(*) AS n FROM scores WHERE routed AND department <> 'sales' GROUP BY 1) n ON n.id = r.id),
s0 AS (SELECT *, CASE WHEN n_routes >= 3 THEN 24 WHEN n_routes = 2 THEN 14 WHEN n_routes = 1 THEN 6 ELSE 0 END + {_SIGNAL_POINTS} + CASE urgency WHEN 'ACTION REQUIRED' THEN 18 WHEN 'STRATEGIC' THEN 14 WHEN 'WATCH' THEN 6 ELSE 0 END + least(10, greatest(0, CAST(floor((impact - 65) / 3.0::DOUBLE + 0.5) AS INTEGER))) AS a FROM texted),
s1 AS (SELECT *, CASE WHEN {_INTAKE} THEN least(a, 38) ELSE a END AS b FROM s0),
s2 AS (SELECT *, CASE WHEN topic = 'Precedent-Setting Judgment' AND NOT {has_word('x', lexicon.PRECEDENT_WORDS)} THEN least(b, 64) ELSE b END AS c FROM s1),
s3 AS (SELECT *, CASE WHEN {_JUDGED} THEN least(c, 58) ELSE c END AS d FROM s2),
scored_items AS (SELECT *, greatest(0, least(100, CASE WHEN {has_word('x', lexicon.NOTICE_WORDS)} AND NOT {has_word('x', lexicon.NOTICE_EXCUSE_WORDS)} THEN least(d, 45) ELSE d END)) AS signal_score FROM s3)"""
DIGEST_SQL = f"""alerts AS (SELECT i.*, s.route_score FROM scored_items i JOIN scores s ON s.id = i.id AND s.department = 'legislation' AND s.route_score >= 52
  WHERE NOT {has_word('lower(title)', lexicon.OPINION_WORDS)} AND NOT ({has_word('lower(title)', lexicon.ANALYSIS_WORDS)} AND NOT {has_word('x', lexicon.ANALYSIS_EXCUSE_WORDS)}) AND NOT {_INTAKE} AND NOT {_JUDGED}
  QUALIFY row_number() OVER (PARTITION BY country ORDER BY signal_score DESC, s.route_score DESC, impact DESC, i.id) <= 12),
candidates AS (SELECT *, row_number() OVER (ORDER BY signal_score DESC, route_score DESC, impact DESC, id) AS rank FROM alerts),
chosen AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY rank) AS turn FROM candidates ORDER BY turn, rank LIMIT 12)"""
_KEYWORDS = [(k, w) for k, ws in MOVE_KEYWORDS.items() for w in ws]
_MOVE_HIT = "list_filter([" + ", ".join(f"CASE WHEN contains(low, '{w}') THEN '{w}' END" for _, w in _KEYWORDS) + "], lambda v: v IS NOT NULL)"
_MOVE_TYPE = "CASE " + " ".join("WHEN {} THEN '{}'".format(" OR ".join(f"contains(low, '{w}')" for w in MOVE_KEYWORDS[k]), k) for k in lexicon.MOVEMENT_PRIORITY) + " ELSE 'unknown' END"
_Q = lambda pattern: pattern.replace("'", "''")


def _raw_name(pattern: str) -> str:
    n = f"string_split_regex(regexp_extract(x, '{_Q(pattern)}', 1), '[.;:,]\\s+')[1]"
    for end in lexicon.NAME_ENDS:
        n = f"regexp_replace({n}, '{end}', '')"
    return f"trim({n})"


_NAMES = ", ".join(f"{_raw_name(p)} AS n{i}" for i, p in enumerate(lexicon.NAME_PATTERNS))
_NAME = "coalesce(" + ", ".join(f"CASE WHEN n{i} <> '' AND len(string_split_regex(n{i}, '\\s+')) <= 5 AND NOT regexp_matches(n{i}, '{lexicon.NAME_REFUSED}') THEN n{i} END" for i in range(len(lexicon.NAME_PATTERNS))) + ", '')"
_ROLES = ", ".join(f"nullif(trim(regexp_extract(x, '(?i)\\b{lead}{lexicon.ROLE_ENDS}', 1)), '')" for lead in lexicon.ROLE_LEADS)
_ROLE = f"coalesce({_ROLES}, CASE WHEN movement_type = 'leadership_change' THEN nullif(regexp_extract(x, '{lexicon.CHIEF_ROLES}', 1), '') END, CASE WHEN movement_type = 'elevation' THEN 'Elevation' END, '')"
_COURT = "CASE " + " ".join(f"WHEN regexp_matches(x, '(?i)\\b{c}\\b') THEN '{c}'" for c in lexicon.COURTS) + " ELSE '' END"
MOVES_SQL = f"""m0 AS (SELECT *, trim(regexp_replace(concat_ws(' ', title, summary, country, category, source, source_tab), '\\s+', ' ', 'g')) AS x, lower(trim(regexp_replace(concat_ws(' ', title, summary, country, category, source, source_tab), '\\s+', ' ', 'g'))) AS low, lower(concat_ws(' ', source, source_tab, category)) AS src FROM items),
m1 AS (SELECT *, {_MOVE_HIT} AS hits, {_MOVE_TYPE} AS movement_type, {_NAMES} FROM m0),
m2 AS (SELECT *, {_NAME} AS judge_name, {_COURT} AS court, {_ROLE} AS new_role FROM m1),
moved AS (SELECT *, CASE WHEN {has_word('low', lexicon.JUDGE_WORDS)} AND {has_word('low', lexicon.SPEECH_WORDS)} AND NOT {has_word('low', lexicon.MOVE_WORDS)} OR len(hits) = 0 THEN 0 ELSE least(100, 28 + least(26, len(hits) * 8) + CASE WHEN movement_type IN ('appointment', 'elevation', 'leadership_change', 'retirement') THEN 10 ELSE 0 END + CASE WHEN judge_name <> '' THEN 14 ELSE 0 END + CASE WHEN court <> '' THEN 10 ELSE 0 END + CASE WHEN new_role <> '' THEN 10 ELSE 0 END
  + CASE WHEN regexp_matches(src, 'court|judiciar|ministry|government|gazette|bar|law society') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(src, 'press release|judiciary updates') THEN 8 ELSE 0 END + CASE WHEN judge_name = '' AND contains(lower(title || ' ' || summary), 'elevation') THEN 10 ELSE 0 END + CASE WHEN contains(src, 'news') THEN 4 ELSE 0 END) END AS confidence FROM m2),
shown AS (SELECT *, CASE WHEN confidence >= 70 AND judge_name <> '' AND (new_role <> '' OR court <> '') THEN 'detected' ELSE 'needs_review' END AS status FROM moved WHERE confidence >= 42)"""
def _escaped(column: str) -> str:
    out = column
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        out = f"replace({out}, '{char}', '{ref}')"
    return out


_FEEDBACK = """feedback AS (SELECT CASE WHEN value > 50 THEN 'useful' ELSE 'noise' END AS value, ['product', 'legislation', 'sales', 'editorial'][user_id % 4 + 1] AS department, list_filter([CASE WHEN event_id % 2 = 0 THEN event_type END, CASE WHEN event_id % 5 = 0 THEN 'citation' END], lambda x: x IS NOT NULL) AS topics FROM events)"""

_WORD_CUT = r"CASE WHEN len({0}) <= {1} THEN {0} ELSE regexp_replace(substr({0}, 1, {2}), '\s+\S*$', '') || '...' END"
_SHORT_CUT = "CASE WHEN len({0}) <= 320 THEN {0} ELSE trim(substr({0}, 1, 319)) || '...' END"
_PASTE = "'" + wordings.PASTE_BODY.replace("\n", "' || chr(10) || '") + "'"
_SQUEEZE = f"trim(regexp_replace({{0}}, '{text.SPACE}', ' ', 'g'))"
_ENCODED = "replace(replace(replace(replace(replace(url_encode({0}), '%2A', '*'), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')')"
_DECODED = "html"
for _name, _point in lexicon.REFERENCES.items():
    if _name != "amp":
        _DECODED = f"replace({_DECODED}, '&{_name};', chr({_point}))"
_DECODED = f"replace(replace({_DECODED}, '&#39;', chr(39)), '&amp;', '&')"
_GRID = (REGISTRY_SQL, SIGNALS_SQL, CELLS_SQL)
_LABELS = "CASE domain " + " ".join(f"WHEN '{d[0]}' THEN '{d[1]}'" for d in DOMAINS) + " END"
_CELL_COLUMNS = f"""country, domain, {_LABELS} AS label, score, level, uncapped, cap, n, weighted, last7, previous7, previous30, delta7, trend,
  coalesce(nullif(concat_ws(' / ', CASE WHEN high > 0 THEN 'High: ' || high END, CASE WHEN middle > 0 THEN 'Medium-Low: ' || middle END, CASE WHEN low > 0 THEN 'Low: ' || low END), ''), 'No authority mix yet') AS authority_mix,
  CASE WHEN n > 0 THEN n || CASE WHEN n = 1 THEN ' raw signal; ' ELSE ' raw signals; ' END || CAST(CAST(weighted AS DECIMAL(20,1)) AS VARCHAR) || ' weighted; delta ' || delta7 ELSE 'No signals in selected period.' END AS rationale,
  n || CASE WHEN n = 1 THEN ' signal · ' ELSE ' signals · ' END || CASE WHEN delta7 > 0 THEN '↑ +' WHEN delta7 < 0 THEN '↓ ' ELSE '→ +' END || delta7 || ' vs prior 7d' AS trend_line"""
ORACLES = {
    "risk_signals": with_items("SELECT id, domain, CAST(n_terms AS INTEGER) AS n_terms, authority, severity, recency, confidence, score FROM sig", REGISTRY_SQL, SIGNALS_SQL),
    **dict.fromkeys(("risk_heatmap_cells", "risk_cells_kept_up"), with_items(f"SELECT {_CELL_COLUMNS} FROM leveled", *_GRID)),
    "counts_kept_up": with_items(f"SELECT 'total' AS kind, NULL AS name, count(*) AS n FROM items UNION ALL SELECT 'country', country, count(*) FROM items GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM items GROUP BY 2 UNION ALL SELECT 'new', NULL, count(*) FROM items WHERE first_seen_at >= {NOW_SQL} - INTERVAL 24 HOUR"),
    "risk_heatmap_top_signals": with_items("SELECT country, domain, place, id, score FROM top", *_GRID),
    "risk_kpis": with_items(
        f"""SELECT (SELECT country FROM leveled WHERE score > 0 ORDER BY score DESC, j_ord, d_ord LIMIT 1) AS highest_country, (SELECT domain FROM leveled WHERE score > 0 ORDER BY score DESC, j_ord, d_ord LIMIT 1) AS highest_domain,
  (SELECT country || ' / ' || domain FROM leveled WHERE score > 0 AND (delta7 > 0 OR last7 > 0) ORDER BY delta7 DESC, last7 DESC, weighted DESC, j_ord, d_ord LIMIT 1) AS rising, (SELECT CAST(sum(n) AS BIGINT) FROM leveled WHERE score > 0) AS displayed,
  (SELECT domain FROM leveled WHERE score > 0 GROUP BY domain, d_ord ORDER BY sum(weighted) DESC, d_ord LIMIT 1) AS hottest, (SELECT count(*) FROM items WHERE coalesce(CAST(date AS TIMESTAMP), first_seen_at) BETWEEN {NOW_SQL} - INTERVAL 7 DAY AND {NOW_SQL}) AS ingested_week""",
        *_GRID,
    ),
    "risk_cells_filtered": with_items("SELECT l.country, l.domain, CASE WHEN coalesce(s.n, 0) = 0 THEN 0 ELSE score END AS score, coalesce(s.n, 0) AS shown, CASE WHEN coalesce(s.n, 0) = 0 THEN 'No Signals' ELSE level END AS level FROM leveled l LEFT JOIN (SELECT country, domain, count(*) AS n FROM top WHERE date >= DATE '2024-01-25' GROUP BY 1, 2) s ON s.country = l.country AND s.domain = l.domain", *_GRID),
    "routing_topics": with_items("SELECT id, topic, urgency, impact, CASE WHEN is_new THEN 'New' ELSE 'Reviewed' END AS status, array_to_string(tags, ',') AS tags FROM routed", ROUTED_SQL),
    "route_scores": with_items("SELECT id, department, route_score, routed, confidence, route_rank FROM scores", ROUTED_SQL, SCORES_SQL),
    "signal_scores": with_items("SELECT id, n_routes, signal_score FROM scored_items", ROUTED_SQL, SCORES_SQL, SCORED_SQL),
    "strategic_signals": with_items("SELECT id, signal_score, impact FROM scored_items WHERE signal_score >= 60", ROUTED_SQL, SCORES_SQL, SCORED_SQL),
    "routing_breakdown": with_items("SELECT CASE grouping(urgency, country, topic) WHEN 3 THEN 'urgency' WHEN 5 THEN 'country' ELSE 'topic' END AS kind, coalesce(urgency, country, topic) AS name, count(*) AS n FROM scored_items WHERE signal_score >= 60 GROUP BY GROUPING SETS ((urgency), (country), (topic))", ROUTED_SQL, SCORES_SQL, SCORED_SQL),
    "balanced_digest": with_items("SELECT id, country, rank, turn FROM chosen", ROUTED_SQL, SCORES_SQL, SCORED_SQL, DIGEST_SQL),
    "digest_summary": with_items("SELECT count(*) AS n, count(*) FILTER (urgency IN ('ACTION REQUIRED', 'STRATEGIC')) AS urgent, (SELECT string_agg(topic, ', ' ORDER BY p) FROM (SELECT topic, min(rank) AS p FROM chosen GROUP BY 1 ORDER BY p LIMIT 3)) AS topics FROM chosen", ROUTED_SQL, SCORES_SQL, SCORED_SQL, DIGEST_SQL),
    "digest_bodies": with_items(
        r"""SELECT 'Weekly <briefing>' || chr(10) || chr(10) || string_agg(k || '. ' || title || ' [' || country || ']' || chr(10) || '   ' || link, chr(10) ORDER BY k) AS text_body,
  '<h1>Weekly &lt;briefing&gt;</h1><ol>' || string_agg('<li><a href="' || ESC(link) || '">' || ESC(title) || '</a> ' || ESC(country) || '</li>', '' ORDER BY k) || '</ol>' AS html_body FROM (SELECT *, row_number() OVER (ORDER BY rank) AS k FROM chosen)""".replace("ESC(link)", _escaped("link")).replace("ESC(title)", _escaped("title")).replace("ESC(country)", _escaped("country")),
        ROUTED_SQL, SCORES_SQL, SCORED_SQL, DIGEST_SQL,
    ),
    "source_urls": with_items("SELECT i.id, coalesce(a.url, b.url, i.link) AS source_url FROM items i LEFT JOIN registry a ON a.name = i.source AND a.id NOT IN ('s4', 's7') LEFT JOIN (SELECT country, category, min_by(url, id) AS url FROM registry WHERE id NOT IN ('s4', 's7') GROUP BY 1, 2) b ON b.country = i.country AND b.category = i.category", REGISTRY_SQL),
    "detected_movements": with_items("SELECT id, movement_type, judge_name, court, new_role, confidence, status, array_to_string(hits, ',') AS keywords FROM shown", MOVES_SQL),
    "movement_funnel": with_items("SELECT count(*) AS total, count(*) FILTER (status = 'detected' AND id % 3 <> 0) AS detected, count(*) FILTER (status = 'needs_review' AND id % 3 <> 0) AS needs_review, count(*) FILTER (id % 3 = 0) AS approved, count(*) FILTER (false) AS dismissed FROM shown", MOVES_SQL),
    "movement_bands": with_items(
        r"""SELECT id, 'Medium' AS band, lower(to_base(abs(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(link, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)), 36)) AS short_id,
  array_to_string(list_transform(string_split(replace(movement_type, '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM shown WHERE country = 'India' AND confidence >= 60 AND confidence < 80""",
        MOVES_SQL,
    ),
    "movement_drafts": with_items(f"""SELECT id, CASE WHEN movement_type = 'retirement' THEN 'Congratulations on your judicial service' ELSE 'Congratulations on your appointment as ' || role END AS subject,
  '{wordings.REVIEW_NOTE}' || chr(10) || chr(10) || 'Dear ' || name || ',' || chr(10) || chr(10) || 'On behalf of [Organisation/Team], ' || replace('{wordings.TONES['Formal judiciary']}', 'this important appointment', 'your appointment as ' || role || at_court) || chr(10) || chr(10) || chr(10)
    || 'We wish you every success in this important role and look forward to following your continued contribution to the administration of justice in ' || country || '.' || chr(10) || chr(10) || 'Yours sincerely,' || chr(10) || '[Sender Name]' AS body,
  concat_ws(',', CASE WHEN judge_name = '' THEN 'judge name' END, CASE WHEN placeless THEN 'new role or court' END) AS missing, judge_name <> '' AND NOT placeless AS can_approve
FROM (SELECT *, CASE WHEN new_role <> '' THEN new_role WHEN movement_type = 'retirement' THEN 'your judicial service' WHEN movement_type = 'honour' THEN 'this honour' ELSE '[New Role]' END AS role, CASE WHEN judge_name <> '' THEN judge_name ELSE '[Judge Name]' END AS name,
  CASE WHEN court <> '' THEN ' at ' || court ELSE '' END AS at_court, new_role = '' AND court = '' AND movement_type NOT IN ('retirement', 'honour') AS placeless FROM shown)""", MOVES_SQL),
    "feedback_topics": f"WITH {_FEEDBACK} SELECT 'value' AS kind, value AS name, count(*) AS n FROM feedback GROUP BY 2 UNION ALL SELECT 'department', department, count(*) FROM feedback GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'topic' AS kind, t AS name, count(*) AS n FROM (SELECT unnest(topics) AS t FROM feedback) GROUP BY 2 ORDER BY n DESC, name LIMIT 5)",
    "ignored_topics": f"WITH {_FEEDBACK} SELECT topic FROM (SELECT lower(string_split(p_type, ' ')[1]) AS topic FROM part UNION SELECT event_type FROM events) WHERE topic NOT IN (SELECT unnest(topics) FROM feedback) ORDER BY 1 LIMIT 5",
    "kept_selection": with_items("SELECT id FROM routed WHERE id % 4 = 0 AND urgency = 'ACTION REQUIRED'", ROUTED_SQL),
    "todays_items": with_items("SELECT id FROM items WHERE (date = DATE '2024-01-31' OR CAST(first_seen_at AS DATE) = DATE '2024-01-31') AND trim(title) <> ''"),
    "country_line": with_items("SELECT string_agg(country || ' (' || n || ')', ', ' ORDER BY n DESC, country) AS mix FROM (SELECT country, count(*) AS n FROM items GROUP BY 1)"),
    "carried_lines": """WITH l AS (SELECT doc_id AS page_id, unnest(range(0, len(a))) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
f AS (SELECT *, CASE WHEN len(line) % 5 = 0 THEN len(line) END AS d, CASE WHEN len(line) % 3 = 0 THEN substr(line, 1, 20) END AS h, max(CASE WHEN contains(lower(line), 'license') THEN 1 ELSE 0 END) OVER w AS stopped FROM l WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
b AS (SELECT *, count(d) OVER w AS block, last_value(d IGNORE NULLS) OVER w AS day FROM f WINDOW w AS (PARTITION BY page_id ORDER BY pos))
SELECT page_id, CAST(pos AS INTEGER) AS pos, CAST(day AS INTEGER) AS day, last_value(h IGNORE NULLS) OVER (PARTITION BY page_id, block ORDER BY pos) AS heading FROM b QUALIFY stopped = 0""",
    "rss_entries": with_items("SELECT source, CAST(k - 1 AS INTEGER) AS pos, 'https://news.example/' || source || '/' || (id % 500) || '?a=' || (id % 3) AS link, CAST(first_seen_at AS DATE) AS date FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS k FROM items) WHERE k <= 25"),
    "headlines": with_items(
        rf"""SELECT id, {_WORD_CUT.format('h', 118, 115)} AS headline, CASE WHEN len(s) <= 120 THEN s ELSE trim(regexp_replace(substr(s, 1, 117), '\s+\S*$', ''), ' .,;:') || '...' END AS lead, regexp_replace(lower(category), '[^a-z0-9]+', '-', 'g') AS slug FROM (
  SELECT *, CASE WHEN letters > 0 AND capitals / letters > 0.72 THEN regexp_replace(array_to_string(list_transform(regexp_extract_all(lower(c), '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda w: CASE WHEN regexp_matches(w, '^[a-z]') THEN upper(w[1]) || w[2:] ELSE w END), ''), '\bVs\.?\b', 'v.', 'g') ELSE c END AS h FROM (
    SELECT *, len(regexp_replace(c, '[^A-Za-z]', '', 'g')) AS letters, len(regexp_replace(c, '[^A-Z]', '', 'g')) AS capitals FROM (
      SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(t, '(?i)\bDownload\b.*$', ''), '(?i)\bGazette ID\b.*$', ''), '(?i)\s*[-|]\s*(Latest|News|Update)$', '')) AS c FROM (SELECT *, {_SQUEEZE.format('title')} AS t, {_SQUEEZE.format('summary')} AS s FROM items))))"""
    ),
    "mail_drafts": with_items(
        f"SELECT id, CASE WHEN len(u) <= 1800 THEN 'mailto' ELSE 'copy' END AS mode, CASE WHEN len(u) <= 1800 THEN u ELSE 'mailto:?subject=' || {_ENCODED.format('title')} || '&body=' || {_ENCODED.format(_PASTE)} END AS url, CASE WHEN len(u) <= 1800 THEN '' ELSE b END AS clipboard FROM (SELECT id, title, b, 'mailto:?subject=' || {_ENCODED.format('title')} || '&body=' || {_ENCODED.format('b')} AS u FROM (SELECT *, {_SHORT_CUT.format('s')} AS b FROM (SELECT id, coalesce(title, '') AS title, {_SQUEEZE.format("coalesce(summary, '')")} AS s FROM items)))"
    ),
    "day_mails": with_items(
        f"""SELECT country, category, n, subject, body, CASE WHEN len(u) <= 1800 THEN 'mailto' ELSE 'copy' END AS mode, CASE WHEN len(u) <= 1800 THEN u ELSE 'mailto:?subject=' || {_ENCODED.format('subject')} || '&body=' || {_ENCODED.format(_PASTE)} END AS url FROM (SELECT *, 'mailto:?subject=' || {_ENCODED.format('subject')} || '&body=' || {_ENCODED.format('body')} AS u FROM (
  SELECT country, category, count(*) AS n, 'APAC Legal Updates - 31 Jan 2024' AS subject, 'Dear team,' || chr(10) || chr(10) || CASE WHEN count(*) = 1 THEN 'Please find today''s legal update below.' ELSE 'Please find today''s ' || count(*) || ' legal updates below.' END || chr(10) || chr(10)
    || string_agg(k || '. ' || t || chr(10) || '   ' || concat_ws(' / ', country, category, source) || CASE WHEN s <> '' THEN chr(10) || '   Summary: ' || {_SHORT_CUT.format('s')} ELSE '' END || chr(10) || '   Link: ' || link, chr(10) ORDER BY k) || chr(10) || chr(10) || 'Best regards,' AS body
  FROM (SELECT *, row_number() OVER (PARTITION BY country, category ORDER BY id) AS k FROM (SELECT *, {_SQUEEZE.format("coalesce(title, '')")} AS t, {_SQUEEZE.format("coalesce(summary, '')")} AS s FROM items WHERE date = DATE '2024-01-31' OR CAST(first_seen_at AS DATE) = DATE '2024-01-31') WHERE t <> '' QUALIFY k <= 200) GROUP BY 1, 2))"""
    ),
    "cleaned_texts": f"SELECT page_id, trim(regexp_replace(regexp_replace({_DECODED}, '<[A-Za-z/!][^>]*>', ' ', 'g'), '{text.SPACE}', ' ', 'g'), ' ' || chr(9) || chr(13) || chr(10) || '-•|') AS text FROM pages",
    "scanned_pages": f"SELECT CAST(page_id AS VARCHAR) AS source_id, CAST(0 AS INTEGER) AS pos, CASE WHEN len(t) > 260 THEN rtrim(substr(t, 1, 259)) || '...' ELSE t END AS title, CAST(CASE WHEN len(t) > 520 THEN len(rtrim(substr(t, 1, 519))) + 3 ELSE len(t) END AS INTEGER) AS summary_chars, url AS link FROM (SELECT page_id, url, trim(regexp_replace(regexp_replace({_DECODED.replace('html', 'h')}, '<[A-Za-z/!][^>]*>', ' ', 'g'), '{text.SPACE}', ' ', 'g'), ' ' || chr(9) || chr(13) || chr(10) || '-•|') AS t FROM (SELECT *, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h FROM pages))",
    "publication_dates": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders",
    "event_windows": "SELECT TIMESTAMP '1970-01-01' + to_days(CAST(floor(epoch(ts) / 86400 / 7) * 7 AS INTEGER)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "sliding_windows": "SELECT date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS start, event_type, count(*) AS n FROM events, (SELECT unnest(range(3)) AS k) GROUP BY 1, 2",
    "risk_lookbacks": with_items("SELECT date + CAST(k AS INTEGER) AS day, country, domain, count(*) FILTER (k < 7) AS last7, count(*) FILTER (k BETWEEN 7 AND 13) AS previous7, count(*) FILTER (k >= 7) AS previous30 FROM sig, (SELECT unnest(range(37)) AS k) WHERE date IS NOT NULL GROUP BY 1, 2, 3", REGISTRY_SQL, SIGNALS_SQL),
    "scanned_listings": """WITH p AS (SELECT *, DATE '2019-01-01' + CAST(p_partkey % 300 AS INTEGER) AS day FROM part)
SELECT 'gazette' AS finder, p_name || ' ' || p_brand AS title, day AS date, 'https://site.example/list/' AS link, NULL AS summary FROM p WHERE p_partkey % 5 > 0
UNION ALL SELECT 'judgments', p_name || ', diary number ' || p_partkey || ', uploaded on ' || strftime(day, '%d-%m-%Y'), day, 'https://site.example/list/j' || p_partkey, NULL FROM p WHERE p_partkey % 3 > 0
UNION ALL SELECT 'ai', 'News of the part ' || n, first(day ORDER BY k), 'https://site.example/p' || min(k), first('About ' || b ORDER BY k) FROM (SELECT p_partkey AS k, p_partkey // 50 AS page, p_name AS n, p_brand AS b, day FROM p) GROUP BY page, n""",
}
