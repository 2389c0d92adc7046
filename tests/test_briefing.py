"""Briefing, AI-news, ingestion and guard functions on literal rows."""

import datetime as dt

from pyspark.sql import functions as F

from quillspark.functions import labels, text, urls
from quillspark.operators import ainews, briefing, gates, movements, refresh, routing, stats


def now():
    return F.lit("2024-01-31 12:00:00").cast("timestamp")


def told(spark, values, column):
    """What a column over ``x`` says of each value, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r["y"] for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_character_references(spark):
    raw = ["a &amp;lt; b", "&#233;&#xE9;&eacute;", "&copy; &unknown; &#0; &#55296;", "no & such", "&amp;amp;", None]
    assert told(spark, raw, text.decode_references) == ["a &lt; b", "ééé", "© &unknown; &#0; &#55296;", "no & such", "&amp;", None]
    assert told(spark, ["<b>R&amp;D</b> &#8211; news |"], text.clean_text) == ["R&D – news"]


def test_public_urls(spark):
    good = ["https://site.example/a", "http://8.8.8.8/", "http://172.32.0.1:8080/x"]
    bad = ["ftp://site.example/", "http:///x", "http://localhost/", "http://LOCALHOST:80", "http://a.local/", "http://10.0.0.1", "http://user:pw@192.168.1.1/", "http://[::1]/", "http://[fe80::1]/", "", None]
    assert told(spark, good + bad, urls.public_url) == [True] * len(good) + [False] * len(bad)


def test_labels(spark):
    assert told(spark, ["legal_ai", "new_topic/of-note", "official/policy"], labels.topic_label) == ["Legal AI", "New Topic Of-Note", "Official Policy"]
    assert told(spark, ["html", "RSS", "editorial/legal_ai_news"], labels.source_type_label) == ["HTML", "RSS", "Editorial / Legal Ai News"]
    ages = ["2024-01-31 11:59:50", "2024-01-31 11:01:00", "2024-01-31 10:29:00", "2024-01-29 12:31:00", "2024-01-20 12:00:00", None]
    assert told(spark, ages, lambda x: labels.time_ago(x.cast("timestamp"), now())) == ["1m ago", "59m ago", "2h ago", "47h ago", "20 Jan 2024", "No scan yet"]


def test_provider_replies(spark):
    replies = ['{"output_text": " Two  sentences. "}', '{"output": [{"content": [{"text": "One."}, {"kind": "x"}]}, {"content": null}, {"content": [{"text": "Two."}]}]}', "no json", None, "{}"]
    assert told(spark, replies, briefing.provider_text) == ["Two sentences.", "One. Two.", "", "", ""]


def test_source_lookup_has_four_levels(spark):
    registry = spark.createDataFrame([("s1", "Named", "India", "Legal News", "u1"), ("s2", "Topical", "India", "AI Regulation", "u2"), ("s3", "Placed", "Malaysia", "Legal News", "u3")], "id string, name string, country string, category string, url string")
    items = spark.createDataFrame([(1, "own", "x", "India", "AI Regulation"), (2, "", "Named", "India", "None"), (3, None, "x", "India", "AI Regulation"), (4, None, "x", "Malaysia", "AI Regulation"), (5, None, "x", "Nowhere", "None")], "id int, link string, source string, country string, topic string")
    got = routing.source_registry_lookup(items, registry).orderBy("id").collect()
    assert [(r["source_name"], r["source_link"]) for r in got] == [("x", "own"), ("Named", "u1"), ("Topical", "u2"), ("Placed", "u3"), ("x", "#")]


def test_drafts_by_output(spark):
    row = spark.createDataFrame([("appointment", "A. Bee", "High Court", "Chief Justice", "India"), ("retirement", "C. Dee", "", "", ""), ("appointment", "", "", "", "India")], "movement_type string, judge_name string, court string, new_role string, country string")
    mail = movements.draft(row, tone="Warm professional").collect()
    assert "Dear A. Bee," in mail[0]["body"] and "warmest congratulations" in mail[0]["body"] and mail[0]["subject"] == "Congratulations on your appointment as Chief Justice"
    assert [r["can_approve"] for r in mail] == [True, True, False] and mail[2]["missing"] == ["judge name", "new role or court"]
    assert "your appointment as Chief Justice at High Court." in movements.draft(row).first()["body"]
    assert "congratulates C. Dee on their judicial service." in movements.draft(row, output="LinkedIn/internal post").collect()[1]["body"]
    note = movements.draft(row, output="Short executive note").first()
    assert note["subject"] == "Judicial movement note: A. Bee" and "for appointment: Chief Justice at High Court." in note["body"]


def test_short_ids(spark):
    def by_hand(s):
        h = 0
        raw = s.encode("utf-16-be")
        for k in range(0, len(raw), 2):
            h = (h * 31 + int.from_bytes(raw[k : k + 2], "big") + 2**31) % 2**32 - 2**31
        n, digits = abs(h), ""
        while n:
            n, d = divmod(n, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
        return digits or "0"

    texts = ["", "a", "https://news.example/x?y=1", "日本 é", "\U0001f600 smile"]
    assert told(spark, texts, movements.fallback_id) == [by_hand(t) for t in texts]


def test_commercial_rules(spark):
    rows = spark.createDataFrame([("adv x", "", "https://a/"), ("a", "presale now", "https://a/"), ("a", "", "https://STORE.lawnet.com/x"), ("a", "", "https://www.techlawfest.com/event/1"), ("get a ticket", "", "https://techlawfest.com/x"), ("a", "", "https://techlawfest.com/x"), ("a", "b", None)], "t string, s string, l string")
    assert [r["y"] for r in rows.select(gates.commercial_noise(F.col("t"), F.col("s"), F.col("l")).alias("y")).collect()] == [True, True, True, True, True, False, False]


def test_terms_of_a_source_are_literals(spark):
    shape = "id string, name string, country string, category string, source_type string, official boolean, source_tab string, force_category boolean, include_all boolean, require_date boolean, required_terms array<string>, excluded_terms array<string>, country_detection boolean, url string"
    registry = spark.createDataFrame([("a", "A", "India", "Legal News", "rss", False, None, False, True, False, ["attorney-general", "c.p.c"], ["opinion"], False, "https://a/")], shape)
    entries = spark.createDataFrame([("A", "Attorney-General speaks out", "", None, "l1", 1), ("A", "Attorney general speaks out", "", None, "l2", 2), ("A", "Changes to the C.P.C. today", "", None, "l3", 3), ("A", "Changes to the CxPxC today", "", None, "l4", 4), ("A", "Attorney-General: an opinion", "", None, "l5", 5)], "source string, title string, summary string, date date, link string, seq int")
    assert {r["seq"] for r in refresh.accepted_items(entries, registry).collect()} == {1, 3}


def test_refresh_counts_and_runs(spark):
    shape = "id string, name string, country string, category string, source_type string, official boolean, source_tab string, force_category boolean, include_all boolean, require_date boolean, required_terms array<string>, excluded_terms array<string>, country_detection boolean, url string, ingestion_method string"
    registry = spark.createDataFrame([(k, k.upper(), "India", "Legal News", "rss", False, "Tab", False, True, False, [], [], False, f"https://{k}/", m) for k, m in (("a", "rss"), ("b", "rss"), ("c", "manual"))], shape)
    entries = spark.createDataFrame([("A", "One long title", "s", None, "", 1), ("A", "One long title", "later", None, "", 2), ("A", "short", "s", None, "", 3), ("B", "From a failed scan", "s", None, "", 4)], "source string, title string, summary string, date date, link string, seq int")
    scans = spark.createDataFrame([("A", None), ("B", "x" * 800), ("C", None)], "source string, error string")
    stored = refresh.accepted_items(entries.limit(0), registry).drop("seq").withColumns({"first_seen_at": now(), "last_seen_at": now()})
    merged, runs, counts = refresh.refresh(entries, scans, registry, stored, now())
    assert counts.first().asDict() == {"sources": 3, "seen": 2, "failed": 1, "inserted": 1, "updated": 0}
    assert [(r["title"], r["summary"], r["source_tab"], r["link"]) for r in merged.collect()] == [("One long title", "later", "Tab", "https://a/")]
    assert {(r["source_id"], r["status"], r["item_count"], len(r["error"] or "")) for r in runs.collect()} == {("a", "ok", 2, 0), ("b", "error", 0, 700), ("c", "idle", 0, 0)}
    again = refresh.refresh(entries, scans, registry, merged.drop("action"), now())[2].first()
    assert (again["inserted"], again["updated"]) == (0, 1)


def test_blank_errors_take_their_class(spark):
    runs = spark.createDataFrame([(1, "a", "error", dt.datetime(2024, 1, 1), 0, " ", "ReadTimeout")], "id int, source_id string, status string, fetched_at timestamp, item_count int, error string, error_type string")
    registry = spark.createDataFrame([("a", "A", True, "rss")], "id string, name string, official boolean, source_type string")
    items = spark.createDataFrame([], "source string")
    assert stats.run_health(runs, registry, items).first()["error"] == "ReadTimeout"


def test_what_a_department_reads(spark):
    general, ai = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(2,), (3,)], "id int")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(ainews.for_department("sales", general, ai)) == [2, 3] and ids(ainews.for_department("sales", general, ai.limit(0))) == [1] and ids(ainews.for_department("product", general, ai)) == [1]
    assert ids(ainews.or_else(ai.limit(0), general.limit(0))) == []


def test_ai_topics_stand_anywhere(spark):
    assert told(spark, ["relaunched tools", "fact finding", "cyberrisks", "datasets", "nothing"], ainews.ai_topic) == ["Legal Tech Market Intelligence", "AI Regulation", "Privacy/Data Protection", "API/Data Licensing", "Legal Tech Market Intelligence"]
