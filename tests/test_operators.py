"""Single operators on literal rows."""

import datetime as dt
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import dates, lexicon, matching, text
from quillspark.operators import classify, gates, heatmap, listing, merge, movements, positional, routing, summarize
from quillspark.operators.frame import settled
from quillspark.sources import items as item_source
from quillspark.sources import markup

NOW = "2024-01-31 12:00:00"
NOW_AT = dt.datetime(2024, 1, 1)


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'date' if isinstance(v, dt.date) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTPS://News.Example.COM/a/b/?utm_source=x&b=1&c=#top", "https://news.example.com/a/b?b=1&c="),
        ("http://x.org", "http://x.org/"),
        ("http://x.org/?fbclid=1", "http://x.org/"),
        ("http://x.org/p;v=1?a", "http://x.org/p?a="),
    ],
)
def test_canonical_url(spark, raw, want):
    assert one(spark, text.canonical_url(F.col("u")), u=raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("on 2024-02-30 or 3 March 2023", dt.date(2023, 3, 3)),
        ("12/05/69", dt.date(2069, 5, 12)),
        ("12.05.71", dt.date(1971, 5, 12)),
        ("1 Sept 2020", dt.date(2020, 9, 1)),
        ("nothing", None),
    ],
)
def test_publication_date(spark, raw, want):
    assert one(spark, dates.publication_date(F.col("u")), u=raw) == want


def test_feed_and_relative_dates(spark):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    assert one(spark, dates.feed_date(F.col("u")), u="Tue, 02 Jan 2024 23:30:00 -0500") == dt.date(2024, 1, 3)
    assert one(spark, dates.relative_date(F.col("u"), now), u="26 May") == dt.date(2023, 5, 26)
    assert one(spark, dates.relative_date(F.col("u"), now), u="Today") == dt.date(2024, 1, 10)


def test_encoding_repair_holds_few_texts(spark):
    """Of a batch only a few texts are Python's at a time, and only suspicious ones are given to it."""
    bad, good, wide = "cafÃ© " * 2000, "café " * 2000, "漢字 plain " * 1000
    batch = pa.array([bad] * 3000)
    tracemalloc.start()
    out = text._repair.func(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20 and len(out) == 3000 and out[0].as_py() == out[2999].as_py() == good
    assert [text._repair.func(pa.array([x], pa.string())).to_pylist() for x in (None, "", wide)] == [[None], [""], [wide]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate((bad, wide, None, "", "â"))], "i int, u string")
    assert [r[1] for r in rows.select("i", text.repair_encoding(F.col("u"))).orderBy("i").collect()] == [good, wide, None, "", "â"]


def test_text_functions(spark):
    assert one(spark, text.clean_text(F.col("u")), u=" <b>A&amp;B</b>   - ") == "A&B"
    assert one(spark, text.clean_text(F.col("u"), 10), u="abcdefghijklmnop") == "abcdefghi..."
    assert one(spark, text.repair_encoding(F.col("u")), u="cafÃ©") == "café"
    assert one(spark, text.executive_title(F.col("u")), u="SMITH VS. JONES DOWNLOAD 3 MB") == "Smith v.. Jones"
    assert one(spark, text.executive_title(F.col("u")), u="O'NEIL VS THE ANTI-MONEY BOARD") == "O'Neil v. The Anti-Money Board"
    assert one(spark, text.cut_at_word(F.col("u"), 10, 9), u="one two\nthree four") == "one two..."
    assert one(spark, text.cut_at_word(F.col("u"), 10, 8), u="one two\nthree four") == "one two..."
    assert one(spark, text.cut_short(F.col("u"), 10), u="one  two\nthree") == "one two t..."
    assert one(spark, text.escape_html(F.col("u")), u="<a href='x'>&</a>") == "&lt;a href=&#39;x&#39;&gt;&amp;&lt;/a&gt;"
    assert one(spark, text.safe_href(F.col("u")), u="javascript:alert(1)") == "#"
    assert one(spark, text.gazette_text(F.col("u")), u="CG-DL-E-01012024-123456 Rules 01-Jan-2024 1.2 MB Download") == "Rules"
    assert one(spark, text.clean_model_output(F.col("u")), u="Here is the summary:\n* one\n\n* two") == "one\ntwo"
    assert one(spark, text.any_term(F.col("u"), ("ai",)), u="maintain") is False
    assert one(spark, text.any_term(F.col("u"), ("ai",)), u="about ai.") is True


def test_unknown_tab_hides_editorial(spark):
    rows = spark.createDataFrame([("a: Opinion", None), ("plain", None), ("a: Opinion", "Other"), ("a: opinion", "News Sources")], "title string, source_tab string").withColumn("summary", F.lit(""))
    assert [r["title"] for r in rows.filter(listing.editorial_rule()).collect()] == ["plain", "a: Opinion"]


def test_country_detection(spark):
    pairs = [("New Zealand and NZ news", "New Zealand"), ("HKSAR court", "Hong Kong"), ("nothing here", None), ("Malaysia and Singapore", "Malaysia"), ("Supreme Court of India", "India")]
    for raw, want in pairs:
        assert one(spark, classify.detect_country(F.col("u")), u=raw) == want


def test_legal_relevance(spark):
    relevant = lambda raw: one(spark, classify.legal_relevance(F.col("u")), u=raw)
    assert relevant("High Court rules on appeal")
    assert not relevant("Weather today")
    assert not relevant("police raid over a bill")
    assert relevant("police raid: suspect convicted in court")


def test_gates(spark):
    rows = spark.createDataFrame(
        [(1, "Home", "x", "src0"), (2, "High Court rules on data", "court", "src0"), (3, "Adv great court offer today", "", "src0"), (4, "The court says: Opinion", "", "src0"), (5, "A garden of flowers", "none", "src1")],
        "id int, title string, summary string, source string",
    ).withColumns({"country": F.lit("India"), "category": F.lit("Legal News"), "date": F.lit("2024-01-01").cast("date"), "link": F.lit("http://a.b/c")})
    known = item_source.registry(spark).withColumn("include_all", F.lit(False))
    got = {r["id"]: r["reject_reason"] for r in gates.gate_items(classify.with_registry(rows, known), country_signals={"India": ("the",)}).collect()}
    assert got[1] == "short title" and got[2] is None and got[3] == "commercial" and got[4] == "editorial" and got[5] == "not legal"


def test_merge_keeps_and_overwrites(spark):
    schema = "fingerprint string, country string, title string, summary string, category string, source_tab string, date date, link string, first_seen_at timestamp, last_seen_at timestamp"
    day, old = dt.date(2024, 1, 1), dt.datetime(2024, 1, 1)
    stored = spark.createDataFrame([("a", "India", "t", "s", "Legal News", "tab", day, "l", old, old), ("b", "India", "t", "s", "Legal News", "tab", day, "l", old, old)], schema)
    batch = spark.createDataFrame([("a", "X", "new", "", "Case Summary", None, None, "m", 1), ("c", "X", "n", "first", "Case Summary", None, None, "m", 1), ("c", "X", "n", "last", "Case Summary", None, None, "m", 2)], "fingerprint string, country string, title string, summary string, category string, source_tab string, date date, link string, seq int")
    got = {r["fingerprint"]: r for r in merge.merge_items(stored, batch, F.lit(NOW).cast("timestamp")).collect()}
    assert got["a"]["action"] == "updated" and got["a"]["title"] == "t" and got["a"]["summary"] == "s" and got["a"]["date"] == day and got["a"]["source_tab"] is None and got["a"]["link"] == "m" and got["a"]["first_seen_at"] == old
    assert got["b"]["action"] == "kept" and got["b"]["last_seen_at"] == old
    assert got["c"]["action"] == "inserted" and got["c"]["summary"] == "last"


def test_balanced_is_a_round_robin(spark):
    rng = random.Random(2)
    for _ in range(3):
        rows = [(i, rng.choice(["a", "b", "c", None])) for i in range(14)]
        left, chosen, used = list(rows), [], set()
        while left and len(chosen) < 9:
            at = next((k for k, r in enumerate(left) if r[1] not in used), None)
            if at is None:
                used, at = set(), 0
            row = left.pop(at)
            chosen.append(row[0])
            used |= {row[1]} - {None}
        df = spark.createDataFrame(rows, "rank int, country string")
        assert [r["rank"] for r in routing.balanced(df, 9).collect()] == chosen


def test_empty_grid_is_full(spark):
    none = item_source.items(spark, "/root/testdata/sf0.001").filter("false")
    cells = heatmap.grid(heatmap.signals(none, item_source.registry(spark), item_source.now()), item_source.now())
    assert cells.count() == 30 and cells.filter("score <> 0 OR level <> 'No Signals'").count() == 0


def test_movement(spark):
    rows = spark.createDataFrame([(1, "Justice Mary Tan appointed as judge of the High Court", "", "Press Release/Judiciary Updates"), (2, "Chief Justice gives keynote speech", "", "Legal News"), (3, "Nothing", "", "Legal News")], "id int, title string, summary string, category string").withColumns({"country": F.lit("Singapore"), "source": F.lit("Judiciary"), "source_tab": F.lit(None).cast("string")})
    got = movements.detect_movements(rows).collect()
    assert [(r["id"], r["movement_type"], r["judge_name"], r["court"], r["status"]) for r in got] == [(1, "appointment", "Mary Tan", "High Court", "detected")]


def test_drafts(spark):
    rows = [(1, "appointment", "Mary Tan", "High Court", "Judge"), (2, "retirement", "Mary Tan", "", ""), (3, "elevation", "", "", ""), (4, "honour", "Mary Tan", "", "")]
    made = movements.draft(spark.createDataFrame(rows, "id int, movement_type string, judge_name string, court string, new_role string")).orderBy("id").collect()
    assert [(r["subject"], r["missing"], r["can_approve"]) for r in made] == [
        ("Congratulations on your appointment as Judge", [], True),
        ("Congratulations on your judicial service", [], True),
        ("Congratulations on your appointment as [New Role]", ["judge name", "new role or court"], False),
        ("Congratulations on your appointment as this honour", [], True),
    ]


def test_carry_forward_stops(spark):
    rows = spark.createDataFrame([(1, 0, "d1"), (1, 1, "h:x"), (1, 2, "a"), (1, 3, "d2"), (1, 4, "b"), (1, 5, "STOP"), (1, 6, "c"), (2, 0, "z")], "page_id int, pos int, t string")
    t = F.col("t")
    got = positional.carry_forward(rows, date=F.when(t.startswith("d"), t), heading=F.when(t.startswith("h:"), t), stop=t == "STOP").orderBy("page_id", "pos").collect()
    assert [(r["t"], r["current_date"], r["current_heading"]) for r in got] == [("d1", "d1", None), ("h:x", "d1", "h:x"), ("a", "d1", "h:x"), ("d2", "d2", None), ("b", "d2", None), ("z", None, None)]


def test_markup_scans(spark):
    html = '<nav><li>Menu entry here</li></nav><ul><li><a href="/a">First story title</a> <time datetime="2024-01-02T00:00">x</time></li><li><a href="/b">first story TITLE</a></li><li>Second story, 3 May 2023</li></ul><table><tr><td>Ministry Rules</td><td>CG-DL-E-01012024-123456</td><td>01 Jan 2024</td></tr></table>'
    nodes = markup.page_nodes(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string"))
    got = [(r["title"], r["link"], str(r["date"])) for r in markup.node_items(nodes).orderBy("pos").collect()]
    assert got == [("First story title x", "/a", "2024-01-02"), ("first story TITLE", "/b", "None"), ("Second story, 3 May 2023", None, "2023-05-03")]
    assert [r["title"] for r in markup.gazette_rows(nodes).collect()] == ["Ministry Rules"]
    feed = "<rss><item><title><![CDATA[A & B]]></title><link>http://x.org/1?utm_source=a</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item><item><title>Two</title></item></rss>"
    got = markup.rss_items(spark.createDataFrame([("s", feed), ("t", "broken")], "source string, xml string")).collect()
    assert [(r["pos"], r["title"], r["link"], str(r["date"])) for r in got] == [(0, "A & B", "http://x.org/1", "2024-01-02"), (1, "Two", got[1]["link"], "None")]


def test_failing_summariser_falls_back(spark):
    def fails(_: str) -> str:
        raise RuntimeError("no provider")

    rows = spark.createDataFrame([(1, "One. Two.", None), (2, None, "short"), (3, None, None)], "id int, content string, summary string")
    got = {r["id"]: (r["status"], r["text"], r["error"]) for r in summarize.summarize(rows, fails).collect()}
    assert got == {1: ("error", "", "no provider"), 2: ("error", "", "no provider"), 3: ("error", "", "nothing to summarise")}
    assert {r["id"]: r["text"] for r in summarize.summarize(rows, summarize.resolve({"remote": None})).collect()} == {1: "One. Two.", 2: "short", 3: ""}
    assert [r["error"] for r in summarize.summarize(rows, allowed=F.col("id") < 0).collect()] == ["Only public http(s) source URLs can be summarized."] * 3
    with pytest.raises(ValueError):
        summarize.resolve({"remote": None}, "remote")


def test_spellings_of_patterns():
    assert sorted("".join(p) for p in matching.spellings("licen[cs]ed?")) == ["licence", "licenced", "license", "licensed"]
    assert matching.spellings(r"c\.?a\.?\s+no") == [["c.a.", "no"], ["c.a", "no"], ["ca.", "no"], ["ca", "no"]]
    for odd in ("a(b)", "a+", "x{2}", ".", r"\d"):
        with pytest.raises(ValueError):
            matching.spellings(odd)


def test_one_pass_finds_what_regular_expressions_find(spark):
    """Every lexicon and pattern, on texts made of their own words and of what almost is one."""
    import random
    import re

    terms = {f"t{i}": tuple(d[3]) for i, d in enumerate(lexicon.RISK_DOMAINS)} | {"odd": ("import/export", "a.b", "é", "x y", "-", "_a", "ai")}
    patterns = {f"p{i}": r[1] for i, r in enumerate(lexicon.TOPIC_RULES)} | {f"s{i}": r[2] for i, r in enumerate(lexicon.SIGNAL_RULES)} | {"cause": lexicon.CAUSE_LIST_WORDS, "odd": r"a\d+|ai", "court": lexicon.COURT_TOPIC_WORDS}
    by_term, by_pattern = matching.Lexicons(matching.TERM, **terms), matching.Lexicons(matching.PATTERN, **patterns)
    rng = random.Random(4)
    pieces = sorted({p for ts in terms.values() for t in ts for p in (t, *t.split())} | {p for x in patterns.values() for a in x.split("|") for p in (re.sub(r"\\s\+", " ", a).replace("\\", "").replace("?", ""), a[:3])} | {"c.a. no", "crla", "a77", "judgement s", "É"})
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", " ", "  ", "-", "_", ".", "", "\n", "é"]) for _ in range(rng.randrange(8))).lower() for _ in range(600)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    t, w1, w2 = F.col("t"), F.col("w1"), F.col("w2")
    found = settled(rows, {"w1": by_term.words(t), "w2": by_pattern.words(t)})
    got = found.select("t", *[by_term.any(k, w1, t).alias(k) for k in terms if k != "odd"], by_term.which("odd", w1, t).alias("which"), *[by_pattern.any(k, w2, t).alias(k) for k in patterns], text.any_word(t, "ai|e-?filing").alias("alone")).collect()
    for r in got:
        for k, ts in terms.items():
            hits = [x for x in ts if re.search(rf"(?<![a-z0-9]){re.escape(x)}(?![a-z0-9])", r["t"])]
            assert r["which"] == hits if k == "odd" else r[k] == bool(hits), (k, r["t"])
        for k, p in patterns.items():
            assert r[k] == bool(re.search(rf"(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_])", r["t"])), (k, r["t"])
        assert r["alone"] == bool(re.search(r"(?<![A-Za-z0-9_])(?:ai|e-?filing)(?![A-Za-z0-9_])", r["t"]))


def test_texts_are_cut_into_words_once(spark):
    """One array_intersect with a vocabulary for each text, and no regular expression that scans whole texts for words."""
    rows = spark.createDataFrame([(1, "t", "s", "Legal News", "src", None, "2024-01-30 00:00:00", None, "Singapore")], "id int, title string, summary string, category string, source string, source_tab string, first_seen_at string, date date, country string")
    rows = rows.withColumn("first_seen_at", F.to_timestamp("first_seen_at"))
    plan = routing.strategic_scores(routing.routing_items(rows, F.lit("2024-01-31").cast("timestamp")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") <= 3 and "(?:ai|" not in plan and "?:bill" not in plan
