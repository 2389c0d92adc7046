"""The trigram index against plain searches, deep pages against sorted rows, and what their plans read."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import listing, pages, search_index
from quillspark.session import scratch


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    words = ["Court", "of", "APPEAL", "é", "100%", "a_b", "x", "der Straße", "\n", "ab", "back\\slash", ""]
    made = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(4))), None if i % 9 == 0 else " ".join(rng.choice(words) for _ in range(12)), rng.choice(["s1", "İs", None]), i % 5) for i in range(300)]
    made += [(1000, "a", "", "", 0), (1000, "a", "", "", 0), (None, "court", "court", "court", 0)]
    return spark.createDataFrame(made, "id long, title string, summary string, source string, gram int").repartition(3)


def test_search_finds_what_ilike_finds(spark, rows):
    root = scratch(spark, "index")
    search_index.build_index(rows, root)
    for q in ("court", "COURT OF", "t of a", "é", "a", "ab", "%", "_", "", "a_b", "o%l", "\\%", "a\\_b", "100\\%", "\\\\s", "zzz", "e\nx", " ", "ß", "i̇s", "s1"):
        plain = rows.filter(F.col("id").isNotNull()).filter(F.col("title").ilike(f"%{q}%") | F.col("summary").ilike(f"%{q}%") | F.col("source").ilike(f"%{q}%"))
        got = search_index.search(rows.filter(F.col("id").isNotNull()), root, q)
        assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in plain.collect()), q
        assert got.columns == rows.columns
    empty = scratch(spark, "index")
    search_index.build_index(rows.limit(0), empty)
    assert search_index.search(rows.limit(0), empty, "court").collect() == []


def test_index_is_written_in_even_shares(spark, rows, monkeypatch):
    """Each file holds one share of one folder, so no task sorts several of them; grams know their postings."""
    monkeypatch.setattr(search_index, "PART_ROWS", 100_000)
    monkeypatch.setattr(search_index, "SHARE_ROWS", 20_000, raising=False)
    root = scratch(spark, "index")
    search_index.build_index(rows, root)
    postings, shares = spark.read.parquet(f"{root}/postings"), -(-303 * 1000 // (3 * 20_000))
    share = F.pmod(F.xxhash64("key"), F.lit(shares))
    files = postings.groupBy(F.input_file_name().alias("f")).agg(F.countDistinct("part", share).alias("n"), F.first(share).alias("share"), F.first("part").alias("part"))
    got = files.collect()
    assert len(got) > 3 * 4 and {r["n"] for r in got} == {1} and len({(r["part"], r["share"]) for r in got}) == len(got)
    counted = {(r["part"], r["gram"]): r["n"] for r in spark.read.parquet(f"{root}/grams").collect()}
    assert counted == {(r["part"], r["gram"]): r["count"] for r in postings.groupBy("part", "gram").count().collect()}


def test_listing_with_an_index_reads_postings(spark, rows):
    root = scratch(spark, "index")
    items = rows.filter("id < 1000").withColumns({"date": F.lit("2024-01-01").cast("date"), "first_seen_at": F.lit("2024-01-01").cast("timestamp")})
    search_index.build_index(items, root)
    now = F.lit("2024-01-02").cast("timestamp")
    page = listing.list_items(items, now, q="appeal", index=root)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram," in plan and "PartitionFilters: [isnotnull(part" in plan and "LeftSemi" in plan
    assert [r["id"] for r in page.collect()] == [r["id"] for r in listing.list_items(items, now, q="appeal").collect()]


def test_literals_of_patterns():
    assert search_index.literals("A%b_c\\%d\\\\") == ["a", "b", "c%d\\"] and search_index.literals("%_") == []


def test_deep_pages_are_read_from_one_range(spark):
    rng = random.Random(1)
    day = lambda: None if rng.random() < 0.2 else dt.date(2024, 1, 1 + rng.randrange(28))
    made = [(i, day(), dt.datetime(2024, 1, 1, rng.randrange(24))) for i in range(5000)]
    items = spark.createDataFrame(made, "id long, date date, first_seen_at timestamp").repartition(4)
    root = scratch(spark, "ranges")
    pages.write_ranges(items, root, range_rows=300)
    want = [r["id"] for r in items.orderBy(*pages.newest_first()).collect()]
    for offset in (0, 295, 2500, 4990, 5000, 9000):
        assert [r["id"] for r in pages.page(spark, root, limit=20, offset=offset).collect()] == want[offset : offset + 20]
    read = pages.page(spark, root, limit=20, offset=2500)._jdf.queryExecution().executedPlan().toString()
    asked = read.split("PartitionFilters: [")[1].split("]")[0]
    assert "range#" in asked and asked.count(",") <= 1 + asked.count("isnotnull")  # one range, or two neighbours
    nothing = scratch(spark, "ranges")
    pages.write_ranges(items.limit(0), nothing)
    assert pages.page(spark, nothing, limit=5, offset=0).collect() == []


def test_small_ranges_need_no_tasks_of_their_own(spark):
    items = spark.range(2000).select("id", F.lit("2024-01-01").cast("date").alias("date"), F.lit("2024-01-01").cast("timestamp").alias("first_seen_at")).repartition(4)
    root = scratch(spark, "ranges")
    pages.write_ranges(items, root, range_rows=50)
    ranges = spark.read.parquet(f"{root}/ranges").orderBy("range").collect()
    assert [(r["n"], r["before"]) for r in ranges] == [(50, 50 * i) for i in range(40)]
    assert [r["id"] for r in pages.page(spark, root, limit=30, offset=985).collect()] == list(range(985, 1015))


def test_pages_of_countries(spark):
    made = [(i, "ABC"[i % 3], dt.date(2024, 1, 1 + i % 5) if i % 4 else None, dt.datetime(2024, 1, 9, i % 24)) for i in range(60)]
    items = spark.createDataFrame(made, "id long, country string, date date, first_seen_at timestamp")
    newest = lambda rows: sorted(rows, key=lambda r: (r[2] is None, -(r[2] or dt.date.min).toordinal(), -r[3].timestamp(), r[0]))
    want = [r[0] for c in "CA" for r in newest([x for x in made if x[1] == c])[:7]]
    got = listing.pages_by(items, "country", ("C", "A", "C"), limit=7)
    assert [r["id"] for r in got.orderBy("place").collect()] == want
    chosen = [r for r in made if r[0] in want]
    when = lambda r: dt.datetime.combine(r[2], dt.time()) if r[2] else r[3]
    merged = sorted(chosen, key=lambda r: (-when(r).timestamp(), -r[3].timestamp(), r[0]))
    assert [r["id"] for r in listing.merged_pages(got.unionByName(got)).dropDuplicates(["id"]).orderBy("id").collect()] == sorted(want)
    assert [r["id"] for r in listing.merged_pages(got).collect()] == [r[0] for r in merged]
