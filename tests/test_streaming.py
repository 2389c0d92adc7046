"""Real streams of several micro-batches against batch versions of what they compute."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from quillspark.session import scratch
from quillspark.streaming import ingest, runs
from quillspark.streaming.store import ItemStore

T0 = dt.datetime(2024, 1, 10)


def hours(n):
    return T0 + dt.timedelta(hours=n)


def streamed(spark, kinds, batches, root):
    """A stream that takes each list of rows as one micro-batch, in order."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").json(f"{root}/in-{n:02d}")
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).json(f"{root}/in-*")


def ran(df, mode, root):
    """All rows that a stream gives, with the number of the micro-batch that gave them."""
    out = []
    def take(batch, n):
        out.extend((n, *r) for r in batch.collect())
    query = df.writeStream.outputMode(mode).foreachBatch(take).option("checkpointLocation", f"{root}/ck-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return out


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", runs.PROVIDER)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_redelivered_items_are_dropped_while_they_can_be_expected(spark):
    kinds = "fingerprint string, title string, fetched_at timestamp"
    batches = [
        [("a", "first", hours(0)), ("b", "b", hours(1)), ("a", "again", hours(1))],
        [("a", "redelivered", hours(5)), ("c", "c", hours(30))],
        [("b", "late, dropped", hours(0)), ("d", "d", hours(50))],
        [("e", "e", hours(51))],  # state that is past its time goes at the end of a micro-batch
        [("a", "long after", hours(60))],
    ]
    root = scratch(spark, "once")
    got = ran(ingest.once(streamed(spark, kinds, batches, root), late="24 hours"), "append", root)
    assert sorted((r[1], r[2]) for r in got if r[1] != "a") == [("b", "b"), ("c", "c"), ("d", "d"), ("e", "e")]
    assert sorted(r[2] for r in got if r[1] == "a") in (["first", "long after"], ["again", "long after"])
    flat = spark.createDataFrame([r for b in batches for r in b], kinds)
    assert {r["fingerprint"] for r in ingest.once(flat).collect()} == {r[1] for r in got}


def test_batches_reach_the_store_once(spark):
    kinds = "fingerprint string, country string, title string, summary string, category string, source_tab string, date date, link string"
    row = lambda f, s: (f, "X", f"title {f}", s, "Case Summary", "tab", None, f"l{f}")
    shape = spark.createDataFrame([], kinds + ", first_seen_at timestamp, last_seen_at timestamp").schema
    root = scratch(spark, "stream")
    store = ItemStore(spark, f"{root}/store", shape, most_deltas=2)
    store.create(spark.createDataFrame([(*row("z", "old"), T0, T0)], shape))
    now = F.lit("2024-01-31 12:00:00").cast("timestamp")
    for _ in range(2):  # the second time everything is delivered again, in new files
        batches = [[(*row("a", "one"), 1, hours(0)), (*row("a", "two"), 2, hours(0))], [(*row("b", "b"), 1, hours(1)), (*row("z", ""), 1, hours(1))], [(*row("a", ""), 1, hours(2))]]
        place = f"{root}/{uuid.uuid4().hex}"
        stream = streamed(spark, kinds + ", seq int, fetched_at timestamp", batches, place)
        query = ingest.merge_stream(stream.drop("fetched_at"), store, f"{place}/ck", now)
        query.awaitTermination(300)
        assert query.exception() is None
        assert {(r["fingerprint"], r["summary"]) for r in store.read().collect()} == {("a", "two"), ("b", "b"), ("z", "old")}
    seen = {r["fingerprint"]: (r["first_seen_at"], r["last_seen_at"]) for r in store.read().collect()}
    assert seen["z"] == (T0, dt.datetime(2024, 1, 31, 12)) and seen["a"][0] == dt.datetime(2024, 1, 31, 12)
    assert len(store.state()["deltas"]) < 2


def test_sources_go_stale_by_a_timer(spark):
    kinds = "source_id string, id long, status string, fetched_at timestamp"
    batches = [
        [("s1", 1, "ok", hours(0)), ("s2", 2, "error", hours(1)), ("s1", 3, "ok", hours(2))],
        [("s2", 4, "ok", hours(40)), ("s3", 5, "ok", hours(41))],
        [("s2", 6, "error", hours(55))],
        [("s3", 7, "ok", hours(58))],
    ]
    root = scratch(spark, "runs")
    got = ran(runs.latest_runs_stream(streamed(spark, kinds, batches, root)), "update", root)
    fired = [r for r in got if r[1] == "s1" and r[-1]]
    assert len(fired) == 1 and fired[0][0] > 0  # no run of s1 came with it: the timer gave the row
    last = {}
    for r in got:
        last[r[1]] = r[1:]
    table = spark.createDataFrame([r for b in batches for r in b], kinds)
    want = runs.latest_runs_state(table, F.lit(hours(57).strftime("%F %T")).cast("timestamp")).collect()
    assert sorted(last.values()) == sorted(map(tuple, want)) and [r["stale"] for r in sorted(want)] == [True, False, False]


def test_sliding_windows_drop_late_rows(spark):
    kinds = "ts timestamp, event_type string"
    days = lambda n: hours(24 * n)
    batches = [[(days(0), "a"), (days(1), "a"), (days(2), "b")], [(days(12), "a"), (days(1), "behind, its windows still open")], [(days(13), "b")], [(days(1), "a"), (days(14), "b")], [(days(40), "a")]]
    root = scratch(spark, "windows")
    stream = ingest.windowed_counts(streamed(spark, kinds, batches, root), width="4 days", slide="1 day", late="2 days")
    got = {}
    for r in ran(stream, "update", root):
        got[r[1:3]] = r[3]
    # From the second batch on the watermark is day 10: the row of day 1 in the fourth belongs to no window that is open.
    rows = [r for n, b in enumerate(batches) for r in b if not (n == 3 and r[0] == days(1))]
    want = {(r["start"], r["event_type"]): r["n"] for r in ingest.windowed_counts(spark.createDataFrame(rows, kinds), width="4 days", slide="1 day").collect()}
    assert got == want


def test_lookbacks_slide_with_the_days(spark):
    import random

    rng = random.Random(8)
    made = [(dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(60)), rng.choice("AB"), "d") for _ in range(120)]
    made.sort()
    kinds = "date date, country string, domain string"
    root = scratch(spark, "lookbacks")
    stream = ingest.lookback_counts(streamed(spark, kinds, [made[:50], made[50:90], made[90:]], root), late="40 days")
    got = {}
    for r in ran(stream, "update", root):
        got[r[1:3]] = r[4:]
    table = spark.createDataFrame(made, kinds)
    batch = {(r["day"], r["country"]): (r["last7"], r["previous7"], r["previous30"]) for r in ingest.lookback_counts(table).collect()}
    day = max(d for d, _, _ in made)
    age = lambda d: (day - d).days
    for c in "AB":
        own = [age(d) for d, k, _ in made if k == c]
        assert batch[day, c] == (sum(0 <= a < 7 for a in own), sum(7 <= a < 14 for a in own), sum(7 <= a < 37 for a in own))
    assert got == batch
