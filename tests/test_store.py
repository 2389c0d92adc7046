"""The item store: merges, deltas and compaction against plain merges, and what a merge exchanges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspark.operators.merge import merge_counts, merge_items
from quillspark.session import scratch
from quillspark.streaming.store import ItemStore

KINDS = "fingerprint string, country string, title string, summary string, category string, source_tab string, date date, link string, first_seen_at timestamp, last_seen_at timestamp"


def at(day):
    return F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp")


def items(spark, ids, word, day):
    rows = [(f"f{i}", "India", f"{word} {i}", "" if i % 3 == 0 else f"{word} text {i}", "Legal News", None if i % 2 else word, dt.date(2024, 1, day) if i % 4 else None, f"l{i}" if i % 5 else "") for i in ids]
    return spark.createDataFrame(rows, KINDS.split(", first_seen_at")[0])


def stored(spark, ids):
    return items(spark, ids, "old", 1).withColumns({"first_seen_at": at(1), "last_seen_at": at(2)})


def batch(spark, ids, word, day):
    one = items(spark, ids, word, day).withColumn("seq", F.lit(1))
    return one.unionByName(items(spark, list(ids)[:5], word + " earlier", day).withColumn("seq", F.lit(0)))


def rows(df):
    return sorted(map(tuple, df.select([f.split()[0] for f in KINDS.split(", ")]).collect()))


@pytest.fixture
def store(spark):
    s = ItemStore(spark, scratch(spark, "store"), stored(spark, [0]).schema, bucket_rows=60, most_deltas=3)
    s.create(stored(spark, range(200)))
    return s


def test_merges_equal_plain_merges(spark, store):
    plain = stored(spark, range(200))
    for day, ids in ((5, range(150, 260)), (6, range(90, 120)), (7, [])):
        new = batch(spark, ids, f"new{day}", day)
        merged = merge_items(plain, new, at(day))
        assert store.merge(new, at(day)).first() == merge_counts(merged).first()
        plain = spark.createDataFrame(merged.drop("action").collect(), plain.schema)
        assert rows(store.read()) == rows(plain)


def test_deltas_equal_plain_merges(spark, store):
    plain = stored(spark, range(200))
    for n, (day, ids) in enumerate(((5, range(150, 260)), (6, range(90, 220)), (8, range(240, 300)), (9, range(0, 10)))):
        new = batch(spark, ids, f"new{day}", day)
        plain = spark.createDataFrame(merge_items(plain, new, at(day), recategorise=True).drop("action").collect(), plain.schema)
        store.append(new, at(day))
        assert rows(store.read()) == rows(plain), n
    state = store.state()
    assert len(state["deltas"]) == 1 and state["buckets"] == 4
    again = ItemStore(spark, store.root, store.schema)
    assert rows(again.read()) == rows(plain)


def test_a_merge_exchanges_the_batch_alone(spark, store):
    s = store.state()
    new = batch(spark, range(10), "x", 5)
    plan = store._merged(store.base(s), new, s["buckets"], at(5))._jdf.queryExecution().executedPlan().toString()
    side = next(line for line in plan.splitlines() if "Bucketed: true" in line)
    before = plan[: plan.index(side)].splitlines()
    join = max(i for i, line in enumerate(before) if "SortMergeJoin" in line)
    assert not any("Exchange" in line for line in before[join:])


def test_readers_see_whole_states(spark, store):
    before = rows(store.read())
    old, state = store.base(store.state()), store.state()
    store.merge(batch(spark, range(50), "x", 5), at(5))
    assert rows(old) == before and store.state()["version"] == state["version"] + 1


def test_a_merge_exchanges_last_rows_alone(spark, store):
    """Rows of a fingerprint that a later one replaces are dropped before the batch goes to buckets."""
    many = items(spark, range(7), "new", 5).withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(500)))).withColumn("summary", F.concat("summary", F.lit(" "), "seq"))
    plan = store._merged(store.base(), many, 4, at(6))._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("WindowGroupLimit") > plan.rindex("Exchange hashpartitioning(fingerprint")
    store.merge(many, at(6))
    assert rows(store.read()) == rows(merge_items(stored(spark, range(200)), many, at(6)))
