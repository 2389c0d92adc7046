"""Feeds as a data source: ``spark.read.format("feeds")`` gives the entries of feed files or addresses.

    read = spark.read.format("feeds").option("registry", json).option("entries", 25).load()

The registry is a JSON list of objects with id and url, of files or of http(s) addresses. Each feed is a partition of its
own; where the session lets filters reach Python data sources (``PUSHDOWN``), one on ``source`` is pushed down, so other
feeds are not fetched. Spark 4.1 keeps a pushed filter with the loaded frame: load anew for each such filter. A feed that cannot be fetched or read gives
one row with its ``error`` and nothing else, so that a refresh can report the run.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit
from urllib.request import urlopen
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "source string, pos int, title string, link string, summary string, published string, error string"
#: The session's setting that lets a data source written in Python see filters.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Feed(InputPartition):
    def __init__(self, source: str, url: str):
        super().__init__(source)
        self.source, self.url = source, url


def fetch(url: str, seconds: float) -> bytes:
    """The bytes of a file or an address."""
    if urlsplit(url).scheme in ("http", "https"):
        with urlopen(url, timeout=seconds) as answer:  # noqa: S310
            return answer.read()
    with open(url.removeprefix("file://"), "rb") as f:
        return f.read()


def _local(tag: object) -> str:
    return str(tag).rpartition("}")[2]


def read_entries(xml: bytes, most: int) -> Iterator[tuple]:
    """pos, title, link, summary and date of the first entries of an RSS or Atom feed, as the feed spells them."""
    nodes = [n for n in ElementTree.fromstring(xml).iter() if _local(n.tag) in ("item", "entry")]
    for pos, node in enumerate(nodes[:most]):
        fields: dict[str, str] = {}
        for child in node:
            fields.setdefault(_local(child.tag), "".join(child.itertext()).strip() or child.get("href") or "")
        first = lambda *names, fields=fields: next((fields[n] for n in names if fields.get(n)), "")
        yield pos, first("title"), first("link", "guid", "id"), first("description", "summary", "content"), first("pubDate", "published", "updated", "date")


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.feeds = [(f["id"], f["url"]) for f in json.loads(options.get("registry", "[]"))]
        self.most, self.seconds = int(options.get("entries", "25")), float(options.get("seconds", "18"))

    def partitions(self) -> list[InputPartition]:
        return [Feed(*x) for x in self.feeds] or [Feed("", "")]

    def read(self, partition: Feed) -> Iterator[tuple]:
        if not partition.source:
            return
        try:
            rows = [(partition.source, *e, None) for e in read_entries(fetch(partition.url, self.seconds), self.most)]
        except Exception as failed:  # whatever goes wrong with one feed is that feed's run, not the job's
            rows = [(partition.source, None, None, None, None, None, str(failed) or type(failed).__name__)]
        yield from rows


class FilteredFeedReader(FeedReader):
    """The reader of sessions that push filters; Spark refuses it in others."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("source",):
                self.feeds = [x for x in self.feeds if x[0] == f.value]
            elif isinstance(f, In) and f.attribute == ("source",):
                self.feeds = [x for x in self.feeds if x[0] in f.value]
            else:
                yield f


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (FilteredFeedReader if self.options.get("pushdown") == "true" else FeedReader)(self.options)


def read_feeds(spark: SparkSession, registry: list[dict], *, entries: int = 25) -> DataFrame:
    """The entries of a registry's feeds (objects with id and url), and the errors of those that failed."""
    spark.dataSource.register(FeedSource)
    return spark.read.format("feeds").option("registry", json.dumps(registry)).option("entries", entries).option("pushdown", spark.conf.get(PUSHDOWN, "false")).load()


def entries_and_scans(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feed rows as ``refresh`` takes them: entries (source, pos, title, summary, link, date, seq) and scans (source, error)."""
    from quillspark.functions.dates import feed_date
    from quillspark.functions.text import canonical_url, clean_text

    good = read.filter(F.col("error").isNull())
    entries = good.select("source", "pos", clean_text(F.col("title"), 260).alias("title"), clean_text(F.col("summary"), 520).alias("summary"), canonical_url(F.col("link")).alias("link"), feed_date(F.col("published")).alias("date"), F.col("pos").alias("seq"))
    return entries, read.groupBy("source").agg(F.max("error").alias("error"))
