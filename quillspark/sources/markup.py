"""Markup scans: nodes of HTML pages as rows, and items of RSS feeds."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexicon
from quillspark.functions.dates import feed_date, publication_date
from quillspark.functions.text import canonical_url, clean_text
from quillspark.sources.batches import pieces

SKIPPED = frozenset(("script", "style", "nav", "footer", "noscript"))
SINGLE = frozenset(("br", "img", "hr", "meta", "link", "input"))


class _Nodes(HTMLParser):
    """Flat nodes in document order: tag, classes, text, first link, first datetime."""

    def __init__(self, wanted: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.wanted, self.found, self.open, self.skipped = wanted, [], [], 0

    def handle_starttag(self, tag, attrs):
        known = dict(attrs)
        if tag in SKIPPED:
            self.skipped += 1
        if tag == "p":  # a paragraph ends the one before
            self.open = [n for n in self.open if n["tag"] != "p"]
        if tag in ("td", "th", "br"):
            for n in self.open:
                n["text"].append(" ")
        if tag == "a" and known.get("href"):
            for n in self.open:
                n["href"] = n["href"] or known["href"]
        if tag == "time" and known.get("datetime"):
            for n in self.open:
                n["when"] = n["when"] or known["datetime"]
        if tag in self.wanted and tag not in SINGLE and not self.skipped:
            node = {"tag": tag, "class": known.get("class") or "", "text": [], "href": known.get("href") if tag == "a" else None, "when": known.get("datetime") if tag == "time" else None}
            self.found.append(node)
            self.open.append(node)

    def handle_endtag(self, tag):
        if tag in SKIPPED and self.skipped:
            self.skipped -= 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if not self.skipped:
            for n in self.open:
                n["text"].append(data)


def page_nodes(pages: DataFrame, *, tags: tuple[str, ...] = ("h1", "h2", "h3", "h4", "li", "tr", "article", "p"), id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row for each node of the wanted tags: page, pos, tag, class, text, href, datetime. Boilerplate elements are skipped.

    Nodes go out after every few pages, so that a task's Python holds those of a piece of a batch alone.
    """
    wanted, id_type = frozenset(tags), pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            at, rows = [], []
            for i in range(batch.num_rows):
                parser = _Nodes(wanted)
                parser.feed(batch.column(1)[i].as_py() or "")
                parser.close()
                for pos, n in enumerate(parser.found):
                    at.append(i)
                    rows.append((pos, n["tag"], n["class"], " ".join("".join(n["text"]).split()), n["href"], n["when"]))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *cols], names=["id", "pos", "tag", "class", "text", "href", "datetime"])

    lean = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return lean.mapInArrow(run, f"id {id_type}, pos int, tag string, class string, text string, href string, datetime string").withColumnRenamed("id", id_col)


def node_items(nodes: DataFrame, *, id_col: str = "page_id", tags: tuple[str, ...] = ("li", "article"), least: int = 8, most: int = 25) -> DataFrame:
    """Items of list pages: title, link, date; one for each title of a page, at most ``most`` a page, after the gates."""
    from quillspark.operators.dedup import cap_per

    rows = nodes.filter(F.col("tag").isin(*tags)).select(id_col, "pos", clean_text(F.col("text"), 260).alias("title"), F.col("href").alias("link"), F.coalesce(F.substring("datetime", 1, 10).try_cast("date"), publication_date(F.col("text"))).alias("date"))
    first = rows.filter(F.length("title") >= least).groupBy(id_col, F.lower("title").alias("key")).agg(F.min_by(F.struct("pos", "title", "link", "date"), "pos").alias("r")).select(id_col, "r.*")
    return cap_per(first, id_col, most, "pos")


def page_text(nodes: DataFrame, *, id_col: str = "page_id", most: int = 12000) -> DataFrame:
    """Heading and useful paragraphs of a page, each once, joined and cut at ``most`` characters."""
    from quillspark.operators.gates import useful_paragraph

    rows = nodes.filter((F.col("tag") == "h1") | ((F.col("tag") == "p") & useful_paragraph(F.col("text"))))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return rows.groupBy(id_col).agg(F.substring(F.array_join(F.array_distinct(ordered), "\n"), 1, most).alias("content"))


def gazette_rows(nodes: DataFrame, *, id_col: str = "page_id") -> DataFrame:
    """Table rows that have both a gazette id and a date, titles rid of both."""
    from quillspark.functions.text import gazette_text

    t = F.col("text")
    both = t.rlike(lexicon.GAZETTE_ID) & publication_date(t).isNotNull()
    return nodes.filter((F.col("tag") == "tr") & both).select(id_col, "pos", gazette_text(t).alias("title"), publication_date(t).alias("date"))


def rss_items(feeds: DataFrame, *, source_col: str = "source", xml_col: str = "xml", most: int = 25) -> DataFrame:
    """The first ``most`` entries of each feed: source, pos, title, summary, link, date. Broken feeds give no entries."""
    entry = F.regexp_extract_all(F.col(xml_col), F.lit(r"(?s)<item\b.*?</item>"), F.lit(0))

    def field(body: Column, name: str) -> Column:
        raw = F.regexp_extract(body, rf"(?s)<{name}\b[^>]*>(.*?)</{name}>", 1)
        return F.regexp_replace(raw, r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1")

    rows = feeds.select(source_col, F.posexplode(F.slice(entry, 1, most)).alias("pos", "body"))
    b = F.col("body")
    return rows.select(source_col, "pos", clean_text(field(b, "title"), 260).alias("title"), clean_text(field(b, "description"), 520).alias("summary"), canonical_url(field(b, "link")).alias("link"), feed_date(field(b, "pubDate")).alias("date"))
