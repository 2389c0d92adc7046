"""Main-text extraction with a site style tree.

The pages of a host are merged into one style tree: a node stands for all elements of the same path of tags
and classes. For every node the spread of its presentation (sequences of children) and of its content (text)
over the host's pages is measured as normalised entropy; their weighted sum is the node's importance. What
looks and reads alike on page after page, such as a menu or a notice, comes out low.

A page's branch goes if its node is of low importance, inside article and main elements too. Pages of a host with one
main text are copies and count once, so that a copied article does not measure as boilerplate. Two priors stand above
the entropy, since adverts, menus and comments may differ from page to page: elements whose tag, role, style or class
names say that they are page furniture have no importance, and article or main elements themselves stay. Names that prose
may bear as well (``SOFT_NAMES``) say so inside an article only of branches that are mostly links. Where a page has
article or main elements, its text is what is left of theirs; else it is what is left of the body, and if nothing would
be left, low-importance branches stay.

Pages shuffle only if their host is neither large nor absent from the table of low branches: hosts with more than one
page in ``HOT`` are fewer than that, and their branches are broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.lineage import cut

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
ENDS_P = BLOCK - frozenset("head html body title option td th tr tbody thead tfoot legend".split())
FURNITURE_TAGS = frozenset("head script style noscript template iframe object svg canvas nav footer aside form button select input textarea dialog menu search audio video".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments disqus respond reply replies "
    "newsletter subscribe subscription signup login paywall widget toolbar pagination pager".split()
)
SOFT_NAMES = frozenset("share sharing social related recommended".split())
#: Parts of class names that say nothing of what stands in a branch.
LAYOUT_NAMES = frozenset("bar block box btn button col column container content d field footer frame global group header holder hidden home icon id inline inner item items js layout left link links list main mobile module outer page panel right row section site slot small static sticky strip text top unit wide wrap wrapper zone".split())
HIDING_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)
#: What an element's start tag closes, if it is open in the same list or table.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
NEUTRAL, FURNITURE, ARTICLE, SOFT = 0, 1, 2, 3
#: Elements deeper than this share the style node of their ancestor at this depth.
MAX_STYLE_DEPTH = 24
#: A host with more than one page in so many is large; their paths are broadcast up to so many characters, else salted.
HOT, BROADCAST_CHARS, SALTS = 400, 32_000_000, 64


class PageTree(HTMLParser):
    """A page as a flat list of nodes, parents first, and its texts and block ends in order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.parent, self.path, self.prior = ["#root"], [-1], [""], [NEUTRAL]
        self.styled, self.in_article = [0], [False]  # the ancestor that bears a node's style; whether an article encloses it
        self.events: list[tuple[int, str | None]] = []
        self.open, self.opened = [0], Counter()
        self.feed(html)
        self.close()
        self._settle_soft()

    def _prior(self, tag: str, attrs: dict[str, str | None]) -> int:
        words = [[p for p in re.split(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])", w) if p] for w in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split()]
        names = {p for w in words for p in w}
        # A name tells if it is made of furniture and layout alone; with other parts beside, it may be prose's own.
        telling = any(FURNITURE_NAMES.intersection(w) and all(p in FURNITURE_NAMES or p in LAYOUT_NAMES or p in SOFT_NAMES or p.isdigit() for p in w) for w in words)
        role = (attrs.get("role") or "").lower()
        inside = self.in_article[self.open[-1]]
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or HIDING_STYLE.search(attrs.get("style") or "")
        if tag in FURNITURE_TAGS or role in FURNITURE_ROLES or telling or hidden or (tag == "header" and not inside):
            return FURNITURE
        if tag in ("article", "main") or role in ("main", "article"):
            return ARTICLE
        if names & SOFT_NAMES:
            return SOFT if inside else FURNITURE
        return SOFT if names & FURNITURE_NAMES else NEUTRAL

    def _settle_soft(self) -> None:
        """Suspected branches are furniture if more than half of their characters stand in links; else the tree decides."""
        if SOFT not in self.prior:
            return
        n = len(self.tags)
        every, linked, link = [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            link[i] = self.tags[i] == "a" or link[self.parent[i]]
        for i, data in self.events:
            if data:
                every[i] += (size := len(data.strip()))
                linked[i] += size * link[i]
        for i in range(n - 1, 0, -1):
            every[self.parent[i]] += every[i]
            linked[self.parent[i]] += linked[i]
        for i in range(1, n):
            if self.prior[i] == SOFT:
                self.prior[i] = FURNITURE if 2 * linked[i] > every[i] else SOFT

    def _shut(self, at: int) -> None:
        self.opened.subtract(self.tags[i] for i in self.open[at:])
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SIBLINGS and any(self.opened[t] for t in SIBLINGS[tag]):
            for at in range(len(self.open) - 1, 0, -1):
                name = self.tags[self.open[at]]
                if name in SCOPES[tag]:
                    break
                if name in SIBLINGS[tag]:
                    self._shut(at)
                    break
        elif tag in ENDS_P and self.opened["p"]:
            for at in range(len(self.open) - 1, 0, -1):
                name = self.tags[self.open[at]]
                if name == "p":
                    self._shut(at)
                    break
                if name in BLOCK:
                    break
        if tag in BLOCK:
            self.events.append((-1, None))
        if tag in VOID:
            if tag == "br":
                self.events.append((self.open[-1], " "))
            return
        known = dict(attrs)
        up = self.open[-1]
        deep = len(self.open) > MAX_STYLE_DEPTH
        sign = ".".join([tag, *sorted((known.get("class") or "").lower().split())])
        prior = self._prior(tag, known)
        self.path.append(self.path[up] if deep else f"{self.path[up]}/{sign}")
        self.prior.append(prior)
        self.tags.append(tag)
        self.parent.append(up)
        self.open.append(len(self.tags) - 1)
        self.opened[tag] += 1
        self.styled.append(self.styled[up] if deep else len(self.tags) - 1)
        self.in_article.append(self.in_article[up] or prior == ARTICLE)

    def handle_endtag(self, tag: str) -> None:
        if self.opened[tag]:
            for at in range(len(self.open) - 1, 0, -1):
                if self.tags[self.open[at]] == tag:
                    self._shut(at)
                    break
        if tag in BLOCK:
            self.events.append((-1, None))

    def handle_data(self, data: str) -> None:
        self.events.append((self.open[-1], data))

    def styles(self) -> list[tuple[str, int, int]]:
        """For each path of the page: the path, the hash of its children's sequence, the hash of its text.

        Branches that go by the priors have no style: the tree is not asked about them.
        """
        gone = self._gone()
        kids: dict[str, list[str]] = {}
        for i in range(1, len(self.tags)):
            if not gone[i]:
                kids.setdefault(self.path[i], [])
                kids.setdefault(self.path[self.parent[i]], []).append(self.tags[i])
        text: dict[str, xxhash.xxh3_64] = {p: xxhash.xxh3_64() for p in kids}
        for i, data in self.events:
            if data and not data.isspace() and not gone[i]:
                raw, i, seen = data.encode("utf-8", "replace"), self.styled[i], set()
                while i > 0:
                    if self.path[i] not in seen:
                        seen.add(self.path[i])
                        text[self.path[i]].update(raw)
                    i = self.parent[i]
        signed = lambda n: n - (1 << 64) if n >> 63 else n
        return [(p, signed(xxhash.xxh3_64_intdigest("/".join(k))), signed(text[p].intdigest())) for p, k in kids.items() if p]

    def _gone(self) -> list[bool]:
        gone = [False] * len(self.tags)
        for i in range(1, len(gone)):
            gone[i] = gone[self.parent[i]] or self.prior[i] == FURNITURE
        return gone

    def main_text(self, low: frozenset[str] = frozenset(), dim: frozenset[str] = frozenset()) -> str:
        """The blocks that stay, joined by line breaks: branches of the ``low`` paths go, suspected ones of the ``dim`` paths too."""
        n = len(self.tags)
        gone, inside = self._gone(), [False] * n
        for i in range(1, n):
            up = self.parent[i]
            inside[i] = not gone[i] and (inside[up] or self.prior[i] == ARTICLE)
        kept = inside if any(inside) else [not g for g in gone]
        dropped = [False] * n
        for i in range(1, n):
            up = self.parent[i]
            outer = dropped[up] and (kept[up] or not inside[i])
            dropped[i] = outer or ((self.path[i] in low or self.prior[i] == SOFT and self.path[i] in dim) and not (inside[i] and self.prior[i] == ARTICLE))
        return self._blocks([k and not d for k, d in zip(kept, dropped, strict=True)]) or self._blocks(kept)

    def _blocks(self, stays: list[bool]) -> str:
        blocks, now = [], []
        for i, data in [*self.events, (-1, None)]:
            if data is None:
                if block := " ".join("".join(now).split()):
                    blocks.append(block)
                now = []
            elif stays[i]:
                now.append(data)
        return "\n".join(blocks)


def site_styles(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", weight: float = 0.9) -> DataFrame:
    """The merged style trees: host, path, pages, importance (0 to 1) of every style node.

    Importance is (1 - weight) * entropy of presentation + weight * entropy of content, each over the log of the
    number of pages that have the node; a node on one page alone has importance 1. Pages with one main text, by the
    priors alone, are one page. Pages without a host are left out.
    """
    lean = pages.select(F.lower(F.try_parse_url(F.col(url_col), F.lit("HOST"))).alias("host"), F.col(html_col).alias("html")).filter(F.col("host").isNotNull() & F.col("html").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tree = PageTree(html.as_py())
                page = xxhash.xxh3_64_intdigest(tree.main_text().encode("utf-8", "replace"))
                rows += [(host, page - (1 << 64) if page >> 63 else page, *s) for s in tree.styles()]
            kinds = {"host": pa.string(), "page": pa.int64(), "path": pa.string(), "style": pa.int64(), "content": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    nodes = lean.mapInArrow(run, "host string, page long, path string, style long, content long")
    nodes = nodes.groupBy("host", "path", "page").agg(F.min(F.struct("style", "content")).alias("s")).select("host", "path", "s.style", "s.content")
    kinds = nodes.select("host", "path", F.explode(F.create_map(F.lit("style"), "style", F.lit("content"), "content")).alias("kind", "value"))
    counts = kinds.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n"))
    spread = counts.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == "style", F.col("n"))).alias("pages"),
        *[F.sum(F.when(F.col("kind") == k, F.col("n") * F.log("n"))).alias(k) for k in ("style", "content")],
    )
    entropy = lambda k: 1 - F.col(k) / F.col("pages") / F.log("pages")
    importance = F.when(F.col("pages") > 1, (1 - weight) * entropy("style") + weight * entropy("content")).otherwise(1.0)
    return spread.select("host", "path", "pages", importance.alias("importance"))


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.3, suspected: float = 0.7, min_pages: int = 3) -> DataFrame:
    """id, url and main text of every page; importance below ``threshold`` is low, below ``suspected`` for suspected branches.

    Null and empty html give an empty text. A page without a usable url has no style tree, only the priors.
    Repeated rows and ids stay as they are; broken markup is read as far as it goes. Other columns are ignored.
    """
    styles = site_styles(pages, url_col=url_col, html_col=html_col).filter(F.col("pages") >= min_pages)
    # Of the paths between the bounds only those are needed whose last element has a name that can raise a suspicion.
    doubtful = F.lower(F.substring_index("path", "/", -1)).rlike("[.](?:.*[^a-z0-9])?(?:" + "|".join(sorted(FURNITURE_NAMES | SOFT_NAMES)) + ")(?:[^a-z]|$)")
    is_low = F.col("importance") < threshold
    low = styles.filter(is_low | (F.col("importance") < suspected) & (threshold >= 0) & doubtful).select("host", F.concat(F.when(is_low, "").otherwise("?"), F.col("path")).alias("path"))
    host = F.lower(F.try_parse_url(F.col(url_col), F.lit("HOST")))
    held = pages.groupBy(host.alias("host")).agg(F.count("*").alias("n"))
    site = held.join(low.groupBy("host").agg(F.collect_set("path").alias("low")), "host", "left")
    site = cut(site.select("host", "n", F.coalesce("low", F.array().cast("array<string>")).alias("low")).filter(F.col("host").isNotNull()))
    large = max(1000, pages.select(id_col).count() // HOT)
    lean = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    big = site.filter(F.col("n") > large).select("host", "low")
    # Large hosts are few, but their lists can be long: they are broadcast where they measure small, else spread by salt.
    if (big.agg(F.sum(F.length(F.array_join("low", " ")))).first()[0] or 0) <= BROADCAST_CHARS:
        joined = lean.join(F.broadcast(big), "host", "left")
    else:
        spread = big.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = lean.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(spread, ["host", "salt"], "left").drop("salt")
    rest = site.filter((F.col("n") <= large) & (F.size("low") > 0)).select("host", "low")
    if not rest.isEmpty():
        plain = F.col("low").isNull() & F.col("host").isNotNull()
        joined = joined.filter(~plain).unionByName(joined.filter(plain).drop("low").join(rest, "host", "left"))
    joined = joined.select("id", "url", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, low in zip(batch.column(2), batch.column(3), strict=True):
                paths = low.as_py() or ()
                sure, dim = frozenset(p for p in paths if p[:1] != "?"), frozenset(p[1:] for p in paths if p[:1] == "?")
                texts.append(PageTree(h).main_text(sure, dim) if (h := html.as_py()) else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, type=pa.string())], names=["id", "url", "text"])

    return joined.mapInArrow(run, f"id {lean.schema['id'].dataType.simpleString()}, url string, text string").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
