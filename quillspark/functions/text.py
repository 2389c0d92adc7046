"""Text functions as Column expressions; one Arrow function where the JVM has no counterpart."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import lexicon
from quillspark.functions.matching import PATTERN, TERM, Lexicons, let, quoted, texts

SPACE = r"[\s  -     　]+"


#: The characters of that class beyond ASCII. Their class is slow to match, so it is asked for only where one is there.
_RARE_SPACES = tuple(c for c in map(chr, range(128, 0x3001)) if re.fullmatch(SPACE.replace(r"\s", ""), c))
_PLAIN_RUNS = r"[\t\n\x0B\f\r][ \t\n\x0B\f\r]*| [ \t\n\x0B\f\r]+"


def _single_spaces(text: Column) -> Column:
    return let(text, lambda t: F.when(any_substring(t, _RARE_SPACES), F.regexp_replace(t, SPACE, " ")).otherwise(F.regexp_replace(t, _PLAIN_RUNS, " ")))


def squeeze(text: Column) -> Column:
    """White space runs (no-break spaces too) become one space; ends are trimmed."""
    return F.trim(_single_spaces(text))


def decode_references(text: Column) -> Column:
    """Numeric character references and the named ones of the lexicon as characters, &amp; last. Others stay."""
    names = F.expr(f"map({', '.join(f'{quoted(k)}, {v:d}' for k, v in lexicon.REFERENCES.items())})")
    char = lambda point: F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    decimal, hexadecimal = (lambda ref: F.substring(ref, 3, 7).try_cast("int")), (lambda ref: F.conv(F.substring(ref, 4, 6), 16, 10).try_cast("int"))

    def decoded(ref: Column) -> Column:
        body = F.btrim(ref, F.lit("&;"))
        point = F.when(body.rlike("^#[0-9]"), decimal(F.concat(F.lit("&"), body))).when(body.rlike("^#[xX]"), hexadecimal(F.concat(F.lit("&"), body))).otherwise(names[body])
        return F.when((point > 0) & (point < 55296) | (point > 57343) & (point < 1114112), char(point))

    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]{2,8});"), F.lit(0))))
    others = F.filter(found, lambda r: ~r.isin("&amp;", "&#38;", "&#x26;"))
    plain = F.aggregate(others, text, lambda out, ref: F.coalesce(F.replace(out, ref, decoded(ref)), out))
    return F.when(F.contains(text, F.lit("&")), F.regexp_replace(plain, "&(?:amp|#38|#x26);", "&")).otherwise(text)


def _mended(text: Column) -> Column:
    for bad, good in lexicon.MOJIBAKE.items():
        text = F.replace(text, F.lit(bad), F.lit(good))
    return text


def clean_text(text: Column, most: int | None = None) -> Column:
    """Markup and white space removed, known encoding slips mended, decorations trimmed. Null becomes empty.

    Longer texts than ``most`` are cut at most - 1 and get three dots.
    """
    out = let(decode_references(F.coalesce(text, F.lit(""))), lambda t: F.when(F.contains(t, F.lit("<")), F.regexp_replace(t, r"<[A-Za-z/!][^>]*>", " ")).otherwise(t))
    out = let(out, lambda t: F.when(any_substring(t, ("â", "Â")), _mended(t)).otherwise(t))
    out = F.btrim(_single_spaces(out), F.lit(" \t\r\n-•|"))
    if most:
        out = let(out, lambda t: F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("..."))).otherwise(t))
    return out


def normal_key(text: Column) -> Column:
    """Lower case with only a-z, 0-9 and common CJK left, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(clean_text(text)), "[^a-z0-9一-鿿]+", " "))


def any_term(text: Column, terms: Iterable[str]) -> Column:
    """Whether a lower-case text has any of the terms, bounded by characters other than a-z and 0-9: one pass."""
    terms = tuple(terms)
    lexicons = Lexicons(TERM, asked=terms)
    return lexicons.found(text, lambda words, t: lexicons.any("asked", words, t)) if terms else F.lit(False)


def any_word(text: Column, pattern: str) -> Column:
    """Whether a lower-case text has the pattern between word boundaries of letters, digits and underscores: one pass."""
    lexicons = Lexicons(PATTERN, asked=pattern)
    return lexicons.found(text, lambda words, t: lexicons.any("asked", words, t))


def matched_terms(text: Column, terms: Iterable[str]) -> Column:
    """The terms that a lower-case text has, in list order, bounded as in ``any_term``: one pass."""
    lexicons = Lexicons(TERM, asked=tuple(terms))
    return lexicons.found(text, lambda words, t: lexicons.which("asked", words, t))


def any_substring(text: Column, parts: Iterable[str]) -> Column:
    """Whether a text contains any of the parts."""
    parts = tuple(parts)
    return F.exists(texts(parts), lambda p: F.contains(text, p)) if parts else F.lit(False)


def canonical_url(url: Column) -> Column:
    """Host in lower case, tracking parameters, fragment and closing slashes dropped; an empty path is a slash."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[^:/?#]+://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(u, r"^[^:/?#]+://[^/?#]*([^?#;]*)", 1), "/+$", "")
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    # Names and values are decoded and encoded anew, so that spellings of one query are one; bytes that decode to nothing stay.
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    encoded = lambda x: F.replace(F.replace(F.url_encode(decoded(x)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    kept = F.filter(F.split(query, "&"), lambda p: (F.length(p) > 0) & ~decoded(F.substring_index(p, "=", 1)).isin(*lexicon.TRACKING_PARAMS))
    pair = lambda p: F.concat(encoded(F.substring_index(p, "=", 1)), F.lit("="), F.when(F.contains(p, F.lit("=")), encoded(p.substr(F.instr(p, "=") + 1, F.length(p)))).otherwise(""))
    asked = F.array_join(F.transform(kept, pair), "&")
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(asked == "", "").otherwise(F.concat(F.lit("?"), asked)))


def fingerprint(group: Column, title: Column, link: Column) -> Column:
    """sha-256 of the group and the normalised title, or the canonical link where the title normalises to nothing."""
    key = normal_key(title)
    return F.sha2(F.concat_ws("|", group, F.when(key != "", key).otherwise(F.coalesce(canonical_url(link), F.lit("")))).cast("binary"), 256)


def escape_html(text: Column) -> Column:
    """The five characters that markup reserves, replaced by references."""
    out = F.coalesce(text, F.lit(""))
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(ref))
    return out


def safe_href(url: Column) -> Column:
    """The url if it is http or https, else '#'."""
    return F.when(F.coalesce(F.trim(url).rlike("(?i)^https?://"), F.lit(False)), F.trim(url)).otherwise("#")


def slug(text: Column) -> Column:
    """Lower case; other characters than a-z and 0-9 become single hyphens."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")


def cut_at_word(text: Column, most: int, keep: int) -> Column:
    """Texts longer than ``most`` are cut to ``keep``, back to a word's end, and get three dots."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, keep), r"\s+\S*\z", ""), F.lit("...")))


def sentence_trim(text: Column, most: int) -> Column:
    """White space squeezed; longer texts cut at the last space before ``most``, punctuation stripped, dots added."""
    t = squeeze(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.btrim(F.regexp_replace(F.substring(t, 1, most - 3), r"\s+\S*\z", ""), F.lit(" .,;:")), F.lit("...")))


def cut_short(text: Column, most: int) -> Column:
    """White space squeezed; longer texts are cut to ``most`` - 1 characters, wherever that falls, trimmed, and get three dots."""
    t = squeeze(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.trim(F.substring(t, 1, most - 1)), F.lit("...")))


def title_case(text: Column) -> Column:
    """Lower case, with a capital wherever a run of letters, digits and underscores begins with a-z."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.when(w.rlike("^[a-z]"), F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))).otherwise(w)), "")


def executive_title(title: Column) -> Column:
    """A headline without feed leftovers; shouting becomes title case, Vs becomes v.; long ones are cut at a word."""
    def shown(t: Column) -> Column:
        letters, upper = F.length(F.regexp_replace(t, "[^A-Za-z]+", "")), F.length(F.regexp_replace(t, "[^A-Z]+", ""))
        return F.when((letters > 0) & (upper / F.when(letters > 0, letters) > 0.72), F.regexp_replace(title_case(t), r"(?<![A-Za-z0-9_])Vs(?:\.(?=[A-Za-z0-9_])|(?![A-Za-z0-9_]))", "v.")).otherwise(t)

    def plain(t: Column) -> Column:
        t = F.regexp_replace(t, r"(?i)\bDownload\b.*\z", "")
        t = F.regexp_replace(t, r"(?i)\bGazette ID\b.*\z", "")
        return F.trim(F.regexp_replace(t, r"(?i)\s*[-|]\s*(Latest|News|Update)\z", ""))

    # Most headlines have none of these leftovers and are not searched for them.
    left = lambda t: let(F.lower(t), lambda low: any_substring(low, ("download", "gazette id")) | low.rlike("(?:latest|news|update)\\z"))
    told = let(squeeze(F.coalesce(title, F.lit(""))), lambda t: F.when(left(t), plain(t)).otherwise(t))
    return let(let(told, shown), lambda t: cut_at_word(t, 118, 115))


def gazette_text(text: Column) -> Column:
    """Gazette leftovers removed: ids, dates, sizes and the word Download."""
    t = F.coalesce(text, F.lit(""))
    for pattern in (lexicon.GAZETTE_ID, r"\b\d{1,2}[-/ ][A-Za-z]{3,9}[-/ ]\d{2,4}\b", r"(?i)\b\d+(?:\.\d+)?\s*MB\b", r"(?i)\bDownload\b"):
        t = F.regexp_replace(t, pattern, "")
    return F.btrim(F.regexp_replace(t, r"\s+", " "), F.lit(" -|.,"))


def gazette_title(cells: Column) -> Column:
    """A title from the cells of a row: dates, ids, sizes and labels go, the rest is joined, each text once."""
    from quillspark.functions.dates import publication_date

    cleaned = F.transform(cells, lambda c: clean_text(c))
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    kept = F.filter(cleaned, lambda c: (c != "") & publication_date(c).isNull() & ~c.rlike(lexicon.GAZETTE_ID) & ~c.rlike(lexicon.GAZETTE_SIZE) & ~plain(c).isin(*lexicon.GAZETTE_LABELS))
    return F.array_join(F.array_distinct(kept), " ")


def clean_model_output(text: Column) -> Column:
    """A model's preamble line and list bullets removed, blank lines dropped."""
    t = F.coalesce(text, F.lit(""))
    for _ in range(3):
        t = F.regexp_replace(t, r"(?is)^\s*(?:sure|certainly|of course|okay|here(?:'s| is| are)|below is|this is)\b[^\n:]{0,160}[:.!]\s*", "")
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[*•-]|\d+[.)])\s+", "")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def _suspicious(text: str) -> int:
    return sum(c in "âÃ�" or "\u0080" <= c <= "\u009f" for c in text)


def _repaired(text: str | None) -> str | None:
    if not text or not (best := _suspicious(text)):
        return text
    out = text
    for page in ("cp1252", "latin-1"):
        try:
            tried = text.encode(page).decode("utf-8")
        except UnicodeError:
            continue
        if (n := _suspicious(tried)) < best:
            out, best = tried, n
    return out


@F.arrow_udf(T.StringType())
def _repair(texts: pa.Array) -> pa.Array:
    # A few texts at a time are Python's; the others are bytes in the batch.
    return pa.concat_arrays([pa.array([_repaired(t.as_py()) for t in texts.slice(at, 32)], texts.type) for at in range(0, len(texts), 32)]) if len(texts) else texts


def repair_encoding(text: Column) -> Column:
    """UTF-8 once read as a Western code page, read again rightly if that leaves fewer suspicious characters.

    Spark's own ``encode`` has no such code page and stops at characters it cannot map, hence a function of Python. It is
    given the texts that have suspicious characters and nulls for the others.
    """
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(_repair(F.when(text.rlike("[âÃ\ufffd\u0080-\u009f]"), text)), text)
