"""Ordered quality gates: the first rule that rejects an item names the reason, null means accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexicon, wordings
from quillspark.functions.text import any_substring, any_term, canonical_url, clean_text, fingerprint, normal_key
from quillspark.operators.frame import settled
from quillspark.operators.classify import detect_category, detect_country, legal_relevance

def commercial_noise(title_key: Column, summary_key: Column, link: Column, phrases=lexicon.COMMERCIAL_PHRASES, hosts=lexicon.COMMERCIAL_HOSTS) -> Column:
    """Adverts by title, shops by host, events by host with path or tickets, sales by phrase."""
    host = F.lower(F.coalesce(F.regexp_extract(link, r"^[^:/?#]+://([^/?#]*)", 1), F.lit("")))
    path = F.lower(F.coalesce(F.regexp_extract(link, r"^[^:/?#]+://[^/?#]*([^?#;]*)", 1), F.lit("")))
    both = F.concat_ws(" ", title_key, summary_key)
    adverts = title_key.startswith("adv ") | title_key.startswith("advertisement ")
    event = F.contains(host, F.lit(lexicon.EVENT_HOST)) & (F.contains(path, F.lit(lexicon.EVENT_PATH)) | F.contains(both, F.lit(lexicon.EVENT_WORD)))
    return adverts | (host.isin(*hosts) if hosts else F.lit(False)) | event | any_substring(both, phrases)


def editorial_noise(title_key: Column, summary_key: Column, suffixes=lexicon.EDITORIAL_SUFFIXES, phrases=lexicon.EDITORIAL_PHRASES) -> Column:
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | title_key.endswith(f" {s}")
    return ends | any_substring(F.concat_ws(" ", title_key, summary_key), phrases)


def malformed_gazette(title: Column, summary: Column) -> Column:
    """Listing furniture, or more than one gazette id in one item."""
    text = F.concat_ws(" ", title, summary)
    ids = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(lexicon.GAZETTE_ID), F.lit(0)))) > 1
    return any_substring(normal_key(text), lexicon.MALFORMED_GAZETTE_PHRASES) | normal_key(title).isin("department of publication", "recent weekly gazettes", "recent extra ordinary gazettes") | ids


def gate_items(items: DataFrame, *, noise_titles=lexicon.NOISE_TITLES, noise_phrases=lexicon.NOISE_PHRASES, commercial=lexicon.COMMERCIAL_PHRASES, editorial=lexicon.EDITORIAL_PHRASES, legal=lexicon.LEGAL_TERMS, political=lexicon.POLITICAL_TERMS, strong=lexicon.STRONG_TERMS, gazette_ids=("in_gazette",), country_signals=lexicon.COUNTRY_SIGNALS, rules=lexicon.CATEGORY_RULES) -> DataFrame:
    """Items joined with their registry row (``with_registry``), with cleaned columns and ``reject_reason``.

    Added: clean_title, clean_summary, clean_link, item_country, item_category, fingerprint, reject_reason.
    """
    out = settled(items, {"clean_title": clean_text(F.col("title"), 260), "clean_summary": clean_text(F.col("summary"), 520)})
    out = settled(out, {"__tk": normal_key(F.col("clean_title")), "__sk": normal_key(F.col("clean_summary")), "__low": F.lower(F.concat_ws(" ", "clean_title", "clean_summary"))})
    both, low = F.concat_ws(" ", "clean_title", "clean_summary"), F.col("__low")
    # A source's own terms are literals between bounds, as in any_term.
    terms = lambda c: F.exists(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda t: F.rlike(low, F.concat(F.lit(r"(?<![a-z0-9])\Q"), t, F.lit(r"\E(?![a-z0-9])"))))
    detected = detect_country(F.concat_ws(" ", both, F.col("link")), country_signals)
    country = F.when(F.coalesce(F.col("r_country_detection"), F.lit(False)), detected).otherwise(F.coalesce("r_country", "country"))
    out = settled(out, {"item_country": country})
    reasons = [
        ("short title", F.length("clean_title") < 8),
        ("noise title", F.col("__tk").isin(*noise_titles)),
        ("noise phrase", any_substring(F.col("__tk"), noise_phrases) | any_substring(F.col("__sk"), noise_phrases)),
        ("commercial", commercial_noise(F.col("__tk"), F.col("__sk"), F.col("link"), commercial)),
        ("editorial", editorial_noise(F.col("__tk"), F.col("__sk"), phrases=editorial)),
        ("malformed gazette", F.coalesce(F.col("r_id").isin(*gazette_ids), F.lit(False)) & malformed_gazette(F.col("clean_title"), F.col("clean_summary"))),
        ("no date", F.coalesce("r_require_date", F.lit(False)) & F.col("date").isNull()),
        ("required terms", (F.coalesce(F.size("r_required_terms"), F.lit(0)) > 0) & ~terms("r_required_terms")),
        ("excluded terms", (F.coalesce(F.size("r_excluded_terms"), F.lit(0)) > 0) & terms("r_excluded_terms")),
        ("not legal", ~F.coalesce("r_include_all", F.lit(False)) & ~legal_relevance(both, legal=legal, political=political, strong=strong)),
        ("no country", F.col("item_country").isNull()),
    ]
    reason = F.lit(None).cast("string")
    for name, rejects in reversed(reasons):
        reason = F.when(rejects, name).otherwise(reason)
    out = settled(out, {"reject_reason": reason, "clean_link": canonical_url(F.coalesce(F.nullif(F.col("link"), F.lit("")), F.col("r_url"))), "item_category": detect_category(F.coalesce("r_category", "category"), F.col("r_force_category"), F.col("clean_title"), F.col("clean_summary"), rules)})
    return out.withColumn("fingerprint", fingerprint(F.col("item_country"), F.col("clean_title"), F.col("clean_link"))).drop("__tk", "__sk", "__low")


def ai_gate(items: DataFrame, terms, focused_sources=()) -> DataFrame:
    """Items that focused sources give, or whose text has one of the terms."""
    low = F.lower(clean_text(F.concat_ws(" ", "title", "summary")))
    return items.filter((F.col("source").isin(*focused_sources) if focused_sources else F.lit(False)) | any_term(low, terms))


def useful_paragraph(text: Column, least: int = 45, boilerplate=wordings.PARAGRAPH_BOILERPLATE) -> Column:
    """Long enough and no boilerplate."""
    return (F.length(text) >= least) & ~any_substring(F.lower(text), boilerplate)
