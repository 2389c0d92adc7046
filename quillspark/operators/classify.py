"""Lexicon-driven classification as Column expressions; every lexicon is an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexicon
from quillspark.functions.matching import TERM, Lexicons, let
from quillspark.functions.text import any_term, clean_text


def known_category(category: Column) -> Column:
    """A present category: old names are mapped, unknown and null ones become the default."""
    mapped = category
    for old, new in lexicon.LEGACY_CATEGORIES.items():
        mapped = F.when(category == old, new).otherwise(mapped)
    return F.when(mapped.isin(*lexicon.CATEGORIES), mapped).otherwise(lexicon.DEFAULT_CATEGORY)


def stored_category(category: Column, title: Column, summary: Column, policy_terms=lexicon.POLICY_TERMS) -> Column:
    """The category as stored: default items with policy terms are policy items."""
    known, text = known_category(category), F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit(""))))
    return F.when((known == lexicon.DEFAULT_CATEGORY) & any_term(text, policy_terms), lexicon.POLICY_CATEGORY).otherwise(known)


def detect_category(source_category: Column, forced: Column, title: Column, summary: Column, rules=lexicon.CATEGORY_RULES) -> Column:
    """Forced, else pinned, else that of the first matching rule, else the source's, else the default."""
    lexicons = Lexicons(TERM, **{f"rule{i}": terms for i, (_, terms) in enumerate(rules)})

    def by_rules(words: Column, text: Column) -> Column:
        found = [F.when(lexicons.any(f"rule{i}", words, text), category) for i, (category, _) in enumerate(rules)]
        return F.coalesce(*found, F.when(source_category.isin(*lexicon.CATEGORIES), source_category), F.lit(lexicon.DEFAULT_CATEGORY))

    pinned = F.coalesce(forced, F.lit(False)) | source_category.isin(*lexicon.PINNED_CATEGORIES)
    return F.when(pinned, source_category).otherwise(lexicons.found(F.lower(clean_text(F.concat_ws(" ", title, summary))), by_rules))


def detect_country(text: Column, signals=lexicon.COUNTRY_SIGNALS) -> Column:
    """The country whose signals score most (its own name 3, others 1), the first of equals; null without any."""
    lexicons = Lexicons(TERM, **{f"country{i}": terms for i, terms in enumerate(signals.values())})

    def best(words: Column, low: Column) -> Column:
        scored = []
        for i, country in enumerate(signals):
            found = lexicons.which(f"country{i}", words, low)
            points = F.size(found) + F.when(F.array_contains(found, country.lower()), 2).otherwise(0)
            scored.append(F.struct(points.alias("points"), F.lit(-i).alias("place"), F.lit(country).alias("country")))
        return F.array_max(F.array(*scored))

    return let(lexicons.found(F.lower(clean_text(text)), best), lambda x: F.when(x["points"] > 0, x["country"]))


def legal_relevance(text: Column, *, legal=lexicon.LEGAL_TERMS, political=lexicon.POLITICAL_TERMS, strong=lexicon.STRONG_TERMS, enforcement=lexicon.ENFORCEMENT_TERMS, context=lexicon.COURT_CONTEXT_TERMS) -> Column:
    """A legal term; not political without a strong signal; enforcement news only with a court's context."""
    lexicons = Lexicons(TERM, legal=legal, political=political, strong=strong, enforcement=enforcement, context=context)

    def relevant(words: Column, low: Column) -> Column:
        has = lambda name: lexicons.any(name, words, low)
        return has("legal") & ~(has("political") & ~has("strong")) & (~has("enforcement") | has("context"))

    return lexicons.found(F.lower(clean_text(text)), relevant)


def with_registry(items: DataFrame, registry: DataFrame, prefix: str = "r_") -> DataFrame:
    """Items with their source's registry row, its columns prefixed. Spark broadcasts a registry that measures small enough."""
    return items.join(registry.select(*[F.col(c).alias(prefix + c) for c in registry.columns]), F.col("source") == F.col(f"{prefix}name"), "left")
