"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window of an item occurs in a document only if all its two-word shingles do. So its shingles are put in
order of rarity over all documents, and the necessary prefix is the first: the window's rarest shingle. Only
document places that hold such a shingle are candidates. Each gives an alignment of one item with the
document; bounds on position and length leave the windows that fit, and these are compared word by word.

Both passes over the documents explode words inside the scan's stage and keep only what joins. The shingles
of the items are broadcast if their measured bytes are ``broadcast_bytes`` at most; else the joins shuffle. Item texts
are not broadcast: an item's words join a document's candidates of it once. One shuffle brings candidates back to
their documents; documents without any pass through it once.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.lineage import by_merging, cut, keyed_rows

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII texts take the fast built-in."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    """Words of digits, a-z and characters beyond ASCII; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), "")


def _shingles(words: str) -> Column:
    """Two-word shingles by place; the last word stands with a null."""
    return F.arrays_zip(F.col(words).alias("a"), F.slice(F.col(words), F.lit(2), F.size(words)).alias("b"))


def _places(docs: DataFrame, text: Column) -> DataFrame:
    """__id, __th, at, a, b: every word of every document with the word after it."""
    words = docs.select("__id", "__th", words_of(text).alias("w"))
    return words.select("__id", "__th", F.posexplode(_shingles("w")).alias("at", "s")).select("__id", "__th", "at", F.col("s")["a"].alias("a"), F.col("s")["b"].alias("b"))


def _small(df: DataFrame, held: int, most: int) -> DataFrame:
    return F.broadcast(df) if held <= most else df


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    share: int = 20,
    broadcast_bytes: int = 64_000_000,
) -> DataFrame:
    """``docs`` with n_words, n_hit (long), items (sorted array<string> of item ids) and contaminated (boolean).

    A document word inside any occurrence of an item's window of ``window`` words (all words of a shorter item)
    is hit; ``share`` * n_hit >= n_words > 0 with a hit makes a document contaminated. Null and empty texts have
    no words; null and empty items have no windows; items of one id count once. Repeated rows stay. Columns of
    ``docs`` with the added names are replaced.
    """
    keyed = keyed_rows(docs, id_col, text_col)
    text = F.col("__row")[text_col]
    listed = items.select(F.col(item_id_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("iw")).filter(F.size("iw") > 0).distinct()
    span = F.least(F.size("iw"), F.lit(window))
    listed = cut(listed.withColumn("ih", F.xxhash64("iw")))
    windows = listed.select("item", "ih", "iw", F.explode(F.sequence(F.lit(0), F.size("iw") - span)).alias("start"))
    inside = windows.select("item", "ih", "iw", "start", F.explode(F.sequence(F.col("start"), F.col("start") + F.greatest(span - 2, F.lit(0)))).alias("p"))
    shingles = cut(inside.select("item", "ih", "start", "p", F.get("iw", F.col("p")).alias("a"), F.get("iw", F.col("p") + 1).alias("b")))
    # What a broadcast holds at most: every shingle with its item, and as much again for a row's and a hash table's own needs.
    held = shingles.agg(F.sum(F.octet_length("item") + F.octet_length("a") + F.coalesce(F.octet_length("b"), F.lit(0)) + 128)).first()[0] or 0

    # Rarity of the items' shingles, counted over all documents.
    pairs = shingles.filter(F.col("b").isNotNull()).select("a", "b").distinct()
    counts = _places(keyed, text).join(_small(pairs, held, broadcast_bytes), ["a", "b"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    ranked = shingles.join(counts, ["a", "b"], "left").withColumn("single", F.col("b").isNull())
    # A window whose rarest shingle is nowhere cannot occur; one-word items have no pair to look for.
    rarest = ranked.groupBy("item", "ih", "start", "single").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "a", "b", "p")).alias("s")).filter((F.col("s.n") > 0) | F.col("single"))
    anchors = cut(rarest.select(F.col("s.a").alias("a"), F.col("s.b").alias("b"), "item", "ih", F.col("s.p").alias("p")).distinct())

    paired, single = anchors.filter(F.col("b").isNotNull()), anchors.filter(F.col("b").isNull())
    found = _places(keyed, text).join(_small(paired, held, broadcast_bytes), ["a", "b"])
    if not single.isEmpty():
        found = found.unionByName(_places(keyed, text).drop("b").join(_small(single, held, broadcast_bytes), "a").select(*found.columns))
    shifts = found.groupBy("__id", "__th", "item", "ih").agg(F.collect_set(F.col("at") - F.col("p")).alias("shifts"))
    candidates = shifts.join(listed, ["item", "ih"]).groupBy("__id", "__th").agg(F.collect_list(F.struct("item", "iw", "shifts")).alias("__c"))

    joined = keyed.join(by_merging(candidates), ["__id", "__th"], "left").withColumn("__w", words_of(text)).withColumn("__n", F.size("__w"))
    w, n = F.col("__w"), F.col("__n")

    def aligned(c: Column, shift: Column) -> Column:
        length = F.least(F.size(c["iw"]), F.lit(window))
        fits = lambda k: (k + shift >= 0) & (k + shift + length <= n)
        same = lambda k: F.slice(w, k + shift + 1, length) == F.slice(c["iw"], k + 1, length)
        starts = F.filter(F.sequence(F.lit(0), F.size(c["iw"]) - length), lambda k: F.when(fits(k), same(k)).otherwise(False))
        return F.transform(starts, lambda k: F.struct((k + shift).alias("start"), (k + shift + length).alias("stop"), c["item"].alias("item")))

    def occurrences(c: Column) -> Column:
        return F.flatten(F.transform(c["shifts"], lambda shift: aligned(c, shift)))

    none = F.array().cast("array<struct<start:int,stop:int,item:string>>")
    occurring = F.when(F.col("__c").isNull(), none).otherwise(F.array_sort(F.flatten(F.transform("__c", occurrences))))
    spans = joined.withColumn("__o", occurring)
    covered = F.aggregate(
        "__o",
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda s, o: F.struct(F.greatest(s["upto"], o["stop"]).alias("upto"), (s["n"] + F.greatest(o["stop"] - F.greatest(o["start"], s["upto"]), F.lit(0))).alias("n")),
        lambda s: s["n"],
    )
    named = F.array_sort(F.array_distinct(F.filter(F.transform("__o", lambda o: o["item"]), lambda i: i.isNotNull())))
    measured = spans.withColumns({"n_words": n.cast("long"), "n_hit": covered, "items": named})
    contaminated = (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    added = ("n_words", "n_hit", "items", "contaminated")
    own = [F.col("__row")[c].alias(c) for c in docs.columns if c not in added]
    return measured.withColumn("contaminated", contaminated).select(*own, *added)
