"""Substring search by a table of trigrams: posting lists met by semi-joins, then the rows they name verified.

Every text is taken in lower case between two marks, so that also a text of one character has a trigram. The postings
(part, gram, key) are Parquet, in folders by a hash of the gram and sorted by gram inside, so a lookup reads one
folder and, of its files, the row groups of the gram. Beside them stand the grams with their numbers of postings.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands before and after every text.
FIRST, LAST = "\u0002", "\u0003"
#: Postings that a folder holds, about, tasks that write one of them, at least, and postings that a task sorts, about.
PART_ROWS, SPREAD, SHARE_ROWS = 20_000_000, 4, 2_000_000


def trigrams(text: Column) -> Column:
    """All runs of three characters of a text between its marks, each once; none of an empty or null text."""
    marked = F.concat(F.lit(FIRST), F.lower(text), F.lit(LAST))
    return F.when(F.length(text) > 0, F.array_distinct(F.regexp_extract_all(marked, F.lit("(?s)(?=(.{3}))"), F.lit(1)))).otherwise(F.array().cast("array<string>"))


def build_index(items: DataFrame, root: str, *, key: str = "id", columns: tuple[str, ...] = ("title", "summary", "source")) -> None:
    """Write the index of the columns' texts to ``root``. Rows without a key are not indexed."""
    spark = items.sparkSession
    every = reduce(F.array_union, [trigrams(F.coalesce(c, F.lit(""))) for c in columns])
    rows = items.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.explode(every).alias("gram"))
    held = items.count()
    parts = max(1, held * 1000 // PART_ROWS)  # a text has about a thousand different trigrams
    # Each task writes one share of one folder, by number: shares that hashing put together would be sorted by one task.
    shares = max(SPREAD, -(-held * 1000 // (parts * SHARE_ROWS)))
    parted = rows.withColumn("part", _part(F.col("gram"), parts))
    share = F.col("part") * shares + F.pmod(F.xxhash64("key"), F.lit(shares)).cast("int")
    parted.repartitionById(parts * shares, share).sortWithinPartitions("part", "gram", "key").write.partitionBy("part").parquet(f"{root}/postings")
    parted.limit(0).write.parquet(f"{root}/schema")
    # A row is a posting (keys that repeat count as often), so the rows are counted and no set of keys is held.
    counted = _postings(spark, root).groupBy("part", "gram").agg(F.count("*").alias("n"))
    counted.withColumn("parts", F.lit(parts)).write.parquet(f"{root}/grams")


def _postings(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{root}/schema").schema).parquet(f"{root}/postings")


def _part(gram: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(parts)).cast("int")


def literals(q: str) -> list[str]:
    """The stretches of a LIKE pattern between its wildcards % and _, in lower case; a backslash takes the next one as it is."""
    out = [""]
    for escaped, char in re.findall(r"(?s)(\\?)(.)", q):
        if char in "%_" and not escaped:
            out.append("")
        else:
            out[-1] += char
    return [x.lower() for x in out if x]


def keys_matching(spark: SparkSession, root: str, q: str, most: int = 4) -> DataFrame | None:
    """Keys of rows that may hold the pattern ``%q%``, every one that does among them; None where the pattern names no characters.

    Of all trigrams of the pattern's stretches the ``most`` rarest are met. Where no stretch has three characters,
    the longest one is looked for in the grams, and the postings of those that hold it are read.
    """
    stretches = literals(q)
    if not stretches:
        return None
    grams, postings = spark.read.parquet(f"{root}/grams"), _postings(spark, root)
    wanted = sorted({x[i : i + 3] for x in stretches for i in range(len(x) - 2)})
    if not wanted:
        part = max(stretches, key=len)
        return postings.join(grams.filter(F.contains("gram", F.lit(part))).select("part", "gram"), ["part", "gram"], "left_semi").select("key").distinct()
    known = {r["gram"]: (r["n"], r["parts"]) for r in grams.filter(F.col("gram").isin(wanted)).collect()}  # a row a trigram of q
    if len(known) < len(wanted):
        return postings.select("key").limit(0)
    rarest = sorted(known, key=lambda g: (known[g][0], g))[:most]
    lists = [postings.filter((F.col("part") == _part(F.lit(g), known[g][1])) & (F.col("gram") == g)).select("key") for g in rarest]
    return reduce(lambda a, b: a.join(b, "key", "left_semi"), lists)


def search(items: DataFrame, root: str, q: str, *, key: str = "id", columns: tuple[str, ...] = ("title", "summary", "source")) -> DataFrame:
    """Rows that match ``%q%`` in one of the columns, letter case aside; % and _ in it are wildcards, \\ escapes them."""
    keys = keys_matching(items.sparkSession, root, q)
    asked = items if keys is None else items.join(keys.withColumnRenamed("key", key), key, "left_semi")
    return asked.filter(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{q}%") for c in columns]))
