"""Cutting lineage through the shared checkpoint folder, and keys that name rows."""

from __future__ import annotations

from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import shared_dir

#: Spark's setting that removes the shuffle files of an execution as it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The setting belongs to the session, so one thread at a time changes it and puts it back.
_SETTING = Lock()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to, and read from, the folder named by spark.checkpoint.dir, which executors share.

    Reliable checkpoints survive lost executors; local ones are never used. What has been written needs no shuffle
    again, so its shuffle files go at once instead of whenever the driver next collects garbage.
    """
    spark = df.sparkSession
    shared_dir(spark)
    with _SETTING:  # the setting is read when a frame is made, so the work itself runs outside
        before = spark.conf.get(SHUFFLES_GO, None)
        spark.conf.set(SHUFFLES_GO, "true")
        try:
            made = df.select("*")
        finally:
            spark.conf.set(SHUFFLES_GO, before) if before is not None else spark.conf.unset(SHUFFLES_GO)
    return made.checkpoint()


def by_merging(df: DataFrame) -> DataFrame:
    """``df``, which grows with the corpus, for a join: both sides are sorted and merged, whatever Spark takes their size to be.

    Else Spark may broadcast it, by an estimate that exploding does not raise, or by bytes of rows that a hash table
    takes several times over. All of it then passes through the driver.
    """
    return df.hint("merge")


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row as one struct, __row, with two never-null keys: __id, its id as text, and __th, a hash of its text.

    Inside the struct no column of the caller's can clash with an operator's own. Rows of one id with different
    texts are told apart; rows alike in both are treated alike.
    """
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), F.coalesce(docs[id_col].cast("string"), F.lit("\u0000null")).alias("__id"), F.xxhash64(docs[text_col]).alias("__th"))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int, share: int = 400) -> DataFrame:
    """``rows`` left-joined with ``groups``, which has one row for each of its keys and, in ``count``, how many rows it meets.

    Groups of more than a ``share``-th of all ``total`` rows are fewer than ``share``: those are broadcast, the others
    shuffle, so no task gets more than such a part of the rows for one key. Keys are not null.
    """
    often = groups.filter(F.col(count) > total // share)
    met = rows.join(F.broadcast(often), keys, "left")
    rest = met.filter(F.col(count).isNull()).select(rows.columns).join(by_merging(groups.filter(F.col(count) <= total // share)), keys, "left")
    return met.filter(F.col(count).isNotNull()).unionByName(rest)
