"""Exact dedup by a tree-merge of sorted digest runs.

Every partition sorts the digests of its rows into runs, rows of one text combined. Runs are then exchanged in binomial
rounds over a hypercube of slots: in each round a slot keeps the part of its runs whose digests agree with its next
digit and hands the other parts to the slots that differ from it in this digit alone, so what it receives shares one
more digit. It merges the runs that it receives by one multiway merge, combining what several of them hold.
After the last round a slot holds one stretch of the digests, and each group once.

Runs are ordered by SHA-256. Entries are combined, at every level, only where the whole digest, the length in bytes and a
second hash of the text, made another way, agree: an identifier that is kept is verified wherever runs meet.

A text that a third of all rows hold is one entry of each run, so no slot ever gets more of them than runs. Entries are
some eighty bytes a row; texts are read once and never shuffled.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.lineage import cut, join_groups

#: Bytes of an entry's key: SHA-256, length, second hash.
KEY = 48
#: Entries that a partition gathers before it sorts them into a run.
RUN_ROWS = 50_000
RUNS = "slot long, keys binary, ids array<long>, places array<long>, counts array<long>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Entry = tuple[bytes, "int | None", int, int]


def lower_ascii(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def text_key(text: Column) -> Column:
    """48 bytes: SHA-256, the length in bytes and a 64-bit hash of another family."""
    number = lambda x: F.unhex(F.lpad(F.hex(x), 16, "0"))
    return F.concat(F.unhex(F.sha2(text.cast("binary"), 256)), number(F.octet_length(text).cast("long")), number(F.xxhash64(text)))


def combined(entries: Iterable[Entry], sign: int) -> Iterator[Entry]:
    """Entries in order of their keys, those of one key as one: counts add up, the best identifier stays.

    Best is the smallest times ``sign``, a null one last; of equal ones that of the first place.
    """
    key = None
    for k, i, place, n in entries:
        mine = (i is None, 0 if i is None else i * sign, place)
        if k != key:
            if key is not None:
                yield key, best[3], best[2], total
            key, best, total = k, (*mine, i), n
        else:
            total += n
            if mine < best[:3]:
                best = (*mine, i)
    if key is not None:
        yield key, best[3], best[2], total


def entries_of(keys: bytes, ids: list, places: list, counts: list) -> Iterator[Entry]:
    return zip((keys[k : k + KEY] for k in range(0, len(keys), KEY)), ids, places, counts, strict=True)


def digit(key: bytes, level: int, bits: int) -> int:
    """The ``level``-th group of ``bits`` leading bits of a key."""
    return int.from_bytes(key[:8], "big") >> 64 - bits * (level + 1) & (1 << bits) - 1


def sent(entries: Iterable[Entry], slot: int, level: int, levels: int, bits: int) -> Iterator[dict]:
    """Sorted entries of a slot cut into runs for the slots that this round's digit names; after the last round they stay."""
    shift = bits * (levels - 1 - level)
    to, run = None, []

    def packed() -> dict:
        keys, ids, places, counts = zip(*run, strict=True)
        return {"slot": to, "keys": b"".join(keys), "ids": list(ids), "places": list(places), "counts": list(counts)}

    for e in entries:
        there = slot if level == levels else slot & ~((1 << bits) - 1 << shift) | digit(e[0], level, bits) << shift
        if run and (there != to or len(run) >= RUN_ROWS):
            yield packed()
            run = []
        to = there
        run.append(e)
    if run:
        yield packed()


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"slot": pa.int64(), "keys": pa.binary(), "ids": pa.list_(pa.int64()), "places": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))


def digest_groups(rows: DataFrame, *, total: int, smallest: bool = True, slot_rows: int = 16_384, most_rounds: int = 4) -> DataFrame:
    """(key, keep_id, keep_place, n) of every key that more than one of ``rows`` (key, id, place, part) has.

    There are as many slots as leave each some ``slot_rows`` of ``total`` rows; rounds take three bits of a slot's number
    each, or more where that would ask for more than ``most_rounds``.
    """
    sign = 1 if smallest else -1
    wanted = max(1, math.ceil(math.log2(max(2, total / slot_rows))))
    levels = min(most_rounds, math.ceil(wanted / 3))
    bits = math.ceil(wanted / levels)
    slots = 1 << bits * levels

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, slot = [], 0

        def run() -> list[dict]:
            return list(sent(combined(sorted(held, key=itemgetter(0)), sign), slot, 0, levels, bits))

        for batch in batches:
            columns = batch.to_pydict()
            held += [(k, i, place, 1) for k, i, place in zip(columns["key"], columns["id"], columns["place"], strict=True)]
            slot = columns["part"][0] % slots if columns["part"] else slot
            if len(held) >= RUN_ROWS:
                yield _batch(run())
                held = []
        if held:
            yield _batch(run())

    def merge(level: int):
        def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            runs = [entries_of(r["keys"], r["ids"], r["places"], r["counts"]) for batch in batches for r in batch.to_pylist()]
            one = combined(heapq.merge(*runs, key=itemgetter(0)), sign)
            for run in sent(one, key[0].as_py(), level, levels, bits):
                yield _batch([run])

        return merged

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = [e for e in entries_of(r["keys"], r["ids"], r["places"], r["counts"]) if e[3] > 1]
                columns = list(zip(*found, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["key", "keep_id", "keep_place", "n"])

    runs = rows.mapInArrow(leaves, RUNS)
    for level in range(levels):
        runs = runs.groupBy("slot").applyInArrow(merge(level + 1), RUNS)
    return runs.mapInArrow(repeated, "key binary, keep_id long, keep_place long, n long")


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", smallest: bool = True, **tree) -> DataFrame:
    """Every row of ``docs`` with its group: the id, keep_id, group_size, kept and text_sha256.

    Texts are equal that are identical once A-Z are lower case; null counts as empty. Of equal texts the row of the
    smallest id stays (the largest, if not ``smallest``); ids are integers, null ones come last, and of rows alike in both
    exactly one stays. No rows give no rows; other columns of ``docs`` are not looked at.
    """
    text = lower_ascii(docs[text_col])
    # A row's place is fixed as it is written, so that rows alike in id and text are told apart.
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_key(text).alias("key"), F.monotonically_increasing_id().alias("place"))
    rows = cut(rows.withColumn("part", F.shiftright("place", 33)))
    total = rows.count()
    groups = cut(digest_groups(rows, total=total, smallest=smallest, **tree))
    found = join_groups(rows, groups, ["key"], "n", total)
    alone = F.col("n").isNull()
    return found.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("place") == F.col("keep_place"))).alias("kept"),
        F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", smallest: bool = True, **tree) -> DataFrame:
    """``docs`` with one row of each text, chosen as ``exact_duplicates`` does, all columns as they are.

    Rows alike in id and text are one document: should other columns differ, all of them stay or go together.
    """
    found = exact_duplicates(docs, id_col=id_col, text_col=text_col, smallest=smallest, **tree)
    digest = F.sha2(lower_ascii(docs[text_col]).cast("binary"), 256)
    gone = cut(found.filter("group_size > 1").groupBy(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha")).agg(F.max("kept").alias("kept")).filter("NOT kept"))
    own = docs.withColumns({"__sha": digest, "__own": docs[id_col].cast("long")})
    return own.join(gone, (own["__sha"] == gone["__sha"]) & own["__own"].eqNullSafe(gone["__id"]), "left_anti").select(docs.columns)
