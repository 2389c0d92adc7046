"""Runs: stretches of words that repeat with a period, found by matching aligned blocks.

A run of smallest period q holds, in its first words, an aligned block of 2^k words, the largest power of two up
to q, that occurs again q words further. So at every scale the aligned blocks of a text are the keys of an automaton over
word numbers, which is run across the text; an occurrence whose distance from the block fits the scale, 2^k up to
2^(k+1) - 1, names a period, and the pair is extended word by word in both directions, exactly.

Only blocks all of whose words come again within that distance can be such blocks, and a stretch inside a
run that a smaller scale has found is known already; what is left is searched, and only where it can occur again.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters that a task gathers before it hands them on.
OUT_CHARS = 4_000_000


def agreeing(ids: np.ndarray, a: int, b: int) -> int:
    """How many words from ``a`` on equal those from ``b`` (after ``a``) on."""
    done, step, n = 0, 64, len(ids) - b
    while done < n:
        differ = np.flatnonzero(ids[a + done : a + min(done + step, n)] != ids[b + done : b + min(done + step, n)])
        if len(differ):
            return done + int(differ[0])
        done, step = done + step, step * 2
    return n


def agreeing_before(ids: np.ndarray, a: int, b: int) -> int:
    """How many words before ``a`` equal those before ``b`` (after ``a``)."""
    done, step = 0, 64
    while done < a:
        size = min(step, a - done)
        differ = np.flatnonzero(ids[a - done - size : a - done] != ids[b - done - size : b - done])
        if len(differ):
            return done + size - 1 - int(differ[-1])
        done, step = done + size, step * 2
    return a


def next_places(ids: np.ndarray) -> np.ndarray:
    """Distance from each word to its next occurrence; a huge one where there is none."""
    order = np.argsort(ids, kind="stable")
    far = np.full(len(ids), np.iinfo(np.int64).max // 2)
    same = ids[order[1:]] == ids[order[:-1]]
    far[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return far


def find_runs(ids: np.ndarray, least: int = 6, power: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` words and ``power`` periods, in order.

    A run is a stretch with that smallest period that cannot be made longer on either side. Stretches of fewer than three
    periods need not hold an aligned block twice, so ``power`` is three at least.
    """
    if power < 3:
        raise ValueError("runs of fewer than three periods are not looked for")
    n, found = len(ids), set()
    if n < least:
        return []
    far = next_places(ids)
    size, hay = 1, None
    while size <= n // power:
        blocks = n // size
        # A block whose words all come again within twice its size, and that no run already found holds with what follows it.
        open_ = np.flatnonzero(np.maximum.reduceat(far[: blocks * size], np.arange(0, blocks * size, size)) < 2 * size)
        starts, reach = _reach(found)
        if len(starts) and len(open_):
            at = np.searchsorted(starts, open_ * size, side="right") - 1
            open_ = open_[(at < 0) | (reach[at] < np.minimum(open_ * size + 3 * size - 1, n))]
        if len(open_):
            hay = hay or tuple(ids.tolist())
            found |= _runs_at(ids, hay, size, open_, starts, reach, least, power)
        size *= 2
    return sorted(found)


def _reach(found: set[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs in order, and how far any run that starts there or before goes."""
    spans = sorted((s, s + length) for s, length, _ in found)
    return np.array([s for s, _ in spans], dtype=np.int64), np.maximum.accumulate(np.array([e for _, e in spans], dtype=np.int64)) if spans else np.empty(0, dtype=np.int64)


def _runs_at(ids: np.ndarray, hay: tuple, size: int, open_: np.ndarray, starts: np.ndarray, reach: np.ndarray, least: int, power: int) -> set[tuple[int, int, int]]:
    """Runs of periods from ``size`` to twice that, from the open blocks of that size."""
    n, keys, key_of = len(hay), ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), {}
    for b in open_.tolist():
        block = hay[b * size : (b + 1) * size]
        key_of[b] = number = keys.get(block, len(key_of))
        keys.add_word(block, number)
    keys.make_automaton()
    firsts, reaches = starts.tolist(), reach.tolist()
    found, seen = set(), {}
    # Blocks that follow one another share what lies behind them.
    edges = np.flatnonzero(np.diff(open_) > 2)
    for lo, hi in zip(np.concatenate(([0], edges + 1)), np.concatenate((edges, [len(open_) - 1])), strict=True):
        begin, end = (int(open_[lo]) + 1) * size, min(n, (int(open_[hi]) + 3) * size - 1)
        for last, number in keys.iter(hay[begin:end]):
            o = begin + last - size + 1
            b = o // size - 1  # the one aligned block at a distance from size to 2 size - 1
            if key_of.get(b) != number:
                continue
            s = b * size
            period = o - s
            if s < seen.get(period, 0):
                continue  # inside a stretch of this period that is known
            at = bisect_right(firsts, s) - 1
            if at >= 0 and reaches[at] >= o + size:
                continue  # inside a run of a smaller period, which divides this one
            ahead, behind = agreeing(ids, s, o), agreeing_before(ids, s, o)
            seen[period] = s + ahead
            length = behind + ahead + period
            if length >= max(least, power * period):
                found.add((s - behind, length, period))
    return found


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay when each run keeps its first period alone."""
    gone = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return np.cumsum(gone)[:n] == 0


def _batch(rows: list[tuple], kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["__id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 6, power: int = 4) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row: runs is an array of struct<start, length, period>, all long, in order.

    Words are what white space, space and \\x09 to \\x0D, separates, numbered from 0. ``collapsed`` is the words that no run
    holds after its first period, joined by one space. Null and empty texts have no words, no runs and an
    empty text. Rows are handled one by one, repeated ones too; other columns of ``docs`` are not looked at.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        chars = 0
        for batch in batches:
            kinds = (batch.schema.field(0).type, pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string())
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                n, numbers = len(words), {}
                found = find_runs(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=n), least, power)
                if found:
                    words = [words[k] for k in np.flatnonzero(kept_words(n, found)).tolist()]
                out.append((i, n, [{"start": s, "length": length, "period": p} for s, length, p in found], b" ".join(words).decode("utf-8", "surrogatepass")))
                chars += len(out[-1][3]) + 100 * len(found)
                if chars >= OUT_CHARS:
                    yield _batch(out, kinds)
                    out, chars = [], 0
            if out:
                yield _batch(out, kinds)
                out, chars = [], 0

    kind = docs.schema[id_col].dataType.simpleString()
    made = docs.select(docs[id_col].alias("__id"), docs[text_col].cast("string").alias("__text")).mapInArrow(runs, f"__id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return made.withColumnRenamed("__id", id_col)
