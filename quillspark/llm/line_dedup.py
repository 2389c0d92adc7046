"""Line dedup by content-defined chunks of lines, and by windows where chunks cannot see.

Chunks: a rolling hash runs over the hashes of a text's lines, and a boundary stands wherever it falls below a bound,
after two lines at the least. A boundary depends on few lines before it, so insertions shift chunks but soon no longer
change them. Chunks of ``chunk_words`` words or more that the corpus repeats are taken out but for their first place.

Chunks at a passage's ends differ with what stands around it, and a short passage need not hold a whole one. So each
text also has its windows: at every line with words begins a window of as few lines as
hold ``min_words`` words, and one ends. A passage of that many words is covered by the windows inside it, whatever
stands around it, so two copies of a passage share all of its windows.

Chunks and windows are grouped over the corpus by 128-bit hashes; the first occurrence (smallest id, then place)
stays, and every later one is taken out with the lines that it covers. Those that repeat one text at one distance are
joined to runs, and runs are compared byte by byte with the lines that they repeat. One that overlaps its own first
occurrence leaves that occurrence's lines. Single lines and pairs of short ones, such as licences, stay where they are.

Only hashes are grouped over the corpus, with partial sums before the shuffle; texts of repeated runs alone are
compared, and copies of what they repeat are as many as the repeats need, one for each ``SPREAD``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.lineage import by_merging, cut, keyed_rows

#: Occurrences of a passage that are compared with one copy of its first.
SPREAD, HOT = 100, 400
#: Characters that a task gathers before it hands them on.
OUT_CHARS = 4_000_000
#: One line in so many ends a chunk, once it has two, and the rolling hash's odd factor.
CHUNK_LINES, ROLL = 2, 0x9E3779B97F4A7C15


def boundaries(lines: list[str], held: list[int]) -> list[int]:
    """Positions in ``held``, the lines with words, after which a chunk ends.

    That is wherever the rolling hash over two line hashes is low, but not after a chunk's first line.
    """
    ends, before = [], None
    for at, i in enumerate(held):
        now = xxhash.xxh3_64_intdigest(lines[i].encode("utf-8", "surrogatepass"))
        if before is not None and (before * ROLL + now) * ROLL & (1 << 64) - 1 < (1 << 64) // CHUNK_LINES:
            ends.append(at)
            before = None  # the next line begins a chunk
        else:
            before = now
    return ends


def line_chunks(text: str, min_words: int, chunk_words: int) -> tuple[list[str], list[tuple[int, int]]]:
    """The lines of a text, and its chunks and windows as (first line, line after the last), in order.

    Both begin and end with a line that has words. A chunk has two such lines or more and ``chunk_words`` words or
    more. A window holds ``min_words`` words or more, and would not without its last line, or not without its first.
    """
    lines = text.split("\n")
    words = [len(line.split()) for line in lines]
    held = [i for i, n in enumerate(words) if n]
    found, first, total = set(), 0, 0
    for last, j in enumerate(held):
        # Line j fills the windows of these first lines.
        total += words[j]
        while total >= min_words and first <= last:
            found.add((held[first], j + 1))
            total -= words[held[first]]
            first += 1
        # The least window that ends at j begins one before ``first``, whose own window is not full yet.
        if first:
            found.add((held[first - 1], j + 1))
    if len(held) > 1:
        begin = 0
        for end in sorted({*boundaries(lines, held), len(held) - 1}):
            if end > begin and sum(words[i] for i in held[begin : end + 1]) >= chunk_words:
                found.add((held[begin], held[end] + 1))
            begin = end + 1
    return lines, sorted(found)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, chunk_words: int = 20) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text_col``, and ``lines_removed`` (long).

    Lines are what \\n separates; lines that stay keep their bytes and their order. A text that loses all its
    lines becomes empty; null and empty texts stay as they are. Rows of one id with one text count as one
    document and are treated alike. Repeats inside one text are repeats too. A column of ``docs`` named lines_removed
    is replaced.
    """
    keyed = keyed_rows(docs, id_col, text_col)
    whole = docs.schema[id_col].dataType.typeName() in ("long", "integer", "short", "byte")
    order = F.struct(F.length("__id") if whole else F.lit(0), F.col("__id").alias("id0"), F.col("__th").alias("th0"), F.col("start").alias("start0"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, starts, stops, high, low = [], [], [], [], []
            for i, text in enumerate(batch.column(2)):
                lines, windows = line_chunks(text.as_py(), min_words, chunk_words)
                digests = [_digest(line.encode("utf-8", "surrogatepass")) for line in lines] if windows else []
                for b, e in windows:
                    digest = _digest(b"".join(digests[b:e]))
                    at.append(i)
                    starts.append(b)
                    stops.append(e)
                    high.append(int.from_bytes(digest[:8], "little", signed=True))
                    low.append(int.from_bytes(digest[8:], "little", signed=True))
            pick = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64())], names=["__id", "__th", "start", "stop", "high", "low"])

    text = F.col("__row")[text_col]
    lean = keyed.filter(F.length(text) > 0).select("__id", "__th", text.alias("text"))
    windows = cut(lean.mapInArrow(hashes, "__id string, __th long, start int, stop int, high long, low long"))
    repeated = cut(windows.groupBy("high", "low").agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1"))
    # Windows with more than 1 / HOT of all occurrences are fewer than HOT: those are broadcast, the others shuffle.
    often = max(SPREAD, windows.count() // HOT)
    met = windows.join(F.broadcast(repeated.filter(F.col("n") > often).drop("n")), ["high", "low"], "left")
    rest = met.filter(F.col("first").isNull()).drop("first").join(by_merging(repeated.filter(F.col("n") <= often).drop("n")), ["high", "low"])
    later = met.filter(F.col("first").isNotNull()).unionByName(rest).filter(order != F.col("first"))
    place = F.struct(F.col("first.id0").alias("id0"), F.col("first.th0").alias("th0"), (F.col("first.start0") - F.col("start")).alias("shift"), "start", "stop")
    places = later.groupBy("__id", "__th").agg(F.array_sort(F.collect_set(place)).alias("places"))

    def joined_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                runs: list[dict] = []
                for p in row["places"]:
                    # Inside one text, what was found matters: a later place may overlap the first.
                    found = [p["start"], p["stop"]] if (row["__id"], row["__th"]) == (p["id0"], p["th0"]) else None
                    same = runs and all(runs[-1][k] == p[k] for k in ("id0", "th0", "shift"))
                    if same and p["start"] <= runs[-1]["stop"]:
                        runs[-1]["stop"] = max(runs[-1]["stop"], p["stop"])
                        runs[-1]["spans"] += found or []
                    else:
                        runs.append({**p, "spans": found or []})
                out += [{"__id": row["__id"], "__th": row["__th"], **r} for r in runs]
            yield pa.RecordBatch.from_pylist(out, schema=run_shape)

    run_shape = pa.schema([("__id", pa.string()), ("__th", pa.int64()), ("id0", pa.string()), ("th0", pa.int64()), ("shift", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("spans", pa.list_(pa.int32()))])
    runs = cut(places.mapInArrow(joined_runs, "__id string, __th long, id0 string, th0 long, shift int, start int, stop int, spans array<int>"))
    runs = runs.withColumns({"start0": F.col("start") + F.col("shift"), "stop0": F.col("stop") + F.col("shift")})
    key = ["id0", "th0", "start0", "stop0"]
    firsts = runs.groupBy(key).agg(F.count("*").alias("n"))
    hot = firsts.filter(F.col("n") > max(SPREAD, runs.count() // HOT)).select(*key, F.ceil(F.col("n") / SPREAD).cast("int").alias("ways"))
    salted = runs.join(F.broadcast(hot), key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("__id", "__th", "start"), F.col("ways")), F.lit(0)).cast("int"))
    wanted = F.struct("id0", "th0", "start0", "stop0", "salt", "start", "stop", "spans")
    asked = salted.groupBy("__id", "__th").agg(F.collect_list(wanted).alias("__places"))
    ways = firsts.join(F.broadcast(hot), key, "left").select(*key, F.coalesce("ways", F.lit(1)).alias("ways"))
    held = ways.groupBy(F.col("id0").alias("__id"), F.col("th0").alias("__th")).agg(F.collect_list(F.struct("id0", "th0", "start0", "stop0", F.col("ways").alias("salt"), F.col("start0").alias("start"), F.col("stop0").alias("stop"), F.lit(None).cast("array<int>").alias("spans"))).alias("__places"))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, hashes_, wanted = batch.columns
            texts, out, held = rows.field(text_col), [], 0
            for i in range(batch.num_rows):
                lines = texts[i].as_py().split("\n")
                for p in wanted[i].as_py():
                    body = "\n".join(lines[p["start"] : p["stop"]])
                    out.append({"__id": ids[i].as_py(), "__th": hashes_[i].as_py(), **p, "body": body})
                    held += len(body)
                    if held > OUT_CHARS:
                        yield pa.RecordBatch.from_pylist(out, schema=shape)
                        out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    shape = pa.schema([("__id", pa.string()), ("__th", pa.int64()), ("id0", pa.string()), ("th0", pa.int64()), ("start0", pa.int32()), ("stop0", pa.int32()), ("salt", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("spans", pa.list_(pa.int32())), ("body", pa.string())])
    # Whole rows go in, so that these joins and the last one read one and the same exchange of the documents.
    shown = lambda places: keyed.join(by_merging(places), ["__id", "__th"]).select("__row", "__id", "__th", "__places").mapInArrow(bodies, "__id string, __th long, id0 string, th0 long, start0 int, stop0 int, salt int, start int, stop int, spans array<int>, body string")
    originals = shown(held).select(*key, F.explode(F.sequence(F.lit(0), F.col("salt") - 1)).alias("salt"), F.col("body").alias("body0"))
    originals = originals.groupBy(*key, "salt").agg(F.first("body0").alias("body0"))
    pairs = shown(asked).join(by_merging(originals), [*key, "salt"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, gone = [], []
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            for i in range(batch.num_rows):
                row = {n: col[n][i].as_py() for n in ("start", "start0", "spans", "body", "body0")}
                lines = _equal(row["body"], row["body0"], row["start"], row["start0"], row["spans"])
                if lines:
                    keep.append(i)
                    gone.append(lines)
            pick = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([col["__id"].take(pick), col["__th"].take(pick), pa.array(gone, pa.list_(pa.int32()))], names=["__id", "__th", "gone"])

    matched = pairs.select("__id", "__th", "start", "start0", "spans", "body", "body0").mapInArrow(alike, "__id string, __th long, gone array<int>")
    removed = matched.groupBy("__id", "__th").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("__gone"))
    joined = keyed.join(by_merging(removed), ["__id", "__th"], "left")
    lines = F.split(text, "\n", -1)
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone")), lambda i: F.get(lines, i))
    cleaned = F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(stay, "\n"))
    count = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")
    own = [cleaned.alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in docs.columns if c != "lines_removed"]
    return joined.select(*own, count.alias("lines_removed"))


def _digest(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def _equal(body: str, body0: str, start: int, start0: int, spans: list[int] | None) -> list[int]:
    """The lines of ``body``, which begins at line ``start``, that go since they equal those of ``body0``.

    ``spans`` has the first line, and that after the last, of what was found, if both stand in one text (else it is empty): each then
    leaves the lines that are its first occurrence's too.
    """
    if not spans:
        return list(range(start, start + body.count("\n") + 1)) if body == body0 else []
    lines, lines0 = body.split("\n"), body0.split("\n")
    gone: set[int] = set()
    for b, e in zip(spans[::2], spans[1::2], strict=True):
        if lines[b - start : e - start] == lines0[b - start : e - start]:
            gone |= set(range(b, e)) - set(range(start0 + b - start, start0 + e - start))
    return sorted(gone)
