"""Compression of vectors by integer product codebooks.

Components are scaled to integers, so every distance, sum and mean is exact and does not depend on the order of rows.
A vector is cut into consecutive parts; each part position has a codebook of its own, a few thousand integers in all,
which is broadcast. Arrow batches compute the distances of all their parts to all entries by norm expansion, with int64
matrix products, and take the first least one. Tasks add up what they assign to each entry; only those sums are
shuffled, grouped by entry, and the codebooks of the next round are made of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scaled components are held within this bound, so that squared distances of 8192 components fit 64 bits.
BOUND = 1 << 24
#: Components of a slice of a batch that is worked on at once.
SLICE = 1 << 20


class Codebooks:
    """One table of integer entries for each part position; parts are as equal as the dimension lets them be."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables
        self.ends = np.cumsum([0, *(t.shape[1] for t in tables)])
        self.squares = [(t * t).sum(axis=1) for t in tables]

    @classmethod
    def starting(cls, x: np.ndarray, parts: int) -> Codebooks:
        """The parts of the rows of ``x`` as entries, in order."""
        ends = [i * x.shape[1] // parts for i in range(parts + 1)]
        return cls([np.ascontiguousarray(x[:, a:b]) for a, b in zip(ends, ends[1:], strict=False)])

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (row x part) of the nearest entries, the first of equals, and each row's squared distance in all."""
        codes, error = np.empty((len(x), len(self.tables)), dtype=np.uint8), np.zeros(len(x), dtype=np.int64)
        for p, (table, square) in enumerate(zip(self.tables, self.squares, strict=True)):
            own = x[:, self.ends[p] : self.ends[p + 1]]
            # |x - c|^2 = |x|^2 - 2 x.c + |c|^2; |x|^2 is the same for all entries
            far = square - 2 * (own @ table.T)
            codes[:, p] = far.argmin(axis=1)
            error += np.take_along_axis(far, codes[:, p : p + 1].astype(np.int64), axis=1)[:, 0] + (own * own).sum(axis=1)
        return codes, error

    def moved(self, sums: dict[tuple[int, int, int], tuple[int, int]]) -> Codebooks:
        """Entries replaced by floor(sum / count) by (part, entry, position); what no vector took stays."""
        tables = [t.copy() for t in self.tables]
        for (part, entry, at), (s, n) in sums.items():
            tables[part][entry, at] = s // n
        return Codebooks(tables)

    def sha256(self) -> str:
        """Hex digest of all integers by part, entry and position, in decimal, joined by commas."""
        return hashlib.sha256(",".join(str(v) for t in self.tables for row in t.tolist() for v in row).encode()).hexdigest()


def scaled(flat: np.ndarray, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) as integers, rows of ``dim``, held within the bound."""
    return np.clip(np.floor(flat * float(scale)), -BOUND, BOUND).astype(np.int64).reshape(-1, dim)


def _slices(batches: Iterator[pa.RecordBatch], column: int, dim: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, SLICE // max(1, dim))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, scaled(part.column(column).flatten().to_numpy(zero_copy_only=False), dim, scale) if dim else np.empty((part.num_rows, 0), dtype=np.int64)


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """``vectors`` with __v, the vector as array<double>; rows without one, or with null or non-finite components, go."""
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return vectors.withColumn("__v", F.col(vec_col).cast("array<double>")).filter(F.col("__v").isNotNull() & F.forall("__v", good))


def compress_vectors(vectors: DataFrame, *, id_col: str, vec_col: str, keep: tuple[str, ...] = (), parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, Codebooks | None]:
    """(rows, codebooks): the id, the ``keep`` columns, code (string, two hex digits a part) and error (long) of every vector.

    Codebooks start as the parts of the ``entries`` (256 at most) smallest ids, ascending, of equal ids the smaller vector;
    fewer vectors make fewer entries. Each round assigns all parts and moves every entry to the floored mean of its own.

    Null vectors and those with null or non-finite components go. Vectors have one length, the most frequent one (of
    equals the smaller): others go too. Where ``parts`` does not divide it, parts are as equal as can be, and
    those of no component have code 00. Components beyond the bound of 2 ** 24 after scaling are held there.
    No usable vector gives no rows and no codebooks. Repeated rows are coded each.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.select(id_col, vec_col, *keep), vec_col).select(F.col(id_col).alias("__id"), "__v", *keep)
    lengths = rows.groupBy(F.size("__v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = f"__id {vectors.schema[id_col].dataType.simpleString()}, " + "".join(f"{c} {vectors.schema[c].dataType.simpleString()}, " for c in keep)
    if not lengths:
        return spark.createDataFrame([], f"{schema}code string, error long").withColumnRenamed("__id", id_col), None
    dim = lengths[0]["d"]
    rows = rows.filter(F.size("__v") == dim)
    first = [r["__v"] for r in rows.orderBy("__id", "__v").limit(entries).collect()]
    books = Codebooks.starting(scaled(np.array(first, dtype=np.float64).reshape(-1), dim, scale) if dim else np.empty((len(first), 0), dtype=np.int64), parts)
    vectors_only = rows.select("__v")
    for _ in range(rounds if dim else 0):
        shared = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            added, held = [np.zeros_like(t) for t in own.tables], [np.zeros(len(t), dtype=np.int64) for t in own.tables]
            for _, x in _slices(batches, 0, dim, scale):
                codes, _ = own.assign(x)
                for p in range(parts):
                    np.add.at(added[p], codes[:, p], x[:, own.ends[p] : own.ends[p + 1]])
                    held[p] += np.bincount(codes[:, p], minlength=len(held[p]))
            for p in range(parts):
                used, width = np.flatnonzero(held[p]), added[p].shape[1]
                flat = {"part": np.full(len(used) * width, p), "entry": np.repeat(used, width), "at": np.tile(np.arange(width), len(used)), "s": added[p][used].reshape(-1), "n": np.repeat(held[p][used], width)}
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in flat.values()], names=list(flat))

        merged = vectors_only.mapInArrow(sums, "part long, entry long, at long, s long, n long").groupBy("part", "entry", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        books = books.moved({(r["part"], r["entry"], r["at"]): (r["s"], r["n"]) for r in merged.collect()})  # entries x dim rows at most
    shared = spark.sparkContext.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _slices(batches, 1, dim, scale):
            codes, error = shared.value.assign(x)
            hexed = codes.tobytes().hex()
            text = [hexed[i : i + 2 * parts] for i in range(0, len(hexed), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(text, pa.string()), pa.array(error, pa.int64())], names=["__id", *keep, "code", "error"])

    return rows.mapInArrow(coded, f"{schema}code string, error long").withColumnRenamed("__id", id_col), books
