"""Approximate nearest neighbours by additive quantisation.

Fitting: full-dimensional codebooks are learnt one after another on the residuals of a bounded, documented
sample (k-means each), then refined: vectors are encoded anew by beam search over all codebooks, and all
codewords are solved for together by ridge least squares.
Encoding: every vector is normalised and coded by beam search, keeping the ``beam`` best partial sums; the squared
norm of each decoded vector is stored beside its codes.
Search: a query's inner products with all codewords make a lookup table; an item's score is the sum of its
table entries over its stored norm. The best ``rerank`` items of every block are scored exactly, in double
precision, on the original vectors.

Every row is indexed. The stated queries and the index meet in blocks of bounded size: each block of the index is
read with each block of queries. Only the best ``k`` of a block leave it. Blocks are dealt by ids, so a vector that a
third of all rows hold is spread evenly, and inside a block its rows are scored once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 without overflow or underflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class AdditiveQuantizer:
    """``n_books`` codebooks of ``n_words`` full-dimensional codewords; a vector is approximated by one word of each."""

    def __init__(self, books: np.ndarray, beam: int):
        self.books, self.beam = books, beam
        self.gram = np.einsum("akd,bjd->abkj", books, books)
        self.square = (books * books).sum(axis=2)

    @classmethod
    def fit(cls, x: np.ndarray, n_books: int = 16, n_words: int = 64, beam: int = 8, rounds: int = 2, seed: int = 3) -> AdditiveQuantizer:
        """Fit on the rows of ``x``; fewer rows than codewords leave the other codewords at zero."""
        rng, residual, books = np.random.default_rng(seed), x.copy(), np.zeros((n_books, n_words, x.shape[1]))
        for m in range(n_books):
            n = min(n_words, len(x))
            words = residual[rng.choice(len(x), n, replace=False)]
            for _ in range(8):
                near = ((words * words).sum(axis=1) - 2 * residual @ words.T).argmin(axis=1)
                sums, held = np.zeros_like(words), np.bincount(near, minlength=n)
                np.add.at(sums, near, residual)
                words = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], words)
            near = ((words * words).sum(axis=1) - 2 * residual @ words.T).argmin(axis=1)
            books[m, :n] = words
            residual -= words[near]
        for _ in range(rounds):
            codes = cls(books, beam).encode(x)
            a = np.zeros((len(x), n_books * n_words))
            for m in range(n_books):
                a[np.arange(len(x)), m * n_words + codes[:, m]] = 1
            books = np.linalg.solve(a.T @ a + 0.1 * np.eye(a.shape[1]), a.T @ x + 0.1 * books.reshape(a.shape[1], -1)).reshape(books.shape)
        return cls(books, beam)

    def encode(self, x: np.ndarray, rows: int = 2048) -> np.ndarray:
        """Codes by beam search: at each codebook the best ``beam`` partial sums of all extensions are kept."""
        return np.concatenate([self._encode(x[i : i + rows]) for i in range(0, len(x), rows)]) if len(x) else np.empty((0, len(self.books)), dtype=np.int64)

    def _encode(self, x: np.ndarray) -> np.ndarray:
        n_books, n_words, _ = self.books.shape
        n, codes, cost = len(x), np.zeros((len(x), 1, 0), dtype=np.int64), np.zeros((len(x), 1))
        for m in range(n_books):
            # |x - s - c|^2 = |x - s|^2 + |c|^2 - 2 x.c + 2 s.c, with s.c from the codebooks' Gram matrices
            more = np.broadcast_to((self.square[m] - 2 * x @ self.books[m].T)[:, None, :], (n, codes.shape[1], n_words)).copy()
            for j in range(m):
                more += 2 * self.gram[j, m][codes[:, :, j]]
            every = (cost[:, :, None] + more).reshape(n, -1)
            keep = min(self.beam, every.shape[1])
            best = np.argpartition(every, keep - 1, axis=1)[:, :keep]
            cost = np.take_along_axis(every, best, axis=1)
            parent = np.take_along_axis(codes, (best // n_words)[:, :, None], axis=1)
            codes = np.concatenate([parent, (best % n_words)[:, :, None]], axis=2)
        return codes[np.arange(n), cost.argmin(axis=1)]

    def norms(self, codes: np.ndarray) -> np.ndarray:
        """Lengths of the decoded vectors, stored beside the codes."""
        return np.sqrt((sum(self.books[m][codes[:, m]] for m in range(len(self.books))) ** 2).sum(axis=1))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries with all codewords: query x codebook x codeword."""
        return np.einsum("qd,mkd->qmk", q, self.books)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and vector (array<double>) of the rows that take part: no null, NaN or infinite component, not all zero."""
    v = F.col("v")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0)
    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.coalesce(good, F.lit(False)) & F.col("id").isNotNull())


def fit_quantizer(vectors: DataFrame, *, id_col: str, vec_col: str, fit_rows: int = 4000, dim: int | None = None, **params) -> AdditiveQuantizer | None:
    """Fit on at most ``fit_rows`` vectors, the first by a hash of the id. None where no vector takes part.

    Vectors of one length can be near each other: ``dim``, or else the most frequent length, of equals the smaller.
    """
    rows = usable(vectors, id_col, vec_col)
    if dim is None:
        lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
        dim = lengths[0]["d"] if lengths else 0
    rows = rows.filter(F.size("v") == dim)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(fit_rows).collect()
    if not sample:
        return None
    return AdditiveQuantizer.fit(_unit(np.array([r["v"] for r in sample])), **params)


def encode_vectors(vectors: DataFrame, quantizer: AdditiveQuantizer, *, id_col: str, vec_col: str) -> DataFrame:
    """The index: id, v, codes (array<int>) and norm of every row that takes part and has the quantiser's dimension."""
    dim = quantizer.books.shape[2]
    rows = usable(vectors, id_col, vec_col).filter(F.size("v") == dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            codes = quantizer.encode(_unit(x))
            listed = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32), pa.array(codes.ravel(), type=pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), listed, pa.array(quantizer.norms(codes), type=pa.float64())], names=["id", "v", "codes", "norm"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, codes array<int>, norm double")


def _matrix(column: pa.Array | pa.ChunkedArray, width: int, dtype=np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=dtype).reshape(-1, width)


def _one_each(rows: pa.Table, dim: int) -> pa.Table:
    """The rows by id; of several with one id, which are all in one block, the smallest vector."""
    ids = np.asarray(rows["id"])
    order = np.argsort(ids, kind="stable")
    if len(np.unique(ids)) < len(ids):
        order = np.lexsort((*_matrix(rows["v"], dim).T[::-1], ids))
        order = order[np.concatenate(([True], ids[order][1:] != ids[order][:-1]))]
    return rows.take(pa.array(order))


def search(index: DataFrame, queries: DataFrame, quantizer: AdditiveQuantizer, *, k: int = 5, rerank: int = 160, index_block: int = 8192, query_block: int = 4096) -> DataFrame:
    """query_id, rank, id and score of each query's ``k`` nearest index rows but itself, ties to the smaller id.

    ``index`` is what ``encode_vectors`` returns; ``queries`` has id and v. Equal vectors are ranked as one
    class inside a block, so groups of copies hide nothing. Rows of one id are one vector, the smallest by its
    components, both as candidates and as queries. A query with fewer candidates gets them all; without index rows
    or queries there are no rows. ``rerank`` rows of each block are scored exactly.
    """
    n_index, n_query = (max(1, -(-df.count() // per)) for df, per in ((index, index_block), (queries, query_block)))
    dim, n_books = quantizer.books.shape[2], len(quantizer.books)
    ib, qb = F.pmod(F.xxhash64("id"), F.lit(n_index)).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_query)).cast("int")
    items = index.withColumn("ib", ib).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))
    asked = queries.select("id", "v").withColumn("qb", qb).withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(n_index - 1))))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            left, right = _one_each(left, dim), _one_each(right, dim)
            ids, x, codes, norm = np.asarray(left["id"]), _matrix(left["v"], dim), _matrix(left["codes"], n_books, np.int64), np.asarray(left["norm"])
            _, first, copy_of = np.unique(x, axis=0, return_index=True, return_inverse=True)
            copy_of = copy_of.ravel()
            members = np.argsort(copy_of, kind="stable")  # by class, then by id
            begin = np.searchsorted(copy_of[members], np.arange(len(first) + 1))
            own, own_codes, own_norm, unit = x[first], codes[first], np.maximum(norm[first], 1e-12), _unit(x[first])
            qx = _matrix(right["v"], dim)
            q_unit = _unit(qx)
            for i, q in enumerate(np.asarray(right["id"])):
                table = quantizer.tables(q_unit[i : i + 1])[0]
                rough = sum(table[m][own_codes[:, m]] for m in range(n_books)) / own_norm
                near = np.argpartition(-rough, rerank)[:rerank] if len(rough) > rerank else np.arange(len(rough))
                exact = cosines(own[near], qx[i], unit[near], q_unit[i])
                cand = [(-exact[j], int(v)) for j, c in enumerate(near) for v in ids[members[begin[c] : min(begin[c + 1], begin[c] + k + 1)]] if v != q]
                for s, v in sorted(cand)[:k]:
                    out[0].append(q), out[1].append(v), out[2].append(-s)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = items.groupBy("ib", "qb").cogroup(asked.groupBy("ib", "qb")).applyInArrow(block, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def cosines(x: np.ndarray, q: np.ndarray, unit: np.ndarray, q_unit: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each row summed alone and in one order, so equal vectors score equally.

    The plain quotient is used where its terms neither overflow nor underflow, else that of scaled vectors.
    """
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        square = (x * x).sum(axis=1) * (q * q).sum()
        plain = (x * q).sum(axis=1) / np.sqrt((x * x).sum(axis=1)) / np.sqrt((q * q).sum())
    return np.where(np.isfinite(square) & (square > 1e-200), plain, (unit * q_unit).sum(axis=1))
