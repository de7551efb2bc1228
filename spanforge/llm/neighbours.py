"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves and each half is quantised by a codebook of its own, fitted by k-means on a
bounded sample; a row's cell is its pair of nearest centroids. A query walks the pairs of centroids by the sum
of their squared distances, with a heap, until the cells it has passed hold a set share of all rows; the share
is the smallest one that gave the wanted recall on the sample, and codebooks grow while that makes a query
cheaper by the sample's figures (rows to rerank, and cells to pass). All rows of these cells are reranked by
their exact distance.

Cells are stored in blocks of bounded size, so a cell with many rows is worked on by many tasks. Queries are
broadcast in pieces of bounded size, each with the sum at which its walk ended; a block of a cell finds from
the centroids which queries passed it, so nothing is copied for each query and cell. With several pieces each
one's result is cut by checkpoint() before the next is sent.

Defined results: a vector that is null, zero or has a null or non-finite component takes no part; vectors of
different length don't meet; each of the MOST_INDEXED lengths with most rows has an index of its own, and all
others, as well as lengths that fit into one block, are searched exactly; repeated rows are separate candidates,
except that a query never finds a row with its own id; ties go to the smaller id; other columns are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .flat import shared_dir
from .topk import PIECE_BYTES, blocks, finite

#: Lengths that are indexed at most, centroids of a half at most, and what passing a cell costs a query, in rows to rerank.
MOST_INDEXED, MOST_CENTRES, CELL = 64, 512, 10

@dataclass
class Codebooks:
    """centres: of each half; visit: share of all rows that a query passes."""

    centres: tuple[np.ndarray, np.ndarray]
    visit: float

    @property
    def cut(self) -> int:
        return self.centres[0].shape[1]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of every vector's halves to their centroids."""
        return tuple(((part**2).sum(1)[:, None] - 2 * part @ c.T + (c**2).sum(1)[None, :]) for part, c in zip((x[:, : self.cut], x[:, self.cut :]), self.centres, strict=True))

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(1) * len(self.centres[1]) + b.argmin(1)


def walk(a: np.ndarray, b: np.ndarray) -> Iterator[int]:
    """Cells by ascending a[i] + b[j]: the multi-sequence algorithm."""
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, done = [(a[by_a[0]] + b[by_b[0]], 0, 0)], np.zeros(len(a) + 1, np.int64)
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(by_a[i]) * len(b) + int(by_b[j])
        done[i] = j + 1
        if j + 1 < len(b) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (a[by_a[i]] + b[by_b[j + 1]], i, j + 1))
        if i + 1 < len(a) and done[i + 1] == j:
            heapq.heappush(heap, (a[by_a[i + 1]] + b[by_b[j]], i + 1, j))


def passed(a: np.ndarray, b: np.ndarray, counts: np.ndarray, least: float) -> float:
    """The sum a[i] + b[j] up to which the walk passes cells that hold at least so many rows."""
    held = 0
    for cell in walk(a, b):
        held += counts[cell]
        if held >= least:
            return float(a[cell // len(b)] + b[cell % len(b)])
    return np.inf


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of x, from k-means++ seeds; as many as there are different rows if these are fewer."""
    x = np.asarray(x, float)
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    far = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k and far.sum() > 0:
        centres.append(x[rng.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        near = ((c**2).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        size = np.bincount(near, minlength=len(c))
        for d in range(x.shape[1]):
            total = np.bincount(near, x[:, d], len(c))
            c[:, d] = np.where(size > 0, total / np.maximum(size, 1), c[:, d])
    return c


def fit(sample: np.ndarray, cells_a_half: int, recall: float, k: int, seed: int = 3, asked: int = 200) -> Codebooks:
    """Codebooks of the sample, and the share of rows to visit for the recall among `asked` of its rows."""
    cut = max(1, sample.shape[1] // 2)
    # a vector of one component has an empty second half
    books = Codebooks((k_means(sample[:, :cut], cells_a_half, 12, seed), k_means(sample[:, cut:], cells_a_half, 12, seed + 1) if sample.shape[1] > 1 else np.zeros((1, 0))), 1.0)
    n = len(sample)
    if n <= 4 * k or recall >= 1:
        return books
    pick = np.random.default_rng(seed).choice(n, min(asked, n), replace=False)
    cells = books.cells(sample)
    counts = np.bincount(cells, minlength=len(books.centres[0]) * len(books.centres[1]))
    a, b = books.halves(sample[pick])
    needed = []
    for row, i in enumerate(pick):
        d = ((sample - sample[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argpartition(d, k)[:k]
        order = np.argsort((a[row][:, None] + b[row][None, :]).ravel(), kind="stable")
        held = np.empty(len(order))
        held[order] = np.cumsum(counts[order])
        needed.append(np.sort(held[cells[near]]) / n)
    books.visit = float(min(1.0, np.quantile(np.concatenate(needed), recall)))
    return books


def fitted(sample: np.ndarray, n: int, recall: float, k: int) -> Codebooks:
    """The codebooks that make a query cheapest: twice as many centroids each time, while that costs less over n rows."""
    best, least, size = None, np.inf, 4
    while best is None or (size <= MOST_CENTRES and size * size <= max(n // 4, 16)):
        books = fit(sample, size, recall, k)
        cost = books.visit * (n + CELL * len(books.centres[0]) * len(books.centres[1]))
        if cost >= least:
            break
        best, least, size = books, cost, 2 * size
    return best


def _best(key: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of each key."""
    by = np.lexsort((ids, d, key))
    key, ids, d = key[by], ids[by], d[by]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    place = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return key[place < k], ids[place < k], d[place < k]


def _rank(k: int, shared, books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, indexed = shared.value, books.value
        held: list[tuple] = []
        rows = 0
        for r in (b.slice(i, 1).to_pylist()[0] for b in batches for i in range(b.num_rows)):
            dim = r["dim"]
            if dim not in asked:
                continue
            keys, q, ends = asked[dim]
            ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["data"], np.float64).reshape(-1, dim)
            if r["cell"] >= 0:
                own = indexed[dim]
                i, j = divmod(r["cell"], len(own.centres[1]))
                a, b = Codebooks((own.centres[0][i : i + 1], own.centres[1][j : j + 1]), 0.0).halves(q)
                # a little more, as sums of the same terms may differ in their last bits
                at = np.flatnonzero((a + b)[:, 0] <= ends + 1e-9 * (1 + np.abs(ends)))
            else:
                at = np.arange(len(q))
            norm = (x**2).sum(1)
            for some in np.split(at, range(256, len(at), 256)):
                about = norm[None, :] - 2 * q[some] @ x.T
                room = 1e-9 * (norm.max() + (q[some] ** 2).sum(1))
                for row, i in enumerate(some.tolist()):
                    near = np.flatnonzero(ids != keys[i])
                    if len(near) > k:
                        d = about[row][near]
                        near = near[d <= np.partition(d, k - 1)[k - 1] + room[row]]
                    d = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
                    held.append((np.full(len(near), keys[i]), ids[near], d))
                    rows += len(near)
            if rows > 1 << 18:
                held = [_best(*(np.concatenate(c) for c in zip(*held, strict=True)), k)]
                rows = len(held[0][0])
                if rows > 1 << 17:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["query_id", "vec_id", "score"])
                    held, rows = [], 0
        if held:
            found = _best(*(np.concatenate(c) for c in zip(*held, strict=True)), k)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    return run


def _sample(own: DataFrame, dim: int, n: int, rows: int) -> np.ndarray:
    """About `rows` vectors of the length, by a hash of their ids."""
    near = own.filter((F.size("v") == dim) & (F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 31)) < int(min(1.0, rows / n) * (1 << 31))))
    sample = near.select("id", "v").limit(2 * rows).toArrow().sort_by("id")
    values = np.concatenate([np.asarray(c.flatten(), float) for c in sample["v"].chunks] or [np.zeros(0)]).reshape(-1, dim)
    return values if len(values) else np.zeros((1, dim))


def _by_length(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors and ends of walks for each length."""
    v, out = table["v"].combine_chunks(), {}
    sizes = np.asarray(v.value_lengths(), np.int64)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        out[dim] = np.asarray(table["id"], np.int64)[at], np.asarray(v.take(pa.array(at)).flatten(), float).reshape(-1, dim), np.asarray(table["ends"], float)[at]
    return out


def nearest(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, recall: float = 0.94, sample_rows: int = 8192, block: int = 4096, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is a query the k nearest other rows found, by Euclidean distance.

    recall: the share of true neighbours that the visited cells are to hold, as measured on the sample of about
    sample_rows rows of a length; 1 visits all cells. All rows are indexed.
    """
    spark = df.sparkSession
    shared_dir(spark)
    good = finite(F.col(vector)) & F.exists(vector, lambda x: x != 0) & F.col(key).isNotNull()
    own = df.filter(good).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    large = own.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).filter(F.col("n") > block).orderBy(F.desc("n"), "dim").limit(MOST_INDEXED).collect()
    books = {r["dim"]: fitted(_sample(own, r["dim"], r["n"], sample_rows), r["n"], recall, k) for r in large}
    shared = spark.sparkContext.broadcast(books)  # MOST_INDEXED * 2 * MOST_CENTRES centroids at most

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            sizes = np.asarray(v.value_lengths(), np.int64)
            cell = np.full(len(sizes), -1, np.int32)
            for dim in set(sizes.tolist()) & set(shared.value):
                at = np.flatnonzero(sizes == dim)
                cell[at] = shared.value[dim].cells(np.asarray(v.take(pa.array(at)).flatten(), float).reshape(-1, dim))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], ["id", "v", "q", "cell"])

    rows = own.select("id", "v", "q").mapInArrow(placed, "id long, v array<double>, q boolean, cell int")
    counts = {dim: np.zeros(len(x.centres[0]) * len(x.centres[1]), np.int64) for dim, x in books.items()}
    for r in rows.filter("cell >= 0").groupBy(F.size("v").alias("dim"), "cell").agg(F.count("*").alias("n")).collect():  # one row a cell of the books
        counts[r["dim"]][r["cell"]] = r["n"]
    filled = spark.sparkContext.broadcast(counts)  # as above
    least = {r["dim"]: books[r["dim"]].visit * r["n"] + k for r in large}

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, ends = b.column("v"), np.full(b.num_rows, np.inf)
            sizes = np.asarray(v.value_lengths(), np.int64)
            for dim in set(sizes.tolist()) & set(shared.value):
                at = np.flatnonzero(sizes == dim)
                x, y = shared.value[dim].halves(np.asarray(v.take(pa.array(at)).flatten(), float).reshape(-1, dim))
                ends[at] = [passed(x[i], y[i], filled.value[dim], least[dim]) for i in range(len(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends)], ["id", "v", "ends"])

    stored = blocks(rows.select("cell", "id", "v"), block, "float64", ("cell",))
    asked = own.filter("q").select("id", "v")
    size = asked.agg(F.coalesce(F.sum(8 * (F.size("v") + 2)), F.lit(0))).first()[0]
    pieces = max(1, -(-size // piece_bytes))
    if pieces > 1:
        stored = stored.checkpoint()
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = None
    for i in range(pieces):
        piece = asked.filter(F.pmod(F.xxhash64("id"), F.lit(pieces)) == i).mapInArrow(walked, "id long, v array<double>, ends double").toArrow()
        sent = spark.sparkContext.broadcast(_by_length(piece))  # about piece_bytes
        part = stored.mapInArrow(_rank(k, sent, shared), "query_id long, vec_id long, score double")
        part = part.withColumn("rank", F.row_number().over(by).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if pieces > 1:
            part = part.checkpoint()
            sent.destroy()
        found = part if found is None else found.union(part)
    return found
