"""Exact top-k inner-product search over an impact-ordered index, score at a time.

Vectors become integers. Rows are dealt to blocks of bounded size; each block is indexed by component: its
postings lie by value in segments of equal quantised impact. A query orders all segments of a block by the
most that a posting of them can add and works through them in that order, adding to accumulators. What a
vector can still gain is bounded by the best unseen segment of each component it hasn't been met in. The
first few segments give candidates whose exact scores set a mark; the segments' bounds alone then tell from
where on a vector not met at all can't reach it, and there the bounds of all vectors are looked at. Those that
reach the k-th best exact score found are possible members; work stops when scoring them exactly costs less
than more postings, which proves that no other vector can be among the best. Blocks' results meet in a window
per query.

Rows are packed once; the queries are broadcast in pieces of bounded size, so nothing is copied for each pair
of blocks. With several pieces each one's result is cut by checkpoint() before the next is sent.

Defined results: a vector that is null or has a null or non-finite component takes no part; vectors of
different length don't meet, and there may be any number of lengths; repeated rows are separate candidates,
except that a query never finds a row with its own id; ties go to the smaller id; other columns are left out.
Components are expected to fit a long after scaling; sums beyond 2**53 are computed in wrapping 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .flat import shared_dir

LEVELS = 32
#: Shares of a block's postings: worked through to set a mark, after the point from which a vector not met at all cannot reach it,
#: and between further looks at the bounds; share of its rows whose exact
#: scores cost less than the postings between two looks.
SEEDS, FIRST, STEP, FEW = 0.02, 0.18, 0.08, 0.25
PACKED = "dim int, block int, ids binary, data binary"
#: Bytes of queries that are broadcast at a time; lengths with several blocks that are broadcast at most.
PIECE_BYTES, FEW_LENGTHS = 32 << 20, 10_000


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, good), F.lit(False))


def blocks(df: DataFrame, size: int, kind: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """df (keys, id, v) as packed blocks of about size rows of one length (and keys): keys, dim, block, ids, data."""
    by = [*keys, "dim"]
    sized = df.withColumn("dim", F.size("v"))
    # only groups with more rows than a block have to be known, at most one in `size` rows
    large = sized.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > size).select(*by, F.ceil(F.col("n") / size).alias("many"))
    found = large.limit(FEW_LENGTHS + 1).collect()
    if len(found) <= FEW_LENGTHS:
        large = F.broadcast(df.sparkSession.createDataFrame(found, large.schema))  # FEW_LENGTHS rows at most
    dealt = sized.join(large, by, "left").withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce("many", F.lit(1))).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        values = np.concatenate([np.asarray(c.flatten(), kind) for c in table["v"].chunks])
        ids = np.asarray(table["id"], np.int64)
        made = {c: table[c][:1] for c in [*by, "block"]} | {"ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([values.tobytes()], pa.binary())}
        return pa.table(made)

    head = "".join(f"{c} {sized.schema[c].dataType.simpleString()}, " for c in keys)
    return dealt.select(*by, "block", "id", "v").groupBy(*by, "block").applyInArrow(pack, head + PACKED)


class Index:
    """Posting segments of one block: rows x components of integers."""

    def __init__(self, values: np.ndarray):
        self.values = values
        n, dims = values.shape
        by = np.argsort(values, axis=0, kind="stable").T
        self.docs = np.ascontiguousarray(by)
        sorted_ = np.take_along_axis(values.T, by, 1)
        span = np.maximum(sorted_[:, -1:] - sorted_[:, :1], 1)
        level = (sorted_ - sorted_[:, :1]).astype(float) * LEVELS // (span + 1)
        head = np.ones((dims, n), bool)
        head[:, 1:] = level[:, 1:] != level[:, :-1]
        start = np.flatnonzero(head.ravel())
        end = np.append(start[1:], n * dims)
        self.vals = sorted_.astype(float)
        flat = self.vals.ravel()
        self.low, self.high, self.dim, self.size = flat[start], flat[end - 1], start // n, end - start
        self.first = np.searchsorted(self.dim, np.arange(dims))

    def search(self, q: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, float]:
        """Rows (positions) that may hold the k best scores for q, without those in skip: all whose bound reaches the k-th best
        exact score seen; and the share of all postings worked through."""
        n, dims = self.values.shape
        if n <= 4 * k + len(skip):
            return np.arange(n), 0.0
        weight = q.astype(float)
        high = weight > 0
        bound = np.maximum(weight[self.dim] * self.low, weight[self.dim] * self.high)
        order = np.argsort(-bound, kind="stable")
        work = np.cumsum(self.size[order])
        # what the bound of a component falls to after each segment: the next one's, 0 after the last
        beside = np.zeros((2, len(bound)))
        beside[0, 1:], beside[1, :-1] = np.where(np.diff(self.dim) == 0, bound[:-1], 0), np.where(np.diff(self.dim) == 0, bound[1:], 0)
        after = np.where(high[self.dim], beside[0], beside[1])
        edge = np.where(high, np.append(self.first[1:], len(bound)) - 1, self.first)
        unseen = bound[edge].sum() + np.cumsum((after - bound)[order])

        def bounds(to: int) -> np.ndarray:
            # of each component the segments so far are one end of its postings: the high end where the weight is positive
            count = np.bincount(self.dim[order[:to]], self.size[order[:to]], dims).astype(np.int64)
            next_ = np.clip(np.where(high, n - count - 1, count), 0, n - 1)
            best = np.where(count < n, weight * self.vals[np.arange(dims), next_], 0.0)  # most that an unseen posting adds
            ends = [(j, slice(n - c, n) if h else slice(0, c)) for j, (c, h) in enumerate(zip(count.tolist(), high.tolist(), strict=True)) if c]
            # what has been met in place of the bound for it, over the bounds of all components
            reach = np.full(n, best.sum())
            for j, s in ends:
                reach[self.docs[j, s]] += self.vals[j, s] * weight[j] - best[j]
            reach[skip] = -np.inf
            return reach

        def marked(reach: np.ndarray) -> float:
            """The k-th best of the exact scores of the rows that reach furthest."""
            top = np.argpartition(-reach, 2 * k)[: 2 * k]
            scores = np.sort((self.values[top] @ q)[reach[top] > -np.inf])
            return float(scores[-k]) if len(scores) >= k else -np.inf

        to = min(int(np.searchsorted(work, SEEDS * n * dims, "left")) + 1, len(order))
        mark = marked(bounds(to))
        to = min(max(to, int(np.searchsorted(-unseen, -mark, "right")) + 1), len(order))
        to = min(int(np.searchsorted(work, work[to - 1] + FIRST * n * dims, "left")) + 1, len(order))
        while True:
            reach = bounds(to)
            mark = max(mark, marked(reach))
            possible = np.flatnonzero(reach >= mark - 0.5)
            if len(possible) <= max(8 * k, int(n * FEW)) or to == len(order):
                return possible, float(work[to - 1]) / (n * dims)
            to = min(max(to + 1, int(np.searchsorted(work, work[to - 1] + STEP * n * dims, "left")) + 1), len(order))


def _search(k: int, shared):
    names = ["query_id", "vec_id", "score", "rescored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                dim = r["dim"]
                if dim not in asked:
                    continue
                keys, queries = asked[dim]
                ids = np.frombuffer(r["ids"], np.int64)
                values = np.frombuffer(r["data"], np.int64).reshape(len(ids), dim)
                largest = max(abs(int(values.min(initial=0))), int(values.max(initial=0))) * max(abs(int(queries.min(initial=0))), int(queries.max(initial=0))) * max(dim, 1)
                small = largest < 1 << 52 and dim > 0
                index = Index(values) if small else None
                for at in range(0, len(keys), 1024):
                    out = []
                    for key, q in zip(keys[at : at + 1024], queries[at : at + 1024], strict=True):
                        found, share = index.search(q, k, np.flatnonzero(ids == key)) if small else (np.arange(len(ids)), 0.0)
                        rescored = len(found) / len(ids)
                        found = found[ids[found] != key]
                        score = values[found] @ q
                        by = np.lexsort((ids[found], -score if small else ~score))[:k]
                        out.append((np.full(len(by), key), ids[found[by]], score[by], np.full(len(by), rescored)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names)

    return run


def _by_length(packed: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of each length from a table of id and v."""
    sizes = np.asarray(packed["v"].combine_chunks().value_lengths(), np.int64)
    ids, flat = np.asarray(packed["id"], np.int64), np.concatenate([np.asarray(c.flatten(), np.int64) for c in packed["v"].chunks] or [np.zeros(0, np.int64)])
    first = np.cumsum(sizes) - sizes
    out = {}
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        out[dim] = ids[at], flat[first[at][:, None] + np.arange(dim)[None, :]]
    return out


def top_k(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256.0, block: int = 8192, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is a query its k best other rows by integer inner product of floor(scale * x);
    rescored: the share of the found row's block that was scored exactly for the query."""
    shared_dir(df.sparkSession)
    own = df.filter(finite(F.col(vector)) & F.col(key).isNotNull())
    ints = own.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    asked = ints.filter("q").select("id", "v")
    size = asked.agg(F.coalesce(F.sum(8 * (F.size("v") + 1)), F.lit(0))).first()[0]
    pieces = max(1, -(-size // piece_bytes))
    rows = blocks(ints.select("id", "v"), block, "int64")
    if pieces > 1:
        rows = rows.checkpoint()
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = None
    for i in range(pieces):
        sent = df.sparkSession.sparkContext.broadcast(_by_length(asked.filter(F.pmod(F.xxhash64("id"), F.lit(pieces)) == i).toArrow()))  # about piece_bytes
        part = rows.mapInArrow(_search(k, sent), "query_id long, vec_id long, score long, rescored double")
        part = part.withColumn("rank", F.row_number().over(by).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "rescored")
        if pieces > 1:
            part = part.checkpoint()
            sent.destroy()
        found = part if found is None else found.union(part)
    return found
