from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from spanforge.llm import neighbours as N


def test_walk_is_by_ascending_sum():
    r = np.random.default_rng(0)
    for a, b in ((7, 5), (1, 4), (3, 1)):
        x, y = r.random(a), r.random(b)
        cells = list(N.walk(x, y))
        sums = [x[c // b] + y[c % b] for c in cells]
        assert sorted(cells) == list(range(a * b)) and sums == sorted(sums)


def test_recall_and_exact_scores(spark):
    for sf in ("sf0.1",):
        df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        rows = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
        ids, x = np.array(list(rows)), np.array(list(rows.values()))
        got = defaultdict(list)
        for r in N.nearest(df, F.col("vec_id") % 20 == 0, sample_rows=1000).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        hits = total = 0
        for q, found in got.items():
            d = np.sqrt(((x - rows[q]) ** 2).sum(1))
            d[ids == q] = np.inf
            true = ids[np.lexsort((ids, d))[:10]]
            hits += len(set(true.tolist()) & {v for v, _ in found})
            total += 10
            assert len(found) == 10 and [s for _, s in found] == sorted(s for _, s in found)
            assert all(abs(s - np.sqrt(((rows[v] - rows[q]) ** 2).sum())) < 1e-12 for v, s in found)
        assert len(got) == sum(i % 20 == 0 for i in rows) and hits / total >= 0.9, hits / total


def test_edges(spark):
    rows = [(i, [float(i % 7), 1.0, float(i)]) for i in range(200)] + [(300 + i, [2.0, 2.0, 2.0]) for i in range(50)]
    rows += [(900, None), (901, [0.0, 0.0, 0.0]), (902, [None, 1.0, 1.0]), (903, [float("nan"), 1.0, 1.0]), (1000, [1.0]), (1001, [3.0]), (1100, [5.0, 5.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = defaultdict(list)
    for r in N.nearest(df, F.col("vec_id") % 100 == 0, recall=1.0, block=16, piece_bytes=60).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    good = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    for q in (0, 100, 300, 1000):
        want = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:10]
        assert got[q] == want, q
    assert 1100 not in got and 900 not in got
    assert N.nearest(df.filter("false"), F.lit(True)).count() == 0


def test_clustered_vectors_are_pruned():
    r = np.random.default_rng(5)
    x = r.normal(size=(40, 16))[r.integers(40, size=4000)] * 10 + r.normal(size=(4000, 16))
    books = N.fitted(x, len(x), 0.94, 10)
    assert books.visit < 0.1 and len(books.centres[0]) >= 8
    a, b = books.halves(x[:50])
    counts = np.bincount(books.cells(x), minlength=a.shape[1] * b.shape[1])
    for i in range(50):
        end = N.passed(a[i], b[i], counts, 300)
        sums = a[i][:, None] + b[i][None, :]
        assert counts[(sums <= end).ravel()].sum() >= 300 > counts[(sums < end).ravel()].sum()


def test_any_number_of_lengths(spark):
    r = np.random.default_rng(6)
    rows = [(10 * n + i, r.normal(size=n).tolist()) for n in range(1, 101) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (2, 100):  # with and without indexes
        got = sorted((x.query_id, x.rank, x.vec_id) for x in N.nearest(df, F.col("vec_id") % 10 == 0, recall=1.0, block=block, sample_rows=50).collect())
        want = []
        for n in range(1, 101):
            v = {i: np.array(x) for i, x in rows if i // 10 == n}
            near = sorted((float(np.sqrt(((v[j] - v[10 * n]) ** 2).sum())), j) for j in v if j != 10 * n)
            want += [(10 * n, k, j) for k, (_, j) in enumerate(near, 1)]
        assert got == sorted(want)
