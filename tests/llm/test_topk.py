import numpy as np
from pyspark.sql import functions as F

from spanforge.llm import topk as K


def brute(rows, asked, k):
    good = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i in asked:
            s = sorted((-int(q @ v), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out += [(i, r, j, -x) for r, (x, j) in enumerate(s, 1)]
    return sorted(out)


def test_matches_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(int(i), v.tolist()) for i, v in enumerate(r.normal(size=(700, 12)))]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]
    rows += [(2000, None), (2001, [1.0, None] * 6), (2002, [float("nan")] * 12), (2003, [float("inf")] * 12), (2004, [0.0] * 12), (2005, [1.0, -2.0]), (2050, [0.5, 0.5]), (None, [1.0] * 12), (2100, [])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<double>, score int")
    for block, piece_bytes in ((64, 500), (4096, 1 << 20)):
        got = K.top_k(df.repartition(3), F.col("vec_id") % 50 == 0, block=block, piece_bytes=piece_bytes).collect()
        assert sorted(tuple(x)[:4] for x in got) == brute(rows, {i for i, _ in rows if i is not None and i % 50 == 0}, 5)
    assert K.top_k(df.filter("false"), F.lit(True)).count() == 0


def test_bounds_and_large_values(spark):
    r = np.random.default_rng(2)
    x = r.integers(-90, 90, (3000, 20))
    index, q = K.Index(x), r.integers(-90, 90, 20)
    found, share = index.search(q, 5, np.array([7]))
    s = x @ q
    s[7] = -(10**9)
    assert set(np.flatnonzero(s >= np.sort(s)[-5])) <= set(found.tolist()) and len(found) < 3000 * K.FEW and share < 1
    # where few components matter, few postings are met
    y = r.integers(-9, 9, (3000, 20))
    y[:, :3] += r.choice([-200, 200], (3000, 3))
    p = np.append([180, -190, 170], r.integers(-9, 9, 17))
    found, share = K.Index(y).search(p, 5, np.array([], int))
    assert set(np.argsort(-(y @ p), kind="stable")[:5]) <= set(found.tolist()) and share < 0.5
    big = [(i, [float(2**40 + i), float(i)]) for i in range(100)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = K.top_k(df, F.col("vec_id") == 0).collect()
    assert len(got) == 5


def test_any_number_of_lengths(spark):
    r = np.random.default_rng(3)
    rows = [(2 * n + i, r.normal(size=n).tolist()) for n in range(1, 1041) for i in (0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = K.top_k(df, F.lit(True), piece_bytes=1 << 22).collect()
    assert sorted((x.query_id, x.vec_id) for x in got) == sorted((a, b) for n in range(1, 1041) for a, b in ((2 * n, 2 * n + 1), (2 * n + 1, 2 * n)))
