import math
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spanforge.llm import hpylm as H


def tokens(t):
    return [*(t or "").encode().lower().split(), None]


def test_counts_and_base_score_match_brute_force(spark):
    rows = [(1, "the of the and", True), (2, "The zebra of", False), (3, None, True), (4, "", False), (5, " \n ", True), (1, "the of the and", True), (None, "of " * 5000, True), (6, "ü É é unseen-word", False)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, train boolean, score string")
    for batch, bucket in ((1 << 20, 1 << 20), (40, 1000)):
        out = H.score(df.repartition(2), F.col("train"), batch_bytes=batch, bucket_bytes=bucket).collect()
        count = Counter(w for _, t, train in rows if train for w in tokens(t))
        n, v = sum(count.values()), len(count)
        want = sorted((i or 0, train, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for i, t, train in rows)
        assert sorted((r.key or 0, r.train, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
        assert all(r.score < 0 for r in out)


def test_model_is_a_distribution():
    r = np.random.default_rng(0)
    words, contexts, kind = 60, 5, np.array([3, 3, 9, 9, 9])
    c = r.poisson(r.gamma(0.3, 3, (words, contexts)))
    word, context = (x.ravel() for x in np.indices(c.shape))
    b = H.Bucket.of(c.ravel(), context, word, kind[context], words)
    known = int((c.sum(1) > 0).sum())
    by_class = lambda x: [np.bincount(b.kind, x, 10)[[3, 9]]]
    met = np.bincount(b.section, b.c > 0, len(b.word))
    prior = H.Totals(c.sum(0), [(c > 0).sum(0)], np.array([3, 9]), by_class(met), by_class(met > 0), [(met > 0).sum()], [known], int(c.sum()), known, 0.6, 0.5, 0.4, seeds=(1, 2))
    for x in H.sweeps(b, 0, prior, 2, 3):
        assert (x.t <= b.c).all() and (x.t >= np.minimum(b.c, 1)).all() and (x.t1 <= x.c1).all() and (x.t0 <= x.c0).all()
        assert (x.c1 == np.bincount(b.section, x.t)).all() and (x.c0 == np.bincount(b.word, x.t1)).all() and ((x.t1 > 0) == (x.c1 > 0)).all()
        now = H.replace(prior, t=[np.bincount(b.context, x.t)], c1=by_class(x.c1), t1=by_class(x.t1), c0=[x.c0.sum()], t0=[x.t0.sum()])
        at = np.searchsorted(now.classes, kind[context])
        p = H.predictive(b.c, x.t, context, x.c1[b.section], x.t1[b.section], at, x.c0[word], x.t0[word], now, 0).reshape(c.shape)
        # one unknown word has the probability of any word without training count
        unknown = np.flatnonzero(b.c_word == 0)[:1]
        assert len(unknown) and np.allclose(p[b.c_word > 0].sum(0) + p[unknown[0]], 1)


def plain_gibbs(docs, held, rounds, burn, seed):
    """One customer at a time, each table known: the mean log10 probability of the held texts under the samples after burn."""
    rng = np.random.default_rng(seed)
    ending = lambda u: u.encode()[-2:] if u else b""
    chain = lambda u: [("u", u), ("k", ending(u)), ("r",)]
    read = lambda t: list(zip([None, *t.split()], [*t.split(), None], strict=True))
    pairs = [p for t in docs for p in read(t)]
    types = len({w for _, w in pairs})
    spread = lambda keys: Counter(Counter(keys).values())
    n2, n1, n0 = spread(pairs), spread([(ending(u), w) for u, w in set(pairs)]), spread([w for _, w in {(ending(u), w) for u, w in pairs}])
    d = [min(max(n[1] / max(n[1] + 2 * n[2], 1), 0.05), 0.95) for n in (n2, n1, n0)]
    seats = {}  # restaurant -> dish -> sizes of tables

    def prob(path, level, w):
        if level == 3:
            return 1 / (types + 1)
        tables = seats.get(path[level], {})
        total, many, mine = sum(map(sum, tables.values())), sum(map(len, tables.values())), tables.get(w, [])
        return (sum(mine) - d[level] * len(mine) + (1 + d[level] * many) * prob(path, level + 1, w)) / (1 + total)

    def add(path, level, w):
        if level == 3:
            return
        tables = seats.setdefault(path[level], {})
        mine, many = tables.setdefault(w, []), sum(map(len, tables.values()))
        odds = np.array([x - d[level] for x in mine] + [(1 + d[level] * many) * prob(path, level + 1, w)])
        at = rng.choice(len(odds), p=odds / odds.sum())
        if at < len(mine):
            mine[at] += 1
        else:
            mine.append(1)
            add(path, level + 1, w)

    def remove(path, level, w):
        if level == 3:
            return
        mine = seats[path[level]][w]
        at = rng.choice(len(mine), p=np.array(mine) / sum(mine))
        mine[at] -= 1
        if not mine[at]:
            del mine[at]
            remove(path, level + 1, w)

    for u, w in pairs:
        add(chain(u), 0, w)
    asked = [read(t) for t in held]
    mean = [np.zeros(len(x)) for x in asked]
    for r in range(rounds):
        for u, w in pairs:
            remove(chain(u), 0, w)
            add(chain(u), 0, w)
        if r >= burn:
            mean = [m + [prob(chain(u), 0, w) for u, w in x] for m, x in zip(mean, asked, strict=True)]
    return [float(np.log10(m / (rounds - burn)).sum()) for m in mean]


def test_agrees_with_one_by_one_gibbs_sampling(spark):
    r = np.random.default_rng(8)
    names = ["an", "ran", "on", "won", "xe", "the", "se", "ox"]
    step = r.dirichlet(np.full(len(names), 0.3), len(names))

    def text():
        at, out = r.integers(len(names)), []
        for _ in range(r.integers(3, 9)):
            out.append(names[at])
            at = r.choice(len(names), p=step[at])
        return " ".join(out)

    docs, held = [text() for _ in range(40)], [text() for _ in range(30)] + ["zzz on the zzz", "ox"]
    want = plain_gibbs(docs, held, 120, 20, 3)
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(docs)] + [(1000 + i, t, False) for i, t in enumerate(held)], "doc_id long, text string, train boolean")
    got = {x.key: x.score for x in H.score(df, F.col("train"), burn=15, samples=25).collect()}
    mine = [got[1000 + i] for i in range(len(held))]
    print(sum(mine), sum(want))
    assert abs(sum(mine) - sum(want)) < 0.01 * abs(sum(want))
    assert max(abs(x - y) for x, y in zip(mine, want, strict=True)) < 0.35


def plain_seat(customers, a, b, d, rng):
    tables = np.ones(len(customers))
    by = np.argsort(-customers, kind="stable")
    n, a, b, k = customers[by], a[by], b[by], tables[by]
    i = 1
    while m := int((n > i).sum()):
        size = 1 if i < H.SINGLY else np.minimum(i // H.BLOCK, n[:m] - i)
        new = a[:m] + b[:m] * k[:m]
        chance = new / (new + i - d * k[:m])
        if i < H.SINGLY:
            k[:m] += rng.random(m) < chance
        else:
            middle = k[:m] + chance * size / 2
            new = a[:m] + b[:m] * middle
            k[:m] += rng.binomial(size, new / (new + i + size / 2 - d * middle))
        i += 1 if i < H.SINGLY else i // H.BLOCK
    tables[by] = k
    return tables


def test_quick_forms_equal_plain_ones_and_cost_less():
    r = np.random.default_rng(9)
    for kind in ("<u8", "<i8", "<u4", "<i4", "<u2", "u1"):
        for n in (0, 1, 7, 1000):
            x = r.integers(0, 200, n).astype(kind)
            assert H.unpack(H.pack(x), kind).tolist() == x.tolist()
    x = r.integers(0, 1 << 63, 5000, dtype=np.uint64)
    order = H._by_ending(x)
    assert (np.argsort(order) == np.lexsort((x, x & H.ENDING))).all()
    for most in (2, 60, 5000, 100_000):
        customers, a, b = r.integers(1, most, 3000), r.random(3000) * 3, r.random(3000)
        assert (H.seat(customers, a, b, 0.6, np.random.default_rng(3)) == plain_seat(customers, a, b, 0.6, np.random.default_rng(3))).all()
    assert len(H.seat(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), 0.6, r)) == 0

    def seconds(f):
        times = []
        for _ in range(5):
            start = time.process_time()
            f()
            times.append(time.process_time() - start)
        return min(times)

    zeros = np.zeros(2_000_000, np.uint64)  # next to no work for the compressor
    assert seconds(lambda: H.pack(zeros)) < seconds(lambda: zeros.view(np.uint8).reshape(-1, 8).T.tobytes())


def test_seating_follows_the_restaurant_process():
    """Mean number of tables against the sum over customers of the chance of a new table, by recursion."""
    def mean(n, a, b, d):
        p = {1: 1.0}
        for i in range(1, n):
            q = Counter()
            for k, x in p.items():
                new = (a + b * k) / (a + b * k + i - d * k)
                q[k + 1] += x * new
                q[k] += x * (1 - new)
            p = q
        return sum(k * x for k, x in p.items())

    rng = np.random.default_rng(4)
    for n, a, b, d in ((2, 0.5, 0.2, 0.3), (30, 2.0, 0.1, 0.6), (400, 1.0, 0.05, 0.5), (2500, 30.0, 0.2, 0.7)):
        got = H.seat(np.full(20_000, n), np.full(20_000, a), np.full(20_000, b), d, rng)
        assert abs(got.mean() - mean(n, a, b, d)) < 5 * got.std() / math.sqrt(20_000) + 1e-3 * got.mean()


def test_beats_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = H.score(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10, F.lit(0)) != 0)
    r = out.filter("not train").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    print("held out:", r)
    assert r[2] > 50 and r[0] > r[1]
    assert H.score(docs.filter("false"), F.lit(True)).count() == 0
    none = H.score(docs.limit(3), F.lit(False)).collect()
    assert all(abs(r.score) < 1e-6 and abs(r.base_score) < 1e-6 and abs(r.perplexity - 1) < 1e-6 for r in none)


def test_context_is_the_whole_word_before(spark):
    # the, he and she end alike, but tell apart what follows
    after = {"the": "sun", "he": "ran", "she": "sang"}
    rows = [(i, f"{w} {after[w]}", True) for i, w in enumerate(list(after) * 40)]
    rows += [(1000 + 10 * i + j, f"{w} {x}", False) for i, w in enumerate(after) for j, x in enumerate(after.values())]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    for batch, bucket in ((1 << 20, 1 << 20), (200, 100)):
        got = {r.key: r.score for r in H.score(df.repartition(2), F.col("train"), batch_bytes=batch, bucket_bytes=bucket).collect()}
        for i in range(3):
            assert all(got[1000 + 11 * i] > got[1000 + 10 * i + j] + 1 for j in range(3) if j != i)
