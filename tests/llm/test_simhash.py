import itertools
import random

import numpy as np
import pyarrow as pa
import xxhash

from spanforge.llm import simhash as S


def brute(rows, n=3, radius=3):
    prints = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    ids = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    return sorted(((rows[i][0], prints[i], ids[group[i]]) for i in range(len(rows))), key=str)


def test_matches_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["Äpfel", "THE", "The"]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.choice((1, 2, 3, 40, 400)))) for _ in range(60)]
    rows = list(enumerate(base))
    for k in range(80):
        w = r.choice(base).split()
        w[r.randrange(len(w))] = "changed"
        rows.append((100 + k, "  ".join(w)))
    rows += [(300, None), (301, ""), (302, " \n\t"), (None, base[0]), (0, base[0]), (303, base[5].upper())]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = sorted(((x.doc_id, x.fp & (1 << 64) - 1, x.component_id) for x in S.near_duplicates(df.repartition(3)).collect()), key=str)
    assert got == brute(rows)


def test_every_pair_in_the_radius_meets():
    masks = S.masks(3, (1 << 64) - 1)
    assert len(masks) == 15 and all(m.bit_count() >= 30 for m in masks)
    for bits in itertools.combinations(range(64), 3):
        d = sum(1 << b for b in bits)
        assert any(not d & m for m in masks)


def parts(members, pairs):
    root = {int(m): int(m) for m in members}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(int(a))] = find(int(b))
    groups = {}
    for m in root:
        groups.setdefault(find(m), set()).add(m)
    return sorted(map(sorted, groups.values()))


def test_large_keys_are_divided_without_loss(spark):
    r = np.random.default_rng(1)
    centre = r.integers(0, 1 << 62, 4, dtype=np.uint64)
    flips = np.array([[1 << b for b in r.choice(64, 2, replace=False)] for _ in range(4000)], dtype=np.uint64)
    # most keys have far more than DIRECT members
    members = np.unique(centre[r.integers(0, 4, 4000)] ^ flips[:, 0] ^ flips[:, 1])
    df = spark.createDataFrame([(int(m),) for m in members.view(np.int64)], "fp long").repartition(3)
    got = [(x.u, x.v) for x in S.links(df, 3).collect()]
    want = [(int(a), int(b)) for a, b in S.linked(members, 3).view(np.int64)]
    assert parts(members.view(np.int64), got) == parts(members.view(np.int64), want)
    assert S.kept_bits(0, 3) == 0 and S.kept_bits(5, 3) == S.masks(3, (1 << 64) - 1)[4]


def test_frequent_fingerprints_are_salted(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 3)
    rows = [(i, "the same words", 1) for i in range(20)] + [(50, "", 1), (51, None, 1), (52, " ", 1), (53, "\t", 1), (60, "other words here", 1)]
    got = sorted(((x.doc_id, x.fp & (1 << 64) - 1, x.component_id) for x in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)).collect()), key=str)
    assert got == brute(rows := [r[:2] for r in rows])


def similar(texts, n=5, least=0.8):
    """Groups of texts (by index) that share enough of their shingles, by all pairs."""
    w = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(x[i : i + n]) for i in range(len(x) - n + 1)} for x in w]
    links = []
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if w[i] == w[j] or (both and both >= least * len(sets[i] | sets[j])):
            links.append((i, j))
    return parts(range(len(texts)), links)


def test_near_texts_match_all_pairs(spark):
    from pyspark.sql import functions as F

    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.choice((1, 4, 5, 60, 150, 700)))) for _ in range(80)] + [None, "", "  "]
    for k in range(160):
        w = texts[r.randrange(80)].split()
        for _ in range(r.choice((0, 1, 1, len(w) // 60, len(w) // 20))):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(" ".join(w).upper() if k % 9 == 0 else "\n".join(w))
    # many copies of one text that are like it, and less like each other
    base = [r.choice(vocabulary) for _ in range(200)]
    for _ in range(700):
        w = list(base)
        for _ in range(r.choice((1, 2, 3))):
            w[r.randrange(200)] = r.choice(vocabulary)
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    groups = {}
    for x in S.near_texts(df, F.col("doc_id")).collect():
        groups.setdefault(x.root, []).append(x.doc_id)
    assert sorted(map(sorted, groups.values())) == similar(texts)
    assert S.near_texts(df.filter("false"), F.col("doc_id")).count() == 0


def rare_miss():
    """Two texts of 1,500 words that share 0.8 of their five-word shingles, but no band and no near fingerprint."""
    r = random.Random(909)
    a = [f"w{r.randrange(10**6)}" for _ in range(1500)]
    b, lose = list(a), (1500 - 4) // 9
    for k in range(lose // 5):
        b[20 + 7 * k] = f"x{r.randrange(10**6)}"
    for k in range(lose % 5):
        b[-1 - k] = f"y{k}"
    return [" ".join(a), " ".join(b)]


def test_pairs_that_share_no_band_are_found(spark):
    from pyspark.sql import functions as F

    texts = rare_miss()
    hashes, row, count, _ = S._shingles(pa.chunked_array([pa.array(texts)]), 5)
    keys, prints = S.bands(hashes, row, 2), S.fingerprint(hashes, count)
    assert not (keys[0] == keys[1]).any() and np.bitwise_count(prints[0] ^ prints[1]) > 3 and similar(texts) == [[0, 1]]
    got = S.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.col("doc_id")).collect()
    assert len({x.root for x in got}) == 1


def test_the_second_pass_alone_loses_no_link(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(S, "BLOCK", 7)
    monkeypatch.setattr(S, "_candidates", lambda: lambda batches: iter(()))
    monkeypatch.setattr(S, "links", lambda nodes, radius: nodes.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0))
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    texts = [" ".join([r.choice(vocabulary) for _ in range(n)] + passage * (n % 3 > 0)) for n in range(5, 60)] + [None, "", "w1 w2"]
    for _ in range(120):
        w = texts[r.randrange(55)].split()
        for _ in range(r.choice((0, 1, 1, 2, 3))):
            at = r.choice((0, len(w) - 1, r.randrange(len(w))))
            w[at] = r.choice(vocabulary)
        texts.append(" ".join(w))
    # a text with one more word before and after each time: neighbours are alike, the ends aren't
    line = [r.choice(vocabulary) for _ in range(120)]
    texts += [" ".join(line[i : i + 40]) for i in range(0, 80, 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    groups = {}
    for x in S.near_texts(df, F.col("doc_id")).collect():
        groups.setdefault(x.root, []).append(x.doc_id)
    assert sorted(map(sorted, groups.values())) == similar(texts)


def test_pairs_to_look_at_grow_with_the_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "SAMPLE", 75)

    def met(n):
        """Pairs of n texts, 30 of which share a passage, that meet by an early shingle."""
        r = random.Random(21)
        passages = [[f"p{k}_{i}" for i in range(60)] for k in range(n // 30)]
        texts = [" ".join([f"w{r.randrange(10**6)}" for _ in range(120)] + passages[i % len(passages)]) for i in range(n)]
        own = spark.createDataFrame(list(enumerate(texts)), "_rid long, _text string")
        common = S.common_shingles(own, 5, 1 << 20)
        table = pa.table({"doc_id": range(n), "_rid": range(n), "_text": texts})
        low = [x for b in S._prints(5, 0.8, common, 1 << 20)(iter(table.to_batches())) for x in b.column("low").to_pylist()]
        at = {}
        for i, keys in enumerate(low):
            for k in keys:
                at.setdefault(k, []).append(i)
        return len({p for x in at.values() for p in itertools.combinations(x, 2)})

    few, many = met(300), met(1500)
    assert many <= max(6 * few, 1500)


def test_only_the_most_frequent_shingles_are_told_apart(spark, monkeypatch):
    rows = [(i, " ".join(f"{x}{j}" for x, n in (("a", 4), ("b", 7), ("c", 9)) if i < n for j in range(8))) for i in range(9)]
    own = spark.createDataFrame(rows, "_rid long, _text string")
    everything = S.common_shingles(own, 5, 1 << 20)
    assert len(everything) == 4 + 4 + 4 + 4 + 4  # of each run of words, and where runs meet: ab (4 texts) and bc (7)
    monkeypatch.setattr(S, "FREQUENT", 9)
    got = S.common_shingles(own, 5, 1 << 20)
    assert got[-4:].tolist() == everything[-4:].tolist() and set(got) <= set(everything[-12:]) and 4 < len(got) < 12
    monkeypatch.setattr(S, "FREQUENT", 4)
    assert S.common_shingles(own, 5, 1 << 20).tolist() == everything[-4:].tolist()


def test_bounds_hold():
    r = np.random.default_rng(6)
    for n in (1, 5, 9, 45, 300, 1500):
        for _ in range(20):
            a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            gone = r.random(n) < r.choice((0.02, 0.1, 0.2))
            b = np.unique(np.concatenate([a[~gone], r.integers(0, 1 << 63, int(r.integers(0, n // 8 + 2)), dtype=np.uint64)]))
            if not len(b):
                continue
            both, x, y = np.intersect1d(a, b, return_indices=True)
            x_bits, y_bits = S.parities(a), S.parities(b)
            size = min(len(x_bits), len(y_bits))
            assert np.bitwise_count(S.folded(x_bits, size) ^ S.folded(y_bits, size)).sum() <= len(a) + len(b) - 2 * len(both)
            if 5 * len(both) >= 4 * (len(a) + len(b) - len(both)):
                assert x.min() < S.early(len(a), 0.8) and y.min() < S.early(len(b), 0.8)


def test_long_documents_and_no_rows(spark):
    h = np.random.default_rng(2).integers(0, 1 << 63, 200_000, dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
    assert S.fingerprint(h, np.array([0, len(h), 0])).tolist() == [0, want, 0]
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
