from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spanforge.llm.substrings import remove_repeats


def brute(rows, n):
    """Kept words by row, comparing every window with every other."""
    first, words = {}, [(i if i is not None else 1 << 63, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, w in words:
        gone = {x for s in range(len(w) - n + 1) if first[tuple(w[s : s + n])] < (i, s) for x in range(s, s + n)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def test_matches_brute_force(spark):
    import random

    r = random.Random(5)
    vocabulary = ["a", "b", "the", "ümlaut", "longerword-than-eight", "x" * 40]
    passage = " ".join(r.choice(vocabulary) for _ in range(12))
    rows = [(i, " \n".join(r.choice(vocabulary) for _ in range(r.randrange(60))) + ("  " + passage if i % 3 == 0 else "")) for i in range(80)]
    rows += [(None, passage), (200, None), (201, ""), (202, " \t\r\n"), (5, rows[5][1]), (203, rows[7][1]), (204, (passage + " ") * 30)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _starts_of string").withColumn("n_words", F.lit("clash"))
    for buckets, batch in ((1 << 30, 1 << 24), (100, 500)):
        out = remove_repeats(df.repartition(3), length=4, bucket_bytes=buckets, batch_bytes=batch).collect()
        got, want = defaultdict(list), defaultdict(list)
        for x in out:
            got[x.doc_id].append((x.n_words, x.n_removed, x.kept_text))
            assert sum(s.end - s.start for s in x.removed_spans) == x.n_removed
        for (i, _), x in zip(rows, brute(rows, 4), strict=True):
            want[i].append(x)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_common_line_spreads_over_buckets(spark):
    import random

    from spanforge.llm import substrings as S

    r = random.Random(6)
    line = " ".join(f"line{i}" for i in range(15))
    rows = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(20)) + " " + line + " " + " ".join(f"w{r.randrange(10**6)}" for _ in range(20))) for i in range(1000)]
    tagged = spark.createDataFrame([(i, i, t) for i, t in rows], "_rid long, _ord long, _text string").repartition(4)
    size = sum(len(t) for _, t in rows)
    for most in (20_000, 60_000):
        sizes = [x.n for x in S.windows(tagged, 20, most, 1 << 20).groupBy("bucket").agg(F.sum(F.size("h")).alias("n")).collect()]
        # words have seven bytes here; a bucket holds its text's windows and, of each hash that isn't dealt one by one, a quarter of that
        assert sum(sizes) == 36 * 1000 and max(sizes) < 2 * most / 6, (max(sizes), most, size)


@pytest.mark.parametrize("length", [1, 2, 3, 7, 20])
def test_rolling_hash_tells_windows_apart(length):
    import numpy as np

    from spanforge.llm.substrings import BASE_KEY, rolling

    v = np.random.default_rng(1).integers(0, 5, 400).astype(np.uint64)
    h = rolling(v, length, BASE_KEY)
    same = defaultdict(set)
    for i in range(len(v) - length + 1):
        same[tuple(v[i : i + length])].add(int(h[i]))
    assert len(h) == len(v) - length + 1 and all(len(x) == 1 for x in same.values())
    assert len({next(iter(x)) for x in same.values()}) == len(same)
