import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanforge.llm import mixing as M
from spanforge.llm.queries import QUERIES


def share_out(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets, round after round: sources above `most` times their size are closed, the rest is shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: most * float(sizes[s]) for s in full}
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def test_targets(spark):
    assert share_out({"a": 10, "b": 10, None: 10}) == {"a": 20.0, "b": pytest.approx(25 / 3), None: pytest.approx(50 / 3)}
    r = random.Random(4)
    cases = [{"a": 100, "b": 1000, "c": 10, "d": 0}, {"a": 10, "b": 10, None: 10}, {"a": 0}, {}, {r.choice("abÄz") + str(i): r.choice((0, 3, 50, 1000)) for i in range(40)}]
    for sizes in cases:
        df = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(3)
        got = {x.source: x.target for x in M.targets(df).collect()}
        assert got == pytest.approx(share_out(sizes)), sizes


def cheapest(patterns, quotas, repeats):
    """The best (flow, -cost) by trying all flows."""
    names = list(quotas)
    best = (-1, 0)
    ways = [[x for x in itertools.product(*[range(n * repeats + 1) if s in members else (0,) for s in names]) if sum(x) <= n * repeats] for members, n in patterns]
    for pick in itertools.product(*ways):
        if all(sum(x[i] for x in pick) <= quotas[s] for i, s in enumerate(names)):
            cost = sum(r * r * min(max(sum(x) - (r - 1) * n, 0), n) for x, (_, n) in zip(pick, patterns, strict=True) for r in range(1, repeats + 1))
            best = max(best, (sum(map(sum, pick)), -cost))
    return best


def test_flow_against_all_flows():
    r = random.Random(9)
    for _ in range(60):
        names = "abc"[: r.randint(1, 3)]
        patterns = [(m, r.randint(0, 2)) for k in range(1, len(names) + 1) for m in itertools.combinations(names, k) if r.random() < 0.6][:4]
        quotas = {s: r.randint(0, 4) for s in names}
        got = M.route(patterns, quotas, 2)
        cost = sum(k * k * min(max(f - (k - 1) * n, 0), n) for f, (_, n) in zip(got, patterns, strict=True) for k in (1, 2))
        assert (sum(got), -cost) == cheapest(patterns, quotas, 2), (patterns, quotas, got)


def test_more_patterns_than_the_flow_takes(spark):
    r = random.Random(1)
    rows = [(i, "w " * 10, r.sample([f"s{j}" for j in range(9)], r.randint(1, 5))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `in` array<string>")
    patterns = len({tuple(sorted(x)) for _, _, x in rows})
    for limit in (patterns + 10, 40, 9):
        out = M.mix(df, F.col("in"), weights=(1,), share=0.2, limit=limit)
        taken = out.taken.collect()
        wanted = sum(x.target for x in out.sources.collect())
        assert len(taken) == 3000 and all(x.taken in (0, 10, 20) for x in taken)
        assert abs(sum(x.taken for x in taken) - min(wanted, 60_000)) < 5 * patterns + 10, limit


def test_ten_thousand_sources(spark):
    df = spark.range(36_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), F.col("id") % 12_000).alias("source"))
    out = M.mix(df, F.array("source"), limit=100)
    want = {x.source: x.target for x in out.sources.collect()}
    got = {x.source: x.t for x in out.taken.groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    assert len(want) == 12_000 and all(abs(got[s] - t) <= 2.5 for s, t in want.items())


def test_flow_repeats_only_where_needed():
    # b's quota can't be met without the shared pattern; a takes its own tokens first
    got = M.route([(("a",), 100), (("a", "b"), 50), (("b",), 10)], {"a": 110, "b": 60})
    assert sum(got) == 170 and got[0] <= 200 and got[1] <= 100 and got[2] <= 20
    assert M.route([(("a",), 10), (("a", "b"), 10)], {"a": 10, "b": 10}) == [10, 10]
    assert M.route([(("a",), 10)], {"a": 100}) == [20]


def test_query_meets_targets_and_reruns_agree(spark):
    d = "/root/testdata/sf0.01"
    rows = QUERIES["op7_mixing"](spark, d).collect()
    docs = {r.doc_id: len((r.text or "").encode().split()) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    taken, sizes, longest = Counter(), Counter(), Counter()
    for r in rows:
        assert r["size"] == docs[r.doc_id] and r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
        sizes[r.source] += r["size"]
        longest[r.source] = max(longest[r.source], r["size"])
    targets = share_out(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
    for s, t in targets.items():
        assert abs(taken[s] - t) <= longest[s] / 2 + 1
    again = M.mix(spark.read.parquet(f"{d}/documents.parquet").repartition(7), F.array("source")).taken
    assert {(r.doc_id, r.taken) for r in again.collect()} == {(r.doc_id, r.taken) for r in rows}


def test_edges(spark):
    rows = [(1, "a b c", None, 5), (2, None, "x", 5), (None, " \t ", "x", 5), (3, "d", "x\"y", 5), (3, "d", "x\"y", 5), (4, "e " * 9, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")
    out = M.mix(df, F.array("source"))
    assert {x.source: x["size"] for x in out.sources.collect()} == {None: 3, "x": 9, 'x"y': 2}
    got = sorted((r.doc_id or 0, r["size"], r.taken) for r in out.taken.collect())
    assert [g[:2] for g in got] == [(0, 0), (1, 3), (2, 0), (3, 1), (3, 1), (4, 9)]
    assert got[3] == got[4] and all(t <= 2 * s for _, s, t in got)
    empty = M.mix(df.filter("false"), F.array("source"))
    assert empty.taken.count() == 0 and empty.sources.count() == 0


def test_overlapping_sources(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("w w w w").alias("text"), F.when(F.col("id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("id") % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"))).alias("in"))
    out = M.mix(df, F.col("in"), weights=(1, 1), share=0.5)
    assert {x.source: x["size"] for x in out.sources.collect()} == {"a": 800, "b": 800}
    total = out.taken.agg(F.sum("taken")).first()[0]
    assert abs(total - 800) <= 12
