"""Mixing documents of (overlapping) sources to target token counts by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them) in Spark. Each pattern offers
its tokens once for every allowed repetition, at a marginal cost that rises from repetition to repetition, so the
flow repeats only where quotas can't be met otherwise; flow leaves through the pattern's sources, up to their
quotas. A source that shares no document with others needs no flow network: its flow is a Spark expression, so
there may be any number of such sources. Patterns of several sources, and those of their sources alone, go to the
driver's flow, MOST_PATTERNS rows at most: where there are more, patterns are folded onto fewer of their sources
(the scarcest ones; one alone in the end), which keeps every document in the mix and only narrows its ways out.
A pattern's flow is so many whole repetitions of all its documents and a rest, for which documents are taken in
the order of a seeded hash. The rest's limit is found from sums over 2**8 hash bins, over the 2**8 parts of one
of them, and then inside one part, so no pattern's documents meet in one task.

Defined results: a null text has size 0; a null source is a source, after all others; a row in no source (a null
or empty array) isn't taken; rows with equal doc_id and text are taken together; empty tables give no rows; the
order of rows and partitions doesn't matter; other columns pass through, and output columns replace columns of
their name.
"""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .flat import shared_dir

#: Patterns that the driver's flow takes, and rows of a table by pattern or source that are broadcast, at most.
MOST_PATTERNS, FEW = 10_000, 20_000
MEMBERS = "array<string>"


def word_count(text: str) -> Column:
    """The number of maximal runs of characters other than 0x20 and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(F.col(text), r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def small(df: DataFrame) -> DataFrame:
    """df, for broadcast where it has few rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def numbered(df: DataFrame, *by: Column) -> DataFrame:
    """df (checkpointed) with place: the rows' numbers from 0 in the order of `by`, without a single task for all."""
    at = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).checkpoint()
    before, total = [], 0
    for r in at.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # one row a partition
        before.append((r["_part"], total))
        total += r["n"]
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "_part int, _before long"))
    return at.join(starts, "_part").withColumn("place", F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, size) with target: shares of `share` times all sizes by weights (given to the sources by code point,
    null last, and repeated), each at most `most` times its source's size; what is over goes to the others by weight,
    until none is above."""
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.col("place") % len(weights)]
    ranked = numbered(sizes, F.col("source").asc_nulls_last()).withColumn("weight", weight).withColumn("cap", float(most) * F.col("size")).drop("place").checkpoint()
    budget = share * float(ranked.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    level, closed = 0.0, -1
    while True:
        full = F.col("cap") < level * F.col("weight")
        held, many, open_ = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.count_if(full), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if many == closed or not open_:
            break
        level, closed = (budget - held) / open_, many
    return ranked.withColumn("target", F.least("cap", level * F.col("weight"))).drop("weight", "cap")


def route(patterns: list[tuple[tuple, int]], quotas: dict, repeats: int = 2) -> list[int]:
    """For each (sources, tokens): the tokens that a cheapest largest flow takes of it, repetitions counted.

    Repetition r of a token costs r * r. What a path costs is its repetition alone, so cheapest paths first means: as much
    flow as the first repetitions give, then as much as the second ones add, and so on, each by Dinic's algorithm.
    """
    names = {s: i for i, s in enumerate(quotas)}
    base, end = 1 + len(patterns), 1 + len(patterns) + len(names)
    heads: list[int] = []
    caps: list[int] = []
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, cap: int) -> int:
        for x, y, c in ((a, b, cap), (b, a, 0)):
            out[x].append(len(heads))
            heads.append(y)
            caps.append(c)
        return len(heads) - 2

    offers = [arc(0, 1 + p, 0) for p in range(len(patterns))]
    for p, (members, size) in enumerate(patterns):
        for s in members:
            arc(1 + p, base + names[s], size * repeats)
    for s, i in names.items():
        arc(base + i, end, int(quotas[s] + 0.5))

    def levels() -> list[int]:
        far, queue = [-1] * (end + 1), deque([0])
        far[0] = 0
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if caps[e] and far[heads[e]] < 0:
                    far[heads[e]] = far[a] + 1
                    queue.append(heads[e])
        return far

    for _ in range(repeats):
        for p, (_, size) in enumerate(patterns):
            caps[offers[p]] += size
        while (far := levels())[end] >= 0:
            tried, path, a = [0] * (end + 1), [], 0
            while True:
                if a == end:
                    flow = min(caps[e] for e in path)
                    for e in path:
                        caps[e] -= flow
                        caps[e ^ 1] += flow
                    path, a = [], 0
                elif tried[a] < len(out[a]):
                    e = out[a][tried[a]]
                    if caps[e] and far[heads[e]] == far[a] + 1:
                        path.append(e)
                        a = heads[e]
                    else:
                        tried[a] += 1
                elif path:
                    a = heads[path.pop() ^ 1]
                    tried[a] += 1
                else:
                    break
    return [caps[e ^ 1] for e in offers]


@dataclass
class Mixture:
    """sources: source, size and target; taken: df with size and taken (tokens of the row in the mix)."""

    sources: DataFrame
    taken: DataFrame


def _members(pattern: str = "_pattern") -> Column:
    return F.from_json(F.col(pattern), MEMBERS)


def _flows(patterns: DataFrame, quotas: DataFrame, most: int, limit: int) -> DataFrame:
    """patterns (_pattern, n) with flow. quotas: source, size, target."""
    spark = patterns.sparkSession
    scarce = small(quotas.select(F.col("source").alias("_s"), F.col("size").alias("_n")))
    each = patterns.select("_pattern", "n", F.explode(_members()).alias("source"))
    # of each pattern its sources, the smallest first
    ordered = each.join(scarce, F.col("source").eqNullSafe(F.col("_s"))).groupBy("_pattern", "n").agg(F.array_sort(F.collect_list(F.struct("_n", F.col("source").isNull().alias("none"), "source"))).alias("x"))
    ordered = ordered.select("_pattern", "n", F.transform("x", lambda x: x["source"]).alias("sources")).checkpoint()
    keep = max(1, ordered.agg(F.coalesce(F.max(F.size("sources")), F.lit(1))).first()[0])
    while True:
        folded = ordered.withColumn("sources", F.array_sort(F.slice("sources", 1, keep)))
        groups = folded.groupBy("sources").agg(F.sum("n").alias("n"))
        shared = groups.filter(F.size("sources") > 1)
        touched = shared.select(F.explode("sources").alias("_s")).distinct()
        alone = groups.filter(F.size("sources") == 1).withColumn("source", F.col("sources")[0])
        near = alone.join(touched, F.col("source").eqNullSafe(F.col("_s")), "left_semi")
        rows = shared.select("sources", "n").union(near.select("sources", "n")).limit(limit + 1).collect()
        if len(rows) <= limit:
            break
        keep = keep // 2 if keep > 1 else 1
    rows.sort(key=lambda r: json.dumps(r["sources"]))
    names = {s for r in rows for s in r["sources"]}
    wanted = spark.createDataFrame([(s,) for s in names], "_s string")  # of at most `limit` patterns
    asked = {r["source"]: r["target"] for r in quotas.join(F.broadcast(wanted), F.col("source").eqNullSafe(F.col("_s")), "left_semi").collect()}
    given = route([(tuple(r["sources"]), r["n"]) for r in rows], {s: asked[s] for s in sorted(asked, key=lambda s: (s is None, s or ""))}, most)
    driver = spark.createDataFrame([(r["sources"], r["n"], f) for r, f in zip(rows, given, strict=True)], "sources array<string>, total long, flow long")
    free = alone.join(touched, F.col("source").eqNullSafe(F.col("_s")), "left_anti").join(small(quotas.select(F.col("source").alias("_s"), "target")), F.col("source").eqNullSafe(F.col("_s")))
    own = free.select("sources", F.col("n").alias("total"), F.least(F.floor(F.col("target") + 0.5), most * F.col("n")).cast("long").alias("flow"))
    found = small(driver.union(own).checkpoint())
    # patterns that were folded together share their group's flow by size: the parts' ends, rounded, differ by whole tokens
    upto = F.sum("n").over(Window.partitionBy("sources").orderBy("_pattern"))
    parts = folded.withColumn("upto", upto) if keep < _longest(ordered) else folded.withColumn("upto", F.col("n"))
    cut = lambda x: F.when(F.col("total") > 0, F.floor(x.cast("decimal(38,0)") * F.col("flow").cast("decimal(19,0)") / F.col("total"))).otherwise(0).cast("long")
    return parts.join(found, "sources").select("_pattern", "n", (cut(F.col("upto")) - cut(F.col("upto") - F.col("n"))).alias("flow"))


def _longest(ordered: DataFrame) -> int:
    return ordered.agg(F.coalesce(F.max(F.size("sources")), F.lit(1))).first()[0]


def mix(df: DataFrame, sources: Column, text: str = "text", doc_id: str = "doc_id", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7, limit: int = MOST_PATTERNS) -> Mixture:
    """Mix the rows of df. sources: an array column with the names of the sources that hold the row. limit: patterns for the driver's flow."""
    shared_dir(df.sparkSession)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("size", "taken")]
    h = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    pattern = F.to_json(F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast(MEMBERS)))), {"ignoreNullFields": "false"})
    keyed = df.select(*kept, pattern.alias("_pattern"), h.alias("_h")).withColumn("_bin", F.shiftrightunsigned("_h", 48))
    sized = keyed.withColumn("size", word_count(text))
    bins = sized.groupBy("_pattern", "_bin").agg(F.sum("size").alias("n")).withColumn("_high", F.shiftright("_bin", 8)).checkpoint()
    highs = bins.groupBy("_pattern", "_high").agg(F.sum("n").alias("n")).checkpoint()
    patterns = highs.groupBy("_pattern").agg(F.sum("n").alias("n")).checkpoint()
    quotas = targets(patterns.select(F.explode(_members()).alias("source"), "n").groupBy("source").agg(F.sum("n").alias("size")), weights, share, most).checkpoint()
    flows = _flows(patterns, quotas, most, limit)
    plan = flows.select("_pattern", F.when(F.col("n") > 0, F.expr("flow div n")).otherwise(0).alias("_whole"), F.when(F.col("n") > 0, F.expr("flow % n")).otherwise(0).alias("_rest")).checkpoint()

    def ends(sums: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
        """Of each pattern the bin in which _rest ends, and what of it is left there (_room)."""
        upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("_pattern").orderBy(by)))
        met = upto.join(small(wanted), "_pattern").filter("upto - n <= _rest and upto > _rest")
        return met.select("_pattern", by, (F.col("_rest") - F.col("upto") + F.col("n")).alias("_room")).checkpoint()

    high = ends(highs, plan.select("_pattern", "_rest"), "_high")
    inside = bins.join(small(high.drop("_room")), ["_pattern", "_high"]).select("_pattern", "_bin", "n")
    end = ends(inside, high.select("_pattern", F.col("_room").alias("_rest")), "_bin")
    last = keyed.join(small(end), ["_pattern", "_bin"]).withColumn("size", word_count(text)).groupBy("_pattern", "_h", "_room").agg(F.sum("size").alias("n"))
    sums = last.withColumn("upto", F.sum("n").over(Window.partitionBy("_pattern").orderBy(F.col("_h"))))
    cuts = sums.filter("2 * upto - n <= 2 * _room").groupBy("_pattern").agg(F.max("_h").alias("_cut"))
    rule = plan.select("_pattern", "_whole").join(end.select("_pattern", F.col("_bin").alias("_end")), "_pattern", "left").join(cuts, "_pattern", "left").checkpoint()
    extra = F.coalesce((F.col("_bin") < F.col("_end")) | ((F.col("_bin") == F.col("_end")) & F.coalesce(F.col("_h") <= F.col("_cut"), F.lit(False))), F.lit(False))
    taken = sized.join(small(rule), "_pattern", "left").withColumn("taken", F.col("size") * (F.coalesce("_whole", F.lit(0)) + extra.cast("long")))
    return Mixture(quotas, taken.select(*kept, "size", "taken"))
