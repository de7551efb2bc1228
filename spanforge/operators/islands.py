"""Bundles of neighbouring intervals (gaps and islands), order and merging of sorted inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START_ONLY, START_AND_END = 0, 1


def _numbered(df: DataFrame, mode: int, spacing: int, width: int) -> DataFrame:
    """df with _island: the bundle's number in its chromosome.

    A chromosome isn't one task: rows are windowed inside bins of `width`; what a bin needs of those before it (the
    largest start and end, the number of bundles) comes from windows over one row for each bin.
    """
    keyed = df.withColumn("_bin", F.floor(F.col("start") / width))
    bins = Window.partitionBy("chrom").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    reach, value = ("start", F.col("start") > F.col("_reach") + spacing) if mode == START_ONLY else ("end", F.col("start") >= F.col("_reach") + spacing)
    carried = keyed.groupBy("chrom", "_bin").agg(F.max(reach).alias("_most")).select("chrom", "_bin", F.max("_most").over(bins).alias("_carried"))
    local = Window.partitionBy("chrom", "_bin").orderBy("start", "end")
    inside = F.max(reach).over(local.rowsBetween(Window.unboundedPreceding, -1))
    marked = keyed.join(carried, ["chrom", "_bin"]).withColumn("_reach", F.greatest(inside, F.col("_carried"))).withColumn("_new", F.coalesce(value, F.lit(True)).cast("long"))
    offsets = marked.groupBy("chrom", "_bin").agg(F.sum("_new").alias("_n")).select("chrom", "_bin", F.coalesce(F.sum("_n").over(bins), F.lit(0)).alias("_offset"))
    counted = marked.withColumn("_here", F.sum("_new").over(local.rowsBetween(Window.unboundedPreceding, 0))).join(offsets, ["chrom", "_bin"])
    return counted.withColumn("_island", F.col("_offset") + F.col("_here")).drop("_bin", "_carried", "_reach", "_new", "_here", "_offset")


def _merged(islands: DataFrame, min_capacity: int, piece: int = 256) -> DataFrame:
    """chrom, _island, _first: the island that begins the bundle of each, where a bundle takes islands while it has fewer rows.

    One expression folds a chromosome's counts (two numbers an island), in pieces, so that lists don't grow by one element at a time.
    """
    listed = islands.groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("_island", "count"))).alias("all"))
    state = lambda n, first, out: F.struct(n.cast("long").alias("n"), first.cast("long").alias("first"), out.alias("out"))

    def step(a, x):
        more = (a["n"] > 0) & (a["n"] < min_capacity)
        first = F.when(more, a["first"]).otherwise(x["_island"])
        return state(F.when(more, a["n"]).otherwise(F.lit(0)) + x["count"], first, F.concat(a["out"], F.array(first)))

    def whole(a, p):
        inner = F.aggregate(p, state(a["n"], a["first"], F.array().cast("array<bigint>")), step)
        return F.transform(F.array(inner), lambda r: state(r["n"], r["first"], F.concat(a["out"], F.array(r["out"]))))[0]

    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.size("all") / piece).cast("int") - 1), lambda i: F.slice("all", i * piece + 1, F.lit(piece)))
    firsts = F.flatten(F.aggregate(pieces, state(F.lit(0), F.lit(0), F.array().cast("array<array<bigint>>")), whole)["out"])
    each = listed.select("chrom", F.explode(F.arrays_zip(F.col("all").alias("x"), firsts.alias("_first"))).alias("_e"))
    return each.select("chrom", F.col("_e.x._island").alias("_island"), F.col("_e._first").alias("_first"))


def bundle(df: DataFrame, mode: int = START_AND_END, min_capacity: int = 1, min_spacing: int = 0, keep: list[str] | None = None, width: int = 1 << 20) -> DataFrame:
    """chrom, start_min, start_max, end_min, end_max, mode, count and, with keep, data (these columns of the members, in order).

    START_AND_END starts a new bundle where a row starts at or after all ends so far plus min_spacing; START_ONLY where
    it starts more than min_spacing after the last start. min_capacity: only once the bundle has so many rows.
    """
    if mode not in (START_ONLY, START_AND_END):
        raise ValueError(f"unknown mode {mode}")
    numbered = _numbered(df, mode, min_spacing, width)
    measures = [F.min("start").alias("start_min"), F.max("start").alias("start_max"), F.min("end").alias("end_min"), F.max("end").alias("end_max"), F.count("*").alias("count")]
    data = F.array_sort(F.collect_list(F.struct("start", "end", *[c for c in keep or [] if c not in ("start", "end")])))
    islands = numbered.groupBy("chrom", "_island").agg(*measures, *([data.alias("data")] if keep is not None else []))
    if min_capacity > 1:
        # a greedy pass over the islands' counts, not rows; for min_spacing >= 0 it makes the same bundles
        merged = islands.join(_merged(islands, min_capacity), ["chrom", "_island"]).groupBy("chrom", "_first")
        joined = [F.min("start_min").alias("start_min"), F.max("start_max").alias("start_max"), F.min("end_min").alias("end_min"), F.max("end_max").alias("end_max"), F.sum("count").alias("count")]
        members = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_island", "data"))), lambda x: x["data"])) if keep is not None else None
        islands = merged.agg(*joined, *([members.alias("data")] if keep is not None else []))
    return islands.withColumn("mode", F.lit(mode)).select("chrom", "start_min", "start_max", "end_min", "end_max", "mode", "count", *(["data"] if keep is not None else []))


def in_order(df: DataFrame, *ties: str) -> DataFrame:
    """Rows by chrom (code points), start, end, then the tie columns."""
    return df.orderBy("chrom", "start", "end", *ties)


def placed(df: DataFrame, *ties: str, width: int = 1 << 20) -> DataFrame:
    """df with place: each row's number from 1 in the order of in_order().

    Rows are numbered inside coordinate bins; only one row a bin, with its count, is windowed over all bins.
    """
    keyed = df.withColumn("_bin", F.floor(F.col("start") / width))
    before = Window.orderBy("chrom", "_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("chrom", "_bin").agg(F.count("*").alias("_n"))
    offsets = counts.select("chrom", "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy("chrom", "_bin").orderBy("start", "end", *ties)
    return keyed.join(offsets, ["chrom", "_bin"]).withColumn("place", (F.col("_before") + F.row_number().over(local)).cast("long")).drop("_bin", "_before")


def merge_sorted(*inputs: DataFrame) -> DataFrame:
    """All rows with container (the input's number), in order; ties go to the smaller number."""
    tagged = [d.withColumn("container", F.lit(i)) for i, d in enumerate(inputs)]
    out = tagged[0]
    for d in tagged[1:]:
        out = out.unionByName(d)
    return out.orderBy("chrom", "start", "end", "container")


def disorder(df: DataFrame, ordinal: str) -> DataFrame:
    """Rows that sort before the row that precedes them by the ordinal column within each chromosome; none if sorted."""
    w = Window.partitionBy("chrom").orderBy(ordinal)
    key = F.struct("start", "end")
    return df.withColumn("_before", F.lag(key).over(w)).filter(F.col("_before").isNotNull() & (key < F.col("_before"))).drop("_before")
