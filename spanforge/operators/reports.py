"""Counting, strand assignment and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import interval as I
from .joins import overlap_join


def _after_overlap(condition: Column) -> Column:
    """A costly condition on joined rows that is looked at only for spans that overlap, also where it becomes part of the join."""
    return F.when(I.overlaps(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")), condition).otherwise(False)


def feature_count(reads: DataFrame, features: DataFrame, strand: str | None = None, mode: str = "overlap", width: int = 1000, paired: bool = False) -> DataFrame:
    """name, Length, Count for every feature, also those without reads; features of one name are counted apart.

    features: name, chrom, start, end, strand[, blocks]; reads: chrom, start, end, strand[, blocks], or fragments with mate1 and
    mate2 if paired. strand: forward (the same), reverse (the other) or None; mode: overlap (spans), coincide or contain
    (blocks, of both mates if paired).
    """
    if strand not in (None, "forward", "reverse") or mode not in ("overlap", "coincide", "contain"):
        raise ValueError("unknown strand or mode")
    span = ["chrom", "start", "end", "strand"]
    looked = [] if mode == "overlap" else ["mate1.blocks", "mate2.blocks"] if paired else ["blocks"]
    used = [*span, *(["blocks"] if looked else [])]
    size = B.length(F.col("blocks")) if "blocks" in features.columns else F.col("end") - F.col("start")
    named = features.select("name", size.alias("Length"), *used, F.xxhash64("name", *used).alias("_id"))
    # the counted side has fewer columns than the pairs: only ids go on; equal features are one
    own = reads.select(*span, *[F.col(c).alias(f"_blocks{i}") for i, c in enumerate(looked)])
    met = overlap_join(own, named.select("_id", *used).dropDuplicates(["_id"]), width=width)
    if strand:
        # as part of the join's condition, not one of its keys, by which the rows would be shuffled anew
        met = met.filter(_after_overlap(F.col("strand") == F.col("r_strand") if strand == "forward" else F.col("strand") != F.col("r_strand")))
    for i in range(len(looked)):
        met = met.filter(_after_overlap((B.coincides if mode == "coincide" else B.contains)(F.col("r_blocks"), F.col(f"_blocks{i}"))))
    counts = met.groupBy(F.col("r__id").alias("_id")).agg(F.count("*").alias("Count"))
    return named.select("name", "Length", "_id").join(counts, "_id", "left").select("name", "Length", F.coalesce("Count", F.lit(0)).alias("Count"))


def assign_strand(fragments: DataFrame, transcripts: DataFrame, key: str, width: int = 1000) -> DataFrame:
    """key, ST: the strand that overlapping transcripts give a fragment: U without any; the one strand they have; of two, that of
    the transcripts which span it, else of those that it coincides with, else A.

    fragments: key, chrom, start, end, blocks or blocks_array; transcripts: chrom, start, end, strand, blocks.
    """
    lists = F.col("blocks_array") if "blocks_array" in fragments.columns else F.array("blocks")
    own = fragments.select(F.col(key).alias("_key"), "chrom", "start", "end", lists.alias("_lists"))
    met = overlap_join(own, transcripts.select("chrom", "start", "end", "strand", "blocks"), width=width)
    spans = (F.col("r_start") <= F.col("start")) & (F.col("end") <= F.col("r_end"))
    fits = spans & I.all_coincide(F.col("r_blocks"), F.col("_lists"))
    plus = lambda when: F.max(F.when(when & (F.col("r_strand") == "+"), 1).otherwise(0))
    minus = lambda when: F.max(F.when(when & (F.col("r_strand") == "-"), 1).otherwise(0))
    parts = {"a": F.lit(True), "s": spans, "c": fits}
    sums = met.groupBy("_key").agg(*[f(w).alias(n + k) for k, w in parts.items() for n, f in (("p", plus), ("m", minus))])
    one = lambda k: (F.col(f"p{k}") + F.col(f"m{k}") == 1)
    pick = lambda k: F.when(F.col(f"p{k}") == 1, "+").otherwise("-")
    none = lambda k: F.col(f"p{k}") + F.col(f"m{k}") == 0
    st = F.when(F.col("pa").isNull() | none("a"), "U").when(one("a"), pick("a")).when(none("s"), "A").when(one("s"), pick("s")).when(one("c"), pick("c")).otherwise("A")
    return fragments.select(F.col(key).alias("_key")).join(sums, "_key", "left").select(F.col("_key").alias(key), st.alias("ST"))


def protocol_strand(protocol: str, strand: Column, mate2: Column | None = None) -> Column:
    """The strand that a protocol gives: fr a read's own (the first mate's), rf the other (the second mate's)."""
    if protocol not in ("fr", "rf"):
        raise ValueError("protocol is fr or rf")
    if protocol == "fr":
        return strand
    return mate2 if mate2 is not None else F.when(strand == "+", "-").when(strand == "-", "+").otherwise(strand)


def strand_summary(assigned: DataFrame, *by: str) -> DataFrame:
    """Counts of +, -, A and U."""
    n = [F.count_if(F.col("ST") == s).alias(name) for s, name in (("+", "plus"), ("-", "minus"), ("A", "ambiguous"), ("U", "unknown"))]
    return assigned.groupBy(*by).agg(*n)


def filter_coincided(fragments: DataFrame, transcripts: DataFrame, key: str, width: int = 1000) -> DataFrame:
    """Fragments that coincide with some transcript."""
    met = overlap_join(fragments.select(F.col(key), "chrom", "start", "end", "blocks"), transcripts.select("chrom", "start", "end", "blocks"), width=width)
    return fragments.join(met.filter(_after_overlap(B.coincides(F.col("r_blocks"), F.col("blocks")))).select(key).distinct(), key, "left_semi")


TYPES = ("A-C", "A-G", "A-T", "C-A", "C-G", "C-T", "G-A", "G-C", "G-T", "T-A", "T-C", "T-G")


def _typed(events: DataFrame, min_qual: int, strand: Column | None) -> DataFrame:
    from .events import relative

    out = events if strand is None else relative(events, strand)
    return out.filter(F.col("qual") >= min_qual).withColumn("type", F.concat_ws("-", "ref", "alt")).filter(F.col("type").isin(*TYPES))


def mismatch_ratio(events: DataFrame, base_counts: DataFrame, min_qual: int = 20, strand: Column | None = None) -> DataFrame:
    """type, count, bases (of the type's reference base), ratio. events: ref, alt, qual; base_counts: base, n."""
    counted = _typed(events, min_qual, strand).groupBy("type").agg(F.count("*").alias("count"))
    bases = base_counts.groupBy("base").agg(F.sum("n").alias("bases"))
    kinds = events.sparkSession.createDataFrame([(t, t[0]) for t in TYPES], "type string, base string")
    out = kinds.join(counted, "type", "left").join(bases, "base", "left").select("type", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("bases", F.lit(0)).alias("bases"))
    return out.withColumn("ratio", F.when(F.col("bases") > 0, F.col("count") / F.col("bases")).otherwise(0.0))


def mismatch_cooccurrence(events: DataFrame, key: str, min_qual: int = 20, strand: Column | None = None) -> DataFrame:
    """given, type, count: events of a type in the fragments that have an event of the given type."""
    own = _typed(events, min_qual, strand).groupBy(key, "type").agg(F.count("*").alias("n"))
    # twelve types at most, so a fragment's row is small and pairs come from it without a join
    listed = own.groupBy(key).agg(F.collect_list(F.struct("type", "n")).alias("all"))
    pairs = listed.select("all", F.explode("all").alias("g")).select(F.col("g.type").alias("given"), F.explode("all").alias("x"))
    return pairs.groupBy("given", F.col("x.type").alias("type")).agg(F.sum("x.n").alias("count"))


def event_cube(events: DataFrame) -> DataFrame:
    """type, dist, qual, is_snp, count: what all histograms below are summed from."""
    typed = events.withColumn("type", F.concat_ws("-", "ref", "alt"))
    return typed.groupBy("type", "dist", "qual", "is_snp").agg(F.count("*").alias("count"))


def histogram(cube: DataFrame, by: str) -> DataFrame:
    """by, count, percent of all events."""
    sums = cube.groupBy(by).agg(F.sum("count").alias("count"))
    total = sums.agg(F.sum("count").alias("_total"))
    return sums.join(F.broadcast(total)).select(by, "count", (F.col("count") * 100.0 / F.col("_total")).alias("percent"))  # one row


def matrix(cube: DataFrame, quals: list[int]) -> DataFrame:
    """A row for each distance, a column for each of the scores."""
    return cube.groupBy("dist").agg(*[F.coalesce(F.sum(F.when(F.col("qual") == q, F.col("count"))), F.lit(0)).alias(f"q{q}") for q in quals])


def snp_share(cube: DataFrame) -> DataFrame:
    """type, count, snps, share of each type's events that are known variants."""
    out = cube.groupBy("type").agg(F.sum("count").alias("count"), F.coalesce(F.sum(F.when(F.col("is_snp"), F.col("count"))), F.lit(0)).alias("snps"))
    return out.withColumn("share", F.col("snps") / F.col("count"))


def filtered_counts(cube: DataFrame, min_dist: int, min_qual: int) -> DataFrame:
    """type, raw and filtered counts of events that are no known variants."""
    good = (F.col("dist") >= min_dist) & (F.col("qual") >= min_qual)
    return cube.filter(~F.col("is_snp")).groupBy("type").agg(F.sum("count").alias("raw"), F.coalesce(F.sum(F.when(good, F.col("count"))), F.lit(0)).alias("filtered"))


def top_by(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter("_n = 1").drop("_n")
