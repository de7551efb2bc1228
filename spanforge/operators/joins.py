"""Overlap joins and what is built on them.

Spark joins on equality. An overlap join deals both sides to bins of the coordinate: each row goes to every bin it
touches, rows meet within (chrom, bin), and a pair belongs to the bin where the later of both starts lies, so it is found
once. Bins spread a chromosome over many tasks. Rows that touch more than `most_bins` bins would be copied too
often; they belong one level up, to bins `most_bins` times as wide, and so on, so nothing is capped. A pair meets at the
higher of its two levels: besides its own level a row visits, as a guest, those higher levels to which rows of the other
side belong, and guests never meet guests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.let import exploded

LEVELS = 6
#: Rows of a side up to which Spark may broadcast it; rows of both sides for each task of a join in which none is.
FEW_ROWS, ROWS_A_TASK = 1 << 18, 1 << 20


def _level(start: Column, end: Column, width: int, most_bins: int) -> Column:
    """The lowest level at which a span touches at most most_bins bins."""
    out = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        w = width * most_bins**k
        out = F.when(F.floor((end - 1) / w) - F.floor(start / w) < most_bins, k).otherwise(out)
    return out


def _bins(level: Column, start: Column, end: Column, width: int, most_bins: int) -> Column:
    w = F.element_at(F.array(*[F.lit(width * most_bins**k).cast("long") for k in range(LEVELS)]), level + 1)
    return F.sequence(F.floor(start / w), F.floor((end - 1) / w))


def overlap_join(left: DataFrame, right: DataFrame, how: str = "inner", width: int = 1000, most_bins: int = 16, prefix: str = "r_") -> DataFrame:
    """Pairs of rows with the same chrom whose [start, end) overlap; how: inner, left, left_semi or left_anti.

    right's columns get the prefix. width: about the length of most rows. Each side is read once for every way that
    its rows are used; for rows of mixed lengths, levels keep the copies few. Rows whose span is null have no partners.
    """
    right = right.select(*[F.col(f"`{c}`").alias(prefix + c) for c in right.columns])
    span = ["chrom", "start", "end"]
    if how != "inner":
        # rows of one span have the same partners, so the distinct spans are joined and rows find theirs by the span itself
        met = _met(left.select(*span).distinct(), right, width, most_bins, prefix)
        more = [F.col(f"`{c}`") for c in right.columns] if how == "left" else []
        return left.join(met.select(*span, *more), span, how).select(*[F.col(f"`{c}`") for c in left.columns], *more)
    return _met(left, right, width, most_bins, prefix)


def _met(left: DataFrame, right: DataFrame, width: int, most_bins: int, prefix: str) -> DataFrame:
    """The pairs; right's columns have the prefix."""
    rs, re = F.col(f"{prefix}start"), F.col(f"{prefix}end")
    tagged = left.withColumn("_level", _level(F.col("start"), F.col("end"), width, most_bins))
    other = right.withColumn("_rlevel", _level(rs, re, width, most_bins))
    # which levels have rows of their own on either side, and how many: a few numbers, from one pass over the coordinates
    present = tagged.select(F.lit("l").alias("side"), F.col("_level").alias("k")).union(other.select(F.lit("r"), "_rlevel")).groupBy("side", "k").count().collect()
    left_levels, right_levels = ([r["k"] for r in present if r["side"] == side] for side in "lr")

    def spread(df: DataFrame, level: str, start: Column, end: Column, others: list[int], own_roles: list[int], guest_role: int, k: str, b: str, role: str) -> DataFrame:
        ways = [(F.col(level), r, F.lit(True)) for r in own_roles] + [(F.lit(x), guest_role, F.col(level) < x) for x in others]
        at = lambda x, r: F.transform(_bins(x, start, end, width, most_bins), lambda i: F.struct(x.cast("int").alias("k"), i.alias("b"), F.lit(r).alias("r")))
        none = F.slice(at(F.lit(0), 0), 1, 0)
        return exploded(df, "_x", F.concat(*[F.when(use, at(x, r)).otherwise(none) for x, r, use in ways])).withColumns({k: F.col("_x.k"), b: F.col("_x.b"), role: F.col("_x.r")}).drop("_x")

    # role 0: left rows at home, right rows at home or guests; role 1: left guests, right rows at home
    a = spread(tagged, "_level", F.col("start"), F.col("end"), right_levels, [0], 1, "_k", "_b", "_r")
    b = spread(other, "_rlevel", rs, re, left_levels, [0, 1], 0, "_rk", "_rb", "_rr")
    w = F.element_at(F.array(*[F.lit(width * most_bins**k).cast("long") for k in range(LEVELS)]), F.col("_k") + 1)
    on = (F.col("chrom") == F.col(f"{prefix}chrom")) & (F.col("_k") == F.col("_rk")) & (F.col("_b") == F.col("_rb")) & (F.col("_r") == F.col("_rr"))
    rows = [sum(r["count"] for r in present if r["side"] == side) for side in "lr"]
    if min(rows) > FEW_ROWS:
        # Spark goes by the size of files, which tells little of the rows and copies here: it would broadcast what does not fit
        tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(rows) // ROWS_A_TASK + 1)
        a, b = a.repartition(tasks, "chrom", "_k", "_b", "_r"), b.repartition(tasks, f"{prefix}chrom", "_rk", "_rb", "_rr").hint("merge")
    hit = (F.col("start") < re) & (F.col("end") > rs) & (F.col("_b") == F.floor(F.greatest(F.col("start"), rs) / w))
    return a.join(b, on & hit).drop("_k", "_b", "_r", "_rk", "_rb", "_rr", "_level", "_rlevel")


def overlap_join_plain(left: DataFrame, right: DataFrame, how: str = "inner", prefix: str = "r_") -> DataFrame:
    """The same pairs by equality of chrom and a range condition; for small sides."""
    right = right.select(*[F.col(f"`{c}`").alias(prefix + c) for c in right.columns])
    on = (F.col("chrom") == F.col(f"{prefix}chrom")) & (F.col("start") < F.col(f"{prefix}end")) & (F.col("end") > F.col(f"{prefix}start"))
    return left.join(right, on, how)


def region(df: DataFrame, chrom: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows that overlap a region; reaches the scan as plain filters."""
    out = df.filter(F.col("chrom") == chrom)
    if end is not None:
        out = out.filter(F.col("start") < end)
    return out if start is None else out.filter(F.col("end") > start)


def allele_match(ref: Column, alt: Column, snp_ref: Column, snp_alts: Column) -> Column:
    """Whether ref and alt are a variant's, on either strand."""
    same = lambda r, a: (snp_ref == r) & F.array_contains(snp_alts, a)
    return F.coalesce(same(ref, alt) | same(S.complement(ref), S.complement(alt)), F.lit(False))


def without_positions(events: DataFrame, snps: DataFrame) -> DataFrame:
    """Event rows (chrom, pos, ...) at no SNP's start."""
    return events.join(snps.select("chrom", F.col("start").alias("pos")).distinct(), ["chrom", "pos"], "left_anti")


def mark_variants(sites: DataFrame, snps: DataFrame) -> DataFrame:
    """sites (chrom, pos, ref, alt) with is_snp: a variant of the same alleles, on either strand, starts there."""
    known = snps.select("chrom", F.col("start").alias("pos"), F.explode("alts").alias("_alt"), F.col("ref").alias("_ref"))
    both = known.union(known.select("chrom", "pos", S.complement(F.col("_alt")), S.complement(F.col("_ref")))).select("chrom", "pos", F.col("_ref").alias("ref"), F.col("_alt").alias("alt")).distinct()
    return sites.join(both.withColumn("_hit", F.lit(True)), ["chrom", "pos", "ref", "alt"], "left").withColumn("is_snp", F.coalesce("_hit", F.lit(False))).drop("_hit")


def split_blacklist(sites: DataFrame, blacklist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, hit): sites without and with a blacklisted variant of the same alleles."""
    marked = mark_variants(sites, blacklist)
    return marked.filter(~F.col("is_snp")).drop("is_snp"), marked.filter("is_snp").drop("is_snp")
