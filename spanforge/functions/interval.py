"""Scalar functions on spans (start, end), strands and transcripts, as column expressions.

Relations look at coordinates only; joins compare chromosomes. Positions and indexes are strand-aware: on "-"
they count from the 3' side of the span. What has no answer is null, or raises with strict=True.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import blocks as B


def _lit(x: Column | int | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def is_valid(start: Column, end: Column) -> Column:
    return (start >= 0) & (start < end)


def check(start: Column, end: Column) -> Column:
    """start; the query fails on a span that is none."""
    return F.when(is_valid(start, end), start).otherwise(F.raise_error(F.lit("invalid span")))


def fits_blocks(start: Column, end: Column, b: Column) -> Column:
    """Whether a span, ends of which may be null, and its blocks go together: valid blocks that begin and end where it does; without
    blocks, a valid span."""
    low, high = F.get(b, F.lit(0))["s"], F.get(b, F.size(b) - 1)["e"]
    same = (start.isNull() | (start == low)) & (end.isNull() | (end == high)) & B.is_valid(b)
    return F.coalesce(F.when(b.isNull() | (F.size(b) == 0), is_valid(start, end)).otherwise(same), F.lit(False))


def valid_strand(strand: Column) -> Column:
    return strand.isNull() | strand.isin(".", "+", "-")


def is_forward(strand: Column) -> Column:
    return F.coalesce(strand == "+", F.lit(False))


def is_reverse(strand: Column) -> Column:
    return F.coalesce(strand == "-", F.lit(False))


def index(start: Column, end: Column, pos: Column, strand: Column | None = None, strict: bool = False) -> Column:
    """Offset of pos within the span."""
    strand = F.lit(None).cast("string") if strand is None else strand
    value = F.when(is_reverse(strand), end - pos - 1).otherwise(pos - start)
    return F.when((start <= pos) & (pos < end), value).otherwise(F.raise_error(F.lit("position outside the span")) if strict else F.lit(None))


def position(start: Column, end: Column, idx: Column, strand: Column | None = None, strict: bool = False) -> Column:
    """The position at an offset; negative offsets count from the other end."""
    strand = F.lit(None).cast("string") if strand is None else strand
    n = end - start
    at = F.when(idx < 0, idx + n).otherwise(idx)
    value = F.when(is_reverse(strand), end - 1 - at).otherwise(start + at)
    return F.when((idx >= -n) & (idx < n), value).otherwise(F.raise_error(F.lit("index outside the span")) if strict else F.lit(None))


def distance(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Bases between two spans; negative: bases of overlap."""
    return F.greatest(s1, s2) - F.least(e1, e2)


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return distance(s1, e1, s2, e2) < 0


def adjacent(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return distance(s1, e1, s2, e2) == 0


def away(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return distance(s1, e1, s2, e2) > 0


def contacts(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return distance(s1, e1, s2, e2) <= 0


def contains(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether the first span holds the second. On plain spans coinciding is the same."""
    return (s1 <= s2) & (e1 >= e2)


def overlaps_blocks(a: Column, b: Column) -> Column:
    """Whether blocks, not only spans, overlap (a span may overlap inside an intron)."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])))


def order_key(chrom: Column, start: Column, end: Column) -> Column:
    """Sorts as records do: chromosome by code point, then start, then end."""
    return F.struct(chrom.alias("chrom"), start.alias("start"), end.alias("end"))


def shift(start: Column, end: Column, by: Column | int) -> Column:
    """struct(start, end) moved; null where it would start below zero."""
    return F.when(start + _lit(by) >= 0, F.struct((start + _lit(by)).alias("start"), (end + _lit(by)).alias("end")))


def intersect(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """struct(start, end) common to both spans, or null."""
    return F.when(overlaps(s1, e1, s2, e2), F.struct(F.greatest(s1, s2).alias("start"), F.least(e1, e2).alias("end")))


def union(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """struct(start, end) of two spans in contact, or null."""
    return F.when(contacts(s1, e1, s2, e2), F.struct(F.least(s1, s2).alias("start"), F.greatest(e1, e2).alias("end")))


def subtract(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Blocks of the first span that the second leaves."""
    piece = lambda s, e: F.when(s < e, F.array(B.block(s, e))).otherwise(B.empty())
    return F.concat(piece(s1, F.least(e1, s2)), piece(F.greatest(s1, e2), e1))


def label(chrom: Column, start: Column, end: Column) -> Column:
    """chrom:start-end."""
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def valid_thick(b: Column, thick: Column) -> Column:
    """Whether the thick part lies in the span, its ends inside blocks."""
    inside = (thick["s"] < thick["e"]) & B.includes(b, thick["s"]) & B.includes(b, thick["e"] - 1)
    return thick.isNull() | F.coalesce(inside, F.lit(False))


def thick_indexes(b: Column, thick: Column, strand: Column) -> Column:
    """struct(i0, i1, i2, i3): start, thick start, thick end and end in transcript coordinates; i1, i2 null without thick."""
    n = B.length(b)
    low, high = B.index(b, thick["s"]), B.index(b, thick["e"] - 1) + 1
    back = is_reverse(strand)
    return F.struct(F.lit(0).cast("long").alias("i0"), F.when(back, n - high).otherwise(low).alias("i1"), F.when(back, n - low).otherwise(high).alias("i2"), n.alias("i3"))


def cds(b: Column, thick: Column) -> Column:
    """Blocks of the coding part."""
    return B.clip(b, thick["s"], thick["e"])


def utr5(b: Column, thick: Column, strand: Column) -> Column:
    """Blocks before the coding part, in the direction of the strand; null without coding part."""
    outer = _outer(b, thick)
    return F.when(is_reverse(strand), outer["high"]).otherwise(outer["low"])


def utr3(b: Column, thick: Column, strand: Column) -> Column:
    """Blocks behind the coding part, in the direction of the strand; null without coding part."""
    outer = _outer(b, thick)
    return F.when(is_reverse(strand), outer["low"]).otherwise(outer["high"])


def _outer(b: Column, thick: Column) -> Column:
    cut = lambda s, e: F.filter(F.transform(b, lambda x: B.block(F.greatest(x["s"], s), F.least(x["e"], e))), lambda x: x["s"] < x["e"])
    none = F.lit(None)
    return F.struct(F.when(thick.isNotNull(), cut(B.first(b)["s"], thick["s"])).otherwise(none).alias("low"), F.when(thick.isNotNull(), cut(thick["e"], B.last(b)["e"])).otherwise(none).alias("high"))


def part_lengths(b: Column, thick: Column, strand: Column) -> Column:
    """struct(utr5, cds, utr3): exonic bases of each part."""
    i = thick_indexes(b, thick, strand)
    return F.struct((i["i1"] - i["i0"]).alias("utr5"), (i["i2"] - i["i1"]).alias("cds"), (i["i3"] - i["i2"]).alias("utr3"))


def landmark_distances(b: Column, thick: Column, strand: Column, pos: Column) -> Column:
    """struct(tss, cds_start, cds_end, tes): offsets of pos from these points in transcript coordinates; nulls without coding part."""
    i, at = thick_indexes(b, thick, strand), B.index(b, pos, is_reverse(strand))
    some = thick.isNotNull()
    part = lambda x: F.when(some, at - x)
    return F.struct(part(i["i0"]).alias("tss"), part(i["i1"]).alias("cds_start"), part(i["i2"]).alias("cds_end"), part(i["i3"]).alias("tes"))


def metagene_ratio(b: Column, thick: Column, strand: Column, pos: Column) -> Column:
    """Where pos lies: 0 to 1 in the 5' UTR, 1 to 2 in the coding part, 2 to 3 in the 3' UTR; null without coding part."""
    i, at = thick_indexes(b, thick, strand), B.index(b, pos, is_reverse(strand))
    within = lambda low, high: (at - low + 0.5) / (high - low)
    return F.when(at < i["i1"], within(i["i0"], i["i1"])).when(at < i["i2"], within(i["i1"], i["i2"]) + 1).when(at < i["i3"], within(i["i2"], i["i3"]) + 2)


def all_coincide(ref: Column, lists: Column) -> Column:
    """Whether every block list (such as the mates of a fragment) coincides with ref."""
    return F.forall(lists, lambda q: B.coincides(ref, q))
