"""Algebra of exon blocks, as column expressions over array<struct<s, e>>.

Block lists are sorted and disjoint unless a function says otherwise. No function needs Python workers.
Functions that have no answer (a position in a gap, a shift below zero, a broken list) give null, or raise
inside the query with `strict=True`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BLOCKS
from .let import let


def block(s: Column | int, e: Column | int) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(s).cast("long").alias("s"), lit(e).cast("long").alias("e"))


def empty() -> Column:
    return F.array().cast(BLOCKS)


def literal(pairs: list[tuple[int, int]]) -> Column:
    """A constant block list."""
    return F.array(*[block(*p) for p in pairs]).cast(BLOCKS) if pairs else empty()


def first(b: Column) -> Column:
    return F.get(b, F.lit(0))


def last(b: Column) -> Column:
    return F.get(b, F.size(b) - 1)


def _or_null(good: Column, value: Column, strict: bool, message: str) -> Column:
    return F.when(good, value).otherwise(F.raise_error(F.lit(message)) if strict else F.lit(None))


def is_valid(b: Column) -> Column:
    """Not empty, each block with 0 <= s < e, each starting at or after the end of the one before."""
    walk = F.aggregate(b, F.lit(0).cast("long"), lambda at, x: F.when((at >= 0) & (x["s"] >= at) & (x["s"] < x["e"]), x["e"]).otherwise(F.lit(-1).cast("long")))
    return F.coalesce((F.size(b) > 0) & (walk > 0), F.lit(False))


def check(b: Column) -> Column:
    """b itself; the query fails on a list that isn't valid."""
    return _or_null(is_valid(b), b, True, "invalid blocks")


def is_sorted(b: Column) -> Column:
    """Whether blocks ascend by (s, e)."""
    return b == F.array_sort(b)


def check_sorted(b: Column) -> Column:
    """b itself; the query fails on a list out of order."""
    return _or_null(is_sorted(b), b, True, "blocks out of order")


def sort(b: Column) -> Column:
    return F.array_sort(b)


def length(b: Column) -> Column:
    """Bases in all blocks."""
    return F.aggregate(b, F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])


def includes(b: Column, pos: Column) -> Column:
    """Whether a block holds the position."""
    return F.exists(b, lambda x: (x["s"] <= pos) & (pos < x["e"]))


def index(b: Column, pos: Column, reverse: Column | bool = False, strict: bool = False) -> Column:
    """The number of bases of b before pos (after it, if reverse); null in gaps and outside."""
    reverse = reverse if isinstance(reverse, Column) else F.lit(reverse)
    before = F.aggregate(b, F.lit(0).cast("long"), lambda n, x: n + F.least(F.greatest(pos - x["s"], F.lit(0)), x["e"] - x["s"]))
    value = F.when(reverse, length(b) - 1 - before).otherwise(before)
    return _or_null(includes(b, pos), value, strict, "position outside the blocks")


def position(b: Column, idx: Column, reverse: Column | bool = False, strict: bool = False) -> Column:
    """The position of the idx-th base (negative: from the end); null outside -length <= idx < length."""
    reverse = reverse if isinstance(reverse, Column) else F.lit(reverse)
    n = length(b)
    forward = F.when(idx < 0, idx + n).otherwise(idx)
    at = F.when(reverse, n - 1 - forward).otherwise(forward)
    start = F.struct(F.lit(0).cast("long").alias("done"), F.lit(None).cast("long").alias("pos"))
    step = lambda a, x: F.struct((a["done"] + x["e"] - x["s"]).alias("done"), F.when(a["pos"].isNull() & (at < a["done"] + x["e"] - x["s"]), x["s"] + at - a["done"]).otherwise(a["pos"]).alias("pos"))
    return _or_null((idx >= -n) & (idx < n), F.aggregate(b, start, step, lambda a: a["pos"]), strict, "index outside the blocks")


def move(b: Column, step: Column | int, strict: bool = False) -> Column:
    """All blocks shifted; null if the first would start below zero."""
    step = step if isinstance(step, Column) else F.lit(step)
    return _or_null(first(b)["s"] + step >= 0, F.transform(b, lambda x: block(x["s"] + step, x["e"] + step)), strict, "shift below zero")


def gaps(b: Column) -> Column:
    """The introns: one gap between each two neighbours, of length zero where they touch."""
    return let(b, lambda v: F.transform(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), lambda x, i: block(F.get(v, i)["e"], x["s"])))


def suture(b: Column, gap: Column | int = 0) -> Column:
    """Blocks merged where the next starts at most `gap` behind; any order of b."""
    gap = gap if isinstance(gap, Column) else F.lit(gap)
    join = lambda a, x: F.when((F.size(a) > 0) & (x["s"] - last(a)["e"] <= gap), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(block(last(a)["s"], F.greatest(last(a)["e"], x["e"]))))).otherwise(F.concat(a, F.array(block(x["s"], x["e"]))))
    return F.aggregate(F.array_sort(b), empty(), join)


def fusion(a: Column, b: Column) -> Column:
    """The union of two block lists."""
    return suture(F.concat(a, b))


def contains(b: Column, inner: Column) -> Column:
    """Whether every block of inner lies within b (touching blocks of b count as one)."""
    return let(suture(b), lambda whole: F.forall(inner, lambda y: F.exists(whole, lambda x: (x["s"] <= y["s"]) & (x["e"] >= y["e"]))))


def coincides(ref: Column, query: Column) -> Column:
    """Whether query is splice-compatible with ref: inner edges of query lie on block edges of ref, whole blocks
    of ref may be skipped. Not symmetric. An empty query is compatible."""
    a, z = first(query), last(query)
    single = F.exists(ref, lambda x: (x["s"] <= a["s"]) & (x["e"] >= a["e"]))
    head = F.exists(ref, lambda x: (x["s"] <= a["s"]) & (x["e"] == a["e"]))
    middle = F.forall(F.slice(query, 2, F.greatest(F.size(query) - 2, F.lit(0))), lambda y: F.exists(ref, lambda x: (x["s"] == y["s"]) & (x["e"] == y["e"])))
    tail = F.exists(ref, lambda x: (x["s"] == z["s"]) & (x["e"] >= z["e"]))
    return F.when(F.size(query) == 0, True).when(F.size(query) == 1, single).otherwise(head & middle & tail)


def clip(b: Column, start: Column | int, end: Column | int, strict: bool = False) -> Column:
    """b inside the window [start, end); may be empty. Null for a window that is none."""
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    cut = F.filter(F.transform(b, lambda x: block(F.greatest(x["s"], start), F.least(x["e"], end))), lambda x: x["s"] < x["e"])
    return _or_null((start >= 0) & (start < end), cut, strict, "no window")


def clip_extend(b: Column, start: Column | int, end: Column | int, template: Column | None = None, left: bool = True, right: bool = True, supply: bool = False, join: bool = True) -> Column:
    """clip(), and what the window has beyond b: plain blocks, or those of the template there, and with supply also
    a plain piece beyond the template's own edge. Where an edge is shared there is no extension."""
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    low, high = first(b)["s"], last(b)["e"]
    some = lambda s, e: F.when(s < e, F.array(block(s, e))).otherwise(empty())
    inner = clip(b, start, end)
    before, after = empty(), empty()
    if template is None:
        before, after = some(start, F.least(low, end)), some(F.greatest(high, start), end)
    else:
        within = lambda s, e: F.when(s < e, F.filter(F.transform(template, lambda x: block(F.greatest(x["s"], s), F.least(x["e"], e))), lambda x: x["s"] < x["e"])).otherwise(empty())
        before, after = within(start, F.least(low, end)), within(F.greatest(high, start), end)
        if supply:
            edge_low, edge_high = first(template)["s"], last(template)["e"]
            before = F.concat(some(start, F.least(edge_low, F.least(low, end))), before)
            after = F.concat(after, some(F.greatest(edge_high, F.greatest(high, start)), end))
    out = F.concat(before if left else empty(), inner, after if right else empty())
    return F.when(inner.isNotNull(), suture(out) if join else F.array_sort(out))


#: Fixed values of the comparison's classes.
NOT_OVERLAP, OVERLAP, FULL_MATCH = 0, 1, 2
BOTH_ENDS_MATCH, RIGHT_END_DIFFERS, LEFT_END_DIFFERS, BOTH_ENDS_DIFFER = 0, 1, 2, 3


def compare(ref: Column, query: Column, tolerance: int = 50) -> Column:
    """struct(category, subcategory) of a query isoform against a reference.

    One block on both sides: overlap or not, by span. The same introns: full match, and which ends differ by more
    than the tolerance. Anything else, also a multi-block reference with a one-block query: nulls.
    """
    return let(ref, lambda a: let(query, lambda b: _compare(a, b, tolerance)))


def _compare(ref: Column, query: Column, tolerance: int) -> Column:
    left, right = F.abs(first(ref)["s"] - first(query)["s"]) > tolerance, F.abs(last(ref)["e"] - last(query)["e"]) > tolerance
    over = (first(query)["s"] < last(ref)["e"]) & (last(query)["e"] > first(ref)["s"])
    same = (F.size(ref) > 1) & (F.size(query) > 1) & (gaps(ref) == gaps(query))
    category = F.when(F.size(ref) == 1, F.when(over, OVERLAP).otherwise(NOT_OVERLAP)).when(same, FULL_MATCH)
    ends = F.when(left & right, BOTH_ENDS_DIFFER).when(left, LEFT_END_DIFFERS).when(right, RIGHT_END_DIFFERS).otherwise(BOTH_ENDS_MATCH)
    return F.struct(category.alias("category"), F.when((F.size(ref) > 1) & same, ends).alias("subcategory"))


def text(b: Column, between: str = "-", join: str = ";") -> Column:
    """Blocks as text, like 10-20;30-40."""
    return F.array_join(F.transform(b, lambda x: F.concat_ws(between, x["s"].cast("string"), x["e"].cast("string"))), join)


def parse(t: Column, between: str = "-", join: str = ";") -> Column:
    """Blocks from text."""
    parts = lambda x: F.split(x, between)
    return F.transform(F.split(t, join), lambda x: block(parts(x)[0].cast("long"), parts(x)[1].cast("long"))).cast(BLOCKS)
