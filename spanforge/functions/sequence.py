"""Sequence functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let

#: Fixed: bases and their complements.
BASES, COMPLEMENTS = "ACGTNacgtn", "TGCANtgcan"


def complement(seq: Column) -> Column:
    return F.translate(seq, BASES, COMPLEMENTS)


def reverse_complement(seq: Column, strict: bool = False) -> Column:
    """The other strand's sequence; other letters than ACGTN stay, or fail with strict."""
    value = F.reverse(complement(seq))
    return F.when(F.translate(seq, BASES, "") == "", value).otherwise(F.raise_error(F.lit("unknown base"))) if strict else value


def piece(seq: Column, start: Column, end: Column, strict: bool = False) -> Column:
    """seq[start:end]; null (or failing) outside the sequence."""
    good = (start >= 0) & (start < end) & (end <= F.length(seq))
    return F.when(good, F.substring(seq, start.cast("int") + 1, (end - start).cast("int"))).otherwise(F.raise_error(F.lit("outside the sequence")) if strict else F.lit(None))


def spliced(seq: Column, b: Column, strand: Column | None = None) -> Column:
    """The sequence over blocks, in genomic order; reverse-complemented where strand is "-"."""
    joined = F.array_join(F.transform(b, lambda x: F.substring(seq, x["s"].cast("int") + 1, (x["e"] - x["s"]).cast("int"))), "")
    return joined if strand is None else F.when(strand == "-", reverse_complement(joined)).otherwise(joined)


def wrapped(seq: Column, width: int = 50) -> Column:
    """Lines of `width` letters."""
    return F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n"))


def base_count(seq: Column, base: str) -> Column:
    """How often an upper- or lower-case base occurs."""
    upper = F.upper(seq)
    return (F.length(upper) - F.length(F.replace(upper, F.lit(base), F.lit("")))).cast("long")


def base_counts(seq: Column, bases: str = "ACGTN") -> Column:
    """Counts of the bases that occur, as text like A,3;C,1 in alphabetic order."""

    def counted(upper: Column, base: str) -> Column:
        n = F.length(upper) - F.length(F.replace(upper, F.lit(base), F.lit("")))
        return let(n, lambda many: F.when(many > 0, F.concat(F.lit(f"{base},"), many.cast("string"))))

    return let(F.upper(seq), lambda upper: F.array_join(F.array_compact(F.array(*[counted(upper, x) for x in sorted(bases)])), ";"))
