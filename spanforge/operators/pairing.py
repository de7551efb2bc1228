"""Mates of paired reads, and fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks as B

#: Fixed bits of a read's flag.
PAIRED, PROPER, UNMAPPED, REVERSE, FIRST, SECOND, SECONDARY, SUPPLEMENTARY = 1, 2, 4, 16, 64, 128, 256, 2048


def flag(bit: int):
    return F.col("flag").bitwiseAND(F.lit(bit)) != 0


def mates(reads: DataFrame) -> DataFrame:
    """chrom, start, end, qname, mate1, mate2: first and second reads of a name that name each other's start, one to one in
    order; reads without mate are dropped. reads: qname, flag, chrom, start, end, next_start and more."""
    own = [c for c in reads.columns]
    rank = F.row_number().over(Window.partitionBy("qname", "chrom", "start", "next_start").orderBy("end", *[c for c in own if c in ("cigar", "seq", "read_id")]))
    side = lambda first, name: reads.filter(flag(FIRST) == F.lit(first)).withColumn("_n", rank).select("qname", "chrom", F.col("start").alias("start" if first else "_next"), F.col("next_start").alias("_next" if first else "start"), "_n", F.struct(*own).alias(name))
    met = side(True, "mate1").join(side(False, "mate2"), ["qname", "chrom", "start", "_next", "_n"])
    return met.select("chrom", F.least("mate1.start", "mate2.start").alias("start"), F.greatest("mate1.end", "mate2.end").alias("end"), "qname", "mate1", "mate2")


def fragments(reads: DataFrame) -> DataFrame:
    """mates() with blocks, the union of both mates' blocks, and strand, the first mate's. reads also have blocks and strand."""
    return mates(reads).withColumns({"blocks": B.fusion(F.col("mate1.blocks"), F.col("mate2.blocks")), "strand": F.col("mate1.strand")})


def name_paired(reads: DataFrame, ordinal: str) -> DataFrame:
    """Mates of a name-paired file: rows 2k and 2k + 1 by the ordinal; an odd last row is dropped, different names fail."""
    row = F.struct(*reads.columns)
    both = reads.groupBy(F.floor(F.col(ordinal) / 2).alias("_pair")).agg(F.min_by(row, ordinal).alias("mate1"), F.max_by(row, ordinal).alias("mate2"), F.count("*").alias("_n")).filter("_n = 2")
    name = F.when(F.col("mate1.qname") == F.col("mate2.qname"), F.col("mate1.qname")).otherwise(F.raise_error(F.lit("mates have different names")))
    return both.select(name.alias("qname"), "mate1", "mate2")


def as_reads(pairs: DataFrame) -> DataFrame:
    """mate1 and mate2 of every pair as rows, with ordinal 0 and 1."""
    return pairs.select("qname", F.posexplode(F.array("mate1", "mate2")).alias("ordinal", "read")).select(F.col("read.*"), "ordinal")


def split_by_chromosome(pairs: DataFrame, path: str) -> None:
    """Write a folder for each chromosome."""
    pairs.write.partitionBy("chrom").parquet(path)


def merge(*inputs: DataFrame) -> DataFrame:
    """All rows of the inputs, one after the other."""
    out = inputs[0]
    for d in inputs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
