"""Mismatch events of reads and fragments: calling, masking, merging of mates, sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import cigar as C
from ..functions import sequence as S
from ..functions.let import exploded, let, once
from . import pairing as P


def mapped(reads: DataFrame) -> DataFrame:
    """Reads without unmapped, secondary and supplementary ones."""
    return reads.filter(~P.flag(P.UNMAPPED) & ~P.flag(P.SECONDARY) & ~P.flag(P.SUPPLEMENTARY))


def called(reads: DataFrame, insertions: bool = True) -> DataFrame:
    """reads (cigar, start, seq, qual, tags with MD) with events and base_counts (of the reference under the read)."""
    md = F.col("tags")["MD"]
    return reads.withColumns({"events": C.events(F.col("cigar"), F.col("start"), md, F.col("seq"), F.col("qual"), insertions=insertions), "base_counts": S.base_counts(C.reference_sequence(F.col("cigar"), md, F.col("seq")))})


def tagged(reads: DataFrame) -> DataFrame:
    """called() as tags: ME has the events, RC the base counts."""
    out = called(mapped(reads))
    tags = F.map_concat(F.map_filter("tags", lambda k, _: ~k.isin("ME", "RC")), F.create_map(F.lit("ME"), C.encode_events(F.col("events")), F.lit("RC"), F.col("base_counts")))
    return out.withColumn("tags", tags).drop("events", "base_counts")


def rows(reads: DataFrame, key: str, events: str = "events") -> DataFrame:
    """One row for each event: key, chrom, pos, ref, alt, qual (the best of several), dist."""
    return exploded(reads, "x", F.col(events)).select(key, "chrom", "x.pos", "x.ref", "x.alt", F.array_max("x.qual").alias("qual"), "x.dist")


def per_base(events: DataFrame) -> DataFrame:
    """Event rows with deletions of several bases as one row for each base, insertions left out."""
    kept = events.filter("ref <> '-'")
    each = kept.select("*", F.posexplode(F.split("ref", "")).alias("_i", "_base")).filter("_base <> ''")
    return each.withColumns({"pos": F.col("pos") + F.col("_i"), "ref": F.col("_base")}).drop("_i", "_base")


def is_indel(ref: Column, alt: Column) -> Column:
    return (ref == "-") | (alt == "-")


def masked(events: DataFrame, snps: DataFrame, drop_indels: bool = True) -> DataFrame:
    """Event rows without those at a SNP's start and, by choice, without indels (which otherwise stay, at SNPs too)."""
    at = snps.select("chrom", F.col("start").alias("pos")).distinct().withColumn("_snp", F.lit(True))
    indel = is_indel(F.col("ref"), F.col("alt"))
    out = events.join(at, ["chrom", "pos"], "left")
    return out.filter((~indel & F.col("_snp").isNull()) if drop_indels else (indel | F.col("_snp").isNull())).drop("_snp")


def regrouped(events: DataFrame, key: str) -> DataFrame:
    """key, events: rows() undone, in order."""
    x = F.struct("pos", "ref", "alt", F.array("qual").alias("qual"), "dist")
    return events.groupBy(key).agg(F.array_sort(F.collect_list(x)).alias("events"))


def merge_mates(first: DataFrame, second: DataFrame, key: str = "fragment") -> DataFrame:
    """Events of both mates by position: the same allele keeps the best score and distance; of different alleles the higher
    score wins, then the larger distance, and equal ones drop out. Different reference bases fail."""
    on = [key, "chrom", "pos"]
    a = first.select(*on, F.struct("ref", "alt", "qual", "dist").alias("a"))
    b = second.select(*on, F.struct("ref", "alt", "qual", "dist").alias("b"))
    x, y = F.col("a"), F.col("b")
    both = x.isNotNull() & y.isNotNull()
    same = F.struct(x["ref"].alias("ref"), x["alt"].alias("alt"), F.greatest(x["qual"], y["qual"]).alias("qual"), F.greatest(x["dist"], y["dist"]).alias("dist"))
    best = F.when(x["qual"] > y["qual"], x).when(x["qual"] < y["qual"], y).when(x["dist"] > y["dist"], x).when(x["dist"] < y["dist"], y)
    wrong = F.raise_error(F.lit("mates have different reference bases"))
    z = F.when(~both, F.coalesce(x, y)).when(x["ref"] != y["ref"], wrong).when(x["alt"] == y["alt"], same).otherwise(best)
    return a.join(b, on, "full").withColumn("z", z).filter("z is not null").select(*on, "z.ref", "z.alt", "z.qual", "z.dist")


def cross_checked(events: DataFrame, other_base: Column, other_qual: Column) -> DataFrame:
    """Events of one mate against the other mate's base and score at the same place (null where it doesn't reach): kept if it
    agrees or is absent; a better other base replaces the event, or removes it if it is the reference's; a tie drops it."""
    base = F.when(other_base.isNull() | (other_base == F.col("alt")) | (F.col("qual") > other_qual), F.col("alt")).when(other_qual > F.col("qual"), other_base)
    score = F.when(other_base.isNull(), F.col("qual")).otherwise(F.greatest(F.col("qual"), other_qual))
    return events.withColumns({"alt": base, "qual": score}).filter(F.col("alt").isNotNull() & (F.col("alt") != F.col("ref")))


def _against(events: Column, other: Column) -> Column:
    """events of one mate with the other mate's base, score and distance in place of theirs where its score is higher; alt is null
    where scores tie over different bases."""

    def judged(e: Column, at: Column, scores: Column, n: Column) -> Column:
        off = e["pos"] - at["g0"]
        base = F.when(at["op"] == "M", F.substring(other["seq"], (at["r0"] + off).cast("int") + 1, F.lit(1))).when(at["op"] == "D", "-")
        score = F.when(at["op"] == "M", F.coalesce(F.get(scores, (at["r0"] + off).cast("int")), F.lit(0))).when(at["op"] == "D", 0)
        own = F.get(e["qual"], F.lit(0))
        alt = F.when(score > own, base).when((score == own) & (base != e["alt"]), F.lit(None)).otherwise(e["alt"])
        dist = F.when(score > own, F.least(at["m0"] + off, n - 1 - at["m0"] - off)).otherwise(e["dist"])
        return F.struct(e["pos"].alias("pos"), e["ref"].alias("ref"), alt.alias("alt"), F.array(F.when(score > own, score).otherwise(own)).alias("qual"), dist.alias("dist"))

    covers = lambda e: lambda x: (x["g0"] <= e["pos"]) & (e["pos"] < x["g1"])
    one = lambda ops, scores, n: lambda e: let(F.get(F.filter(ops, covers(e)), F.lit(0)), lambda at: judged(e, at, scores, n))
    return let(C.operations(other["cigar"], other["start"]), lambda ops: let(C.qualities(other["qual"]), lambda scores: let(C.mapped_length(other["cigar"]), lambda n: F.transform(events, one(ops, scores, n)))))


def pair_events(first: Column, second: Column) -> Column:
    """Events of a fragment (base_events() of both mates, structs of cigar, start, seq, qual and tags) with every position once.

    The other mate's base at an event's position replaces it if its score is higher; of different bases with equal scores none
    stays; what then is the reference's base goes. Where both mates have an event the first mate's counts.
    """
    return let(_own_events(first), lambda a: let(_own_events(second), lambda b: _pair_events(first, second, a, b)))


def _own_events(mate: Column) -> Column:
    return C.base_events(mate["cigar"], mate["start"], mate["tags"]["MD"], mate["seq"], mate["qual"])


def _pair_events(first: Column, second: Column, a: Column, b: Column) -> Column:
    """pair_events() from the mates' own events a and b."""
    new = F.filter(b, lambda y: ~F.exists(a, lambda x: x["pos"] == y["pos"]))
    return F.filter(F.concat(_against(a, second), _against(new, first)), lambda e: e["alt"].isNotNull() & (e["alt"] != e["ref"]))


def pair_reference(first: Column, second: Column) -> Column:
    """The reference's bases under a fragment, by the mates' MD tags: the first mate's, then the second's outside the first's blocks."""
    return _pair_reference(first, second, _own_reference(first), _own_reference(second))


def _own_reference(mate: Column) -> Column:
    return C.reference_sequence(mate["cigar"], mate["tags"]["MD"], mate["seq"])


def _pair_reference(first: Column, second: Column, a: Column, b: Column) -> Column:
    """pair_reference() from the references a and b under the mates."""
    places = F.flatten(F.transform(second["blocks"], lambda x: F.sequence(x["s"], x["e"] - 1)))
    listed = F.arrays_zip(places.alias("p"), F.split(b, "").alias("b"))
    outside = F.filter(listed, lambda x: x["p"].isNotNull() & ~B.includes(first["blocks"], x["p"]))
    return F.concat(a, F.array_join(F.transform(outside, lambda x: x["b"]), ""))


def genome_counts(ranges: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """chrom, blocks, counts: the genome's bases (as text, upper case) under each distinct row of blocks; chunks: of sources.text.chunked()
    by that size. Blocks on no contig have no row; bases beyond a contig's end don't count."""
    spans = ranges.select("chrom", "blocks").distinct()
    each = spans.select("chrom", "blocks", F.explode("blocks").alias("_b"))
    touched = each.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("_b.s") / size), F.floor((F.col("_b.e") - 1) / size))))
    low, high = F.greatest(F.col("_b.s") - F.col("chunk") * size, F.lit(0)), F.least(F.col("_b.e") - F.col("chunk") * size, F.lit(size))
    piece = F.upper(F.substring("_part", low.cast("int") + 1, (high - low).cast("int")))
    # pieces are many more rows than the file of their contigs suggests, so they are never broadcast
    parts = touched.join(chunks.select(F.col("name").alias("chrom"), "chunk", F.col("sequence").alias("_part")).hint("merge"), ["chrom", "chunk"]).withColumn("_piece", piece)
    letters = sorted("ACGTN")
    sums = parts.groupBy("chrom", "blocks").agg(*[F.sum(S.base_count(F.col("_piece"), x)).alias(x) for x in letters])
    shown = F.array_join(F.array_compact(F.array(*[F.when(F.col(x) > 0, F.concat(F.lit(f"{x},"), F.col(x).cast("string"))) for x in letters])), ";")
    return sums.select("chrom", "blocks", shown.alias("counts"))


def _retagged(tags: Column, **values: Column) -> Column:
    new = [x for k, v in values.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))]
    return F.map_concat(F.map_filter(tags, lambda k, _: ~k.isin(*values)), F.create_map(*new))


def _counted(df: DataFrame, counts: DataFrame, blocks: str, name: str) -> DataFrame:
    own = counts.select(F.col("chrom").alias("_chrom"), F.col("blocks").alias("_blocks"), F.col("counts").alias(name))
    return df.join(own, (F.col("chrom") == F.col("_chrom")) & (F.col(blocks) == F.col("_blocks")), "left").drop("_chrom", "_blocks")


def identified(reads: DataFrame, chunks: DataFrame | None = None, size: int = 1 << 12) -> DataFrame:
    """Alignments with the tags ME (base_events()) and RC (bases of the reference under the blocks, A to T).

    The reference is that of the MD tags, so nothing is shuffled, or the genome's if its chunks (of that size) are given.
    Unmapped, secondary and supplementary reads are left out; a read without MD has empty tags.
    """
    kept, md = mapped(reads), F.col("tags")["MD"]
    if chunks is None:
        out = kept.withColumn("_rc", S.base_counts(C.reference_sequence(F.col("cigar"), md, F.col("seq"))))
    else:
        out = _counted(kept, genome_counts(kept, chunks, size), "blocks", "_rc")
    me = C.encode_events(C.base_events(F.col("cigar"), F.col("start"), md, F.col("seq"), F.col("qual")))
    return out.withColumn("tags", _retagged(F.col("tags"), ME=me, RC=F.col("_rc"))).drop("_rc")


def identified_pairs(pairs: DataFrame, chunks: DataFrame | None = None, size: int = 1 << 12) -> DataFrame:
    """Fragments (as pairing.fragments() gives them) whose mates have the tags ME and RC, the first mate also PE (pair_events())
    and PC (bases under the fragment's blocks). The reference is found as by identified()."""
    one, two = F.col("mate1"), F.col("mate2")
    a, b = F.col("_e1"), F.col("_e2")
    own = {"_e1": _own_events(one), "_e2": _own_events(two)}
    if chunks is None:
        known = once(pairs, **own, _ref1=_own_reference(one), _ref2=_own_reference(two))
        x, y = F.col("_ref1"), F.col("_ref2")
        out = known.withColumns({"_rc1": S.base_counts(x), "_rc2": S.base_counts(y), "_pc": S.base_counts(_pair_reference(one, two, x, y))}).drop("_ref1", "_ref2")
    else:
        every = pairs.select("chrom", F.explode(F.array("mate1.blocks", "mate2.blocks", "blocks")).alias("blocks"))
        counts = genome_counts(every, chunks, size)
        out = _counted(_counted(_counted(pairs, counts, "mate1.blocks", "_rc1"), counts, "mate2.blocks", "_rc2"), counts, "blocks", "_pc")
        out = once(out, **own)
    first = _retagged(one["tags"], ME=C.encode_events(a), RC=F.col("_rc1"), PE=C.encode_events(_pair_events(one, two, a, b)), PC=F.col("_pc"))
    second = _retagged(two["tags"], ME=C.encode_events(b), RC=F.col("_rc2"))
    return out.withColumns({"mate1": one.withField("tags", first), "mate2": two.withField("tags", second)}).drop("_rc1", "_rc2", "_pc", "_e1", "_e2")


def single_side(events: DataFrame, other_qual: Column) -> DataFrame:
    """Events that the mate doesn't cover, or whose score is above the mate's there."""
    return events.filter(other_qual.isNull() | (F.col("qual") > other_qual))


def sites(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each (chrom, pos, ref, alt): the best score and its distance."""
    return events.groupBy(*keep, "chrom", "pos", "ref", "alt").agg(F.max(F.struct("qual", "dist")).alias("x")).select(*keep, "chrom", "pos", "ref", "alt", "x.qual", "x.dist")


def relative(events: DataFrame, strand: Column) -> DataFrame:
    """ref and alt as seen along the strand."""
    turn = lambda c: F.when(strand == "-", S.complement(F.col(c))).otherwise(F.col(c))
    return events.withColumns({"ref": turn("ref"), "alt": turn("alt")})


def compared(ranges: DataFrame) -> DataFrame:
    """Mismatches of sequence against reference of the same length (columns chrom, start, sequence, reference): pos, ref, alt, offset, dist."""
    at = F.posexplode(F.arrays_zip(F.split("reference", "").alias("r"), F.split("sequence", "").alias("a"))).alias("offset", "x")
    out = ranges.select("*", at).filter((F.col("x.r") != F.col("x.a")) & (F.col("x.r") != "") & (F.col("x.a") != ""))
    n = F.length("sequence")
    return out.select("chrom", (F.col("start") + F.col("offset")).alias("pos"), F.col("x.r").alias("ref"), F.col("x.a").alias("alt"), "offset", F.least(F.col("offset"), n - 1 - F.col("offset")).alias("dist"))
