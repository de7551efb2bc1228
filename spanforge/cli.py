"""Command line: python -m spanforge.cli COMMAND ... . Inputs by extension: .bed, .gtf, .gff3, .vcf, .sam, .bam (.gz where text)."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import blocks as B
from .functions import cigar as C
from .operators import events, joins, models, pairing, reports
from .sources import sam
from .sources import text as T


def _session() -> SparkSession:
    return SparkSession.builder.appName("spanforge").getOrCreate()


def _plain(path: str) -> str:
    return path.removesuffix(".gz")


def load_reads(spark: SparkSession, path: str) -> DataFrame:
    return sam.read_bam(spark, path) if path.endswith(".bam") else sam.read_sam(spark, path)


def load_snps(spark: SparkSession, path: str | None) -> DataFrame:
    """chrom, start, end, ref, alts of a VCF, or of a BED (without alleles); none without path."""
    if path is None:
        return spark.createDataFrame([], "chrom string, start long, end long, ref string, alts array<string>")
    if _plain(path).endswith(".vcf"):
        return T.read_vcf(spark, path).select("chrom", "start", "end", "ref", "alts")
    return T.read_bed(spark, path, 3).select("chrom", "start", "end", F.lit(None).cast("string").alias("ref"), F.array().cast("array<string>").alias("alts"))


def _table(df: DataFrame, path: str) -> None:
    """CSV, or tab-separated unless the path ends in .csv; with header."""
    df.write.csv(path, header=True, sep="," if path.endswith(".csv") else "\t")


def _mask(reads: DataFrame, snps: DataFrame, source: str, drop_indels: bool) -> DataFrame:
    """reads with the tag CE: the events of the source tag without SNPs."""
    own = reads.withColumn("_id", F.xxhash64(*[F.col(c) if c != "tags" else F.col("tags")[source] for c in reads.columns]))
    listed = own.filter(F.col("tags")[source].isNotNull()).select("_id", "chrom", C.decode_events(F.col("tags")[source]).alias("events")).dropDuplicates(["_id"])
    each = listed.select("_id", "chrom", F.posexplode("events").alias("_n", "x")).select("_id", "chrom", "_n", "x", "x.pos", "x.ref", "x.alt")
    kept = events.masked(each, snps, drop_indels).groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_n", "x"))).alias("all")).select("_id", C.encode_events(F.transform("all", lambda e: e["x"])).alias("ce"))
    tags = F.map_concat(F.map_filter("tags", lambda k, _: k != "CE"), F.create_map(F.lit("CE"), F.coalesce("ce", F.lit(""))))
    return own.join(kept, "_id", "left").withColumn("tags", tags).drop("_id", "ce")


def bam_extract(a: argparse.Namespace) -> None:
    spark = _session()
    reads = sam.alignments(load_reads(spark, a.input), True)
    sam.write_sam(joins.region(reads, a.chrom, a.start, a.end), a.output)


def bam_getevent(a: argparse.Namespace) -> None:
    sam.write_sam(events.tagged(load_reads(_session(), a.input)), a.output)


def maskevent(a: argparse.Namespace) -> None:
    spark = _session()
    sam.write_sam(_mask(load_reads(spark, a.input), load_snps(spark, a.snps), "ME", True), a.output)


def mark_snp(a: argparse.Namespace) -> None:
    spark = _session()
    sam.write_sam(_mask(load_reads(spark, a.input), load_snps(spark, a.snps), a.tag, False), a.output)


def fam_build(a: argparse.Namespace) -> None:
    pairs = pairing.mates(sam.alignments(load_reads(_session(), a.input)).filter(pairing.flag(pairing.PROPER)))
    out = pairing.as_reads(pairs.sortWithinPartitions("chrom", "start", "end"))
    sam.write_sam(out, a.output)


def fam_split(a: argparse.Namespace) -> None:
    load_reads(_session(), a.input).withColumn("value", sam.sam_line()).select("value", "chrom").write.partitionBy("chrom").text(a.output)


def fam_merge(a: argparse.Namespace) -> None:
    spark = _session()
    sam.write_sam(pairing.merge(*[load_reads(spark, p) for p in a.inputs]), a.output)


def table(a: argparse.Namespace) -> None:
    spark = _session()
    read = T.read_gtf if _plain(a.input).endswith(".gtf") else T.read_gff
    _table(T.attribute_table(read(spark, a.input)), a.output)


def gff_transcript(a: argparse.Namespace) -> None:
    out = models.gff_transcripts(T.read_gff(_session(), a.input), ("transcript", "mRNA"))
    T.write_bed(out, a.output, score=None, color=None)


def gtf_information(a: argparse.Namespace) -> None:
    """Gene and transcript tables and BED files under the output folder."""
    features = T.read_gtf(_session(), a.input)
    _table(models.gene_info(features), f"{a.output}/genes.csv")
    _table(models.transcript_info(features), f"{a.output}/transcripts.csv")
    kind = F.coalesce(F.col("attributes")["gene_type"], F.lit(""))
    genes = features.filter("feature = 'gene'").withColumn("name", F.concat_ws(":", F.col("attributes")["gene_id"], F.coalesce(F.col("attributes")["gene_name"], F.lit("")), kind))
    T.write_bed(genes.orderBy("chrom", "start", "end", "name"), f"{a.output}/genes.bed.gz", 6, score=None, blocks=None, thick=None, color=None)
    T.write_bed(models.gtf_transcripts(features).orderBy("chrom", "start", "end", "name"), f"{a.output}/transcripts.bed.gz", score=None, color=None)


def append_canonical(a: argparse.Namespace) -> None:
    spark = _session()
    rows = spark.read.csv(a.input, header=True, sep="," if a.input.endswith(".csv") else "\t").withColumn("Length", F.col("Length").cast("long"))
    listed = spark.read.text(a.canonical).select(F.trim("value").alias("TranscriptID"))
    _table(models.canonical(rows, listed), a.output)


def determine_strand(a: argparse.Namespace) -> None:
    spark = _session()
    pairs = pairing.fragments(sam.alignments(load_reads(spark, a.input)))
    if a.protocol:
        out = pairs.select("qname", reports.protocol_strand(a.protocol, F.col("mate1.strand"), F.col("mate2.strand")).alias("ST"))
    else:
        own = pairs.select(F.xxhash64("qname", "chrom", "start", "end").alias("id"), "qname", "chrom", "start", "end", F.array("mate1.blocks", "mate2.blocks").alias("blocks_array")).dropDuplicates(["id"])
        out = own.join(reports.assign_strand(own, T.read_bed(spark, a.genes), "id"), "id").select("qname", "ST")
    _table(out, f"{a.output}/strand.tsv")
    _table(reports.strand_summary(out), f"{a.output}/summary.tsv")


def feature_count(a: argparse.Namespace) -> None:
    spark = _session()
    reads = sam.alignments(load_reads(spark, a.input))
    counted = pairing.fragments(reads) if a.type == "paired" else reads
    _table(reports.feature_count(counted, T.read_bed(spark, a.transcripts), a.strand, a.mode, paired=a.type == "paired"), a.output)


def identify_events(a: argparse.Namespace) -> None:
    """Mismatch events as tags of reads, or of both mates and their fragments; the reference is that of the MD tags or a FASTA's."""
    spark = _session()
    reads = sam.alignments(load_reads(spark, a.input))
    chunks = None if a.genome is None else T.chunked(T.read_fasta(spark, a.genome).withColumn("name", F.regexp_extract("name", r"^\S+", 0)), 1 << 12)
    if a.type == "paired":
        out = pairing.as_reads(events.identified_pairs(pairing.fragments(events.mapped(reads)), chunks, 1 << 12))
    else:
        out = events.identified(reads, chunks, 1 << 12)
    sam.write_sam(out, a.output)


def report_ratio(a: argparse.Namespace) -> None:
    """Mismatch ratios and co-occurrence, from the events of the CE or else the ME tag."""
    reads = load_reads(_session(), a.input).filter(F.col("tags")["ME"].isNotNull())
    tag = F.coalesce(F.col("tags")["CE"], F.col("tags")["ME"])
    own = reads.select("qname", "chrom", F.when(F.col("tags")["ST"].isNotNull(), F.col("tags")["ST"]).otherwise("+").alias("strand"), C.decode_events(tag).alias("events"), F.col("tags")["RC"].alias("rc"))
    each = own.select("qname", "strand", F.explode("events").alias("x")).select("qname", "strand", "x.ref", "x.alt", F.array_max("x.qual").alias("qual"))
    bases = own.select(F.explode(F.split("rc", ";")).alias("b")).select(F.substring("b", 1, 1).alias("base"), F.get(F.split("b", ","), F.lit(1)).cast("long").alias("n")).filter("n is not null")
    _table(reports.mismatch_ratio(each, bases, strand=F.col("strand")), f"{a.output}/ratio.tsv")
    _table(reports.mismatch_cooccurrence(each, "qname", strand=F.col("strand")), f"{a.output}/together.tsv")


def statistic(a: argparse.Namespace) -> None:
    """Histograms of events, known variants marked."""
    spark = _session()
    reads = events.called(events.mapped(load_reads(spark, a.input)), insertions=False)
    each = events.rows(reads, "qname").filter("alt <> '-'")
    cube = reports.event_cube(joins.mark_variants(each, load_snps(spark, a.snps)))
    for by in ("qual", "dist", "type"):
        _table(reports.histogram(cube, by), f"{a.output}/{by}.tsv")
    _table(reports.snp_share(cube), f"{a.output}/snp.tsv")
    _table(reports.filtered_counts(cube, a.min_distance, a.min_quality), f"{a.output}/filtered.tsv")


def extract_snp(a: argparse.Namespace) -> None:
    rows = _session().read.csv(a.input, sep="\t").selectExpr("_c1 as chrom", "cast(_c2 as long) as start", "_c4 as name", "_c6 as strand", "_c7 as ref_ncbi", "_c8 as ref_ucsc", "_c9 as observed", "_c11 as class")
    out = models.ucsc_single_base(rows).withColumn("name", F.concat("ref", F.lit("-"), "alt"))
    T.write_bed(out, a.output, 6, score=None, blocks=None, thick=None, color=None)


def fastq_uniq(a: argparse.Namespace) -> None:
    T.write_lines(T.unique_reads(T.read_fastq(_session(), a.input)), T.fastq_record(), a.output)


def fasta_fetch(a: argparse.Namespace) -> None:
    spark = _session()
    ranges = T.read_bed(spark, a.regions)
    out = T.fetch(ranges, T.read_fasta(spark, a.input), "blocks")
    T.write_lines(out.withColumn("name", F.coalesce("name", F.concat("chrom", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))), T.fasta_record(), a.output)


def genes_bed(a: argparse.Namespace) -> None:
    out = models.gtf_genes(T.read_gtf(_session(), a.input))
    T.write_bed(out.withColumn("thick", F.lit(None).cast("struct<s:bigint,e:bigint>")).withColumn("length", B.length(F.col("blocks"))), a.output, score=None, color=None)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanforge", description=__doc__)
    sub = p.add_subparsers(required=True)

    def add(name: str, run, *arguments: str, **options) -> argparse.ArgumentParser:
        s = sub.add_parser(name, help=run.__doc__)
        for x in arguments:
            s.add_argument(x)
        for k, v in options.items():
            s.add_argument(f"--{k.replace('_', '-')}", **v)
        s.set_defaults(run=run)
        return s

    number = {"type": int}
    add("bam-extract", bam_extract, "input", "output", chrom={"required": True}, start=number, end=number)
    add("bam-getevent", bam_getevent, "input", "output")
    add("bam-maskevent", maskevent, "input", "snps", "output")
    add("fam-maskevent", maskevent, "input", "snps", "output")
    add("mark-snp", mark_snp, "input", "snps", "output", tag={"default": "ME"})
    add("annotate-snp", mark_snp, "input", "snps", "output", tag={"default": "ME"})
    add("fam-build", fam_build, "input", "output")
    add("fam-split", fam_split, "input", "output")
    add("fam-merge", fam_merge, "output").add_argument("inputs", nargs="+")
    add("gtf-table", table, "input", "output")
    add("gff-table", table, "input", "output")
    add("gff-transcript", gff_transcript, "input", "output")
    add("gtf-genes", genes_bed, "input", "output")
    add("gtf-information", gtf_information, "input", "output")
    add("append-canonical", append_canonical, "input", "canonical", "output")
    add("determine-strand", determine_strand, "input", "output", protocol={"choices": ["fr", "rf"]}, genes={})
    add("feature-count", feature_count, "input", "transcripts", "output", strand={"choices": ["forward", "reverse"]}, mode={"choices": ["overlap", "coincide"], "default": "overlap"}, type={"choices": ["single", "paired"], "default": "single"})
    add("identify-mismatch-events", identify_events, "input", "output", genome={}, type={"choices": ["single", "paired"], "default": "single"})
    add("report-mismatch-ratio", report_ratio, "input", "output")
    add("statistic-mismatch-event", statistic, "input", "output", snps={}, min_distance={"type": int, "default": 5}, min_quality={"type": int, "default": 20})
    add("extract-snp", extract_snp, "input", "output")
    add("fastq-uniq", fastq_uniq, "input", "output")
    add("fasta-fetch", fasta_fetch, "input", "regions", "output")
    return p


def main(argv: Sequence[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(a)


if __name__ == "__main__":
    main()
