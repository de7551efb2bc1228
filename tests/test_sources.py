import gzip

import pytest
from pyspark.sql import functions as F

from spanforge import cli
from spanforge.operators import models
from spanforge.sources import sam
from spanforge.sources import text as T
from spanforge.streaming import overlaps

BED = ["chr1\t10\t60\tt1\t.\t+\t12\t55\t0,0,255\t2\t10,20,\t0,30,", "chr1\t100\t200\tt2\t3.0\t-\t100\t100\t255,0,0\t1\t100,\t0,", "chr2\t5\t9\tt3\t.\t.\t5\t5\t1,2,3\t1\t4,\t0,"]


def write(path, lines, packed=False):
    data = "".join(x + "\n" for x in lines)
    with gzip.open(path, "wt") if packed else open(path, "w") as f:
        f.write(data)
    return str(path)


def test_bed_round_trip(spark, tmp_path):
    for name, packed in (("a.bed", False), ("a.bed.gz", True)):
        df = T.read_bed(spark, write(tmp_path / name, ["# head", "", *BED], packed))
        assert sorted(r[0] for r in df.select(T.bed_line()).collect()) == sorted(BED)
        assert sorted(r[0] for r in df.select(T.bed_line(3)).collect()) == sorted("\t".join(x.split("\t")[:3]) for x in BED)
    six = T.read_bed(spark, write(tmp_path / "six.bed", ["\t".join(x.split("\t")[:6]) for x in BED]))
    assert sorted(r[0] for r in six.select(T.bed_line(6)).collect()) == sorted("\t".join(x.split("\t")[:6]) for x in BED)
    out = str(tmp_path / "out.bed.gz")
    T.write_bed(df, out)
    assert sorted(r[0] for r in T.read_bed(spark, out).select(T.bed_line()).collect()) == sorted(BED)
    with pytest.raises(ValueError):
        T.parse_bed(df, 2)


GTF = [
    "#!x", 'c\ts\tgene\t1\t90\t.\t-\t.\tgene_id "G"; gene_name "N;1"; level 2;', 'c\ts\texon\t51\t90\t.\t-\t.\tgene_id "G"; transcript_id "T"; tag "a"; tag "b"; last "gone"',
    'c\ts\texon\t1\t30\t.\t-\t.\tgene_id "G"; transcript_id "T";', 'c\ts\tCDS\t11\t30\t.\t-\t0\tgene_id "G"; transcript_id "T";',
]


def test_gtf(spark, tmp_path):
    df = T.read_gtf(spark, write(tmp_path / "a.gtf", GTF))
    a = {r.feature + str(r.start): r.attributes for r in df.collect()}
    assert a["gene0"] == {"gene_id": "G", "gene_name": "N;1", "level": "2"} and a["exon50"] == {"gene_id": "G", "transcript_id": "T", "tag": "b"}
    t = models.gtf_transcripts(df, records=True).first()
    assert (t.start, t.end, t.name, t.strand, [tuple(b) for b in t.blocks], tuple(t.thick)) == (0, 90, "T", "-", [(0, 30), (50, 90)], (10, 30))
    assert set(t.records) == {"exon", "CDS"} and t.gene["gene_name"] == "N;1"
    wide = T.attribute_table(df)
    assert wide.columns[8:] == ["gene_id", "gene_name", "level", "tag", "transcript_id"]
    bad = spark.createDataFrame([("c\ts\texon\t1\t30\t.\t-\t.\tgene_id \"G\";",)], "value string")
    with pytest.raises(Exception, match="bad GTF line"):
        T.parse_gtf(bad).collect()
    assert T.parse_gtf(bad, "null").first().chrom is None
    with pytest.raises(Exception, match="without exon"):
        models.gtf_transcripts(df.filter("feature <> 'exon'")).collect()


def test_gff_tree(spark, tmp_path):
    lines = ["c\ts\tgene\t1\t90\t.\t+\t.\tID=g", "c\ts\ttranscript\t1\t90\t.\t+\t.\tID=t;Parent=g", 'c\ts\texon\t1\t90\t.\t+\t.\tID=e;Parent=t;note="x%20y"']
    df = T.read_gff(spark, write(tmp_path / "a.gff3", lines))
    assert {(r.name, r.root, r.depth, r.n_children) for r in models.feature_tree(df).collect()} == {("g", "g", 0, 1), ("t", "g", 1, 1), ("e", "g", 2, 0)}
    assert models.gff_transcripts(df).first().parent == "g" and models.gff_genes(df).count() == 1
    with pytest.raises(Exception, match="missing parent"):
        models.feature_tree(df.filter("name <> 't'")).collect()
    assert sorted(r[0] for r in df.select(T.gff_line()).collect())[0].endswith("ID=e;Parent=t;note=x%20y")


def test_sequence_files(spark, tmp_path):
    fa = T.read_fasta(spark, write(tmp_path / "a.fa", [">one x>y", "ACGT" * 15, "AC", ">two", "GG"]))
    assert {(r.name, r.sequence) for r in fa.collect()} == {("one x>y", "ACGT" * 15 + "AC"), ("two", "GG")}
    assert fa.filter("name = 'two'").select(T.fasta_record()).first()[0] == ">two\nGG"
    records = [(f"r{i}", "ACGT"[: 1 + i % 4], "@+II"[: 1 + i % 4]) for i in range(500)]
    path = write(tmp_path / "a.fq", [y for n, s, q in records for y in (f"@{n}", s, "+", q)])
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        fq = T.read_fastq(spark, path)
        assert fq.rdd.getNumPartitions() > 0 and sorted(map(tuple, fq.collect())) == sorted(records)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert T.unique_reads(fq).count() == 4
    with pytest.raises(Exception, match="bad FASTQ"):
        T.read_fastq(spark, write(tmp_path / "b.fq", ["@a", "AC", "+", "I"])).collect()


def test_vcf(spark, tmp_path):
    line = "c\t11\trs\tA\tG,T\t30\tPASS\tSB=-;DP=4;FLAG"
    r = T.read_vcf(spark, write(tmp_path / "a.vcf", ["##x", "#CHROM", line])).first()
    assert (r.start, r.end, r.alts, r.qual, r.info, r.strand) == (10, 11, ["G", "T"], 30, {"SB": "-", "DP": "4", "FLAG": ""}, "-")


SAM = ["@HD\tVN:1.6", "r1\t99\tc\t11\t60\t5M\t=\t31\t25\tACGTA\tIIII5\tMD:Z:2C2\tNM:i:1", "r1\t147\tc\t31\t60\t2S3M\t=\t11\t-25\tACGTA\tIIIII\tMD:Z:3", "u\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*"]


def test_sam_and_bam(spark, tmp_path):
    df = sam.read_sam(spark, write(tmp_path / "a.sam", SAM))
    assert sorted(r[0] for r in df.select(sam.sam_line()).collect()) == sorted(SAM[1:])
    path = str(tmp_path / "a.bam")
    sam.write_bam(df, path, {"c": 1000})
    assert sorted(map(str, sam.read_bam(spark, path).collect())) == sorted(map(str, df.collect()))
    assert gzip.open(path).read(4) == b"BAM\x01"
    assert sam.bam_header(spark, path) == ("@HD\tVN:1.6\n", {"c": 1000})
    many = df.filter("flag = 99").crossJoin(spark.range(5000)).withColumn("qname", F.concat("qname", F.lit("."), F.col("id").cast("string"))).drop("id")
    text, refs = "@HD\tVN:1.6\n@CO\tü\n", {"z": 5, "c": 1000}
    sam.write_bam(many.repartition(3).sortWithinPartitions("qname"), str(tmp_path / "many.bam"), refs, text)
    assert sam.bam_header(spark, str(tmp_path / "many.bam")) == (text, refs) and list(sam.bam_header(spark, str(tmp_path / "many.bam"))[1]) == ["z", "c"]
    assert sorted(map(str, sam.read_bam(spark, str(tmp_path / "many.bam")).collect())) == sorted(map(str, many.collect()))
    sam.write_bam(df.limit(0), str(tmp_path / "none.bam"), refs)
    assert sam.read_bam(spark, str(tmp_path / "none.bam")).count() == 0
    rows = sam.alignments(sam.read_bam(spark, path)).orderBy("start").collect()
    assert [(r.start, r.end, r.strand) for r in rows] == [(10, 15, "+"), (30, 33, "-")]


def test_commands(spark, tmp_path):
    src = write(tmp_path / "a.sam", SAM)
    snps = write(tmp_path / "s.bed", ["c\t12\t13"])
    cli.main(["bam-getevent", src, str(tmp_path / "ev.sam")])
    tagged = {r.qname + str(r.flag): r.tags for r in sam.read_sam(spark, str(tmp_path / "ev.sam")).collect()}
    assert tagged["r199"]["ME"] == "12,C,G,40,2" and tagged["r199"]["RC"] == "A,2;C,2;T,1" and tagged["r1147"]["ME"] == ""
    cli.main(["mark-snp", str(tmp_path / "ev.sam"), snps, str(tmp_path / "ce.sam")])
    assert {r.tags["CE"] for r in sam.read_sam(spark, str(tmp_path / "ce.sam")).collect()} == {""}
    cli.main(["fam-build", src, str(tmp_path / "fam.sam")])
    assert sam.read_sam(spark, str(tmp_path / "fam.sam")).count() == 2
    bed = write(tmp_path / "t.bed", ["c\t0\t100\tt\t.\t+\t0\t0\t0\t1\t100,\t0,", "d\t0\t9\tz\t.\t-\t0\t0\t0\t1\t9,\t0,"])
    cli.main(["feature-count", src, bed, str(tmp_path / "n.csv")])
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "n.csv"), header=True).collect()} == {("t", "100", "2"), ("z", "9", "0")}
    cli.main(["determine-strand", src, str(tmp_path / "st"), "--genes", bed])
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "st/summary.tsv"), header=True, sep="\t").collect()] == [("1", "0", "0", "0")]
    cli.main(["report-mismatch-ratio", str(tmp_path / "ev.sam"), str(tmp_path / "ratio")])
    rows = {r.type: r for r in spark.read.csv(str(tmp_path / "ratio/ratio.tsv"), header=True, sep="\t").collect()}
    assert rows["C-G"]["count"] == "1" and len(rows) == 12
    cli.main(["statistic-mismatch-event", src, str(tmp_path / "stat")])
    cli.main(["gtf-information", write(tmp_path / "i.gtf", GTF), str(tmp_path / "info")])
    assert T.read_bed(spark, str(tmp_path / "info/transcripts.bed.gz")).count() == 1


def test_identified_events(spark, tmp_path):
    """Mates that overlap in 12..15: the second has a better base at 12, another one, equally good, at 14, and a deletion at 15."""
    lines = ["p\t99\tc\t11\t60\t6M\t=\t13\t9\tACTTAC\tIIIIII\tMD:Z:2G1C0A0", "p\t147\tc\t13\t60\t3M1D3M\t=\t11\t-9\tGTCGGA\tJIIIII\tMD:Z:2A0^T0A2", "q\t0\tc\t1\t60\t4M\t*\t0\t0\tAAAA\tIIII"]
    src, out = write(tmp_path / "p.sam", lines), str(tmp_path / "id.sam")
    cli.main(["identify-mismatch-events", src, out])
    tags = {(r.qname, r.flag): r.tags for r in sam.read_sam(spark, out).collect()}
    assert tags["p", 99]["ME"] == "12,G,T,40,2;14,C,A,40,1;15,A,C,40,0" and tags["p", 99]["RC"] == "A,2;C,2;G,1;T,1"
    assert tags["p", 147]["ME"] == "14,A,C,40,2;15,T,-,0,3;16,A,G,40,2" and tags["q", 0]["ME"] == "" and tags["q", 0]["RC"] == ""
    cli.main(["identify-mismatch-events", src, str(tmp_path / "pe.sam"), "--type", "paired"])
    tags = {(r.qname, r.flag): r.tags for r in sam.read_sam(spark, str(tmp_path / "pe.sam")).collect()}
    # 12: the mate's G is the reference's and better; 14: A against C with equal scores; 15: the mate's deletion is worse
    assert set(tags) == {("p", 99), ("p", 147)} and tags["p", 99]["PE"] == "15,A,C,40,0;16,A,G,40,2" and "PE" not in tags["p", 147]
    assert tags["p", 99]["PC"] == "A,4;C,2;G,2;T,1"
    fasta = write(tmp_path / "g.fa", [">c some words", "acgtacgtac", "ACGTCAAGN"])
    cli.main(["identify-mismatch-events", src, str(tmp_path / "ge.sam"), "--type", "paired", "--genome", fasta])
    tags = {(r.qname, r.flag): r.tags for r in sam.read_sam(spark, str(tmp_path / "ge.sam")).collect()}
    assert tags["p", 99]["RC"] == "A,2;C,2;G,1;T,1" and tags["p", 147]["RC"] == "A,2;C,1;G,2;N,1;T,1" and tags["p", 99]["PC"] == "A,3;C,2;G,2;N,1;T,1"
    cli.main(["identify-mismatch-events", src, str(tmp_path / "gs.sam"), "--genome", fasta])
    assert {r.qname: r.tags["RC"] for r in sam.read_sam(spark, str(tmp_path / "gs.sam")).collect()}["q"] == "A,1;C,1;G,1;T,1"


def test_stream_counts(spark, tmp_path):
    reads = spark.createDataFrame([("c", 1, 5, "+"), ("c", 3, 9, "+"), ("d", 1, 2, "-")], "chrom string, start long, end long, strand string")
    reads.write.parquet(str(tmp_path / "in"))
    features = spark.createDataFrame([("c", 0, 4, "f", "+"), ("c", 8, 12, "g", "+")], "chrom string, start long, end long, name string, strand string")
    stream = spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in"))
    q = overlaps.count(stream, features, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.name, r.Count) for r in overlaps.totals(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {("f", 2), ("g", 1)}
    seen = []
    q = overlaps.annotate(stream, features, lambda df, n: seen.append(df.select(F.col("r_name")).count())).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sum(seen) == 3


def test_quick_attributes_are_those_of_the_map(spark):
    import itertools

    from spanforge.functions.let import once

    gtf = ['gene_id "G"; transcript_id "T";', 'gene_id "G"; gene_id "H"; transcript_id "T";', 'note "a; gene_id x;"; gene_id  "G" ;', 'note "gene_id"; gene_id "G"; transcript_id "T";', 'gene_id G; transcript_id  ; x "y";', 'gene_id "G"', 'a  ;gene_id "";transcript_id "t;u";',
           'gene_id "G\x02x"; transcript_id "T\x01";', 'gene_id "G\nH"; transcript_id "T";', "", "  ;; ", 'gene_ids "G"; transcript_id "gene_id";', 'gene_id "a" ; b c; gene_id d e ;']
    gff = ["ID=a;Parent=b", "ID=a;ID=b", " ID=x ;Parent = y;Parent", "XID=a;ID", "ID;Parent=p,q;", 'ID="a b" ;Parent="c"', "ID =x;Parent=", "Parent=u;ID=v;Parent=w;", "", ";;", "Parents=1;ID=P=2"]
    gff += [";".join(x) for x in itertools.permutations(["ID=1", "Parent", " Parent= 2 ", "ID"], 3)]
    for texts, keys, read, quick in ((gtf, ("gene_id", "transcript_id"), T.gtf_attributes, T._gtf_value), (gff, ("ID", "Parent"), T.gff_attributes, T._gff_value)):
        df = once(spark.createDataFrame([(x,) for x in texts], "t string"), m=read(F.col("t")))
        for key in keys:
            rows = df.select("t", F.col("m")[key].alias("want"), F.when(T._odd(F.col("t")), F.col("m")[key]).otherwise(quick(F.col("t"), key)).alias("got"), (T._gtf_has if read is T.gtf_attributes else T._gff_has)(F.col("t"), key).alias("has")).collect()
            assert [(r.t, r.got, r.has) for r in rows] == [(r.t, r.want, r.want is not None) for r in rows]


def plain_gtf(text):
    """Attributes by the patterns of the format's description."""
    import re

    out = {}
    for item in re.findall(r"""[^ ;]+ +(?:"[^"]*"|[^";]+);""", text):
        value = re.match(r"^[^ ]+ +(.*);$", item)
        out[re.match(r"[^ ]+", item)[0]] = re.sub('^"(.*)"$', r"\1", value[1]) if value else ""
    return out


def test_gtf_attributes_match_plain_patterns(spark):
    import random

    r = random.Random(5)
    texts = ["".join(r.choice(['a', 'gene_id', ' ', '  ', '"', ';', '; ', 'v w', '"x; y"', '""']) for _ in range(r.randrange(14))) for _ in range(400)]
    got = [x.m for x in spark.createDataFrame([(t,) for t in texts], "t string").select(T.gtf_attributes(F.col("t")).alias("m")).collect()]
    assert got == [plain_gtf(t) for t in texts]


def test_models_read_lines_few_times(spark):
    lines = ["c\ts\tgene\t1\t90\t.\t+\t.\tID=g", "c\ts\ttranscript\t1\t90\t.\t+\t.\tID=t;Parent=g", "c\ts\texon\t1\t90\t.\t+\t.\tID=e;Parent=t,g", "c\ts\texon\t1\t90\t.\t+\t.\tID=e;Parent=t"]
    df = T.parse_gff(spark.createDataFrame([(x,) for x in lines], "value string"))
    tree = models.feature_tree(df)
    rows = sorted((r.name, r.root, r.depth, r.n_children) for r in tree.collect())
    assert rows == [("e", "g", 1, 0), ("e", "g", 2, 0), ("e", "g", 2, 0), ("g", "g", 0, 2), ("t", "g", 1, 2)]
    final = tree._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Scan ExistingRDD") <= 2 or final.count("ReusedExchange") >= 2, final
    # the map of attributes is not made where models need one key
    assert "map_from_entries" not in tree._jdf.queryExecution().optimizedPlan().toString().split("Generate")[-1]
