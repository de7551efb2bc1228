import random

import pytest
from pyspark.sql import functions as F

from spanforge.functions import blocks as B
from spanforge.functions import cigar as C
from spanforge.functions import interval as I
from spanforge.functions import sequence as S
from spanforge.operators import events, islands, joins, models, pairing, reports

ARRAY = [("chr1", 10, 20), ("chr1", 15, 25), ("chr1", 20, 30), ("chr1", 25, 35), ("chr1", 50, 60), ("chr1", 80, 90), ("chr2", 10, 20), ("chr2", 50, 60), ("chr2", 70, 90), ("chr2", 80, 90), ("chr2", 85, 90), ("chr2", 90, 100), *[("chr3", 10, 20)] * 4]
GOLDEN = {
    (0, 1): [("chr1", 10, 11, 1), ("chr1", 15, 16, 1), ("chr1", 20, 21, 1), ("chr1", 25, 26, 1), ("chr1", 50, 51, 1), ("chr1", 80, 81, 1), ("chr2", 10, 11, 1), ("chr2", 50, 51, 1), ("chr2", 70, 71, 1), ("chr2", 80, 81, 1), ("chr2", 85, 86, 1), ("chr2", 90, 91, 1), ("chr3", 10, 11, 4)],
    (0, 2): [("chr1", 10, 16, 2), ("chr1", 20, 26, 2), ("chr1", 50, 81, 2), ("chr2", 10, 51, 2), ("chr2", 70, 81, 2), ("chr2", 85, 91, 2), ("chr3", 10, 11, 4)],
    (1, 1): [("chr1", 10, 35, 4), ("chr1", 50, 60, 1), ("chr1", 80, 90, 1), ("chr2", 10, 20, 1), ("chr2", 50, 60, 1), ("chr2", 70, 90, 3), ("chr2", 90, 100, 1), ("chr3", 10, 20, 4)],
    (1, 2): [("chr1", 10, 35, 4), ("chr1", 50, 90, 2), ("chr2", 10, 60, 2), ("chr2", 70, 90, 3), ("chr2", 90, 100, 1), ("chr3", 10, 20, 4)],
}


@pytest.mark.parametrize("mode,capacity", GOLDEN)
@pytest.mark.parametrize("width", [1 << 20, 17])
def test_bundles(spark, mode, capacity, width):
    df = spark.createDataFrame(ARRAY, "chrom string, start long, end long")
    rows = islands.bundle(df, mode, capacity, keep=["start"], width=width).orderBy("chrom", "start_min").collect()
    end = lambda r: r.start_max + 1 if mode == 0 else r.end_max
    assert [(r.chrom, r.start_min, end(r), r["count"]) for r in rows] == GOLDEN[mode, capacity]
    assert all(len(r.data) == r["count"] for r in rows)
    with pytest.raises(ValueError, match="mode"):
        islands.bundle(df, 7)


def test_overlap_join_matches_plain_join(spark):
    r = random.Random(2)
    row = lambda i, longest: (f"chr{r.randrange(3)}", s := r.randrange(3000), s + 1 + r.randrange(longest), i)
    a = spark.createDataFrame([row(i, r.choice([5, 50, 3000])) for i in range(150)], "chrom string, start long, end long, id int")
    b = spark.createDataFrame([row(i, r.choice([5, 50, 100_000])) for i in range(150)], "chrom string, start long, end long, id int")
    for width, most in ((7, 2), (100, 4), (10_000, 16)):
        for how in ("inner", "left", "left_semi", "left_anti"):
            want = sorted(map(str, joins.overlap_join_plain(a, b, how).collect()))
            assert sorted(map(str, joins.overlap_join(a, b, how, width, most).collect())) == want, (width, how)


def test_order(spark):
    df = spark.createDataFrame([("chr10", 5, 9, "a"), ("chr2", 7, 8, "b"), ("chr2", 7, 9, "c")], "chrom string, start long, end long, name string")
    assert [x.name for x in islands.in_order(df.repartition(3), "name").collect()] == ["a", "b", "c"]
    merged = islands.merge_sorted(df, df).collect()
    assert [(x.name, x.container) for x in merged] == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("c", 0), ("c", 1)]
    assert [x.name for x in islands.disorder(df.withColumn("n", -F.col("end")), "n").collect()] == ["b"]


def test_spans(spark):
    df = spark.createDataFrame([(10, 20, "+"), (10, 20, "-"), (10, 20, None)], "start long, end long, strand string")
    c = F.col
    rows = df.select(I.index(c("start"), c("end"), F.lit(12), c("strand")), I.position(c("start"), c("end"), F.lit(2), c("strand")), I.position(c("start"), c("end"), F.lit(-1), c("strand")), I.index(c("start"), c("end"), F.lit(20), c("strand")), I.is_forward(c("strand")), I.is_reverse(c("strand"))).collect()
    assert [tuple(r) for r in rows] == [(2, 12, 19, None, True, False), (7, 17, 10, None, False, True), (2, 12, 19, None, False, False)]


def test_thick_indexes(spark):
    b, t = B.literal([(10, 20), (30, 40)]), B.block(12, 35)
    plus, minus, none = spark.range(1).select(I.thick_indexes(b, t, F.lit("+")), I.thick_indexes(b, t, F.lit("-")), I.thick_indexes(b, F.lit(None).cast("struct<s:bigint,e:bigint>"), F.lit("+"))).first()
    assert tuple(plus) == (0, 2, 15, 20) and tuple(minus) == (0, 5, 18, 20) and tuple(none) == (0, None, None, 20)
    u5, u3, cds = spark.range(1).select(I.utr5(b, t, F.lit("-")), I.utr3(b, t, F.lit("-")), I.cds(b, t)).first()
    assert [tuple(x) for x in u5] == [(35, 40)] and [tuple(x) for x in u3] == [(10, 12)] and [tuple(x) for x in cds] == [(12, 20), (30, 35)]


def test_alignment(spark):
    cig, seq, qual, md = F.lit("5S10M2I3M2D4M100N15M4H"), F.lit("TTTTTACGTACGTACGGACGTACGTACGTACGTACGTACG"), F.lit("I" * 39), F.lit("3C9^GG19")
    r = spark.range(1).select(C.blocks(cig, F.lit(1000)).alias("b"), C.events(cig, F.lit(1000), md, seq, qual).alias("e"), C.clipped(cig).alias("c"), C.mapped_length(cig).alias("n"), C.query_base(cig, F.lit(1000), seq, F.lit(1014)).alias("q"), C.aligned_qualities(cig, qual).alias("aq")).first()
    assert [tuple(x) for x in r.b] == [(1000, 1019), (1119, 1134)] and tuple(r.c) == (5, 4) and r.n == 34 and r.q == "-"
    assert [(x.pos, x.ref, x.alt, x.qual, x.dist) for x in r.e] == [(1003, "C", "T", [40], 3), (1010, "-", "GG", [40, 40], 10), (1013, "GG", "-", [0], 13)]
    assert r.aq.count(-1) == 2 and len(r.aq) == 34
    one = C.encode_events(C.events(cig, F.lit(1000), md, seq, qual))
    text, back = spark.range(1).select(one, C.encode_events(C.decode_events(one))).first()
    assert text == back == "1003,C,T,40,3;1010,-,GG,40/40,10;1013,GG,-,0,13"
    with pytest.raises(Exception, match="unsupported"):
        spark.range(1).select(C.blocks(F.lit("5=3X"), F.lit(1))).collect()


def test_sequences(spark):
    rc, w, n = spark.range(1).select(S.reverse_complement(F.lit("ACGTNacgtn")), S.wrapped(F.lit("A" * 120)), S.base_counts(F.lit("acGGNX"))).first()
    assert rc == "nacgtNACGT" and w == "A" * 50 + "\n" + "A" * 50 + "\n" + "A" * 20 and n == "A,1;C,1;G,2;N,1"


def test_mates(spark):
    reads = [("q", 67, "c", 10, 50, 100), ("q", 131, "c", 100, 150, 10), ("q", 67, "c", 10, 60, 100), ("x", 67, "c", 10, 50, 100), ("y", 67, "c", 5, 9, 5), ("y", 131, "c", 5, 9, 5)]
    df = spark.createDataFrame(reads, "qname string, flag int, chrom string, start long, end long, next_start long")
    got = sorted((r.qname, r.start, r.end, r.mate1.end) for r in pairing.mates(df).collect())
    assert got == [("q", 10, 150, 50), ("y", 5, 9, 9)]


def test_strand_rules(spark):
    one = lambda s, e: [(s, e)]
    tx = spark.createDataFrame([("c", 0, 100, "+", one(0, 100)), ("c", 50, 200, "-", one(50, 200)), ("c", 300, 400, "-", one(300, 400)), ("c", 1000, 1100, "+", [(1000, 1040), (1060, 1100)]), ("c", 1000, 1100, "-", one(1000, 1100))], "chrom string, start long, end long, strand string, blocks array<struct<s:bigint,e:bigint>>")
    fr = spark.createDataFrame([(1, "c", 10, 20, one(10, 20)), (2, "c", 60, 150, one(60, 150)), (3, "c", 40, 120, one(40, 60)), (4, "c", 500, 510, one(500, 510)), (5, "c", 1010, 1090, [(1010, 1040), (1060, 1090)]), (6, "c", 1010, 1090, one(1010, 1030)), (7, "c", 60, 90, one(60, 90)), (8, "c", 310, 500, one(310, 500))], "id int, chrom string, start long, end long, blocks array<struct<s:bigint,e:bigint>>")
    got = {r.id: r.ST for r in reports.assign_strand(fr, tx, "id", width=50).collect()}
    assert got == {1: "+", 2: "-", 3: "A", 4: "U", 5: "+", 6: "A", 7: "A", 8: "-"}
    with pytest.raises(ValueError):
        reports.protocol_strand("ff", F.lit("+"))


def test_events_of_mates(spark):
    s = "fragment int, chrom string, pos long, ref string, alt string, qual int, dist long"
    a = spark.createDataFrame([(1, "c", 5, "A", "G", 30, 3), (1, "c", 6, "A", "G", 30, 3), (1, "c", 7, "A", "G", 30, 3), (1, "c", 8, "A", "C", 20, 9), (1, "c", 9, "A", "C", 9, 9)], s)
    b = spark.createDataFrame([(1, "c", 5, "A", "G", 20, 8), (1, "c", 6, "A", "T", 40, 1), (1, "c", 7, "A", "T", 30, 3), (1, "c", 8, "A", "T", 20, 2), (1, "c", 10, "A", "C", 8, 8)], s)
    got = {r.pos: (r.alt, r.qual, r.dist) for r in events.merge_mates(a, b).collect()}
    assert got == {5: ("G", 30, 8), 6: ("T", 40, 1), 8: ("C", 20, 9), 9: ("C", 9, 9), 10: ("C", 8, 8)}
    with pytest.raises(Exception, match="different reference"):
        events.merge_mates(a, b.withColumn("ref", F.lit("T"))).collect()


def test_canonical(spark):
    t = spark.createDataFrame([("G1", "T1.1", 10), ("G1", "T2.5", 30), ("G1", "T3.1", 20), ("G2", "T4.1", 5), ("G2", "T5.1", 5), (None, "T6.1", 9)], "GeneID string, TranscriptID string, Length long")
    got = {r.TranscriptID for r in models.canonical(t, spark.createDataFrame([("T3.9",), ("T1.4",)], "TranscriptID string")).collect() if r.Canonical}
    assert got == {"T3.1", "T4.1"}


def test_all_registered_queries_have_oracles():
    from spanforge.plans import catalogue

    assert set(catalogue.QUERIES) == set(catalogue.ORACLES) and len(catalogue.QUERIES) > 80


def test_features_of_one_name_are_counted_apart(spark):
    from spanforge.operators import reports

    whole, half = [(10, 20), (30, 40)], [(10, 20)]
    features = spark.createDataFrame([("G", "chrX", 10, 40, "+", whole), ("G", "chrY", 10, 40, "+", whole), ("H", "chrX", 10, 20, "+", half), ("H", "chrX", 10, 20, "+", half)], "name string, chrom string, start long, end long, strand string, blocks array<struct<s:bigint,e:bigint>>")
    kind = "chrom string, start long, end long, strand string, mate1 struct<blocks:array<struct<s:bigint,e:bigint>>>, mate2 struct<blocks:array<struct<s:bigint,e:bigint>>>"
    pairs = spark.createDataFrame([("chrX", 12, 38, "+", ([(12, 15)],), ([(31, 38)],)), ("chrX", 12, 38, "-", ([(12, 20), (30, 31)],), ([(31, 38)],)), ("chrX", 12, 29, "+", ([(12, 15)],), ([(22, 29)],))], kind)
    count = lambda **how: sorted(map(tuple, reports.feature_count(pairs, features, paired=True, **how).collect()))
    assert count() == [("G", 20, 0), ("G", 20, 3), ("H", 10, 3), ("H", 10, 3)]
    assert count(mode="coincide") == [("G", 20, 0), ("G", 20, 2), ("H", 10, 0), ("H", 10, 0)]
    assert count(mode="coincide", strand="forward") == [("G", 20, 0), ("G", 20, 1), ("H", 10, 0), ("H", 10, 0)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


READ = "part long, chrom string, flag int, start long, cigar string, seq string, qual string, tags map<string,string>"


def test_reads_are_decoded_once(spark):
    df = spark.createDataFrame([(1, "c", 0, 100, "4M1D4M", "ACGTACGT", "IIIIIIII", {"MD": "1A2^G4"})], READ)
    tagged = events.tagged(df).select(C.encode_events(C.decode_events(F.col("tags")["ME"])).alias("ME"), F.col("tags")["RC"].alias("RC"))
    assert tuple(tagged.first()) == ("101,A,C,40,1;104,G,-,0,4", "A,3;C,1;G,3;T,2")
    assert plan(events.tagged(df)).count("regexp_extract_all") < 10
    rows = events.rows(events.called(df), "part")
    assert [(r.pos, r.ref) for r in rows.orderBy("pos").collect()] == [(101, "A"), (104, "G")]
    # no filter by the size of the events, which finds them twice
    assert plan(rows).count("regexp_extract_all") == 3
    none = spark.createDataFrame([(1, "c", 0, 100, "4M", "ACGT", "IIII", {"MD": "4"})], READ)
    assert events.rows(events.called(none), "part").count() == 0


def test_few_small_rows_are_dealt_to_many_tasks(spark):
    from spanforge.plans import views

    assert views.dna(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == views.TASKS_A_CORE * spark.sparkContext.defaultParallelism


def test_isoforms_are_compared_from_bound_blocks(spark):
    df = spark.createDataFrame([([(0, 10), (20, 30), (40, 50)],)], "b array<struct<s:bigint,e:bigint>>")
    other = F.transform("b", lambda x: B.block(x["s"], x["e"] + 1))
    assert tuple(df.select(B.compare(F.col("b"), other).alias("x")).first().x) == (None, None)
    assert plan(df.select(B.compare(F.col("b"), other))).count("+ 1)") == 2


def test_large_sides_are_not_broadcast(spark, monkeypatch):
    r = random.Random(3)
    rows = [(f"chr{r.randrange(2)}", s := r.randrange(3000), s + 1 + r.randrange(60), "+-"[i % 2], i) for i in range(200)]
    a = spark.createDataFrame(rows, "chrom string, start long, end long, strand string, id int")
    named = a.withColumn("name", F.col("id").cast("string"))
    want = [sorted(map(str, x.collect())) for x in (joins.overlap_join(a, a, width=20), reports.feature_count(a, named, "forward", width=20))]
    monkeypatch.setattr(joins, "FEW_ROWS", 10)
    monkeypatch.setattr(joins, "ROWS_A_TASK", 30)
    got = joins.overlap_join(a, a, width=20), reports.feature_count(a, named, "forward", width=20)
    assert [sorted(map(str, x.collect())) for x in got] == want
    for x in got:
        text = x._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "SortMergeJoin [chrom#" in text and text.count("14), REPARTITION_BY_NUM") == 2, text


def test_pieces_of_contigs_are_not_broadcast(spark):
    from spanforge.sources import text as T

    genome = spark.createDataFrame([("c", "ACGTACGTAC" * 4)], "name string, sequence string")
    spans = spark.createDataFrame([(1, "c", "+", 3, 33)], "id int, chrom string, strand string, start long, end long")
    counts = events.genome_counts(spans.withColumn("blocks", F.array(B.block(F.col("start"), F.col("end")))), T.chunked(genome, 7), 7)
    fetched = T.fetch_chunked(spans, T.chunked(genome, 7), "id", 7)
    under = ("ACGTACGTAC" * 4)[3:33]
    assert counts.first().counts == ";".join(f"{x},{under.count(x)}" for x in "ACGT")
    assert fetched.first().sequence == under
    for df in (counts, fetched):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
