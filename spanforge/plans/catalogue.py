"""Registered queries over the driver tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import cigar as C
from ..functions import interval as I
from ..functions import sequence as S
from ..functions.let import exploded
from ..operators import events as E
from ..operators import islands, joins, models, pairing, reports
from ..sources import sam
from ..sources import text as T
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, *ctes: str) -> Callable:
    """Register a query under the function's name; sql: a DuckDB query over the named common table expressions."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = ("WITH " + ", ".join(ctes) + " " if ctes else "") + sql
        return f

    return add


c = F.col
OVER = 'r.chrom = f.chrom AND r."start" < f."end" AND r."end" > f."start"'

# joins and counting


@query(f'SELECT f.name, f."end" - f."start" AS "Length", CAST(count(r.chrom) AS BIGINT) AS "Count" FROM features f LEFT JOIN reads r ON {OVER} GROUP BY ALL', V.READS, V.FEATURES)
def flagship_feature_count(spark, d):
    """Reads for every feature that they overlap, features without reads too."""
    return reports.feature_count(V.reads(spark, d), V.features(spark, d), width=400)


@query(f'SELECT f.name, f."end" - f."start" AS "Length", CAST(count(r.chrom) AS BIGINT) AS "Count" FROM features f LEFT JOIN reads r ON {OVER} AND r.strand = f.strand GROUP BY ALL', V.READS, V.FEATURES)
def feature_count_stranded(spark, d):
    return reports.feature_count(V.reads(spark, d), V.features(spark, d), "forward", width=400)


@query("""SELECT t.name, (SELECT CAST(sum(x.e - x.s) AS BIGINT) FROM exons x WHERE x.part = t.part) AS "Length", CAST(count(f.id) AS BIGINT) AS "Count" FROM transcripts t LEFT JOIN fragments f ON t.chrom = f.chrom AND t."start" < f."end" AND t."end" > f."start"
 AND len(list_filter(t.b, lambda x: x.s <= f."start" AND x.e = f."start" + f.n)) > 0 AND len(list_filter(t.b, lambda x: x.s = f."start" + 100 AND x.e >= f."start" + 100 + f.n)) > 0 GROUP BY ALL""", V.TRANSCRIPTS, V.FRAGMENTS)
def feature_count_coincide(spark, d):
    return reports.feature_count(V.fragments(spark, d), V.transcripts(spark, d), mode="coincide", width=2000)


@query("""SELECT t.name, (SELECT CAST(sum(x.e - x.s) AS BIGINT) FROM exons x WHERE x.part = t.part) AS "Length", CAST(count(f.id) AS BIGINT) AS "Count" FROM transcripts t LEFT JOIN fragments f ON t.chrom = f.chrom AND t."start" < f."end" AND t."end" > f."start"
 AND len(list_filter(t.b, lambda x: x.s <= f."start" AND x.e >= f."start" + f.n)) > 0 AND len(list_filter(t.b, lambda x: x.s <= f."start" + 100 AND x.e >= f."start" + 100 + f.n)) > 0 GROUP BY ALL""", V.TRANSCRIPTS, V.FRAGMENTS)
def feature_count_paired(spark, d):
    """Fragments of which each mate by itself coincides."""
    mate = lambda i: F.struct(F.array(F.get("blocks", F.lit(i))).alias("blocks"))
    pairs = V.fragments(spark, d).withColumns({"mate1": mate(0), "mate2": mate(1)}).drop("blocks")
    return reports.feature_count(pairs, V.transcripts(spark, d), mode="coincide", width=2000, paired=True)


JOINED = f'SELECT r.chrom, r."start" AS r_start, r."end" AS r_end, r.strand, f.name FROM reads r JOIN features f ON {OVER}'


@query(JOINED, V.READS, V.FEATURES)
def overlap_join(spark, d):
    """Rows meet in the bins of their coordinates."""
    out = joins.overlap_join(V.reads(spark, d), V.features(spark, d), width=1000, prefix="f_")
    return out.select("chrom", c("start").alias("r_start"), c("end").alias("r_end"), "strand", c("f_name").alias("name"))


@query(JOINED, V.READS, V.FEATURES)
def overlap_join_binned(spark, d):
    out = joins.overlap_join(V.reads(spark, d), V.features(spark, d), width=400, prefix="f_")
    return out.select("chrom", c("start").alias("r_start"), c("end").alias("r_end"), "strand", c("f_name").alias("name"))


@query('SELECT f.id, t.name FROM fragments f LEFT JOIN transcripts t ON t.chrom = f.chrom AND t."start" < f."end" AND t."end" > f."start"', V.TRANSCRIPTS, V.FRAGMENTS)
def overlap_left_zero(spark, d):
    out = joins.overlap_join(V.fragments(spark, d), V.transcripts(spark, d), "left", width=500)
    return out.select("id", c("r_name").alias("name"))


@query('SELECT f.id, (EXISTS (SELECT 1 FROM transcripts t WHERE t.chrom = f.chrom AND t."start" < f."end" AND t."end" > f."start")) AS hit FROM fragments f', V.TRANSCRIPTS, V.FRAGMENTS)
def overlap_semi_anti(spark, d):
    f, t = V.fragments(spark, d), V.transcripts(spark, d)
    semi = joins.overlap_join(f, t, "left_semi", width=500).select("id", F.lit(True).alias("hit"))
    return semi.unionByName(joins.overlap_join(f, t, "left_anti", width=500).select("id", F.lit(False).alias("hit")))


@query("SELECT f.id, CAST(count(t.name) AS BIGINT) AS n, coalesce(string_agg(t.name, ',' ORDER BY t.name), '') AS names FROM fragments f LEFT JOIN transcripts t ON t.chrom = f.chrom AND t.\"start\" < f.\"end\" AND t.\"end\" > f.\"start\" GROUP BY f.id", V.TRANSCRIPTS, V.FRAGMENTS)
def overlap_nested(spark, d):
    """All hits of a fragment in one row."""
    out = joins.overlap_join(V.fragments(spark, d), V.transcripts(spark, d), "left", width=500)
    return out.groupBy("id").agg(F.count("r_name").alias("n"), F.array_join(F.array_sort(F.collect_list("r_name")), ",").alias("names"))


@query("""SELECT chrom, "start", "end", name FROM features WHERE chrom = 'chr2' AND "start" < 60000 AND "end" > 20000""", V.FEATURES)
def region_fetch(spark, d):
    return joins.region(V.features(spark, d), "chr2", 20000, 60000).select("chrom", "start", "end", "name")


STRAND = """hits AS (SELECT f.id, t.strand, t."start" <= f."start" AND f."end" <= t."end" AS spans, len(list_filter(t.b, lambda x: x.s <= f."start" AND x.e = f."start" + f.n)) > 0 AND len(list_filter(t.b, lambda x: x.s = f."start" + 100 AND x.e >= f."start" + 100 + f.n)) > 0 AS fits
 FROM fragments f JOIN transcripts t ON t.chrom = f.chrom AND t."start" < f."end" AND t."end" > f."start"),
 sums AS (SELECT id, count(DISTINCT strand) AS na, min(strand) AS sa, count(DISTINCT strand) FILTER (spans) AS ns, min(strand) FILTER (spans) AS ss, count(DISTINCT strand) FILTER (spans AND fits) AS nc, min(strand) FILTER (spans AND fits) AS sc FROM hits GROUP BY id),
 assigned AS (SELECT f.id, CASE WHEN na IS NULL THEN 'U' WHEN na = 1 THEN sa WHEN ns = 0 THEN 'A' WHEN ns = 1 THEN ss WHEN nc = 1 THEN sc ELSE 'A' END AS "ST" FROM fragments f LEFT JOIN sums USING (id))"""


@query("SELECT * FROM assigned", V.TRANSCRIPTS, V.FRAGMENTS, STRAND)
def strand_assign(spark, d):
    return reports.assign_strand(V.fragments(spark, d), V.transcripts(spark, d), "id", width=500)


@query("""SELECT count(*) FILTER ("ST" = '+') AS plus, count(*) FILTER ("ST" = '-') AS minus, count(*) FILTER ("ST" = 'A') AS ambiguous, count(*) FILTER ("ST" = 'U') AS unknown FROM assigned""", V.TRANSCRIPTS, V.FRAGMENTS, STRAND)
def strand_summary(spark, d):
    return reports.strand_summary(strand_assign(spark, d))


@query("SELECT id, strand AS fr, CASE WHEN strand = '+' THEN '-' ELSE '+' END AS rf FROM fragments", V.FRAGMENTS)
def strand_protocol(spark, d):
    return V.fragments(spark, d).select("id", reports.protocol_strand("fr", c("strand")).alias("fr"), reports.protocol_strand("rf", c("strand")).alias("rf"))


@query('SELECT DISTINCT f.id FROM fragments f JOIN transcripts t ON t.chrom = f.chrom AND t."start" < f."end" AND t."end" > f."start" AND len(list_filter(t.b, lambda x: x.s <= f."start" AND x.e = f."start" + f.n)) > 0 AND len(list_filter(t.b, lambda x: x.s = f."start" + 100 AND x.e >= f."start" + 100 + f.n)) > 0', V.TRANSCRIPTS, V.FRAGMENTS)
def coincided_fragments(spark, d):
    return reports.filter_coincided(V.fragments(spark, d), V.transcripts(spark, d), "id", width=500).select("id")


# spans: each feature against a made-up partner

PARTNER = """pairs AS (SELECT *, "start" + (size * 7) % 300 - 150 AS s2, "start" + (size * 7) % 300 - 150 + 100 AS e2 FROM features)"""


def _pairs(spark, d):
    return V.features(spark, d).withColumn("s2", c("start") + (c("size") * 7) % 300 - 150).withColumn("e2", c("s2") + 100)


@query('SELECT name, greatest("start", s2) - least("end", e2) AS distance FROM pairs', V.FEATURES, PARTNER)
def iv_distance(spark, d):
    return _pairs(spark, d).select("name", I.distance(c("start"), c("end"), c("s2"), c("e2")).alias("distance"))


@query('SELECT name, "start" < e2 AND "end" > s2 AS overlap, greatest("start", s2) = least("end", e2) AS adjacent, "start" > e2 OR "end" < s2 AS away, "start" <= e2 AND "end" >= s2 AS contact, "start" <= s2 AND "end" >= e2 AS contain FROM pairs', V.FEATURES, PARTNER)
def iv_relations(spark, d):
    x = (c("start"), c("end"), c("s2"), c("e2"))
    return _pairs(spark, d).select("name", I.overlaps(*x).alias("overlap"), I.adjacent(*x).alias("adjacent"), I.away(*x).alias("away"), I.contacts(*x).alias("contact"), I.contains(*x).alias("contain"))


@query("""SELECT name, CASE WHEN "start" <= s2 AND s2 < "end" THEN CASE WHEN strand = '-' THEN "end" - s2 - 1 ELSE s2 - "start" END END AS idx FROM pairs""", V.FEATURES, PARTNER)
def iv_index(spark, d):
    return _pairs(spark, d).select("name", I.index(c("start"), c("end"), c("s2"), c("strand")).alias("idx"))


@query("""SELECT name, CASE WHEN i >= -n AND i < n THEN CASE WHEN strand = '-' THEN "end" - 1 - (CASE WHEN i < 0 THEN i + n ELSE i END) ELSE "start" + (CASE WHEN i < 0 THEN i + n ELSE i END) END END AS pos FROM (SELECT *, "end" - "start" AS n, size * 13 % 400 - 200 AS i FROM features)""", V.FEATURES)
def iv_position(spark, d):
    return V.features(spark, d).select("name", I.position(c("start"), c("end"), c("size") * 13 % 400 - 200, c("strand")).alias("pos"))


@query('SELECT name, CASE WHEN "start" - 900 >= 0 THEN "start" - 900 END AS s, CASE WHEN "start" - 900 >= 0 THEN "end" - 900 END AS e FROM features', V.FEATURES)
def iv_shift(spark, d):
    return V.features(spark, d).withColumn("x", I.shift(c("start"), c("end"), -900)).select("name", c("x.start").alias("s"), c("x.end").alias("e"))


@query('SELECT name, CAST(row_number() OVER (ORDER BY chrom, "start", "end", name) AS BIGINT) AS place FROM features', V.FEATURES)
def iv_sort(spark, d):
    return islands.placed(V.features(spark, d), "name").select("name", "place")


@query("""SELECT name, CASE WHEN "start" < e2 AND "end" > s2 THEN CAST(greatest("start", s2) AS VARCHAR) || '-' || CAST(least("end", e2) AS VARCHAR) END AS both,
 concat_ws(';', CASE WHEN "start" < least("end", s2) THEN CAST("start" AS VARCHAR) || '-' || CAST(least("end", s2) AS VARCHAR) END, CASE WHEN greatest("start", e2) < "end" THEN CAST(greatest("start", e2) AS VARCHAR) || '-' || CAST("end" AS VARCHAR) END) AS rest FROM pairs""", V.FEATURES, PARTNER)
def iv_set_operations(spark, d):
    x = (c("start"), c("end"), c("s2"), c("e2"))
    both = I.intersect(*x)
    return _pairs(spark, d).select("name", F.when(both.isNotNull(), F.concat_ws("-", both["start"].cast("string"), both["end"].cast("string"))).alias("both"), B.text(I.subtract(*x)).alias("rest"))


# block algebra


def _tx(spark, d) -> DataFrame:
    return V.transcripts(spark, d)


@query("SELECT 'T' || CAST(part AS VARCHAR) AS name, CAST(sum(e - s) AS BIGINT) AS length FROM exons GROUP BY part", V.EXONS)
def bk_length(spark, d):
    return _tx(spark, d).select("name", B.length(c("blocks")).alias("length"))


@query("SELECT name, coalesce(string_agg(CAST(e AS VARCHAR) || '-' || CAST(nx AS VARCHAR), ';' ORDER BY k) FILTER (nx IS NOT NULL), '') AS gaps FROM (SELECT 'T' || CAST(part AS VARCHAR) AS name, k, e, lead(s) OVER (PARTITION BY part ORDER BY k) AS nx FROM exons) GROUP BY name", V.EXONS)
def bk_gaps(spark, d):
    return _tx(spark, d).select("name", B.text(B.gaps(c("blocks"))).alias("gaps"))


def _islands(source: str, gap: int) -> str:
    return f"""SELECT 'T' || CAST(part AS VARCHAR) AS name, string_agg(CAST(s AS VARCHAR) || '-' || CAST(e AS VARCHAR), ';' ORDER BY s) AS blocks FROM (SELECT part, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY part ORDER BY s, e) AS island FROM
 (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY part ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap} THEN 0 ELSE 1 END AS new FROM ({source}))) GROUP BY part, island) GROUP BY part"""


@query(_islands("SELECT part, s, e FROM exons", 0), V.EXONS)
def bk_suture_g0(spark, d):
    return _tx(spark, d).select("name", B.text(B.suture(c("blocks"))).alias("blocks"))


@query(_islands("SELECT part, s, e FROM exons", 70), V.EXONS)
def bk_suture_g70(spark, d):
    return _tx(spark, d).select("name", B.text(B.suture(c("blocks"), 70)).alias("blocks"))


@query(_islands("SELECT part, s, e FROM exons UNION ALL SELECT part, s + 30, e + 30 FROM exons", 0), V.EXONS)
def bk_fusion(spark, d):
    return _tx(spark, d).select("name", B.text(B.fusion(c("blocks"), B.move(c("blocks"), 30))).alias("blocks"))


@query("""SELECT 'T' || CAST(part AS VARCHAR) AS name, bool_and(q > 3) AS inside, bool_and(EXISTS (SELECT 1 FROM exons y WHERE y.part = x.part AND y.s <= x.s + 5 AND y.e >= x.e + 5)) AS moved FROM exons x GROUP BY part""", V.EXONS)
def bk_contain(spark, d):
    """Whether blocks hold their own blocks, made smaller where they are long enough and else larger; and their shifted blocks."""
    inner = F.transform(c("blocks"), lambda x: F.when(x["e"] - x["s"] > 3, B.block(x["s"] + 1, x["e"] - 1)).otherwise(B.block(x["s"], x["e"] + 1)))
    return _tx(spark, d).select("name", B.contains(c("blocks"), inner).alias("inside"), B.contains(c("blocks"), B.move(c("blocks"), 5)).alias("moved"))


@query("""SELECT name, CASE WHEN n = 1 THEN len(list_filter(b, lambda x: x.s <= q[1].s AND x.e >= q[1].e)) > 0 ELSE len(list_filter(b, lambda x: x.s <= q[1].s AND x.e = q[1].e)) > 0 AND len(list_filter(b, lambda x: x.s = q[n].s AND x.e >= q[n].e)) > 0
 AND len(list_filter(q[2:n - 1], lambda y: NOT list_contains(b, y))) = 0 END AS coincides FROM (SELECT *, len(q) AS n FROM (SELECT name, b, list_transform(list_filter(b, lambda x: (x.s // 100) % 3 <> 1), lambda x: {'s': x.s, 'e': x.e + CASE WHEN part % 3 = 0 THEN 1 ELSE 0 END}) AS q FROM transcripts) WHERE len(q) > 0)""", V.TRANSCRIPTS)
def bk_coincide(spark, d):
    """Against a query that skips blocks and, for a third of the transcripts, ends every block one base late."""
    late = F.when(c("part") % 3 == 0, 1).otherwise(0)
    q = F.transform(F.filter(c("blocks"), lambda x: F.floor(x["s"] / 100) % 3 != 1), lambda x: B.block(x["s"], x["e"] + late))
    return _tx(spark, d).withColumn("q", q).filter(F.size("q") > 0).select("name", B.coincides(c("blocks"), c("q")).alias("coincides"))


CLIPPED = "SELECT 'T' || CAST(part AS VARCHAR) AS name, coalesce(string_agg(CAST(greatest(s, part * 1000 + 150) AS VARCHAR) || '-' || CAST(least(e, part * 1000 + 920) AS VARCHAR), ';' ORDER BY s) FILTER (greatest(s, part * 1000 + 150) < least(e, part * 1000 + 920)), '') AS blocks FROM exons GROUP BY part"


@query(CLIPPED, V.EXONS)
def bk_clip(spark, d):
    return _tx(spark, d).select("name", B.text(B.clip(c("blocks"), c("part") * 1000 + 150, c("part") * 1000 + 920)).alias("blocks"))


@query(_islands("SELECT part, greatest(s, part * 1000 - 40) AS s, least(e, part * 1000 + 3500) AS e FROM exons WHERE s < part * 1000 + 3500 UNION ALL SELECT part, part * 1000 - 40, min(s) FROM exons GROUP BY part UNION ALL SELECT part, max(e), part * 1000 + 3500 FROM exons GROUP BY part HAVING max(e) < part * 1000 + 3500", 0).replace("- 40", "+ CASE WHEN part = 0 THEN 0 ELSE -40 END"), V.EXONS)
def bk_clip_extend(spark, d):
    return _tx(spark, d).select("name", B.text(B.clip_extend(c("blocks"), F.greatest(c("part") * 1000 - 40, F.lit(0)), c("part") * 1000 + 3500)).alias("blocks"))


@query("""SELECT 'T' || CAST(part AS VARCHAR) AS name, CASE WHEN bool_or(s <= p AND p < e) THEN CAST(sum(greatest(least(p, e) - s, 0)) AS BIGINT) END AS idx, CASE WHEN bool_or(s <= p AND p < e) THEN CAST(sum(e - s) - 1 - sum(greatest(least(p, e) - s, 0)) AS BIGINT) END AS back FROM (SELECT *, part * 1000 + (part * 37) % 900 AS p FROM exons) GROUP BY part""", V.EXONS)
def bk_index(spark, d):
    p = c("part") * 1000 + (c("part") * 37) % 900
    return _tx(spark, d).select("name", B.index(c("blocks"), p).alias("idx"), B.index(c("blocks"), p, True).alias("back"))


@query("""SELECT 'T' || CAST(part AS VARCHAR) AS name, CAST(max(s + i - before) FILTER (i >= before AND i < before + e - s) AS BIGINT) AS pos FROM (SELECT *, sum(e - s) OVER (PARTITION BY part ORDER BY k) - (e - s) AS before, CASE WHEN part % 2 = 0 THEN (part * 7) % 600 ELSE (part * 7) % 600 - 300 + CASE WHEN (part * 7) % 600 < 300 THEN sum(e - s) OVER (PARTITION BY part) ELSE 0 END END AS i FROM exons) GROUP BY part""", V.EXONS)
def bk_position(spark, d):
    i = F.when(c("part") % 2 == 0, (c("part") * 7) % 600).otherwise((c("part") * 7) % 600 - 300)
    return _tx(spark, d).select("name", B.position(c("blocks"), i).alias("pos"))


@query("SELECT 'T' || CAST(part AS VARCHAR) AS name, string_agg(CAST(s - 7 AS VARCHAR) || '-' || CAST(e - 7 AS VARCHAR), ';' ORDER BY s) AS blocks FROM exons WHERE part > 0 GROUP BY part", V.EXONS)
def bk_move(spark, d):
    return _tx(spark, d).filter("part > 0").select("name", B.text(B.move(c("blocks"), -7)).alias("blocks"))


@query("""SELECT 'T' || CAST(part AS VARCHAR) AS name, count(*) = 1 OR max(q) + 51 <= 100 AS valid, bool_or(s <= part * 1000 + 105 AND part * 1000 + 105 < e) AS included, TRUE AS sorted, count(*) = 1 AS sorted_back FROM exons GROUP BY part""", V.EXONS)
def bk_valid(spark, d):
    """Validity of blocks made 51 bases longer (only the last may then touch no other), membership, order."""
    longer = F.transform(c("blocks"), lambda x: B.block(x["s"], x["e"] + 51))
    top = F.array_max(F.transform(c("blocks"), lambda x: x["e"] - x["s"]))
    fair = F.when(F.size("blocks") == 1, longer).otherwise(F.array(B.block(0, top + 51), B.block(100, 200)))
    return _tx(spark, d).select("name", B.is_valid(fair).alias("valid"), B.includes(c("blocks"), c("part") * 1000 + 105).alias("included"), B.is_sorted(c("blocks")).alias("sorted"), B.is_sorted(F.reverse("blocks")).alias("sorted_back"))


@query("""SELECT name, category, subcategory FROM (SELECT name, CASE WHEN n = 1 THEN CAST("start" + shift < "end" AS INTEGER) WHEN same THEN 2 END AS category, CASE WHEN n > 1 AND same THEN CASE WHEN shift > 50 AND ext > 50 THEN 3 WHEN shift > 50 THEN 2 WHEN ext > 50 THEN 1 ELSE 0 END END AS subcategory
 FROM (SELECT *, len(b) AS n, CASE WHEN part % 3 = 0 AND len(b) > 1 THEN b[1].e - b[1].s - 1 ELSE 0 END AS shift, part % 90 AS ext, part % 7 <> 0 AS same FROM transcripts))""", V.TRANSCRIPTS)
def iso_compare(spark, d):
    """Against a query with other ends and, for every seventh, another intron."""
    b = c("blocks")
    n = F.size("blocks")
    shift = F.when((c("part") % 3 == 0) & (n > 1), B.first(b)["e"] - B.first(b)["s"] - 1).otherwise(0)
    other = F.transform(b, lambda x, i: B.block(x["s"] + F.when(i == 0, shift).otherwise(0), x["e"] + F.when(i == n - 1, c("part") % 90).otherwise(F.when((c("part") % 7 == 0) & (i == 0), 1).otherwise(0))))
    return _tx(spark, d).withColumn("x", B.compare(b, other)).select("name", c("x.category").alias("category"), c("x.subcategory").alias("subcategory"))


# transcripts' parts

INDEXES = """idx AS (SELECT t.name, t.part, t.strand, n, CASE WHEN ts IS NOT NULL THEN CASE WHEN strand = '-' THEN n - hi ELSE lo END END AS i1, CASE WHEN ts IS NOT NULL THEN CASE WHEN strand = '-' THEN n - lo ELSE hi END END AS i2
 FROM transcripts t JOIN (SELECT part, CAST(sum(e - s) AS BIGINT) AS n, CAST(0 AS BIGINT) AS lo, CAST(sum(e - s) - arg_max(e - s, k) + 1 AS BIGINT) AS hi FROM exons GROUP BY part) x USING (part))"""


@query("SELECT name, CAST(0 AS BIGINT) AS i0, i1, i2, n AS i3 FROM idx", V.TRANSCRIPTS, INDEXES)
def thick_indexes(spark, d):
    return _tx(spark, d).withColumn("x", I.thick_indexes(c("blocks"), c("thick"), c("strand"))).select("name", "x.*")


@query("SELECT name, i1 AS utr5, i2 - i1 AS cds, n - i2 AS utr3 FROM idx", V.TRANSCRIPTS, INDEXES)
def tx_regions(spark, d):
    return _tx(spark, d).withColumn("x", I.part_lengths(c("blocks"), c("thick"), c("strand"))).select("name", "x.*")


@query("""SELECT name, i1 IS NOT NULL AS coding, coalesce(i1, 0) AS len5, coalesce(n - i2, 0) AS len3 FROM idx""", V.TRANSCRIPTS, INDEXES)
def tx_region_blocks(spark, d):
    size = lambda x: F.coalesce(B.length(x), F.lit(0))
    return _tx(spark, d).select("name", c("thick").isNotNull().alias("coding"), size(I.utr5(c("blocks"), c("thick"), c("strand"))).alias("len5"), size(I.utr3(c("blocks"), c("thick"), c("strand"))).alias("len3"))


AT = """pt AS (SELECT idx.*, CASE WHEN strand = '-' THEN n - 1 ELSE 0 END AS p FROM idx)"""


@query("SELECT name, p AS tss, p - i1 AS cds_start, p - i2 AS cds_end, p - n AS tes FROM (SELECT name, i1, i2, n, CASE WHEN i1 IS NOT NULL THEN CAST(p AS BIGINT) END AS p FROM pt)", V.TRANSCRIPTS, INDEXES, AT)
def landmark_distances(spark, d):
    p = B.first(c("blocks"))["s"]
    return _tx(spark, d).withColumn("x", I.landmark_distances(c("blocks"), c("thick"), c("strand"), p)).select("name", "x.*")


@query("SELECT name, round(CASE WHEN p < i1 THEN (p + 0.5) / i1 WHEN p < i2 THEN (p - i1 + 0.5) / (i2 - i1) + 1 WHEN p < n AND i2 IS NOT NULL THEN (p - i2 + 0.5) / (n - i2) + 2 END, 9) AS ratio FROM pt", V.TRANSCRIPTS, INDEXES, AT)
def metagene_ratio(spark, d):
    p = B.first(c("blocks"))["s"]
    x = I.metagene_ratio(c("blocks"), c("thick"), c("strand"), p)
    return _tx(spark, d).select("name", F.round(F.when(c("thick").isNotNull(), x), 9).alias("ratio"))


# bundles and order


def _bundle_sql(new: str) -> str:
    return f"""SELECT chrom, min("start") AS start_min, max("start") AS start_max, min("end") AS end_min, max("end") AS end_max, count(*) AS count FROM (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY "start", "end") AS i FROM
 (SELECT *, CASE WHEN {new} THEN 0 ELSE 1 END AS new FROM (SELECT *, max("start") OVER w AS ms, max("end") OVER w AS me FROM reads WINDOW w AS (PARTITION BY chrom ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))) GROUP BY chrom, i"""


@query(_bundle_sql('"start" <= ms'), V.READS)
def bundle_start(spark, d):
    return islands.bundle(V.reads(spark, d), islands.START_ONLY, width=2000).drop("mode")


@query(_bundle_sql('"start" < me'), V.READS)
def bundle_span(spark, d):
    return islands.bundle(V.reads(spark, d), width=2000).drop("mode")


@query(_bundle_sql('"start" < me + 20'), V.READS)
def bundle_spacing(spark, d):
    return islands.bundle(V.reads(spark, d), min_spacing=20, width=2000).drop("mode")


CAPACITY = """SELECT chrom, min(s) AS start_min, max(s) AS start_max, min(e) AS end_min, max(e) AS end_max, count(*) AS count FROM (
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY s, e) AS n FROM base),
walk AS (SELECT chrom, n, s, e, e AS me, 1 AS held, 1 AS bundle FROM o WHERE n = 1
 UNION ALL SELECT o.chrom, o.n, o.s, o.e, CASE WHEN w.held >= 5 AND o.s >= w.me THEN o.e ELSE greatest(w.me, o.e) END, CASE WHEN w.held >= 5 AND o.s >= w.me THEN 1 ELSE w.held + 1 END, CASE WHEN w.held >= 5 AND o.s >= w.me THEN w.bundle + 1 ELSE w.bundle END FROM walk w JOIN o ON o.chrom = w.chrom AND o.n = w.n + 1)
SELECT * FROM walk) GROUP BY chrom, bundle"""


@query(CAPACITY, V.FEATURES, """base AS (SELECT chrom, "start" AS s, "end" AS e FROM features)""")
def bundle_capacity(spark, d):
    return islands.bundle(V.features(spark, d), min_capacity=5, width=5000).drop("mode")


@query("""SELECT chrom, min("start") AS start_min, CAST(count(*) AS BIGINT) AS count, string_agg(name, ',' ORDER BY "start", "end", name) AS names FROM numbered GROUP BY chrom, island""", V.FEATURES,
       """marked AS (SELECT *, CASE WHEN "start" < max("end") OVER (PARTITION BY chrom ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM features WHERE size < 30)""",
       """numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM marked)""")
def bundle_keep(spark, d):
    """Bundles with their members."""
    out = islands.bundle(V.features(spark, d).filter("size < 30"), keep=["name"], width=5000)
    return out.select("chrom", "start_min", "count", F.array_join(F.transform("data", lambda x: x["name"]), ",").alias("names"))


PAIRED_BLOCKS = """two AS (SELECT part, size, size - 3 AS a, size - 3 + part % 4 AS b, part % 60 AS c, part % 60 + part % 5 AS d FROM dna)"""


def _two_blocks(spark, d) -> DataFrame:
    """Two blocks for each part, some of them invalid or out of order."""
    low, later = c("size") - 3, c("part") % 60
    return V.dna(spark, d).withColumn("blocks", F.array(B.block(low, low + c("part") % 4), B.block(later, later + c("part") % 5)))


@query("""SELECT part, a >= 0 AND a < b AND c >= b AND c < d AS valid, a < c OR (a = c AND b <= d) AS sorted, CASE WHEN a < c OR (a = c AND b <= d) THEN a || '-' || b || ';' || c || '-' || d ELSE c || '-' || d || ';' || a || '-' || b END AS in_order FROM two""", V.DNA, PAIRED_BLOCKS)
def bk_checked(spark, d):
    """Whether blocks are valid and sorted, and the sorted blocks."""
    return _two_blocks(spark, d).select("part", B.is_valid(c("blocks")).alias("valid"), B.is_sorted(c("blocks")).alias("sorted"), B.text(B.sort(c("blocks"))).alias("in_order"))


@query("""SELECT part, a >= 0 AND a < c AS valid, coalesce(strand = '+', FALSE) AS forward, coalesce(strand = '-', FALSE) AS reverse, a >= 0 AND a < b AND c >= b AND c < d AND (s IS NULL OR s = a) AND (e IS NULL OR e = d) AS fits
 FROM (SELECT *, CASE part % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN '.' END AS strand, CASE WHEN part % 3 > 0 THEN a + CASE WHEN part % 7 = 0 THEN 1 ELSE 0 END END AS s, CASE WHEN part % 2 = 0 THEN d END AS e FROM two)""", V.DNA, PAIRED_BLOCKS)
def iv_checked(spark, d):
    """Valid spans, their direction, and spans that go with their blocks."""
    b, part = c("blocks"), c("part")
    strand = F.when(part % 4 == 0, "+").when(part % 4 == 1, "-").when(part % 4 == 2, ".")
    start, end = F.when(part % 3 > 0, b[0]["s"] + F.when(part % 7 == 0, 1).otherwise(0)), F.when(part % 2 == 0, b[1]["e"])
    return _two_blocks(spark, d).select("part", I.is_valid(b[0]["s"], b[1]["s"]).alias("valid"), I.is_forward(strand).alias("forward"), I.is_reverse(strand).alias("reverse"), I.fits_blocks(start, end, b).alias("fits"))


@query("""SELECT 0 AS container, name, CAST(row_number() OVER (ORDER BY chrom, "start", "end", container, name) AS BIGINT) AS place FROM (SELECT *, 0 AS container FROM features) WHERE FALSE UNION ALL
 SELECT container, name, CAST(row_number() OVER (ORDER BY chrom, "start", "end", container, name) AS BIGINT) AS place FROM (SELECT chrom, "start", "end", name, 0 AS container FROM features UNION ALL SELECT chrom, "start", "end", name, 1 FROM transcripts)""", V.FEATURES, V.TRANSCRIPTS)
def kway_merge(spark, d):
    own = ["chrom", "start", "end", "name"]
    out = islands.merge_sorted(V.features(spark, d).select(*own), _tx(spark, d).select(*own))
    return islands.placed(out, "container", "name").select("container", "name", "place")


@query("""SELECT name FROM (SELECT name, "start", "end", lag("start") OVER w AS ps, lag("end") OVER w AS pe FROM features WINDOW w AS (PARTITION BY chrom ORDER BY name)) WHERE ps IS NOT NULL AND ("start" < ps OR ("start" = ps AND "end" < pe))""", V.FEATURES)
def sorted_check(spark, d):
    return islands.disorder(V.features(spark, d), "name").select("name")


# annotation formats and models


def _gtf_lines(spark, d) -> DataFrame:
    """GTF lines of all transcripts: gene, transcript, exon and CDS."""
    t = _tx(spark, d).withColumn("gene", F.expr("concat('G', cast(part div 2 as string))"))
    row = lambda kind, s, e: F.struct(F.lit(kind).alias("f"), s.alias("s"), e.alias("e"))
    tops = F.array(row("transcript", c("start"), c("end")))
    ex = F.transform(c("blocks"), lambda x: row("exon", x["s"], x["e"]))
    cds = F.when(c("thick").isNotNull(), F.transform(B.clip(c("blocks"), c("thick.s"), c("thick.e")), lambda x: row("CDS", x["s"], x["e"]))).otherwise(F.slice(ex, 1, 0))
    out = exploded(t.select("chrom", "strand", "name", "gene", "part", "start", "end", "blocks", "thick"), "x", F.concat(tops, ex, cds))
    attributes = F.concat(F.lit('gene_id "'), c("gene"), F.lit('"; transcript_id "'), c("name"), F.lit('"; note "a; b"; level '), (c("part") % 3).cast("string"), F.lit('; tag "x"; tag "y";'))
    genes = t.groupBy("chrom", "gene").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.min("strand").alias("strand"))
    gene_line = F.concat_ws("\t", "chrom", F.lit("src"), F.lit("gene"), (c("s") + 1).cast("string"), c("e").cast("string"), F.lit("."), "strand", F.lit("."), F.concat(F.lit('gene_id "'), c("gene"), F.lit('"; gene_name "N'), c("gene"), F.lit('"; gene_type "coding";')))
    feature_line = F.concat_ws("\t", "chrom", F.lit("src"), c("x.f"), (c("x.s") + 1).cast("string"), c("x.e").cast("string"), F.lit("."), "strand", F.lit("."), attributes)
    return out.select(feature_line.alias("value")).unionByName(genes.select(gene_line.alias("value")))


def _gff_lines(spark, d) -> DataFrame:
    t = _tx(spark, d).withColumn("gene", F.concat(F.lit("G"), c("name")))
    row = lambda kind, s, e, i, p: F.struct(F.lit(kind).alias("f"), s.alias("s"), e.alias("e"), i.alias("i"), p.alias("p"))
    tops = F.array(row("gene", c("start"), c("end"), c("gene"), F.lit("")), row("transcript", c("start"), c("end"), c("name"), c("gene")))
    ex = F.transform(c("blocks"), lambda x, i: row("exon", x["s"], x["e"], F.concat(F.lit("exon:"), c("name"), F.lit(":"), i.cast("string")), c("name")))
    cds = F.when(c("thick").isNotNull(), F.transform(B.clip(c("blocks"), c("thick.s"), c("thick.e")), lambda x: row("CDS", x["s"], x["e"], F.concat(F.lit("CDS:"), c("name"), F.lit(":"), x["s"].cast("string")), c("name")))).otherwise(F.slice(ex, 1, 0))
    out = exploded(t, "x", F.concat(tops, ex, cds))
    a = F.concat(F.lit("ID="), c("x.i"), F.when(c("x.p") != "", F.concat(F.lit(";Parent="), c("x.p"))).otherwise(""), F.lit(';note="q"'))
    return out.select(F.concat_ws("\t", "chrom", F.lit("src"), c("x.f"), (c("x.s") + 1).cast("string"), c("x.e").cast("string"), F.lit("."), "strand", F.lit("."), a).alias("value"))


TX_TEXT = """SELECT t.chrom, t."start", t."end", t.name, t.strand, string_agg(CAST(s AS VARCHAR) || '-' || CAST(e AS VARCHAR), ';' ORDER BY k) AS blocks, any_value(ts) AS thick_start, any_value(te) AS thick_end FROM transcripts t JOIN exons USING (part) GROUP BY ALL"""


def _tx_text(t: DataFrame) -> DataFrame:
    return t.select("chrom", "start", "end", "name", "strand", B.text(c("blocks")).alias("blocks"), c("thick.s").alias("thick_start"), c("thick.e").alias("thick_end"))


@query(TX_TEXT, V.TRANSCRIPTS)
def tx_from_gtf(spark, d):
    return _tx_text(models.gtf_transcripts(T.parse_gtf(_gtf_lines(spark, d))))


@query(TX_TEXT, V.TRANSCRIPTS)
def tx_from_gff(spark, d):
    return _tx_text(models.gff_transcripts(T.parse_gff(_gff_lines(spark, d))))


@query("""SELECT chrom, name, min(s) AS "start", max(e) AS "end", string_agg(CAST(s AS VARCHAR) || '-' || CAST(e AS VARCHAR), ';' ORDER BY s) AS blocks, any_value(n) AS n FROM (SELECT 'chr' || CAST(part % 5 + 1 AS VARCHAR) AS chrom, 'G' || CAST(part // 2 AS VARCHAR) AS name, min(s) AS s, max(e) AS e, 1 AS one FROM exons GROUP BY part, k)
 JOIN (SELECT 'chr' || CAST(part % 5 + 1 AS VARCHAR) AS chrom, 'G' || CAST(part // 2 AS VARCHAR) AS name, count(DISTINCT part) AS n FROM exons GROUP BY ALL) USING (chrom, name) GROUP BY chrom, name""", V.EXONS)
def gene_from_gtf(spark, d):
    out = models.gtf_genes(T.parse_gtf(_gtf_lines(spark, d)))
    return out.select("chrom", "name", "start", "end", B.text(c("blocks")).alias("blocks"), F.size("transcripts").cast("long").alias("n"))


@query("""SELECT chrom, 'G' || name AS name, "start", "end", CAST("start" AS VARCHAR) || '-' || CAST("end" AS VARCHAR) AS blocks, CAST(1 AS BIGINT) AS n FROM transcripts""", V.TRANSCRIPTS)
def gene_from_gff(spark, d):
    out = models.gff_genes(T.parse_gff(_gff_lines(spark, d)))
    return out.select("chrom", "name", "start", "end", B.text(c("blocks")).alias("blocks"), F.size("transcripts").cast("long").alias("n"))


@query("""SELECT depth, count(*) AS n, CAST(sum(kids) AS BIGINT) AS kids FROM (SELECT 0 AS depth, 1 AS kids FROM transcripts UNION ALL SELECT 1, len(b) + CASE WHEN ts IS NULL THEN 0 ELSE len(b) END FROM transcripts UNION ALL SELECT 2, 0 FROM exons UNION ALL SELECT 2, 0 FROM exons WHERE part % 4 <> 0) GROUP BY depth""", V.TRANSCRIPTS)
def gff_tree(spark, d):
    out = models.feature_tree(T.parse_gff(_gff_lines(spark, d)), 4)
    return out.groupBy("depth").agg(F.count("*").alias("n"), F.sum("n_children").alias("kids"))


@query("""SELECT chrom, "start", "end", gene_id, transcript_id, note, level, tag FROM (SELECT 'chr' || CAST(part % 5 + 1 AS VARCHAR) AS chrom, s AS "start", e AS "end", 'G' || CAST(part // 2 AS VARCHAR) AS gene_id, 'T' || CAST(part AS VARCHAR) AS transcript_id, 'a; b' AS note, CAST(part % 3 AS VARCHAR) AS level, 'y' AS tag FROM exons)""", V.EXONS)
def attr_table(spark, d):
    out = T.attribute_table(T.parse_gtf(_gtf_lines(spark, d)).filter("feature = 'exon'"))
    return out.select("chrom", "start", "end", "gene_id", "transcript_id", "note", "level", "tag")


@query("""SELECT 'G' || CAST(part // 2 AS VARCHAR) AS "GeneID", 'NG' || CAST(part // 2 AS VARCHAR) AS "GeneName", 'coding' AS "GeneType", 'chr' || CAST(part % 5 + 1 AS VARCHAR) AS "Chrom", min(s) AS "Start", max(e) AS "End", min(CASE WHEN part % 2 = 0 THEN '+' ELSE '-' END) AS "Strand" FROM exons GROUP BY part // 2, part % 5""", V.EXONS)
def gene_info(spark, d):
    return models.gene_info(T.parse_gtf(_gtf_lines(spark, d)))


@query("""SELECT t.name AS "TranscriptID", 'G' || CAST(part // 2 AS VARCHAR) AS "GeneID", t.chrom AS "Chrom", t."start" AS "Start", t."end" AS "End", t.strand AS "Strand", CAST(sum(e - s) AS BIGINT) AS "Length" FROM transcripts t JOIN exons USING (part) GROUP BY ALL""", V.TRANSCRIPTS)
def tx_info(spark, d):
    return models.transcript_info(T.parse_gtf(_gtf_lines(spark, d))).select("TranscriptID", "GeneID", "Chrom", "Start", "End", "Strand", "Length")


LENGTHS = """lengths AS (SELECT 'T' || CAST(part AS VARCHAR) || '.1' AS id, CASE WHEN part % 50 <> 0 THEN 'G' || CAST(part // 4 AS VARCHAR) END AS gene, CAST(sum(e - s) AS BIGINT) AS length, part % 3 = 0 AS listed FROM exons GROUP BY part)"""


@query("""SELECT id AS "TranscriptID", gene AS "GeneID", length AS "Length", gene IS NOT NULL AND row_number() OVER (PARTITION BY gene ORDER BY listed DESC, length DESC, id) = 1 AS "Canonical" FROM lengths""", V.EXONS, LENGTHS)
def canonical_tx(spark, d):
    t = _tx(spark, d)
    rows = t.select(F.concat("name", F.lit(".1")).alias("TranscriptID"), F.expr("if(part % 50 <> 0, concat('G', cast(part div 4 as string)), null)").alias("GeneID"), B.length(c("blocks")).alias("Length"))
    return models.canonical(rows, t.filter("part % 3 = 0").select(F.concat("name", F.lit(".77")).alias("TranscriptID")))


@query("""SELECT chrom, "start", "start" + 1 AS "end", name, ref, alt FROM (SELECT 'chr1' AS chrom, event_id AS "start", 'rs' || CAST(event_id AS VARCHAR) AS name, substring('ACGT', CAST(event_id % 4 + 1 AS INTEGER), 1) AS ref, unnest(['A', 'C', 'T']) AS alt FROM events WHERE event_id % 3 <> 0) WHERE ref <> alt""")
def ucsc_snp_alleles(spark, d):
    e = V.table(spark, d, "events")
    rows = e.selectExpr("'chr1' as chrom", "event_id as start", "concat('rs', cast(event_id as string)) as name", "'+' as strand", "substring('ACGT', cast(event_id % 4 + 1 as int), 1) as ref_ncbi", "substring('ACGT', cast(event_id % 4 + 1 as int), 1) as ref_ucsc", "'A/C/T/-' as observed", "if(event_id % 3 = 0, 'deletion', 'single') as class")
    return models.ucsc_single_base(rows).select("chrom", "start", "end", "name", "ref", "alt")


BED_LINE = """SELECT chrom || chr(9) || "start" || chr(9) || "end" || chr(9) || name || chr(9) || '.' || chr(9) || strand || chr(9) || coalesce(ts, "start") || chr(9) || coalesce(te, "start") || chr(9) || CASE WHEN strand = '+' THEN '0,0,255' ELSE '255,0,0' END || chr(9) || len(b) || chr(9) || list_aggregate(list_transform(b, lambda x: CAST(x.e - x.s AS VARCHAR)), 'string_agg', ',') || ',' || chr(9) || list_aggregate(list_transform(b, lambda x: CAST(x.s - "start" AS VARCHAR)), 'string_agg', ',') || ',' AS line FROM transcripts"""


@query(BED_LINE, V.TRANSCRIPTS)
def bed12_format(spark, d):
    return _tx(spark, d).select(T.bed_line(score=None, color=None).alias("line"))


@query(TX_TEXT, V.TRANSCRIPTS)
def bed_roundtrip(spark, d):
    return _tx_text(T.parse_bed(_tx(spark, d).select(T.bed_line(score=None, color=None).alias("value"))))


@query("""SELECT t.chrom || chr(9) || 'src' || chr(9) || 'exon' || chr(9) || (s + 1) || chr(9) || e || chr(9) || '.' || chr(9) || strand || chr(9) || '.' || chr(9) || 'gene_id "G' || (part // 2) || '"; transcript_id "' || name || '"; note "a; b"; level "' || (part % 3) || '"; tag "y";' AS line FROM transcripts t JOIN exons USING (part)""", V.TRANSCRIPTS)
def gtf_format(spark, d):
    return T.parse_gtf(_gtf_lines(spark, d)).filter("feature = 'exon'").select(T.gtf_line().alias("line"))


@query("""SELECT t.chrom || chr(9) || 'src' || chr(9) || 'exon' || chr(9) || (s + 1) || chr(9) || e || chr(9) || '.' || chr(9) || strand || chr(9) || '.' || chr(9) || 'ID=exon:' || name || ':' || k || ';Parent=' || name || ';note=q' AS line FROM transcripts t JOIN exons USING (part)""", V.TRANSCRIPTS)
def gff_format(spark, d):
    return T.parse_gff(_gff_lines(spark, d)).filter("feature = 'exon'").select(T.gff_line().alias("line"))


@query("""SELECT name || chr(9) || chrom || chr(9) || coalesce(ts || '-' || te, '.') || chr(9) || list_aggregate(list_transform(b, lambda x: CAST(x.s AS VARCHAR) || '-' || CAST(x.e AS VARCHAR)), 'string_agg', ';') AS line FROM transcripts""", V.TRANSCRIPTS)
def tbl_format(spark, d):
    header = ["name", "chrom", "thick", "blocks"]
    once = _tx(spark, d).select(T.table_line(header).alias("value"))
    return T.parse_table(once, header).select(T.table_line(header).alias("line"))


def _vcf(spark, d) -> DataFrame:
    return V.variants(spark, d).select("chrom", "start", F.concat(F.lit("rs"), c("event_id").cast("string")).alias("name"), F.lit("-").alias("strand"), "ref", F.concat("alts", F.array(F.lit("N"))).alias("alts"), (c("event_id") % 90).cast("int").alias("qual"), F.lit("PASS").alias("filt"), F.create_map(F.lit("DP"), c("event_id").cast("string")).alias("info"))


@query("""SELECT chrom || chr(9) || ("start" + 1) || chr(9) || 'rs' || event_id || chr(9) || ref || chr(9) || alt || ',N' || chr(9) || (event_id % 90) || chr(9) || 'PASS' || chr(9) || 'SB=-;DP=' || event_id AS line FROM variants""", V.VARIANTS)
def vcf_format(spark, d):
    return _vcf(spark, d).select(T.vcf_line().alias("line"))


@query("""SELECT chrom, "start", "start" + 1 AS "end", 'rs' || event_id AS name, '-' AS strand, ref, alt || ',N' AS alts, CAST(event_id % 90 AS INTEGER) AS qual, CAST(event_id AS VARCHAR) AS dp FROM variants""", V.VARIANTS)
def vcf_parse(spark, d):
    out = T.parse_vcf(_vcf(spark, d).select(T.vcf_line().alias("value")))
    return out.select("chrom", "start", "end", "name", "strand", "ref", F.array_join("alts", ",").alias("alts"), "qual", c("info")["DP"].alias("dp"))


@query("""SELECT chrom, "start", ref, alt FROM variants""", V.VARIANTS)
def site_bed(spark, d):
    line = F.concat_ws("\t", "chrom", c("start").cast("string"), (c("start") + 1).cast("string"), F.concat("ref", F.lit("-"), F.get("alts", F.lit(0))), F.lit("."), F.lit("+"))
    return T.parse_site_bed(V.variants(spark, d).select(line.alias("value"))).select("chrom", "start", "ref", "alt")


# sequences


@query("SELECT part, substring(seq, CAST(size % 40 + 1 AS INTEGER), 20) AS piece FROM dna", V.DNA)
def fasta_substring(spark, d):
    return V.dna(spark, d).select("part", S.piece(c("seq"), c("size") % 40, c("size") % 40 + 20).alias("piece"))


REVCOMP = "translate(reverse({}), 'ACGT', 'TGCA')"


@query(f"SELECT part, CASE WHEN part % 2 = 1 THEN {REVCOMP.format('x')} ELSE x END AS spliced FROM (SELECT part, substring(seq, 6, 10) || substring(seq, 31, 15) AS x FROM dna)", V.DNA)
def fasta_blocks_rc(spark, d):
    ranges = V.dna(spark, d).select("part", c("part").cast("string").alias("chrom"), F.when(c("part") % 2 == 1, "-").otherwise("+").alias("strand"), F.lit(5).cast("long").alias("start"), F.lit(45).cast("long").alias("end"), B.literal([(5, 15), (30, 45)]).alias("blocks"))
    contigs = V.dna(spark, d).select(c("part").cast("string").alias("name"), c("seq").alias("sequence"))
    return T.fetch(ranges, contigs, "blocks").select("part", c("sequence").alias("spliced"))


BLOCK_BASES = ", ".join(f"CASE WHEN strpos(under, '{b}') > 0 THEN '{b},' || (length(under) - length(replace(under, '{b}', ''))) END" for b in "ACGT")


@query(f"SELECT part, concat_ws(';', {BLOCK_BASES}) AS counts FROM (SELECT part, substring(seq, 6, 10) || substring(seq, 31, 15) || substring(seq, 61, 4) AS under FROM dna)", V.DNA)
def genome_base_counts(spark, d):
    """Bases of a genome in pieces of 16 under blocks, the last of which goes beyond its contig."""
    dna = V.dna(spark, d).withColumns({"name": c("part").cast("string"), "sequence": c("seq")})
    spans = dna.select(c("name").alias("chrom"), B.literal([(5, 15), (30, 45), (60, 90)]).alias("blocks"))
    return E.genome_counts(spans, T.chunked(dna, 16), 16).select(c("chrom").cast(dna.schema["part"].dataType).alias("part"), "counts")


@query("SELECT part, substring(seq, CAST(size % 20 + 1 AS INTEGER), 35) AS piece FROM dna", V.DNA)
def fasta_chunked(spark, d):
    ranges = V.dna(spark, d).select("part", c("part").cast("string").alias("chrom"), F.lit("+").alias("strand"), (c("size") % 20).alias("start"), (c("size") % 20 + 35).alias("end"))
    contigs = V.dna(spark, d).select(c("part").cast("string").alias("name"), c("seq").alias("sequence"))
    return T.fetch_chunked(ranges, T.chunked(contigs, 16), "part", 16).select("part", c("sequence").alias("piece"))


@query("SELECT '>' || part || chr(10) || substring(seq, 1, 25) || chr(10) || substring(seq, 26, 25) || chr(10) || substring(seq, 51, 14) AS record FROM dna", V.DNA)
def fasta_wrap(spark, d):
    return V.dna(spark, d).select(c("part").cast("string").alias("name"), c("seq").alias("sequence")).select(T.fasta_record(25).alias("record"))


@query("SELECT part, " + ", ".join(f"CAST(length(seq) - length(replace(seq, '{b}', '')) AS BIGINT) AS {b.lower()}" for b in "ACGT") + " FROM dna", V.DNA)
def base_composition(spark, d):
    return V.dna(spark, d).select("part", *[S.base_count(c("seq"), b).alias(b.lower()) for b in "ACGT"])


@query(f"SELECT part, {REVCOMP.format('seq')} AS rc, translate(seq, 'ACGT', 'TGCA') AS comp FROM dna", V.DNA)
def revcomp(spark, d):
    return V.dna(spark, d).select("part", S.reverse_complement(c("seq")).alias("rc"), S.complement(c("seq")).alias("comp"))


@query("SELECT seq AS sequence, min('r' || lpad(CAST(part AS VARCHAR), 9, '0')) AS name FROM (SELECT part, substring(seq, 1, 4) AS seq FROM dna) GROUP BY seq", V.DNA)
def fastq_unique(spark, d):
    reads = V.dna(spark, d).select(F.concat(F.lit("r"), F.lpad(c("part").cast("string"), 9, "0")).alias("name"), F.substring("seq", 1, 4).alias("sequence"), F.lit("IIII").alias("quality"))
    return T.unique_reads(reads).select("sequence", "name")


# alignments: 3S 20M 2I 10M 4D 9M 50N 12M 8S over each part's bases, with one mismatch


def _alignments(spark, d) -> DataFrame:
    md = F.concat((c("size") % 19).cast("string"), F.lit("N"), (29 - c("size") % 19).cast("string"), F.lit("^ACGT21"))
    return V.dna(spark, d).select("part", F.concat(F.lit("r"), c("part").cast("string")).alias("qname"), F.lit(0).alias("flag"), F.expr("concat('chr', cast(part % 5 + 1 as string))").alias("chrom"), (c("part") * 10).alias("start"), F.lit("3S20M2I10M4D9M50N12M8S").alias("cigar"), "seq", F.repeat(F.lit("5"), 64).alias("qual"), F.create_map(F.lit("MD"), md).alias("tags"), "size")


@query("SELECT part, CAST(part * 10 AS VARCHAR) || '-' || (part * 10 + 43) || ';' || (part * 10 + 93) || '-' || (part * 10 + 105) AS blocks, CAST(part * 10 AS VARCHAR) || '-' || (part * 10 + 30) || ';' || (part * 10 + 34) || '-' || (part * 10 + 43) || ';' || (part * 10 + 93) || '-' || (part * 10 + 105) AS split FROM dna", V.DNA)
def cigar_blocks(spark, d):
    return _alignments(spark, d).select("part", B.text(C.blocks(c("cigar"), c("start"))).alias("blocks"), B.text(C.blocks(c("cigar"), c("start"), False)).alias("split"))


@query("SELECT part, CAST(55 AS BIGINT) AS mapped, CAST(105 AS BIGINT) AS reference, CAST(3 AS BIGINT) AS clip_left, CAST(8 AS BIGINT) AS clip_right FROM dna", V.DNA)
def cigar_lengths(spark, d):
    return _alignments(spark, d).select("part", C.mapped_length(c("cigar")).alias("mapped"), C.reference_length(c("cigar")).alias("reference"), C.clipped(c("cigar"))["left"].alias("clip_left"), C.clipped(c("cigar"))["right"].alias("clip_right"))


@query("SELECT part, substring(seq, 4, 20) || substring(seq, 26, 10) || '----' || substring(seq, 36, 21) AS aligned FROM dna", V.DNA)
def aligned_seq(spark, d):
    return _alignments(spark, d).select("part", C.aligned_sequence(c("cigar"), c("seq")).alias("aligned"))


@query("SELECT part, CASE WHEN o < 20 THEN substring(seq, CAST(4 + o AS INTEGER), 1) WHEN o < 30 THEN substring(seq, CAST(6 + o AS INTEGER), 1) WHEN o < 34 THEN '-' WHEN o < 43 THEN substring(seq, CAST(2 + o AS INTEGER), 1) END AS base FROM (SELECT *, size + 3 AS o FROM dna)", V.DNA)
def query_base(spark, d):
    return _alignments(spark, d).select("part", C.query_base(c("cigar"), c("start"), c("seq"), c("start") + c("size") + 3).alias("base"))


MD_EVENTS = """ev AS (SELECT part, size, part * 10 + x AS pos, 'N' AS ref, substring(seq, CAST(4 + x AS INTEGER), 1) AS alt, 20 AS qual, least(x, 54 - x) AS dist FROM (SELECT *, size % 19 AS x FROM dna)
 UNION ALL SELECT part, size, part * 10 + 20, '-', substring(seq, 24, 2), 20, 20 FROM dna UNION ALL SELECT part, size, part * 10 + 30, 'ACGT', '-', 0, 21 FROM dna)"""


@query("SELECT part, pos, ref, alt, qual, CAST(dist AS BIGINT) AS dist FROM ev", V.DNA, MD_EVENTS)
def md_events(spark, d):
    return E.rows(E.called(_alignments(spark, d)), "part").select("part", "pos", "ref", "alt", "qual", "dist")


@query("""SELECT part, string_agg(pos || ',' || ref || ',' || alt || ',' || CASE WHEN ref = '-' THEN '20/20' ELSE CAST(qual AS VARCHAR) END || ',' || dist, ';' ORDER BY pos, ref, alt) AS "ME" FROM ev GROUP BY part""", V.DNA, MD_EVENTS)
def event_tags(spark, d):
    """Events as tag text, decoded and encoded once more."""
    out = E.tagged(_alignments(spark, d)).select("part", c("tags")["ME"].alias("ME"))
    return out.select("part", C.encode_events(C.decode_events(c("ME"))).alias("ME"))


@query("""SELECT part, substring(seq, 4, CAST(size % 19 AS INTEGER)) || 'N' || substring(seq, CAST(5 + size % 19 AS INTEGER), CAST(19 - size % 19 AS INTEGER)) || substring(seq, 26, 10) || 'ACGT' || substring(seq, 36, 21) AS reference FROM dna""", V.DNA)
def reference_seq(spark, d):
    return _alignments(spark, d).select("part", C.reference_sequence(c("cigar"), c("tags")["MD"], c("seq")).alias("reference"))


@query("""SELECT part, pos + i AS pos, substring(ref, CAST(i + 1 AS INTEGER), 1) AS ref, alt FROM ev, unnest(range(length(ref))) AS u(i) WHERE ref <> '-'""", V.DNA, MD_EVENTS)
def events_per_base(spark, d):
    return E.per_base(E.rows(E.called(_alignments(spark, d)), "part")).select("part", "pos", "ref", "alt")


# mates


def _paired(spark, d) -> DataFrame:
    """Two reads of each order, some of them without mate."""
    f = V.fragments(spark, d)
    one = f.selectExpr("concat('q', cast(id div 2 as string)) as qname", "67 as flag", "chrom", "start", "start + 40 as end", "start + 60 as next_start", "strand", "id")
    two = f.filter("id % 5 <> 0").selectExpr("concat('q', cast(id div 2 as string)) as qname", "131 as flag", "chrom", "start + 60 as start", "start + 100 as end", "start as next_start", "if(strand = '+', '-', '+') as strand", "id")
    out = one.unionByName(two)
    return out.withColumn("blocks", F.array(B.block(c("start"), c("end"))))


MATES = """mates AS (SELECT f.chrom, f."start", 'q' || (f.id // 2) AS qname, row_number() OVER (PARTITION BY f.id // 2, f.chrom, f."start" ORDER BY f.id) AS n FROM fragments f),
 seconds AS (SELECT f.chrom, f."start", 'q' || (f.id // 2) AS qname, row_number() OVER (PARTITION BY f.id // 2, f.chrom, f."start" ORDER BY f.id) AS n FROM fragments f WHERE f.id % 5 <> 0)"""


@query("""SELECT qname, chrom, "start", "start" + 100 AS "end" FROM mates JOIN seconds USING (qname, chrom, "start", n)""", V.FRAGMENTS, MATES)
def mate_pairs(spark, d):
    return pairing.mates(_paired(spark, d)).select("qname", "chrom", "start", "end")


@query("""SELECT qname, "start" || '-' || ("start" + 40) || ';' || ("start" + 60) || '-' || ("start" + 100) AS blocks FROM mates JOIN seconds USING (qname, chrom, "start", n)""", V.FRAGMENTS, MATES)
def fragment_blocks(spark, d):
    return pairing.fragments(_paired(spark, d)).select("qname", B.text(c("blocks")).alias("blocks"))


@query("""SELECT 'q' || CAST(id AS VARCHAR) AS qname, "start" AS s1, "start" + 60 AS s2 FROM fragments""", V.FRAGMENTS)
def name_pairs(spark, d):
    """Mates by their place in a name-paired file."""
    f = V.fragments(spark, d).selectExpr("concat('q', cast(id as string)) as qname", "start", "id as n")
    both = f.selectExpr("qname", "start", "n * 2 as ordinal").unionByName(f.selectExpr("qname", "start + 60 as start", "n * 2 + 1 as ordinal"))
    out = pairing.name_paired(both, "ordinal")
    return out.select("qname", c("mate1.start").alias("s1"), c("mate2.start").alias("s2"))


# events


@query("""SELECT id FROM mismatches m WHERE ref <> '-' AND alt <> '-' AND NOT EXISTS (SELECT 1 FROM variants v WHERE v.chrom = m.chrom AND v."start" = m.pos)""", V.MISMATCHES, V.VARIANTS)
def event_mask(spark, d):
    return E.masked(V.mismatches(spark, d), V.variants(spark, d)).select("id")


@query("""SELECT id FROM mismatches m WHERE alt = '-' OR NOT EXISTS (SELECT 1 FROM variants v WHERE v.chrom = m.chrom AND v."start" = m.pos)""", V.MISMATCHES, V.VARIANTS)
def event_mask_keep_indels(spark, d):
    return E.masked(V.mismatches(spark, d), V.variants(spark, d), drop_indels=False).select("id")


@query("""SELECT id FROM mismatches m WHERE NOT EXISTS (SELECT 1 FROM variants v WHERE v.chrom = m.chrom AND v."start" = m.pos)""", V.MISMATCHES, V.VARIANTS)
def event_mask_pos(spark, d):
    return joins.without_positions(V.mismatches(spark, d), V.variants(spark, d)).select("id")


@query("""SELECT id, EXISTS (SELECT 1 FROM variants v WHERE v.chrom = m.chrom AND v."start" = m.pos AND ((v.ref = m.ref AND v.alt = m.alt) OR (translate(v.ref, 'ACGTN', 'TGCAN') = m.ref AND translate(v.alt, 'ACGTN', 'TGCAN') = m.alt))) AS is_snp FROM mismatches m""", V.MISMATCHES, V.VARIANTS)
def snp_allele_match(spark, d):
    return joins.mark_variants(V.mismatches(spark, d), V.variants(spark, d)).select("id", "is_snp")


@query("""SELECT m.id, v.event_id FROM mismatches m JOIN variants v ON v.chrom = m.chrom AND v."start" = m.pos AND ((v.ref = m.ref AND v.alt = m.alt) OR (translate(v.ref, 'ACGTN', 'TGCAN') = m.ref AND translate(v.alt, 'ACGTN', 'TGCAN') = m.alt))""", V.MISMATCHES, V.VARIANTS)
def allele_condition(spark, d):
    v = V.variants(spark, d).selectExpr("chrom", "start as pos", "ref as v_ref", "alts", "event_id")
    return V.mismatches(spark, d).join(v, ["chrom", "pos"]).filter(joins.allele_match(c("ref"), c("alt"), c("v_ref"), c("alts"))).select("id", "event_id")


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    m = V.mismatches(spark, d).filter("alt <> '-'").withColumns({"pos": c("id") % 11, "ref": F.lit("A"), "chrom": F.lit("chr1")}).filter("alt <> 'A'")
    own = ["fragment", "chrom", "pos", "ref", "alt", "qual", "dist"]
    best = lambda df: df.groupBy("fragment", "chrom", "pos").agg(F.min_by(F.struct(*own), "id").alias("x")).select("x.*")
    return best(m.filter("id % 2 = 0")), best(m.filter("id % 2 = 1"))


SIDE = "(SELECT fragment, id % 11 AS pos, arg_min(alt, id) AS alt, arg_min(qual, id) AS qual, arg_min(dist, id) AS dist FROM mismatches WHERE alt NOT IN ('-', 'A') AND id % 2 = {} GROUP BY fragment, id % 11)"


@query(f"""SELECT fragment, pos, alt, qual, dist FROM (SELECT coalesce(x.fragment, y.fragment) AS fragment, coalesce(x.pos, y.pos) AS pos, CASE WHEN x.pos IS NULL THEN y.alt WHEN y.pos IS NULL OR x.alt = y.alt OR x.qual > y.qual OR (x.qual = y.qual AND x.dist > y.dist) THEN x.alt WHEN x.qual < y.qual OR x.dist < y.dist THEN y.alt END AS alt,
 CASE WHEN x.pos IS NULL THEN y.qual WHEN y.pos IS NULL THEN x.qual ELSE greatest(x.qual, y.qual) END AS qual, CASE WHEN x.pos IS NULL THEN y.dist WHEN y.pos IS NULL THEN x.dist WHEN x.alt = y.alt THEN greatest(x.dist, y.dist) WHEN x.qual > y.qual THEN x.dist WHEN x.qual < y.qual THEN y.dist ELSE greatest(x.dist, y.dist) END AS dist
 FROM {SIDE.format(0)} x FULL JOIN {SIDE.format(1)} y ON x.fragment = y.fragment AND x.pos = y.pos) WHERE alt IS NOT NULL""", V.MISMATCHES)
def event_merge_mates(spark, d):
    a, b = _sides(spark, d)
    return E.merge_mates(a, b).select("fragment", "pos", "alt", "qual", "dist")


@query(f"""SELECT x.fragment, x.pos, x.alt FROM {SIDE.format(0)} x LEFT JOIN {SIDE.format(1)} y ON x.fragment = y.fragment AND x.pos = y.pos WHERE y.qual IS NULL OR x.qual > y.qual""", V.MISMATCHES)
def event_single_side(spark, d):
    a, b = _sides(spark, d)
    met = a.join(b.select("fragment", "pos", c("qual").alias("other")), ["fragment", "pos"], "left")
    return E.single_side(met, c("other")).select("fragment", "pos", "alt")


@query(f"""SELECT fragment, pos, alt, qual FROM (SELECT x.fragment, x.pos, CASE WHEN y.alt IS NULL OR y.alt = x.alt OR x.qual > y.qual THEN x.alt WHEN y.qual > x.qual THEN y.alt END AS alt, CASE WHEN y.alt IS NULL THEN x.qual ELSE greatest(x.qual, y.qual) END AS qual FROM {SIDE.format(0)} x LEFT JOIN {SIDE.format(1)} y ON x.fragment = y.fragment AND x.pos = y.pos) WHERE alt IS NOT NULL AND alt <> 'A'""", V.MISMATCHES)
def event_cross_check(spark, d):
    a, b = _sides(spark, d)
    met = a.join(b.select("fragment", "pos", c("alt").alias("o_alt"), c("qual").alias("o_qual")), ["fragment", "pos"], "left")
    return E.cross_checked(met, c("o_alt"), c("o_qual")).select("fragment", "pos", "alt", "qual")


@query("SELECT part, CAST(part * 10 AS VARCHAR) || '-' || (part * 10 + 43) || ';' || (part * 10 + 93) || '-' || (part * 10 + 105) AS merged FROM dna", V.DNA)
def cigar_merge_deletions(spark, d):
    return _alignments(spark, d).select("part", B.text(C.merge_deletions(c("cigar"), c("start"))).alias("merged"))


@query("""SELECT 'r' || part AS qname, CAST(0 AS INTEGER) AS flag, 'chr' || (part % 5 + 1) AS chrom, part * 10 AS "start", CASE WHEN part % 3 = 0 THEN 255 ELSE 60 END AS mapq, '3S20M2I10M4D9M50N12M8S' AS cigar, CASE WHEN part % 2 = 0 THEN 'chr' || (part % 5 + 1) END AS next_chrom, part * 10 + 7 AS next_start, seq, (size % 19) || 'N' || (29 - size % 19) || '^ACGT21' AS md, CAST(size AS VARCHAR) AS nm FROM dna""", V.DNA)
def sam_roundtrip(spark, d):
    """Reads as SAM lines and back."""
    own = _alignments(spark, d).withColumns({"mapq": F.when(c("part") % 3 != 0, 60), "next_chrom": F.when(c("part") % 2 == 0, c("chrom")), "next_start": c("start") + 7, "tlen": F.lit(0).cast("long"), "tags": F.map_concat("tags", F.create_map(F.lit("NM"), c("size").cast("string")))})
    back = sam.parse_sam(own.select(sam.sam_line().alias("value")))
    return back.select("qname", "flag", "chrom", "start", "mapq", "cigar", "next_chrom", "next_start", "seq", c("tags")["MD"].alias("md"), c("tags")["NM"].alias("nm"))


def _covered_twice(spark, d) -> DataFrame:
    """Each read with a second mate over its first block and beyond; by part the second mate's score is higher, equal or lower, in
    the first two cases over complementary bases."""
    reads = _alignments(spark, d)
    own = S.complement(F.substring("seq", 4, 20))
    head = F.when(c("part") % 3 < 2, own).otherwise(F.substring("seq", 4, 20))
    score = F.when(c("part") % 3 == 0, "7").when(c("part") % 3 == 1, "5").otherwise("3")
    span = lambda x: x.withColumn("blocks", C.blocks(c("cigar"), c("start")))
    mate = F.struct("cigar", "start", "seq", "qual", "tags", "blocks")
    one = span(reads).select("part", "chrom", mate.alias("mate1"))
    two = span(reads.withColumns({"seq": F.concat(head, F.substring("seq", 40, 15)), "cigar": F.lit("20M20N15M"), "qual": F.repeat(score, F.lit(35)), "tags": F.create_map(F.lit("MD"), F.lit("34A0"))})).select("part", mate.alias("mate2"))
    return one.join(two, "part").withColumn("blocks", B.fusion(c("mate1.blocks"), c("mate2.blocks")))


PAIR_TAGS = """pairs AS (SELECT part, part * 10 AS s, x, substring(seq, CAST(4 + x AS INTEGER), 1) AS b, substring(seq, 54, 1) AS far, CASE part % 3 WHEN 0 THEN 22 WHEN 1 THEN 20 ELSE 18 END AS q,
 substring(seq, 4, CAST(x AS INTEGER)) || 'N' || substring(seq, CAST(5 + x AS INTEGER), CAST(19 - x AS INTEGER)) || substring(seq, 26, 10) || 'ACGT' || substring(seq, 36, 21) || substring(seq, 43, 11) || 'A' AS under FROM (SELECT *, size % 19 AS x FROM dna))"""
LETTERS = ", ".join(f"CASE WHEN strpos(under, '{b}') > 0 THEN '{b},' || (length(under) - length(replace(under, '{b}', ''))) END" for b in "ACGNT")


@query(f"""SELECT part, concat_ws(';', CASE part % 3 WHEN 0 THEN (s + x) || ',N,' || translate(b, 'ACGT', 'TGCA') || ',22,' || least(x, 34 - x) WHEN 2 THEN (s + x) || ',N,' || b || ',20,' || least(x, 54 - x) END,
 (s + 30) || ',A,-,0,24', (s + 31) || ',C,-,0,23', (s + 32) || ',G,-,0,22', (s + 33) || ',T,-,0,21', CASE WHEN far <> 'A' THEN (s + 54) || ',A,' || far || ',' || q || ',0' END) AS "PE", concat_ws(';', {LETTERS}) AS "PC" FROM pairs""", V.DNA, PAIR_TAGS)
def pair_event_tags(spark, d):
    """Events of fragments, each mate's checked against the other's bases, and the bases under both."""
    out = E.identified_pairs(_covered_twice(spark, d))
    return out.select("part", c("mate1.tags")["PE"].alias("PE"), c("mate1.tags")["PC"].alias("PC"))


@query("SELECT chrom, pos, ref, alt, max(qual) AS qual, max(qual * 1000 + dist) % 1000 AS dist FROM mismatches GROUP BY chrom, pos, ref, alt", V.MISMATCHES)
def event_dedup(spark, d):
    return E.sites(V.mismatches(spark, d))


@query("""SELECT id, EXISTS (SELECT 1 FROM variants v WHERE v.chrom = m.chrom AND v."start" = m.pos AND ((v.ref = m.ref AND v.alt = m.alt) OR (translate(v.ref, 'ACGTN', 'TGCAN') = m.ref AND translate(v.alt, 'ACGTN', 'TGCAN') = m.alt))) AS hit FROM mismatches m""", V.MISMATCHES, V.VARIANTS)
def blacklist_split(spark, d):
    kept, hit = joins.split_blacklist(V.mismatches(spark, d), V.variants(spark, d))
    return kept.select("id", F.lit(False).alias("hit")).unionByName(hit.select("id", F.lit(True).alias("hit")))


@query("""SELECT part, size % 19 AS "offset", part * 10 + size % 19 AS pos FROM dna WHERE substring(seq, CAST(size % 19 + 1 AS INTEGER), 1) <> 'A'""", V.DNA)
def sequence_compare(spark, d):
    """Mismatches by comparing a sequence that has an A put in with the reference."""
    i = (c("size") % 19).cast("int")
    changed = F.concat(F.substring("seq", 1, i), F.lit("A"), F.substring("seq", i + 2, F.lit(64)))
    rows = V.dna(spark, d).select(c("part").cast("string").alias("chrom"), (c("part") * 10).alias("start"), changed.alias("sequence"), c("seq").alias("reference"))
    return E.compared(rows).select(c("chrom").cast("long").alias("part"), c("offset").cast("long").alias("offset"), "pos")


# reports

TYPED = """typed AS (SELECT *, CASE WHEN strand = '-' THEN translate(ref, 'ACGTN', 'TGCAN') || '-' || translate(alt, 'ACGTN', 'TGCAN') ELSE ref || '-' || alt END AS type FROM mismatches WHERE qual >= 20 AND alt NOT IN ('-', 'N'))"""
KINDS = "(VALUES " + ", ".join(f"('{t}')" for t in reports.TYPES) + ") AS k(type)"


@query(f"""SELECT type, coalesce(n, 0) AS count, CAST(coalesce(b, 0) AS BIGINT) AS bases, round(CASE WHEN b > 0 THEN coalesce(n, 0) / b ELSE 0 END, 9) AS ratio FROM {KINDS} LEFT JOIN (SELECT type, count(*) AS n FROM typed GROUP BY type) USING (type) LEFT JOIN (SELECT base, CAST(sum(n) AS BIGINT) AS b FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS base, unnest([length(seq) - length(replace(seq, 'A', '')), length(seq) - length(replace(seq, 'C', '')), length(seq) - length(replace(seq, 'G', '')), length(seq) - length(replace(seq, 'T', ''))]) AS n FROM dna) GROUP BY base) ON base = type[1]""", V.MISMATCHES, TYPED, V.DNA)
def mismatch_ratio(spark, d):
    counts = V.dna(spark, d).select(F.explode(F.array(*[F.struct(F.lit(b).alias("base"), S.base_count(c("seq"), b).alias("n")) for b in "ACGT"])).alias("x")).select("x.*")
    return reports.mismatch_ratio(V.mismatches(spark, d), counts, strand=c("strand")).withColumn("ratio", F.round("ratio", 9))


@query("""SELECT g.type AS given, t.type, CAST(count(*) AS BIGINT) AS count FROM (SELECT DISTINCT fragment, type FROM typed) g JOIN typed t USING (fragment) GROUP BY ALL""", V.MISMATCHES, TYPED)
def mismatch_cooccurrence(spark, d):
    return reports.mismatch_cooccurrence(V.mismatches(spark, d), "fragment", strand=c("strand"))


MARKED = """marked AS (SELECT m.*, EXISTS (SELECT 1 FROM variants v WHERE v.chrom = m.chrom AND v."start" = m.pos AND ((v.ref = m.ref AND v.alt = m.alt) OR (translate(v.ref, 'ACGTN', 'TGCAN') = m.ref AND translate(v.alt, 'ACGTN', 'TGCAN') = m.alt))) AS is_snp FROM mismatches m)"""


def _cube(spark, d) -> DataFrame:
    return reports.event_cube(joins.mark_variants(V.mismatches(spark, d), V.variants(spark, d)))


@query("SELECT qual, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 9) AS percent FROM mismatches GROUP BY qual", V.MISMATCHES)
def score_hist(spark, d):
    return reports.histogram(_cube(spark, d), "qual").withColumn("percent", F.round("percent", 9))


@query("SELECT dist, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 9) AS percent FROM mismatches GROUP BY dist", V.MISMATCHES)
def distance_hist(spark, d):
    return reports.histogram(_cube(spark, d), "dist").withColumn("percent", F.round("percent", 9))


@query("SELECT dist, " + ", ".join(f"count(*) FILTER (qual = {q}) AS q{q}" for q in (0, 20, 40)) + " FROM mismatches GROUP BY dist", V.MISMATCHES)
def score_distance_matrix(spark, d):
    return reports.matrix(_cube(spark, d), [0, 20, 40])


@query("SELECT ref || '-' || alt AS type, count(*) AS count, count(*) FILTER (is_snp) AS snps, round(count(*) FILTER (is_snp) / count(*), 9) AS share FROM marked GROUP BY ALL", V.MISMATCHES, V.VARIANTS, MARKED)
def snp_share(spark, d):
    return reports.snp_share(_cube(spark, d)).withColumn("share", F.round("share", 9))


@query("SELECT ref || '-' || alt AS type, count(*) AS raw, count(*) FILTER (dist >= 5 AND qual >= 20) AS filtered FROM marked WHERE NOT is_snp GROUP BY ALL", V.MISMATCHES, V.VARIANTS, MARKED)
def filtered_ratio(spark, d):
    return reports.filtered_counts(_cube(spark, d), 5, 20)

