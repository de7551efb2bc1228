"""Genomic views over the driver's tables, each with the same rows in DuckDB SQL (as common table expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import blocks as B


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("concat('chr', cast(p_partkey % 5 + 1 as string)) as chrom", "p_partkey * 50 as start", "p_partkey * 50 + p_size * 10 as end", "concat('F', cast(p_partkey as string)) as name", "if(p_partkey % 2 = 0, '+', '-') as strand", "cast(p_size as long) as size")


FEATURES = """features AS (SELECT 'chr' || CAST(p_partkey % 5 + 1 AS VARCHAR) AS chrom, p_partkey * 50 AS "start", p_partkey * 50 + p_size * 10 AS "end", 'F' || CAST(p_partkey AS VARCHAR) AS name,
 CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(p_size AS BIGINT) AS size FROM part)"""


def reads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("concat('chr', cast(l_suppkey % 5 + 1 as string)) as chrom", "l_partkey * 50 + l_linenumber * 7 as start", "l_partkey * 50 + l_linenumber * 7 + cast(l_quantity as long) * 2 as end", "if(l_linestatus = 'O', '+', '-') as strand")


READS = """reads AS (SELECT 'chr' || CAST(l_suppkey % 5 + 1 AS VARCHAR) AS chrom, l_partkey * 50 + l_linenumber * 7 AS "start", l_partkey * 50 + l_linenumber * 7 + CAST(l_quantity AS BIGINT) * 2 AS "end",
 CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand FROM lineitem)"""


def fragments(spark: SparkSession, d: str) -> DataFrame:
    """Unique ids; two blocks each."""
    base = table(spark, d, "orders").selectExpr("o_orderkey as id", "o_custkey % 97 * 1000 + o_orderkey % 700 as start", "o_orderkey % 23 + 4 as n", "o_custkey")
    two = F.array(B.block(F.col("start"), F.col("start") + F.col("n")), B.block(F.col("start") + 100, F.col("start") + 100 + F.col("n")))
    return base.select("id", F.expr("concat('chr', cast(o_custkey % 97 % 5 + 1 as string))").alias("chrom"), "start", (F.col("start") + 100 + F.col("n")).alias("end"), two.alias("blocks"), F.expr("if(id % 3 = 0, '-', '+')").alias("strand"))


FRAGMENTS = """fragments AS (SELECT o_orderkey AS id, 'chr' || CAST(o_custkey % 97 % 5 + 1 AS VARCHAR) AS chrom, o_custkey % 97 * 1000 + o_orderkey % 700 AS "start",
 o_custkey % 97 * 1000 + o_orderkey % 700 + 100 + o_orderkey % 23 + 4 AS "end", o_orderkey % 23 + 4 AS n, CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '+' END AS strand FROM orders)"""


def exons(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("q")).distinct()
    k = F.row_number().over(Window.partitionBy("part").orderBy("q")) - 1
    return q.withColumn("k", k.cast("long")).withColumn("s", F.col("part") * 1000 + 100 * F.col("k")).withColumn("e", F.col("s") + F.col("q"))


EXONS = """exons AS (SELECT part, q, k, part * 1000 + 100 * k AS s, part * 1000 + 100 * k + q AS e FROM (SELECT part, q, row_number() OVER (PARTITION BY part ORDER BY q) - 1 AS k
 FROM (SELECT DISTINCT l_partkey AS part, CAST(l_quantity AS BIGINT) AS q FROM lineitem)))"""


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """part, chrom, start, end, name, strand, blocks, thick (from inside the first to inside the last block)."""
    b = F.array_sort(F.collect_list(F.struct("s", "e")))
    out = exons(spark, d).groupBy("part").agg(b.alias("blocks"))
    thick = F.when(F.col("part") % 4 != 0, B.block(B.first(F.col("blocks"))["s"], B.last(F.col("blocks"))["s"] + 1))
    return out.select("part", F.expr("concat('chr', cast(part % 5 + 1 as string))").alias("chrom"), B.first(F.col("blocks"))["s"].alias("start"), B.last(F.col("blocks"))["e"].alias("end"), F.expr("concat('T', cast(part as string))").alias("name"), F.expr("if(part % 2 = 0, '+', '-')").alias("strand"), "blocks", thick.alias("thick"))


TRANSCRIPTS = (
    EXONS
    + """, transcripts AS (SELECT part, 'chr' || CAST(part % 5 + 1 AS VARCHAR) AS chrom, min(s) AS "start", max(e) AS "end", 'T' || CAST(part AS VARCHAR) AS name, CASE WHEN part % 2 = 0 THEN '+' ELSE '-' END AS strand,
 list({'s': s, 'e': e} ORDER BY k) AS b, CASE WHEN part % 4 <> 0 THEN min(s) END AS ts, CASE WHEN part % 4 <> 0 THEN max(s) + 1 END AS te FROM exons GROUP BY part)"""
)

#: Tasks to which the parts' keys are dealt, for each core.
TASKS_A_CORE = 4
DNA_FROM, DNA_TO = "0123456789abcdef", "ACGTACGTACGTACGT"


def dna(spark: SparkSession, d: str) -> DataFrame:
    """64 bases for each part. A part is a few bytes in the file, which few tasks read, but much work later, so the keys are dealt."""
    s = F.translate(F.concat(F.md5(F.concat("k", F.lit("a"))), F.md5(F.concat("k", F.lit("b")))), DNA_FROM, DNA_TO)
    keys = table(spark, d, "part").select("p_partkey", "p_size").repartition(TASKS_A_CORE * spark.sparkContext.defaultParallelism, "p_partkey")
    return keys.select(F.col("p_partkey").alias("part"), F.col("p_partkey").cast("string").alias("k"), F.col("p_size").cast("long").alias("size")).withColumn("seq", s).drop("k")


DNA = """dna AS (SELECT p_partkey AS part, CAST(p_size AS BIGINT) AS size, translate(md5(CAST(p_partkey AS VARCHAR) || 'a') || md5(CAST(p_partkey AS VARCHAR) || 'b'), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM part)"""


def variants(spark: SparkSession, d: str) -> DataFrame:
    """SNPs: chrom, start, ref, alts."""
    return table(spark, d, "events").selectExpr("event_id", "concat('chr', cast(event_id % 5 + 1 as string)) as chrom", "event_id * 7 % 30011 as start", "substring('ACGT', cast(event_id % 4 + 1 as int), 1) as ref", "array(substring('CGTA', cast(event_id % 4 + 1 as int), 1)) as alts")


VARIANTS = """variants AS (SELECT event_id, 'chr' || CAST(event_id % 5 + 1 AS VARCHAR) AS chrom, event_id * 7 % 30011 AS "start", substring('ACGT', CAST(event_id % 4 + 1 AS INTEGER), 1) AS ref, substring('CGTA', CAST(event_id % 4 + 1 AS INTEGER), 1) AS alt FROM events)"""


def mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Event rows: fragment, chrom, pos, ref, alt, qual, dist, strand (from orders, several to a fragment)."""
    return table(spark, d, "orders").selectExpr("o_custkey as fragment", "o_orderkey as id", "concat('chr', cast(o_orderkey % 5 + 1 as string)) as chrom", "o_orderkey % 4000 as pos", "substring('ACGT', cast(o_orderkey % 4 + 1 as int), 1) as ref", "substring('GTAC-N', cast((o_orderkey + o_custkey) % 6 + 1 as int), 1) as alt", "cast(o_orderkey % 41 as int) as qual", "o_custkey % 30 as dist", "if(o_custkey % 2 = 0, '+', '-') as strand").filter("ref <> alt")


MISMATCHES = """mismatches AS (SELECT * FROM (SELECT o_custkey AS fragment, o_orderkey AS id, 'chr' || CAST(o_orderkey % 5 + 1 AS VARCHAR) AS chrom, o_orderkey % 4000 AS pos, substring('ACGT', CAST(o_orderkey % 4 + 1 AS INTEGER), 1) AS ref,
 substring('GTAC-N', CAST((o_orderkey + o_custkey) % 6 + 1 AS INTEGER), 1) AS alt, CAST(o_orderkey % 41 AS INTEGER) AS qual, o_custkey % 30 AS dist, CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM orders) WHERE ref <> alt)"""
