"""Text formats of genomics as columns: parsers and formatters of lines, and readers and writers of files.

Parsers take a DataFrame with a text column `value` (as spark.read.text gives; .gz is read transparently) and
return typed columns; nothing needs Python workers. Malformed lines make the query fail, with the line in the
message, unless bad="null", which nulls their columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import sequence as S
from ..functions.let import exploded, let, once
from ..schema import BLOCKS

TAB = "\t"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of one or more files."""
    return spark.read.text(path)


def content(df: DataFrame) -> DataFrame:
    """Without blank and # lines."""
    return df.filter((F.trim("value") != "") & ~F.col("value").startswith("#"))


def comments(df: DataFrame) -> DataFrame:
    """The # lines."""
    return df.filter(F.col("value").startswith("#"))


def _checked(good: Column, value: Column, what: str, bad: str) -> Column:
    return F.when(good, value).otherwise(F.lit(None) if bad == "null" else F.raise_error(F.concat(F.lit(f"bad {what} line: "), F.col("value"))))


def _field(i: int) -> Column:
    return F.get(F.split(F.col("value"), TAB), F.lit(i))


def write_lines(df: DataFrame, line: Column, path: str) -> None:
    """One line for each row, in the DataFrame's partitions; gzip where the path ends in .gz."""
    df.select(line.alias("value")).write.text(path, compression="gzip" if path.endswith(".gz") else "none")


# BED


def parse_bed(df: DataFrame, ncol: int = 12) -> DataFrame:
    """chrom, start, end, name, score, strand, thick, color, blocks from BED lines of 3 to 12 columns, of which at most ncol are read."""
    if ncol < 3:
        raise ValueError("BED has at least three columns")
    df = once(df.select("value"), parts=F.split("value", TAB))
    _field = lambda i: F.get("parts", F.lit(i))
    n = F.least(F.size("parts"), F.lit(ncol))
    at = lambda i: F.when(n > i, _field(i))
    number = lambda i: at(i).cast("long")
    start, end = number(1), number(2)
    thick = F.when(number(6) < number(7), B.block(number(6), number(7)))
    ints = lambda i: F.transform(F.split(F.rtrim(_field(i), F.lit(",")), ","), lambda x: x.cast("long"))
    many = F.transform(F.arrays_zip(ints(11).alias("o"), ints(10).alias("n")), lambda x: B.block(start + x["o"], start + x["o"] + x["n"]))
    strand = F.when(at(5).isin("+", "-", "."), at(5))
    return df.select(at(0).alias("chrom"), start.alias("start"), end.alias("end"), at(3).alias("name"), F.when(at(4) != ".", at(4)).cast("double").alias("score"), strand.alias("strand"), thick.alias("thick"), at(8).alias("color"), F.when(n >= 12, many).otherwise(F.array(B.block(start, end))).cast(BLOCKS).alias("blocks"))


def bed_line(ncol: int = 12, score: str | None = "score", blocks: str | None = "blocks", thick: str | None = "thick", color: str | None = "color") -> Column:
    """A BED line of the first ncol columns; None: there is no such column. Without thick part both its columns are start;
    without colour it is 0,0,255 on + and 255,0,0 otherwise; lists end in a comma."""
    col = F.col
    b = col(blocks) if blocks else F.array(B.block(col("start"), col("end")))
    t = col(thick) if thick else F.lit(None).cast("struct<s:bigint,e:bigint>")
    number = F.when(col(score).isNull(), ".").otherwise(col(score).cast("string")) if score else F.lit(".")
    parts = [col("chrom"), col("start").cast("string"), col("end").cast("string"), F.coalesce(col("name"), F.lit("None")), number, F.coalesce(col("strand"), F.lit("None")), F.coalesce(t["s"], col("start")).cast("string"), F.coalesce(t["e"], col("start")).cast("string"), F.coalesce(col(color) if color else F.lit(None), F.when(col("strand") == "+", "0,0,255").otherwise("255,0,0")), F.size(b).cast("string"), F.concat(F.array_join(F.transform(b, lambda x: (x["e"] - x["s"]).cast("string")), ","), F.lit(",")), F.concat(F.array_join(F.transform(b, lambda x: (x["s"] - col("start")).cast("string")), ","), F.lit(","))]
    return F.concat_ws(TAB, *parts[:ncol])


def read_bed(spark: SparkSession, path: str | list[str], ncol: int = 12) -> DataFrame:
    return parse_bed(content(lines(spark, path)), ncol)


def write_bed(df: DataFrame, path: str, ncol: int = 12, **columns: str | None) -> None:
    write_lines(df, bed_line(ncol, **columns), path)


def parse_site_bed(df: DataFrame) -> DataFrame:
    """chrom, start, end, strand, ref, alt from a BED whose names are like A-G."""
    bed = parse_bed(df, 6)
    return bed.select("chrom", "start", "end", "strand", F.get(F.split("name", "-"), F.lit(0)).alias("ref"), F.get(F.split("name", "-"), F.lit(1)).alias("alt"))


# GTF and GFF3


def last_wins(pairs: Column) -> Column:
    """A map of array<struct<k, v>>; of equal keys the last counts, at the place of the first."""
    def folded(all_: Column) -> Column:
        keys = F.array_distinct(F.transform(all_, lambda p: p["k"]))
        return let(keys, lambda ks: F.when(F.size(ks) == F.size(all_), F.map_from_entries(all_)).otherwise(F.map_from_arrays(ks, F.transform(ks, lambda k: F.element_at(F.filter(all_, lambda p: p["k"] == k), -1)["v"]))))

    return let(pairs, folded)


def gtf_attributes(text: Column) -> Column:
    """The attribute column of GTF: key "value"; or key value; (; may stand inside quotes, an item without ; at the end is dropped)."""
    item = r"""([^ ;]+ +(?:"[^"]*"|[^";]+);)"""
    parts = F.regexp_extract_all(text, F.lit(item), F.lit(1))
    pair = lambda x: F.struct(F.regexp_extract(x, r"^([^ ]+)", 1).alias("k"), F.regexp_replace(F.regexp_extract(x, r"^[^ ]+ +(.*);$", 1), '^"(.*)"$', "$1").alias("v"))
    marked = lambda p: F.struct(F.substring_index(p, SPLIT, 1).alias("k"), F.substring_index(F.substring_index(p, CLOSE, 1), SPLIT, -1).alias("v"))
    quick = F.transform(F.slice(F.split(_gtf_marked(text), OPEN), 2, 1 << 30), marked)
    return last_wins(F.when(_odd(text), F.transform(parts, pair)).otherwise(quick))


#: What marks keys and values in _gtf_marked(), and what stands for it if a text has such characters itself.
OPEN, SPLIT, CLOSE, OTHER = "\x01", "\x02", "\x03", "\x04"


def _odd(text: Column) -> Column:
    """Whether attributes hold marks or line ends, which only the plain way of reading them deals with."""
    return text.rlike("[\\x01-\\x03\\n\\r\\x{85}\\x{2028}\\x{2029}]")


def _gtf_marked(text: Column) -> Column:
    """A GTF attribute column with marks around keys and values, by one pass of a pattern; what lies between items is left in."""
    item = r"""([^ ;]++) +(?:"([^"]*+)"|([^ ";][^";]*+)| );"""
    return F.regexp_replace(F.translate(text, OPEN + SPLIT + CLOSE, OTHER * 3), item, f"{OPEN}$1{SPLIT}$2$3{CLOSE}")


def _gtf_has(text: Column, key: str) -> Column:
    return F.contains(_gtf_marked(text), F.lit(OPEN + key + SPLIT))


def _gtf_usual(key: str) -> str:
    """A pattern of attributes that are all like key "value"; up to a key, whose value it holds."""
    return rf"""^(?:[^ ";]+ "[^"]*"; )*?{key} "([^"]*)";"""


def _gtf_value(text: Column, key: str) -> Column:
    """The last value of a key, null without it; where the key stands there once and in the usual form, with less work."""
    alone = F.length(text) - F.length(F.replace(text, F.lit(key), F.lit(""))) == len(key)
    marked = _gtf_marked(text)
    plain = F.when(_gtf_has(text, key), F.substring_index(F.substring_index(marked, OPEN + key + SPLIT, -1), CLOSE, 1))
    return F.when(alone & text.rlike(_gtf_usual(key)), F.regexp_extract(text, _gtf_usual(key), 1)).otherwise(plain)


def gff_attributes(text: Column) -> Column:
    """The attribute column of GFF3: k=v;k=v. Quotes are taken off, %-codes stay, an item without = is a key of its text."""
    parts = F.filter(F.split(text, ";"), lambda x: F.trim(x) != "")
    clean = lambda x: F.replace(x, F.lit('"'), F.lit(""))
    pair = lambda x: F.struct(F.when(F.contains(x, F.lit("=")), F.regexp_extract(x, "^([^=]*)=", 1)).otherwise(x).alias("k"), F.when(F.contains(x, F.lit("=")), clean(F.regexp_extract(x, "^[^=]*=(.*)$", 1))).otherwise(F.lit("")).alias("v"))
    return last_wins(F.transform(parts, lambda x: pair(F.trim(x))))


def _gff_has(text: Column, key: str) -> Column:
    return text.rlike(f"(?:^|;) *{key}(?:=| *(?:;|\\z))")


def _gff_value(text: Column, key: str) -> Column:
    """The last value of a key in a GFF3 attribute column; null without it."""
    found = F.regexp_extract(text, f"(?s)^(?:.*;)? *{key}(?:=([^;]*)| *(?:;|\\z))", 1)
    return F.when(F.contains(text, F.lit(key)) & _gff_has(text, key), F.replace(F.rtrim(found), F.lit('"'), F.lit("")))


def _features(df: DataFrame, attributes: Column, quick: dict[str, Column], needs: Column, what: str, bad: str) -> DataFrame:
    """quick: columns with the value of one attribute, got without the map, which is read only where it is asked for."""
    df = once(df.select("value"), parts=F.split("value", TAB))
    _field = lambda i: F.get("parts", F.lit(i))
    start, end = _field(3).cast("long") - 1, _field(4).cast("long")
    good = F.coalesce((F.size("parts") == 9) & (start >= 0) & (start < end) & _field(6).isin("+", "-", ".") & _field(7).isin("0", "1", "2", ".") & needs, F.lit(False))
    df = once(df, good=good)
    ok = lambda c: _checked(F.col("good"), c, what, bad)
    more = [ok(F.when(_odd(_field(8)), attributes[k]).otherwise(c)).alias(QUICK + k) for k, c in quick.items()]
    return df.select(ok(_field(0)).alias("chrom"), ok(_field(1)).alias("source"), ok(_field(2)).alias("feature"), ok(start).alias("start"), ok(end).alias("end"), ok(_field(5)).alias("score"), ok(_field(6)).alias("strand"), ok(_field(7)).alias("frame"), ok(attributes).alias("attributes"), *more)


#: Parsed features have the attributes that models are built from also as columns, of the key after this prefix.
QUICK = "attr_"


def attribute(features: DataFrame, key: str) -> Column:
    """An attribute of features: its own column where a parser made one, else from the map."""
    return F.col(QUICK + key) if QUICK + key in features.columns else F.col("attributes")[key]


def parse_gtf(df: DataFrame, bad: str = "fail") -> DataFrame:
    """Features of GTF lines. gene_id is needed, and transcript_id unless the feature is a gene."""
    text = F.get("parts", F.lit(8))
    has = lambda key: F.when(text.rlike(_gtf_usual(key)), True).otherwise(_gtf_has(text, key))
    needs = has("gene_id") & ((F.get("parts", F.lit(2)) == "gene") | has("transcript_id"))
    return _features(df, gtf_attributes(text), {k: _gtf_value(text, k) for k in ("gene_id", "transcript_id")}, needs, "GTF", bad)


def parse_gff(df: DataFrame, bad: str = "fail") -> DataFrame:
    """Features of GFF3 lines, with name: the ID, which is needed."""
    text = F.get("parts", F.lit(8))
    out = _features(df, gff_attributes(text), {k: _gff_value(text, k) for k in ("ID", "Parent")}, _gff_has(text, "ID"), "GFF", bad)
    return out.withColumnRenamed(QUICK + "ID", "name")


def _feature_line(attributes: Column) -> Column:
    parts = [F.col("chrom"), F.col("source"), F.col("feature"), (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.coalesce("score", F.lit(".")), F.coalesce("strand", F.lit(".")), F.coalesce("frame", F.lit("."))]
    return F.concat_ws(TAB, *parts, attributes)


def gtf_line() -> Column:
    """A GTF line; all values quoted."""
    return _feature_line(F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit(' "'), e["value"], F.lit('";'))), " "))


def gff_line() -> Column:
    return _feature_line(F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"))


def read_gtf(spark: SparkSession, path: str | list[str], bad: str = "fail") -> DataFrame:
    return parse_gtf(content(lines(spark, path)), bad)


def read_gff(spark: SparkSession, path: str | list[str], bad: str = "fail") -> DataFrame:
    return parse_gff(content(lines(spark, path)), bad)


def attribute_table(features: DataFrame, keys: list[str] | None = None, most_keys: int = 10_000) -> DataFrame:
    """One column for each attribute key that occurs (in code-point order), empty text where a feature has none.

    Without keys a first pass finds them; more than most_keys are refused.
    """
    if keys is None:
        found = exploded(features.select("attributes"), "k", F.map_keys("attributes")).select("k").distinct().orderBy("k").limit(most_keys + 1).collect()
        if len(found) > most_keys:
            raise ValueError(f"more than {most_keys} attribute keys")
        keys = [r["k"] for r in found]
    fixed = ["chrom", "source", "feature", "start", "end", "score", "strand", "frame"]
    return features.select(*fixed, *[F.coalesce(F.col("attributes")[k], F.lit("")).alias(f"attr_{k}" if k in fixed else k) for k in keys])


# VCF


def parse_vcf(df: DataFrame) -> DataFrame:
    """Single-base variants of 8-column VCF lines; INFO flags without value are keys of empty text."""
    info = last_wins(F.transform(F.filter(F.split(_field(7), ";"), lambda x: (x != "") & (x != ".")), lambda x: F.struct(F.regexp_extract(x, "^([^=]*)", 1).alias("k"), F.regexp_extract(x, "^[^=]*=?(.*)$", 1).alias("v"))))
    df = once(df.select("value"), parts=F.split("value", TAB), info=info)
    info = F.col("info")
    at = lambda i: F.get("parts", F.lit(i))
    start = at(1).cast("long") - 1
    good = F.coalesce((F.size("parts") == 8) & (F.length(at(3)) == 1) & (start >= 0) & at(5).rlike("^[0-9]+$"), F.lit(False))
    ok = lambda c: _checked(good, c, "VCF", "fail")
    return df.select(ok(at(0)).alias("chrom"), ok(start).alias("start"), ok(start + 1).alias("end"), ok(at(2)).alias("name"), F.coalesce(info["SB"], F.lit("+")).alias("strand"), ok(at(3)).alias("ref"), ok(F.split(at(4), ",")).alias("alts"), ok(at(5).cast("int")).alias("qual"), ok(at(6)).alias("filt"), ok(info).alias("info"))


def vcf_line() -> Column:
    """A VCF line; INFO starts with SB, which info may override."""
    rest = F.map_filter("info", lambda k, _: k != "SB")
    items = F.concat(F.array(F.concat(F.lit("SB="), F.coalesce(F.col("info")["SB"], F.col("strand"), F.lit("+")))), F.transform(F.map_entries(rest), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return F.concat_ws(TAB, "chrom", (F.col("start") + 1).cast("string"), F.coalesce("name", F.lit(".")), "ref", F.array_join("alts", ","), F.col("qual").cast("string"), F.coalesce("filt", F.lit(".")), F.array_join(items, ";"))


def read_vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_vcf(content(lines(spark, path)))


# FASTA and FASTQ


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name (the whole header line) and sequence. Records are cut at line ends followed by >."""
    raw = spark.read.option("lineSep", "\n>").text(path).filter(F.trim("value") != "")
    text = F.regexp_replace("value", "^>", "")
    head = F.trim(F.regexp_extract(text, r"^([^\r\n]*)", 1), F.lit("\r\n"))
    return raw.select(head.alias("name"), F.regexp_replace(F.regexp_replace(text, r"^[^\r\n]*", ""), r"\s+", "").alias("sequence"))


def fasta_record(width: int | None = 50) -> Column:
    return F.concat(F.lit(">"), F.col("name"), F.lit("\n"), S.wrapped(F.col("sequence"), width) if width else F.col("sequence"))


def parse_fai(df: DataFrame) -> DataFrame:
    """name, length, offset, line_bases, line_width of a FASTA index."""
    return df.select(_field(0).alias("name"), *[_field(i + 1).cast("long").alias(c) for i, c in enumerate(("length", "offset", "line_bases", "line_width"))])


def fetch(ranges: DataFrame, sequences: DataFrame, blocks: str | None = None, strandness: bool = True) -> DataFrame:
    """ranges (chrom, start, end, strand[, blocks]) with their sequence: of the span, or of the blocks in genomic order;
    reverse-complemented on - with strandness."""
    seq = sequences.select(F.col("name").alias("chrom"), F.col("sequence").alias("_contig"))
    strand = F.col("strand") if strandness else F.lit("+")
    b = F.col(blocks) if blocks else F.array(B.block(F.col("start"), F.col("end")))
    return ranges.join(seq, "chrom").withColumn("sequence", S.spliced(F.col("_contig"), b, strand)).drop("_contig")


def chunked(sequences: DataFrame, size: int = 1 << 16) -> DataFrame:
    """name, chunk, sequence: contigs cut into pieces, so that long ones spread over tasks."""
    n = F.greatest(F.ceil(F.length("sequence") / size), F.lit(1)).cast("int")
    return sequences.select("name", "sequence", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk")).select("name", F.col("chunk").cast("long").alias("chunk"), F.substring("sequence", F.col("chunk") * size + 1, F.lit(size)).alias("sequence"))


def fetch_chunked(ranges: DataFrame, chunks: DataFrame, key: str, size: int = 1 << 16) -> DataFrame:
    """As fetch() for spans, from chunked(): each range reads the chunks that it touches. key: a unique column of ranges."""
    touched = ranges.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))))
    # pieces are many more rows than the file of their contigs suggests, so they are never broadcast; nor are the ranges
    parts = touched.join(chunks.withColumnRenamed("name", "chrom").withColumnRenamed("sequence", "_part").hint("merge"), ["chrom", "chunk"])
    low = F.greatest(F.col("start") - F.col("chunk") * size, F.lit(0)).cast("int")
    high = F.least(F.col("end") - F.col("chunk") * size, F.lit(size)).cast("int")
    whole = parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", F.substring("_part", low + 1, high - low).alias("s")))), lambda x: x["s"]), "").alias("sequence"))
    out = ranges.join(whole.hint("merge"), key)
    return out.withColumn("sequence", F.when(F.col("strand") == "-", S.reverse_complement(F.col("sequence"))).otherwise(F.col("sequence")))


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name, sequence, quality of FASTQ files, strictly four lines a record; records may lie across file splits.

    A line's number in its file is its number in its split plus the lines of the splits before, which one count gives.
    """
    own = ["file", "split"]
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("i"))
    sizes = raw.groupBy(*own).agg(F.min("i").alias("low"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    placed = raw.join(sizes.select(*own, "low", F.coalesce(before, F.lit(0)).alias("before")), own).withColumn("line", F.col("before") + F.col("i") - F.col("low"))
    at = lambda k: F.max(F.when(F.col("line") % 4 == k, F.rtrim("value", F.lit("\r")))).alias(f"l{k}")
    records = placed.groupBy("file", F.expr("line div 4").alias("record")).agg(*[at(k) for k in range(4)]).filter("l0 <> '' or l1 is not null")
    good = F.coalesce(F.col("l0").startswith("@") & F.col("l2").startswith("+") & (F.length("l1") == F.length("l3")), F.lit(False))
    ok = lambda c: F.when(good, c).otherwise(F.raise_error(F.concat(F.lit("bad FASTQ record: "), F.coalesce("l0", F.lit("")))))
    return records.select(ok(F.substring("l0", 2, 1 << 30)).alias("name"), ok(F.col("l1")).alias("sequence"), ok(F.col("l3")).alias("quality"))


def fastq_record() -> Column:
    return F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col("sequence"), F.lit("\n+\n"), F.col("quality"))


def unique_reads(reads: DataFrame) -> DataFrame:
    """One record for each sequence: the first by name."""
    return reads.groupBy("sequence").agg(F.min(F.struct("name", "quality")).alias("x")).select("x.name", "sequence", "x.quality")


# tables


def parse_table(df: DataFrame, header: list[str]) -> DataFrame:
    """Tab-separated lines with named columns: start and end are numbers, thick is like 12-35, blocks like 10-20;30-40."""
    kinds = {"start": lambda c: c.cast("long"), "end": lambda c: c.cast("long"), "score": lambda c: F.when(c != ".", c).cast("double"), "thick": lambda c: F.get(B.parse(F.when(c != ".", c)), F.lit(0)), "blocks": lambda c: B.parse(c)}
    return df.select(*[kinds.get(h, lambda c: c)(_field(i)).alias(h) for i, h in enumerate(header)])


def table_line(header: list[str]) -> Column:
    one = {"thick": lambda c: F.when(c.isNotNull(), F.concat_ws("-", c["s"].cast("string"), c["e"].cast("string"))), "blocks": lambda c: B.text(c)}
    return F.concat_ws(TAB, *[F.coalesce(one[h](F.col(h)) if h in one else F.col(h).cast("string"), F.lit(".")) for h in header])


def read_table(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """A table file; without header its first line names the columns."""
    raw = lines(spark, path)
    if header is None:
        top = raw.limit(1).collect()[0]["value"]
        return parse_table(raw.filter(F.col("value") != top), top.split(TAB))
    return parse_table(raw, header)


