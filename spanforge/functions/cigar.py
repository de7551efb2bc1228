"""Decoding of CIGAR strings and MD tags, as column expressions.

A read's bases have three coordinates: mapped (M and D bases, as MD counts), read (position in the sequence) and
genomic. Operations P, = and X aren't supported and make the query fail. Hard clips take no bases of the sequence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EVENTS
from . import blocks as B
from .let import let

OPS = "array<struct<op:string,m0:bigint,m1:bigint,r0:bigint,r1:bigint,g0:bigint,g1:bigint>>"
MD = "array<struct<kind:string,m0:bigint,m1:bigint,bases:string>>"


def tokens(cigar: Column) -> Column:
    """array of struct(n, op)."""
    parts = F.regexp_extract_all(cigar, F.lit(r"([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda t: F.struct(F.substring(t, 1, F.length(t) - 1).cast("long").alias("n"), F.right(t, F.lit(1)).alias("op")))


def operations(cigar: Column, start: Column) -> Column:
    """Every operation with its mapped, read and genomic range."""
    state = F.struct(F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("r"), start.cast("long").alias("g"), F.array().cast(OPS).alias("out"))

    def step(a: Column, t: Column) -> Column:
        n = lambda ops: F.when(t["op"].isin(*ops), t["n"]).otherwise(F.lit(0).cast("long"))
        op = F.when(t["op"].isin(*"MIDNSH"), t["op"]).otherwise(F.raise_error(F.concat(F.lit("unsupported CIGAR operation "), t["op"])))
        m, r, g = a["m"] + n("MD"), a["r"] + n("MIS"), a["g"] + n("MDN")
        row = F.struct(op.alias("op"), a["m"].alias("m0"), m.alias("m1"), a["r"].alias("r0"), r.alias("r1"), a["g"].alias("g0"), g.alias("g1"))
        return F.struct(m.alias("m"), r.alias("r"), g.alias("g"), F.concat(a["out"], F.array(row)).cast(OPS).alias("out"))

    return F.aggregate(tokens(cigar), state, step, lambda a: a["out"])


def blocks(cigar: Column, start: Column, fill_gap: bool = True) -> Column:
    """Genomic blocks of a read: M (and D, if fill_gap), joined where they touch; N separates."""
    used = F.filter(operations(cigar, start), lambda x: x["op"].isin("M", "D") if fill_gap else x["op"] == "M")
    return B.suture(F.transform(used, lambda x: B.block(x["g0"], x["g1"])))


def _sum(cigar: Column, ops: str) -> Column:
    return F.aggregate(F.filter(tokens(cigar), lambda t: t["op"].isin(*ops)), F.lit(0).cast("long"), lambda n, t: n + t["n"])


def mapped_length(cigar: Column) -> Column:
    """M and D bases."""
    return _sum(cigar, "MD")


def reference_length(cigar: Column) -> Column:
    """Genomic bases from start to end."""
    return _sum(cigar, "MDN")


def clipped(cigar: Column) -> Column:
    """struct(left, right): clipped bases at either end, by the outermost operation."""
    n = lambda x: F.when(x["op"].isin("S", "H"), x["n"]).otherwise(F.lit(0).cast("long"))
    return let(tokens(cigar), lambda t: F.struct(n(F.get(t, F.lit(0))).alias("left"), F.when(F.size(t) > 1, n(F.get(t, F.size(t) - 1))).otherwise(F.lit(0).cast("long")).alias("right")))


def merge_deletions(cigar: Column, start: Column) -> Column:
    """M ranges with the deletions next to them taken in (other operations are left out)."""
    return blocks(cigar, start, True)


def qualities(qual: Column) -> Column:
    """Phred scores of a quality string; `*` has none."""
    return F.when(qual != "*", F.transform(F.split(qual, ""), lambda c: F.ascii(c) - 33))


def aligned_sequence(cigar: Column, seq: Column) -> Column:
    """The read without clips and insertions, - for deleted bases."""
    ops = F.filter(operations(cigar, F.lit(0)), lambda x: x["op"].isin("M", "D"))
    return F.array_join(F.transform(ops, lambda x: F.when(x["op"] == "D", F.repeat(F.lit("-"), (x["m1"] - x["m0"]).cast("int"))).otherwise(F.substring(seq, x["r0"].cast("int") + 1, (x["r1"] - x["r0"]).cast("int")))), "")


def aligned_qualities(cigar: Column, qual: Column) -> Column:
    """Scores as aligned_sequence has bases, -1 for deleted ones."""
    ops = F.filter(operations(cigar, F.lit(0)), lambda x: x["op"].isin("M", "D"))
    return let(qualities(qual), lambda scores: F.flatten(F.transform(ops, lambda x: F.when(x["op"] == "D", F.array_repeat(F.lit(-1), (x["m1"] - x["m0"]).cast("int"))).otherwise(F.slice(scores, x["r0"].cast("int") + 1, (x["r1"] - x["r0"]).cast("int"))))))


def query_base(cigar: Column, start: Column, seq: Column, pos: Column) -> Column:
    """The read's base at a genomic position: - if deleted there, null if skipped or outside."""
    found = F.get(F.filter(operations(cigar, start), lambda x: (x["g0"] <= pos) & (pos < x["g1"])), F.lit(0))
    return let(found, lambda at: F.when(at["op"] == "M", F.substring(seq, (at["r0"] + pos - at["g0"]).cast("int") + 1, F.lit(1))).when(at["op"] == "D", "-"))


def parse_md(md: Column) -> Column:
    """Items of an MD tag with their mapped range: = matches, X one mismatch, D a deletion (bases: the reference's)."""
    parts = F.regexp_extract_all(md, F.lit(r"([0-9]+|\^[A-Z]+|[A-Z])"), F.lit(1))
    state = F.struct(F.lit(0).cast("long").alias("m"), F.array().cast(MD).alias("out"))

    def step(a: Column, t: Column) -> Column:
        digit, gone = t.rlike("^[0-9]"), t.startswith("^")
        n = F.when(digit, t.cast("long")).when(gone, F.length(t) - 1).otherwise(1).cast("long")
        bases = F.when(gone, F.substring(t, 2, F.length(t))).when(~digit, t)
        row = F.struct(F.when(digit, "=").when(gone, "D").otherwise("X").alias("kind"), a["m"].alias("m0"), (a["m"] + n).alias("m1"), bases.alias("bases"))
        return F.struct((a["m"] + n).alias("m"), F.concat(a["out"], F.array(row)).cast(MD).alias("out"))

    return F.aggregate(parts, state, step, lambda a: a["out"])


def snvs(cigar: Column, start: Column, md: Column, seq: Column, qual: Column) -> Column:
    """All differences with every coordinate: array of struct(kind, m0, m1, r0, r1, g0, g1, ref, alt, quals), by mapped position."""
    return let(operations(cigar, start), lambda ops: let(qualities(qual), lambda scores: _snvs(ops, scores, md, seq)))


def _snvs(ops: Column, scores: Column, md: Column, seq: Column) -> Column:
    items = F.filter(parse_md(md), lambda x: x["kind"] != "=")
    none = F.lit(None).cast("string")
    row = lambda kind, m0, m1, r0, r1, g0, g1, ref, alt, q: F.struct(kind.alias("kind"), m0.alias("m0"), m1.alias("m1"), r0.alias("r0"), r1.alias("r1"), g0.alias("g0"), g1.alias("g1"), ref.alias("ref"), alt.alias("alt"), q.alias("quals"))
    sub = lambda x, a, b: F.substring(x, a.cast("int") + 1, (b - a).cast("int"))
    cut = lambda a, b: F.slice(scores, a.cast("int") + 1, (b - a).cast("int"))
    inserted = F.transform(F.filter(ops, lambda x: x["op"] == "I"), lambda x: row(F.lit("I"), x["m0"], x["m1"], x["r0"], x["r1"], x["g0"], x["g1"], none, sub(seq, x["r0"], x["r1"]), cut(x["r0"], x["r1"])))

    def listed(i: Column) -> Column:
        holder = F.get(F.filter(ops, lambda x: (x["op"] == F.when(i["kind"] == "X", "M").otherwise("D")) & (x["m0"] <= i["m0"]) & (i["m1"] <= x["m1"])), F.lit(0))
        return let(holder, lambda o: placed(i, o))

    def placed(i: Column, o: Column) -> Column:
        off = i["m0"] - o["m0"]
        r0, g0 = o["r0"] + F.when(i["kind"] == "X", off).otherwise(0), o["g0"] + off
        r1 = F.when(i["kind"] == "X", r0 + 1).otherwise(r0)
        alt = F.when(i["kind"] == "X", sub(seq, r0, r1))
        return row(i["kind"], i["m0"], i["m1"], r0, r1, g0, g0 + i["m1"] - i["m0"], i["bases"], alt, F.when(i["kind"] == "X", cut(r0, r1)))

    return F.array_sort(F.concat(inserted, F.transform(items, listed)), lambda a, b: F.when(a["m0"] < b["m0"], -1).when(a["m0"] > b["m0"], 1).when(a["m1"] < b["m1"], -1).when(a["m1"] > b["m1"], 1).otherwise(0))


def events(cigar: Column, start: Column, md: Column, seq: Column, qual: Column, deletions: bool = True, insertions: bool = True) -> Column:
    """Mismatches, deletions (alt -, quality 0) and insertions (ref -), sorted; dist: mapped bases to the nearer end."""
    return let(mapped_length(cigar), lambda n: _events(n, snvs(cigar, start, md, seq, qual), deletions, insertions))


def _events(n: Column, found: Column, deletions: bool, insertions: bool) -> Column:
    all_ = F.filter(found, lambda x: (x["kind"] == "X") | ((x["kind"] == "D") & F.lit(deletions)) | ((x["kind"] == "I") & F.lit(insertions)))
    dist = lambda x: F.when(x["kind"] == "X", F.least(x["m0"], n - x["m0"] - 1)).when(x["kind"] == "D", F.least(x["m0"], n - x["m1"])).otherwise(F.least(x["m0"], n - x["m0"]))
    row = lambda x: F.struct(x["g0"].alias("pos"), F.coalesce(x["ref"], F.lit("-")).alias("ref"), F.coalesce(x["alt"], F.lit("-")).alias("alt"), F.coalesce(x["quals"], F.array(F.lit(0))).alias("qual"), dist(x).alias("dist"))
    return F.array_sort(F.transform(all_, row)).cast(EVENTS)


def base_events(cigar: Column, start: Column, md: Column, seq: Column, qual: Column) -> Column:
    """Mismatches and deletions, these with an event for each base (alt -, quality 0); dist: mapped bases to the nearer end."""
    return let(mapped_length(cigar), lambda n: _base_events(n, snvs(cigar, start, md, seq, qual)))


def _base_events(n: Column, found: Column) -> Column:
    row = lambda x, i: F.struct((x["g0"] + i).alias("pos"), F.substring(x["ref"], i.cast("int") + 1, F.lit(1)).alias("ref"), F.coalesce(x["alt"], F.lit("-")).alias("alt"), F.coalesce(x["quals"], F.array(F.lit(0))).alias("qual"), F.least(x["m0"] + i, n - 1 - x["m0"] - i).alias("dist"))
    each = lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["m1"] - x["m0"] - 1), lambda i: row(x, i))
    return F.flatten(F.transform(F.filter(found, lambda x: x["kind"] != "I"), each)).cast(EVENTS)


def reference_sequence(cigar: Column, md: Column, seq: Column) -> Column:
    """The reference's bases under the mapped bases, from the read and its MD tag."""
    return let(aligned_sequence(cigar, seq), lambda read: F.array_join(F.transform(parse_md(md), lambda i: F.coalesce(i["bases"], F.substring(read, i["m0"].cast("int") + 1, (i["m1"] - i["m0"]).cast("int")))), ""))


def encode_events(e: Column) -> Column:
    """Events as text: pos,ref,alt,qual,dist joined by ; with the scores of long insertions joined by /."""
    one = lambda x: F.concat_ws(",", x["pos"].cast("string"), x["ref"], x["alt"], F.array_join(x["qual"].cast("array<string>"), "/"), x["dist"].cast("string"))
    return F.array_join(F.transform(e, one), ";")


def decode_events(t: Column) -> Column:
    """Events from text; empty text has none."""
    part = lambda p, i: F.get(p, F.lit(i))
    row = lambda p: F.struct(part(p, 0).cast("long").alias("pos"), part(p, 1).alias("ref"), part(p, 2).alias("alt"), F.split(part(p, 3), "/").cast("array<int>").alias("qual"), part(p, 4).cast("long").alias("dist"))
    one = lambda x: let(F.split(x, ","), row)
    return let(t, lambda v: F.when(v == "", F.array().cast(EVENTS)).otherwise(F.transform(F.split(v, ";"), one).cast(EVENTS)))
