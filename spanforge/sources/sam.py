"""Alignments: SAM text and BAM files.

SAM is parsed with column expressions. BAM files are gzip members of binary records; each file is decoded by one
task in a streaming pass, and rows come in Arrow batches. Rows become members of a file in the tasks that hold them.
"""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions.let import once
from ..operators import pairing as P
from ..schema import READ
from .text import TAB, last_wins

#: Fixed codes of BAM.
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
NUMBER_TAGS = ("NM", "NH", "HI", "AS")
NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def parse_sam(df: DataFrame) -> DataFrame:
    """Reads of SAM lines (header lines are left out); tags are values without their types."""
    body = once(df.filter(~F.col("value").startswith("@") & (F.trim("value") != "")).select("value"), parts=F.split("value", TAB))
    at = lambda i: F.get("parts", F.lit(i))
    tags = F.transform(F.slice("parts", 12, F.greatest(F.size("parts") - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, 6, 1 << 30).alias("v")))
    star = lambda c: F.when(c != "*", c)
    next_chrom = F.when(at(6) == "=", at(2)).otherwise(star(at(6)))
    return body.select(at(0).alias("qname"), at(1).cast("int").alias("flag"), star(at(2)).alias("chrom"), (at(3).cast("long") - 1).alias("start"), at(4).cast("int").alias("mapq"), at(5).alias("cigar"), next_chrom.alias("next_chrom"), (at(7).cast("long") - 1).alias("next_start"), at(8).cast("long").alias("tlen"), at(9).alias("seq"), at(10).alias("qual"), last_wins(tags).alias("tags"))


def sam_line(number_tags: tuple[str, ...] = NUMBER_TAGS) -> Column:
    """A SAM line; tags are text (Z) except for the named whole numbers (i)."""
    tag = lambda e: F.concat(e["key"], F.when(e["key"].isin(*number_tags), ":i:").otherwise(":Z:"), e["value"])
    fixed = [F.col("qname"), F.col("flag").cast("string"), F.coalesce("chrom", F.lit("*")), (F.col("start") + 1).cast("string"), F.coalesce(F.col("mapq"), F.lit(255)).cast("string"), F.coalesce("cigar", F.lit("*")), F.when(F.col("next_chrom") == F.col("chrom"), "=").otherwise(F.coalesce("next_chrom", F.lit("*"))), (F.coalesce("next_start", F.lit(-1)) + 1).cast("string"), F.coalesce("tlen", F.lit(0)).cast("string"), F.coalesce("seq", F.lit("*")), F.coalesce("qual", F.lit("*"))]
    return F.concat_ws(TAB, *fixed, F.transform(F.map_entries("tags"), tag))


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_sam(spark.read.text(path))


def header(spark: SparkSession, path: str) -> DataFrame:
    """The header lines of a SAM file."""
    return spark.read.text(path).filter(F.col("value").startswith("@"))


def write_sam(df: DataFrame, path: str) -> None:
    """Lines without header, a file for each partition; gzip where the path ends in .gz."""
    df.select(sam_line().alias("value")).write.text(path, compression="gzip" if path.endswith(".gz") else "none")


def _exactly(f: io.BufferedIOBase, n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise ValueError("a BAM file breaks off")
    return data


def _tags(data: bytes) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(data):
        key, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind in "ZH":
            end = data.index(0, at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            code = NUMBERS[sub]
            values = struct.unpack_from(f"<{n}{code[1]}", data, at + 5)
            value, at = ",".join([sub, *(f"{x:g}" if sub == "f" else str(x) for x in values)]), at + 5 + n * struct.calcsize(code)
        else:
            code = NUMBERS[kind]
            x = struct.unpack_from(code, data, at)[0]
            value, at = f"{x:g}" if kind == "f" else str(x), at + struct.calcsize(code)
        out.append((key, value))
    return out


def _head(f: io.BufferedIOBase) -> tuple[str, list[tuple[str, int]]]:
    """The header text and the references with their lengths, from an opened BAM file's begin."""
    if _exactly(f, 4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    text = _exactly(f, struct.unpack("<i", _exactly(f, 4))[0]).rstrip(b"\0").decode()
    found = []
    for _ in range(struct.unpack("<i", _exactly(f, 4))[0]):
        name = _exactly(f, struct.unpack("<i", _exactly(f, 4))[0])[:-1].decode()
        found.append((name, struct.unpack("<i", _exactly(f, 4))[0]))
    return text, found


def decode_bam(f: io.BufferedIOBase) -> Iterator[tuple]:
    """The rows (as READ) of an opened BAM file, in file order."""
    names: list[str | None] = [n for n, _ in _head(f)[1]]
    names.append(None)  # reference -1
    while head := f.read(4):
        data = _exactly(f, struct.unpack("<i", head)[0])
        ref, pos, l_name, mapq, _, n_ops, flag, n, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
        at = 32
        name = data[at : at + l_name - 1].decode()
        at += l_name
        ops = struct.unpack_from(f"<{n_ops}I", data, at)
        at += 4 * n_ops
        packed = data[at : at + (n + 1) // 2]
        at += (n + 1) // 2
        qual = data[at : at + n]
        seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n] or "*"
        scores = "*" if not n or qual[0] == 255 else bytes(q + 33 for q in qual).decode()
        yield name, flag, names[ref], pos, mapq, "".join(f"{o >> 4}{OPS[o & 15]}" for o in ops) or "*", names[next_ref], next_pos, tlen, seq, scores, dict(_tags(data[at + n :]))


def read_bam(spark: SparkSession, path: str | list[str], batch: int = 4096) -> DataFrame:
    """Reads of BAM files, one task a file."""
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        cols[-1] = [list(m.items()) for m in cols[-1]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows: list[tuple] = []
                for row in decode_bam(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    rows.append(row)
                    if len(rows) >= batch:
                        yield flush(rows)
                        rows = []
                if rows:
                    yield flush(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)


def bam_header(spark: SparkSession, path: str) -> tuple[str, dict[str, int]]:
    """The header text of a BAM file and its references' lengths by name, in order: what write_bam() takes as a template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                text, found = _head(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())))
                yield pa.RecordBatch.from_arrays([pa.array([text]), pa.array([[(n, size) for n, size in found]], pa.map_(pa.string(), pa.int64()))], ["text", "found"])

    one = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "text string, found map<string,bigint>").first()
    return one["text"], dict(one["found"])


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return struct.pack("<BBBBIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def _members(pieces: Iterable[bytes], size: int = 60_000) -> Iterator[bytes]:
    out = bytearray()
    for piece in pieces:
        out += piece
        while len(out) >= size:
            yield _member(bytes(out[:size]))
            del out[:size]
    if out:
        yield _member(bytes(out))


def encode_header(references: dict[str, int], text: str = "@HD\tVN:1.6\n") -> bytes:
    """What a BAM file begins with, not yet packed; references: lengths by name, in order."""
    out = bytearray(b"BAM\x01" + struct.pack("<i", len(text.encode())) + text.encode() + struct.pack("<i", len(references)))
    for n, size in references.items():
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
    return bytes(out)


def encode_record(row: tuple, at: dict[str | None, int], number_tags: tuple[str, ...] = NUMBER_TAGS) -> bytes:
    """A row (as READ) as a record of a BAM file, not yet packed; at: places of the references, -1 for None."""
    qname, flag, chrom, start, mapq, cigar, next_chrom, next_start, tlen, seq, qual, tags = row
    ops, number = [], ""
    for c in "" if cigar in (None, "*") else cigar:
        if c.isdigit():
            number += c
        else:
            ops.append(int(number) << 4 | OPS.index(c))
            number = ""
    seq = "" if seq in (None, "*") else seq
    codes = [BASES.index(c) if c in BASES else 15 for c in seq] + [0]
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
    scores = bytes([255] * len(seq)) if qual in (None, "*") else bytes(ord(c) - 33 for c in qual)
    extra = b"".join(k.encode() + (b"i" + struct.pack("<i", int(v)) if k in number_tags else b"Z" + v.encode() + b"\0") for k, v in (tags or {}).items())
    fixed = struct.pack("<iiBBHHHiiii", at[chrom], start if start is not None else -1, len(qname) + 1, 255 if mapq is None else mapq, 0, len(ops), flag, len(seq), at[next_chrom], -1 if next_start is None else next_start, tlen or 0)
    record = fixed + qname.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + scores + extra
    return struct.pack("<i", len(record)) + record


def write_bam(df: DataFrame, path: str, references: dict[str, int], text: str = "@HD\tVN:1.6\n", number_tags: tuple[str, ...] = NUMBER_TAGS) -> None:
    """One BAM file on the driver's disk, in the DataFrame's order, with the given header.

    Tasks encode and pack their rows; the driver appends their packed members, one partition at a time. Tags are text (Z) except for
    the named whole numbers (i).
    """
    names = [x.split()[0] for x in READ.split(", ")]
    at: dict[str | None, int] = {n: i for i, n in enumerate(references)} | {None: -1}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        records = (encode_record((*r[:-1], dict(r[-1] or ())), at, number_tags) for r in rows)
        for member in _members(records):
            yield pa.RecordBatch.from_arrays([pa.array([member], pa.binary())], ["member"])

    with open(path, "wb") as f:
        for member in _members([encode_header(references, text)]):
            f.write(member)
        for r in df.select(*names).mapInArrow(run, "member binary").toLocalIterator():
            f.write(r["member"])
        f.write(_member(b""))


def alignments(reads: DataFrame, keep_unmapped: bool = False) -> DataFrame:
    """reads with end, strand and blocks; unmapped ones are left out (secondary and supplementary ones stay)."""
    kept = reads if keep_unmapped else reads.filter(~P.flag(P.UNMAPPED))
    out = kept.withColumns({"end": F.col("start") + C.reference_length(F.col("cigar")), "strand": F.when(P.flag(P.REVERSE), "-").otherwise("+"), "blocks": C.blocks(F.col("cigar"), F.col("start"))})
    return out
