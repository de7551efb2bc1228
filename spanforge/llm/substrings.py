"""Removal of word windows that occur earlier in the corpus (Rabin-Karp hashes counted in Spark).

Every window of `length` consecutive words gets a polynomial hash. Map tasks keep the first occurrence
that they see of a hash, so a passage that a third of all documents share costs one entry for each task.
Entries meet in buckets, chosen by the smallest hash of any few words inside the window, so that neighbouring
windows mostly share a bucket and travel as runs; the number of buckets follows the input, so a bucket's size
doesn't. A hash that chooses the bucket of too many different windows (those around a common line) is found by a
count over a sample of the window keys beforehand; its windows are dealt by their own hashes. Every occurrence after the smallest (doc_id, start) is reported, as runs again; the reported runs of a
document merge into maximal intervals, and one join applies them.

Defined results: null or empty texts have no words and stay empty; a document shorter than the window
loses nothing; rows with the same doc_id and text are one document and don't remove each other; a null
doc_id comes last in the order; other columns pass through, and output columns replace columns of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import U64, chunks, flat, lists, mix, small_batches, text_bytes, trim, words

#: Bases of the two polynomial hashes.
BASE_KEY, BASE_BUCKET = U64(0x9E6C63D0876A9A47), U64(0xD1342543DE82EF95)
LAST = np.iinfo(np.int64).max
#: Hashes whose windows are dealt one by one at most (a window has one such hash, so a share of all windows bounds them);
#: windows that a sample of window keys is to count of such a hash; one key in so many is in the sample at most.
MOST_HEAVY, COUNTED, THINNEST = 50_000, 128, 256
#: Words behind the hash that chooses a window's bucket.
INNER = 5
ENTRIES = "bucket int, h array<long>, rid array<long>, ord array<long>, at array<int>, cnt array<int>, drop_rid array<long>, drop_low array<int>, drop_high array<int>"


def rolling(values: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """The polynomial hash of each `length` consecutive values, by doubling."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, power, span, factor = None, 0, values, 1, np.array([base])
    while length:
        if length & 1:
            if out is None:
                out, have = power, span
            else:
                out = out[: len(power) - have] * factor + power[have : have + len(out)] if len(power) > have else out[:0]
                have += span
        length >>= 1
        if length:
            power = power[:-span] * factor + power[span:]
            factor, span = np.multiply(factor, factor, dtype=np.uint64), span * 2
    return out[:n]


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` consecutive values."""
    span = 1
    while 2 * span <= width:
        values, span = np.minimum(values[:-span], values[span:]) if len(values) > span else values[:0], 2 * span
    rest = width - span
    return values if not rest else np.minimum(values[:-rest], values[rest:]) if len(values) > rest else values[:0]


def _windows(table: pa.Table, length: int):
    """Of each window in a table of documents: key, bucket hash, row and start, in the order of (ord, start)."""
    table = table.take(pa.array(np.argsort(np.asarray(table["_ord"]), kind="stable")))
    w = words(table["_text"])
    hashes = w.hashes()
    counts = np.maximum(w.counts - length + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(w.first[:-1], counts) + start
    key = rolling(hashes, length, BASE_KEY)[at]
    inner = min(INNER, length)
    other = smallest(mix(rolling(hashes, inner, BASE_BUCKET)), length - inner + 1)[at]
    return table, mix(key), mix(other), row, start


def _frequent(length: int, rate: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "_text", limit):
            _, key, other, _, _ = _windows(table, length)
            at = np.flatnonzero(key % U64(rate) == 0)
            _, first = np.unique(key[at], return_index=True)
            some, n = np.unique(other[at[first]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)), pa.array(n.astype(np.int64))], ["o", "n"])

    return run


def heavy(tagged: DataFrame, length: int, total: int, bucket_bytes: int, batch_bytes: int) -> np.ndarray:
    """The sorted bucket hashes of more windows (different ones in a map step) than a quarter of a bucket's text has, at most MOST_HEAVY."""
    most = max(bucket_bytes // 24, total // 2 // MOST_HEAVY)  # a word and its space have two bytes at least, mostly six
    rate = max(1, min(THINNEST, most // COUNTED))
    counts = tagged.select("_rid", "_ord", "_text").mapInArrow(_frequent(length, rate, batch_bytes), "o long, n long").groupBy("o").agg(F.sum("n").alias("n"))
    found = counts.filter(F.col("n") * rate > most).orderBy(F.desc("n"), "o").limit(MOST_HEAVY).select("o").collect()  # the rest would be lighter
    return np.sort(np.array([r["o"] for r in found], np.int64).view(np.uint64))


def runs(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last start of each run of consecutive starts."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    return row[head], start[head], start[np.append(head[1:], len(row)) - 1] if len(row) else start


def _entries(length: int, buckets: int, limit: int, shared):
    names = [x.split()[0] for x in ENTRIES.split(", ")]
    none = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "_text", limit):
            table, key, other, row, start = _windows(table, length)
            rid, order = np.asarray(table["_rid"]), np.asarray(table["_ord"])
            if len(shared.value):
                at = np.minimum(np.searchsorted(shared.value, other), len(shared.value) - 1)
                other = np.where(shared.value[at] == other, mix(key), other)
            by = np.argsort(key, kind="stable")
            same = np.zeros(len(by), bool)
            same[1:] = (key[by[1:]] == key[by[:-1]]) & (other[by[1:]] == other[by[:-1]])
            heads = np.flatnonzero(~same)
            head = by[np.repeat(heads, np.diff(np.append(heads, len(by))))]
            later = (order[row[by]] > order[row[head]]) | ((order[row[by]] == order[row[head]]) & (start[by] > start[head]))
            gone = np.sort(by[later])
            keep = np.ones(len(key), bool)
            keep[gone] = False
            keep = np.flatnonzero(keep)
            bucket = ((other[keep] >> U64(32)) * U64(buckets) >> U64(32)).astype(np.uint16 if buckets < 65536 else np.uint32)
            by = np.argsort(bucket, kind="stable")
            keep, bucket = keep[by], bucket[by].astype(np.int32)
            r, s = row[keep], start[keep]
            edge = np.ones(len(keep) + 1, bool)
            edge[1:-1] = (bucket[1:] != bucket[:-1]) | (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)
            edges = np.flatnonzero(edge) if len(keep) else np.zeros(1, np.int64)
            first = edges[:-1]
            cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
            cut_runs = np.searchsorted(edges, cut)
            n = len(cut) - 1
            if n:
                cols = [pa.array(bucket[cut[:-1]], pa.int32()), lists(key[keep].view(np.int64), cut, pa.int64())]
                cols += [lists(v, cut_runs, k) for v, k in ((rid[r[first]], pa.int64()), (order[r[first]], pa.int64()), (s[first].astype(np.int32), pa.int32()), (np.diff(edges).astype(np.int32), pa.int32()))]
                cols += [lists(none, np.zeros(n + 1, np.int64), k) for k in (pa.int64(), pa.int32(), pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names)
            if len(gone):
                where, low, high = runs(row[gone], start[gone])
                empty, one = np.zeros(2, np.int64), np.array([0, len(where)])
                cols = [pa.array([int(key[0] % U64(buckets))], pa.int32())]
                cols += [lists(none, empty, k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())]
                cols += [lists(v, one, k) for v, k in ((rid[where], pa.int64()), (low.astype(np.int32), pa.int32()), (high.astype(np.int32), pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _reported(table: pa.Table) -> pa.Table:
    """Of one bucket's entries: runs of windows that occur earlier, as (document, first start, last start)."""
    key = flat(table["h"], np.int64)[0]
    count = flat(table["cnt"], np.int64)[0]
    entry = np.repeat(np.arange(len(count)), count)
    start = flat(table["at"], np.int64)[0][entry] + np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
    by = np.argsort(key)
    sorted_key = key[by]
    twin = np.zeros(len(by), bool)
    twin[1:] = sorted_key[1:] == sorted_key[:-1]
    twin[:-1] |= twin[1:]
    at = by[twin]
    order = flat(table["ord"], np.int64)[0][entry[at]]
    by = np.lexsort((start[at], order, key[at]))
    at, order = at[by], order[by]
    k, s = key[at], start[at]
    new = np.ones(len(at), bool)
    new[1:] = k[1:] != k[:-1]
    heads = np.flatnonzero(new)
    head = np.repeat(heads, np.diff(np.append(heads, len(at))))
    later = (order > order[head]) | (s > s[head])
    rid, s = flat(table["rid"], np.int64)[0][entry[at[later]]], s[later]
    by = np.lexsort((s, rid))
    found = runs(rid[by], s[by])
    drops = [flat(table[c], np.int64)[0] for c in ("drop_rid", "drop_low", "drop_high")]
    rid, low, high = (np.concatenate(x) for x in zip(found, drops, strict=True))
    del key, entry, start, by, sorted_key, twin, at, order
    trim()
    return pa.table({"_rid": pa.array(rid, pa.int64()), "low": pa.array(low.astype(np.int32)), "high": pa.array(high.astype(np.int32))})


def _packed(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for table in chunks(batches, "_text", limit):
            for b in table.to_batches():
                buf, offsets = text_bytes(b.column("_text"))
                raw = buf.tobytes()
                packed = pa.array([pack.compress(raw[x:y]) for x, y in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
                yield b.set_column(b.schema.get_field_index("_text"), "_text", packed)

    return run


def _applied(length: int, names: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            texts, kept, counts, removed, spans = [], [], [], [], []
            for packed, reported, absent in zip(b.column("_text"), b.column("_runs"), b.column("_null").to_pylist(), strict=True):
                raw = unpack.decompress(packed.as_buffer())
                mine = raw.split()
                counts.append(len(mine))
                texts.append(None if absent else raw.decode())
                if not reported.is_valid or not len(reported):
                    removed.append(0)
                    spans.append([])
                    kept.append(b" ".join(mine).decode())
                    continue
                low, high = (np.asarray(reported.values.field(i)) for i in (0, 1))
                by = np.argsort(low)
                low, reach = low[by], np.maximum.accumulate(high[by]) + length
                cut = np.flatnonzero(low[1:] > reach[:-1]) + 1
                low, high = low[np.insert(cut, 0, 0)], reach[np.append(cut, len(low)) - 1]
                # intervals that touch are one
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(low, high, strict=True)])
                removed.append(int((high - low).sum()))
                edges = [0, *np.stack([low, high], 1).ravel().tolist(), len(mine)]
                kept.append(b" ".join([w for x, y in zip(edges[::2], edges[1::2], strict=True) for w in mine[x:y]]).decode())
            made = {text: pa.array(texts, pa.string()), "kept_text": pa.array(kept, pa.string()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "removed_spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))}
            yield pa.RecordBatch.from_arrays([made[x] if x in made else b.column(x) for x in names], names)
        trim()

    return run


def windows(tagged: DataFrame, length: int, bucket_bytes: int, batch_bytes: int) -> DataFrame:
    """ENTRIES of all windows of tagged (_rid, _ord, _text)."""
    total = tagged.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = int(max(8, -(-total // bucket_bytes)))
    shared = tagged.sparkSession.sparkContext.broadcast(heavy(tagged, length, total, bucket_bytes, batch_bytes))  # MOST_HEAVY hashes at most
    return tagged.select("_rid", "_ord", "_text").mapInArrow(_entries(length, buckets, batch_bytes, shared), ENTRIES)


def remove_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 20, bucket_bytes: int = 20 << 20, batch_bytes: int = 5 << 20) -> DataFrame:
    """df with kept_text (kept words joined by a space), n_words, n_removed and removed_spans (word intervals).

    bucket_bytes and batch_bytes bound the text whose windows one reduce group or one map step holds at a time.
    """
    small_batches(df.sparkSession)
    made = {"kept_text", "n_words", "n_removed", "removed_spans"}
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in made])
    tagged = base.withColumns({"_rid": F.xxhash64(F.col(doc_id), F.col(text)), "_ord": F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)), "_null": F.col(text).isNull()}).withColumnRenamed(text, "_text")
    entries = windows(tagged, length, bucket_bytes, batch_bytes)
    reported = entries.groupBy("bucket").applyInArrow(_reported, "_rid long, low int, high int").groupBy("_rid").agg(F.collect_list(F.struct("low", "high")).alias("_runs"))
    packed = tagged.drop("_ord")
    schema = T.StructType([T.StructField("_text", T.BinaryType()) if f.name == "_text" else f for f in packed.schema])
    joined = packed.mapInArrow(_packed(batch_bytes), schema).join(reported, "_rid", "left")
    out = T.StructType([*base.schema.fields, *T._parse_datatype_string("kept_text string, n_words long, n_removed long, removed_spans array<struct<start:int,end:int>>").fields])
    return joined.mapInArrow(_applied(length, out.names, text), out)
