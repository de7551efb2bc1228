"""Near-duplicate groups by SimHash and covering locality-sensitive hashing.

Fingerprints are made in one pass. Documents with the same fingerprint become one node, so exact copies
cost nothing further. Each node enters 2^(r+1) - 1 tables, each keyed by the fingerprint under a structured
bit mask: bit i has a vector m(i) of r + 1 bits and mask v keeps bit i where <m(i), v> is odd. For any r
differing bits some v is orthogonal to all their vectors, so every pair within the radius meets in a table.
Within a key, links are replaced by a star around the smallest member of each linked part. The members of a
key with more than DIRECT of them go back to Spark and are divided by the same construction over the bits that
the masks so far left free; fingerprints are distinct, so a few such levels leave small keys only. Nothing is
capped, no pairs are emitted, and no task holds a large key. Stars join into components by alternating
large-star and small-star steps in Spark. The rows of a frequent fingerprint are dealt with salt.

near_texts() groups texts by the part of their shingles that they share. A radius of 3 bits finds next to none of
the pairs that share 0.8 of their five-word shingles (see README), so beside the covering tables each text has
further fingerprints, of bands of sampled shingles; of texts that share one, each is paired with the nearest by
SimHash and with the one at the group's middle. All pairs are checked exactly, by all their shingles. That joins most
of what belongs together, but not surely all, so a second pass (rest()) looks at every pair left that could be similar.
Shingles have one order, frequent ones last; of two similar texts the first shingle that they share lies early in both.
Texts of different groups meet by each of their early shingles, and drop out where the rest of the two can't hold enough
in common or the parities of their shingles differ in too many places, both of which are bounds. What is left is checked
exactly, a few pairs of two groups at a time, until the groups are joined or have no pair left.

Defined results: null and empty texts have fingerprint zero and link like any other; a null doc_id belongs
to its component and is never its id (a component of null doc_ids only has a null id); repeated rows each
get a row; other columns are left out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .flat import U64, chunks, mix, shared_dir, shuffles_freed, small_batches, text_bytes, words
from .substrings import BASE_KEY, rolling

SEED = 42
#: Up to so many members of a key are compared directly.
DIRECT = 512
#: Rows of a fingerprint beyond which they are dealt with salt, a part for each so many.
HOT = 100_000
#: Bands of a text, sampled shingles in each, and bits by which texts differ that surely aren't similar.
BANDS, ROWS, FAR = 16, 4, 28
#: For the order of shingles one text in SHARE is sampled, or more to have SAMPLE of them; how many of the sample a frequent shingle
#: is in, and how many of those are told apart.
SHARE, SAMPLE, OFTEN, FREQUENT = 4, 6_000, 3, 1 << 20
#: Entries of a shingle in one task, and pairs of two groups checked in the first round (each later round: so many times more).
BLOCK, ROUND = 4096, 4
#: Parts of one shingle's entries at most; two parts are numbered as one.
PARTS = 1 << 20
#: What rounding may add to a bound.
SLACK = 1e-6
LANES = np.uint64(0x0001000100010001)


def masks(radius: int, bits: int) -> list[int]:
    """The covering masks over the given set of bits (a bit pattern)."""
    dims = radius + 1
    at = [i for i in range(64) if bits >> i & 1]
    vector = {b: k % ((1 << dims) - 1) + 1 for k, b in enumerate(at)}
    return [sum(1 << b for b in at if (vector[b] & v).bit_count() & 1) for v in range(1, 1 << dims)]


def fingerprint(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each run of hashes (counts: the runs' lengths): the bits set in over half of them."""
    first = np.cumsum(counts) - counts
    pieces = np.maximum(-(-counts // 65535), 1)
    owner = np.repeat(np.arange(len(counts)), pieces)
    part = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = first[owner] + part * 65535
    full = counts[owner] > 0
    votes = np.zeros((len(counts), 64), np.int64)
    if full.any():
        for k in range(16):
            lanes = np.add.reduceat((hashes >> np.uint64(k)) & LANES, start[full])
            for j in range(4):
                np.add.at(votes[:, 16 * j + k], owner[full], ((lanes >> np.uint64(16 * j)) & np.uint64(0xFFFF)).astype(np.int64))
    return np.packbits(2 * votes > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _fingerprints(shingle: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_digest
        for table in chunks(batches, "_text", limit):
            buf, offsets = text_bytes(table["_text"])
            raw = buf.tobytes().lower()
            joined = b" ".join(b" ".join([raw[x:y] for x, y in zip(offsets[:-1], offsets[1:], strict=True)]).split())
            spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
            starts, ends = np.insert(spaces + 1, 0, 0), np.append(spaces, len(joined))
            w = words(table["_text"])
            n = w.counts
            made = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
            head = np.repeat(w.first[:-1], made) + np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made)
            tail = head + np.repeat(np.minimum(n, shingle), made) - 1
            a, b = starts[head].tolist(), ends[tail].tolist()
            hashes = np.frombuffer(b"".join([digest(joined[x:y], SEED) for x, y in zip(a, b, strict=True)]), ">u8").astype(np.uint64)
            fp = fingerprint(hashes, made)
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), table["_rid"].combine_chunks(), pa.array(fp.view(np.int64))], ["doc_id", "rid", "fp"])

    return run


def simhash(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, batch_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, rid (a hash of doc_id and text) and fp (the fingerprint as a signed long) of every row."""
    small_batches(df.sparkSession)
    own = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("_rid"), F.col(text).alias("_text"))
    return own.mapInArrow(_fingerprints(shingle, batch_bytes), "doc_id long, rid long, fp long")


def linked(members: np.ndarray, radius: int) -> np.ndarray:
    """Of distinct fingerprints, not many: rows (member, smallest member of its linked part)."""
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= radius
    label = np.arange(len(members))
    while True:
        low = np.where(near, label[None, :], len(members)).min(1)
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(len(members)))
    return np.stack([members[moved], members[label[moved]]], 1)


def kept_bits(path: int, radius: int) -> int:
    """The bits that the masks along a path keep: its base-2**(radius + 1) digits, the first mask's lowest, less one number the masks."""
    bits, kept = (1 << 64) - 1, 0
    while path:
        kept |= masks(radius, bits & ~kept)[path % (1 << radius + 1) - 1]
        path >>= radius + 1
    return kept


def _divided(radius: int):
    """Rows (path, fp) to rows (path, key, fp) for each mask over the bits that the path leaves free."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[tuple[int, int]]] = {}
        for b in batches:
            path, fp = np.asarray(b.column(0)), np.asarray(b.column(1)).view(np.uint64)
            for p in np.unique(path).tolist():
                if p not in known:
                    step = (radius + 1) * -(-p.bit_length() // (radius + 1))
                    known[p] = [(q, kept_bits(q, radius)) for q in (p | t << step for t in range(1, 1 << radius + 1))]
                own = fp[path == p]
                for q, kept in known[p]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), q)), pa.array((own & np.uint64(kept)).view(np.int64)), pa.array(own.view(np.int64))], ["path", "key", "fp"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str], most: int) -> Iterator[tuple[list[np.ndarray], bool, bool]]:
    """Rows sorted by their first two columns as (columns, whether the last group goes on, whether it began before): whole groups
    together, a group beyond `most` rows in parts."""
    held: list[np.ndarray] = []
    began = False
    for b in batches:
        new = [np.asarray(b.column(c)) for c in columns]
        held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
        if not len(held[0]):
            continue
        changes = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0))
        last = int(changes[-1]) + 1 if len(changes) else 0
        if last:
            yield [x[:last] for x in held], False, began
            held, began = [x[last:] for x in held], False
        if len(held[0]) > most:
            yield held, True, began
            held, began = [x[-1:] for x in held], True
    if held and len(held[0]) > began:
        yield held, False, began


def _stars(radius: int):
    """Rows (path, key, fp) sorted by path and key to links (u, v) with path 0, and members of large keys (u) with their path."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, key, fp), on, began in _groups(batches, ["path", "key", "fp"], DIRECT):
            fp = fp.view(np.uint64)
            cut = np.flatnonzero((np.diff(path) != 0) | (np.diff(key) != 0)) + 1
            head = np.concatenate([[0], cut]).astype(np.int64)
            size = np.diff(np.append(head, len(path)))
            large = size > DIRECT
            large[0] |= began or (on and len(head) == 1)
            rest = np.repeat(large, size)
            if began:
                rest[0] = False  # carried along to tell where its group goes on
            two = head[(size == 2) & ~large]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius] if len(two) else two
            out = [np.stack([np.maximum(fp[two], fp[two + 1]), np.minimum(fp[two], fp[two + 1])], 1)]
            out += [linked(np.sort(fp[h : h + n]), radius) for h, n in zip(head[(size > 2) & ~large].tolist(), size[(size > 2) & ~large].tolist(), strict=True)]
            pairs = np.concatenate(out)
            u, v = (np.concatenate([pairs[:, i], fp[rest]]).view(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.concatenate([np.zeros(len(pairs), np.int64), path[rest]]))], ["u", "v", "path"])

    return run


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """u, v: stars over the linked parts of distinct fingerprints (fp)."""
    found, left = None, nodes.select(F.lit(0).cast("long").alias("path"), "fp")
    while True:
        met = left.mapInArrow(_divided(radius), "path long, key long, fp long").repartition("path", "key").sortWithinPartitions("path", "key")
        out = met.mapInArrow(_stars(radius), "u long, v long, path long").checkpoint()
        stars = out.filter("path = 0").select("u", "v")
        found = stars if found is None else found.union(stars)
        left = out.filter("path <> 0").select("path", F.col("u").alias("fp"))
        if left.isEmpty():
            return found


def components(edges: DataFrame) -> DataFrame:
    """u, v: each node of the edges (u, v) with the smallest node of its component, itself left out.

    Alternating large-star and small-star steps, each cut by checkpoint(), until nothing changes.
    """
    shared_dir(edges.sparkSession)

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(low, "u")
        if large:
            return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()

    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct().checkpoint()
    before = None
    while (now := state(edges)) != before:
        before = now
        if not now[0]:
            break
        edges = star(star(edges, True), False).checkpoint()
    return edges


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, rid, fp, root, component_id of every row: root is a fingerprint that stands for the component,
    component_id the smallest doc_id reachable over fingerprints within the radius."""
    shared_dir(df.sparkSession)
    prints = simhash(df, text, doc_id, shingle).checkpoint()
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    roots = components(links(nodes, radius)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    placed = nodes.join(roots, "fp", "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    told = placed.join(ids, "root").select("fp", "root", "component_id", F.ceil(F.col("n") / HOT).alias("parts"))
    hot = told.filter("parts > 1").select("fp", F.col("parts").alias("_parts"))  # one in HOT rows at most
    # numbered as the checkpoint holds them, before any shuffle: a task that runs again deals its rows alike
    numbered = prints.withColumn("_row", F.monotonically_increasing_id())
    salted = numbered.join(few(hot), "fp", "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("rid", "_row"), F.col("_parts")), F.lit(0)))
    spread = told.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    return salted.join(spread, ["fp", "_salt"]).select("doc_id", "rid", "fp", "root", "component_id")


def few(df: DataFrame, most: int = 20_000) -> DataFrame:
    """df, for broadcast where it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _shingles(column: pa.ChunkedArray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all rows' shingles, each one's row, each row's number of them, and a hash of each row's words."""
    w = words(column, lower=True)
    hashes = w.hashes()
    count = np.maximum(w.counts - shingle + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    at = np.repeat(w.first[:-1] - (np.cumsum(count) - count), count) + np.arange(len(row))
    place = np.arange(len(hashes)) - np.repeat(w.first[:-1], w.counts)
    total = np.zeros(len(count), np.uint64)
    np.add.at(total, np.repeat(np.arange(len(count)), w.counts), mix(hashes ^ mix(place.astype(np.uint64))))
    return mix(rolling(hashes, shingle, BASE_KEY)[at]), row, count, mix(total + w.counts.astype(np.uint64))


def bands(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """BANDS keys of each row: of the smallest hashes in BANDS * ROWS parts of its set of shingles. An empty part takes the next
    one's."""
    parts = BANDS * ROWS
    low = np.full(rows * parts, np.iinfo(np.uint64).max, np.uint64)
    slot = (hashes >> U64(32)) * U64(parts) >> U64(32)
    np.minimum.at(low, row * parts + slot.astype(np.int64), mix(hashes))
    low = low.reshape(rows, parts)
    empty = low == np.iinfo(np.uint64).max
    while empty.any() and not empty.all(1).any():
        low = np.where(empty, mix(np.roll(low, -1, 1)), low)
        empty &= np.roll(empty, -1, 1)
    keys = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64)), (rows, BANDS)).copy()
    for k in range(ROWS):
        keys = mix(keys ^ low[:, k::ROWS])
    return keys


def _sets(hashes: np.ndarray, count: np.ndarray, known: np.ndarray, by: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted different shingles of each row that has any, renumbered: the common ones (known, sorted) last, in the order of their
    places (by)."""
    token = hashes >> U64(1)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        token = np.where(known[at] == hashes, by[at].astype(np.uint64) | U64(1 << 63), token)
    ends = np.cumsum(count)
    for y, n in zip(ends[count > 0].tolist(), count[count > 0].tolist(), strict=True):
        yield np.unique(token[y - n : y])


def early(size: int, least: float) -> int:
    """Among how many of its first shingles a set has the first one that it shares with any set like it."""
    return size - int(np.ceil(least * size - SLACK)) + 1


def parities(tokens: np.ndarray) -> np.ndarray:
    """Bits (64 or a larger power of two, at least two for each token) of whether an odd number of tokens falls on them; sets differ
    in as many tokens as these bits or more."""
    size = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    odd = np.bincount((mix(tokens) & U64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Parities (in bytes) over fewer bits."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def _prints(shingle: int, least: float, common: np.ndarray, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = np.argsort(common)
        known = common[by]
        for table in chunks(batches, "_text", limit):
            hashes, row, count, node = _shingles(table["_text"], shingle)
            some = np.flatnonzero(count)
            keys = bands(hashes, np.repeat(np.arange(len(some)), count[some]), len(some))
            offsets = np.concatenate([[0], np.cumsum(np.where(count > 0, BANDS, 0))])
            made = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
            size, brief, first, odd = np.zeros(len(count), np.int64), np.zeros(len(count), np.uint64), [np.zeros(0, np.uint64)] * len(count), [b""] * len(count)
            for i, tokens in zip(some.tolist(), _sets(hashes, count, known, by), strict=True):
                bits = parities(tokens)
                size[i], brief[i], first[i], odd[i] = len(tokens), folded(bits, 8).view("<u8")[0], tokens[: early(len(tokens), least)], bits.tobytes()
            ends = np.cumsum([0, *[len(x) for x in first]])
            low = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(first).view(np.int64)))
            cols = [table["doc_id"].combine_chunks(), table["_rid"].combine_chunks(), pa.array(node.view(np.int64)), pa.array(fingerprint(hashes, count).view(np.int64)), made, pa.array(size), pa.array(brief.view(np.int64)), low, pa.array(odd, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "rid", "node", "fp", "bands", "size", "brief", "low", "odd"])

    return run


def _counted(shingle: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "_text", limit):
            hashes, row, _, _ = _shingles(table["_text"], shingle)
            by = np.lexsort((row, hashes))
            hashes, row = hashes[by], row[by]
            new = (np.diff(hashes, prepend=0) != 0) | (np.diff(row, prepend=-1) != 0)
            key, n = np.unique(hashes[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return run


def common_shingles(own: DataFrame, shingle: int, limit: int) -> np.ndarray:
    """The shingles that are frequent in a sample of texts (_rid, _text), the most frequent last. They only set an order. The sample
    grows with the texts: with a fixed one, shingles of as many texts as before would come early in a larger table."""
    rows = own.count()
    some = own.filter(F.pmod(F.xxhash64("_rid", F.lit("sample")), F.lit(min(SHARE, max(1, -(-rows // SAMPLE))))) == 0)
    counted = some.mapInArrow(_counted(shingle, limit), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN).checkpoint()
    # about FREQUENT of them go to the driver: of the least count that fits in part only, a part
    least, part, room = 0, PARTS, FREQUENT
    for n, keys in sorted(((x["n"], x["keys"]) for x in counted.groupBy("n").agg(F.count("*").alias("keys")).collect()), reverse=True):
        if keys > room:
            least, part = n, room * PARTS // keys
            break
        room -= keys
    got = counted.filter((F.col("n") > least) | (F.col("n") == least) & (F.pmod("key", F.lit(PARTS)) < part)).toArrow()
    key, n = np.asarray(got["key"]).view(np.uint64), np.asarray(got["n"])
    return key[np.lexsort((~key, n))]


def _candidates():
    """Rows (key, zero, node, fp) sorted by key to pairs of nodes worth an exact look: each with its nearest and the middle one
    of its group, by fingerprint; a long group's parts are tied by their middles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = None
        for (key, _, node, fp), on, began in _groups(batches, ["key", "zero", "node", "fp"], DIRECT):
            fp = fp.view(np.uint64)
            head = np.concatenate([[0], np.flatnonzero(np.diff(key) != 0) + 1]).astype(np.int64)
            size = np.diff(np.append(head, len(key)))
            out = [np.zeros((0, 2), np.int64)]
            two = head[size == 2]
            out.append(np.stack([two, two + 1], 1))
            ties = []
            for i in np.flatnonzero(size > 2).tolist() + ([0] if began and size[0] <= 2 else []):
                first, n = int(head[i]), int(size[i])
                for start in range(first, first + n, DIRECT):
                    at = np.arange(start, min(start + DIRECT, first + n))
                    far = np.bitwise_count(fp[at][:, None] ^ fp[at][None, :]).astype(np.int64)
                    centre = at[far.sum(1).argmin()]
                    np.fill_diagonal(far, 99)
                    if len(at) > 1:
                        out += [np.stack([at, at[far.argmin(1)]], 1), np.stack([at, np.full(len(at), centre)], 1)]
                    if start > first:
                        ties.append((node[centre], before))
                    elif i == 0 and began and middle is not None:
                        ties.append((node[centre], middle))
                    before = node[centre]
                if i == len(size) - 1:
                    middle = before
            pair = np.concatenate(out)
            pair = pair[np.bitwise_count(fp[pair[:, 0]] ^ fp[pair[:, 1]]) <= FAR]
            made = np.concatenate([node[pair], np.array(ties, np.int64).reshape(-1, 2)])
            u, v = made.max(1) if len(made) else made[:, 0], made.min(1) if len(made) else made[:, 0]
            new = u != v
            yield pa.RecordBatch.from_arrays([pa.array(u[new]), pa.array(v[new])], ["u", "v"])

    return run


def _similar(shingle: int, least: float, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "a", limit):
            sets = []
            for c in ("a", "b"):
                hashes, _, count, _ = _shingles(table[c], shingle)
                ends = np.cumsum(count)
                sets.append([np.unique(hashes[y - n : y]) for y, n in zip(ends.tolist(), count.tolist(), strict=True)])
            good = np.zeros(table.num_rows, bool)
            for i, (x, y) in enumerate(zip(*sets, strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = both >= least * (len(x) + len(y) - both) and both > 0
            yield from table.select(["u", "v"]).filter(pa.array(good)).to_batches()

    return run


def _possible(least: float):
    """Rows (key, pair, node, root, size, left, brief, part) sorted by key and pair to pairs of nodes of different groups that may be
    similar. left: how many of a node's shingles come from key on. A pair of different parts skips pairs within a part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, pair, node, root, size, left, brief, part), _, _ in _groups(batches, ["key", "pair", "node", "root", "size", "left", "brief", "part"], 1 << 62):
            brief = brief.view(np.uint64)
            head = np.concatenate([[0], np.flatnonzero((np.diff(key) != 0) | (np.diff(pair) != 0)) + 1]).astype(np.int64)
            sizes = np.diff(np.append(head, len(key)))
            end, at, out, k = np.repeat(head + sizes, sizes), np.arange(len(key)), [np.zeros((0, 2), np.int64)], 1
            within = pair % (PARTS + 1) == 0
            while len(at := at[at + k < end[at]]):
                x, y = at, at + k
                both = size[x] + size[y]
                good = (root[x] != root[y]) & (np.minimum(left[x], left[y]) >= least / (1 + least) * both - SLACK)
                good &= (np.bitwise_count(brief[x] ^ brief[y]) <= (1 - least) / (1 + least) * both + SLACK) & (within[x] | (part[x] != part[y]))
                if good.any():
                    out.append(np.stack([np.maximum(node[x[good]], node[y[good]]), np.minimum(node[x[good]], node[y[good]])], 1))
                k += 1
            made = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], ["u", "v"])

    return run


def _close(least: float):
    """Pairs (u, v, their sizes n and m, parities a and b) that may be similar, with the places in which parities differ (far)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = (1 - least) / (1 + least) * (np.asarray(b.column("n")) + np.asarray(b.column("m"))) + SLACK
            far = np.zeros(b.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                far[i] = np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()
            good = pa.array(far <= most)
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(far)], ["u", "v", "far"]).filter(good)

    return run


def rest(nodes: DataFrame, roots: DataFrame, tried: DataFrame, least: float) -> DataFrame:
    """u, v, far: all pairs of nodes (node, size, low, odd, brief) of different groups (roots: node, root) that bounds don't rule
    out, without those tried."""
    placed = nodes.filter("size > 0").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    entries = placed.select("node", "root", "size", "brief", F.posexplode("low").alias("at", "key")).withColumn("left", F.col("size") - F.col("at")).drop("at")
    own = Window.partitionBy("key")
    met = entries.select("*", F.count("*").over(own).alias("n"), (F.min("root").over(own) < F.max("root").over(own)).alias("mixed")).filter("mixed")
    # a frequent shingle's entries are dealt to parts, and each two parts meet in a task
    dealt = met.withColumn("parts", F.ceil(F.col("n") / BLOCK)).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.withColumn("pair", F.least("part", "other") * PARTS + F.greatest("part", "other")).select("key", "pair", "node", "root", "size", "left", "brief", "part")
    pairs = dealt.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(_possible(least), "u long, v long").distinct().join(tried, ["u", "v"], "left_anti")
    told = lambda c, n, p: nodes.select(F.col("node").alias(c), F.col("size").alias(n), F.col("odd").alias(p))
    return pairs.join(told("u", "n", "a"), "u").join(told("v", "m", "b"), "v").select("u", "v", "n", "m", "a", "b").mapInArrow(_close(least), "u long, v long, far long")


def near_texts(df: DataFrame, rid: Column, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8, radius: int = 3, batch_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, rid, node, root of every row: rows with one root are linked by texts with the same words (a node), or that share at
    least `similarity` of their different shingles. rid: a column that identifies a row. A text of fewer words than a shingle
    is only like texts of the same words; null and empty texts are alike."""
    spark = df.sparkSession
    shared_dir(spark)
    small_batches(spark)
    own = df.select(F.col(doc_id).cast("long").alias("doc_id"), rid.alias("_rid"), F.col(text).alias("_text"))
    columns = "doc_id long, rid long, node long, fp long, bands array<long>, size long, brief long, low array<long>, odd binary"
    with shuffles_freed(spark):
        common = common_shingles(own, shingle, batch_bytes)
        prints = own.mapInArrow(_prints(shingle, similarity, common, batch_bytes), columns).checkpoint()
        nodes = prints.groupBy("node").agg(*[F.min(c).alias(c) for c in ("rid", "fp", "bands", "size", "brief", "low", "odd")])
        keys = nodes.select(F.explode("bands").alias("key"), F.lit(0).alias("zero"), "node", "fp").repartition("key").sortWithinPartitions("key", "node")
        same = nodes.groupBy("fp").agg(F.min("node").alias("first")).checkpoint()
        alike = nodes.join(same, "fp").filter("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
        ends = lambda c, n: same.select(F.col("fp").alias(c), F.col("first").alias(n))
        covered = links(same, radius).join(ends("u", "x"), "u").join(ends("v", "y"), "v").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
        pairs = keys.mapInArrow(_candidates(), "u long, v long").union(alike).union(covered).distinct().checkpoint()

        def texts_of(pairs: DataFrame) -> DataFrame:
            asked = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
            # one text of each node that is to be looked at
            wanted = nodes.select("node", "rid").join(asked, "node", "left_semi").checkpoint()
            return own.select(F.col("_rid").alias("rid"), "_text").join(few(wanted), "rid").groupBy("node").agg(F.min("_text").alias("_text")).checkpoint()

        def check(pairs: DataFrame, texts: DataFrame) -> DataFrame:
            told = lambda c, t: texts.select(F.col("node").alias(c), F.col("_text").alias(t))
            return pairs.join(told("u", "a"), "u").join(told("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(_similar(shingle, similarity, batch_bytes), "u long, v long")

        def joined(edges: DataFrame) -> DataFrame:
            return components(edges).select(F.col("u").alias("node"), F.col("v").alias("root"))

        roots = joined(check(pairs, texts_of(pairs)))
        left = rest(nodes, roots, pairs, similarity).checkpoint()
        most, texts = ROUND, None
        while not left.isEmpty():
            texts = texts or texts_of(left)
            root = lambda c, r: roots.select(F.col("node").alias(c), F.col("root").alias(r))
            now = left.join(root("u", "x"), "u", "left").join(root("v", "y"), "v", "left").select("u", "v", "far", F.coalesce("x", "u").alias("x"), F.coalesce("y", "v").alias("y")).filter("x <> y")
            turn = F.row_number().over(Window.partitionBy(F.greatest("x", "y"), F.least("x", "y")).orderBy("far", "u", "v"))
            now = now.select("u", "v", "far", turn.alias("turn")).checkpoint()
            left = now.filter(F.col("turn") > most).select("u", "v", "far")
            found = check(now.filter(F.col("turn") <= most).select("u", "v"), texts)
            roots = joined(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(found))
            most *= 16
    return prints.select("doc_id", "rid", "node").join(roots, "node", "left").select("doc_id", "rid", "node", F.coalesce("root", "node").alias("root"))
