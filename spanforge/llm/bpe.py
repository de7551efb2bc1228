"""Byte-level BPE encoding and decoding with public vocabulary files, in batched numpy merge rounds.

The distinct pieces of a batch lie in one flat symbol array. In each round every adjacent pair is looked up
by binary search among the sorted pair keys; of each piece the pairs of its lowest rank merge, from the left,
and finished pieces leave the array. A merge never makes a pair of lower rank, so this gives what merging one
pair at a time gives. Long pieces, which take many rounds, are merged together by ascending rank: a round merges
one rank in all of them and looks up only the pairs beside what it merged, so their work is close to linear.

Defined results: a null or empty text has no ids and decodes to the empty text; texts are taken whole; a
special token's string in a text is that token; ids outside the vocabulary and null ids decode to nothing;
bytes that are no UTF-8 decode to the replacement character; other columns pass through, and the output
column replaces a column of its name.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import chunks, lists, small_batches, trim

#: Fixed: the pre-tokenizer's pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a task remembers, and their characters; beyond that it starts anew.
REMEMBERED, REMEMBERED_CHARACTERS = 100_000, 8 << 20
#: Bytes from which a piece is long.
LONG = 256


def byte_characters() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: itself where it prints, else from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Vocabulary:
    """keys: sorted left * size + right of every merge; rank and made: its rank and the id it makes."""

    size: int
    keys: np.ndarray
    rank: np.ndarray
    made: np.ndarray
    single: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    special: dict[str, int]


def load_vocabulary(path: str) -> Vocabulary:
    """Read a tokenizers JSON file of kind byte-level BPE without normaliser (anything else is refused)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model.get("dropout") or model.get("ignore_merges"):
        raise ValueError("a plain byte-level BPE file is needed")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("added tokens with conditions aren't supported")
    vocab, stand = model["vocab"], byte_characters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = max([*vocab.values(), *special.values()]) + 1
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
    by = np.argsort(keys)
    made = np.array([vocab[a + b] for a, b in pairs], np.int32)
    single = np.zeros(256, np.int32)
    for c, b in stand.items():
        single[b] = vocab[c]
    content = [b""] * size
    for t, i in vocab.items():
        content[i] = bytes(stand[c] for c in t) if all(c in stand for c in t) else t.encode()
    for t, i in special.items():
        content[i] = t.encode()
    offsets = np.cumsum([0, *map(len, content)])
    return Vocabulary(size, keys[by], by.astype(np.int32), made[by], single, np.frombuffer(b"".join(content), np.uint8), offsets, special)


def merge(pieces: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces, one after the other, and the offsets of each piece's ids."""
    symbols = v.single[np.frombuffer(b"".join(pieces), np.uint8)]
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    owner = np.repeat(np.arange(len(pieces)), sizes)
    long = np.repeat(sizes >= LONG, sizes)
    if long.all():
        found = [merge_long(symbols, owner, v)]
    elif long.any():
        found = [merge_short(symbols[~long], owner[~long], v), merge_long(symbols[long], owner[long], v)]
    else:
        found = [merge_short(symbols, owner, v)]
    owners, ids = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.argsort(owners, kind="stable")
    return ids[by], np.searchsorted(owners[by], np.arange(len(pieces) + 1))


def merge_long(symbols: np.ndarray, owner: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Owners and ids after all merges, rank by rank over linked symbols."""
    n, none = len(symbols), np.iinfo(np.int32).max
    made = np.empty(len(v.made), np.int32)
    made[v.rank] = v.made
    symbols, after, before = symbols.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
    edge = np.flatnonzero(np.diff(owner, append=-1) != 0)
    after[edge] = -1
    before[np.append(0, edge[:-1] + 1)[:n]] = -1
    current, alive = np.full(n, none, np.int32), np.ones(n, bool)
    waiting: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def look(at: np.ndarray) -> None:
        """Find the ranks of the pairs that begin at these places, and put the places down under them."""
        right = after[at]
        key = symbols[at].astype(np.int64) * v.size + symbols[right]
        found = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        rank = np.where((right >= 0) & (v.keys[found] == key), v.rank[found], none)
        current[at] = rank
        by = np.argsort(rank, kind="stable")
        rank, at = rank[by], at[by]
        ends = [*(np.flatnonzero(np.diff(rank)) + 1).tolist(), len(rank)]
        start = 0
        for end in ends:
            if end > start and (r := int(rank[start])) != none:
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(at[start:end])
            start = end

    look(np.arange(n))
    while ranks:
        r = heapq.heappop(ranks)
        places = waiting.pop(r)
        at = places[0] if len(places) == 1 else np.unique(np.concatenate(places))
        at = at[current[at] == r]
        if not len(at):
            continue
        # in a run of overlapping pairs every second one merges, from the left
        run = np.flatnonzero(np.append(True, after[at[:-1]] != at[1:]))
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
        gone = after[at]
        beyond = after[gone]
        symbols[at], after[at] = made[r], beyond
        before[beyond[beyond >= 0]] = at[beyond >= 0]
        current[gone], alive[gone] = none, False
        left = before[at]
        look(np.unique(np.concatenate([at, left[left >= 0]])))
    return owner[alive], symbols[alive]


def merge_short(symbols: np.ndarray, owner: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Owners and ids after all merges, of each piece's lowest rank in a round."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    none = np.iinfo(np.int32).max
    while len(symbols):
        key = symbols[:-1].astype(np.int64) * v.size + symbols[1:]
        at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        hit = (v.keys[at] == key) & (owner[:-1] == owner[1:])
        rank = np.append(np.where(hit, v.rank[at], none), none)
        heads = np.flatnonzero(np.diff(owner, prepend=-1))
        low = np.minimum.reduceat(rank, heads)
        sizes = np.diff(np.append(heads, len(owner)))
        low_of = np.repeat(low, sizes)
        over = low_of == none
        if over.any():
            done.append((owner[over], symbols[over]))
        pick = np.flatnonzero((rank == low_of) & ~over)
        # in a run of overlapping pairs every second one merges, from the left
        run = np.flatnonzero(np.diff(pick, prepend=-2) != 1)
        place = np.arange(len(pick)) - np.repeat(run, np.diff(np.append(run, len(pick))))
        pick = pick[place % 2 == 0]
        symbols = symbols.copy()
        symbols[pick] = v.made[at[pick]]
        stay = ~over
        stay[pick + 1] = False
        symbols, owner = symbols[stay], owner[stay]
    owners = np.concatenate([o for o, _ in done] or [np.zeros(0, np.int64)])
    return owners, np.concatenate([s for _, s in done] or [np.zeros(0, np.int32)])


def spread(data: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data[offsets[i]:offsets[i + 1]] for each i of index, one after the other, and the length of each."""
    size = (offsets[1:] - offsets[:-1])[index]
    step = np.repeat(offsets[index] - (np.cumsum(size) - size), size)
    return data[step + np.arange(len(step))], size


def _encode(shared, names: list[str], text: str, ids: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        split = regex.compile(PATTERN).findall
        marks = re.compile("(" + "|".join(map(re.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None
        place: dict[str, int] = {}
        held = 0
        data, offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

        def pieces(t: str) -> list[str]:
            if not marks or not any(m in t for m in v.special):
                return split(t)
            return [x for part in marks.split(t) for x in ([part] if part in v.special else split(part))]

        for table in chunks(batches, text, limit):
            for b in table.to_batches():
                rows = [pieces(t) if t else [] for t in b.column(text).to_pylist()]
                if len(place) > REMEMBERED or held > REMEMBERED_CHARACTERS:
                    held, place, data, offsets = 0, {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
                seen: set[str] = set()
                for r in rows:
                    seen.update(r)
                new = [x for x in seen if x not in place]
                held += sum(map(len, new))
                if new:
                    plain = [x for x in new if x not in v.special]
                    marked = [x for x in new if x in v.special]
                    got, cut = merge([x.encode() for x in plain], v)
                    got = np.concatenate([got, np.array([v.special[x] for x in marked], np.int32)])
                    cut = np.concatenate([cut, cut[-1] + 1 + np.arange(len(marked))])
                    place.update(zip([*plain, *marked], range(len(offsets) - 1, len(offsets) - 1 + len(new)), strict=True))
                    data, offsets = np.concatenate([data, got]), np.concatenate([offsets, offsets[-1] + cut[1:]])
                count = np.fromiter(map(len, rows), np.int64, len(rows))
                index = np.fromiter((i for r in rows for i in map(place.__getitem__, r)), np.int64, int(count.sum()))
                flat_ids, size = spread(data, offsets, index)
                ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]
                made = lists(flat_ids, ends, pa.int32())
                yield pa.RecordBatch.from_arrays([made if x == ids else b.column(x) for x in names], names)

    return run


def _decode(shared, names: list[str], ids: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                column = b.column(ids)
                values = column.flatten()
                index = np.asarray(values.fill_null(-1), dtype=np.int64)
                size = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
                good = (index >= 0) & (index < v.size)
                data, length = spread(v.data, v.offsets, np.where(good, index, 0))
                if not good.all():
                    data = data[np.repeat(good, length)]
                    length = np.where(good, length, 0)
                ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(size)])].tolist()
                raw = data.tobytes()
                made = pa.array([raw[x:y].decode("utf-8", "replace") for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([made if x == text else b.column(x) for x in names], names)
        trim()

    return run


def _with(df: DataFrame, name: str, kind: str) -> T.StructType:
    return T.StructType([*[f for f in df.schema if f.name != name], T.StructField(name, T._parse_datatype_string(kind))])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", batch_bytes: int = 2 << 20) -> DataFrame:
    """df with the column ids: the token ids of each whole text. path: a tokenizers JSON file that the driver reads."""
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(path))  # a vocabulary's size is fixed
    small_batches(df.sparkSession)
    schema = _with(df, ids, "array<int>")
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != ids or c == text]).mapInArrow(_encode(shared, schema.names, text, ids, batch_bytes), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the column text: the bytes of each row's tokens, read as UTF-8."""
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(path))  # a vocabulary's size is fixed
    small_batches(df.sparkSession)
    schema = _with(df, text, "string")
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != text]).mapInArrow(_decode(shared, schema.names, ids, text), schema)


def encode_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", batch_bytes: int = 2 << 20) -> DataFrame:
    """df with ids and decoded: encode() and then decode(), by the same workers in one pass."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(path))  # a vocabulary's size is fixed
    own = df.select(*[F.col(f"`{c}`") for c in df.columns if c == text or c not in (ids, decoded)])
    between = _with(own, ids, "array<int>")
    schema = T.StructType([*[f for f in between if f.name != decoded], T.StructField(decoded, T.StringType())])
    first, second = _encode(shared, between.names, text, ids, batch_bytes), _decode(shared, schema.names, ids, decoded)
    return own.mapInArrow(lambda batches: second(first(batches)), schema)
