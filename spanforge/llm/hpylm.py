"""Scoring of texts by a hierarchical Pitman-Yor language model.

Tokens are lower-cased (A-Z) words and an end token after each text. A token's context is the whole word before it
(or a text's start), so there are as many context restaurants as words. Contexts whose words end alike (in their last
two bytes) share a parent, a class restaurant; all classes share the root, a restaurant without context, whose base is
uniform over the training words and one unknown word. A word's key carries its ending, so a context names its class.

Words are dealt to buckets. A bucket holds a word in all contexts, so the classes' and the root's parts of a word are
local to it, and it owns the restaurants of the contexts that its words are. What the few classes (2**16 at most) hold
over all words goes through the driver. Map steps send each bucket their distinct (word, context)
pairs with counts, and of each word the customers and sections that its context has there. A section of one customer
has one table whatever happens, so an owner knows the tables of its contexts up to the sections of several customers;
only of those do buckets send tables to owners, and get the contexts' totals back. A Gibbs sweep takes each section
(all customers of a restaurant with one dish) out and seats it anew given all others; the customers of long sections
come in blocks that grow with those seated, so the work follows the logarithm of a section's size and nothing is
capped. Buckets run sweeps side by side against the totals of the round before. The samples' tables go to the owners,
the same seeded sweeps run again, and seatings and totals go back to the map steps, where predictive probabilities
are averaged over the samples, each with its own totals, and summed by document. The driver sees sums only.

Defined results: a null or empty text is its end token only; rows are scored each for itself, repeated rows
too; with no training rows every word has probability one over one unknown word; other columns are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .flat import U64, Words, chunks, mix, shared_dir, shuffles_freed, small_batches, trim, words

#: Bits of a word's hash that tell words apart, beside the word's last two bytes in the lowest bits.
ENDING = U64((1 << 16) - 1)
KEPT = ~ENDING
END = mix(np.array([0x656E64], np.uint64))[0] & KEPT
#: Rows between steps: kind, the bucket (negative for documents) they go to, the bucket or batch they come from or go back to.
WIRE = "to int, kind int, at long, data array<binary>, sums array<double>"
PAIRS, DOCS, CORE, BACK, OWN, SENT, TOTAL, SUMS, REPLY, CLASSES = range(10)
#: Tokens whose probabilities are worked out at a time.
SLICE = 1 << 17
#: Customers of a section that are seated one by one, and the part of those seated that later come at once.
SINGLY, BLOCK = 48, 48


def pack(x: np.ndarray) -> bytes:
    by_byte = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize)
    turned = np.empty(by_byte.shape[::-1], np.uint8)
    for i in range(x.itemsize):  # a copy of each plane is several times faster than one of the transposed whole
        turned[i] = by_byte[:, i]
    return zstandard.ZstdCompressor(level=1).compress(turned)


def unpack(b: bytes, kind: str) -> np.ndarray:
    k = np.dtype(kind)
    turned = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(k.itemsize, -1)
    by_byte = np.empty(turned.shape[::-1], np.uint8)
    for i in range(k.itemsize):
        by_byte[:, i] = turned[i]
    return by_byte.reshape(-1).view(k)


@dataclass
class Totals:
    """What restaurants share. c, t: customers of every context, tables of every context by sample; classes (sorted), with
    c1, t1 their customers and tables by sample; c0, t0: those of the root; sizes and parameters of the three levels."""

    c: np.ndarray
    t: list[np.ndarray]
    classes: np.ndarray
    c1: list[np.ndarray]
    t1: list[np.ndarray]
    c0: list[float]
    t0: list[float]
    tokens: int
    types: int
    d2: float
    d1: float
    d0: float
    theta2: float = 1.0
    theta1: float = 1.0
    theta0: float = 1.0
    seeds: tuple[int, ...] = field(default=(1,))

    @property
    def base(self) -> float:
        return 1.0 / (self.types + 1)


def seat(customers: np.ndarray, a: np.ndarray, b: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of sections of so many customers (at least 1). With i customers at k tables the next opens one at odds
    a + b * k to i - d * k.

    The first SINGLY customers come one by one, later ones in blocks of one part in BLOCK of those seated; a block's new
    tables are binomial, at the chance in its middle.
    """
    tables = np.ones(len(customers))
    by = np.argsort(narrow(customers.max(initial=0) - customers), kind="stable")
    n, a, b, k = customers[by], a[by], b[by], tables[by]
    less = -n
    first, second = np.empty(len(n)), np.empty(len(n))
    i = 1
    while m := int(np.searchsorted(less, -i, "left")):  # sections with more than i customers
        if i < SINGLY:
            new = np.multiply(b[:m], k[:m], out=first[:m])
            new += a[:m]
            rest = np.add(new, i, out=second[:m])
            rest -= d * k[:m]
            new /= rest
            k[:m] += rng.random(out=rest) < new
        else:
            size = np.minimum(i // BLOCK, n[:m] - i)
            new = a[:m] + b[:m] * k[:m]
            chance = new / (new + i - d * k[:m])
            middle = k[:m] + chance * size / 2
            new = a[:m] + b[:m] * middle
            k[:m] += rng.binomial(size, new / (new + i + size / 2 - d * middle))
        i += 1 if i < SINGLY else i // BLOCK
    tables[by] = k
    return tables


def _wire(made: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.float64())]
    return pa.Table.from_arrays([pa.array([r[i] for r in made], k) for i, k in enumerate(kinds)], [x.split()[0] for x in WIRE.split(", ")])


def _owner(w: np.ndarray, buckets: int) -> tuple[list[int], list[int], list[int]]:
    """Where the runs of sorted words that go to one bucket start and end, and their buckets."""
    bucket = ((w >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    heads = np.flatnonzero(np.diff(bucket, prepend=-1))
    return heads.tolist(), np.append(heads, len(w))[1:].tolist(), bucket[heads].tolist()


def _endings(w: Words) -> np.ndarray:
    """The last two bytes of each word, the last one lowest; a word of one byte has only that."""
    before = w.buf[np.maximum(w.ends - 2, 0)].astype(np.uint64) if len(w.ends) else np.zeros(0, np.uint64)
    last = w.buf[w.ends - 1].astype(np.uint64) if len(w.ends) else before
    return last | np.where(w.ends - w.starts > 1, before << U64(8), U64(0))


def _by_ending(context: np.ndarray) -> np.ndarray:
    """Contexts turned so that they sort by their endings first."""
    return context << U64(48) | context >> U64(16)


def _pairs(buckets: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, table in enumerate(chunks(batches, "text", limit)):
            batch = (TaskContext.get().partitionId() << 24) + seq
            w = words(table["text"], lower=True)
            train = np.asarray(table["train"].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False), bool)
            n = w.counts + 1
            where = np.arange(len(w.starts)) + np.repeat(np.arange(len(train)), w.counts)
            token = np.full(len(w.starts) + len(train), END, np.uint64)
            token[where] = (w.hashes() & KEPT) | _endings(w)
            context = np.zeros(len(token) + 1, np.uint64)
            context[where + 1] = token[where]
            context = context[:-1]
            del w, where
            counted = np.repeat(train, n)
            # of a word the contexts of one class lie together
            by = np.lexsort((_by_ending(context), token))
            new = np.ones(len(by), bool)
            new[1:] = (np.diff(token[by]) != 0) | (np.diff(context[by]) != 0)
            heads = np.flatnonzero(new)
            pair = np.empty(len(by), np.uint32)
            pair[by] = np.cumsum(new) - 1
            count = np.add.reduceat(counted[by].astype(np.int64), heads)
            pw, pc = token[by[heads]], context[by[heads]]
            del token, context, counted, by, new
            # the words of the batch, and 0, the context at a text's start
            every = np.union1d(pw, np.zeros(1, np.uint64))
            runs = np.diff(np.searchsorted(pw, every, "left"), append=len(pw))
            of = np.searchsorted(every, pc)
            customers, sections = (np.bincount(of, x, len(every)).astype(np.int64) for x in (count, count > 0))
            first = np.concatenate([[0], np.cumsum(runs)])
            made = []
            for x, y, bucket in zip(*_owner(every, buckets), strict=True):
                own = slice(first[x], first[y])
                made.append((bucket, PAIRS, batch, [pack(every[x:y]), pack(runs[x:y].astype(np.uint32)), pack(pc[own]), pack(count[own].astype(np.uint32)), pack(customers[x:y].astype(np.uint32)), pack(sections[x:y].astype(np.uint32))], None))
            key = table["key"].combine_chunks()
            made.append((-1 - batch % buckets, DOCS, batch, [pack(np.asarray(key.fill_null(0), np.int64)), pack(np.asarray(key.is_null().to_numpy(zero_copy_only=False), np.uint8)), pack(train.astype(np.uint8)), pack(n.astype(np.uint32)), pack((every & ENDING).astype(np.uint16)), pack(pair), pack(runs.astype(np.uint32))], None))
            del pair, pw, pc, count, of
            yield from _wire(made).to_batches()
            del made
            trim()

    return run


@dataclass
class Bucket:
    """The distinct (word, context) pairs of a bucket, sorted. Of a pair, c: training count, context: its index among those
    that Totals.t holds, section: the index of its (word, class). Of a section, word: its word's index, kind: its class.
    c_word: each word's training count."""

    c: np.ndarray
    context: np.ndarray
    section: np.ndarray
    word: np.ndarray
    kind: np.ndarray
    c_word: np.ndarray

    @classmethod
    def of(cls, c: np.ndarray, context: np.ndarray, word: np.ndarray, kind: np.ndarray, words: int) -> Bucket:
        """From each pair's count, context, word and class."""
        both, section = np.unique(word.astype(np.uint64) << U64(16) | kind.astype(np.uint64), return_inverse=True)
        return cls(c, context, section, (both >> U64(16)).astype(np.int64), (both & ENDING).astype(np.int64), np.bincount(word, c, words).astype(np.int64))


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in as few bytes as hold them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _steps(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=0).astype(np.int32))


def _unsteps(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, "<i4").astype(np.int64))


def _state(table: pa.Table) -> pa.Table:
    """A bucket's merged pairs (CORE), their places in the batches (BACK) and its contexts (OWN); documents as they are."""
    to = table["to"][0].as_py()
    if to < 0:
        return table
    table = table.sort_by("at")
    rows = table["data"].to_pylist()
    w, runs, ctx, n, customers, sections = ([unpack(r[i], k) for r in rows] for i, k in enumerate(("<u8", "<u4", "<u8", "<u4", "<u4", "<u4")))
    sizes, lengths = [len(x) for x in ctx], [len(x) for x in w]
    every, of = np.unique(np.concatenate(w), return_inverse=True)
    customers, sections = (np.bincount(of, np.concatenate(x), len(every)).astype(np.int64) for x in (customers, sections))
    own, ctx, n = np.repeat(of, np.concatenate(runs)), np.concatenate(ctx), np.concatenate(n).astype(np.int64)
    by = np.lexsort((_by_ending(ctx), own))
    new = np.ones(len(by), bool)
    new[1:] = (np.diff(own[by]) != 0) | (np.diff(ctx[by]) != 0)
    heads = np.flatnonzero(new)
    inverse = np.empty(len(by), np.int64)
    inverse[by] = np.cumsum(new) - 1
    c, times = (np.bincount(inverse, x, len(heads)).astype(np.int64) for x in (n, n > 0))
    word, ctx = own[by[heads]], ctx[by[heads]]
    many = c > 1
    kind = ctx & ENDING
    b = Bucket.of(c, None, word, kind, len(every))
    met, spread = np.bincount(b.section, c > 0, len(b.word)), np.bincount(b.word, np.bincount(b.section, c > 0, len(b.word)) > 0, len(every))
    count = lambda x: [int((x == 1).sum()), int((x == 2).sum())]
    sums = [c.sum(), (b.c_word > 0).sum(), *count(c), *count(met), *count(spread), (met > 0).sum()]
    core = [pack(c), pack(np.bincount(word, minlength=len(every)).astype(np.uint32)), pack(kind.astype(np.uint16)), pack(ctx[many]), pack(times[many].astype(np.uint32))]
    back = [pack(np.asarray(table["at"], np.int64)), pack(np.array(sizes, np.uint32)), pack(np.array(lengths, np.uint32)), _steps(inverse), _steps(of)]
    made = [(to, CORE, to, core, [float(x) for x in sums]), (to, BACK, to, back, None), (to, OWN, to, [pack(every), pack(sections), pack(customers)], None)]
    return _wire([*made, (to, CLASSES, to, None, _by_class(b.kind, met, met > 0))])


def _by_class(kind: np.ndarray, *values: np.ndarray) -> list[float]:
    """Rows, one after the other, of each class and the sums of its sections' values."""
    some, of = np.unique(kind, return_inverse=True)
    return np.stack([some, *[np.bincount(of, x, len(some)) for x in values]], 1).astype(float).ravel().tolist()


@dataclass
class Core:
    """A bucket with the contexts of its sections of several customers: bucket.context counts in `used`."""

    bucket: Bucket
    many: np.ndarray
    used: np.ndarray
    times: np.ndarray

    def messages(self, bucket: int, seatings: list[np.ndarray], buckets: int) -> list[tuple]:
        """To the owner of each context: the tables of its sections here, less what map steps have told of them."""
        of = self.bucket.context[self.many]
        found = [np.bincount(of, t[self.many] - self.times, len(self.used)).astype(np.int64) for t in seatings]
        return [(to, SENT, bucket, [pack(self.used[x:y]), *[pack(f[x:y]) for f in found]], None) for x, y, to in zip(*_owner(self.used, buckets), strict=True)]


def _core(data: list[bytes]) -> Core:
    c, runs, kind, ctx, times = (unpack(x, k) for x, k in zip(data, ("<i8", "<u4", "<u2", "<u8", "<u4"), strict=True))
    many = np.flatnonzero(c > 1)
    used, of = np.unique(ctx, return_inverse=True)
    context = np.zeros(len(c), np.int64)
    context[many] = of
    return Core(Bucket.of(c, context, np.repeat(np.arange(len(runs)), runs), kind, len(runs)), many, used, times.astype(np.int64))


def _first(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                core = _core(row["data"])
                yield from _wire(core.messages(row["to"], [np.minimum(core.bucket.c, 1)], buckets)).to_batches()

    return run


def _tables(own: list[bytes], sent: list[dict], samples: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The tables of a bucket's own contexts in each sample, and the places of each message's contexts."""
    every, sections = unpack(own[0], "<u8"), unpack(own[1], "<i8")
    tables, places = [sections.copy() for _ in range(samples)], []
    for r in sent:
        places.append(np.searchsorted(every, unpack(r["data"][0], "<u8")))
        for t, x in zip(tables, r["data"][1:], strict=True):
            t[places[-1]] += unpack(x, "<i8")
    return tables, places


def _answer(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    sent = [r for r in rows if r["kind"] == SENT]
    (t,), places = _tables(next(r["data"] for r in rows if r["kind"] == OWN), sent, 1)
    return _wire([(r["at"], TOTAL, r["to"], [pack(t[at])], None) for r, at in zip(sent, places, strict=True)])


@dataclass
class Seating:
    """One sample: t, the tables of each pair; c1 and t1, customers and tables of each section; c0 and t0, of each word at the root."""

    t: np.ndarray
    c1: np.ndarray
    t1: np.ndarray
    c0: np.ndarray
    t0: np.ndarray


def sweeps(b: Bucket, bucket: int, totals: Totals, burn: int, samples: int) -> Iterator[Seating]:
    """After burn sweeps, samples times: the seating of a bucket."""
    rng = np.random.default_rng([*totals.seeds, bucket])
    d2, d1, d0 = totals.d2, totals.d1, totals.d0
    at = np.searchsorted(totals.classes, b.kind)
    c_class, t_class = (np.append(x[0], 0.0)[at] for x in (totals.c1, totals.t1))  # a class without customers has no row
    open0, down0 = (totals.theta0 + d0 * totals.t0[0]) * totals.base, totals.theta0 + totals.c0[0]
    t, many = np.minimum(b.c, 1).astype(float), np.flatnonzero(b.c > 1)
    own, context = b.section[many], totals.t[0][b.context[many]]
    c1 = np.bincount(b.section, t, len(b.word))
    t1 = np.minimum(c1, 1)
    c0 = np.bincount(b.word, t1, len(b.c_word))
    t0 = np.minimum(c0, 1)

    def less(total: np.ndarray, tables: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of a dish when part of its customers are taken out."""
        rest = np.maximum(total - part, 0)
        return rest, np.minimum(tables, rest)

    def root(rest: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (rest - d0 * tables + open0) / down0

    for sweep in range(burn + samples):
        some = np.flatnonzero(c1 > 0)
        parent = root(*less(c0[b.word[some]], t0[b.word[some]], t1[some]))
        others = np.maximum(t_class[some] - t1[some], 0)
        t1 = t1.copy()
        t1[some] = seat(c1[some].astype(np.int64), (totals.theta1 + d1 * others) * parent, d1 * parent, d1, rng)
        c0 = np.bincount(b.word, t1, len(b.c_word))
        some = np.flatnonzero(c0 > 0)
        t0 = np.zeros(len(c0))
        t0[some] = seat(c0[some].astype(np.int64), np.full(len(some), open0), np.full(len(some), d0 * totals.base), d0, rng)
        if sweep >= burn:
            yield Seating(t, c1, t1, c0, t0)
        if sweep + 1 == burn + samples:
            return
        rest, tables = less(c1[own], t1[own], t[many])
        gone = t1[own] - tables
        over = root(*less(c0[b.word[own]], t0[b.word[own]], gone))
        parent = (rest - d1 * tables + (totals.theta1 + d1 * np.maximum(t_class[own] - gone, 0)) * over) / (totals.theta1 + np.maximum(c_class[own] - t[many], rest))
        others = np.maximum(context - t[many], 0)
        t = t.copy()
        t[many] = seat(b.c[many], (totals.theta2 + d2 * others) * parent, d2 * parent, d2, rng)
        c1 = np.bincount(b.section, t, len(b.word))


def _told(rows: list[dict], totals: Totals) -> tuple[Core, Totals]:
    """A group's core, and totals with the tables of its contexts as their owners told them."""
    parts = sorted((r for r in rows if r["kind"] == TOTAL), key=lambda r: r["at"])
    t = np.concatenate([np.zeros(0), *[unpack(r["data"][0], "<i8") for r in parts]])
    return _core(next(r["data"] for r in rows if r["kind"] == CORE)), replace(totals, t=[t])


def _gather(totals: Totals, buckets: int, burn: int, samples: int):
    def run(table: pa.Table) -> pa.Table:
        core, given = _told(table.to_pylist(), totals)
        bucket = table["to"][0].as_py()
        seen = list(sweeps(core.bucket, bucket, given, burn, samples))
        sums = [float(x.c0.sum()) for x in seen] + [float(x.t0.sum()) for x in seen]
        classes = _by_class(core.bucket.kind, *[x.c1 for x in seen], *[x.t1 for x in seen])
        return _wire([*core.messages(bucket, [x.t for x in seen], buckets), (bucket, SUMS, bucket, None, sums), (bucket, CLASSES, bucket, None, classes)])

    return run


def predictive(c, t, context, c1, t1, at, c0, t0, totals: Totals, s: int) -> np.ndarray:
    """The probability of tokens under sample s: customers and tables of their pair, section and word, the index of their
    context and the place of their class in totals."""
    root = (c0 - totals.d0 * t0 + (totals.theta0 + totals.d0 * totals.t0[s]) * totals.base) / (totals.theta0 + totals.c0[s])
    c_class, t_class = (np.append(x[s], 0.0)[at] for x in (totals.c1, totals.t1))
    middle = (c1 - totals.d1 * t1 + (totals.theta1 + totals.d1 * t_class) * root) / (totals.theta1 + c_class)
    return (c - totals.d2 * t + (totals.theta2 + totals.d2 * totals.t[s][context]) * middle) / (totals.theta2 + totals.c[context])


def _replies(totals: Totals, burn: int, samples: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        bucket = rows[0]["to"]
        core, given = _told(rows, totals)
        b = core.bucket
        back, own = (next(r["data"] for r in rows if r["kind"] == k) for k in (BACK, OWN))
        t_own, _ = _tables(own, [r for r in rows if r["kind"] == SENT], samples)
        del rows
        per_pair, per_section, per_word = [narrow(b.c)], [], [b.c_word, unpack(own[2], "<i8"), *t_own]
        for x in sweeps(b, bucket, given, burn, samples):
            per_pair.append(narrow(x.t))
            per_section += [narrow(x.c1), narrow(x.t1)]
            per_word += [x.c0.astype(np.int64), x.t0.astype(np.int64)]
        section = narrow(b.section)
        del core, given, b, own, x
        sources, sizes, lengths = (unpack(x, k) for x, k in zip(back[:3], ("<i8", "<u4", "<u4"), strict=True))
        inverse, of = narrow(_unsteps(back[3])), narrow(_unsteps(back[4]))
        del back
        cut, cut_of = (np.cumsum([0, *x]).tolist() for x in (sizes, lengths))
        for j, x in enumerate(sources.tolist()):
            at, at_word = inverse[cut[j] : cut[j + 1]], of[cut_of[j] : cut_of[j + 1]]
            at_section = section[at]
            at_section = at_section[np.diff(at_section.astype(np.int64), prepend=-1) != 0]
            # all values of a pair (or section, word) lie side by side, as most repeat those of others
            rows = zip((per_pair, per_section, per_word), (at, at_section, at_word), (np.uint32, np.uint32, np.uint64), strict=True)
            data = [pack(np.stack([y[i] for y in values], 1).astype(kind).ravel()) for values, i, kind in rows]
            yield from _wire([(bucket, REPLY, x, data, None)]).to_batches()
        del inverse, of, section, per_pair, per_section, per_word
        trim()

    return run


def _summed(totals: Totals, samples: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("to")
        rows = table.to_pylist()
        doc = next(r["data"] for r in rows if r["kind"] == DOCS)
        answers = [r["data"] for r in rows if r["kind"] == REPLY]
        del rows
        take = lambda i, kind, n: np.ascontiguousarray(np.concatenate([unpack(x[i], kind).reshape(-1, n) for x in answers]).T)
        of_pair, of_section, of_word = take(0, "<u4", 1 + samples), take(1, "<u4", 2 * samples), take(2, "<u8", 2 + 3 * samples).astype(np.int64)
        del answers
        keys, null, train, n, ending, at, runs = (unpack(x, k) for x, k in zip(doc, ("<i8", "u1", "u1", "<u4", "<u2", "<u4", "<u4"), strict=True))
        n = n.astype(np.int64)
        first = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(runs)), runs)
        word = owner[at]
        context = np.append(0, word[:-1])
        context[first] = 0
        # sections are runs of pairs of one word and class
        kind = np.empty(len(owner), np.int64)
        kind[at] = ending[context]
        section = (np.cumsum((np.diff(owner, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0)) - 1)[at]
        place = np.searchsorted(totals.classes, ending)[context]
        shared = replace(totals, c=of_word[1], t=list(of_word[2 : 2 + samples]))
        log = np.empty(len(at))
        for x in range(0, len(at), SLICE):
            i = slice(x, x + SLICE)
            total = 0.0
            for s in range(samples):
                (c1, t1), (c0, t0) = of_section[2 * s :][:2], of_word[2 + samples + 2 * s :][:2]
                total = total + predictive(of_pair[0][at[i]], of_pair[1 + s][at[i]], context[i], c1[section[i]], t1[section[i]], place[i], c0[word[i]], t0[word[i]], shared, s)
            log[i] = np.log10(total / samples)
        count = of_word[0][word]
        base = np.log10((count + 0.1) / (totals.tokens + 0.1 * (totals.types + 1)))
        summed = lambda x: np.add.reduceat(x, first)
        return pa.table({"key": pa.array(keys, mask=null.astype(bool)), "train": pa.array(train.astype(bool)), "n_tokens": n, "n_known": summed((count > 0).astype(np.int64)), "base_score": summed(base), "score": summed(log)})

    return run


def _kept(df: DataFrame, path: str) -> DataFrame:
    """df written to the shared folder and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _removed(spark: SparkSession, path: str) -> None:
    """Delete a table that no later step reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _lean(f):
    """f over a group, after which the worker gives memory back."""
    def run(table: pa.Table) -> pa.Table:
        out = f(table)
        del table
        trim()
        return out

    return run


def _sums(df: DataFrame, n: int) -> list[float]:
    """The sums of the first n entries of the column sums."""
    return list(df.agg(*[F.coalesce(F.sum(F.col("sums")[i]), F.lit(0.0)) for i in range(n)]).first())


def _class_sums(df: DataFrame, values: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The classes of the CLASSES rows of df, sorted, and each one's sums."""
    width = values + 1
    rows = df.filter((F.col("kind") == CLASSES) & (F.size("sums") > 0)).select("sums", F.expr(f"sequence(0, size(sums) div {width} - 1)").alias("i"))
    x = rows.select(F.explode(F.transform("i", lambda i: F.slice("sums", i * width + 1, F.lit(width)))).alias("x"))
    got = x.groupBy(F.col("x")[0].alias("class")).agg(*[F.sum(F.col("x")[i + 1]).alias(f"s{i}") for i in range(values)]).collect()  # 2**16 rows at most
    table = np.array(sorted(map(tuple, got)), float).reshape(-1, width)
    return table[:, 0].astype(np.int64), [table[:, i + 1].copy() for i in range(values)]


def score(df: DataFrame, train: Column, text: str = "text", key: str = "doc_id", burn: int = 3, samples: int = 2, seed: int = 11, batch_bytes: int = 6 << 20, bucket_bytes: int = 8 << 20) -> DataFrame:
    """key, train, n_tokens, n_known, train_tokens, base_score, score (log10 probability), perplexity (per token) of every row of df.

    train: which rows are learned from. batch_bytes and bucket_bytes bound the text behind a map step and a bucket.
    """
    spark = df.sparkSession
    shared_dir(spark)
    small_batches(spark)
    own = df.select(F.col(key).cast("long").alias("key"), train.alias("train"), F.col(text).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(8, -(-size // bucket_bytes)))
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/hpylm-{uuid.uuid4().hex}"
    grouped = lambda *tables: reduce(DataFrame.unionByName, tables).groupBy("to")
    with shuffles_freed(spark):
        state = _kept(own.mapInArrow(_pairs(buckets, batch_bytes), WIRE).groupBy("to").applyInArrow(_lean(_state), WIRE), f"{folder}/state")
        core, back, contexts, docs = (state.filter(F.col("kind") == k) for k in (CORE, BACK, OWN, DOCS))
        tokens, types, *ones = _sums(core, 9)
        discount = lambda one, two: min(max(one / max(one + 2 * two, 1), 0.05), 0.95)
        d2, d1, d0 = (discount(*ones[i : i + 2]) for i in (0, 2, 4))
        classes, (c1, t1) = _class_sums(state, 2)
        start = Totals(np.zeros(0), [], classes, [c1], [t1], [ones[6]], [types], int(tokens), int(types), d2, d1, d0, seeds=(seed, 0))
        told = grouped(contexts, core.mapInArrow(_first(buckets), WIRE)).applyInArrow(_lean(_answer), WIRE)
        sent = _kept(grouped(core, told).applyInArrow(_lean(_gather(start, buckets, burn, 1)), WIRE), f"{folder}/prior")
        c0, t0 = _sums(sent.filter(F.col("kind") == SUMS), 2)
        classes, (c1, t1) = _class_sums(sent, 2)
        prior = replace(start, classes=classes, c1=[c1], t1=[t1], c0=[c0], t0=[t0], seeds=(seed, 1))
        told = _kept(grouped(contexts, sent.filter(F.col("kind") == SENT)).applyInArrow(_lean(_answer), WIRE), f"{folder}/told")
        sent = _kept(grouped(core, told).applyInArrow(_lean(_gather(prior, buckets, burn, samples)), WIRE), f"{folder}/samples")
    _removed(spark, f"{folder}/prior")
    sums = _sums(sent.filter(F.col("kind") == SUMS), 2 * samples)
    classes, by_class = _class_sums(sent, 2 * samples)
    last = replace(prior, classes=classes, c1=by_class[:samples], t1=by_class[samples:], c0=sums[:samples], t0=sums[samples:])
    replies = grouped(core, back, contexts, told, sent.filter(F.col("kind") == SENT)).applyInArrow(_replies(prior, burn, samples), WIRE)
    out = docs.unionByName(replies).groupBy("at").applyInArrow(_lean(_summed(last, samples)), "key long, train boolean, n_tokens long, n_known long, base_score double, score double")
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return out.select("key", "train", "n_tokens", "n_known", F.lit(start.tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))
