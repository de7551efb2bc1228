"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Lower-cased code-point n-grams are hashed into 2**16 features; a feature's value is its share of the text's
n-grams times its inverse document frequency. Document frequencies come from every labelled document. The
weights are fitted by follow-the-regularised-leader with elastic-net penalties on a sample of labelled rows,
stratified by language and bounded by `sample_rows`; a part of it that isn't fitted sets the temperature
that calibrates the probabilities. Prediction reads whole texts and nothing but the text.

Defined results: a text that is null or has no letter is `und` with score 0, and so is every text if no row is
labelled; ties go to the smaller language name; other columns pass through, and output columns replace
columns of their name. Where there are more than MOST_LANGUAGES label values, the most frequent ones are learned
(ties: the smaller names) and the others are never predicted. The sample is the rows with the smallest hashes of key
and text, so repeated rows and null keys don't matter, and reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import chunks, small_batches, trim

BITS, ORDERS = 16, (1, 2, 3)
SIZE = 1 << BITS
MOST_LANGUAGES = 1000
#: Factor that brings the features' shares near one.
SCALE = 20.0
STEPS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


@dataclass
class Model:
    """weights has idf * SCALE in it and a last row of zeros for positions without an n-gram."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the feature of every position (SIZE where the text ends before), each text's offsets, its number of n-grams."""
    low = [t.lower() for t in texts]
    size = np.fromiter(map(len, low), np.int64, len(low))
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum(size)])
    out = []
    h = np.zeros(len(codes), np.uint32)
    for n in ORDERS:
        h[: len(codes) - n + 1] = h[: len(codes) - n + 1] * STEPS[0] + codes[n - 1 :] + STEPS[1] if len(codes) >= n else 0
        x = h ^ (h >> np.uint32(15))
        x *= STEPS[2]
        f = (x >> np.uint32(32 - BITS)).astype(np.int32)
        for back in range(1, n):
            at = offsets[1:][size >= back] - back
            f[at] = SIZE
        out.append(f)
    return out, offsets, sum(np.maximum(size - n + 1, 0) for n in ORDERS)


def _document_counts(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, documents, seen = np.zeros(SIZE + 1, np.int64), 0, np.zeros(SIZE + 1, bool)
        for table in chunks(batches, "text", limit):
            features, offsets, _ = grams([t or "" for t in table["text"].to_pylist()])
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for f in features:
                    seen[f[a:b]] = True
                counts += seen
                seen[:] = False
            documents += len(offsets) - 1
        counts[SIZE] = documents
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["f", "n"])

    return run


def _samples(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "text", limit):
            features, offsets, total = grams(table["text"].to_pylist())
            index, share = [], []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                counts = np.bincount(np.concatenate([f[a:b] for f in features]), minlength=SIZE + 1)[:SIZE]
                index.append(np.flatnonzero(counts).astype(np.int32))
                share.append((counts[index[-1]] / max(total[i], 1)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([table["lang"].combine_chunks(), table["pick"].combine_chunks(), pa.array(index, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], ["lang", "pick", "i", "x"])

    return run


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights (features and a last row for the bias, by class) after follow-the-regularised-leader steps over the rows."""
    z, n = np.zeros((SIZE + 1, classes)), np.zeros((SIZE + 1, classes))

    def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return -(z - np.clip(z, -l1, l1)) / ((beta + np.sqrt(n)) / alpha + l2)

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            i, x = rows[k]
            w, m = weight(z[i], n[i]), n[i]
            score = x @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[labels[k]] -= 1
            g = x[:, None] * p
            z[i] += g - (np.sqrt(m + g * g) - np.sqrt(m)) / alpha * w
            n[i] = m + g * g
    return weight(z, n)


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = 4000, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, batch_bytes: int = 2 << 20) -> Model:
    """Learn from the rows of df with a label and a text. About sample_rows of them are fitted; document frequencies count all."""
    small_batches(df.sparkSession)
    own = df.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.lit(17), F.col(key), F.col(text)).alias("pick")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((SIZE + 1, 0), np.float32), np.zeros(0), 1.0)
    counts = np.zeros(SIZE + 1, np.int64)
    for r in own.select("text").mapInArrow(_document_counts(batch_bytes), "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():  # SIZE + 1 rows at most
        counts[r["f"]] = r["n"]
    idf = np.log((1 + counts[SIZE]) / (1 + counts[:SIZE])) + 1
    share = sample_rows / len(languages)
    chosen = F.lit(False)
    for x in languages:
        chosen = chosen | ((F.col("lang") == x) & (F.pmod("pick", F.lit(1 << 31)) < int(min(1.0, share / sizes[x]) * (1 << 31))))
    table = own.filter(chosen).mapInArrow(_samples(batch_bytes), "lang string, pick long, i array<int>, x array<float>").orderBy(F.pmod("pick", F.lit(1 << 31)), "pick", "lang").limit(2 * sample_rows).toArrow().sort_by([("pick", "ascending"), ("lang", "ascending")])
    rows = [(np.append(i.values.to_numpy(), np.int32(SIZE)), np.append(x.values.to_numpy() * idf[i.values.to_numpy()] * SCALE, 1.0).astype(np.float32)) for i, x in zip(table["i"], table["x"], strict=True)]
    labels = np.array([languages.index(x) for x in table["lang"].to_pylist()], np.int64)
    del table
    held = np.arange(len(rows)) % 5 == 0 if len(rows) >= 10 else np.zeros(len(rows), bool)
    w = ftrl([r for r, h in zip(rows, held, strict=True) if not h], labels[~held], len(languages), epochs, alpha, beta, l1, l2)
    temperature = 1.0
    if held.any():
        scores = np.array([x @ w[i] for (i, x), h in zip(rows, held, strict=True) if h])

        def loss(t: float) -> float:
            s = scores / t
            s = s - s.max(1, keepdims=True)
            return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), labels[held]]))

        temperature = min(np.geomspace(0.1, 10, 81).tolist(), key=loss)
    weights = np.concatenate([w[:SIZE] * (idf * SCALE)[:, None], np.zeros((1, len(languages)))]).astype(np.float32)
    del rows
    trim()  # the driver goes on to other work
    return Model(languages, weights, w[SIZE], temperature)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The most probable language of each text and its calibrated probability."""
    letter = regex.compile(r"\p{L}").search
    real = np.array([bool(t) and letter(t) is not None for t in texts], bool) & bool(model.languages)
    names, best = np.full(len(texts), "und", object), np.zeros(len(texts))
    if real.any():
        features, offsets, total = grams([t for t, r in zip(texts, real, strict=True) if r])
        score = np.zeros((int(real.sum()), len(model.languages)))
        for c in range(len(model.languages)):
            column = np.ascontiguousarray(model.weights[:, c])
            score[:, c] = sum(np.add.reduceat(column[f], offsets[:-1]) for f in features) / total + model.bias[c]
        score = score / model.temperature
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        at = p.argmax(1)
        names[real], best[real] = np.array(model.languages, object)[at], p[np.arange(len(at)), at]
    return names.tolist(), best


def identify(df: DataFrame, model: Model, text: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """df with lang_pred and lang_score (0 to 1)."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by SIZE and MOST_LANGUAGES
    made = {"lang_pred", "lang_score"}
    kept = [c for c in df.columns if c not in made]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, text, batch_bytes):
            for b in table.to_batches():
                names, best = predict(shared.value, b.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(names, pa.string()), pa.array(best)], schema.names)

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def remainder(key: str, by: int) -> Column:
    """crc32 of the key's decimal text, modulo by; that of a null key is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % by, F.lit(0))
