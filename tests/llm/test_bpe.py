import pytest

from spanforge.llm import bpe

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def path():
    return P.path("byte_bpe_50k.json")


TEXTS = [
    None, "", " ", "\n\n  x", "Hello world, it's we'll they'VE 123  456\t\tx ", "aaaaaaaaaaaaaaaaaaaaaaaaaaa bbbb aaaaa", "a<|endoftext|>b <|endoftext|>", "<|endoftext|>",
    "Ünïcödé ñandú 東京 🙂🙃 ​ x\x00\x01", "é" * 300, "$$$ ***&&&%%%### ...", "ß" * 7 + " \r\n\x0b\x0c " * 5, "the of and " * 3000, "﻿ x", "٣٤٥ ½ ²",
]


def test_same_ids_and_texts_as_the_library(spark, path):
    t = tokenizers.Tokenizer.from_file(path)
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(TEXTS)], "doc_id int, text string, ids string")
    enc = bpe.encode(df, path)
    out = {r.doc_id: r for r in bpe.decode(enc, path).collect()}
    assert {r.doc_id: r for r in bpe.encode_decode(df.withColumn("decoded", df.text), path).collect()} == out
    for i, x in enumerate(TEXTS):
        want = t.encode(x or "", add_special_tokens=False).ids
        assert out[i].ids == want, x
        assert out[i].decoded == t.decode(want, skip_special_tokens=False) == (x or "")


def test_driver_texts(spark, path):
    t = tokenizers.Tokenizer.from_file(path)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = bpe.decode(bpe.encode(df, path, batch_bytes=50_000), path).collect()
    for r, e in zip(rows, t.encode_batch([r.text or "" for r in rows], add_special_tokens=False), strict=True):
        assert r.ids == e.ids and r.decoded == (r.text or "")


def test_odd_ids(spark, path):
    t = tokenizers.Tokenizer.from_file(path)
    df = spark.createDataFrame([([50256, 300, None, 10**6, -4],), ([220, 160, 161],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(df, path).collect()] == [t.decode([50256, 300], skip_special_tokens=False), t.decode([220, 160, 161], skip_special_tokens=False), "", ""]


def test_no_rows(spark, path):
    assert bpe.encode(spark.createDataFrame([], "text string"), path).count() == 0


def test_long_pieces(path):
    import random
    import time

    r = random.Random(2)
    v, t = bpe.load_vocabulary(path), tokenizers.Tokenizer.from_file(path)
    texts = ["a" * 5001, "ab" * 700, "".join(r.choice("ACGT") for _ in range(30_000)), "".join(r.choice("etaoinshr") for _ in range(20_000)), "=" * 999, "é" * 400, "x", "theand" * 300, "a" * 255]
    ids, cut = bpe.merge([x.encode() for x in texts], v)
    for i, x in enumerate(texts):
        assert ids[cut[i] : cut[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, x[:20]
    assert bpe.merge([], v)[0].tolist() == []
    long = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    began = time.time()
    ids, _ = bpe.merge([long.encode()], v)
    print("seconds:", time.time() - began)
    assert time.time() - began < 60 and ids.tolist() == t.encode(long, add_special_tokens=False).ids
