import random
from collections import Counter

import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

import corpus_pipeline as C  # noqa: E402

from .test_simhash import similar  # noqa: E402
from .test_substrings import brute as windows  # noqa: E402


def documents(spark):
    r = random.Random(9)
    words = {"en": "the of and to in that is was for with house water".split(), "de": "der die und das ist nicht mit für haus wasser straße".split()}
    text = lambda k, n: " ".join(r.choice(words[k]) + r.choice(["", "s", "e", "ab", "ol"]) for _ in range(n))
    passage = text("en", 30)
    rows = [(i, text("de" if i % 3 else "en", r.randrange(30, 90)) + (" " + passage if i % 7 == 0 else ""), "de" if i % 3 else "en", f"s{i % 4}") for i in range(120)]
    rows += [(200 + i, rows[i][1], rows[i][2], "s9") for i in range(0, 40, 4)]
    near = [rows[i][1].split() for i in range(1, 60, 9)]
    for w in near:
        w[len(w) // 2] = "changed"
    rows += [(250 + i, " ".join(w), "en", "s2") for i, w in enumerate(near)]
    rows += [(300, None, "en", "s0"), (301, "12 %% 34", "en", None), (302, "", "de", "s0"), (303, text("de", 40), None, None), (5, *rows[5][1:]), (None, text("en", 50), "en", "s1")]
    df = spark.createDataFrame([(i, t, k, s, len(t or "")) for i, t, k, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return rows, df.repartition(4)


def test_stages_against_plain_versions(spark):
    rows, docs = documents(spark)
    assert [n for n, _ in C.STAGES] == ["language_id", "near_dedup", "substring_dedup", "source_mixing", "bpe_encoding"] and C.ORACLE_SQL is None
    got = []
    for _, stage in C.STAGES:
        docs = stage(spark, docs, "").checkpoint()
        got.append(docs.collect())
        if len(got) < 5:
            assert docs.columns == C.COLUMNS
    lang, near, sub, mixed, encoded = got
    has_letter = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert sorted(str(r.doc_id) for r in lang) == sorted(str(r[0]) for r in has_letter) and all(r.lang for r in lang)
    # one document of each group, the smallest
    want = [min((lang[i].doc_id for i in g if lang[i].doc_id is not None), default=-1) for g in similar([r.text for r in lang])]
    assert len(want) < len({r.text for r in lang}) and sorted(r.doc_id or -1 for r in near) == sorted(x or -1 for x in want)
    texts = {r.doc_id: r.text for r in near}
    plain = {i: (t, n, k) for (i, t), (n, k, _) in zip(texts.items(), windows(list(texts.items()), 20), strict=True)}
    kept = {i: w for i, w in zip(texts, windows(list(texts.items()), 20), strict=True)}
    assert {r.doc_id for r in sub} == {i for i, (_, n, k) in plain.items() if n > k}
    for r in sub:
        n, gone, left = kept[r.doc_id]
        assert r.text == (left if gone else texts[r.doc_id]) and r.n_chars == len(r.text)
    assert any(kept[r.doc_id][1] for r in sub)
    total = sum(len(r.text.split()) for r in sub)
    taken = sum(len(r.text.split()) for r in mixed)
    assert abs(taken - 1.5 * total) < 0.2 * total and max(Counter(r.doc_id for r in mixed).values()) == 2
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by_id = {r.doc_id: r.text for r in mixed}
    assert len(encoded) == len(mixed)
    for r in encoded:
        assert r.round_trip and r.ids == t.encode(by_id[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_run_on_driver_documents_and_on_none(spark, tmp_path):
    out = C.run(spark, "/root/testdata/sf0.001").collect()
    assert out and all(r.round_trip for r in out)
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
