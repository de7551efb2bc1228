import zlib

import numpy as np

from spanforge.llm import langid as L


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = L.remainder("doc_id", 3)
    model = L.fit(docs.filter(fold != 1), sample_rows=400)
    out = L.identify(docs.withColumns({"fold": fold}), model).select("doc_id", "lang", "fold", "lang_pred", "lang_score").collect()
    assert all(r.fold == zlib.crc32(str(r.doc_id).encode()) % 3 for r in out)
    held = [r for r in out if r.fold == 1 and r.lang and r.lang_pred != "und"]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.lang_score <= 1 for r in out)
    again = L.identify(docs.repartition(5), L.fit(docs.repartition(3).filter(fold != 1), sample_rows=400)).select("doc_id", "lang_pred").collect()
    assert {(r.doc_id, r.lang_pred) for r in again} == {(r.doc_id, r.lang_pred) for r in out}


def test_edges(spark):
    rows = [(1, "the of and that", "en", "c"), (2, "der die und das", "de", "c"), (3, None, "de", "c"), (4, "", None, "c"), (5, "12 34 %%", "en", "c"), (None, "the and İİ" * 9000, None, "c"), (1, "the of and that", "en", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    out = L.identify(df, L.fit(df)).collect()
    got = [(r.doc_id, r.lang_pred) for r in out]
    assert got[2:5] == [(3, "und"), (4, "und"), (5, "und")] and got[0] == (1, "en") and got[1] == (2, "de") and got[5] == (None, "en")
    none = L.identify(df, L.fit(df.filter("false"))).collect()
    assert {(r.lang_pred, r.lang_score) for r in none} == {("und", 0.0)}
    assert L.identify(df.filter("false"), L.fit(df)).count() == 0


def test_features_stay_in_their_text():
    a, _, n = L.grams(["abc", "", "x", "abc"])
    assert n.tolist() == [6, 0, 1, 6]
    for f in a:
        assert f[:3].tolist() == f[4:].tolist()
    assert a[2].tolist()[1:4] == [L.SIZE] * 3 and a[1][3] == L.SIZE
