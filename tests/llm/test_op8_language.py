import zlib

import numpy as np

from rasterloom.llm import op8_language as op8

SF = "/root/testdata/sf0.01"


def test_kernel_counts_shared_ngrams():
    a, b = op8.presence(["Abcab", "bcé"])
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    x, y = grams(b"abcab"), grams("bcé".encode())
    assert a.sum() == len(x) and b.sum() == len(y) and (a & b).sum() == len(x & y)
    m = op8.Model(["q"], b[None], np.zeros((2, 1)))
    assert abs(m.kernel(a[None])[0, 0] - len(x & y) / (len(x) * len(y)) ** 0.5) < 1e-6


def test_held_out_accuracy(spark):
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = op8.op8_language(spark, SF).collect()
    assert len(out) == len(truth)
    held = [x for x in out if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in out)
    assert np.mean([x.lang_pred == truth[x.doc_id][0] for x in held]) > 0.97
    assert all(0 <= x.score <= 1 for x in out)


def test_texts_without_letters_and_empty_tables(spark):
    rows = [(1, "the cat and the dog", "en"), (3, "der hund und die katze", "de"), (4, None, "en"), (5, "12 !?", "en"), (6, "", None), (None, "der hund", None), (1, "the cat and the dog", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as lang_pred", "1 as score")
    out = sorted(map(tuple, op8.identify(df, op8.train(df)).select("doc_id", "lang_pred").collect()), key=str)
    assert len(out) == 7 and (4, "und") in out and (5, "und") in out and (6, "und") in out and (1, "en") in out and (3, "de") in out
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert op8.train(none) is None and op8.identify(none, None).count() == 0
    assert [x.lang_pred for x in op8.identify(df.where("doc_id = 1"), None).collect()] == ["und", "und"]
