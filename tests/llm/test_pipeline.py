import random
import struct

import corpus_pipeline as cp
from rasterloom.llm import op10_packing as op10
from rasterloom.llm import op9_mixing as op9
from tests.llm.test_op4_suffix_dedup import brute as brute_bytes
from tests.llm.test_op6_minhash import brute as brute_classes


def corpus():
    r = random.Random(8)
    langs = {"en": "the of and to in that it was for with".split(), "de": "der die und das nicht ein zu für mit auf".split()}
    rows = []
    for d in range(160):
        lang = r.choice(list(langs))
        t = [r.choice(langs[lang]) + r.choice(("", "", "er", "ly" if lang == "en" else "ung")) for _ in range(r.randint(3, 120))]
        rows.append([d, " ".join(t), lang, f"s{d % 3}", 0])
    shared = rows[5][1] + " é end of a passage that comes again in other documents, word by word, and once more"
    for d in range(60, 70):
        rows[d][1] = rows[d][1] + " " + shared
    rows += [[200 + k, rows[40][1], "en", "s0", 0] for k in range(20)] + [[230, None, None, None, None], [231, "", "de", None, 0], [232, "12 34", "en", "s1", 5], [None, "the end of it", "en", "s1", 0], [240, "the only one here of and to", None, None, None]]
    return [tuple(x) for x in rows]


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = [rows]
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append([tuple(x) for x in docs.collect()])
    raw, spoken, near, cut, mixed = seen
    assert {x[0] for x in raw} - {x[0] for x in spoken} == {230, 231, 232} and len(spoken) == len(raw) - 3
    want = {d for d, c in brute_classes([x[:2] for x in spoken]) if d == c and d is not None}
    assert {x[0] for x in near} == want | {None} and len(near) == len(want) + 1
    assert {x[1] for x in near} <= {x[1] for x in spoken}
    left = {d: k[3].decode(errors="ignore") for d, k in brute_bytes([x[:2] for x in near if x[0] is not None], 100).items()}
    assert {x[0]: x[1] for x in cut if x[0] is not None} == {d: t for d, t in left.items() if t}
    assert all(x[4] == len(x[1]) for x in cut if x[0] is not None)
    size = {}
    for x in cut:
        size[x[3]] = size.get(x[3], 0) + len(x[1].split())
    target = op9.targets(size)
    for s in size:
        assert abs(sum(len(x[1].split()) for x in mixed if x[3] == s) - target[s]) <= 130
    assert max(mixed.count(x) for x in mixed) <= 3
    out = cp.packing(spark, docs, str(tmp_path)).collect()
    tok = op10.Encoder(op10.default_tokenizer())
    want = sorted((x[0] is None, x[0] or 0, *p) for x in mixed for p in op10.pieces_of(tok.direct(x[1]) + struct.pack("<I", 2), 1024))
    assert sorted((x.doc_id is None, x.doc_id or 0, x.start, x.length, x.ids_crc32) for x in out) == want


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_replacement_characters_of_a_text_outlive_a_cut_inside_another(spark, tmp_path):
    shared = " ".join(f"x{i}" for i in range(60))
    rows = [(1, shared + "é", "en", "s", 0), (2, "\ufffd start " + shared + "è and \ufffd more", "en", "s", 0), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id: (x.text, x.n_chars) for x in cp.suffix_array_dedup(spark, docs, str(tmp_path)).collect()}
    assert got[1][0] == shared + "é" and got[2] == ("\ufffd start  and \ufffd more", 19) and len(got) == 2


def test_one_id_on_several_texts_is_not_multiplied(spark, tmp_path):
    shared = " ".join(f"y{i}" for i in range(60))
    rows = [(1, "one " + shared, "en", "s", 0), (1, "two and other words", "de", "s", 0), (2, "three " + shared, "en", "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.suffix_array_dedup(spark, docs, str(tmp_path)).collect()
    assert sorted((x.doc_id, x.lang) for x in got) == [(1, "de"), (1, "en"), (2, "en")] and {x.text for x in got} >= {"two and other words"}
