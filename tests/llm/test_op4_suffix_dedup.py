import random

import numpy as np
import pandas as pd

from rasterloom.llm import op4_suffix_dedup as op4
from rasterloom.llm.pfp import equal_runs, suffix_order
from tests.llm.test_op1_substring_dedup import corpus, periodic


def brute(rows, w):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - w + 1):
            key = b[s : s + w]
            if key in seen:
                gone[s : s + w] = [True] * w
            seen.add(key)
        out[d] = (len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), bytes(x for x, g in zip(b, gone) if not g))
    return out


def test_suffix_order_of_repetitive_text():
    r = random.Random(3)
    base = bytes(r.choice(b"abc ") for _ in range(400))
    texts = [base[a : a + r.randint(0, 200)] for a in (r.randint(0, 300) for _ in range(40))] + [b"", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 3]
    t, order = suffix_order(texts)
    raw = t.tobytes()
    assert order.tolist() == sorted(range(len(order)), key=lambda i: raw[i:])
    kind = equal_runs(t, order, 10)
    key = [(raw + b"\xff" * 10)[i : i + 10] for i in order]
    assert np.array_equal(kind, np.cumsum([k > 0 and key[k] != key[k - 1] for k in range(len(key))]))


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    want = brute(rows, 100)
    for shard_bytes, spread in ((8 << 20, 2048), (4000, 2)):
        monkeypatch.setattr(op4, "SPREAD", spread)
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as shard", "1 as h1")
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in op4.suffix_dedup(df, shard_bytes=shard_bytes).collect()}
        assert got == want


def test_empty_table_and_null_and_repeated_rows(spark):
    assert op4.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = "".join(f"x{i}" for i in range(90))
    n = len(t)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed, r.n_spans) for r in op4.suffix_dedup(spark.createDataFrame([(1, t), (1, t), (2, t), (None, "a b"), (3, None)], "doc_id long, text string")).collect())
    assert got == [(False, 1, 0, 0), (False, 1, 0, 0), (False, 2, n, 1), (False, 3, 0, 0), (True, 0, 0, 0)]


def test_lines_repeated_at_the_length_of_a_name(spark):
    rows = periodic(lambda r: r.choice("abcdefghijklmnopqrstuvwxyz "), "", 85, (190, 340, 700, 2000))
    for shard_bytes in (8 << 20, 4000):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in op4.suffix_dedup(df, shard_bytes=shard_bytes).collect()} == brute(rows, 100)


def test_lines_repeated_at_the_length_of_any_name(spark):
    rows = periodic(lambda r: r.choice("abcdefghijklmnopqrstuvwxyz "), "", 69, (190, 340, 700, 2000))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for gram in (16, 32):
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in op4.suffix_dedup(df, gram=gram).collect()} == brute(rows, 100)


def test_common_phrases_alone_put_little_into_suffix_order(spark, monkeypatch):
    """Texts of few words share many short phrases, but no windows; a passage that does recur is found among them."""
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(40)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = say(30)
    rows = [(d, f"{say(80)} {passage} {say(20)}" if d % 40 == 0 else say(120)) for d in range(400)]
    sizes = {}

    def sized(df, name):
        out = write(df, name)
        if name == "rims":
            sizes[name] = out.selectExpr("sum(octet_length(text)) as b").first()["b"]
        return out

    write = op4.written
    monkeypatch.setattr(op4, "written", sized)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in op4.suffix_dedup(df).collect()} == brute(rows, 100)
    assert sizes["rims"] < sum(len(t) for _, t in rows) / 10


def test_segments_that_share_only_a_name_are_not_ordered(monkeypatch):
    r = random.Random(6)
    say = lambda n: bytes(r.choice(b"abcdefgh") for _ in range(n))
    name, shared = say(32), say(70)
    texts = [say(84) + name + say(84) for _ in range(50)] + [say(20) + shared + name + say(30), say(40) + shared + name + say(10)]
    rims = pd.DataFrame([{"h1": 1, "h2": k, "kinds": len(texts), "doc_id": k, "a": 0, "nw": len(t) - 99, "text": t} for k, t in enumerate(texts)])
    seen = []
    monkeypatch.setattr(op4, "suffix_order", lambda texts, at: seen.extend(texts) or suffix_order(texts, at))
    got = op4._settle(100)(rims)
    assert got[["late", "doc_id", "s", "nw"]].values.tolist() == [[True, 51, 40, 3]] and seen == texts[50:]
    assert not len(op4._settle(100)(rims[:50]))


def test_a_common_line_of_many_contexts_sends_no_windows(spark, monkeypatch):
    """A line shorter than a window in more contexts than SPREAD, and one longer than a window: the first has no row a window."""
    monkeypatch.setattr(op4, "SPREAD", 8)
    r = random.Random(7)
    say = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    line, passage = say(60), say(140)
    rows = [(d, say(120) + (line if d % 2 else passage) + say(120)) for d in range(80)]
    spread = {}

    def counted(df, name):
        out = write(df, name)
        if name == "settled":
            spread["long" if len(rows) > 40 else "short"] = out.where("not late").count()
        return out

    write = op4.written
    monkeypatch.setattr(op4, "written", counted)
    for rows in (rows, rows[1::2]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in op4.suffix_dedup(df).collect()} == brute(rows, 100)
    assert spread["short"] == 0
