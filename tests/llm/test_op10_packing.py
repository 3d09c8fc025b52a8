import json
import random
import struct
import zlib

import pytest

from rasterloom.llm import op10_packing as op10


def test_fullest_against_all_combinations():
    r = random.Random(0)
    for _ in range(60):
        lens = [r.randint(1, 30) for _ in range(9)]
        counts = [0] * 41
        for x in lens:
            counts[x] += 1
        first = max(lens)
        got = op10.fullest(counts, first, 40)
        rest = lens.copy()
        rest.remove(first)
        best = max(s for m in range(1 << 8) if (s := first + sum(x for k, x in enumerate(rest) if m >> k & 1)) <= 40)
        assert sum(x * k for x, k in got.items()) == best and all(k <= counts[x] for x, k in got.items())


def test_pieces_of_long_documents():
    ids = bytes(4 * 2500)
    assert [p[:2] for p in op10.pieces_of(ids, 1024)] == [(0, 452), (452, 1024), (1476, 1024)]
    assert [p[:2] for p in op10.pieces_of(bytes(4 * 2048), 1024)] == [(0, 1024), (1024, 1024)]
    assert [p[:2] for p in op10.pieces_of(bytes(4), 1024)] == [(0, 1)]


def test_same_ids_as_the_tokenizer():
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(op10.default_tokenizer())
    e = op10.Encoder(op10.default_tokenizer())
    r = random.Random(1)
    chars = "aé'stdm \n\t\r!?.19ßÀ¾ªºʼn²" + " \x85\x1c 　日😀\x00"
    texts = ["<|endoftext|> a", "don't  we'll\n\n x", " ", "\n \n"] + ["".join(r.choice(chars[: r.choice([12, 24, len(chars)])]) for _ in range(r.randint(1, 60))) for _ in range(1500)]
    for t in texts:
        want = tok.encode(t, add_special_tokens=False).ids
        assert e(t) == struct.pack(f"<{len(want)}I", *want), repr(t)


def test_long_runs():
    e = op10.Encoder(op10.default_tokenizer())
    for t in (" " * 300_000, (" " * 999 + "x") * 50, "a" * 100_000, "qzjxkvb" * 10_000, "^-=#" * 20_000, "a\n" * 20_000):
        assert e(t) == e.direct(t)


def test_vocabulary_by_ranks(tmp_path):
    assert op10.by_ranks(op10.default_tokenizer())
    with open(op10.default_tokenizer(), encoding="utf-8") as f:
        model = json.load(f)
    known = model["model"]["vocab"]
    bytes_ = {t: k for t, k in known.items() if len(t) == 1}
    kinds = {}
    # By its merges, abc of this list is a + bc, but bc comes after ab: joining by ids alone makes ab + c into abc.
    for name, merges in (("good", [["a", "b"], ["ab", "c"]]), ("bad", [["a", "b"], ["b", "c"], ["a", "bc"]])):
        model["model"] |= {"vocab": bytes_ | {x + y: 256 + k for k, (x, y) in enumerate(merges)}, "merges": merges}
        kinds[name] = str(tmp_path / f"{name}.json")
        with open(kinds[name], "w", encoding="utf-8") as f:
            json.dump(model, f)
    assert op10.by_ranks(kinds["good"]) and not op10.by_ranks(kinds["bad"])
    for path in kinds.values():
        e = op10.Encoder(path)
        for t in ("abc", "aabcbc", " abcab", "bcabc"):
            assert e(t) == e.direct(t)


def test_packing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op10, "RANKED", 20)
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["the", "and", "xyzzy", "é"]) for _ in range(int(r.expovariate(1 / 300))))) for i in range(200)] + [(500, None), (501, ""), (502, "a " * 5000), (502, "a " * 5000), (None, "b")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as bucket").write.parquet(str(tmp_path / "documents.parquet"))
    out = op10.op10_packing(spark, str(tmp_path)).collect()
    bins = {}
    for x in out:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 1024
    ffd: list[int] = []  # first-fit decreasing
    for n in sorted((x.length for x in out), reverse=True):
        k = next((k for k, room in enumerate(ffd) if room >= n), len(ffd))
        ffd[k:] = [ffd[k] - n, *ffd[k + 1 :]] if k < len(ffd) else [1024 - n]
    assert len(bins) <= len(ffd)
    tok = op10.Encoder(op10.default_tokenizer())
    for d, t in rows:
        ids = (tok.direct(t) if t else b"") + struct.pack("<I", 2)
        mine = sorted({(x.piece, x.start, x.length, x.ids_crc32) for x in out if x.doc_id == d})
        assert mine == [(k, *p) for k, p in enumerate(op10.pieces_of(ids, 1024))]
        assert mine[0][3] == zlib.crc32(ids[: 4 * mine[0][2]])
    assert len({x.sequence_id for x in out}) == len(bins)
    assert op10.pack(op10.token_pieces(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
