import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.operators import codecs


def payloads():
    r = random.Random(3)
    yield from (b"", b"A", b"AA", b"AAA", b"A" * 130, b"A" * 131, r.randbytes(128), r.randbytes(129), bytes(range(256)) * 3, b"AB" * 500, b"A" * 5000)
    yield from (r.randbytes(50) + bytes(4046) + b"", bytes(r.choice(b"ab") for _ in range(3000)), bytes(min(255, int(r.expovariate(0.02))) for _ in range(5000)), bytes(range(17)), b"".join(bytes([k]) * 2 ** min(k, 12) for k in range(30)))
    far = r.randbytes(20)
    yield far + bytes(4096 - 20) + far + bytes(4097 - 20) + far


@pytest.mark.parametrize("name", codecs.CODECS)
def test_what_was_encoded_is_decoded(name):
    enc, dec = codecs.CODECS[name]
    for p in payloads():
        s = enc(p)
        assert dec(s) == codecs.decode_any(s) == p and len(s) % 4 == 0 and int.from_bytes(s[1:4], "little") == len(p)


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=600), st.lists(st.sampled_from([b"a", b"bb", b"abc", b"\0"]), max_size=200).map(b"".join)))
def test_any_payload(p):
    for enc, dec in codecs.CODECS.values():
        assert dec(enc(p)) == p


def test_formats():
    assert codecs.rle_encode(b"A" * 5) == bytes.fromhex("30050000824100" + "00")
    assert codecs.store(b"\1\2\3") == bytes.fromhex("0003000001020300")
    for p in payloads():
        made = 0
        for length, d in codecs.lz_tokens(codecs.lz_encode(p)):
            assert not length or 3 <= length <= 18 and 2 <= d <= min(4096, made)
            made += length or 1
        assert len(codecs.rle_encode(p)) <= 8 + len(p) + -(-len(p) // 128)
    with pytest.raises(ValueError):
        codecs.rle_encode(bytes(1 << 24))


def test_columns(spark):
    df = spark.createDataFrame([(1, "aaaaaaab"), (2, ""), (3, None)], "k int, t string")
    for name in codecs.CODECS:
        got = {r.k: (r.raw_size, bytes(r.decoded)) for r in codecs.roundtrip(df, "k", "t", name).collect()}
        assert got == {1: (8, b"aaaaaaab"), 2: (0, b""), 3: (0, b"")}
    same = df.where("t is not null").select(codecs.encode(df.t.cast("binary"), "store").alias("a"), "t").collect()
    assert all(bytes(r.a) == codecs.store(r.t.encode()) for r in same)


def test_long_codes_and_blocks(monkeypatch):
    r = random.Random(5)
    steps = b"".join(bytes([k]) * n for k, n in enumerate((1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377)))
    for p in (steps, bytes(r.choice(steps) for _ in range(4000)), b"A" * 999, r.randbytes(700)):
        packed = codecs.huffman_encode(p)
        for most, block in ((20, 8), (20, 1 << 16), (3, 8)):
            monkeypatch.setattr(codecs, "LOOKED_UP", most)
            monkeypatch.setattr(codecs, "BLOCK", block)
            assert codecs.huffman_decode(packed) == p


def test_longest_match_of_the_window():
    r = random.Random(6)
    for _ in range(300):
        raw, at = bytes(r.choice(b"ab") for _ in range(60)), r.randrange(2, 57)
        most = min(18, 60 - at)
        same = lambda p: next((k for k in range(most) if raw[p + k] != raw[at + k]), most)
        want = max((same(p) for p in range(at - 1)), default=0)
        assert codecs._longest(raw, at, most)[0] == (want if want >= 3 else 0)


def test_payloads_too_large_have_no_stream(spark):
    df = spark.range(2).selectExpr("id", "repeat('a', if(id = 0, 16777216, 5)) AS t")
    for name in codecs.CODECS:
        got = {x.id: x.decoded for x in codecs.roundtrip(df, "id", "t", name).collect()}
        assert got[0] is None and bytes(got[1]) == b"aaaaa"


@pytest.mark.parametrize("name", ["rle", "store", "lz77", "huffman"])
def test_codec_batches_are_bounded(spark, name):
    import pyarrow as pa

    from rasterloom.functions import batches

    enc, dec = codecs.CODECS[name]
    raws = [bytes([k]) * 700_000 for k in range(30)] + [b"", None, b"abc"]
    packed = [r if r is None else enc(r) for r in raws]
    for f, given, want in ((enc, raws, packed), (codecs.decode_any, packed, raws)):
        out = list(codecs._each(f, codecs.LIMIT).func(iter([pa.array(given, pa.binary())])))
        assert [x for b in out for x in b.to_pylist()] == want
        assert all(b.nbytes <= batches.BATCH_BYTES + 800_000 for b in out)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.createDataFrame([(k, "ab" * 50_000) for k in range(100)] + [(100, None)], "k int, t string").coalesce(1)
    rows = codecs.roundtrip(df, "k", "t", name).collect()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == batches.BATCH_BYTES
    assert len(rows) == 101 and all(bytes(r.decoded) == (b"" if r.k == 100 else b"ab" * 50_000) and r.packed_size == len(enc(bytes(r.decoded))) for r in rows)


def test_huffman_looks_up_faster_than_bit_by_bit_in_bounded_memory(monkeypatch):
    import time
    import tracemalloc

    r, laid = random.Random(7), []
    made = codecs._laid_out
    monkeypatch.setattr(codecs, "_laid_out", lambda t: laid.append(t) or made(t))
    raw = bytes(min(255, int(r.expovariate(0.03))) for _ in range(300_000))
    packed = codecs.huffman_encode(raw)
    assert len(laid) == 1
    tree, body = packed[5 : 4 + 2 * (packed[4] + 1)], packed[4 + 2 * (packed[4] + 1) :]
    times = []
    for f, args in ((codecs._symbols, (tree, body, len(raw))), (codecs.huffman_decode, (packed,)), (codecs.huffman_decode, (packed,))):
        begin = time.process_time()
        assert f(*args) == raw
        times.append(time.process_time() - begin)
    assert 3 * min(times[1:]) < times[0]
    tracemalloc.start()
    packed = codecs.huffman_encode(raw * 20)
    assert tracemalloc.get_traced_memory()[1] < 4 * 20 * len(raw)
    tracemalloc.stop()
    assert codecs.huffman_decode(packed) == raw * 20


def test_steps_are_followed_to_any_number_of_places():
    r = random.Random(8)
    for _ in range(200):
        steps = np.array([r.randrange(1, 21) for _ in range(r.randrange(1, 90))], np.uint8)
        at, most = r.randrange(0, 25), r.randrange(1, 60)
        want, k = [], at
        while k < len(steps) and len(want) < most:
            want.append(k)
            k += int(steps[k])
        places, beyond = codecs._followed(steps, at, most)
        assert places.tolist() == want and (len(want) == most or beyond == k - len(steps))


@pytest.mark.parametrize("block", [37, codecs.LZ_BLOCK])
def test_bounds_of_matches_change_no_stream(monkeypatch, block):
    def plain(raw):
        at = 0
        while at < len(raw):
            best, where = codecs._longest(raw, at, min(18, len(raw) - at))
            yield (best, at - where) if best else (0, raw[at])
            at += best or 1

    r = random.Random(9)
    monkeypatch.setattr(codecs, "LZ_BLOCK", block)
    for raw in [*payloads(), *(bytes(r.choice(b"abcdefgh"[:k]) for _ in range(r.randrange(400))) for k in range(1, 9) for _ in range(8)), b"".join(r.choice([b"some ", b"words ", b"again ", r.randbytes(3)]) for _ in range(4000))]:
        bounds = codecs._bounds(raw)
        assert len(bounds) == len(raw) and all(bounds[at] >= codecs._longest(raw, at, min(18, len(raw) - at))[0] for at in range(0, len(raw), 7))
        assert list(codecs.lz_tokens(codecs.lz_encode(raw))) == list(plain(raw))
