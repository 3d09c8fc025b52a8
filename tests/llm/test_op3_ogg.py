import hashlib
import random
import zlib

from rasterloom.llm import ogg
from rasterloom.llm import op3_ogg as op3


def slow_checksum(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
    return c


def test_checksum_against_bitwise_division():
    r = random.Random(1)
    for n in (0, 1, 3, 27, 300):
        d = r.randbytes(n)
        assert ogg.checksum(d) == slow_checksum(d)


def test_packets_of_any_length_come_back():
    r = random.Random(2)
    for per_page in (1, 3, 255):
        packets = [[r.randbytes(n) for n in (10, 0, 254, 255, 256, 510, 1, 70000 if per_page == 255 else 900, 0)] for _ in range(3)]
        streams = []
        for k, own in enumerate(packets):
            ends, at = [], 0
            for i, p in enumerate(own):
                at += len(p) if i else 0
                ends.append(at)
            streams.append(ogg.paginate(100 + k, own, ends, per_page))
        found = ogg.demultiplex(ogg.multiplex(streams))
        assert sorted(found) == [100, 101, 102]
        for k, own in enumerate(packets):
            s = found[100 + k]
            assert [p.data for p in s.packets] == own and s.ended and not s.lost
            at = 0
            for p, (a, b) in zip(own[1:], s.times(), strict=True):
                assert (a, b) == (at, at + len(p))
                at += len(p)


def test_damaged_and_missing_pages():
    payload = random.Random(3).randbytes(300_000)
    data = op3.store(payload)
    assert op3.load(b"junk" + data)[0] == payload
    at = [i for i in range(len(data)) if data.startswith(b"OggS", i)]
    broken = bytearray(data)
    broken[at[4] + 200] ^= 1
    back, streams, _ = op3.load(bytes(broken))
    assert sum(s.lost for s in streams.values()) == 1 and 0 < len(back) < len(payload)
    gone = data[: at[4]] + data[at[5] :]
    back, streams, _ = op3.load(gone)
    assert sum(s.lost for s in streams.values()) == 1 and 0 < len(back) < len(payload)
    assert op3.load(data[: at[3] + 9])[0] == b"" or len(op3.load(data[: at[3] + 9])[0]) < len(payload)


def test_query(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "é" * 32), (4, "x" * 65), (5, "wörd " * 30000), (5, "wörd " * 30000), (None, "a\0b")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as feature", "1 as media").write.parquet(str(tmp_path / "documents.parquet"))
    out = op3.op3_ogg(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    for x in out:
        text = dict(rows)[x.doc_id] or ""
        raw = text.encode()
        pad = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert x.media_sha256 == hashlib.sha256(op3.store(pad)).hexdigest() and x.media_bytes == len(op3.store(pad)) and x.lost_pages == 0
    assert len({x.feature for x in out if x.doc_id == 5}) == 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    files = op3.ogg_files(docs, "doc_id", "text")
    assert op3.ogg_packets(files, "doc_id", "media").where("doc_id = 5").count() > 4
    bad = spark.createDataFrame([(1, None), (2, b""), (3, b"RIFF1234")], "k long, media binary")
    assert op3.ogg_packets(bad, "k", "media").count() == 0
    assert op3.ogg_columns(docs.where("false")).count() == 0
