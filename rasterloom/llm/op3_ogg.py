"""Media columns: Ogg files in a binary column.

store() writes payloads as 8-bit samples, dealt over two logical streams that are multiplexed into one file; load()
verifies the pages, reassembles the packets, demultiplexes the streams and puts the samples in order again by the
times that follow from the granule positions. ogg_packets() does that for any binary column.

Defined results: a null text counts as empty; an empty payload is 64 zero bytes; equal texts have equal files (serial
numbers come from the payload); damaged pages are counted and what they hold is left out; a null or foreign value has
no packets; repeated rows are treated each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ogg
from .common import read_table

#: Samples a second, bytes of a packet, logical streams of a file.
RATE, PACKET, STREAMS = 8000, 4000, 2
MAGIC = b"\x01samples8"
HEAD = struct.Struct("<9sIBBQ")


def payload_of(text: str | None) -> tuple[bytes, bytes]:
    """The text's bytes, and those with zeros up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw, raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def store(payload: bytes, rate: int = RATE, packet: int = PACKET, streams: int = STREAMS) -> bytes:
    serial = zlib.crc32(payload)
    parts = [payload[k : k + packet] for k in range(0, len(payload), packet)]
    logical = []
    for k in range(streams):
        own = parts[k::streams]
        ends = np.cumsum([len(p) for p in own]).tolist()
        head = HEAD.pack(MAGIC, rate, k, streams, len(payload))
        logical.append(ogg.paginate((serial + k) & 0xFFFFFFFF, [head, *own], [0, *ends]))
    return ogg.multiplex(logical)


def load(data: bytes) -> tuple[bytes, dict[int, ogg.Stream], float]:
    """The payload, the logical streams, and seconds by granule positions."""
    streams = ogg.demultiplex(data)
    placed, longest, rate = [], 0, RATE
    for s in streams.values():
        if not s.packets or not s.packets[0].data.startswith(MAGIC) or len(s.packets[0].data) != HEAD.size:
            continue
        _, rate, k, _, _ = HEAD.unpack(s.packets[0].data)
        times = s.times()
        longest = max([longest, *(end for _, end in times if end is not None)])
        placed += [(begin, k, p.data) for p, (begin, _) in zip(s.packets[1:], times, strict=True) if begin is not None]
    placed.sort(key=lambda x: x[:2])
    return b"".join(p for _, _, p in placed), streams, longest / rate


def features(payload: bytes, streams: dict[int, ogg.Stream], seconds: float) -> str:
    x = np.frombuffer(payload, np.uint8)
    level = np.sqrt(np.mean((x.astype(np.float32) - 128) ** 2, dtype=np.float64)) if len(x) else 0.0
    turns = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={sum(len(s.packets) for s in streams.values())};seconds={seconds:.4f};peak={int(x.max(initial=0))};rms={level:.4f};crossings={turns}"


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("seconds", pa.float64()), ("lost_pages", pa.int64())])
DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, lost_pages long"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw, payload = payload_of(text.as_py())
            media = store(payload)
            back, streams, seconds = load(media)
            rows.append((doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(back, streams, seconds), seconds, sum(s.lost for s in streams.values())))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [()] * len(RESULT), RESULT, strict=True)], schema=RESULT)


def ogg_columns(documents: DataFrame) -> DataFrame:
    """What op3 returns, and seconds and lost_pages, for each row of doc_id and text."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measure, DDL)


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        files = [store(payload_of(t.as_py())[1]) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(files, pa.binary())], names=[b.schema.names[0], "media"])


def ogg_files(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, media: an Ogg file for each row."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(_files, f"`{key}` {kind}, media binary")


PACKETS = [("serial", pa.int64()), ("packet", pa.int32()), ("page", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("data", pa.binary()), ("lost_pages", pa.int64())]


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, media in enumerate(b.column(1)):  # a batch a file: what a batch holds is bounded by a file
            rows = []
            for s in ogg.demultiplex(media.as_py() or b"").values():
                times = [(None, None), *s.times()][: len(s.packets)]
                rows += [(s.serial, k, p.page, *t, p.data, s.lost) for k, (p, t) in enumerate(zip(s.packets, times, strict=True))]
            if rows:
                key = pa.array([b.column(0)[i].as_py()] * len(rows), b.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([key, *(pa.array(x, t) for x, (_, t) in zip(zip(*rows), PACKETS, strict=True))], names=[b.schema.names[0], *(n for n, _ in PACKETS)])


def ogg_packets(df: DataFrame, key: str, media: str) -> DataFrame:
    """key, serial, packet, page, first, last (positions, null for headers), data, lost_pages: the packets of each file's logical streams."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, media).mapInArrow(_packets, f"`{key}` {kind}, serial long, packet int, page long, first long, last long, data binary, lost_pages long")


def op3_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_columns(read_table(spark, sf_dir, "documents"))
