"""Exact search for repeated windows of W units (words or bytes) over a whole corpus, with a few rows for each passage.

Every window is named by the smallest hash among its grams of K units, so equal windows have equal names wherever
they stand. A segment is a maximal run of windows of one document that have one name. Segments, not windows, are
shuffled: 1 row for about (W - K) / 2 windows, combined for each batch and shard before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import freed, id_bounds, id_range, numbered, small_batches, text_hash, written

U = np.uint64
MULT = 0x9E3779B97F4A7C15
_INV = pow(MULT, -1, 1 << 64)
_tables = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) | U(1)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
#: Longest run of windows in a segment, units in a chunk of a document, bytes hashed at once.
RUN, CHUNK, SLICE = 512, 1 << 15, 1 << 20
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, m in enumerate((MULT, _INV)):
            a = np.full(max(n, 1 << 16), U(m))
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=U)
    return _powers[0], _powers[1]


def mix(x: np.ndarray, c: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    x = x ^ (x >> U(32))
    x *= U(c)
    x ^= x >> U(29)
    return x


def prefix(u: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of every run of units follows."""
    c = np.zeros(len(u) + 1, U)
    np.cumsum(u * powers(len(u))[0][: len(u)], out=c[1:])
    return c


def run_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (c[end] - c[start]) * powers(len(c))[1][start]


def slide(x: np.ndarray, n: int, f: np.ufunc) -> np.ndarray:
    """f over every n neighbours, in log n steps."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = f(x[:-step], x[step:])
        have += step
    return x


def byte_units(data: bytes) -> np.ndarray:
    return _tables[np.frombuffer(data, np.uint8)]


def word_units(data: bytes) -> np.ndarray:
    """A 64-bit hash for each word, from slices cut at white space."""
    found, at = [], 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            while end < len(data) and data[end] not in b" \t\n\v\f\r":
                end += 1
        part = np.frombuffer(data, np.uint8, min(end, len(data)) - at, at)
        gap = np.concatenate(([True], _IS_SPACE[part], [True]))
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        c = prefix(_tables[part])
        found.append(mix(run_hash(c, edge[::2], edge[1::2]) + (edge[1::2] - edge[::2]).astype(U)))
        at = end
    return np.concatenate(found) if found else np.zeros(0, U)


UNITS: dict[str, Callable[[bytes], np.ndarray]] = {"word": word_units, "byte": byte_units}


@dataclass(frozen=True)
class Grain:
    """Windows of `window` units, named by grams of `gram` units."""

    unit: str
    window: int
    gram: int
    shard_bytes: int = 8 << 20


def chunks(units: list[np.ndarray], w: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of neighbouring documents, long ones cut with w - 1 units of overlap: units, ends, document, first unit's place."""
    batch: list[tuple[np.ndarray, int, int]] = []
    total = 0

    def joined():
        lens = np.array([len(x[0]) for x in batch])
        return np.concatenate([x[0] for x in batch]), np.cumsum(lens), np.array([x[1] for x in batch]), np.array([x[2] for x in batch])

    for d, u in enumerate(units):
        for at in range(0, max(0, len(u) - w + 1), CHUNK):
            part = u[at : at + CHUNK + w - 1]
            batch.append((part, d, at))
            total += len(part)
            if total >= CHUNK:
                yield joined()
                batch, total = [], 0
    if batch:
        yield joined()


def segments(units: list[np.ndarray], w: int, k: int) -> dict[str, np.ndarray]:
    """The segments of some documents: name h1, content hash h2, document, first window a, windows nw, own (2 if a window may repeat inside)."""
    out: dict[str, list[np.ndarray]] = {x: [] for x in ("h1", "h2", "doc", "a", "nw", "own")}
    g_n = w - k + 1
    for u, ends, docs, base in chunks(units, w):
        n = len(u)
        c = prefix(u)
        inv = powers(n + 1)[1]
        g = mix((c[k:] - c[:-k]) * inv[: n - k + 1])
        m = slide(g, g_n, np.minimum)
        last = np.repeat(ends, np.diff(ends, prepend=0))[: n - w + 1]
        valid = np.arange(w, n + 1) <= last
        first = np.empty(len(m), bool)
        first[0] = True
        first[1:] = (m[1:] != m[:-1]) | ~valid[:-1]
        first &= valid
        cut = valid & ~first
        starts = np.flatnonzero(first)
        stops = np.append(starts[1:], len(m))
        over = np.flatnonzero(stops - starts > RUN)
        if len(over):
            extra = np.concatenate([np.arange(starts[i], stops[i], RUN)[1:] for i in over])
            starts = np.sort(np.concatenate([starts, extra[cut[extra]]]))
        stops = np.append(starts[1:], len(m))
        seen = np.concatenate(([0], np.cumsum(valid)))
        nw = (seen[stops] - seen[starts]).astype(np.int64)
        # Grams that are the smallest of some window. Of equal ones no further apart than g_n, the window after the first may be a repeat
        # inside its segment: at g_n no window holds both, but all windows between have the one name.
        pad = np.zeros(g_n - 1, U)
        least = np.flatnonzero(slide(np.concatenate([pad, np.where(valid, m, U(0)), pad]), g_n, np.maximum) == g)
        twin = (g[least[1:]] == g[least[:-1]]) & (least[1:] - least[:-1] <= g_n)
        own = np.ones(len(starts), np.int64)
        if twin.any():
            mark = np.zeros(len(m) + 1, np.int64)
            np.add.at(mark, np.clip(least[1:][twin] - g_n + 1, 0, len(m)), 1)
            np.add.at(mark, np.clip(least[:-1][twin] + 2, 0, len(m)), -1)
            own += np.maximum.reduceat(np.cumsum(mark[:-1]) > 0, starts).astype(np.int64)
        part = np.searchsorted(ends, starts, side="right")
        begin = np.concatenate(([0], ends[:-1]))[part]
        for name, x in (("h1", m[starts].view(np.int64)), ("h2", mix(run_hash(c, starts, starts + nw + w - 1) ^ nw.astype(U), 0xA0761D6478BD642F | 1).view(np.int64)), ("doc", docs[part]), ("a", starts - begin + base[part]), ("nw", nw), ("own", own)):
            out[name].append(x)
    return {x: np.concatenate(v) if v else np.zeros(0, np.int64) for x, v in out.items()}


def window_hashes(u: np.ndarray, w: int) -> np.ndarray:
    c = prefix(u)
    n = max(0, len(u) - w + 1)
    return mix((c[w : w + n] - c[:n]) * powers(n + 1)[1][:n], 0xE7037ED1A0B428DB).view(np.int64)


def as_bytes(text) -> bytes:
    return b"" if text is None or text != text else text.encode()


SEGMENT = "h1 long, h2 long, shard int, doc_id long, a long, nw int, n long, own int"


def _scan(grain: Grain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, shard, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2)
            rows = sorted(range(len(ids)), key=ids.__getitem__)
            at, size = 0, 0
            for end, r in enumerate(rows, 1):  # at most some MB of text at a time
                size += len(texts[r].as_buffer() or b"") if texts[r].is_valid else 0
                if size < 4 << 20 and end < len(rows):
                    continue
                some, at, size = rows[at:end], end, 0
                s = segments([UNITS[grain.unit](as_bytes(texts[i].as_py())) for i in some], grain.window, grain.gram)
                if not len(s["h1"]):
                    continue
                some = np.array(some)
                d = pd.DataFrame({"h1": s["h1"], "h2": s["h2"], "shard": shard[some][s["doc"]].astype(np.int32), "doc_id": ids[some][s["doc"]], "a": s["a"], "nw": s["nw"].astype(np.int32), "n": 1, "own": s["own"].astype(np.int32)})
                twice = d.duplicated(["h1", "h2", "shard"], keep=False).to_numpy()
                if twice.any():  # rows are in corpus order, so the first of each is the earliest
                    e = d[twice].groupby(["h1", "h2", "shard"], sort=False, as_index=False).agg({"doc_id": "first", "a": "first", "nw": "first", "n": "sum", "own": "max"})
                    d = pd.concat([d[~twice], e])
                yield pa.RecordBatch.from_pandas(d, schema=_ARROW, preserve_index=False)

    return run


_ARROW = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("shard", pa.int32()), ("doc_id", pa.int64()), ("a", pa.int64()), ("nw", pa.int32()), ("n", pa.int64()), ("own", pa.int32())])


@dataclass
class Found:
    """docs: doc_id, shard, text. passages: for each shard, the segments to look for there. contested: first places of differing segments of one name.

    Where a doc_id of the input stands on several texts, doc_id here is the row number of each text in `ids` (common.numbered).
    """

    docs: DataFrame
    passages: DataFrame
    contested: DataFrame
    shard: Callable
    shards: int
    ids: DataFrame | None

    def named(self, out: DataFrame) -> DataFrame:
        """out with the input's own doc_id."""
        if self.ids is None:
            return out
        own = self.ids.select(F.col("row").alias("row_"), F.col("doc_id").alias("own_"))
        return out.join(own, out.doc_id == F.col("row_")).select(F.col("own_").alias("doc_id"), *[c for c in out.columns if c != "doc_id"])


def recurring(documents: DataFrame, grain: Grain) -> Found:
    """Segments that occur again, and those of which some windows may.

    The corpus is cut into shards, ranges of doc_id of about grain.shard_bytes. The only shuffle that grows with the
    corpus carries a row for each segment, combined by batch and shard; a name on many documents so has a row for each
    shard at most, whatever its frequency.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    small_batches(documents.sparkSession)
    ids = numbered(docs)
    if ids is not None:
        docs = docs.withColumn("node", text_hash()).join(ids, ["doc_id", "node"]).select(F.col("row").alias("doc_id"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    bounds = id_bounds(docs, min(1 << 20, size // grain.shard_bytes + 1))
    shard = lambda c: id_range(c, bounds).cast("int")
    docs = docs.select("doc_id", shard(F.col("doc_id")).alias("shard"), "text")
    found = docs.mapInArrow(freed(_scan(grain)), SEGMENT)
    often = written(found.withColumn("times", F.sum(F.col("n") + F.col("own") - 1).over(Window.partitionBy("h1"))).where("times > 1").drop("times"), "segments")
    kinds = often.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "a")).alias("f"), F.sum("n").alias("n"), F.max("nw").alias("nw"), F.max("own").alias("own"))
    kinds = written(kinds, "kinds")
    here = often.groupBy("shard", "h1", "h2").agg(F.min(F.struct("doc_id", "a")).alias("e"))
    passages = here.join(kinds.where("n > 1"), ["h1", "h2"]).select("shard", "h1", "h2", F.col("e.doc_id").alias("doc_id"), F.col("e.a").alias("a"), "nw", F.col("f.doc_id").alias("first_doc"), F.col("f.a").alias("first_a"))
    shared = kinds.groupBy("h1").agg(F.count("*").alias("kinds"))
    contested = kinds.join(shared, "h1").where("kinds > 1 or own > 1").select(shard(F.col("f.doc_id")).alias("shard"), "h1", "h2", F.col("f.doc_id").alias("doc_id"), F.col("f.a").alias("a"), "nw", "kinds")
    return Found(docs, passages, contested, shard, max(1, len(bounds) + 1), ids)


class Shard:
    """The documents of a shard, laid end to end."""

    def __init__(self, docs: pd.DataFrame, unit: str):
        self.owner = docs["doc_id"].to_numpy(np.int64)
        self.texts = [as_bytes(t) for t in docs["text"]]
        self.units = [UNITS[unit](t) for t in self.texts]
        self.lens = np.array([len(u) for u in self.units], np.int64)
        self.base = np.concatenate(([0], np.cumsum(self.lens))).astype(np.int64)

    def rows(self, finds: pd.DataFrame) -> pd.DataFrame:
        """finds with the row of its document in the shard (each row, where a document is repeated)."""
        return finds.astype({"doc_id": "int64"}).merge(pd.DataFrame({"doc_id": self.owner, "row": np.arange(len(self.owner))}), on="doc_id")

    def covered(self, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For every unit of the shard, whether a span covers it."""
        d = np.zeros(self.base[-1] + 1, np.int32)
        at, stop = self.base[row], self.base[row + 1]
        np.add.at(d, np.minimum(at + start, stop), 1)
        np.add.at(d, np.minimum(at + end, stop), -1)
        return np.cumsum(d[:-1], dtype=np.int32) > 0

    def sums(self, x: np.ndarray) -> np.ndarray:
        """The sum over each document's units."""
        c = np.zeros(len(x) + 1, np.int32)
        np.cumsum(x, out=c[1:])
        return (c[self.base[1:]] - c[self.base[:-1]]).astype(np.int64)


def ramp(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, joined."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
