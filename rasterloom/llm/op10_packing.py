"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most the capacity; the packing itself needs only how many pieces there are of each
length, a table of at most `capacity` rows whatever the corpus. For a bin that holds the longest length left, bitset
subset-sum dynamic programming over the lengths left finds the fullest feasible combination; it is applied as often as
the counts allow. Where that needs more bins than the sum of all lengths does, relaxed rules (a little slack is as good
as none, so that larger pieces go first) are tried too, and the rule with the fewest bins wins. Pieces get their places by their rank within their length, from counts by bucket, without a sort of
the corpus.

Defined results: a null or empty text has the end id alone; ties (pieces of one length) are ordered by bucket, doc_id
and piece; repeated rows are packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import freed, read_table, small_batches, written

CAPACITY, END_ID = 1024, 2
#: Rows of a rank bucket.
RANKED = 50_000
#: Characters of text that are encoded in one call.
TOGETHER = 1 << 20
#: Slack that the relaxed rules take for none.
SLACKS = (1, 2, 4, 8, 16, 32)
#: What only the tokenizer itself encodes: characters on which its Unicode tables and this module's may differ, and long runs of white space.
OTHER = re.compile(r"[^\t\n\r -~¡-ɏ]|[\t\n\r ]{1000}")
END_MARK = "<|endoftext|>"
LETTERS, DIGITS = ("".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind) for kind in "LN")
#: The tokenizer's own split into words, for these characters.
SPLIT = rf"'(?:[sdmt]|ll|ve|re)| ?(?:[{LETTERS}]+|[{DIGITS}]+|[^\s{LETTERS}{DIGITS}]+)|\s+(?!\S)|\s+"
_memory: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the others for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(0x100 + k): x for k, x in enumerate(rest)}


def _model(path: str) -> tuple[dict[str, int], list[tuple[str, str]]] | None:
    """Vocabulary and merges of a byte-level BPE whose ids ascend with its merges and whose words are those of SPLIT; else None."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    pre, model = d.get("pre_tokenizer") or {}, d["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not d.get("normalizer") and not d.get("truncation")
    if not plain or model.get("type") != "BPE" or [t["content"] for t in d["added_tokens"]] != [END_MARK] or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [vocab[x] for x in _bytes_of() if x in vocab] + [vocab[x + y] for x, y in merges]
    return (vocab, merges) if len(ids) == len(vocab) == 256 + len(merges) and max(ids[:256]) < ids[256] and ids[256:] == sorted(set(ids[256:])) else None


def _alone(pairs: dict[tuple[str, str], int], pair: tuple[str, str]) -> bool:
    """Whether the merges before that of a pair make just this pair of its bytes."""
    parts = list(pair[0] + pair[1])
    while len(parts) > 1:
        rank, k = min((pairs.get((parts[k], parts[k + 1]), len(pairs)), k) for k in range(len(parts) - 1))
        if rank >= pairs[pair]:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return tuple(parts) == pair


@functools.cache
def by_ranks(path: str) -> bool:
    """Whether joining the neighbours whose whole has the least id gives the tokenizer's ids, for every text.

    The tokenizer joins by its list of merges, where a whole may also have other halves. Take the first join by ids: as no
    lower one is left, the merges before it are done inside of its bytes, and none crossed their ends, which still stand.
    So if the merges before that of a whole make just its listed halves of its bytes, those are the two that are joined.
    This is tried for all merges.
    """
    if not (found := _model(path)):
        return False
    pairs = {p: k for k, p in enumerate(found[1])}
    return all(_alone(pairs, p) for p in pairs)


class Encoder:
    """Texts to the bytes of their ids (little-endian 32 bits); with `ranks` (by_ranks of the path), most texts by their vocabulary's ids alone, three times as fast."""

    def __init__(self, path: str, ranks: bool | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = None
        if by_ranks(path) if ranks is None else ranks:
            import tiktoken

            byte = _bytes_of()
            vocab = {bytes(map(byte.__getitem__, t)): k for t, k in _model(path)[0].items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=vocab, special_tokens={}).encode_ordinary

    def direct(self, text: str) -> bytes:
        return self._encode([text])[0]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def __call__(self, text: str) -> bytes:
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[bytes]:
        other = [k for k, t in enumerate(texts) if not self.fast or OTHER.search(t) or END_MARK in t]
        out = dict(zip(other, self._encode([texts[k] for k in other]), strict=True))
        return [out[k] if k in out else array("I", self.fast(t)).tobytes() for k, t in enumerate(texts)]


def pieces_of(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int]]:
    """Start, length and checksum of the pieces of a document; a long one's first piece takes what the others leave."""
    n = len(ids) // 4
    at, end = 0, (n - 1) % capacity + 1
    while at < n:
        yield at, end - at, zlib.crc32(memoryview(ids)[4 * at : 4 * end])
        at, end = end, end + capacity


def _tokenize(path: str, capacity: int, ranks: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _memory:
            _memory[path] = Encoder(path, ranks)
        encode, last = _memory[path], END_ID.to_bytes(4, "little")
        for b in batches:
            rows, at = [], 0
            ids, texts = b.column(0).to_pylist(), b.column(1)
            while at < len(ids):  # some MB of text at a time
                some, size = [], 0
                while at + len(some) < len(ids) and size < TOGETHER:
                    some.append(texts[at + len(some)].as_py() or "")
                    size += len(some[-1])
                for doc, data in zip(ids[at:], encode.batch(some), strict=False):
                    rows += [(doc, k, *p) for k, p in enumerate(pieces_of(data + last, capacity))]
                at += len(some)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small_batches(documents.sparkSession)
    path = path or default_tokenizer()
    return docs.mapInArrow(freed(_tokenize(path, capacity, by_ranks(path))), "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: list[int], first: int, capacity: int, slack: int = 0) -> dict[int, int]:
    """Of the lengths left, a combination that holds `first` and leaves the least slack, or with large pieces at most `slack`."""
    room = capacity - first
    left = counts.copy()
    left[first] -= 1
    mask, reach, trail = (1 << (room + 1)) - 1, 1, []
    for length in range(min(room, capacity), 0, -1):
        for _ in range(min(left[length], room // length)):
            more = reach | (reach << length) & mask
            if more == reach:
                break
            trail.append((length, reach))
            reach = more
            if reach >> max(0, room - slack) > 0:
                break
        if reach >> max(0, room - slack) > 0:
            break
    best = reach.bit_length() - 1
    found = {first: 1}
    for length, before in reversed(trail):
        if not before >> best & 1:
            found[length] = found.get(length, 0) + 1
            best -= length
    return found


Places = list[tuple[int, int, int, int, int, int]]


def plan(counts: list[int], capacity: int) -> Places:
    """length, first rank, rank after the last, number of each bin, first sequence, offset: where the pieces of a length go."""
    least = -(-sum(k * n for k, n in enumerate(counts)) // capacity)
    best, bins = bins_of(counts, capacity, 0)
    for slack in SLACKS:
        if bins <= least:
            break
        other, n = bins_of(counts, capacity, slack)
        if n < bins:
            best, bins = other, n
    return best


def bins_of(counts: list[int], capacity: int, slack: int) -> tuple[Places, int]:
    """The plan by one rule, and its number of bins."""
    counts, used, seq, out = counts.copy(), [0] * len(counts), 0, []
    for first in range(capacity, 0, -1):
        while counts[first]:
            need = fullest(counts, first, capacity, slack)
            times = min(counts[x] // k for x, k in need.items())
            at = 0
            for length, k in need.items():
                out.append((length, used[length], used[length] + times * k, k, seq, at))
                used[length] += times * k
                counts[length] -= times * k
                at += length * k
            seq += times
    return out, seq


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (a written table with doc_id, piece, length and more) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = [0] * (capacity + 1)
    for r in pieces.groupBy("length").count().collect():  # capacity rows at most
        counts[r["length"]] = r["count"]
    places = plan(counts, capacity)
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(sum(counts) // RANKED + 1)).cast("int")
    pieces = pieces.withColumn("bucket", bucket)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    # The plan has a few rows for each of at most `capacity` lengths: it doesn't grow with the corpus.
    plan_df = spark.createDataFrame(places, "len long, lo long, hi long, each long, seq long, at long")
    done = ranked.join(F.broadcast(plan_df), (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    r = F.col("rank") - F.col("lo")
    return done.withColumn("sequence_id", F.col("seq") + F.floor(r / F.col("each"))).withColumn("offset", F.col("at") + F.col("length") * (r % F.col("each"))).drop("len", "lo", "hi", "each", "seq", "at", "rank", "before", "bucket")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = written(token_pieces(read_table(spark, sf_dir, "documents")), "pieces")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
