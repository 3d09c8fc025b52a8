"""Substring dedup with repeated-phrase automata.

Recurring passages of words are confirmed over the whole corpus (segments.recurring); each shard of the corpus then
compiles the passages that were confirmed for it into Aho-Corasick automata of bounded size and streams all its
documents through them, which locates every occurrence word by word. Windows at the rim of a passage, where its
surroundings differ, are compared by window.

Defined results: null, empty and short texts keep all words; a text under the window's length has no window;
ties cannot occur, as (doc_id, start) orders all windows; rows that repeat a doc_id and text are judged as that one
document and each returned; rows of one doc_id and different texts are documents of their own, in the order of their
hashes; rows without doc_id are returned unchanged; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, trim, written
from .segments import Found, Grain, Shard, U, as_bytes, prefix, ramp, recurring, run_hash, window_hashes

#: Passages in one automaton: bounds its memory to some tens of MB.
AUTOMATON = 10_000
#: A word is written as so many symbols of 6 bits of its hash, the first from an alphabet of its own; matches are then verified by whole hashes.
SYMBOLS = 4


def spelled(units: np.ndarray) -> str:
    """Words as symbols. Small alphabets keep the automaton's nodes narrow."""
    out = np.empty((len(units), SYMBOLS), np.uint8)
    for k in range(SYMBOLS):
        out[:, k] = ((units >> U(6 * k)) & U(63)).astype(np.uint8) + (0x40 if k == 0 else 0x80)
    return out.tobytes().decode("latin-1")


def occurrences(units: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and passage of every occurrence of distinct passages; both are given as word hashes."""
    gap = np.zeros(1, U)
    stream = "\1\1\1\1".join(spelled(u) for u in units)
    flat = np.concatenate([x for u in units for x in (u, gap)])
    begin = np.concatenate(([0], np.cumsum([len(u) + 1 for u in units])))
    hashes = prefix(flat)
    lens = np.array([len(p) for p in passages])
    whole = prefix(np.concatenate(passages))
    ends = np.cumsum(lens)
    own = run_hash(whole, ends - lens, ends)
    at, which = [], []
    for first in range(0, len(passages), AUTOMATON):
        a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        same: dict[int, list[int]] = {}
        for k in range(first, min(len(passages), first + AUTOMATON)):
            if not a.add_word(word := spelled(passages[k]), k):  # spelled as another: both are verified
                same.setdefault(a.get(word), []).append(k)
        a.make_automaton()
        got = np.fromiter(chain.from_iterable(a.iter(stream)), np.int64).reshape(-1, 2)
        at.append(got[:, 0])
        which.append(got[:, 1])
        for k, more in same.items():
            for other in more:
                at.append(got[got[:, 1] == k, 0])
                which.append(np.full(len(at[-1]), other))
    which = np.concatenate(which)
    start = (np.concatenate(at) + 1) // SYMBOLS - lens[which]
    true = run_hash(hashes, start, start + lens[which]) == own[which]
    start, which = start[true], which[true]
    row = np.searchsorted(begin, start, side="right") - 1
    return row, start - begin[row], which


def _rims(window: int):
    """Hashes of the contested windows."""

    def run(key, docs: pd.DataFrame, rims: pd.DataFrame) -> pd.DataFrame:
        docs = docs[docs["doc_id"].isin(rims["doc_id"])].drop_duplicates("doc_id")
        shard = Shard(docs, "word")
        r = shard.rows(rims)
        h = [window_hashes(u, window) for u in shard.units]
        begin = np.concatenate(([0], np.cumsum([len(x) for x in h]))).astype(np.int64)
        nw, a, row = r["nw"].to_numpy(np.int64), r["a"].to_numpy(np.int64), r["row"].to_numpy(np.int64)
        s = np.repeat(a, nw) + ramp(nw)
        flat = np.concatenate(h) if h else np.zeros(0, np.int64)
        trim()
        return pd.DataFrame({"h1": np.repeat(r["h1"].to_numpy(np.int64), nw), "w": flat[np.repeat(begin[row], nw) + s], "doc_id": np.repeat(r["doc_id"].to_numpy(np.int64), nw), "s": s})

    return run


def _remove(window: int):
    def run(key, docs: pd.DataFrame, finds: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(docs, "word")
        finds = shard.rows(finds)
        known, rim = finds[finds["kind"] == 0].drop_duplicates(["h1", "h2"]), finds[finds["kind"] == 1]
        row, start, end = rim["row"].to_numpy(np.int64), rim["a"].to_numpy(np.int64), rim["a"].to_numpy(np.int64) + window
        if len(known):
            passages = [shard.units[r][a : a + n + window - 1] for r, a, n in zip(known["row"], known["a"], known["nw"], strict=True)]
            r, a, k = occurrences(shard.units, passages)
            doc, fd, fa = shard.owner[r], known["first_doc"].to_numpy(np.int64)[k], known["first_a"].to_numpy(np.int64)[k]
            late = (doc > fd) | ((doc == fd) & (a > fa))
            r, a, k = r[late], a[late], k[late]
            row, start, end = np.concatenate((row, r)), np.concatenate((start, a)), np.concatenate((end, a + np.array([len(p) for p in passages])[k]))
        cut = shard.covered(row, start, end)
        gone = shard.sums(cut)
        kept = []
        for d, t in enumerate(shard.texts):
            words = t.split()
            kept.append(b" ".join(compress(words, (~cut[shard.base[d] : shard.base[d + 1]]).tolist()) if gone[d] else words).decode())
        trim()
        return pd.DataFrame({"doc_id": shard.owner, "n_words": shard.lens, "n_removed": gone, "kept_text": kept})

    return run


def substring_dedup(documents: DataFrame, window: int = 20, gram: int = 8, shard_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: each text without the words of windows that also start earlier in the corpus."""
    found: Found = recurring(documents, Grain("word", window, gram, shard_bytes))
    docs = found.docs
    rims = written(docs.groupBy("shard").cogroup(found.contested.groupBy("shard")).applyInPandas(_rims(window), "h1 long, w long, doc_id long, s long"), "rims")
    first = rims.groupBy("h1", "w").agg(F.min(F.struct("doc_id", "s")).alias("f"), F.count("*").alias("n")).where("n > 1").select("h1", "w", "f")
    none = F.lit(0).cast("long")
    late = rims.join(first, ["h1", "w"]).where(F.struct("doc_id", "s") > F.col("f")).select(found.shard(F.col("doc_id")).alias("shard"), F.lit(1).alias("kind"), none.alias("h1"), none.alias("h2"), "doc_id", F.col("s").alias("a"), F.lit(0).alias("nw"), none.alias("first_doc"), none.alias("first_a"))
    finds = found.passages.select("shard", F.lit(0).alias("kind"), "h1", "h2", "doc_id", "a", "nw", "first_doc", "first_a").unionByName(late)
    out = docs.groupBy("shard").cogroup(finds.groupBy("shard")).applyInPandas(_remove(window), "doc_id long, n_words long, n_removed long, kept_text string")
    bare = documents.where("doc_id is null").select("text").mapInPandas(_bare, "doc_id long, n_words long, n_removed long, kept_text string")
    return found.named(out).unionByName(bare)


def _bare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        words = [as_bytes(t).split() for t in b["text"]]
        yield pd.DataFrame({"doc_id": pd.Series([None] * len(words), dtype="Int64"), "n_words": [len(w) for w in words], "n_removed": 0, "kept_text": [b" ".join(w).decode() for w in words]})


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
