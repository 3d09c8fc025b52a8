"""Suffix-array dedup of repetitive text, by prefix-free parsing.

Segments of byte windows that recur are found over the whole corpus (segments.recurring). Those whose content is the
same everywhere are settled by their first place. The first copies of segments that share a name but differ somewhere
(the rims of passages and of edits: highly repetitive text) go into bounded buckets; prefix-free parsing puts a
bucket's windows into suffix order, where equal windows are neighbours, and all but the earliest are removed. Segments
none of whose windows has an equal hash in the bucket share nothing but their name and are left out of that order. Segments
of a name with very many of them (a common line) are cut into those of longer names first; where such a name still has
very many, it is dealt over several buckets, whose survivors meet in an aggregation.

A name is a gram of 32 bytes. Any length gives the same result, but short grams recur in passages that have nothing else in
common, the more the larger the corpus is: with 16 bytes, the contested text grew as the corpus to the power 1.17.

Defined results: null, empty and short texts keep all bytes; rows that repeat a doc_id and text are judged as that
one document and each returned; rows of one doc_id and different texts are documents of their own, in the order of
their hashes; rows without doc_id are returned unchanged; other columns of the input are ignored;
kept bytes are binary, as a cut may fall inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, trim, written
from .pfp import equal_runs, suffix_order
from .segments import Found, Grain, Shard, as_bytes, byte_units, ramp, recurring, segments, window_hashes

#: Segments of one name in a bucket, bytes in a bucket (on average).
SPREAD, BUCKET = 2048, 1 << 20
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, node binary"


def _texts(window: int):
    """The bytes of the contested segments; those of a name with over SPREAD of them are cut by names of four fifths of a window."""

    def run(key, docs: pd.DataFrame, rims: pd.DataFrame) -> pd.DataFrame:
        docs = docs[docs["doc_id"].isin(rims["doc_id"])].drop_duplicates("doc_id")
        text = {d: as_bytes(t) for d, t in zip(docs["doc_id"], docs["text"], strict=True)}
        rims = rims[rims["doc_id"].isin(text.keys())]
        many = rims["kinds"].to_numpy() > SPREAD
        if many.any():
            some = rims[many]
            s = segments([byte_units(text[d][a : a + nw + window - 1]) for d, a, nw in zip(some["doc_id"], some["a"], some["nw"], strict=True)], window, window * 4 // 5)
            some = some.iloc[s["doc"]]
            rims = pd.concat([rims[~many], some.assign(h1=s["h1"], h2=s["h2"], a=some["a"] + s["a"], nw=s["nw"])])
        trim()
        return rims.assign(text=[text[d][a : a + nw + window - 1] for d, a, nw in zip(rims["doc_id"], rims["a"], rims["nw"], strict=True)])[["h1", "h2", "kinds", "doc_id", "a", "nw", "text"]]

    return run


def _alike(texts: list[bytes], window: int) -> np.ndarray:
    """For each text of window bytes or more, whether the hash of one of its windows occurs twice among them all: equal windows have equal hashes."""
    hashes = [window_hashes(byte_units(x), window) for x in texts]
    n = np.array([len(x) for x in hashes], np.int64)
    w = np.concatenate(hashes)
    order = np.argsort(w)
    same = np.flatnonzero(w[order[1:]] == w[order[:-1]])
    twice = np.zeros(len(w), bool)
    twice[order[same]] = twice[order[same + 1]] = True
    return np.logical_or.reduceat(twice, np.cumsum(n) - n)


def _settle(window: int):
    """Of a bucket: runs of windows with an earlier equal in it (late), and the earliest of each class of a spread name."""

    def run(rims: pd.DataFrame) -> pd.DataFrame:
        rims = rims[_alike(list(rims["text"]), window) | (rims["kinds"].to_numpy() > SPREAD)]
        if not len(rims):
            trim()
            return pd.DataFrame()
        rims = rims.sort_values(["doc_id", "a"], kind="stable").reset_index(drop=True)
        texts, nw = list(rims["text"]), rims["nw"].to_numpy(np.int64)
        begin = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts])))[:-1]
        t, order = suffix_order(texts, np.repeat(begin, nw) + ramp(nw))
        kind = equal_runs(t, order, window)
        place = np.lexsort((order, kind))  # texts are in corpus order
        order, kind = order[place], kind[place]
        late = np.zeros(len(order), bool)
        late[1:] = kind[1:] == kind[:-1]
        k = np.searchsorted(begin, order, side="right") - 1
        spread = np.flatnonzero(~late & (rims["kinds"].to_numpy()[k] > SPREAD))
        w = window_hashes(byte_units(t.tobytes()), window)[order[spread]] if len(spread) else np.zeros(0, np.int64)
        at = np.sort(order[late])  # runs end with their text, as the last window - 1 places of a text start no window
        edge = np.ones(len(at) + 1, bool)
        edge[1:-1] = at[1:] != at[:-1] + 1
        edge = np.flatnonzero(edge)
        order = np.concatenate((at[edge[:-1]], order[spread]))
        k = np.searchsorted(begin, order, side="right") - 1
        n, m = len(edge) - 1, len(spread)
        trim()
        return pd.DataFrame({
            "late": np.arange(n + m) < n, "h1": rims["h1"].to_numpy()[k], "w": np.concatenate((np.zeros(n, np.int64), w)), "doc_id": rims["doc_id"].to_numpy()[k],
            "s": rims["a"].to_numpy()[k] + order - begin[k], "nw": np.concatenate((np.diff(edge), np.ones(m, np.int64))),
        })

    return run


def _remove(window: int, gram: int):
    def run(key, docs: pd.DataFrame, finds: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(docs, "byte")
        rim = shard.rows(finds[finds["kind"] == 1])
        row, start, end = rim["row"].to_numpy(np.int64), rim["a"].to_numpy(np.int64), rim["a"].to_numpy(np.int64) + rim["nw"].to_numpy(np.int64) + window - 1
        known = finds[finds["kind"] == 0]
        if len(known):
            s = pd.DataFrame(segments(shard.units, window, gram)).merge(known[["h1", "h2", "first_doc", "first_a"]], on=["h1", "h2"])
            doc = shard.owner[s["doc"]]
            s = s[(doc > s["first_doc"]) | ((doc == s["first_doc"]) & (s["a"] > s["first_a"]))]
            row, start, end = np.concatenate((row, s["doc"])), np.concatenate((start, s["a"])), np.concatenate((end, s["a"] + s["nw"] + window - 1))
        cut = shard.covered(row, start, end)
        begins = cut.copy()
        begins[1:] &= ~cut[:-1]
        edge = shard.base[:-1][shard.lens > 0]
        begins[edge] = cut[edge]
        gone = shard.sums(cut)
        kept = [np.frombuffer(t, np.uint8)[~cut[shard.base[d] : shard.base[d + 1]]].tobytes() if gone[d] else t for d, t in enumerate(shard.texts)]
        trim()
        return pd.DataFrame({"doc_id": shard.owner, "n_bytes": shard.lens, "n_removed": gone, "n_spans": shard.sums(begins), "kept": kept, "node": [md5(t).digest() for t in shard.texts]})

    return run


def suffix_dedup(documents: DataFrame, window: int = 100, gram: int = 32, shard_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept, node (text_hash of the whole text): each text without the bytes of windows that also start earlier in the corpus."""
    found: Found = recurring(documents, Grain("byte", window, gram, shard_bytes))
    docs = found.docs
    rims = written(docs.groupBy("shard").cogroup(found.contested.groupBy("shard")).applyInPandas(_texts(window), "h1 long, h2 long, kinds long, doc_id long, a long, nw int, text binary"), "rims")
    size = rims.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    # Longer names with many segments: a row for over SPREAD of them, so they are sent to all.
    cut = F.col("kinds") > SPREAD
    still = rims.where(cut).groupBy("h1").agg(F.count("*").alias("still")).where(F.col("still") > SPREAD)
    rims = rims.join(F.broadcast(still), "h1", "left").withColumn("kinds", F.when(cut, F.coalesce("still", F.lit(1))).otherwise(F.col("kinds"))).drop("still")
    # A name with few segments stays whole in a bucket; one with many is dealt by content.
    part = F.when(F.col("kinds") > SPREAD, F.pmod(F.col("h2"), F.ceil(F.col("kinds") / (SPREAD // 2)))).otherwise(0)
    bucket = F.pmod(F.xxhash64("h1", part), F.lit(size // BUCKET + 1))
    settled = written(rims.groupBy(bucket.alias("bucket")).applyInPandas(_settle(window), "late boolean, h1 long, w long, doc_id long, s long, nw long"), "settled")
    spread = settled.where("not late")
    first = spread.groupBy("h1", "w").agg(F.min(F.struct("doc_id", "s")).alias("f"), F.count("*").alias("n")).where("n > 1").select("h1", "w", "f")
    late = settled.where("late").select("doc_id", "s", "nw").unionByName(spread.join(first, ["h1", "w"]).where(F.struct("doc_id", "s") > F.col("f")).select("doc_id", "s", "nw"))
    none = F.lit(0).cast("long")
    late = late.select(found.shard(F.col("doc_id")).alias("shard"), F.lit(1).alias("kind"), none.alias("h1"), none.alias("h2"), "doc_id", F.col("s").alias("a"), "nw", none.alias("first_doc"), none.alias("first_a"))
    finds = found.passages.select("shard", F.lit(0).alias("kind"), "h1", "h2", "doc_id", "a", F.col("nw").cast("long").alias("nw"), "first_doc", "first_a").unionByName(late)
    out = docs.groupBy("shard").cogroup(finds.groupBy("shard")).applyInPandas(_remove(window, gram), RESULT)
    return found.named(out).unionByName(documents.where("doc_id is null").select("text").mapInPandas(_bare, RESULT))


def _bare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = [as_bytes(t) for t in b["text"]]
        yield pd.DataFrame({"doc_id": pd.Series([None] * len(texts), dtype="Int64"), "n_bytes": [len(t) for t in texts], "n_removed": 0, "n_spans": 0, "kept": texts, "node": [md5(t).digest() for t in texts]})


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
