"""Near-duplicates by BagMinHash.

Texts are multisets of five-word shingles; two are near-duplicates if their weighted Jaccard similarity is 0.8 or more.
Equal texts are one node from the start. Bands of signature registers put nodes into buckets, and every pair of texts
that share a bucket is settled, by the exact overlap of their multisets:

- Each bucket has a pivot, by consensus: the text whose buckets are the largest, which is the original of a group of
  edited copies, as it holds the most frequent registers. It is a member, or shares a bucket with the best one. All
  members are compared with it. Of two members, both near the pivot, nothing more need be known: they are of one class.
- In a bucket of SMALL members at most, what isn't near the pivot meets all the others.
- In a large one, members are written as differences from the pivot. Two texts of which one isn't near the pivot can
  only be near each other if they share a part of their differences, and how much follows from their sizes: the first
  parts of each (as many as that bound gives, in an order with common parts last) key smaller buckets. There, what isn't near the pivot meets the
  others that may share enough from that part on; a bucket of over MANY members first gets a pivot of its own (all this
  ROUNDS times at most, so that it ends).

So no bucket's pairs are listed, and none is cut off. Before texts are fetched, two signatures must agree in AGREE of
80 registers; of pairs at exactly 0.8, 1 of 86,000 does not.

Defined results: class_id is the least doc_id of the class; a text without words (null, empty) is near nothing but an
equal one's class; one of under five words has them all as its only shingle; repeated rows belong to one class, as do
rows of one text with different ids; rows of one doc_id and different texts are judged by their texts; rows without
doc_id are returned with their class's id, null if all its ids are; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bagminhash import band_keys, difference, overlap, packed, shingles, signatures
from .common import dropped, freed, read_table, small_batches, text_hash, written
from .components import components

#: Bands and their registers: of pairs at 0.8, 1 of 38,000 shares no band.
BANDS, ROWS = 20, 4
#: Near from (least part of the union that is shared), registers that must agree before texts are compared.
SHARED, OF, AGREE = 4, 5, 48
#: Members of a bucket without a pivot of its own: of one of signatures, and of one of shared differences.
SMALL, MANY = 32, 2048
#: Times that buckets get pivots; in the last one, buckets of any size are as those of MANY members.
ROUNDS = 3
#: Members of a bucket whose parts tell which are common, how many of them must have one, and the most that are put last.
SAMPLE, OFTEN, COMMON = 128, 3, 1024
#: Members of a pivot that are joined with what is known of all of them in one place.
DEALT = 256
#: Registers in a long of a packed signature, bytes of text signed at once, parts of differences in a batch.
SLOTS, SIGNED, PARTS = 7, 1 << 20, 1 << 18
#: Stands for a missing doc_id in joins.
NO_ID = -(1 << 63)


def _signed(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys: list = [None] * b.num_rows
            sigs: list = [None] * b.num_rows
            at = 0
            while at < b.num_rows:  # some MB of text at a time
                some, bags, size = [], [], 0
                while at < b.num_rows and size < SIGNED:
                    data = (b.column(2)[at].as_py() or "").encode()
                    bag = shingles(data)
                    if len(bag[0]):
                        some.append(at)
                        bags.append(bag)
                    size += len(data)
                    at += 1
                if bags:
                    s = signatures(bags, bands * rows)
                    for i, k, p in zip(some, band_keys(s, rows), packed(s, SLOTS), strict=True):
                        keys[i], sigs[i] = k, p
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))], names=["doc_id", "node", "keys", "sig"])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether u and v are near and, where asked for, v's size and its difference from u. Rows of one u mostly come together, so its multiset is made once."""
    last, bag = None, None
    kind = pa.schema([("u", pa.binary()), ("v", pa.binary()), ("big", pa.bool_()), ("near", pa.bool_()), ("whole", pa.int64()), ("parts", pa.list_(pa.int64()))])
    for b in batches:
        rows, size = [], 0
        for u, v, big, u_text, v_text in zip(*b.columns, strict=True):
            if (u := u.as_py()) != last:
                last, bag = u, shingles(u_text.as_py().encode())
            other = shingles(v_text.as_py().encode())
            both, all_ = overlap(bag, other)
            row = [u, v.as_py(), big.as_py(), all_ > 0 and OF * both >= SHARED * all_, None, None]
            if row[2]:
                parts = difference(bag, other)
                row[4:] = int(other[1].sum()), parts
                size += len(parts)
            rows.append(row)
            if size > PARTS:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)


def _agreeing(a: str, b: str, longs: int, unused: int) -> Column:
    """In how many registers two packed signatures agree: the zero bytes of their difference."""
    low, high = F.lit(0x007F7F7F7F7F7F7F), F.lit(0x0080808080808080)
    x = [F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))) for k in range(longs)]
    same = [F.bit_count(F.bitwise_not((y.bitwiseAND(low) + low).bitwiseOR(y).bitwiseOR(low)).bitwiseAND(high)) for y in x]
    return reduce(lambda p, q: p + q, same) - unused


def _met(pairs: DataFrame, texts: DataFrame, registers: int) -> DataFrame:
    """Of pairs (u, v, big), those compared: all big ones, and of the others those whose signatures let them be near."""
    longs = -(-registers // SLOTS)
    sig = lambda n: texts.select(F.col("node").alias(n), F.col("sig").alias(f"{n}_sig"))
    text = lambda n: texts.select(F.col("node").alias(n), F.col("text").alias(f"{n}_text"))
    alike = _agreeing("u_sig", "v_sig", longs, longs * SLOTS - registers) * 80 >= AGREE * registers
    able = pairs.join(sig("v"), "v").join(sig("u"), "u").where(F.col("big") | alike).select("u", "v", "big")
    found = able.join(text("v"), "v").join(text("u"), "u").select("u", "v", "big", "u_text", "v_text")
    return found.mapInArrow(freed(_compare), "u binary, v binary, big boolean, near boolean, whole long, parts array<long>")


def _smaller(met: DataFrame) -> DataFrame:
    """Buckets of those that share an early part of their differences from a pivot u, if one of them isn't near u.

    far: may be the one that isn't near u; any: may be the other; parts of the difference, rank of the shared one, size of the text.
    Two near texts differ in a ninth of their summed sizes at most, so each shares all its parts but these with the other,
    and one near u over 4 / 9 of them with one that isn't: the first shared part is among the first of each. Any order of
    the parts would do; common ones (by a sample of the members) come last, the others by their hashes. The members of a
    large group are dealt over many tasks, in shares of some DEALT, and evenly where their parts become rows.
    """
    n, whole, near = F.size("parts").cast("long"), F.col("whole"), F.col("near")
    big = met.where("big")
    of = big.groupBy("u").agg(F.count("*").alias("members"), F.max("whole").alias("widest"), F.min(F.when(~near, n)).alias("far_least")).where("far_least is not null")
    # A row for each pivot of over DEALT members.
    shares = F.broadcast(of.select("u", F.floor(F.col("members") / DEALT).alias("shares")).where("shares > 0"))
    shared_out = lambda d: d.join(shares, "u", "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("shares", F.lit(0).cast("long"))))).drop("shares")
    big = big.join(shares, "u", "left").withColumn("share", F.coalesce(F.pmod(F.xxhash64("v", F.lit(1)), F.col("shares") + 1), F.lit(0).cast("long"))).drop("shares")
    big = big.join(shared_out(of), ["u", "share"])
    some = big.where(F.pmod(F.xxhash64("v"), F.floor(F.col("members") / SAMPLE) + 1) == 0).select("u", F.explode("parts").alias("part"))
    often = some.groupBy("u", "part").agg(F.count("*").alias("times")).where(F.col("times") >= OFTEN)
    often = often.withColumn("nth", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("times"), "part"))).where(F.col("nth") <= COMMON)
    common = often.groupBy("u").agg(F.sort_array(F.collect_list(F.struct(-F.col("nth"), "part"))).alias("common")).select("u", F.col("common.part").alias("common"))
    known = F.coalesce("common", F.array().cast("array<bigint>"))
    # What a near text of at most this size may differ in; parts shared at least.
    differ = (whole + F.least(F.col("widest"), F.floor(whole * 5 / 4))) / 9
    shared = F.greatest(F.lit(1), F.ceil(n - differ))
    far_first = F.when(near, 0).otherwise(n - shared + 1)
    any_first = F.when(n + differ < F.col("far_least"), 0).otherwise(n - F.greatest(shared, F.floor(n * 4 / 9) + 1) + 1)
    first = big.join(shared_out(common), ["u", "share"], "left").select("u", "v", "whole", n.alias("parts"), far_first.alias("far_first"), any_first.alias("any_first"), F.concat(F.sort_array(F.array_except("parts", known)), F.array_intersect(known, "parts")).alias("ordered"))
    each = F.posexplode(F.slice("ordered", F.lit(1), F.greatest("far_first", "any_first").cast("int"))).alias("place", "part")
    rank = F.col("place") + F.lit(1).cast("long")
    first = first.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return first.select("u", "v", "whole", "parts", "far_first", "any_first", each).select(F.xxhash64("u", "part").alias("key"), F.col("v").alias("node"), (rank <= F.col("far_first")).alias("far"), (rank <= F.col("any_first")).alias("any"), "parts", rank.alias("rank"), "whole")


def _met_in_buckets(rest: DataFrame) -> DataFrame:
    """Pairs (u, v), u the lesser, of rows of one key: one that is far and one that is any. A pair of which either could be either comes once a key, not twice."""
    own = ["node", "far", "any", "parts", "rank", "whole"]
    a = rest.where("far").select("key", *[F.col(x).alias(f"u_{x}") for x in own])
    b = rest.where("`any`").select("key", *[F.col(x).alias(f"v_{x}") for x in own])
    # The parts shared, at most from the rank of the first on, against those that near texts of these sizes share.
    shared = 1 + F.least(F.col("u_parts") - F.col("u_rank"), F.col("v_parts") - F.col("v_rank"))
    able = 18 * shared >= 9 * (F.col("u_parts") + F.col("v_parts")) - F.col("u_whole") - F.col("v_whole")
    once = F.when(F.col("u_any") & F.col("v_far"), F.col("u_node") < F.col("v_node")).otherwise(F.col("u_node") != F.col("v_node"))
    return a.join(b, (a.key == b.key) & once & able).select(F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v"))


def _links(members: DataFrame, texts: DataFrame, registers: int) -> list[DataFrame]:
    """Written tables of links (u, v) between the nodes of buckets (key, node, n: their number), which connect whatever the buckets' near pairs do."""
    links = []
    for turn in range(ROUNDS):
        weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
        chosen = members.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("top"))
        # A bucket's best member may itself stand in a bucket with a better one: that serves both, so that a group of copies has few pivots.
        best = members.join(chosen, "key").groupBy("node").agg(F.max("top").alias("best"))
        chosen = chosen.join(best, F.col("top.node") == F.col("node")).select("key", F.col("best.node").alias("u"))
        here = written(members.join(chosen, "key").where("node <> u").select("key", "u", F.col("node").alias("v"), (F.col("n") > SMALL).alias("big")), "met-pivot")
        pairs = here.groupBy("u", "v").agg(F.max("big").alias("big"))
        met = written(_met(pairs, texts, registers), "met")
        links.append(met.where("near").select("u", "v"))
        links[-1].scratch = met.scratch
        near = met.where("near").select("u", "v", F.lit(True).alias("near"))
        rest = here.where("not big").join(near, ["u", "v"], "left").select("key", F.col("v").alias("node"), F.col("near").isNull().alias("far"), F.lit(True).alias("any"), *[F.lit(0).cast("long").alias(x) for x in ("parts", "rank", "whole")])
        rest = written(rest.unionByName(_smaller(met)), "rest")
        open_ = rest.groupBy("key").agg(F.count("*").alias("n"), F.max("far").alias("some")).where("n > 1 and some").drop("some")
        rest, old = written(rest.join(open_, "key"), "open"), rest
        few = F.lit(turn == ROUNDS - 1) | (F.col("n") <= F.when(F.col("whole") > 0, MANY).otherwise(SMALL))
        pairs = _met_in_buckets(rest.where(few)).distinct()
        more = written(_met(pairs.withColumn("big", F.lit(False)), texts, registers).where("near").select("u", "v"), "links")
        links.append(more)
        dropped(here, old, *([] if len(links) == 2 else [members]))
        members = rest.where(~few).select("key", "node", "n")
        members.scratch = rest.scratch
        if turn == ROUNDS - 1 or members.isEmpty():
            break
    dropped(rest)
    return links


def near_classes(documents: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """node (text_hash of the text), class_id, head, at: for each distinct text its class; head: the class keeps this one, of the row with doc_id `at` (NO_ID: null)."""
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = docs.select("doc_id", text_hash().alias("node"), "text").mapInArrow(freed(_signed(bands, rows)), "doc_id long, node binary, keys array<long>, sig array<long>")
    nodes = written(signed.groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.any_value("keys").alias("keys"), F.any_value("sig").alias("sig")), "nodes")
    keys = nodes.select("node", F.explode("keys").alias("key"))
    often = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keys.join(often, "key").select("key", "node", "n"), "members")
    # Copies of one text lie on as many keys as they have ids, not on one.
    at = lambda c: F.coalesce(c, F.lit(NO_ID)).alias("at")
    some = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", at("first_doc"), "sig")
    texts = docs.where("text is not null").select(text_hash().alias("node"), at("doc_id"), "text").join(some, ["node", "at"]).dropDuplicates(["node", "at"])
    texts = written(texts.select("node", "sig", "text"), "texts")
    links = _links(members, texts, bands * rows)
    comp = components(reduce(DataFrame.unionByName, links))
    known = nodes.select("node", "first_doc").join(comp, "node", "left").select("node", "first_doc", F.coalesce("comp", "node").alias("comp"))
    first = known.groupBy("comp").agg(F.min(F.struct(F.col("first_doc").isNull(), F.col("first_doc").alias("doc"), F.col("node").alias("head"))).alias("first"))
    classes = known.join(first, "comp").select("node", F.col("first.doc").alias("class_id"), (F.col("node") == F.col("first.head")).alias("head"), at("first_doc"))
    classes = written(classes, "classes")
    dropped(nodes, members, texts, comp, *links)
    return classes


def near_duplicates(documents: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id and class_id for each document."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.select("doc_id", text_hash().alias("node")).join(near_classes(documents, bands, rows).select("node", "class_id"), "node").select("doc_id", "class_id")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
