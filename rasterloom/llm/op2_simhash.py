"""Document fingerprints: SimHash, with DataFrame functions only.

Each word votes on 64 signed bits with its length (16 at most) as weight; a bit of the fingerprint is set if its votes
are positive. The votes of two bits share a long (32 bits each: the weights of a text cannot exceed its characters),
so 32 sums in whole-stage code count all of them. neighbours() finds all fingerprints within a Hamming radius by
permuted block tables; within() counts, for a set of queries, those of all fingerprints.

Defined results: a null text counts as empty; the fingerprint of a text without words is 0; equal texts have equal
fingerprints; rows that repeat a doc_id are ordered by text; other columns of the input are ignored; an empty table
gives an empty result; a table of one document has itself as next.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, id_bounds, id_range, read_table, written

LANES, MAX_WEIGHT = 32, 16
#: The query set of the search for near fingerprints: ids divisible by this, against all rows.
QUERY_EVERY = 20
PAIR = (1 << 32) | 1
LOW = (1 << 32) - 1


def simhash(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and fp (long) for each row of df; keys must tell the rows apart. No shuffle if df is partitioned by some of them."""
    words = df.select(*keys, F.explode(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+")).alias("word"))
    h, weight = F.xxhash64("word"), F.least(F.length("word"), F.lit(MAX_WEIGHT)).cast("long")
    votes = words.select(*keys, h.alias("h"), weight.alias("w"))
    sums = votes.groupBy(*keys).agg(F.sum("w").alias("w"), *[F.sum(F.shiftright("h", k).bitwiseAND(F.lit(PAIR)) * F.col("w")).alias(f"s{k}") for k in range(LANES)])
    bits = [F.when(2 * F.col(f"s{k}").bitwiseAND(F.lit(LOW)) > F.col("w"), F.lit(1 << k)).otherwise(F.lit(0).cast("long")) for k in range(LANES)]
    high = [F.when(2 * F.shiftrightunsigned(f"s{k}", 32) > F.col("w"), F.lit((1 << (k + 32)) - (1 << 64 if k == 31 else 0))).otherwise(F.lit(0).cast("long")) for k in range(LANES)]
    fp = bits[0].cast("long")
    for b in bits[1:] + high:
        fp = fp.bitwiseOR(b.cast("long"))
    return sums.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _tables(fps: DataFrame, radius: int, blocks: int) -> tuple[DataFrame, Column]:
    """fp, t, key: each distinct fingerprint in every permuted block table; and the first table in which fp and other meet."""
    width = [64 // blocks + (k < 64 % blocks) for k in range(blocks)]
    begin = [sum(width[:k]) for k in range(blocks)]
    cut = [F.shiftrightunsigned("fp", begin[k]).bitwiseAND(F.lit((1 << width[k]) - 1)) for k in range(blocks)]
    choices = list(combinations(range(blocks), blocks - radius))
    tables = F.array(*[F.xxhash64(F.lit(t), *[cut[k] for k in c]) for t, c in enumerate(choices)])
    x = F.col("fp").bitwiseXOR(F.col("other"))
    same = [x.bitwiseAND(F.lit(_signed(((1 << width[k]) - 1) << begin[k]))) == 0 for k in range(blocks)]
    first = F.lit(None).cast("int")
    for t, c in reversed(list(enumerate(choices))):
        both = same[c[0]]
        for k in c[1:]:
            both = both & same[k]
        first = F.when(both, F.lit(t)).otherwise(first)
    return fps.select("fp").where("fp is not null").distinct().select("fp", F.posexplode(tables).alias("t", "key")), first


def within(queries: DataFrame, fps: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """fp, n_near: for each distinct fingerprint of queries, how many other distinct ones of fps lie within the radius, by the same tables.

    A common block key has few queries for many fingerprints, and Spark splits its partition on the larger side. The tables
    are merged, not broadcast: Spark judges by the fingerprints' size before their rows are made twenty of.
    """
    own, first = _tables(queries, radius, blocks)
    other = _tables(fps, radius, blocks)[0].select(F.col("fp").alias("other"), F.col("t").alias("t2"), F.col("key").alias("key2"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius
    found = own.hint("merge").join(other, (F.col("key") == F.col("key2")) & (F.col("t") == F.col("t2")) & (F.col("fp") != F.col("other")) & near & (F.col("t") == first))
    return found.groupBy("fp").agg(F.count("*").alias("n_near"))


def neighbours(fps: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """fp, other: all pairs fp < other of distinct fingerprints within the radius (column fp of fps; documents with equal ones are one class).

    Fingerprints that differ in `radius` bits agree on blocks - radius of the blocks at least; each table permutes
    such a choice to the front and joins on it. A pair is reported by the first table that finds it only.
    """
    own, first = _tables(fps, radius, blocks)
    other = own.select(F.col("fp").alias("other"), F.col("t").alias("t2"), F.col("key").alias("key2"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius
    return own.join(other, (F.col("key") == F.col("key2")) & (F.col("t") == F.col("t2")) & (F.col("fp") < F.col("other")) & near & (F.col("t") == first)).select("fp", "other")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def edited(documents: DataFrame, range_bytes: int = 16 << 20) -> DataFrame:
    """part, rn, doc_id, text, edited, next_fp: each text beside the one whose last third gives way to the beginning of the next document's, by descending doc_id.

    The texts are shuffled once, by ranges of doc_id of about range_bytes; only the first row of each range travels to its neighbour.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    bounds = id_bounds(docs, min(1 << 20, size // range_bytes + 1))
    docs = docs.select(F.when(F.col("doc_id").isNull(), -1).otherwise(id_range(F.col("doc_id"), bounds)).cast("int").alias("part"), "doc_id", "text")
    order = Window.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    # The first row of every range: as many rows as ranges, 2**20 at most (24 MB), so they are sent to the texts, which are not shuffled again.
    tops = docs.groupBy("part").agg(F.max("doc_id").alias("doc_id"))
    heads = docs.alias("d").join(F.broadcast(tops).alias("t"), (F.col("d.part") == F.col("t.part")) & F.col("d.doc_id").eqNullSafe(F.col("t.doc_id"))).groupBy("t.part").agg(F.min("text").alias("text"))
    heads = simhash(heads, ["part", "text"])
    ring = Window.partitionBy(F.lit(0)).orderBy("part")
    ring = heads.select("part").withColumn("after", F.coalesce(F.lag("part").over(ring), F.max("part").over(Window.partitionBy(F.lit(0)))))
    heads = ring.join(heads.select(F.col("part").alias("after"), F.col("text").alias("head"), F.col("fp").alias("head_fp")), "after").drop("after")
    rows = docs.select("part", F.row_number().over(order).alias("rn"), "doc_id", "text", F.lead("text").over(order).alias("nxt"))
    rows = rows.join(heads, "part", "left")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    text = F.concat(F.substring("text", F.lit(1), n - third), F.substring(F.coalesce("nxt", "head"), F.lit(1), third))
    return rows.select("part", "rn", "doc_id", "text", text.alias("edited"), F.when(F.col("nxt").isNull(), F.col("head_fp")).alias("head_fp"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_near: of ids divisible by 20, how many other distinct fingerprints of the table lie within 3 bits (else null)."""
    rows = edited(read_table(spark, sf_dir, "documents"))
    keys = ["part", "rn", "doc_id", "head_fp", "n_chars", "edited_sha256"]
    both = rows.select("part", "rn", "doc_id", "head_fp", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("which", "text"))
    fps = simhash(both, [*keys, "which"]).groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))
    nxt = F.coalesce(F.lead("fp").over(Window.partitionBy("part").orderBy("rn")), F.col("head_fp"))
    fps = written(fps.withColumn("next_fp", nxt).drop("part", "rn", "head_fp"), "fingerprints")
    asked = F.coalesce(F.col("doc_id") % QUERY_EVERY == 0, F.lit(False))
    counts = within(fps.where(asked), fps)
    found = fps.where(asked).join(counts, "fp", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    return found.unionByName(fps.where(~asked).withColumn("n_near", F.lit(None).cast("long"))).select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near",
    )
