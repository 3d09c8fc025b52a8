"""Mixing sources to target weights by hash-threshold histograms.

A source gives each document whole times (its target over its size, rounded down) and the rest by a threshold on a
hash of doc_id and text: words are summed by source and the hash's leading bits, the bucket in which the rest runs out is
refined by the next bits, and so on until it holds one hash; documents below the threshold are in. No sort, and a
larger share takes a superset of a smaller one.

Defined results: a null or empty text has size 0 and is taken 0 times; the null source comes last; ties cannot occur
(rows that repeat a doc_id and its text are in or out together; those without doc_id are told apart by text); an empty table gives an empty result; other columns are ignored.
The driver holds one row a source (some 100 bytes each), whose count is that of the sources, not of the documents; the
tables made of them are joined without a hint, so that Spark broadcasts them only while they are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, read_table, written

WEIGHTS = (5, 2, 1)
CAP, BITS = 3, 12
TOP = 63


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights=WEIGHTS, cap: int = CAP, total: float | None = None) -> dict:
    """Words for each source: shares by weight, none above cap times its size, the excess reshared by weight."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total = float(sum(sizes.values())) if total is None else total
    out: dict = {}
    left = set(order)
    while left:
        share = total - sum(out.values())
        whole = sum(weight[s] for s in left)
        over = [s for s in left if share * weight[s] / whole > cap * sizes[s]]
        if not over:
            out |= {s: share * weight[s] / whole for s in left}
            break
        out |= {s: float(cap * sizes[s]) for s in over}
        left -= set(over)
    return out


def thresholds(sizes: DataFrame, budgets: dict) -> dict:
    """For each source, the hash below which documents hold about its budget of words. sizes: source, size, h (0 to 2**63 - 1)."""
    spark = sizes.sparkSession
    done = {s: 0 for s, b in budgets.items() if b <= 0}
    state = {s: (0, float(b)) for s, b in budgets.items() if b > 0}
    shift = TOP
    while state:
        before, shift = shift, max(0, shift - BITS)
        known = spark.createDataFrame([(s, p, b) for s, (p, b) in state.items()], "src string, prefix long, budget double")
        match = F.col("source").eqNullSafe(F.col("src")) & ((F.shiftright("h", before) if before < TOP else F.lit(0).cast("long")) == F.col("prefix"))
        buckets = sizes.where("size > 0").join(known, match).groupBy("src", "budget", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("s"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        upto = F.sum("s").over(Window.partitionBy("src").orderBy("b"))
        edge = buckets.withColumn("upto", upto).where("upto > budget and upto - s <= budget")
        found = {r.src: r for r in edge.collect()}  # a row a source
        done |= {s: 1 << TOP for s in state if s not in found}
        nxt = {}
        for s, r in found.items():
            below = state[s][1] - (r.upto - r.s)
            if r.lo == r.hi:  # a single document: in, if that is nearer
                done[s] = r.hi + 1 if r.s - below < below else r.lo
            else:
                nxt[s] = (r.b, below)
        state = nxt
    return done


def mix(documents: DataFrame, weights=WEIGHTS, cap: int = CAP, keep: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes, whole times its size; with keep also these columns of the document, as the struct doc."""
    own = [F.col("source").cast("string").alias("source"), n_words().alias("size"), F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(9)), 1).alias("h")]
    sizes = written(documents.select("doc_id", *own), "sizes")
    per = {r.source: r.n for r in sizes.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    want = targets(per, weights, cap)
    times = {s: int(want[s] // n) if n else 0 for s, n in per.items()}
    cut = thresholds(sizes, {s: want[s] - times[s] * n for s, n in per.items()})
    # 2**63 does not fit a long: -1 stands for all.
    plan = [(s, n, want[s], times[s], -1 if cut[s] >= 1 << TOP else cut[s]) for s, n in per.items()]
    plan = documents.sparkSession.createDataFrame(plan, "src string, source_size long, target double, times int, cut long")
    extra = F.when((F.col("cut") < 0) | (F.col("h") < F.col("cut")), 1).otherwise(0)
    rows = documents.select("doc_id", F.struct(*keep).alias("doc"), *own) if keep else sizes
    return rows.join(plan, F.col("source").eqNullSafe(F.col("src"))).select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("times") + extra)).alias("taken"), *(["doc"] if keep else []))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))
