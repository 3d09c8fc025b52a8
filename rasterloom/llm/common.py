"""What several operators share: the shared folder, written tables, even ranges of document ids."""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words: space and the control characters from tab to carriage return.
SPACE = " \\t-\\r"
WORD = "[^ \\x09-\\x0D]+"
#: Bytes of an Arrow batch: two tasks of an executor hold a few of them each, however long the texts are.
ARROW_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes: by rows alone (10,000), a batch of long texts takes hundreds of MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def freed(run):
    """run, and afterwards the worker hands free memory back to the system: it lives on for other tasks."""

    def then(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return then


def trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session (tests, bench) that names none gets a temporary one: on a cluster others could not read it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="rasterloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet into the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch = path
    return found


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def id_bounds(docs: DataFrame, parts: int, key: str = "doc_id") -> list[int]:
    """parts - 1 ascending ids that cut the table into ranges of about as many rows. Only the id column is read; the driver gets 8 bytes a range."""
    if parts <= 1:
        return []
    at = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx(key, at, max(10_000, 20 * parts)).alias("q")).first()["q"]
    return sorted(set(found or []))


def id_range(key: Column, bounds: list[int]) -> Column:
    """The number of bounds that are at or below key: a binary search over a literal array, without a join."""
    if not bounds:
        return F.lit(0)
    cuts = F.array(*[F.lit(x).cast("long") for x in bounds]) if len(bounds) < 16 else F.from_json(F.lit(str(bounds)), "array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(math.ceil(math.log2(len(bounds) + 1))))])
    found = F.aggregate(steps, F.lit(0), lambda lo, k: F.when((lo + k <= len(bounds)) & (F.get(cuts, lo + k - 1) <= key), lo + k).otherwise(lo))
    return F.coalesce(found, F.lit(0))


def text_hash(text: str = "text") -> Column:
    """16 bytes that tell texts apart; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def numbered(docs: DataFrame) -> DataFrame | None:
    """None if each doc_id stands on one text only. Else doc_id, node (text_hash), row: the rank of each text by (doc_id, node), as a row of its own each.

    Ids and hashes alone are shuffled; a rank is a row's place in its range of ids, plus the rows of the ranges before.
    """
    clash = docs.groupBy("doc_id").agg(F.min(F.xxhash64(F.coalesce("text", F.lit("")))).alias("lo"), F.max(F.xxhash64(F.coalesce("text", F.lit("")))).alias("hi")).where("lo <> hi")
    if clash.isEmpty():
        return None
    ids = docs.select("doc_id", text_hash().alias("node")).distinct()
    ids = written(ids.withColumn("part", id_range(F.col("doc_id"), id_bounds(docs, min(1 << 20, docs.count() // 200_000 + 1)))), "ids")
    # A row for each range, 2**20 at most.
    before = ids.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "node"))
    return written(ids.withColumn("row", inside).join(before, "part").select("doc_id", "node", (F.col("row") + F.col("before")).alias("row")), "numbered")
