"""From raw documents to packed training sequences: each stage works on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Rows without doc_id go through
all stages, as do those of one doc_id and different texts; of near copies and repeated rows one stays (near_dedup). A null
or empty text ends in the first stage, as one without letters does. An empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rasterloom.llm.common import text_hash, written
from rasterloom.llm.op4_suffix_dedup import suffix_dedup
from rasterloom.llm.op6_minhash import NO_ID, near_classes
from rasterloom.llm.op8_language import identify, train
from rasterloom.llm.op9_mixing import mix
from rasterloom.llm.op10_packing import pack, token_pieces


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (no text, or none with letters) go; lang becomes the one found."""
    found = identify(docs, train(docs), keep=docs.columns)
    return found.where("lang_pred <> 'und'").select(*[F.col("lang_pred" if c == "lang" else f"doc.`{c}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: that of the least doc_id (null last), of several texts with it the one of the least hash, of repeated rows one.

    A null or empty text is a class of its own with its equals. Rows of one doc_id whose texts aren't near each other all stay.
    """
    heads = near_classes(docs).where("head").select("node", "at")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text_hash().alias("node"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("at"), F.to_json(F.struct(*others)).alias("rest"))
    again = F.row_number().over(Window.partitionBy("node", "at").orderBy("rest"))
    return rows.join(heads, ["node", "at"]).withColumn("again", again).where("again = 1").select("doc.*")


@F.pandas_udf(StringType())
def _characters(data: pd.Series) -> pd.Series:
    """The whole characters among some bytes."""
    return data.map(lambda b: None if b is None else bytes(b).decode(errors="ignore"))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that also start earlier go, and with them documents of which nothing is left. A cut inside a character drops its other bytes too."""
    whole = F.try_validate_utf8(F.col("kept").cast("string"))
    cut = suffix_dedup(docs).where("doc_id is not null").select("doc_id", "node", whole.alias("whole"), F.when(whole.isNull(), F.col("kept")).alias("broken"))
    cut = cut.select("doc_id", "node", F.coalesce("whole", _characters("broken")).alias("text")).where("length(text) > 0")
    new = {"text": F.col("cut.text"), "n_chars": F.length("cut.text").cast("long")}
    rest = docs.where("doc_id is not null").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text_hash().alias("own")).alias("d")
    rest = rest.join(cut.alias("cut"), (F.col("doc.doc_id") == F.col("cut.doc_id")) & (F.col("d.own") == F.col("cut.node")))
    return rest.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns]).unionByName(docs.where("doc_id is null").select(*docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is repeated as often as the mix takes it; those taken not at all go."""
    times = written(mix(docs, keep=docs.columns), "mixed").withColumn("times", F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int"))
    return times.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(written(token_pieces(docs), "pieces")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language", language), ("near_dedup", near_dedup), ("suffix_array_dedup", suffix_array_dedup), ("mixing", mixing), ("packing", packing)]

#: The stages hash, learn and tokenize, which SQL can't express: tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
