"""Language identification by string kernels.

The kernel of two texts is the number of hashed 1- to 3-grams of bytes that both hold, over the root of the product of
their numbers (a blended-spectrum presence kernel). Landmarks from each language give Nyström features; one-versus-rest
kernel ridge regression is fitted on a bounded sample (PER_LANGUAGE labelled documents of each language, those with the
smallest hash of doc_id). A batch of whole texts is scored by one matrix product with the landmarks.

Defined results: `und` with score 0 for a null text, one without letters, or if no labelled row exists; ties go to the
language that comes first; repeated rows are scored each; an empty table gives an empty result; rows without doc_id
are not held out; other columns are ignored. The number of languages is taken to be bounded (their counts are collected).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import freed, read_table, small_batches

#: Labelled documents and landmarks of a language, hashed n-grams, ridge, bytes scored at once.
PER_LANGUAGE, LANDMARKS, DIMS, RIDGE, BATCH = 150, 16, 14, 1e-3, 1 << 19
LETTER = regex.compile(r"\p{L}")


def presence(texts: list[str]) -> np.ndarray:
    """A row of 0 and 1 for each text: the hashed n-grams that it holds."""
    data = [t.lower().encode() for t in texts]
    b = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(data)), [len(x) for x in data])
    out = np.zeros((len(data), 1 << DIMS), np.uint8)
    code = np.zeros(len(b), np.uint32)
    for n in (1, 2, 3):
        k = len(b) - n + 1
        if k <= 0:
            break
        code = code[:k] * np.uint32(257) + b[n - 1 :] + np.uint32(1)
        h = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIMS)
        inside = row[:k] == row[n - 1 :]
        out.ravel()[(row[:k][inside] << DIMS) + h[inside]] = 1
    return out


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def kernel(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32)
        marks = self.landmarks.astype(np.float32)
        return (x @ marks.T) / np.sqrt(np.maximum(1, x.sum(axis=1)))[:, None] / np.sqrt(np.maximum(1, marks.sum(axis=1)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        k = self.kernel(x)
        return k @ self.weights[:-1] + self.weights[-1]


def fit(rows: list[tuple[str, str]]) -> Model | None:
    """rows: (language, text)."""
    rows = [(a, t) for a, t in rows if t and LETTER.search(t)]
    langs = sorted({a for a, _ in rows})
    if not langs:
        return None
    x = np.concatenate([presence([t for _, t in rows[i : i + 64]]) for i in range(0, len(rows), 64)])
    y = np.array([langs.index(a) for a, _ in rows])
    marks = np.concatenate([np.flatnonzero(y == k)[:LANDMARKS] for k in range(len(langs))])
    m = Model(langs, x[marks], np.zeros((len(marks) + 1, len(langs))))
    values, vectors = np.linalg.eigh(m.kernel(x[marks]).astype(np.float64))
    half = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    f = m.kernel(x) @ half
    mean = f.mean(axis=0)
    one = (y[:, None] == np.arange(len(langs))).astype(np.float64)
    beta = np.linalg.solve((f - mean).T @ (f - mean) + RIDGE * len(y) * np.eye(len(marks)), (f - mean).T @ (one - one.mean(axis=0)))
    m.weights = np.concatenate([half @ beta, [one.mean(axis=0) - mean @ beta]]).astype(np.float32)
    return m


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Two passes over doc_id and lang choose the sample's ids; a third reads those rows' texts."""
    known = documents.select("doc_id", F.col("lang").cast("string").alias("lang"), F.abs(F.xxhash64("doc_id") % (1 << 30)).alias("h")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    n = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not n:
        return None
    part = F.create_map(*[F.lit(x) for a, k in n.items() for x in (a, int(min(1.0, (3 * per_language + 200) / k) * (1 << 30)))])
    few = known.where(F.col("h") < part[F.col("lang")])
    ids = [r["doc_id"] for r in few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("k") <= per_language).select("doc_id").collect()]
    rows = documents.where(F.col("doc_id").isin(ids)).select("doc_id", F.col("lang").cast("string").alias("lang"), "text").where("lang is not null and text is not null").collect()
    place = {d: k for k, d in enumerate(ids)}
    return fit([(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (place[r["doc_id"]], r["lang"], r["text"]))])


def _score(model: Model | None, inside: str | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            columns = b.columns[:-1]
            if inside is not None:  # the text travels once, in the struct
                texts, columns = texts.field(inside), b.columns
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            some: list[int] = []
            held: list[str] = []

            def flush():
                if some:
                    s = model(presence(held))
                    best = s.argmax(axis=1)
                    for i, k, v in zip(some, best, s.max(axis=1), strict=True):
                        pred[i], score[i] = model.langs[k], min(1.0, max(0.0, float(v)))
                    some.clear()
                    held.clear()

            size = 0
            for i in range(len(texts)):
                t = texts[i].as_py()
                if model is None or not t or not LETTER.search(t):
                    continue
                some.append(i)
                held.append(t)
                size += len(t)
                if size > BATCH or len(some) >= 128:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names[: len(columns)], "lang_pred", "score"])

    return run


def identify(documents: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score; with keep also these columns of the document, as the struct doc."""
    small_batches(documents.sparkSession)
    inside = "text" if keep and "text" in keep and isinstance(documents.schema["text"].dataType, StringType) else None
    text = [] if inside else [F.col("text").cast("string").alias("text")]
    docs = documents.select(F.col("doc_id"), held_out().alias("held_out"), *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc")] if keep else []), *text)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.mapInArrow(freed(_score(model, inside)), f"{kinds}, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
