"""Palettes as rows (palette_id, idx, r, g, b): lookup, nearest colour, merging with remapped pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import DIFFER

#: Entries of a palette; more are refused.
MOST = 256


def nearest(palette: DataFrame, color: tuple[int, int, int], within: int | None = DIFFER) -> DataFrame:
    """palette_id, idx, d2: each palette's nearest entry to a colour, the lowest of equal ones; none at a squared distance of `within` or more."""
    r, g, b = color
    d2 = (F.col("r") - r) * (F.col("r") - r) + (F.col("g") - g) * (F.col("g") - g) + (F.col("b") - b) * (F.col("b") - b)
    best = palette.groupBy("palette_id").agg(F.min(F.struct(d2.cast("long").alias("d2"), "idx")).alias("m"))
    out = best.select("palette_id", "m.idx", "m.d2")
    return out if within is None else out.where(F.col("d2") < within)


def swap(palette: DataFrame, chosen: DataFrame) -> DataFrame:
    """palette with entry 0 and each palette's chosen entry (palette_id, idx) exchanged."""
    to = chosen.select("palette_id", F.col("idx").alias("other"))
    i = F.when(F.col("idx") == 0, F.col("other")).when(F.col("idx") == F.col("other"), F.lit(0)).otherwise(F.col("idx"))
    return palette.join(to, "palette_id", "left").select("palette_id", F.coalesce(i, "idx").cast("int").alias("idx"), "r", "g", "b")


def sliced(palette: DataFrame, start: int, end: int) -> DataFrame:
    """Entries start to end - 1 of each palette, as far as there are such, numbered from 0. No more than the palette's size are taken."""
    return palette.where((F.col("idx") >= start) & (F.col("idx") < end)).withColumn("idx", F.col("idx") - start)


def merge(used: DataFrame, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One palette from those of several files: palette (idx, r, g, b) of distinct colours in the order of (file, idx), and remap (file, idx, new_idx).

    used: file, idx, r, g, b of the entries in use. start: entries (idx from 0 on without gaps, r, g, b) that come first
    and keep their places, an external palette or the entry 0 to be kept; of equal ones the lowest counts. More than 256
    colours are refused.
    """
    first = used.groupBy("r", "g", "b").agg(F.min(F.struct("file", "idx")).alias("f"))
    n = 0
    if start is not None:
        n = start.limit(MOST + 1).count()
        first = first.join(start.select("r", "g", "b").distinct(), ["r", "g", "b"], "left_anti")
    if n + first.limit(MOST + 1).count() > MOST:
        raise ValueError(f"more than {MOST} colours")
    merged = first.select((F.row_number().over(Window.orderBy("f")) - 1 + n).cast("int").alias("idx"), "r", "g", "b")  # 256 rows at most
    if start is not None:
        known = start.groupBy("r", "g", "b").agg(F.min("idx").cast("int").alias("idx")).select("idx", "r", "g", "b")
        palette, merged = start.select(F.col("idx").cast("int").alias("idx"), "r", "g", "b").unionByName(merged), known.unionByName(merged)
        remap = used.join(F.broadcast(merged.withColumnRenamed("idx", "new_idx")), ["r", "g", "b"]).select("file", "idx", "new_idx")
        return palette, remap
    remap = used.join(F.broadcast(merged.withColumnRenamed("idx", "new_idx")), ["r", "g", "b"]).select("file", "idx", "new_idx")
    return merged, remap


def quantize(colors: DataFrame, n: int) -> DataFrame:
    """r, g, b, count and box, new_r, new_g, new_b: median cut of a histogram (r, g, b, count) into n boxes, each split at its weighted median along its longest side.

    Boxes are split level by level, so n is rounded up to a power of two of boxes at most; a box of one colour stays.
    """
    boxes = colors.withColumn("box", F.lit(0).cast("long"))
    depth = max(0, (n - 1).bit_length())
    for _ in range(depth):
        own = Window.partitionBy("box")
        spans = [F.max(c).over(own) - F.min(c).over(own) for c in "rgb"]
        boxes = boxes.select("*", *[s.alias(f"s{c}") for s, c in zip(spans, "rgb", strict=True)])
        axis = F.when((F.col("sr") >= F.col("sg")) & (F.col("sr") >= F.col("sb")), F.col("r")).when(F.col("sg") >= F.col("sb"), F.col("g")).otherwise(F.col("b"))
        boxes = boxes.withColumn("axis", axis)
        upto = F.sum("count").over(Window.partitionBy("box").orderBy("axis", "r", "g", "b").rowsBetween(Window.unboundedPreceding, -1))
        upper = (F.coalesce(upto, F.lit(0)) * 2 >= F.sum("count").over(own)) & (F.greatest("sr", "sg", "sb") > 0)
        boxes = boxes.withColumn("box", F.col("box") * 2 + upper.cast("long")).select("r", "g", "b", "count", "box")
    own = Window.partitionBy("box")
    mean = lambda c: F.floor(F.sum(F.col(c) * F.col("count")).over(own) / F.sum("count").over(own)).cast("int")
    return boxes.select("*", *[mean(c).alias(f"new_{c}") for c in "rgb"])
