"""Tile reduction: rasters to a dictionary of distinct tiles and a map of references to it, and back.

A tile is an array of integers, row by row. The dictionary is set-based: group by a key that is the same for all
tiles that match, first occurrence by position, ids in that order. Only keys and positions are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MapFormat:
    """Where a map entry keeps its fields: (shift, width)."""

    bits: int = 16
    tile: tuple[int, int] = (0, 10)
    hflip: tuple[int, int] = (10, 1)
    vflip: tuple[int, int] = (11, 1)
    bank: tuple[int, int] = (12, 4)
    base: int = 0

    @classmethod
    def parse(cls, text: str, base: int = 0) -> MapFormat:
        """From text such as 16:p4v1h1i10, highest field first: i tile, h and v flips, p bank, _ unused."""
        import re

        m = re.fullmatch(r"(\d+):((?:[iphv_]\d+)+)", text)
        if not m or int(m[1]) not in (8, 16):
            raise ValueError(f"no map format of 8 or 16 bits: {text}")
        fields = [(k, int(n)) for k, n in re.findall(r"([iphv_])(\d+)", m[2])]
        if sum(n for _, n in fields) > int(m[1]):
            raise ValueError(f"fields wider than the entry: {text}")
        at, found = 0, {}
        for k, n in reversed(fields):
            found[{"i": "tile", "h": "hflip", "v": "vflip", "p": "bank"}.get(k, "_")] = (at, n)
            at += n
        found.pop("_", None)
        return cls(int(m[1]), **{k: found.get(k, (0, 0)) for k in ("tile", "hflip", "vflip", "bank")}, base=base)


#: Tiles of a tileset: map entries have 16 bits at most.
MOST = 1 << 16
TEXT = MapFormat()
AFFINE = MapFormat(8, (0, 8), (0, 0), (0, 0), (0, 0))


def flipped(tile: Column, width: int, height: int, h: bool, v: bool) -> Column:
    """A mirrored tile: a permutation of its pixels."""
    order = [(height - 1 - y if v else y) * width + (width - 1 - x if h else x) for y in range(height) for x in range(width)]
    return F.array(*[F.get(tile, F.lit(k)) for k in order])


def bank_of(tile: Column) -> Column:
    """High nibble of the first pixel whose low nibble isn't 0, else 0."""
    lit = F.filter(tile, lambda p: p.bitwiseAND(F.lit(15)) != 0)
    return F.coalesce(F.shiftright(F.get(lit, F.lit(0)), 4), F.lit(0))


def low_nibbles(tile: Column) -> Column:
    return F.transform(tile, lambda p: p.bitwiseAND(F.lit(15)))


def reduce(tiles: DataFrame, at: list[str], width: int, height: int, flips: bool = False, banks: bool = False, seed: DataFrame | None = None, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """map (at, tile_id, hflip, vflip, bank) and tileset (tile_id, tile) of tiles (at, tile), in the order of `at`.

    Without a seed tile 0 is blank. A seed (tile_id, tile; ids 0 to n - 1, repeats allowed) comes first and keeps its
    ids. More than `most` tiles end the query. The order of columns is that of `at`: with tx before ty it goes by columns.
    A tile matches straight, mirrored across, both ways, then upside down; the lowest id of the first that matches.
    """
    tiles = tiles.select(*at, (low_nibbles(F.col("tile")) if banks else F.col("tile")).alias("tile"), (bank_of(F.col("tile")) if banks else F.lit(0)).alias("bank"))
    forms = [(False, False), *([(True, False), (True, True), (False, True)] if flips else [])]
    key = F.least(*[flipped(F.col("tile"), width, height, h, v) for h, v in forms]) if flips else F.col("tile")
    if seed is None:
        spark = tiles.sparkSession
        seed = spark.range(1).select(F.lit(0).cast("long").alias("tile_id"), F.array_repeat(F.lit(0), width * height).alias("tile"))
    seed = seed.select(F.col("tile_id").cast("long").alias("tile_id"), (low_nibbles(F.col("tile")) if banks else F.col("tile")).alias("tile"))
    keyed = tiles.withColumn("key", key)
    seeded = seed.withColumn("key", key)
    first = keyed.groupBy("key").agg(F.min(F.struct(*at, "tile")).alias("f"))
    new = first.join(seeded.select("key").distinct(), "key", "left_anti")
    n = seed.agg((F.coalesce(F.max("tile_id"), F.lit(-1)) + 1).alias("n")).first()["n"]
    # One task sees the first of the new tiles, one more than there may be.
    order = [F.col(f"f.{c}") for c in at]
    rank = F.row_number().over(Window.orderBy(*order)) - 1 + n
    first = new.orderBy(*order).limit(max(0, most - n) + 1).withColumn("rank", rank.cast("long"))
    fresh = first.select(F.when(F.col("rank") < most, F.col("rank")).otherwise(F.raise_error(F.lit(f"more than {most} tiles")).cast("long")).alias("tile_id"), F.col("f.tile").alias("tile"), "key")
    tileset = seeded.unionByName(fresh)
    entries = tileset.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("tile_id", "tile"))).alias("entries"))  # as many as a seed repeats or mirrors a tile
    found = keyed.join(entries, "key")
    ranked = F.array_min(F.flatten(F.transform("entries", lambda e: F.array(*[F.when(flipped(e["tile"], width, height, h, v) == F.col("tile"), F.struct(F.lit(k).alias("k"), e["tile_id"].alias("tile_id"))) for k, (h, v) in enumerate(forms)]))))
    found = found.withColumn("m", ranked)
    return found.select(*at, F.col("m.tile_id").alias("tile_id"), F.col("m.k").isin(1, 2).cast("int").alias("hflip"), F.col("m.k").isin(2, 3).cast("int").alias("vflip"), "bank"), tileset.select("tile_id", "tile")


def unreduced(tiles: DataFrame, file: str, at: list[str], banks: bool = False) -> DataFrame:
    """Maps without matching: file, at, tile_id, hflip, vflip, bank, tile. Each tile of a file has an id of its own, from 1 on in the order of `at` (0 is blank)."""
    bank = bank_of(F.col("tile")) if banks else F.lit(0)
    rank = F.row_number().over(Window.partitionBy(file).orderBy(*at)).cast("long")
    return tiles.select(file, *at, rank.alias("tile_id"), F.lit(0).alias("hflip"), F.lit(0).alias("vflip"), bank.alias("bank"), (low_nibbles(F.col("tile")) if banks else F.col("tile")).alias("tile"))


def pack_entry(fmt: MapFormat = TEXT, tile: str = "tile_id", hflip: str = "hflip", vflip: str = "vflip", bank: str = "bank") -> Column:
    """The map entry as an integer; base is added to every entry of 16 bits, and 8-bit ones keep the tile alone."""
    part = lambda c, f: F.shiftleft(F.col(c).cast("long").bitwiseAND(F.lit((1 << f[1]) - 1)), f[0])
    if fmt.bits == 8:
        return part(tile, fmt.tile).bitwiseAND(F.lit(0xFF))
    whole = part(tile, fmt.tile)
    for c, f in ((hflip, fmt.hflip), (vflip, fmt.vflip), (bank, fmt.bank)):
        whole = whole.bitwiseOR(part(c, f)) if f[1] else whole
    return (whole + fmt.base).bitwiseAND(F.lit(0xFFFF))


def unpack_entry(entry: Column, fmt: MapFormat = TEXT) -> dict[str, Column]:
    v = (entry - fmt.base if fmt.bits == 16 else entry).cast("long")
    take = lambda f: F.shiftright(v, f[0]).bitwiseAND(F.lit((1 << f[1]) - 1))
    return {"tile_id": take(fmt.tile), "hflip": take(fmt.hflip), "vflip": take(fmt.vflip), "bank": take(fmt.bank)}


def render(map_: DataFrame, tileset: DataFrame, at: list[str], width: int, height: int) -> DataFrame:
    """at and tile: the tiles that the map refers to, mirrored and banked."""
    t = F.col("tile")
    tile = F.when((F.col("hflip") == 1) & (F.col("vflip") == 1), flipped(t, width, height, True, True)).when(F.col("hflip") == 1, flipped(t, width, height, True, False)).when(F.col("vflip") == 1, flipped(t, width, height, False, True)).otherwise(t)
    banked = F.transform(tile, lambda p: F.when(p != 0, p.bitwiseOR(F.shiftleft(F.col("bank"), 4))).otherwise(p))
    return map_.join(tileset, "tile_id").select(*at, F.when(F.col("bank") > 0, banked).otherwise(tile).alias("tile"))


def metatiles(tiles: DataFrame, at: list[str], width: int, height: int, meta_w: int, meta_h: int, flips: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A map of metatiles (meta_w by meta_h tiles), the map of the metatiles' own tiles, and the tileset. The first metatile and tile are blank."""
    wide, high = width * meta_w, height * meta_h
    outer, metas = reduce(tiles, at, wide, high)
    cut = lambda ty, tx: F.array(*[F.get("tile", F.lit((ty * height + y) * wide + tx * width + x)) for y in range(height) for x in range(width)])
    parts = F.array(*[F.struct(F.lit(ty).alias("ty"), F.lit(tx).alias("tx"), cut(ty, tx).alias("tile")) for ty in range(meta_h) for tx in range(meta_w)])
    inner = metas.select(F.col("tile_id").alias("meta_id"), F.explode(parts).alias("p")).select("meta_id", "p.ty", "p.tx", "p.tile")
    return outer, *reduce(inner, ["meta_id", "ty", "tx"], width, height, flips)
