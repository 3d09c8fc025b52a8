"""The queries of the raster and byte operators over the synthetic tables, and the same in DuckDB's SQL.

A row of embeddings is an 8x8 raster: one bit a pixel (positive or not), or a byte (its value scaled).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits, color, names
from ..functions.batches import bound_batches
from ..operators import codecs, geometry, palettes, tiles
from ..sources import export, images

SIDE = 8
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rasters(spark: SparkSession, d: str, kind: str = "bit") -> DataFrame:
    """vec_id, px: 64 pixels."""
    one = {"bit": lambda e: (e > 0).cast("int"), "byte": lambda e: F.floor((e.cast("double") + 1) * 100).cast("int")}[kind]
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", one).alias("px"))


def subtiles(spark: SparkSession, d: str, kind: str = "bit") -> DataFrame:
    """vec_id, ty, tx, tile: 2x2 tiles."""
    cut = geometry.tiles(F.col("px"), SIDE, SIDE, 2, 2)
    return rasters(spark, d, kind).select("vec_id", F.explode(cut).alias("t")).select("vec_id", "t.ty", "t.tx", "t.tile")


AT = ["vec_id", "ty", "tx"]
_PX = "px AS (SELECT vec_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CASE WHEN embedding[i] > 0 THEN 1 ELSE 0 END AS v, CAST(floor((CAST(embedding[i] AS DOUBLE) + 1) * 100) AS INTEGER) AS b FROM embeddings, unnest(range(1, 65)) AS u(i))"
_TILES = _PX + """, tiles AS (SELECT vec_id, CAST(y // 2 AS INTEGER) AS ty, CAST(x // 2 AS INTEGER) AS tx,
  max(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN {v} END) AS a, max(CASE WHEN y % 2 = 0 AND x % 2 = 1 THEN {v} END) AS b,
  max(CASE WHEN y % 2 = 1 AND x % 2 = 0 THEN {v} END) AS c, max(CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN {v} END) AS d
  FROM px GROUP BY vec_id, y // 2, x // 2)"""


@query("WITH " + _TILES.format(v="v") + """,
first AS (SELECT a, b, c, d, min((vec_id, ty, tx)) AS f FROM tiles WHERE a + b + c + d > 0 GROUP BY a, b, c, d),
ids AS (SELECT a, b, c, d, row_number() OVER (ORDER BY f) AS id FROM first UNION ALL SELECT 0, 0, 0, 0, 0)
SELECT vec_id, ty, tx, CAST(id AS BIGINT) AS tile_id, CAST(id % 1024 AS BIGINT) AS mapsel FROM tiles JOIN ids USING (a, b, c, d)""")
def tile_dedup(spark, d):
    map_, _ = tiles.reduce(subtiles(spark, d), AT, 2, 2)
    return map_.select(*AT, "tile_id", tiles.pack_entry().alias("mapsel"))


_FLIP = "WITH " + _TILES.format(v="v") + """,
keyed AS (SELECT *, least(a * 8 + b * 4 + c * 2 + d, b * 8 + a * 4 + d * 2 + c, d * 8 + c * 4 + b * 2 + a, c * 8 + d * 4 + a * 2 + b) AS key FROM tiles),
first AS (SELECT key, min((vec_id, ty, tx)) AS f, arg_min((a, b, c, d), (vec_id, ty, tx)) AS r FROM keyed WHERE key > 0 GROUP BY key),
ids AS (SELECT key, r, row_number() OVER (ORDER BY f) AS id FROM first UNION ALL SELECT 0, (0, 0, 0, 0), 0),
found AS (SELECT vec_id, ty, tx, a, b, c, d, id, CASE WHEN (a, b, c, d) = r THEN 0 WHEN (b, a, d, c) = r THEN 1 WHEN (d, c, b, a) = r THEN 2 ELSE 3 END AS k FROM keyed JOIN ids USING (key)) """


@query(_FLIP + "SELECT vec_id, ty, tx, CAST(id AS BIGINT) AS tile_id, CAST(k IN (1, 2) AS INTEGER) AS hflip, CAST(k IN (2, 3) AS INTEGER) AS vflip FROM found")
def tile_dedup_flip(spark, d):
    map_, _ = tiles.reduce(subtiles(spark, d), AT, 2, 2, flips=True)
    return map_.select(*AT, "tile_id", "hflip", "vflip")


@query("WITH " + _TILES.format(v="b") + """,
banked AS (SELECT vec_id, ty, tx, a % 16 AS a, b % 16 AS b, c % 16 AS c, d % 16 AS d,
  CASE WHEN a % 16 <> 0 THEN a // 16 WHEN b % 16 <> 0 THEN b // 16 WHEN c % 16 <> 0 THEN c // 16 WHEN d % 16 <> 0 THEN d // 16 ELSE 0 END AS bank FROM tiles),
first AS (SELECT a, b, c, d, min((vec_id, ty, tx)) AS f FROM banked WHERE a + b + c + d > 0 GROUP BY a, b, c, d),
ids AS (SELECT a, b, c, d, row_number() OVER (ORDER BY f) AS id FROM first UNION ALL SELECT 0, 0, 0, 0, 0)
SELECT vec_id, ty, tx, CAST(id AS BIGINT) AS tile_id, CAST(bank AS INTEGER) AS bank FROM banked JOIN ids USING (a, b, c, d)""")
def tile_dedup_pbank(spark, d):
    map_, _ = tiles.reduce(subtiles(spark, d, "byte"), AT, 2, 2, banks=True)
    return map_.select(*AT, "tile_id", F.col("bank").cast("int").alias("bank"))


@query("WITH " + _TILES.format(v="v") + """,
seed AS (SELECT * FROM (VALUES (1, 1, 0, 0, 0), (0, 0, 0, 1, 1), (1, 1, 0, 0, 2), (1, 1, 1, 1, 3)) AS s(a, b, c, d, id)),
known AS (SELECT a, b, c, d, min(id) AS id FROM seed GROUP BY a, b, c, d),
first AS (SELECT a, b, c, d, min((vec_id, ty, tx)) AS f FROM tiles ANTI JOIN known USING (a, b, c, d) GROUP BY a, b, c, d),
ids AS (SELECT a, b, c, d, 3 + row_number() OVER (ORDER BY f) AS id FROM first UNION ALL SELECT * FROM known)
SELECT vec_id, ty, tx, CAST(id AS BIGINT) AS tile_id FROM tiles JOIN ids USING (a, b, c, d)""")
def tile_dedup_seeded(spark, d):
    seed = spark.createDataFrame([(0, [1, 1, 0, 0]), (1, [0, 0, 0, 1]), (2, [1, 1, 0, 0]), (3, [1, 1, 1, 1])], "tile_id long, tile array<int>")
    map_, _ = tiles.reduce(subtiles(spark, d), AT, 2, 2, seed=seed)
    return map_.select(*AT, "tile_id")


@query("WITH " + _TILES.format(v="v") + " SELECT vec_id, ty, tx, a * 1000 + b * 100 + c * 10 + d AS px FROM tiles")
def tilemap_render(spark, d):
    map_, tileset = tiles.reduce(subtiles(spark, d), AT, 2, 2, flips=True)
    t = tiles.render(map_, tileset, AT, 2, 2)
    return t.select(*AT, sum(F.get("tile", F.lit(k)) * 10 ** (3 - k) for k in range(4)).cast("int").alias("px"))


@query("WITH " + _PX + """, quads AS (SELECT vec_id, CAST(y // 4 AS INTEGER) AS my, CAST(x // 4 AS INTEGER) AS mx, string_agg(CAST(v AS VARCHAR), '' ORDER BY y, x) AS k FROM px GROUP BY vec_id, y // 4, x // 4),
first AS (SELECT k, min((vec_id, my, mx)) AS f FROM quads WHERE k <> repeat('0', 16) GROUP BY k),
ids AS (SELECT k, row_number() OVER (ORDER BY f) AS id FROM first UNION ALL SELECT repeat('0', 16), 0)
SELECT vec_id, my, mx, CAST(id AS BIGINT) AS meta_id FROM quads JOIN ids USING (k)""")
def metatile_map(spark, d):
    quads = rasters(spark, d).select("vec_id", F.explode(geometry.tiles(F.col("px"), SIDE, SIDE, 4, 4)).alias("t")).select("vec_id", F.col("t.ty").alias("my"), F.col("t.tx").alias("mx"), "t.tile")
    outer, _, _ = tiles.metatiles(quads, ["vec_id", "my", "mx"], 2, 2, 2, 2, flips=True)
    return outer.select("vec_id", "my", "mx", F.col("tile_id").alias("meta_id"))


@query("SELECT l_orderkey, l_linenumber, (l_partkey % 1024 + (l_linenumber % 2) * 1024 + (l_suppkey % 2) * 2048 + (l_suppkey % 16) * 4096 + 256) % 65536 AS mapsel, l_partkey % 256 AS affine FROM lineitem")
def tilemap_pack(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 1024).alias("tile_id"), (F.col("l_linenumber") % 2).alias("hflip"), (F.col("l_suppkey") % 2).alias("vflip"), (F.col("l_suppkey") % 16).alias("bank"))
    return rows.select("l_orderkey", "l_linenumber", tiles.pack_entry(tiles.MapFormat.parse("16:p4v1h1i10", base=256)).alias("mapsel"), tiles.pack_entry(tiles.AFFINE).alias("affine"))


@query("SELECT l_orderkey, l_linenumber, e % 1024 AS tile_id, e // 1024 % 2 AS hflip, e // 2048 % 2 AS vflip, e // 4096 % 16 AS bank FROM (SELECT l_orderkey, l_linenumber, l_partkey * 31 % 65536 AS e FROM lineitem)")
def tilemap_unpack(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in tiles.unpack_entry(F.col("l_partkey") * 31 % 65536).items()])


def _geometry(spark, d, px) -> DataFrame:
    return rasters(spark, d, "byte").select("vec_id", F.array_join(px(F.col("px")), ",").alias("px"))


def _grid(w: int, h: int, value: str) -> str:
    return "WITH " + _PX + f" SELECT e.vec_id, string_agg(CAST({value} AS VARCHAR), ',' ORDER BY g.y, g.x) AS px FROM embeddings e CROSS JOIN (SELECT yy.i AS y, xx.i AS x FROM range({h}) yy(i), range({w}) xx(i)) g LEFT JOIN px p ON p.vec_id = e.vec_id AND {{on}} GROUP BY e.vec_id"


@query(_grid(9, 7, "coalesce(p.b, 0)").format(on="p.x = g.x - 2 AND p.y = g.y + 3"))
def crop_zero_fill(spark, d):
    return _geometry(spark, d, lambda px: geometry.crop(px, SIDE, SIDE, -2, 3, 7, 10))


@query("WITH " + _PX + " SELECT vec_id, string_agg(CAST(CASE WHEN x >= 6 AND y < 2 THEN 1000 + (y + 1) * 3 + x - 6 ELSE b END AS VARCHAR), ',' ORDER BY y, x) AS px FROM px GROUP BY vec_id")
def paste(spark, d):
    return _geometry(spark, d, lambda px: geometry.paste(px, SIDE, SIDE, F.array(*[F.lit(1000 + k) for k in range(9)]), 3, 3, 6, -1))


@query(_grid(8, 8, "p.b").format(on="p.x = 7 - g.x AND p.y = g.y"))
def flip_h(spark, d):
    return _geometry(spark, d, lambda px: geometry.flip_h(px, SIDE, SIDE))


@query(_grid(8, 8, "p.b").format(on="p.x = g.x AND p.y = 7 - g.y"))
def flip_v(spark, d):
    return _geometry(spark, d, lambda px: geometry.flip_v(px, SIDE, SIDE))


@query("WITH " + _PX + " SELECT vec_id, CAST(y // 4 AS INTEGER) AS ty, CAST(x // 4 AS INTEGER) AS tx, string_agg(CAST(b AS VARCHAR), ',' ORDER BY y, x) AS px FROM px GROUP BY vec_id, y // 4, x // 4")
def retile(spark, d):
    return rasters(spark, d, "byte").select("vec_id", F.explode(geometry.tiles(F.col("px"), SIDE, SIDE, 4, 4)).alias("t")).select("vec_id", "t.ty", "t.tx", F.array_join("t.tile", ",").alias("px"))


@query("WITH " + _PX + " SELECT vec_id, string_agg(CAST(CASE WHEN x < 6 AND y < 6 THEN b ELSE 0 END AS VARCHAR), ',' ORDER BY y, x) AS px FROM px GROUP BY vec_id")
def untile(spark, d):
    return _geometry(spark, d, lambda px: geometry.untile(F.transform(geometry.tiles(geometry.crop(px, SIDE, SIDE, 0, 0, 6, 7), 6, 7, 3, 3), lambda t: t["tile"]), 2, 2, 3, 3, SIDE, SIDE))


@query("SELECT l_orderkey, l_linenumber, (ty // 32 * 4 + tx // 32) * 1024 + ty % 32 * 32 + tx % 32 AS place FROM (SELECT l_orderkey, l_linenumber, l_partkey % 128 AS tx, l_suppkey % 96 AS ty FROM lineitem)")
def screenblock_order(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", geometry.block_order(F.col("l_suppkey") % 96, F.col("l_partkey") % 128, 128).alias("place"))


# Colours of parts: fixed multiples of the key.
_RGB = "(SELECT p_partkey, CAST(p_partkey * 37 % 256 AS INTEGER) AS r, CAST(p_partkey * 91 % 256 AS INTEGER) AS g, CAST(p_partkey * 53 % 256 AS INTEGER) AS b FROM part)"


def _colors(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", *[(F.col("p_partkey") * k % 256).cast("int").alias(c) for c, k in (("r", 37), ("g", 91), ("b", 53))])


@query(f"SELECT p_partkey, CAST(r // 8 + g // 8 * 32 + b // 8 * 1024 AS INTEGER) AS c FROM {_RGB}")
def rgb_to_555(spark, d):
    return _colors(spark, d).select("p_partkey", color.rgb555(F.col("r"), F.col("g"), F.col("b")).alias("c"))


@query("SELECT p_partkey, CAST(c % 32 * 255 // 31 AS INTEGER) AS r, CAST(c // 32 % 32 * 255 // 31 AS INTEGER) AS g, CAST(c // 1024 % 32 * 255 // 31 AS INTEGER) AS b FROM (SELECT p_partkey, p_partkey * 7919 % 32768 AS c FROM part)")
def rgb555_expand(spark, d):
    c = (F.col("p_partkey") * 7919 % 32768).cast("int")
    return table(spark, d, "part").select("p_partkey", *[color.to8(x).alias(n) for n, x in zip("rgb", color.channels(c), strict=True)])


@query("SELECT p_partkey, CAST(c // 32768 * 32768 + c % 32 * 1024 + c // 32 % 32 * 32 + c // 1024 % 32 AS INTEGER) AS c16, CAST(w % 256 * 65536 + w // 256 % 256 * 256 + w // 65536 AS INTEGER) AS c24 FROM (SELECT p_partkey, p_partkey * 7919 % 65536 AS c, p_partkey * 7919 % 16777216 AS w FROM part)")
def swap_rb(spark, d):
    x = F.col("p_partkey") * 7919
    return table(spark, d, "part").select("p_partkey", color.swap_rb16((x % 65536).cast("int")).alias("c16"), color.swap_rb24((x % 16777216).cast("int")).alias("c24"))


@query("SELECT p_partkey, CAST(c + 32768 AS INTEGER) AS every, CAST(CASE WHEN c = 31 THEN c ELSE c + 32768 END AS INTEGER) AS but_one FROM (SELECT p_partkey, p_partkey * 7919 % 32768 AS c FROM part)")
def alpha_bit(spark, d):
    c = (F.col("p_partkey") * 7919 % 32768).cast("int")
    return table(spark, d, "part").select("p_partkey", color.with_alpha(c).alias("every"), color.with_alpha(c, "except", 31).alias("but_one"))


@query(f"SELECT p_partkey, CAST(255 - r AS INTEGER) AS inverted, CAST(least(255, r + 40) AS INTEGER) AS brighter FROM {_RGB}")
def color_adjust(spark, d):
    return _colors(spark, d).select("p_partkey", color.adjust(F.col("r"), "invert").alias("inverted"), color.adjust(F.col("r"), "brightness", 40).alias("brighter"))


def _palettes(spark, d) -> DataFrame:
    """Palettes of 16 parts."""
    return _colors(spark, d).select(F.floor(F.col("p_partkey") / 16).cast("long").alias("palette_id"), (F.col("p_partkey") % 16).cast("int").alias("idx"), "r", "g", "b")


_PALETTES = f"(SELECT p_partkey // 16 AS palette_id, CAST(p_partkey % 16 AS INTEGER) AS idx, r, g, b FROM {_RGB})"


@query(f"WITH {_PX} SELECT vec_id, x, y, r, g, b FROM (SELECT vec_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, b % 16 AS i FROM px) JOIN (SELECT palette_id, idx AS i, r, g, b FROM {_PALETTES}) p USING (i) WHERE palette_id = vec_id % (SELECT max(palette_id) + 1 FROM {_PALETTES})")
def palette_lookup(spark, d):
    """Each raster with one of all palettes."""
    palettes_ = _palettes(spark, d)
    n = palettes_.agg(F.max("palette_id") + 1).first()[0] or 1
    px = rasters(spark, d, "byte").select("vec_id", (F.col("vec_id") % n).alias("palette_id"), F.posexplode("px").alias("k", "v")).select("vec_id", "palette_id", (F.col("k") % 8).alias("x"), F.floor(F.col("k") / 8).cast("int").alias("y"), (F.col("v") % 16).alias("idx"))
    return px.join(palettes_, ["palette_id", "idx"]).select("vec_id", "x", "y", "r", "g", "b")


_NEAREST = f"SELECT palette_id, idx, d2 FROM (SELECT palette_id, idx, CAST((r - 248) * (r - 248) + g * g + (b - 248) * (b - 248) AS BIGINT) AS d2, row_number() OVER (PARTITION BY palette_id ORDER BY (r - 248) * (r - 248) + g * g + (b - 248) * (b - 248), idx) AS k FROM {_PALETTES}) WHERE k = 1 AND d2 < 576"


@query(_NEAREST)
def nearest_palette(spark, d):
    return palettes.nearest(_palettes(spark, d), (248, 0, 248))


@query(f"SELECT palette_id, CAST(CASE WHEN p.idx = 0 THEN coalesce(n.idx, 0) WHEN p.idx = n.idx THEN 0 ELSE p.idx END AS INTEGER) AS idx, r, g, b FROM {_PALETTES} p LEFT JOIN ({_NEAREST}) n USING (palette_id)")
def swap_transparent(spark, d):
    p = _palettes(spark, d)
    return palettes.swap(p, palettes.nearest(p, (248, 0, 248)))


_USED = "(SELECT p_partkey // 16 AS file, CAST(p_partkey % 16 AS INTEGER) AS idx, CAST(p_partkey * 37 % 5 AS INTEGER) AS r, CAST(p_partkey * 91 % 6 AS INTEGER) AS g, CAST(p_partkey * 53 % 4 AS INTEGER) AS b FROM part)"


@query(f"WITH used AS {_USED}, merged AS (SELECT r, g, b, row_number() OVER (ORDER BY min((file, idx))) - 1 AS i FROM used GROUP BY r, g, b) SELECT file, idx, CAST(i AS INTEGER) AS new_idx FROM used JOIN merged USING (r, g, b)")
def palette_merge(spark, d):
    k = F.col("p_partkey")
    used = table(spark, d, "part").select(F.floor(k / 16).cast("long").alias("file"), (k % 16).cast("int").alias("idx"), (k * 37 % 5).cast("int").alias("r"), (k * 91 % 6).cast("int").alias("g"), (k * 53 % 4).cast("int").alias("b"))
    return palettes.merge(used)[1]


@query(f"""WITH used AS {_USED}, start AS (SELECT * FROM (VALUES (0, 4, 5, 3), (1, 1, 1, 1), (2, 1, 1, 1), (3, 9, 9, 9)) AS s(idx, r, g, b)),
fresh AS (SELECT r, g, b, min((file, idx)) AS f FROM used ANTI JOIN start USING (r, g, b) GROUP BY r, g, b),
merged AS (SELECT r, g, b, 3 + row_number() OVER (ORDER BY f) AS i FROM fresh UNION ALL SELECT r, g, b, min(idx) FROM start GROUP BY r, g, b)
SELECT file, idx, CAST(i AS INTEGER) AS new_idx FROM used JOIN merged USING (r, g, b)""")
def palette_merge_external(spark, d):
    """Merging that starts from an external palette, one of whose colours stands there twice."""
    k = F.col("p_partkey")
    used = table(spark, d, "part").select(F.floor(k / 16).cast("long").alias("file"), (k % 16).cast("int").alias("idx"), (k * 37 % 5).cast("int").alias("r"), (k * 91 % 6).cast("int").alias("g"), (k * 53 % 4).cast("int").alias("b"))
    start = spark.createDataFrame([(0, 4, 5, 3), (1, 1, 1, 1), (2, 1, 1, 1), (3, 9, 9, 9)], "idx int, r int, g int, b int")
    return palettes.merge(used, start)[1]


@query(f"SELECT palette_id, CAST(idx - 3 AS INTEGER) AS idx, CAST(r // 8 + g // 8 * 32 + b // 8 * 1024 AS INTEGER) AS c FROM {_PALETTES} WHERE idx BETWEEN 3 AND 11")
def palette_slice(spark, d):
    """Entries 3 to 11 of each palette as device colours."""
    return palettes.sliced(_palettes(spark, d), 3, 12).select("palette_id", "idx", color.rgb555(F.col("r"), F.col("g"), F.col("b")).alias("c"))


_DEPTHS = "SELECT p_partkey, w % 32768 AS h, w % 16777216 AS t, w AS q FROM (SELECT p_partkey, p_partkey * 2654435761 % 4294967296 AS w FROM part)"


@query(f"""WITH s AS ({_DEPTHS}), e AS (SELECT *, h // 1024 * 255 // 31 * 65536 + h // 32 % 32 * 255 // 31 * 256 + h % 32 * 255 // 31 AS up FROM s)
SELECT p_partkey, up AS c16_24, up + 4278190080 AS c16_32, t // 524288 * 1024 + t // 2048 % 32 * 32 + t // 8 % 32 AS c24_16, t + 4278190080 AS c24_32, q // 524288 % 32 * 1024 + q // 2048 % 32 * 32 + q // 8 % 32 AS c32_16, q % 16777216 AS c32_24, q AS c32_32 FROM e""")
def true_color_depths(spark, d):
    w = F.col("p_partkey") * 2654435761 % 4294967296
    of = {16: w % 32768, 24: w % 16777216, 32: w}
    pairs = [(16, 24), (16, 32), (24, 16), (24, 32), (32, 16), (32, 24), (32, 32)]
    return table(spark, d, "part").select("p_partkey", *[color.true_color(of[a], a, b).alias(f"c{a}_{b}") for a, b in pairs])


@query("WITH " + _TILES.format(v="v") + """,
first AS (SELECT a, b, c, d, min((vec_id, tx, ty)) AS f FROM tiles WHERE a + b + c + d > 0 GROUP BY a, b, c, d),
ids AS (SELECT a, b, c, d, row_number() OVER (ORDER BY f) AS id FROM first UNION ALL SELECT 0, 0, 0, 0, 0)
SELECT vec_id, ty, tx, CAST(id AS BIGINT) AS tile_id FROM tiles JOIN ids USING (a, b, c, d)""")
def tile_dedup_colmajor(spark, d):
    return tiles.reduce(subtiles(spark, d), ["vec_id", "tx", "ty"], 2, 2)[0].select(*AT, "tile_id")


@query("WITH " + _TILES.format(v="b") + """
SELECT vec_id, ty, tx, CAST(ty * 4 + tx + 1 AS BIGINT) AS tile_id, CAST(CASE WHEN a % 16 <> 0 THEN a // 16 WHEN b % 16 <> 0 THEN b // 16 WHEN c % 16 <> 0 THEN c // 16 WHEN d % 16 <> 0 THEN d // 16 ELSE 0 END AS INTEGER) AS bank,
  concat_ws(',', a % 16, b % 16, c % 16, d % 16) AS px FROM tiles""")
def tilemap_unreduced(spark, d):
    out = tiles.unreduced(subtiles(spark, d, "byte"), "vec_id", ["ty", "tx"], banks=True)
    return out.select(*AT, "tile_id", F.col("bank").cast("int").alias("bank"), F.array_join("tile", ",").alias("px"))


@query("""SELECT l_orderkey, l_linenumber, lo, CAST(lo + (CASE WHEN hi = 0 THEN 240 ELSE hi END - lo + 15) // 16 * 16 AS BIGINT) AS hi FROM
(SELECT l_orderkey, l_linenumber, least(l_partkey % 50, l_suppkey % 50) AS lo, greatest(l_partkey % 50, l_suppkey % 50) AS hi FROM lineitem)""")
def area_fit(spark, d):
    lo, hi = geometry.fit_span(F.col("l_partkey") % 50, F.col("l_suppkey") % 50, F.lit(240), 16)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", lo.alias("lo"), hi.cast("long").alias("hi"))


def _image(kind: str) -> None:
    def run(spark, d):
        two = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
        rgb = lambda v: F.concat(two(v), two(255 - v), two(F.shiftright(v, 1)))
        forms = F.array(*[F.struct(F.lit(n).alias("bpp"), F.unhex(F.array_join(F.transform("px", f), "")).alias("data")) for n, f in ((8, two), (24, rgb))])
        palette = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.struct((i * 37 % 256).alias("r"), (255 - i).alias("g"), (i * 91 % 256).alias("b")))
        made = rasters(spark, d, "byte").select("vec_id", F.explode(forms).alias("f")).select(F.concat("vec_id", F.lit("-"), "f.bpp").alias("image_id"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), "f.bpp", F.when(F.col("f.bpp") == 8, palette).otherwise(F.slice(palette, 1, 0)).alias("palette"), "f.data")
        back = images.decoded(images.encoded(made, kind))
        c = F.get("palette", F.conv(F.substring(F.hex("data"), 1, 2), 16, 10).cast("int"))
        return back.select(F.regexp_extract("image_id", r"^(\d+)-", 1).cast("long").alias("vec_id"), "width", "height", "bpp", F.hex("data").alias("data"), *[c[x].alias(x) for x in "rgb"])

    run.__name__ = f"image_{kind}_roundtrip"
    query("WITH " + _PX + """, f AS (SELECT vec_id, string_agg(printf('%02X', b), '' ORDER BY y, x) AS one, string_agg(printf('%02X%02X%02X', b, 255 - b, b // 2), '' ORDER BY y, x) AS three, min(CASE WHEN x = 0 AND y = 0 THEN b END) AS i FROM px GROUP BY vec_id)
SELECT CAST(vec_id AS BIGINT) AS vec_id, 8 AS width, 8 AS height, 8 AS bpp, one AS data, CAST(i * 37 % 256 AS INTEGER) AS r, CAST(255 - i AS INTEGER) AS g, CAST(i * 91 % 256 AS INTEGER) AS b FROM f UNION ALL SELECT vec_id, 8, 8, 24, three, NULL, NULL, NULL FROM f""")(run)


for _name in images.ENCODERS:
    _image(_name)


@query()
def quantize(spark, d):
    hist = _colors(spark, d).groupBy("r", "g", "b").agg(F.count("*").alias("count"))
    return palettes.quantize(hist, 64)


@query("WITH h AS (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS v FROM documents) SELECT v, count(*) AS n FROM h GROUP BY v")
def byte_histogram(spark, d):
    h = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.hex(F.col("text").cast("binary")), F.lit("(..)"), F.lit(1))).alias("v"))
    return h.groupBy("v").agg(F.count("*").alias("n"))


@query("""WITH px AS (SELECT vec_id, i, embedding[i] > 0 AS v FROM embeddings, unnest(range(1, 65)) AS u(i)),
runs AS (SELECT vec_id, i, v, i - row_number() OVER (PARTITION BY vec_id, v ORDER BY i) AS g FROM px)
SELECT vec_id, CAST(min(i) - 1 AS INTEGER) AS first, CAST(v AS INTEGER) AS v, count(*) AS n FROM runs GROUP BY vec_id, v, g""")
def run_segments(spark, d):
    px = rasters(spark, d).select("vec_id", F.posexplode("px").alias("k", "v"))
    new = F.when(F.lag("v").over(Window.partitionBy("vec_id").orderBy("k")) == F.col("v"), 0).otherwise(1)
    px = px.withColumn("new", new).withColumn("g", F.sum("new").over(Window.partitionBy("vec_id").orderBy("k")))
    return px.groupBy("vec_id", "v", "g").agg(F.min("k").alias("first"), F.count("*").alias("n")).select("vec_id", "first", "v", "n")


@query("WITH " + _PX + " SELECT vec_id, CAST(y AS INTEGER) AS place, CAST(sum(CAST(b % 16 AS BIGINT) * CAST(power(16, x) AS BIGINT)) AS BIGINT) AS word FROM px GROUP BY vec_id, y")
def bit_pack4(spark, d):
    """All 64 pixels of each raster."""
    return rasters(spark, d, "byte").select("vec_id", F.posexplode(bits.pack_words(F.col("px"), 4, 8)).alias("place", "word"))


@query("SELECT l_orderkey, l_linenumber, concat_ws(',', w % 16, w // 16 % 16, w // 256 % 16, w // 4096 % 16) AS fields FROM (SELECT l_orderkey, l_linenumber, l_partkey * 7919 % 65536 AS w FROM lineitem)")
def bit_unpack4(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(",", bits.unpack(F.col("l_partkey") * 7919 % 65536, 4, 4).cast("array<string>")).alias("fields"))


@query("SELECT doc_id, md5(regexp_replace(hex(encode(text)), '(..)(..)(..)(..)', '\\4\\3\\2\\1', 'g')) AS reversed FROM documents")
def byte_reverse(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(bits.byte_reverse(F.hex(F.col("text").cast("binary")), 4)).alias("reversed"))


@query("SELECT l_orderkey, l_linenumber, l_partkey // 8 % 32 AS got, l_partkey - l_partkey // 8 % 32 * 8 + l_suppkey % 32 * 8 AS put FROM lineitem")
def bitfields(spark, d):
    p = F.col("l_partkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", bits.field(p, 3, 5).alias("got"), bits.with_field(p, F.col("l_suppkey"), 3, 5).alias("put"))


@query("""SELECT l_orderkey, l_linenumber, (l_partkey + 6) // 7 * 7 AS aligned, greatest(10, least(l_partkey, 99)) AS clamped,
  CASE WHEN l_linenumber >= 5 THEN 8 - l_linenumber WHEN l_linenumber < 2 THEN 4 - l_linenumber ELSE l_linenumber END AS reflected,
  CASE WHEN l_linenumber >= 5 THEN l_linenumber - 3 WHEN l_linenumber < 2 THEN l_linenumber + 3 ELSE l_linenumber END AS wrapped,
  CASE WHEN l_suppkey <= 1 THEN 1 ELSE CAST(power(2, ceil(log2(l_suppkey))) AS BIGINT) END AS power FROM lineitem""")
def align_clamp_reflect_wrap(spark, d):
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", bits.align(p, 7).alias("aligned"), bits.clamp(p, 10, 100).alias("clamped"), bits.reflect(n, 2, 5).alias("reflected"), bits.wrap(n, 2, 5).alias("wrapped"), bits.next_power_of_two(F.col("l_suppkey")).alias("power"))


@query(r"""SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS name, regexp_extract(url, '^(.*)[/\\]', 1) AS dir, regexp_extract(regexp_extract(url, '([^/\\]*)$', 1), '\.([^.]*)$', 1) AS ext,
  regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '\.[^.]*$', '') AS title, regexp_replace(url, '\.[^./\\]*$', '') || '.bin' AS other FROM pages""")
def path_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", names.path_name(u).alias("name"), names.path_dir(u).alias("dir"), names.path_ext(u).alias("ext"), names.path_title(u).alias("title"), names.with_ext(u, "bin").alias("other"))


@query("""SELECT page_id, ident(url) AS ident, ident(reverse(url)) AS turned, ident(CAST(page_id AS VARCHAR) || url) AS numbered FROM pages""".replace("ident(url)", "CASE WHEN regexp_matches(url, '^[A-Za-z]') THEN url[1] ELSE '_' END || regexp_replace(url[2:], '[^A-Za-z0-9_]', '_', 'g')").replace("ident(reverse(url))", "CASE WHEN regexp_matches(reverse(url), '^[A-Za-z]') THEN reverse(url)[1] ELSE '_' END || regexp_replace(reverse(url)[2:], '[^A-Za-z0-9_]', '_', 'g')").replace("ident(CAST(page_id AS VARCHAR) || url)", "'_' || regexp_replace((CAST(page_id AS VARCHAR) || url)[2:], '[^A-Za-z0-9_]', '_', 'g')"))
def ident_fix(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", names.identifier(u).alias("ident"), names.identifier(F.reverse(u)).alias("turned"), names.identifier(F.concat(F.col("page_id").cast("string"), u)).alias("numbered"))


@query("WITH " + _PX + """ SELECT vec_id, CAST(8 * y + x AS INTEGER) AS place, CAST(b % 16 * 16 + b // 16 AS BIGINT) AS nibbles, CAST(b % 4 * 64 + b // 4 % 4 * 16 + b // 16 % 4 * 4 + b // 64 AS BIGINT) AS pairs,
  CAST(b % 2 * 128 + b // 2 % 2 * 64 + b // 4 % 2 * 32 + b // 8 % 2 * 16 + b // 16 % 2 * 8 + b // 32 % 2 * 4 + b // 64 % 2 * 2 + b // 128 AS BIGINT) AS bits FROM px""")
def bit_reverse(spark, d):
    px = F.col("px").cast("array<bigint>")
    both = F.arrays_zip(bits.bit_reverse(px, 4).alias("nibbles"), bits.bit_reverse(px, 2).alias("pairs"), bits.bit_reverse(px, 1).alias("bits"))
    return rasters(spark, d, "byte").select("vec_id", F.posexplode(both).alias("place", "b")).select("vec_id", "place", "b.*")


@query("WITH " + _PX + """, f AS (SELECT vec_id, 8 * y + x AS i, CASE WHEN b = 0 THEN 0 ELSE (b - 3 + 256) % 16 END AS n, (b - 3 + 256) % 16 AS z FROM px)
SELECT vec_id, CAST(i // 2 AS INTEGER) AS place, CAST(sum(CASE WHEN i % 2 = 0 THEN n ELSE 16 * n END) AS BIGINT) AS low, CAST(sum(CASE WHEN i % 2 = 0 THEN 16 * z ELSE z END) AS BIGINT) AS high FROM f GROUP BY vec_id, i // 2""")
def bit_pack_base(spark, d):
    """8 to 4 bits with a base: lowest field first and zeros kept, and highest first with the base off zeros too."""
    px = F.col("px").cast("array<bigint>")
    both = F.arrays_zip(bits.pack_bytes(bits.less_base(px, 4, 3), 4).alias("low"), bits.pack_bytes(bits.less_base(px, 4, 3, True), 4, True).alias("high"))
    return rasters(spark, d, "byte").select("vec_id", F.posexplode(both).alias("place", "b")).select("vec_id", "place", "b.*")


@query("WITH " + _PX + """, f AS (SELECT vec_id, 8 * y + x AS i, unnest([0, 1]) AS k, b FROM px)
SELECT vec_id, CAST(2 * i + k AS INTEGER) AS place, CAST(CASE WHEN v = 0 THEN 0 ELSE v + 16 END AS BIGINT) AS low, CAST(w + 16 AS BIGINT) AS high FROM (SELECT vec_id, i, k, CASE WHEN k = 0 THEN b % 16 ELSE b // 16 END AS v, CASE WHEN k = 0 THEN b // 16 ELSE b % 16 END AS w FROM f)""")
def bit_unpack_base(spark, d):
    """4 to 8 bits with a base: lowest field first and zeros kept, and highest first with the base on zeros too."""
    px = F.col("px").cast("array<bigint>")
    both = F.arrays_zip(bits.add_base(bits.byte_fields(px, 4), 16).alias("low"), bits.add_base(bits.byte_fields(px, 4, True), 16, True).alias("high"))
    return rasters(spark, d, "byte").select("vec_id", F.posexplode(both).alias("place", "b")).select("vec_id", "place", "b.*")


@query("WITH " + _PX + """ SELECT vec_id, CAST(8 * y + x AS INTEGER) AS place, CAST(CASE p WHEN 0 THEN 5 WHEN 5 THEN 0 ELSE p END AS BIGINT) AS swapped, CAST(CASE p WHEN 1 THEN 30 WHEN 2 THEN 1 ELSE p END AS BIGINT) AS replaced, CAST(CASE WHEN p = 0 THEN 0 ELSE p + 4 END AS BIGINT) AS moved,
  CAST(p + b // 8 * 8 AS BIGINT) AS a5i3, CAST(p + 248 AS BIGINT) AS opaque FROM (SELECT *, b % 8 AS p FROM px)""")
def pixel_prep(spark, d):
    """Pixels with the transparent index swapped, values replaced, an offset, and alpha of textures (its own, and opaque)."""
    df = rasters(spark, d, "byte").select("vec_id", F.col("px").cast("array<bigint>").alias("px")).select("vec_id", "px", F.transform("px", lambda v: v % 8).alias("p"))
    long = lambda c: c.cast("array<bigint>")
    each = F.arrays_zip(long(bits.swap_index(F.col("p"), 5)).alias("swapped"), long(bits.replaced(F.col("p"), [1, 2], [30, 1])).alias("replaced"), bits.add_base(F.col("p"), 4).alias("moved"),
                        F.transform("px", lambda v: bits.texture_alpha(v % 8, v, 5)).alias("a5i3"), F.transform("p", lambda v: bits.texture_alpha(v, None, 5)).alias("opaque"))
    return df.select("vec_id", F.posexplode(each).alias("place", "b")).select("vec_id", "place", "b.*")


def _artifacts(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.concat(F.lit("d"), (F.col("doc_id") % 100).cast("string")).alias("symbol"), "doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"))


@query("SELECT 'd' || doc_id % 100 AS symbol, CAST(sum((strlen(coalesce(text, '')) + 3) // 4 * 4 + 8) + 20 AS BIGINT) AS size FROM documents GROUP BY doc_id % 100")
def artifact_sizes(spark, d):
    return export.sizes(_artifacts(spark, d), riff=True)


@query("""WITH old AS (SELECT substr(substr('entry_of_document_number_' || doc_id, 1, 21) || '_' || doc_id, 1, 24) AS name, strlen(text) AS n FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 <> 0),
new AS (SELECT substr(substr('entry_of_document_number_' || doc_id, 1, 21) || '_' || doc_id, 1, 24) AS name, -1 AS n FROM documents WHERE doc_id % 2 = 0)
SELECT name, CAST(n AS INTEGER) AS n FROM old WHERE name NOT IN (SELECT name FROM new) UNION ALL SELECT name, n FROM new""")
def archive_upsert(spark, d):
    i = F.col("doc_id").cast("string")
    entries = table(spark, d, "documents").select(F.substring(F.concat(F.substring(F.concat(F.lit("entry_of_document_number_"), i), 1, 21), F.lit("_"), i), 1, 24).alias("name"), "doc_id", F.octet_length("text").alias("n"))
    return export.upsert(entries.where("doc_id % 3 <> 0 or doc_id % 2 <> 0").select("name", "n"), entries.where("doc_id % 2 = 0").select("name", F.lit(-1).alias("n")))


@query()
def c_arrays(spark, d):
    bound_batches(spark)
    a = _artifacts(spark, d)
    name = F.concat("symbol", F.lit("_"), F.col("doc_id").cast("string"))
    return a.select("doc_id", F.md5(export.c_array(name, F.col("data"), "u16")).alias("c"), F.md5(export.asm_array(name, F.col("data"), "u32")).alias("asm"), export.c_header(name, F.col("data")).alias("header"))


def _codec(name: str) -> None:
    def run(spark, d):
        out = codecs.roundtrip(table(spark, d, "documents"), "doc_id", "text", name)
        return out.select("doc_id", "raw_size", F.md5("decoded").alias("decoded"))

    run.__name__ = f"codec_{name}_roundtrip"
    query("SELECT doc_id, strlen(coalesce(text, '')) AS raw_size, md5(coalesce(text, '')) AS decoded FROM documents")(run)


for _name in codecs.CODECS:
    _codec(_name)
