"""Rasters as pixel arrays, row by row: cutting, pasting, mirroring and tiling without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bits import bound


def _grid(width: int, height: int, at) -> Column:
    """A raster of which `at(x, y)` gives each pixel."""
    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda k: at((k % width).cast("int"), F.floor(k / width).cast("int")))


def crop(px: Column, width: int, height: int, left: int, top: int, right: int, bottom: int, fill: int = 0) -> Column:
    """The rectangle [left, right) x [top, bottom); what lies outside the raster is filled."""
    inside = lambda x, y: (x >= 0) & (x < width) & (y >= 0) & (y < height)
    return bound(px, lambda p: _grid(right - left, bottom - top, lambda x, y: F.when(inside(x + left, y + top), F.get(p, (y + top) * width + x + left)).otherwise(fill)))


def paste(px: Column, width: int, height: int, other: Column, w: int, h: int, left: int, top: int) -> Column:
    """px with the other raster laid over it at (left, top), clipped."""
    inside = lambda x, y: (x >= left) & (x < left + w) & (y >= top) & (y < top + h)
    return bound(F.struct(px.alias("p"), other.alias("o")), lambda b: _grid(width, height, lambda x, y: F.when(inside(x, y), F.get(b["o"], (y - top) * w + x - left)).otherwise(F.get(b["p"], y * width + x))))


def flip_h(px: Column, width: int, height: int) -> Column:
    return bound(px, lambda p: _grid(width, height, lambda x, y: F.get(p, y * width + (width - 1) - x)))


def flip_v(px: Column, width: int, height: int) -> Column:
    return bound(px, lambda p: _grid(width, height, lambda x, y: F.get(p, ((height - 1) - y) * width + x)))


def tiles(px: Column, width: int, height: int, tile_w: int, tile_h: int) -> Column:
    """An array of (ty, tx, tile), row by row; partial tiles at the rims are left out."""
    across, down = width // tile_w, height // tile_h
    cut = lambda p, ty, tx: _grid(tile_w, tile_h, lambda x, y: F.get(p, (ty * tile_h + y) * width + tx * tile_w + x))
    return bound(px, lambda p: F.transform(F.sequence(F.lit(0), F.lit(across * down - 1)), lambda k: F.struct(F.floor(k / across).cast("int").alias("ty"), (k % across).cast("int").alias("tx"), cut(p, F.floor(k / across).cast("int"), (k % across).cast("int")).alias("tile"))))


def untile(tiles_: Column, across: int, down: int, tile_w: int, tile_h: int, width: int | None = None, height: int | None = None) -> Column:
    """The inverse of tiles (an array of pixel arrays, row by row); what no tile covers is 0."""
    width, height = width or across * tile_w, height or down * tile_h
    fits = lambda x, y: (x < across * tile_w) & (y < down * tile_h)
    return bound(tiles_, lambda ts: _grid(width, height, lambda x, y: F.when(fits(x, y), F.get(F.get(ts, (F.floor(y / tile_h) * across + F.floor(x / tile_w)).cast("int")), ((y % tile_h) * tile_w + x % tile_w).cast("int"))).otherwise(0)))


def block_order(ty: Column, tx: Column, tiles_across: int, block: int = 32) -> Column:
    """Place of a tile when the map is stored in square blocks of `block` tiles, one after the other."""
    across = -(-tiles_across // block)
    n = F.floor(ty / block) * across + F.floor(tx / block)
    return (n * block * block + (ty % block) * block + tx % block).cast("long")


def fit_span(lo: Column, hi: Column, size: Column, block: int) -> tuple[Column, Column]:
    """One side of an area: its ends in order, the image's size for an upper end of 0, and a length up to a multiple of `block`."""
    first, last = F.least(lo, hi), F.greatest(lo, hi)
    last = F.when(last == 0, size).otherwise(last)
    return first, first + F.floor((last - first + block - 1) / block) * block
