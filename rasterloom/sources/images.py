"""Image and palette files as rasters: width, height, bpp, palette, data (top-down, a byte a pixel for indexed images, else 3 or 4 in r, g, b, a).

BMP (1 to 32 bits, uncompressed), PCX, TGA, PNG; palettes CLR, RIFF and JASC. Indices are kept as stored, so entries
of equal colour stay apart, which Spark's own image source doesn't do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import bound_batches, in_batches


@dataclass
class Raster:
    width: int
    height: int
    bpp: int
    palette: list[tuple[int, int, int]]
    data: bytes


def _indices(rows: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Packed rows to one index a byte, the highest bits first."""
    if bits == 8:
        return rows[:, :width]
    shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
    return ((rows[:, :, None] >> shifts) & ((1 << bits) - 1)).reshape(len(rows), -1)[:, :width]


def _five(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.uint32)
    return np.stack([((v >> s & 31) * 255 // 31).astype(np.uint8) for s in (10, 5, 0)], axis=-1)


def bmp(b: bytes) -> Raster:
    if b[:2] != b"BM":
        raise ValueError("not a BMP")
    at, head = struct.unpack_from("<II", b, 10)
    if head == 12:
        width, height, _, bits = struct.unpack_from("<HHHH", b, 18)
        compression = used = 0
    else:
        width, height, _, bits, compression = struct.unpack_from("<iiHHI", b, 18)
        used = struct.unpack_from("<I", b, 46)[0]
    if compression:
        raise ValueError("compressed BMP")
    size = 3 if head == 12 else 4
    n = (used or 1 << bits) if bits <= 8 else 0
    palette = [(b[p + 2], b[p + 1], b[p]) for p in range(14 + head, 14 + head + n * size, size)]
    pitch = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(b, np.uint8, pitch * abs(height), at).reshape(abs(height), pitch)
    rows = rows if height < 0 else rows[::-1]
    if bits <= 8:
        px = _indices(rows, width, bits)
    elif bits == 16:
        px = _five(np.ascontiguousarray(rows[:, : 2 * width]).view("<u2"))
    else:
        px = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, [2, 1, 0, 3][: bits // 8]]
    return Raster(width, abs(height), 24 if bits == 16 else bits, palette, px.tobytes())


def pcx(b: bytes) -> Raster:
    if b[0] != 10:
        raise ValueError("not a PCX")
    bits, x0, y0, x1, y1 = struct.unpack_from("<BHHHH", b, 3)
    planes, pitch = b[65], struct.unpack_from("<H", b, 66)[0]
    width, height = x1 - x0 + 1, y1 - y0 + 1
    out, at, need = bytearray(), 128, pitch * planes * height
    while len(out) < need:
        v, n = b[at], 1
        if b[2] and v >= 0xC0:
            n, at = v & 63, at + 1
            v = b[at]
        out += bytes([v]) * n
        at += 1
    rows = np.frombuffer(bytes(out[:need]), np.uint8).reshape(height, planes, pitch)
    if bits == 8 and planes == 3:
        return Raster(width, height, 24, [], rows[:, :, :width].transpose(0, 2, 1).tobytes())
    if bits == 8:
        tail = b[-768:]
        return Raster(width, height, 8, [tuple(tail[k : k + 3]) for k in range(0, 768, 3)], rows[:, 0, :width].tobytes())
    flat = sum(_indices(rows[:, k], width, bits).astype(np.uint8) << (k * bits) for k in range(planes))
    total = bits * planes
    return Raster(width, height, total, [tuple(b[16 + k : 19 + k]) for k in range(0, 3 << min(4, total), 3)], flat.astype(np.uint8).tobytes())


def tga(b: bytes) -> Raster:
    skip, mapped, kind, first, n, entry = struct.unpack_from("<BBBHHB", b)
    width, height, bits, flags = struct.unpack_from("<HHBB", b, 12)
    if kind not in (1, 2, 3, 9, 10, 11):
        raise ValueError("not such a TGA")
    at, size = 18 + skip, (bits + 7) // 8

    def colors(raw: np.ndarray, depth: int) -> np.ndarray:
        return _five(raw.copy().view("<u2")[..., 0]) if depth in (15, 16) else raw[..., [2, 1, 0, 3][: depth // 8]]

    palette = [(0, 0, 0)] * first
    if mapped:
        e = (entry + 7) // 8
        palette += [tuple(int(x) for x in c[:3]) for c in colors(np.frombuffer(b, np.uint8, n * e, at).reshape(n, e), entry)]
        at += n * e
    if kind == 3 or kind == 11:
        palette = [(k, k, k) for k in range(256)]
    need = width * height * size
    if kind > 8:
        out = bytearray()
        while len(out) < need:
            c, at = b[at], at + 1
            k = (c & 127) + 1
            if c & 128:
                out += b[at : at + size] * k
                at += size
            else:
                out += b[at : at + size * k]
                at += size * k
        raw = bytes(out[:need])
    else:
        raw = b[at : at + need]
    px = np.frombuffer(raw, np.uint8).reshape(height, width, size)
    px = px if flags & 32 else px[::-1]
    if kind in (1, 3, 9, 11):
        return Raster(width, height, 8, palette, px.tobytes())
    px = colors(px, bits)
    return Raster(width, height, 8 * px.shape[-1], [], px.tobytes())


def png(b: bytes) -> Raster:
    if b[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, parts, palette = 8, [], []
    while at < len(b):
        n, name = struct.unpack_from(">I4s", b, at)
        data = b[at + 8 : at + 8 + n]
        at += 12 + n
        if name == b"IHDR":
            width, height, bits, kind, _, _, interlaced = struct.unpack(">IIBBBBB", data)
        elif name == b"PLTE":
            palette = [tuple(data[k : k + 3]) for k in range(0, n, 3)]
        elif name == b"IDAT":
            parts.append(data)
    if interlaced or bits == 2 or kind == 4:
        raise ValueError("interlaced, 2-bit or gray with alpha")
    each = {0: 1, 2: 3, 3: 1, 6: 4}[kind]
    pitch, step = (width * bits * each + 7) // 8, max(1, bits * each // 8)
    raw = zlib.decompress(b"".join(parts))
    rows = np.zeros((height, pitch), np.uint8)
    above = np.zeros(pitch, np.uint8)
    for y in range(height):
        how, line = raw[y * (pitch + 1)], bytearray(raw[y * (pitch + 1) + 1 : (y + 1) * (pitch + 1)])
        if how == 2:
            line = (np.frombuffer(bytes(line), np.uint8) + above).tobytes()
        elif how:
            up = above.tobytes()
            for x in range(pitch):
                left, top, corner = line[x - step] if x >= step else 0, up[x], up[x - step] if x >= step else 0
                if how == 1:
                    add = left
                elif how == 3:
                    add = (left + top) // 2
                else:
                    guess = left + top - corner
                    add = min((left, top, corner), key=lambda v: abs(guess - v))
                line[x] = (line[x] + add) & 255
        above = np.frombuffer(bytes(line), np.uint8)
        rows[y] = above
    if bits == 16:
        rows, bits = np.ascontiguousarray(rows[:, ::2]), 8
    if each == 1:
        palette = palette if kind == 3 else [(v * 255 // ((1 << bits) - 1),) * 3 for v in range(1 << bits)]
        return Raster(width, height, bits, palette, _indices(rows, width, bits).tobytes())
    return Raster(width, height, 8 * each, [], rows.tobytes())


DECODERS = {"bmp": bmp, "pcx": pcx, "tga": tga, "png": png}


def palette_file(b: bytes) -> list[tuple[int, int, int]]:
    """CLR (four bytes an entry), RIFF PAL or JASC."""
    if b[:4] == b"RIFF":
        n = struct.unpack_from("<H", b, 22)[0]
        return [tuple(b[k : k + 3]) for k in range(24, 24 + 4 * n, 4)]
    if b[:8] == b"JASC-PAL":
        lines = b.decode("ascii").split()
        return [tuple(int(x) for x in lines[k : k + 3]) for k in range(3, 3 + 3 * int(lines[2]), 3)]
    return [tuple(b[k : k + 3]) for k in range(0, len(b) // 4 * 4, 4)]


def write_bmp(r: Raster) -> bytes:
    """8-bit or 24-bit BMP."""
    indexed = r.bpp <= 8
    depth = 1 if indexed else r.bpp // 8
    px = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, depth)
    px = px if indexed else px[:, :, [2, 1, 0]]
    pitch = (r.width * px.shape[2] + 3) // 4 * 4
    rows = np.zeros((r.height, pitch), np.uint8)
    rows[:, : r.width * px.shape[2]] = px.reshape(r.height, -1)
    table = b"".join(bytes((b, g, red, 0)) for red, g, b in r.palette) if indexed else b""
    at = 54 + len(table)
    head = struct.pack("<2sIHHI", b"BM", at + rows.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, r.width, r.height, 1, 8 * px.shape[2], 0, rows.size, 0, 0, len(r.palette) if indexed else 0, 0)
    return head + table + rows[::-1].tobytes()


def _pixels(r: Raster) -> np.ndarray:
    """height, width, bytes of a pixel."""
    return np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 1 if r.bpp <= 8 else r.bpp // 8)


def _entries(r: Raster) -> bytes:
    """256 entries of a palette, missing ones black."""
    return b"".join(bytes(c) for c in r.palette).ljust(768, b"\0")[:768]


def write_png(r: Raster) -> bytes:
    """8-bit indexed, 24-bit or 32-bit PNG; lines without a filter."""
    px = _pixels(r)
    lines = np.zeros((r.height, 1 + r.width * px.shape[2]), np.uint8)
    lines[:, 1:] = px.reshape(r.height, -1)
    parts = [(b"IHDR", struct.pack(">IIBBBBB", r.width, r.height, 8, {1: 3, 3: 2, 4: 6}[px.shape[2]], 0, 0, 0))]
    if px.shape[2] == 1:
        parts.append((b"PLTE", b"".join(bytes(c) for c in r.palette[:256])))
    parts += [(b"IDAT", zlib.compress(lines.tobytes())), (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d)) for n, d in parts)


def write_pcx(r: Raster) -> bytes:
    """8-bit PCX, or one of three planes; runs of at most 63 within a line of a plane. An alpha channel isn't kept."""
    px = _pixels(r)[:, :, :3]
    planes, pitch = px.shape[2], r.width + r.width % 2
    rows = np.zeros((r.height, planes, pitch), np.uint8)
    rows[:, :, : r.width] = px.transpose(0, 2, 1)
    out = bytearray()
    for line in rows.reshape(-1, pitch):
        starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        for v, n in zip(line[starts].tolist(), np.diff(np.r_[starts, pitch]).tolist(), strict=True):
            while n:
                k = min(n, 63)
                out += bytes((0xC0 | k, v)) if k > 1 or v >= 0xC0 else bytes((v,))
                n -= k
    head = struct.pack("<BBBBHHHHHH48sBBHH58x", 10, 5, 1, 8, 0, 0, r.width - 1, r.height - 1, 72, 72, _entries(r)[:48], 0, planes, pitch, 1)
    return head + bytes(out) + (b"\x0c" + _entries(r) if planes == 1 else b"")


def write_tga(r: Raster) -> bytes:
    """8-bit mapped, 24-bit or 32-bit TGA, from the top, uncompressed."""
    px = _pixels(r)
    depth = px.shape[2]
    table = b"" if depth > 1 else b"".join(bytes((b, g, red)) for red, g, b in r.palette[:256])
    px = px if depth == 1 else px[:, :, [2, 1, 0, 3][:depth]]
    return struct.pack("<BBBHHBHHHHBB", 0, depth == 1, 1 if depth == 1 else 2, 0, len(table) // 3, 24 if table else 0, 0, 0, r.width, r.height, 8 * depth, 0x20 | (8 if depth == 4 else 0)) + table + px.tobytes()


def write_clr(palette: list[tuple[int, int, int]]) -> bytes:
    return b"".join(bytes((*c, 0)) for c in palette)


ENCODERS = {"bmp": write_bmp, "pcx": write_pcx, "tga": write_tga, "png": write_png}
SCHEMA = "image_id string, width int, height int, bpp int, palette array<struct<r:int,g:int,b:int>>, data binary, error string"


FILES = pa.schema([("path", pa.string()), ("content", pa.binary())])
IMAGES = pa.schema([("image_id", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("bpp", pa.int32()), ("palette", pa.list_(pa.struct([(c, pa.int32()) for c in "rgb"]))), ("data", pa.binary()), ("error", pa.string())])


def _entries_of(palettes: pa.ListArray) -> Iterator[list[tuple[int, int, int]]]:
    """The entries of one palette at a time."""
    at = palettes.offsets.to_pylist()
    colors = [palettes.values.field(k) for k in range(3)]
    for begin, end in zip(at, at[1:], strict=False):
        yield list(zip(*(c.slice(begin, end - begin).to_numpy(zero_copy_only=False).tolist() for c in colors), strict=True))


def _palettes_of(palettes: list[np.ndarray | None]) -> pa.Array:
    """The inverse of _entries_of, over arrays of one row an entry."""
    at, n = [], 0
    for p in palettes:
        at.append(None if p is None else n)
        n += 0 if p is None else len(p)
    flat = np.concatenate([np.zeros((0, 3), np.int32), *(p for p in palettes if p is not None)])
    kind = IMAGES.field("palette").type
    colors = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array([*at, n], pa.int32()), colors, type=kind)


def _images_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([_palettes_of(c) if f.name == "palette" else pa.array(c, f.type) for f, c in zip(IMAGES, columns, strict=True)], schema=IMAGES)


def _files_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(FILES, zip(*rows, strict=True), strict=True)], schema=FILES)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    r = DECODERS[path.rsplit(".", 1)[-1].lower()](bytes(content.as_py()))
                except (ValueError, KeyError, IndexError, struct.error, zlib.error, UnboundLocalError) as e:  # what damaged bytes raise in the decoders
                    yield 0, (path, None, None, None, None, None, f"{type(e).__name__}: {e}")
                    continue
                palette = np.array(r.palette, np.int32).reshape(-1, 3)
                yield palette.nbytes + len(r.data), (path, r.width, r.height, r.bpp, palette, r.data, None)

    yield from in_batches(rows(), _images_of)


def decoded(files: DataFrame) -> DataFrame:
    """A row for each file (path, content), by its extension. One that can't be decoded has its reason in `error`, and nulls."""
    bound_batches(files.sparkSession)
    return files.select("path", "content").mapInArrow(_decode, SCHEMA)


def encoded(images: DataFrame, kind: str) -> DataFrame:
    """path (image_id and the extension) and content of each image, as files of one kind."""
    write = ENCODERS[kind]

    def rows(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ids, widths, heights, depths = (b.column(c).to_pylist() for c in ("image_id", "width", "height", "bpp"))
            for i, w, h, n, p, x in zip(ids, widths, heights, depths, _entries_of(b.column("palette")), b.column("data"), strict=True):
                content = write(Raster(w, h, n, p, bytes(x.as_py())))
                yield len(content), (f"{i}.{kind}", content)

    bound_batches(images.sparkSession)
    of_ints = [F.col(c).cast("int").alias(c) for c in ("width", "height", "bpp")]
    palette = F.transform("palette", lambda c: F.struct(*[c[x].cast("int").alias(x) for x in "rgb"])).alias("palette")
    return images.select("image_id", *of_ints, palette, "data").mapInArrow(lambda batches: in_batches(rows(batches), _files_of), "path string, content binary")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """A row for each image file under path, as of decoded()."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{bmp,pcx,tga,png}").option("recursiveFileLookup", "true").load(path)
    return decoded(files)
