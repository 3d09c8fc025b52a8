import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from rasterloom.operators.tiles import MapFormat
from rasterloom.sources import export, images

R = random.Random(1)
PAL = [(R.randrange(256), R.randrange(256), R.randrange(256)) for _ in range(256)]
PAL[7] = PAL[3]  # entries of equal colour stay apart


def raster(bpp, w=13, h=5):
    data = R.randbytes(w * h) if bpp == 8 else R.randbytes(w * h * 3)
    return images.Raster(w, h, bpp, PAL if bpp == 8 else [], data)


def png_of(r, how):
    depth = 1 if r.bpp == 8 else 3
    pitch, lines, above = r.width * depth, b"", bytes(r.width * depth)
    for y in range(r.height):
        line = r.data[y * pitch : (y + 1) * pitch]
        out = bytearray()
        for x, v in enumerate(line):
            a, b, c = line[x - depth] if x >= depth else 0, above[x], above[x - depth] if x >= depth else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((v - (0, a, b, (a + b) // 2, paeth)[how]) & 255)
        lines, above = lines + bytes([how]) + bytes(out), line
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", r.width, r.height, 8, 3 if depth == 1 else 2, 0, 0, 0)) + (chunk(b"PLTE", b"".join(map(bytes, r.palette))) if depth == 1 else b"") + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("bpp", [8, 24])
def test_bmp_and_png(bpp):
    r = raster(bpp)
    assert images.bmp(images.write_bmp(r)) == r
    for how in range(5):
        assert images.png(png_of(r, how)) == r


def test_pcx_and_tga():
    r = raster(8)
    head = struct.pack("<BBBBHHHHHH48sBBH60x", 10, 5, 1, 8, 0, 0, r.width - 1, r.height - 1, 72, 72, bytes(48), 0, 1, r.width + 1)
    body = b"".join(bytes([0xC1, v]) if v >= 0xC0 else bytes([v]) for y in range(r.height) for v in r.data[y * r.width : (y + 1) * r.width] + b"\0")
    assert images.pcx(head + body + b"\x0c" + b"".join(map(bytes, PAL))) == r
    pal = b"".join(bytes((b, g, a)) for a, g, b in PAL)
    tga = struct.pack("<BBBHHBHHHHBB", 0, 1, 9, 0, 256, 24, 0, 0, r.width, r.height, 8, 32) + pal + b"".join(bytes([0x80, v]) for v in r.data)
    assert images.tga(tga) == r
    t = raster(24)
    plain = struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, t.width, t.height, 24, 32) + b"".join(t.data[k : k + 3][::-1] for k in range(0, len(t.data), 3))
    assert images.tga(plain) == t


def test_palette_files():
    few = PAL[:4]
    assert images.palette_file(b"".join(bytes((*c, 0)) for c in few)) == few
    assert images.palette_file(b"JASC-PAL\r\n0100\r\n4\r\n" + b"".join(b"%d %d %d\r\n" % c for c in few)) == few
    assert images.palette_file(b"RIFF" + struct.pack("<I4s4sIHH", 32, b"PAL ", b"data", 20, 0x300, 4) + b"".join(bytes((*c, 0)) for c in few)) == few


def test_read_images(spark, tmp_path):
    r = raster(8)
    (tmp_path / "a.bmp").write_bytes(images.write_bmp(r))
    (tmp_path / "b.png").write_bytes(png_of(r, 4))
    rows = images.read_images(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and all((x.width, x.height, x.bpp, bytes(x.data)) == (r.width, r.height, 8, r.data) and [tuple(c) for c in x.palette] == PAL for x in rows)


def test_arrays_archives_and_chunks(spark):
    data = R.randbytes(299)
    df = spark.createDataFrame([("tiles", data), ("none", b"")], "symbol string, data binary")
    for dtype in ("u8", "u16", "u32"):
        for make in (export.c_array, export.asm_array):
            text = {r.symbol: r.t for r in df.select("symbol", make(df.symbol, df.data, dtype).alias("t")).collect()}
            back = export.array_from_source(text["tiles"], "tiles")
            assert back[:299] == data and not any(back[299:]) and export.array_from_source(text["none"], "none") == b""
    entries = [("b", b"12345"), ("a", data)]
    assert export.read_archive(export.archive(entries)) == [("a", data + b"\0"), ("b", b"12345\0\0\0")]
    made = export.archives(spark.createDataFrame([("g", n, d) for n, d in entries], "g string, name string, data binary"), "g").first()
    assert bytes(made.archive) == export.archive(entries)
    riff = export.chunks({"PAL": b"123", "GFX": data})
    assert riff[:4] == b"RIFF" and struct.unpack_from("<I", riff, 4)[0] == len(riff) - 8


def test_map_formats():
    assert MapFormat.parse("16:p4v1h1i10") == MapFormat()
    assert MapFormat.parse("8:i8").tile == (0, 8) and MapFormat.parse("16:_3i13").tile == (0, 13)
    for bad in ("12:i8", "16:i17", "x", "8:p4i8"):
        with pytest.raises(ValueError):
            MapFormat.parse(bad)


def test_written_files_and_damaged_ones(spark):
    r, t = raster(8), raster(24)
    for kind in images.ENCODERS:
        for x in (r, t):
            assert images.DECODERS[kind](images.ENCODERS[kind](x)) == x
    assert images.palette_file(images.write_clr(PAL)) == PAL
    rows = [("a.png", images.write_png(r)), ("b.png", images.write_png(r)[:60]), ("c.bmp", b"no"), ("d.xyz", b""), ("e.tga", b""), ("f.pcx", b"\x0a")]
    out = {x.image_id: x for x in images.decoded(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert len(out) == 6 and out["a.png"].error is None and bytes(out["a.png"].data) == r.data
    assert all(out[p].error and out[p].data is None for p, _ in rows[1:])


def test_limits_are_refused(spark):
    from rasterloom.operators import palettes, tiles

    some = spark.range(1, 9).selectExpr("id AS at", "array(cast(id AS int)) AS tile")
    assert tiles.reduce(some, ["at"], 1, 1, most=9)[1].count() == 9
    with pytest.raises(Exception, match="more than 8 tiles"):
        tiles.reduce(some, ["at"], 1, 1, most=8)[0].collect()
    used = spark.range(300).selectExpr("0 AS file", "id AS idx", "int(id) AS r", "0 AS g", "0 AS b")
    with pytest.raises(ValueError, match="colours"):
        palettes.merge(used.where("idx < 200"), used.where("idx >= 200").selectExpr("int(idx - 200) AS idx", "r", "g", "1 AS b"))


@pytest.mark.parametrize("kind", ["tga", "png", "bmp", "pcx"])
def test_image_batches_are_bounded(spark, kind):
    import pyarrow as pa

    from rasterloom.functions import batches

    r, t = raster(8), raster(24)
    files = [(f"{k}.{kind}", images.ENCODERS[kind](x)) for k, x in enumerate([r, t] * 2000)] + [("none", b"")]
    given = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*files, strict=True)], ["path", "content"])
    out = list(images._decode(iter([given])))
    assert len(out) > 1 and all(b.nbytes <= 2 * batches.BATCH_BYTES for b in out)
    rows = [x for b in out for x in b.to_pylist()]
    assert [x["image_id"] for x in rows] == [p for p, _ in files] and all(x["data"] == (r, t)[k % 2].data for k, x in enumerate(rows[:-1]))
    assert [tuple(c.values()) for c in rows[-3]["palette"]] == PAL and rows[-2]["palette"] == [] and rows[-1]["palette"] is None and rows[-1]["error"]
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    made = spark.createDataFrame([("a", 13, 5, 8, PAL, r.data), ("b", 13, 5, 24, [], t.data)], "image_id string, width long, height int, bpp int, palette array<struct<r:int,g:long,b:int>>, data binary")
    back = {x.image_id: x for x in images.decoded(images.encoded(made, kind)).collect()}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == batches.BATCH_BYTES
    assert bytes(back[f"a.{kind}"].data) == r.data and list(map(tuple, back[f"a.{kind}"].palette)) == PAL and bytes(back[f"b.{kind}"].data) == t.data


def array_text(data, dtype, lead, end):
    size, per = export.ELEMENT[dtype][:2]
    data += bytes(-len(data) % size)
    values = ["0x" + data[k : k + size][::-1].hex().upper() for k in range(0, len(data), size)]
    rows = [values[k : k + per] for k in range(0, len(values), per)]
    return "\n".join(lead + ",".join(r) + (end if k < len(rows) - 1 else "") + ("\n" if k % 8 == 7 else "") for k, r in enumerate(rows))


def test_arrays_of_all_lengths_and_a_long_one_in_time(spark):
    import time

    rows = [(f"s{n}é", R.randbytes(n)) for n in [*range(70), 127, 128, 129, 255, 256, 257, 511, 512, 513, 2047, 2048, 2049]]
    df = spark.createDataFrame([*rows, ("n", None), (None, b"abc")], "symbol string, data binary")
    for dtype, (size, _, kind, word) in export.ELEMENT.items():
        got = {r.symbol: r for r in df.select("symbol", export.c_array(df.symbol, df.data, dtype).alias("c"), export.asm_array(df.symbol, df.data, dtype).alias("a")).collect()}
        for s, d in rows:
            assert got[s].c == f'const {kind} {s}[{-(-len(d) // 4) * 4 // size}] __attribute__((aligned(4))) __attribute__((visibility("hidden")))=\n{{\n{array_text(d, dtype, "\t", ",")},\n}};\n\n'
            assert got[s].a == f"\t.section .rodata\n\t.align\t2\n\t.global {s}\n{s}:\n{array_text(d, dtype, f'\t{word} ', '')}\n"
        assert got["n"].c is None and got["n"].a.endswith("n:\n\n") and got[None].c is None and got[None].a is None
    long = spark.range(1).selectExpr("'x' AS symbol", "cast(repeat('abcdefgh', 1 << 20) AS binary) AS data")
    begin = time.monotonic()
    assert long.select(F.length(export.c_array(long.symbol, long.data, "u16")).alias("n")).first().n > 28 << 20
    assert time.monotonic() - begin < 8
