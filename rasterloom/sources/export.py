"""Artifacts (symbol, item, dtype, data) as C and assembler arrays, headers, archives and chunk files.

The text of an array is made in Python, from Arrow batches; so are archives and chunk files, one a group.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import in_batches

#: Fixed by the formats: suffixes of items, bytes and row lengths of element types.
SUFFIX = {"gfx": "Tiles", "map": "Map", "meta": "Meta", "pal": "Pal"}
ELEMENT = {"u8": (1, 16, "unsigned char", ".byte"), "u16": (2, 8, "unsigned short", ".hword"), "u32": (4, 8, "unsigned int", ".word")}


def _rows(data: bytes, dtype: str, lead: str, end: str) -> str:
    """The little-endian elements of some bytes in rows, the last element filled up with zeros; a blank line after every eight rows."""
    size, per, _, _ = ELEMENT[dtype]
    if not data:
        return ""
    data += bytes(-len(data) % size)
    big = np.frombuffer(data, f"<u{size}").byteswap().tobytes()
    text = "0x" + big.hex(",", size).upper().replace(",", ",0x")
    wide = per * (2 * size + 3)
    rows = [text[k : k + wide - 1] for k in range(0, len(text), wide)]
    between = f"{end}\n{lead}"
    blocks = [between.join(rows[k : k + 8]) for k in range(0, len(rows), 8)]
    return lead + f"{end}\n\n{lead}".join(blocks) + ("\n" if len(rows) % 8 == 0 else "")


def _text(make):
    """make(symbol, data) as a column function, null without a symbol; data may be None."""

    def made(parts: Iterator[tuple[pa.Array, pa.Array]]):
        for symbols, data in parts:
            for s, d in zip(symbols, data, strict=True):
                text = make(s.as_py(), d.as_py()) if s.is_valid else None
                yield len(text or ""), text

    @F.arrow_udf("string")
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from in_batches(made(parts), lambda rows: pa.array(rows, pa.string()))

    return run


def c_array(symbol: Column, data: Column, dtype: str = "u8") -> Column:
    """A definition whose length is that of the data up to a multiple of four bytes."""
    size, _, kind, _ = ELEMENT[dtype]
    make = lambda s, d: d if d is None else f'const {kind} {s}[{(len(d) + 3) // 4 * 4 // size}] __attribute__((aligned(4))) __attribute__((visibility("hidden")))=\n{{\n{_rows(d, dtype, "\t", ",")},\n}};\n\n'
    return _text(make)(symbol, data)


def asm_array(symbol: Column, data: Column, dtype: str = "u8") -> Column:
    word = ELEMENT[dtype][3]
    make = lambda s, d: f"\t.section .rodata\n\t.align\t2\n\t.global {s}\n{s}:\n{_rows(d or b'', dtype, f'\t{word} ', '')}\n"
    return _text(make)(symbol, data)


def c_header(symbol: Column, data: Column, dtype: str = "u8") -> Column:
    size, _, kind, _ = ELEMENT[dtype]
    n = F.octet_length(data)
    return F.concat(F.lit("#define "), symbol, F.lit("Len "), n.cast("string"), F.lit(f"\nextern const {kind} "), symbol, F.lit("["), F.ceil(n / size).cast("string"), F.lit("];\n"))


def sizes(artifacts: DataFrame, riff: bool = False) -> DataFrame:
    """symbol, size: bytes of each symbol's items, each up to a multiple of four; with the chunk headers of a chunk file."""
    each = F.floor((F.octet_length("data") + 3) / 4) * 4 + (8 if riff else 0)
    return artifacts.groupBy("symbol").agg((F.sum(each) + (20 if riff else 0)).cast("long").alias("size"))


def upsert(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """Entries of new, and of old those that new has no namesake of."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def entry_name(symbol: Column, suffix: str) -> Column:
    """An archive's name: 21 characters of the symbol, the suffix, 24 in all."""
    return F.substring(F.concat(F.substring(symbol, 1, 21), F.lit(suffix)), 1, 24)


def archive(entries: list[tuple[str, bytes]]) -> bytes:
    """A flat archive: header, directory by name, data at multiples of 16 with lengths up to multiples of four."""
    entries = sorted((n.encode()[:24], d + bytes(-len(d) % 4)) for n, d in entries)
    at = 32 + 32 * len(entries)
    directory, body = b"", b""
    for name, data in entries:
        directory += struct.pack("<24sII", name, len(data), at + len(body))
        body += data + bytes(-len(data) % 16)
    head = struct.pack("<16sIHH8x", b"PinEightGBFS\r\n\x1a\n", at + len(body), 32, len(entries))
    return head + directory + body


def read_archive(data: bytes) -> list[tuple[str, bytes]]:
    _, _, at, n = struct.unpack_from("<16sIHH", data)
    found = [struct.unpack_from("<24sII", data, at + 32 * k) for k in range(n)]
    return [(name.rstrip(b"\0").decode(), data[o : o + size]) for name, size, o in found]


def chunks(items: dict[str, bytes]) -> bytes:
    """A RIFF file of named chunks, each padded to a multiple of four."""
    body = b"".join(struct.pack("<4sI", k.encode().ljust(4), len(v)) + v + bytes(-len(v) % 4) for k, v in items.items())
    return struct.pack("<4sI4s", b"RIFF", len(body) + 4, b"GRF ") + body


def archives(entries: DataFrame, by: str) -> DataFrame:
    """An archive for each group of (by, name, data). What a group holds is bounded by the format's 32-bit size."""

    def build(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: [g[by].iloc[0]], "archive": [archive([(n, bytes(d)) for n, d in zip(g["name"], g["data"], strict=True)])]})

    return entries.groupBy(by).applyInPandas(build, f"{by} {entries.schema[by].dataType.simpleString()}, archive binary")


def array_from_source(text: str, symbol: str) -> bytes:
    """The bytes of an array in generated C or assembler source."""
    at = re.search(rf"\b{re.escape(symbol)}(?:\[\d*\][^{{]*\{{|:)", text)
    if not at:
        raise KeyError(symbol)
    out, size = bytearray(), {"char": 1, "short": 2, "int": 4}.get((re.search(r"unsigned (char|short|int) $", text[: at.start()]) or [0, ""])[1], 0)
    for line in text[at.end() :].split("\n"):
        if re.search(r"\}|\.global|\.section", line):
            break
        if m := re.match(r"\s*\.(byte|hword|word)\b", line):
            size = {"byte": 1, "hword": 2, "word": 4}[m[1]]
        for v in re.findall(r"0x([0-9A-Fa-f]+)", line):
            out += int(v, 16).to_bytes(size, "little")
    return bytes(out)
