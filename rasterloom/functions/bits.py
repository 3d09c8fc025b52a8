"""Bit fields, alignment, range folding, and byte order, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f) -> Column:
    """f(value), with value evaluated once however often f reads it, also inside lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def field(v: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(v, shift).bitwiseAND(F.lit((1 << width) - 1))


def with_field(v: Column, x: Column, shift: int, width: int) -> Column:
    mask = (1 << width) - 1
    return v.bitwiseAND(F.lit(~(mask << shift))).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask)), shift))


def align(v: Column, to: int) -> Column:
    """Rounded up to a multiple."""
    return (F.floor((v + (to - 1)) / to) * to).cast("long")


def is_power_of_two(v: Column) -> Column:
    return (v > 0) & (v.bitwiseAND(v - 1) == 0)


def next_power_of_two(v: Column) -> Column:
    """Rounded up; 1 for 1 and less."""
    x = F.greatest(v - 1, F.lit(0)).cast("long")
    for k in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseOR(F.shiftrightunsigned(x, k))
    return x + 1


def clamp(v: Column, lo: int, hi: int) -> Column:
    """Into [lo, hi)."""
    return F.greatest(F.lit(lo), F.least(v, F.lit(hi - 1)))


def reflect(v: Column, lo: int, hi: int) -> Column:
    """Mirrored at the rims of [lo, hi), once."""
    return F.when(v >= hi, 2 * (hi - 1) - v).when(v < lo, 2 * lo - v).otherwise(v)


def wrap(v: Column, lo: int, hi: int) -> Column:
    """Moved by one length of [lo, hi)."""
    return F.when(v >= hi, v - (hi - lo)).when(v < lo, v + (hi - lo)).otherwise(v)


def swap16(v: Column) -> Column:
    return F.shiftleft(v.bitwiseAND(F.lit(0xFF)), 8).bitwiseOR(F.shiftright(v, 8).bitwiseAND(F.lit(0xFF)))


def little_endian(v: Column, size: int) -> Column:
    """The low bytes of an integer, least first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(field(v.cast("long"), 8 * k, 8)), 2, "0") for k in range(size)]))


def byte_values(data: Column) -> Column:
    """A binary column as an array of integers."""
    h = F.hex(data)
    return F.when(F.length(h) > 0, F.transform(F.sequence(F.lit(0), F.octet_length(data) - 1), lambda k: F.conv(F.substr(h, 2 * k + 1, F.lit(2)), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))


def byte_reverse(h: Column, chunk: int) -> Column:
    """Hex text with the bytes of each whole chunk in reverse order."""
    groups = "".join("(..)" for _ in range(chunk))
    return F.regexp_replace(h, groups, "".join(f"${k}" for k in range(chunk, 0, -1)))


def pack(values: Column, bits: int) -> Column:
    """Fields of an array into one integer, first lowest. An error, if they need over 64 bits."""
    word = F.aggregate(F.transform(values, lambda v, k: F.call_function("shiftleft", v.cast("long").bitwiseAND(F.lit((1 << bits) - 1)), (k * bits).cast("int"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(values) > 64 // bits, F.raise_error(F.lit(f"more than {64 // bits} fields of {bits} bits in a word")).cast("long")).otherwise(word)


def pack_words(values: Column, bits: int, n: int) -> Column:
    """All fields of an array into an array of integers, n fields each (the last may have fewer)."""
    words = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / n).cast("int")), lambda w: pack(F.slice(values, w * n + 1, F.lit(n)), bits))
    return F.when(F.size(values) > 0, words).when(F.size(values) == 0, F.array().cast("array<bigint>"))


def unpack(v: Column, bits: int, n: int) -> Column:
    """The inverse of pack."""
    return F.array(*[field(v, k * bits, bits) for k in range(n)])


def add_base(values: Column, base: int, zero_too: bool = False) -> Column:
    """base on fields that were widened; zeros stay zero unless asked for."""
    return F.transform(values, lambda v: F.when((v != 0) | F.lit(zero_too), v + base).otherwise(v))


def less_base(values: Column, bits: int, base: int, zero_too: bool = False) -> Column:
    """base off fields that are to be narrowed to so many bits, which wrap; zeros stay zero unless asked for."""
    return F.transform(values, lambda v: F.when((v != 0) | F.lit(zero_too), v - base).otherwise(v).bitwiseAND(F.lit((1 << bits) - 1)))


def byte_fields(values: Column, bits: int, high_first: bool = False) -> Column:
    """The fields of each byte of an array, lowest first or highest first."""
    places = range(8 - bits, -1, -bits) if high_first else range(0, 8, bits)
    return F.flatten(F.transform(values, lambda v: F.array(*[field(v, k, bits) for k in places])))


def pack_bytes(values: Column, bits: int, high_first: bool = False) -> Column:
    """An array of fields as an array of bytes, the first field lowest or highest; the last byte is filled with zeros."""
    n = 8 // bits
    mask = F.lit((1 << bits) - 1)
    at = lambda v, k: F.shiftleft(F.coalesce(v.bitwiseAND(mask), F.lit(0)), 8 - bits - k * bits if high_first else k * bits)

    def byte(w: Column) -> Column:
        out = at(F.get(values, w * n), 0)
        for k in range(1, n):
            out = out.bitwiseOR(at(F.get(values, w * n + k), k))
        return out

    found = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / n).cast("int")), byte)
    return F.when(F.size(values) > 0, found).when(F.size(values) == 0, F.slice(values, 1, 0))


def bit_reverse(values: Column, bits: int) -> Column:
    """Each byte of an array with its chunks of so many bits in reverse order."""

    def turned(v: Column) -> Column:
        out = F.shiftleft(field(v, 0, bits), 8 - bits)
        for k in range(bits, 8, bits):
            out = out.bitwiseOR(F.shiftleft(field(v, k, bits), 8 - bits - k))
        return out

    return F.transform(values, turned)


def replaced(values: Column, old: list[int], new: list[int]) -> Column:
    """Each value that stands in old as the one at its place in new; where old repeats a value, the first counts."""
    first = {a: b for a, b in reversed(list(zip(old, new, strict=True)))}
    known = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    return F.transform(values, lambda v: F.coalesce(F.try_element_at(known, v), v))


def swap_index(values: Column, k: int) -> Column:
    """Pixels with index 0 and index k exchanged, to go with a palette whose entries are."""
    return F.transform(values, lambda v: F.when(v == 0, F.lit(k)).when(v == k, F.lit(0)).otherwise(v))


def texture_alpha(index: Column, alpha: Column | None, alpha_bits: int) -> Column:
    """Texture pixels: the high bits of alpha above the bits of the index; opaque without alpha."""
    low = 8 - alpha_bits
    top = F.lit(255 >> low << low) if alpha is None else F.shiftleft(F.shiftright(alpha, low), low)
    return index.bitwiseOR(top)
