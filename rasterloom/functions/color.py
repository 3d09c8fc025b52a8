"""Colours as integer columns: 15-bit device colours (blue high, red low), 24-bit channels, distances. All in whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed by the hardware: the opaque bit of a 16-bit colour, and the squared distance from which two colours differ.
ALPHA, DIFFER = 0x8000, 576


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int")


def to5(v: Column) -> Column:
    """8-bit channel to 5 bits, truncated."""
    return F.shiftright(v.cast("int"), 3)


def to8(v: Column) -> Column:
    """5-bit channel to the full 8-bit range, truncated."""
    return _div(v.cast("int") * 255, 31)


def rgb555(r: Column, g: Column, b: Column) -> Column:
    """Device colour: red in the low bits."""
    return to5(r).bitwiseOR(F.shiftleft(to5(g), 5)).bitwiseOR(F.shiftleft(to5(b), 10))


def channels(c: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue (5 bits each) of a device colour."""
    low = lambda x: x.bitwiseAND(F.lit(31))
    return low(c), low(F.shiftright(c, 5)), low(F.shiftright(c, 10))


def swap_rb16(c: Column) -> Column:
    """Red and blue change places; green and the top bit stay."""
    r, _, b = channels(c)
    return c.bitwiseAND(F.lit(0x83E0)).bitwiseOR(F.shiftleft(r, 10)).bitwiseOR(b)


def swap_rb24(c: Column) -> Column:
    return F.shiftleft(c.bitwiseAND(F.lit(255)), 16).bitwiseOR(c.bitwiseAND(F.lit(0xFF00))).bitwiseOR(F.shiftright(c, 16).bitwiseAND(F.lit(255)))


def distance2(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a[1:], b[1:], strict=True)), (a[0] - b[0]) * (a[0] - b[0]))


def with_alpha(c: Column, mode: str = "all", clear: int | None = None) -> Column:
    """The opaque bit on no colour, all, or all but the colour `clear`."""
    if mode == "none":
        return c
    on = c.bitwiseOR(F.lit(ALPHA))
    return on if mode == "all" else F.when(c == clear, c).otherwise(on)


def parse_hex(s: Column) -> Column:
    """24-bit RRGGBB of a hex string with or without 0x: up to 4 digits are a device colour, more are RRGGBB."""
    digits = F.regexp_replace(s, "^0[xX]", "")
    n = F.conv(digits, 16, 10).cast("int")
    r, g, b = (to8(x) for x in channels(n))
    return F.when(F.length(digits) <= 4, F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)).otherwise(n.bitwiseAND(F.lit(0xFFFFFF)))


def adjust(v: Column, op: str, by: float = 0.0) -> Column:
    """8-bit channel inverted, brighter by `by`, of contrast or intensity times `by`, or with gamma `by`; clamped. The formulas are this package's own."""
    x = v.cast("double")
    out = {"invert": 255 - x, "brightness": x + by, "contrast": (x - 128) * by + 128, "intensity": x * by, "gamma": 255 * F.pow(x / 255, F.lit(1 / by if by else 1.0))}[op]
    return F.greatest(F.lit(0), F.least(F.lit(255), F.round(out).cast("int")))


def true_color(c: Column, depth: int, to: int) -> Column:
    """A pixel of 16 (red high), 24 or 32 bits (alpha, red, green, blue) in another depth. Opaque where alpha is new; of equal depths, unchanged."""
    c = c.cast("long")
    if depth == to:
        return c
    part = lambda at, bits: F.shiftright(c, at).bitwiseAND(F.lit((1 << bits) - 1))
    if to == 16:
        return F.shiftleft(part(19, 5), 10).bitwiseOR(F.shiftleft(part(11, 5), 5)).bitwiseOR(part(3, 5))
    r, g, b = (to8(part(at, 5)).cast("long") for at in (10, 5, 0)) if depth == 16 else (part(at, 8) for at in (16, 8, 0))
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b).bitwiseOR(F.lit(0xFF000000 if to == 32 else 0))
