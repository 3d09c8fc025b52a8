"""The Ogg container: pages with checksums and lacing values, packets, logical streams, granule positions (RFC 3533)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

CAPTURE, HEADER = b"OggS", struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
#: Lacing values a page can hold, and the granule position of a page on which no packet ends.
MAX_LACING, NO_GRANULE = 255, -1
_REVERSED = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


def checksum(data: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, from 0: zlib's over reversed bits."""
    c = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "big").translate(_REVERSED), "little")


@dataclass
class Page:
    flags: int
    granule: int
    serial: int
    sequence: int
    lacing: bytes
    body: bytes
    valid: bool = True

    def encode(self) -> bytes:
        head = HEADER.pack(CAPTURE, 0, self.flags, self.granule, self.serial, self.sequence, 0, len(self.lacing))
        data = head + self.lacing + self.body
        return data[:22] + checksum(data).to_bytes(4, "little") + data[26:]


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a physical stream. Bytes between pages are skipped; a page with a wrong checksum is marked; a truncated one ends the stream."""
    at = data.find(CAPTURE)
    while 0 <= at <= len(data) - HEADER.size:
        _, version, flags, granule, serial, sequence, crc, n = HEADER.unpack_from(data, at)
        begin = at + HEADER.size + n
        lacing = data[at + HEADER.size : begin]
        end = begin + sum(lacing)
        whole = len(lacing) == n and end <= len(data)
        good = whole and version == 0 and checksum(data[at : at + 22] + bytes(4) + data[at + 26 : end]) == crc
        if whole:
            yield Page(flags, granule, serial, sequence, lacing, data[begin:end], good)
        # Lengths of a damaged page can't be trusted: look for the next capture pattern inside it.
        at = data.find(CAPTURE, end if good else at + 1)


def paginate(serial: int, packets: list[bytes], granules: list[int], lacing_per_page: int = MAX_LACING) -> list[Page]:
    """A logical stream. granules: the position after each packet. The first packet, a header, has a page of its own."""
    out: list[Page] = []
    lacing, body, granule, begun = bytearray(), [], NO_GRANULE, False

    def flush(carry: bool):
        nonlocal lacing, body, granule, begun
        out.append(Page((CONTINUED if begun else 0) | (0 if out else FIRST), granule, serial, len(out), bytes(lacing), b"".join(body)))
        lacing, body, granule, begun = bytearray(), [], NO_GRANULE, carry

    for k, (p, g) in enumerate(zip(packets, granules, strict=True)):
        values = [255] * (len(p) // 255) + [len(p) % 255]
        at = 0
        while values:
            take, values = values[: lacing_per_page - len(lacing)], values[lacing_per_page - len(lacing) :]
            lacing += bytes(take)
            body.append(p[at : at + sum(take)])
            at += sum(take)
            if not values:
                granule = g
            if len(lacing) == lacing_per_page:
                flush(bool(values))
        if k == 0 and lacing:
            flush(False)
    if lacing:
        flush(False)
    if out:
        out[-1].flags |= LAST
    return out


def multiplex(streams: list[list[Page]]) -> bytes:
    """The streams' first pages, then the others in turn."""
    first = [s[0] for s in streams if s]
    rest = sorted(((k, i) for i, s in enumerate(streams) for k in range(1, len(s))))
    return b"".join(p.encode() for p in first) + b"".join(streams[i][k].encode() for k, i in rest)


@dataclass
class Packet:
    data: bytes
    page: int
    #: Position after the packet if it is the last that ends on its page, else None.
    granule: int | None = None


@dataclass
class Stream:
    serial: int
    packets: list[Packet] = field(default_factory=list)
    pages: int = 0
    #: Pages lost: wrong checksums and gaps in the page numbers.
    lost: int = 0
    ended: bool = False

    def times(self) -> list[tuple[int, int]]:
        """First and last position of each packet after the header, for streams with one position a byte: pages tell the end of their last packet, lengths the others'."""
        out: list[tuple[int, int]] = []
        end: int | None = None
        for p in reversed(self.packets[1:]):
            end = p.granule if p.granule is not None else end
            begin = None if end is None else end - len(p.data)
            out.append((begin, end))
            end = begin
        return out[::-1]


def demultiplex(data: bytes) -> dict[int, Stream]:
    """The logical streams by serial number. A packet of which a page is missing or damaged is left out."""
    streams: dict[int, Stream] = {}
    open_: dict[int, list[bytes] | None] = {}
    expected: dict[int, int] = {}
    broken: dict[int, int] = {}  # damaged pages since the last good one
    for p in pages(data):
        s = streams.setdefault(p.serial, Stream(p.serial)) if p.valid else streams.get(p.serial)
        if not p.valid:
            if s:
                s.lost += 1
                broken[p.serial] = broken.get(p.serial, 0) + 1
                open_[p.serial] = None
            continue
        s.pages += 1
        s.ended |= bool(p.flags & LAST)
        parts = open_.pop(p.serial, None) if p.flags & CONTINUED else None
        if p.sequence != expected.get(p.serial, p.sequence):
            s.lost += max(0, p.sequence - expected[p.serial] - broken.get(p.serial, 0))
            parts = None
        broken.pop(p.serial, None)
        skipping = bool(p.flags & CONTINUED) and parts is None
        parts = parts or []
        expected[p.serial] = p.sequence + 1
        at, ended = 0, None
        for n in p.lacing:
            parts.append(p.body[at : at + n])
            at += n
            if n < 255:
                if not skipping:
                    ended = Packet(b"".join(parts), p.sequence)
                    s.packets.append(ended)
                parts, skipping = [], False
        if ended and p.granule != NO_GRANULE:
            ended.granule = p.granule
        if parts and not skipping:
            open_[p.serial] = parts
    return streams
