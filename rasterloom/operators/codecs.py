"""Compression of payloads for small devices: header only, run lengths, LZ77 and Huffman, and their inverses.

Streams begin with a tag byte and the payload's size in 24 bits (little-endian), and are padded with zeros to a
multiple of four. Larger payloads have no stream: the functions refuse them, the columns are null. The codecs work on Arrow batches.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import bound_batches, in_batches

#: Fixed values of the formats: tags, limits of runs and literals, window and matches of LZ77, bytes of a Huffman tree.
NONE, LZ77, HUFF4, HUFF8, RLE = 0x00, 0x10, 0x24, 0x28, 0x30
LIMIT = 1 << 24
RUN_LEAST, RUN_MOST, LITERAL_MOST = 3, 130, 128
WINDOW, MATCH_LEAST, MATCH_MOST, DISTANCE_LEAST = 4096, 3, 18, 2
TREE_BYTES = 512
#: Longest code that is decoded by a table, bytes of a stream that are looked up at once, doublings of the steps from code to code.
LOOKED_UP, BLOCK, STRIDE = 20, 1 << 14, 3
#: Lengths whose occurrence bounds the matches of LZ77, and places that are bounded at once: with a window they have 15 bits.
BOUNDS, LZ_BLOCK = (3, 4, 5, 6, 7, 8, 9, 11, 13), (1 << 15) - WINDOW
_RUNS = re.compile(rb"(.)\1{2,129}", re.S)


def _header(tag: int, n: int) -> bytes:
    if n >= LIMIT:
        raise ValueError(f"a payload of {n} bytes does not fit the 24-bit size")
    return bytes([tag]) + n.to_bytes(3, "little")


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 4)


def _body(data: bytes, *tags: int) -> tuple[int, int]:
    if len(data) < 4 or data[0] not in tags:
        raise ValueError("not such a stream")
    return data[0], int.from_bytes(data[1:4], "little")


def store(raw: bytes) -> bytes:
    return _padded(_header(NONE, len(raw)) + raw)


def unstore(data: bytes) -> bytes:
    _, n = _body(data, NONE)
    return data[4 : 4 + n]


def rle_encode(raw: bytes) -> bytes:
    out, at = [_header(RLE, len(raw))], 0

    def literals(end: int) -> None:
        for k in range(at, end, LITERAL_MOST):
            part = raw[k : min(end, k + LITERAL_MOST)]
            out.append(bytes([len(part) - 1]) + part)

    for m in _RUNS.finditer(raw):
        literals(m.start())
        out.append(bytes([0x80 | m.end() - m.start() - RUN_LEAST, raw[m.start()]]))
        at = m.end()
    literals(len(raw))
    return _padded(b"".join(out))


def rle_decode(data: bytes) -> bytes:
    _, n = _body(data, RLE)
    out, at = bytearray(), 4
    while len(out) < n:
        k = data[at]
        if k & 0x80:
            out += data[at + 1 : at + 2] * ((k & 0x7F) + RUN_LEAST)
            at += 2
        else:
            out += data[at + 1 : at + 2 + k]
            at += 2 + k
    return bytes(out)


def _longest(raw: bytes, at: int, most: int) -> tuple[int, int]:
    """Length and place of the longest match in the window, the earliest of equal ones; (0, 0) if there is none. Only searches for longer ones go on."""
    best, where, k = 0, 0, MATCH_LEAST
    if most < k:
        return 0, 0
    p = raw.find(raw[at : at + k], max(0, at - WINDOW), at - DISTANCE_LEAST + k)
    while p >= 0:
        while k < most and raw[p + k] == raw[at + k]:
            k += 1
        best, where = k, p
        if k == most:
            break
        k += 1
        p = raw.find(raw[at : at + k], p + 1, at - DISTANCE_LEAST + k)
    return best, where


def _bounds(raw: bytes) -> bytes:
    """For each place, what no match there is longer than: one less than the shortest of some lengths that the window has no such bytes of. Hashes may only make it more."""
    n, out = len(raw), []
    for begin in range(0, n, LZ_BLOCK):
        first, end = max(0, begin - WINDOW), min(n, begin + LZ_BLOCK)
        b = np.frombuffer(raw, np.uint8, min(n, end + max(BOUNDS)) - first, first).astype(np.int64)
        most, code, k = np.full(end - first, MATCH_MOST, np.uint8), b, 1
        for length in BOUNDS:
            while k < length:
                code = code[:-1] * 0x9E3779B1 + b[k:] if k >= 6 else code[:-1] << 8 | b[k:]
                k += 1
            if not len(code):
                break
            key = code[: end - first] & ((1 << 48) - 1) if length <= 6 else (code[: end - first] * 0x9E3779B97F4A7C1 >> 12) & ((1 << 48) - 1)
            key = np.sort(key << 15 | np.arange(len(key)))
            place = key & 0x7FFF
            none = np.full(len(key), True)
            none[place[1:]] = (key[1:] >> 15 != key[:-1] >> 15) | (place[1:] - place[:-1] > WINDOW)
            most[: len(key)] = np.minimum(most[: len(key)], np.where(none, length - 1, MATCH_MOST))
        out.append(most[begin - first :].tobytes())
    return b"".join(out)


def lz_encode(raw: bytes) -> bytes:
    """Greedy matching over the whole window."""
    out, n, at, bounds = bytearray(_header(LZ77, len(raw))), len(raw), 0, _bounds(raw)
    while at < n:
        flag_at, flags = len(out), 0
        out.append(0)
        for bit in range(7, -1, -1):
            if at >= n:
                break
            best = min(bounds[at], n - at)
            if best < MATCH_LEAST:
                best = 0
            elif (where := raw.find(raw[at : at + best], max(0, at - WINDOW), at - DISTANCE_LEAST + best)) < 0:
                best, where = _longest(raw, at, best - 1)
            if best:
                d = at - where - 1
                out.append((best - MATCH_LEAST) << 4 | d >> 8)
                out.append(d & 255)
                flags |= 1 << bit
                at += best
            else:
                out.append(raw[at])
                at += 1
        out[flag_at] = flags
    return _padded(bytes(out))


def lz_tokens(data: bytes) -> Iterator[tuple[int, int]]:
    """(0, byte) for literals, (length, distance) for matches."""
    _, n = _body(data, LZ77)
    at, made = 4, 0
    while made < n:
        flags = data[at]
        at += 1
        for bit in range(7, -1, -1):
            if made >= n:
                break
            if flags >> bit & 1:
                length, d = (data[at] >> 4) + MATCH_LEAST, ((data[at] & 15) << 8 | data[at + 1]) + 1
                yield length, d
                at, made = at + 2, made + length
            else:
                yield 0, data[at]
                at, made = at + 1, made + 1


def lz_decode(data: bytes) -> bytes:
    _, n = _body(data, LZ77)
    out, at = bytearray(), 4
    while len(out) < n:
        flags = data[at]
        at += 1
        if not flags:
            out += data[at : at + min(8, n - len(out))]
            at += 8
            continue
        for bit in (128, 64, 32, 16, 8, 4, 2, 1):
            if not flags & bit:
                out.append(data[at])
                at += 1
            else:
                length, d = (data[at] >> 4) + MATCH_LEAST, ((data[at] & 15) << 8 | data[at + 1]) + 1
                part = out[-d : len(out) - d + length]
                out += part if d >= length else (part * (length // d + 1))[:length]
                at += 2
            if len(out) >= n:
                break
    return bytes(out)


def _tree(counts: dict[int, int]) -> tuple:
    """Nested pairs; ties by the order of creation, after the symbols by value."""
    heap = [(n, k, v) for k, (v, n) in enumerate(sorted(counts.items()))]
    heapq.heapify(heap)
    if len(heap) == 1:
        heap.append((0, 1, heap[0][2]))
    k = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], k, (a[2], b[2])))
        k += 1
    return heap[0][2]


def _laid_out(tree: tuple) -> bytes | None:
    """The tree's bytes from the root on: a node tells (6 bits) how far its pair of children is, and which are leaves.

    Pairs are placed in turn; the pair whose node is the oldest goes first once it is close to out of reach, else the
    smallest subtree, which keeps few pairs waiting. None if an offset gets too large.
    """
    sizes: dict[int, int] = {}

    def size(t) -> int:
        if not isinstance(t, tuple):
            return 0
        sizes[id(t)] = n = 1 + size(t[0]) + size(t[1])
        return n

    out: list[int] = [0]
    waiting = [(0, tree, size(tree))]  # by place, as later ones are added
    while waiting:
        pairs = len(out) // 2  # number of the next pair
        reach = [64 - (pairs - w[0] // 2 - (w[0] % 2)) for w in waiting]
        urgent = next((k for k, r in enumerate(reach) if r <= len(waiting) + 1), None)
        k = urgent if urgent is not None else min(range(len(waiting)), key=lambda k: (waiting[k][2], waiting[k][0]))
        at, node, _ = waiting.pop(k)
        first = len(out) + (len(out) + 1) % 2 if at else 1
        offset = (first + 1 - (((at + 1) & ~1) + 2)) // 2
        if not 0 <= offset < 64:
            return None
        out[at] = offset | (0 if isinstance(node[0], tuple) else 0x80) | (0 if isinstance(node[1], tuple) else 0x40)
        for side in node:
            if isinstance(side, tuple):
                waiting.append((len(out), side, sizes[id(side)]))
                out.append(0)
            else:
                out.append(side)
    return bytes(out)


def _nibbles(raw: bytes) -> bytes:
    """The lower half of each byte, then the upper one."""
    b = np.frombuffer(raw, np.uint8)
    return np.stack([b & 15, b >> 4], axis=1).tobytes()


def _codes(tree: tuple) -> dict[int, str]:
    codes: dict[int, str] = {}
    stack = [(tree, "")]
    while stack:
        t, code = stack.pop()
        if isinstance(t, tuple):
            stack += [(t[0], code + "0"), (t[1], code + "1")]
        else:
            codes.setdefault(t, code)
    return codes


def huffman_encode(raw: bytes) -> bytes:
    """Symbols of 4 or of 8 bits: the shorter stream, the latter if both are as long. Only that one is made."""
    head = _header(HUFF8, len(raw))
    if not raw:
        return _padded(head + b"\xff" + bytes(TREE_BYTES - 1))
    values = np.frombuffer(raw, np.uint8)
    eight = sum(np.bincount(values[k : k + BLOCK], minlength=256) for k in range(0, len(raw), BLOCK)).reshape(16, 16)
    found = []
    for tag, each in ((HUFF8, eight.ravel()), (HUFF4, eight.sum(0) + eight.sum(1))):
        counts = {v: n for v, n in enumerate(each.tolist()) if n}
        codes = _codes(tree := _tree(counts))
        found.append((-(-sum(n * len(codes[v]) for v, n in counts.items()) // 32), -tag, tree, codes))
    for _, tag, tree, codes in sorted(found, key=lambda f: f[:2]):
        laid = _laid_out(tree)
        if laid is not None and len(laid) < TREE_BYTES:
            break
    else:
        raise ValueError("no tree of these symbols can be laid out")
    words, text = [], ""
    for begin in range(0, len(raw), BLOCK):  # some bytes at a time: a bit takes a byte here
        part = raw[begin : begin + BLOCK]
        text += "".join(map(codes.__getitem__, part if tag == -HUFF8 else _nibbles(part)))
        if begin + BLOCK >= len(raw):
            text += "0" * (-len(text) % 32)
        whole = len(text) // 32 * 32
        if whole:
            words.append(np.frombuffer(int(text[:whole], 2).to_bytes(whole // 8, "big"), ">u4").astype("<u4").tobytes())
        text = text[whole:]
    return bytes([-tag]) + head[1:] + b"\xff" + laid + bytes(TREE_BYTES - 1 - len(laid)) + b"".join(words)


def _leaves(tree: bytes) -> list[tuple[int, int]]:
    """Symbol and code length of the leaves, from the code of zeros to that of ones."""
    out, stack = [], [(0, 0)]
    while stack:
        node, depth = stack.pop()
        if node < 0:
            out.append((tree[-node], depth))
            continue
        first = ((node + 1) & ~1) + 2 * (tree[node] & 63) + 1
        stack += [(-first - 1 if tree[node] & 0x40 else first + 1, depth + 1), (-first if tree[node] & 0x80 else first, depth + 1)]
    return out


def _symbols(tree: bytes, body: bytes, need: int) -> bytes:
    """Bit by bit."""
    out, node = bytearray(), 0
    for k in range(0, len(body), 4):
        word = int.from_bytes(body[k : k + 4], "little")
        for bit in range(31, -1, -1):
            if len(out) == need:
                break
            side = word >> bit & 1
            child = ((node + 1) & ~1) + 2 * (tree[node] & 63) + 1 + side
            if tree[node] & (0x40 if side else 0x80):
                out.append(tree[child])
                node = 0
            else:
                node = child
    return bytes(out)


def _followed(steps: np.ndarray, at: int, most: int) -> tuple[np.ndarray, int]:
    """The places from one on, each as far from the last as its step tells, at most so many; and where the next one is beyond the end.

    Every 2**STRIDE-th place is followed alone, over steps that are put together, and those between come from it at once.
    """
    end = len(steps)
    after = [np.arange(end + LOOKED_UP + 1)]
    after[0][:end] += steps  # what is beyond stays there
    for _ in range(STRIDE):
        after.append(after[-1].take(after[-1]))
    jump, first = memoryview(after[-1]), []
    for _ in range(-(-most >> STRIDE) if most > 0 else 0):
        if at >= end:
            break
        first.append(at)
        at = jump[at]
    places = np.array(first, np.int64)
    for a in reversed(after[:-1]):
        places = np.stack([places, a.take(places)], axis=1).ravel()
    return places[places < end][:most], at - end


def huffman_decode(data: bytes) -> bytes:
    """What starts at each bit is looked up for all bits at once, then followed from code to code."""
    tag, n = _body(data, HUFF4, HUFF8)
    if not n:
        return b""
    tree, body = data[5 : 4 + 2 * (data[4] + 1)], data[4 + 2 * (data[4] + 1) :]
    bits, leaves = tag & 15, _leaves(tree)
    need, longest = n * 8 // bits, max(depth for _, depth in leaves)
    if longest > LOOKED_UP:
        out = _symbols(tree, body, need)
    else:
        symbol, depth = (np.array(x, np.uint8) for x in zip(*leaves, strict=True))
        span = 1 << (longest - depth.astype(np.int64))
        symbols, depths = np.repeat(symbol, span), np.repeat(depth, span)
        parts, at, left = [], 0, need
        stream = np.frombuffer(body[: len(body) // 4 * 4], "<u4").astype(">u4").tobytes() + bytes(4)
        shifts = (32 - longest - np.arange(8)).astype(np.uint32)[:, None]
        for begin in range(0, len(stream) - 4, BLOCK):  # some bytes at a time: a bit takes some 60 bytes here
            b = np.frombuffer(stream[begin : begin + BLOCK + 4], np.uint8).astype(np.uint32)
            four = b[:-4] << 24 | b[1:-3] << 16 | b[2:-2] << 8 | b[3:-1]
            code = (four >> shifts & np.uint32((1 << longest) - 1)).T.astype(np.int64, order="C").ravel()
            places, at = _followed(depths.take(code), at, left)
            parts.append(symbols.take(code.take(places)).tobytes())
            left -= len(places)
            if not left:
                break
        out = b"".join(parts)
    if bits == 8:
        return out
    b = np.frombuffer(out, np.uint8)
    return (b[::2] | b[1::2] << 4).tobytes()


CODECS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {"store": (store, unstore), "rle": (rle_encode, rle_decode), "lz77": (lz_encode, lz_decode), "huffman": (huffman_encode, huffman_decode)}
_BY_TAG = {NONE: unstore, LZ77: lz_decode, HUFF4: huffman_decode, HUFF8: huffman_decode, RLE: rle_decode}


def decode_any(data: bytes) -> bytes:
    """By the stream's tag."""
    return _BY_TAG[data[0]](data)


def _each(f: Callable[[bytes], bytes], limit: int | None = None):
    def made(parts: Iterator[pa.Array]):
        for x in parts:
            for v in x:
                raw = v.as_py()
                out = None if raw is None or limit and len(raw) >= limit else f(raw)
                yield len(out or b""), out

    @F.arrow_udf("binary")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from in_batches(made(parts), lambda rows: pa.array(rows, pa.binary()))

    return run


def encode(data: Column, codec: str) -> Column:
    """The stream of each payload, null for one of 16 MiB or more; header only is a plain column expression."""
    if codec == "store":
        n = F.octet_length(data)
        size = F.lpad(F.hex(n), 6, "0")
        head = F.unhex(F.concat(F.lit("00"), F.substring(size, 5, 2), F.substring(size, 3, 2), F.substring(size, 1, 2)))
        return F.when(n < LIMIT, F.concat(head, data, F.unhex(F.repeat(F.lit("00"), (F.pmod(-n, F.lit(4))).cast("int")))))
    return _each(CODECS[codec][0], LIMIT)(data)


def decode(data: Column) -> Column:
    return _each(decode_any)(data)


def roundtrip(df: DataFrame, key: str, text: str, codec: str) -> DataFrame:
    """key, raw_size, packed_size, decoded: each text encoded and decoded again."""
    bound_batches(df.sparkSession)
    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    packed = rows.select(key, F.octet_length("raw").cast("long").alias("raw_size"), encode(F.col("raw"), codec).alias("packed"))
    return packed.select(key, "raw_size", F.octet_length("packed").cast("long").alias("packed_size"), decode(F.col("packed")).alias("decoded"))
