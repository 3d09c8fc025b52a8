"""BagMinHash: signatures whose registers agree with the probability of the weighted Jaccard similarity.

For each element a Poisson process runs over weights and time: a register keeps the earliest point that it gets from
the region below the element's weight. Weights are discretised to whole numbers. The region is cut into dyadic
intervals [0, 1), [1, 2), [2, 4), ..., each with a process of its own; the interval that holds the weight is split
further by the bits of its points' levels. Points come in order of time, and an element is done when its next point is
later than all registers of its text: few elements of a long text get a second point.
"""

from __future__ import annotations

import numpy as np

from .segments import U, mix, prefix, run_hash, word_units

#: Words of a shingle.
SHINGLE = 5
GOLDEN = U(0x9E3779B97F4A7C15)


def shingles(data: bytes, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of runs of n words (of all words, if there are fewer), and their numbers."""
    u = word_units(data)
    if not len(u):
        return np.zeros(0, U), np.zeros(0, np.int64)
    n = min(n, len(u))
    at = np.arange(len(u) - n + 1)
    return np.unique(mix(run_hash(prefix(u), at, at + n) + U(n)), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sizes of the intersection and the union of two multisets."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    both = int(np.minimum(a[1][at[same]], b[1][same]).sum())
    return both, int(a[1].sum() + b[1].sum()) - both


def difference(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """What b has more or less than a, each copy with a number of its own: two such differences from a share what their texts share."""
    h = np.union1d(a[0], b[0])
    n = np.zeros(len(h), np.int64)
    n[np.searchsorted(h, b[0])] += b[1]
    n[np.searchsorted(h, a[0])] -= a[1]
    h, n = h[n != 0], n[n != 0]
    part = mix(h ^ np.where(n > 0, GOLDEN, U(1)))
    k = np.abs(n)
    nth = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    return (np.repeat(part, k) + nth.astype(U) * GOLDEN).view(np.int64)


def packed(sig: np.ndarray, slots: int = 7) -> np.ndarray:
    """A byte of each register, so many in a long."""
    n, m = sig.shape
    longs = -(-m // slots)
    b = np.zeros((n, longs * slots), U)
    b[:, :m] = mix(sig.view(U) + U(1)) >> U(56)
    out = np.zeros((n, longs), U)
    for k in range(slots):
        out = out << U(8) | b[:, k::slots]
    return out.view(np.int64)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """A row of m registers for each multiset (times as integers; those of an empty one are all alike)."""
    reg = np.full(len(bags) * m, np.inf)
    sizes = np.array([len(h) for h, _ in bags])
    doc = np.repeat(np.arange(len(bags)), sizes)
    if not len(doc):
        return reg.reshape(-1, m).view(np.int64)
    h, w = np.concatenate([x for x, _ in bags]), np.concatenate([x for _, x in bags])
    top = np.full(len(bags), np.inf)
    low = 0
    while len(doc):  # an interval of weights after the other: [0, 1), [1, 2), [2, 4), ...
        width = max(1, low)
        _run(reg, top, m, doc, mix(h ^ mix(np.full(1, low, U) + GOLDEN)), w, low, width)
        low += width
        more = w > low
        doc, h, w = doc[more], h[more], w[more]
    return reg.reshape(-1, m).view(np.int64)


def _uniform(bits: np.ndarray) -> np.ndarray:
    return (bits >> U(11)) * 2.0**-53


def _run(reg: np.ndarray, top: np.ndarray, m: int, doc: np.ndarray, seed: np.ndarray, w: np.ndarray, low: int, width: int) -> None:
    """The points of the processes of [low, low + width), all elements a point at a time."""
    x = np.zeros(len(doc))
    wave = 0
    while len(doc):
        wave += 1
        bits = mix(seed + np.full(1, wave, U) * GOLDEN)
        x = x - np.log1p(-_uniform(bits)) / width
        early = x <= top[doc]
        doc, seed, w, x, bits = doc[early], seed[early], w[early], x[early], bits[early]
        place = mix(bits, 0xC2B2AE3D27D4EB4F)
        level = low + (_uniform(mix(place, 0x165667B19E3779F9)) * width).astype(np.int64)
        below = level < w
        np.minimum.at(reg, doc[below] * m + (place[below] % U(m)).astype(np.int64), x[below])
        touched = np.unique(doc)
        top[touched] = reg.reshape(-1, m)[touched].max(axis=1)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band of `rows` registers."""
    n, m = sig.shape
    s = sig.view(U).reshape(n, m // rows, rows)
    out = np.broadcast_to(np.arange(m // rows, dtype=U) * GOLDEN, (n, m // rows)).copy()
    for k in range(rows):
        out = mix(out ^ s[:, :, k])
        out = out * U(3) + U(k + 1)
    return out.view(np.int64)
