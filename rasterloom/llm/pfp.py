"""Suffix order by prefix-free parsing.

A rolling hash picks trigger strings; phrases run from one trigger to the end of the next. Of repetitive text the
dictionary of distinct phrases and the parse (their order) are far smaller than the text. The order of all suffixes
follows from the suffix arrays of those two: first by the rest of the phrase, then by what follows in the parse.
"""

from __future__ import annotations

import numpy as np

#: Ends every text; it cannot occur in UTF-8.
END = 0xFF
TRIGGER, ONE_IN = 8, 24
#: Bytes by which suffixes of phrases are ordered at first.
FIRST = 7


def packed(s: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The first FIRST bytes of each string s[i : i + left[i]] as one number that orders them; the low byte tells how many there are."""
    key = np.zeros(len(s), np.uint64)
    wide = np.concatenate([s, np.zeros(FIRST, np.uint8)])
    for k in range(FIRST):
        key = key << np.uint64(8) | np.where(left > k, wide[k : k + len(s)], 0).astype(np.uint64)
    return key << np.uint64(8) | np.minimum(left, FIRST).astype(np.uint64)


def ranks(key: np.ndarray, left: np.ndarray, have: int = 1) -> np.ndarray:
    """Rank of each string of length left[i] that starts at place i, by prefix doubling; equal strings have equal ranks.

    key orders the strings by their first `have` symbols. Only strings that are not yet told apart are sorted again.
    """
    n = len(key)
    order = np.argsort(key, kind="stable")
    place = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    r = np.empty(n, np.int64)
    r[order] = np.maximum.accumulate(np.where(new, place, 0))
    open_ = order[~new | np.append(~new[1:], False)]
    while True:
        open_ = open_[left[open_] >= have]
        if not len(open_):
            return r
        k = r[open_] * (n + 1) + np.where(left[open_] > have, r[np.minimum(open_ + have, n - 1)] + 1, 0)
        o = np.argsort(k, kind="stable")
        open_, k = open_[o], k[o]
        old, place = r[open_], np.arange(len(open_))
        new, sub = np.ones(len(open_), bool), np.ones(len(open_), bool)
        new[1:] = old[1:] != old[:-1]
        sub[1:] = k[1:] != k[:-1]
        r[open_] = old + np.maximum.accumulate(np.where(sub, place, 0)) - np.maximum.accumulate(np.where(new, place, 0))
        open_ = open_[~sub | np.append(~sub[1:], False)]
        have *= 2


def triggers(t: np.ndarray) -> np.ndarray:
    """Starts of the trigger strings: a rolling hash over TRIGGER symbols that is 0 modulo ONE_IN."""
    h = np.zeros(len(t) - TRIGGER + 1, np.uint64)
    for k in range(TRIGGER):
        h = h * np.uint64(0x100000001B3) + t[k : k + len(h)].astype(np.uint64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero((h >> np.uint64(33)) % np.uint64(ONE_IN) == 0)


def suffix_order(texts: list[bytes], at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The joined texts, each ended by END, and the places `at` (all by default) in the order of their suffixes."""
    t = np.frombuffer(bytes([END]).join(texts) + bytes([END]) * (TRIGGER + 1), np.uint8)
    last = len(t) - TRIGGER
    cuts = triggers(t)
    cuts = np.unique(np.concatenate(([0], cuts[cuts < last], [last])))
    raw = t.tobytes()
    phrases = [raw[a : b + TRIGGER] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    words = sorted(set(phrases))
    number = {p: k for k, p in enumerate(words)}
    parse = np.fromiter((number[p] for p in phrases), np.int64, len(phrases))
    after = np.append(ranks(parse, len(parse) - np.arange(len(parse))), 0)  # the order of what follows each phrase
    # No suffix of a phrase that is longer than a trigger is a proper prefix of another, so what follows matters only if two are equal.
    lens = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.concatenate(([0], np.cumsum(lens)[:-1]))
    rest = np.repeat(begin + lens, lens) - np.arange(lens.sum())
    own = ranks(packed(np.frombuffer(b"".join(words), np.uint8), rest), rest, FIRST)
    if at is None:
        at = np.arange(last)
    k = np.searchsorted(cuts, at, side="right") - 1
    order = np.lexsort((after[k + 1], own[begin[parse[k]] + at - cuts[k]]))
    return t, at[order]


def equal_runs(t: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """For places in suffix order, the number of the class of those whose first n symbols are equal."""
    w = np.lib.stride_tricks.sliding_window_view(np.concatenate([t, np.full(n, END, np.uint8)]), n)
    new = np.ones(len(order), bool)
    for a in range(1, len(order), 8192):
        b = min(len(order), a + 8192)
        new[a:b] = (w[order[a:b]] != w[order[a - 1 : b - 1]]).any(axis=1)
    return np.cumsum(new) - 1
