"""HTML extraction by a recurrent block labeller.

A page is a sequence of leaf blocks. For each, a bidirectional LSTM in numpy reads a vector of its tag path (elements,
classes, ids, roles, share of links) and one of its hashed words, and tells from the whole page whether the block
belongs to the main text. The network is learned here, once a process, from random labelled pages (html_blocks).

Defined results: a null or empty page has no text; neither has one without main blocks; unclosed elements end where
HTML ends them; repeated rows are treated each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .html_blocks import Block, blocks, random_page

#: Hash buckets of path names and of words, width of their vectors, width of the state in each direction.
NAMES, WORDS, WIDTH, STATE = 1024, 1024, 16, 16
#: Pages to learn from, a step's pages, rounds, step size.
PAGES, BATCH, ROUNDS, RATE = 1500, 50, 8, 0.03
#: Blocks and pages labelled at once.
CELLS, TOGETHER = 20_000, 128


@functools.lru_cache(1 << 17)
def _word(w: str) -> int:
    return zlib.crc32(w.encode()) % WORDS


@functools.lru_cache(1 << 14)
def _name(w: str) -> int:
    return zlib.crc32(w.encode()) % NAMES


def _bags(items: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joined ids, starts and sizes. None is empty."""
    n = np.fromiter(map(len, items), np.int64, len(items))
    return np.fromiter((x for i in items for x in i), np.int64, int(n.sum())), np.cumsum(n) - n, n


def encoded(page: list[Block]) -> list[tuple[list[int], list[int]]]:
    """For each block the ids of its path names and of its distinct words."""
    return [([_name(w) for w in sorted(b.path)], [_word(w) for w in sorted(set(b.text.lower().split()))]) for b in page]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Labeller:
    """Parameters p: vectors of names (N) and words (V); for both directions W, U, b; the output's w and c."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        self.p = {"N": g.normal(0, 0.3, (NAMES, WIDTH)), "V": g.normal(0, 0.05, (WORDS, WIDTH)), "w": g.normal(0, 0.3, 2 * STATE), "c": np.zeros(1)}
        for d in "fr":
            b = np.zeros(4 * STATE)
            b[STATE : 2 * STATE] = 1
            self.p |= {f"W{d}": g.normal(0, 0.2, (2 * WIDTH, 4 * STATE)), f"U{d}": g.normal(0, 0.2, (STATE, 4 * STATE)), f"b{d}": b}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, pages: list[list[tuple[list[int], list[int]]]]):
        """Scores (steps, pages), and what learning needs. Pages are padded at their ends."""
        lens = [len(x) for x in pages]
        steps = max(lens)
        cell = np.array([(t, k) for k, n in enumerate(lens) for t in range(n)])
        names, words = _bags([b[0] for x in pages for b in x]), _bags([b[1] for x in pages for b in x])
        x = np.zeros((steps, len(pages), 2 * WIDTH), np.float32)
        for (ids, at, n), table, lo in ((names, self.p["N"], 0), (words, self.p["V"], WIDTH)):
            x[cell[:, 0], cell[:, 1], lo : lo + WIDTH] = np.add.reduceat(table[ids], at) / np.sqrt(n)[:, None]
        mask = (np.arange(steps)[:, None] < np.array(lens)).astype(np.float32)[:, :, None]
        runs = {}
        for d in "fr":
            z = x @ self.p[f"W{d}"] + self.p[f"b{d}"]
            h = np.zeros((steps, len(pages), STATE), np.float32)
            gates, cells = np.empty_like(z), np.zeros_like(h)
            ht = ct = np.zeros((len(pages), STATE), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                a = z[t] + ht @ self.p[f"U{d}"]
                a[:, : 3 * STATE] = sigmoid(a[:, : 3 * STATE])
                a[:, 3 * STATE :] = np.tanh(a[:, 3 * STATE :])
                i, f, o, g = np.split(a, 4, axis=1)
                ct = mask[t] * (f * ct + i * g)
                ht = mask[t] * (o * np.tanh(ct))
                gates[t], cells[t], h[t] = a, ct, ht
            runs[d] = (h, gates, cells)
        score = np.concatenate([runs["f"][0], runs["r"][0]], axis=2) @ self.p["w"] + self.p["c"]
        return score, (x, mask, runs, cell, names, words)

    def gradient(self, score: np.ndarray, truth: np.ndarray, kept) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy, through time."""
        x, mask, runs, cell, names, words = kept
        m = mask[:, :, 0]
        ds = (sigmoid(score) - truth) * m / m.sum()
        out = {"w": np.einsum("tb,tbh->h", ds, np.concatenate([runs["f"][0], runs["r"][0]], axis=2)), "c": np.array([ds.sum()])}
        dx = np.zeros_like(x)
        steps = len(x)
        for k, d in enumerate("fr"):
            h, gates, cells = runs[d]
            w = self.p["w"][k * STATE : (k + 1) * STATE]
            dz = np.zeros_like(gates)
            dh = dc = np.zeros_like(h[0])
            order = list(range(steps)) if d == "f" else list(range(steps - 1, -1, -1))
            for j in range(steps - 1, -1, -1):
                t = order[j]
                before = cells[order[j - 1]] if j else np.zeros_like(cells[0])
                i, f, o, g = np.split(gates[t], 4, axis=1)
                dh = (dh + ds[t][:, None] * w) * mask[t]
                tc = np.tanh(cells[t])
                dc = (dc + dh * o * (1 - tc * tc)) * mask[t]
                dz[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                dc = dc * f
                dh = dz[t] @ self.p[f"U{d}"].T
            prev = np.zeros_like(h)
            if d == "f":
                prev[1:] = h[:-1]
            else:
                prev[:-1] = h[1:]
            out[f"W{d}"] = np.einsum("tbx,tbz->xz", x, dz)
            out[f"U{d}"] = np.einsum("tbx,tbz->xz", prev, dz)
            out[f"b{d}"] = dz.sum(axis=(0, 1))
            dx += dz @ self.p[f"W{d}"].T
        flat = dx[cell[:, 0], cell[:, 1]]
        for name, (ids, _, n), lo in (("N", names, 0), ("V", words, WIDTH)):
            g = np.zeros_like(self.p[name])
            np.add.at(g, ids, np.repeat(flat[:, lo : lo + WIDTH] / np.sqrt(n)[:, None], n, axis=0))
            out[name] = g
        return out

    def learn(self, pages: list, truth: list[list[bool]], seed: int = 11) -> float:
        """Adam over pages of similar length together. Returns the share of blocks labelled right in the last round."""
        r = random.Random(seed)
        first, second = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        groups = [order[k : k + BATCH] for k in range(0, len(order), BATCH)]
        step = right = total = 0
        for turn in range(ROUNDS):
            r.shuffle(groups)
            right = total = 0
            for g in groups:
                score, kept = self.forward([pages[k] for k in g])
                y = np.zeros_like(score)
                for c, k in enumerate(g):
                    y[: len(truth[k]), c] = truth[k]
                m = kept[1][:, :, 0] > 0
                right, total, step = right + ((score > 0) == (y > 0))[m].sum(), total + m.sum(), step + 1
                rate = RATE * (1 - turn / ROUNDS)
                for k, v in self.gradient(score, y, kept).items():
                    first[k] += 0.1 * (v - first[k])
                    second[k] += 0.01 * (v * v - second[k])
                    self.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return right / total

    def __call__(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which blocks belong to the main text. Pages of similar length share a batch."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < TOGETHER and len(pages[order[end]]) * (end - at + 1) <= CELLS:
                end += 1
            some = order[at:end]
            score, _ = self.forward([encoded(pages[k]) for k in some])
            for c, k in enumerate(some):
                out[k] = score[: len(pages[k]), c] > 0
            at = end
        return out


@functools.lru_cache(1)
def trained(n: int = PAGES, seed: int = 5) -> Labeller:
    r = random.Random(seed)
    pages, truth = [], []
    while len(pages) < n:
        html, labels = random_page(r)
        found = blocks(html)
        if found and len(found) == len(labels):
            pages.append(encoded(found))
            truth.append(labels)
    model = Labeller()
    model.learn(pages, truth)
    return model


def _extract(model: Labeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            html, texts, at = b.column(b.num_columns - 1), [], 0
            while at < len(html):  # some MB of pages at a time
                some, size = [], 0
                while at < len(html) and (not some or size < 2 << 20):
                    page = html[at].as_py() or ""
                    some.append(blocks(page))
                    size += len(page)
                    at += 1
                texts += ["\n\n".join(x.text for x, y in zip(page, main, strict=True) if y) for page, main in zip(some, model(some), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*b.schema.names[:-1], "text"])

    return run


def main_text(pages: DataFrame, keys: list[str], html: str = "html", model: Labeller | None = None) -> DataFrame:
    """keys and text: the main text of each page."""
    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.select(*keys, F.col(html).cast("string").alias("html")).mapInArrow(_extract(model or trained()), f"{kinds}, text string")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(read_table(spark, sf_dir, "pages"), ["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
