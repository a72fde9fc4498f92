"""The block labeller: a bidirectional LSTM in numpy over a page's blocks.

A block enters as a hashed bag of its tag path, a hashed bag of its words and a few measures; the forward and the
backward network read the whole page, and every block gets the probability that it is part of the main text. Weights
are trained by ``python -m gaugework.llm.html_pages`` on pages made there and kept beside this file.
"""

from __future__ import annotations

import functools
import math
import os

import numpy as np

from gaugework.llm.html_blocks import PATHS, Block

WORD_BITS, EMBED, HIDDEN, MEASURES = 9, 16, 24, 9
WORDS = 1 << WORD_BITS
MIX = np.uint64(0x9E3779B97F4A7C15)
POWERS = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(64)], np.uint64)
WEIGHTS = os.path.join(os.path.dirname(__file__), "block_labeller.npz")
HEADINGS = frozenset(f"h{k}" for k in range(1, 7))


def path_buckets(b: Block) -> np.ndarray:
    """The buckets of a block's whole path."""
    mask = b.inside.mask if b.inside else 0
    return np.flatnonzero(np.unpackbits(np.frombuffer(mask.to_bytes(PATHS // 8, "little"), np.uint8), bitorder="little"))


def word_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of all words of texts of words between single spaces the bucket, and the first word of each text."""
    codes = np.frombuffer("\n".join(texts).lower().encode(), np.uint8)
    gap = (codes == 32) | (codes == 10)
    starts = np.append(0, np.flatnonzero(gap) + 1)
    place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    term = (codes.astype(np.uint64) + np.uint64(1)) * POWERS[place & 63]
    term[gap] = 0
    bucket = (np.add.reduceat(term, starts) * MIX >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    return bucket, np.flatnonzero(np.append(True, codes[starts[1:] - 1] == 10))


def measures(page: list[Block], words: np.ndarray) -> np.ndarray:
    """Nine measures of each block: size, words, links, marks, heading or not, place in the page, depth."""
    total, rows = len(page), []
    for i, (b, n) in enumerate(zip(page, words.tolist(), strict=True)):
        size, e = len(b.text), b.inside
        marks = sum(map(b.text.count, ".,;:!?"))
        depth = min(e.depth, 20) if e else 0
        rows.append((
            math.log1p(size) / 8, math.log1p(n) / 6, b.linked / size, marks / n, size / n / 10, bool(e) and e.tag in HEADINGS, i / total,
            1 - i / total, depth / 10
        ))
    return np.array(rows, np.float32).reshape(total, MEASURES)


def features(page: list[Block]) -> np.ndarray:
    """A row for each block: path bag, word bag (each of length 1), measures. For training; embedded() has no such rows."""
    out = np.zeros((len(page), PATHS + WORDS + MEASURES), np.float32)
    if not page:
        return out
    bucket, first = word_buckets([b.text for b in page])
    n = np.diff(np.append(first, len(bucket)))
    np.add.at(out, (np.repeat(np.arange(len(page)), n), PATHS + bucket), 1)
    out[:, PATHS : PATHS + WORDS] /= n[:, None]
    for i, b in enumerate(page):
        buckets = path_buckets(b)
        out[i, buckets] = 1 / max(1, len(buckets)) ** 0.5
    out[:, PATHS + WORDS :] = measures(page, n)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Labeller:
    """Parameters: the embeddings ep and ew, for both directions k the gates' wk, uk and bk, and the output's o and c."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.paths: dict[int, np.ndarray] = {}  # embeddings of paths met before, for labelling

    @classmethod
    def fresh(cls, seed: int = 7) -> Labeller:
        rng, size = np.random.default_rng(seed), 2 * EMBED + MEASURES
        draw = lambda *shape: (rng.standard_normal(shape) / shape[0] ** 0.5).astype(np.float32)
        w = {"ep": draw(PATHS, EMBED) * 8, "ew": draw(WORDS, EMBED) * 8, "o": draw(2 * HIDDEN, 1), "c": np.zeros(1, np.float32)}
        for k in "fb":
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            w |= {"w" + k: draw(size, 4 * HIDDEN), "u" + k: draw(HIDDEN, 4 * HIDDEN), "b" + k: bias}
        return cls(w)

    @classmethod
    @functools.cache
    def load(cls) -> Labeller:
        with np.load(WEIGHTS) as z:
            return cls({k: z[k].astype(np.float32) for k in z.files})

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, dict]:
        """x: pages, blocks, features, padded at the end where mask is 0. Gives log-odds, and what backward needs."""
        w = self.w
        e = np.concatenate([x[..., :PATHS] @ w["ep"], x[..., PATHS : PATHS + WORDS] @ w["ew"], x[..., PATHS + WORDS :]], -1)
        kept: dict = {"e": e}
        n, steps = x.shape[:2]
        both = np.zeros((n, steps, 2 * HIDDEN), np.float32)
        for k, order, at in (("f", range(steps), 0), ("b", range(steps - 1, -1, -1), HIDDEN)):
            gates = e @ w["w" + k] + w["b" + k]
            h = c = np.zeros((n, HIDDEN), np.float32)
            trace = kept[k] = []
            for t in order:
                z = gates[:, t] + h @ w["u" + k]
                i, f, o = (sigmoid(z[:, j * HIDDEN : (j + 1) * HIDDEN]) for j in range(3))
                g = np.tanh(z[:, 3 * HIDDEN :])
                m = mask[:, t, None]
                new = f * c + i * g
                s = np.tanh(new)
                trace.append((t, h, c, i, f, o, g, s))
                c, h = m * new + (1 - m) * c, m * (o * s) + (1 - m) * h  # padding leaves the state as it is
                both[:, t, at : at + HIDDEN] = h
        kept["both"] = both
        return (both @ w["o"])[..., 0] + w["c"], kept

    def backward(self, x: np.ndarray, mask: np.ndarray, kept: dict, d: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the parameters from those of the log-odds."""
        w, e, both = self.w, kept["e"], kept["both"]
        grad = {"o": np.einsum("nth,nt->h", both, d)[:, None], "c": np.array([d.sum()], np.float32)}
        d_both, d_e = d[..., None] * w["o"][:, 0], np.zeros_like(e)
        for k, at in (("f", 0), ("b", HIDDEN)):
            dz_all = np.zeros((*e.shape[:2], 4 * HIDDEN), np.float32)
            grad["u" + k] = np.zeros_like(w["u" + k])
            dh = dc = np.zeros((e.shape[0], HIDDEN), np.float32)
            for t, h0, c0, i, f, o, g, s in reversed(kept[k]):
                m = mask[:, t, None]
                dh = dh + d_both[:, t, at : at + HIDDEN]
                own, carry = dh * m, dh * (1 - m)
                dn = dc * m + own * o * (1 - s * s)
                dz = np.concatenate([dn * g * i * (1 - i), dn * c0 * f * (1 - f), own * s * o * (1 - o), dn * i * (1 - g * g)], 1)
                dz_all[:, t] = dz
                grad["u" + k] += h0.T @ dz
                dh, dc = dz @ w["u" + k].T + carry, dn * f + dc * (1 - m)
            flat = dz_all.reshape(-1, 4 * HIDDEN)
            grad["w" + k], grad["b" + k] = e.reshape(-1, e.shape[-1]).T @ flat, flat.sum(0)
            d_e += dz_all @ w["w" + k].T
        flat, d_e = x.reshape(-1, x.shape[-1]), d_e.reshape(-1, e.shape[-1])
        grad["ep"], grad["ew"] = flat[:, :PATHS].T @ d_e[:, :EMBED], flat[:, PATHS : PATHS + WORDS].T @ d_e[:, EMBED : 2 * EMBED]
        return grad

    def embedded(self, page: list[Block]) -> np.ndarray:
        """What enters the recurrent layers for each block: both bags' embeddings and the measures."""
        out, ep = np.zeros((len(page), 2 * EMBED + MEASURES), np.float32), self.w["ep"]
        bucket, first = word_buckets([b.text for b in page])
        n = np.diff(np.append(first, len(bucket)))
        for at in range(0, len(page), 1024):  # the words of so many blocks at once
            size = n[at : at + 1024]
            own = bucket[first[at] : first[at] + size.sum()]
            bags = np.bincount(np.repeat(np.arange(len(size)) * WORDS, size) + own, minlength=len(size) * WORDS).reshape(-1, WORDS)
            out[at : at + 1024, EMBED : 2 * EMBED] = bags.astype(np.float32) @ self.w["ew"] / size[:, None]
        table, numbers, of = [], [], {}
        if len(self.paths) > 20_000:
            self.paths.clear()
        for b in page:
            if (k := of.get(b.inside)) is None:
                path, k = b.inside.mask if b.inside else 0, len(table)
                of[b.inside] = k
                if path not in self.paths:
                    buckets = path_buckets(b)
                    self.paths[path] = ep[buckets].sum(0) / max(1, len(buckets)) ** 0.5
                table.append(self.paths[path])
            numbers.append(k)
        out[:, :EMBED] = np.array(table)[numbers]
        out[:, 2 * EMBED :] = measures(page, n)
        return out

    def odds(self, pages: list[np.ndarray], chunk: int = 1024) -> list[np.ndarray]:
        """Log-odds of every block of embedded pages. Both directions go step by step together, the backward one from each
        page's own end; what a step needs of the input is made for ``chunk`` steps at a time, and no trace is kept."""
        w, n, steps = self.w, len(pages), max(map(len, pages))
        both = np.zeros((2, steps, n, 2 * EMBED + MEASURES), np.float32)
        for i, p in enumerate(pages):
            both[0, : len(p), i], both[1, : len(p), i] = p, p[::-1]
        pair = lambda k: np.stack([w[k + "f"], w[k + "b"]])
        wx, u, bias = pair("w"), pair("u"), pair("b")[:, None]
        o = w["o"].reshape(2, HIDDEN)
        h = c = np.zeros((2, n, HIDDEN), np.float32)
        out = np.empty((2, steps, n), np.float32)
        for at in range(0, steps, chunk):
            now = both[:, at : at + chunk].reshape(2, -1, both.shape[-1])
            gates = np.matmul(now, wx)
            gates += bias
            gates = gates.reshape(2, -1, n, 4 * HIDDEN)
            held = np.empty((2, gates.shape[1], n, HIDDEN), np.float32)
            for t in range(gates.shape[1]):
                z = np.matmul(h, u)
                z += gates[:, t]
                s = sigmoid(z[..., : 3 * HIDDEN])
                c = s[..., HIDDEN : 2 * HIDDEN] * c + s[..., :HIDDEN] * np.tanh(z[..., 3 * HIDDEN :])
                h = held[:, t] = s[..., 2 * HIDDEN :] * np.tanh(c)
            out[:, at : at + chunk] = np.matmul(held.reshape(2, -1, HIDDEN), o[:, :, None]).reshape(2, -1, n)
        return [out[0, : len(p), i] + out[1, : len(p), i][::-1] + w["c"] for i, p in enumerate(pages)]

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(len(p) for p in pages)
        x, mask = np.zeros((len(pages), steps, PATHS + WORDS + MEASURES), np.float32), np.zeros((len(pages), steps), np.float32)
        for i, p in enumerate(pages):
            x[i, : len(p)], mask[i, : len(p)] = p, 1
        return x, mask

    def main_blocks(self, pages: list[list[Block]], cells: int = 6000) -> list[list[bool]]:
        """For every block of every page, whether it is part of the main text. Pages of like length share a batch of bounded size."""
        out: list[list[bool]] = [[] for _ in pages]
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            n = max(1, cells // len(pages[order[-1]]))
            now, order = order[-n:], order[:-n]
            for i, odds in zip(now, self.odds([self.embedded(pages[i]) for i in now]), strict=True):
                out[i] = (odds > 0).tolist()
        return out

    def fit(self, pages: list[tuple[list[Block], list[bool]]], rounds: int = 6, batch: int = 24, rate: float = 4e-3, seed: int = 11) -> Labeller:
        """Adam on the cross-entropy of all blocks."""
        rng = np.random.default_rng(seed)
        rows = [(features(p), np.array(y, np.float32)) for p, y in pages if p]
        self.paths.clear()
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        step = 0
        for turn in range(rounds):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), batch):
                now = [rows[i] for i in order[at : at + batch]]
                x, mask = self.padded([r for r, _ in now])
                y = np.zeros(mask.shape, np.float32)
                for i, (_, own) in enumerate(now):
                    y[i, : len(own)] = own
                odds, kept = self.forward(x, mask)
                d = (sigmoid(odds) - y) * mask / mask.sum()
                step += 1
                pace = rate * (1 - (turn * len(rows) + at) / (rounds * len(rows)) * 0.9)
                for k, g in self.backward(x, mask, kept, d.astype(np.float32)).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self
