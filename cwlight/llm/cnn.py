"""A convolutional text classifier in numpy: hashed word embeddings, several filter widths, max pooling.

A word comes as several buckets (itself, its stem) whose embeddings add up.
A second head reads the language from the mean embedding, so that thresholds
calibrated by language can be applied without being told the language.
"""

from __future__ import annotations

import numpy as np

WIDTHS, PAD = (1, 2, 3), 3


def padded(ids: np.ndarray, bounds: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Word ids with ``PAD`` empty places behind each document, so that no filter reaches over its end."""
    sizes = np.diff(bounds)
    out = np.full((len(ids) + PAD * len(sizes), ids.shape[1]), pad, ids.dtype)
    out[np.arange(len(ids)) + PAD * np.repeat(np.arange(len(sizes)), sizes)] = ids
    return out, bounds + PAD * np.arange(len(bounds))


class TextCNN:
    def __init__(self, buckets: int, languages: int, dim: int = 12, filters: int = 6, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.buckets, self.filters = buckets, filters
        self.words = rng.normal(0, 0.1, (buckets + 1, dim)).astype(np.float32)
        self.words[buckets] = 0
        self.kernel = [rng.normal(0, 0.3, (w, dim, filters)).astype(np.float32) for w in WIDTHS]
        self.offset = np.zeros(len(WIDTHS) * filters, np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * filters).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.lang = rng.normal(0, 0.1, (dim, max(1, languages))).astype(np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.words, *self.kernel, self.offset, self.out, self.bias, self.lang]

    def warm(self, weight: np.ndarray) -> None:
        """Starts the first dimension at each word's smoothed log-odds, read by the first filter of each width."""
        self.words[: self.buckets, 0] = weight
        for k in self.kernel:
            k[:, 0, 0] += 1.0 / len(k)
        self.out[:: self.filters] = 1.0

    def _forward(self, ids: np.ndarray, starts: np.ndarray) -> tuple:
        e = self.words[ids].sum(axis=1)
        ends = np.append(starts[1:], len(ids))
        pooled, where = [], []
        for w, k in zip(WIDTHS, self.kernel):
            n = len(ids) - w + 1
            c = sum(e[j : j + n] @ k[j] for j in range(w))
            for a, b in zip(starts, ends):
                best = c[a : b - w + 1].argmax(axis=0) + a
                where.append(best)
                pooled.append(c[best, np.arange(self.filters)])
        docs = len(starts)
        order = lambda xs: np.concatenate([np.array(xs[i * docs : (i + 1) * docs]) for i in range(len(WIDTHS))], axis=1)
        h = order(pooled) + self.offset
        return e, order(where), h, np.add.reduceat(e, starts) / np.maximum(1, (ends - starts - PAD))[:, None]

    def step(self, ids: np.ndarray, starts: np.ndarray, y: np.ndarray, lang: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean loss over a batch."""
        e, where, h, mean = self._forward(ids, starts)
        r, docs = np.maximum(h, 0), len(starts)
        p = 1 / (1 + np.exp(-(r @ self.out + self.bias)))
        dz = ((p - y) / docs).astype(np.float32)
        s = mean @ self.lang
        s = np.exp(s - s.max(axis=1, keepdims=True))
        s /= s.sum(axis=1, keepdims=True)
        s[np.arange(docs), lang] -= 1
        s *= (lang >= 0)[:, None] / np.float32(docs)
        d_h = dz[:, None] * self.out * (h > 0)
        d_words, d_kernel = np.zeros_like(self.words), [np.zeros_like(k) for k in self.kernel]
        for i, (w, k) in enumerate(zip(WIDTHS, self.kernel)):
            for f in range(self.filters):
                at, g = where[:, i * self.filters + f], d_h[:, i * self.filters + f]
                for j in range(w):
                    d_kernel[i][j, :, f] += g @ e[at + j]
                    for column in ids.T:
                        np.add.at(d_words, column[at + j], g[:, None] * k[j, :, f])
        sizes = np.diff(np.append(starts, len(ids)))
        d_mean = (s @ self.lang.T) / np.maximum(1, sizes - PAD)[:, None]
        for column in ids.T:
            np.add.at(d_words, column, np.repeat(d_mean, sizes, axis=0))
        d_words[self.buckets] = 0
        return [d_words, *d_kernel, d_h.sum(axis=0), dz @ r, dz.sum(keepdims=True), mean.T @ s]

    def fit(self, docs: list[np.ndarray], y: np.ndarray, lang: np.ndarray, rounds: int = 240, batch: int = 32, rate: float = 0.01, drop: float = 0.1, seed: int = 13) -> None:
        """Adam with decay; half of each batch is of each class, words are dropped at random."""
        rng = np.random.default_rng(seed)
        sides = [np.flatnonzero(y == v) for v in (0, 1)]
        first = [np.zeros_like(p) for p in self.parameters()]
        second = [np.zeros_like(p) for p in self.parameters()]
        for n in range(1, rounds + 1):
            rows = np.concatenate([rng.choice(s, batch // 2) for s in sides if len(s)])
            texts = [np.where(rng.random((len(docs[i]), 1)) < drop, self.buckets, docs[i]) for i in rows]
            bounds = np.cumsum([0, *map(len, texts)])
            ids, bounds = padded(np.concatenate(texts), bounds, self.buckets)
            grads = self.step(ids, bounds[:-1], y[rows].astype(np.float32), lang[rows])
            for p, g, m, v in zip(self.parameters(), grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (1 - n / (rounds + 1)) * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-6) + 1e-4 * p

    def tables(self) -> np.ndarray:
        """Per word: its share in each filter at each place, then its language scores."""
        return np.concatenate([self.words @ k[j] for k in self.kernel for j in range(len(k))] + [self.words @ self.lang], axis=1)

    def scores(self, tables: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(margin, language probabilities) of documents given as word ids and bounds."""
        ids, at = padded(ids, bounds, self.buckets)
        starts, f, column, pooled = at[:-1], self.filters, 0, []
        g = tables[ids[:, 0]]
        for other in ids.T[1:]:
            g += tables[other]
        for w in WIDTHS:
            c = g[:, column : column + f].copy()
            for j in range(1, w):
                c[:-j] += g[j:, column + j * f : column + (j + 1) * f]
                c[at[1:] - j] = -np.inf  # it would reach into the next document
            column += w * f
            pooled.append(np.maximum.reduceat(c, starts))
        r = np.maximum(np.concatenate(pooled, axis=1) + self.offset, 0)
        s = np.add.reduceat(g[:, column:], starts) / np.maximum(1, np.diff(bounds))[:, None]
        s = np.exp(s - s.max(axis=1, keepdims=True))
        return r @ self.out + self.bias, s / s.sum(axis=1, keepdims=True)
