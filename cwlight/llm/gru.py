"""A bidirectional gated recurrent network over bytes, in numpy.

Every position of a segment gets class probabilities from the forward and the
backward state; training is by backpropagation through time on whole segments.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """One gated recurrent layer.  Gates: update z, reset r, candidate c."""

    def __init__(self, rng: np.random.Generator, hidden: int) -> None:
        # The input is one byte, so its weights are a table of gate inputs.
        self.table = (rng.normal(0, 0.3, (256, 3 * hidden))).astype(np.float32)
        self.gate = (rng.normal(0, hidden**-0.5, (hidden, 2 * hidden))).astype(np.float32)
        self.cand = (rng.normal(0, hidden**-0.5, (hidden, hidden))).astype(np.float32)
        self.hidden = hidden

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.gate, self.cand]

    def run(self, steps: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States after each step; ``steps`` is (time, segments) of bytes."""
        h = np.zeros((steps.shape[1], self.hidden), np.float32)
        out, memory, k = np.empty((*steps.shape, self.hidden), np.float32), [], 2 * self.hidden
        for t, x in enumerate(steps):
            into = self.table[x]
            zr = _sigmoid(into[:, :k] + h @ self.gate)
            z, r = zr[:, : self.hidden], zr[:, self.hidden :]
            c = np.tanh(into[:, k:] + (r * h) @ self.cand)
            if keep:
                memory.append((x, h, z, r, c))
            h = h + z * (c - h)
            out[t] = h
        return out, memory

    def states(self, steps: np.ndarray) -> np.ndarray:
        """What ``run`` gives, without memory of the way, in place."""
        k, n = 2 * self.hidden, steps.shape[1]
        # sigmoid(x) is tanh(x / 2) / 2 + 1 / 2: half the gate weights go in, and u = tanh + 1 is twice a gate.
        scale = np.repeat(np.float32([0.5, 1.0]), [k, self.hidden])
        table, gate, cand = self.table * scale, self.gate * np.float32(0.5), self.cand * np.float32(0.5)
        h, out = np.zeros((n, self.hidden), np.float32), np.empty((*steps.shape, self.hidden), np.float32)
        into, c = np.empty((n, 3 * self.hidden), np.float32), np.empty((n, self.hidden), np.float32)
        u, z, r = into[:, :k], into[:, : self.hidden], into[:, self.hidden : k]
        for t, x in enumerate(steps):
            table.take(x, axis=0, out=into, mode="clip")
            u += h @ gate
            np.tanh(u, out=u)
            u += 1
            r *= h
            np.matmul(r, cand, out=c)
            c += into[:, k:]
            np.tanh(c, out=c)
            c -= h
            c *= z
            c *= np.float32(0.5)
            np.add(h, c, out=out[t])
            h = out[t]
        return out

    def back(self, memory: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of the parameters, given those of the states."""
        d_table, d_gate, d_cand = (np.zeros_like(p) for p in self.parameters())
        dh = np.zeros_like(d_out[0])
        for t in range(len(memory) - 1, -1, -1):
            x, h, z, r, c = memory[t]
            dh = dh + d_out[t]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - h) * z * (1 - z)
            rh = dc @ self.cand.T
            dr = rh * h * r * (1 - r)
            d_zr = np.concatenate([dz, dr], axis=1)
            d_cand += (r * h).T @ dc
            d_gate += h.T @ d_zr
            np.add.at(d_table, x, np.concatenate([d_zr, dc], axis=1))
            dh = dh * (1 - z) + rh * r + d_zr @ self.gate.T
        return [d_table, d_gate, d_cand]


class ByteTagger:
    """Two directions and a softmax at every position."""

    def __init__(self, classes: int, hidden: int = 8, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.ahead, self.behind = Direction(rng, hidden), Direction(rng, hidden)
        self.top = rng.normal(0, 0.3, (2 * hidden, classes)).astype(np.float32)
        self.bias = np.zeros(classes, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.ahead.parameters(), *self.behind.parameters(), self.top, self.bias]

    def _scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = self.ahead.hidden
        s = a @ self.top[:k] + b[::-1] @ self.top[k:] + self.bias
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=2, keepdims=True)
        return s

    def probabilities(self, segments: np.ndarray) -> np.ndarray:
        """(time, segments, classes) for (segments, time) of bytes."""
        steps = np.ascontiguousarray(segments.T)
        return self._scores(self.ahead.states(steps), self.behind.states(steps[::-1]))

    def fit(self, segments: np.ndarray, classes: np.ndarray, rounds: int = 250, batch: int = 64, rate: float = 0.02, seed: int = 5) -> None:
        """Adam on the cross-entropy of every position."""
        rng, k = np.random.default_rng(seed), self.ahead.hidden
        first = [np.zeros_like(p) for p in self.parameters()]
        second = [np.zeros_like(p) for p in self.parameters()]
        for n in range(1, rounds + 1):
            rows = rng.integers(0, len(segments), batch)
            steps, y = np.ascontiguousarray(segments[rows].T), classes[rows]
            a, ma = self.ahead.run(steps, True)
            b, mb = self.behind.run(steps[::-1], True)
            d = self._scores(a, b)
            d[:, np.arange(batch), y] -= 1
            d /= d.shape[0] * batch
            flat = d.reshape(-1, d.shape[2])
            d_top = np.concatenate([a.reshape(-1, k).T @ flat, b[::-1].reshape(-1, k).T @ flat])
            grads = [*self.ahead.back(ma, d @ self.top[:k].T), *self.behind.back(mb, (d @ self.top[k:].T)[::-1]), d_top, flat.sum(axis=0)]
            size = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
            for p, g, m, v in zip(self.parameters(), grads, first, second):
                g = g * min(1.0, 1.0 / max(size, 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (1 - n / (rounds + 1)) * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-7)
