"""Signal kernels on numpy arrays, called inside Spark tasks.

Filters and what builds on them take one channel, or several of one length as the
columns of a matrix: their recursion then takes one step per sample for all.
"""

from __future__ import annotations

import math
from decimal import Decimal, localcontext
from functools import lru_cache

import numpy as np

ROOT_EPS = math.sqrt(np.finfo(float).eps)
#: Decimal digits of the powers that join blocks of a filter.
DIGITS = 60


# Filters -------------------------------------------------------------------


def butterworth(order: int, edges_hz: float | tuple[float, float], fs: float) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a low-pass (one edge) or band-pass (two edges) Butterworth filter.

    Analogue poles on the unit circle are moved to the band and carried to the
    z-plane by the bilinear transform, all in pole-zero form.
    """
    angles = math.pi * (2 * np.arange(order) + 1) / (2 * order) + math.pi / 2
    poles = np.exp(1j * angles)
    warp = lambda f: 4 * math.tan(math.pi * f / fs)  # noqa: E731  the z-plane is sampled at 2 Hz here
    if isinstance(edges_hz, tuple):
        low, high = map(warp, edges_hz)
        width, centre = high - low, math.sqrt(low * high)
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2 + 0j)
        poles, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(order), width**order
    else:
        w = warp(edges_hz)
        poles, zeros, gain = poles * w, np.zeros(0), w**order
    scale = np.prod(4 - zeros) / np.prod(4 - poles)
    z_poles = (4 + poles) / (4 - poles)
    z_zeros = np.concatenate([(4 + zeros) / (4 - zeros), -np.ones(len(poles) - len(zeros))])
    return np.real(gain * scale) * np.real(np.poly(z_zeros)), np.real(np.poly(z_poles))


def recursive(b: np.ndarray, a: np.ndarray, x: np.ndarray, past_in: float | np.ndarray = 0.0, past_out: float | np.ndarray = 0.0) -> np.ndarray:
    """The direct-form filter along the first axis, with constant inputs and outputs before the first sample."""
    before, n = len(b) - 1, len(x)
    taps = np.concatenate([np.broadcast_to(past_in, (before, *x.shape[1:])), x])
    drive = sum(tap * taps[before - j : before - j + n] for j, tap in enumerate(b)) / a[0]
    back = -(a[1:] / a[0])[::-1]
    memory = len(back)
    out = np.empty((memory + n, *x.shape[1:]))
    out[:memory] = past_out
    for i in range(n):
        out[memory + i] = drive[i] + back @ out[i : i + memory]
    return out[memory:]


def driven(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Outputs for ``x`` behind its first ``len(b) - 1`` values, which only lead in, and behind the outputs ``state``."""
    before = len(b) - 1
    return recursive(np.ones(1), a, sum(tap * x[before - j : len(x) - j] for j, tap in enumerate(b)), 0.0, state)


@lru_cache(maxsize=256)
def _power(back: tuple[float, ...], n: int) -> list[list[Decimal]]:
    """The ``n``-th power of the matrix that moves a state of past outputs, the newest last, by one sample without input."""
    m = len(back)
    turn = lambda x, y: [[sum(x[i][k] * y[k][j] for k in range(m)) for j in range(m)] for i in range(m)]
    with localcontext() as exact:
        exact.prec = DIGITS
        step = [[Decimal(int(j == i + 1)) for j in range(m)] for i in range(m - 1)] + [[Decimal(x) for x in back]]
        out = [[Decimal(int(i == j)) for j in range(m)] for i in range(m)]
        while n:
            if n & 1:
                out = turn(out, step)
            step, n = turn(step, step), n >> 1
    return out


def faded(a: np.ndarray, n: int, state: np.ndarray) -> np.ndarray:
    """The last outputs once ``n`` samples without input have passed, from those before, the newest last.

    Powers of this matrix lose all digits of a double for narrow bands, whose
    poles nearly meet, so they are taken in decimals.
    """
    if not np.any(state):
        return np.zeros(len(state))
    with localcontext() as exact:
        exact.prec = DIGITS
        given = [Decimal(x) for x in np.asarray(state, float).tolist()]
        return np.array([float(sum(x * y for x, y in zip(row, given))) for row in _power(tuple((-a[1:] / a[0])[::-1].tolist()), n)])


def both_ways(b: np.ndarray, a: np.ndarray, x: np.ndarray, ends: str) -> np.ndarray:
    """Zero phase.  ``hold``: each pass starts as if its first sample had always been; ``zeros``: from rest, with zeros behind the end."""
    gain = b.sum() / a.sum()
    if ends == "zeros":
        x = np.concatenate([x, np.zeros((2 * max(len(a), len(b)), *x.shape[1:]))])
    n, y = len(x), x
    for _ in range(2):
        start = (y[0], y[0] * gain) if ends == "hold" else (0.0, 0.0)
        y = recursive(b, a, y, *start)[::-1]
    return y[: n if ends == "hold" else n - 2 * max(len(a), len(b))]


def bandpass(x: np.ndarray, fs: float, band: tuple[float, float], order: int = 3) -> np.ndarray:
    """Physiological band: a constant signal has nothing in it."""
    b, a = butterworth(order, band, fs)
    least = 2 * max(len(a), len(b)) + 1
    if len(x) < least:
        raise ValueError(f"a band filter of order {order} needs {least} samples")
    return np.where(x.min(axis=0) == x.max(axis=0), 0.0, both_ways(b, a, x, "zeros"))


def near_constant(x: np.ndarray) -> bool:
    return bool(np.std(x, ddof=1) <= ROOT_EPS * max(1.0, np.abs(x).max()))


# Motion --------------------------------------------------------------------


def _biweight(d: np.ndarray, centre: float, tune: float) -> np.ndarray | None:
    """Tukey weights about ``centre``; None where the spread is zero or all weight is gone."""
    apart = np.abs(d - centre)
    sigma = 1.4826 * np.median(apart)
    if not np.isfinite(sigma) or sigma <= 0:
        return None
    u = apart / (sigma * tune)
    w = np.where(u < 1, (1 - u * u) ** 2, 0.0)
    return w if w.sum() > 0 else None


def tddr(x: np.ndarray, fs: float, cutoff_hz: float = 0.5, tune: float = 4.685, rounds: int = 50) -> np.ndarray:
    """Temporal derivative distribution repair: steps in the slow part are weighted down by how unusual they are."""
    z = x - x.mean(axis=0)
    slow = z if 2 * cutoff_hz / fs >= 1 - 1e-12 else both_ways(*butterworth(3, cutoff_hz, fs), z, "hold")
    if x.ndim == 1:
        return _relevelled(x, slow, tune, rounds)
    return np.stack([_relevelled(*xs, tune, rounds) for xs in zip(x.T, slow.T)], axis=1)


def _relevelled(x: np.ndarray, slow: np.ndarray, tune: float, rounds: int) -> np.ndarray:
    """One channel with the steps of its slow part weighted; as it is where the steps are all alike."""
    mean = x.mean()
    step = np.diff(slow)
    centre = step.mean()
    if np.abs(step - centre).max() == 0:
        return x
    for _ in range(rounds):
        w = _biweight(step, centre, tune)
        if w is None:
            return x
        moved = float(w @ step / w.sum())
        done = abs(moved - centre) < ROOT_EPS * max(abs(moved), abs(centre))
        centre = moved
        if done:
            break
    w = _biweight(step, centre, tune)
    if w is None:
        return x
    level = np.concatenate([[0.0], np.cumsum(w * (step - centre))])
    out = level - level.mean() + (x - mean - slow)
    return out - out.mean() + mean


_R3 = math.sqrt(3)
#: The four taps of the second Daubechies wavelet, low and high pass.
DB2_LOW = np.array([1 + _R3, 3 + _R3, 3 - _R3, 1 - _R3]) / (4 * math.sqrt(2))
DB2_HIGH = DB2_LOW[::-1] * np.array([1, -1, 1, -1])


def _windows(n: int) -> np.ndarray:
    """Places that each output of one periodic level reads: four from one before each even place."""
    return (2 * np.arange(n // 2)[:, None] + np.arange(4) - 1) % n


def db2_level(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Approximation and detail of one periodic level, along the last axis."""
    read = x[..., _windows(x.shape[-1])]
    return read @ DB2_LOW, read @ DB2_HIGH


def db2_merge(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The inverse of ``db2_level``, along the last axis: its transpose, as the taps are orthonormal."""
    n = 2 * low.shape[-1]
    spread = low[..., None] * DB2_LOW + high[..., None] * DB2_HIGH
    flat, at = spread.reshape(*low.shape[:-1], -1), _windows(n).ravel()
    out = np.zeros((*low.shape[:-1], n))
    for tap in range(4):  # places of one tap are distinct
        out[..., at[tap::4]] += flat[..., tap::4]
    return out


def wavelet_repair(x: np.ndarray, iqr: float = 1.5, min_level: int = 4) -> np.ndarray:
    """Coefficients of a shift-invariant tree beyond the quartile fences are set to zero.

    Columns are channels.  A level holds all blocks of a channel; each block
    gives two, from itself and from itself moved by one sample.  The deepest
    level stays as it is.
    """
    n, size = len(x), 1 << max(0, math.ceil(math.log2(len(x))))
    depth = int(math.log2(size)) - min_level
    if depth < 2:
        raise ValueError(f"the signal is too short for min_level: {size} samples after padding, {1 << (min_level + 2)} needed")
    columns = x[:, None] if x.ndim == 1 else x
    padded = np.zeros((columns.shape[1], size))
    padded[:, :n] = columns.T
    base = padded.mean(axis=1)
    blocks, details = (padded - base[:, None])[:, None, :], []
    for _ in range(depth):
        pair = np.stack([blocks, np.roll(blocks, 1, axis=2)], axis=2)
        low, high = db2_level(pair)
        details.append(high)
        blocks = low.reshape(len(low), -1, low.shape[-1])
    for level in range(depth - 1):
        # The two halves of a block are blocks of the next level.
        own = details[level].reshape(-1, details[level].shape[-1])
        known = own[:, : min(n >> (level + 1), own.shape[1])]
        q1, q3 = np.quantile(known, [0.25, 0.75], axis=1)[:, :, None]
        own[(own < q1 - iqr * (q3 - q1)) | (own > q3 + iqr * (q3 - q1))] = 0
    for high in reversed(details):
        both = db2_merge(blocks.reshape(high.shape), high)
        blocks = (both[:, :, 0] + np.roll(both[:, :, 1], -1, axis=2)) / 2
    out = blocks[:, 0, :n].T + base
    return out[:, 0] if x.ndim == 1 else out


def smoothing_spline(t: np.ndarray, y: np.ndarray, p: float) -> np.ndarray:
    """Values of the cubic smoothing spline at its sites ``t``: second derivatives from a five-diagonal system.

    The columns of a matrix ``y`` share the sites, and the elimination.
    """
    n = len(t)
    if n <= 2 or p == 1:
        return y.copy()
    h, m = np.diff(t), n - 2
    inv = 1 / h
    mid = -(inv[:-1] + inv[1:])
    k = 6 * (1 - p)
    bands = [
        k * (inv[:-1] ** 2 + mid**2 + inv[1:] ** 2) + 2 * p * (h[:-1] + h[1:]),
        k * (mid[:-1] * inv[1:-1] + inv[1:-1] * mid[1:]) + p * h[1:-1],
        k * inv[1:-2] * inv[2:-1],
    ]
    # Symmetric elimination L D L' with two bands below the diagonal.
    d, l1, l2 = np.zeros(m + 2), np.zeros(m + 2), np.zeros(m + 2)
    across = (slice(None),) + (None,) * (y.ndim - 1)
    z = np.zeros((m + 2, *y.shape[1:]))  # two rows of zeros in front
    rhs = np.diff(np.diff(y, axis=0) * inv[across], axis=0)
    for i in range(m):
        if i >= 2:
            l2[i] = bands[2][i - 2] / d[i - 2]
        if i >= 1:
            l1[i] = (bands[1][i - 1] - (l2[i] * d[i - 2] * l1[i - 1] if i >= 2 else 0)) / d[i - 1]
        d[i] = bands[0][i] - (l1[i] ** 2 * d[i - 1] if i >= 1 else 0) - (l2[i] ** 2 * d[i - 2] if i >= 2 else 0)
        z[i + 2] = rhs[i] - l1[i] * z[i + 1] - l2[i] * z[i]
    u = np.zeros((n + 2, *y.shape[1:]))  # one row of zeros in front, three behind
    for i in range(m - 1, -1, -1):
        u[i + 1] = z[i + 2] / d[i] - l1[i + 1] * u[i + 2] - l2[i + 2] * u[i + 3]
    none = np.zeros((1, *y.shape[1:]))
    bend = np.diff(np.concatenate([none, np.diff(u[:n], axis=0) * inv[across], none]), axis=0)
    return y - k * bend


def _reach(n: int, fs: float) -> int:
    """Samples that stand for the level of a stretch of ``n``."""
    if n < 0.3 * fs:
        return n
    return max(1, int(0.3 * fs) if n < 3 * fs else n // 10)


def spline_repair(y: np.ndarray, t: np.ndarray, bad: np.ndarray, fs: float, p: float = 0.99) -> np.ndarray:
    """Masked stretches lose their smooth part; then every stretch is set to the level where the last one ends.

    Columns are channels.  Masked stretches of one length, of whatever channel,
    are fitted together, where the times ``t`` are even.
    """
    one = y.ndim == 1
    y, bad = (y[:, None], bad[:, None]) if one else (y, bad)
    if bad.all(axis=0).any():
        raise ValueError("spline repair needs at least one clean sample")
    out = y.astype(float).copy()
    edges = [np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1, [len(y)]]).tolist() for column in bad.T]
    steps = np.diff(t)
    even = bool(np.allclose(steps, steps[:1], rtol=1e-9, atol=0)) if len(steps) else True
    by_size: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for c, cuts in enumerate(edges):
        for a, b in zip(cuts[:-1], cuts[1:]):
            if bad[a, c]:
                by_size.setdefault((b - a, 0 if even else a), []).append((a, c))
    for (size, first), places in by_size.items():
        at = np.array([a for a, _ in places]) + np.arange(size)[:, None]
        column = np.array([c for _, c in places])
        out[at, column] -= smoothing_spline(t[first : first + size], y[at, column], p)
    for c, cuts in enumerate(edges):
        stretches = list(zip(cuts[:-1], cuts[1:]))
        if len(stretches) == 1:
            continue
        head = lambda v: v[: _reach(len(v), fs)].mean()
        tail = lambda v: v[-_reach(len(v), fs) :].mean()
        for i, (a, b) in enumerate(stretches):
            if i:
                out[a:b, c] += tail(out[stretches[i - 1][0] : a, c]) - head(out[a:b, c])
            elif bad[0, c]:  # nothing before it: the clean stretch behind gives the level
                out[a:b, c] += head(y[b : stretches[1][1], c]) - tail(out[a:b, c])
    return out[:, 0] if one else out


# Quality -------------------------------------------------------------------


def spectrum(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided power density under a Hamming window, along the last axis."""
    n = x.shape[-1]
    w = np.hamming(n)
    power = np.abs(np.fft.rfft((x - x.mean(axis=-1, keepdims=True)) * w)) ** 2 / (fs * (w @ w))
    lines = power.shape[-1]
    power[..., 1 : lines - (n % 2 == 0)] *= 2
    return np.arange(lines) * fs / n, power


def band_power(f: np.ndarray, p: np.ndarray, bands: list[tuple[float, float]]) -> float:
    """Integral of the power over the bands; its edges are interpolated."""
    total = 0.0
    for lo, hi in bands:
        grid = np.concatenate([[lo], f[(f > lo) & (f < hi)], [hi]])
        total += float(np.trapezoid(np.interp(grid, f, p), grid))
    return total


def snr_db(x: np.ndarray, fs: float, cardiac: tuple[float, float], noise: list[tuple[float, float]]) -> float:
    f, p = spectrum(x, fs)
    signal, rest = band_power(f, p, [cardiac]), band_power(f, p, noise)
    if not (signal > 0 and rest > 0):
        raise ValueError("the ratio needs power in the signal band and in the noise band")
    return 10 * math.log10(signal / rest)


def peak_power(x: np.ndarray, y: np.ndarray, fs: float) -> np.ndarray | float:
    """Highest power density of the cross-correlation of two scaled signals, along the last axis; 0 where one hardly varies."""
    n = x.shape[-1]
    sd = [v.std(axis=-1, ddof=1) for v in (x, y)]
    flat = [s <= ROOT_EPS * np.maximum(1.0, np.abs(v).max(axis=-1)) for s, v in zip(sd, (x, y))]
    live = ~(flat[0] | flat[1])
    unit = [v / np.where(live, s, 1.0)[..., None] for s, v in zip(sd, (x, y))]
    size = 1 << (2 * n - 1).bit_length()  # circular without overlap
    ring = np.fft.irfft(np.fft.rfft(unit[0], size) * np.conj(np.fft.rfft(unit[1], size)), size)
    both = np.concatenate([ring[..., size - n + 1 :], ring[..., :n]], axis=-1) / n
    out = np.where(live, spectrum(both, fs)[1].max(axis=-1), 0.0)
    return float(out) if out.ndim == 0 else out
