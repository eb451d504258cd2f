"""Periodic runs of words: stretches that repeat a short sequence four times or more.

A run of period q and length L >= max(6, 4q) agrees with itself shifted by q at
L - q >= 3q places in a row, so each such stretch holds a multiple of 3q,
counted from the document's start.  Hence the harmonic grid: for every period p
the points 0, 3p, 6p, ..., n/3 * ln(n) pairs (point, period) in all.

1. Words become numbers, exactly (Arrow's dictionary), and their hashes running
   sums, so that any two stretches compare in constant time.
2. Pairs whose words differ at the point go; so do those that agree for half
   of the least stretch neither before nor behind it.
3. For all pairs left at once a binary search finds how far the agreement
   reaches to both sides (LCE).
4. Runs found from several points, or by multiples of their period, are one:
   of equal stretches the least period stays.  Its words are compared one by
   one; if a hash has erred, the document is searched without hashes.

Work goes over pieces of about ``PIECE`` bytes of text, many documents at once; a
longer text stands alone, with memory in proportion to it.  Pairs are made
``PAIRS`` at a time.  Nothing is shuffled, and a task that is lost runs again by
itself.

Defined cases: a null, empty or blank text has no words and no runs; repeated
rows are judged each by itself, also where they share a doc_id; a null doc_id
stays null; an empty table gives no rows.  Columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cwlight.llm.common import pieces, text_buffer
from cwlight.llm.wordhash import ODD, mix, powers

PIECE, PAIRS = 2 << 20, 1 << 20
#: A run has this many words and this many periods at least.
LEAST, TIMES = 6, 4
WORD = r"[^\x20\x09-\x0D]+"


def numbered(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of each word, bounds of the rows, the words): equal numbers mean equal words."""
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = offsets[:-1]
    heads = heads[heads < len(raw)]
    first[heads] = solid[heads]
    starts = np.flatnonzero(first)
    before = np.cumsum(solid, dtype=np.int32)[starts] - 1 if len(starts) else np.zeros(0, np.int32)
    letters = raw[solid]
    ends = np.concatenate([before, [len(letters)]]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32), np.searchsorted(starts, offsets), words


class _Stretches:
    """Comparison of stretches of one sequence by prefix hashes."""

    def __init__(self, ids: np.ndarray) -> None:
        self.up = powers(len(ids) + 1)[0]
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(mix((ids.astype(np.uint64) + np.uint64(1)) * ODD) * self.up[: len(ids)], out=self.sums[1:])

    def same(self, at: np.ndarray, shift: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` words from ``at`` equal those ``shift`` further on."""
        s = self.sums
        return (s[at + size] - s[at]) * self.up[shift] == s[at + shift + size] - s[at + shift]

    def reach(self, at: np.ndarray, shift: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from ``at`` on (or before it) equal those ``shift`` further on, ``most`` at most."""
        low, high = np.zeros_like(most), most.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            a, p = at[open_], shift[open_]
            mid = (low[open_] + high[open_] + 1) >> 1
            good = self.same(a - mid if back else a, p, mid)
            low[open_[good]] = mid[good]
            high[open_[~good]] = mid[~good] - 1
            open_ = open_[low[open_] < high[open_]]
        return low


def _shortest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (start, length) once, with its least period; by start, then period."""
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def by_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of one document, without hashes; time grows with the square of its words."""
    found = [np.zeros((3, 0), np.int64)]
    for p in range(1, len(ids) // TIMES + 1):
        equal = np.concatenate([[0], (ids[:-p] == ids[p:]).astype(np.int8), [0]])
        edge = np.diff(equal)
        start, size = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
        good = size + p >= max(LEAST, TIMES * p)
        found.append(np.array([start[good], size[good] + p, np.full(good.sum(), p)]))
    return _shortest(*np.concatenate(found, axis=1))


def runs_of(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in ``ids``, length, period) of the runs of all rows ``bounds[r]:bounds[r + 1]``, by start, then period."""
    none = np.zeros(0, np.int64)
    found = [(none, none, none)]
    size = np.diff(bounds)
    most = size // TIMES
    doc = np.repeat(np.arange(len(size)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = (TIMES - 1) * period
    points = -(-(size[doc] - period) // step)
    ends = np.cumsum(points)
    stretches = _Stretches(ids)
    a = 0
    while a < len(doc):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        count = points[a:b]
        which = np.repeat(np.arange(a, b), count)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        at = bounds[doc[which]] + nth * step[which]
        p = period[which]
        hit = np.flatnonzero(ids[at] == ids[at + p])
        at, p, d = at[hit], p[hit], doc[which[hit]]
        least = np.maximum(LEAST - p, step[which[hit]])
        half = (least + 1) >> 1
        ahead, behind = bounds[d + 1] - at - p, at - bounds[d]
        on = np.flatnonzero(ahead >= half)
        back = np.flatnonzero(behind >= half)
        keep = np.zeros(len(at), bool)
        keep[on] = stretches.same(at[on], p[on], half[on])
        keep[back] |= stretches.same(at[back] - half[back], p[back], half[back])
        at, p, ahead, behind, least = at[keep], p[keep], ahead[keep], behind[keep], least[keep]
        right, left = stretches.reach(at, p, ahead, False), stretches.reach(at, p, behind, True)
        good = left + right >= least
        found.append(_shortest((at - left)[good], (left + right + p)[good], p[good]))
        a = b
    start, length, period = _shortest(*(np.concatenate(x) for x in zip(*found)))
    wrong = {int(np.searchsorted(bounds, s, "right")) - 1 for s, n, p in zip(start.tolist(), length.tolist(), period.tolist()) if not np.array_equal(ids[s : s + n - p], ids[s + p : s + n])}
    for r in wrong:
        keep = (start < bounds[r]) | (start >= bounds[r + 1])
        s, n, p = by_words(ids[bounds[r] : bounds[r + 1]])
        start, length, period = _shortest(np.concatenate([start[keep], s + bounds[r]]), np.concatenate([length[keep], n]), np.concatenate([period[keep], p]))
    return start, length, period


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """Of runs in order of start and period, the first with the greatest length / period, compared exactly."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def runs_in(docs: DataFrame, with_runs: bool = True, with_text: bool = True) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256[, runs][, collapsed]) of every row.

    start to exponent_milli tell of the strongest run and are null without one;
    ``collapsed`` is the text without words behind the first period of a run.
    """

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for a, b in pieces(offsets, PIECE):
                ids, bounds, words = numbered(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                start, length, period = runs_of(ids, bounds)
                change = np.zeros(len(ids) + 1, np.int32)
                np.add.at(change, start + period, 1)
                np.add.at(change, start + length, -1)
                stays = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                ends = pa.array(np.searchsorted(stays, bounds), pa.int32())
                collapsed = pc.binary_join(pa.ListArray.from_arrays(ends, words.take(pa.array(stays))), b" ")
                cuts = np.searchsorted(start, bounds).tolist()
                every, rows = list(zip(start.tolist(), length.tolist(), period.tolist())), {k: [] for k in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256")}
                listed = []
                for lo, hi, at in zip(cuts[:-1], cuts[1:], bounds.tolist()):
                    own = [(s - at, n, p) for s, n, p in every[lo:hi]]
                    top = strongest(own) if own else (None, None, None)
                    for k, v in zip(rows, (len(own), *top, 1000 * top[1] // top[2] if own else None)):
                        rows[k].append(v)
                    rows["runs_sha256"].append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in own).encode()).hexdigest())
                    listed.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                columns = {"doc_id": batch.column(0).slice(a, b - a)}
                columns |= {k: pa.array(v, pa.string() if k == "runs_sha256" else pa.int64()) for k, v in rows.items()}
                columns["collapsed_sha256"] = pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in collapsed], pa.string())
                if with_runs:
                    columns["runs"] = pa.array(listed, pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])))
                if with_text:
                    columns["collapsed"] = collapsed.cast(pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    schema += ", runs array<struct<start: long, length: long, period: long>>" * with_runs + ", collapsed string" * with_text
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def with_echoes(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of ``docs``, where every tenth id, by its crc32 h, ends in an echo of its own words.

    Of n words those from a = floor(h/10) % n on repeat the first
    p = 1 + floor((n - a) / (3 + floor(h/10) % 8)) of them.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    g, n = "(h div 10)", "size(ws)"
    a = f"({g} % {n})"
    p = f"(1 + ({n} - {a}) div (3 + {g} % 8))"
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", h)
    chosen = chosen.withColumn("ws", F.when(F.col("h") % 10 == 0, words))
    # Bounds are computed once for each text, not for each of its words.
    bound = chosen.withColumn("b", F.expr(f"CASE WHEN size(ws) > 0 THEN named_struct('a', {a}, 'p', {p}) END"))
    echo = "array_join(transform(ws, (w, i) -> CASE WHEN i < b.a THEN w ELSE get(ws, CAST(b.a + (i - b.a) % b.p AS INT)) END), ' ')"
    return bound.select("doc_id", F.expr(f"CASE WHEN b IS NOT NULL THEN {echo} ELSE text END").alias("text"))
