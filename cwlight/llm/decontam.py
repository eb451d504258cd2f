"""Benchmark passages in documents: q-gram lemma filter, then banded alignment.

Texts and items are compared in a plain form: ASCII letters in lower case, every
run of ASCII signs and blanks as one blank.  An item of m bytes may occur with
k = floor(RATE * m) edits.  By the q-gram lemma such an occurrence shares at
least m + 1 - q - k * q q-grams with the item, all within k + 1 neighbouring
diagonals.  Diagonals are counted in bands of twice that width that overlap by
half, so one band holds them all; bands with enough hits are verified by
semi-global alignment within the band.

Items whose plain form has fewer than ``LEAST`` bytes leave no room for edits: they
are sought as whole words in sequence, exactly, by hashes of word sequences that
are then compared.  ``matches`` reports them like the others; for ``drop_leaks``
they count from ``LEAK_WORDS`` words on, as a word or two is no sign of a leak.

Every occurrence counts.  Occurrences of one item that overlap are one region:
the stretch that those with the fewest edits among them cover.

The items are a stated query set.  They are read in blocks of at most
``BLOCK_BYTES``; every block is a broadcast of that bound and one pass over the
documents, and its rows are written before the next block is read, so the driver
holds one block however many items there are.  Within a task, hits are counted
in slices of about ``HITS``, so that a text and an item that repeat one letter
take time but no memory.

Defined cases: null and empty texts match nothing, nor do items without a letter
or digit; repeated items and rows are all reported, also with a null id; no items
or no documents give no rows.  Columns other than doc_id, text and item_id, text are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cwlight.llm.common import cut, pieces, text_buffer
from cwlight.llm.wordhash import grams, mix, words

Q, RATE, LEAST, BLOCK_BYTES, PIECE, HITS = 12, 0.05, 24, 4 << 20, 1 << 20, 1 << 20
#: Words from which a short item, found exactly, makes a document a leak.
LEAK_WORDS = 3
FAR = 1 << 30
MATCH = "doc_id long, item_id long, start long, end long, edits int"


def _forms() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    keep = (out >= 128) | ((out >= 48) & (out <= 57)) | ((out >= 97) & (out <= 122))
    out[~keep] = 32
    return out


FORM = _forms()
CODE = mix(np.arange(1, 257, dtype=np.uint64))


def plain(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(plain bytes, row bounds in them, place of each in ``raw``); rows begin and end without blanks."""
    x = FORM[raw]
    blank = x == 32
    first = np.zeros(len(x) + 1, bool)
    first[offsets[:-1]] = True
    keep = ~blank
    keep[1:] |= ~blank[:-1] & ~first[1:-1]
    at = np.flatnonzero(keep)
    bounds = np.searchsorted(at, offsets)
    return x[at], bounds, at


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        raw, offsets = text_buffer(pa.array([t for _, t in items], pa.string()))
        text, bounds, _ = plain(raw, offsets)
        forms = [text[a:b].tobytes().strip() for a, b in zip(bounds[:-1], bounds[1:])]
        self.short: dict[int, dict[int, list[tuple[int, bytes]]]] = {}  # words of an item, hash of their sequence
        for (item_id, _), f in zip(items, forms):
            if 0 < len(f) < LEAST:
                h = words(np.frombuffer(f, np.uint8), np.array([0, len(f)]), plain=True)[0]
                self.short.setdefault(len(h), {}).setdefault(int(grams(h, len(h))[0]), []).append((item_id, f))
        kept = [i for i, f in enumerate(forms) if len(f) >= LEAST]
        self.ids, self.texts = [items[i][0] for i in kept], [np.frombuffer(forms[i], np.uint8) for i in kept]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.floor(RATE * self.size).astype(np.int64)
        self.need = self.size + 1 - Q - self.edits * Q
        self.shift = np.ceil(np.log2(2 * (self.edits + 1))).astype(np.int64)
        h = [grams(CODE[t], Q) for t in self.texts]
        item = np.repeat(np.arange(len(h)), [len(x) for x in h])
        place = np.concatenate([np.arange(len(x)) for x in h] + [np.zeros(0, np.int64)])
        flat = np.concatenate([*h, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.start = np.unique(flat[order], return_index=True)
        self.stop = np.append(self.start[1:], len(flat))
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def short_ones(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item id, start, end in bytes of the row, words) of the exact occurrences of short items."""
        h, starts, ends, bounds = words(raw, offsets, lower=True, plain=True)
        for count, known in self.short.items():
            runs = grams(h, count)
            keys = np.sort(np.array(list(known), np.uint64))
            k = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
            for i in np.flatnonzero(keys[k] == runs).tolist():
                row = int(np.searchsorted(bounds, i, "right")) - 1
                if i + count > bounds[row + 1]:
                    continue
                a, b = int(starts[i]), int(ends[i + count - 1])
                body = plain(raw[a:b], np.array([0, b - a]))[0].tobytes()
                for item_id, form in known[int(runs[i])]:
                    if body == form:
                        yield row, item_id, a - int(offsets[row]), b - int(offsets[row]), count

    def candidates(self, text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first diagonal of its band) of the bands with enough hits; diagonals are places in ``text``."""
        h = grams(CODE[text], Q)
        at = np.flatnonzero(self.seen[(h >> np.uint64(42)).astype(np.int64)])
        k = np.searchsorted(self.keys, h[at])
        real = (k < len(self.keys)) & (self.keys[np.minimum(k, len(self.keys) - 1)] == h[at])
        at, k = at[real], k[real]
        count = self.stop[k] - self.start[k]
        ends = np.cumsum(count)
        cuts = np.unique(np.searchsorted(ends, np.arange(HITS, int(ends[-1]) + HITS, HITS))) if len(k) else np.zeros(0, int)
        total: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2
        a = 0
        for b in (np.minimum(cuts, len(k) - 1) + 1).tolist():
            n, first = count[a:b], self.start[k[a:b]]
            post = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            item, diagonal = self.item[post], np.repeat(at[a:b], n) - self.place[post] + FAR
            shift = self.shift[item]
            for half in (0, 1):
                key, n_key = np.unique((item << 34) | ((diagonal + (half << shift >> 1)) >> shift), return_counts=True)
                total[half] = _added(*total[half], key, n_key)
            a = b
        found_item, found_band = [], []
        for half, (key, n) in enumerate(total):
            i = key >> 34
            good = n >= self.need[i]
            i, band = i[good], (key & ((1 << 34) - 1))[good]
            found_item.append(i)
            found_band.append((band << self.shift[i]) - (half << self.shift[i] >> 1) - FAR)
        return np.concatenate(found_item), np.concatenate(found_band)

    def aligned(self, item: int, text: np.ndarray, low: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best occurrence in ``text`` on diagonals from ``low`` on, if within budget.

        Of exact ones, which overlap if there are several, the stretch they cover.
        """
        pattern, k, width = self.texts[item], int(self.edits[item]), 1 << int(self.shift[item])
        body = text.tobytes()
        bounds = max(0, low), max(0, low + width) + len(pattern)
        exact = body.find(pattern.tobytes(), *bounds)
        if exact >= 0:
            return 0, exact, body.rfind(pattern.tobytes(), *bounds) + len(pattern)
        lo, span = low - k, width + 2 * k + 1
        far = np.int64(1 << 20)
        col = np.arange(span)
        # cost[j]: pattern[:i] against a stretch of text that ends at place i + lo + j; start[j]: where it begins.
        end = lo + col
        cost = np.where((end >= 0) & (end <= len(text)), 0, far)
        start = end.copy()
        pack = cost * (1 << 32) + (start + (1 << 20))
        one = np.int64(1 << 32)
        for i in range(1, len(pattern) + 1):
            end = i + lo + col
            inside = (end >= 1) & (end <= len(text))
            same = np.zeros(span, bool)
            same[inside] = text[end[inside] - 1] == pattern[i - 1]
            new = np.where(inside, pack + np.where(same, 0, one), far * one)
            new[:-1] = np.minimum(new[:-1], pack[1:] + one)
            new = np.where((end >= 0) & (end <= len(text)), new, far * one)
            pack = np.minimum.accumulate(new - col * one) + col * one
        j = int(pack.argmin())
        edits = int(pack[j] >> 32)
        return (edits, int(pack[j] & (one - 1)) - (1 << 20), len(pattern) + lo + j) if edits <= k else None


def _added(key: np.ndarray, n: np.ndarray, more: np.ndarray, n_more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of two sets of distinct keys, added up."""
    if not len(key):
        return more, n_more
    both, at = np.unique(np.concatenate([key, more]), return_inverse=True)
    return both, np.bincount(at, np.concatenate([n, n_more])).astype(np.int64)


def regions(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Occurrences (edits, start, end), each group that overlaps as one: the fewest edits, and what those with so few cover."""
    out: list[list[int]] = []  # edits, start, end, end of the group
    for edits, start, end in sorted(found, key=lambda x: (x[1], x[2])):
        if not out or start >= out[-1][3]:
            out.append([edits, start, end, end])
            continue
        last = out[-1]
        if edits < last[0]:
            last[:3] = edits, start, end
        elif edits == last[0]:
            last[2] = max(last[2], end)
        last[3] = max(last[3], end)
    return [(e, a, b) for e, a, b, _ in out]


def _matches(index: Index, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, place of the item, start, end in bytes of the row, edits) of every region."""
    text, bounds, at = plain(raw, offsets)
    found: dict[tuple[int, int], set[tuple[int, int, int]]] = {}
    if len(text) < Q or not len(index.keys):
        return []
    for item, band in set(zip(*(x.tolist() for x in index.candidates(text, bounds)))):
        # The band may reach over the edge of a row: every row it touches is tried.
        width, size = 1 << int(index.shift[item]), int(index.size[item])
        r0 = max(0, int(np.searchsorted(bounds, max(0, band), "right")) - 1)
        r1 = int(np.searchsorted(bounds, min(len(text) - 1, max(0, band + width + size)), "right")) - 1
        for row in range(r0, min(r1, len(bounds) - 2) + 1):
            a, b = int(bounds[row]), int(bounds[row + 1])
            if b - a < size - index.edits[item]:
                continue
            lo, hi = max(a, band - 2 * width), min(b, band + size + 3 * width)
            got = index.aligned(item, text[lo:hi], band - lo) if hi > lo else None
            if got and got[2] > got[1]:
                found.setdefault((row, item), set()).add((got[0], lo + got[1], lo + got[2]))
    out = []
    for (row, item), places in sorted(found.items()):
        for edits, a, b in regions(list(places)):
            out.append((row, item, int(at[a] - offsets[row]), int(at[b - 1] + 1 - offsets[row]), edits))
    return out


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items, in lists of at most ``most`` bytes (a longer item stands alone), one list at a time."""
    held, size = [], 0
    rows = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for r in rows.toLocalIterator():
        n = len(r["text"].encode())
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += n
    if held:
        yield held


def _passes(benchmark: DataFrame, one_pass) -> Iterator[DataFrame]:
    """``one_pass(index)`` for each block of items; with several blocks each result is written before the next block is read."""
    spark, held, many = benchmark.sparkSession, blocks(benchmark), False
    items = next(held, None)
    while items is not None:
        shared = spark.sparkContext.broadcast(Index(items))
        items = next(held, None)
        many = many or items is not None
        out = one_pass(shared)
        yield cut(out) if many else out


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per region of a document in which an item occurs: place in code points (end exclusive) and edits."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def one_pass(shared) -> DataFrame:
        def run(batches):
            index = shared.value
            for batch in batches:
                raw, offsets = text_buffer(batch.column(1))
                out: list[list] = [[] for _ in range(5)]
                for a, b in pieces(offsets, PIECE):
                    held = raw[offsets[a] : offsets[b]]
                    bounds = offsets[a : b + 1] - offsets[a]
                    found = [(row, index.ids[item], first, last, edits) for row, item, first, last, edits in _matches(index, held, bounds)]
                    found += [(row, item, first, last, 0) for row, item, first, last, _ in index.short_ones(held, bounds)]
                    for row, item, first, last, edits in found:
                        body = raw[offsets[a + row] : offsets[a + row + 1]]
                        lead = (body & 0xC0) != 0x80
                        start = int(lead[:first].sum())
                        for column, value in zip(out, (batch.column(0)[a + row].as_py(), item, start, start + int(lead[first:last].sum()), edits)):
                            column.append(value)
                types = [pa.int64()] * 4 + [pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["doc_id", "item_id", "start", "end", "edits"])

        return rows.mapInArrow(run, MATCH)

    found = None
    for out in _passes(benchmark, one_pass):
        found = out if found is None else found.unionByName(out)
    return docs.sparkSession.createDataFrame([], MATCH) if found is None else found


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows in whose text an item occurs; each row is judged by its own text.

    One block of items is a filter.  With several blocks each marks texts by
    their hashes (128 bits), and all that are marked go at once, so that no text
    is written for a block.
    """
    out = docs.withColumn("text", F.col("text").cast("string"))

    def leaks(index: Index, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        found = np.zeros(len(offsets) - 1, bool)
        for a, b in pieces(offsets, PIECE):
            held, bounds = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            rows = [row for row, *_ in _matches(index, held, bounds)]
            rows += [row for row, *_, count in index.short_ones(held, bounds) if count >= LEAK_WORDS]
            found[a + np.array(rows, int)] = True
        return found

    def kept(shared) -> DataFrame:
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(~leaks(shared.value, *text_buffer(batch.column("text")))))

        return out.mapInArrow(run, out.schema)

    def marked(shared) -> DataFrame:
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(leaks(shared.value, *text_buffer(batch.column(0)))))

        texts = out.where("text IS NOT NULL").select("text").mapInArrow(run, "text string")
        return texts.select(*_hashes("text")).distinct()

    held = blocks(benchmark)
    first, second = next(held, None), next(held, None)
    if second is None:
        return out if first is None else kept(out.sparkSession.sparkContext.broadcast(Index(first)))
    gone = None
    for some in _passes(benchmark, marked):
        gone = some if gone is None else gone.union(some)
    names = [f"{c}__leak" for c in ("h", "k")]
    away = gone.distinct().toDF(*names)
    same = [F.coalesce(h, F.lit(0)) == F.col(n) for h, n in zip(_hashes("text"), names)]
    return out.join(away, same, "left_anti")


def _hashes(text: str) -> list:
    """Two independent 64-bit hashes of a text."""
    return [F.xxhash64(F.lit(7), F.col(text)), F.xxhash64(F.col(text), F.lit("leak"))]
