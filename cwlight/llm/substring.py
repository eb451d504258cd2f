"""Removal of long word sequences that occur more than once, by fixed-block anchors.

With blocks of half a window, rounded up, every window of ``window`` words
holds one whole block of the grid 0, b, 2b, ... of its document.  So:

1. Documents are dealt into packs of about ``PACK_BYTES`` by a hash.  Each pack
   sends every distinct rolling run of b words once, as a hash marked where the
   run is a block of the grid somewhere in the pack and where it occurs there
   twice; runs meet by hash range, not by document.
2. A run that occurs at two places, one of them a grid block, is a hit.  The
   pack is told the first place of the run and finds the others by itself.
3. Around the hits a pack extends to whole windows and sends each distinct one,
   again once and by a hash; a window that occurs twice is a repeat.  Runs of
   such windows are the maximal repeats of at least ``window`` words.
4. Each pack removes the words its repeated windows cover.

What decides a removal is a hash of 127 bits of the window's words, two
independent ones of 64 and 63: with 1e13 windows two different ones agree with
a probability below 1e-12.  Hashes of blocks (30 bits beside their range) only
choose which windows are looked at.

Rows of the exchanges are packed cells (one pack, one hash range; see
``cell_sizes``), so bytes per probe are about five.  A passage in a third of all
documents adds at most one probe for each pack to its range, 7 MB at 100 TB.
The texts themselves are shuffled once; Spark reuses that exchange for all
three passes.

Defined cases: a null or blank text has no words; texts shorter than a window
lose nothing; repeated rows repeat each other, also with the same doc_id, and
are dealt into different packs by their place in the table (so ``docs`` should be
a table whose rows come in the same order when a task runs again, as those of
files do).  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cwlight.llm.common import text_buffer, total_bytes
from cwlight.llm.wordhash import grams, mix, words

#: Bytes of text in a pack and in a hash range, at least; probes in one cell of the two on average, at least.
PACK_BYTES, RANGE_BYTES, CELL_PROBES = 2 << 20, 16 << 20, 64
CELL = "part int, pack int, n int, body binary"
FOUND = "pack int, body binary"
FILL, OTHER = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0x5851F42D4C957F2D)
GAP = 255
#: Marks of a run in its pack: a block of the grid, met twice.
GRID, TWICE = 1, 2


def cell_sizes(total: int) -> tuple[int, int]:
    """Bytes of a pack and of a range for ``total`` bytes of text.

    There are packs times ranges cells, so beyond some 80 GB both grow with the
    square root of the text; a cell then keeps its probes (one per six bytes or
    so) and the rows of an exchange grow in proportion to the text.  100 TB give
    packs of 70 MB and ranges of 550 MB.
    """
    grow = max(1.0, math.sqrt(6 * CELL_PROBES * total / (PACK_BYTES * RANGE_BYTES)))
    return int(PACK_BYTES * grow), int(RANGE_BYTES * grow)


def _cells(pack: int, places: np.ndarray, ranges: np.ndarray, keys: list[np.ndarray], parts: int) -> pa.Table:
    """One row per hash range (chosen by the high bits of ``ranges``): the keys, then each place's distance from the last as one byte.

    A distance of 255 or more is bridged by entries whose first key is ``FILL``.
    """
    part = (((ranges >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((places, part))
    places, part, keys = places[order], part[order], [k[order] for k in keys]
    cuts = np.flatnonzero(np.diff(part)) + 1
    heads = np.concatenate([[0], cuts]) if len(part) else np.zeros(0, np.int64)
    before = np.empty_like(places)
    before[1:] = places[:-1]
    before[heads] = 0
    gaps = places - before
    extra = gaps // GAP
    at = np.arange(len(gaps)) + np.cumsum(extra)
    size = len(gaps) + int(extra.sum())
    columns = [np.full(size, FILL.astype(k.dtype)) for k in keys] + [np.full(size, GAP, np.uint8)]
    for column, values in zip(columns, [*keys, gaps - extra * GAP]):
        column[at] = values
    ends = np.concatenate([at[cuts - 1] + 1, [size]]) if len(part) else np.zeros(0, np.int64)
    rows, a = [], 0
    for b in ends.tolist():
        rows.append(b"".join(column[a:b].tobytes() for column in columns))
        a = b
    return pa.table(
        {
            "part": pa.array(part[heads], pa.int32()),
            "pack": pa.array(np.full(len(heads), pack), pa.int32()),
            "n": pa.array(np.diff(np.concatenate([[0], ends])), pa.int32()),
            "body": pa.array(rows, pa.binary()),
        }
    )


def _opened(cells: pa.Table, kinds: list[type]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(row of the cell, place in its pack, keys) of every entry."""
    keys, places, owner = [[np.zeros(0, k)] for k in kinds], [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
    for i, (n, body) in enumerate(zip(cells["n"].to_pylist(), cells["body"].to_pylist())):
        at, real = 0, None
        for column, kind in zip(keys, kinds):
            k = np.frombuffer(body, kind, n, at)
            real = k != FILL.astype(kind) if real is None else real
            column.append(k[real])
            at += k.nbytes
        places.append(np.cumsum(np.frombuffer(body, np.uint8, n, at), dtype=np.uint32)[real])
        owner.append(np.full(len(places[-1]), i, np.int32))
    return np.concatenate(owner), np.concatenate(places), [np.concatenate(k) for k in keys]


def _answers(cells: pa.Table, owner: np.ndarray, places: np.ndarray) -> pa.Table:
    """The found places of each cell, as rows for its pack."""
    order = np.argsort(owner, kind="stable")
    owner, places = owner[order], places[order]
    heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    packs = cells["pack"].to_numpy()
    bodies = [x.tobytes() for x in np.split(places, heads[1:])] if len(owner) else []
    return pa.table({"pack": pa.array(packs[owner[heads]], pa.int32()), "body": pa.array(bodies, pa.binary())})


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start of each group of equal keys in it, size of each group); the order is stable."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        ranked = k[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    new[:1] = True
    starts = np.flatnonzero(new)
    return order, starts, np.diff(np.concatenate([starts, [len(order)]]))


def _block_hits(cells: pa.Table) -> pa.Table:
    """Entries whose run occurs twice or more, once at least as a grid block."""
    owner, places, (keys,) = _opened(cells, [np.uint32])
    if not len(keys):
        return _answers(cells, owner, places)
    order, starts, sizes = _groups(keys >> np.uint32(2))
    marks = np.bitwise_or.reduceat(keys[order], starts)
    good = ((sizes > 1) | (marks & np.uint32(TWICE) > 0)) & (marks & np.uint32(GRID) > 0)
    hit = order[np.repeat(good, sizes)]
    return _answers(cells, owner[hit], places[hit])


def _window_hits(cells: pa.Table) -> pa.Table:
    """Entries whose window occurs twice or more."""
    owner, places, (first, second) = _opened(cells, [np.uint64, np.uint64])
    if not len(first):
        return _answers(cells, owner, places)
    order, starts, sizes = _groups(first, second >> np.uint64(1))
    twice = (sizes > 1) | (np.bitwise_or.reduceat(second[order], starts) & np.uint64(1) > 0)
    hit = order[np.repeat(twice, sizes)]
    return _answers(cells, owner[hit], places[hit])


class _Pack:
    """The documents of one pack in a fixed order, as words."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
        self.ids = rows["doc_id"].combine_chunks()
        raw, offsets = text_buffer(rows["text"])
        self.raw = np.insert(raw, offsets[1:], np.uint8(32))  # a blank follows every word
        self.offsets = offsets + np.arange(len(offsets))
        self.hashes, self.starts, self.ends, self.bounds = words(self.raw, self.offsets)
        self.sizes = np.diff(self.bounds)

    def first(self, width: int, window: int) -> np.ndarray:
        """Where a run of ``width`` words starts, in documents of ``window`` words or more."""
        place = np.arange(len(self.hashes)) - np.repeat(self.bounds[:-1], self.sizes)
        size = np.repeat(self.sizes, self.sizes)
        return np.flatnonzero((size >= window) & (place + width <= size))

    def grid(self, places: np.ndarray, block: int) -> np.ndarray:
        return (places - np.repeat(self.bounds[:-1], self.sizes)[places]) % block == 0


def _window_hashes(pack: _Pack, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each run of ``window`` words: of 64 bits, and of 63 from the second bit on."""
    first, second = grams(pack.hashes, window), grams(mix(pack.hashes ^ OTHER), window)
    first[first == FILL] = 0
    return first, second & ~np.uint64(1)


def _told(found: pa.Table) -> np.ndarray:
    """The places that were answered."""
    return np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.uint32).astype(np.int64) for x in found["body"].to_pylist())])


def block_probes(number: int, pack: _Pack, block: int, window: int, parts: int) -> pa.Table:
    """Cells of the distinct runs of ``block`` words of a pack."""
    places = pack.first(block, window)
    h = grams(pack.hashes, block)[places]
    order, starts, sizes = _groups(h)
    if not len(h):
        return _cells(number, places, h, [h.astype(np.uint32)], parts)
    grid = np.maximum.reduceat(pack.grid(places, block)[order], starts)
    one = order[starts]
    key = (h[one] & ~np.uint64(3)) | grid.astype(np.uint64) * np.uint64(GRID) | (sizes > 1).astype(np.uint64) * np.uint64(TWICE)
    key = key.astype(np.uint32)
    key[key == FILL.astype(np.uint32)] ^= np.uint32(4)  # kept for FILL
    return _cells(number, places[one], h[one], [key], parts)


def window_probes(number: int, pack: _Pack, told: np.ndarray, block: int, window: int, parts: int) -> pa.Table:
    """Cells of the distinct windows that hold a run told to be a hit."""
    n = len(pack.hashes)
    places = pack.first(block, window)
    h = grams(pack.hashes, block)[places]
    hit = np.zeros(n + 1, np.int64)
    hit[places[np.isin(h, h[np.searchsorted(places, told)])]] = 1
    before = np.concatenate([[0], np.cumsum(hit)])
    places = pack.first(window, window)
    places = places[before[places + window - block + 1] > before[places]]
    first, second = (x[places] for x in _window_hashes(pack, window))
    order, starts, sizes = _groups(first, second)
    one = order[starts]
    return _cells(number, places[one], first[one], [first[one], second[one] | (sizes > 1).astype(np.uint64)], parts)


def repeated_windows(pack: _Pack, told: np.ndarray, window: int) -> np.ndarray:
    """Where the windows start that are equal to one at a told place."""
    if not len(told):
        return told
    first, second = _window_hashes(pack, window)
    places = pack.first(window, window)
    places = places[np.isin(first[places], first[told])]
    asked = np.zeros(len(pack.hashes), bool)
    asked[told] = True
    order, starts, sizes = _groups(first[places], second[places])
    good = np.maximum.reduceat(asked[places][order], starts)
    return places[order[np.repeat(good, sizes)]]


def _kept(pack: _Pack, starts: np.ndarray, window: int) -> pa.Table:
    """What stays of each document once the words under windows at ``starts`` are gone."""
    n = len(pack.hashes)
    delta = np.zeros(n + 1, np.int64)
    delta[starts] += 1  # distinct places
    delta[starts + window] -= 1
    keep = np.cumsum(delta[:n]) == 0
    edge = np.zeros(len(pack.raw) + 1, np.int8)
    edge[pack.starts[keep]] += 1
    edge[pack.ends[keep] + 1] -= 1  # with the blank that follows
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    left = pack.raw[inside]
    left[(left >= 9) & (left <= 13)] = 32
    counts = np.concatenate([[0], np.cumsum(inside)])[pack.offsets]
    body = left.tobytes()
    stays = np.concatenate([[0], np.cumsum(keep)])[pack.bounds]
    text = [body[a : max(a, b - 1)] for a, b in zip(counts[:-1].tolist(), counts[1:].tolist())]
    sha = [hashlib.sha256(x).hexdigest() for x in text]
    return pa.table(
        {
            "doc_id": pack.ids,
            "n_words": pa.array(pack.sizes, pa.int64()),
            "n_removed": pa.array(pack.sizes - np.diff(stays), pa.int64()),
            "kept_sha256": pa.array(sha, pa.string()),
            "kept": pa.array(text, pa.binary()).cast(pa.string()),
        }
    )


def remove_repeats(docs: DataFrame, window: int = 35, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) of every row of ``docs``.

    ``kept`` is the text that stays: words joined by one space.
    """
    block = (window + 1) // 2
    total = total_bytes(docs)
    packs, parts = (total // size + 1 for size in cell_sizes(total))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The row's place takes part, so that rows said over and over are dealt into many packs.
    rows = rows.withColumn("pack", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(packs)).cast("int"))

    def probes(key, table):
        return block_probes(key[0].as_py(), _Pack(table), block, window, parts)

    def windows(key, table, found):
        if not table.num_rows or not found.num_rows:
            none = np.zeros(0, np.uint64)
            return _cells(0, np.zeros(0, np.int64), none, [none, none], parts)
        return window_probes(key[0].as_py(), _Pack(table), _told(found), block, window, parts)

    def finish(key, table, found):
        pack = _Pack(table)
        out = _kept(pack, repeated_windows(pack, _told(found), window), window)
        return out if with_text else out.drop_columns(["kept"])

    def at_pack(df: DataFrame):
        return df.groupBy("pack")

    hits = at_pack(rows).applyInArrow(probes, CELL).groupBy("part").applyInArrow(_block_hits, FOUND)
    grown = at_pack(rows).cogroup(at_pack(hits)).applyInArrow(windows, CELL)
    repeats = grown.groupBy("part").applyInArrow(_window_hits, FOUND)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return at_pack(rows).cogroup(at_pack(repeats)).applyInArrow(finish, schema)
