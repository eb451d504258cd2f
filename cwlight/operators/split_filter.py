"""Recursive filters over channels of any length: blocks are filtered apart and joined by their states.

A direct-form filter with m past outputs is linear in them, so the state behind
a block is ``M @ state + v``: M depends on the block's length alone, v is what the
block leaves when it starts from rest.  One pass is then

1. each block, with the last inputs of its neighbour, gives v;
2. the states in front of all blocks of a channel follow from these few numbers,
   by composing (M, v) pairs in a tree: pairs of blocks, pairs of pairs, and
   back down;
3. each block runs again, from the state in front of it.

Rows are pieces of blocks, with their samples as lists.  Blocks are dealt out by
hash and come to numpy sorted, many at a time, where those of one length are a
matrix: a short block costs no group and no call of its own.  A task holds a
block with the ``m`` samples beside it, or as many pieces as Arrow sends at once,
and one state of a channel.  Both passes use the same blocks: the second takes
them from the end.  Samples are numbered from 1 without gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cwlight.functions import kernels

KEY = ["recording", "channel"]
BLOCK = [*KEY, "block"]
ROW = "recording long, channel long, block long, sample long, numbers array<long>, value array<double>"
LEFT = "recording long, channel long, block long, count long, v array<double>, start array<double>"
PART = LEFT.replace("block", "node")
STATE = "recording long, channel long, node long, state array<double>"
#: States of a channel that one task composes; more of them go up a level of the tree.
FAN = 1024
#: Samples of a piece at most, which with Arrow's rows of a batch bounds what a task is sent at once.
PIECE = 256


def _changes(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether a row begins a group of ``keys``."""
    of = np.column_stack([rows[k].to_numpy() for k in keys])
    return np.concatenate([[True], (of[1:] != of[:-1]).any(axis=1)])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted ``batches``, cut anew where ``keys`` change: each holds its groups whole, as many as came in one."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        places = np.flatnonzero(_changes(rows, keys))
        if not held or held[-1].slice(len(held[-1]) - 1).select(keys).equals(rows.slice(0, 1).select(keys)):
            places = places[1:]
        if len(places):
            yield pa.concat_tables([*held, rows.slice(0, places[-1])])
            held, rows = [], rows.slice(places[-1])
        held.append(rows)
    if held:
        yield pa.concat_tables(held)


def _alike(rows: pa.Table, at: np.ndarray, backwards: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(blocks, places of the samples that lead in, places of their own) of the blocks beginning ``at`` that have as many of both.

    Places count the samples of all ``rows``; a column is a block, in the direction of the pass.
    """
    n = pc.list_value_length(rows["value"]).to_numpy()
    leads, size = np.add.reduceat(np.where(rows["lead"].to_numpy(), n, 0), at), np.add.reduceat(n, at)
    begin = np.cumsum(size) - size
    for lead, most in sorted(set(zip(leads.tolist(), size.tolist()))):
        if lead < most:  # else it lies behind the last block
            blocks = np.flatnonzero((leads == lead) & (size == most))
            along = np.arange(most)[:, None]
            places = begin[blocks] + (most - 1 - along if backwards else along)
            yield blocks, places[:lead], places[lead:]


def _lists(values: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """``values`` in lists of ``n``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(values))


def _step(b: np.ndarray, a: np.ndarray, before: np.ndarray, x: np.ndarray, hold: bool, state: np.ndarray) -> np.ndarray:
    """Outputs behind ``state`` of blocks ``x``, one a column, with the samples ``before`` them."""
    # A pass that starts less than the memory ago: its first sample, or nothing, stands for what is missing.
    first = before[:1] if len(before) else x[:1]
    missing = np.repeat(first if hold else np.zeros_like(first), len(b) - 1 - len(before), axis=0)
    return kernels.driven(b, a, np.concatenate([missing, before, x]), state)


def _leads(rows: DataFrame, size: int, memory: int, backwards: bool) -> DataFrame:
    """``rows`` with ``lead``: the samples next to a block's far end come a second time, for the block they lead in."""
    at, on = F.pmod(F.col("sample") - 1, F.lit(size)), -1 if backwards else 1
    edge = at < memory if backwards else at >= size - memory
    own = F.struct(F.col("block").alias("block"), F.lit(False).alias("lead"))
    more = F.struct((F.col("block") + on).alias("block"), F.lit(True).alias("lead"))
    rest = [c for c in rows.columns if c not in BLOCK]
    return rows.withColumn("b", F.explode(F.when(edge, F.array(own, more)).otherwise(F.array(own)))).select(*KEY, F.col("b.block").alias("block"), F.col("b.lead").alias("lead"), *rest)


def _pieces(rows: DataFrame, size: int, memory: int) -> DataFrame:
    """``rows`` of samples as pieces of blocks, by their first ``sample``; what leads in a neighbour is apart from the rest."""
    at = F.pmod(F.col("sample") - 1, F.lit(size))
    low, high = sorted([memory, size - memory])
    cut = F.when(at < low, 0).when(at >= high, high).otherwise(low + F.floor((at - low) / PIECE) * PIECE).cast("long").alias("cut")
    block = F.floor((F.col("sample") - 1) / size).cast("long").alias("block")
    lists = rows.groupBy(*KEY, block, cut).agg(F.sort_array(F.collect_list(F.struct("sample", "value"))).alias("of"))
    return lists.select(*BLOCK, (F.col("block") * size + F.col("cut") + 1).alias("sample"), F.col("of.sample").alias("numbers"), F.col("of.value").alias("value"))


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` of one key in one task; rows without a key have no place."""
    return rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).repartition(*keys)


def _states(left: DataFrame, a: np.ndarray, backwards: bool, levels: int) -> DataFrame:
    """(recording, channel, block, state): the outputs before each block, newest last, from (recording, channel, block, count, v, start)."""
    m, run = len(a) - 1, [*KEY, "up"]
    order = [*run, F.col("node").desc() if backwards else F.col("node")]

    def folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What each run of blocks leaves, as if it were one."""
        key = count = v = start = None
        for pdf in frames:
            out = []
            for *now, n, own, first in zip(*(pdf[c] for c in (*run, "count", "v", "start"))):
                if now != key:
                    out += [(*key, count, v, start)] if key else []
                    key, count, v, start = now, 0, np.zeros(m), first
                count, v = count + n, kernels.faded(a, n, v) + own
            if out:
                yield pd.DataFrame(out, columns=names)
        if key:
            yield pd.DataFrame([(*key, count, v, start)], columns=names)

    def unfolded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The state before each member of a run, from the state before the run."""
        key = count = v = state = None
        for pdf in frames:
            out = []
            for *now, n, own, above in zip(*(pdf[c] for c in (*run, "count", "v", "state"))):
                state = kernels.faded(a, count, state) + v if now == key else above
                key, count, v = now, n, own
                out.append(state)
            yield pdf[[*KEY, "node"]].assign(state=out)

    names = [*KEY, "node", "count", "v", "start"]
    up = F.floor(F.col("node") / FAN).cast("long")
    tree = [left.withColumnRenamed("block", "node")]
    for _ in range(levels):
        tree.append(_dealt(tree[-1].withColumn("up", up), run).sortWithinPartitions(*order).mapInPandas(folded, PART))
    # At the top no state is known: the pass starts there.
    top = tree.pop().withColumns({"up": F.lit(0).cast("long"), "state": F.col("start")})
    states = _dealt(top, run).sortWithinPartitions(*order).mapInPandas(unfolded, STATE)
    while tree:
        known = _dealt(tree.pop().withColumn("up", up), run).join(states.withColumnRenamed("node", "up"), run)
        states = known.sortWithinPartitions(*order).mapInPandas(unfolded, STATE)
    return states.withColumnRenamed("node", "block")


def one_pass(rows: DataFrame, b: np.ndarray, a: np.ndarray, size: int, hold: bool, backwards: bool, levels: int = 0) -> DataFrame:
    """(recording, channel, block, sample, numbers, value) of the pieces ``rows`` filtered in one direction.

    ``hold``: the pass starts as if its first sample had always been; else from
    rest.  Without a tree (``levels`` of 0) one task composes the states of a
    channel, six numbers a block; ``levels`` serve ``FAN ** (levels + 1)`` blocks.
    """
    m, gain = len(a) - 1, float(b.sum() / a.sum())
    led = _dealt(_leads(rows, size, len(b) - 1, backwards), BLOCK)

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, BLOCK):
            at = np.flatnonzero(_changes(part, BLOCK))
            values = pc.list_flatten(part["value"]).to_numpy()
            count, v, start = np.zeros(len(at), int), np.zeros((len(at), m)), np.zeros((len(at), m))
            for blocks, before, own in _alike(part, at, backwards):
                y = _step(b, a, values[before], values[own], hold, np.zeros((m, 1)))[-m:]
                count[blocks] = len(own)
                v[blocks, m - len(y) :] = y.T
                if hold:
                    start[blocks] = values[own[0]][:, None] * gain
            some = np.flatnonzero(count)
            of = part.select(BLOCK).take(at[some]).append_column("count", pa.array(count[some]))
            for name, x in (("v", v), ("start", start)):
                of = of.append_column(name, _lists(x[some].ravel(), np.full(len(some), m)))
            yield from of.to_batches()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, BLOCK):
            at = np.flatnonzero(_changes(part, BLOCK))
            values = pc.list_flatten(part["value"]).to_numpy()
            states = pc.list_flatten(part["state"]).to_numpy().reshape(-1, m)[at]
            out = values.copy()
            for blocks, before, own in _alike(part, at, backwards):
                out[own] = _step(b, a, values[before], values[own], hold, states[blocks].T)
            of = part.select([*BLOCK, "sample", "numbers"]).append_column("value", _lists(out, pc.list_value_length(part["value"]).to_numpy()))
            yield from of.filter(pc.invert(part["lead"])).to_batches()

    left = led.sortWithinPartitions(*BLOCK, "sample").mapInArrow(leave, LEFT)
    # However they are joined, the pieces of a block stay in one task: they were dealt by it, and it has one state.
    known = led.join(_states(left, a, backwards, levels), BLOCK).select(*BLOCK, "lead", "sample", "numbers", "value", "state")
    return known.sortWithinPartitions(*BLOCK, "sample").mapInArrow(finish, ROW)


def both_ways(samples: DataFrame, b: np.ndarray, a: np.ndarray, ends: str, size: int, levels: int = 0) -> DataFrame:
    """``kernels.both_ways`` of every channel of (recording, channel, sample, value), ``size`` samples at a time."""
    if size < max(len(a), len(b)):
        raise ValueError("a block must hold the filter's memory")
    b, a = np.asarray(b, float), np.asarray(a, float)
    rows = samples.select(*(F.col(k).cast("long").alias(k) for k in (*KEY, "sample")), F.col("value").cast("double").alias("value"))
    if ends == "zeros":
        pad = 2 * max(len(a), len(b))
        last = rows.groupBy(*KEY).agg(F.max("sample").alias("last"))
        behind = last.select(*KEY, F.explode(F.sequence(F.col("last") + 1, F.col("last") + pad)).alias("sample"), F.lit(0.0).alias("value"))
        rows = rows.union(behind)
    out = _pieces(rows, size, len(b) - 1)
    for backwards in (False, True):
        out = one_pass(out, b, a, size, ends == "hold", backwards, levels)
    if ends == "zeros":
        out = out.join(last, KEY)
    out = out.select("*", F.posexplode("value").alias("at", "of")).withColumn("sample", F.col("numbers")[F.col("at")])
    return (out.where("sample <= last") if ends == "zeros" else out).select(*KEY, "sample", F.col("of").alias("value"))
