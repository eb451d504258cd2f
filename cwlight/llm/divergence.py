"""How the sources of each language differ in their words: chi-square distances and the terms behind them.

1. Every task of a first pass counts, in a count-min sketch of ``ROWS`` rows, in
   how many documents of a language each term occurs; the sketches are added up
   by cell range.  Cells stop at 255, so an estimate may be too high, never too
   low for the few documents that are asked for.
2. A second pass counts terms by (language, source), adds up what a task reads,
   and drops terms whose estimate is below the bound before anything is
   shuffled.  Those left are counted exactly and the bound is applied again.
3. A pair's distance sums over all terms of the language, also over those that
   neither source has.  With counts c, a term that a source lacks has one and
   the same share p0, so only terms with c > 0 are touched:
   sum = sum over A of f(p, p0 of B) + sum over B of f(p0 of A, q)
   + sum over both of [f(p, q) - f(p, p0 of B) - f(p0 of A, q) + f(p0, p0)]
   + (V - |A| - |B|) f(p0, p0).  The first two run over how often each share
   occurs in a source; the third joins the sparse counts by term.

A pair has p = 1 + floor(10**9 (c + 1) / (N + V)), and f(p, q) = floor((p - q)**2 / q).
Shares sum to 10**9 + V at most, so each of these sums stays below 3e18, within a
long, for V up to 10**9.  Quotients are taken in decimals.

The sketch is broadcast: ``ROWS * 2**24`` bytes (48 MB) at most.  Its width is a
power of two near a 32nd of the text's bytes, within 2**16 to 2**24.  Beyond
some 1e8 distinct terms it fills up and lets more terms through, which costs
shuffled rows and changes no result.  A first pass has ``TASKS`` tasks for each
core at most, as each sends a whole sketch.

Rows of the pair join grow with terms times the squared number of sources that
have the term, as the sought pairs of sources do.

Defined cases: null text, language and source count as ''; a text without terms
still makes its (language, source) known; a language without kept terms gives
value 0 to all its pairs; repeated rows are documents each; an empty table gives
no rows.  Columns other than text, lang and source are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cwlight.llm import sketch
from cwlight.llm.common import cut, pieces, small, text_buffer, total_bytes
from cwlight.llm.wordhash import BYTE, ODD, mix, powers

ROWS, TASKS = 3, 4
PIECE = 2 << 20
#: Rows of counts that a task of the second pass holds before it sends them.
HELD = 1 << 18
#: Groups that are broadcast to the counts at most.
FEW = 1 << 16
COUNTS = "lang string, term string, docs long, of array<struct<source: string, n: long>>"

LETTER = np.zeros(256, bool)
LETTER[np.r_[65:91, 97:123, 128:256]] = True
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def terms_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, number in the dictionary) of every term, and the dictionary of distinct terms; A-Z in lower case."""
    solid = LETTER[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = offsets[:-1]
    heads = heads[heads < len(raw)]
    first[heads] = solid[heads]
    starts = np.flatnonzero(first)
    before = np.cumsum(solid, dtype=np.int32)[starts] - 1 if len(starts) else np.zeros(0, np.int32)
    letters = LOWER[raw[solid]]
    ends = np.concatenate([before, [len(letters)]]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
    row = np.searchsorted(offsets, starts, "right") - 1
    return row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    raw, offsets = text_buffer(words)
    if not len(words):
        return np.zeros(0, np.uint64)
    size = np.diff(offsets)
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], size)
    value = np.concatenate([BYTE[raw] * powers(max(1, int(size.max(initial=0))))[0][place], np.zeros(1, np.uint64)])
    out = np.add.reduceat(value, offsets[:-1])
    out[size == 0] = 0
    return mix(out + size.astype(np.uint64) * ODD)


def cells(keys: np.ndarray, width: int) -> np.ndarray:
    """The cell of each key in each row of a sketch, numbered through all rows."""
    rows = np.arange(ROWS, dtype=np.uint64)[:, None]
    return ((mix(keys[None, :] + (rows + np.uint64(1)) * ODD) & np.uint64(width - 1)) + rows * np.uint64(width)).astype(np.int64)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers of ``x``, sorted.  ``np.unique`` hashes here, at several times the cost of a sort."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


class _Piece:
    """Terms of some rows, with the numbers of their languages and sources."""

    def __init__(self, text: tuple[np.ndarray, np.ndarray], lang: pa.Array, source: pa.Array) -> None:
        self.row, self.term, self.words = terms_of(*text)
        coded = lang.dictionary_encode(), source.dictionary_encode()
        self.lang, self.source = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in coded)
        self.langs, self.sources = (x.dictionary for x in coded)
        self.once = distinct(self.row * max(1, len(self.words)) + self.term)  # each term of each row once

    def documents(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group * terms + term, number of rows) of all terms, for the group of each row."""
        d = max(1, len(self.words))
        return np.unique(group[self.once // d] * d + self.once % d, return_counts=True)

    def keys(self, lang: np.ndarray, term: np.ndarray) -> np.ndarray:
        return mix(hashes(self.words)[term] ^ mix(hashes(self.langs) + ODD)[lang])


def _pieces(batches):
    for batch in batches:
        raw, offsets = text_buffer(batch.column("text"))
        for a, b in pieces(offsets, PIECE):
            yield _Piece((raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), batch.column("lang").slice(a, b - a), batch.column("source").slice(a, b - a))


def document_sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Count-min sketch of the documents that hold each (language, term): ``ROWS`` times ``width`` cells, up to 255."""

    def fill(batches, counts):
        for piece in _pieces(batches):
            key, n = piece.documents(piece.lang)
            d = max(1, len(piece.words))
            sketch.add(counts, cells(piece.keys(key // d, key % d), width).ravel(), np.tile(n, ROWS))

    return sketch.merged(docs, fill, ROWS * width, np.uint8, TASKS * docs.sparkSession.sparkContext.defaultParallelism)


def _counts(docs: DataFrame, seen: np.ndarray, width: int, least: int) -> DataFrame:
    """(lang, term, docs, of) as each task counts them, ``of`` listing (source, n), without terms whose estimate is below ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(seen)

    def run(batches):
        held, size = [], 0

        def total() -> pa.Table:
            t = pa.concat_tables(held).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
            return t.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])

        def packed(t: pa.Table):
            """One row for each term, so that a term is sent once for all its sources."""
            t = t.group_by(["lang", "term"], use_threads=False).aggregate([("docs", "sum"), ("source", "list"), ("n", "list")])
            for batch in t.to_batches(max_chunksize=1 << 15):
                sources, n = batch.column("source_list"), batch.column("n_list")
                of = pa.ListArray.from_arrays(sources.offsets, pa.StructArray.from_arrays([sources.values, n.values], ["source", "n"]))
                yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("term"), batch.column("docs_sum"), of], names=["lang", "term", "docs", "of"])

        for piece in _pieces(batches):
            d, s = max(1, len(piece.words)), max(1, len(piece.sources))
            group = piece.lang * s + piece.source
            key, docs_ = piece.documents(group)
            _, n = np.unique(group[piece.row] * d + piece.term, return_counts=True)
            lang, source, term = key // (d * s), key // d % s, key % d
            good = np.flatnonzero(shared.value[cells(piece.keys(lang, term), width)].min(axis=0) >= least)
            took = [x.take(pa.array(i[good])) for x, i in ((piece.langs, lang), (piece.sources, source), (piece.words, term))]
            held.append(pa.table([*took, pa.array(n[good], pa.int64()), pa.array(docs_[good], pa.int64())], names=["lang", "source", "term", "n", "docs"]))
            size += len(good)
            if size > HELD:
                held = [total()]
                size = len(held[0])
                if size > HELD // 2:
                    yield from packed(held.pop())
                    size = 0
                pa.default_memory_pool().release_unused()
        if size:
            yield from packed(total())

    return docs.mapInArrow(run, COUNTS)


def kept_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n, whole): occurrences in a source and in its language of terms in at least ``least`` documents of the language."""
    if not 1 <= least <= 255:
        raise ValueError("least must lie within 1 and 255")
    width = sketch.width_for(total_bytes(docs) // 32, 1 << 16, 1 << 24)
    found = _counts(docs, document_sketch(docs, width), width, least).repartition("lang", "term")
    # Documents of a row are told once, beside its first source.
    each = found.select("lang", "term", "docs", F.posexplode("of")).select("lang", "term", "col.source", "col.n", F.when(F.col("pos") == 0, F.col("docs")).otherwise(0).alias("docs"))
    exact = each.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    line = Window.partitionBy("lang", "term")
    return exact.select("lang", "source", "term", "n", F.sum("n").over(line).alias("whole"), F.sum("docs").over(line).alias("docs")).where(F.col("docs") >= least).drop("docs")


def share(n: str, whole: str, terms: str) -> Column:
    """1 + floor(10**9 * (n + 1) / (whole + terms)), exactly."""
    return F.expr(f"1 + (CAST({n} + 1 AS DECIMAL(20, 0)) * 1000000000BD) div CAST({whole} + {terms} AS DECIMAL(20, 0))")


def unlike(p: str, q: str) -> str:
    """floor((p - q)**2 / q) as SQL."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def divergence(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): for each (language, source) its distance from each other source of the language (``pair``) and the ``top`` terms it has more of than the language (``term``)."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    kept = cut(kept_counts(docs, least))
    langs = kept.groupBy("lang", "term").agg(F.first("whole").alias("whole")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("whole").alias("whole"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("own"))
    groups = docs.select("lang", "source").distinct().join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").na.fill(0)
    groups = cut(groups.select("lang", "source", "terms", "whole", "n", "own", F.when(F.col("terms") > 0, share("0", "n", "terms")).alias("p0")))

    named = small(groups, FEW).select("lang", "source", "terms", F.col("whole").alias("all_n"), F.col("n").alias("own_n"), "p0")
    shares = kept.join(named, ["lang", "source"]).select("lang", "source", "term", share("n", "own_n", "terms").alias("p"), share("whole", "all_n", "terms").alias("q"), "p0")
    term = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(unlike("p", "q")).alias("value"))

    x = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("za"))
    y = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("zb"))
    both = lambda p, q, zp, zq: F.expr(f"{unlike(p, q)} - {unlike(p, zq)} - {unlike(zp, q)} + {unlike(zp, zq)}")
    met = x.join(y, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(both("pa", "pb", "za", "zb")).alias("ab"), F.sum(both("pb", "pa", "zb", "za")).alias("ba"))

    often = shares.groupBy("lang", F.col("source").alias("a"), F.col("p").alias("pa")).agg(F.count(F.lit(1)).alias("c"))
    others = small(groups, FEW).select("lang", F.col("source").alias("b"), F.col("p0").alias("zb"), F.col("own").alias("own_b"))
    lone = often.join(others, "lang").where("a != b").groupBy("lang", "a", "b").agg(F.sum(F.expr(f"c * {unlike('pa', 'zb')}")).alias("ab"), F.sum(F.expr(f"c * {unlike('zb', 'pa')}")).alias("ba"))
    rest = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("za"), F.col("own").alias("own_a"), "terms").join(others, "lang").where("a != b")
    rest = rest.select("lang", "a", "b", F.coalesce(F.expr(f"(terms - own_a - own_b) * {unlike('za', 'zb')}"), F.lit(0)).alias("value"))
    ways = met.unionByName(lone)
    parts = [rest, ways.select("lang", "a", "b", F.col("ab").alias("value")), ways.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("ba").alias("value"))]
    pair = parts[0].union(parts[1]).union(parts[2]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pair = pair.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")

    line = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [pair.withColumn("rank", F.row_number().over(line)), term.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= top)]
    return ranked[0].union(ranked[1])
