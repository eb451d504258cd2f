"""Near-duplicate documents by b-bit MinHash, with exact confirmation.

1. Every text becomes 128 minima over its set of word shingles.  Four minima
   make a band (32 bands); of each minimum the low four bits are packed into
   eight 64-bit words.
2. Rows with equal sets form a class; one row per class goes on.
3. Classes meeting in a band bucket are candidates.  In a bucket of up to
   ``SMALL`` members all pairs are; in a larger one each member is paired with
   the bucket's most connected member.
4. The packed bits give a collision-corrected similarity by bit counts; pairs
   far below the threshold go, the rest are confirmed on the full sets.
5. Members of large buckets that are still apart from their bucket's main
   component are searched exactly: with shingles in one order, those in many
   of the searched sets last, a pair of enough overlap shares one early enough
   in both sets for the overlap to fit.
6. Components are found by rounds of label passing with shortcuts.

Two similar texts miss all 32 bands with probability (1 - s**4)**32, that is
5e-6 at s = 0.75.  A confirmed link is exact up to 64-bit hash collisions.

Defined cases: null and blank texts have no shingles and no links; every row is
judged by its own text, also where rows share a doc_id; a row without doc_id
takes no part (component null, kept).  Columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cwlight.llm import sketch
from cwlight.llm.common import cut, pieces, text_buffer
from cwlight.llm.common import small as few_rows
from cwlight.llm.wordhash import grams, mix, words

HASHES, BANDS, BITS = 128, 32, 4
#: All pairs are tried in buckets of up to this many members.
SMALL = 64
#: Rows that keep_one names (three numbers each) and broadcasts at most.
FEW = 1 << 18
#: Cells of the sketch that orders the search in larger buckets at most, of two bytes each: 16 MB, broadcast.
WIDTH = 1 << 23
#: Standard deviations by which the estimate may fall short of the threshold.
SLACK = 5.0
SIGNATURE = "doc_id long, n_shingles long, node long, check long, bands array<long>, packed array<long>"


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
    return (seed[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seed[HASHES:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: pa.Array, width: int):
    """The sorted distinct shingle hashes of every text, in order; ASCII letters in lower case."""
    raw, offsets = text_buffer(texts)
    for a, b in pieces(offsets, 1 << 20):
        h, _, _, bounds = words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
        runs = grams(h, width)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo >= width:
                yield np.unique(runs[lo : hi - width + 1])
            elif hi > lo:
                yield grams(h[lo:hi], hi - lo) ^ np.uint64(hi - lo)
            else:
                yield np.zeros(0, np.uint64)


def minima(shingles: np.ndarray, mult: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """The least of a*x + b modulo 2**32 over a set, for each (a, b)."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 4096):
        np.minimum(out, (mult[:, None] * x[None, i : i + 4096] + plus[:, None]).min(axis=1), out=out)
    return out


def pack(low: np.ndarray) -> np.ndarray:
    """Rows of 128 four-bit numbers as rows of eight 64-bit words."""
    lanes = (low & np.uint32(15)).astype(np.uint64).reshape(len(low), -1, 16)
    return (lanes << (np.arange(16, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def _lists(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows).view(np.int64).ravel()))


def fingerprint(shingles: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that equal sets share."""
    m = mix(shingles + np.uint64(1))
    return m.sum(dtype=np.uint64), mix(m ^ np.uint64(0xABCDEF)).sum(dtype=np.uint64)


def signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row per document: set size, 128-bit set fingerprint, band keys, packed minima."""

    def run(batches):
        mult, plus = _multipliers()
        for batch in batches:
            ids = batch.column(0)
            for at in range(0, batch.num_rows, 2048):
                texts = batch.column(1).slice(at, 2048)
                size, fp, low = [], [], []
                for s in shingle_sets(texts, width):
                    size.append(len(s))
                    fp.append(fingerprint(s))
                    low.append(minima(s, mult, plus))
                low = np.array(low, np.uint32).reshape(len(size), HASHES)
                fp = np.array(fp, np.uint64).reshape(len(size), 2).view(np.int64)
                quads = low.astype(np.uint64).reshape(len(size), BANDS, -1)
                keys = np.full((len(size), BANDS), 7, np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for j in range(quads.shape[2]):
                    keys = mix(keys ^ quads[:, :, j]) + np.uint64(j)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, 2048), pa.array(size, pa.int64()), pa.array(fp[:, 0]), pa.array(fp[:, 1]), _lists(keys), _lists(pack(low))],
                    names=["doc_id", "n_shingles", "node", "check", "bands", "packed"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SIGNATURE)


def full_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """(node, check, shingles): the sorted distinct shingle hashes of each text, and their fingerprint."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = list(shingle_sets(batch.column(0).slice(at, 512), width))
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                fp = np.array([fingerprint(s) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(fp[:, 0]), pa.array(fp[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "check", "shingles"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "node long, check long, shingles array<long>")


def estimate(a: str, b: str) -> F.Column:
    """Similarity from packed minima: equal lanes by bit counts, less those equal by chance."""
    lane = F.lit(0x1111111111111111)

    def unequal(i: int) -> F.Column:
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for by in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        return F.bit_count(x.bitwiseAND(lane))

    apart = sum((unequal(i) for i in range(1, HASHES * BITS // 64)), unequal(0))
    same, chance = 1 - apart / F.lit(float(HASHES)), 1 / 2.0**BITS
    return (same - chance) / (1 - chance)


def floor_of(similarity: float) -> float:
    """The least estimate that a pair of this similarity may show, ``SLACK`` deviations down."""
    chance = 1 / 2.0**BITS
    p = chance + (1 - chance) * similarity
    return similarity - SLACK * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets overlap enough.  One set travels with each pair, never two."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    either = F.size("sa") + F.size("sb") - both
    sized = F.least(F.size("sa"), F.size("sb")) * 100 >= F.greatest(F.size("sa"), F.size("sb")) * percent
    return pairs.join(left, "a").join(right, "b").where(sized & (both * 100 >= either * percent)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, c) of every linked node: c is the smallest node it can reach.

    Each round hangs every label's neighbours on the smallest label next to
    it, then follows labels of labels; a chain of n links takes about log n
    rounds.  Labels are written to the checkpoint folder every round.
    """
    edges = cut(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    labels = edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("c")).select(F.col("x").alias("node"), "c")
    while True:
        labels = cut(labels)
        named = labels.select(F.col("node").alias("y"), F.col("c").alias("cy"))
        near = edges.join(named, "y").groupBy("x").agg(F.min("cy").alias("n"))
        seen = labels.join(near, labels.node == near.x).select("node", "c", "n")
        # The root c learns the least label seen by any of its members.
        hooked = seen.groupBy("c").agg(F.min("n").alias("n")).select(F.col("c").alias("r"), F.least("r", "n").alias("up"))
        jump = cut(hooked.where("up < r"))
        if jump.isEmpty():
            return labels.select("node", "c")
        while True:  # roots hang on roots: follow until all point at the top
            top = jump.select(F.col("r").alias("up"), F.col("up").alias("upper"))
            step = jump.join(top, "up", "left").select("r", F.coalesce("upper", "up").alias("next"), "up")
            step = cut(step)
            jump = step.select("r", F.col("next").alias("up"))
            if step.where("next < up").isEmpty():
                break
        labels = labels.join(jump, labels.c == jump.r, "left").select("node", F.coalesce("up", "c").alias("c"))


def _often(members: DataFrame) -> np.ndarray:
    """In how many sets of ``members`` (shingles, any others) the shingles of each cell occur, up to 65535.

    It only orders the search that follows, so shared cells drop no pair.
    """
    total = members.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0)).alias("n")).first()["n"]
    cells = sketch.width_for(total // 4, sketch.CELLS, WIDTH)

    def fill(batches, counts):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                flat = batch.column(0).slice(at, 512).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                sketch.add(counts, (flat & np.uint64(cells - 1)).astype(np.int64))

    return sketch.merged(members.select("shingles"), fill, cells, np.uint16, 2 * members.sparkSession.sparkContext.defaultParallelism)


def _prefixes(members: DataFrame, percent: int, often: np.ndarray) -> DataFrame:
    """(node, c, apart, n, p, s): the first shingles of each set, the rarest by ``often`` first, p from 1."""
    shared = members.sparkSession.sparkContext.broadcast(often)

    def run(batches):
        for batch in batches:
            at, place, shingle, size = [], [], [], []
            for i, held in enumerate(batch.column(3)):
                s = np.frombuffer(held.values.buffers()[1], np.int64)[held.values.offset : held.values.offset + len(held.values)].view(np.uint64)
                count = shared.value[(s & np.uint64(len(shared.value) - 1)).astype(np.int64)]
                reach = len(s) - -(-len(s) * percent // 100) + 1
                first = s[np.lexsort((s, count))[:reach]]
                at.append(np.full(len(first), i))
                place.append(np.arange(1, len(first) + 1))
                shingle.append(first)
                size.append(np.full(len(first), len(s)))
            if at:
                own = batch.select(["node", "c", "apart"]).take(pa.array(np.concatenate(at)))
                rest = [pa.array(np.concatenate(size), pa.int64()), pa.array(np.concatenate(place), pa.int64()), pa.array(np.concatenate(shingle).view(np.int64))]
                yield pa.RecordBatch.from_arrays([*own.columns, *rest], names=["node", "c", "apart", "n", "p", "s"])

    return members.select("node", "c", "apart", "shingles").mapInArrow(run, "node long, c long, apart boolean, n long, p long, s long")


def _ordered_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs across components among ``members`` (node, c, apart), a written table, that may overlap enough.

    With shingles in one order for all sets, an overlap of
    t = ceil(percent * (|a| + |b|) / (100 + percent)) leaves each pair a first
    common shingle at places pa and pb with 1 + min(|a| - pa, |b| - pb) >= t
    (places from 1), so joining on prefixes under that condition is exact,
    whatever the order; with frequent shingles last it meets few pairs.  Only
    rows marked ``apart`` search.
    """
    held = cut(sets.join(few_rows(members, FEW), "node"))
    prefix = cut(_prefixes(held, percent, _often(held)))
    x = prefix.where("apart").select(*(F.col(k).alias(f"{k}x") for k in ("node", "c", "n", "p")), "s")
    y = prefix.select(*(F.col(k).alias(f"{k}y") for k in ("node", "c", "apart", "n", "p")), "s")
    need = F.ceil((F.col("nx") + F.col("ny")) * percent / (100.0 + percent))
    room = 1 + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    once = ~F.col("aparty") | (F.col("nodex") < F.col("nodey"))
    hits = x.join(y, (x.s == y.s) & (F.col("cx") != F.col("cy")) & once & (room >= need))
    return hits.select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b")).distinct()


def _classed(docs: DataFrame, width: int, percent: int, small: int) -> tuple[DataFrame, DataFrame]:
    """(signatures of all rows; (node, check, rep, c) of every class of equal sets: smallest doc_id and label of the component)."""
    sigs = cut(signatures(docs, width))
    full = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Classes have all 128 bits; from here on a number of its own, written once, is the node of a class.
    classes = cut(full.groupBy("node", "check").agg(F.min("doc_id").alias("rep")).withColumn("id", F.monotonically_increasing_id()))
    heads = classes.select("node", "check", F.col("rep").alias("doc_id"), "id")
    reps = full.join(heads, ["node", "check", "doc_id"]).dropDuplicates(["id"]).drop("node", "check").withColumnRenamed("id", "node")

    member = reps.select("node", F.explode("bands").alias("key"))
    # Small sides are written first: a join of two plain exchanges is one whose large keys Spark can split.
    counts = cut(member.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = cut(member.join(counts, "key"))
    low = shared.where(F.col("n") <= small).select("key", "node")
    few = low.select("key", F.col("node").alias("a")).join(low.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b")
    degree = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    large = cut(shared.where(F.col("n") > small).join(degree, "node"))
    middle = cut(large.groupBy("key").agg(F.min(F.struct((-F.col("degree")).alias("d"), F.col("node"))).alias("m")).select("key", F.col("m.node").alias("middle")))
    star = large.select("key", "node").join(middle, "key").where("node != middle").select(F.least("node", "middle").alias("a"), F.greatest("node", "middle").alias("b"))
    packed = reps.select("node", "packed")
    pairs = few.union(star).distinct()
    pairs = pairs.join(packed.select(F.col("node").alias("a"), F.col("packed").alias("qa")), "a").join(packed.select(F.col("node").alias("b"), F.col("packed").alias("qb")), "b")
    pairs = cut(pairs.where(estimate("qa", "qb") >= floor_of(percent / 100.0)).select("a", "b"))

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large.select("node")).distinct()
    ids = reps.join(wanted, "node", "left_semi").select("doc_id").distinct()
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    named = classes.join(wanted.withColumnRenamed("node", "id"), "id", "left_semi").select("node", "check", "id")
    sets = full_sets(chosen, width).join(named, ["node", "check"]).dropDuplicates(["node", "check"])
    sets = cut(sets.select(F.col("id").alias("node"), "shingles"))
    links = cut(confirm(pairs, sets, percent))
    found = components(links)

    placed = large.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("c", "node").alias("c"))
    tally = placed.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    main = cut(tally.groupBy("key").agg(F.min(F.struct(-F.col("n"), F.col("c"))).alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", F.col("m.c").alias("main")))
    split = cut(placed.join(main, "key").groupBy("node", "c").agg(F.max(F.col("c") != F.col("main")).alias("apart")))
    if not split.isEmpty():
        more = cut(confirm(_ordered_pairs(split, sets, percent), sets, percent))
        if not more.isEmpty():
            found = components(links.union(more))

    tree = classes.join(found.withColumnRenamed("node", "id"), "id", "left").select("node", "check", "rep", F.coalesce("c", "id").alias("c"))
    return sigs, tree


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, small: int = SMALL) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text, any others)."""
    sigs, tree = _classed(docs, width, percent, small)
    least = cut(tree.groupBy("c").agg(F.min("rep").alias("component_id")))
    named = tree.join(least, "c").select("node", "check", "component_id")
    out = sigs.join(named, ["node", "check"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """(row, doc_id, node, check): the rows of ``docs`` as structs, with the fingerprint of their shingle sets."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = StructType([*rows.schema.fields[:2], StructField("node", LongType()), StructField("check", LongType())])

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(s) for s in shingle_sets(batch.column(2), width)], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp[:, 0]), pa.array(fp[:, 1])], names=schema.names)

    return rows.mapInArrow(run, schema)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one row of every component, and all rows without doc_id or without a word.

    It is the row with the smallest doc_id; where rows share that, the one with
    the least set fingerprint, then the least text, then any of the equal ones.
    """
    sigs, tree = _classed(docs, width, percent, SMALL)
    keys = ["doc_id", "node", "check"]
    stays = tree.groupBy("c").agg(F.min(F.struct("rep", "node", "check")).alias("m")).select(F.col("m.rep").alias("doc_id"), "m.node", "m.check", F.lit(True).alias("stays"))
    found = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(stays, keys, "left")
    # Rows that go, and those of which one goes on; where they are few, no text is shuffled for them.
    told = cut(found.where("stays IS NULL OR n > 1").select(*keys, F.coalesce("stays", F.lit(False)).alias("stays")))
    word = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    apart = docs.where(F.col("doc_id").isNull() | ~word)
    rows = fingerprints(docs.where(F.col("doc_id").isNotNull() & word), width)
    out = rows.join(few_rows(told.select(*keys), FEW), keys, "left_anti").select("row.*").union(apart)
    again = told.where("stays").select(*keys)
    if again.isEmpty():
        return out
    # The one row is chosen before the shuffle too, so a row said a thousand times costs one.
    line = Window.partitionBy(*keys).orderBy("row.text")
    first = rows.join(few_rows(again, FEW), keys, "left_semi").withColumn("nth", F.row_number().over(line)).where("nth = 1")
    return out.union(first.select("row.*"))
