"""Links of documents whose word n-gram sets are nearly equal: a size-aware join, light and heavy.

1. A first pass counts shingles in a sketch of bounded width.  Its cells give one
   order of all shingles, rare ones first; any order keeps the join exact, a
   good one keeps it cheap.
2. Rows with equal sets form a class.  A set of n shingles overlaps a partner in
   at least t = ceil(percent * n / 100), so two partners have l shingles in
   common among the first n - t + l of each.
3. Light sets (n <= boundary) enumerate the subsets of two shingles among their
   first n - t + 2 and meet in equal ones.  Heavy sets meet in the inverted
   lists of their first n - t + 1 shingles; light ones that may have a heavy
   partner stand in the lists too.  The boundary is where the sum of subsets
   enumerated below and of list entries scanned above is least; both are added
   up by size over all sets.
4. A list is first scanned against its most connected member.  What is close
   enough is confirmed on the full sets, and components are formed.
5. Then every list that still holds several components is scanned again, for
   pairs of different components only, so no link is lost.  Sizes, places in
   the order and the bits in which two 1024-bit parity maps differ bound the
   overlap from above; pairs above that bound are not made at all.

Work that remains quadratic: sets in one list that are alike but linked to none
of its main component, compared by their maps within the join.  The order gets
worse where distinct shingles exceed the sketch's cells by far (``WIDTH``); with
1e12 of them only shingles in more than about a hundred thousand documents still come last.

A confirmed link is exact up to 64-bit hash collisions; classes have 128 bits.

Defined cases: null and blank texts have no shingles and no links; with fewer
words than the width the whole sequence is the only shingle; every row is judged
by its own text, also where rows share a doc_id; a row without doc_id takes no
part (component null); an empty table gives no rows.  Columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cwlight.llm import sketch
from cwlight.llm.common import cut, total_bytes
from cwlight.llm.common import small as few_rows
from cwlight.llm.near_dup import components, confirm, fingerprint, shingle_sets

#: Cells of the sketch at most, of two bytes each: 16 MB, broadcast.
WIDTH = 1 << 23
#: Light sets hold this many shingles at most.
LIGHT = 256
#: What one entry of a list is taken to cost at most: however long the list, it is compared with the middle
#: member, and with others only while components are apart.
SCANNED = 16
#: 64-bit words of a parity map.
MAP = 16
#: Ids broadcast at most to choose the texts whose full sets are needed.
FEW = 1 << 18
SIGNED = "doc_id long, n_shingles long, node long, check long, first array<long>, map array<long>, scan double"


def first_of(n: int, percent: int, common: int) -> int:
    """How many first shingles two partners share ``common`` of, for a set of ``n``."""
    return min(n, n + (-n * percent // 100) + common)


def parity(shingles: np.ndarray) -> np.ndarray:
    """A map of ``64 * MAP`` bits: each counts, modulo 2, the shingles that fall on it."""
    at = (shingles >> np.uint64(20)) % np.uint64(64 * MAP)
    odd = (np.bincount(at.astype(np.int64), minlength=64 * MAP) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def shingle_sketch(docs: DataFrame, width: int, cells: int) -> np.ndarray:
    """In how many rows the shingles of each cell occur, up to 65535."""

    def fill(batches, counts):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = list(shingle_sets(batch.column(0).slice(at, 512), width))
                sketch.add(counts, (np.concatenate([np.zeros(0, np.uint64), *sets]) & np.uint64(cells - 1)).astype(np.int64))

    return sketch.merged(docs.select("text"), fill, cells, np.uint16, 2 * docs.sparkSession.sparkContext.defaultParallelism)


def signed(docs: DataFrame, width: int, percent: int, counts: np.ndarray) -> DataFrame:
    """One row per document: set size, 128-bit fingerprint, first shingles in the order of ``counts``, parity map, entries of their lists."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    noise = float(counts.mean(dtype=np.float64))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                ids = batch.column(0).slice(at, 1024)
                size, fp, first, maps, scan = [], [], [], [], []
                for s in shingle_sets(batch.column(1).slice(at, 1024), width):
                    often = shared.value[(s & np.uint64(len(shared.value) - 1)).astype(np.int64)]
                    order = np.lexsort((s, often))[: first_of(len(s), percent, 2)]
                    size.append(len(s))
                    fp.append(fingerprint(s))
                    first.append(s[order])
                    maps.append(parity(s))
                    scan.append(float(np.clip(often[order] - noise, 1, SCANNED).sum()))
                fp = np.array(fp, np.uint64).reshape(-1, 2).view(np.int64)
                ends = np.concatenate([[0], np.cumsum([len(f) for f in first])]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.uint64), *first]).view(np.int64)
                maps = np.concatenate([np.zeros(0, np.int64), *maps])
                columns = [ids, pa.array(size, pa.int64()), pa.array(fp[:, 0]), pa.array(fp[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                columns += [pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * MAP), pa.array(maps)), pa.array(scan, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "node", "check", "first", "map", "scan"])

    return docs.mapInArrow(run, SIGNED)


def boundary(classes: DataFrame, percent: int) -> int:
    """The size up to which sets are light: subsets enumerated up to it and list entries scanned beyond it add up to the least."""
    sized = classes.groupBy(F.least("n", F.lit(LIGHT + 1)).alias("n")).agg(F.count(F.lit(1)).alias("sets"), F.sum("scan").alias("scan"))
    subsets, scans = np.zeros(LIGHT + 2), np.zeros(LIGHT + 2)
    for row in sized.collect():
        m = first_of(row["n"], percent, 2)
        subsets[row["n"]], scans[row["n"]] = row["sets"] * (m * (m - 1) // 2), row["scan"]
    total = np.cumsum(subsets) + scans.sum() - np.cumsum(scans)
    return int(np.argmin(total[: LIGHT + 1]))


def entries(classes: DataFrame, percent: int, light: int) -> DataFrame:
    """(key, id, n, place): light sets under their subsets of two, the others, and light ones near the boundary, under single shingles.

    ``place`` is such that 1 + n - place bounds the overlap of sets whose first
    common shingles, in the order, are those of the key.
    """
    pairs = "flatten(transform(slice(first, 2, size(first)), (b, j) -> transform(slice(first, 1, j + 1), a -> named_struct('key', xxhash64(a, b), 'place', j + 1))))"
    single = "transform(slice(first, 1, greatest(1, size(first) - 1)), (a, j) -> named_struct('key', a, 'place', j + 1))"
    subsets = classes.where(F.col("n") <= light).select("id", "n", F.explode(F.expr(pairs)).alias("e"))
    lists = classes.where(F.col("n") * 100 >= percent * (light + 1)).select("id", "n", F.explode(F.expr(single)).alias("e"))
    return subsets.union(lists).select("e.key", "id", "n", "e.place")


def overlap(a: str, b: str, percent: int) -> Column:
    """The least overlap of linked sets of ``a`` and ``b`` shingles: ceil(percent * (a + b) / (100 + percent))."""
    return F.expr(f"({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent}")


def near_enough(na: str, nb: str, ma: str, mb: str, percent: int) -> Column:
    """Whether sizes and parity maps leave room for a link: two sets differ in at least the bits their maps differ in."""
    apart = F.expr(" + ".join(f"bit_count({ma}[{i}] ^ {mb}[{i}])" for i in range(MAP)))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (apart <= F.col(na) + F.col(nb) - 2 * overlap(na, nb, percent))


def _sets(docs: DataFrame, width: int, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, shingles) with ``node`` the id of a class: the full sets of the classes in ``ids``."""
    wanted = cut(classes.select("id", "node", "check", "rep").join(ids, "id", "left_semi"))
    chosen = docs.join(few_rows(wanted.select(F.col("rep").alias("doc_id")).distinct(), FEW), "doc_id", "left_semi")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = list(shingle_sets(batch.column(0).slice(at, 512), width))
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
                fp = np.array([fingerprint(s) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(fp[:, 0]), pa.array(fp[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "check", "shingles"])

    found = chosen.select("text").mapInArrow(run, "node long, check long, shingles array<long>")
    named = found.join(few_rows(wanted, FEW).select("node", "check", "id"), ["node", "check"])
    return cut(named.select(F.col("id").alias("node"), "shingles").dropDuplicates(["node"]))


def _confirmed(docs: DataFrame, width: int, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    return cut(confirm(pairs, _sets(docs, width, classes, ids), percent))


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, light: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; ``light`` sets the boundary by hand."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cells = sketch.width_for(total_bytes(docs) // 8, sketch.CELLS, WIDTH)
    sigs = cut(signed(docs, width, percent, shingle_sketch(docs, width, cells)))
    full = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    one = full.groupBy("node", "check").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("first").alias("first"), F.first("map").alias("map"), F.first("scan").alias("scan"))
    classes = cut(one.withColumn("id", F.monotonically_increasing_id()))

    every = entries(classes, percent, boundary(classes, percent) if light is None else light)
    # Small sides are written first: a join of two plain exchanges is one whose large keys Spark can split.
    counts = cut(every.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    shared = cut(every.join(counts, "key"))
    degree = cut(shared.groupBy("id").agg(F.sum("size").alias("degree")))
    ranked = shared.join(degree, "id").groupBy("key").agg(F.min(F.struct((-F.col("degree")).alias("d"), F.col("id"))).alias("m"))
    middle = cut(ranked.select("key", F.col("m.id").alias("middle")))
    star = shared.join(middle, "key").where("id != middle").select(F.least("id", "middle").alias("a"), F.greatest("id", "middle").alias("b")).distinct()
    sized = classes.select("id", "n", "map")
    left, right = (sized.select(F.col("id").alias(i), F.col("n").alias(f"n{i}"), F.col("map").alias(f"m{i}")) for i in "ab")
    star = cut(star.join(left, "a").join(right, "b").where(near_enough("na", "nb", "ma", "mb", percent)).select("a", "b"))
    links = _confirmed(docs, width, classes, star, percent)
    found = components(links)

    placed = cut(shared.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", "place", F.coalesce("c", "id").alias("c")))
    mixed = cut(placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key"))
    again = cut(placed.join(mixed, "key").join(classes.select("id", "map"), "id"))
    x, y = (again.select("key", *(F.col(k).alias(f"{k}{i}") for k in ("id", "n", "place", "c", "map"))) for i in "ab")
    room = 1 + F.least(F.col("na") - F.col("placea"), F.col("nb") - F.col("placeb")) >= overlap("na", "nb", percent)
    across = x.join(y, (x.key == y.key) & (F.col("ida") < F.col("idb")) & (F.col("ca") != F.col("cb")) & room & near_enough("na", "nb", "mapa", "mapb", percent))
    across = cut(across.select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct().join(star, ["a", "b"], "left_anti"))
    if not across.isEmpty():
        more = _confirmed(docs, width, classes, across, percent)
        if not more.isEmpty():
            found = components(links.union(more))

    tree = classes.join(found.withColumnRenamed("node", "id"), "id", "left").select("node", "check", "rep", F.coalesce("c", "id").alias("c"))
    least = cut(tree.groupBy("c").agg(F.min("rep").alias("component_id")))
    named = tree.join(least, "c").select("node", "check", "component_id")
    out = sigs.select("doc_id", "n_shingles", "node", "check").join(named, ["node", "check"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))
