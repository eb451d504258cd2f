"""Nearest neighbours by shifted space-filling curves.

1. Equal vectors are one node of the index, told apart by a 128-bit hash; a node
   stands for as many of its smallest ids as an answer can hold, so a vector
   shared by a third of all rows is indexed and searched once.
2. ``CURVES`` Hilbert orderings are laid over the nodes, each over its own random
   orthogonal projection to ``DIMS`` dimensions, moved by a random shift.  Spark
   range-partitions and sorts ids by their keys; their places are ranks.
3. The reach of a window is measured, not guessed: for at most ``PROBES`` nodes
   the true neighbours are found in one pass over the table, and the reach is
   the least number of ranks within which some curve brings a share ``TARGET``
   of them together.  Data with structure get narrow windows, data without any
   wide ones, at every size by the same rule.
4. Each curve gives the ids within reach of a query.  The ids of all curves are
   merged by query and block of nodes, so that each pair is compared once, by
   differences in double precision; only ids travel until then.
5. The best of all blocks are ranked by distance, then by id.

``compared`` in the result is the number of nodes whose vectors the query met.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without vec_id, take no part; 0.0 and -0.0 are equal;
vectors are compared with those of their own length (the lengths are taken to be
few); ties go to the smaller vec_id.  Rows may share a vec_id: equal ones count
once, a query_id with several vectors gets a list for each, and no row with the
query's own id is in a list.  Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cwlight.llm.common import cut

CURVES, DIMS, BITS = 64, 12, 4
#: Vectors the projections are scaled by, and nodes whose neighbours set the reach, for each length of vector.
SAMPLE, PROBES, TARGET = 4096, 256, 0.96
#: Ranks in a chunk of a curve, nodes in a block (a power of two up to 2**16), and queries that meet either in one task.
CHUNK, BLOCK_BITS, QUERY_BLOCK = 8192, 14, 1024
KEY_BITS = 48


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n, d) below 2**bits; d * bits is at most 63.

    Gray-code walk down the levels: at each level the quadrant's digit is read
    off, and the lower bits are reflected and exchanged as the curve turns there.
    """
    x = points.astype(np.int64).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(d):
            up = (x[i] & bit) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(up, below, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[d - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


class Curves:
    """Projections, shifts and scales of the curves for vectors of one length."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, seed: int = 17) -> None:
        width = sample.shape[1]
        self.dims = min(DIMS, width)
        rng = np.random.default_rng([seed, width])
        self.middle = sample.mean(axis=0)
        self.axes = [np.linalg.qr(rng.normal(size=(width, self.dims)))[0] for _ in range(curves)]
        self.shift = rng.uniform(0, 1, (curves, self.dims))
        self.steps = [np.quantile((sample - self.middle) @ a, np.linspace(0, 1, 65), axis=0) for a in self.axes]

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(curves, rows) of places on the curves."""
        out, x = [], x - self.middle
        for axes, shift, steps in zip(self.axes, self.shift, self.steps):
            p = x @ axes
            # Projected values by their rank among the sample, then moved by the shift.
            u = np.stack([np.interp(p[:, j], steps[:, j], np.linspace(0, 1, 65)) for j in range(self.dims)], axis=1)
            out.append(hilbert(((u + shift) / 2 * ((1 << BITS) - 1)).astype(np.int64), BITS))
        return np.array(out)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, h1, h2) of the rows that take part; equal vectors share both hashes."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine).select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.col("v")).alias("h2"))


def _nodes(rows: DataFrame, k: int, every: int) -> DataFrame:
    """(id, h1, h2, width, v, ids, asks): one row per distinct vector, with its ``k + 1`` smallest vec_ids; ids count from 0."""
    asks = F.pmod("vec_id", F.lit(every)) == 0
    line = Window.partitionBy("h1", "h2", "asks").orderBy("vec_id")
    first = rows.withColumn("asks", asks).withColumn("n", F.dense_rank().over(line)).where(F.col("n") <= k + 1)
    ids = F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1)
    nodes = first.groupBy("h1", "h2").agg(F.first("v").alias("v"), ids.alias("ids"), F.bool_or("asks").alias("asks"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("at"), "h1", "h2", F.size("v").alias("width"), "v", "ids", "asks"))
    # Ids without gaps, so that blocks are full however the table is dealt: one row per partition tells how many nodes come before it.
    task = F.shiftright("at", 33).alias("task")
    tally = nodes.groupBy(task).agg(F.count(F.lit(1)).alias("all"))
    before = tally.select("task", (F.sum("all").over(Window.orderBy("task")) - F.col("all")).alias("before"))
    numbered = nodes.withColumn("task", task).join(F.broadcast(before), "task")
    return numbered.select((F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"), "h1", "h2", "width", "v", "ids", "asks")


def _runs(nodes: DataFrame, models: list[tuple[int, Curves]]) -> DataFrame:
    """(curve, start, n, ids, asks): runs of neighbours on a curve from rank ``start`` on; ``asks`` are the queries' places in a run.

    Curves of the i-th model are numbered from ``i * CURVES`` on.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(models)

    def keyed(batches):
        for batch in batches:
            widths = batch.column(2).to_numpy()
            for i, (w, model) in enumerate(shared.value):
                if not (widths == w).any():
                    continue
                part = batch.filter(pa.array(widths == w))
                keys = model.keys(_matrix(part.column(3), w))
                curves, n = keys.shape
                key = keys + ((np.arange(curves) + i * curves) << KEY_BITS)[:, None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.ravel()), pa.array(np.tile(part.column(0).to_numpy(), curves)), pa.array(np.tile(part.column(1).to_numpy(zero_copy_only=False), curves))],
                    names=["key", "id", "asks"],
                )

    def numbered(batches):
        count: dict[int, int] = {}
        for batch in batches:
            curve = batch.column(0).to_numpy() >> KEY_BITS
            ids, asks = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            rows: list[list] = [[] for _ in range(6)]
            for c in np.unique(curve).tolist():
                a, b = np.searchsorted(curve, [c, c + 1])
                at = count.get(c, 0)
                count[c] = at + int(b - a)
                for column, value in zip(rows, (c, batch.column(3)[0].as_py(), at, int(b - a), ids[a:b].tobytes(), np.flatnonzero(asks[a:b]).astype(np.int32).tobytes())):
                    column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types)], names=["curve", "task", "at", "n", "ids", "asks"])

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select("id", "asks", "width", "v").mapInArrow(keyed, "key long, id long, asks boolean")
    rows = rows.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id").withColumn("task", F.spark_partition_id())
    runs = cut(rows.mapInArrow(numbered, "curve long, task int, at long, n long, ids binary, asks binary"))
    # One row per task and curve: how many rows of the curve lie in earlier tasks.
    tally = runs.groupBy("curve", "task").agg(F.sum("n").alias("all"))
    before = tally.select("curve", "task", (F.sum("all").over(Window.partitionBy("curve").orderBy("task")) - F.col("all")).alias("before"))
    return runs.join(before, ["curve", "task"]).select("curve", (F.col("before") + F.col("at")).alias("start"), "n", "ids", "asks")


def _reaches(nodes: DataFrame, runs: DataFrame, models: list[tuple[int, Curves]], k: int, target: float) -> list[int]:
    """For each model the ranks within which ``target`` of the true neighbours of its probes lie on some curve."""
    spark = nodes.sparkSession
    place = {w: i for i, (w, _) in enumerate(models)}
    line = Window.partitionBy("width").orderBy("h1", "h2")
    asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    picked = nodes.withColumn("n", F.row_number().over(line)).where(F.col("n") <= PROBES).select("width", "id", "v").orderBy("width", "id").collect()
    for w, rows in groupby(picked, key=lambda r: r["width"]):
        held = list(rows)
        asked[w] = (np.array([r["id"] for r in held]), np.array([r["v"] for r in held]) - models[place[w]][1].middle)
    shared = spark.sparkContext.broadcast((asked, {w: m.middle for w, m in models}))

    def close(batches):
        for batch in batches:
            widths = batch.column(1).to_numpy()
            for w in np.unique(widths).tolist():
                part = batch.filter(pa.array(widths == w))
                (own, q), ids = shared.value[0][w], part.column(0).to_numpy()
                x = _matrix(part.column(2), w) - shared.value[1][w]
                d = (x * x).sum(axis=1)[None, :] - 2 * q @ x.T + (q * q).sum(axis=1)[:, None]
                d[own[:, None] == ids[None, :]] = np.inf
                most = min(k, len(ids))
                best = np.argpartition(d, most - 1, axis=1)[:, :most]
                got = np.take_along_axis(d, best, axis=1).ravel()
                probe, id_ = np.repeat(own, most), ids[best].ravel()
                keep = np.isfinite(got)
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (np.full(len(got), w, np.int32), probe, id_, got)], names=["width", "probe", "id", "d"])

    near = nodes.select("id", "width", "v").mapInArrow(close, "width int, probe long, id long, d double")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("probe").orderBy("d", "id"))).where(F.col("n") <= k).select("width", "probe", "id").collect()
    wanted = np.unique(np.array([x for r in near for x in (r["probe"], r["id"])], np.int64))
    sought = spark.sparkContext.broadcast(wanted)

    def ranked(batches):
        for batch in batches:
            for curve, start, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = np.frombuffer(body, np.int64)
                at = np.flatnonzero(np.isin(ids, sought.value))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), curve)), pa.array(ids[at]), pa.array(at + start)], names=["curve", "id", "rank"])

    found = runs.select("curve", "start", "ids").mapInArrow(ranked, "curve long, id long, rank long").toPandas()
    ranks = np.full((len(wanted), CURVES), 1 << 60)
    ranks[np.searchsorted(wanted, found["id"]), found["curve"] % CURVES] = found["rank"]
    gaps: list[list[int]] = [[] for _ in models]
    for r in near:
        a, b = np.searchsorted(wanted, [r["probe"], r["id"]])
        gaps[place[r["width"]]].append(int(np.abs(ranks[a] - ranks[b]).min()))
    return [max(k + 1, int(np.quantile(g, target)) if g else 0) for g in gaps]


def _cells(runs: DataFrame, reach: list[int], sizes: list[int], asks: list[int]) -> DataFrame:
    """(block, query, body): places in a block of the ids within reach of a query on one curve; written to the shared folder."""
    reaches = F.element_at(F.array(*map(F.lit, reach)), (F.floor(F.col("curve") / CURVES) + 1).cast("int"))
    deals = [1 + int(a * min(1.0, (CHUNK + 2 * r) / n)) // QUERY_BLOCK for r, n, a in zip(reach, sizes, asks)]
    deal = F.element_at(F.array(*map(F.lit, deals)), (F.floor(F.col("curve") / CURVES) + 1).cast("int"))

    def asking(batches):
        for batch in batches:
            for curve, start, body, at in zip(*(batch.column(i).to_pylist() for i in range(4))):
                at = np.frombuffer(at, np.int32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), curve)), pa.array(at + start), pa.array(np.frombuffer(body, np.int64)[at])], names=["curve", "rank", "query"])

    def chunk(of: F.Column) -> F.Column:
        return F.floor(of / CHUNK)

    held = runs.select("curve", "start", "ids", F.explode(F.sequence(chunk(F.col("start")), chunk(F.col("start") + F.col("n") - 1))).alias("chunk"))
    held = held.withColumn("deal", F.explode(F.sequence(F.lit(0), deal - 1)))
    asked = runs.where("octet_length(asks) > 0").select("curve", "start", "ids", "asks").mapInArrow(asking, "curve long, rank long, query long").withColumn("reach", reaches.cast("long"))
    asked = asked.withColumn("chunk", F.explode(F.sequence(chunk(F.greatest(F.col("rank") - F.col("reach"), F.lit(0))), chunk(F.col("rank") + F.col("reach")))))
    asked = asked.withColumn("deal", F.pmod(F.xxhash64("query"), deal).cast("int"))

    def windows(key, held, asked):
        rows: list[list] = [[], [], []]
        if held.num_rows and asked.num_rows:
            first = key[1].as_py() * CHUNK
            ids = np.full(CHUNK, -1)
            for start, body in zip(held["start"].to_pylist(), held["ids"].to_pylist()):
                run = np.frombuffer(body, np.int64)
                a, b = max(start, first), min(start + len(run), first + CHUNK)
                ids[a - first : b - first] = run[a - start : b - start]
            ids = ids[ids >= 0]  # a curve's last chunk is shorter
            for rank, query, reach in zip(asked["rank"].to_pylist(), asked["query"].to_pylist(), asked["reach"].to_pylist()):
                got = np.sort(ids[max(0, rank - reach - first) : max(0, rank + reach + 1 - first)])
                block = got >> BLOCK_BITS
                for part in np.split(got, np.flatnonzero(np.diff(block)) + 1) if len(got) else ():
                    rows[0].append(int(part[0] >> BLOCK_BITS))
                    rows[1].append(query)
                    rows[2].append((part & ((1 << BLOCK_BITS) - 1)).astype(np.uint16).tobytes())
        return pa.table({"block": pa.array(rows[0], pa.int64()), "query": pa.array(rows[1], pa.int64()), "body": pa.array(rows[2], pa.binary())})

    keys = ["curve", "chunk", "deal"]
    return cut(held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(windows, "block long, query long, body binary"))


def _best(nodes: DataFrame, cells: DataFrame, k: int, deals: int) -> DataFrame:
    """(query, node, least, score, compared): the ``k + 1`` nearest of each query in each block; each pair is compared once."""
    deal = F.pmod(F.xxhash64("query"), F.lit(deals)).cast("int").alias("deal")
    met = cells.select("block", "query", deal).distinct()
    vectors = met.join(nodes.where("asks").select(F.col("id").alias("query"), "v"), "query").select("block", "deal", "query", "v", F.lit(None).cast("binary").alias("body"))
    asked = vectors.union(cells.select("block", deal, "query", F.lit(None).cast("array<double>").alias("v"), "body"))
    asked = asked.select(*(F.col(c).alias(f"q_{c}") for c in asked.columns))
    held = nodes.select(F.shiftright("id", BLOCK_BITS).alias("block"), "id", "v", F.element_at("ids", 1).alias("least"))
    held = held.join(met.select("block", "deal").distinct(), "block").select(*(F.col(c).alias(f"n_{c}") for c in ("block", "deal", "id", "v", "least")))
    names, types = ["query", "node", "least", "score", "compared"], [np.int64, np.int64, np.int64, np.float64, np.int64]

    def compared(key, held, asked):
        out: list[list] = [[np.zeros(0, t)] for t in types]
        given = pc.is_valid(asked["q_v"]).to_numpy()
        bodies: dict[int, list] = {}
        for q, body in zip(asked["q_query"].to_pylist(), asked["q_body"].to_pylist()):
            if body is not None:
                bodies.setdefault(q, []).append(np.frombuffer(body, np.uint16))
        ids, least = held["n_id"].to_numpy(), held["n_least"].to_numpy()
        row = np.zeros(1 << BLOCK_BITS, np.int64)
        row[ids & ((1 << BLOCK_BITS) - 1)] = np.arange(len(ids))
        flat = held["n_v"].combine_chunks()
        starts = flat.offsets.to_numpy().astype(np.int64)
        flat = flat.values.to_numpy(zero_copy_only=False)
        for q, v in zip(asked["q_query"].to_pylist(), asked["q_v"].to_pylist()) if given.any() else ():
            if v is None:
                continue
            mark = np.zeros(1 << BLOCK_BITS, bool)
            for places in bodies[q]:
                mark[places] = True
            at = row[np.flatnonzero(mark)]
            v = np.array(v)
            x = flat[starts[at][:, None] + np.arange(len(v))]
            x -= v
            score = np.sqrt((x * x).sum(axis=1))
            top = at
            if len(at) > 8 * (k + 1):
                near = np.flatnonzero(score <= np.partition(score, k)[k])
                score, top = score[near], at[near]
            order = np.lexsort((least[top], score))[: k + 1]
            for column, value in zip(out, (np.full(len(order), q), ids[top[order]], least[top[order]], score[order], np.where(np.arange(len(order)) == 0, len(at), 0))):
                column.append(value)
        return pa.table({n: pa.array(np.concatenate(x).astype(t)) for n, x, t in zip(names, out, types)})

    return held.groupBy("n_block", "n_deal").cogroup(asked.groupBy("q_block", "q_deal")).applyInArrow(compared, "query long, node long, least long, score double, compared long")


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score, compared): for each vec_id divisible by ``every`` its ``k`` nearest found other rows."""
    rows = usable(vectors)
    nodes = _nodes(rows, k, every)
    sizes = nodes.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("long")).alias("asks")).orderBy("width").collect()
    if not sizes:
        return rows.selectExpr("vec_id AS query_id", "0 AS rank", "vec_id", "0D AS score", "0L AS compared").limit(0)
    line = Window.partitionBy("width").orderBy("h2", "h1")
    taken = nodes.withColumn("n", F.row_number().over(line)).where(F.col("n") <= SAMPLE).select("width", "v", "h1").orderBy("width", "h1").collect()
    models = [(w, Curves(np.array([r["v"] for r in held]))) for w, held in groupby(taken, key=lambda r: r["width"])]

    runs = _runs(nodes, models)
    reach = _reaches(nodes, runs, models, k, target)
    cells = _cells(runs, reach, [r["n"] for r in sizes], [r["asks"] for r in sizes])
    found = _best(nodes, cells, k, 1 + max(r["asks"] for r in sizes) // QUERY_BLOCK)

    of = Window.partitionBy("query")
    found = found.withColumns({"n": F.row_number().over(of.orderBy("score", "least", "node")), "compared": F.sum("compared").over(of)}).where(F.col("n") <= k + 1)
    members = found.join(nodes.select(F.col("id").alias("node"), "ids"), "node").select("query", "score", "compared", F.explode("ids").alias("vec_id"))
    members = members.withColumn("n", F.row_number().over(of.orderBy("score", "vec_id"))).where(F.col("n") <= k + 1).drop("n")
    asking = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct()
    asking = asking.join(nodes.select("h1", "h2", F.col("id").alias("query")), ["h1", "h2"]).select("query_id", "query")
    answers = asking.join(members, "query").where("vec_id <> query_id")
    order = Window.partitionBy("query_id", "query").orderBy("score", "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "compared")
