"""Small helpers shared by the text operators: checkpoints, samples, Arrow access."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a new local one on a local master and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="cwlight-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows no model may learn from: crc32 of the id as text, modulo 3, is 1.

    A null id counts as not held out.
    """
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def pick_per_class(df: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` documents of every value of ``label``: (label, doc_id).

    Every class is dealt into ``per_class`` hash cells and each cell keeps one
    id.  It is one aggregation with partial results on the map side, so a class
    holding most rows costs no more than another.
    """
    h = F.xxhash64(F.col("doc_id").cast("string"))
    cell = F.pmod(h, F.lit(per_class))
    return (
        df.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(label, cell.alias("cell"))
        .agg(F.min(F.struct(F.xxhash64(h).alias("h"), F.col("doc_id"))).alias("m"))
        .select(label, F.col("m.doc_id").alias("doc_id"))
    )


def text_buffer(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null counts as an empty string."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if values.null_count:
        values = values.fill_null("")
    wide = pa.types.is_large_string(values.type)
    _, off, data = values.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    return raw[lo:hi], offsets - lo


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about ``most`` bytes each; a longer row stands alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def small(df: DataFrame, most: int) -> DataFrame:
    """``df``, a written table, marked for broadcast if it has at most ``most`` rows; Spark shuffles it otherwise."""
    return F.broadcast(df) if df.count() <= most else df


def total_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"])


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` dealt to all cores, where the table has too few partitions for half of them; else as it is.

    A table of one file and row group would otherwise be one Python task.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if 2 * docs.rdd.getNumPartitions() <= cores else docs
