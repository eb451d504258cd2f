"""Delivery of updates: a bounded queue of chunks in front of the loop, a ledger of receipts behind it.

Both lie in folders that any store Spark reads can hold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLES = "stream string, t double, channels array<double>"
RECEIPT = "stream string, sequence long, time double, scheduled double, values map<string,double>, receipt string, batch long"
SKIP = "stream string, time double, scheduled double, skipped string, skipped_count long, batch long"
#: Chunks that may wait; receipts kept for each stream.
CAPACITY, KEPT = 16, 1024


class ChunkQueue:
    """Chunks of samples that wait for a step, one folder each, oldest first.

    A chunk is written under a passing name and then renamed into its place, and
    admitted by another rename, so a step sees whole chunks only.
    """

    def __init__(self, spark: SparkSession, folder: str, capacity: int = CAPACITY) -> None:
        self.spark, self.folder, self.capacity = spark, folder.rstrip("/"), capacity
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for part in ("waiting", "admitted"):
            self._fs.mkdirs(self._path(f"{self.folder}/{part}"))

    def _names(self, part: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/{part}")))

    def waiting(self) -> int:
        return len(self._names("waiting"))

    def offer(self, chunk: DataFrame) -> str:
        """Puts (stream, t, channels) rows behind all that wait, and gives the chunk's name."""
        last = max((int(n.split("-")[0]) for part in ("waiting", "admitted") for n in self._names(part)), default=-1)
        name = f"{last + 1:012d}-{uuid.uuid4().hex[:8]}"
        chunk.select("stream", "t", "channels").write.parquet(f"{self.folder}/coming-{name}")
        self._move(f"coming-{name}", f"waiting/{name}")
        return name

    def _move(self, a: str, b: str) -> None:
        if not self._fs.rename(self._path(f"{self.folder}/{a}"), self._path(f"{self.folder}/{b}")):
            raise RuntimeError(f"cannot move {a} to {b}")

    def admit(self, most: int) -> list[str]:
        """Lets the ``most`` oldest chunks through; an error where more wait than the queue may hold."""
        names = self._names("waiting")
        if len(names) > self.capacity:
            raise RuntimeError(f"{len(names)} chunks wait, and the queue holds {self.capacity}")
        for name in names[:most]:
            self._move(f"waiting/{name}", f"admitted/{name}")
        return names[:most]

    def stream(self) -> DataFrame:
        """Admitted chunks as a streaming DataFrame."""
        return self.spark.readStream.schema(SAMPLES).option("recursiveFileLookup", "true").parquet(f"{self.folder}/admitted")


class Ledger:
    """Updates with their receipts: each (stream, sequence) once, without gaps, by one writer.

    A batch is one commit: the last ``kept`` receipts of every stream, those of
    the batch included, under the batch's number and the writer's name.  What
    came before is read from the newest commit only.  A batch that comes again
    adds nothing; a gap, or a commit by someone else, raises an error and claims
    nothing.  Skipped slots are kept beside them.
    """

    def __init__(self, spark: SparkSession, folder: str, writer: str, kept: int = KEPT) -> None:
        self.spark, self.folder, self.writer, self.kept = spark, folder.rstrip("/"), writer, kept

    def _read(self, part: str, schema: str, more: str = "") -> DataFrame:
        try:
            return self.spark.read.schema(schema + more).parquet(f"{self.folder}/{part}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema + more)

    def _write(self, rows: DataFrame, part: str, *keys: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{self.folder}/{part}")

    def receipts(self) -> DataFrame:
        """(stream, sequence, time, scheduled, values, receipt, batch): the last receipts of every stream."""
        every = self._read("receipts", RECEIPT.replace("batch long", "first_batch long"), ", batch long, writer string")
        newest = every.agg(F.max("batch")).first()[0]
        held = every.where(F.col("batch") == (-1 if newest is None else newest))
        return held.select("stream", "sequence", "time", "scheduled", "values", "receipt", F.col("first_batch").alias("batch"), F.col("batch").alias("commit"), "writer")

    def commit(self, updates: DataFrame, batch: int) -> None:
        """The updates of one batch (``feedback.UPDATE`` rows): for ``foreachBatch``."""
        updates = updates.persist()
        try:
            now = self.receipts().persist()
            state = now.agg(F.max("commit").alias("last"), F.max(F.col("writer") != F.lit(self.writer)).alias("foreign")).first()
            if state["foreign"]:
                raise RuntimeError("another writer has committed to this ledger")
            if state["last"] is not None and state["last"] > batch:
                raise RuntimeError(f"the ledger holds batch {state['last']}, which is later than {batch}")
            skips = updates.where("skipped IS NOT NULL").select("stream", "time", "scheduled", "skipped", "skipped_count", F.lit(batch).cast("long").alias("batch"))
            self._write(skips, "skips", "batch")
            if state["last"] == batch:  # it comes again
                return
            # All targets of an update are one row, so an update is delivered whole or not at all.
            new = updates.where("skipped IS NULL").groupBy("stream", "sequence").agg(F.max("time").alias("time"), F.max("scheduled").alias("scheduled"), F.map_from_entries(F.collect_list(F.struct("target", "value"))).alias("values"))
            came = new.groupBy("stream").agg(F.min("sequence").alias("low"), F.max("sequence").alias("high"), F.count(F.lit(1)).alias("n"))
            heads = now.groupBy("stream").agg(F.max("sequence").alias("head"))
            seen = came.join(heads, "stream", "left").withColumn("expected", F.coalesce(F.col("head") + 1, F.lit(0)))
            wrong = seen.where("low != expected OR high - low + 1 != n").first()
            if wrong is not None:
                raise RuntimeError(f"stream {wrong['stream']}: updates {wrong['low']} to {wrong['high']} came where {wrong['expected']} is next")
            if new.isEmpty():
                return
            signed = F.sha2(F.concat_ws(":", F.lit(self.writer), F.lit(str(batch)), "stream", F.col("sequence").cast("string")), 256)
            signed = new.select("stream", "sequence", "time", "scheduled", "values", signed.alias("receipt"), F.lit(batch).cast("long").alias("first_batch"))
            held = now.withColumnRenamed("batch", "first_batch").select(*signed.columns).unionByName(signed)
            place = F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("sequence")))
            last = held.withColumn("place", place).where(F.col("place") <= self.kept).drop("place")
            self._write(last.withColumns({"batch": F.lit(batch).cast("long"), "writer": F.lit(self.writer)}), "receipts", "batch", "writer")
            now.unpersist()
        finally:
            updates.unpersist()

    def undelivered(self, since: dict[str, int] | int) -> DataFrame:
        """(stream, sequence, time, scheduled, values) from the given sequence on, of all streams or of those named.

        An error where receipts that old are gone, so that a reader never takes
        a part for the whole.
        """
        rows = self.receipts()
        if isinstance(since, dict):
            known = self.spark.createDataFrame(list(since.items()), "stream string, next long")
            rows = rows.join(F.broadcast(known), "stream")  # as many rows as the caller has typed
        else:
            rows = rows.withColumn("next", F.lit(int(since)).cast("long"))
        rows = rows.withColumn("gap", F.min("sequence").over(Window.partitionBy("stream")) > F.col("next"))
        text = F.concat(F.lit("receipts before the oldest kept are asked for: stream "), F.col("stream"))
        fine = F.when(F.col("gap"), F.raise_error(text).cast("boolean")).otherwise(F.col("sequence") >= F.col("next"))
        return rows.where(fine).select("stream", "sequence", "time", "scheduled", "values")

    def updates(self) -> DataFrame:
        """Updates and skipped slots that are kept, one row for each target."""
        sent = self.receipts().select("stream", "sequence", "time", "scheduled", F.explode("values").alias("target", "value"), F.lit(None).cast("string").alias("skipped"), F.lit(0).cast("long").alias("skipped_count"))
        lost = self._read("skips", SKIP)
        return sent.unionByName(lost.select("stream", F.lit(None).cast("long").alias("sequence"), "time", "scheduled", F.lit(None).cast("string").alias("target"), F.lit(None).cast("double").alias("value"), "skipped", "skipped_count"))
