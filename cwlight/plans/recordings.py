"""Recordings as views over the tables at hand.

``events``: one channel per user, samples in time order; intensity is the value over
a dark level of ``DARK``, as values may be 0 and intensities may not.
``embeddings``: one channel per vector, 64 samples at 10 Hz; 24 channels make a
recording, two neighbouring channels a pair at 760 and 850 nm.  Sources stand a
metre apart; detectors lie 8, 9 or 30 mm from their source in turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FS, LENGTH, CHANNELS = 10.0, 64, 24
SPACING = (0.008, 0.009, 0.03)
DARK = 0.01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.lit(0).cast("long").alias("recording"), F.col("user_id").alias("channel"), "ts", "event_id", (F.col("value").cast("double") + DARK).alias("value"))
    line = Window.partitionBy("channel").orderBy("ts", "event_id")
    return rows.select("recording", "channel", F.row_number().over(line).cast("long").alias("sample"), "value")


def vector_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "x"))
    return rows.select(
        F.floor(F.col("vec_id") / CHANNELS).cast("long").alias("recording"), F.pmod("vec_id", F.lit(CHANNELS)).cast("long").alias("channel"), (F.col("at") + 1).cast("long").alias("sample"), F.col("x").cast("double").alias("value")
    )


def vector_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording, channel, pair, source, detector, wavelength_nm) of the vector recordings."""
    ids = table(spark, sf_dir, "embeddings").select("vec_id")
    channel = F.pmod("vec_id", F.lit(CHANNELS)).cast("long")
    pair = F.floor(channel / 2).cast("long")
    return ids.select(F.floor(F.col("vec_id") / CHANNELS).cast("long").alias("recording"), channel.alias("channel"), pair.alias("pair"), pair.alias("source"), pair.alias("detector"), F.when(channel % 2 == 0, 760).otherwise(850).alias("wavelength_nm"))


def vector_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording, role, idx, x, y, z) of sources and detectors, in metres."""
    pairs = vector_channels(spark, sf_dir).select("recording", "pair").distinct()
    apart = F.element_at(F.array(*map(F.lit, SPACING)), (F.pmod("pair", F.lit(3)) + 1).cast("int"))
    spots = pairs.select("recording", "pair", F.explode(F.array(F.struct(F.lit("source").alias("role"), F.lit(0.0).alias("y")), F.struct(F.lit("detector").alias("role"), apart.alias("y")))).alias("p"))
    return spots.select("recording", "p.role", F.col("pair").alias("idx"), F.col("pair").cast("double").alias("x"), F.col("p.y").alias("y"), F.lit(0.0).alias("z"))
