"""Motion artifacts: detection by windows, repair by kernels on blocks of channels."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cwlight.functions import kernels
from cwlight.sources import context
from cwlight.sources.tables import Recording, current

KEY = ["recording", "channel"]
SIGNAL = "recording long, channel long, sample long, value double"
#: Channels of a recording that go to numpy together.
BLOCK = 16


def whole(x: float) -> int:
    """Nearest whole number, halves to even."""
    return int(Decimal(repr(x)).quantize(Decimal(1), ROUND_HALF_EVEN))


def max_lag_change(samples: DataFrame, lags: int) -> DataFrame:
    """Adds ``change``: the largest absolute change over 1 to ``lags`` samples ahead; null at the last sample.

    The extremes of the samples ahead give it without a join: one sort per
    channel serves this and the windows that follow.
    """
    ahead = Window.partitionBy(*KEY).orderBy("sample").rowsBetween(1, lags)
    return samples.withColumn("change", F.greatest(F.max("value").over(ahead) - F.col("value"), F.col("value") - F.min("value").over(ahead)))


def motion_mask(samples: DataFrame, fs: float, t_motion: float = 0.5, t_mask: float = 1.0, sd_threshold: float = 20.0, amplitude_threshold: float = 0.5) -> DataFrame:
    """(recording, channel, sample, masked): changes over either threshold, widened by ``t_mask`` to both sides.

    A change belongs to the later of its samples, so the first sample is never
    masked.
    """
    lags, spread = max(1, whole(t_motion * fs)), whole(t_mask * fs)
    line = Window.partitionBy(*KEY).orderBy("sample")
    rows = max_lag_change(samples, lags).withColumn("step", F.col("value") - F.lag("value").over(line))
    sd = F.stddev_samp("step").over(Window.partitionBy(*KEY))
    bad = F.coalesce((F.col("change") > sd_threshold * sd) | (F.col("change") > amplitude_threshold), F.lit(False))
    near = F.max("bad").over(line.rowsBetween(-1 - spread, -1 + spread))
    return rows.withColumn("bad", bad).select(*KEY, "sample", ((F.col("sample") > 1) & F.coalesce(near, F.lit(False))).alias("masked"))


def group_wavelengths(mask: DataFrame, channels: DataFrame) -> DataFrame:
    """A sample masked in one channel is masked in all channels of its pair."""
    rows = mask.join(channels.select(*KEY, "pair"), KEY)
    joint = rows.groupBy("recording", "pair", "sample").agg(F.bool_or("masked").alias("masked"))
    return rows.drop("masked").join(joint, ["recording", "pair", "sample"]).select(*KEY, "sample", "masked")


def intervals(mask: DataFrame, fs: float) -> DataFrame:
    """(recording, channel, start_index, end_index, start_time, end_time) of the masked stretches of each channel."""
    line = Window.partitionBy(*KEY).orderBy("sample")
    runs = mask.where("masked").withColumn("run", F.col("sample") - F.row_number().over(line))
    out = runs.groupBy(*KEY, "run").agg(F.min("sample").alias("start_index"), F.max("sample").alias("end_index"))
    return out.select(*KEY, "start_index", "end_index", ((F.col("start_index") - 1) / fs).alias("start_time"), ((F.col("end_index") - 1) / fs).alias("end_time"))


def per_channel(samples: DataFrame, kernel, *more: str) -> DataFrame:
    """``kernel(values, *others)`` of all channels; a column is a channel, a row a sample in order.

    Spark deals out blocks of at most ``BLOCK`` channels of one recording, so a
    group grows with the length of a recording, not with the table.  Channels
    of one length in a block come as one matrix.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for n, part in by_length(pdf):
            part["value"] = kernel(*(part[c].to_numpy(float).reshape(-1, n).T for c in ("value", *more))).T.ravel()
            out.append(part[[*KEY, "sample", "value"]])
        return pd.concat(out)

    rows = samples.select(*KEY, "sample", "value", *more)
    return rows.groupBy("recording", block()).applyInPandas(run, SIGNAL)


def block() -> Column:
    """The block of a channel within its recording."""
    return F.floor(F.col("channel") / BLOCK).alias("block")


def by_length(pdf: pd.DataFrame) -> list[tuple[int, pd.DataFrame]]:
    """(length, rows by channel and sample) of the channels of each length."""
    pdf = pdf.sort_values(["channel", "sample"], ignore_index=True)
    size = pdf.groupby("channel")["sample"].transform("size")
    return [(int(n), pdf[size == n].copy()) for n in size.unique()]


def tddr(samples: DataFrame, fs: float, cutoff_hz: float = 0.5, tune: float = 4.685, rounds: int = 50) -> DataFrame:
    """Temporal derivative distribution repair."""
    return per_channel(samples, lambda x: kernels.tddr(x, fs, cutoff_hz, tune, rounds))


def wavelet_correct(samples: DataFrame, iqr: float = 1.5, min_level: int = 4) -> DataFrame:
    """Wavelet coefficients beyond the quartile fences removed."""
    return per_channel(samples, lambda x: kernels.wavelet_repair(x, iqr, min_level))


def spline_correct(samples: DataFrame, mask: DataFrame, fs: float, p: float = 0.99, lost: str = "error", source: Recording | None = None, assay: str | None = None) -> DataFrame:
    """Spline repair of masked stretches.  Channels without any pass by the kernel; a mask of another signal is refused where it is bound.

    A mask bound by ``context.bound`` to an ``assay`` of ``source`` (its samples,
    contract, clock and list) is refused where one of these has changed.

    A channel masked from end to end has no level to return to: an error, or
    with ``lost="null"`` a null for each of its samples.
    """
    if lost not in ("error", "null"):
        raise ValueError("lost must be 'error' or 'null'")
    whole_ = Window.partitionBy(*KEY)
    if "context" in mask.columns:
        mask = context.checked(mask, source, None if source is None else context.of_assay(source, assay or source.only("optical_density")))
    rows = samples.join(current(mask, samples), [*KEY, "sample"])
    touched = rows.withColumns({"any": F.max("masked").over(whole_), "all": F.min("masked").over(whole_)})
    sent = touched.where("any" if lost == "error" else "any AND NOT all")
    fixed = per_channel(sent, lambda x, bad: kernels.spline_repair(x, np.arange(len(x)) / fs, bad.astype(bool), fs, p), "masked")
    out = fixed.unionByName(touched.where("NOT any").select(*KEY, "sample", "value"))
    return out if lost == "error" else out.unionByName(touched.where("all").select(*KEY, "sample", F.lit(None).cast("double").alias("value")))


def db2_level(samples: DataFrame, length: int) -> DataFrame:
    """(recording, channel, k, approximation, detail): one periodic wavelet level by a join with the taps."""
    spark = samples.sparkSession
    taps = spark.createDataFrame([(j, float(a), float(b)) for j, (a, b) in enumerate(zip(kernels.DB2_LOW, kernels.DB2_HIGH))], "tap int, low double, high double")
    # Sample s (from 1) meets tap j in the outputs k with 2k + j - 1 = s - 1 modulo the length.
    at = F.pmod(F.col("sample") - F.col("tap"), F.lit(length))
    met = samples.crossJoin(F.broadcast(taps)).where(at % 2 == 0)  # four rows
    return met.groupBy(*KEY, (at / 2 + 1).cast("long").alias("k")).agg(F.sum(F.col("value") * F.col("low")).alias("approximation"), F.sum(F.col("value") * F.col("high")).alias("detail"))
