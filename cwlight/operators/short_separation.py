"""Short-separation nuisance: regression on short channels, design matrices, physiological bands."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cwlight.functions import kernels
from cwlight.operators import split_filter
from cwlight.operators.geometry import nearest_short
from cwlight.operators.motion import KEY, SIGNAL, per_channel, whole
from cwlight.sources import context
from cwlight.sources.tables import Recording

#: Physiological bands in Hz.
BANDS = {"mayer": (0.07, 0.13), "respiration": (0.15, 0.40), "cardiac": (0.70, 2.00)}
TINY = kernels.ROOT_EPS
#: Parts into which the design columns of a recording are dealt.
DEAL = 4


def exact_lag(lag_seconds: float, fs: float) -> int:
    exact = lag_seconds * fs
    lag = whole(exact)
    if abs(exact - lag) > TINY * max(1.0, abs(exact)):
        raise ValueError("lag_seconds must be a whole number of samples")
    return lag


def regress_nearest(samples: DataFrame, mapped: DataFrame, fs: float, lag_seconds: float = 0.0, source: Recording | None = None) -> DataFrame:
    """(recording, channel, sample, value): long channels less what their nearest short channel explains.

    A positive lag lets the short sample at t - lag speak for the long sample at
    t.  Samples without a partner, and short channels, stay as they are.  A map
    that ``context.bound`` ties to its recordings is refused if ``source`` is not
    what it was made from.
    """
    mapped = context.checked(mapped, source)
    lag = exact_lag(lag_seconds, fs)
    pick = nearest_short(mapped).select("recording", F.col("target").alias("channel"), "short")
    short = samples.select("recording", F.col("channel").alias("short"), (F.col("sample") + lag).alias("sample"), F.col("value").alias("x"))
    rows = samples.join(pick, KEY, "left").join(short, ["recording", "short", "sample"], "left")
    met = rows.where("x IS NOT NULL")
    fit = met.groupBy(*KEY).agg(F.regr_slope("value", "x").alias("slope"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.max(F.abs("x")).alias("most"))
    flat = F.col("sd") <= TINY * F.greatest(F.lit(1.0), F.col("most"))
    fit = fit.withColumn("slope", F.when(flat, F.raise_error(F.lit("the short signal hardly varies")).cast("double")).otherwise(F.col("slope")))
    out = rows.join(fit.select(*KEY, "slope", "mean"), KEY, "left")
    value = F.when(F.col("x").isNull(), F.col("value")).otherwise(F.col("value") - (F.col("x") - F.col("mean")) * F.col("slope"))
    return out.select(*KEY, "sample", value.alias("value"))


def regress_all(samples: DataFrame, mapped: DataFrame, fs: float, lag_seconds: float = 0.0, condition_limit: float = 1e10, source: Recording | None = None) -> DataFrame:
    """As ``regress_nearest``, on all short channels of the wavelength at once.

    A recording's channels of one wavelength are one group.
    """
    mapped = context.checked(mapped, source)
    lag = exact_lag(lag_seconds, fs)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        short = pdf.groupby("channel")["is_short"].first()
        wide = pdf.pivot(index="sample", columns="channel", values="value").sort_index()
        data, out = wide.to_numpy(float), wide.to_numpy(float).copy()
        shorts = np.flatnonzero(short.loc[wide.columns].to_numpy())
        longs = np.flatnonzero(~short.loc[wide.columns].to_numpy())
        if not len(shorts) and len(longs):
            raise ValueError("no short channel of the same wavelength")
        n = len(data)
        rows = np.arange(max(0, lag), n + min(0, lag))
        x = data[rows - lag][:, shorts]
        x = x - x.mean(axis=0)
        if len(longs):
            full = np.column_stack([np.ones(len(x)), data[rows - lag][:, shorts]])
            size = np.linalg.svd(full, compute_uv=False)
            if size[-1] <= 0 or size[0] / size[-1] > condition_limit:
                raise ValueError("the short signals are too alike to be told apart")
            y = data[rows][:, longs]
            beta = np.linalg.lstsq(x, y - y.mean(axis=0), rcond=None)[0]
            out[np.ix_(rows, longs)] = y - x @ beta
        return pd.DataFrame(out, index=wide.index, columns=wide.columns).stack().rename("value").reset_index().assign(recording=pdf["recording"].iloc[0])[["recording", "channel", "sample", "value"]]

    rows = samples.join(mapped.select(*KEY, "wavelength_nm", "is_short"), KEY)
    return rows.groupBy("recording", "wavelength_nm").applyInPandas(run, SIGNAL)


def bandpass(samples: DataFrame, fs: float, band: str = "mayer", range_hz: tuple[float, float] | None = None, order: int = 3, split: int | None = None) -> DataFrame:
    """Each channel's zero-phase Butterworth band.

    With ``split`` a channel is filtered in blocks of that many samples, so that
    no task needs a whole one; else channels go to tasks whole.
    """
    edges = range_hz or BANDS[band]
    if not 0 < edges[0] < edges[1] < fs / 2:
        raise ValueError("a band must increase and lie below half the sampling rate")
    if split is None:
        return per_channel(samples, lambda x: kernels.bandpass(x, fs, edges, order))
    b, a = kernels.butterworth(order, edges, fs)
    least = 2 * max(len(a), len(b)) + 1
    known = samples.groupBy(*KEY).agg((F.min("value") == F.max("value")).alias("flat"), F.count(F.lit(1)).alias("n"))
    short = F.raise_error(F.lit(f"a band filter of order {order} needs {least} samples")).cast("boolean")
    known = known.select(*KEY, F.when(F.col("n") >= least, F.col("flat")).otherwise(short).alias("flat"))
    out = split_filter.both_ways(samples, b, a, "zeros", split).join(known, KEY)
    return out.select(*KEY, "sample", F.when(F.col("flat"), 0.0).otherwise(F.col("value")).alias("value"))


def design_columns(samples: DataFrame, mapped: DataFrame, aggregation: str = "all", source: Recording | None = None) -> DataFrame:
    """(recording, column, sample, value): nuisance regressors from the short channels, one or one mean per wavelength.

    A bound map is checked as in ``regress_nearest``.
    """
    mapped = context.checked(mapped, source)
    short = samples.join(mapped.where("is_short").select(*KEY, "wavelength_nm", "pair"), KEY)
    if aggregation == "all":
        name = F.concat_ws("_", F.lit("short"), F.format_string("S%d_D%d", "pair", "pair"), F.concat(F.lit("wl"), F.col("wavelength_nm").cast("string")))  # null, and left out, for pairs
        return short.select("recording", name.alias("column"), "sample", "value")
    if aggregation != "mean":
        raise ValueError("aggregation must be 'all' or 'mean'")
    name = F.concat_ws("_", F.lit("short_mean"), F.concat(F.lit("wl"), F.col("wavelength_nm").cast("string")))
    return short.groupBy("recording", name.alias("column"), "sample").agg(F.avg("value").alias("value"))


def with_bands(design: DataFrame, fs: float, bands: dict[str, tuple[float, float]], order: int = 3) -> DataFrame:
    """The design with a band-passed copy of each column for each band.

    Columns of one length in a recording are filtered as one matrix, for all
    bands, in one group and one read of the design.
    """

    def copies(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["column", "sample"], ignore_index=True)
        size = pdf.groupby("column")["sample"].transform("size")
        out = [pdf]
        for n in size.unique():
            part = pdf[size == n]
            x = part["value"].to_numpy(float).reshape(-1, int(n)).T
            out += [part.assign(column=part["column"] + f"_{name}", value=kernels.bandpass(x, fs, edges, order).T.ravel()) for name, edges in bands.items()]
        return pd.concat(out)

    part = F.pmod(F.xxhash64("column"), F.lit(DEAL))
    return design.groupBy("recording", part).applyInPandas(copies, design.schema)


def standardized(design: DataFrame) -> DataFrame:
    """Each column less its mean, over its sample deviation."""
    stats = design.groupBy("recording", "column").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.max(F.abs("value")).alias("most"))
    flat = F.col("s") <= TINY * F.greatest(F.lit(1.0), F.col("most"))
    scale = F.when(flat, F.raise_error(F.lit("a design column hardly varies")).cast("double")).otherwise(F.col("s"))
    return design.join(stats, ["recording", "column"]).select("recording", "column", "sample", ((F.col("value") - F.col("m")) / scale).alias("value"))
