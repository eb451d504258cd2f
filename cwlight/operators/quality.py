"""Signal quality over hopping windows, and pruning by it."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cwlight.functions import kernels
from cwlight.operators import split_filter
from cwlight.operators.motion import KEY, block, by_length, per_channel
from cwlight.sources.tables import current

EPS = float(np.finfo(float).eps)
#: Pairs of a recording whose windows are scored together.
PAIRS = 8
SCORE = "recording long, channel long, window int, score double"


def windows(n: int, size: int, step: int) -> int:
    """Complete windows of ``size`` samples every ``step`` in ``n``."""
    return (n - size) // step + 1 if n >= size else 0


def in_windows(samples: DataFrame, n: int, size: int, step: int) -> DataFrame:
    """Adds ``window`` (from 1): a sample comes once for each complete window that holds it.

    The windows of a sample follow from its number, so there is no range join.
    """
    count = windows(n, size, step)
    first = F.greatest(F.lit(1), F.ceil((F.col("sample") - size) / step) + 1)
    last = F.least(F.lit(count), F.floor((F.col("sample") - 1) / step) + 1)
    rows = samples.withColumns({"first": first.cast("int"), "last": last.cast("int")}).where("first <= last")
    return rows.withColumn("window", F.explode(F.sequence("first", "last"))).drop("first", "last")


def quality_filter(samples: DataFrame, fs: float, low: float = 0.7, high: float = 1.5, order: int = 3, split: int | None = None) -> DataFrame:
    """Band filter of whole channels, once, before any window is cut; with ``split``, by blocks of that many samples."""
    b, a = kernels.butterworth(order, (low, high), fs)
    if split is not None:
        return split_filter.both_ways(samples, b, a, "hold", split)
    return per_channel(samples, lambda x: kernels.both_ways(b, a, x, "hold"))


def coupling(filtered: DataFrame, channels: DataFrame, n: int, size: int, step: int) -> DataFrame:
    """(recording, channel, window, score): the least correlation between two wavelengths of a pair.

    A near-constant signal scores 0; every wavelength of a pair has its score.
    """
    rows = filtered.join(channels.select(*KEY, "pair"), KEY)
    x = rows.select("recording", "pair", "sample", F.col("channel").alias("cx"), F.col("value").alias("x"))
    y = rows.select("recording", "pair", "sample", F.col("channel").alias("cy"), F.col("value").alias("y"))
    # Samples meet before they are dealt to windows, so each is shuffled once.
    both = in_windows(x.join(y, ["recording", "pair", "sample"]).where("cx < cy"), n, size, step)
    stats = both.groupBy("recording", "pair", "window", "cx", "cy").agg(
        F.covar_samp("x", "y").alias("c"), *(f(k).alias(f"{name}{k}") for k in "xy" for name, f in (("s", F.stddev_samp), ("m", lambda k: F.max(F.abs(k)))))
    )
    flat = lambda k: F.col(f"s{k}") <= kernels.ROOT_EPS * F.greatest(F.lit(1.0), F.col(f"m{k}"))
    score = F.when(flat("x") | flat("y"), 0.0).otherwise(F.try_divide(F.col("c"), F.col("sx") * F.col("sy")))
    least = stats.groupBy("recording", "pair", "window").agg(F.min(F.coalesce(score, F.lit(0.0))).alias("score"))
    return channels.select(*KEY, "pair").join(least, ["recording", "pair"]).select(*KEY, "window", "score")


def scalp_coupling(samples: DataFrame, channels: DataFrame, fs: float, n: int, size: int | None = None, step: int | None = None, low: float = 0.7, high: float = 1.5, order: int = 3) -> DataFrame:
    """Scalp-coupling index: coupling in the cardiac band."""
    size = size or n
    return coupling(quality_filter(samples, fs, low, high, order), channels, n, size, step or size)


def noise_bands(fs: float, size: int, cardiac: tuple[float, float]) -> list[tuple[float, float]]:
    """What lies below and above the cardiac band."""
    bands = [(fs / size, cardiac[0]), (cardiac[1], fs / 2 - EPS * fs)]
    return [b for b in bands if b[1] > b[0]]


def snr(samples: DataFrame, fs: float, n: int, size: int, step: int | None = None, cardiac: tuple[float, float] = (0.7, 1.5), noise: list[tuple[float, float]] | None = None) -> DataFrame:
    """(recording, channel, window, score): decibels of cardiac over other power."""
    bands, count = noise or noise_bands(fs, size, cardiac), windows(n, size, step or size)
    if any(lo < cardiac[1] and hi > cardiac[0] for lo, hi in bands):
        raise ValueError("noise bands must not overlap the cardiac band")
    if any(a[1] > b[0] for a, b in zip(sorted(bands), sorted(bands)[1:])):
        raise ValueError("noise bands must not overlap one another")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for m, part in by_length(pdf):
            for c, x in zip(part["channel"].to_numpy()[::m], part["value"].to_numpy(float).reshape(-1, m)):
                out += [(part["recording"].iloc[0], c, w + 1, kernels.snr_db(x[w * (step or size) : w * (step or size) + size], fs, cardiac, bands)) for w in range(count)]
        return pd.DataFrame(out, columns=["recording", "channel", "window", "score"]).astype({"window": np.int32})

    return samples.groupBy("recording", block()).applyInPandas(run, SCORE)


def peak_power(samples: DataFrame, channels: DataFrame, fs: float, n: int, size: int, step: int | None = None, cardiac: tuple[float, float] = (0.7, 1.5), order: int = 3) -> DataFrame:
    """(recording, channel, window, score): the least peak power between two wavelengths of a pair."""
    step, count = step or size, windows(n, size, step or size)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pair", "channel", "sample"], ignore_index=True)
        heads = pdf.groupby(["pair", "channel"], sort=True).agg(n=("sample", "size")).reset_index()
        starts = np.concatenate([[0], np.cumsum(heads["n"])])
        value, alike, out = pdf["value"].to_numpy(float), {}, []
        for pair, rows in heads.groupby("pair").indices.items():
            lengths = heads["n"].to_numpy()[rows]
            # Pairs of one shape are scored together; channels that do not cover the windows score 0.
            shape = (len(rows), int(lengths[0])) if (lengths == lengths[0]).all() and lengths[0] >= (count - 1) * step + size else (len(rows), 0)
            alike.setdefault(shape, []).append(rows)
        for (k, m), pairs in alike.items():
            rows = np.array(pairs)
            least = np.zeros((len(rows), count))
            if k > 1 and m:
                x = np.stack([value[starts[r] : starts[r] + m] for r in rows.ravel()]).reshape(len(rows), k, m)
                cuts = np.stack([x[:, :, w * step : w * step + size] for w in range(count)], axis=2)
                scores = np.stack([kernels.peak_power(cuts[:, i], cuts[:, j], fs) for i, j in combinations(range(k), 2)])
                least = np.where(np.isfinite(scores).all(axis=0), scores.min(axis=0), 0.0)
            channel = heads["channel"].to_numpy()[rows.ravel()]
            out.append(pd.DataFrame({"recording": pdf["recording"].iloc[0], "channel": np.repeat(channel, count), "window": np.tile(np.arange(1, count + 1, dtype=np.int32), len(channel)), "score": np.repeat(least, k, axis=0).ravel()}))
        return pd.concat(out)

    rows = quality_filter(samples, fs, *cardiac, order).join(channels.select(*KEY, "pair"), KEY)
    return rows.groupBy("recording", F.floor(F.col("pair") / PAIRS).alias("part")).applyInPandas(run, SCORE)


def judged(scores: DataFrame, metric: str, threshold: float) -> DataFrame:
    """Scores with their metric and ``passed``: at the threshold or over it."""
    return scores.withColumns({"metric": F.lit(metric), "passed": F.col("score") >= threshold})


def same_identity(judgements: DataFrame) -> DataFrame:
    """The judgements, if within each recording all metrics judge the same channels over the same windows; else an error.

    Sets are compared by counts and sums of hashes, which each task adds up for
    its own rows; nothing is sorted.
    """
    key = F.xxhash64("channel", "window")
    sets = judgements.groupBy("recording", "metric").agg(F.count(F.lit(1)).alias("n"), F.sum(key.cast("decimal(38,0)")).alias("total"), F.bit_xor(key).alias("mixed"))
    alike = sets.groupBy("recording").agg(F.count_distinct("n", "total", "mixed").alias("kinds"))
    text = F.concat(F.lit("metrics judge other channels or windows in recording "), F.col("recording").cast("string"))
    fine = F.when(F.col("kinds") == 1, F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))
    return judgements.join(alike, "recording").where(fine).select(*judgements.columns)


def _verdict(require_all: bool) -> Column:
    return F.bool_and("ok") if require_all else F.bool_or("ok")


def prune(judgements: DataFrame, channels: DataFrame, action: str = "mark", require_all: bool = True, source: DataFrame | None = None) -> DataFrame:
    """One row per channel: passed, metrics, failed_windows; ``drop`` judges whole pairs and gives the rows that stay.

    A metric passes where all its windows do; all metrics must judge the same
    channels and windows.  Judgements bound to a signal are
    refused if ``source`` is another.
    """
    if source is not None:
        judgements = current(judgements, source)
    if action not in ("mark", "drop"):
        raise ValueError("action must be 'mark' or 'drop'")
    by_metric = same_identity(judgements).groupBy(*KEY, "metric").agg(F.bool_and("passed").alias("ok"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.format_string("%s:w%04d", "metric", "window")))).alias("failed"))
    out = by_metric.groupBy(*KEY).agg(_verdict(require_all).alias("passed"), F.concat_ws(",", F.array_sort(F.collect_list("metric"))).alias("metrics"), F.concat_ws(";", F.array_sort(F.flatten(F.collect_list("failed")))).alias("failed_windows"))
    if action == "mark":
        return out
    known = out.join(channels.select(*KEY, "pair"), KEY)
    pairs = known.groupBy("recording", "pair").agg(F.bool_and("passed").alias("stays"))
    return known.join(pairs.where("stays"), ["recording", "pair"], "left_semi").select(*out.columns)


def summary(judgements: DataFrame) -> DataFrame:
    """(metric, channels, windows, passed, scored): what one line about a result says."""
    return judgements.groupBy("metric").agg(F.count_distinct(*KEY).alias("channels"), F.count_distinct("window").alias("windows"), F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("scored"))
