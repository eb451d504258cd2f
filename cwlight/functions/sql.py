"""Signal kernels as SQL functions on arrays of doubles, one array a channel in sample order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from cwlight.functions import kernels


@F.pandas_udf(ArrayType(DoubleType()))
def tddr(values: pd.Series, fs: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else kernels.tddr(np.asarray(v, float), f) for v, f in zip(values, fs)])


@F.pandas_udf(ArrayType(DoubleType()))
def wavelet_repair(values: pd.Series, iqr: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else kernels.wavelet_repair(np.asarray(v, float), q) for v, q in zip(values, iqr)])


@F.pandas_udf(ArrayType(DoubleType()))
def bandpass(values: pd.Series, fs: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else kernels.bandpass(np.asarray(v, float), f, (a, b)) for v, f, a, b in zip(values, fs, low, high)])


@F.pandas_udf(DoubleType())
def snr_db(values: pd.Series, fs: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    def one(v: np.ndarray, f: float, a: float, b: float) -> float:
        return kernels.snr_db(np.asarray(v, float), f, (a, b), [(f / len(v), a), (b, f / 2)])

    return pd.Series([None if v is None else one(v, f, a, b) for v, f, a, b in zip(values, fs, low, high)])


@F.pandas_udf(DoubleType())
def peak_power(x: pd.Series, y: pd.Series, fs: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else kernels.peak_power(np.asarray(a, float), np.asarray(b, float), f) for a, b, f in zip(x, y, fs)])


@F.pandas_udf(ArrayType(DoubleType()))
def spline_repair(values: pd.Series, masked: pd.Series, fs: pd.Series) -> pd.Series:
    def one(v: np.ndarray, m: np.ndarray, f: float) -> np.ndarray:
        return kernels.spline_repair(np.asarray(v, float), np.arange(len(v)) / f, np.asarray(m, bool), f)

    return pd.Series([None if v is None or m is None else one(v, m, f) for v, m, f in zip(values, masked, fs)])


@F.pandas_udf(ArrayType(StructType([StructField("start_index", IntegerType()), StructField("end_index", IntegerType())])))
def mask_intervals(masked: pd.Series) -> pd.Series:
    """Masked stretches, from 1, ends included."""

    def one(m: np.ndarray) -> list[dict]:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(m, bool).astype(int), [0]])))
        return [{"start_index": int(a) + 1, "end_index": int(b)} for a, b in zip(edges[::2], edges[1::2])]

    return pd.Series([None if m is None else one(m) for m in masked])


FUNCTIONS = {"signal_spline_repair": spline_repair, "signal_mask_intervals": mask_intervals, "signal_tddr": tddr, "signal_wavelet_repair": wavelet_repair, "signal_bandpass": bandpass, "signal_snr_db": snr_db, "signal_peak_power": peak_power}


def register(spark: SparkSession) -> None:
    """Makes the kernels callable in SQL under the names in ``FUNCTIONS``."""
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
