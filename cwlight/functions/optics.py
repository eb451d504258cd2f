"""Optical constants as Spark columns: pathlength factors and extinction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Duncan 1996, wavelength to (constant, slope, exponent of age).
DUNCAN = {690: (5.38, 0.049, 0.877), 744: (5.11, 0.106, 0.723), 807: (4.99, 0.067, 0.814), 832: (4.67, 0.062, 0.819)}
#: Known points of the haemoglobin extinction grid, nm to (HbO2, HbR) in 1/(cm M), base 10.
EXTINCTION = {250: (106112.0, 112736.0), 252: (105552.0, 112736.0), 690: (276.0, 2051.96), 760: (586.0, 1548.52), 762: (598.0, 1508.44), 850: (1058.0, 691.32)}
#: 1/(cm M) in base 10 to 1/(m M) in base e.
NATURAL = 100 * math.log(10)


def _checked(value: Column, fine: Column, text: str) -> Column:
    return F.when(fine, value).otherwise(F.raise_error(F.lit(text)).cast("double"))


def dpf_scholkmann(wavelength_nm: Column, age_years: Column, extrapolate: bool = False) -> Column:
    """Differential pathlength factor, Scholkmann and Wolf 2013; 650-950 nm, 0-70 years."""
    w = wavelength_nm.cast("double")
    value = 223.3 + 0.05624 * F.pow(age_years.cast("double"), 0.8493) - 5.723e-7 * w * w * w + 0.001245 * w * w - 0.9025 * w
    if extrapolate:
        return value
    return _checked(value, w.between(650, 950) & age_years.between(0, 70), "wavelength or age outside the model: 650-950 nm, 0-70 years")


def dpf_duncan(wavelength_nm: Column, age_years: Column, extrapolate: bool = False) -> Column:
    """Differential pathlength factor, Duncan 1996; four wavelengths, 0-50 years."""
    value = F.lit(None).cast("double")
    for nm, (base, slope, power) in DUNCAN.items():
        value = F.when(wavelength_nm == nm, base + slope * F.pow(age_years.cast("double"), power)).otherwise(value)
    fine = value.isNotNull() if extrapolate else value.isNotNull() & age_years.between(0, 50)
    return _checked(value, fine, "wavelength or age outside the model: 690, 744, 807 or 832 nm, 0-50 years")


def extinction_segments(grid: DataFrame, step: float | None = 2.0) -> DataFrame:
    """Neighbouring rows of a grid (nm, hbo, hbr) as segments; gaps wider than ``step`` are none."""
    from pyspark.sql import Window

    w = Window.orderBy("nm")
    ends = [F.lag("nm").over(w).isNull().alias("lowest"), F.lead("nm", 2).over(w).isNull().alias("highest")]
    rows = grid.select("nm", "hbo", "hbr", *(F.lead(c).over(w).alias(f"{c}_next") for c in ("nm", "hbo", "hbr")), *ends)
    return rows if step is None else rows.withColumn("nm_next", F.when(F.col("nm_next") - F.col("nm") <= step, F.col("nm_next")))


def extinction(queries: DataFrame, grid: DataFrame, unit: str = "m-1 M-1", extrapolate: bool = False) -> DataFrame:
    """``queries`` (wavelength_nm, any others) with hbo and hbr, linear between grid rows.

    The grid is a fixed table of a few hundred rows, so it is broadcast.  A
    wavelength off the grid raises an error, or with ``extrapolate`` follows the
    slope at that end; a coefficient below zero always raises one.
    """
    if unit not in ("m-1 M-1", "cm-1 M-1"):
        raise ValueError("unit must be 'm-1 M-1' or 'cm-1 M-1'")
    factor = NATURAL if unit == "m-1 M-1" else 1.0
    x = F.col("wavelength_nm").cast("double")
    hit = (x == F.col("nm")) | ((x > F.col("nm")) & (x < F.col("nm_next")))
    if extrapolate:
        hit = hit | (F.col("lowest") & (x < F.col("nm"))) | (F.col("highest") & (x > F.col("nm_next")))
    joined = queries.join(F.broadcast(extinction_segments(grid)), hit, "left")
    t = F.when(x == F.col("nm"), F.lit(0.0)).otherwise((x - F.col("nm")) / (F.col("nm_next") - F.col("nm")))
    value = lambda c: (F.col(c) + F.when(t == 0, 0.0).otherwise(t * (F.col(f"{c}_next") - F.col(c)))) * factor
    checked = lambda c: _checked(_checked(value(c), value(c) >= 0, "extinction below zero"), F.col("nm").isNotNull(), "wavelength outside the extinction grid")
    return joined.select(*queries.columns, checked("hbo").alias("hbo"), checked("hbr").alias("hbr"))
