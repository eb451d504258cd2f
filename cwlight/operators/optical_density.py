"""Intensity to optical density.

Signals are long tables (recording, channel, sample, value); ``sample`` counts
from 1.  Every operator keeps its input's other columns out and adds none but
those it names.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from cwlight.sources.tables import Recording

KEY = ["recording", "channel"]


#: Fixed value: the data type of continuous-wave amplitude.
CONTINUOUS_WAVE = 1


def continuous_wave(samples: DataFrame, measurements: DataFrame) -> DataFrame:
    """``samples``, if every channel is listed (as measurement_index) with data_type 1 and a positive wavelength; else an error naming it."""
    listed = measurements.select("recording", F.col("measurement_index").cast("long").alias("channel"), "data_type", "wavelength_nm")
    fine = F.coalesce((F.col("data_type") == CONTINUOUS_WAVE) & (F.col("wavelength_nm") > 0) & (F.col("wavelength_nm") < float("inf")), F.lit(False))
    text = F.format_string("not continuous-wave amplitude: recording %s, channel %s, data type %s, wavelength %s", *(F.col(c).cast("string") for c in (*KEY, "data_type", "wavelength_nm")))
    # A filter, so no later choice of columns takes the check away.
    checked = samples.join(listed, KEY, "left").where(F.when(fine, F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))
    return checked.select(*samples.columns)


def intensity_to_od(
    samples: DataFrame,
    baseline: str = "mean",
    interval: tuple[float, float] | None = None,
    fs: float = 10.0,
    reference: float | Column | None = None,
    nonpositive: str = "error",
    replacement: float | None = None,
    measurements: DataFrame | None = None,
) -> DataFrame:
    """(recording, channel, sample, od): ln of the reference less ln of the intensity.

    The reference is each channel's mean or median, over all samples or over a
    closed ``interval`` of seconds, or a given value, which must be positive and
    finite.  A channel without a sample in the interval is an error, as is, where
    ``measurements`` are given, one that they do not list as continuous-wave
    amplitude.  Errors name the channel and sample.  Logarithms are taken apart,
    so extreme intensities neither overflow nor vanish.
    """
    if baseline not in ("mean", "median"):
        raise ValueError("baseline must be 'mean' or 'median'")
    if nonpositive not in ("error", "replace"):
        raise ValueError("nonpositive must be 'error' or 'replace'")
    if nonpositive == "replace" and not (replacement and replacement > 0):
        raise ValueError("replacement must be positive where values are replaced")
    if interval is not None and (reference is not None or interval[0] > interval[1]):
        raise ValueError("interval must increase and excludes a given reference")
    if measurements is not None:
        samples = continuous_wave(samples, measurements)
    v = F.col("value")
    wrong = lambda what: F.raise_error(F.format_string(f"intensity must be {what}: recording %s, channel %s, sample %s", *(F.col(c).cast("string") for c in (*KEY, "sample")))).cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    other = F.lit(replacement) if nonpositive == "replace" else wrong("positive")
    clean = F.when(bad, wrong("finite")).when(v > 0, v).otherwise(other)
    rows = samples.select(*KEY, "sample", clean.alias("value"))
    if reference is not None:
        zero = reference if isinstance(reference, Column) else F.lit(float(reference))
        fine = zero.isNotNull() & (zero > 0) & (zero < float("inf"))
        zero = F.when(fine, zero).otherwise(F.raise_error(F.lit("a given reference must be positive and finite")).cast("double"))
        return rows.select(*KEY, "sample", (F.ln(zero) - F.ln("value")).alias("od"))
    part = rows if interval is None else rows.where(((F.col("sample") - 1) / fs).between(*interval))
    zero = part.groupBy(*KEY).agg((F.avg("value") if baseline == "mean" else F.median("value")).alias("zero"))
    empty = F.raise_error(F.lit("the baseline interval holds no sample of a channel")).cast("double")
    rows = rows.join(zero, KEY, "left").withColumn("zero", F.coalesce("zero", empty))
    return rows.select(*KEY, "sample", (F.ln("zero") - F.ln("value")).alias("od"))


def optical_density(rec: Recording, assay: str | None = None, output: str = "OD", **options) -> Recording:
    """``rec`` with the optical density of its intensity: ``assay``, or the only one of that kind.

    Every channel must be listed as continuous-wave amplitude.  ``options`` are
    those of ``intensity_to_od``; they go into the step of provenance.
    """
    name = assay or rec.only("continuous_wave_intensity")
    kind = (rec.contracts or {}).get(name, {}).get("kind", "continuous_wave_intensity")
    if kind != "continuous_wave_intensity":
        raise ValueError(f"{name} is {kind}, not intensity")
    rows = intensity_to_od(rec.assay(name), measurements=rec.measurements, **options)
    contract = {"kind": "optical_density", "unit": "1", "log": "natural", "source": name}
    return rec.add(output, rows, contract, "intensity_to_od", input_assay=name, **{k: v for k, v in options.items() if isinstance(v, (str, int, float, tuple, type(None)))})
