"""Measurement lists, labels, stimuli and time axes of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds in one unit of time.
TIME = {"s": 1.0, "ms": 1e-3, "us": 1e-6}


def labels(measurements: DataFrame) -> DataFrame:
    """Adds ``channel_label``: ``{source}_{detector}_{wavelength}``; repeats get ``_T{type}I{type index}M{position}``.

    Missing source and detector labels are S and D with their index; a
    wavelength is written in full, without a point where it is whole.
    """
    source = F.coalesce("source_label", F.concat(F.lit("S"), F.col("source_index").cast("string")))
    detector = F.coalesce("detector_label", F.concat(F.lit("D"), F.col("detector_index").cast("string")))
    nm = F.col("wavelength_nm")
    written = F.when(nm == F.floor(nm), F.floor(nm).cast("string")).otherwise(nm.cast("double").cast("string"))
    rows = measurements.withColumn("base", F.concat_ws("_", source, detector, written))
    again = F.count(F.lit(1)).over(Window.partitionBy("recording", "base")) > 1
    more = F.format_string("_T%dI%dM%d", "data_type", "data_type_index", "measurement_index")
    return rows.withColumn("channel_label", F.when(again, F.concat("base", more)).otherwise(F.col("base"))).drop("base")


def checked(measurements: DataFrame) -> DataFrame:
    """The list, if each recording's positions are 1 to n, indices are positive and wavelengths positive; else an error."""
    whole = Window.partitionBy("recording")
    place = (F.col("measurement_index") == F.row_number().over(whole.orderBy("measurement_index"))) & (F.col("source_index") >= 1) & (F.col("detector_index") >= 1) & (F.col("wavelength_nm") > 0)
    return measurements.withColumn("measurement_index", F.when(place, F.col("measurement_index")).otherwise(F.raise_error(F.lit("malformed measurement list")).cast("int")))


def covered(measurements: DataFrame, probe: DataFrame) -> DataFrame:
    """The list, if the probe has every source and detector that it names, under the same label where both have one; else an error."""
    out = measurements
    label = F.col("label") if "label" in probe.columns else F.lit(None).cast("string")
    for role in ("source", "detector"):
        place = probe.where(F.col("role") == role).select("recording", F.col("idx").alias(f"{role}_index"), F.lit(True).alias("there"), label.alias("probe_label"))
        same = F.coalesce(F.col("probe_label") == F.col(f"{role}_label"), F.lit(True))
        text = F.format_string(f"recording %s: the probe disagrees on {role} %s", F.col("recording").cast("string"), F.col(f"{role}_index").cast("string"))
        fine = F.when(F.coalesce("there", F.lit(False)) & same, F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))
        out = out.join(place, ["recording", f"{role}_index"], "left").where(fine).select(*measurements.columns)
    return out


def sound_probe(probe: DataFrame) -> DataFrame:
    """The probe (recording, role, idx, x, y, z[, label]), if it is whole; else an error that says what is wrong.

    A recording has sources and detectors, each index once; places are finite;
    z is given for all of them or for none; landmarks are labelled all or none.
    """
    place = F.col("role").isin("source", "detector")
    off = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    labelled = F.col("label").isNotNull() & (F.length("label") > 0) if "label" in probe.columns else F.lit(True)
    facts = probe.groupBy("recording").agg(
        F.count_if(F.col("role") == "source").alias("sources"), F.count_if(F.col("role") == "detector").alias("detectors"),
        F.count_if(~F.col("role").isin("source", "detector", "landmark") | F.col("role").isNull()).alias("unknown"),
        F.count_if(F.col("x").isNull() | F.col("y").isNull() | off("x") | off("y") | F.coalesce(off("z"), F.lit(False))).alias("astray"),
        F.count_if(place & F.col("z").isNull()).alias("flat"), F.count_if(place).alias("places"), F.count_distinct(F.when(place, F.struct("role", "idx"))).alias("distinct"),
        F.count_if((F.col("role") == "landmark") & labelled).alias("named"), F.count_if(F.col("role") == "landmark").alias("landmarks"),
    )
    wrong = (
        F.when((F.col("sources") == 0) | (F.col("detectors") == 0), "sources and detectors must both have places")
        .when(F.col("unknown") > 0, "an unknown role")
        .when(F.col("astray") > 0, "a place that is not finite")
        .when((F.col("flat") > 0) & (F.col("flat") < F.col("places")), "places in space for some sources and detectors only")
        .when(F.col("distinct") < F.col("places"), "a source or detector with two places")
        .when((F.col("named") > 0) & (F.col("named") < F.col("landmarks")), "labels for some landmarks only")
    )
    text = F.concat(F.lit("probe of recording "), F.col("recording").cast("string"), F.lit(": "), F.col("wrong"))
    fine = F.when(F.col("wrong").isNull(), F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))
    return probe.join(facts.select("recording", wrong.alias("wrong")), "recording").where(fine).select(*probe.columns)


def with_wavelengths(measurements: DataFrame, wavelengths: DataFrame) -> DataFrame:
    """The list with wavelength_nm from a recording's table (recording, wavelength_index, wavelength_nm).

    An index that the table has not, a table entry that repeats or is not a
    positive number, and a nominal wavelength in the list that differs from the
    table's are errors.
    """
    once = F.count(F.lit(1)).over(Window.partitionBy("recording", "wavelength_index"))
    table = wavelengths.select("recording", "wavelength_index", F.col("wavelength_nm").cast("double").alias("nominal"), once.alias("entries"))
    rows = measurements.join(table, ["recording", "wavelength_index"], "left")
    text = lambda what: F.raise_error(F.format_string(f"recording %s: {what} %s", F.col("recording").cast("string"), F.col("wavelength_index").cast("string"))).cast("double")
    sound = (F.col("entries") == 1) & (F.col("nominal") > 0) & (F.col("nominal") < float("inf"))
    nm = F.when(F.col("entries").isNull(), text("no wavelength has the index")).when(~F.coalesce(sound, F.lit(False)), text("a malformed entry for wavelength"))
    if "wavelength_nm" in measurements.columns:
        nm = nm.when(F.col("wavelength_nm").isNotNull() & (F.col("wavelength_nm").cast("double") != F.col("nominal")), text("another nominal wavelength than the table's at index"))
    rest = [c for c in measurements.columns if c != "wavelength_nm"]
    return rows.select(*rest, nm.otherwise(F.col("nominal")).alias("wavelength_nm"))


def pairs(measurements: DataFrame) -> DataFrame:
    """The list with pair, from 1 in the order in which source and detector first meet in it, and channel_id S{source}_D{detector}.

    The ordinal is a column, so the order outlives any shuffle.
    """
    whole = Window.partitionBy("recording")
    first = measurements.withColumn("first", F.min("measurement_index").over(Window.partitionBy("recording", "source_index", "detector_index")))
    out = first.withColumn("pair", F.dense_rank().over(whole.orderBy("first")).cast("long"))
    return out.withColumn("channel_id", F.format_string("S%d_D%d", "source_index", "detector_index")).drop("first")


def renumbered(samples: DataFrame, measurements: DataFrame, stays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, measurements) of the channels in ``stays`` (recording, channel), counted from 1 again in each recording."""
    kept = measurements.join(stays.select("recording", F.col("channel").alias("measurement_index")).distinct(), ["recording", "measurement_index"], "left_semi")
    place = F.row_number().over(Window.partitionBy("recording").orderBy("measurement_index"))
    listed = kept.withColumn("place", place)
    names = listed.select("recording", F.col("measurement_index").cast("long").alias("channel"), F.col("place").cast("long").alias("place"))
    moved = samples.join(names, ["recording", "channel"]).withColumn("channel", F.col("place")).select(*samples.columns)
    return moved, listed.withColumn("measurement_index", F.col("place")).select(*measurements.columns)


def whole_stim() -> Column:
    """A condition that holds for each whole stimulus row (start, duration of 0 or more, value) and is an error for others."""
    data = F.col("data")
    fine = (F.size(data) >= 3) & (F.try_element_at(data, F.lit(2)) >= 0) & F.forall(data, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    wrong = F.raise_error(F.lit("a stimulus row needs start, a duration of 0 or more, and value")).cast("boolean")
    return F.when(F.coalesce(fine, F.lit(False)), F.lit(True)).otherwise(wrong)


def events(stims: DataFrame) -> DataFrame:
    """(recording, onset, duration, type, value) from (recording, stim_index, row, name, data), by onset, ties in stored order.

    ``position`` numbers the events of a recording.
    """
    data = F.col("data")
    bad = (F.size(data) < 3) | (data[1] < 0)
    onset = F.when(bad, F.raise_error(F.lit("a stimulus row needs start, a duration of 0 or more, and value")).cast("double")).otherwise(data[0])
    rows = stims.select("recording", "stim_index", "row", onset.alias("onset"), data[1].alias("duration"), F.col("name").alias("type"), data[2].alias("value"))
    line = Window.partitionBy("recording").orderBy("onset", "stim_index", "row")
    return rows.withColumn("position", F.row_number().over(line)).drop("stim_index", "row")


def stim_labels(stims: DataFrame) -> DataFrame:
    """``stims`` (data, data_labels, any others) with a label for every number of a row: start, duration, value, then extras."""
    first = F.array(*map(F.lit, ("starttime", "duration", "value")))
    usual = F.transform(F.sequence(F.lit(1), F.size("data")), lambda i: F.when(i <= 3, F.try_element_at(first, i)).otherwise(F.concat(F.lit("extra"), (i - 3).cast("string"))))
    named = F.coalesce("data_labels", usual)
    return stims.withColumn("data_labels", F.when(F.size(named) == F.size("data"), named).otherwise(F.raise_error(F.lit("a stimulus needs a label for every number")).cast("array<string>")))


def time_axis(recordings: DataFrame, rows: str = "n_rows") -> DataFrame:
    """(recording, sample, time_seconds) from compact (start, step) or full times, in the recording's unit.

    Two times stand for start and step, unless the recording has two rows.  An
    unknown unit, a step of 0 or less and times that do not increase are errors.
    """
    factor = F.create_map(*(F.lit(x) for kv in TIME.items() for x in kv))[F.col("time_unit")]
    factor = F.coalesce(factor, F.raise_error(F.lit("unknown unit of time")).cast("double"))
    compact = (F.size("time") == 2) & (F.col(rows) != 2)
    full = F.transform(F.sequence(F.lit(0), F.col(rows) - 1), lambda i: F.col("time")[0] + i * F.col("time")[1])
    times = F.when(compact, full).otherwise(F.col("time"))
    steps = F.zip_with(F.slice(times, 2, F.greatest(F.size(times) - 1, F.lit(0))), F.slice(times, 1, F.greatest(F.size(times) - 1, F.lit(0))), lambda b, a: b > a)
    times = F.when(F.forall(steps, lambda x: x), times).otherwise(F.raise_error(F.lit("times must increase")).cast("array<double>"))
    out = recordings.select("recording", factor.alias("factor"), F.posexplode(times).alias("at", "t"))
    return out.select("recording", (F.col("at") + 1).cast("long").alias("sample"), (F.col("t") * F.col("factor")).alias("time_seconds"))


def uniform_step(times: DataFrame, relative: float = 1e-9, least: float = 1e-12) -> DataFrame:
    """(key columns, step_seconds, uniform) from (recording, channel, sample, t): the median step, and whether all steps keep to it."""
    line = Window.partitionBy("recording", "channel").orderBy("sample")
    steps = times.withColumn("d", F.col("t") - F.lag("t").over(line)).where("d IS NOT NULL")
    middle = steps.groupBy("recording", "channel").agg(F.median("d").alias("step_seconds"))
    off = steps.join(middle, ["recording", "channel"]).groupBy("recording", "channel").agg(F.first("step_seconds").alias("step_seconds"), F.max(F.abs(F.col("d") - F.col("step_seconds"))).alias("off"), F.min("d").alias("low"))
    return off.select("recording", "channel", "step_seconds", ((F.col("low") > 0) & (F.col("off") <= F.greatest(F.lit(least), relative * F.col("step_seconds")))).alias("uniform"))
