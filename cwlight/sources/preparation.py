"""Time axes and stimuli made ready for writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cwlight.operators import measurements

EVENT = ("onset", "duration", "type", "value")


def times(recordings: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(recording, sample, time_seconds) of every recording (recording, n_rows, sampling_rate).

    ``given`` times (recording, sample, time_seconds) are taken where a recording
    has any: as many as it has rows, finite and increasing, else an error.
    Others follow from the rate, which must then be positive.
    """
    rate = F.col("sampling_rate")
    sound = F.coalesce((rate > 0) & (rate < float("inf")), F.lit(False))
    text = lambda what: F.raise_error(F.concat(F.lit(f"{what}: recording "), F.col("recording").cast("string"))).cast("boolean")
    rest = recordings.select("recording", "n_rows", "sampling_rate")
    if given is None:
        known = None
    else:
        line = Window.partitionBy("recording").orderBy("sample")
        t = F.col("time_seconds")
        rows = given.select("recording", "sample", "time_seconds").withColumns({"before": F.lag("time_seconds").over(line), "place": F.row_number().over(line), "count": F.count(F.lit(1)).over(Window.partitionBy("recording"))})
        rows = rows.join(rest.select("recording", "n_rows"), "recording")
        fine = t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf")) & (F.col("before").isNull() | (t > F.col("before"))) & (F.col("place") == F.col("sample")) & (F.col("count") == F.col("n_rows"))
        known = rows.where(F.when(F.coalesce(fine, F.lit(False)), F.lit(True)).otherwise(text("times must be finite, increase and match the rows"))).select("recording", "sample", "time_seconds")
        rest = rest.join(given.select("recording").distinct(), "recording", "left_anti")
    # As a column, since a filter would move below the join and judge recordings that have times.
    checked = F.when(sound, rate).otherwise(text("times or a positive sampling rate are needed").cast("double"))
    made = rest.select("recording", checked.alias("sampling_rate"), F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))).alias("sample"))
    made = made.select("recording", F.col("sample").cast("long").alias("sample"), ((F.col("sample") - 1) / F.col("sampling_rate")).alias("time_seconds"))
    return made if known is None else made.unionByName(known)


def compact(axis: DataFrame) -> DataFrame:
    """(recording, start, step) in place of every time, if all steps of a recording are alike; else an error."""
    rows = axis.select("recording", F.lit(0).alias("channel"), "sample", F.col("time_seconds").alias("t"))
    steps = measurements.uniform_step(rows).drop("channel")
    first = axis.groupBy("recording").agg(F.min_by("time_seconds", "sample").alias("start"))
    text = F.raise_error(F.concat(F.lit("compact times need even steps: recording "), F.col("recording").cast("string"))).cast("boolean")
    fine = F.when(F.coalesce(F.col("uniform"), F.lit(False)), F.lit(True)).otherwise(text)
    return first.join(steps, "recording", "left").where(fine).select("recording", "start", F.col("step_seconds").alias("step"))


def edited(events: DataFrame, stims: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """(recording) of those whose events are no longer those of the stored stimuli, as multisets, nulls alike.

    Both sides are counted in one aggregation over (recording, event); nothing
    is collected or sorted.  ``units`` (recording, time_unit) are those of the
    stored times; seconds without them.
    """
    now = events.select("recording", *EVENT, F.lit(1).alias("n"))
    then = measurements.events(in_seconds(stims, units)).select("recording", *EVENT, F.lit(-1).alias("n"))
    counts = now.unionByName(then).groupBy("recording", *EVENT).agg(F.sum("n").alias("n"))
    return counts.where("n != 0").select("recording").distinct()


def in_seconds(stims: DataFrame, units: DataFrame | None) -> DataFrame:
    """Stimuli with start and duration in seconds."""
    if units is None:
        return stims
    factor = F.create_map(*(F.lit(x) for kv in measurements.TIME.items() for x in kv))[F.col("time_unit")]
    factor = F.coalesce(factor, F.raise_error(F.lit("unknown unit of time")).cast("double"))
    rows = stims.join(units.select("recording", "time_unit"), "recording", "left").withColumn("factor", factor)
    return rows.withColumn("data", F.transform("data", lambda x, i: F.when(i < 2, x * F.col("factor")).otherwise(x))).select(*stims.columns)


def stimuli(events: DataFrame, stims: DataFrame, units: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(stimuli to write, notes) from a recording's events and the stimuli stored with it.

    Where they agree, the stored rows go on whole, extra numbers and labels too.
    Where they do not, rows are made from the events, one stimulus a type in the
    order in which types first come, and a note (recording, note) says what was
    given up.  Events without finite numbers, or with a negative duration or no
    type, are an error.
    """
    changed = edited(events, stims, units)
    kept = measurements.stim_labels(in_seconds(stims, units).join(changed, "recording", "left_anti"))
    rows = events.join(changed, "recording", "left_semi").withColumn("number", F.col("value").try_cast("double") if dict(events.dtypes)["value"] == "string" else F.col("value"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    fine = finite("onset") & finite("duration") & finite("number") & (F.col("duration") >= 0) & (F.length("type") > 0)
    text = F.raise_error(F.concat(F.lit("events cannot be written as stimuli: recording "), F.col("recording").cast("string"))).cast("boolean")
    rows = rows.where(F.when(F.coalesce(fine, F.lit(False)), F.lit(True)).otherwise(text))
    order = Window.partitionBy("recording").orderBy("onset", "type", "duration", "number")
    rows = rows.withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("first", F.min("place").over(Window.partitionBy("recording", "type")))
    rows = rows.withColumns({"stim_index": F.dense_rank().over(Window.partitionBy("recording").orderBy("first")), "row": F.row_number().over(Window.partitionBy("recording", "type").orderBy("place"))})
    labels = F.array(*map(F.lit, ("starttime", "duration", "value")))
    made = rows.select("recording", "stim_index", F.col("row").cast("long").alias("row"), F.col("type").alias("name"), F.array("onset", "duration", "number").alias("data"), labels.alias("data_labels"))
    extra = stims.join(changed, "recording", "left_semi").groupBy("recording").agg(F.max(F.size("data") > 3).alias("extra"))
    note = F.when(F.col("extra"), "events were edited: extra columns of stored stimuli were dropped").otherwise("events were edited: stored stimuli were replaced")
    columns = ["recording", "stim_index", "row", "name", "data", "data_labels"]
    whole = kept.withColumns({"stim_index": F.col("stim_index").cast("int"), "row": F.col("row").cast("long")}).select(*columns)
    return whole.unionByName(made.select(*columns)), extra.select("recording", note.alias("note"))
