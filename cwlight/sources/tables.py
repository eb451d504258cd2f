"""Recordings in tables: reading with checks, writing partitioned by recording.

A recording is a folder of Parquet tables: samples (recording, assay, channel,
sample, value), measurements, probe, stims, tags.  Any store Spark reads will
do.  Checks are part of the plan, so a bad row fails the job that reads it.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cwlight.operators import measurements

NAMES = ("samples", "measurements", "probe", "stims", "tags")
#: Tags every recording must carry.
REQUIRED_TAGS = ("SubjectID", "MeasurementDate", "MeasurementTime", "LengthUnit", "TimeUnit", "FrequencyUnit")
KINDS = ("continuous_wave_intensity", "optical_density", "haemoglobin_concentration", "motion_corrected_signal")


@dataclass(frozen=True)
class Recording:
    """The tables of some recordings, and what is known of their assays.  Operators give new objects."""

    samples: DataFrame
    measurements: DataFrame
    probe: DataFrame
    stims: DataFrame | None = None
    tags: DataFrame | None = None
    contracts: dict[str, dict] | None = None
    steps: tuple[dict, ...] = ()
    times: DataFrame | None = None
    events: DataFrame | None = None

    def assay(self, name: str) -> DataFrame:
        """(recording, channel, sample, value) of one assay."""
        if self.contracts is not None and name not in self.contracts:
            raise ValueError(f"no assay {name!r}; there are {sorted(self.contracts)}")
        return self.samples.where(F.col("assay") == name).select("recording", "channel", "sample", "value")

    def only(self, kind: str) -> str:
        """The name of the one assay of a kind."""
        found = [n for n, c in (self.contracts or {}).items() if c.get("kind") == kind]
        if len(found) != 1:
            raise ValueError(f"{len(found)} assays of kind {kind}; name one")
        return found[0]

    def add(self, name: str, rows: DataFrame, contract: dict, activity: str, **parameters) -> Recording:
        """A new recording with one more assay, its contract and one more step of provenance."""
        known = self.contracts or {}
        if name in known:
            raise ValueError(f"the assay already exists: {name}")
        if contract.get("kind") not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        new = finite_samples(rows.select("recording", F.lit(name).alias("assay"), "channel", "sample", F.col(rows.columns[-1]).alias("value")))
        taken = F.raise_error(F.lit(f"stored samples already have an assay {name}")).cast("boolean")
        step = {"activity": activity, "output_assay": name, "parameters": parameters}
        return replace(self, samples=self.samples.where(F.when(F.col("assay") == name, taken).otherwise(F.lit(True))).unionByName(new), contracts={**known, name: contract}, steps=(*self.steps, step))


def fingerprint(rows: DataFrame) -> DataFrame:
    """(recording, fingerprint): SHA-256 over each recording's values in channel and sample order.

    Channels are hashed on their own and joined by their hashes, so no task holds
    more than a channel.
    """
    value = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("sample", "value"))), lambda s: F.concat_ws(":", s["sample"].cast("string"), F.hex(s["value"].cast("string")))))
    channels = rows.groupBy("recording", "channel").agg(F.sha2(value, 256).alias("h"))
    joined = F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("channel", "h"))), lambda s: F.concat_ws("=", s["channel"].cast("string"), s["h"])))
    return channels.groupBy("recording").agg(F.sha2(joined, 256).alias("fingerprint"))


def bound(derived: DataFrame, source: DataFrame) -> DataFrame:
    """``derived`` (recording, any others), such as a mask or scores, with the fingerprint of the signal it was made from."""
    return derived.join(fingerprint(source), "recording")


def still_bound(derived: DataFrame, source: DataFrame) -> DataFrame:
    """The rows of ``bound``, if ``source`` is still the signal they were made from; else an error.

    The check is a filter, so no later choice of columns takes it away.
    """
    now = fingerprint(source).withColumnRenamed("fingerprint", "now")
    stale = F.raise_error(F.lit("made from another signal, or from an older state of it")).cast("boolean")
    return derived.join(now, "recording", "left").where(F.when(F.col("now") == F.col("fingerprint"), F.lit(True)).otherwise(stale)).drop("now", "fingerprint")


def missing_tags(tags: DataFrame, recordings: DataFrame) -> DataFrame:
    """(recording, name) of required tags that a recording does not carry."""
    names = F.explode(F.array(*map(F.lit, REQUIRED_TAGS))).alias("name")
    return recordings.select("recording", names).join(tags.select("recording", "name"), ["recording", "name"], "left_anti")


def current(derived: DataFrame, source: DataFrame) -> DataFrame:
    """``derived``, checked by ``still_bound`` where it carries a fingerprint."""
    return still_bound(derived, source) if "fingerprint" in derived.columns else derived


def prepared_tags(tags: DataFrame, recordings: DataFrame, length_unit: str = "m") -> DataFrame:
    """(recording, name, value): every required tag of every recording, times in seconds; an empty or repeated tag is an error.

    Tags that a recording lacks are ``unknown``, its units metres (or
    ``length_unit``), seconds and Hz.
    """
    usual = {**dict.fromkeys(REQUIRED_TAGS[:3], "unknown"), "LengthUnit": length_unit, "TimeUnit": "s", "FrequencyUnit": "Hz"}
    pairs = F.explode(F.create_map(*(F.lit(x) for kv in usual.items() for x in kv))).alias("name", "usual")
    wanted = recordings.select("recording").distinct().select("recording", pairs)
    once = F.count(F.lit(1)).over(Window.partitionBy("recording", "name")) == 1
    full = F.coalesce(F.length("value") > 0, F.lit(False))
    text = F.concat(F.lit("an empty or repeated tag: "), F.col("name"))
    given = tags.where(F.when(full, F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))).withColumn("once", once)
    given = given.where(F.when(F.col("once"), F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))).select("recording", "name", "value")
    fixed = F.when(F.col("name").isin("LengthUnit", "TimeUnit"), F.col("usual"))
    return given.join(wanted, ["recording", "name"], "full").select("recording", "name", F.coalesce(fixed, "value", "usual").alias("value"))


def finite_samples(samples: DataFrame) -> DataFrame:
    """The samples, if all are finite; else an error naming one that is not."""
    fine = F.coalesce(~F.isnan("value") & (F.abs("value") < float("inf")), F.lit(False))
    text = F.format_string("a sample that is not finite: recording %s, channel %s, sample %s", *(F.col(c).cast("string") for c in ("recording", "channel", "sample")))
    return samples.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))


def full_tags(tags: DataFrame, recordings: DataFrame) -> DataFrame:
    """The tags, if every recording carries the required ones; else an error naming one it lacks."""
    text = F.concat(F.lit("recording "), F.col("recording").cast("string"), F.lit(" lacks the tag "), F.col("name"))
    lost = missing_tags(tags, recordings.select("recording").distinct()).select("recording", "name", F.raise_error(text).alias("value"))
    return tags.unionByName(lost, allowMissingColumns=True)


def read(spark: SparkSession, path: str, contracts: dict[str, dict] | None = None) -> Recording:
    """The recordings under ``path``, checked where they are read.

    Measurement lists must be in order, agree with a whole probe, and are
    labelled; samples must be finite, stimuli whole rows, tags complete.
    """
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in NAMES[:3]}
    probe = measurements.sound_probe(tables["probe"])
    listed = measurements.labels(measurements.covered(measurements.checked(tables["measurements"].drop("channel_label")), probe))
    more = {}
    for name in NAMES[3:]:
        try:
            more[name] = spark.read.parquet(f"{path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    stims, tags = more.get("stims"), more.get("tags")
    return Recording(
        finite_samples(tables["samples"]), listed, probe, None if stims is None else stims.where(measurements.whole_stim()), None if tags is None else full_tags(tags, tables["measurements"]), contracts
    )


def write(rec: Recording, path: str, mode: str = "errorifexists") -> None:
    """All tables; samples lie in one folder per assay, in files by ranges of recordings and channels.

    Ranges hold about the same number of rows, whatever a recording's length,
    and a reader of some recordings skips the other files by their statistics.
    Samples must be finite, the list must agree with the probe, stimuli must be
    whole rows, and tags are completed.  Events that differ from the stored
    stimuli replace them, with a warning.  Spark's commit protocol puts a table in
    place once all its tasks have ended.
    """
    finite_samples(rec.samples).repartitionByRange("assay", "recording", "channel").sortWithinPartitions("assay", "recording", "channel", "sample").write.mode(mode).partitionBy("assay").parquet(f"{path}/samples")
    tags = None if rec.tags is None else prepared_tags(rec.tags, rec.measurements)
    stims = None if rec.stims is None else rec.stims.where(measurements.whole_stim())
    if rec.events is not None and stims is not None:
        from cwlight.sources.preparation import stimuli

        stims, notes = stimuli(rec.events, stims)
        for note in notes.select("note").distinct().collect():  # two texts at most
            warnings.warn(note["note"], stacklevel=2)
    for name, table in zip(NAMES[1:], (measurements.covered(rec.measurements, rec.probe), measurements.sound_probe(rec.probe), stims, tags)):
        if table is not None:
            table.write.mode(mode).parquet(f"{path}/{name}")
