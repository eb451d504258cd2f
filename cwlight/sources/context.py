"""What a derived table was made from: a tree of hashes over a recording's assays, contracts, clock, list and probe.

Samples are hashed by channel, channels by assay; contracts, the time axis, the
measurement list and the probe are leaves of their own.  A derived table, such
as a map of short channels, carries the leaves of its recording, so that one
leaf can be recomputed alone and a refusal can name what has changed.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cwlight.sources.tables import Recording


def _written(column: str) -> Column:
    """A column as text that tells null from everything else."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def _rows_hash(rows: DataFrame, leaf: str) -> DataFrame:
    """(recording, leaf, hash) of a small table's rows, whatever their order and that of the columns."""
    line = F.concat_ws("|", *(F.concat(F.lit(f"{c}:"), _written(c)) for c in sorted(rows.columns)))
    return rows.groupBy("recording").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line))), 256).alias("hash")).select("recording", F.lit(leaf).alias("leaf"), "hash")


def _assay_hash(rec: Recording, name: str) -> DataFrame:
    """Channels are hashed on their own and joined by their hashes; no task holds more than a channel."""
    rows = rec.assay(name)
    line = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("sample", "value"))), lambda s: F.concat_ws(":", s["sample"].cast("string"), s["value"].cast("string"))))
    channels = rows.groupBy("recording", "channel").agg(F.sha2(line, 256).alias("h"))
    return _rows_hash(channels, f"assay {name}")


def names(rec: Recording) -> list[str]:
    """The leaves of these recordings."""
    found = [f"{kind} {n}" for n in sorted(rec.contracts or {}) for kind in ("assay", "contract")]
    return found + ["list", "probe"] + ["clock"] * (rec.times is not None)


def leaves(rec: Recording, only: Iterable[str] | None = None) -> DataFrame:
    """(recording, leaf, hash) of all leaves, or of those named."""
    wanted = names(rec) if only is None else list(only)
    unknown = set(wanted) - set(names(rec))
    if unknown:
        raise ValueError(f"no such leaf: {sorted(unknown)}")
    parts = []
    for leaf in wanted:
        kind, _, name = leaf.partition(" ")
        if kind == "assay":
            parts.append(_assay_hash(rec, name))
        elif kind == "contract":
            text = json.dumps(rec.contracts[name], sort_keys=True)
            parts.append(rec.measurements.select("recording").distinct().select("recording", F.lit(leaf).alias("leaf"), F.sha2(F.lit(text), 256).alias("hash")))
        else:
            parts.append(_rows_hash({"list": rec.measurements, "probe": rec.probe, "clock": rec.times}[leaf], leaf))
    return reduce(DataFrame.unionByName, parts)


def contexts(rec: Recording, only: Iterable[str] | None = None) -> DataFrame:
    """(recording, context): the hash of every leaf, by name."""
    return leaves(rec, only).groupBy("recording").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("leaf", "hash")))).alias("context"))


def of_assay(rec: Recording, name: str) -> list[str]:
    """The leaves that what is made from one assay depends on: a mask, say."""
    return [f"assay {name}", f"contract {name}", "list"] + ["clock"] * (rec.times is not None)


def bound(derived: DataFrame, rec: Recording, only: Iterable[str] | None = None) -> DataFrame:
    """``derived`` (recording, any others) with the leaves, all or those named, of the recording it was made from."""
    return derived.join(contexts(rec, only), "recording")


def checked(derived: DataFrame, rec: Recording | None, only: Iterable[str] | None = None) -> DataFrame:
    """The rows of ``bound``, without its column, if ``rec`` is what they were made from; else an error that names the leaves that differ.

    ``only`` recomputes and compares some leaves.  A table that is not bound
    passes; one that is needs ``rec``.  The check is a filter, so no later choice
    of columns takes it away.
    """
    if "context" not in derived.columns:
        return derived
    if rec is None:
        raise ValueError("the table is bound to its recordings: give them as source")
    now = contexts(rec, only).withColumnRenamed("context", "now")
    chosen = F.col("context") if only is None else F.map_filter("context", lambda k, _: k.isin(list(only)))
    differ = F.array_union(F.array_except(F.map_entries(chosen), F.map_entries("now")), F.array_except(F.map_entries("now"), F.map_entries(chosen)))
    told = F.array_join(F.array_sort(F.array_distinct(F.transform(differ, lambda e: e["key"]))), ", ")
    text = F.concat(F.lit("stale, or made from another recording: "), F.coalesce(told, F.lit("recording")), F.lit(" of recording "), F.col("recording").cast("string"))
    fine = F.when(F.coalesce(F.size(differ) == 0, F.lit(False)), F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))
    return derived.join(now, "recording", "left").where(fine).drop("now", "context")
