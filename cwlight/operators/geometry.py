"""Source-detector geometry: distances, midpoints, short channels, nearest short channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Metres in one unit of length.
LENGTH = {"m": 1.0, "cm": 0.01, "mm": 0.001}


def _norm(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def distances(channels: DataFrame, probe: DataFrame, unit: str = "m", dims: int = 3) -> DataFrame:
    """``channels`` (recording, channel, source, detector, any others) with distance_m and midpoint_{x,y,z}_m.

    ``probe`` is (recording, role, idx, x, y, z), role source or detector.  Both
    joins are on keys, so the probe need not be small; Spark broadcasts it where
    it is.
    """
    factor = LENGTH[unit]
    axes = ["x", "y", "z"][:dims]
    out = channels
    for role, tag in (("source", "s"), ("detector", "d")):
        place = probe.where(F.col("role") == role).select("recording", F.col("idx").alias(role), *((F.col(a) * factor).alias(f"{tag}{a}") for a in axes))
        out = out.join(place, ["recording", role], "left")
    apart = _norm(*(F.col(f"d{a}") - F.col(f"s{a}") for a in axes))
    wrong = F.raise_error(F.lit("a channel names an unknown source or detector, or one whose place is not finite")).cast("double")
    distance = F.when(apart.isNotNull() & ~F.isnan(apart) & (apart < float("inf")), apart).otherwise(wrong)
    middle = [((F.col(f"s{a}") + F.col(f"d{a}")) / 2).alias(f"midpoint_{a}_m") for a in axes]
    return out.select(*channels.columns, distance.alias("distance_m"), *middle)


def source_detector_distances(channels: DataFrame, probe: DataFrame, length_unit: str, dimension: str = "auto", unit: str = "m") -> DataFrame:
    """``channels`` with distance, distance_unit and geometry_dimension.

    ``auto`` measures in space where every place of the recording's probe has a
    z, else in the plane; ``native`` keeps the probe's ``length_unit``.
    """
    if dimension not in ("auto", "3d", "2d") or unit not in ("m", "native"):
        raise ValueError("dimension must be 'auto', '3d' or '2d', and unit 'm' or 'native'")
    if not length_unit or (unit == "m" and length_unit not in LENGTH):
        raise ValueError(f"a declared unit of length is needed, for metres one of {sorted(LENGTH)}")
    factor = LENGTH[length_unit] if unit == "m" else 1.0
    solid = F.bool_and(F.col("z").isNotNull())
    use = F.when(solid, "3d").otherwise("2d") if dimension == "auto" else F.lit(dimension)
    chosen = probe.groupBy("recording").agg(use.alias("geometry_dimension"))
    flat = probe.join(chosen, "recording").withColumn("z", F.when(F.col("geometry_dimension") == "2d", 0.0).otherwise(F.col("z"))).drop("geometry_dimension")
    out = distances(channels, flat).withColumns({"distance": F.col("distance_m") * factor, "distance_unit": F.lit("m" if unit == "m" else length_unit)})
    return out.join(chosen, "recording").select(*channels.columns, "distance", "distance_unit", "geometry_dimension")


def short_map(placed: DataFrame, threshold_m: float = 0.01) -> DataFrame:
    """Channels with ``is_short``: a distance strictly below the threshold."""
    if not threshold_m > 0:
        raise ValueError("threshold_m must be positive")
    return placed.withColumn("is_short", F.col("distance_m") < threshold_m)


def pair_map(placed: DataFrame, threshold_m: float = 0.01) -> DataFrame:
    """``short_map`` for signals of pairs, such as haemoglobin: channel is the pair, and wavelengths (null) have no say.

    Channels of a pair must agree on its distance.
    """
    axes = [c for c in placed.columns if c.startswith("midpoint_")]
    pairs = placed.groupBy("recording", "pair").agg(F.avg("distance_m").alias("distance_m"), F.min("distance_m").alias("low"), F.max("distance_m").alias("high"), *(F.min(a).alias(a) for a in axes))
    agree = F.col("high") - F.col("low") <= F.greatest(F.lit(1e-12), 1e-8 * F.col("high"))
    wrong = F.raise_error(F.concat(F.lit("the channels of a pair disagree on its distance: pair "), F.col("pair").cast("string"))).cast("double")
    rows = pairs.select("recording", F.col("pair").alias("channel"), "pair", F.lit(None).cast("int").alias("wavelength_nm"), F.when(agree, F.col("distance_m")).otherwise(wrong).alias("distance_m"), *axes)
    return short_map(rows, threshold_m)


def nearest_short(mapped: DataFrame) -> DataFrame:
    """(recording, target, short, between_m): for each long channel the short one of its wavelength with the nearest midpoint.

    Midpoints within max(1e-12, 1e-12 * the least) tie; the lowest channel wins.
    Without a wavelength (signals of pairs) all short ones may serve.  The join is
    within a recording and wavelength, so it grows with the channels of one probe,
    not with the number of recordings.
    """
    axes = [c for c in mapped.columns if c.startswith("midpoint_")]
    side = lambda tag, keep: mapped.where(keep).select("recording", F.coalesce("wavelength_nm", F.lit(0)).alias("wavelength_nm"), F.col("channel").alias(tag), *(F.col(a).alias(f"{tag}_{a}") for a in axes))
    pairs = side("target", ~F.col("is_short")).join(side("short", F.col("is_short")), ["recording", "wavelength_nm"], "left")
    pairs = pairs.withColumn("between_m", _norm(*(F.col(f"target_{a}") - F.col(f"short_{a}") for a in axes)))
    pairs = pairs.withColumn("least", F.min("between_m").over(Window.partitionBy("recording", "target")))
    slack = F.greatest(F.lit(1e-12), F.lit(1e-12) * F.greatest(F.lit(1.0), F.col("least")))
    tied = pairs.where(F.col("short").isNull() | (F.col("between_m") <= F.col("least") + slack))
    best = tied.groupBy("recording", "target").agg(F.min(F.struct("short", "between_m")).alias("b"))
    fine = F.when(F.isnull("b.short"), F.raise_error(F.lit("no short channel of the same wavelength")).cast("long")).otherwise(F.col("b.short"))
    return best.select("recording", "target", fine.alias("short"), F.col("b.between_m").alias("between_m"))
