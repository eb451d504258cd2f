"""Modified Beer-Lambert law: optical density to haemoglobin concentration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cwlight.functions import optics


def resolved(channels: DataFrame, given: float | dict | Sequence[float] | DataFrame, name: str, by_wavelength: bool) -> DataFrame:
    """``channels`` with column ``name``: a positive number for each channel, from whatever form it is given in.

    One number stands for all.  A dict names every wavelength (or pair, where
    wavelengths have no say) of a recording, no others.  A sequence has, in this
    order of precedence, one number for each channel of a recording in order, or
    for each of its wavelengths, ascending (or pairs, as they first come).  A
    table (channel or pair or wavelength_nm, ``name``, perhaps recording) is joined.
    What leaves a channel without a number is an error.
    """
    kind = "wavelength_nm" if by_wavelength else "pair"
    missing = F.raise_error(F.format_string(f"no {name} is given for channel %s, {kind} %s, of recording %s", *(F.col(c).cast("string") for c in ("channel", kind, "recording")))).cast("double")
    rest = [c for c in channels.columns if c != name]
    if isinstance(given, DataFrame):
        keys = [c for c in given.columns if c != name]
        if name not in given.columns or not keys or not set(keys) <= {"recording", "channel", "pair", "wavelength_nm"}:
            raise ValueError(f"a table of {name} needs that column and what it belongs to")
        fine = (F.col("given") > 0) & (F.col("given") < float("inf"))
        table = given.select(*keys, F.col(name).cast("double").alias("given"))
        return channels.select(*rest).join(table, keys, "left").select(*rest, F.when(fine, F.col("given")).otherwise(missing).alias(name))
    values = list(given.values()) if isinstance(given, dict) else [given] if isinstance(given, (int, float)) else list(given)
    if not values or not all(0 < x < float("inf") for x in values):
        raise ValueError(f"{name}: numbers must be positive and finite")
    one = Window.partitionBy("recording")
    if isinstance(given, dict):
        table = channels.sparkSession.createDataFrame([(float(k) if by_wavelength else k, float(x)) for k, x in given.items()], ["named", "given"])
        present = F.size(F.collect_set(F.when(F.col("given").isNotNull(), F.col(kind))).over(one)) == len(given)
        rows = channels.select(*rest).join(table, (F.col(kind).cast("double") if by_wavelength else F.col(kind)) == F.col("named"), "left").withColumn("present", present)
        spare = F.raise_error(F.lit(f"{name} names a {kind} that the recording has not")).cast("double")
        return rows.select(*rest, F.when(F.col("given").isNull(), missing).when(F.col("present"), F.col("given")).otherwise(spare).alias(name))
    if len(values) == 1:
        return channels.select(*rest, F.lit(float(values[0])).alias(name))
    order = F.dense_rank().over(one.orderBy("wavelength_nm")) if by_wavelength else F.dense_rank().over(one.orderBy("pair_first"))
    rows = channels.select(*rest)
    if not by_wavelength:
        rows = rows.withColumn("pair_first", F.min("channel").over(Window.partitionBy("recording", "pair")))
    rows = rows.withColumns({"place": F.row_number().over(one.orderBy("channel")), "group": order})
    rows = rows.withColumns({"places": F.max("place").over(one), "groups": F.max("group").over(one)})
    n = len(values)
    text = F.concat(F.lit(f"{n} numbers of {name} are given where one, "), F.col("places").cast("string"), F.lit(" or "), F.col("groups").cast("string"), F.lit(" are needed"))
    at = F.when(F.col("places") == n, F.col("place")).when(F.col("groups") == n, F.col("group")).otherwise(F.raise_error(text).cast("int"))
    return rows.select(*rest, F.element_at(F.array(*(F.lit(float(x)) for x in values)), at).alias(name))


def with_pathlength(channels: DataFrame, factor: float | dict[float, float] | Sequence[float] | DataFrame = 6.0, age_years: float | None = None, model: str = "scholkmann2013", extrapolate: bool = False) -> DataFrame:
    """``channels`` with pathlength_factor: by a model of age, or as ``resolved`` takes it, by wavelength."""
    if age_years is None:
        return resolved(channels, factor, "pathlength_factor", True)
    models = {"scholkmann2013": optics.dpf_scholkmann, "duncan1996": optics.dpf_duncan}
    if model not in models:
        raise ValueError(f"model must be one of {sorted(models)}")
    return channels.withColumn("pathlength_factor", models[model](F.col("wavelength_nm").cast("double"), F.lit(float(age_years)), extrapolate))


def with_distance(channels: DataFrame, distance_m: float | dict | Sequence[float] | DataFrame) -> DataFrame:
    """``channels`` with distance_m given by the caller in place of the probe's, as ``resolved`` takes it, by pair."""
    return resolved(channels, distance_m, "distance_m", False)


def agreed_distances(channels: DataFrame) -> DataFrame:
    """``channels`` with each pair's mean distance_m; wavelengths of a pair that disagree on it raise an error."""
    pair = Window.partitionBy("recording", "pair")
    least, most = F.min("distance_m").over(pair), F.max("distance_m").over(pair)
    agree = most - least <= F.greatest(F.lit(1e-12), 1e-8 * most)
    wrong = F.raise_error(F.lit("the wavelengths of a pair disagree on its distance")).cast("double")
    return channels.withColumn("distance_m", F.when(agree, F.avg("distance_m").over(pair)).otherwise(wrong))


def pair_weights(channels: DataFrame, condition_limit: float = 1e8, incomplete: str = "error") -> DataFrame:
    """(recording, channel, pair, w_hbo, w_hbr): least-squares weights of each wavelength of a pair, to micromolar.

    ``channels`` holds hbo and hbr extinction per metre and mole, distance_m and
    pathlength_factor.  A pair has two unknowns, so its normal equations are two
    by two and solved in closed form, whatever the number of wavelengths.  A pair
    with fewer than two wavelengths is an error, or with ``incomplete="null"`` has
    null weights; wavelengths that repeat or hardly differ always are an error.
    """
    if incomplete not in ("error", "null"):
        raise ValueError("incomplete must be 'error' or 'null'")
    path = F.col("distance_m") * F.col("pathlength_factor")
    rows = agreed_distances(channels).select("recording", "channel", "pair", "wavelength_nm", (F.col("hbo") * path).alias("eo"), (F.col("hbr") * path).alias("er"))
    sums = rows.groupBy("recording", "pair").agg(
        F.sum(F.col("eo") * F.col("eo")).alias("oo"), F.sum(F.col("eo") * F.col("er")).alias("co"), F.sum(F.col("er") * F.col("er")).alias("rr"),
        F.count_distinct("wavelength_nm").alias("nw"), F.count(F.lit(1)).alias("n"),
    )
    det = F.col("oo") * F.col("rr") - F.col("co") * F.col("co")
    # Condition number of the design from the eigenvalues of its normal matrix.
    half, root = (F.col("oo") + F.col("rr")) / 2, F.sqrt(F.pow((F.col("oo") - F.col("rr")) / 2, 2) + F.col("co") * F.col("co"))
    alone = F.col("nw") < 2
    sound = ~alone & (F.col("nw") == F.col("n")) & (half - root > 0) & ((half + root) <= (half - root) * condition_limit**2)
    wrong = F.raise_error(F.lit("a pair needs two or more distinct, well-conditioned wavelengths")).cast("double")
    if incomplete == "null":
        wrong = F.when(alone & (F.col("n") == 1), F.lit(None).cast("double")).otherwise(wrong)
    both = rows.join(sums.withColumn("det", F.when(sound, det).otherwise(wrong)), ["recording", "pair"])
    w_hbo = (F.col("rr") * F.col("eo") - F.col("co") * F.col("er")) / F.col("det") * 1e6
    w_hbr = (F.col("oo") * F.col("er") - F.col("co") * F.col("eo")) / F.col("det") * 1e6
    return both.select("recording", "channel", "pair", w_hbo.alias("w_hbo"), w_hbr.alias("w_hbr"))


def mbll(od: DataFrame, channels: DataFrame, output_unit: str = "uM", condition_limit: float = 1e8, incomplete: str = "error") -> DataFrame:
    """(recording, pair, sample, hbo, hbr, hbt) in micromolar, from (recording, channel, sample, od).

    The weights are a dimension table, joined to the samples by key; one
    aggregation by pair and sample follows.  ``incomplete`` is that of
    ``pair_weights``: ``null`` gives such pairs rows with nulls.
    """
    if output_unit != "uM":
        raise ValueError("output_unit must be 'uM'")
    weighed = od.join(pair_weights(channels, condition_limit, incomplete), ["recording", "channel"])
    out = weighed.groupBy("recording", "pair", "sample").agg(F.sum(F.col("w_hbo") * F.col("od")).alias("hbo"), F.sum(F.col("w_hbr") * F.col("od")).alias("hbr"))
    return out.withColumn("hbt", F.col("hbo") + F.col("hbr"))
