"""What readers, writers and operators check, and the parameters that override the probe."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cwlight.functions import sql
from cwlight.operators import geometry, measurements, motion, quality
from cwlight.operators.mbll import with_distance
from cwlight.operators.optical_density import intensity_to_od
from cwlight.sources import tables

SAMPLES = "recording long, channel long, sample long, value double"


def listed(spark, *types):
    rows = [(1, i, 1, 1, 760.0, t, 1, None, None) for i, t in enumerate(types, 1)]
    return spark.createDataFrame(rows, "recording long, measurement_index int, source_index int, detector_index int, wavelength_nm double, data_type int, data_type_index int, source_label string, detector_label string")


def test_only_continuous_wave_becomes_optical_density(spark):
    rows = spark.createDataFrame([(1, c, s, 1.0) for c in (1, 2) for s in (1, 2)], SAMPLES)
    assert intensity_to_od(rows, measurements=listed(spark, 1, 1)).count() == 4
    for bad in (listed(spark, 1, 51), listed(spark, 1)):
        with pytest.raises(PySparkException, match="channel 2"):
            intensity_to_od(rows, measurements=bad).collect()


def test_the_sample_at_fault_is_named(spark):
    rows = spark.createDataFrame([(1, 7, 1, 1.0), (1, 7, 2, -1.0)], SAMPLES)
    with pytest.raises(PySparkException, match="channel 7, sample 2"):
        intensity_to_od(rows).collect()


def test_given_distances(spark):
    rows = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "recording long, channel long, pair long")
    assert {r.distance_m for r in with_distance(rows, 0.02).collect()} == {0.02}
    assert {r.pair: r.distance_m for r in with_distance(rows, {1: 0.02, 2: 0.03}).collect()} == {1: 0.02, 2: 0.03}
    with pytest.raises(PySparkException, match="pair 2"):
        with_distance(rows, {1: 0.02}).collect()
    with pytest.raises(ValueError):
        with_distance(rows, 0.0)


def test_distances_in_space_and_in_the_plane(spark):
    channels = spark.createDataFrame([(r, 1, 1, 1) for r in (1, 2)], "recording long, channel long, source long, detector long")
    probe = spark.createDataFrame([(1, "source", 1, 0.0, 0.0, 0.0), (1, "detector", 1, 3.0, 0.0, 4.0), (2, "source", 1, 0.0, 0.0, None), (2, "detector", 1, 3.0, 0.0, None)], "recording long, role string, idx long, x double, y double, z double")
    got = lambda *a: {r.recording: (round(r.distance, 9), r.distance_unit, r.geometry_dimension) for r in geometry.source_detector_distances(channels, probe, *a).collect()}
    assert got("cm") == {1: (0.05, "m", "3d"), 2: (0.03, "m", "2d")}
    assert got("cm", "2d", "native") == {1: (3.0, "cm", "2d"), 2: (3.0, "cm", "2d")}
    with pytest.raises(PySparkException):
        got("cm", "3d")
    with pytest.raises(ValueError):
        got("ell")


def test_dropped_channels_are_counted_again(spark):
    rows = spark.createDataFrame([(1, c, 1, float(c)) for c in (1, 2, 3)], SAMPLES)
    stays = spark.createDataFrame([(1, 1), (1, 3)], "recording long, channel long")
    samples, rest = measurements.renumbered(rows, listed(spark, 1, 1, 1), stays)
    assert sorted((r.channel, r.value) for r in samples.collect()) == [(1, 1.0), (2, 3.0)]
    assert sorted(r.measurement_index for r in measurements.checked(rest).collect()) == [1, 2]


def test_the_probe_must_cover_the_list(spark):
    probe = spark.createDataFrame([(1, "source", 1, "A"), (1, "detector", 1, None)], "recording long, role string, idx int, label string")
    assert measurements.covered(listed(spark, 1), probe).count() == 1
    for bad in (listed(spark, 1).withColumn("detector_index", F.lit(2)), listed(spark, 1).withColumn("source_label", F.lit("B"))):
        with pytest.raises(PySparkException, match="disagrees"):
            measurements.covered(bad, probe).collect()


def test_tags_are_completed(spark):
    tags = spark.createDataFrame([(1, "SubjectID", "x"), (1, "TimeUnit", "ms"), (1, "Room", "4")], "recording long, name string, value string")
    got = {r["name"]: r.value for r in tables.prepared_tags(tags, spark.range(1, 2).toDF("recording")).collect()}
    assert got == {"SubjectID": "x", "MeasurementDate": "unknown", "MeasurementTime": "unknown", "LengthUnit": "m", "TimeUnit": "s", "FrequencyUnit": "Hz", "Room": "4"}
    for bad in (tags.union(tags), tags.withColumn("value", F.lit(""))):
        with pytest.raises(PySparkException, match="tag"):
            tables.prepared_tags(bad, spark.range(1, 2).toDF("recording")).collect()


def test_operators_refuse_what_was_made_from_another_signal(spark):
    rows = spark.createDataFrame([(1, 1, s, float(s % 5)) for s in range(1, 41)], SAMPLES)
    mask = tables.bound(rows.select("recording", "channel", "sample", F.col("sample").between(10, 14).alias("masked")), rows)
    other = rows.withColumn("value", F.col("value") + 1)
    assert motion.spline_correct(rows, mask, 10.0).count() == 40
    with pytest.raises(PySparkException, match="another signal"):
        motion.spline_correct(other, mask, 10.0).collect()
    scores = tables.bound(spark.createDataFrame([(1, 1, 1, 0.9)], "recording long, channel long, window int, score double"), rows)
    judged = quality.judged(scores, "sci", 0.8)
    channels = spark.createDataFrame([(1, 1, 1)], "recording long, channel long, pair long")
    assert quality.prune(judged, channels, source=rows).count() == 1
    with pytest.raises(PySparkException, match="another signal"):
        quality.prune(judged, channels, source=other).collect()


def test_channels_of_unequal_length_in_one_block(spark):
    rng = np.random.default_rng(5)
    signals = {c: rng.normal(size=n) for c, n in ((1, 64), (2, 80), (17, 64), (18, 64))}
    rows = spark.createDataFrame([(1, c, i + 1, float(v)) for c, xs in signals.items() for i, v in enumerate(xs)], SAMPLES)
    got = {}
    for r in motion.tddr(rows, 10.0).orderBy("channel", "sample").collect():
        got.setdefault(r.channel, []).append(r.value)
    for c, xs in signals.items():
        assert np.allclose(got[c], motion.kernels.tddr(xs, 10.0))


def test_spline_and_intervals_in_sql(spark):
    sql.register(spark)
    x, bad = np.sin(np.arange(40.0)), np.zeros(40, bool)
    bad[:3] = bad[10:15] = True
    spark.createDataFrame([(x.tolist(), bad.tolist()), (None, None)], "v array<double>, m array<boolean>").createOrReplaceTempView("masked_channels")
    rows = spark.sql("SELECT signal_spline_repair(v, m, 10D) v, signal_mask_intervals(m) i FROM masked_channels").collect()
    assert np.allclose(rows[0].v, motion.kernels.spline_repair(x, np.arange(40) / 10, bad, 10)) and rows[1].v is None
    assert [tuple(i) for i in rows[0].i] == [(1, 3), (11, 15)] and rows[1].i is None
