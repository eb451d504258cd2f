import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cwlight.functions import optics
from cwlight.operators import geometry, measurements, motion, quality, short_separation
from cwlight.operators.mbll import agreed_distances, mbll, with_pathlength
from cwlight.operators.optical_density import intensity_to_od

SAMPLES = "recording long, channel long, sample long, value double"


def signal(spark, *channels):
    return spark.createDataFrame([(1, c, i + 1, float(v)) for c, xs in enumerate(channels, 1) for i, v in enumerate(xs)], SAMPLES)


def test_optical_density(spark):
    rows = signal(spark, [100, 50, 25, 100])
    got = {r.sample: r.od for r in intensity_to_od(rows, reference=100.0).collect()}
    assert np.allclose([got[i] for i in (1, 2, 3, 4)], [0, math.log(2), math.log(4), 0])
    got = [r.od for r in intensity_to_od(rows, "median", (0.1, 0.2), 10.0).orderBy("sample").collect()]
    assert np.allclose(got, np.log(37.5) - np.log([100, 50, 25, 100]))


def test_optical_density_of_extremes_and_bad_values(spark):
    assert np.isfinite([r.od for r in intensity_to_od(signal(spark, [1e308, 1e-308]), reference=1.0).collect()]).all()
    for bad in (0.0, -1.0, float("nan"), float("inf")):
        with pytest.raises(PySparkException):
            intensity_to_od(signal(spark, [1.0, bad])).collect()
    got = intensity_to_od(signal(spark, [1.0, 0.0]), reference=1.0, nonpositive="replace", replacement=0.5).orderBy("sample").collect()
    assert np.isclose(got[1].od, math.log(2))
    with pytest.raises(ValueError):
        intensity_to_od(signal(spark, [1.0]), nonpositive="replace")


def test_dpf(spark):
    row = spark.range(1).select(optics.dpf_duncan(F.lit(744), F.lit(20)).alias("a"), optics.dpf_scholkmann(F.lit(800), F.lit(30)).alias("b")).first()
    assert np.isclose(row.a, 5.11 + 0.106 * 20**0.723)
    assert np.isclose(row.b, 223.3 + 0.05624 * 30**0.8493 - 5.723e-7 * 800**3 + 0.001245 * 800**2 - 0.9025 * 800)
    with pytest.raises(PySparkException):
        spark.range(1).select(optics.dpf_duncan(F.lit(700), F.lit(20))).collect()


def test_extinction(spark):
    grid = spark.createDataFrame([(float(k), *v) for k, v in optics.EXTINCTION.items()], "nm double, hbo double, hbr double")
    ask = spark.createDataFrame([(760.0,), (761.0,)], "wavelength_nm double")
    got = {r.wavelength_nm: (r.hbo, r.hbr) for r in optics.extinction(ask, grid, "cm-1 M-1").collect()}
    assert got[760.0] == (586.0, 1548.52) and np.allclose(got[761.0], (592.0, 1528.48))
    with pytest.raises(PySparkException):
        optics.extinction(spark.createDataFrame([(800.0,)], "wavelength_nm double"), grid).collect()


@pytest.mark.parametrize("wavelengths", [(760, 850), (690, 760, 850)])
def test_mbll_inverts_the_forward_model(spark, wavelengths):
    hbo, hbr, d, ppf = np.array([1.0, 2.0]), np.array([-0.5, 0.25]), 0.03, 6.0
    channels, od = [], []
    for c, nm in enumerate(wavelengths):
        eo, er = (x * optics.NATURAL for x in optics.EXTINCTION[nm])
        channels.append((1, c, 0, nm, eo, er, d, ppf))
        od += [(1, c, i + 1, float((eo * hbo[i] + er * hbr[i]) * 1e-6 * d * ppf)) for i in range(2)]
    ch = spark.createDataFrame(channels, "recording long, channel long, pair long, wavelength_nm int, hbo double, hbr double, distance_m double, pathlength_factor double")
    got = mbll(spark.createDataFrame(od, "recording long, channel long, sample long, od double"), ch).orderBy("sample").collect()
    assert np.allclose([r.hbo for r in got], hbo) and np.allclose([r.hbr for r in got], hbr) and np.allclose([r.hbt for r in got], hbo + hbr)
    with pytest.raises(PySparkException):
        mbll(spark.createDataFrame(od, "recording long, channel long, sample long, od double"), ch.withColumn("wavelength_nm", F.lit(760))).collect()


def test_motion_mask(spark):
    x = np.zeros(80)
    x[39] = 1
    for t_mask, want in ((0.0, {40, 41}), (0.2, set(range(38, 44)))):
        got = motion.motion_mask(signal(spark, x), 10.0, t_motion=0.1, t_mask=t_mask).where("masked").collect()
        assert {r.sample for r in got} == want
    mask = motion.motion_mask(signal(spark, x, x * 0), 10.0, t_motion=0.1, t_mask=0.0)
    spans = motion.intervals(mask, 10.0).collect()
    assert [(r.channel, r.start_index, r.end_index, r.start_time) for r in spans] == [(1, 40, 41, 3.9)]
    pairs = spark.createDataFrame([(1, 1, 7), (1, 2, 7)], "recording long, channel long, pair long")
    assert motion.group_wavelengths(mask, pairs).where("masked").count() == 4


def test_repairs_keep_rows(spark):
    rng = np.random.default_rng(3)
    rows = signal(spark, rng.normal(size=128), np.sin(np.arange(128)))
    for out in (motion.tddr(rows, 10.0), motion.wavelet_correct(rows)):
        assert out.count() == 256
    mask = rows.select("recording", "channel", "sample", ((F.col("channel") == 1) & F.col("sample").between(30, 40)).alias("masked"))
    fixed = motion.spline_correct(rows, mask, 10.0)
    assert fixed.join(rows.withColumnRenamed("value", "old"), ["recording", "channel", "sample"]).where("channel = 2 AND value <> old").count() == 0 and fixed.count() == 256


def geometry_rows(spark):
    channels = spark.createDataFrame([(1, 1, 1, 1, 1, 760), (1, 2, 2, 2, 2, 760), (1, 3, 3, 3, 3, 760)], "recording long, channel long, pair long, source long, detector long, wavelength_nm int")
    probe = spark.createDataFrame([(1, "source", i, float(i), 0.0, 0.0) for i in (1, 2, 3)] + [(1, "detector", i, float(i), d, 0.0) for i, d in ((1, 0.008), (2, 0.01), (3, 0.03))], "recording long, role string, idx long, x double, y double, z double")
    return channels, probe


def test_short_channels(spark):
    placed = geometry.distances(*geometry_rows(spark))
    assert [r.is_short for r in geometry.short_map(placed).orderBy("channel").collect()] == [True, False, False]
    got = {r.target: r.short for r in geometry.nearest_short(geometry.short_map(placed)).collect()}
    assert got == {2: 1, 3: 1}
    with pytest.raises(PySparkException):
        geometry.nearest_short(geometry.short_map(placed, 0.001)).collect()


def test_short_regression_equals_least_squares(spark):
    rng = np.random.default_rng(4)
    s, noise = rng.normal(size=60), rng.normal(size=60)
    y = 2 * s + noise
    mapped = geometry.short_map(geometry.distances(*geometry_rows(spark)))
    rows = signal(spark, s, y, y[::-1])
    want = y - (s - s.mean()) * (np.cov(s, y)[0, 1] / s.var(ddof=1))
    for f in (short_separation.regress_nearest, short_separation.regress_all):
        got = [r.value for r in f(rows, mapped, 10.0).where("channel = 2").orderBy("sample").collect()]
        assert np.allclose(got, want, atol=1e-11)
    lagged = [[r.value for r in f(rows, mapped, 10.0, 0.3).where("channel = 2").orderBy("sample").collect()] for f in (short_separation.regress_nearest, short_separation.regress_all)]
    assert np.allclose(*lagged) and np.allclose(lagged[0][:3], y[:3])
    with pytest.raises(ValueError):
        short_separation.exact_lag(0.25, 10.0)


def test_quality(spark):
    t = np.arange(600) / 10
    pulse = np.sin(2 * np.pi * 1.0 * t)
    rows = signal(spark, pulse + 0.05 * np.sin(2 * np.pi * 0.2 * t), 0.8 * pulse, np.sin(2 * np.pi * 0.15 * t), np.sin(2 * np.pi * 0.27 * t + 1))
    channels = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 2), (1, 4, 2)], "recording long, channel long, pair long")
    scores = quality.scalp_coupling(rows, channels, 10.0, 600, 100, 50)
    assert scores.count() == 44
    judged = quality.judged(scores, "sci", 0.8)
    marks = {r.channel: r for r in quality.prune(judged, channels).collect()}
    assert marks[1].passed and not marks[3].passed and "sci:w0002;sci:w0003" in marks[3].failed_windows
    assert {r.channel for r in quality.prune(judged, channels, "drop").collect()} == {1, 2}
    flat = quality.coupling(signal(spark, np.ones(40), np.arange(40.0)), channels.where("pair = 1"), 40, 40, 40)
    assert {r.score for r in flat.collect()} == {0.0}


def test_labels_events_and_times(spark):
    rows = spark.createDataFrame([(1, 1, 1, 1, 760, 1, 1), (1, 2, 1, 1, 760, 1, 2), (1, 3, 1, 2, 850, 1, 1)], "recording long, measurement_index int, source_index int, detector_index int, wavelength_nm int, data_type int, data_type_index int")
    rows = rows.withColumns({"source_label": F.lit(None).cast("string"), "detector_label": F.lit("R")})
    got = [r.channel_label for r in measurements.labels(measurements.checked(rows)).orderBy("measurement_index").collect()]
    assert got == ["S1_R_760_T1I1M1", "S1_R_760_T1I2M2", "S1_R_850"]
    with pytest.raises(PySparkException):
        measurements.checked(rows.where("measurement_index <> 2")).collect()
    stims = spark.createDataFrame([(1, 1, 1, "a", [0.8, 0.2, 2.0]), (1, 2, 1, "b", [0.2, 0.1, 1.0, 11.0])], "recording long, stim_index int, row long, name string, data array<double>")
    assert [r.type for r in measurements.events(stims).orderBy("position").collect()] == ["b", "a"]
    times = spark.createDataFrame([(1, 4, "ms", [0.0, 100.0]), (2, 2, "s", [0.0, 3.0])], "recording long, n_rows int, time_unit string, time array<double>")
    got = [(r.recording, r.sample, round(r.time_seconds, 9)) for r in measurements.time_axis(times).orderBy("recording", "sample").collect()]
    assert got == [(1, 1, 0.0), (1, 2, 0.1), (1, 3, 0.2), (1, 4, 0.3), (2, 1, 0.0), (2, 2, 3.0)]


def test_extinction_beyond_the_grid(spark):
    grid = spark.createDataFrame([(700.0, 10.0, 1.0), (702.0, 12.0, 2.0), (704.0, 16.0, 5.0)], "nm double, hbo double, hbr double")
    ask = lambda *nm: spark.createDataFrame([(float(x),) for x in nm], "wavelength_nm double")
    got = {r.wavelength_nm: (r.hbo, r.hbr) for r in optics.extinction(ask(699, 700, 704, 706), grid, "cm-1 M-1", extrapolate=True).collect()}
    assert got == {699.0: (9.0, 0.5), 700.0: (10.0, 1.0), 704.0: (16.0, 5.0), 706.0: (20.0, 8.0)}
    for rows in (optics.extinction(ask(706), grid), optics.extinction(ask(690), grid, extrapolate=True)):
        with pytest.raises(PySparkException):
            rows.collect()


def test_pathlengths_and_pair_distances(spark):
    rows = spark.createDataFrame([(1, 1, 1, 760, 0.03), (1, 2, 1, 850, 0.03)], "recording long, channel long, pair long, wavelength_nm int, distance_m double")
    factors = lambda *a, **k: [r.pathlength_factor for r in with_pathlength(rows, *a, **k).orderBy("channel").collect()]
    assert factors() == [6.0, 6.0] and factors({760: 6.5, 850: 5.5}) == [6.5, 5.5]
    assert np.allclose(factors(age_years=30), [223.3 + 0.05624 * 30**0.8493 - 5.723e-7 * w**3 + 0.001245 * w**2 - 0.9025 * w for w in (760, 850)])
    with pytest.raises(PySparkException):
        factors({760: 6.5})
    for bad in ({"factor": 0.0}, {"factor": {}}, {"age_years": 30, "model": "none"}):
        with pytest.raises(ValueError):
            factors(**bad)
    near = rows.withColumn("distance_m", F.col("distance_m") + F.when(F.col("channel") == 2, 1e-11).otherwise(0.0))
    assert len({r.distance_m for r in agreed_distances(near).collect()}) == 1
    with pytest.raises(PySparkException):
        agreed_distances(rows.withColumn("distance_m", F.col("channel") * 0.01)).collect()


def test_labels_of_stimulus_numbers(spark):
    schema = "data array<double>, data_labels array<string>"
    got = measurements.stim_labels(spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0], None), ([1.0, 2.0, 3.0], ["a", "b", "c"])], schema)).collect()
    assert [r.data_labels for r in got] == [["starttime", "duration", "value", "extra1", "extra2"], ["a", "b", "c"]]
    with pytest.raises(PySparkException):
        measurements.stim_labels(spark.createDataFrame([([1.0, 2.0, 3.0], ["a"])], schema)).collect()


def test_places_must_be_finite(spark):
    channels, probe = geometry_rows(spark)
    with pytest.raises(PySparkException):
        geometry.distances(channels, probe.withColumn("x", F.lit(float("nan")))).collect()
    with pytest.raises(PySparkException):
        geometry.distances(channels, probe.where("idx < 3")).collect()
