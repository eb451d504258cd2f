import pytest

from cwlight.operators import measurements, quality
from cwlight.operators.mbll import mbll, with_distance, with_pathlength

CHANNELS = [(0, 0, 7, 850), (0, 1, 7, 760), (0, 2, 3, 760), (0, 3, 3, 850), (0, 4, 9, 760), (0, 5, 9, 850)]


@pytest.fixture(scope="module")
def channels(spark):
    return spark.createDataFrame(CHANNELS, "recording long, channel long, pair long, wavelength_nm int").cache()


def factors(df, name="pathlength_factor"):
    return [r[name] for r in df.orderBy("recording", "channel").collect()]


def test_one_number_or_one_for_each_wavelength(channels):
    assert factors(with_pathlength(channels, 6)) == [6.0] * 6
    assert factors(with_pathlength(channels, {760: 5.0, 850: 4.0})) == [4.0, 5.0, 5.0, 4.0, 5.0, 4.0]
    assert factors(with_pathlength(channels, [5.0, 4.0])) == [4.0, 5.0, 5.0, 4.0, 5.0, 4.0]
    assert factors(with_pathlength(channels, [1.0, 2, 3, 4, 5, 6])) == [1.0, 2, 3, 4, 5, 6]


def test_pairs_are_numbered_as_they_first_come(channels):
    assert factors(with_distance(channels, [0.01, 0.02, 0.03]), "distance_m") == [0.01, 0.01, 0.02, 0.02, 0.03, 0.03]
    assert factors(with_distance(channels, {3: 0.02, 7: 0.01, 9: 0.03}), "distance_m") == [0.01, 0.01, 0.02, 0.02, 0.03, 0.03]
    assert factors(with_distance(channels, [0.1] * 6), "distance_m") == [0.1] * 6


def test_measurements_come_before_groups_where_both_fit(spark):
    two = spark.createDataFrame([(0, 0, 0, 850), (0, 1, 0, 760)], "recording long, channel long, pair long, wavelength_nm int")
    assert factors(with_pathlength(two, [8.0, 7.0])) == [8.0, 7.0]  # by measurement, not by ascending wavelength


def test_tables_and_what_they_lack(spark, channels):
    table = spark.createDataFrame([(760, 5.0), (850, 4.0)], "wavelength_nm int, pathlength_factor double")
    assert factors(with_pathlength(channels, table)) == [4.0, 5.0, 5.0, 4.0, 5.0, 4.0]
    for bad in (table.where("wavelength_nm = 760"), table.selectExpr("wavelength_nm", "pathlength_factor - 4 AS pathlength_factor")):
        with pytest.raises(Exception, match="no pathlength_factor is given for channel"):
            with_pathlength(channels, bad).collect()


@pytest.mark.parametrize("given,text", [([1.0, 2, 3], "one, 6 or 2"), ({760: 1.0}, "no pathlength_factor"), ({760: 1.0, 850: 1.0, 900: 1.0}, "has not"), ([1.0, 2.0, 3.0, 4.0], "4 numbers")])
def test_what_does_not_cover_a_recording_is_refused(channels, given, text):
    with pytest.raises(Exception, match=text):
        with_pathlength(channels, given).collect()


def test_numbers_units_and_lone_pairs_are_checked(spark, channels):
    for bad in (0, -1.0, float("inf"), [], [1.0, float("nan")]):
        with pytest.raises(ValueError):
            with_pathlength(channels, bad)
    od = spark.createDataFrame([(0, 0, 1, 0.1)], "recording long, channel long, sample long, od double")
    lone = channels.where("channel = 0").selectExpr("*", "1000D AS hbo", "2000D AS hbr", "0.03D AS distance_m", "6D AS pathlength_factor")
    with pytest.raises(ValueError, match="output_unit"):
        mbll(od, lone, output_unit="mM")
    with pytest.raises(Exception, match="two or more"):
        mbll(od, lone).collect()
    assert [r.hbt for r in mbll(od, lone, incomplete="null").collect()] == [None]


def test_wavelength_tables(spark):
    rows = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "recording long, measurement_index int, wavelength_index int")
    table = spark.createDataFrame([(1, 1, 760.0), (1, 2, 850.0)], "recording long, wavelength_index int, wavelength_nm double")
    assert [r.wavelength_nm for r in measurements.with_wavelengths(rows, table).orderBy("measurement_index").collect()] == [760.0, 850.0]
    named = rows.selectExpr("*", "760D + 90D * (measurement_index - 1) AS wavelength_nm")
    assert measurements.with_wavelengths(named, table).count() == 2
    for list_, tab, text in (
        (named.selectExpr("recording", "measurement_index", "wavelength_index", "wavelength_nm + 1 AS wavelength_nm"), table, "another nominal"),
        (rows, table.where("wavelength_index = 1"), "no wavelength has the index"),
        (rows, table.union(table), "malformed"),
        (rows, table.selectExpr("recording", "wavelength_index", "-wavelength_nm AS wavelength_nm"), "malformed"),
    ):
        with pytest.raises(Exception, match=text):
            measurements.with_wavelengths(list_, tab).collect()


def test_pairs_in_first_seen_order(spark):
    rows = spark.createDataFrame([(1, 1, 5, 2), (1, 2, 1, 1), (1, 3, 5, 2), (1, 4, 1, 9), (2, 1, 1, 1)], "recording long, measurement_index int, source_index int, detector_index int")
    got = [(r.recording, r.pair, r.channel_id) for r in measurements.pairs(rows).orderBy("recording", "measurement_index").collect()]
    assert got == [(1, 1, "S5_D2"), (1, 2, "S1_D1"), (1, 1, "S5_D2"), (1, 3, "S1_D9"), (2, 1, "S1_D1")]


def test_metrics_over_other_channels_or_windows_are_refused(spark, channels):
    one = spark.createDataFrame([(0, c, w, 0.9) for c in range(6) for w in (1, 2)], "recording long, channel long, window int, score double")
    a, b = quality.judged(one, "a", 0.5), quality.judged(one, "b", 0.95)
    both = quality.prune(a.unionByName(b), channels, require_all=False).collect()
    assert len(both) == 6 and all(r.passed and r.metrics == "a,b" and r.failed_windows == "b:w0001;b:w0002" for r in both)
    for other in (b.where("window = 1"), b.where("channel < 5"), b.withColumn("window", b.window + 1), b.withColumn("channel", (b.channel + 1) % 6 + 10)):
        with pytest.raises(Exception, match="other channels or windows"):
            quality.prune(a.unionByName(other), channels).collect()


def test_od_of_recordings_always_checks_the_data_type(spark):
    from cwlight.operators.optical_density import optical_density
    from cwlight.sources.tables import Recording

    samples = spark.createDataFrame([(1, "raw", c, s, 1.0 + c + s) for c in (1, 2) for s in (1, 2, 3)], "recording long, assay string, channel long, sample long, value double")
    listed = spark.createDataFrame([(1, 1, 1, 760.0), (1, 2, 1, 850.0)], "recording long, measurement_index int, data_type int, wavelength_nm double")
    rec = Recording(samples, listed, None, contracts={"raw": {"kind": "continuous_wave_intensity"}})
    out = optical_density(rec, baseline="median")
    assert out.assay("OD").count() == 6 and out.contracts["OD"]["kind"] == "optical_density" and rec.contracts == {"raw": {"kind": "continuous_wave_intensity"}}
    assert out.steps[-1]["parameters"] == {"input_assay": "raw", "baseline": "median"}
    wrong = Recording(samples, listed.selectExpr("recording", "measurement_index", "data_type + measurement_index - 1 AS data_type", "wavelength_nm"), None, contracts=rec.contracts)
    with pytest.raises(Exception, match="not continuous-wave amplitude: recording 1, channel 2"):
        optical_density(wrong).samples.collect()
    for again, text in ((lambda: optical_density(out), "already exists"), (lambda: optical_density(out, "OD", "x"), "not intensity"), (lambda: optical_density(out, "none"), "no assay")):
        with pytest.raises(ValueError, match=text):
            again()


def test_pairs_must_agree_on_their_distance(spark):
    from cwlight.operators.geometry import pair_map

    rows = spark.createDataFrame([(1, 1, 1, 0.03, 0.0), (1, 2, 1, 0.03, 0.0), (1, 3, 2, 0.008, 1.0)], "recording long, channel long, pair long, distance_m double, midpoint_x_m double")
    assert [(r.channel, r.is_short) for r in pair_map(rows).orderBy("channel").collect()] == [(1, False), (2, True)]
    with pytest.raises(Exception, match="disagree"):
        pair_map(rows.withColumn("distance_m", rows.distance_m + rows.channel / 1000)).collect()
