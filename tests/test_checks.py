"""Inputs that the operators must refuse, and what they keep in full."""

import pytest

from cwlight.operators import measurements, quality
from cwlight.operators.optical_density import intensity_to_od


def samples(spark):
    rows = [(1, c, s, 1.0 + s) for c in (1, 2) for s in range(1, 6) if c == 1 or s > 2]
    return spark.createDataFrame(rows, "recording long, channel long, sample long, value double")


def test_an_interval_without_samples_is_an_error(spark):
    assert intensity_to_od(samples(spark), interval=(0.0, 0.4), fs=10.0).count() == 8
    with pytest.raises(Exception, match="holds no sample"):
        intensity_to_od(samples(spark), interval=(0.0, 0.1), fs=10.0).collect()


@pytest.mark.parametrize("reference", [0.0, -1.0, float("nan"), float("inf")])
def test_a_given_reference_must_be_positive(spark, reference):
    with pytest.raises(Exception, match="positive and finite"):
        intensity_to_od(samples(spark), reference=reference).collect()


def test_labels_keep_fractions_of_wavelengths(spark):
    rows = [(1, i + 1, 1, 1, nm, 1, 1, None, None) for i, nm in enumerate((759.6, 759.9, 850.0))]
    frame = spark.createDataFrame(rows, "recording long, measurement_index int, source_index int, detector_index int, wavelength_nm double, data_type int, data_type_index int, source_label string, detector_label string")
    assert sorted(r.channel_label for r in measurements.labels(frame).collect()) == ["S1_D1_759.6", "S1_D1_759.9", "S1_D1_850"]


def test_time_axes(spark):
    frame = lambda unit, time, n: spark.createDataFrame([(1, unit, time, n)], "recording long, time_unit string, time array<double>, n_rows int")
    assert [r.time_seconds for r in measurements.time_axis(frame("ms", [0.0, 100.0], 3)).orderBy("sample").collect()] == pytest.approx([0.0, 0.1, 0.2])
    for unit, time, n, message in (("min", [0.0, 1.0], 3, "unknown unit"), ("s", [0.0, 0.0], 3, "must increase"), ("s", [0.0, 2.0, 1.0], 3, "must increase")):
        with pytest.raises(Exception, match=message):
            measurements.time_axis(frame(unit, time, n)).collect()


def test_noise_bands_must_be_apart(spark):
    with pytest.raises(ValueError, match="one another"):
        quality.snr(samples(spark), 10.0, 64, 64, noise=[(1.6, 3.0), (2.5, 4.0)])
