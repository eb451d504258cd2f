import numpy as np
import pytest

from cwlight.functions import kernels as k


def test_smoothing_spline_has_the_pinned_values():
    got = k.smoothing_spline(np.array([1.0, 2, 4, 6]), np.array([2.0, 4, 5, 7]), 0.5)
    assert np.allclose(got, [2.3183673469387753, 3.4857142857142858, 5.2326530612244895, 6.9632653061224490], atol=1e-13)


def test_smoothing_spline_equals_a_dense_solve():
    rng = np.random.default_rng(1)
    t, y, p = np.cumsum(rng.uniform(0.5, 2, 40)), rng.normal(size=40), 0.9
    h = np.diff(t)
    q = np.zeros((38, 40))
    for i in range(38):
        q[i, i : i + 3] = [1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]]
    r = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
    u = np.linalg.solve(6 * (1 - p) * q @ q.T + p * r, q @ y)
    assert np.allclose(k.smoothing_spline(t, y, p), y - 6 * (1 - p) * q.T @ u, atol=1e-10)


def test_wavelet_level_has_the_pinned_values_and_an_inverse():
    low, high = k.db2_level(np.arange(1.0, 9))
    assert np.allclose(low, [4.760278777324327, 3.725002596914244, 6.553429721660434, 10.417133026816707])
    assert np.allclose(high, [-1.035276180410083, 0, 0, 3.863703305156273], atol=1e-12)
    assert np.allclose(k.db2_merge(low, high), np.arange(1.0, 9))


def test_wavelet_repair_without_outliers_changes_nothing():
    x = np.random.default_rng(0).normal(size=100)
    assert np.allclose(k.wavelet_repair(x, 1e9), x)
    with pytest.raises(ValueError, match="too short"):
        k.wavelet_repair(np.ones(20))


def test_wavelet_repair_of_many_channels_is_that_of_each():
    x = np.random.default_rng(5).standard_t(2, size=(90, 5))
    both = k.wavelet_repair(x, 1.5, 2)
    assert np.allclose(both, np.stack([k.wavelet_repair(c, 1.5, 2) for c in x.T], axis=1)) and not np.allclose(both, x)


def test_tddr_has_the_pinned_values():
    x = np.sin(2 * np.pi * 0.1 * np.arange(128) / 10)
    x[39:45] += 2
    got = k.tddr(x, 10)
    pinned = np.array([0.22029013111501081, 0.26069931347728714, 0.30071915642678609, 0.33999729647761467, 0.37820661879393913, 0.41507693245278232, 0.45040683909522811, 0.48405500199893170])
    assert np.allclose(got[:8] - got.mean(), pinned - 0.23908607435190424, atol=1e-9)
    assert abs(got.mean() - x.mean()) < 1e-14


def test_tddr_leaves_a_flat_or_degenerate_signal():
    x = np.full(50, 3.0)
    assert (k.tddr(x, 10) == x).all()


def test_bandpass_gain_and_stop():
    fs, t = 10.0, np.arange(4000) / 10
    inside = k.bandpass(np.sin(2 * np.pi * 0.1 * t), fs, (0.07, 0.13))[1000:3000]
    outside = k.bandpass(np.sin(2 * np.pi * 1.0 * t), fs, (0.07, 0.13))[1000:3000]
    assert abs(np.abs(inside).max() - 1) < 2e-3 and np.abs(outside).max() < 1e-4
    assert (k.bandpass(np.full(40, 2.0), fs, (0.7, 2.0)) == 0).all()


def test_snr_of_two_tones_is_20_db():
    t = np.arange(400) / 20
    x = 2 * np.sin(2 * np.pi * t) + 0.2 * np.sin(6 * np.pi * t)
    assert abs(k.snr_db(x, 20, (0.8, 1.2), [(2.8, 3.2)]) - 20) < 0.15
    with pytest.raises(ValueError):
        k.snr_db(np.zeros(64), 20, (0.8, 1.2), [(2.8, 3.2)])


def test_spline_repair():
    rng = np.random.default_rng(2)
    t, y, bad = np.arange(200) / 10, rng.normal(0, 0.01, 200), np.zeros(200, bool)
    assert (k.spline_repair(y, t, bad, 10) == y).all()
    bad[50:60] = bad[120:150] = True
    y[50:60] += 5
    got = k.spline_repair(y, t, bad, 10)
    assert np.abs(got).max() < 0.5 and np.isfinite(got).all()
    with pytest.raises(ValueError, match="clean"):
        k.spline_repair(y, t, np.ones(200, bool), 10)


def test_spline_repair_of_many_channels_is_that_of_each():
    rng = np.random.default_rng(3)
    y, bad = np.cumsum(rng.normal(size=(120, 6)), axis=0), np.zeros((120, 6), bool)
    for c, cuts in enumerate([(0, 9), (30, 39), (100, 120), (5, 6), (60, 62), ()]):
        bad[slice(*cuts) if cuts else slice(0, 0), c] = True
    bad[70:79, 0] = bad[50:59, 3] = True
    for t in (np.arange(120) / 10, np.cumsum(rng.uniform(0.05, 0.15, 120))):
        both = k.spline_repair(y, t, bad, 10)
        assert np.allclose(both, np.stack([k.spline_repair(y[:, c], t, bad[:, c], 10) for c in range(6)], axis=1), atol=1e-12)
    sites = np.arange(9) / 10
    assert np.allclose(k.smoothing_spline(sites, y[:9], 0.9), np.stack([k.smoothing_spline(sites, y[:9, c], 0.9) for c in range(6)], axis=1), atol=1e-12)


def test_peak_power_of_a_constant_is_zero():
    assert k.peak_power(np.ones(50), np.random.default_rng(0).normal(size=50), 10) == 0.0
