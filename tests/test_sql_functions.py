import numpy as np

from cwlight.functions import kernels, sql


def test_kernels_in_sql(spark):
    sql.register(spark)
    x = np.sin(2 * np.pi * np.arange(128) / 10) + np.random.default_rng(0).normal(0, 0.1, 128)
    spark.createDataFrame([(x.tolist(),), (None,)], "v array<double>").createOrReplaceTempView("channels")
    rows = spark.sql("SELECT signal_tddr(v, 10D) t, signal_wavelet_repair(v, 1.5D) w, signal_bandpass(v, 10D, 0.7D, 1.5D) b, signal_snr_db(v, 10D, 0.7D, 1.5D) s, signal_peak_power(v, v, 10D) p FROM channels").collect()
    assert np.allclose(rows[0].t, kernels.tddr(x, 10)) and np.allclose(rows[0].b, kernels.bandpass(x, 10, (0.7, 1.5))) and np.allclose(rows[0].w, kernels.wavelet_repair(x))
    assert rows[0].s > 0 and rows[0].p > 0 and rows[1].t is None and rows[1].s is None
