import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cwlight.functions import kernels
from cwlight.operators import short_separation, split_filter

FS = 10.0


def rows_of(spark, signals):
    return spark.createDataFrame([(r, c, i + 1, float(v)) for (r, c), xs in signals.items() for i, v in enumerate(xs)], "recording long, channel long, sample long, value double")


def walks(n):
    rng = np.random.default_rng(n)
    return {(0, c): np.cumsum(rng.normal(size=n + 3 * c)) for c in range(2)}


def values(df, key):
    pdf = df.toPandas().sort_values("sample")
    mine = pdf[(pdf.recording == key[0]) & (pdf.channel == key[1])]
    assert mine["sample"].tolist() == list(range(1, len(mine) + 1))
    return mine["value"].to_numpy()


@pytest.mark.parametrize("band,ends,size,levels", [("mayer", "zeros", 50, 1), ("respiration", "hold", 7, 3), ("respiration", "zeros", 64, 1), ("cardiac", "zeros", 9, 2), ("cardiac", "hold", 100, 0)])
def test_split_channels_equal_whole_ones(spark, monkeypatch, band, ends, size, levels):
    monkeypatch.setattr(split_filter, "FAN", 3)
    signals = walks(150)
    b, a = kernels.butterworth(3, short_separation.BANDS[band], FS)
    got = split_filter.both_ways(rows_of(spark, signals), b, a, ends, size, levels).cache()
    for key, x in signals.items():
        want = kernels.both_ways(b, a, x, ends)
        assert np.abs(values(got, key) - want).max() < 1e-9 * np.abs(x).max()


def test_no_group_holds_more_than_a_block_and_its_lead(spark):
    rows = rows_of(spark, walks(200)).withColumn("block", F.floor((F.col("sample") - 1) / 25))
    for backwards in (False, True):
        sizes = split_filter._leads(rows, 25, 6, backwards).groupBy("recording", "channel", "block").count()
        assert sizes.agg(F.max("count")).first()[0] == 25 + 6


def test_powers_of_a_narrow_band_keep_their_digits():
    b, a = kernels.butterworth(3, short_separation.BANDS["mayer"], FS)
    state = np.sin(np.arange(6) / 5)
    alone = kernels.recursive(np.ones(1), a, np.zeros(40), 0.0, state)
    assert np.abs(kernels.faded(a, 40, state) - alone[-6:]).max() < 1e-8
    assert np.allclose(kernels.faded(a, 0, state), state)


def test_constant_and_short_channels(spark):
    rows = rows_of(spark, {(0, 0): np.full(60, 4.0), (0, 1): np.sin(np.arange(60))})
    got = short_separation.bandpass(rows, FS, "cardiac", split=16).cache()
    assert (values(got, (0, 0)) == 0).all()
    assert np.allclose(values(got, (0, 1)), kernels.bandpass(np.sin(np.arange(60)), FS, (0.7, 2.0)))
    with pytest.raises(Exception, match="needs 15 samples"):
        short_separation.bandpass(rows_of(spark, {(0, 0): np.arange(9.0)}), FS, "cardiac", split=8).collect()
    with pytest.raises(ValueError, match="memory"):
        short_separation.bandpass(rows, FS, "cardiac", split=3)


@pytest.mark.parametrize("joined,batch,piece,ends", [("-1", "5", 4, "zeros"), ("10m", "10000", 256, "hold")])
def test_many_short_blocks_share_their_calls(spark, monkeypatch, joined, batch, piece, ends):
    """No block is a group of its own, whatever batches it comes in and however its state is joined."""
    monkeypatch.setattr(split_filter, "PIECE", piece)
    rng = np.random.default_rng(1)
    signals = {(r, c): rng.normal(size=40 + 7 * r + c) for r in range(3) for c in range(8)}
    b, a = kernels.butterworth(3, short_separation.BANDS["respiration"], FS)
    settings = {"spark.sql.autoBroadcastJoinThreshold": joined, "spark.sql.adaptive.autoBroadcastJoinThreshold": joined, "spark.sql.execution.arrow.maxRecordsPerBatch": batch}
    for name, x in settings.items():
        spark.conf.set(name, x)
    try:
        got = split_filter.both_ways(rows_of(spark, signals), b, a, ends, 18)
        assert "GroupsIn" not in got._jdf.queryExecution().toString()
        pdf = got.toPandas()
    finally:
        for name in settings:
            spark.conf.unset(name)
    found = {k: part.sort_values("sample") for k, part in pdf.groupby(["recording", "channel"])}
    assert found.keys() == signals.keys()
    for key, x in signals.items():
        assert found[key]["sample"].tolist() == list(range(1, len(x) + 1))
        assert np.abs(found[key]["value"].to_numpy() - kernels.both_ways(b, a, x, ends)).max() < 1e-9


def test_blocks_of_one_length_are_one_matrix():
    blocks = [(0, c, k, k * 18 + 1, lead, [float(c)] * n) for c in range(50) for k, lead, n in ((0, False, 18), (1, True, 6), (1, False, 7))]
    names = ["recording", "channel", "block", "sample", "lead", "value"]
    batches = [pa.RecordBatch.from_pydict({k: [row[i] for row in blocks[at : at + 64]] for i, k in enumerate(names)}) for at in range(0, len(blocks), 64)]
    parts = list(split_filter._groups(iter(batches), split_filter.BLOCK))
    assert sum(len(p) for p in parts) == len(blocks) and len(parts) <= len(batches) + 1
    seen = 0
    for part in parts:
        at = np.flatnonzero(split_filter._changes(part, split_filter.BLOCK))
        shapes = [(len(which), before.shape, own.shape) for which, before, own in split_filter._alike(part, at, False)]
        assert len(shapes) <= 2 and all(b == (0, n) and o == (18, n) or b == (6, n) and o == (7, n) for n, b, o in shapes)
        seen += sum(n for n, _, _ in shapes)
    assert seen == 100
