import pytest

from cwlight.operators import measurements
from cwlight.sources import preparation as prep

STIM = "recording long, stim_index int, row long, name string, data array<double>, data_labels array<string>"
EVENT = "recording long, onset double, duration double, type string, value double"


def stored(spark):
    return spark.createDataFrame([(1, 1, 1, "a", [0.0, 1.0, 2.0, 9.0], ["s", "d", "v", "x"]), (1, 1, 2, "a", [0.0, 1.0, 2.0, 8.0], ["s", "d", "v", "x"]), (1, 2, 1, "b", [5.0, 0.5, 1.0], None), (2, 1, 1, "a", [3.0, 0.0, 1.0], None), (3, 1, 1, "c", [1.0, 0.0, 1.0], None)], STIM)


def events_of(spark, stims):
    return measurements.events(stims).select("recording", "onset", "duration", "type", "value")


def test_unchanged_events_keep_rows_extras_and_labels(spark):
    rows, notes = prep.stimuli(events_of(spark, stored(spark)), stored(spark))
    assert notes.count() == 0
    got = {(r.recording, r.stim_index, r.row): (list(r.data), list(r.data_labels)) for r in rows.collect()}
    assert got[1, 1, 1] == ([0.0, 1.0, 2.0, 9.0], ["s", "d", "v", "x"]) and got[1, 2, 1][1] == ["starttime", "duration", "value"] and len(got) == 5


def test_edited_events_are_rebuilt_by_type_with_a_note(spark):
    # Recording 1 loses one of two equal events, 2 moves its event; 3 is as it was.
    now = spark.createDataFrame([(1, 5.0, 0.5, "b", 1.0), (1, 0.0, 1.0, "a", 2.0), (2, 4.0, 0.0, "a", 1.0), (2, 1.0, 0.0, "z", 2.0), (3, 1.0, 0.0, "c", 1.0)], EVENT)
    assert sorted(r.recording for r in prep.edited(now, stored(spark)).collect()) == [1, 2]
    rows, notes = prep.stimuli(now, stored(spark))
    got = sorted((r.recording, r.stim_index, r.row, r.name, list(r.data)) for r in rows.collect())
    assert got == [(1, 1, 1, "a", [0.0, 1.0, 2.0]), (1, 2, 1, "b", [5.0, 0.5, 1.0]), (2, 1, 1, "z", [1.0, 0.0, 2.0]), (2, 2, 1, "a", [4.0, 0.0, 1.0]), (3, 1, 1, "c", [1.0, 0.0, 1.0])]
    assert {r.recording: "extra columns" in r.note for r in notes.collect()} == {1: True, 2: False}


def test_units_nulls_and_bad_events(spark):
    units = spark.createDataFrame([(1, "ms"), (2, "s"), (3, "s")], "recording long, time_unit string")
    now = events_of(spark, prep.in_seconds(stored(spark), units))
    assert prep.edited(now, stored(spark), units).count() == 0 and prep.edited(now, stored(spark)).count() == 1
    for bad in ((3, 1.0, -1.0, "c", 1.0), (3, float("nan"), 0.0, "c", 1.0), (3, 1.0, 0.0, "", 1.0), (3, 1.0, 0.0, "c", None)):
        with pytest.raises(Exception, match="cannot be written"):
            prep.stimuli(spark.createDataFrame([bad], EVENT), stored(spark).where("recording = 3"))[0].collect()


def test_times_come_from_the_axis_or_the_rate(spark):
    recs = spark.createDataFrame([(1, 4, 10.0), (2, 3, None), (3, 2, 5.0)], "recording long, n_rows int, sampling_rate double")
    axis = spark.createDataFrame([(2, 1, 0.0), (2, 2, 0.5), (2, 3, 2.0)], "recording long, sample long, time_seconds double")
    got = {(r.recording, r.sample): round(r.time_seconds, 9) for r in prep.times(recs, axis).collect()}
    assert got == {(1, 1): 0.0, (1, 2): 0.1, (1, 3): 0.2, (1, 4): 0.3, (2, 1): 0.0, (2, 2): 0.5, (2, 3): 2.0, (3, 1): 0.0, (3, 2): 0.2}
    with pytest.raises(Exception, match="positive sampling rate"):
        prep.times(recs).collect()
    for bad in ([(2, 1, 0.0), (2, 2, 0.0), (2, 3, 1.0)], [(2, 1, 0.0), (2, 2, 1.0)], [(2, 1, 0.0), (2, 2, float("inf")), (2, 3, 1.0)]):
        with pytest.raises(Exception, match="must be finite"):
            prep.times(recs, spark.createDataFrame(bad, axis.schema)).collect()


def test_compact_times_need_even_steps(spark):
    recs = spark.createDataFrame([(1, 4, 10.0)], "recording long, n_rows int, sampling_rate double")
    assert [(r.start, round(r.step, 9)) for r in prep.compact(prep.times(recs)).collect()] == [(0.0, 0.1)]
    uneven = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.1), (1, 3, 0.3), (1, 4, 0.4)], "recording long, sample long, time_seconds double")
    with pytest.raises(Exception, match="even steps"):
        prep.compact(prep.times(recs, uneven)).collect()
