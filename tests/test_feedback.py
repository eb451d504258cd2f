import numpy as np
import pytest

from cwlight.streaming.feedback import Feedback, Plan, State, advance, replay

PLAN = Plan(fs=10, regions={"left": (0, 1), "right": (2,)}, contrast={"lateral": {"left": 1.0, "right": -1.0}}, baseline_seconds=1.0, update_seconds=0.2, smoothing_seconds=0.4)


def source():
    t = np.arange(30) / 10
    return t, np.stack([1 + np.where(t >= 1, t, 0), 1 + np.where(t >= 1, 0.5 * t, 0), np.ones(30)], axis=1)


def test_any_cut_into_batches_gives_the_same_updates():
    t, x = source()
    whole = advance(PLAN, State(), t, x)
    s, parts = State(), []
    for a, b in ((0, 1), (1, 8), (8, 9), (9, 23), (23, 30)):
        parts += advance(PLAN, s, t[a:b], x[a:b])
    sent = [r for r in whole if r[3] is not None]
    assert [r[0] for r in sent] == list(range(len(sent))) and len(sent) == 10 and sent[0][1] >= 1
    assert all(np.allclose(a[3], b[3]) if a[3] is not None else a == b for a, b in zip(whole, parts)) and len(whole) == len(parts)
    assert len(s.times) <= 8


def test_a_late_sample_stops_the_stream():
    t, x = source()
    t[7] += 0.05
    with pytest.raises(ValueError, match="clock"):
        advance(PLAN, State(), t, x)


def test_plans_are_checked():
    with pytest.raises(ValueError):
        Plan(fs=10, regions={"a": (0,), "b": (0,)}, contrast={})
    with pytest.raises(ValueError):
        Plan(fs=10, regions={"a": (0,)}, contrast={"x": {"b": 1.0}})
    with pytest.raises(ValueError, match="every region"):
        Plan(fs=10, regions={"a": (0,), "b": (1,)}, contrast={"x": {"b": 1.0}})


def test_stream_equals_replay(spark, tmp_path):
    t, x = source()
    rows = spark.createDataFrame([("s", float(a), [float(v) for v in b]) for a, b in zip(t, x)], "stream string, t double, channels array<double>")
    want = sorted((r.time, round(r.value, 9)) for r in replay(rows, PLAN).where("skipped IS NULL").collect())
    for i, (lo, hi) in enumerate(((0, 1.25), (1.25, 9))):
        rows.where(f"t >= {lo} AND t < {hi}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    live = Feedback(stream, PLAN, "feedback_test", str(tmp_path / "ck")).start().step()
    got = sorted((r.time, round(r.value, 9)) for r in live.state().where("skipped IS NULL").collect())
    live.stop()
    assert got == want and len(got) == 10 and "stopped" in repr(live)
    with pytest.raises(RuntimeError):
        live.start()


def test_updates_in_files_come_once_over_restarts(spark, tmp_path):
    t, x = source()
    rows = spark.createDataFrame([("s", float(a), [float(v) for v in b]) for a, b in zip(t, x)], "stream string, t double, channels array<double>")
    places = {k: str(tmp_path / k) for k in ("in", "ck", "out")}
    for name, lo, hi in (("one", 0, 1.85), ("two", 1.85, 9)):
        rows.where(f"t >= {lo} AND t < {hi}").coalesce(1).write.parquet(f"{places['in']}/{name}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(places["in"])
        live = Feedback(stream, PLAN, f"feedback_{name}", places["ck"], places["out"]).start().step()
        live.stop()
    got = sorted(r.sequence for r in live.state().where("skipped IS NULL").collect())
    assert got == list(range(10))
