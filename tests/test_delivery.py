import numpy as np
import pytest
from pyspark.sql import functions as F

from cwlight.streaming.delivery import ChunkQueue, Ledger
from cwlight.streaming.feedback import UPDATE, Feedback, Plan, replay

PLAN = Plan(fs=10, regions={"left": (0, 1), "right": (2,)}, contrast={"lateral": {"left": 1.0, "right": -1.0}, "mean": {"left": 0.5, "right": 0.5}}, baseline_seconds=1.0, update_seconds=0.2, smoothing_seconds=0.4)
ROWS = "stream string, t double, channels array<double>"


def samples(spark, streams="ab", n=60):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(s, i / 10, rng.normal(size=3).tolist()) for s in streams for i in range(n)], ROWS)


def chunk(rows, i, size=2):
    return rows.where((F.round(F.col("t") * 10) >= i * size) & (F.round(F.col("t") * 10) < (i + 1) * size)).coalesce(1)


def sent(df):
    return sorted((r.stream, r.sequence, round(r.time, 9), r.target, round(r.value, 9)) for r in df.where("skipped IS NULL").collect())


def updates(spark, *rows):
    """UPDATE rows of (stream, sequence) with two targets each."""
    return spark.createDataFrame([(s, k, k / 5, k / 5, target, float(k), None, 0) for s, k in rows for target in ("x", "y")], UPDATE)


def test_steps_over_a_queue_equal_a_replay_with_restarts(spark, tmp_path):
    rows = samples(spark).cache()
    queue = ChunkQueue(spark, str(tmp_path / "queue"))
    place = (str(tmp_path / "ck"), str(tmp_path / "out"))
    loop, done = Feedback(queue, PLAN, "steps_0", *place).start(), 0
    for restart, chunks in enumerate((11, 12, 7)):
        if restart:  # a new loop over the same checkpoint
            loop.stop()
            loop = Feedback(queue, PLAN, f"steps_{restart}", *place).start()
        for i in range(done, done + chunks):
            queue.offer(chunk(rows, i))
        done += chunks
        loop.step(5)
        assert queue.waiting() == max(0, chunks - 5)
        while queue.waiting():
            loop.step()
    assert sent(loop.state()) == sent(replay(rows, PLAN))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
    # What is kept of a stream is bounded by the smoothing window, not by its length.
    kept = spark.read.format("statestore").option("path", place[0]).option("stateVarName", "window").load()
    assert 0 < kept.count() <= 2 * (int(PLAN.smoothing_seconds * PLAN.fs) + 2)
    late = loop.ledger.undelivered({"a": 3})
    assert sorted(r.sequence for r in late.collect()) == list(range(3, late.count() + 3))
    facts = loop.snapshot()
    assert facts["status"] == "running" and facts["waiting"] == 0 and facts["streams"] == 2 and facts["updates"] == 2 * (facts["last_sequence"] + 1)
    loop.stop()


def test_more_chunks_than_the_queue_holds_end_the_loop(spark, tmp_path):
    queue = ChunkQueue(spark, str(tmp_path / "queue"))
    loop = Feedback(queue, PLAN, "full", str(tmp_path / "ck"), str(tmp_path / "out")).start()
    one = samples(spark, "a", 2).coalesce(1)
    for _ in range(17):
        queue.offer(one)
    with pytest.raises(RuntimeError, match="17 chunks wait"):
        loop.step(4)
    assert loop.status == "error_stopped" and queue.waiting() == 17
    with pytest.raises(RuntimeError, match="cannot step"):
        loop.step()


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path), "me")
    ledger.commit(updates(spark, ("a", 0), ("a", 1), ("b", 0)), 0)
    first = sorted(map(str, ledger.receipts().collect()))
    ledger.commit(updates(spark, ("a", 0), ("a", 1), ("b", 0)), 0)
    assert sorted(map(str, ledger.receipts().collect())) == first and len(first) == 3
    ledger.commit(updates(spark, ("a", 2)), 1)
    assert {(r.stream, r.sequence, r.batch) for r in ledger.receipts().collect()} == {("a", 0, 0), ("a", 1, 0), ("b", 0, 0), ("a", 2, 1)}
    assert all(r["values"] == {"x": float(r.sequence), "y": float(r.sequence)} for r in ledger.receipts().collect())


def test_gaps_and_other_writers_are_refused_without_a_claim(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path), "me")
    ledger.commit(updates(spark, ("a", 0)), 0)
    for bad in ([("a", 2)], [("a", 0)], [("a", 1), ("a", 3)], [("c", 1)]):
        with pytest.raises(RuntimeError, match="is next"):
            ledger.commit(updates(spark, *bad), 1)
    Ledger(spark, str(tmp_path), "me").commit(updates(spark, ("a", 1)), 4)
    with pytest.raises(RuntimeError, match="later"):
        ledger.commit(updates(spark, ("a", 1)), 2)
    with pytest.raises(RuntimeError, match="another writer"):
        Ledger(spark, str(tmp_path), "someone else").commit(updates(spark, ("a", 2)), 5)
    assert sorted(r.sequence for r in ledger.receipts().collect()) == [0, 1]


def test_an_interfering_writer_stops_the_loop(spark, tmp_path):
    rows = samples(spark, "a").cache()
    queue = ChunkQueue(spark, str(tmp_path / "queue"))
    loop = Feedback(queue, PLAN, "interfered", str(tmp_path / "ck"), str(tmp_path / "out")).start()
    for i in range(10):
        queue.offer(chunk(rows, i))
    loop.step()
    before = sent(loop.state())
    assert before
    head = max(x[1] for x in before)
    other = Ledger(spark, str(tmp_path / "out"), str(tmp_path / "ck"))
    other.commit(updates(spark, ("a", head + 1)), 50)  # it even bears the loop's name
    for i in range(10, 14):
        queue.offer(chunk(rows, i))
    with pytest.raises(Exception, match="later than"):
        loop.step()
    assert loop.status == "error_stopped"
    assert sorted({r.sequence for r in loop.ledger.receipts().collect()}) == list(range(head + 2))


def test_receipts_are_trimmed_and_old_ones_not_promised(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path), "me", kept=4)
    ledger.commit(updates(spark, *(("a", k) for k in range(3)), ("b", 0)), 0)
    ledger.commit(updates(spark, *(("a", k) for k in range(3, 9))), 1)
    assert sorted((r.stream, r.sequence) for r in ledger.receipts().collect()) == [("a", 5), ("a", 6), ("a", 7), ("a", 8), ("b", 0)]
    assert sorted(r.sequence for r in ledger.undelivered({"a": 6}).collect()) == [6, 7, 8]
    assert ledger.undelivered({"a": 9}).count() == 0
    with pytest.raises(Exception, match="oldest kept"):
        ledger.undelivered({"a": 2}).collect()


def test_a_silent_stream_is_forgotten(spark, tmp_path):
    rows = samples(spark, "a", 12)
    rows.coalesce(1).write.parquet(str(tmp_path / "in" / "0"))
    stream = spark.readStream.schema(ROWS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    live = Feedback(stream, PLAN, "forgetful", str(tmp_path / "ck"), str(tmp_path / "out"), forget_seconds=0.05).start().step()
    first = sorted(r.sequence for r in live.state().where("skipped IS NULL AND target = 'mean'").collect())
    rows.coalesce(1).write.parquet(str(tmp_path / "in" / "1"))  # its clock starts again: an error if the stream were known
    live.step()
    both = sorted(r.sequence for r in live.state().where("skipped IS NULL AND target = 'mean'").collect())
    assert first and both == list(range(2 * len(first)))
    live.stop()
    with pytest.raises(ValueError, match="folder"):
        Feedback(stream, PLAN, "forgetful", str(tmp_path / "ck"), forget_seconds=1.0)
