"""Live feedback: region means against a frozen baseline, smoothed and sent at a fixed pace.

``advance`` handles one stream's new samples and is the same for a stream
(``live``) and for a stored recording (``replay``).  Samples are taken in chunks
of max(1, floor(fs * update_seconds)), whatever the micro-batches were: at most
one update leaves a chunk, at its last sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cwlight.streaming.delivery import CAPACITY, ChunkQueue, Ledger

UPDATE = "stream string, sequence long, time double, scheduled double, target string, value double, skipped string, skipped_count long"


@dataclass(frozen=True)
class Plan:
    """What is measured: regions as channel positions, targets as weights of regions, and the pace."""

    fs: float
    regions: dict[str, tuple[int, ...]]
    contrast: dict[str, dict[str, float]]
    baseline_seconds: float = 20.0
    update_seconds: float = 0.1
    smoothing_seconds: float = 2.0

    def __post_init__(self) -> None:
        used = [c for cs in self.regions.values() for c in cs]
        if not used or len(used) != len(set(used)):
            raise ValueError("regions must not be empty or share channels")
        if not self.contrast or any(set(w) != set(self.regions) for w in self.contrast.values()):
            raise ValueError("each target of a contrast must name every region exactly, with weight 0 where it has none")
        if not all(np.isfinite(x) for w in self.contrast.values() for x in w.values()):
            raise ValueError("weights must be finite")
        if not all(self.regions.values()) or not all([*self.regions, *self.contrast]):
            raise ValueError("regions need members, regions and targets names")
        if not (0 < self.baseline_seconds <= 1800 and 1 / 120 <= self.update_seconds <= 1 and 0 < self.smoothing_seconds <= 600):
            raise ValueError("baseline, update or smoothing seconds out of range")

    @property
    def chunk(self) -> int:
        return max(1, int(self.fs * self.update_seconds))

    @property
    def weights(self) -> np.ndarray:
        """(targets, regions)."""
        return np.array([[w.get(r, 0.0) for r in self.regions] for w in self.contrast.values()])


@dataclass
class State:
    """All that is kept of a stream between its chunks."""

    start: float | None = None
    total: list[float] = field(default_factory=list)
    count: int = 0
    baseline: list[float] | None = None
    due: float | None = None
    sent: int = 0
    times: list[float] = field(default_factory=list)
    values: list[list[float]] = field(default_factory=list)
    waiting_times: list[float] = field(default_factory=list)
    waiting: list[list[float]] = field(default_factory=list)


def trailing_mean(t: np.ndarray, v: np.ndarray, end: float, seconds: float) -> np.ndarray | None:
    """Time-weighted means over the last ``seconds``, linear between samples; None where they are not covered."""
    start, slack = end - seconds, max(1e-9, seconds * 1e-9)
    if not len(t) or t[0] > start + slack or t[-1] < end - slack:
        return None
    grid = np.concatenate([[start], t[(t > start) & (t < end)], [end]])
    return np.array([np.trapezoid(np.interp(grid, t, column), grid) for column in v.T]) / seconds


def _one_chunk(plan: Plan, s: State, t: np.ndarray, regions: np.ndarray) -> list[tuple]:
    """Rows (sequence, time, scheduled, values, reason, count) that one chunk gives; the state moves on."""
    step, out = 1 / plan.fs, []
    slack = max(1e-9, 0.05 * step)
    gaps = np.diff(np.concatenate([s.times[-1:], t]))
    if len(gaps) and np.abs(gaps - step).max() > slack:
        raise ValueError("the stream's clock jumped: a sample is late, early or missing")
    if s.start is None:
        s.start, s.total = float(t[0]), [0.0] * regions.shape[1]
    quiet_end, now = s.start + plan.baseline_seconds, float(t[-1])
    if s.baseline is None:
        early = t < quiet_end
        s.total = (np.array(s.total) + regions[early].sum(axis=0)).tolist()
        s.count += int(early.sum())
        if now >= quiet_end:
            if s.count < 2:
                raise ValueError("the baseline holds fewer than two samples")
            s.baseline = (np.array(s.total) / s.count).tolist()
            s.due = max(quiet_end, s.start + plan.smoothing_seconds)
    s.times += t.tolist()
    s.values += regions.tolist()
    if s.due is not None and now + slack >= s.due:
        late = max(0, int(np.floor((now - s.due) / plan.update_seconds + 1e-10)))
        if late:
            out.append((None, now, s.due, None, "obsolete_schedule", late))
            s.due += late * plan.update_seconds
        mean = trailing_mean(np.array(s.times), np.array(s.values), now, plan.smoothing_seconds)
        if mean is None:
            out.append((None, now, s.due, None, "incomplete_smoothing_window", 1))
        else:
            out.append((s.sent, now, s.due, plan.weights @ (mean - np.array(s.baseline)), None, 0))
            s.sent += 1
        s.due += plan.update_seconds
    keep_from = now - max(plan.smoothing_seconds, 2 * plan.update_seconds, 4 * step)
    first = max(0, int(np.searchsorted(s.times, keep_from)) - 1)
    s.times, s.values = s.times[first:], s.values[first:]
    return out


def advance(plan: Plan, s: State, t: np.ndarray, channels: np.ndarray) -> list[tuple]:
    """Rows for all whole chunks in the samples that wait and those that came."""
    if len(t) and not (np.isfinite(t).all() and np.isfinite(channels).all()):
        raise ValueError("samples must be finite")
    new = np.array([channels[:, list(cs)].mean(axis=1) for cs in plan.regions.values()]).T if len(t) else np.zeros((0, len(plan.regions)))
    times = np.concatenate([s.waiting_times, t])
    values = np.concatenate([np.array(s.waiting).reshape(-1, len(plan.regions)), new])
    out, n = [], plan.chunk
    whole = len(times) // n * n
    for a in range(0, whole, n):
        out += _one_chunk(plan, s, times[a : a + n], values[a : a + n])
    s.waiting_times, s.waiting = times[whole:].tolist(), values[whole:].tolist()
    return out


def _table(plan: Plan, stream: str, rows: list[tuple]) -> pd.DataFrame:
    flat = []
    for sequence, time, scheduled, values, reason, count in rows:
        if values is None:
            flat.append((stream, None, time, scheduled, None, None, reason, count))
        else:
            flat += [(stream, sequence, time, scheduled, target, float(x), None, 0) for target, x in zip(plan.contrast, values)]
    out = pd.DataFrame(flat, columns=[c.split()[0] for c in UPDATE.split(", ")])
    return out.astype({"sequence": "Int64", "skipped_count": "int64", "time": float, "scheduled": float, "value": float})


def replay(samples: DataFrame, plan: Plan, missing: str = "error") -> DataFrame:
    """Updates of stored streams: (stream, t, channels array<double>) rows, one stream a group.

    A stream without all channels that the plan names is an error, or with
    ``missing="skip"`` one row with reason ``missing_channels`` and their number.
    """
    if missing not in ("error", "skip"):
        raise ValueError("missing must be 'error' or 'skip'")
    named = 1 + max(c for cs in plan.regions.values() for c in cs)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stream, width = pdf["stream"].iloc[0], min(len(x) for x in pdf["channels"])
        if width < named and missing == "skip":
            return _table(plan, stream, [(None, None, None, None, "missing_channels", named - width)])
        pdf = pdf.sort_values("t")
        return _table(plan, stream, advance(plan, State(), pdf["t"].to_numpy(float), np.stack(pdf["channels"].to_numpy())))

    return samples.groupBy("stream").applyInPandas(run, UPDATE)


STATES = {"sent": "sent long", "clock": "start double, due double, count long", "baseline": "total array<double>, mean array<double>", "window": "t double, regions array<double>", "waiting": "t double, regions array<double>"}
#: State with a type for each part needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Stream(StatefulProcessor):
    """``advance`` over typed state: values (updates sent, clock, baseline) and lists (the smoothing window, samples short of a chunk).

    All but the number of updates sent is forgotten in time, so a stream that
    comes back goes on with the next number.
    """

    def __init__(self, plan: Plan, forget_seconds: float | None) -> None:
        self.plan, self.ttl = plan, None if forget_seconds is None else int(1000 * forget_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        value, listed = handle.getValueState, handle.getListState
        self.states = {name: (listed if name in ("window", "waiting") else value)(name, schema, None if name == "sent" else self.ttl) for name, schema in STATES.items()}

    def _read(self) -> State:
        sent, clock, baseline, window, waiting = self.states.values()
        number = sent.get()[0] if sent.exists() else 0
        if not clock.exists():
            return State(sent=number)
        start, due, count = clock.get()
        total, mean = baseline.get()
        near, short = ([(t, list(x)) for t, x in s.get()] if s.exists() else [] for s in (window, waiting))
        split = lambda rows: ([t for t, _ in rows], [x for _, x in rows])
        return State(start, list(total), count, None if mean is None else list(mean), due, number, *split(near), *split(short))

    def _write(self, s: State) -> None:
        sent, clock, baseline, window, waiting = self.states.values()
        sent.update((s.sent,))
        clock.update((s.start, s.due, s.count))
        baseline.update((s.total, s.baseline))
        for state, times, values in ((window, s.times, s.values), (waiting, s.waiting_times, s.waiting)):
            if times:
                state.put(list(zip(times, values)))
            else:
                state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values("t")
        s = self._read()
        out = advance(self.plan, s, pdf["t"].to_numpy(float), np.stack(pdf["channels"].to_numpy()))
        self._write(s)
        yield _table(self.plan, key[0], out)

    def close(self) -> None:
        pass


def live(samples: DataFrame, plan: Plan, forget_seconds: float | None = None) -> DataFrame:
    """Updates of a streaming DataFrame of the same rows.

    State is kept per stream and trimmed to the smoothing window; with
    ``forget_seconds`` a stream silent for so long is forgotten, and one that
    comes back then starts with a new baseline.  The query must run with ``STORE`` as its state
    store (``Feedback`` sees to that).
    """
    mode = "None" if forget_seconds is None else "ProcessingTime"
    return samples.groupBy("stream").transformWithStateInPandas(_Stream(plan, forget_seconds), UPDATE, "append", mode)


class Feedback:
    """A live query from start to stop.  It cannot be started twice, or stepped once it has stopped.

    ``samples`` is a streaming DataFrame, all of which a step works off, or a
    ``ChunkQueue``, from which a step takes as many chunks as it is told.
    Updates go to a table in memory, or to a ``Ledger`` in ``folder``: there each
    comes once, with a receipt, also over restarts and replayed batches.
    """

    def __init__(self, samples: DataFrame | ChunkQueue, plan: Plan, name: str, checkpoint: str, folder: str | None = None, forget_seconds: float | None = None) -> None:
        self.queue = samples if isinstance(samples, ChunkQueue) else None
        # Over a queue, or where streams are forgotten by the clock, each step is a query that ends.
        self.stepwise = self.queue is not None or forget_seconds is not None
        if self.stepwise and folder is None:
            raise ValueError("steps over a queue, and streams that are forgotten, need a folder for their updates")
        rows = samples if self.queue is None else self.queue.stream()
        self.updates, self.name, self.checkpoint, self.query, self.status = live(rows, plan, forget_seconds), name, checkpoint, None, "created"
        # By the clock there is always one more batch to look for what is forgotten, so such a step is one batch.
        self.trigger = {"availableNow": True} if forget_seconds is None else {"once": True}
        self.folder = folder
        self.ledger = None if folder is None else Ledger(rows.sparkSession, folder, checkpoint)

    @property
    def _spark(self) -> SparkSession:
        return self.updates.sparkSession

    def _run(self, **trigger):
        """The query, begun with the store that typed state needs; the session keeps its own setting."""
        out = self.updates.writeStream.outputMode("append").queryName(self.name).option("checkpointLocation", self.checkpoint)
        out = out.format("memory") if self.ledger is None else out.foreachBatch(self.ledger.commit)
        key = "spark.sql.streaming.stateStore.providerClass"
        before = self._spark.conf.get(key, None)
        self._spark.conf.set(key, STORE)
        try:
            return (out.trigger(**trigger) if trigger else out).start()
        finally:
            self._spark.conf.unset(key) if before is None else self._spark.conf.set(key, before)

    def start(self) -> Feedback:
        if self.status != "created":
            raise RuntimeError(f"cannot start: {self.status}")
        if not self.stepwise:
            self.query = self._run()
        self.status = "running"
        return self

    def step(self, max_chunks: int = CAPACITY) -> Feedback:
        """Works off all that has arrived or, from a queue, at most ``max_chunks`` chunks, oldest first.

        A queue in which more than its capacity waits, a gap in the clock or in
        the updates, and another writer in the folder end the loop.
        """
        if self.status != "running":
            raise RuntimeError(f"cannot step: {self.status}")
        if not (isinstance(max_chunks, int) and 1 <= max_chunks <= 100_000):
            raise ValueError("max_chunks must be a whole number from 1 to 100000")
        try:
            if not self.stepwise:
                self.query.processAllAvailable()
            else:
                if self.queue is not None:
                    self.queue.admit(max_chunks)
                self.query = self._run(**self.trigger)
                self.query.awaitTermination()
        except Exception:
            self.status = "error_stopped"
            raise
        return self

    def state(self, last: int = 512) -> DataFrame:
        """The last updates, newest first."""
        rows = self._spark.table(self.name) if self.ledger is None else self.ledger.updates()
        return rows.orderBy(F.desc("time"), "stream", "target").limit(last)

    def snapshot(self) -> dict:
        """The loop in plain numbers: status, chunks that wait, and of updates kept the number, the last sequence and the last time."""
        sent = self.state(2**31 - 1).where("skipped IS NULL").select("stream", "sequence", "time").distinct()
        facts = sent.agg(F.count(F.lit(1)).alias("updates"), F.count_distinct("stream").alias("streams"), F.max("sequence").alias("last_sequence"), F.max("time").alias("last_time")).first()
        return {"status": self.status, "waiting": None if self.queue is None else self.queue.waiting(), **facts.asDict()}

    def stop(self) -> None:
        if self.status == "running":
            if self.query is not None:
                self.query.stop()
            self.status = "stopped"

    def __repr__(self) -> str:
        return f"<Feedback {self.name}: {self.status}>"
