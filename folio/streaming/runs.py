"""Runs and conversations as keyed state: runs that fall silent are ended by a timer, old turns are handed on for a summary."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folio.operators.state import ORPHAN_AFTER
from folio.streaming.answers import ROCKS, STORE


class _Silent(StatefulProcessor):
    """State of a run: its first and last event's time and how many it has; gone when it has ended."""

    def __init__(self, after: float) -> None:
        self.after = int(1000 * after)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "first long, last long, n long, ended boolean")

    def _row(self, key: tuple, status: str, at: int, n: int, first: int, last: int) -> pd.DataFrame:
        return pd.DataFrame({"run_id": [key[0]], "status": [status], "at": [at], "n_events": [n], "seconds": [(last - first) / 1000]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        first, last, n, ended = self.run.get() if self.run.exists() else (None, None, 0, False)
        if ended:
            return
        events = sorted((ms, not answer) for frame in rows for ms, answer in zip(frame["ms"].tolist(), frame["answer"].tolist(), strict=True))
        for ms, open_still in events:
            if last is not None and ms - last > self.after:  # it had been silent too long before this event came
                ended = True
                yield self._row(key, "interrupted", last + self.after + 1, n, first, last)
                break
            first, last, n = ms if first is None else first, ms if last is None else max(last, ms), n + 1
            if not open_still:
                ended = True
                yield self._row(key, "finished", ms, n, first, last)
                break
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not ended:
            self.handle.registerTimer(last + self.after + 1)  # one that the watermark has passed fires with this batch
        self.run.update((first, last, n, ended))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        first, last, n, ended = self.run.get()
        if not ended:
            self.run.update((first, last, n, True))
            yield self._row(key, "interrupted", expiredTimerInfo.getExpiryTimeInMs(), n, first, last)

    def close(self) -> None:
        pass


def ended_runs(events: DataFrame, after: float = ORPHAN_AFTER, late: str = "0 seconds") -> DataFrame:
    """(run_id, status, at, n_events, seconds) of a stream (run_id, ts, answer boolean), once for each run: ``finished`` when its answer comes,
    ``interrupted`` when it is silent for longer than ``after`` seconds: a timer says so when the watermark is that far past its last event, without a new row of the
    run, or the event after the silence. ``at`` is in milliseconds.

    A run stays ended, whatever comes later. Results are the same for any batches of events that come in the order of time, and of one time, an answer counts first; equal rows
    count each; an event without a run or time is left out."""
    events.sparkSession.conf.set(STORE, ROCKS)
    kind = dict(events.dtypes)["run_id"]
    rows = events.where(F.col("run_id").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late).select("run_id", "ts", F.unix_millis("ts").alias("ms"), F.coalesce("answer", F.lit(False)).alias("answer"))
    return rows.groupBy("run_id").transformWithStateInPandas(_Silent(after), f"run_id {kind}, status string, at long, n_events long, seconds double", "append", "eventTime")


class _Summarised(StatefulProcessor):
    """State of a session: its turns that no summary has yet, in order."""

    def __init__(self, budget: float, keep: int) -> None:
        self.budget, self.keep = budget, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn long, cost double")
        self.done = handle.getValueState("done", "turn long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        done = self.done.get()[0] if self.done.exists() else None
        fresh = {t: c for frame in rows for t, c in zip(frame["turn"].tolist(), frame["cost"].tolist(), strict=True) if done is None or t > done}
        held = dict(self.turns.get()) if self.turns.exists() else {}
        held |= {t: c for t, c in fresh.items() if t not in held}
        told = []
        order = sorted(held)
        total, first = 0.0, 0
        # turn by turn, so that it doesn't matter how many of them come in one batch
        for i, turn in enumerate(order):
            total += held[turn]
            if total >= self.budget and i - first + 1 > self.keep and turn in fresh:
                last = i - self.keep
                told.append((key[0], order[first], order[last], last - first + 1, sum(held[t] for t in order[first : last + 1])))
                total -= told[-1][4]
                first = last + 1
        if told:
            self.done.update((told[-1][2],))
        self.turns.put([(t, held[t]) for t in order[first:]])
        yield pd.DataFrame(told, columns=["session", "idx_from", "idx_to", "n", "cost"])

    def close(self) -> None:
        pass


def summary_ranges(turns: DataFrame, cost: Column, budget: float = 3000, keep: int = 6) -> DataFrame:
    """(session, idx_from, idx_to, n, cost) of a stream (session, turn, ...): the ranges of turns that summaries take in. After a turn with which the turns that no summary
    has yet cost ``budget`` or more, all but the last ``keep`` of these are sent on and forgotten.

    Turns of a session are to come in order, in any batches; a turn that comes again, or after its range was sent, is left out. State is bounded by the budget: at most the
    turns that cost less than it, and ``keep`` more."""
    turns.sparkSession.conf.set(STORE, ROCKS)
    kind = dict(turns.dtypes)["session"]
    rows = turns.select("session", F.col("turn").cast("long").alias("turn"), cost.cast("double").alias("cost")).where("turn IS NOT NULL").fillna(0.0, ["cost"])
    return rows.groupBy("session").transformWithStateInPandas(_Summarised(budget, keep), f"session {kind}, idx_from long, idx_to long, n long, cost double", "append", "none")
