"""Keyed state over event streams: current case state and the invalid-attempt limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ladingcheck import constants as K
from ladingcheck.operators.runs import _STATUS_OF_EVENT

#: Timers and several state variables a key need this provider; the session is told before the query starts.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

CASE_STATE = "case_id string, run_id string, status string, at timestamp"


def _use_state_store(stream: DataFrame) -> None:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class CaseState(StatefulProcessor):
    """Run, status and time of each case; events of an older run are ignored."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("case", "run_id string, status string, at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run_id, status, at = self.state.get() if self.state.exists() else (None, None, None)
        changed = False
        # A key's rows of a micro-batch may come in several frames; their order is that of all of them.
        for event in pd.concat(list(rows)).sort_values(["at", "event_id"]).itertuples():
            if event.type in ("CASE_CREATED", "CASE_REPROCESSED"):
                run_id = event.run_id
            new = _STATUS_OF_EVENT.get(event.type)
            if new is None or run_id is None or event.run_id != run_id:
                continue
            status, at, changed = new, event.at, True
        if run_id is not None:
            self.state.update((run_id, status, at))
        if changed:
            yield pd.DataFrame({"case_id": [key[0]], "run_id": [run_id], "status": [status], "at": [at]})

    def close(self) -> None:
        pass


def stream_case_state(events: DataFrame) -> DataFrame:
    """Updates of the current state per case, from events in arrival order."""
    _use_state_store(events)
    return events.groupBy("case_id").transformWithStateInPandas(
        statefulProcessor=CaseState(), outputStructType=CASE_STATE, outputMode="Update", timeMode="None")


class AttemptLimit(StatefulProcessor):
    """Keeps the counted invalid attempts of the last minute per actor."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counted = handle.getListState("counted", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counted = [r[0] for r in self.counted.get()] if self.counted.exists() else []
        limited = []
        frame = pd.concat(list(rows)).sort_values(["at_ms", "attempt_id"])
        for at, invalid in zip(frame["at_ms"], frame["invalid"]):
            counted = [t for t in counted if at - t < K.INVALID_WINDOW_MS]
            full = len(counted) >= K.INVALID_LIMIT
            limited.append(full)
            if invalid and not full:
                counted.append(at)
        if counted:
            self.counted.put([(t,) for t in counted])
        else:
            self.counted.clear()
        yield frame.assign(limited=limited)[["actor", "attempt_id", "at_ms", "limited"]]

    def close(self) -> None:
        pass


def stream_rate_limit(attempts: DataFrame) -> DataFrame:
    _use_state_store(attempts)
    return attempts.groupBy("actor").transformWithStateInPandas(
        statefulProcessor=AttemptLimit(),
        outputStructType="actor string, attempt_id string, at_ms long, limited boolean",
        outputMode="Append", timeMode="None")
