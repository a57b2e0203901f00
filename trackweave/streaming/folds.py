"""Folds over streams: the step functions of ordered folds with their state in the query's checkpoint."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class Fold(StatefulProcessor):
    """Keeps of each key its state and the rows of its newest frame, which is complete once a later one comes."""

    def __init__(self, frame: str, order: list[str], step: Callable[[dict, pd.DataFrame], pd.DataFrame], idle_ms: int | None):
        self.frame, self.order, self.step, self.idle_ms = frame, order, step, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("kept", "blob binary")

    def _load(self) -> tuple[dict, pd.DataFrame | None, int | None]:
        return pickle.loads(self.kept.get()[0]) if self.kept.exists() else ({}, None, None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, held, done = self._load()
        pdf = pd.concat([p for p in (held, *rows) if p is not None and len(p)], ignore_index=True)
        if done is not None:
            pdf = pdf[pdf[self.frame] > done]
        pdf = pdf.sort_values([self.frame, *self.order], kind="stable")
        newest = pdf[self.frame].max()
        whole, held = pdf[pdf[self.frame] < newest], pdf[pdf[self.frame] == newest]
        if len(whole):
            done = int(whole[self.frame].iloc[-1])
            yield self.step(state, whole)
        self.kept.update((pickle.dumps((state, held, done)),))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, held, _ = self._load()
        self.kept.clear()
        if held is not None and len(held):
            yield self.step(state, held)

    def close(self) -> None:
        pass


def fold_stream(rows: DataFrame, keys: list[str], frame: str, order: list[str], step: Callable[[dict, pd.DataFrame], pd.DataFrame], schema: str, *, idle_ms: int | None = None) -> DataFrame:
    """step(state, rows of one frame) over a stream, frame by frame of each key, as fold_ordered does over a table.

    A frame is handed on when a row of a later frame of its key has come; rows
    of frames handed on already are too late and go. A key without rows for
    idle_ms ends: its last frame is handed on and its state is dropped; with
    None it is kept. Needs the RocksDB state store.
    """
    return rows.groupBy(*keys).transformWithStateInPandas(Fold(frame, order, step, idle_ms), schema, "Append", "None" if idle_ms is None else "ProcessingTime")
