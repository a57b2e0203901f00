"""The event windows as streams: tumbling counts with a watermark, and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, time: str, length: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Rows of each key and window; works on a stream or a table. A stream drops rows later than the watermark."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, length).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def session_counts(events: DataFrame, time: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def accepted_cuts(hits: DataFrame, key: str, order: str, min_gap: int) -> DataFrame:
    """A stream of hits (key, order) of which each accepted one lies at least min_gap after the last accepted one of its key.

    The last accepted place of each key is the query's state, kept in its
    checkpoint; rows of one batch are taken in order, and one that comes after
    a later one was accepted is dropped.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = hits.schema[key].dataType.simpleString()

    def step(name: tuple, parts, state: GroupState):
        last = state.get[0] if state.exists else None
        for at in sorted(v for pdf in parts for v in pdf[order].tolist()):
            if last is None or at - last >= min_gap:
                last = at
                yield pd.DataFrame({key: [name[0]], order: [at]})
        if last is not None:
            state.update((last,))

    return hits.select(key, order).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, `{order}` long", "last long", "append", GroupStateTimeout.NoTimeout)
