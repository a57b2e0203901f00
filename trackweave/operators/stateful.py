"""Operators whose next row depends on what they decided before: folds over the sorted rows of each key.

A fold keeps one small state for the key at hand and reads its partition as a
sorted stream of Arrow batches, so a key of any number of rows is never held.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions.scalars import cosine
from trackweave.operators.joins import candidate_edges
from trackweave.operators.windows import compact_ranges


def fold_ordered(df: DataFrame, keys: list[str], order: list[str], step: Callable[[dict, pd.DataFrame], pd.DataFrame], schema: str, *, whole: list[str] | None = None, many: bool = False) -> DataFrame:
    """Apply step(state, rows) to consecutive rows of each key in order; state is an empty dict at a key's first rows.

    Rows that agree in the columns of whole (keys at least) come in one call;
    without it a call has as many rows of the key as the batch holds. With many
    a call has all of the batch's rows of the key that are whole, so that a
    step that goes through frames by itself builds one table for them all.
    """
    whole = whole or []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        at: tuple | None = None
        rest: pd.DataFrame | None = None

        def parts(pdf: pd.DataFrame, by: list[str]) -> list[pd.DataFrame]:
            cols = pdf[by]
            new = ~(cols.eq(cols.shift()) | (cols.isna() & cols.shift().isna())).all(axis=1).to_numpy()
            new[:1] = True
            cuts = [*np.flatnonzero(new).tolist(), len(pdf)]
            return [pdf.iloc[a:b] for a, b in zip(cuts, cuts[1:])]

        def apply(part: pd.DataFrame) -> pd.DataFrame:
            nonlocal at, state
            key = tuple(None if pd.isna(v) else v for v in part[keys].iloc[0])
            if key != at:
                at, state = key, {}
            return step(state, part)

        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            some = parts(pdf, whole if whole and not many else keys) if len(pdf) else []
            rest = some.pop() if whole and some else None
            if many and rest is not None and len(last := parts(rest, whole)) > 1:
                some.append(rest.iloc[: -len(last[-1])])
                rest = last[-1]
            for part in some:
                yield apply(part)
        if rest is not None:
            yield apply(rest)

    placed = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return placed.mapInPandas(run, schema)


def kalman_positions(df: DataFrame, keys: list[str], order: str, x: str, y: str, *, max_lost: int = 8, process: float = 50.0, measurement: float = 5.0, spread: float = 100.0) -> DataFrame:
    """Constant-acceleration filter over a key's rows: keys, order, filter_x, filter_y, lost, valid, predicted.

    Every row is a step; one without a position (null or NaN in either
    coordinate) is only predicted. lost counts such steps since the last
    position, valid says that it is at most max_lost. Before the first position
    the outputs are null and valid is false. The axes don't interact, so one
    3 by 3 covariance serves both.
    """
    move = np.array([[1.0, 1.0, 0.5], [0.0, 1.0, 1.0], [0.0, 0.0, 1.0]])

    def step(state: dict, rows: pd.DataFrame) -> pd.DataFrame:
        seen = rows[[x, y]].to_numpy(float)
        out = np.full((len(rows), 2), np.nan)
        lost = np.zeros(len(rows), np.int64)
        for i, z in enumerate(seen):
            known = not np.isnan(z).any()
            if "mean" in state:
                state["mean"] = move @ state["mean"]
                state["cov"] = move @ state["cov"] @ move.T + process * np.eye(3)
                state["lost"] += 1
                if known:
                    gain = state["cov"][:, 0] / (state["cov"][0, 0] + measurement)
                    state["mean"] = state["mean"] + np.outer(gain, z - state["mean"][0])
                    state["cov"] = state["cov"] - np.outer(gain, state["cov"][0])
            elif known:
                state |= {"mean": np.array([z, [0.0, 0.0], [0.0, 0.0]]), "cov": spread * np.eye(3)}
            if known:
                state["lost"] = 0
            if "mean" in state:
                out[i], lost[i] = state["mean"][0], state["lost"]
            else:
                lost[i] = -1
        fresh = pd.Series(lost, index=rows.index)
        got = rows[[*keys, order]].assign(filter_x=out[:, 0], filter_y=out[:, 1], lost=fresh.where(fresh >= 0).astype("Int64"), valid=(fresh >= 0) & (fresh <= max_lost), predicted=fresh > 0)
        return got.replace({"filter_x": {np.nan: None}, "filter_y": {np.nan: None}})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, order]) + ", filter_x double, filter_y double, lost long, valid boolean, predicted boolean"
    return fold_ordered(df.select(*keys, order, F.col(x).cast("double"), F.col(y).cast("double")), keys, [order], step, schema)


def select_object(
    df: DataFrame, keys: list[str], frame: str, *, frame_area: float, max_area: float, size_penalty: float, acquire: float, reach: float, reach_cap: float, near: float, distance_penalty: float, after_miss: float, forget: int
) -> DataFrame:
    """At most one candidate of each frame, judged by confidence, size and distance from the last one taken.

    df: keys, frame, candidate, confidence, x1, y1, x2, y2. Candidates over
    max_area of the frame go. With nothing taken in the last forget frames a
    candidate needs the confidence acquire. Otherwise it must lie within reach
    per frame passed (reach_cap at most; near at most if its confidence is
    under acquire) and, after a miss, have the confidence after_miss. The
    score is the confidence less size_penalty and distance_penalty times the
    shares of the limits used; equal scores go to the smaller candidate.
    """

    def step(state: dict, rows: pd.DataFrame) -> pd.DataFrame:
        box, conf = rows[["x1", "y1", "x2", "y2"]].to_numpy(float), rows["confidence"].to_numpy(float)
        share = np.clip(box[:, 2] - box[:, 0], 0, None) * np.clip(box[:, 3] - box[:, 1], 0, None) / frame_area
        fits, plain, conf = (share <= max_area).tolist(), (conf - size_penalty * share / max_area).tolist(), conf.tolist()
        middle = ((box[:, 0] + box[:, 2]) / 2 + 1j * ((box[:, 1] + box[:, 3]) / 2)).tolist()
        at = rows[frame].to_numpy()
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(rows)]
        taken, scores, moved, gaps = [], [], [], []
        for first, last, now in zip(cuts, cuts[1:], at[cuts[:-1]].tolist()):
            gap = now - state["frame"] if "frame" in state else 0
            follows = 0 < gap <= forget
            limit = max(1.0, min(reach * gap, reach_cap))
            best, top, step_ = None, 0.0, None
            for i in range(first, last):
                if not fits[i]:
                    continue
                score, away = plain[i], None
                if follows:
                    away = abs(middle[i] - state["middle"])
                    part = away / (min(limit, max(1.0, near)) if conf[i] < acquire else limit)
                    if not part <= 1 or (gap > 1 and conf[i] < after_miss):
                        continue
                    score -= distance_penalty * part
                elif conf[i] < acquire:
                    continue
                if best is None or score > top:
                    best, top, step_ = i, score, away
            if best is not None:
                state |= {"frame": now, "middle": middle[best]}
                taken.append(best)
                scores.append(top)
                moved.append(step_)
                gaps.append(gap if follows else None)
        got = rows.iloc[taken][[*keys, frame, "candidate"]]
        return got.assign(score=scores, moved=pd.array(moved, dtype="Float64"), gap=pd.array(gaps, dtype="Int64"))

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, frame, "candidate"]) + ", score double, moved double, gap long"
    need = df.select(*keys, frame, "candidate", "confidence", "x1", "y1", "x2", "y2").dropna(subset=["confidence", "x1", "y1", "x2", "y2"])
    return fold_ordered(need, keys, [frame, "candidate"], step, schema, whole=[*keys, frame], many=True)


def link_candidates(spans: DataFrame, key: str, *, max_gap: int, max_distance: float, same_team: Column, min_cosine: float, gap_cost: float = 0.5) -> DataFrame:
    """Predecessors that each span may follow: within max_gap frames and max_distance, teams and looks not against it.

    spans: key, id, start, end, first_x, first_y, last_x, last_y, team,
    team_confidence, look (vector or null). same_team is a condition on the
    structs `p` and `c`. Pairs come from a join on buckets of frames.
    """
    edges = candidate_edges(spans, [key], id="id", start="start", end="end", max_gap=max_gap, bucket=max(1, max_gap))
    whole = F.struct(*[c for c in spans.columns if c not in (key, "ranges")])
    p = spans.select(key, F.col("id").alias("source"), whole.alias("p"))
    c = spans.select(key, F.col("id").alias("target"), whole.alias("c"))
    pairs = edges.join(p, [key, "source"]).join(c, [key, "target"])
    away = F.hypot(F.col("c.first_x") - F.col("p.last_x"), F.col("c.first_y") - F.col("p.last_y"))
    alike = F.coalesce(cosine(F.col("p.look"), F.col("c.look")) >= min_cosine, F.lit(True))
    kept = pairs.withColumn("distance", away).where((F.col("distance") <= max_distance) & same_team & alike)
    return kept.select(key, "source", "target", F.col("c.start").alias("start"), F.col("c.end").alias("end"), "gap", "distance", (F.col("distance") + gap_cost * F.col("gap")).alias("score"))


def teams_agree(sure: float = 0.65) -> Column:
    """Not two known, different teams that both are sure."""
    against = (F.col("p.team") != F.col("c.team")) & (F.col("p.team_confidence") >= sure) & (F.col("c.team_confidence") >= sure)
    return ~F.coalesce(against, F.lit(False))


def frame_ranges(rows: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """keys, ranges: the frames of each span as sorted runs (first, last) of consecutive numbers."""
    return compact_ranges(rows, keys, frame).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last")))).alias("ranges"))


class FrameSet:
    """Frames as sorted, disjoint runs: whether others are among them, and their union."""

    def __init__(self) -> None:
        self.first: list[int] = []
        self.last: list[int] = []

    def meets(self, ranges: list[tuple[int, int]]) -> bool:
        for a, b in ranges:
            i = bisect_right(self.first, b) - 1
            if i >= 0 and self.last[i] >= a:
                return True
        return False

    def add(self, ranges: list[tuple[int, int]]) -> None:
        for a, b in ranges:
            i, j = bisect_left(self.last, a - 1), bisect_right(self.first, b + 1)
            if i < j:
                a, b = min(a, self.first[i]), max(b, self.last[j - 1])
            self.first[i:j], self.last[i:j] = [a], [b]


def link_spans(spans: DataFrame, candidates: DataFrame, key: str, *, max_gap: int) -> DataFrame:
    """Chain spans in order of (start, id): key, id, cluster, follows.

    Each takes its candidate of the lowest score (then the smallest id) whose
    cluster has none of its frames; a span may be followed by several that
    share no frame. A span's frames are its ranges (sorted runs, see
    frame_ranges) or, without that column, all from start to end: spans whose
    frames interleave can be one cluster. A cluster is named by its first span.
    Clusters that ended more than max_gap before the span at hand can't be
    followed and leave the state, which so holds the open clusters of one key only.
    """
    offers = candidates.groupBy(key, F.col("target").alias("id")).agg(F.array_sort(F.collect_list(F.struct("score", "source"))).alias("offers"))
    frames = F.col("ranges") if "ranges" in spans.columns else F.array(F.struct(F.col("start").alias("first"), F.col("end").alias("last")))
    flat = [F.transform(frames, lambda r: r["first"].cast("long")).alias("first"), F.transform(frames, lambda r: r["last"].cast("long")).alias("last")]
    rows = spans.select(key, "id", "start", "end", *flat).join(offers, [key, "id"], "left")
    rows = rows.select(key, "id", "start", "end", "first", "last", F.coalesce(F.transform("offers", lambda o: o["source"]), F.array().cast("array<long>")).alias("sources"))

    def step(state: dict, part: pd.DataFrame) -> pd.DataFrame:
        if not state:
            state |= {"of": {}, "frames": {}, "last": {}, "next": 4096}
        names, follows = [], []
        for i, start, end, first, last, sources in zip(*(part[c].tolist() for c in ("id", "start", "end", "first", "last", "sources"))):
            name, before, own = i, None, list(zip(first, last))
            for source in sources:
                cluster = state["of"].get(source)
                if cluster is not None and not state["frames"][cluster].meets(own):
                    name, before = cluster, source
                    break
            state["of"][i] = name
            state["frames"].setdefault(name, FrameSet()).add(own)
            state["last"][name] = max(end, state["last"].get(name, end))
            names.append(name)
            follows.append(before)
            if len(state["of"]) > state["next"]:
                over = {c for c, e in state["last"].items() if e < start - max_gap}
                state["of"] = {k: c for k, c in state["of"].items() if c not in over}
                for c in over:
                    del state["frames"][c], state["last"][c]
                state["next"] = 2 * len(state["of"]) + 4096
        return part[[key, "id"]].assign(cluster=names, follows=pd.array(follows, dtype="Int64"))

    kind = spans.schema[key].dataType.simpleString()
    return fold_ordered(rows, [key], ["start", "id"], step, f"`{key}` {kind}, id long, cluster long, follows long")
