"""Multi-object tracking: detections of consecutive frames joined to tracks, as folds over the frames of each recording.

A step function takes the state of a recording and the detections of some
whole frames; the same step runs over a table (stateful.fold_ordered) and over a
stream (streaming.folds). The state holds live tracks only: those seen within
the age limit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.operators.joins import least_cost_assignment
from trackweave.operators.scenes import annotated, id_offsets
from trackweave.operators.stateful import fold_ordered

#: Kinds of detections that may continue each other's tracks (fixed values of the rules).
PEOPLE = ("player", "goalkeeper", "person")
NEVER = 1e6
BOX = ["x1", "y1", "x2", "y2"]

Step = Callable[[dict, pd.DataFrame], pd.DataFrame]


@dataclass(frozen=True)
class LookRules:
    """Limits of tracking by overlap, look and distance at once (defaults are those of the rules)."""

    min_confidence: float = 0.10
    max_age: int = 150
    min_hits: int = 2
    reach: float = 180.0
    max_cost: float = 0.78
    overlap_weight: float = 0.45
    look_weight: float = 0.35
    distance_weight: float = 0.20
    min_similarity: float = 0.15
    keep: float = 0.85
    same_kind: bool = True


@dataclass(frozen=True)
class StageRules:
    """Limits of tracking in stages: sure detections before unsure ones (defaults are those of the rules).

    sure: confidence from which a detection takes part in the first stage; one
    that begins a track has lead more. buffer: frames that a track is looked
    for after it was last seen.
    """

    floor: float = 0.10
    sure: float = 0.25
    lead: float = 0.10
    most: float = 0.95
    most_unsure: float = 0.5
    most_new: float = 0.7
    buffer: int = 150
    min_hits: int = 2


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of every box of a with every box of b; 0 where both are empty."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    shared = np.clip(high - low, 0, None).prod(axis=2)
    area = lambda x: np.clip(x[:, 2:] - x[:, :2], 0, None).prod(axis=1)
    union = area(a)[:, None] + area(b)[None] - shared
    return np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between the middles of boxes."""
    return np.hypot(*np.moveaxis((a[:, None, :2] + a[:, None, 2:] - b[None, :, :2] - b[None, :, 2:]) / 2, 2, 0))


def similarities(a: list[np.ndarray | None], b: list[np.ndarray | None]) -> np.ndarray:
    """Cosines; NaN where a side is missing or zero, or their lengths differ."""
    out = np.full((len(a), len(b)), np.nan)
    for size in {len(x) for x in a if x is not None} & {len(y) for y in b if y is not None}:
        i, j = ([k for k, x in enumerate(side) if x is not None and len(x) == size] for side in (a, b))
        x, y = np.array([a[k] for k in i]), np.array([b[k] for k in j])
        norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)
        out[np.ix_(i, j)] = np.divide(x @ y.T, norms, out=np.full(norms.shape, np.nan), where=norms > 0)
    return out


def matched(cost: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Pairs of the assignment of least total cost that cost at most `most`."""
    if not cost.size:
        return []
    return [(i, j) for i, j in zip(*(v.tolist() for v in least_cost_assignment(cost))) if cost[i, j] <= most]


def _advance(tracks: list[dict], frames: int, age: int) -> list[dict]:
    """Tracks moved on by their velocity, without those unseen for more than age frames."""
    for t in tracks:
        t["box"] = t["box"] + frames * t["velocity"]
        t["unseen"] += frames
    return [t for t in tracks if t["unseen"] <= age]


def _see(track: dict, box: np.ndarray, kind: str | None, look: np.ndarray | None = None, keep: float = 0.0) -> None:
    track |= {"velocity": box - track["box"], "box": box, "unseen": 0, "hits": track["hits"] + 1, "kind": kind}
    old = track["look"]
    if look is not None:
        mixed = keep * old + (1 - keep) * look if old is not None and len(old) == len(look) else look
        track["look"] = mixed / np.linalg.norm(mixed) if mixed is not look and np.linalg.norm(mixed) > 0 else look


def _frames(rows: pd.DataFrame, frame: str) -> list[tuple[int, slice]]:
    """Each frame of sorted rows with the places of its rows."""
    at = rows[frame].to_numpy(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
    return [(int(at[a]), slice(a, b)) for a, b in zip(cuts, cuts[1:]) if a < b]


def _arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list]:
    return rows[BOX].to_numpy(float), rows["confidence"].to_numpy(float), [None if pd.isna(k) else k for k in rows["kind"]]


def _passed(state: dict, now: int) -> int:
    frames = now - state.get("frame", now - 1)
    state.setdefault("tracks", [])
    state.setdefault("next", 1)
    state["frame"] = now
    return frames


def look_step(rules: LookRules, keys: list[str], frame: str) -> Step:
    """One frame by overlap, look and distance: every live track's box moves by its last velocity, then boxes are assigned at least total cost.

    A pair is out if its kinds differ (all people are one kind), if it is over
    reach apart without overlap, or unlike without overlap; without looks the
    look costs a half. Frames without detections move tracks on as well. A box
    is reported under its track from the track's min_hits-th sight on.
    """

    group = lambda k: "people" if k in PEOPLE else k

    def one(state: dict, now: int, box: np.ndarray, confidence: np.ndarray, kind: list, looks: list) -> tuple[list, list]:
        use = np.flatnonzero((confidence >= rules.min_confidence) & np.isfinite(box).all(axis=1))
        tracks = _advance(state.get("tracks", []), _passed(state, now), rules.max_age)
        ids, hits = [None] * len(box), [None] * len(box)
        free = dict.fromkeys(use.tolist())
        if tracks and len(use):
            own = np.array([t["box"] for t in tracks])
            shared, apart = overlaps(own, box[use]), distances(own, box[use])
            like = similarities([t["look"] for t in tracks], [looks[i] for i in use])
            cost = rules.overlap_weight * (1 - shared) + rules.look_weight * np.where(np.isnan(like), 0.5, 1 - np.clip(like, 0, 1)) + rules.distance_weight * np.minimum(1, apart / max(1.0, rules.reach))
            out = ((apart > rules.reach) & (shared <= 0.01)) | ((like < rules.min_similarity) & (shared <= 0.05))
            if rules.same_kind:
                out |= np.array([[group(t["kind"]) != group(kind[i]) for i in use] for t in tracks])
            for t, j in matched(np.where(out, NEVER, cost), rules.max_cost):
                i = int(use[j])
                _see(tracks[t], box[i], kind[i], looks[i], rules.keep)
                ids[i], hits[i] = tracks[t]["id"], tracks[t]["hits"]
                del free[i]
        for i in free:
            tracks.append({"id": state["next"], "box": box[i], "velocity": np.zeros(4), "unseen": 0, "hits": 1, "kind": kind[i], "look": looks[i]})
            ids[i], hits[i] = state["next"], 1
            state["next"] += 1
        state["tracks"] = tracks
        return [v if h is not None and h >= rules.min_hits else None for v, h in zip(ids, hits)], hits

    def step(state: dict, rows: pd.DataFrame) -> pd.DataFrame:
        box, confidence, kind = _arrays(rows)
        looks = [None if v is None or np.ndim(v) == 0 else np.asarray(v, float) for v in rows["look"]]
        got = [one(state, now, box[at], confidence[at], kind[at], looks[at]) for now, at in _frames(rows, frame)]
        flat = lambda k: pd.array([v for g in got for v in g[k]], dtype="Int64")
        return rows[[*keys, frame, "detection"]].assign(track_id=flat(0), hits=flat(1))

    return step


def stage_step(rules: StageRules, keys: list[str], frame: str) -> Step:
    """One frame in stages, by overlap with the tracks' boxes moved on.

    First sure detections meet all confirmed tracks, also lost ones, at 1 less
    the overlap weighted by confidence; then unsure ones meet the tracks of the
    frame before that are left; then sure ones left meet tracks not confirmed
    yet, which end if none fits. Sure ones left begin tracks. A track gets its
    id when it is confirmed: at min_hits sights in a row, at once in a
    recording's first frame.
    """

    def one(state: dict, now: int, box: np.ndarray, confidence: np.ndarray, kind: list) -> tuple[list, list]:
        first = "frame" not in state
        frames = _passed(state, now)
        tracks = _advance(state["tracks"], frames, rules.buffer)
        valid = np.isfinite(box).all(axis=1) & (confidence >= rules.floor)
        sure, unsure = np.flatnonzero(valid & (confidence >= rules.sure)).tolist(), np.flatnonzero(valid & (confidence < rules.sure)).tolist()
        ids, stage = [None] * len(box), [None] * len(box)

        def take(pool: list[dict], some: list[int], most: float, number: int, weighted: bool) -> None:
            shared = overlaps(np.array([t["box"] for t in pool]).reshape(-1, 4), box[some].reshape(-1, 4))
            pairs = matched(1 - (shared * confidence[some] if weighted else shared), most)
            for p, s in pairs:
                _see(pool[p], box[some[s]], kind[some[s]])
                if pool[p]["id"] is None and pool[p]["hits"] >= rules.min_hits:
                    pool[p]["id"], state["next"] = state["next"], state["next"] + 1
                ids[some[s]], stage[some[s]] = pool[p]["id"], number
            for s in sorted((s for _, s in pairs), reverse=True):
                del some[s]

        take([t for t in tracks if t["id"] is not None], sure, rules.most, 1, True)
        take([t for t in tracks if t["id"] is not None and t["unseen"] == 1], unsure, rules.most_unsure, 2, False)
        take([t for t in tracks if t["id"] is None and t["unseen"] == 1], sure, rules.most_new, 3, True)
        tracks = [t for t in tracks if t["id"] is not None or t["unseen"] == 0]
        for i in sure:
            if confidence[i] >= rules.sure + rules.lead:
                begun = {"id": None, "box": box[i], "velocity": np.zeros(4), "unseen": 0, "hits": 1, "kind": kind[i], "look": None}
                if first or rules.min_hits <= 1:
                    begun["id"], state["next"] = state["next"], state["next"] + 1
                tracks.append(begun)
                ids[i], stage[i] = begun["id"], 0
        state["tracks"] = tracks
        return ids, stage

    def step(state: dict, rows: pd.DataFrame) -> pd.DataFrame:
        box, confidence, kind = _arrays(rows)
        got = [one(state, now, box[at], confidence[at], kind[at]) for now, at in _frames(rows, frame)]
        flat = lambda k: pd.array([v for g in got for v in g[k]], dtype="Int64")
        return rows[[*keys, frame, "detection"]].assign(track_id=flat(0), stage=flat(1))

    return step


def detection_rows(df: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """What the steps read: keys, frame, detection, confidence, x1, y1, x2, y2, kind, look (null where df has none). Rows without a frame go."""
    look = F.col("look").cast("array<double>") if "look" in df.columns else F.lit(None).cast("array<double>")
    kind = F.col("kind") if "kind" in df.columns else F.lit(None).cast("string")
    whole = df.where(F.col(frame).isNotNull()).select(*keys, F.col(frame).cast("long").alias(frame), F.col("detection").cast("long").alias("detection"), *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in ("confidence", *BOX)], kind.alias("kind"), look.alias("look"))
    return whole


def output_schema(df: DataFrame, keys: list[str], frame: str, last: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", `{frame}` long, detection long, track_id long, {last} long"


def track_by_look(detections: DataFrame, keys: list[str], frame: str, rules: LookRules = LookRules()) -> DataFrame:
    """Per detection (keys, frame, detection): track_id, null until its track has min_hits sights or where it has none, and hits.

    detections: keys, frame, detection, confidence, x1, y1, x2, y2 and, if
    known, kind and look. One recording's frames are read as a sorted stream.
    Detections under min_confidence, or without a whole box, have no track.
    """
    rows = detection_rows(detections, keys, frame)
    return fold_ordered(rows, keys, [frame, "detection"], look_step(rules, keys, frame), output_schema(rows, keys, frame, "hits"), whole=[*keys, frame], many=True)


def track_in_stages(detections: DataFrame, cuts: DataFrame, keys: list[str], frame: str, rules: StageRules = StageRules()) -> DataFrame:
    """Per detection: scene_segment, raw_track_id (counted in its scene), track_id (counted on over scenes), stage.

    At a cut (keys, frame) all tracks end: a scene is a recording of its own,
    so scenes are followed side by side; ids then go on above the highest of
    the scenes before. stage says where the detection met its track: 1 to 3 as
    in stage_step, 0 began it.
    """
    marks = cuts.select(*keys, frame).distinct().withColumns({"score": F.lit(None).cast("double"), "type": F.lit(None).cast("string")})
    scenes = annotated(detection_rows(detections, keys, frame), marks, keys, frame).select(*keys, "scene_segment", frame, "detection", "confidence", *BOX, "kind", "look")
    by = [*keys, "scene_segment"]
    found = fold_ordered(scenes, by, [frame, "detection"], stage_step(rules, by, frame), output_schema(scenes, by, frame, "stage"), whole=[*by, frame], many=True)
    out = id_offsets(found.withColumnRenamed("track_id", "raw_track_id"), keys, "scene_segment", "raw_track_id")
    return out.select(*by, frame, "detection", "raw_track_id", F.col("new_id").alias("track_id"), "stage")


@dataclass(frozen=True)
class ObjectRules:
    """Limits of following one small object (defaults are those of the rules)."""

    frame_area: float = 1920.0 * 1080.0
    max_area: float = 0.0015
    size_penalty: float = 0.5
    acquire: float = 0.05
    reach: float = 120.0
    reach_cap: float = 120.0
    near: float = 30.0
    distance_penalty: float = 0.35
    reject_far: bool = True
    after_miss: float = 0.05
    forget: int = 12
    temporal: bool = True
    filtered: bool = True
    max_lost: int = 8
    process: float = 50.0
    measurement: float = 5.0
    fast: float = 30.0
    fast_area: float = 3.0


_MOVE = np.array([[1.0, 1.0, 0.5], [0.0, 1.0, 1.0], [0.0, 0.0, 1.0]])


def object_step(rules: ObjectRules, keys: list[str], frame: str) -> Step:
    """One frame of following an object: predict, gate and score by the prediction, select, update; the prediction stands in where nothing passes.

    While the filter's prediction is valid, a candidate is judged by its
    distance from it, else by that from the last one taken, if that is not
    forgotten. At speeds over fast the largest area is fast_area times as
    large. Frames without rows are run through as well, until all is forgotten.
    """

    def one(state: dict, now: int, box: np.ndarray, confidence: np.ndarray) -> tuple | None:
        predicted, speed = None, 0.0
        if rules.filtered and "mean" in state:
            before = state["mean"][0]
            state["mean"] = _MOVE @ state["mean"]
            state["cov"] = _MOVE @ state["cov"] @ _MOVE.T + rules.process * np.eye(3)
            state["lost"] += 1
            if state["lost"] <= rules.max_lost:
                predicted, speed = state["mean"][0], float(np.linalg.norm(state["mean"][0] - before))
        most = rules.max_area * (rules.fast_area if predicted is not None and speed > rules.fast else 1.0)
        since = now - state["frame"] if "frame" in state else 0
        recent = 0 < since <= rules.forget
        share = np.clip(box[:, 2:] - box[:, :2], 0, None).prod(axis=1) / rules.frame_area
        ok = share <= most
        if rules.temporal and not recent:
            ok &= confidence >= rules.acquire
        score, away, gap = confidence - rules.size_penalty * share / most, np.full(len(box), np.nan), None
        if predicted is not None or (rules.temporal and recent):
            centre, gap = (predicted, max(1, state["lost"])) if predicted is not None else (state["middle"], since)
            away = np.hypot(*((box[:, :2] + box[:, 2:]) / 2 - centre).T)
            limit = max(1.0, min(rules.reach * gap, rules.reach_cap) if rules.reach_cap > 0 else rules.reach * gap)
            part = away / np.where(confidence < rules.acquire, min(limit, max(1.0, rules.near)), limit)
            ok &= (gap == 1) | (confidence >= rules.after_miss)
            if rules.reject_far:
                ok &= part <= 1
            score = score - rules.distance_penalty * part
        if ok.any():
            best = int(np.where(ok, score, -np.inf).argmax())
            middle = (box[best, :2] + box[best, 2:]) / 2
            if "mean" in state:
                gain = state["cov"][:, 0] / (state["cov"][0, 0] + rules.measurement)
                state["mean"] = state["mean"] + np.outer(gain, middle - state["mean"][0])
                state["cov"] = state["cov"] - np.outer(gain, state["cov"][0])
            elif rules.filtered:
                state |= {"mean": np.array([middle, [0.0, 0.0], [0.0, 0.0]]), "cov": 100.0 * np.eye(3)}
            state |= {"frame": now, "middle": middle, "size": np.maximum(1.0, box[best, 2:] - box[best, :2]), "lost": 0}
            return best, box[best], confidence[best], score[best], None if np.isnan(away[best]) else away[best], gap, False, speed
        size = state.get("size")
        if "frame" in state and since > rules.forget:
            state.clear()
        if predicted is not None:
            return None, np.concatenate([predicted - size / 2, predicted + size / 2]), None, None, None, None, True, speed
        return None

    def step(state: dict, rows: pd.DataFrame) -> pd.DataFrame:
        boxes, confidences, ids, out = rows[BOX].to_numpy(float), rows["confidence"].to_numpy(float), rows["detection"].tolist(), []
        for now, part in _frames(rows, frame):
            at = state.pop("at", now - 1) + 1
            while at < now and "frame" in state:  # frames without rows
                out.append((at, one(state, at, np.zeros((0, 4)), np.zeros(0))))
                at += 1
            use = part.start + np.flatnonzero(np.isfinite(boxes[part]).all(axis=1) & np.isfinite(confidences[part]))
            got = one(state, now, boxes[use], confidences[use])
            out.append((now, got and ((None if got[0] is None else ids[use[got[0]]]), *got[1:])))
            state["at"] = now
        out = [(f, g) for f, g in out if g is not None]
        data = {k: rows[k].iloc[[0] * len(out)].reset_index(drop=True) for k in keys} | {frame: [f for f, _ in out], "detection": pd.array([g[0] for _, g in out], dtype="Int64")}
        data |= {c: [g[1][i] for _, g in out] for i, c in enumerate(BOX)}
        data |= {c: np.array([g[i] for _, g in out], float) for i, c in ((2, "confidence"), (3, "score"), (4, "moved"))}  # None becomes NaN, which is null in Spark
        return pd.DataFrame(data | {"gap": pd.array([g[5] for _, g in out], dtype="Int64"), "predicted": [g[6] for _, g in out], "speed": [g[7] for _, g in out]})

    return step


def follow_object(candidates: DataFrame, keys: list[str], frame: str, rules: ObjectRules = ObjectRules()) -> DataFrame:
    """At most one row for each frame: the candidate taken, or the filter's prediction where none passes.

    candidates: keys (recording, scene), frame, detection, confidence, x1, y1,
    x2, y2; rows with nulls beside a frame stand for a frame without candidates.
    Result: keys, frame, detection (null if predicted), the box, confidence,
    score, moved and gap (from what it was judged by), predicted, speed.
    """
    rows = detection_rows(candidates, keys, frame).select(*keys, frame, "detection", "confidence", *BOX)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", `{frame}` long, detection long, x1 double, y1 double, x2 double, y2 double, confidence double, score double, moved double, gap long, predicted boolean, speed double"
    return fold_ordered(rows, keys, [frame, "detection"], object_step(rules, keys, frame), schema, whole=[*keys, frame], many=True)
