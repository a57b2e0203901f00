"""Trackers and the gated object loop against plain Python, over tables and over streams."""

import itertools
import math
import tempfile
import time

import numpy as np
import pytest

from trackweave.operators import tracking as T
from trackweave.streaming.folds import fold_stream

DETECTIONS = "video string, frame long, detection long, confidence double, x1 double, y1 double, x2 double, y2 double, kind string, look array<double>"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    union = sum(max(0, r[2] - r[0]) * max(0, r[3] - r[1]) for r in (a, b)) - both
    return both / union if union > 0 else 0


def apart(a, b):
    return math.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)


def best_pairs(cost, most):
    """By trying every assignment."""
    n, m = len(cost), len(cost[0]) if cost else 0
    if not n or not m:
        return []
    if n <= m:
        options = [list(zip(range(n), p)) for p in itertools.permutations(range(m), n)]
    else:
        options = [list(zip(p, range(m))) for p in itertools.permutations(range(n), m)]
    best = min(options, key=lambda o: sum(cost[i][j] for i, j in o))
    return [(i, j) for i, j in best if cost[i][j] <= most]


def plain_look(rows, rules):
    """rows of one video; every frame from the first to the last is run, also empty ones."""
    out, tracks, n = {}, [], 1
    for frame in range(min(r[1] for r in rows), max(r[1] for r in rows) + 1):
        for t in tracks:
            t["box"] = [b + v for b, v in zip(t["box"], t["v"])]
            t["unseen"] += 1
        tracks = [t for t in tracks if t["unseen"] <= rules.max_age]
        here = sorted((r for r in rows if r[1] == frame), key=lambda r: r[2])
        out |= {(frame, r[2]): (None, None) for r in here}
        here = [r for r in here if r[3] is not None and r[3] >= rules.min_confidence and None not in r[4:8]]
        cost = []
        for t in tracks:
            line = []
            for r in here:
                shared, away = iou(t["box"], r[4:8]), apart(t["box"], r[4:8])
                like = None
                if t["look"] is not None and r[9] is not None:
                    like = np.dot(t["look"], r[9]) / np.linalg.norm(t["look"]) / np.linalg.norm(r[9])
                c = rules.overlap_weight * (1 - shared) + rules.look_weight * (0.5 if like is None else 1 - min(1, max(0, like))) + rules.distance_weight * min(1, away / rules.reach)
                people = ("person", "player", "goalkeeper")
                if away > rules.reach and shared <= 0.01 or like is not None and like < rules.min_similarity and shared <= 0.05 or not (t["kind"] == r[8] or t["kind"] in people and r[8] in people):
                    c = 1e6
                line.append(c)
            cost.append(line)
        pairs = best_pairs(cost, rules.max_cost)
        for i, j in pairs:
            t, r = tracks[i], here[j]
            t |= {"v": [b - a for a, b in zip(t["box"], r[4:8])], "box": list(r[4:8]), "unseen": 0, "hits": t["hits"] + 1, "kind": r[8]}
            if r[9] is not None:
                mix = rules.keep * np.array(t["look"]) + (1 - rules.keep) * np.array(r[9]) if t["look"] is not None else np.array(r[9])
                t["look"] = mix / np.linalg.norm(mix) if t["look"] is not None else mix
            out[frame, r[2]] = (t["id"] if t["hits"] >= rules.min_hits else None, t["hits"])
        for j, r in enumerate(here):
            if j not in {j for _, j in pairs}:
                tracks.append({"id": n, "box": list(r[4:8]), "v": [0] * 4, "unseen": 0, "hits": 1, "kind": r[8], "look": r[9]})
                out[frame, r[2]] = (n if rules.min_hits <= 1 else None, 1)
                n += 1
    return out


def moving(seed, videos=("a", "b"), frames=30, objects=4):
    rng = np.random.default_rng(seed)
    rows = []
    for video in videos:
        place, step = rng.uniform(0, 300, (objects, 2)), rng.normal(0, 6, (objects, 2))
        looks = rng.normal(size=(objects, 4))
        for frame in range(frames):
            if frame % 11 == 7:
                continue
            for i in rng.permutation(objects).tolist():
                x, y = (place[i] + frame * step[i] + rng.normal(0, 1.5, 2)).tolist()
                if rng.random() < 0.8:
                    confidence = None if rng.random() < 0.02 else float(rng.choice([0.05, 0.15, 0.3, 0.5, 0.9]))
                    look = None if rng.random() < 0.3 else [float(v) for v in looks[i] + rng.normal(0, 0.2, 4)]
                    rows.append((video, frame, i, confidence, x, y, x + 20, y + 40, ["player", "person", "referee", None][i], look))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_track_by_look(spark, seed):
    rows = moving(seed)
    rules = T.LookRules(max_age=4, reach=60.0)
    got = T.track_by_look(spark.createDataFrame(rows, DETECTIONS).repartition(5), ["video"], "frame", rules).collect()
    assert len(got) == len(rows)
    for video in "ab":
        want = plain_look([r for r in rows if r[0] == video], rules)
        assert {(r["frame"], r["detection"]): (r["track_id"], r["hits"]) for r in got if r["video"] == video} == want
        assert len({v[0] for v in want.values()}) > 4


def test_looks_keep_identities_where_boxes_cross(spark):
    rules = T.LookRules(max_age=5, min_hits=1, reach=80.0, max_cost=0.9, overlap_weight=0.2, look_weight=0.7, distance_weight=0.1, min_similarity=0.0)
    rows = [("v", 1, 1, 0.9, 0.0, 0.0, 20.0, 40.0, "person", [1.0, 0.0]), ("v", 1, 2, 0.9, 80.0, 0.0, 100.0, 40.0, "person", [0.0, 1.0])]
    rows += [("v", 2, 1, 0.9, 76.0, 0.0, 96.0, 40.0, "person", [1.0, 0.0]), ("v", 2, 2, 0.9, 4.0, 0.0, 24.0, 40.0, "person", [0.0, 1.0])]
    got = {(r["frame"], r["detection"]): r["track_id"] for r in T.track_by_look(spark.createDataFrame(rows, DETECTIONS), ["video"], "frame", rules).collect()}
    assert got[1, 1] == got[2, 1] and got[1, 2] == got[2, 2] and got[1, 1] != got[1, 2]


def plain_stages(rows, rules):
    out, tracks, n = {}, [], 1
    first = min(r[1] for r in rows)
    for frame in range(first, max(r[1] for r in rows) + 1):
        for t in tracks:
            t["box"] = [b + v for b, v in zip(t["box"], t["v"])]
            t["unseen"] += 1
        tracks = [t for t in tracks if t["unseen"] <= rules.buffer]
        here = sorted((r for r in rows if r[1] == frame), key=lambda r: r[2])
        if not here:
            continue
        out |= {(frame, r[2]): (None, None) for r in here}
        here = [r for r in here if r[3] is not None and r[3] >= rules.floor]
        sure, unsure = [r for r in here if r[3] >= rules.sure], [r for r in here if r[3] < rules.sure]
        for number in (1, 2, 3):
            pool = [t for t in tracks if (t["id"] is None) == (number == 3) and (number == 1 or t["unseen"] == 1)]
            some, most = (unsure, rules.most_unsure) if number == 2 else (sure, rules.most if number == 1 else rules.most_new)
            pairs = best_pairs([[1 - iou(t["box"], r[4:8]) * (1 if number == 2 else r[3]) for r in some] for t in pool], most)
            for i, j in sorted(pairs):
                t, r = pool[i], some[j]
                t |= {"v": [b - a for a, b in zip(t["box"], r[4:8])], "box": list(r[4:8]), "unseen": 0, "hits": t["hits"] + 1}
                if t["id"] is None and t["hits"] >= rules.min_hits:
                    t["id"], n = n, n + 1
                out[frame, r[2]] = (t["id"], number)
            some[:] = [r for j, r in enumerate(some) if j not in {j for _, j in pairs}]
        tracks = [t for t in tracks if t["id"] is not None or t["unseen"] == 0]
        for r in sure:
            if r[3] >= rules.sure + rules.lead:
                t = {"id": None, "box": list(r[4:8]), "v": [0] * 4, "unseen": 0, "hits": 1}
                if frame == first or rules.min_hits <= 1:
                    t["id"], n = n, n + 1
                tracks.append(t)
                out[frame, r[2]] = (t["id"], 0)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_track_in_stages(spark, seed):
    rows, rules = moving(seed), T.StageRules(buffer=4)
    cuts = [("a", 13), ("b", 5), ("b", 21), ("b", 0), ("c", 3)]
    got = T.track_in_stages(spark.createDataFrame(rows, DETECTIONS).repartition(5), spark.createDataFrame(cuts, "video string, frame long"), ["video"], "frame", rules).collect()
    assert len(got) == len(rows)
    for video in "ab":
        offset, last = 0, -1
        for scene, cut in enumerate([*sorted(f for v, f in cuts if v == video and f > 0), 99]):
            part = [r for r in rows if r[0] == video and last < r[1] < cut]
            want = plain_stages(part, rules)
            mine = [r for r in got if r["video"] == video and r["scene_segment"] == scene]
            assert {(r["frame"], r["detection"]): (r["raw_track_id"], r["stage"]) for r in mine} == want
            assert all(r["track_id"] == (None if r["raw_track_id"] is None else r["raw_track_id"] + offset) for r in mine)
            offset, last = offset + max(v[0] or 0 for v in want.values()), cut - 1
    assert {1, 2, 3, 0} <= {r["stage"] for r in got}


def test_stages_in_words(spark):
    """A track that is hidden for two frames goes on, an unsure box keeps its track, a cut ends all."""
    def box(x):
        return (float(x), 0.0, x + 20.0, 40.0)

    seen = [(0, 1, 0.9, 0), (0, 2, 0.9, 100), (1, 1, 0.9, 2), (1, 2, 0.15, 101), (4, 1, 0.9, 8), (4, 2, 0.15, 104), (5, 1, 0.9, 10), (5, 3, 0.15, 300), (6, 1, 0.9, 12), (6, 2, 0.9, 200), (7, 2, 0.9, 200)]
    df = spark.createDataFrame([("v", f, d, c, *box(x), "player", None) for f, d, c, x in seen], DETECTIONS)
    got = {(r["frame"], r["detection"]): (r["track_id"], r["stage"]) for r in T.track_in_stages(df, spark.createDataFrame([("v", 6)], "video string, frame long"), ["video"], "frame").collect()}
    assert got[0, 1] == (1, 0) and got[1, 1] == (1, 1) and got[1, 2] == (2, 2)
    assert got[4, 1] == (1, 1) and got[4, 2] == (None, None)  # lost tracks are looked for among sure boxes only
    assert got[5, 1] == (1, 1) and got[5, 3] == (None, None)
    assert got[6, 1] == (3, 0) and got[6, 2] == (4, 0) and got[7, 2] == (4, 1)


def plain_object(rows, rules):
    """The loop with 6 by 6 matrices, frame by frame."""
    move, look = np.eye(6), np.eye(2, 6)
    for i in range(4):
        move[i, i + 2] = 1
    move[0, 4] = move[1, 5] = 0.5
    x, cov, lost, last, size, centre, out = None, 100 * np.eye(6), 0, None, None, None, {}
    for frame in range(min(r[1] for r in rows), max(r[1] for r in rows) + 1):
        guess, speed = None, 0.0
        if rules.filtered and size is not None and x is not None:
            before = x[:2]
            x, cov, lost = move @ x, move @ cov @ move.T + rules.process * np.eye(6), lost + 1
            if lost <= rules.max_lost:
                guess, speed = x[:2], np.linalg.norm(x[:2] - before)
        most = rules.max_area * (rules.fast_area if guess is not None and speed > rules.fast else 1)
        recent = last is not None and 0 < frame - last <= rules.forget
        best = None
        for r in sorted((r for r in rows if r[1] == frame and None not in r[3:8]), key=lambda r: r[2]):
            share = max(0, r[6] - r[4]) * max(0, r[7] - r[5]) / rules.frame_area
            if share > most or rules.temporal and not recent and r[3] < rules.acquire:
                continue
            score, away, gap = r[3] - rules.size_penalty * share / most, None, None
            if guess is not None or rules.temporal and recent:
                from_, gap = (guess, max(1, lost)) if guess is not None else (centre, frame - last)
                away = math.hypot((r[4] + r[6]) / 2 - from_[0], (r[5] + r[7]) / 2 - from_[1])
                limit = max(1.0, min(rules.reach * gap, rules.reach_cap))
                if r[3] < rules.acquire:
                    limit = min(limit, max(1.0, rules.near))
                if rules.reject_far and away > limit or gap > 1 and r[3] < rules.after_miss:
                    continue
                score -= rules.distance_penalty * away / limit
            if best is None or score > best[0]:
                best = (score, r, away, gap)
        if best:
            r = best[1]
            z = np.array([(r[4] + r[6]) / 2, (r[5] + r[7]) / 2])
            if rules.filtered and x is not None:
                gain = cov @ look.T @ np.linalg.inv(look @ cov @ look.T + rules.measurement * np.eye(2))
                x, cov = x + gain @ (z - look @ x), (np.eye(6) - gain @ look) @ cov
            elif rules.filtered:
                x = np.array([*z, 0, 0, 0, 0])
            last, size, centre, lost = frame, (max(1, r[6] - r[4]), max(1, r[7] - r[5])), z, 0
            out[frame] = (r[2], r[4:8], best[0], best[2], best[3], speed)
            continue
        if last is not None and frame - last > rules.forget:
            x, cov, lost, last, centre = None, 100 * np.eye(6), 0, None, None
        if guess is not None:
            out[frame] = (None, (guess[0] - size[0] / 2, guess[1] - size[1] / 2, guess[0] + size[0] / 2, guess[1] + size[1] / 2), None, None, None, speed)
        if last is None:
            size = None
    return out


def balls(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for video in ("a", "b", "c"):
        for frame in range(120):
            if frame % 31 > 22 or 60 < frame < 66:
                continue
            x, y = 300 + 4 * frame + 200 * (frame > 80), 200 + 100 * math.sin(frame / 6)
            spots = [(x, y, rng.choice([0.02, 0.08, 0.5]), rng.choice([10, 10, 30]))] if rng.random() < 0.8 else []
            spots += [(*rng.uniform(0, 900, 2), float(rng.choice([0.03, 0.2, 0.7])), 12)] if rng.random() < 0.5 else []
            rows += [(video, frame, i, float(c), float(a), float(b), float(a + s), float(b + s)) for i, (a, b, c, s) in enumerate(spots)]
            if not spots:
                rows.append((video, frame, None, None, None, None, None, None))
    return rows


@pytest.mark.parametrize("options", [{}, {"filtered": False}, {"temporal": False}, {"reject_far": False, "forget": 3}, {"max_lost": 2, "acquire": 0.1, "fast": 5.0}])
def test_follow_object(spark, options):
    rules, rows = T.ObjectRules(**{"frame_area": 1e5, "reach": 60.0, "reach_cap": 100.0, "max_area": 0.0015} | options), balls(4)
    df = spark.createDataFrame(rows, DETECTIONS.split(", kind")[0])
    got = T.follow_object(df, ["video"], "frame", rules).collect()
    for video in "abc":
        want = plain_object([r for r in rows if r[0] == video], rules)
        mine = {r["frame"]: r for r in got if r["video"] == video}
        assert set(mine) == set(want)
        for f, (detection, box, score, away, gap, speed) in want.items():
            r = mine[f]
            assert (r["detection"], r["gap"], r["predicted"]) == (detection, gap, detection is None)
            assert [r["x1"], r["y1"], r["x2"], r["y2"], r["speed"]] == pytest.approx([*box, speed], abs=1e-6)
            assert (r["score"], r["moved"]) == (pytest.approx(score) if score is not None else None, pytest.approx(away) if away is not None else None)
    if options.get("filtered", True):
        assert any(r["predicted"] for r in got) and any(not r["predicted"] and r["moved"] is not None for r in got)


def test_object_gates(spark):
    """At speed a larger box passes; a near weak candidate beats a far strong one."""
    rules = T.ObjectRules(frame_area=1e6, max_area=0.01, size_penalty=0.0, reach=60.0, reach_cap=60.0, distance_penalty=0.5)

    def taken(last, **more):
        rows = [("v", f, 1, 0.4, 40.0 * f, 0.0, 40.0 * f + 12, 12.0) for f in range(1, 10)] + last
        out = T.follow_object(spark.createDataFrame(rows, DETECTIONS.split(", kind")[0]), ["video"], "frame", T.ObjectRules(**{**rules.__dict__, **more})).collect()
        return {r["frame"]: r["detection"] for r in out}[10]

    blur = [("v", 10, 5, 0.4, 346.0, -54.0, 466.0, 66.0)]
    assert taken(blur) == 5 and taken(blur, fast=1e9) is None
    assert taken([("v", 10, 1, 0.2, 400.0, 0.0, 412.0, 12.0), ("v", 10, 2, 0.8, 900.0, 390.0, 920.0, 410.0)]) == 1


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, old)


def started(spark, folder, rules, idle_ms, **trigger):
    source = T.detection_rows(spark.readStream.schema(DETECTIONS).parquet(f"{folder}/in"), ["video"], "frame")
    step = T.look_step(rules, ["video"], "frame")
    out = fold_stream(source, ["video"], "frame", ["detection"], step, T.output_schema(source, ["video"], "frame", "hits"), idle_ms=idle_ms)
    return out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(**trigger).start()


def written_rows(spark, folder):
    return {(r["video"], r["frame"], r["detection"]): (r["track_id"], r["hits"]) for r in spark.read.parquet(f"{folder}/out").collect()}


def test_stream_equals_table_after_restarts(spark, rocks):
    rows, rules, folder = moving(5), T.LookRules(max_age=4, reach=60.0), tempfile.mkdtemp()
    want = {(r["video"], r["frame"], r["detection"]): (r["track_id"], r["hits"]) for r in T.track_by_look(spark.createDataFrame(rows, DETECTIONS), ["video"], "frame", rules).collect()}
    for low, high in ((0, 9), (9, 10), (10, 99)):  # three queries, each going on from the checkpoint
        spark.createDataFrame([r for r in rows if low <= r[1] < high], DETECTIONS).write.mode("append").parquet(f"{folder}/in")
        assert started(spark, folder, rules, None, availableNow=True).awaitTermination(60)
    assert written_rows(spark, folder) == {k: v for k, v in want.items() if k[1] < 28}  # the last frame may still get rows


def test_idle_keys_end(spark, rocks):
    rows, rules, folder = moving(6, frames=6), T.LookRules(max_age=4, reach=60.0), tempfile.mkdtemp()
    want = {(r["video"], r["frame"], r["detection"]): (r["track_id"], r["hits"]) for r in T.track_by_look(spark.createDataFrame(rows, DETECTIONS), ["video"], "frame", rules).collect()}
    spark.createDataFrame(rows, DETECTIONS).write.parquet(f"{folder}/in")
    query, got = started(spark, folder, rules, 2000, processingTime="1 second"), {}
    for _ in range(40):
        time.sleep(1)
        try:
            got = written_rows(spark, folder)
        except Exception:  # nothing is written yet
            continue
        if len(got) == len(want):
            break
    query.stop()
    assert got == want  # what idle keys held was handed on
