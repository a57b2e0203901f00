"""Ordered folds against plain brute force."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.operators import stateful as SF
from trackweave.operators import vectors as V


def test_kalman_matches_matrices_and_expires(spark):
    rng = np.random.default_rng(3)
    rows = [(k, t, None, None) if t < 2 or rng.random() < 0.4 else (k, t, float(rng.normal(3 * t, 2)), float(rng.normal(-t, 2))) for k in ("a", "b", None) for t in range(25)]
    df = spark.createDataFrame(rows, "k string, t int, x double, y double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a key's rows come in several batches
    got = {(r["k"], r["t"]): r for r in SF.kalman_positions(df, ["k"], "t", "x", "y", max_lost=1).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    move, look = np.eye(6), np.eye(2, 6)
    for i in range(4):
        move[i, i + 2] = 1
    move[0, 4] = move[1, 5] = 0.5
    for key in ("a", "b", None):
        mean, lost = None, 0
        for _, t, x, y in (r for r in rows if r[0] == key):
            if mean is not None:
                mean, cov, lost = move @ mean, move @ cov @ move.T + 50 * np.eye(6), lost + 1
            if x is not None and mean is None:
                mean, cov, lost = np.array([x, y, 0, 0, 0, 0]), 100 * np.eye(6), 0
            elif x is not None:
                gain = cov @ look.T @ np.linalg.inv(look @ cov @ look.T + 5 * np.eye(2))
                mean, cov, lost = mean + gain @ (np.array([x, y]) - look @ mean), (np.eye(6) - gain @ look) @ cov, 0
            r = got[key, t]
            if mean is None:
                assert r["filter_x"] is None and r["lost"] is None and not r["valid"] and not r["predicted"]
            else:
                assert np.allclose([r["filter_x"], r["filter_y"]], mean[:2]) and (r["lost"], r["valid"], r["predicted"]) == (lost, lost <= 1, lost > 0)


def test_selection_gates(spark):
    rows = [
        ("v", 1, 1, 0.3, 0.0, 0.0, 4.0, 4.0),  # too weak to begin with
        ("v", 2, 1, 0.8, 0.0, 0.0, 4.0, 4.0), ("v", 2, 2, 0.9, 0.0, 0.0, 90.0, 90.0),  # the second is too large
        ("v", 3, 1, 0.9, 200.0, 0.0, 204.0, 4.0), ("v", 3, 2, 0.2, 6.0, 0.0, 10.0, 4.0),  # near and weak beats far
        ("v", 5, 1, 0.1, 6.0, 0.0, 10.0, 4.0),  # too weak after a miss
        ("v", 6, 1, None, 6.0, 0.0, 10.0, 4.0),
        ("v", 20, 1, 0.4, 6.0, 0.0, 10.0, 4.0), ("v", 20, 2, 0.6, 500.0, 0.0, 504.0, 4.0),  # forgotten: begin anew
        ("w", 21, 1, 0.2, 500.0, 0.0, 504.0, 4.0),
    ]
    df = spark.createDataFrame(rows, "k string, frame int, candidate int, confidence double, x1 double, y1 double, x2 double, y2 double")
    pick = dict(frame_area=1e4, max_area=0.1, size_penalty=0.1, acquire=0.5, reach=50, reach_cap=100, near=20, distance_penalty=0.2, after_miss=0.15, forget=5)
    got = {(r["k"], r["frame"]): r for r in SF.select_object(df, ["k"], "frame", **pick).collect()}
    assert {k: r["candidate"] for k, r in got.items()} == {("v", 2): 1, ("v", 3): 2, ("v", 20): 2}
    assert got["v", 2]["moved"] is None and got["v", 3]["moved"] == 6 and got["v", 3]["gap"] == 1
    assert math.isclose(got["v", 3]["score"], 0.2 - 0.1 * 0.0016 / 0.1 - 0.2 * 6 / 20)
    assert SF.select_object(df.limit(0), ["k"], "frame", **pick).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_links_match_greedy(spark, seed):
    rng = np.random.default_rng(seed)
    spans = []
    for i in range(60):
        start = int(rng.integers(0, 300))
        xs = [float(v) for v in rng.integers(0, 60, 4)]
        spans.append((["a", "b"][i % 2], i, start, start + int(rng.integers(0, 40)), *xs, int(rng.integers(1, 3)), float(rng.random()), None if i % 5 == 0 else [float(v) for v in rng.normal(1, 1, 3)]))
    names = ["v", "id", "start", "end", "first_x", "first_y", "last_x", "last_y", "team", "team_confidence", "look"]
    df = spark.createDataFrame(spans, "v string, id long, start long, end long, first_x double, first_y double, last_x double, last_y double, team int, team_confidence double, look array<double>")
    got = {(r["v"], r["id"]): (r["cluster"], r["follows"]) for r in SF.link_spans(df, SF.link_candidates(df, "v", max_gap=30, max_distance=40, same_team=SF.teams_agree(), min_cosine=0.5), "v", max_gap=30).collect()}
    want = {}
    for v in ("a", "b"):
        own = sorted((dict(zip(names, s)) for s in spans if s[0] == v), key=lambda s: (s["start"], s["id"]))
        cluster = {}
        for n, c in enumerate(own):
            best = None
            for p in own[:n]:
                gap, away = c["start"] - p["end"], math.hypot(c["first_x"] - p["last_x"], c["first_y"] - p["last_y"])
                meets = any(cluster[q["id"]] == cluster[p["id"]] and q["start"] <= c["end"] and q["end"] >= c["start"] for q in own[:n])
                against = p["team"] != c["team"] and min(p["team_confidence"], c["team_confidence"]) >= 0.65
                alike = p["look"] is None or c["look"] is None or np.dot(p["look"], c["look"]) / np.linalg.norm(p["look"]) / np.linalg.norm(c["look"]) >= 0.5
                if 0 < gap <= 30 and not meets and away <= 40 and not against and alike and (best is None or (away + gap / 2, p["id"]) < best):
                    best = (away + gap / 2, p["id"])
            cluster[c["id"]] = cluster[best[1]] if best else c["id"]
            want[v, c["id"]] = (cluster[c["id"]], best[1] if best else None)
    assert got == want and sum(f is not None for _, f in got.values()) > 10


def test_spans_whose_frames_interleave_are_one_cluster(spark):
    frames = {1: [0, 1], 2: [10, 11, 20, 21], 3: [15, 16, 25], 4: [16, 17]}
    rows = spark.createDataFrame([("v", i, f) for i, fs in frames.items() for f in fs], "v string, id long, frame long")
    ends = spark.createDataFrame([("v", i, min(fs), max(fs)) for i, fs in frames.items()], "v string, id long, start long, end long")
    offers = spark.createDataFrame([("v", 1, 2, 1.0), ("v", 1, 3, 1.0), ("v", 1, 4, 1.0)], "v string, source long, target long, score double")
    of = lambda spans: {r["id"]: r["cluster"] for r in SF.link_spans(spans, offers, "v", max_gap=100).collect()}
    assert of(ends.join(SF.frame_ranges(rows, ["v", "id"], "frame"), ["v", "id"])) == {1: 1, 2: 1, 3: 1, 4: 4}
    assert of(ends) == {1: 1, 2: 1, 3: 3, 4: 4}  # without their frames spans have all between their ends


def test_frame_sets():
    rng = np.random.default_rng(8)
    for _ in range(200):
        whole, runs = set(), SF.FrameSet()
        for _ in range(12):
            new = set(rng.integers(0, 60, rng.integers(1, 9)).tolist())
            cut = sorted(f for f in new if f - 1 not in new)
            ranges = [(f, next(g for g in range(f, 99) if g + 1 not in new)) for f in cut]
            assert runs.meets(ranges) == bool(whole & new)
            runs.add(ranges)
            whole |= new
            assert {f for a, b in zip(runs.first, runs.last) for f in range(a, b + 1)} == whole and all(b + 1 < a for b, a in zip(runs.last, runs.first[1:]))


def test_mean_and_nearest_vectors(spark):
    df = spark.createDataFrame([(1, "a", [3.0, 0.0]), (2, "a", [5.0, 0.0]), (3, "b", [0.0, 2.0]), (4, "c", [1.0, 0.0]), (5, "c", [-1.0, 0.0]), (6, None, None), (7, "b", [0.0, 0.0])], "id int, k string, v array<double>")
    means = V.mean_vectors(df, "k", "v")
    assert {r["k"]: r["vector"] for r in means.collect()} == {"a": [1.0, 0.0], "b": [0.0, 1.0]}
    got = {r["id"]: (r["k"], round(r["similarity"], 6), round(r["margin"], 6)) for r in V.nearest_vector(df, "id", "v", means, "k").collect()}
    assert got[1] == ("a", 1.0, 1.0) and got[3][0] == "b" and got[5] == ("b", 0.0, 1.0) and 6 not in got and got[7][0] == "a"
    one = V.nearest_vector(df, "id", "v", means.where("k = 'b'"), "k").collect()
    assert len(one) == 6 and all(r["margin"] == r["similarity"] for r in one)
    assert V.nearest_vector(df, "id", "v", means.where("false"), "k").count() == 0


def test_select_object_takes_many_frames_in_a_call(spark):
    """A table of its own for each frame took a millisecond and more of them; 60,000 frames of one key."""
    n = 60_000
    df = spark.range(n, numPartitions=1).selectExpr("0L AS video", "id AS at", "id AS candidate", "0.5D AS confidence", "1.0D * id AS x1", "0.0D AS y1", "1.0D * id + 8 AS x2", "8.0D AS y2")
    rules = dict(frame_area=1e6, max_area=0.001, size_penalty=0.2, acquire=0.1, reach=60, reach_cap=300, near=40, distance_penalty=0.3, after_miss=0.05, forget=12)
    started = time.time()
    got = SF.select_object(df, ["video"], "at", **rules).agg(F.count("*"), F.sum("moved"), F.sum("gap")).first()
    assert tuple(got) == (n, n - 1.0, n - 1) and time.time() - started < 30
