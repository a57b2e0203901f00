"""Operators on small cases with known answers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.functions import scalars as S
from trackweave.operators import aggregates as A
from trackweave.operators import identity as I
from trackweave.operators import joins as J
from trackweave.operators import windows as W
from trackweave.sources import tables
from trackweave.streaming import windows as ST


def test_parse_number(spark):
    df = spark.createDataFrame([("1",), ("00",), ("0",), ("A17",), ("171",), (None,)], "t string")
    assert [r[0] for r in df.select(S.parse_number(F.col("t"))).collect()] == [1, None, None, 17, 17, None]


def test_geometry(spark):
    df = spark.createDataFrame([((0.0, 0.0, 2.0, 2.0), (1.0, 1.0, 3.0, 3.0)), ((0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0))], "a struct<x1:double,y1:double,x2:double,y2:double>, b struct<x1:double,y1:double,x2:double,y2:double>")
    assert [r[0] for r in df.select(S.iou(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 7), 0.0]
    centred = F.array(*(F.lit(float(v)) for v in (1, 0, 52.5, 0, 1, 34, 0, 0, 1)))
    assert tuple(spark.range(1).select(S.project(centred, F.lit(0.0), F.lit(0.0)).alias("p")).first()["p"]) == (52.5, 34.0)


def test_mode_takes_first_seen(spark):
    df = spark.createDataFrame([(1, 0, 7), (1, 1, 3), (1, 2, 3), (1, 3, 7), (1, 4, None)], "k int, frame int, v int")
    assert [tuple(r) for r in A.mode_first_seen(df, ["k"], "v", "frame").collect()] == [(1, 7, 2)]


def test_vote(spark):
    df = spark.createDataFrame([(1, 7, 0.01), (1, 9, 0.7), (1, 9, 0.6)], "k int, n int, c double")
    r = A.weighted_vote(df, ["k"], number="n", confidence="c").first()
    assert r["winner"] == 9 and r["votes"] == 2 and r["margin"] > 0 and r["share"] > 0.5


def test_crop_collapse(spark):
    df = spark.createDataFrame([("a", 38, 0.9), ("a", 38, 0.8), ("a", 8, 0.2), ("b", 38, 0.7)], "crop string, n int, c double")
    assert sorted((r["crop"], r["n"], r["observations"]) for r in A.crop_collapse(df, ["crop"], number="n", confidence="c").collect()) == [("a", 38, 2), ("b", 38, 1)]


def test_conflict_islands_bridge(spark):
    conflict = {0: 2, 1: 2, 4: 2, 5: 2, 6: 2, 7: 2}
    df = spark.createDataFrame([(1, f, conflict.get(f)) for f in range(8)], "k int, frame int, team int")
    r = W.conflict_islands(df, ["k"], "frame", "team", max_gap=2, min_rows=2).collect()
    assert [(x["first"], x["last"], x["bridges"]) for x in r] == [(0, 7, 2)]


def test_interpolation_and_refractory(spark):
    df = spark.createDataFrame([(1, 0, 10.0), (1, 1, None), (1, 2, 20.0), (1, 3, None)], "k int, frame long, v double")
    assert [r["filled"] for r in W.interpolate(df, ["k"], "frame", "v", "frame").orderBy("frame").collect()] == [10.0, 15.0, 20.0, 20.0]
    hits = spark.createDataFrame([(1, f, 1.0) for f in (0, 2, 5, 6, 11)], "k int, frame long, s double")
    assert sorted(r["frame"] for r in W.refractory(hits, ["k"], "frame", F.col("s"), 0.5, 5).collect()) == [0, 5, 11]


def test_nearest_tie_goes_to_earlier(spark):
    anchors = spark.createDataFrame([(1, 0, "a"), (1, 10, "b")], "k int, frame long, v string")
    rows = spark.createDataFrame([(1, f) for f in (4, 5, 8, 16)], "k int, frame long")
    got = {r["frame"]: r["nearest_value"] for r in J.nearest(rows, anchors, ["k"], "frame", "v", 5).collect()}
    assert got == {4: "a", 5: "a", 8: "b", 16: None}


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for shape in ((1, 1), (3, 5), (5, 3), (6, 6)):
        cost = rng.random(shape)
        r, c = J.least_cost_assignment(cost)
        small = cost if shape[0] <= shape[1] else cost.T
        best = min(sum(small[i, p[i]] for i in range(small.shape[0])) for p in permutations(range(small.shape[1]), small.shape[0]))
        assert cost[r, c].sum() == pytest.approx(best) and len(set(r)) == len(set(c)) == min(shape)


def test_propagation_and_candidates(spark):
    nodes = spark.createDataFrame([(1, "p"), (2, None), (3, None), (4, "q")], "node int, player_id string")
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (4, 3, 0.78)], "source int, target int, score double")
    one = {r["node"]: r["player_id"] for r in I.propagate(nodes, edges, min_score=0.5, min_margin=0.05).collect()}
    assert one == {1: "p", 2: "p", 3: "q", 4: "q"}
    costs = spark.createDataFrame([(10, "a", 0.1), (20, "a", 0.0), (30, "b", 0.2), (30, "c", 0.6)], "track_id int, player_id string, cost double")
    got = {r["track_id"]: r["rejection"] for r in I.identity_candidates(costs, spark.createDataFrame([(10,)], "track_id int"), max_cost=0.5, min_margin=0.1, max_spread=2).collect()}
    assert got == {20: "cost", 30: None}


def test_constraints_clear_weaker_rows(spark):
    rows = spark.createDataFrame([(0, 0, 1, 1, 1, "a", 0.9), (1, 0, 2, 1, 1, "a", 0.5), (2, 1, 3, 1, 96, "b", 0.9)], "frame int, slot int, track_id int, team_id int, jersey_number int, player_id string, confidence double")
    roster = spark.createDataFrame([("a", 1, 1)], "player_id string, team_id int, jersey_number int")
    got = {r["frame"]: (r["jersey_number"], r["player_id"]) for r in I.constraint_chain(rows, roster, ["slot"]).collect()}
    assert got == {0: (1, "a"), 1: (None, None), 2: (None, None)}


def test_sources(spark, tmp_path):
    path = tmp_path / "roster.json"
    path.write_text(json.dumps([{"player_id": "a", "team_id": 1, "jersey_number": 9}, {"player_id": "b", "team_id": 1, "jersey_number": 100}]))
    assert {r["player_id"]: r["jersey_number"] for r in tables.read_roster(spark, str(path)).collect()} == {"a": 9, "b": None}
    path.write_text(json.dumps([{"player_id": "a", "team_id": 1, "jersey_number": 9}, {"player_id": "b", "team_id": 1, "jersey_number": 9}]))
    with pytest.raises(ValueError):
        tables.read_roster(spark, str(path))
    df = spark.createDataFrame([(1, "unknown", (1.0, 2.0)), (2, 'a "b"\nc', (3.0, 4.0))], "frame int, player_id string, p struct<x:double,y:double>")
    tables.write_tracklets_csv(df, str(tmp_path / "t"))
    assert sorted((r["frame"], r["player_id"], r["p"]) for r in tables.read_tracklets_csv(spark, str(tmp_path / "t")).collect()) == [("1", None, '{"x":1.0,"y":2.0}'), ("2", 'a "b"\nc', '{"x":3.0,"y":4.0}')]
    tables.write_tracklets_csv(df.where("false"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_stream_equals_table(spark, tmp_path):
    events = spark.sql("SELECT timestamp_seconds(id * 700) AS ts, id % 3 AS k FROM range(50)")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = ST.tumbling_counts(stream, "ts", "1 hour", ["k"]).writeStream.outputMode("complete").format("memory").queryName("tumbling").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, ST.tumbling_counts(events, "ts", "1 hour", ["k"]).collect()))


def test_boxes_meet_by_place_and_size(spark):
    rng = np.random.default_rng(3)

    def some(n, at):
        size = 2.0 ** rng.integers(-3, 9, (n, 2)) * rng.choice([1.0, 1.3], (n, 2))  # exact powers are the edges of levels
        corner = np.where(rng.random((n, 2)) < 0.5, rng.integers(-40, 40, (n, 2)) * 4.0, rng.uniform(-2000, 2000, (n, 2)))
        return [(at + i, int(i % 2), (float(x), float(y), float(x + w), float(y + h))) for i, ((x, y), (w, h)) in enumerate(zip(corner, size))]

    first, second = some(700, 0), some(700, 10_000)
    second += [(20_000 + i, f, b) for i, f, b in first[:50]]  # equal boxes
    odd = [(i, 0, b) for i, b in ((-1, None), (-2, (1.0, 1.0, 1.0, 5.0)), (-3, (5.0, 5.0, 1.0, 1.0)), (-4, (0.0, 0.0, float("inf"), 4.0)))]
    box = "struct<x1: double, y1: double, x2: double, y2: double>"
    p = spark.createDataFrame(first + odd, f"prediction_id long, frame int, p_box {box}")
    t = spark.createDataFrame(second + odd, f"truth_id long, frame int, t_box {box}")

    def share(a, b):
        w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)

    near = J.near_boxes(p, t, ["frame"], "p_box", "t_box", least=0.05).select("prediction_id", "truth_id").collect()
    assert len(near) == len(set(near)) < 700 * 750 / 2 / 5  # each pair once, and far fewer than all of a frame
    for least in (0.05, 0.25, 1.0):
        want = {}
        for i, f, a in first:
            over = [(share(a, b), -j) for j, g, b in second if f == g and share(a, b) >= least]
            if over:
                want[i] = (-max(over)[1], pytest.approx(max(over)[0]))
        got = {r["prediction_id"]: (r["truth_id"], r["iou"]) for r in J.best_overlap(p, t, ["frame"], least=least).collect()}
        assert got == want and len(got) >= 50
