"""Files of other tools: read what they say, in all their forms."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.sources import annotations as A


def dump(path, data):
    path.write_text(data if isinstance(data, str) else json.dumps(data))
    return f"file://{path}"


def test_roster(spark, tmp_path):
    rows = [
        {"player_id": "a", "team_id": 1, "jersey_number": 7, "position_prior": {"x": 1, "y": 2}, "kit_hint": {"primary": "red", "socks": "white"}, "metadata": {"shirt_color": "blue"}},
        {"player_id": "b", "name": "B", "team_id": 2, "jersey_number": 7, "position_prior": [3.5, 4], "color": "green", "visual_profile": [1.0, 0.0]},
        {"player_id": "c", "position_prior": [1, 2, 3]},
    ]
    got = {r["player_id"]: r for r in A.read_roster(spark, dump(tmp_path / "r.json", rows)).collect()}
    assert got["a"]["metadata"] == {"shirt_color": "blue", "kit_color": "red", "socks_color": "white"} and (got["a"]["prior_x"], got["a"]["prior_y"]) == (1, 2)
    assert (got["b"]["name"], got["b"]["prior_x"], got["b"]["look"]) == ("B", 3.5, [1.0, 0.0]) and got["b"]["metadata"] == {"color": "green"}
    assert got["c"]["prior_x"] is None and got["c"]["name"] == "c"
    for bad in ([{"player_id": "a", "jersey_number": 100}], [{"player_id": p, "team_id": 1, "jersey_number": 9} for p in "ab"]):
        with pytest.raises(ValueError):
            A.read_roster(spark, dump(tmp_path / "bad.json", bad))


def test_homography_fit(spark, tmp_path):
    h = np.array([[2.0, 0.3, 5], [-0.2, 1.5, 7], [0.001, 0.002, 1]])
    px = np.random.default_rng(0).uniform(0, 1000, (6, 2))
    p = np.column_stack([px, np.ones(6)]) @ h.T
    p = p[:, :2] / p[:, 2:]
    assert A.fit_homography(px, p) == pytest.approx(h, rel=1e-6, abs=1e-9)
    assert A.fit_homography(np.array([[0, 0], [1, 1], [2, 2], [3, 3]]), np.array([[0, 0], [1, 0], [0, 1], [1, 1]])) is None
    points = spark.createDataFrame([("k", *map(float, a), *map(float, b)) for a, b in zip(px, p)] + [("few", 0.0, 0.0, 0.0, 0.0)], "key string, px double, py double, x double, y double")
    got = {r["key"]: r["homography"] for r in A.fitted_homographies(points, "key").collect()}
    assert got["few"] is None and got["k"] == pytest.approx(h.ravel().tolist(), rel=1e-5, abs=1e-8)
    one = A.read_calibration(spark, dump(tmp_path / "h.json", {"homography": h.tolist(), "pitch_length": 100}))
    assert one["homography"] == h.ravel().tolist() and one["pitch_length"] == 100
    corners = A.read_calibration(spark, dump(tmp_path / "c.json", {"pixel_vertices": [[0, 680], [0, 0], [1050, 0], [1050, 680]]}))
    assert corners["homography"] == pytest.approx([0.1, 0, 0, 0, 0.1, 0, 0, 0, 1], abs=1e-9)
    pairs = A.read_calibration(spark, dump(tmp_path / "p.json", {"point_correspondences": [{"pixel": a.tolist(), "pitch": b.tolist()} for a, b in zip(px, p)]}))
    assert pairs["homography"] == pytest.approx(h.ravel().tolist(), rel=1e-5, abs=1e-8)
    with pytest.raises(ValueError):
        A.read_calibration(spark, dump(tmp_path / "n.json", {}))


def test_homography_records(spark, tmp_path):
    eye = [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    two = [[2, 0, 0], [0, 2, 0], [0, 0, 2]]
    forms = {
        "list": [{"frame": 3, "homography": eye}, {"image_id": "img/000004.jpg", "homography": [eye, two]}, {"x": 1}],
        "one": {"frame_index": 3, "homography": eye},
        "records": {"samples": [{"frame_idx": 3, "homography": eye}]},
        "keyed": {"000003.jpg": {"homography": eye}},
        "lines": "\n".join(json.dumps(r) for r in ({"homography": eye}, {"frame": 3, "homography": two}, {"frame": 3, "homography": eye})),
    }
    for name, data in forms.items():
        got = {r["frame"]: r["homography"] for r in A.read_homographies(spark, dump(tmp_path / f"{name}.json", data)).collect()}
        assert got[3] == [1, 0, 52.5, 0, 1, 34, 0, 0, 1], name
        assert set(got) == {"list": {3, 4}, "lines": {0, 3}}.get(name, {3})
    stack = {r["frame"]: r["homography"] for r in A.read_homographies(spark, f"file://{tmp_path}/list.json", temporal_index=1, centred=False, invert=True, frame_offset=1).collect()}
    assert stack[3] == [1, 0, 0, 0, 1, 0, 0, 0, 1] and stack[2] == [1, 0, 0, 0, 1, 0, 0, 0, 1]


def test_annotations(spark, tmp_path):
    folder = tmp_path / "valid" / "SNGS-9"
    folder.mkdir(parents=True)
    box = {"x": 1.0, "y": 2.0, "w": 10.0, "h": 20.0}
    say = lambda image, track, **more: {"image_id": image, "track_id": track, "bbox_image": box, **more}
    data = {
        "images": [{"id": "1", "file_name": "000001.jpg"}, {"id": "2", "file_name": "000002.jpg"}, {"id": "3", "file_name": "000003.jpg", "has_labeled_person": False}],
        "categories": [{"id": 1, "name": "Goalkeeper"}],
        "annotations": [say("1", "t", attributes={"role": "player", "jersey": "9", "team": "left"}), say("2", "t", attributes={"role": "Field Player", "jersey": "8"}), say("2", "g", category_id=1, attributes={"number": "1"}), say("3", "t", attributes={}), say("1", "r", attributes={"role": "referee"}), say("1", "u", attributes={"role": "player"}), say("9", "t", attributes={})],
    }
    (folder / "Labels-GameState.json").write_text(json.dumps(data))
    files = A.label_files(spark, f"file://{tmp_path}", sequences=["SNGS-9"], splits=["val"])
    found = A.annotations(files)
    skips = {r["skip"]: r["n"] for r in found.groupBy("skip").agg(F.count("*").alias("n")).collect()}
    assert skips == {None: 3, "missing_or_unlabeled_image": 2, "role": 1, "missing_jersey_number": 1}
    rows = {(r["track"], r["frame"]): r for r in A.truth_tracklets(found).collect()}
    assert rows["t", 1]["truth_number"] == rows["t", 2]["truth_number"] == 9 and rows["t", 1]["num_frames"] == 2 and rows["g", 2]["role"] == "goalkeeper"
    assert A.truth_tracklets(found, min_frames=2).select("track").distinct().count() == 1 and A.truth_tracklets(found, min_area=201).count() == 0
    assert A.label_files(spark, f"file://{tmp_path}", splits=["test"]).count() == 0


def test_lines_and_sinks(spark, tmp_path):
    lines = "\n".join(json.dumps(r) for r in ({"sequence": "a", "frame": 1, "role": "player", "jersey_number": "7"}, {"sequence": "a", "frame": 2, "role": "referee", "jersey_number": "8"}, {"sequence": "b", "frame": 3, "role": "Goalkeeper", "jersey_number": "0"}, {"sequence": "b", "frame": 4, "role": "Goalkeeper", "jersey_number": "1"}))
    got = A.numbered_lines(spark, dump(tmp_path / "gt.jsonl", lines))
    assert sorted((r["sequence"], r["frame"], r["jersey_number"]) for r in got.collect()) == [("a", 0, 7), ("b", 3, 1)]
    assert A.numbered_lines(spark, f"file://{tmp_path}/gt.jsonl", sequences=["b"]).count() == 1
    assert A.optional_json(spark, f"file://{tmp_path}/none.json") is None
    A.write_artifacts({"gt": got}, f"file://{tmp_path}/run")
    assert spark.read.parquet(f"file://{tmp_path}/run/gt").count() == 2
    A.write_lines(got, f"file://{tmp_path}/lines", F.col("frame") == 0)
    assert [json.loads(x)["jersey_number"] for p in (tmp_path / "lines").glob("*.json") for x in p.read_text().splitlines()] == [1]
    labels = spark.createDataFrame([("f1", "0 b"), ("f1", "0 a"), ("f2", "1 c"), ("f2", None)], "file string, line string")
    A.write_label_files(labels, f"file://{tmp_path}/labels")
    assert {d.name: "".join(p.read_text() for p in sorted(d.glob("*.txt"))) for d in (tmp_path / "labels").glob("file=*")} == {"file=f1": "0 a\n0 b\n", "file=f2": "1 c\n"}
    A.write_report(spark.createDataFrame([(1, [1, 2])], "k int, v array<int>"), f"file://{tmp_path}/report")
    assert next((tmp_path / "report").glob("*.csv")).read_text() == 'k,v\n1,"[1,2]"\n'
    rows = spark.createDataFrame([("k1", 1), ("k2", 2), ("k2", 2)], "key string, v int")
    cache = f"file://{tmp_path}/cache"
    assert (A.append_cache(rows.where("key = 'k1'"), cache, "key"), A.append_cache(rows, cache, "key"), A.append_cache(rows, cache, "key")) == (1, 1, 0)
    assert sorted((r["key"], r["n"], r["v"]) for r in A.cached(spark.createDataFrame([("k2", 9), ("k3", 9)], "key string, n int"), cache, "key").collect()) == [("k2", 9, 2), ("k3", 9, None)]
