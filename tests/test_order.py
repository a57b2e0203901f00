"""Doubles add up in the order of rows, however these are divided: 1e16 + 1 - 1e16 is 0 in order, 1 if the ends meet first."""

import pytest
from pyspark.sql import functions as F

from trackweave.operators import aggregates as A
from trackweave.operators import assignment as AS
from trackweave.operators import linking as L
from trackweave.operators import merging as M
from trackweave.plans import assignment as QA

ENDS_FIRST = [(1, 1e16), (3, -1e16), (2, 1.0)]


def test_distribution_adds_in_order(spark):
    df = spark.createDataFrame([(7, 1, at, [(5, c, 1)]) for at, c in ENDS_FIRST] + [(7, 1, 4, [(6, 0.5, 1)])], "video int, track_id int, at int, candidates array<struct<jersey_number:int,confidence:double,votes:int>>")
    got = AS.merged_distribution(df.coalesce(1), AS.KEY, ["candidates"], "d").first()["d"]
    assert [(c["jersey_number"], c["confidence"]) for c in got] == [(6, 1.0), (5, 0.0)]


def test_report_adds_in_order(spark):
    df = spark.createDataFrame([(7, 1, at, at, q, None, None) for at, q in ENDS_FIRST], "video int, display int, frame int, crop int, crop_quality double, player_id string, jersey_number int")
    none = spark.createDataFrame([], "display int, status string, raw long, voting long, selected long")
    assert M.unknown_report(df.coalesce(1), none).first()["quality_bucket"] == "low"


@pytest.mark.parametrize("count_all", [False, True])
def test_colours_add_in_order(spark, count_all):
    df = spark.createDataFrame([(7, 1, at, c, "black") for at, c in ENDS_FIRST] + [(7, 1, 4, 0.2, "yellow")], "video int, display_track_id int, at int, score double, colour string")
    assert L.colour_summary(df.coalesce(1), L.KEY, ["colour"], "score", order="at", count_all=count_all).first()["colour"] == "yellow"


def test_votes_add_in_order(spark):
    df = spark.createDataFrame([(1, at, 5, c) for at, c in [(1, 1e16), (3, 1e16), (2, 3.0)]] + [(1, 4, 6, 2e16)], "k int, at int, n int, c double")
    # 3 is lost after the first 1e16 or kept (as 4) before it; both ends first give 2e16 + 4
    got = [A.weighted_vote(df.coalesce(1).sort(*by), ["k"], number="n", confidence="c", order="at").first()["score"] for by in (["at"], ["n", F.desc("c")])]
    assert got[0] == got[1] == 1e16 + 3.0 + 1e16


def test_summary_means_in_order(spark):
    cols = "video int, track_id int, at int, frame int, raw_track_id int, role string, semantic_group int, team int, team_confidence double, keeper_team int, jersey_number int, jersey_confidence double, head double, margin double, jersey_votes int, palette_match boolean, keeper_score double, crop_quality double, x double, y double, candidates array<struct<jersey_number:int,confidence:double,votes:int>>"
    for video in (7, None):
        df = spark.createDataFrame([(video, 1, at, at, at, "player", 1, 1, v, 1, 5, v, v, v, 4, False, v, v, v, v, None) for at, v in ENDS_FIRST], cols)
        got = AS.summarize(df.coalesce(1)).collect()
        assert len(got) == 1
        means = ["mean_team_confidence", "keeper_score", "mean_crop_quality", "mean_x", "mean_y"] + (["jersey_confidence", "head", "margin"] if video else [])
        assert {c: got[0][c] for c in means} == dict.fromkeys(means, 0.0)


@pytest.mark.parametrize("zero", [0.0, 1.0])
def test_cheapest_players_are_those_of_all_pairs(spark, zero):
    seen = QA.daily(spark, "/root/testdata/sf0.001")
    tracklets, roster = AS.summarize(seen), QA.roster(spark, "/root/testdata/sf0.01")
    every = AS.costs(AS.pairs(tracklets, roster)).select(*AS.KEY, "player_id", "cost").collect()
    want = {}
    for r in every:
        want.setdefault((r["video"], r["track_id"]), []).append((zero if r["cost"] == 0 else r["cost"], r["player_id"]))
    got = {}
    for r in AS.cheapest(tracklets, roster, F.lit(3), zero=zero).collect():
        got.setdefault((r["video"], r["track_id"]), []).append((zero if r["cost"] == 0 else r["cost"], r["player_id"]))
    assert len(want) > 100 and {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:3] for k, v in want.items()}


def test_rosters_of_any_size_meet_all_tracklets(spark, monkeypatch):
    monkeypatch.setattr(AS, "MOST_PLAYERS", 5)
    one, some = AS.summarize(QA.rows(spark, "/root/testdata/sf0.001")), QA.roster(spark, "/root/testdata/sf0.01")
    assert AS.pairs(one, some).count() == one.count() * some.count() > 0
    assert AS.assign(AS.gated(AS.cheapest(one, some, AS.of_video()))).count() == one.count()
