"""The order-dependent engines against plain Python, and rules that tables of the queries seldom meet."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.operators import assignment as AS
from trackweave.operators import constraints as C
from trackweave.operators import evaluation as E
from trackweave.operators import linking as L
from trackweave.operators import propagation as P
from trackweave.operators import readings as R
from trackweave.operators import scenes as S
from trackweave.plans import assignment as QA
from trackweave.plans import linking as QL
from trackweave.plans import propagation as QP
from trackweave.plans import tracks as T

SF = "/root/testdata/sf0.001"
ROW = "video int, frame long, raw_track_id long, display_track_id long, role string, team int, team_confidence double, frame_team int, frame_team_confidence double, semantic_group int, palette_match boolean, jersey_number int, jersey_confidence double, jersey_votes int, head double, margin double, candidates array<struct<jersey_number:int,confidence:double,votes:int>>, player_id string, identity_confidence double, crop_quality double, area double"
ROSTER = [("k1", 1, 1, "goalkeeper"), ("p7", 1, 7, "player"), ("p9", 1, 9, None), ("q7", 2, 7, "player")]


def seen(frame, raw, **more):
    base = dict(video=0, frame=frame, raw_track_id=raw, display_track_id=raw, role="player", team=1, team_confidence=0.9, frame_team=None, frame_team_confidence=None, semantic_group=1, palette_match=False, jersey_number=None, jersey_confidence=0.5, jersey_votes=3, head=0.6, margin=0.2, candidates=None, player_id=None, identity_confidence=0.0, crop_quality=0.5, area=10.0)
    return tuple((base | more).values())


@pytest.fixture(scope="module")
def roster(spark):
    return spark.createDataFrame(ROSTER, "player_id string, team int, jersey_number int, role string")


def test_constraints_on_single_rows(spark, roster):
    cand = [(1, 0.5, 4), (7, 0.3, 2), (9, 0.2, 2)]
    rows = [
        seen(0, 1, jersey_number=3, player_id="p7"),  # not in the roster
        seen(0, 2, team=3, jersey_number=3, player_id="x"),  # a team without a roster is left alone
        seen(0, 3, jersey_number=1, candidates=cand),  # a goalkeeper's number on a player: 7 is held by display 5, so none
        seen(1, 4, jersey_number=1, role="keeper"),  # a goalkeeper keeps it
        seen(2, 5, jersey_number=7, player_id="p7", identity_confidence=0.9),
        seen(1, 6, jersey_number=9, role="gk", display_track_id=60),  # not a goalkeeper's number
        seen(3, 7, frame_team=2, frame_team_confidence=0.9, jersey_number=9, player_id="p9"),
        seen(4, 8, player_id="p9", identity_confidence=0.2), seen(4, 9, player_id="p9", identity_confidence=0.4),
    ]
    got = {r["raw_track_id"]: r for r in C.enforce(spark.createDataFrame(rows, ROW), roster).collect()}
    why = {k: (r["jersey_reason"], r["identity_reason"]) for k, r in got.items()}
    assert why[1] == ("number_not_in_team_roster", "assigned_jersey_not_in_track_team_roster") and why[2] == (None, None) and got[2]["jersey_number"] == 3
    assert why[3][0] == "goalkeeper_only_jersey_on_non_goalkeeper" and got[3]["jersey_number"] is None and got[3]["alternate_rejection"] == "alternate_known_owner_conflict"
    assert got[4]["jersey_number"] == 1 and why[6][0] == "non_goalkeeper_jersey_on_goalkeeper"
    assert (got[7]["team"], why[7]) == (2, ("frame_team_conflict", "frame_team_conflict"))
    assert (got[8]["player_id"], got[9]["player_id"], why[8][1]) == (None, "p9", "duplicate_player_id_same_frame")
    table = spark.createDataFrame(rows, ROW)
    alone = lambda owners, **how: C.clear_keeper_only_numbers(C.with_number_sets(C.opened(table), roster), owners, **how).where("raw_track_id = 3").first()["jersey_number"]
    assert alone(C.known_owners(table), block_known_owner=False) == 7
    assert alone(C.known_owners(table.where("raw_track_id <> 7")), stop_on_conflict=False) == 9
    assert alone(C.known_owners(table), stop_on_conflict=False) is None and alone(None) is None


def test_long_conflicts_become_displays(spark, roster):
    clash = [True, True, False, False, True, True, False, False, False, True]
    rows = [seen(f, f + 1, display_track_id=5, frame_team=2 if c else 1, frame_team_confidence=0.9, jersey_number=7) for f, c in enumerate(clash)]
    got = {r["frame"]: r for r in C.split_conflicts(C.frame_team_consistency(C.opened(spark.createDataFrame(rows, ROW)))).collect()}
    assert [got[f]["display_track_id"] for f in range(10)] == [6] * 6 + [5] * 4
    assert got[2]["jersey_reason"] == "persistent_frame_team_conflict_bridge" and got[7]["jersey_number"] == 7 and got[0]["previous_display_id"] == 5


def test_assignment_is_one_to_one_and_gated(spark):
    scored = QA.scored(spark, SF).cache()
    out = AS.assign(scored).collect()
    cost = {(r["video"], r["track_id"], r["player_id"]): r for r in scored.collect()}
    tracklets = {(v, t) for v, t, _ in cost}
    assert {(r["video"], r["track_id"]) for r in out} == tracklets
    for v in {v for v, _ in tracklets}:
        mine = [r for r in out if r["video"] == v and r["best_candidate"]]
        assert len({r["best_candidate"] for r in mine}) == len(mine) == min(len({t for w, t in tracklets if w == v}), len({p for w, _, p in cost if w == v}))
        total = sum(cost[v, r["track_id"], r["best_candidate"]]["cost"] for r in mine)
        rng = np.random.default_rng(0)
        ids, people = sorted({t for w, t in tracklets if w == v}), sorted({p for w, _, p in cost if w == v})
        for _ in range(200):
            some = rng.permutation(len(people))[: len(ids)]
            assert total <= sum(cost[v, t, people[k]]["cost"] for t, k in zip(ids, some)) + 1e-9
    for r in out:
        if r["best_candidate"]:
            c = cost[r["video"], r["track_id"], r["best_candidate"]]
            want = "below_threshold" if c["confidence"] < 0.35 else "assigned" if c["gate_pass"] else "insufficient_assignment_evidence"
            assert r["status"] == want and (r["player_id"] is not None) == (want == "assigned")


def test_propagation_against_plain_python(spark):
    rows, nodes, roster, cuts = QP.rows(spark, SF).cache(), QP.nodes(spark, SF).cache(), T.players(spark, SF), QP.cuts(spark, SF)
    for limits in (QP.LIMITS, P.Propagation(min_composite=0.2, min_margin=0.0, min_source=0.0, partial=False, keepers=True, buffer=1)):
        edges = P.scored_edges(nodes, cuts, QP.RULES).where("rejection is null").collect()
        known = {(n["video"], n["node"]): n for n in nodes.collect()}
        people = {p["player_id"]: p for p in roster.collect()}
        table = [r.asDict() for r in rows.select("video", "frame", "node", "player_id", "team", "jersey_number").collect()]
        by_target = {}
        for e in edges:
            if e["composite"] >= limits.min_composite:
                by_target.setdefault((e["video"], e["target"]), []).append(e)
        want = {}
        for (video, target), some in sorted(by_target.items()):
            some.sort(key=lambda e: (-e["composite"], e["source"]))
            best, second = some[0], some[1]["composite"] if len(some) > 1 else 0.0
            source, player = known[video, best["source"]], people.get(known[video, best["source"]]["player_id"])
            if best["composite"] - second < limits.min_margin:
                want[video, target] = ("ambiguous_best_edge", 0)
            elif (source["confidence"] or 0) < limits.min_source:
                want[video, target] = ("source_confidence_too_low", 0)
            elif player is None:
                want[video, target] = ("source_not_in_roster", 0)
            elif not limits.keepers and player["role"] == "goalkeeper":
                want[video, target] = ("goalkeeper_source_propagation_disabled", 0)
            else:
                frames = sorted({r["frame"] for r in table if (r["video"], r["node"]) == (video, target)})
                active = set(frames[limits.buffer : -limits.buffer] if limits.buffer and len(frames) > 2 * limits.buffer else frames)
                bad = {r["frame"] for r in table if r["video"] == video and r["node"] != target and r["frame"] in active and (r["player_id"] == player["player_id"] or (player["team"] is not None and player["jersey_number"] is not None and (r["team"], r["jersey_number"]) == (player["team"], player["jersey_number"])))}
                free = active - bad
                if bad and not limits.partial:
                    want[video, target] = ("frame_conflict", 0)
                elif len(free) < limits.min_frames or len(free) / max(1, len(active)) < limits.min_fraction:
                    want[video, target] = ("insufficient_non_conflicting_frames", 0)
                else:
                    want[video, target] = (None, len(free))
                    number = player["jersey_number"] or known[video, target]["number"]
                    for r in table:
                        if (r["video"], r["node"]) == (video, target) and r["frame"] in free and r["player_id"] is None:
                            r["player_id"], r["jersey_number"] = player["player_id"], number
        decided = P.hop(rows, nodes, roster, cuts, QP.RULES, limits).collect()
        # the tables' rows of unknown nodes may have players of their own: only the node is unknown
        assert {(r["video"], r["target"]): (r["reason"], len(r["frames"])) for r in decided} == want


def test_propagation_goes_on_from_hop_to_hop(spark):
    """A chain a - b - c: b takes a's player in the first hop; c can only from b, in the second, if propagated nodes are sources."""
    kinds = "video int, node long, start long, end long, team int, team_confidence double, number int, number_confidence double, head double, votes int, player_id string, confidence double, depth int, goalkeeper boolean, referee boolean, first_x double, first_y double, last_x double, last_y double, look array<double>"
    node = lambda n, start, player: (0, n, start, start + 9, 1, 0.9, 7, 0.9, 0.9, 9, player, 0.9 if player else None, 0 if player else None, False, False, 0.0, 0.0, 0.0, 0.0, [1.0, 0.0])
    nodes = spark.createDataFrame([node(1, 0, "p7"), node(2, 20, None), node(3, 140, None)], kinds)
    rows = spark.createDataFrame([(0, f, n, "p7" if n == 1 else None, 1, None) for n, a in ((1, 0), (2, 20), (3, 140)) for f in range(a, a + 10)] + [(0, 25, 9, "p7", 1, None)], "video int, frame long, node long, player_id string, team int, jersey_number int")
    roster = spark.createDataFrame(ROSTER, "player_id string, team int, jersey_number int, role string")
    p = P.Propagation(min_composite=0.1, min_margin=0.0, from_propagated=True, partial=True, hops=3)
    got, known, log = P.propagate(rows, nodes, roster, rules=P.EdgeRules(max_gap=112), p=p)
    assert {(r["hop"], r["source"], r["target"]) for r in P.report(log).collect()} == {(1, 1, 2), (2, 2, 3)}
    assert {(r["node"], r["player_id"], r["depth"]) for r in known.collect()} == {(1, "p7", 0), (2, "p7", 1), (3, "p7", 2)}
    held = Counter(r["node"] for r in got.where("player_id = 'p7' and jersey_number = 7").collect())
    assert held == {2: 9, 3: 10}  # frame 25 has the player elsewhere


def test_links_by_number(spark):
    found = QL.summaries(spark, SF).where("reliable").collect()
    got = {(r["video"], r["id"]): (r["cluster"], r["follows"]) for r in QL.number_links(spark, SF).collect()}
    frames = {}
    for r in QL.rows(spark, SF).collect():
        frames.setdefault((r["video"], r["display_track_id"]), set()).add(r["frame"])
    want, members = {}, {}
    for s in sorted(found, key=lambda s: (s["start"], s["display_track_id"])):
        best = None
        for q in found:
            if (q["start"], q["display_track_id"]) >= (s["start"], s["display_track_id"]) or q["video"] != s["video"] or q["jersey_number"] != s["jersey_number"] or not 0 < s["start"] - q["end"] <= 300:
                continue
            if any(frames[m["video"], m["display_track_id"]] & frames[s["video"], s["display_track_id"]] for m in members[want[q["video"], q["display_track_id"]][0], s["video"]]):
                continue
            away = np.hypot(s["first_x"] - q["last_x"], s["first_y"] - q["last_y"])
            if away > 400 or not (q["team"] == s["team"] or min(q["team_confidence"], s["team_confidence"]) < 0.6):
                continue
            score = (away + 0.5 * (s["start"] - q["end"]), q["display_track_id"])
            best = min(best, (score, q["display_track_id"])) if best else (score, q["display_track_id"])
        name = want[s["video"], best[1]][0] if best else s["display_track_id"]
        want[s["video"], s["display_track_id"]] = (name, best[1] if best else None)
        members.setdefault((name, s["video"]), []).append(s)
    assert got == want


def test_votes_and_rare_rules(spark):
    read = spark.createDataFrame([("d", 1, 0.9), ("d", 11, 0.5), ("e", 21, 0.9), ("e", 11, 0.2)], "k string, number int, confidence double")
    rule = {1: {"prefer": 11, "min_alternative_ratio": 0.5, "max_winner_ratio": 2.0}, 21: {"prefer": 11, "min_alternative_ratio": 0.5}}
    got = {r["k"]: r for r in R.vote(read, ["k"], overrides=rule).collect()}
    assert (got["d"]["jersey_number"], got["e"]["jersey_number"]) == (11, 21) and got["d"]["margin"] < 0
    assert R.vote(read.where("1 = 0"), ["k"]).count() == 0
    scores = spark.createDataFrame([(1, f, 1.0, 0.5) for f in (0, 2, 5, 6, 11, 40)], "k int, frame long, score double, correlation double")
    assert sorted((r["frame"], r["nth"]) for r in S.cuts(scores, ["k"], "frame", threshold=0.5, min_gap=5, most=3).collect()) == [(0, 1), (5, 2), (11, 3)]
    flat = spark.createDataFrame([([1.0, 1.0], [1.0, 1.0]), ([1.0, 1.0], [1.0, 2.0]), ([], []), ([1.0, 2.0], [2.0, 4.0])], "a array<double>, b array<double>")
    assert [r[0] for r in flat.select(S.correlation(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, pytest.approx(1.0)]
    empty = spark.createDataFrame([], "k int, team int, truth_team string")
    assert E.team_mapping(empty, ["k"]).count() == 0
    assert Counter(r["part"] for r in E.split_at_median(spark.createDataFrame([(1, f) for f in (1, 1, 2, 9)], "k int, frame int"), ["k"], "frame").collect()) == {"train": 2, "eval": 2}


def test_pairs_of_own_rosters(spark):
    seen = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (2, 1), (None, 9)], "video long, track_id long")
    people = [(0, "a", 1, "gk"), (0, "b", 1, "GK"), (1, "c", 1, "goalkeeper"), (1, "d", None, "gk"), (7, "e", 1, "player"), (None, "f", 1, "gk")]
    roster = spark.createDataFrame([(v, p, t, None, r, None, None) for v, p, t, r in people], "video long, player_id string, team int, jersey_number int, role string, prior_x double, prior_y double")
    got = sorted((r["video"], r["track_id"], r["player_id"], r["team_keepers"]) for r in AS.pairs(seen, roster).collect())
    # keepers are counted in each roster; rosters and tracklets without a video, or of another, meet none
    assert got == [(0, 1, "a", 2), (0, 1, "b", 2), (0, 2, "a", 2), (0, 2, "b", 2), (1, 1, "c", 1), (1, 1, "d", 0)]
    assert AS.pairs(seen, roster.drop("video")).count() == 30
