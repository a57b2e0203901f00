"""Queries of the constraint passes: each alone, and all nine in a chain."""

from __future__ import annotations

from trackweave.operators import constraints as C
from trackweave.plans.registry import query
from trackweave.plans.tracks import TRACKS, players, tracks

SHOWN = ["video", "frame", "raw_track_id", "display_track_id", "team", "semantic_group", "jersey_number", "player_id", "jersey_reason", "identity_reason", "conflict"]
SETS = """,
sets AS (SELECT team, list_sort(list_distinct(list(jersey_number))) AS numbers, list_distinct(list(jersey_number) FILTER (coalesce(role IN ('goalkeeper', 'keeper', 'gk'), false))) AS keepers
         FROM players WHERE team IS NOT NULL AND jersey_number IS NOT NULL GROUP BY team),
p0 AS (SELECT *, false AS conflict, CAST(NULL AS VARCHAR) AS jersey_reason, CAST(NULL AS VARCHAR) AS identity_reason, CAST(NULL AS BIGINT) AS previous_display_id FROM r)"""


def _clear(source: str, reason: str, identity_reason: str | None = None, *, evidence: bool = True, more: str = "", drop: str = "w", number: bool = True) -> str:
    """SQL that clears the rows of source where w holds."""
    n, p = "w AND jersey_number IS NOT NULL", "w AND player_id IS NOT NULL"
    parts = [f"CASE WHEN NOT ({p}) THEN player_id END AS player_id", f"CASE WHEN {p} THEN 0 ELSE identity_confidence END AS identity_confidence", f"CASE WHEN {p} THEN '{identity_reason or reason}' ELSE identity_reason END AS identity_reason"]
    if number:
        parts += [f"CASE WHEN NOT ({n}) THEN jersey_number END AS jersey_number", f"CASE WHEN {n} THEN 0 ELSE jersey_confidence END AS jersey_confidence", f"CASE WHEN {n} THEN 0 ELSE jersey_votes END AS jersey_votes", f"CASE WHEN {n} THEN '{reason}' ELSE jersey_reason END AS jersey_reason"]
        if evidence:
            parts += [f"CASE WHEN NOT ({n}) THEN {c} END AS {c}" for c in ("head", "margin", "candidates")]
    return f"SELECT * EXCLUDE ({drop}) REPLACE ({', '.join(parts)}{more}) FROM {source}"


KEEPER = "(coalesce(lower(role) IN ('goalkeeper', 'keeper', 'gk'), false) OR coalesce(palette_match, false))"
RANK = """CASE WHEN coalesce(role IN ('referee', 'referee_candidate'), false) OR coalesce(semantic_group = 5, false) THEN -1 ELSE 0 END DESC, CASE WHEN coalesce(semantic_group IN (3, 4), false) OR coalesce(role = 'goalkeeper', false) THEN 1 ELSE 0 END DESC,
  coalesce(jersey_confidence, 0) DESC, coalesce(head, 0) DESC, coalesce(margin, 0) DESC, coalesce(jersey_votes, 0) DESC, coalesce(identity_confidence, 0) DESC, coalesce(crop_quality, 0) DESC, coalesce(area, 0) DESC"""


def frame_team(s: str) -> str:
    where = f"coalesce(NOT coalesce(lower(role) IN ('referee', 'referee_candidate', 'goalkeeper'), false) AND NOT coalesce(semantic_group IN (3, 4, 5), false) AND team <> frame_team AND frame_team_confidence >= 0.6, false)"
    more = ", CASE WHEN w THEN true ELSE conflict END AS conflict, CASE WHEN w THEN frame_team ELSE team END AS team, CASE WHEN w THEN greatest(team_confidence, frame_team_confidence) ELSE team_confidence END AS team_confidence"
    return _clear(f"(SELECT *, {where} AS w FROM {s})", "frame_team_conflict", more=more)


def invalid(s: str) -> str:
    return _clear(f"(SELECT x.*, coalesce(jersey_number IS NOT NULL AND len(numbers) > 0 AND NOT list_contains(numbers, jersey_number), false) AS w FROM {s} x LEFT JOIN sets USING (team))", "number_not_in_team_roster", "assigned_jersey_not_in_track_team_roster", evidence=False)


def keeper_only(s: str) -> str:
    hit = f"(SELECT x.*, numbers, keepers, coalesce(list_contains(keepers, jersey_number), false) AND NOT {KEEPER} AS w FROM {s} x LEFT JOIN sets USING (team))"
    return f"""SELECT * EXCLUDE (alt, blocked) REPLACE (coalesce(alt.number, jersey_number) AS jersey_number, coalesce(alt.confidence, jersey_confidence) AS jersey_confidence, coalesce(alt.votes, jersey_votes) AS jersey_votes),
      CASE WHEN alt IS NULL AND blocked THEN 'alternate_known_owner_conflict' END AS alternate_rejection
    FROM ({_clear(hit, "goalkeeper_only_jersey_on_non_goalkeeper", drop="w, numbers, keepers")}) LEFT JOIN (
      SELECT video, frame, raw_track_id, CASE WHEN NOT arg_min(taken, rank) THEN arg_min({{'number': number, 'confidence': confidence, 'votes': votes}}, rank) END AS alt, arg_min(taken, rank) AS blocked FROM (
        SELECT n.*, coalesce(low <> display_track_id OR high <> display_track_id, false) AS taken FROM (
          SELECT *, row_number() OVER (PARTITION BY video, frame, raw_track_id ORDER BY confidence DESC, votes DESC, pos) AS rank FROM (
            SELECT video, frame, raw_track_id, display_track_id, team, jersey_number AS had, numbers, keepers, unnest(candidates).jersey_number AS number, unnest(candidates).confidence AS confidence, unnest(candidates).votes AS votes, generate_subscripts(candidates, 1) AS pos FROM {hit} WHERE w)
          QUALIFY row_number() OVER (PARTITION BY video, frame, raw_track_id, number ORDER BY pos) = 1) n
        LEFT JOIN owners o ON n.video = o.video AND n.team = o.team AND n.number = o.number
        WHERE rank <= 5 AND n.number <> had AND list_contains(numbers, n.number) AND NOT list_contains(keepers, n.number) AND confidence >= 0.10 AND votes >= 1) GROUP BY ALL) USING (video, frame, raw_track_id)"""


def keeper_invalid(s: str) -> str:
    return _clear(f"(SELECT x.*, coalesce({KEEPER} AND jersey_number IS NOT NULL AND len(keepers) > 0 AND NOT list_contains(keepers, jersey_number), false) AS w FROM {s} x LEFT JOIN sets USING (team))", "non_goalkeeper_jersey_on_goalkeeper")


def duplicate_player(s: str) -> str:
    return _clear(f"(SELECT *, player_id IS NOT NULL AND row_number() OVER (PARTITION BY video, frame, player_id ORDER BY coalesce(identity_confidence, 0) DESC, coalesce(crop_quality, 0) DESC, coalesce(area, 0) DESC, raw_track_id) > 1 AS w FROM {s})", "duplicate_player_id_same_frame", number=False)


def groups(s: str) -> str:
    return f"""SELECT * EXCLUDE (goal, pr, pt, listed) REPLACE (coalesce(goal, semantic_group) AS semantic_group),
      CASE WHEN goal IS NOT NULL AND semantic_group IS DISTINCT FROM goal THEN CASE WHEN pr IN ('goalkeeper', 'keeper', 'gk') THEN 'roster_goalkeeper_role' WHEN goal = 5 THEN 'referee_role' WHEN listed AND pt IS NOT NULL THEN 'roster_team_role' ELSE 'track_team_role' END END AS group_reason
    FROM (SELECT *, CASE WHEN er IN ('referee', 'referee_candidate') THEN 5 WHEN er IN ('goalkeeper', 'keeper', 'gk') THEN CASE et WHEN 1 THEN 3 WHEN 2 THEN 4 END WHEN coalesce(role IN ('referee', 'referee_candidate'), false) THEN 5 ELSE CASE et WHEN 1 THEN 1 WHEN 2 THEN 2 END END AS goal FROM (
      SELECT x.*, p.role AS pr, p.team AS pt, p.player_id IS NOT NULL AS listed, coalesce(p.role, x.role, '') AS er, CASE WHEN p.player_id IS NOT NULL THEN p.team ELSE x.team END AS et FROM {s} x LEFT JOIN players p ON x.player_id = p.player_id)) t""".replace("SELECT * EXCLUDE (goal, pr, pt, listed)", "SELECT * EXCLUDE (goal, pr, pt, listed, er, et)")


def duplicate_number(s: str) -> str:
    return _clear(f"(SELECT *, team IS NOT NULL AND jersey_number IS NOT NULL AND row_number() OVER (PARTITION BY video, frame, team, jersey_number ORDER BY {RANK}, raw_track_id) > 1 AS w FROM {s})", "duplicate_team_jersey_same_frame")


def split(s: str) -> str:
    runs = f"""SELECT video, display_track_id, min(n) AS a, max(n) AS b FROM (
        SELECT *, sum(CASE WHEN pn IS NULL OR n - pn > 3 OR pt <> frame_team OR frame - pf > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY video, display_track_id ORDER BY n) AS run FROM (
          SELECT *, lag(n) OVER w AS pn, lag(frame_team) OVER w AS pt, lag(frame) OVER w AS pf FROM (SELECT *, row_number() OVER (PARTITION BY video, display_track_id ORDER BY frame, raw_track_id) AS n FROM {s}) WHERE conflict WINDOW w AS (PARTITION BY video, display_track_id ORDER BY n)))
        GROUP BY video, display_track_id, run HAVING max(n) - min(n) + 1 >= 4"""
    base = f"""(SELECT x.*, new, new IS NOT NULL AND NOT conflict AS w FROM (SELECT *, row_number() OVER (PARTITION BY video, display_track_id ORDER BY frame, raw_track_id) AS n FROM {s}) x
        LEFT JOIN (SELECT q.*, top + row_number() OVER (PARTITION BY q.video ORDER BY display_track_id, a) AS new FROM ({runs}) q JOIN (SELECT video, max(display_track_id) AS top FROM {s} GROUP BY video) m ON q.video = m.video) t
        ON x.video = t.video AND x.display_track_id = t.display_track_id AND x.n BETWEEN t.a AND t.b)"""
    return _clear(base, "persistent_frame_team_conflict_bridge", drop="w, new, n", more=", CASE WHEN new IS NOT NULL THEN display_track_id END AS previous_display_id, coalesce(new, display_track_id) AS display_track_id")


def owner(s: str) -> str:
    means = ["jersey_confidence", "head", "margin", "jersey_votes", "identity_confidence", "team_confidence"]
    ranked = f"(SELECT *, row_number() OVER (PARTITION BY video, team, jersey_number, owner ORDER BY {RANK}) AS best FROM owned)"
    cols = [c.removesuffix(" DESC").strip() for c in RANK.replace("\n", " ").split(" DESC,")]
    best = ", ".join(f"max(CASE WHEN best = 1 THEN {c} END) AS b{i}" for i, c in enumerate(cols))
    return f"""SELECT * FROM (WITH held AS (SELECT * FROM {s} WHERE team IS NOT NULL AND jersey_number IS NOT NULL),
      names AS (SELECT video, team, jersey_number, display_track_id, arg_min(player_id, frame * 1000000000 + raw_track_id) FILTER (player_id IS NOT NULL) AS player FROM held GROUP BY ALL),
      owned AS (SELECT held.*, coalesce('p:' || player, 'd:' || held.display_track_id) AS owner FROM held JOIN names USING (video, team, jersey_number, display_track_id)),
      merged AS (SELECT video, team, jersey_number, owner, {best}, {", ".join(f"avg(coalesce({c}, 0)) AS m_{c}" for c in means)}, max(coalesce(jersey_votes, 0)) AS votes, count(player_id) AS known, count(*) AS n, count(DISTINCT display_track_id) AS displays, min(display_track_id) AS low FROM {ranked} GROUP BY ALL),
      kept AS (SELECT video, team, jersey_number, owner AS kept, sum(displays) OVER (PARTITION BY video, team, jersey_number) AS displays, row_number() OVER (PARTITION BY video, team, jersey_number ORDER BY owner > 'p' DESC, {", ".join(f"b{i} DESC" for i in range(len(cols)))},
        m_jersey_confidence DESC, m_head DESC, m_margin DESC, votes DESC, m_jersey_votes DESC, known DESC, m_identity_confidence DESC, m_team_confidence DESC, n DESC, low) AS place FROM merged QUALIFY place = 1),
      lost AS (SELECT DISTINCT video, team, jersey_number, display_track_id, true AS lost FROM owned JOIN kept USING (video, team, jersey_number) WHERE displays > 1 AND owner <> kept)
      {_clear(f"(SELECT x.*, lost, coalesce(lost, false) AS w FROM {s} x LEFT JOIN lost USING (video, team, jersey_number, display_track_id))", "global_duplicate_team_jersey_owner", drop="w, lost")})"""


OWNERS = ", owners AS (SELECT video, team, jersey_number AS number, min(display_track_id) AS low, max(display_track_id) AS high FROM r WHERE player_id IS NOT NULL AND team IS NOT NULL AND jersey_number IS NOT NULL GROUP BY ALL)"
CHAIN = [frame_team, invalid, keeper_only, keeper_invalid, duplicate_player, groups, duplicate_number, split, owner]
ALL = TRACKS + SETS + OWNERS + "".join(f",\np{i + 1} AS ({step(f'p{i}')})" for i, step in enumerate(CHAIN))
COLS = ", ".join(SHOWN)


def _one(step) -> str:
    return f"SELECT {COLS} FROM ({step('p0')})"


def _pass(spark, sf_dir, step, sets: bool = False):
    rows = C.opened(tracks(spark, sf_dir))
    return step(C.with_number_sets(rows, players(spark, sf_dir)) if sets else rows).select(*SHOWN)


@query(_one(frame_team), TRACKS + SETS)
def frame_team_consistency(spark, sf_dir):
    return _pass(spark, sf_dir, C.frame_team_consistency)


@query(_one(invalid), TRACKS + SETS)
def invalid_team_numbers(spark, sf_dir):
    return _pass(spark, sf_dir, C.clear_invalid_numbers, True)


@query(f"SELECT {COLS}, alternate_rejection FROM ({keeper_only('p0')})", TRACKS + SETS + OWNERS)
def keeper_only_numbers(spark, sf_dir):
    rows = C.with_number_sets(C.opened(tracks(spark, sf_dir)), players(spark, sf_dir))
    return C.clear_keeper_only_numbers(rows, C.known_owners(rows)).select(*SHOWN, "alternate_rejection")


@query(_one(keeper_invalid), TRACKS + SETS)
def keeper_invalid_numbers(spark, sf_dir):
    return _pass(spark, sf_dir, C.clear_keeper_invalid_numbers, True)


@query(_one(duplicate_player), TRACKS + SETS)
def duplicate_players(spark, sf_dir):
    return _pass(spark, sf_dir, C.clear_duplicate_players)


@query(f"SELECT {COLS}, group_reason FROM ({groups('p0')})", TRACKS + SETS)
def group_corrections(spark, sf_dir):
    return C.correct_groups(C.opened(tracks(spark, sf_dir)), players(spark, sf_dir)).select(*SHOWN, "group_reason")


@query(_one(duplicate_number), TRACKS + SETS)
def duplicate_numbers(spark, sf_dir):
    return _pass(spark, sf_dir, C.clear_duplicate_numbers)


@query(f"SELECT {COLS}, previous_display_id FROM ({split('p1')})", TRACKS + SETS + f", p1 AS ({frame_team('p0')})")
def conflict_splits(spark, sf_dir):
    rows = C.frame_team_consistency(C.opened(tracks(spark, sf_dir)))
    return C.split_conflicts(rows).select(*SHOWN, "previous_display_id")


@query(_one(owner), TRACKS + SETS)
def global_number_owners(spark, sf_dir):
    return _pass(spark, sf_dir, C.global_owners)


@query(f"SELECT {COLS}, previous_display_id FROM p9", ALL)
def constraint_engine(spark, sf_dir):
    return C.enforce(tracks(spark, sf_dir), players(spark, sf_dir)).select(*SHOWN, "previous_display_id")


@query("SELECT 'jersey' AS what, jersey_reason AS reason, count(*) AS n FROM p9 WHERE jersey_reason IS NOT NULL GROUP BY 2 UNION ALL SELECT 'identity', identity_reason, count(*) FROM p9 WHERE identity_reason IS NOT NULL GROUP BY 2", ALL)
def constraint_reasons(spark, sf_dir):
    return C.reason_counts(C.enforce(tracks(spark, sf_dir), players(spark, sf_dir)))


@query("SELECT video, team, jersey_number AS number, min(display_track_id) AS low, max(display_track_id) AS high FROM r WHERE player_id IS NOT NULL AND team IS NOT NULL AND jersey_number IS NOT NULL GROUP BY ALL", TRACKS)
def known_number_owners(spark, sf_dir):
    return C.known_owners(tracks(spark, sf_dir))
