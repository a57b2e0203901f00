"""Queries of run merging and of audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.operators import merging as M
from trackweave.plans.registry import query, rounded
from trackweave.plans.tracks import TRACKS, players, tracks

#: The base run knows little: a display is a track's quarter of the month, and only some of these have players or numbers.
RUNS = """,
disp AS (SELECT *, display_track_id * 10 + frame // 180 AS display, frame * 1000000000 + raw_track_id AS sq FROM r),
base AS (SELECT video, frame, raw_track_id, display, sq, team, crop_quality, CASE WHEN display % 3 = 0 THEN jersey_number END AS jersey_number, CASE WHEN display % 3 = 0 THEN jersey_confidence END AS jersey_confidence, CASE WHEN display % 6 = 0 THEN player_id END AS player_id, CASE WHEN display % 6 = 0 THEN identity_confidence END AS identity_confidence FROM disp WHERE team_confidence >= 0.05 OR jersey_number IS NOT NULL),
aux AS (SELECT video, frame, display, sq, team, CASE WHEN jersey_number % 10 < 4 THEN jersey_number % 4 * 9 + 1 END AS jersey_number, jersey_confidence, player_id, identity_confidence FROM disp WHERE team IS NOT NULL OR semantic_group IS NOT NULL),
wn AS (SELECT video, display, team, jersey_number, count(*) AS support_frames, avg(coalesce(jersey_confidence, 0)) AS mean_confidence, quantile_cont(coalesce(jersey_confidence, 0), 0.5) AS median_confidence, quantile_cont(coalesce(jersey_confidence, 0), 0.75) AS p75_confidence, avg(coalesce(identity_confidence, 0)) AS mean_identity, quantile_cont(coalesce(identity_confidence, 0), 0.5) AS median_identity
  FROM aux WHERE team IS NOT NULL AND jersey_number IS NOT NULL GROUP BY video, display, team, jersey_number QUALIFY row_number() OVER (PARTITION BY video, display ORDER BY count(*) DESC, min(sq)) = 1),
unk AS (SELECT video, display FROM base GROUP BY ALL HAVING count(player_id) = 0 AND count(jersey_number) = 0)"""


def _disp(spark, sf_dir):
    return tracks(spark, sf_dir).withColumns({"display": F.col("display_track_id") * 10 + F.floor(F.col("frame") / 180), "at": F.col("frame") * 1000000000 + F.col("raw_track_id")})


def base(spark, sf_dir):
    out = _disp(spark, sf_dir).where("team_confidence >= 0.05 OR jersey_number IS NOT NULL")
    third, sixth = F.col("display") % 3 == 0, F.col("display") % 6 == 0
    return out.withColumns({"jersey_number": F.when(third, F.col("jersey_number")), "jersey_confidence": F.when(third, F.col("jersey_confidence")), "player_id": F.when(sixth, F.col("player_id")), "identity_confidence": F.when(sixth, F.col("identity_confidence"))})


def aux(spark, sf_dir):
    return _disp(spark, sf_dir).where("team is not null or semantic_group is not null").withColumn("jersey_number", F.when(F.col("jersey_number") % 10 < 4, F.col("jersey_number") % 4 * 9 + 1))


@query("SELECT video, display, team, jersey_number, support_frames, round(1e-9 + mean_confidence, 6) AS mean_confidence, round(1e-9 + median_confidence, 6) AS median_confidence, round(1e-9 + p75_confidence, 6) AS p75_confidence, round(1e-9 + mean_identity, 6) AS mean_identity, round(1e-9 + median_identity, 6) AS median_identity FROM wn", TRACKS + RUNS)
def display_winners(spark, sf_dir):
    return M.display_winners(aux(spark, sf_dir)).withColumns({c: rounded(c, 6) for c in ("mean_confidence", "median_confidence", "p75_confidence", "mean_identity", "median_identity")})


@query("SELECT * FROM unk", TRACKS + RUNS)
def unknown_displays(spark, sf_dir):
    return M.unknown_displays(base(spark, sf_dir))


JUDGED = """,
w1 AS (SELECT *, median_confidence AS filter_confidence, support_frames * median_confidence AS support_score, count(*) OVER (PARTITION BY video, team, jersey_number) AS spread FROM wn),
pl AS (SELECT team, jersey_number, list_sort(list(player_id)) AS players FROM players WHERE team IS NOT NULL AND jersey_number IS NOT NULL GROUP BY ALL),
w2 AS (SELECT w1.*, coalesce(players, []) AS players FROM w1 LEFT JOIN pl USING (team, jersey_number)),
pc AS (SELECT video, players[1] AS player, count(*) AS n FROM w2 WHERE NOT (support_frames < 3 AND support_score < 1.0) AND filter_confidence >= 0.2 AND spread <= 12 AND len(players) = 1 GROUP BY ALL),
jd AS (SELECT b.video, b.display, w2.* EXCLUDE (video, display), coalesce(pc.n, 0) AS player_displays, CASE WHEN unk.display IS NULL THEN 'baseline_not_unknown' WHEN jersey_number IS NULL THEN 'no_aux_winner' WHEN support_frames < 3 AND support_score < 1.0 THEN 'below_min_support_score' WHEN filter_confidence < 0.2 THEN 'below_min_jersey_confidence'
    WHEN spread > 12 THEN 'jersey_display_spread' WHEN len(players) <> 1 THEN 'not_unique_roster_player' WHEN jersey_number BETWEEN 1 AND 9 AND filter_confidence < 0.5 AND coalesce(pc.n, 0) < 3 THEN 'single_digit_low_confidence_single_fragment' END AS rejection
  FROM (SELECT video, display FROM base INTERSECT SELECT video, display FROM aux) b LEFT JOIN unk USING (video, display) LEFT JOIN w2 USING (video, display) LEFT JOIN pc ON b.video = pc.video AND w2.players[1] = pc.player)"""
RULES = {"min_frames": 3, "min_score": 1.0, "min_confidence": 0.2, "stat": "median", "max_spread": 12, "single_confidence": 0.5, "single_displays": 3}


def judged(spark, sf_dir):
    return M.judged(base(spark, sf_dir), aux(spark, sf_dir), players(spark, sf_dir), **RULES)


@query("SELECT video, display, team, jersey_number, support_frames, round(1e-9 + support_score, 5) AS support_score, spread, player_displays, rejection, CASE WHEN rejection IS NULL THEN players[1] END AS player_id FROM jd", TRACKS + RUNS + JUDGED)
def merge_candidates(spark, sf_dir):
    return judged(spark, sf_dir).select("video", "display", "team", "jersey_number", "support_frames", rounded("support_score", 5).alias("support_score"), "spread", F.coalesce("player_displays", F.lit(0)).alias("player_displays"), "rejection", "player_id")


CLASH = """,
ok AS (SELECT *, players[1] AS player FROM jd WHERE rejection IS NULL),
clash AS (SELECT DISTINCT m.video, m.display, m.frame, x.reason, o.display AS other FROM (SELECT DISTINCT base.video, base.display, frame, player, ok.team AS t, ok.jersey_number AS n FROM base JOIN ok ON base.video = ok.video AND base.display = ok.display) m JOIN base o ON m.video = o.video AND m.frame = o.frame AND m.display <> o.display
  JOIN (VALUES ('duplicate_player_id'), ('duplicate_team_jersey')) x(reason) ON (x.reason = 'duplicate_player_id' AND o.player_id = m.player) OR (x.reason = 'duplicate_team_jersey' AND o.team = m.t AND o.jersey_number = m.n)),
fr AS (SELECT b.video, b.display, count(*) AS frames, count(c.frame) AS conflict_frames FROM (SELECT DISTINCT video, display, frame FROM base) b JOIN ok ON b.video = ok.video AND b.display = ok.display LEFT JOIN (SELECT DISTINCT video, display, frame FROM clash) c ON b.video = c.video AND b.display = c.display AND b.frame = c.frame GROUP BY ALL),
rs AS (SELECT jd.* EXCLUDE (rejection), conflict_frames, frames - conflict_frames AS valid_frames, conflict_frames > 0 AND (frames - conflict_frames >= 3 OR (frames - conflict_frames) * filter_confidence >= 1.0) AS partial,
  CASE WHEN conflict_frames > 0 AND NOT (frames - conflict_frames >= 3 OR (frames - conflict_frames) * filter_confidence >= 1.0) THEN 'frame_conflict' ELSE rejection END AS rejection FROM jd LEFT JOIN fr USING (video, display))"""


@query("SELECT * FROM clash", TRACKS + RUNS + JUDGED + CLASH)
def merge_conflicts(spark, sf_dir):
    return M.frame_conflicts(base(spark, sf_dir), judged(spark, sf_dir).where("rejection is null"))


def resolved(spark, sf_dir):
    return M.resolved(base(spark, sf_dir), judged(spark, sf_dir), min_frames=3, min_score=1.0, partial=True)


@query("SELECT video, display, conflict_frames, valid_frames, coalesce(partial, false) AS partial, rejection FROM rs", TRACKS + RUNS + JUDGED + CLASH)
def merge_resolutions(spark, sf_dir):
    return resolved(spark, sf_dir).select("video", "display", "conflict_frames", "valid_frames", F.coalesce("partial", F.lit(False)).alias("partial"), "rejection")


MERGED = """,
mg AS (SELECT b.*, rs.players[1] AS cp, rs.team AS ct, rs.jersey_number AS cn, rs.mean_confidence AS cc, rs.display IS NOT NULL AND c.frame IS NULL AS merged FROM base b LEFT JOIN (SELECT * FROM rs WHERE rejection IS NULL) rs ON b.video = rs.video AND b.display = rs.display LEFT JOIN (SELECT DISTINCT video, display, frame FROM clash) c ON b.video = c.video AND b.display = c.display AND b.frame = c.frame),
fin AS (SELECT video, frame, raw_track_id, display, merged, CASE WHEN merged THEN cp ELSE player_id END AS player_id, CASE WHEN merged THEN ct ELSE team END AS team, CASE WHEN merged THEN cn ELSE jersey_number END AS jersey_number, CASE WHEN merged THEN round(cc, 6) ELSE jersey_confidence END AS jersey_confidence FROM mg)"""


def merged(spark, sf_dir):
    return M.merged(base(spark, sf_dir), resolved(spark, sf_dir))


@query("SELECT raw_track_id, merged, player_id, team, jersey_number, round(1e-9 + jersey_confidence, 5) AS jersey_confidence FROM fin", TRACKS + RUNS + JUDGED + CLASH + MERGED)
def merged_rows(spark, sf_dir):
    return merged(spark, sf_dir).select("raw_track_id", "merged", "player_id", "team", "jersey_number", rounded("jersey_confidence", 5).alias("jersey_confidence"))


@query("SELECT video, frame, 'player' AS what, player_id AS value, count(*) AS n FROM fin WHERE player_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT video, frame, 'team_jersey', team || ':' || jersey_number, count(*) FROM fin WHERE team IS NOT NULL AND jersey_number IS NOT NULL GROUP BY ALL HAVING count(*) > 1", TRACKS + RUNS + JUDGED + CLASH + MERGED)
def merged_duplicates(spark, sf_dir):
    return M.duplicate_frames(merged(spark, sf_dir))


ENTRIES = """,
en AS (SELECT CASE WHEN display % 4 = 0 THEN CAST(display AS VARCHAR) ELSE concat(display, ':', frame // 90) END AS key, count(*) AS raw, count(jersey_number) AS voting, count(DISTINCT crop_quality) AS selected, CASE WHEN count(jersey_number) > 3 THEN 'assigned' WHEN count(jersey_number) > 0 THEN 'insufficient_votes' ELSE 'no_valid_vote' END AS status FROM base WHERE display % 5 <> 2 GROUP BY 1
  UNION ALL SELECT concat(display, ':x'), 1, 1, 1, 'assigned' FROM base WHERE display % 8 = 0 GROUP BY display),
ed AS (SELECT * EXCLUDE (has, exact) FROM (SELECT *, max(exact) OVER (PARTITION BY display) AS has FROM (SELECT *, split_part(key, ':', 1) AS display, CASE WHEN contains(key, ':') THEN 0 ELSE 1 END AS exact FROM en)) WHERE has = 0 OR exact = 1)"""


def entries(spark, sf_dir):
    b = base(spark, sf_dir)
    key = F.when(F.col("display") % 4 == 0, F.col("display").cast("string")).otherwise(F.concat_ws(":", "display", F.floor(F.col("frame") / 90).cast("string")))
    n = F.count("jersey_number")
    one = b.where("display % 5 <> 2").groupBy(key.alias("key")).agg(F.count("*").alias("raw"), n.alias("voting"), F.countDistinct("crop_quality").alias("selected"), F.when(n > 3, "assigned").when(n > 0, "insufficient_votes").otherwise("no_valid_vote").alias("status"))
    more = b.where("display % 8 = 0").select(F.concat_ws(":", F.col("display").cast("string"), F.lit("x")).alias("key")).distinct().select("key", F.lit(1).alias("raw"), F.lit(1).alias("voting"), F.lit(1).alias("selected"), F.lit("assigned").alias("status"))
    return M.for_display(one.unionByName(more), "key")


@query("SELECT display, key, status, raw FROM ed", TRACKS + RUNS + ENTRIES)
def display_entries(spark, sf_dir):
    return entries(spark, sf_dir).select("display", "key", "status", "raw")


REPORT = """,
up AS (SELECT CAST(video AS BIGINT) AS video, display, count(*) AS n_frames, min(frame) AS start_frame, max(frame) AS end_frame, avg(crop_quality) AS q, max(crop_quality) AS max_quality, arg_max(raw_track_id, crop_quality * 1000000 - frame) AS best_crop FROM base JOIN unk USING (video, display) GROUP BY ALL),
st AS (SELECT display, status AS primary_status FROM (SELECT display, status, count(*) AS n FROM ed GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY display ORDER BY n DESC, status) = 1),
ss AS (SELECT display, sum(raw) AS raw, sum(voting) AS voting, sum(selected) AS selected FROM ed GROUP BY display)"""


@query("SELECT video, up.display, n_frames, start_frame, end_frame, round(1e-9 + q, 6) AS mean_quality, max_quality, best_crop, coalesce(primary_status, 'not_attempted') AS primary_status, coalesce(raw, 0) AS raw, coalesce(voting, 0) AS voting, coalesce(selected, 0) AS selected, CASE WHEN q > 0.30 THEN 'high' WHEN q > 0.10 THEN 'mid' ELSE 'low' END AS quality_bucket FROM up LEFT JOIN st ON CAST(up.display AS VARCHAR) = st.display LEFT JOIN ss ON CAST(up.display AS VARCHAR) = ss.display", TRACKS + RUNS + ENTRIES + REPORT)
def unknown_report(spark, sf_dir):
    e = entries(spark, sf_dir).withColumn("display", F.col("display").cast("long"))
    return M.unknown_report(base(spark, sf_dir).withColumn("crop", F.col("raw_track_id")), e).withColumn("mean_quality", rounded("mean_quality", 6))


@query("SELECT video, display FROM unk WHERE CAST(display AS VARCHAR) IN (SELECT display FROM ed)", TRACKS + RUNS + ENTRIES)
def audit_displays(spark, sf_dir):
    return M.audit_displays(base(spark, sf_dir), entries(spark, sf_dir).withColumn("display", F.col("display").cast("long")))


@query("SELECT display, name, n, rank FROM (SELECT display, name, sum(c) AS n, CAST(row_number() OVER (PARTITION BY display ORDER BY sum(c) DESC, name) AS INTEGER) AS rank FROM (SELECT display, status AS name, raw AS c FROM ed UNION ALL SELECT display, 'all', voting FROM ed) GROUP BY display, name) WHERE rank <= 2", TRACKS + RUNS + ENTRIES)
def display_counters(spark, sf_dir):
    e = entries(spark, sf_dir).withColumn("counts", F.create_map(F.col("status"), F.col("raw"), F.lit("all"), F.col("voting")))
    return M.counted(e, ["display"], "counts", most=2)


HITS = """,
rej AS (SELECT video, display, frame, raw_track_id, kind FROM (SELECT video, display, frame, raw_track_id, CASE WHEN jersey_number % 5 = 0 THEN 'invalid_number' END AS a, CASE WHEN crop_quality < 0.2 THEN 'low_quality' END AS b FROM base), LATERAL (SELECT a AS kind UNION ALL SELECT b) x WHERE kind IS NOT NULL),
hit AS (SELECT *, CAST(row_number() OVER (PARTITION BY video, display ORDER BY kind, frame, raw_track_id) AS INTEGER) AS place FROM rej QUALIFY place <= 4)"""


def hits(spark, sf_dir):
    b = base(spark, sf_dir)
    kinds = F.array_compact(F.array(F.when(F.col("jersey_number") % 5 == 0, "invalid_number"), F.when(F.col("crop_quality") < 0.2, "low_quality")))
    return M.constraint_hits(b.select("video", "display", "frame", "raw_track_id", F.explode(kinds).alias("kind")), most=4)


@query("SELECT video, display, frame, raw_track_id, kind, place FROM hit", TRACKS + RUNS + HITS)
def constraint_hits(spark, sf_dir):
    return hits(spark, sf_dir)


@query("SELECT video, display, CASE WHEN display % 11 = 0 THEN 'roster_filter:number_not_in_team_roster' WHEN display % 13 = 0 THEN 'goalkeeper_ocr_filter:goalkeeper_tracklet' WHEN kind IS NOT NULL THEN 'constraint:' || kind WHEN display % 3 = 1 THEN 'hungarian_gate:insufficient_assignment_evidence' WHEN read THEN 'ocr_assigned_but_not_propagated_unclear' ELSE 'no_ocr_assignment' END AS cause FROM (SELECT unk.*, CAST(unk.display AS VARCHAR) IN (SELECT display FROM ed) AS read FROM unk) LEFT JOIN (SELECT video, display, kind FROM hit WHERE place = 1) USING (video, display)", TRACKS + RUNS + ENTRIES + HITS)
def likely_causes(spark, sf_dir):
    read = entries(spark, sf_dir).select(F.col("display").cast("long").alias("display")).distinct().withColumn("read", F.lit(True))
    shown = M.unknown_displays(base(spark, sf_dir)).join(hits(spark, sf_dir).where("place = 1").select("video", "display", "kind"), ["video", "display"], "left").join(read, "display", "left")
    of = lambda n, value: F.when(F.col("display") % n == 0, value)
    cause = M.likely_cause(of(11, "number_not_in_team_roster"), of(13, "goalkeeper_tracklet"), F.lit(None).cast("string"), F.col("kind"), F.when(F.col("display") % 3 == 1, "insufficient_assignment_evidence"), F.lit(False), F.coalesce("read", F.lit(False)))
    return shown.select("video", "display", cause.alias("cause"))


KEEPERS = ", kp AS (SELECT video, display FROM (SELECT *, coalesce(role IN ('goalkeeper', 'keeper', 'gk'), false) OR coalesce(semantic_group IN (3, 4), false) AS k FROM disp WHERE team_confidence >= 0.05 OR jersey_number IS NOT NULL) GROUP BY ALL HAVING count(*) FILTER (k) >= greatest(1, floor(count(*) * 0.5)))"


@query("SELECT video, display, jersey_number, kp.display IS NOT NULL AS dropped FROM wn LEFT JOIN kp USING (video, display)", TRACKS + RUNS + KEEPERS)
def keeper_readings(spark, sf_dir):
    from trackweave.operators.assignment import keeper_tracklets

    keepers = keeper_tracklets(base(spark, sf_dir).withColumn("track_id", F.col("display"))).withColumnRenamed("track_id", "display")
    kept, dropped = M.without_keeper_readings(M.display_winners(aux(spark, sf_dir)).select("video", "display", "jersey_number"), keepers)
    return kept.withColumn("dropped", F.lit(False)).unionByName(dropped.select("video", "display", "jersey_number", F.lit(True).alias("dropped")))
