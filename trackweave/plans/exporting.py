"""Queries of the flat form and of one object's diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.operators import exporting as X
from trackweave.plans.registry import query, rounded
from trackweave.plans.tracks import TRACKS, tracks

NAMED = {"team_id": "team", "role_detection": "role", "semantic_group_id": "semantic_group", "goalkeeper_palette_match": "palette_match", "jersey_head_confidence": "head", "jersey_winner_margin": "margin", "track_id": "raw_track_id", "jersey_candidates": "candidates"}


def flat(spark, sf_dir):
    return X.flat_rows(tracks(spark, sf_dir), NAMED)


@query("SELECT raw_track_id, raw_track_id AS track_id, 'players' AS track_group, coalesce(player_id, 'unknown') AS player_id, team AS team_id, jersey_number, coalesce(jersey_votes, 0) AS jersey_votes, round(1e-9 + coalesce(jersey_confidence, 0), 6) AS jersey_confidence, head AS jersey_head_confidence, false AS interpolated, 0 AS scene_segment_id, CAST(NULL AS VARCHAR) AS crop_path FROM r", TRACKS)
def flat_rows(spark, sf_dir):
    return flat(spark, sf_dir).select("raw_track_id", "track_id", "track_group", "player_id", "team_id", "jersey_number", "jersey_votes", rounded("jersey_confidence", 6).alias("jersey_confidence"), "jersey_head_confidence", "interpolated", "scene_segment_id", "crop_path")


@query("SELECT raw_track_id, player_id, team AS team_id, jersey_number, head AS jersey_head_confidence, palette_match AS goalkeeper_palette_match, len(candidates) AS n, candidates[2].jersey_number AS second FROM r", TRACKS)
def parsed_rows(spark, sf_dir):
    out = X.parsed_rows(X.as_text(flat(spark, sf_dir)))
    return out.select("raw_track_id", "player_id", "team_id", "jersey_number", "jersey_head_confidence", "goalkeeper_palette_match", F.size("jersey_candidates").alias("n"), F.col("jersey_candidates")[1]["jersey_number"].alias("second"))


@query("SELECT track_group, count(*) AS n, count(DISTINCT raw_track_id) AS ids FROM (SELECT CASE WHEN coalesce(role = 'referee', false) THEN 'referees' ELSE 'players' END AS track_group, raw_track_id FROM r) GROUP BY ALL", TRACKS)
def player_referee_union(spark, sf_dir):
    seen = tracks(spark, sf_dir).select("raw_track_id", "role")
    referee = F.coalesce(F.col("role") == "referee", F.lit(False))
    both = X.both_groups(seen.where(~referee), seen.where(referee).drop("role"))
    return both.groupBy("track_group").agg(F.count("*").alias("n"), F.countDistinct("raw_track_id").alias("ids"))


JUMPS = """, o1 AS (SELECT *, frame * 1000000000 + raw_track_id AS sq FROM r), jp AS (SELECT display_track_id, sq, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS jump, frame - lag(frame) OVER w AS gap FROM o1 WHERE raw_track_id % 4 > 0 WINDOW w AS (PARTITION BY display_track_id ORDER BY sq))"""


def objects(spark, sf_dir):
    seen = F.col("raw_track_id") % 4 > 0
    return tracks(spark, sf_dir).withColumns({"x": F.when(seen, F.col("x")), "at": F.col("frame") * 1000000000 + F.col("raw_track_id")})


@query("SELECT display_track_id, n AS rows, coalesce(detected, 0) AS detected, round(1e-9 + mean_jump, 5) AS mean_jump, round(1e-9 + median_jump, 5) AS median_jump, round(1e-9 + p95_jump, 5) AS p95_jump, round(1e-9 + max_jump, 5) AS max_jump FROM (SELECT display_track_id, count(*) AS n FROM o1 GROUP BY 1) LEFT JOIN (SELECT display_track_id, count(*) AS detected, avg(jump) AS mean_jump, quantile_cont(jump, 0.5) AS median_jump, quantile_cont(jump, 0.95) AS p95_jump, max(jump) AS max_jump FROM jp GROUP BY 1) USING (display_track_id)", TRACKS + JUMPS)
def object_report(spark, sf_dir):
    out = X.object_report(objects(spark, sf_dir), ["display_track_id"], "at", "x", "y").drop("max_gap")
    return out.withColumns({c: rounded(c, 5) for c in ("mean_jump", "median_jump", "p95_jump", "max_jump")})


@query("SELECT display_track_id, sq AS at_row, round(1e-9 + jump, 5) AS jump, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY display_track_id ORDER BY jump DESC, sq) AS rank FROM jp WHERE jump IS NOT NULL) WHERE rank <= 20", TRACKS + JUMPS)
def largest_jumps(spark, sf_dir):
    out = X.largest_jumps(objects(spark, sf_dir), ["display_track_id"], "at", "x", "y")
    return out.select("display_track_id", F.col("at").alias("at_row"), rounded("jump", 5).alias("jump"), "rank")
