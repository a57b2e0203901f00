"""Queries of links by number, colour votes and kits."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.operators import linking as L
from trackweave.operators.stateful import frame_ranges
from trackweave.plans.registry import query, rounded
from trackweave.plans.tracks import TRACKS, tracks

#: A display is a track's three days; numbers are few, so that some displays share one.
DISPLAYS = """,
dd AS (SELECT * EXCLUDE (jersey_number, display_track_id), display_track_id * 100 + frame // 72 AS display_track_id, CASE WHEN jersey_number % 4 > 0 THEN display_track_id % 5 + 1 END AS jersey_number, frame * 1000000000 + raw_track_id AS sq FROM r),
dn AS (SELECT video, display_track_id, jersey_number, max(coalesce(jersey_confidence, 0)) AS confidence, max(coalesce(head, 0)) AS head, max(coalesce(margin, 0)) AS margin, max(coalesce(jersey_votes, 0)) AS votes FROM dd WHERE jersey_number IS NOT NULL GROUP BY video, display_track_id, jersey_number QUALIFY row_number() OVER (PARTITION BY video, display_track_id ORDER BY count(*) DESC, min(sq)) = 1),
dt AS (SELECT video, display_track_id, team, avg(team_confidence) AS team_confidence FROM dd WHERE team IS NOT NULL GROUP BY video, display_track_id, team QUALIFY row_number() OVER (PARTITION BY video, display_track_id ORDER BY count(*) DESC, min(sq)) = 1),
sm AS (SELECT *, num_frames >= 3 AND jersey_number IS NOT NULL AND team IS NOT NULL AND coalesce(confidence, 0) >= 0.35 AND coalesce(head, 0) >= 0.6 AND coalesce(margin, 0) >= 0.1 AND coalesce(votes, 0) >= 4 AS reliable FROM (SELECT video, display_track_id, count(*) AS num_frames, min(frame) AS start, max(frame) AS end_, arg_min(x, sq) AS first_x, arg_max(x, sq) AS last_x, arg_min(y, sq) AS first_y, arg_max(y, sq) AS last_y FROM dd GROUP BY ALL) LEFT JOIN dn USING (video, display_track_id) LEFT JOIN dt USING (video, display_track_id))"""


def rows(spark, sf_dir):
    seen = tracks(spark, sf_dir)
    return seen.withColumns({"jersey_number": F.when(F.col("jersey_number") % 4 > 0, F.col("display_track_id") % 5 + 1).cast("int"), "display_track_id": F.col("display_track_id") * 100 + F.floor(F.col("frame") / 72), "at": F.col("frame") * 1000000000 + F.col("raw_track_id")})


def summaries(spark, sf_dir):
    return L.number_summaries(rows(spark, sf_dir), min_frames=3)


@query("SELECT video, display_track_id, num_frames, start, end_ AS end, first_x, last_y, team, round(1e-9 + coalesce(team_confidence, 0), 6) AS team_confidence, jersey_number, round(1e-9 + coalesce(confidence, 0), 6) AS confidence, coalesce(votes, 0) AS votes, reliable FROM sm", TRACKS + DISPLAYS)
def number_summaries(spark, sf_dir):
    return summaries(spark, sf_dir).select("video", "display_track_id", "num_frames", "start", "end", "first_x", "last_y", "team", rounded("team_confidence", 6).alias("team_confidence"), "jersey_number", rounded("confidence", 6).alias("confidence"), "votes", "reliable")


@query(None)
def number_links(spark, sf_dir):
    return L.number_links(summaries(spark, sf_dir), frame_ranges(rows(spark, sf_dir), L.KEY, "frame"), max_gap=300, max_distance=400.0)


@query(None)
def relinked_rows(spark, sf_dir):
    return L.relinked(rows(spark, sf_dir), L.number_links(summaries(spark, sf_dir), frame_ranges(rows(spark, sf_dir), L.KEY, "frame"), max_gap=300, max_distance=400.0)).select("video", "frame", "raw_track_id", "display_track_id", "previous_display_id")


#: Two colour scores of each row, one for each team.
SCORES = """, cs AS (SELECT video, display_track_id, raw_track_id, t AS choice, CAST((raw_track_id * (7 + 6 * t) + t * 13) % 50 AS DOUBLE) / 100 AS score FROM r, (VALUES (1), (2)) x(t)),
ch AS (SELECT video, display_track_id, raw_track_id, CASE WHEN score >= 0.16 AND score - next >= 0.04 - 1e-12 THEN choice END AS choice, score AS best_score, score - next AS margin FROM (SELECT *, coalesce(lead(score) OVER (PARTITION BY raw_track_id ORDER BY score DESC, choice), 0) AS next, row_number() OVER (PARTITION BY raw_track_id ORDER BY score DESC, choice) AS k FROM cs) WHERE k = 1)"""


def choices(spark, sf_dir):
    seen = tracks(spark, sf_dir).select("video", "display_track_id", "raw_track_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("choice"))
    scores = seen.withColumn("score", ((F.col("raw_track_id") * (7 + 6 * F.col("choice")) + F.col("choice") * 13) % 50).cast("double") / 100)
    return L.palette_choice(scores, ["video", "display_track_id", "raw_track_id"], "choice", "score", min_margin=0.04 - 1e-12)


@query("SELECT raw_track_id, choice, best_score, round(1e-9 + margin, 6) AS margin FROM ch", TRACKS + SCORES)
def palette_choices(spark, sf_dir):
    return choices(spark, sf_dir).select("raw_track_id", "choice", "best_score", rounded("margin", 6).alias("margin"))


@query("SELECT video, display_track_id, samples, choice, votes, round(1e-9 + mean_score, 6) AS mean_score, round(1e-9 + mean_margin, 6) AS mean_margin, round(1e-9 + coalesce(votes, 0) / samples, 6) AS confidence FROM (SELECT video, display_track_id, count(*) AS samples, coalesce(avg(margin) FILTER (choice IS NOT NULL), 0) AS mean_margin FROM ch GROUP BY ALL) LEFT JOIN (SELECT video, display_track_id, choice, count(*) AS votes, avg(best_score) AS mean_score FROM ch WHERE choice IS NOT NULL GROUP BY video, display_track_id, choice QUALIFY row_number() OVER (PARTITION BY video, display_track_id ORDER BY count(*) DESC, choice) = 1) USING (video, display_track_id)", TRACKS + SCORES)
def team_palette_votes(spark, sf_dir):
    out = L.palette_votes(choices(spark, sf_dir), ["video", "display_track_id"], "choice")
    return out.withColumns({c: rounded(c, 6) for c in ("mean_score", "mean_margin", "confidence")})


REF = """, rc AS (SELECT video, display_track_id, CASE WHEN raw_track_id % 2 = 0 THEN 'yellow' ELSE 'black' END AS colour, referee_score AS score FROM r WHERE referee_score > 0.2),
rm AS (SELECT video, display_track_id, colour, avg(score) AS m, count(*) AS n, sum(count(*)) OVER (PARTITION BY video, display_track_id) AS num_samples FROM rc GROUP BY video, display_track_id, colour QUALIFY row_number() OVER (PARTITION BY video, display_track_id ORDER BY avg(score) DESC, count(*) DESC, colour) = 1)"""


def referee_samples(spark, sf_dir):
    return tracks(spark, sf_dir).where("referee_score > 0.2").withColumn("colour", F.when(F.col("raw_track_id") % 2 == 0, "yellow").otherwise("black"))


@query("SELECT raw_track_id, colour AS referee_colour, coalesce(m >= 0.4 AND num_samples >= 3, false) AS referee_match, CASE WHEN coalesce(m >= 0.4 AND num_samples >= 3, false) AND coalesce(role, 'player') = 'player' THEN 'referee_candidate' ELSE role END AS role FROM r LEFT JOIN rm USING (video, display_track_id)", TRACKS + REF)
def referee_colours(spark, sf_dir):
    summary = L.colour_summary(referee_samples(spark, sf_dir), L.KEY, ["colour"], "referee_score", order="raw_track_id", count_all=True)
    return L.with_referees(tracks(spark, sf_dir), summary, min_score=0.4).select("raw_track_id", "referee_colour", "referee_match", "role")


@query("SELECT raw_track_id, coalesce(m >= 0.25 AND n >= 3, false) AS keeper_match, CASE WHEN coalesce(m >= 0.25 AND n >= 3, false) AND role = 'goalkeeper' THEN keeper_kit ELSE team END AS team FROM r LEFT JOIN (SELECT video, display_track_id, keeper_team AS keeper_kit, colour, avg(keeper_score) AS m, count(*) AS n FROM (SELECT *, CASE WHEN raw_track_id % 3 = 0 THEN 'green' ELSE 'grey' END AS colour FROM r WHERE keeper_score IS NOT NULL AND keeper_team IS NOT NULL) GROUP BY video, display_track_id, keeper_team, colour QUALIFY row_number() OVER (PARTITION BY video, display_track_id ORDER BY avg(keeper_score) DESC, count(*) DESC, keeper_team, colour) = 1) USING (video, display_track_id)", TRACKS)
def keeper_colours(spark, sf_dir):
    seen = tracks(spark, sf_dir)
    samples = seen.where("keeper_score is not null and keeper_team is not null").select(*L.KEY, "raw_track_id", "keeper_score", F.col("keeper_team").alias("kit_team"), F.when(F.col("raw_track_id") % 3 == 0, "green").otherwise("grey").alias("colour"))
    summary = L.colour_summary(samples, L.KEY, ["kit_team", "colour"], "keeper_score", order="raw_track_id", count_all=False)
    return L.with_keepers(seen, summary, min_score=0.25).select("raw_track_id", "keeper_match", "team")


@query("SELECT video, frame FROM (SELECT *, count(*) OVER w AS f, coalesce(sum(n) OVER w, 0) AS c FROM (SELECT video, frame, count(team) AS n FROM r GROUP BY ALL) WINDOW w AS (PARTITION BY video ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE f < 12 OR c < 40", TRACKS)
def seed_frames(spark, sf_dir):
    return L.seed_frames(tracks(spark, sf_dir).withColumn("colour", F.col("team")), min_colours=40)


@query(None)
def kit_clusters(spark, sf_dir):
    seen = tracks(spark, sf_dir).withColumn("colour", F.array(F.col("x"), F.col("y") + F.when(F.col("team") == 1, 200.0).otherwise(0.0)))
    centres = L.two_kits(seen, "colour")
    return L.kit_votes(seen, L.KEY, "colour", centres or [[0.0, 0.0], [0.0, 200.0]]).withColumns({c: rounded(c, 4) for c in ("mean_margin", "confidence")}).drop("mean_score")
