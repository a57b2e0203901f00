"""Queries of crops, readings, votes, the roster filter and segment candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.operators import readings as R
from trackweave.plans.registry import query, rounded, table
from trackweave.plans.tracks import TRACKS, players, tracks

#: Readings from events; a crop is a display's half day.
COLUMNS = {
    "reading": "event_id",
    "display": "user_id",
    "frame": "CAST(floor(sec / 3600) AS BIGINT) - 473352",
    "crop": "concat(user_id, '-', CAST(floor(sec / 43200) AS BIGINT))",
    "number": "CASE WHEN event_id % 7 > 0 THEN CAST(nullif(k % 40, 0) AS INT) END",
    "confidence": "CASE WHEN event_id % 10 > 0 THEN least(1.0, value / 120) END",
    "channel": "CASE WHEN event_id % 4 = 0 THEN 'direct' WHEN event_id % 4 = 1 THEN 'det' WHEN event_id % 4 = 2 THEN 'direct' END",
    "source": "CASE WHEN event_id % 5 > 0 THEN event_type END",
    "variant": "CASE WHEN event_id % 6 > 0 THEN concat('upper_', event_id % 6) END",
    "vote_weight": "CASE WHEN event_id % 9 > 0 THEN CAST(event_id % 3 AS DOUBLE) / 2 + 0.5 WHEN event_id % 18 = 0 THEN CAST(0 AS DOUBLE) END",
    "text": "CASE WHEN event_id % 14 = 0 THEN 'abc' WHEN event_id % 21 = 0 THEN '' ELSE CAST(k AS STRING) END",
    "error": "CASE WHEN event_id % 35 = 0 THEN 'failed' END",
    "quality": "CAST(event_id * 29 % 100 AS DOUBLE) / 100",
    "x1": "value", "y1": "CAST(k AS DOUBLE)", "x2": "value + 20 + event_id % 40", "y2": "CAST(k AS DOUBLE) + 60 + event_id % 150",
}
READINGS = f"g AS (SELECT {', '.join(f'{e} AS {c}' for c, e in COLUMNS.items())} FROM (SELECT *, epoch(ts) AS sec, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"


def readings(spark, sf_dir):
    base = table(spark, sf_dir, "events").withColumns({"k": F.get_json_object("props", "$.k").cast("int"), "sec": F.col("ts").cast("timestamp").cast("double")})
    return base.select(*[F.expr(e).alias(c) for c, e in COLUMNS.items()])


@query("SELECT raw_track_id FROM r WHERE NOT coalesce(lower(role) IN ('referee', 'referee_candidate'), false) AND NOT coalesce(semantic_group = 5, false)", TRACKS)
def readable_rows(spark, sf_dir):
    return R.eligible_rows(tracks(spark, sf_dir)).select("raw_track_id")


SCORE = "quality + (least(0.4, (x2 - x1) * (y2 - y1) / 50000) + CASE WHEN (y2 - y1) / (x2 - x1) BETWEEN 1.6 AND 4.5 THEN 0.15 ELSE 0 END)"


@query(f"SELECT reading, round(1e-9 + {SCORE}, 5) AS score, round(1e-9 + greatest(0, least(1, (x2 - x1) * (y2 - y1) / 800000 / 0.02) + least(0.2, (y2 - y1) / 500) - CASE WHEN x1 <= 1 OR y1 <= 1 OR x2 >= 999 THEN 0.4 ELSE 0 END), 5) AS quality, round(1e-9 + CASE WHEN reading % 3 = 0 OR quality <= 0 THEN coalesce(confidence, 0) ELSE coalesce(confidence, 0) * (0.75 + 0.25 * quality) END, 5) AS combined FROM g", READINGS)
def crop_scores(spark, sf_dir):
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    detection = F.when(F.col("reading") % 3 != 0, F.col("quality"))
    return readings(spark, sf_dir).select("reading", rounded(R.crop_score(F.col("quality"), *box), 5).alias("score"), rounded(R.crop_quality(*box, F.lit(1000), F.lit(800)), 5).alias("quality"), rounded(R.combined_confidence(F.col("confidence"), detection), 5).alias("combined"))


def _spread(most: int, passes: int, at_pass: int) -> str:
    return f"""SELECT display, reading, in_bucket, in_top FROM (SELECT *, row_number() OVER (PARTITION BY display ORDER BY in_bucket DESC, CASE WHEN in_bucket THEN pos ELSE top END) AS place FROM (
  SELECT *, chosen AND row_number() OVER (PARTITION BY display, bucket ORDER BY quality DESC, frame, crop, reading) = 1 AS in_bucket, top <= greatest(1, target // 2) AS in_top FROM (
    SELECT s.*, b.bucket, b.bucket IN (SELECT least(s.buckets - 1, i * {passes} + {at_pass}) FROM range(0, s.target) q(i)) AS chosen FROM (
      SELECT *, least({most}, n) AS target, least(n, least({most}, n) * {passes}) AS buckets FROM (
        SELECT *, count(*) OVER (PARTITION BY display) AS n, row_number() OVER (PARTITION BY display ORDER BY frame, crop, reading) - 1 AS pos, row_number() OVER (PARTITION BY display ORDER BY {SCORE} DESC, frame, crop, reading) AS top FROM g)) s
    JOIN (SELECT n, buckets, bucket, CAST(round_even(bucket * n / buckets, 0) AS BIGINT) AS low, CAST(round_even((bucket + 1) * n / buckets, 0) AS BIGINT) AS high FROM (SELECT DISTINCT n, least(n, least({most}, n) * {passes}) AS buckets FROM (SELECT count(*) AS n FROM g GROUP BY display)) z, range(0, z.buckets) w(bucket)) b
    ON s.n = b.n AND s.pos >= b.low AND s.pos < b.high)) WHERE in_bucket OR in_top) WHERE place <= 2 * {most}"""


@query(_spread(7, 2, 1), READINGS)
def spread_crops(spark, sf_dir):
    crops = readings(spark, sf_dir).withColumn("crop", F.struct("crop", "reading"))
    return R.spread_crops(crops, most=7, passes=2, at_pass=1).select("display", "reading", "in_bucket", "in_top")


@query("""SELECT display, reading, even FROM (SELECT *, row_number() OVER (PARTITION BY display ORDER BY even DESC, CASE WHEN even THEN pos END, area DESC, pos) AS place FROM (
  SELECT *, n <= 9 OR pos IN (SELECT least(s.n - 1, CAST(round_even(i * (s.n - 1) / 8, 0) AS BIGINT)) FROM range(0, 9) q(i)) AS even FROM (
    SELECT *, (x2 - x1) * (y2 - y1) AS area, count(*) OVER (PARTITION BY display) AS n, row_number() OVER (PARTITION BY display ORDER BY frame, crop, reading) - 1 AS pos FROM g) s)) WHERE n <= 9 OR place <= 9""", READINGS)
def even_crops(spark, sf_dir):
    return R.even_crops(readings(spark, sf_dir).withColumn("crop", F.struct("crop", "reading")), most=9).select("display", "reading", "even")


@query(f"""SELECT display, available, CASE WHEN good >= 3 THEN good ELSE available END AS usable, coalesce(taken, 0) AS selected, greatest(0, CASE WHEN good >= 3 THEN good ELSE available END - coalesce(taken, 0)) AS unselected, min_quality, max_quality, round(1e-9 + mean_quality, 6) AS mean_quality FROM (
  SELECT display, count(*) AS available, count(*) FILTER (quality >= 0.6) AS good, min(quality) AS min_quality, max(quality) AS max_quality, avg(quality) AS mean_quality FROM g GROUP BY display) LEFT JOIN (SELECT display, count(*) AS taken FROM ({_spread(7, 1, 0)}) GROUP BY display) USING (display)""", READINGS)
def crop_selection(spark, sf_dir):
    crops = readings(spark, sf_dir).withColumn("crop", F.struct("crop", "reading"))
    return R.selection_report(crops, R.spread_crops(crops, most=7), 0.6).withColumn("mean_quality", rounded("mean_quality", 6))


@query("SELECT DISTINCT c.reading FROM (SELECT reading, crop, CAST(reading % 23 + 1 AS INTEGER) AS number, quality AS confidence FROM g) c LEFT JOIN (SELECT DISTINCT crop, number FROM g WHERE number IS NOT NULL) r USING (crop, number) WHERE r.crop IS NOT NULL OR (c.number >= 10 AND c.confidence >= 0.78)", READINGS)
def template_matches(spark, sf_dir):
    read = readings(spark, sf_dir)
    return R.template_allowed(read.select("reading", "crop", (F.col("reading") % 23 + 1).cast("int").alias("number"), F.col("quality").alias("confidence")), read).select("reading")


@query("SELECT reading, NOT contains(v, 'full_body') AND (contains(v, 'back_number') OR contains(v, 'upper') OR contains(v, 'torso')) AS template, NOT contains(v, 'full_body') AND (contains(v, 'upper_back') OR contains(v, 'center_back') OR contains(v, 'torso') OR contains(v, 'number_band')) AS direct FROM (SELECT reading, CASE reading % 5 WHEN 0 THEN 'full_body_torso' WHEN 1 THEN 'upper_back_2' WHEN 2 THEN 'torso' WHEN 3 THEN 'back_number' ELSE 'legs' END AS v FROM g)", READINGS)
def variant_names(spark, sf_dir):
    v = F.element_at(F.array(*[F.lit(x) for x in ("full_body_torso", "upper_back_2", "torso", "back_number", "legs")]), (F.col("reading") % 5 + 1).cast("int"))
    return readings(spark, sf_dir).select("reading", R.template_variant(v).alias("template"), R.direct_variant(v).alias("direct"))


CROPS = """,
w0 AS (SELECT *, greatest(0.01, coalesce(confidence, 0)) * greatest(0, coalesce(vote_weight, 1)) AS v FROM g WHERE number IS NOT NULL AND greatest(0, coalesce(vote_weight, 1)) > 0),
w1 AS (SELECT *, row_number() OVER (PARTITION BY display, crop, number ORDER BY v DESC, reading) AS s FROM w0),
w2 AS (SELECT display, crop, number, least(1, max(v)) AS confidence, count(*) AS observations, list_sort(list(DISTINCT coalesce(source, 'ocr'))) AS sources, list_sort(list(DISTINCT coalesce(channel, 'unknown'))) AS channels, coalesce(list(variant ORDER BY s) FILTER (s <= 6 AND variant IS NOT NULL), []) AS variants, min(reading) FILTER (s = 1) AS best_reading FROM w1 GROUP BY ALL),
w3 AS (SELECT * REPLACE (CASE WHEN number BETWEEN 1 AND 9 AND channels = ['direct'] THEN least(confidence, 0.01) ELSE confidence END AS confidence), number BETWEEN 1 AND 9 AND channels = ['direct'] AS direct_only, max(CASE WHEN number >= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY display, crop) AS two FROM w2),
w4 AS (SELECT *, greatest(0.01, max(confidence) OVER (PARTITION BY display, crop)) AS top, CAST(row_number() OVER (PARTITION BY display, crop ORDER BY confidence DESC, observations DESC, number) AS INTEGER) AS rank FROM w3 WHERE two = 0 OR number >= 10),
crops AS (SELECT * EXCLUDE (two, top) FROM w4 WHERE confidence >= 0.35 * top AND rank <= 3)"""


@query("SELECT display, crop, number, round(1e-9 + confidence, 6) AS confidence, observations, array_to_string(sources, ',') AS sources, array_to_string(channels, ',') AS channels, array_to_string(variants, ',') AS variants, best_reading, direct_only, rank FROM crops", READINGS + CROPS)
def crop_candidates(spark, sf_dir):
    out = R.by_crop(readings(spark, sf_dir))
    return out.withColumns({"confidence": rounded("confidence", 6)} | {c: F.array_join(c, ",") for c in ("sources", "channels", "variants")})


VOTES = """,
v0 AS (SELECT display, number, sum(greatest(0.01, confidence)) AS score, count(*) AS votes FROM crops WHERE NOT direct_only GROUP BY ALL),
v1 AS (SELECT *, row_number() OVER (PARTITION BY display ORDER BY score DESC, votes DESC, number) AS place, sum(score) OVER (PARTITION BY display) AS total, CAST(sum(votes) OVER (PARTITION BY display) AS BIGINT) AS readings FROM v0),
win AS (SELECT display, CASE WHEN b.score IS NOT NULL AND b.score >= 0.5 * a.score THEN b.number ELSE a.number END AS jersey_number FROM v1 a LEFT JOIN (SELECT display AS d, number, score FROM v0 WHERE number = 11) b ON a.display = b.d AND a.number % 10 = 1 AND a.number <> 11 AND a.number < 40 WHERE place = 1),
voted AS (SELECT w.display, w.jersey_number, a.score, a.votes, a.total, a.readings, coalesce((SELECT max(score) FROM v1 o WHERE o.display = w.display AND o.number <> w.jersey_number), 0) AS next FROM win w JOIN v1 a ON w.display = a.display AND w.jersey_number = a.number)"""
#: Numbers that are often a misread 11.
OVERRIDES = {n: {"prefer": 11, "min_alternative_ratio": 0.5} for n in (1, 21, 31)}


def votes(spark, sf_dir):
    return R.vote(R.by_crop(readings(spark, sf_dir)), ["display"], overrides=OVERRIDES)


@query("SELECT display, jersey_number, round(1e-9 + score / total, 6) AS confidence, round(1e-9 + score / (score + next), 6) AS head, round(1e-9 + (score - next) / total, 6) AS margin, round(1e-9 + CASE WHEN next > 0 THEN score / next END, 5) AS ratio, round(1e-9 + score, 6) AS score, votes, readings FROM voted", READINGS + CROPS + VOTES)
def number_votes(spark, sf_dir):
    return votes(spark, sf_dir).drop("candidates").withColumns({c: rounded(c, 6) for c in ("confidence", "head", "margin", "score")} | {"ratio": rounded("ratio", 5)})


@query("SELECT display, CAST(place - 1 AS INTEGER) AS place, number AS jersey_number, round(1e-9 + score / total, 6) AS confidence, votes, round(1e-9 + score, 6) AS score FROM v1 WHERE place <= 8", READINGS + CROPS + VOTES)
def vote_distributions(spark, sf_dir):
    return votes(spark, sf_dir).select("display", F.posexplode("candidates").alias("place", "c")).select("display", "place", "c.jersey_number", rounded("c.confidence", 6).alias("confidence"), "c.votes", rounded("c.score", 6).alias("score"))


@query("""SELECT display, CASE WHEN votes >= 40 THEN 'assigned' WHEN votes IS NOT NULL THEN 'insufficient_votes' WHEN raw = 0 THEN 'no_raw_detections' WHEN coalesce(voting, 0) = 0 THEN 'no_voting_detections' WHEN direct_only = voting THEN 'only_direct_single_digit_candidates' ELSE 'no_valid_vote' END AS status,
  coalesce(raw, 0) AS raw, backend_error, empty_text, non_numeric_text, below_min_raw_confidence, numbers, coalesce(voting, 0) AS voting, coalesce(direct_only, 0) AS direct_only FROM (
  SELECT display, count(*) AS raw, count(*) FILTER (number IS NULL AND error IS NOT NULL) AS backend_error, count(*) FILTER (number IS NULL AND error IS NULL AND coalesce(text, '') = '') AS empty_text, count(*) FILTER (number IS NULL AND error IS NULL AND coalesce(text, '') <> '') AS non_numeric_text,
    count(*) FILTER (number IS NOT NULL AND coalesce(confidence, 0) < 0.05) AS below_min_raw_confidence, count(DISTINCT number) AS numbers FROM g GROUP BY display)
  LEFT JOIN (SELECT display, count(*) AS voting, count(*) FILTER (direct_only) AS direct_only FROM crops GROUP BY display) USING (display) LEFT JOIN voted USING (display)""", READINGS + CROPS + VOTES)
def reading_decisions(spark, sf_dir):
    read = readings(spark, sf_dir)
    crops = R.by_crop(read)
    return R.decisions(read, read, crops, R.vote(crops, ["display"], overrides=OVERRIDES), min_votes=40, least_confidence=0.05)


@query("SELECT display, variant, n, rank FROM (SELECT display, variant, count(*) AS n, CAST(row_number() OVER (PARTITION BY display ORDER BY count(*) DESC, variant) AS INTEGER) AS rank FROM g WHERE variant IS NOT NULL GROUP BY display, variant) WHERE rank <= 3", READINGS)
def top_variants(spark, sf_dir):
    return R.top_counts(readings(spark, sf_dir), ["display"], "variant", 3)


SEGMENTS = """,
a0 AS (SELECT display_track_id AS display, frame // 48 AS segment, jersey_number, sum(greatest(0.01, jersey_confidence)) AS score, count(*) AS votes FROM r WHERE jersey_number IS NOT NULL GROUP BY ALL),
a1 AS (SELECT *, row_number() OVER (PARTITION BY display, segment ORDER BY score DESC, votes DESC, jersey_number) AS place, sum(score) OVER (PARTITION BY display, segment) AS total FROM a0),
teams AS (SELECT display_track_id AS display, frame // 48 AS segment, min(CASE WHEN raw_track_id % 97 <> 0 THEN team END) AS team, max(role) FILTER (role <> 'referee' AND raw_track_id % 3 = 0) AS role FROM r GROUP BY ALL),
asg AS (SELECT display, segment, segment * 48 AS start, segment * 48 + 47 AS end_, team, role, jersey_number, score / total AS confidence, votes, list({'jersey_number': o.jersey_number, 'confidence': o.score / o.total, 'votes': o.votes} ORDER BY o.place) AS candidates
  FROM (SELECT display, segment, jersey_number, score, total, votes FROM a1 WHERE place = 1) JOIN teams USING (display, segment) JOIN (SELECT display, segment, jersey_number, score, votes, place, total FROM a1 WHERE place <= 8) o USING (display, segment) GROUP BY ALL)""".replace("list({'jersey_number': o.jersey_number", "list({'jersey_number': o.jersey_number")
SEGMENTS = SEGMENTS.replace("asg AS (SELECT display, segment, segment * 48 AS start, segment * 48 + 47 AS end_, team, role, jersey_number, score / total AS confidence, votes,", "asg AS (SELECT w.display, w.segment, w.segment * 48 AS start, w.segment * 48 + 47 AS end_, team, role, w.jersey_number, w.score / w.total AS confidence, w.votes,").replace("FROM a1 WHERE place = 1) JOIN", "FROM a1 WHERE place = 1) w JOIN")


def assignments(spark, sf_dir):
    """The number of each display in each two days, with its majority team and role as the tables have it."""
    seen = tracks(spark, sf_dir).withColumns({"display": F.col("display_track_id"), "segment": F.floor(F.col("frame") / 48)})
    read = seen.where("jersey_number is not null").select("display", "segment", F.col("jersey_number").alias("number"), F.col("jersey_confidence").alias("confidence"))
    team = seen.groupBy("display", "segment").agg(F.min(F.when(F.col("raw_track_id") % 97 != 0, F.col("team"))).alias("team"), F.max(F.when((F.col("role") != "referee") & (F.col("raw_track_id") % 3 == 0), F.col("role"))).alias("role"))
    return R.vote(read, ["display", "segment"]).join(team, ["display", "segment"]).withColumns({"start": F.col("segment") * 48, "end": F.col("segment") * 48 + 47})


SETS = """, sets AS (SELECT team, list(DISTINCT jersey_number) AS numbers, list(DISTINCT jersey_number) FILTER (coalesce(role IN ('goalkeeper', 'keeper', 'gk'), false)) AS keepers FROM players WHERE team IS NOT NULL AND jersey_number IS NOT NULL GROUP BY team),
f0 AS (SELECT asg.*, coalesce(coalesce(role IN ('goalkeeper', 'keeper', 'gk'), false) AND len(keepers) > 0, false) AS keeper, CASE WHEN coalesce(role IN ('goalkeeper', 'keeper', 'gk'), false) AND len(keepers) > 0 THEN keepers ELSE coalesce(numbers, []) END AS allowed FROM asg LEFT JOIN sets USING (team)),
f1 AS (SELECT *, list_contains(allowed, jersey_number) AS fits, list_filter(candidates, lambda c: list_contains(allowed, c.jersey_number)) AS inside FROM f0),
f2 AS (SELECT *, CASE WHEN NOT fits THEN list_filter(inside, lambda c: c.confidence >= 0.12 AND c.votes >= 1)[1] END AS pick, coalesce(list_sum(list_transform(inside, lambda c: c.confidence)), 0) AS mass FROM f1)"""


@query("""SELECT display, segment, status, reason, CASE WHEN status = 'promoted_alternative' THEN pick.jersey_number WHEN status <> 'dropped_preserved_evidence' THEN jersey_number END AS jersey_number, jersey_number AS original_number,
  round(1e-9 + CASE status WHEN 'promoted_alternative' THEN pick.confidence WHEN 'dropped_preserved_evidence' THEN 0 WHEN 'degraded' THEN confidence * 0.6 ELSE confidence END, 6) AS confidence, CASE status WHEN 'promoted_alternative' THEN pick.votes WHEN 'dropped_preserved_evidence' THEN 0 ELSE votes END AS votes, round(1e-9 + CASE WHEN team IS NOT NULL AND mass > 0 THEN mass END, 6) AS roster_mass
FROM (SELECT *, CASE WHEN team IS NULL OR fits THEN 'kept' WHEN pick IS NOT NULL THEN 'promoted_alternative' WHEN keeper THEN 'dropped_preserved_evidence' ELSE 'degraded' END AS status, CASE WHEN team IS NULL OR fits THEN NULL WHEN keeper THEN 'goalkeeper_number_not_in_goalkeeper_roster' ELSE 'number_not_in_team_roster' END AS reason FROM f2)""", TRACKS + SEGMENTS + SETS)
def roster_number_filter(spark, sf_dir):
    out = R.roster_filter(assignments(spark, sf_dir), players(spark, sf_dir), preserve=True)
    return out.select("display", "segment", "status", "reason", "jersey_number", "original_number", rounded("confidence", 6).alias("confidence"), "votes", rounded("roster_mass", 6).alias("roster_mass"))


JUDGED = """,
named AS (SELECT display, segment, start, end_, jersey_number, confidence, votes, team, list_sort(coalesce((SELECT list(player_id) FROM players p WHERE p.team IS NOT NULL AND p.jersey_number = asg.jersey_number AND (asg.team IS NULL OR p.team = asg.team)), [])) AS players FROM asg),
ruled AS (SELECT *, CASE WHEN confidence < 0.2 THEN 'low_confidence' WHEN votes < 1 THEN 'low_votes' WHEN spread > 3 THEN 'high_jersey_display_spread' WHEN len(players) <> 1 THEN 'not_unique_roster_player' END AS rejection FROM (SELECT n.*, s.spread FROM named n JOIN (SELECT jersey_number, count(DISTINCT display) AS spread FROM named GROUP BY 1) s USING (jersey_number))),
judged AS (SELECT *, rejection IS NULL AND row_number() OVER (PARTITION BY display, segment, rejection IS NULL ORDER BY spread, confidence DESC, votes DESC, jersey_number) = 1 AS accepted FROM ruled)"""


def judged(spark, sf_dir):
    return R.judged_segments(R.segment_candidates(assignments(spark, sf_dir), players(spark, sf_dir)), min_votes=1)


@query("SELECT display, segment, jersey_number, round(1e-9 + confidence, 6) AS confidence, votes, array_to_string(players, ',') AS players, spread, rejection, accepted FROM judged", TRACKS + SEGMENTS + JUDGED)
def segment_candidates(spark, sf_dir):
    return judged(spark, sf_dir).select("display", "segment", "jersey_number", rounded("confidence", 6).alias("confidence"), "votes", F.array_join("players", ",").alias("players"), "spread", "rejection", "accepted")


@query("SELECT raw_track_id, CASE WHEN player_id IS NULL THEN players[1] END AS segment_player, CASE WHEN player_id IS NULL THEN j.jersey_number END AS segment_number FROM r LEFT JOIN (SELECT * FROM judged WHERE accepted AND len(players) > 0) j ON r.display_track_id = j.display AND r.frame BETWEEN start AND end_", TRACKS + SEGMENTS + JUDGED)
def segment_players(spark, sf_dir):
    return R.apply_segments(tracks(spark, sf_dir), judged(spark, sf_dir).where("accepted"), width=48).select("raw_track_id", "segment_player", "segment_number")


@query("SELECT raw_track_id, coalesce(s.jersey_number, d.jersey_number) AS read_number, s.jersey_number IS NOT NULL AS from_segment FROM r LEFT JOIN (SELECT * FROM asg WHERE confidence >= 0.3) s ON r.display_track_id = s.display AND r.frame BETWEEN start AND end_ LEFT JOIN (SELECT display, min(jersey_number) AS jersey_number FROM asg GROUP BY 1) d ON r.display_track_id = d.display", TRACKS + SEGMENTS)
def segment_or_display_numbers(spark, sf_dir):
    a = assignments(spark, sf_dir)
    return R.segment_or_direct(tracks(spark, sf_dir), a.where("confidence >= 0.3"), a.groupBy("display").agg(F.min("jersey_number").alias("jersey_number")), width=48).select("raw_track_id", "read_number", "from_segment")


@query("""SELECT raw_track_id, jersey_number, confidence, votes, source, CAST(row_number() OVER (PARTITION BY raw_track_id ORDER BY confidence DESC, votes DESC, field, pos) AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY raw_track_id, jersey_number ORDER BY field, pos) AS nth FROM (SELECT raw_track_id, 0 AS field, 'own' AS source, 0 AS pos, jersey_number, coalesce(jersey_confidence, 0) AS confidence, coalesce(jersey_votes, 0) AS votes FROM r WHERE jersey_number IS NOT NULL
    UNION ALL SELECT raw_track_id, 1, 'candidates', generate_subscripts(candidates, 1) - 1, unnest(candidates).jersey_number, unnest(candidates).confidence, unnest(candidates).votes FROM r)) WHERE nth = 1""", TRACKS)
def ranked_candidates(spark, sf_dir):
    own = F.when(F.col("jersey_number").isNotNull(), F.array(F.struct("jersey_number", F.col("jersey_confidence").alias("confidence"), F.col("jersey_votes").alias("votes"))))
    return R.ranked_candidates(tracks(spark, sf_dir).withColumn("own", own), ["raw_track_id"], ["own", "candidates"])


@query(r"""SELECT display, number AS jersey_number, votes, round(1e-9 + votes * share, 6) AS score FROM (SELECT user_id AS display, number, count(*) AS votes, max(share) AS share FROM (
  SELECT user_id, CAST(substr(run, 1, 2) AS INTEGER) AS number, length(run) / length(props) AS share FROM (SELECT *, regexp_extract(props, '[0-9]+') AS run FROM events) WHERE run <> '') WHERE number BETWEEN 1 AND 99 GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY display ORDER BY votes * share DESC, votes DESC, number) = 1""")
def read_numbers(spark, sf_dir):
    """From pictures (here texts) to a number for each user: read by all wanted readers, of which one doesn't load, joined by crop, voted."""
    from trackweave.functions.scalars import parse_number
    from trackweave.operators import readers

    crops = table(spark, sf_dir, "events").select(F.col("user_id").alias("display"), F.col("event_id").alias("crop"), F.col("props").alias("picture"))
    seen = readers.read_crops(crops, "picture", {"digits": readers.digit_runs}, "absent,digits").withColumns({"number": parse_number(F.col("text")), "vote_weight": F.lit(1.0), "variant": F.lit(None).cast("string")})
    return R.vote(R.by_crop(seen), ["display"]).select("display", "jersey_number", "votes", rounded("score", 6).alias("score"))
