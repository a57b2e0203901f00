"""Queries that apply the operators to the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions import scalars as S
from trackweave.operators import aggregates as A
from trackweave.operators import identity as I
from trackweave.operators import joins as J
from trackweave.operators import stateful as SF
from trackweave.operators import vectors as V
from trackweave.operators import windows as W
from trackweave.plans import registry
from trackweave.plans import assignment, colours, constraints, evaluation, exporting, fields, linking, merging, propagation, readings, tracking  # noqa: F401, I001  (they register their queries)
from trackweave.plans.registry import ORACLE_SQL, QUERIES, table  # noqa: F401
from trackweave.streaming import windows as ST

#: Observations from events: who was seen when, with a number, a confidence and a place.
OBS = """
o AS (SELECT event_id AS frame, user_id AS track_id, nullif(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS jersey_number,
      least(1.0, value / 500) AS confidence, event_type AS role, CAST(user_id % 2 + 1 AS INTEGER) AS team_id, value AS x,
      CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, date_trunc('hour', ts) AS slot, epoch(ts) AS sec FROM events),
s0 AS (SELECT *, lag(sec) OVER (PARTITION BY track_id ORDER BY sec, frame) AS before FROM o),
s AS (SELECT *, CAST(sum(CASE WHEN before IS NULL OR sec - before > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY sec, frame ROWS UNBOUNDED PRECEDING) AS INTEGER) AS session FROM s0),
roster AS (SELECT s_name AS player_id, CAST(s_suppkey AS INTEGER) AS jersey_number, CAST(n_regionkey % 2 + 1 AS INTEGER) AS team_id, s_acctbal AS prior
           FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""


def query(sql: str | None, ctes: str = OBS):
    return registry.query(sql, ctes)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("frame"), F.col("user_id").alias("track_id"), F.nullif(k, F.lit(0)).alias("jersey_number"),
        F.least(F.lit(1.0), F.col("value") / 500).alias("confidence"), F.col("event_type").alias("role"), (F.col("user_id") % 2 + 1).cast("int").alias("team_id"),
        F.col("value").alias("x"), k.cast("double").alias("y"), F.date_trunc("hour", "ts").alias("slot"), F.col("ts").cast("timestamp").cast("double").alias("sec"),
    )


def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).withColumn("at", F.struct("sec", "frame"))
    return W.sessions(obs, ["track_id"], "at", F.col("sec") - F.col("previous.sec") > 43200).drop("at").withColumn("session", F.col("session").cast("int"))


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_name").alias("player_id"), F.col("s_suppkey").cast("int").alias("jersey_number"), (F.col("n_regionkey") % 2 + 1).cast("int").alias("team_id"), F.col("s_acctbal").alias("prior"))


@query("SELECT role, count(*) AS n_rows, count(DISTINCT track_id) AS tracks, count(jersey_number) AS numbered, count(*) FILTER (confidence >= 0.5) AS confident, count(DISTINCT jersey_number) AS numbers FROM o GROUP BY role")
def run_audit(spark, sf_dir):
    return I.run_audit(observations(spark, sf_dir), ["role"])


@query("SELECT frame, role, confidence FROM o WHERE confidence >= CASE WHEN role = 'purchase' THEN 0.2 ELSE 0.6 END")
def class_threshold_filter(spark, sf_dir):
    return observations(spark, sf_dir).where(F.col("confidence") >= F.when(F.col("role") == "purchase", 0.2).otherwise(0.6)).select("frame", "role", "confidence")


@query("SELECT frame, track_id, slot FROM (SELECT *, sum(CASE WHEN confidence >= 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id, session) AS good FROM s) WHERE confidence >= 0.3 OR good < 3")
def quality_filter_fallback(spark, sf_dir):
    return W.quality_filter(session_rows(spark, sf_dir), ["track_id", "session"], "confidence", 0.3).select("frame", "track_id", "slot")


@query("SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 20", "")
def class_balanced_cap(spark, sf_dir):
    return W.cap_per_label(table(spark, sf_dir, "embeddings"), "label", "vec_id", 20).select("vec_id", "label")


@query("SELECT frame, round((2 * x + 3 * y + 5) / (0.001 * x + 1), 6) AS px, round((x - y + 2) / (0.001 * x + 1), 6) AS py FROM o")
def homography_project(spark, sf_dir):
    h = F.array(*(F.lit(v) for v in (2.0, 3.0, 5.0, 1.0, -1.0, 2.0, 0.001, 0.0, 1.0)))
    return observations(spark, sf_dir).withColumn("p", S.project(h, F.col("x"), F.col("y"))).select("frame", F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"))


@query("SELECT frame, CASE WHEN role = 'purchase' THEN 5 WHEN role = 'signup' THEN CASE WHEN team_id = 2 THEN 4 ELSE 3 END ELSE team_id END AS semantic_group FROM o")
def semantic_groups(spark, sf_dir):
    role = F.when(F.col("role") == "purchase", "referee").when(F.col("role") == "signup", "goalkeeper").otherwise("player")
    return observations(spark, sf_dir).select("frame", S.role_group(role, F.col("team_id")).alias("semantic_group"))


@query("SELECT page_id, CASE WHEN n BETWEEN 1 AND 99 THEN n END AS number, regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g') AS name FROM (SELECT *, TRY_CAST(substr(regexp_extract(url, '(\\d+)', 1), 1, 2) AS INTEGER) AS n FROM pages)", "")
def parse_number_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.parse_number(F.col("url")).alias("number"), S.safe_name(F.col("url")).alias("name"))


@query("SELECT sha256(text) AS content, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1", "")
def content_hash_dedup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT track_id, jersey_number AS mode, n AS mode_votes FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY n DESC, first) AS r FROM (SELECT track_id, jersey_number, count(*) AS n, min(frame) AS first FROM o WHERE jersey_number IS NOT NULL GROUP BY ALL)) WHERE r = 1")
def mode_first_seen(spark, sf_dir):
    return A.mode_first_seen(observations(spark, sf_dir), ["track_id"], "jersey_number", "frame")


MODES = """, m AS (SELECT track_id, session, jersey_number AS main_number, n AS main_number_votes FROM (SELECT *, row_number() OVER (PARTITION BY track_id, session ORDER BY n DESC, first) AS r FROM (SELECT track_id, session, jersey_number, count(*) AS n, min(frame) AS first FROM s WHERE jersey_number IS NOT NULL GROUP BY ALL)) WHERE r = 1)"""


@query("SELECT s.track_id, s.session, count(*) AS num_frames, min(frame) AS start_frame, max(frame) AS end_frame, any_value(main_number) AS main_number, round(coalesce(avg(confidence) FILTER (jersey_number = main_number), 0), 6) AS mean_confidence, max(frame) - min(frame) + 1 AS frame_span FROM s LEFT JOIN m ON s.track_id = m.track_id AND s.session = m.session GROUP BY s.track_id, s.session", OBS + MODES)
def tracklet_summary(spark, sf_dir):
    out = A.tracklet_summary(session_rows(spark, sf_dir), ["track_id", "session"], order="frame", number="jersey_number", confidence="confidence", team="team_id")
    return out.select("track_id", "session", "num_frames", "start_frame", "end_frame", "main_number", F.round("mean_confidence", 6).alias("mean_confidence"), "frame_span")


@query("SELECT track_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, arg_min(x, frame) AS first_x, arg_max(x, frame) AS last_x FROM o GROUP BY track_id")
def mean_position(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("track_id").agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"), F.min_by("x", "frame").alias("first_x"), F.max_by("x", "frame").alias("last_x"))


@query("SELECT label, pos, round(mean / sqrt(sum(mean * mean) OVER (PARTITION BY label)), 4) AS value FROM (SELECT label, CAST(i - 1 AS INTEGER) AS pos, avg(CAST(embedding[i] AS DOUBLE)) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY ALL)", "")
def class_centroids(spark, sf_dir):
    return A.mean_embedding(table(spark, sf_dir, "embeddings"), ["label"]).select("label", "pos", F.round("value", 4).alias("value"))


@query("""SELECT track_id, jersey_number AS winner, round(score, 6) AS score, votes, round(score / total, 6) AS share, round((score - second) / total, 6) AS margin FROM (
  SELECT *, coalesce(lead(score) OVER w, 0) AS second, sum(score) OVER (PARTITION BY track_id) AS total, row_number() OVER w AS r FROM (
    SELECT track_id, jersey_number, sum(greatest(0.01, confidence)) AS score, count(*) AS votes FROM o WHERE jersey_number IS NOT NULL GROUP BY ALL)
  WINDOW w AS (PARTITION BY track_id ORDER BY score DESC, votes DESC, jersey_number)) WHERE r = 1""")
def weighted_vote(spark, sf_dir):
    out = A.weighted_vote(observations(spark, sf_dir), ["track_id"], number="jersey_number", confidence="confidence", order="frame")
    return out.select("track_id", "winner", F.round("score", 6).alias("score"), "votes", F.round("share", 6).alias("share"), F.round("margin", 6).alias("margin"))


@query("SELECT slot, track_id, jersey_number, best, observations, rank FROM (SELECT *, max(best) OVER (PARTITION BY slot, track_id) AS top, CAST(row_number() OVER (PARTITION BY slot, track_id ORDER BY best DESC, observations DESC, jersey_number) AS INTEGER) AS rank FROM (SELECT slot, track_id, jersey_number, max(confidence) AS best, count(*) AS observations FROM o WHERE jersey_number IS NOT NULL GROUP BY ALL)) WHERE best >= 0.35 * top AND rank <= 3")
def crop_collapse_vote(spark, sf_dir):
    return A.crop_collapse(observations(spark, sf_dir), ["slot", "track_id"], number="jersey_number", confidence="confidence")


@query("SELECT track_id, jersey_number, round(mass / sum(mass) OVER (PARTITION BY track_id), 6) AS share, votes FROM (SELECT track_id, jersey_number, sum(confidence) AS mass, count(*) AS votes FROM o WHERE jersey_number IS NOT NULL GROUP BY ALL)")
def distribution_merge(spark, sf_dir):
    return A.distribution(observations(spark, sf_dir), ["track_id"], number="jersey_number", confidence="confidence").select("track_id", "jersey_number", F.round("share", 6).alias("share"), "votes")


@query("SELECT track_id, role, n FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY mean DESC, n DESC, role) AS r FROM (SELECT track_id, role, round(avg(confidence), 9) AS mean, count(*) AS n FROM o GROUP BY ALL)) WHERE r = 1")
def colour_argmax(spark, sf_dir):
    return A.group_argmax(observations(spark, sf_dir), ["track_id"], "role", "confidence").select("track_id", "role", "n")


@query("SELECT track_id, count(*) AS samples, round(coalesce(max(v), 0) / count(*), 6) AS confidence FROM (SELECT track_id, CASE WHEN x > 50 THEN count(*) FILTER (x > 50) OVER (PARTITION BY track_id, jersey_number % 2) END AS v FROM o WHERE x IS NOT NULL AND jersey_number IS NOT NULL) GROUP BY track_id")
def palette_votes(spark, sf_dir):
    rows = observations(spark, sf_dir).where("x is not null and jersey_number is not null").withColumn("choice", F.when(F.col("x") > 50, F.col("jersey_number") % 2))
    return A.decided_votes(rows, ["track_id"], "choice").select("track_id", "samples", F.round("confidence", 6).alias("confidence"))


@query("SELECT team_id, jersey_number, count(DISTINCT track_id) AS displays FROM o WHERE jersey_number IS NOT NULL GROUP BY ALL")
def jersey_display_spread(spark, sf_dir):
    return observations(spark, sf_dir).where("jersey_number is not null").groupBy("team_id", "jersey_number").agg(F.countDistinct("track_id").alias("displays"))


@query("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM o WHERE jersey_number IS NOT NULL GROUP BY slot, jersey_number) WHERE n > 1")
def remaining_duplicates(spark, sf_dir):
    return A.remaining_duplicates(observations(spark, sf_dir), ["slot"], "jersey_number")


@query("SELECT track_id, count(*) AS n, round(quantile_cont(confidence, 0.5), 6) AS median, round(quantile_cont(confidence, 0.75), 6) AS p75 FROM o GROUP BY track_id")
def display_winner_stats(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("track_id").agg(F.count("*").alias("n"), F.round(F.percentile("confidence", 0.5), 6).alias("median"), F.round(F.percentile("confidence", 0.75), 6).alias("p75"))


@query("SELECT track_id, frame, round(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 5) AS jump, frame - lag(frame) OVER w AS gap FROM o WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY track_id ORDER BY frame)")
def jump_diagnostics(spark, sf_dir):
    return W.jumps(observations(spark, sf_dir), ["track_id"], "frame", "x", "y").select("track_id", "frame", F.round("jump", 5).alias("jump"), "gap")


@query("SELECT lang, source, count(*) AS total, count(quality) AS assigned, count(*) FILTER (quality = 1) AS correct, round(count(quality) / count(*), 6) AS coverage, round(coalesce(count(*) FILTER (quality = 1) / nullif(count(quality), 0), 0), 6) AS accuracy_assigned FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source))", "")
def eval_metrics_by_key(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    out = A.accuracy_metrics(df, ["lang", "source"], assigned=F.col("quality").isNotNull(), correct=F.col("quality") == 1)
    return out.select("lang", "source", "total", "assigned", "correct", F.round("coverage", 6).alias("coverage"), F.round("accuracy_assigned", 6).alias("accuracy_assigned"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL", "")
def confusion_matrix(spark, sf_dir):
    return A.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("SELECT cut, count(frame) AS kept, count(frame) FILTER (jersey_number % 2 = 0) AS correct FROM (SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.9]) AS cut) c LEFT JOIN o ON confidence >= cut GROUP BY cut")
def threshold_sweep(spark, sf_dir):
    return A.threshold_sweep(observations(spark, sf_dir), "confidence", F.coalesce(F.col("jersey_number") % 2 == 0, F.lit(False)), [0.0, 0.1, 0.25, 0.5, 0.9]).select("cut", "kept", "correct")


@query("SELECT vec_id, round(sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding])), 4) AS norm, round(list_sum([CAST(embedding[i] AS DOUBLE) * b[i] FOR i IN range(1, 65)]) / sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding])) / sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN b])), 4) AS cosine FROM (SELECT *, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)", "")
def scene_cut_scores(spark, sf_dir):
    from pyspark.sql import Window

    df = table(spark, sf_dir, "embeddings").withColumn("b", F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id")))
    return df.select("vec_id", F.round(F.sqrt(S.dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"), F.round(S.cosine(F.col("embedding"), F.col("b")), 4).alias("cosine"))


@query("""SELECT track_id, frame FROM kept""", """RECURSIVE h AS (SELECT event_id AS frame, user_id AS track_id FROM events WHERE value >= 100),
kept AS (SELECT track_id, min(frame) AS frame FROM h GROUP BY track_id UNION ALL
  SELECT k.track_id, (SELECT min(h.frame) FROM h WHERE h.track_id = k.track_id AND h.frame >= k.frame + 500) AS frame FROM kept k WHERE EXISTS (SELECT 1 FROM h WHERE h.track_id = k.track_id AND h.frame >= k.frame + 500))""")
def refractory_cuts(spark, sf_dir):
    return W.refractory(observations(spark, sf_dir), ["track_id"], "frame", F.col("x"), 100.0, 500)


@query("SELECT conv_id, segment_index, min(turn) AS start_frame, max(turn) AS end_frame, count(*) AS num_frames FROM (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_index FROM conversations) GROUP BY ALL", "")
def segment_ranges(spark, sf_dir):
    rows = W.running_segments(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") == "user")
    return W.segment_ranges(rows, ["conv_id"], "turn", "segment_index")


@query("""SELECT track_id, run, any_value(team) AS team, min(f) AS first, max(f) AS last, min(row) AS first_row, max(row) AS last_row, count(*) AS conflicts, max(row) - min(row) + 1 - count(*) AS bridges FROM (
  SELECT *, CAST(sum(CASE WHEN p IS NULL OR row - p - 1 > 2 OR pt <> team OR f - pa > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY row ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM (
    SELECT *, lag(row) OVER w AS p, lag(team) OVER w AS pt, lag(f) OVER w AS pa FROM (
      SELECT *, CAST(floor(sec / 40000) AS BIGINT) AS f, CASE WHEN jersey_number % 3 = 0 THEN 1 WHEN jersey_number % 7 = 0 THEN 2 END AS team, CAST(row_number() OVER (PARTITION BY track_id ORDER BY CAST(floor(sec / 40000) AS BIGINT), frame) AS INTEGER) AS row FROM o) WHERE team IS NOT NULL WINDOW w AS (PARTITION BY track_id ORDER BY row)))
  GROUP BY track_id, run HAVING max(row) - min(row) + 1 >= 2""")
def conflict_islands(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumns({"conflict": F.when(F.col("jersey_number") % 3 == 0, 1).when(F.col("jersey_number") % 7 == 0, 2), "at": F.floor(F.col("sec") / 40000)})
    return W.conflict_islands(rows, ["track_id"], ["at", "frame"], "conflict", max_gap=2, min_rows=2)


@query("SELECT o_custkey, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS n FROM (SELECT *, o_orderkey - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS g FROM orders) GROUP BY o_custkey, g", "")
def compact_ranges(spark, sf_dir):
    return W.compact_ranges(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey")


@query("""SELECT track_id, frame, interpolated, round(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (frame - p0) / (p1 - p0) END, 6) AS filled FROM (
  SELECT *, v IS NULL AS interpolated, last_value(v IGNORE NULLS) OVER b AS v0, first_value(v IGNORE NULLS) OVER a AS v1, last_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS p0, first_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS p1
  FROM (SELECT *, CASE WHEN y % 5 <> 0 THEN x END AS v FROM o)
  WINDOW b AS (PARTITION BY track_id ORDER BY frame ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
def linear_interpolation(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("v", F.when(F.col("y") % 5 != 0, F.col("x")))
    return W.interpolate(rows, ["track_id"], "frame", "v", "frame").select("track_id", "frame", "interpolated", F.round("filled", 6).alias("filled"))


@query("SELECT frame, jersey_number IS NULL OR row_number() OVER (PARTITION BY slot, team_id, jersey_number ORDER BY confidence DESC, frame) = 1 AS kept FROM o")
def frame_dedup_jersey(spark, sf_dir):
    return W.keep_best(observations(spark, sf_dir), ["slot", "team_id", "jersey_number"], [F.desc("confidence"), F.asc("frame")]).select("frame", "kept")


@query("SELECT track_id, frame, round(margin, 6) AS margin FROM (SELECT *, confidence - coalesce(lead(confidence) OVER w, 0) AS margin, row_number() OVER w AS r FROM o WINDOW w AS (PARTITION BY track_id ORDER BY confidence DESC, frame)) WHERE r = 1")
def best_runner_up_margin(spark, sf_dir):
    return W.best_and_margin(observations(spark, sf_dir), ["track_id"], "confidence", "frame").select("track_id", "frame", F.round("margin", 6).alias("margin"))


@query("SELECT track_id, bucket, frame FROM (SELECT *, row_number() OVER (PARTITION BY track_id, bucket ORDER BY confidence DESC, frame) AS r FROM (SELECT *, CAST((row_number() OVER (PARTITION BY track_id ORDER BY frame) - 1) * 5 // count(*) OVER (PARTITION BY track_id) AS INTEGER) AS bucket FROM o)) WHERE r = 1")
def spread_sampling(spark, sf_dir):
    return W.bucket_sample(observations(spark, sf_dir), ["track_id"], "frame", "confidence", 5).select("track_id", "bucket", "frame")


@query("SELECT frame, round(coalesce(0.2 + 0.8 * (confidence - lo) / nullif(hi - lo, 0), 1), 6) AS vote_weight FROM (SELECT *, min(confidence) OVER w AS lo, max(confidence) OVER w AS hi FROM s WINDOW w AS (PARTITION BY track_id, session))")
def relative_quality_weight(spark, sf_dir):
    return W.relative_weight(session_rows(spark, sf_dir), ["track_id", "session"], "confidence").select("frame", F.round("vote_weight", 6).alias("vote_weight"))


@query("SELECT track_id, frame FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS n, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS r FROM o) WHERE n <= 10 OR (r > 5 AND r <= n - 5)")
def trim_buffer(spark, sf_dir):
    return W.trim_ends(observations(spark, sf_dir), ["track_id"], "frame", 5).select("track_id", "frame")


SPANS = ", spans AS (SELECT track_id, session, min(frame) AS start_frame, max(frame) AS end_frame FROM s GROUP BY ALL)"


def spans(spark, sf_dir):
    return session_rows(spark, sf_dir).groupBy("track_id", "session").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"))


@query("SELECT o.track_id, o.frame, min(session) AS segment FROM o LEFT JOIN spans p ON o.track_id = p.track_id AND o.frame BETWEEN start_frame AND end_frame GROUP BY ALL", OBS + SPANS)
def range_first_match(spark, sf_dir):
    segments = spans(spark, sf_dir).withColumnRenamed("session", "segment")
    return J.first_covering(observations(spark, sf_dir).select("track_id", "frame"), segments, "track_id", "frame", width=2000).select("track_id", "frame", "segment")


@query("""SELECT frame, CASE WHEN gap <= 900 THEN v END AS nearest_value, CASE WHEN gap <= 900 THEN gap END AS nearest_gap FROM (
  SELECT frame, CASE WHEN f IS NULL OR frame - b <= f - frame THEN frame - b ELSE f - frame END AS gap, CASE WHEN f IS NULL OR frame - b <= f - frame THEN bv ELSE fv END AS v FROM (
    SELECT frame, (SELECT max(frame) FROM a WHERE a.track_id = o.track_id AND a.frame <= o.frame) AS b, (SELECT min(frame) FROM a WHERE a.track_id = o.track_id AND a.frame >= o.frame) AS f,
      (SELECT arg_max(x, frame) FROM a WHERE a.track_id = o.track_id AND a.frame <= o.frame) AS bv, (SELECT arg_min(x, frame) FROM a WHERE a.track_id = o.track_id AND a.frame >= o.frame) AS fv FROM o WHERE role <> 'purchase'))""", OBS + ", a AS (SELECT * FROM o WHERE role = 'purchase')")
def asof_nearest(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return J.nearest(obs.where("role <> 'purchase'"), obs.where("role = 'purchase'"), ["track_id"], "frame", "x", 900).select("frame", "nearest_value", "nearest_gap")


@query("SELECT o.frame, r.player_id FROM (SELECT frame, jersey_number, CASE WHEN role <> 'click' THEN team_id END AS team_id FROM o) o LEFT JOIN roster r ON o.jersey_number = r.jersey_number AND (o.team_id IS NULL OR o.team_id = r.team_id)")
def roster_lookup_degraded(spark, sf_dir):
    rows = observations(spark, sf_dir).select("frame", "jersey_number", F.when(F.col("role") != "click", F.col("team_id")).alias("team_id"))
    return J.roster_lookup(rows, roster(spark, sf_dir)).select("frame", "player_id")


@query("SELECT a.track_id % 20 AS grp, a.track_id * 1000 + a.session AS source, b.track_id * 1000 + b.session AS target, b.start_frame - a.end_frame AS gap FROM spans a JOIN spans b ON a.track_id % 20 = b.track_id % 20 AND (a.track_id, a.session) <> (b.track_id, b.session) AND b.start_frame - a.end_frame BETWEEN 1 AND 120", OBS + SPANS)
def bucketed_edges(spark, sf_dir):
    rows = spans(spark, sf_dir).select((F.col("track_id") % 20).alias("grp"), (F.col("track_id") * 1000 + F.col("session")).alias("node"), "start_frame", "end_frame")
    return J.candidate_edges(rows, ["grp"], id="node", start="start_frame", end="end_frame", max_gap=120, bucket=50).select("grp", "source", "target", "gap")


@query("SELECT slot, frame FROM (SELECT *, min(track_id) OVER w AS lo, max(track_id) OVER w AS hi FROM o WINDOW w AS (PARTITION BY slot, jersey_number)) WHERE lo = hi OR jersey_number IS NULL")
def conflict_free_frames(spark, sf_dir):
    return J.conflict_free(observations(spark, sf_dir), ["slot"], "track_id", "jersey_number").select("slot", "frame")


@query("SELECT coalesce(p.track_id, f.track_id) AS track_id, coalesce(p.n, f.n) AS n, CASE WHEN p.n IS NOT NULL THEN 'primary' ELSE 'fallback' END AS origin FROM (SELECT track_id, max(jersey_number) AS n FROM o WHERE role = 'purchase' GROUP BY 1) p FULL JOIN (SELECT track_id, min(jersey_number) AS n FROM o WHERE role = 'click' GROUP BY 1) f ON p.track_id = f.track_id")
def full_outer_preference(spark, sf_dir):
    obs = observations(spark, sf_dir)
    p = obs.where("role = 'purchase'").groupBy("track_id").agg(F.max("jersey_number").alias("n"))
    f = obs.where("role = 'click'").groupBy("track_id").agg(F.min("jersey_number").alias("n"))
    return J.prefer(p, f, ["track_id"], "n")


@query("SELECT frame, CASE WHEN team_id IS NULL THEN 'unknown_team' WHEN r.n IS NULL THEN 'degraded' ELSE 'kept' END AS status, round(CASE WHEN team_id IS NOT NULL AND r.n IS NULL THEN confidence * 0.5 ELSE confidence END, 9) AS confidence FROM (SELECT * FROM o WHERE jersey_number IS NOT NULL) o LEFT JOIN (SELECT DISTINCT team_id AS t, jersey_number AS n FROM roster) r ON o.team_id = r.t AND o.jersey_number = r.n")
def roster_membership(spark, sf_dir):
    return I.roster_filter(observations(spark, sf_dir).where("jersey_number is not null"), roster(spark, sf_dir)).select("frame", "status", F.round("confidence", 9).alias("confidence"))


TRACKS = """, t AS (SELECT track_id, any_value(team_id) AS team_id, arg_max(jersey_number, confidence * 1e7 - frame / 1e7) AS jersey_number, round(avg(x), 4) AS position, round(max(confidence), 6) AS confidence FROM o WHERE jersey_number IS NOT NULL GROUP BY track_id),
costs AS (SELECT track_id, player_id, least(1.0, greatest(0.0, CASE WHEN t.jersey_number = r.jersey_number THEN 0.0 ELSE 0.45 END + CASE WHEN t.team_id = r.team_id THEN 0.0 ELSE 0.35 END + least(0.08, 0.08 * abs(position - prior) / 1000) + 0.1 * (1 - confidence))) AS cost
          FROM t JOIN roster r ON t.team_id = r.team_id OR t.jersey_number = r.jersey_number)"""


def track_costs(spark, sf_dir):
    rows = observations(spark, sf_dir).where("jersey_number is not null")
    t = rows.groupBy("track_id").agg(F.max("team_id").alias("team_id"), F.max_by("jersey_number", F.col("confidence") * 1e7 - F.col("frame") / 1e7).alias("jersey_number"), F.round(F.avg("x"), 4).alias("position"), F.round(F.max("confidence"), 6).alias("confidence"))
    return I.assignment_costs(t, roster(spark, sf_dir))


@query("SELECT track_id, player_id, round(cost, 6) AS cost FROM costs", OBS + TRACKS)
def assignment_costs(spark, sf_dir):
    return track_costs(spark, sf_dir).select("track_id", "player_id", F.round("cost", 6).alias("cost"))


@query("""SELECT track_id, b.player_id, round(cost, 6) AS cost, CASE WHEN cost > 0.3 THEN 'cost' WHEN margin < 0.01 THEN 'margin' WHEN spread > 3 THEN 'spread' END AS rejection FROM (
  SELECT *, count(*) OVER (PARTITION BY player_id) AS spread FROM (SELECT *, coalesce(lead(cost) OVER w, 1.0) - cost AS margin, row_number() OVER w AS r FROM (SELECT track_id, player_id, round(coalesce(nullif(cost, 0), 1.0), 9) AS cost FROM costs WHERE track_id % 3 <> 0) WINDOW w AS (PARTITION BY track_id ORDER BY cost, player_id)) WHERE r = 1) b""", OBS + TRACKS)
def identity_candidates(spark, sf_dir):
    costs = track_costs(spark, sf_dir).withColumn("cost", F.round("cost", 9))
    out = I.identity_candidates(costs, costs.where("track_id % 3 = 0").select("track_id").distinct(), max_cost=0.3, min_margin=0.01, max_spread=3)
    return out.select("track_id", "player_id", F.round("cost", 6).alias("cost"), "rejection")


@query(None)
def optimal_assignment(spark, sf_dir):
    costs = track_costs(spark, sf_dir).withColumn("video", F.floor(F.col("track_id") / 10))
    # a recording is ten users: its tracklets against the roster
    return J.assign_one_to_one(costs, "video", row="track_id", column="player_id", cost="cost", most=0.5)


@query("""SELECT frame, CASE WHEN owner IS NULL OR owner = c.track_id THEN c.j3 END AS jersey_number, CASE WHEN owner IS NULL OR owner = c.track_id THEN c.p3 END AS player_id
FROM c LEFT JOIN w ON c.team_id = w.team_id AND c.j3 = w.j3""", OBS + """,
a AS (SELECT o.*, CASE WHEN r.n IS NOT NULL THEN jersey_number END AS j1, CASE WHEN r.n IS NOT NULL OR jersey_number IS NULL THEN p END AS p1
      FROM (SELECT *, CASE WHEN confidence > 0.1 THEN 'P' || jersey_number END AS p FROM o) o LEFT JOIN (SELECT DISTINCT team_id AS t, jersey_number AS n FROM roster) r ON o.team_id = r.t AND o.jersey_number = r.n),
b AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY slot, team_id, j1 ORDER BY confidence DESC, track_id, frame) = 1 THEN j1 END AS j3 FROM a),
c AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY slot, p1 ORDER BY confidence DESC, track_id, frame) = 1 THEN p1 END AS p3 FROM b),
g AS (SELECT team_id, j3, track_id, max(CASE WHEN p3 IS NOT NULL THEN 1 ELSE 0 END) AS known, round(sum(confidence), 6) AS mass FROM c WHERE j3 IS NOT NULL GROUP BY ALL),
w AS (SELECT team_id, j3, track_id AS owner FROM (SELECT *, row_number() OVER (PARTITION BY team_id, j3 ORDER BY known DESC, mass DESC, track_id) AS r FROM g) WHERE r = 1)""")
def constraint_chain(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("player_id", F.when(F.col("confidence") > 0.1, F.concat(F.lit("P"), F.col("jersey_number").cast("string"))))
    return I.constraint_chain(rows, roster(spark, sf_dir), ["slot"]).select("frame", "jersey_number", "player_id")


@query("SELECT a.track_id, CASE WHEN a.player_id IS NULL AND b.votes >= 2 THEN b.player_id ELSE a.player_id END AS player_id, CASE WHEN a.player_id IS NULL AND b.votes >= 2 AND b.player_id IS NOT NULL THEN 'other' WHEN a.player_id IS NOT NULL THEN 'base' ELSE 'unknown' END AS origin FROM (SELECT track_id, max(jersey_number) FILTER (role = 'purchase' AND confidence > 0.2) AS player_id FROM o GROUP BY 1) a LEFT JOIN (SELECT track_id, min(jersey_number) AS player_id, count(*) AS votes FROM o WHERE role = 'click' GROUP BY 1) b ON a.track_id = b.track_id")
def run_merge(spark, sf_dir):
    obs = observations(spark, sf_dir)
    base = obs.groupBy("track_id").agg(F.max(F.when((F.col("role") == "purchase") & (F.col("confidence") > 0.2), F.col("jersey_number"))).alias("player_id"))
    other = obs.where("role = 'click'").groupBy("track_id").agg(F.min("jersey_number").alias("player_id"), F.count("*").alias("votes"))
    return I.merge_runs(base, other)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL", "")
def tumbling_segments(spark, sf_dir):
    return ST.tumbling_counts(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"])


@query("SELECT track_id, session, count(*) AS n, min(frame) AS first FROM s GROUP BY ALL")
def session_windows(spark, sf_dir):
    return session_rows(spark, sf_dir).groupBy("track_id", "session").agg(F.count("*").alias("n"), F.min("frame").alias("first"))


@query("SELECT item_id, text FROM benchmark WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL)", "")
def cache_miss_antijoin(spark, sf_dir):
    from trackweave.sources.tables import cache_misses

    keyed = lambda t: table(spark, sf_dir, t).withColumn("key", F.sha2("text", 256))
    return cache_misses(keyed("benchmark"), keyed("documents"), "key").select("item_id", "text")


@query(None)
def kalman_positions(spark, sf_dir):
    seen = observations(spark, sf_dir).withColumn("x", F.when(F.col("frame") % 4 != 0, F.col("x")))
    return SF.kalman_positions(seen, ["track_id"], "frame", "x", "y").withColumn("filter_x", F.round("filter_x", 4)).withColumn("filter_y", F.round("filter_y", 4))


@query(None)
def object_selection(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("at", F.floor(F.col("frame") / 5))
    boxes = o.select(F.floor(F.col("track_id") / 10).alias("video"), "at", F.col("frame").alias("candidate"), "confidence", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 8).alias("x2"), (F.col("y") + 8).alias("y2"))
    return SF.select_object(boxes, ["video"], "at", frame_area=1e6, max_area=0.001, size_penalty=0.2, acquire=0.1, reach=60, reach_cap=300, near=40, distance_penalty=0.3, after_miss=0.05, forget=12).withColumn("score", F.round("score", 6)).withColumn("moved", F.round("moved", 6))


def session_spans(spark, sf_dir) -> DataFrame:
    ends = [f(F.col(c), F.col("frame")).alias(f"{n}_{c}") for n, f in (("first", F.min_by), ("last", F.max_by)) for c in "xy"]
    return session_rows(spark, sf_dir).groupBy(F.floor(F.col("track_id") / 10).alias("video"), "track_id", "session").agg(
        F.min("frame").alias("id"), F.min("frame").alias("start"), F.max("frame").alias("end"), *ends, F.first("team_id").alias("team"), F.avg("confidence").alias("team_confidence")
    ).withColumn("look", F.array(F.col("first_x"), F.col("last_x")))


@query(None)
def span_links(spark, sf_dir):
    spans = session_spans(spark, sf_dir)
    found = SF.link_candidates(spans, "video", max_gap=400, max_distance=120, same_team=SF.teams_agree(), min_cosine=0.72)
    seen = session_rows(spark, sf_dir).withColumn("video", F.floor(F.col("track_id") / 10))
    frames = SF.frame_ranges(seen, ["video", "track_id", "session"], "frame")
    return SF.link_spans(spans.join(frames, ["video", "track_id", "session"]), found, "video", max_gap=400)


@query("""SELECT a.video, a.id AS source, b.id AS target, b.start - a.end AS gap, round(sqrt((b.first_x - a.last_x) ** 2 + (b.first_y - a.last_y) ** 2), 6) AS distance FROM t a JOIN t b ON a.video = b.video AND b.start - a.end BETWEEN 1 AND 400
WHERE sqrt((b.first_x - a.last_x) ** 2 + (b.first_y - a.last_y) ** 2) <= 120 AND NOT (a.team <> b.team AND a.conf >= 0.65 AND b.conf >= 0.65)""", OBS + """,
t AS (SELECT CAST(floor(track_id / 10) AS BIGINT) AS video, min(frame) AS id, min(frame) AS start, max(frame) AS end, min(team_id) AS team, avg(confidence) AS conf, arg_min(x, frame) AS first_x, arg_max(x, frame) AS last_x, arg_min(y, frame) AS first_y, arg_max(y, frame) AS last_y FROM s GROUP BY track_id, session)""")
def span_link_candidates(spark, sf_dir):
    spans = session_spans(spark, sf_dir).withColumn("look", F.lit(None).cast("array<double>"))
    found = SF.link_candidates(spans, "video", max_gap=400, max_distance=120, same_team=SF.teams_agree(), min_cosine=0.72)
    return found.select("video", "source", "target", "gap", F.round("distance", 6).alias("distance"))


UNIT = """u AS (SELECT label, pos, avg(v) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY label, pos),
n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM u GROUP BY label)"""


@query("SELECT u.label, u.pos::INTEGER AS pos, round(m / norm, 5) AS value FROM u JOIN n ON u.label IS NOT DISTINCT FROM n.label WHERE norm > 0", UNIT)
def mean_embedding(spark, sf_dir):
    means = V.mean_vectors(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("vector").alias("pos", "value")).withColumn("value", F.round("value", 5))
