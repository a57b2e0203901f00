"""Queries of evaluation and of scene cuts."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.operators import evaluation as E
from trackweave.operators import joins as J
from trackweave.operators import scenes as S
from trackweave.operators import vectors as V
from trackweave.plans.registry import query, rounded, table
from trackweave.plans.tracks import COLUMNS, CROWDED, CROWDED_TRACKS, TRACKS, tracks

#: Predicted boxes are those of clicks and views, true ones those of the other events, near each other in a frame.
BOXES = """,
bx AS (SELECT *, (raw_track_id * 7 % 30) AS px, (raw_track_id * 11 % 30) AS py, coalesce(role, 'player') IN ('player') AS pred FROM r),
pairs AS (SELECT p.video, p.frame, p.raw_track_id AS prediction_id, t.raw_track_id AS truth_id, p.team, p.jersey_number, p.player_id AS candidate_player_id, CASE t.team WHEN 1 THEN 'Right' WHEN 2 THEN 'left' END AS truth_team, t.jersey_number AS truth_number,
  greatest(0, least(p.px, t.px) + 20 - greatest(p.px, t.px)) * greatest(0, least(p.py, t.py) + 20 - greatest(p.py, t.py)) AS common FROM bx p JOIN bx t ON p.video = t.video AND p.frame = t.frame AND p.pred AND NOT t.pred),
matched AS (SELECT *, common / (800.0 - common) AS iou FROM pairs WHERE common / (800.0 - common) >= 0.2 QUALIFY row_number() OVER (PARTITION BY video, frame, prediction_id ORDER BY common DESC, truth_id) = 1)"""


def boxes(spark, sf_dir, columns=COLUMNS):
    x, y = F.col("raw_track_id") * 7 % 30, F.col("raw_track_id") * 11 % 30
    box = F.struct(x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + 20).cast("double").alias("x2"), (y + 20).cast("double").alias("y2"))
    return tracks(spark, sf_dir, columns).withColumns({"box": box, "pred": F.coalesce("role", F.lit("player")) == "player"})


def matches(spark, sf_dir, columns=COLUMNS):
    every = boxes(spark, sf_dir, columns)
    pred = every.where("pred").select("video", "frame", F.col("raw_track_id").alias("prediction_id"), F.col("box").alias("p_box"), "team", "jersey_number", F.col("player_id").alias("candidate_player_id"))
    truth = every.where("not pred").select("video", "frame", F.col("raw_track_id").alias("truth_id"), F.col("box").alias("t_box"), F.when(F.col("team") == 1, "Right").when(F.col("team") == 2, "left").alias("truth_team"), F.col("jersey_number").alias("truth_number"))
    found = J.best_overlap(pred.select("video", "frame", "prediction_id", "p_box"), truth.select("video", "frame", "truth_id", "t_box"), ["video", "frame"], least=0.2)
    return pred.drop("p_box").join(found, ["video", "frame", "prediction_id"]).join(truth.drop("t_box"), ["video", "frame", "truth_id"])


@query("SELECT video, frame, prediction_id, truth_id, round(1e-9 + iou, 6) AS iou FROM matched", CROWDED_TRACKS + BOXES)
def iou_matches(spark, sf_dir):
    return matches(spark, sf_dir, CROWDED).select("video", "frame", "prediction_id", "truth_id", rounded("iou", 6).alias("iou"))


TEAMS = """,
tm AS (SELECT video, count(*) FILTER (team = CASE truth_team WHEN 'left' THEN 1 ELSE 2 END AND truth_team IS NOT NULL) AS normal, count(*) FILTER (team = CASE truth_team WHEN 'left' THEN 2 ELSE 1 END AND truth_team IS NOT NULL) AS swapped FROM matched GROUP BY video)"""


@query("SELECT video, CASE WHEN swapped > normal THEN 'swapped' ELSE 'normal' END AS mapping, greatest(normal, swapped) AS team_correct FROM tm", TRACKS + BOXES + TEAMS)
def team_mappings(spark, sf_dir):
    return E.team_mapping(matches(spark, sf_dir), ["video"])


METRICS = ["team_correct", "matches", "jersey_total", "known_total", "jersey_correct", "wrong_known", "candidate_total", "candidate_correct"]


def _ratio(a: str, b: str, name: str) -> str:
    return f"coalesce(round({a} / nullif({b}, 0), 6), 0) AS {name}"


@query(f"""SELECT *, {_ratio('matches', 'pred_rows', 'match_rate')}, {_ratio('team_correct', 'matches', 'team_accuracy')}, {_ratio('jersey_correct', 'jersey_total', 'jersey_recall_accuracy')}, {_ratio('jersey_correct', 'known_total', 'known_pred_precision')}, {_ratio('candidate_correct', 'candidate_total', 'candidate_accuracy')}, jersey_total - known_total AS unknown_jersey
FROM (SELECT video, pred_rows, coalesce(mapping, 'normal') AS mapping, {", ".join(f"coalesce({c}, 0) AS {c}" for c in METRICS)} FROM (SELECT video, count(*) AS pred_rows FROM bx WHERE pred GROUP BY video) LEFT JOIN (
  SELECT video, mapping, team_correct, count(*) AS matches, count(truth_number) AS jersey_total, count(*) FILTER (truth_number IS NOT NULL AND jersey_number IS NOT NULL) AS known_total, count(*) FILTER (truth_number = jersey_number) AS jersey_correct, count(*) FILTER (truth_number <> jersey_number) AS wrong_known,
    count(*) FILTER (truth_number IS NOT NULL AND candidate_player_id IS NOT NULL) AS candidate_total, count(*) FILTER (candidate_player_id = 'team' || CASE WHEN (truth_team = 'left') = (mapping = 'normal') THEN 1 ELSE 2 END || '_' || lpad(CAST(truth_number AS VARCHAR), 2, '0')) AS candidate_correct
  FROM matched JOIN (SELECT video, CASE WHEN swapped > normal THEN 'swapped' ELSE 'normal' END AS mapping, greatest(normal, swapped) AS team_correct FROM tm) USING (video) GROUP BY ALL) USING (video))""", TRACKS + BOXES + TEAMS)
def run_metrics(spark, sf_dir):
    return E.run_metrics(boxes(spark, sf_dir).where("pred"), matches(spark, sf_dir), ["video"])


#: A display's number by votes against the smallest it ever had, standing in for the truth.
PREDICTED = """,
v0 AS (SELECT display_track_id, jersey_number, sum(jersey_confidence) AS score, count(*) AS n FROM r WHERE jersey_number IS NOT NULL AND team_confidence > 0.05 GROUP BY ALL),
v1 AS (SELECT *, row_number() OVER (PARTITION BY display_track_id ORDER BY score DESC, n DESC, jersey_number) AS place, sum(score) OVER (PARTITION BY display_track_id) AS total, lead(score) OVER (PARTITION BY display_track_id ORDER BY score DESC, n DESC, jersey_number) AS next FROM v0),
a AS (SELECT display_track_id, jersey_number, score / total AS confidence, score / (score + coalesce(next, 0)) AS head, (score - coalesce(next, 0)) / total AS margin, n AS votes FROM v1 WHERE place = 1),
pr AS (SELECT t.*, jersey_number, confidence, head, margin, coalesce(votes, 0) AS votes, jersey_number IS NOT NULL AS assigned, coalesce(jersey_number = truth_number, false) AS correct FROM (SELECT display_track_id, max(team) AS team, arg_max(jersey_number, jersey_confidence * 1e6 - raw_track_id / 1e6) AS truth_number FROM r WHERE jersey_number IS NOT NULL GROUP BY 1) t LEFT JOIN a USING (display_track_id))"""


def predicted(spark, sf_dir):
    from trackweave.operators.readings import vote

    seen = tracks(spark, sf_dir)
    truth = seen.where("jersey_number is not null").groupBy("display_track_id").agg(F.max("team").alias("team"), F.max_by("jersey_number", F.col("jersey_confidence") * 1e6 - F.col("raw_track_id") / 1e6).alias("truth_number"))
    read = seen.where("jersey_number is not null and team_confidence > 0.05").select("display_track_id", F.col("jersey_number").alias("number"), F.greatest("jersey_confidence", F.lit(0.0)).alias("confidence"))
    return E.predictions(truth, vote(read.where("confidence >= 0.01"), ["display_track_id"]).drop("candidates"), ["display_track_id"])


@query("SELECT display_track_id, truth_number, jersey_number, round(1e-9 + confidence, 6) AS confidence, votes, assigned, correct FROM pr", TRACKS + PREDICTED)
def number_predictions(spark, sf_dir):
    return predicted(spark, sf_dir).select("display_track_id", "truth_number", "jersey_number", rounded("confidence", 6).alias("confidence"), "votes", "assigned", "correct")


AXES = {"confidence": [0.02, 0.03, 0.04, 0.05, 0.06], "head": [0.5, 0.51, 0.52, 0.55, 0.6, 0.7], "margin": [0.0, 0.001, 0.002, 0.005, 0.01, 0.02], "votes": [1.0, 2.0, 3.0, 4.0, 5.0, 8.0]}


@query(f"""SELECT c AS confidence, h AS head, m AS margin, v AS votes, count(*) AS kept, count(*) FILTER (correct) AS "right", round(1e-9 + count(*) / (SELECT count(*) FROM pr), 6) AS coverage, round(1e-9 + count(*) FILTER (correct) / count(*), 6) AS accuracy_assigned, round(1e-9 + count(*) FILTER (correct) / (SELECT count(*) FROM pr), 6) AS accuracy_all
FROM pr, (SELECT CAST(unnest({AXES['confidence']}) AS DOUBLE) AS c), (SELECT CAST(unnest({AXES['head']}) AS DOUBLE) AS h), (SELECT CAST(unnest({AXES['margin']}) AS DOUBLE) AS m), (SELECT CAST(unnest({AXES['votes']}) AS DOUBLE) AS v) WHERE assigned AND confidence >= c AND head >= h AND margin >= m AND votes >= v GROUP BY ALL""", TRACKS + PREDICTED)
def grid_sweep(spark, sf_dir):
    out = E.grid_sweep(predicted(spark, sf_dir), AXES)
    return out.withColumns({c: rounded(c, 6) for c in ("coverage", "accuracy_assigned", "accuracy_all")})


@query("SELECT truth_number, jersey_number, count(*) AS n, array_to_string(list(CAST(display_track_id AS VARCHAR) ORDER BY display_track_id)[1:10], ';') AS examples FROM pr WHERE jersey_number <> truth_number GROUP BY 1, 2", TRACKS + PREDICTED)
def number_confusions(spark, sf_dir):
    return E.confusions(predicted(spark, sf_dir), "truth_number", "jersey_number", "display_track_id")


@query("SELECT raw_track_id, CASE WHEN frame < middle THEN 'train' ELSE 'eval' END AS part, CASE WHEN frame % 2 = 0 THEN 'train' ELSE 'eval' END AS parity FROM r JOIN (SELECT video, list_sort(list(DISTINCT frame))[count(DISTINCT frame) // 2 + 1] AS middle FROM r GROUP BY video) USING (video)", TRACKS)
def held_out_splits(spark, sf_dir):
    out = E.split_by_parity(E.split_at_median(tracks(spark, sf_dir), ["video"], "frame").withColumnRenamed("part", "median"), "frame")
    return out.select("raw_track_id", F.col("median").alias("part"), F.col("part").alias("parity"))


@query("SELECT raw_track_id FROM r WHERE jersey_number IN (SELECT jersey_number FROM players WHERE team = 1)", TRACKS)
def roster_restricted(spark, sf_dir):
    from trackweave.plans.tracks import players

    return E.restricted(tracks(spark, sf_dir), players(spark, sf_dir).where("team = 1"), "jersey_number").select("raw_track_id")


DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * z[2]))"
COSINE = f"{DOT} / sqrt({DOT.replace('{b}', '{a}')}) / sqrt({DOT.replace('{a}', '{b}')})"


@query(f"""SELECT vec_id, label, round(1e-9 + score, 4) AS score, round(1e-9 + score - coalesce(next, 0), 4) AS margin FROM (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS next FROM (
  SELECT vec_id, label, sum(greatest(0, cos)) AS score FROM (SELECT q.vec_id, t.label, {COSINE.format(a='q.embedding', b='t.embedding')} AS cos, t.vec_id AS tid FROM embeddings q, embeddings t WHERE q.vec_id % 2 = 1 AND t.vec_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY cos DESC, tid) <= 5) GROUP BY ALL)
  WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, label)) WHERE place = 1""")
def nearest_labels(spark, sf_dir):
    parts = E.split_by_parity(table(spark, sf_dir, "embeddings"), "vec_id")
    out = E.nearest_votes(parts.where("part = 'eval'"), parts.where("part = 'train'"), id="vec_id", vector="embedding", label="label", k=5)
    return out.withColumns({c: rounded(c, 4) for c in ("score", "margin")})


@query(f"""SELECT vec_id, label, round(1e-9 + cos, 5) AS similarity, round(1e-9 + cos - next, 5) AS margin FROM (SELECT e.vec_id, m.label, {COSINE.format(a='e.embedding', b='m.v')} AS cos, coalesce(lead(cos) OVER (PARTITION BY e.vec_id ORDER BY cos DESC, m.label), 0) AS next, row_number() OVER (PARTITION BY e.vec_id ORDER BY cos DESC, m.label) AS place
  FROM embeddings e, (SELECT label, list(m ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL) GROUP BY label) m) WHERE place = 1""")
def centroid_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    out = V.nearest_vector(rows, "vec_id", "embedding", V.mean_vectors(rows, "label", "embedding"), "label")
    return out.withColumns({c: rounded(c, 5) for c in ("similarity", "margin")})


#: Histograms of consecutive "frames": absolute values of embeddings, by label.
HISTOGRAMS = """h AS (SELECT label AS video, vec_id AS frame, list_transform(embedding, lambda x: abs(x)) AS hist FROM embeddings),
hs AS (SELECT * FROM (SELECT *, lag(hist) OVER w AS before, lag(frame) OVER w AS previous_frame FROM h WINDOW w AS (PARTITION BY video ORDER BY frame)) WHERE previous_frame IS NOT NULL),
sc AS (SELECT video, frame, previous_frame, 0.5 * list_sum(list_transform(list_zip(before, hist), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) ** 2 / (CAST(z[1] AS DOUBLE) + z[2] + 1e-8))) AS score, (SELECT corr(a, b) FROM (SELECT unnest(before) AS a, unnest(hist) AS b)) AS correlation FROM hs)"""


def histograms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("video"), F.col("vec_id").alias("frame"), F.transform("embedding", lambda x: F.abs(x)).alias("hist"))


def scores(spark, sf_dir):
    return S.cut_scores(histograms(spark, sf_dir), ["video"], "frame", "hist")


@query("SELECT video, frame, previous_frame, round(1e-9 + score, 4) AS score, round(1e-9 + correlation, 4) AS correlation FROM sc", HISTOGRAMS)
def histogram_distances(spark, sf_dir):
    return scores(spark, sf_dir).withColumns({c: rounded(c, 4) for c in ("score", "correlation")})


CUTS = """,
ct AS (SELECT video, frame, score, 1 AS nth FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame) AS k FROM sc WHERE score >= 1.5) WHERE k = 1
  UNION ALL SELECT c.video, n.frame, n.score, c.nth + 1 FROM ct c, LATERAL (SELECT frame, score FROM sc WHERE sc.video = c.video AND score >= 1.5 AND sc.frame - c.frame >= 40 ORDER BY frame LIMIT 1) n),
cut AS (SELECT *, CASE WHEN score >= 1.5 * 1.35 THEN 'hard_cut' ELSE 'discontinuity' END AS type FROM ct)"""
WITH_CUTS = "RECURSIVE " + HISTOGRAMS + CUTS


def found(spark, sf_dir):
    return S.cuts(scores(spark, sf_dir), ["video"], "frame", threshold=1.5, min_gap=40)


@query("SELECT video, frame, round(1e-9 + score, 4) AS score, nth, type FROM cut", WITH_CUTS)
def scene_cuts(spark, sf_dir):
    return found(spark, sf_dir).select("video", "frame", rounded("score", 4).alias("score"), "nth", "type")


@query("SELECT video, CAST(row_number() OVER (PARTITION BY video ORDER BY start) - 1 AS INTEGER) AS segment_index, start AS start_frame, coalesce(lead(start) OVER (PARTITION BY video ORDER BY start), frames) - 1 AS end_frame, coalesce(lead(start) OVER (PARTITION BY video ORDER BY start), frames) - start AS num_frames FROM (SELECT video, 0 AS start FROM h GROUP BY video UNION ALL SELECT video, frame FROM cut WHERE frame > 0) JOIN (SELECT video, max(frame) + 1 AS frames FROM h GROUP BY video) USING (video) WHERE start < frames", WITH_CUTS)
def scene_segments(spark, sf_dir):
    return S.segments(histograms(spark, sf_dir).groupBy("video").agg((F.max("frame") + 1).alias("frames")), found(spark, sf_dir), ["video"], "frame")


@query("SELECT h.video, h.frame, (SELECT CAST(count(*) AS INTEGER) FROM cut c WHERE c.video = h.video AND c.frame <= h.frame AND c.frame > 0) AS scene_segment, c.frame IS NOT NULL AS scene_cut_boundary, c.type AS scene_cut_type FROM h LEFT JOIN cut c ON h.video = c.video AND h.frame = c.frame AND c.frame > 0", WITH_CUTS)
def scene_annotations(spark, sf_dir):
    return S.annotated(histograms(spark, sf_dir).drop("hist"), found(spark, sf_dir), ["video"], "frame").drop("scene_cut_score")


@query("SELECT p.video, p.low, p.high, (SELECT min(c.frame) FROM cut c WHERE c.video = p.video AND c.frame > p.low AND c.frame <= p.high) AS cut FROM (SELECT video, frame AS low, frame + 60 AS high FROM h) p", WITH_CUTS)
def cuts_between(spark, sf_dir):
    pairs = histograms(spark, sf_dir).select("video", F.col("frame").alias("low"), (F.col("frame") + 60).alias("high"))
    return S.cut_between(pairs, found(spark, sf_dir), "video", "frame", "low", "high")


@query("SELECT raw_track_id, display_track_id + coalesce((SELECT sum(top) FROM (SELECT video AS v, frame // 200 AS seg, max(display_track_id) AS top FROM r GROUP BY ALL) t WHERE t.v = r.video AND t.seg < r.frame // 200), 0) AS new_id FROM r", TRACKS)
def reset_id_offsets(spark, sf_dir):
    rows = tracks(spark, sf_dir).withColumn("segment", F.floor(F.col("frame") / 200))
    return S.id_offsets(rows, ["video"], "segment", "display_track_id").select("raw_track_id", "new_id")
