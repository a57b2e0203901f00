"""Queries of the field functions and of routing by class."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.functions import fields as FF
from trackweave.plans.registry import query, rounded, table
from trackweave.plans.tracks import TRACKS, tracks

BOX = """, q AS (SELECT *, x - 40 AS x1, y - 20 AS y1, x + 30.5 AS x2, y + 80.25 AS y2 FROM r)"""


def boxed(spark, sf_dir):
    return tracks(spark, sf_dir).withColumns({"x1": F.col("x") - 40, "y1": F.col("y") - 20, "x2": F.col("x") + 30.5, "y2": F.col("y") + 80.25})


@query("""SELECT raw_track_id, CASE WHEN raw_track_id % 3 < 2 THEN round(1e-9 + x1, 5) END AS x, CASE WHEN raw_track_id % 3 < 2 THEN 70.5 END AS w, CASE WHEN raw_track_id % 3 < 2 THEN round(1e-9 + 70.5 * 100.25, 5) ELSE 0 END AS area FROM q""", TRACKS + BOX)
def normal_boxes(spark, sf_dir):
    m = lambda *kv: F.create_map(*[F.lit(k) if isinstance(k, str) else k for k in kv])
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    kind = F.col("raw_track_id") % 3
    given = F.when(kind == 0, m("x", x1, "y", y1, "w", x2 - x1, "h", y2 - y1)).when(kind == 1, m("x1", x1, "y1", y1, "x2", x2, "y2", y2)).otherwise(m("x", x1))
    out = boxed(spark, sf_dir).select("raw_track_id", FF.corner_box(given).alias("b"))
    return out.select("raw_track_id", rounded("b.x", 5).alias("x"), rounded("b.w", 5).alias("w"), rounded(FF.box_area(F.col("b")), 5).alias("area"))


@query("""SELECT raw_track_id, CASE WHEN r > l AND b > t THEN l END AS "left", CASE WHEN r > l AND b > t THEN t END AS top, CASE WHEN r > l AND b > t THEN r END AS "right", CASE WHEN r > l AND b > t THEN b END AS bottom, greatest(0, least(199, CAST(trunc(x1) AS INTEGER))) AS cx1, greatest(0, least(200, CAST(trunc(x2) AS INTEGER))) AS cx2
  FROM (SELECT raw_track_id, x1, x2, greatest(0, CAST(round_even(x1 - 70.5 * 0.03, 0) AS INTEGER)) AS l, greatest(0, CAST(round_even(y1 - 100.25 * 0.03, 0) AS INTEGER)) AS t, least(200, CAST(round_even(x2 + 70.5 * 0.03, 0) AS INTEGER)) AS r, least(100, CAST(round_even(y2 + 100.25 * 0.03, 0) AS INTEGER)) AS b FROM (SELECT * REPLACE (x1 AS x1) FROM q))""", TRACKS + BOX)
def crop_windows(spark, sf_dir):
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    x1, y1 = box[0], box[1]
    out = boxed(spark, sf_dir).select("raw_track_id", FF.crop_window(x1, y1, x1 + 70.5, y1 + 100.25, 200, 100).alias("w"), FF.clipped_box(*box, 200, 100).alias("c"))
    return out.select("raw_track_id", "w.left", "w.top", "w.right", "w.bottom", F.col("c.x1").alias("cx1"), F.col("c.x2").alias("cx2"))


@query("""SELECT raw_track_id, cls, CASE WHEN ok THEN concat(cls, ' ', printf('%.6f', least(1, greatest(0, (x1 + 35.25) / 200))), ' ', printf('%.6f', least(1, greatest(0, (y1 + h / 2) / 100))), ' ', printf('%.6f', least(1, 70.5 / 200)), ' ', printf('%.6f', least(1, h / 100))) END AS line
FROM (SELECT *, h > 0 AND 70.5 * h >= 2000 AS ok FROM (SELECT *, y - 30 AS h, CASE role WHEN 'player' THEN 0 WHEN 'goalkeeper' THEN 1 WHEN 'referee' THEN 2 END AS cls FROM q)) WHERE cls IS NOT NULL""", TRACKS + BOX)
def detector_labels(spark, sf_dir):
    cls = FF.class_id(F.col("role"), "four_class")
    rel = FF.relative_box(F.col("x1"), F.col("y1"), F.lit(70.5), F.col("y") - 30, F.lit(200.0), F.lit(100.0), 2000)
    out = boxed(spark, sf_dir).select("raw_track_id", cls.alias("cls"), rel.alias("b")).where("cls is not null")
    return out.select("raw_track_id", "cls", F.when(F.col("b").isNotNull(), FF.label_line(F.col("cls"), F.col("b"))).alias("line"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 0 END AS person_ball, CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 0 WHEN 'signup' THEN 0 END AS person_only, CASE event_type WHEN 'click' THEN 'goalkeeper' WHEN 'view' THEN 'ball' WHEN 'purchase' THEN 'referee' WHEN 'signup' THEN 'other' ELSE 'odd_word' END AS role FROM events""")
def role_classes(spark, sf_dir):
    word = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "Goal Keeper", "view", "BALL", "purchase", " match-official ", "signup", "Other", "error", "odd word")]), F.col("event_type"))
    role = FF.normal_role(word)
    return table(spark, sf_dir, "events").select("event_id", FF.class_id(role, "person_ball").alias("person_ball"), FF.class_id(role, "person_only", True).alias("person_only"), role.alias("role"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CASE WHEN n BETWEEN 1 AND 99 THEN n ELSE 12 END WHEN event_id % 4 = 1 THEN 77 WHEN event_id % 4 = 2 THEN CASE WHEN n BETWEEN 1 AND 99 THEN n END END AS number FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS n FROM events)""")
def attribute_numbers(spark, sf_dir):
    k, i = F.get_json_object("props", "$.k"), F.col("event_id") % 4
    attributes = F.when(i == 0, F.create_map(F.lit("jersey"), k, F.lit("bib_number"), F.lit("no. 12"))).when(i == 1, F.create_map(F.lit("Shirt colour"), F.lit("red"), F.lit("jersey text"), F.lit("#77"))).when(i == 2, F.create_map(F.lit("number"), F.concat(F.lit("N"), k))).otherwise(F.create_map(F.lit("age"), F.lit("30")))
    return table(spark, sf_dir, "events").select("event_id", FF.attribute_number(attributes).alias("number"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'test' WHEN 3 THEN 'challenge' WHEN 4 THEN 'val' ELSE 'unknown' END AS split, CASE page_id % 6 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'val' WHEN 3 THEN 'test' WHEN 4 THEN 'val' ELSE 'train' END AS training FROM pages""")
def path_splits(spark, sf_dir):
    part = F.element_at(F.array(*[F.lit(x) for x in ("Train", "valid", "test", "challenge", "val", "contest")]), (F.col("page_id") % 6 + 1).cast("int"))
    path = F.concat(F.lit("/data/"), part, F.lit("/SNGS-1/Labels.json"))
    return table(spark, sf_dir, "pages").select("page_id", FF.path_split(path).alias("split"), FF.training_split(path).alias("training"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN CAST(event_id AS VARCHAR) ELSE k END AS text, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN 0.5 ELSE 0 END AS confidence, CASE event_id % 4 WHEN 0 THEN 'roi' ELSE 'unknown' END AS channel FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)""")
def reader_results(spark, sf_dir):
    k, i = F.get_json_object("props", "$.k"), F.col("event_id") % 4
    raw = F.when(i == 0, F.to_json(F.struct(k.alias("text"), F.col("value").alias("confidence"), F.lit("roi").alias("ocr_channel")))).when(i == 1, F.concat(F.lit('["'), k, F.lit('", 0.5]'))).when(i == 2, F.concat(F.lit('["'), k, F.lit('"]'))).otherwise(F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", FF.reading(raw).alias("r")).select("event_id", "r.*")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n, CASE event_id % 4 WHEN 0 THEN k WHEN 1 THEN k END AS first, CASE event_id % 5 WHEN 0 THEN 0.25 WHEN 1 THEN value ELSE 0 END AS evidence, CASE event_id % 3 WHEN 0 THEN k WHEN 1 THEN k END AS loose, CASE event_id % 3 WHEN 0 THEN k END AS strict FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
def json_cells(spark, sf_dir):
    k, i = F.get_json_object("props", "$.k"), F.col("event_id")
    cell = F.when(i % 4 == 0, F.concat(F.lit('[{"jersey_number": '), k, F.lit(', "confidence": 0.5, "votes": 2}, {"jersey_number": 3}]'))).when(i % 4 == 1, F.concat(F.lit('{"jersey_number": '), k, F.lit("}"))).when(i % 4 == 2, "None")
    held = F.when(i % 5 == 0, '{"confidence": 0.25}').when(i % 5 == 1, "{}").otherwise("not json")
    text = F.when(i % 3 == 0, k).when(i % 3 == 1, F.concat(k, F.lit(".0"))).otherwise("x")
    c = FF.candidate_list(cell)
    return table(spark, sf_dir, "events").select("event_id", F.size(c).alias("n"), F.get(c, F.lit(0))["jersey_number"].alias("first"), FF.evidence(held, "confidence", F.when(i % 5 == 1, F.col("value"))).alias("evidence"), FF.whole_number(text).alias("loose"), FF.strict_number(text).alias("strict"))


@query("""SELECT raw_track_id, CASE WHEN seg IS NULL THEN CAST(display_track_id AS VARCHAR) ELSE display_track_id || ':' || seg END AS key, display_track_id AS display, seg AS segment, CASE WHEN seg IS NULL THEN display_track_id ELSE display_track_id * 100000 + seg END AS tracklet FROM (SELECT *, CASE WHEN raw_track_id % 3 > 0 THEN frame // 50 END AS seg FROM r)""", TRACKS)
def segment_keys(spark, sf_dir):
    seg = F.when(F.col("raw_track_id") % 3 > 0, F.floor(F.col("frame") / 50))
    out = tracks(spark, sf_dir).select("raw_track_id", "display_track_id", seg.alias("seg")).withColumn("key", FF.group_key(F.col("display_track_id"), F.col("seg")))
    return out.select("raw_track_id", "key", FF.key_display(F.col("key")).alias("display"), FF.key_segment(F.col("key")).alias("segment"), FF.tracklet_id(F.col("display_track_id"), F.col("seg")).alias("tracklet"))


@query("""SELECT vec_id, round(1e-9 + (e[1] + e[7] * 52.5) / d, 4) AS h0, round(1e-9 + (e[6] + e[9] * 34) / d, 4) AS h5, 1.0 AS h8 FROM (SELECT *, CASE WHEN abs(e[9]) > 1e-12 THEN e[9] ELSE 1 END AS d FROM (SELECT vec_id, list_transform(embedding[1:9], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)) WHERE abs(e[9]) > 0.01""")
def pitch_homographies(spark, sf_dir):
    e = F.transform(F.slice("embedding", 1, 9), lambda x: x.cast("double"))
    out = table(spark, sf_dir, "embeddings").withColumn("e", e).where(F.abs(F.col("e")[8]) > 0.01).select("vec_id", FF.pitch_homography(F.col("e")).alias("h"))
    return out.select("vec_id", rounded(F.col("h")[0], 4).alias("h0"), rounded(F.col("h")[5], 4).alias("h5"), F.col("h")[8].alias("h8"))


@query("""SELECT vec_id, round(1e-9 + m[1] / sqrt(list_sum(list_transform(m, lambda x: x * x))), 4) AS first, round(1e-9 + m[64] / sqrt(list_sum(list_transform(m, lambda x: x * x))), 4) AS last FROM (SELECT vec_id, CASE WHEN b IS NULL THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE)) ELSE list_transform(list_zip(b, embedding), lambda z: 0.9 * z[1] + 0.1 * z[2]) END AS m FROM (SELECT *, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings))""")
def blended_vectors(spark, sf_dir):
    from pyspark.sql import Window

    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").withColumn("b", F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id")))
    out = rows.select("vec_id", FF.blended(double("b"), double("embedding"), 0.9).alias("m"))
    return out.select("vec_id", rounded(F.col("m")[0], 4).alias("first"), rounded(F.col("m")[63], 4).alias("last"))


@query("""SELECT raw_track_id, vis AS number, concat_ws(' ', coalesce(CASE semantic_group WHEN 1 THEN 'T1' WHEN 2 THEN 'T2' WHEN 3 THEN 'GK1' WHEN 4 THEN 'GK2' WHEN 5 THEN 'REF' END, 'T' || coalesce(CAST(team AS VARCHAR), '?')), '#' || vis, CASE WHEN player_id IS NOT NULL AND identity_confidence >= 0.5 THEN player_id || ' ' || printf('%.2f', identity_confidence) ELSE 'ID' || display_track_id END) AS label
FROM (SELECT *, CASE WHEN (coalesce(jersey_confidence, 0) >= 0.45 AND coalesce(jersey_votes, 0) >= 3) OR (coalesce(jersey_votes, 0) >= 8 AND coalesce(margin, 0) >= 0.10) OR (coalesce(jersey_votes, 0) >= 4 AND coalesce(head, 0) >= 0.65) THEN jersey_number END AS vis FROM (SELECT * REPLACE (floor(identity_confidence * 10) / 10 AS identity_confidence) FROM r))""", TRACKS)
def track_labels(spark, sf_dir):
    rows = tracks(spark, sf_dir).withColumn("identity_confidence", F.floor(F.col("identity_confidence") * 10) / 10)
    c = F.col
    seen = rows.withColumn("vis", FF.visible_number(c("jersey_number"), c("jersey_confidence"), c("jersey_votes"), c("head"), c("margin")))
    return seen.select("raw_track_id", c("vis").alias("number"), FF.label(c("semantic_group"), c("team"), c("vis"), c("player_id"), c("identity_confidence"), c("display_track_id")).alias("label"))


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'error') THEN 'ball' WHEN event_type = 'purchase' THEN 'referees' ELSE 'players' END AS track_group FROM events WHERE value / 500 >= CASE WHEN event_type IN ('view', 'error') THEN 0.02 ELSE 0.05 END")
def detections_by_class(spark, sf_dir):
    from trackweave.operators.windows import routed_detections

    word = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "ball", "error", "sports ball", "purchase", "referee", "click", "person", "signup", "goalkeeper")]), F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("event_id", word.alias("cls"), (F.col("value") / 500).alias("confidence"))
    return routed_detections(rows, "cls", "confidence", ball=0.02, person=0.05).select("event_id", "track_group")


@query("""SELECT raw_track_id, round(1e-9 + (x1 + x2) / 2, 5) AS cx, round(1e-9 + y2, 5) AS fy, round(1e-9 + sqrt(((x1 + x2) / 2 - x) ** 2 + (y2 - y) ** 2), 5) AS distance, round(1e-9 + common / (2 * 70.5 * 100.25 - common), 6) AS iou
FROM (SELECT *, greatest(0, 70.5 - abs(x - y)) * greatest(0, 100.25 - abs(x - y)) AS common FROM q)""", TRACKS + BOX)
def box_geometry(spark, sf_dir):
    from trackweave.functions import scalars as S

    box = F.struct("x1", "y1", "x2", "y2")
    by = F.col("x") - F.col("y")
    moved = F.struct((F.col("x1") + by).alias("x1"), (F.col("y1") + by).alias("y1"), (F.col("x2") + by).alias("x2"), (F.col("y2") + by).alias("y2"))
    rows = boxed(spark, sf_dir).withColumns({"b": box, "m": moved})
    at = F.struct("x", "y")
    return rows.select("raw_track_id", rounded(S.center(F.col("b"))["x"], 5).alias("cx"), rounded(S.foot(F.col("b"))["y"], 5).alias("fy"), rounded(S.distance(S.foot(F.col("b")), at), 5).alias("distance"), rounded(S.iou(F.col("b"), F.col("m")), 6).alias("iou"))


@query("""SELECT vec_id, round(1e-9 + least(1, greatest(0, (1 - list_sum(list_transform(list_zip(embedding, b), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) / sqrt(list_sum(list_transform(b, lambda x: CAST(x AS DOUBLE) * x)))) / 2)), 4) AS away, round(1e-9 + list_avg(list_transform(embedding, lambda x: greatest(0, least(1, CAST(x AS DOUBLE))))), 4) AS held
FROM (SELECT *, lead(embedding) OVER (ORDER BY vec_id) AS b FROM embeddings) WHERE b IS NOT NULL""")
def vector_distances(spark, sf_dir):
    from trackweave.functions import scalars as S

    rows = table(spark, sf_dir, "embeddings")
    nxt = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    held = F.aggregate(F.transform("embedding", lambda x: S.clamp(x.cast("double"))), F.lit(0.0), lambda s, v: s + v) / F.size("embedding")
    return rows.join(nxt, "vec_id").select("vec_id", rounded(S.visual_distance(F.col("embedding"), F.col("b")), 4).alias("away"), rounded(held, 4).alias("held"))
