"""Queries over pixels: entries of an embedding are the channels of a crop's pixels, labels its recordings, nations those who play there."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.functions import colours as C
from trackweave.operators import linking as L
from trackweave.operators import palettes as P
from trackweave.operators import scenes as S
from trackweave.plans.registry import query, rounded, table

PIXELS = """c AS (SELECT label AS video, vec_id AS frame, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 2000) AS BIGINT) % 256) AS a FROM embeddings),
rgb AS (SELECT video, frame, a[3 * i + 1] AS r, a[3 * i + 2] AS g, a[3 * i + 3] AS b FROM c, (SELECT unnest(range(21)) AS i)),
px AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE (510 * d + v) // (2 * v) END AS s, CASE WHEN d = 0 THEN 0 ELSE (2 * (CASE v WHEN r THEN 30 * (g - b) + 180 * d WHEN g THEN 30 * (b - r) + 240 * d ELSE 30 * (r - g) + 300 * d END) + d) // (2 * d) % 180 END AS h FROM (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM rgb))"""
#: Colours of the roster, and in SQL their ranges: colour, part of it, bounds.
COLOURS = ["black_blue", "White", "#ff0000", "light blue", "00a0ff", "no colour", "red/white"]
RULES = """, ru(colour, word, h0, h1, s0, s1, v0, v1) AS (VALUES ('black_blue', 'black', 0, 179, 0, 140, 0, 72), ('black_blue', 'blue', 98, 132, 45, 255, 45, 255), ('White', 'white', 0, 179, 0, 55, 150, 255), ('#ff0000', '#ff0000', 0, 12, 45, 255, 95, 255), ('#ff0000', '#ff0000', 168, 179, 45, 255, 95, 255),
  ('light blue', 'light_blue', 88, 112, 35, 255, 105, 255), ('00a0ff', '00a0ff', 89, 113, 45, 255, 95, 255), ('red/white', 'red', 0, 10, 70, 255, 70, 255), ('red/white', 'red', 170, 179, 70, 255, 70, 255), ('red/white', 'white', 0, 179, 0, 55, 150, 255)),
ro AS (SELECT n_nationkey % 10 AS video, n_nationkey % 3 + 1 AS team, CASE n_nationkey % 4 WHEN 0 THEN 'referee' WHEN 1 THEN 'player' END AS role, ['black_blue', 'White', '#ff0000', 'light blue', '00a0ff', 'no colour', 'red/white'][n_nationkey % 7 + 1] AS colour FROM nation)"""


def crops(spark, sf_dir):
    channel = lambda x: (F.floor(F.abs(x.cast("double")) * 2000) % 256).cast("int")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("video"), F.col("vec_id").alias("frame"), F.slice(F.transform("embedding", channel), 1, 63).alias("rgb"))


def roster(spark, sf_dir):
    key = F.col("n_nationkey")
    colour = F.element_at(F.array(*[F.lit(c) for c in COLOURS]), (key % 7 + 1).cast("int"))
    return table(spark, sf_dir, "nation").select((key % 10).alias("video"), (key % 3 + 1).alias("team"), F.when(key % 4 == 0, "referee").when(key % 4 == 1, "player").alias("role"), colour.alias("colour"))


def scored(kind: str, who: str) -> str:
    """Scores in SQL: a crop's summed shares of the distinct colours of each choice."""
    return f""", pa AS (SELECT DISTINCT video, {who} AS choice, word, h0, h1, s0, s1, v0, v1 FROM ro JOIN ru USING (colour) WHERE {kind}),
sh AS (SELECT video, frame, choice, word, count(DISTINCT n) FILTER (h BETWEEN h0 AND h1 AND s BETWEEN s0 AND s1 AND v BETWEEN v0 AND v1) / 21 AS share FROM (SELECT *, row_number() OVER () AS n FROM px) JOIN pa USING (video) GROUP BY ALL),
sc AS (SELECT video, frame, choice, least(1.0, sum(share)) AS score FROM sh GROUP BY ALL)"""


CHOSEN = "SELECT video, frame, CASE WHEN score >= 0.16 AND score - next >= 0.04 THEN choice END AS choice, round(1e-9 + score, 6) AS best_score, round(1e-9 + score - next, 6) AS margin FROM (SELECT *, coalesce(lead(score) OVER w, 0) AS next, row_number() OVER w AS k FROM (SELECT video, frame, choice, round(score, 9) AS score FROM sc) WINDOW w AS (PARTITION BY video, frame ORDER BY score DESC, choice)) WHERE k = 1"


def chosen(spark, sf_dir, palettes):
    scores = P.palette_scores(crops(spark, sf_dir), palettes, ["video"], "rgb").withColumn("score", F.round("score", 9))
    return L.palette_choice(scores, ["video", "frame"], "choice", "score").withColumns({c: rounded(c, 6) for c in ("best_score", "margin")})


@query(CHOSEN, PIXELS + RULES + scored("role IS NULL OR role <> 'referee'", "team"))
def kit_palette_choices(spark, sf_dir):
    return chosen(spark, sf_dir, P.kit_palettes(roster(spark, sf_dir), ["video"]))


#: As an official's colour a word counts only if it is one of theirs or a hex code; composites and white aren't.
WORN = "role = 'referee' AND colour IN ('#ff0000', 'light blue', '00a0ff')"


@query(CHOSEN, PIXELS + RULES + scored(WORN, "replace(lower(colour), ' ', '_')"))
def official_palette_choices(spark, sf_dir):
    return chosen(spark, sf_dir, P.official_palettes(roster(spark, sf_dir), ["video"]))


BINS = """, hb AS (SELECT video, frame, h * 8 // 180 * 4 + s * 4 // 256 AS bin, count(*) / 21 AS share FROM px GROUP BY ALL),
hs AS (SELECT video, frame, list(coalesce(share, 0) ORDER BY bin) AS hist FROM (SELECT video, frame, bin FROM c, (SELECT unnest(range(32)) AS bin)) LEFT JOIN hb USING (video, frame, bin) GROUP BY ALL)"""


@query("SELECT video, frame, bin, round(1e-9 + share, 6) AS share FROM hb", PIXELS + BINS)
def colour_histograms(spark, sf_dir):
    """The filled bins of each crop."""
    out = crops(spark, sf_dir).select("video", "frame", F.posexplode(C.hsv_histogram("rgb", hues=8, saturations=4)).alias("bin", "share"))
    return out.where("share > 0").withColumn("share", rounded("share", 6))


@query("SELECT video, frame, previous_frame, round(1e-9 + 0.5 * list_sum(list_transform(list_zip(before, hist), lambda z: (z[1] - z[2]) ** 2 / (z[1] + z[2] + 1e-8))), 4) AS score FROM (SELECT *, lag(hist) OVER w AS before, lag(frame) OVER w AS previous_frame FROM hs WINDOW w AS (PARTITION BY video ORDER BY frame)) WHERE before IS NOT NULL", PIXELS + BINS)
def colour_cut_scores(spark, sf_dir):
    """How far each crop's colours are from those of the one before."""
    frames = crops(spark, sf_dir).withColumn("hist", C.hsv_histogram("rgb", hues=8, saturations=4))
    return S.cut_scores(frames, ["video"], "frame", "hist").select("video", "frame", "previous_frame", rounded("score", 4).alias("score"))


@query("SELECT video, frame, (r // 64 * 4 + g // 64) * 4 + b // 64 AS bin, round(1e-9 + count(*) / 21, 6) AS share FROM rgb GROUP BY ALL", PIXELS)
def rgb_histograms(spark, sf_dir):
    """The filled bins of each crop by red, green and blue."""
    out = crops(spark, sf_dir).select("video", "frame", F.posexplode(C.rgb_histogram("rgb", bins=4)).alias("bin", "share"))
    return out.where("share > 0").withColumn("share", rounded("share", 6))


@query("""SELECT video, frame, place, round(1e-9 + n / sqrt(sum(n * n) OVER (PARTITION BY video, frame)), 6) AS value FROM (
  SELECT video, frame, place, count(*) AS n FROM (SELECT video, frame, unnest([h * 12 // 180, 12 + s * 8 // 256, 20 + v * 8 // 256]) AS place FROM px) GROUP BY ALL
  UNION ALL SELECT video, frame, unnest([28, 29]), unnest([7.0 / 3.0, 3.0 / 256.0]) FROM c)""", PIXELS)
def crop_looks(spark, sf_dir):
    """The filled places of each crop's look, taken as seven pixels wide and three high."""
    out = crops(spark, sf_dir).select("video", "frame", F.posexplode(C.look("rgb", F.lit(7.0), F.lit(3.0))).alias("place", "value"))
    return out.where("value > 0").withColumn("value", rounded("value", 6))
