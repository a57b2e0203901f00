"""A made-up match from the driver's tables: who was seen in which frame of which video, and the players that could be there.

The same expressions make the tables in Spark and in SQL; the operators are written twice, the data are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.plans.registry import table

#: Columns of an observation from events with k, the number in props; a frame is an hour, a video's players are forty users: videos grow in number with the users.
COLUMNS = {
    "video": "CAST(floor(user_id / 40) AS BIGINT)",
    "frame": "CAST(floor(sec / 3600) AS BIGINT) - 473352",
    "raw_track_id": "event_id",
    "display_track_id": "user_id",
    "role": "CASE event_type WHEN 'purchase' THEN 'referee' WHEN 'signup' THEN 'goalkeeper' WHEN 'click' THEN 'player' END",
    "team": "CASE WHEN user_id % 11 <> 0 THEN CAST(user_id % 2 + 1 AS INT) END",
    "team_confidence": "least(1.0, value / 200)",
    "frame_team": "CASE WHEN event_id % 7 <> 0 THEN CAST(CASE WHEN event_id % 5 < 2 THEN 2 - user_id % 2 ELSE user_id % 2 + 1 END AS INT) END",
    "frame_team_confidence": "least(1.0, value / 60)",
    "semantic_group": "CASE WHEN event_id % 17 = 0 THEN 5 WHEN event_id % 19 = 0 THEN 3 WHEN event_id % 3 = 0 THEN CAST(user_id % 2 + 1 AS INT) END",
    "palette_match": "event_id % 13 = 0",
    "jersey_number": "CAST(nullif(k, 0) AS INT)",
    "jersey_confidence": "CASE WHEN k > 0 THEN least(1.0, value / 120) END",
    "jersey_votes": "CASE WHEN k > 0 THEN CAST(event_id % 12 AS INT) END",
    "head": "CASE WHEN event_id % 4 > 0 THEN CAST(event_id * 37 % 100 AS DOUBLE) / 100 END",
    "margin": "CASE WHEN event_id % 6 > 0 THEN CAST(event_id * 53 % 50 AS DOUBLE) / 100 END",
    "player_id": "CASE WHEN event_id % 3 = 0 AND k > 0 THEN concat('P', k) END",
    "identity_confidence": "CASE WHEN event_id % 3 = 0 AND k > 0 THEN least(1.0, value / 150) ELSE CAST(0 AS DOUBLE) END",
    "crop_quality": "CAST(event_id * 29 % 100 AS DOUBLE) / 100",
    "area": "value * 10",
    "x": "value",
    "y": "CAST(k AS DOUBLE)",
    "referee_score": "CAST(event_id * 41 % 60 AS DOUBLE) / 100",
    "keeper_score": "CASE WHEN event_id % 5 > 0 THEN CAST(event_id * 31 % 50 AS DOUBLE) / 100 END",
    "keeper_team": "CASE WHEN event_id % 9 = 0 THEN CAST(event_id % 2 + 1 AS INT) END",
}
#: Numbers read on a row: jersey_number, confidence, votes.
READ = [("k % 99 + 1", "0.4", "5"), ("k * 7 % 99 + 1", "0.3", "2"), ("k * 13 % 99 + 1", "0.15", "1"), ("k * 29 % 99 + 1", "0.3", "4")]
PLAYERS = {
    "player_id": "concat('P', s_suppkey)",
    "team": "CAST(n_regionkey % 2 + 1 AS INT)",
    "jersey_number": "CASE WHEN s_suppkey % 23 > 0 THEN CAST((s_suppkey - 1) % 99 + 1 AS INT) END",
    "role": "CASE WHEN s_nationkey % 8 = 0 THEN 'goalkeeper' WHEN s_nationkey % 5 > 0 THEN 'player' END",
    "prior_x": "s_acctbal / 100",
    "prior_y": "CAST(s_nationkey * 2 AS DOUBLE)",
}

_DUCK_READ = ", ".join(f"{{'jersey_number': CAST({n} AS INTEGER), 'confidence': CAST({c} AS DOUBLE), 'votes': {v}}}" for n, c, v in READ)


def tracks_sql(columns: dict[str, str]) -> str:
    return f"""r AS (SELECT {", ".join(f"{e} AS {c}" for c, e in columns.items())}, [{_DUCK_READ}] AS candidates
  FROM (SELECT *, epoch(ts) AS sec, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
players AS (SELECT {", ".join(f"{e} AS {c}" for c, e in PLAYERS.items())} FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


TRACKS = tracks_sql(COLUMNS)
#: The same with all users in four videos, where far more of them meet; for queries that compare rows of a video.
CROWDED = COLUMNS | {"video": "user_id % 4"}
CROWDED_TRACKS = tracks_sql(CROWDED)


def tracks(spark: SparkSession, sf_dir: str, columns: dict[str, str] = COLUMNS) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    base = table(spark, sf_dir, "events").withColumns({"k": k, "sec": F.col("ts").cast("timestamp").cast("double")})
    read = F.array(*[F.struct(F.expr(n).cast("int").alias("jersey_number"), F.lit(float(c)).alias("confidence"), F.lit(int(v)).alias("votes")) for n, c, v in READ])
    return base.select(*[F.expr(e).alias(c) for c, e in columns.items()], read.alias("candidates"))


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(*[F.expr(e).alias(c) for c, e in PLAYERS.items()])
