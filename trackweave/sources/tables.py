"""Reading rosters, ground truth and tracklet tables into typed relations, and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions.scalars import known

ROSTER = "player_id string, name string, team_id int, jersey_number int, role string, position_prior struct<x:double,y:double>, visual_embedding array<float>, metadata map<string,string>"


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """A roster JSON list; numbers outside 1 to 99 are null, and a (team, number) that stands twice is an error."""
    roster = spark.read.option("multiLine", True).schema(ROSTER).json(path)
    roster = roster.withColumn("jersey_number", F.when(F.col("jersey_number").between(1, 99), F.col("jersey_number")))
    twice = roster.where("jersey_number is not null").groupBy("team_id", "jersey_number").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"numbers given twice in a team: {[(r[0], r[1]) for r in twice]}")
    return roster


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with frames from 1; frames are counted from 0 here."""
    schema = "sequence string, split string, frame int, role string, team string, jersey_number int, bbox array<double>, track_id int"
    return spark.read.schema(schema).json(path).withColumn("frame", F.col("frame") - 1)


def read_tracklets_csv(spark: SparkSession, path: str) -> DataFrame:
    """A tracklet table of strings; the sentinels of unknown values become null."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return raw.select(*[known(F.col(c)).alias(c) for c in raw.columns])


def write_tracklets_csv(df: DataFrame, path: str) -> None:
    """Nested columns as JSON; nothing is written for an empty table."""
    if df.isEmpty():
        return
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def latest_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Records read later replace earlier ones of the same key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")


def cache_misses(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return rows.join(cache.select(key), key, "left_anti")
