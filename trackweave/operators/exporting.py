"""The flat form of observations for other tools, its inverse, and the diagnostics of one tracked object."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from trackweave.functions.scalars import known

#: Columns of the flat form with their type and what stands for a missing value.
FLAT = {
    "frame": ("int", None), "track_group": ("string", "players"), "track_id": ("bigint", None), "raw_track_id": ("bigint", None), "display_track_id": ("bigint", None), "identity_tracklet_id": ("bigint", None), "previous_display_track_id": ("bigint", None), "interpolated": ("boolean", False),
    "role_detection": ("string", None), "player_id": ("string", "unknown"), "player_name": ("string", "unknown"), "team_id": ("int", None), "team_confidence": ("double", 0.0), "frame_team": ("int", None), "frame_team_confidence": ("double", 0.0), "frame_team_conflict": ("boolean", False),
    "semantic_group_id": ("int", None), "goalkeeper_palette_match": ("boolean", False), "goalkeeper_like_score": ("double", 0.0), "referee_like_score": ("double", 0.0), "jersey_number": ("int", None), "jersey_confidence": ("double", 0.0), "jersey_head_confidence": ("double", None),
    "jersey_winner_margin": ("double", None), "jersey_votes": ("int", 0), "jersey_segment_index": ("int", None), "jersey_candidates": ("array<struct<jersey_number:int,confidence:double,votes:int>>", None), "jersey_constraint": ("string", None), "identity_confidence": ("double", 0.0),
    "identity_evidence": ("string", None), "position": ("array<double>", None), "position_pitch": ("array<double>", None), "bbox": ("array<double>", None), "crop_path": ("string", None), "crop_quality": ("double", 0.0), "scene_segment_id": ("int", 0), "scene_cut_boundary": ("boolean", False),
    "candidate_player_id": ("string", None), "candidate_confidence": ("double", None), "candidate_reason": ("string", None),
}


def flat_rows(rows: DataFrame, named: dict[str, str] | None = None) -> DataFrame:
    """rows in the columns of FLAT: from the column that named gives, or that of the same name; what is missing gets its default."""
    named = named or {}
    out = []
    for c, (kind, default) in FLAT.items():
        source = named.get(c, c)
        value = F.col(source).cast(kind) if source in rows.columns else F.lit(None).cast(kind)
        out.append((value if default is None else F.coalesce(value, F.lit(default))).alias(c))
    return rows.select(*out)


def both_groups(players: DataFrame, referees: DataFrame) -> DataFrame:
    """Players and referees in one table, each under its track group."""
    return players.withColumn("track_group", F.lit("players")).unionByName(referees.withColumn("track_group", F.lit("referees")), allowMissingColumns=True)


def as_text(rows: DataFrame) -> DataFrame:
    """All columns as strings, nested ones as JSON, as a CSV would have them."""
    nested = (ArrayType, StructType, MapType)
    return rows.select(*[(F.to_json(f.name) if isinstance(f.dataType, nested) else F.col(f.name).cast("string")).alias(f.name) for f in rows.schema])


def parsed_rows(text: DataFrame) -> DataFrame:
    """The inverse of as_text for the columns of FLAT that are there; what doesn't parse, and the words for unknown, become null."""
    def value(c: str):
        kind = FLAT[c][0]
        if kind.startswith("array"):
            return F.from_json(c, kind)
        plain = known(F.col(c))
        return plain.try_cast("double").cast(kind) if kind in ("int", "bigint") else plain if kind == "string" else plain.try_cast(kind)

    return text.select(*[value(c).alias(c) for c in FLAT if c in text.columns])


def object_report(rows: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """Per key: rows, rows with a place, jumps between consecutive places (mean, median, 95th percentile, largest), and the longest time without one.

    Percentiles are exact with linear interpolation.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    seen = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    jumps = seen.select(*keys, F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)).alias("jump"), (F.col(order) - F.lag(order).over(w)).alias("gap"))
    stats = jumps.groupBy(*keys).agg(F.count("*").alias("detected"), F.avg("jump").alias("mean_jump"), F.percentile("jump", 0.5).alias("median_jump"), F.percentile("jump", 0.95).alias("p95_jump"), F.max("jump").alias("max_jump"), F.max("gap").alias("max_gap"))
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).join(stats, keys, "left").fillna(0, ["detected"])


def largest_jumps(rows: DataFrame, keys: list[str], order: str, x: str, y: str, most: int = 20) -> DataFrame:
    """The largest jumps of each key, with where they ended and their place in that order."""
    w = Window.partitionBy(*keys).orderBy(order)
    seen = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    jumps = seen.select(*keys, order, F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)).alias("jump")).where("jump is not null")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("jump"), order))
    return jumps.withColumn("rank", rank).where(F.col("rank") <= most)
