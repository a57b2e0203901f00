"""Queries of the trackers: a recording is ten users, a frame an hour, a detection an event."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.operators import tracking as T
from trackweave.plans.registry import query, table


def detections(spark, sf_dir):
    """Boxes that drift over the hours, so that events of a user lie near each other; looks by user."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    x = (F.col("user_id") % 10) * 90.0 + k / 4
    y = F.col("value") / 4
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("user_id") / 10).alias("video"), (F.floor(F.col("ts").cast("timestamp").cast("double") / 3600) - 473352).alias("frame"), F.col("event_id").alias("detection"), F.least(F.lit(1.0), F.col("value") / 80).alias("confidence"),
        x.alias("x1"), y.alias("y1"), (x + 60).alias("x2"), (y + 120).alias("y2"), F.when(F.col("event_type") == "purchase", "referee").otherwise("player").alias("kind"), F.array(F.cos(F.col("user_id").cast("double")), F.sin(F.col("user_id").cast("double")), F.lit(0.5)).alias("look"),
    )


@query(None)
def tracked_by_look(spark, sf_dir):
    return T.track_by_look(detections(spark, sf_dir), ["video"], "frame", T.LookRules(max_age=48))


@query(None)
def tracked_in_stages(spark, sf_dir):
    seen = detections(spark, sf_dir)
    return T.track_in_stages(seen, seen.where("frame % 168 = 0").select("video", "frame"), ["video"], "frame", T.StageRules(buffer=48))


@query(None)
def followed_object(spark, sf_dir):
    small = detections(spark, sf_dir).withColumns({"x2": F.col("x1") + 12, "y2": F.col("y1") + 12})
    out = T.follow_object(small, ["video"], "frame", T.ObjectRules(frame_area=1e6, fast=20.0))
    return out.select("video", "frame", "detection", "gap", "predicted", *[F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2", "score", "moved", "speed")])
