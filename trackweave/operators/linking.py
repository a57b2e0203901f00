"""Displays joined by a shared, reliable number, and teams, referees and goalkeepers told by colour.

Rows are those of operators.constraints with x, y; a display is (video, display_track_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.scalars import safe_ratio
from trackweave.operators.aggregates import in_order
from trackweave.operators.stateful import link_candidates, link_spans

KEY = ["video", "display_track_id"]


def number_summaries(rows: DataFrame, *, order: str = "at", min_frames: int = 8, min_confidence: float = 0.35, min_head: float = 0.60, min_margin: float = 0.10, min_votes: int = 4) -> DataFrame:
    """Per display: extent, first and last place, team and number by majority, the best evidence of that number, and whether it is reliable.

    Evidence is the maximum over the rows with the number, team_confidence the
    mean over those with the team.
    """
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    place = lambda f, c: f(c, order)
    base = rows.groupBy(*KEY).agg(F.count("*").alias("num_frames"), F.min("frame").alias("start"), F.max("frame").alias("end"), place(F.min_by, "x").alias("first_x"), place(F.min_by, "y").alias("first_y"), place(F.max_by, "x").alias("last_x"), place(F.max_by, "y").alias("last_y"))
    numbers = rows.where("jersey_number is not null").groupBy(*KEY, "jersey_number").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(zero("jersey_confidence")).alias("confidence"), F.max(zero("head")).alias("head"), F.max(zero("margin")).alias("margin"), F.max(zero("jersey_votes")).cast("int").alias("votes"))
    teams = rows.where("team is not null").groupBy(*KEY, "team").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.avg(zero("team_confidence")).alias("team_confidence"))
    top = lambda df, fields: df.groupBy(*KEY).agg(F.max_by(F.struct(*fields), F.struct("n", -F.col("first"))).alias("m")).select(*KEY, "m.*")
    out = base.join(top(numbers, ["jersey_number", "confidence", "head", "margin", "votes"]), KEY, "left").join(top(teams, ["team", "team_confidence"]), KEY, "left").fillna(0.0, ["confidence", "head", "margin", "team_confidence"]).fillna(0, ["votes"])
    ok = (F.col("num_frames") >= min_frames) & F.col("jersey_number").isNotNull() & F.col("team").isNotNull() & (F.col("confidence") >= min_confidence) & (F.col("head") >= min_head) & (F.col("margin") >= min_margin) & (F.col("votes") >= min_votes)
    return out.withColumn("reliable", ok)


def number_links(summaries: DataFrame, ranges: DataFrame | None = None, *, max_gap: int = 250, max_distance: float = 140.0, sure: float = 0.60) -> DataFrame:
    """Reliable displays chained through the same number: video, id, cluster, follows.

    Teams must agree unless one of them is unsure. Pairs meet by number in
    buckets of frames; whose cluster is free is then decided in order of start.
    A cluster is free for a display that shares no frame with it; ranges (video,
    display_track_id, ranges) are the displays' frames, without which each has
    all from its start to its end.
    """
    reliable = summaries.where("reliable")
    if ranges is not None:
        reliable = reliable.join(ranges.select(*KEY, "ranges"), KEY)
    spans = reliable.select(*([] if ranges is None else ["ranges"]), F.struct("video", "jersey_number").alias("group"), F.col("display_track_id").alias("id"), "start", "end", "first_x", "first_y", "last_x", "last_y", "team", "team_confidence", F.lit(None).cast("array<double>").alias("look"))
    agree = (F.col("p.team") == F.col("c.team")) | (F.col("p.team_confidence") < sure) | (F.col("c.team_confidence") < sure)
    flat = spans.withColumn("key", F.concat_ws(":", "group.video", "group.jersey_number")).drop("group")
    found = link_candidates(flat, "key", max_gap=max_gap, max_distance=max_distance, same_team=agree, min_cosine=-1.0)
    out = link_spans(flat, found, "key", max_gap=max_gap)
    return out.select(F.substring_index("key", ":", 1).cast(summaries.schema["video"].dataType).alias("video"), "id", "cluster", "follows")


def relinked(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows under their cluster's display, with the one before where it changed."""
    moved = links.where("cluster <> id").select("video", F.col("id").alias("display_track_id"), F.col("cluster").alias("to_"))
    out = rows.join(moved, KEY, "left")
    return out.withColumns({"previous_display_id": F.when(F.col("to_").isNotNull(), F.col("display_track_id")), "display_track_id": F.coalesce("to_", "display_track_id")}).drop("to_")


def palette_choice(scores: DataFrame, keys: list[str], choice: str, score: str, *, min_score: float = 0.16, min_margin: float = 0.04) -> DataFrame:
    """Per sample its best choice by score, null under min_score or a lead of min_margin; score_best and margin besides. scores: keys, choice, score."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), choice)
    ranked = scores.withColumns({"next_": F.coalesce(F.lead(score).over(w), F.lit(0.0)), "rank_": F.row_number().over(w)}).where("rank_ = 1")
    margin = F.col(score) - F.col("next_")
    sure = (F.col(score) >= min_score) & (margin >= min_margin)
    return ranked.select(*keys, F.when(sure, F.col(choice)).alias(choice), F.col(score).alias("best_score"), margin.alias("margin"))


def palette_votes(samples: DataFrame, keys: list[str], choice: str) -> DataFrame:
    """Per key the most voted choice: its share of all samples, undecided ones included, its mean score, and the mean margin of decided samples; null without any."""
    decided = samples.where(F.col(choice).isNotNull())
    votes = decided.groupBy(*keys, choice).agg(F.count("*").alias("votes"), F.avg("best_score").alias("mean_score"))
    best = votes.groupBy(*keys).agg(F.max_by(F.struct(choice, "votes", "mean_score"), F.struct("votes", -F.col(choice))).alias("b")).select(*keys, f"b.{choice}", "b.votes", "b.mean_score")
    out = samples.groupBy(*keys).agg(F.count("*").alias("samples"), F.coalesce(F.avg(F.when(F.col(choice).isNotNull(), F.col("margin"))), F.lit(0.0)).alias("mean_margin")).join(best, keys, "left")
    return out.withColumn("confidence", safe_ratio(F.coalesce("votes", F.lit(0)).cast("double"), F.col("samples")))


def colour_summary(samples: DataFrame, keys: list[str], group: list[str], score: str, *, order: str, count_all: bool) -> DataFrame:
    """Per key the group of the best (mean score, size), scores added up in order; num_samples counts all samples of the key, or those of the group alone."""
    means = in_order(samples, keys, order).groupBy(*keys, *group).agg(F.avg(score).alias("mean_score"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    ranked = means.withColumns({"all_": F.sum("n").over(w), "rank_": F.row_number().over(w.orderBy(F.desc("mean_score"), F.desc("n"), *group))}).where("rank_ = 1")
    return ranked.select(*keys, *group, "mean_score", F.col("all_" if count_all else "n").alias("num_samples"))


def with_referees(rows: DataFrame, summary: DataFrame, *, min_score: float = 0.25, min_samples: int = 3) -> DataFrame:
    """rows with the referee colour of their display; players whose colour is sure become referee_candidate."""
    out = rows.join(summary.select(*KEY, F.col("colour").alias("referee_colour"), F.col("mean_score").alias("referee_mean"), F.col("num_samples").alias("n_")), KEY, "left")
    sure = (F.col("referee_mean") >= min_score) & (F.col("n_") >= min_samples)
    return out.withColumns({"referee_match": F.coalesce(sure, F.lit(False)), "role": F.when(F.coalesce(sure, F.lit(False)) & (F.coalesce("role", F.lit("player")) == "player"), "referee_candidate").otherwise(F.col("role"))}).drop("n_")


def with_keepers(rows: DataFrame, summary: DataFrame, *, min_score: float = 0.20, min_samples: int = 3) -> DataFrame:
    """rows with the goalkeeper kit of their display; goalkeepers of another or no team take the kit's."""
    out = rows.join(summary.select(*KEY, F.col("kit_team"), F.col("mean_score").alias("keeper_mean"), F.col("num_samples").alias("n_")), KEY, "left")
    sure = F.coalesce((F.col("keeper_mean") >= min_score) & (F.col("n_") >= min_samples), F.lit(False))
    return out.withColumns({"keeper_match": sure, "team": F.when(sure & (F.col("role") == "goalkeeper"), F.col("kit_team")).otherwise(F.col("team"))}).drop("n_", "kit_team")


def seed_frames(rows: DataFrame, *, min_frames: int = 12, min_colours: int = 8) -> DataFrame:
    """The first frames of a video, as many as bring min_frames frames and min_colours colours: the frames before both were reached, and the one that reaches them."""
    n = rows.groupBy("video", "frame").agg(F.count("colour").alias("colours"))
    before = Window.partitionBy("video").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    counted = n.withColumns({"frames_": F.count("*").over(before), "colours_": F.coalesce(F.sum("colours").over(before), F.lit(0))})
    return counted.where((F.col("frames_") < min_frames) | (F.col("colours_") < min_colours)).select("video", "frame")


def two_kits(colours: DataFrame, vector: str, *, seeds: tuple[int, ...] = (0, 42, 7, 13), least_distance: float = 30.0, least_rows: int = 8):
    """Two colour centres by k-means, the best of several seeds by how far apart they lie, in the order of their coordinates; None if there are too few or they are too near."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = colours.where(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector)).alias("features")).persist()
    try:
        if data.limit(least_rows).count() < least_rows:
            return None
        best, apart = None, -1.0
        for seed in seeds:
            a, b = (c.tolist() for c in KMeans(k=2, seed=seed).fit(data).clusterCenters())
            away = sum((p - q) ** 2 for p, q in zip(a, b)) ** 0.5
            if away > apart:
                best, apart = sorted([a, b]), away
        return best if apart >= least_distance else None
    finally:
        data.unpersist()


def kit_votes(colours: DataFrame, keys: list[str], vector: str, centres: list[list[float]], *, min_margin: float = 12.0) -> DataFrame:
    """Per key the team (1 or 2) whose centre more colours are nearer to; colours about as near to both count in the share's denominator only."""
    away = lambda c: F.sqrt(F.aggregate(F.zip_with(F.col(vector), F.array(*[F.lit(float(x)) for x in c]), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    a, b = away(centres[0]), away(centres[1])
    team = F.when(F.abs(a - b) >= min_margin, F.when(a <= b, 1).otherwise(2))
    return palette_votes(colours.where(F.col(vector).isNotNull()).select(*keys, team.alias("team"), F.lit(1.0).alias("best_score"), F.abs(a - b).alias("margin")), keys, "team")
