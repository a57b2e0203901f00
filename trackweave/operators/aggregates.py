"""Aggregations over tracklets: modes, votes, distributions, summaries and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.scalars import safe_ratio


def in_order(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """rows with those of a key together and in order, so that doubles grouped by the keys (and others) add up in that order.

    Sums of doubles depend on their order in the last bits, which decide ties
    and whether a mean reaches a limit; here neither files nor tasks do. A key
    is one task, which reads it as a sorted stream.
    """
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def mode_first_seen(df: DataFrame, keys: list[str], value: str, order: str, name: str = "mode") -> DataFrame:
    """Per key the most frequent value; of equally frequent ones the first seen. Nulls don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(name), F.max("n").alias(f"{name}_votes"))


def tracklet_summary(rows: DataFrame, keys: list[str], *, order: str, number: str, confidence: str, team: str) -> DataFrame:
    """Per tracklet: extent, modes of team and number (first seen), mean confidence over the rows of that number, and its rows.

    Rows are counted by (tracklet, number) and by (tracklet, team); all else follows from these counts.
    """
    parts = rows.groupBy(*keys, number).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"), F.avg(confidence).alias("mean"))
    best = F.max_by(F.struct(F.col(number).alias("number"), "n", "mean"), F.when(F.col(number).isNotNull(), F.struct("n", -F.col("first"))))
    out = parts.groupBy(*keys).agg(F.sum("n").alias("num_frames"), F.min("first").alias("start_frame"), F.max("last").alias("end_frame"), best.alias("b")).join(mode_first_seen(rows, keys, team, order, "main_team"), keys, "left")
    return out.withColumns({"main_number": F.col("b.number"), "main_number_votes": F.col("b.n"), "mean_confidence": F.coalesce("b.mean", F.lit(0.0)), "frame_span": F.col("end_frame") - F.col("start_frame") + 1}).drop("b")


def weighted_vote(rows: DataFrame, keys: list[str], *, number: str, confidence: str, weight: Column | None = None, order: str | None = None) -> DataFrame:
    """Per key the winner among numbers: score, share, margin to and ratio of the runner-up, votes.

    A reading counts max(0.01, confidence) times its weight, added up in the
    given order; numbers rank by score, then votes, then the smaller number.
    """
    rows = in_order(rows, keys, order) if order else rows
    value = F.greatest(F.lit(0.01), F.col(confidence)) * (weight if weight is not None else F.lit(1.0))
    scores = rows.where(F.col(number).isNotNull()).groupBy(*keys, number).agg(F.sum(value).alias("score"), F.count("*").alias("votes"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("votes"), F.asc(number))
    ranked = scores.withColumn("rank", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("score").over(w), F.lit(0.0))).withColumn("total", F.sum("score").over(Window.partitionBy(*keys)))
    best = ranked.where("rank = 1")
    return best.select(*keys, F.col(number).alias("winner"), "score", "votes", (F.col("score") / F.col("total")).alias("share"), ((F.col("score") - F.col("second")) / F.col("total")).alias("margin"), safe_ratio(F.col("second"), F.col("score")).alias("ratio"))


def crop_collapse(rows: DataFrame, crop: list[str], *, number: str, confidence: str, relative: float = 0.35, top: int = 3) -> DataFrame:
    """Per crop and number its best confidence and count; numbers under relative of the crop's best, or beyond the top ones, go."""
    best = rows.where(F.col(number).isNotNull()).groupBy(*crop, number).agg(F.max(F.least(F.col(confidence), F.lit(1.0))).alias("best"), F.count("*").alias("observations"))
    w = Window.partitionBy(*crop)
    ranked = best.withColumn("top", F.max("best").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("best"), F.desc("observations"), F.asc(number))))
    return ranked.where((F.col("best") >= relative * F.col("top")) & (F.col("rank") <= top)).drop("top")


def distribution(rows: DataFrame, keys: list[str], *, number: str, confidence: str) -> DataFrame:
    """Per key and number the share of all confidence, with votes."""
    sums = rows.where(F.col(number).isNotNull()).groupBy(*keys, number).agg(F.sum(confidence).alias("mass"), F.count("*").alias("votes"))
    return sums.withColumn("share", safe_ratio(F.col("mass"), F.sum("mass").over(Window.partitionBy(*keys))))


def mean_embedding(df: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Per key the mean of vectors, brought to length 1 (rows key, pos, value); keys with a zero mean give no rows."""
    parts = df.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    norm = F.sqrt(F.sum(F.col("mean") * F.col("mean")).over(Window.partitionBy(*keys)))
    return parts.withColumn("norm", norm).where("norm > 0").select(*keys, "pos", (F.col("mean") / F.col("norm")).alias("value"))


def group_argmax(rows: DataFrame, keys: list[str], group: str, score: str) -> DataFrame:
    """Per key the group with the best (mean score, size); ties go to the smaller group."""
    means = rows.groupBy(*keys, group).agg(F.avg(score).alias("mean"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("mean"), F.desc("n"), F.asc(group))
    return means.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def decided_votes(rows: DataFrame, keys: list[str], choice: str) -> DataFrame:
    """Per key the most frequent choice; its confidence is its share of all samples, undecided ones (null) included."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("samples"))
    best = rows.where(F.col(choice).isNotNull()).groupBy(*keys, choice).agg(F.count("*").alias("votes"))
    best = best.groupBy(*keys).agg(F.max_by(F.struct(choice, "votes"), F.struct("votes", -F.col(choice))).alias("b")).select(*keys, F.col(f"b.{choice}").alias("choice"), F.col("b.votes").alias("votes"))
    return n.join(best, keys, "left").withColumn("confidence", safe_ratio(F.coalesce("votes", F.lit(0)), F.col("samples")))


def remaining_duplicates(rows: DataFrame, frame: list[str], key: str) -> DataFrame:
    """Rows too many: sum of count - 1 over keys that stand twice or more in a frame."""
    return rows.where(F.col(key).isNotNull()).groupBy(*frame, key).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicates"))


def accuracy_metrics(df: DataFrame, keys: list[str], *, assigned: Column, correct: Column) -> DataFrame:
    """Overall and by each key (others null): coverage, accuracy of assigned rows and of all rows."""
    view = df.select(*keys, assigned.alias("is_assigned"), (assigned & correct).alias("is_correct"))
    out = view.groupingSets([[], *[[F.col(k)] for k in keys]], *[F.col(k) for k in keys]).agg(F.count("*").alias("total"), F.count_if("is_assigned").alias("assigned"), F.count_if("is_correct").alias("correct"))
    return out.withColumn("coverage", safe_ratio(F.col("assigned"), F.col("total"))).withColumn("accuracy_assigned", safe_ratio(F.col("correct"), F.col("assigned"))).withColumn("accuracy_all", safe_ratio(F.col("correct"), F.col("total")))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def threshold_sweep(df: DataFrame, score: str, correct: Column, cuts: list[float]) -> DataFrame:
    """For each cut how many rows reach it and how many of those are right; rows go to the cuts below them, counts are summed from above."""
    level = F.lit(0)
    for c in sorted(cuts):
        level = level + (F.col(score) >= c).cast("int")
    counts = df.select(level.alias("level"), correct.alias("ok")).groupBy("level").agg(F.count("*").alias("n"), F.count_if("ok").alias("right"))
    grid = df.sparkSession.createDataFrame([(i + 1, float(c)) for i, c in enumerate(sorted(cuts))], "at int, cut double")
    out = grid.join(counts, counts["level"] >= grid["at"], "left").groupBy("cut").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("kept"), F.coalesce(F.sum("right"), F.lit(0)).cast("long").alias("correct"))
    return out.withColumn("accuracy", safe_ratio(F.col("correct"), F.col("kept")))
