"""Ordered operators: segments, islands, interpolation, ranks and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segment_number(frame: Column, length: int) -> Column:
    """Tumbling segments of length frames."""
    return F.floor(frame / length).cast("int")


def routed_detections(rows: DataFrame, cls: str, confidence: str, *, ball: float, person: float) -> DataFrame:
    """Detections of known classes over their class's threshold, with the track group that they go to: players, referees or ball."""
    group = F.when(F.col(cls).isin("ball", "sports ball"), "ball").when(F.col(cls) == "referee", "referees").when(F.col(cls).isin("person", "player", "goalkeeper"), "players")
    return rows.withColumn("track_group", group).where(F.col(confidence) >= F.when(F.col("track_group") == "ball", ball).when(F.col("track_group").isNotNull(), person))


def running_segments(df: DataFrame, keys: list[str], order: str, is_cut: Column, name: str = "segment_index") -> DataFrame:
    """How many cuts lie at or before each row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(is_cut.cast("int")).over(w))


def segment_ranges(df: DataFrame, keys: list[str], order: str, segment: str) -> DataFrame:
    return df.groupBy(*keys, segment).agg(F.min(order).alias("start_frame"), F.max(order).alias("end_frame"), F.count("*").alias("num_frames"))


def sessions(df: DataFrame, keys: list[str], order: str, gap: Column, name: str = "session") -> DataFrame:
    """Rows of a key further apart than the gap (a condition on `previous`) begin a new session."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("previous", F.lag(order).over(w)).withColumn("begins", F.col("previous").isNull() | gap)
    return running_segments(marked, keys, order, F.col("begins"), name).drop("previous", "begins")


def refractory(df: DataFrame, keys: list[str], order: str, score: Column, threshold: float, min_gap: int) -> DataFrame:
    """Rows whose score reaches the threshold, each at least min_gap after the last accepted one: the hits of a key as a sorted stream with that one as its state."""
    from trackweave.operators.stateful import fold_ordered

    def step(state: dict, rows):
        take = []
        for at in rows[order].tolist():
            take.append("last" not in state or at - state["last"] >= min_gap)
            if take[-1]:
                state["last"] = at
        return rows[take]

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    hits = df.where(score >= threshold).select(*keys, order)
    return fold_ordered(hits, keys, [order], step, ", ".join(f"`{c}` {kinds[c]}" for c in hits.columns))


def compact_ranges(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Runs of consecutive whole numbers."""
    w = Window.partitionBy(*keys).orderBy(value)
    return df.select(*keys, value).distinct().withColumn("island", F.col(value) - F.row_number().over(w)).groupBy(*keys, "island").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n")).drop("island")


def conflict_islands(df: DataFrame, keys: list[str], order: str | list[str], team: str, *, max_gap: int, min_rows: int) -> DataFrame:
    """Runs of rows in conflict (team not null), bridged over at most max_gap other rows.

    A run ends when more rows without conflict pass, the conflicting team
    changes, or the first order column moves on by more than max_gap + 1.
    Rows inside a run without conflict are its bridges; runs of fewer than
    min_rows rows, bridges included, are left out. first_row and last_row are
    places among the rows of the key.
    """
    order = [order] if isinstance(order, str) else order
    w = Window.partitionBy(*keys).orderBy(*order)
    hits = df.withColumn("row", F.row_number().over(w)).where(F.col(team).isNotNull())
    v = Window.partitionBy(*keys).orderBy("row")
    past = F.lag("row").over(v)
    new = past.isNull() | (F.col("row") - past - 1 > max_gap) | (F.lag(team).over(v) != F.col(team)) | (F.col(order[0]) - F.lag(order[0]).over(v) > max_gap + 1)
    runs = hits.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*keys, "run").agg(F.first(team).alias("team"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.count("*").alias("conflicts"))
    out = out.withColumn("bridges", F.col("last_row") - F.col("first_row") + 1 - F.col("conflicts"))
    return out.where(F.col("conflicts") + F.col("bridges") >= min_rows)


def interpolate(df: DataFrame, keys: list[str], order: str, value: str, position: str) -> DataFrame:
    """Fill nulls of value on the straight line between the nearest known rows by position; ends take the nearest known value."""
    back = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(position))
    p0, p1 = F.last(at, True).over(back), F.first(at, True).over(ahead)
    v0, v1 = F.last(value, True).over(back), F.first(value, True).over(ahead)
    line = F.when(p0 == p1, v0).otherwise(v0 + (v1 - v0) * (F.col(position) - p0) / (p1 - p0))
    return df.withColumn("filled", F.coalesce(F.col(value), line, v0, v1)).withColumn("interpolated", F.col(value).isNull() & F.col("filled").isNotNull())


def jumps(df: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """Distance and gap to the previous known position."""
    w = Window.partitionBy(*keys).orderBy(order)
    seen = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return seen.withColumn("jump", F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))).withColumn("gap", F.col(order) - F.lag(order).over(w))


def keep_best(df: DataFrame, keys: list[str], order: list[Column], name: str = "kept") -> DataFrame:
    """Marks the first row of each key in the order; rows without a key are kept."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return df.withColumn(name, missing | (rank == 1))


def best_and_margin(df: DataFrame, keys: list[str], score: str, tie: str, default: float = 0.0, ascending: bool = False) -> DataFrame:
    """Best row of each key and its lead over the runner-up (default where there is none)."""
    first = F.asc(score) if ascending else F.desc(score)
    w = Window.partitionBy(*keys).orderBy(first, F.asc(tie))
    second = F.coalesce(F.lead(score).over(w), F.lit(default))
    margin = (second - F.col(score)) if ascending else (F.col(score) - second)
    return df.withColumn("rank", F.row_number().over(w)).withColumn("margin", margin).where("rank = 1").drop("rank")


def relative_weight(df: DataFrame, keys: list[str], quality: str, low: float = 0.2, power: float = 1.0) -> DataFrame:
    """Quality inside its key, scaled to low..1; 1 where all are alike."""
    w = Window.partitionBy(*keys)
    least, span = F.min(quality).over(w), F.max(quality).over(w) - F.min(quality).over(w)
    share = F.pow((F.col(quality) - least) / F.nullif(span, F.lit(0.0)), F.lit(power))
    return df.withColumn("vote_weight", F.coalesce(low + (1 - low) * share, F.lit(1.0)))


def quality_filter(df: DataFrame, keys: list[str], quality: str, least: float, few: int = 3) -> DataFrame:
    """Rows of at least that quality; all rows of a key where fewer than few have it."""
    n = F.sum((F.col(quality) >= least).cast("int")).over(Window.partitionBy(*keys))
    return df.withColumn("good_", n).where((F.col(quality) >= least) | (F.col("good_") < few)).drop("good_")


def bucket_sample(df: DataFrame, keys: list[str], order: str, quality: str, buckets: int) -> DataFrame:
    """One row from each of as many equal stretches of a key's rows in order: that of the best quality."""
    w = Window.partitionBy(*keys)
    placed = df.withColumn("bucket", F.floor((F.row_number().over(w.orderBy(order)) - 1) * buckets / F.count("*").over(w)).cast("int"))
    best = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(F.desc(quality), F.asc(order)))
    return placed.withColumn("rank_", best).where("rank_ = 1").drop("rank_")


def cap_per_label(df: DataFrame, label: str, order: str, most: int) -> DataFrame:
    """At most that many rows of each label, in order."""
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(label).orderBy(order))).where(F.col("rank_") <= most).drop("rank_")


def trim_ends(df: DataFrame, keys: list[str], order: str, buffer: int) -> DataFrame:
    """Without buffer rows at both ends of each key that has more than twice as many."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("n_", F.count("*").over(w)).withColumn("up_", F.row_number().over(w.orderBy(order)))
    return ranked.where((F.col("n_") <= 2 * buffer) | ((F.col("up_") > buffer) & (F.col("up_") <= F.col("n_") - buffer))).drop("n_", "up_")
