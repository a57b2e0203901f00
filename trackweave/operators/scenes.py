"""Scene cuts from histograms of consecutive frames, and what they do to tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.scalars import chi_square


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays; of a flat one 1 if both are alike, else 0; 0 of empty ones."""
    n = F.size(a)
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double")) / n
    moment = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v) / n
    va, vb = moment(a, a) - mean(a) * mean(a), moment(b, b) - mean(b) * mean(b)
    alike = F.forall(F.zip_with(a, b, lambda p, q: F.abs(p - q) <= 1e-8 + 1e-5 * F.abs(q)), lambda x: x)
    flat = (va <= 1e-16) | (vb <= 1e-16)
    return F.when(n == 0, 0.0).when(flat, F.when(alike, 1.0).otherwise(0.0)).otherwise((moment(a, b) - mean(a) * mean(b)) / F.sqrt(va * vb))


def cut_scores(frames: DataFrame, keys: list[str], frame: str, histogram: str) -> DataFrame:
    """Per frame but the first of a key: the frame before, the chi-square distance of their histograms, and their correlation."""
    w = Window.partitionBy(*keys).orderBy(frame)
    lagged = frames.select(*keys, frame, histogram, F.lag(histogram).over(w).alias("h_"), F.lag(frame).over(w).alias("previous_frame")).where("previous_frame is not null")
    return lagged.select(*keys, frame, "previous_frame", chi_square(F.col("h_"), F.col(histogram)).alias("score"), correlation(F.col("h_"), F.col(histogram)).alias("correlation"))


def cuts(scores: DataFrame, keys: list[str], frame: str, *, threshold: float, min_gap: int, hard: float | None = None, most: int | None = None) -> DataFrame:
    """Scores that are cuts: at threshold or over, and at least min_gap frames after the last one taken, with their type and number.

    Which hit is taken depends on the one before, so hits are read as a sorted
    stream of their key with the last one taken as its state.
    """
    import pandas as pd

    from trackweave.operators.stateful import fold_ordered

    def step(state: dict, rows: pd.DataFrame) -> pd.DataFrame:
        take = []
        for at in rows[frame].tolist():
            ok = at - state.get("last", -min_gap) >= min_gap and (most is None or state.get("n", 0) < most)
            if ok:
                state |= {"last": at, "n": state.get("n", 0) + 1}
            take.append(state["n"] if ok else 0)
        return rows.assign(nth=take)[[n > 0 for n in take]]

    kinds = {f.name: f.dataType.simpleString() for f in scores.schema}
    hits = scores.where(F.col("score") >= threshold)
    found = fold_ordered(hits, keys, [frame], step, ", ".join(f"`{c}` {kinds[c]}" for c in hits.columns) + ", nth int")
    return found.withColumn("type", F.when(F.col("score") >= (1.35 * threshold if hard is None else hard), "hard_cut").otherwise("discontinuity"))


def segments(frame_counts: DataFrame, found: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """Inclusive ranges between cut frames: keys, segment_index, start_frame, end_frame, num_frames. Cuts at 0 or beyond the last frame count nothing.

    frame_counts: keys, frames. A key without cuts is one segment, without frames none.
    """
    inner = found.select(*keys, F.col(frame).alias("start_frame")).distinct().join(frame_counts, keys).where((F.col("start_frame") > 0) & (F.col("start_frame") < F.col("frames")))
    starts = frame_counts.where("frames > 0").select(*keys, F.lit(0).cast("long").alias("start_frame"), "frames").unionByName(inner.select(*keys, F.col("start_frame").cast("long"), "frames"))
    w = Window.partitionBy(*keys).orderBy("start_frame")
    out = starts.select(*keys, (F.row_number().over(w) - 1).alias("segment_index"), "start_frame", (F.coalesce(F.lead("start_frame").over(w), F.col("frames")) - 1).alias("end_frame"))
    return out.withColumn("num_frames", F.col("end_frame") - F.col("start_frame") + 1)


def annotated(rows: DataFrame, found: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """rows with scene_segment (cuts at or before their frame), scene_cut_boundary, scene_cut_score and scene_cut_type.

    Cuts go into the sorted stream of their key's rows, so no range is joined.
    """
    marks = found.where(F.col(frame) > 0).select(*keys, F.col(frame), F.col("score").alias("scene_cut_score"), F.col("type").alias("scene_cut_type"), F.lit(1).alias("cut_"))
    both = rows.withColumn("cut_", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(frame, F.desc("cut_")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("cut_") == 1, F.struct(frame, "scene_cut_score", "scene_cut_type")), True).over(w)
    out = both.withColumns({"scene_segment": F.sum("cut_").over(w), "l_": last}).where("cut_ = 0")
    here = F.coalesce(F.col(f"l_.{frame}") == F.col(frame), F.lit(False))
    return out.select(*rows.columns, F.col("scene_segment").cast("int").alias("scene_segment"), here.alias("scene_cut_boundary"), F.when(here, F.col("l_.scene_cut_score")).alias("scene_cut_score"), F.when(here, F.col("l_.scene_cut_type")).alias("scene_cut_type"))


def cut_between(pairs: DataFrame, found: DataFrame, key: str, frame: str, low: str, high: str) -> DataFrame:
    """pairs with cut: the first cut frame after low and not after high, null without one."""
    lists = found.groupBy(key).agg(F.array_sort(F.collect_set(frame)).alias("cuts_"))
    inside = F.filter("cuts_", lambda c: (c > F.col(low)) & (c <= F.col(high)))
    return pairs.join(lists, key, "left").withColumn("cut", F.array_min(inside)).drop("cuts_")


def id_offsets(rows: DataFrame, keys: list[str], segment: str, id: str) -> DataFrame:
    """rows with new_id: after a cut the tracker counts from 1 again, so ids go on above the highest of the segments before."""
    top = rows.groupBy(*keys, segment).agg(F.max(id).alias("top_"))
    before = Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(top.withColumn("offset_", F.coalesce(F.sum("top_").over(before), F.lit(0))).drop("top_"), [*keys, segment]).withColumn("new_id", F.col(id) + F.col("offset_")).drop("offset_")
