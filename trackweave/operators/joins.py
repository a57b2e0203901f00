"""Joins by range, nearest row, degraded keys, overlap and conflict; optimal assignment."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.scalars import iou


def first_covering(rows: DataFrame, segments: DataFrame, key: str, frame: str, *, width: int) -> DataFrame:
    """Left join of each row with the first segment (by start, end) of its key that covers its frame.

    Segments are dealt to buckets of width frames and gathered there, so the
    join is on equal keys, every row meets one list of those that touch its
    bucket, and rows need not be told apart: repeated rows and rows with nulls
    stay as they are. segments: key, start_frame, end_frame and others.
    """
    extra = [c for c in segments.columns if c != key]
    one = F.struct("start_frame", "end_frame", *[c for c in extra if c not in ("start_frame", "end_frame")])
    spread = segments.select(F.col(key).alias("key_"), one.alias("s_"), F.explode(F.sequence(F.floor(F.col("start_frame") / width), F.floor(F.col("end_frame") / width))).alias("bucket_"))
    lists = spread.groupBy("key_", "bucket_").agg(F.array_sort(F.collect_list("s_")).alias("near_"))
    joined = rows.withColumn("at_", F.floor(F.col(frame) / width)).join(lists, (F.col(key) == F.col("key_")) & (F.col("at_") == F.col("bucket_")), "left")
    here = F.get(F.filter("near_", lambda s: F.col(frame).between(s["start_frame"], s["end_frame"])), F.lit(0))
    return joined.withColumn("hit_", here).select(*[rows[c] for c in rows.columns], *[F.col(f"hit_.{c}").alias(c) for c in extra])


def nearest(rows: DataFrame, anchors: DataFrame, keys: list[str], order: str, value: str, max_gap: int) -> DataFrame:
    """As-of join with the closest anchor of the key; a tie goes to the earlier one; null beyond max_gap. One sort by key serves both directions."""
    a = anchors.select(*keys, order, F.col(value).alias("anchor_"), F.lit(0).alias("side_"))
    both = rows.withColumn("side_", F.lit(1)).withColumn("anchor_", F.lit(None).cast(anchors.schema[value].dataType)).unionByName(a, allowMissingColumns=True)
    back = Window.partitionBy(*keys).orderBy(order, "side_").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(order, F.desc("side_")).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("side_") == 0, F.struct(F.col(order).alias("o"), F.col("anchor_").alias("v")))
    both = both.withColumn("b_", F.last(at, True).over(back)).withColumn("f_", F.first(at, True).over(ahead)).where("side_ = 1")
    to_b, to_f = F.col(order) - F.col("b_.o"), F.col("f_.o") - F.col(order)
    pick = F.when(to_f.isNull() | (to_b <= to_f), F.struct(to_b.alias("gap"), F.col("b_.v").alias("v"))).otherwise(F.struct(to_f.alias("gap"), F.col("f_.v").alias("v")))
    both = both.withColumn("p_", pick)
    near = F.col("p_.gap") <= max_gap
    return both.withColumn("nearest_value", F.when(near, F.col("p_.v"))).withColumn("nearest_gap", F.when(near, F.col("p_.gap"))).drop("side_", "anchor_", "b_", "f_", "p_")


def roster_lookup(rows: DataFrame, roster: DataFrame, *, team: str = "team_id", number: str = "jersey_number") -> DataFrame:
    """Roster players by (team, number); rows of unknown team match on the number alone, perhaps several."""
    r = roster.select(F.col("player_id"), F.col("team_id").alias("t_"), F.col("jersey_number").alias("n_"))
    return rows.join(r, (F.col(number) == F.col("n_")) & (F.col(team).isNull() | (F.col(team) == F.col("t_"))), "left").drop("t_", "n_")


def _cells(rows: DataFrame, box: str, side: str, above: int) -> DataFrame:
    """rows at each cell that its box touches, in the grid of its own size (level_) and the next coarser ones; at most four cells of each."""
    b = F.col(box)
    longest = F.greatest(b["x2"] - b["x1"], b["y2"] - b["y1"])
    sized = rows.where((b["x2"] > b["x1"]) & (b["y2"] > b["y1"]) & (longest < float("inf"))).withColumn(f"{side}_level_", F.ceil(F.log2(longest) / 2))
    at = sized.withColumn("level_", F.explode(F.sequence(F.col(f"{side}_level_"), F.col(f"{side}_level_") + above))).withColumn("size_", F.pow(F.lit(4.0), F.col("level_")))
    for c in ("x", "y"):
        at = at.withColumn(f"c{c}_", F.explode(F.sequence(F.floor(b[f"{c}1"] / F.col("size_")), F.floor(b[f"{c}2"] / F.col("size_")))))
    return at if side == "a" else at.drop("size_")


def near_boxes(a: DataFrame, b: DataFrame, keys: list[str], a_box: str, b_box: str, *, least: float) -> DataFrame:
    """Pairs of equal keys whose boxes touch and are of a size by which their overlap could be least (over 0) or more; each pair once.

    Grids have cells of 4^level, and a box's own level is that of its longer
    side. Boxes that overlap by least differ by a known number of levels, so
    both stand in the grid of the larger one's level; the pair belongs to the
    cell that holds the corner where their intersection begins. The join is on
    equal keys and cells: a crowded frame is divided by place, and no box is
    too large. Null, empty and endless boxes touch nothing.
    """
    above = math.ceil(math.log(1 / least, 4) + 1e-9)
    both = _cells(a, a_box, "a", above).join(_cells(b, b_box, "b", above), [*keys, "level_", "cx_", "cy_"])
    owner = [F.floor(F.greatest(F.col(a_box)[f"{c}1"], F.col(b_box)[f"{c}1"]) / F.col("size_")) == F.col(f"c{c}_") for c in ("x", "y")]
    mine = (F.col("level_") == F.greatest("a_level_", "b_level_")) & owner[0] & owner[1]
    return both.where(mine).drop("level_", "a_level_", "b_level_", "size_", "cx_", "cy_")


def best_overlap(predictions: DataFrame, truth: DataFrame, frame: list[str], *, boxes: tuple[str, str] = ("p_box", "t_box"), least: float) -> DataFrame:
    """Each prediction's truth of the same frame with the largest overlap of at least least; the smallest truth_id of equal ones.

    Equal boxes of a frame overlap alike, so only distinct ones meet: a truth
    box stands for its smallest id, and all predictions of a box take its match.
    """
    mine, other = boxes
    distinct, owned = predictions.select(*frame, mine).distinct(), truth.groupBy(*frame, other).agg(F.min("truth_id").alias("truth_id"))
    pairs = near_boxes(distinct, owned, frame, *boxes, least=least).withColumn("iou", iou(F.col(mine), F.col(other))).where(F.col("iou") >= least)
    best = F.max_by(F.struct("truth_id", "iou"), F.struct("iou", -F.col("truth_id"))).alias("m")
    matched = predictions.join(pairs.groupBy(*frame, mine).agg(best).select(*frame, mine, "m.*"), [*frame, mine])
    return matched.groupBy(*frame, "prediction_id").agg(best).select(*frame, "prediction_id", "m.truth_id", "m.iou")


def prefer(primary: DataFrame, fallback: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer join that takes the primary's value where it has one."""
    p, f = primary.select(*keys, F.col(value).alias("p_")), fallback.select(*keys, F.col(value).alias("f_"))
    return p.join(f, keys, "full").select(*keys, F.coalesce("p_", "f_").alias(value), F.when(F.col("p_").isNotNull(), "primary").when(F.col("f_").isNotNull(), "fallback").alias("origin"))


def conflict_free(rows: DataFrame, frame: list[str], owner: str, value: str) -> DataFrame:
    """Rows whose value no other owner holds in the same frame."""
    w = Window.partitionBy(*frame, value)
    return rows.withColumn("lo_", F.min(owner).over(w)).withColumn("hi_", F.max(owner).over(w)).where((F.col("lo_") == F.col("hi_")) | F.col(value).isNull()).drop("lo_", "hi_")


def candidate_edges(spans: DataFrame, key: list[str], *, id: str, start: str, end: str, max_gap: int, bucket: int) -> DataFrame:
    """Pairs of spans of a key where the second begins 1 to max_gap after the first ends.

    Ends go to one bucket, starts to the buckets from which they can be
    reached, so each pair meets exactly once and only near spans are compared.
    """
    reach = max_gap // bucket + 1
    left = spans.select(*key, F.col(id).alias("source"), F.col(end).alias("source_end"), F.floor(F.col(end) / bucket).alias("b_"))
    right = spans.select(*key, F.col(id).alias("target"), F.col(start).alias("target_start"), F.explode(F.sequence(F.floor(F.col(start) / bucket) - reach, F.floor(F.col(start) / bucket))).alias("b_"))
    gap = F.col("target_start") - F.col("source_end")
    return left.join(right, [*key, "b_"]).where((F.col("source") != F.col("target")) & gap.between(1, max_gap)).withColumn("gap", gap).drop("b_")


def least_cost_assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a one-to-one assignment of least total cost, by shortest augmenting paths with potentials."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, owner = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)
    for row in range(n):
        owner[m], col = row, m
        dist, back, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[col] >= 0:
            done[col] = True
            i, open_ = owner[col], ~done[:m]
            reduced = c[i] - u[i] - v[:m]
            better = open_ & (reduced < dist)
            dist[better], back[better] = reduced[better], col
            col_next = int(np.where(open_, dist, np.inf).argmin())
            step = dist[col_next]
            u[owner[done]] += step
            v[done] -= step
            dist[open_] -= step
            col = col_next
        while col != m:
            owner[col] = owner[back[col]]
            col = back[col]
    cols = np.flatnonzero(owner[:m] >= 0)
    rows = owner[cols]
    order = np.argsort(rows)
    rows, cols = rows[order], cols[order]
    return (cols, rows) if flip else (rows, cols)


def assign_one_to_one(costs: DataFrame, group: str, *, row: str, column: str, cost: str, most: float) -> DataFrame:
    """Per group the assignment of least total cost over all (row, column, cost), dropping pairs over most.

    A group is one recording: tracklets by roster players, a matrix of bounded size.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot_table(index=row, columns=column, values=cost, aggfunc="min", fill_value=1e6).sort_index().sort_index(axis=1)
        r, c = least_cost_assignment(grid.to_numpy(float))
        out = pd.DataFrame({group: pdf[group].iloc[0], row: grid.index[r], column: grid.columns[c], cost: grid.to_numpy(float)[r, c]})
        return out[out[cost] <= most]

    kinds = {f.name: f.dataType.simpleString() for f in costs.schema}
    return costs.select(group, row, column, cost).groupBy(group).applyInPandas(solve, f"{group} {kinds[group]}, {row} {kinds[row]}, {column} {kinds[column]}, {cost} double")

