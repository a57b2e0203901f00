"""Promoting what an auxiliary run read into the unknown displays of a base run, with reasons, and auditing what stays unknown.

Rows have video, frame, display, team, jersey_number, jersey_confidence,
player_id and identity_confidence; a display is (video, display).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.operators.aggregates import in_order


KEY = ["video", "display"]


def unknown_displays(rows: DataFrame) -> DataFrame:
    """Displays none of whose rows has a player or a number."""
    return rows.groupBy(*KEY).agg(F.count("player_id").alias("p"), F.count("jersey_number").alias("n")).where("p = 0 and n = 0").select(*KEY)


def display_winners(rows: DataFrame) -> DataFrame:
    """Per display the (team, number) of most rows, the first seen of equals, with its rows and the middle of their confidences.

    Medians are exact with linear interpolation; missing confidences count 0.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    held = rows.where("team is not null and jersey_number is not null").groupBy(*KEY, "team", "jersey_number").agg(
        F.count("*").alias("support_frames"), F.min("at").alias("first"), F.avg(zero("jersey_confidence")).alias("mean_confidence"), F.percentile(zero("jersey_confidence"), 0.5).alias("median_confidence"),
        F.percentile(zero("jersey_confidence"), 0.75).alias("p75_confidence"), F.avg(zero("identity_confidence")).alias("mean_identity"), F.percentile(zero("identity_confidence"), 0.5).alias("median_identity"),
    )
    fields = ["team", "jersey_number", "support_frames", "mean_confidence", "median_confidence", "p75_confidence", "mean_identity", "median_identity"]
    return held.groupBy(*KEY).agg(F.max_by(F.struct(*fields), F.struct("support_frames", -F.col("first"))).alias("w")).select(*KEY, "w.*")


def judged(base: DataFrame, aux: DataFrame, roster: DataFrame, *, min_frames: int = 200, min_score: float = 0.0, min_confidence: float = 0.0, stat: str = "mean", max_spread: int = 2, single_confidence: float = 0.0, single_displays: int = 1, unique: bool = True, only_unknown: bool = True) -> DataFrame:
    """Displays of both runs with the auxiliary winner, the player it means, and the first rule it breaks as rejection.

    Score is rows times the chosen statistic of the confidence; with min_score
    it may stand in for min_frames. spread is how many displays win the same
    (team, number). A single digit of low confidence needs the player to win
    single_displays displays, counted among winners that pass the other rules.
    """
    winners = display_winners(aux)
    confidence = F.col({"mean": "mean_confidence", "median": "median_confidence", "p75": "p75_confidence"}[stat])
    spread = F.when(F.col("team").isNotNull(), F.count("*").over(Window.partitionBy("video", "team", "jersey_number")))
    winners = winners.withColumns({"filter_confidence": confidence, "spread": spread}).withColumn("support_score", F.col("support_frames") * F.col("filter_confidence"))
    players = roster.where("team is not null and jersey_number is not null").groupBy("team", "jersey_number").agg(F.array_sort(F.collect_list("player_id")).alias("players"))
    named = winners.join(players, ["team", "jersey_number"], "left").withColumn("players", F.coalesce("players", F.array().cast("array<string>")))
    few = F.col("support_frames") < min_frames
    low_score = (F.col("support_score") < min_score) if min_score > 0 else F.lit(True)
    plausible = ~(few & low_score) & (F.col("filter_confidence") >= min_confidence) & (F.col("spread") <= max_spread) & (F.size("players") == 1 if unique else F.size("players") > 0)
    counts = named.where(plausible).groupBy("video", F.col("players")[0].alias("first_player")).agg(F.count("*").alias("player_displays"))
    named = named.withColumn("first_player", F.get("players", F.lit(0))).join(counts, ["video", "first_player"], "left").fillna(0, ["player_displays"])
    both = base.select(*KEY).distinct().join(aux.select(*KEY).distinct(), KEY).join(unknown_displays(base).withColumn("unknown", F.lit(True)), KEY, "left").join(named, KEY, "left")
    reason = (
        F.when(F.lit(only_unknown) & F.col("unknown").isNull(), "baseline_not_unknown")
        .when(F.col("jersey_number").isNull(), "no_aux_winner")
        .when(few & F.lit(min_score <= 0), "below_min_support_frames")
        .when(few & low_score, "below_min_support_score")
        .when(F.col("filter_confidence") < min_confidence, "below_min_jersey_confidence")
        .when(F.col("spread") > max_spread, "jersey_display_spread")
        .when(F.lit(unique) & (F.size("players") != 1), "not_unique_roster_player")
        .when(F.size("players") == 0, "not_in_roster")
        .when(F.col("jersey_number").between(1, 9) & (F.col("filter_confidence") < single_confidence) & (F.col("player_displays") < single_displays), "single_digit_low_confidence_single_fragment")
    )
    return both.withColumn("rejection", reason).withColumn("player_id", F.when(F.col("rejection").isNull(), F.col("first_player"))).drop("unknown", "first_player", "players")


def frame_conflicts(base: DataFrame, candidates: DataFrame) -> DataFrame:
    """Frames of a candidate's display in which another display has its player or its (team, number): video, display, frame, reason.

    Two joins on equal keys find who holds the same player or number in the
    same frame. candidates: video, display, player_id, team, jersey_number.
    """
    c = candidates.select(*KEY, F.col("player_id").alias("p_"), F.col("team").alias("t_"), F.col("jersey_number").alias("n_"))
    mine = base.select(*KEY, "frame").distinct().join(c, KEY)
    other = base.select("video", "frame", F.col("display").alias("other"), "player_id", "team", "jersey_number")
    same_player = mine.alias("m").join(other.alias("o"), (F.col("m.video") == F.col("o.video")) & (F.col("m.frame") == F.col("o.frame")) & (F.col("p_") == F.col("o.player_id")) & (F.col("display") != F.col("other")))
    same_number = mine.alias("m").join(other.alias("o"), (F.col("m.video") == F.col("o.video")) & (F.col("m.frame") == F.col("o.frame")) & (F.col("t_") == F.col("o.team")) & (F.col("n_") == F.col("o.jersey_number")) & (F.col("display") != F.col("other")))
    pick = lambda df, why: df.select("m.video", "display", "m.frame", F.lit(why).alias("reason"), "other")
    return pick(same_player, "duplicate_player_id").unionByName(pick(same_number, "duplicate_team_jersey")).distinct()


def resolved(base: DataFrame, found: DataFrame, *, min_frames: int = 200, min_score: float = 0.0, partial: bool = False) -> DataFrame:
    """judged candidates after a look at conflicts: those in conflict are rejected (frame_conflict), or with partial merged in the frames that are free, if these are enough.

    valid_frames and conflict_frames are counted, partial says that only some frames take it.
    """
    ok = found.where("rejection is null")
    clash = frame_conflicts(base, ok).select(*KEY, "frame").distinct()
    frames = base.select(*KEY, "frame").distinct().join(ok.select(*KEY), KEY, "left_semi")
    counts = frames.join(clash.withColumn("clash", F.lit(1)), [*KEY, "frame"], "left").groupBy(*KEY).agg(F.count("*").alias("frames"), F.count("clash").alias("conflict_frames"))
    out = found.join(counts, KEY, "left").withColumn("valid_frames", F.col("frames") - F.col("conflict_frames")).drop("frames")
    enough = (F.col("valid_frames") >= min_frames) | (F.lit(min_score > 0) & (F.col("valid_frames") * F.col("filter_confidence") >= min_score))
    bad = F.col("rejection").isNull() & (F.col("conflict_frames") > 0)
    out = out.withColumn("partial", bad & F.lit(partial) & enough)
    return out.withColumn("rejection", F.when(bad & ~F.col("partial"), "frame_conflict").otherwise(F.col("rejection"))).withColumn("player_id", F.when(F.col("rejection").isNull(), F.col("player_id")))


def merged(base: DataFrame, accepted: DataFrame, *, apply_player: bool = True) -> DataFrame:
    """base with the candidates of accepted displays, outside their conflicts, and with apply_player as the rows' own player and number."""
    ok = accepted.where("rejection is null")
    clash = frame_conflicts(base, ok).select(*KEY, "frame").distinct().withColumn("clash_", F.lit(True))
    c = ok.select(*KEY, F.col("player_id").alias("candidate_player_id"), F.col("team").alias("candidate_team"), F.col("jersey_number").alias("candidate_number"), F.round("mean_confidence", 6).alias("candidate_confidence"), F.round("mean_identity", 6).alias("i_"), F.col("support_frames").alias("s_"))
    out = base.join(c, KEY, "left").join(clash, [*KEY, "frame"], "left")
    take = F.col("candidate_player_id").isNotNull() & F.col("clash_").isNull()
    out = out.withColumn("merged", take)
    fields = ["candidate_player_id", "candidate_team", "candidate_number", "candidate_confidence"]
    out = out.withColumns({f: F.when(F.col("merged"), F.col(f)) for f in fields})
    if apply_player:
        own = {"player_id": "candidate_player_id", "team": "candidate_team", "jersey_number": "candidate_number", "jersey_confidence": "candidate_confidence", "identity_confidence": "i_"}
        out = out.withColumns({c: F.when(F.col("merged"), F.col(n)).otherwise(F.col(c)) for c, n in own.items()})
    return out.drop("clash_", "i_", "s_")


def duplicate_frames(rows: DataFrame) -> DataFrame:
    """Frames in which a player or a (team, number) stands more than once: video, frame, what, value, n."""
    players = rows.where("player_id is not null").groupBy("video", "frame", F.lit("player").alias("what"), F.col("player_id").alias("value"))
    numbers = rows.where("team is not null and jersey_number is not null").groupBy("video", "frame", F.lit("team_jersey").alias("what"), F.concat_ws(":", "team", "jersey_number").alias("value"))
    return players.agg(F.count("*").alias("n")).unionByName(numbers.agg(F.count("*").alias("n"))).where("n > 1")


def quality_bucket(mean: Column) -> Column:
    return F.when(mean > 0.30, "high").when(mean > 0.10, "mid").otherwise("low")


def for_display(entries: DataFrame, key: str) -> DataFrame:
    """Entries under keys "display" or "display:segment" with display; those of the exact key alone where it exists."""
    parts = entries.withColumns({"display": F.substring_index(key, ":", 1), "exact_": ~F.contains(F.col(key), F.lit(":"))})
    has = F.max("exact_").over(Window.partitionBy("display"))
    return parts.withColumn("has_", has).where(~F.col("has_") | F.col("exact_")).drop("exact_", "has_")


def counted(entries: DataFrame, keys: list[str], counts: str, *, most: int = 10) -> DataFrame:
    """Maps of counts added up per key: keys, name, n, rank, the largest first, equal ones by name."""
    n = entries.select(*keys, F.explode(counts).alias("name", "c")).groupBy(*keys, "name").agg(F.sum("c").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "name"))).where(F.col("rank") <= most)


def unknown_report(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Unknown displays: extent, crop quality with its bucket, best crop, and what reading made of them.

    rows: video, display, frame, crop, crop_quality besides; entries: display,
    status, raw, voting, selected. Qualities add up in order of (frame, crop).
    """
    q = F.coalesce("crop_quality", F.lit(0.0))
    shown = in_order(rows.join(unknown_displays(rows), KEY, "left_semi"), KEY, "frame", "crop").groupBy(*KEY).agg(F.count("*").alias("n_frames"), F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.avg(q).alias("mean_quality"), F.max(q).alias("max_quality"), F.max_by("crop", F.struct(q, -F.col("frame"))).alias("best_crop"))
    statuses = entries.groupBy("display", "status").agg(F.count("*").alias("n"))
    top = statuses.groupBy("display").agg(F.min(F.struct((-F.col("n")).alias("less"), "status")).alias("t")).select("display", F.col("t.status").alias("primary_status"))
    sums = entries.groupBy("display").agg(*[F.sum(c).alias(c) for c in ("raw", "voting", "selected")])
    out = shown.join(top, "display", "left").join(sums, "display", "left").withColumn("primary_status", F.coalesce("primary_status", F.lit("not_attempted"))).fillna(0, ["raw", "voting", "selected"])
    return out.withColumn("quality_bucket", quality_bucket(F.col("mean_quality")))


def constraint_hits(rejections: DataFrame, *, most: int = 20) -> DataFrame:
    """The first rejections of each display over all kinds: display, kind, frame, place."""
    w = Window.partitionBy(*KEY).orderBy("kind", "frame", "raw_track_id")
    return rejections.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def likely_cause(dropped: Column, keeper_dropped: Column, constraint: Column, hit: Column, gate: Column, gate_pass: Column, read: Column) -> Column:
    """Why a display stayed unknown: the first stage that took something from it."""
    say = lambda prefix, c: F.when(c.isNotNull(), F.concat(F.lit(prefix), c))
    closed = F.when(~F.coalesce(gate_pass, F.lit(False)) & gate.isNotNull(), F.concat(F.lit("hungarian_gate:"), gate))
    return F.coalesce(say("roster_filter:", dropped), say("goalkeeper_ocr_filter:", keeper_dropped), say("constraint:", constraint), say("constraint:", hit), closed, F.when(read, "ocr_assigned_but_not_propagated_unclear"), F.lit("no_ocr_assignment"))


def audit_displays(rows: DataFrame, read: DataFrame) -> DataFrame:
    """Displays to audit: unknown at the end, although something was read on them."""
    return unknown_displays(rows).join(read.select("display").distinct(), "display", "left_semi").select(*KEY)


def without_keeper_readings(assignments: DataFrame, keepers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assigned numbers outside goalkeepers' displays, and those dropped on them."""
    return assignments.join(keepers.select(*KEY), KEY, "left_anti"), assignments.join(keepers.select(*KEY), KEY, "left_semi").withColumn("reason", F.lit("goalkeeper_tracklet"))
