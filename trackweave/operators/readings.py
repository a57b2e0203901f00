"""Numbers read on crops: choice of crops, votes in two steps, roster filter, and candidates by segment.

Readings have display, crop, frame, number, confidence, channel, source,
variant, vote_weight, text and error; crops display, crop, frame, quality,
x1, y1, x2, y2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.scalars import clamp
from trackweave.operators.constraints import KEEPERS, REFEREES, _is, number_sets


def eligible_rows(rows: DataFrame) -> DataFrame:
    """Rows on which a number may be read: no referees by role or group."""
    return rows.where(~_is(F.col("role"), REFEREES) & ~F.coalesce(F.col("semantic_group") == 5, F.lit(False)))


def crop_score(quality: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Quality, up to 0.4 more for size and 0.15 for the shape of a standing person (fixed values of the score)."""
    wide, high = F.greatest(F.lit(1.0), x2 - x1), F.greatest(F.lit(1.0), y2 - y1)
    shape = F.when((high / wide).between(1.6, 4.5), 0.15).otherwise(0.0)
    return F.coalesce(quality, F.lit(0.0)) + F.coalesce(F.least(F.lit(0.4), wide * high / 50000.0) + shape, F.lit(0.0))


def crop_quality(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Quality of a box in a frame: its share of the frame against 2 %, a little for height, less where it touches the left, right or upper border."""
    share = F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0)) / F.greatest(width * height, F.lit(1.0))
    border = ((x1 <= 1) | (y1 <= 1) | (x2 >= width - 1)).cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share / 0.02) + F.least(F.lit(0.2), F.greatest(y2 - y1, F.lit(0.0)) / 500) - 0.4 * border)


def combined_confidence(recognition: Column, detection: Column) -> Column:
    """The reader's confidence, a quarter of which depends on the detector's; the reader's alone without one. Both are held to 0..1."""
    rec, det = clamp(F.coalesce(recognition, F.lit(0.0))), clamp(detection)
    return F.when(detection.isNull() | (det <= 0), rec).otherwise(clamp(rec * (0.75 + 0.25 * det)))


def mean_score(scores: Column) -> Column:
    """Mean of the finite values of an array, between 0 and 1; 0 without any."""
    finite = F.filter(scores, lambda s: s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")))
    total = F.aggregate(finite, F.lit(0.0), lambda a, s: a + s)
    return F.when(F.size(finite) > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), total / F.size(finite)))).otherwise(0.0)


def spread_crops(crops: DataFrame, *, most: int, passes: int = 1, at_pass: int = 0) -> DataFrame:
    """Crops of a display spread over its time, with the best by crop_score besides; in_bucket and in_top say why one was taken.

    target = min(most, rows) buckets of equal depth are taken, out of
    min(rows, target * passes) with those of at_pass; a bucket gives its crop
    of the best quality, the first of equals. The best target // 2 (one at
    least) by score follow, at most 2 * most in all in that order. Bounds are
    rounded half to even.
    """
    w = Window.partitionBy("display")
    order = ["frame", "crop"]
    ranked = crops.withColumns({"n": F.count("*").over(w), "at": F.row_number().over(w.orderBy(*order)) - 1, "score": crop_score(F.col("quality"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))})
    target = F.least(F.lit(most), F.col("n"))
    ranked = ranked.withColumns({"target": target, "buckets": F.least(F.col("n"), target * passes)})
    edge = lambda b: F.bround(b * F.col("n") / F.col("buckets")).cast("long")
    # each row lies in one bucket; rounding moves a bound by one at most
    guess = F.floor(F.col("at") * F.col("buckets") / F.col("n"))
    bucket = F.when(edge(guess) > F.col("at"), guess - 1).when(edge(guess + 1) <= F.col("at"), guess + 1).otherwise(guess)
    ranked = ranked.withColumn("bucket", bucket)
    chosen = F.array_contains(F.transform(F.sequence(F.lit(0).cast("long"), F.col("target") - 1), lambda i: F.least(F.col("buckets") - 1, i * passes + at_pass)), F.col("bucket"))
    best = F.row_number().over(Window.partitionBy("display", "bucket").orderBy(F.desc_nulls_last("quality"), *order))
    top = F.row_number().over(w.orderBy(F.desc("score"), *order))
    ranked = ranked.withColumns({"in_bucket": chosen & (best == 1), "top": top})
    ranked = ranked.withColumn("in_top", F.col("top") <= F.greatest(F.lit(1), F.floor(F.col("target") / 2)))
    place = F.row_number().over(w.orderBy(F.desc("in_bucket"), F.when(F.col("in_bucket"), F.col("at")).otherwise(F.col("top"))))
    return ranked.where("in_bucket or in_top").withColumn("place", place).where(F.col("place") <= 2 * most).select(*crops.columns, "score", "in_bucket", "in_top")


def even_crops(crops: DataFrame, *, most: int) -> DataFrame:
    """At most that many crops of a display at even distances in time; where places fall together the largest boxes fill up."""
    w = Window.partitionBy("display")
    size = F.greatest(F.col("x2") - F.col("x1"), F.lit(0.0)) * F.greatest(F.col("y2") - F.col("y1"), F.lit(0.0))
    ranked = crops.withColumns({"n": F.count("*").over(w), "at": F.row_number().over(w.orderBy("frame", "crop")) - 1, "size": size})
    places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.least(F.col("n") - 1, F.bround(i * (F.col("n") - 1) / max(1, most - 1)).cast("long")))
    ranked = ranked.withColumn("even", (F.col("n") <= most) | F.array_contains(places, F.col("at")))
    rank = F.row_number().over(w.orderBy(F.desc("even"), F.when(F.col("even"), F.col("at")), F.desc("size"), "at"))
    return ranked.withColumn("rank_", rank).where((F.col("n") <= most) | (F.col("rank_") <= most)).select(*crops.columns, "even")


def selection_report(crops: DataFrame, selected: DataFrame, least_quality: float) -> DataFrame:
    """Per display how many crops there were, were usable and were taken, and the range and mean of their quality."""
    good = F.coalesce(F.col("quality"), F.lit(0.0)) >= least_quality
    base = crops.groupBy("display").agg(F.count("*").alias("available"), F.count_if(good).alias("good"), F.min(F.coalesce("quality", F.lit(0.0))).alias("min_quality"), F.max(F.coalesce("quality", F.lit(0.0))).alias("max_quality"), F.avg(F.coalesce("quality", F.lit(0.0))).alias("mean_quality"))
    taken = selected.groupBy("display").agg(F.count("*").alias("selected"))
    out = base.join(taken, "display", "left").withColumns({"selected": F.coalesce("selected", F.lit(0)), "usable": F.when(F.col("good") >= 3, F.col("good")).otherwise(F.col("available"))})
    return out.withColumn("unselected", F.greatest(F.lit(0), F.col("usable") - F.col("selected"))).drop("good")


def template_allowed(candidates: DataFrame, readings: DataFrame, *, least: float = 0.78) -> DataFrame:
    """Template matches that a reading of their crop agrees with, or that are two sure digits."""
    read = readings.where("number is not null").select("crop", F.col("number")).distinct().withColumn("read_", F.lit(True))
    out = candidates.join(read, ["crop", "number"], "left")
    return out.where(F.col("read_") | ((F.col("number") >= 10) & (F.coalesce("confidence", F.lit(0.0)) >= least))).drop("read_")


def template_variant(name: Column) -> Column:
    return ~F.contains(name, F.lit("full_body")) & (F.contains(name, F.lit("back_number")) | F.contains(name, F.lit("upper")) | F.contains(name, F.lit("torso")))


def direct_variant(name: Column) -> Column:
    return ~F.contains(name, F.lit("full_body")) & (F.contains(name, F.lit("upper_back")) | F.contains(name, F.lit("center_back")) | F.contains(name, F.lit("torso")) | F.contains(name, F.lit("number_band")))


def by_crop(readings: DataFrame, *, least_confidence: float = 0.0, most: int = 3, relative: float = 0.35, demote: bool = True, two_digits: bool = True) -> DataFrame:
    """Readings of a crop as one candidate for each number, so that many variants of one picture vote once.

    A candidate has its best weighted confidence (1 at most), how often it was
    read, its sources, channels and the variants of its six best readings. A
    single digit that only the direct channel read counts 0.01 and is marked;
    where a crop has two-digit numbers the others go; so do candidates under
    relative of the best, and those beyond the first most.
    """
    weight = F.greatest(F.lit(0.0), F.coalesce("vote_weight", F.lit(1.0)))
    value = F.greatest(F.lit(0.01), F.coalesce("confidence", F.lit(0.0))) * weight
    ok = readings.where(F.col("number").isNotNull() & (F.coalesce("confidence", F.lit(0.0)) >= least_confidence) & (weight > 0)).withColumn("value_", value)
    key = ["display", "crop", "number"]
    seq = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("value_"), "reading"))
    out = ok.withColumn("seq_", seq).groupBy(*key).agg(
        F.least(F.lit(1.0), F.max("value_")).alias("confidence"), F.count("*").alias("observations"), F.array_sort(F.collect_set(F.coalesce("source", F.lit("ocr")))).alias("sources"), F.array_sort(F.collect_set(F.coalesce("channel", F.lit("unknown")))).alias("channels"),
        F.transform(F.array_sort(F.collect_list(F.when((F.col("seq_") <= 6) & F.col("variant").isNotNull(), F.struct("seq_", "variant")))), lambda v: v["variant"]).alias("variants"), F.min(F.when(F.col("seq_") == 1, F.col("reading"))).alias("best_reading"),
    )
    only = (F.col("number").between(1, 9) & (F.size("channels") == 1) & (F.col("channels")[0] == "direct")) if demote else F.lit(False)
    out = out.withColumn("direct_only", only).withColumn("confidence", F.when(F.col("direct_only"), F.least(F.col("confidence"), F.lit(0.01))).otherwise(F.col("confidence")))
    w = Window.partitionBy("display", "crop")
    if two_digits:
        out = out.withColumn("two_", F.max(F.col("number") >= 10).over(w)).where(~F.col("two_") | (F.col("number") >= 10)).drop("two_")
    ranked = out.withColumns({"top_": F.greatest(F.lit(0.01), F.max("confidence").over(w)), "rank": F.row_number().over(w.orderBy(F.desc("confidence"), F.desc("observations"), "number"))})
    return ranked.where((F.col("confidence") >= relative * F.col("top_")) & (F.col("rank") <= max(1, most))).drop("top_")


def vote(readings: DataFrame, keys: list[str], *, least_confidence: float = 0.0, overrides: dict[int, dict] | None = None, most: int = 8) -> DataFrame:
    """Per key the number with the most weighted confidence, and how sure that is.

    confidence is its share, head its share of the first two, margin its lead
    over the next in shares, ratio that to the next (null alone); candidates
    are the first most. Equal scores go to more votes, then the smaller number.
    overrides: for a winner {prefer, min_alternative_ratio, max_winner_ratio},
    a number it is often misread for, taken if it comes close enough.
    """
    weight = F.greatest(F.lit(0.0), F.coalesce("vote_weight", F.lit(1.0))) if "vote_weight" in readings.columns else F.lit(1.0)
    direct = ~F.coalesce("direct_only", F.lit(False)) if "direct_only" in readings.columns else F.lit(True)
    ok = readings.where(F.col("number").isNotNull() & (F.coalesce("confidence", F.lit(0.0)) >= least_confidence) & direct)
    scores = ok.groupBy(*keys, "number").agg(F.sum(F.greatest(F.lit(0.01), F.coalesce("confidence", F.lit(0.0))) * weight).alias("score"), F.count("*").alias("votes"))
    one = F.struct((-F.col("score")).alias("less"), (-F.col("votes")).alias("fewer"), "number")
    rated = scores.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("r"), F.sum("score").alias("total"), F.sum("votes").alias("readings"))
    first = F.col("r")[0]
    winner = first
    for number, rule in sorted((overrides or {}).items()):
        rival = F.get(F.filter("r", lambda x: x["number"] == rule["prefer"]), F.lit(0))
        close = rival.isNotNull() & (rival["less"] <= first["less"] * float(rule.get("min_alternative_ratio", 0.0)))
        if rule.get("max_winner_ratio") is not None:
            close = close & (-first["less"] / F.greatest(F.lit(0.01), -rival["less"]) <= float(rule["max_winner_ratio"]))
        winner = F.when((first["number"] == number) & close, rival).otherwise(winner)
    rated = rated.withColumn("w", winner)
    rated = rated.withColumn("next", F.coalesce(F.get(F.filter("r", lambda x: x["number"] != F.col("w.number")), F.lit(0))["less"], F.lit(0.0)) * -1).withColumn("score", -F.col("w.less"))
    share = lambda x: F.when(F.col("total") > 0, x / F.col("total")).otherwise(0.0)
    listed = F.transform(F.slice("r", 1, most), lambda x: F.struct(x["number"].alias("jersey_number"), share(-x["less"]).alias("confidence"), (-x["fewer"]).alias("votes"), (-x["less"]).alias("score")))
    head = F.when(F.col("score") + F.col("next") > 0, F.col("score") / (F.col("score") + F.col("next"))).otherwise(1.0)
    ratio = F.when(F.col("next") > 0, F.col("score") / F.col("next"))
    return rated.select(*keys, F.col("w.number").alias("jersey_number"), share(F.col("score")).alias("confidence"), head.alias("head"), share(F.col("score") - F.col("next")).alias("margin"), ratio.alias("ratio"), "score", (-F.col("w.fewer")).alias("votes"), "readings", listed.alias("candidates"))


def decisions(displays: DataFrame, readings: DataFrame, crops: DataFrame, votes: DataFrame, *, min_votes: int = 2, least_confidence: float = 0.0) -> DataFrame:
    """Per display how its number was decided, with counts of why readings didn't count.

    displays: display. crops is what by_crop made of the readings, votes what
    vote made of the crops.
    """
    low = F.coalesce("confidence", F.lit(0.0)) < least_confidence
    none = F.col("number").isNull()
    raw = readings.groupBy("display").agg(
        F.count("*").alias("raw"), F.count_if(none & F.col("error").isNotNull()).alias("backend_error"), F.count_if(none & F.col("error").isNull() & (F.coalesce("text", F.lit("")) == "")).alias("empty_text"),
        F.count_if(none & F.col("error").isNull() & (F.coalesce("text", F.lit("")) != "")).alias("non_numeric_text"), F.count_if(~none & low).alias("below_min_raw_confidence"), F.countDistinct("number").alias("numbers"),
    )
    voting = crops.groupBy("display").agg(F.count("*").alias("voting"), F.count_if("direct_only").alias("direct_only"))
    out = displays.select("display").distinct().join(raw, "display", "left").join(voting, "display", "left").join(votes.select("display", F.col("votes").alias("won")), "display", "left")
    counts = ["raw", "backend_error", "empty_text", "non_numeric_text", "below_min_raw_confidence", "numbers", "voting", "direct_only"]
    out = out.fillna(0, counts)
    status = F.when(F.col("won") >= min_votes, "assigned").when(F.col("won").isNotNull(), "insufficient_votes").when(F.col("raw") == 0, "no_raw_detections").when(F.col("voting") == 0, "no_voting_detections")
    return out.select("display", status.when(F.col("direct_only") == F.col("voting"), "only_direct_single_digit_candidates").otherwise("no_valid_vote").alias("status"), *counts)


def top_counts(df: DataFrame, keys: list[str], value: str, most: int) -> DataFrame:
    """The most frequent values of each key, with their counts; equal counts by value."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))).where(F.col("rank") <= most)


def roster_filter(assignments: DataFrame, roster: DataFrame, *, mode: str = "degrade", unknown_team: str = "keep", scale: float = 0.60, promote: bool = True, min_confidence: float = 0.12, min_votes: int = 1, preserve: bool = False) -> DataFrame:
    """Assigned numbers against the roster of their team; status says what became of each.

    assignments: team and role (majorities of their rows), jersey_number,
    confidence, votes, candidates. A goalkeeper is held to the goalkeepers'
    numbers if the team has any. A number that isn't allowed gives way to the
    first candidate that is and has the confidence and votes
    (promoted_alternative); else it is kept at scale times its confidence
    (degraded), or in mode "drop" dropped, as a goalkeeper's always is; with
    preserve the row stays without number (dropped_preserved_evidence).
    roster_candidates are the candidates of the roster, roster_mass their
    confidence together. Unknown teams are kept or dropped as unknown_team says.
    """
    sets = number_sets(roster)
    out = assignments.join(sets, "team", "left")
    keeper = _is(F.col("role"), KEEPERS) & (F.size("keeper_numbers") > 0)
    allowed = F.coalesce(F.when(keeper, F.col("keeper_numbers")).otherwise(F.col("numbers")), F.array().cast("array<int>"))
    out = out.withColumns({"keeper_": F.coalesce(keeper, F.lit(False)), "allowed_": allowed})
    inside = F.filter(F.coalesce("candidates", F.array().cast(assignments.schema["candidates"].dataType)), lambda c: F.array_contains(F.col("allowed_"), c["jersey_number"]))
    mass = F.aggregate(inside, F.lit(0.0), lambda a, c: a + F.coalesce(c["confidence"], F.lit(0.0)))
    fits = F.array_contains("allowed_", F.col("jersey_number"))
    out = out.withColumns({"inside_": inside, "mass_": mass, "fits_": fits})
    good = F.filter("inside_", lambda c: (F.coalesce(c["confidence"], F.lit(0.0)) >= min_confidence) & (F.coalesce(c["votes"], F.lit(0)) >= min_votes))
    out = out.withColumn("pick_", F.when(~F.col("fits_") & F.lit(promote), F.get(good, F.lit(0))))
    dropped = "dropped_preserved_evidence" if preserve else "dropped"
    status = F.when(F.col("team").isNull(), "kept" if unknown_team == "keep" else "dropped").when(F.col("fits_"), "kept").when(F.col("pick_").isNotNull(), "promoted_alternative").when(F.col("keeper_") | F.lit(mode != "degrade"), dropped).otherwise("degraded")
    reason = F.when(F.col("team").isNull(), None if unknown_team == "keep" else "unknown_team").when(F.col("fits_"), None).when(F.col("keeper_"), "goalkeeper_number_not_in_goalkeeper_roster").otherwise("number_not_in_team_roster")
    out = out.withColumns({"status": status, "reason": reason, "original_number": F.col("jersey_number")})
    gone, promoted = F.col("status") == "dropped_preserved_evidence", F.col("status") == "promoted_alternative"
    attach = F.col("team").isNotNull() & (F.col("mass_") > 0)
    return out.withColumns({
        "jersey_number": F.when(promoted, F.col("pick_.jersey_number")).when(~gone, F.col("jersey_number")),
        "confidence": F.when(promoted, F.col("pick_.confidence")).when(gone, 0.0).when(F.col("status") == "degraded", F.col("confidence") * scale).otherwise(F.col("confidence")),
        "votes": F.when(promoted, F.col("pick_.votes").cast("long")).when(gone, 0).otherwise(F.col("votes").cast("long")),
        "roster_candidates": F.when(attach, F.col("inside_")), "roster_mass": F.when(attach, F.col("mass_")),
    }).drop("keeper_", "allowed_", "inside_", "mass_", "fits_", "pick_", "numbers", "keeper_numbers")


def segment_candidates(assignments: DataFrame, roster: DataFrame) -> DataFrame:
    """Assigned segments with the players that could be meant: those of (team, number), of the number alone where the team is unknown.

    assignments: display, segment, start, end, team, jersey_number, confidence, votes.
    """
    known = roster.where("team is not null and jersey_number is not null").select(F.col("team").alias("t_"), F.col("jersey_number").alias("n_"), "player_id")
    with_team = known.groupBy("t_", "n_").agg(F.array_sort(F.collect_list("player_id")).alias("players"))
    alone = known.groupBy("n_").agg(F.array_sort(F.collect_list("player_id")).alias("any_players"))
    held = assignments.where("jersey_number is not null")
    out = held.join(with_team, (F.col("team") == F.col("t_")) & (F.col("jersey_number") == F.col("n_")), "left").drop("t_", "n_").join(alone, F.col("jersey_number") == F.col("n_"), "left").drop("n_")
    none = F.array().cast("array<string>")
    return out.withColumn("players", F.coalesce(F.when(F.col("team").isNull(), F.col("any_players")).otherwise(F.col("players")), none)).drop("any_players")


def judged_segments(candidates: DataFrame, *, min_confidence: float = 0.20, min_votes: int = 8, max_spread: int = 3, unique: bool = True) -> DataFrame:
    """segment_candidates with spread (displays with that number), rejection (the first rule broken) and accepted (the best of its display and segment)."""
    displays = candidates.groupBy("jersey_number").agg(F.countDistinct("display").alias("spread"))
    out = candidates.join(displays, "jersey_number")
    reason = F.when(F.coalesce("confidence", F.lit(0.0)) < min_confidence, "low_confidence").when(F.coalesce("votes", F.lit(0)) < min_votes, "low_votes").when(F.col("spread") > max_spread, "high_jersey_display_spread")
    out = out.withColumn("rejection", reason.when(F.lit(unique) & (F.size("players") != 1), "not_unique_roster_player"))
    w = Window.partitionBy("display", "segment", F.col("rejection").isNull()).orderBy("spread", F.desc("confidence"), F.desc("votes"), "jersey_number")
    return out.withColumn("accepted", F.col("rejection").isNull() & (F.row_number().over(w) == 1))


def apply_segments(rows: DataFrame, accepted: DataFrame, *, width: int, only_unknown: bool = True) -> DataFrame:
    """rows with the player of the first accepted segment that covers their frame, as segment_player and segment_number; known rows are left alone."""
    from trackweave.operators.joins import first_covering

    named = accepted.where(F.size("players") > 0).select(F.col("display").alias("display_track_id"), F.col("start").alias("start_frame"), F.col("end").alias("end_frame"), F.col("players")[0].alias("segment_player"), F.col("jersey_number").alias("segment_number"))
    out = first_covering(rows, named, "display_track_id", "frame", width=width).drop("start_frame", "end_frame")
    skip = F.lit(only_unknown) & F.col("player_id").isNotNull()
    return out.withColumns({c: F.when(~skip, F.col(c)) for c in ("segment_player", "segment_number")})


def segment_or_direct(rows: DataFrame, segmented: DataFrame, direct: DataFrame, *, width: int) -> DataFrame:
    """rows with the number of the first segment over their frame, else that of their display: read_number and from_segment."""
    from trackweave.operators.joins import first_covering

    s = segmented.select(F.col("display").alias("display_track_id"), F.col("start").alias("start_frame"), F.col("end").alias("end_frame"), F.col("jersey_number").alias("s_"))
    d = direct.select(F.col("display").alias("display_track_id"), F.col("jersey_number").alias("d_"))
    out = first_covering(rows, s, "display_track_id", "frame", width=width).join(d, "display_track_id", "left")
    return out.withColumns({"read_number": F.coalesce("s_", "d_"), "from_segment": F.col("s_").isNotNull()}).drop("start_frame", "end_frame", "s_", "d_")


def ranked_candidates(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Candidates of several fields as one ranked list: keys, jersey_number, confidence, votes, source, rank.

    Of a number that several fields have, the first field's counts; ranks go by confidence, then votes, then the fields' order.
    """
    parts = None
    for i, f in enumerate(fields):
        one = rows.select(*keys, F.lit(i).alias("field"), F.lit(f).alias("source"), F.posexplode(f).alias("pos", "c")).where("c.jersey_number is not null")
        parts = one if parts is None else parts.unionByName(one)
    flat = parts.select(*keys, "field", "source", "pos", F.col("c.jersey_number").alias("jersey_number"), F.coalesce("c.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("c.votes", F.lit(0)).alias("votes"))
    first = F.row_number().over(Window.partitionBy(*keys, "jersey_number").orderBy("field", "pos"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), F.desc("votes"), "field", "pos"))
    return flat.withColumn("nth_", first).where("nth_ = 1").drop("nth_").withColumn("rank", rank).drop("field", "pos")
