"""Identity constraints as a chain of passes over observations; each sees what the ones before cleared.

Rows have video, frame, raw_track_id, display_track_id, role, team,
team_confidence, frame_team, frame_team_confidence, semantic_group,
palette_match, jersey_number, jersey_confidence, jersey_votes, head, margin,
candidates (array of jersey_number, confidence, votes), player_id,
identity_confidence, crop_quality and area; opened() adds what the passes
record: conflict, jersey_reason, identity_reason and previous_display_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.operators.windows import conflict_islands

ROW = ["video", "frame", "raw_track_id"]
#: Words for roles (fixed values of the rules).
KEEPERS, REFEREES = ("goalkeeper", "keeper", "gk"), ("referee", "referee_candidate")


def _is(role: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(role).isin(*words), F.lit(False))


def goalkeeper_evidence() -> Column:
    """A goalkeeper by role or by the colour of the kit."""
    return _is(F.col("role"), KEEPERS) | F.coalesce(F.col("palette_match"), F.lit(False))


def opened(rows: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.withColumns({"conflict": F.lit(False), "jersey_reason": none, "identity_reason": none, "previous_display_id": F.lit(None).cast("long")})


def cleared(rows: DataFrame, when: Column, reason: str, *, identity_reason: str | None = None, evidence: bool = True) -> DataFrame:
    """Number and identity taken from the rows where the condition holds, each with the reason if there was one to take.

    Without evidence, head share, margin and candidates stay as they were.
    """
    when = F.coalesce(when, F.lit(False))
    number, player = when & F.col("jersey_number").isNotNull(), when & F.col("player_id").isNotNull()
    less = {c: F.when(~number, F.col(c)).otherwise(F.lit(zero)) for c, zero in (("jersey_number", None), ("jersey_confidence", 0.0), ("jersey_votes", 0))}
    if evidence:
        less |= {c: F.when(~number, F.col(c)) for c in ("head", "margin", "candidates")}
    less |= {"player_id": F.when(~player, F.col("player_id")), "identity_confidence": F.when(~player, F.col("identity_confidence")).otherwise(0.0)}
    less |= {"jersey_reason": F.when(number, reason).otherwise(F.col("jersey_reason")), "identity_reason": F.when(player, identity_reason or reason).otherwise(F.col("identity_reason"))}
    return rows.withColumns(less)


def number_sets(roster: DataFrame) -> DataFrame:
    """team, numbers, keeper_numbers: at most 99 numbers each. roster: player_id, team, jersey_number, role."""
    known = roster.where("team is not null and jersey_number is not null").groupBy("team")
    return known.agg(F.collect_set("jersey_number").alias("numbers"), F.collect_set(F.when(_is(F.col("role"), KEEPERS), F.col("jersey_number"))).alias("keeper_numbers"))


def with_number_sets(rows: DataFrame, roster: DataFrame) -> DataFrame:
    return rows.drop("numbers", "keeper_numbers").join(number_sets(roster), "team", "left")


def frame_team_consistency(rows: DataFrame, *, min_confidence: float = 0.6) -> DataFrame:
    """A sure colour that speaks against the track's team moves the row to that team and clears what was read on it."""
    spared = _is(F.col("role"), (*REFEREES, "goalkeeper")) | F.coalesce(F.col("semantic_group").isin(3, 4, 5), F.lit(False))
    marked = rows.withColumn("clash_", F.coalesce(~spared & (F.col("team") != F.col("frame_team")) & (F.col("frame_team_confidence") >= min_confidence), F.lit(False)))
    out = cleared(marked, F.col("clash_"), "frame_team_conflict")
    moved = {"conflict": F.col("conflict") | F.col("clash_"), "team": F.when(F.col("clash_"), F.col("frame_team")).otherwise(F.col("team"))}
    sure = F.when(F.col("clash_"), F.greatest("team_confidence", "frame_team_confidence")).otherwise(F.col("team_confidence"))
    return out.withColumns(moved | {"team_confidence": sure}).drop("clash_")


def clear_invalid_numbers(rows: DataFrame) -> DataFrame:
    """Numbers that the team's roster lacks go; teams without a roster are left alone. Rows as from with_number_sets."""
    wrong = F.col("jersey_number").isNotNull() & (F.size("numbers") > 0) & ~F.array_contains("numbers", F.col("jersey_number"))
    return cleared(rows, wrong, "number_not_in_team_roster", identity_reason="assigned_jersey_not_in_track_team_roster", evidence=False)


def known_owners(rows: DataFrame) -> DataFrame:
    """video, team, number, first and last display that has both the number and a player: one that is neither's own is another's."""
    held = rows.where("player_id is not null and team is not null and jersey_number is not null")
    return held.groupBy("video", "team", F.col("jersey_number").alias("number")).agg(F.min("display_track_id").alias("low"), F.max("display_track_id").alias("high"))


def clear_keeper_only_numbers(rows: DataFrame, owners: DataFrame | None = None, *, min_confidence: float = 0.10, min_votes: int = 1, max_rank: int = 5, block_known_owner: bool = True, stop_on_conflict: bool = True) -> DataFrame:
    """A goalkeeper's number on a player goes. With owners (those before all passes) the next number read may take its place.

    That is the first by rank (confidence, votes) of the team's numbers that no
    goalkeeper has, with enough confidence and votes. One that another display
    with a known player holds blocks: it ends the search, or is passed over.
    alternate_rejection says why there is none. Only the rows concerned are
    exploded by their candidates.
    """
    hit = F.coalesce(F.array_contains("keeper_numbers", F.col("jersey_number")), F.lit(False)) & ~goalkeeper_evidence()
    if owners is None:
        return cleared(rows, hit, "goalkeeper_only_jersey_on_non_goalkeeper")
    marked = rows.withColumn("hit_", hit)
    offers = marked.where("hit_").select(*ROW, "display_track_id", "team", F.col("jersey_number").alias("had"), "numbers", "keeper_numbers", F.posexplode("candidates").alias("pos", "c"))
    offers = offers.where("c.jersey_number is not null").withColumn("number", F.col("c.jersey_number"))
    once = Window.partitionBy(*ROW, "number").orderBy("pos")
    offers = offers.withColumn("nth", F.row_number().over(once)).where("nth = 1")
    by_rank = Window.partitionBy(*ROW).orderBy(F.desc("c.confidence"), F.desc("c.votes"), "pos")
    offers = offers.withColumn("rank", F.row_number().over(by_rank))
    fits = (F.col("rank") <= max_rank) & (F.col("number") != F.col("had")) & F.array_contains("numbers", F.col("number")) & ~F.array_contains("keeper_numbers", F.col("number"))
    offers = offers.where(fits & (F.col("c.confidence") >= min_confidence) & (F.col("c.votes") >= min_votes)).join(owners, ["video", "team", "number"], "left")
    taken = F.coalesce((F.col("low") != F.col("display_track_id")) | (F.col("high") != F.col("display_track_id")), F.lit(False)) & F.lit(block_known_owner)
    one = F.struct("rank", "number", F.col("c.confidence").alias("confidence"), F.col("c.votes").alias("votes"), "taken")
    found = offers.withColumn("taken", taken).groupBy(*ROW).agg(F.min(one).alias("first_"), F.min(F.when(~F.col("taken"), one)).alias("free_"))
    pick = F.when(F.col("first_.taken"), F.lit(None) if stop_on_conflict else F.col("free_")).otherwise(F.col("first_"))
    out = cleared(marked, F.col("hit_"), "goalkeeper_only_jersey_on_non_goalkeeper").join(found.select(*ROW, pick.alias("alt_"), F.col("first_.taken").alias("blocked_")), ROW, "left")
    use = F.col("alt_").isNotNull()
    new = {"jersey_number": F.when(use, F.col("alt_.number")).otherwise(F.col("jersey_number")), "jersey_confidence": F.when(use, F.col("alt_.confidence")).otherwise(F.col("jersey_confidence")), "jersey_votes": F.when(use, F.col("alt_.votes")).otherwise(F.col("jersey_votes"))}
    return out.withColumns(new | {"alternate_rejection": F.when(~use & F.col("blocked_"), "alternate_known_owner_conflict")}).drop("hit_", "alt_", "blocked_")


def clear_keeper_invalid_numbers(rows: DataFrame) -> DataFrame:
    """On a goalkeeper only goalkeepers' numbers stay, if the team's are known."""
    wrong = goalkeeper_evidence() & F.col("jersey_number").isNotNull() & (F.size("keeper_numbers") > 0) & ~F.array_contains("keeper_numbers", F.col("jersey_number"))
    return cleared(rows, wrong, "non_goalkeeper_jersey_on_goalkeeper")


def _rest(rows: DataFrame, keys: list[str], rank: list[Column]) -> DataFrame:
    """rows with rest_: not the first of those that share all keys. Rows that lack a key lie spread over all tasks."""
    lacks = F.greatest(F.lit(0), *[F.col(k).isNull().cast("int") for k in keys]) == 1
    spread = F.when(lacks, F.col("raw_track_id"))
    w = Window.partitionBy("video", "frame", *keys, spread).orderBy(*[r.desc() for r in rank], F.asc("raw_track_id"))
    return rows.withColumn("rest_", ~lacks & (F.row_number().over(w) > 1))


def clear_duplicate_players(rows: DataFrame) -> DataFrame:
    """In a frame a player stays with the row of the best identity, crop and size."""
    found = _rest(rows, ["player_id"], [F.coalesce("identity_confidence", F.lit(0.0)), F.coalesce("crop_quality", F.lit(0.0)), F.coalesce("area", F.lit(0.0))])
    player = found.withColumns({"player_id": F.when(~F.col("rest_"), F.col("player_id")), "identity_confidence": F.when(~F.col("rest_"), F.col("identity_confidence")).otherwise(0.0)})
    return player.withColumn("identity_reason", F.when(F.col("rest_"), "duplicate_player_id_same_frame").otherwise(F.col("identity_reason"))).drop("rest_")


def correct_groups(rows: DataFrame, roster: DataFrame) -> DataFrame:
    """The semantic group that follows from the player's roster entry, else from the track; group_reason says from what it was corrected.

    A goalkeeper of no known team changes nothing.
    """
    entry = roster.select(F.col("player_id").alias("id_"), F.col("team").alias("t_"), F.lower("role").alias("r_")).dropDuplicates(["id_"])
    out = rows.join(entry, F.col("player_id") == F.col("id_"), "left")
    listed = F.col("id_").isNotNull()
    role = F.coalesce(F.when(F.col("r_") != "", F.col("r_")), F.lower("role"), F.lit(""))
    team = F.when(listed, F.col("t_")).otherwise(F.col("team"))
    of_team = lambda a, b: F.when(team == 1, a).when(team == 2, b)
    goal = F.when(role.isin(*REFEREES), 5).when(role.isin(*KEEPERS), of_team(3, 4)).when(_is(F.col("role"), REFEREES), 5).otherwise(of_team(1, 2))
    change = goal.isNotNull() & ~F.col("semantic_group").eqNullSafe(goal)
    why = F.when(F.col("r_").isin(*KEEPERS), "roster_goalkeeper_role").when(goal == 5, "referee_role").when(listed & F.col("t_").isNotNull(), "roster_team_role").otherwise("track_team_role")
    return out.withColumns({"semantic_group": F.coalesce(goal, F.col("semantic_group")), "group_reason": F.when(change, why)}).drop("id_", "t_", "r_")


def number_rank() -> list[Column]:
    """What decides between rows with one number: referees last, goalkeepers first, then the evidence of the number."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("double"))
    referee = F.coalesce(F.col("role").isin(*REFEREES), F.lit(False)) | F.coalesce(F.col("semantic_group") == 5, F.lit(False))
    keeper = F.coalesce(F.col("semantic_group").isin(3, 4), F.lit(False)) | F.coalesce(F.col("role") == "goalkeeper", F.lit(False))
    return [-referee.cast("int"), keeper.cast("int"), *(zero(c) for c in ("jersey_confidence", "head", "margin", "jersey_votes", "identity_confidence", "crop_quality", "area"))]


def clear_duplicate_numbers(rows: DataFrame) -> DataFrame:
    """In a frame a (team, number) stays with its best row."""
    found = _rest(rows, ["team", "jersey_number"], number_rank())
    return cleared(found, F.col("rest_"), "duplicate_team_jersey_same_frame").drop("rest_")


def split_conflicts(rows: DataFrame, *, min_frames: int = 4, max_gap: int = 2) -> DataFrame:
    """Long runs of conflict become displays of their own, numbered after the video's last; the rows that bridge them are cleared."""
    runs = conflict_islands(rows.withColumn("hit_", F.when(F.col("conflict"), F.coalesce("frame_team", F.lit(-1)))), ["video", "display_track_id"], ["frame", "raw_track_id"], "hit_", max_gap=max_gap, min_rows=min_frames)
    last = rows.groupBy("video").agg(F.max("display_track_id").alias("last_"))
    numbered = runs.withColumn("nth_", F.row_number().over(Window.partitionBy("video").orderBy("display_track_id", "first_row"))).join(last, "video")
    ranges = numbered.select(F.col("video").alias("v_"), F.col("display_track_id").alias("d_"), "first_row", "last_row", (F.col("last_") + F.col("nth_")).alias("new_"))
    placed = rows.withColumn("row_", F.row_number().over(Window.partitionBy("video", "display_track_id").orderBy("frame", "raw_track_id")))
    out = placed.join(ranges, (F.col("video") == F.col("v_")) & (F.col("display_track_id") == F.col("d_")) & F.col("row_").between(F.col("first_row"), F.col("last_row")), "left")
    out = cleared(out, F.col("new_").isNotNull() & ~F.col("conflict"), "persistent_frame_team_conflict_bridge")
    moved = {"previous_display_id": F.when(F.col("new_").isNotNull(), F.col("display_track_id")), "display_track_id": F.coalesce("new_", "display_track_id")}
    return out.withColumns(moved).drop("v_", "d_", "first_row", "last_row", "new_", "row_")


def global_owners(rows: DataFrame) -> DataFrame:
    """Over the whole video a (team, number) of several displays belongs to one owner; the others' rows are cleared.

    Displays of one known player are one owner, others each one; known players
    come first, then the best row, the means of the evidence, and how long.
    Sums of displays are merged into those of owners, so rows are grouped once.
    """
    key = ["video", "team", "jersey_number"]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    means = ["jersey_confidence", "head", "margin", "jersey_votes", "identity_confidence", "team_confidence"]
    held = rows.where("team is not null and jersey_number is not null").groupBy(*key, "display_track_id").agg(
        F.max(F.struct(*[r.alias(f"r{i}") for i, r in enumerate(number_rank())])).alias("best"), *[F.sum(zero(c)).alias(c) for c in means],
        F.max(zero("jersey_votes")).alias("votes"), F.count("player_id").alias("known"), F.count("*").alias("n"),
        F.min_by("player_id", F.when(F.col("player_id").isNotNull(), F.struct("frame", "raw_track_id"))).alias("player"),
    )
    held = held.withColumn("owner", F.coalesce(F.concat(F.lit("p:"), "player"), F.concat(F.lit("d:"), F.col("display_track_id").cast("string"))))
    merged = held.groupBy(*key, "owner").agg(F.max("best").alias("best"), *[(F.sum(c) / F.sum("n")).alias(c) for c in means], F.max("votes").alias("votes"), F.sum("known").alias("known"), F.sum("n").alias("n"), F.count("*").alias("displays"), F.min("display_track_id").alias("low"))
    rank = F.struct((F.col("owner") > "p").alias("is_known"), "best", "jersey_confidence", "head", "margin", "votes", "jersey_votes", "known", "identity_confidence", "team_confidence", "n", (-F.col("low")).alias("low"))
    kept = merged.groupBy(*key).agg(F.max_by("owner", rank).alias("kept"), F.sum("displays").alias("displays")).where("displays > 1")
    losers = held.join(kept, key).where("owner <> kept").select(*key, "display_track_id", F.lit(True).alias("lost_"))
    return cleared(rows.join(losers, [*key, "display_track_id"], "left"), F.col("lost_"), "global_duplicate_team_jersey_owner").drop("lost_")


def enforce(rows: DataFrame, roster: DataFrame, *, min_team_confidence: float = 0.6, alternates: bool = True, min_frames: int = 4, max_gap: int = 2) -> DataFrame:
    """All nine passes in order. Owners of numbers are those before the first pass."""
    owners = known_owners(rows) if alternates else None
    out = frame_team_consistency(opened(rows), min_confidence=min_team_confidence)
    out = clear_invalid_numbers(with_number_sets(out, roster))
    out = clear_keeper_invalid_numbers(clear_keeper_only_numbers(out, owners))
    out = clear_duplicate_numbers(correct_groups(clear_duplicate_players(out), roster))
    return global_owners(split_conflicts(out, min_frames=min_frames, max_gap=max_gap))


def reason_counts(rows: DataFrame) -> DataFrame:
    """How many rows each reason cleared, by what it cleared."""
    return rows.select(F.explode(F.array(F.struct(F.lit("jersey").alias("what"), F.col("jersey_reason").alias("reason")), F.struct(F.lit("identity").alias("what"), F.col("identity_reason").alias("reason")))).alias("r")).where("r.reason is not null").groupBy("r.what", "r.reason").agg(F.count("*").alias("n"))
