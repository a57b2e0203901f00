"""Palettes of teams and officials from rosters, and how much of a crop has their colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.functions.colours import colour_ranges, flat_rules, kit_ranges, palette_score
from trackweave.operators.constraints import KEEPERS, _is

#: Roles whose clothes are no team's kit, and those of officials (fixed values).
NO_KIT = (*KEEPERS, "referee", "official", "match_official")
OFFICIALS = ("referee", "official", "match_official", "referee_candidate")


def kit_palettes(roster: DataFrame, keys: list[str]) -> DataFrame:
    """keys, choice, rules: the kit of each team of a roster, from the colours of its outfield players; nothing for teams without a known colour.

    roster: keys, team, role, colour (words, hex codes or composites). Players
    of one team may name several colours; each counts once.
    """
    players = roster.where(F.col("team").isNotNull() & F.col("colour").isNotNull() & ~_is(F.col("role"), NO_KIT))
    return _palettes(players.withColumnRenamed("team", "choice"), keys, lambda words: {w: r for c in words for w, r in kit_ranges(c).items()})


def official_palettes(roster: DataFrame, keys: list[str], *, keepers: bool = False) -> DataFrame:
    """keys, choice, rules: each colour that officials wear by the roster, or that a team's goalkeepers do."""
    of = KEEPERS if keepers else OFFICIALS
    worn = roster.where(_is(F.col("role"), of) & F.col("colour").isNotNull() & (F.col("team").isNotNull() if keepers else F.lit(True)))
    word = F.regexp_replace(F.lower(F.trim("colour")), " ", "_")
    return _palettes(worn.select(*keys, word.alias("colour"), (F.col("team") if keepers else word).alias("choice")), keys, lambda words: {w: colour_ranges(w) for w in words if colour_ranges(w)})


def _palettes(worn: DataFrame, keys: list[str], ranges) -> DataFrame:
    rules = F.udf(lambda words: flat_rules(ranges(words)), "array<int>")  # a row for each team of a recording
    out = worn.groupBy(*keys, "choice").agg(F.array_sort(F.collect_set("colour")).alias("words"))
    return out.select(*keys, "choice", rules("words").alias("rules")).where(F.size("rules") > 0)


def palette_scores(crops: DataFrame, palettes: DataFrame, keys: list[str], rgb: str) -> DataFrame:
    """crops without their pixels, with choice and score for each palette of their keys: the input of palette_choice."""
    scored = crops.join(palettes, keys).withColumn("score", palette_score(rgb, "rules"))
    return scored.drop(rgb, "rules")
