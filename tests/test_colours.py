"""Colours, palettes and histograms against plain Python."""

import colorsys

import numpy as np

from trackweave.functions import colours as C
from trackweave.operators import palettes as P


def test_hue_saturation_value():
    rgb = np.random.default_rng(3).integers(0, 256, (3000, 3))
    for got, (r, g, b) in zip(C.hsv(rgb).tolist(), rgb.tolist()):
        h, s, v = colorsys.rgb_to_hsv(r, g, b)
        assert abs((got[0] - h * 180 + 90) % 180 - 90) <= 0.5 + 1e-9 and abs(got[1] - s * 255) <= 0.5 + 1e-9 and got[2] == v
    assert C.hsv(np.array([[0, 0, 0], [9, 9, 9], [255, 0, 0], [0, 255, 0], [0, 0, 255]])).tolist() == [[0, 0, 0], [0, 0, 9], [0, 255, 255], [60, 255, 255], [120, 255, 255]]


def test_ranges_wrap_around():
    hues = lambda c, **more: [(r["h_min"], r["h_max"]) for r in C.colour_ranges(c, **more)]
    assert hues("#ff0000") == hues((255, 0, 0)) == [(0, 12), (168, 179)]
    assert hues("00FF00") == [(48, 72)] and hues("#00ff00", tolerance=3) == [(57, 63)]
    assert C.hsv(np.array([[255, 0, 17]]))[0, 0] == 178 and hues("ff0011") == [(166, 179), (0, 10)]
    assert hues(" Yellow ") == [(22, 38)]
    assert [C.colour_ranges(x) for x in (None, "", "#12", "ggg000", "purple", (1, 2))] == [[]] * 6


def test_kit_words():
    assert C.kit_words("Black/Blue") == C.kit_words("nerazzurri") == C.kit_words(["black", "blue"]) == ["black", "blue"]
    assert C.kit_words("red and white") == ["red", "white"] and C.kit_words("light blue") == ["light_blue"]
    assert C.kit_words("#00FF00") == ["#00ff00"] and C.kit_words("dark-blue") == ["dark_blue"] and C.kit_words(None) == C.kit_words(" ") == []
    assert set(C.kit_ranges("red_purple")) == {"red"} and C.kit_ranges("black") != C.kit_ranges("#000000")


def test_shares_of_odd_pixels(spark):
    rules = C.flat_rules({"red": C.colour_ranges("#ff0000"), "blue": C.colour_ranges("blue")})
    rows = [(1, [255, 0, 0, 0, 0, 255, 0, 0, 0, 255, 0, 17]), (2, []), (3, None), (4, [1, 2]), (5, [None, 0, 0])]
    df = spark.createDataFrame([(i, p, rules) for i, p in rows], "id int, rgb array<int>, rules array<int>")
    got = {r["id"]: (list(r["s"]), r["p"]) for r in df.select("id", C.colour_shares("rgb", "rules").alias("s"), C.palette_score("rgb", "rules").alias("p")).collect()}
    assert got == {1: ([0.5, 0.25], 0.75), **{i: ([0.0, 0.0], 0.0) for i in (2, 3, 4, 5)}}
    got = df.select("id", C.hsv_histogram("rgb", hues=4, saturations=2).alias("h"), C.rgb_histogram("rgb", bins=1).alias("r"), C.look("rgb", "id", "id").alias("l")).orderBy("id").collect()
    assert got[0]["h"] == [0.25, 0.25, 0, 0, 0, 0.25, 0, 0.25] and got[0]["r"] == [0.25, 0.25, 0, 0, 0.5, 0, 0, 0]
    assert all(sum(r["h"]) == sum(r["r"]) == 0 and r["l"] is None for r in got[1:]) and abs(sum(x * x for x in got[0]["l"]) - 1) < 1e-9


def test_palettes_of_a_roster(spark):
    roster = [("m", 1, "player", "Black/Blue"), ("m", 1, None, "red"), ("m", 1, "goalkeeper", "orange"), ("m", 2, "player", "plaid"), ("m", None, "Referee", "Fluorescent Yellow"), ("m", 2, "official", None), ("n", 1, "player", "red"), ("n", None, "player", "red")]
    df = spark.createDataFrame(roster, "video string, team int, role string, colour string")
    made = lambda d: {(r["video"], r["choice"]): r["rules"] for r in d.collect()}
    three = C.flat_rules({**C.kit_ranges("Black/Blue"), **C.kit_ranges("red")})
    assert made(P.kit_palettes(df, ["video"])) == {("m", 1): three, ("n", 1): C.flat_rules(C.kit_ranges("red"))}
    assert made(P.official_palettes(df, ["video"])) == {("m", "fluorescent_yellow"): C.flat_rules({"x": C.OFFICIAL_COLOURS["fluorescent_yellow"]})}
    assert made(P.official_palettes(df, ["video"], keepers=True)) == {("m", 1): C.flat_rules({"x": C.OFFICIAL_COLOURS["orange"]})}
