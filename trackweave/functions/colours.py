"""Colours: words, hex codes and triples as ranges of hue, saturation and value; pixels inside them; histograms.

Pixels are one flat array of red, green, blue, 0 to 255 each. Hue runs from 0
to 179, saturation and value to 255, all rounded to whole numbers.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of a range: least and most hue, saturation, value.
ANY = {"h_min": 0, "h_max": 179, "s_min": 0, "s_max": 255, "v_min": 0, "v_max": 255}
BOUNDS = tuple(ANY)
# Fixed values of the colour words, for officials and goalkeepers, and for outfield kits.
OFFICIAL_COLOURS = {
    "black": [{"v_max": 70, "s_max": 120}],
    "yellow": [{"h_min": 22, "h_max": 38, "s_min": 70, "v_min": 120}],
    "fluorescent_yellow": [{"h_min": 20, "h_max": 42, "s_min": 55, "v_min": 135}],
    "orange": [{"h_min": 6, "h_max": 24, "s_min": 70, "v_min": 105}],
    "light_blue": [{"h_min": 88, "h_max": 112, "s_min": 35, "v_min": 105}],
    "blue": [{"h_min": 100, "h_max": 128, "s_min": 45, "v_min": 65}],
    "red": [{"h_min": 0, "h_max": 10, "s_min": 70, "v_min": 70}, {"h_min": 170, "h_max": 179, "s_min": 70, "v_min": 70}],
}
KIT_COLOURS = {
    "black": [{"v_max": 72, "s_max": 140}],
    "white": [{"s_max": 55, "v_min": 150}],
    "blue": [{"h_min": 98, "h_max": 132, "s_min": 45, "v_min": 45}],
    "dark_blue": [{"h_min": 98, "h_max": 132, "s_min": 45, "v_min": 28, "v_max": 135}],
    "red": [{"h_min": 0, "h_max": 10, "s_min": 70, "v_min": 70}, {"h_min": 170, "h_max": 179, "s_min": 70, "v_min": 70}],
}
KIT_WORDS = {
    "black_blue": ["black", "blue"], "blackblue": ["black", "blue"], "black_and_blue": ["black", "blue"],
    "nero_blu": ["black", "blue"], "neroblu": ["black", "blue"], "nerazzurro": ["black", "blue"], "nerazzurri": ["black", "blue"],
    "lightblue": ["light_blue"], "light_blue": ["light_blue"],
}


def hsv(rgb: np.ndarray) -> np.ndarray:
    """n x 3 pixels as hue, saturation, value; grey has hue 0; halves are rounded up."""
    r, g, b = (rgb[:, i].astype(np.int64) for i in range(3))
    v = np.maximum(np.maximum(r, g), b)
    d = v - np.minimum(np.minimum(r, g), b)
    d1, v1 = np.maximum(d, 1), np.maximum(v, 1)
    turn = np.where(v == r, 30 * (g - b) + 180 * d, np.where(v == g, 30 * (b - r) + 240 * d, 30 * (r - g) + 300 * d))
    hue = np.where(d == 0, 0, (2 * turn + d) // (2 * d1) % 180)
    return np.stack([hue, np.where(v == 0, 0, (510 * d + v) // (2 * v1)), v], axis=1)


def hex_colour(text: str) -> tuple[int, int, int] | None:
    """#d22030 or d22030 as red, green, blue; None for anything else."""
    digits = re.fullmatch(r"\s*#?([0-9a-f]{6})\s*", str(text).lower())
    return tuple(bytes.fromhex(digits[1])) if digits else None


def colour_ranges(colour, *, tolerance: int = 12, least_saturation: int = 45, least_value: int = 95, words: dict[str, list[dict]] = OFFICIAL_COLOURS) -> list[dict]:
    """A word's ranges, or the hues around a hex code or triple, in two ranges where they pass the end of the circle; none for what isn't a colour."""
    if isinstance(colour, str):
        word = colour.strip().lower()
        if word in words:
            return words[word]
        rgb = hex_colour(word)
    else:
        rgb = tuple(int(x) for x in colour) if isinstance(colour, list | tuple) and len(colour) == 3 else None
    if rgb is None:
        return []
    hue, rest = int(hsv(np.array([rgb]))[0, 0]), {"s_min": least_saturation, "v_min": least_value}
    low, high = hue - tolerance, hue + tolerance
    spans = [(0, high), (180 + low, 179)] if low < 0 else [(low, 179), (0, high - 180)] if high > 179 else [(low, high)]
    return [{"h_min": a, "h_max": b, **rest} for a, b in spans]


def kit_words(colour) -> list[str]:
    """The single colours of a kit: its known names, a hex code, or the parts of a composite like black/blue; lists add up."""
    if isinstance(colour, list | tuple):
        return [w for c in colour for w in kit_words(c)]
    word = re.sub(r"[-/+& ]", "_", str(colour or "").strip().lower())
    if word in KIT_WORDS:
        return KIT_WORDS[word]
    if not word or word in KIT_COLOURS or word.startswith("#") or len(word) == 6:
        return [word] if word else []
    return [p for p in word.split("_") if p not in ("", "and", "e")] or [word]


def kit_ranges(colour) -> dict[str, list[dict]]:
    """Ranges of each single colour of a kit, by its word; words that aren't colours have none. A later colour of the same word takes its place."""
    found = {w: KIT_COLOURS.get(w) or colour_ranges(w) for w in kit_words(colour)}
    return {w: r for w, r in found.items() if r}


def flat_rules(palette: dict[str, list[dict]]) -> list[int]:
    """A palette as seven numbers for each range: which colour of the palette, and its bounds."""
    return [x for i, ranges in enumerate(palette.values()) for r in ranges for x in (i, *({**ANY, **r}[b] for b in BOUNDS))]


def share_inside(pixels: np.ndarray, rules: list[int]) -> np.ndarray:
    """For each colour of flat rules the share of hsv pixels inside any of its ranges; 0 of no pixels."""
    table = np.asarray(rules, dtype=np.int64).reshape(-1, 7)
    out = np.zeros(table[:, 0].max(initial=-1) + 1)
    for i in range(len(out) if len(pixels) else 0):
        inside = np.zeros(len(pixels), bool)
        for _, h0, h1, s0, s1, v0, v1 in table[table[:, 0] == i]:
            h, s, v = pixels.T
            inside |= (h >= h0) & (h <= h1) & (s >= s0) & (s <= s1) & (v >= v0) & (v <= v1)
        out[i] = inside.mean()
    return out


def _pixels(flat) -> np.ndarray:
    """n x 3; no pixels for null, nulls inside, or an array that doesn't come in threes."""
    a = np.zeros(0) if flat is None else np.asarray(flat, dtype=np.float64)
    return a.reshape(-1, 3).astype(np.int64) if len(a) % 3 == 0 and np.isfinite(a).all() else np.zeros((0, 3), np.int64)


@F.pandas_udf(T.DoubleType())
def palette_score(rgb: pd.Series, rules: pd.Series) -> pd.Series:
    """Summed shares of pixels inside the colours of a palette, 1 at most: each stripe of a kit counts."""
    return pd.Series([min(1.0, float(share_inside(hsv(_pixels(p)), [] if r is None else r).sum())) for p, r in zip(rgb, rules)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def colour_shares(rgb: pd.Series, rules: pd.Series) -> pd.Series:
    """The share of pixels inside each colour of a palette, in its order."""
    return pd.Series([share_inside(hsv(_pixels(p)), [] if r is None else r) for p, r in zip(rgb, rules)], dtype=object)


def _histograms(count: Callable[[np.ndarray], np.ndarray]):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def one(rgb: pd.Series) -> pd.Series:
        return pd.Series([count(_pixels(p)) for p in rgb], dtype=object)

    return one


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / max(counts.sum(), 1)


def hsv_histogram(rgb: str | Column, *, hues: int = 32, saturations: int = 32) -> Column:
    """Shares of pixels by hue and saturation, hue by hue; all 0 without pixels."""

    def count(pixels: np.ndarray) -> np.ndarray:
        h, s, _ = hsv(pixels).T
        return _shares(np.bincount(h * hues // 180 * saturations + s * saturations // 256, minlength=hues * saturations))

    return _histograms(count)(rgb)


def rgb_histogram(rgb: str | Column, *, bins: int = 8) -> Column:
    """Shares of pixels by red, green and blue; all 0 without pixels. At least two bins each."""
    n = max(2, bins)

    def count(pixels: np.ndarray) -> np.ndarray:
        r, g, b = (np.clip(pixels, 0, 255) * n // 256).T
        return _shares(np.bincount((r * n + g) * n + b, minlength=n**3))

    return _histograms(count)(rgb)


def look(rgb: str | Column, width: str | Column, height: str | Column) -> Column:
    """What a crop looks like as a vector of length 1: 12 hue, 8 saturation and 8 value counts, its shape and its height over 256; null without pixels."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def one(rgb: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        out = []
        for p, w, h in zip(rgb, width, height):
            pixels = hsv(_pixels(p))
            parts = [np.bincount(pixels[:, i] * n // top, minlength=n) for i, n, top in ((0, 12, 180), (1, 8, 256), (2, 8, 256))]
            v = np.concatenate([*parts, [w / max(1.0, h), h / 256.0]])
            out.append(v / np.sqrt((v * v).sum()) if len(pixels) and np.isfinite(v).all() else None)
        return pd.Series(out, dtype=object)

    return one(rgb, width, height)
