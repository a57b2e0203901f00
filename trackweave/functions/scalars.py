"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.when(F.coalesce(b, F.lit(0)) == 0, 0.0).otherwise(a / b)


def parse_number(text: Column) -> Column:
    """The first two digits of the first digit run as a shirt number 1 to 99, else null."""
    n = F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d+)", 1).substr(1, 2).try_cast("int")
    return F.when(n.between(1, 99), n)


def known(text: Column) -> Column:
    """Null for the sentinels of an unknown value."""
    return F.when(~F.trim(text).isin("", "None", "unknown"), text)


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_")


def center(box: Column) -> Column:
    return F.struct(((box["x1"] + box["x2"]) / 2).alias("x"), ((box["y1"] + box["y2"]) / 2).alias("y"))


def foot(box: Column) -> Column:
    """Where a person stands: the middle of the lower edge."""
    return F.struct(((box["x1"] + box["x2"]) / 2).alias("x"), box["y2"].alias("y"))


def area(box: Column) -> Column:
    return F.greatest(box["x2"] - box["x1"], F.lit(0.0)) * F.greatest(box["y2"] - box["y1"], F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes as a share of their union, 0 for an empty union."""
    wide = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    high = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    return safe_ratio(wide * high, area(a) + area(b) - wide * high)


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def project(h: Column, x: Column, y: Column) -> Column:
    """A point through a 3x3 homography given as an array of 9, row by row; null where the point goes to infinity."""
    row = lambda i: h[3 * i] * x + h[3 * i + 1] * y + h[3 * i + 2]
    w = F.nullif(row(2), F.lit(0.0))
    return F.struct((row(0) / w).alias("x"), (row(1) / w).alias("y"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Null for different lengths or a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def visual_distance(a: Column, b: Column) -> Column:
    return clamp((1 - cosine(a, b)) / 2)


def chi_square(a: Column, b: Column) -> Column:
    """Half the sum of (a-b)^2 / (a+b), with a small term against empty bins (fixed value 1e-8)."""
    part = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)) / (x.cast("double") + y.cast("double") + 1e-8))
    return 0.5 * F.aggregate(part, F.lit(0.0), lambda s, v: s + v)


def role_group(role: Column, team: Column) -> Column:
    """Semantic groups: players of team 1 and 2, goalkeepers of team 1 and 2, referees; a goalkeeper of no known team counts as 3."""
    role = F.lower(role)
    return (
        F.when(role.isin("referee", "referee_candidate"), 5)
        .when(role == "goalkeeper", F.when(team == 2, 4).otherwise(3))
        .when(team == 1, 1)
        .when(team == 2, 2)
    )


def or_default(x: Column, default: float) -> Column:
    """Zero counts as missing, like null."""
    return F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(default))
