"""Fields as other tools write them: boxes, homographies, roles, numbers, keys and labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackweave.functions.scalars import parse_number

#: Words for roles in annotations, and the keys that may hold a shirt number in order of trust (fixed values of the data).
ROLE_WORDS = {"field_player": "player", "outfield_player": "player", "players": "player", "keeper": "goalkeeper", "goal_keeper": "goalkeeper", "gk": "goalkeeper", "ref": "referee", "official": "referee", "match_official": "referee"}
NUMBER_KEYS = ("jersey_number", "jersey", "shirt_number", "shirt", "number", "bib_number")
SPLITS = ("train", "valid", "val", "test", "challenge")
CLASSES = ("player", "goalkeeper", "referee", "ball")
GROUP_LABELS = {1: "T1", 2: "T2", 3: "GK1", 4: "GK2", 5: "REF"}


def corner_box(box: Column) -> Column:
    """A map of x, y, w, h or x1, y1, x2, y2 as x, y, w, h; null without either."""
    v = lambda k: F.try_element_at(box, F.lit(k))
    have = lambda *ks: sum((v(k).isNotNull().cast("int") for k in ks), F.lit(0)) == len(ks)
    made = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    return F.when(have("x", "y", "w", "h"), made(v("x"), v("y"), v("w"), v("h"))).when(have("x1", "y1", "x2", "y2"), made(v("x1"), v("y1"), v("x2") - v("x1"), v("y2") - v("y1")))


def box_area(box: Column) -> Column:
    return F.coalesce(F.greatest(box["w"], F.lit(0.0)) * F.greatest(box["h"], F.lit(0.0)), F.lit(0.0))


def crop_window(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int, margin: float = 0.03) -> Column:
    """Whole pixels of a box widened by margin on each side and cut to the frame, rounded half to even; null if nothing is left."""
    px, py = F.greatest(F.lit(1.0), x2 - x1) * margin, F.greatest(F.lit(1.0), y2 - y1) * margin
    left, top = F.greatest(F.lit(0), F.bround(x1 - px).cast("int")), F.greatest(F.lit(0), F.bround(y1 - py).cast("int"))
    right, bottom = F.least(F.lit(width), F.bround(x2 + px).cast("int")), F.least(F.lit(height), F.bround(y2 + py).cast("int"))
    return F.when((right > left) & (bottom > top), F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")))


def clipped_box(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int) -> Column:
    """Corners as whole numbers (cut toward zero) inside the frame; the first corner stays a pixel short of the far edge."""
    hold = lambda c, most: F.greatest(F.lit(0), F.least(F.lit(most), c.cast("int")))
    return F.struct(hold(x1, width - 1).alias("x1"), hold(y1, height - 1).alias("y1"), hold(x2, width).alias("x2"), hold(y2, height).alias("y2"))


def relative_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, least_area: float = 0.0) -> Column:
    """Centre and size as shares of the frame, each held to 0..1; null for a box or frame without area, or one under least_area."""
    part = lambda c, of: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c / of))
    ok = (width > 0) & (height > 0) & (w > 0) & (h > 0) & (w * h >= least_area)
    return F.when(ok, F.struct(part(x + w / 2, width).alias("cx"), part(y + h / 2, height).alias("cy"), part(w, width).alias("w"), part(h, height).alias("h")))


def class_id(role: Column, mode: str, include_other: bool = False) -> Column:
    """The class of a role among person and ball, person alone, or the four classes; null outside them."""
    role = F.lower(role)
    person = role.isin("player", "goalkeeper", "referee", *(["other"] if include_other else []))
    if mode == "person_ball":
        return F.when(person, 0).when(role == "ball", 1)
    if mode == "person_only":
        return F.when(person, 0)
    if mode == "four_class":
        return F.when(role.isin(*CLASSES), F.array_position(F.array(*[F.lit(c) for c in CLASSES]), role).cast("int") - 1)
    raise ValueError(mode)


def label_line(cls: Column, box: Column) -> Column:
    """A detector's label line: class, centre and size with 6 digits."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", cls, box["cx"], box["cy"], box["w"], box["h"])


def normal_role(role: Column) -> Column:
    """A role word in lower case with underscores, under its common name; null stays."""
    plain = F.regexp_replace(F.lower(F.trim(role)), "[- ]", "_")
    words = F.create_map(*[F.lit(x) for kv in ROLE_WORDS.items() for x in kv])
    return F.coalesce(F.try_element_at(words, plain), plain)


def attribute_number(attributes: Column) -> Column:
    """A shirt number from a map of attributes: from the known keys in order, else from the first key by name that speaks of a jersey, shirt or bib."""
    direct = [parse_number(F.try_element_at(attributes, F.lit(k))) for k in NUMBER_KEYS]
    others = F.array_sort(F.map_entries(attributes))
    named = F.filter(others, lambda e: F.rlike(F.lower(e["key"]), F.lit("jersey|shirt|bib")))
    numbers = F.filter(F.transform(named, lambda e: parse_number(e["value"])), lambda n: n.isNotNull())
    return F.coalesce(*direct, F.get(numbers, F.lit(0)))


def path_split(path: Column) -> Column:
    """The split that a part of the path names, the first of SPLITS; valid counts as val; unknown without one."""
    parts = F.split(F.lower(path), "/")
    found = F.coalesce(*[F.when(F.array_contains(parts, s), "val" if s == "valid" else s) for s in SPLITS])
    return F.coalesce(found, F.lit("unknown"))


def training_split(path: Column) -> Column:
    """The split for detector training: test serves as val and challenge as test; train without a word."""
    p = F.lower(path)
    has = lambda s: F.contains(p, F.lit(f"/{s}/"))
    return F.when(has("train"), "train").when(has("valid") | has("val") | has("test"), "val").when(has("challenge"), "test").otherwise("train")


def reading(raw: Column) -> Column:
    """text, confidence and channel of a reader's result given as JSON: an object, a list of one to three, or a bare value."""
    item = F.trim(raw)
    from_object = F.from_json(raw, "text string, confidence double, ocr_channel string")
    from_list = F.from_json(raw, "array<string>")
    objects = F.struct(from_object["text"].alias("text"), F.coalesce(from_object["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce(from_object["ocr_channel"], F.lit("unknown")).alias("channel"))
    at = lambda i: F.get(from_list, F.lit(i))
    lists = F.struct(at(0).alias("text"), F.coalesce(at(1).try_cast("double"), F.lit(0.0)).alias("confidence"), F.coalesce(at(2), F.lit("unknown")).alias("channel"))
    bare = F.struct(raw.alias("text"), F.lit(0.0).alias("confidence"), F.lit("unknown").alias("channel"))
    return F.when(item.startswith("{"), objects).when(item.startswith("["), lists).otherwise(bare)


def candidate_list(cell: Column) -> Column:
    """Candidates from a cell of JSON, a list of objects or one object; an empty array where it doesn't parse."""
    kind = "struct<jersey_number:int,confidence:double,votes:int>"
    many, one = F.from_json(cell, f"array<{kind}>"), F.from_json(cell, "jersey_number int, confidence double, votes int")
    none = F.array().cast(f"array<{kind}>")
    ok = F.filter(F.when(F.trim(cell).startswith("["), many).when(F.trim(cell).startswith("{"), F.array(one)), lambda c: c.isNotNull())
    return F.coalesce(ok, none)


def evidence(cell: Column, key: str, flat: Column) -> Column:
    """A value of evidence given as JSON, else the flat column, else 0."""
    return F.coalesce(F.get_json_object(cell, f"$.{key}").try_cast("double"), flat.cast("double"), F.lit(0.0))


def whole_number(text: Column) -> Column:
    """A number as the graph reads it: "3.0" is 3."""
    return text.try_cast("double").cast("int")


def strict_number(text: Column) -> Column:
    """A number as run merging reads it: "3.0" is none."""
    return F.when(F.trim(text).rlike(r"^[+-]?\d+$"), text.try_cast("int"))


def group_key(display: Column, segment: Column) -> Column:
    return F.concat_ws(":", display.cast("string"), segment.cast("string"))


def key_display(key: Column) -> Column:
    return F.substring_index(key, ":", 1).try_cast("long")


def key_segment(key: Column) -> Column:
    return F.when(F.contains(key, F.lit(":")), F.substring_index(key, ":", -1).try_cast("long"))


def tracklet_id(display: Column, segment: Column) -> Column:
    return F.when(segment.isNull(), display).otherwise(display * 100000 + segment)


def pitch_homography(h: Column, *, centred: bool = True, invert: bool = False, length: float = 105.0, width: float = 68.0) -> Column:
    """A 3x3 homography (array of 9) into pitch metres from the upper left corner, its last entry 1; null if an entry isn't finite or it can't be inverted."""
    a = [h[i] for i in range(9)]
    if invert:
        minor = lambda p, q, r, s: a[p] * a[s] - a[q] * a[r]
        adjugate = [minor(4, 5, 7, 8), -minor(1, 2, 7, 8), minor(1, 2, 4, 5), -minor(3, 5, 6, 8), minor(0, 2, 6, 8), -minor(0, 2, 3, 5), minor(3, 4, 6, 7), -minor(0, 1, 6, 7), minor(0, 1, 3, 4)]
        det = F.nullif(a[0] * adjugate[0] + a[1] * adjugate[3] + a[2] * adjugate[6], F.lit(0.0))
        a = [c / det for c in adjugate]
    if centred:
        a = [a[0] + a[6] * (length / 2), a[1] + a[7] * (length / 2), a[2] + a[8] * (length / 2), a[3] + a[6] * (width / 2), a[4] + a[7] * (width / 2), a[5] + a[8] * (width / 2), a[6], a[7], a[8]]
    last = F.when(F.abs(a[8]) > 1e-12, a[8]).otherwise(1.0)
    out = F.array(*[c / last for c in a])
    return F.when((F.size(h) == 9) & F.forall(out, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), out)


def blended(old: Column, new: Column, keep: float) -> Column:
    """A running mean of vectors, brought to length 1; the new one where there is none before."""
    mix = F.when(old.isNull(), new).otherwise(F.zip_with(old, new, lambda a, b: keep * a + (1 - keep) * b))
    norm = F.sqrt(F.aggregate(mix, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when(norm > 0, F.transform(mix, lambda x: x / norm))


def visible_number(number: Column, confidence: Column, votes: Column, head: Column, margin: Column, *, sure: float = 0.45, least_votes: int = 3, stable_votes: int = 8, least_margin: float = 0.10, head_votes: int = 4, least_head: float = 0.65) -> Column:
    """The number if its share is high, or it leads by many votes, or it leads the second clearly."""
    z = lambda c: F.coalesce(c, F.lit(0).cast("double"))
    ok = ((z(confidence) >= sure) & (z(votes) >= least_votes)) | ((z(votes) >= stable_votes) & (z(margin) >= least_margin)) | ((z(votes) >= head_votes) & (z(head) >= least_head))
    return F.when(ok, number)


def label(group: Column, team: Column, number: Column, player: Column, confidence: Column, display: Column, least_confidence: float = 0.5) -> Column:
    """What is written above a track: group or team, number, and the player with confidence, or the display."""
    names = F.create_map(*[F.lit(x) for kv in GROUP_LABELS.items() for x in kv])
    who = F.when(player.isNotNull() & (confidence >= least_confidence), F.concat_ws(" ", player, F.format_string("%.2f", confidence))).otherwise(F.concat(F.lit("ID"), display.cast("string")))
    return F.concat_ws(" ", F.coalesce(F.try_element_at(names, group), F.concat(F.lit("T"), F.coalesce(F.nullif(team, F.lit(0)).cast("string"), F.lit("?")))), F.concat(F.lit("#"), number.cast("string")), who)
