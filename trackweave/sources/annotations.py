"""Reading annotations, calibrations, rosters and side files of other tools into typed relations, and writing what they read."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType, VariantType

from trackweave.functions.fields import attribute_number, box_area, corner_box, normal_role, path_split, pitch_homography

#: A roster entry as files give it; kit_hint, prior and numbers come in several forms.
ENTRY = "player_id string, name string, team_id int, jersey_number int, role string, position_prior variant, visual_embedding array<float>, visual_profile array<float>, metadata map<string,string>, kit_hint map<string,string>, kit_color string, uniform_color string, shirt_color string, referee_color string, color string"
ROOT_COLOURS = ("kit_color", "uniform_color", "shirt_color", "referee_color", "color")
#: Where a kit's parts may stand in its hint.
KIT = {"shirt": ("shirt", "shirt_color", "primary"), "shorts": ("shorts", "shorts_color"), "socks": ("socks", "socks_color")}


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """A roster list with one form of everything: player_id, name, team, jersey_number, role, prior_x, prior_y, look, metadata.

    A prior is {x, y} or a pair. A kit hint fills kit, shirt, shorts and socks
    colours that the metadata lacks, then colours at the root do. A number
    outside 1..99, or one that stands twice in a team, is an error.
    """
    raw = spark.read.option("multiLine", True).schema(ENTRY).json(path)
    if bad := raw.where(~F.col("jersey_number").between(1, 99)).select("player_id", "jersey_number").limit(5).collect():
        raise ValueError(f"numbers outside 1 to 99: {[tuple(r) for r in bad]}")
    if twice := raw.where("jersey_number is not null and team_id is not null").groupBy("team_id", "jersey_number").count().where("count > 1").limit(5).collect():
        raise ValueError(f"numbers given twice in a team: {[(r[0], r[1]) for r in twice]}")
    hint = F.col("kit_hint")
    part = {k: F.coalesce(*[F.nullif(F.try_element_at(hint, F.lit(w)), F.lit("")) for w in words]) for k, words in KIT.items()}
    given = [("kit_color", part["shirt"]), ("shirt_color", part["shirt"]), ("shorts_color", part["shorts"]), ("socks_color", part["socks"]), *((c, F.col(c)) for c in ROOT_COLOURS)]
    meta = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    for key, value in given:
        have = F.map_contains_key(meta, key) | value.isNull()
        meta = F.when(have, meta).otherwise(F.map_concat(meta, F.create_map(F.lit(key), value)))
    prior = F.col("position_prior")
    at = lambda field, i: F.coalesce(F.try_variant_get(prior, f"$.{field}", "double"), F.when(F.try_variant_get(prior, "$[2]", "double").isNull(), F.try_variant_get(prior, f"$[{i}]", "double")))
    return raw.select("player_id", F.coalesce("name", "player_id").alias("name"), F.col("team_id").alias("team"), "jersey_number", "role", at("x", 0).alias("prior_x"), at("y", 1).alias("prior_y"), F.coalesce(F.when(F.size("visual_embedding") > 0, F.col("visual_embedding")), F.col("visual_profile")).alias("look"), meta.alias("metadata"))


def fit_homography(pixels: np.ndarray, pitch: np.ndarray) -> np.ndarray | None:
    """The homography of least squares through four or more pairs of points, from the smallest singular vector; None where it isn't determined.

    Points are centred and scaled first, so that large coordinates lose nothing.
    """
    if len(pixels) < 4 or len(pixels) != len(pitch):
        raise ValueError("at least four pairs of points")

    def scaled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle = p.mean(axis=0)
        size = np.sqrt(((p - middle) ** 2).sum(axis=1)).mean() or 1.0
        t = np.array([[1.4142135623730951 / size, 0, -1.4142135623730951 * middle[0] / size], [0, 1.4142135623730951 / size, -1.4142135623730951 * middle[1] / size], [0, 0, 1]])
        return (p - middle) * 1.4142135623730951 / size, t

    (a, ta), (b, tb) = scaled(np.asarray(pixels, float)), scaled(np.asarray(pitch, float))
    one, zero = np.ones(len(a)), np.zeros((len(a), 3))
    left = np.column_stack([a, one])
    rows = np.concatenate([np.hstack([left, zero, -b[:, :1] * left]), np.hstack([zero, left, -b[:, 1:] * left])])
    _, s, v = np.linalg.svd(rows)
    if s[7] < 1e-9 * s[0]:
        return None
    h = np.linalg.inv(tb) @ v[-1].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def fitted_homographies(points: DataFrame, key: str) -> DataFrame:
    """key, homography (9 numbers) from rows of key, px, py, x, y; keys of points that determine none have null."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        h = fit_homography(pdf[["px", "py"]].to_numpy(float), pdf[["x", "y"]].to_numpy(float)) if len(pdf) >= 4 else None
        return pd.DataFrame({key: [pdf[key].iloc[0]], "homography": [None if h is None else h.ravel().tolist()]})

    kind = points.schema[key].dataType.simpleString()
    return points.select(key, "px", "py", "x", "y").groupBy(key).applyInPandas(fit, f"`{key}` {kind}, homography array<double>")


def read_calibration(spark: SparkSession, path: str) -> dict:
    """A calibration file (a few numbers, so read on the driver): homography as 9 numbers, pitch_length, pitch_width.

    It gives a 3x3 homography, or pairs of points, or four pixel corners of the
    pitch (or of target_vertices), from which one is fitted.
    """
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    data = json.loads(text)
    length, width = float(data.get("pitch_length", 105.0)), float(data.get("pitch_width", 68.0))
    if "homography" in data:
        h = np.asarray(data["homography"], float)
        if h.shape != (3, 3):
            raise ValueError("homography must be 3x3")
    elif "point_correspondences" in data:
        h = fit_homography(np.array([p["pixel"] for p in data["point_correspondences"]]), np.array([p["pitch"] for p in data["point_correspondences"]]))
    elif "pixel_vertices" in data:
        h = fit_homography(np.array(data["pixel_vertices"]), np.array(data.get("target_vertices", [[0, width], [0, 0], [length, 0], [length, width]])))
    else:
        raise ValueError(f"no calibration in {path}")
    return {"homography": None if h is None else h.ravel().tolist(), "pitch_length": length, "pitch_width": width}


def read_homographies(spark: SparkSession, path: str, *, temporal_index: int = 0, frame_offset: int = 0, centred: bool = True, invert: bool = False, length: float = 105.0, width: float = 68.0) -> DataFrame:
    """frame, homography from records of per-frame calibrations; a later record of the same frame counts.

    The file is a list, one record, an object with a list under records,
    samples or per_sample_output, an object of records by image id, or lines of
    records. A frame is its number, else the digits at the end of its image's
    name, else the record's place; frame_offset is taken from it. Of a stack of
    matrices the one at temporal_index counts.
    """
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t")).where("t <> ''")
    one = F.try_parse_json("t")
    is_list = F.col("t").startswith("[")
    inner = F.coalesce(*[F.try_variant_get(one, f"$.{k}", "array<variant>") for k in ("records", "samples", "per_sample_output")])
    single = F.try_variant_get(one, "$.homography", "variant").isNotNull()
    keyed = F.map_entries(F.try_variant_get(one, "$", "map<string,variant>"))
    named = F.transform(keyed, lambda e: F.struct(e["key"].alias("id"), e["value"].alias("r")))
    plain = lambda a: F.transform(a, lambda r: F.struct(F.lit(None).cast("string").alias("id"), r.alias("r")))
    lines = F.transform(F.filter(F.split("t", r"\n"), lambda x: F.trim(x) != ""), lambda x: F.try_parse_json(x))
    by_line = one.isNull() | ((F.size(lines) > 1) & F.forall(lines, lambda x: x.isNotNull()))  # a parser may be content with the first of them
    records = F.when(by_line, plain(lines)).when(is_list, plain(F.try_variant_get(one, "$", "array<variant>"))).when(single, plain(F.array(one))).when(inner.isNotNull(), plain(inner)).otherwise(named)
    each = whole.select(F.posexplode(records).alias("place", "e")).select("place", "e.id", F.col("e.r").alias("r"))
    get = lambda k, kind: F.try_variant_get("r", f"$.{k}", kind)
    image = F.coalesce(*[get(k, "string") for k in ("image_id", "image_ids", "image", "file_name")], F.get(get("image_ids", "array<string>"), F.lit(0)), F.col("id"))
    stem = F.regexp_replace(F.element_at(F.split(image, "/"), -1), r"\.[^.]*$", "")
    digits = F.regexp_extract(stem, r"(\d+)$", 1).try_cast("long")
    frame = F.coalesce(get("frame", "long"), get("frame_index", "long"), get("frame_idx", "long"), digits, F.col("place").cast("long")) - frame_offset
    flat, stack = get("homography", "array<array<double>>"), get("homography", "array<array<array<double>>>")
    matrix = F.coalesce(F.when(F.size(F.flatten(flat)) == 9, F.flatten(flat)), F.flatten(F.get(stack, F.lit(temporal_index))))
    found = each.where(get("homography", "variant").isNotNull()).select("place", frame.alias("frame"), pitch_homography(matrix, centred=centred, invert=invert, length=length, width=width).alias("homography"))
    return found.groupBy("frame").agg(F.max_by("homography", "place").alias("homography"))


def label_files(spark: SparkSession, path: str, name: str = "Labels-GameState.json", *, sequences: list[str] | None = None, splits: list[str] | None = None) -> DataFrame:
    """Label files below a folder as text: path, sequence (their folder), split, content; only those of the sequences and splits asked for are kept."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    out = files.select("path", F.element_at(F.split("path", "/"), -2).alias("sequence"), path_split(F.col("path")).alias("split"), "content")
    if sequences:
        out = out.where(F.col("sequence").isin(*sequences))
    return out.where(F.col("split").isin(*splits)) if splits else out


LABELS = "images array<struct<id:string,image_id:string,file_name:string,has_labeled_person:boolean,frame:int>>, annotations array<struct<id:string,image_id:string,category_id:int,track_id:string,person_id:string,bbox_image:map<string,double>,bbox:map<string,double>,attributes:map<string,string>>>, categories array<struct<id:int,name:string>>"


def annotations(files: DataFrame) -> DataFrame:
    """Annotations of label files with their image and category, and skip, the first reason that one isn't a numbered player (null: it is).

    The later image of an id counts; a role in the attributes goes before the
    category. Outputs: sequence, split, track, frame_name, frame, role, team, truth_number, box, skip.
    """
    parsed = files.select("path", "sequence", "split", F.from_json("content", LABELS).alias("l"))
    images = parsed.select("path", F.posexplode("l.images").alias("at", "i")).select("path", "at", "i", F.explode(F.array_compact(F.array_distinct(F.array("i.id", "i.image_id")))).alias("image_id"))
    images = images.groupBy("path", "image_id").agg(F.max_by("i", "at").alias("i"))
    kinds = parsed.select("path", F.explode("l.categories").alias("c")).select("path", F.col("c.id").alias("category_id"), F.lower("c.name").alias("category")).dropDuplicates(["path", "category_id"])
    each = parsed.select("path", "sequence", "split", F.explode("l.annotations").alias("a"))
    out = each.withColumns({"image_id": F.col("a.image_id"), "category_id": F.col("a.category_id")}).join(images, ["path", "image_id"], "left").join(kinds, ["path", "category_id"], "left")
    own = F.coalesce(*[F.nullif(F.try_element_at("a.attributes", F.lit(k)), F.lit("")) for k in ("role", "class", "category")])
    given = F.coalesce(F.when(F.size("a.bbox_image") > 0, F.col("a.bbox_image")), F.col("a.bbox"))
    frame = F.coalesce("i.frame", F.regexp_extract(F.regexp_replace("i.file_name", r"\.[^.]*$", ""), r"(\d+)", 1).try_cast("int"), F.lit(0))
    out = out.select(
        "sequence", "split", F.coalesce(F.nullif("a.track_id", F.lit("")), F.nullif("a.person_id", F.lit(""))).alias("track"), F.col("i.file_name").alias("frame_name"), frame.alias("frame"), normal_role(F.coalesce(own, F.col("category"))).alias("role"),
        F.coalesce(F.try_element_at("a.attributes", F.lit("team")), F.try_element_at("a.attributes", F.lit("side"))).alias("team"), attribute_number(F.coalesce("a.attributes", F.create_map().cast("map<string,string>"))).alias("truth_number"), corner_box(given).alias("box"), (F.col("i").isNotNull() & F.coalesce("i.has_labeled_person", F.lit(True))).alias("seen_"),
    )
    skip = F.when(~F.col("seen_"), "missing_or_unlabeled_image").when(~F.coalesce(F.col("role").isin("player", "goalkeeper"), F.lit(False)), "role").when(F.col("truth_number").isNull(), "missing_jersey_number")
    return out.withColumn("skip", skip).drop("seen_")


def truth_tracklets(found: DataFrame, *, min_area: float = 0.0, min_frames: int = 1) -> DataFrame:
    """Rows of numbered players in tracklets of at least min_frames, each with its tracklet's most frequent number (the first seen of equals)."""
    from trackweave.operators.aggregates import mode_first_seen

    ok = found.where("skip is null and track is not null and frame_name is not null").where(box_area(F.col("box")) >= min_area)
    keys = ["sequence", "track"]
    n = ok.groupBy(*keys).agg(F.count("*").alias("num_frames")).where(F.col("num_frames") >= min_frames)
    mode = mode_first_seen(ok, keys, "truth_number", "frame", "n_").drop("n__votes")
    return ok.join(n, keys).join(mode, keys).withColumn("truth_number", F.col("n_")).drop("n_")


def numbered_lines(spark: SparkSession, path: str, *, sequences: list[str] | None = None, roles: tuple[str, ...] = ("player", "goalkeeper")) -> DataFrame:
    """Ground truth lines of the roles with a number of 1..99, frames counted from 0."""
    schema = "sequence string, split string, frame int, role string, team string, jersey_number string, bbox_image map<string,double>, bbox array<double>, track_id string"
    rows = spark.read.schema(schema).json(path)
    number = F.col("jersey_number").try_cast("int")
    out = rows.withColumns({"jersey_number": F.when(number.between(1, 99), number), "frame": F.col("frame") - 1}).where(F.col("jersey_number").isNotNull() & F.lower("role").isin(*roles))
    return out.where(F.col("sequence").isin(*sequences)) if sequences else out


def optional_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A JSON side file, or None where there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def _plain(field) -> Column:
    return F.to_json(field.name).alias(field.name) if isinstance(field.dataType, (ArrayType, StructType, VariantType)) else F.col(field.name)


def write_artifacts(relations: dict[str, DataFrame], folder: str) -> None:
    """A Parquet folder for each relation of a run."""
    for name, df in relations.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_lines(df: DataFrame, path: str, skip: Column | None = None) -> None:
    """JSON lines; rows for which skip holds are left out."""
    (df if skip is None else df.where(~F.coalesce(skip, F.lit(False)))).write.mode("overwrite").json(path)


def write_label_files(df: DataFrame, path: str) -> None:
    """Detector labels: rows of file and line as text below a folder for each file, in order of the lines."""
    df.where("line is not null").repartition("file").sortWithinPartitions("file", "line").select("file", F.col("line").alias("value")).write.mode("overwrite").partitionBy("file").text(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small table as CSV with a header, nested cells as JSON, in one file."""
    df.select(*[_plain(f) for f in df.schema]).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_cache(df: DataFrame, path: str, key: str) -> int:
    """Rows whose key the cache at path lacks, appended to it by Spark's commit protocol; returns how many.

    A second writer of the same key may append it as well; readers take any of its rows.
    """
    spark = df.sparkSession
    new = df.dropDuplicates([key])
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    new = new.select(df.columns)
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def cached(df: DataFrame, path: str, key: str) -> DataFrame:
    """df with what the cache holds under its key; the key's own row columns stay those of df."""
    held = df.sparkSession.read.parquet(path).dropDuplicates([key])
    return df.join(held.select(key, *[c for c in held.columns if c not in df.columns]), key, "left")
