"""Helpers shared by the text operators: scratch tables, word tables and byte-balanced batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes outside space and \t..\r, which is what bytes.split() cuts at.
WORD_BREAK = r"[\x20\x09-\x0D]+"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; a temporary one only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="trackweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_filter(hashes: DataFrame, most_bits: int = 25) -> Callable[[Column], Column] | None:
    """Predicate on a column of 64-bit hashes: true for all of `hashes` (one long column), for few others.

    One bit each for 16 times as many places as hashes, 2^most_bits (4 MB) at
    most; None where so few bits would tell little, and all rows are to pass.
    """
    spark, (name,) = hashes.sparkSession, hashes.columns
    n = hashes.count()
    bits = min(max(16, (16 * n).bit_length()), most_bits)
    if 2 * n > 1 << bits:
        return None
    place = F.shiftrightunsigned(name, 64 - bits)
    words = hashes.select(F.shiftright(place, 5).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(31)).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).astype(np.uint32)
    sent = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def may_hold(column: pd.Series) -> pd.Series:
        at = column.to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - bits)
        return pd.Series((sent.value[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool))

    return may_hold


def lower_ascii(text: bytes) -> bytes:
    return text.translate(_LOWER)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def byte_groups(sizes: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to about budget; one larger item stands alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > budget:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def safe_pieces(text: bytes, size: int) -> Iterator[bytes]:
    """Cut a long text at ASCII white space, so that no word is divided."""
    start, n = 0, len(text)
    while n - start > size:
        cut = max(text.rfind(c, start, start + size) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= start:  # one word longer than a piece: go on to where it ends
            cut = min((p for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (p := text.find(c, start + size)) >= 0), default=n)
        yield text[start:cut]
        start = cut
    yield text[start:]


class WordTable:
    """Numbers distinct words and keeps one computed row for each, within a bound.

    compute(words) returns an array with a row per word. When more than limit
    words are held the table starts anew, so memory doesn't follow the input.
    """

    def __init__(self, compute: Callable[[list[bytes]], np.ndarray], limit: int = 400_000):
        self.compute, self.limit = compute, limit
        self.index: dict[bytes, int] = {}
        self.rows: np.ndarray | None = None

    def lookup(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > self.limit:
            self.index, self.rows = {}, None
        found = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = list(dict.fromkeys([words[i] for i in missing.tolist()]))
            had = len(self.index)
            self.index.update(zip(new, range(had, had + len(new))))
            self._append(had, self.compute(new))
            found[missing] = np.fromiter(map(self.index.get, [words[i] for i in missing.tolist()]), np.int64, len(missing))
        return found

    def _append(self, had: int, more: np.ndarray) -> None:
        if self.rows is None or had + len(more) > len(self.rows):
            grown = np.empty((max(2 * had, had + len(more), 1024), *more.shape[1:]), more.dtype)
            if had:
                grown[:had] = self.rows[:had]
            self.rows = grown
        self.rows[had : had + len(more)] = more


def sums_by_run(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each consecutive run of values; runs may be empty."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
