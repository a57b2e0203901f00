"""Language identification by prediction by partial matching: code lengths under frozen byte context trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import byte_groups, lower_ascii, safe_pieces, text_bytes
from trackweave.llm.pieces import kept

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: Bytes before a text, which make its first contexts.
BEFORE = bytes(7)


def coded(text: bytes) -> bytes:
    """What is coded of a text: its words, ASCII letters in lower case, each with one space before it."""
    return b"".join([b" " + w for w in lower_ascii(text).split()])


def grams(text: bytes, order: int) -> np.ndarray:
    """Each byte of text and the order bytes before it as one number, the byte itself lowest; the first 7 bytes are only context."""
    every = np.ndarray(max(0, len(text) - 7), ">u8", text, strides=(1,)).astype(np.uint64)
    return every & np.uint64((1 << 8 * (order + 1)) - 1)


@dataclass
class ContextTrees:
    """For each language and each context of up to order bytes: the bits of each byte that followed, and of an escape.

    Method C: in a context with n occurrences of d distinct bytes, a byte seen
    c times has probability c / (n + d), and the escape to the next shorter
    context d / (n + d); a context never seen is passed over at no cost; below
    order 0 all 256 bytes are alike. Statistics don't change while coding, so
    the cost of a byte depends on it and the order bytes before it alone.
    Level k holds sorted keys of contexts of k bytes and of such contexts with
    a byte behind, and a column for each language.
    """

    order: int
    languages: list[str]
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    @classmethod
    def fit(cls, texts: dict[str, list[bytes]], order: int = 4) -> ContextTrees:
        """texts: for each language its sample."""
        if not 0 <= order <= 6:
            raise ValueError("order 0 to 6")
        out = cls(order, sorted(texts))
        found = [np.concatenate([np.zeros(0, np.uint64), *[grams(BEFORE + coded(t), order) for t in texts[x]]]) for x in out.languages]
        for k in range(order + 1):
            counted = [np.unique(g & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True) for g in found]
            keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *[u for u, _ in counted]]))
            seen = np.zeros((len(keys), len(found)))
            for j, (u, n) in enumerate(counted):
                seen[np.searchsorted(keys, u), j] = n
            contexts, first = np.unique(keys >> np.uint64(8), return_index=True)
            total = np.add.reduceat(seen, first, axis=0) if len(keys) else np.zeros((0, len(found)))
            distinct = np.add.reduceat(seen > 0, first, axis=0, dtype=np.int64) if len(keys) else np.zeros((0, len(found)))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + distinct) / distinct), np.nan)
                of = np.repeat(np.arange(len(contexts)), np.diff(np.append(first, len(keys))))
                bits = np.where(seen > 0, np.log2((total + distinct)[of] / seen), np.inf)
            out.levels.append((keys, bits.astype(np.float32), contexts, escape.astype(np.float32)))
        return out

    def cost(self, keys: np.ndarray) -> np.ndarray:
        """Bits that each language needs for the bytes that grams gave: a row for each key."""
        out = np.zeros((len(keys), len(self.languages)), np.float32)
        open_ = np.ones(out.shape, bool)
        for k in range(self.order, -1, -1):
            known, bits, contexts, escape = self.levels[k]
            if not len(known):
                continue
            key = keys & np.uint64((1 << 8 * (k + 1)) - 1)
            at, hit = _find(known, key)
            here = np.where(hit[:, None], bits[at], np.inf)
            take = open_ & np.isfinite(here)
            out[take] += here[take]
            open_ &= ~take
            at, hit = _find(contexts, key >> np.uint64(8))
            here = np.where(hit[:, None], escape[at], np.nan)
            leave = open_ & ~np.isnan(here)
            out[leave] += here[leave]
        out[open_] += 8.0
        return out


def _find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


class GramCosts:
    """Costs of the grams a worker has met, in a hash table with open addressing that starts anew beyond limit grams."""

    def __init__(self, trees: ContextTrees, limit: int = 1 << 20):
        self.trees, self.limit = trees, limit
        self._begin()

    def _begin(self) -> None:
        self.bits, self.held = 16, 0
        self.keys, self.at = np.full(1 << self.bits, ~np.uint64(0)), np.zeros(1 << self.bits, np.int32)
        self.rows = np.zeros((1 << 12, len(self.trees.languages)), np.float32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed ^ mixed >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _insert(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        slot, last = self._slots(keys), (1 << self.bits) - 1
        while len(slot):
            free = np.flatnonzero(self.keys[slot] == ~np.uint64(0))
            _, pick = np.unique(slot[free], return_index=True)
            put = free[pick]
            self.keys[slot[put]], self.at[slot[put]] = keys[put], numbers[put]
            rest = np.ones(len(slot), bool)
            rest[put] = False
            slot, keys, numbers = (slot[rest] + 1) & last, keys[rest], numbers[rest]

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Places in rows of the costs of keys."""
        if self.held > self.limit:
            self._begin()
        out, slot, left, missing = np.empty(len(keys), np.int64), self._slots(keys), np.arange(len(keys)), []
        while len(left):
            held = self.keys[slot]
            same = held == keys[left]
            out[left[same]] = self.at[slot[same]]
            empty = held == ~np.uint64(0)
            missing.append(left[empty])
            more = ~same & ~empty
            left, slot = left[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        missing = np.concatenate(missing) if missing else left
        if len(missing):
            new, back = np.unique(keys[missing], return_inverse=True)
            numbers = np.arange(self.held, self.held + len(new))
            while self.held + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[numbers] = self.trees.cost(new)
            self.held += len(new)
            while self.held * 2 > 1 << self.bits:
                filled = np.flatnonzero(self.keys != ~np.uint64(0))
                old, at = self.keys[filled], self.at[filled]
                self.bits += 1
                self.keys, self.at = np.full(1 << self.bits, ~np.uint64(0)), np.zeros(1 << self.bits, np.int32)
                self._insert(old, at)
            self._insert(new, numbers)
            out[missing] = numbers[back]
        return out

    def bits_of(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths of coded texts (each with 7 bytes of context before it) under each language."""
        sizes = np.array([len(t) - 7 for t in texts])
        every = grams(b"".join(texts), self.trees.order)
        ends = np.cumsum(sizes + 7) - 7  # of the places that belong to a text, which the next one's context follows
        own = np.repeat(ends - sizes - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        places = self.lookup(every[own])  # may put more rows in
        rows = self.rows[places]
        out, have = np.zeros((len(texts), rows.shape[1])), np.flatnonzero(sizes)
        if len(have):
            out[have] = np.add.reduceat(rows, (np.cumsum(sizes) - sizes)[have], axis=0, dtype=np.float64)
        return out


def fit_languages(df: DataFrame, *, order: int = 4, max_rows: int = 4000, max_bytes: int = 8 << 20) -> ContextTrees:
    """Context trees of every lang of df (doc_id, text, lang), from its first rows by a hash of the id.

    Each language gets max_rows / languages rows, one at least, and of those
    the whole texts that begin within its share of max_bytes, so always the
    first, whatever its length. Both bounds are kept in Spark: rows are ranked
    by language without their texts, and texts beyond the share never reach
    the driver. Rows with null id, text or lang teach nothing; repeated rows
    count once; an empty table gives a model of no language.
    """
    rows = df.where("lang is not null and doc_id is not null and text is not null").select("lang", F.xxhash64("doc_id", "text").alias("h"), "doc_id", F.octet_length("text").cast("long").alias("n"), "text")
    n = rows.select("lang").distinct().count()
    share, most = max(1, max_rows // max(1, n)), max(1, max_bytes // max(1, n))
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    # ranked in 64 parts of a language first, so that no task sorts a whole one
    parts = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h", "doc_id")
    ranked = rows.drop("text").dropDuplicates(["lang", "h", "doc_id"]).withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= share)
    ranked = ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= share)
    bounded = ranked.withColumn("before", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).where(F.col("before") < most)
    picked = bounded.select("lang", "h", "doc_id").distinct()
    texts: dict[str, list[bytes]] = {}
    for r in rows.join(F.broadcast(picked), ["lang", "h", "doc_id"]).dropDuplicates(["lang", "h", "doc_id"]).orderBy("lang", "h", "doc_id").select("lang", "text").collect():
        texts.setdefault(r["lang"], []).append(r["text"].encode())
    return ContextTrees.fit(texts, order)


def identify_languages(df: DataFrame, trees: ContextTrees, *, id_column: str = "doc_id", text_column: str = "text", batch_bytes: int = 1 << 19) -> DataFrame:
    """Per row of df: id, lang_pred, score and bits, the code length of the text under the best tree.

    All words of the whole text are coded under every tree, contexts reaching
    over the spaces between them; the shortest code wins, ties go to the first
    language by name. score is the winner's share of 2^-bits over all
    languages, with the bits of a text taken per 8 words beyond that, so that
    long texts don't all score 1. A text that is null or has no letter gives
    `und` with score 0, as does a model without languages. Null and repeated
    ids are scored row by row; an empty table gives an empty result; further
    columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(trees)  # bounded by the fitting sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        costs = kept(("languages", id(model)), lambda: GramCosts(model))
        names = [*model.languages, UNKNOWN]
        for batch in batches:
            texts = text_bytes(batch.column(1))
            bits, count = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
            if model.languages:
                pieces, last = [], {}
                for i, t in enumerate(texts):
                    for p in safe_pieces(t, batch_bytes):
                        line = coded(p)
                        pieces.append((i, last.get(i, BEFORE) + line))
                        last = {i: pieces[-1][1][-7:]}  # a long text's pieces go on where the one before ended
                        count[i] += line.count(b" ")
                for a, b in byte_groups([len(p) for _, p in pieces], batch_bytes):
                    np.add.at(bits, [i for i, _ in pieces[a:b]], costs.bits_of([p for _, p in pieces[a:b]]))
            letters = np.array([bool(LETTER.search(t.decode())) for t in texts], bool) & bool(model.languages)
            if model.languages:
                best, least = bits.argmin(axis=1), bits.min(axis=1)
                share = 1 / np.exp2((least[:, None] - bits) / np.maximum(1, count / 8)[:, None]).sum(axis=1)
            else:
                best, least, share = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
            chosen = [names[k] if ok else UNKNOWN for k, ok in zip(best, letters)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chosen, pa.string()), pa.array(np.where(letters, share, 0.0)), pa.array(np.where(letters, least, 0.0))], ["id", "lang_pred", "score", "bits"])

    kind = df.schema[id_column].dataType.simpleString()
    out = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, bits double")
    return out.withColumnRenamed("id", id_column)
