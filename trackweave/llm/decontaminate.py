"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import WordTable, byte_groups, text_bytes, written
from trackweave.llm.pieces import kept

STRIP = string.punctuation
#: Places of a seed's words: three in a row, and two, any word, one more, which also hold where every third or fourth word differs.
SHAPES = ((0, 1, 2), (0, 1, 3))
#: The seed filter that is sent to every worker has 2^BITS[0] bits, or more up to 2^BITS[1] (32 MB), 32 or more for each seed.
BITS = (20, 28)


def _hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, lower-cased and without outer punctuation; 0 for a word of punctuation only."""
    plain = [w.decode().lower().strip(STRIP).encode() for w in words]
    return np.array([xxhash.xxh64_intdigest(p, 3) | 1 if p else 0 for p in plain], np.uint64)


def text_hashes(texts: list[bytes]) -> list[np.ndarray]:
    table = kept(("hashes",), lambda: WordTable(_hashes, 150_000))
    cut = [t.split() for t in texts]
    at = table.lookup([w for ws in cut for w in ws])
    flat = table.rows[at] if len(at) else np.zeros(0, np.uint64)
    return [part[part != 0] for part in np.split(flat, np.cumsum([len(ws) for ws in cut])[:-1])]


def gram_hashes(words: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A hash of the words at these places after each word; as many as there are places for the last of them."""
    n = max(len(words) - shape[-1], 0)
    out = np.full(n, shape[-1], np.uint64)
    for k in shape:
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    return out ^ (out >> np.uint64(29))


def all_grams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all shapes, and where each begins."""
    grams = [gram_hashes(words, shape) for shape in SHAPES]
    return np.concatenate(grams), np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams])


def item_seeds(items: DataFrame) -> DataFrame:
    """Per item: item_id, item (hash of its words), words (hashes, 32 bits), grams and places (arrays side by side)."""
    schema = "item_id long, words array<int>, grams array<long>, places array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = text_hashes(text_bytes(batch.column(1)))
            grams = [all_grams(h) for h in hashes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_short(h) for h in hashes], pa.list_(pa.int32())), pa.array([g.view(np.int64) for g, _ in grams], pa.list_(pa.int64())), pa.array([p for _, p in grams], pa.list_(pa.int32()))], ["item_id", "words", "grams", "places"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, schema).withColumn("item", F.xxhash64("words"))


def _short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _filter(grams: DataFrame) -> np.ndarray:
    """One bit for each hash of the seeds, sized by their number within BITS; made of the bits that are set, of which there are never more."""
    bits = min(max(BITS[0], grams.count().bit_length() + 5), BITS[1])
    bit = F.shiftrightunsigned("gram", 64 - bits)
    word = grams.select(F.shiftright(bit, 5).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(31)).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(1 << (bits - 5), np.uint32)
    got = word.toPandas()
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).astype(np.uint32)
    return out


def _passing(grams: np.ndarray, bits: np.ndarray) -> np.ndarray:
    bit = grams >> np.uint64(64 - 5 - (len(bits).bit_length() - 1))
    return np.flatnonzero(bits[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32) & np.uint32(1))


def placed_seeds(items: DataFrame) -> DataFrame:
    """(gram, item_id, item, m, first, last): every gram of an item of m words, once, with the first and last place it stands at.

    None is left out for being frequent: what very many documents hold may be
    all that some of them share with the item, as where a thousand documents
    hold one edited copy and one holds the rest.
    """
    placed = items.select("item_id", "item", F.size("words").alias("m"), F.explode(F.arrays_zip("grams", "places")).alias("g"))
    return placed.groupBy(F.col("g.grams").alias("gram"), "item_id", "item", "m").agg(F.min("g.places").alias("first"), F.max("g.places").alias("last"))


def seed_hits(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Per text with a seed: doc_id, row (hash of the text, seeded by doc_id), words, grams and places of the hits."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter(seeds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, doc_ids = text_bytes(batch.column(1)), batch.column(0).to_pylist()
            for a, b in byte_groups([len(t) for t in texts], 2 << 20):
                rows = []
                for i, words in enumerate(text_hashes(texts[a:b]), a):
                    grams, places = all_grams(words)
                    at = _passing(grams, bits.value)
                    if len(at):
                        rows.append((doc_ids[i], np.uint64(xxhash.xxh64_intdigest(texts[i], (doc_ids[i] or 0) & (1 << 64) - 1)).astype(np.int64), _short(words), grams[at].view(np.int64), places[at]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())))], ["doc_id", "row", "words", "grams", "places"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, row long, words array<int>, grams array<long>, places array<int>")


def align(queries: list[np.ndarray], windows: list[np.ndarray], match: int = 2, mismatch: int = -1, gap: int = -1) -> np.ndarray:
    """Smith-Waterman scores of pairs, a row of the matrices of all pairs at a time.

    Gaps along the window follow from a running maximum, as each costs the same.
    """
    out = np.zeros(len(queries), np.int64)
    order = sorted(range(len(queries)), key=lambda i: len(queries[i]))
    for a, b in byte_groups([(len(queries[i]) + 1) * (len(windows[i]) + 1) // 16 + len(windows[i]) for i in order], 1 << 18):
        pick = order[a:b]
        m, w = max(len(queries[i]) for i in pick), max((len(windows[i]) for i in pick), default=0)
        q, t = np.full((len(pick), m), -1, np.int64), np.full((len(pick), w), -2, np.int64)
        for r, i in enumerate(pick):
            q[r, : len(queries[i])], t[r, : len(windows[i])] = queries[i].astype(np.uint32), windows[i].astype(np.uint32)
        row, best, slope = np.zeros((len(pick), w + 1), np.int32), np.zeros(len(pick), np.int32), -gap * np.arange(w + 1, dtype=np.int32)
        for k in range(m):
            step = np.zeros_like(row)
            step[:, 1:] = np.maximum(row[:, :-1] + np.where(t == q[:, k : k + 1], match, mismatch), row[:, 1:] + gap)
            row = np.maximum(np.maximum.accumulate(step + slope, axis=1) - slope, 0).astype(np.int32)
            best = np.maximum(best, row.max(axis=1))
        out[pick] = best
    return out


def shared_words(query: np.ndarray, window: np.ndarray) -> int:
    """How many words of the query stand in the window at all: no alignment matches more."""
    return int(np.isin(query, window).sum())


def contaminated(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.4) -> DataFrame:
    """Pairs of documents and benchmark items that they hold: doc_id, item_id, score, start, n_item_words.

    A pair's score is the best local alignment between the item's words and
    the passages of the document around the seeds that both hold (match 2,
    other word or gap -1), as a share of a full match; pairs at threshold or
    more are returned, one row each. start is the first word of the best passage.
    Every gram of an item in one of SHAPES is a seed, however many documents
    hold it; a passage that shares none with the item isn't aligned, nor is
    one that has too few of its words for the threshold.

    Words are compared lower-cased without outer punctuation. The filter that
    goes to workers is at most 32 MB; what passes it is joined to the seeds
    exactly. Items under three words, and null texts, have no seeds and give no
    row; documents without an id, and null or repeated ids of items, are
    reported as they are; repeated rows give one row; empty tables give an
    empty result; further columns are ignored.
    """
    items = written(item_seeds(benchmark), "items")
    seeds = written(placed_seeds(items), "seeds")
    found = written(seed_hits(docs, seeds.select("gram").distinct()), "hits")
    pairs = found.select("doc_id", "row", F.explode(F.arrays_zip("grams", "places")).alias("x")).select("doc_id", "row", F.col("x.grams").alias("gram"), F.col("x.places").alias("pos"))
    hits = pairs.join(seeds, "gram")
    begin = F.col("pos") - F.col("last")
    spans = hits.groupBy("doc_id", "row", "item_id", "item", "m", F.floor(begin / F.col("m")).alias("near")).agg(F.min(begin).alias("low"), F.max(F.col("pos") - F.col("first")).alias("high"))
    slack = F.ceil(F.col("m") / 4).cast("int") + 2
    spans = spans.withColumn("start", F.greatest(F.lit(0), F.col("low") - slack).cast("int")).withColumn("stop", (F.col("high") + F.col("m") + slack).cast("int"))
    # rows that repeat have the same words: one of them is enough; the key is that of the join, so words are shuffled once
    texts = found.select(F.col("row").alias("r"), "words").dropDuplicates(["r"])
    passages = spans.join(texts, F.col("row") == F.col("r")).select("doc_id", "item_id", "item", "m", "start", F.slice("words", F.col("start") + 1, F.col("stop") - F.col("start")).alias("window"))
    queries = items.select(F.col("item").alias("i"), F.col("words").alias("query")).dropDuplicates(["i"])
    joined = passages.join(queries, F.col("item") == F.col("i"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for got in batches:
            enough = [shared_words(q, w) / len(q) >= threshold for q, w in zip(got["query"], got["window"])]
            got = got[enough]
            score = align(list(got["query"]), list(got["window"])) / (2.0 * got["m"])
            yield pd.DataFrame({"doc_id": got["doc_id"], "item_id": got["item_id"], "score": score, "start": got["start"], "n_item_words": got["m"]})[score >= threshold]

    scored = joined.select("doc_id", "item_id", "m", "start", "window", "query").mapInPandas(run, "doc_id long, item_id long, score double, start int, n_item_words int")
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("start")).alias("at"), "n_item_words")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.score").alias("score"), (-F.col("b.at")).alias("start"), F.col("b.n_item_words").alias("n_item_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the documents that hold a benchmark item; those without an id stay."""
    bad = written(contaminated(docs, benchmark, **options).select("doc_id").where("doc_id is not null").distinct(), "contaminated")
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
