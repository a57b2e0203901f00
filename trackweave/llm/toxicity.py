"""Toxicity: a convolutional text classifier on hashed word embeddings, trained in numpy."""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import WordTable, byte_groups, safe_pieces, text_bytes
from trackweave.llm.pieces import kept

STRIP = string.punctuation.encode()
POWER, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def word_features(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of words, lower-cased and without outer punctuation: (all buckets, how many for each word).

    A word's first bucket is its own, from a polynomial of its bytes; the others
    are those of its byte 4- and 5-grams with marked ends. All words are hashed side by side.
    """
    marked = [b"<%b>" % (w.lower().strip(STRIP) if w.isascii() else w.decode().lower().strip(STRIP.decode()).encode()) for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    text = np.frombuffer(b"".join(marked) + b"    ", np.uint8).astype(np.uint64)
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    powers = np.cumprod(np.append(np.uint64(1), np.full(int(size.max(initial=1)), POWER, np.uint64)))
    own = np.add.reduceat(text[: len(place)] * powers[place], begin) if len(words) else np.zeros(0, np.uint64)
    four = text[:-4] | text[1:-3] << np.uint64(8) | text[2:-2] << np.uint64(16) | text[3:-1] << np.uint64(24)
    five = four | text[4:] << np.uint64(32)
    fours, fives = np.maximum(size - 3, 0), np.maximum(size - 4, 0)
    count = 1 + fours + fives
    flat = np.empty(int(count.sum()), np.uint64)
    first = np.cumsum(count) - count
    flat[first] = own ^ (own >> np.uint64(29))
    flat[ragged(first + 1, fours)] = four[ragged(begin, fours)]
    flat[ragged(first + 1 + fours, fives)] = five[ragged(begin, fives)]
    return ((flat * MIX) >> np.uint64(40)).astype(np.int64) % buckets, count


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for size[0] places, then the same for the next."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def feature_weights(size: np.ndarray) -> np.ndarray:
    """All buckets of a word share 1."""
    return np.repeat(1 / size, size).astype(np.float32)[:, None]


@dataclass
class ConvNet:
    """score = sigmoid(out . max over positions of relu(filters)) for several filter widths.

    taps holds a dim x filters matrix for each place under each filter width.
    thresholds: by language, where the score best separates the calibration rows.
    """

    buckets: int
    widths: tuple[int, ...]
    filters: int
    embed: np.ndarray
    taps: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def new(cls, buckets: int, dim: int, filters: int, widths: tuple[int, ...], seed: int, scale: float = 0.1) -> ConvNet:
        rng = np.random.default_rng(seed)
        f = len(widths) * filters
        return cls(buckets, widths, filters, rng.normal(0, scale, (buckets, dim)).astype(np.float32), rng.normal(0, 0.3, (sum(widths), dim, filters)).astype(np.float32), np.zeros(f, np.float32), np.append(rng.normal(0.3, 0.1, f), -1.0).astype(np.float32))

    def vectors(self, words: list[bytes]) -> np.ndarray:
        flat, n = word_features(words, self.buckets)
        return np.add.reduceat(self.embed[flat] * feature_weights(n), np.cumsum(n) - n, axis=0)

    def responses(self, words: list[bytes]) -> np.ndarray:
        """What each word adds to the filters at each place: rows of sum(widths) * filters."""
        vectors = self.vectors(words)
        return np.concatenate([vectors @ tap for tap in self.taps], axis=1)

    def pool(self, rows: np.ndarray, at: np.ndarray, counts: np.ndarray, goes_on: np.ndarray | None = None) -> np.ndarray:
        """Largest filter outputs of each run of words, before the bias; rows ends with a zero row for places beyond the end.

        A run that goes_on has no end of its own: only windows that lie in it whole count.
        """
        pad = max(self.widths) - 1
        padded = np.full(int(counts.sum() + (pad + 1) * len(counts)), len(rows) - 1)
        start = np.cumsum(counts + pad + 1) - counts - pad - 1
        padded[np.arange(len(at)) + np.repeat(start - (np.cumsum(counts) - counts), counts)] = at
        padded = np.append(padded, np.full(pad, len(rows) - 1))
        out, tap, n = [], 0, len(padded) - pad
        for width in self.widths:
            total = None
            for k in range(width):
                part = rows[:, tap * self.filters : (tap + 1) * self.filters][padded[k : k + n]]
                total = part if total is None else total + part
                tap += 1
            windows = np.maximum(counts, 1) if goes_on is None else np.where(goes_on, counts - width + 1, np.maximum(counts, 1))
            stops = np.stack([start, start + np.maximum(windows, 1)], axis=1).ravel()
            best = np.maximum.reduceat(total, stops, axis=0)[::2]
            best[windows < 1] = -np.inf
            out.append(best)
        return np.concatenate(out, axis=1)

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.maximum(pooled + self.bias, 0)
        logit = hidden @ self.out[:-1] + self.out[-1] + self.shift
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        words = [t.split() for t in texts]
        index = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        rows = self.responses(list(index)) if index else np.zeros((0, sum(self.widths) * self.filters), np.float32)
        rows = np.concatenate([rows, np.zeros((1, rows.shape[1]), np.float32)])
        at = np.fromiter((index[w] for ws in words for w in ws), np.int64)
        return self.probability(self.pool(rows, at, np.array([len(ws) for ws in words], np.int64)))


def train(texts: list[bytes], toxic: np.ndarray, languages: list[str | None], *, buckets: int = 1 << 15, dim: int = 16, filters: int = 8, widths: tuple[int, ...] = (1, 2, 3), epochs: int | None = None, steps: int = 500, batch: int = 32, rate: float = 0.1, seed: int = 0, calibrate: float = 0.2) -> ConvNet:
    """Adagrad on the log loss, positives weighted up to balance; a share of the rows is kept for calibration.

    The cut that separates those rows best becomes score 0.5, and each language
    with rows of both kinds gets its own threshold. Languages take no part in the score.
    Unless epochs is given, about steps batches are seen, in 3 to 20 rounds.
    """
    net, rng = ConvNet.new(buckets, dim, filters, widths, seed), np.random.default_rng(seed)
    index: dict[bytes, int] = {}
    docs = [np.fromiter((index.setdefault(w, len(index)) for w in t.split()), np.int32) for t in texts]  # words of one text at a time
    flat, n_ids = word_features(list(index), buckets)
    index.clear()
    flat = flat.astype(np.int32)
    begin, weights = np.cumsum(n_ids) - n_ids, feature_weights(n_ids)
    order = rng.permutation(len(docs))
    held, used = order[: int(calibrate * len(docs))], order[int(calibrate * len(docs)) :]
    weight = np.where(toxic == 1, min(10.0, max(1.0, (toxic[used] == 0).sum() / max(1, (toxic[used] == 1).sum()))), 1.0)
    memory = {k: np.full(v.shape, 1e-3, np.float32) for k, v in (("embed", net.embed), ("taps", net.taps), ("bias", net.bias), ("out", net.out))}
    pad = max(widths) - 1

    def step(name: str, where, grad: np.ndarray) -> None:
        memory[name][where] += grad**2
        getattr(net, name)[where] -= rate * grad / np.sqrt(memory[name][where])

    for _ in range(epochs or int(np.clip(steps * batch / max(1, len(used)), 3, 20))):
        for some in np.array_split(rng.permutation(used), max(1, len(used) // batch)):
            if not len(some):
                continue
            own = [docs[i] for i in some]
            uniq, at = np.unique(np.concatenate(own), return_inverse=True)
            counts = np.array([len(d) for d in own])
            size = n_ids[uniq]
            cut = ragged(begin[uniq], size)
            vectors = np.add.reduceat(net.embed[flat[cut]] * weights[cut], np.cumsum(size) - size, axis=0) if len(uniq) else np.zeros((0, dim), np.float32)
            vectors = np.concatenate([vectors, np.zeros((1, dim), np.float32)])
            responses = [vectors @ tap for tap in net.taps]
            g_vec, g_taps = np.zeros_like(vectors), np.zeros_like(net.taps)
            start = np.cumsum(counts + pad) - counts - pad
            seq = np.full(int(counts.sum() + pad * len(own)) + pad, len(uniq))
            seq[ragged(start, counts)] = at
            best, pooled, tap = [], [], 0
            for width in widths:
                total = sum(responses[tap + k][seq[k : len(seq) - pad + k]] for k in range(width))
                tap += width
                where = np.stack([s + total[s : s + max(c, 1)].argmax(axis=0) for s, c in zip(start.tolist(), counts.tolist())])
                best.append(where)
                pooled.append(np.take_along_axis(total, where, axis=0))
            z = np.concatenate(pooled, axis=1) + net.bias
            hidden = np.maximum(z, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.out[:-1] + net.out[-1], -30, 30)))
            delta = ((p - toxic[some]) * weight[some] / len(some)).astype(np.float32)
            g_z = delta[:, None] * net.out[:-1] * (z > 0)
            step("out", slice(None), np.append(delta @ hidden, delta.sum()).astype(np.float32))
            step("bias", slice(None), g_z.sum(axis=0))
            tap = 0
            for j, width in enumerate(widths):
                g = g_z[:, j * filters : (j + 1) * filters]
                for k in range(width):
                    place = seq[best[j] + k]  # docs x filters
                    g_taps[tap + k] += np.einsum("bfd,bf->df", vectors[place], g)
                    np.add.at(g_vec, place.ravel(), (g[:, :, None] * net.taps[tap + k].T[None]).reshape(-1, dim))
                tap += width
            step("taps", slice(None), g_taps)
            hot = np.flatnonzero(np.abs(g_vec[:-1]).sum(axis=1))
            if len(hot):
                size = n_ids[uniq[hot]]
                cut = ragged(begin[uniq[hot]], size)
                ids_, inverse = np.unique(flat[cut], return_inverse=True)
                g_embed = np.zeros((len(ids_), dim), np.float32)
                np.add.at(g_embed, inverse, np.repeat(g_vec[hot], size, axis=0) * weights[cut])
                step("embed", ids_, g_embed)
    held = held if len(held) else order
    score = lambda: np.concatenate([np.zeros(0), *[net.score([texts[i] for i in held[a : a + 64]]) for a in range(0, len(held), 64)]])
    p, y = score(), toxic[held]
    cut = best_cut(p, y)
    net.shift = float(-np.log(cut / (1 - cut)))
    p = score()
    of = np.array([languages[i] or "" for i in held])
    for language in sorted(set(of) - {""}):
        mine = of == language
        if 0 < y[mine].sum() < mine.sum():
            net.thresholds[language] = best_cut(p[mine], y[mine])
    return net


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The score that splits with fewest errors, midway (in log odds) to the next; 0.5 with one kind of row only."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    s, hits = p[order], np.cumsum(y[order])
    errors = np.arange(1, len(s) + 1) - hits + y.sum() - hits
    errors = np.where(np.append(s[:-1] != s[1:], True), errors, len(s) + 1)
    i = int(errors.argmin())
    a, b = (np.clip(x, 1e-6, 1 - 1e-6) for x in (s[i], s[min(i + 1, len(s) - 1)]))
    middle = (np.log(a / (1 - a)) + np.log(b / (1 - b))) / 2
    return float(1 / (1 + np.exp(-middle)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, max_rows: int = 5000, max_bytes: int = 16 << 20, **options) -> ConvNet | None:
    """Train on at most max_rows labelled documents, half of each kind at most, and the whole texts that begin within max_bytes, in the order of a hash of the ids.

    The sample is chosen from the labels alone and joined to the texts by a
    broadcast of at most max_rows rows; rows that repeat count once, and those
    beyond max_rows or max_bytes are left out in Spark, before anything reaches the driver. Null
    ids and labels teach nothing, null and empty texts count as such. None
    without labels of both kinds, as with an empty table.
    """
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", "toxic").distinct()
    h = F.xxhash64("doc_id")
    picked = known.where("toxic = 1").orderBy(h, "doc_id").limit(max_rows // 2).union(known.where("toxic = 0").orderBy(h, "doc_id").limit(max_rows // 2))
    joined = docs.select("doc_id", "lang", "text").join(F.broadcast(picked), "doc_id").withColumns({"h": h, "n": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "t": F.xxhash64("text")})
    order = ["h", "doc_id", "toxic", "t"]
    first = joined.drop("text").orderBy(*order).limit(max_rows)
    before = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    fits = first.withColumn("before", before).where(F.col("before") < max_bytes).select(*order).distinct()
    chosen = joined.join(F.broadcast(fits), order).dropDuplicates(order).select("h", "doc_id", "toxic", "lang", F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("text"))
    rows = sorted(map(tuple, chosen.toLocalIterator()), key=lambda r: (*r[:3], r[4]))  # a partition at a time in the driver's JVM
    texts, toxic, languages = [bytes(r[4]) for r in rows], [r[2] for r in rows], [r[3] for r in rows]
    del rows
    y = np.array(toxic)
    if len(set(toxic)) < 2:
        return None
    return train(texts, y, languages, **options)


def score_toxicity(df: DataFrame, net: ConvNet | None, *, batch_bytes: int = 2 << 20) -> DataFrame:
    """Per document: doc_id, score, predicted (score >= 0.5), threshold (of its language, else 0.5) and flagged (score >= threshold).

    Every word of the whole text passes the filters. Long texts go in pieces
    that overlap by the widest filter less one word, and only the last one has
    an end, so pooling sees the windows of the whole text and no others. Null and empty texts score what the bias gives; without a model
    every score is 0. Null or repeated ids are scored row by row; an empty
    table gives an empty result; columns beyond doc_id, lang and text are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(net)  # bounded by its parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        table = kept(("toxicity", id(net)), lambda: WordTable(net.responses, 300_000)) if net is not None else None
        for batch in batches:
            texts = text_bytes(batch.column(1))
            languages = batch.column(2).to_pylist()
            score = np.zeros(len(texts))
            if net is not None and texts:
                pad = max(net.widths) - 1
                pooled = np.full((len(texts), len(net.widths) * net.filters), -np.inf, np.float32)
                pieces = [(i, p) for i, t in enumerate(texts) for p in safe_pieces(t, batch_bytes)]
                goes_on = np.array([i == j for (i, _), (j, _) in zip(pieces, [*pieces[1:], (-1, b"")])], bool)
                tail: dict[int, list[bytes]] = {}
                for a, b in byte_groups([len(p) for _, p in pieces], batch_bytes):
                    words = []
                    for i, p in pieces[a:b]:
                        ws = tail.get(i, []) + p.split()
                        tail = {i: ws[-pad:] if pad else []}
                        words.append(ws)
                    at = table.lookup([w for ws in words for w in ws])
                    rows = table.rows[: len(table.index)] if len(at) else np.zeros((0, sum(net.widths) * net.filters), np.float32)
                    rows = np.concatenate([rows, np.zeros((1, rows.shape[1]), np.float32)])
                    np.maximum.at(pooled, [i for i, _ in pieces[a:b]], net.pool(rows, at, np.array([len(ws) for ws in words], np.int64), goes_on[a:b]))
                score = net.probability(pooled)
            threshold = np.array([(net.thresholds if net else {}).get(x, 0.5) for x in languages])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(threshold, pa.float64()), pa.array(score >= threshold)], ["doc_id", "score", "predicted", "threshold", "flagged"])

    return df.select(F.col("doc_id").cast("long"), "text", "lang").mapInArrow(run, "doc_id long, score double, predicted int, threshold double, flagged boolean")
