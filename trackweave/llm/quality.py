"""Quality rules: gradient-boosted trees over document statistics, scored from flat numpy node arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import text_bytes

#: Counted symbols (fixed values of the contract).
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = b"0123456789"
CONTINUATION = bytes(range(0x80, 0xC0))

#: Features of the trees; the sign of a monotonic constraint on the chance of good quality, 0 for none.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_rate": -1, "dup_line_share": -1, "repeat_share": -1, "upper_rate": 0,
    "digit_rate": 0, "bang_rate": 0, "bar_rate": -1, "distinct_share": 0, "words_per_line": 0, "stop_rate": 0,
}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SCHEMA = ", ".join(f"{c} long" for c in STATS) + ", features array<float>"


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of width words that occur twice or more in the text, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.uint64, len(words))
    if len(number) == len(words):
        return 0
    key = np.zeros(n, np.uint64)
    for k in range(width):  # exact pairs would need 8 numbers; 64 mixed bits tell windows of one text apart
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + ids[k : k + n] * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines with a word."""
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines)), len(lines)


def document_stats(text: bytes) -> tuple[list[int], list[float]]:
    words = text.split()
    n = len(words)
    chars = len(text) - _count(text, SPACE) - _count(text, CONTINUATION)
    symbols, (dup, lines), repeat = _count(text, SYMBOLS), duplicate_lines(text), repeated_words(words)
    size = max(len(text), 1)
    features = [np.log1p(n), chars / max(n, 1), symbols / size, dup / max(lines, 1), repeat / max(n, 1), _count(text, UPPER) / max(_count(text, LETTERS), 1), _count(text, DIGITS) / size, text.count(b"!") / max(n, 1), text.count(b" | ") / max(n, 1), len(set(words)) / max(n, 1), np.log1p(n / max(lines, 1)), sum(len(w) <= 3 for w in words) / max(n, 1)]
    return [n, chars, symbols, dup, repeat], features


@dataclass(frozen=True)
class Trees:
    """All trees in one set of arrays; a leaf points to itself. score() goes one level down for all rows and trees at once."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float
    threshold: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], *, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: int = 5, keep_good: float = 0.998) -> Trees:
    """Boosted trees for logistic loss on histograms.

    signs: -1 or 1 lets the score only fall or rise with that feature. A split
    that breaks the order of its sides is passed over, and both sides are held
    to their middle further down. The threshold keeps at least keep_good of the
    rows labelled good and never exceeds 0.5.
    """
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    score = np.full(len(y), base)
    nodes: list[list[float]] = []  # feature, cut, left, right, value
    roots = []

    def leaf(g: float, h: float, lo: float, hi: float) -> float:
        return float(np.clip(-g / (h + l2), lo, hi))

    def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, level: int, lo: float, hi: float) -> int:
        me = len(nodes)
        g, h = grad[rows].sum(), hess[rows].sum()
        nodes.append([0, 0.0, me, me, rate * leaf(g, h, lo, hi)])
        best = (1e-6, -1, 0, 0.0)
        if level < depth and len(rows) >= 2 * least:
            for f in range(x.shape[1]):
                if not len(edges[f]):
                    continue
                b, k = binned[rows, f], len(edges[f]) + 1
                gl, hl, nl = (np.cumsum(np.bincount(b, w, k))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
                vl, vr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-(g - gl) / (h - hl + l2), lo, hi)
                gain = -(gl * vl + (hl + l2) * vl**2 / 2 + (g - gl) * vr + (h - hl + l2) * vr**2 / 2) - g**2 / (h + l2) / 2
                gain[(nl < least) | (len(rows) - nl < least) | (signs[f] * (vr - vl) < 0)] = -1
                if gain.max() > best[0]:
                    j = int(gain.argmax())
                    best = (gain[j], f, j, (vl[j] + vr[j]) / 2)
        if best[1] >= 0:
            _, f, j, middle = best
            go = binned[rows, f] <= j
            low, high = ((middle, hi), (lo, middle)) if signs[f] < 0 else ((lo, middle), (middle, hi)) if signs[f] > 0 else ((lo, hi), (lo, hi))
            nodes[me][:2] = [f, edges[f][j]]
            nodes[me][2] = grow(rows[go], grad, hess, level + 1, *low)
            nodes[me][3] = grow(rows[~go], grad, hess, level + 1, *high)
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        tree = _flat(nodes, [first], depth, 0.0)
        score = score + tree.value[_leaf_of(tree, x)]
    out = _flat(nodes, roots, depth, base)
    good = out.score(x)[y == 1]
    return Trees(**{**out.__dict__, "threshold": float(min(0.5, np.quantile(good, 1 - keep_good)))})


def _flat(nodes: list[list[float]], roots: list[int], depth: int, base: float) -> Trees:
    a = np.array(nodes, float)
    return Trees(a[:, 0].astype(np.int32), a[:, 1], a[:, 2].astype(np.int32), a[:, 3].astype(np.int32), a[:, 4], np.array(roots, np.int32), depth, base)


def _leaf_of(tree: Trees, x: np.ndarray) -> np.ndarray:
    at = np.full(len(x), tree.roots[0])
    for _ in range(tree.depth):
        at = np.where(x[np.arange(len(x)), tree.feature[at]] <= tree.cut[at], tree.left[at], tree.right[at])
    return at


def with_stats(df: DataFrame, text_column: str = "text") -> DataFrame:
    """df with the statistics of its texts appended (columns STATS and features) by one Arrow pass; null text has no words."""
    at = df.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [document_stats(t) for t in text_bytes(batch.column(at))]
            stats = np.array([g[0] for g in got], np.int64).reshape(-1, len(STATS))
            columns = [*batch.columns, *(pa.array(stats[:, i]) for i in range(len(STATS))), pa.array([g[1] for g in got], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *STATS, "features"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{own}, {_SCHEMA}")


def fit_quality(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, **options) -> Trees | None:
    """Fit on at most max_rows labelled documents, those first by a hash of their ids; None without labels of both kinds.

    The sample is drawn from the labels alone, so joining it to the documents
    broadcasts at most max_rows pairs of numbers; the statistics of at most
    max_rows documents, not texts, reach the driver. Labels and documents
    without an id, and labels without a value, teach nothing; null and empty
    texts count as texts without words; further columns are ignored.
    """
    picked = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # repeated ids bring more rows than were picked: bounded again, without the texts
    got = with_stats(sample).select("doc_id", "quality", "features").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "features").limit(max_rows).toPandas().sort_values(["doc_id", "quality"])
    y = got["quality"].to_numpy(float)
    if len(set(y)) < 2:
        return None
    return fit_trees(np.array(got["features"].tolist(), np.float64), y, list(FEATURES.values()), **options)


def _verdict(got: list[tuple[list[int], list[float]]], trees: Trees | None, least_words: int, most_repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, repeat = (np.array([g[0][i] for g in got], np.int64) for i in (0, 4))
    failed = (n < least_words) | (100 * repeat > most_repeat * n)
    score = trees.score(np.array([g[1] for g in got], np.float32).astype(np.float64)) if trees else np.ones(len(n))
    return failed, ~failed & (score >= (trees.threshold if trees else 0)), score


def quality_rules(docs: DataFrame, trees: Trees | None, *, least_words: int = 20, most_repeat: int = 30) -> DataFrame:
    """Per document: doc_id, STATS, base_failed, kept and quality_score.

    base_failed: fewer than least_words words, or over most_repeat percent of
    them in repeated windows. kept: not base_failed and a score of at least the
    trees' threshold; without trees the base rules alone decide. A null or
    empty text has no words and fails. Rows with null or repeated ids are
    judged one by one; an empty table gives an empty result; further columns
    of docs are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [document_stats(t) for t in text_bytes(batch.column(1))]
            if not got:
                continue
            stats = np.array([g[0] for g in got], np.int64)
            failed, kept, score = _verdict(got, trees, least_words, most_repeat)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(stats[:, i]) for i in range(len(STATS))), pa.array(failed), pa.array(kept), pa.array(score)], ["doc_id", *STATS, "base_failed", "kept", "quality_score"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in STATS) + ", base_failed boolean, kept boolean, quality_score double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def keep_quality(docs: DataFrame, trees: Trees | None, *, least_words: int = 20, most_repeat: int = 30) -> DataFrame:
    """The rows of docs that quality_rules keeps, whole: rows are dropped inside the Arrow pass, so texts are not joined back.

    Null and empty texts go, repeated rows and null ids are judged by their own
    text; further columns stay; an empty table gives an empty one.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [document_stats(t) for t in text_bytes(batch.column(at))]
            if got:
                yield batch.filter(pa.array(_verdict(got, trees, least_words, most_repeat)[1]))

    return docs.mapInArrow(run, docs.schema)
