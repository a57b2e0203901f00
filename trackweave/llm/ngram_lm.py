"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays and memory-mapped by workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import WordTable, byte_groups, lower_ascii, scratch, sums_by_run, text_bytes, written

#: The end token; no word holds a space, so none equals it.
END = b" end"
#: Odd multiplier that spreads pairs of ids over 64 bits, and its inverse: the hash of a pair is exact.
SPREAD = 0x9E3779B97F4A7C15
GATHER = pow(SPREAD, -1, 1 << 64)
RUN = "shard int, kind int, keys binary, counts binary"
_MAPPED: dict[str, np.ndarray] = {}


def save_array(uri: str, values: np.ndarray) -> None:
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    with system.open_output_stream(path) as out:
        np.lib.format.write_array(out, np.ascontiguousarray(values))


def map_array(uri: str) -> np.ndarray:
    """A stored array, memory-mapped; from a store without local paths it is copied to an unlinked local file first."""
    if uri not in _MAPPED:
        if _MAPPED and not _same_model(uri):
            _MAPPED.clear()  # another model's arrays
        system, path = fs.FileSystem.from_uri(uri)
        if isinstance(system, fs.LocalFileSystem):
            _MAPPED[uri] = np.load(path, mmap_mode="r")
        else:
            with tempfile.NamedTemporaryFile(suffix=".npy") as local:
                with system.open_input_stream(path) as stored:
                    while block := stored.read(1 << 22):
                        local.write(block)
                local.flush()
                _MAPPED[uri] = np.load(local.name, mmap_mode="r")
    return _MAPPED[uri]


def _same_model(uri: str) -> bool:
    """Whether the arrays mapped so far lie in the folder of the model that uri belongs to."""
    return any(uri.startswith(root) for root in {u.split("/lm-")[0] + "/lm-" + u.split("/lm-")[1].split("/")[0] for u in _MAPPED if "/lm-" in u})


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of the hash, so sorted hashes lie in sorted shards."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def runs_by_shard(keys: np.ndarray, counts: np.ndarray, shards: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    """Packed runs: a row for each shard with its part of the sorted keys and counts."""
    cuts = np.append(np.flatnonzero(np.append(True, shards[1:] != shards[:-1])), len(keys)) if len(keys) else np.zeros(1, int)
    pieces = [(int(shards[a]), kind, keys[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
    columns = list(zip(*pieces)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["shard", "kind", "keys", "counts"])


def joined(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


@dataclass
class KneserNey:
    """Where the arrays lie, and the model's few numbers.

    Words are numbered by their place in the sorted hash array. The lower
    order counts left contexts; discounts for counts 1, 2 and over follow the
    counts of counts. Arrays by id: left contexts and how many right contexts
    occur once, twice and more.
    """

    folder: str
    words: list[str] = field(default_factory=list)
    first_id: list[int] = field(default_factory=list)
    by_id: list[str] = field(default_factory=list)
    pairs: list[str] = field(default_factory=list)
    tokens: int = 0
    distinct: int = 0
    texts: int = 0
    left_total: int = 0
    left_of: list[int] = field(default_factory=lambda: [0] * 5)
    pair_of: list[int] = field(default_factory=lambda: [0] * 5)
    #: Ids of one array by id.
    span: int = 1

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of hashed words; -1 and 0 where unknown."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        order = np.argsort(hashes)
        for s, rows in _by_shard(hashes[order], order, len(self.words)):
            if self.words[s]:
                keys = map_array(self.words[s] + "/keys.npy")
                at = np.minimum(np.searchsorted(keys, hashes[rows]), len(keys) - 1)
                hit = keys[at] == hashes[rows]
                ids[rows[hit]] = self.first_id[s] + at[hit]
                counts[rows[hit]] = map_array(self.words[s] + "/counts.npy")[at[hit]]
        return ids, counts

    def of_ids(self, ids: np.ndarray) -> np.ndarray:
        """Rows (left contexts, right contexts seen once, twice, more)."""
        out = np.zeros((len(ids), 4), np.int64)
        part = ids // self.span
        for s in np.unique(part[ids >= 0]):
            out[part == s] = map_array(self.by_id[s])[ids[part == s] - s * self.span]
        return out

    def pair_counts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.zeros(len(first), np.int64)
        known = np.flatnonzero((first >= 0) & (second >= 0))
        keys, back = np.unique(pair_hash(first[known], second[known]), return_inverse=True)
        found = np.zeros(len(keys), np.int64)
        for s, rows in _by_shard(keys, np.arange(len(keys)), len(self.pairs)):
            if self.pairs[s]:
                stored = map_array(self.pairs[s] + "/keys.npy")
                at = np.minimum(np.searchsorted(stored, keys[rows]), len(stored) - 1)
                hit = stored[at] == keys[rows]
                found[rows[hit]] = map_array(self.pairs[s] + "/counts.npy")[at[hit]]
        out[known] = found[back]
        return out

    def word_rows(self, words: list[bytes]) -> np.ndarray:
        """Per word: id, count, lower-order probability, weight that its context leaves to the lower order."""
        ids, counts = self.find(word_hashes(words))
        by_id = self.of_ids(ids)
        d = discounts(self.left_of)
        left_total = max(1, self.left_total)
        n1, n2 = self.left_of[1], self.left_of[2]
        rest = d[1] * n1 + d[2] * n2 + d[3] * (self.distinct - n1 - n2)
        lower = np.maximum(by_id[:, 0] - d[np.minimum(by_id[:, 0], 3)], 0) / left_total + (rest / left_total if self.left_total else 1.0) / (self.distinct + 1)
        return np.stack([ids, counts, lower, self.kept_back(by_id, counts)], axis=1).astype(np.float64)

    def kept_back(self, by_id: np.ndarray, totals: np.ndarray) -> np.ndarray:
        d = discounts(self.pair_of)
        seen = by_id[:, 1:].sum(axis=1) > 0
        return np.where(seen, (by_id[:, 1:] @ d[1:]) / np.maximum(totals, 1), 1.0)


def _by_shard(sorted_hashes: np.ndarray, order: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    part = shard_of(sorted_hashes, shards)
    cuts = np.searchsorted(part, np.arange(shards + 1))
    for s in range(shards):
        if cuts[s] < cuts[s + 1]:
            yield s, order[cuts[s] : cuts[s + 1]]


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return ((first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)) * np.uint64(SPREAD)


def discounts(of: list[int]) -> np.ndarray:
    """Amounts taken from counts 0, 1, 2 and 3 or more; fixed ones where a count of counts is zero."""
    if min(of[1:5]) == 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = of[1] / (of[1] + 2 * of[2])
    return np.array([0.0, *(float(np.clip(k - (k + 1) * y * of[k + 1] / of[k], 0.01, k)) for k in (1, 2, 3))])


def fit_kneser_ney(docs: DataFrame, *, text_column: str = "text", shards: int | None = None, run_keys: int = 1 << 21, shard_bytes: int = 64 << 20) -> KneserNey:
    """Count words and pairs of the whole texts of docs and write the model's arrays to the shared folder.

    Each task counts up to run_keys keys at a time and passes on sorted packed
    runs, one row for each shard; shards (as many as shuffle partitions unless
    given, and one for each shard_bytes of text at least) are equal ranges of
    a hash, so no frequent word makes a large one, and each is merged by one
    task that holds about as many bytes of runs. The driver sees a row for each
    shard. Ids have 32 bits: over 2^32 distinct words are an error. Null and
    empty texts count as an end token alone, repeated rows as often as they
    stand; an empty table gives a model that knows nothing.
    """
    spark = docs.sparkSession
    if not shards:
        size = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
        shards = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    model = KneserNey(scratch(spark, "lm"), words=[""] * shards, first_id=[0] * shards, pairs=[""] * shards)
    texts = docs.select(F.col(text_column).alias("text"))
    folder = model.folder

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            keys, counts = summed(word_hashes(list(seen)), np.fromiter(seen.values(), np.int64))
            seen.clear()
            return runs_by_shard(keys, counts, shard_of(keys, shards))

        for batch in batches:
            for text in text_bytes(batch.column(0)):
                seen.update(lower_ascii(text).split())
                seen[END] += 1
                if len(seen) > run_keys // 4:
                    yield flush()
        yield flush()

    def merge_words(got: pa.Table) -> pa.Table:
        keys, counts = summed(joined(got["keys"], np.uint64), joined(got["counts"], np.int64))
        path = f"{folder}/words-{uuid.uuid4().hex}"
        save_array(path + "/keys.npy", keys)
        save_array(path + "/counts.npy", counts)
        return pa.table({"shard": got["shard"][:1], "path": [path], "rows": [len(keys)], "total": [int(counts.sum())]})

    for r in texts.mapInArrow(count_words, RUN).groupBy("shard").applyInArrow(merge_words, "shard int, path string, rows long, total long").collect():
        model.words[r["shard"]] = r["path"]
        model.first_id[r["shard"]] = r["rows"]
        model.tokens += r["total"]
    rows = list(model.first_id)
    model.distinct = sum(rows)
    if model.distinct >= (1 << 32) - 1:
        raise ValueError("over 2^32 distinct words")
    model.first_id = [sum(rows[:s]) for s in range(shards)]
    model.texts = int(model.find(word_hashes([END]))[1][0])
    model.span = -(-(model.distinct + 1) // shards)
    start = model.distinct  # the id of the place before a text
    frozen = KneserNey(**model.__dict__)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(lambda words: frozen.find(word_hashes(words))[0])
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = summed(np.concatenate(held) if held else np.zeros(0, np.uint64))
            return runs_by_shard(keys, counts.astype(np.uint32), shard_of(keys, shards))

        for batch in batches:
            docs = text_bytes(batch.column(0))
            for a, b in byte_groups([len(t) for t in docs], 4 << 20):
                words = [[*lower_ascii(t).split(), END] for t in docs[a:b]]
                at = table.lookup([w for ws in words for w in ws])
                second = table.rows[at]
                first = np.concatenate([[start], second[:-1]])
                first[np.cumsum([0, *map(len, words[:-1])])] = start
                held.append(pair_hash(first, second))
                size += len(second)
                if size > run_keys:
                    yield flush()
                    held, size = [], 0
        yield flush()

    def merge_pairs(got: pa.Table) -> pa.Table:
        keys, counts = summed(joined(got["keys"], np.uint64), joined(got["counts"], np.uint32).astype(np.int64))
        path = f"{folder}/pairs-{uuid.uuid4().hex}"
        save_array(path + "/keys.npy", keys)
        save_array(path + "/counts.npy", counts.astype(np.uint32) if not len(counts) or counts.max() < 1 << 32 else counts)
        pair = keys * np.uint64(GATHER)
        first, second = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # words that occur once have one left and one right context: merge_ids knows those
        once = lambda ids: np.where(ids < start, frozen_counts(frozen, np.minimum(ids, max(start - 1, 0))), 2) == 1
        out = []
        left, n = summed(second[~once(second)])
        out.append(_id_runs(left, n[:, None], 0, frozen.span))
        more = ~once(first)
        right, at = np.unique(first[more], return_inverse=True)
        kinds = np.zeros((len(right), 3), np.int64)
        np.add.at(kinds, (at, np.minimum(counts[more], 3) - 1), 1)
        out.append(_id_runs(right, kinds, 1, frozen.span))
        of = [int((counts == k).sum()) for k in range(5)]
        head = pa.RecordBatch.from_arrays([got["shard"][:1].combine_chunks(), pa.array([2], pa.int32()), pa.array([path.encode()], pa.binary()), pa.array([np.array(of, np.int64).tobytes()], pa.binary())], ["shard", "kind", "keys", "counts"])
        return pa.Table.from_batches([head, *out])

    merged = written(texts.mapInArrow(count_pairs, RUN).groupBy("shard").applyInArrow(merge_pairs, RUN), "lm-pairs")
    for r in merged.where("kind = 2").collect():
        model.pairs[r["shard"]] = bytes(r["keys"]).decode()
        model.pair_of = [a + int(b) for a, b in zip(model.pair_of, np.frombuffer(r["counts"], np.int64))]

    def merge_ids(got: pa.Table) -> pa.Table:
        shard = got["shard"][0].as_py()
        low, high = shard * frozen.span, min((shard + 1) * frozen.span, start + 1)
        out = np.zeros((high - low, 4), np.int64)
        ids = np.arange(low, high)
        out[(ids < start) & (frozen_counts(frozen, np.minimum(ids, max(start - 1, 0))) == 1)] = [1, 1, 0, 0]
        for kind, keys, counts in zip(got["kind"].to_pylist(), got["keys"].to_pylist(), got["counts"].to_pylist()):
            if keys is not None and len(keys):
                at = np.frombuffer(keys, np.uint32).astype(np.int64) - low
                if kind == 0:
                    out[at, 0] += np.frombuffer(counts, np.uint32)
                else:
                    out[at, 1:] += np.frombuffer(counts, np.uint32).reshape(3, -1).T
        path = f"{folder}/ids-{uuid.uuid4().hex}.npy"
        save_array(path, out.astype(np.uint32))
        left = out[:, 0]
        return pa.table({"shard": pa.array([shard], pa.int32()), "path": [path], "left": [int(left.sum())], "of": [[int((left == k).sum()) for k in range(5)]]})

    # every shard of ids is built, also those that only words that occur once belong to
    parts = spark.range(-(-(start + 1) // model.span)).select(F.col("id").cast("int").alias("shard"), F.lit(3).alias("kind"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("counts"))
    model.by_id = [""] * -(-(start + 1) // model.span)
    for r in merged.where("kind < 2").union(parts).groupBy("shard").applyInArrow(merge_ids, "shard int, path string, left long, of array<long>").collect():
        model.by_id[r["shard"]] = r["path"]
        model.left_total += r["left"]
        model.left_of = [a + b for a, b in zip(model.left_of, r["of"])]
    return model


def frozen_counts(model: KneserNey, ids: np.ndarray) -> np.ndarray:
    """Counts of words by id; ids may be in any order."""
    out = np.zeros(len(ids), np.int64)
    part = np.searchsorted(model.first_id, ids, side="right") - 1
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(len(model.words) + 1))
    for s in range(len(model.words)):
        rows = order[cuts[s] : cuts[s + 1]]
        if len(rows) and model.words[s]:
            out[rows] = map_array(model.words[s] + "/counts.npy")[ids[rows] - model.first_id[s]]
    return out


def _id_runs(ids: np.ndarray, counts: np.ndarray, kind: int, span: int) -> pa.RecordBatch:
    part = (ids // span).astype(np.int32)
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(ids)) if len(ids) else np.zeros(1, int)
    pieces = [(int(part[a]), kind, ids[a:b].astype(np.uint32).tobytes(), np.ascontiguousarray(counts[a:b].T).astype(np.uint32).tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
    columns = list(zip(*pieces)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["shard", "kind", "keys", "counts"])


def score_texts(df: DataFrame, model: KneserNey, *, id_column: str = "doc_id", text_column: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """Per row of df: id, n_tokens, n_known, base_score, score, perplexity.

    Tokens are the lower-cased words and one end. base_score adds one to every
    word's count; score is the model's log10 probability, perplexity is
    10^(-score / n_tokens). An unknown word takes the lower order's share for
    words never seen. Null texts count as empty (the end alone); null and
    repeated ids are scored row by row; an empty table gives an empty result;
    further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(model.word_rows)
        d = discounts(model.pair_of)
        opening = model.of_ids(np.array([model.distinct]))
        opens = float(model.kept_back(opening, np.array([model.texts]))[0])
        scale = model.tokens + model.distinct + 1
        for batch in batches:
            docs = text_bytes(batch.column(1))
            out = []
            for a, b in byte_groups([len(t) for t in docs], batch_bytes):
                words = [[*lower_ascii(t).split(), END] for t in docs[a:b]]
                counts = np.array([len(ws) for ws in words])
                at = table.lookup([w for ws in words for w in ws])
                ids, seen, lower, left = table.rows[at].T
                heads = np.cumsum(counts) - counts
                before = np.concatenate([[0], ids[:-1]]).astype(np.int64)
                total, weight = np.concatenate([[0], seen[:-1]]), np.concatenate([[0], left[:-1]])
                before[heads], total[heads], weight[heads] = model.distinct, model.texts, opens
                pair = model.pair_counts(before, ids.astype(np.int64))
                chance = np.maximum(pair - d[np.minimum(pair, 3)], 0) / np.maximum(total, 1) + weight * lower
                known = (seen > 0).astype(np.int64)
                out.append((counts, sums_by_run(known, counts), sums_by_run(np.log10((seen + 1) / scale), counts), sums_by_run(np.log10(chance), counts)))
            n, known, base, score = (np.concatenate(x) for x in zip(*out)) if out else ([], [], [], [])
            n, score = np.asarray(n, np.int64), np.asarray(score, np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(np.asarray(known, np.int64)), pa.array(np.asarray(base, np.float64)), pa.array(score), pa.array(10.0 ** np.minimum(-score / np.maximum(n, 1), 300))], ["id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    kind = df.schema[id_column].dataType.simpleString()
    out = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double")
    return out.withColumnRenamed("id", id_column)
