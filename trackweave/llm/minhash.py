"""MinHash near-duplicates: banded candidates, pruned by a sequential Bayesian test, survivors compared in full."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import byte_groups, hash_filter, lower_ascii, text_bytes, written
from trackweave.llm.simhash import components

BANDS, ROWS, STEP = 30, 5, 16
#: Hashes of which one byte each is kept for the Bayesian test.
KEPT = 128


def shingle_set(text: bytes, width: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the width-word shingles; of fewer words the whole sequence, of none nothing."""
    words = lower_ascii(text).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line)], np.uint64)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = end - np.fromiter(map(len, words), np.int64, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b]) for a, b in zip(start[: 1 - width].tolist(), end[width - 1 :].tolist())], np.uint64))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(12)
    return rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64), rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray, block: int = 1 << 13) -> np.ndarray:
    """The smallest value of each hash function over the set, as 32-bit numbers."""
    flip, odd = _MULTIPLIERS
    low = np.full(len(flip), 0xFFFFFFFF, np.uint64)
    for a in range(0, len(hashes), block):
        low = np.minimum(low, (((hashes[a : a + block, None] ^ flip) * odd) >> np.uint64(32)).min(axis=0))
    return low.astype(np.uint32)


_MULTIPLIERS = _multipliers()


def least_matches(threshold: float, miss: float, kept: int = KEPT, step: int = STEP) -> list[int]:
    """After each batch of step hashes, the least number of matches with which a pair goes on.

    Under a uniform prior the similarity after m of k matches is
    Beta(m + 1, k - m + 1), whose tail above the threshold is a binomial sum:
    P(J >= t) = P(Binomial(k + 1, t) <= m). A pair is pruned where that is below miss.
    """
    out = []
    for k in range(step, kept + 1, step):
        tail, m = 0.0, 0
        while True:
            tail += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


class _Forest:
    """Union-find over the rows of one group; labels give rows that are already joined."""

    def __init__(self, joined: np.ndarray):
        _, self.root = np.unique(joined, return_inverse=True)
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            if self.root[i] != self.root[j]:
                self.links.append((i, j))
                self.root[self.root == self.root[j]] = self.root[i]


def likely(signatures: list[bytes], joined: np.ndarray, least: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that the Bayesian test doesn't prune: batch by batch of signature bytes, a row against all later ones not joined to it yet."""
    sig = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), -1)
    forest = _Forest(joined)
    for i in range(len(sig) - 1):
        rest = i + 1 + np.flatnonzero(forest.root[i + 1 :] != forest.root[i])
        same = np.zeros(len(rest), np.int64)
        for b, m in enumerate(least):
            if not len(rest):
                break
            same += (sig[rest, STEP * b : STEP * b + STEP] == sig[i, STEP * b : STEP * b + STEP]).sum(axis=1)
            rest, same = rest[same >= m], same[same >= m]
        forest.join(i, rest)
    return forest.links


def verified(texts: list[bytes], joined: np.ndarray, percent: int, width: int, columns: int = 4096) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * |A and B| >= percent * |A or B|, by their full shingle sets.

    Intersections of all pairs are a product of the 0/1 matrix of rows and
    shingles with itself, made of so many columns at a time; shingles that one
    row alone has are left out.
    """
    sets = [shingle_set(t, width) for t in texts]
    size = np.array([len(s) for s in sets])
    _, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    row, at = row[df[at] > 1], at[df[at] > 1]
    if not len(at):
        return []
    at = np.unique(at, return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    row, at, shared = row[order], at[order], np.zeros((len(sets), len(sets)), np.int64)
    for a in range(0, int(at[-1]) + 1, columns):
        low, high = np.searchsorted(at, [a, a + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[row[low:high], at[low:high] - a] = 1
        shared += (part @ part.T).astype(np.int64)
    link = np.triu(100 * shared >= percent * (size[:, None] + size - shared), 1)
    forest = _Forest(joined)
    for i in np.flatnonzero(link.any(axis=1)).tolist():
        forest.join(i, np.flatnonzero(link[i]))
    return forest.links


def in_groups(rows: DataFrame, payload: str, compare: Callable[[list[bytes], np.ndarray], list[tuple[int, int]]]) -> DataFrame:
    """Links (a, b) that compare finds in each group; rows: group, chunk, node, joined, payload (binary).

    Groups are read as a sorted stream and held one at a time; a node that
    stands twice in one counts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        links: list[tuple[int, int]] = []

        def close() -> None:
            if len(held) > 1:
                node = [h[2] for h in held]
                links.extend((node[i], node[j]) for i, j in compare([h[4] for h in held], np.array([h[3] for h in held])))
            held.clear()

        for batch in batches:
            for got in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:2] != got[:2]:
                    close()
                if not held or held[-1][2] != got[2]:
                    held.append(got)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in links], pa.int64()), pa.array([max(p) for p in links], pa.int64())], ["a", "b"])
                links.clear()
        close()
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in links], pa.int64()), pa.array([max(p) for p in links], pa.int64())], ["a", "b"])

    sorted_rows = rows.select("group", "chunk", "node", "joined", F.col(payload).cast("binary").alias("payload"))
    return sorted_rows.repartition("group", "chunk").sortWithinPartitions("group", "chunk", "node").mapInArrow(run, "a long, b long")


def group_links(members: DataFrame, payload: str, attach: Callable[[DataFrame], DataFrame], compare: Callable, *, rows: int, weight: int) -> DataFrame:
    """Links that connect each group of members (group, node, weight) as all its linked pairs would.

    A group of over `rows` members, or of more weight than `weight`, is divided
    into chunks by a hash. First each chunk is compared within, together with
    the group's smallest node, which takes a group of like texts together
    without its pairs. Only groups that this leaves in pieces have each pair of
    chunks compared as a group of its own, with what is joined already left
    out; so no pair is lost and no task holds more than two chunks.
    """
    sizes = members.groupBy("group").agg(F.count("*").alias("n"), F.sum("weight").alias("all"), F.min("node").alias("hub")).where("n > 1")
    parts = F.when((F.col("n") <= rows) & (F.col("all") <= weight), 1).otherwise(F.greatest(F.ceil(2 * F.col("n") / rows), F.ceil(2 * F.col("all") / weight)))
    placed = members.select("group", "node").join(sizes.select("group", "hub", parts.cast("int").alias("parts")), "group")
    placed = written(placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("long")), "groups")
    first = placed.withColumn("chunk", F.explode(F.when((F.col("parts") > 1) & (F.col("node") == F.col("hub")), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array("own"))))
    links = written(in_groups(attach(first.withColumn("joined", F.col("node"))), payload, compare).distinct(), "links")
    large = placed.where("parts > 1")
    if large.isEmpty():
        return links
    large = written(large.join(components(links).withColumnRenamed("root", "joined"), "node", "left").withColumn("joined", F.coalesce("joined", "node")), "large-groups")
    open_groups = large.groupBy("group").agg(F.min("joined").alias("low"), F.max("joined").alias("high")).where("low < high").select("group")
    pairs = large.join(open_groups, "group").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pairs = pairs.withColumn("chunk", F.least("own", "other") * F.col("parts") + F.greatest("own", "other"))
    return links.union(written(in_groups(attach(pairs), payload, compare).distinct(), "links"))


def signatures(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4) -> DataFrame:
    """(id, hash of the text, n, node, bytes, bands) for each row: node is the hash of the shingle set, null if it is empty."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(2))
            for a, b in byte_groups([len(t) for t in texts], 1 << 22):
                n, node, low, bands = [], [], [], []
                for text in texts[a:b]:
                    hashes = shingle_set(text, width)
                    n.append(len(hashes))
                    if not len(hashes):
                        node.append(None), low.append(None), bands.append(None)
                        continue
                    sig = signature(hashes)
                    node.append(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 1)).astype(np.int64).item())
                    low.append(sig[:KEPT].astype(np.uint8).tobytes())
                    bands.append([np.uint64(xxhash.xxh64_intdigest(sig[ROWS * k : ROWS * k + ROWS].tobytes(), k)).astype(np.int64).item() for k in range(BANDS)])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(low, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "text_hash", "n", "node", "low", "bands"])

    rows = df.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, text_hash long, n long, node long, low binary, bands array<long>")


def minhash_components(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", percent: int = 80, width: int = 4, miss: float = 1e-6, rows: int = 512, weight: int = 2_000_000) -> DataFrame:
    """Per row of df: id, n_shingles, component_id (smallest id reachable over links), kept (the id is the component's).

    Texts link whose sets of distinct width-word shingles have
    100 * |A and B| >= percent * |A or B|. Texts with one set count once. A
    pair meets in a bucket of equal bands (30 of 5 hashes: a pair of similarity
    0.8 misses all with probability 7e-6, and 7e-8 at 0.85); inside buckets it is
    dropped once its similarity reaches the threshold with probability below
    miss; what is left links classes, and within a class all pairs are compared
    by full sets. Sets are compared by 64-bit hashes.

    Null, empty and blank texts have no set and link with nothing. Rows with a
    null id get their component's smallest id, null if it has none, and
    aren't kept; repeated rows stay. Rows without a set are components by
    themselves, by id. An empty table gives an empty result; further columns
    are ignored.
    """
    all_rows = written(signatures(df, id_column, text_column, width), "signatures")
    texts = all_rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.min(F.struct("id", "text_hash", "n", "low", "bands")).alias("one"))
    texts = written(texts.select("node", "least", "one.*"), "shingle-sets")
    least = least_matches(percent / 100, miss)
    banded = texts.select("node", F.explode("bands").alias("group"), F.lit(1).alias("weight"))
    near = group_links(banded, "low", lambda placed: placed.join(texts.select("node", "low"), "node"), lambda sigs, joined: likely(sigs, joined, least), rows=4096, weight=1 << 40)
    classes = components(near)
    members = written(classes.join(texts.select("node", "id", "text_hash", "n"), "node").select("node", F.col("root").alias("group"), F.col("n").alias("weight"), "id", "text_hash"), "classes")
    docs = df.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("text"))
    may_hold = hash_filter(members.select("text_hash"))
    if may_hold:  # most texts are in no class: their words needn't be shuffled
        docs = docs.where(may_hold("text_hash"))

    def with_texts(placed: DataFrame) -> DataFrame:
        own = members.select("node", F.col("id").alias("rep"), "text_hash").join(placed, "node")
        return docs.join(own, (docs["id"].eqNullSafe(own["rep"])) & (docs["text_hash"] == own["text_hash"])).select("group", "chunk", "node", "joined", "text")

    links = group_links(members.select("group", "node", "weight"), "text", with_texts, lambda got, joined: verified(got, joined, percent, width), rows=rows, weight=weight)
    root = texts.select("node", "least").join(components(links), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    smallest = root.groupBy("root").agg(F.min("least").alias("component"))
    out = all_rows.select("id", "n", "node").join(root.join(smallest, "root").select("node", "component"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
