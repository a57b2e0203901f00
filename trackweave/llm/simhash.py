"""SimHash near-duplicates: bit planes stored vertically, distances counted by carry-save bitwise counters."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import byte_groups, lower_ascii, text_bytes, written

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
ONE = np.uint64(1)


def _shingle_hashes(text: bytes, width: int, seed: int) -> list[int]:
    words = lower_ascii(text).split()
    if not words:
        return []
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(line, seed)]
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    return [digest(line[a:b], seed) for a, b in zip(start[: 1 - width].tolist(), end[width - 1 :].tolist())]


def simhash64(texts: list[bytes], width: int = 4, seed: int = 42) -> np.ndarray:
    """Fingerprints: a bit is set where over half the shingle hashes have it; zero without words."""
    out = np.zeros(len(texts), np.uint64)
    for a, b in byte_groups([len(t) for t in texts], 1 << 20):
        hashes = [_shingle_hashes(t, width, seed) for t in texts[a:b]]
        counts = np.array([len(h) for h in hashes])
        have = np.flatnonzero(counts)
        if not len(have):
            continue
        flat = np.array([x for h in hashes for x in h], "<u8")
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate([[0], np.cumsum(counts[have])[:-1]])
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        out[a + have] = np.packbits(2 * sums > counts[have][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def bit_planes(codes: np.ndarray) -> np.ndarray:
    """planes[k, t]: bit k of the 64 codes of tile t, one code to a bit."""
    tiles = -(-len(codes) // 64)
    padded = np.zeros(tiles * 64, "<u8")
    padded[: len(codes)] = codes
    bits = np.unpackbits(padded.view(np.uint8).reshape(tiles, 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]


def links_in_groups(codes: np.ndarray, ends: np.ndarray, radius: int = 4, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j), i < j, of a spanning forest of all pairs in the same group with at most radius differing bits.

    ends[i] is where the group of row i ends (groups are consecutive). Each
    query row meets the tiles of 64 rows that its group reaches; a plane at a
    time, its differing bits enter three-bit carry-save counters with a sticky
    overflow, and queries whose lanes all exceed the radius (below 7) are left.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    planes, root = bit_planes(codes), np.arange(n)
    first, last = np.arange(n) // 64, (ends - 1) // 64
    per = np.where(ends - np.arange(n) > 1, last - first + 1, 0)
    found: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in byte_groups(per.tolist(), block):
        row = np.repeat(np.arange(a, b), per[a:b])
        if not len(row):
            continue
        tile = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(per[a:b]) - per[a:b], per[a:b])
        # lanes above the row itself and below the end of its group
        low, high = np.clip(row + 1 - 64 * tile, 0, 64), np.clip(ends[row] - 64 * tile, 0, 64)
        below = lambda x: np.where(x >= 64, ALL, (ONE << np.minimum(x, 63).astype(np.uint64)) - ONE)
        alive = below(high) & ~below(low)
        keep = alive != 0
        row, tile, alive = row[keep], tile[keep], alive[keep]
        ones, twos, fours, over = (np.zeros(len(row), np.uint64) for _ in range(4))
        query = codes[row]
        for k in range(64):
            x = planes[k][tile] ^ (np.uint64(0) - ((query >> np.uint64(k)) & ONE))
            carry = ones & x
            ones ^= x
            x = twos & carry
            twos ^= carry
            over |= fours & x
            fours ^= x
            if k % 8 == 7:
                alive &= ~(over | _exceeds(ones, twos, fours, radius))
                keep = alive != 0
                if not keep.any():
                    row = row[:0]
                    break
                if keep.mean() < 0.7:
                    row, tile, alive, query, ones, twos, fours, over = (v[keep] for v in (row, tile, alive, query, ones, twos, fours, over))
        if not len(row):
            continue
        lanes = np.unpackbits(alive.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, lane = np.nonzero(lanes)
        i, j = row[at], 64 * tile[at] + lane
        while len(i):
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            for p, q in zip(i[:4096].tolist(), j[:4096].tolist()):
                p0, q0 = find(p), find(q)
                if p0 != q0:
                    root[max(p0, q0)] = min(p0, q0)
                    found.append((p, q))
            i, j = i[4096:], j[4096:]
            while not np.array_equal(root, up := root[root]):
                root[:] = up
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _exceeds(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count (0 to 7) is over the radius: a bitwise comparison with a constant."""
    over, same = np.zeros_like(ones), np.full_like(ones, ALL)
    for plane, bit in ((fours, radius & 4), (twos, radius & 2), (ones, radius & 1)):
        if bit:
            same &= plane
        else:
            over |= same & plane
            same &= ~plane
    return over


def block_keys(code: Column, radius: int, blocks: int) -> Column:
    """Array of bucket keys: two codes within the radius agree on at least blocks - radius blocks, so in one key at least."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [F.shiftrightunsigned(code, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in range(blocks)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(number).cast("long")
        for i in chosen:
            key = F.shiftleft(key, cuts[i + 1] - cuts[i]).bitwiseOR(parts[i])
        keys.append(key)
    return F.array(*keys)


def blocks_for(codes: int, radius: int, chunk: int = 1024) -> int:
    """Blocks to cut a code into: so many that a bucket, in which all but radius of them agree, holds few of that many random codes."""
    blocks = radius + 2
    while codes > chunk << 64 * (blocks - radius) // blocks and blocks < 2 * radius + 2:
        blocks += 1
    return blocks


def near_pairs(codes: DataFrame, *, radius: int = 4, blocks: int | None = None, chunk: int = 1024) -> DataFrame:
    """Links (a, b), a < b, that connect all distinct codes (column code) as all pairs within the radius would.

    Codes meet in buckets of equal blocks; unless given, their number follows
    that of the codes, so that buckets don't grow with it. A bucket of over chunk codes is
    divided into chunks by a hash and each pair of chunks becomes a group of
    its own, so no task holds more than twice chunk codes of it; no pair is
    left out.
    """
    blocks = blocks or blocks_for(codes.count(), radius, chunk)
    keyed = codes.select("code", F.explode(block_keys(F.col("code"), radius, blocks)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # half as many codes as chunk to a chunk on average, as a hash fills them unevenly
    parts = F.ceil(F.col("n") / (chunk // 2)).cast("int")
    placed = keyed.join(sizes, "key").withColumn("parts", F.when(F.col("n") > chunk, parts).otherwise(1))
    own = F.pmod(F.xxhash64("code"), F.col("parts")).cast("int")
    placed = placed.withColumn("own", own)
    pair = F.when(F.col("parts") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, F.col("own")).cast("long") * F.col("parts") + F.greatest(o, F.col("own")))
    )
    groups = placed.select("code", "key", F.explode(pair).alias("pair"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for got in batches:
            got = got if held is None else pd.concat([held, got], ignore_index=True)
            key, pair = got["key"].to_numpy(), got["pair"].to_numpy()
            new = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
            if not len(new):
                held = got
                continue
            held = got.iloc[new[-1] :]
            yield linked(got["code"].to_numpy()[: new[-1]], new)
        if held is not None:
            yield linked(held["code"].to_numpy(), np.array([len(held)]))

    def linked(code: np.ndarray, stops: np.ndarray) -> pd.DataFrame:
        ends = np.repeat(stops, np.diff(np.concatenate([[0], stops])))
        i, j = links_in_groups(code.astype(np.int64).view(np.uint64), ends, radius)
        return pd.DataFrame({"a": np.minimum(code[i], code[j]), "b": np.maximum(code[i], code[j])})

    return groups.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInPandas(run, "a long, b long").distinct()


def components(links: DataFrame, most: int = 50) -> DataFrame:
    """(node, root) for every node of links (a, b): the smallest node of its connected component.

    Alternating large-star and small-star steps; each state is a table in the
    shared folder and only its row count and hash sum reach the driver.
    """
    links = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b"), "links")
    before = None
    for _ in range(most):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        links = written(small, "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, code): the SimHash of each text as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(simhash64(text_bytes(batch.column(1))).view(np.int64))], ["id", "code"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, code long")


def simhash_components(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", radius: int = 4, blocks: int | None = None) -> DataFrame:
    """Per row of df: id, fingerprint (16 hex digits) and component_id, the smallest id reachable over links.

    Texts link where their fingerprints differ in at most radius bits. Copies
    share a fingerprint and count once in the comparison. Null and empty texts
    have fingerprint zero and link like others. Rows with a null id get their
    component's smallest id, null if it has none; repeated rows stay. An empty
    table gives an empty result; further columns are ignored.
    """
    rows = written(fingerprints(df, id_column, text_column), "fingerprints")
    codes = written(rows.groupBy("code").agg(F.min("id").alias("least")), "codes")
    found = components(near_pairs(codes.select("code"), radius=radius, blocks=blocks))
    placed = codes.join(found, codes["code"] == found["node"], "left").select("code", "least", F.coalesce("root", "code").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_code = placed.join(smallest, "root").select("code", "component_id")
    out = rows.join(of_code, "code")
    return out.select(F.col("id").alias(id_column), F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, **options) -> DataFrame:
    """df with one document of each component: that with its smallest id, and of several texts with that id the one of the smallest hash.

    A text without an id stays only if no document with an id is in its
    component; of rows with equal ids and texts one stays.
    """
    key = F.xxhash64("text")
    rows = df.select(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", key.alias("key")).alias("doc_id"), "text")
    kept = simhash_components(rows, **options).where("doc_id = component_id").select("doc_id.doc_id", F.col("doc_id.key").alias("key")).distinct()
    # the row travels as one column, so that names of its columns can't clash
    whole = df.select(F.col("doc_id").alias("id"), key.alias("own"), F.struct(*(df[c] for c in df.columns)).alias("row"))
    found = whole.join(kept, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("key")), "left_semi")
    return found.dropDuplicates(["id", "own"]).select(*(F.col("row")[c].alias(c) for c in df.columns))
