"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import byte_groups, scratch, text_bytes, written
from trackweave.llm.pieces import PieceTable, kept

MAGIC = b"TWID0002"
#: File: magic; blocks, each with a head (ids, coded 16-bit words, crc32 of its ids as little-endian 32-bit integers, crc32 of the
#: words) and its words; documents (id, null flag, ids); foot (documents, ids, blocks, ids per block, crc32 of the documents, magic).
FOOT, BLOCK = struct.Struct("<QQIII8s"), struct.Struct("<IIII")
DOCS = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")])
#: Places of the order-2 table; bits below an id's confidence; ids that are contexts of order 1 of their own.
ORDER2, SHIFT, OWN = 1 << 20, 24, 63
#: Weights of an id counted after its context and of all that order 0 knows.
AFTER, BEFORE = 256, 8192
MASK, LEAST = np.uint64((1 << 48) - 1), np.uint64(1 << 32)
U16, U32 = np.uint64(16), np.uint64(32)
#: Bytes of text a writing task takes; larger inputs get larger tasks instead of more than MOST_TASKS.
TASK_BYTES, MOST_TASKS = 16 << 20, 20_000
#: A file holds no more documents than this, so that its list of them has a bound.
MOST_DOCS = 1 << 20


class _Mixer:
    """The model of one block, shared by its lanes; every block starts anew.

    Ids stand as their ranks by frequency in the block, rank 0 the commonest.
    Orders 2 and 1 each predict one id, the last confirmed after the same two
    ids or one id, with a confidence of 0 to 3. Whether the order-2 id, the
    order-1 id or neither follows is coded under a mix of what was counted at
    this pair of confidences, at each of them alone and in the whole block, so
    that contexts seen little lean on wider ones. Other ids are coded under a
    mix of the counts after the id before (the OWN commonest ids are contexts of
    their own, the others one together) and those of order 0. Predicted ids
    adapt at every step, counts when a fifth more ids have been seen; all sums
    are of whole numbers, so that both sides agree on every machine.
    """

    def __init__(self, lanes: int, top: int, n_ids: int):
        self.two, self.one = np.zeros(ORDER2, np.int32), np.zeros(top, np.int32)  # confidence << SHIFT | rank
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.kinds, self.top, self.contexts = np.ones((4, 8, 3), np.int64), top, min(OWN, top) + 1
        small = n_ids * AFTER + self.contexts * (BEFORE + top) < 1 << 31
        self.kind = np.int32 if small else np.int64  # narrow tables stay in a core's cache
        self.after = np.zeros((self.contexts, top), self.kind)
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []
        self.seen, self.due = 0, 0
        self.sums = np.zeros((self.contexts, top + 1), self.kind)
        self.places, self.base = self.sums.ravel(), np.zeros(self.contexts, self.kind)
        self.rebuild()

    def rebuild(self) -> None:
        if self.kept:
            self.kinds += np.bincount(np.concatenate([c for c, _ in self.kept]), minlength=96).reshape(4, 8, 3)
            np.add.at(self.after.ravel(), np.concatenate([r for _, r in self.kept]), self.kind(1))
            self.kept = []
        self.due = self.seen + self.seen // 5 + 1
        wide = [self.kinds.sum(axis=1, keepdims=True), self.kinds.sum(axis=0, keepdims=True), self.kinds.sum(axis=(0, 1), keepdims=True)]
        mixed = self.kinds * 256 + sum(w * 1024 // w.sum(axis=2, keepdims=True) for w in wide)
        sums = np.zeros((32, 4), np.int64)
        sums[:, 1:] = np.cumsum(mixed, axis=2).reshape(32, 3)
        scaled = sums * ((1 << 16) - 3) // sums[:, 3:] + np.arange(4)
        self.first, self.second = scaled[:, 1].copy(), scaled[:, 2].copy()
        self.start, self.width = scaled[:, :3].ravel().astype(np.uint64), np.diff(scaled, axis=1).ravel().astype(np.uint64)
        zero = self.after.sum(axis=0, dtype=np.int64)
        least = (zero * BEFORE // max(1, int(zero.sum())) + 1).astype(self.kind)
        for c, (counts, sums) in enumerate(zip(self.after, self.sums)):  # rising through all contexts, to look ids up at once
            self.base[c] = sums[0] = self.sums[c - 1, -1] if c else 0
            weights = counts * self.kind(AFTER) + least
            weights[0] += sums[0]
            np.cumsum(weights, dtype=self.kind, out=sums[1:])
        self.total = (self.sums[:, -1] - self.base).astype(np.uint64)

    def find(self, after: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Places in sums of the contexts' values, looked up in rising order: far fewer cache misses than in any other."""
        sought = value.astype(self.kind) + self.base[after]
        order = np.argsort(sought)
        found = np.empty(len(sought), np.int64)
        found[order] = np.searchsorted(self.places, sought[order], side="right") - 1
        return found

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the first n lanes: the ids of orders 2 and 1, and the context of their confidences."""
        last = self.last[:n]
        self.at = (last * 40503 + self.before[:n] * 2654435761) >> 5 & (ORDER2 - 1), last
        self.was = self.two.take(self.at[0]), self.one.take(last)
        two, one = self.was[0] & (1 << SHIFT) - 1, self.was[1] & (1 << SHIFT) - 1
        return two, one, (self.was[0] >> SHIFT) * 8 + (self.was[1] >> SHIFT) * 2 + (two == one)

    def context(self, lanes: np.ndarray) -> np.ndarray:
        return np.minimum(self.last[lanes], self.contexts - 1)

    def update(self, ids: np.ndarray, two: np.ndarray, one: np.ndarray, kind: np.ndarray, rest: np.ndarray) -> None:
        """kind: three times the context of the confidences plus the kind coded; rest: contexts of order 1 times top plus the ids coded there."""
        n, fresh = len(ids), (ids | 1 << SHIFT).astype(np.int32)
        for table, at, was, guess in ((self.two, self.at[0], self.was[0], two), (self.one, self.at[1], self.was[1], one)):
            lost = np.where(was >= 2 << SHIFT, was - (1 << SHIFT), fresh)
            table[at] = np.where(guess == ids, np.minimum(was + (1 << SHIFT), guess | 3 << SHIFT), lost)  # lanes at one place: the last counts
        self.before[:n] = self.last[:n]
        self.last[:n] = ids
        self.kept.append((kind, rest))
        self.seen += n
        if self.seen >= self.due:
            self.rebuild()


def _lanes(n: int) -> tuple[int, int, int]:
    """For a block of n ids: ids to a lane, lanes, and ids of the last lane."""
    length = max(64, min(256, n >> 9))
    return length, -(-n // length), n - (n - 1) // length * length


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, the commonest first; the ids as places in them)."""
    if int(ids.max()) < 1 << 20:
        counts = np.bincount(ids)
        names = np.flatnonzero(counts)
        counts = counts[names]
    else:
        names, counts = np.unique(ids, return_counts=True)
    names = names[np.argsort(-counts, kind="stable")]
    if int(names.max()) < 1 << 20:
        place = np.zeros(int(names.max()) + 1, np.int64)
        place[names] = np.arange(len(names))
        return names, place[ids]
    order = np.argsort(names)
    return names, order[np.searchsorted(names[order], ids)]


def _encode_block(ids: np.ndarray) -> np.ndarray:
    """How many distinct ids (two words), words to an id and the ids, how many words each lane has, then the lanes' words.

    Each lane has a range coder of its own.
    """
    length, lanes, short = _lanes(len(ids))
    names, ranks = _ranked(ids)
    padded = np.zeros(lanes * length, np.int64)
    padded[: len(ids)] = ranks
    table, mixer, every = np.ascontiguousarray(padded.reshape(lanes, length).T), _Mixer(lanes, len(names), len(ids)), np.arange(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, MASK)
    out, used = np.zeros((lanes, length * 4 + 8), np.uint16), np.zeros(lanes, np.int64)

    def carried(below: np.ndarray, at: np.ndarray) -> np.ndarray:
        over = at[below > MASK]
        back = used[over] - 1
        while len(over):  # a carry runs back through the words written
            out[over, back] += 1
            on = out[over, back] == 0
            over, back = over[on], back[on] - 1
        return below & MASK

    def put(at: np.ndarray, part: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        below, width = carried(low[at] + part * start, at), part * size
        while len(few := np.flatnonzero(width < LEAST)):
            which = at[few]
            out[which, used[which]] = below[few] >> U32
            used[which] += 1
            below[few] = below[few] << U16 & MASK
            width[few] <<= U16
        low[at], span[at] = below, width

    for t in range(min(length, len(ids))):
        n = lanes if t < short else lanes - 1
        now = table[t, :n]
        two, one, context = mixer.predict(n)
        kind = np.where(now == two, 0, np.where(now == one, 1, 2))
        context = context * 3 + kind
        put(every[:n], span[:n] >> U16, mixer.start.take(context), mixer.width.take(context))
        rest = np.flatnonzero(kind == 2)
        coded = rest
        if len(rest):
            after = mixer.context(rest)
            coded = after * (mixer.top + 1) + now[rest]
            start = mixer.places.take(coded)
            put(rest, span[rest] // mixer.total[after], (start - mixer.base[after]).astype(np.uint64), (mixer.places.take(coded + 1) - start).astype(np.uint64))
            coded = coded - after
        mixer.update(now, two, one, context, coded)
    low = carried(low + np.uint64(0xFFFF), every)  # two words stay within the span, whatever follows them
    out[every, used], out[every, used + 1] = low >> U32, low >> U16 & np.uint64(0xFFFF)
    size = used + 2
    wide = 1 + int(names.max() >= 1 << 16)
    head = np.array([len(names)], "<u4").view("<u2"), np.array([wide], "<u2"), names.astype("<u4" if wide == 2 else "<u2").view("<u2")
    return np.concatenate([*head, size.astype(np.uint16), out[np.arange(out.shape[1]) < size[:, None]]])


def _decode_block(coded: np.ndarray, n_ids: int) -> np.ndarray:
    length, lanes, short = _lanes(n_ids)
    top = int(coded[:2].view("<u4")[0])
    wide = int(coded[2])
    names, coded = coded[3 : 3 + wide * top].view("<u4" if wide == 2 else "<u2").astype(np.uint32), coded[3 + wide * top :]
    size, mixer, every = coded[:lanes].astype(np.int64), _Mixer(lanes, top, n_ids), np.arange(lanes)
    words = np.zeros(int(size.sum()) + 4, np.uint64)  # past its own words a lane may read any
    words[:-4] = coded[lanes:]
    at_word = np.cumsum(size) - size + 3
    code = words[at_word - 3] << U32 | words[at_word - 2] << U16 | words[at_word - 1]
    span, out = np.full(lanes, MASK), np.zeros((length, lanes), np.int32)

    def take(at: np.ndarray, part: np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
        value, width = code[at] - part * start, part * width
        while len(few := np.flatnonzero(width < LEAST)):
            which = at[few]
            value[few] = value[few] << U16 | words.take(at_word[which], mode="clip")
            width[few] <<= U16
            at_word[which] += 1
        code[at], span[at] = value, width

    for t in range(min(length, n_ids)):
        n = lanes if t < short else lanes - 1
        two, one, context = mixer.predict(n)
        part = span[:n] >> U16
        value = np.minimum((code[:n] // part).astype(np.int64), (1 << 16) - 1)
        kind = (value >= mixer.first.take(context)).astype(np.int64) + (value >= mixer.second.take(context))
        context = context * 3 + kind
        take(every[:n], part, mixer.start.take(context), mixer.width.take(context))
        now = np.where(kind == 0, two, one).astype(np.int64)
        rest = np.flatnonzero(kind == 2)
        found = rest
        if len(rest):
            after = mixer.context(rest)
            part = span[rest] // mixer.total[after]
            value = np.minimum(code[rest] // part, mixer.total[after] - np.uint64(1))
            found = mixer.find(after, value)
            start = mixer.places.take(found)
            take(rest, part, (start - mixer.base[after]).astype(np.uint64), (mixer.places.take(found + 1) - start).astype(np.uint64))
            now[rest] = found - after * (top + 1)
            found = found - after
        out[t, :n] = now
        mixer.update(now, two, one, context, found)
    return names[out.T.ravel()[:n_ids]]


def encode_blocks(ids: np.ndarray, block: int) -> list[np.ndarray]:
    """The coded 16-bit words of each run of block ids (the last may be shorter)."""
    return [_encode_block(ids[i : i + block]) for i in range(0, len(ids), block)]


def decode_blocks(coded: list[np.ndarray], n_ids: int, block: int) -> np.ndarray:
    """The ids of encode_blocks."""
    parts = [_decode_block(c, min(block, n_ids - i * block)) for i, c in enumerate(coded)]
    return np.concatenate([np.zeros(0, np.uint32), *parts])


class TokenFile:
    """Writes documents' ids to a stream block by block, so that no more than a block and the list of documents are held."""

    def __init__(self, stream, block: int):
        self.stream, self.block = stream, block
        self.docs: list[np.ndarray] = []
        self.held: list[np.ndarray] = []
        self.n_docs = self.n_ids = self.n_blocks = self.n_held = 0
        stream.write(MAGIC)

    def add(self, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        docs = np.zeros(len(doc_ids), DOCS)
        docs["id"], docs["null"], docs["n"] = [x or 0 for x in doc_ids], [x is None for x in doc_ids], counts
        self.docs.append(docs)
        self.held.append(ids)
        self.n_docs += len(docs)
        self.n_ids += len(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            ids, at = np.concatenate(self.held), 0
            while len(ids) - at >= self.block:
                self._write(ids[at : at + self.block])
                at += self.block
            self.held, self.n_held = [ids[at:].copy()], len(ids) - at

    def _write(self, ids: np.ndarray) -> None:
        words = _encode_block(ids).astype("<u2", copy=False)
        self.stream.write(BLOCK.pack(len(ids), len(words), zlib.crc32(ids.astype("<u4", copy=False)), zlib.crc32(words)))
        self.stream.write(words.tobytes())
        self.n_blocks += 1

    def close(self) -> None:
        if self.n_held:
            self._write(np.concatenate(self.held))
        docs = np.concatenate([np.zeros(0, DOCS), *self.docs]).tobytes()
        self.stream.write(docs)
        self.stream.write(FOOT.pack(self.n_docs, self.n_ids, self.n_blocks, self.block, zlib.crc32(docs), MAGIC))


def read_file(stored) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray, list[int]]]:
    """(doc_ids, start, counts, crc32 of the ids) of the documents that end in each block, after checking it; reads a block at a time.

    ValueError where a checksum or the format doesn't hold.
    """
    end = stored.size() - FOOT.size
    if end < len(MAGIC):
        raise ValueError("not a token file")
    n_docs, n_ids, n_blocks, block, crc, magic = FOOT.unpack(stored.read_at(FOOT.size, end))
    data = stored.read_at(n_docs * DOCS.itemsize, end - n_docs * DOCS.itemsize) if magic == MAGIC else b""
    if magic != MAGIC or zlib.crc32(data) != crc:
        raise ValueError("not a token file, or its foot is damaged")
    docs = np.frombuffer(data, DOCS)
    counts = docs["n"].astype(np.int64)
    ends, at, done, sums = np.cumsum(counts), len(MAGIC), 0, 0
    for i in range(n_blocks):
        n, size, plain, own = BLOCK.unpack(stored.read_at(BLOCK.size, at))
        words = stored.read_at(2 * size, at + BLOCK.size)
        if zlib.crc32(words) != own:
            raise ValueError(f"block {i} is damaged")
        ids = memoryview(np.ascontiguousarray(_decode_block(np.frombuffer(words, "<u2"), n), "<u4")).cast("B")
        if zlib.crc32(ids) != plain:
            raise ValueError(f"block {i} is damaged")
        at += BLOCK.size + 2 * size
        first, last = i * block, i * block + n
        stop = int(np.searchsorted(ends, last, side="right")) if i < n_blocks - 1 else n_docs
        crcs = []
        for e, c in zip(ends[done:stop].tolist(), counts[done:stop].tolist()):
            crcs.append(zlib.crc32(ids[4 * max(0, e - c - first) : 4 * (e - first)], sums if e - c < first else 0))
        if stop == n_docs or int(ends[stop] - counts[stop]) >= last:
            sums = 0
        else:  # a document that goes on into the next block
            begun = int(ends[stop] - counts[stop])
            sums = zlib.crc32(ids[4 * max(0, begun - first) :], sums if begun < first else 0)
        own = docs[done:stop]
        yield [None if null else d for d, null in zip(own["id"].tolist(), own["null"].tolist())], ends[done:stop] - counts[done:stop], counts[done:stop], crcs
        done = stop


def write_token_files(df: DataFrame, path: str, *, folder: str | None = None, end_id: int = 2, file_ids: int = 1 << 23, block: int = 1 << 20) -> DataFrame:
    """Encode the texts of df (doc_id, text) in ascending doc_id order into token files; returns their manifest.

    Manifest rows: path, part, seq, n_docs, n_ids, in order of (part, seq). A
    task of a range partitioning by doc_id and a hash of the text writes files
    of about file_ids ids, a block at a time, under names of its own attempt,
    and the manifest, a table in the shared folder, lists those of tasks that
    ended: a task that runs twice does no harm. Ids may have 32 bits.
    """
    folder = folder or scratch(df.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = kept(("ids", path), lambda: PieceTable(path))
        part, seq, file, uri, stream = TaskContext.get().partitionId(), 0, None, "", None

        def closed() -> pa.RecordBatch:
            file.close()
            stream.close()
            return pa.RecordBatch.from_pydict({"path": [uri], "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": [file.n_docs], "n_ids": [file.n_ids]})

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for a, b in byte_groups([len(t) for t in texts], 1 << 19):
                if file is None:
                    uri = f"{folder}/ids-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.twid"
                    system, name = fs.FileSystem.from_uri(uri)
                    system.create_dir(os.path.dirname(name), recursive=True)
                    stream = system.open_output_stream(name)
                    file = TokenFile(stream, block)
                got, n = table.encode(texts[a:b], end_id)
                file.add(ids[a:b], n, got)
                if file.n_ids >= file_ids or file.n_docs >= MOST_DOCS:
                    yield closed()
                    file, seq = None, seq + 1
        if file is not None:
            yield closed()

    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = min(size // TASK_BYTES + 1, MOST_TASKS)
    docs = df.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    docs = docs.repartitionByRange(tasks, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return written(docs.mapInArrow(run, "path string, part int, seq int, n_docs long, n_ids long"), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, after decoding and checking every block.

    Only the parts' totals, at most MOST_TASKS rows, are summed in one task;
    files are dealt by a stated number, as their paths are too few bytes for
    adaptive execution to keep them apart.
    """
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    files = manifest.select("path", "part", own.alias("own")).join(before, "part").select("path", (F.col("before") + F.col("own")).alias("start"))
    tasks = max(1, min(manifest.count(), MOST_TASKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, name = fs.FileSystem.from_uri(uri)
                with system.open_input_file(name) as stored:
                    for doc_ids, start, counts, sums in read_file(stored):
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + first), pa.array(counts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartitionByRange(tasks, "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(df: DataFrame, path: str, **options) -> DataFrame:
    """Write df's texts as token files and return what reading them back gives, one row per row of df.

    Null text counts as empty (the end id alone). Null ids come first; rows
    with equal ids follow each other, in the order of a hash of their texts, and
    may lie in several ranges. An empty table gives no files and an empty
    result; further columns are ignored.
    """
    return read_token_files(write_token_files(df, path, **options))
