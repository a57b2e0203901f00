"""Token counts: batch encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import byte_groups, safe_pieces, text_bytes
from trackweave.llm.pieces import PieceTable, kept


def _counter(path: str, batch_bytes: int) -> Callable[[list[bytes]], np.ndarray]:
    if path.endswith(".model"):  # no boundary is known to be safe: whole texts
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)

        def encode(texts: list[bytes]) -> np.ndarray:
            return np.array([len(x) for x in model.encode([t.decode() for t in texts], num_threads=1)], np.int64)
    else:
        table = PieceTable(path, keep_ids=False)
        if table.by_word:
            return lambda texts: _in_pieces(table, texts, batch_bytes)
        encode = table.lengths

    def balanced(texts: list[bytes]) -> np.ndarray:
        """Lengths of texts, encoded in batches of about as many bytes, like lengths together."""
        out = np.zeros(len(texts), np.int64)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        for a, b in byte_groups([len(texts[i]) + 16 for i in order], batch_bytes):
            out[order[a:b]] = encode([texts[i] for i in order[a:b]])
        return out

    return balanced


def _in_pieces(table: PieceTable, texts: list[bytes], batch_bytes: int) -> np.ndarray:
    pieces = [(i, p) for i, t in enumerate(texts) for p in safe_pieces(t, batch_bytes)]
    total = np.zeros(len(texts), np.int64)
    for a, b in byte_groups([len(p) for _, p in pieces], batch_bytes):
        np.add.at(total, [i for i, _ in pieces[a:b]], table.lengths([p for _, p in pieces[a:b]]))
    return total


def token_counts(df: DataFrame, path: str, *, id_column: str = "doc_id", text_column: str = "text", limit: int = 2048, batch_bytes: int = 1 << 19) -> DataFrame:
    """Per row of df: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts are those of the library of the tokenizer file at path, without
    begin, end or added special tokens, truncation or padding. Texts are cut at
    ASCII white space where the tokenizer never joins over it (checked on the
    file), distinct pieces are encoded once per worker in batches of about
    batch_bytes, and only lengths leave Python.

    Null text counts as empty (0 bytes, 0 tokens); ids may be null or repeat
    and each row gets its own count; an empty table gives an empty result;
    further columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = kept(("lengths", path, batch_bytes), lambda: _counter(path, batch_bytes))
        for batch in batches:
            texts = text_bytes(batch.column(1))
            n = count(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[id_column].dataType.simpleString()
    out = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_column)
