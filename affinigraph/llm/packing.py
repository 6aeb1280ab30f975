"""Concatenate-and-cut packing of documents into fixed windows of tokens.

Pass one tokenizes every document once and writes its ids with the tokens that precede it in its partition. The
partition totals, one number for each partition, are summed on the driver into global offsets. Pass two places each
document in the one long sequence and cuts at the window borders; a document that crosses a border leaves one boundary
record in each window it touches. Neither pass shuffles.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from ._common import binary_buffers, materialize, ship

TOKENS = "part int, doc_id long, before long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_OUT = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every whole text and the end id, with the tokens before it in its partition. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from affinigraph.llm.tokenizing import word_tokenizer

        tok, part, before = word_tokenizer(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            offsets, raw = binary_buffers(batch.column(1))
            keys, ns, starts, out, size = [], [], [], [], 0
            raw = raw.tobytes()
            for i, k in enumerate(batch.column(0).to_pylist()):
                ids = tok.encode(raw[offsets[i] : offsets[i + 1]]) + end
                keys.append(k)
                starts.append(before)
                ns.append(len(ids) // 4)
                before += len(ids) // 4
                out.append(np.frombuffer(ids, "<u4").astype("<u2").tobytes() if narrow else ids)
                size += len(out[-1])
                if size > 8 << 20 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ns, pa.int64()), pa.array(out, pa.binary())], names=["part", "doc_id", "before", "n", "ids"])
                    keys, ns, starts, out, size = [], [], [], [], 0

    narrow = vocabulary_size(tokenizer) <= 1 << 16
    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, TOKENS)


def vocabulary_size(tokenizer: str) -> int:
    from .tokenizing import word_tokenizer

    return word_tokenizer(tokenizer).full.get_vocab_size()


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row for each piece: its document, its place there and its place in a sequence of ``window`` tokens.

    Only the last sequence is short. A null or empty text is one end id; repeated rows are packed each; a null id stays
    null; other columns are ignored. ``keep_ids`` adds the piece's ids (little-endian, 32 bits).
    """
    spark = docs.sparkSession
    ship(spark)
    tokens = materialize(tokenize(docs, tokenizer, end_id, key, text), "tokens")
    totals = {r.part: r.n for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(totals):
        base[part] = total
        total += totals[part]
    narrow = vocabulary_size(tokenizer) <= 1 << 16

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, doc, before, n = (batch.column(i).to_numpy(zero_copy_only=False) if i != 1 else batch.column(i).to_pylist() for i in range(4))
            offsets, raw = binary_buffers(batch.column(4))
            rows: list[tuple] = []
            kept: list[bytes] = []
            for i in range(batch.num_rows):
                ids = raw[offsets[i] : offsets[i + 1]].view("<u2" if narrow else "<u4").astype("<u4")
                at, done = base[int(part[i])] + int(before[i]), 0
                while done < n[i]:
                    length = min(window - (at + done) % window, int(n[i]) - done)
                    piece = ids[done : done + length].tobytes()
                    rows.append((doc[i], done, length, zlib.crc32(piece), int(n[i]), (at + done) // window, (at + done) % window))
                    if keep_ids:
                        kept.append(piece)
                    done += length
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * keep_ids, names=_OUT.names + ["ids"] * keep_ids)

    return tokens.mapInArrow(cut, PIECES + ", ids binary" * keep_ids)
