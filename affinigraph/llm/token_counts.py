"""Token counts of fields and sections from one encoding of each whole document.

A document's fields are encoded together, as one text, so counts add up to what a model reads. Token byte spans are
interval-joined with the section spans by binary search. A token that crosses a border belongs to the section with most of
its bytes; on equal parts, to the earlier section (rule "most"), or to the section of its first byte (rule "first").
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary_buffers, ship

COUNTS = "doc_id long, section int, start_byte long, end_byte long, n_tokens long, n_crossing long"
FIELDS = COUNTS.replace("section int", "field string")
RULES = ("most", "first")


def allocate(start: np.ndarray, end: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token span, and whether it crosses. ``borders``: first bytes of the sections, from 0, then the end."""
    first = np.searchsorted(borders, start, "right") - 1
    last = np.searchsorted(borders, end - 1, "right") - 1
    crossing = last > first
    if rule == "first" or not crossing.any():
        return first, crossing
    own = first.copy()
    for i in np.nonzero(crossing)[0]:
        inner = np.clip(borders[first[i] : last[i] + 2], start[i], end[i])
        own[i] = first[i] + int(np.argmax(np.diff(inner)))
    return own, crossing


def counts_of(tok, own: bytes, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each part of a text, and those of them that cross a border."""
    n = len(borders) - 1
    if not own:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    start, end = tok.spans(own.decode())
    at, crossing = allocate(start, end, borders, rule)
    return np.bincount(at, minlength=n), np.bincount(at[crossing], minlength=n)


def _checked(rule: str, separator: bytes) -> int:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if len(separator) != 1:
        raise ValueError("the separator is one byte")
    return separator[0]


def section_counts(
    docs: DataFrame, vocabulary: str, pattern: str, separator: bytes = b"\n", rule: str = "most", key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row for each section (a run of text up to and with its separator), in document order, from 0.

    A null or empty text has one empty section without tokens; a null id stays null; repeated rows are counted each.
    """
    sep = _checked(rule, separator)
    ship(docs.sparkSession)
    names = [c.split()[0] for c in COUNTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from affinigraph.llm.tokenizing import byte_tokenizer

        tok = byte_tokenizer(vocabulary, pattern)
        for batch in batches:
            offsets, raw = binary_buffers(batch.column(1))
            keys, out, size = [], [], 0
            for i, k in enumerate(batch.column(0).to_pylist()):
                own = raw[offsets[i] : offsets[i + 1]]
                borders = np.concatenate(([0], np.nonzero(own == sep)[0] + 1, [len(own)]))
                if len(borders) > 2 and borders[-2] == borders[-1]:
                    borders = borders[:-1]
                n = len(borders) - 1
                counts, crossed = counts_of(tok, own.tobytes(), borders, rule)
                keys += [k] * n
                out.append(np.stack([np.arange(n), borders[:-1], borders[1:], counts, crossed]))
                size += n
                if size > 50_000 or i == batch.num_rows - 1:
                    v = np.concatenate(out, axis=1)
                    numbers = [pa.array(v[0], pa.int32()), *(pa.array(x, pa.int64()) for x in v[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *numbers], names=names)
                    keys, out, size = [], [], 0

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, COUNTS)


def field_counts(
    docs: DataFrame, fields: list[str], vocabulary: str, pattern: str, separator: bytes = b"\n", rule: str = "most", key: str = "doc_id",
) -> DataFrame:
    """One row for each field of each row: its tokens in the one text that the fields make, each but the last followed by the
    separator, which counts for the field before. A null field is empty; a null id stays null; repeated rows are counted each.
    """
    _checked(rule, separator)
    ship(docs.sparkSession)
    names = [c.split()[0] for c in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from affinigraph.llm.tokenizing import byte_tokenizer

        tok = byte_tokenizer(vocabulary, pattern)
        for batch in batches:
            rows = []
            for k, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = [(v or "").encode() + separator for v in values]
                parts[-1] = parts[-1][:-1]
                borders = np.cumsum([0, *map(len, parts)])
                kept = np.nonzero(np.diff(borders))[0]  # an empty last field takes no token
                counts, crossed = (np.zeros(len(parts), np.int64) for _ in range(2))
                if len(kept):
                    counts[kept], crossed[kept] = counts_of(tok, b"".join(parts), np.append(borders[kept], borders[-1]), rule)
                rows += zip([k] * len(parts), fields, borders[:-1].tolist(), borders[1:].tolist(), counts.tolist(), crossed.tolist(), strict=True)
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col(key).cast("long"), *(F.col("`" + c.replace("`", "``") + "`").cast("string") for c in fields)).mapInArrow(run, FIELDS)
