"""Benchmark decontamination by the q-gram lemma.

A benchmark item is cut into overlapping pieces of at most ``piece`` bytes. If a piece of L bytes lies in a document with at
most e edits, the two share at least L + 1 - q (e + 1) q-grams, on diagonals that differ by at most e. Every document is
scanned once: shared q-grams are counted in overlapping diagonal bands, bands that reach the bound are retained, and a
banded alignment decides. Parts of an item that fill no piece are found by windows of ``passage`` bytes at every offset: the
shared q-grams of a whole item are counted, band by band, in a sliding window. Case is folded (A-Z and Latin-1) and white
space bytes count as blanks on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary_buffers, materialize, ship, split_batch

LEAKS = "doc_id long, item_id long, n_regions long, start_byte long, end_byte long, edits long"
_UNIT = 1 << 20  # one edit in the alignment's cost; the rest of the number is the origin

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


def fold(b: np.ndarray) -> np.ndarray:
    """Lower-case A-Z and the two-byte Latin capitals from U+00C0, and make white space blank; lengths stay."""
    out = _FOLD[b]
    if len(b) > 1:
        out[1:] |= ((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)).astype(np.uint8) << 5
    return out


def crowded(key: np.ndarray, least: np.ndarray | int) -> np.ndarray:
    """Whether ``least`` entries may share a key: they are counted in a table by a hash, so that some more pass."""
    bits = min(24, max(12, int(4 * len(key)).bit_length()))
    slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)
    return np.bincount(slot, minlength=1 << bits)[slot] >= least


class QGramIndex:
    """Pieces of the items and their q-grams (q = 8, so that a q-gram is one 64-bit word)."""

    def __init__(self, items: list[tuple[int, bytes]], piece: int = 120, error: float = 0.08, passage: int = 64):
        self.q, self.band, self.passage = 8, 16, passage
        self.edits = min(int(error * passage), passage // self.q - 1)
        self.item, self.text, self.budget, self.need = [], [], [], []
        self.whole, self.name, self.part_of, self.start = [], [], [], []
        for item, raw in items:
            folded = fold(np.frombuffer(raw, np.uint8))
            starts = [0] if len(folded) <= piece else [*range(0, len(folded) - piece, piece // 2), len(folded) - piece]
            self.whole.append(folded)
            self.name.append(item)
            for s in starts:
                own = folded[s : s + piece]
                edits = min(int(error * len(own)), len(own) // self.q - 1)  # some q-gram is left whole
                if edits >= 0:
                    self.item.append(item)
                    self.part_of.append(len(self.whole) - 1)
                    self.start.append(s)
                    self.text.append(own)
                    self.budget.append(edits)
                    self.need.append(len(own) + 1 - self.q * (edits + 1))
        self.budget, self.need = np.array(self.budget, np.int64), np.array(self.need, np.int64)
        self.length = np.array([len(t) for t in self.text], np.int64)
        if not self.text:
            return
        grams = [self.grams(t) for t in self.text]
        of = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams])
        flat = np.concatenate(grams)
        order = np.argsort(flat, kind="stable")
        self.keys, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.of, self.at = of[order], at[order]
        self.part_of, self.start = np.array(self.part_of, np.int64), np.array(self.start, np.int64)
        self.size = np.array([len(t) for t in self.whole], np.int64)
        place = self.part_of[self.of] * (int(self.size.max()) + 1) + self.start[self.of] + self.at
        self.once = np.zeros(len(place), bool)  # pieces overlap; a q-gram of the whole item counts once
        self.once[np.unique(place, return_index=True)[1]] = True
        self.once &= (self.size[self.part_of[self.of]] > passage) & (self.edits >= 0)
        self.bits = max(16, int(np.ceil(np.log2(len(self.keys) * 64))))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(self.keys)] = True
        self.reach = int(max(self.length.max() + self.budget.max(), passage + self.edits))
        self.least = int(min(self.need.min(), self.enough if self.once.any() else self.need.min()))

    @property
    def enough(self) -> int:
        """q-grams that a window of ``passage`` bytes shares at least."""
        return self.passage + 1 - self.q * (self.edits + 1)

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def grams(self, b: np.ndarray) -> np.ndarray:
        if len(b) < self.q:
            return np.zeros(0, np.uint64)
        return np.lib.stride_tricks.as_strided(np.ascontiguousarray(b).view(np.uint8), (len(b) - self.q + 1, self.q), (1, 1)).copy().view("<u8").ravel()

    def hits(self, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, position, entry of the index) of the shared q-grams, where they are dense enough for any bound."""
        none = np.zeros(0, np.int64)
        g = self.grams(text)
        if not len(g):
            return none, none, none
        flag = self.seen[self._slot(g)]
        total = np.concatenate(([0], np.cumsum(flag)))
        n, least = len(g), self.least
        ends = np.minimum(np.arange(n) + self.reach, n)
        dense = total[ends] - total[:n] >= least
        near = np.zeros(n + 1, np.int64)
        runs = np.nonzero(np.diff(np.concatenate(([False], dense, [False])).astype(np.int8)))[0].reshape(-1, 2)
        np.add.at(near, runs[:, 0], 1)
        np.add.at(near, np.minimum(runs[:, 1] - 1 + self.reach, n), -1)
        pos = np.nonzero(flag & (np.cumsum(near)[:n] > 0))[0]
        k = np.searchsorted(self.keys, g[pos])
        k[k == len(self.keys)] = 0
        ok = self.keys[k] == g[pos]
        pos, k = pos[ok], k[ok]
        doc = np.searchsorted(offsets, pos, "right") - 1
        ok = pos + self.q <= offsets[doc + 1]
        pos, k, doc = pos[ok], k[ok], doc[ok]
        if not len(pos):
            return none, none, none
        times = self.count[k]
        hit = np.repeat(self.first[k], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(doc, times), np.repeat(pos, times), hit

    def candidates(self, doc: np.ndarray, pos: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, piece, first diagonal) of the bands that reach the bound."""
        piece = self.of[hit]
        pad = 4 * (self.reach + self.band)  # bands of neighbouring documents stay apart
        diagonal = pos - self.at[hit] + (doc + 1) * pad
        band = diagonal // self.band
        low = diagonal % self.band < self.budget[piece]
        key = np.concatenate([piece * (1 << 40) + band, (piece * (1 << 40) + band - 1)[low]])
        owner = np.concatenate([doc, doc[low]])
        ok = crowded(key, self.need[key >> 40])
        key, owner = key[ok], owner[ok]
        keys, first, count = np.unique(key, return_index=True, return_counts=True)
        piece, owner = keys >> 40, owner[first]
        ok = count >= self.need[piece]
        piece, owner, band = piece[ok], owner[ok], (keys & ((1 << 40) - 1))[ok]
        return owner, piece, band * self.band - (owner + 1) * pad

    def windows(self, doc: np.ndarray, pos: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, item's place, first diagonal, start): windows of ``passage`` bytes of the items that may be within the
        budget. A window shares enough distinct q-grams, and few edits, each of which breaks q in a row, can break the rest."""
        whole, at = self.part_of[self.of[hit]], self.start[self.of[hit]] + self.at[hit]
        pad = 4 * (int(self.size.max()) + self.passage + self.band)
        diagonal = pos - at + (doc + 1) * pad
        low = diagonal % self.band < self.edits
        band = np.concatenate([diagonal // self.band, (diagonal // self.band - 1)[low]])
        whole, at, doc = (np.concatenate([x, x[low]]) for x in (whole, at, doc))
        ok = crowded(whole * (1 << 40) + band, self.enough)
        whole, at, doc, band = whole[ok], at[ok], doc[ok], band[ok]
        bands, own, group = np.unique(whole * (1 << 40) + band, return_index=True, return_inverse=True)
        whole, doc, band = whole[own], doc[own], bands & ((1 << 40) - 1)
        span, grams = int(self.size.max()) + self.passage + 1, self.passage - self.q + 1
        key = np.unique(group * span + at)
        ends = np.append(np.nonzero(np.diff(key) != 1)[0], len(key) - 1)
        runs = key[ends[np.searchsorted(ends, np.arange(len(key)))]] + 1 if len(key) else key
        count = np.searchsorted(key, key + grams) - np.arange(len(key))
        i = np.nonzero(count >= self.enough)[0]
        g, at = np.divmod(key[i], span)
        first = np.maximum(key[np.minimum(i + self.enough - 1, len(key) - 1)] % span - grams + 1, 0)
        last = np.minimum(at, self.size[whole[g]] - self.passage)
        out = [key[:0]]
        for part in np.array_split(np.arange(len(g)), max(1, len(g) // 65536)):
            n = np.maximum(last[part] - first[part] + 1, 0)
            w = np.unique(np.repeat(g[part] * span + first[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            reached = w.copy()
            for turn in range(self.edits + 1):  # the first q-gram from here that is not shared
                k = np.minimum(np.searchsorted(key, reached), len(key) - 1)
                reached = np.where(key[k] == reached, runs[k], reached) if len(key) else reached
                if turn < self.edits:
                    reached += self.q
            out.append(w[reached >= w + grams])
        g, w = np.divmod(np.unique(np.concatenate(out)), span)
        return doc[g], whole[g], band[g] * self.band - (doc[g] + 1) * pad, w

    def quoted(self, text: np.ndarray, offsets: np.ndarray, windows: tuple[np.ndarray, ...]) -> dict[tuple[int, int], tuple[int, int, int]]:
        """{(document, item's place): (edits, begin, end)} of a window within the budget. One window of each band is aligned
        first; the others only where none of the first passed."""
        out: dict[tuple[int, int], tuple[int, int, int]] = {}

        def attempt(rows: np.ndarray) -> None:
            for part in np.array_split(rows, -(-len(rows) // 512)) if len(rows) else ():
                d, k, diagonal, w = (x[part] for x in windows)
                own = np.stack([self.whole[a][b : b + self.passage] for a, b in zip(k, w, strict=True)])
                edits, begin, end = self.banded(text, offsets, d, own, self.edits, diagonal + w)
                for a, b, *region in zip(*(x.tolist() for x in (d, k, edits, begin, end)), strict=True):
                    if region[0] <= self.edits:
                        out[a, b] = min(out.get((a, b), tuple(region)), tuple(region))

        first = np.ones(len(windows[0]), bool)
        first[1:] = np.any([np.diff(x) != 0 for x in windows[:3]], axis=0)
        attempt(np.nonzero(first)[0])
        rest = [(d, k) not in out for d, k in zip(windows[0].tolist(), windows[1].tolist(), strict=True)]
        attempt(np.nonzero(~first & np.array(rest, bool))[0])
        return out

    def align(self, text: np.ndarray, offsets: np.ndarray, doc: np.ndarray, piece: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least edits of each piece inside its band, and the bytes where that alignment starts and ends."""
        edits, begin, end = (np.zeros(len(doc), np.int64) for _ in range(3))
        for length in np.unique(self.length[piece]):
            rows = np.nonzero(self.length[piece] == length)[0]
            for part in np.array_split(rows, max(1, len(rows) // 512)):
                own = np.stack([self.text[p] for p in piece[part]])
                edits[part], begin[part], end[part] = self.banded(text, offsets, doc[part], own, int(self.budget[piece[part]].max()), diagonal[part])
        return edits, begin, end

    def banded(self, text: np.ndarray, offsets: np.ndarray, doc: np.ndarray, own: np.ndarray, e: int, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """align() for texts of one length, the rows of ``own``, with at most e edits."""
        length, rows = own.shape[1], np.arange(len(own))
        width = self.band + 3 * e + 1
        base, lo, hi = diagonal - e, offsets[doc], offsets[doc + 1]
        o = np.arange(width)
        start = base[:, None] + o
        inside = (start >= lo[:, None]) & (start <= hi[:, None])
        cost = np.where(inside, o, _UNIT << 20).astype(np.int64)
        for i in range(length):
            at = start + i
            legal = (at >= lo[:, None]) & (at < hi[:, None])
            differs = text[np.clip(at, 0, len(text) - 1)] != own[:, i : i + 1]
            match = np.where(legal, cost + differs * _UNIT, _UNIT << 20)
            skip = np.concatenate([cost[:, 1:] + _UNIT, np.full((len(own), 1), _UNIT << 20)], axis=1)
            best = np.minimum(match, skip)
            cost = np.minimum.accumulate(best - o * _UNIT, axis=1) + o * _UNIT
        best = cost.argmin(axis=1)
        value = cost[rows, best]
        return value // _UNIT, base + value % _UNIT, base + best + length

    def leaks(self, text: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(document, item, regions, start, end, edits): the best region of each item in each document."""
        if not self.text:
            return []
        text = fold(text)
        near = self.hits(text, offsets)
        if not len(near[0]):
            return []
        doc, piece, diagonal = self.candidates(*near)
        edits, begin, end = self.align(text, offsets, doc, piece, diagonal)
        found: dict[tuple[int, int], list] = {}
        for d, p, e, b, f in zip(doc, piece, edits, begin, end, strict=True):
            if e <= self.budget[p]:
                x = found.setdefault((int(d), self.item[p]), [set(), None])
                x[0].add(int(p))
                own = (int(e), int(b - offsets[d]), int(f - offsets[d]))
                x[1] = own if x[1] is None else min(x[1], own)
        once = self.once[near[2]]
        wide = self.windows(*(x[once] for x in near))
        new = np.array([(d, self.name[k]) not in found for d, k in zip(wide[0].tolist(), wide[1].tolist(), strict=True)], bool)
        for (d, k), (e, b, f) in self.quoted(text, offsets, tuple(x[new] for x in wide)).items():
            own = (e, b - int(offsets[d]), f - int(offsets[d]))
            x = found.setdefault((d, self.name[k]), [{-1}, own])
            x[1] = min(x[1], own)
        return [(d, item, len(ps), b, f, e) for (d, item), (ps, (e, b, f)) in found.items()]


def _indexes(benchmark: DataFrame, piece: int, error: float, passage: int, block_bytes: int, item_key: str, item_text: str) -> tuple[int, Iterator[QGramIndex]]:
    """How many blocks the items make, and their indexes, one at a time."""
    items = benchmark.select(F.col(item_key).cast("long").alias("k"), F.col(item_text).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("t").cast("long")).alias("n")).first().n or 0
    blocks = max(1, -(-size // block_bytes))

    def one(n: int) -> QGramIndex:
        mine = items.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == n).distinct().orderBy("k", "t").collect()
        return QGramIndex([(r.k, r.t.encode()) for r in mine], piece, error, passage)

    return blocks, (one(n) for n in range(blocks))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, piece: int = 120, error: float = 0.08, passage: int = 64, block_bytes: int = 4 << 20,
    key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row for each document row and item of which a piece, or any ``passage`` bytes at whatever offset, lies in the
    document within the edit budget. ``n_regions`` counts the pieces, and is 1 where a passage fills none.

    The items go to the tasks in blocks of about ``block_bytes``; of several, each is sent, has its pass over the documents
    written and is released before the next. Null texts match nothing; items under 8 bytes can't be told from chance and
    match nothing; equal items are reported each; repeated rows are judged each; a null document id stays null.
    """
    spark = docs.sparkSession
    ship(spark)
    blocks, indexes = _indexes(benchmark, piece, error, passage, block_bytes, item_key, item_text)
    source, out = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text_")), None
    names = [c.split()[0] for c in LEAKS.split(", ")]
    for index in indexes:
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for whole in batches:
                for batch in split_batch(whole, "text_"):
                    offsets, raw = binary_buffers(batch.column(1))
                    rows = index.leaks(raw, offsets) if len(raw) else []
                    ids = batch.column(0).to_pylist()
                    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                    own = [pa.array([ids[d] for d in cols[0]], pa.int64()), *(pa.array(c, pa.int64()) for c in cols[1:])]
                    yield pa.RecordBatch.from_arrays(own, names=names)

        part = source.mapInArrow(run, LEAKS)
        if blocks > 1:
            part = materialize(part, "leaks")
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, piece: int = 120, error: float = 0.08, passage: int = 64, block_bytes: int = 4 << 20,
    text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows, whole and with all their columns, in whose text no item leaks; what leaks is as in find_leaks(). Each row is
    judged by its own text, whatever its id; a null text stays. No shuffle: tasks pass on what they keep."""
    spark = docs.sparkSession
    ship(spark)
    blocks, indexes = _indexes(benchmark, piece, error, passage, block_bytes, item_key, item_text)
    at = docs.columns.index(text)
    for index in indexes:
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for whole in batches:
                for batch in split_batch(whole, at):
                    offsets, raw = binary_buffers(batch.column(at))
                    clean = np.ones(batch.num_rows, bool)
                    clean[[r[0] for r in index.leaks(raw, offsets)] if len(raw) else []] = False
                    yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
        if blocks > 1:
            docs = materialize(docs, "clean")
            sent.destroy()
    return docs
