"""Exact removal of repeated byte strings by a distributed merge sort of suffixes.

A repeat of ``length`` bytes holds, at the same place in each of its copies, an anchor: a position whose q-gram has the
least hash of all q-grams of the repeat. So only suffixes that start at anchors are sorted.

1. Tasks exchange the hashes of their anchors' q-grams and learn which occur elsewhere; only those can lie in a repeat.
2. Each task sorts its remaining suffixes into runs. A suffix is its q-gram's hash (which spreads the ranges evenly) and up
   to ``length`` bytes; copies with the same surroundings are settled on the spot and leave one. Runs are cut by ranges
   and sent front-coded: the length of the prefix shared with the suffix before, and the rest.
3. Each range merges its runs in a loser tree that compares suffixes by their known common prefixes with the last winner
   and looks at bytes only where these are equal, from there on. The common prefixes that fall out, with those of the text
   to the left, tell which strings around each anchor also start earlier.

The surroundings of one q-gram meet in one range. A q-gram that occurs more than ``hot`` times is therefore dealt by whole
windows instead: each task sends the 128-bit fingerprint of each distinct window around it once, so a common passage costs
a task one row for each of its windows, and what differs around it spreads over all ranges.

Marks and spans go back to the documents by buckets of document ids, many in one row, so that the rows sent never exceed
tasks x buckets, and a bucket's task makes one row of each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary_buffers, materialize, mix64, one_per_id, partitions_for, ship, split_batch

Q = 32
#: Texts of about so many bytes are hashed at once; arrays of 8 bytes for each byte of text then stay small.
TEXT_BYTES = 1 << 20
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every window of ``width``, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = f(out[:-step], out[step:])
        done += step
    return out


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Places in the buffer, documents and q-gram hashes of the anchors, in order; then the short hashes at these places
    and the least short hash of each window, which tell in which windows an anchor is the least.

    All q-grams with the least hash of a window count, so what is chosen in a window depends on its bytes alone.
    """
    n, w = len(raw) - Q + 1, length - Q + 1
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    word = np.lib.stride_tricks.as_strided(np.ascontiguousarray(raw), (len(raw) - 7, 8), (1, 1)).copy().view("<u8").ravel()
    h = word[:n] * np.uint64(0x9E3779B97F4A7C15)
    h += word[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h += word[16 : 16 + n] * np.uint64(0x165667B19E3779F9)
    h += word[24 : 24 + n] * np.uint64(0xD6E8FEB86659FD93)
    h = mix64(h)
    small = (h >> np.uint64(32)).astype(np.uint32)
    least = _slide(small, w, np.minimum)
    room = np.zeros(len(raw) + 1, np.int8)  # windows that stay in their document
    size = np.diff(offsets)
    long = np.nonzero(size >= length)[0]
    np.add.at(room, offsets[long], 1)
    np.add.at(room, offsets[long + 1] - length + 1, -1)
    least[np.cumsum(room, dtype=np.int8)[: len(least)] == 0] = 0
    padded = np.zeros(len(least) + 2 * (w - 1), np.uint32)
    padded[w - 1 : w - 1 + len(least)] = least
    at = np.nonzero(_slide(padded, w, np.maximum) == small)[0]
    doc = np.searchsorted(offsets, at, "right") - 1
    ok = at + Q <= offsets[doc + 1]
    at, doc = at[ok], doc[ok]
    return at, doc, mix64(h[at]), small[at], least  # the least hashes are all small; ranges need even ones


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def bucket_of(doc: np.ndarray, parts: int) -> np.ndarray:
    """Where a document's marks and spans are gathered."""
    return part_of(mix64(np.asarray(doc, np.int64).view(np.uint64)), parts)


def gram_key(h: np.ndarray, parts: int) -> np.ndarray:
    """What names a q-gram in its range: the range and the low half of the hash."""
    return (part_of(h, parts) << 32) | (h & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _batch(names: list[str], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(cols), names=names)


def _runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of the runs of equal values in a sorted array."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.nonzero(np.concatenate(([True], x[1:] != x[:-1])))[0]
    return first, np.append(first[1:], len(x))


def _dealt(part: np.ndarray, *cols: np.ndarray) -> Iterator[tuple]:
    """(part, columns) for each distinct part."""
    order = np.argsort(part, kind="stable")
    for a, b in zip(*_runs_of(part[order]), strict=True):
        own = order[a:b]
        yield int(part[own[0]]), *(c[own] for c in cols)


# Pass 1: which anchors occur elsewhere

ANNOUNCED = "part int, kind int, docs binary, marks binary, counts binary"
MARKED = "doc_id long, marks binary, gram long, n long"


def announce(docs: DataFrame, length: int, parts: int, most: int = 250_000) -> DataFrame:
    """Rows by range: kind 0 the low hash halves of anchors, one document of each and how often each occurs, one entry for
    each hash and batch. Rows by bucket: kind 1 the anchors already known to repeat inside a batch, with their documents."""
    names = [c.split()[0] for c in ANNOUNCED.split(", ")]

    def flush(found: list[tuple]) -> pa.RecordBatch:
        h, ids = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(h, kind="stable")
        h, ids = h[order], ids[order]
        first, end = _runs_of(h)
        n = end - first
        low = (h & np.uint64(0xFFFFFFFF)).astype("<u4")
        many = np.repeat(n > 1, n)
        rows = [(p, 1, d.astype("<i8").tobytes(), m.tobytes(), b"") for p, d, m in _dealt(bucket_of(ids[many], parts), ids[many], low[many])]
        for p, d, m, c in _dealt(part_of(h[first], parts), ids[first], low[first], np.minimum(n, 65535)):
            rows.append((p, 0, d.astype("<i8").tobytes(), m.tobytes(), c.astype("<u2").tobytes()))
        part, kind, *data = zip(*rows, strict=True)
        return _batch(names, pa.array(part, pa.int32()), pa.array(kind, pa.int32()), *(pa.array(c, pa.binary()) for c in data))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for whole in batches:
            for batch in split_batch(whole, "text_", TEXT_BYTES):
                offsets, raw = binary_buffers(batch.column(1))
                _, doc, h, *_ = anchors(raw, offsets, length)
                found.append((h, batch.column(0).to_numpy()[doc]))
                size += len(h)
                if size >= most:
                    yield flush(found)
                    found, size = [], 0
        if size:
            yield flush(found)

    return docs.mapInArrow(run, ANNOUNCED)


def repeated(announced: DataFrame, parts: int, hot: int) -> DataFrame:
    """For each document (doc_id, marks) the hash halves of anchors that occur in another batch or twice in one; and, without
    an id, (gram, n) of the q-grams that occur more than ``hot`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        known: list[tuple] = []
        for batch in batches:
            for part, kind, d, m, c in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                d, m = np.frombuffer(d, "<i8"), np.frombuffer(m, "<u4")
                if kind:
                    known.append((d, m))
                else:
                    got.setdefault(part, []).append((d, m, np.frombuffer(c, "<u2")))
        rows = []
        for part in list(got):
            d, m, c = (np.concatenate(x) for x in zip(*got.pop(part), strict=True))
            order = np.argsort(m, kind="stable")
            d, m, c = d[order], m[order], c[order].astype(np.int64)
            first, end = _runs_of(m)
            total = np.add.reduceat(c, first)
            many = np.repeat(end - first > 1, end - first)
            known.append((d[many], m[many]))
            often = total > hot
            if often.any():
                keys = (part << 32) | m[first[often]].astype(np.int64)
                rows.append((part, 1, keys.astype("<i8").tobytes(), total[often].astype("<i8").tobytes(), b""))
        if known:
            d, m = (np.concatenate(x) for x in zip(*known, strict=True))
            rows += [(p, 0, x.astype("<i8").tobytes(), y.astype("<u4").tobytes(), b"") for p, x, y in _dealt(bucket_of(d, parts), d, m)]
        for row in rows:
            yield _batch(names, *(pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[tuple] = []
        for batch in batches:
            for _, kind, a, b, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind:
                    gram, n = np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")
                    none = [pa.nulls(len(gram), t) for t in (pa.int64(), pa.binary())]
                    yield _batch(out, *none, pa.array(gram), pa.array(n))
                else:
                    known.append((np.frombuffer(a, "<i8"), np.frombuffer(b, "<u4")))
        if known:
            d, m = (np.concatenate(x) for x in zip(*known, strict=True))
            order = np.lexsort((m, d))
            d, m = d[order], m[order]
            fresh = np.concatenate(([True], (d[1:] != d[:-1]) | (m[1:] != m[:-1])))
            d, m = d[fresh], m[fresh]
            first, end = _runs_of(d)
            for i in range(0, len(first), 5000):
                a, b = first[i : i + 5000], end[i : i + 5000]
                marks = pa.array([m[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary())
                yield _batch(out, pa.array(d[a], pa.int64()), marks, *(pa.nulls(len(a), pa.int64()) for _ in range(2)))

    names, out = ([c.split()[0] for c in x.split(", ")] for x in (ANNOUNCED, MARKED))
    met = announced.repartitionById(parts, F.col("part")).mapInArrow(run, ANNOUNCED)
    return met.repartitionById(parts, F.col("part")).mapInArrow(gather, MARKED)


# Pass 2: sorted front-coded runs


def windows_of(raw: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes right of each place, bytes left of it from near to far, and how many of each the document has."""
    left = length - Q
    right_n, left_n = np.minimum(length, high - at), np.minimum(left, at - low)
    padded = np.concatenate([np.zeros(left, np.uint8), raw, np.zeros(length, np.uint8)])
    right = padded[(at + left)[:, None] + np.arange(length)]
    right[np.arange(length) >= right_n[:, None]] = 0
    back = padded[(at + left - 1)[:, None] - np.arange(left)]
    back[np.arange(left) >= left_n[:, None]] = 0
    return right, back, right_n, left_n


def _columns(m: np.ndarray) -> list[np.ndarray]:
    """A byte matrix as big-endian words, most significant column first."""
    pad = -m.shape[1] % 8
    return list(np.ascontiguousarray(np.pad(m, ((0, 0), (0, pad)))).view(">u8").astype(np.uint64).T)


def common_prefix(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the row before it; 0 for the first."""
    out = np.zeros(len(m), np.int64)
    if len(m) > 1:
        differs = m[1:] != m[:-1]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), m.shape[1])
        out[1:] = np.minimum(first, np.minimum(n[1:], n[:-1]))
    return out


def merge_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of each document as one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    change = np.concatenate(([True], doc[1:] != doc[:-1]))
    shift = np.cumsum(change) * (int(end.max()) + 2)  # documents side by side, apart
    reach = np.maximum.accumulate(end + shift)
    fresh = np.concatenate(([True], (start + shift)[1:] > reach[:-1]))
    first = np.nonzero(fresh)[0]
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], (reach - shift)[last]


def front_coded(key: np.ndarray, key_n: np.ndarray, back: np.ndarray, back_n: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> bytes:
    """A sorted run: shared prefix lengths, key lengths, key rests, left texts, documents and places."""
    shared = common_prefix(key, key_n)
    cols = np.arange(key.shape[1])
    rest = key[(cols >= shared[:, None]) & (cols < key_n[:, None])]
    left = back[np.arange(back.shape[1]) < back_n[:, None]]
    head = np.array([len(key), len(rest), len(left)], "<i8")
    numbers = [x.astype("<i8").tobytes() for x in (doc, pos)] + [x.astype("<u2").tobytes() for x in (shared, key_n, back_n)]
    return b"".join([head.tobytes(), *numbers, rest.tobytes(), left.tobytes()])


class Run:
    """A front-coded run, unpacked."""

    def __init__(self, raw: bytes):
        n, n_rest, n_left = np.frombuffer(raw, "<i8", 3)
        at = 24
        got = []
        for kind, width in (("<i8", 8), ("<i8", 8), ("<u2", 2), ("<u2", 2), ("<u2", 2)):
            got.append(np.frombuffer(raw, kind, n, at))
            at += int(n) * width
        self.doc, self.pos, shared, key_n, self.back_n = got
        self.shared = shared.tolist()
        rest, self.left = raw[at : at + int(n_rest)], np.frombuffer(raw, np.uint8, n_left, at + int(n_rest))
        self.keys, key, i = [], b"", 0
        for s, k in zip(self.shared, key_n.tolist(), strict=True):
            key = key[:s] + rest[i : i + k - s]
            i += k - s
            self.keys.append(key)


def _first_difference(a: bytes, b: bytes, known: int) -> int:
    n = min(len(a), len(b)) - known
    x = int.from_bytes(a[known : known + n], "big") ^ int.from_bytes(b[known : known + n], "big")
    return known + n - (x.bit_length() + 7) // 8


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, prefix shared with the one before) in sorted order; ``runs``: sorted keys, and their shared prefixes.

    A loser tree: each inner node keeps the loser of its match and the prefix that it shares with the winner, which has
    since gone up. A new key enters with its shared prefix in its own run. Of two rivals that share different lengths with
    the last winner, the one that shares more is smaller; bytes are compared only on equal lengths, beyond them.
    """
    k = 1 << max(0, len(runs) - 1).bit_length()
    keys = [r[0] for r in runs] + [[]] * (k - len(runs))
    shared = [r[1] for r in runs] + [[]] * (k - len(runs))
    at = [0] * k
    head: list[bytes | None] = [x[0] if x else None for x in keys]
    loser, known = [0] * k, [0] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        x, y = head[a], head[b]
        if y is None or (x is not None and x <= y):
            a, b, x, y = b, a, y, x
        loser[node], known[node] = a, 0 if x is None or y is None else _first_difference(x, y, 0)
        return b

    best, common = play(1), 0
    if k == 1:
        best = 0
    while head[best] is not None:
        i = at[best]
        yield best, i, common
        at[best] = i = i + 1
        if i < len(keys[best]):
            own, mine = keys[best][i], shared[best][i]
            head[best] = own
        else:
            own = head[best] = None
            mine = -1
        run, node = best, (best + k) >> 1
        while node:
            rival, theirs = loser[node], known[node]
            other = head[rival]
            if other is not None:
                if own is None or theirs > mine:
                    loser[node], known[node] = run, mine
                    run, own, mine = rival, other, theirs
                elif theirs == mine:
                    m = _first_difference(own, other, mine)
                    if other[m:] < own[m:]:
                        loser[node], known[node] = run, m
                        run, own, mine = rival, other, theirs
                    else:
                        known[node] = m
            node >>= 1
        best, common = run, mine


def earlier_copies(shared: np.ndarray, right_n: np.ndarray, back: np.ndarray, back_n: np.ndarray, doc: np.ndarray, pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (document, start, end) of strings around anchors that start earlier as well.

    ``shared``: bytes right of each anchor shared with the anchor before it in sorted order. A string that starts i bytes
    left of its anchor has an earlier copy if another anchor agrees in i bytes to the left and length - i to the right;
    for each i, classes by both are runs of the two sorted orders.
    """
    n = len(doc)
    order = np.lexsort([back_n, *reversed(_columns(back))])
    left_shared = common_prefix(back[order], back_n[order])
    rank = np.empty(n, np.int64)
    rank[np.lexsort((pos, doc))] = np.arange(n)
    low, high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    left = np.empty(n, np.int64)
    for i in range(length - Q + 1):
        ok = np.nonzero((right_n >= length - i) & (back_n >= i))[0]
        if len(ok) < 2:
            continue
        left[order] = np.cumsum(left_shared < i)
        right = np.cumsum(shared < length - i)
        both = right[ok] * (n + 1) + left[ok]
        s = np.lexsort((rank[ok], both))
        later = ok[s[1:][both[s[1:]] == both[s[:-1]]]]
        low[later] = np.where(low[later] < 0, i, low[later])
        high[later] = i
    hit = np.nonzero(high >= 0)[0]
    return doc[hit], pos[hit] - high[hit], pos[hit] - low[hit] + length


def fingerprints(raw: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Two 64-bit hashes of the ``length`` bytes from each place."""
    m = np.zeros((len(start), length + -length % 8), np.uint8)
    m[:, :length] = raw[start[:, None] + np.arange(length)]
    out = np.empty((len(start), 2), np.uint64)
    for k, seed in enumerate((np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))):
        h = np.full(len(start), seed)
        for word in m.view("<u8").T:
            h = mix64(h * seed + word)
        out[:, k] = h
    return out


def repeats_among(windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (fingerprint, fingerprint, document, start), without those of which the same window starts earlier; and the
    spans (document, start, end) of the latter."""
    w = windows[np.lexsort(windows.T[::-1])]
    again = np.zeros(len(w), bool)
    again[1:] = (w[1:, :2] == w[:-1, :2]).all(axis=1)
    fresh = ~again
    fresh[1:] |= (w[1:, 2:] != w[:-1, 2:]).any(axis=1)  # a window met twice through two anchors isn't a repeat
    spans = w[again & fresh, 2:]
    return w[~again], np.concatenate([spans, spans[:, 1:] + length], axis=1)


def _span_rows(doc: np.ndarray, start: np.ndarray, end: np.ndarray, parts: int, kind: int = 1) -> list[tuple]:
    """(bucket, kind, data): merged spans, one row for each bucket of documents."""
    doc, start, end = merge_spans(doc, start, end)
    return [(p, kind, np.stack(own, axis=1).astype("<i8").tobytes()) for p, *own in _dealt(bucket_of(doc, parts), doc, start, end)]


def sorted_runs(docs: DataFrame, length: int, parts: int, hot: np.ndarray, most: int = 60_000, most_windows: int = 250_000) -> DataFrame:
    """Rows (part, kind, data): kind 0 a front-coded run of one range, kind 2 windows around hot q-grams by the range of
    their fingerprint, kind 1 spans settled inside a task, by bucket. ``hot``: sorted keys of the hot q-grams."""
    names = ["part", "kind", "data"]

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        part, kind, data = zip(*rows, strict=True)
        return _batch(names, pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary()))

    def flush(found: list[tuple]) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*found, strict=True)]
        right, back, right_n, back_n, doc, pos, h = cols
        order = np.lexsort([pos, doc, back_n, *reversed(_columns(back)), right_n, *reversed(_columns(right)), h])
        right, back, right_n, back_n, doc, pos, h = (x[order] for x in cols)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (right_n[1:] == right_n[:-1]) & (back_n[1:] == back_n[:-1])
        again[1:] &= (right[1:] == right[:-1]).all(axis=1) & (back[1:] == back[:-1]).all(axis=1)
        settled = again & (right_n + back_n >= length)
        rows = _span_rows(doc[settled], (pos - back_n)[settled], (pos + right_n)[settled], parts)
        right, back, right_n, back_n, doc, pos, h = (x[~again] for x in (right, back, right_n, back_n, doc, pos, h))
        key = np.concatenate([h.astype(">u8").view(np.uint8).reshape(-1, 8), right], axis=1)
        for p, a, b in zip(*_ranges(part_of(h, parts)), strict=True):
            rows.append((p, 0, front_coded(key[a:b], right_n[a:b] + 8, back[a:b], back_n[a:b], doc[a:b], pos[a:b])))
        return rows_of(rows)

    def flush_windows(found: list[np.ndarray]) -> pa.RecordBatch:
        first, spans = repeats_among(np.concatenate(found), length)
        rows = _span_rows(*spans.T, parts)
        rows += [(p, 2, own.astype("<i8").tobytes()) for p, own in _dealt(part_of(first[:, 0].view(np.uint64), parts), first)]
        return rows_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size, windows, n_windows = [], 0, [], 0
        for whole in batches:
            for batch in split_batch(whole, "text", TEXT_BYTES):
                offsets, raw = binary_buffers(batch.column(1))
                at, doc, h, small, least = anchors(raw, offsets, length)
                marks, ids = batch.column(2), batch.column(0).to_numpy()
                keep = np.zeros(len(at), bool)
                cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                low32 = h.astype("<u4")
                for i in range(batch.num_rows):
                    if cut[i + 1] > cut[i]:
                        keep[cut[i] : cut[i + 1]] = np.isin(low32[cut[i] : cut[i + 1]], np.frombuffer(marks[i].as_py(), "<u4"))
                at, doc, h, small = at[keep], doc[keep], h[keep], small[keep]
                if len(hot):
                    key = gram_key(h, parts)
                    k = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                    is_hot = hot[k] == key
                    for i in range(0, int(is_hot.sum()), most_windows // length):
                        own = np.nonzero(is_hot)[0][i : i + most_windows // length]
                        start = (at[own][:, None] - np.arange(length - Q + 1)).ravel()
                        of, mark = (np.repeat(x[own], length - Q + 1) for x in (doc, small))
                        ok = (start >= offsets[of]) & (start + length <= offsets[of + 1])
                        start, of, mark = start[ok], of[ok], mark[ok]
                        ok = least[start] == mark  # other windows have another least q-gram
                        start, of = start[ok], of[ok]
                        print_ = fingerprints(raw, start, length).view(np.int64)
                        windows.append(np.concatenate([print_, ids[of][:, None], (start - offsets[of])[:, None]], axis=1))
                        n_windows += len(start)
                        if n_windows >= most_windows:
                            yield flush_windows(windows)
                            windows, n_windows = [], 0
                    at, doc, h = at[~is_hot], doc[~is_hot], h[~is_hot]
                for i in range(0, len(at), most):
                    a, d = at[i : i + most], doc[i : i + most]
                    found.append((*windows_of(raw, a, offsets[d], offsets[d + 1], length), ids[d], a - offsets[d], h[i : i + most]))
                    size += len(a)
                    if size >= most:
                        yield flush(found)
                        found, size = [], 0
        if size:
            yield flush(found)
        if n_windows:
            yield flush_windows(windows)

    return docs.mapInArrow(run, "part int, kind int, data binary")


def _ranges(part: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Parts of a sorted column, and where each begins and ends."""
    first, end = _runs_of(part)
    return part[first].tolist(), first, end


def merged_spans(runs: DataFrame, length: int, parts: int, most: int = 40_000) -> DataFrame:
    """(doc_id, spans): for each document the spans that the ranges and the tasks found, as pairs of 64-bit numbers."""

    def settle(chunk: list[tuple], runs: list[Run]) -> tuple:
        which, index, shared = np.array(chunk, np.int64).T
        right_n = np.array([len(runs[r].keys[i]) - 8 for r, i, _ in chunk], np.int64)
        doc, pos, back_n, start = (np.empty(len(chunk), np.int64) for _ in range(4))
        back = np.zeros((len(chunk), length - Q), np.uint8)
        for r in np.unique(which):
            m = np.nonzero(which == r)[0]
            own, i = runs[r], index[m]
            doc[m], pos[m], back_n[m] = own.doc[i], own.pos[i], own.back_n[i]
            start[m] = (np.cumsum(own.back_n.astype(np.int64)) - own.back_n)[i]
            padded = np.concatenate([own.left, np.zeros(length - Q, np.uint8)])
            got = padded[start[m][:, None] + np.arange(length - Q)]
            got[np.arange(length - Q) >= back_n[m][:, None]] = 0
            back[m] = got
        shared = np.maximum(shared - 8, 0)
        shared[0] = 0
        return earlier_copies(shared, right_n, back, back_n, doc, pos, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data: dict[int, list[bytes]] = {}
        spans: list[tuple] = []
        windows: list[np.ndarray] = []
        for batch in batches:
            for part, kind, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 1:
                    spans.append(tuple(np.frombuffer(raw, "<i8").reshape(-1, 3).T))
                elif kind == 2:
                    windows.append(np.frombuffer(raw, "<i8").reshape(-1, 4))
                else:
                    data.setdefault(part, []).append(raw)
        if windows:
            spans.append(merge_spans(*repeats_among(np.concatenate(windows), length)[1].T))
            windows = []
        for part in list(data):
            runs = [Run(r) for r in data.pop(part)]
            group, chunk = [], []
            for item in merge_runs([(r.keys, r.shared) for r in runs]):
                if item[2] < 8 + Q:  # another q-gram begins
                    if len(group) > 1:
                        chunk += group
                    group = []
                    if len(chunk) >= most:
                        spans.append(merge_spans(*settle(chunk, runs)))
                        chunk = []
                group.append(item)
            if len(group) > 1:
                chunk += group
            if chunk:
                spans.append(merge_spans(*settle(chunk, runs)))
        if spans:
            for p, _, raw in _span_rows(*(np.concatenate([s[i] for s in spans]) for i in range(3)), parts):
                yield _batch(["part", "data"], pa.array([p], pa.int32()), pa.array([raw], pa.binary()))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = [np.frombuffer(raw, "<i8").reshape(-1, 3) for batch in batches for raw in batch.column(1).to_pylist()]
        if spans:
            doc, start, end = merge_spans(*np.concatenate(spans).T)
            flat = np.stack([start, end], axis=1).astype("<i8")
            first, last = _runs_of(doc)
            for i in range(0, len(first), 5000):
                a, b = first[i : i + 5000], last[i : i + 5000]
                own = pa.array([flat[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary())
                yield _batch(["doc_id", "spans"], pa.array(doc[a], pa.int64()), own)

    met = runs.repartitionById(parts, F.col("part")).mapInArrow(run, "part int, data binary")
    return met.repartitionById(parts, F.col("part")).mapInArrow(gather, "doc_id long, spans binary")


def remove_repeats(
    docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text", keep_bytes: bool = False,
    hot: int = 4096, most_hot: int = 1 << 20, range_bytes: int = 16 << 20,
) -> DataFrame:
    """One row for each non-null id: bytes, removed bytes, maximal removed runs and the SHA-256 of what is left.

    Removed is each byte in a string of ``length`` bytes that also starts earlier: in a document with a smaller id, or
    earlier in its own. A null text is empty. Of rows that share an id the smallest text counts. ``keep_bytes`` adds
    the remaining bytes, and the removed runs as pairs of offsets.

    Of the q-grams that occur more than ``hot`` times the ``most_hot`` most frequent are dealt by whole windows (8 MB of
    hashes go to each task at most); the others by their ranges. Either way finds the same. A range holds the suffixes of
    about ``range_bytes`` of text.
    """
    if length < Q + 8:
        raise ValueError(f"length must be {Q + 8} or more")
    spark = docs.sparkSession
    ship(spark)
    long = docs.where(F.col(key).isNotNull() & (F.octet_length(text) >= length))
    size = long.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    parts = max(partitions_for(spark), -(-size // range_bytes))
    base = one_per_id(docs, key, text)
    source = long.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text_"))
    found = materialize(repeated(announce(source, length, parts), parts, hot), "marks")
    often = found.where(F.col("doc_id").isNull()).orderBy(F.desc("n"), "gram").select("gram").limit(most_hot).collect()
    marked = base.join(found.where(F.col("doc_id").isNotNull()).select("doc_id", "marks"), "doc_id").select("doc_id", "text", "marks")
    spans = merged_spans(sorted_runs(marked, length, parts, np.array(sorted(r.gram for r in often), np.int64)), length, parts)
    names = [c.split()[0] for c in RESULT.split(", ")] + ["kept", "spans"] * keep_bytes
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64()))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_batch(whole, "text"):
                offsets, raw = binary_buffers(batch.column(1))
                rows = []
                for i, own in enumerate(batch.column(2)):
                    body = raw[offsets[i] : offsets[i + 1]]
                    start, end = np.frombuffer(own.as_py() or b"", "<i8").reshape(-1, 2).T
                    kept = body.tobytes()
                    if len(start):
                        gone = np.zeros(len(body) + 1, np.int8)
                        gone[start] += 1
                        gone[end] -= 1
                        kept = body[np.cumsum(gone[:-1]) == 0].tobytes()
                    row = (len(body), len(body) - len(kept), len(start), hashlib.sha256(kept).hexdigest())
                    rows.append(row + ((kept, np.stack([start, end], axis=1).tolist()) if keep_bytes else ()))
                cols = list(zip(*rows, strict=True))
                yield _batch(names, batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds[: len(cols)], strict=True)))

    out = base.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return out.mapInArrow(cut, RESULT + ", kept binary, spans array<array<long>>" * keep_bytes)
