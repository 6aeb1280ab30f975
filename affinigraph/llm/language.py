"""Language identification with a byte convolutional network in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, max pooling keeps each filter's best answer
and a softmax names the language. The network is fitted on the driver on a bounded sample of labelled windows; prediction
runs over all windows of every whole text and averages their probabilities by window length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import binary_buffers, sampled, ship, split_batch

PREDICTION = "doc_id long, held_out boolean, lang_pred string, score double"
UNDETERMINED = "und"


@dataclass
class ByteConvNet:
    """Parameters and forward pass. Filters narrower than the widest have zero weights beyond their width."""

    labels: list[str]
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    dim: int = 8
    seed: int = 7

    def __post_init__(self):
        rng, top, n = np.random.default_rng(self.seed), max(self.widths), len(self.widths) * self.filters
        self.emb = rng.normal(0, 0.5, (256, self.dim)).astype(np.float32)
        self.mask = np.repeat(np.concatenate([np.repeat((np.arange(top) < w)[:, None], self.filters, 1) for w in self.widths], 1), self.dim, 0).astype(np.float32)
        self.kernel = (rng.normal(0, 0.3, (top * self.dim, n)) * self.mask).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, len(self.labels))).astype(np.float32)
        self.out_bias = np.zeros(len(self.labels), np.float32)

    def _patches(self, x: np.ndarray) -> np.ndarray:
        top = max(self.widths)
        e = self.emb[x].reshape(len(x), -1)
        shape = (len(x), x.shape[1] - top + 1, top * self.dim)
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(e, shape, (e.strides[0], self.dim * 4, 4)))

    def pooled(self, x: np.ndarray, places: bool = False):
        p = self._patches(x)
        y = (p.reshape(-1, p.shape[2]) @ self.kernel).reshape(p.shape[0], p.shape[1], -1)
        top = y.max(axis=1) + self.bias
        return (np.maximum(top, 0), top, y.argmax(axis=1), p) if places else np.maximum(top, 0)

    def probabilities(self, x: np.ndarray, batch: int = 64) -> np.ndarray:
        """Softmax for each window; ``x``: bytes, one row a window."""
        h = np.concatenate([self.pooled(x[i : i + batch]) for i in range(0, len(x), batch)]) if len(x) else np.zeros((0, len(self.bias)), np.float32)
        z = h @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 3e-3) -> ByteConvNet:
        rng, names = np.random.default_rng(self.seed + 1), ("emb", "kernel", "bias", "out", "out_bias")
        moment = {k: [np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))] for k in names}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                xb, yb = x[order[i : i + batch]], y[order[i : i + batch]]
                h, raw, at, p = self.pooled(xb, places=True)
                z = h @ self.out + self.out_bias
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
                z[np.arange(len(yb)), yb] -= 1
                z /= len(yb)
                back = (z @ self.out.T) * (raw > 0)
                best = p[np.arange(len(xb))[:, None], at]
                grad_patch = back[:, :, None] * self.kernel.T[None]
                grad_emb = np.zeros_like(self.emb)
                for k in range(max(self.widths)):
                    np.add.at(grad_emb, xb[np.arange(len(xb))[:, None], at + k], grad_patch[:, :, k * self.dim : (k + 1) * self.dim])
                grads = {"emb": grad_emb, "kernel": np.einsum("bfd,bf->df", best, back) * self.mask, "bias": back.sum(0), "out": h.T @ z, "out_bias": z.sum(0)}
                step += 1
                for k in names:
                    m, v = moment[k]
                    m += 0.1 * (grads[k] - m)
                    v += 0.001 * (grads[k] ** 2 - v)
                    setattr(self, k, (getattr(self, k) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
        return self

    def predict_texts(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Mean window probabilities, weighted by length, for each text of a buffer; rows of zeros for empty texts."""
        sizes = np.diff(offsets)
        counts = -(-sizes // self.window)
        owner = np.repeat(np.arange(len(sizes)), counts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = offsets[owner] + nth * self.window
        length = np.minimum(self.window, offsets[owner + 1] - start)
        padded = np.concatenate([raw, np.zeros(self.window, np.uint8)])
        total = np.zeros((len(sizes), len(self.labels)))
        for i in range(0, len(owner), 4096):
            s, n = start[i : i + 4096], length[i : i + 4096]
            x = padded[s[:, None] + np.arange(self.window)]
            x[np.arange(self.window) >= n[:, None]] = 0
            np.add.at(total, owner[i : i + 4096], self.probabilities(x) * n[:, None])
        return total / np.maximum(sizes, 1)[:, None]


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = 6000, window: int = 256) -> ByteConvNet | None:
    """Fit on one window from each of at most ``sample`` labelled documents that are not held out, chosen by a hash.

    Only these windows reach the driver (1.5 MB by default). None if there is nothing to learn from.
    """
    place = F.pmod(F.xxhash64(key, F.lit("place")), F.greatest(F.lit(1), F.length(text) - window + 1)) + 1
    known = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    rows = (
        sampled(known, F.xxhash64(key), sample).select(F.xxhash64(key).alias("h"), F.col(label).alias("y"), F.col(text).substr(place.cast("int"), F.lit(window)).alias("x"))
        .orderBy("h", "y", "x").limit(sample).collect()
    )
    if not rows:
        return None
    labels = sorted({r.y for r in rows})
    x = np.zeros((len(rows), window), np.uint8)
    for i, r in enumerate(rows):
        b = r.x.encode()[:window]
        x[i, : len(b)] = np.frombuffer(b, np.uint8)
    return ByteConvNet(labels, window=window).fit(x, np.array([labels.index(r.y) for r in rows]), epochs=max(12, min(60, 40_000 // len(rows))))


def identify(docs: DataFrame, model: ByteConvNet | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """Predicted language and its probability for every row. A null text or one without a letter is ``und`` with score 0,
    as is every text if there is no model. Only the text is looked at. ``keep``: columns to carry along, besides the text with ``keep_text``."""
    ship(docs.sparkSession)
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    source = docs.select(F.col(text), letters, *keep)
    source = source.toDF(*(f"c{i}" for i in range(len(source.columns))))
    schema = docs.select(*keep).schema
    if keep_text:
        schema = schema.add(text, "string")
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_batch(whole, 0):
                has = batch.column(1).to_numpy(zero_copy_only=False)
                if model is None:
                    pred, score = [UNDETERMINED] * len(has), np.zeros(len(has))
                else:
                    p = model.predict_texts(*binary_buffers(batch.column(0)))
                    best = p.argmax(axis=1)
                    pred = [model.labels[k] if ok else UNDETERMINED for k, ok in zip(best, has, strict=True)]
                    score = np.where(has, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], *batch.columns[:keep_text], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return source.mapInArrow(run, schema.add("lang_pred", "string").add("score", "double"))
