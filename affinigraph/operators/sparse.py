"""Sparse points: vectors of many features of which each has few, compared without being filled up.

A sparse point's ``v`` is a struct of size, indices (ascending) and values. Products of a pair of blocks come from inverted
lists: what both blocks have of a feature is multiplied, and features that many rows share go through one dense product.
A squared distance by norms and product is used where its bound on the error, relative to the distance, is small enough,
and differences of the entries elsewhere and for every neighbour that is reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blocks import turns
from ..functions.vectors import EPSILON

SPARSE = "struct<size:int,indices:array<int>,values:array<double>>"
#: The largest relative error of a distance by norms that is let pass.
PRECISION = 1e-6
#: Features with more rows of a block than this are multiplied densely, so many at once.
HEAVY, SLICE = 32, 4096


def is_sparse(points: DataFrame, v: str = "v") -> bool:
    return dict(points.dtypes)[v] == SPARSE


def sparse(v: Column) -> Column:
    """The sparse form of an array of doubles."""
    at = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e["x"] != 0)
    return F.struct(F.size(v).alias("size"), F.transform(at, lambda e: e["i"]).alias("indices"), F.transform(at, lambda e: e["x"]).alias("values")).cast(SPARSE)


def dense(v: Column) -> Column:
    """The array of all values of a sparse vector."""
    entries = F.map_from_arrays(v["indices"], v["values"])
    return F.transform(F.sequence(F.lit(0), v["size"] - 1), lambda i: F.coalesce(F.element_at(entries, i), F.lit(0.0)))


def from_entries(entries: DataFrame, key: str, feature: str, value: str, size: int) -> DataFrame:
    """Points (id, v) of rows (key, feature, value), one for each entry that is not zero."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(feature).cast("int").alias("i"), F.col(value).cast("double").alias("x"))))
    v = F.struct(F.lit(size).alias("size"), F.transform("e", lambda e: e["i"]).alias("indices"), F.transform("e", lambda e: e["x"]).alias("values"))
    return entries.where(F.col(value) != 0).groupBy(F.col(key).cast("long").alias("id")).agg(pairs.alias("e")).select("id", v.cast(SPARSE).alias("v"))


def read_sparse(spark: SparkSession, path: str, features: int | None = None) -> DataFrame:
    """(label, v) of lines ``label index:value ...`` with indices from 1, ascending; other lines fail the query. The number of
    features is the largest index if none is given."""
    parts = F.split(F.trim("value"), r"\s+")
    e = F.transform(F.filter(F.slice(parts, 2, F.size(parts)), lambda x: x != ""), lambda x: F.split(x, ":"))
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts[0].cast("double").alias("label"), e.alias("e"))
    index = F.transform("e", lambda x: x[0].cast("int") - 1)
    rows = rows.select("label", index.alias("indices"), F.transform("e", lambda x: x[1].cast("double")).alias("values"))
    if features is None:
        features = (rows.agg(F.max(F.array_max("indices"))).first()[0] or -1) + 1
    rising = F.forall(F.sequence(F.lit(0), F.size("indices")), lambda i: F.coalesce(F.get("indices", i) > F.coalesce(F.get("indices", i - 1), F.lit(-1)), F.lit(True)))
    inside = F.coalesce(F.array_max("indices"), F.lit(-1)) < features
    checked = F.when(rising & inside, F.struct(F.lit(features).alias("size"), "indices", "values").cast(SPARSE)).otherwise(F.raise_error(F.lit("indices must rise and stay within the features")))
    return rows.select("label", checked.alias("v"))


@dataclass
class Rows:
    """Sparse rows one after another: where each ends, and features and values of all."""

    end: np.ndarray
    feature: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, column: pa.Array | pa.ChunkedArray) -> Rows:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        _, indices, values = column.flatten()  # a slice of the children, as the column may be one
        return cls(np.cumsum(indices.value_lengths().to_numpy()).astype(np.int64), indices.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy(zero_copy_only=False).astype(float))

    def __len__(self) -> int:
        return len(self.end)

    @property
    def start(self) -> np.ndarray:
        return np.concatenate([[0], self.end[:-1]]).astype(np.int64)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.end - self.start)

    def norms(self) -> np.ndarray:
        return np.bincount(self.row(), self.value * self.value, len(self))

    @cached_property
    def by_feature(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features in order, and the row and value of each entry: the inverted lists, made once."""
        order = np.argsort(self.feature, kind="stable")
        return self.feature[order], self.row()[order], self.value[order]

    def take(self, rows: np.ndarray) -> Rows:
        n = (self.end - self.start)[rows]
        at = np.repeat(self.start[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return Rows(np.cumsum(n), self.feature[at], self.value[at])


def products(x: Rows, y: Rows) -> np.ndarray:
    """Inner products of all rows of x and y."""
    out = np.zeros((len(x), len(y)))
    f, rows, vals = x.by_feature
    g, cols, wals = y.by_feature
    shared = np.unique(f)
    at = np.minimum(np.searchsorted(g, shared), max(0, len(g) - 1))
    shared = shared[g[at] == shared] if len(g) else shared[:0]
    a, b = np.searchsorted(f, shared), np.searchsorted(f, shared, "right")
    c, d = np.searchsorted(g, shared), np.searchsorted(g, shared, "right")
    heavy = np.nonzero(d - c > HEAVY)[0]
    spread = lambda first, end, which: (np.repeat(first[which], (end - first)[which]) + np.arange((end - first)[which].sum()) - np.repeat(np.cumsum((end - first)[which]) - (end - first)[which], (end - first)[which]), np.repeat(np.arange(len(which)), (end - first)[which]))
    for s in range(0, len(heavy), SLICE):
        which = heavy[s : s + SLICE]
        left, right = np.zeros((len(x), len(which))), np.zeros((len(which), len(y)))
        at, k = spread(a, b, which)
        left[rows[at], k] = vals[at]
        at, k = spread(c, d, which)
        right[k, cols[at]] = wals[at]
        out += left @ right
    light = np.nonzero(d - c <= HEAVY)[0]
    at, k = spread(a, b, light)  # each entry of x in a light feature meets that feature's list of y
    n = (d - c)[light][k]
    for s in range(0, len(at), 65_536):
        part, m = at[s : s + 65_536], n[s : s + 65_536]
        i = np.repeat(part, m)
        j = np.repeat(c[light][k[s : s + 65_536]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        np.add.at(out, (rows[i], cols[j]), vals[i] * wals[j])
    return out


def differences(x: Rows, y: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs of rows (i, j) from the differences of their entries."""
    out = np.zeros(len(i))
    for s in range(0, len(i), 4096):
        p, q = x.take(i[s : s + 4096]), y.take(j[s : s + 4096])
        pair = np.concatenate([p.row(), q.row()])
        feature, value = np.concatenate([p.feature, q.feature]), np.concatenate([p.value, -q.value])
        order = np.lexsort((feature, pair))
        pair, feature, value = pair[order], feature[order], value[order]
        if len(pair):
            first = np.nonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (feature[1:] != feature[:-1])]))[0]
            out[s : s + 4096] = np.bincount(pair[first], np.add.reduceat(value, first) ** 2, len(p))
    return out


def squared_distances(x: Rows, y: Rows) -> np.ndarray:
    """Squared distances of all rows: by norms and products where the rounding of these, relative to the distance, stays within
    PRECISION, and by differences elsewhere."""
    dot = products(x, y)
    scale = x.norms()[:, None] + y.norms()[None]
    d = np.maximum(scale - 2 * dot, 0)
    i, j = np.nonzero(EPSILON * (scale + 2 * np.abs(dot)) > PRECISION * (d + EPSILON))
    d[i, j] = differences(x, y, i, j)
    return d


def nearest(x: Rows, y: Rows, ids: np.ndarray, t: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, place in y, squared distance) of the t nearest rows of y for each of x, ties to smaller ids, in order."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    own, to, dist = (np.concatenate(c) for c in zip(none, *nearest_in_turns(x, y, ids, t, rows), strict=True))
    return own, to, dist


def nearest_in_turns(x: Rows, y: Rows, ids: np.ndarray, t: int, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What nearest() finds, some rows of x after others."""
    top = y.norms().max(initial=0)
    for a, end in turns(len(x), len(y), rows):
        part = x.take(np.arange(a, end))
        d = squared_distances(part, y)
        limit = np.partition(d, t - 1, axis=1)[:, t - 1] if len(y) > t else np.full(len(part), np.inf)
        i, j = np.nonzero(d <= (limit * (1 + 2 * PRECISION) + 1e-12 * (part.norms() + top))[:, None])
        exact = differences(part, y, i, j)
        order = np.lexsort((ids[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < t
        yield i[keep] + a, j[keep], exact[keep]
