"""Column expressions on arrays of doubles.

Sums over a known width are written out term by term, so that Spark compiles them into one loop body; beyond
``GENERATED`` terms the compiled method would be too large and higher-order functions take over.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

GENERATED = 200
EPSILON = float(np.finfo(float).eps)


def squared_distance(a: str, b: str, width: int) -> Column:
    """Squared Euclidean distance of two vector columns, named by SQL text."""
    if width <= GENERATED:
        return F.expr(" + ".join(f"({a}[{k}] - {b}[{k}]) * ({a}[{k}] - {b}[{k}])" for k in range(width)))
    return F.aggregate(F.zip_with(F.expr(a), F.expr(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def clamp_unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def parse_line(line: Column) -> Column:
    """Comma-separated doubles; trailing empty fields are dropped, any other bad field fails the query."""
    return F.split(F.regexp_replace(line, ",+$", ""), ",").cast("array<double>")


def self_tuning_kernel(d: Column, mean_i: Column, mean_j: Column, power: int = 2) -> Column:
    """exp(-d**power / (mean_i * mean_j)); where a mean is 0, 1 for equal points and 0 for others."""
    scaled = F.try_divide(F.pow(d, F.lit(float(power))), mean_i * mean_j)
    return F.coalesce(F.exp(-scaled), F.when(d == 0, 1.0).otherwise(0.0))


def width_kernel(d: Column, sigma: float, twice: bool = False, power: int = 2) -> Column:
    """exp(-d**power / sigma**2), or with 2 sigma**2 as the landmark strategy has it."""
    if sigma == 0:
        return F.when(d == 0, 1.0).otherwise(0.0)
    return F.exp(-F.pow(d, F.lit(float(power))) / F.lit((2.0 if twice else 1.0) * sigma * sigma))


def bin_of(x: Column, low: Column, step: Column, bins: int = 20) -> Column:
    """Number of the first bin that holds x, borders included, so a border belongs to the lower bin. The last bin reaches
    0.1 further; a value in no bin counts for bin 0."""
    out = None
    for m in range(bins):
        lower = low + step * m
        upper = lower + step + 0.1 if m == bins - 1 else lower + step
        out = (F.when if out is None else out.when)((x >= lower) & (x <= upper), m)
    return out.otherwise(0)


def signature(v: str, features: list[int], thresholds: list[float]) -> Column:
    """Bit b is set if the b-th drawn feature reaches its threshold."""
    return F.expr(" + ".join(f"shiftleft(CAST({v}[{f}] >= CAST('{t!r}' AS DOUBLE) AS BIGINT), {b})" for b, (f, t) in enumerate(zip(features, thresholds, strict=True))))


def unit_row(e: Column, width: int) -> Column:
    """L2-normalised row; a row of zeros becomes a row of ones."""
    n = norm(e)
    return F.when(n == 0, F.array_repeat(F.lit(1.0), width)).otherwise(F.transform(e, lambda x: x / n))


def java_doubles(seed: int, n: int) -> list[float]:
    """The first doubles of Java's linear congruential generator; multiplier, increment and widths are fixed values of
    its public specification."""
    state, out = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1), []
    for _ in range(n):
        bits = []
        for width in (26, 27):
            state = (state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
            bits.append(state >> (48 - width))
        out.append(((bits[0] << 27) + bits[1]) / (1 << 53))
    return out
