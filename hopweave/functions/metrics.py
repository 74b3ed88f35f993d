"""Distances between vector columns as Column expressions, computed in double precision and summed from the left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Jaccard distances at or above this are no neighbours (fixed value).
JACCARD_VALID = 1 - 1e-5


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _pairs(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return total(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))


def squared_l2(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: (x - y) * (x - y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def dot(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x * y)


def inner_product(a: Column, b: Column) -> Column:
    """Smaller is closer: the negative dot product."""
    return -dot(a, b)


def l1(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: F.abs(x - y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def angular(a: Column, b: Column) -> Column:
    """1 - cosine."""
    return 1 - dot(a, b) / (norm(a) * norm(b))


def cosine(a: Column, b: Column) -> Column:
    """Smaller is closer: the negative cosine."""
    return -(dot(a, b) / (norm(a) * norm(b)))


def bit_hamming(a: Column, b: Column) -> Column:
    """Share of unequal bits of two boolean (or 0/1) arrays."""
    return total(F.zip_with(a, b, lambda x, y: (x != y).cast("double"))) / F.size(a)


def jaccard(a: Column, b: Column) -> Column:
    """1 - |A n B| / |A u B| of arrays of distinct items; 1 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 1.0).otherwise(1 - both / (F.size(a) + F.size(b) - both))


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "squared_l2": squared_l2,
    "euclidean": euclidean,
    "ip": inner_product,
    "l1": l1,
    "cosine": cosine,
    "angular": angular,
    "hamming": bit_hamming,
    "jaccard": jaccard,
}


def metric(name: str) -> Callable[[Column, Column], Column]:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; one of {', '.join(METRICS)}")
    return METRICS[name]


def valid(name: str, distance: Column) -> Column:
    """Whether a pair at this distance counts as neighbours at all."""
    return distance < JACCARD_VALID if name == "jaccard" else F.lit(True)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def binarised(a: Column) -> Column:
    return F.transform(a, lambda x: x > 0)


def interpolated(x0: Column, y0: Column, x1: Column, y1: Column, x: Column) -> Column:
    """The line through two points at x; 0 outside of them."""
    inside = (x >= F.least(x0, x1)) & (x <= F.greatest(x0, x1))
    return F.when(inside, F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))).otherwise(0.0)


def random_level(key: Column, m: int, seed: int = 100) -> Column:
    """floor(-ln U / ln m) with U in (0, 1] from a hash of the key."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) + 1) / F.lit(float(1 << 30))
    return F.floor(-F.log(u) / F.log(F.lit(float(m)))).cast("int")


def flattened(nested: Column) -> Column:
    return F.flatten(nested)


def nested(flat: Column, width: int) -> Column:
    """A flat array in rows of `width`; what does not fill a row is left out."""
    rows = F.floor(F.size(flat) / width).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(rows, F.lit(1)) - 1), lambda i: F.slice(flat, i * width + 1, width))
    return F.when(rows > 0, cut).otherwise(F.slice(cut, 1, 0))
