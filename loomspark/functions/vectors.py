"""Vector and scalar mathematics as Column builders over array<double>."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def gaussian(a: Column, b: Column, variance: float = 1.0) -> Column:
    return F.exp(-squared_distance(a, b) / (2 * variance))


def polynomial(a: Column, b: Column, degree: int = 2) -> Column:
    return F.pow(dot(a, b), F.lit(degree))


#: Similarities by name: larger is nearer.
SIMILARITY = {
    "euclidean": lambda a, b: -euclidean(a, b),
    "cosine": cosine,
    "gaussian": gaussian,
    "polynomial": polynomial,
    "linear": dot,
}


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def normal_pdf(x: Column, mean: Column, variance: Column) -> Column:
    return F.exp(-((x - mean) * (x - mean)) / (2 * variance)) / F.sqrt(2 * math.pi * variance)


def log_likelihood(y: Column, p: Column) -> Column:
    return F.sum(y * F.ln(p) + (1 - y) * F.ln(1 - p))


def sign_up(x: Column) -> Column:
    """1 from zero on, else -1."""
    return F.when(x >= 0, 1).otherwise(-1)


def fixed(x: Column, digits: int = 3) -> Column:
    """x with so many decimals, rounded as C's printf does: by the exact binary value, ties to even. Null stays null.

    Whether x * 10^digits lies above or below half-way is told by the product's rounding error, which is exact
    (the factors' high and low halves are multiplied apart). For magnitudes below 1e15 after scaling.
    """
    scale = 10**digits
    a = F.abs(x)
    big = a * F.lit(134217729.0)  # 2^27 + 1
    high = big - (big - a)
    y = a * F.lit(float(scale))
    error = (high * F.lit(float(scale)) - y) + (a - high) * F.lit(float(scale))
    k = F.floor(y)
    part = y - k
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (k % 2 == 1))))
    n = k + F.when(up, 1).otherwise(0)
    sign = F.when(x < 0, "-").otherwise("")
    whole = F.floor(n / scale) if not digits else (n - n % scale) / scale
    return F.concat(sign, whole.cast("long").cast("string"), *([F.lit("."), F.lpad((n % scale).cast("long").cast("string"), digits, "0")] if digits else []))


def bin_of(x: Column, cuts: list[float]) -> Column:
    """0 up to the first cut, i up to cut i + 1, len(cuts) beyond; null stays null."""
    found = reduce(lambda rest, iv: F.when(x <= F.lit(iv[1]), iv[0]).otherwise(rest), reversed(list(enumerate(cuts))), F.lit(len(cuts)))
    return F.when(x.isNotNull(), found)


def over(x: Column, limit: Column) -> Column:
    """0 up to the limit, 1 above, null for null."""
    return F.when(x.isNotNull(), F.when(x > limit, 1).otherwise(0))


def min_max(x: Column, low: Column, high: Column) -> Column:
    return (x - low) / F.nullif(high - low, F.lit(0.0))


def z_score(x: Column, mean: Column, sd: Column) -> Column:
    return (x - mean) / F.nullif(sd, F.lit(0.0))


def manhattan(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.abs(x1 - x2) + F.abs(y1 - y2)


def grid_euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def as_label(prediction: Column, cut: float | None = None) -> Column:
    """A predicted number as a label: the nearest whole number, halves to even; with a cut, 1 from it on and 0 below."""
    return F.bround(prediction).cast("int") if cut is None else F.when(prediction.isNotNull(), F.when(prediction >= cut, 1).otherwise(0))


def one_hot(c: Column, values: list) -> Column:
    """One position a value; null gives all zeros."""
    return F.array(*[F.coalesce((c == F.lit(v)).cast("double"), F.lit(0.0)) for v in values])


def with_bias(features: Column) -> Column:
    return F.concat(F.array(F.lit(1.0)), features)


def pick(features: Column, indices: list[int]) -> Column:
    """Positions from 0, in the order asked for."""
    return F.array(*[F.element_at(features, i + 1) for i in indices])


def busy_fibonacci(n: int = 17):
    """Arrow UDF that spends time: the n-th Fibonacci number by plain recursion, added as zero to its input."""
    def fib(k: int) -> int:
        return k if k < 2 else fib(k - 1) + fib(k - 2)

    @F.pandas_udf("double")
    def spend(x: pd.Series) -> pd.Series:
        return x.map(lambda v: v + 0 * fib(n))

    return spend
