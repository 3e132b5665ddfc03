"""Vectors as arrays; all arithmetic in doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column, floor: float = 1e-12) -> Column:
    """v over its length, which counts as floor at least."""
    return F.transform(F.array(F.greatest(norm(v), F.lit(floor))), lambda n: F.transform(v, lambda x: x / n))[0]


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def sign_bits(v: Column) -> Column:
    """Signs of any number of dimensions as longs of 64 each: bit i of a long is set where its element i is positive."""
    word = lambda part: F.aggregate(F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / 64).cast("int") - 1, F.lit(0))), lambda w: word(F.slice(v, w * 64 + 1, F.lit(64))))


def bit_score(a: Column, b: Column, dim: Column | int = 64) -> Column:
    """dim minus twice the differing signs: rises with their agreement."""
    return (F.lit(dim) if isinstance(dim, int) else dim) - 2 * F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bce(x: Column, y: Column) -> Column:
    """Binary cross-entropy of a logit, in the form that does not overflow."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
