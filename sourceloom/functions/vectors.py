"""Vector columns, accumulated in DOUBLE."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores are compared on a grid of 1e-9, finer than the float32 vectors they come from,
# so that equal vectors tie whatever order a kernel adds their products in.
SCORE_GRID = 1e9


def to_vector(value: Column) -> Column:
    return value.cast("array<float>")


def literal_vector(values: Sequence[float]) -> Column:
    return F.lit([float(v) for v in values]).cast("array<float>")


def is_valid(vector: Column) -> Column:
    """True only for a vector with at least one number."""
    return F.coalesce(F.size(vector) > 0, F.lit(False))


def dot(a: Column, b: Column) -> Column:
    """Dot product; vectors of unequal length fail the job."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    total = F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)
    mismatch = F.raise_error(
        F.concat(
            F.lit("vector lengths differ: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string")
        )
    )
    return F.when(F.size(a) != F.size(b), mismatch.cast("double")).otherwise(total)


def norm(vector: Column) -> Column:
    squares = F.transform(vector, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v))


def on_grid(score: Column) -> Column:
    return F.rint(score * F.lit(SCORE_GRID)) / F.lit(SCORE_GRID)


def cosine_to(vector: Column, values: Sequence[float], length: Column | None = None) -> Column:
    """Cosine similarity to one fixed vector, whose norm is worked out once, not per row.
    ``length`` is the norm of the vector, where it is stored."""
    fixed = np.asarray(values, dtype=np.float32).astype(np.float64)
    own = norm(vector) if length is None else F.coalesce(length, norm(vector))
    score = F.try_divide(dot(vector, literal_vector(values)), own * F.lit(math.sqrt(float(fixed @ fixed))))
    return on_grid(F.coalesce(score, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0.0 where either vector has no length."""
    return on_grid(F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0)))
