"""Column expressions on vectors: distance, grid cells, roles in a box."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

OUTER, MARGIN, INTERIOR = "OUTER_MARGIN", "INNER_MARGIN", "INNER_REGION"


def distance(a: Column, b: Column, dims: int) -> Column:
    """Euclidean distance, squares summed in dimension order: the same bits in any engine.

    Few dimensions are written out, which keeps them in generated code; many are folded.
    """
    if dims <= 16:
        terms = [(a[i] - b[i]) * (a[i] - b[i]) for i in range(dims)]
        return F.sqrt(sum(terms[1:], terms[0]))
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def finite(vec: Column, dims: int) -> Column:
    """Whether no coordinate is null, NaN or infinite."""
    if dims <= 16:
        return reduce(and_, [F.abs(vec[i]) < F.lit(math.inf) for i in range(dims)])
    return F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf)))


def cell(value: Column, eps: float) -> Column:
    """The grid cell of a coordinate; a hair wider than eps, so that rounding can't put two
    neighbours two cells apart."""
    return F.floor(value / F.lit(eps * (1 + 1e-9))).cast("long")


def role(vector: Column, bounds: Column, eps: float) -> Column:
    """Where a point lies in a box with bounds array<struct<lower, upper>>; null: not in its reach.

    Outside the box widened by eps in any dimension: null. Else outside the box: OUTER_MARGIN.
    Else within eps of any side: INNER_MARGIN. Else INNER_REGION.
    """

    def side(v: Column, b: Column) -> Column:
        low, high, e = b["lower"], b["upper"], F.lit(float(eps))
        return (
            F.when((v < low - e) | (v >= high + e), 3)
            .when((v < low) | (v >= high), 2)
            .when((v < low + e) | (v >= high - e), 1)
            .otherwise(0)
        )

    worst = F.array_max(F.zip_with(vector, bounds, side))
    return F.when(worst == 2, OUTER).when(worst == 1, MARGIN).when(worst == 0, INTERIOR)
