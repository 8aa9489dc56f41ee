"""Vector arithmetic as Column expressions.

With a known small ``dim`` the dot product is written out term by term, which stays in
generated code. A long sum would push the method around it (a join loop, say) over the
size the JVM compiles, so longer vectors use a higher-order function.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

# fixed values of the sigmoid table: 100,000 steps over [-6, 6]; the index
# factor is 100000 / 6 / 2 in integer arithmetic
SIGMOID_MAX = 6.0
SIGMOID_SIZE = 100_000
SIGMOID_FACTOR = 8333.0


UNROLL = 16


def dot(u: Column, v: Column, dim: int | None = None) -> Column:
    if dim is None or dim > UNROLL:
        return F.aggregate(
            F.zip_with(u, v, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x
        )
    return reduce(add, [u[i].cast("double") * v[i].cast("double") for i in range(dim)])


def norm(u: Column, dim: int | None = None) -> Column:
    return F.sqrt(dot(u, u, dim))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def sigmoid_table(x: Column) -> Column:
    """The 100,000-step table as a closed form; outside [-6, 6] the end entries."""
    index = (
        F.when(x > SIGMOID_MAX, F.lit(float(SIGMOID_SIZE - 1)))
        .when(x < -SIGMOID_MAX, F.lit(0.0))
        .otherwise(F.floor((x + SIGMOID_MAX) * SIGMOID_FACTOR).cast("double"))
    )
    e = F.exp((index * 2.0 / SIGMOID_SIZE - 1.0) * SIGMOID_MAX)
    return e / (e + 1.0)


def log_softmax(x: Column, ys: Column) -> Column:
    """``log(e^x / (e^x + sum e^y))``, shifted by the largest term."""
    top = F.greatest(x, F.coalesce(F.array_max(ys), x))
    total = F.aggregate(ys, F.exp(x - top), lambda s, y: s + F.exp(y - top))
    return x - top - F.log(total)


def scaled(u: Column, factor: Column) -> Column:
    return F.transform(u, lambda a: a.cast("double") * factor)


def plus(u: Column, v: Column) -> Column:
    return F.zip_with(u, v, lambda a, b: a.cast("double") + b.cast("double"))


def cosine(u: Column, v: Column, dim: int | None = None) -> Column:
    """Cosine similarity, 0.0 when either vector is zero."""
    lengths = norm(u, dim) * norm(v, dim)
    return F.when(lengths == 0.0, F.lit(0.0)).otherwise(dot(u, v, dim) / lengths)


def as_floats(u: Column) -> Column:
    return u.cast("array<float>")
