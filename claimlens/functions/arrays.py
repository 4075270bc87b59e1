"""Array / vector scalar functions as JVM-side expressions.

All are ``Column -> Column``; higher-order functions keep the work inside the
executor JVM, no Python per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` for ``body`` so that it is computed once per row: a lambda's
    variable, unlike a repeated expression, is never evaluated again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pad(arr: Column, length: Column, value) -> Column:
    """right-pad ``arr`` with ``value`` up to ``length`` (never truncates)."""
    return F.concat(arr, F.array_repeat(F.lit(value), F.greatest(length - F.size(arr), F.lit(0))))


def pad_to(arr: Column, length: Column, value: Column) -> Column:
    return F.concat(arr, F.array_repeat(value, F.greatest(length - F.size(arr), F.lit(0))))


def count_mask(n: Column, length: Column) -> Column:
    """[1]*n + [0]*(length-n) as ``transform(sequence)``."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: (i < n).cast("int"))


def nonzero(vec: Column) -> Column:
    """1 when some component is not 0 (the length-mask rule)."""
    return F.exists(vec, lambda x: x != 0).cast("int")


def sigmoid(x: Column) -> Column:
    """F8."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def vsum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def hadamard(a: Column, b: Column) -> Column:
    """elementwise product."""
    return F.zip_with(a, b, lambda x, y: x * y)


def vtanh(a: Column) -> Column:
    return F.transform(a, lambda x: F.tanh(x))


def softmax(a: Column) -> Column:
    """max-shifted softmax of an array."""
    each = lambda m: F.transform(a, lambda x: F.exp(x - m))
    return let(let(F.array_max(a), each), lambda e: let(vsum(e), lambda s: F.transform(e, lambda x: x / s)))


def log_softmax(a: Column) -> Column:
    """max-shifted log-softmax of an array."""
    lse = lambda m: F.log(vsum(F.transform(a, lambda x: F.exp(x - m)))) + m
    return let(let(F.array_max(a), lse), lambda s: F.transform(a, lambda x: x - s))


def layer_norm(vec: Column, gain: Column, bias: Column, eps: float = 1e-6) -> Column:
    """gain * (x - mean) / (std + eps) + bias, std with n-1 (ddof 1).

    Mean and deviation are bound once a row; as repeated expressions they would be worked out again for every component."""
    n = F.size(vec)

    def rows(mean: Column) -> Column:
        var = F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / (n - 1)
        return let(F.sqrt(var) + F.lit(eps), lambda sd: F.transform(vec, lambda x: (x - mean) / sd))

    z = let(vsum(vec) / F.nullif(n, F.lit(0)), rows)
    return F.zip_with(F.zip_with(z, gain, lambda x, g: x * g), bias, lambda x, b: x + b)


def matvec(vec: Column, w_cols: list[list[float]], bias: list[float] | None = None) -> Column:
    """F12 for few outputs: y_j = sum_i x_i W[i][j] + b_j with W given column-wise
    (``w_cols[j]`` = column j). Wide layers use the Arrow-batch path instead."""
    outs = []
    for j, col in enumerate(w_cols):
        wj = F.array(*[F.lit(float(v)) for v in col])
        y = dot(vec, wj)
        if bias is not None:
            y = y + F.lit(float(bias[j]))
        outs.append(y)
    return F.array(*outs)
