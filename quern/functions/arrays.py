"""Expressions on arrays of numbers: one row's vector at a time, inside the JVM.

These suit short vectors. For long ones, use the numpy batches of ``quern.operators.blocks``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def sum_squares(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def rms(a: Column) -> Column:
    return F.sqrt(sum_squares(a) / F.size(a))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once: within the lambda of another function it would be for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spread(a: Column) -> Column:
    """Sample standard deviation; null for fewer than two numbers."""
    squares = once(mean(a), lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)))
    return F.sqrt(F.try_divide(squares, F.size(a) - 1))


def kth_smallest(a: Column, k: int) -> Column:
    """The k-th smallest, from 0; null beyond the end."""
    return F.try_element_at(F.array_sort(a), F.lit(k + 1))


def entropy_bits(p: Column) -> Column:
    """Entropy in bits; null unless the parts sum to 1."""
    bits = F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0)))
    return F.when(F.abs(total(p) - 1) <= 1e-5, bits)


def soft_threshold(x: Column, t: float) -> Column:
    """Toward zero by ``t``, and zero within."""
    return F.when(F.abs(x) > t, x - F.signum(x) * t).otherwise(F.lit(0.0))


def hard_threshold(x: Column, t: float) -> Column:
    return F.when(F.abs(x) > t, x).otherwise(F.lit(0.0))


def nearly_equal(a: Column, b: Column, tolerance: float = 1e-7) -> Column:
    return F.abs(a - b) <= tolerance


def _scaled(a: Column, shift: Column, scale: Column) -> Column:
    factor = F.when(scale.isNull() | (scale == 0), F.lit(1.0)).otherwise(scale)
    return once(F.struct(shift.alias("shift"), factor.alias("factor")), lambda by: F.transform(a, lambda x: (x - by["shift"]) / by["factor"]))


#: Shift and scale of each mode, of a row's vector.
_MODES = {
    "01": lambda a: (F.array_min(a), F.array_max(a) - F.array_min(a)),
    "pm1": lambda a: ((F.array_max(a) + F.array_min(a)) / 2, (F.array_max(a) - F.array_min(a)) / 2),
    "s1": lambda a: (F.lit(0.0), total(a)),
    "m0": lambda a: (mean(a), F.lit(1.0)),
    "v1": lambda a: (F.lit(0.0), spread(a)),
    "n1": lambda a: (F.lit(0.0), F.sqrt(sum_squares(a))),
    "m0v1": lambda a: (mean(a), spread(a)),
}
MODES = tuple(_MODES)


def normalized(a: Column, mode: str) -> Column:
    """A row's vector, shifted and then scaled: to [0, 1], to [-1, 1], sum 1, mean 0, variance 1, length 1, or mean 0 and variance 1.

    A scale of zero counts as 1.
    """
    return _scaled(a, *_MODES[mode](a))


def half_up(x: Column, places: int) -> Column:
    """Numbers from 0 to 2 ** 63 / 10 ** ``places``, rounded half up; unlike ``round``, without a decimal for each."""
    t, one = x * F.lit(10.0**places), F.lit(10.0**places)
    low = F.floor(t)
    return (low + F.when(t - low >= 0.5, 1).otherwise(0)) / one
