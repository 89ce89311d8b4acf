"""Statistics of one row's own array (an image, a ring of pixels). Row-sized, so no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and use it as often as wanted, also inside other lambdas.

    Without this a scalar that a lambda refers to is worked out again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, v: acc + v)


def total_squares(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, v: acc + v.cast("bigint") * v)


def mean(values: Column) -> Column:
    """Mean of whole numbers; null when empty. The sum is exact, so only one division rounds."""
    return F.when(F.size(values) > 0, total(values) / F.size(values))


def deviation(values: Column) -> Column:
    """Population standard deviation from exact sums."""
    n = F.size(values).cast("bigint")
    s = total(values)
    return F.when(n > 0, F.sqrt((n * total_squares(values) - s * s).cast("double")) / n)


def count_where(values: Column, predicate) -> Column:
    return F.size(F.filter(values, predicate))


def nth_smallest(values: Column, index: Column) -> Column:
    """Zero-based."""
    return F.get(F.sort_array(values), index)


def upper_median(values: Column) -> Column:
    return nth_smallest(values, F.floor(F.size(values) / 2).cast("int"))


def twice_median(values: Column) -> Column:
    """Twice the interpolated median, kept whole: the sum of the two middle values."""

    def middle(ordered: Column) -> Column:
        n = F.size(ordered)
        return F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))

    return let(F.sort_array(values), middle)


def median_deviation(values: Column) -> Column:
    """Median absolute deviation from the interpolated median; exact in quarters."""
    twice = let(twice_median(values), lambda m: twice_median(F.transform(values, lambda v: F.abs(v * 2 - m))))
    return twice / 4


def at(values: Column, positions: Column) -> Column:
    """Values at zero-based positions."""
    return F.transform(positions, lambda i: F.get(values, i))


def index_range(start: Column, stop: Column, step: Column | None = None) -> Column:
    """start, start+step … below stop; empty when there is none."""
    step = F.lit(1) if step is None else step
    full = F.sequence(start, F.greatest(stop - 1, start), step)
    return F.when(stop > start, full).otherwise(F.filter(full, lambda _: F.lit(False)))
