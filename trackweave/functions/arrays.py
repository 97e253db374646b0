"""Array functions on columns: missing-aware sums, running sums, slices, masks, bins."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x))


def total(a: Column) -> Column:
    return F.aggregate(present(a), F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    """Mean of the present elements; null if there are none."""
    return F.try_divide(total(a), F.size(present(a)))


def median(a: Column) -> Column:
    s = F.array_sort(present(a))
    n = F.size(s)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def weighted_mean(a: Column, weights: Column) -> Column:
    pairs = F.filter(F.arrays_zip(a.alias("x"), weights.alias("w")), lambda p: p.x.isNotNull() & ~F.isnan(p.x))
    return F.try_divide(F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p.x * p.w), F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p.w))


def running_total(a: Column) -> Column:
    return F.transform(a, lambda _, i: F.aggregate(F.slice(a, 1, i + 1), F.lit(0.0), lambda s, x: s + x))


def differences(a: Column) -> Column:
    return F.transform(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, i: x - F.get(a, i))


def added(a: Column, b: Column) -> tuple[Column, Column]:
    """(sums, counts) by place: sums of the present elements, null where both are missing, and how many are present."""

    def given(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x)

    sums = F.zip_with(a, b, lambda x, y: F.when(given(x) | given(y), F.when(given(x), x).otherwise(0.0) + F.when(given(y), y).otherwise(0.0)))
    return sums, F.zip_with(a, b, lambda x, y: given(x).cast("int") + given(y).cast("int"))


def widest_difference(a: Column) -> Column:
    """Largest less smallest of the present elements."""
    return F.array_max(present(a)) - F.array_min(present(a))


def boundary_median(a: Column, lower: float, upper: float) -> Column:
    """Struct (low, middle, high): elements of the sorted array at a lower and an upper percentage, and the median of those from one to the other.

    Places are round(percentage * n / 100), one less for the lower; they are held inside the array.
    """
    s, n = F.array_sort(a), F.size(a)
    lo = F.greatest(F.round(F.lit(lower) * n / 100).cast("int") - 1, F.lit(0))
    hi = F.least(F.round(F.lit(upper) * n / 100).cast("int"), n - 1)
    return F.when(n > 0, F.struct(F.get(s, lo).alias("low"), median(F.slice(s, lo + 1, hi - lo + 1)).alias("middle"), F.get(s, hi).alias("high")))


def nearest_multiple(x: Column, n: int) -> Column:
    return (F.round(x / n) * n).cast("long")


def random_integers(key: Column, low: int, high: int, n: int, seed: int = 1) -> Column:
    """Array of n integers from low to high, both in, that depend on the key and the seed alone."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.pmod(F.xxhash64(F.lit(seed), i, key), F.lit(high - low + 1)) + low)


def last_at_most(a: Column) -> Column:
    """Index of the largest element, the last of equal ones."""
    return F.array_max(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))).i


def both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x & y)


def either(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x | y)


def exactly_one(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x != y)


def negated(a: Column) -> Column:
    return F.transform(a, lambda x: ~x)


def pick(a: Column, indices: Column) -> Column:
    return F.transform(indices, lambda i: F.get(a, i))


def pick_where(a: Column, mask: Column) -> Column:
    return F.filter(a, lambda _, i: F.get(mask, i))


def within(a: Column, low: Column, high: Column) -> Column:
    """Indices of the elements in [low, high]."""
    return F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.get(a, i).between(low, high))


def sort_order(a: Column) -> Column:
    """Indices that sort the array; equal elements keep their order."""
    pairs = F.array_sort(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.transform(pairs, lambda p: p.i)


def evenly_spaced(low: float, high: float, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(low) + i * (high - low) / max(1, n - 1))


def bin_index(x: Column, edges: list[float]) -> Column:
    """Index of the half-open bin that holds x: -1 below the first edge, len(edges) - 1 from the last on."""
    return sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(-1))


def quantised(x: Column, low: float, high: float, n: int) -> Column:
    """Level 0..n-1 of x, saturating at the limits."""
    clipped = F.least(F.greatest(x, F.lit(low)), F.lit(high))
    return F.round((clipped - low) * (n - 1) / (high - low)).cast("long")


def as_hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.hex(c), 2, "0") for c in (r, g, b)])


def interpolated(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.when(x1 == x0, y0).otherwise(y0 + (x - x0) * (y1 - y0) / (x1 - x0))


def ordinate(d: Column, levels: int, largest: float) -> Column:
    """Level 1..levels of a distance up to ``largest``; 0 stays 0."""
    return F.when(d == 0, 0).otherwise((F.floor(F.greatest(F.abs(d) - 1, F.lit(1)) * levels / largest) + 1)).cast("long")
