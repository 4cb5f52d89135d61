"""Column expressions used by several operators. Missing values are NULL throughout, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Retracement ratios of the level features (fixed values).
LEVEL_RATIOS = (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0)


def trailing(k: int, *keys: str, order: str = "date") -> WindowSpec:
    """The last ``k`` rows of a security, the current one included."""
    return Window.partitionBy(*(keys or ("issue_id",))).orderBy(order).rowsBetween(1 - k, 0)


def running(*keys: str, order: str = "date") -> WindowSpec:
    """All rows of a security up to the current one."""
    return Window.partitionBy(*(keys or ("issue_id",))).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def ordered(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*(keys or ("issue_id",))).orderBy(order)


def full(value: Column, src: Column | str, k: int, *keys: str, order: str = "date") -> Column:
    """``value`` where the last ``k`` rows all have ``src``, else NULL."""
    return F.when(F.count(src).over(trailing(k, *keys, order=order)) == k, value)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; NULL where ``b`` is 0."""
    return F.try_divide(a, b)


def rounded(x: Column, digits: int) -> Column:
    """Halves away from zero, as SQL rounds doubles: by a product and a floor, where ``round`` makes a decimal of each element of an array.

    ``x`` is taken twice, so in an array it should be an element and no formula.
    """
    unit = 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * unit + 0.5) / unit + F.lit(0.0)


def hash_order(seed: int, *keys: Column | str) -> Column:
    """A reproducible random order: md5 of seed and keys, the same on any partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))


def uniform(seed: int, *keys: Column | str) -> Column:
    """A reproducible number in [0, 1): the first 8 hex digits of :func:`hash_order`."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def bin_index(value: Column, lo: Column | float, hi: Column | float, bins: int, clip: bool = False) -> Column:
    """Equal-width right-open bins with a closed last one; out-of-range values are NULL, or clipped."""
    lo, hi = F.lit(lo), F.lit(hi)
    at = F.floor((value - lo) / ((hi - lo) / bins)).cast("int")
    inside = F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1))
    return inside if clip else F.when((value >= lo) & (value <= hi), inside)


def levels(lo: Column, hi: Column) -> Column:
    """Array of the retracement levels of a price range."""
    return F.transform(F.array(*map(F.lit, LEVEL_RATIOS)), lambda r: lo + r * (hi - lo))


def first_argmax(*values: Column) -> Column:
    """Zero-based index of the largest value, the first one on a tie."""
    top = F.greatest(*values)
    out = F.lit(len(values) - 1)
    for i in range(len(values) - 2, -1, -1):
        out = F.when(values[i] == top, i).otherwise(out)
    return F.when(top.isNotNull(), out)


def softmax(*values: Column) -> list[Column]:
    top = F.greatest(*values)
    parts = [F.exp(v - top) for v in values]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]
