"""Normalisers: over a security's column, over sample windows, and by the range of a history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pricepanel.functions.expressions import full, ordered, rounded, trailing

EPS = 1e-6


def by_group(df: DataFrame, src: str, group: str, dst: str, kind: str) -> DataFrame:
    """Column z-score, min-max (zero spread becomes 1e-6) or a hundredth; another kind is an error."""
    w = Window.partitionBy(group)
    safe = lambda spread: F.when(spread == 0, EPS).otherwise(spread)
    if kind == "zscore":
        value = (F.col(src) - F.avg(src).over(w)) / safe(F.stddev_samp(src).over(w))
    elif kind == "minmax":
        value = (F.col(src) - F.min(src).over(w)) / safe(F.max(src).over(w) - F.min(src).over(w))
    elif kind == "percent":
        value = F.col(src) / 100
    else:
        raise ValueError(f"unknown normalisation: {kind}")
    return df.withColumn(dst, value)


def sample_minmax(x: Column) -> Column:
    """Ends are taken once, ahead of the transform; a lambda would look for them at every element."""
    ends = F.array(F.struct(F.array_min(x).alias("lo"), F.array_max(x).alias("hi")))
    return F.flatten(F.transform(ends, lambda p: F.transform(x, lambda v: (v - p["lo"]) / (p["hi"] - p["lo"] + EPS))))


def sample_zscore(x: Column) -> Column:
    """By mean and population deviation of the window; both sums are taken once, ahead of the transform."""
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)
    squares = lambda m: F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
    shape = F.transform(F.array(mean), lambda m: F.struct(m.alias("m"), (F.sqrt(squares(m) / F.size(x)) + EPS).alias("s")))
    return F.flatten(F.transform(shape, lambda p: F.transform(x, lambda v: (v - p["m"]) / p["s"])))


#: Sample normalisers by name. The grouped names normalise each row alone as well, so they are the same functions.
SAMPLE: dict[str, Callable[[Column], Column]] = {
    "sample_minmax": sample_minmax,
    "sample_zscore": sample_zscore,
    "group_minmax": sample_minmax,
    "group_zscore": sample_zscore,
}


#: What a window's values are taken from and divided by, as aggregates over the rows it is made of.
SHAPES: dict[str, Callable[[str, WindowSpec], tuple[Column, Column]]] = {
    "minmax": lambda src, w: (F.min(src).over(w), F.max(src).over(w) - F.min(src).over(w)),
    "zscore": lambda src, w: (F.avg(src).over(w), F.stddev_pop(src).over(w)),
}


def windows_normalised(df: DataFrame, plan: dict[str, tuple[str, str | None]], k: int, digits: dict[str, int] | None = None) -> DataFrame:
    """Windows of ``k`` rows as arrays ``dst: (src, method)``; no method leaves the window as it is. ``digits`` rounds normalised ones.

    Values are those of :data:`SAMPLE`; ends, means and deviations come from the frame that makes the array, not from folds over each array.
    """
    if unknown := [m for _, m in plan.values() if m and m not in SAMPLE]:
        raise ValueError(f"unknown normalisation: {unknown}")
    w, columns = trailing(k), {}
    for dst, (src, method) in plan.items():
        columns[dst] = full(F.collect_list(src).over(w), src, k)
        if method:
            columns[f"_from_{dst}"], columns[f"_by_{dst}"] = SHAPES[method.split("_")[1]](src, w)
    rows = df.select("issue_id", "date", *(c.alias(name) for name, c in columns.items()))
    for dst in plan:
        rows = rows.where(F.col(dst).isNotNull())

    def normalised(dst: str) -> Column:
        value = F.transform(dst, lambda v: (v - F.col(f"_from_{dst}")) / (F.col(f"_by_{dst}") + EPS))
        return F.transform(value, lambda v: rounded(v, digits[dst])) if digits and dst in digits else value

    return rows.select("issue_id", "date", *((normalised(dst) if m else F.col(dst)).alias(dst) for dst, (_, m) in plan.items()))


def history_range(df: DataFrame, src: str, k: int) -> DataFrame:
    """``hist_min`` and ``hist_range`` (1e-8 at least) of the last ``k`` prices, full windows only."""
    w = trailing(k)
    spread = F.greatest(F.max(src).over(w) - F.min(src).over(w), F.lit(1e-8))
    return df.withColumns({"hist_min": F.min(src).over(w), "hist_range": spread, "_n": F.count(src).over(w)}).where(F.col("_n") == k).drop("_n")


def rescaled(df: DataFrame, src: str, dst: str) -> DataFrame:
    return df.withColumn(dst, (F.col(src) - F.col("hist_min")) / F.col("hist_range"))


def window_scale(df: DataFrame, src: str, k: int) -> DataFrame:
    """Window minimum and range with the last and the next price scaled by them."""
    rows = history_range(df.withColumn("_next", F.lead(src).over(ordered())), src, k).where("_next is not null")
    return rows.select(
        "issue_id",
        "date",
        F.col("hist_min").alias("price_min"),
        F.col("hist_range").alias("price_range"),
        ((F.col(src) - F.col("hist_min")) / F.col("hist_range")).alias("last_scaled"),
        ((F.col("_next") - F.col("hist_min")) / F.col("hist_range")).alias("next_scaled"),
    )
