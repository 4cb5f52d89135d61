"""Sample windows and level features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricepanel.functions.expressions import full, levels, ordered, running, trailing

FLOOR = 1e-8


def next_step_windows(df: DataFrame, src: str, k: int, most: int | None = None) -> DataFrame:
    """Last ``k`` prices and the next one, by the window's last date; with ``most`` only the earliest windows of each security."""
    order = Window.partitionBy("issue_id").orderBy("date")
    rows = df.select("issue_id", "date", full(F.collect_list(src).over(trailing(k)), src, k).alias("window"), F.lead(src).over(order).alias("next_price"))
    rows = rows.where("window is not null and next_price is not null")
    if most is None:
        return rows
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def train_test_windows(df: DataFrame, src: str, train: int, test: int) -> DataFrame:
    """Prices of ``train`` days up to the test date and of the ``test`` days after it; full windows only."""
    order = Window.partitionBy("issue_id").orderBy("date")
    rows = df.select(
        "issue_id",
        F.col("date").alias("test_date"),
        F.collect_list(src).over(order.rowsBetween(1 - train, 0)).alias("train"),
        F.collect_list(src).over(order.rowsBetween(1, test)).alias("test"),
    )
    return rows.where((F.size("train") == train) & (F.size("test") == test))


def without_windows(df: DataFrame, need: int) -> DataFrame:
    """Securities too short for one window of ``need`` rows."""
    return df.groupBy("issue_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < need).select("issue_id", "n")


def rolling_extremes(df: DataFrame, src: str, k: int) -> DataFrame:
    """``lo`` and ``hi`` of ``src`` over the last ``k`` rows of a security, nulls left out, and ``_n``, how many of them have it.

    The extremes of 2, 4, 8, ... rows come from two spans of half as many each, those of ``k`` rows from two that overlap. So a row takes as
    many steps as ``k`` has binary digits, where a sliding frame goes over its ``k`` rows again; all windows share one order.
    """
    rows, span = df.withColumns({"lo": F.col(src), "hi": F.col(src), "_c": F.count(src).over(running())}), 1
    while span < k:
        back = min(span, k - span)
        rows = rows.withColumns({"lo": F.least("lo", F.lag("lo", back).over(ordered())), "hi": F.greatest("hi", F.lag("hi", back).over(ordered()))})
        span += back
    return rows.withColumn("_n", F.col("_c") - F.coalesce(F.lag("_c", k).over(ordered()), F.lit(0))).drop("_c")


def window_range(df: DataFrame, src: str, k: int) -> DataFrame:
    """``last, previous, lo, hi`` of each full window of ``k`` rows."""
    rows = df.select("issue_id", "date", F.col(src).alias("last"), F.lag(src).over(ordered()).alias("previous"))
    return rolling_extremes(rows, "last", k).where(F.col("_n") == k).drop("_n")


def multi_horizon_range(df: DataFrame, src: str, short: int, middle: int, k: int) -> DataFrame:
    """Range of the ``short`` last rows if it is over half the full one, else of the ``middle`` ones by the same rule, else the full range."""
    lo, hi = (lambda n: F.min(src).over(trailing(n))), (lambda n: F.max(src).over(trailing(n)))
    rows = df.select("issue_id", "date", *(f(n).alias(f"{name}{n}") for n in (short, middle, k) for name, f in (("lo", lo), ("hi", hi))), F.count(src).over(trailing(k)).alias("_n"))
    rows = rows.where(F.col("_n") == k)
    half = (F.col(f"hi{k}") - F.col(f"lo{k}")) / 2
    use = F.when(F.col(f"hi{short}") - F.col(f"lo{short}") > half, short).when(F.col(f"hi{middle}") - F.col(f"lo{middle}") > half, middle).otherwise(k)
    pick = lambda name: F.when(use == short, F.col(f"{name}{short}")).when(use == middle, F.col(f"{name}{middle}")).otherwise(F.col(f"{name}{k}"))
    return rows.select("issue_id", "date", use.alias("rows_used"), pick("lo").alias("lo"), pick("hi").alias("hi"), F.greatest(pick("hi") - pick("lo"), F.lit(FLOOR)).alias("delta"))


def signed_distances(last: Column, lo: Column, hi: Column) -> Column:
    """Distance of the last price from each level, in ranges."""
    return F.transform(levels(lo, hi), lambda v: (last - v) / F.greatest(hi - lo, F.lit(FLOOR)))


def nearest_level(distances: Column) -> Column:
    """Index of the nearest level, the first one on a tie."""
    sizes = F.transform(distances, lambda d, i: F.struct(F.round(F.abs(d), 9).alias("size"), i.alias("i")))
    return F.array_min(sizes)["i"]


def window_features(ranges: DataFrame) -> DataFrame:
    """Signed distances, nearest level with its distance, and the last move, all in window ranges."""
    rows = ranges.withColumn("distances", signed_distances(F.col("last"), F.col("lo"), F.col("hi")))
    rows = rows.withColumn("nearest_level", nearest_level(F.col("distances")))
    return rows.withColumn("distance", F.element_at("distances", F.col("nearest_level") + 1)).withColumn(
        "movement", (F.col("last") - F.col("previous")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(FLOOR))
    )


def moment_features(df: DataFrame, src: str, k: int) -> DataFrame:
    w = trailing(k)
    rows = df.select(
        "issue_id", "date", F.col(src).alias("x"), (F.col(src) * F.col(src)).alias("x2"), F.avg(src).over(w).alias("mean"), F.stddev_pop(src).over(w).alias("std"),
        F.min(src).over(w).alias("lo"), F.max(src).over(w).alias("hi"), F.lit(1.0).alias("one"), F.count(src).over(w).alias("_n"),
    )
    return rows.where(F.col("_n") == k).drop("_n")


def direction_signs(features: DataFrame) -> DataFrame:
    """Signs of the nearest signed distance and of the last move; zero counts as up."""
    sign = lambda c: F.when(F.col(c) < 0, -1).otherwise(1)
    return features.withColumn("bounce_sign", sign("distance")).withColumn("break_sign", sign("movement"))


def fixed_level_distance(origins: DataFrame, path: DataFrame, keys: list[str]) -> DataFrame:
    """Mean distance of a path's future steps to the nearest level frozen at the origin, in history ranges.

    ``origins(keys, lo, hi)``; ``path(keys, step, price)``, where step 0 is the history's end.
    """
    spread = F.greatest(F.col("hi") - F.col("lo"), F.lit(FLOOR))
    near = F.array_min(F.transform(levels(F.col("lo"), F.col("hi")), lambda v: F.abs(F.col("price") - v) / spread))
    return path.where("step > 0").join(origins.select(*keys, "lo", "hi"), keys).groupBy(*keys).agg(F.avg(near).alias("mean_distance"))


def trajectory_windows(origins: DataFrame, df: DataFrame, src: str, k: int, horizon: int) -> DataFrame:
    """For each of ``horizon + 1`` steps of an origin its trailing window's range: a window over the security, joined by position."""
    from pricepanel.operators.calendar import positions

    rows = positions(df).select("issue_id", "pos", "date", F.col(src).alias("last"), F.lag(src).over(ordered()).alias("previous"))
    ranges = rolling_extremes(rows, "last", k)
    steps = origins.select(*(c for c in origins.columns if c != "origin_pos"), F.posexplode(F.sequence(F.col("origin_pos"), F.col("origin_pos") + horizon)).alias("step", "pos"))
    return steps.join(ranges.where(F.col("_n") == k).drop("_n"), ["issue_id", "pos"]).drop("pos")


