"""Linear-trend corridors over train windows and the labels of the days after them.

The daily fit comes from window aggregates over positions, so no window array is built for it; the test days are one
array of ``horizon`` prices per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricepanel.functions.expressions import ratio, trailing
from pricepanel.operators.calendar import positions

CONFIDENCE = 1.96
#: Largest deviation in percent by horizon (fixed values).
DEVIATION_CLIP = {63: 50.0, 5: 15.0}


def _less_product(c: Column, a: Column, b: Column) -> Column:
    """``c - a * b`` without the product's own rounding, for a ``b`` of up to 26 bits: by the upper and the lower half of ``a``."""
    scaled = a * float(2**27 + 1)
    upper = scaled - (scaled - a)
    return (c - upper * b) - (a - upper) * b


def fits(df: DataFrame, src: str, train: int, horizon: int, window: str | None = None) -> DataFrame:
    """Per full window: ``slope, intercept`` (at the window's first day), ``sigma`` (population), ``lo, hi`` and the ``test`` prices.

    ``window`` names a column for the window's own prices, which no fit needs. A price on the line itself has a margin of 1, which the last bits
    of the fit decide, so its sums and its line run as those of ``regr_slope``, ``regr_intercept`` and ``regr_syy`` in SQL, rounded where they are.
    """
    w = trailing(train)
    order = Window.partitionBy("issue_id").orderBy("date")
    y, x = F.col(src), F.col("pos").cast("double")
    # Positions of a full window follow one another, so their spread is known, and mean, variance and covariance make the whole fit.
    spread, n = F.lit((train * train - 1) / 12), float(train)
    rows = positions(df).select(
        "issue_id",
        "date",
        (F.col("pos") - (train - 1)).cast("double").alias("_first"),
        F.covar_pop(x, y).over(w).alias("_cov"),
        F.covar_pop(y, y).over(w).alias("_var"),
        F.avg(y).over(w).alias("_mean"),
        F.min(src).over(w).alias("lo"),
        F.max(src).over(w).alias("hi"),
        F.count(src).over(w).alias("_n"),
        F.collect_list(src).over(order.rowsBetween(1, horizon)).alias("test"),
        *([F.collect_list(src).over(w).alias(window)] if window else []),
    )
    rows = rows.where((F.col("_n") == train) & (F.size("test") == horizon)).withColumn("slope", ratio(F.col("_cov"), spread))
    sxy = F.col("_cov") * n
    sigma = F.sqrt(F.greatest((F.col("_var") * n - sxy * sxy / (spread * n)) / n, F.lit(0.0)))
    at_zero = _less_product(F.col("_mean"), F.col("slope"), F.col("_first") + (train - 1) / 2)
    return rows.select(
        "issue_id", F.col("date").alias("test_date"), "slope", (at_zero + F.col("slope") * F.col("_first")).alias("intercept"), sigma.alias("sigma"), "lo", "hi", "test",
        *([window] if window else []),
    )


def normalised_slope(rows: DataFrame) -> DataFrame:
    return rows.withColumn("slope_normalised", F.col("slope") / (F.col("hi") - F.col("lo") + 1e-6))


def corridor(rows: DataFrame, train: int) -> DataFrame:
    """``half`` width, normalised ``ci_width`` and ``days``: structs of step, price, lower and upper bound for the test days."""
    rows = rows.withColumn("half", CONFIDENCE * F.col("sigma"))
    line = lambda k: F.col("intercept") + F.col("slope") * (F.lit(train) + k)
    days = F.transform(
        "test", lambda y, k: F.struct(k.alias("k"), y.alias("y"), (line(k) - F.col("half")).alias("lb"), (line(k) + F.col("half")).alias("ub"))
    )
    return rows.withColumn("days", days).withColumn("ci_width", ratio(2 * F.col("half"), F.col("hi") - F.col("lo")))


def _count(days: str, ok) -> Column:
    return F.size(F.filter(days, ok))


def coverage(rows: DataFrame) -> DataFrame:
    return rows.withColumn("coverage", _count("days", lambda s: (s["y"] >= s["lb"]) & (s["y"] <= s["ub"])) / F.size("days"))


def first_crossing(rows: DataFrame) -> DataFrame:
    """``label``: 1 if no day leaves the corridor, else 2 (above) or 0 (below) by the first that does; ``time_label`` signed days left at it."""
    first = lambda ok: F.array_min(F.transform(F.filter("days", ok), lambda s: s["k"]))
    rows = rows.withColumns({"_up": first(lambda s: s["y"] > s["ub"]), "_down": first(lambda s: s["y"] < s["lb"])})
    none = F.col("_up").isNull() & F.col("_down").isNull()
    up = F.col("_down").isNull() | (F.col("_up") < F.col("_down"))
    label = F.when(none, 1).when(up, 2).otherwise(0)
    left = F.size("days") - F.least("_up", "_down")
    return rows.withColumn("label", label).withColumn("time_label", F.when(none, 0).when(up, left).otherwise(-left)).drop("_up", "_down")


def deviations(rows: DataFrame, horizon: int) -> DataFrame:
    """Percent beyond the touched bound by day, 0 inside, clipped by horizon; and the one of largest size, first on a tie."""
    beyond = lambda s: F.when(s["y"] >= s["ub"], 100 * (s["y"] - s["ub"]) / s["ub"]).when(s["y"] <= s["lb"], 100 * (s["y"] - s["lb"]) / s["lb"]).otherwise(0.0)
    most = DEVIATION_CLIP.get(horizon)
    clipped = (lambda v: F.greatest(F.least(v, F.lit(most)), F.lit(-most))) if most else (lambda v: v)
    rows = rows.withColumn("deviations", F.transform("days", lambda s: clipped(beyond(s))))
    top = F.array_max(F.transform("deviations", lambda v, k: F.struct(F.abs(v).alias("size"), (-k).alias("k"), v.alias("v"))))
    return rows.withColumn("residual_label", top["v"])


def difficulty(rows: DataFrame) -> DataFrame:
    """``margin``: how near the middle of its corridor the first test price is, 0 outside."""
    first = F.col("days")[0]
    spread = first["ub"] - first["lb"]
    at = ratio(first["y"] - first["lb"], spread)
    inside = (spread > 0) & (first["y"] >= first["lb"]) & (first["y"] <= first["ub"])
    return rows.withColumn("margin", F.when(inside, F.greatest(F.least(1 - 2 * F.abs(at - 0.5), F.lit(1.0)), F.lit(0.0))).otherwise(0.0))


def trend_samples(df: DataFrame, src: str = "cl_adj_loc", train: int = 21, horizon: int = 5, window: str | None = None) -> DataFrame:
    """Every label of each sample by its security and test date, with its prices if ``window`` names a column for them; one shuffle by security."""
    rows = corridor(normalised_slope(fits(df, src, train, horizon, window)), train)
    return difficulty(deviations(first_crossing(coverage(rows)), horizon))


def strided_fit(window: Column, step: int) -> Column:
    """Slope and population deviation of the residuals of every ``step``-th element, against its place among those."""
    picked = F.filter(window, lambda x, i: i % step == 0)
    points = F.transform(picked, lambda y, i: F.struct(i.cast("double").alias("x"), y.alias("y")))
    zero = F.struct(F.lit(0).alias("n"), *(F.lit(0.0).alias(c) for c in ("x", "y", "xx", "xy", "yy")))

    def added(a: Column, p: Column) -> Column:
        return F.struct(
            (a["n"] + 1).alias("n"), (a["x"] + p["x"]).alias("x"), (a["y"] + p["y"]).alias("y"),
            (a["xx"] + p["x"] * p["x"]).alias("xx"), (a["xy"] + p["x"] * p["y"]).alias("xy"), (a["yy"] + p["y"] * p["y"]).alias("yy"),
        )

    def ended(sums: Column) -> Column:
        n = sums["n"]
        sxx, sxy = sums["xx"] - sums["x"] * sums["x"] / n, sums["xy"] - sums["x"] * sums["y"] / n
        syy = sums["yy"] - sums["y"] * sums["y"] / n
        slope = ratio(sxy, sxx)
        return F.struct(
            slope.alias("slope"),
            ((sums["y"] - slope * sums["x"]) / n).alias("intercept"),
            F.sqrt(F.greatest((syy - slope * sxy) / n, F.lit(0.0))).alias("sigma"),
            n.alias("n"),
        )

    return F.aggregate(points, zero, added, ended)  # one fold; its sums are the last step's argument


def coverage_and_instability(windows: DataFrame, step: int) -> DataFrame:
    """Of ``(train, test)`` windows at a bar of ``step`` days: coverage of the strided test days, and population deviation over mean of the
    weekly, monthly and chosen slopes."""
    rows = windows.withColumns({"_bar": strided_fit(F.col("train"), step), "_week": strided_fit(F.col("train"), 5), "_month": strided_fit(F.col("train"), 21)})
    line = lambda k: F.col("_bar.intercept") + F.col("_bar.slope") * (F.col("_bar.n") + k)
    days = F.transform(F.filter("test", lambda x, i: i % step == 0), lambda y, k: F.abs(y - line(k)) <= CONFIDENCE * F.col("_bar.sigma"))
    slopes = F.array(F.col("_week.slope"), F.col("_month.slope"), F.col("_bar.slope"))
    mean = (slopes[0] + slopes[1] + slopes[2]) / 3
    spread = F.sqrt(((slopes[0] - mean) * (slopes[0] - mean) + (slopes[1] - mean) * (slopes[1] - mean) + (slopes[2] - mean) * (slopes[2] - mean)) / 3)
    rows = rows.withColumn("coverage", F.size(F.filter(days, lambda b: b)) / F.size(days)).withColumn("slope_cv", ratio(spread, mean))
    return rows.drop("_bar", "_week", "_month")


def labelled_dataset(df: DataFrame, src: str, train: int, test: int, step: int, train_end: str) -> DataFrame:
    """Per security and split: windows, share labelled 1 (all days covered) and mean slope instability."""
    from pricepanel.operators.windows import train_test_windows

    rows = coverage_and_instability(train_test_windows(df, src, train, test), step)
    split = F.when(F.col("test_date") <= train_end, "train").otherwise("val")
    return rows.groupBy("issue_id", split.alias("split")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("coverage") == 1).cast("int")).alias("label_share"), F.avg("slope_cv").alias("mean_slope_cv")
    )
