"""Error-analysis tables over prediction rows ``(issue_id, test_date, label, y_hat, ...)``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricepanel.functions.expressions import bin_index, ratio
from pricepanel.functions.storage import written
from pricepanel.operators.quantiles import exact_quantiles


def wrong() -> Column:
    return (F.col("label") != F.col("y_hat")).cast("int")


def error_rate(rows: DataFrame, *keys: Column | str) -> DataFrame:
    """Errors, total and their ratio by key."""
    return rows.groupBy(*keys).agg(F.sum(wrong()).alias("errors"), F.count(F.lit(1)).alias("total")).withColumn("ratio", F.col("errors") / F.col("total"))


def error_rate_by_bin(rows: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Errors by equal-width bin of fixed edges, dense; values outside are dropped, the ratio of an empty bin is 0."""
    found = error_rate(rows.withColumn("bin", bin_index(F.col(value), lo, hi, bins)).where("bin is not null"), "bin")
    grid = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(found, "bin", "left").na.fill(0, ["errors", "total"]).na.fill(0.0, ["ratio"])


def label_counts_by_bin(rows: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Labels and predictions of each class by bin."""
    kinds = F.array(F.struct(F.lit("label").alias("kind"), F.col("label").alias("class")), F.struct(F.lit("prediction").alias("kind"), F.col("y_hat").alias("class")))
    long = rows.withColumn("bin", bin_index(F.col(value), lo, hi, bins)).where("bin is not null").select("bin", F.explode(kinds).alias("k")).select("bin", "k.*")
    return long.groupBy("bin", "kind", "class").agg(F.count(F.lit(1)).alias("n"))


def histogram_2d(rows: DataFrame, x: tuple[str, float, float], y: tuple[str, float, float], bins: int) -> DataFrame:
    binned = rows.select(bin_index(F.col(x[0]), x[1], x[2], bins).alias("x_bin"), bin_index(F.col(y[0]), y[1], y[2], bins).alias("y_bin"))
    return binned.where("x_bin is not null and y_bin is not null").groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))


def class_counts_over_time(rows: DataFrame, classes: int = 3) -> DataFrame:
    """One column per class and date, zero where there is none."""
    return rows.groupBy("test_date").agg(*(F.count(F.when(F.col("y_hat") == c, 1)).alias(f"class_{c}") for c in range(classes)))


def samples_over_time(rows: DataFrame) -> DataFrame:
    return rows.groupBy("test_date").agg(F.count(F.lit(1)).alias("n"))


def deviation_counts(rows: DataFrame, horizon: int) -> DataFrame:
    """Share of samples by number of days outside the corridor, ``horizon`` bins, beside the 95 % quantile of that number."""
    counted = rows.select(F.size(F.filter("deviations", lambda v: v != 0)).alias("k"))
    top = counted.agg(F.percentile("k", F.lit(0.95)).alias("q95"), F.count(F.lit(1)).alias("_all"))
    binned = counted.groupBy(bin_index(F.col("k").cast("double"), 0.0, float(horizon), horizon).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return binned.crossJoin(F.broadcast(top)).select("bin", "n", (100 * F.col("n") / F.col("_all")).alias("percent"), "q95")


def deviation_histogram(rows: DataFrame, lo: float = -1.0, hi: float = 1.0, bins: int = 50) -> DataFrame:
    """Share of the daily deviations by bin, beside their 2.5 % and 97.5 % quantiles."""
    long = written(rows.select(F.explode("deviations").alias("v")), "deviations")
    ends = long.agg(F.count(F.lit(1)).alias("_all")).join(F.broadcast(exact_quantiles(long, [], "v", {"q025": 0.025, "q975": 0.975})), how="left")  # one row
    binned = long.withColumn("bin", bin_index(F.col("v"), lo, hi, bins)).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return binned.crossJoin(F.broadcast(ends)).select("bin", "n", (100 * F.col("n") / F.col("_all")).alias("percent"), "q025", "q975")


def deviation_heat(rows: DataFrame, lo: float = -1.0, hi: float = 1.0, bins: int = 21) -> DataFrame:
    """Percent of each horizon day's deviations by bin."""
    long = rows.select(F.posexplode("deviations").alias("day", "v")).withColumn("bin", bin_index(F.col("v"), lo, hi, bins)).where("bin is not null")
    counts = long.groupBy("day", "bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("day")))


def autocorrelation(rows: DataFrame, lags: int, least: int) -> DataFrame:
    """Mean over securities with ``least`` rows of the biased autocorrelation of correctness at lags 0 to ``lags``.

    Each row meets its ``lags`` successors as an array over the same window, not by a join.
    """
    w = Window.partitionBy("issue_id")
    order = w.orderBy("test_date")
    base = rows.select("issue_id", "test_date", (1 - wrong()).cast("double").alias("x"))
    base = base.withColumns({"_m": F.avg("x").over(w), "_n": F.count(F.lit(1)).over(w)}).where(F.col("_n") >= least)
    base = base.withColumn("c", F.col("x") - F.col("_m"))
    base = base.withColumn("_ahead", F.collect_list("c").over(order.rowsBetween(0, lags)))
    long = base.select("issue_id", "c", F.posexplode("_ahead").alias("lag", "d"))
    sums = long.groupBy("issue_id", "lag").agg(F.sum(F.col("c") * F.col("d")).alias("s"))
    zero = F.max(F.when(F.col("lag") == 0, F.col("s"))).over(Window.partitionBy("issue_id"))
    acf = sums.withColumn("acf", ratio(F.col("s"), zero))
    return acf.groupBy("lag").agg(F.avg("acf").alias("mean_acf"), F.count("acf").alias("issues"))


def binomial_quantiles(n: Column, p: Column, low: float = 0.025, high: float = 0.975) -> tuple[Column, Column]:
    """The least numbers of successes of ``n`` draws whose cumulative chance reaches ``low`` and ``high``: terms added up one by one.

    Terms further from the mean than 20 roots of ``n`` add up to less than 2 exp(-800) (Hoeffding's bound), which is 0 as a double, so an array has
    40 roots of ``n`` terms and not ``n``. Terms count by their share of all, so the first one needs no factorials.
    """
    odds, reach = F.ln(p) - F.ln(1 - p), 20 * F.sqrt(n)
    first, last = F.greatest(F.floor(n * p - reach), F.lit(0)).cast("long"), F.least(F.ceil(n * p + reach), n).cast("long")
    part = lambda k, share: F.when(k > 0, k * F.ln(k / (n * share))).otherwise(0.0)
    start = -(part(first, p) + part(n - first, 1 - p))

    def after(log: Column, k: Column) -> Column:
        return F.coalesce(log + odds + F.ln((n - k).cast("double")) - F.ln(k + 1.0), F.lit(float("-inf"))).alias("log")

    def total(so_far: Column, k: Column) -> Column:
        return F.struct(after(so_far["log"], k), (so_far["up_to"] + F.exp(so_far["log"])).alias("up_to"))

    def add(so_far: Column, k: Column) -> Column:
        up_to = so_far["up_to"] + F.exp(so_far["log"]) / so_far["all"]
        reached = lambda name, q: F.coalesce(so_far[name], F.when(up_to >= q - 1e-12, k)).alias(name)
        return F.struct(after(so_far["log"], k), up_to.alias("up_to"), so_far["all"].alias("all"), reached("low", low), reached("high", high))

    none = F.lit(None).cast("long")
    ks, begun = F.sequence(first, last), [start.alias("log"), F.lit(0.0).alias("up_to")]
    every = F.aggregate(ks, F.struct(*begun), total, lambda s: s["up_to"])
    found = F.aggregate(ks, F.struct(*begun, every.alias("all"), none.alias("low"), none.alias("high")), add)
    return tuple(F.when(p <= 0, 0).when(p >= 1, n).otherwise(F.coalesce(found[name], n)) for name in ("low", "high"))


def effective_size(rows: DataFrame, acf: DataFrame, upto: int = 50) -> DataFrame:
    """Inflation 1 + 2 * sum of the mean autocorrelations of lags 1 to ``upto``, effective size, accuracy and its 95 % binomial interval at that size.

    The interval's counts are those of the whole part of the effective size, over the size itself.
    """
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(1 - wrong()).alias("accuracy"))
    inflation = acf.where(F.col("lag").between(1, upto)).agg((1 + 2 * F.coalesce(F.sum("mean_acf"), F.lit(0.0))).alias("inflation"))
    out = total.crossJoin(inflation).withColumn("n_eff", F.col("n") / F.col("inflation"))  # one row each
    low, high = binomial_quantiles(F.floor("n_eff"), F.col("accuracy"))
    return out.withColumns({"lo": low / F.col("n_eff"), "hi": high / F.col("n_eff")})


def sparse_accuracy(rows: DataFrame, strides: tuple[int, ...] = (60, 90, 180, 378)) -> DataFrame:
    """Accuracy over every n-th row of each security."""
    at = F.row_number().over(Window.partitionBy("issue_id").orderBy("test_date")) - 1
    long = rows.withColumn("_at", at).withColumn("stride", F.explode(F.array(*map(F.lit, strides)))).where(F.col("_at") % F.col("stride") == 0)
    return long.groupBy("stride").agg(F.count(F.lit(1)).alias("n"), F.avg(1 - wrong()).alias("accuracy"))


def block_accuracy(rows: DataFrame, size: int = 21) -> DataFrame:
    """Mean, population deviation, least and largest accuracy of each security's blocks of ``size`` rows."""
    at = F.row_number().over(Window.partitionBy("issue_id").orderBy("test_date")) - 1
    blocks = rows.withColumn("block", F.floor(at / size)).groupBy("issue_id", "block").agg(F.avg(1 - wrong()).alias("a"))
    return blocks.groupBy("issue_id").agg(F.count(F.lit(1)).alias("blocks"), F.avg("a").alias("mean"), F.stddev_pop("a").alias("std"), F.min("a").alias("least"), F.max("a").alias("most"))


LEVEL_NAMES = ("Low", "Med", "High")


def level_of(value: Column) -> Column:
    return F.when(value < 0.33, "Low").when(value < 0.67, "Med").otherwise("High")


def normalised_entropy(p: list[str]) -> Column:
    terms = [F.when(F.col(c) > 0, F.col(c) * F.ln(c)).otherwise(0.0) for c in p]
    return F.least(F.greatest(-sum(terms, F.lit(0.0)) / math.log(len(p)), F.lit(0.0)), F.lit(1.0))


def entropy_difficulty(rows: DataFrame, p: list[str], difficulty: str) -> DataFrame:
    """Count and accuracy by level of entropy and of difficulty, dense."""
    found = rows.groupBy(level_of(normalised_entropy(p)).alias("entropy"), level_of(F.col(difficulty)).alias("difficulty")).agg(
        F.count(F.lit(1)).alias("n"), (100 * F.avg(1 - wrong())).alias("accuracy")
    )
    names = F.explode(F.array(*map(F.lit, LEVEL_NAMES)))
    grid = rows.sparkSession.range(1).select(names.alias("entropy")).withColumn("difficulty", names)
    return grid.join(found, ["entropy", "difficulty"], "left").na.fill(0, ["n"])


def entropy_curve(rows: DataFrame, p: list[str], difficulty: str, bins: int = 10) -> DataFrame:
    """Mean entropy by right-open bins of difficulty; a difficulty of exactly 1 falls out."""
    inside = rows.where((F.col(difficulty) >= 0) & (F.col(difficulty) < 1))
    return inside.groupBy(F.floor(F.col(difficulty) * bins).cast("int").alias("bin")).agg(F.avg(normalised_entropy(p)).alias("entropy"), F.count(F.lit(1)).alias("n"))


def residual_bands(members: DataFrame, keys: list[str], residual: str) -> DataFrame:
    """Mean and population deviation of the ensemble's nonzero residuals, and the bounds scaled by mean plus and minus deviation."""
    some = F.when(F.col(residual) != 0, F.col(residual))
    out = members.groupBy(*keys, "lb", "ub").agg(F.avg(some).alias("mean"), F.stddev_pop(some).alias("std"))
    bound = F.when(F.col("mean") >= 0, F.col("ub")).otherwise(F.col("lb"))
    scaled = lambda v: bound * (1 + v / 100)
    return out.withColumns({"band_lo": scaled(F.col("mean") - F.col("std")), "band_hi": scaled(F.col("mean") + F.col("std"))})


def touch_point(rows: DataFrame, value: str, horizon: int) -> DataFrame:
    """Where a signed time prediction says the corridor is left: ``position`` counted from the window's end, and the ``level`` there."""
    v = F.col(value)
    at = horizon - F.abs(v)
    line = F.col("intercept") + F.col("slope") * (F.col("train") + at)
    inner = line - F.col("half") + (v + 1) / 2 * 2 * F.col("half")
    return rows.withColumns({"position": at, "level": F.when(v >= 1, line + F.col("half")).when(v <= -1, line - F.col("half")).otherwise(inner)})


def panel_raster(df: DataFrame, value: str) -> DataFrame:
    """Min-max value of each security by trading day with its index, and whether the day before is a one-day gap."""
    from pricepanel.operators.calendar import gaps
    from pricepanel.operators.normalise import by_group
    from pricepanel.operators.sampling import numbered

    ids = numbered(df.select("issue_id").distinct(), "issue_id").select("issue_id", (F.col("_n") - 1).cast("int").alias("issue_index"))
    rows = gaps(by_group(df, value, "issue_id", "value", "minmax")).withColumn("gap_before", F.coalesce(F.col("gap") == 1, F.lit(False)))
    return rows.join(ids, "issue_id").select("issue_index", "trading_day", "value", "gap_before")
