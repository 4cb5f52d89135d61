"""Statistics of price paths and tests between sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricepanel.functions.expressions import bin_index, ratio, uniform
from pricepanel.functions.storage import written
from pricepanel.operators.quantiles import exact_quantiles, running_total

KEYS = ["issue_id", "origin_date", "source", "iteration"]
#: Differences up to which the signed-rank test is exact.
EXACT = 50
#: Names and levels of a band's quantiles.
BAND = {"q05": 0.05, "median": 0.5, "q95": 0.95}


def inventory(paths: DataFrame) -> DataFrame:
    """Per origin: paths, distinct iterations, valid paths. ``paths(issue_id, origin_date, iteration, is_valid)``, one row each."""
    return paths.groupBy("issue_id", "origin_date").agg(
        F.count(F.lit(1)).alias("paths"), F.countDistinct("iteration").alias("iterations"), F.sum(F.col("is_valid").cast("int")).alias("valid_paths")
    )


def noise(seed: int, *keys: Column | str) -> Column:
    """Standard normal number of a key: Box-Muller on two md5 numbers."""
    u1, u2 = uniform(seed, *keys), uniform(seed + 1, *keys)
    return F.sqrt(-2 * F.ln(F.greatest(u1, F.lit(1e-12)))) * F.cos(2 * 3.141592653589793 * u2)


def mean_reverting(origins: DataFrame, n: int, seed: int, kappa: float = 0.1, mu: float = 0.5, sigma: float = 0.05) -> DataFrame:
    """A mean-reverting path of ``n`` steps per origin ``(issue_id, origin_date, price, lo, hi)``, in price units.

    The recursion's closed form needs one running sum: x_t = mu + phi^t (x_0 - mu + s * sum of phi^-k z_k).
    """
    import math

    phi = math.exp(-kappa)
    s = sigma * math.sqrt((1 - phi * phi) / (2 * kappa))
    spread = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-8))
    rows = origins.withColumn("x0", (F.col("price") - F.col("lo")) / spread).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n))))
    shock = F.when(F.col("step") == 0, 0.0).otherwise(F.pow(F.lit(phi), -F.col("step")) * noise(seed, "issue_id", "origin_date", "step"))
    w = Window.partitionBy("issue_id", "origin_date").orderBy("step")
    rows = rows.withColumn("_z", shock).withColumn("_sum", F.sum("_z").over(w))
    x = mu + F.pow(F.lit(phi), F.col("step")) * (F.col("x0") - mu + s * F.col("_sum"))
    return rows.select("issue_id", "origin_date", "step", (F.col("lo") + x * spread).alias("price"))


def change_statistics(paths: DataFrame, keys: list[str], path: list[str], scale: float = 1.0) -> DataFrame:
    """Fourteen statistics of the scaled changes from step to step."""
    d = (F.col("price") - F.lag("price").over(Window.partitionBy(*path).orderBy("step"))) * scale
    rows = paths.withColumn("d", d).where("d is not null")
    rows = written(rows.select(*keys, "d"), "path-changes")
    out = rows.groupBy(*keys).agg(
        F.count("d").alias("count"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.avg(F.abs("d")).alias("mean_abs"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms"),
        F.min("d").alias("min"), F.max("d").alias("max"), F.avg((F.col("d") > 0).cast("int")).alias("share_up"), F.avg((F.col("d") < 0).cast("int")).alias("share_down"),
    )
    return out.join(exact_quantiles(rows, keys, "d", {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}), keys)


def metric_summary(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Per group and metric: paths, valid ones, and over the valid ones mean, population deviation, 5 %, 50 % and 95 % quantiles."""
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    long = written(rows.select(*keys, "is_valid", F.explode(cells).alias("c")).select(*keys, "is_valid", "c.*"), "path-metrics")
    ok = F.when(F.col("is_valid"), F.col("value"))
    out = long.groupBy(*keys, "metric").agg(
        F.count(F.lit(1)).alias("paths"), F.count(F.when(F.col("is_valid"), 1)).alias("valid"), F.avg(ok).alias("mean"), F.stddev_pop(ok).alias("std"),
    )
    return out.join(exact_quantiles(long.where("is_valid"), [*keys, "metric"], "value", BAND), [*keys, "metric"], "left")


def returns(paths: DataFrame, path: list[str]) -> DataFrame:
    """Simple returns where the price before isn't 0."""
    back = F.lag("price").over(Window.partitionBy(*path).orderBy("step"))
    return paths.withColumn("ret", ratio(F.col("price"), back) - 1).where("ret is not null")


def return_metrics(paths: DataFrame, path: list[str]) -> DataFrame:
    """Per path: returns, their mean, deviation and variance (population), and the largest drawdown."""
    w = Window.partitionBy(*path).orderBy("step")
    rows = paths.withColumns({"ret": ratio(F.col("price"), F.lag("price").over(w)) - 1, "_dd": 1 - F.col("price") / F.max("price").over(w)})
    return rows.groupBy(*path).agg(
        F.count("ret").alias("returns"), F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("std"), F.var_pop("ret").alias("variance"), F.max("_dd").alias("max_drawdown"),
        F.sum("ret").alias("sum_ret"), F.sum(F.col("ret") * F.col("ret")).alias("sum_sq"),
    )


def pooled(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Pooled mean and deviation of all returns of a group, from the paths' own sums, and the mean of their drawdowns."""
    n, s, q = F.sum("returns"), F.sum("sum_ret"), F.sum("sum_sq")
    return metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("paths"), n.alias("returns"), (s / n).alias("mean"), F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))).alias("std"), F.avg("max_drawdown").alias("mean_drawdown")
    )


def across_issues(metrics: DataFrame, sources: list[str]) -> DataFrame:
    """Per security: origins, and by source the means of the paths' metrics side by side."""
    names = ("mean", "std", "max_drawdown", "variance")
    wide = [F.avg(F.when(F.col("source") == s, F.col(m))).alias(f"{s}_{m}") for s in sources for m in names]
    return metrics.groupBy("issue_id").agg(F.countDistinct("origin_date").alias("origins"), F.count(F.lit(1)).alias("paths"), *wide)


def shared_histogram(rows: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """Count and density by source over edges common to all sources (padded where there is one value)."""
    ends = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    ends = ends.select(F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"), F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    binned = rows.crossJoin(F.broadcast(ends)).withColumn("bin", bin_index(F.col(value), F.col("_lo"), F.col("_hi"), bins, clip=True))
    counts = binned.groupBy("source", "bin").agg(F.count(F.lit(1)).alias("n"), F.first((F.col("_hi") - F.col("_lo")) / bins).alias("_w"))
    return counts.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy("source")) * F.col("_w"))).drop("_w")


def signed_rank_test(rows: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """One-sided paired test that error ``b`` is larger than ``a``: zeros dropped, average ranks.

    ``p_value`` is exact for up to ``EXACT`` differences of distinct sizes, none of them 0, else by the normal approximation with ties corrected.

    Ranks come from the running totals of the counts of distinct sizes, which are summed by ranges, so no row is ranked in one task with all others.
    """
    d = F.round(F.col(b) - F.col(a), 12)
    rows = written(rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b, d.alias("_d")), "paired-differences")
    totals = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("issues"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b")
    )
    for c, name in ((a, "median_a"), (b, "median_b")):
        median = exact_quantiles(rows, keys, c, {name: 0.5})
        totals = totals.join(median, keys, "left") if keys else totals.join(F.broadcast(median), how="left")  # one row
    sizes = rows.where("_d <> 0").groupBy(*keys, F.abs("_d").alias("_size")).agg(F.count(F.lit(1)).alias("_c"), F.count(F.when(F.col("_d") > 0, 1)).alias("_up"))
    ranked = running_total(sizes, keys, "_size", "_c", "_up_to").withColumn("_rank", F.col("_up_to") - (F.col("_c") - 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum("_c").alias("n"), F.sum(F.col("_rank") * F.col("_up")).alias("statistic"), F.sum(F.col("_c") * F.col("_c") * F.col("_c") - F.col("_c")).alias("_ties"))
    out = totals.join(sums, keys, "left") if keys else totals.crossJoin(sums)
    n = F.coalesce("n", F.lit(0))
    mean, variance = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.coalesce("_ties", F.lit(0)) / 48
    z = ratio(F.coalesce("statistic", F.lit(0.0)) - mean, F.sqrt(variance))
    out = out.withColumns({"n": n, "statistic": F.coalesce("statistic", F.lit(0.0)), "z": z})
    exact = (F.col("n") <= EXACT) & (F.col("n") == F.col("issues")) & (F.col("_ties") == 0)
    p = F.when(F.col("z").isNull(), 1.0).when(exact, signed_rank_tail(F.col("n"), F.col("statistic"))).otherwise(upper_tail(F.col("z")))
    return out.withColumn("p_value", p).drop("_ties")


def signed_rank_tail(n: Column, statistic: Column) -> Column:
    """Chance that the ranks 1 to ``n``, each in or out like a coin, sum to ``statistic`` or more: the distribution rank by rank."""
    ranks = F.sequence(F.lit(1), n.cast("int"))
    start = F.transform(F.sequence(F.lit(0), (n * (n + 1) / 2).cast("int")), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    with_rank = lambda p, r: F.transform(p, lambda x, i: (x + F.when(i >= r, F.get(p, i - r)).otherwise(0.0)) / 2)
    chances = F.aggregate(ranks, start, with_rank)
    return F.aggregate(F.slice(chances, statistic.cast("int") + 1, F.size(start)), F.lit(0.0), lambda a, x: a + x)


def upper_tail(z: Column) -> Column:
    """1 - Phi(z) by the rational approximation 26.2.17 of Abramowitz and Stegun (error below 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def quantile_band(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Median, 5 % and 95 % quantiles over paths at each step."""
    return exact_quantiles(paths, [*keys, "step"], "price", BAND)
