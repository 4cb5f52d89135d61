"""Prediction metrics: grouped, conditional and power-sum aggregates over prediction rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricepanel.functions.expressions import first_argmax, ratio, softmax
from pricepanel.functions.storage import written


def _n(ok: Column) -> Column:
    return F.count(F.when(ok, 1))


def binary(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Counts, accuracy and error rates; a rate over no rows is 0."""
    t, p = F.col(true) == 1, F.col(pred) == 1
    sums = df.agg(_n(t & p).alias("tp"), _n(~t & ~p).alias("tn"), _n(~t & p).alias("fp"), _n(t & ~p).alias("fn"))
    rate = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    c = F.col
    return sums.withColumns(
        {"accuracy": rate(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")), "fpr": rate(c("fp"), c("fp") + c("tn")), "fnr": rate(c("fn"), c("fn") + c("tp"))}
    )


def confusion(df: DataFrame, true: str, pred: str, classes: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Dense ``classes`` squared table: count and percent of the true class (NULL for an absent one)."""
    counts = df.groupBy(*keys, F.col(true).cast("int").alias("y_true"), F.col(pred).cast("int").alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))
    cells = F.sequence(F.lit(0), F.lit(classes - 1))
    counts = written(counts, "confusion-counts") if keys else counts  # read for its keys too, so that ``df`` is read once
    base = counts.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    grid = base.withColumn("y_true", F.explode(cells)).withColumn("y_pred", F.explode(cells))
    full = grid.join(counts, [*keys, "y_true", "y_pred"], "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(*keys, "y_true"))
    return full.withColumn("percent", ratio(100 * F.col("n"), total))


def macro_recall(table: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the diagonal over the classes present."""
    return table.where("y_true = y_pred").groupBy(*keys).agg(F.avg("percent").alias("macro_recall"))


def residual_errors(df: DataFrame, true: str, pred: str, bin_of: Callable[[Column], Column], bins: list[str]) -> DataFrame:
    """Mean squared error over all rows beside the mean absolute error of every bin of the true value."""
    error = F.col(true) - F.col(pred)
    mse = df.agg(F.avg(error * error).alias("mse"))
    per_bin = df.groupBy(bin_of(F.col(true)).alias("bin")).agg(F.avg(F.abs(error)).alias("mae"), F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, bins))).alias("bin"))
    return grid.join(per_bin, "bin", "left").na.fill(0, ["n"]).crossJoin(F.broadcast(mse))


def errors_by_label(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Per true label: mean absolute and squared error, mean and population deviation of the prediction."""
    error = F.col(true) - F.col(pred)
    return df.groupBy(F.col(true).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"), F.avg(pred).alias("mean_pred"), F.stddev_pop(pred).alias("std_pred")
    )


def label_change_lag(df: DataFrame, key: str, order: str, true: str, pred: str, k: int) -> DataFrame:
    """Errors in the unbroken run that starts at a label change, within ``k`` steps: their share of all errors, and the mean steps to its end.

    A change is followed up to its first correct row or the next change, ``k`` steps at most.
    """
    w = Window.partitionBy(key).orderBy(order)
    rows = df.withColumns({"_wrong": F.col(true) != F.col(pred), "_change": F.coalesce(F.col(true) != F.lag(true).over(w), F.lit(False))})
    rows = rows.withColumn("_run", F.sum(F.col("_change").cast("int")).over(w))
    in_run = Window.partitionBy(key, "_run").orderBy(order)
    rows = rows.withColumns({"_step": F.row_number().over(in_run) - 1, "_right": F.sum((~F.col("_wrong")).cast("int")).over(in_run)})
    lagging = (F.col("_run") > 0) & F.col("_wrong") & (F.col("_right") == 0) & (F.col("_step") < k)
    runs = rows.where("_run > 0").groupBy(key, "_run").agg(_n(lagging).alias("steps"))
    errors = rows.agg(_n(F.col("_wrong")).alias("errors"))
    return runs.agg(F.sum("steps").alias("lag_errors"), F.avg("steps").alias("mean_steps"), F.count(F.lit(1)).alias("changes")).crossJoin(errors).withColumn(
        "lag_share", ratio(F.col("lag_errors"), F.col("errors"))
    )


def calibration(df: DataFrame, z: str, key: str, order: str, eps: float = 1e-8) -> DataFrame:
    """Moments, coverage within 1 to 3 deviations and lag-1 autocorrelation of standardised residuals, in two aggregations."""
    rows = df.withColumn("_back", F.lag(z).over(Window.partitionBy(key).orderBy(order)))
    mean = rows.agg(F.avg(z).alias("_m"), F.stddev_pop(z).alias("_s"))
    d = F.col(z) - F.col("_m")
    t = d / (F.col("_s") + eps)
    joined = rows.crossJoin(F.broadcast(mean))
    pairs = F.sum(d * (F.col("_back") - F.col("_m")))
    out = [
        F.count(z).alias("n"), F.first("_m").alias("mean"), F.first("_s").alias("std"), *(F.avg((F.abs(z) <= k).cast("int")).alias(f"within_{k}") for k in (1, 2, 3)),
        ratio(pairs, F.sum(d * d) + eps).alias("lag1"), F.avg(t * t * t).alias("skew"), (F.avg(t * t * t * t) - 3).alias("excess_kurtosis"),
    ]
    targets = {"target_1": 0.6827, "target_2": 0.9545, "target_3": 0.9973}
    return joined.agg(*out).withColumns({k: F.lit(v) for k, v in targets.items()})


def recovery(df: DataFrame, pairs: dict[str, tuple[str, str]], threshold: float) -> DataFrame:
    """For each named pair of predicted and true parameter: mean absolute error, correlation (0 without spread) and whether it reaches ``threshold``."""
    out = None
    for name, (a, b) in pairs.items():
        one = df.agg(F.lit(name).alias("parameter"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mae"), F.coalesce(F.corr(a, b), F.lit(0.0)).alias("corr"))
        one = one.withColumn("recovered", F.col("corr") >= threshold)
        out = one if out is None else out.union(one)
    return out


CLASS_NAMES = ("Down", "NoTouch", "Up")


def class_vote(members: DataFrame, keys: list[str], p: list[str]) -> DataFrame:
    """Mean member probability of each class and the class of the largest, the first on a tie, by name."""
    mean = members.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in p))
    at = first_argmax(*(F.round(c, 12) for c in p))
    return mean.withColumn("vote", at).withColumn("vote_name", F.array(*map(F.lit, CLASS_NAMES))[F.col("vote")])


def ensemble_regression(members: DataFrame, keys: list[str], value: str) -> DataFrame:
    return members.groupBy(*keys).agg(F.avg(value).alias(f"{value}_mean"), F.stddev_samp(value).alias(f"{value}_std"))


def repeated_runs(table: DataFrame, cells: list[str], value: str) -> DataFrame:
    """Mean and population deviation of each cell over runs."""
    return table.groupBy(*cells).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("runs"))


def weighted_mse(df: DataFrame, true: str, pred: str, weights: list[float], shift: int) -> DataFrame:
    """Squared error weighted by label, ``weights`` scaled to mean 1; the label's place is shifted and clamped."""
    scale = len(weights) / sum(weights)
    at = F.least(F.greatest(F.round(F.col(true)).cast("int") + shift, F.lit(0)), F.lit(len(weights) - 1))
    weight = F.array(*(F.lit(w * scale) for w in weights))[at]
    error = F.col(true) - F.col(pred)
    return df.agg(F.avg(weight * error * error).alias("weighted_mse"), F.avg(error * error).alias("mse"))


def gaussian_nll(x: Column, nxt: Column, mu: Column, sigma: Column, dt: float = 1.0, eps: float = 1e-6) -> Column:
    var = (sigma + eps) * (sigma + eps) * dt + eps
    gap = nxt - x - mu * dt
    return 0.5 * (F.ln(var) + gap * gap / var)


def transition_scores(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean negative log-likelihood of ``(x, nxt, mu, sigma)`` and root mean squared error of the next value."""
    gap = F.col("nxt") - F.col("x") - F.col("mu")
    return df.groupBy(*keys).agg(F.avg(gaussian_nll(*(F.col(c) for c in ("x", "nxt", "mu", "sigma")))).alias("nll"), F.sqrt(F.avg(gap * gap)).alias("rmse"))


def class_decisions(df: DataFrame, logits: str, threshold: float = 0.5) -> DataFrame:
    """:func:`decisions` for an array of logits of any length: ``p`` (array), ``argmax`` (the first on a tie) and ``positive``."""
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    positive = (1 / (1 + F.exp(-F.element_at(logits, 1))) > threshold).cast("int")
    return df.withColumns({"p": F.transform(weights, lambda x: x / total), "argmax": (F.array_position(logits, top) - 1).cast("int"), "positive": positive})


def decisions(df: DataFrame, logits: list[str], threshold: float = 0.5) -> DataFrame:
    """Softmax probabilities with their argmax, and for the first logit alone the sigmoid's decision."""
    p = softmax(*(F.col(c) for c in logits))
    out = df.withColumns({f"p{i}": q for i, q in enumerate(p)})
    return out.withColumn("argmax", first_argmax(*(F.col(c) for c in logits))).withColumn("positive", (1 / (1 + F.exp(-F.col(logits[0]))) > threshold).cast("int"))
