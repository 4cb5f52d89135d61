"""Lookups and joins of the panel, its origins and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricepanel.operators.calendar import positions


def realised_future(origins: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """For each ``(issue_id, origin_date)`` its rows from that date on, ``n + 1`` at most: ``step, date, price``.

    A position makes the range a short run of equal keys: each origin names the positions it wants.
    """
    rows = positions(df).select("issue_id", "pos", "date", "cl_adj_loc")
    start = rows.select("issue_id", F.col("date").alias("origin_date"), F.col("pos").alias("_p0"))
    wanted = origins.select("issue_id", "origin_date").join(start, ["issue_id", "origin_date"])
    wanted = wanted.select("issue_id", "origin_date", F.posexplode(F.sequence(F.col("_p0"), F.col("_p0") + n)).alias("step", "pos"))
    return wanted.join(rows, ["issue_id", "pos"]).select("issue_id", "origin_date", "step", "date", F.col("cl_adj_loc").alias("price"))


def origin_windows(origins: DataFrame, df: DataFrame, lookback: int, horizon: int) -> DataFrame:
    """Origins that match one row, with arrays of the ``lookback`` prices up to it and the ``horizon + 1`` from it."""
    once = df.groupBy("issue_id", "date").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("issue_id").orderBy("date")
    rows = df.select(
        "issue_id",
        F.col("date").alias("origin_date"),
        F.collect_list("cl_adj_loc").over(order.rowsBetween(1 - lookback, 0)).alias("history"),
        F.collect_list("cl_adj_loc").over(order.rowsBetween(0, horizon)).alias("future"),
    )
    unique = once.where("_n = 1").select("issue_id", F.col("date").alias("origin_date"))
    matched = origins.select("issue_id", "origin_date").join(unique, ["issue_id", "origin_date"]).join(rows, ["issue_id", "origin_date"])
    return matched.where((F.size("history") == lookback) & (F.size("future") == horizon + 1))


def nearest_day(requests: DataFrame, df: DataFrame) -> DataFrame:
    """Date of the security nearest to ``asked`` (the later on a tie, the latest where nothing is asked): ``date_used``.

    One sorted pass over the union of both sides; a request sees the last date before it and the first after it.
    """
    dates = df.select("issue_id", F.col("date").alias("_at"), F.col("date").alias("_day"), F.lit(None).cast("date").alias("asked"), F.lit(0).alias("_ask"))
    far = F.to_date(F.lit("9999-12-31"))
    asks = requests.select("issue_id", F.coalesce("asked", far).alias("_at"), F.lit(None).cast("date").alias("_day"), "asked", F.lit(1).alias("_ask"))
    order = Window.partitionBy("issue_id").orderBy("_at", "_ask")
    both = dates.unionByName(asks).withColumns(
        {
            "_before": F.last("_day", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "_after": F.first("_day", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    later = F.col("_after").isNotNull() & (F.col("_before").isNull() | (F.datediff("_after", "_at") <= F.datediff("_at", "_before")))
    return both.where("_ask = 1").select("issue_id", "asked", F.when(later, F.col("_after")).otherwise(F.col("_before")).alias("date_used"))


def one_sample(samples: DataFrame, issue_id: str, date: str) -> DataFrame:
    """The sample of a security and date; none or several are an error that names the security's range."""
    found = samples.where((F.col("issue_id") == issue_id) & (F.col("date") == F.lit(date).cast("date")))
    if found.limit(2).count() != 1:
        lo, hi = samples.where(F.col("issue_id") == issue_id).agg(F.min("date"), F.max("date")).first()
        raise ValueError(f"no single sample of {issue_id} on {date}; its dates are {lo} to {hi}")
    return found


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join whose right side must have each key once."""
    if right.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"right side repeats {keys}")
    return left.join(right, keys)


def completed(counts: DataFrame, grid: DataFrame, keys: list[str], zeros: list[str]) -> DataFrame:
    """``counts`` on every row of ``grid``; missing counts are 0, other columns NULL."""
    return grid.join(counts, keys, "left").na.fill(0, subset=zeros)


def reference_errors(ours: DataFrame, reference: DataFrame, keys: list[str], cols: list[str], tolerance: float) -> DataFrame:
    """``rows, missing, violations, max_error`` of ``ours`` against a stored reference."""
    theirs = reference.select(*keys, *(F.col(c).alias(f"_{c}") for c in cols), F.lit(1).alias("_there"))
    error = F.greatest(*(F.abs(F.col(c) - F.col(f"_{c}")) for c in cols), F.lit(0.0))
    return ours.join(theirs, keys, "left").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.col("_there").isNull(), 1)).alias("missing"),
        F.count(F.when(error > tolerance, 1)).alias("violations"),
        F.max(F.when(F.col("_there").isNotNull(), error)).alias("max_error"),
    )


def last_epoch(epochs: DataFrame, finals: DataFrame, run: str, epoch: str, cols: list[str]) -> DataFrame:
    """Each run's row of its last epoch beside its final scalars; runs without finals stay."""
    last = epochs.groupBy(run).agg(F.max_by(F.struct(epoch, *cols), epoch).alias("_l")).select(run, "_l.*")
    return last.join(finals, run, "left")


def pairs_by_date(df: DataFrame, value: str) -> DataFrame:
    """All pairs of securities on their common dates: ``id_a, id_b, date, a, b``."""
    a = df.select("date", F.col("issue_id").alias("id_a"), F.col(value).alias("a"))
    b = df.select("date", F.col("issue_id").alias("id_b"), F.col(value).alias("b"))
    return a.join(b, "date").where("id_a < id_b")
