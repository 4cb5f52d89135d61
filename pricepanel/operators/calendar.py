"""Trading-day positions, gaps, bars, business days and evaluation segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricepanel.functions.expressions import ordered


def trading_days(df: DataFrame) -> DataFrame:
    """``trading_day``: position of the date among all dates. Only the distinct dates, a few thousand at most, are ordered in one task."""
    dates = df.select("date").distinct().withColumn("trading_day", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))
    return df.join(dates, "date")


def gaps(df: DataFrame) -> DataFrame:
    """``gap``: trading days without a row between a security's row and the one before."""
    day = F.col("trading_day")
    return trading_days(df).withColumn("gap", day - F.lag("trading_day").over(ordered()) - 1)


def one_day_gaps(df: DataFrame) -> DataFrame:
    previous = F.lag("trading_day").over(ordered())
    return gaps(df).withColumn("prev_day", previous).where("gap = 1").select("issue_id", (F.col("trading_day") - 1).alias("missing_day"), "prev_day")


def bar_end(date: Column | str, bar: str) -> Column:
    """Friday of the date's week (Saturday and Sunday belong to the next) or last day of its month."""
    if bar == "weekly":
        return F.date_add(F.to_date(F.date_trunc("week", F.date_add(date, 2))), 4)
    if bar == "monthly":
        return F.last_day(date)
    if bar == "daily":
        return F.col(date) if isinstance(date, str) else date
    raise ValueError(f"unknown time bar: {bar}")


def bars(df: DataFrame, src: str, bar: str, key: str = "issue_id", date: str = "date") -> DataFrame:
    """Last value of each bar that isn't null."""
    known = df.where(F.col(src).isNotNull())
    return known.groupBy(key, bar_end(date, bar).alias("bar")).agg(F.max_by(src, date).alias(src))


#: Rows of a daily window that make one of a bar's.
STRIDE = {"daily": 1, "weekly": 5, "monthly": 21}


def window_size(days: Column, bar: str) -> Column:
    return F.floor(days / STRIDE[bar]).cast("long")


def strided(window: Column, bar: str) -> Column:
    """Every 1st, 5th or 21st element from the window's start."""
    step = STRIDE[bar]
    return F.filter(window, lambda x, i: i % step == 0)


def business_days(df: DataFrame, start: str, n: int) -> DataFrame:
    """``step, day``: ``n + 1`` weekdays from each row's ``start``, rolled forward from a weekend."""
    span = F.sequence(F.col(start), F.date_add(start, 2 + (n + 1) * 7 // 5 + 7))
    days = F.slice(F.filter(span, lambda d: F.weekday(d) < 5), 1, n + 1)
    return df.select("*", F.posexplode(days).alias("step", "day"))


def full_year_ids(df: DataFrame, first: str, last: str) -> DataFrame:
    """Securities with rows in every year of the range."""
    inside = df.where(F.col("date").between(first, last))
    years = int(last[:4]) - int(first[:4]) + 1
    return inside.groupBy("issue_id").agg(F.countDistinct(F.year("date")).alias("years")).where(F.col("years") == years).select("issue_id")


def positions(df: DataFrame) -> DataFrame:
    """``pos``: zero-based position of the row in its security."""
    return df.withColumn("pos", (F.row_number().over(ordered()) - 1).cast("long"))


def segment_origins(df: DataFrame, lookback: int, horizon: int, start: str, end: str) -> DataFrame:
    """Origins ``horizon`` apart with a full lookback before and a full horizon up to ``end``."""
    rows = positions(df)
    w = Window.partitionBy("issue_id")
    first = F.greatest(F.min(F.when(F.col("date") >= start, F.col("pos"))).over(w), F.lit(lookback - 1))
    last = F.max(F.when(F.col("date") <= end, F.col("pos"))).over(w)
    rows = rows.withColumns({"_first": first, "_last": last})
    ok = (F.col("pos") >= F.col("_first")) & ((F.col("pos") - F.col("_first")) % horizon == 0) & (F.col("pos") + horizon <= F.col("_last"))
    return rows.where(ok).select("issue_id", F.col("date").alias("origin_date"), F.col("pos").alias("origin_pos"))


def duplicate_dates(df: DataFrame) -> DataFrame:
    """Securities with a date twice."""
    return df.groupBy("issue_id", "date").count().where("count > 1").select("issue_id").distinct()


def without_duplicate_dates(df: DataFrame) -> DataFrame:
    return df.join(duplicate_dates(df), "issue_id", "left_anti")


def weekdays_of(spark: SparkSession, start: str, n: int) -> DataFrame:
    return business_days(spark.range(1).select(F.to_date(F.lit(start)).alias("start")), "start", n)
