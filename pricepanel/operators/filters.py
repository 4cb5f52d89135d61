"""Row predicates, guards, fills and identifiers of the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricepanel.functions.expressions import ordered, ratio, trailing
from pricepanel.operators.calendar import trading_days
from pricepanel.operators.sampling import numbered


def issue_date_filter(df: DataFrame, ids: list[str] | None, start: str, end: str) -> DataFrame:
    """Inclusive date range and ids; apply it after features, so that rows before ``start`` warm them up."""
    inside = F.col("date").between(start, end)
    return df.where(inside if ids is None else inside & F.col("issue_id").isin(ids))


def temporal_split(df: DataFrame, start: str, train_end: str, test_end: str) -> DataFrame:
    """``split`` train and val; the boundary day is in both."""
    parts = F.array(
        F.when(F.col("date").between(start, train_end), F.lit("train")), F.when(F.col("date").between(train_end, test_end), F.lit("val"))
    )
    return df.withColumn("split", F.explode(F.array_compact(parts)))


def standard_columns(prices: DataFrame, securities: DataFrame) -> DataFrame:
    """Dates as ISO text under the names that a merged table has."""
    prices = prices.withColumn("date_prices", F.date_format("date", "yyyy-MM-dd")).drop("date")
    return prices.join(securities.withColumnRenamed("sector", "industry_sector"), "issue_id")


def coerced(df: DataFrame, date: str, value: str) -> DataFrame:
    """Text columns read as date and number; rows where either fails are dropped. An empty result is the caller's error."""
    out = df.withColumn(date, F.expr(f"try_cast({date} AS date)")).withColumn(value, F.expr(f"try_cast({value} AS double)"))
    return out.where(F.col(date).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value))


def path_sane(paths: DataFrame, keys: list[str], most: float = 4.0, least: float = 0.05) -> DataFrame:
    """``is_valid`` per path ``(keys, step, price)``: positive, within multiples of its start, no daily return above 1 in size."""
    back = F.lag("price").over(Window.partitionBy(*keys).orderBy("step"))
    rows = paths.withColumn("_r", F.abs(ratio(F.col("price"), back) - 1))
    stats = rows.groupBy(*keys).agg(
        F.min("price").alias("lo"), F.max("price").alias("hi"), F.min_by("price", "step").alias("s0"), F.coalesce(F.max("_r"), F.lit(0.0)).alias("r")
    )
    sane = (F.col("lo") > 0) & (F.col("hi") / F.col("s0") <= most) & (F.col("lo") / F.col("s0") >= least) & (F.col("r") <= 1)
    return stats.select(*keys, F.coalesce(sane, F.lit(False)).alias("is_valid"))


def probabilities_valid(p: list[Column]) -> Column:
    """Three finite probabilities, none negative, that sum to 1 within 1e-5 (absolute and relative)."""
    finite = F.lit(True)
    for c in p:
        finite = finite & c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c < float("inf"))
    return F.coalesce(finite & (F.abs(sum(p[1:], p[0]) - 1) <= 2e-5), F.lit(False))


def invalid_reason(rows: DataFrame, keys: list[str], price: str, p: list[str], features: list[str]) -> DataFrame:
    """First reason that makes a path invalid, empty if none does."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    any_bad = F.lit(False)
    for c in features:
        any_bad = any_bad | bad(c)
    flags = rows.groupBy(*keys).agg(
        F.bool_or(bad(price)).alias("nonfinite"),
        F.bool_or(F.coalesce(F.col(price) <= 0, F.lit(False))).alias("nonpositive"),
        F.bool_or(any_bad).alias("features"),
        F.bool_or(~probabilities_valid([F.col(c) for c in p])).alias("probabilities"),
    )
    reason = F.when(F.col("nonfinite"), "nonfinite price").when(F.col("nonpositive"), "nonpositive price")
    reason = reason.when(F.col("features"), "nonfinite features").when(F.col("probabilities"), "invalid probabilities").otherwise("")
    return flags.select(*keys, reason.alias("reason"))


def zone_level(price: Column, levels: Column, tolerance: float) -> Column:
    """Nearest level within the tolerance, the lower one on a tie; NULL if there is none."""
    near = F.filter(levels, lambda v: F.abs(price - v) <= tolerance)
    return F.array_min(F.transform(near, lambda v: F.struct(F.abs(price - v).alias("distance"), v.alias("level"))))["level"]


def side(price: Column, level: Column, tolerance: float) -> Column:
    return F.when(price < level - tolerance, "below").when(price > level + tolerance, "above").otherwise("inside")


def origin_exclusions(origins: DataFrame) -> DataFrame:
    """``reason`` for origins ``(lo, hi, finite)`` of their history that can't be used, empty for the others."""
    reason = F.when(~F.col("finite"), "nonfinite history").when(F.col("lo") <= 0, "nonpositive history")
    return origins.withColumn("reason", reason.when(F.col("hi") - F.col("lo") < 1e-8, "constant history").otherwise(""))


def history_stats(df: DataFrame, src: str, k: int) -> DataFrame:
    """``lo, hi, finite`` of the last ``k`` rows of each full window."""
    w = trailing(k)
    rows = df.withColumns({"lo": F.min(src).over(w), "hi": F.max(src).over(w), "_n": F.count(F.lit(1)).over(w), "finite": F.count(src).over(w) == k})
    return rows.where(F.col("_n") == k).drop("_n")


def is_synthetic(issue_id: Column) -> Column:
    return F.lower(issue_id).contains("synthetic")


def drop_incomplete(df: DataFrame, *cols: str) -> DataFrame:
    """Without any security that has a null in ``cols``."""
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.col(c).isNull()
    return df.join(df.where(bad).select("issue_id").distinct(), "issue_id", "left_anti")


def filled_open(df: DataFrame, open_: str, close: str) -> DataFrame:
    return df.withColumn(open_, F.coalesce(open_, F.lag(close).over(ordered())))


def anonymised(df: DataFrame) -> DataFrame:
    """Ids replaced by their rank as ``0001`` and on; only the distinct ids are ordered."""
    ids = numbered(df.select("issue_id").distinct(), "issue_id")
    return df.join(ids, "issue_id").withColumn("issue_id", F.lpad(F.col("_n").cast("string"), 4, "0")).drop("_n", "_all")


def student_export(df: DataFrame) -> DataFrame:
    """Complete securities, opens filled, days recomputed, ids anonymised."""
    rows = filled_open(drop_incomplete(df, "lo_adj_loc", "hi_adj_loc"), "op_adj_loc", "cl_adj_loc")
    return anonymised(trading_days(rows)).select(
        "issue_id", "trading_day", "date", F.col("op_adj_loc").alias("open"), F.col("hi_adj_loc").alias("high"),
        F.col("lo_adj_loc").alias("low"), F.col("cl_adj_loc").alias("close"), F.col("vo_adj").alias("volume"),
    )


def synthetic_id(issue_id: Column, i: Column) -> Column:
    return F.concat(issue_id, F.lit("_synthetic_"), i.cast("string"))


def monte_carlo_id(issue_id: Column, base: Column, iteration: Column) -> Column:
    return F.concat(issue_id, F.format_string("_synthetic_MC_%04d_%03d", base, iteration))


def padded_id(issue_id: Column) -> Column:
    return F.when(issue_id.rlike("^[0-9]+$") & (F.length(issue_id) < 8), F.lpad(issue_id, 8, "0")).otherwise(issue_id)
