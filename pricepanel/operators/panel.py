"""The daily price panel that the driver's tables are read as."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricepanel.functions.expressions import ordered, running

#: The same panel as a common table expression for DuckDB.
PANEL_SQL = """daily AS (
  SELECT l_suppkey::VARCHAR AS issue_id, l_shipdate::DATE AS date, sum(round(100 * l_discount) - 5)::BIGINT AS step, sum(l_quantity) AS vo_adj
  FROM lineitem GROUP BY 1, 2
), closes AS (
  SELECT issue_id, date, vo_adj, round(100 * exp(sum(step) OVER (PARTITION BY issue_id ORDER BY date) / 200.0), 4) AS cl_adj_loc FROM daily
), opens AS (
  SELECT *, lag(cl_adj_loc) OVER (PARTITION BY issue_id ORDER BY date) AS op_adj_loc FROM closes
), panel AS (
  SELECT issue_id, date, op_adj_loc,
         CASE WHEN (date - DATE '1970-01-01') % 97 <> 0 THEN greatest(coalesce(op_adj_loc, cl_adj_loc), cl_adj_loc) END AS hi_adj_loc,
         CASE WHEN (date - DATE '1970-01-01') % 97 <> 0 THEN least(coalesce(op_adj_loc, cl_adj_loc), cl_adj_loc) END AS lo_adj_loc,
         cl_adj_loc, vo_adj
  FROM opens
)"""

UNIVERSE_SQL = """universe AS (
  SELECT s_suppkey::VARCHAR AS issue_id, r_name AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``issue_id, date, op, hi, lo, cl (adj_loc), vo_adj``: one row per supplier and shipping day.

    Lines are summed before the shuffle; the windows share the grouping's partitioning by security.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("issue_id"), F.to_date("l_shipdate").alias("date"), "l_discount", "l_quantity"
    )
    daily = lines.groupBy("issue_id", "date").agg(
        F.sum(F.round(100 * F.col("l_discount")) - 5).cast("long").alias("step"), F.sum("l_quantity").alias("vo_adj")
    )
    daily = daily.withColumn("cl_adj_loc", F.round(100 * F.exp(F.sum("step").over(running()) / 200.0), 4))
    daily = daily.withColumn("op_adj_loc", F.lag("cl_adj_loc").over(ordered()))
    quoted = F.unix_date("date") % 97 != 0
    opened = F.coalesce("op_adj_loc", "cl_adj_loc")
    return daily.select(
        "issue_id",
        "date",
        "op_adj_loc",
        F.when(quoted, F.greatest(opened, "cl_adj_loc")).alias("hi_adj_loc"),
        F.when(quoted, F.least(opened, "cl_adj_loc")).alias("lo_adj_loc"),
        "cl_adj_loc",
        "vo_adj",
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``issue_id, sector``: a supplier's region."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("issue_id"), "s_nationkey")
    places = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", F.col("r_name").alias("sector"))
    return supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey")).select("issue_id", "sector")
