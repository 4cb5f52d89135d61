"""Queries E01-E18 and F01-F09 over the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricepanel.operators import features as fx
from pricepanel.operators import normalise as nm
from pricepanel.operators.panel import PANEL_SQL, panel
from pricepanel.plans.registry import query

P = f"WITH {PANEL_SQL}"
O = "PARTITION BY issue_id ORDER BY date"  # noqa: E741
K = "issue_id, date"


def w(k: int) -> str:
    return f"OVER ({O} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


WU = f"OVER ({O} ROWS UNBOUNDED PRECEDING)"
RET = f"{P}, r AS (SELECT *, cl_adj_loc / lag(cl_adj_loc) OVER ({O}) - 1 AS ret FROM panel)"
CL = "cl_adj_loc"


@query(f"{P} SELECT {K}, ln(cl_adj_loc) AS v FROM panel WHERE cl_adj_loc > 0", "v")
def e01_log_value(spark, d):
    return fx.log_value(panel(spark, d), CL, "v").select("issue_id", "date", "v")


@query(f"{P} SELECT {K}, cl_adj_loc + op_adj_loc AS v FROM panel WHERE op_adj_loc IS NOT NULL", "v")
def e02_sum_of_columns(spark, d):
    return fx.sum_of(panel(spark, d), (CL, "op_adj_loc"), "v").select("issue_id", "date", "v")


@query(f"{P} SELECT {K}, cl_adj_loc + op_adj_loc AS v FROM panel", "v")
def e03_open_close_sum(spark, d):
    return fx.sum_of(panel(spark, d), (CL, "op_adj_loc"), "v", drop=False).select("issue_id", "date", "v")


@query(
    f"""{P}, r AS (SELECT *, ln(cl_adj_loc / lag(cl_adj_loc) OVER ({O})) AS raw FROM panel),
    f AS (SELECT {K}, last_value(raw IGNORE NULLS) {WU} AS ret FROM r),
    s AS (SELECT {K}, CASE WHEN count(ret) {w(21)} >= 4 THEN stddev_samp(ret) {w(21)} END AS v FROM f)
    SELECT * FROM s WHERE v IS NOT NULL""",
    "v",
)
def e04_close_volatility(spark, d):
    return fx.close_volatility(panel(spark, d), CL, "v").select("issue_id", "date", "v")


@query(
    f"""{P}, a AS (SELECT {K}, list(cl_adj_loc) {w(21)} AS x FROM panel), b AS (SELECT {K}, x, list_avg(x) AS m FROM a WHERE len(x) = 21),
    c AS (SELECT {K}, m, unnest(x) AS p, generate_subscripts(x, 1) AS i FROM b),
    e AS (SELECT {K}, sum(p - m) OVER (PARTITION BY {K} ORDER BY i) AS y, (p - m) * (p - m) AS q FROM c),
    g AS (SELECT {K}, max(y) - min(y) AS r, sqrt(sum(q) / 21) AS s FROM e GROUP BY {K})
    SELECT {K}, ln(r / s) / ln(21.0) AS v FROM g WHERE s > 1e-12 AND r > 0""",
    "v",
)
def e05_hurst(spark, d):
    return fx.hurst(panel(spark, d), CL, "v").select("issue_id", "date", "v")


def _sma_sql(s: int, n: int) -> str:
    return f"{P}, a AS (SELECT {K}, CASE WHEN count(cl_adj_loc) {w(n)} = {n} THEN avg(cl_adj_loc) {w(s)} / avg(cl_adj_loc) {w(n)} END AS v FROM panel) SELECT * FROM a WHERE v IS NOT NULL"


@query(_sma_sql(50, 200), "v")
def e06_sma_50_200(spark, d):
    return fx.sma_ratio(panel(spark, d), CL, "v", 50, 200).select("issue_id", "date", "v")


@query(_sma_sql(50, 100), "v")
def e06_sma_50_100(spark, d):
    return fx.sma_ratio(panel(spark, d), CL, "v", 50, 100).select("issue_id", "date", "v")


@query(_sma_sql(100, 200), "v")
def e06_sma_100_200(spark, d):
    return fx.sma_ratio(panel(spark, d), CL, "v", 100, 200).select("issue_id", "date", "v")


@query(f"{RET}, a AS (SELECT {K}, CASE WHEN count(ret) {w(21)} = 21 THEN min(ret) {w(21)} END AS v FROM r) SELECT * FROM a WHERE v IS NOT NULL", "v")
def e07_min_return(spark, d):
    return fx.min_return(panel(spark, d), CL, "v").select("issue_id", "date", "v")


@query(f"{RET} SELECT {K}, CASE WHEN count(ret) {w(21)} = 21 THEN max(ret) {w(21)} END AS v FROM r", "v")
def e08_max_return(spark, d):
    return fx.max_return(panel(spark, d), CL, "v").select("issue_id", "date", "v")


@query(f"{P}, a AS (SELECT {K}, cl_adj_loc / lag(cl_adj_loc, 21) OVER ({O}) - 1 AS v FROM panel) SELECT * FROM a WHERE v IS NOT NULL", "v")
def e09_cumulative_return(spark, d):
    return fx.cumulative_return(panel(spark, d), CL, "v").select("issue_id", "date", "v")


@query(
    f"""{P}, a AS (SELECT {K}, cl_adj_loc AS p, avg(cl_adj_loc) {w(21)} AS m, stddev_samp(cl_adj_loc) {w(21)} AS s, count(cl_adj_loc) {w(21)} AS n FROM panel)
    SELECT {K}, (p - (m - 2 * s)) / (4 * s) AS v FROM a WHERE n = 21 AND s <> 0""",
    "v",
)
def e10_percent_b(spark, d):
    return fx.percent_b(panel(spark, d), CL, "v").select("issue_id", "date", "v")


@query(
    f"""{P}, a AS (SELECT {K}, cl_adj_loc - lag(cl_adj_loc) OVER ({O}) AS x FROM panel),
    b AS (SELECT {K}, avg(greatest(x, 0)) {w(14)} AS g, avg(greatest(-x, 0)) {w(14)} AS l, count(x) {w(14)} AS n FROM a)
    SELECT {K}, 100 - 100 / (1 + g / (l + 1e-6)) AS v FROM b WHERE n = 14""",
    "v",
    4,
)
def e11_rsi(spark, d):
    return fx.rsi(panel(spark, d), CL, "v").select("issue_id", "date", "v")


@query(f"{P}, a AS (SELECT {K}, coalesce(sign(cl_adj_loc - lag(cl_adj_loc) OVER ({O})) * vo_adj, 0) AS x FROM panel) SELECT {K}, sum(x) {WU} AS v FROM a", "v")
def e12_on_balance_volume(spark, d):
    return fx.on_balance_volume(panel(spark, d), CL, "vo_adj", "v").select("issue_id", "date", "v")


@query(
    f"""{P}, a AS (SELECT {K}, cl_adj_loc, vo_adj, CASE WHEN count(cl_adj_loc) {w(14)} = 14 THEN cl_adj_loc / lag(cl_adj_loc, 21) OVER ({O}) - 1 END AS c,
      lag(cl_adj_loc, 21) OVER ({O}) AS back FROM panel),
    b AS (SELECT {K}, cl_adj_loc, vo_adj, cl_adj_loc / back - 1 AS c, cl_adj_loc - lag(cl_adj_loc) OVER ({O}) AS raw FROM a WHERE back IS NOT NULL),
    e AS (SELECT {K}, c, cl_adj_loc, vo_adj, cl_adj_loc - lag(cl_adj_loc) OVER ({O}) AS x FROM b),
    g AS (SELECT *, avg(greatest(x, 0)) {w(14)} AS gain, avg(greatest(-x, 0)) {w(14)} AS loss, count(x) {w(14)} AS n FROM e),
    h AS (SELECT {K}, c, 100 - 100 / (1 + gain / (loss + 1e-6)) AS rsi, cl_adj_loc, vo_adj FROM g WHERE n = 14),
    i AS (SELECT *, coalesce(sign(cl_adj_loc - lag(cl_adj_loc) OVER ({O})) * vo_adj, 0) AS s FROM h)
    SELECT {K}, c AS CumRet1m, rsi AS Rsi14, sum(s) {WU} AS OnBalanceVolume FROM i""",
    "CumRet1m Rsi14 OnBalanceVolume",
    4,
)
def e13_feature_dispatcher(spark, d):
    return fx.add_features(panel(spark, d), ["CumRet1m", "Rsi14", "OnBalanceVolume"]).select("issue_id", "date", "CumRet1m", "Rsi14", "OnBalanceVolume")


@query(f"{P} SELECT {K}, last_value(lo_adj_loc IGNORE NULLS) {WU} AS v FROM panel", "v")
def e14_forward_fill(spark, d):
    return fx.forward_fill(panel(spark, d), "lo_adj_loc", "v").select("issue_id", "date", "v")


@query(f"{P} SELECT {K}, avg(vo_adj) {w(20)} AS v FROM panel", "v")
def e15_rolling_smooth(spark, d):
    return fx.smoothed(panel(spark, d), "vo_adj", "v").select("issue_id", "date", "v")


@query(f"{RET}, a AS (SELECT {K}, CASE WHEN count(ret) {w(20)} = 20 THEN stddev_pop(ret) {w(20)} END AS v FROM r) SELECT * FROM a WHERE v IS NOT NULL", "v")
def e16_rolling_volatility(spark, d):
    return fx.rolling_volatility(panel(spark, d), CL, "v").select("issue_id", "date", "v")


@query(f"{P}, a AS (SELECT issue_id, 1 - cl_adj_loc / max(cl_adj_loc) {WU} AS dd FROM panel) SELECT issue_id, max(dd) AS max_drawdown FROM a GROUP BY 1", "max_drawdown")
def e17_max_drawdown(spark, d):
    return fx.drawdown(panel(spark, d), CL, "dd").groupBy("issue_id").agg(F.max("dd").alias("max_drawdown"))


@query(f"{P} SELECT {K}, lag(cl_adj_loc) OVER ({O}) AS previous, cl_adj_loc - lag(cl_adj_loc) OVER ({O}) AS change FROM panel", "previous change")
def e18_lag_and_change(spark, d):
    return fx.lags(panel(spark, d), CL).select("issue_id", "date", "previous", "change")


G = "OVER (PARTITION BY issue_id)"


@query(f"{P} SELECT {K}, (cl_adj_loc - avg(cl_adj_loc) {G}) / CASE WHEN stddev_samp(cl_adj_loc) {G} = 0 THEN 1e-6 ELSE stddev_samp(cl_adj_loc) {G} END AS v FROM panel", "v")
def f01_zscore_by_group(spark, d):
    return nm.by_group(panel(spark, d), CL, "issue_id", "v", "zscore").select("issue_id", "date", "v")


@query(f"{P} SELECT {K}, (cl_adj_loc - min(cl_adj_loc) {G}) / CASE WHEN max(cl_adj_loc) {G} = min(cl_adj_loc) {G} THEN 1e-6 ELSE max(cl_adj_loc) {G} - min(cl_adj_loc) {G} END AS v FROM panel", "v")
def f02_minmax_by_group(spark, d):
    return nm.by_group(panel(spark, d), CL, "issue_id", "v", "minmax").select("issue_id", "date", "v")


@query(f"{P} SELECT {K}, cl_adj_loc / 100 AS v FROM panel", "v")
def f03_percent_scale(spark, d):
    return nm.by_group(panel(spark, d), CL, "issue_id", "v", "percent").select("issue_id", "date", "v")


WIN = f"{P}, a AS (SELECT {K}, list(cl_adj_loc) {w(21)} AS x, list(vo_adj) {w(21)} AS y FROM panel), b AS (SELECT * FROM a WHERE len(x) = 21)"
MM = "list_transform({0}, lambda q: round((q - list_min({0})) / (list_max({0}) - list_min({0}) + 1e-6), 6) + 0.0)"
ZS = "list_transform({0}, lambda q: round((q - list_avg({0})) / (list_stddev_pop({0}) + 1e-6), 4) + 0.0)"


@query(f"{WIN} SELECT {K}, {MM.format('x')} AS x FROM b")
def f04_sample_minmax(spark, d):
    return nm.windows_normalised(panel(spark, d), {"x": (CL, "sample_minmax")}, 21, {"x": 6})


@query(f"{WIN} SELECT {K}, {ZS.format('x')} AS x FROM b")
def f05_sample_zscore(spark, d):
    return nm.windows_normalised(panel(spark, d), {"x": (CL, "sample_zscore")}, 21, {"x": 4})


@query(f"{WIN} SELECT {K}, {MM.format('x')} AS x, {ZS.format('y')} AS y FROM b")
def f06_group_variants(spark, d):
    return nm.windows_normalised(panel(spark, d), {"x": (CL, "group_minmax"), "y": ("vo_adj", "group_zscore")}, 21, {"x": 6, "y": 4})


@query(f"{WIN} SELECT {K}, {MM.format('x')} AS x, y FROM b")
def f07_normalisation_map(spark, d):
    return nm.windows_normalised(panel(spark, d), {"x": (CL, "sample_minmax"), "y": ("vo_adj", None)}, 21, {"x": 6})


@query(
    f"""{P}, a AS (SELECT {K}, cl_adj_loc AS p, min(cl_adj_loc) {w(64)} AS lo, greatest(max(cl_adj_loc) {w(64)} - min(cl_adj_loc) {w(64)}, 1e-8) AS rng,
    count(cl_adj_loc) {w(64)} AS n, lead(cl_adj_loc) OVER ({O}) AS nxt FROM panel)
    SELECT {K}, lo AS price_min, rng AS price_range, (p - lo) / rng AS last_scaled, (nxt - lo) / rng AS next_scaled FROM a WHERE n = 64 AND nxt IS NOT NULL""",
    "price_min price_range last_scaled next_scaled",
)
def f08_window_minmax(spark, d):
    return nm.window_scale(panel(spark, d), CL, 64)


@query(
    f"""{P}, a AS (SELECT {K}, cl_adj_loc AS p, min(cl_adj_loc) {w(64)} AS lo, greatest(max(cl_adj_loc) {w(64)} - min(cl_adj_loc) {w(64)}, 1e-8) AS rng, count(cl_adj_loc) {w(64)} AS n FROM panel)
    SELECT {K}, (p * 1.1 - lo) / rng AS path_rescaled, lo AS hist_min, rng AS hist_range FROM a WHERE n = 64""",
    "path_rescaled hist_min hist_range",
)
def f09_historical_rescale(spark, d):
    origins = nm.history_range(panel(spark, d), CL, 64)
    return nm.rescaled(origins.withColumn("path", F.col(CL) * 1.1), "path", "path_rescaled").select("issue_id", "date", "path_rescaled", "hist_min", "hist_range")
