"""Queries G01-G13 and H01-H13 over the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricepanel.functions.expressions import levels
from pricepanel.operators import trend as tr
from pricepanel.operators import windows as wn
from pricepanel.operators.panel import UNIVERSE_SQL, panel, universe
from pricepanel.plans.calendar_queries import HOR, LOOK, ORIGINS, origins
from pricepanel.plans.feature_queries import K, O, P, w
from pricepanel.plans.registry import query

CL = "cl_adj_loc"
RATIOS = "[0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0]"
RANGES = f"{P}, m AS (SELECT {K}, cl_adj_loc AS last, lag(cl_adj_loc) OVER ({O}) AS previous, min(cl_adj_loc) {w(LOOK)} AS lo, max(cl_adj_loc) {w(LOOK)} AS hi, count(*) {w(LOOK)} AS n FROM panel), z AS (SELECT * FROM m WHERE n = {LOOK})"
DIST = "list_transform([0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0], lambda q: (last - (lo + q * (hi - lo))) / greatest(hi - lo, 1e-8))"
FEATS = f"""f0 AS (SELECT *, {DIST} AS distances FROM z),
  f1 AS (SELECT *, list_position(list_transform(distances, lambda q: round(abs(q), 9)), list_min(list_transform(distances, lambda q: round(abs(q), 9)))) - 1 AS nearest_level, (last - previous) / greatest(hi - lo, 1e-8) AS movement FROM f0),
  feats AS (SELECT *, distances[nearest_level + 1] AS distance FROM f1)"""


def ranges(spark, d):
    return wn.window_range(panel(spark, d), CL, LOOK)


def _rounded(c: str):
    return F.transform(c, lambda x: F.round(x, 6) + F.lit(0.0)).alias(c)


@query(f"{P}, a AS (SELECT {K}, list(cl_adj_loc) {w(16)} AS win, lead(cl_adj_loc) OVER ({O}) AS next_price FROM panel) SELECT {K}, win AS \"window\", next_price FROM a WHERE len(win) = 16 AND next_price IS NOT NULL")
def g01_next_step_windows(spark, d):
    return wn.next_step_windows(panel(spark, d), CL, 16)


@query(f"{P}, a AS (SELECT {K}, list(cl_adj_loc) {w(64)} AS win, lead(cl_adj_loc) OVER ({O}) AS next_price, row_number() OVER ({O}) AS n FROM panel) SELECT {K}, win AS \"window\", next_price FROM a WHERE n BETWEEN 64 AND 83 AND next_price IS NOT NULL")
def g02_window_cap(spark, d):
    return wn.next_step_windows(panel(spark, d), CL, 64, most=20)


@query(f"{P}, a AS (SELECT issue_id, date AS test_date, list(cl_adj_loc) {w(21)} AS train, list(cl_adj_loc) OVER ({O} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS test FROM panel) SELECT * FROM a WHERE len(train) = 21 AND len(test) = 5")
def g03_train_test_windows(spark, d):
    return wn.train_test_windows(panel(spark, d), CL, 21, 5)


@query(f"{P} SELECT issue_id, count(*) AS n FROM panel GROUP BY 1 HAVING count(*) < 540")
def g04_excluded_securities(spark, d):
    return wn.without_windows(panel(spark, d), 540)


LAST3 = f"{P}, r AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY date DESC) AS back, list(cl_adj_loc) {w(21)} AS win, list(cl_adj_loc) OVER ({O} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ahead FROM panel)"


@query(f"{LAST3} SELECT issue_id, date AS test_date, list_transform(win, lambda q: round((q - list_min(win)) / (list_max(win) - list_min(win) + 1e-6), 6) + 0.0) AS features, CASE WHEN len(ahead) = 5 THEN ahead[5] ELSE -100.0 END AS last_ahead FROM r WHERE back IN (1, 6) AND len(win) = 21")
def g05_single_window(spark, d):
    from pyspark.sql import Window

    from pricepanel.operators.normalise import sample_minmax

    order = Window.partitionBy("issue_id").orderBy("date")
    rows = panel(spark, d).select(
        "issue_id", F.col("date").alias("test_date"), F.row_number().over(Window.partitionBy("issue_id").orderBy(F.desc("date"))).alias("back"),
        F.collect_list(CL).over(order.rowsBetween(-20, 0)).alias("win"), F.collect_list(CL).over(order.rowsBetween(1, 5)).alias("ahead"),
    )
    rows = rows.where("back in (1, 6) and size(win) = 21").withColumn("features", sample_minmax(F.col("win")))
    return rows.select("issue_id", "test_date", _rounded("features"), F.when(F.size("ahead") == 5, F.col("ahead")[4]).otherwise(-100.0).alias("last_ahead"))


@query(f"{RANGES} SELECT {K}, list_transform({RATIOS}, lambda q: round(lo + q * (hi - lo), 6) + 0.0) AS levels, hi - lo AS delta FROM z", "delta")
def g06_levels(spark, d):
    rows = ranges(spark, d).withColumn("levels", levels(F.col("lo"), F.col("hi")))
    return rows.select("issue_id", "date", _rounded("levels"), (F.col("hi") - F.col("lo")).alias("delta"))


@query(
    f"""{P}, m AS (SELECT {K}, min(cl_adj_loc) {w(63)} AS lo1, max(cl_adj_loc) {w(63)} AS hi1, min(cl_adj_loc) {w(126)} AS lo2, max(cl_adj_loc) {w(126)} AS hi2, min(cl_adj_loc) {w(252)} AS lo3, max(cl_adj_loc) {w(252)} AS hi3, count(*) {w(252)} AS n FROM panel),
    u AS (SELECT *, CASE WHEN hi1 - lo1 > (hi3 - lo3) / 2 THEN 63 WHEN hi2 - lo2 > (hi3 - lo3) / 2 THEN 126 ELSE 252 END AS rows_used FROM m WHERE n = 252),
    v AS (SELECT {K}, rows_used, CASE rows_used WHEN 63 THEN lo1 WHEN 126 THEN lo2 ELSE lo3 END AS lo, CASE rows_used WHEN 63 THEN hi1 WHEN 126 THEN hi2 ELSE hi3 END AS hi FROM u)
    SELECT *, greatest(hi - lo, 1e-8) AS delta FROM v""",
    "lo hi delta",
)
def g07_multi_horizon_levels(spark, d):
    return wn.multi_horizon_range(panel(spark, d), CL, 63, 126, 252)


@query(f"{RANGES} SELECT {K}, list_transform({DIST}, lambda q: round(q, 6) + 0.0) AS distances FROM z")
def g08_signed_distances(spark, d):
    return ranges(spark, d).select("issue_id", "date", F.transform(wn.signed_distances(F.col("last"), F.col("lo"), F.col("hi")), lambda x: F.round(x, 6) + F.lit(0.0)).alias("distances"))


@query(f"{RANGES}, {FEATS} SELECT {K}, nearest_level, distance, movement FROM feats", "distance movement")
def g09_window_features(spark, d):
    return wn.window_features(ranges(spark, d)).select("issue_id", "date", "nearest_level", "distance", "movement")


@query(f"{P}, m AS (SELECT {K}, cl_adj_loc AS x, cl_adj_loc * cl_adj_loc AS x2, avg(cl_adj_loc) {w(63)} AS mean, stddev_pop(cl_adj_loc) {w(63)} AS std, min(cl_adj_loc) {w(63)} AS lo, max(cl_adj_loc) {w(63)} AS hi, 1.0::DOUBLE AS one, count(*) {w(63)} AS n FROM panel) SELECT * EXCLUDE (n) FROM m WHERE n = 63", "x2 mean std")
def g10_moment_features(spark, d):
    return wn.moment_features(panel(spark, d), CL, 63)


@query(f"{RANGES}, {FEATS} SELECT {K}, CASE WHEN distance < 0 THEN -1 ELSE 1 END AS bounce_sign, CASE WHEN movement < 0 THEN -1 ELSE 1 END AS break_sign FROM feats")
def g11_direction_signs(spark, d):
    return wn.direction_signs(wn.window_features(ranges(spark, d))).select("issue_id", "date", "bounce_sign", "break_sign")


@query(
    f"""{ORIGINS}, h AS (SELECT o.issue_id, origin_date, origin_pos, min(cl_adj_loc) AS lo, max(cl_adj_loc) AS hi FROM origins o JOIN pos p ON p.issue_id = o.issue_id AND p.pos BETWEEN origin_pos - {LOOK - 1} AND origin_pos GROUP BY 1, 2, 3),
    e AS (SELECT h.issue_id, origin_date, list_min(list_transform({RATIOS}, lambda q: abs(cl_adj_loc - (lo + q * (hi - lo))) / greatest(hi - lo, 1e-8))) AS near FROM h JOIN pos p ON p.issue_id = h.issue_id AND p.pos BETWEEN origin_pos + 1 AND origin_pos + {HOR})
    SELECT issue_id, origin_date, avg(near) AS mean_distance FROM e GROUP BY 1, 2""",
    "mean_distance",
)
def g12_fixed_level_distance(spark, d):
    from pricepanel.operators.joins import realised_future

    starts, prices = origins(spark, d), panel(spark, d)
    history = ranges(spark, d).withColumnRenamed("date", "origin_date").join(starts, ["issue_id", "origin_date"])
    return wn.fixed_level_distance(history, realised_future(starts, prices, HOR), ["issue_id", "origin_date"])


@query(
    f"""{ORIGINS}, m AS (SELECT issue_id, pos, date, cl_adj_loc AS last, lag(cl_adj_loc) OVER ({O}) AS previous, min(cl_adj_loc) {w(LOOK)} AS lo, max(cl_adj_loc) {w(LOOK)} AS hi FROM pos)
    SELECT o.issue_id, origin_date, (m.pos - origin_pos)::INT AS step, date, last, previous, lo, hi FROM origins o JOIN m ON m.issue_id = o.issue_id AND m.pos BETWEEN origin_pos AND origin_pos + {HOR}"""
)
def g13_trajectory_windows(spark, d):
    return wn.trajectory_windows(origins(spark, d), panel(spark, d), CL, LOOK, HOR)


T, H = 21, 5
FIT = f"""{P}, ps AS (SELECT *, row_number() OVER ({O}) - 1 AS pos FROM panel),
  f0 AS (SELECT issue_id, date AS test_date, pos, regr_slope(cl_adj_loc, pos) {w(T)} AS slope, regr_intercept(cl_adj_loc, pos) {w(T)} AS at0, regr_sxx(cl_adj_loc, pos) {w(T)} AS sxx, regr_syy(cl_adj_loc, pos) {w(T)} AS syy,
    regr_sxy(cl_adj_loc, pos) {w(T)} AS sxy, min(cl_adj_loc) {w(T)} AS lo, max(cl_adj_loc) {w(T)} AS hi, count(*) {w(T)} AS n, list(cl_adj_loc) OVER ({O} ROWS BETWEEN 1 FOLLOWING AND {H} FOLLOWING) AS test FROM ps),
  fit AS (SELECT issue_id, test_date, slope, at0 + slope * (pos - {T - 1}) AS intercept, sqrt(greatest((syy - sxy * sxy / sxx) / {T}, 0)) AS sigma, lo, hi, test FROM f0 WHERE n = {T} AND len(test) = {H}),
  days AS (SELECT issue_id, test_date, k, test[k + 1] AS y, intercept + slope * ({T} + k) - 1.96 * sigma AS lb, intercept + slope * ({T} + k) + 1.96 * sigma AS ub FROM fit, range({H}) t(k)),
  dev AS (SELECT *, greatest(least(CASE WHEN y >= ub THEN 100 * (y - ub) / ub WHEN y <= lb THEN 100 * (y - lb) / lb ELSE 0 END, 15), -15) AS dv FROM days),
  lab AS (SELECT issue_id, test_date, avg(CASE WHEN y >= lb AND y <= ub THEN 1 ELSE 0 END) AS coverage, min(k) FILTER (y > ub) AS up, min(k) FILTER (y < lb) AS down,
    list(dv ORDER BY k) AS deviations, arg_max(dv, abs(dv) * 1e9 - k) AS residual_label,
    max(CASE WHEN k = 0 AND ub > lb AND y >= lb AND y <= ub THEN greatest(least(1 - 2 * abs((y - lb) / (ub - lb) - 0.5), 1), 0) ELSE 0 END) AS margin FROM dev GROUP BY 1, 2),
  samples AS (SELECT fit.*, slope / (hi - lo + 1e-6) AS slope_normalised, 1.96 * sigma AS half, CASE WHEN hi > lo THEN 2 * 1.96 * sigma / (hi - lo) END AS ci_width, coverage, deviations, residual_label, margin,
    CASE WHEN up IS NULL AND down IS NULL THEN 1 WHEN down IS NULL OR up < down THEN 2 ELSE 0 END AS label,
    CASE WHEN up IS NULL AND down IS NULL THEN 0 WHEN down IS NULL OR up < down THEN {H} - up ELSE down - {H} END AS time_label
    FROM fit JOIN lab USING (issue_id, test_date))"""
KT = "issue_id, test_date"


def samples(spark, d):
    return tr.trend_samples(panel(spark, d), CL, T, H)


@query(f"{FIT} SELECT {KT}, slope, intercept FROM samples", "slope intercept")
def h01_least_squares(spark, d):
    return tr.fits(panel(spark, d), CL, T, H).select("issue_id", "test_date", "slope", "intercept")


@query(f"{FIT} SELECT {KT}, slope_normalised FROM samples", "slope_normalised")
def h02_normalised_slope(spark, d):
    return tr.normalised_slope(tr.fits(panel(spark, d), CL, T, H)).select("issue_id", "test_date", "slope_normalised")


@query(f"{FIT} SELECT {KT}, k::INT AS k, y, lb, ub FROM days", "lb ub")
def h03_corridor(spark, d):
    rows = tr.corridor(tr.fits(panel(spark, d), CL, T, H), T)
    return rows.select("issue_id", "test_date", F.explode("days").alias("s")).select("issue_id", "test_date", "s.*")


@query(f"{FIT} SELECT {KT}, ci_width FROM samples", "ci_width")
def h04_corridor_width(spark, d):
    return tr.corridor(tr.fits(panel(spark, d), CL, T, H), T).select("issue_id", "test_date", "ci_width")


@query(f"{FIT} SELECT {KT}, coverage FROM samples", "coverage")
def h05_coverage(spark, d):
    return tr.coverage(tr.corridor(tr.fits(panel(spark, d), CL, T, H), T)).select("issue_id", "test_date", "coverage")


@query(f"{FIT} SELECT {KT}, label FROM samples")
def h06_first_crossing_class(spark, d):
    return tr.first_crossing(tr.corridor(tr.fits(panel(spark, d), CL, T, H), T)).select("issue_id", "test_date", "label")


@query(f"{FIT} SELECT {KT}, time_label FROM samples")
def h07_crossing_time(spark, d):
    return tr.first_crossing(tr.corridor(tr.fits(panel(spark, d), CL, T, H), T)).select("issue_id", "test_date", "time_label")


@query(f"{FIT} SELECT {KT}, list_transform(deviations, lambda q: round(q, 6) + 0.0) AS deviations FROM samples")
def h08_deviation_vector(spark, d):
    return samples(spark, d).select("issue_id", "test_date", _rounded("deviations"))


@query(f"{FIT} SELECT {KT}, residual_label FROM samples", "residual_label")
def h09_max_deviation(spark, d):
    return samples(spark, d).select("issue_id", "test_date", "residual_label")


@query(f"{FIT} SELECT {KT}, margin FROM samples", "margin")
def h10_difficulty_margin(spark, d):
    return samples(spark, d).select("issue_id", "test_date", "margin")


LABEL_ROW = ("slope_normalised", "ci_width", "coverage", "label", "time_label", "residual_label", "margin")


@query(f"{FIT} SELECT {KT}, {', '.join(LABEL_ROW)} FROM samples", "slope_normalised ci_width coverage residual_label margin")
def h11_trend_label_row(spark, d):
    return samples(spark, d).select("issue_id", "test_date", *LABEL_ROW)


WT = f"""{P}, a AS (SELECT issue_id, date AS test_date, list(cl_adj_loc) {w(105)} AS train, list(cl_adj_loc) OVER ({O} ROWS BETWEEN 1 FOLLOWING AND 25 FOLLOWING) AS test FROM panel), b AS (SELECT * FROM a WHERE len(train) = 105 AND len(test) = 25),
  pts AS (SELECT issue_id, test_date, 5 AS step, i AS x, train[i * 5 + 1] AS y FROM b, range(21) t(i) UNION ALL SELECT issue_id, test_date, 21, i, train[i * 21 + 1] FROM b, range(5) t(i)),
  fits AS (SELECT issue_id, test_date, step, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, sqrt(greatest((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / count(*), 0)) AS sigma FROM pts GROUP BY 1, 2, 3),
  cov AS (SELECT issue_id, test_date, avg(CASE WHEN abs(test[k * 5 + 1] - (intercept + slope * (21 + k))) <= 1.96 * sigma THEN 1 ELSE 0 END) AS coverage FROM b JOIN fits USING (issue_id, test_date), range(5) t(k) WHERE step = 5 GROUP BY 1, 2),
  sl AS (SELECT issue_id, test_date, max(slope) FILTER (step = 5) AS s5, max(slope) FILTER (step = 21) AS s21 FROM fits GROUP BY 1, 2),
  mm AS (SELECT *, (s5 + s21 + s5) / 3 AS m FROM sl),
  cvs AS (SELECT issue_id, test_date, CASE WHEN m <> 0 THEN sqrt((2 * (s5 - m) * (s5 - m) + (s21 - m) * (s21 - m)) / 3) / m END AS slope_cv FROM mm)"""


@query(f"{WT} SELECT issue_id, test_date, coverage, CASE WHEN abs(slope_cv) < 50 THEN slope_cv END AS slope_cv FROM cov JOIN cvs USING (issue_id, test_date)", "coverage slope_cv", 4)
def h12_coverage_and_instability(spark, d):
    rows = tr.coverage_and_instability(wn.train_test_windows(panel(spark, d), CL, 105, 25), 5)
    return rows.select("issue_id", "test_date", "coverage", F.when(F.abs("slope_cv") < 50, F.col("slope_cv")).alias("slope_cv"))


@query(
    f"{WT} SELECT issue_id, CASE WHEN test_date <= DATE '1998-12-31' THEN 'train' ELSE 'val' END AS split, count(*) AS n, avg(CASE WHEN coverage = 1 THEN 1 ELSE 0 END) AS label_share FROM cov JOIN cvs USING (issue_id, test_date) GROUP BY 1, 2",
    "label_share",
)
def h13_labelled_dataset(spark, d):
    return tr.labelled_dataset(panel(spark, d), CL, 105, 25, 5, "1998-12-31").drop("mean_slope_cv")


@query(f"{FIT}, {UNIVERSE_SQL} SELECT sector, label, count(*) AS n, avg(coverage) AS mean_coverage FROM samples JOIN universe USING (issue_id) GROUP BY 1, 2", "mean_coverage")
def flagship_labels_by_sector(spark, d):
    """Class counts and mean coverage of the trend labels by sector."""
    rows = samples(spark, d).select("issue_id", "label", "coverage").join(universe(spark, d), "issue_id")
    return rows.groupBy("sector", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("coverage").alias("mean_coverage"))
