"""Queries N01-N13 over price paths and P01-P22 over predictions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pricepanel.operators import error_tables as et
from pricepanel.operators import paths as pt
from pricepanel.operators import windows as wn
from pricepanel.operators.joins import realised_future
from pricepanel.operators.panel import UNIVERSE_SQL, panel, universe
from pricepanel.plans.calendar_queries import DAYS, HOR, LOOK, ORIGINS, origins
from pricepanel.plans.feature_queries import O
from pricepanel.plans.metric_queries import MEMBERS, PRED, members, predictions
from pricepanel.plans.registry import query
from pricepanel.plans.trend_queries import RATIOS, T

#: Paths: the realised future, two made by the returns of rows 7 and 14 before, and the mean-reverting baseline.
KAPPA, MU, SIGMA = 0.1, 0.5, 0.05
PHI = math.exp(-KAPPA)
S = SIGMA * math.sqrt((1 - PHI * PHI) / (2 * KAPPA))


def _u(seed: int) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', issue_id, origin_date::VARCHAR, step::VARCHAR)), 1, 8))::BIGINT / 4294967296.0)"


HIST = f"{ORIGINS}, hs AS (SELECT o.issue_id, origin_date, origin_pos, min(cl_adj_loc) AS lo, max(cl_adj_loc) AS hi, max(cl_adj_loc) FILTER (p.pos = origin_pos) AS price FROM origins o JOIN pos p ON p.issue_id = o.issue_id AND p.pos BETWEEN origin_pos - {LOOK - 1} AND origin_pos GROUP BY 1, 2, 3)"
BASE = f"""vz AS (SELECT issue_id, origin_date, lo, greatest(hi - lo, 1e-8) AS sp, price, k::INT AS step FROM hs, range({HOR + 1}) t(k)),
  vn AS (SELECT *, CASE WHEN step = 0 THEN 0 ELSE pow({PHI}, -step) * sqrt(-2 * ln(greatest({_u(5)}, 1e-12))) * cos(2 * 3.141592653589793 * {_u(6)}) END AS z FROM vz),
  base AS (SELECT issue_id, origin_date, step, lo + ({MU} + pow({PHI}, step) * ((price - lo) / sp - {MU} + {S} * sum(z) OVER (PARTITION BY issue_id, origin_date ORDER BY step))) * sp AS price FROM vn)"""
PATHS = f"""{HIST}, {BASE}, paths AS (SELECT o.issue_id, origin_date, CASE WHEN i = 0 THEN 'original' ELSE 'donor' END AS source, i::INT AS iteration, (p.pos - origin_pos + 7 * i)::INT AS step, p.cl_adj_loc AS price
  FROM origins o CROSS JOIN range(3) t(i) JOIN pos p ON p.issue_id = o.issue_id AND p.pos BETWEEN origin_pos - 7 * i AND origin_pos - 7 * i + {HOR}
  UNION ALL SELECT issue_id, origin_date, 'baseline', 0, step, price FROM base)"""
PK = "issue_id, origin_date, source, iteration"
PW = f"PARTITION BY {PK} ORDER BY step"


def origin_prices(spark, d):
    """One row per origin: ``x``, its prices from the first row of the look-back to the horizon's last."""
    from pricepanel.operators.calendar import positions

    rows = positions(panel(spark, d)).select("issue_id", "pos", F.col("cl_adj_loc").alias("price"))
    starts = origins(spark, d)
    wanted = starts.select("issue_id", "origin_date", F.explode(F.sequence(F.col("origin_pos") - (LOOK - 1), F.col("origin_pos") + HOR)).alias("pos"))
    prices = F.transform(F.sort_array(F.collect_list(F.struct("pos", "price"))), lambda s: s["price"])
    return wanted.join(rows, ["issue_id", "pos"]).groupBy("issue_id", "origin_date").agg(prices.alias("x"))


def histories(spark, d):
    return _histories(origin_prices(spark, d))


def _histories(found):
    back = F.slice("x", 1, LOOK)
    return found.select("issue_id", "origin_date", F.array_min(back).alias("lo"), F.array_max(back).alias("hi"), F.element_at("x", LOOK).alias("price"))


def baseline(spark, d):
    return pt.mean_reverting(histories(spark, d), HOR, 5, KAPPA, MU, SIGMA)


def price_paths(spark, d):
    found = origin_prices(spark, d)
    shifted = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(i.alias("iteration"), F.slice("x", LOOK - 7 * i, F.lit(HOR + 1)).alias("prices")))
    source = F.when(F.col("iteration") == 0, "original").otherwise("donor").alias("source")
    drawn = found.select("issue_id", "origin_date", F.inline(shifted)).select("issue_id", "origin_date", source, "iteration", F.posexplode("prices").alias("step", "price"))
    made = pt.mean_reverting(_histories(found), HOR, 5, KAPPA, MU, SIGMA)
    return drawn.unionByName(made.withColumns({"source": F.lit("baseline"), "iteration": F.lit(0)}))


@query(f"{PATHS}, v AS (SELECT {PK}, max(price) / min(price) < 1.25 AS ok FROM paths GROUP BY {PK}) SELECT issue_id, origin_date, count(*) AS paths, count(DISTINCT iteration) AS iterations, sum(ok::INT)::BIGINT AS valid_paths FROM v GROUP BY 1, 2")
def n01_path_inventory(spark, d):
    one = price_paths(spark, d).groupBy(*pt.KEYS).agg((F.max("price") / F.min("price") < 1.25).alias("is_valid"))
    return pt.inventory(one)


@query(f"{HIST}, {BASE} SELECT issue_id, origin_date, step, price FROM base", "price", 5)
def n02_mean_reverting_baseline(spark, d):
    return baseline(spark, d)


CHANGES = "mean std mean_abs rms min max share_up share_down q05 q25 median q75 q95"


@query(
    f"""{PATHS}, dd AS (SELECT source, price - lag(price) OVER ({PW}) AS d FROM paths) SELECT source, count(d) AS count, avg(d) AS mean, stddev_pop(d) AS std, avg(abs(d)) AS mean_abs, sqrt(avg(d * d)) AS rms, min(d) AS min, max(d) AS max, avg((d > 0)::INT) AS share_up, avg((d < 0)::INT) AS share_down,
    {', '.join(f'quantile_cont(d, {q}) AS {n}' for q, n in ((0.05, 'q05'), (0.25, 'q25'), (0.5, 'median'), (0.75, 'q75'), (0.95, 'q95')))} FROM dd WHERE d IS NOT NULL GROUP BY 1""",
    CHANGES,
    5,
)
def n03_change_statistics(spark, d):
    return pt.change_statistics(price_paths(spark, d), ["source"], pt.KEYS)


RETS = f"{PATHS}, rr AS (SELECT {PK}, step, price, price / lag(price) OVER ({PW}) - 1 AS ret, 1 - price / max(price) OVER ({PW}) AS dd FROM paths), rm AS (SELECT {PK}, count(ret) AS returns, avg(ret) AS mean, stddev_pop(ret) AS std, var_pop(ret) AS variance, max(dd) AS max_drawdown FROM rr GROUP BY {PK})"


def _path_metrics(spark, d):
    return pt.return_metrics(price_paths(spark, d), pt.KEYS)


@query(
    f"""{RETS}, lg AS (SELECT source, max_drawdown < 0.15 AS ok, unnest(['std', 'max_drawdown']) AS metric, unnest([std, max_drawdown]) AS value FROM rm)
    SELECT source, metric, count(*) AS paths, count(*) FILTER (ok) AS valid, avg(value) FILTER (ok) AS mean, stddev_pop(value) FILTER (ok) AS std, quantile_cont(value, 0.05) FILTER (ok) AS q05, quantile_cont(value, 0.5) FILTER (ok) AS median, quantile_cont(value, 0.95) FILTER (ok) AS q95 FROM lg GROUP BY 1, 2""",
    "mean std q05 median q95",
)
def n04_metric_summary(spark, d):
    rows = _path_metrics(spark, d).withColumn("is_valid", F.col("max_drawdown") < 0.15)
    return pt.metric_summary(rows, ["source"], ["std", "max_drawdown"])


@query(
    f"""{PATHS}, e AS (SELECT p.issue_id, p.origin_date, source, avg(list_min(list_transform({RATIOS}, lambda q: abs(p.price - (lo + q * (hi - lo))) / greatest(hi - lo, 1e-8)))) AS m FROM paths p JOIN hs USING (issue_id, origin_date) WHERE step > 0 AND source <> 'donor' GROUP BY 1, 2, 3),
    w AS (SELECT issue_id, origin_date, max(m) FILTER (source = 'original') AS original, max(m) FILTER (source = 'baseline') AS baseline FROM e GROUP BY 1, 2) SELECT issue_id, origin_date, original, baseline, baseline / nullif(original, 0) AS ratio FROM w""",
    "original baseline ratio",
    4,
)
def n05_fixed_level_ratio(spark, d):
    hist, keys = histories(spark, d), ["issue_id", "origin_date"]
    real = wn.fixed_level_distance(hist, realised_future(origins(spark, d), panel(spark, d), HOR), keys).withColumnRenamed("mean_distance", "original")
    made = wn.fixed_level_distance(hist, baseline(spark, d), keys).withColumnRenamed("mean_distance", "baseline")
    return real.join(made, keys).withColumn("ratio", F.try_divide("baseline", "original"))


@query(f"{RETS} SELECT {PK}, step, ret FROM rr WHERE ret IS NOT NULL", "ret")
def n06_daily_returns(spark, d):
    return pt.returns(price_paths(spark, d), pt.KEYS).select(*pt.KEYS, "step", "ret")


@query(f"{RETS} SELECT * FROM rm", "mean std variance max_drawdown")
def n07_path_return_metrics(spark, d):
    return _path_metrics(spark, d).drop("sum_ret", "sum_sq")


@query(f"{RETS}, pl AS (SELECT source, count(ret) AS returns, avg(ret) AS mean, stddev_pop(ret) AS std FROM rr GROUP BY 1), dr AS (SELECT source, count(*) AS paths, avg(max_drawdown) AS mean_drawdown FROM rm GROUP BY 1) SELECT * FROM pl JOIN dr USING (source)", "mean std mean_drawdown")
def n08_source_returns(spark, d):
    return pt.pooled(_path_metrics(spark, d), ["source"])


@query(f"{RETS}, pl AS (SELECT issue_id, source, count(ret) AS returns, avg(ret) AS mean, stddev_pop(ret) AS std FROM rr WHERE NOT (source = 'donor' AND iteration = 2) GROUP BY 1, 2), dr AS (SELECT issue_id, source, count(*) AS paths, avg(max_drawdown) AS mean_drawdown FROM rm WHERE NOT (source = 'donor' AND iteration = 2) GROUP BY 1, 2) SELECT * FROM pl JOIN dr USING (issue_id, source)", "mean std mean_drawdown")
def n09_one_issue_across_dates(spark, d):
    from pricepanel.operators.sampling import first_per_group

    once = first_per_group(_path_metrics(spark, d), ["issue_id", "origin_date", "source"], ["iteration"])
    return pt.pooled(once, ["issue_id", "source"])


SOURCES = ["original", "donor", "baseline"]
WIDE = [f"{s}_{m}" for s in SOURCES for m in ("mean", "std", "max_drawdown", "variance")]


@query(f"{RETS} SELECT issue_id, count(DISTINCT origin_date) AS origins, count(*) AS paths, {', '.join(f'avg({m}) FILTER (source = {chr(39)}{s}{chr(39)}) AS {s}_{m}' for s in SOURCES for m in ('mean', 'std', 'max_drawdown', 'variance'))} FROM rm GROUP BY 1", " ".join(WIDE))
def n10_across_issues(spark, d):
    return pt.across_issues(_path_metrics(spark, d), SOURCES)


@query(f"{RETS}, q AS (SELECT source, std FROM rm), e AS (SELECT min(std) AS lo, max(std) AS hi FROM q), b AS (SELECT source, least(greatest(floor((std - lo) / ((hi - lo) / 40)), 0), 39)::INT AS bin, (hi - lo) / 40 AS w FROM q, e), c AS (SELECT source, bin, count(*) AS n, max(w) AS w FROM b GROUP BY 1, 2) SELECT source, bin, n, n / (sum(n) OVER (PARTITION BY source) * w) AS density FROM c", "density", 3)
def n11_shared_histogram(spark, d):
    return pt.shared_histogram(_path_metrics(spark, d), "std")


TAIL = "CASE WHEN z IS NULL THEN 1 WHEN z >= 0 THEN tail ELSE 1 - tail END"
TEST = "mean_a mean_b median_a median_b statistic z p_value"


@query(
    f"""{RETS}, w AS (SELECT issue_id, avg(std) FILTER (source = 'original') AS o, avg(std) FILTER (source = 'donor') AS t, avg(std) FILTER (source = 'baseline') AS v FROM rm GROUP BY 1), x AS (SELECT issue_id, abs(t - o) AS a, abs(v - o) AS b, round(abs(v - o) - abs(t - o), 12) AS d FROM w),
    k AS (SELECT count(*) AS issues, avg(a) AS mean_a, avg(b) AS mean_b, quantile_cont(a, 0.5) AS median_a, quantile_cont(b, 0.5) AS median_b FROM x WHERE a IS NOT NULL AND b IS NOT NULL), sz AS (SELECT abs(d) AS s, count(*) AS c, count(*) FILTER (d > 0) AS up FROM x WHERE d <> 0 GROUP BY 1),
    rk AS (SELECT *, sum(c) OVER (ORDER BY s) - (c - 1) / 2 AS r FROM sz), sm AS (SELECT sum(c)::BIGINT AS n, sum(r * up) AS statistic, sum(c * c * c - c) AS ties FROM rk),
    f AS (SELECT *, (statistic - n * (n + 1) / 4) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 0) AS z FROM k, sm), g AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM f),
    h AS (SELECT *, exp(-z * z / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS tail FROM g),
    dist(i, k, p) AS (SELECT 0::BIGINT, 0::BIGINT, 1.0::DOUBLE UNION ALL SELECT i, k, sum(p) FROM (SELECT d.i + 1 AS i, d.k + u.u * (d.i + 1) AS k, d.p / 2 AS p FROM dist d, (SELECT unnest([0, 1]) AS u) u, sm WHERE d.i < sm.n AND sm.n <= {pt.EXACT}) GROUP BY i, k),
    ev AS (SELECT sum(p) FILTER (i = n AND k >= statistic) AS exact FROM dist, sm),
    j AS (SELECT *, CASE WHEN z IS NOT NULL AND n <= {pt.EXACT} AND n = issues AND ties = 0 THEN exact ELSE {TAIL} END AS p_value FROM h, ev)
    SELECT issues, mean_a, mean_b, median_a, median_b, n, statistic, z, p_value, p_value < 0.05 AS better FROM j""".replace("WITH ", "WITH RECURSIVE ", 1),
    TEST,
)
def n12_signed_rank_test(spark, d):
    wide = pt.across_issues(_path_metrics(spark, d), SOURCES)
    errors = wide.select("issue_id", F.abs(F.col("donor_std") - F.col("original_std")).alias("a"), F.abs(F.col("baseline_std") - F.col("original_std")).alias("b"))
    return pt.signed_rank_test(errors, "a", "b", []).withColumn("better", F.col("p_value") < 0.05)


@query(f"{PATHS} SELECT issue_id, origin_date, step, quantile_cont(price, 0.05) AS q05, quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.95) AS q95 FROM paths GROUP BY 1, 2, 3", "q05 median q95", 7)
def n13_quantile_band(spark, d):
    return pt.quantile_band(price_paths(spark, d), ["issue_id", "origin_date"])


def _bin_sql(value: str, lo: float, hi: float, bins: int) -> str:
    return f"(CASE WHEN {value} >= {lo} AND {value} <= {hi} THEN least(greatest(floor(({value} - ({lo})) / (({hi} - ({lo})) / {bins})), 0), {bins - 1})::INT END)"


def _rate_sql(value: str, lo: float, hi: float, bins: int) -> str:
    return f"""{PRED}, bb AS (SELECT {_bin_sql(value, lo, hi, bins)} AS bin, (label <> y_hat)::INT AS e FROM preds), cc AS (SELECT bin, sum(e)::BIGINT AS errors, count(*) AS total, sum(e) / count(*) AS ratio FROM bb WHERE bin IS NOT NULL GROUP BY 1)
    SELECT b::INT AS bin, coalesce(errors, 0) AS errors, coalesce(total, 0) AS total, coalesce(ratio, 0) AS ratio FROM range({bins}) t(b) LEFT JOIN cc ON cc.bin = b"""


@query(_rate_sql("slope_normalised", -0.06, 0.06, 30), "ratio")
def p01_error_rate_by_slope(spark, d):
    return et.error_rate_by_bin(predictions(spark, d), "slope_normalised", -0.06, 0.06, 30)


@query(_rate_sql("ci_width", 0.0, 1.0, 30), "ratio")
def p02_error_rate_by_width(spark, d):
    return et.error_rate_by_bin(predictions(spark, d), "ci_width", 0.0, 1.0, 30)


SCALED = "((lo + hi) / 2 - 100) / 20"


def _with_price(spark, d):
    return predictions(spark, d).withColumn("price", ((F.col("lo") + F.col("hi")) / 2 - 100) / 20)


@query(_rate_sql(f"({SCALED})", -2.0, 2.0, 25), "ratio")
def p03_error_rate_by_price(spark, d):
    return et.error_rate_by_bin(_with_price(spark, d), "price", -2.0, 2.0, 25)


def _by(key: str) -> str:
    return f"{PRED}, {UNIVERSE_SQL} SELECT {key}, sum((label <> y_hat)::INT)::BIGINT AS errors, count(*) AS total, sum((label <> y_hat)::INT) / count(*) AS ratio FROM preds"


@query(f"{_by('issue_id')} GROUP BY 1", "ratio")
def p04_errors_by_issue(spark, d):
    return et.error_rate(predictions(spark, d), "issue_id")


@query(f"{_by('sector')} JOIN universe USING (issue_id) GROUP BY 1", "ratio")
def p05_error_rate_by_sector(spark, d):
    return et.error_rate(predictions(spark, d).join(universe(spark, d), "issue_id"), "sector")


@query(f"{_by('year(test_date) AS y')} GROUP BY 1", "ratio")
def p06_error_rate_by_year(spark, d):
    return et.error_rate(predictions(spark, d), F.year("test_date").alias("y"))


@query(f"{PRED}, b AS (SELECT {_bin_sql(f'({SCALED})', -2.0, 2.0, 50)} AS bin, unnest(['label', 'prediction']) AS kind, unnest([label, y_hat]) AS class FROM preds) SELECT bin, kind, class, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY 1, 2, 3")
def p07_label_counts_by_price(spark, d):
    return et.label_counts_by_bin(_with_price(spark, d), "price", -2.0, 2.0, 50)



@query(f"{MEMBERS}, q AS (SELECT m.p2, ((s.lo + s.hi) / 2 - 100) / 20 AS price FROM members m JOIN samples s USING (issue_id, test_date)), b AS (SELECT {_bin_sql('p2', 0.0, 1.0, 50)} AS x_bin, {_bin_sql('price', -2.0, 2.0, 50)} AS y_bin FROM q) SELECT x_bin, y_bin, count(*) AS n FROM b WHERE x_bin IS NOT NULL AND y_bin IS NOT NULL GROUP BY 1, 2")
def p08_probability_price_histogram(spark, d):
    rows = members(spark, d).withColumn("price", ((F.col("lo") + F.col("hi")) / 2 - 100) / 20)
    return et.histogram_2d(rows, ("p2", 0.0, 1.0), ("price", -2.0, 2.0), 50)


@query(f"{PRED} SELECT test_date, count(*) FILTER (y_hat = 0) AS class_0, count(*) FILTER (y_hat = 1) AS class_1, count(*) FILTER (y_hat = 2) AS class_2 FROM preds GROUP BY 1")
def p09_predictions_over_time(spark, d):
    return et.class_counts_over_time(predictions(spark, d))


@query(f"{PRED} SELECT test_date, count(*) AS n FROM preds GROUP BY 1")
def p10_samples_over_time(spark, d):
    return et.samples_over_time(predictions(spark, d))


@query(f"{PRED}, c AS (SELECT len(list_filter(deviations, lambda q: q <> 0)) AS k FROM preds), b AS (SELECT {_bin_sql('k', 0.0, 5.0, 5)} AS bin, count(*) AS n FROM c GROUP BY 1) SELECT bin, n, 100 * n / sum(n) OVER () AS percent, (SELECT quantile_cont(k, 0.95) FROM c) AS q95 FROM b", "percent q95")
def p11_deviation_counts(spark, d):
    return et.deviation_counts(predictions(spark, d), 5)


DEVS = f"{PRED}, dv2 AS (SELECT unnest(deviations) AS v, generate_subscripts(deviations, 1) - 1 AS day FROM preds)"


@query(f"{DEVS}, b AS (SELECT {_bin_sql('v', -1.0, 1.0, 50)} AS bin, count(*) AS n FROM dv2 GROUP BY 1) SELECT bin, n, 100 * n / (SELECT count(*) FROM dv2) AS percent, (SELECT quantile_cont(v, 0.025) FROM dv2) AS q025, (SELECT quantile_cont(v, 0.975) FROM dv2) AS q975 FROM b WHERE bin IS NOT NULL", "percent q025 q975")
def p12_deviation_histogram(spark, d):
    return et.deviation_histogram(predictions(spark, d))


@query(f"{DEVS}, b AS (SELECT day::INT AS day, {_bin_sql('v', -1.0, 1.0, 21)} AS bin, count(*) AS n FROM dv2 GROUP BY 1, 2) SELECT day, bin, n, 100 * n / sum(n) OVER (PARTITION BY day) AS percent FROM b WHERE bin IS NOT NULL", "percent")
def p13_deviation_heat(spark, d):
    return et.deviation_heat(predictions(spark, d))


ACF = f"""{PRED}, x0 AS (SELECT issue_id, (label = y_hat)::INT AS x, row_number() OVER (PARTITION BY issue_id ORDER BY test_date) AS rn, avg((label = y_hat)::INT) OVER (PARTITION BY issue_id) AS m, count(*) OVER (PARTITION BY issue_id) AS n FROM preds), x1 AS (SELECT issue_id, rn, x - m AS c FROM x0 WHERE n >= 100),
  sl AS (SELECT a.issue_id, (b.rn - a.rn)::INT AS lag, sum(a.c * b.c) AS s FROM x1 a JOIN x1 b ON a.issue_id = b.issue_id AND b.rn BETWEEN a.rn AND a.rn + 20 GROUP BY 1, 2), ac AS (SELECT lag, s / nullif(max(s) FILTER (lag = 0) OVER (PARTITION BY issue_id), 0) AS acf FROM sl), acf AS (SELECT lag, avg(acf) AS mean_acf, count(acf) AS issues FROM ac GROUP BY 1)"""


@query(f"{ACF} SELECT * FROM acf", "mean_acf")
def p14_correctness_autocorrelation(spark, d):
    return et.autocorrelation(predictions(spark, d), 20, 100)


@query(
    f"""{ACF}, t AS (SELECT count(*) AS n, avg((label = y_hat)::INT) AS accuracy FROM preds), i AS (SELECT 1 + 2 * sum(mean_acf) AS inflation FROM acf WHERE lag BETWEEN 1 AND 20), e AS (SELECT n, accuracy, inflation, n / inflation AS n_eff, floor(n / inflation)::BIGINT AS m FROM t, i),
    pm AS (SELECT k, exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + k * ln(accuracy) + (m - k) * ln(1 - accuracy)) AS p FROM e, range(0, (SELECT m + 1 FROM e)) r(k)), cd AS (SELECT k, sum(p) OVER (ORDER BY k) AS c FROM pm)
    SELECT n, accuracy, inflation, n_eff, (SELECT min(k) FROM cd WHERE c >= 0.025) / n_eff AS lo, (SELECT min(k) FROM cd WHERE c >= 0.975) / n_eff AS hi FROM e""",
    "accuracy inflation n_eff lo hi",
    4,
)
def p15_effective_sample_size(spark, d):
    rows = predictions(spark, d)
    return et.effective_size(rows, et.autocorrelation(rows, 20, 100), 20)


@query(f"{PRED}, r AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY test_date) - 1 AS rn FROM preds) SELECT stride::INT AS stride, count(*) AS n, avg((label = y_hat)::INT) AS accuracy FROM r, (SELECT unnest([60, 90, 180, 378]) AS stride) WHERE rn % stride = 0 GROUP BY 1", "accuracy")
def p16_sparse_accuracy(spark, d):
    return et.sparse_accuracy(predictions(spark, d))


@query(f"{PRED}, r AS (SELECT *, (row_number() OVER (PARTITION BY issue_id ORDER BY test_date) - 1) // 21 AS block FROM preds), b AS (SELECT issue_id, block, avg((label = y_hat)::INT) AS a FROM r GROUP BY 1, 2) SELECT issue_id, count(*) AS blocks, avg(a) AS mean, stddev_pop(a) AS std, min(a) AS least, max(a) AS most FROM b GROUP BY 1", "mean std least most")
def p16_block_accuracy(spark, d):
    return et.block_accuracy(predictions(spark, d))


PR = f"""{PRED}, e0 AS (SELECT *, exp(z0 - greatest(z0, z1, z2)) AS ea, exp(z1 - greatest(z0, z1, z2)) AS eb, exp(z2 - greatest(z0, z1, z2)) AS ec FROM preds), e1 AS (SELECT *, ea / (ea + eb + ec) AS p0, eb / (ea + eb + ec) AS p1, ec / (ea + eb + ec) AS p2 FROM e0),
  pe AS (SELECT *, least(greatest(-(CASE WHEN p0 > 0 THEN p0 * ln(p0) ELSE 0 END + CASE WHEN p1 > 0 THEN p1 * ln(p1) ELSE 0 END + CASE WHEN p2 > 0 THEN p2 * ln(p2) ELSE 0 END) / {math.log(3)}, 0), 1) AS ent FROM e1)"""


def _with_probabilities(spark, d):
    from pricepanel.operators.metrics import decisions

    return decisions(predictions(spark, d), ["z0", "z1", "z2"])


def _lv(x: str) -> str:
    return f"CASE WHEN {x} < 0.33 THEN 'Low' WHEN {x} < 0.67 THEN 'Med' ELSE 'High' END"


@query(f"{PR}, g AS (SELECT unnest(['Low', 'Med', 'High']) AS entropy), h AS (SELECT unnest(['Low', 'Med', 'High']) AS difficulty), c AS (SELECT {_lv('ent')} AS entropy, {_lv('margin')} AS difficulty, count(*) AS n, 100 * avg((label = y_hat)::INT) AS accuracy FROM pe GROUP BY 1, 2) SELECT entropy, difficulty, coalesce(n, 0) AS n, accuracy FROM g CROSS JOIN h LEFT JOIN c USING (entropy, difficulty)", "accuracy")
def p17_entropy_difficulty_grid(spark, d):
    return et.entropy_difficulty(_with_probabilities(spark, d), ["p0", "p1", "p2"], "margin")


@query(f"{PR} SELECT floor(margin * 10)::INT AS bin, avg(ent) AS entropy, count(*) AS n FROM pe WHERE margin >= 0 AND margin < 1 GROUP BY 1", "entropy")
def p18_entropy_curve(spark, d):
    return et.entropy_curve(_with_probabilities(spark, d), ["p0", "p1", "p2"], "margin")


@query(f"{PRED} SELECT issue_id, avg((label = y_hat)::INT) AS accuracy FROM preds GROUP BY 1", "accuracy")
def p19_accuracy_per_issue(spark, d):
    return predictions(spark, d).groupBy("issue_id").agg(F.avg(1 - et.wrong()).alias("accuracy"))


@query(
    f"""{MEMBERS}, b AS (SELECT issue_id, test_date, any_value(intercept + slope * {T} - half) AS lb, any_value(intercept + slope * {T} + half) AS ub, avg(r) FILTER (r <> 0) AS mean, stddev_pop(r) FILTER (r <> 0) AS std FROM (SELECT m.issue_id, m.test_date, m.r, s.intercept, s.slope, s.half FROM members m JOIN samples s USING (issue_id, test_date)) GROUP BY 1, 2)
    SELECT *, CASE WHEN mean >= 0 THEN ub ELSE lb END * (1 + (mean - std) / 100) AS band_lo, CASE WHEN mean >= 0 THEN ub ELSE lb END * (1 + (mean + std) / 100) AS band_hi FROM b""",
    "lb ub mean std band_lo band_hi",
    4,
)
def p20_residual_bands(spark, d):
    line = F.col("intercept") + F.col("slope") * T
    rows = members(spark, d).withColumns({"lb": line - F.col("half"), "ub": line + F.col("half")})
    return et.residual_bands(rows, ["issue_id", "test_date"], "r")


@query(f"{DAYS}, ix AS (SELECT issue_id, row_number() OVER (ORDER BY issue_id) - 1 AS issue_index FROM (SELECT DISTINCT issue_id FROM panel)) SELECT issue_index, trading_day, (cl_adj_loc - min(cl_adj_loc) OVER w) / CASE WHEN max(cl_adj_loc) OVER w = min(cl_adj_loc) OVER w THEN 1e-6 ELSE max(cl_adj_loc) OVER w - min(cl_adj_loc) OVER w END AS value, coalesce(trading_day - lag(trading_day) OVER ({O}) - 1 = 1, false) AS gap_before FROM t JOIN ix USING (issue_id) WINDOW w AS (PARTITION BY issue_id)", "value")
def p21_panel_raster(spark, d):
    return et.panel_raster(panel(spark, d), "cl_adj_loc")


@query(
    f"""{PRED}, v AS (SELECT issue_id, test_date, t_hat * 0.9 AS v, 5 - abs(t_hat * 0.9) AS position, intercept + slope * ({T} + 5 - abs(t_hat * 0.9)) AS line, half FROM preds)
    SELECT issue_id, test_date, position, CASE WHEN v >= 1 THEN line + half WHEN v <= -1 THEN line - half ELSE line - half + (v + 1) / 2 * 2 * half END AS level FROM v""",
    "position level",
    4,
)
def p22_touch_point(spark, d):
    rows = predictions(spark, d).withColumns({"v": F.col("t_hat") * 0.9, "train": F.lit(T)})
    return et.touch_point(rows, "v", 5).select("issue_id", "test_date", "position", "level")


