"""Queries J01-J17 over trend samples and K01-K18 over gate rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pricepanel.operators import gates as gt
from pricepanel.operators import metrics as mt
from pricepanel.operators import windows as wn
from pricepanel.operators.panel import table
from pricepanel.plans.feature_queries import K
from pricepanel.plans.registry import query
from pricepanel.plans.trend_queries import FEATS, FIT, KT, RANGES, ranges, samples

#: Predictions: the label of the sample before; logits from slope and width; ten members by shifted scores.
PRED = f"""{FIT}, pred AS (SELECT *, lag(label) OVER (PARTITION BY issue_id ORDER BY test_date) AS y_hat, lag(residual_label) OVER (PARTITION BY issue_id ORDER BY test_date) AS r_hat,
  lag(time_label) OVER (PARTITION BY issue_id ORDER BY test_date) AS t_hat, -20 * slope_normalised AS z0, 0.5 - ci_width AS z1, 20 * slope_normalised AS z2 FROM samples),
  preds AS (SELECT * FROM pred WHERE y_hat IS NOT NULL)"""


def predictions(spark, d):
    w = Window.partitionBy("issue_id").orderBy("test_date")
    rows = samples(spark, d).withColumns(
        {"y_hat": F.lag("label").over(w), "r_hat": F.lag("residual_label").over(w), "t_hat": F.lag("time_label").over(w),
         "z0": -20 * F.col("slope_normalised"), "z1": 0.5 - F.col("ci_width"), "z2": 20 * F.col("slope_normalised")}
    )
    return rows.where("y_hat is not null")


MEMBERS = f"""{PRED}, ms AS (SELECT {KT}, label, residual_label, time_label, k, z0 + 0.1 * (k - 4.5) AS a, z1 AS b, z2 - 0.1 * (k - 4.5) AS c, r_hat + 0.05 * k AS r, t_hat + 0.1 * k AS t FROM preds, range(10) g(k)),
  mp AS (SELECT *, exp(a - greatest(a, b, c)) AS ea, exp(b - greatest(a, b, c)) AS eb, exp(c - greatest(a, b, c)) AS ec FROM ms),
  members AS (SELECT *, ea / (ea + eb + ec) AS p0, eb / (ea + eb + ec) AS p1, ec / (ea + eb + ec) AS p2 FROM mp)"""


def members(spark, d):
    rows = predictions(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
    shift = 0.1 * (F.col("k") - 4.5)
    rows = rows.withColumns({"a": F.col("z0") + shift, "b": F.col("z1"), "c": F.col("z2") - shift, "r": F.col("r_hat") + 0.05 * F.col("k"), "t": F.col("t_hat") + 0.1 * F.col("k")})
    return mt.decisions(rows, ["a", "b", "c"])


@query("SELECT count(*) FILTER (toxic = 1 AND quality = 1) AS tp, count(*) FILTER (toxic <> 1 AND quality <> 1) AS tn, count(*) FILTER (toxic <> 1 AND quality = 1) AS fp, count(*) FILTER (toxic = 1 AND quality <> 1) AS fn, count(*) FILTER ((toxic = 1) = (quality = 1)) / count(*) AS accuracy, count(*) FILTER (toxic <> 1 AND quality = 1) / count(*) FILTER (toxic <> 1) AS fpr, count(*) FILTER (toxic = 1 AND quality <> 1) / count(*) FILTER (toxic = 1) AS fnr FROM labels", "accuracy fpr fnr")
def j01_binary_metrics(spark, d):
    return mt.binary(table(spark, d, "labels"), "toxic", "quality")


CONF = f"{PRED}, g AS (SELECT a::INT AS y_true, b::INT AS y_pred FROM range(3) t(a), range(3) u(b)), c AS (SELECT label AS y_true, y_hat AS y_pred, count(*) AS n FROM preds GROUP BY 1, 2), conf AS (SELECT y_true, y_pred, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (y_true, y_pred)), cp AS (SELECT *, 100 * n / sum(n) OVER (PARTITION BY y_true) AS percent FROM conf)"


@query(f"{CONF} SELECT * FROM cp", "percent")
def j02_confusion_matrix(spark, d):
    return mt.confusion(predictions(spark, d), "label", "y_hat", 3)


@query(f"{CONF} SELECT avg(percent) AS macro_recall FROM cp WHERE y_true = y_pred", "macro_recall")
def j02_macro_recall(spark, d):
    return mt.macro_recall(mt.confusion(predictions(spark, d), "label", "y_hat", 3))


@query(f"{CONF} SELECT y_true, y_pred, n / sum(n) OVER () AS share, percent / 100 AS row_rate FROM cp", "share row_rate", 3)
def j03_validation_confusion(spark, d):
    rows = mt.confusion(predictions(spark, d), "label", "y_hat", 3)
    return rows.select("y_true", "y_pred", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"), (F.col("percent") / 100).alias("row_rate"))


BIN = "CASE WHEN residual_label < -5 THEN 'far below' WHEN residual_label < 0 THEN 'below' WHEN residual_label = 0 THEN 'inside' WHEN residual_label <= 5 THEN 'above' ELSE 'far above' END"
BIN_NAMES = ["far below", "below", "inside", "above", "far above"]


def residual_bin(x):
    return F.when(x < -5, "far below").when(x < 0, "below").when(x == 0, "inside").when(x <= 5, "above").otherwise("far above")


@query(f"{PRED}, g AS (SELECT unnest({BIN_NAMES}) AS bin), b AS (SELECT {BIN} AS bin, avg(abs(residual_label - r_hat)) AS mae, count(*) AS n FROM preds GROUP BY 1) SELECT bin, mae, coalesce(n, 0) AS n, (SELECT avg((residual_label - r_hat) ** 2) FROM preds) AS mse FROM g LEFT JOIN b USING (bin)", "mae mse")
def j04_residual_errors(spark, d):
    return mt.residual_errors(predictions(spark, d), "residual_label", "r_hat", residual_bin, BIN_NAMES)


@query(f"{PRED} SELECT time_label AS label, count(*) AS n, avg(abs(time_label - t_hat)) AS mae, avg((time_label - t_hat) ** 2) AS mse FROM preds GROUP BY 1", "mae mse")
def j05_time_errors(spark, d):
    return mt.errors_by_label(predictions(spark, d), "time_label", "t_hat").drop("mean_pred", "std_pred")


@query(f"{PRED} SELECT time_label AS label, avg(t_hat) AS mean_pred, stddev_pop(t_hat) AS std_pred FROM preds GROUP BY 1", "mean_pred std_pred")
def j06_prediction_by_label(spark, d):
    return mt.errors_by_label(predictions(spark, d), "time_label", "t_hat").select("label", "mean_pred", "std_pred")


@query(
    f"""{PRED}, a AS (SELECT {KT}, label <> y_hat AS wrong, coalesce(label <> lag(label) OVER (PARTITION BY issue_id ORDER BY test_date), false) AS change FROM preds),
    b AS (SELECT *, sum(change::INT) OVER (PARTITION BY issue_id ORDER BY test_date ROWS UNBOUNDED PRECEDING) AS run FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY issue_id, run ORDER BY test_date) - 1 AS step, sum((NOT wrong)::INT) OVER (PARTITION BY issue_id, run ORDER BY test_date ROWS UNBOUNDED PRECEDING) AS ok FROM b),
    r AS (SELECT issue_id, run, count(*) FILTER (wrong AND ok = 0 AND step < 10) AS steps FROM c WHERE run > 0 GROUP BY 1, 2)
    SELECT sum(steps)::BIGINT AS lag_errors, avg(steps) AS mean_steps, count(*) AS changes, (SELECT count(*) FROM a WHERE wrong) AS errors, sum(steps) / (SELECT count(*) FROM a WHERE wrong) AS lag_share FROM r""",
    "mean_steps lag_share",
)
def j07_label_change_lag(spark, d):
    return mt.label_change_lag(predictions(spark, d), "issue_id", "test_date", "label", "y_hat", 10)


@query(
    f"""{PRED}, z AS (SELECT {KT}, (residual_label - r_hat) / (1 + 1e-8) AS z, lag((residual_label - r_hat) / (1 + 1e-8)) OVER (PARTITION BY issue_id ORDER BY test_date) AS back FROM preds), m AS (SELECT avg(z) AS m, stddev_pop(z) AS s FROM z)
    SELECT count(*) AS n, max(m) AS mean, max(s) AS std, avg((abs(z) <= 1)::INT) AS within_1, avg((abs(z) <= 2)::INT) AS within_2, avg((abs(z) <= 3)::INT) AS within_3, sum((z - m) * (back - m)) / (sum((z - m) ** 2) + 1e-8) AS lag1,
    avg(((z - m) / (s + 1e-8)) ** 3) AS skew, avg(((z - m) / (s + 1e-8)) ** 4) - 3 AS excess_kurtosis, 0.6827::DOUBLE AS target_1, 0.9545::DOUBLE AS target_2, 0.9973::DOUBLE AS target_3 FROM z, m""",
    "mean std within_1 within_2 within_3 lag1 skew excess_kurtosis",
)
def j08_residual_calibration(spark, d):
    rows = predictions(spark, d).withColumn("z", (F.col("residual_label") - F.col("r_hat")) / (1 + 1e-8))
    return mt.calibration(rows, "z", "issue_id", "test_date")


@query(
    f"""{PRED} SELECT 'drift' AS parameter, avg(abs(slope - 0.1 * (100 - intercept) / 10)) AS mae, corr(slope, 0.1 * (100 - intercept) / 10) AS corr, corr(slope, 0.1 * (100 - intercept) / 10) >= 0.5 AS recovered FROM preds
    UNION ALL SELECT 'diffusion', avg(abs(sigma - (0.5 + 2 / (1 + exp(-ci_width))))), corr(sigma, 0.5 + 2 / (1 + exp(-ci_width))), corr(sigma, 0.5 + 2 / (1 + exp(-ci_width))) >= 0.5 FROM preds""",
    "mae corr",
)
def j09_parameter_recovery(spark, d):
    rows = predictions(spark, d).withColumns({"drift": 0.1 * (100 - F.col("intercept")) / 10, "diffusion": 0.5 + 2 / (1 + F.exp(-F.col("ci_width")))})
    return mt.recovery(rows, {"drift": ("slope", "drift"), "diffusion": ("sigma", "diffusion")}, 0.5)


VOTE = f"{MEMBERS}, v AS (SELECT {KT}, avg(p0) AS p0, avg(p1) AS p1, avg(p2) AS p2 FROM members GROUP BY 1, 2), votes AS (SELECT *, CASE WHEN round(p0, 12) >= greatest(round(p1, 12), round(p2, 12)) THEN 0 WHEN round(p1, 12) >= round(p2, 12) THEN 1 ELSE 2 END AS vote FROM v)"


@query(f"{VOTE} SELECT *, ['Down', 'NoTouch', 'Up'][vote + 1] AS vote_name FROM votes", "p0 p1 p2")
def j10_class_vote(spark, d):
    return mt.class_vote(members(spark, d), ["issue_id", "test_date"], ["p0", "p1", "p2"])


@query(f"{MEMBERS} SELECT {KT}, avg(r) AS r_mean, stddev_samp(r) AS r_std FROM members GROUP BY 1, 2", "r_mean r_std")
def j11_ensemble_regression(spark, d):
    return mt.ensemble_regression(members(spark, d), ["issue_id", "test_date"], "r")


@query(
    f"""{MEMBERS}, y AS (SELECT k AS run, label AS y_true, CASE WHEN a >= greatest(b, c) THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS y_pred FROM members), g AS (SELECT r AS run, x::INT AS y_true, z::INT AS y_pred FROM range(10) q(r), range(3) t(x), range(3) u(z)),
    n AS (SELECT run, y_true, y_pred, count(*) AS n FROM y GROUP BY 1, 2, 3), f AS (SELECT run, y_true, y_pred, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (run, y_true, y_pred)), p AS (SELECT *, 100 * n / sum(n) OVER (PARTITION BY run, y_true) AS percent FROM f)
    SELECT y_true, y_pred, avg(percent) AS mean, stddev_pop(percent) AS std, count(*) AS runs FROM p GROUP BY 1, 2""",
    "mean std",
)
def j12_repeated_runs(spark, d):
    table_ = mt.confusion(members(spark, d).withColumnRenamed("k", "run"), "label", "argmax", 3, ("run",))
    return mt.repeated_runs(table_, ["y_true", "y_pred"], "percent")


@query(f"{PRED}, w AS (SELECT time_label, t_hat, (11 * (1 + least(greatest(time_label + 5, 0), 10)) / 66.0) AS w FROM preds) SELECT avg(w * (time_label - t_hat) ** 2) AS weighted_mse, avg((time_label - t_hat) ** 2) AS mse FROM w", "weighted_mse mse")
def j13_weighted_mse(spark, d):
    return mt.weighted_mse(predictions(spark, d), "time_label", "t_hat", [float(i + 1) for i in range(11)], 5)


@query(f"{PRED}, t AS (SELECT issue_id, intercept + slope * 20 AS x, test[1] AS nxt, slope AS mu, sigma, (sigma + 1e-6) ** 2 + 1e-6 AS v FROM preds) SELECT issue_id, avg(0.5 * (ln(v) + (nxt - x - mu) ** 2 / v)) AS nll, sqrt(avg((nxt - x - mu) ** 2)) AS rmse FROM t GROUP BY 1", "nll rmse", 4)
def j14_transition_nll(spark, d):
    rows = predictions(spark, d).select("issue_id", (F.col("intercept") + F.col("slope") * 20).alias("x"), F.col("test")[0].alias("nxt"), F.col("slope").alias("mu"), "sigma")
    return mt.transition_scores(rows, ("issue_id",))


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS l FROM embeddings), x AS (SELECT *, list_transform(l, lambda x: exp(x - list_max(l))) AS w FROM e)
    SELECT vec_id, (generate_subscripts(w, 1) - 1)::INT AS class, unnest(w) / list_sum(w) AS p, (list_position(l, list_max(l)) - 1)::INT AS argmax, (1 / (1 + exp(-l[1])) > 0.5)::INT AS positive FROM x""",
    "p",
)
def j15_softmax_decision(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("logits"))
    return mt.class_decisions(rows, "logits").select("vec_id", F.posexplode("p").alias("class", "p"), "argmax", "positive")


@query(
    f"""{VOTE}, e AS (SELECT {KT}, avg(r) AS r_mean, stddev_samp(r) AS r_std, avg(t) AS t_mean, stddev_samp(t) AS t_std FROM members GROUP BY 1, 2)
    SELECT v.issue_id, v.test_date, vote, r_mean, r_std, t_mean, t_std, s.label AS true_label, s.residual_label AS true_residual FROM votes v JOIN e USING (issue_id, test_date) JOIN samples s USING (issue_id, test_date)""",
    "r_mean r_std t_mean t_std true_residual",
)
def j16_multi_task_report(spark, d):
    keys = ["issue_id", "test_date"]
    rows = members(spark, d)
    one = rows.groupBy(*keys).agg(
        *(F.avg(c).alias(c) for c in ("p0", "p1", "p2")), *(f(c).alias(f"{c}_{n}") for c in "rt" for n, f in (("mean", F.avg), ("std", F.stddev_samp))),
        F.coalesce(F.first("label"), F.lit(-100)).alias("true_label"), F.coalesce(F.first("residual_label"), F.lit(-100.0)).alias("true_residual"),
    )
    from pricepanel.functions.expressions import first_argmax

    return one.select(*keys, first_argmax(*(F.round(c, 12) for c in ("p0", "p1", "p2"))).alias("vote"), "r_mean", "r_std", "t_mean", "t_std", "true_label", "true_residual")


@query(f"{FIT} SELECT CASE WHEN test_date <= DATE '1998-12-31' THEN 'train' ELSE 'val' END AS split, count(*) AS n, count(DISTINCT issue_id) AS ids FROM samples GROUP BY 1")
def j17_split_counts(spark, d):
    split = F.when(F.col("test_date") <= "1998-12-31", "train").otherwise("val")
    return samples(spark, d).groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("issue_id").alias("ids"))


def _gates_sql(name: str, tau: float) -> str:
    """Gate rows of the column-only scorer over window features, at temperature ``tau``."""
    return f"""{name}_z AS (SELECT *, ((last - lo) / greatest(hi - lo, 1e-8)) / {tau} AS za, distances[4] / {tau} AS zb FROM feats),
  {name}_e AS (SELECT *, exp(za - greatest(za, zb, -za)) AS ea, exp(zb - greatest(za, zb, -za)) AS eb, exp(-za - greatest(za, zb, -za)) AS ec FROM {name}_z),
  {name} AS (SELECT issue_id, date, year(date) AS y, nearest_level, distance, movement, last, ea / (ea + eb + ec) AS p_bounce, eb / (ea + eb + ec) AS p_break, ec / (ea + eb + ec) AS p_hover FROM {name}_e)"""


GATES = f"{RANGES}, {FEATS}, {_gates_sql('gates', 1.0)}"
GATES2 = f"{GATES}, {_gates_sql('cooler', 0.5)}"


def gates(spark, d, temperature: float = 1.0):
    rows = gt.gate_scores(wn.window_features(ranges(spark, d)), temperature)
    return rows.withColumn("y", F.year("date"))


H = "-(p_bounce * ln(p_bounce) + p_break * ln(p_break) + p_hover * ln(p_hover))"
KCOLS = [f"{a}_{e}" for e in gt.EXPERTS for a in ("mean", "var", "share")]


@query(
    f"""{GATES}, t AS (SELECT *, greatest(p_bounce, p_break, p_hover) AS top FROM gates), s AS (SELECT *, (p_bounce = top)::INT + (p_break = top)::INT + (p_hover = top)::INT AS k FROM t)
    SELECT y, count(*) AS n, {', '.join(f"avg(p_{e}) AS mean_{e}, var_pop(p_{e}) AS var_{e}, avg((p_{e} = top)::INT / k) AS share_{e}" for e in gt.EXPERTS)}, avg({H}) / ln(3.0) AS entropy, avg(top) AS mean_max FROM s GROUP BY 1""",
    " ".join(KCOLS) + " entropy mean_max",
)
def k01_gate_accumulator(spark, d):
    return gt.accumulated(gates(spark, d), ["y"])


def _top(t: str) -> str:
    return f"SELECT {K}, p_bounce, p_break, p_hover, CASE WHEN p_bounce >= greatest(p_break, p_hover) THEN 0 WHEN p_break >= p_hover THEN 1 ELSE 2 END AS state, round(greatest(p_bounce, p_break, p_hover) - (p_bounce + p_break + p_hover - greatest(p_bounce, p_break, p_hover) - least(p_bounce, p_break, p_hover)), 12) AS margin FROM {t}"


@query(
    f"""{GATES2}, a AS ({_top('gates')}), b AS ({_top('cooler')}), j AS (SELECT a.margin >= 0.05 AND b.margin >= 0.05 AS ok, a.state <> b.state AS sw, (abs(a.p_bounce - b.p_bounce) + abs(a.p_break - b.p_break) + abs(a.p_hover - b.p_hover)) / 3 AS ch FROM a JOIN b USING ({K}))
    SELECT count(*) AS n, avg((NOT ok)::INT) AS exclusion_rate, avg(sw::INT) FILTER (ok) AS switch_fraction, avg(ch) AS mean_change FROM j""",
    "exclusion_rate switch_fraction mean_change",
    5,
)
def k02_assignment_change(spark, d):
    return gt.assignment_change(gates(spark, d), gates(spark, d, 0.5), ["issue_id", "date"])


@query(f"{GATES} SELECT min(distance) AS lo_distance, max(distance) AS hi_distance, min(movement) AS lo_movement, max(movement) AS hi_movement FROM gates", "lo_distance hi_distance lo_movement hi_movement")
def k03_bin_edges(spark, d):
    return gt.edges(gates(spark, d), "distance", "movement")


@query(f"{RANGES}, e AS (SELECT min(last) AS lo, max(last) AS hi FROM z), b AS (SELECT least(greatest(floor((last - e.lo) / ((e.hi - e.lo) / 20)), 0), 19)::INT AS bin FROM z, e) SELECT bin, count(*) AS n FROM b GROUP BY 1")
def k04_bin_index(spark, d):
    return gt.binned(ranges(spark, d), "last").groupBy(F.col("last_bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _binned_sql(col: str, src: str, dst: str) -> str:
    return f"{dst} AS (SELECT {src}.*, least(greatest(floor(({col} - e.lo) / ((e.hi - e.lo) / 20)), 0), 19)::INT AS {col}_bin FROM {src}, (SELECT min({col}) AS lo, max({col}) AS hi FROM {src}) e)"


PCOLS = "p_bounce p_break p_hover"
GRID = "(n >= 30 AND stocks >= 5)"


@query(
    f"""{GATES}, {_binned_sql('distance', 'gates', 'db')}, lv AS (SELECT unnest([-1, nearest_level]) AS level, * EXCLUDE (nearest_level) FROM db), c AS (SELECT level, distance_bin, count(*) AS n, count(DISTINCT issue_id) AS stocks, avg(p_bounce) AS p_bounce, avg(p_break) AS p_break, avg(p_hover) AS p_hover FROM lv GROUP BY 1, 2),
    g AS (SELECT (a - 1)::INT AS level, b::INT AS distance_bin FROM range(8) t(a), range(20) u(b)), f AS (SELECT level, distance_bin, coalesce(n, 0) AS n, coalesce(stocks, 0) AS stocks, p_bounce, p_break, p_hover FROM g LEFT JOIN c USING (level, distance_bin))
    SELECT level, distance_bin, n, stocks, {GRID} AS supported, p_bounce, p_break, p_hover FROM f""",
    PCOLS,
)
def k05_distance_summary(spark, d):
    return gt.distance_summary(gates(spark, d))


REPS = 1000


def weights_sql(table: str) -> str:
    """``weights(replicate, issue_id, weight)``: how often each replicate draws each security of ``table``."""
    return f"""ids AS (SELECT issue_id, row_number() OVER (ORDER BY issue_id) - 1 AS n, count(*) OVER () AS c FROM (SELECT DISTINCT issue_id FROM {table})),
  draws AS (SELECT r::INT AS replicate, floor((('0x' || substr(md5(concat_ws('|', '7', r::VARCHAR, ids.n::VARCHAR)), 1, 8))::BIGINT) / 4294967296.0 * c)::BIGINT AS n FROM ids, range({REPS}) t(r)),
  weights AS (SELECT replicate, issue_id, count(*) AS weight FROM draws JOIN ids USING (n) GROUP BY 1, 2)"""


@query(
    f"""{GATES}, {weights_sql('gates')}, {_binned_sql('distance', 'gates', 'db')}, lv AS (SELECT unnest([-1, nearest_level]) AS level, * EXCLUDE (nearest_level) FROM db), s AS (SELECT level, distance_bin, issue_id, count(*) AS n, sum(p_bounce) AS p_bounce, sum(p_break) AS p_break, sum(p_hover) AS p_hover FROM lv GROUP BY 1, 2, 3),
    w AS (SELECT level, distance_bin, replicate, sum(p_bounce * weight) / sum(n * weight) AS p_bounce, sum(p_break * weight) / sum(n * weight) AS p_break, sum(p_hover * weight) / sum(n * weight) AS p_hover FROM s JOIN weights USING (issue_id) GROUP BY 1, 2, 3),
    b AS (SELECT level, distance_bin, count(*) AS replicates, {', '.join(f'quantile_cont({c}, 0.025) AS {c}_lo, quantile_cont({c}, 0.975) AS {c}_hi' for c in gt.P)} FROM w GROUP BY 1, 2), c AS (SELECT level, distance_bin, sum(n)::BIGINT AS n, count(*) AS stocks FROM s GROUP BY 1, 2),
    g AS (SELECT (a - 1)::INT AS level, b::INT AS distance_bin FROM range(8) t(a), range(20) u(b)), f AS (SELECT g.*, coalesce(n, 0) AS n, coalesce(stocks, 0) AS stocks, coalesce(replicates, 0) AS replicates, b.* EXCLUDE (level, distance_bin, replicates) FROM g LEFT JOIN c USING (level, distance_bin) LEFT JOIN b USING (level, distance_bin))
    SELECT level, distance_bin, n, stocks, {GRID} AS supported, replicates, {', '.join(f'CASE WHEN {GRID} THEN {c}_{e} END AS {c}_{e}' for c in gt.P for e in ('lo', 'hi'))} FROM f""",
    " ".join(f"{c}_{e}" for c in gt.P for e in ("lo", "hi")),
)
def k05_distance_bands(spark, d):
    return gt.distance_bands(gates(spark, d), REPS, 7)


@query(
    f"""{GATES}, {_binned_sql('distance', 'gates', 'db')}, {_binned_sql('movement', 'db', 'mb')}, c AS (SELECT distance_bin, movement_bin, count(*) AS n, count(DISTINCT issue_id) AS stocks, avg(p_bounce) AS p_bounce, avg(p_break) AS p_break, avg(p_hover) AS p_hover FROM mb GROUP BY 1, 2),
    g AS (SELECT a::INT AS distance_bin, b::INT AS movement_bin FROM range(20) t(a), range(20) u(b)), f AS (SELECT distance_bin, movement_bin, coalesce(n, 0) AS n, coalesce(stocks, 0) AS stocks, p_bounce, p_break, p_hover FROM g LEFT JOIN c USING (distance_bin, movement_bin))
    SELECT distance_bin, movement_bin, n, stocks, {GRID} AS supported, p_bounce, p_break, p_hover FROM f""",
    PCOLS,
)
def k06_movement_grid(spark, d):
    return gt.movement_summary(gates(spark, d))


@query(f"{GATES} SELECT y, avg(-(p_bounce * ln(p_bounce + 1e-8) + p_break * ln(p_break + 1e-8) + p_hover * ln(p_hover + 1e-8))) AS entropy FROM gates GROUP BY 1", "entropy")
def k09_categorical_entropy(spark, d):
    return gt.gate_entropy(gates(spark, d), ["y"])


TERMS = f"""{GATES}, h AS (SELECT y, count(*) AS n, {', '.join(f'avg({c}) AS m{i}, avg(-{c} * ln({c} + 1e-8)) AS h{i}, var_pop({c}) AS v{i}' for i, c in enumerate(gt.P))} FROM gates GROUP BY 1),
  terms AS (SELECT y, n, h0 + h1 + h2 AS entropy_reward, {' + '.join(f'h{i} / greatest(least(3 * m{i}, 1), 0.1)' for i in range(3))} AS adaptive_entropy_reward, (v0 + v1 + v2) / 3 AS regional_variance_reward,
    -({' + '.join(f'm{i} * ln(m{i} + 1e-8)' for i in range(3))}) - (h0 + h1 + h2) AS mutual_info_reward, {' + '.join(f'(m{i} - 1 / 3) ** 2' for i in range(3))} AS balance_loss FROM h)"""


def _register(query_name: str, column: str) -> None:
    from pricepanel.plans import registry

    def run(spark, d):
        return gt.batch_terms(gates(spark, d), ["y"]).select("y", "n", column)

    run.__name__ = query_name
    registry.query(f"{TERMS} SELECT y, n, {column} FROM terms", column)(run)


for _name, _column in (
    ("k10_entropy_reward", "entropy_reward"),
    ("k11_adaptive_entropy_reward", "adaptive_entropy_reward"),
    ("k12_regional_variance_reward", "regional_variance_reward"),
    ("k13_mutual_info_reward", "mutual_info_reward"),
    ("k14_balance_loss", "balance_loss"),
):
    _register(_name, _column)


MIX = """mix AS (SELECT *, p_bounce * distance - p_break * movement + p_hover * 0.1 AS mu, sqrt(p_bounce * 0.04 + p_break * movement * movement + p_hover * 0.01) AS sigma, lead(last) OVER (PARTITION BY issue_id ORDER BY date) AS nxt FROM gates)"""


def _mixed(spark, d):
    rows = wn.window_features(ranges(spark, d))
    x = (F.col("last") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-8))
    rows = rows.withColumns(
        {"za": x, "zb": F.element_at("distances", 4), "zc": -x, "m0": F.col("distance"), "m1": -F.col("movement"), "m2": F.lit(0.1), "s0": F.lit(0.2), "s1": F.abs("movement"), "s2": F.lit(0.1)}
    )
    rows = gt.mixture(rows, ["za", "zb", "zc"], ["m0", "m1", "m2"], ["s0", "s1", "s2"])
    return rows.withColumns({"y": F.year("date"), "nxt": F.lead("last").over(Window.partitionBy("issue_id").orderBy("date"))})


@query(f"{TERMS}, {MIX}, l AS (SELECT y, avg(0.5 * (ln((sigma + 1e-6) ** 2 + 1e-6) + (nxt - last - mu) ** 2 / ((sigma + 1e-6) ** 2 + 1e-6))) AS nll FROM mix WHERE nxt IS NOT NULL GROUP BY 1) SELECT y, nll, nll - 0.1 * entropy_reward + 0.5 * balance_loss AS objective FROM l JOIN terms USING (y)", "nll objective", 3)
def k16_total_objective(spark, d):
    rows = _mixed(spark, d)
    nll = mt.transition_scores(rows.where("nxt is not null").select("y", F.col("last").alias("x"), "nxt", "mu", "sigma"), ("y",))
    terms = gt.batch_terms(rows, ["y"])
    return nll.join(terms, "y").select("y", "nll", (F.col("nll") - 0.1 * F.col("entropy_reward") + 0.5 * F.col("balance_loss")).alias("objective"))


@query(f"{GATES}, {MIX} SELECT {K}, p_bounce, p_break, p_hover, mu, sigma FROM mix", f"{PCOLS} mu sigma")
def k17_mixture(spark, d):
    return _mixed(spark, d).select("issue_id", "date", *gt.P, "mu", "sigma")


@query(
    f"""{GATES}, {MIX}, u AS (SELECT y, {', '.join(f'avg(p_{e}) AS mean_{e}, var_pop(p_{e}) AS var_{e}, stddev_pop(p_{e}) AS sd_{e}' for e in gt.EXPERTS)}, avg(abs(mu)) AS mean_abs_drift, avg(sigma) AS mean_diffusion FROM mix GROUP BY 1) SELECT *, least(mean_bounce, mean_break, mean_hover) AS min_mean FROM u""",
    " ".join(f"{a}_{e}" for e in gt.EXPERTS for a in ("mean", "var", "sd")) + " mean_abs_drift mean_diffusion min_mean",
)
def k18_utilisation(spark, d):
    return gt.utilisation(_mixed(spark, d), ["y"])
