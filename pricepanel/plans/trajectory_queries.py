"""Queries L01-L19 over gate trajectories and M01-M13, K07, K08 and C12 over their events.

Trajectories: the real path of an origin, and three synthetic ones (the same security's windows 7, 14 and 21 rows earlier).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pricepanel.functions.expressions import LEVEL_RATIOS, levels
from pricepanel.functions.storage import written
from pricepanel.operators import events as ev
from pricepanel.operators import gates as gt
from pricepanel.operators import trajectory as tj
from pricepanel.operators import windows as wn
from pricepanel.operators.panel import PANEL_SQL, panel
from pricepanel.plans.calendar_queries import HOR, LOOK, ORIGINS, origins
from pricepanel.plans.event_sql import ALIGNED, events_sql
from pricepanel.plans.feature_queries import O, w
from pricepanel.plans.metric_queries import REPS, weights_sql
from pricepanel.plans.registry import query
from pricepanel.plans.trend_queries import FEATS

PK = "segment_id, issue_id, source, path_id"
PROB = "p_bounce, p_break, p_hover"
PW = f"PARTITION BY {PK} ORDER BY step"
TRAJ = f"""{ORIGINS}, m AS (SELECT issue_id, pos, date, cl_adj_loc AS last, lag(cl_adj_loc) OVER ({O}) AS previous, min(cl_adj_loc) {w(LOOK)} AS lo, max(cl_adj_loc) {w(LOOK)} AS hi, count(*) {w(LOOK)} AS n FROM pos),
  z AS (SELECT o.issue_id || '|' || origin_date AS segment_id, o.issue_id, origin_date, CASE WHEN p = 0 THEN 'real' ELSE 'synthetic' END AS source, p::INT AS path_id, (m.pos - origin_pos + 7 * p)::INT AS step, last, previous, lo, hi
    FROM origins o CROSS JOIN range(4) t(p) JOIN m ON m.issue_id = o.issue_id AND m.pos BETWEEN origin_pos - 7 * p AND origin_pos - 7 * p + {HOR} AND m.n = {LOOK}), {FEATS},
  ge AS (SELECT *, (last - lo) / greatest(hi - lo, 1e-8) AS za, distances[4] AS zb FROM feats), gf AS (SELECT *, exp(za - greatest(za, zb, -za)) AS ea, exp(zb - greatest(za, zb, -za)) AS eb, exp(-za - greatest(za, zb, -za)) AS ec FROM ge),
  traj AS (SELECT {PK}, origin_date, step, last AS price, ea / (ea + eb + ec) AS p_bounce, eb / (ea + eb + ec) AS p_break, ec / (ea + eb + ec) AS p_hover FROM gf),
  s0 AS (SELECT *, CASE WHEN p_bounce >= greatest(p_break, p_hover) THEN 0 WHEN p_break >= p_hover THEN 1 ELSE 2 END AS state,
    round(greatest(p_bounce, p_break, p_hover) - list_sort([p_bounce, p_break, p_hover])[2], 12) AS margin FROM traj),
  s1 AS (SELECT *, margin < 0.05 AS ambiguous, margin = 0 AS tied, lag(state) OVER ({PW}) AS "before", (abs(p_bounce - lag(p_bounce) OVER ({PW})) + abs(p_break - lag(p_break) OVER ({PW})) + abs(p_hover - lag(p_hover) OVER ({PW}))) / 3 AS soft_change FROM s0),
  st AS (SELECT *, sum(coalesce((state <> "before")::INT, 0)) OVER ({PW}) AS run, min(step) OVER (PARTITION BY {PK}) AS f, max(step) OVER (PARTITION BY {PK}) AS l FROM s1),
  runs AS (SELECT {PK}, run, state, min(step) AS start, max(step) AS "end", count(*) AS duration, min(step) = min(f) AS left_censored, max(step) = max(l) AS right_censored, min(step) <> min(f) AND max(step) <> max(l) AS interior FROM st GROUP BY {PK}, run, state),
  cells AS (SELECT a::INT AS a, b::INT AS b FROM range(3) t(a), range(3) u(b)), keys AS (SELECT DISTINCT {PK} FROM traj),
  tn AS (SELECT {PK}, "before" AS a, state AS b, count(*) AS n FROM st WHERE "before" IS NOT NULL GROUP BY {PK}, "before", state), tc AS (SELECT {PK}, a, b, coalesce(n, 0) AS n FROM keys CROSS JOIN cells LEFT JOIN tn USING ({PK}, a, b)),
  paths AS (SELECT {PK}, max(price) / min(price) < 1.25 AS valid FROM traj GROUP BY {PK}),
  ok AS (SELECT *, bool_or(source = 'real') OVER (PARTITION BY segment_id) AND bool_or(source = 'synthetic') OVER (PARTITION BY segment_id) AS paired FROM paths WHERE valid),
  wt AS (SELECT {PK}, 1 / count(*) OVER (PARTITION BY segment_id, source) AS weight FROM ok WHERE paired),
  met AS (SELECT {PK}, count(*) AS observations, count(*) FILTER (state <> "before") AS switches, avg(soft_change) AS soft_change_mean, quantile_cont(soft_change, 0.5) AS soft_change_median,
    avg(-({' + '.join(f'CASE WHEN {c} > 0 THEN {c} * ln({c}) ELSE 0 END' for c in gt.P)})) / ln(3.0) AS entropy, avg(ambiguous::INT) AS ambiguous_share, avg(tied::INT) AS tie_share, {', '.join(f'avg(p_{e}) AS mean_{e}' for e in gt.EXPERTS)},
    {', '.join(f'avg((state = {i})::INT) AS share_{e}' for i, e in enumerate(gt.EXPERTS))} FROM st GROUP BY {PK}),
  md AS (SELECT {PK}, avg(duration) AS dwell_mean, quantile_cont(duration, 0.5) AS dwell_median, {', '.join(f'avg(duration) FILTER (state = {i}) AS dwell_{e}' for i, e in enumerate(gt.EXPERTS))} FROM runs GROUP BY {PK}),
  metrics AS (SELECT *, CASE WHEN observations > 1 THEN 100 * switches / (observations - 1) END AS switches_per_100, switches = 0 AS zero_switch FROM met JOIN md USING ({PK}))"""


def trajectories(spark, d):
    starts = origins(spark, d).withColumn("path_id", F.explode(F.sequence(F.lit(0), F.lit(3))))
    starts = starts.withColumns(
        {"source": F.when(F.col("path_id") == 0, "real").otherwise("synthetic"), "segment_id": F.concat_ws("|", "issue_id", F.col("origin_date").cast("string")), "origin_pos": F.col("origin_pos") - 7 * F.col("path_id")}
    )
    rows = gt.gate_scores(wn.window_features(wn.trajectory_windows(starts, panel(spark, d), "cl_adj_loc", LOOK, HOR)))
    return rows.select(*tj.PATH, "origin_date", "step", F.col("last").alias("price"), "lo", "hi", *gt.P)


def steps(spark, d):
    return tj.stepped(trajectories(spark, d))


def paths(rows):
    out = rows.groupBy(*tj.PATH).agg((F.max("price") / F.min("price") < 1.25).alias("valid"))
    return out.withColumn("reason", F.when(F.col("valid"), "").otherwise("range"))


def weighted(rows):
    return tj.paired_weights(paths(rows))


@query(f"{TRAJ} SELECT {PK}, step, state, margin, ambiguous, tied FROM st", "margin")
def l01_states_and_flags(spark, d):
    return gt.top_two(trajectories(spark, d)).select(*tj.PATH, "step", "state", "margin", "ambiguous", "tied")


@query(f"{TRAJ} SELECT {PK}, step, soft_change FROM st", "soft_change")
def l02_soft_change(spark, d):
    return steps(spark, d).select(*tj.PATH, "step", "soft_change")


@query(f"{TRAJ} SELECT {PK}, run, state, start, \"end\", duration, left_censored, right_censored, interior FROM runs")
def l03_dwell_runs(spark, d):
    return tj.dwell_runs(steps(spark, d))


@query(f"{TRAJ} SELECT {PK}, a AS \"from\", b AS \"to\", n, n / nullif(sum(n) OVER (PARTITION BY {PK}, a), 0) AS probability FROM tc", "probability")
def l04_transitions(spark, d):
    return tj.transition_rows(tj.transitions(steps(spark, d)), tj.PATH)


MET = [f"{a}_{e}" for e in gt.EXPERTS for a in ("mean", "share", "dwell")] + ["soft_change_mean", "soft_change_median", "entropy", "ambiguous_share", "tie_share", "dwell_mean", "dwell_median", "switches_per_100"]


@query(f"{TRAJ} SELECT {PK}, observations, switches, zero_switch, {', '.join(MET)} FROM metrics", " ".join(MET))
def l05_trajectory_metrics(spark, d):
    return tj.trajectory_metrics(steps(spark, d)).select(*tj.PATH, "observations", "switches", "zero_switch", *MET)


@query(f"{TRAJ} SELECT {PK}, weight FROM wt", "weight")
def l06_paired_weights(spark, d):
    return weighted(trajectories(spark, d)).select(*tj.PATH, "weight")


@query(
    f"""{TRAJ}, x AS (SELECT source, entropy AS v, weight FROM metrics JOIN wt USING ({PK})), c AS (SELECT *, sum(weight) OVER (PARTITION BY source ORDER BY v) AS cum, sum(weight) OVER (PARTITION BY source) AS a FROM x)
    SELECT source, min(v) AS entropy_quantile FROM c WHERE cum >= 0.5 * a - 1e-9 GROUP BY 1""",
    "entropy_quantile",
)
def l07_weighted_quantile(spark, d):
    rows = steps(spark, d)
    both = tj.trajectory_metrics(rows).join(weighted(rows), tj.PATH)
    return tj.weighted_quantile(both, ["source"], "entropy", "weight")


@query(f"{TRAJ}, {weights_sql('panel')} SELECT replicate, issue_id, weight FROM weights")
def l08_bootstrap_weights(spark, d):
    return gt.bootstrap_weights(panel(spark, d), REPS, 7)


def _bands_sql(sums: str, keys: str) -> str:
    """Estimate, interval and difference (synthetic less real) from per-stock sums ``sums(keys, source, issue_id, s, w)``; a draw counts where its ``w`` is positive."""
    k, on = f"{keys}, ", f"{keys}, source"
    gap = "max(estimate) FILTER (source = 'synthetic') - max(estimate) FILTER (source = 'real') AS estimate"
    return f"""est AS (SELECT {k}source, sum(s) / nullif(sum(w), 0) AS estimate FROM {sums} GROUP BY ALL), dr AS (SELECT {k}source, replicate, CASE WHEN sum(w * weight) > 0 THEN sum(s * weight) / sum(w * weight) END AS estimate FROM {sums} JOIN weights USING (issue_id) GROUP BY ALL),
  est2 AS (SELECT {k}source, estimate FROM est UNION ALL SELECT {k}'{tj.GAP}', {gap} FROM est GROUP BY {keys}),
  dr2 AS (SELECT {k}source, estimate FROM dr UNION ALL SELECT {k}'{tj.GAP}', {gap} FROM dr GROUP BY {k}replicate),
  bands AS (SELECT {on}, quantile_cont(estimate, 0.025) AS lo, quantile_cont(estimate, 0.975) AS hi, count(estimate)::INT AS replicates FROM dr2 GROUP BY ALL),
  result AS (SELECT * FROM est2 LEFT JOIN bands USING ({on}))"""


@query(
    f"""{TRAJ}, {weights_sql('wt')}, lg AS (SELECT segment_id, issue_id, source, weight, unnest([{', '.join(f"'{x}'" for x in tj.METRICS)}]) AS metric, unnest([{', '.join(f'{x}::DOUBLE' for x in tj.METRICS)}]) AS value FROM metrics JOIN wt USING ({PK})),
    sm AS (SELECT metric, source, issue_id, coalesce(sum(weight * value), 0) AS s, sum(weight) AS w FROM lg GROUP BY 1, 2, 3), {_bands_sql('sm', 'metric')},
    cu AS (SELECT metric, source, value, sum(weight) OVER (PARTITION BY metric, source ORDER BY value) AS cum, sum(weight) OVER (PARTITION BY metric, source) AS a FROM lg WHERE value IS NOT NULL), md2 AS (SELECT metric, source, min(value) AS median FROM cu WHERE cum >= 0.5 * a - 1e-9 GROUP BY 1, 2),
    nn AS (SELECT source, count(*) AS trajectories, count(DISTINCT segment_id) AS origins FROM wt GROUP BY 1), n2 AS (SELECT * FROM nn UNION ALL SELECT '{tj.GAP}', NULL, origins FROM nn WHERE source = 'real')
    SELECT r.metric, r.source, estimate, lo, hi, replicates, median, trajectories, origins, (SELECT count(DISTINCT issue_id) FROM wt) AS stocks FROM result r LEFT JOIN md2 USING (metric, source) JOIN n2 USING (source)""",
    "estimate lo hi median",
)
def l09_trajectory_comparison(spark, d):
    rows = written(steps(spark, d), "steps")
    both = tj.trajectory_metrics(rows).join(weighted(rows), tj.PATH)
    return tj.compared(written(both, "weighted-metrics"), REPS, 7)


@query(
    f"""{TRAJ}, {weights_sql('wt')}, s9 AS (SELECT a AS "from", b AS "to", source, issue_id, sum(weight * n) AS s, sum(n) AS n FROM tc JOIN wt USING ({PK}) GROUP BY 1, 2, 3, 4),
    sm AS (SELECT *, sum(s) OVER (PARTITION BY "from", source, issue_id) AS w, sum(n) OVER (PARTITION BY "from", source, issue_id) AS raw FROM s9), {_bands_sql('sm', '"from", "to"')},
    sp AS (SELECT "from", "to", source, sum(s) AS weighted, sum(w) AS weighted_from, sum(raw)::BIGINT AS raw_from, count(*) FILTER (w > 0) AS stocks, sum(raw) >= 30 AND count(*) FILTER (w > 0) >= 5 AS supported FROM sm GROUP BY 1, 2, 3),
    s2 AS (SELECT * FROM sp UNION ALL SELECT "from", "to", '{tj.GAP}', NULL, NULL, NULL, min(stocks), bool_and(supported) FROM sp GROUP BY 1, 2)
    SELECT r.* EXCLUDE (lo, hi), CASE WHEN supported THEN lo END AS lo, CASE WHEN supported THEN hi END AS hi, weighted, weighted_from, raw_from, stocks, supported FROM result r JOIN s2 USING ("from", "to", source)""",
    "estimate lo hi weighted weighted_from",
)
def l10_transition_comparison(spark, d):
    rows = written(steps(spark, d), "steps")
    return tj.compared_transitions(tj.transitions(rows), weighted(rows), REPS, 7)


@query(f"{TRAJ} SELECT segment_id, source, a AS \"from\", b AS \"to\", sum(n)::BIGINT AS raw, sum(n * weight) AS weighted FROM tc JOIN wt USING ({PK}) GROUP BY 1, 2, 3, 4", "weighted")
def l11_transition_origins(spark, d):
    rows = steps(spark, d)
    return tj.transition_origins(tj.transitions(rows), weighted(rows))


@query(f"{TRAJ} SELECT source, quantile_cont(soft_change, 0.025) AS lo, quantile_cont(soft_change, 0.975) AS hi, count(soft_change) AS replicates FROM st GROUP BY 1", "lo hi")
def l12_interval(spark, d):
    return tj.interval(steps(spark, d), ["source"], "soft_change")


DIST = f"""wr AS (SELECT runs.*, weight FROM runs JOIN wt USING ({PK})), dm AS (SELECT source, state, interior, duration, sum(weight) AS mass FROM wr GROUP BY 1, 2, 3, 4),
  dg AS (SELECT source, a::INT AS state, interior, du::BIGINT AS duration FROM (SELECT unnest(['real', 'synthetic']) AS source), range(3) t(a), (SELECT unnest([true, false]) AS interior), range(1, {HOR + 2}) u(du)),
  dd AS (SELECT source, state, interior, duration, coalesce(mass, 0) AS mass FROM dg LEFT JOIN dm USING (source, state, interior, duration)), dist AS (SELECT *, mass / nullif(sum(mass) OVER (PARTITION BY source, state), 0) AS share FROM dd)"""


@query(f"{TRAJ}, {DIST} SELECT * FROM dist", "mass share")
def l13_dwell_distribution(spark, d):
    rows = steps(spark, d)
    return tj.dwell_distribution(tj.weighted_runs(tj.dwell_runs(rows), weighted(rows)), HOR + 1)


@query(
    f"""{TRAJ}, {DIST}, sc AS (SELECT *, 'all' AS scope FROM wr UNION ALL SELECT *, 'interior' FROM wr WHERE interior), cu AS (SELECT source, state, scope, duration, sum(weight) OVER (PARTITION BY source, state, scope ORDER BY duration) AS cum, sum(weight) OVER (PARTITION BY source, state, scope) AS a FROM sc),
    me AS (SELECT source, state, scope, min(duration)::DOUBLE AS median FROM cu WHERE cum >= 0.5 * a - 1e-9 GROUP BY 1, 2, 3)
    SELECT source, state, scope, count(*) AS runs, sum(weight) AS weighted_runs, sum(weight * duration) / sum(weight) AS mean, coalesce(sum(weight) FILTER (NOT interior), 0) / sum(weight) AS censored_share, max(median) AS median FROM sc JOIN me USING (source, state, scope) GROUP BY 1, 2, 3""",
    "weighted_runs mean censored_share median",
)
def l14_dwell_summary(spark, d):
    rows = steps(spark, d)
    return tj.dwell_summary(tj.weighted_runs(tj.dwell_runs(rows), weighted(rows)))


@query(
    f"""{TRAJ}, x AS (SELECT source, weight, switches, soft_change_mean AS m, max(soft_change_mean) OVER () AS t FROM metrics JOIN wt USING ({PK})), h AS (SELECT 'switches' AS name, source, switches::INT AS bin, sum(weight) AS mass FROM x GROUP BY 2, 3
    UNION ALL SELECT 'soft_change', source, coalesce(least(floor(m / nullif(t, 0) * 40), 39), 0)::INT, sum(weight) FROM x WHERE m IS NOT NULL GROUP BY 2, 3) SELECT name, source, bin, mass / sum(mass) OVER (PARTITION BY name, source) AS share FROM h""",
    "share",
)
def l15_weighted_histograms(spark, d):
    rows = written(steps(spark, d), "steps")
    both = tj.trajectory_metrics(rows).join(weighted(rows), tj.PATH)
    counts = tj.weighted_histogram(both, "switches", width=1.0).select(F.lit("switches").alias("name"), "source", "bin", "share")
    return counts.union(tj.weighted_histogram(both, "soft_change_mean").select(F.lit("soft_change"), "source", "bin", "share"))


COVER = f"cv AS (SELECT segment_id, issue_id, count(*) FILTER (source = 'real' AND valid) AS real_valid, count(*) FILTER (source = 'synthetic') AS generated, count(*) FILTER (source = 'synthetic' AND valid) AS synthetic_valid, count(*) FILTER (source = 'synthetic' AND NOT valid) AS synthetic_invalid FROM paths GROUP BY 1, 2)"


@query(f"{TRAJ}, {COVER} SELECT *, real_valid > 0 AND synthetic_valid > 0 AS paired FROM cv")
def l16_coverage(spark, d):
    return tj.coverage(paths(trajectories(spark, d)))


@query(f"{TRAJ}, {COVER}, e AS (SELECT source, 'range' AS reason FROM paths WHERE NOT valid UNION ALL SELECT 'real', 'no valid path' FROM cv WHERE real_valid = 0 UNION ALL SELECT 'synthetic', 'no valid path' FROM cv WHERE synthetic_valid = 0) SELECT source, reason, count(*) AS n FROM e GROUP BY 1, 2")
def l16_exclusions(spark, d):
    return tj.exclusions(paths(trajectories(spark, d)))


@query(f"{TRAJ}, {DIST} SELECT source, state, duration, sum(share) AS share FROM dist GROUP BY 1, 2, 3", "share")
def l17_all_runs_share(spark, d):
    rows = steps(spark, d)
    return tj.all_runs_share(tj.dwell_distribution(tj.weighted_runs(tj.dwell_runs(rows), weighted(rows)), HOR + 1))


@query(
    f"""{ORIGINS}, h AS (SELECT issue_id, origin_date, sha256('1|' || issue_id || '|' || origin_date) AS x FROM origins)
    SELECT issue_id, origin_date, ({' + '.join(f"(('0x' || substr(x, {2 * i + 1}, 2))::INT)::HUGEINT * {256 ** i}::HUGEINT" for i in range(8))}) % 9223372036854775807 AS seed FROM h"""
)
def l18_origin_seed(spark, d):
    return origins(spark, d).select("issue_id", "origin_date", tj.origin_seed(1, F.col("issue_id"), F.col("origin_date")).alias("seed"))


@query(f"{TRAJ} SELECT {PK}, (row_number() OVER ({PW}) - 1)::INT AS step, price, {PROB} FROM traj", "p_bounce p_break p_hover")
def l19_unrolled_steps(spark, d):
    rows = trajectories(spark, d)
    packed = rows.groupBy(*tj.PATH).agg(F.sort_array(F.collect_list(F.struct("step", "price", *gt.P))).alias("s"))
    return tj.unrolled(packed.select(*tj.PATH, *(F.col(f"s.{c}").alias(c) for c in ("price", *gt.P))))


RULES = ev.Rules()
#: Last prices that the SQL extends an unfinished path by: enough for any interaction to have an event.
PAD = RULES.min_dwell + RULES.max_dwell + RULES.confirmation


def event_paths(spark, d):
    """Paths in units of their origin's window range, with the levels of that range."""
    from pyspark.sql import Window

    rows = trajectories(spark, d)
    first = Window.partitionBy(*tj.PATH).orderBy("step")
    rows = rows.withColumns({"l0": F.first("lo").over(first), "h0": F.first("hi").over(first)})
    scaled = (F.col("price") - F.col("l0")) / F.greatest(F.col("h0") - F.col("l0"), F.lit(1e-8))
    return rows.withColumn("price", scaled).withColumn("levels", levels(F.lit(0.0), F.lit(1.0)))


def traced(spark, d):
    return ev.traced(event_paths(spark, d), tj.PATH, RULES)


def detected(spark, d):
    rows = written(event_paths(spark, d), "event-paths")
    return rows, written(ev.interactions(rows, tj.PATH, RULES), "events")


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


EV = _recursive(f"{TRAJ}, {events_sql(RULES, LEVEL_RATIOS)}")
EV_PADDED = _recursive(f"{TRAJ}, {events_sql(RULES, LEVEL_RATIOS, PAD)}")
EV_BOTH = f"{EV_PADDED}, {events_sql(RULES, LEVEL_RATIOS, prefix='u_')}"


def _unresolved_sql(horizon: int) -> str:
    return f"""op AS (SELECT DISTINCT {PK}, entry_index FROM ev WHERE entry_index <= {horizon} AND output_index > {horizon}),
  ur AS (SELECT {PK}, count(*) AS unresolved FROM op ANTI JOIN (SELECT {PK}, entry_index FROM ev WHERE is_terminal AND output_index <= {horizon}) USING ({PK}, entry_index) GROUP BY {PK})"""


@query(f"{EV} SELECT * FROM ev", "fib_level exit_price max_price_after min_price_after")
def m01_interactions(spark, d):
    return ev.interactions(event_paths(spark, d), tj.PATH, RULES)


@query(
    f"""WITH {PANEL_SQL}, m AS (SELECT issue_id, date_trunc('month', date)::DATE AS origin_date, hi_adj_loc AS hi, CASE WHEN month(date) <> 2 THEN 1 END AS has_levels FROM panel)
  SELECT issue_id, origin_date, count(hi) AS n_steps, count(*) - count(hi) AS n_missing,
         CASE WHEN count(hi) = 0 THEN 'empty' WHEN count(has_levels) = 0 THEN 'levels' END AS fault FROM m GROUP BY 1, 2"""
)
def m02_detector_inputs(spark, d):
    """High prices by security and month; February comes without levels."""
    rows = panel(spark, d).select("issue_id", F.trunc("date", "month").alias("origin_date"), F.dayofmonth("date").alias("step"), F.col("hi_adj_loc").alias("price"), "date")
    return ev.path_faults(rows.withColumn("levels", F.when(F.month("date") != 2, levels(F.lit(0.0), F.lit(1.0)))), ["issue_id", "origin_date"])


@query(f"{EV} SELECT {PK}, step, state FROM trace")
def m03_state_trace(spark, d):
    return ev.state_trace(event_paths(spark, d), tj.PATH, RULES)


@query(
    f"""{EV}, tl AS (SELECT *, coalesce((state <> lag(state) OVER ({PW}))::INT, 0) AS new FROM trace), tr AS (SELECT *, sum(new) OVER ({PW}) AS run FROM tl)
    SELECT {PK}, run, state, min(step)::INT AS start, max(step)::INT AS "end", coalesce(string_agg(event_type, ',' ORDER BY step), '') AS events FROM tr LEFT JOIN (SELECT {PK}, output_index AS step, event_type FROM ev) USING ({PK}, step) GROUP BY {PK}, run, state"""
)
def m04_state_runs(spark, d):
    traces = written(traced(spark, d), "traced-paths")
    return ev.state_runs(ev.states_of(traces, tj.PATH), ev.events_of(traces, tj.PATH), tj.PATH)


def _faulty(events):
    """The events, and those of every third path once more with an output one step earlier: a table with violations."""
    odd = F.pmod(F.col("entry_index") + F.col("path_id"), F.lit(3)) == 0
    moved = events.where(odd).withColumns({"source": F.concat(F.lit("faulty "), "source"), "output_index": F.col("output_index") - F.col("entry_index")})
    return events.unionByName(moved).unionByName(events.where(odd).withColumn("source", F.concat(F.lit("faulty "), "source")))


@query(
    f"""{EV}, od AS (SELECT * FROM ev WHERE (entry_index + path_id) % 3 = 0), fe AS (SELECT * FROM ev UNION ALL SELECT * REPLACE ('faulty ' || source AS source, output_index - entry_index AS output_index) FROM od UNION ALL SELECT * REPLACE ('faulty ' || source AS source) FROM od),
    fl AS (SELECT *, lag(output_index) OVER w AS back, lag(entry_index) OVER w AS went FROM fe WINDOW w AS (PARTITION BY {PK} ORDER BY output_index, entry_index, event_type)),
    fp AS (SELECT count(*) FILTER (event_type = 'HOVER') AS h, count(*) FILTER (is_terminal) AS t, max(hover_index) AS hover, min(output_index) FILTER (is_terminal) AS final FROM fe GROUP BY {PK}, entry_index)
    SELECT * FROM (SELECT count(*) FILTER (back >= output_index) AS out_of_order, count(*) FILTER (went <> entry_index AND entry_index <= back) AS overlapping FROM fl),
      (SELECT count(*) FILTER (h > 1) AS hovers, count(*) FILTER (t > 1) AS terminals, count(*) FILTER (hover > final) AS hover_after_end FROM fp)"""
)
def m05_event_integrity(spark, d):
    """Violations in the events together with a spoilt copy of some; on its own what the detector returns has none."""
    return ev.integrity(_faulty(detected(spark, d)[1]), tj.PATH)


def _aligned(spark, d):
    rows, events = detected(spark, d)
    return ev.aligned(events, rows, tj.PATH)


GATE = " ".join(f"{c}{x}" for c in gt.P for x in ("", "_entry", "_change"))
AL = f"{EV}, {ALIGNED}"


@query(f"{AL} SELECT * FROM ag", f"fib_level exit_price max_price_after min_price_after {GATE}")
def m06_event_gate_alignment(spark, d):
    return _aligned(spark, d)


@query(f"{EV_PADDED}, {_unresolved_sql(HOR)} SELECT * FROM ur")
def m07_unresolved(spark, d):
    return ev.unresolved(traced(spark, d), tj.PATH, HOR, RULES, PAD)


@query(
    f"""{AL}, du AS (SELECT event, duration, row_number() OVER (PARTITION BY event ORDER BY duration) AS k, count(*) OVER (PARTITION BY event) AS n FROM ag), md2 AS (SELECT event, duration FROM du WHERE k = (n + 1) // 2),
    mo AS (SELECT event, duration, issue_id, split_part(segment_id, '|', 2) AS origin_date, entry_index, row_number() OVER (PARTITION BY event ORDER BY issue_id, split_part(segment_id, '|', 2), entry_index) AS k FROM ag JOIN md2 USING (event, duration))
    SELECT event, duration, issue_id, origin_date, entry_index FROM mo WHERE k = 1"""
)
def m08_typical_examples(spark, d):
    rows = _aligned(spark, d).withColumn("origin_date", F.element_at(F.split("segment_id", r"\|"), 2))
    return ev.typical_examples(rows)


BY_PATH = f"""{EV}, bp0 AS (SELECT {PK}, count(*) FILTER (event_type = 'HOVER') AS hover, count(*) FILTER (event_type = 'BREAKOUT') AS breakout, count(*) FILTER (event_type = 'PULLBACK') AS pullback, count(*) FILTER (event_type = 'TIMEOUT') AS timeout
    FROM (SELECT DISTINCT {PK} FROM ep) LEFT JOIN ev USING ({PK}) GROUP BY {PK}), bp AS (SELECT *, breakout + pullback AS evaluated FROM bp0)"""


@query(f"{BY_PATH} SELECT *, breakout / nullif(evaluated, 0) AS breakout_share, pullback / nullif(evaluated, 0) AS pullback_share, breakout / nullif(pullback, 0) AS breakout_ratio FROM bp", "breakout_share pullback_share breakout_ratio")
def m09_events_by_path(spark, d):
    rows, events = detected(spark, d)
    return ev.counts_by_path(rows, events, tj.PATH)


KINDS = ("hover", "breakout", "pullback", "timeout", "evaluated")


@query(f"{BY_PATH} SELECT source, count(*) AS paths, {', '.join(f'sum({k})::BIGINT AS {k}, avg({k}) AS mean_{k}' for k in KINDS)} FROM bp GROUP BY source", " ".join(f"mean_{k}" for k in KINDS))
def m10_events_by_source(spark, d):
    rows, events = detected(spark, d)
    return ev.counts_by_source(ev.counts_by_path(rows, events, tj.PATH))


def _with_level(events):
    place = F.array_position(F.transform(levels(F.lit(0.0), F.lit(1.0)), lambda v: F.round(v, 6)), F.round("fib_level", 6))
    return events.withColumn("level_index", (place - 1).cast("int"))


@query(
    f"""{EV}, hn AS (SELECT event_type, lv.l AS level_index, source, count(*) AS n FROM ev JOIN lv ON ev.fib_level = lv.level GROUP BY ALL)
    SELECT event_type, level_index::INT AS level_index, source, coalesce(n, 0) AS n FROM (SELECT unnest(['HOVER', 'BREAKOUT', 'PULLBACK', 'TIMEOUT']) AS event_type) CROSS JOIN (SELECT l AS level_index FROM lv) CROSS JOIN (SELECT unnest(['real', 'synthetic']) AS source) LEFT JOIN hn USING (event_type, level_index, source)"""
)
def m11_event_level_histogram(spark, d):
    return ev.level_histogram(_with_level(detected(spark, d)[1]))


@query(
    f"""{TRAJ}, n AS (SELECT year(origin_date) AS y, source, nearest_level AS level_index, count(*) AS n FROM feats GROUP BY 1, 2, 3), wd AS (SELECT y, level_index, coalesce(sum(n) FILTER (source = 'real'), 0) AS a, coalesce(sum(n) FILTER (source = 'synthetic'), 0) AS b FROM n GROUP BY 1, 2),
    p AS (SELECT y, a / sum(a) OVER (PARTITION BY y) AS p, b / sum(b) OVER (PARTITION BY y) AS q FROM wd) SELECT y, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS distance FROM p GROUP BY 1""",
    "distance",
)
def m12_jensen_shannon(spark, d):
    starts = origins(spark, d).withColumn("path_id", F.explode(F.sequence(F.lit(0), F.lit(3))))
    starts = starts.withColumns({"source": F.when(F.col("path_id") == 0, "real").otherwise("synthetic"), "origin_pos": F.col("origin_pos") - 7 * F.col("path_id")})
    rows = wn.window_features(wn.trajectory_windows(starts, panel(spark, d), "cl_adj_loc", LOOK, HOR))
    counts = rows.groupBy(F.year("origin_date").alias("y"), "source", F.col("nearest_level").alias("level_index")).agg(F.count(F.lit(1)).alias("n"))
    return ev.jensen_shannon(counts, ["y"], "real", "synthetic")


@query(
    f"""{EV_BOTH}, {_unresolved_sql(HOR)}, us AS (SELECT segment_id, sum(unresolved)::BIGINT AS unresolved FROM ur GROUP BY 1),
    ts AS (SELECT segment_id, count(*) FILTER (event_type = 'TIMEOUT') AS timeouts FROM u_ev GROUP BY 1)
    SELECT segment_id, coalesce(timeouts, 0) AS timeouts, coalesce(unresolved, 0) AS unresolved FROM (SELECT DISTINCT segment_id FROM ep) LEFT JOIN ts USING (segment_id) LEFT JOIN us USING (segment_id)"""
)
def m13_segment_counters(spark, d):
    traces = written(traced(spark, d), "traced-paths")
    timeouts = F.size(F.filter("event", lambda e: e["event_type"] == "TIMEOUT"))
    per = traces.groupBy("segment_id").agg(F.sum(timeouts.cast("long")).alias("timeouts"))
    open_ = ev.unresolved(traces, tj.PATH, HOR, RULES, PAD).groupBy("segment_id").agg(F.sum("unresolved").alias("unresolved"))
    return per.join(open_, "segment_id", "left").na.fill(0, ["timeouts", "unresolved"])


@query(f"{EV_PADDED}, {_unresolved_sql(HOR // 2)} SELECT * FROM ur")
def c12_unfinished_entries(spark, d):
    return ev.unresolved(traced(spark, d), tj.PATH, HOR // 2, RULES, PAD)


SUMMARY = f"""{AL}, lg AS (SELECT event, issue_id, unnest([{', '.join(f"'{e}'" for e in gt.EXPERTS)}]) AS expert, unnest([{', '.join(gt.P)}]) AS a, unnest([{', '.join(f'{c}_entry' for c in gt.P)}]) AS b FROM ag),
  sg AS (SELECT event, expert, count(*) AS n, count(DISTINCT issue_id) AS stocks, avg(a) AS mean_event, avg(b) AS mean_entry, avg(a - b) AS mean_change FROM lg GROUP BY 1, 2),
  sy AS (SELECT event, expert, coalesce(n, 0) AS n, coalesce(stocks, 0) AS stocks, mean_event, mean_entry, mean_change FROM (SELECT unnest([{', '.join(f"'{e}'" for e in ev.EVENTS)}]) AS event) CROSS JOIN (SELECT unnest([{', '.join(f"'{e}'" for e in gt.EXPERTS)}]) AS expert) LEFT JOIN sg USING (event, expert))"""


@query(f"{SUMMARY} SELECT *, n >= 30 AND stocks >= 5 AS supported FROM sy", "mean_event mean_entry mean_change")
def k07_event_summary(spark, d):
    return ev.event_summary(_aligned(spark, d))


@query(
    f"""{SUMMARY}, sp AS (SELECT *, max(mean_event) OVER (PARTITION BY expert) - min(mean_event) OVER (PARTITION BY expert) AS spread, row_number() OVER (PARTITION BY event ORDER BY mean_event DESC, expert DESC) AS k FROM sy WHERE mean_event IS NOT NULL)
    SELECT event, expert, mean_event, spread FROM sp WHERE k = 1""",
    "mean_event spread",
)
def k08_event_winners(spark, d):
    return ev.event_winners(ev.event_summary(_aligned(spark, d)))
