"""Hand-computed cases, invariants, and SQL oracles on the smallest tables."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricepanel import plans
from pricepanel.operators import automaton
from pricepanel.operators import calendar as cal
from pricepanel.operators import events as ev
from pricepanel.operators import features as fx
from pricepanel.operators import filters as fl
from pricepanel.operators import gates as gt
from pricepanel.operators import joins as jn
from pricepanel.operators import metrics as mt
from pricepanel.operators import normalise as nm
from pricepanel.operators import paths as pt
from pricepanel.operators import sampling as sm
from pricepanel.operators import trajectory as tj
from pricepanel.operators import user_functions as uf
from pricepanel.operators import windows as wn
from pricepanel.plans import registry
from pricepanel.sources import tables as st

sys.path.insert(0, os.path.dirname(__file__))
from detector import detect  # noqa: E402

plans.load()
TINY = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings labels".split()


def gate_rows(spark, rows, **cols):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "step int, p_bounce double, p_break double, p_hover double").withColumns({k: F.lit(v) for k, v in cols.items()})


def prices(spark, values, start="2017-01-02", issue="a"):
    days = [d.date() for d in pd.bdate_range(start, periods=len(values))]
    return spark.createDataFrame([(issue, d, float(v)) for d, v in zip(days, values, strict=True)], "issue_id string, date date, cl_adj_loc double")


def test_gate_accumulator_splits_ties(spark):
    rows = gate_rows(spark, [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (0.5, 0.5, 0.0), (1 / 3, 1 / 3, 1 / 3)], batch=1)
    out = gt.accumulated(rows, ["batch"]).first()
    assert math.isclose(out["share_bounce"], (1 + 0.5 + 1 / 3) / 5) and math.isclose(out["share_hover"], (1 + 1 / 3) / 5)
    uniform = gt.accumulated(rows.where("step = 4"), ["batch"]).first()
    assert math.isclose(uniform["entropy"], 1) and gt.accumulated(rows.where("step = 0"), ["batch"]).first()["entropy"] == 0


def test_assignment_change_leaves_ambiguous_rows_out(spark):
    before = gate_rows(spark, [(0.8, 0.1, 0.1), (0.4, 0.39, 0.21), (0.1, 0.8, 0.1)])
    after = gate_rows(spark, [(0.1, 0.8, 0.1), (0.2, 0.6, 0.2), (0.1, 0.8, 0.1)])
    out = gt.assignment_change(before, after, ["step"]).first()
    assert math.isclose(out["exclusion_rate"], 1 / 3) and out["switch_fraction"] == 0.5
    tied = gate_rows(spark, [(0.4, 0.4, 0.2)])
    assert gt.assignment_change(tied, tied, ["step"]).first()["switch_fraction"] is None


def test_gate_rewards_of_known_gates(spark):
    collapsed = gt.batch_terms(gate_rows(spark, [(1.0, 0.0, 0.0)] * 10, b=1), ["b"]).first()
    balanced = gt.batch_terms(gate_rows(spark, [(1 / 3, 1 / 3, 1 / 3)] * 10, b=1), ["b"]).first()
    special = gt.batch_terms(gate_rows(spark, [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)], b=1), ["b"]).first()
    assert math.isclose(collapsed["balance_loss"], 2 / 3) and abs(balanced["balance_loss"]) < 1e-12
    assert math.isclose(balanced["entropy_reward"], math.log(3), abs_tol=1e-6) and abs(balanced["mutual_info_reward"]) < 1e-6
    assert math.isclose(special["mutual_info_reward"], math.log(3), abs_tol=1e-6) and math.isclose(special["regional_variance_reward"], 2 / 9)


def test_probability_checks(spark):
    rows = gate_rows(spark, [(0.2, 0.3, 0.5), (0.2, 0.3, 0.6), (-0.1, 0.6, 0.5), (float("nan"), 0.5, 0.5), (None, 0.5, 0.5)])
    assert [r[0] for r in rows.orderBy("step").select(fl.probabilities_valid([F.col(c) for c in gt.P])).collect()] == [True, False, False, False, False]


def test_window_features_take_the_first_level_on_a_tie(spark):
    rows = spark.createDataFrame([(12.1, 12.0, 10.0, 14.0), (11.8, 12.0, 10.0, 14.0), (7.0, 7.0, 7.0, 7.0), (11.6, 11.0, 10.0, 14.0)], "last double, previous double, lo double, hi double")
    out = wn.window_features(rows).collect()
    assert out[0]["distance"] > 0 > out[1]["distance"] and [r["nearest_level"] for r in out] == [3, 3, 0, 2]


def test_states_and_runs(spark):
    path = {"segment_id": 0, "issue_id": "a", "source": "real", "path_id": 0}
    still = tj.stepped(gate_rows(spark, [(0.0, 0.0, 1.0)] * 101, **path))
    flips = tj.stepped(gate_rows(spark, [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0)] * 50 + [(1.0, 0.0, 0.0)], **path))
    for rows, switches in ((still, 0), (flips, 100)):
        runs = tj.dwell_runs(rows)
        out = tj.trajectory_metrics(rows).first()
        assert out["switches"] == switches and runs.agg(F.sum("duration")).first()[0] == 101
        counts = tj.transitions(rows)
        assert sum(counts.select([c for c in counts.columns if c.startswith("t_")]).first()) == 100
        first, last = runs.orderBy("start").first(), runs.orderBy(F.desc("start")).first()
        assert first["left_censored"] and last["right_censored"]
    assert tj.transition_rows(tj.transitions(still), ["segment_id"]).where("from = 0 and to = 1").first()["probability"] is None
    mixed = tj.stepped(gate_rows(spark, [(0.0, 0.0, 1.0)] * 3 + [(1.0, 0.0, 0.0)] * 2 + [(0.0, 0.0, 1.0)], **path))
    assert [(r["state"], r["duration"], r["interior"]) for r in tj.dwell_runs(mixed).orderBy("start").collect()] == [(2, 3, False), (0, 2, True), (2, 1, False)]


def test_paired_weights_sum_to_one(spark):
    rows = [(s, "i", "real", 0, True) for s in range(6)] + [(s, "i", "synthetic", p, True) for s in range(6) for p in range(s + 1)] + [(99, "i", "real", 0, True), (98, "i", "synthetic", 0, False)]
    out = tj.paired_weights(spark.createDataFrame(rows, "segment_id int, issue_id string, source string, path_id int, valid boolean"))
    sums = out.groupBy("segment_id", "source").agg(F.sum("weight").alias("w")).collect()
    assert len(sums) == 12 and all(math.isclose(r["w"], 1) for r in sums)


@pytest.mark.parametrize("bins", [1, 7, 1024])
def test_weighted_quantile_against_sorting(spark, bins):
    rng = np.random.default_rng(2)
    x, w = rng.integers(0, 40, 300) / 4, rng.integers(0, 5, 300) / 3
    rows = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, w, strict=True)], "g string, x double, w double")
    order = np.argsort(x, kind="stable")
    cum = np.cumsum(w[order])
    for q in (0.0, 0.25, 0.5, 0.99):
        want = x[order][w[order] > 0][np.searchsorted(cum[w[order] > 0], max(q * w.sum() - 1e-9, 0))]
        assert tj.weighted_quantile(rows, ["g"], "x", "w", q, bins).first()["x_quantile"] == want


def test_origin_seed_formula(spark):
    import hashlib

    row = spark.createDataFrame([("00123", dt.date(2018, 1, 2))], "i string, d date").select(tj.origin_seed(1, F.col("i"), F.col("d")).alias("s")).first()
    want = int.from_bytes(hashlib.sha256(b"1|00123|2018-01-02").digest()[:8], "little") % (2**63 - 1)
    assert row["s"] == want


def test_event_is_read_at_exit_not_at_confirmation(spark):
    path = np.array([0.45, 0.50, 0.501, 0.499] + [0.54] * 12)
    events, states = detect(path, np.array([0.5]))
    assert [(e["event_type"], e["entry_index"], e["output_index"], e["exit_index"]) for e in events] == [("HOVER", 1, 3, None), ("BREAKOUT", 1, 13, 4)]
    assert states[:4] == ["IDLE", "APPROACHING", "APPROACHING", "CONSOLIDATING"] and states[13] == "FINISHED"
    rows = spark.createDataFrame([(0, i, float(p), [0.5]) for i, p in enumerate(path)], "k int, step int, price double, levels array<double>")
    assert ev.unresolved(ev.traced(rows.where("step < 7"), ["k"]), ["k"], 6).first()["unresolved"] == 1
    assert ev.unresolved(ev.traced(rows, ["k"]), ["k"], 15).count() == 0


def stepwise(prices, levels, rules):
    """The same events by walking the steps one after the other."""
    side = lambda p, v: 1 if p - v > rules.tolerance else -1 if p - v < -rules.tolerance else 0
    out, i, n = [], 1, len(prices)
    while i < n:
        near = min((abs(prices[i] - v), v) for v in levels)
        if near[0] > rules.tolerance or side(prices[i - 1], near[1]) == 0:
            i += 1
            continue
        level, came, entry, inside, settled, j = near[1], side(prices[i - 1], near[1]), i, 1, None, i
        if rules.min_dwell == 1:
            settled = i
            out.append(("HOVER", entry, i))
        while True:
            j += 1
            if j >= n:
                return out
            if settled is not None and j >= settled + rules.max_dwell:
                out.append(("TIMEOUT", entry, settled + rules.max_dwell))
                i = settled + rules.max_dwell + 1
                break
            here = side(prices[j], level)
            if here == 0:
                inside += 1
                if settled is None and inside >= rules.min_dwell:
                    settled = j
                    out.append(("HOVER", entry, j))
                continue
            if settled is None and here != came:
                i = j
                break
            done = j + rules.confirmation - 1
            if settled is not None and settled + rules.max_dwell < n and done >= settled + rules.max_dwell:
                j = settled + rules.max_dwell - 1
                continue
            if done >= n:
                return out
            broken = next((k for k in range(j, done + 1) if side(prices[k], level) != here), None)
            if broken is None:
                out.append(("PULLBACK" if here == came else "BREAKOUT", entry, done))
                i = done + 1
                break
            if settled is None:
                i = broken
                break
            j = broken - 1
    return out


@pytest.mark.parametrize("rules", [ev.Rules(), ev.Rules(0.03, 1, 2, 5), ev.Rules(0.02, 2, 3, 8), ev.Rules(0.05, 3, 1, 3)])
def test_detector_against_a_stepwise_walk(rules):
    levels = np.array([0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0])
    rng = np.random.default_rng(1)
    for _ in range(300):
        path = np.round(np.cumsum(rng.normal(0, rng.choice([0.01, 0.03, 0.1]), rng.integers(1, 120))) + rng.random(), 4)
        events, _ = detect(path, levels, rules)
        assert [(e["event_type"], e["entry_index"], e["output_index"]) for e in events] == stepwise(path, levels, rules)


LEVELS = [0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0]
PATHS = "k int, step int, price double, levels array<double>"


def random_paths(seed, n, longest):
    rng = np.random.default_rng(seed)
    return [np.round(np.cumsum(rng.normal(0, rng.choice([0.01, 0.03, 0.1]), rng.integers(1, longest))) + rng.random(), 4) for _ in range(n)]


def by_path(traces):
    return {r["k"]: ([tuple(e) for e in r["event"]], list(r["state"])) for r in traces.collect()}


def plain(path, rules, levels=LEVELS):
    events, states = detect(path, np.array(levels), rules)
    names = [f.split()[0] for f in automaton.EVENT.split(", ")]
    return [tuple(e[n] for n in names) for e in events], states


@pytest.mark.parametrize("rules", [ev.Rules(), ev.Rules(0.03, 1, 2, 5), ev.Rules(0.02, 2, 3, 8), ev.Rules(0.05, 3, 1, 3), ev.Rules(0.04, 1, 1, 1)])
def test_fold_against_the_detector(spark, rules):
    paths = random_paths(7, 250, 140)
    rows = spark.createDataFrame([(k, i, float(p), LEVELS[::-1] + [0.5]) for k, path in enumerate(paths) for i, p in enumerate(path)], PATHS)
    found = by_path(ev.traced(rows, ["k"], rules))
    assert found == {k: plain(path, rules) for k, path in enumerate(paths)} and sum(len(e) for e, _ in found.values()) > 100


@pytest.mark.parametrize("rules", [ev.Rules(), ev.Rules(0.03, 1, 2, 5)])
def test_path_cut_anywhere_goes_on(spark, rules):
    rng = np.random.default_rng(5)
    paths = random_paths(8, 120, 120)
    cuts = [rng.integers(0, len(p) + 1) for p in paths]
    rows = spark.createDataFrame([(k, i, float(p), LEVELS) for k, path in enumerate(paths) for i, p in enumerate(path)], PATHS)
    cut = spark.createDataFrame([(k, int(c)) for k, c in enumerate(cuts)], "k int, cut int")
    both = rows.join(cut, "k")
    first = ev.traced(both.where("step < cut").drop("cut"), ["k"], rules).cache()
    second = ev.traced(both.where("step >= cut").drop("cut"), ["k"], rules, first)
    a, b = by_path(first), by_path(second)
    for k, path in enumerate(paths):
        events, states = plain(path, rules)
        assert a.get(k, ([], []))[0] + b.get(k, ([], []))[0] == events
        # Steps from an exit that was too late to be confirmed stay idle in the first part; all else is as in the whole.
        assert all(x in (y, "IDLE") for x, y in zip(a.get(k, ([], []))[1], states, strict=False)) and b.get(k, ([], []))[1] == states[cuts[k] :]


def test_path_of_10000_steps(spark):
    path = np.round(0.5 + 0.3 * np.sin(np.arange(10_000) / 60) + np.random.default_rng(2).normal(0, 0.004, 10_000), 4)
    rows = spark.createDataFrame([(0, i, float(p), LEVELS) for i, p in enumerate(path)], PATHS)
    found = by_path(ev.traced(rows, ["k"]))[0]
    assert found == plain(path, ev.Rules()) and len(found[0]) > 300


@pytest.mark.parametrize("horizon", [5, 30, 200])
def test_unresolved_entries_are_those_of_a_path_that_stands_still(spark, horizon):
    paths = random_paths(9, 200, 60)
    rows = spark.createDataFrame([(k, i, float(p), LEVELS) for k, path in enumerate(paths) for i, p in enumerate(path)], PATHS)
    want = {}
    for k, path in enumerate(paths):
        events, _ = detect(np.concatenate([path, np.repeat(path[-1], 33)]), np.array(LEVELS))
        late = {e["entry_index"] for e in events if e["entry_index"] <= horizon < e["output_index"]}
        late -= {e["entry_index"] for e in events if e["is_terminal"] and e["output_index"] <= horizon}
        if late:
            want[k] = len(late)
    found = {r["k"]: r["unresolved"] for r in ev.unresolved(ev.traced(rows, ["k"]), ["k"], horizon, pad=33).collect()}
    assert found == want and (len(want) > 5 or horizon == 200)


def test_events_run_in_the_jvm(spark):
    rows = spark.createDataFrame([(0, 0, 0.5, LEVELS)], PATHS)
    plan = ev.traced(rows, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    for bad in ([(0, 0, float("nan"), LEVELS)], [(0, 0, 0.1, [])], [(0, 0, 0.1, [float("inf")])]):
        with pytest.raises(Exception, match="finite"):
            ev.traced(spark.createDataFrame(bad, PATHS), ["k"]).collect()


def test_detector_rejects_bad_input():
    for bad in ([], [1.0, float("nan")]):
        with pytest.raises(ValueError):
            detect(np.array(bad), np.array([0.5]))
    with pytest.raises(ValueError):
        ev.Rules(min_dwell=5, max_dwell=2)


def test_faults_are_what_the_detector_rejects(spark):
    nan, inf = float("nan"), float("inf")
    paths = {"ok": ([0.1, None, 0.2], [0.5]), "gone": ([None], [0.5]), "nan": ([0.1, nan], [0.5]), "inf": ([-inf], [0.5])}
    paths |= {"none": ([0.1], None), "no": ([0.1], []), "hole": ([0.1], [0.5, None]), "odd": ([0.1], [inf])}
    rows = [(k, i, p, lv) for k, (ps, lv) in paths.items() for i, p in enumerate(ps)]
    found = {r["k"]: r for r in ev.path_faults(spark.createDataFrame(rows, "k string, step int, price double, levels array<double>"), ["k"]).collect()}
    assert {k: r["fault"] for k, r in found.items()} == {
        "ok": None, "gone": "empty", "nan": "price", "inf": "price", "none": "levels", "no": "levels", "hole": "levels", "odd": "levels"
    }
    assert (found["ok"]["n_steps"], found["ok"]["n_missing"]) == (2, 1)
    for k, (ps, lv) in paths.items():
        args = np.array([p for p in ps if p is not None], float), np.array(lv or [], float)
        if found[k]["fault"]:
            with pytest.raises(ValueError):
                detect(*args)
        else:
            detect(*args)


def test_segments_of_a_calendar(spark):
    rows = prices(spark, range(1500), "2016-01-01")
    found = cal.segment_origins(rows, 252, 100, "2018-01-01", "2020-12-31").orderBy("origin_pos").collect()
    pos = [r["origin_pos"] for r in found]
    assert pos[0] >= 251 and found[0]["origin_date"] >= dt.date(2018, 1, 1) and set(np.diff(pos)) == {100}
    assert cal.positions(rows).where(F.col("pos") == pos[-1] + 100).first()["date"] <= dt.date(2020, 12, 31)


def test_later_prices_leave_earlier_features_alone(spark):
    values = [100 + 5 * math.sin(i / 5) + i / 100 for i in range(400)]
    changed = values[:300] + [v * 1.5 for v in values[300:]]
    one, two = (fx.add_features(prices(spark, v).withColumn("vo_adj", F.lit(1.0)), ["CumRet1m", "Rsi14", "PctBb"]).orderBy("date").collect() for v in (values, changed))
    kept = [r for r in one if r["date"] <= one[0]["date"] + dt.timedelta(days=300)][:200]
    assert kept == two[: len(kept)]
    with pytest.raises(ValueError):
        fx.add_features(prices(spark, values), ["NoSuchFeature"])


def test_nearest_day_prefers_the_later_one(spark):
    rows = prices(spark, [1, 2, 3], "2020-01-06").where("day(date) <> 7")
    asks = spark.createDataFrame([("a", dt.date(2020, 1, 7)), ("a", None), ("a", dt.date(2019, 1, 1)), ("b", dt.date(2020, 1, 6))], "issue_id string, asked date")
    out = {(r["issue_id"], r["asked"]): r["date_used"] for r in jn.nearest_day(asks, rows).collect()}
    assert out["a", dt.date(2020, 1, 7)] == dt.date(2020, 1, 8) == out["a", None] and out["a", dt.date(2019, 1, 1)] == dt.date(2020, 1, 6) and out["b", dt.date(2020, 1, 6)] is None


def test_guards_raise(spark):
    rows = prices(spark, [1, 2, 3])
    with pytest.raises(ValueError):
        jn.many_to_one(rows, rows, ["issue_id"])
    with pytest.raises(ValueError):
        jn.one_sample(rows, "a", "1999-01-01")
    with pytest.raises(ValueError):
        nm.by_group(rows, "cl_adj_loc", "issue_id", "v", "other")
    with pytest.raises(ValueError, match="cl_adj_loc"):
        st.user_frame(rows.drop("cl_adj_loc"))
    with pytest.raises(FileNotFoundError):
        st.market_tables(spark, "/no/such/folder")
    with pytest.raises(ValueError):
        st.load(spark, "nowhere", "nothing", "x")


def test_balances_and_quotas(spark):
    rows = spark.createDataFrame([(i, i % 3, i % 4 == 0) for i in range(200)], "k int, label int, synthetic boolean")
    counts = {r["count"] for r in sm.balanced(rows, "label", ["k"], 1).groupBy("label").count().collect()}
    assert counts == {66}
    assert sm.synthetic_quotas(60_000, 3, 25) == (20_000, 5_000) and sm.synthetic_quotas(10, 2, 0.5) == (5, 2)
    with pytest.raises(ValueError):
        sm.synthetic_share_balance(rows, "label", "synthetic", ["k"], 300, 0.9, 1)
    filled = sm.balanced_bins(rows.withColumn("b", (F.col("k") < 5).cast("int")), "b", ["k"], 20, 1)
    assert {r["count"] for r in filled.groupBy("b").count().collect()} == {20}
    ranks = sm.ranked_in_buckets(rows, sm.hash_order(1, "k"), ["k"]).select("rank").collect()
    assert sorted(r["rank"] for r in ranks) == list(range(1, 201))


def test_binary_metrics_of_nothing_are_zero(spark):
    out = mt.binary(spark.createDataFrame([], "t int, p int"), "t", "p").first()
    assert (out["tp"], out["accuracy"], out["fpr"], out["fnr"]) == (0, 0.0, 0.0, 0.0)


def test_results_do_not_depend_on_partitions(spark):
    if not os.path.isdir(TINY):
        pytest.skip("no test tables")
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append({name: sorted(map(str, registry.QUERIES[name](spark, TINY).collect())) for name in ("i03_random_row_split", "l09_trajectory_comparison")})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


def _plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_plain, v)) + "]"
    return str(int(v)) if hasattr(v, "as_tuple") and v == int(v) else str(v)


@pytest.mark.parametrize("name", ["flagship_labels_by_sector", "b16_student_export", "c03_nearest_trading_day", "e05_hurst", "h11_trend_label_row", "i10_stratified_sample", "k05_distance_bands", "l14_dwell_summary", "n12_signed_rank_test", "p14_correctness_autocorrelation"])
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(TINY):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    df = registry.QUERIES[name](spark, TINY)
    cols = sorted(df.columns)
    rel = con.sql(registry.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    ours = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    assert ours == sorted(tuple(_plain(r[i]) for i in at) for r in rel.fetchall()) and ours


def test_every_oracle_belongs_to_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_user_functions(spark):
    rows = prices(spark, [float(v) for v in (3, 1, 2, 5, 4, 6)], "2020-01-01")
    value = [c for c in rows.columns if c not in ("issue_id", "date")][0]
    low = uf.grouped_map(rows, lambda pdf: pdf.assign(low=pdf[value].cummin())[["issue_id", "date", "low"]], "issue_id string, date date, low double").orderBy("date").collect()
    assert [r["low"] for r in low] == [3, 1, 1, 1, 1, 1]
    out = uf.rolling_map(rows, value, "named", 3, "range")
    out = uf.rolling_map(out, value, "own", 3, lambda x: F.array_max(x))
    out = uf.rolling_python(out, value, "python", 3, lambda x: float(min(x))).orderBy("date").collect()
    assert [(r["named"], r["own"], r["python"]) for r in out] == [(None, None, None)] * 2 + [(2, 3, 1), (4, 5, 1), (3, 5, 2), (2, 6, 4)]
    with pytest.raises(ValueError, match="unknown kernel"):
        uf.rolling_map(rows, value, "v", 3, "nothing")
    found = uf.balanced_by(rows, value, lambda v: F.when(v < 6, F.floor(v / 3).cast("int")), ["issue_id", "date"], 4, 1)
    assert {r["bin"]: r["count"] for r in found.groupBy("bin").count().collect()} == {0: 4, 1: 4}
    paths = rows.select("issue_id", F.dayofmonth("date").alias("step"), F.col(value).alias("price"))
    uf.table_function(spark, "rises", lambda pdf: pdf[pdf["price"].diff() > 0][["step"]], {"issue_id": "string"}, "step int")
    assert spark.sql("SELECT * FROM rises(TABLE(SELECT * FROM {paths}) PARTITION BY issue_id ORDER BY step)", paths=paths).count() == 3


def test_numbers_without_one_task(spark):
    ids = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("issue_id")).repartition(7)
    found = sm.numbered(ids, "issue_id").orderBy("_n").collect()
    assert [r["_n"] for r in found] == list(range(1, 1001)) and {r["_all"] for r in found} == {1000}
    assert [r["issue_id"] for r in found] == sorted(r["issue_id"] for r in found)
    rows = spark.range(500).select("id", (F.col("id") % 10 == 0).alias("g"))
    ranked = sm.ranked_in_buckets(rows, F.md5(F.col("id").cast("string")), ["id"], ("g",), "r", "n").collect()
    assert sorted(r["r"] for r in ranked if r["g"]) == list(range(1, 51)) and {(r["g"], r["n"]) for r in ranked} == {(True, 50), (False, 450)}


def test_mean_correlations_against_pandas(spark):
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(size=(9, 40)), axis=1)
    x[2, :5] = np.nan
    x[5] = 3.0
    rows = [(str(i), [None if np.isnan(v) else float(v) for v in own]) for i, own in enumerate(x)]
    c = pd.DataFrame(x.T).corr().abs().to_numpy()
    np.fill_diagonal(c, np.nan)
    for block in (64, 2):
        found = {int(r["issue_id"]): r["mean_abs_corr"] for r in sm.mean_correlations(spark.createDataFrame(rows, "issue_id string, x array<double>"), block).collect()}
        assert set(found) == set(range(9)) - {5} and all(abs(found[i] - np.nanmean(c[i])) < 1e-9 for i in found)


@pytest.mark.parametrize("block", [None, 3, 1])
def test_pair_correlations_against_pandas(spark, block):
    rng = np.random.default_rng(4)
    x = np.cumsum(rng.normal(size=(11, 30)), axis=1)
    x[2, :28] = np.nan
    x[3, 2:] = np.nan
    x[5] = 3.0
    x[7] = np.nan
    rows = [(f"s{i}", [None if np.isnan(v) else float(v) for v in own]) for i, own in enumerate(x)]
    found = {(r["id_a"], r["id_b"]): (r["n"], r["c"]) for r in sm.pair_correlations(spark.createDataFrame(rows, "issue_id string, x array<double>"), block).collect()}
    want = {}
    for i in range(11):
        for j in range(11):
            both = np.isfinite(x[i]) & np.isfinite(x[j])
            if f"s{i}" < f"s{j}" and both.any():
                a, b = x[i][both], x[j][both]
                want[f"s{i}", f"s{j}"] = both.sum(), np.corrcoef(a, b)[0, 1] if len(a) > 1 and a.std() > 1e-12 and b.std() > 1e-12 else None
    assert set(found) == set(want)
    for key, (n, c) in want.items():
        assert found[key][0] == n and (found[key][1] is None if c is None else abs(found[key][1] - c) < 1e-9)


def test_block_sizes_follow_bytes_and_tasks(spark):
    series = spark.range(5000).select(F.col("id").cast("string").alias("issue_id"), F.array_repeat(F.lit(1.0), 10).alias("x"))
    blocks = sm._block_pairs(series, None).agg(F.max("own")).first()[0] + 1
    assert blocks == -(-5000 // max(64, math.ceil(5000 / math.sqrt(8))))
    assert sm._block_pairs(series, 2000).count() == 5000 * 3


def test_signed_rank_tails_are_exact(spark):
    from itertools import product

    rows = [(n, float(w)) for n in (1, 4, 7) for w in range(n * (n + 1) // 2 + 1)]
    table = spark.createDataFrame(rows, "n long, w double").withColumn("p", pt.signed_rank_tail(F.col("n"), F.col("w")))
    for r in table.collect():
        sums = [sum(i + 1 for i, s in enumerate(signs) if s) for signs in product((0, 1), repeat=r["n"])]
        assert math.isclose(r["p"], sum(s >= r["w"] for s in sums) / len(sums))
