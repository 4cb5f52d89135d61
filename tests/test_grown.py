"""Queries on tables that are larger or have larger keys than the smallest ones, against their SQL."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricepanel.functions.expressions import rounded
from pricepanel.operators import models as md
from pricepanel.operators import normalise as nm
from pricepanel.operators import sampling as sm
from pricepanel.operators import trend as tr
from pricepanel.operators import windows as wn
from pricepanel.operators.metrics import confusion
from pricepanel.plans import load, registry, source_queries, user_queries
from pricepanel.plans.trend_queries import FIT
from pricepanel.sources import tables
from test_panel import TABLES, TINY, _plain

load()


def matches(spark, name: str, folder: str) -> None:
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df, rel = registry.QUERIES[name](spark, folder), con.sql(registry.ORACLE_SQL[name])
    cols = sorted(df.columns)
    at = [rel.columns.index(c) for c in cols]
    ours = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    assert ours == sorted(tuple(_plain(r[i]) for i in at) for r in rel.fetchall()) and ours


@pytest.fixture
def shifted(tmp_path):
    """The smallest tables with suppliers from 9998 on."""
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(TINY):
        pytest.skip("no test tables")
    for t, key in (("supplier", "s_suppkey"), ("lineitem", "l_suppkey"), ("nation", None), ("region", None)):
        more = f" REPLACE ({key} + 9998 AS {key})" if key else ""
        duckdb.sql(f"COPY (SELECT *{more} FROM '{TINY}/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    return str(tmp_path)


def test_ids_of_more_than_four_digits(spark, shifted):
    matches(spark, "b17_synthetic_ids", shifted)


def test_peaks_of_all_months_of_a_security():
    """A frame has a security's months; a step's neighbours are those of its own month."""
    months = [(2020, 1, [1.0, 3.0, 2.0, 9.0]), (2020, 2, [1.0, 2.0]), (2021, 2, [9.0, 1.0, 2.0, 1.0]), (2021, 3, [5.0])]
    rows = [(y, m, s + 1, p) for y, m, prices in months for s, p in enumerate(prices)]
    found = user_queries.peaks(pd.DataFrame(rows, columns=["year", "month", "step", "price"]))
    assert list(found.itertuples(index=False, name=None)) == [(2020, 1, 2, 3.0), (2021, 2, 3, 2.0)]
    assert not len(user_queries.peaks(pd.DataFrame(rows[-1:], columns=["year", "month", "step", "price"])))
    assert not len(user_queries.peaks(pd.DataFrame(rows[:2], columns=["year", "month", "step", "price"])))


def test_table_function_over_securities(spark):
    matches(spark, "u06_table_function", TINY)


def test_hurst_takes_a_mean_once_for_a_window(spark):
    """A filter on the result is pushed through the columns before it; it must not carry the mean into the fold's steps."""
    plan = registry.QUERIES["e05_hurst"](spark, TINY)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") <= 4  # a mean and a fold, in the result and in its filter


def test_normalisers_take_a_window_s_sums_once(spark):
    """Ends, mean and deviation are no part of a lambda over the elements, where each element would take them again."""
    x = [1.0, 5.0, 3.0, 2.0]
    rows = spark.createDataFrame([(x,)], "x array<double>").select(nm.sample_minmax(F.col("x")).alias("m"), nm.sample_zscore(F.col("x")).alias("z"))
    found = rows.first()
    assert np.allclose(found["m"], (np.array(x) - 1) / (4 + 1e-6)) and np.allclose(found["z"], (np.array(x) - np.mean(x)) / (np.std(x) + 1e-6))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_min") == 1 and plan.count("aggregate(") == 2


def test_runs_of_the_classifier_normalise_once(spark):
    """Runs by seed read written vectors, and tell what single fits on the arrays tell."""
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist(), i % 3) for i in range(60)], "k int, features array<double>, label int")
    runs = md.repeated(rows, rows, [4, 5, 3], [1, 2], 3)
    assert "array_min" not in runs._jdf.queryExecution().optimizedPlan().toString()
    by = {s: {r["k"]: r for r in runs.where(F.col("run") == s).collect()} for s in (1, 2)}
    for s in (1, 2):
        alone = md.train_and_score(rows, rows, [4, 5, 3], s, 3).collect()
        assert len(alone) == len(by[s]) == 60 and all(np.allclose([r[f"p{i}"] for i in range(3)], [by[s][r["k"]][f"p{i}"] for i in range(3)], atol=1e-6) for r in alone)


def test_strided_fit_is_one_fold(spark):
    rows = spark.createDataFrame([([1.0, 9.0, 3.0, 9.0, 4.0, 9.0],)], "x array<double>").select(tr.strided_fit(F.col("x"), 2).alias("f"))
    found = rows.first()["f"]
    slope, intercept = np.polyfit([0, 1, 2], [1, 3, 4], 1)
    assert np.allclose([found["slope"], found["intercept"], found["n"]], [slope, intercept, 3])
    assert np.isclose(found["sigma"], np.sqrt(np.mean((np.array([1, 3, 4]) - intercept - slope * np.arange(3)) ** 2)))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_coverage_and_instability(spark):
    matches(spark, "h12_coverage_and_instability", TINY)


def test_wide_files_of_absent_cells(spark, tmp_path):
    """A file for each year has its own header, and a line a cell for each id, absent ones too; no cell is looked up in a map."""
    rows = [("10", "2020-01-02", "1.5"), ("9", "2020-01-02", "2.5"), ("11", "2020-01-03", "3.5"), ("10", "2021-05-03", "4.5")]
    at = str(tmp_path / "wide")
    source_queries._wide_files(spark.createDataFrame(rows, "issue_id string, day string, text string").selectExpr("issue_id", "to_date(day) AS date", "text"), at)
    lines = {y: [r[0] for r in spark.read.text(f"{at}/year={y}").collect()] for y in (2020, 2021)}
    head = "Datetime,Close_10,Close_11,Close_9"
    assert lines == {2020: [head, "2020-01-02,1.5,,2.5", "2020-01-03,,3.5,"], 2021: [head, "2021-05-03,4.5,,"]}
    found = tables.wide_lines_to_panel(spark, at).collect()
    assert sorted((r["issue_id"], str(r["date"]), str(r["cl_adj_loc"])) for r in found) == sorted(rows)


def test_wide_to_panel(spark):
    matches(spark, "a04_wide_to_panel", TINY)


def test_extremes_of_the_last_rows(spark):
    """Extremes by spans that double are those of the last rows, nulls left out; no frame slides over the rows."""
    rng = np.random.default_rng(3)
    values = {s: [None if rng.random() < 0.1 else float(rng.integers(50)) for _ in range(n)] for s, n in (("a", 40), ("b", 7), ("c", 1))}
    rows = spark.createDataFrame([(s, i, v) for s, vs in values.items() for i, v in enumerate(vs)], "issue_id string, date int, x double")
    for k in (1, 2, 3, 8, 21):
        found = wn.rolling_extremes(rows, "x", k)
        for r in found.collect():
            own = [v for v in values[r["issue_id"]][max(0, r["date"] + 1 - k) : r["date"] + 1] if v is not None]
            assert (r["lo"], r["hi"], r["_n"]) == (min(own, default=None), max(own, default=None), len(own))
    plan = wn.window_range(rows, "x", 21)._jdf.queryExecution().optimizedPlan().toString()
    assert "min(" not in plan and "-20, currentrow" not in plan


def test_fit_of_variance_and_covariance(spark):
    """A fit far from a security's first row is that of its own window, and takes no more than one covariance."""
    prices = [100 + 0.3 * i + (i * 7 % 5) for i in range(400)]
    rows = tr.fits(spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(prices)], "issue_id string, date int, x double"), "x", 21, 5)
    for r in rows.where("test_date in (20, 200, 394)").collect():
        own = np.array(prices[r["test_date"] - 20 : r["test_date"] + 1])
        slope, intercept = np.polyfit(np.arange(21), own, 1)
        sigma = np.sqrt(np.mean((own - intercept - slope * np.arange(21)) ** 2))
        assert np.allclose([r["slope"], r["intercept"], r["sigma"], r["lo"], r["hi"]], [slope, intercept, sigma, own.min(), own.max()])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "regr_" not in plan and "regr" not in plan.lower()


def test_pairs_travel_as_the_values_they_have(spark):
    """A series has no cells for the days it lacks, before pairs and in them, and parts of a block make the same pairs as whole ones."""
    rows = [(s, d, float(s * d % 7 + d)) for s in range(40) for d in range(60) if (s + d) % 4 == 0]
    prices = spark.createDataFrame([(str(s), d, x) for s, d, x in rows], "issue_id string, date int, x double")
    series = sm.calendar_series(prices, "x")
    assert {r["issue_id"]: list(r["at"]) for r in series.collect()} == {str(s): [d for d in range(60) if (s + d) % 4 == 0] for s in range(40)}
    assert series.select(F.max(F.size("x"))).first()[0] == 15
    whole = {(r["id_a"], r["id_b"]): (r["n"], round(r["c"], 9)) for r in sm.pair_correlations(series).collect()}
    wide = pd.DataFrame(rows, columns=["s", "d", "x"]).pivot(index="d", columns="s", values="x")
    want = wide.corr(min_periods=2).stack()
    assert len(whole) == 4 * (10 * 9 // 2) and all(a < b and n == 15 and abs(c - want[int(a), int(b)]) < 1e-8 for (a, b), (n, c) in whole.items())
    part, sm.PART = sm.PART, 6
    try:
        for block in (None, 15):
            assert {(r["id_a"], r["id_b"]): (r["n"], round(r["c"], 9)) for r in sm.pair_correlations(series, block).collect()} == whole
    finally:
        sm.PART = part


def test_classifier_rows_come_from_one_pass(spark):
    """Windows and labels are those of the joined passes; training and held-out rows read one written table and no lines."""
    from pricepanel.operators.panel import panel
    from pricepanel.plans.trend_queries import samples

    keys = ["issue_id", "test_date"]
    train, test = source_queries._classified(spark, TINY)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (train, test)]
    assert not any("l_suppkey" in p or "collect_list" in p for p in plans)
    joined = wn.train_test_windows(panel(spark, TINY), "cl_adj_loc", 21, 5).join(samples(spark, TINY), keys).select(*keys, F.col("train").alias("features"), "label")
    late = joined.where("test_date > date '1998-12-31'")
    assert test.count() == late.count() > 0 and test.exceptAll(late).isEmpty()
    early = sm.balanced(joined.where("test_date <= date '1998-12-31'"), "label", keys, 7)
    assert train.count() == early.count() > 0 and train.select(*keys, "features", "label").exceptAll(early.select(*keys, "features", "label")).isEmpty()


def test_windows_are_normalised_by_their_frames(spark):
    """A window's ends, mean and deviation are taken by the frame that makes it; rounding makes no decimals and takes halves away from zero."""
    values = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 6.0, 6.0, 6.0]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "issue_id string, date int, x double")
    found = nm.windows_normalised(rows, {"m": ("x", "group_minmax"), "z": ("x", "sample_zscore"), "w": ("x", None)}, 4)
    got = found.collect()
    assert [r["date"] for r in sorted(got, key=lambda r: r["date"])] == list(range(3, 11))
    for r in got:
        own = np.array(values[r["date"] - 3 : r["date"] + 1])
        assert list(r["w"]) == list(own) and np.allclose(r["m"], (own - own.min()) / (np.ptp(own) + 1e-6)) and np.allclose(r["z"], (own - own.mean()) / (own.std() + 1e-6))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "array_min" not in plan
    halves = spark.createDataFrame([([0.125, -0.125, -0.001, 0.126, -3.0],)], "x array<double>").select(F.transform("x", lambda v: rounded(v, 2)).alias("x"))
    assert str(halves.first()["x"]) == "[0.13, -0.13, 0.0, 0.13, -3.0]" and "round(" not in halves._jdf.queryExecution().optimizedPlan().toString()


def test_group_variants(spark):
    matches(spark, "f06_group_variants", TINY)


def test_prices_on_their_line_as_in_sql(spark):
    """A first test price that lies on the fitted line has a margin of exactly 1 or just below it, by the last bits of the fit. Sums and line run as the
    SQL's, so both tell nearly all alike; where the SQL engine merges or fuses its sums, the bits are its own."""
    duckdb = pytest.importorskip("duckdb")
    rng, weights, rows = np.random.default_rng(4), 10 + 3 * np.arange(-10, 11), []
    y = np.round(1e6 * np.exp(rng.integers(-5, 6, 2000).cumsum() / 200)).astype(int)
    starts = [k + int(rng.integers(8, 11)) for k in range(0, 1950, 32)]  # the SQL engine merges no sums in these
    for s in starts:
        y[s + 7] -= int(weights @ y[s : s + 21]) % 210  # that price has weight 1 of 210 in the line's next value
        y[s + 21] = int(weights @ y[s : s + 21]) // 210
    days = pd.date_range("1995-01-01", periods=len(y)).date
    px = pd.DataFrame({"issue_id": "1", "date": days, "cl_adj_loc": y / 1e4})  # noqa: F841
    con = duckdb.connect()
    con.execute("CREATE TABLE px AS SELECT issue_id, date::DATE AS date, cl_adj_loc FROM px")
    sql = "WITH panel AS (SELECT * FROM px), " + FIT[FIT.index("ps AS (SELECT") :]
    theirs = dict(con.sql(f"{sql} SELECT test_date, margin FROM samples").fetchall())
    ours = {r["test_date"]: r["margin"] for r in tr.trend_samples(spark.createDataFrame(px), "cl_adj_loc", 21, 5).select("test_date", "margin").collect()}
    ties = [days[s + 20] for s in starts]
    assert ours.keys() == theirs.keys() and all(ours[t] > 1 - 1e-12 for t in ties)
    assert {theirs[t] < 1 for t in ties} == {True, False} and sum((ours[t] < 1) == (theirs[t] < 1) for t in ties) >= 0.9 * len(ties)


def _windows(spark, n=256):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 6)).cumsum(axis=1)
    y = (x[:, -1] > x[:, 0]).astype(int) + (x[:, 3] > x[:, 1])
    return spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "k int, features array<double>, label int").coalesce(1)


@pytest.mark.parametrize("iterations", [1, 20])
def test_fits_are_spark_s_perceptron(spark, iterations):
    """Passes shared by the runs end at the weights of Spark ML's own fits (whose blocks of 128 rows are full here)."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = _windows(spark)
    vectors = rows.select("k", array_to_vector(nm.sample_minmax(F.col("features"))).alias("x"), F.col("label").cast("double").alias("y"))
    found = md.repeated(rows, rows, [6, 5, 4, 3], [1, 2, 3], iterations)
    for seed in (1, 2, 3):
        net = MultilayerPerceptronClassifier(layers=[6, 5, 4, 3], seed=seed, maxIter=iterations, featuresCol="x", labelCol="y")
        theirs = {r["k"]: (list(r["p"]), r["prediction"]) for r in net.fit(vectors).transform(vectors).select("k", vector_to_array("probability").alias("p"), "prediction").collect()}
        ours = {r["k"]: ([r[f"p{i}"] for i in range(3)], r["y_hat"]) for r in found.where(F.col("run") == seed).collect()}
        assert ours.keys() == theirs.keys() and all(np.allclose(ours[k][0], theirs[k][0], atol=1e-6) for k in ours)
        assert sum(ours[k][1] != theirs[k][1] for k in ours) <= 1


def test_runs_share_their_passes(spark, monkeypatch):
    """Ten runs read the rows no more often than the slowest of them alone, and confusion reads the scored rows once."""
    passes, one_pass = [], md._losses
    monkeypatch.setattr(md, "_losses", lambda train, layers, points: passes.append(len(points)) or one_pass(train, layers, points))
    rows, alone = _windows(spark), []
    for seed in range(1, 5):
        md.repeated(rows, rows, [6, 5, 3], [seed], 4)
        alone.append(len(passes))
        passes.clear()
    runs = md.repeated(rows, rows, [6, 5, 3], [1, 2, 3, 4], 4)
    assert len(passes) == max(alone) and sum(passes) == sum(alone)
    table = confusion(runs, "label", "y_hat", 3, ("run",))
    assert "MapInArrow" not in table._jdf.queryExecution().optimizedPlan().toString()
    assert table.count() == 36 and table.agg(F.sum("n")).first()[0] == 4 * 256


def test_series_travel_once_for_all_their_pairs(spark):
    """Blocks meet without a shuffle of pairs: a series is in one block, however many blocks there are, and none is copied for each of them."""
    rows = [(str(s), d, float(s * d % 7 + d)) for s in range(40) for d in range(20)]
    series = sm.calendar_series(spark.createDataFrame(rows, "issue_id string, date int, x double"), "x")
    blocks = sm._blocks(series, 4)
    assert blocks.count() > 5 and blocks.agg(F.sum(F.size("series"))).first()[0] == 40
    pairs = sm.pair_correlations(series, 4)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "FlatMapGroups" not in plan and pairs.count() == 40 * 39 // 2
