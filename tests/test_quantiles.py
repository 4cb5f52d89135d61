"""Exact quantiles and running totals against sorting."""

from __future__ import annotations

import numpy as np
import pytest

from pricepanel.operators import quantiles as qt

LEVELS = {"low": 0.025, "q1": 0.25, "half": 0.5, "top": 1.0, "bottom": 0.0, "high": 0.975}


def rows(seed):
    rng = np.random.default_rng(seed)
    out = [("hot", 1, float(x)) for x in np.round(rng.normal(0, 1, 3000), 3)]
    out += [("same", 1, 2.5)] * 700 + [("far", 2, float(x)) for x in np.exp(rng.normal(0, 12, 900))] + [("one", 3, -1.0), ("two", 3, 1.0), ("two", 3, 2.0)]
    out += [(None, None, float(x)) for x in range(50)] + [("none", 9, None), ("hot", 1, None), ("few", 1, 0.0), ("few", 1, 1e300), ("few", 1, -1e300)]
    return out


@pytest.mark.parametrize(("bins", "whole"), [(4096, 50_000), (16, 3), (64, 20)])
def test_quantiles_against_sorting(spark, bins, whole):
    own = rows(bins)
    df = spark.createDataFrame(own, "g string, h int, x double").repartition(5)
    found = {(r["g"], r["h"]): r for r in qt.exact_quantiles(df, ["g", "h"], "x", LEVELS, bins, whole).collect()}
    groups = {}
    for g, h, x in own:
        if x is not None:
            groups.setdefault((g, h), []).append(x)
    assert set(found) == set(groups)
    for key, values in groups.items():
        for name, q in LEVELS.items():
            assert np.isclose(found[key][name], np.quantile(values, q), rtol=1e-12, atol=1e-12), (key, name)


def test_quantiles_of_all_rows_and_of_none(spark):
    df = spark.createDataFrame([(float(x),) for x in range(101)], "x double")
    assert tuple(qt.exact_quantiles(df, [], "x", {"a": 0.05, "b": 0.5}, 4, 5).first()) == (5.0, 50.0)
    assert qt.exact_quantiles(df.limit(0), [], "x", {"a": 0.5}).count() == 0


def test_running_totals(spark):
    own = [("a", float(i), i % 5) for i in range(300)] + [(None, 1.0, 7), (None, 0.5, 1), ("b", 2.0, 3)]
    df = spark.createDataFrame(own, "g string, x double, n long").repartition(6)
    found = {(r["g"], r["x"]): r["up"] for r in qt.running_total(df, ["g"], "x", "n", "up").collect()}
    assert found == {(g, x): sum(n for g2, x2, n in own if g2 == g and x2 <= x) for g, x, n in own}
    plan = qt.running_total(df, ["g"], "x", "n", "up")._jdf.queryExecution().executedPlan().toString()
    assert "Window [sum(n" in plan and "_p" in plan
