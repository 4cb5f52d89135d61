"""Bootstraps against their formulas in numpy: sign, support, medians, counts and nulls."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricepanel.operators import bootstrap as bs
from pricepanel.operators import gates as gt
from pricepanel.operators import trajectory as tj

SEED, REPLICATES = 3, 200


def weight_matrix(spark, ids):
    """Replicates by securities, from the draws as rows."""
    rows = gt.bootstrap_weights(spark.createDataFrame([(i,) for i in ids], "issue_id string"), REPLICATES, SEED).collect()
    out, place = np.zeros((REPLICATES, len(ids))), {i: k for k, i in enumerate(sorted(ids))}
    for r in rows:
        out[r["replicate"], place[r["issue_id"]]] = r["weight"]
    assert (out.sum(axis=1) == len(ids)).all()
    return out


def test_draws_are_not_broadcast(spark):
    """The draws are replicates times as many as the securities that the plan's sizes are guessed from."""
    rows = gt.bootstrap_weights(spark.createDataFrame([(f"s{i:02d}",) for i in range(40)], "issue_id string"), REPLICATES, SEED)
    joins = [line for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "_n#" in line]
    assert joins and all("shuffle_hash" in line for line in joins)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 1


def same(a, b):
    return a is None and b is None or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize("block", [1024, 7])
def test_products_of_blocks_against_a_matrix(spark, monkeypatch, block):
    monkeypatch.setattr(bs, "BLOCK", block)
    monkeypatch.setattr(bs, "CELLS", 3)
    monkeypatch.setattr(bs, "DRAWS", 5)
    rng = np.random.default_rng(1)
    ids = [f"s{i:02d}" for i in range(40)]
    cells = [(i, int(c), k, float(rng.normal()), None if rng.random() < 0.1 else float(rng.random())) for i in ids for c in range(5) for k in ("x", None) if rng.random() < 0.6]
    found = bs.resampled(spark.createDataFrame(cells, "issue_id string, cell int, kind string, a double, b double"), ["cell", "kind"], ["a", "b"], REPLICATES, SEED).collect()
    used = sorted({c[0] for c in cells})
    w = weight_matrix(spark, used)
    assert {(r["cell"], r["kind"]) for r in found} == {c[1:3] for c in cells}
    for r in found:
        sums = np.zeros((len(used), 2))
        for i, c, k, a, b in cells:
            if (c, k) == (r["cell"], r["kind"]):
                sums[used.index(i)] = a, b or 0.0
        assert np.allclose(r["a"], w @ sums[:, 0]) and np.allclose(r["b"], w @ sums[:, 1])
    assert bs.resampled(spark.createDataFrame([], "issue_id string, cell int, a double"), ["cell"], ["a"], 10, 1).count() == 0


def test_bands_against_the_formula(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(30):
        for _ in range(rng.integers(1, 60)):
            p = rng.dirichlet([1, 2, 3])
            rows.append((f"s{i:02d}", float(rng.normal()), int(rng.integers(0, 7)), *map(float, p)))
    frame = pd.DataFrame(rows, columns=["issue_id", "distance", "nearest_level", *gt.P])
    found = {(r["level"], r["distance_bin"]): r for r in gt.distance_bands(spark.createDataFrame(frame), REPLICATES, SEED).collect()}
    ids = sorted(frame.issue_id.unique())
    w = weight_matrix(spark, ids)
    edges = np.linspace(frame.distance.min(), frame.distance.max(), 21)
    frame["bin"] = np.clip(np.searchsorted(edges, frame.distance, side="right") - 1, 0, 19)
    assert len(found) == 160
    some = 0
    for level in (-1, *range(7)):
        own = frame if level < 0 else frame[frame.nearest_level == level]
        for b in range(20):
            part, r = own[own.bin == b], found[level, b]
            count = part.groupby("issue_id").size().reindex(ids).fillna(0).to_numpy()
            supported = len(part) >= 30 and (count > 0).sum() >= 5
            valid = w @ count > 0
            assert (r["n"], r["stocks"], r["supported"], r["replicates"]) == (len(part), (count > 0).sum(), supported, valid.sum())
            for c in gt.P:
                sums = part.groupby("issue_id")[c].sum().reindex(ids).fillna(0).to_numpy()
                low, high = np.quantile((w @ sums)[valid] / (w @ count)[valid], [0.025, 0.975]) if supported else (None, None)
                assert same(r[f"{c}_lo"], low) and same(r[f"{c}_hi"], high)
                some += supported
    assert some > 20


def trajectories(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(60):
        stock = f"s{s % 12:02d}"
        for source, n in (("real", 1), ("synthetic", int(rng.integers(1, 5)))):
            for path in range(n):
                counts = rng.integers(0, 4, 9) * (rng.random(9) < (0.9 if source == "real" else 0.5))
                counts[6:] = counts[6:] * (s % 12 < 3)  # the last state has too few stocks
                rows.append((f"g{s}", stock, source, path, 1 / n, float(rng.normal()), None if rng.random() < 0.2 else float(rng.random()), *map(int, counts)))
    names = [*tj.PATH, "weight", "m1", "m2", *(f"t_{a}{b}" for a in range(3) for b in range(3))]
    return pd.DataFrame(rows, columns=names)


def test_comparison_against_the_formula(spark):
    frame = trajectories(5)
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), "segment_id string, issue_id string, source string, path_id long, weight double, m1 double, m2 double, " + ", ".join(f"t_{a}{b} long" for a in range(3) for b in range(3)))
    found = {(r["metric"], r["source"]): r for r in tj.compared(df.drop(*(c for c in df.columns if c[:2] == "t_")), REPLICATES, SEED, ("m1", "m2")).collect()}
    ids = sorted(frame.issue_id.unique())
    w = weight_matrix(spark, ids)
    for m in ("m1", "m2"):
        draws, mean = {}, {}
        for source in tj.SOURCES:
            own = frame[frame.source == source]
            bottom = own.groupby("issue_id").weight.sum().reindex(ids).to_numpy()
            top = (own[m] * own.weight).groupby(own.issue_id).sum().reindex(ids).to_numpy()
            draws[source], mean[source] = (w @ top) / (w @ bottom), top.sum() / bottom.sum()
            r = found[m, source]
            values = own[own[m].notna()].sort_values(m)
            median = values[m].to_numpy()[np.searchsorted(values.weight.cumsum(), 0.5 * values.weight.sum() - 1e-9)]
            low, high = np.quantile(draws[source], [0.025, 0.975])
            assert all(map(same, (r["estimate"], r["lo"], r["hi"], r["median"]), (mean[source], low, high, median)))
            assert (r["trajectories"], r["origins"], r["stocks"], r["replicates"]) == (len(own), own.segment_id.nunique(), len(ids), REPLICATES)
        r, gap = found[m, tj.GAP], draws["synthetic"] - draws["real"]
        assert all(map(same, (r["estimate"], r["lo"], r["hi"], r["median"]), (mean["synthetic"] - mean["real"], *np.quantile(gap, [0.025, 0.975]), None)))
        assert (r["trajectories"], r["origins"], r["stocks"]) == (None, 60, len(ids))


def test_transition_comparison_against_the_formula(spark):
    frame = trajectories(6)
    df = spark.createDataFrame(frame.drop(columns=["m1", "m2"]))
    counts = df.drop("weight")
    found = {(r["source"], r["from"], r["to"]): r for r in tj.compared_transitions(counts, df.select(*tj.PATH, "weight"), REPLICATES, SEED).collect()}
    ids = sorted(frame.issue_id.unique())
    w = weight_matrix(spark, ids)
    kept = set()
    for a in range(3):
        draws, said = {}, {}
        for source in tj.SOURCES:
            own = frame[frame.source == source]
            by = {b: (own[f"t_{a}{b}"] * own.weight).groupby(own.issue_id).sum().reindex(ids).to_numpy() for b in range(3)}
            bottom = sum(by.values())
            raw, stocks = int(own[[f"t_{a}{b}" for b in range(3)]].sum().sum()), int((bottom > 0).sum())
            said[source] = supported = raw >= 30 and stocks >= 5, stocks
            for b in range(3):
                r, ok = found[source, a, b], w @ bottom > 0
                draws[source, b] = np.divide(w @ by[b], w @ bottom, out=np.full(REPLICATES, np.nan), where=ok)
                low, high = np.quantile(draws[source, b][ok], [0.025, 0.975]) if supported[0] else (None, None)
                assert all(map(same, (r["estimate"], r["weighted"], r["weighted_from"], r["lo"], r["hi"]), (by[b].sum() / bottom.sum(), by[b].sum(), bottom.sum(), low, high)))
                assert (r["raw_from"], r["stocks"], r["supported"], r["replicates"]) == (raw, stocks, supported[0], ok.sum())
                kept.add(supported[0])
        for b in range(3):
            r, gap = found[tj.GAP, a, b], draws["synthetic", b] - draws["real", b]
            both = said["real"][0] and said["synthetic"][0]
            low, high = np.quantile(gap[np.isfinite(gap)], [0.025, 0.975]) if both else (None, None)
            want = found["synthetic", a, b]["estimate"] - found["real", a, b]["estimate"]
            assert all(map(same, (r["estimate"], r["lo"], r["hi"]), (want, low, high)))
            assert (r["supported"], r["stocks"], r["raw_from"], r["replicates"]) == (both, min(said["real"][1], said["synthetic"][1]), None, np.isfinite(gap).sum())
    assert kept == {True, False}


def test_edges_of_one_value_are_padded_by_little(spark):
    r = gt.edges(spark.createDataFrame([(5.0, 0.0), (5.0, 0.0)], "a double, b double"), "a", "b").first()
    assert (r["lo_a"], r["hi_a"], r["lo_b"], r["hi_b"]) == (5.0 - 5e-6, 5.0 + 5e-6, -1e-8, 1e-8)
    assert gt.binned(spark.createDataFrame([(5.0,)], "a double"), "a").select(F.col("a_bin")).first()[0] == 10


def test_binomial_quantiles_by_enumeration(spark):
    from pricepanel.operators.error_tables import binomial_quantiles

    cases = [(n, p) for n in range(31) for p in (0.0, 0.01, 0.3, 0.5, 0.731, 0.99, 1.0)] + [(349, 0.731), (20_000, 0.5)]
    rows = spark.createDataFrame(cases, "n long, p double")
    low, high = binomial_quantiles(F.col("n"), F.col("p"))
    for r in rows.select("n", "p", low.alias("low"), high.alias("high")).collect():
        chances, up_to, found = [], 0.0, []
        for k in range(r["n"] + 1):
            chances.append(math.exp(math.lgamma(r["n"] + 1) - math.lgamma(k + 1) - math.lgamma(r["n"] - k + 1) + k * math.log(r["p"]) + (r["n"] - k) * math.log(1 - r["p"])) if 0 < r["p"] < 1 else float(k == r["n"] * (r["p"] == 1)))
        for q in (0.025, 0.975):
            up_to = np.cumsum(chances)
            found.append(int(np.argmax(up_to >= q - 1e-12)))
        assert [r["low"], r["high"]] == found, r


def test_binomial_quantiles_of_many_draws(spark):
    """An array of all counts would be too long for 3,000,000,000 draws; 30,000,000 are added up without a drift."""
    from pricepanel.operators.error_tables import binomial_quantiles

    rows = spark.createDataFrame([(30_000_000, 0.6), (30_000_000, 0.999), (3_000_000_000, 0.6)], "n long, p double")
    low, high = binomial_quantiles(F.col("n"), F.col("p"))
    for r in rows.select("n", "p", low.alias("low"), high.alias("high")).collect():
        mean, spread = r["n"] * r["p"], math.sqrt(r["n"] * r["p"] * (1 - r["p"]))
        for z, found in ((-1.959964, r["low"]), (1.959964, r["high"])):
            assert abs(mean + z * spread + (z * z - 1) * (1 - 2 * r["p"]) / 6 - found) <= 1, r
