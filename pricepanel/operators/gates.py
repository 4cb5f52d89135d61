"""Gate-probability analytics over rows ``(segment, step, p_bounce, p_break, p_hover)``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricepanel.functions.expressions import bin_index, first_argmax, ratio, softmax
from pricepanel.functions.storage import written
from pricepanel.operators.bootstrap import percentiles, ratios, resampled
from pricepanel.operators.sampling import numbered

EXPERTS = ("bounce", "break", "hover")
P = tuple(f"p_{e}" for e in EXPERTS)
#: Windows and stocks from which a cell counts as supported, bins of an axis.
MIN_WINDOWS, MIN_STOCKS, BINS = 30, 5, 20


def gate_scores(features: DataFrame, temperature: float = 1.0) -> DataFrame:
    """The column-only scorer: softmax of the normalised last price, the middle level's distance and minus the last price."""
    x = (F.col("last") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-8))
    p = softmax(*(v / temperature for v in (x, F.element_at("distances", 4), -x)))
    return features.withColumns(dict(zip(P, p, strict=True)))


def top_two(df: DataFrame) -> DataFrame:
    """``state`` (first on a tie, -1 without numbers), ``margin`` of the best over the second, ``ambiguous`` and ``tied``."""
    ranked = F.sort_array(F.array(*(F.col(c) for c in P)), asc=False)
    ok = F.col(P[0]).isNotNull() & F.col(P[1]).isNotNull() & F.col(P[2]).isNotNull()
    margin = F.round(ranked[0] - ranked[1], 12)
    df = df.withColumn("state", F.when(ok, first_argmax(*(F.col(c) for c in P))).otherwise(-1)).withColumn("margin", F.when(ok, margin))
    return df.withColumn("ambiguous", F.col("margin") < 0.05).withColumn("tied", F.col("margin") == 0)


def winner_shares() -> list[Column]:
    """One share per expert; ties split it."""
    top = F.greatest(*P)
    wins = [(F.col(c) == top).cast("int") for c in P]
    return [w / (wins[0] + wins[1] + wins[2]) for w in wins]


def entropy(eps: float = 0.0) -> Column:
    """-sum p ln p; ``eps`` inside the logarithm, or 0 ln 0 = 0 without it."""
    terms = [F.col(c) * F.ln(F.col(c) + eps) if eps else F.when(F.col(c) > 0, F.col(c) * F.ln(c)).otherwise(0.0) for c in P]
    return -(terms[0] + terms[1] + terms[2])


def accumulated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mergeable statistics: sums in the tasks, merged by the shuffle."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for e, c, share in zip(EXPERTS, P, winner_shares(), strict=True):
        aggs += [F.avg(c).alias(f"mean_{e}"), F.greatest(F.var_pop(c), F.lit(0.0)).alias(f"var_{e}"), F.avg(share).alias(f"share_{e}")]
    return df.groupBy(*keys).agg(*aggs, F.avg(entropy() / math.log(3)).alias("entropy"), F.avg(F.greatest(*P)).alias("mean_max"))


def assignment_change(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows in both: share excluded for a small margin, share of the others that switch winner (NULL if none), mean absolute change."""
    a = top_two(before).select(*keys, *(F.col(c).alias(f"a_{c}") for c in P), F.col("state").alias("sa"), F.col("margin").alias("ma"))
    b = top_two(after).select(*keys, *P, "state", "margin")
    both = a.join(b, keys)
    eligible = (F.col("ma") >= 0.05) & (F.col("margin") >= 0.05)
    change = sum((F.abs(F.col(c) - F.col(f"a_{c}")) for c in P), F.lit(0.0)) / 3
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((~eligible).cast("int")).alias("exclusion_rate"),
        F.avg(F.when(eligible, (F.col("sa") != F.col("state")).cast("int"))).alias("switch_fraction"),
        F.avg(change).alias("mean_change"),
    )


def edges(df: DataFrame, *cols: str) -> DataFrame:
    """One row with ``lo_<col>, hi_<col>`` of each column; where it has one value, a millionth of it (1e-8 at least) is added on both sides."""
    stats = df.agg(*(f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))))
    pad = {c: F.when(F.col(f"lo_{c}") == F.col(f"hi_{c}"), F.greatest(F.abs(f"lo_{c}") * 1e-6, F.lit(1e-8))).otherwise(0.0) for c in cols}
    return stats.select(*(x for c in cols for x in ((F.col(f"lo_{c}") - pad[c]).alias(f"lo_{c}"), (F.col(f"hi_{c}") + pad[c]).alias(f"hi_{c}"))))


def binned(df: DataFrame, col: str, bins: int = BINS) -> DataFrame:
    """``<col>_bin`` over the column's own range; the edges are one row."""
    return df.crossJoin(F.broadcast(edges(df, col))).withColumn(f"{col}_bin", bin_index(F.col(col), F.col(f"lo_{col}"), F.col(f"hi_{col}"), bins, clip=True)).drop(f"lo_{col}", f"hi_{col}")


def supported() -> Column:
    return (F.col("n") >= MIN_WINDOWS) & (F.col("stocks") >= MIN_STOCKS)


def _grid(df: DataFrame, **axes: list[int]) -> DataFrame:
    out = df.sparkSession.range(1).select()
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out


def distance_sums(df: DataFrame) -> DataFrame:
    """Sums by level (-1 for all), bin and stock: all that the summary and its bootstrap read afterwards."""
    rest = ["distance_bin", "issue_id"]
    rows = df.select(F.col("nearest_level").cast("int").alias("level"), *rest, *P)
    both = rows.groupingSets([["level", *rest], rest], "level", *rest).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in P), F.grouping_id().alias("_all"))
    return both.select(F.when(F.col("_all") > 0, -1).otherwise(F.col("level")).alias("level"), *rest, "n", *P)


def distance_summary(df: DataFrame) -> DataFrame:
    """Per level and distance bin: windows, stocks, support and mean gates; unseen cells have zero counts."""
    cells = distance_sums(binned(df, "distance")).groupBy("level", "distance_bin").agg(
        F.sum("n").alias("n"), F.countDistinct("issue_id").alias("stocks"), *(F.sum(c).alias(c) for c in P)
    )
    grid = _grid(df, level=list(range(-1, 7)), distance_bin=list(range(BINS)))
    full = grid.join(cells, ["level", "distance_bin"], "left").na.fill(0, ["n", "stocks"])
    return full.select("level", "distance_bin", "n", "stocks", supported().alias("supported"), *(ratio(F.col(c), F.col("n")).alias(c) for c in P))


def bootstrap_weights(ids: DataFrame, replicates: int, seed: int) -> DataFrame:
    """``(replicate, issue_id, weight)``: how often each security is drawn; as many draws as securities, from md5 numbers."""
    ranked = numbered(ids.select("issue_id").distinct(), "issue_id").withColumn("_n", F.col("_n") - 1)
    tasks = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes make many draws
    draw = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    draws = ranked.repartition(tasks, "_n").select(F.col("_n").alias("_draw"), "_all", draw.alias("replicate"))
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("_draw").cast("string"))), 1, 8), 16, 10).cast("double")
    drawn = draws.select("replicate", F.floor(digits / 2.0**32 * F.col("_all")).alias("_n"))
    weights = drawn.repartition("_n").groupBy("replicate", "_n").agg(F.count(F.lit(1)).alias("weight"))
    # Spark takes exploded rows for as few as they came from and would broadcast them; both sides are dealt by security instead.
    return weights.join(ranked.hint("shuffle_hash"), "_n").select("replicate", "issue_id", "weight")


def distance_bands(df: DataFrame, replicates: int = 1000, seed: int = 1) -> DataFrame:
    """2.5 and 97.5 percentiles over replicates of each cell's mean gates, left out where the cell isn't supported.

    The stocks of ``df`` are drawn, the same in all cells; a replicate counts for a cell if it drew a window of it. Cells of no window have no replicates.
    """
    sums = written(distance_sums(binned(df, "distance")), "distance-sums")
    cells = sums.groupBy("level", "distance_bin").agg(F.sum("n").alias("n"), F.countDistinct("issue_id").alias("stocks"))
    draws = resampled(sums, ["level", "distance_bin"], ["n", *P], replicates, seed)
    bands = {c: percentiles(ratios(c, "n")) for c in P}
    found = draws.select("level", "distance_bin", bands[P[0]][2].alias("replicates"), *(x.alias(f"{c}_{end}") for c, own in bands.items() for x, end in zip(own, ("lo", "hi"), strict=False)))
    grid = _grid(df, level=list(range(-1, 7)), distance_bin=list(range(BINS)))
    full = grid.join(cells, ["level", "distance_bin"], "left").join(found, ["level", "distance_bin"], "left").na.fill(0, ["n", "stocks", "replicates"])
    ends = [F.when(supported(), F.col(f"{c}_{end}")).alias(f"{c}_{end}") for c in P for end in ("lo", "hi")]
    return full.select("level", "distance_bin", "n", "stocks", supported().alias("supported"), "replicates", *ends)


def movement_summary(df: DataFrame) -> DataFrame:
    """Distance by movement, 20 by 20 bins: windows, stocks, support and mean gates."""
    cells = binned(binned(df, "distance"), "movement").groupBy("distance_bin", "movement_bin").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("issue_id").alias("stocks"), *(F.avg(c).alias(c) for c in P)
    )
    grid = _grid(df, distance_bin=list(range(BINS)), movement_bin=list(range(BINS)))
    full = grid.join(cells, ["distance_bin", "movement_bin"], "left").na.fill(0, ["n", "stocks"])
    return full.select("distance_bin", "movement_bin", "n", "stocks", supported().alias("supported"), *P)


def gate_entropy(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(entropy(1e-8)).alias("entropy"))


def batch_terms(df: DataFrame, keys: list[str], clip: float = 0.1) -> DataFrame:
    """Gate rewards (at unit strength) and the balance loss per batch: two aggregations, the second over the first's means."""
    h = [-F.col(c) * F.ln(F.col(c) + 1e-8) for c in P]
    means = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(P)), *(F.avg(x).alias(f"h{i}") for i, x in enumerate(h)), *(F.var_pop(c).alias(f"v{i}") for i, c in enumerate(P))
    )
    m, hh, v = ([F.col(f"{x}{i}") for i in range(3)] for x in "mhv")
    strength = [1 / F.greatest(F.least(3 * x, F.lit(1.0)), F.lit(clip)) for x in m]
    mixed = -sum((x * F.ln(x + 1e-8) for x in m), F.lit(0.0))
    return means.select(
        *keys,
        "n",
        (hh[0] + hh[1] + hh[2]).alias("entropy_reward"),
        (strength[0] * hh[0] + strength[1] * hh[1] + strength[2] * hh[2]).alias("adaptive_entropy_reward"),
        ((v[0] + v[1] + v[2]) / 3).alias("regional_variance_reward"),
        (mixed - (hh[0] + hh[1] + hh[2])).alias("mutual_info_reward"),
        sum(((x - 1 / 3) * (x - 1 / 3) for x in m), F.lit(0.0)).alias("balance_loss"),
    )


def mixture(df: DataFrame, logits: list[str], mu: list[str], sigma: list[str], temperature: float = 1.0) -> DataFrame:
    """Softmax gates and the mixture's drift and diffusion."""
    p = softmax(*(F.col(c) / temperature for c in logits))
    drift = sum((q * F.col(c) for q, c in zip(p, mu, strict=True)), F.lit(0.0))
    variance = sum((q * F.col(c) * F.col(c) for q, c in zip(p, sigma, strict=True)), F.lit(0.0))
    return df.withColumns({**dict(zip(P, p, strict=True)), "mu": drift, "sigma": F.sqrt(variance)})


def utilisation(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, variance and deviation of each gate, the least used one's mean, mean size of drift and mean diffusion."""
    aggs = [f(c).alias(f"{n}_{e}") for e, c in zip(EXPERTS, P, strict=True) for n, f in (("mean", F.avg), ("var", F.var_pop), ("sd", F.stddev_pop))]
    out = df.groupBy(*keys).agg(*aggs, F.avg(F.abs("mu")).alias("mean_abs_drift"), F.avg("sigma").alias("mean_diffusion"))
    return out.withColumn("min_mean", F.least(*(f"mean_{e}" for e in EXPERTS)))
