"""Dwell, transition and bootstrap statistics of gate trajectories.

A trajectory is the steps of one ``(segment_id, source, path_id)``; ``issue_id`` is its stock. Statistics of many trajectories
are summed per stock before bootstrap weights meet them, so facts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricepanel.functions.expressions import ratio
from pricepanel.functions.storage import written
from pricepanel.operators.bootstrap import percentiles, ratios, resampled
from pricepanel.operators.gates import EXPERTS, P, entropy, top_two
from pricepanel.operators.quantiles import exact_quantiles

PATH = ["segment_id", "issue_id", "source", "path_id"]
METRICS = (
    "switches", "switches_per_100", "zero_switch", "dwell_mean", "dwell_median", "soft_change_mean", "soft_change_median", "entropy", "ambiguous_share", "tie_share",
    *(f"mean_{e}" for e in EXPERTS), *(f"share_{e}" for e in EXPERTS),
)
SOURCES, GAP = ("real", "synthetic"), "synthetic-minus-real"
#: Transitions out of a state, and stocks that have any, from which the state counts as supported.
MIN_TRANSITIONS, MIN_STOCKS = 30, 5


def _order():
    return Window.partitionBy(*PATH).orderBy("step")


def stepped(df: DataFrame) -> DataFrame:
    """States, flags, the mean gate change to the step before, the state before and the dwell run of each step."""
    w = _order()
    rows = top_two(df).withColumn("before", F.lag("state").over(w))
    change = sum((F.abs(F.col(c) - F.lag(c).over(w)) for c in P), F.lit(0.0)) / 3
    rows = rows.withColumn("soft_change", change)
    return rows.withColumn("run", F.sum(F.coalesce((F.col("state") != F.col("before")).cast("int"), F.lit(0))).over(w))


def dwell_runs(steps: DataFrame) -> DataFrame:
    """Maximal runs of one state: first and last step, duration, whether cut off by the trajectory's start or end."""
    ends = Window.partitionBy(*PATH)
    rows = steps.withColumns({"_first": F.min("step").over(ends), "_last": F.max("step").over(ends)})
    runs = rows.groupBy(*PATH, "run", "state").agg(
        F.min("step").alias("start"), F.max("step").alias("end"), F.count(F.lit(1)).alias("duration"), F.min("_first").alias("_first"), F.max("_last").alias("_last")
    )
    runs = runs.withColumns({"left_censored": F.col("start") == F.col("_first"), "right_censored": F.col("end") == F.col("_last")})
    return runs.withColumn("interior", ~F.col("left_censored") & ~F.col("right_censored")).drop("_first", "_last")


def transitions(steps: DataFrame) -> DataFrame:
    """Counts of each pair of states per trajectory in columns ``t_<from><to>``."""
    pair = lambda a, b: F.count(F.when((F.col("before") == a) & (F.col("state") == b), 1)).alias(f"t_{a}{b}")
    return steps.groupBy(*PATH).agg(*(pair(a, b) for a in range(3) for b in range(3)))


def transition_rows(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Long form ``from, to, n, probability``; the probability of an empty row is NULL."""
    cells = F.array(*(F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"), F.col(f"t_{a}{b}").alias("n")) for a in range(3) for b in range(3)))
    rows = counts.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")
    return rows.withColumn("probability", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*keys, "from"))))


def trajectory_metrics(steps: DataFrame) -> DataFrame:
    """One row per trajectory; medians are exact, per-expert dwells are NULL where the expert never won.

    A run's duration stands at its first step, so steps and runs are summed in one grouping, on the partitioning that the steps have.
    """
    first = F.coalesce(F.col("state") != F.col("before"), F.lit(True))
    duration = F.when(first, F.count(F.lit(1)).over(Window.partitionBy(*PATH, "run")))
    rows = steps.withColumn("_duration", duration).groupBy(*PATH).agg(
        F.count(F.lit(1)).alias("observations"),
        F.count(F.when(F.col("state") != F.col("before"), 1)).alias("switches"),
        F.avg("soft_change").alias("soft_change_mean"),
        F.percentile("soft_change", F.lit(0.5)).alias("soft_change_median"),
        F.avg(entropy() / F.ln(F.lit(3.0))).alias("entropy"),
        F.avg(F.col("ambiguous").cast("int")).alias("ambiguous_share"),
        F.avg(F.col("tied").cast("int")).alias("tie_share"),
        *(F.avg(c).alias(f"mean_{e}") for e, c in zip(EXPERTS, P, strict=True)),
        *(F.avg((F.col("state") == i).cast("int")).alias(f"share_{e}") for i, e in enumerate(EXPERTS)),
        F.avg("_duration").alias("dwell_mean"),
        F.percentile("_duration", F.lit(0.5)).alias("dwell_median"),
        *(F.avg(F.when(F.col("state") == i, F.col("_duration"))).alias(f"dwell_{e}") for i, e in enumerate(EXPERTS)),
    )
    return rows.withColumns({"switches_per_100": ratio(100 * F.col("switches"), F.col("observations") - 1), "zero_switch": F.col("switches") == 0})


def paired_weights(paths: DataFrame) -> DataFrame:
    """Valid rows of the segments with a valid path of either source, ``weight`` 1 over the paths of their segment and source."""
    ok = paths.where("valid")
    w = Window.partitionBy("segment_id")
    has = [F.max((F.col("source") == s).cast("int")).over(w) == 1 for s in SOURCES]
    rows = ok.withColumn("_both", has[0] & has[1]).where("_both").drop("_both")
    return rows.withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy("segment_id", "source")))


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, q: float = 0.5, bins: int = 1024) -> DataFrame:
    """Smallest value whose cumulative weight reaches ``q`` of the total, over positive weights.

    Bin totals tell which equal-width bin holds the quantile; only that bin's distinct values are then ordered, so no group is sorted whole.
    """
    rows = df.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    rows = rows.groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(F.sum(weight).alias("_w"))
    ends = rows.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.sum("_w").alias("_all"))
    at = F.least(F.floor(F.coalesce(ratio(F.col("_x") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    rows = rows.join(ends, keys).withColumn("_bin", at)
    totals = rows.groupBy(*keys, "_bin", "_all").agg(F.sum("_w").alias("_b"))
    up_to = F.sum("_b").over(Window.partitionBy(*keys).orderBy("_bin"))
    totals = totals.withColumns({"_up": up_to, "_before": up_to - F.col("_b")})
    target = F.greatest(q * F.col("_all") - 1e-9, F.lit(1e-300))
    chosen = totals.where((F.col("_up") >= target) & (F.col("_before") < target)).select(*keys, "_bin", "_before")
    inside = rows.join(chosen, [*keys, "_bin"])
    inside = inside.withColumn("_cum", F.col("_before") + F.sum("_w").over(Window.partitionBy(*keys).orderBy("_x")))
    return inside.where(F.col("_cum") >= target).groupBy(*keys).agg(F.min("_x").alias(f"{value}_quantile"))


def interval(draws: DataFrame, keys: list[str], value: str) -> DataFrame:
    """2.5 and 97.5 percentiles of the draws that have a value, and their number."""
    draws = written(draws.select(*keys, value), "draws")
    counts = draws.groupBy(*keys).agg(F.count(value).alias("replicates"))
    return counts.join(exact_quantiles(draws, keys, value, {"lo": 0.025, "hi": 0.975}), keys, "left").select(*keys, "lo", "hi", "replicates")


def _sides(sums: DataFrame, keys: list[str], replicates: int, seed: int) -> DataFrame:
    """``keys, source, estimate, lo, hi, replicates`` of ``sum s / sum w`` for both sources and the second less the first.

    ``sums(issue_id, keys, s_<source>, w_<source>)`` are per stock. Both sources share their draws, so the difference is taken draw by draw.
    """
    names = [f"{x}_{source}" for source in SOURCES for x in "sw"]
    whole = sums.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in names))
    point = [ratio(F.col(f"s_{source}"), F.col(f"w_{source}")) for source in SOURCES]
    estimates = whole.select(*keys, F.explode(F.array(*(F.struct(F.lit(name).alias("source"), value.alias("estimate")) for name, value in zip((*SOURCES, GAP), (*point, point[1] - point[0]), strict=True)))).alias("e"))
    drawn = resampled(sums, keys, names, replicates, seed)
    drawn = drawn.select(*keys, *(ratios(f"s_{source}", f"w_{source}").alias(source) for source in SOURCES))
    drawn = drawn.withColumn(GAP, F.zip_with(SOURCES[1], SOURCES[0], lambda a, b: a - b))
    bands = [F.struct(F.lit(name).alias("source"), *(x.alias(n) for x, n in zip(percentiles(F.col(f"`{name}`")), ("lo", "hi", "replicates"), strict=True))) for name in (*SOURCES, GAP)]
    intervals = drawn.select(*keys, F.explode(F.array(*bands)).alias("b")).select(*keys, "b.*")
    return estimates.select(*keys, "e.*").join(intervals, [*keys, "source"], "left")


def compared(weighted: DataFrame, replicates: int = 1000, seed: int = 1, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Per metric, for each source and for synthetic less real: weighted mean, weighted median, bootstrap interval and counts.

    ``weighted`` are the included trajectories with their metrics and ``weight``; their stocks are drawn, the same for all metrics and both
    sources. A metric that a trajectory lacks adds nothing to its sum. The difference has no median and no trajectories; its origins are the real ones.
    """
    cell = lambda source, value: F.sum(F.when(F.col("source") == source, value))
    value = {m: F.col(m).cast("double") for m in metrics}
    totals = [cell(source, F.col("weight") * value[m]).alias(f"{m}|{source}") for m in metrics for source in SOURCES]
    stocks = weighted.groupBy("issue_id").agg(*totals, *(cell(source, F.col("weight")).alias(f"w_{source}") for source in SOURCES))
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), *(F.col(f"`{m}|{source}`").alias(f"s_{source}") for source in SOURCES)) for m in metrics))
    sums = written(stocks.select("issue_id", F.explode(cells).alias("c"), *(f"w_{source}" for source in SOURCES)).select("issue_id", "c.*", *(f"w_{source}" for source in SOURCES)), "metric-sums")
    out = _sides(sums, ["metric"], replicates, seed)
    long = weighted.select("source", "weight", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), value[m].alias("value")) for m in metrics))).alias("c")).select("source", "weight", "c.*")
    medians = weighted_quantile(long, ["metric", "source"], "value", "weight").withColumnRenamed("value_quantile", "median")
    counts = weighted.groupBy("source").agg(F.count(F.lit(1)).alias("trajectories"), F.countDistinct("segment_id").alias("origins"))
    gap = counts.where(F.col("source") == SOURCES[0]).select(F.lit(GAP).alias("source"), F.lit(None).cast("long").alias("trajectories"), "origins")
    both = counts.unionByName(gap).crossJoin(F.broadcast(weighted.agg(F.countDistinct("issue_id").alias("stocks"))))  # three rows and one
    return out.join(medians, ["metric", "source"], "left").join(both, "source")


def compared_transitions(counts: DataFrame, weighted: DataFrame, replicates: int = 1000, seed: int = 1) -> DataFrame:
    """Weighted transition probabilities of each source and of synthetic less real, with intervals and support.

    A source state is supported by 30 raw transitions out of it and 5 stocks that have any; the difference, where both sources' are. Unsupported rows
    have no interval. The difference has no counts, and the fewer stocks of both.
    """
    own = counts.join(weighted.select(*PATH, "weight"), PATH)
    stocks = own.groupBy("issue_id", "source").agg(*(f.alias(f"{n}_{a}{b}") for a in range(3) for b in range(3) for n, f in (("s", F.sum(F.col("weight") * F.col(f"t_{a}{b}"))), ("r", F.sum(f"t_{a}{b}")))))
    cells = F.array(*(F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"), F.col(f"s_{a}{b}").alias("s"), (F.col(f"s_{a}0") + F.col(f"s_{a}1") + F.col(f"s_{a}2")).alias("w"), (F.col(f"r_{a}0") + F.col(f"r_{a}1") + F.col(f"r_{a}2")).alias("raw")) for a in range(3) for b in range(3)))
    long = stocks.select("issue_id", "source", F.explode(cells).alias("c")).select("issue_id", "source", "c.*")
    side = lambda source, c: F.sum(F.when(F.col("source") == source, F.col(c)))
    sums = written(long.groupBy("from", "to", "issue_id").agg(*(side(source, c).alias(f"{c}_{source}") for source in SOURCES for c in ("s", "w", "raw"))), "transition-sums")
    out = _sides(sums, ["from", "to"], replicates, seed)
    keys = ["from", "to"]
    totals = sums.groupBy(*keys).agg(*(x.alias(f"{n}_{source}") for source in SOURCES for n, x in (("weighted", F.sum(f"s_{source}")), ("weighted_from", F.sum(f"w_{source}")), ("raw_from", F.sum(f"raw_{source}")), ("stocks", F.count(F.when(F.col(f"w_{source}") > 0, 1))))))
    enough = {source: (F.col(f"raw_from_{source}") >= MIN_TRANSITIONS) & (F.col(f"stocks_{source}") >= MIN_STOCKS) for source in SOURCES}
    rows = [F.struct(F.lit(source).alias("source"), *(F.col(f"{n}_{source}").alias(n) for n in ("weighted", "weighted_from", "raw_from", "stocks")), enough[source].alias("supported")) for source in SOURCES]
    none = [F.lit(None).cast(kind).alias(n) for n, kind in (("weighted", "double"), ("weighted_from", "double"), ("raw_from", "long"))]
    rows.append(F.struct(F.lit(GAP).alias("source"), *none, F.least(*(f"stocks_{source}" for source in SOURCES)).alias("stocks"), (enough[SOURCES[0]] & enough[SOURCES[1]]).alias("supported")))
    support = totals.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")
    both = out.join(support, [*keys, "source"])
    return both.withColumns({end: F.when(F.col("supported"), F.col(end)) for end in ("lo", "hi")})


def transition_origins(counts: DataFrame, weighted: DataFrame) -> DataFrame:
    """Raw and weighted counts per segment, source and pair of states."""
    cells = F.array(*(F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"), F.col(f"t_{a}{b}").alias("n")) for a in range(3) for b in range(3)))
    long = counts.join(weighted.select(*PATH, "weight"), PATH).select("segment_id", "source", "weight", F.explode(cells).alias("c")).select("segment_id", "source", "weight", "c.*")
    return long.groupBy("segment_id", "source", "from", "to").agg(F.sum("n").alias("raw"), F.sum(F.col("n") * F.col("weight")).alias("weighted"))


def weighted_runs(runs: DataFrame, weighted: DataFrame) -> DataFrame:
    return runs.join(weighted.select(*PATH, "weight"), PATH)


def dwell_distribution(runs: DataFrame, longest: int) -> DataFrame:
    """Weighted mass and share of the source's expert and interior flag by duration, dense from 1 to ``longest``."""
    mass = runs.groupBy("source", "state", "interior", "duration").agg(F.sum("weight").alias("mass"))
    groups = F.explode(F.array(*(F.struct(F.lit(s).alias("source"), F.lit(i).alias("state"), F.lit(b).alias("interior")) for s in SOURCES for i in range(3) for b in (False, True))))
    grid = runs.sparkSession.range(1).select(groups.alias("g")).select("g.*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(longest).cast("long"))).alias("duration"))
    full = grid.join(mass, ["source", "state", "interior", "duration"], "left").na.fill(0.0, ["mass"])
    return full.withColumn("share", ratio(F.col("mass"), F.sum("mass").over(Window.partitionBy("source", "state"))))


def all_runs_share(distribution: DataFrame) -> DataFrame:
    return distribution.groupBy("source", "state", "duration").agg(F.sum("share").alias("share"))


def dwell_summary(runs: DataFrame) -> DataFrame:
    """Per source, expert and scope (all or interior runs): counts, weighted mean and median, share cut off."""
    scopes = F.when(F.col("interior"), F.array(F.lit("all"), F.lit("interior"))).otherwise(F.array(F.lit("all")))
    rows = runs.withColumn("scope", F.explode(scopes))
    keys = ["source", "state", "scope"]
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("weight").alias("weighted_runs"),
        ratio(F.sum(F.col("weight") * F.col("duration")), F.sum("weight")).alias("mean"),
        ratio(F.sum(F.when(~F.col("interior"), F.col("weight")).otherwise(0.0)), F.sum("weight")).alias("censored_share"),
    )
    return out.join(weighted_quantile(rows, keys, "duration", "weight").withColumnRenamed("duration_quantile", "median"), keys)


def weighted_histogram(df: DataFrame, value: str, width: float | None = None, bins: int = 40) -> DataFrame:
    """Share of weight per source and bin: bins of ``width`` from 0, or ``bins`` up to the largest value."""
    rows = df.where(F.col(value).isNotNull())
    if width is None:
        top = F.broadcast(rows.agg(F.max(value).alias("_top")))
        rows = rows.crossJoin(top).withColumn("bin", F.coalesce(F.least(F.floor(ratio(F.col(value), F.col("_top")) * bins), F.lit(bins - 1)), F.lit(0)).cast("int"))
    else:
        rows = rows.withColumn("bin", F.floor(F.col(value) / width).cast("int"))
    mass = rows.groupBy("source", "bin").agg(F.sum("weight").alias("mass"))
    return mass.withColumn("share", F.col("mass") / F.sum("mass").over(Window.partitionBy("source"))).drop("mass")


def coverage(paths: DataFrame) -> DataFrame:
    """Per origin: valid real paths, synthetic ones made, valid and invalid, and whether it is paired."""
    n = lambda ok: F.count(F.when(ok, 1))
    real, made = F.col("source") == "real", F.col("source") == "synthetic"
    rows = paths.groupBy("segment_id", "issue_id").agg(
        n(real & F.col("valid")).alias("real_valid"), n(made).alias("generated"), n(made & F.col("valid")).alias("synthetic_valid"), n(made & ~F.col("valid")).alias("synthetic_invalid")
    )
    return rows.withColumn("paired", (F.col("real_valid") > 0) & (F.col("synthetic_valid") > 0))


def exclusions(paths: DataFrame) -> DataFrame:
    """Reasons of the invalid paths, and origins without a valid path of a source."""
    invalid = paths.where("not valid").groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))
    origins = coverage(paths).select(F.explode(F.array_compact(F.array(
        F.when(F.col("real_valid") == 0, F.struct(F.lit("real").alias("source"), F.lit("no valid path").alias("reason"))),
        F.when(F.col("synthetic_valid") == 0, F.struct(F.lit("synthetic").alias("source"), F.lit("no valid path").alias("reason"))),
    ))).alias("r")).select("r.*")
    return invalid.unionByName(origins.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n")))


def origin_seed(seed: int, issue_id: Column, origin_date: Column) -> Column:
    """First 8 bytes of the SHA-256 of ``seed|issue|date``, least byte first, modulo 2**63 - 1."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), issue_id, origin_date.cast("string")), 256)
    turned = F.concat(*(F.substring(digest, 2 * i + 1, 2) for i in range(7, -1, -1)))
    return (F.conv(turned, 16, 10).cast("decimal(20,0)") % F.lit(2**63 - 1).cast("decimal(20,0)")).cast("long")


def unrolled(paths: DataFrame) -> DataFrame:
    """Array columns ``price`` and gates of a path as one row per step."""
    zipped = F.arrays_zip("price", *P)
    return paths.select(*PATH, F.posexplode(zipped).alias("step", "r")).select(*PATH, "step", "r.*")
