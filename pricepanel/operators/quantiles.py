"""Exact quantiles and running totals of groups of any size, of which no task sees a whole one.

Quantiles are selected by rank: a round counts a group's values by equal-width bins of the ranges that still hold a wanted rank, and goes on with the
values of its bin, from the smallest that is there to the largest, until a range has one value or few enough to be ranked in a task. All wanted
ranks of all groups are refined in the same rounds. Counts are partial before the shuffle, so a group of a third of all rows is no hot one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricepanel.functions.storage import written

#: Bins of a round, and values of a range that are ranked in one task.
BINS, WHOLE = 4096, 50_000


def _on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys of which any may be null; the right side's keys go."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    met = [left[k].eqNullSafe(other[f"_right_{k}"]) for k in keys]
    condition = met[0]
    for m in met[1:]:
        condition &= m
    return left.join(other, condition, how).drop(*(f"_right_{k}" for k in keys))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], bins: int = BINS, whole: int = WHOLE) -> DataFrame:
    """``keys`` and a column for each of the ``quantiles``, interpolated between the two values around it; nulls don't count, groups of nulls have no row."""
    named = {k: f"_k{i}" for i, k in enumerate(keys)} or {"": "_k0"}
    own = list(named.values())
    cells = [(F.col(k) if k else F.lit(0)).alias(n) for k, n in named.items()]
    values = written(df.select(*cells, F.col(value).cast("double").alias("_x")).where("_x is not null"), "quantile-values")
    ends = values.groupBy(*own).agg(F.min("_x").alias("_a"), F.max("_x").alias("_b"), F.count(F.lit(1)).alias("_inside"))
    place = {n: F.lit(q) * (F.col("_n") - 1) for n, q in quantiles.items()}
    groups = written(ends.select(*own, F.col("_inside").alias("_n")), "quantile-groups")
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(p), F.ceil(p)) for p in place.values()))))
    targets = written(ends.withColumn("_n", F.col("_inside")).select(*own, F.explode(ranks).alias("_rank"), "_a", "_b", F.lit(0).cast("long").alias("_before"), "_inside"), "quantile-ranks")
    still = (F.col("_inside") > whole) & (F.col("_a") < F.col("_b"))
    while not targets.where(still).isEmpty():
        open_ = targets.where(still)
        hits = _in_range(values, open_, own)
        bin_ = F.least(F.floor((F.col("_x") - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins), F.lit(bins - 1))
        counts = hits.groupBy(*own, "_a", "_b", bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        up_to = F.coalesce(F.sum("_c").over(Window.partitionBy(*own, "_a", "_b").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        met = _on(open_, counts.withColumn("_up", up_to), [*own, "_a", "_b"])
        first = F.col("_before") + F.col("_up")
        chosen = met.where((F.col("_rank") >= first) & (F.col("_rank") < first + F.col("_c")))
        chosen = chosen.select(*own, "_rank", F.col("_lo").alias("_a"), F.col("_hi").alias("_b"), first.alias("_before"), F.col("_c").alias("_inside"))
        targets = written(targets.where(~still).unionByName(chosen), "quantile-ranks")
    single = targets.where("_a = _b").select(*own, "_rank", F.col("_a").alias("_v"))
    few = targets.where("_a < _b")
    order = F.row_number().over(Window.partitionBy(*own, "_a", "_b").orderBy("_x")) - 1
    ranked = _in_range(values, few, own).withColumn("_i", order)
    found = _on(few, ranked, [*own, "_a", "_b"]).where(F.col("_rank") == F.col("_before") + F.col("_i")).select(*own, "_rank", F.col("_x").alias("_v"))
    by_rank = single.unionByName(found).groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_of"))
    out = _on(groups, by_rank, own)

    def at(p: Column) -> Column:
        low, high = F.element_at("_of", F.floor(p)), F.element_at("_of", F.ceil(p))
        return low + (high - low) * (p - F.floor(p))

    return out.select(*(F.col(n).alias(k) for k, n in named.items() if k), *(at(p).alias(n) for n, p in place.items()))


def _in_range(values: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, _x, _a, _b``: the values that are in a range of their group's targets. Ranges of a group are equal or apart."""
    spans = targets.groupBy(*keys).agg(F.collect_set(F.struct("_a", "_b")).alias("_spans"))
    span = F.get(F.filter("_spans", lambda s: (F.col("_x") >= s["_a"]) & (F.col("_x") <= s["_b"])), F.lit(0))
    return _on(values, spans, keys).withColumn("_s", span).where("_s is not null").select(*keys, "_x", "_s.*")


def running_total(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` up to each row by ``order`` within its group, without a task that sorts a whole group.

    Rows are summed within the ranges of a range partitioning, and lifted by the totals of the ranges before. ``order`` must tell a group's rows apart.
    """
    rows = written(df.repartitionByRange(*keys, order).withColumn("_p", F.spark_partition_id()), "running-ranges")
    totals = rows.groupBy(*keys, "_p").agg(F.sum(value).alias("_t"))  # a row for each group and range that has it
    before = F.coalesce(F.sum("_t").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.sum(value).over(Window.partitionBy(*keys, "_p").orderBy(order))
    return _on(rows.withColumn("_own", own), totals.select(*keys, "_p", before.alias("_earlier")), [*keys, "_p"]).withColumn(name, F.col("_own") + F.col("_earlier")).drop("_p", "_own", "_earlier")
