"""Samplers, splits, balances and set operations. Random order is an md5 of seed and keys, the same on any partitioning."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricepanel.functions.expressions import hash_order
from pricepanel.functions.storage import written


def random_ids(df: DataFrame, k: int, seed: int) -> DataFrame:
    """``k`` of the securities."""
    ids = df.select("issue_id").distinct()
    return ids.orderBy(hash_order(seed, "issue_id"), "issue_id").limit(k)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``_n`` from 1 by ``order`` over all rows, and their number ``_all``, without sorting them in one task.

    Rows are sorted within the ranges of a range partitioning, which is written, and lifted by the counts of the ranges before.
    """
    rows = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    counts = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))  # a row for each partition
    up_to = F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    before = counts.select("_p", (up_to - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_all"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return rows.withColumn("_own", own).join(F.broadcast(before), "_p").withColumn("_n", F.col("_own") + F.col("_before")).drop("_p", "_own", "_before")


def split_ids(df: DataFrame) -> DataFrame:
    """First half of the sorted securities train, the rest val; a single one is both. Only ids are ordered."""
    ranked = numbered(df.select("issue_id").distinct(), "issue_id")
    both = F.array(F.lit("train"), F.lit("val"))
    split = F.when(F.col("_all") == 1, both).when(F.col("_n") <= F.floor(F.col("_all") / 2), F.array(F.lit("train"))).otherwise(F.array(F.lit("val")))
    return ranked.select("issue_id", F.explode(split).alias("split"))


def ranked_in_buckets(df: DataFrame, order: Column, ties: list[str], by: tuple[str, ...] = (), rank: str = "rank", size: str | None = None) -> DataFrame:
    """``rank`` from 1 by a hexadecimal ``order`` over all rows, or those of each group ``by``, without sorting one in one task.

    Rows are ranked within the first three digits (4,096 buckets) and lifted by the counts of the group's buckets before; ``size`` names a
    column for the group's number of rows.
    """
    rows = df.withColumn("_h", order).withColumn("_b", F.substring("_h", 1, 3))
    counts = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    up_to = F.sum("_c").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    before = counts.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_b").alias("_at"), (up_to - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy(*by)).alias("_size"))
    own = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", *ties))
    same = F.col("_b") == F.col("_at")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    met = rows.withColumn("_own", own).join(before if by else F.broadcast(before), same)
    if size:
        met = met.withColumn(size, F.col("_size"))
    return met.withColumn(rank, F.col("_own") + F.col("_before")).drop("_h", "_b", "_at", "_own", "_before", "_size", *(f"_by_{c}" for c in by))


def random_split(df: DataFrame, keys: list[str], share: float, seed: int) -> DataFrame:
    """``split`` train for ``int(share * n)`` rows (one at least), val for the others."""
    total = df.count()
    first = max(1, int(share * total))
    ranked = ranked_in_buckets(df, hash_order(seed, *keys), keys)
    return ranked.withColumn("split", F.when(F.col("rank") <= first, "train").otherwise("val")).drop("rank")


def balanced(df: DataFrame, label: str, keys: list[str], seed: int, write: bool = True) -> DataFrame:
    """As many rows of every class as the smallest has, without replacement. ``df`` is read for its counts and for its rows; one that is a table already needs no writing."""
    df = written(df, "rows-to-balance") if write else df
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).agg(F.min("_n").alias("_least"))
    ranked = ranked_in_buckets(df, hash_order(seed, *keys), keys, (label,), "_rank")
    return ranked.join(F.broadcast(least), F.col("_rank") <= F.col("_least")).drop("_rank", "_least")  # one row


def balanced_bins(df: DataFrame, bin_: str, keys: list[str], target: int, seed: int) -> DataFrame:
    """``target`` rows of every nonempty bin; a short one repeats rows, drawn by hash (``copy`` tells draws apart)."""
    ranked = ranked_in_buckets(df, hash_order(seed, *keys), keys, (bin_,), "_rank", "_n")
    long = ranked.where((F.col("_n") >= target) & (F.col("_rank") <= target)).withColumn("copy", F.lit(0))
    sizes = df.groupBy(bin_).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < target)
    draws = sizes.select(bin_, "_n", F.explode(F.sequence(F.lit(1), F.lit(target))).alias("copy"))
    digits = F.conv(F.substring(hash_order(seed, bin_, "copy"), 1, 8), 16, 10).cast("long")
    draws = draws.select(bin_, "copy", (digits % F.col("_n") + 1).cast("int").alias("_rank"))
    short = ranked.drop("_n").join(draws, [bin_, "_rank"])
    return long.drop("_rank", "_n").unionByName(short.drop("_rank"))


def synthetic_quotas(total: int, classes: int, share: float) -> tuple[int, int]:
    """Rows per class and how many of them are synthetic (half to even); a share above 1 is a percentage."""
    share = share / 100 if share > 1 else share
    target = total // classes
    return target, round(target * share)


def synthetic_share_balance(df: DataFrame, label: str, synthetic: str, keys: list[str], total: int, share: float, seed: int) -> DataFrame:
    """Equal classes with a fixed share of synthetic rows each; too few rows of a kind are an error."""
    counts = {(r[label], r[synthetic]): r["n"] for r in df.groupBy(label, synthetic).agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = sorted({c for c, _ in counts})
    target, wanted = synthetic_quotas(total, len(classes), share)
    for c in classes:
        if counts.get((c, True), 0) < wanted or counts.get((c, False), 0) < target - wanted:
            raise ValueError(f"class {c} has too few rows for {target - wanted} real and {wanted} synthetic ones")
    ranked = ranked_in_buckets(df, hash_order(seed, *keys), keys, (label, synthetic), "_rank")
    quota = F.when(F.col(synthetic), wanted).otherwise(target - wanted)
    return ranked.where(F.col("_rank") <= quota).drop("_rank")


def synthetic_caps(df: DataFrame, label: str, synthetic: str, shares: list[float]) -> DataFrame:
    """Planning table: for each share the largest total that the class counts allow."""
    counts = df.groupBy(label).agg(F.count(F.when(F.col(synthetic), 1)).alias("s"), F.count(F.when(~F.col(synthetic), 1)).alias("r"))
    plan = counts.select("*", F.explode(F.array(*map(F.lit, shares))).alias("share"))
    by_synthetic = F.when(F.col("share") > 0, F.floor(F.col("s") / F.col("share")))
    by_real = F.when(F.col("share") < 1, F.floor(F.col("r") / (1 - F.col("share"))))
    per_class = plan.withColumn("cap", F.least(by_synthetic, by_real).cast("long"))
    return per_class.groupBy("share").agg(F.min("cap").alias("per_class"), (F.min("cap") * F.count(F.lit(1))).alias("total"))


def appended(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Rows of both, duplicates kept; the synthetic side is cast to the real one's types."""
    return real.unionByName(synthetic.select(*(F.col(f.name).cast(f.dataType) for f in real.schema)))


def sector_allocation(universe: DataFrame, n: int, seed: int) -> DataFrame:
    """``int(n / sectors + .5)`` securities of each sector, the first half of them train."""
    each = universe.select("sector").distinct().agg(F.floor(n / F.count(F.lit(1)) + 0.5).cast("int").alias("_each"))
    ranked = ranked_in_buckets(universe, hash_order(seed, "issue_id"), ["issue_id"], ("sector",), "_rank", "_n").crossJoin(F.broadcast(each)).where("_rank <= _each")
    size = F.least("_n", "_each")
    return ranked.withColumn("split", F.when(F.col("_rank") <= F.floor(size / 2), "train").otherwise("val")).drop("_rank", "_each", "_n")


def matched_batches(rows: DataFrame, env: str, keys: list[str], seed: int) -> DataFrame:
    """One row of each sector per ``batch``; as many batches as the smallest sector has rows. ``weight`` is the sector's share of rows."""
    sizes = rows.groupBy(env).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumns({"_least": F.min("_n").over(Window.partitionBy()), "_all": F.sum("_n").over(Window.partitionBy())})
    ranked = ranked_in_buckets(rows, hash_order(seed, *keys), keys, (env,), "batch").join(F.broadcast(sizes), env)
    return ranked.where(F.col("batch") <= F.col("_least")).withColumn("weight", F.col("_n") / F.col("_all")).drop("_n", "_least", "_all")


def stratified_ids(rows: DataFrame, eligible: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` eligible securities, sectors by their share of rows: quotas half to even, capped, then trimmed or topped up by hash.

    ``rows(issue_id, sector)`` has every row; ``eligible(issue_id, sector)`` the securities to choose from.
    """
    share = rows.groupBy("sector").agg(F.count(F.lit(1)).alias("_c")).withColumn("_all", F.sum("_c").over(Window.partitionBy()))
    quota = share.select("sector", F.bround(F.col("_c") / F.col("_all") * n).cast("int").alias("_quota"))
    order = hash_order(seed, "issue_id")
    ranked = ranked_in_buckets(eligible, order, ["issue_id"], ("sector",), "_rank").join(F.broadcast(quota), "sector")
    first = F.when(F.col("_rank") <= F.col("_quota"), 0).otherwise(1)
    # Ids in quota come first, the others top up; n of them stay. Only ids are ordered.
    return ranked.withColumn("_first", first).orderBy("_first", order, "issue_id").limit(n).select("issue_id", "sector")


def least_correlated(df: DataFrame, value: str, first: str, last: str, k: int) -> DataFrame:
    """``k`` securities of the smallest mean absolute correlation with the others, over forward-filled prices of full-year securities."""
    from pricepanel.operators.calendar import full_year_ids

    inside = df.where(F.col("date").between(first, last)).join(full_year_ids(df, first, last), "issue_id", "left_semi")
    once = inside.groupBy("issue_id", "date").agg(F.avg(value).alias(value))
    dates, ids = once.select("date").distinct(), once.select("issue_id").distinct()
    grid = ids.crossJoin(F.broadcast(dates)).join(once, ["issue_id", "date"], "left")
    present = grid.withColumn("_share", F.avg(F.col(value).isNotNull().cast("int")).over(Window.partitionBy("issue_id"))).where("_share >= 0.5")
    order = Window.partitionBy("issue_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    filled = present.select("issue_id", "date", F.last(value, ignorenulls=True).over(order).alias("x"))
    means = mean_correlations(filled.groupBy("issue_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("date", "x"))), lambda s: s["x"]).alias("x")))
    return means.select("issue_id", F.round("mean_abs_corr", 9).alias("mean_abs_corr")).orderBy("mean_abs_corr", "issue_id").limit(k)


def calendar_series(df: DataFrame, value: str) -> DataFrame:
    """``(issue_id, at, x)``: each security's values that are there, and the places of their days among all days of the panel, in their order."""
    days = numbered(df.select("date").distinct(), "date").select("date", (F.col("_n") - 1).cast("int").alias("_at"))
    rows = df.select("issue_id", "date", F.col(value).alias("_x")).where("_x is not null").join(F.broadcast(days), "date")
    cells = rows.groupBy("issue_id").agg(F.sort_array(F.collect_list(F.struct("_at", "_x"))).alias("_c"))
    return cells.select("issue_id", F.col("_c._at").alias("at"), F.col("_c._x").alias("x"))


#: Bytes of one series block in a task, and securities of a block at most: a pair of blocks makes a few matrices of their product's size.
BLOCK_BYTES, BLOCK_SERIES = 32 << 20, 2048


def _block_pairs(series: DataFrame, block: int | None) -> DataFrame:
    """The series' columns and ``own, i, j``: the series of both blocks of each pair of blocks ``i <= j``.

    A block is as large as its bytes allow, since a series travels once for each block; few securities make smaller ones, so that all tasks have pairs.
    """
    size = series.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("long")).first()
    if not block:
        tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread = math.ceil(size["n"] / math.sqrt(2 * tasks))
        block = max(1, min(BLOCK_SERIES, BLOCK_BYTES // (8 * max(1, size["long"] or 1)), max(64, spread)))
    blocks = max(1, -(-size["n"] // block))
    own = F.pmod(F.xxhash64("issue_id"), F.lit(blocks)).cast("int")
    met = series.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    return met.select(*series.columns, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _products(a: list | np.ndarray, b: list | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common days and correlation of each series of ``a`` with each of ``b``; NaN where one of them stands still over the common days."""
    x, y = (np.array([np.array(v, float) for v in side]) for side in (a, b))
    m, k = (np.isfinite(v).astype(float) for v in (x, y))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # a series without any value has no mean
        x, y = (np.where(np.isfinite(v), v - np.nanmean(np.where(np.isfinite(v), v, np.nan), axis=1, keepdims=True), 0.0) for v in (x, y))
    n, sx, sy = m @ k.T, x @ k.T, m @ y.T
    xx, yy = (x * x) @ k.T, m @ (y * y).T
    left, right = n * xx - sx**2, n * yy - sy**2
    for spread, squares in ((left, xx), (right, yy)):
        spread[spread <= 1e-12 * n * squares] = np.nan
    return n, (n * (x @ y.T) - sx * sy) / np.sqrt(left * right)


def _none(**columns: type) -> pd.DataFrame:
    return pd.DataFrame({name: pd.Series(dtype=kind) for name, kind in columns.items()})


def mean_correlations(series: DataFrame, block: int | None = None) -> DataFrame:
    """``(issue_id, mean_abs_corr)`` of each security's correlations with all others, over ``series(issue_id, x)``: arrays over one calendar.

    Nulls are left out pair by pair; pairs without a correlation count for nothing. A task does the pairs of two blocks as products of matrices.
    """

    def correlated(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf[pdf["own"] == pdf["i"].iloc[0]]
        alone = pdf["i"].iloc[0] == pdf["j"].iloc[0]  # a block with itself has its own pairs, two blocks those across
        second = first if alone else pdf[pdf["own"] != pdf["i"].iloc[0]]
        if not len(first) or not len(second):
            return _none(issue_id=object, total=float, n=int)
        c = np.abs(_products(first["x"].tolist(), second["x"].tolist())[1])
        wanted = np.isfinite(c) & ~(np.eye(len(c), dtype=bool) if alone else np.zeros(c.shape, bool))
        c = np.where(wanted, c, 0.0)
        sides = [(first, c.sum(axis=1), wanted.sum(axis=1)), *([] if alone else [(second, c.sum(axis=0), wanted.sum(axis=0))])]
        return pd.concat([pd.DataFrame({"issue_id": pd.Series(s["issue_id"].tolist(), dtype=object), "total": t, "n": n}) for s, t, n in sides])

    met = _block_pairs(written(series, "series"), block)
    sums = met.groupBy("i", "j").applyInPandas(correlated, "issue_id string, total double, n long")
    return sums.groupBy("issue_id").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("mean_abs_corr")).where("mean_abs_corr is not null")


#: Bytes of a block of packed series and its securities at most, and bytes of a task's share of the blocks.
PACKED_BYTES, PART, SHARE_BYTES = 8 << 20, 1024, 64 << 20


def _packed(series: DataFrame) -> DataFrame:
    """``(issue_id, at, x)`` of ``series(issue_id, x)``, arrays over one calendar: the values that are there and their places."""
    if "at" in series.columns:
        return series
    there = F.filter(F.transform("x", lambda v, i: F.struct(i.alias("at"), v.alias("x"))), lambda c: c["x"].isNotNull())
    return series.select("issue_id", there.alias("_c")).select("issue_id", F.col("_c.at").alias("at"), F.col("_c.x").alias("x"))


def _blocks(packed: DataFrame, block: int | None) -> DataFrame:
    """``(own, series)``: a row for each block of packed series, as large as its bytes allow, or smaller where all tasks would not have pairs.

    Rows are dealt to parts that a task can hold two of, and to enough of them that pairs of parts occupy all tasks.
    """
    size = packed.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("x")).alias("mean")).first()
    tasks, bytes_ = packed.sparkSession.sparkContext.defaultParallelism, 12 * max(1.0, size["mean"] or 1.0)
    if not block:
        spread = math.ceil(size["n"] / math.sqrt(2 * tasks))
        block = max(1, min(PART, int(PACKED_BYTES / bytes_), max(64, spread)))
    blocks = max(1, -(-size["n"] // block))
    parts = min(blocks, max(math.ceil(4 * math.sqrt(tasks)), math.ceil(size["n"] * bytes_ / SHARE_BYTES)))
    own = F.pmod(F.xxhash64("issue_id"), F.lit(blocks)).cast("int").alias("own")
    return written(packed.groupBy(own).agg(F.collect_list(F.struct("issue_id", "at", "x")).alias("series")), "blocks").repartition(parts)


def _dense(series: pa.StructArray, days: int) -> np.ndarray:
    """A row for each packed series over ``days`` days, NaN where it has no value."""
    at, out = series.field("at"), np.full((len(series), days), np.nan)
    out[np.repeat(np.arange(len(series)), at.value_lengths().to_numpy()), at.flatten().to_numpy()] = series.field("x").flatten().to_numpy()
    return out


def pair_correlations(series: DataFrame, block: int | None = None) -> DataFrame:
    """``(id_a, id_b, n, c)`` of all pairs ``id_a < id_b`` with common days: their number and the correlation over them, null where there is none.

    The pairs are the result. Series are shuffled once, into blocks, of which only the values that are there travel; a task reads two parts of the blocks
    and spreads a pair of blocks over the calendar, so what is written grows with the series and not with their pairs.
    """

    def correlated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                first, second = (batch.column(side)[k].values for side in ("left", "right"))
                alone = batch.column("i")[k] == batch.column("j")[k]
                days = 1 + max(max((pc.max(side.field("at").flatten()).as_py() or 0) for side in (first, second)), 0)
                x = _dense(first, days)
                n, c = _products(x, x if alone else _dense(second, days))
                one, other = np.nonzero((n > 0) & (np.triu(np.ones(n.shape, bool), 1) if alone else True))
                n, c = n[one, other].astype(int), c[one, other]
                a, b = first.field("issue_id").take(pa.array(one)), second.field("issue_id").take(pa.array(other))
                lower = pc.less(a, b)
                ids = [pc.if_else(lower, a, b), pc.if_else(lower, b, a)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(n), pa.array(c, mask=np.isnan(c))], ["id_a", "id_b", "n", "c"])

    blocks = _blocks(written(_packed(series), "series"), block)
    left, right = (blocks.select(F.col("own").alias(n), F.col("series").alias(side)) for n, side in (("i", "left"), ("j", "right")))
    met = left.hint("shuffle_replicate_nl").join(right, F.col("i") <= F.col("j"))
    return met.mapInArrow(correlated, "id_a string, id_b string, n long, c double")


def round_robin(candidates: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` origins, one per security in turn, in hash order."""
    turn = F.row_number().over(Window.partitionBy("issue_id").orderBy(hash_order(seed, "issue_id", "origin_date"), "origin_date"))
    return candidates.withColumn("turn", turn).orderBy("turn", "issue_id").limit(n)


def expanded(origins: DataFrame, paths: int, batch: int) -> DataFrame:
    """Each origin ``paths`` times, ``batch`` rows in all, by ``(issue_id, origin_date, iteration)``."""
    rows = origins.select("*", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))).alias("iteration"))
    return rows.orderBy("issue_id", "origin_date", "iteration").limit(batch)


def first_valid(paths: DataFrame, valid: str, keys: list[str], k: int, seed: int) -> DataFrame:
    """The first ``k`` valid paths in hash order."""
    return paths.where(valid).orderBy(hash_order(seed, *keys), *keys).limit(k)


def mean_of_duplicates(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy("issue_id", "date").agg(F.avg(value).alias(value))


def evenly_spaced(ids: DataFrame, k: int = 3) -> DataFrame:
    """Up to ``k`` ids at evenly spaced ranks."""
    ranked = numbered(ids.select("issue_id").distinct(), "issue_id").withColumn("_n", F.col("_n") - 1)
    spots = [F.floor(F.lit(i) * (F.col("_all") - 1) / (k - 1)) for i in range(k)]
    return ranked.where(F.col("_n").isin(*spots)).select("issue_id")


def first_per_group(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_n = 1").drop("_n")
