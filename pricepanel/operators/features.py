"""Rolling features per security. Each takes a panel and returns it with one more column; ``drop`` says which remove rows.

All windows are trailing ROWS frames over one partitioning by security, so a chain of features is one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricepanel.functions.expressions import full, ordered, ratio, running, trailing


def _kept(df: DataFrame, dst: str, value: Column, drop: bool = True) -> DataFrame:
    out = df.withColumn(dst, value)
    return out.where(F.col(dst).isNotNull()) if drop else out


def _previous(src: str, n: int = 1) -> Column:
    return F.lag(src, n).over(ordered())


def log_value(df: DataFrame, src: str, dst: str) -> DataFrame:
    return _kept(df, dst, F.when(F.col(src) > 0, F.ln(src)))


def sum_of(df: DataFrame, srcs: tuple[str, ...], dst: str, drop: bool = True) -> DataFrame:
    total = F.col(srcs[0])
    for c in srcs[1:]:
        total = total + F.col(c)
    return _kept(df, dst, total, drop)


def close_volatility(df: DataFrame, src: str, dst: str, window: int = 21, least: int = 4) -> DataFrame:
    """Sample deviation of forward-filled log returns over the window, from ``least`` of them on."""
    df = df.withColumn("_r", F.when((F.col(src) > 0) & (_previous(src) > 0), F.ln(F.col(src) / _previous(src))))
    df = df.withColumn("_r", F.last("_r", ignorenulls=True).over(running()))
    w = trailing(window)
    return _kept(df, dst, F.when(F.count("_r").over(w) >= least, F.stddev_samp("_r").over(w))).drop("_r")


def hurst(df: DataFrame, src: str, dst: str, window: int = 21) -> DataFrame:
    """ln(range of the cumulated deviations / population deviation) / ln(n)."""
    df = df.withColumn("_w", full(F.collect_list(src).over(trailing(window)), src, window))
    zero = F.struct(F.lit(0.0).alias("at"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(0.0).alias("sq"))

    def step(a: Column, off: Column) -> Column:
        at = a["at"] + off
        return F.struct(at.alias("at"), F.least(a["lo"], at).alias("lo"), F.greatest(a["hi"], at).alias("hi"), (a["sq"] + off * off).alias("sq"))

    def ended(a: Column) -> Column:
        spread, deviation = a["hi"] - a["lo"], F.sqrt(a["sq"] / window)
        return F.when((deviation > 1e-12) & (spread > 0), F.ln(spread / deviation) / F.ln(F.lit(float(window))))

    # The mean is bound once, as the lambda's argument: as a column, a filter on the result takes it into every step of the fold.
    mean = F.aggregate("_w", F.lit(0.0), lambda a, x: a + x) / window
    folded = F.transform(F.array(mean), lambda m: F.aggregate(F.transform("_w", lambda x: x - m), zero, step, ended))
    return _kept(df, dst, F.get(folded, F.lit(0)) if window >= 20 else F.lit(None).cast("double")).drop("_w")


def sma_ratio(df: DataFrame, src: str, dst: str, short: int, long: int) -> DataFrame:
    return _kept(df, dst, full(ratio(F.avg(src).over(trailing(short)), F.avg(src).over(trailing(long))), src, long))


def _with_return(df: DataFrame, src: str) -> DataFrame:
    return df.withColumn("_r", ratio(F.col(src), _previous(src)) - 1)


def min_return(df: DataFrame, src: str, dst: str, window: int = 21) -> DataFrame:
    return _kept(_with_return(df, src), dst, full(F.min("_r").over(trailing(window)), "_r", window)).drop("_r")


def max_return(df: DataFrame, src: str, dst: str, window: int = 21) -> DataFrame:
    return _kept(_with_return(df, src), dst, full(F.max("_r").over(trailing(window)), "_r", window), drop=False).drop("_r")


def cumulative_return(df: DataFrame, src: str, dst: str, window: int = 21) -> DataFrame:
    return _kept(df, dst, ratio(F.col(src), _previous(src, window)) - 1)


def percent_b(df: DataFrame, src: str, dst: str, window: int = 21, width: float = 2.0) -> DataFrame:
    w = trailing(window)
    mean, deviation = F.avg(src).over(w), F.stddev_samp(src).over(w)
    return _kept(df, dst, full(ratio(F.col(src) - (mean - width * deviation), 2 * width * deviation), src, window))


def rsi(df: DataFrame, src: str, dst: str, window: int = 14) -> DataFrame:
    df = df.withColumn("_d", F.col(src) - _previous(src))
    w = trailing(window)
    gain, loss = F.avg(F.greatest("_d", F.lit(0.0))).over(w), F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(w)
    return _kept(df, dst, full(100 - 100 / (1 + gain / (loss + 1e-6)), "_d", window)).drop("_d")


def on_balance_volume(df: DataFrame, src: str, volume: str, dst: str) -> DataFrame:
    signed = F.coalesce(F.signum(F.col(src) - _previous(src)) * F.col(volume), F.lit(0.0))
    return df.withColumn("_v", signed).withColumn(dst, F.sum("_v").over(running())).drop("_v")


def forward_fill(df: DataFrame, src: str, dst: str) -> DataFrame:
    return df.withColumn(dst, F.last(src, ignorenulls=True).over(running()))


def smoothed(df: DataFrame, src: str, dst: str, window: int = 20) -> DataFrame:
    return df.withColumn(dst, F.avg(src).over(trailing(window)))


def rolling_volatility(df: DataFrame, src: str, dst: str, window: int = 20) -> DataFrame:
    """Population deviation of simple returns, full windows only."""
    return _kept(_with_return(df, src), dst, full(F.stddev_pop("_r").over(trailing(window)), "_r", window)).drop("_r")


def drawdown(df: DataFrame, src: str, dst: str) -> DataFrame:
    return df.withColumn(dst, 1 - F.col(src) / F.max(src).over(running()))


def lags(df: DataFrame, src: str) -> DataFrame:
    return df.withColumn("previous", _previous(src)).withColumn("change", F.col(src) - _previous(src))


#: Features by name over the columns of the panel; ``close`` is the price column to read.
REGISTRY: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "LogClAdjLoc": lambda df, close: log_value(df, close, "LogClAdjLoc"),
    "SumOpClAdjLoc": lambda df, close: sum_of(df, (close, "op_adj_loc"), "SumOpClAdjLoc"),
    "OpClAdjUsdSum": lambda df, close: sum_of(df, (close, "op_adj_loc"), "OpClAdjUsdSum", drop=False),
    "Cl1mVol": lambda df, close: close_volatility(df, close, "Cl1mVol"),
    "Hurst1m": lambda df, close: hurst(df, close, "Hurst1m"),
    "Sma50x200": lambda df, close: sma_ratio(df, close, "Sma50x200", 50, 200),
    "Sma50x100": lambda df, close: sma_ratio(df, close, "Sma50x100", 50, 100),
    "Sma100x200": lambda df, close: sma_ratio(df, close, "Sma100x200", 100, 200),
    "Min1dRet1m": lambda df, close: min_return(df, close, "Min1dRet1m"),
    "Max1dRet1m": lambda df, close: max_return(df, close, "Max1dRet1m"),
    "CumRet1m": lambda df, close: cumulative_return(df, close, "CumRet1m"),
    "PctBb": lambda df, close: percent_b(df, close, "PctBb"),
    "Rsi14": lambda df, close: rsi(df, close, "Rsi14"),
    "OnBalanceVolume": lambda df, close: on_balance_volume(df, close, "vo_adj", "OnBalanceVolume"),
}


def add_features(df: DataFrame, names: list[str], close: str = "cl_adj_loc") -> DataFrame:
    """Features in the order given; columns that exist are skipped, unknown names are an error, each works on what the last one kept."""
    if unknown := [n for n in names if n not in REGISTRY and n not in df.columns]:
        raise ValueError(f"unknown features: {unknown}")
    for name in names:
        if name not in df.columns:
            df = REGISTRY[name](df, close)
    return df
