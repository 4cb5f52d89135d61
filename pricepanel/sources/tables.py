"""Sources and sinks: market files, wide vendor files, path artifacts, id lists, run folders and result tables.

Paths go through Spark's readers and the Hadoop file API only, so any store that Spark reads will do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricepanel.functions.storage import written
from pricepanel.operators.panel import panel

#: Types of known columns of the market files; others are read as text.
MARKET_TYPES = {"ClAdjLoc": "double", "OpAdjLoc": "double", "LoAdjLoc": "double", "HiAdjLoc": "double", "ClAdjUsd": "double", "OpAdjUsd": "double", "VoAdj": "double", "Date": "date"}
REQUIRED = ("issue_id", "date", "cl_adj_loc")


def _names(spark: SparkSession, folder: str) -> list[str]:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path))


def market_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every tab-separated ``.csv`` or ``.txt`` of a folder by its stem; ids stay text, numbers and dates are typed leniently."""
    out = {}
    for name in _names(spark, folder):
        if name.endswith((".csv", ".txt")):
            raw = spark.read.csv(f"{folder}/{name}", sep="\t", header=True, inferSchema=False)
            typed = [F.expr(f"try_cast(`{c}` AS {MARKET_TYPES[c]})").alias(c) if c in MARKET_TYPES else F.col(f"`{c}`") for c in raw.columns]
            out[name.rsplit(".", 1)[0]] = raw.select(*typed)
    return out


def checked(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df


def price_panel(raw: DataFrame) -> DataFrame:
    """``issue_id, date, cl_adj_loc`` of a market price table."""
    return raw.select(F.col("IssueId").cast("string").alias("issue_id"), F.col("Date").alias("date"), F.col("ClAdjLoc").alias("cl_adj_loc"))


def two_header_csv(spark: SparkSession, path: str, column: str, issue_id: str) -> DataFrame:
    """One instrument of a file with two header rows: the first names the columns, the second is skipped; bad rows are dropped."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    first = raw.columns[0]
    rows = raw.select(F.lit(issue_id).alias("issue_id"), F.expr(f"try_cast(`{first}` AS date)").alias("date"), F.expr(f"try_cast(`{column}` AS double)").alias("cl_adj_loc"))
    return rows.dropna(subset=["date", "cl_adj_loc"])


def date_column(columns: list[str]) -> str:
    """The date column by its name: an exact one first, else the first whose name contains date or time."""
    lower = {c.lower(): c for c in reversed(columns)}
    for exact in ("index", "datetime", "date"):
        if exact in lower:
            return lower[exact]
    if found := [c for c in columns if "date" in c.lower() or "time" in c.lower()]:
        return found[0]
    raise ValueError(f"no date column among {columns}")


def wide_to_panel(wide: DataFrame, tickers: list[str] | None = None, end: str | None = None) -> DataFrame:
    """``Close_<ticker>`` columns as a long panel; a file of one ticker may call it ``Close``. ``end`` is the last day to keep."""
    date = date_column(wide.columns)
    closes = [c for c in wide.columns if c.startswith("Close")]
    if not closes:
        raise ValueError("no Close column")
    if tickers:
        closes = [f"Close_{t}" if f"Close_{t}" in closes else closes[0] for t in tickers]
    long = wide.select(F.to_date(date).alias("date"), *dict.fromkeys(closes)).unpivot(["date"], list(dict.fromkeys(closes)), "name", "cl_adj_loc")
    ticker = F.regexp_extract("name", r"^Close_(.*)$", 1)
    named = F.when(ticker == "", F.lit(tickers[0] if tickers else "Close")).otherwise(ticker)
    rows = long.select(named.alias("issue_id"), "date", F.col("cl_adj_loc").cast("double").alias("cl_adj_loc")).where("cl_adj_loc is not null")
    return rows.where(F.col("date") < F.date_add(F.lit(end).cast("date"), 1)) if end else rows


def wide_lines_to_panel(spark: SparkSession, path: str, end: str | None = None, sep: str = ",") -> DataFrame:
    """:func:`wide_to_panel` for files of any width: ``Close_<ticker>`` columns of plain numbers, read as lines.

    A line is cut into an array and unpivoted in its task; a cell finds its ticker by its place in the header of its own file. So neither the
    columns nor the tickers become part of the plan or come to the driver. Cells that are no number, and lines whose day is no date, are left out.
    Files go by number through the join with their headers, as their paths would be most of its bytes.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    # A file's first line is the first one of its first block.
    headers = written(lines.where("_block = 0").groupBy("file").agg(F.min_by("value", "_id").alias("header")), "headers")
    files = headers.select("file", F.row_number().over(Window.orderBy("file")).alias("_file"))  # a row for each file
    names = headers.join(F.broadcast(files), "file").select("_file", F.posexplode(F.split("header", F.lit(sep))).alias("place", "name"))
    low = F.lower("name")
    rank = F.when(low == "index", 0).when(low == "datetime", 1).when(low == "date", 2).when(low.contains("date") | low.contains("time"), 3)
    dates = names.where(rank.isNotNull()).groupBy("_file").agg(F.min(F.struct(rank.alias("rank"), "place")).alias("d")).select("_file", F.col("d.place").alias("_date"))
    closes = names.where(F.col("name").startswith("Close")).select("_file", "place", F.when(F.col("name") == "Close", "Close").otherwise(F.regexp_extract("name", r"^Close_(.*)$", 1)).alias("issue_id"))
    cells = F.split("value", F.lit(sep))
    known = files.join(dates, "_file")
    rows = lines.join(F.broadcast(known), "file").select("_file", F.expr("try_cast(split(value, :sep)[_date] AS date)".replace(":sep", repr(sep))).alias("date"), cells.alias("cells")).where("date is not null")
    if end:
        rows = rows.where(F.col("date") < F.date_add(F.lit(end).cast("date"), 1))
    long = rows.select("_file", "date", F.posexplode("cells").alias("place", "_text")).where("_text <> ''")
    long = long.select("_file", "date", "place", F.expr("try_cast(_text AS double)").alias("cl_adj_loc"))
    return long.where("cl_adj_loc is not null").join(closes, ["_file", "place"]).select("issue_id", "date", "cl_adj_loc")


def user_frame(df: DataFrame) -> DataFrame:
    """A caller's frame: ``ticker`` may stand for the id, dates are cast leniently, required columns are checked."""
    if "ticker" in df.columns and "issue_id" not in df.columns:
        df = df.withColumnRenamed("ticker", "issue_id")
    return checked(df).withColumn("date", F.expr("try_cast(date AS date)")).where("date is not null")


def filtered_prices(prices: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    """Three columns of some securities; a long id list is a table and joins, a short one is pushed down."""
    rows = prices.select("issue_id", "date", "cl_adj_loc")
    return rows.where(F.col("issue_id").isin(ids)) if isinstance(ids, list) else rows.join(ids.select("issue_id").distinct(), "issue_id", "left_semi")


def synthetic_paths(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """A long CSV of made paths: trimmed ids, lenient dates and numbers, rows with nulls dropped, inclusive dates."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    checked(raw, ("IssueId", "Date", "ClAdjLoc"))
    rows = raw.select(F.trim("IssueId").alias("issue_id"), F.expr("try_cast(Date AS date)").alias("date"), F.expr("try_cast(ClAdjLoc AS double)").alias("cl_adj_loc"))
    return rows.dropna().where(F.col("date").between(start, end))


def path_records(df: DataFrame) -> DataFrame:
    """Standard artifact: padded prices cut to their own length."""
    checked(df, ("sample_id", "original_price", "original_price_len"))
    return df.withColumn("original_price", F.slice("original_price", 1, F.col("original_price_len"))).drop("original_price_len")


def monte_carlo_records(origins: DataFrame, paths: DataFrame) -> DataFrame:
    """Star artifact: every path with its base sample. A legacy file has no ``base_sample_id``: it has one base sample, 0."""
    if "base_sample_id" not in paths.columns:
        paths = paths.withColumn("base_sample_id", F.lit(0))
    if paths.join(origins, "base_sample_id", "left_anti").limit(1).count():
        raise ValueError("paths without a base sample")
    return paths.join(origins, "base_sample_id")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id per line, blank lines skipped."""
    return spark.read.text(path).select(F.trim("value").alias("issue_id")).where("issue_id <> ''")


def write_id_list(ids: DataFrame, path: str) -> None:
    ids.select(F.col("issue_id").cast("string").alias("value")).write.mode("overwrite").text(path)


def write_long_paths(paths: DataFrame, path: str) -> None:
    """Array-valued paths as one CSV row per step, with a header."""
    rows = paths.select(*(c for c in paths.columns if c != "prices"), F.posexplode("prices").alias("step", "price"))
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_artifact(df: DataFrame, path: str) -> None:
    """Arrays and scalars of samples as compressed Parquet."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_steps(steps: DataFrame, path: str) -> None:
    """Step rows as compressed CSV, a folder per source."""
    steps.write.mode("overwrite").partitionBy("source").option("compression", "gzip").option("header", True).csv(path)


def write_tables(tables: dict[str, DataFrame], folder: str, manifest: dict[str, str]) -> None:
    """Each named table as CSV, beside a manifest of one JSON row."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([tuple(manifest.values())], list(manifest)).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def run_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame | None]:
    """Optional tables of a run's variants (``variant=<name>`` folders): epoch metrics and finals; an absent one is None."""
    out: dict[str, DataFrame | None] = {}
    variants = [n for n in _names(spark, folder) if n.startswith("variant=")]
    for name, read in (("epoch_metrics", lambda p: spark.read.csv(p, header=True, inferSchema=True)), ("val_metrics", spark.read.json)):
        found = [v for v in variants if any(n.startswith(name) for n in _names(spark, f"{folder}/{v}"))]
        frames = [read(f"{folder}/{v}/{name}").withColumn("variant", F.lit(v.split("=", 1)[1])) for v in found]
        out[name] = None
        for f in frames:
            out[name] = f if out[name] is None else out[name].unionByName(f, allowMissingColumns=True)
    return out


#: Loaders by source and type.
LOADERS: dict[tuple[str, str], Callable[[SparkSession, str], DataFrame]] = {
    ("local", "US_Stocks"): lambda spark, at: price_panel(market_tables(spark, at)["security_data"]),
    ("local", "RX1"): lambda spark, at: two_header_csv(spark, f"{at}/rx1.csv", "RX1", "RX1"),
    ("driver", "panel"): panel,
}


def load(spark: SparkSession, source: str, kind: str, at: str) -> DataFrame:
    if (source, kind) not in LOADERS:
        raise ValueError(f"unknown loader {source}/{kind}; there are {sorted(LOADERS)}")
    return checked(LOADERS[source, kind](spark, at))
