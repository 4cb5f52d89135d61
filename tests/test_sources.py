"""The bucketed panel store by its plans, wide files of any width, and table functions in SQL."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricepanel.operators import calendar as cal
from pricepanel.operators import joins as jn
from pricepanel.operators import user_functions as uf
from pricepanel.sources import tables as st
from pricepanel.sources.store import PanelStore


@pytest.fixture(scope="module")
def panel(spark):
    day = F.date_add(F.lit("2017-01-02").cast("date"), F.col("id").cast("int") % 500)
    rows = spark.range(20_000).select((F.col("id") % 40).cast("long").alias("issue_id"), day.alias("date"), (F.col("id") % 97 + 1).cast("double").alias("cl_adj_loc"), F.lit(1.0).alias("vo_adj"))
    return rows.dropDuplicates(["issue_id", "date"])


@pytest.fixture(scope="module")
def store(panel, tmp_path_factory):
    return PanelStore.write(panel, str(tmp_path_factory.mktemp("store") / "panel"), 8)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_store_gives_back_the_panel(spark, panel, store):
    want = rows_of(panel.withColumn("issue_id", F.col("issue_id").cast("string")))
    assert rows_of(store.read()) == want and rows_of(PanelStore(spark, store.path).read()) == want
    some = store.read(["3", "17"], "2017-03-01", "2017-06-30", ("issue_id", "date"))
    assert rows_of(some) == rows_of(panel.where("issue_id in (3, 17) and date between '2017-03-01' and '2017-06-30'").select(F.col("issue_id").cast("string"), "date"))
    assert store.read([]).count() == 0


def test_filters_columns_and_buckets_reach_the_scan(store):
    found = plan(st.filtered_prices(store.read(start="2017-03-01"), ["3", "17"]))
    assert "PushedFilters: [" in found and "In(issue_id, [" in found and "GreaterThanOrEqual(date,2017-03-01)" in found
    grouped = store.read(["3", "17"]).groupBy("issue_id").count()
    mode = grouped.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    assert "SelectedBucketsCount: 2 out of 8" in grouped._jdf.queryExecution().explainString(mode) and "Exchange" not in plan(grouped)
    assert "vo_adj" not in found.split("ReadSchema")[1]


def test_joins_and_windows_start_without_an_exchange(spark, store):
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = store.read()
        sectors = PanelStore.write(rows.select("issue_id").distinct().withColumns({"date": F.lit("2017-01-02").cast("date"), "sector": F.lit("x")}), store.path + "-sectors", 8).read(columns=("issue_id", "sector"))
        origins = cal.segment_origins(rows, 20, 5, "2017-01-01", "2019-12-31")
        for df in (jn.many_to_one(rows, sectors, ["issue_id"]), jn.realised_future(origins, rows, 5), jn.origin_windows(origins, rows, 20, 5)):
            assert "hashpartitioning" not in plan(df) and df.count() > 0
    finally:
        for key in ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)


def test_wide_file_of_50000_columns(spark, tmp_path):
    n = 50_000
    lines = ["Datetime," + ",".join(f"Close_t{i}" for i in range(n))]
    lines += [f"2020-01-{d:02d}," + ",".join("" if (i + d) % 10 else f"{i}.{d}" for i in range(n)) for d in (1, 2, 3)] + ["nonsense," + "1," * n]
    (tmp_path / "wide.csv").write_text("\n".join(lines) + "\n")
    df = st.wide_lines_to_panel(spark, str(tmp_path), "2020-01-02")
    assert len(plan(df)) < 20_000
    got = df.agg(F.count(F.lit(1)), F.countDistinct("issue_id"), F.min("date").cast("string"), F.max("date").cast("string"), F.sum("cl_adj_loc")).first()
    want = [(i, float(f"{i}.{d}")) for d in (1, 2) for i in range(n) if (i + d) % 10 == 0]
    assert tuple(got)[:4] == (len(want), len({i for i, _ in want}), "2020-01-01", "2020-01-02") and abs(got[4] - sum(v for _, v in want)) < 1e-3


def test_wide_files_with_headers_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,Close_q,Date,Close_r\n9,1.5,2020-01-01,\n9,bad,2020-01-02,2\n")
    (tmp_path / "b.csv").write_text("Close,time_of_day,datetime\n3,08:00,2020-01-03\n")
    assert rows_of(st.wide_lines_to_panel(spark, str(tmp_path)).withColumn("date", F.col("date").cast("string"))) == sorted(map(repr, [("q", "2020-01-01", 1.5), ("r", "2020-01-02", 2.0), ("Close", "2020-01-03", 3.0)]))


def test_table_function_sees_partitions_in_order(spark):
    def falls(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[pdf["price"].diff() < 0][["step", "price"]]

    rows = spark.createDataFrame([(k, s, float((s * 7 + k) % 5)) for k in range(30) for s in range(20)], "k int, step long, price double").repartition(7)
    uf.table_function(spark, "falls", falls, {"k": "int"}, "step long, price double")
    found = spark.sql("SELECT * FROM falls(TABLE(SELECT * FROM {rows}) PARTITION BY k ORDER BY step) WHERE k < 3", rows=rows)
    want = [(k, s, float((s * 7 + k) % 5)) for k in range(3) for s in range(1, 20) if (s * 7 + k) % 5 < ((s - 1) * 7 + k) % 5]
    assert sorted(map(tuple, found.collect())) == want
    assert spark.sql("SELECT * FROM falls(TABLE(SELECT * FROM {rows}) PARTITION BY k ORDER BY step)", rows=rows.limit(0)).count() == 0


def test_scratch_tables_can_be_dropped(spark, tmp_path):
    from pricepanel.functions import storage

    kept = spark.range(5)
    kept.write.parquet(str(tmp_path / "kept"))
    before = dict(storage._HANDED_OUT)
    storage._HANDED_OUT.clear()  # what other tests wrote stays
    try:
        tables = [storage.written(spark.range(n), "dropped") for n in (3, 4)]
        assert [t.count() for t in tables] == [3, 4] and storage.drop_scratch(spark) == 2 and storage.drop_scratch(spark) == 0
        with pytest.raises(Exception, match="(?i)file|path"):
            tables[0].collect()
        assert spark.read.parquet(str(tmp_path / "kept")).count() == 5
    finally:
        storage._HANDED_OUT.update(before)
