"""A price panel stored by buckets of securities and sorted within them.

Reads of some securities list only the buckets that these hash to, and the filters reach the row groups' statistics, as ids are stored as the text that
they are compared with. What is grouped, windowed or joined by security starts on the stored partitioning, without an exchange; joins by security
and date do so too under ``spark.sql.requireAllClusterKeysForCoPartition=false``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY, ORDER = "issue_id", "date"


class PanelStore:
    """The table at ``path``; ``path-layout`` says how it is laid out, so that any session can open it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        """Opens a store that was written before."""
        layout = spark.read.json(f"{path}-layout").first()
        self.spark, self.path, self.buckets = spark, path, layout["buckets"]
        self.table = f"panel_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} ({layout['columns']}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}, {ORDER}) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    @classmethod
    def write(cls, panel: DataFrame, path: str, buckets: int | None = None) -> PanelStore:
        """Writes a panel with ``issue_id`` and ``date``; one file a bucket, as many buckets as the session has shuffle partitions by default."""
        spark = panel.sparkSession
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows, name = panel.withColumn(KEY, F.col(KEY).cast("string")), f"panel_{uuid.uuid4().hex}"
        rows.repartition(n, KEY).write.bucketBy(n, KEY).sortBy(KEY, ORDER).option("path", path).saveAsTable(name)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        spark.createDataFrame([(n, columns)], "buckets int, columns string").coalesce(1).write.mode("overwrite").json(f"{path}-layout")
        spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
        return cls(spark, path)

    def read(self, ids: list[str] | None = None, start: str | None = None, end: str | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
        """Rows of some securities between two days, both included; each is pushed to the scan."""
        df = self.spark.table(self.table)
        if ids is not None:
            df = df.where(F.col(KEY).isin([str(i) for i in ids]))
        if start:
            df = df.where(F.col(ORDER) >= F.lit(start).cast("date"))
        if end:
            df = df.where(F.col(ORDER) <= F.lit(end).cast("date"))
        return df.select(*columns) if columns else df
