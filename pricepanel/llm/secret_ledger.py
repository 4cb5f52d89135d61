"""Secret scans with an incremental blob ledger, in Spark expressions only.

Every version of a text is addressed by the SHA-256 of its content. The ledger keeps which blob was scanned under which rule
version and the spans found; ingesting history scans only unseen pairs, one copy of each blob, and a report joins the findings back to
all versions of all paths.

A rule is a pattern and a test of its matches: matches are leftmost and don't overlap, those failing the test are dropped after they have
taken their text. Spans are code points, end exclusive.

Defined results: null counts as empty text; empty texts have no spans; rows that repeat a path and version are reported each;
null paths are reported; a batch ingested again changes nothing; very long texts are scanned whole; an empty table gives an empty
report; extra columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricepanel.llm.common import sources, written


@dataclass(frozen=True)
class Rule:
    """Spans of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # Runs of one class begin and end at its edges, so a shortest length in the pattern drops the same matches as a later test.
    Rule("access", 1, r"(AKIA[A-Z0-9]{16,})", 1, 20),
    Rule("hex", 1, r"([0-9a-f]{24,})", 1, 24),
)


def scan(texts: DataFrame, rules: tuple[Rule, ...], key: str = "blob") -> DataFrame:
    """``(key, kind, version, start, end)`` of ``texts(key, text, due)``, where a key may repeat with its text; ``due`` has the kinds to scan a text for."""
    lengths = lambda parts: F.transform(parts, F.length)
    none = F.array().cast("array<struct<rule:int,i:int,gap:int,size:int,tested:int>>")

    def places(k: int, r: Rule) -> Column:
        # What stands between matches and the matches themselves take turns, so running sums of lengths give places.
        parts = F.arrays_zip(
            lengths(F.split("text", r.pattern, -1)).alias("gap"),
            lengths(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).alias("size"),
            lengths(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))).alias("tested"),
        )
        numbered = F.transform(parts, lambda p, i: F.struct(F.lit(k).alias("rule"), i.alias("i"), p["gap"].alias("gap"), p["size"].alias("size"), p["tested"].alias("tested")))
        # The text is tested only where the scan is due, which the ledger says: the test can't move ahead of the ledger's join.
        return F.when(F.array_contains("due", r.kind) & F.col("text").rlike(r.pattern), numbered).otherwise(none)

    # Each text is read once for all rules; only places travel from here, no text.
    rows = texts.select(key, F.explode(F.concat(*(places(k, r) for k, r in enumerate(rules)))).alias("p")).select(key, "p.*")
    # Equal rows of a path and version bring a text more than once: each place counts once.
    rows = rows.dropDuplicates([key, "rule", "i"])
    before = F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(Window.partitionBy(key, "rule").orderBy("i"))
    of = lambda field: F.element_at(F.array(*(F.lit(getattr(r, field)) for r in rules)), F.col("rule") + 1)
    placed = rows.withColumn("end", before).where(F.col("tested") >= of("least"))
    return placed.select(key, of("kind").alias("kind"), of("version").alias("version"), (F.col("end") - F.col("size")).alias("start"), "end")


class Ledger:
    """The ledger at ``path``, a folder that driver and executors share: ``versions``, ``scanned`` and ``findings``."""

    VERSIONS = "batch string, path long, version long, blob string"
    SCANNED = "batch string, blob string, kind string, version int"
    FINDINGS = "batch string, blob string, kind string, version int, start long, end long"

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES) -> None:
        self.spark, self.path, self.rules = spark, path.rstrip("/"), rules
        self.batches: list[str] = self._complete()

    def _complete(self) -> list[str]:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/scanned")
        fs = root.getFileSystem(conf)
        if not fs.exists(root):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{s.getPath()}/_SUCCESS")))

    def _table(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{name}/{b}" for b in self.batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ingest(self, batch: str, history: DataFrame) -> DataFrame:
        """Take in ``history(path, version, text)``; returns the pairs of blob and kind that were unseen.

        The scan marks are written last: a batch without them was cut short, counts as absent and is ingested anew.
        """
        name = f"batch={batch}"
        if name in self.batches:
            return self.spark.createDataFrame([], "blob string, due array<string>")
        texts = sources(history, "path", "version", "text").withColumn("text", F.coalesce("text", F.lit("")))
        addressed = texts.select("path", "version", F.sha2("text", 256).alias("blob"))
        addressed.write.mode("overwrite").parquet(f"{self.path}/versions/{name}")
        own = self.spark.read.parquet(f"{self.path}/versions/{name}")
        first = own.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at"))
        rules = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in self.rules))
        pairs = first.select("blob", "at", F.explode(rules).alias("r")).select("blob", "at", "r.*")
        unseen = pairs.join(self._table("scanned", self.SCANNED), ["blob", "kind", "version"], "left_anti") if self.batches else pairs
        due = written(unseen.groupBy("blob", "at.path", "at.version").agg(F.collect_set("kind").alias("due")), "unseen-blobs")
        # Only one path and version of each unseen blob travels; where they repeat, the blob is checked again and equal rows all come.
        copies = texts.join(due, texts["path"].eqNullSafe(due["path"]) & texts["version"].eqNullSafe(due["version"]))
        copies = copies.where(F.sha2("text", 256) == F.col("blob")).select("blob", "text", "due")
        spans = scan(copies, self.rules).distinct()
        spans.write.mode("overwrite").parquet(f"{self.path}/findings/{name}")
        versions = F.create_map(*(x for r in self.rules for x in (F.lit(r.kind), F.lit(r.version))))
        marks = due.select("blob", F.explode("due").alias("kind")).withColumn("version", versions[F.col("kind")])
        marks.write.mode("overwrite").parquet(f"{self.path}/scanned/{name}")
        self.batches = self._complete()
        return due.select("blob", "due")

    def report(self) -> DataFrame:
        """``path, version, n_<kind> per rule, spans`` (structs of start, order, kind, end by place) for every version of every path."""
        current = F.lit(False)
        for r in self.rules:
            current |= (F.col("kind") == r.kind) & (F.col("version") == r.version)
        order = F.create_map(*(x for i, r in enumerate(self.rules) for x in (F.lit(r.kind), F.lit(i))))
        found = self._table("findings", self.FINDINGS).where(current)
        spans = F.sort_array(F.collect_list(F.struct("start", order[F.col("kind")].alias("order"), "kind", "end"))).alias("spans")
        counts = [F.count(F.when(F.col("kind") == r.kind, 1)).alias(f"n_{r.kind}") for r in self.rules]
        blobs = written(found.groupBy("blob").agg(*counts, spans), "findings-by-blob")
        versions = self._table("versions", self.VERSIONS)
        none = F.array().cast(blobs.schema["spans"].dataType)
        return versions.join(blobs, "blob", "left").select(
            "path", "version", "blob", *(F.coalesce(f"n_{r.kind}", F.lit(0)).alias(f"n_{r.kind}") for r in self.rules), F.coalesce("spans", none).alias("spans")
        )
