"""Delta-maintained token counts by source, language and tokenizer version.

A store has a ledger of batches. A batch holds changes ``(op, doc_id, tokenizer, source, lang, tokens)`` with op ``insert``,
``delete`` or ``revise``; each becomes signed rows of the ledger: an insert adds its facts, a delete takes the current
ones away, a revision does both. Totals are sums of signed rows, so they need no recount and any order of batches gives the same.

A batch is written in a folder of its own name and counts once that folder is complete, so a repeated commit changes nothing,
and one that a lost driver left half-way is written anew. The ledger is laid out by ``PARTS`` hash parts of the document id, sorted within them, and a commit reads only
the parts that its own documents are in. :meth:`Rollups.compact` folds committed batches into one: the list of its members is written first, its rows under a name of their own next, and only a
complete base takes its members' place, so it can be tried again after any loss.

Defined results: an insert of a document that the store has counts as a revision, a delete or revision of an unknown
one as nothing or as an insert; of several changes of one document in a batch the one of highest ``seq`` counts, then
delete before revise before insert, then the largest count, then the last source and language by name; null source or lang are groups of their own;
null tokens count as 0, and null and empty texts have 0 tokens under every counter; changes without doc_id or tokenizer are dropped; an empty batch is committed and changes nothing; groups whose
documents are all gone are not returned; very long texts are counted whole; extra columns of changes are dropped, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricepanel.llm import bpe
from pricepanel.llm.common import sources, written

KEY = ["doc_id", "tokenizer"]
SIGNED = "doc_id long, tokenizer string, source string, lang string, tokens long, sign int, part int"
#: Hash parts of a ledger.
PARTS = 64


def _part() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")


def words_1(text: Column) -> Column:
    """Tokenizer ``words-1``: maximal runs of anything but ASCII white space."""
    trimmed = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w")
    return F.coalesce(F.length(F.regexp_replace(trimmed, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def pieces_1(text: Column) -> Column:
    """Tokenizer ``pieces-1``: runs of ASCII letters, of digits, of other non-ASCII characters, and single ASCII marks."""
    out = F.regexp_replace(text, r"[A-Za-z]+|[0-9]+|[^\x00-\x7F]+|[\x21-\x7E]", "w")
    return F.coalesce(F.length(F.regexp_replace(out, r"[^w]+", "")), F.lit(0)).cast("long")


def counted(docs: DataFrame, tokenizer: str, count: Column, op: str = "insert", seq: int = 0) -> DataFrame:
    """Changes that give each document its ``count`` under ``tokenizer``."""
    return docs.select(
        F.lit(op).alias("op"), F.lit(seq).alias("seq"), "doc_id", F.lit(tokenizer).alias("tokenizer"), "source", "lang", count.cast("long").alias("tokens")
    )


def bpe_counted(docs: DataFrame, tokenizer: str, path: str, pattern: str, op: str = "insert", seq: int = 0) -> DataFrame:
    """Changes that give each document its number of byte-level BPE tokens by the ranks in ``path``, as tokenizer version ``tokenizer``."""
    return counted(bpe.encode(docs, path, pattern, packed=True, keep=("source", "lang")), tokenizer, F.col("n_tokens"), op, seq)


class Rollups:
    """A store at ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path

    def committed(self) -> list[str]:
        """Names of the complete batches that no compaction has replaced."""
        fs, path = self._fs()
        root = path(self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root) if fs.exists(path(f"{s.getPath()}/_SUCCESS"))]
        names = [n for n in names if not n.startswith("members-")]
        folded = {n for base in names if base.startswith("base-") for n in self._members(base)}
        return sorted(set(names) - folded)

    def _members(self, base: str) -> list[str]:
        return [r["value"] for r in self.spark.read.text(f"{self.path}/members-{base}").collect()]

    def _ledger(self, names: list[str]) -> DataFrame:
        empty = self.spark.createDataFrame([], SIGNED)
        frames = [self.spark.read.schema(SIGNED).parquet(f"{self.path}/{n}") for n in names]  # each has its own folders of parts
        return reduce(DataFrame.unionByName, frames, empty) if frames else empty

    def _write(self, rows: DataFrame, name: str) -> None:
        """Rows by part: a file for each part and task that has it, sorted by document."""
        own = rows.withColumn("part", _part()).repartition("part").sortWithinPartitions("part", "doc_id")
        own.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{name}")

    def ledger(self) -> DataFrame:
        """All signed rows that count."""
        return self._ledger(self.committed())

    def facts(self, of: DataFrame | None = None) -> DataFrame:
        """The current facts of each document and tokenizer version, or of those ``of`` names."""
        rows = self.ledger()
        if of is not None:
            parts = [r[0] for r in of.select(_part()).distinct().collect()]  # at most PARTS numbers
            rows = rows.where(F.col("part").isin(parts)).join(of.select(*KEY), KEY, "left_semi")
        return self._net(rows)

    @staticmethod
    def _net(rows: DataFrame) -> DataFrame:
        facts = rows.groupBy(*KEY, "source", "lang", "tokens").agg(F.sum("sign").alias("sign"))
        return facts.where("sign > 0").drop("sign")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was committed before."""
        fs, path = self._fs()
        name = f"batch-{batch_id}"
        done = [n for base in self.committed() if base.startswith("base-") for n in self._members(base)]
        if name in done or fs.exists(path(f"{self.path}/{name}/_SUCCESS")):
            return False
        known = sources(changes, "op", "seq", *KEY, "source", "lang", "tokens").where("doc_id is not null and tokenizer is not null")
        rank = F.when(F.col("op") == "delete", 2).when(F.col("op") == "revise", 1).otherwise(0)
        last = known.groupBy(*KEY).agg(F.max(F.struct("seq", rank.alias("rank"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "source", "lang")).alias("new"))
        last = written(last, "changes")  # counted once: it is looked up by, and joined
        old = self.facts(last).select(*KEY, F.struct("source", "lang", "tokens").alias("old"))
        met = last.join(old, KEY, "left")
        side = lambda c, sign: F.struct(F.col(f"{c}.source").alias("source"), F.col(f"{c}.lang").alias("lang"), F.col(f"{c}.tokens").alias("tokens"), F.lit(sign).alias("sign"))
        rows = F.concat(
            F.when(F.col("old").isNotNull(), F.array(side("old", -1))).otherwise(F.array().cast("array<struct<source:string,lang:string,tokens:bigint,sign:int>>")),
            F.when(F.col("new.rank") < 2, F.array(side("new", 1))).otherwise(F.array().cast("array<struct<source:string,lang:string,tokens:bigint,sign:int>>")),
        )
        self._write(met.select(*KEY, F.explode(rows).alias("r")).select(*KEY, "r.*"), name)
        return True

    def compact(self, base_id: str) -> bool:
        """Fold the committed batches into one of net rows; totals stay as they are. False if this base is complete already."""
        fs, path = self._fs()
        base = f"base-{base_id}"
        if fs.exists(path(f"{self.path}/{base}/_SUCCESS")):
            return False
        # A list left by an earlier try names what its base was to fold; nothing has been folded yet, so it is written anew.
        names = self.committed()
        members = [m for n in names for m in ([n, *self._members(n)] if n.startswith("base-") else [n])]
        self.spark.createDataFrame([(m,) for m in members], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/members-{base}")
        net = self._net(self._ledger(names)).withColumn("sign", F.lit(1))
        self._write(net, base)
        return True

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, documents, tokens``: sums of signed rows, partial before the shuffle."""
        sums = self.ledger().groupBy("source", "lang", "tokenizer").agg(F.sum("sign").cast("long").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        return sums.where("documents > 0")
