"""A corpus pipeline: five operators, one after the other, over ``documents``.

Every stage but the last returns the columns of ``documents``; extra columns of a table, whatever their names, are dropped. Null and empty texts are documents
like others: they aren't toxic, are one group of exact copies, have fingerprint zero, match no benchmark item and have no tokens. Very long texts are judged
whole. Null and repeated ids are kept apart by a row id of each stage's own, so a row is judged by its own text. Ties go to the smallest
doc_id, then to any one of the rows that are equal in it. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricepanel.llm import bpe, decontaminate, exact_dedup, simhash, toxicity
from pricepanel.llm.common import remainder, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; all of them where the labels don't have both classes. Labels of the held-out fold teach nothing."""
    docs = _documents(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 5) != 0)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with a written ``row`` id, by which a stage carries its decision back: a doc_id may be null or repeat."""
    return written(_documents(docs).withColumn("row", F.monotonically_increasing_id()), "numbered")


def _kept(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The numbered rows that ``kept(row)`` names. Ids aren't broadcast, however few: the plan is the same at every size."""
    return rows.join(written(kept, "kept-rows").hint("shuffle_hash"), "row", "left_semi").select(*COLUMNS)


def _by_row(rows: DataFrame) -> DataFrame:
    """``rows`` as an operator takes them, with the row id for a doc_id."""
    return rows.select(F.col("row").alias("doc_id"), "text")


def _firsts(members: DataFrame, *order: Column) -> DataFrame:
    """``(row)``: one row of each group of ``members(row, doc_id, of, ...)``, first by ``order``, then by smallest doc_id, null last."""
    first = F.min(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    return members.groupBy("of").agg(first.alias("first")).select("first.row")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The one row that stays of each group of equal texts: most code points, then smallest doc_id (null last), then any one."""
    rows = _numbered(docs)
    groups = exact_dedup.dedup(_by_row(rows)).select(F.col("doc_id").alias("row"), F.col("text_sha256").alias("of"))
    sizes = rows.select("row", "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    return _kept(rows, _firsts(sizes.join(groups, "row"), -F.col("chars")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The one row of smallest doc_id (null last) of each SimHash component."""
    rows = _numbered(docs)
    groups = simhash.near_duplicates(_by_row(rows)).select(F.col("doc_id").alias("row"), F.col("component_id").alias("of"))
    return _kept(rows, _firsts(rows.select("row", "doc_id").join(groups, "row")))


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without a copy of a benchmark item, each judged by its own text; items without text match nothing."""
    rows = _numbered(docs)
    found = decontaminate.contaminated(_by_row(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(found.select(F.col("doc_id").alias("row")).distinct(), "row", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left, with digests of them and of what they decode to; a null or empty text has none."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.coded(docs, path, pattern).select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_copies),
    ("byte_bpe", encode),
]

#: Trained models, SimHash and BPE have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
