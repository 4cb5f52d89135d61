"""Registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricepanel.llm import alignment, bpe, chat, decontaminate, exact_dedup, fim, language_id, ppm, secret_ledger, simhash, suffix_dedup, token_rollups, toxicity
from pricepanel.llm.common import remainder, shared_path, written

VOCABULARY, ALIGNED = "byte_bpe_multi_50k.tiktoken", ("byte_bpe_50k.json", "piece_bpe_32k.model")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _with_fold(result: DataFrame, modulus: int, held: int) -> DataFrame:
    rest = [c for c in result.columns if c != "doc_id"]
    return result.select("doc_id", (remainder("doc_id", modulus) == held).alias("held_out"), *rest)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(remainder("doc_id", 3) != 1))
    return _with_fold(language_id.predict(docs, model), 3, 1)


def rollup_batches(spark: SparkSession, docs: DataFrame, kinds: dict[str, Callable[..., DataFrame]]) -> token_rollups.Rollups:
    """A store that took three batches: provisional counts arrive first, exact ones revise them and come twice, and repeated texts are deleted.

    ``kinds`` has for each tokenizer version the function that makes a batch's changes of documents.
    """
    store = token_rollups.Rollups(spark, shared_path(spark, "token-rollups"))
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    store.commit("provisional", union(token_rollups.counted(docs, k, F.coalesce(F.length("text"), F.lit(0))) for k in kinds))
    exact = union(count(docs, k, op="revise", seq=1) for k, count in kinds.items())
    store.commit("exact", exact)
    store.commit("exact", exact)
    hashed = docs.select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    firsts = hashed.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    repeats = hashed.join(firsts, "doc_id", "left_anti")
    store.commit("repeats", union(token_rollups.counted(repeats, k, F.lit(0), "delete", 2) for k in kinds))
    return store


def op2_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of byte-level BPE tokens, first of each text only."""
    multi = partial(token_rollups.bpe_counted, path=public_tokenizers.path(VOCABULARY), pattern=public_tokenizers.PATTERN)
    return rollup_batches(spark, _read(spark, sf_dir, "documents"), {"byte-bpe-multi-50k": multi}).totals()


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    labels = _read(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    return _with_fold(toxicity.score(docs, toxicity.fit(docs, labels)), 5, 0)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents was scanned by an older rule version; then all come in two batches, and only unseen pairs are scanned."""
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    history = lambda rows, version: rows.withColumn("version", F.lit(version).cast("long"))
    path, older = shared_path(spark, "secret-ledger"), (*secret_ledger.RULES[:2], secret_ledger.Rule("hex", 0, r"([0-9a-f]{64,})", 1, 64))
    secret_ledger.Ledger(spark, path, older).ingest("before", history(docs.where(remainder("path", 4) == 0), 1))
    ledger = secret_ledger.Ledger(spark, path)
    ledger.ingest("first-half", history(docs.where(remainder("path", 2) == 0), 2))
    ledger.ingest("second-half", history(docs.where(remainder("path", 2) == 1), 2))
    named = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return ledger.report().where("version = 2").select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(named, 256).alias("base_sha256"), named.alias("spans"))


def _spans_sql(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    text = f"""
  SELECT doc_id, {order} AS o, '{kind}' AS kind, g.tested, g.size,
         sum(g.gap + g.size) OVER (PARTITION BY doc_id ORDER BY g.i) AS stop
  FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'i': i, 'gap': length(s[i]), 'size': length(m[i]), 'tested': length(t[i])}})) AS g
    FROM (
      SELECT doc_id, string_split_regex(text, '{pattern}') AS s, regexp_extract_all(text, '{pattern}') AS m,
             regexp_extract_all(text, '{pattern}', {group}) AS t
      FROM documents WHERE text IS NOT NULL
    )
  )"""
    return f"SELECT doc_id, o, kind, stop - size AS start, stop FROM ({text}) WHERE tested >= {least}"


OP5_SQL = (
    "WITH spans AS ("
    + " UNION ALL ".join(_spans_sql(r.kind, i, r.pattern.replace("'", "''"), r.group, r.least) for i, r in enumerate(secret_ledger.RULES))
    + """), named AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
         string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, o) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN named n ON d.doc_id = n.doc_id
"""
)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    marks = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.digests(rows.unionByName(marks))


OP6_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS was,
         length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) AS size,
         length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;')) AS role_size
  FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(size + CASE WHEN was = role THEN 6 ELSE 3 + role_size + 1 + 4 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_read(spark, sf_dir, "documents"))


OP8_SQL = """
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS body FROM documents
), ranked AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS size FROM rows
)
SELECT doc_id, keep_id, size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM ranked
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return _with_fold(ppm.scores(docs, docs.where(remainder("doc_id", 5) != 1)), 5, 1)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.transform(_read(spark, sf_dir, "documents"), with_restored=True)
    digests = F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP12_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(sha256('7:' || doc_id), i, 8))::BIGINT) AS h
  FROM documents
), cut AS (
  SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
              WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:n], '') AS s FROM cut
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(_read(spark, sf_dir, "documents"), *map(public_tokenizers.path, ALIGNED))
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256")
    return alignment.scored(written(found.select(*(digest if c == "groups" else c for c in found.columns)), "aligned"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_token_rollups, op3_toxicity, op4_simhash, op5_secret_scan, op6_chat_format, op7_byte_bpe, op8_exact_dedup, op9_decontamination, op10_lm_score, op11_suffix_dedup, op12_fill_in_middle, op13_alignment)}
ORACLE_SQL = {"op5_secret_scan": OP5_SQL, "op6_chat_format": OP6_SQL, "op8_exact_dedup": OP8_SQL, "op12_fill_in_middle": OP12_SQL}
