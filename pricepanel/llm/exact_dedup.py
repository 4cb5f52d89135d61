"""Exact deduplication by a minimal perfect hash over historical distinct digests.

History is grouped by the SHA-256 of its white-space-free text. The distinct digests are spread by their own bits over
shards of bounded size; each shard gets a minimal perfect hash (levels of bit arrays: a digest takes its bit at the
first level where no other wants it, and the rank of that bit is its slot). A slot holds the full digest and the locator of
the group's winner. A lookup computes the slot and compares all 32 bytes: equal means a repeat of history, unequal
means a new text, which is grouped among the new ones.

A table without a history of its own is cut in two by document id: the digests of one half are indexed, those of the other are
looked up. Members join the group in their slot, whose winner is then settled between both; nonmembers are groups of their own.

Defined results: null counts as empty text, and empty texts are one group. Of a group the row with the most code points
stays, then the smallest doc_id; a null doc_id loses to any other. Rows that repeat a doc_id are one document:
all rows of the winning doc_id are ``kept``. Very long texts are read whole, one at a time. An empty table gives an empty result. Extra
columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricepanel.llm.common import arrow_type, map_slices, remainder, sources, written

#: Digests that a shard of the index holds on average; a task builds or reads one shard at a time.
SHARD_DIGESTS = 20_000
#: Bits per key still unplaced at each level, and the number of levels before keys are listed one by one.
GAMMA, LEVELS = 1.5, 48
WHITE = b" \t\n\x0b\x0c\r"


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest binary, n_chars)``: SHA-256 of the text without white space, code points of the text as it is."""

    def run(slices: Iterator[list[list]]) -> Iterator[list[list]]:
        for ids, texts in slices:
            texts = [t or "" for t in texts]
            yield [ids, [hashlib.sha256(t.encode().translate(None, WHITE)).digest() for t in texts], list(map(len, texts))]

    return map_slices(sources(docs, "doc_id", "text"), run, "doc_id long, digest binary, n_chars long")


def groups(rows: DataFrame) -> DataFrame:
    """One row per distinct digest: winner's locator ``(keep_chars, keep_id)`` and ``group_size``. Counted before the shuffle."""
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")).select(
        "digest", "group_size", (-F.col("best.less")).alias("keep_chars"), F.col("best.id").alias("keep_id")
    )


def _shard(n: int) -> Column:
    return F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % n


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys + np.uint64((level * 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests: a slot below ``len(keys)`` for each, any or none for others."""

    def __init__(self, bits: list[np.ndarray], rest: dict[bytes, int]) -> None:
        self.bits, self.rest = bits, rest
        self.ranks, self.placed = [], 0
        for level in bits:
            self.ranks.append(np.cumsum(level, dtype=np.int64) + self.placed - 1)
            self.placed += int(level.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, bits = keys.copy(), []
        while len(left) and len(bits) < LEVELS:
            size = max(8, int(len(left) * GAMMA))
            at = (_mix(cls.word(left), len(bits)) % np.uint64(size)).astype(np.int64)
            level = np.bincount(at, minlength=size) == 1
            bits.append(level)
            left = left[~level[at]]
        placed = sum(int(level.sum()) for level in bits)
        return cls(bits, {bytes(k): placed + i for i, k in enumerate(left)})

    @staticmethod
    def word(keys: np.ndarray) -> np.ndarray:
        return keys[:, 8:16].copy().view("<u8").ravel()

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level has its bit."""
        out, words, open_ = np.full(len(keys), -1, np.int64), self.word(keys), np.arange(len(keys))
        for i, (level, rank) in enumerate(zip(self.bits, self.ranks, strict=True)):
            at = (_mix(words[open_], i) % np.uint64(len(level))).astype(np.int64)
            hit = level[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        for i in open_ if self.rest else ():
            out[i] = self.rest.get(bytes(keys[i]), -1)
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(self.rest), len(self.bits), *map(len, self.bits)], "<i8").tobytes()
        return sizes + b"".join(np.packbits(level).tobytes() for level in self.bits) + b"".join(sorted(self.rest, key=self.rest.get))

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n_rest, n_levels = np.frombuffer(data, "<i8", 2)
        sizes = np.frombuffer(data, "<i8", int(n_levels), 16)
        at, bits = 16 + 8 * int(n_levels), []
        for size in map(int, sizes):
            n = (size + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, n, at))[:size].astype(bool))
            at += n
        placed = sum(int(level.sum()) for level in bits)
        return cls(bits, {data[at + 32 * i : at + 32 * i + 32]: placed + i for i in range(int(n_rest))})


def _matrix(values: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), np.uint8).reshape(-1, 32)


INDEX = "shard long, slot long, digest binary, keep_chars long, keep_id long, group_size long"
FOUND = "digest binary, old_chars long, old_id long, old_size long"


class DigestIndex:
    """The written index: per shard one row with the hash function (slot -1) and one row per slot."""

    def __init__(self, rows: DataFrame, shards: int) -> None:
        self.rows, self.shards = rows, shards

    @classmethod
    def build(cls, grouped: DataFrame) -> DigestIndex:
        """Index of the output of :func:`groups`, which is written already."""
        n = max(1, -(-grouped.count() // SHARD_DIGESTS))

        def shard(table: pa.Table) -> pa.Table:
            # Arrow keeps whole numbers whole beside nulls; pandas would make ids floats.
            schema, keys = arrow_type(INDEX), _matrix(table["digest"])
            function = PerfectHash.build(keys)
            rows = table.append_column("slot", pa.array(function.slots(keys))).select(schema.names).sort_by("slot").cast(schema)
            head = {"shard": table["shard"][0].as_py(), "slot": -1, "digest": function.dump()}
            return pa.concat_tables([pa.Table.from_pylist([head], schema), rows])

        return cls(written(grouped.withColumn("shard", _shard(n)).groupBy("shard").applyInArrow(shard, INDEX), "digest-index"), n)

    def lookup(self, distinct: DataFrame) -> DataFrame:
        """For distinct digests: the slot's group where the bytes agree, nulls for nonmembers."""

        def probe(asked: pa.Table, index: pa.Table) -> pa.Table:
            schema = arrow_type(FOUND)
            if not asked.num_rows or not index.num_rows:
                return pa.table([asked["digest"], *(pa.nulls(asked.num_rows, pa.int64()) for _ in range(3))], schema)
            index = index.sort_by("slot")
            function, slots = PerfectHash.load(index["digest"][0].as_py()), index.slice(1)
            keys = _matrix(asked["digest"])
            at = function.slots(keys)
            same = at >= 0
            same[same] = (_matrix(slots["digest"])[at[same]] == keys[same]).all(axis=1)
            places = pa.array(at, mask=~same)
            return pa.table([asked["digest"], *(slots[of].take(places) for of in ("keep_chars", "keep_id", "group_size"))], schema)

        asked = distinct.select("digest").withColumn("shard", _shard(self.shards)).groupBy("shard")
        return asked.cogroup(self.rows.groupBy("shard")).applyInArrow(probe, FOUND)


WINNERS = ("digest", "keep_id", "group_size")


def resolve(batch: DataFrame, index: DigestIndex) -> DataFrame:
    """Groups of a batch against history: ``(digest, keep_id, group_size, known)``; history and batch count together."""
    grouped = batch.withColumnsRenamed({"keep_id": "new_id", "keep_chars": "new_chars", "group_size": "new_size"})
    found = index.lookup(batch)
    rank = lambda chars, key: F.struct(-F.col(chars), F.col(key).isNull(), F.col(key))
    old_wins = F.col("old_chars").isNotNull() & (rank("old_chars", "old_id") <= rank("new_chars", "new_id"))
    return grouped.join(found, "digest").select(
        "digest",
        F.when(old_wins, F.col("old_id")).otherwise(F.col("new_id")).alias("keep_id"),
        (F.col("new_size") + F.coalesce("old_size", F.lit(0))).alias("group_size"),
        F.col("old_size").isNotNull().alias("known"),
    )


def _by_halves(rows: DataFrame) -> DataFrame:
    """``(digest, keep_id, group_size)`` of all rows: one half is the history, the other the batch that is looked up in it."""
    half = remainder("doc_id", 2)
    history = written(groups(rows.where(half == 0)), "history-groups")
    batch = written(groups(rows.where(half == 1)), "batch-groups")
    resolved = written(resolve(batch, DigestIndex.build(history)), "resolved")
    met = resolved.where("known").select("digest")
    return history.join(met, "digest", "left_anti").select(*WINNERS).union(resolved.select(*WINNERS))


def dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Per document ``doc_id, keep_id, group_size, kept, text_sha256``.

    With ``index``, ``docs`` is a new batch whose repeats of history are dropped too. Without it one half of the table is the
    history of the other.
    """
    rows = written(digests(docs), "digests")
    found = _by_halves(rows) if index is None else resolve(written(groups(rows), "batch-groups"), index).select(*WINNERS)
    # Both sides are plain tables, so a group with a large part of all rows is a skewed join that Spark splits.
    return rows.join(written(found, "digest-winners"), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
