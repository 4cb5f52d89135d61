"""Arrow helpers, samples and lookup tables used by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricepanel.functions.storage import scratch as shared_path
from pricepanel.functions.storage import written

__all__ = ["Lookup", "arrow_cuts", "arrow_type", "hashes", "map_slices", "pair_hashes", "quota_sample", "remainder", "shared_path", "sources", "written"]

#: Rows, and characters of text, that a Python task holds as Python objects at a time (one longer text may exceed the latter).
SLICE_ROWS, SLICE_CHARS = 256, 1 << 20
#: Ranges of the hash by which a sample's rows are counted, a power of two.
BUCKETS = 4096


def remainder(col: str, modulus: int):
    """crc32 of the id as text, modulo: the fold that held-out rows are told by. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % modulus


def sources(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads, so that no other column's name can clash."""
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df.select(*names)


def arrow_type(ddl: str) -> pa.Schema:
    """An Arrow schema for a DDL string of simple types and arrays of them."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = []
    for part in ddl.split(","):
        name, kind = part.split()
        fields.append((name, pa.list_(kinds[kind[6:-1]]) if kind.startswith("array<") else kinds[kind]))
    return pa.schema(fields)


def arrow_cuts(batch: pa.RecordBatch, rows: int, chars: int) -> Iterator[tuple[int, int]]:
    """First row and number of rows of each slice, by rows and by the bytes of the string columns."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(size), 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(total, before + chars, "right"))))
        yield at, end - at
        at = end


def map_slices(df: DataFrame, fn: Callable[[Iterator[list[list]]], Iterator[list[list]]], ddl: str, rows: int = SLICE_ROWS) -> DataFrame:
    """Apply ``fn`` in each task to an iterator of column lists; it yields column lists of schema ``ddl``.

    A slice has ``rows`` rows and ``SLICE_CHARS`` bytes of text at most, so Python objects of a few texts live at a time,
    whatever a partition's size; a text longer than that is a slice of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_type(ddl)

        def slices() -> Iterator[list[list]]:
            for batch in batches:
                for at, n in arrow_cuts(batch, rows, SLICE_CHARS):
                    yield [c.to_pylist() for c in batch.slice(at, n).columns]

        for columns in fn(slices()):
            if columns and len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return df.mapInArrow(run, ddl)


def quota_sample(df: DataFrame, by: str, rows: int, chars: int) -> DataFrame:
    """``df(doc_id, text, by)`` cut to a sample bounded in rows and in code points, shared evenly by the values of ``by``.

    Of each value the rows of smallest hash come in, as long as both its shares last: ``rows`` and ``chars`` by the number of values, of which the
    ``rows`` most frequent count. So a sample has ``rows`` rows at most, and for each value one text at most begins before and ends after its
    share of ``chars``. Equal rows count each; they share a hash, and so many of them come in as are left to take. Partitions
    don't change the sample. Rows without a value aren't sampled.

    Only hashes and lengths are counted: by ranges of the hash, then one by one within the range of each value in which its share ends.
    """
    hashed = df.where(F.col(by).isNotNull()).withColumn("_h", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    light = written(hashed.select(F.col(by).alias("_by"), "_h", F.coalesce(F.length("text"), F.lit(0)).alias("_n")), "hashes")
    values = light.groupBy("_by").agg(F.count(F.lit(1)).alias("_rows"))
    n = values.count()
    if not n:
        return df.limit(0)
    share, most = max(1, rows // n), max(1, chars // n)
    # At most ``rows`` values: a proven bound for the broadcasts.
    used = values if n <= rows else values.orderBy(F.col("_rows").desc(), "_by").limit(rows)
    used = F.broadcast(written(used.select("_by"), "sampled-values"))
    light = light.join(used, "_by").withColumn("_range", F.shiftright("_h", 64 - BUCKETS.bit_length() + 1))

    def up_to(counts: DataFrame, place: str) -> DataFrame:
        """Rows and code points of each value before each place."""
        w = Window.partitionBy("_by").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        before = {f"_{c}_before": F.coalesce(F.sum(f"_{c}").over(w), F.lit(0)) for c in ("rows", "chars")}
        return counts.withColumns(before)

    sums = (F.count(F.lit(1)).alias("_rows"), F.sum(F.col("_n").cast("long")).alias("_chars"))
    ranges = up_to(light.groupBy("_by", "_range").agg(*sums), "_range").where((F.col("_rows_before") < share) & (F.col("_chars_before") < most))
    last = ranges.groupBy("_by").agg(F.max_by(F.struct("_range", "_rows_before", "_chars_before"), "_range").alias("_last"))
    last = F.broadcast(written(last.select("_by", "_last.*"), "last-ranges").withColumnsRenamed({"_rows_before": "_r", "_chars_before": "_c"}))
    inside = light.join(last, ["_by", "_range"]).groupBy("_by", "_h", "_r", "_c").agg(*sums)
    inside = up_to(inside, "_h").withColumns({"_rows_before": F.col("_rows_before") + F.col("_r"), "_chars_before": F.col("_chars_before") + F.col("_c")})
    fit = inside.where((F.col("_rows_before") < share) & (F.col("_chars_before") < most))
    each = F.greatest(F.lit(1), (F.col("_chars") / F.col("_rows")).cast("long"))
    left = F.least(F.col("_rows"), share - F.col("_rows_before"), F.ceil((most - F.col("_chars_before")) / each))
    ends = fit.groupBy("_by").agg(F.max_by(F.struct(F.col("_h").alias("_end"), left.alias("_left")), "_h").alias("_cut")).select("_by", "_cut.*")
    cut = hashed.join(F.broadcast(written(ends, "sample-ends")), F.col(by) == F.col("_by"))
    whole = cut.where(F.col("_h") < F.col("_end")).select(*df.columns)
    equal = cut.where(F.col("_h") == F.col("_end")).withColumn("_i", F.row_number().over(Window.partitionBy("_by").orderBy("_h")))
    # Equal rows of a value: a task keeps ``share`` of them at most before they meet.
    return whole.unionByName(equal.where((F.col("_i") <= share) & (F.col("_i") <= F.col("_left"))).select(*df.columns))


def hashes(words: list[str]) -> np.ndarray:
    """64-bit hash of each word, the same in every process; two words of a model share one with a chance below one in a million."""
    return pd.util.hash_array(np.array(words, object), categorize=False) if words else np.zeros(0, np.uint64)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit hash of each pair of hashed words, in order."""
    with np.errstate(over="ignore"):
        x = first * np.uint64(0x9E3779B97F4A7C15) ^ (second + np.uint64(0x632BE59BD9B4E019))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Lookup:
    """Distinct 64-bit keys with a row of values each, laid out by slot; where each slot begins is worked out where it is used."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(2 * max(1, len(keys))))))
        at = np.argsort(self._slot(keys), kind="stable")
        self.keys, self.values = keys[at], values[at]
        self.begins: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "begins": None}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key among those that are here, -1 for others."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        if self.begins is None:
            self.begins = np.concatenate([[0], np.cumsum(np.bincount(self._slot(self.keys), minlength=1 << self.bits))]).astype(np.int32)
        slot = self._slot(keys)
        at, stop = self.begins[slot], self.begins[slot + 1]
        some = at < stop
        hit = some & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys)
        out, left = np.where(hit, at, np.int64(-1)), np.flatnonzero(some & ~hit)
        while len(left):  # as often as the fullest slot has keys: a few times, for few keys
            at[left] += 1
            left = left[at[left] < stop[left]]
            same = self.keys[at[left]] == keys[left]
            out[left[same]] = at[left[same]]
            left = left[~same]
        return out
