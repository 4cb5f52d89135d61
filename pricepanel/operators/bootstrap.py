"""Stock-cluster bootstrap as products of blocks: draws by securities times securities by cells.

A replicate draws as many securities as there are, with replacement, from md5 numbers; all cells share its draws. Draws are made where the
securities lie, ``(replicate, security)`` pairs are packed by block of securities, and meet the block's sums in one dense product. A block gives one row a cell,
with an array over the replicates; rows of equal cells are added up. So neither draws nor cells are ever exploded, whatever the number of replicates.

Defined results: a security without rows in a cell adds nothing to it; null sums count as none; no securities give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricepanel.functions.storage import written
from pricepanel.operators.sampling import numbered

#: Securities of a block, draws made at a time, and cells multiplied at a time.
BLOCK, DRAWS, CELLS = 1024, 512, 256


def _packed_draws(ranked: DataFrame, replicates: int, seed: int) -> DataFrame:
    """``(block, drawn binary)``: pairs of replicate and place in the block, 32 bits each, that the draws of ``ranked(_n, _all)`` hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = [f"{seed}|{r}|".encode() for r in range(replicates)]
        replicate = np.arange(replicates, dtype=np.uint32)
        for batch in batches:
            ids, sizes = batch.column("_n").to_numpy() - 1, batch.column("_all").to_numpy()
            for a in range(0, len(ids), DRAWS):
                own = [str(i).encode() for i in ids[a : a + DRAWS].tolist()]
                digits = np.array([int.from_bytes(hashlib.md5(h + i, usedforsecurity=False).digest()[:4], "big") for i in own for h in heads], np.float64)
                hit = np.floor(digits / 2.0**32 * np.repeat(sizes[a : a + DRAWS], replicates)).astype(np.int64)
                pairs = np.stack([np.tile(replicate, len(own)), (hit % BLOCK).astype(np.uint32)], axis=1)
                block = hit // BLOCK
                order = np.argsort(block, kind="stable")
                there, begins = np.unique(block[order], return_index=True)
                packed = [p.tobytes() for p in np.split(pairs[order], begins[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(packed, pa.binary())], ["block", "drawn"])

    tasks = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes make many draws
    return ranked.select("_n", "_all").repartition(tasks, "_n").mapInArrow(run, "block long, drawn binary")


def _cells(keys: pa.Table, arrays: list[np.ndarray], values: list[str]) -> pa.Table:
    """The rows of ``keys`` with a list column of each of the ``values`` from arrays of shape (rows, replicates)."""
    for name, own in zip(values, arrays, strict=True):
        offsets = np.arange(0, own.size + 1, own.shape[1] or 1, dtype=np.int32)[: len(own) + 1]
        keys = keys.append_column(name, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(own).ravel(), pa.float64())))
    return keys


def resampled(sums: DataFrame, keys: list[str], values: list[str], replicates: int, seed: int) -> DataFrame:
    """``keys`` with, for each of the ``values``, an array of its sum in each replicate.

    ``sums(issue_id, keys, values)`` has a row at most for each security and cell. A security is counted as often as the replicate drew it from
    those in ``sums``. A task holds a block's rows: ``BLOCK`` securities by the cells they have.
    """
    ranked = written(numbered(sums.select("issue_id").distinct(), "issue_id"), "ranked-securities")
    own = sums.join(ranked.select("issue_id", "_n"), "issue_id")
    own = own.select(F.expr(f"(_n - 1) div {BLOCK}").alias("block"), ((F.col("_n") - 1) % BLOCK).alias("at"), *keys, *(F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    ddl = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"`{v}` array<double>" for v in values)])

    def product(drawn: pa.Table, cells: pa.Table) -> pa.Table:
        if not cells.num_rows:
            return _cells(cells.select(keys), [np.zeros((0, replicates))] * len(values), values)
        pairs = np.frombuffer(b"".join(drawn["drawn"].to_pylist()), np.uint32).reshape(-1, 2).astype(np.int64)
        weights = np.bincount(pairs[:, 0] * BLOCK + pairs[:, 1], minlength=replicates * BLOCK).reshape(replicates, BLOCK).astype(np.float64)
        cell = cells.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        first = np.unique(cell, return_index=True)[1]
        at, amounts = cells["at"].to_numpy(), np.stack([cells[v].to_numpy() for v in values], axis=1)
        found = []
        for a in range(0, len(first), CELLS):
            of = np.flatnonzero((cell >= a) & (cell < a + CELLS))
            n = min(CELLS, len(first) - a)
            block = np.zeros((BLOCK, n, len(values)))
            np.add.at(block, (at[of], cell[of] - a), amounts[of])
            found.append((weights @ block.reshape(BLOCK, -1)).reshape(replicates, n, len(values)))
        whole = np.concatenate(found, axis=1)
        return _cells(cells.select(keys).take(pa.array(first)), [whole[:, :, i].T for i in range(len(values))], values)

    def added(parts: pa.Table) -> pa.Table:
        total = [parts[v].combine_chunks().flatten().to_numpy().reshape(-1, replicates).sum(axis=0)[None, :] for v in values]
        return _cells(parts.select(keys).slice(0, 1), total, values)

    met = _packed_draws(ranked, replicates, seed).groupBy("block").cogroup(own.groupBy("block")).applyInArrow(product, ddl)
    return met.groupBy(*keys).applyInArrow(added, ddl)


def ratios(top: str, bottom: str) -> Column:
    """Quotient of two arrays by replicate, null where the lower one isn't positive."""
    return F.zip_with(top, bottom, lambda a, b: F.when(b > 0, a / b))


def percentiles(draws: Column, low: float = 0.025, high: float = 0.975) -> tuple[Column, Column, Column]:
    """Two percentiles, interpolated, of the values of an array that are there, and how many there are."""
    there = F.array_sort(F.filter(draws, lambda x: x.isNotNull()))
    n = F.size(there)

    def at(q: float) -> Column:
        place = F.lit(q) * (n - 1)
        under = F.floor(place).cast("int")
        below, above = F.get(there, under), F.get(there, F.least(under + 1, n - 1))
        return F.when(n > 0, below + (above - below) * (place - under))

    return at(low), at(high), n
