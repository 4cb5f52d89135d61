"""Fill-in-the-middle transformation of whole texts, as a pipeline of Arrow compute kernels.

A text's lines are its units. Two cut points, drawn by the document's id, part the units into prefix, middle and suffix, which are written
behind sentinels in the order suffix, prefix, middle (``spm``) or prefix, suffix, middle (``psm``); other texts stay as they are (``plain``).
In each batch the units of all texts are one flat array with parent indices: ordinals come from the list offsets, a role is a filter over
the flat array, and ``binary_join`` puts the units of a rebuilt list together. No text is handled as a Python object.

Defined results: a null text counts as empty, and an empty text is plain with 0 units; a text that holds a sentinel is plain, so every
output reads back in one way; a null id draws as an empty one; very long texts are processed whole, one of over ``BATCH_BYTES`` bytes as a
batch of its own; rows with equal ids and texts give equal rows; an empty table gives an empty result; extra columns of the input are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricepanel.llm.common import arrow_cuts, sources

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Rows and bytes of text that a task transforms at a time.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20
DRAWS = ("h1", "h2", "h3", "h4")
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(id_col: str, seed: int) -> list[Column]:
    """Four 32-bit numbers drawn by an id: the first groups of eight digits of the hexadecimal SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(name) for i, name in enumerate(DRAWS)]


def _units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lines of all texts in one array, each with its line feed; the text that each is of, and how many units each text has."""
    parts = pc.split_pattern(texts, "\n")
    flat, parents = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes) - 1  # a text's last part has no line feed, and is no unit if empty
    last = np.zeros(len(flat), bool)
    last[ends] = True
    units = pc.binary_join_element_wise(flat, pc.if_else(pa.array(last), "", "\n"), "")
    there = ~last | (pc.binary_length(flat).to_numpy() > 0)
    parents = parents[there]
    return units.filter(pa.array(there)), parents, np.bincount(parents, minlength=len(texts))


def _joined(units: pa.Array, parents: np.ndarray, role: np.ndarray, texts: int) -> pa.Array:
    """The units that ``role`` marks, joined for each text."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(parents[role], minlength=texts))]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), units.filter(pa.array(role))), "")


def _with_sentinel(texts: pa.Array) -> pa.Array:
    return pc.or_(pc.or_(pc.match_substring(texts, PREFIX), pc.match_substring(texts, SUFFIX)), pc.match_substring(texts, MIDDLE))


def transformed(batch: pa.RecordBatch, fim_rate: int, spm_rate: int) -> list[pa.Array]:
    """The columns of ``RESULT`` for a batch of ``doc_id, text, h1, h2, h3, h4``."""
    texts = pc.fill_null(batch.column("text"), "")
    h1, h2, h3, h4 = (batch.column(h).to_numpy() for h in DRAWS)
    units, parents, n = _units(texts)
    first, second = np.sort([h1 % (n + 1), h2 % (n + 1)], axis=0)
    ordinals = np.arange(len(parents)) - (np.cumsum(n) - n)[parents]
    roles = (ordinals < first[parents], (ordinals >= first[parents]) & (ordinals < second[parents]), ordinals >= second[parents])
    prefix, middle, suffix = (_joined(units, parents, role, len(n)) for role in roles)
    plain = pc.or_(_with_sentinel(texts), pa.array((n == 0) | (h3 % 100 >= fim_rate)))
    spm = pa.array(h4 % 100 < spm_rate)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    spm_text = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    psm_text = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    output = pc.if_else(plain, texts, pc.if_else(spm, spm_text, psm_text))
    sizes = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(piece).cast(pa.int64())) for piece in (prefix, middle)]
    return [batch.column("doc_id"), pa.array(n, pa.int64()), form, *sizes, output]


def _after(texts: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
    """What is before and behind the first ``mark`` of each text."""
    parts = pc.split_pattern(texts, mark, max_splits=1)
    return pc.list_element(parts, 0), pc.list_element(parts, 1)


def restored(form: pa.Array, output: pa.Array) -> pa.Array:
    """The texts that outputs were made of, rebuilt from the outputs and their forms alone."""
    own = pc.index_in(form, pa.array(["plain", "psm", "spm"])).to_numpy()
    found = [output.filter(pa.array(own == 0))]
    for code, marks in ((1, (PREFIX, SUFFIX, MIDDLE)), (2, (SUFFIX, PREFIX, MIDDLE))):
        rest = _after(output.filter(pa.array(own == code)), marks[0])[1]
        first, rest = _after(rest, marks[1])
        second, middle = _after(rest, marks[2])
        prefix, suffix = (first, second) if code == 1 else (second, first)
        found.append(pc.binary_join_element_wise(prefix, middle, suffix, ""))
    back = np.argsort(np.argsort(own, kind="stable"), kind="stable")
    return pa.concat_arrays(found).take(pa.array(back))


def transform(docs: DataFrame, seed: int = 7, fim_rate: int = 100, spm_rate: int = 50, with_restored: bool = False) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for each document; ``with_restored`` adds the text rebuilt from the output.

    ``fim_rate`` and ``spm_rate`` are percents: of the texts that are transformed, and of those the ones written suffix first.
    """
    ddl = RESULT + ", restored string" * with_restored

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in arrow_cuts(batch, BATCH_ROWS, BATCH_BYTES):
                columns = transformed(batch.slice(at, rows), fim_rate, spm_rate)
                names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
                if with_restored:
                    columns, names = [*columns, restored(columns[2], columns[5])], [*names, "restored"]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = sources(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", *draws("doc_id", seed))
    return rows.mapInArrow(run, ddl)
