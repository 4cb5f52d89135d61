"""Removal of byte strings that occur in an earlier document, by suffix sorting with bucket-pointer refinement.

A byte goes if a string of ``length`` bytes covers it that also starts in a document of smaller id. Strings start at every byte, so not all of
them can be sorted together over the network. What travels is kept below the input:

1. Texts are packed into blocks of bounded size, one compressed row each, in a table bucketed by block: no later pass moves a text.
2. A string's bucket is its q-gram of smallest hash, which equal strings share wherever they are; neighbouring strings mostly have it in common and form a run.
   Each block sends its distinct buckets to the shards of a hash, packed, and hears which of them other blocks have too.
3. Of these, and of its own buckets of several documents, it sends the runs' digests with the smallest id. A bucket of one run is settled: all its
   strings are in the same documents. A bucket of several runs is open.
4. The bytes of open buckets' runs meet in a task, where their strings are refined: positions are ranked by their first bytes, and buckets of several are
   sorted by the bucket pointers of themselves and of a later offset. Each round gives new pointers, which the next reuses at twice the depth, until ``length``; a
   bucket of one is never sorted again. The smallest id of each final bucket goes back to the blocks, which cut their texts.

A bucket that more than ``hot`` blocks share would be too many runs for a task. Its strings are sent as runs of one string each, in buckets of their own, of
which every block sends each once.

Defined results: null and empty texts have no bytes, and a text shorter than ``length`` keeps all of them; bytes are UTF-8, and what is kept may cut a
character; a null doc_id is larger than any other; rows of equal id are not smaller than each other, so they take nothing from each other; strings are
judged on the input, not on what is left; very long texts are a block of their own, hashed in overlapping pieces of ``PIECE`` bytes; an empty table gives an empty
result; extra columns are dropped. Runs are told apart by 64-bit digests within a bucket, of which ``_width`` bytes are kept: two runs of a corpus are taken for
each other with a chance below one in a million.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricepanel.llm.common import arrow_cuts, arrow_type, shared_path, sources, written

#: Bytes of text and rows of a block; there are some ``MOST_BLOCKS`` at most, so blocks grow beyond some 16 TB of text.
BLOCK_BYTES, BLOCK_ROWS, MOST_BLOCKS = 1 << 20, 4096, 1 << 24
#: Bytes of text that are hashed at a time, and bytes of text by shard of the buckets' counts, of the runs' digests, and of refinement.
PIECE, COUNT_BYTES, DIGEST_BYTES, REFINE_BYTES = 1 << 18, 16 << 20, 16 << 20, 16 << 20
#: Bytes of runs that are refined at a time, unless those of one bucket are more.
SORTED_BYTES = 2 << 20
#: Bytes of text in a partition of the laid-out table.
PARTITION_BYTES = 64 << 20
#: Bytes by which positions are ranked first.
FIRST = 8
NO_ID = 2**63 - 1
SPAN = np.dtype([("start", "<i4"), ("stop", "<i4"), ("least", "<i8")])
HIT = np.dtype([("bucket", "<u8"), ("digest", "<u8"), ("start", "<i4"), ("stop", "<i4"), ("least", "<i8")])
RUN = np.dtype([("bucket", "<u8"), ("digest", "<u8"), ("doc", "<i4"), ("strings", "<i4"), ("at", "<i8")])
_MIXERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_STEP = 0xA0761D6478BD642F


def _words(data: bytes, n: int) -> np.ndarray:
    """The eight bytes from each of the first ``n`` places of ``data``, zeros behind its end, as big-endian numbers."""
    padded, out = data + b"\0" * 16, np.empty(n, np.uint64)
    for i in range(min(8, n)):  # every eighth place from each of the first eight
        out[i::8] = np.frombuffer(padded, ">u8", count=len(out[i::8]), offset=i)
    return out


def _gram_hashes(data: bytes, q: int) -> np.ndarray:
    """64-bit hash of the ``q`` bytes from each place on."""
    n = len(data) - q + 1
    words = _words(data, len(data))
    h = np.full(n, q, np.uint64)
    with np.errstate(over="ignore"):
        for i in [*range(0, q - 8, 8), q - 8]:
            h ^= words[i : i + n]
            h *= _MIXERS[0]
            h ^= h >> np.uint64(32)
        h *= _MIXERS[1]
        h ^= h >> np.uint64(29)
    return h


def _window_least(h: np.ndarray, window: int) -> np.ndarray:
    least, size = h, 1
    while size < window:
        step = min(size, window - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    return least


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """``(doc, offset, bytes)`` in lists of some ``PIECE`` bytes; the pieces of a longer text overlap so that each string is in one."""
    out, size = [], 0
    for doc, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            piece = text[at : at + PIECE + length - 1]
            if len(piece) < length:
                continue
            if size + len(piece) > PIECE and out:
                yield out
                out, size = [], 0
            out.append((doc, at, piece))
            size += len(piece)
    if out:
        yield out


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_STEP`` to the power of each place, and of minus each place, modulo 2^64."""
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, _STEP, np.uint64))
        down = np.cumprod(np.full(n, pow(_STEP, -1, 2**64), np.uint64))
    return up, down


def _runs(texts: list[bytes], length: int, q: int, mask: int, hot: np.ndarray | None = None, each: bool = False) -> np.ndarray:
    """The runs of all texts as ``RUN`` rows: bucket, digest of the bytes, text, number of strings, and first byte in the text.

    The runs of ``hot`` buckets come as runs of one string each, whose bucket is their digest; with ``each``, all runs do.
    """
    out = [np.zeros(0, RUN)]
    for pieces in _pieces(texts, length):
        data = b"".join(p for *_, p in pieces)
        sizes = np.array([len(p) for *_, p in pieces])
        begins = np.cumsum(sizes) - sizes
        grams = _gram_hashes(data, q)
        least = _window_least(grams, length - q + 1)
        edges = np.zeros(len(least) + 1, np.int8)
        edges[begins] += 1
        edges[begins + sizes - length + 1] -= 1  # behind a piece's last string; the next piece's first is further on
        within = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
        first = within.copy()
        first[1:] &= ~within[:-1] | (least[1:] != least[:-1])
        first[begins] = True
        last = within.copy()
        last[:-1] &= ~within[1:] | first[1:]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last)
        bucket, single = least[starts] & np.uint64(mask), np.zeros(len(starts), bool)
        if each or hot is not None and len(hot):
            single = np.ones(len(starts), bool) if each else _member(bucket, hot)
            counts = np.where(single, stops - starts + 1, 1)
            of = np.repeat(np.arange(len(starts)), counts)
            shift = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            bucket, single = bucket[of], single[of]
            starts, stops = starts[of] + shift, np.where(single, starts[of] + shift, stops[of])
        rows = np.empty(len(starts), RUN)
        up, down = _powers(2 * PIECE + length)
        with np.errstate(over="ignore"):  # a polynomial over the hashes of the q-grams, moved to the run's first place
            upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams * up[: len(grams)])])
            digest = (upto[stops + length - q + 1] - upto[starts]) * down[starts]
            digest = (digest ^ (digest >> np.uint64(31))) * _MIXERS[1]
            digest ^= digest >> np.uint64(32)
        piece = np.searchsorted(begins, starts, "right") - 1
        docs, offsets = (np.array(x, np.int64) for x in list(zip(*pieces, strict=True))[:2])
        rows["bucket"], rows["digest"], rows["strings"] = np.where(single, digest & np.uint64(mask), bucket), digest, stops - starts + 1
        rows["doc"], rows["at"] = docs[piece], offsets[piece] + starts - begins[piece]
        out.append(rows)
    return np.concatenate(out)


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted ``of``."""
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values if len(of) else np.zeros(len(values), bool)


def _width(size: int) -> int:
    """Bytes of a bucket that are kept: so many that a bucket of a corpus has a chance of some one in 10,000 to be taken for another."""
    return min(8, -(-(max(size, 2).bit_length() + 10) // 8))


def _packed(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _packed_ids(ids: np.ndarray) -> bytes:
    """Ids as differences from the smallest, in as few bytes each as they need."""
    low = int(ids.min()) if len(ids) else 0
    with np.errstate(over="ignore"):
        above = ids.view(np.uint64) - np.uint64(low % 2**64)
    width = max(1, -(-int(above.max() if len(ids) else 0).bit_length() // 8))
    return low.to_bytes(8, "little", signed=True) + bytes([width]) + _packed(above, width)


def _unpacked_ids(raw: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_unpacked(raw[9:], raw[8]) + np.uint64(int.from_bytes(raw[:8], "little", signed=True) % 2**64)).view(np.int64)


def _frame(ddl: str, rows: list[tuple]) -> pa.Table:
    schema = arrow_type(ddl)
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _by_shard(buckets: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that the buckets are of, and their places."""
    shard = buckets % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    there, begins = np.unique(shard[order], return_index=True)
    return zip(there.tolist(), np.split(order, begins[1:]), strict=True) if len(buckets) else iter(())


class Texts:
    """The ids and texts of a packed block."""

    def __init__(self, raw: bytes) -> None:
        table = pa.ipc.open_stream(raw).read_all()
        self.doc_ids = table["doc_id"].to_pylist()
        self.texts: list[bytes] = table["text"].to_pylist()
        self.ids = np.array([NO_ID if i is None else i for i in self.doc_ids], np.int64)

    @staticmethod
    def pack(batch: pa.RecordBatch) -> bytes:
        texts = batch.column("text").cast(pa.binary()).fill_null(b"")
        sink = pa.BufferOutputStream()
        own = pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])
        with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(own)
        return sink.getvalue().to_pybytes()


def laid_out(docs: DataFrame) -> tuple[DataFrame, int]:
    """``block, packed`` in a table bucketed by block, and the bytes of all texts."""
    docs = sources(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    most = max(BLOCK_BYTES, total // MOST_BLOCKS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, rows, size = TaskContext.get().partitionId() << 33, [], 0, 0

        def full() -> pa.RecordBatch:
            whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([Texts.pack(whole)], pa.binary())], ["block", "packed"])

        for batch in batches:
            for at, n in arrow_cuts(batch, 256, most):
                part = batch.slice(at, n)
                if waiting and (size + part.nbytes > most or rows + n > BLOCK_ROWS):
                    yield full()
                    block, waiting, rows, size = block + 1, [], 0, 0
                waiting.append(part)
                rows, size = rows + n, size + part.nbytes
        if waiting:
            yield full()

    spark = docs.sparkSession
    n = 1 + max(total // PARTITION_BYTES, min(total // BLOCK_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1))
    name = f"texts_by_block_{uuid.uuid4().hex}"
    rows = docs.mapInArrow(pack, "block long, packed binary").repartition(n, "block")
    rows.write.bucketBy(n, "block").option("path", shared_path(spark, name)).saveAsTable(name)
    return spark.table(name), total


def shared_buckets(blocks: DataFrame, size: int, length: int, q: int, hot: int) -> DataFrame:
    """``block, shared, hot``: of each block the buckets that other blocks have too, packed, and those of them that over ``hot`` have."""
    width, shards = _width(size), 1 + size // COUNT_BYTES
    mask, sent_ddl = (1 << 8 * width) - 1, "shard long, block long, buckets binary"

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                buckets = np.unique(_runs(Texts(raw).texts, length, q, mask)["bucket"])
                rows = [(shard, block, _packed(buckets[i], width)) for shard, i in _by_shard(buckets, shards)]
                yield from _frame(sent_ddl, rows).to_batches()

    def met(table: pa.Table) -> pa.Table:
        packed, rows, stop = table["buckets"].to_pylist(), [], 0
        _, at, counts = np.unique(_unpacked(b"".join(packed), width), return_inverse=True, return_counts=True)
        times = counts[at]
        for block, raw in zip(table["block"].to_pylist(), packed, strict=True):
            buckets, n = _unpacked(raw, width), times[stop : stop + len(raw) // width]
            stop += len(buckets)
            if (n > 1).any():
                rows.append((block, _packed(buckets[(n > 1) & (n <= hot)], width), _packed(buckets[n > max(1, hot)], width)))
        return _frame("block long, shared binary, hot binary", rows)

    sent = blocks.mapInArrow(own, sent_ddl)
    return sent.groupBy("shard").applyInArrow(met, "block long, shared binary, hot binary")


def _lows(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One run of each bucket and digest, the smallest id that has it, and whether others have it too."""
    owner = ids[rows["doc"]]
    order = np.lexsort((owner, rows["digest"], rows["bucket"]))
    rows, owner = rows[order], owner[order]
    begins = np.flatnonzero(np.concatenate([[True], (rows["bucket"][1:] != rows["bucket"][:-1]) | (rows["digest"][1:] != rows["digest"][:-1])]) if len(rows) else [])
    ends = np.concatenate([begins[1:], [len(rows)]])[: len(begins)] - 1
    return rows[begins], owner[begins], owner[begins] < owner[ends]


def verdicts(blocks: DataFrame, shared: DataFrame, size: int, length: int, q: int) -> DataFrame:
    """``block, settled, least, single, single_least, opened``: of each block the buckets of one run and the smallest id that has it, the same for
    strings of hot buckets, and the buckets of several runs."""
    width, shards = _width(size), 1 + size // DIGEST_BYTES
    mask = (1 << 8 * width) - 1
    ddl = "shard long, block long, single boolean, buckets binary, digests binary, low binary, several binary"
    result = "block long, settled binary, least binary, single binary, single_least binary, opened binary"

    def own(table: pa.Table, said: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _frame(ddl, [])
        block, texts = table["block"][0].as_py(), Texts(table["packed"][0].as_py())
        shared, hot = (np.sort(_unpacked(b"".join(said[c].to_pylist()), width)) for c in ("shared", "hot"))
        rows = _runs(texts.texts, length, q, mask)
        # Buckets of several ids within the block are due as well.
        order = np.lexsort((texts.ids[rows["doc"]], rows["bucket"]))
        bucket, owner = rows["bucket"][order], texts.ids[rows["doc"]][order]
        here = np.unique(bucket[1:][(bucket[1:] == bucket[:-1]) & (owner[1:] != owner[:-1])])
        due = (_member(rows["bucket"], shared) | _member(rows["bucket"], here)) & ~_member(rows["bucket"], hot)
        parts = [(False, rows[due])]
        if len(hot):
            split = _runs(texts.texts, length, q, mask, hot)
            parts.append((True, split[(split["strings"] == 1) & (split["bucket"] == split["digest"] & np.uint64(mask))]))
        out = []
        for single, some in parts:
            distinct, low, several = _lows(some, texts.ids)
            for shard, i in _by_shard(distinct["bucket"], shards):
                part = distinct[i]
                cells = _packed(part["bucket"], width), part["digest"].tobytes(), _packed_ids(low[i]), np.packbits(several[i]).tobytes()
                out.append((shard, block, single, *cells))
        return _frame(ddl, out)

    def met(table: pa.Table) -> pa.Table:
        out: dict[int, list[list[bytes]]] = {}
        for single in (False, True):
            part = table.filter(pc.equal(table["single"], single))
            if not part.num_rows:
                continue
            block, counts = part["block"].to_numpy(), [len(b) // width for b in part["buckets"].to_pylist()]
            bucket = _unpacked(b"".join(part["buckets"].to_pylist()), width)
            digest = np.frombuffer(b"".join(part["digests"].to_pylist()), np.uint64)
            low = np.concatenate([_unpacked_ids(x) for x in part["low"].to_pylist()])
            several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(part["several"].to_pylist(), counts, strict=True)]).astype(bool)
            order = np.lexsort((digest, bucket))
            b, d = bucket[order], digest[order]
            begins = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]) | (np.concatenate([[True], d[1:] != d[:-1]]) if single else False))
            sizes = np.diff([*begins, len(b)])
            one = np.ones(len(begins), bool) if single else d[begins] == d[begins + sizes - 1]  # digests are sorted within a bucket
            least = np.empty(len(b), np.int64)
            least[order] = np.repeat(np.minimum.reduceat(low[order], begins), sizes)
            settled = np.empty(len(b), bool)
            settled[order] = np.repeat(one, sizes)
            wanted = settled & ((least < low) | several)
            for r, start, stop in zip(range(len(counts)), np.cumsum(counts) - counts, np.cumsum(counts), strict=True):
                of = np.arange(start, stop)
                yes, no = of[wanted[of]], of[~settled[of]]
                if len(yes) or len(no):
                    cell = out.setdefault(int(block[r]), [[], [], [], [], []])
                    keys = digest[yes].tobytes() if single else _packed(bucket[yes], width)
                    cell[2 * single].append(keys)
                    cell[2 * single + 1].append(least[yes].tobytes())
                    cell[4].append(_packed(np.unique(bucket[no]), width))
        return _frame(result, [(number, *(b"".join(x) for x in cell)) for number, cell in out.items()])

    sent = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(own, ddl)
    return sent.groupBy("shard").applyInArrow(met, result)


def refined(data: bytes, ends: np.ndarray, length: int) -> np.ndarray:
    """Bucket pointers of all places of ``data``, by ``length`` bytes where so many are left before the end of the run, which ``ends`` gives for each place.

    A pointer is the number of places in smaller buckets. Places with fewer bytes than a round compares keep the pointer they have.
    """
    n = len(data)
    left = ends - np.arange(n)
    pointer, depth = np.zeros(n, np.int64), 0
    active, key = np.arange(n), _words(data, n)
    rest = FIRST
    while True:
        # The places of a bucket that are compared are sorted by bucket, then by what is further on; a new bucket begins where either changes.
        order = np.argsort(key[active], kind="stable") if depth == 0 else np.lexsort((key[active], pointer[active]))
        sorted_at = active[order]
        old, new = pointer[sorted_at], key[sorted_at]
        begins = np.concatenate([[True], (old[1:] != old[:-1]) | (new[1:] != new[:-1])]) if len(old) else np.zeros(0, bool)
        first_of_bucket = np.concatenate([[True], old[1:] != old[:-1]]) if len(old) else begins
        places = np.arange(len(old))
        into = np.maximum.accumulate(np.where(begins, places, 0)) - np.maximum.accumulate(np.where(first_of_bucket, places, 0))
        pointer[sorted_at] = old + into
        depth += rest
        if depth >= length:
            return pointer
        # Buckets of one are settled. The others go on by the pointers ``rest`` bytes ahead, which are as deep as their own.
        size = np.bincount(pointer, minlength=n)
        rest = min(depth, length - depth)
        active = np.flatnonzero((left >= depth + rest) & (size[pointer] > 1))
        key = np.zeros(n, np.int64)
        key[active] = pointer[active + rest]


def _least_ids(runs: list[bytes], low: np.ndarray, length: int) -> list[np.ndarray]:
    """For each run the smallest id that has each of its strings."""
    data, sizes = b"".join(runs), np.array([len(r) for r in runs])
    stops = np.cumsum(sizes)
    ends = np.repeat(stops, sizes)
    strings = np.flatnonzero(ends - np.arange(len(data)) >= length)
    pointer = refined(data, ends, length)[strings]
    owner = low[np.repeat(np.arange(len(runs)), sizes)[strings]]
    order = np.argsort(pointer, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], np.diff(pointer[order]) != 0]))
    least = np.empty(len(strings), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(owner[order], begins), np.diff([*begins, len(order)]))
    return np.split(least, np.cumsum(sizes - length + 1)[:-1])


def _spans(least: np.ndarray) -> np.ndarray:
    """The strings of a run in spans of equal smallest id."""
    begins = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    out = np.empty(len(begins), SPAN)
    out["start"], out["stop"], out["least"] = begins, [*begins[1:], len(least)], least[begins]
    return out


def refine(blocks: DataFrame, opened: DataFrame, size: int, length: int, q: int) -> DataFrame:
    """``block, hits``: of the runs in ``opened(block, opened)`` buckets, packed as ``HIT``, the spans of strings that a smaller id has too."""
    width, shards = _width(size), 1 + size // REFINE_BYTES
    mask = (1 << 8 * width) - 1
    ddl = "shard long, block long, buckets binary, digests binary, sizes binary, runs binary, low binary, several binary"

    def own(table: pa.Table, said: pa.Table) -> pa.Table:
        wanted = np.unique(_unpacked(b"".join(said["opened"].to_pylist()), width))
        if not table.num_rows or not len(wanted):
            return _frame(ddl, [])
        texts = Texts(table["packed"][0].as_py())
        rows = _runs(texts.texts, length, q, mask)
        distinct, low, several = _lows(rows[_member(rows["bucket"], wanted)], texts.ids)
        out = []
        for shard, i in _by_shard(distinct["bucket"], shards):
            part = distinct[i]
            sizes = part["strings"] + np.int32(length - 1)
            runs = b"".join(texts.texts[d][at : at + n] for d, at, n in zip(part["doc"].tolist(), part["at"].tolist(), sizes.tolist(), strict=True))
            cells = _packed(part["bucket"], width), part["digest"].tobytes(), sizes.astype("<i4").tobytes(), runs, _packed_ids(low[i]), np.packbits(several[i]).tobytes()
            out.append((shard, table["block"][0].as_py(), *cells))
        return _frame(ddl, out)

    def sorted_runs(table: pa.Table) -> pa.Table:
        counts = [len(b) // width for b in table["buckets"].to_pylist()]
        block = np.repeat(table["block"].to_numpy(), counts)
        bucket = _unpacked(b"".join(table["buckets"].to_pylist()), width)
        digest, sizes = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("digests", "<u8"), ("sizes", "<i4")))
        data, stops = b"".join(table["runs"].to_pylist()), np.cumsum(sizes, dtype=np.int64)
        low = np.concatenate([_unpacked_ids(x) for x in table["low"].to_pylist()])
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table["several"].to_pylist(), counts, strict=True)]).astype(bool)
        order = np.lexsort((digest, bucket))
        edges = [*np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]])).tolist(), len(order)]
        out: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        runs: dict[bytes, list[int]] = {}
        waiting = 0
        for a, b in zip(edges, edges[1:], strict=False):
            for r in order[a:b].tolist():
                run = data[stops[r] - sizes[r] : stops[r]]
                waiting += len(run) if run not in runs else 0
                runs.setdefault(run, []).append(r)
            if waiting < SORTED_BYTES and b < len(order):
                continue
            lows = np.array([low[of].min() for of in runs.values()], np.int64)
            for least, of in zip(_least_ids(list(runs), lows, length), runs.values(), strict=True):
                spans = _spans(least)
                for r in of:
                    some = spans if several[r] else spans[spans["least"] < low[r]]
                    hits = np.empty(len(some), HIT)
                    hits["bucket"], hits["digest"] = bucket[r], digest[r]
                    for c in SPAN.names:
                        hits[c] = some[c]
                    out.append(hits)
                    owners.append(np.full(len(some), block[r]))
            runs, waiting = {}, 0
        hits, owner = np.concatenate(out or [np.zeros(0, HIT)]), np.concatenate(owners or [np.zeros(0, np.int64)])
        order = np.argsort(owner, kind="stable")
        there, begins = np.unique(owner[order], return_index=True)
        return _frame("block long, hits binary", [(b, h.tobytes()) for b, h in zip(there.tolist(), np.split(hits[order], begins[1:]), strict=True)] if len(hits) else [])

    sent = blocks.groupBy("block").cogroup(opened.groupBy("block")).applyInArrow(own, ddl)
    return sent.groupBy("shard").applyInArrow(sorted_runs, "block long, hits binary")


def _cut(texts: Texts, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple]:
    """The columns of :func:`cut` for each text, given the text and the bytes of each interval that goes."""
    order = np.argsort(doc, kind="stable")
    doc, begin, end = doc[order], begin[order], end[order]
    cuts = np.searchsorted(doc, np.arange(len(texts.texts) + 1))
    out = []
    for i, text in enumerate(texts.texts):
        b, e = begin[cuts[i] : cuts[i + 1]], end[cuts[i] : cuts[i + 1]]
        if not len(b):
            out.append((texts.doc_ids[i], len(text), 0, 0, text))
            continue
        by = np.argsort(b, kind="stable")
        b, reach = b[by], np.maximum.accumulate(e[by])
        new = np.concatenate([[True], b[1:] > reach[:-1]])  # what touches is one run
        first, stop = b[new], reach[np.concatenate([new[1:], [True]])]
        kept = b"".join(text[x:y] for x, y in zip([0, *stop.tolist()], [*first.tolist(), len(text)], strict=True))
        out.append((texts.doc_ids[i], len(text), len(text) - len(kept), len(first), kept))
    return out


def cut(blocks: DataFrame, said: DataFrame, size: int, length: int, q: int) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept binary`` of each text, without the bytes that the verdicts and hits of ``said`` cover."""
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    width = _width(size)
    mask = (1 << 8 * width) - 1

    def own(table: pa.Table, said: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _frame(ddl, [])
        texts = Texts(table["packed"][0].as_py())
        raw = {c: b"".join(x or b"" for x in said[c].to_pylist()) for c in ("settled", "least", "single", "single_least", "hits")}
        found = [(np.zeros(0, np.int64),) * 3]

        def cover(rows: np.ndarray, start: np.ndarray | int, stop: np.ndarray, least: np.ndarray) -> None:
            yes = texts.ids[rows["doc"]] > least
            found.append(tuple(x[yes] for x in (rows["doc"].astype(np.int64), rows["at"] + start, rows["at"] + stop + length - 1)))

        if raw["settled"] or raw["hits"]:
            rows = _runs(texts.texts, length, q, mask)
            for keys, least in ((_unpacked(raw["settled"], width), np.frombuffer(raw["least"], np.int64)),):
                order = np.argsort(keys)
                of = rows[_member(rows["bucket"], keys[order])]
                cover(of, 0, of["strings"], least[order][np.searchsorted(keys[order], of["bucket"])])
            hits = np.sort(np.frombuffer(raw["hits"], HIT), order="digest")
            low, high = (np.searchsorted(hits["digest"], rows["digest"], side) for side in ("left", "right"))
            some = np.flatnonzero(high > low)
            n = (high - low)[some]
            of = np.repeat(some, n)
            hit = hits[np.repeat(low[some], n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)]
            same = hit["bucket"] == rows["bucket"][of]
            cover(rows[of[same]], hit["start"][same], hit["stop"][same], hit["least"][same])
        if raw["single"]:
            keys, least = np.frombuffer(raw["single"], np.uint64), np.frombuffer(raw["single_least"], np.int64)
            order = np.argsort(keys)
            rows = _runs(texts.texts, length, q, mask, each=True)
            of = rows[_member(rows["digest"], keys[order])]
            cover(of, 0, of["strings"], least[order][np.searchsorted(keys[order], of["digest"])])
        return _frame(ddl, _cut(texts, *(np.concatenate(x) for x in zip(*found, strict=True))))

    return blocks.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(own, ddl)


def dedup(docs: DataFrame, length: int = 50, q: int = 24, hot: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept binary`` per document, without every byte that a string of ``length`` bytes of a smaller id covers."""
    if not FIRST <= q <= length:
        raise ValueError(f"q is from {FIRST} to the length of the strings")
    blocks, size = laid_out(docs)
    found = written(verdicts(blocks, shared_buckets(blocks, size, length, q, hot), size, length, q), "verdicts")
    hits = refine(blocks, found.select("block", "opened"), size, length, q)
    none = F.lit(None).cast("binary")
    said = found.select("block", "settled", "least", "single", "single_least", none.alias("hits"))
    said = said.unionByName(hits.select("block", *(none.alias(c) for c in ("settled", "least", "single", "single_least")), "hits"))
    return cut(blocks, said, size, length, q)
