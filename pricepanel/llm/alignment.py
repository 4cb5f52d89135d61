"""Alignment of two tokenizers over the same text, and of their vocabularies over a corpus.

Tokenizer A is a byte-level BPE file of the tokenizers library and reads a space and the text; tokenizer B is a sentencepiece model that
adds that space itself. The cumulative ends of each token's bytes go into two dictionaries from end to index; their common keys, sorted,
slice both id lists into groups, and the tokens of a slice that end with it are linked. An id pair's count is how many links hold it in the whole corpus.

A space or line feed between two characters that aren't white space starts a token of A; of B too, if no piece has a space behind another character or a line
feed. So texts are cut there into units, a unit that recurs is aligned once a worker, and a text's groups and links are those of its units. Should a
unit's bytes not come back, or B's pieces not allow cutting, the whole text is encoded and aligned at once.

Counting: a task lays the pairs of a block of texts (``SLICE_ROWS`` rows, ``SLICE_CHARS`` bytes) together, so that a pair is shuffled once a
block, however many of its texts have it; counts come back to the block in the same way, and blocks to their texts.

Defined results: a text that is null, empty, or whose tokens of A or B don't spell the space and the text, has no tokens: zeros and an empty
string of groups. Strings of special tokens are plain text. Very long texts are aligned whole, their dictionaries over ``PIECE`` tokens at a time. Rows with equal
ids or texts are independent and each counts; ties for the highest count are all best; an empty table gives an empty result; extra
columns of the input are dropped.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricepanel.llm.bpe import byte_table
from pricepanel.llm.common import map_slices, sources

#: White space that isn't alone between two other characters, and the places to cut at: a space goes, a line feed stays with what follows.
WIDE_SPACE, CUT = re.compile(r"\s\s|\A\s|\s\Z").search, re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)").split
#: Tokens of A whose ends are in a dictionary at a time.
PIECE = 1 << 16
#: Characters of a unit that is remembered, and bytes of all units that a worker remembers; beyond half of them memory starts anew beside the old.
MEMO_CHARS, MEMO_BYTES = 64, 160 << 20
NOTHING = (0, 0, 0, 0, "", b"")
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "block long, link_at array<int>, link_times array<int>, pairs array<long>, pair_times array<long>"
)


def common_ends(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """The places after the last tokens of A, and of B, at each end that both have, in order of the ends."""
    stops: tuple[list[int], list[int]] = [], []
    at = first = 0
    while at < len(ends_a):
        stop = bisect_right(ends_a, ends_a[min(at + PIECE, len(ends_a)) - 1])
        last = bisect_right(ends_b, ends_a[stop - 1])
        index_a = dict(zip(ends_a[at:stop], count(at + 1), strict=False))
        index_b = dict(zip(ends_b[first:last], count(first + 1), strict=False))
        both = sorted(index_a.keys() & index_b.keys())
        stops[0].extend(map(index_a.__getitem__, both))
        stops[1].extend(map(index_b.__getitem__, both))
        at, first = stop, last
    return stops


def sliced(a: list[int], b: list[int], sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The groups of two lists of ids that spell the same bytes, the end of each, and the packed links with the place after each group's last."""
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    stops_a, stops_b = (np.array(s, np.int64) for s in common_ends(ends_a.tolist(), ends_b.tolist()))
    last_a, last_b = (np.array(ids, np.int64)[stops - 1] for ids, stops in ((a, stops_a), (b, stops_b)))
    from_a, from_b = (np.concatenate([[0], stops[:-1]]).astype(np.int64) for stops in (stops_a, stops_b))
    groups = list(map("%d|%d".__mod__, zip(last_a.tolist(), last_b.tolist(), strict=True)))
    several = np.flatnonzero((stops_a - from_a > 1) | (stops_b - from_b > 1))
    bounds = (x[several].tolist() for x in (from_a, stops_a, from_b, stops_b))
    for k, i, stop_a, j, stop_b in zip(several.tolist(), *bounds, strict=True):
        groups[k] = f"{','.join(map(str, a[i:stop_a]))}|{','.join(map(str, b[j:stop_b]))}"
    links = last_a << 32 | last_b
    counts = np.ones(len(links), np.int64)
    if not (sizes_a.all() and sizes_b.all()):  # tokens without bytes end together with the one before them
        out = []
        for i, stop_a, j, stop_b in zip(*(x.tolist() for x in (from_a, stops_a, from_b, stops_b)), strict=True):
            with_a = [v for v, end in zip(a[i:stop_a], ends_a[i:stop_a], strict=True) if end == ends_a[stop_a - 1]]
            with_b = [w for w, end in zip(b[j:stop_b], ends_b[j:stop_b], strict=True) if end == ends_b[stop_b - 1]]
            out.append([v << 32 | w for v in with_a for w in with_b])
        links, counts = np.array(list(chain.from_iterable(out)), np.int64), np.array([len(x) for x in out], np.int64)
    return groups, ends_a[stops_a - 1], links, np.cumsum(counts)


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the units aligned so far; built once in a Python worker."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        byte_of = {char: b for b, char in enumerate(byte_table())}
        self.bytes_a = {i: bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode() for token, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        self.cuts = not self.b.is_unknown(self.space) and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.size_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(max(self.bytes_a) + 1)])
        self.size_b = np.array([len(own) for own in self.bytes_b])
        #: Units met lately, and those of the time before, from which they come back when met again.
        self.memo: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}
        self.memo_bytes = 0

    def _units(self, text: str) -> list[str]:
        """The units of a text: a space goes before each that doesn't begin with a line feed."""
        if not self.cuts or text[:1] == "\n":
            return [text]
        return CUT(text) if WIDE_SPACE(text) else text.replace("\n", " \n").split(" ")

    def _aligned(self, units: list[str], whole: bool = False) -> list[tuple | None]:
        """Tokens, groups and links of units, or of whole texts; None where their bytes don't come back."""
        spelt = [" " + u if whole or u[:1] != "\n" else u for u in units]
        own_a = [e.ids for e in self.a.encode_batch_fast(spelt, add_special_tokens=False)]
        own_b = self.b.encode(units, num_threads=1)
        for text, ids in zip(spelt, own_b, strict=True):
            if text[:1] == "\n" and ids[:1] == [self.space]:
                del ids[0]  # the space that B adds is only the text's
        return self._records([s.encode() for s in spelt], own_a, own_b)

    def _records(self, raw: list[bytes], own_a: list[list[int]], own_b: list[list[int]]) -> list[tuple | None]:
        """A record of each unit. All of them are laid end to end, since units end where their tokens do, and sliced at once."""
        a, b = list(chain.from_iterable(own_a)), list(chain.from_iterable(own_b))
        sizes_a, sizes_b = self.size_a[np.array(a, np.int64)], self.size_b[np.array(b, np.int64)]
        stops = np.cumsum([len(r) for r in raw])
        spells = lambda sizes, own: np.array_equal(np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([len(x) for x in own])], stops)
        want = b"".join(raw)
        if not (spells(sizes_a, own_a) and spells(sizes_b, own_b) and b"".join(map(self.bytes_a.__getitem__, a)) == want == b"".join(map(self.bytes_b.__getitem__, b))):
            fine = [b"".join(map(self.bytes_a.__getitem__, x)) == r == b"".join(map(self.bytes_b.__getitem__, y)) for r, x, y in zip(raw, own_a, own_b, strict=True)]
            rest = iter(self._records(*([x for x, ok in zip(own, fine, strict=True) if ok] for own in (raw, own_a, own_b))) if any(fine) else [])
            return [next(rest) if ok else None for ok in fine]
        groups, ends, links, upto = sliced(a, b, sizes_a, sizes_b)
        cuts = np.concatenate([[0], np.searchsorted(ends, stops, "right")])
        packed, places = links.astype("<i8").tobytes(), (8 * np.concatenate([[0], upto])[cuts]).tolist()
        cuts = cuts.tolist()
        return [
            (len(x), len(y), stop - start, (q - p) // 8, ";".join(groups[start:stop]), packed[p:q])
            for x, y, start, stop, p, q in zip(own_a, own_b, cuts, cuts[1:], places, places[1:], strict=False)
        ]

    def _remember(self, unit: str, record: tuple | None) -> None:
        self.memo[unit] = record
        # What an entry's objects and its place in the table take, besides the strings.
        self.memo_bytes += 300 + 2 * len(unit) + (len(record[4]) + len(record[5]) if record else 0)

    def align(self, texts: list[str]) -> list[tuple]:
        """Numbers of tokens, groups and links, the groups, and the packed links of each text."""
        units = [self._units(t) for t in texts]
        if self.memo_bytes > MEMO_BYTES // 2:
            self.older, self.memo, self.memo_bytes = self.memo, {}, 0
        known, older = self.memo, self.older
        unseen, long = [], {}
        for unit in {u for own in units if len(own) > 1 for u in own}:
            if unit not in known:
                if unit in older:
                    self._remember(unit, older[unit])
                else:
                    unseen.append(unit)
        for at in range(0, len(unseen), 10_000):
            part = unseen[at : at + 10_000]
            for unit, record in zip(part, self._aligned(part), strict=True):
                if len(unit) <= MEMO_CHARS:
                    self._remember(unit, record)
                else:
                    long[unit] = record
        get = known.__getitem__
        out = []
        for text, own in zip(texts, units, strict=True):
            records = [long[u] if u in long else get(u) for u in own] if len(own) > 1 and long else list(map(get, own)) if len(own) > 1 else [None]
            if None in records:
                out.append((self._aligned([text], whole=True)[0] if text else None) or NOTHING)
            else:
                n_a, n_b, n_groups, n_links, groups, links = zip(*records, strict=True)
                out.append((sum(n_a), sum(n_b), sum(n_groups), sum(n_links), ";".join(groups), b"".join(links)))
        return out


# A worker keeps one aligner at a time.
@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Groups and links of every whole text, in blocks of texts.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the ids of A and B of each group. ``link_at`` and ``link_times`` are a text's distinct linked pairs, as
    places in its block's list, and how often each is linked. The first row of a ``block`` has that list: ``pairs`` (A's id times 2^32, plus
    B's) and ``pair_times`` over the block.
    """

    def run(slices: Iterator[list[list]]) -> Iterator[list[list]]:
        own, blocks = aligner(path_a, path_b), count(TaskContext.get().partitionId() << 33)
        for ids, texts in slices:
            found = own.align([t or "" for t in texts])
            distinct = [np.unique(np.frombuffer(links, "<i8"), return_counts=True) for *_, links in found]
            pairs, at = np.unique(np.concatenate([keys for keys, _ in distinct]), return_inverse=True)
            times = np.concatenate([n for _, n in distinct])
            ends = np.cumsum([len(keys) for keys, _ in distinct])[:-1]
            n_a, n_b, n_groups, n_links, groups, _ = zip(*found, strict=True)
            first = lambda values: [values, *[None] * (len(ids) - 1)]  # noqa: B023, E731
            totals = np.bincount(at, times, len(pairs)).astype(np.int64) if len(pairs) else pairs
            yield [ids, n_a, n_b, n_groups, n_links, groups, [next(blocks)] * len(ids), np.split(at, ends), np.split(times, ends), first(pairs), first(totals)]

    return map_slices(sources(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, RESULT)


def block_pairs(aligned: DataFrame) -> DataFrame:
    """``block, at, pair, times``: the pairs of each block of :func:`align`."""
    entries = aligned.where(F.col("pairs").isNotNull()).select("block", F.posexplode(F.arrays_zip("pairs", "pair_times")).alias("at", "entry"))
    return entries.select("block", "at", F.col("entry.pairs").alias("pair"), F.col("entry.pair_times").alias("times"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, links, best``: the links that hold each id pair over the corpus, and whether no other pair of its B id has more.

    The window over a B id sees at most one row for each id of A.
    """
    totals = block_pairs(aligned).groupBy("pair").agg(F.sum("times").alias("links"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    return totals.select("pair", "links", (F.col("links") == F.max("links").over(of_b)).alias("best"))


def scored(aligned: DataFrame) -> DataFrame:
    """``aligned`` with ``n_best``, the links whose pair is its B id's best, and ``count_sum``, the sum of the pairs' counts over the links.

    ``aligned`` must be a written table, since its blocks are numbered by task.
    """
    known = block_pairs(aligned).join(pair_counts(aligned), "pair")
    lists = known.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "links", "best"))).alias("known"))
    total = lambda of: F.aggregate(F.zip_with("link_at", "link_times", of), F.lit(0).cast("long"), lambda so_far, x: so_far + x)
    entry = lambda i: F.get("known", i)
    best = total(lambda i, n: F.when(entry(i)["best"], n.cast("long")).otherwise(0))
    sums = total(lambda i, n: entry(i)["links"] * n)
    rest = [c for c in aligned.columns if c not in ("block", "link_at", "link_times", "pairs", "pair_times")]
    return aligned.select(*rest, "block", "link_at", "link_times").join(lists, "block", "left").select(*rest, best.alias("n_best"), sums.alias("count_sum"))
