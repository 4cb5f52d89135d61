"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The score of a document and a test item is their best local alignment by words (match 2, mismatch -1, gap -2) divided by that of the
item with itself; documents that reach ``threshold`` are contaminated. What such an alignment must keep of the item follows from the
threshold, so the filters before it lose nothing:

- An item of ``L`` words may lose ``budget = floor(2 L (1 - threshold))`` of its score. An inserted word costs 2, a replaced one 3, a dropped one 4,
  one cut off at an end 2. So the alignment falls into ``budget / 2 + 1`` intact runs at most, and one has ``L / (budget / 2 + 1)`` words or more:
  that is the item's seed length, three at most (:func:`seed_length`).
- Every unit of cost spoils ``(n - 1) / 2``, ``n / 3`` or a half of the item's places of n-grams at most, so at least :func:`least_places` of them are intact. All but
  that many less one are seeds, the rarest among the documents, and a document with fewer known places of an item than that isn't aligned.

One pass over the documents finds the known n-grams of each, and counts them; documents that could be copies are written with their
text. Seeds found there pick the item and the diagonals to align around.

Items are broadcast in blocks of ``block`` words on average (some 40 MB in a worker), dealt by a hash of their id, so that is the bound for any benchmark of
items that are shorter; each block takes its own pass over the documents. Of several texts of one item id the smallest counts.

Defined results: null, empty and wordless texts and items match nothing; each pair of document and item is returned once with its best
score, however often it occurs; equal scores take the first place; rows that repeat a doc_id give one pair; null doc_ids are one document;
very long texts are read whole; empty tables give an empty result; extra columns are dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricepanel.llm.common import map_slices, sources, written

#: Words of a seed at most, score from which a document is a copy, words of a block of items.
SEED, THRESHOLD, BLOCK = 3, 0.6, 80_000
#: Scores of a match, of a mismatch and of a gap of one word.
MATCH, MISMATCH, GAP = 2, -1, -2
RESULT = "doc_id long, item_id long, score double, first_word int, end_word int"
words_of = re.compile(r"\w+").findall


def budget(length: int, threshold: float = THRESHOLD) -> int:
    """What an item of so many words may lose of its own score."""
    return math.floor(MATCH * length * (1 - threshold) + 1e-9)


def seed_length(length: int, threshold: float = THRESHOLD, most: int = SEED) -> int:
    """Words of the longest run that every passing copy keeps, ``most`` at most."""
    return min(most, -(-length // (budget(length, threshold) // 2 + 1)))


def least_places(length: int, n: int, threshold: float = THRESHOLD) -> int:
    """Places of n-grams of the item that every passing copy keeps, one at least by the choice of ``n``."""
    return max(1, length - n + 1 - math.floor(budget(length, threshold) * max((n - 1) / 2, n / 3, 1 / 2) + 1e-9))


def align(passage: list[str], item: list[str]) -> tuple[int, int, int]:
    """Best local alignment score, with the first and last+1 word of ``passage`` in it."""
    codes: dict[str, int] = {}
    b = np.array([codes.setdefault(w, len(codes)) for w in item])
    a = [codes.get(w, -1) for w in passage]
    steps = -GAP * np.arange(len(b) + 1)
    places = np.arange(len(b) + 1)
    above, starts = np.zeros(len(b) + 1, np.int64), np.zeros(len(b) + 1, np.int64)
    best = (0, 0, 0)
    for i, code in enumerate(a):
        diagonal = above[:-1] + np.where(b == code, MATCH, MISMATCH)
        here = np.zeros(len(b) + 1, np.int64)
        here[1:] = np.maximum(np.maximum(diagonal, above[1:] + GAP), 0)
        from_ = np.full(len(b) + 1, i)
        from_[1:] = np.where(here[1:] == 0, i + 1, np.where(diagonal >= above[1:] + GAP, np.where(above[:-1] > 0, starts[:-1], i), starts[1:]))
        # Gaps along the item: the best earlier cell less its distance.
        lifted = np.maximum.accumulate(here + steps)
        by_gap = lifted - steps
        source = np.maximum.accumulate(np.where(here + steps == lifted, places, 0))
        from_ = np.where(by_gap > here, from_[source], from_)
        above, starts = np.maximum(here, by_gap), from_
        top = int(above.argmax())
        if above[top] > best[0]:
            best = (int(above[top]), int(starts[top]), i + 1)
    return best


class Block:
    """Items of one block: their words, and the places of their n-grams."""

    def __init__(self, items: list[tuple[int, list[str]]], threshold: float, most: int) -> None:
        self.items, self.threshold = dict(items), threshold
        self.length = {item: seed_length(len(words), threshold, most) for item, words in items}
        self.least = {item: least_places(len(words), self.length[item], threshold) for item, words in items}
        self.ids: dict[str, int] = {}
        self.places: list[list[tuple[int, int]]] = []
        for item, words in items:
            n = self.length[item]
            for at in range(len(words) - n + 1):
                gram = " ".join(words[at : at + n])
                if gram not in self.ids:
                    self.ids[gram] = len(self.places)
                    self.places.append([])
                self.places[self.ids[gram]].append((item, at))
        # Whether two words that follow each other are the first of a known n-gram says in one look that most places have none.
        self.heads = {tuple(words[at : at + min(2, self.length[item])]) for item, words in items for at in range(len(words) - self.length[item] + 1)}
        self.sizes = sorted({*self.length.values()})

    def hits(self, words: list[str]) -> list[tuple[int, int]]:
        """Place in a text and number of each known n-gram."""
        out, ids = [], self.ids
        if 1 in self.sizes:
            out += [(i, ids[w]) for i, w in enumerate(words) if (w,) in self.heads]
        if self.sizes and self.sizes[-1] > 1:
            heads = self.heads
            for i in [i for i, pair in enumerate(zip(words, words[1:], strict=False)) if pair in heads]:
                out += [(i, ids[gram]) for n in self.sizes if n > 1 and i + n <= len(words) and (gram := " ".join(words[i : i + n])) in ids]
        return out

    def possible(self, hits: list[tuple[int, int]]) -> bool:
        """Whether some item has as many of its places in the text as each of its copies must keep."""
        found = Counter(item for gram in {g for _, g in hits} for item, _ in self.places[gram])
        return any(n >= self.least[item] for item, n in found.items())

    def rarest(self, counts: dict[int, int]) -> set[tuple[int, int]]:
        """``(item, gram)`` of the seeds: of each item the commonest n-grams go, as many places less one as a copy must keep."""
        own: dict[int, Counter] = defaultdict(Counter)
        for gram, places in enumerate(self.places):
            for item, _ in places:
                own[item][gram] += 1
        seeds = set()
        for item, grams in own.items():
            spare = self.least[item] - 1
            for gram in sorted(grams, key=lambda g: (-counts.get(g, 0), g)):
                if grams[gram] <= spare:
                    spare -= grams[gram]
                else:
                    seeds.add((item, gram))
        return seeds


def _known_grams(docs: DataFrame, block: Block) -> DataFrame:
    """``(doc_id, grams, text)`` of the documents with a known n-gram: distinct ones, and the text if it could be a copy."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(slices: Iterator[list[list]]) -> Iterator[list[list]]:
        for ids, texts in slices:
            out: list[list] = [[], [], []]
            for key, text in zip(ids, texts, strict=True):
                if hits := shared.value.hits(words_of((text or "").lower())):
                    row = (key, sorted({g for _, g in hits}), text if shared.value.possible(hits) else None)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield out

    return map_slices(docs, run, "doc_id long, grams array<int>, text string")


def _windows(diagonals: dict[int, set[int]], length: int, slack: int, least: int, words: int) -> Iterator[tuple[int, int]]:
    """First and last+1 word of the passages that hold every alignment through a seed; passages that overlap are one.

    ``diagonals`` has the item's places found on each diagonal (place in the text less place in the item).
    """
    lo = hi = None
    found: set[int] = set()
    for d in sorted(diagonals):
        a, b = max(0, d - slack), min(words, d + length + slack)
        if hi is not None and a > hi:
            if len(found) >= least:
                yield lo, hi
            lo, found = None, set()
        lo, hi = (a if lo is None else lo), b
        found |= diagonals[d]
    if hi is not None and len(found) >= least:
        yield lo, hi


def _aligned(rows: DataFrame, block: Block, seeds: set[tuple[int, int]]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((block, seeds))

    def run(slices: Iterator[list[list]]) -> Iterator[list[list]]:
        block, seeds = shared.value
        for ids, texts in slices:
            out: list[list] = [[], [], [], [], []]
            for key, text in zip(ids, texts, strict=True):
                words = words_of(text.lower())
                diagonals: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
                seeded = set()
                for i, gram in block.hits(words):
                    for item, at in block.places[gram]:
                        diagonals[item][i - at].add(at)
                        if (item, gram) in seeds:
                            seeded.add(item)
                for item in seeded:
                    target, best = block.items[item], (0, 0, 0)
                    slack = budget(len(target), block.threshold) // 2 + 1
                    for lo, hi in _windows(diagonals[item], len(target), slack, block.least[item], len(words)):
                        score, a, b = align(words[lo:hi], target)
                        if score > best[0]:
                            best = (score, lo + a, lo + b)
                    if best[0] >= MATCH * len(target) - budget(len(target), block.threshold):
                        for column, value in zip(out, (key, item, best[0] / (MATCH * len(target)), best[1], best[2]), strict=True):
                            column.append(value)
            yield out

    return map_slices(rows, run, RESULT, rows=64)


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``doc_id, item_id, score, first_word, end_word`` of every document and item that align; words count from 0, end exclusive."""
    docs, items = sources(docs, "doc_id", "text"), sources(benchmark, "item_id", "text").where("item_id is not null and text is not null")
    items = written(items.groupBy("item_id").agg(F.min("text").alias("text")), "benchmark-items")
    total = items.agg(F.sum(F.size(F.split("text", r"\W+")))).first()[0] or 0
    n = max(1, -(-total // block))
    pieces = []
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).collect()  # ``block`` words on average
        known = Block([(r["item_id"], words) for r in part if (words := words_of(r["text"].lower()))], threshold, seed)
        if not known.items:
            continue
        found = written(_known_grams(docs, known), "known-grams")
        by_gram = found.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        counts = {r["gram"]: r["n"] for r in by_gram.collect()}  # the block's n-grams at most
        pieces.append(written(_aligned(found.where("text is not null").select("doc_id", "text"), known, known.rarest(counts)), "aligned"))
    if not pieces:
        return docs.sparkSession.createDataFrame([], RESULT)
    found = pieces[0]
    for p in pieces[1:]:
        found = found.union(p)
    best = F.max_by(F.struct("score", "first_word", "end_word"), F.struct("score", -F.col("first_word"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")
