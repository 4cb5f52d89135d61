"""Language identification, word first with backoff to character n-grams.

A known word scores by its log frequency in each language. An unseen word falls back to the longest n-grams of its
characters (edges marked) of which any is known: length 5, then 4, down to single characters; it scores by their mean.

The model is fitted on a bounded sample of labelled rows, ``max_rows`` and ``max_chars`` code points, of which every language has
an equal share, so a rare language is learned from a large table as from a small one. Every word and n-gram of the sample is
kept; they are keyed by 64-bit hashes, and an entry lists only the languages that have it, so the model is 16 bytes for each word or n-gram and 8 more for each
of its languages, however many languages there are. Languages beyond ``max_rows`` aren't learned, the least frequent ones.

Defined results: null text, empty text, or text without a letter, is ``und`` with score 0. If nothing was learned every text is
``und``. A tie goes to the language with more training words, then to the first by name. Whole texts are read however long they are,
rows that repeat a doc_id or a text count as they are, in training too, an empty table gives an empty result, extra columns are dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricepanel.llm.common import Lookup, hashes, map_slices, quota_sample, sources, written

#: Bounds of the sample; longest n-gram.
MAX_ROWS, MAX_CHARS, LONGEST = 20_000, 40_000_000, 5
#: Entries of a model that are added up at a time.
ADDED = 1 << 22
#: Distinct words that a task counts before it hands its counts on.
HELD = 100_000
words_of = re.compile(r"[^\W\d_]+").findall


def grams_of(word: str, n: int) -> list[str]:
    """The character n-grams of a word with its edges marked; single characters without the marks."""
    if n == 1:
        return list(word)
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Parts:
    """What words or n-grams add to a language's score above ``unseen``, for the languages that have them."""

    #: First entry and number of entries of each key.
    of: Lookup
    lang: np.ndarray
    gain: np.ndarray

    @classmethod
    def build(cls, part: np.ndarray, lang: np.ndarray, n: np.ndarray) -> Parts:
        order = np.argsort(part, kind="stable")
        keys, begins, sizes = np.unique(part[order], return_index=True, return_counts=True)
        return cls(Lookup(keys, np.stack([begins, sizes], axis=1).astype(np.int32)), lang[order].astype(np.int32), np.log1p(10.0 * n[order]).astype(np.float32))

    def entries(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each place in ``of`` its entries: which place each is of, and its place in ``lang`` and ``gain``."""
        begin, size = self.of.values[at].T.astype(np.int64) if len(at) else np.zeros((2, 0), np.int64)
        which = np.repeat(np.arange(len(at)), size)
        return which, np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(which))


@dataclass
class Model:
    """Log frequencies by language of the sample's words and n-grams: what unseen ones of each length have, and the gains of those seen."""

    langs: list[str]
    unseen: np.ndarray
    words: Parts
    grams: Parts

    def _unknown(self, words: list[str], texts: np.ndarray, of: np.ndarray, totals: np.ndarray) -> None:
        """Adds the scores of words that aren't known, which occur in ``texts`` as number ``of``, by the longest known n-grams."""
        left = np.arange(len(words))
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            own = [grams_of(words[i], n) for i in left]
            at = self.grams.of.places(hashes(list(chain.from_iterable(own))))
            word = np.repeat(np.arange(len(left)), [len(g) for g in own])[at >= 0]
            found = np.bincount(word, minlength=len(left))
            if (met := found > 0).any():
                # The occurrences of the words that are settled at this length, and their n-grams' entries.
                place = np.full(len(words), -1)
                place[left[met]] = np.flatnonzero(met)
                here = place[of] >= 0
                grams = at[at >= 0]
                begins = np.cumsum(found) - found  # n-grams come in the order of their words
                self._add(self.grams, grams, begins, found, place[of[here]], texts[here], totals)
                totals += np.bincount(texts[here], minlength=len(totals))[:, None] * self.unseen[n]
            left = left[~met]

    @staticmethod
    def _add(parts: Parts, keys: np.ndarray, begins: np.ndarray, sizes: np.ndarray, of: np.ndarray, texts: np.ndarray, totals: np.ndarray) -> None:
        """Adds to the total of each text the mean gain of the keys of each of its words ``of``: ``sizes`` from ``begins`` on."""
        at = 0
        each = sizes[of]
        while at < len(of):  # so many occurrences at a time as have ADDED entries, one at least
            stop = at + max(1, int(np.searchsorted(np.cumsum(each[at:] * totals.shape[1]), ADDED, "right")))
            n, text = each[at:stop], texts[at:stop]
            which = np.repeat(np.arange(stop - at), n)
            key = keys[np.repeat(begins[of[at:stop]] - (np.cumsum(n) - n), n) + np.arange(len(which))]
            entry_of, entry = parts.entries(key)
            cell = text[which[entry_of]] * totals.shape[1] + parts.lang[entry]
            totals += np.bincount(cell, parts.gain[entry] / n[which[entry_of]], totals.size).reshape(totals.shape)
            at = stop

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        own = [words_of((t or "").lower()) for t in texts]
        # Some characters that count as parts of words, such as raised figures, are no letters.
        known = [bool(self.langs) and any(c.isalpha() for w in words for c in w) for words in own]
        own = [words if k else [] for words, k in zip(own, known, strict=True)]
        sizes = np.array([len(words) for words in own])
        every = list(chain.from_iterable(own))
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not every:
            return langs, scores
        keys, text = hashes(every), np.repeat(np.arange(len(own)), sizes)
        distinct, first, of = np.unique(keys, return_index=True, return_inverse=True)
        at = self.words.of.places(distinct)
        totals = np.zeros((len(own), len(self.langs)))
        seen = at[of] >= 0
        ones = np.ones(len(at), np.int64)
        self._add(self.words, at, np.arange(len(at)), ones, of[seen], text[seen], totals)
        totals += np.bincount(text[seen], minlength=len(own))[:, None] * self.unseen[0]
        missing = np.flatnonzero(at < 0)
        number = np.full(len(at), -1)
        number[missing] = np.arange(len(missing))
        self._unknown([every[first[i]] for i in missing], text[~seen], number[of[~seen]], totals)
        for i in np.flatnonzero(sizes):
            total = totals[i]
            best = int(total.argmax())
            shares = np.exp((total - total[best]) * min(1.0, 50 / sizes[i]))
            langs[i], scores[i] = self.langs[best], float(shares[best] / shares.sum())
        return langs, scores


def _words(rows: DataFrame) -> DataFrame:
    """``(lang, word, n)``; summed in the task first."""

    def run(slices: Iterator[list[list]]) -> Iterator[list[list]]:
        held: Counter = Counter()
        for langs, texts in slices:
            for lang, text in zip(langs, texts, strict=True):
                held.update((lang, w) for w in words_of(text.lower()))
                if len(held) > HELD:
                    yield [[k[0] for k in held], [k[1] for k in held], list(held.values())]
                    held.clear()
        yield [[k[0] for k in held], [k[1] for k in held], list(held.values())]

    return map_slices(rows, run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _parts(words: DataFrame) -> DataFrame:
    """``(size, part, lang, n)``: hashes of the counted words (size 0) and of their n-grams."""

    def run(slices: Iterator[list[list]]) -> Iterator[list[list]]:
        for langs, words, counts in slices:
            for n in range(LONGEST + 1):
                own = [grams_of(w, n) if n else [w] for w in words]
                sizes = [len(g) for g in own]
                parts = hashes(list(chain.from_iterable(own))).view(np.int64)
                yield [np.full(len(parts), n), parts, [lang for lang, k in zip(langs, sizes, strict=True) for _ in range(k)], np.repeat(counts, sizes)]

    return map_slices(words, run, "size int, part long, lang string, n long", rows=4096).groupBy("size", "part", "lang").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    """Model of ``labelled(doc_id, text, lang)``; rows without text or lang teach nothing."""
    taught = sources(labelled, "doc_id", "text", "lang").where("text is not null and lang is not null")
    words = written(_words(quota_sample(taught, "lang", max_rows, max_chars).select("lang", "text")), "words")
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals, key=lambda k: (-totals[k], k))
    number = {k: i for i, k in enumerate(langs)}
    # Bounded by the sample: a word has six n-grams a code point at most, and a row here is 20 bytes.
    rows = _parts(words).toArrow()
    names = rows["lang"].combine_chunks().dictionary_encode()
    size, part, n = (rows[c].to_numpy() for c in ("size", "part", "n"))
    lang = np.array([number[k] for k in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()] if len(rows) else np.zeros(0, np.int64)
    # n-grams of one length compete with each other only, so their frequencies are shares of that length.
    unseen = np.zeros((LONGEST + 1, max(1, len(langs))))
    for k in range(LONGEST + 1):
        of = size == k
        total = np.bincount(lang[of], n[of], max(1, len(langs)))
        unseen[k] = np.log(0.1 / (total + 0.1 * (len(np.unique(part[of])) + 1)))
    word = size == 0
    keys = part.view(np.uint64)
    return Model(langs, unseen, Parts.build(keys[word], lang[word], n[word]), Parts.build(keys[~word], lang[~word], n[~word]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` for every whole text; only the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(slices: Iterator[list[list]]) -> Iterator[list[list]]:
        for ids, texts in slices:
            yield [ids, *shared.value.predict(texts)]

    return map_slices(sources(docs, "doc_id", "text"), run, "doc_id long, lang_pred string, score double")
