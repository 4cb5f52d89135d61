"""Language-model scores by prediction by partial matching over bytes.

The trie of byte contexts, up to ``ORDER`` bytes long, is counted over all training texts. A byte is predicted from its longest
known context; where that has not seen it, an escape (as likely as the context's number of different bytes, method C) leads to
the context shorter by one, in which the bytes of the longer one are excluded, and at last to equal chances for the bytes left. The model is
pretrained: counts don't change while a text is scored. Its log10 probability of a text includes an end mark.

Contexts are counted as integers of packed bytes, sorted and summed in the task and then by Spark; the trie is written tables, a
pair for each context length, and keeps every context. The chances of the ``MAX_ENTRIES`` most frequent entries are broadcast; a document's other
bytes are counted by code and joined with the rest of the trie, or with the escapes of codes that it hasn't. The bound moves
work from one to the other and changes no score.

The base score is a smoothed unigram model of words, exact for any vocabulary: the ``TOP_WORDS`` most frequent words are
broadcast; a document's other words are joined with the counts of all others.

Defined results: null counts as empty text, which has one token, its end; without training texts every byte has an equal
chance; rows that repeat a doc_id, null ones too, are scored each; very long texts are scored whole, in pieces; an empty table gives an empty result; extra
columns are dropped.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricepanel.llm.common import Lookup, map_slices, sources, written

#: Context length in bytes; bounds of the broadcast chances and of the broadcast words.
ORDER, MAX_ENTRIES, TOP_WORDS = 4, 262_144, 100_000
#: Bytes whose contexts are sorted at a time, and distinct words that a task counts before it hands its counts on.
CHUNK, HELD = 2 << 20, 200_000
#: Bytes that UTF-8 never has: before a text's start, and its end.
START, END = 0xFE, 0xFF


def pieces(text: bytes, order: int = ORDER, size: int = CHUNK) -> list[bytes]:
    """The text with its start and end marks, cut into pieces of ``size`` bytes, each with the ``order`` bytes before it in front."""
    whole = bytes([START]) * order + text + bytes([END])
    return [whole[at - order : at + size] for at in range(order, len(whole), size)]


def packed(cut: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of :func:`pieces`: the context before it and itself as one integer; and where each piece begins."""
    raw = np.frombuffer(b"".join(cut), np.uint8)
    sizes = np.array([len(c) - order for c in cut], np.int64)
    codes = np.zeros(len(raw), np.uint64)
    for back in range(order + 1):
        codes[back:] |= raw[: len(raw) - back].astype(np.uint64) << np.uint64(8 * back)
    begins = np.cumsum(sizes) - sizes
    real = np.ones(len(raw), bool)
    for k in range(order):
        real[begins + order * np.arange(len(cut)) + k] = False
    return codes[real], begins


def grouped(texts: list[str | None], order: int = ORDER) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Pieces of the texts and which text each is of, ``CHUNK`` bytes and little more at a time."""
    of, held, size = [], [], 0
    for i, t in enumerate(texts):
        for piece in pieces((t or "").encode(), order):
            of.append(i)
            held.append(piece)
            size += len(piece)
            if size > CHUNK:
                yield np.array(of), held
                of, held, size = [], [], 0
    if held:
        yield np.array(of), held


def count_contexts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``(code, n)`` over all texts, for contexts of the full length."""

    def run(slices: Iterator[list[list]]) -> Iterator[list[list]]:
        held, size = [], 0

        def out() -> list[list]:
            codes, counts = np.unique(packed(held, order)[0], return_counts=True)
            return [codes.astype(np.int64), counts]

        for (own,) in slices:
            for t in own:
                for piece in pieces((t or "").encode(), order):
                    held.append(piece)
                    size += len(piece)
                    if size > CHUNK:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return map_slices(texts, run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _low(code: Column, n: int) -> Column:
    """The last ``n`` bytes of a packed code."""
    return code.bitwiseAND(F.lit((1 << 8 * n) - 1))


@dataclass
class Model:
    """Written tables by context length: ``entries[k](code, n)``, a context of ``k`` bytes and the byte after it, and
    ``contexts[k](context, total, kinds, left_total, left_kinds)``, where ``left`` is what stays in the context shorter by one once
    the bytes of this one are excluded."""

    entries: list[DataFrame]
    contexts: list[DataFrame]
    bytes_seen: int

    def known(self) -> DataFrame:
        """``(code, n, log)``: log10 chance of each byte that its full context has seen."""
        full = self.contexts[-1].select("context", "total", "kinds")
        met = self.entries[-1].withColumn("context", F.shiftright("code", 8)).join(full, "context")
        return met.select("code", "n", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("log"))

    def chances(self, codes: DataFrame) -> DataFrame:
        """``(code, log)`` of distinct ``codes(code)`` of the full length, by escapes where a context hasn't seen the byte."""
        none = F.lit(None).cast("long")
        rows = codes.select("code", F.lit(0.0).alias("log"), F.lit(False).alias("found"), none.alias("left_total"), none.alias("left_kinds"))
        for k in range(len(self.entries) - 1, -1, -1):
            entry = self.entries[k].select(F.col("code").alias("own"), "n")
            context = self.contexts[k].select("context", "total", "kinds", F.col("left_total").alias("next_total"), F.col("left_kinds").alias("next_kinds"))
            # Two bytes have 65,536 values: a proven bound. Longer keys meet as plain tables.
            entry, context = F.broadcast(entry) if k < 2 else entry, F.broadcast(context) if k < 3 else context
            own = _low(F.col("code"), k + 1)
            met = rows.withColumns({"own": own, "context": F.shiftright(own, 8)}).join(entry, "own", "left").join(context, "context", "left")
            total, kinds = F.coalesce("left_total", "total"), F.coalesce("left_kinds", "kinds")
            step = F.when(F.col("n").isNotNull(), F.log10(F.col("n") / (total + kinds))).when(kinds > 0, F.log10(kinds / (total + kinds))).otherwise(0.0)
            rows = met.select(
                "code",
                (F.col("log") + F.when(F.col("found"), 0.0).otherwise(step)).alias("log"),
                (F.col("found") | F.col("n").isNotNull()).alias("found"),
                F.col("next_total").alias("left_total"),
                F.col("next_kinds").alias("left_kinds"),
            )
        return rows.select("code", F.when(F.col("found"), F.col("log")).otherwise(F.col("log") - math.log10(max(256 - self.bytes_seen, 1))).alias("log"))


def fit(texts: DataFrame, order: int = ORDER) -> Model:
    """Model of all texts of the one-column ``texts``; every context counts."""
    entries = [written(count_contexts(texts, order), "entries")]
    for k in range(order, 0, -1):
        shorter = entries[0].groupBy(_low(F.col("code"), k).alias("code")).agg(F.sum("n").alias("n"))
        entries.insert(0, written(shorter, "entries"))
    totals = [e.groupBy(F.shiftright("code", 8).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")) for e in entries]
    none = F.lit(None).cast("long")
    contexts = [written(totals[0].withColumns({"left_total": none, "left_kinds": none}), "contexts")]
    for k in range(1, order + 1):
        # A shorter entry or context goes on in 256 longer ones at most, so no key is hot.
        counted = entries[k - 1].select(F.col("code").alias("short"), F.col("n").alias("m"))
        own = entries[k].select(F.shiftright("code", 8).alias("context"), _low(F.col("code"), k).alias("short"))
        taken = own.join(counted, "short").groupBy("context").agg(F.sum("m").alias("taken"))
        below = contexts[k - 1].select(F.col("context").alias("below"), F.col("total").alias("all"), F.col("kinds").alias("of"))
        met = totals[k].join(taken, "context").withColumn("below", _low(F.col("context"), k - 1)).join(below, "below")
        left = [(F.col("all") - F.col("taken")).alias("left_total"), (F.col("of") - F.col("kinds")).alias("left_kinds")]
        contexts.append(written(met.select("context", "total", "kinds", *left), "contexts"))
    return Model(entries, contexts, entries[0].count())


def most_frequent(known: DataFrame, max_entries: int) -> tuple[Lookup, int]:
    """The entries of :meth:`Model.known` that are broadcast, ``max_entries`` at most, and the least count among them."""
    least, kept = 1, 0
    for r in known.groupBy("n").agg(F.count(F.lit(1)).alias("entries")).orderBy(F.desc("n")).toLocalIterator():
        kept += r["entries"]
        if kept > max_entries:
            least = r["n"] + 1
            break
    rows = known.where(F.col("n") >= least).select("code", "log").toArrow()
    return Lookup(rows["code"].to_numpy().astype(np.uint64), rows["log"].to_numpy().astype(float)), least


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased; a word holds anything but ASCII white space."""
    return (text or "").encode().lower().split()


def count_words(texts: DataFrame) -> DataFrame:
    """``(word binary, n)`` over all texts of the one-column ``texts``; summed in the task first."""

    def run(slices: Iterator[list[list]]) -> Iterator[list[list]]:
        held: Counter = Counter()
        for (own,) in slices:
            for t in own:
                held.update(words_of(t))
                if len(held) > HELD:
                    yield [list(held), list(held.values())]
                    held.clear()
        yield [list(held), list(held.values())]

    return map_slices(texts, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def scores(docs: DataFrame, training: DataFrame, order: int = ORDER, max_entries: int = MAX_ENTRIES, top_words: int = TOP_WORDS) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of all ``docs`` under the models of ``training``."""
    spark = docs.sparkSession
    taught = training.select("text")
    model = fit(taught, order)
    entries = written(model.known(), "chances")
    frequent_codes, least = most_frequent(entries, max_entries)
    shared = spark.sparkContext.broadcast(frequent_codes)
    vocabulary = written(count_words(taught), "vocabulary")
    sums = vocabulary.agg(F.count(F.lit(1)).alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    ends = taught.count()
    total, kinds = sums["n"] + ends, sums["kinds"] + (ends > 0)
    divisor = total + 0.5 * (kinds + 1)
    frequent = vocabulary.orderBy(F.desc("n"), "word").limit(top_words)
    frequent = written(frequent, "frequent-words")
    rows = frequent.toArrow()  # top_words rows at most
    top = dict(zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True))
    # Rare words: words as frequent as the last broadcast one may be on either side, those above it are all broadcast.
    rare = vocabulary
    if top:
        last = min(top.values())
        own = F.broadcast(frequent.where(F.col("n") == last).select("word"))
        rare = vocabulary.where(F.col("n") <= last).join(own, "word", "left_anti") if len(top) >= top_words else vocabulary.limit(0)
    known = spark.sparkContext.broadcast({w: math.log10((c + 0.5) / divisor) for w, c in top.items()})
    end_score = math.log10((ends + 0.5) / divisor)

    def score(slices: Iterator[list[list]]) -> Iterator[list[list]]:
        chance = known.value.get
        for ids, texts in slices:
            sums, absent = np.zeros(len(ids)), []
            for of, cut in grouped(texts, order):
                codes, begins = packed(cut, order)
                at = shared.value.places(codes)
                sums += np.bincount(of, np.add.reduceat(np.where(at < 0, 0.0, shared.value.values[at] if len(shared.value.keys) else 0.0), begins), len(ids))
                # Codes to join, counted by text: the text's place in the slice stands above the five bytes.
                place = np.flatnonzero(at < 0)
                text = of[np.searchsorted(begins, place, "right") - 1].astype(np.uint64)
                absent.append(np.unique(text << np.uint64(40) | codes[place], return_counts=True))
            rest, back = np.unique(np.concatenate([a[0] for a in absent]), return_inverse=True)
            times = np.bincount(back, np.concatenate([a[1] for a in absent]), len(rest)).astype(np.int64)
            cuts = np.searchsorted(rest, np.arange(1, len(ids), dtype=np.uint64) << np.uint64(40))
            rest = np.split((rest & np.uint64(2**40 - 1)).astype(np.int64), cuts)
            out: list[list] = [[], [], [], [], [], [], [], rest, np.split(times, cuts)]
            for key, t, log in zip(ids, texts, sums.tolist(), strict=True):
                own = words_of(t)
                found = [chance(w) for w in own]
                hits = [x for x in found if x is not None]
                others = Counter(w for w, x in zip(own, found, strict=True) if x is None) if len(hits) < len(own) else {}
                row = (key, len(own) + 1, len(hits) + (ends > 0), math.fsum(hits) + end_score, log, list(others), list(others.values()))
                for column, value in zip(out[:7], row, strict=True):
                    column.append(value)
            yield out

    ddl = "doc_id long, n_tokens long, n_known long, base double, log double, words array<binary>, times array<long>, codes array<long>, code_times array<long>"
    scored = map_slices(sources(docs, "doc_id", "text"), score, ddl, rows=64)
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    asked = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    met = asked.join(rare, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + F.lit(0.5)) / F.lit(divisor))).alias("rest"),
    )
    bytes_ = scored.select("row", F.explode(F.arrays_zip("codes", "code_times")).alias("c")).select("row", F.col("c.codes").alias("code"), F.col("c.code_times").alias("times"))
    unseen = written(bytes_.select("code").distinct().join(entries, "code", "left_anti"), "unseen-codes")
    others = written(entries.where(F.col("n") < least).select("code", "log").union(model.chances(unseen)), "other-chances")
    by_code = bytes_.join(others, "code").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("rest_log"))
    return scored.drop("words", "times", "codes", "code_times").join(met, "row", "left").join(by_code, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        (F.col("log") + F.coalesce("rest_log", F.lit(0.0))).alias("score"),
    )
