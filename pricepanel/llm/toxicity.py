"""Toxicity by class-conditional Kneser-Ney bigram models.

Toxic and ordinary texts each have a bigram model. The class's unigrams are continuation counts (after how many different words
a word comes), so copies of a text add nothing. Every count is discounted by ``DISCOUNT``, the same at every size; the mass taken
from a word or a bigram in either class goes back to it in shares that both classes have in common, a bigram's in proportion to the
class's continuation unigram. So what was seen once is nearly as likely under one model as under the other, and what was seen often in one only isn't.
A history that only one class has seen tells nothing of the other, so there both models back off to the unigrams.

A text's evidence is the difference of its log-likelihoods under the two models, divided by its length: that of the whole text, and
those of its most toxic expressions of one, two and four words, since a few insults say little about a long text's mean. A logistic
function of these, fitted on training rows that the counts have not seen, is the score; how many of the expressions it reads and its ridge are chosen by
folds of those rows. No count is dropped and no ratio is cut off.

The models are fitted on a bounded sample: ``max_toxic`` labelled rows of one class, ``max_ordinary`` of the other, and ``max_chars``
code points in all. Every word and bigram of the sample is kept; words are keyed by 64-bit hashes, so the model is
two arrays of 12 bytes an entry, and has fewer entries than the sample has code points.

Defined results: empty and null texts have no evidence and a score like any other; several labels of a document count as toxic if
one is; labels without a document teach nothing; without labels of both classes every score is 0. Equal texts in the sample teach
once, whatever order equal hashes come in; rows that repeat a doc_id are scored each; very long texts are scored whole, in pieces; an
empty table gives an empty result. Extra columns are dropped by :func:`score` and kept by :func:`drop_toxic`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricepanel.llm.common import Lookup, hashes, map_slices, pair_hashes, quota_sample, sources, written

#: Bounds of the sample; one labelled row in ``FOLDS`` fits the logistic function.
MAX_TOXIC, MAX_ORDINARY, MAX_CHARS, FOLDS = 3_000, 9_000, 40_000_000, 5
#: Kneser-Ney discount, and the words of an expression.
DISCOUNT, EXPRESSIONS = 0.75, (1, 2, 4)
#: Intercept and weights (whole text, expressions) where no row is left to fit them on; ridges that a fit chooses from.
UNFITTED, RIDGES = (-6.0, 0.0, 1.0, 1.0, 0.0), (0.0005, 0.005, 0.05, 0.5)
#: Distinct bigrams that a task counts before it hands its counts on.
HELD = 100_000
words_of, SPACE = re.compile(r"\w+").findall, re.compile(r"\s+").search
#: Stands before a text's first word.
START = hashes([""])


def _none() -> Lookup:
    return Lookup(np.zeros(0, np.uint64), np.zeros(0, np.float32))


@dataclass
class Model:
    """Log-likelihood ratios (toxic to ordinary) by word and by bigram, and the logistic weights."""

    rare: float = 0.0
    word: Lookup = field(default_factory=_none)
    bigram: Lookup = field(default_factory=_none)
    weights: tuple[float, ...] | None = None

    def ratios(self, words: np.ndarray, before: np.ndarray = START) -> np.ndarray:
        """Log-likelihood ratio of each of the hashed words that follow ``before``: of the bigram where both classes know its history, else of the word."""
        at = self.word.places(words)
        out = np.where(at >= 0, self.word.values[at] if len(self.word.keys) else 0.0, self.rare)
        at = self.bigram.places(pair_hashes(np.concatenate([before, words[:-1]]), words)) if len(words) else at
        known = at >= 0
        out[known] = self.bigram.values[at[known]]
        return out

    def parts(self, text: str | None) -> Iterator[np.ndarray]:
        """:meth:`ratios` of a text's words, a piece of the text at a time."""
        before = START
        for piece in pieces(text or ""):
            if words := words_of(piece.lower()):
                own = hashes(words)
                yield self.ratios(own, before)
                before = own[-1:]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        x = np.array([features(self.parts(t)) for t in texts]).reshape(-1, len(self.weights)) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def pieces(text: str, size: int = 1 << 20) -> Iterator[str]:
    """The text in pieces of ``size`` characters and up to the next white space, so that no word is cut."""
    at = 0
    while at < len(text):
        space = SPACE(text, at + size)
        end = space.end() if space else len(text)
        yield text[at:end]
        at = end


def features(parts: Iterable[np.ndarray]) -> list[float]:
    """Intercept, then the log-likelihood ratio per word of the whole text and of its most toxic expression of each length.

    ``parts`` are the ratios of the text's words, piece by piece; expressions reach over from one to the next.
    """
    total, n, last, best = 0.0, 0, np.zeros(0), dict.fromkeys(EXPRESSIONS, -math.inf)
    for own in parts:
        total, n = total + float(own.sum(dtype=float)), n + len(own)
        run = np.concatenate([last, own.astype(float)])
        sums = np.concatenate([[0.0], np.cumsum(run)])
        for k in EXPRESSIONS:
            if len(run) >= k:
                best[k] = max(best[k], float((sums[k:] - sums[:-k]).max()) / k)
        last = run[-(max(EXPRESSIONS) - 1) :]
    if not n:
        return [1.0, *[0.0] * (len(EXPRESSIONS) + 1)]
    # A text that is shorter than an expression is one.
    return [1.0, total / n, *(best[k] if n >= k else total / n for k in EXPRESSIONS)]


def _sample(docs: DataFrame, labels: DataFrame, most: tuple[int, int], max_chars: int) -> tuple[DataFrame, dict[int, int]]:
    """``(toxic, calibrates, text)`` of the rows of smallest id hash in each class, and the class sizes."""
    h = F.xxhash64(F.col("doc_id").cast("string"))
    known = sources(labels, "doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = written(known.withColumn("h", h), "labels")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # At most max_toxic + max_ordinary ids: a proven bound for the broadcast.
    picked = [known.where(F.col("toxic") == c).orderBy("h", "doc_id").limit(most[c] if len(sizes) == 2 else 0) for c in (0, 1)]
    picked = F.broadcast(written(picked[0].union(picked[1]), "sampled-labels"))
    rows = sources(docs, "doc_id", "text").where("text is not null").join(picked, "doc_id")
    rows = written(quota_sample(written(rows, "labelled"), "toxic", 2 * sum(most), max_chars), "quota")
    calibrates = F.pmod(F.shiftrightunsigned("h", 7), F.lit(FOLDS)) == 0
    # Of equal texts one row stays, by text: which one it is changes nothing but the fold.
    own = rows.groupBy("toxic", "text").agg(F.min(calibrates.cast("int")).alias("calibrates"))
    return written(own.select("toxic", "calibrates", "text"), "toxicity-sample"), sizes


def _bigrams(rows: DataFrame) -> DataFrame:
    """``(v, w, n0, n1)``: hashed words, and the ordinary and toxic texts with each bigram; summed in the task first."""

    def run(slices: Iterator[list[list]]) -> Iterator[list[list]]:
        held: Counter = Counter()

        def out() -> list[list]:
            return [np.array(c) for c in (*zip(*held, strict=True), list(held.values()))] if held else []

        for classes, texts in slices:
            for c, text in zip(classes, texts, strict=True):
                own = hashes(words_of(text.lower()))
                pairs = np.unique(np.stack([np.concatenate([START, own[:-1]]), own]).view(np.int64), axis=1) if len(own) else np.zeros((2, 0), np.int64)
                held.update(zip([c] * pairs.shape[1], *pairs.tolist(), strict=True))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    counted = map_slices(rows, run, "toxic int, v long, w long, n long")
    return counted.groupBy("v", "w").agg(*(F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)))


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY, max_chars: int = MAX_CHARS) -> Model:
    """Model of the labelled documents; callers pass the training labels only."""
    rows, sizes = _sample(docs, labels, (max_ordinary, max_toxic), max_chars)
    model = Model()
    if len(sizes) < 2:
        return model
    less = lambda n: F.least(F.col(n).cast("double"), F.lit(DISCOUNT))
    pairs = written(_bigrams(rows.where("calibrates = 0").select("toxic", "text")), "bigrams")
    spread = [F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"k{c}") for c in (0, 1)]
    by_word = written(pairs.groupBy("w").agg(*spread), "by-word")
    total = by_word.agg(*(F.sum(f"k{c}").alias(f"k{c}") for c in (0, 1)), *(F.sum(less(f"k{c}")).alias(f"d{c}") for c in (0, 1))).first()
    if not total["k0"] or not total["k1"]:
        return model
    k, taken = (total["k0"], total["k1"]), (total["d0"], total["d1"])
    model.rare = math.log(taken[1] / k[1]) - math.log(taken[0] / k[0])
    shared = (less("k0") + less("k1")) / F.lit(sum(taken))
    chance = lambda c: (F.greatest(F.col(f"k{c}") - F.lit(DISCOUNT), F.lit(0.0)) + F.lit(taken[c]) * shared) / F.lit(float(k[c]))
    words = written(by_word.select("w", F.log(chance(1) / chance(0)).alias("ratio")), "word-ratios")
    # Only a history that both classes have says how likely a word after it is in each.
    by_history = pairs.groupBy("v").agg(*(F.sum(f"n{c}").alias(f"v{c}") for c in (0, 1))).where(F.least("v0", "v1") > 0)
    known = pairs.join(written(by_history, "by-history"), "v").join(words, "w")
    back = (less("n0") + less("n1")) / (F.col("v0") + F.col("v1"))
    toxic = 1 / (1 + F.exp(-F.col("ratio")))
    after = lambda c, part: F.greatest(F.col(f"n{c}") - F.lit(DISCOUNT), F.lit(0.0)) / F.col(f"v{c}") + 2 * back * part
    bigrams = known.select("v", "w", F.log(after(1, toxic) / after(0, 1 - toxic)).alias("ratio"))
    # Bounded by the sample: each of its code points can begin one word at most.
    table = words.toArrow()
    model.word = Lookup(table["w"].to_numpy().view(np.uint64), table["ratio"].to_numpy().astype(np.float32))
    table = bigrams.toArrow()
    keys = pair_hashes(*(table[c].to_numpy().view(np.uint64) for c in ("v", "w")))
    model.bigram = Lookup(keys, table["ratio"].to_numpy().astype(np.float32))
    model.weights = _weights(model, rows.where("calibrates = 1").select("toxic", "text"), sizes)
    return model


def _weights(model: Model, rows: DataFrame, sizes: dict[int, int]) -> tuple[float, ...]:
    """Weights of the logistic function; the ridge and the expressions are those of least loss over folds of these same rows."""
    found = sorted((r["toxic"], *r["features"]) for r in _with_features(rows, model).collect())  # a few numbers a row of the sample
    y = np.array([r[0] for r in found], float)
    if not 0 < y.sum() < len(y):
        return UNFITTED
    x = np.array([r[1:] for r in found])
    prior = math.log(sizes[1] / sizes[0])
    # Each class weighs as much as all its labels.
    per = np.array([sizes[0] / (len(y) - y.sum()), sizes[1] / y.sum()])[y.astype(int)]
    per *= len(y) / per.sum()
    fold, best = np.arange(len(y)) % FOLDS, (math.inf, 0.0, 0)
    for used in range(2, x.shape[1] + 1):  # the whole text and so many of the expressions, shortest first
        for ridge in RIDGES:
            loss = 0.0
            for f in range(FOLDS):
                fits, tries = fold != f, fold == f
                w = logistic(x[fits, :used], y[fits], per[fits], ridge, prior)
                p = 1 / (1 + np.exp(-np.clip(x[tries, :used] @ w, -30, 30)))
                loss -= float((per[tries] * np.log(np.where(y[tries] == 1, p, 1 - p))).sum())
            best = min(best, (loss, ridge, used))
    weights = np.zeros(x.shape[1])
    weights[: best[2]] = logistic(x[:, : best[2]], y, per, best[1], prior)
    return tuple(weights.tolist())


def logistic(x: np.ndarray, y: np.ndarray, per: np.ndarray, ridge: float, prior: float) -> np.ndarray:
    """Weights that minimise the loss, each row weighing ``per``, and half the ridge times the squared weights but the first, none of which is negative."""
    used = np.arange(x.shape[1])
    while True:
        w = np.where(used > 0, 0.5, prior)
        own, penalty = x[:, used], np.where(used > 0, ridge, 0.0)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            gradient = own.T @ (per * (p - y)) + penalty * w
            curve = (own * (per * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ own + np.diag(penalty + 1e-6)
            step = np.linalg.solve(curve, gradient)
            w = w - step * min(1.0, 3 / np.abs(step).max())
            if np.abs(step).max() < 1e-6:
                break
        if (stays := (w >= 0) | (used == 0)).all():
            break
        used = used[stays]
    weights = np.zeros(x.shape[1])
    weights[used] = w
    return weights


def _with_features(rows: DataFrame, model: Model) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(slices: Iterator[list[list]]) -> Iterator[list[list]]:
        for classes, texts in slices:
            yield [classes, [features(shared.value.parts(t)) for t in texts]]

    return map_slices(rows, run, "toxic int, features array<double>")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` for every whole text; only the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(slices: Iterator[list[list]]) -> Iterator[list[list]]:
        for ids, texts in slices:
            scores = shared.value.scores(texts)
            yield [ids, scores, (scores >= 0.5).astype(np.int32)]

    return map_slices(sources(docs, "doc_id", "text"), run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose text isn't predicted toxic; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                yield part.filter(pa.array(shared.value.scores(part.column(at).to_pylist()) < 0.5))

    return docs.mapInArrow(run, docs.schema)
