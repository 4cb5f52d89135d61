"""Bounded samples, fits and blocks: what is taken, chosen and held, against plain counts."""

from __future__ import annotations

import math
import pickle
import random
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricepanel.llm import common, decontaminate, language_id, toxicity

SCHEMA = "doc_id long, text string, lang string"


def by_hand(rows, n_rows, n_chars):
    """Texts by class: rows in order of their hash while both shares last."""
    values = Counter(r["lang"] for r in rows if r["lang"] is not None)
    used = [v for v, _ in sorted(values.items(), key=lambda x: (-x[1], x[0]))][:n_rows]
    share, most = max(1, n_rows // len(values)), max(1, n_chars // len(values))
    out = defaultdict(list)
    for value in used:
        chars = 0
        for r in sorted((r for r in rows if r["lang"] == value), key=lambda r: r["h"]):
            if len(out[value]) >= share or chars >= most:
                break
            out[value].append((r["doc_id"], r["text"]))
            chars += len(r["text"] or "")
    return out


@pytest.mark.parametrize(("n_rows", "n_chars"), [(60, 10**9), (10**6, 10**9), (400, 900), (3, 10**6), (7, 5)])
def test_sample_against_sorting(spark, n_rows, n_chars):
    rng = random.Random(n_rows)
    rows = [(i if rng.random() < 0.9 else None, rng.choice(["x" * rng.randint(0, 40), "same", None]), rng.choice(["aa", "aa", "aa", "bb", "cc", None])) for i in range(900)]
    rows += [(None, "again", "bb")] * 300 + [(1, "dd", "dd")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = by_hand(df.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), "text")).collect(), n_rows, n_chars)
    found = defaultdict(list)
    for r in common.quota_sample(df.repartition(5), "lang", n_rows, n_chars).collect():
        found[r["lang"]].append((r["doc_id"], r["text"]))
    assert {k: sorted(map(repr, v)) for k, v in found.items()} == {k: sorted(map(repr, v)) for k, v in want.items()}


def test_language_of_80000_equal_rows_is_learned(spark):
    same = spark.range(80_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("ein und das selbe").alias("text"), F.lit("aa").alias("lang"))
    model = language_id.fit(same.unionByName(spark.createDataFrame([(i, f"other words {i}", "bb") for i in range(100)], SCHEMA)))
    assert sorted(model.langs) == ["aa", "bb"]
    found = language_id.predict(spark.createDataFrame([(1, "ein und das selbe"), (2, "other words")], "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] for r in sorted(found)] == ["aa", "bb"] and all(r["score"] > 0.9 for r in found)


def test_thousands_of_languages_and_a_hot_one(spark):
    rows = spark.range(5000).select("id", F.concat(F.lit("wort"), "id", F.lit(" und mehr")).alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    hot = spark.range(20_000).select((F.col("id") + 5000).alias("id"), F.concat(F.lit("hot text "), "id").alias("text"), F.lit("hot").alias("lang"))
    labelled = rows.unionByName(hot).withColumnRenamed("id", "doc_id")
    words = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    spell = F.udf(lambda t: " ".join(words(w) if w.isdigit() else "w" + words(w[4:]) if w.startswith("wort") else w for w in t.split()))
    labelled = labelled.withColumn("text", spell("text"))
    model = language_id.fit(labelled)
    assert len(model.langs) == 5001
    found = language_id.predict(spark.createDataFrame([(1, "w" + words(4711)), (2, "hot text"), (3, "w" + words(17))], "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] for r in sorted(found)] == ["l4711", "hot", "l17"]
    assert common.quota_sample(labelled, "lang", 20_000, 40_000_000).count() == 5000 + 20_000 // 5001


def test_more_languages_than_rows_leave_the_rare_ones_out(spark):
    rows = spark.createDataFrame([(i, "t", f"l{i % 30}" if i < 60 else "l7") for i in range(70)], SCHEMA)
    taken = common.quota_sample(rows, "lang", 10, 10**6).collect()
    assert len(taken) == 10 and "l7" in {r["lang"] for r in taken}


def loss_of(x, y, per, ridge, w):
    p = 1 / (1 + np.exp(-(x @ w)))
    return -(per * np.log(np.where(y == 1, p, 1 - p))).sum() + ridge / 2 * (w[1:] ** 2).sum()


@pytest.mark.parametrize("seed", range(6))
def test_logistic_weights_cannot_be_bettered(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([np.ones((300, 1)), rng.normal(size=(300, 4))], axis=1)
    y = (x @ np.array([-1.0, 2.0, -1.5, 0.3, 0.0]) + rng.logistic(size=300) > 0).astype(float)
    per, ridge = rng.uniform(0.5, 2, 300), (0.005, 0.5)[seed % 2]
    w = toxicity.logistic(x, y, per, ridge, -1.0)
    assert (w[1:] >= 0).all() and w[2] == 0
    best = loss_of(x, y, per, ridge, w)
    for i in range(5):  # a convex loss: no step along an axis that stays allowed is lower
        for step in (1e-3, -1e-3):
            other = w.copy()
            other[i] += step
            if i == 0 or other[i] >= 0:
                assert loss_of(x, y, per, ridge, other) >= best - 1e-9
    for _ in range(200):
        other = w + rng.normal(scale=0.05, size=5)
        other[1:] = np.maximum(other[1:], 0)
        assert loss_of(x, y, per, ridge, other) >= best - 1e-9


def test_sample_of_equal_labelled_rows(spark):
    docs = spark.createDataFrame([(i, "vile rotten words" if i % 2 else "calm and plain words") for i in range(400)] + [(1, "vile rotten words")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(1, 1)] * 30 + [(5, 7), (6, None)], "doc_id long, toxic int")
    found = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(found) == 450 and {(r["doc_id"] % 2, r["predicted"]) for r in found} <= {(0, 0), (1, 1), (1, 0)}


def test_a_full_block_of_items_is_small_in_a_worker(tmp_path):
    items = [(i, [f"w{i}x{k}" for k in range(40)]) for i in range(decontaminate.BLOCK // 40)]
    (tmp_path / "block").write_bytes(pickle.dumps(decontaminate.Block(items, decontaminate.THRESHOLD, decontaminate.SEED)))
    code = """
import pickle, re, sys
import pricepanel.llm.decontaminate
used = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1])
before = used()
block = pickle.loads(open(sys.argv[1], "rb").read())
print(used() - before)
"""
    grown = subprocess.run([sys.executable, "-c", code, str(tmp_path / "block")], capture_output=True, text=True, check=True).stdout
    assert int(grown) < 80_000  # kB, the pickled bytes included


def test_items_longer_than_a_block_and_many_blocks(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([5, 30, 300])))) for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, k=20)) + " " + t + " " + " ".join(rng.choices(words, k=20))) for i, t in items] + [(100 + i, " ".join(rng.choices(words, k=200))) for i in range(40)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(*frames, block=200).collect()}
    assert {(i, i) for i, _ in items} <= found and all(d < 100 for d, _ in found)
    assert math.isclose(min(r["score"] for r in decontaminate.contaminated(*frames, block=200).collect() if r["doc_id"] == r["item_id"]), 1.0)
