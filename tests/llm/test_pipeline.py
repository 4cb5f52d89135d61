"""The pipeline on planted documents: each stage's decisions take effect, clean documents come through whole."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from pricepanel.llm.bpe import read_ranks  # noqa: E402

SYLLABLES = ("ba", "ke", "mo", "ti", "ru", "la", "ne", "so", "pi", "du")


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_planted_documents(spark, tmp_path):
    rng = random.Random(4)
    texts = {i: prose(i, 150) for i in range(400)}
    labels = []
    for i in range(0, 400, 4):
        words = texts[i].split()
        for _ in range(6):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "rotten", "nasty"]))
        texts[i] = " ".join(words)
    labels = [(i, 1, int(i % 4 == 0)) for i in range(400)]
    items = [(j, prose(9000 + j, 30)) for j in range(4)]
    texts[1000], texts[1001] = texts[1].replace(" ", "\n"), "  " + texts[2]
    texts[1002] = texts[3]
    texts[1003] = texts[5] + " " + items[0][1]
    texts[1004], texts[1005], texts[1006] = "", None, " \n"
    rows = [(i, t, "en", "s", len(t or ""), "extra") for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # 1001 has more code points than its equal 2; of the equals 1 and 1000, and 3 and 1002, the smaller id stays; 1006 is the longest of the empty ones.
    want = {i for i in range(400) if i % 4} - {2} | {1001, 1006}
    assert set(out) == want
    encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=read_ranks(public.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for i in (7, 1001, 1006):
        ids = encoding.encode_ordinary(texts[i])
        assert out[i]["n_tokens"] == len(ids) and bytes(out[i]["ids"]) == np.array(ids, "<u4").tobytes()
        assert out[i]["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest()


def test_stages_keep_the_columns(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0


def test_null_and_repeated_ids_are_judged_by_row(spark, tmp_path):
    a, b, c, d, item = (prose(i, 150) for i in (1, 2, 3, 4, 5))
    rows = [(None, a), (None, b), (7, c), (7, c), (None, c), (8, "  " + a), (9, d), (9, d + " " + item), (None, prose(6, 150) + " " + item)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = lambda stage, df: sorted(((r["doc_id"] or 0, r["text"]) for r in stage(spark, df, str(tmp_path)).collect()))
    exact = [(None, b), (7, c), (8, "  " + a), *rows[6:]]
    assert texts(corpus_pipeline.drop_exact_copies, frame) == sorted((i or 0, t) for i, t in exact)
    near = texts(corpus_pipeline.drop_near_copies, frame)
    assert {(0, b), (7, c), (8, "  " + a)} <= set(near) and len(near) == len(set(near)) and (0, a) not in near and (0, c) not in near
    assert texts(corpus_pipeline.drop_benchmark_copies, frame) == sorted((i or 0, t) for i, t in rows[:7])


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_clashing_columns(spark, tmp_path, stage):
    texts = [None, "", "", " ", "a b c", "a  b c", None, "x" * 300_000, "日本語", "calm words " * 40_000, "vile rotten filth", "calm and plain words"]
    rows = [(None if i % 5 == 4 else i // 2, t, "en", None, 0, i, "clash", 0.5, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, of string, score double, predicted int")
    spark.createDataFrame([(100 + i, i % 2) for i in range(40)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, ""), (None, "a b c d e f g")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    run = dict(corpus_pipeline.STAGES)[stage]
    kept = {"exact_dedup": 7, "simhash_near_dedup": 7}.get(stage, len(texts))
    found = run(spark, df, str(tmp_path))
    assert found.count() == kept
    assert stage == "byte_bpe" or found.columns == list(corpus_pipeline.COLUMNS)
    assert run(spark, df.limit(0), str(tmp_path)).count() == 0
