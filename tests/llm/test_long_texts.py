"""Texts over every cut: slices of 1 MiB, and the pieces that shingles, ids, bytes and words are taken in."""

from __future__ import annotations

import base64
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pricepanel.llm import bpe, chat, common, decontaminate, exact_dedup, language_id, ppm, secret_ledger, simhash, toxicity  # noqa: E402

WORDS = [a + b + c for a in ("ba", "ke", "mo", "ti", "ru", "é") for b in ("la", "ne", "so") for c in ("", "n", "st", "x")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def long():
    text = prose(1, 600_000)
    assert len(text.encode()) > 2 * common.SLICE_CHARS and len(text.encode()) > ppm.CHUNK and 600_000 > 2 * simhash.CHUNK
    return text


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_slices_of_long_texts_give_each_row_once(spark, long):
    df = frame(spark, ["a", long, "b", None, long[:100], long + "c"])
    found = common.map_slices(df, lambda slices: ([ids, [len(t or "") for t in texts]] for ids, texts in slices), "doc_id long, n long").collect()
    assert sorted(map(tuple, found)) == [(0, 1), (1, len(long)), (2, 1), (3, 0), (4, 100), (5, len(long) + 1)]


def test_fingerprint_in_pieces(monkeypatch, long):
    whole = simhash.fingerprint(long)
    monkeypatch.setattr(simhash, "CHUNK", 10**9)
    assert simhash.fingerprint(long) == whole
    monkeypatch.setattr(simhash, "CHUNK", 1000)
    assert simhash.fingerprint(long) == whole


def test_bpe_in_pieces(long):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    text = long[:1_500_000]
    ids = bpe.codec(path, public_tokenizers.PATTERN).encode_packed([text])[0]
    assert len(ids) // 4 > 2 * bpe.PIECE and bpe.table(path).decode_bytes(ids) == text.encode()
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert bpe.np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text)


def test_scores_in_pieces(spark, monkeypatch, long):
    df = frame(spark, [long, "ba ke", prose(2, 50)])
    docs = frame(spark, [prose(i, 400) for i in range(8)])
    whole = by_id(ppm.scores(df, docs), "score", "base_score", "n_tokens")
    monkeypatch.setattr(ppm, "CHUNK", 1 << 17)
    cut = by_id(ppm.scores(df, docs), "score", "base_score", "n_tokens")
    assert all(a == pytest.approx(b, rel=1e-9) for i in whole for a, b in zip(whole[i], cut[i], strict=True)) and whole[0][2] == 600_001


def test_expressions_over_pieces(long):
    model = toxicity.Model()
    ratios = [p for p in toxicity.pieces(long)]
    assert len(ratios) > 2 and "".join(ratios) == long
    rng = toxicity.np.random.default_rng(1).normal(size=1000)
    whole = toxicity.features([rng])
    assert toxicity.features([rng[:3], rng[3:4], rng[4:700], rng[700:]]) == pytest.approx(whole)
    assert toxicity.features(model.parts(long))[0] == 1.0


def test_operators_take_a_long_text(spark, long):
    copy, odd = long.replace(" ", "  ", 5), long[:-3] + " zz"
    df = frame(spark, [long, copy, "a", odd])
    keep = by_id(exact_dedup.dedup(df), "keep_id", "group_size")
    assert keep[0] == keep[1] == (1, 2) and keep[3] == (3, 1)
    assert {i: c[0] for i, c in by_id(simhash.near_duplicates(df), "component_id").items()} == {0: 0, 1: 0, 2: 2, 3: 0}
    item = spark.createDataFrame([(7, " ".join(long.split(" ")[400_000:400_030]))], "item_id long, text string")
    found = {r["doc_id"]: r["first_word"] for r in decontaminate.contaminated(df, item).collect()}
    assert {i: found.get(i) for i in (0, 1, 3)} == dict.fromkeys((0, 1, 3), 400_000) and 2 not in found
    labelled = spark.createDataFrame([(1, prose(3, 30), "xx"), (2, "quick brown fox", "yy")], "doc_id long, text string, lang string")
    assert by_id(language_id.predict(df, language_id.fit(labelled)), "lang_pred")[0] == ("xx",)


def test_secrets_and_turns_in_long_texts(spark, long):
    text = long + " token: abcdef123456 " + long + " AKIA" + "B" * 20
    history = spark.createDataFrame([(5, 1, text)], "path long, version long, text string")
    ledger = secret_ledger.Ledger(spark, common.shared_path(spark, "long-secrets"))
    ledger.ingest("one", history)
    r = ledger.report().first()
    assert (r["n_assign"], r["n_access"], r["n_hex"]) == (1, 1, 0) and {(s["kind"], s["start"]) for s in r["spans"]} == {("assign", len(long) + 1), ("access", len(text) - 24)}
    rows = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "<" + long), (1, 2, "assistant", "end")], "conv_id long, turn int, role string, text string")
    found = chat.digests(rows).first()
    assert found["loss_chars"] == len(long) + 4 and found["n_turns"] == 3
