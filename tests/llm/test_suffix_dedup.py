"""Suffix deduplication against a dictionary of all strings."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from pricepanel.llm import queries, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, block long, row long, run string, n_bytes long"


def by_hand(rows, length):
    least = {}
    order = lambda i: 2**63 - 1 if i is None else i
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            least[s] = min(least.get(s, 2**63 - 1), order(i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if least[raw[p : p + length]] < order(i):
                gone[p : p + length] = b"\1" * length
        runs = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return sorted(map(repr, out))


def rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(12)]
    texts = [None, "", "x", "x" * 49, "x" * 50, "x" * 51, "x" * 700, "ab" * 300, "🙂" * 40]
    for _ in range(150):
        parts = [rng.choice(passages)[rng.randint(0, 20) :] if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 5))]
        texts.append(" ".join(parts))
    texts += [texts[20], texts[20] + "z", "y" + texts[20], texts[30][:60], passages[0] * 9]
    rng.shuffle(texts)
    return [(None if i % 31 == 5 else i // 2 if i % 7 == 0 else i - 4, t) for i, t in enumerate([*texts, *texts[:6]])]


def table(spark, own):
    return spark.createDataFrame([(i, t, "en", 3, 3, "clash", 0) for i, t in own], SCHEMA)


def result(found):
    return sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())) for r in found.collect())


@pytest.mark.parametrize(("length", "q", "hot", "small"), [(50, 24, 4096, False), (50, 24, 1, True), (50, 12, 2, True), (20, 20, 4096, True), (33, 9, 3, True), (8, 8, 4096, True)])
def test_against_a_dictionary(spark, monkeypatch, length, q, hot, small):
    if small:
        for name, value in (("BLOCK_BYTES", 2000), ("BLOCK_ROWS", 7), ("PIECE", 300), ("COUNT_BYTES", 9000), ("DIGEST_BYTES", 8000), ("REFINE_BYTES", 5000), ("SORTED_BYTES", 500)):
            monkeypatch.setattr(suffix_dedup, name, value)
    own = rows(length)
    want = by_hand(own, length)
    assert sum(eval(w)[2] > 0 for w in want) > 60
    assert result(suffix_dedup.dedup(table(spark, own), length, q, hot)) == want


def test_query_columns(spark, tmp_path):
    own = rows(9)
    table(spark, own).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op11_suffix_dedup(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(repr, map(tuple, found.collect()))) == by_hand(own, 50)


@pytest.mark.parametrize("length", [8, 11, 16, 50])
def test_pointers_order_places_by_their_bytes(length):
    rng = random.Random(length)
    runs = ["".join(rng.choice("ab") for _ in range(rng.randint(length, 3 * length))).encode() for _ in range(40)]
    data, sizes = b"".join(runs), np.array([len(r) for r in runs])
    ends = np.repeat(np.cumsum(sizes), sizes)
    pointer = suffix_dedup.refined(data, ends, length)
    places = [p for p in range(len(data)) if ends[p] - p >= length]
    for p in places:
        for other in places[::7]:
            a, b = data[p : p + length], data[other : other + length]
            assert (pointer[p] < pointer[other]) == (a < b) and (pointer[p] == pointer[other]) == (a == b)


def test_long_text_in_pieces(spark, monkeypatch):
    rng = random.Random(5)
    long = "".join(rng.choice("abcd \n") for _ in range(2_500_000))
    own = [(2, long), (1, long[1_000_000:1_200_000] + "!" + long[2_097_100:2_097_250]), (3, "q" + long[7:90])]
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.dedup(table(spark, own)).collect()}
    assert found == {1: (200_151, 0, 0), 2: (2_500_000, 200_150, 2), 3: (84, 83, 1)}


def test_empty_table_and_wrong_lengths(spark):
    assert suffix_dedup.dedup(table(spark, [])).count() == 0
    assert result(suffix_dedup.dedup(table(spark, [(None, None)]))) == by_hand([(None, None)], 50)
    with pytest.raises(ValueError, match="length"):
        suffix_dedup.dedup(table(spark, []), 10, 11)
