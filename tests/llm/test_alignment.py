"""Alignment of two tokenizers against the libraries on whole texts and a plain intersection of ends."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pricepanel.llm import alignment, bpe, common, queries  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, n_a long, groups string, block long, pair long"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a b", "a b", "x▁y", "x ▁ y", "▁", "\x00a", "a\nb c\n d", "<s> hi </s> <|endoftext|> <unk> <0x41>",
    "\t\tq r", "日本語 テキスト 🙂👩‍👩‍👧 ﬁ", "a\x1cb \x85 　 c", "don't we'll  I'M", "naïve café́ Ünï", "word " * 3000, "x" * 3000, "日本" * 2000,
]


def texts():
    rng = random.Random(4)
    parts = ["the", "of", " ", "  ", "\n", "token", "ization", "é", "日", "1234", "'s", "!", "<s>", "\t", "\xa0", "Ab", "x1c\x1c", "▁"]
    return [*ODD, *("".join(rng.choice(parts[: -1 if i % 4 else None]) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 60))) for i in range(400)), *ODD[4:10]]


def whole(texts):
    """Groups and links of each text by the libraries' encoding of the whole text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    byte_of = {c: i for i, c in enumerate(bpe.byte_table())}
    out = []
    for text in texts:
        own_a = a.encode(" " + (text or ""), add_special_tokens=False)
        ids_b = b.encode(text or "")
        spelt_a = [bytes(byte_of[c] for c in t) for t in own_a.tokens]
        spelt_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        want = b" " + (text or "").encode()
        if not text or b"".join(spelt_a) != want or b"".join(spelt_b) != want:
            out.append((0, 0, [], []))
            continue
        ends = [[sum(map(len, s[: i + 1])) for i in range(len(s))] if len(s) < 2000 else list(__import__("itertools").accumulate(map(len, s))) for s in (spelt_a, spelt_b)]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, low = [], 0
        where_a, where_b = {e: i for i, e in enumerate(ends[0])}, {e: i for i, e in enumerate(ends[1])}
        i = j = 0
        for e in both:
            groups.append((own_a.ids[i : where_a[e] + 1], ids_b[j : where_b[e] + 1]))
            i, j = where_a[e] + 1, where_b[e] + 1
        links = [(own_a.ids[where_a[e]], ids_b[where_b[e]]) for e in both]
        out.append((len(own_a.ids), len(ids_b), groups, links))
    return out


def test_query_columns_against_the_libraries(spark, tmp_path):
    rows = [(None if i == 7 else i // 2 if i % 10 == 0 else i, t, "en", -5, "clash", 1, 2) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want, by_text = [], whole(texts())
    counts = Counter(pair for *_, links in by_text for pair in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    for (doc_id, *_), (n_a, n_b, groups, links) in zip(rows, by_text, strict=True):
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        n_best = sum(counts[p] == best[p[1]] for p in links)
        want.append((doc_id, n_a, n_b, len(groups), len(links), n_best, sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if n_a else ""))
    assert sum(w[1] > 0 for w in want) > 250 and sum(w[1] == 0 for w in want) > 50
    found = queries.op13_alignment(spark, str(tmp_path)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def test_small_pieces_blocks_and_memory_change_nothing(spark, monkeypatch):
    table = spark.createDataFrame([(i, t, "en", -5, "clash", 1, 2) for i, t in enumerate(texts())], SCHEMA)
    result = lambda: sorted(map(repr, map(tuple, alignment.scored(common.written(alignment.align(table, *PATHS), "aligned")).collect())))
    want = result()
    own = alignment.Aligner(*PATHS)
    plain = [r[:5] for r in own.align([t or "" for t in texts()])]
    monkeypatch.setattr(alignment, "PIECE", 3)
    monkeypatch.setattr(alignment, "MEMO_BYTES", 2000)
    own.memo, own.older = {}, {}
    assert [r[:5] for r in own.align([t or "" for t in texts()])] == plain
    own.cuts = False
    assert [r[:5] for r in own.align([t or "" for t in texts()])] == plain
    monkeypatch.setattr(common, "SLICE_CHARS", 200)
    assert result() == want


def test_tokens_without_bytes_link_with_the_token_they_end_with():
    groups, ends, links, upto = alignment.sliced([1, 2, 3, 4], [7, 8], np.array([1, 1, 0, 1]), np.array([2, 1]))
    assert groups == ["1,2,3|7", "4|8"] and ends.tolist() == [2, 3] and links.tolist() == [2 << 32 | 7, 3 << 32 | 7, 4 << 32 | 8] and upto.tolist() == [2, 3]
    assert alignment.common_ends([1, 2, 2, 3], [2, 3]) == ([3, 4], [1, 2])


def test_empty_table(spark):
    assert alignment.scored(common.written(alignment.align(spark.createDataFrame([], SCHEMA), *PATHS), "aligned")).count() == 0
