"""Fill-in-the-middle against a plain loop over lines."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from pricepanel.llm import fim

SCHEMA = "doc_id long, text string, lang string, n long, form string, output string, h1 long"
ODD = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "one\ntwo\nthree", "x <P> y\nz", "<S>", "a\r\nb\x0bc", "日本\n語🙂\n", "<\nP>\n<", "long line " * 60_000, "l\n" * 300_000]


def rows():
    rng = random.Random(1)
    more = ["".join(rng.choice(["\n", "ab", "<", "P>", "<S", "ü", " "]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    return [(None if i == 5 else i // 2 if i % 9 == 0 else i - 3, t) for i, t in enumerate([*ODD, *more, *ODD])]


def by_hand(doc_id, text, seed, fim_rate, spm_rate):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_rate:
        return doc_id, len(units), "plain", None, None, text, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < spm_rate
    return doc_id, len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", text


@pytest.mark.parametrize(("seed", "fim_rate", "spm_rate"), [(7, 100, 50), (1, 40, 0), (2, 90, 100), (3, 0, 50)])
def test_against_a_loop(spark, seed, fim_rate, spm_rate):
    table = spark.createDataFrame([(i, t, "en", -1, "clash", "clash", 0) for i, t in rows()], SCHEMA)
    found = fim.transform(table, seed, fim_rate, spm_rate, with_restored=True)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr(by_hand(i, t, seed, fim_rate, spm_rate)) for i, t in rows())


def test_slices_change_nothing(spark, monkeypatch):
    table = spark.createDataFrame([(i, t, "en", -1, "clash", "clash", 0) for i, t in rows()], SCHEMA)
    want = sorted(map(repr, fim.transform(table).collect()))
    monkeypatch.setattr(fim, "BATCH_ROWS", 3)
    monkeypatch.setattr(fim, "BATCH_BYTES", 10)
    assert sorted(map(repr, fim.transform(table).collect())) == want


def test_empty_table_and_missing_column(spark):
    assert fim.transform(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError, match="missing columns"):
        fim.transform(spark.createDataFrame([(1,)], "doc_id long"))
