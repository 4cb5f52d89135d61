"""Byte-level BPE encoding and decoding over Arrow batches with the tokenizers library.

Ranks come from a file of the ``tiktoken`` form. Each rank's bytes are written with the 256 characters of the usual
byte-to-character table, so the library's BPE model sees text; a token's merges are all its splits into two known
tokens, in rank order. Every match of the split pattern is encoded on its own.

Defined results: a null or empty text has no tokens; no special token is ever produced or read; very long texts are processed
whole; rows with equal ids or texts are independent; an empty table gives an empty result; extra columns of the input are dropped.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricepanel.llm.common import map_slices, sources

#: White space around a space: only there can a match of the pattern reach over a space between two words.
WIDE_SPACE = regex.compile(r"\s (?:\s|\Z)").search
#: Bytes of words, ids and their objects that an encoder remembers between slices; beyond it the memory starts anew.
MEMO_BYTES = 96 << 20
#: Ids that are decoded at a time.
PIECE = 1 << 16


def byte_table() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes and rank of each line of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder of one rank file; built once in a Python worker."""

    def __init__(self, path: str, pattern: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        chars = byte_table()
        spell = lambda token: "".join(chars[b] for b in token)
        merges = []
        for token in sorted(ranks, key=ranks.get):
            splits = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += sorted(splits, key=lambda s: (ranks[s[0]], ranks[s[1]]))
        self.model = Tokenizer(models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=[(spell(a), spell(b)) for a, b in merges], ignore_merges=True, cache_capacity=0))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.memo: dict[str, bytes] = {}
        self.memo_bytes = 0

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        # A space before a word always starts a match, so words with the space before them are encoded once each.
        words = [t.split(" ") if not WIDE_SPACE(t) else [t] for t in texts]
        memo = self.memo
        unseen = list({w for own in words for w in own[1:] if w not in memo})
        starts = [own[0] for own in words]
        found = self._pieces([" " + w for w in unseen] + starts)
        memo.update(zip(unseen, found, strict=False))
        get = memo.__getitem__
        out = [first + b"".join(map(get, own[1:])) for first, own in zip(found[len(unseen) :], words, strict=True)]
        # An entry is two objects of some 50 bytes more than what they hold, and a place in the table.
        self.memo_bytes += sum(map(len, unseen)) + sum(map(len, found[: len(unseen)])) + 200 * len(unseen)
        if self.memo_bytes > MEMO_BYTES:
            memo.clear()
            self.memo_bytes = 0
        return out

    def _pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are split by the pattern; equal pieces are encoded once."""
        pieces = [self.split(t) for t in texts]
        distinct = list({p for own in pieces for p in own})
        ids: dict[str, bytes] = {}
        for at in range(0, len(distinct), 10_000):
            part = distinct[at : at + 10_000]
            found = [e.ids for e in self.model.encode_batch_fast(part, add_special_tokens=False)]
            raw = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
            ends = list(accumulate(map(len, found), initial=0))
            ids.update((piece, raw[4 * a : 4 * b]) for piece, a, b in zip(part, ends, ends[1:], strict=False))
        get = ids.__getitem__
        return [get(own[0]) if len(own) == 1 else b"".join(map(get, own)) for own in pieces]


class Table:
    """The bytes of each id of a rank file, laid end to end: what decoding needs."""

    def __init__(self, path: str) -> None:
        ranks = read_ranks(path)
        by_rank = sorted(ranks, key=ranks.get)
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[[ranks[t] for t in by_rank]] = [len(t) for t in by_rank]
        self.begin = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(by_rank), np.uint8)

    def bytes_of(self, token: int) -> bytes:
        return self.raw[self.begin[token] : self.begin[token] + self.size[token]].tobytes()

    def offsets(self, text: str, packed: bytes) -> list[list[int]]:
        """Start and end character of each token; a token that holds part of a character covers the whole of it."""
        sizes = self.size[np.frombuffer(packed, "<u4")]
        raw = np.frombuffer(text.encode(), np.uint8)
        char_of_byte = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(sizes)
        return [char_of_byte[ends - sizes].tolist(), (char_of_byte[ends - 1] + 1).tolist()] if len(ends) else [[], []]

    def decode_bytes(self, packed: bytes) -> bytes:
        """The bytes that the ids stand for, in any cut: a character split over ids comes back whole when they meet."""
        out = []
        for at in range(0, len(packed), 4 * PIECE):
            ids = np.frombuffer(packed[at : at + 4 * PIECE], "<u4")
            sizes = self.size[ids]
            # Each byte's place: its token's begin, plus how far it is into the token.
            within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out.append(self.raw[np.repeat(self.begin[ids], sizes) + within].tobytes())
        return b"".join(out)


# A worker keeps one encoder and one table at a time, so what it holds doesn't grow with the rank files it has met.
@lru_cache(maxsize=1)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


@lru_cache(maxsize=1)
def table(path: str) -> Table:
    return Table(path)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False, offsets: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Ids of every whole text: ``(id_col, keep columns, n_tokens long, ids)``.

    ``ids`` is an array of ints or, with ``packed``, the little-endian 32-bit form that loaders read. With ``offsets``
    two arrays follow: the first character of each token and the one after its last.
    """

    def run(slices: Iterator[list[list]]) -> Iterator[list[list]]:
        c = codec(path, pattern)
        for *kept, texts in slices:
            texts = [t or "" for t in texts]
            ids = c.encode_packed(texts)
            out = [*kept, [len(i) // 4 for i in ids], ids if packed else [np.frombuffer(i, "<u4").tolist() for i in ids]]
            if offsets:
                found = [table(path).offsets(t, i) for t, i in zip(texts, ids, strict=True)]
                out += [[f[0] for f in found], [f[1] for f in found]]
            yield out

    kinds = ", ".join(f"{n} {docs.schema[n].dataType.simpleString().replace('bigint', 'long')}" for n in (id_col, *keep))
    ddl = f"{kinds}, n_tokens long, ids {'binary' if packed else 'array<int>'}" + ", starts array<int>, ends array<int>" * offsets
    return map_slices(sources(docs, id_col, *keep, text_col), run, ddl)


def decode(tokens: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``decoded binary`` for the packed ``ids`` of :func:`encode`, with the ``keep`` columns.

    Bytes are joined before any reading as text, so characters split over tokens come back whole; ids cut within a
    character keep their partial bytes, which ``decode(decoded, 'UTF-8')`` shows as replacement characters.
    """

    def run(slices: Iterator[list[list]]) -> Iterator[list[list]]:
        own = table(path)
        for columns in slices:
            yield [*columns, [own.decode_bytes(i or b"") for i in columns[-1]]]

    names = (*keep, "ids")
    kinds = {f.name: f.dataType.simpleString().replace("bigint", "long") for f in tokens.schema}
    return map_slices(sources(tokens, *names), run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", decoded binary")


def coded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids binary, decoded binary``: :func:`encode` and :func:`decode` in one pass of one worker a task."""

    def run(slices: Iterator[list[list]]) -> Iterator[list[list]]:
        c, own = codec(path, pattern), table(path)
        for keys, texts in slices:
            ids = c.encode_packed([t or "" for t in texts])
            yield [keys, [len(i) // 4 for i in ids], ids, [own.decode_bytes(i) for i in ids]]

    return map_slices(sources(docs, "doc_id", "text"), run, "doc_id long, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document the token count, and digests of the ids and of what they decode to."""
    return coded(docs, path, pattern).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
