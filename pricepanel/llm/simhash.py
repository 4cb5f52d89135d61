"""SimHash near-duplicates by pigeonring filtering.

A fingerprint's 64 bits are cut into ``m`` consecutive segments on a ring. If two fingerprints differ in at most ``t``
bits, some chain of segments on that ring has, at each length ``l``, at most ``l * t / m`` differing bits. While that budget
is below one, the chain's segments are equal: these form the bucket key, so only fingerprints that begin such a chain
meet. Longer prefixes of the chain are then held to their budgets before the full Hamming check. Only distinct fingerprints are
compared, and a bucket of many is split by longer prefixes of the chain.

Defined results: null, empty and wordless texts have fingerprint zero and link like any other; fewer words than a
shingle are one shingle; a bit that half the shingles have is zero; very long texts are read whole, a part at a time; repeated rows and rows
that repeat a doc_id count as they are; a null doc_id names a component only if it has no other; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricepanel.llm.common import map_slices, sources, written
from pricepanel.llm.components import components

#: Fingerprints of a bucket that are paired; larger buckets are split, which moves work and changes no link.
PAIRED = 48
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles: a bit is set if more than half the shingle hashes have it."""
    own = _WORDS((text or "").translate(_LOWER) if text and not text.isascii() else (text or "").lower())
    if not own:
        return 0
    digest = xxhash.xxh64_intdigest
    shingles = map(" ".join, zip(*(own[i:] for i in range(words)), strict=False)) if len(own) >= words else [" ".join(own)]
    hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint's bits as a signed long."""

    def run(slices: Iterator[list[list]]) -> Iterator[list[list]]:
        for ids, texts in slices:
            found = np.array([fingerprint(t, words) for t in texts], np.uint64)
            yield [ids, found.view(np.int64).tolist()]

    return map_slices(sources(docs, "doc_id", "text"), run, "doc_id long, fp long")


def _bounds(m: int) -> list[tuple[int, int]]:
    """First bit and width of each segment."""
    cuts = [i * 64 // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(segments: list[tuple[int, int]]) -> int:
    return _signed(sum(((1 << width) - 1) << at for at, width in segments))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def chains(m: int, t: int) -> list[list[tuple[int, int]]]:
    """The segments of the chain that begins at each place of the ring."""
    ring = _bounds(m)
    return [[ring[(i + k) % m] for k in range(m)] for i in range(m)]


def _flips(segment: tuple[int, int], most: int) -> list[tuple[int, int]]:
    """``(mask, bits)`` of every way to change ``most`` bits of a segment at most."""
    at, width = segment
    return [(_signed(sum(1 << at + b for b in bits)), n) for n in range(min(most, width) + 1) for bits in combinations(range(width), n)]


def links(fps: DataFrame, t: int = 2, m: int = 5, paired: int = PAIRED) -> DataFrame:
    """``(a, b)``, ``a < b``, of all distinct fingerprints ``fps(fp)`` that differ in ``t`` bits or fewer.

    A bucket is keyed by a prefix of a chain. As long as the prefix's budget is below one, its members have it in common. A bucket of
    more than ``paired`` members goes on to keys that are longer by the next segment of the chain: each member has its own there, and
    visits those that its budget lets it reach, so the members of a longer key are again all that may be within it. The rest are paired, held to
    the budgets of the prefixes still ahead, and then to the full Hamming distance. At the chain's end a key is one fingerprint and what is
    within ``t`` bits of it, so no bucket is left whole, and a hot one costs as much for each member whatever its size.
    """
    if not 0 <= t < 64 or not t < m <= 64:
        raise ValueError("more segments than differing bits are needed, and 64 at most")
    plan, equal = chains(m, t), max(n for n in range(1, m + 1) if n * t < m)
    budgets = [n * t // m for n in range(m + 1)]
    differ = lambda mask: F.bit_count(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(mask))
    by_turn = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("turn") + 1)
    first = F.array(*(F.col("fp").bitwiseAND(F.lit(_mask(order[:equal]))) for order in plan))
    # ``used`` bits were changed on the way to the key; who has changed none is at home there.
    rows = fps.select("fp", F.posexplode(first).alias("turn", "key"), F.lit(0).alias("used"))
    found = []
    for n in range(equal, m + 1):
        sizes = rows.groupBy("turn", "key").agg(F.count(F.lit(1)).alias("size"), F.count(F.when(F.col("used") == 0, 1)).alias("at_home"))
        met = written(rows.join(sizes.where("size > 1 and at_home > 0"), ["turn", "key"]), "ring-buckets")
        few = met if n == m else met.where(F.col("size") <= paired)
        home = few.where("used = 0").select("turn", "key", F.col("fp").alias("a"))
        both = home.join(few.select("turn", "key", "used", F.col("fp").alias("b")), ["turn", "key"]).where((F.col("used") > 0) | (F.col("a") < F.col("b")))
        for k in range(n + 1, m):
            both = both.where(differ(by_turn([_mask(order[:k]) for order in plan])) <= budgets[k])
        found.append(both.where(differ(F.lit(-1)) <= t).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        if n == m:
            break
        many = met.where(F.col("size") > paired)
        if many.isEmpty():
            break
        # One-off tables of flips by turn: the width of a segment over the bits that its budget leaves, however many fingerprints there are.
        flips = F.array(*(F.array(*(F.struct(F.lit(mask).cast("long").alias("mask"), F.lit(bits).alias("bits")) for mask, bits in _flips(order[n], budgets[n + 1]))) for order in plan))
        ways = F.filter(F.element_at(flips, F.col("turn") + 1), lambda f: F.col("used") + f["bits"] <= budgets[n + 1])
        own = F.col("fp").bitwiseAND(by_turn([_mask([order[n]]) for order in plan]))
        moved = many.select("turn", "fp", "used", F.col("key").bitwiseOR(own).alias("key"), F.explode(ways).alias("way"))
        rows = moved.select("turn", "fp", F.col("key").bitwiseXOR(F.col("way.mask")).alias("key"), (F.col("used") + F.col("way.bits")).alias("used"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.distinct()


def near_duplicates(docs: DataFrame, words: int = 3, t: int = 2, m: int = 5) -> DataFrame:
    """Per document ``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest doc_id reachable."""
    rows = written(fingerprints(docs, words), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-classes")
    labels = written(components(written(links(distinct.select("fp"), t, m), "ring-links")), "components")
    classes = distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    classes = written(classes, "labelled-classes")
    smallest = written(classes.groupBy("label").agg(F.min("first_id").alias("component_id")), "smallest")
    member = written(classes.join(smallest, "label").select("fp", "component_id"), "membership")
    return rows.join(member, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
