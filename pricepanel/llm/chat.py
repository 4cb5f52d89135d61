"""Chat formatting in Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role share a block. A block is
``<s>role`` + newline + its texts with ``<part>`` between + ``</s>``. In roles and texts ``&``, ``<`` and ``[`` (in roles the newline too) are written as
entities, so no control string can stand in them and every turn can be read back. The loss mask holds the spans of
assistant texts in the formatted string.

Defined results: null text counts as empty, null role as an empty role; turns are sorted by number (null first), then
role, then text, and repeated rows are turns of their own; a null conv_id is a conversation; very long texts are formatted whole; an empty
table gives an empty result; extra columns are dropped. A conversation is one row, so its turns meet in one task; time for its loss
spans grows with the square of their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricepanel.llm.common import sources

OPEN, CLOSE, PART = "<s>", "</s>", "<part>"
#: Written forms of the characters that control strings are made of, in the order of writing; read back in reverse.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("\n", "&#10;"))


def escape(text: Column, role: bool = False) -> Column:
    for plain, entity in ENTITIES[: 4 if role else 3]:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for plain, entity in reversed(ENTITIES[: 4 if role else 3]):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def format_chats(conversations: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans``: spans are structs of start and end in code points of ``formatted``, end exclusive."""
    rows = sources(conversations, "conv_id", "turn", "role", "text")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # Each turn with the marks before it: a new block, or a further part of the block of the turn before.
    before = lambda i: F.when(i > 0, F.element_at("turns", i)["role"])
    merged = F.transform(
        "turns",
        lambda t, i: F.struct(
            F.when(
                before(i).eqNullSafe(t["role"]), F.lit(PART)
            ).otherwise(F.concat(F.when(i > 0, F.lit(CLOSE)).otherwise(F.lit("")), F.lit(OPEN), escape(t["role"], role=True), F.lit("\n"))).alias("mark"),
            escape(t["text"]).alias("text"),
            (t["role"] == learned_role).alias("learned"),
        ),
    )
    placed = sorted_.select("conv_id", merged.alias("parts"))
    span = "struct<start:int,end:int>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["mark"])
        end = start + F.length(p["text"])
        own = F.when(p["learned"], F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast(f"array<{span}>"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], own).alias("spans"))

    texts = F.transform("parts", lambda p: F.concat(p["mark"], p["text"]))
    return placed.select("conv_id", F.concat(F.array_join(texts, ""), F.lit(CLOSE)).alias("formatted"), F.aggregate("parts", zero, step)["spans"].alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns (structs of role and text), loss_text``, all taken from the formatted string and its mask."""
    blocks = F.filter(F.split("formatted", CLOSE, -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        body = F.substring(block, len(OPEN) + 1, F.length(block))
        role = F.substring_index(body, "\n", 1)
        texts = F.split(F.substring(body, F.length(role) + 2, F.length(body)), PART, -1)
        return F.transform(texts, lambda t: F.struct(unescape(role, role=True).alias("role"), unescape(t).alias("text")))

    masked = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"), F.array_join(masked, "").alias("loss_text"))


def digests(conversations: DataFrame) -> DataFrame:
    """Counts and digests of what the formatted conversations read back as."""
    back = read_back(format_chats(conversations))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
