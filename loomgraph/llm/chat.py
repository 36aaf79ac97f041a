"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, and put together by array functions:
adjacent turns of one role share a block.  Blocks read ``<s>[role]text</s>``, and the texts of a block
are separated by ``<t>``.  ``&``, ``<``, ``[`` and ``]`` inside roles and texts are written as
entities, so no text can hold a control string and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Escaped characters; the ampersand is escaped first and read back last.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))
OPEN, ROLE_END, NEXT, CLOSE = "<s>[", "]", "<t>", "</s>"


def escaped(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescaped(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def format_conversations(
    turns: DataFrame, loss_role: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, formatted, loss_spans): one row for each conversation.

    ``loss_spans`` is the loss mask: structs (start, size) in UTF-8 bytes of ``formatted``, one for
    each turn of ``loss_role``, around its text alone.  Rows are ordered by turn, then role, then
    text; a missing turn comes first.  Null roles and texts are empty, rows with a null id form a
    conversation, repeated rows are turns of their own, other columns are ignored, and an empty table
    gives an empty result.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    collected = turns.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    written = collected.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escaped(t["role"]).alias("name"), escaped(t["text"]).alias("text"))).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        before = F.get(F.col("turns"), i - 1)["role"]
        opened = F.concat(F.lit(OPEN), t["name"], F.lit(ROLE_END))
        lead = F.when(i == 0, opened).when(before == t["role"], F.lit(NEXT)).otherwise(F.concat(F.lit(CLOSE), opened))
        return F.struct(lead.alias("lead"), t["text"].alias("text"), (t["role"] == loss_role).alias("loss"))

    pieces = written.select("conv_id", F.transform("turns", piece).alias("pieces"))
    text = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["text"])), ""), F.lit(CLOSE))
    sizes = F.transform("pieces", lambda p: F.struct(F.octet_length(p["lead"]).cast("long").alias("lead"), F.octet_length(p["text"]).cast("long").alias("text"), p["loss"].alias("loss")))
    return pieces.select("conv_id", text.alias("formatted"), sizes.alias("sizes")).select("conv_id", "formatted", _loss_spans().alias("loss_spans"))


#: Turns whose places are summed together: arrays are copied as they grow, so sums go in two levels.
SUM_BLOCK = 128


def _loss_spans() -> Column:
    """The places of the texts under the loss, from the column ``sizes`` of structs (lead, text, loss)."""

    def add(state: Column, p: Column) -> Column:
        start = state["at"] + p["lead"]
        span = F.array(F.struct(start.alias("start"), p["text"].alias("size")))
        return F.struct((start + p["text"]).alias("at"), F.when(p["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    def begin(at: Column) -> Column:
        return F.struct(at.alias("at"), F.expr("array()").cast("array<struct<start:bigint,size:bigint>>").alias("spans"))

    zero = F.lit(0).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("sizes") - 1) / SUM_BLOCK).cast("int")), lambda k: F.slice("sizes", k * SUM_BLOCK + 1, F.lit(SUM_BLOCK)))
    totals = F.transform(blocks, lambda block: F.aggregate(block, zero, lambda s, p: s + p["lead"] + p["text"]))
    starts = F.aggregate(totals, F.struct(zero.alias("at"), F.expr("array()").cast("array<bigint>").alias("all")), lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])
    return F.flatten(F.zip_with(blocks, starts, lambda block, at: F.aggregate(block, begin(at), add, lambda s: s["spans"])))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of structs (role, text)."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")
    body = lambda b: F.substring_index(b, ROLE_END, -1)  # noqa: E731  neither roles nor texts hold a ]
    role = lambda b: unescaped(F.substring_index(F.substring_index(b, ROLE_END, 1), "[", -1))
    return F.flatten(F.transform(blocks, lambda b: F.transform(F.split(body(b), NEXT), lambda t: F.struct(role(b).alias("role"), unescaped(t).alias("text")))))


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    data = formatted.cast("binary")
    cut = lambda s: unescaped(F.substr(data, (s["start"] + 1).cast("int"), s["size"].cast("int")).cast("string"))
    return F.array_join(F.transform(loss_spans, cut), "")
