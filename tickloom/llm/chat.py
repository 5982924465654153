"""Chat formatting: one training example for each assistant turn.

A conversation's turns, in order, become prefix-target examples: all turns
before an assistant turn are context, that reply alone is trainable.  Turns are
written ``<s>role[INST]text</s>`` (``[/INST]`` for the assistant).  Inside roles
and texts the three characters that control strings are made of are escaped, so
no text can forge a control string and reading back is exact: a backslash
becomes ``\\b``, ``<`` becomes ``\\l`` and ``[`` becomes ``\\o``.

Contract for odd input: null roles and texts are empty; a null conversation id
is an id like any other; turns are ordered by (turn, role, text) with nulls
first, so ties and repeated rows have one order and all of them stay; a
conversation that does not end in an assistant turn gets one more example with
nothing trainable, which holds all its turns; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
BEGIN, USER_MARK, ASSISTANT_MARK, END = "<s>", "[INST]", "[/INST]", "</s>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\o"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\o"), F.lit("[")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _opening(turn: Column) -> Column:
    mark = F.when(turn["role"] == ASSISTANT, F.lit(ASSISTANT_MARK)).otherwise(F.lit(USER_MARK))
    return F.concat(F.lit(BEGIN), escape(turn["role"]), mark)


def format_chats(frame: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv id, example (turn number of its reply, from 0), formatted, loss_start (from 0) and loss_length in code points."""
    turns = frame.select(
        F.col(f"`{conv_col}`").alias("_conv"),
        F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).alias("_turn"),
    )
    whole = turns.groupBy("_conv").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    whole = whole.withColumn("_done", F.transform("_turns", lambda t: F.concat(_opening(t), escape(t["text"]), F.lit(END))))

    def example(i: Column) -> Column:
        turn = F.get(F.col("_turns"), i)
        context = F.concat(F.array_join(F.slice("_done", F.lit(1), i), ""), _opening(turn))
        return F.struct(i.alias("at"), context.alias("context"), escape(turn["text"]).alias("target"), F.lit(END).alias("end"))

    replies = F.filter(F.sequence(F.lit(0), F.size("_turns") - 1), lambda i: F.get(F.col("_turns"), i)["role"] == ASSISTANT)
    rest = F.array(F.struct(F.size("_turns").alias("at"), F.array_join("_done", "").alias("context"), F.lit("").alias("target"), F.lit("").alias("end")))
    open_end = F.element_at("_turns", -1)["role"] != ASSISTANT
    examples = F.transform(replies, example)
    out = whole.select("_conv", F.explode(F.when(open_end, F.concat(examples, rest)).otherwise(examples)).alias("_x"))
    return out.select(
        F.col("_conv").alias(conv_col),
        F.col("_x.at").alias("example"),
        F.concat("_x.context", "_x.target", "_x.end").alias("formatted"),
        F.length("_x.context").alias("loss_start"),
        F.length("_x.target").alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), unescaped, from a formatted example."""
    pieces = F.slice(F.split(formatted, END), F.lit(1), F.size(F.split(formatted, END)) - 1)
    mark = r"^<s>([^\[]*)\[/?INST\]"
    return F.transform(
        pieces,
        lambda p: F.struct(unescape(F.regexp_extract(p, mark, 1)).alias("role"), unescape(F.regexp_replace(p, mark, "")).alias("text")),
    )


def loss_text(frame_formatted: Column, start: Column, length: Column) -> Column:
    """The unescaped text under the loss mask."""
    return unescape(F.substring(frame_formatted, start + F.lit(1), length))
