"""Chat formatting with a grammar round trip.

Template, turn by turn: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Every turn is first rendered as it is and read
back by the parser. Where role or text does not come back identical, its content is escaped and read back again;
a turn that still differs ends the job, so what is returned always reads back to its source.

Escaping adds one caret to every ``<``, carets, ``|`` (``<|`` becomes ``<^|``, ``<^|`` becomes ``<^^|``); reading
takes one away. A line break in a role is written ``<|n|>``. No escaped content holds a control string.

Defined results: null texts and roles count as empty; a null turn sorts first; turns with equal numbers are
ordered by role, then text; equal rows are kept; a null ``conv_id`` is a conversation of its own; extra columns
are ignored; no rows give no conversations. A conversation is one output value and so is held by one task;
different conversations never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|n|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\^*)\|", r"<$1^|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\^(\^*)\|", r"<$1|")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse_turn(body: Column) -> Column:
    """What follows one start mark: struct(role, text, raw_chars, head_chars, sound); ``sound`` if the grammar holds."""
    role = F.substring_index(body, "\n", 1)
    rest = F.substr(body, F.length(role) + 2)
    raw = F.substring_index(rest, END, 1)
    return F.struct(
        unescape(F.replace(role, F.lit(BREAK), F.lit("\n"))).alias("role"),
        unescape(raw).alias("text"),
        F.length(raw).alias("raw_chars"),
        (F.length(role) + 1).alias("head_chars"),
        (F.substr(rest, F.length(raw) + 1) == F.lit(END + "\n")).alias("sound"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, read by its marks alone."""
    parts = F.split(formatted, r"<\|im_start\|>", -1)
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), parse_turn)


def render_turns(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with ``rendered`` and ``escaped``; every turn has been read back."""

    def same(rendered: str) -> Column:
        got = parse(F.col(rendered))
        one = F.element_at(got, 1)
        return (F.size(got) == 1) & one["sound"] & (one["role"] == F.col("role")) & (one["text"] == F.col("text"))

    plain = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("plain", render(F.col("role"), F.col("text")))
    kept = plain.withColumn("escaped", ~same("plain")).withColumn(
        "rendered",
        F.when(~F.col("escaped"), F.col("plain")).otherwise(
            render(F.replace(escape(F.col("role")), F.lit("\n"), F.lit(BREAK)), escape(F.col("text")))
        ),
    )
    sound = F.when(~F.col("escaped") | same("rendered"), F.col("rendered")).otherwise(
        F.raise_error(F.lit("a turn does not read back"))
    )
    return kept.select("conv_id", "turn", "role", "text", "escaped", sound.alias("rendered"))


def format_chats(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted, turns (as read back), loss_spans (start, chars) in ``formatted``.

    The loss mask covers the texts of the role ``assistant``.
    """
    turns = render_turns(rows)
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "rendered"))).alias("source"))
    chats = chats.withColumn("formatted", F.array_join(F.transform("source", lambda x: x["rendered"]), "")).withColumn("turns", parse(F.col("formatted")))
    same = F.transform("source", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))) == F.transform(
        "turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))
    )
    at = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,chars:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + len(START) + x["head_chars"]
        mine = F.array(F.struct(begin.alias("start"), x["raw_chars"].alias("chars")))
        return F.struct(
            (begin + x["raw_chars"] + len(END) + 1).alias("at"),
            F.when(x["role"] == "assistant", F.concat(acc["spans"], mine)).otherwise(acc["spans"]).alias("spans"),
        )

    return chats.select(
        "conv_id",
        F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not read back"))).alias("formatted"),
        "turns",
        F.aggregate("turns", at, step)["spans"].alias("loss_spans"),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["chars"]))), "")
