"""Chat formatting: a finite-state machine checks the order of turns, a declarative template writes the segments.

All of it is built-in expressions. A conversation is one output row, so its turns meet in one row; conversations are
otherwise spread by their id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn, which roles are learnt, and which role may follow which.

    ``marks``: role to (opening, closing). A role that is not listed is written as ``other[0] role other[1] text
    other[2]``. ``controls`` are the strings that no text may hold unescaped: each starts with one of ``<`` and ``[``.
    """

    marks: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>\n", "\n<</SYS>>\n"),
            "user": ("[INST] ", " [/INST] "),
            "assistant": ("<s> ", " </s>"),
        }
    )
    other: tuple[str, str, str] = ("<turn>", "</role>", "</turn>")
    controls: tuple[str, ...] = (
        "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<turn>", "</role>", "</turn>",
    )
    learnt: tuple[str, ...] = ("assistant",)
    order: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
        }
    )
    final: tuple[str, ...] = ("assistant",)

    def ahead(self) -> str:
        return "|".join(re.escape(c[1:]).replace("/", "\\/") for c in self.controls)


def escape(text: Column, template: Template) -> Column:
    r"""Puts one more backslash behind the first character of each control string, so none is left in the text.

    ``</s>`` becomes ``<\/s>`` and ``<\/s>`` becomes ``<\\/s>``; everything else stays, so ``unescape`` gives back
    exactly the text.
    """
    return F.regexp_replace(text, rf"([<\[])(\\*+)(?={template.ahead()})", r"$1\\$2")


def unescape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*+)(?={template.ahead()})", "$1$2")


def _by_role(role: Column, values: dict[str, str], other: Column) -> Column:
    chosen = None
    for name, value in values.items():
        chosen = F.when(role == name, F.lit(value)) if chosen is None else chosen.when(role == name, F.lit(value))
    return chosen.otherwise(other)


def check_order(turns: Column, template: Template) -> Column:
    """``valid`` and ``first_bad`` (position from 1, null if none; one past the end if the last turn may not be last)."""
    allowed = {f"{state}>{role}": role for state, roles in template.order.items() for role in roles}
    moves = F.create_map(*[F.lit(x) for pair in allowed.items() for x in pair])

    def step(state: Column, turn: Column) -> Column:
        after = F.try_element_at(moves, F.concat(state["at"], F.lit(">"), turn["role"]))
        bad = F.when(state["bad"].isNull() & after.isNull(), state["n"] + 1).otherwise(state["bad"])
        return F.struct(F.coalesce(after, F.lit("?")).alias("at"), (state["n"] + 1).alias("n"), bad.alias("bad"))

    start = F.struct(F.lit("").alias("at"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    ended = F.aggregate(turns, start, step)
    bad = F.coalesce(ended["bad"], F.when(~ended["at"].isin(*template.final), ended["n"] + 1))
    return F.struct(bad.isNull().alias("valid"), bad.alias("first_bad"))


def format_conversations(
    df: DataFrame, template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, n_turns, segments, formatted, valid, first_bad``: one row per conversation.

    ``segments`` holds ``text`` and ``loss`` in order; ``formatted`` is all segment texts joined. Turns go by number,
    then role and text. Null role or text: empty. Rows with a null conversation id form one conversation; a null turn
    number comes first; repeated rows are repeated turns. Conversations in a wrong order are formatted too, with
    ``valid`` false. Other columns are not read. An empty table gives no rows.
    """
    rows = df.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
        ).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    first, second, third = template.other

    def segments(t: Column) -> Column:
        other = F.concat(F.lit(first), escape(t["role"], template), F.lit(second))
        opening = _by_role(t["role"], {r: m[0] for r, m in template.marks.items()}, other)
        closing = _by_role(t["role"], {r: m[1] for r, m in template.marks.items()}, F.lit(third))
        part = lambda value, loss: F.struct(value.alias("text"), loss.alias("loss"))
        return F.array(
            part(opening, F.lit(False)),
            part(escape(t["text"], template), t["role"].isin(*template.learnt)),
            part(closing, F.lit(False)),
        )

    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
        check_order(F.col("turns"), template).alias("order"),
    ).select(
        "conv_id", "n_turns", "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "order.valid", "order.first_bad",
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (``role``, ``text``) behind a formatted text."""
    first, second, third = template.other
    closings = [m[1] for m in template.marks.values()] + [third]
    ends = "|".join(re.escape(c).replace("/", "\\/") for c in closings)
    whole = F.regexp_extract_all(formatted, F.lit(f"(?s).*?(?:{ends})"), F.lit(0))

    def turn(piece: Column) -> Column:
        chosen = None
        for role, (opening, closing) in template.marks.items():
            inner = F.substring(piece, F.lit(len(opening) + 1), F.length(piece) - len(opening) - len(closing))
            found = F.struct(F.lit(role).alias("role"), unescape(inner, template).alias("text"))
            mine = piece.startswith(opening) & piece.endswith(closing)
            chosen = F.when(mine, found) if chosen is None else chosen.when(mine, found)
        name = F.regexp_extract(piece, rf"(?s)\A{re.escape(first)}(.*?){re.escape(second).replace('/', chr(92) + '/')}", 1)
        before = F.length(name) + len(first) + len(second)
        inner = F.substring(piece, before + 1, F.length(piece) - before - len(third))
        return chosen.otherwise(F.struct(unescape(name, template).alias("role"), unescape(inner, template).alias("text")))

    return F.transform(whole, turn)


def read_learnt(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
