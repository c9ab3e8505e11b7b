"""Chat formatting: a finite-state machine over roles and a declarative template.

Each turn becomes three text segments (opening mark with the role, text, closing
mark), each with a loss flag; the formatted conversation is the segments' texts in
order.  Control strings inside texts and roles get a backslash behind their first
character (one more where backslashes already stand there), which ``unescape``
takes away again, so no text can look like a mark.

The machine's states and moves are a table of the template.  A run of turns acts
on the machine as a map from state to state, and maps compose, so a conversation
is assembled in two steps: pieces of ``PIECE`` turn numbers, then the pieces.  A
task gathers one piece, or one row per piece; the finished conversation, which is
one row by nature, is the only place where all its turns meet.

Edge cases: null roles and texts are empty; unknown roles are formatted, without
loss, and make the conversation invalid; turns are ordered by number (null first),
ties by role and text; repeated rows are turns of their own; rows without a
conversation id form one conversation; an empty table gives no row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

PIECE = 256


@dataclass(frozen=True)
class Template:
    opening: str = "<|im_start|>"
    after_role: str = "<|im_sep|>"
    closing: str = "<|im_end|>"
    #: Strings that must not stand unescaped in a text; each begins with one of ``<`` and ``[``.
    control: tuple[str, ...] = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")
    loss_roles: tuple[str, ...] = ("assistant",)
    #: Moves of the machine: (state, role) -> state; any other move leads to ``broken``.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    states: tuple[str, ...] = ("start", "told", "asked", "answered", "broken")
    final: tuple[str, ...] = ("answered",)

    @property
    def rests(self) -> str:
        """The control strings without their first character, as alternatives."""
        return "|".join(sorted({re.escape(c[1:]) for c in self.control}, key=lambda c: (-len(c), c)))

    def step(self, role: str) -> list[int]:
        """The machine's map for one turn: the state after it, by the state before."""
        at = self.states.index
        return [at(self.moves.get((s, role), "broken")) for s in self.states]


CHAT = Template()


def escape(text: Column, template: Template = CHAT) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({template.rests})", r"$1\\$2$3")


def unescape(text: Column, template: Template = CHAT) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({template.rests})", "$1$2$3")


def _ints(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def format_chats(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    template: Template = CHAT,
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``segments`` (text, loss) and ``valid``."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.floor(F.col(turn_col) / PIECE).alias("piece"),
        F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("t"),
    )
    pieces = rows.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        marks = F.concat(F.lit(template.opening), escape(t["role"], template), F.lit(template.after_role))
        no = F.lit(False)
        return F.array(
            F.struct(marks.alias("text"), no.alias("loss")),
            F.struct(escape(t["text"], template).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.closing).alias("text"), no.alias("loss")),
        )

    def step(t: Column) -> Column:
        known = sorted({role for _, role in template.moves})
        out = _ints(template.step(""))
        for role in known:
            out = F.when(t["role"] == role, _ints(template.step(role))).otherwise(out)
        return out

    def compose(first: Column, then: Column) -> Column:
        return F.transform(first, lambda s: F.get(then, s))

    identity = _ints(list(range(len(template.states))))
    mapped = pieces.select(
        "conv_id",
        F.struct(
            "piece",
            F.flatten(F.transform("turns", segments)).alias("segments"),
            F.aggregate("turns", identity, lambda m, t: compose(m, step(t))).alias("moves"),
        ).alias("p"),
    )
    whole = mapped.groupBy("conv_id").agg(F.array_sort(F.collect_list("p"), _by_piece).alias("pieces"))
    end = F.aggregate("pieces", F.lit(template.states.index("start")), lambda s, p: F.get(p["moves"], s))
    return whole.select(
        "conv_id",
        F.flatten(F.transform("pieces", lambda p: p["segments"])).alias("segments"),
        end.isin(*[template.states.index(s) for s in template.final]).alias("valid"),
    )


def _by_piece(a: Column, b: Column) -> Column:
    """Ascending, null first."""
    x, y = a["piece"], b["piece"]
    return (
        F.when(x.isNull(), F.lit(-1)).when(y.isNull(), F.lit(1)).when(x < y, F.lit(-1)).otherwise(F.lit(1))
    )


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(text: Column, template: Template = CHAT) -> Column:
    """The turns (role, text) of a formatted conversation."""
    quoted = lambda s: re.escape(s)
    parts = F.filter(F.split(text, quoted(template.closing)), lambda p: p != "")

    def turn(part: Column) -> Column:
        inner = F.split(F.substr(part, F.lit(len(template.opening) + 1)), quoted(template.after_role))
        return F.struct(
            unescape(F.get(inner, F.lit(0)), template).alias("role"),
            unescape(F.get(inner, F.lit(1)), template).alias("text"),
        )

    return F.transform(parts, turn)


def loss_text(segments: Column, template: Template = CHAT) -> Column:
    """All text under the loss mask, unescaped."""
    learned = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(learned, lambda s: unescape(s["text"], template)), "")
