"""Chat formatting: a finite-state machine over roles checks turn order, a declarative template writes text segments.

A template states the marks before and after a turn of each role, which roles are under the loss, and the moves of
a finite-state machine over roles.  A conversation becomes a sequence of segments (text, loss): its begin mark, then
per turn the opening mark, the escaped text and the closing mark; only texts can be under the loss.  Formatted, it is
those segments put together.  Roles that the template does not name are written out between marks of their own.

Escaping puts a backslash after the first character of a control string inside a text (and one more where there
are backslashes already), so no escaped text holds a control string, formatted text can be cut at its marks, and
taking one backslash out gives the text back.  DataFrame functions only: one shuffle by conversation, whose turns are
one row, since a formatted conversation is one value.

Turns are in order of ``turn``, null first; equal ones by role and text, so repeated rows are turns like any other.
Null roles and texts count as empty.  Rows without a conversation id form one conversation without id.  A conversation
that breaks the turn order is formatted all the same; ``first_error`` says where.  An empty table gives no rows.  Texts
of any length are handled whole, by regular expressions without backtracking.  Other columns are not read, whatever
their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Marks:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """``roles`` by name; ``other`` for any other role, whose name stands between ``other.before`` and ``name_end``.

    ``moves`` are (state, role, next state) of the machine, which begins in ``start`` and may stop in ``accepting``.
    Every mark begins with a control string; ``controls`` are all strings that texts must not hold unescaped.
    """

    begin: str
    roles: dict[str, Marks]
    other: Marks
    name_end: str
    controls: tuple[str, ...]
    moves: tuple[tuple[str, str, str], ...]
    start: str = "start"
    accepting: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        marks = [self.begin, self.name_end, *[m for r in (*self.roles.values(), self.other) for m in (r.before, r.after)]]
        openings = [r.before for r in (*self.roles.values(), self.other)]
        if any(a is not b and b.startswith(a) for a in openings for b in openings):
            raise ValueError("opening marks must tell roles apart")
        for control in self.controls:
            if len(control) < 2 or "\\" in control:
                raise ValueError(f"a control string has two characters or more and no backslash: {control!r}")
            parts = [control[i:] for i in range(1, len(control))]
            if any(c is not control and control in c for c in self.controls):
                raise ValueError(f"{control!r} lies within another control string")
            # A text must not complete a control string together with a mark or with another control string.
            if any(m.startswith(p) for p in parts for m in (*marks, *self.controls)) or any(
                m.endswith(control[:i]) for i in range(1, len(control)) for m in marks
            ):
                raise ValueError(f"{control!r} overlaps a mark")
        if not all(any(m.startswith(c) for c in self.controls) for m in marks):
            raise ValueError("every mark begins with a control string")

    def _inside(self, slashes: str) -> str:
        """A control string with backslashes after its first character, in three groups per first character."""
        firsts = sorted({c[0] for c in self.controls})
        return "|".join(
            f"({re.escape(a)}){slashes}({'|'.join(re.escape(c[1:]) for c in self.controls if c[0] == a)})" for a in firsts
        )

    def _replaced(self, text: Column, slashes: str, between: str) -> Column:
        groups = 3 * len({c[0] for c in self.controls})
        one, two, three = ("".join(f"${i}" for i in range(k, groups + 1, 3)) for k in (1, 2, 3))
        return F.regexp_replace(text, F.lit(self._inside(slashes)), F.lit(one + between + two + three))

    def escape(self, text: Column) -> Column:
        return self._replaced(text, r"(\\*)", r"\\")

    def unescape(self, text: Column) -> Column:
        return self._replaced(text, r"\\(\\*)", "")


# The moves of a conversation that may begin with a system turn and then alternates.
ALTERNATING = (
    ("start", "system", "system"), ("start", "user", "user"), ("system", "user", "user"),
    ("user", "assistant", "assistant"), ("assistant", "user", "user"),
)

BRACKETS = ChatTemplate(
    begin="<s>",
    roles={
        "system": Marks("[SYS]", "[/SYS]"), "user": Marks("[INST]", "[/INST]"),
        "assistant": Marks("[OUT]", "</s>", loss=True),
    },
    other=Marks("[ROLE]", "[/ROLE]"),
    name_end="[TEXT]",
    controls=("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]", "[TEXT]"),
    moves=ALTERNATING,
)


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id`` and its ``turns``, an array of (turn, role, text) in order."""
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def first_error(turns: Column, template: ChatTemplate) -> Column:
    """The place, from 1, of the first turn that the machine has no move for; one more than there are turns if the
    conversation stops where it may not; null if all is well."""
    moves = F.create_map(*[F.lit(x) for state, role, after in template.moves for x in (f"{state}\0{role}", after)])

    def move(now: Column, turn: Column) -> Column:
        after = F.try_element_at(moves, F.concat(now["state"], F.lit("\0"), turn["role"]))
        return F.struct(
            F.when(now["state"].isNotNull(), after).alias("state"),
            (now["passed"] + F.when(now["state"].isNotNull() & after.isNotNull(), 1).otherwise(0)).alias("passed"),
        )

    begun = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("passed"))
    return F.aggregate(
        turns, begun, move, lambda end: F.when(~F.coalesce(end["state"].isin(*template.accepting), F.lit(False)), end["passed"] + 1)
    )


def _segment(text: Column, loss: bool | Column = False) -> Column:
    return F.struct(text.alias("text"), (F.lit(loss) if isinstance(loss, bool) else loss).alias("loss"))


def _by_role(role: Column, template: ChatTemplate, of, other: Column) -> Column:
    chosen = F
    for name, marks in template.roles.items():
        chosen = chosen.when(role == name, F.lit(of(marks)))
    return chosen.otherwise(other)


def format_chats(conversations: DataFrame, template: ChatTemplate = BRACKETS) -> DataFrame:
    """``conv_id``, ``segments`` (array of (text, loss)) and ``first_error`` of every conversation."""

    def segments(turn: Column) -> Column:
        role = turn["role"]
        named = F.concat(F.lit(template.other.before), template.escape(role), F.lit(template.name_end))
        return F.array(
            _segment(_by_role(role, template, lambda m: m.before, named)),
            _segment(template.escape(turn["text"]), _by_role(role, template, lambda m: m.loss, F.lit(template.other.loss))),
            _segment(_by_role(role, template, lambda m: m.after, F.lit(template.other.after))),
        )

    every = F.concat(F.array(_segment(F.lit(template.begin))), F.flatten(F.transform("turns", segments)))
    return turns_of(conversations).select(
        "conv_id", every.alias("segments"), first_error(F.col("turns"), template).alias("first_error")
    )


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column, template: ChatTemplate = BRACKETS) -> Column:
    """What lies under the loss, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")


def parse(text: Column, template: ChatTemplate = BRACKETS) -> Column:
    """The turns, as (role, text), of a formatted conversation."""
    openings = [m.before for m in (*template.roles.values(), template.other)]
    body = F.substr(text, F.lit(len(template.begin) + 1))
    pieces = F.filter(F.split(body, f"(?={'|'.join(map(re.escape, openings))})", -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        name_at = F.instr(piece, template.name_end)
        name = F.substr(piece, F.lit(len(template.other.before) + 1), name_at - 1 - len(template.other.before))
        at, less = name_at + len(template.name_end), F.lit(len(template.other.after))
        role, start = F, F
        for own, marks in template.roles.items():
            here = F.startswith(piece, F.lit(marks.before))
            role, start = role.when(here, F.lit(own)), start.when(here, F.struct(
                F.lit(len(marks.before) + 1).alias("start"), F.lit(len(marks.after)).alias("less")))
        role = role.otherwise(template.unescape(name))
        start = start.otherwise(F.struct(at.alias("start"), less.alias("less")))
        inner = F.substr(piece, start["start"], F.length(piece) - start["start"] + 1 - start["less"])
        return F.struct(role.alias("role"), template.unescape(inner).alias("text"))

    return F.transform(pieces, turn)
