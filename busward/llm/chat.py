"""Chat formatting: turns become marked text segments with loss flags, by a declarative template.

Built-in expressions only. One conversation is one row of the result, as its format asks; the rows of a
conversation meet through an aggregate on its id, so the work spreads by conversation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

#: Put after the first character of a control string inside a text; doubled where a text has it.
ESCAPE = "\\"


@dataclass(frozen=True)
class Marks:
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks of each role, of roles that are not listed (their name stands between two marks), and turn order.

    `end` ends every turn. `control` lists the strings that marks are made of and that texts must not hold.
    Each starts with a character that no control string has further inside, so that none can arise where a
    text meets a mark.
    """

    begin: str = "<s>"
    end: str = "</s>"
    roles: dict[str, Marks] = field(
        default_factory=lambda: {
            "system": Marks("[SYS] ", " [/SYS]"),
            "user": Marks("[INST] ", " [/INST]"),
            "assistant": Marks("[ANS] ", " [/ANS]", loss=True),
            "tool": Marks("[TOOL] ", " [/TOOL]"),
        }
    )
    other_opening: str = "[ROLE] "
    other_middle: str = " [SAYS] "
    other_closing: str = " [/SAYS]"
    control: tuple[str, ...] = (
        "<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ANS]", "[/ANS]", "[TOOL]", "[/TOOL]", "[ROLE]", "[SAYS]", "[/SAYS]",
    )
    #: state -> roles that may follow; a role's name is the next state. Roles without an entry end a valid order.
    order: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant", "tool"),
        }
    )
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        leads = {c[0] for c in self.control}
        if any(ESCAPE in c or len(c) < 2 or leads & set(c[1:]) for c in self.control):
            raise ValueError("control strings must start with a character found nowhere inside one, and hold no escape")
        if self.end not in self.control or not all(any(c in m for c in self.control) for r in self.roles.values() for m in (r.opening, r.closing)):
            raise ValueError("each mark must hold a control string")

    def escape(self, text: Column) -> Column:
        out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
        for c in self.control:
            out = F.replace(out, F.lit(c), F.lit(c[0] + ESCAPE + c[1:]))
        return out

    def unescape(self, text: Column) -> Column:
        out = text
        for c in self.control:
            out = F.replace(out, F.lit(c[0] + ESCAPE + c[1:]), F.lit(c))
        return F.replace(out, F.lit(ESCAPE * 2), F.lit(ESCAPE))

    def segments(self, role: Column, text: Column) -> Column:
        """Opening, text and closing of a turn, each with its loss flag."""
        opening = F.concat(F.lit(self.other_opening), self.escape(role), F.lit(self.other_middle))
        closing, loss = F.lit(self.other_closing), F.lit(False)
        for name, marks in self.roles.items():
            own = role == name
            opening = F.when(own, F.lit(marks.opening)).otherwise(opening)
            closing = F.when(own, F.lit(marks.closing)).otherwise(closing)
            loss = F.when(own, F.lit(marks.loss)).otherwise(loss)
        part = lambda value, flag: F.struct(value.alias("text"), flag.alias("loss"))
        return F.array(part(opening, F.lit(False)), part(self.escape(text), loss), part(F.concat(closing, F.lit(self.end)), F.lit(False)))

    def first_violation(self, turns: Column) -> Column:
        """Position of the first turn that the order does not allow; null if all are allowed."""
        allowed = [(state, role) for state, roles in self.order.items() for role in roles]

        def step(state: Column, role: Column) -> Column:
            ok = F.lit(False)
            for a, b in allowed:
                ok = ok | ((state == a) & (role == b))
            return ok

        start = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))
        return F.aggregate(
            turns,
            start,
            lambda acc, t: F.struct(
                t["role"].alias("state"),
                (acc["at"] + 1).alias("at"),
                F.when(acc["bad"].isNull() & ~step(acc["state"], t["role"]), acc["at"]).otherwise(acc["bad"]).alias("bad"),
            ),
            lambda acc: acc["bad"],
        )


def formatted(df: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: segments, formatted, first_violation, complete.

    Rows are taken by turn (null last), equal turns by role and text; repeated rows are turns of their own.
    A null role or text counts as an empty one; rows without an id are one conversation with id null.
    Conversations out of order are formatted too and carry the position of the first turn that does not
    fit; complete says that the order holds and ends in a final role. Other columns are not carried.
    """
    template = template or Template()
    row = F.struct(
        F.col(turn).isNull().alias("late"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    turns = df.groupBy(F.col(conv)).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    done = turns.withColumn("segments", F.flatten(F.transform("turns", lambda t: template.segments(t["role"], t["text"]))))
    last = F.element_at("turns", -1)["role"]
    return done.select(
        conv,
        "segments",
        F.concat(F.lit(template.begin), F.array_join(F.transform("segments", lambda s: s["text"]), "")).alias("formatted"),
        template.first_violation(F.col("turns")).alias("first_violation"),
        (template.first_violation(F.col("turns")).isNull() & last.isin(*template.final)).alias("complete"),
    )


def read_turns(text: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation: an array of role and text, unescaped."""
    template = template or Template()
    body = F.substr(text, F.lit(len(template.begin) + 1))
    pieces = F.split(body, re.escape(template.end))
    cut = lambda piece, left, right: F.substr(piece, left + 1, F.length(piece) - left - right)

    def turn(piece: Column) -> Column:
        middle = F.locate(template.other_middle, piece, len(template.other_opening) + 1)
        left = len(template.other_opening)
        name = F.substr(piece, F.lit(left + 1), middle - left - 1)
        start = middle + len(template.other_middle) - 1
        role, body = template.unescape(name), cut(piece, start, F.lit(len(template.other_closing)))
        for known, marks in template.roles.items():
            own = F.startswith(piece, F.lit(marks.opening))
            role = F.when(own, F.lit(known)).otherwise(role)
            body = F.when(own, cut(piece, F.lit(len(marks.opening)), F.lit(len(marks.closing)))).otherwise(body)
        return F.struct(role.alias("role"), template.unescape(body).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    template = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")
