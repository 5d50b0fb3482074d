"""Chat formatting: a state machine over roles, and text segments that say whether they count for the loss.

The template is data: per role the strings before and after a text and whether
the text is trained on, and which role may follow which. Texts that hold one of
the template's strings are escaped, so the output can always be read back.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "start"
_MARK = "~"


@dataclass(frozen=True)
class Template:
    """``roles``: role -> (before, after, trained on). Other roles stand, with their name, between ``other``'s three strings.

    ``follows``: the roles that may come after a role (or at ``START``); a
    conversation may end anywhere. Each string must begin with a character of
    ``opening`` that no string holds elsewhere, and none holds another: then no
    text can complete a string together with its surroundings.
    """

    roles: Mapping[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {
            "system": ("[SYS]", "[/SYS]", False),
            "user": ("[INST]", "[/INST]", False),
            "assistant": ("<s>", "</s>", True),
        }
    )
    other: tuple[str, str, str] = ("[ROLE]", "[:]", "[/ROLE]")
    follows: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: {
            START: ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    opening: str = "[<"

    def __post_init__(self) -> None:
        strings = self.strings()
        for s in strings:
            if len(s) < 2 or s[0] not in self.opening or any(c in s[1:] for c in self.opening + _MARK):
                raise ValueError(f"{s!r} must begin with one of {self.opening!r} and hold none of them, nor {_MARK!r}, later")
        if len(set(strings)) < len(strings):
            raise ValueError("the strings of a template must differ")

    def strings(self) -> list[str]:
        return [s for before, after, _ in self.roles.values() for s in (before, after)] + list(self.other)

    def _ends(self) -> str:
        """What may follow an opening character in a string of the template."""
        return "|".join(re.escape(s[1:]) for s in sorted(self.strings(), key=len, reverse=True))

    def escape(self, text: Column) -> Column:
        """Whatever reads as a string of the template gets one more mark after its first character."""
        pattern = f"([{re.escape(self.opening)}])({_MARK}*(?:{self._ends()}))"
        return F.regexp_replace(text, pattern, f"$1{_MARK}$2")

    def unescape(self, text: Column) -> Column:
        pattern = f"([{re.escape(self.opening)}]){_MARK}({_MARK}*(?:{self._ends()}))"
        return F.regexp_replace(text, pattern, "$1$2")

    def allowed(self, before: Column, role: Column) -> Column:
        """Whether the machine may go from ``before`` (null at the start) to ``role``."""
        steps = [f"{a}\n{b}" for a, later in self.follows.items() for b in later]
        step = F.concat_ws("\n", F.coalesce(before, F.lit(START)), role)
        return role.isNotNull() & step.isin(steps)


DEFAULT = Template()


def _segments(turn: Column, template: Template) -> Column:
    """The three segments of a turn: what stands before its text, the text, what stands after."""
    known = list(template.roles)
    role, text = F.coalesce(turn["role"], F.lit("")), template.escape(turn["text"])
    opens = F.concat(F.lit(template.other[0]), template.escape(role), F.lit(template.other[1]))
    closes, trained = F.lit(template.other[2]), F.lit(False)
    for name in known:
        before, after, loss = template.roles[name]
        opens = F.when(role == name, F.lit(before)).otherwise(opens)
        closes = F.when(role == name, F.lit(after)).otherwise(closes)
        trained = F.when(role == name, F.lit(loss)).otherwise(trained)
    part = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
    return F.array(part(opens, F.lit(False)), part(text, trained), part(closes, F.lit(False)))


def format_chats(
    rows: DataFrame,
    template: Template = DEFAULT,
    *,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, valid, first_bad_turn, segments, formatted``.

    ``segments`` are ``(text, loss)`` in order, ``formatted`` their texts joined;
    the loss covers the texts of roles trained on, without the strings around
    them. Turns are ordered by their number, nulls first, then by role and text,
    so ties have one order too. Null texts are empty; null roles read back as
    empty ones and are never valid, nor are roles without a place in the
    machine: such conversations are formatted all the same, with ``valid``
    false and the position (from 0) of the first turn that the machine refuses.
    Rows without a conversation id form one conversation. A conversation is one
    cell by definition and must fit in memory; the turns of one are gathered by
    an aggregate, so no window over a conversation is needed. An empty table
    gives no rows; other columns are not read.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.col(role_col).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    talks = rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    previous = F.concat(F.array(F.lit(None).cast("string")), F.col("turns.role"))
    return (
        talks.withColumn("_steps", F.arrays_zip(previous.alias("before"), F.col("turns.role").alias("role")))
        .withColumn("_steps", F.slice("_steps", F.lit(1), F.size("turns")))
        .withColumn(
            "_refused",
            F.transform(
                "_steps",
                lambda s, i: F.when((i > 0) & s["before"].isNull() | ~template.allowed(s["before"], s["role"]), i),
            ),
        )
        .withColumn("first_bad_turn", F.array_min("_refused"))
        .withColumn("segments", F.flatten(F.transform("turns", lambda t: _segments(t, template))))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.col("first_bad_turn").isNull().alias("valid"),
            "first_bad_turn",
            "segments",
            F.array_join("segments.text", "").alias("formatted"),
        )
    )


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns ``(role, text)`` that a formatted conversation holds."""
    q = lambda s: rf"\Q{s}\E"
    forms = {name: f"{q(b)}(.*?){q(a)}" for name, (b, a, _) in template.roles.items()}
    opens, middle, closes = map(q, template.other)
    other = f"{opens}(.*?){middle}(.*?){closes}"
    found = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join([*forms.values(), other])), F.lit(0))

    def turn(x: Column) -> Column:
        role = template.unescape(F.regexp_extract(x, "(?s)^" + other, 1))
        text = F.regexp_extract(x, "(?s)^" + other, 2)
        for name, (before, after, _) in template.roles.items():
            here = x.startswith(before)
            inner = F.substr(x, F.lit(len(before) + 1), F.length(x) - len(before) - len(after))
            role, text = F.when(here, F.lit(name)).otherwise(role), F.when(here, inner).otherwise(text)
        return F.struct(role.alias("role"), template.unescape(text).alias("text"))

    return F.transform(found, turn)


def read_loss(segments: Column, template: Template = DEFAULT) -> Column:
    """All text under the loss mask as it was before escaping."""
    trained = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(trained, lambda s: template.unescape(s["text"])), "")
