"""Chat formatting: each conversation as one text, parsed again before it is given out.

The grammar of a formatted conversation::

    conversation = turn*
    turn         = open " " body " " close          open and close belong to one role
    body         = any characters but a control string

A control string is one of the template's opens and closes.  A body of a role
without marks of its own is the role's name, a line feed and the text.  A text that
doesn't come back as it was is escaped: a backslash goes behind the first character
of each control string, and of each that is escaped already, so that taking one
away gives the text again.  No control string holds the first character of one
further on, so none can arise where two parts meet.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgraph.functions.links import let

#: Marks of the roles that have their own: a bracket, a name, a bracket.
TEMPLATE = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>"), "tool": ("[TOOL]", "[/TOOL]")}
#: Marks of all other roles.
OTHER = ("[TURN]", "[/TURN]")
#: The role whose texts are trained on.
LOSS_ROLE = "assistant"


class Template:
    """Marks by role, with the expressions that render, parse and escape by them."""

    def __init__(self, marks: dict[str, tuple[str, str]] | None = None, other: tuple[str, str] = OTHER, loss_role: str = LOSS_ROLE) -> None:
        self.marks, self.other, self.loss_role = dict(TEMPLATE if marks is None else marks), other, loss_role
        self.controls = sorted({c for pair in [*self.marks.values(), other] for c in pair})
        if len(self.controls) != 2 * len(self.marks) + 2 or not all(re.fullmatch(r"[\[<{][^\\\[\]<>{}\s]+[\]>}]", c) for c in self.controls):
            raise ValueError("marks must differ, and be a name between brackets")
        if loss_role not in self.marks:
            raise ValueError("the role that is trained on needs marks of its own")
        # By first character, so that most characters of a text are passed over at a glance.
        rests = {first: "(?:" + "|".join(re.escape(c[1:]) for c in self.controls if c[0] == first) + ")" for first in sorted({c[0] for c in self.controls})}
        self._first = list(rests)
        starts = "[" + "".join(map(re.escape, rests)) + "]"
        self.control = starts + "(?:" + "|".join(f"(?<={re.escape(c)}){rest}" for c, rest in rests.items()) + ")"
        self._to_escape = "|".join(f"{re.escape(c)}(?=\\\\*{rest})" for c, rest in rests.items())
        self._escaped = "\\\\(?:" + "|".join(f"(?<={re.escape(c)}\\\\)(?=\\\\*{rest})" for c, rest in rests.items()) + ")"

    def may_conflict(self, text: Column) -> Column:
        """Whether a text holds the first character of any control string: others can't be taken for one."""
        found = text.contains(self._first[0])
        for c in self._first[1:]:
            found = found | text.contains(c)
        return found

    def escape(self, text: Column) -> Column:
        return F.when(self.may_conflict(text), F.regexp_replace(text, self._to_escape, r"$0\\")).otherwise(text)

    def unescape(self, text: Column) -> Column:
        return F.when(text.contains("\\"), F.regexp_replace(text, self._escaped, "")).otherwise(text)

    def _mark(self, role: Column, which: int) -> Column:
        marks = F.lit(self.other[which])
        for name, pair in self.marks.items():
            marks = F.when(role == name, pair[which]).otherwise(marks)
        return marks

    def body(self, role: Column, text: Column) -> Column:
        name = F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))
        return F.when(role.isin(*self.marks), text).otherwise(F.concat(name, F.lit("\n"), text))

    def segments(self, role: Column, text: Column, escaped: Column) -> Column:
        """A turn as three pieces of text, with whether each is trained on."""
        body = self.body(role, text)
        piece = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
        no = F.lit(False)
        return F.array(
            piece(F.concat(self._mark(role, 0), F.lit(" ")), no), piece(F.when(escaped, self.escape(body)).otherwise(body), role == self.loss_role), piece(F.concat(F.lit(" "), self._mark(role, 1)), no)
        )

    def parse(self, formatted: Column) -> Column:
        """The turns of a formatted text as array<struct<role, text>>; null if it isn't in the grammar.

        The text is cut before each control string; each second piece closes what
        the one before it opened, so the work is linear.
        """
        even, odd = (lambda a: F.filter(a, lambda _, i: i % 2 == 0)), (lambda a: F.filter(a, lambda _, i: i % 2 == 1))
        known = [a + b for a, b in [*self.marks.values(), self.other]]
        pieces = F.filter(F.split(formatted, f"(?={self.control})", -1), lambda x: x != "")
        marked = F.transform(pieces, lambda x: let(F.regexp_extract(x, f"^{self.control}", 0), lambda m: F.struct(m.alias("mark"), x.substr(F.length(m) + 1, F.length(x)).alias("rest"))))
        pairs = lambda x: F.zip_with(even(x), odd(x), lambda a, b: F.concat(a["mark"], b["mark"]))
        cut = let(marked, lambda x: F.struct(pairs(x).alias("pairs"), F.transform(even(x), lambda a: a["rest"]).alias("bodies"), F.forall(odd(x), lambda b: b["rest"] == "").alias("together")))

        def turns(x: Column) -> Column:
            good = x["together"] & F.forall(x["pairs"], lambda p: F.coalesce(p.isin(*known), F.lit(False))) & F.forall(x["bodies"], lambda t: t.startswith(" ") & t.endswith(" ") & (F.length(t) >= 2))
            return F.when(good, F.zip_with(x["pairs"], x["bodies"], lambda pair, t: self._turn(pair, self.unescape(t.substr(F.lit(2), F.length(t) - 2)))))

        return let(cut, turns)

    def _turn(self, pair: Column, body: Column) -> Column:
        said = F.substring_index(body, "\n", 1)
        role = F.replace(F.replace(said, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))
        for name, marks in self.marks.items():
            role = F.when(pair == "".join(marks), name).otherwise(role)
        text = F.when(pair == "".join(self.other), body.substr(F.length(said) + 2, F.length(body))).otherwise(body)
        return F.struct(role.alias("role"), text.alias("text"))


def _joined(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def _rendered_turn(template: Template, escaped: Column) -> Column:
    return _joined(template.segments(F.col("role"), F.col("text"), escaped))


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, segments: the text of each conversation in pieces, array<struct<text, loss>>, loss for what a model is trained on.

    Reads conv_id, turn, role and text; other columns are ignored.  Turns stand in
    order of turn, nulls first, those of one turn by role and text, repeated rows
    as often as they are there.  Null roles and texts are empty ones; rows of a null
    conv_id are one conversation.  No rows give no rows.

    Each turn is rendered as it is and parsed; one that doesn't come back is
    escaped, rendered and parsed again.  Then the whole conversation is parsed and
    compared with its turns, and raises if it differs.  A conversation is a row of
    the result, so its texts must fit one (two gigabytes); rows are shuffled once.
    """
    template = template or Template()
    empty = F.lit("")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    source = F.array(F.struct("role", "text"))
    same = lambda escaped: F.coalesce(template.parse(_rendered_turn(template, F.lit(escaped))) == source, F.lit(False))
    plain = ~template.may_conflict(F.concat("role", "text"))
    escaped = F.when(plain | same(False), False).when(same(True), True).otherwise(F.raise_error(F.concat(F.lit("a turn doesn't come back: "), F.col("text"))))
    rows = rows.withColumn("escaped", escaped)
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "escaped"))).alias("turns"))
    out = turns.withColumn("segments", F.flatten(F.transform("turns", lambda t: template.segments(t["role"], t["text"], t["escaped"]))))
    back = template.parse(_joined(F.col("segments")))
    is_same = F.coalesce(back == F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), F.lit(False))
    checked = F.when(is_same, F.col("segments")).otherwise(F.raise_error(F.concat(F.lit("a conversation doesn't come back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    return out.select("conv_id", checked.alias("segments"))


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, formatted, turns, loss_text of (conv_id, segments): the whole text, the turns parsed from it, and the texts trained on without their escapes."""
    template = template or Template()
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")
    rows = formatted.select("conv_id", _joined(F.col("segments")).alias("formatted"), loss.alias("loss_text"))
    return rows.select("conv_id", "formatted", template.parse(F.col("formatted")).alias("turns"), "loss_text")


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of what ``read_back`` finds."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted, template).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
