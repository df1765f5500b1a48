"""Chat formatting: a finite-state machine over roles checks the turn order
and a declarative template turns a conversation into text segments, each
with its own loss flag.

DataFrame functions only. One conversation is one output record, so its turns
meet in one row (partial aggregation first); conversations spread by id.

Defined results: a null text is empty; a null role is the empty role; roles
that the template does not name are marked with their own name; turns are
ordered by (turn, role, text), null turns first, repeated rows stay repeated
turns; a null conversation id is a conversation of its own; an order of roles
that the machine rejects is still formatted, with ``valid`` = false; an empty
table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Per role: opening mark, closing mark, loss flag. Marks hold ``<`` or
    ``[`` in first place; escaped texts hold neither, so a mark can't be
    forged by a text. ``moves`` is the machine: (state, role) -> state."""

    roles: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {
        "system": ("[SYS] ", " [/SYS]", False),
        "user": ("[INST] ", " [/INST]", False),
        "assistant": ("<s>", "</s>", True),
    })
    other_open: str = "[ROLE] "
    other_close: str = " [/ROLE]"
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "primed",
        ("start", "user"): "asked",
        ("primed", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    })
    start: str = "start"
    accepting: tuple[str, ...] = ("answered",)


TEMPLATE = Template()

#: Escapes of the characters that start marks; the escape character first.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"))


def escape(text: Column) -> Column:
    """Reversible: afterwards the text holds no ``<`` and no ``[``."""
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _machine(roles: Column, template: Template) -> Column:
    """Does the machine accept this array of roles?"""
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items()
                           for x in (f"{state} {role}", to)])
    end = F.aggregate(roles, F.lit(template.start),
                      lambda state, role: F.coalesce(F.get(F.array(F.try_element_at(moves, F.concat(state, F.lit(" "), role))), F.lit(0)),
                                                     F.lit("rejected")))
    return end.isin(*template.accepting)


def format_conversations(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, valid, segments array<struct<text, loss>>: the concatenated
    segment texts are the formatted conversation."""
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    known = list(template.roles.items())

    def by_role(r: Column, values: list, other: Column) -> Column:
        out = other
        for (name, _), value in zip(known, values):
            out = F.when(r == name, value).otherwise(out)
        return out

    def segment(t: Column) -> Column:
        r = t["role"]
        opening = by_role(r, [F.lit(m[0]) for _, m in known],
                          F.concat(F.lit(template.other_open), escape(r), F.lit(template.other_open[0])))
        closing = by_role(r, [F.lit(m[1]) for _, m in known], F.lit(template.other_close))
        loss = by_role(r, [F.lit(m[2]) for _, m in known], F.lit(False))
        return F.array(F.struct(opening.alias("text"), F.lit(False).alias("loss")),
                       F.struct(t["text"].alias("text"), loss.alias("loss")),
                       F.struct(closing.alias("text"), F.lit(False).alias("loss")))

    ordered = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn").alias("turn")).alias("at"),
                                             role.alias("role"), text.alias("text")))).alias("t"))
    return ordered.select(
        "conv_id",
        _machine(F.transform("t", lambda t: t["role"]), template).alias("valid"),
        F.flatten(F.transform("t", segment)).alias("segments"))


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column) -> Column:
    """The unescaped text under the loss mask."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    marks = [m[0] for m in template.roles.values()] + [template.other_open]
    quoted = "|".join("".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in m) for m in marks)
    pieces = F.filter(F.split(formatted, f"(?={quoted})"), lambda p: p != "")
    other = len(template.other_open)

    def inner(p: Column, opening: Column, closing: str) -> Column:
        return F.substring(p, opening + 1, F.length(p) - opening - len(closing))

    def read(p: Column) -> Column:
        # other roles: mark, escaped name, the mark's first character, text
        named = F.substring_index(F.substring(p, F.lit(other + 1), F.length(p)), template.other_open[0], 1)
        out = F.struct(unescape(named).alias("role"),
                       unescape(inner(p, F.length(named) + other + 1, template.other_close)).alias("text"))
        for name, (opening, closing, _) in template.roles.items():
            out = F.when(F.startswith(p, F.lit(opening)),
                         F.struct(F.lit(name).alias("role"),
                                  unescape(inner(p, F.lit(len(opening)), closing)).alias("text"))).otherwise(out)
        return out

    return F.transform(pieces, read)


def digest(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """One row per formatted conversation, derived from the output alone."""
    read = formatted.select("conv_id", "valid", formatted_text(F.col("segments")).alias("formatted"),
                            loss_text(F.col("segments")).alias("loss"))
    read = read.withColumn("turns", read_turns(F.col("formatted"), template))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid")
