"""Chat formatting: a finite-state machine over roles and a declarative template.

Everything is a DataFrame expression. A conversation's turns, ordered by (turn, role,
text), become text segments: a header, the escaped text and an end mark for each turn.
Each segment has a loss flag; the loss falls on the texts of the template's trained
roles. The machine starts in ``start``, moves by role, and must end in a final state;
conversations that break it are formatted too and carry ``valid`` false and the first
turn that had no move.

Control strings inside texts are escaped and come back exactly: ``\\`` becomes ``\\0``, the
header mark ``\\1``, the end mark ``\\2``; in role names a colon becomes ``\\3`` and a line
feed ``\\4``. Nulls: null text and null role are empty, null turns come first, null conv_id is
one conversation. Repeated rows are turns of their own. Empty input gives no rows. Other
columns are not read. A conversation is one row, so it must fit in one (2 GB).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import project


@dataclass(frozen=True)
class Template:
    header_mark: str = "### "
    end_mark: str = "</turn>"
    labels: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    trained: tuple = ("assistant",)
    moves: dict = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    final: tuple = ("assistant",)

    @property
    def control(self) -> tuple:
        return self.header_mark.strip(), self.end_mark


DEFAULT = Template()


def escape(text: Column, t: Template = DEFAULT) -> Column:
    head, end = t.control
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\0")), F.lit(head), F.lit("\\1")), F.lit(end), F.lit("\\2"))


def unescape(text: Column, t: Template = DEFAULT) -> Column:
    head, end = t.control
    return F.replace(F.replace(F.replace(text, F.lit("\\2"), F.lit(end)), F.lit("\\1"), F.lit(head)), F.lit("\\0"), F.lit("\\"))


def _label(role: Column, t: Template) -> Column:
    known = F.create_map(*[F.lit(x) for kv in t.labels.items() for x in kv])
    other = F.concat(F.lit("?"), F.replace(F.replace(escape(role, t), F.lit(":"), F.lit("\\3")), F.lit("\n"), F.lit("\\4")))
    return F.coalesce(F.element_at(known, role), other)


def _role(label: Column, t: Template) -> Column:
    known = F.create_map(*[F.lit(x) for role, name in t.labels.items() for x in (name, role)])
    raw = F.replace(F.replace(F.substr(label, F.lit(2)), F.lit("\\4"), F.lit("\n")), F.lit("\\3"), F.lit(":"))
    return F.when(F.startswith(label, F.lit("?")), unescape(raw, t)).otherwise(F.element_at(known, label))


def format_conversations(turns: DataFrame, t: Template = DEFAULT, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted, valid, bad_turn (0-based, null if valid so far)."""
    rows = project(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def pieces(x: Column) -> Column:
        head = F.concat(F.lit(t.header_mark), _label(x["role"], t), F.lit(": "))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(x["text"], t).alias("text"), x["role"].isin(*t.trained).alias("loss")),
            F.struct(F.lit(t.end_mark + "\n").alias("text"), F.lit(False).alias("loss")),
        )

    move = F.create_map(*[F.lit(x) for (state, role), then in t.moves.items() for x in (f"{state}>{role}", then)])

    def step(acc: Column, x: Column) -> Column:
        then = F.element_at(move, F.concat(acc["state"], F.lit(">"), x["role"]))
        return F.struct(
            F.when(acc["bad"].isNull(), F.coalesce(then, F.lit("error"))).otherwise(acc["state"]).alias("state"),
            F.coalesce(acc["bad"], F.when(then.isNull(), acc["n"])).alias("bad"),
            (acc["n"] + 1).alias("n"),
        )

    start = F.struct(F.lit("start").alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("n"))
    out = convs.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"), F.aggregate("turns", start, step).alias("m"))
    return out.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("m.bad").isNull() & F.col("m.state").isin(*t.final)).alias("valid"),
        F.col("m.bad").cast("long").alias("bad_turn"),
    )


def read_turns(formatted: Column, t: Template = DEFAULT) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    parts = F.split(formatted, r"\Q" + t.end_mark + "\n" + r"\E")
    parts = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    skip = len(t.header_mark) + 1

    def turn(p: Column) -> Column:
        colon = F.instr(p, ": ")
        return F.struct(_role(F.substr(p, F.lit(skip), colon - skip), t).alias("role"), unescape(F.substr(p, colon + 2), t).alias("text"))

    return F.transform(parts, turn)


def loss_text(segments: Column, t: Template = DEFAULT) -> Column:
    """The text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")
