"""Chat formatting: a state machine over roles and a declarative template, in SQL functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Stands before a role that is meant as it is spelled. No code of a mark.
RAW = "\\a"


@dataclass(frozen=True)
class Template:
    """Markers of a turn, what carries loss, and which role may follow which state.

    A turn is `head` + role + `mid` + text + `end`. Inside roles and texts every backslash and
    every control string is replaced by a backslash code (see `escaped`), so the markers occur
    in the output only as markers and the replacement can be undone. A role that is spelled like
    another role's name here gets the code `RAW` before it.
    """

    head: str = "### "
    mid: str = ": "
    end: str = "</turn>"
    names: dict[str, str] = field(
        default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"}
    )
    loss_roles: tuple[str, ...] = ("assistant",)
    #: (state, role) -> next state; a pair that is not listed is an error.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accepting: tuple[str, ...] = ("answered",)

    def clashing(self) -> list[str]:
        """Spellings that would be read back as another role."""
        return sorted({name for role, name in self.names.items() if name != role})

    def codes(self) -> list[tuple[str, str]]:
        # Longest first, so that a marker inside another one cannot split it.
        marks = sorted({self.end, self.head, self.mid}, key=lambda m: (-len(m), m))
        return [("\\", "\\b"), *((m, f"\\{chr(ord('c') + k)}") for k, m in enumerate(marks))]


def escaped(text: Column, template: Template) -> Column:
    for mark, code in template.codes():
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def unescaped(text: Column, template: Template) -> Column:
    for mark, code in reversed(template.codes()):
        text = F.replace(text, F.lit(code), F.lit(mark))
    return text


def format_chats(
    df: DataFrame,
    template: Template = Template(),
    conversation: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, spans, valid, bad_turn.

    `spans` lists (start, length, loss) of consecutive segments of `formatted` in code points,
    two kinds for each turn: markers (no loss) and the text (loss for `loss_roles`). `valid` says
    whether the role machine accepts the whole conversation, `bad_turn` is the first turn (from 1)
    without a move, null if none; invalid conversations are formatted like the others.

    Null role or text: empty. Rows of equal turn: ordered by role, then text; a null turn comes
    first; repeated rows all count. Rows of null conversation id are one conversation. A
    conversation is a row of the result, so its turns meet in one task; no table: no rows. Other columns of
    `df` are ignored, so names cannot clash.
    """
    turns = df.select(
        F.col(conversation).alias("conv_id"),
        F.struct(
            F.col(order).alias("t"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("r"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("x"),
        ).alias("turn"),
    )
    named = F.create_map(*[F.lit(v) for pair in template.names.items() for v in pair])

    def shown(role: Column) -> Column:
        spelled = escaped(F.coalesce(named[role], role), template)
        as_is = role.isin(*template.clashing()) & named[role].isNull()
        return F.when(as_is, F.concat(F.lit(RAW), spelled)).otherwise(spelled)

    pieces = lambda t: F.struct(
        F.concat(
            F.lit(template.head),
            shown(t["r"]),
            F.lit(template.mid),
        ).alias("open"),
        escaped(t["x"], template).alias("body"),
        t["r"].isin(*template.loss_roles).alias("loss"),
    )
    machine = F.create_map(
        *[F.lit(v) for (state, r), to in template.moves.items() for v in (f"{state}>{r}", to)]
    )
    start = F.struct(F.lit("start").alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("n"))

    def step(acc: Column, t: Column) -> Column:
        to = machine[F.concat(acc["state"], F.lit(">"), t["r"])]
        return F.struct(
            F.coalesce(to, F.lit("error")).alias("state"),
            F.coalesce(acc["bad"], F.when(to.isNull(), acc["n"] + 1)).alias("bad"),
            (acc["n"] + 1).alias("n"),
        )

    end = len(template.end)
    place = lambda acc, p: F.struct(
        (acc["at"] + F.length(p["open"]) + F.length(p["body"]) + end).alias("at"),
        F.concat(
            acc["spans"],
            F.array(
                F.struct(acc["at"].alias("start"), F.length(p["open"]).alias("length"), F.lit(False).alias("loss")),
                F.struct(
                    (acc["at"] + F.length(p["open"])).alias("start"),
                    F.length(p["body"]).alias("length"),
                    p["loss"].alias("loss"),
                ),
                F.struct(
                    (acc["at"] + F.length(p["open"]) + F.length(p["body"])).alias("start"),
                    F.lit(end).alias("length"),
                    F.lit(False).alias("loss"),
                ),
            ),
        ).alias("spans"),
    )
    empty = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<struct<start:int,length:int,loss:boolean>>").alias("spans"),
    )
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    cut = grouped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.transform("turns", pieces).alias("pieces"),
        F.aggregate("turns", start, step).alias("machine"),
    )
    return cut.select(
        "conv_id",
        "n_turns",
        F.array_join(
            F.transform("pieces", lambda p: F.concat(p["open"], p["body"], F.lit(template.end))), ""
        ).alias("formatted"),
        F.aggregate("pieces", empty, place)["spans"].alias("spans"),
        (F.col("machine.bad").isNull() & F.col("machine.state").isin(*template.accepting)).alias("valid"),
        F.col("machine.bad").alias("bad_turn"),
    )


def read_chats(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Undo `format_chats` from `formatted` and `spans` alone: adds turns (role, text) and
    loss_texts, the unescaped text of every loss span in order."""
    back = F.create_map(*[F.lit(v) for k, n in template.names.items() for v in (n, k)])
    pieces = F.filter(F.split(F.col("formatted"), f"\\Q{template.end}\\E"), lambda p: p != "")
    mid = F.lit(template.mid)

    def turn(p: Column) -> Column:
        at = F.instr(p, template.mid)
        spelled = F.substring(p, F.lit(len(template.head) + 1), at - len(template.head) - 1)
        name = unescaped(spelled, template)
        as_is = unescaped(F.substring(spelled, F.lit(len(RAW) + 1), F.length(spelled)), template)
        return F.struct(
            F.when(F.startswith(spelled, F.lit(RAW)), as_is).otherwise(F.coalesce(back[name], name)).alias("role"),
            unescaped(F.substring(p, at + F.length(mid), F.length(p)), template).alias("text"),
        )

    loss = F.transform(
        F.filter("spans", lambda s: s["loss"]),
        lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"]), template),
    )
    return formatted.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_texts", loss)
