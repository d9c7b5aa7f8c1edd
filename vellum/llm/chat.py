"""Chat formatting from a declarative template, with expressions only.

A finite-state machine over roles, folded over a conversation's turns, says where the order of turns breaks. Each turn
gives three segments - opening, text, closing - with a loss flag each; the formatted text is their concatenation.

Escaping (so that no text can forge a turn): a backslash is doubled, and ``<|`` becomes ``<\\|``. A run of backslashes
from a text has even length then, so ``<\\|`` with a single backslash is always an escape and the way back is exact. In
roles a line feed becomes ``<\\_|`` as well.

Defined cases: a null text or role is empty; rows with a null conv_id form one conversation; turns are ordered by
(turn, role, text), nulls first, and equal rows are separate turns; conversations whose order is broken are formatted
too and say at which turn it breaks; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings, which roles carry loss, and the machine: state -> {role: next state}.
TEMPLATE = {
    "open": "<|im_start|>",
    "role_end": "\n",
    "close": "<|im_end|>",
    "turn_end": "\n",
    "loss_roles": ["assistant"],
    "start": "start",
    "next": {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    },
}


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\_|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\_|"), F.lit("\n")))


def broken_turn(turns: Column, template: dict) -> Column:
    """Position (from 0) of the first turn that the machine rejects; null if it accepts all."""
    moves = [(f"{state}\n{role}", to) for state, out in template["next"].items() for role, to in out.items()]
    table = F.map_from_arrays(F.array(*[F.lit(k) for k, _ in moves]), F.array(*[F.lit(v) for _, v in moves]))
    begin = F.struct(F.lit(template["start"]).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("broken"))

    def step(acc: Column, turn: Column) -> Column:
        to = F.try_element_at(table, F.concat(acc["state"], F.lit("\n"), turn["role"]))
        broken = F.coalesce(acc["broken"], F.when(to.isNull(), acc["at"]))
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["at"] + 1).alias("at"), broken.alias("broken"))

    return F.aggregate(turns, begin, step, lambda acc: acc["broken"])


def format_conversations(rows: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, formatted (string), segments (array of text, loss) and broken_turn of each conversation."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    talks = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def segments(t: Column) -> Column:
        return F.array(
            part(F.concat(F.lit(template["open"]), escape_role(t["role"]), F.lit(template["role_end"])), F.lit(False)),
            part(escape(t["text"]), t["role"].isin(template["loss_roles"])),
            part(F.lit(template["close"] + template["turn_end"]), F.lit(False)),
        )

    out = talks.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), broken_turn(F.col("turns"), template).alias("broken_turn"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "broken_turn")


def read_turns(formatted: Column, template: dict = TEMPLATE) -> Column:
    """The turns (array of role, text) back from a formatted text."""
    ends = template["close"] + template["turn_end"]
    parts = F.split(formatted, "\\Q" + ends + "\\E")
    parts = F.slice(parts, 1, F.size(parts) - 1)  # every turn is closed, so nothing follows the last one

    def turn(p: Column) -> Column:
        body = F.substring(p, len(template["open"]) + 1, F.length(p))
        cut = F.instr(body, template["role_end"])
        return F.struct(
            unescape_role(F.substring(body, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(body, cut + len(template["role_end"]), F.length(body))).alias("text"),
        )

    return F.transform(parts, turn)


def read_back(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Counts and digests of what a formatted text and its loss mask hold."""
    turns = read_turns(F.col("formatted"), template)
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    back = formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"), "broken_turn")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("broken_turn").cast("long").alias("broken_turn"),
    )
