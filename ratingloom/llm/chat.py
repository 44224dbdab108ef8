"""Chat formatting: a finite-state machine over roles and a declarative template with per-segment loss flags.

A template names the marks around a turn, the roles whose text is trained on, the control strings that texts must not
hold, and the transitions that make a turn order valid. Every conversation is formatted, turns in the order of their
number; ``valid`` says whether the machine accepted the order and ended in an accepting state, ``first_bad_turn`` where it
failed first (0-based position).

Escaping is reversible: a backslash becomes two, and every control string gets one backslash after its first character.
Undone, a pair of backslashes is one and a single one is nothing.

Nulls and odd rows: a null text or role is empty; rows with the same turn are ordered by role and text, repeated rows
stay; a null conversation id is a conversation of its own. One conversation becomes one string, so it must fit in a row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class ChatTemplate:
    opening: str = "<|im_start|>"
    after_role: str = "<|im_sep|>"
    closing: str = "<|im_end|>"
    between: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    # strings that other chat formats use as control are escaped too, so that text never passes for a mark
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    start: str = "start"
    accepting: tuple[str, ...] = ("answered", "asked")
    # state and role, then the next state
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "instructed",
            ("start", "user"): "asked",
            ("instructed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.opening, self.after_role, self.closing, *self.foreign)


CHATML = ChatTemplate()


def escape(text: Column, template: ChatTemplate = CHATML) -> Column:
    places = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls)
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"({places})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _accepted(roles: Column, template: ChatTemplate) -> Column:
    """(state, bad): the machine after all roles; ``bad`` is the position of the first role it refused, from where on the
    state is empty."""

    def step(state: Column, turn: Column) -> Column:
        after = F.lit("")
        for (at, role), to in template.transitions.items():
            after = F.when((state["state"] == at) & (turn == role), F.lit(to)).otherwise(after)
        bad = F.when(state["bad"] >= 0, state["bad"]).when(after == "", state["seen"]).otherwise(F.lit(-1))
        return F.struct(after.alias("state"), bad.alias("bad"), (state["seen"] + 1).alias("seen"))

    start = F.struct(F.lit(template.start).alias("state"), F.lit(-1).alias("bad"), F.lit(0).alias("seen"))
    return F.aggregate(roles, start, step)


def format_chats(
    turns: DataFrame,
    template: ChatTemplate = CHATML,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(conv_id, formatted, segments<text, loss>, valid, first_bad_turn), one row per conversation."""
    empty = F.lit("")
    rows = turns.select(
        F.col(conversation).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), empty).alias("role"),
            F.coalesce(F.col(text), empty).alias("text"),
        ).alias("row"),
    )
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))

    def segments(row: Column) -> Column:
        def segment(value: Column, loss: Column) -> Column:
            return F.struct(value.alias("text"), loss.alias("loss"))

        no = F.lit(False)
        opened = F.concat(F.lit(template.opening), escape(row["role"], template), F.lit(template.after_role))
        return F.array(
            segment(opened, no),
            segment(escape(row["text"], template), row["role"].isin(*template.loss_roles)),
            segment(F.lit(template.closing + template.between), no),
        )

    state = _accepted(F.transform("rows", lambda r: r["role"]), template)
    made = grouped.select(
        "conv_id", F.flatten(F.transform("rows", segments)).alias("segments"), state.alias("machine")
    )
    valid = F.coalesce(F.col("machine.state").isin(*template.accepting), F.lit(False))
    return made.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        valid.alias("valid"),
        F.when(F.col("machine.bad") >= 0, F.col("machine.bad")).alias("first_bad_turn"),
    )


def read_back(formatted: Column, template: ChatTemplate = CHATML) -> Column:
    """array<struct<role, text>> of a formatted conversation, by its marks alone."""
    closing = re.escape(template.closing + template.between)
    bodies = F.filter(F.split(formatted, closing), lambda b: b != "")

    def parts(body: Column) -> Column:
        cut = F.split(F.substr(body, F.lit(len(template.opening) + 1)), re.escape(template.after_role), 2)
        return F.struct(unescape(F.element_at(cut, 1)).alias("role"), unescape(F.element_at(cut, 2)).alias("text"))

    return F.transform(bodies, parts)


def chat_digest(chats: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """What training would see, read back from formatted strings and loss flags."""
    turns = read_back(F.col("formatted"), template)
    whole = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return chats.withColumn("__turns", turns).select(
        "conv_id",
        F.size("__turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
