"""Chat formatting: turns as one training text, with a flag per segment that says whether its tokens count in the loss.

A ``ChatTemplate`` is data: what opens and closes a turn, a label per role, which roles are learnt, and the steps of
the finite-state machine that a well-formed conversation follows. ``format_conversations`` and ``read_turns`` are
expressions of Spark's own functions; texts are escaped row by row before the one shuffle, by conversation.

A control string never occurs inside an escaped text: the escape character is doubled, and put behind the first
character of each control string. So a formatted conversation is read back by splitting at the closing string, and
each text by dropping one escape character before any character.

Defined results. Turns are in order of ``turn`` (null first), ties by role, then text; repeated rows are turns of
their own. A null text or role is empty; a role that the template does not know is written with its escaped name and
refused by the machine, but formatted like any other. Rows with a null ``conv_id`` are one conversation with a null
id. Empty tables give no rows; other columns, whatever their names, are not read. One conversation is one value of
the result, so it must fit into a string of Spark (2 GB), as its digests need it whole; texts have no other limit.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """``steps`` maps (state, role) to the next state; a conversation starts in ``start`` and may end in ``final``."""

    labels: Mapping[str, str]
    learnt: frozenset[str]
    steps: Mapping[tuple[str, str], str]
    start: str
    final: frozenset[str]
    opens: str = "### "
    after_label: str = ": "
    closes: str = "</turn>"
    gap: str = "\n"
    escape: str = "\\"
    other: str = "="
    control: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "control", (self.opens, self.after_label, self.closes))
        for text in self.control:
            if len(text) < 2 or self.escape in text:
                raise ValueError(f"a control string needs two characters and no escape: {text!r}")
            if any(text.endswith(other[:n]) for other in self.control for n in range(1, min(len(text), len(other)) + (other != text))):
                raise ValueError(f"the end of {text!r} starts a control string")
        for label in self.labels.values():
            if label.startswith(self.other) or self.escape in label or any(text in label for text in self.control):
                raise ValueError(f"label {label!r} cannot be told from a control string")
        if len(set(self.labels.values())) < len(self.labels):
            raise ValueError("two roles have one label")


#: An optional system turn, then user and assistant in turn, the assistant last; only assistant texts are learnt.
TEMPLATE = ChatTemplate(
    labels={"system": "System", "user": "User", "assistant": "Assistant"},
    learnt=frozenset({"assistant"}),
    steps={
        ("start", "system"): "instructed",
        ("start", "user"): "asked",
        ("instructed", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    },
    start="start",
    final=frozenset({"answered"}),
)


def escaped(text: Column, template: ChatTemplate, label: bool = False) -> Column:
    """The text with no control string inside; what ends a label matters in labels only."""
    mark = template.escape
    text = F.replace(text, F.lit(mark), F.lit(mark * 2))
    for control in template.control if label else (template.opens, template.closes):
        text = F.replace(text, F.lit(control), F.lit(control[0] + mark + control[1:]))
    return text


def unescaped(text: Column, template: ChatTemplate) -> Column:
    return F.regexp_replace(text, f"(?s){re.escape(template.escape)}(.)", "$1")


def _label(role: Column, template: ChatTemplate) -> Column:
    """What stands for the role: its label, or its escaped name behind a mark."""
    found = F.concat(F.lit(template.other), escaped(role, template, label=True))
    for name, label in template.labels.items():
        found = F.when(role == name, F.lit(label)).otherwise(found)
    return found


def _role(label: Column, template: ChatTemplate) -> Column:
    found = unescaped(F.substring(label, len(template.other) + 1, 2147483647), template)
    for name, text in template.labels.items():
        found = F.when(label == text, F.lit(name)).otherwise(found)
    return found


def _first_fault(roles: Column, template: ChatTemplate) -> Column:
    """Walk the machine: the position of the first turn it refuses, the number of turns if it ends too early, else null."""
    states = sorted({template.start, *template.final, *template.steps.values(), *(s for s, _ in template.steps)})
    code = {state: i for i, state in enumerate(states)}

    def step(seen: Column, role: Column) -> Column:
        state = F.lit(-1)
        for (at, name), to in template.steps.items():
            state = F.when((seen["state"] == code[at]) & (role == name), F.lit(code[to])).otherwise(state)
        go_on = seen["state"] >= 0
        return F.struct(F.when(go_on, state).otherwise(F.lit(-1)).alias("state"), (seen["at"] + F.when(go_on & (state >= 0), 1).otherwise(0)).cast("int").alias("at"))

    def fault(seen: Column) -> Column:
        return F.when(~seen["state"].isin([code[s] for s in template.final]), seen["at"])

    return F.aggregate(roles, F.struct(F.lit(code[template.start]).alias("state"), F.lit(0).alias("at")), step, fault)


def format_conversations(turns: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """One row per conversation of ``(conv_id, turn, role, text)`` rows.

    ``segments``: in order, what the text is made of, each with its loss flag; ``formatted``: all of them joined;
    ``fault``: null if the machine accepts the order of the roles, else where it stops.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("order"))
    # Escaped beside the texts, before the shuffle; the label goes with the role.
    rows = rows.select(
        "conv_id",
        F.struct(
            "order",
            F.concat(F.lit(template.opens), _label(F.col("order.role"), template), F.lit(template.after_label)).alias("head"),
            escaped(F.col("order.text"), template).alias("body"),
        ).alias("turn"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    tail = F.lit(template.closes + template.gap)
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(t["head"].alias("text"), F.lit(False).alias("loss")),
                F.struct(t["body"].alias("text"), t["order"]["role"].isin(*sorted(template.learnt)).alias("loss")),
                F.struct(tail.alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    fault = _first_fault(F.transform("turns", lambda t: t["order"]["role"]), template)
    return whole.select("conv_id", segments.alias("segments"), fault.alias("fault")).select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "fault"
    )


def read_turns(formatted: Column, template: ChatTemplate = TEMPLATE) -> Column:
    """The (role, text) of each turn, from the formatted text alone."""
    pieces = F.split(formatted, re.escape(template.closes + template.gap))
    bare = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substring(p, len(template.opens) + 1, 2147483647))
    cut = F.transform(bare, lambda p: F.struct(F.substring_index(p, template.after_label, 1).alias("label"), p.alias("piece")))
    return F.transform(
        cut,
        lambda c: F.struct(
            _role(c["label"], template).alias("role"),
            unescaped(c["piece"].substr(F.length(c["label"]) + len(template.after_label) + 1, F.length(c["piece"])), template).alias("text"),
        ),
    )


def learnt_text(segments: Column, template: ChatTemplate = TEMPLATE) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")


def digests(conversations: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """Counts and digests of formatted conversations, read back from ``formatted`` and ``segments``."""
    read = conversations.select("conv_id", "formatted", "fault", read_turns(F.col("formatted"), template).alias("turns"), learnt_text(F.col("segments"), template).alias("learnt"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("fault").isNull().alias("accepted"),
    )
