"""Operator 10: chat formatting with a finite-state machine over roles.

A declarative template says how a turn of each role opens and closes and whether
its text counts for the loss.  A machine over roles checks the turn order.  Each
turn becomes segments of text with a loss flag; control strings inside a text
are escaped, so the output can be parsed back to the turns it came from.

A conversation may be of any length: rows are dealt by conversation and sorted
by turn, and one pass over them holds only the state of the current
conversation (machine state, running hashes, counts).

Edge cases: NULL text and NULL role are empty strings; rows of equal turn are
ordered by role, then text, and repeated rows are turns of their own; a NULL
conv_id is one conversation; a conversation that breaks the turn order
is formatted all the same, with ``valid`` false; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathwise.llm.common import id_text, ids_back, table
from pathwise.llm.registry import register


@dataclass(frozen=True)
class Template:
    """How turns are written.

    ``open`` and ``close`` map a role to its marks (``*`` for any other role, whose
    name is written inside the mark); ``loss`` names the roles whose text is trained on.
    ``escape`` is put before every ``escape`` and before the first character of
    every mark, so no mark can occur inside an escaped text.
    """

    open: dict = field(default_factory=lambda: {"system": "<<SYS>>", "user": "[INST]", "assistant": "[ANS]",
                                                "*": "[ROLE]"})
    close: dict = field(default_factory=lambda: {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>",
                                                 "*": "[/ROLE]"})
    role_end: str = "[:]"
    loss: frozenset = frozenset({"assistant"})
    escape: str = "\\"

    def marks(self) -> list[str]:
        return sorted({*self.open.values(), *self.close.values(), self.role_end}, key=len, reverse=True)

    def special(self) -> str:
        """Characters that are escaped wherever they stand in a text."""
        return "".join(sorted({self.escape, *(m[0] for m in self.marks())}))


#: Allowed next roles by state; the state is the previous role.
TRANSITIONS = {
    "start": {"system", "user"},
    "system": {"user"},
    "user": {"assistant"},
    "assistant": {"user"},
}
FINAL = {"assistant"}


def next_state(state: str | None, role: str, transitions=TRANSITIONS) -> str | None:
    """The state after ``role``; None once the order is broken."""
    return role if state is not None and role in transitions.get(state, ()) else None


def segments(role: str, text: str, template: Template) -> list[tuple[str, bool]]:
    """A turn as ``(text, counts for the loss)`` segments, in order."""
    special = re.compile("[" + re.escape(template.special()) + "]")

    def escaped(s: str) -> str:
        return special.sub(lambda m: template.escape + m[0], s)

    known = role in template.open and role != "*"
    head = template.open[role] if known else template.open["*"] + escaped(role) + template.role_end
    tail = template.close[role] if known else template.close["*"]
    return [(head, False), (escaped(text), role in template.loss), (tail, False)]


class Reader:
    """Parses formatted text back into turns; text arrives in pieces that end at a turn's end."""

    def __init__(self, template: Template):
        self.template = template
        self.role_of = {v: k for k, v in template.open.items()}
        esc = re.escape(template.escape)
        plain = "[^" + re.escape(template.special()) + "]+"
        self.tokens = re.compile("(?P<mark>" + "|".join(map(re.escape, template.marks())) + f")|{esc}(?P<esc>.)|(?P<plain>{plain})",
                                 re.DOTALL)

    def read(self, formatted: str) -> list[tuple[str, str]]:
        turns, at, role, parts, naming = [], 0, None, [], False
        while at < len(formatted):
            m = self.tokens.match(formatted, at)
            if m is None:
                raise ValueError(f"stray control character at {at}")
            at, mark = m.end(), m["mark"]
            if mark is None:
                parts.append(m["plain"] if m["plain"] is not None else m["esc"])
            elif role is None and mark in self.role_of:
                role, naming, parts = self.role_of[mark], self.role_of[mark] == "*", []
            elif naming and mark == self.template.role_end:
                role, naming, parts = ("*", "".join(parts)), False, []
            elif role is not None and not naming and mark == self.template.close["*" if isinstance(role, tuple) else role]:
                turns.append((role[1] if isinstance(role, tuple) else role, "".join(parts)))
                role, parts = None, []
            else:
                raise ValueError(f"mark {mark!r} out of place at {at}")
        if role is not None:
            raise ValueError("a turn does not end")
        return turns


def _ordered(convs: DataFrame) -> DataFrame:
    """Rows of a conversation in one partition, by turn."""
    rows = convs.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select(id_text("conv_id"), "role", "text")


def format_segments(convs: DataFrame, template: Template = Template()) -> DataFrame:
    """``conv_id, seq, turn_no, segment, loss``: the training text as flagged segments in order."""

    def run(frames):
        current, turn_no, seq = object(), 0, 0
        for frame in frames:
            out = []
            for conv, role, text in zip(frame["conv_id"], frame["role"], frame["text"]):
                if conv != current:
                    current, turn_no, seq = conv, 0, 0
                for piece, loss in segments(role, text, template):
                    out.append((conv, seq, turn_no, piece, loss))
                    seq += 1
                turn_no += 1
            yield pd.DataFrame(out, columns=["conv_id", "seq", "turn_no", "segment", "loss"])

    return ids_back(_ordered(convs).mapInPandas(run, "conv_id string, seq long, turn_no long, segment string, loss boolean"),
                    "conv_id")


def format_digests(convs: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, read back from its formatted segments.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid``.
    """

    def run(frames):
        reader = Reader(template)
        state = None

        def fresh(conv):
            return {"conv_id": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0,
                    "chars": 0, "fsm": "start"}

        def row(s):
            return (s["conv_id"], s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"],
                    s["fsm"] in FINAL)

        for frame in frames:
            done = []
            for conv, role, text in zip(frame["conv_id"], frame["role"], frame["text"]):
                if state is None or conv != state["conv_id"]:
                    if state is not None:
                        done.append(row(state))
                    state = fresh(conv)
                pieces = segments(role, text, template)
                formatted = "".join(p for p, _ in pieces)
                state["chars"] += len(formatted)
                for back_role, back_text in reader.read(formatted):
                    state["n"] += 1
                    state["turns"].update(f"{back_role}\n{back_text}\n".encode())
                    state["fsm"] = next_state(state["fsm"], back_role)
                for piece, loss in pieces:
                    if loss:
                        plain = re.sub(re.escape(template.escape) + "(.)", r"\1", piece, flags=re.DOTALL)
                        state["loss_chars"] += len(plain)
                        state["loss"].update(plain.encode())
            yield _digest_frame(done)
        if state is not None:
            yield _digest_frame([row(state)])

    return ids_back(_ordered(convs).mapInPandas(
        run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long, valid boolean"), "conv_id")


def _digest_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])


PROBE = "</s>[INST] ok [/INST]"

OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (
  SELECT *, lag(role) OVER w AS prev, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    length(text) + length(regexp_replace(text, '[^<\[\\]', '', 'g')) AS esc,
    length(role) + length(regexp_replace(role, '[^<\[\\]', '', 'g')) AS role_esc
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (
  SELECT *, esc + CASE role WHEN 'system' THEN 7 + 8 WHEN 'user' THEN 6 + 7 WHEN 'assistant' THEN 5 + 4
                   ELSE 6 + role_esc + 3 + 7 END AS chars,
    CASE WHEN i = 1 THEN role IN ('system', 'user') WHEN prev IN ('system', 'assistant') THEN role = 'user'
         WHEN prev = 'user' THEN role = 'assistant' ELSE FALSE END AND (i < n OR role = 'assistant') AS fine
  FROM o)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_and(fine) AS valid
FROM s GROUP BY conv_id
"""


@register("op10_chat_format", OP10_SQL)
def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    """Operator 10 over all conversations and one probe conversation (-1)."""
    convs = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                                                         "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)],
                                  "conv_id long, turn long, role string, text string")
    return format_digests(convs.unionByName(probe))
