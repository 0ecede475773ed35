"""The evidence-gathering loop: a tool-calling model over the record selector.

The model is any callable from messages to a reply; nothing here opens a
connection.  A reply is ``{"content": str, "calls": [{"id", "arguments"}]}``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators.search import record_selector

MAX_ROUNDS = 30
_ARGUMENTS = ("source_path", "start_ts", "end_ts", "exact_pattern", "similarity_pattern", "limit")

Model = Callable[[list[dict]], dict]


@dataclass
class Conversation:
    """Messages of one incident and the chunks it has retrieved."""

    system: str
    question: str
    messages: list[dict] = field(default_factory=list)
    retrieved: list[tuple[int, str, int]] = field(default_factory=list)
    summary: str = ""

    def composed(self) -> list[dict]:
        """What the model is sent: the summary stands for the rounds before it."""
        head = [{"role": "system", "content": self.system}, {"role": "user", "content": self.question}]
        if self.summary:
            head.append({"role": "assistant", "content": self.summary})
        return head + self.messages


def call_selector(chunks: DataFrame, arguments: str | dict) -> list[dict]:
    """One tool call: rows as dictionaries, or one entry with the error."""
    try:
        wanted = json.loads(arguments) if isinstance(arguments, str) else dict(arguments)
        known = {k: v for k, v in wanted.items() if k in _ARGUMENTS and v not in (None, "")}
        found = record_selector(chunks, **known)
    except (ValueError, TypeError) as error:
        return [{"error": str(error)}]
    time = F.date_format("time_start", "yyyy-MM-dd'T'HH:mm:ss")
    return [row.asDict() for row in found.select("source_path", "chunk_id", time.alias("time_start"), "content_text").collect()]  # at most 12 rows


def gather(model: Model, chunks: DataFrame, system: str, question: str, rounds: int = MAX_ROUNDS, summarise: Model | None = None, keep: int = 8) -> tuple[str, Conversation]:
    """Ask until the model answers without a call or the rounds are over, then ask for a final answer.

    With ``summarise`` the messages of old rounds are replaced by its summary
    once there are more than ``keep``.
    """
    talk = Conversation(system, question)
    for round_no in range(rounds):
        reply = model(talk.composed())
        talk.messages.append({"role": "assistant", "content": reply.get("content", ""), **({"calls": reply["calls"]} if reply.get("calls") else {})})
        if not reply.get("calls"):
            return reply.get("content", ""), talk
        for call in reply["calls"]:
            rows = call_selector(chunks, call["arguments"])
            talk.retrieved += [(round_no, r["source_path"], r["chunk_id"]) for r in rows if "chunk_id" in r]
            talk.messages.append({"role": "tool", "id": call.get("id"), "content": json.dumps(rows)})
        if summarise and len(talk.messages) > keep:
            talk.summary = summarise(talk.composed())["content"]
            talk.messages.clear()
    talk.messages.append({"role": "user", "content": "Give the final answer now, without further calls."})
    final = model(talk.composed())
    return final.get("content", ""), talk
