"""Prompts and conversations as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: wording of the prompt
SYSTEM_LINE = "You are an expert legal-precedent selector."
MIDDLE_PLAIN = "You are given the following legal context:"
MIDDLE_JUDGES = "You are given the following legal context and the presiding judge(s):"
CLOSING_LINE = "Please respond with the corresponding special token."


@dataclass(frozen=True)
class ChatTemplate:
    """Markers put around the messages when a conversation becomes one string; a parameter, not a model's own."""

    header: str = "<|{role}|>\n"
    end: str = "<|end|>\n"
    answer_role: str = "assistant"


def prompt(payload: Column, enriched: bool = False, middle: str | None = None) -> Column:
    middle = middle or (MIDDLE_JUDGES if enriched else MIDDLE_PLAIN)
    return F.concat(F.lit(f"{SYSTEM_LINE}\n\n{middle}\n"), payload, F.lit(f"\n\n{CLOSING_LINE}"))


def conversation(user: Column, assistant: Column) -> Column:
    """Two messages: what the user asks and what the assistant should answer."""
    return F.array(
        F.struct(F.lit("user").alias("role"), user.alias("content")),
        F.struct(F.lit("assistant").alias("role"), assistant.alias("content")),
    )


def user_side(messages: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The messages without any answer, so an evaluation prompt cannot show the expected one."""
    return F.filter(messages, lambda m: m["role"] != template.answer_role)


def render_chat(messages: Column, template: ChatTemplate = ChatTemplate(), generation: bool = False) -> Column:
    """One string per conversation. ``generation`` renders the prompt for a model: no answers, and the answer
    header at the end."""
    before, after = template.header.split("{role}")

    def one(m: Column) -> Column:
        return F.concat(F.lit(before), m["role"], F.lit(after), F.coalesce(m["content"], F.lit("")), F.lit(template.end))

    shown = user_side(messages, template) if generation else messages
    text = F.array_join(F.transform(shown, one), "")
    return F.concat(text, F.lit(template.header.format(role=template.answer_role))) if generation else text
