"""Text expressions. White space means what Python's ``str.split`` and ``str.strip`` mean by it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's \s knows ASCII only; this is the whole class.
SPACE = r"[\t-\r\x1c-\x1f \x85\xa0  -     　]"


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    """Null counts as blank. One other character decides; nothing is rewritten."""
    return ~F.coalesce(text.rlike(f"[^{SPACE[1:-1]}]"), F.lit(False))


def dedupe_key(text: Column) -> Column:
    """Lower case with white space collapsed: two questions with one key are the same question."""
    return collapse(F.lower(text))


def snippet(text: Column, limit: int = 300) -> Column:
    """Collapsed and at most ``limit`` long; a cut text ends in three dots."""
    # Enough of the text for ``limit`` characters is collapsed; runs of white space may make that all of it.
    head = F.regexp_extract(text, rf"\A{SPACE}*+(?:[^{SPACE[1:-1]}]{SPACE}*+){{0,{limit + 1}}}+", 0)
    flat = collapse(head)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 3), F.lit("...")))


def clip(text: Column, limit: int) -> Column:
    """Stripped; what is cut off is counted in a suffix."""
    whole = strip(text)
    rest = (F.length(whole) - limit).cast("string")
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.substring(whole, 1, limit), F.lit(" [... "), rest, F.lit(" more chars]")))


def split_thinking(text: Column, opened: Column | bool = False) -> Column:
    """struct(answer, finished): what follows the last ``</think>``.

    Without that mark, a text that starts with ``<think>``, or whose prompt opened the thinking, has
    no answer and isn't finished; any other text is its own answer.
    """
    opened = F.lit(opened) if isinstance(opened, bool) else opened
    closed, bare = text.contains("</think>"), strip(text)
    answer = F.when(closed, strip(F.substring_index(text, "</think>", -1))).when(opened | bare.startswith("<think>"), "").otherwise(bare)
    return F.struct(answer.alias("answer"), (closed | ~(opened | bare.startswith("<think>"))).alias("finished"))


def answer_text(completion: Column, thinking: Column | bool) -> Column:
    """The answer of a training completion; empty where its thinking never ended.

    Unlike ``split_thinking``, an opening mark anywhere counts as thinking.
    """
    thinking = F.lit(thinking) if isinstance(thinking, bool) else thinking
    last = strip(F.substring_index(completion, "</think>", -1))
    return F.when(completion.contains("</think>"), last).when(thinking | completion.contains("<think>"), "").otherwise(strip(completion))


def chat_answer_text(messages: Column, thinking: Column | bool) -> Column:
    """The answer of a chat completion (array of role and content): that of its last message.

    A message that a parser has split already has no marks left, so it is taken whole unless one is.
    """
    content = F.coalesce(F.element_at(messages, -1)["content"], F.lit(""))
    marked = content.contains("<think>") | content.contains("</think>")
    return F.when(marked, answer_text(content, thinking)).otherwise(strip(content))


def sha12(text: Column) -> Column:
    """The first twelve hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 12)


def listing_id(url: Column) -> Column:
    """What follows the last ``/abs/``."""
    return F.substring_index(url, "/abs/", -1)


def file_id(listing: Column) -> Column:
    """A listing id without its version, usable as a file name."""
    return F.replace(F.regexp_replace(listing, "v[^v]*$", ""), F.lit("/"), F.lit("_"))


def markdown_title(text: Column, fallback: Column) -> Column:
    """The first level-one heading, or the fallback. A heading without words isn't one."""
    blank = r"[^\S\r\n]*"
    found = strip(F.regexp_extract(text, rf"(?mU)^{blank}# {blank}(\S[^\r\n]*)$", 1))
    return F.coalesce(F.nullif(found, F.lit("")), fallback)


# What an error message says when a prompt is too long for a model, and how a gateway quotes the status behind its own.
CONTEXT_WORDS = r"context.length|maximum model length|prompt is too long|too many tokens|context_length_exceeded|input is too long"
UPSTREAM = r"upstream error ([0-9]{3})"


def error_class(status: Column, message: Column) -> Column:
    """``context_length``, ``auth``, ``transient`` or ``other`` from an HTTP status and an error message.

    A gateway's 5xx that quotes the status behind it counts as that one. 408, 409, 429 and 5xx may pass; 413, and
    400 where the message says so, mean that the prompt is too long. Without a status (no connection, no
    readable reply) an error may pass too.
    """
    said = F.coalesce(message, F.lit(""))
    quoted = F.nullif(F.regexp_extract(said, UPSTREAM, 1), F.lit("")).cast("int")
    code = F.when(status >= 500, F.coalesce(quoted, status)).otherwise(status)
    return (
        F.when(code.isNull() | code.isin(408, 409, 429) | (code >= 500), "transient")
        .when((code == 413) | ((code == 400) & said.rlike(f"(?i){CONTEXT_WORDS}")), "context_length")
        .when(code.isin(401, 403), "auth")
        .otherwise("other")
    )


def classify(status: int | None, message: str | None) -> str:
    """The rule of ``error_class`` for one error, where it is raised."""
    said = message or ""
    quoted = re.search(UPSTREAM, said)
    code = int(quoted[1]) if status is not None and status >= 500 and quoted else status
    if code is None or code in (408, 409, 429) or code >= 500:
        return "transient"
    if code == 413 or code == 400 and re.search(CONTEXT_WORDS, said, re.IGNORECASE):
        return "context_length"
    return "auth" if code in (401, 403) else "other"
