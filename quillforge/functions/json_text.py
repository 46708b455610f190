"""JSON out of a model's prose, in Arrow batches; only this recovery is Python, parsing is VARIANT."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from ..batches import bound_active

_FENCE = re.compile(r"```(?:json)?\s*([{\[])")
_FENCE_ENDS = {"{": re.compile(r"\}\s*```"), "[": re.compile(r"\]\s*```")}
_SIGN = re.compile(r'["{}\[\]]')
_CLOSES = {"}": "{", "]": "["}
_STRAY_COMMA = re.compile(r",(?=\s*[\]}])")


def fenced(text: str) -> str | None:
    """What the first fenced block holds that begins with a bracket and ends with one of its kind before a fence."""
    for m in _FENCE.finditer(text):
        if end := _FENCE_ENDS[m[1]].search(text, m.end()):
            return text[m.start(1) : end.start() + 1]
        if not any(e.search(text, m.end()) for e in _FENCE_ENDS.values()):
            return None
    return None


def balanced(text: str) -> str | None:
    """The first bracketed span whose brackets match, strings skipped.

    An opener whose span breaks off is given up, and the next opener after it is tried, be it inside of what
    the one before took for a string. All openers are decided in one pass from the end: ``reach[i]`` is the
    place of the bracket that ends the level which is read from sign i on, outside of strings.
    """
    signs = [(m.start(), m.group()) for m in _SIGN.finditer(text)]
    n = len(signs)
    nothing = -1
    after = [n] * (n + 1)  # the sign after a string that opens at a quote
    closing = n  # the next quote that can close a string
    reach = [nothing] * (n + 1)
    whole = [nothing] * n  # the sign that closes an opener's span
    for i in range(n - 1, -1, -1):
        at, sign = signs[i]
        if sign == '"':
            after[i] = closing + 1 if closing < n else n
            reach[i] = reach[after[i]]
            back = at
            while back and text[back - 1] == "\\":
                back -= 1
            if (at - back) % 2 == 0:
                closing = i
        elif sign in _CLOSES:
            reach[i] = i
        else:
            end = reach[i + 1]
            if end != nothing and _CLOSES[signs[end][1]] == sign:
                whole[i], reach[i] = end, reach[end + 1]
    for i, end in enumerate(whole):
        if end != nothing:
            return text[signs[i][0] : signs[end][0] + 1]
    return None


def extract(text: str | None) -> str | None:
    """JSON text from a reply: a fenced block, else the first balanced span, else all of it.

    One repair is tried: commas before a closing bracket. Null where nothing parses.
    """
    if text is None:
        return None
    bare = text.strip()
    found = fenced(bare) or balanced(bare) or bare
    for candidate in (found, _STRAY_COMMA.sub("", found)):
        try:
            json.loads(candidate)
        except (ValueError, RecursionError):  # brackets nested beyond what the parser takes
            continue
        return candidate
    return None


def to_prompt_json(criteria) -> str:
    """A rubric as one JSON array with Python's separators, other letters than ASCII as they are."""
    return json.dumps([{"criterion": c["criterion"], "weight": int(c["weight"]), "category": c["category"]} for c in criteria], ensure_ascii=False)


def extract_json(text: Column) -> Column:
    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(extract, na_action="ignore")

    bound_active()
    return run(text)


def prompt_json(criteria: Column) -> Column:
    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(to_prompt_json, na_action="ignore")

    bound_active()
    return run(criteria)


def fill_template(template: str, names: list[str], *values: Column) -> Column:
    """``$name`` in a template replaced; unknown names stay, and values aren't looked at again."""

    @pandas_udf("string")
    def run(*columns: pd.Series) -> pd.Series:
        from string import Template

        t = Template(template)
        rows = zip(*[c.fillna("") for c in columns], strict=True)
        return pd.Series([t.safe_substitute(dict(zip(names, row, strict=True))) for row in rows])

    bound_active()
    return run(*values)
