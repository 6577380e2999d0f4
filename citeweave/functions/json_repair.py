"""Repair of JSON objects that a model cut off or wrote carelessly: a stack automaton over the characters."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CLOSERS = {"{": "}", "[": "]"}
#: Words that stand for a value, in the order in which a cut one is completed.
LITERALS = ("true", "false", "null")
SPACE = " \t\n\r"


def _settled(out: list[str]) -> None:
    """Make what has been written so far a whole value or member: no comma at the end, no open number or word, no key alone."""
    while out and out[-1] in SPACE:
        out.pop()
    if out and out[-1] == ",":
        out.pop()
        return
    tail = ""
    while out and (out[-1].isalnum() or out[-1] in "+-."):
        tail = out.pop() + tail
    if tail:
        whole = next((w for w in LITERALS if tail.isalpha() and w.startswith(tail)), None)
        if whole is None:
            whole = tail.rstrip("eE+-.") or "null"
        out.extend(whole)
    elif out and out[-1] == ":":
        out.extend(" null")


def repair(text: str | None) -> str | None:
    """The first object in ``text``, closed and mended; null if there is none or no valid one comes out.

    Open strings, arrays and objects are closed in order, trailing commas go, a key
    without value gets ``null``, single quotes become double ones.
    """
    start = (text or "").find("{")
    if start < 0:
        return None
    out: list[str] = []
    stack: list[str] = []
    quote = None
    colon = False  # whether the member being written has its colon
    at = start
    while at < len(text):
        c = text[at]
        if quote:
            if c == "\\" and at + 1 < len(text):
                out.append("'" if text[at + 1] == "'" else c + text[at + 1])
                at += 2
                continue
            if c == "\\":
                break
            if c == quote:
                quote = None
                out.append('"')
            else:
                out.append('\\"' if c == '"' else "\\n" if c == "\n" else c)
        elif c in "\"'":
            quote = c
            out.append('"')
        elif c in CLOSERS:
            stack.append(c)
            colon = False
            out.append(c)
        elif c in "}]":
            if not stack or CLOSERS[stack[-1]] != c:
                return None
            _settled(out)
            stack.pop()
            out.append(c)
            if not stack:
                break
            colon = stack[-1] == "{"
        else:
            colon = True if c == ":" else False if c == "," else colon
            out.append(c)
        at += 1
    if quote:
        out.append('"')
    while stack:
        if stack[-1] == "{" and not colon and out[-1] == '"':
            out.extend(": null")
        else:
            _settled(out)
        out.append(CLOSERS[stack.pop()])
        colon = True
    made = "".join(out)
    try:
        return made if isinstance(json.loads(made), dict) else None
    except ValueError:
        return None


@F.pandas_udf(StringType())
def repaired_object(text: pd.Series) -> pd.Series:
    """``repair`` for a column (a stack over characters has no counterpart among Spark's functions)."""
    return text.map(repair)
