"""Structured payloads in texts and replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafscan.functions import text as X

STRING = r'"(?:[^"\\]|\\.)*+"'  # a JSON string; possessive, so long texts do not recurse
TOKEN = rf'(?s){STRING}|[{{}}]|[^"{{}}]++|"'
FENCE = r"(?s)^```(?:json)?\s*(.*?)\s*(?:```)?$"


def backtick_value(text: Column, label: str) -> Column:
    """Value in back ticks after a label."""
    return X.strip(F.regexp_extract(text, rf"{label}:[{X.WS}]*`([^`]*)`", 1))


def json_block(text: Column, heading: str) -> Column:
    """Fenced JSON under a heading (empty if absent)."""
    return F.regexp_extract(text, rf"(?s){heading}[{X.WS}]*```json[{X.WS}]*(.*?)[{X.WS}]*```", 1)


def first_object(text: Column) -> Column:
    """The first whole JSON object of a text, NULL without one.

    Braces are counted outside of strings: tokens are strings, braces and what
    lies between, and the object ends where the running depth falls back to
    zero. Words before and after it, with braces of their own, do no harm.
    """
    from_brace = F.regexp_extract(text, r"(?s)\{.*", 0)

    def cut(tokens: Column) -> Column:
        steps = F.transform(tokens, lambda t: F.when(t == "{", 1).when(t == "}", -1).otherwise(0).cast("long"))

        def end(depth: Column) -> Column:
            return F.array_position(F.transform(depth, lambda d, i: (d == 0) & (F.get(tokens, i) == "}")), True).cast("int")

        return X.let(X.running_sums(steps), lambda depth: X.let(end(depth), lambda n: F.when(n > 0, F.array_join(F.slice(tokens, 1, n), ""))))

    return F.when(from_brace != "", X.let(F.regexp_extract_all(from_brace, F.lit(TOKEN), F.lit(0)), cut))


def json_object(reply: Column) -> Column:
    """The JSON object of a model's reply: inside a fence if it begins with one, else the first in the text."""
    text = X.strip(F.coalesce(reply, F.lit("")))
    inner = F.when(text.startswith("```"), F.regexp_extract(text, FENCE, 1)).otherwise(text)
    return first_object(inner)
