"""JSON in free-form model output."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veilframe.functions.text import inference_part

_CLOSING = {"{": "}", "[": "]"}


def _unfenced(text: str) -> str:
    text = text.strip()
    if text.startswith("```") and text.endswith("```"):
        lines = text.split("\n")
        if len(lines) >= 3:
            text = "\n".join(lines[1:-1])
    return text


def _balance_points(text: str) -> dict[int, int]:
    """For each opening bracket, where counting its kind alone comes back to zero."""
    ends: dict[int, int] = {}
    open_at: dict[str, list[int]] = {"}": [], "]": []}
    for i, c in enumerate(text):
        if c in _CLOSING:
            open_at[_CLOSING[c]].append(i)
        elif c in open_at and open_at[c]:
            ends[open_at[c].pop()] = i
    return ends


def _string_aware_end(text: str, start: int) -> int | None:
    try:
        return json.JSONDecoder().raw_decode(text, start)[1] - 1
    except ValueError:
        return None


def first_json(text: str | None, string_aware: bool = False):
    """The first object or list in the text, or None.

    Candidates begin at each opening bracket, left to right. By default a candidate ends where its
    own kind of bracket balances, strings not being looked into, so one that fails may give way to
    a candidate inside it; string_aware reads candidates as JSON proper.
    """
    if not text:
        return None
    text = _unfenced(text)
    ends = {} if string_aware else _balance_points(text)
    for i, c in enumerate(text):
        if c in _CLOSING:
            end = _string_aware_end(text, i) if string_aware else ends.get(i)
            if end is not None:
                try:
                    return json.loads(text[i : end + 1])
                except ValueError:
                    continue
    return None


def _dumped(value) -> str | None:
    return None if value is None else json.dumps(value, ensure_ascii=False)


@F.pandas_udf(StringType())
def first_json_text(texts: pd.Series) -> pd.Series:
    """first_json as compact JSON text."""
    return texts.map(lambda t: _dumped(first_json(t)))


NO_GUESS = '{"error": "no JSON object found"}'


def guess_json(response: Column) -> Column:
    """The guessed object anywhere in a response as JSON text, or an object with the key error."""
    found = first_json_text(response)
    return F.when(found.startswith("{"), found).otherwise(F.lit(NO_GUESS))


def attack(response: Column) -> Column:
    """A response as STRUCT<inference, guess_json>."""
    return F.struct(inference_part(response).alias("inference"), guess_json(response).alias("guess_json"))
