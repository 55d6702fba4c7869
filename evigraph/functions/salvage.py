"""JSON out of replies that are fenced, preceded by prose, cut off, or broken in the middle.

A state machine over brackets and strings, which Spark has no function for; it runs in Arrow batches and only on
replies that don't parse as they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The key that marks a salvaged object as incomplete (fixed value).
MARK = "_truncated"
PAIRS = {"{": "}", "[": "]"}


class Reader:
    """Reads JSON text once and remembers where it may be cut, and what is open there."""

    def __init__(self, text: str) -> None:
        self.whole: list[tuple[int, str]] = []  # just past an object or array: place, what closes the rest
        self.any: list[tuple[int, str]] = []  # those, and places past a string and before a comma
        self.open, self.in_string = "", False
        skip = False
        for place, sign in enumerate(text):
            if self.in_string:
                if skip:
                    skip = False
                elif sign == "\\":
                    skip = True
                elif sign == '"':
                    self.in_string = False
                    self.any.append((place + 1, self.open))
            elif sign == '"':
                self.in_string = True
            elif sign in PAIRS:
                self.open = PAIRS[sign] + self.open
            elif sign in "}]":
                self.open = self.open[1:]
                self.whole.append((place + 1, self.open))
                self.any.append((place + 1, self.open))
            elif sign == ",":
                self.any.append((place, self.open))


def _closings(text: str, cuts: list[tuple[int, str]]) -> Iterator[str]:
    """The text up to each cut with what is open there closed, the longest first."""
    for place, rest in reversed(cuts):
        head = text[:place].rstrip().rstrip(",").rstrip()
        if head:
            yield head + rest


def _first_valid(candidates: Iterator[str]) -> object | None:
    for text in candidates:
        try:
            return json.loads(text)
        except ValueError:
            continue
    return None


def salvage(reply: str | None) -> tuple[str | None, str]:
    """The outermost value of a reply as JSON, and how it was come by: ``whole``, ``truncated``, ``malformed`` or ``none``.

    A reply that stops early is cut after its last complete value.  One that is broken inside a value is
    cut after the last complete object or array before the fault, as the record with the fault is only half read.
    """
    text = (reply or "").strip()
    if text.startswith("```"):
        text = text.strip("`")
        text = text[4:].strip() if text[:4].lower() == "json" else text
    begins = [p for p in (text.find("{"), text.find("[")) if p >= 0]
    if not begins:
        return None, "none"
    text = text[min(begins) :]
    end, fault = text.rfind(PAIRS[text[0]]), None
    if end > 0:
        try:
            return json.dumps(json.loads(text[: end + 1]), ensure_ascii=False), "whole"
        except json.JSONDecodeError as error:
            fault = error.pos
    seen = Reader(text)
    found, how = None, "truncated"
    if seen.open or seen.in_string:
        found = _first_valid(_closings(text, seen.any))
    if found is None and fault:
        read = text[:fault]
        found, how = _first_valid(_closings(read, Reader(read).whole)), "malformed"
    if found is None:
        return None, "none"
    if isinstance(found, dict):
        found[MARK] = True
    return json.dumps(found, ensure_ascii=False), how


def _batch(replies: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([salvage(r) for r in replies], columns=["value", "how"])


def salvaged(reply: Column) -> Column:
    """A struct (value, how) of a reply: see ``salvage``."""
    return F.pandas_udf(_batch, "value string, how string")(reply)


#: Keys under which replies put quotations, and the text of one (fixed values).
QUOTE_LISTS, QUOTE_TEXTS = ("supporting_quotes", "quotes", "evidence_quotes", "quote"), ("quote", "text", "sentence", "excerpt")


def quotations(value: Column) -> Column:
    """The quotations in JSON of any of the shapes that replies have: a string, a list of strings or objects, an object that holds these."""

    def read(value: object) -> list[str]:
        if isinstance(value, str):
            return [value]
        if isinstance(value, dict):
            key = next((k for k in QUOTE_LISTS if k in value), None)
            return read(value[key]) if key else []
        texts = []
        for item in value if isinstance(value, list) else ():
            if isinstance(item, dict):
                item = next((item[k] for k in QUOTE_TEXTS if isinstance(item.get(k), str)), None)
            if isinstance(item, str):
                texts.append(item)
        return texts

    def batch(values: pd.Series) -> pd.Series:
        found = []
        for text in values:
            try:
                found.append(read(json.loads(text)) if text else [])
            except ValueError:
                found.append([text])
        return pd.Series(found)

    return F.pandas_udf(batch, "array<string>")(value)
