"""Abbreviations that papers define for themselves: found in Arrow batches, agreed on and applied in DataFrame operations."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import vocabulary as V

# What stands in brackets as an abbreviation, and what only looks like one.
CANDIDATE = re.compile(r"\(([A-Za-z][A-Za-z0-9\-/]{1,9})s?\)")
NOT_ONE = re.compile(r"(?i)^(?:fig|figs|table|ref|refs|see|e\.?g|i\.?e|vs|et\s*al|n|p|sd|sem|ci|df|min|max|hr|hrs|sec|mm|cm|um|nm|ml|mg|kg|mol|mM|uM|nM)$")
#: Characters before the bracket in which the long form stands, and lengths of it and of a word in it (fixed values).
LOOK_BACK, LONG_FORM, LONGEST_WORD, MOST = 160, (3, 90), 25, 200
_WORD, _SENTENCE = re.compile(r"[A-Za-z0-9\-]+"), re.compile(r"[.!?] |[\n;]")


def spells(words: list[str], letters: str) -> bool:
    """Whether the letters stand in the words in order, the first of them at the beginning of a word."""
    text = " ".join(words).lower()
    if letters[0] not in {w[0] for w in re.split("[^a-z0-9]+", text) if w}:
        return False
    rest = iter(text)
    return all(letter in rest for letter in letters)


def defined(text: str | None, most: int = MOST) -> dict[str, str]:
    """Abbreviations of a text with their long forms: the fewest words before the bracket, within its sentence, that spell it."""
    found: dict[str, str] = {}
    for match in CANDIDATE.finditer(text or ""):
        short = match[1]
        if len(short) > 2 and short[-1] == "s" and short[-2] != "s":
            short = short[:-1]
        letters = "".join(c for c in short.lower() if c.isalnum())
        if NOT_ONE.match(short) or short == short.lower():
            continue
        before = text[max(0, match.start() - LOOK_BACK) : match.start()]
        sentence = _SENTENCE.split(before)[-1]
        words = _WORD.findall(sentence)[-min(len(letters) + 5, 2 * len(letters)) :]
        fits = next((words[i:] for i in range(len(words) - 1, -1, -1) if spells(words[i:], letters)), None)
        if fits is None or fits[0][0].lower() != letters[0] or max(map(len, fits)) > LONGEST_WORD:
            continue
        if LONG_FORM[0] <= len(" ".join(fits)) <= LONG_FORM[1]:
            found.setdefault(short, " ".join(fits))
        if len(found) >= most:
            break
    return found


def harvest(papers: DataFrame, key: str) -> DataFrame:
    """(key, abbrev, long_form): what each paper of ``papers`` (key, text) defines."""

    def batch(texts: pd.Series) -> pd.Series:
        return pd.Series([list(defined(t).items()) for t in texts])

    read = F.pandas_udf(batch, "array<struct<abbrev:string,long_form:string>>")
    return papers.select(key, F.explode(read("text")).alias("d")).select(key, "d.*")


def agreed(definitions: DataFrame, key: str) -> DataFrame:
    """(abbrev, long_form, n_forms, n_papers): the long form that all papers agree on, or null where they don't."""
    tidy = definitions.select(key, F.trim("abbrev").alias("abbrev"), F.lower(F.trim("long_form")).alias("form")).where("abbrev <> '' AND form <> ''")
    counted = tidy.groupBy("abbrev").agg(F.countDistinct("form").alias("n_forms"), F.countDistinct(key).alias("n_papers"), F.min("form").alias("form"))
    return counted.select("abbrev", F.when(F.col("n_forms") == 1, F.col("form")).alias("long_form"), "n_forms", "n_papers")


def about(definitions: DataFrame, terms: DataFrame, least: int = 1) -> DataFrame:
    """``definitions`` (abbrev, long_form) whose long form shares ``least`` words or more with ``terms`` (term), by words that begin alike."""
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) > 3)
    known = terms.select(F.explode(words(F.col("term"))).alias("w"))
    begins = known.select(F.explode(F.array("w", V.stem(F.col("w")))).alias("w")).where(F.length("w") > 3).distinct()
    # A word begins with a known one if their first four letters agree, so these are the key.
    mine = definitions.select("abbrev", "long_form", F.explode(F.array_distinct(words(F.col("long_form")))).alias("own"))
    met = mine.withColumn("k", F.substring("own", 1, 4)).join(begins.withColumn("k", F.substring("w", 1, 4)), "k").where(F.col("own").startswith(F.col("w")))
    shared = met.groupBy("abbrev", "long_form").agg(F.countDistinct("own").alias("n_shared"))
    return shared.where(F.col("n_shared") >= least)


def expanded(text: Column, table: Column) -> Column:
    """Text with the abbreviations of ``table`` (array of structs abbrev, long_form) written out, the longest first; their plurals too."""

    def batch(texts: pd.Series, tables: pd.Series) -> pd.Series:
        out = []
        for t, pairs in zip(texts, tables, strict=True):
            for p in sorted(pairs if pairs is not None else [], key=lambda p: (-len(p["abbrev"]), p["abbrev"])):
                if p["abbrev"].strip() and (p["long_form"] or "").strip():
                    t = re.sub(rf"(?i)\b{re.escape(p['abbrev'].strip())}s?\b", lambda _, p=p: p["long_form"].strip().lower(), t or "")
            out.append(t)
        return pd.Series(out)

    return F.pandas_udf(batch, "string")(text, table)
