"""Similarity of normal forms.  Spark has no Ratcliff-Obershelp ratio, so that part alone is computed in Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evigraph.functions.labels import token_key

#: Weights of the sequence ratio, the Jaccard index of words, and of one form holding the other (fixed values).
WEIGHTS = {"sequence": 0.45, "jaccard": 0.40, "containment": 0.15}


def _ratios(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, *pair, autojunk=False).ratio() for pair in zip(left, right, strict=True)], dtype="float64")


def sequence_ratio(left: Column | str, right: Column | str) -> Column:
    """How much of two texts matches in order, from 0 to 1."""
    return F.pandas_udf(_ratios, "double")(left, right)


def word_overlap(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    """The Jaccard index of the words of two texts, and 1 if one holds the other, else 0."""
    left, right = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    words = [F.filter(F.split(c, r"\s+"), lambda w: w != "") for c in (left, right)]
    return F.size(F.array_intersect(*words)) / F.size(F.array_union(*words)), F.when(F.contains(left, right) | F.contains(right, left), 1.0).otherwise(0.0)


def label_similarity(a: Column | str, b: Column | str) -> Column:
    """A blend of sequence ratio (as written or with words sorted, whichever is better), shared words and containment; 0 to 1."""
    left, right = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (a, b))
    ratio = F.greatest(sequence_ratio(left, right), sequence_ratio(token_key(left), token_key(right)))
    jaccard, held = word_overlap(left, right)
    blend = F.round(WEIGHTS["sequence"] * ratio + WEIGHTS["jaccard"] * jaccard + WEIGHTS["containment"] * held, 4)
    return F.when((left == "") | (right == ""), 0.0).when(left == right, 1.0).otherwise(blend)
