"""Quality classifier: a generalised additive model with pairwise interactions.

Training is cyclic boosting: feature after feature, a shallow tree is fitted to the gradients of the log loss
as they sum up in the feature's bins, and added, shrunken, to the feature's lookup table; then the same
over cells of the feature pairs that gain most.  A model is lookup tables and nothing else, and a score is the
sum of the entries that a text's bins select, through the logistic function.

Training reads a bounded sample of the labelled rows (``SAMPLE``, those with the smallest hash of the id);
scoring reads every text whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows to learn from at most, bins of a feature, bins of it in a pair, and pairs.
SAMPLE, BINS, PAIR_BINS, PAIRS = 20_000, 48, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, DEPTH, SMOOTH = 150, 60, 0.12, 3, 5.0
#: Scores from here on count as good.
GOOD = 0.7
FEATURES = (
    "bytes", "words", "lines", "word_bytes", "longest_word", "upper", "digit", "symbol", "punctuation", "blank", "other_bytes",
    "distinct_words", "distinct_pairs", "top_word", "distinct_lines", "short_lines", "symbol_words", "shouted_words", "pipes", "byte_entropy")

_KIND = np.zeros(256, np.int64)
_KIND[[*range(65, 91)]], _KIND[[*range(97, 123)]], _KIND[[*range(48, 58)]] = 1, 2, 3
_KIND[[9, 10, 11, 12, 13, 32]], _KIND[128:] = 4, 5
_KIND[list(b".,;:'\"-()")] = 6
_KIND[[c for c in range(33, 127) if _KIND[c] == 0]] = 7


def features(text: bytes) -> list[float]:
    """What the model knows of a text (UTF-8), in the order of FEATURES."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digit, blank, other, point, symbol = np.bincount(_KIND, weights=histogram, minlength=8)[1:8]
    words = text.split()
    w = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    share = histogram[histogram > 0] / n
    ends = sum(1 for x in words if _KIND[x[-1]] == 7)
    shouted = text.upper() == text and upper > 0
    return [
        float(n), float(len(words)), float(k), (n - blank) / w, float(max(map(len, words), default=0)), upper / max(1.0, upper + lower), digit / n, symbol / n, point / n,
        blank / n, other / n, len(set(words)) / w, len(set(zip(words, words[1:], strict=False))) / max(1, w - 1), max(Counter(words).values(), default=0) / w,
        len(set(lines)) / k, sum(1 for x in lines if len(x) < 20) / k, ends / w, float(shouted), histogram[124] / w, float(-(share * np.log2(share)).sum())]


def feature_matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([features(t or b"") for t in texts], np.float64).reshape(len(texts), len(FEATURES))


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int) -> np.ndarray:
    """A tree over ordered bins as its value in each bin."""
    out = np.full(len(grad), grad.sum() / (hess.sum() + SMOOTH))
    if depth == 0 or len(grad) < 2:
        return out
    g, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
    gain = g**2 / (h + SMOOTH) + (grad.sum() - g) ** 2 / (hess.sum() - h + SMOOTH)
    gain[(h < 1) | (hess.sum() - h < 1)] = -1
    at = int(gain.argmax())
    if gain[at] <= grad.sum() ** 2 / (hess.sum() + SMOOTH) + 1e-9:
        return out
    return np.concatenate([_tree(grad[: at + 1], hess[: at + 1], depth - 1), _tree(grad[at + 1 :], hess[at + 1 :], depth - 1)])


@dataclass
class Additive:
    """Lookup tables per feature and pair."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    base: float

    def scores(self, matrix: np.ndarray) -> np.ndarray:
        """Between 0 and 1 for each row."""
        total = np.full(len(matrix), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, matrix[:, j], side="right")]
        coarse = [np.searchsorted(e, matrix[:, j], side="right") for j, e in enumerate(self.pair_edges)]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.empty(0)


def train(matrix: np.ndarray, label: np.ndarray) -> Additive:
    """Cyclic boosting; without rows of both labels the model is a constant."""
    width = matrix.shape[1]
    edges, pair_edges = ([_edges(matrix[:, j], n) for j in range(width)] for n in (BINS, PAIR_BINS))
    rate = (label.sum() + 1) / (len(label) + 2)
    model = Additive(edges, [np.zeros(len(e) + 1) for e in edges], pair_edges, [], [], float(np.log(rate / (1 - rate))))
    if not 0 < label.sum() < len(label):
        return model
    fine = [np.searchsorted(e, matrix[:, j], side="right") for j, e in enumerate(edges)]
    coarse = [np.searchsorted(e, matrix[:, j], side="right") for j, e in enumerate(pair_edges)]
    total = np.full(len(label), model.base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return label - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(width):
            g, h = slope()
            size = len(edges[j]) + 1
            step = RATE * _tree(np.bincount(fine[j], g, size), np.bincount(fine[j], h, size), DEPTH)
            model.tables[j] += step
            total += step[fine[j]]

    def cells(a: int, b: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = len(pair_edges[a]) + 1, len(pair_edges[b]) + 1
        return coarse[a] * shape[1] + coarse[b], shape

    g, h = slope()
    gain = {}
    for a, b in combinations(range(width), 2):
        at, shape = cells(a, b)
        gain[a, b] = (np.bincount(at, g, shape[0] * shape[1]) ** 2 / (np.bincount(at, h, shape[0] * shape[1]) + SMOOTH)).sum()
    model.pairs = sorted(gain, key=gain.get)[::-1][:PAIRS]
    model.pair_tables = [np.zeros(cells(a, b)[1]) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            g, h = slope()
            at, shape = cells(a, b)
            gs, hs = np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)
            # A tree over the first feature, and one over the second in either half of the first.
            rows = _tree(gs.sum(axis=1), hs.sum(axis=1), 1)
            step = np.zeros(shape)
            for value in np.unique(rows):
                own = rows == value
                step[own] = RATE * _tree(gs[own].sum(axis=0), hs[own].sum(axis=0), 1)
            model.pair_tables[k] += step
            total += step[coarse[a], coarse[b]]
    return model


def bucket(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Additive:
    """Learn ``labels.quality`` from at most ``sample`` rows that aren't held out.

    Of contradicting labels for one id the lower counts; null ids and labels are passed over.
    """
    chosen = labels.where((bucket("doc_id", 4) != 2) & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` ids
    # Ids may repeat without bound; of the rows of one id that with the least features counts, so ``sample`` rows reach the driver at most.

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = feature_matrix(batch["text"].to_pylist())
            lists = pa.FixedSizeListArray.from_arrays(pa.array(matrix.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"], lists], names=["doc_id", "quality", "features"])

    measured = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "text").mapInArrow(measure, "doc_id bigint, quality int, features array<double>")
    found = measured.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("features").alias("features")).toArrow()
    matrix = np.array(found["features"].to_pylist(), np.float64).reshape(found.num_rows, len(FEATURES))
    order = np.lexsort((*matrix.T, found["doc_id"].to_numpy()))  # the order in which rows come must not count
    return train(matrix[order], found["quality"].to_numpy().astype(np.float64)[order])


def score_quality(docs: DataFrame, model: Additive, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null texts count as empty ones, which get a score too.  Repeated rows each get their row, an empty
    table gives an empty result, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shared.value.scores(feature_matrix(batch["text"].to_pylist()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(got), pa.array((got >= GOOD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (bucket(id_col, 4) == 2).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(score, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Additive, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score counts as good, with all their columns and no others.

    Null texts are scored as empty ones; repeated rows stay or go together; an empty table gives an empty result.
    Texts are measured as bytes, so those that aren't valid UTF-8 have a score as well.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(feature_matrix(texts.tolist())), dtype=np.float64)

    return docs.where(score(F.col(text_col).cast("binary")) >= GOOD)
