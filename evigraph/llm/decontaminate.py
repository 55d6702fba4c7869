"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: every block of documents holds, for each term of the benchmark, the
ascending positions at which it stands, documents being laid out one after another with gaps that no
match can span.  Terms that the benchmark doesn't use have no postings, as no query asks for them.
The counts of all blocks together say which terms of a phrase are rare; a phrase is looked up by taking the
postings of its rarest term, shifted by its offset, and intersecting them with those of the next rarest,
until few or none are left.  Proximity is found the same way with intervals in place of equal offsets.
No posting is ever shuffled: blocks answer all queries by themselves and give one row per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.workspace import Workspace

#: Words in a window, words by which proximate ones may be apart, positions between two documents.
WINDOW, SLOP, GAP = 10, 20, 64
#: Words of a block of the index, and bytes of benchmark text that are looked up at once.
BLOCK_WORDS, QUERY_BYTES = 2 << 20, 32 << 20
_WORD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
INDEX = "doc_ids array<bigint>, keys array<bigint>, n_words array<int>, starts array<int>, terms array<int>, offsets array<int>, positions array<int>"


def words(text: bytes) -> list[bytes]:
    """Letters and digits of ASCII and all other characters, A-Z in lower case; the rest separates words."""
    return text.translate(_WORD).split()


@dataclass
class Phrases:
    """Windows of benchmark items over a vocabulary of their own."""

    vocabulary: dict[bytes, int]
    windows: np.ndarray  # of terms in order, one window a row; shorter ones are filled up with the size of the vocabulary
    sizes: np.ndarray
    items: list[list[int]]  # that have each window

    @classmethod
    def of(cls, items: list[tuple[int, bytes]], window: int = WINDOW) -> Phrases:
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            terms = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
            size = min(window, len(terms))
            for i in range(len(terms) - size + 1 if size else 0):
                found.setdefault(tuple(terms[i : i + size]), set()).add(item)
        order = sorted(found)
        matrix = np.full((len(order), window), len(vocabulary), np.int32)
        for row, terms in zip(matrix, order, strict=True):
            row[: len(terms)] = terms
        return cls(vocabulary, matrix, np.array([len(w) for w in order], np.int32), [sorted(found[w]) for w in order])

    def rarest_first(self, often: np.ndarray) -> np.ndarray:
        """The places of each window's terms, the rarest of the corpus first and of equally rare ones the first."""
        counts = np.append(often, np.iinfo(np.int64).max)[self.windows]
        return np.argsort(counts, axis=1, kind="stable")


@dataclass
class Block:
    """Postings of some documents."""

    n_words: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    offsets: np.ndarray
    positions: np.ndarray

    @classmethod
    def build(cls, texts: list[bytes], vocabulary: dict[bytes, int]) -> Block:
        ids, counts = [], []
        for text in texts:
            own = words(text)
            ids.append(np.fromiter(map(vocabulary.get, own, repeat(-1)), np.int32, len(own)))
            counts.append(len(own))
        n_words = np.array(counts, np.int32)
        starts = (np.cumsum(n_words + GAP) - n_words - GAP).astype(np.int32)
        whole = np.concatenate(ids) if ids else np.empty(0, np.int32)
        place = np.arange(len(whole), dtype=np.int32) + np.repeat(np.arange(len(counts), dtype=np.int32) * GAP, n_words)
        known = np.flatnonzero(whole >= 0)
        order = known[np.argsort(whole[known], kind="stable")]
        terms, first = np.unique(whole[order], return_index=True)
        return cls(n_words, starts, terms.astype(np.int32), np.append(first, len(order)).astype(np.int32), place[order])

    def answer(self, phrases: Phrases, order: np.ndarray, slop: int = SLOP) -> tuple[np.ndarray, dict[int, set[int]], dict[int, set[int]]]:
        """Ranges of positions hit, and by document the items with exact and with proximate windows.

        Only windows of which the block has all terms are looked at; ``order`` is that of ``Phrases.rarest_first``.
        """
        at_term = np.full(len(phrases.vocabulary) + 1, -1, np.int64)
        at_term[self.terms] = np.arange(len(self.terms))
        have = at_term >= 0
        have[-1] = True
        end = int(self.starts[-1] + self.n_words[-1]) if len(self.starts) else 0
        edges = np.zeros(end + 1, np.int32)
        exact: dict[int, set[int]] = {}
        near: dict[int, set[int]] = {}

        def posted(term: int) -> np.ndarray:
            k = at_term[term]
            return self.positions[self.offsets[k] : self.offsets[k + 1]]

        for w in np.flatnonzero(have[phrases.windows].all(axis=1)).tolist():
            size = int(phrases.sizes[w])
            terms, places = phrases.windows[w], [p for p in order[w].tolist() if p < size]
            rarest, items = places[0], phrases.items[w]
            close = posted(terms[rarest])
            for i in places[1:]:
                other = posted(terms[i])
                gap = other[np.minimum(np.searchsorted(other, close - slop), len(other) - 1)] - close
                close = close[(gap >= -slop) & (gap <= slop)]
                if not len(close):
                    break
            if not len(close):
                continue
            for d in np.unique(np.searchsorted(self.starts, close, side="right") - 1).tolist():
                near.setdefault(d, set()).update(items)
            begin = close - rarest
            for i in places[1:]:
                other, wanted = posted(terms[i]), begin + i
                begin = begin[other[np.minimum(np.searchsorted(other, wanted), len(other) - 1)] == wanted]
                if not len(begin):
                    break
            if len(begin):
                np.add.at(edges, begin, 1)
                np.add.at(edges, begin + size, -1)
                for d in np.unique(np.searchsorted(self.starts, begin, side="right") - 1).tolist():
                    exact.setdefault(d, set()).update(items)
        over = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(edges[:-1]) > 0, [0]]).astype(np.int8)))
        return over.reshape(-1, 2), exact, near


def blocks(rows: Iterator[tuple[int | None, int, bytes]], vocabulary: dict[bytes, int]) -> Iterator[tuple[list, list, Block]]:
    """Documents in blocks of about BLOCK_WORDS words; a longer document is a block of its own."""
    held: tuple[list, list, list] = ([], [], [])
    size = 0
    for doc_id, key, text in rows:
        more = len(text) // 4
        if size and size + more > BLOCK_WORDS:
            yield held[0], held[1], Block.build(held[2], vocabulary)
            held, size = ([], [], []), 0
        for column, value in zip(held, (doc_id, key, text), strict=True):
            column.append(value)
        size += more
    if held[0]:
        yield held[0], held[1], Block.build(held[2], vocabulary)


def build_index(rows: DataFrame, phrases: Phrases) -> DataFrame:
    """Blocks of the index over ``rows`` (doc_id, key, text as binary)."""
    shared = rows.sparkSession.sparkContext.broadcast(phrases)  # at most QUERY_BYTES of benchmark text

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((i, k, t or b"") for b in batches for i, k, t in zip(b["doc_id"].to_pylist(), b["key"].to_pylist(), b["text"].to_pylist(), strict=True))
        for ids, keys, own in blocks(each, shared.value.vocabulary):
            columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([keys], pa.list_(pa.int64()))]
            for part in (own.n_words, own.starts, own.terms, own.offsets, own.positions):
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part)))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_ids", "keys", "n_words", "starts", "terms", "offsets", "positions"])

    return rows.mapInArrow(index, INDEX)


def term_counts(index: DataFrame, size: int) -> np.ndarray:
    """How often each term of the vocabulary stands in all blocks; as many numbers as the benchmark has words."""
    each = index.where("size(terms) > 0").select(F.expr("inline(transform(sequence(1, size(terms)), i -> named_struct('term', terms[i - 1], 'n', cast(offsets[i] - offsets[i - 1] AS bigint))))"))
    found = each.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(size, np.int64)
    often[found["term"].to_numpy()] = found["n"].to_numpy()
    return often


def query_index(index: DataFrame, phrases: Phrases, often: np.ndarray) -> DataFrame:
    """One row per document of the index: doc_id, key, n_words, spans, items, near_items."""
    shared = index.sparkSession.sparkContext.broadcast((phrases, phrases.rarest_first(often)))  # at most QUERY_BYTES of benchmark text
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, order = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                part = {name: batch[name][r].values for name in batch.schema.names}
                block = Block(*(part[n].to_numpy() for n in ("n_words", "starts", "terms", "offsets", "positions")))
                ranges, exact, near = block.answer(asked, order)
                spans: dict[int, list[dict[str, int]]] = {}
                for (start, end), d in zip(ranges.tolist(), (np.searchsorted(block.starts, ranges[:, 0], side="right") - 1).tolist(), strict=True):
                    spans.setdefault(d, []).append({"start": start - int(block.starts[d]), "end": end - int(block.starts[d])})
                rows = range(len(block.n_words))
                sets = [pa.array([sorted(found.get(d, ())) for d in rows], pa.list_(pa.int64())) for found in (exact, near)]
                yield pa.RecordBatch.from_arrays([part["doc_ids"], part["keys"], pa.array(block.n_words.astype(np.int64)), pa.array([spans.get(d, []) for d in rows], pa.list_(span)), *sets], names=["doc_id", "key", "n_words", "spans", "items", "near_items"])

    return index.mapInArrow(query, "doc_id bigint, key bigint, n_words bigint, spans array<struct<start:int,end:int>>, items array<bigint>, near_items array<bigint>")


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("binary").alias("text")).where("item_id is not null and text is not null")


def _bytes(items: DataFrame) -> int:
    return items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans, items, near_items.

    A window is WINDOW consecutive words of an item (an item of fewer, but not none, is one window).
    ``spans`` are the ranges of words inside any occurrence of a window, ``items`` lists the items with
    occurring windows, ``near_items`` those of which all words of a window stand within SLOP words of its
    rarest.  Null texts have no words; items without an id are passed over, items of equal ids are one.
    Repeated rows each get their row; empty tables give empty results; other columns are ignored.
    A benchmark of more than QUERY_BYTES is looked up in blocks, each against all documents.
    """
    space, items = Workspace(docs.sparkSession, "index"), _items(benchmark, item_col, item_text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("key"), F.col(text_col).cast("binary").alias("text"))
    parts = -(-_bytes(items) // QUERY_BYTES)
    if parts > 1:  # the blocks' answers come together by row
        rows = space.put(rows.withColumn("key", F.monotonically_increasing_id()), "rows")
    answers = None
    for part in range(max(1, parts)):
        own = items if parts <= 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        phrases = Phrases.of([(r["item_id"], bytes(r["text"])) for r in own.collect()])  # QUERY_BYTES, on average
        index = space.put(build_index(rows, phrases), f"index{part}")
        answer = query_index(index, phrases, term_counts(index, len(phrases.vocabulary)))
        answers = answer if answers is None else answers.unionByName(answer)
    if parts > 1:
        joined = answers.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near_items")))
        answers = joined.select("doc_id", "n_words", F.array_sort("spans").alias("spans"), *(F.array_sort(F.array_distinct(c)).alias(c) for c in ("items", "near_items")))
    return answers.select("doc_id", "n_words", "spans", "items", "near_items")


def n_hit(spans: Column) -> Column:
    """Words in the union of spans that are ordered by their start."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["upto"]), F.lit(0))).alias("n"), F.greatest(acc["upto"], s["end"]).alias("upto"))
    return F.aggregate(spans, start, step, lambda acc: acc["n"].cast("bigint"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any occurrence of a window, with all their columns and no others.

    Counts come from an index of the whole corpus; the filter itself looks up each batch of rows in an
    index of its own, so rows need no key.  Null and empty texts stay, as do all rows where the benchmark is empty;
    repeated rows stay or go together; an empty table gives an empty result.
    """
    space, items = Workspace(docs.sparkSession, "clean"), _items(benchmark, "item_id", "text")
    parts = max(1, -(-_bytes(items) // QUERY_BYTES))
    rows = docs.select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("key"), F.col(text_col).cast("binary").alias("text"))
    for part in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        phrases = Phrases.of([(r["item_id"], bytes(r["text"])) for r in own.collect()])  # QUERY_BYTES, on average
        often = term_counts(space.put(build_index(rows, phrases).select("terms", "offsets"), f"counts{part}"), len(phrases.vocabulary))
        space.drop(f"counts{part}")
        docs = docs.where(~_hit_udf(docs, phrases, often)(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    return docs


def _hit_udf(docs: DataFrame, phrases: Phrases, often: np.ndarray):  # noqa: ANN202
    shared = docs.sparkSession.sparkContext.broadcast((phrases, phrases.rarest_first(often)))

    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        asked, order = shared.value
        out = np.zeros(len(texts), np.bool_)
        for _, places, block in blocks(((None, i, bytes(t)) for i, t in enumerate(texts)), asked.vocabulary):
            _, exact, _ = block.answer(asked, order, slop=WINDOW)
            out[[places[d] for d in exact]] = True
        return pd.Series(out)

    return hit


def contamination_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items of what ``contamination`` returns."""
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.withColumn("n_hit", n_hit(F.col("spans"))).select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("bigint").alias("n_near_items"))
