"""Language-model scores by a hidden Markov model over word classes.

Words are counted over all training texts.  The most frequent ``OWN`` words are symbols of their own, all
others fall into classes by their shape, and a word's probability within its class follows from its count, so
the model is a distribution over all words, unknown ones included.  Baum-Welch runs over the symbols of all
training texts until their likelihood hardly gains: every task sums the expected counts of its rows, the sums of all tasks are added up by a
distributed aggregation, and only states x symbols numbers reach the driver.  The score of a text is the
exact likelihood of its whole sequence by scaled forward recursion.

Counts of the most frequent words of at most ``WORD_BYTES`` bytes are broadcast, ``HEAD`` of them at most; those of all
other words are looked up by a shuffled join with the table of counts, so no word goes without its exact count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.workspace import Workspace

#: States, words with symbols of their own, words whose counts are broadcast at most, and bytes of such a word at most.
STATES, OWN, HEAD, WORD_BYTES = 8, 2000, 250_000, 64
#: Steps of the logarithm of a count in which words are told apart when the frequent ones are chosen.
LEVELS = 64
#: Baum-Welch ends when the training likelihood gains less than this in a round, in log10 a token, and gains are
#: falling: near a saddle they are small at first and grow.
TOLERANCE = 0.001
#: Rounds over pairs of neighbours, which give the start, end when one gains less than this, in log10 a pair.
PAIR_TOLERANCE = 1e-5
#: Expected counts are taken over blocks of so many tokens, which hand messages to each other; tokens, bytes of text and sums handled at once.
BLOCK, SLICE, TEXT_BYTES, COUNTED = 1024, 1 << 21, 1 << 24, 300_000
#: Added to every count.
SMOOTH = 0.1
LENGTHS = 3, 5, 7, 9, 12, 16
SHAPES = 8 * (len(LENGTHS) + 1)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array]]:
    """Batches in parts of about TEXT_BYTES: rows, the row of each word, its place among the part's different words, and these.

    Words stand between ASCII white space, A-Z in lower case; the end of a text is added by the callers.
    """
    for batch in batches:
        every = pc.fill_null(batch["text"].cast(pa.binary()), b"")
        ends = np.cumsum(pc.binary_length(every).to_numpy(), dtype=np.int64)
        start = 0
        while start < len(every):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TEXT_BYTES, side="right")))
            # Kernels for ASCII take other bytes as they are, valid UTF-8 or not.
            listed = pc.ascii_split_whitespace(pc.ascii_lower(every[start:stop].view(pa.string())))
            coded = listed.flatten().view(pa.binary()).dictionary_encode()
            at = np.repeat(np.arange(stop - start), np.diff(listed.offsets.to_numpy()))
            code, words = coded.indices.to_numpy(), coded.dictionary
            blank = pc.index(words, b"").as_py()
            if blank >= 0:  # at the ends of texts
                full = code != blank
                at, code = at[full], code[full]
            yield batch.slice(start, stop - start), at, code, words
            start = stop


def shapes(words: pa.Array) -> np.ndarray:
    """The classes of words by length, digits, other than ASCII characters and final punctuation."""
    ends = np.cumsum(pc.binary_length(words).to_numpy(), dtype=np.int64)
    size = np.diff(ends, prepend=0)
    data = np.frombuffer(b"".join(words.to_pylist()), np.uint8) if len(words) else np.empty(0, np.uint8)

    def any_of(marks: np.ndarray) -> np.ndarray:
        before = np.concatenate([[0], np.cumsum(marks)])
        return before[ends] > before[ends - size]

    last = data[ends - 1] if len(data) else np.zeros(len(words), np.uint8)
    point = ~((last >= 97) & (last <= 122) | (last >= 48) & (last <= 57) | (last >= 128))
    long = np.searchsorted(LENGTHS, size, side="right")
    return ((long * 2 + any_of((data >= 48) & (data <= 57))) * 2 + any_of(data >= 128)) * 2 + point


@dataclass
class Counts:
    """What is known of the training texts' words; the end of a text is the last symbol."""

    words: pa.Array  # the frequent ones, most frequent first
    often: np.ndarray
    total: int
    distinct: int
    ends: int
    mass: np.ndarray  # of each shape's words without a symbol of their own: counts and their smoothing

    @property
    def symbols(self) -> int:
        return OWN + SHAPES + 1

    @property
    def base(self) -> float:
        """log10 of the denominator of the base score."""
        return float(np.log10(self.total + SMOOTH * (self.distinct + 1)))


def count_words(rows: DataFrame, space: Workspace) -> tuple[DataFrame, Counts]:
    """The table (word, shape, n) over the training rows of ``rows``, and its frequent part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, code, words in _words(batches):
            times = np.bincount(code, minlength=len(words))
            own = words.filter(pa.array(times > 0))
            yield pa.RecordBatch.from_arrays([own, pa.array(shapes(own), pa.int32()), pa.array(times[times > 0])], names=["word", "shape", "n"])

    training = rows.where("not held_out")
    counts = space.put(training.select("text").mapInArrow(count, "word binary, shape int, n bigint").groupBy("word", "shape").agg(F.sum("n").alias("n")), "counts")
    ends = training.count()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("words")).first()
    # Words by the logarithm of their count: a bounded number of levels, whole levels being taken or left.
    level = F.floor(F.log2("n") * LEVELS)
    short = counts.where(F.octet_length("word") <= WORD_BYTES)
    least, held = None, 0
    for r in sorted(short.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["level"]):
        if held + r["words"] > HEAD:
            break
        least, held = r["level"], held + r["words"]
    head = short.where(level >= (least if least is not None else 1 << 20)).toArrow()  # HEAD words at most
    head = head.cast(pa.schema([("word", pa.binary()), ("shape", pa.int32()), ("n", pa.int64())])).sort_by([("n", "descending"), ("word", "ascending")])
    words, often, classes = pa.array(head["word"].to_pylist(), pa.binary()), head["n"].to_numpy(), head["shape"].to_numpy()
    mass = np.full(SHAPES, SMOOTH)  # a word that no training text has
    for r in counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        mass[r["shape"]] += r["n"] + SMOOTH * r["words"]
    for i in range(min(OWN, len(words))):
        mass[classes[i]] -= often[i] + SMOOTH
    return counts, Counts(words, often, sums["n"] + ends, sums["words"] + (ends > 0), ends, np.maximum(mass, SMOOTH))


def encode(rows: DataFrame, known: Counts) -> DataFrame:
    """Texts as symbols: key, doc_id, held_out, n_tokens, n_known, symbols (uint16 as binary), and what is known
    of the sums of logarithms; ``rare`` and ``times`` are the words whose counts have to be looked up."""
    shared = rows.sparkSession.sparkContext.broadcast(known)  # HEAD words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = shared.value
        log_count = np.append(np.log10(have.often + SMOOTH), 0.0)
        log_mass = np.log10(have.mass)
        symbol = np.append(np.arange(len(have.words)), 0)
        symbol[OWN:-1] = OWN + shapes(have.words[OWN:])
        end = have.symbols - 1
        for part, row, code, words in _words(batches):
            n = part.num_rows
            known = pc.fill_null(pc.index_in(words, value_set=have.words), -1).to_numpy()  # of the different words
            codes = np.where(known < 0, OWN + shapes(words), symbol[known])[code]
            at = known[code]
            size = np.bincount(row, minlength=n)
            # Symbols of a text and its end stand together.
            flat = np.full(len(code) + n, end, np.uint16)
            flat[np.arange(len(code)) + row] = codes
            ends = np.concatenate([[0], np.cumsum(size + 1)])
            symbols = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * 2).astype(np.int32)), pa.py_buffer(flat)])
            logs, is_known, by_shape = log_count[at], at >= 0, codes >= OWN
            sums = lambda of, values, row=row, n=n: np.bincount(row[of], values[of], n).astype(np.float64)
            masses = log_mass[np.where(by_shape, codes - OWN, 0)]
            # Words to look up: of each text, each once.
            asked, times = np.unique(row[~is_known] * len(words) + code[~is_known], return_counts=True)
            first = pa.array(np.searchsorted(asked, np.arange(n + 1) * len(words)).astype(np.int32))
            columns = {
                "doc_id": part["doc_id"], "held_out": part["held_out"], "n_tokens": pa.array(size + 1), "n_known": pa.array(np.bincount(row[is_known], minlength=n) + (have.ends > 0)), "symbols": symbols,
                "all_logs": pa.array(sums(is_known, logs) + np.log10(have.ends + SMOOTH)), "shape_logs": pa.array(sums(is_known & by_shape, logs)), "mass_logs": pa.array(sums(by_shape, masses)),
                "rare": pa.ListArray.from_arrays(first, words.take(pa.array(asked % max(len(words), 1)))), "times": pa.ListArray.from_arrays(first, pa.array(times))}
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, symbols binary, all_logs double, shape_logs double, mass_logs double, rare array<binary>, times array<bigint>"
    return rows.mapInArrow(run, schema).withColumn("key", F.monotonically_increasing_id())


@dataclass
class Chain:
    """Start, step and emission probabilities."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # states x symbols

    @classmethod
    def first(cls, symbols: int, states: int = STATES) -> Chain:
        """Near uniform, states told apart by fixed pseudo-random weights."""
        rng = np.random.default_rng(7)
        step = np.eye(states) * 0.5 + 0.5 / states
        emit = rng.uniform(0.5, 1.5, (states, symbols)) / np.arange(10, symbols + 10)
        return cls(np.full(states, 1 / states), step, emit / emit.sum(axis=1, keepdims=True))

    @classmethod
    def of_pairs(cls, pairs: np.ndarray, states: int = STATES) -> Chain:
        """Where training begins: the chain under which neighbours in all texts are likeliest, each pair by itself.

        ``pairs`` has, by symbol and next symbol, how often they stand side by side: all that such pairs tell, so
        rounds over them need no text.
        """
        chain = cls.first(len(pairs), states)
        total = float(pairs.sum(dtype=np.float64))
        if not total:
            return chain
        emit, both = chain.emit.astype(np.float32), (chain.start[:, None] * chain.step).astype(np.float32)
        some = pairs > 0
        last = -np.inf
        while True:
            expected = emit.T @ (both @ emit)
            likely = float(np.log10(expected[some]).dot(pairs[some])) / total
            if likely - last < PAIR_TOLERANCE:
                break
            last = likely
            np.divide(pairs, expected, out=expected)
            after = expected @ emit.T
            counted = both * (emit @ after)
            emit *= both @ after.T + (both.T @ emit) @ expected
            emit += SMOOTH
            emit /= emit.sum(axis=1, keepdims=True)
            both = (counted + SMOOTH) / (counted + SMOOTH).sum()
        both, emit = both.astype(np.float64), emit.astype(np.float64)
        return cls(both.sum(axis=1), both / both.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))

    def expected(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, steps and emissions over the texts."""
        return self.counted(texts)[:3]

    def counted(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """The expected counts and the log10 likelihood of the texts; states come first in all arrays.

        Texts are cut into blocks that advance together.  What a block hands to the next and to the last one is
        exact: the product of a block's steps says how it passes messages on, whatever it gets.
        """
        states = len(self.start)
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = np.concatenate(texts).astype(np.int64)
        number = -(-sizes // BLOCK)
        place = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)  # of a block in its text
        lengths = np.minimum(np.repeat(sizes, number) - place * BLOCK, BLOCK)
        is_last = place == np.repeat(number, number) - 1
        at = np.repeat(np.cumsum(sizes) - sizes, number) + place * BLOCK
        emit, step = self.emit.astype(np.float32), self.step.astype(np.float32)
        begin, finish = self._messages(flat, at, lengths, place, is_last, emit, step)
        order = np.argsort(-lengths, kind="stable")
        falling, at_sorted = -lengths[order], at[order]
        steps_of = [int(np.searchsorted(falling, -t, side="left")) for t in range(int(lengths.max()) + 1)]  # blocks with more than t tokens
        widths = [n for n in steps_of if n]
        offset = np.concatenate([[0], np.cumsum(widths)])
        # Tokens step by step, all blocks' first ones first: what belongs to a step stands together in every array.
        on = np.concatenate([flat[at_sorted[:n] + t] for t, n in enumerate(widths)])
        seen, alpha, scale = np.take(emit, on, axis=1), np.empty((states, len(on)), np.float32), np.empty(len(on), np.float32)
        back_step = np.ascontiguousarray(step.T)
        for t, n in enumerate(widths):
            here = slice(offset[t], offset[t] + n)
            own = back_step @ alpha[:, offset[t - 1] : offset[t - 1] + n] if t else begin[:, order]
            own *= seen[:, here]
            np.sum(own, axis=0, out=scale[here])
            np.divide(own, scale[here], out=alpha[:, here])
        likely = float(np.log10(scale).sum(dtype=np.float64))
        # What comes after a block's last token, scaled so that the chances of its states add up to 1.
        last = offset[lengths[order] - 1] + np.arange(len(at))
        ends = alpha[:, last]
        beta = finish[:, order]
        beta /= (ends * beta).sum(axis=0)
        seen /= scale
        first_seen = seen[:, : len(at)].copy()
        steps, emits = np.zeros((states, states)), np.zeros_like(self.emit)
        for t in range(len(widths) - 1, -1, -1):
            if t + 1 < len(widths):
                m = widths[t + 1]
                ahead = seen[:, offset[t + 1] : offset[t + 1] + m]
                ahead *= beta[:, :m]
                steps += alpha[:, offset[t] : offset[t] + m] @ ahead.T
                beta[:, :m] = step @ ahead
            alpha[:, offset[t] : offset[t] + widths[t]] *= beta[:, : widths[t]]  # from here on the chance of each state
        # Steps from one block into the next.
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        into = np.flatnonzero(place > 0)
        if len(into):
            steps += ends[:, back[into - 1]] @ (first_seen[:, back[into]] * beta[:, back[into]]).T
        steps *= self.step
        for s in range(states):
            emits[s] = np.bincount(on, alpha[s], self.emit.shape[1])
        return alpha[:, : len(at)][:, back[place == 0]].sum(axis=1, dtype=np.float64), steps, emits, likely

    def _messages(self, flat: np.ndarray, at: np.ndarray, lengths: np.ndarray, place: np.ndarray, is_last: np.ndarray, emit: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each block gets from the left (the chance of its first state) and from the right (up to a factor)."""
        states = len(self.start)
        begin = np.repeat(self.start.astype(np.float32)[:, None], len(at), axis=1)
        finish = np.ones((states, len(at)), np.float32)
        some = np.flatnonzero(~is_last | (place > 0))  # blocks of texts that have more than one
        if not len(some):
            return begin, finish
        order = some[np.argsort(-lengths[some], kind="stable")]
        # passed[j, i, n]: of state i at the first token, all ways to state j at the last one, tokens included.
        passed = np.repeat(np.eye(states, dtype=np.float32)[:, :, None], len(order), axis=2)
        falling, begins = -lengths[order], at[order]
        relative, back_step = emit / emit.max(axis=0), np.ascontiguousarray(step.T)  # messages count up to a factor
        for t in range(-int(falling[0])):
            n = int(np.searchsorted(falling, -t, side="left"))
            moved = (back_step @ passed[:, :, :n].reshape(states, -1)).reshape(states, states, n) if t else passed[:, :, :n].copy()
            moved *= np.take(relative, flat[begins[:n] + t], axis=1)[:, None]
            if t % 2:  # in two steps nothing gets too small
                moved /= moved.max(axis=(0, 1))
            if n == len(order):
                passed = moved
            else:
                passed[:, :, :n] = moved
        where = np.full(len(at), -1, np.int64)
        where[order] = np.arange(len(order))
        for k in range(1, int(place.max()) + 1):
            now = np.flatnonzero(place == k)
            got = np.einsum("in,jin->jn", begin[:, now - 1], passed[:, :, where[now - 1]])
            begin[:, now] = step.T @ (got / got.sum(axis=0))
        for k in range(int(place.max()) - 1, -1, -1):
            now = np.flatnonzero((place == k) & ~is_last)
            got = np.einsum("jin,jn->in", passed[:, :, where[now + 1]], finish[:, now + 1])
            finish[:, now] = step @ (got / got.sum(axis=0))
        return begin, finish

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 of each whole sequence's probability, texts of many lengths advancing together."""
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        flat = np.concatenate(texts).astype(np.int64) if texts else np.empty(0, np.int64)
        falling = -lengths[order]
        emit, total = np.ascontiguousarray(self.emit.T), np.zeros(len(texts))
        alpha = np.repeat(self.start[None], len(texts), axis=0)
        for t in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(falling, -t, side="left"))
            own = (alpha[:n] @ self.step if t else alpha[:n]) * emit[flat[starts[:n] + t]]
            scale = own.sum(axis=1)
            total[:n] += np.log10(scale)
            alpha[:n] = own / scale[:, None]
        out = np.empty(len(texts))
        out[order] = total
        return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches in parts of about SLICE tokens, with their symbols."""
    for batch in batches:
        whole = [np.frombuffer(b, np.uint16) for b in batch["symbols"].to_pylist()]
        start = held = 0
        for i, t in enumerate(whole):
            if held and held + len(t) > SLICE:
                yield batch.slice(start, i - start), whole[start:i]
                start, held = i, 0
            held += len(t)
        if start < len(whole):
            yield batch.slice(start), whole[start:]


def _pairs(encoded: DataFrame, symbols: int) -> np.ndarray:
    """How often each symbol is followed by each other one in the training rows; the last of a text by none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(symbols * symbols, np.int64)
        for _, texts in _slices(batches):
            flat = np.concatenate(texts).astype(np.int64)
            cells = flat[:-1] * symbols + flat[1:]
            total += np.bincount(np.delete(cells, np.cumsum([len(t) for t in texts])[:-1] - 1), minlength=len(total))
        some = np.flatnonzero(total)
        for i in range(0, len(some), COUNTED):
            part = some[i : i + COUNTED]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["cell", "n"])

    cells = encoded.where("not held_out").select("symbols").mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # symbols x symbols numbers
    total = np.zeros(symbols * symbols, np.float32)
    total[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return total.reshape(symbols, symbols)


def train(encoded: DataFrame, symbols: int, tolerance: float = TOLERANCE, states: int = STATES) -> Chain:
    """Baum-Welch over all training rows, until rounds gain ever less and the last one less than ``tolerance``."""
    chain = Chain.of_pairs(_pairs(encoded, symbols), states)
    width = 1 + states + symbols
    means: list[float] = []
    while True:
        shared = encoded.sparkSession.sparkContext.broadcast(chain)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            total, likely = np.zeros((states, width)), 0.0
            for _, texts in _slices(batches):
                start, step, emit, own = shared.value.counted(texts)
                total[:, 0] += start
                total[:, 1 : 1 + states] += step
                total[:, 1 + states :] += emit
                likely += own
            flat = np.append(total.ravel(), likely)
            some = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], names=["cell", "n"])

        cells = encoded.where("not held_out").select("symbols").mapInArrow(expect, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # states x symbols numbers
        shared.unpersist()
        total = np.zeros(states * width + 1)
        total[cells["cell"].to_numpy()] = cells["n"].to_numpy()
        total, likely = total[:-1].reshape(states, width), total[-1]
        start, step, emit = total[:, 0] + SMOOTH, total[:, 1 : 1 + states] + SMOOTH, total[:, 1 + states :] + SMOOTH
        chain = Chain(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))
        means.append(likely / max(total[:, 1 + states :].sum(), 1))
        gains = np.diff(means).round(7)
        if not likely or len(gains) > 2 and gains[-1] < tolerance and gains[-1] <= gains[-2] <= gains[-3]:
            return chain


def held_out(id_col: str) -> Column:
    """crc32 of the id as text divides by 10; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is empty and has one token, its end.  Texts are read as bytes, valid UTF-8 or not.  Repeated rows each
    count and get their row, null ids are rows like others; an empty
    table gives an empty result; without training rows all probabilities are those of smoothing alone; other
    columns are ignored.
    """
    space = Workspace(docs.sparkSession, "hmm")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    counts, known = count_words(rows, space)
    encoded = space.put(encode(rows, known), "encoded", compression="zstd")
    shared = docs.sparkSession.sparkContext.broadcast(train(encoded, known.symbols))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _slices(batches):
            columns = [batch[n] for n in ("key", "doc_id", "held_out", "n_tokens", "n_known", "all_logs", "shape_logs", "mass_logs")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shared.value.log10(texts))], names=["key", "doc_id", "held_out", "n_tokens", "n_known", "all_logs", "shape_logs", "mass_logs", "chain"])

    scored = encoded.drop("rare", "times").mapInArrow(forward, "key bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, all_logs double, shape_logs double, mass_logs double, chain double")
    asked = encoded.select("key", F.explode(F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("times"))).alias("r")).select("key", "r.*").toDF("key", "word", "times")
    # Rare words are found once in a row or a few times, so no word is hot here; the frequent ones aren't looked up.
    found = asked.join(counts.select("word", "n").hint("merge"), "word", "left")
    sums = found.groupBy("key").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("rare_logs"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    joined = scored.join(sums.hint("merge"), "key", "left").withColumns({"rare_logs": F.coalesce("rare_logs", F.lit(0.0)), "rare_known": F.coalesce("rare_known", F.lit(0))})
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("rare_known")).cast("bigint").alias("n_known"), F.lit(known.total).cast("bigint").alias("train_tokens"),
        (F.col("all_logs") + F.col("rare_logs") - F.col("n_tokens") * F.lit(known.base)).alias("base_score"),
        (F.col("chain") + F.col("shape_logs") + F.col("rare_logs") - F.col("mass_logs")).alias("score"))
