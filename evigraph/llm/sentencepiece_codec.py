"""SentencePiece encoding and decoding by batched Viterbi search in numpy.

Words of equal length advance together: substring hashes of all of them are probed in the sorted keys of
the pieces at once, and at every position a vectorised maximum over the pieces that end there stores the
back pointers.  For a unigram model the maximum is that of summed scores.  For a BPE model the lattice is the
same, but a step from one piece to the next is open only if the pair is stable, that is if merging by
score would leave just these two when given their concatenation; a sequence of which each neighbouring
pair is stable is the one that merging gives, so exactly one path is open and the maximum finds it.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Piece types and model types of the file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
#: What stands for a space, and how a decoded unknown piece reads (fixed values).
SPACE, UNKNOWN_TEXT = "▁", " ⁇ "
#: Score of an unknown character below the lowest piece score, in unigram models (fixed value).
UNKNOWN_PENALTY = 10.0
#: Words that are searched together, words that a Python worker remembers, and bytes of text handled at once.
BATCH_WORDS, REMEMBERED, BATCH_BYTES = 4096, 600_000, 6 << 20
#: Longer words are first cut where no piece can span.
LONG = 48
MIX, MEMO_BITS = 0x9E3779B97F4A7C15, 21
#: Leading bits of hashes of pieces in a table that lets most other substrings go before they are looked up.
SIEVE_BITS = 20


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a message in the protocol buffers wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Pieces:
    """A model's vocabulary, as read from its file."""

    text: list[str] = field(default_factory=list)
    score: list[float] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    model: int = UNIGRAM
    dummy_prefix: bool = True

    @classmethod
    def read(cls, data: bytes) -> Pieces:
        """Models whose normalisation changes more than spaces are refused."""
        own = cls()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                own.text.append(piece[1].decode())
                own.score.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                own.kind.append(piece.get(3, NORMAL))
            elif number == 2:
                own.model = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only models with identity normalisation that keep all spaces are supported")
                own.dummy_prefix = bool(spec.get(3, 1))
        if own.model not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        return own


def _merged(word: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """What merging the best pair first (of equals the leftmost) makes of a word, and its last merge."""
    parts, last = list(word), None
    while len(parts) > 1:
        best, at = min((rank.get(a + b, len(rank)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best == len(rank):
            break
        last = (parts[at], parts[at + 1])
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts, last


class Codec:
    """Encodes and decodes batches of texts; plain arrays, so it can be broadcast (its size is the vocabulary's)."""

    def __init__(self, pieces: Pieces) -> None:
        p = pieces
        self.bpe, self.dummy_prefix = p.model == BPE, p.dummy_prefix
        usable = [i for i, k in enumerate(p.kind) if k in (NORMAL, USER)]
        self.longest = max(len(p.text[i]) for i in usable)
        n = len(p.text)
        self.byte_id = np.full(256, p.kind.index(UNKNOWN), np.int32)
        for i, k in enumerate(p.kind):
            if k == BYTE:
                self.byte_id[int(p.text[i][3:5], 16)] = i
        self.has_bytes = BYTE in p.kind
        self.unknown = p.kind.index(UNKNOWN)
        self.decoded = [
            bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else UNKNOWN_TEXT.encode() if k == UNKNOWN else t.replace(SPACE, " ").encode()
            for t, k in zip(p.text, p.kind, strict=True)]
        # Two characters that no piece has side by side are never in one piece.
        self.adjacent = {t[i : i + 2] for t in (p.text[k] for k in usable) for i in range(len(t) - 1)}
        if any(pair[1] == SPACE != pair[0] for pair in self.adjacent):
            raise ValueError("pieces that go on after a space within are not supported")
        order = sorted(usable, key=lambda i: (-p.score[i], i))
        self.rank = np.full(n + 1, -1, np.int64)
        self.left, self.right = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int32)
        self.score = np.array([*p.score, min(p.score[i] for i in usable) - UNKNOWN_PENALTY])
        if self.bpe:
            # The order of merges counts, so scores give way to ranks; single characters come before all merges.
            merges = [i for i in order if len(p.text[i]) > 1]
            rank, ids = {p.text[i]: r for r, i in enumerate(merges)}, {p.text[i]: i for i in usable}
            reached = [i for i in usable if len(p.text[i]) == 1]
            for i in merges:
                parts, last = _merged(p.text[i], rank)
                if len(parts) == 1 and all(x in ids for x in last):
                    self.rank[i], self.left[i], self.right[i] = rank[p.text[i]], ids[last[0]], ids[last[1]]
                    reached.append(i)
            pairs = sorted((ids[t[:k]] << 32 | ids[t[k:]], rank[t]) for t in rank for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids)
            self.pair_keys, self.pair_ranks = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
            usable = reached
        keys = {self._hash_of(p.text[i]): i for i in usable}
        if len(keys) != len(usable):
            raise ValueError("two pieces have one hash")
        self.keys = np.array(sorted(keys), np.uint64)
        self.sieve = np.zeros(1 << SIEVE_BITS, np.bool_)
        self.sieve[(self.keys >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
        self.ids = np.array([keys[k] for k in sorted(keys)], np.int32)
        self.codes = np.array([[ord(c) for c in p.text[i].ljust(self.longest, "\0")] for i in self.ids], np.uint32)
        self.n, self.known = n, {}
        self.memo_keys, self.memo = np.full(1 << MEMO_BITS, -1, np.int64), np.zeros(1 << MEMO_BITS, np.bool_)

    @staticmethod
    def _spread(code: np.ndarray) -> np.ndarray:
        """Characters as scattered 64-bit numbers."""
        x = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX)
        x ^= x >> np.uint64(29)
        return x * np.uint64(0xBF58476D1CE4E5B9)

    def _hash_of(self, text: str) -> int:
        total = 0
        for x in self._spread(np.array([ord(c) for c in text])).tolist():
            total = (total * MIX + x) % 2**64
        return total

    def _stable(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair of pieces as it is; the unknown piece merges with none."""
        out = np.ones(len(first), np.bool_)
        key = first.astype(np.int64) << 32 | second
        slot = (key.astype(np.uint64) * np.uint64(MIX) >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
        hit = self.memo_keys[slot] == key
        out[hit] = self.memo[slot[hit]]
        ask = np.flatnonzero(~hit)
        if len(ask):
            fresh, back = np.unique(key[ask], return_inverse=True)
            a, b = (fresh >> 32).astype(np.int32), (fresh & 0xFFFFFFFF).astype(np.int32)
            answer, live, limit = np.ones(len(fresh), np.bool_), np.arange(len(fresh)), np.full(len(fresh), 1 << 60, np.int64)
            while len(live):
                # Does some merge across the border come before the piece at it was complete?
                pair = a.astype(np.int64) << 32 | b
                at = np.minimum(np.searchsorted(self.pair_keys, pair), len(self.pair_keys) - 1)
                breaks = (self.pair_keys[at] == pair) & (self.pair_ranks[at] < limit)
                answer[live[breaks]] = False
                ra, rb = self.rank[a], self.rank[b]
                stays = ~breaks & ((ra >= 0) | (rb >= 0))
                live, a, b, ra, rb = live[stays], a[stays], b[stays], ra[stays], rb[stays]
                undo_first = ra > rb  # undo the later merge; of two equal ones the right is the later
                limit = np.where(undo_first, ra, rb + 1)
                a, b = np.where(undo_first, self.right[a], a), np.where(undo_first, b, self.left[b])
            out[ask] = answer[back]
            self.memo_keys[slot[ask]], self.memo[slot[ask]] = key[ask], out[ask]
        return out

    def _search(self, words: list[str]) -> list[bytes]:
        """The ids of words of one length, as bytes of int32."""
        count, size = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(count, size)
        hashes = np.zeros((count, size + 1), np.uint64)
        spread = self._spread(codes)
        for i in range(size):
            hashes[:, i + 1] = hashes[:, i] * np.uint64(MIX) + spread[:, i]
        reach = min(size, self.longest)
        power = np.array([pow(MIX, k, 2**64) for k in range(reach + 1)], np.uint64)
        best = np.full((count, size + 1), -np.inf)
        best[:, 0] = 0
        piece = np.full((count, size + 1), self.n, np.int32)
        back = np.zeros((count, size + 1), np.int32)
        rows = np.arange(count)
        for i in range(1, size + 1):
            far = min(i, reach)
            lengths = np.arange(1, far + 1)
            sub = hashes[:, i, None] - hashes[:, i - lengths] * power[lengths]
            r, k = np.nonzero(self.sieve.take((sub >> np.uint64(64 - SIEVE_BITS)).view(np.int64)))
            key = sub[r, k]
            which = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[which] == key
            r, k, which = r[found], k[found], which[found]
            other = np.ones(count, np.bool_)  # whether the last character is no piece
            other[r[k == 0]] = False
            # The stored characters are compared too, the ends at least: first, last and the length.
            same = (self.codes[which, 0] == codes[r, i - 1 - k]) & (self.codes[which, k] == codes[r, i - 1])
            r, k, ids = r[same], k[same], self.ids[which[same]]
            before = i - 1 - k
            value = best[r, before]
            if self.bpe:
                ok = np.isfinite(value)
                r, k, ids, before = r[ok], k[ok], ids[ok], before[ok]
                inner = before > 0
                ok = np.ones(len(r), np.bool_)
                ok[inner] = self._stable(piece[r[inner], before[inner]], ids[inner])
                # One path is open at most, so there is no maximum to find; a character that is no piece stands alone.
                best[r[ok], i], piece[r[ok], i], back[r[ok], i] = 0, ids[ok], before[ok]
                alone = other & np.isfinite(best[:, i - 1])
                best[alone, i], piece[alone, i], back[alone, i] = 0, self.n, i - 1
                continue
            table, chosen = np.full((count, far), -np.inf), np.zeros((count, far), np.int32)
            table[r, k], chosen[r, k] = value + self.score[ids], ids
            table[other, 0], chosen[other, 0] = best[other, i - 1] + self.score[self.n], self.n
            top = table.argmax(axis=1)
            best[:, i], piece[:, i], back[:, i] = table[rows, top], chosen[rows, top], i - 1 - top
        if not np.isfinite(best[:, size]).all():
            raise AssertionError("a word has no open path")
        ends, live, steps = np.full(count, size), np.ones(count, np.bool_), []
        while live.any():
            steps.append((np.where(live, piece[rows, ends], -1), ends.copy()))
            ends = np.where(live, back[rows, ends], 0)
            live = ends > 0
        ids = np.stack([s for s, _ in steps[::-1]], axis=1)
        real = ids >= 0
        data, ends = ids[real].astype(np.int32).tobytes(), np.cumsum([0, *(4 * real.sum(axis=1))]).tolist()
        out = [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        for w in np.flatnonzero((ids == self.n).any(axis=1)).tolist():
            row = ids[w][real[w]]
            places = [int(e[w]) for s, e in steps[::-1] if s[w] >= 0]
            parts = [[int(t)] if t != self.n else self._fallback(words[w][e - 1]) for t, e in zip(row, places, strict=True)]
            flat = [x for part in parts for x in part]
            if not self.has_bytes:  # neighbouring unknown characters are one unknown piece
                flat = [x for i, x in enumerate(flat) if x != self.unknown or i == 0 or flat[i - 1] != x]
            out[w] = np.array(flat, np.int32).tobytes()
        return out

    def _fallback(self, char: str) -> list[int]:
        return self.byte_id[list(char.encode())].tolist() if self.has_bytes else [self.unknown]

    def _cut(self, word: str) -> list[str]:
        """A long word in parts that no piece can span."""
        cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.adjacent), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, words: set[bytes]) -> None:
        """Search new words, those of one length together, and remember them."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known = {}
        texts = {w: w.decode("utf-8", "replace").replace(" ", SPACE) for w in words}
        whole = {t for t in texts.values() if len(t) <= LONG}
        cut = {t: self._cut(t) for t in texts.values() if len(t) > LONG}
        by_length: dict[int, list[str]] = {}
        for part in whole.union(*cut.values()):
            by_length.setdefault(len(part), []).append(part)
        found: dict[str, bytes] = {}
        for size, group in by_length.items():
            step = max(1, min(BATCH_WORDS, (1 << 18) // size))
            for i in range(0, len(group), step):
                found.update(zip(group[i : i + step], self._search(group[i : i + step]), strict=True))
        for w, t in texts.items():
            self.known[w] = found[t] if t in found and t not in cut else b"".join(found[x] for x in cut[t])

    _words = re.compile(rb" *[^ ]+| +")

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text (UTF-8)."""
        marked = [(b" " if self.dummy_prefix and t else b"") + t.replace(SPACE.encode(), b" ") for t in texts]
        parts = [self._words.findall(t) for t in marked]
        new: set[bytes] = set()
        new.update(*parts)
        missing = new.difference(self.known)
        if len(self.known) + len(missing) > REMEMBERED:
            missing = new
        if missing:
            self._learn(missing)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, own)), np.int32) for own in parts]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The texts of id sequences; bytes that are no UTF-8 stay as they are."""
        cut = int(self.dummy_prefix)
        whole = (b"".join(map(self.decoded.__getitem__, x.tolist())) for x in ids)
        return [t[1:] if cut and t[:1] == b" " else t for t in whole]


def load(path: str) -> Codec:
    """The codec of a model file on the driver."""
    with open(path, "rb") as f:
        return Codec(Pieces.read(f.read()))


def slices(sizes: list[int], most: int) -> Iterator[slice]:
    """Neighbouring rows of at most ``most`` bytes together, one at least."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def sentencepiece_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, token_ids, round_trip.

    ``round_trip`` says whether decoding the ids gives the text back byte for byte, which holds for every
    text without U+2581, a character that the format itself uses for spaces.  Bytes that aren't valid UTF-8 are read as
    U+FFFD and don't come back.  Null and empty texts have no tokens.  Repeated rows each get their row, an empty table gives an empty result, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            texts = [t or b"" for t in batch["text"].to_pylist()]
            for part in slices([len(t) for t in texts], BATCH_BYTES):
                own = texts[part]
                ids = codec.encode(own)
                same = [a == b for a, b in zip(codec.decode(ids), own, strict=True)]
                counts = np.fromiter(map(len, ids), np.int64, len(ids))
                values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([batch["doc_id"][part.start : part.stop], pa.array(counts), lists, pa.array(same)], names=["doc_id", "n_tokens", "token_ids", "round_trip"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(encode, "doc_id bigint, n_tokens bigint, token_ids array<int>, round_trip boolean")


def sentencepiece_texts(tokens: DataFrame, model_path: str, ids_col: str = "token_ids") -> DataFrame:
    """``tokens`` with ``text``, what their ids stand for, and no other change; null and empty lists stand for an empty text.

    Ids that the model doesn't have stand for nothing.  An empty table gives an empty result.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(load(model_path))

    def decode(lists: pd.Series) -> pd.Series:
        codec = shared.value
        size = len(codec.decoded)
        own = [np.array([i for i in (x if x is not None else ()) if i is not None and 0 <= i < size], np.int32) for x in lists]
        return pd.Series([t.decode("utf-8", "replace") for t in codec.decode(own)], dtype=object)

    return tokens.withColumn("text", F.pandas_udf(decode, "string")(ids_col))
