"""Secret scans: three fixed patterns, and a linear-chain conditional random field that adds spans to theirs.

Tokens are runs of the characters that secrets are made of.  The field tags them as outside, begin or inside of a
secret from their shape, the neighbouring words and tokens, and features of the whole file; training maximises the
regularised likelihood of the tags that the patterns give on a bounded sample of rows (``SAMPLE``, those with the
smallest hash of the id), and decoding is by Viterbi.  As the patterns know few shapes of secrets, each secret that they
find is learned from a second time with a token of another shape in its place.

By a hard constraint of the field, a token of letters alone under ``LETTERS`` characters, or of any kind under
``LEAST_TOKEN``, is outside: that is what ordinary words look like.  The best path through a text therefore falls into
independent runs of the other tokens, and searching those runs gives the same path as searching all.

Texts are read as UTF-8; what isn't valid stands for U+FFFD, and positions count code points of the text so read.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The patterns, in the order in which kinds stand at equal starts (fixed values).
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Rows whose tags are learned from at most, steps of training, and the weight of the penalty.
SAMPLE, STEPS, PENALTY = 20_000, 300, 0.1
#: Tokens that the field may tag: of so many characters with a digit, or of so many of any kind.
LEAST_TOKEN, LETTERS = 6, 16
TOKEN = re.compile(rf"(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{{{LEAST_TOKEN},}}|[A-Za-z0-9+/_=-]{{{LETTERS},}}")
GAP = re.compile(r"""[ \t"'.,;:|]{0,3}\Z""")
#: Characters before and after a token in which its neighbours are sought, and buckets of neighbouring words.
NEAR, AFTER, WORDS = 40, 24, 48
#: Bits of features of the token itself.  Learning from each run once with all features and once with these
#: alone keeps the field from leaning on what surrounds the patterns' secrets.
SHAPE = (1 << 28) - 1
OUT, BEGIN, INSIDE = 0, 1, 2
#: Where the bits of the words before, of the one further before, and after a token begin.
BEFORE_BIT, FURTHER_BIT, AFTER_BIT = 40, 40 + WORDS, 40 + 2 * WORDS
FEATURES = 40 + 3 * WORDS + 2
_HEX_ONLY = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))
_WORDS = re.compile(rb"password|passwd|secret|token|api_?key")
_KEY_NEAR = re.compile(r"(?ai:password|passwd|secret|token|api_?key|auth|credential|bearer)")
_WORD = re.compile(r"[^\W\d_]+")
#: Alphabets and lengths of the tokens that stand in for secrets in training.
_ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
_SIZES = (12, 16, 20, 24, 32, 40, 64)


def read(raw: bytes | None) -> str:
    """A text's characters; null is empty, bytes that aren't UTF-8 are replaced."""
    return (raw or b"").decode("utf-8", "replace")


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the secret itself) of the patterns' matches, in order.

    Matches of a kind don't overlap, the leftmost counting; those that are too short are dropped afterwards.
    """
    raw = text.encode("utf-8", "replace") if raw is None else raw
    found = []
    low = raw.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if b"x" * LEAST["hex"] in raw.translate(_HEX_ONLY):
        found += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _step(value: float, *edges: float) -> int:
    return sum(value >= e for e in edges)


def _bucket(word: str) -> int:
    return zlib.crc32(word.lower().encode()) % WORDS


def _mask(token: str, before: str, after: str, file: int) -> int:
    """The active features of a token as bits; ``file`` has those of the whole text."""
    n = len(token)
    digits = sum(c.isdigit() for c in token)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(token).values())
    near = before.rstrip(" \t")
    # Which letters a token has is left out: it would tell the patterns' own secrets from all others.
    bits = [0, 1 + _step(n, 12, 16, 20, 24, 32, 48), 8 + _step(digits / n, 0.01, 0.1, 0.6, 0.99), 13 + _step(entropy, 2.5, 3.0, 3.5, 4.0), 18 if any(c in "+/=" for c in token) else 19, 20 if "-" in token or "_" in token else 21]
    quoted = near[-1:] in ("'", '"')
    if quoted:
        bits.append(28)
        near = near[:-1].rstrip(" \t")
    if near[-1:] in ("=", ":"):
        bits.append(29)
    if _KEY_NEAR.search(before):
        bits.append(30)
    if after[:1] in ("'", '"'):
        bits.append(31)
    if before[-1:] in ("@", ".", "/", "?", "&") or after[:1] in ("@",) or re.match(r"\.[A-Za-z0-9]", after):
        bits.append(32)
    words = _WORD.findall(before)
    bits += [start + _bucket(w) for start, w in zip((BEFORE_BIT, FURTHER_BIT), words[:-3:-1], strict=False)]
    following = _WORD.search(after)
    if following:
        bits.append(AFTER_BIT + _bucket(following[0]))
    # Whether tokens of the same kind stand on either side.
    bits += [FEATURES - 2 + k for k, side in enumerate((before, after)) if TOKEN.search(side)]
    return sum(1 << b for b in set(bits)) | file


def token_runs(text: str, raw: bytes) -> list[list[tuple[int, int, int]]]:
    """(start, end, features) of the tokens that may be tagged, those next to each other in one run."""
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    if not tokens:
        return []
    file = _file(raw, len(tokens))
    runs: list[list[tuple[int, int, int]]] = []
    for start, end in tokens:
        mask = _mask(text[start:end], *_around(text, start, end), file)
        if runs and start - runs[-1][-1][1] <= 3 and GAP.match(text[runs[-1][-1][1] : start]):
            runs[-1].append((start, end, mask))
        else:
            runs.append([(start, end, mask)])
    return runs


def _file(raw: bytes, tokens: int) -> int:
    """The features of a whole text."""
    return (1 << 33 if _WORDS.search(raw.lower()) else 1 << 34) | 1 << (35 + _step(tokens, 4, 16, 64)) | (1 << 39 if b"{" in raw or b";" in raw else 0)


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    """What stands before and after a token on its line, as far as its features look."""
    line = text.rfind("\n", max(0, start - NEAR), start) + 1
    return text[max(line, start - NEAR, 0) : start], text[end : end + AFTER].split("\n", 1)[0]


def another_shape(text: str, start: int, end: int, file: int) -> int:
    """The features of a token with one of another shape in its place, chosen by its own characters."""
    rng = random.Random(zlib.crc32(text[start:end].encode()))
    alphabet, size = rng.choice(_ALPHABETS), rng.choice(_SIZES)
    return _mask("".join(rng.choice(alphabet) for _ in range(size)), *_around(text, start, end), file)


def pattern_tags(run: list[tuple[int, int, int]], spans: list[tuple[int, int, str, int]]) -> list[int]:
    """The tags of a run's tokens by the patterns' secrets."""
    tags = []
    for start, end, _ in run:
        own = [s for s in spans if s[3] < end and start < s[1]]
        tags.append(OUT if not own else BEGIN if min(s[3] for s in own) >= start else INSIDE)
    return tags


class Field:
    """Weights of a linear chain of three tags.  A run stands between tokens that are outside."""

    def __init__(self, emission: np.ndarray | None = None, step: np.ndarray | None = None) -> None:
        self.emission = np.zeros((FEATURES, 3)) if emission is None else emission
        self.step = np.zeros((3, 3)) if step is None else step
        self.cache: dict[int, list[float]] = {}

    def potential(self, mask: int) -> list[float]:
        if mask not in self.cache:
            if len(self.cache) > 200_000:
                self.cache = {}
            self.cache[mask] = self.emission[[b for b in range(FEATURES) if mask >> b & 1]].sum(axis=0).tolist()
        return self.cache[mask]

    def decode(self, masks: list[int]) -> list[int]:
        """The best tags; inside never follows outside."""
        step = self.step.tolist()
        best, back = [0.0, -math.inf, -math.inf], []
        for mask in masks:
            own = self.potential(mask)
            came = [max(range(3), key=lambda a, b=b: best[a] + step[a][b] if (a, b) != (OUT, INSIDE) else -math.inf) for b in range(3)]
            best = [(best[a] + step[a][b] + own[b]) if (a, b) != (OUT, INSIDE) else -math.inf for b, a in enumerate(came)]
            back.append(came)
        tag = max(range(3), key=lambda a: best[a] + step[a][OUT])
        tags = [tag]
        for came in back[:0:-1]:
            tag = came[tag]
            tags.append(tag)
        return tags[::-1]

    def likelihood(self, masks: np.ndarray, tags: np.ndarray, lengths: np.ndarray, often: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood of tagged runs and its gradients, by forward and backward recursion.

        Runs come with the longest first, and their tokens (features as 0/1) one run after another; a run counts ``often`` times.
        """
        starts = np.cumsum(lengths) - lengths
        active = [int(np.searchsorted(-lengths, -i, side="left")) for i in range(int(lengths[0]))]
        emit = masks @ self.emission
        ban = np.zeros((3, 3))
        ban[OUT, INSIDE] = -1e9
        step = self.step + ban
        alpha, first = [], np.broadcast_to(np.array([0.0, -1e9, -1e9]), (len(lengths), 3))
        for i, n in enumerate(active):
            before = alpha[-1][:n] if i else first
            alpha.append(np.logaddexp.reduce(before[:, :, None] + step[None], axis=1) + emit[starts[:n] + i])
        last = np.stack([alpha[size - 1][r] for r, size in enumerate(lengths.tolist())])
        beta = np.repeat(step[:, OUT][None], len(lengths), axis=0)
        norm = np.logaddexp.reduce(last + beta, axis=1)
        final = tags[starts + lengths - 1]
        gold, g_step = np.zeros_like(emit), np.zeros((3, 3))
        g_step[:, OUT] -= (np.exp(last + beta - norm[:, None]) * often[:, None]).sum(axis=0)
        np.add.at(g_step, (final, OUT), often)
        value = (often * (step[final, OUT] - norm)).sum()
        for i in range(len(active) - 1, -1, -1):
            n = active[i]
            at, weight = starts[:n] + i, often[:n]
            came = tags[at - 1] if i else np.zeros(n, np.int64)
            before = alpha[i - 1][:n] if i else first[:n]
            joint = np.exp(before[:, :, None] + step[None] + (emit[at] + beta[:n])[:, None, :] - norm[:n, None, None]) * weight[:, None, None]
            gold[at] = -joint.sum(axis=1)
            gold[at, tags[at]] += weight
            np.add.at(g_step, (came, tags[at]), weight)
            g_step -= joint.sum(axis=0)
            value += (weight * (step[came, tags[at]] + emit[at, tags[at]])).sum()
            beta[:n] = np.logaddexp.reduce(step[None] + (emit[at] + beta[:n])[:, None, :], axis=2)
        return float(value), masks.T @ gold, g_step


def train(runs: list[tuple[list[int], list[int], int]]) -> Field:
    """Adam on the penalised likelihood of (features, tags, number) of runs, equal ones taken together.

    A run that occurs n times counts as log2(1 + n) of them, so that boilerplate doesn't drown the rest.
    """
    field = Field()
    found: Counter = Counter()
    for masks, tags, n in runs:
        for kept in (-1, SHAPE):
            found[tuple(x & kept for x in masks), tuple(tags)] += n
    if not found:
        field.emission[0, OUT] = 1.0
        return field
    keys = sorted(found, key=lambda k: (-len(k[0]), k))
    often = np.log2(1 + np.array([found[k] for k in keys], np.float64))
    lengths = np.array([len(m) for m, _ in keys])
    flat = [m for own, _ in keys for m in own]
    masks = np.array([[m >> b & 1 for b in range(FEATURES)] for m in flat], np.float64)
    tags = np.array([t for _, own in keys for t in own], np.int64)
    moments = [np.zeros_like(field.emission), np.zeros_like(field.emission), np.zeros((3, 3)), np.zeros((3, 3))]
    for k in range(1, STEPS + 1):
        _, ge, gs = field.likelihood(masks, tags, lengths, often)
        for w, g, m in ((field.emission, ge - PENALTY * field.emission, moments[:2]), (field.step, gs - PENALTY * field.step, moments[2:])):
            m[0][:] = 0.9 * m[0] + 0.1 * g
            m[1][:] = 0.99 * m[1] + 0.01 * g * g
            w += 0.1 * (m[0] / (1 - 0.9**k)) / (np.sqrt(m[1] / (1 - 0.99**k)) + 1e-8)
    return field


def field_spans(text: str, raw: bytes, field: Field, base: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str]]:
    """Spans that the field tags; tokens that touch one of the patterns' spans are cut out of them, the rest stays."""
    out = []
    for run in token_runs(text, raw):
        current: tuple[int, int] | None = None
        for (start, end, _), tag in zip(run, field.decode([m for _, _, m in run]), strict=True):
            taken = any(s[0] < end and start < s[1] for s in base)
            if tag == INSIDE and current and not taken:
                current = (current[0], end)
                continue
            if current:
                out.append(current)
            current = (start, end) if tag != OUT and not taken else None
        if current:
            out.append(current)
    return [(a, b, "crf") for a, b in out]


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Learn from the patterns' tags on at most ``sample`` rows, one for each sampled id; rows without an id are passed over."""
    ids = docs.select(F.col(id_col).alias("doc_id")).where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(ids), "doc_id")  # at most ``sample`` ids

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, tags = [], []
            for raw in batch["text"].to_pylist():
                text, raw = read(raw), raw or b""
                spans, runs = base_spans(text, raw), token_runs(text, raw)
                file = _file(raw, sum(map(len, runs)))
                for run in runs:
                    own = pattern_tags(run, spans)
                    masks.append([m.to_bytes(32, "big") for _, _, m in run])
                    tags.append(own)
                    if any(own):
                        masks.append([(another_shape(text, a, b, file) if t else m).to_bytes(32, "big") for (a, b, m), t in zip(run, own, strict=True)])
                        tags.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(masks, pa.list_(pa.binary())), pa.array(tags, pa.list_(pa.int64()))], names=["masks", "tags"])

    # Equal runs come together before they are brought to the driver.  Repeated ids add to counts and not to kinds of runs,
    # as far as their texts are the same.
    found = rows.select("text").mapInArrow(tagged, "masks array<binary>, tags array<bigint>").groupBy("masks", "tags").count().orderBy(F.desc("count"), "masks", "tags").limit(4 * sample).collect()
    return train([([int.from_bytes(m, "big") for m in r["masks"]], list(r["tags"]), r["count"]) for r in found])


def _joined(spans: list[tuple]) -> str:
    return ",".join(f"{s[2]}:{s[0]}:{s[1]}" for s in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan_secrets(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, spans as array of (kind, start, end) in code points, end exclusive.

    Spans of the patterns all stay; those of the field (kind ``crf``) touch none of them.  Null and empty texts
    have none.  Repeated rows each get their row, an empty table gives an empty result, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch["text"].to_pylist():
                text, raw = read(raw), raw or b""
                base = base_spans(text, raw)
                spans = [s[:3] for s in base] + field_spans(text, raw, shared.value, base)
                out.append([{"kind": s[2], "start": s[0], "end": s[1]} for s in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(scan, "doc_id bigint, spans array<struct<kind:string,start:int,end:int>>")


def span_digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans as text of what ``scan_secrets`` returns."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]]
    return scanned.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
