"""Near duplicates by HyperMinHash sketches, banding and verification on full shingle sets.

A sketch has ``MIXES`` x ``BUCKETS`` registers.  Each keeps of the smallest hash in its bucket only the number
of leading zeros and a few mantissa bits, one byte in all.  Registers of sets of at most ``SHORT`` shingles have
no buckets but a hash function each: with few shingles most buckets would be empty, and as these borrow from the next one, a
single shingle would spoil many registers at once and with them every band.  Bands of registers group documents that
may be similar; a Jaccard estimate, corrected for registers that agree by chance, drops pairs far below the
threshold; the rest are confirmed on the full sets of 64-bit shingle hashes.

Documents with equal sets are one node from the start, so copies never meet each other.  In a large band not
all pairs are made: a few pivots are compared with all members.  What these leave outside the main component of
a group of overlapping bands is then compared with the whole group in blocks, of which only links are
returned.  A pair that is left out therefore joins two nodes that are connected anyway.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.workspace import Workspace, kept_rows, keyed

BUCKETS, MIXES, MANTISSA = 64, 5, 4
REGISTERS = BUCKETS * MIXES
#: The chance that a pair at the threshold shares no band is at most this.
MISSED = 1e-5
#: Standard deviations that an estimate may lie below the threshold; sets below this size aren't judged by estimate.
MARGIN, SMALL = 6, 200
#: Sets of at most so many shingles (fewer than SMALL) have independent registers.
SHORT = 128
#: Bits of a sketch that go along with its bands, and the columns that hold them.
TRAITS = 256
_TRAITS = [f"t{i}" for i in range(TRAITS // 64)]
#: Bands of at most so many members make all their pairs; in larger ones so many pivots meet all members.
ALL_PAIRS, PIVOTS = 8, 2
#: Rows of a block that is compared with another one at once, and shingles that are counted at a time.
BLOCK, COLUMNS = 1536, 4096
REMEMBERED = 400_000
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K[1]
    x = (x ^ (x >> np.uint64(27))) * _K[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct hashed shingles of texts; remembers the hashes of words."""

    def __init__(self, width: int) -> None:
        self.width, self.known = width, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        try:
            codes = np.array([*map(self.known.__getitem__, words)], np.uint64)
        except KeyError:
            if len(self.known) > REMEMBERED:
                self.known = {}
            for w in words:
                if w not in self.known:
                    self.known[w] = xxhash.xxh64_intdigest(w)
            codes = np.array([*map(self.known.__getitem__, words)], np.uint64)
        width = min(self.width, len(codes))
        total = np.full(len(codes) - width + 1, len(codes) if width < self.width else self.width, np.uint64)
        for i in range(width):
            total = _mix(total * _K[3] + codes[i : len(codes) - width + 1 + i])
        return np.unique(total)


def _code(rest: np.ndarray) -> np.ndarray:
    """One byte for each hash, of which the highest bit is the first that counts."""
    zeros = np.clip(63 - np.floor(np.log2(rest.astype(np.float64))).astype(np.int64), 0, 63)
    mantissa = (rest << (zeros.astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return (np.minimum(zeros, 15).astype(np.uint8) << MANTISSA) | mantissa.astype(np.uint8)


_SALTS = _mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _K[0])[:, None]


def independent(shingles: np.ndarray) -> np.ndarray:
    """The registers of a set that isn't empty, each by a hash function of its own."""
    return _code(_mix((shingles * _K[4])[None] ^ _SALTS).min(axis=1) | np.uint64(1))


_STARTS = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(58)
_PLACES = np.arange(BUCKETS)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The registers of a set that isn't empty; those of empty buckets borrow from the next one that isn't."""
    out = np.empty((MIXES, BUCKETS), np.uint8)
    for m in range(MIXES):
        x = np.sort(_mix(shingles * _K[4] + np.uint64((m * 0x9E3779B97F4A7C15 + 1) % 2**64)))
        first = np.searchsorted(x, _STARTS)
        least = x[np.minimum(first, len(x) - 1)]
        full = (first < len(x)) & (least >> np.uint64(58) == _PLACES.astype(np.uint64))
        code = _code((least << np.uint64(6)) | np.uint64(1))
        places = np.flatnonzero(full)
        source = np.searchsorted(places, _PLACES) % len(places)
        far = (places[source] - _PLACES) % BUCKETS
        out[m] = code[places[source]] + (far * 37).astype(np.uint8)
    return out.ravel()


def band_rows(threshold: float) -> int:
    """The most registers in a band that keep the chance of a miss at the threshold within MISSED."""
    return max([r for r in range(1, 17) if (1 - threshold**r) ** (REGISTERS // r) <= MISSED], default=1)


def bands(registers: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each sketch (a row of registers)."""
    count = REGISTERS // rows
    key = np.repeat(np.arange(count, dtype=np.uint64)[None], len(registers), axis=0)
    for r in range(rows):
        key = _mix(key * _K[0] + registers[:, r * count : (r + 1) * count].astype(np.uint64) + np.uint64(r + 1))
    return key.view(np.int64)


def by_chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The chance that the registers of unrelated sets of n and m shingles agree."""
    zeros, part = np.divmod(np.arange(16 << MANTISSA), 1 << MANTISSA)
    low = 2.0 ** -(zeros + 1) * (1 + part / (1 << MANTISSA))
    high = 2.0 ** -(zeros + 1) * (1 + (part + 1) / (1 << MANTISSA))
    share = [np.exp(-np.outer(x / BUCKETS, low)) - np.exp(-np.outer(x / BUCKETS, high)) for x in (n, m)]
    return (share[0] * share[1]).sum(axis=1)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs of sketches, corrected for agreement by chance."""
    chance = by_chance(n, m)
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def signature(shingles: np.ndarray) -> bytes:
    """The registers of a set that isn't empty, and its traits."""
    registers = independent(shingles) if len(shingles) <= SHORT else sketch(shingles)
    return registers.tobytes() + traits(shingles, registers).tobytes()


def beside(shingles: np.ndarray, percent: int) -> bytes | None:
    """The registers by buckets of a short set that may be similar to sets that aren't short."""
    return sketch(shingles).tobytes() if len(shingles) <= SHORT and 100 * len(shingles) >= percent * (SHORT + 1) else None


def _sketches(rows: DataFrame, width: int, percent: int, carry: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in batches:
            sizes, digests, registers, more = [], [], [], []
            for text in batch["text"].to_pylist():
                own = shingles(text or b"")
                sizes.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                registers.append(signature(own) if len(own) else None)
                more.append(beside(own, percent) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["print"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(registers, pa.binary()), pa.array(more, pa.binary()), *(batch[c] for c in carry)], names=["doc_id", "print", "n_shingles", "digest", "registers", "beside", *carry])

    return rows.mapInArrow(run, ", ".join(["doc_id bigint, print bigint, n_shingles bigint, digest binary, registers binary, beside binary", *(f"{c} bigint" for c in carry)])).withColumn("key", F.monotonically_increasing_id())


def traits(shingles: np.ndarray, registers: np.ndarray) -> np.ndarray:
    """TRAITS bits of a set: of a small one a bitmap of its hashes, else the lowest mantissa bits of registers."""
    if len(shingles) >= SMALL:
        return np.packbits(registers[:TRAITS] & 1)
    bits = np.zeros(TRAITS, np.uint8)
    bits[(shingles >> np.uint64(40)).astype(np.int64) % TRAITS] = 1
    return np.packbits(bits)


def _plausible(a: Column, b: Column, percent: int) -> Column:
    """Whether sizes and traits (structs n, t) leave it possible that a pair reaches the threshold.

    Bitmaps of small sets differ in no more bits than the sets in members, which the threshold bounds.
    Bits of large ones agree with a chance of (1 + threshold) / 2 at the threshold; a pair may fall MARGIN standard
    deviations short of that.
    """
    p = (1 + percent / 100) / 2
    limit = int(TRAITS * (1 - p) + MARGIN * math.sqrt(TRAITS * p * (1 - p))) + 1
    differ = sum(F.bit_count(a[t].bitwiseXOR(b[t])) for t in _TRAITS)
    least, most = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
    small = differ * (100 + percent) <= (least + most) * (100 - percent)
    return (least * 100 >= most * percent) & F.when(most < SMALL, small).when(least >= SMALL, differ <= limit).otherwise(True)


#: Keeps bands of independent registers apart from others.
_APART = np.int64(0x5851F42D4C957F2D)


def _banded(nodes: DataFrame, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = np.frombuffer(b"".join(batch["registers"].to_pylist()), np.uint8).reshape(-1, REGISTERS + TRAITS // 8)
            sizes = batch["n_shingles"].to_numpy()
            keys = bands(matrix[:, :REGISTERS], rows)
            keys[sizes <= SHORT] ^= _APART
            both = np.flatnonzero(batch["beside"].is_valid().to_numpy(zero_copy_only=False))
            if len(both):
                more = np.frombuffer(b"".join(batch["beside"].drop_null().to_pylist()), np.uint8).reshape(-1, REGISTERS)
                keys = np.concatenate([keys, bands(more, rows)])
            at = np.concatenate([np.arange(len(sizes)), both])
            own = np.ascontiguousarray(matrix[:, REGISTERS:]).view(np.int64)
            columns = [batch["nid"].to_numpy(), sizes, *own.T]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(c[at], keys.shape[1])) for c in columns), pa.array(keys.ravel())], names=["nid", "n", *_TRAITS, "band"])

    return nodes.select("nid", "n_shingles", "registers", "beside").mapInArrow(run, ", ".join(f"{c} bigint" for c in ("nid", "n", *_TRAITS, "band")))


def _estimated(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, ra, rb, na, nb) whose estimate doesn't rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, REGISTERS + TRAITS // 8)[:, :REGISTERS] for c in ("ra", "rb"))
            na, nb = batch["na"].to_numpy(), batch["nb"].to_numpy()
            about = estimate(ra, rb, na, nb)
            keep = (about >= threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / REGISTERS)) | (np.minimum(na, nb) < SMALL)
            keep &= np.minimum(na, nb) >= np.maximum(na, nb) * threshold - 1e-9  # sizes alone can rule a pair out
            yield pa.RecordBatch.from_arrays([batch[c].filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, sa, sb) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["sa"], batch["sb"], strict=True):
                a, b = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                same = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * same >= percent * (len(a) + len(b) - same))
            yield pa.RecordBatch.from_arrays([batch[c].filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def _sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(nid, shingles) of the nodes in ``wanted`` (nid, doc_id, print, digest), read from one of each node's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in batches:
            nids, sets = [], []
            for nid, digest, text in zip(batch["nid"].to_pylist(), batch["digest"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = shingles(text).tobytes()
                if hashlib.blake2b(own, digest_size=16).digest() == digest:
                    nids.append(nid)
                    sets.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(nids, pa.int64()), pa.array(sets, pa.binary())], names=["nid", "shingles"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("print"), F.col(text_col).cast("binary").alias("text"))
    have = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "print")
    found = rows.withColumn("at", have).join(wanted.select("nid", "digest", have.alias("at")).hint("merge"), "at")
    # A row that is repeated gives its node's set again.
    return found.select("nid", "digest", "text").mapInArrow(run, "nid bigint, shingles binary").dropDuplicates(["nid"])


def components(links: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(nid, comp) for all ends of ``links`` (a, b), comp being the least nid connected.

    Each round gives every end the least of its neighbours, and that one's own, for a label, and replaces the
    ends of links by their labels.  Links within a label vanish, so few are left after the first round.
    """
    edge = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = space.put(links.where("a <> b").select(*edge).distinct(), f"{name}-edges")
    mapping, number = None, 0
    while True:
        number += 1
        ends = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        least = space.put(ends.groupBy(F.col("a").alias("nid")).agg(F.min("b").alias("b")).select("nid", F.least("nid", "b").alias("comp")), f"{name}-{number}-least")
        further = least.select(F.col("nid").alias("comp"), F.col("comp").alias("next"))
        step = space.put(least.join(further.hint("merge"), "comp").select("nid", F.least("comp", "next").alias("comp")), f"{name}-{number}-step")
        if mapping is None:
            mapping = step
        else:
            again = step.toDF("comp", "next").hint("merge")
            mapping = space.put(mapping.join(again, "comp", "left").select("nid", F.coalesce("next", "comp").alias("comp")), f"{name}-{number}-mapping")
        moved = edges.join(step.toDF("a", "x").hint("merge"), "a").join(step.toDF("b", "y").hint("merge"), "b").where("x <> y")
        edges = space.put(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-{number}-edges")
        if edges.isEmpty():
            return mapping


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the two sides of each (grp, i, j), both at most BLOCK rows of (nid, comp, side, shingles).

    Intersections of all pairs come from products of 0/1 matrices, some shingles at a time; pairs within a
    component don't count.  Nothing but links leaves the function.
    """

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        comp, nid = table["comp"].to_numpy(), table["nid"].to_numpy()
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table["shingles"]]
        sizes = np.array([len(s) for s in sets])
        whole = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        values, code, count = np.unique(whole, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(count > 1)
        rank = np.full(len(values), -1, np.int64)
        rank[shared] = np.arange(len(shared))
        code = rank[code]
        place = np.empty(len(sets), np.int64)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        same = np.zeros((len(left), len(right)), np.float32)
        for low in range(0, len(shared), COLUMNS):
            on = (code >= low) & (code < low + COLUMNS)
            parts = []
            for number, rows in ((0, left), (1, right)):
                own = on & (side[owner] == number)
                matrix = np.zeros((len(rows), min(COLUMNS, len(shared) - low)), np.float32)
                matrix[place[owner[own]], code[own] - low] = 1
                parts.append(matrix)
            same += parts[0] @ parts[1].T
        union = sizes[left][:, None] + sizes[right][None] - same
        x, y = np.nonzero((100 * same >= percent * union) & (comp[left][:, None] != comp[right][None]))
        return pa.table({"a": nid[left[x]], "b": nid[right[y]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return rows.groupBy("grp", "i", "j").applyInArrow(run, "a bigint, b bigint")


def _rest(members: DataFrame, comps: DataFrame | None, sets: DataFrame, space: Workspace, percent: int) -> DataFrame:
    """Links that pivots may have left out: between what isn't in the main component of a large group and all of it.

    ``members`` (band, nid) are those of large bands; bands that overlap are one group.
    """
    leaders = space.put(members.groupBy("band").agg(F.min("nid").alias("b")), "leaders")
    groups = components(members.select("band", F.col("nid").alias("a")).join(leaders.hint("merge"), "band").select("a", "b").distinct(), space, "groups")
    own = groups.withColumnRenamed("comp", "grp")
    labelled = own.withColumn("comp", F.col("nid")) if comps is None else own.join(comps.hint("merge"), "nid", "left").select("nid", "grp", F.coalesce("comp", "nid").alias("comp"))
    labelled = space.put(labelled, "rest-labelled")
    sizes = space.put(labelled.groupBy("grp", "comp").agg(F.count("*").alias("n")), "rest-sizes")
    main = sizes.groupBy("grp").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"))
    main = space.put(main.select("grp", F.col("main.comp").alias("main"), (F.ceil(F.col("all") / BLOCK)).alias("n_j"), F.ceil((F.col("all") - F.col("main.n")) / BLOCK).alias("n_i")).where("n_i > 0"), "rest-main")
    placed = space.put(labelled.join(main.hint("merge"), "grp"), "rest-placed")
    # Blocks are dealt by hash and so may hold somewhat more than BLOCK rows.
    block = lambda count, salt: F.pmod(F.xxhash64("nid", F.lit(salt)), F.col(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))
    outside = placed.where("comp <> main").select("grp", block("n_i", 1).alias("i"), every("n_j").alias("j"), "nid", "comp", F.lit(0).alias("side"))
    inside = placed.select("grp", every("n_i").alias("i"), block("n_j", 2).alias("j"), "nid", "comp", F.lit(1).alias("side"))
    met = outside.unionByName(inside).join(sets.hint("merge"), "nid")
    return space.put(_across(met, percent), "rest-links")


def _confirm(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, space: Workspace, percent: int, name: str) -> DataFrame:
    """The links among candidate pairs, by estimate first and then by the full sets."""
    pairs = space.put(pairs.distinct(), f"{name}-pairs")
    narrow = nodes.select("nid", "registers", F.col("n_shingles").alias("n"))
    with_a = pairs.join(narrow.toDF("a", "ra", "na").hint("merge"), "a")
    about = space.put(_estimated(with_a.join(narrow.toDF("b", "rb", "nb").hint("merge"), "b"), percent / 100), f"{name}-about")
    with_sets = about.join(sets.toDF("a", "sa").hint("merge"), "a").join(sets.toDF("b", "sb").hint("merge"), "b")
    return space.put(_confirmed(with_sets, percent), f"{name}-links")


def _links(docs: DataFrame, nodes: DataFrame, space: Workspace, width: int, percent: int, id_col: str, text_col: str) -> DataFrame | None:
    """(nid, comp) of the nodes that have links, by components; None if there are no links."""
    member = ("band", "nid", "n", *_TRAITS)
    banded = space.put(_banded(nodes, band_rows(percent / 100)), "bands")
    groups = space.put(banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1"), "sizes")
    active = space.put(banded.join(groups.hint("merge"), "band"), "active")
    wanted = active.select("nid").distinct().join(nodes.select("nid", "doc_id", "print", "digest"), "nid")
    sets = space.put(_sets(docs, wanted, width, id_col, text_col), "sets")
    small, large = active.where(F.col("members") <= ALL_PAIRS).select(*member), space.put(active.where(F.col("members") > ALL_PAIRS).select(*member), "large")
    # In each large band one pivot of each of PIVOTS parts, by the hash of the node.
    part = F.pmod(F.xxhash64("nid"), F.lit(PIVOTS))
    pivots = space.put(large.groupBy("band", part.alias("part")).agg(F.min(F.struct("nid", "n", *_TRAITS)).alias("p")).select("band", "p.*"), "pivots")
    pairs = None
    for left, right in ((small, small), (large, pivots)):
        fits = _plausible(F.struct("x.n", *(f"x.{t}" for t in _TRAITS)), F.struct("y.n", *(f"y.{t}" for t in _TRAITS)), percent)
        order = F.col("x.nid") < F.col("y.nid") if left is small else F.col("x.nid") != F.col("y.nid")
        met = left.alias("x").join(right.alias("y").hint("merge"), (F.col("x.band") == F.col("y.band")) & order & fits)
        found = met.select(F.least("x.nid", "y.nid").alias("a"), F.greatest("x.nid", "y.nid").alias("b"))
        pairs = found if pairs is None else pairs.union(found)
    links = _confirm(pairs, nodes, sets, space, percent, "first")
    comps = None if links.isEmpty() else components(links, space, "comps")
    if large.isEmpty():
        return comps
    more = _rest(large.select("band", "nid"), comps, sets, space, percent)
    if more.isEmpty():
        return comps
    known = more if comps is None else more.union(comps.select(F.col("nid").alias("a"), F.col("comp").alias("b")))
    return components(known, space, "all-comps")


def without_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, with all its columns and no others."""
    rows, key = keyed(docs, Workspace(docs.sparkSession, "similar"))
    return kept_rows(rows, near_duplicates(rows, words, percent, id_col, text_col, key).where("kept"), key)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, and the bigint columns in ``carry``.

    Documents are linked when 100 * intersection >= percent * union of their sets of distinct shingles of
    ``words`` words (with fewer words, the whole sequence).  ``component_id`` is the smallest id in reach.  A text
    without words, or null, has an empty set and is linked with nothing.  Exactly one row of each component
    is kept, the first of those with the smallest id; ids that are null come last.  An empty table gives an
    empty result; other columns are ignored.
    """
    space = Workspace(docs.sparkSession, "near")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("print"), F.col(text_col).cast("binary").alias("text"), *carry)
    found = space.put(_sketches(rows, words, percent, carry), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key", "print", "n_shingles", "registers", "beside")
    nodes = found.where("digest is not null").groupBy("digest").agg(F.min(first).alias("f")).select("digest", "f.*")
    nodes = space.put(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    comps = _links(docs, nodes, space, words, percent, id_col, text_col)
    own = nodes.select("nid", "digest", F.struct("unknown", "doc_id", "key").alias("first"))
    if comps is None:
        heads = own.select("digest", "first")
    else:
        in_comp = space.put(own.join(comps.hint("merge"), "nid", "left").select("digest", "first", F.coalesce("comp", "nid").alias("comp")), "in_comp")
        least = space.put(in_comp.groupBy("comp").agg(F.min("first").alias("first")), "least")
        heads = in_comp.drop("first").join(least.hint("merge"), "comp").select("digest", "first")
    heads = space.put(heads, "heads")
    filled = found.where("digest is not null").select("doc_id", "n_shingles", "key", "digest", *carry).join(heads.hint("merge"), "digest")
    columns = ["doc_id", "n_shingles", "component_id", "kept", *carry]
    linked = filled.select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), (F.col("key") == F.col("first.key")).alias("kept"), *carry)
    empty = found.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), *carry)
    return linked.select(columns).union(empty.select(columns))
