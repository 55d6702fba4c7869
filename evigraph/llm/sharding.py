"""Sharding by a k-d tree over document metadata with distributed weighted medians.

What is dealt out are units: all rows of one text, or, where these outweigh a whole shard, pieces of them.  A node
that must yield k shards is cut along its widest metadata dimension (source, language, size, length; widths count in
parts of the root's) where the bytes to the left come to floor(k/2)/k of its own; equal values are ordered by
content checksum.  The cut points of
all nodes of a level are found at once by refining histograms: each pass counts bytes per node and bin in the
executors and brings at most nodes x bins numbers to the driver.

Units of more than ``HEAVY`` of a shard's bytes, of which there are at most shards / HEAVY, are placed on the driver:
along the same cut, with a few exchanged across it where that levels the sides.  All others are cut so that they
make up for what these leave unequal, and are assigned by a nested CASE expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.workspace import Workspace, keyed

#: Histogram bins in a pass, and the share of a shard's bytes by which a cut may miss its mark.
BINS, MISS = 2048, 0.001
#: The share of a shard's bytes from which on units are placed one by one, and that of a piece of a group that outweighs a shard.
HEAVY, PIECE = 0.0025, 0.002
#: Heavy units on a side up to which pairs of them are tried in exchanges.
FEW = 128
#: Rows that one task numbers at most, on average.
NUMBERED = 50_000
#: Numeric dimensions are logarithms in units of 1/4096, so that no long text makes all others look alike; names of languages
#: and sources have no order of their own and are ordered by their checksum.
DIMENSIONS = ("source_dim", "lang_dim", "size_dim", "chars_dim")
TIES = ("crc", "tie")
UNIT = ("h1", "h2", "piece")


@dataclass
class Unit:
    """A heavy unit: what identifies it, its bytes, its dimensions and ties."""

    key: tuple[int, int, int]
    bytes: int
    at: dict[str, int]


@dataclass
class Node:
    shards: int
    first: int
    heavy: list[Unit]
    light: int = 0
    dim: str = ""
    cut: list[tuple[str, int]] = field(default_factory=list)
    left: Node | None = None
    right: Node | None = None
    # The search for the cut.
    target: int | None = None
    keys: list[str] = field(default_factory=list)
    equal: list[int] = field(default_factory=list)
    lo: int = 0
    hi: int = 0
    below: int = 0

    def side(self) -> Column:
        """True for units left of the cut: (k0, k1, ...) < cut in the order of its keys."""
        cond = F.lit(False)
        for key, value in reversed(self.cut):
            at = F.lit(value).cast("bigint")
            cond = (F.col(key) < at) | ((F.col(key) == at) & cond)
        return cond


def _leaf(node: Node, value: Callable[[Node], Column]) -> Column:
    """The value that belongs to the innermost node that a unit falls into."""
    if node.left is None:
        return value(node)
    return F.when(node.side(), _leaf(node.left, value)).otherwise(_leaf(node.right, value))


def _bin(node: Node, number: int) -> Column:
    """number * BINS + the bin of a unit in the node's present search; null outside of it."""
    value = F.col(node.keys[len(node.equal)])
    inside = value.between(node.lo, node.hi)
    for name, v in zip(node.keys, node.equal, strict=False):
        inside &= F.col(name) == v
    width = -(-(node.hi - node.lo + 1) // BINS)
    # Differences of 64-bit keys may leave the range of a long; decimals don't.
    offset = (value.cast("decimal(20,0)") - F.lit(node.lo).cast("decimal(20,0)")) if node.hi - node.lo >= 2**62 else value - F.lit(node.lo).cast("bigint")
    return F.when(inside, F.floor(offset / F.lit(width)).cast("bigint") + number * BINS)


def _options(side: list[Unit]) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """What one side may give, with its bytes in ascending order: nothing, a unit, or, where there are few of them, two."""
    sizes = [u.bytes for u in side]
    found = [(0, ()), *((n, (i,)) for i, n in enumerate(sizes))]
    if len(side) <= FEW:
        found += [(sizes[i] + sizes[j], (i, j)) for i in range(len(side)) for j in range(i)]
    found.sort()
    return np.array([n for n, _ in found], np.int64), [places for _, places in found]


def _exchange(left: list[Unit], right: list[Unit], lack: float) -> float:
    """Exchange units, so that the left gains what it lacks; what it lacks then."""
    (a, out), (b, into) = _options(left), _options(right)
    wanted = a + lack
    at = np.clip(np.searchsorted(b, wanted), 1, max(1, len(b) - 1))
    at = np.minimum(at, len(b) - 1)
    near = np.where(np.abs(b[at - 1] - wanted) <= np.abs(b[at] - wanted), at - 1, at) if len(b) > 1 else at
    best = int(np.abs(b[near] - wanted).argmin())
    after = float(wanted[best] - b[near[best]])
    if abs(after) >= abs(lack):
        return lack
    gone, come = [left[i] for i in out[best]], [right[i] for i in into[near[best]]]
    left[:] = [u for i, u in enumerate(left) if i not in out[best]] + come
    right[:] = [u for i, u in enumerate(right) if i not in into[near[best]]] + gone
    return after


def _split_heavy(node: Node, light: dict[int, int], width: int, shard: float) -> tuple[list[Unit], list[Unit]]:
    """The heavy units of both sides, and the bytes of light ones that are wanted on the left.

    ``light`` has the bytes of light units by bin of the node's dimension.
    """
    goal = (node.light + sum(u.bytes for u in node.heavy)) * (node.shards // 2) / node.shards
    events = [(b, 1, n, None) for b, n in light.items()] + [((u.at[node.dim] - node.lo) // width, 0, u.bytes, u) for u in node.heavy]
    left: list[Unit] = []
    passed = 0
    for _, _, n, unit in sorted(events, key=lambda e: (e[0], e[1], e[3].at["crc"] if e[3] else 0, e[3].key if e[3] else (0, 0, 0))):
        if passed + n > goal:  # the unit that straddles the mark goes to the side that is nearer
            if unit is not None and goal - passed >= n / 2:
                left.append(unit)
            break
        passed += n
        if unit is not None:
            left.append(unit)
    have = set(map(id, left))
    right = [u for u in node.heavy if id(u) not in have]
    for _ in range(16):
        wanted = goal - sum(u.bytes for u in left)
        lack = wanted if wanted < 0 else max(0.0, wanted - node.light)
        if abs(lack) <= MISS * shard or _exchange(left, right, lack) == lack:
            break
    node.target = int(min(max(goal - sum(u.bytes for u in left), 0), node.light))
    return left, right


def _find_cuts(units: DataFrame, root: Node, nodes: list[Node], shard: float) -> dict[int, tuple[list[Unit], list[Unit]]]:
    """Give each node its cut, refining all searches together; the heavy units on either side of it by node."""
    searching, sides = list(nodes), {}
    while searching:
        numbers = {id(n): i for i, n in enumerate(searching)}
        binned = units.select("bytes", *TIES, _leaf(root, lambda n: _bin(n, numbers[id(n)]) if id(n) in numbers else F.lit(None).cast("bigint")).alias("bin"))
        ends = [f(k).alias(f"{f.__name__}_{k}") for k in TIES for f in (F.min, F.max)]
        counts: dict[int, dict[int, dict]] = {}
        for row in binned.where("bin is not null").groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"), *ends).collect():
            counts.setdefault(row["bin"] // BINS, {})[row["bin"] % BINS] = row
        still = []
        for i, n in enumerate(searching):
            width = -(-(n.hi - n.lo + 1) // BINS)
            found_bins = counts.get(i, {})
            if n.target is None:
                sides[id(n)] = _split_heavy(n, {b: r["bytes"] for b, r in found_bins.items()}, width, shard)
            if not found_bins:  # no light units
                n.cut = [(n.dim, n.lo)]
                continue
            before = n.below
            for b, found in sorted(found_bins.items()):
                after = before + found["bytes"]
                if after >= n.target:
                    break
                before = after
            edge, near_low = n.lo + b * width, n.target - before <= after - n.target
            key, miss = n.keys[len(n.equal)], min(n.target - before, after - n.target) / shard
            if miss <= MISS or found["rows"] == 1 or (width == 1 and key == n.keys[-1]):
                n.cut = [*zip(n.keys, n.equal, strict=False), (key, edge if near_low else edge + width)]
                continue
            n.below = before
            if width == 1:
                n.equal = [*n.equal, edge]
                key = n.keys[len(n.equal)]
                n.lo, n.hi = found[f"min_{key}"], found[f"max_{key}"]
            else:
                n.lo, n.hi = edge, min(n.hi, edge + width - 1)
            still.append(n)
        searching = still
    return sides


def _leaves(node: Node) -> list[Node]:
    return [node] if node.left is None else _leaves(node.left) + _leaves(node.right)


def build_tree(light: DataFrame, heavy: list[Unit], shards: int, shard: float) -> Node:
    """The tree over ``light`` units (bytes, DIMENSIONS, TIES) and heavy ones, whose leaves are single shards of ``shard`` bytes."""
    root, spread = Node(shards, 0, heavy), {}
    while any(n.shards > 1 for n in _leaves(root)):
        nodes = [n for n in _leaves(root) if n.shards > 1]
        numbers = {id(n): i for i, n in enumerate(nodes)}
        number = _leaf(root, lambda n: F.lit(numbers.get(id(n), -1)))
        ends = [f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]
        found = {r["node"]: r for r in light.withColumn("node", number).where("node >= 0").groupBy("node").agg(F.sum("bytes").alias("bytes"), *ends).collect()}
        for i, n in enumerate(nodes):
            r = found.get(i)
            n.light = r["bytes"] if r else 0
            own = {d: [u.at[d] for u in n.heavy] + ([r[f"min_{d}"], r[f"max_{d}"]] if r else []) for d in DIMENSIONS}
            widths = {d: max(v) - min(v) if v else 0 for d, v in own.items()}
            if n is root:
                spread = {d: max(1, w) for d, w in widths.items()}
            n.dim = max(DIMENSIONS, key=lambda d: widths[d] / spread[d])
            n.keys, n.equal, n.below = [n.dim, *TIES], [], 0
            n.lo, n.hi = (min(own[n.dim]), max(own[n.dim])) if own[n.dim] else (0, 0)
        sides = _find_cuts(light, root, nodes, shard)
        for n in nodes:
            half = n.shards // 2
            a, b = sides[id(n)]
            n.left, n.right = Node(half, n.first, a), Node(n.shards - half, n.first + half, b)
    return root


def _meta(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    body = text.cast("binary")
    bits = lambda n: F.floor(F.log2(n) * 4096).cast("bigint")
    names = {c.lower(): c for c in docs.columns}
    code = lambda c: F.crc32(F.coalesce(F.col(names[c]).cast("string"), F.lit("")).cast("binary")) if c in names else F.lit(0).cast("bigint")
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), (F.octet_length(body) + 16).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(11), body).alias("h2"),
        bits(F.octet_length(body) + 16).alias("size_dim"), bits(F.length(text) + 1).alias("chars_dim"), code("lang").alias("lang_dim"), code("source").alias("source_dim"), *carry)


def _units(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("size").alias("bytes"), F.min("text_crc32").alias("crc"), *(F.min(d).alias(d) for d in DIMENSIONS))


def kd_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, and the columns in ``carry``.

    The law is ``bytes``: the sizes (UTF-8 bytes of the text plus 16, a null text counting none) of the
    shards are near equal.  Rows of one text share a shard unless together they outweigh one.  ``slot`` numbers the
    rows of a shard from 0 without gaps.  ``grown_shard`` is null, as it belongs to another law.  Columns named
    ``lang`` and ``source`` are dimensions where there are such, nulls counting as empty.  Ids are integers; null
    and repeated ids get slots of their own, an empty table gives an empty result, other columns are ignored.
    """
    space = Workspace(docs.sparkSession, "kd")
    meta = space.put(_meta(docs, id_col, text_col, carry).withColumn("row", F.monotonically_increasing_id()), "meta")
    total = meta.agg(F.sum("size").alias("n"), F.count("*").alias("rows")).first()
    shard = max(1.0, (total["n"] or 0) / shards)
    groups = space.put(_units(meta, "h1", "h2"), "groups")
    # Groups that outweigh a shard: fewer than shards of them.
    split = groups.where(F.col("bytes") > shard).select("h1", "h2", F.ceil(F.col("bytes") / (PIECE * shard)).cast("bigint").alias("pieces"))
    split = F.broadcast(space.put(split, "split"))
    piece = F.pmod(F.xxhash64("doc_id", "row"), F.col("pieces"))
    pieces = meta.join(split, ["h1", "h2"]).withColumn("piece", piece)
    whole = groups.where(F.col("bytes") <= shard).withColumn("piece", F.lit(0).cast("bigint")).withColumn("tie", F.col("h1"))
    units = space.put(whole.unionByName(_units(pieces, *UNIT).withColumn("tie", F.col("piece"))), "units")
    is_heavy = F.col("bytes") > HEAVY * shard
    heavy = [Unit((r["h1"], r["h2"], r["piece"]), r["bytes"], {d: r[d] for d in (*DIMENSIONS, *TIES)}) for r in units.where(is_heavy).orderBy("crc", *UNIT).collect()]  # at most shards / HEAVY
    light = units.where(~is_heavy)
    root = build_tree(light, heavy, shards, shard)
    fixed = [(*u.key, n.first) for n in _leaves(root) for u in n.heavy]
    schema = "h1 bigint, h2 bigint, piece bigint, shard int"
    placed_heavy = docs.sparkSession.createDataFrame(fixed, schema)
    to = space.put(light.select(*UNIT, _leaf(root, lambda n: F.lit(n.first)).cast("int").alias("shard")).unionByName(placed_heavy), "to")
    # Rows of split groups and of heavy units find their shard in a table of bounded size, all others by a shuffle
    # in which no text weighs more than HEAVY of a shard.
    known = to.join(split.select("h1", "h2").withColumn("was_split", F.lit(True)), ["h1", "h2"], "left")
    few = F.broadcast(known.where("was_split").select(*UNIT, "shard").unionByName(placed_heavy).distinct())
    rows = meta.join(split, ["h1", "h2"], "left").withColumn("piece", F.coalesce(piece, F.lit(0).cast("bigint"))).drop("pieces")
    sought = rows.join(few, list(UNIT), "left")
    columns = ["doc_id", "size", "text_crc32", "row", "shard", *carry]
    many = sought.where("shard IS NULL").drop("shard").join(to.hint("merge"), list(UNIT)).select(columns)
    parts = max(1, -(-total["rows"] // (NUMBERED * shards)))
    placed = space.put(sought.where("shard IS NOT NULL").select(columns).unionByName(many).withColumn("part", F.pmod(F.xxhash64("doc_id", "row"), F.lit(parts))), "placed")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size", "row")) - 1
    return placed.withColumn("within", within).join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("within")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *carry)


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` to ``path`` in one folder ``shard=<n>`` for each shard, in the order of slots.

    Rows are matched by their place in the table's files, so null and repeated ids lose no row.  An empty table writes
    none.  Where ``docs`` has a column ``shard`` of its own, folders are named ``shard_``.
    """
    name = "shard_" if "shard" in {c.lower() for c in docs.columns} else "shard"
    rows, key = keyed(docs, Workspace(docs.sparkSession, "shards"))
    own = kd_shards(rows, shards, id_col, text_col, key).select(*key, F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    placed = rows.join(own.hint("merge"), list(key)).repartition("_shard", F.floor(F.col("_slot") / NUMBERED)).sortWithinPartitions("_shard", "_slot")
    placed.drop(*key, "_slot").withColumnRenamed("_shard", name).write.partitionBy(name).parquet(path)
