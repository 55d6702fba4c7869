"""URL filters over a sorted array of 64-bit digests.

A rule is a host with a path prefix, such as ``example.com/en/``.  The array holds the xxhash64 digests of
the rules' strings in order, beside the strings themselves.  Executors fetch it once as a file and map it
into memory, so all Python workers of a machine share its pages.  For every URL the strings that a rule
could have (host suffixes at label borders, with path prefixes of the lengths that rules have) are
hashed, found by vectorised binary search, and confirmed against the stored strings.
A list beyond ``MAX_LIST_BYTES`` isn't shipped: ``judge_by_join`` looks candidates up with a shuffled join.  ``judge``
takes a table of rules, measures it, and goes one way or the other; both give the same result.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.workspace import ROW_KEY, Workspace, filed, located

#: Rules of at most so many bytes in all are sent to executors.
MAX_LIST_BYTES = 512 << 20
PARTS = "keys", "starts", "text", "actions"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class DigestArray:
    """Rules in the order of their digests; ``mapped`` opens a saved one without reading it."""

    def __init__(self, keys: np.ndarray, starts: np.ndarray, text: np.ndarray, actions: np.ndarray) -> None:
        self.keys, self.starts, self.text, self.actions = keys, starts, text, actions

    @classmethod
    def of(cls, rules: list[tuple[str, bool]]) -> DigestArray:
        """``rules``: (host and path prefix, whether it blocks).  A rule that is given with both actions blocks."""
        whole: dict[bytes, bool] = {}
        for rule, blocks in rules:
            whole[rule.encode()] = whole.get(rule.encode(), False) or blocks
        order = sorted(whole, key=lambda r: (xxhash.xxh64_intdigest(r), r))
        keys = np.fromiter((xxhash.xxh64_intdigest(r) for r in order), np.uint64, len(order))
        starts = np.cumsum([0, *map(len, order)], dtype=np.int64)
        return cls(keys, starts, np.frombuffer(b"".join(order), np.uint8), np.fromiter((whole[r] for r in order), np.bool_, len(order)))

    def save(self, stem: str) -> list[str]:
        names = []
        for part in PARTS:
            np.save(name := f"{stem}-{part}.npy", getattr(self, part))
            names.append(name)
        return names

    @classmethod
    def mapped(cls, stem: str) -> DigestArray:
        return cls(*(np.load(f"{stem}-{part}.npy", mmap_mode="r") for part in PARTS))

    def rule(self, i: int) -> bytes:
        return self.text[self.starts[i] : self.starts[i + 1]].tobytes()

    def find(self, wanted: list[bytes]) -> np.ndarray:
        """The place of each string, or -1."""
        if not wanted or not len(self.keys):
            return np.full(len(wanted), -1, np.int64)
        digests = np.fromiter(map(xxhash.xxh64_intdigest, wanted), np.uint64, len(wanted))
        at = np.searchsorted(self.keys, digests)
        hit = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digests))
        found = np.full(len(wanted), -1, np.int64)
        for k in hit:
            i = int(at[k])
            while i < len(self.keys) and self.keys[i] == digests[k]:  # equal digests of unequal strings stand side by side
                if self.rule(i) == wanted[k]:
                    found[k] = i
                    break
                i += 1
        return found


def _shape(rules: list[tuple[str, bool]]) -> tuple[set[int], set[int]]:
    """How many labels the rules' hosts have, and how many characters their paths."""
    hosts = [r.partition("/") for r, _ in rules]
    return {h.count(".") + 1 for h, _, _ in hosts}, {len(s) + len(p) for _, s, p in hosts}


def candidates(host: str, path: str, labels: set[int], lengths: set[int]) -> list[bytes]:
    """The strings of the rules that would fit, longest first; of equally long ones the longer host first."""
    parts = host.split(".")
    fits = [(".".join(parts[-n:]), path[:k]) for n in labels if n <= len(parts) for k in lengths if k <= len(path)]
    return [(h + p).encode() for h, p in sorted(fits, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))]


def ship(spark: SparkSession, rules: list[tuple[str, bool]]) -> str:
    """Save the digest array and have every executor fetch it; the name to open it by.

    The folder is the driver's own; executors get copies of the files from the driver, into folders of their own.
    """
    stem = f"urls-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp(prefix="evigraph-urls-")
    atexit.register(shutil.rmtree, folder, True)
    for name in DigestArray.of(rules).save(f"{folder}/{stem}"):
        spark.sparkContext.addFile(f"file://{Path(name).resolve()}")
    return stem


def _bytes(rules: list[tuple[str, bool]]) -> int:
    return sum(len(r.encode()) for r, _ in rules)


def judge(pages: DataFrame, rules: DataFrame, default_blocks: bool = False, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """As ``judge_urls``, for a table of rules (rule string, blocks boolean) of any size; null rules are passed over, a null action allows."""
    rules = rules.where("rule IS NOT NULL").select("rule", F.coalesce("blocks", F.lit(False)).alias("blocks"))
    if rules.agg(F.coalesce(F.sum(F.octet_length("rule")), F.lit(0))).first()[0] > MAX_LIST_BYTES:
        return judge_by_join(pages, rules, default_blocks, id_col, url_col)
    return judge_urls(pages, [(r["rule"], r["blocks"]) for r in rules.toLocalIterator()], default_blocks, id_col, url_col)


def judge_urls(pages: DataFrame, rules: list[tuple[str, bool]], default_blocks: bool = False, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    ``rules``: (host and path prefix, whether it blocks).  A rule fits its host and all subdomains if the
    path starts with its own; the longest wins, of equally long ones that with the longer host; a rule that is
    given with both actions blocks.  Where none fits, the rule is null and the verdict the default.  A null URL, or
    one without ``://``, has an empty host and path.  Null and repeated ids each get their row, an empty table
    gives an empty result; other columns are ignored.  More than MAX_LIST_BYTES of rules go through a join.
    """
    if _bytes(rules) > MAX_LIST_BYTES:
        return judge_by_join(pages, pages.sparkSession.createDataFrame(rules, "rule string, blocks boolean"), default_blocks, id_col, url_col)
    stem, (labels, lengths) = ship(pages.sparkSession, rules), _shape(rules)
    words = "allow", "block"

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray.mapped(SparkFiles.get(f"{stem}-keys.npy").removesuffix("-keys.npy"))
        for batch in batches:
            wanted, owner = [], []
            for i, (host, path) in enumerate(zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)):
                own = candidates(host, path, labels, lengths)
                wanted += own
                owner += [i] * len(own)
            rule, verdict = [None] * batch.num_rows, [words[default_blocks]] * batch.num_rows
            found = array.find(wanted)
            for k in np.flatnonzero(found >= 0)[::-1]:  # the first, which is the longest, is set last
                rule[owner[k]], verdict[owner[k]] = wanted[k].decode(), words[int(array.actions[found[k]])]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["host"], batch["path"], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    parsed = pages.select(F.col(id_col).cast("bigint").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    return parsed.mapInArrow(probe, "page_id bigint, host string, path string, rule string, verdict string")


def judge_by_join(pages: DataFrame, rules: DataFrame, default_blocks: bool = False, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """As ``judge_urls``, for a table of rules (rule string, blocks boolean) too large to ship.

    Candidates are joined on digest and string by a shuffle; pages are told apart by their place in the table's
    files, so null and repeated ids each get their own answer.
    """
    rules = rules.groupBy("rule").agg(F.bool_or("blocks").alias("blocks"))
    host, rest = F.substring_index("rule", "/", 1), F.length("rule") - F.length(F.substring_index("rule", "/", 1))
    shape = rules.agg(F.collect_set(F.size(F.split(host, r"\."))).alias("labels"), F.collect_set(rest).alias("lengths")).first()  # lengths of hosts and paths, not rules
    space = Workspace(pages.sparkSession, "urls")
    parsed = located(filed(pages, space), F.col(id_col).cast("bigint").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    hosts = F.explode(F.array(F.lit(None).cast("string"), *[F.when(F.size(F.split("host", r"\.")) >= n, F.substring_index("host", ".", -n)) for n in shape["labels"]]))
    paths = F.explode(F.array(F.lit(None).cast("string"), *[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in shape["lengths"]]))
    tried = parsed.select(*ROW_KEY, "path", hosts.alias("h")).where("h is not null").select(*ROW_KEY, "h", paths.alias("p")).where("p is not null")
    tried = tried.select(*ROW_KEY, F.concat("h", "p").alias("rule"), F.length("h").alias("n_host")).withColumn("digest", F.xxhash64("rule"))
    best = tried.join(rules.withColumn("digest", F.xxhash64("rule")).hint("merge"), ["digest", "rule"]).groupBy(*ROW_KEY).agg(F.max(F.struct(F.length("rule").alias("n"), "n_host", "rule", "blocks")).alias("b"))
    blocks = F.coalesce("b.blocks", F.lit(default_blocks))
    return parsed.join(best.hint("merge"), list(ROW_KEY), "left").select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.when(blocks, "block").otherwise("allow").alias("verdict"))
