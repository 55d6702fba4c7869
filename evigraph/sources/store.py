"""Versioned tables in a folder that the cluster shares: appended logs, keyed rewrites as new versions, a schema version.

A table is a folder of versions, each a folder of Parquet files; the highest complete one counts.  Logs are appended to;
anything else is made anew from what it was, so readers never see half a change and an earlier version can be read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions.text import clean_quote

SCHEMA_VERSION = 1
#: Tables and their columns.
TABLES = {
    "schema_meta": "key string, value string",
    "runs": "run_id bigint, stage string, status string, started timestamp, finished timestamp, model string, n_calls bigint, n_repairs bigint, n_failures bigint",
    "claims": "record_id bigint, run_id bigint, up_name string, down_name string, up_id bigint, down_id bigint, doi string, direction string, relation_kind string, evidence_type string, contradicts boolean, origin string, entered_by string, rationale string",
    "spans": "span_id bigint, record_id bigint, field string, quote string, verified boolean, ratio double, page int",
    "record_history": "history_id bigint, record_id bigint, action string, reason string, curator string, payload string, archived_at timestamp",
    "outcomes": "run_id bigint, filename string, doi string, category string, reason string, n_claims bigint",
    "abbreviations": "doi string, abbrev string, long_form string, stored_at timestamp",
    "canonical": "canonical_id bigint, canonical_name string, level string, status string, curie string, n_source_rows bigint",
    "alias": "canonical_id bigint, raw_label string, n_uses bigint",
    "directions": "canonical_id bigint, direction string, curator string, rationale string",
    "mappings": "mapping_id bigint, canonical_id bigint, relation string, curie string, label string",
    "relations": "source_id bigint, target_id bigint, relation string, curator string",
    "decisions": "decision_id bigint, action string, members array<bigint>, survivor bigint, relationship string, curator string, rationale string, before_state string, after_state string, reverted boolean",
    "syntheses": "ker_key string, body string, confidence string, record_ids array<bigint>, stale boolean, stale_reason string, run_id bigint",
    "synthesis_history": "ker_key string, payload string, reason string",
    "states": "target_type string, target_key string, state string, approved_hash string, approved_by string",
    "approvals": "target_type string, target_key string, from_state string, to_state string, curator string, note string, logged_at timestamp",
    "layouts": "layout string, node string, x double, y double, pinned boolean",
    "links": "canonical_id bigint, provider string, curie string, url string",
    "snapshots": "name string, payload string, hash string, stale boolean, stale_reason string",
    "chunks": "filename string, chunk int, run_id bigint, doi string, section string, text string, stored_at timestamp"}
#: Keys by which tables are rewritten.
KEYS = {
    "schema_meta": ("key",), "runs": ("run_id",), "claims": ("record_id",), "spans": ("span_id",), "abbreviations": ("doi", "abbrev"), "canonical": ("canonical_id",), "alias": ("canonical_id", "raw_label"), "directions": ("canonical_id",),
    "mappings": ("mapping_id",), "relations": ("source_id", "target_id", "relation"), "decisions": ("decision_id",), "syntheses": ("ker_key",), "states": ("target_type", "target_key"), "layouts": ("layout", "node"), "links": ("canonical_id", "provider", "curie"), "snapshots": ("name",),
    "chunks": ("filename", "chunk", "run_id")}
# What a claim is taken to say where it doesn't, and outcomes that there are.
CLAIM_DEFAULTS = {"direction": "unclear", "relation_kind": "causal", "evidence_type": "not_stated"}
CATEGORIES = ("saved", "no_mechanism", "truncated", "unparsed", "provider_error", "no_text", "declined", "skipped", "unknown")
LONGEST_REASON = 1000


class SchemaTooNew(RuntimeError):
    """The folder was written by a later version of this library."""


class Store:
    """The tables of one corpus."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        path = self._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def open(self) -> Store:
        """Make what isn't there; refuse a folder of a later version; columns that an earlier one lacked are null when read."""
        known = {r.key: r.value for r in self.read("schema_meta").collect()}
        if int(known.get("version", SCHEMA_VERSION)) > SCHEMA_VERSION:
            raise SchemaTooNew(f"version {known['version']}, this library knows {SCHEMA_VERSION}")
        if "version" not in known:
            self.upsert("schema_meta", [("version", str(SCHEMA_VERSION))])
        return self

    def _path(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def versions(self, name: str) -> list[int]:
        """The complete versions of a table, oldest first."""
        folder = self._path(name)
        if not self._fs.exists(folder):
            return []
        found = [s.getPath() for s in self._fs.listStatus(folder)]
        return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and self._fs.exists(self._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as it is, or as it was in an earlier version."""
        have = self.versions(name)
        if not have:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}/v{version or have[-1]}")

    def lookup(self, name: str, **keys: object) -> DataFrame:
        """The rows of a table with given values."""
        rows = self.read(name)
        for column, value in keys.items():
            rows = rows.where(F.col(column).eqNullSafe(F.lit(value)))
        return rows

    def frame(self, name: str, rows: DataFrame | list) -> DataFrame:
        """Rows in the columns of a table; columns they lack are null."""
        if not isinstance(rows, DataFrame):
            return self.spark.createDataFrame(rows, TABLES[name])
        schema = self.spark.createDataFrame([], TABLES[name]).schema
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))

    def append(self, name: str, rows: DataFrame | list) -> None:
        """Add rows to a log."""
        have = self.versions(name)
        self.frame(name, rows).write.mode("append").parquet(f"{self.root}/{name}/v{have[-1] if have else 1}")

    def replace(self, name: str, rows: DataFrame | list) -> int:
        """Make a new version of a table; its number."""
        new = (self.versions(name) or [0])[-1] + 1
        self.frame(name, rows).write.parquet(f"{self.root}/{name}/v{new}")
        return new

    def upsert(self, name: str, rows: DataFrame | list, keep: tuple[str, ...] | None = None) -> int:
        """Replace the rows with the keys of ``rows``, of which each key has one, and add the others.

        Columns in ``keep`` (all others than the keys, if it isn't given) keep what they were where the new row has null.
        """
        keys, new = list(KEYS[name]), self.frame(name, rows)
        kept = [c for c in new.columns if c not in keys] if keep is None else list(keep)
        old = self.read(name).withColumnsRenamed({c: f"_{c}" for c in new.columns if c not in keys})
        both = old.join(new.withColumn("_new", F.lit(True)), keys, "full_outer")
        value = lambda c: F.when(F.col("_new"), F.coalesce(c, f"_{c}") if c in kept else F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
        return self.replace(name, both.select(*(F.col(c) if c in keys else value(c) for c in new.columns)))

    def delete(self, name: str, keys: DataFrame) -> int:
        """Drop the rows that ``keys`` names by some of the table's columns."""
        return self.replace(name, self.read(name).join(keys, keys.columns, "left_anti"))

    def update(self, name: str, where: Column, **values: object) -> int:
        """Set columns of the rows that fulfil a condition."""
        made = {c: F.when(where, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}
        return self.replace(name, self.read(name).withColumns(made))


def insert_claims(store: Store, claims: DataFrame, spans: DataFrame | None = None) -> None:
    """Append claims with their defaults, and their quotations, without control characters."""
    plain = claims.withColumns({c: F.coalesce(c, F.lit(v)) if c in claims.columns else F.lit(v) for c, v in CLAIM_DEFAULTS.items()})
    texts = [f.name for f in plain.schema if f.dataType.simpleString() == "string"]
    store.append("claims", plain.withColumns({c: F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "") for c in texts}))
    if spans is not None:
        store.append("spans", spans.withColumn("quote", clean_quote(F.col("quote"))))


def record_outcomes(store: Store, outcomes: DataFrame) -> None:
    """Append what became of papers: unknown categories are ``unknown``, long reasons are cut."""
    known = F.when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise("unknown")
    store.append("outcomes", outcomes.withColumns({"category": known, "reason": F.substring("reason", 1, LONGEST_REASON)}))


def store_latest(store: Store, name: str, rows: DataFrame, at: str = "stored_at") -> None:
    """Upsert rows of which the latest counts for each key; rows without a key are passed over.  A null in a key never equals another."""
    keys = list(KEYS[name])
    named = rows
    for c in keys:
        if dict(rows.dtypes)[c] == "string":
            named = named.where(F.coalesce(F.trim(c), F.lit("")) != "")
    columns = [c for c in rows.columns if c not in keys]
    last = named.groupBy(*keys).agg(F.max_by(F.struct(*columns), at).alias("l")).select(*keys, "l.*")
    store.upsert(name, last)


def start_run(store: Store, run_id: int, stage: str, model: str) -> None:
    store.append("runs", store.spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(stage).alias("stage"), F.lit("running").alias("status"), F.current_timestamp().alias("started"), F.lit(model).alias("model")))


def finish_run(store: Store, run_id: int, status: str, counters: dict[str, int]) -> None:
    """Close a run with its counters."""
    store.update("runs", F.col("run_id") == run_id, status=status, finished=F.current_timestamp(), **{c: F.lit(n).cast("bigint") for c, n in counters.items()})


def close_orphans(store: Store) -> None:
    """Runs that never ended are interrupted."""
    store.update("runs", F.col("status") == "running", status="interrupted")


def archive(store: Store, records: DataFrame, action: str, reason: str, curator: str) -> None:
    """Append claims (record_id) with their quotations as JSON to the history."""
    spans = store.read("spans").groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("span_id", "quote"))).alias("spans"))  # of one claim
    rows = store.read("claims").join(records.select("record_id").distinct(), "record_id", "left_semi").join(spans, "record_id", "left")
    base = store.read("record_history").agg(F.coalesce(F.max("history_id"), F.lit(0))).first()[0]
    made = rows.select("record_id", F.to_json(F.struct(*rows.columns)).alias("payload"))
    store.append("record_history", made.select((F.monotonically_increasing_id() + base + 1).alias("history_id"), "record_id", F.lit(action).alias("action"), F.lit(reason).alias("reason"), F.lit(curator).alias("curator"), "payload", F.current_timestamp().alias("archived_at")))


def delete_records(store: Store, records: DataFrame, reason: str, curator: str) -> None:
    """Archive claims and delete them with their quotations; edges on them are invalidated."""
    invalidate_edges(store, store.read("claims").join(records, "record_id", "left_semi"), reason)
    archive(store, records, "delete", reason, curator)
    for name in ("spans", "claims"):
        store.delete(name, records.select("record_id"))


def update_claim(store: Store, record_id: int, changes: dict[str, object], curator: str, rationale: str) -> bool:
    """Edit a claim after archiving what it was; nothing is written where nothing changes.  Whether anything did."""
    row = store.lookup("claims", record_id=record_id).first()
    moved = {c: v for c, v in changes.items() if row is not None and c in row and row[c] != v and c != "record_id"}
    if not moved:
        return False
    one = store.spark.range(1).select(F.lit(record_id).cast("bigint").alias("record_id"))
    archive(store, one, "edit", rationale, curator)
    store.update("claims", F.col("record_id") == record_id, **moved, origin="curator_edited", rationale=rationale)
    invalidate_edges(store, store.lookup("claims", record_id=record_id), rationale)
    return True


def invalidate_edges(store: Store, claims: DataFrame, reason: str) -> None:
    """Mark the syntheses of the edges of ``claims`` (up_id, down_id) stale."""
    mark_stale(store, claims.select(F.concat_ws("->", "up_id", "down_id").alias("ker_key")).distinct(), reason)


def mark_stale(store: Store, keys: DataFrame, reason: str) -> None:
    """Archive syntheses (ker_key), flag them, take their states back to approved, and flag all snapshots."""
    fresh = store.read("syntheses").where("NOT coalesce(stale, false)").join(keys, "ker_key", "left_semi")
    hit = fresh.select("ker_key", F.to_json(F.struct(*fresh.columns)).alias("payload")).collect()  # syntheses of the edges that were changed in one action
    if not hit:
        return
    store.append("synthesis_history", [(r.ker_key, r.payload, reason) for r in hit])
    names = [r.ker_key for r in hit]
    store.update("syntheses", F.col("ker_key").isin(names), stale=True, stale_reason=reason)
    store.update("states", (F.col("target_type") == "ker") & F.col("target_key").isin(names) & (F.col("state") == "synthesized"), state="approved")
    store.update("snapshots", ~F.coalesce("stale", F.lit(False)), stale=True, stale_reason=reason)


def invalidate_event(store: Store, canonical_id: int, reason: str) -> None:
    """Mark all syntheses that rest on an event stale."""
    ends = F.split("ker_key", "->")
    mark_stale(store, store.read("syntheses").where((F.get(ends, 0) == str(canonical_id)) | (F.get(ends, 1) == str(canonical_id))).select("ker_key"), reason)


def save_synthesis(store: Store, ker_key: str, body: str, confidence: str, record_ids: list[int], run_id: int | None) -> None:
    """Store an assessment, which is fresh again; an earlier one is replaced."""
    store.upsert("syntheses", [(ker_key, body, confidence, record_ids, False, None, run_id)], keep=())


def synthesis_markdown(store: Store, ker_key: str) -> str:
    """An assessment as Markdown; empty if there is none."""
    row = store.lookup("syntheses", ker_key=ker_key).first()
    return "" if row is None else f"## {row.ker_key}\n\n{row.body}\n\nConfidence: {row.confidence or '—'}\n" + (f"\nStale: {row.stale_reason}\n" if row.stale else "")


RULINGS = ("increased", "decreased", "conflicted")


def set_direction(store: Store, canonical_id: int, direction: str, curator: str, rationale: str) -> None:
    """A curator's ruling on which way an event moves."""
    if direction not in RULINGS:
        raise ValueError(f"one of {RULINGS}")
    store.upsert("directions", [(canonical_id, direction, curator, rationale)])


def clear_direction(store: Store, canonical_id: int) -> None:
    store.replace("directions", store.read("directions").where(F.col("canonical_id") != canonical_id))


def record_decision(store: Store, action: str, members: list[int], curator: str, rationale: str, survivor: int | None = None, relationship: str | None = None, before: str | None = None, after: str | None = None) -> int:
    """Append a decision on events (keep separate, unresolved, merge, reject ...); its number."""
    number = store.read("decisions").agg(F.coalesce(F.max("decision_id"), F.lit(0))).first()[0] + 1
    store.append("decisions", [(number, action, members, survivor, relationship, curator, rationale, before, after, False)])
    return number


def reject_event(store: Store, canonical_id: int, curator: str, rationale: str) -> int:
    """An event that is none: its status, the syntheses on it, and the decision."""
    store.update("canonical", F.col("canonical_id") == canonical_id, status="rejected")
    invalidate_event(store, canonical_id, rationale)
    return record_decision(store, "reject", [canonical_id], curator, rationale)


def rename_event(store: Store, canonical_id: int, name: str, layout: str | None = None) -> None:
    """Give an event another name, in drawings as well."""
    old = store.lookup("canonical", canonical_id=canonical_id).first()
    store.update("canonical", F.col("canonical_id") == canonical_id, canonical_name=name)
    if old is not None:
        store.update("layouts", (F.col("node") == old.canonical_name) & (F.lit(layout is None) | (F.col("layout") == layout)), node=name)


def export_layout(store: Store, layout: str) -> str:
    """A drawing's places as JSON."""
    rows = store.lookup("layouts", layout=layout).select(F.to_json(F.sort_array(F.collect_list(F.struct("node", "x", "y", "pinned")))).alias("j"))  # events on one map
    return rows.first().j


def import_layout(store: Store, payload: str, layout: str) -> int:
    """Places out of JSON, replacing those of the same nodes; how many."""
    read = store.spark.range(1).select(F.explode(F.from_json(F.lit(payload), "array<struct<node:string,x:double,y:double,pinned:boolean>>")).alias("p")).select(F.lit(layout).alias("layout"), "p.*").where("node IS NOT NULL")
    store.upsert("layouts", read)
    return read.count()


def copy_layout(store: Store, source: str, destination: str) -> None:
    store.upsert("layouts", store.lookup("layouts", layout=source).withColumn("layout", F.lit(destination)))


def freeze(store: Store, name: str, nodes: DataFrame, edges: DataFrame) -> None:
    """Keep a graph under a name, with a fingerprint of its content."""
    listed = lambda frame: frame.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*sorted(frame.columns))))).alias("j")).first().j  # one drawn map
    payload = f'{{"nodes": {listed(nodes)}, "edges": {listed(edges)}}}'
    store.upsert("snapshots", store.spark.range(1).select(F.lit(name).alias("name"), F.lit(payload).alias("payload"), F.substring(F.sha2(F.lit(payload), 256), 1, 32).alias("hash"), F.lit(False).alias("stale")), keep=())


def contents(store: Store) -> DataFrame:
    """(name, n_rows, n_chars) of all tables: what a database would give away if it were published."""
    parts = []
    for name in TABLES:
        rows = store.read(name)
        chars = sum((F.coalesce(F.sum(F.length(f.name)), F.lit(0)) for f in rows.schema if f.dataType.simpleString() == "string"), F.lit(0))
        parts.append(rows.agg(F.count("*").alias("n_rows"), chars.alias("n_chars")).select(F.lit(name).alias("name"), "n_rows", "n_chars"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
