"""Queries over workflow, histories and merges; events are the rows of ``canonical``, requests those of ``workflow_log``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions import labels as L
from evigraph.operators import workflow as W
from evigraph.plans.labels import polarity_sql
from evigraph.plans.registry import query

TARGET = ("target_type", "target_id")


@query("state_machine", "workflow_log")
def state_machine(log: DataFrame) -> DataFrame:
    return W.transitions(log, *TARGET).select(*TARGET, "log_id", "from_state", F.col("state").alias("to_state"), "accepted", "invalidates")


@query("gated_states", "workflow_log")
def gated_states(log: DataFrame) -> DataFrame:
    """The state that each target has come to by accepted requests."""
    return W.present(W.transitions(log, *TARGET), *TARGET)


HASHES = """al AS (SELECT canonical_id, string_agg(raw_label, ';' ORDER BY raw_label) AS labels FROM {0} GROUP BY 1),
    hashes AS (SELECT c.canonical_id, substr(sha256(concat_ws('|', canonical_name, level, coalesce(curie, ''), coalesce(CAST(wiki_id AS VARCHAR), ''), coalesce(labels, ''))), 1, 32) AS hash FROM canonical c LEFT JOIN al ON al.canonical_id = c.canonical_id)"""


@query("ke_hash", "canonical", "alias", sql=f"WITH {HASHES.format('alias')} SELECT canonical_id, hash FROM hashes")
def ke_hash(canonical: DataFrame, alias: DataFrame) -> DataFrame:
    return W.event_hash(canonical, alias)


PAIRS = "p AS (SELECT DISTINCT up_id, down_id FROM claims)"


@query("ker_hash", "canonical", "alias", "claims", sql=f"WITH {HASHES.format('alias')}, {PAIRS} SELECT up_id || '->' || down_id AS ker_key, substr(sha256(concat_ws('|', up_id || '->' || down_id, coalesce(u.hash, ''), coalesce(d.hash, ''))), 1, 32) AS hash FROM p LEFT JOIN hashes u ON u.canonical_id = up_id LEFT JOIN hashes d ON d.canonical_id = down_id")
def ker_hash(canonical: DataFrame, alias: DataFrame, claims: DataFrame) -> DataFrame:
    edges = claims.select("up_id", "down_id").distinct().withColumn("ker_key", F.concat_ws("->", "up_id", "down_id"))
    return W.edge_hash(edges, W.event_hash(canonical, alias))


OLD = "old AS (SELECT canonical_id, hash AS approved_hash FROM (WITH {0} SELECT * FROM hashes))".format(HASHES.format("(SELECT * FROM alias WHERE n_uses % 5 <> 0)"))
LATEST = "latest AS (SELECT target_id AS canonical_id, arg_max(state, (logged_at, log_id)) AS state FROM workflow_log WHERE target_type = 'ke' GROUP BY 1)"
FRAME = f"""{HASHES.format('alias')}, {OLD}, {LATEST},
    frame AS (SELECT c.canonical_id, coalesce(state, 'raw') AS state, hash AS fingerprint, coalesce(state IN ('approved', 'synthesized') AND approved_hash <> hash, false) AS drifted FROM canonical c LEFT JOIN latest USING (canonical_id) LEFT JOIN old USING (canonical_id) LEFT JOIN hashes USING (canonical_id))"""


def frame(canonical: DataFrame, alias: DataFrame, log: DataFrame) -> DataFrame:
    """Events with their states; approvals rest on the labels that there were then, some of which have been added since."""
    last = log.where("target_type = 'ke'").groupBy(F.col("target_id").alias("canonical_id")).agg(F.max_by("state", F.struct("logged_at", "log_id")).alias("state"))
    approved = W.event_hash(canonical, alias.where("n_uses % 5 <> 0")).withColumnRenamed("hash", "approved_hash")
    states = canonical.select("canonical_id").join(last, "canonical_id", "left").join(approved, "canonical_id", "left").withColumn("state", F.coalesce("state", F.lit("raw")))
    return W.effective(states, W.event_hash(canonical, alias), "canonical_id")


@query("state_frame", "canonical", "alias", "workflow_log", sql=f"WITH {FRAME} SELECT canonical_id, state, CASE WHEN drifted THEN 'curated' ELSE state END AS effective_state, fingerprint FROM frame")
def state_frame(canonical: DataFrame, alias: DataFrame, log: DataFrame) -> DataFrame:
    return frame(canonical, alias, log).select("canonical_id", "state", "effective_state", F.col("hash").alias("fingerprint"))


@query("drifted", "canonical", "alias", "workflow_log", sql=f"WITH {FRAME} SELECT canonical_id, drifted FROM frame")
def drifted(canonical: DataFrame, alias: DataFrame, log: DataFrame) -> DataFrame:
    return frame(canonical, alias, log).select("canonical_id", "drifted")


@query("cascade_invalidate", "claims", "canonical", "alias", "workflow_log", sql=f"""WITH {FRAME}, {PAIRS}, r AS (SELECT canonical_id FROM frame WHERE drifted)
    SELECT up_id, down_id, (up_id + down_id) % 10 = 0 OR up_id IN (SELECT canonical_id FROM r) OR down_id IN (SELECT canonical_id FROM r) AS stale FROM p""")
def cascade_invalidate(claims: DataFrame, canonical: DataFrame, alias: DataFrame, log: DataFrame) -> DataFrame:
    """Syntheses of edges after drifted events were retracted: stale if they were, or if an event on either end is retracted."""
    syntheses = claims.select("up_id", "down_id").distinct().withColumn("stale", (F.col("up_id") + F.col("down_id")) % 10 == 0)
    retracted = frame(canonical, alias, log).where("drifted").select(F.col("canonical_id").alias("event_id"), F.lit("changed since its approval").alias("reason"))
    return W.invalidated(syntheses, retracted).select("up_id", "down_id", "stale")


@query("scd2_history", "workflow_log", sql="""WITH o AS (SELECT target_id, state, note, logged_at, log_id, lag(state) OVER w AS s0, lag(note) OVER w AS n0, row_number() OVER w AS k FROM workflow_log WINDOW w AS (PARTITION BY target_id ORDER BY logged_at, log_id)),
    c AS (SELECT * FROM o WHERE k = 1 OR state IS DISTINCT FROM s0 OR note IS DISTINCT FROM n0)
    SELECT target_id, row_number() OVER v AS version, state, note, logged_at AS valid_from, lead(logged_at) OVER v AS valid_to, lead(log_id) OVER v IS NULL AS is_current FROM c WINDOW v AS (PARTITION BY target_id ORDER BY logged_at, log_id)""")
def scd2_history(log: DataFrame) -> DataFrame:
    return W.versions(log, "target_id", ["logged_at", "log_id"], "state", "note")


@query("archive_json", "claims", sql="SELECT record_key, to_json({'record_id': record_id, 'up_name': up_name, 'doi': coalesce(doi, ''), 'contradicts': contradicts}) AS payload FROM claims WHERE contradicts")
def archive_json(claims: DataFrame) -> DataFrame:
    """Claims that are deleted or edited, as JSON for their history."""
    return claims.where("contradicts").select("record_key", F.to_json(F.struct("record_id", "up_name", F.coalesce("doi", F.lit("")).alias("doi"), "contradicts")).alias("payload"))


@query("cascade_delete", "claims", sql="SELECT up_id, count(*) AS n_left, CAST(sum(n_spans) AS BIGINT) AS n_spans FROM claims WHERE NOT (contradicts AND run_id % 2 = 0) GROUP BY up_id")
def cascade_delete(claims: DataFrame) -> DataFrame:
    """What is left by event once claims and, with them, their spans are deleted."""
    doomed = claims.where("contradicts AND run_id % 2 = 0").select("record_key")
    return claims.join(doomed, "record_key", "left_anti").groupBy("up_id").agg(F.count("*").alias("n_left"), F.sum("n_spans").alias("n_spans"))


@query("snapshot_json", "canonical", "alias", sql="""SELECT c.canonical_id, to_json({'name': canonical_name, 'level': coalesce(level, ''), 'aliases': coalesce(a.l, [])}) AS snapshot FROM canonical c LEFT JOIN (SELECT canonical_id, list({'label': raw_label, 'uses': n_uses} ORDER BY raw_label, n_uses) AS l FROM alias GROUP BY 1) a ON a.canonical_id = c.canonical_id""")
def snapshot_json(canonical: DataFrame, alias: DataFrame) -> DataFrame:
    """Events and their labels as JSON: the state before and after a decision."""
    entry = F.struct(F.col("raw_label").alias("label"), F.col("n_uses").alias("uses"))
    listed = alias.groupBy("canonical_id").agg(F.sort_array(F.collect_list(entry)).alias("aliases"))  # labels of one event
    made = canonical.join(listed, "canonical_id", "left")
    none = F.array().cast("array<struct<label:string,uses:int>>")
    return made.select("canonical_id", F.to_json(F.struct(F.col("canonical_name").alias("name"), F.coalesce("level", F.lit("")).alias("level"), F.coalesce("aliases", none).alias("aliases"))).alias("snapshot"))


DECISIONS = """decisions AS (SELECT canonical_id AS decision_id, canonical_id AS member, CASE WHEN canonical_id % 10 = 3 THEN canonical_id - 2 WHEN canonical_id % 10 = 5 THEN canonical_id - 2 ELSE canonical_id - 1 END AS survivor, canonical_id % 7 = 0 AS reverted FROM canonical WHERE canonical_id % 10 IN (3, 5, 8)),
    hops AS (SELECT d.member, CASE WHEN e.member IS NOT NULL THEN e.survivor ELSE d.survivor END AS survivor FROM (SELECT * FROM decisions WHERE NOT reverted) d LEFT JOIN (SELECT * FROM decisions WHERE NOT reverted) e ON e.member = d.survivor)"""


def decisions(canonical: DataFrame) -> DataFrame:
    """Merges of events into ones of smaller ids, of which some were undone."""
    k = F.col("canonical_id") % 10
    back = F.when(k.isin(3, 5), 2).otherwise(1)
    return canonical.where(k.isin(3, 5, 8)).select(F.col("canonical_id").alias("decision_id"), F.col("canonical_id").alias("member"), (F.col("canonical_id") - back).alias("survivor"), (F.col("canonical_id") % 7 == 0).alias("reverted"))


MERGED = "SELECT c.canonical_id, canonical_name, CAST(n_source_rows + coalesce(more, 0) AS BIGINT) AS n_source_rows, coalesce(n, 0) AS n_merged FROM canonical c LEFT JOIN (SELECT survivor, sum(n_source_rows) AS more, count(*) AS n FROM hops JOIN canonical ON canonical_id = member GROUP BY 1) m ON m.survivor = c.canonical_id WHERE c.canonical_id NOT IN (SELECT member FROM hops)"


@query("merge_equivalent", "canonical", sql=f"WITH {DECISIONS} {MERGED}")
def merge_equivalent(canonical: DataFrame) -> DataFrame:
    """The events after all merges that hold, chains of merges included."""
    return W.merged_events(canonical, W.survivors(decisions(canonical))).select("canonical_id", "canonical_name", F.col("n_source_rows").cast("bigint").alias("n_source_rows"), "n_merged")


@query("undo_merge", "canonical", sql=f"WITH {DECISIONS.replace('canonical_id % 7 = 0 AS reverted', 'canonical_id % 7 = 0 OR canonical_id % 4 = 1 AS reverted')} {MERGED}")
def undo_merge(canonical: DataFrame) -> DataFrame:
    """The events after more merges were undone: as if these had never been."""
    undone = decisions(canonical).withColumn("reverted", F.col("reverted") | (F.col("decision_id") % 4 == 1))
    return W.merged_events(canonical, W.survivors(undone)).select("canonical_id", "canonical_name", F.col("n_source_rows").cast("bigint").alias("n_source_rows"), "n_merged")


@query("collapse_broader", "canonical", "claims", sql=f"WITH {DECISIONS} SELECT coalesce(u.survivor, up_id) AS up_id, coalesce(d.survivor, down_id) AS down_id, count(*) AS n_claims FROM claims LEFT JOIN hops u ON u.member = up_id LEFT JOIN hops d ON d.member = down_id WHERE coalesce(u.survivor, up_id) <> coalesce(d.survivor, down_id) GROUP BY 1, 2")
def collapse_broader(canonical: DataFrame, claims: DataFrame) -> DataFrame:
    """Edges once events are collapsed into broader ones; what becomes a self-loop is dropped."""
    moved = W.remapped(claims.select("record_key", "up_id", "down_id"), W.survivors(decisions(canonical)), "up_id", "down_id")
    return moved.where("up_id <> down_id").groupBy("up_id", "down_id").agg(F.count("*").alias("n_claims"))


@query("split_alias", "alias", "canonical", sql="""SELECT a.canonical_id + CASE WHEN split_off THEN 1000000 ELSE 0 END AS canonical_id, raw_label, n_uses FROM (SELECT *, canonical_id % 4 = 0 AND raw_label LIKE 'increased %' AS split_off FROM alias) a""")
def split_alias(alias: DataFrame, canonical: DataFrame) -> DataFrame:
    """Labels pulled out of their event into a new one of their own."""
    new = (F.col("canonical_id") % 4 == 0) & F.col("raw_label").startswith("increased ")
    return alias.select((F.col("canonical_id") + F.when(new, 1_000_000).otherwise(0)).alias("canonical_id"), "raw_label", "n_uses")


@query("apply_assignments", "alias", sql="SELECT CASE WHEN n_uses % 6 = 0 THEN canonical_id + 1 ELSE canonical_id END AS canonical_id, count(*) AS n_labels, CAST(sum(n_uses) AS BIGINT) AS n_uses FROM alias WHERE n_uses % 11 <> 0 GROUP BY 1")
def apply_assignments(alias: DataFrame) -> DataFrame:
    """Events rebuilt from a curator's table of labels: some labels are assigned elsewhere, some are excluded."""
    assigned = alias.where("n_uses % 6 = 0").select("canonical_id", "raw_label", "n_uses", (F.col("canonical_id") + 1).alias("target"))
    excluded = alias.where("n_uses % 11 = 0").select("canonical_id", "raw_label", "n_uses").distinct()
    key = ["canonical_id", "raw_label", "n_uses"]
    kept = alias.join(excluded, key, "left_anti").join(assigned.distinct(), key, "left")
    return kept.groupBy(F.coalesce("target", "canonical_id").alias("canonical_id")).agg(F.count("*").alias("n_labels"), F.sum("n_uses").alias("n_uses"))


@query("merge_history", "canonical", "claims", sql=f"""WITH {DECISIONS}, c AS (SELECT event, count(*) AS n_claims, count(DISTINCT doi) AS n_papers FROM (SELECT up_id AS event, doi FROM claims UNION ALL SELECT down_id, doi FROM claims) GROUP BY 1)
    SELECT decision_id, member, survivor, canonical_name AS survivor_name, reverted, coalesce(n_claims, 0) AS n_claims, coalesce(n_papers, 0) AS n_papers FROM decisions JOIN canonical ON canonical_id = survivor LEFT JOIN c ON c.event = survivor""")
def merge_history(canonical: DataFrame, claims: DataFrame) -> DataFrame:
    """All merges with the name of the survivor, and claims and papers on it."""
    names = canonical.select(F.col("canonical_id").alias("survivor"), F.col("canonical_name").alias("survivor_name"))
    rolled = claims.select(F.explode(F.array("up_id", "down_id")).alias("survivor"), "doi").groupBy("survivor").agg(F.count("*").alias("n_claims"), F.countDistinct("doi").alias("n_papers"))
    return decisions(canonical).join(names, "survivor").join(rolled, "survivor", "left").fillna(0, ["n_claims", "n_papers"])


SIGNED = f"signed AS (SELECT canonical_id, level, curie, {polarity_sql('canonical_name')} * 1 + CASE canonical_id % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS sign FROM canonical)"


@query("merge_preview_conflicts", "canonical", sql=f"""WITH {SIGNED} SELECT canonical_id // 4 AS grp, list_filter([CASE WHEN max(sign) > 0 AND min(sign) < 0 THEN 'opposite signs' END, CASE WHEN count(DISTINCT level) > 1 THEN 'different levels' END, CASE WHEN count(DISTINCT curie) > 1 THEN 'different terms' END], lambda x: x IS NOT NULL) AS conflicts FROM signed GROUP BY 1""")
def merge_preview_conflicts(canonical: DataFrame) -> DataFrame:
    """What speaks against merging events in groups of four."""
    k = F.col("canonical_id") % 3
    signed = canonical.select("canonical_id", "level", "curie", (L.polarity(F.col("canonical_name")) + F.when(k == 0, 1).when(k == 1, -1).otherwise(0)).alias("sign"))
    return W.merge_conflicts(signed, canonical.select((F.floor(F.col("canonical_id") / 4)).alias("grp"), "canonical_id"))
