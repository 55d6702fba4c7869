"""Queries over logs: workflow state, telemetry, entities and their aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.plans.registry import query
from evigraph.schemas import STATES

TARGET = ["target_type", "target_id"]
LATEST = "latest AS (SELECT target_type, target_id, arg_max(state, (logged_at, log_id)) AS state, max(log_id) AS last_log FROM workflow_log GROUP BY ALL)"


def latest_states(log: DataFrame) -> DataFrame:
    """The present state of each target: the last entry of its log."""
    return log.groupBy(*TARGET).agg(F.max_by("state", F.struct("logged_at", "log_id")).alias("state"), F.max("log_id").alias("last_log"))


@query("content_hash", "workflow_log", sql="SELECT log_id, substr(sha256(concat_ws('|', log_id, state, note)), 1, 32) AS hash FROM workflow_log")
def content_hash(log: DataFrame) -> DataFrame:
    return log.select("log_id", F.substring(F.sha2(F.concat_ws("|", "log_id", "state", "note"), 256), 1, 32).alias("hash"))


@query("state_counts", "workflow_log", sql=f"WITH {LATEST}, s AS (SELECT unnest(['raw', 'normalized', 'curated', 'approved', 'synthesized']) AS state) SELECT s.state, count(l.target_id) AS n FROM s LEFT JOIN latest l ON l.state = s.state GROUP BY s.state")
def state_counts(log: DataFrame) -> DataFrame:
    every = log.sparkSession.range(len(STATES)).select(F.element_at(F.array(*map(F.lit, STATES)), (F.col("id") + 1).cast("int")).alias("state"))
    return every.join(latest_states(log).groupBy("state").agg(F.count("*").alias("n")), "state", "left").fillna(0, ["n"])


@query("approval_gate", "workflow_log", sql=f"WITH {LATEST} SELECT target_type, count(*) AS n_targets, count(*) FILTER (state NOT IN ('approved', 'synthesized')) AS n_blocking, bool_and(state IN ('approved', 'synthesized')) AS allowed FROM latest GROUP BY target_type")
def approval_gate(log: DataFrame) -> DataFrame:
    passed = F.col("state").isin("approved", "synthesized")
    return latest_states(log).groupBy("target_type").agg(F.count("*").alias("n_targets"), F.count(F.when(~passed, 1)).alias("n_blocking"), F.bool_and(passed).alias("allowed"))


@query("approval_log", "workflow_log", sql="SELECT log_id, target_id, state FROM workflow_log WHERE target_type = 'ke' ORDER BY log_id DESC LIMIT 50")
def approval_log(log: DataFrame) -> DataFrame:
    return log.where("target_type = 'ke'").select("log_id", "target_id", "state").orderBy(F.desc("log_id")).limit(50)


@query("decision_log", "workflow_log", sql="SELECT log_id, target_type, target_id, state FROM workflow_log ORDER BY log_id DESC LIMIT 100")
def decision_log(log: DataFrame) -> DataFrame:
    return log.select("log_id", *TARGET, "state").orderBy(F.desc("log_id")).limit(100)


@query("stale_syntheses", "workflow_log", sql=f"WITH {LATEST} SELECT target_id FROM latest WHERE state = 'synthesized' AND target_type = 'ker'")
def stale_syntheses(log: DataFrame) -> DataFrame:
    return latest_states(log).where("state = 'synthesized' AND target_type = 'ker'").select("target_id").orderBy("target_id")


@query("synthesis_history", "workflow_log", sql="SELECT target_id, log_id, state, row_number() OVER (PARTITION BY target_id ORDER BY logged_at DESC, log_id DESC) AS age FROM workflow_log WHERE target_type = 'ker'")
def synthesis_history(log: DataFrame) -> DataFrame:
    order = Window.partitionBy("target_id").orderBy(F.desc("logged_at"), F.desc("log_id"))
    return log.where("target_type = 'ker'").select("target_id", "log_id", "state", F.row_number().over(order).alias("age"))


@query("curation_summary", "workflow_log", sql=f"WITH {LATEST} SELECT target_type, count(*) FILTER (state = 'raw') AS raw, count(*) FILTER (state = 'curated') AS curated, count(*) FILTER (state = 'approved') AS approved FROM latest GROUP BY target_type")
def curation_summary(log: DataFrame) -> DataFrame:
    count = lambda s: F.count(F.when(F.col("state") == s, 1)).alias(s)
    return latest_states(log).groupBy("target_type").agg(count("raw"), count("curated"), count("approved"))


@query("partial_upsert", "workflow_log", sql="""WITH a AS (SELECT target_id, max(log_id) AS v, max(note) AS note FROM workflow_log WHERE log_id % 2 = 0 GROUP BY 1), b AS (SELECT target_id, max(log_id) AS v, CASE WHEN target_id % 3 = 0 THEN max(note) END AS note FROM workflow_log WHERE log_id % 2 = 1 GROUP BY 1)
    SELECT coalesce(a.target_id, b.target_id) AS target_id, coalesce(b.v, a.v) AS v, coalesce(b.note, a.note) AS note FROM a FULL JOIN b ON a.target_id = b.target_id""")
def partial_upsert(log: DataFrame) -> DataFrame:
    a = log.where("log_id % 2 = 0").groupBy("target_id").agg(F.max("log_id").alias("v0"), F.max("note").alias("note0"))
    b = log.where("log_id % 2 = 1").groupBy("target_id").agg(F.max("log_id").alias("v1"), F.max("note").alias("n1")).select("target_id", "v1", F.when(F.col("target_id") % 3 == 0, F.col("n1")).alias("note1"))
    return a.join(b, "target_id", "full_outer").select("target_id", F.coalesce("v1", "v0").alias("v"), F.coalesce("note1", "note0").alias("note"))


@query("telemetry_counts", "telemetry", sql="SELECT run_id, event_type, count(*) AS n FROM telemetry GROUP BY ALL")
def telemetry_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id", "event_type").agg(F.count("*").alias("n"))


@query("telemetry_pivot", "telemetry", sql="SELECT run_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM telemetry GROUP BY run_id")
def telemetry_pivot(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id").pivot("event_type", ["click", "view", "purchase"]).count().fillna(0)


for _name, _kinds in (("repair_rate", ("purchase",)), ("failure_rate", ("error",))):
    @query(_name, "telemetry", sql=f"SELECT run_id, CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER (event_type = '{_kinds[0]}') / count(*) END AS rate FROM telemetry GROUP BY run_id")
    def _rate(events: DataFrame, kinds: tuple[str, ...] = _kinds) -> DataFrame:
        return events.groupBy("run_id").agg((F.count(F.when(F.col("event_type").isin(*kinds), 1)) / F.count("*")).alias("rate"))


@query("error_streaks", "telemetry", sql="""WITH o AS (SELECT run_id, event_id, event_type = 'click' AS bad, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY run_id, event_type = 'click' ORDER BY ts, event_id) AS island FROM telemetry),
    s AS (SELECT run_id, island, count(*) AS n FROM o WHERE bad GROUP BY 1, 2) SELECT run_id, max(n) AS longest, count(*) FILTER (n >= 3) AS n_breaks FROM s GROUP BY run_id""")
def error_streaks(events: DataFrame) -> DataFrame:
    bad = events.withColumn("bad", F.col("event_type") == "click")
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "event_id"))
    runs = bad.withColumn("island", place("run_id") - place("run_id", "bad")).where("bad").groupBy("run_id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("run_id").agg(F.max("n").alias("longest"), F.count(F.when(F.col("n") >= 3, 1)).alias("n_breaks"))


@query("ttl_cache", "telemetry", sql="SELECT event_id, ts >= TIMESTAMP '2024-01-20' - INTERVAL 5 DAY AND ts <= TIMESTAMP '2024-01-20' AS fresh FROM telemetry")
def ttl_cache(events: DataFrame) -> DataFrame:
    now = F.lit("2024-01-20").cast("timestamp")
    return events.select("event_id", ((F.col("ts") >= now - F.expr("INTERVAL 5 DAY")) & (F.col("ts") <= now)).alias("fresh"))


@query("stale_sessions", "telemetry", sql="SELECT run_id, max(ts) AS last FROM telemetry WHERE run_id % 10 <> 0 GROUP BY run_id HAVING max(ts) < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 12 HOUR")
def stale_sessions(events: DataFrame) -> DataFrame:
    last = events.groupBy("run_id").agg(F.max("ts").alias("last"))
    active = events.where("run_id % 10 = 0").select("run_id").distinct()
    return last.where(F.col("last") < F.lit("2024-01-30 12:00:00").cast("timestamp") - F.expr("INTERVAL 12 HOUR")).join(active, "run_id", "left_anti")


@query("runs_newest", "telemetry", sql="SELECT run_id, min(ts) AS started, count(*) AS n FROM telemetry WHERE event_type = 'view' GROUP BY run_id")
def runs_newest(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'view'").groupBy("run_id").agg(F.min("ts").alias("started"), F.count("*").alias("n")).orderBy(F.desc("run_id"))


@query("latest_run", "telemetry", sql="SELECT event_type, max(run_id) AS run_id FROM telemetry GROUP BY event_type")
def latest_run(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.max("run_id").alias("run_id"))


@query("orphaned_runs", "telemetry", sql="SELECT run_id, CASE WHEN max(event_type = 'purchase') THEN 'finished' ELSE 'interrupted' END AS status FROM telemetry GROUP BY run_id")
def orphaned_runs(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id").agg(F.when(F.max(F.col("event_type") == "purchase"), "finished").otherwise("interrupted").alias("status"))


@query("replicate_resume", "telemetry", sql="SELECT DISTINCT run_id, event_type FROM telemetry EXCEPT SELECT run_id, event_type FROM telemetry WHERE value > 50")
def replicate_resume(events: DataFrame) -> DataFrame:
    return events.select("run_id", "event_type").distinct().join(events.where("value > 50").select("run_id", "event_type").distinct(), ["run_id", "event_type"], "left_anti")


@query("alias_crosswalk", "alias", "canonical", sql="SELECT raw_label, canonical_id, canonical_name, level, lower(trim(raw_label)) = lower(trim(canonical_name)) AS is_event_name FROM alias JOIN canonical USING (canonical_id)")
def alias_crosswalk(alias: DataFrame, canonical: DataFrame) -> DataFrame:
    return alias.join(canonical, "canonical_id").select("raw_label", "canonical_id", "canonical_name", "level", (F.lower(F.trim("raw_label")) == F.lower(F.trim("canonical_name"))).alias("is_event_name"))


@query("canonical_with_aliases", "alias", "canonical", sql="SELECT canonical_id, canonical_name, coalesce(a.labels, '') AS labels, coalesce(a.n, 0) AS n_aliases FROM canonical LEFT JOIN (SELECT canonical_id, string_agg(raw_label, '; ' ORDER BY raw_label) AS labels, count(*) AS n FROM alias GROUP BY 1) a USING (canonical_id)")
def canonical_with_aliases(alias: DataFrame, canonical: DataFrame) -> DataFrame:
    folded = alias.groupBy("canonical_id").agg(F.array_join(F.sort_array(F.collect_list("raw_label")), "; ").alias("labels"), F.count("*").alias("n_aliases"))
    return canonical.join(folded, "canonical_id", "left").select("canonical_id", "canonical_name", F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("n_aliases", F.lit(0)).alias("n_aliases"))


@query("fold_remap", "alias", sql="SELECT CASE WHEN canonical_id % 10 = 3 THEN canonical_id - 2 ELSE canonical_id END AS canonical_id, raw_label, CAST(sum(n_uses) AS BIGINT) AS n_uses FROM alias GROUP BY 1, 2")
def fold_remap(alias: DataFrame) -> DataFrame:
    kept = F.when(F.col("canonical_id") % 10 == 3, F.col("canonical_id") - 2).otherwise(F.col("canonical_id"))
    return alias.groupBy(kept.alias("canonical_id"), "raw_label").agg(F.sum("n_uses").alias("n_uses"))


@query("insert_if_absent", "alias", "canonical", sql="SELECT DISTINCT lower(trim(raw_label)) AS name FROM alias WHERE lower(trim(raw_label)) NOT IN (SELECT lower(trim(canonical_name)) FROM canonical)")
def insert_if_absent(alias: DataFrame, canonical: DataFrame) -> DataFrame:
    have = canonical.select(F.lower(F.trim("canonical_name")).alias("name")).distinct()
    return alias.select(F.lower(F.trim("raw_label")).alias("name")).distinct().join(have, "name", "left_anti")


@query("recount_source_rows", "claims", sql="SELECT event, count(*) AS n_source_rows FROM (SELECT up_id AS event FROM claims UNION ALL SELECT down_id FROM claims WHERE down_id <> up_id) GROUP BY event")
def recount_source_rows(claims: DataFrame) -> DataFrame:
    return claims.select("record_key", F.explode(F.array_distinct(F.array("up_id", "down_id"))).alias("event")).groupBy("event").agg(F.count("*").alias("n_source_rows"))


@query("telemetry_windows", "events", sql="SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def telemetry_windows(events: DataFrame) -> DataFrame:
    from evigraph.streaming.telemetry import windowed_counts

    return windowed_counts(events).withColumn("total", F.round("total", 4))
