"""Queries over pairs of records: checks, verdicts, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions import labels as L
from evigraph.functions.similarity import label_similarity
from evigraph.operators import merges as M
from evigraph.plans.labels import _re, normalise_sql, participants_sql
from evigraph.plans.registry import query


def neighbours(records: DataFrame) -> DataFrame:
    """Pairs of records with consecutive keys."""
    return records.select(F.col("key").alias("a"), (F.col("key") + 1).alias("b"))


def pairs(records: DataFrame) -> DataFrame:
    known = M.described(records)
    return M._side(known, "a").join(M._side(known, "b"), F.col("b_key") == F.col("a_key") + 1)


def _state(column: str) -> str:
    quiet, up, down, broken, mended = (_re(column, p) for p in (L.NO_CHANGE, L.INCREASE, L.DECREASE, L.DISRUPTION, L.RESTORATION))
    sign = f"CASE WHEN {quiet} THEN 0 WHEN {up} AND NOT {down} THEN 1 WHEN {down} AND NOT {up} THEN -1 WHEN {mended} AND NOT {broken} THEN 1 WHEN {broken} AND NOT {mended} THEN -1 ELSE 0 END"
    axis = f"CASE WHEN {quiet} THEN 'none' WHEN {broken} OR {mended} THEN 'integrity' WHEN {up} OR {down} THEN 'quantity' END"
    return f"{quiet} AS quiet, {sign} AS sign, {axis} AS axis"


_SUB = "CASE " + " ".join(f"WHEN {_re('label', p)} THEN '{c}'" for p, c in L.SUBTYPES) + " END"
_QUALIFIERS = ", ".join(f"'{q}'" for q in L.QUALIFIERS)
KNOWN = f"""known AS (SELECT key, label, level, nullif(upper(trim(curie)), '') AS curie, {normalise_sql('label')} AS normal, {participants_sql('label')} AS parts, {_state('label')}, {_SUB} AS subtype,
    {_re('label', L.CLASS_HEAD)} AND ({_SUB}) IS NULL AS is_class FROM records),
    two AS (SELECT a.key AS a, b.key AS b, a.level AS la, b.level AS lb, a.normal AS na, b.normal AS nb, a.parts AS pa, b.parts AS pb, a.quiet AS qa, b.quiet AS qb, a.sign AS ga, b.sign AS gb, a.axis AS xa, b.axis AS xb, a.subtype AS sa, b.subtype AS sb,
        a.is_class AS ka, b.is_class AS kb, list_distinct(string_split(a.normal, ' ')) AS wa, list_distinct(string_split(b.normal, ' ')) AS wb FROM known a JOIN known b ON b.key = a.key + 1)"""


@query("participant_check", "records", sql=f"""WITH {KNOWN} SELECT a, b, CASE WHEN len(pa) = 0 OR len(pb) = 0 THEN 'unknown' WHEN len(list_intersect(pa, pb)) / len(list_distinct(list_concat(pa, pb))) >= 0.5 THEN 'pass' ELSE 'fail' END AS outcome FROM two""")
def participant_check(records: DataFrame) -> DataFrame:
    return pairs(records).select(F.col("a_key").alias("a"), F.col("b_key").alias("b"), M.checks()["participants"]["outcome"].alias("outcome"))


@query("direction_check", "records", sql=f"""WITH {KNOWN} SELECT a, b, CASE WHEN qa <> qb OR (ga <> 0 AND gb <> 0 AND ga <> gb) THEN 'contradictory_or_incompatible' WHEN xa IS NOT NULL AND xb IS NOT NULL AND xa <> xb THEN 'related_but_distinct' END AS verdict,
    CASE WHEN qa <> qb OR (ga <> 0 AND gb <> 0 AND ga <> gb) OR (xa IS NOT NULL AND xb IS NOT NULL AND xa <> xb) THEN 'fail' WHEN xa IS NULL OR xb IS NULL THEN 'unknown' ELSE 'pass' END AS outcome FROM two""")
def direction_check(records: DataFrame) -> DataFrame:
    c = M.checks()["direction"]
    return pairs(records).select(F.col("a_key").alias("a"), F.col("b_key").alias("b"), c["verdict"].alias("verdict"), c["outcome"].alias("outcome"))


@query("level_check", "records", sql=f"WITH {KNOWN} SELECT a, b, CASE WHEN la IS NULL OR lb IS NULL THEN 'unknown' WHEN la = lb THEN 'pass' ELSE 'fail' END AS outcome FROM two")
def level_check(records: DataFrame) -> DataFrame:
    return pairs(records).select(F.col("a_key").alias("a"), F.col("b_key").alias("b"), M.checks()["level"]["outcome"].alias("outcome"))


_MENTIONS = "len(list_intersect(string_split({1}, ' '), list_filter(string_split({0}, ' '), lambda w: length(w) > 2))) / len(list_filter(string_split({0}, ' '), lambda w: length(w) > 2)) >= 0.6"


@query("entailment_check", "records", sql=f"""WITH {KNOWN} SELECT a, b, CASE WHEN sa IS NOT NULL AND sb IS NULL AND {_MENTIONS.format('sa', 'nb')} THEN 'narrower_than' WHEN sb IS NOT NULL AND sa IS NULL AND {_MENTIONS.format('sb', 'na')} THEN 'broader_than'
    WHEN sa = sb AND na <> nb THEN 'related_but_distinct' WHEN len(list_intersect(wa, wb)) = len(wb) AND len(wa) > len(wb) AND len(list_filter(wa, lambda w: NOT list_contains(wb, w) AND w NOT IN ({_QUALIFIERS}))) = 0 THEN 'narrower_than'
    WHEN len(list_intersect(wa, wb)) = len(wa) AND len(wb) > len(wa) AND len(list_filter(wb, lambda w: NOT list_contains(wa, w) AND w NOT IN ({_QUALIFIERS}))) = 0 THEN 'broader_than'
    WHEN ka AND NOT kb AND len(list_intersect(pa, pb)) > 0 THEN 'broader_than' WHEN kb AND NOT ka AND len(list_intersect(pa, pb)) > 0 THEN 'narrower_than' END AS verdict FROM two""")
def entailment_check(records: DataFrame) -> DataFrame:
    return pairs(records).select(F.col("a_key").alias("a"), F.col("b_key").alias("b"), M.checks()["entailment"]["verdict"].alias("verdict"))


@query("classify_pairs", "records")
def classify_pairs(records: DataFrame) -> DataFrame:
    return M.classify(records, neighbours(records))


@query("classify_all", "records")
def classify_all(records: DataFrame) -> DataFrame:
    """All pairs whose names are alike enough to be worth a look, of different labels each taken once."""
    once = records.groupBy("label", "level").agg(F.min("key").alias("key"), F.min("curie").alias("curie"))
    found = M.similar_pairs(once, 0.55)
    normal = once.select("key", L.normalise(F.col("label")).alias("n"))
    scored = found.join(normal.toDF("a", "x"), "a").join(normal.toDF("b", "y"), "b").where(label_similarity("x", "y") >= 0.55)
    return M.classify(once, scored.select("a", "b"))


@query("rank_candidates", "records")
def rank_candidates(records: DataFrame) -> DataFrame:
    """Classified neighbours in the order of review, with a score from outside that moves pairs but never makes one mergeable."""
    return M.ranked(M.classify(records, neighbours(records)), F.col("a") % 10 / 10.0).select("a", "b", "relationship", "mergeable", "rank_score", "similarity")


@query("relationship_counts", "records")
def relationship_counts(records: DataFrame) -> DataFrame:
    return M.summary(M.classify(records, neighbours(records)))


@query("group_verdict", "records")
def group_verdict(records: DataFrame) -> DataFrame:
    """The firmest verdict within groups of four records."""
    chains = neighbours(records).unionByName(records.select(F.col("key").alias("a"), (F.col("key") + 2).alias("b"))).unionByName(records.select(F.col("key").alias("a"), (F.col("key") + 3).alias("b")))
    members = records.select(F.floor(F.col("key") / 4).alias("grp"), "key")
    return M.group_verdict(members, M.classify(records, chains.where(F.floor(F.col("a") / 4) == F.floor(F.col("b") / 4))))


@query("worst_verdict", "workflow_log", sql="""SELECT target_id, arg_max(v, CASE v WHEN 'contradictory_or_incompatible' THEN 5 WHEN 'narrower_than' THEN 4 WHEN 'related_but_distinct' THEN 3 WHEN 'uncertain' THEN 1 ELSE 0 END) AS worst
    FROM (SELECT target_id, CASE state WHEN 'raw' THEN 'equivalent' WHEN 'normalized' THEN 'uncertain' WHEN 'curated' THEN 'related_but_distinct' WHEN 'approved' THEN 'narrower_than' ELSE 'contradictory_or_incompatible' END AS v FROM workflow_log) GROUP BY target_id""")
def worst_verdict(log: DataFrame) -> DataFrame:
    """The firmest of several verdicts on a target; states stand in for verdicts."""
    said = {"raw": M.EQUIVALENT, "normalized": M.UNCERTAIN, "curated": M.RELATED, "approved": M.NARROWER}
    verdict = F.lit(M.CONTRADICTORY)
    for state, name in said.items():
        verdict = F.when(F.col("state") == state, name).otherwise(verdict)
    return log.select("target_id", verdict.alias("v")).groupBy("target_id").agg(F.max_by("v", F.struct(M.severity(F.col("v")), "v")).alias("worst"))


@query("suggest_merges", "records")
def suggest_merges(records: DataFrame) -> DataFrame:
    """Suggestions among events of different names; the review shows the most similar first."""
    once = records.groupBy(F.col("label").alias("canonical_name"), "level").agg(F.min("key").alias("canonical_id"), F.max("n_source_rows").alias("n_source_rows"))
    return M.suggest_merges(once).orderBy(F.desc("similarity"), "source_id", "target_id")


@query("term_similarity", "records")
def term_similarity(records: DataFrame) -> DataFrame:
    """How alike neighbouring labels are."""
    both = pairs(records)
    return both.select(F.col("a_key").alias("a"), F.col("b_key").alias("b"), label_similarity("a_normal", "b_normal").alias("score"))


@query("undecided_pairs", "records", "workflow_log", sql="""WITH d AS (SELECT DISTINCT target_id * 2 AS a, target_id * 2 + 1 AS b FROM workflow_log WHERE state = 'curated' UNION SELECT DISTINCT target_id * 2 + 1, target_id * 2 + 2 FROM workflow_log WHERE state = 'curated' UNION SELECT DISTINCT target_id * 2, target_id * 2 + 2 FROM workflow_log WHERE state = 'curated')
    SELECT r.key AS a, s.key AS b FROM records r JOIN records s ON s.key = r.key + 1 ANTI JOIN d ON d.a = r.key AND d.b = s.key""")
def undecided_pairs(records: DataFrame, log: DataFrame) -> DataFrame:
    """Pairs that no decision was taken on; a decision on several members settles all pairs among them."""
    members = log.where("state = 'curated'").select(F.explode(F.array(F.struct(F.array(F.col("target_id") * 2, F.col("target_id") * 2 + 1, F.col("target_id") * 2 + 2).alias("m")))).alias("d")).select("d.m")
    settled = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    decided = members.select(F.explode(settled).alias("p")).select("p.a", "p.b").distinct()
    have = records.select("key")
    asked = neighbours(records).join(have.withColumnRenamed("key", "b"), "b", "left_semi")
    return asked.join(decided, ["a", "b"], "left_anti").select("a", "b")
