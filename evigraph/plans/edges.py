"""Queries over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions import claims as C
from evigraph.operators import edges as E
from evigraph.plans.edge_sql import CANONICAL_KEY, EDGES, NARROW, RAW_KEY, edge_sql, lane
from evigraph.plans.registry import query

NUMBERS = (
    "ker_key", "n_source_rows", "n_rows_contradicting", "n_rows_supporting", "n_papers_total", "n_papers_contradicting", "n_papers_supporting", "n_positive", "n_negative", "n_unsigned", "direction", "sign_conflict",
    "evidence_type", "is_causal", "is_stressor", "n_reverse_only", "n_spans", "n_verified", "provenance_ratio", "in_registry", "ker_adjacency", "level_gap", "evidence_level", "aop_status", "review_status",
    "uncertainty_level", "confidence_score", "confidence_band", "has_essentiality", "has_quantitative", "last_updated", "record_ids")
RAW_COLUMNS = (*NUMBERS, *(t for t in E.TEXTS if t not in E.MERGED))
COLUMNS = (*RAW_COLUMNS, *E.MERGED)


@query("table2_canonical", "claims", sql=f"{EDGES} SELECT {', '.join(COLUMNS)} FROM edges")
def table2_canonical(claims: DataFrame) -> DataFrame:
    return E.pathway_order(E.canonical_edges(claims)).select(*COLUMNS)


@query("table2_raw", "claims", sql=f"WITH {edge_sql(RAW_KEY)} SELECT {', '.join(RAW_COLUMNS)} FROM edges")
def table2_raw(claims: DataFrame) -> DataFrame:
    return E.raw_edges(claims).select(*RAW_COLUMNS)


@query("table2_pathway_order", "claims", sql=f"{NARROW} SELECT ker_key, up_level, down_level, confidence_score FROM edges")
def table2_pathway_order(claims: DataFrame) -> DataFrame:
    return E.pathway_order(E.canonical_edges(claims, "up_level", "down_level")).select("ker_key", "up_level", "down_level", "confidence_score")


@query("relevance_sort", "claims", sql=f"{NARROW} SELECT ker_key, n_papers_total, confidence_score, provenance_ratio FROM edges")
def relevance_sort(claims: DataFrame) -> DataFrame:
    return E.canonical_edges(claims, "up_level").select("ker_key", "n_papers_total", "confidence_score", "provenance_ratio").orderBy(F.desc("n_papers_total"), F.desc("confidence_score"), F.desc("provenance_ratio"), "ker_key")


@query("unsigned_edges", "claims", sql=f"{NARROW} SELECT ker_key, upstream_name, downstream_name, n_source_rows FROM edges WHERE direction = 'unclear'")
def unsigned_edges(claims: DataFrame) -> DataFrame:
    return E.canonical_edges(claims, "upstream_name", "downstream_name").where("direction = 'unclear'").select("ker_key", "upstream_name", "downstream_name", "n_source_rows")


@query("sign_conflicts", "claims", sql=f"{NARROW} SELECT ker_key, n_positive, n_negative, n_papers_total FROM edges WHERE sign_conflict")
def sign_conflicts(claims: DataFrame) -> DataFrame:
    return E.canonical_edges(claims, "up_level").where("sign_conflict").select("ker_key", "n_positive", "n_negative", "n_papers_total").orderBy(F.desc("n_papers_total"), "ker_key")


@query("reverse_edge_pairs", "claims", sql=f"{NARROW} SELECT a.ker_key AS forward, b.ker_key AS backward, a.direction AS forward_direction, b.direction AS backward_direction FROM edges a JOIN edges b ON a.up_id = b.down_id AND a.down_id = b.up_id AND a.up_id < a.down_id")
def reverse_edge_pairs(claims: DataFrame) -> DataFrame:
    return E.reverse_pairs(E.canonical_edges(claims, "up_level"))


@query("neighbourhood", "claims", sql=f"{NARROW} SELECT ker_key, CASE WHEN up_id = 15 THEN 'out' ELSE 'in' END AS side, n_papers_total FROM edges WHERE up_id = 15 OR down_id = 15")
def neighbourhood(claims: DataFrame) -> DataFrame:
    edges = E.canonical_edges(claims.where("up_id = 15 OR down_id = 15"), "up_level")
    return edges.select("ker_key", F.when(F.col("up_id") == 15, "out").otherwise("in").alias("side"), "n_papers_total")


@query("edge_evidence", "claims", sql="SELECT record_key, doi, n_spans, n_verified, n_verified / n_spans AS ratio FROM claims WHERE up_id = 7 AND down_id = 11")
def edge_evidence(claims: DataFrame) -> DataFrame:
    ratio = F.col("n_verified") / F.col("n_spans")
    return claims.where("up_id = 7 AND down_id = 11").select("record_key", "doi", "n_spans", "n_verified", ratio.alias("ratio")).orderBy(F.desc("n_verified"), F.desc("ratio"), "record_key")


@query("synthesis_summary", "claims", sql=f"""{NARROW} SELECT count(*) AS n_edges, CAST(sum(n_source_rows) AS BIGINT) AS n_claims, count(*) FILTER (sign_conflict) AS n_conflicting, count(*) FILTER (n_papers_contradicting > 0) AS n_contradicted,
    count(*) FILTER (in_registry) AS n_registered, count(*) FILTER (ker_adjacency = 'Adjacent') AS n_adjacent, count(*) FILTER (confidence_band = 'High') AS n_high, round(avg(confidence_score), 6) AS mean_score FROM edges""")
def synthesis_summary(claims: DataFrame) -> DataFrame:
    count = lambda cond: F.count(F.when(cond, 1))
    return E.canonical_edges(claims, "ker_adjacency").agg(
        F.count("*").alias("n_edges"), F.sum("n_source_rows").alias("n_claims"), count(F.col("sign_conflict")).alias("n_conflicting"), count(F.col("n_papers_contradicting") > 0).alias("n_contradicted"), count(F.col("in_registry")).alias("n_registered"),
        count(F.col("ker_adjacency") == "Adjacent").alias("n_adjacent"), count(F.col("confidence_band") == "High").alias("n_high"), F.round(F.avg("confidence_score"), 6).alias("mean_score"))


@query("consolidation_report", "claims", sql=f"SELECT count(DISTINCT {RAW_KEY}) AS n_raw, count(DISTINCT {CANONICAL_KEY}) AS n_consolidated, round(100 * (1 - count(DISTINCT {CANONICAL_KEY}) / count(DISTINCT {RAW_KEY})), 1) AS reduction_pct FROM claims")
def consolidation_report(claims: DataFrame) -> DataFrame:
    counted = claims.agg(F.countDistinct(C.raw_key(F.col("up_name"), F.col("down_name"))).alias("n_raw"), F.countDistinct("up_id", "down_id").alias("n_consolidated"))
    return counted.withColumn("reduction_pct", F.round(100 * (1 - F.col("n_consolidated") / F.col("n_raw")), 1))


ENDS = f"""ends AS (SELECT upstream_name AS event, up_level AS level, 1 AS o, 0 AS i, relation_kind <> 'marker' AS causal, false AS marked, n_papers_total AS papers FROM edges
    UNION ALL SELECT downstream_name, down_level, 0, 1, relation_kind <> 'marker', relation_kind = 'marker', n_papers_total FROM edges),
    lv AS (SELECT event, arg_min(level, (-k, lane, level)) AS level FROM (SELECT event, level, count(*) AS k, {lane('level')} AS lane FROM ends GROUP BY 1, 2) GROUP BY event),
    deg AS (SELECT event, lv.level, CAST(sum(o) AS BIGINT) AS out_any, CAST(sum(i) AS BIGINT) AS in_any, CAST(coalesce(sum(o) FILTER (causal), 0) AS BIGINT) AS n_out, CAST(coalesce(sum(i) FILTER (causal), 0) AS BIGINT) AS n_in,
        bool_or(marked) AS is_marker_target, CAST(sum(papers) AS BIGINT) AS n_papers FROM ends JOIN lv USING (event) GROUP BY event, lv.level)"""


def degrees(claims: DataFrame) -> DataFrame:
    return E.event_degrees(E.canonical_edges(claims, *E.DEGREE_COLUMNS))


@query("key_event_index", "claims", sql=f"{NARROW}, {ENDS} SELECT event, level, in_any, out_any, in_any + out_any AS total, n_papers FROM deg")
def key_event_index(claims: DataFrame) -> DataFrame:
    found = degrees(claims).select("event", "level", "in_any", "out_any", (F.col("in_any") + F.col("out_any")).alias("total"), "n_papers")
    return found.orderBy(F.desc("total"), F.desc("n_papers"), "event")


ROLES = """roles AS (SELECT event, level, n_in, n_out, CASE WHEN is_marker_target AND n_out = 0 THEN 'only measures another event' WHEN n_in = 0 AND n_out > 0 AND level IN ('MIE', 'Molecular') THEN 'nothing leads to it, and it is molecular'
    WHEN n_in = 0 AND n_out > 0 THEN 'nothing leads to it, but it isn''t molecular' WHEN n_out = 0 AND n_in > 0 AND level IN ('Tissue', 'Organ', 'Individual', 'Population') THEN 'leads to nothing at a level where outcomes are'
    WHEN n_out = 0 AND n_in > 0 THEN 'leads to nothing below that level' ELSE 'has causes and consequences' END AS reason FROM deg),
    ruled AS (SELECT *, CASE reason WHEN 'only measures another event' THEN 'marker' WHEN 'nothing leads to it, and it is molecular' THEN 'MIE' ELSE 'KE' END AS role,
    CASE reason WHEN 'nothing leads to it, and it is molecular' THEN 'medium' WHEN 'nothing leads to it, but it isn''t molecular' THEN 'low' WHEN 'leads to nothing at a level where outcomes are' THEN 'medium' ELSE 'high' END AS confidence FROM roles)"""


@query("infer_roles", "claims", sql=f"{NARROW}, {ENDS}, {ROLES} SELECT event, level, role, confidence, reason, n_in, n_out FROM ruled")
def infer_roles(claims: DataFrame) -> DataFrame:
    return E.infer_roles(E.canonical_edges(claims, *E.DEGREE_COLUMNS))


@query("aop_completeness", "claims", sql=f"{NARROW}, {ENDS}, {ROLES} SELECT count(*) FILTER (role = 'MIE') AS n_mie, count(*) FILTER (role = 'AO') AS n_ao, count(*) FILTER (role = 'marker') AS n_marker, count(*) FILTER (role = 'MIE') > 0 AND count(*) FILTER (role = 'AO') > 0 AS is_complete FROM ruled")
def aop_completeness(claims: DataFrame) -> DataFrame:
    count = lambda role: F.count(F.when(F.col("role") == role, 1))
    return infer_roles(claims).agg(count("MIE").alias("n_mie"), count("AO").alias("n_ao"), count("marker").alias("n_marker"), ((count("MIE") > 0) & (count("AO") > 0)).alias("is_complete"))


@query("causation_report", "claims", sql=f"""{NARROW} SELECT evidence_type, count(*) AS n_edges, count(*) FILTER (n_reverse_only = n_source_rows) AS n_only_reverse, evidence_type IN ('correlation', 'not_stated') AS is_weak, evidence_type = 'reverse_only' AS is_backwards,
    round(count(*) / sum(count(*)) OVER (), 6) AS share FROM edges GROUP BY evidence_type""")
def causation_report(claims: DataFrame) -> DataFrame:
    counted = E.canonical_edges(claims, "up_level").groupBy("evidence_type").agg(F.count("*").alias("n_edges"), F.count(F.when(F.col("n_reverse_only") == F.col("n_source_rows"), 1)).alias("n_only_reverse"))
    total = counted.agg(F.sum("n_edges").alias("total"))  # one row
    shared = counted.crossJoin(F.broadcast(total))
    return shared.select("evidence_type", "n_edges", "n_only_reverse", F.col("evidence_type").isin("correlation", "not_stated").alias("is_weak"), (F.col("evidence_type") == "reverse_only").alias("is_backwards"), F.round(F.col("n_edges") / F.col("total"), 6).alias("share"))


@query("weak_edges", "claims", sql=f"{NARROW} SELECT ker_key, ker_name, evidence_type, n_papers_total, confidence_band FROM edges WHERE evidence_type IN ('correlation', 'not_stated', 'reverse_only')")
def weak_edges(claims: DataFrame) -> DataFrame:
    """The edges that a causation report lists: only observed together, or seen the other way round."""
    edges = E.canonical_edges(claims, "ker_name").where(F.col("evidence_type").isin("correlation", "not_stated", "reverse_only"))
    return edges.select("ker_key", "ker_name", "evidence_type", "n_papers_total", "confidence_band")


GRAPH = f"""graph AS (SELECT *, CASE WHEN n_papers_contradicting > 0 AND n_papers_supporting > 0 THEN 'mixed' WHEN n_papers_contradicting > 0 THEN 'contradicted' ELSE 'supported' END AS state, {lane('down_level')} - {lane('up_level')} AS gap FROM edges)"""


@query("graph_edges", "claims", sql=f"{NARROW}, {GRAPH} SELECT ker_key, upstream_name, downstream_name, state, abs(gap) AS lane_gap, gap < 0 AS is_backward, round(1 + least(n_papers_supporting, 6) * 0.5, 2) AS width FROM graph")
def graph_edges(claims: DataFrame) -> DataFrame:
    gap = C.level_index(F.col("down_level")) - C.level_index(F.col("up_level"))
    return E.canonical_edges(claims, *E.DEGREE_COLUMNS).select(
        "ker_key", "upstream_name", "downstream_name", E.state(F.col("n_papers_supporting"), F.col("n_papers_contradicting")).alias("state"), F.abs(gap).alias("lane_gap"), (gap < 0).alias("is_backward"),
        F.round(1 + F.least(F.col("n_papers_supporting"), F.lit(6)) * 0.5, 2).alias("width"))


@query("edge_filter_reasons", "claims", sql=f"""{NARROW}, {GRAPH} SELECT coalesce(CASE WHEN ker_adjacency = 'Non-adjacent' THEN 'non_adjacent' WHEN abs(gap) > 2 THEN 'long_range' WHEN gap < 0 THEN 'backward' WHEN confidence_score < 0.3 THEN 'low_confidence'
    WHEN n_papers_supporting < 2 THEN 'few_papers' WHEN state = 'contradicted' THEN 'contradicted' END, 'shown') AS reason, count(*) AS n FROM graph GROUP BY 1""")
def edge_filter_reasons(claims: DataFrame) -> DataFrame:
    return E.exclusion_reasons(E.canonical_edges(claims, "ker_adjacency")).groupBy(F.coalesce("reason", F.lit("shown")).alias("reason")).agg(F.count("*").alias("n"))


@query("graph_statistics", "claims", sql=f"{NARROW}, {ENDS}, {GRAPH} SELECT (SELECT count(*) FROM deg) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM deg WHERE in_any = 0) AS n_sources, (SELECT count(*) FROM deg WHERE out_any = 0) AS n_sinks, (SELECT count(*) FROM graph WHERE gap < 0) AS n_backward")
def graph_statistics(claims: DataFrame) -> DataFrame:
    edges = E.canonical_edges(claims, *E.DEGREE_COLUMNS)
    nodes = E.event_degrees(edges).agg(F.count("*").alias("n_nodes"), F.count(F.when(F.col("in_any") == 0, 1)).alias("n_sources"), F.count(F.when(F.col("out_any") == 0, 1)).alias("n_sinks"))
    back = C.level_index(F.col("down_level")) < C.level_index(F.col("up_level"))
    return nodes.crossJoin(edges.agg(F.count("*").alias("n_edges"), F.count(F.when(back, 1)).alias("n_backward")))


@query("mie_candidates", "claims", sql=f"{NARROW}, {ENDS} SELECT event, level, level IN ('MIE', 'Molecular') AS plausible FROM deg WHERE in_any = 0")
def mie_candidates(claims: DataFrame) -> DataFrame:
    return degrees(claims).where("in_any = 0").select("event", "level", F.col("level").isin(*E.MIE_LEVELS).alias("plausible"))


@query("ao_candidates", "claims", sql=f"{NARROW}, {ENDS} SELECT event, level, level IN ('Organ', 'Individual', 'Population') AS plausible FROM deg WHERE out_any = 0 AND in_any > 0 AND NOT is_marker_target")
def ao_candidates(claims: DataFrame) -> DataFrame:
    return degrees(claims).where("out_any = 0 AND in_any > 0 AND NOT is_marker_target").select("event", "level", F.col("level").isin("Organ", "Individual", "Population").alias("plausible"))


@query("declared_roles", "roles", "canonical", sql="SELECT r.event, r.role FROM roles r JOIN canonical c ON c.canonical_id = r.canonical_id WHERE c.level IS NOT NULL AND r.approved")
def declared_roles(roles: DataFrame, canonical: DataFrame) -> DataFrame:
    """Roles that a curator gave to events that are resolved and approved."""
    known = canonical.where("level IS NOT NULL").select("canonical_id")
    return roles.where("approved").join(known, "canonical_id").select("event", "role")


@query("assign_roles", "claims", "roles", sql=f"{NARROW}, {ENDS} SELECT d.event, coalesce(r.role, CASE WHEN is_marker_target AND n_out = 0 AND out_any = 0 THEN 'marker' ELSE 'KE' END) AS role FROM deg d LEFT JOIN roles r ON r.approved AND lower(r.event) = lower(d.event)")
def assign_roles(claims: DataFrame, roles: DataFrame) -> DataFrame:
    """Declared roles first; events that only markers reach are markers; all others are key events."""
    found = degrees(claims).withColumn("k", F.lower("event")).join(roles.where("approved").select(F.lower("event").alias("k"), "role"), "k", "left")
    return found.select("event", F.coalesce("role", F.when(F.col("is_marker_target") & (F.col("out_any") == 0), "marker"), F.lit("KE")).alias("role"))


@query("edge_counts", "claims", sql=f"WITH {edge_sql(texts=('all_dois',))} SELECT ker_key, n_source_rows, coalesce(len(string_split(all_dois, '; ')), 0) AS n_dois FROM edges")
def edge_counts(claims: DataFrame) -> DataFrame:
    return E.canonical_edges(claims, "all_dois").select("ker_key", "n_source_rows", F.coalesce(F.size(F.split("all_dois", "; ")), F.lit(0)).alias("n_dois"))


@query("chain_provenance", "claims", sql="""WITH p AS (SELECT DISTINCT up_id, down_id, lower(trim(doi)) AS doi FROM claims WHERE doi IS NOT NULL)
    SELECT a.up_id AS a_up, a.down_id AS middle, b.down_id AS b_down, count(*) AS n_spanning FROM p a JOIN p b ON a.down_id = b.up_id AND a.doi = b.doi GROUP BY ALL""")
def chain_provenance(claims: DataFrame) -> DataFrame:
    """Every junction of two edges that some paper spans, with the number of papers; all other junctions are inferred."""
    return E.spanning_papers(claims)


@query("curation_overlay", "claims", sql=f"""{NARROW}, c AS (SELECT DISTINCT ker_key, CASE WHEN (up_id + down_id) % 7 = 0 THEN 'rejected' WHEN (up_id + down_id) % 11 = 0 THEN 'merged' ELSE 'accepted' END AS status, CASE WHEN down_id % 5 = 0 THEN 'renamed ' || down_id END AS display FROM edges WHERE (up_id + down_id) % 2 = 0)
    SELECT e.ker_key, coalesce(display, upstream_name || ' leads to ' || downstream_name) AS ker_name, coalesce(status, 'unreviewed') AS status FROM edges e LEFT JOIN c ON c.ker_key = e.ker_key WHERE coalesce(status, 'unreviewed') NOT IN ('merged', 'rejected')""")
def curation_overlay(claims: DataFrame) -> DataFrame:
    edges = E.canonical_edges(claims, "upstream_name", "downstream_name")
    total = F.col("up_id") + F.col("down_id")
    rulings = edges.where(total % 2 == 0).select("ker_key", F.when(total % 7 == 0, "rejected").when(total % 11 == 0, "merged").otherwise("accepted").alias("status"), F.when(F.col("down_id") % 5 == 0, F.concat(F.lit("renamed "), "down_id")).alias("display"))
    status = F.coalesce("status", F.lit("unreviewed"))
    return edges.join(rulings, "ker_key", "left").where(~status.isin("merged", "rejected")).select("ker_key", F.coalesce("display", F.concat("upstream_name", F.lit(" leads to "), "downstream_name")).alias("ker_name"), status.alias("status"))


@query("hidden_neighbours", "claims", sql=f"{NARROW}, low AS (SELECT up_id, down_id FROM edges WHERE confidence_band = 'Low') SELECT event, count(*) AS n_hidden FROM (SELECT up_id AS event FROM low UNION ALL SELECT down_id FROM low) GROUP BY event")
def hidden_neighbours(claims: DataFrame) -> DataFrame:
    hidden = E.canonical_edges(claims, "up_level").where("confidence_band = 'Low'")
    return hidden.select(F.explode(F.array("up_id", "down_id")).alias("event")).groupBy("event").agg(F.count("*").alias("n_hidden"))


DRIFT_FIELDS = ("n_source_rows", "n_papers_total", "direction", "evidence_type", "confidence_band")
_DRIFT = " UNION ALL ".join(f"SELECT coalesce(a.ker_key, b.ker_key) AS ker_key, '{f}' AS field, CAST(b.{f} AS VARCHAR) AS before, CAST(a.{f} AS VARCHAR) AS after FROM edges a FULL JOIN edges_old b ON a.ker_key = b.ker_key" for f in DRIFT_FIELDS)


@query("field_drift", "claims", sql=f"""{NARROW}, {edge_sql(texts=(), source="(SELECT * FROM claims WHERE run_id % 3 <> 1)", tag="_old")}, d AS ({_DRIFT}) SELECT ker_key, field, before, after FROM d WHERE before IS DISTINCT FROM after""")
def field_drift(claims: DataFrame) -> DataFrame:
    """All fields of all edges that differ between two versions of the corpus, edges of one version alone included.

    The older version lacks a third of the runs.
    """
    return drift(E.canonical_edges(claims.where("run_id % 3 <> 1"), "up_level"), E.canonical_edges(claims, "up_level"), "ker_key", DRIFT_FIELDS)


def drift(before: DataFrame, after: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, field, before, after) of what differs between two tables, as text; a missing row has nulls."""
    side = lambda frame, end: frame.select(key, *(F.col(f).cast("string").alias(f"{f}_{end}") for f in fields))
    both = side(before, "b").join(side(after, "a"), key, "full_outer")
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_b").alias("before"), F.col(f"{f}_a").alias("after")) for f in fields)))
    return both.select(key, cells.alias("c")).select(key, "c.*").where(~F.col("before").eqNullSafe(F.col("after")))
