"""SQL for consolidated edges, written from the definition of each output rather than from the operator.

Every text output is a query of its own, so that a fault of the operator's shared frame shows.
"""

from __future__ import annotations

CANONICAL_KEY = "'canon::' || up_id || '::' || down_id"
RAW_KEY = "'raw::' || lower(trim(up_name)) || '::' || lower(trim(down_name))"
LANES = "['MIE', 'Molecular', 'Cellular', 'Tissue', 'Organ', 'Individual', 'Population']"
PAPER = "coalesce('doi:' || lower(trim(doi)), 'file:' || lower(trim(filename)), 'record:' || record_key)"


def lane(level: str) -> str:
    return f"coalesce(list_position({LANES}, {level}), 2)"


def _says(value: str) -> str:
    return f"{value} IS NOT NULL AND lower(trim({value})) NOT IN ('', 'nan', 'nat', 'none', 'null', '<na>')"


def _union(key: str, columns: tuple[str, ...], where: str = "true") -> str:
    return " UNION ALL ".join(f"SELECT {key} AS ker_key, CAST({c} AS VARCHAR) AS v FROM claims WHERE {where}" for c in columns)


def _listed(out: str, key: str, columns: tuple[str, ...], most: int | None = None, where: str = "true") -> str:
    """Values parted at semicolons, spellings taken together, the most frequent first."""
    cut = f"[1:{most}]" if most else ""
    return f"""{out}_t@ AS (SELECT ker_key, array_to_string(list(item ORDER BY k DESC, length(item) DESC, item){cut}, '; ') AS {out} FROM (
        SELECT ker_key, count(*) AS k, arg_min(item, (-length(item), item)) AS item FROM (SELECT ker_key, trim(unnest(string_split(v, ';'))) AS item FROM ({_union(key, columns, where)}) WHERE {_says('v')})
        WHERE item <> '' GROUP BY ker_key, lower(item)) GROUP BY ker_key)"""


def _agreed(out: str, key: str, column: str) -> str:
    """The whole value that most claims agree on."""
    return f"""{out}_t@ AS (SELECT ker_key, arg_min(item, (-k, -length(item), item)) AS {out} FROM (
        SELECT ker_key, count(*) AS k, arg_min(trim(v), (-length(trim(v)), trim(v))) AS item FROM ({_union(key, (column,))}) WHERE {_says('v')} GROUP BY ker_key, lower(trim(v))) GROUP BY ker_key)"""


def _mode(out: str, key: str, column: str, order: str) -> str:
    return f"""{out}_t@ AS (SELECT ker_key, arg_min(item, (-k, {order}, item)) AS {out} FROM (SELECT ker_key, trim(v) AS item, count(*) AS k FROM ({_union(key, (column,))}) WHERE {_says('v')} GROUP BY ALL) GROUP BY ker_key)"""


def _texts(key: str) -> dict[str, str]:
    lists = {
        "essentiality_evidence": (("essentiality",), 5), "cell_types": (("cell_type", "down_cell_type"), 6), "measured_as": (("measured_as",), 4), "null_findings": (("null_findings",), 4), "study_contexts": (("study_context",), 4),
        "upstream_changes": (("up_change",), 6), "downstream_changes": (("down_change",), 6), "biological_plausibility": (("plausibility",), 4), "empirical_evidence": (("empirical",), 4), "all_taxa": (("taxa",),), "sexes": (("sex",),),
        "life_stages": (("life_stage",),), "study_designs": (("study_design",),), "stressors": (("stressor",), 8), "exposure_routes": (("exposure_route",), 5), "modulating_factors": (("modulating_factors",), 6),
        "feedback_loops": (("feedback_loops",), 4), "all_dois": (("doi",),), "supporting_dois": (("doi",), None, "NOT contradicts"), "contradicting_dois": (("doi",), None, "contradicts"), "cited_dois": (("cited_dois",), 20),
        "aop_ids": (("aop_id",),), "merged_upstream_labels": (("up_name",),), "merged_downstream_labels": (("down_name",),), "merged_ker_names": (("ker_name",), 10)}
    agreed = {"upstream_name": "up_name", "downstream_name": "down_name", "stated_name": "ker_name", "ker_description": "ker_description", "quantitative_relationships": "quantitative", "response_response": "response_response", "time_scale": "time_scale"}
    found = {out: _listed(out, key, *rest) for out, rest in lists.items()} | {out: _agreed(out, key, c) for out, c in agreed.items()}
    known = f"coalesce(list_position({LANES}, item), 8)"
    return found | {"up_level": _mode("up_level", key, "up_level", known), "down_level": _mode("down_level", key, "down_level", known), "usual_kind": _mode("usual_kind", key, "lower(relation_kind)", "8")}


def edge_sql(key: str = CANONICAL_KEY, texts: tuple[str, ...] | None = None, source: str = "claims", tag: str = "") -> str:
    """The body of a CTE list that ends with ``edges`` and the tag; without ``texts`` all text outputs are made."""
    every = _texts(key)
    own = {t: every[t] for t in every if texts is None or t in texts or t in ("up_level", "down_level", "usual_kind", "upstream_name", "downstream_name", "stated_name")}
    strength = "greatest(CASE WHEN bool_or(evidence_type = 'rescue') THEN 5 ELSE 0 END, CASE WHEN bool_or(evidence_type = 'perturbation') THEN 4 ELSE 0 END, CASE WHEN bool_or(evidence_type = 'common_stressor') THEN 3 ELSE 0 END, CASE WHEN bool_or(evidence_type = 'correlation') THEN 2 ELSE 0 END, CASE WHEN bool_or(evidence_type = 'reverse_only') THEN 1 ELSE 0 END)"
    joins = " ".join(f"LEFT JOIN {t}_t@ USING (ker_key)" for t in own)
    plain = [t for t in own if t not in ("up_level", "down_level", "usual_kind", "stated_name")]
    whole = f"""{', '.join(own.values())},
    g@ AS (SELECT {key} AS ker_key, count(*) AS n_source_rows, count(*) FILTER (contradicts) AS n_rows_contradicting, count(DISTINCT {PAPER}) AS n_papers_total, count(DISTINCT {PAPER}) FILTER (contradicts) AS n_papers_contradicting,
        count(*) FILTER (direction = 'positive') AS n_positive, count(*) FILTER (direction = 'negative') AS n_negative, {strength} AS strength, count(*) FILTER (evidence_type = 'reverse_only') AS n_reverse_only,
        CAST(sum(n_spans) AS BIGINT) AS n_spans, CAST(sum(n_verified) AS BIGINT) AS n_verified, avg(CASE confidence WHEN 'High' THEN 1.0::DOUBLE WHEN 'Medium' THEN 0.6 ELSE 0.25 END) AS extraction, bool_or(ker_id IS NOT NULL) AS in_registry,
        bool_or(relation_kind = 'marker') AS any_marker, count(*) FILTER (adjacency = 'Adjacent') AS n_adjacent, count(adjacency) AS n_votes, bool_or(essentiality IS NOT NULL) AS has_essentiality, bool_or(quantitative IS NOT NULL) AS has_quantitative,
        bool_or(aop_status = 'existing') AS is_existing, min(up_id) AS up_id, min(down_id) AS down_id, max(extraction_date) AS last_updated, array_to_string(list(record_id ORDER BY record_id), ',') AS record_ids,
        count(DISTINCT (up_name, down_name)) AS n_distinct_raw_kers FROM claims GROUP BY 1),
    h@ AS (SELECT g@.* EXCLUDE (strength), ['not_stated', 'reverse_only', 'correlation', 'common_stressor', 'perturbation', 'rescue'][strength + 1] AS evidence_type, coalesce(up_level, 'Molecular') AS up_level, coalesce(down_level, 'Molecular') AS down_level,
        CASE WHEN any_marker THEN 'marker' ELSE coalesce(usual_kind, 'causal') END AS relation_kind, coalesce(stated_name, upstream_name || ' leads to ' || downstream_name) AS ker_name, {', '.join(plain)} FROM g@ {joins}),
    i@ AS (SELECT *, abs({lane('up_level')} - {lane('down_level')}) AS level_gap, n_papers_total - n_papers_contradicting AS n_papers_supporting, n_source_rows - n_rows_contradicting AS n_rows_supporting, n_source_rows - n_positive - n_negative AS n_unsigned,
        n_positive > 0 AND n_negative > 0 AS sign_conflict, coalesce(n_verified / nullif(n_spans, 0), 0) AS verified FROM h@),
    j@ AS (SELECT *, CASE WHEN sign_conflict THEN 'conflicting' WHEN n_positive > 0 THEN 'positive' WHEN n_negative > 0 THEN 'negative' ELSE 'unclear' END AS direction, round(verified, 3) AS provenance_ratio,
        CASE WHEN n_adjacent >= greatest(1, n_votes // 2) AND level_gap <= 1 THEN 'Adjacent' ELSE 'Non-adjacent' END AS ker_adjacency, evidence_type IN ('rescue', 'perturbation') AS is_causal, evidence_type = 'common_stressor' AS is_stressor,
        CASE WHEN is_existing THEN 'existing' ELSE 'novel' END AS aop_status, 'Draft' AS review_status, CASE WHEN n_papers_total <= 3 THEN 'Low' WHEN n_papers_total <= 8 THEN 'Moderate' ELSE 'High' END AS evidence_level,
        CASE WHEN n_papers_contradicting = 0 THEN 'Low' WHEN n_papers_contradicting <= 0.25 * n_papers_total THEN 'Moderate' ELSE 'High' END AS uncertainty_level,
        0.3::DOUBLE * least(1.0, n_papers_supporting / 5.0::DOUBLE) * (1 - 0.6::DOUBLE * n_papers_contradicting / n_papers_total) + CASE WHEN has_essentiality THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN has_quantitative THEN 0.15::DOUBLE ELSE 0 END
          + 0.15::DOUBLE * verified + 0.1::DOUBLE * extraction + CASE WHEN in_registry THEN 0.1::DOUBLE ELSE 0 END AS base,
        CASE WHEN sign_conflict THEN 0.5::DOUBLE ELSE 1 END * (1 - 0.25::DOUBLE * n_unsigned / n_source_rows)
          * CASE evidence_type WHEN 'rescue' THEN 1.15::DOUBLE WHEN 'perturbation' THEN 1.0 WHEN 'common_stressor' THEN 0.85 WHEN 'correlation' THEN 0.7 WHEN 'reverse_only' THEN 0.4 ELSE 0.6 END AS factor FROM i@),
    k@ AS (SELECT *, floor(round(1e6 * greatest(0.0, least(1.0, base * factor))) / 1e3 + 0.5) / 1e3 AS confidence_score FROM j@),
    edges@ AS (SELECT * EXCLUDE (base, factor, verified, extraction, any_marker, n_adjacent, n_votes, is_existing), CASE WHEN confidence_score >= 0.66 THEN 'High' WHEN confidence_score >= 0.36 THEN 'Moderate' ELSE 'Low' END AS confidence_band FROM k@)"""
    return whole.replace("@", tag).replace("FROM claims", f"FROM {source}")


#: Edges with all outputs, and with those alone that most questions need.
EDGES = f"WITH {edge_sql()}"
NARROW = f"WITH {edge_sql(texts=())}"
