"""Stand-in views: claims, events, runs and logs derived from the driver's tables.

The views are SQL that Spark and DuckDB both run, so a query and its oracle read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evigraph.schemas import LEVELS


def _level(number: str) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(LEVELS)) + " END"


#: View name to (tables or views it reads, SQL).
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "claims": (("lineitem", "part"), f"""
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS record_key,
               l_orderkey * 8 + l_linenumber AS record_id, l_orderkey % 50 AS run_id,
               l_partkey % 97 AS up_id, l_orderkey % 94 + 8 AS down_id,
               CASE WHEN l_linenumber % 3 = 0 THEN concat('Increased event ', l_partkey % 97) ELSE concat('increased event ', l_partkey % 97) END AS up_name,
               CASE WHEN l_suppkey % 4 = 0 THEN concat(' Increased event ', l_orderkey % 94 + 8) ELSE concat('increased event ', l_orderkey % 94 + 8) END AS down_name,
               {_level('(l_partkey % 97 + CASE WHEN l_linenumber >= 6 THEN 1 ELSE 0 END) % 7')} AS up_level, {_level('(l_orderkey % 94 + 8 + CASE WHEN l_suppkey % 3 = 0 THEN 2 ELSE 0 END) % 7')} AS down_level,
               {_level('(l_linenumber + l_partkey) % 7')} AS noisy_level,
               CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE concat('10.1/', l_suppkey) END AS doi,
               CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE concat('f', l_suppkey, '.pdf') END AS filename,
               l_returnflag = 'R' AND l_linenumber % 3 = 0 AS contradicts,
               CASE WHEN l_linestatus = 'O' THEN 'positive' WHEN l_linenumber % 4 = 0 THEN 'negative' ELSE 'unclear' END AS direction,
               CASE l_linenumber WHEN 1 THEN 'rescue' WHEN 2 THEN 'perturbation' WHEN 3 THEN 'common_stressor' WHEN 4 THEN 'correlation' WHEN 5 THEN 'reverse_only' ELSE 'not_stated' END AS evidence_type,
               CASE WHEN l_partkey % 19 = 0 THEN 'marker' WHEN l_linenumber = 7 THEN 'definitional' ELSE 'causal' END AS relation_kind,
               CASE WHEN CAST(round(l_tax * 100) AS INT) <= 2 THEN 'High' WHEN CAST(round(l_tax * 100) AS INT) <= 5 THEN 'Medium' ELSE 'Low' END AS confidence,
               l_linenumber AS n_spans, l_linenumber - l_linenumber % 3 AS n_verified,
               concat(p_name, '; ', p_type) AS stressor,
               CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE concat(p_brand, ' ; ', lower(p_brand)) END AS cell_type,
               CASE WHEN l_suppkey % 7 = 0 THEN concat('essential in ', p_type) END AS essentiality,
               CASE WHEN l_suppkey % 5 = 0 THEN concat('dose ', CAST(l_quantity AS INT)) END AS quantitative,
               CASE l_linenumber % 4 WHEN 0 THEN 'increased' WHEN 1 THEN 'decreased' WHEN 2 THEN 'no change' ELSE 'altered' END AS up_change,
               CASE l_suppkey % 4 WHEN 0 THEN 'elevated' WHEN 1 THEN 'reduced' WHEN 2 THEN NULL ELSE 'lost' END AS down_change,
               CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_linenumber % 4 = 1 THEN concat('event ', l_partkey % 97, ' leads to event ', l_orderkey % 94 + 8) ELSE concat('E', l_partkey % 97, ' to E', l_orderkey % 94 + 8) END AS ker_name,
               CASE WHEN l_linenumber % 2 = 0 THEN concat('seen by way of ', l_returnflag, '; ', l_linestatus) END AS ker_description,
               CASE l_suppkey % 6 WHEN 0 THEN 'Rat' WHEN 1 THEN 'Mouse; rat' WHEN 2 THEN 'Human' WHEN 3 THEN 'zebrafish; Human;' ELSE ' nan ' END AS taxa,
               CASE l_linenumber % 4 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' WHEN 2 THEN 'Mixed' END AS sex, CASE l_partkey % 3 WHEN 0 THEN 'adult' WHEN 1 THEN 'Adult; juvenile' END AS life_stage,
               CASE l_orderkey % 4 WHEN 0 THEN 'In vivo' WHEN 1 THEN 'In vitro' ELSE 'Review / meta-analysis' END AS study_design, CASE l_orderkey % 3 WHEN 0 THEN 'oral; gavage' WHEN 1 THEN 'Oral' END AS exposure_route,
               CASE WHEN l_suppkey % 3 = 0 THEN concat('fits ', p_type) END AS plausibility, CASE WHEN l_suppkey % 4 = 1 THEN concat('shown at ', CAST(l_quantity AS INT), '; ', l_returnflag) END AS empirical,
               CASE WHEN l_linenumber = 3 THEN concat('linear in ', p_brand) END AS response_response, CASE WHEN l_linenumber = 2 THEN concat(CAST(l_quantity AS INT), ' h') END AS time_scale,
               CASE WHEN l_partkey % 5 = 0 THEN concat('age; ', lower(p_brand)) END AS modulating_factors, CASE WHEN l_partkey % 11 = 0 THEN 'positive loop' END AS feedback_loops,
               CASE WHEN l_linenumber % 3 = 1 THEN concat('assay ', l_suppkey % 9) END AS measured_as, CASE WHEN l_suppkey % 17 = 0 THEN concat('none at ', CAST(l_quantity AS INT)) END AS null_findings,
               concat('study of ', l_returnflag) AS study_context, concat('10.2/', l_partkey % 60, ';10.2/', l_suppkey % 20) AS cited_dois,
               CASE WHEN l_partkey % 4 = 0 THEN concat('Aop:', l_partkey % 8) END AS aop_id, CASE WHEN l_partkey % 8 = 0 THEN 'existing' ELSE 'novel' END AS aop_status,
               CASE WHEN l_suppkey % 8 = 0 THEN lower(p_brand) END AS down_cell_type,
               CASE WHEN l_partkey % 10 = 0 THEN l_partkey END AS ker_id,
               CASE WHEN l_linenumber % 2 = 0 THEN 'Adjacent' ELSE 'Non-adjacent' END AS adjacency,
               CAST(l_shipdate AS DATE) AS extraction_date
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "canonical": (("part",), f"""
        SELECT p_partkey AS canonical_id, p_name AS canonical_name, {_level('p_size % 7')} AS level,
               CASE WHEN p_size % 3 = 0 THEN concat('GO:', p_size) END AS curie, CASE WHEN p_size % 5 = 0 THEN p_size END AS wiki_id, p_size AS n_source_rows
        FROM part"""),
    "alias": (("part",), """
        SELECT p_partkey AS canonical_id, p_name AS raw_label, p_size AS n_uses FROM part
        UNION ALL SELECT p_partkey, concat(CASE p_size % 4 WHEN 0 THEN 'increased ' WHEN 1 THEN 'decreased ' WHEN 2 THEN 'No change in ' ELSE 'loss of ' END, lower(p_type)), p_size + 1 FROM part"""),
    "labels_": (("part",), f"""
        SELECT DISTINCT concat(CASE p_size % 4 WHEN 0 THEN 'Increased ' WHEN 1 THEN 'decrease in ' WHEN 2 THEN 'Impairment of ' ELSE '' END, p_type, CASE p_size % 3 WHEN 0 THEN ' levels' WHEN 1 THEN ' (ROS)' ELSE '' END) AS label,
               {_level('p_size % 7')} AS level, CASE WHEN p_size % 5 = 0 THEN p_size END AS wiki_id FROM part
        UNION SELECT concat(CASE p_size % 3 WHEN 0 THEN 'Increased ' WHEN 1 THEN 'decreased ' ELSE 'increased ' END, CASE WHEN p_size % 2 = 0 THEN p_name ELSE concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1)) END), {_level('p_size % 2')}, NULL FROM part
        UNION SELECT concat('Increased ', p_name, ' brass casing edge shape', CASE WHEN p_size % 2 = 0 THEN ' form' ELSE '' END), 'Cellular', NULL FROM part"""),
    "papers": (("documents",), """
        SELECT doc_id, source, concat('A study of something in ', coalesce(source, 'nothing'), chr(10), 'received 2020, doi: 10.', 1000 + doc_id % 9000, '/AB.', doc_id, ').', chr(10), 'Abstract', chr(10), substr(coalesce(text, ''), 1, 700), chr(10), chr(10),
               '1. Introduction', chr(10), substr(coalesce(text, ''), 701, 1500), chr(10), chr(10), 'see https://doi.org/10.5555/other.', doc_id % 7, chr(10), '3.2 Markers of stress', chr(10), substr(coalesce(text, ''), 2201, 4000), chr(10), chr(10),
               'RESULTS', chr(10), chr(10), substr(coalesce(text, ''), 6201), chr(10), 'References', chr(10), '[1] A cited work', chr(10), '10.1/x') AS text
        FROM documents"""),
    "passages": (("lineitem", "part"), """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS passage_id,
               CASE l_linenumber WHEN 1 THEN 'abstract' WHEN 2 THEN 'intro' WHEN 3 THEN 'methods' WHEN 4 THEN 'results' WHEN 5 THEN 'discussion' WHEN 6 THEN 'other' ELSE 'back' END AS section_kind,
               concat(CASE WHEN l_partkey % 13 = 0 THEN '[TABLE] ' ELSE '' END, 'The ', lower(p_type), ' ', CASE l_suppkey % 6 WHEN 0 THEN 'leads to oxidative stress and apoptosis' WHEN 1 THEN 'induced mitochondrial damage, and induces ROS' WHEN 2 THEN 'is associated with fibrosis'
                 WHEN 3 THEN 'inhibits the receptor; knockdown with siRNA abolished it' WHEN 4 THEN 'was seen' ELSE 'drives a dose-dependent, 3-fold increase of GSH' END, ' (p < 0.', 1 + l_linenumber, '). ',
                 CASE WHEN l_orderkey % 3 = 0 THEN 'Supplementary Table 2 has more. ' ELSE '' END, 'In ', lower(p_brand), 's, the key event is downstream of ', p_name, CASE WHEN l_suppkey % 2 = 0 THEN '; IC50 of 5 mg/kg, 95 % CI.' ELSE '.' END) AS text
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "replies": (("events", ), """
        SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('```json', chr(10), props, chr(10), '```') WHEN 1 THEN concat('Here it is: {"steps": [{"a": ', event_id, ', "b": "x"}, {"a": 2, "b": "cut of')
               WHEN 2 THEN concat('{"steps": [{"a": ', event_id, '}, {"b": "the so-called "nodal" domain"}, {"c": 1}]}') WHEN 3 THEN props WHEN 4 THEN 'nothing here' ELSE concat('[', event_id, ', 2, {"k": "v"') END AS reply
        FROM events"""),
    "roles": (("nation",), """
        SELECT CAST(n_nationkey AS BIGINT) + 1 AS canonical_id, concat('increased event ', n_nationkey * 4) AS event, CASE n_nationkey % 3 WHEN 0 THEN 'AO' WHEN 1 THEN 'MIE' ELSE 'KE' END AS role, n_nationkey % 5 <> 0 AS approved FROM nation"""),
    "records": (("part",), f"""
        SELECT p_partkey * 2 AS key, concat(CASE p_size % 6 WHEN 0 THEN 'Increased ' WHEN 1 THEN 'decrease in ' WHEN 2 THEN 'disrupted ' WHEN 3 THEN 'No change in ' WHEN 4 THEN 'restored ' ELSE '' END, lower(p_type), CASE p_size % 5 WHEN 0 THEN ' levels' WHEN 1 THEN ' expression' ELSE '' END) AS label,
               {_level('p_size % 3')} AS level, CASE WHEN p_size % 4 = 0 THEN concat('go:', p_size % 8) END AS curie, p_size AS n_source_rows FROM part
        UNION ALL SELECT p_partkey * 2 + 1, concat(CASE p_size % 4 WHEN 0 THEN 'mitochondrial ' WHEN 1 THEN 'nuclear increased ' WHEN 2 THEN 'NaV1.' ELSE 'voltage gated sodium channel ' END, CASE WHEN p_size % 4 = 2 THEN concat(p_size % 7, ' expression') ELSE lower(p_type) END), {_level('p_size % 4')},
               CASE WHEN p_size % 8 = 0 THEN 'GO:0' END, p_size + 3 FROM part"""),
    "cells": (("part",), """
        SELECT p_partkey AS row_id, p_partkey % 97 AS event, concat('increased event ', p_partkey % 97) AS label,
               CASE p_size % 13 WHEN 0 THEN 'primary hepatocytes' WHEN 1 THEN 'Kupffer cells' WHEN 2 THEN 'rat OPCs' WHEN 3 THEN 'HK-2 line' WHEN 4 THEN 'Astrocytes, GFAP+' WHEN 5 THEN ' ' WHEN 6 THEN 'some other cell' WHEN 7 THEN 'axons of the optic nerve'
                 WHEN 8 THEN 'HepG2' WHEN 9 THEN 'alveolar type II' WHEN 10 THEN NULL WHEN 11 THEN 'Sertoli cells' ELSE 'unknown line' END AS cell_type,
               CASE WHEN p_partkey % 97 < 50 THEN p_brand ELSE 'Brand#1' END AS target, CASE p_size % 3 WHEN 0 THEN 'increased' WHEN 1 THEN 'Increased' ELSE 'decreased' END AS change
        FROM part"""),
    "tokens": (("part",), """
        SELECT p_partkey AS token_id, CASE p_size % 10 WHEN 0 THEN concat('SCN', p_size, 'A') WHEN 1 THEN 'NaV1.6' WHEN 2 THEN 'MBP' WHEN 3 THEN 'the' WHEN 4 THEN p_name WHEN 5 THEN lower(p_brand) WHEN 6 THEN 'DNA' WHEN 7 THEN ' ALT ' WHEN 8 THEN 'x' ELSE concat('differentiat', CASE WHEN p_partkey % 2 = 0 THEN 'ion' ELSE 'ing' END) END AS token,
               CASE p_size % 3 WHEN 0 THEN 'symbol' WHEN 1 THEN 'alias' END AS matched_by, concat(p_name, ' (', p_type, ') [', p_brand, '] Ca2+ "x"') AS phrase
        FROM part"""),
    "citations": (("supplier",), """
        SELECT concat('10.1/', s_suppkey) AS doi, concat('Author', s_suppkey % 9) AS first_author, concat('Second', s_suppkey % 2) AS second_author, s_suppkey % 4 AS n_authors, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE 2000 + s_suppkey % 5 END AS year, s_suppkey % 3 > 0 AS resolved,
               concat('{"issued": {"date-parts": [[', CASE WHEN s_suppkey % 3 = 0 THEN 'null' ELSE CAST(2000 + s_suppkey % 5 AS STRING) END, ']]}, "published": {"date-parts": [[', 1990 + s_suppkey % 5, ', 2]]}}') AS message
        FROM supplier"""),
    "telemetry": (("events",), "SELECT event_id, ts, user_id AS run_id, event_type, value, props FROM events"),
    "workflow_log": (("orders",), """
        SELECT o_orderkey AS log_id, o_custkey AS target_id, CASE WHEN o_custkey % 2 = 0 THEN 'ke' ELSE 'ker' END AS target_type, o_orderdate AS logged_at,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'approved' WHEN '2-HIGH' THEN 'curated' WHEN '3-MEDIUM' THEN 'normalized' WHEN '5-LOW' THEN 'synthesized' ELSE 'raw' END AS state,
               o_orderstatus AS note
        FROM orders"""),
}


def view_sql(*names: str) -> str:
    """``WITH`` clauses for views, to put before an oracle's query."""
    return "WITH " + ", ".join(f"{name} AS ({VIEWS[name][1]})" for name in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver, or a stand-in view over them."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    reads, sql = VIEWS[name]
    sql = sql.replace("{", "{{").replace("}", "}}")
    for read in reads:  # names in the SQL are bound to frames, so no view is left behind in the session
        sql = sql.replace(f"FROM {read}", f"FROM {{{read}}}").replace(f"JOIN {read} ", f"JOIN {{{read}}} ")
    return spark.sql(sql, **{read: _spread(table(spark, sf_dir, read)) if read in SPREAD else table(spark, sf_dir, read) for read in reads})


#: Tables that come as one file each, which one task would read and work through alone.
SPREAD = ("lineitem",)


def _spread(frame: DataFrame) -> DataFrame:
    return frame.repartition(frame.sparkSession.sparkContext.defaultParallelism)
