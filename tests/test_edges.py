"""Edges on literal rows: papers, signs, ranking and independence of row order."""

import random

import pytest
from pyspark.sql import functions as F

from evigraph.operators import edges as E

DEFAULTS = {
    "record_key": "r", "up_id": 1, "down_id": 2, "up_name": "increased ROS", "down_name": "increased apoptosis", "up_level": "Molecular", "down_level": "Cellular", "doi": "10.1/a", "filename": "a.pdf", "contradicts": False,
    "direction": "positive", "evidence_type": "perturbation", "relation_kind": "causal", "confidence": "High", "n_spans": 1, "n_verified": 1, "stressor": "x", "cell_type": None, "essentiality": None, "quantitative": None,
    "up_change": "increased", "down_change": "increased", "ker_id": None, "adjacency": "Adjacent", "extraction_date": "2026-01-01"}
SCHEMA = ", ".join(f"{k} {'bigint' if k.endswith('_id') else 'int' if k.startswith('n_') else 'boolean' if k == 'contradicts' else 'string'}" for k in DEFAULTS)


def claims(spark, *changes):
    return spark.createDataFrame([tuple((DEFAULTS | {"record_key": f"r{i}"} | c).values()) for i, c in enumerate(changes)], SCHEMA)


def one(spark, *changes):
    rows = E.canonical_edges(claims(spark, *changes)).collect()
    assert len(rows) == 1
    return rows[0]


def test_papers_are_counted_once(spark):
    row = one(spark, {"doi": "x"}, {"doi": "X "}, {"doi": "y"})
    assert (row.n_papers_total, row.n_source_rows) == (2, 3)


def test_a_paper_that_contradicts_anywhere_contradicts(spark):
    row = one(spark, {"doi": "x"}, {"doi": "x", "contradicts": True}, {"doi": "y"})
    assert (row.n_papers_total, row.n_papers_supporting, row.n_papers_contradicting) == (2, 1, 1)


@pytest.mark.parametrize("missing", [None, "", "nan", " None "])
def test_files_stand_in_for_missing_dois(spark, missing):
    assert one(spark, {"doi": missing, "filename": "first.pdf"}, {"doi": missing, "filename": "second.pdf"}).n_papers_total == 2


def test_bands_count_papers_not_rows(spark):
    assert one(spark, *[{"doi": "x"}] * 4).evidence_level == "Low"


def test_conflicting_signs_lower_the_score(spark):
    agree = one(spark, {"doi": "x"}, {"doi": "y"})
    differ = one(spark, {"doi": "x"}, {"doi": "y", "direction": "negative"})
    assert (differ.direction, differ.n_positive, differ.n_negative, differ.sign_conflict) == ("conflicting", 1, 1, True)
    assert differ.confidence_score < agree.confidence_score


def test_unclear_direction(spark):
    assert one(spark, {"direction": "unclear"}).direction == "unclear"


def test_lists_are_ranked(spark):
    row = one(spark, {"stressor": "ROS; lead"}, {"stressor": "ros ;Zinc"}, {"stressor": "zn"}, {"stressor": None})
    assert row.stressors == "ROS; Zinc; lead; zn"


def test_row_order_does_not_count(spark):
    rows = [{"doi": f"10.1/paper{i}", "stressor": f"s{i % 3}; t{i}", "evidence_type": E.EVIDENCE_TYPES[i % 6], "direction": ["positive", "negative"][i % 2]} for i in range(6)]
    first = None
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        got = E.canonical_edges(claims(spark, *rows)).collect()[0].asDict()
        first = first or got
        assert got == first


def test_relation_kind_is_the_usual_one_unless_any_claim_says_marker(spark):
    assert one(spark, {"relation_kind": "definitional"}, {"relation_kind": "Definitional"}, {"relation_kind": "causal"}).relation_kind == "definitional"
    assert one(spark, {"relation_kind": "definitional"}, {"relation_kind": "definitional"}, {"relation_kind": "marker"}).relation_kind == "marker"
    assert one(spark, {"relation_kind": None}).relation_kind == "causal"


def test_levels_are_modes_with_ties_upstream(spark):
    assert one(spark, {"up_level": "Organ"}, {"up_level": "Cellular"}).up_level == "Cellular"
    assert one(spark, {"up_level": "Organ"}, {"up_level": "Organ"}, {"up_level": "Cellular"}).up_level == "Organ"
    assert one(spark, {"up_level": None}).up_level == "Molecular"


def test_names_are_the_most_common_spelling(spark):
    row = one(spark, {"up_name": "ROS rise"}, {"up_name": "ros rise"}, {"up_name": "Oxidative burst"})
    assert (row.upstream_name, row.merged_upstream_labels, row.n_distinct_raw_kers) == ("ROS rise", "ROS rise; Oxidative burst", 3)


def test_only_what_is_asked_for_is_ranked(spark):
    row = E.canonical_edges(claims(spark, {}), "stressors").collect()[0].asDict()
    assert row["stressors"] == "x" and "all_dois" not in row and row["n_papers_total"] == 1


def test_edges_without_ids_go_by_names(spark):
    rows = claims(spark, {"up_id": None}, {"up_id": None, "up_name": " Increased ros"}, {"up_id": None, "up_name": "other"})
    assert sorted((r.ker_key, r.n_source_rows) for r in E.canonical_edges(rows).collect()) == [("name::increased ros::increased apoptosis", 2), ("name::other::increased apoptosis", 1)]


def test_junctions_of_common_papers(spark):
    rows = claims(spark, {"up_id": 1, "down_id": 2, "doi": "x"}, {"up_id": 2, "down_id": 3, "doi": "X"}, {"up_id": 2, "down_id": 3, "doi": "y"}, {"up_id": 2, "down_id": 4, "doi": "z"}, {"up_id": 1, "down_id": 2, "doi": None})
    assert [tuple(r) for r in E.spanning_papers(rows).collect()] == [(1, 2, 3, 1)]


def test_reverse_pairs(spark):
    edges = E.canonical_edges(claims(spark, {"up_id": 1, "down_id": 2}, {"up_id": 2, "down_id": 1}, {"up_id": 3, "down_id": 3}))
    assert [(r.forward, r.backward) for r in E.reverse_pairs(edges).collect()] == [("canon::1::2", "canon::2::1")]


def test_roles(spark):
    edges = E.canonical_edges(claims(spark, {"up_id": 1, "down_id": 2, "up_name": "a", "down_name": "b"}, {"up_id": 2, "down_id": 3, "up_name": "b", "down_name": "c", "relation_kind": "marker", "up_level": "Cellular"}))
    assert {r.event: r.role for r in E.infer_roles(edges).collect()} == {"a": "MIE", "b": "KE", "c": "marker"}


def test_empty_claims(spark):
    assert E.canonical_edges(claims(spark, {}).where(F.lit(False))).count() == 0
