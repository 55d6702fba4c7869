"""Merge checks, workflow and layouts on literal rows."""

import pytest
from pyspark.sql import functions as F

from evigraph.functions import vocabulary as V
from evigraph.operators import layout as G
from evigraph.operators import merges as M
from evigraph.operators import workflow as W


def verdicts(spark, *pairs, ancestors=None):
    rows, asked = [], []
    for i, (a, b) in enumerate(pairs):
        for end, r in (("a", a), ("b", b)):
            label, level, curie = (r, "Cellular", None) if isinstance(r, str) else r
            rows.append((f"{i}{end}", label, level, curie))
        asked.append((f"{i}a", f"{i}b"))
    found = M.classify(spark.createDataFrame(rows, "key string, label string, level string, curie string"), spark.createDataFrame(asked, "a string, b string"), ancestors)
    return [r.relationship for r in found.orderBy(F.expr("cast(substr(a, 1, length(a) - 1) AS int)")).collect()]


def test_verdicts(spark):
    got = verdicts(
        spark, ("restored sheath order", "disrupted sheath order"), ("increased swelling", "decreased swelling"), ("no change in swelling", "increased swelling"), ("NaV1.3", "voltage-gated sodium channel"), ("NaV1.3", "NaV1.5"),
        ("mitochondrial swelling activity", "swelling activity"), (("one thing moving", "Cellular", "GO:1"), ("moving another thing", "Cellular", "go:1")), ("death of neurons by swelling", "neuron death by swelling"),
        (("swelling activity", "Cellular", None), ("swelling activity", "Tissue", None)), ("increased swelling", "increased secretion"))
    assert got == ["contradictory_or_incompatible", "contradictory_or_incompatible", "contradictory_or_incompatible", "narrower_than", "related_but_distinct", "narrower_than", "equivalent", "equivalent", "related_but_distinct", "related_but_distinct"]


def test_an_ancestor_is_broader(spark):
    closure = spark.createDataFrame([("GO:2", "GO:1")], "curie string, ancestor string")
    pair = (("swelling activity here", "Cellular", "GO:2"), ("swelling activity there", "Cellular", "GO:1"))
    assert verdicts(spark, pair, ancestors=closure) == ["narrower_than"]
    assert verdicts(spark, pair) == ["related_but_distinct"]


def test_a_group_is_as_good_as_its_worst_pair(spark):
    pairs = spark.createDataFrame([("a", "b", "equivalent"), ("b", "c", "uncertain"), ("c", "d", "contradictory_or_incompatible")], "a string, b string, relationship string")
    members = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "c"), (2, "d")], "grp int, key string")
    assert {r.grp: r.relationship for r in M.group_verdict(members, pairs).collect()} == {1: "uncertain", 2: "contradictory_or_incompatible"}
    assert {r.relationship: r.n for r in M.summary(pairs).collect()}["narrower_than"] == 0


def test_suggestions(spark):
    rows = [(1, "dispersed channel clustering at node", "Cellular", 5), (2, "shortened segment and dispersed channel clustering at nodes", "Cellular", 2), (3, "increased thing", "Cellular", 1), (4, "decreased thing", "Cellular", 1), (5, "cation flow", "Cellular", 1), (6, "cations flow", "Cellular", 1)]
    got = {(r.source_id, r.target_id) for r in M.suggest_merges(spark.createDataFrame(rows, "canonical_id bigint, canonical_name string, level string, n_source_rows int")).collect()}
    assert (2, 1) in got and (5, 6) in got and (3, 4) not in got and (4, 3) not in got


def test_states(spark):
    rows = [(1, 1, "curated"), (1, 2, "synthesized"), (1, 3, "approved"), (1, 4, "synthesized"), (1, 5, "raw"), (2, 6, "approved"), (2, 7, "normalized"), (2, 8, "raw")]
    log = spark.createDataFrame(rows, "target_id bigint, log_id bigint, state string").withColumn("logged_at", F.col("log_id"))
    got = [(r.log_id, r.from_state, r.accepted, r.invalidates) for r in W.transitions(log, "target_id").orderBy("log_id").collect()]
    assert got == [
        (1, "raw", True, False), (2, "curated", False, False), (3, "curated", True, False), (4, "approved", True, False), (5, "synthesized", True, True), (6, "raw", False, False), (7, "raw", True, False), (8, "normalized", True, False)]


def test_versions_of_what_did_not_change_are_one(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a")], "k int, t int, v string")
    assert [(r.version, r.v, r.valid_from, r.valid_to, r.is_current) for r in W.versions(rows, "k", ["t"], "v").orderBy("version").collect()] == [(1, "a", 1, 3, False), (2, None, 3, 5, False), (3, "a", 5, None, True)]


def test_merges_and_their_undoing(spark):
    rows = [(1, 2, 1, False), (2, 3, 2, False), (3, 5, 4, True), (4, 6, 6, False)]
    decided = spark.createDataFrame(rows, "decision_id bigint, member bigint, survivor bigint, reverted boolean")
    assert {(r.member, r.survivor) for r in W.survivors(decided).collect()} == {(2, 1), (3, 1)}
    events = spark.createDataFrame([(i, i) for i in range(1, 7)], "canonical_id bigint, n_source_rows bigint")
    assert {(r.canonical_id, r.n_source_rows, r.n_merged) for r in W.merged_events(events, W.survivors(decided)).collect()} == {(1, 6, 2), (4, 4, 0), (5, 5, 0), (6, 6, 0)}


def test_drift_takes_an_approval_back(spark):
    states = spark.createDataFrame([(1, "approved", "x"), (2, "approved", "y"), (3, "curated", "x"), (4, "synthesized", None)], "id int, state string, approved_hash string")
    now = spark.createDataFrame([(i, "y") for i in (1, 2, 3, 4)], "id int, hash string")
    assert {r.id: r.effective_state for r in W.effective(states, now, "id").collect()} == {1: "curated", 2: "approved", 3: "curated", 4: "synthesized"}


def test_the_heaviest_path(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "d", 1.0), ("a", "c", 2.0), ("c", "d", 0.5), ("d", "e", 1.0)], "a string, b string, weight double")
    assert {r.node: (r.weight, r.previous) for r in G.backbone(edges).collect()} == {"a": (0.0, None), "b": (1.0, "a"), "c": (2.0, "a"), "d": (2.5, "c"), "e": (3.5, "d")}


def test_shortest_paths(spark):
    edges = spark.createDataFrame([(1, "a", "b", "a", "d"), (1, "b", "d", "a", "d"), (1, "a", "c", "a", "d"), (1, "c", "d", "a", "d"), (2, "a", "b", "a", "z")], "grp int, a string, b string, start string, stop string")
    assert {r.grp: r.path for r in G.shortest_path(edges).collect()} == {1: ["a", "b", "d"]}


def test_layout_keeps_edges_pointing_right(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "c")], "a string, b string")
    placed = G.causal_layout(edges, spark.createDataFrame([("a", "MIE"), ("c", "AO")], "node string, role string"))
    assert {r.node: r.column for r in placed.collect()} == {"a": 0, "b": 1, "c": 2, "x": 0}
    assert G.backward_edges(edges, placed).count() == 0


@pytest.mark.parametrize(("cell", "name"), [("Kupffer cells", "macrophage"), ("rat OPCs", "oligodendroglial"), ("  ", "unspecified"), (None, "unspecified"), ("some line", "unresolved"), ("hepatic stellate cell", "fibroblast")])
def test_lineages(spark, cell, name):
    assert spark.createDataFrame([(cell,)], "c string").select(V.lineage(F.col("c"))).first()[0] == name


@pytest.mark.parametrize(("word", "symbol"), [("SCN8A", True), ("NaV1.6", True), ("MBP", True), ("protein", False), ("DNA", False), ("a b", False), ("x", False), ("p53", True)])
def test_gene_symbols(spark, word, symbol):
    assert spark.createDataFrame([(word,)], "c string").select(V.is_gene_symbol(F.col("c"))).first()[0] is symbol
