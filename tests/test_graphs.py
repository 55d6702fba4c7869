"""Iterative operators, entity resolution and the stream."""

import pytest

from pyspark.sql import functions as F

from evigraph.functions.similarity import label_similarity
from evigraph.operators import entities, graphs
from evigraph.plans import iterative
from evigraph.streaming import telemetry


def edges(spark, *pairs):
    return spark.createDataFrame(pairs, "a string, b string")


def test_components(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "node string")
    got = {r.node: r.component for r in graphs.components(nodes, edges(spark, ("c", "b"), ("b", "a"), ("f", "e"))).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "e", "g": "g"}


def test_a_shortcut_does_not_shorten_the_depth(spark):
    got = {r.node: r.depth for r in graphs.depth(edges(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"))).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_cycles_are_refused(spark):
    with pytest.raises(ValueError, match="cycle"):
        graphs.depth(edges(spark, ("a", "b"), ("b", "a")), most=5)


def test_simple_paths(spark):
    got = sorted(r.path for r in graphs.simple_paths(edges(spark, ("a", "b"), ("b", "c"), ("c", "b"), ("a", "c"), ("c", "d")), 5).collect())
    assert got == [["a", "b", "c", "d"], ["a", "c", "d"]]


def claims(spark, *pairs):
    return spark.createDataFrame([(*p, f"d{i % 2}") for i, p in enumerate(pairs)], "up_id bigint, down_id bigint, doi string")


def test_depth_counts_edges_of_any_span(spark):
    got = {r.node: r.depth for r in iterative.causal_depth(claims(spark, (0, 70), (70, 75), (75, 80), (0, 80), (80, 0), (3, 3))).collect()}
    assert got == {0: 0, 70: 1, 75: 2, 80: 3}


def test_depth_has_no_bound_but_the_nodes(spark):
    line = spark.range(67).selectExpr("id AS a", "id + 1 AS b")
    assert {r.node: r.depth for r in graphs.depth(line).collect()} == {i: i for i in range(68)}


def test_chains_and_the_papers_that_span_them(spark):
    pairs = [(0, 1), (60, 70), (1, 40), (61, 71), (40, 88), (0, 88), (41, 50), (50, 88), (60, 7)]  # even ones are of one paper
    got = sorted((r.path, r.n_spanning, r.evidenced) for r in iterative.pathway_chains(claims(spark, *pairs)).collect())
    assert got == [([0, 1, 40, 88], 1, True), ([0, 88], 1, True), ([41, 50, 88], 0, False), ([60, 70], 1, True), ([61, 71], 1, True)]


def test_entities(spark):
    rows = [
        ("Rising sodium influx", "Molecular", None, None, None), ("Sodium influx, rising", "Molecular", None, None, None), ("first words", "Cellular", 7, None, None), ("nothing alike", "Cellular", 7, None, None),
        ("Activated swelling", "Cellular", None, "go:9", 0.9), ("oedema of tissue", "Cellular", None, "GO:9", 0.8), ("Decreased bulging", "Cellular", None, "GO:9", 0.9), ("faint", "Cellular", None, "GO:9", 0.5)]
    got = {r.label: (r.event, r.basis) for r in entities.canonical_events(spark.createDataFrame(rows, "label string, level string, wiki_id int, curie string, match double")).collect()}
    event = lambda i: got[rows[i][0]]
    assert event(0)[0] == event(1)[0] and event(0)[1] == "token_order"
    assert event(2)[0] == event(3)[0] and event(3)[1] == "registry"
    assert event(4)[0] == event(5)[0] and event(5)[1] == "term"
    assert len({event(4)[0], event(6)[0], event(7)[0]}) == 3


def test_numbers_without_gaps(spark):
    rows = spark.range(0, 500, 1, 7).select(F.pmod(F.xxhash64("id"), F.lit(90)).alias("k"), "id")
    got = graphs.numbered(rows, F.desc("k"), F.asc("id")).orderBy("index").collect()
    assert [r["index"] for r in got] == list(range(500)) and [(-r.k, r.id) for r in got] == sorted((-r.k, r.id) for r in got)


@pytest.mark.parametrize(("a", "b", "score"), [("a b", "a b", 1.0), ("", "a", 0.0), ("hepatic cell death", "death hepatic cell", 0.85), ("swelling", "cell swelling", 0.45 * 16 / 21 + 0.4 / 2 + 0.15), ("x y", "p q", 0.45 / 3)])
def test_similarity(spark, a, b, score):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(label_similarity("a", "b")).first()[0] == pytest.approx(score, abs=1e-4)


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = telemetry.windowed_counts(telemetry.read_events(spark, f"{tmp_path}/in"))
    running = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    assert running.awaitTermination(60)
    got = {(r.start, r.event_type): r.n for r in spark.table("counts").collect()}
    assert got == {(r.start, r.event_type): r.n for r in telemetry.windowed_counts(events).collect()}


def test_labels_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [("Increased liver weight", "Organ", None), ("increased weight of liver", "Organ", None), ("Loss of cells", "Cellular", 3), ("nothing alike", "Cellular", 3), ("swollen limb", "Organ", None)]
    labels = spark.createDataFrame(rows, "label string, level string, wiki_id int")
    got = {r.label: (r.event, r.basis) for r in entities.canonical_events(labels.mapInArrow(counted, labels.schema)).collect()}
    assert seen.value == len(rows)
    assert got == {
        "Increased liver weight": ("increased liver weight", "token_order"), "increased weight of liver": ("increased liver weight", "token_order"), "Loss of cells": ("decreased cell", "registry"),
        "nothing alike": ("decreased cell", "registry"), "swollen limb": ("swollen limb", "own_group")}


def test_papers_of_chains_are_no_rows_of_their_own(spark, monkeypatch):
    """300 papers on both edges of a chain and 100 more on one of them: a few numbers for each edge, whatever the count."""
    rows = [(a, b, f" 10.1/X{i} ") for i in range(300) for a, b in ((0, 1), (1, 2))] + [(0, 1, f"10.1/y{i}") for i in range(100)] + [(0, 1, "nan"), (1, 2, None), (1, 2, "10.1/x7")]
    frame = spark.createDataFrame(rows, "up_id bigint, down_id bigint, doi string")
    chains = spark.createDataFrame([([0, 1, 2], 3), ([0, 1], 2), ([1, 9], 2)], "path array<bigint>, n_events int")
    sizes, put = {}, graphs.stored

    def counted(frame):
        out = put(frame)
        sizes[tuple(out.columns)] = out.count()
        return out

    monkeypatch.setattr(graphs, "stored", counted)
    got = {tuple(r.path): (r.n_spanning, r.evidenced) for r in iterative.chain_papers(chains, frame).collect()}
    assert got == {(0, 1, 2): (300, True), (0, 1): (400, True), (1, 9): (0, False)}
    assert sizes["up_id", "down_id", "part", "bits"] == 7 + 5 and sizes["path", "part", "bits", "whole"] == 5
