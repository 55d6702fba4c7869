"""The store: versions, upserts, histories, invalidation, layouts."""

import json

import pytest
from pyspark.sql import functions as F

from evigraph.sources import store as S


@pytest.fixture
def store(spark, tmp_path):
    return S.Store(spark, f"file://{tmp_path}/store").open()


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "record_id bigint")


def test_upserts_keep_what_is_null_and_earlier_versions(store):
    store.upsert("directions", [(1, "increased", "x", "why"), (2, "decreased", "y", None)])
    S.set_direction(store, 1, "conflicted", "z", None)
    assert {tuple(r) for r in store.read("directions").collect()} == {(1, "conflicted", "z", "why"), (2, "decreased", "y", None)}
    assert {r.direction for r in store.read("directions", version=1).collect()} == {"increased", "decreased"}
    S.clear_direction(store, 2)
    assert [r.canonical_id for r in store.read("directions").collect()] == [1]
    with pytest.raises(ValueError, match="increased"):
        S.set_direction(store, 1, "sideways", "z", None)


def test_a_later_schema_is_refused(store):
    store.upsert("schema_meta", [("version", str(S.SCHEMA_VERSION + 1))])
    with pytest.raises(S.SchemaTooNew):
        store.open()


def test_claims_edits_and_deletions(spark, store):
    claims = spark.createDataFrame([(1, 5, 6, "a\x00b"), (2, 5, 7, "c")], "record_id bigint, up_id bigint, down_id bigint, up_name string")
    S.insert_claims(store, claims, spark.createDataFrame([(1, 1, '"said so" ')], "span_id bigint, record_id bigint, quote string"))
    assert {(r.record_id, r.up_name, r.direction) for r in store.read("claims").collect()} == {(1, "ab", "unclear"), (2, "c", "unclear")}
    S.save_synthesis(store, "5->6", "text", "High", [1], None)
    store.upsert("states", [("ker", "5->6", "synthesized", "h", "me")])
    assert not S.update_claim(store, 1, {"up_name": "ab"}, "me", "nothing new")
    assert S.update_claim(store, 1, {"direction": "positive"}, "me", "reread")
    assert store.lookup("syntheses", ker_key="5->6").first().stale and store.read("states").first().state == "approved"
    assert json.loads(store.read("record_history").first().payload)["direction"] == "unclear"
    S.delete_records(store, ids(spark, 1), "twice", "me")
    assert [r.record_id for r in store.read("claims").collect()] == [2] and store.read("spans").count() == 0 and store.read("record_history").count() == 2
    assert "Stale: reread" in S.synthesis_markdown(store, "5->6") and S.synthesis_markdown(store, "none") == ""


def test_runs_outcomes_and_the_latest_of_each_key(spark, store):
    S.start_run(store, 1, "extract", "m")
    S.start_run(store, 2, "extract", "m")
    S.finish_run(store, 1, "done", {"n_calls": 3})
    S.close_orphans(store)
    assert {(r.run_id, r.status, r.n_calls) for r in store.read("runs").collect()} == {(1, "done", 3), (2, "interrupted", None)}
    S.record_outcomes(store, spark.createDataFrame([(1, "f", "odd", "r" * 2000), (1, "g", "saved", None)], "run_id bigint, filename string, category string, reason string"))
    assert {(r.filename, r.category, len(r.reason or "")) for r in store.read("outcomes").collect()} == {("f", "unknown", 1000), ("g", "saved", 0)}
    rows = spark.createDataFrame([("d", "A", "old", 1), ("d", "A", "new", 2), ("d", " ", "x", 3)], "doi string, abbrev string, long_form string, t int").withColumn("stored_at", F.timestamp_seconds("t"))
    S.store_latest(store, "abbreviations", rows.drop("t"))
    assert [(r.abbrev, r.long_form) for r in store.read("abbreviations").collect()] == [("A", "new")]


def test_layouts_and_names(spark, store):
    store.upsert("canonical", [(1, "a", "Cellular", "accepted", None, 3)])
    assert S.import_layout(store, '[{"node": "a", "x": 1, "y": 2, "pinned": true}, {"node": "b", "x": 0, "y": 0}]', "main") == 2
    S.copy_layout(store, "main", "other")
    S.rename_event(store, 1, "aa", "main")
    assert [p["node"] for p in json.loads(S.export_layout(store, "main"))] == ["aa", "b"] and [p["node"] for p in json.loads(S.export_layout(store, "other"))] == ["a", "b"]
    S.freeze(store, "map", spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([("a", "b")], "x string, y string"))
    assert json.loads(store.read("snapshots").first().payload)["edges"] == [{"x": "a", "y": "b"}]
    assert S.reject_event(store, 1, "me", "a thing") == 1 and store.read("canonical").first().status == "rejected"
    assert {r.name: r.n_rows for r in S.contents(store).collect()}["layouts"] == 4
