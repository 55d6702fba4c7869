"""Documents on literal text: sections, chunks, quotations, identifiers, JSON, abbreviations."""

import json

import pytest
from pyspark.sql import functions as F

from evigraph.functions import abbreviations as A
from evigraph.functions import salvage
from evigraph.functions import text as T
from evigraph.operators import documents as D

PAPER = "Title line of a paper\n\nfirst words\n\nAbstract\n" + "a" * 50 + "\n\n1. Introduction\nsome text\nmore text\n\n" + "b" * 90 + "\n\n" + "c" * 30 + "\n3.2 Markers of stress\nshort\nReferences\n[1] gone"


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(("line", "kind"), [("2. Materials and Methods", "methods"), ("Summary", "abstract"), ("3.1 Ion channels", "other"), ("OTHER, DATA", "other"), ("results of this", "results"), ("plain prose", None), ("", None), ("x" * 91, None), ("FUNDING", "back"), ("AB", None)])
def test_headings(spark, line, kind):
    assert one(spark, line, T.heading_kind) == kind


def test_chunks(spark):
    made = D.build_chunks(spark.createDataFrame([(1, PAPER), (2, None), (3, "")], "doc_id bigint, text string"), "doc_id", target=60, least=40).orderBy("chunk").collect()
    assert [(r.section, r.section_kind) for r in made] == [("Body", "other"), ("Abstract", "abstract"), ("1. Introduction", "intro"), ("3.2 Markers of stress", "other")]
    assert made[2].text == "1. Introduction\nsome text\nmore text\n\n" + "b" * 90 + "\n\n" + "c" * 30  # the last, short one joined
    assert all(PAPER[r.char_start :].startswith(r.text.split("\n\n")[0]) for r in made)


def test_selection_passes_over_what_does_not_fit():
    chunk = lambda n, size, score, kind="results": {"chunk": n, "n_chars": size, "score": score, "section_kind": kind}
    rows = [chunk(1, 30, 0.1, "abstract"), chunk(2, 80, 0.9), chunk(3, 60, 0.8), chunk(4, 10, 0.7), chunk(5, 5, 0.01)]
    assert D.chosen(rows, 100, 0.15, ("abstract",), None) == [1, 3, 4]
    assert D.chosen(rows, 100, 0.15, ("abstract",), 2) == [1, 3]
    assert D.chosen([chunk(1, 500, 0.2), chunk(2, 500, 0.3)], 100, 0.15, (), None) == [2]


def test_quotations(spark):
    docs = spark.createDataFrame([(1, "The neurotoxicity was seen in all animals."), (2, "Dose–dependent\n loss  of ﬁbres was found here"), (3, "cellsinotherbrainregionsatonce"), (4, None)], "doc_id bigint, text string")
    asked = [(1, "toxicity was seen in all"), (2, "dose-dependent loss of fibres WAS"), (3, "cells in other brain regions"), (4, "too short"), (5, "never written anywhere at all"), (6, "neurotoxicitywasseen")]
    got = {(r.quote_id, r.doc_id): r.ratio for r in D.locate_quotes(docs, spark.createDataFrame(asked, "quote_id bigint, quote string")).collect()}
    assert got == {(1, 1): 1.0, (2, 2): 1.0, (3, 3): 0.99, (6, 1): 0.99}


def test_quotations_in_chunks(spark):
    chunks = spark.createDataFrame([(1, 1, "nothing of the kind"), (1, 2, "Myelin was lost in treated animals."), (1, 3, "myelin was lost in treated animals again"), (2, 1, "myelin was lost in treated animals")], "doc_id bigint, chunk_id int, text string")
    asked = spark.createDataFrame([(1, 1, "myelin was lost in treated"), (2, 1, "myelin was found lost in treated animals"), (3, 1, "quite another sentence of no chunk"), (4, 9, "myelin was lost in treated")], "quote_id bigint, doc_id bigint, quote string")
    got = {r.quote_id: (r.chunk_id, r.verified) for r in D.locate_in_chunks(chunks, asked).collect()}
    assert got == {1: (2, True), 2: (3, False), 3: (None, False), 4: (None, False)} or got == {1: (2, True), 2: (2, False), 3: (None, False), 4: (None, False)}


@pytest.mark.parametrize(("text", "doi"), [("10.1/x 10.1234/abc. doi: 10.5555/Q.2).", "10.5555/q.2"), ("see 10.1234/AB;", "10.1234/ab"), ("none", None), ("", None), (None, None)])
def test_dois(spark, text, doi):
    assert one(spark, text, T.find_doi) == doi


@pytest.mark.parametrize(("term", "text", "found"), [("OPC", "two OPCs,", True), ("OL", "control", False), ("NaV1.6", "at NaV1.6, here", True), ("voltage-gated", "voltage gated channel", True), ("a.c", "abc", False), ("ion channel", "ion\nchannels", True), ("", "x", False), (None, "x", False)])
def test_terms(spark, term, text, found):
    assert spark.createDataFrame([(text, term)], "t string, m string").select(T.matches_term(F.col("t"), F.col("m"))).first()[0] is found


def test_one_sentence_quoted_twice_is_one(spark):
    prints = {one(spark, q, lambda c: T.quote_fingerprint(T.clean_quote(c))) for q in ("However, notably, the Cells died.", "“the cells died”", "[c001 | x] The cells -- died!")}
    assert prints == {"the cells died"}


@pytest.mark.parametrize(("reply", "value", "how"), [
    ('```json\n{"a": 1}\n```', {"a": 1}, "whole"), ('Sure: [1, 2] as asked', [1, 2], "whole"), ('{"a": [{"b": 1}, {"b": 2}, {"b": "cut', {"a": [{"b": 1}, {"b": 2}], "_truncated": True}, "truncated"),
    ('{"s": [{"k": "v"}, {"k": "a "bad" one"}, {"k": 3}]}', {"s": [{"k": "v"}], "_truncated": True}, "malformed"), ("nothing", None, "none"), ("", None, "none"), (None, None, "none"), ('{"a', None, "none"), ('[1, 2, "x"', [1, 2, "x"], "truncated")])
def test_salvage(reply, value, how):
    got, told = salvage.salvage(reply)
    assert (json.loads(got) if got else None, told) == (value, how)


def test_abbreviations(spark):
    text = "Cells were kept. We saw oligodendrocyte precursor cells (OPCs) and, in serum, alanine aminotransferase (ALT). A rise (see Fig) of it (n) in the (XYZ) group; voltage-gated sodium channel (VGSC)."
    assert A.defined(text) == {"OPC": "oligodendrocyte precursor cells", "ALT": "alanine aminotransferase", "VGSC": "voltage-gated sodium channel"}
    told = spark.createDataFrame([(1, "A", "one"), (2, "A", "ONE "), (1, "B", "x"), (2, "B", "y"), (3, " ", "z")], "doc bigint, abbrev string, long_form string")
    assert {(r.abbrev, r.long_form, r.n_papers) for r in A.agreed(told, "doc").collect()} == {("A", "one", 2), ("B", None, 2)}
