"""Claims consolidated into edges, and views of edges.

Every aggregate is independent of row order.  Numbers come from two plain aggregations, first by edge and paper and
then by edge, so distinct papers are counted without copies of the rows.  Text comes from one unpivoted frame: all
text columns that are asked for are counted together by (edge, column, item), ranked, and cut to the most items
that a column may have before anything is collected, so an edge with millions of claims never becomes
one array of claims.  Columns that by their definition list everything (``all_dois``, ``record_ids`` ...) are as long as
the evidence; ``edge_records`` gives the same as rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import claims as C
from evigraph.schemas import CAUSAL_EVIDENCE, DEFAULT_LEVEL, EVIDENCE_TYPES


class Text(NamedTuple):
    """An output made of the claims' text: the claim columns or SQL expressions it reads, the most items it may have,
    and whether a ";" parts a value.  ``modal`` ones take the most frequent value as it is written, of equally frequent
    ones the most upstream level, then the first alphabetically; others take spellings of any case together."""

    columns: tuple[str, ...]
    most: int | None = None
    split: bool = True
    modal: bool = False


#: Text outputs of an edge.  One item is the consensus value.
TEXTS = {
    "up_level": Text(("up_level",), 1, False, True), "down_level": Text(("down_level",), 1, False, True), "relation_kind": Text(("lower(trim(relation_kind))",), 1, False, True),
    "upstream_name": Text(("up_name",), 1, False), "downstream_name": Text(("down_name",), 1, False), "ker_name": Text(("ker_name",), 1, False), "ker_description": Text(("ker_description",), 1, False),
    "quantitative_relationships": Text(("quantitative",), 1, False), "response_response": Text(("response_response",), 1, False), "time_scale": Text(("time_scale",), 1, False),
    "essentiality_evidence": Text(("essentiality",), 5), "cell_types": Text(("cell_type", "down_cell_type"), 6), "measured_as": Text(("measured_as",), 4), "null_findings": Text(("null_findings",), 4),
    "study_contexts": Text(("study_context",), 4), "upstream_changes": Text(("up_change",), 6), "downstream_changes": Text(("down_change",), 6), "biological_plausibility": Text(("plausibility",), 4),
    "empirical_evidence": Text(("empirical",), 4), "all_taxa": Text(("taxa",)), "sexes": Text(("sex",)), "life_stages": Text(("life_stage",)), "study_designs": Text(("study_design",)), "stressors": Text(("stressor",), 8),
    "exposure_routes": Text(("exposure_route",), 5), "modulating_factors": Text(("modulating_factors",), 6), "feedback_loops": Text(("feedback_loops",), 4), "all_dois": Text(("doi",)),
    "supporting_dois": Text(("CASE WHEN NOT contradicts THEN doi END",)), "contradicting_dois": Text(("CASE WHEN contradicts THEN doi END",)), "cited_dois": Text(("cited_dois",), 20), "aop_ids": Text(("aop_id",)),
    "merged_upstream_labels": Text(("up_name",)), "merged_downstream_labels": Text(("down_name",)), "merged_ker_names": Text(("ker_name",), 10)}
#: Outputs that tell what was merged, which edges of literal names don't have.
MERGED = ("merged_upstream_labels", "merged_downstream_labels", "merged_ker_names", "n_distinct_raw_kers")
#: Outputs with a value where the claims have none (fixed values).
DEFAULTS = {"up_level": DEFAULT_LEVEL, "down_level": DEFAULT_LEVEL, "relation_kind": "causal"}
RAW_PAIRS = "raw_pairs"
#: Levels at which an event may start or end a pathway (fixed values).
MIE_LEVELS, AO_LEVELS = ("MIE", "Molecular"), ("Tissue", "Organ", "Individual", "Population")


def _present(claims: DataFrame, text: Text) -> list[str]:
    """The columns of an output that the claims have; expressions are taken to be there."""
    have = {c.lower() for c in claims.columns}
    return [c for c in text.columns if not c.isidentifier() or c.lower() in have]


def ranked_items(claims: DataFrame, keys: list[str], texts: dict[str, Text]) -> DataFrame:
    """(keys, text, n, item, lane, shorter): the different items of each output by edge, with how often each was given.

    ``text`` is the output's place in ``texts``.  The spelling that stands for an item is the longest, then the first.
    """
    # What is said of every value is said once, after the unpivot, so that the code for it stays small.
    entries = [F.struct(F.lit(n).alias("text"), F.expr(name).cast("string").alias("value")) for n, t in enumerate(texts.values()) for name in _present(claims, t)]
    modal = [n for n, t in enumerate(texts.values()) if t.modal]
    lists = [n for n, t in enumerate(texts.values()) if t.split]
    values = claims.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.*").where(~C.is_missing(F.col("value")))
    parts = F.when(F.col("text").isin(lists), F.split("value", ";")).otherwise(F.array("value")) if lists else F.array("value")
    long = values.select(*keys, "text", F.explode(parts).alias("item"))
    # Items as they are written are counted by hash; only what is left is brought together by spelling.
    exact = long.withColumn("item", F.trim("item")).where("item <> ''").groupBy(*keys, "text", "item").agg(F.count("*").alias("n"))
    is_modal = F.col("text").isin(modal) if modal else F.lit(False)
    spelled = F.struct(F.when(is_modal, 0).otherwise(-F.length("item")).alias("shorter"), F.col("item").alias("item"))
    folded = exact.groupBy(*keys, "text", F.when(is_modal, F.col("item")).otherwise(F.lower("item")).alias("folded")).agg(F.sum("n").alias("n"), F.min(spelled).alias("s"))
    lane = F.when(is_modal, C.known_level_index(F.col("s.item"))).otherwise(0)
    return folded.select(*keys, "text", "n", F.col("s.item").alias("item"), lane.alias("lane"), F.col("s.shorter").alias("shorter"))


def ranked_lists(claims: DataFrame, keys: list[str], texts: dict[str, Text], sep: str = "; ") -> DataFrame:
    """One row per key with each output of ``texts``: items by frequency, then the longest, then alphabetically."""
    items = ranked_items(claims, keys, texts)
    order = [F.desc("n"), F.asc("lane"), F.asc("shorter"), F.asc("item")]
    cut = [n for n, t in enumerate(texts.values()) if t.most]
    by = [*keys, "text"]
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    # All limits at most first, as a constant that lets partitions drop the rest before they are shuffled.
    widest = max([t.most for t in texts.values() if t.most], default=0)
    parts = []
    if cut:
        most = F.get(F.array(*(F.lit(t.most).cast("int") for t in texts.values())), F.col("text"))
        parts.append(items.where(F.col("text").isin(cut)).withColumn("place", place).where(F.col("place") <= widest).where(F.col("place") <= most).drop("place"))
    if len(cut) < len(texts):
        parts.append(items.where(~F.col("text").isin(cut)) if cut else items)
    left = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    entry = F.struct((-F.col("n")).alias("rarer"), "lane", "shorter", "item")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda s: s["item"]), sep)
    joined = left.groupBy(*by).agg(listed.alias("listed"))
    wide = joined.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("text", "listed"))).alias("m"))  # at most one entry per output
    return wide.select(*keys, *(F.try_element_at("m", F.lit(n)).alias(out) for n, out in enumerate(texts)))


def modal_level(claims: DataFrame, key: str, level: str, out: str) -> DataFrame:
    """The most frequent level of each key, ties going to the most upstream one."""
    counted = claims.groupBy(key, level).agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.min_by(level, F.struct((-F.col("n")).alias("rarer"), C.level_index(F.col(level)), F.col(level))).alias(out))


def _numbers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by edge: claims, papers, signs, evidence, verification."""
    count = lambda cond: F.count(F.when(cond, 1))
    vote = F.trim("adjacency")
    by_paper = rows.groupBy(*keys, "paper").agg(
        F.count("*").alias("n"), count(F.col("contradicts")).alias("contra"), count(F.col("sign") == "positive").alias("pos"), count(F.col("sign") == "negative").alias("neg"),
        F.max(C.evidence_rank(F.lower(F.trim("evidence_type")))).alias("rank"), count(F.lower(F.trim("evidence_type")) == "reverse_only").alias("reverse"), F.sum("n_spans").alias("spans"), F.sum("n_verified").alias("verified"),
        F.sum(F.expr("CASE trim(confidence) WHEN 'High' THEN 100 WHEN 'Medium' THEN 60 ELSE 25 END")).alias("cents"), F.bool_or(F.col("ker_id").isNotNull()).alias("registered"), count(vote == "Adjacent").alias("adjacent"), F.count(vote).alias("votes"),
        F.bool_or(C.is_marker(F.col("relation_kind"))).alias("marker"), F.bool_or(~C.is_missing(F.col("essentiality"))).alias("essential"), F.bool_or(~C.is_missing(F.col("quantitative"))).alias("quantitative"),
        F.bool_or(F.expr("aop_status = 'existing'") if "aop_status" in rows.columns else F.lit(False)).alias("existing"), F.min("up_id").alias("up_id"), F.min("down_id").alias("down_id"), F.max("extraction_date").alias("last"))
    total = {
        "n_source_rows": "n", "n_rows_contradicting": "contra", "n_positive": "pos", "n_negative": "neg", "n_reverse_only": "reverse", "n_spans": "spans", "n_verified": "verified", "cents": "cents", "n_adjacent": "adjacent", "n_votes": "votes"}
    anyone = {"in_registry": "registered", "any_marker": "marker", "has_essentiality": "essential", "has_quantitative": "quantitative", "is_existing": "existing"}
    return by_paper.groupBy(*keys).agg(
        F.count("*").alias("n_papers_total"), F.count(F.when(F.col("contra") > 0, 1)).alias("n_papers_contradicting"), F.max("rank").alias("rank"), F.min("up_id").alias("up_id"), F.min("down_id").alias("down_id"),
        F.max("last").alias("last_updated"), *(F.sum(c).alias(out) for out, c in total.items()), *(F.coalesce(F.bool_or(c), F.lit(False)).alias(out) for out, c in anyone.items()))


def _consolidated(claims: DataFrame, parts: dict[str, Column], ker_key: Column, texts: dict[str, Text], records: bool, pairs: bool) -> DataFrame:
    """One row per edge: ``parts`` are the columns that tell edges apart, of which none is null, ``ker_key`` is made of them."""
    paper = C.paper_identity(F.col("doi"), F.col("filename"), F.col("record_key"))
    rows = claims.withColumns(parts | {"paper": paper, "sign": F.lower(F.trim("direction"))})
    keys = list(parts)
    n, contra, pos, neg = (F.col(c) for c in ("n_source_rows", "n_papers_contradicting", "n_positive", "n_negative"))
    listed = ranked_lists(rows, keys, texts)
    edges = _numbers(rows, keys).join(listed, keys, "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items() if c in texts})
    if records and "record_id" in claims.columns:
        ids = F.array_join(F.transform(F.sort_array(F.collect_list("record_id")), lambda r: r.cast("string")), ",")
        edges = edges.join(rows.groupBy(*keys).agg(ids.alias("record_ids")), keys, "left")
    if pairs:
        raw = rows.groupBy(*keys, "up_name", "down_name").agg(F.lit(1).alias("one"))
        edges = edges.join(raw.groupBy(*keys).agg(F.count("*").alias("n_distinct_raw_kers")), keys, "left")
    strongest = F.element_at(F.array(*(F.lit(e) for e in reversed(EVIDENCE_TYPES))), F.col("rank") + 1)
    conflict, support = (pos > 0) & (neg > 0), F.col("n_papers_total") - contra
    verified = F.coalesce(F.col("n_verified") / F.nullif(F.col("n_spans"), F.lit(0)), F.lit(0.0))
    made = {
        "ker_key": ker_key, "n_rows_supporting": n - F.col("n_rows_contradicting"), "n_papers_supporting": support, "n_unsigned": n - pos - neg, "sign_conflict": conflict,
        "direction": F.when(conflict, "conflicting").when(pos > 0, "positive").when(neg > 0, "negative").otherwise("unclear"), "evidence_type": strongest, "is_causal": strongest.isin(*CAUSAL_EVIDENCE),
        "is_stressor": strongest == "common_stressor", "provenance_ratio": F.round(verified, 3), "evidence_level": C.evidence_level(F.col("n_papers_total")), "uncertainty_level": C.uncertainty_level(F.col("n_papers_total"), contra),
        "aop_status": F.when(F.col("is_existing"), "existing").otherwise("novel"), "review_status": F.lit("Draft"),
        "confidence_score": C.confidence_score(support, contra, F.col("has_essentiality"), F.col("has_quantitative"), verified, F.col("cents") / 100.0 / n, F.col("in_registry"), conflict, (n - pos - neg) / n, strongest)}
    if {"up_level", "down_level"} <= set(texts):
        gap = F.abs(C.level_index(F.col("up_level")) - C.level_index(F.col("down_level")))
        made |= {"level_gap": gap, "ker_adjacency": F.when((F.col("n_adjacent") >= F.greatest(F.lit(1), F.floor(F.col("n_votes") / 2))) & (gap <= 1), "Adjacent").otherwise("Non-adjacent")}
    if "relation_kind" in texts:
        made["relation_kind"] = F.when(F.col("any_marker"), "marker").otherwise(F.col("relation_kind"))
    if {"ker_name", "upstream_name", "downstream_name"} <= set(texts):
        made["ker_name"] = F.coalesce("ker_name", F.concat("upstream_name", F.lit(" leads to "), "downstream_name"))
    return edges.withColumns(made).withColumn("confidence_band", C.confidence_band(F.col("confidence_score"))).drop("cents", "rank", "any_marker", "n_adjacent", "n_votes", "is_existing", *keys)


#: What derived outputs are made of.
_NEEDS = {"level_gap": ("up_level", "down_level"), "ker_adjacency": ("up_level", "down_level"), "ker_name": ("ker_name", "upstream_name", "downstream_name")}


def edge_frame(claims: DataFrame, parts: dict[str, Column], ker_key: Column, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per edge: evidence counts, signs, strength, score and ranked text.

    With ``columns`` only these and what is cheap are made: text that isn't asked for isn't ranked.
    """
    asked = {*TEXTS, *MERGED, "record_ids"} if columns is None else {x for c in columns for x in (c, *_NEEDS.get(c, ()))}
    texts = {out: t for out, t in TEXTS.items() if out in asked} or {"up_level": TEXTS["up_level"]}
    return _consolidated(claims, parts, ker_key, texts, "record_ids" in asked, "n_distinct_raw_kers" in asked)


def canonical_parts(claims: DataFrame) -> tuple[dict[str, Column], Column]:
    """What tells consolidated edges apart: resolved ids, else registry ids, else names; and the key made of these."""
    wiki = [F.col(c) if c in claims.columns else F.lit(None).cast("bigint") for c in ("up_wiki_id", "down_wiki_id")]
    known, registered = F.col("up_id").isNotNull() & F.col("down_id").isNotNull(), wiki[0].isNotNull() & wiki[1].isNotNull()
    number = lambda own, other: F.when(known, F.col(own)).when(registered, other).otherwise(0).cast("bigint")
    name = lambda c: F.when(known | registered, "").otherwise(F.coalesce(F.lower(F.trim(c)), F.lit("")))
    parts = {"k_kind": F.when(known, "canon").when(registered, "wiki").otherwise("name"), "k_up": number("up_id", wiki[0]), "k_down": number("down_id", wiki[1]), "k_up_name": name("up_name"), "k_down_name": name("down_name")}
    by_name = F.col("k_kind") == "name"
    side = lambda c: F.when(by_name, F.col(f"{c}_name")).otherwise(F.col(c).cast("string"))
    return parts, F.concat_ws("::", "k_kind", side("k_up"), side("k_down"))


def canonical_edges(claims: DataFrame, *columns: str) -> DataFrame:
    parts, key = canonical_parts(claims)
    return edge_frame(claims, parts, key, columns or None)


def raw_edges(claims: DataFrame, *columns: str) -> DataFrame:
    """Edges of literal names, in any case."""
    tidy = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit(""))
    asked = columns or tuple(c for c in (*TEXTS, "record_ids") if c not in MERGED)
    return edge_frame(claims, {"k_up": tidy("up_name"), "k_down": tidy("down_name")}, F.concat_ws("::", F.lit("raw"), "k_up", "k_down"), asked)


def edge_records(claims: DataFrame) -> DataFrame:
    """(ker_key, record_id, record_key) of all claims: what ``record_ids`` lists, as rows."""
    parts, key = canonical_parts(claims)
    return claims.withColumns(parts).select(key.alias("ker_key"), "record_id", "record_key")


def claim_papers(claims: DataFrame) -> DataFrame:
    """(up_id, down_id, doi) of every claim that names its paper."""
    return claims.where(~C.is_missing(F.col("doi"))).select("up_id", "down_id", F.lower(F.trim("doi")).alias("doi"))


def edge_papers(claims: DataFrame) -> DataFrame:
    """(up_id, down_id, doi) once each: the papers on every consolidated edge."""
    return claim_papers(claims).distinct()


def pathway_order(edges: DataFrame) -> DataFrame:
    """Upstream lane, downstream lane, then the higher score first."""
    return edges.orderBy(C.level_index(F.col("up_level")), C.level_index(F.col("down_level")), F.desc("confidence_score"), "ker_key")


def reverse_pairs(edges: DataFrame) -> DataFrame:
    """Pairs of edges that run in both directions between two events, each pair once; self-loops don't count."""
    a, b = edges.alias("a"), edges.alias("b")
    both = (F.col("a.up_id") == F.col("b.down_id")) & (F.col("a.down_id") == F.col("b.up_id")) & (F.col("a.up_id") < F.col("a.down_id"))
    return a.join(b, both).select(F.col("a.ker_key").alias("forward"), F.col("b.ker_key").alias("backward"), F.col("a.direction").alias("forward_direction"), F.col("b.direction").alias("backward_direction"))


#: What ``event_degrees`` reads of an edge.
DEGREE_COLUMNS = ("upstream_name", "downstream_name", "up_level", "down_level", "relation_kind")


def event_degrees(edges: DataFrame) -> DataFrame:
    """One row per event: edges in and out, papers on them, with markers left out of the causal degrees.

    The level is that which most of its edges give it, of equally frequent ones the most upstream.
    """
    marker = F.col("relation_kind") == "marker"
    side = lambda name, level, out: F.struct(F.col(name).alias("event"), F.col(level).alias("level"), F.lit(out).alias("o"), F.lit(1 - out).alias("i"), (marker & F.lit(not out)).alias("marked"))
    ends = edges.select((~marker).alias("causal"), "n_papers_total", F.explode(F.array(side("upstream_name", "up_level", 1), side("downstream_name", "down_level", 0))).alias("e")).select("causal", "n_papers_total", "e.*")
    total = lambda c: F.sum(F.when(F.col("causal"), F.col(c)).otherwise(0))
    by_level = ends.groupBy("event", "level").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), total("o").alias("co"), total("i").alias("ci"), F.bool_or("marked").alias("marked"), F.sum("n_papers_total").alias("papers"))
    rank = F.struct((-(F.col("o") + F.col("i"))).alias("fewer"), C.level_index(F.col("level")), "level")
    return by_level.groupBy("event").agg(
        F.min_by("level", rank).alias("level"), F.sum("o").alias("out_any"), F.sum("i").alias("in_any"), F.sum("co").alias("n_out"), F.sum("ci").alias("n_in"), F.bool_or("marked").alias("is_marker_target"), F.sum("papers").alias("n_papers"))


def infer_roles(edges: DataFrame) -> DataFrame:
    """A role for each event from its degrees and level; a terminal event is never declared an outcome here."""
    n_in, n_out, level = F.col("n_in"), F.col("n_out"), F.col("level")
    marker, starts, stops = F.col("is_marker_target") & (n_out == 0), (n_in == 0) & (n_out > 0), (n_out == 0) & (n_in > 0)
    cases = (
        (marker, "marker", "high", "only measures another event"), (starts & level.isin(*MIE_LEVELS), "MIE", "medium", "nothing leads to it, and it is molecular"),
        (starts, "KE", "low", "nothing leads to it, but it isn't molecular"), (stops & level.isin(*AO_LEVELS), "KE", "medium", "leads to nothing at a level where outcomes are"), (stops, "KE", "high", "leads to nothing below that level"))
    pick = lambda at, rest: _chain([(c[0], c[at]) for c in cases], rest)
    return event_degrees(edges).select("event", "level", pick(1, "KE").alias("role"), pick(2, "high").alias("confidence"), pick(3, "has causes and consequences").alias("reason"), "n_in", "n_out")


def _chain(cases: list[tuple[Column, str]], rest: str) -> Column:
    found = F.lit(rest)
    for cond, value in reversed(cases):
        found = F.when(cond, value).otherwise(found)
    return found


def exclusion_reasons(edges: DataFrame, min_confidence: float = 0.3, min_papers: int = 2, max_gap: int = 2) -> DataFrame:
    """Edges with the first reason to hide them, or null: the order of the rules counts."""
    gap = C.level_index(F.col("down_level")) - C.level_index(F.col("up_level"))
    reason = F.when(F.col("ker_adjacency") == "Non-adjacent", "non_adjacent").when(F.abs(gap) > max_gap, "long_range").when(gap < 0, "backward")
    reason = reason.when(F.col("confidence_score") < min_confidence, "low_confidence").when(F.col("n_papers_supporting") < min_papers, "few_papers").when(state(F.col("n_papers_supporting"), F.col("n_papers_contradicting")) == "contradicted", "contradicted")
    return edges.withColumn("reason", reason)


def state(supporting: Column, contradicting: Column) -> Column:
    """Whether an edge is supported, contradicted or mixed, by papers."""
    return F.when((contradicting > 0) & (supporting > 0), "mixed").when(contradicting > 0, "contradicted").otherwise("supported")


def spanning_papers(claims: DataFrame) -> DataFrame:
    """(a_up, middle, b_down, n_spanning): pairs of edges a_up -> middle -> b_down that share papers, and how many.

    Joined on event and paper, so edges without a common paper never meet.
    """
    papers = edge_papers(claims)
    a = papers.select(F.col("up_id").alias("a_up"), F.col("down_id").alias("middle"), "doi")
    b = papers.select(F.col("up_id").alias("middle"), F.col("down_id").alias("b_down"), "doi")
    return a.join(b, ["middle", "doi"]).groupBy("a_up", "middle", "b_down").agg(F.count("*").alias("n_spanning"))
