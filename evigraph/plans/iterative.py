"""Queries that need iteration or Python; most have no SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.similarity import label_similarity
from evigraph.operators import entities, graphs
from evigraph.operators.edges import claim_papers
from evigraph.plans.registry import query


def forward(claims: DataFrame) -> DataFrame:
    """An acyclic graph over events: edges that lead to a larger id."""
    return claims.where("up_id < down_id").select(F.col("up_id").alias("a"), F.col("down_id").alias("b")).distinct()


@query("canonical_events", "labels_")
def canonical_events(labels: DataFrame) -> DataFrame:
    return entities.canonical_events(labels)


@query("er_rule_fuzzy", "labels_")
def er_rule_fuzzy(labels: DataFrame) -> DataFrame:
    return entities.fuzzy_pairs(entities.buckets(labels))


@query("er_crosswalk", "labels_")
def er_crosswalk(labels: DataFrame) -> DataFrame:
    return entities.canonical_events(labels).groupBy("event").agg(F.count("*").alias("n_labels"), F.countDistinct("normal").alias("n_forms")).orderBy(F.desc("n_labels"), "event")


@query("canonical_index", "labels_")
def canonical_index(labels: DataFrame) -> DataFrame:
    """Events numbered by their number of labels, the largest first."""
    sizes = entities.canonical_events(labels).groupBy("event").agg(F.count("*").alias("n_labels"))
    return graphs.numbered(sizes, F.desc("n_labels"), F.asc("event")).select("index", "event", "n_labels")


@query("er_alias_basis", "labels_")
def er_alias_basis(labels: DataFrame) -> DataFrame:
    """Why each label belongs to its event: the first rule that joined it to another."""
    return entities.canonical_events(labels).select("label", "event", "basis").distinct()


@query("label_similarity", "labels_")
def label_similarity_query(labels: DataFrame) -> DataFrame:
    """How alike labels of one level are that share a word, each pair once."""
    forms = entities.buckets(labels)
    words = forms.select("normal", "level", F.explode(F.array_distinct(F.split("normal", " "))).alias("w"))
    a, b = words.alias("a"), words.alias("b")
    met = a.join(b, (F.col("a.w") == F.col("b.w")) & (F.col("a.level") == F.col("b.level")) & (F.col("a.normal") < F.col("b.normal"))).select(F.col("a.normal").alias("left"), F.col("b.normal").alias("right")).distinct()
    return met.select("left", "right", label_similarity("left", "right").alias("score"))


@query("causal_depth", "claims")
def causal_depth(claims: DataFrame) -> DataFrame:
    return graphs.depth(forward(claims))


@query("pathway_chains", "claims")
def pathway_chains(claims: DataFrame) -> DataFrame:
    """All chains of at most three edges from a source to a sink, with the papers that span them; chains that none spans are inferred."""
    claims = graphs.stored(claims.where("up_id < down_id").select("up_id", "down_id", "doi"))  # read for the edges and for the papers
    chains = graphs.simple_paths(forward(claims), 3).select("path", F.size("path").alias("n_events"))
    return chain_papers(chains, claims).orderBy(F.desc("evidenced"), F.desc("n_events"), "path")


def chain_papers(chains: DataFrame, claims: DataFrame) -> DataFrame:
    """``chains`` (path, n_events) with n_spanning, the papers on every one of their edges, and whether there is one.

    Papers are bits, 64 to a number.  Beginnings that chains share grow by an edge at a time, with the papers that
    are on all edges so far; they go where none is left.
    """
    chains = graphs.stored(chains)
    most = chains.agg(F.max("n_events")).first()[0] or 0
    papers = claim_papers(claims)
    number = graphs.numbered(papers.select("doi").distinct(), F.asc("doi")).select("doi", "index")
    bit = F.expr("shiftleft(1L, cast(index & 63 AS int))")
    bits = graphs.stored(papers.join(number, "doi").groupBy("up_id", "down_id", F.shiftright("index", 6).alias("part")).agg(F.bit_or(bit).alias("bits")))
    grown, spanned = bits.select(F.array("up_id", "down_id").alias("path"), "part", "bits"), []
    for n in range(2, most + 1):
        if n > 2:
            edge = bits.select(F.col("up_id").alias("last"), "part", "down_id", F.col("bits").alias("more"))
            both = grown.withColumn("last", F.element_at("path", -1)).join(edge, ["last", "part"]).where(F.col("bits").bitwiseAND(F.col("more")) != 0)
            grown = both.select(F.concat("path", F.array("down_id")).alias("path"), "part", F.col("bits").bitwiseAND(F.col("more")).alias("bits"))
        begun = chains.where(F.col("n_events") >= n).select(F.slice("path", 1, n).alias("path"), (F.col("n_events") == n).alias("whole"))
        grown = graphs.stored(grown.join(begun.groupBy("path").agg(F.max("whole").alias("whole")), "path"))
        spanned.append(grown.where("whole").groupBy("path").agg(F.sum(F.bit_count("bits")).alias("n_spanning")))
        grown = grown.drop("whole")
    found = reduce(DataFrame.union, spanned) if spanned else chains.select("path", F.lit(0).cast("bigint").alias("n_spanning")).limit(0)
    return chains.join(found, "path", "left").select("path", "n_events", F.coalesce("n_spanning", F.lit(0)).alias("n_spanning"), F.col("n_spanning").isNotNull().alias("evidenced"))
