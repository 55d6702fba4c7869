"""Queries over drawings of the graph, its paths, and abbreviations of papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions import abbreviations as A
from evigraph.operators import layout as G
from evigraph.plans.registry import query

LEVELS = 7


def forward(claims: DataFrame) -> DataFrame:
    """Edges to a larger id that span few ids, with the number of papers: a graph without cycles and of moderate depth."""
    near = claims.where("up_id < down_id AND down_id - up_id > 12")
    return near.groupBy(F.col("up_id").alias("a"), F.col("down_id").alias("b")).agg(F.countDistinct("doi").cast("double").alias("weight"))


def lanes(claims: DataFrame) -> DataFrame:
    return claims.select(F.explode(F.array("up_id", "down_id")).alias("node")).distinct().withColumn("lane", F.col("node") % LEVELS)


@query("barycentre", "claims")
def barycentre(claims: DataFrame) -> DataFrame:
    return G.barycentre(lanes(claims), forward(claims))


@query("layered_positions", "claims")
def layered_positions(claims: DataFrame) -> DataFrame:
    """Places of all events, of which some were saved by a curator."""
    placed = G.barycentre(lanes(claims), forward(claims), sweeps=2)
    saved = lanes(claims).where("node % 10 = 0").select("node", F.lit(5.0).alias("x"), (F.col("node") * 2.0).alias("y"))
    return G.layered_positions(placed, saved)


def roles(claims: DataFrame) -> DataFrame:
    return lanes(claims).where("node < 4 OR node > 95").select("node", F.when(F.col("node") < 4, "MIE").otherwise("AO").alias("role"))


@query("layout_rows", "claims")
def layout_rows(claims: DataFrame) -> DataFrame:
    return G.causal_layout(forward(claims), roles(claims))


@query("layout_validate", "claims", sql="SELECT DISTINCT up_id AS a, down_id AS b, CAST(up_id % 7 AS BIGINT) AS column_a, CAST(down_id % 7 AS BIGINT) AS column_b FROM claims WHERE up_id < down_id AND down_id - up_id > 12 AND down_id % 7 < up_id % 7")
def layout_validate(claims: DataFrame) -> DataFrame:
    """Edges that point to the left in a drawing by level."""
    return G.backward_edges(forward(claims), lanes(claims).select("node", F.col("lane").alias("column")))


@query("backbone", "claims", sql="""WITH RECURSIVE e AS (SELECT up_id AS a, down_id AS b, count(DISTINCT doi)::DOUBLE AS w FROM claims WHERE up_id < down_id AND down_id - up_id > 12 GROUP BY 1, 2),
    p(node, weight, hops) AS (SELECT a, 0::DOUBLE, 0 FROM e UNION SELECT e.b, max(p.weight + e.w), p.hops + 1 FROM p JOIN e ON e.a = p.node GROUP BY e.b, p.hops) SELECT node, max(weight) AS weight FROM (SELECT node, weight FROM p UNION ALL SELECT b, 0 FROM e) GROUP BY node""")
def backbone(claims: DataFrame) -> DataFrame:
    """The weight of the heaviest path to each event."""
    return G.backbone(forward(claims)).select("node", "weight")


@query("anchor_path", "claims")
def anchor_path(claims: DataFrame) -> DataFrame:
    """A shortest path from the smallest to the largest event in the steps of each run."""
    steps = claims.where("up_id <> down_id").select(F.col("run_id").alias("grp"), F.col("up_id").alias("a"), F.col("down_id").alias("b")).distinct()
    ends = steps.groupBy("grp").agg(F.min("a").alias("start"), F.max("b").alias("stop"))
    return G.shortest_path(steps.join(ends, "grp")).select("grp", "path", F.size("path").alias("n_events"))


DEFINED = """defs AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'OPC' WHEN 1 THEN 'ALT' ELSE 'HSC' END AS abbrev, CASE doc_id % 3 WHEN 0 THEN 'oligodendrocyte precursor cell' WHEN 1 THEN 'alanine aminotransferase' ELSE CASE WHEN doc_id % 2 = 0 THEN 'hepatic stellate cell' ELSE 'hematopoietic stem cell' END END AS long_form FROM documents)"""


def with_definitions(docs: DataFrame) -> DataFrame:
    """Documents in which a sentence defines an abbreviation."""
    k = F.col("doc_id") % 3
    said = F.when(k == 0, "The oligodendrocyte precursor cells (OPCs) were").when(k == 1, "Serum alanine aminotransferase (ALT) and (see Fig) was").when(F.col("doc_id") % 2 == 0, "a hepatic stellate cell (HSC) is").otherwise("the hematopoietic stem cell (HSC) is")
    return docs.select("doc_id", F.concat(F.substring("text", 1, 200), F.lit(". "), said, F.lit(" here (p < 0.05; n = 3).")).alias("text"))


@query("abbrev_harvest", "documents")
def abbrev_harvest(docs: DataFrame) -> DataFrame:
    return A.harvest(with_definitions(docs), "doc_id")


def definitions(docs: DataFrame) -> DataFrame:
    k = F.col("doc_id") % 3
    long = F.when(k == 0, "oligodendrocyte precursor cell").when(k == 1, "alanine aminotransferase").when(F.col("doc_id") % 2 == 0, "hepatic stellate cell").otherwise("hematopoietic stem cell")
    return docs.select("doc_id", F.when(k == 0, "OPC").when(k == 1, "ALT").otherwise("HSC").alias("abbrev"), long.alias("long_form"))


@query("abbrev_map", "documents", sql=f"WITH {DEFINED} SELECT doc_id, abbrev || '=' || long_form AS table_text FROM defs")
def abbrev_map(docs: DataFrame) -> DataFrame:
    """The abbreviations of each paper as one map, shown as text."""
    folded = definitions(docs).groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("abbrev", "long_form")))).alias("m"))
    return folded.select("doc_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])), "; ").alias("table_text"))


@query("agreed_abbrev", "documents", sql=f"WITH {DEFINED} SELECT abbrev, CASE WHEN count(DISTINCT long_form) = 1 THEN min(long_form) END AS long_form, count(DISTINCT long_form) AS n_forms, count(DISTINCT doc_id) AS n_papers FROM defs GROUP BY abbrev")
def agreed_abbrev(docs: DataFrame) -> DataFrame:
    return A.agreed(definitions(docs), "doc_id")


@query("abbrev_overlap", "documents", sql=f"WITH {DEFINED} SELECT DISTINCT abbrev, long_form, 1::BIGINT AS n_shared FROM defs WHERE long_form LIKE '%oligodendrocyte%' OR long_form LIKE '%stellate%'")
def abbrev_overlap(docs: DataFrame) -> DataFrame:
    """Abbreviations that stand for something that a vocabulary is about."""
    terms = docs.sparkSession.range(1).select(F.explode(F.array(F.lit("oligodendrocytes maturation"), F.lit("stellated"))).alias("term"))
    return A.about(definitions(docs).select("abbrev", "long_form").distinct(), terms)


@query("abbrev_expand", "documents", sql="SELECT doc_id, 'loss of oligodendrocyte precursor cell and ' || CASE WHEN doc_id % 2 = 0 THEN 'optical' ELSE 'alanine aminotransferase' END AS label FROM documents")
def abbrev_expand(docs: DataFrame) -> DataFrame:
    """Labels with the agreed abbreviations written out."""
    table = F.array(F.struct(F.lit("OPC").alias("abbrev"), F.lit("Oligodendrocyte precursor cell").alias("long_form")), F.struct(F.lit("ALT").alias("abbrev"), F.lit("alanine aminotransferase").alias("long_form")))
    return docs.select("doc_id", A.expanded(F.concat(F.lit("loss of OPCs and "), F.when(F.col("doc_id") % 2 == 0, "optical").otherwise("alt")), table).alias("label"))
