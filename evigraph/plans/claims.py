"""Queries over claims: scans, filters, joins, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import claims as C
from evigraph.plans.registry import query

PAPER = "coalesce('doi:' || lower(trim(doi)), 'file:' || lower(trim(filename)), 'record:' || record_key)"


def _paper():  # noqa: ANN202
    return C.paper_identity(F.col("doi"), F.col("filename"), F.col("record_key"))


def ends(claims: DataFrame) -> DataFrame:
    """Claims by event: one row for either end."""
    side = lambda a, b: F.struct(F.lit(a).alias("side"), F.col(f"{a}_id").alias("event"), F.col(f"{a}_name").alias("label"), F.col(f"{a}_level").alias("level"), F.col(f"{a}_change").alias("change"))  # noqa: E731, ARG005
    rest = [c for c in claims.columns if not c.startswith(("up_", "down_"))]
    return claims.select(*rest, F.explode(F.array(side("up", 0), side("down", 1))).alias("e")).select(*rest, "e.*")


ENDS = "ends AS (SELECT *, 'up' AS side, up_id AS event, up_name AS label, up_level AS level, up_change AS change FROM claims UNION ALL SELECT *, 'down', down_id, down_name, down_level, down_change FROM claims)"


@query("scan_claims", "claims", sql="SELECT record_id, record_key, up_name, down_name, direction, doi FROM claims")
def scan_claims(claims: DataFrame) -> DataFrame:
    return claims.select("record_id", "record_key", "up_name", "down_name", "direction", "doi").orderBy("record_id", "record_key")


@query("point_lookup", "claims", sql="SELECT record_key, up_id, down_id, doi FROM claims WHERE record_id = 11")
def point_lookup(claims: DataFrame) -> DataFrame:
    return claims.where("record_id = 11").select("record_key", "up_id", "down_id", "doi")


@query("distinct_dois", "claims", sql="SELECT DISTINCT doi FROM claims WHERE doi IS NOT NULL")
def distinct_dois(claims: DataFrame) -> DataFrame:
    return claims.where("doi IS NOT NULL").select("doi").distinct()


@query("paper_identity", "claims", sql=f"SELECT record_key, {PAPER} AS paper FROM claims")
def paper_identity(claims: DataFrame) -> DataFrame:
    return claims.select("record_key", _paper().alias("paper"))


@query("raw_key", "claims", sql="SELECT record_key, 'raw::' || lower(trim(up_name)) || '::' || lower(trim(down_name)) AS ker_key FROM claims")
def raw_key(claims: DataFrame) -> DataFrame:
    return claims.select("record_key", C.raw_key(F.col("up_name"), F.col("down_name")).alias("ker_key"))


@query("canonical_key", "claims", sql="""SELECT record_key, CASE WHEN up_id % 3 > 0 AND down_id % 3 > 0 THEN 'canon::' || up_id || '::' || down_id WHEN ker_id IS NOT NULL THEN 'wiki::' || ker_id || '::' || down_id ELSE 'name::' || lower(up_name) || '::' || lower(down_name) END AS ker_key FROM claims""")
def canonical_key(claims: DataFrame) -> DataFrame:
    known = lambda c: F.when(F.col(c) % 3 > 0, F.col(c))
    return claims.select("record_key", C.canonical_key(known("up_id"), known("down_id"), F.col("ker_id"), F.col("down_id"), F.col("up_name"), F.col("down_name")).alias("ker_key"))


@query("drop_rejected_claims", "claims", "labels", sql="SELECT c.record_key, CASE WHEN quality = 0 THEN 'rejected' WHEN quality IS NOT NULL THEN 'accepted' ELSE 'unreviewed' END AS status FROM claims c LEFT JOIN labels l ON l.doc_id = c.record_id WHERE coalesce(quality, 1) <> 0")
def drop_rejected_claims(claims: DataFrame, review: DataFrame) -> DataFrame:
    ruled = review.select(F.col("doc_id").alias("record_id"), F.when(F.col("quality") == 0, "rejected").otherwise("accepted").alias("status"))
    return claims.join(ruled, "record_id", "left").select("record_key", F.coalesce("status", F.lit("unreviewed")).alias("status")).where("status <> 'rejected'")


@query("null_normalise", "events", sql="SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS tidy FROM events")
def null_normalise(events: DataFrame) -> DataFrame:
    noisy = F.when(F.col("event_type") == "view", F.element_at(F.array(*map(F.lit, (" NaN", "none", "", "<NA> "))), (F.col("event_id") % 4 + 1).cast("int"))).otherwise(F.col("event_type"))
    return events.select("event_id", C.present(noisy).alias("tidy"))


@query("clean_text", "claims", sql="SELECT record_key, CASE WHEN essentiality IS NULL THEN NULL ELSE essentiality END AS clean FROM claims")
def clean_text(claims: DataFrame) -> DataFrame:
    text = F.coalesce("essentiality", F.lit(" Not specified "))
    return claims.select("record_key", F.when(~C.is_missing(text) & (F.lower(F.trim(text)) != "not specified"), text).alias("clean"))


@query("validate_claims", "claims", sql="""SELECT record_key, list_filter([CASE WHEN doi IS NULL AND filename IS NULL THEN 'no source' END, CASE WHEN up_id = down_id THEN 'self loop' END, CASE WHEN n_verified = 0 THEN 'nothing verified' END, CASE WHEN cell_type IS NULL THEN 'no cell type' END], lambda m: m IS NOT NULL) AS problems FROM claims""")
def validate_claims(claims: DataFrame) -> DataFrame:
    rules = {"no source": "doi IS NULL AND filename IS NULL", "self loop": "up_id = down_id", "nothing verified": "n_verified = 0", "no cell type": "cell_type IS NULL"}
    return claims.select("record_key", F.filter(F.array(*(F.when(F.expr(rule), name) for name, rule in rules.items())), lambda m: m.isNotNull()).alias("problems"))


ARROW = "CASE direction WHEN 'positive' THEN '→' WHEN 'negative' THEN '⊣' WHEN 'none' THEN '⇢' ELSE '→?' END"


def directed(claims: DataFrame) -> F.Column:
    arrow = F.when(F.col("direction") == "positive", "→").when(F.col("direction") == "negative", "⊣").when(F.col("direction") == "none", "⇢").otherwise("→?")
    return F.concat_ws(" ", "up_change", "up_name", arrow, "down_change", "down_name")


@query("directed_claim", "claims", sql=f"SELECT record_key, concat_ws(' ', up_change, up_name, {ARROW}, down_change, down_name) AS sentence FROM claims")
def directed_claim(claims: DataFrame) -> DataFrame:
    return claims.select("record_key", directed(claims).alias("sentence"))


@query("claims_reading_view", "claims", sql=f"SELECT record_key, doi, concat_ws(' ', up_change, up_name, {ARROW}, down_change, down_name) AS claim, CASE WHEN contradicts THEN 'yes' ELSE '' END AS contradicts, evidence_type FROM claims")
def claims_reading_view(claims: DataFrame) -> DataFrame:
    return claims.select("record_key", "doi", directed(claims).alias("claim"), F.when(F.col("contradicts"), "yes").otherwise("").alias("contradicts"), "evidence_type")


@query("level_index", "claims", sql="SELECT record_key, list_position(['MIE','Molecular','Cellular','Tissue','Organ','Individual','Population'], noisy_level) - 1 AS lane FROM claims")
def level_index(claims: DataFrame) -> DataFrame:
    return claims.select("record_key", C.level_index(F.col("noisy_level")).alias("lane"))


@query("sign_of", "claims", sql="SELECT record_key, CASE WHEN regexp_matches(coalesce(down_change, ''), '^(increas|elevat|gain)') THEN '↑' WHEN regexp_matches(coalesce(down_change, ''), '^(decreas|reduc|lost|loss|abolish|impair)') THEN '↓' ELSE '' END AS arrow FROM claims")
def sign_of(claims: DataFrame) -> DataFrame:
    return claims.select("record_key", C.sign_of(F.col("down_change")).alias("arrow"))


@query("derive_coupling", "claims", sql="""SELECT record_key, CASE WHEN up_change IN ('increased', 'decreased') AND d = 'no change' THEN 'none' WHEN up_change NOT IN ('increased', 'decreased') OR d NOT IN ('increased', 'decreased') THEN 'unclear' WHEN up_change = d THEN 'positive' ELSE 'negative' END AS coupling
    FROM (SELECT *, CASE record_id % 3 WHEN 0 THEN 'increased' WHEN 1 THEN 'decreased' ELSE 'no change' END AS d FROM claims)""")
def derive_coupling(claims: DataFrame) -> DataFrame:
    down = F.when(F.col("record_id") % 3 == 0, "increased").when(F.col("record_id") % 3 == 1, "decreased").otherwise("no change")
    return claims.select("record_key", C.derive_coupling(F.col("up_change"), down).alias("coupling"))


for _name, _function, _sql in (
    ("evidence_level", C.evidence_level, "CASE WHEN n <= 3 THEN 'Low' WHEN n <= 8 THEN 'Moderate' ELSE 'High' END"),):
    @query(_name, "claims", sql=f"SELECT doi, {_sql} AS level FROM (SELECT doi, count(*) AS n FROM claims GROUP BY doi)")
    def _level(claims: DataFrame, function=_function) -> DataFrame:  # noqa: ANN001
        return claims.groupBy("doi").agg(F.count("*").alias("n")).select("doi", function(F.col("n")).alias("level"))


@query("uncertainty_level", "claims", sql="SELECT up_id, CASE WHEN k = 0 THEN 'Low' WHEN k <= 0.25 * n THEN 'Moderate' ELSE 'High' END AS level FROM (SELECT up_id, count(*) AS n, count(*) FILTER (contradicts) AS k FROM claims GROUP BY up_id)")
def uncertainty_level(claims: DataFrame) -> DataFrame:
    counted = claims.groupBy("up_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("contradicts"), 1)).alias("k"))
    return counted.select("up_id", C.uncertainty_level(F.col("n"), F.col("k")).alias("level"))


@query("level_mode", "claims", sql="""SELECT up_id, arg_min(noisy_level, (-n, lane)) AS level FROM (SELECT up_id, noisy_level, count(*) AS n, list_position(['MIE','Molecular','Cellular','Tissue','Organ','Individual','Population'], noisy_level) AS lane FROM claims GROUP BY 1, 2) GROUP BY up_id""")
def level_mode(claims: DataFrame) -> DataFrame:
    from evigraph.operators.edges import modal_level

    return modal_level(claims, "up_id", "noisy_level", "level")


ITEMS = "i AS (SELECT up_id, trim(unnest(string_split(stressor, ';'))) AS item FROM claims), r AS (SELECT up_id, lower(item) AS f, count(*) AS n, arg_min(item, (-length(item), item)) AS item FROM i GROUP BY 1, 2)"


@query("rank_items", "claims", sql=f"WITH {ITEMS} SELECT up_id, item, n, row_number() OVER (PARTITION BY up_id ORDER BY n DESC, length(item) DESC, item) AS rank FROM r")
def rank_items(claims: DataFrame) -> DataFrame:
    from evigraph.operators.edges import Text, ranked_items

    order = Window.partitionBy("up_id").orderBy(F.desc("n"), F.desc(F.length("item")), "item")
    return ranked_items(claims, ["up_id"], {"s": Text(("stressor",))}).select("up_id", "item", "n", F.row_number().over(order).alias("rank"))


@query("join_unique_topn", "claims", sql=f"WITH {ITEMS} SELECT up_id, array_to_string(list(item ORDER BY n DESC, length(item) DESC, item)[1:8], '; ') AS stressors FROM r GROUP BY up_id")
def join_unique_topn(claims: DataFrame) -> DataFrame:
    from evigraph.operators.edges import Text, ranked_lists

    return ranked_lists(claims, ["up_id"], {"stressors": Text(("stressor",), 8)})


@query("consensus_value", "claims", sql=f"WITH {ITEMS} SELECT up_id, arg_min(item, (-n, -length(item), item)) AS stressor FROM r GROUP BY up_id")
def consensus_value(claims: DataFrame) -> DataFrame:
    from evigraph.operators.edges import Text, ranked_lists

    return ranked_lists(claims, ["up_id"], {"stressor": Text(("stressor",), 1)})


@query("confidence_score", "claims", sql="""WITH g AS (SELECT up_id, count(DISTINCT doi) AS s, count(*) FILTER (contradicts) AS k, sum(n_verified) / sum(n_spans) AS v FROM claims GROUP BY up_id)
    SELECT up_id, floor(round(1e6 * greatest(0.0, least(1.0, (0.3 * least(1.0, s / 5.0::DOUBLE) * (1 - 0.6::DOUBLE * k / (s + k)) + 0.2::DOUBLE + 0.15::DOUBLE * v + 0.06::DOUBLE) * 0.7::DOUBLE))) / 1e3 + 0.5) / 1e3 AS score FROM g""")
def confidence_score(claims: DataFrame) -> DataFrame:
    g = claims.groupBy("up_id").agg(F.countDistinct("doi").alias("s"), F.count(F.when(F.col("contradicts"), 1)).alias("k"), (F.sum("n_verified") / F.sum("n_spans")).alias("v"))
    yes, no = F.lit(True), F.lit(False)
    return g.select("up_id", C.confidence_score(F.col("s"), F.col("k"), yes, no, F.col("v"), F.lit(0.6), no, no, F.lit(0.0), F.lit("correlation")).alias("score"))


@query("confidence_band", "claims", sql="SELECT record_key, CASE WHEN n_spans / 7 >= 0.66 THEN 'High' WHEN n_spans / 7 >= 0.36 THEN 'Moderate' ELSE 'Low' END AS band FROM claims")
def confidence_band(claims: DataFrame) -> DataFrame:
    return claims.select("record_key", C.confidence_band(F.col("n_spans") / 7).alias("band"))


@query("unpivot_ends", "claims", sql=f"WITH {ENDS} SELECT record_key, side, event, label, level FROM ends")
def unpivot_ends(claims: DataFrame) -> DataFrame:
    return ends(claims).select("record_key", "side", "event", "label", "level")


@query("event_claims", "claims", sql="SELECT record_key, CASE WHEN up_id = 13 THEN 'up' ELSE 'down' END AS side, CASE WHEN up_id = 13 THEN up_change ELSE down_change END AS change FROM claims WHERE (up_id = 13 OR down_id = 13) AND CASE WHEN up_id = 13 THEN up_change ELSE down_change END IS NOT NULL")
def event_claims(claims: DataFrame) -> DataFrame:
    side = F.when(F.col("up_id") == 13, "up").otherwise("down")
    return claims.where("up_id = 13 OR down_id = 13").select("record_key", side.alias("side"), F.when(side == "up", F.col("up_change")).otherwise(F.col("down_change")).alias("change")).where("change IS NOT NULL")


def first_items(rows: DataFrame, keys: list[str], column: str, most: int, out: str) -> DataFrame:
    """(keys, out): the first items of a column by key; what is beyond them is dropped before anything is collected."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(column))
    kept = rows.where(F.col(column).isNotNull()).select(*keys, column).distinct().withColumn("place", place).where(F.col("place") <= most)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list(column)).alias(out))


@query("node_evidence", "claims", sql=f"WITH {ENDS} SELECT event, count(*) AS n_claims, count(DISTINCT doi) AS n_papers, list_sort(list_distinct(list(change) FILTER (change IS NOT NULL)))[1:6] AS changes, coalesce(list_sort(list_distinct(list(cell_type) FILTER (cell_type IS NOT NULL)))[1:4], []) AS cells FROM ends GROUP BY event")
def node_evidence(claims: DataFrame) -> DataFrame:
    rows = ends(claims)
    counted = rows.groupBy("event").agg(F.count("*").alias("n_claims"), F.countDistinct("doi").alias("n_papers"))
    listed = counted.join(first_items(rows, ["event"], "change", 6, "changes"), "event", "left").join(first_items(rows, ["event"], "cell_type", 4, "cells"), "event", "left")
    return listed.withColumn("cells", F.coalesce("cells", F.array().cast("array<string>")))


CHANGES = f"WITH {ENDS}, ch AS (SELECT event, change, count(*) AS n FROM ends WHERE change IS NOT NULL GROUP BY 1, 2)"


@query("observed_summary", "claims", sql=f"{CHANGES} SELECT event, string_agg(change || ' in ' || n, ', ' ORDER BY n DESC, change) AS summary FROM ch GROUP BY event")
def observed_summary(claims: DataFrame) -> DataFrame:
    counted = ends(claims).where("change IS NOT NULL").groupBy("event", "change").agg(F.count("*").alias("n"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("r"), "change")))
    return counted.groupBy("event").agg(F.array_join(F.transform(order, lambda s: F.concat(s["change"], F.lit(" in "), (-s["r"]).cast("string"))), ", ").alias("summary"))


@query("dominant_change", "claims", sql=f"""{CHANGES} SELECT event, CASE WHEN u AND d THEN '±' WHEN u THEN '↑' WHEN d THEN '↓' ELSE '' END AS mark FROM (SELECT event, bool_or(regexp_matches(change, '^(increas|elevat|gain)')) AS u, bool_or(regexp_matches(change, '^(decreas|reduc|lost|loss|abolish|impair)')) AS d FROM ch GROUP BY event)""")
def dominant_change(claims: DataFrame) -> DataFrame:
    signs = ends(claims).where("change IS NOT NULL").withColumn("s", C.sign_of(F.col("change")))
    found = signs.groupBy("event").agg(F.bool_or(F.col("s") == "↑").alias("u"), F.bool_or(F.col("s") == "↓").alias("d"))
    return found.select("event", F.when(F.col("u") & F.col("d"), "±").when(F.col("u"), "↑").when(F.col("d"), "↓").otherwise("").alias("mark"))


@query("context_conflicts", "claims", sql=f"WITH {ENDS} SELECT event, count(DISTINCT cell_type) AS n_contexts FROM ends GROUP BY event HAVING count(DISTINCT cell_type) > 1")
def context_conflicts(claims: DataFrame) -> DataFrame:
    return ends(claims).groupBy("event").agg(F.countDistinct("cell_type").alias("n_contexts")).where("n_contexts > 1")


@query("label_evidence", "claims", sql=f"""WITH {ENDS}, m AS (SELECT label, arg_min(level, (-n, lane)) AS level FROM (SELECT label, level, count(*) AS n, list_position(['MIE','Molecular','Cellular','Tissue','Organ','Individual','Population'], level) AS lane FROM ends GROUP BY 1, 2) GROUP BY label),
    t AS (SELECT label, list(change ORDER BY n DESC, change)[1:3] AS changes FROM (SELECT label, change, count(*) AS n FROM ends WHERE change IS NOT NULL GROUP BY 1, 2) GROUP BY label)
    SELECT e.label, count(*) AS n_claims, count(DISTINCT doi) AS n_papers, m.level, t.changes FROM ends e JOIN m ON m.label = e.label LEFT JOIN t ON t.label = e.label GROUP BY e.label, m.level, t.changes""")
def label_evidence(claims: DataFrame) -> DataFrame:
    """Claims, papers, the usual level and the three most frequent changes of every label."""
    from evigraph.operators.edges import modal_level

    rows = ends(claims)
    counted = rows.where("change IS NOT NULL").groupBy("label", "change").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "change"))
    top = counted.withColumn("place", place).where("place <= 3").groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "change"))), lambda s: s["change"]).alias("changes"))
    summed = rows.groupBy("label").agg(F.count("*").alias("n_claims"), F.countDistinct("doi").alias("n_papers"))
    return summed.join(modal_level(rows, "label", "level", "level"), "label").join(top, "label", "left")


@query("relationship_roster", "claims", sql="SELECT up_id, down_id, count(*) AS n_claims, count(DISTINCT doi) AS n_papers, up_id % 2 = 0 AND down_id % 3 > 0 AS both_approved FROM claims GROUP BY up_id, down_id")
def relationship_roster(claims: DataFrame) -> DataFrame:
    counted = claims.groupBy("up_id", "down_id").agg(F.count("*").alias("n_claims"), F.countDistinct("doi").alias("n_papers"))
    return counted.withColumn("both_approved", (F.col("up_id") % 2 == 0) & (F.col("down_id") % 3 > 0))


@query("approved_edges", "claims", sql="""SELECT up_id, down_id, n AS n_claims, CASE WHEN k * 2 > n THEN 'contradictory' WHEN k > 0 THEN 'mixed' ELSE 'supporting' END AS verdict, any_adjacent, dois[1:6] AS dois FROM (
    SELECT up_id, down_id, count(*) AS n, count(*) FILTER (contradicts) AS k, bool_or(adjacency = 'Adjacent') AS any_adjacent, coalesce(list_sort(list_distinct(list(doi) FILTER (doi IS NOT NULL))), []) AS dois FROM claims WHERE up_id % 2 = 0 AND down_id % 3 > 0 GROUP BY 1, 2)""")
def approved_edges(claims: DataFrame) -> DataFrame:
    rows = claims.where("up_id % 2 = 0 AND down_id % 3 > 0")
    g = rows.groupBy("up_id", "down_id").agg(F.count("*").alias("n_claims"), F.count(F.when(F.col("contradicts"), 1)).alias("k"), F.bool_or(F.col("adjacency") == "Adjacent").alias("any_adjacent"))
    g = g.join(first_items(rows, ["up_id", "down_id"], "doi", 6, "dois"), ["up_id", "down_id"], "left")
    verdict = F.when(F.col("k") * 2 > F.col("n_claims"), "contradictory").when(F.col("k") > 0, "mixed").otherwise("supporting")
    return g.select("up_id", "down_id", "n_claims", verdict.alias("verdict"), "any_adjacent", F.coalesce("dois", F.array().cast("array<string>")).alias("dois"))


@query("available_edges", "claims", sql="SELECT up_id % 2 = 0 AND down_id % 3 > 0 AS allowed, count(DISTINCT (up_id, down_id)) AS n_edges, count(DISTINCT doi) AS n_papers FROM claims GROUP BY 1")
def available_edges(claims: DataFrame) -> DataFrame:
    return claims.groupBy(((F.col("up_id") % 2 == 0) & (F.col("down_id") % 3 > 0)).alias("allowed")).agg(F.countDistinct("up_id", "down_id").alias("n_edges"), F.countDistinct("doi").alias("n_papers"))


@query("decision_support", "claims", sql=f"SELECT up_id, count(DISTINCT {PAPER}) AS n_papers, count(*) FILTER (contradicts) AS n_contradicting, CAST(sum(n_spans) AS BIGINT) AS n_spans, round(100 * sum(n_verified) / sum(n_spans), 1) AS verified_pct FROM claims GROUP BY up_id")
def decision_support(claims: DataFrame) -> DataFrame:
    return claims.groupBy("up_id").agg(F.countDistinct(_paper()).alias("n_papers"), F.count(F.when(F.col("contradicts"), 1)).alias("n_contradicting"), F.sum("n_spans").alias("n_spans"), F.round(100 * F.sum("n_verified") / F.sum("n_spans"), 1).alias("verified_pct"))


@query("sign_partition", "claims", sql="SELECT up_id, direction, count(*) AS n FROM claims GROUP BY ALL")
def sign_partition(claims: DataFrame) -> DataFrame:
    return claims.groupBy("up_id", "direction").agg(F.count("*").alias("n"))


@query("papers_rollup", "claims", sql="SELECT doi, max(extraction_date) AS last_extraction, count(*) AS n_claims, CAST(sum(n_spans) AS BIGINT) AS n_spans FROM claims GROUP BY doi")
def papers_rollup(claims: DataFrame) -> DataFrame:
    return claims.groupBy("doi").agg(F.max("extraction_date").alias("last_extraction"), F.count("*").alias("n_claims"), F.sum("n_spans").alias("n_spans"))


@query("corpus_counts", "claims", sql=f"""SELECT (SELECT count(*) FROM claims) AS n_claims, (SELECT count(DISTINCT {PAPER}) FROM claims) AS n_papers, (SELECT count(*) FROM (SELECT DISTINCT up_id, down_id FROM claims)) AS n_edges,
    (SELECT count(*) FROM (SELECT up_name FROM claims UNION ALL SELECT down_name FROM claims)) AS n_mentions, (SELECT count(*) FROM (SELECT up_name FROM claims UNION SELECT down_name FROM claims)) AS n_labels, (SELECT count(*) FROM claims WHERE contradicts) AS n_contradicting, (SELECT CAST(sum(n_spans) AS BIGINT) FROM claims) AS n_spans""")
def corpus_counts(claims: DataFrame) -> DataFrame:
    labels = ends(claims).agg(F.count("label").alias("n_mentions"), F.countDistinct("label").alias("n_labels"))
    counted = claims.agg(F.count("*").alias("n_claims"), F.countDistinct(_paper()).alias("n_papers"), F.countDistinct("up_id", "down_id").alias("n_edges"), F.count(F.when(F.col("contradicts"), 1)).alias("n_contradicting"), F.sum("n_spans").alias("n_spans"))
    return counted.crossJoin(labels)  # one row each


@query("contributing_papers", "claims", sql=f"SELECT up_id, down_id, count(DISTINCT {PAPER}) AS n_papers FROM claims GROUP BY ALL")
def contributing_papers(claims: DataFrame) -> DataFrame:
    return claims.groupBy("up_id", "down_id").agg(F.countDistinct(_paper()).alias("n_papers"))


@query("known_event_names", "claims", sql="SELECT DISTINCT name FROM (SELECT up_name AS name FROM claims UNION ALL SELECT down_name FROM claims)")
def known_event_names(claims: DataFrame) -> DataFrame:
    return ends(claims).select(F.col("label").alias("name")).distinct().orderBy(F.lower("name"), "name")


@query("node_level_mode", "claims", sql=f"WITH {ENDS}, n AS (SELECT event, noisy_level, count(*) AS n, list_position(['MIE','Molecular','Cellular','Tissue','Organ','Individual','Population'], noisy_level) AS lane FROM ends GROUP BY 1, 2) SELECT event, arg_min(noisy_level, (-n, lane)) AS level FROM n GROUP BY event")
def node_level_mode(claims: DataFrame) -> DataFrame:
    from evigraph.operators.edges import modal_level

    return modal_level(ends(claims), "event", "noisy_level", "level")


@query("initial_order", "claims", sql=f"WITH {ENDS}, m AS (SELECT event, arg_min(level, (-n, lane)) AS level FROM (SELECT event, level, count(*) AS n, list_position(['MIE','Molecular','Cellular','Tissue','Organ','Individual','Population'], level) AS lane FROM ends GROUP BY 1, 2) GROUP BY event) SELECT event, level, row_number() OVER (PARTITION BY level ORDER BY event) - 1 AS place FROM m")
def initial_order(claims: DataFrame) -> DataFrame:
    from evigraph.operators.edges import modal_level

    placed = modal_level(ends(claims), "event", "level", "level")
    return placed.withColumn("place", F.row_number().over(Window.partitionBy("level").orderBy("event")) - 1)


@query("role_graph", "claims", sql="SELECT DISTINCT up_id, down_id FROM claims WHERE up_id <> down_id")
def role_graph(claims: DataFrame) -> DataFrame:
    return claims.where("up_id <> down_id").select("up_id", "down_id").distinct()


@query("merge_preview", "claims", sql="SELECT CASE WHEN up_id IN (3, 5, 8) THEN 3 ELSE up_id END AS up, CASE WHEN down_id IN (3, 5, 8) THEN 3 ELSE down_id END AS down, count(*) AS n_claims, count(DISTINCT (up_id, down_id)) AS n_edges FROM claims WHERE up_id IN (3, 5, 8) OR down_id IN (3, 5, 8) GROUP BY 1, 2")
def merge_preview(claims: DataFrame) -> DataFrame:
    moved = lambda c: F.when(F.col(c).isin(3, 5, 8), 3).otherwise(F.col(c)).cast("bigint")
    return claims.where("up_id IN (3, 5, 8) OR down_id IN (3, 5, 8)").groupBy(moved("up_id").alias("up"), moved("down_id").alias("down")).agg(F.count("*").alias("n_claims"), F.countDistinct("up_id", "down_id").alias("n_edges"))


@query("override_ends", "claims", sql="SELECT record_key, CASE WHEN record_id % 10 = 0 THEN 1000 ELSE up_id END AS up_id, CASE WHEN record_id % 15 = 0 THEN 2000 ELSE down_id END AS down_id FROM claims")
def override_ends(claims: DataFrame) -> DataFrame:
    over = claims.where("record_id % 5 = 0").select("record_key", F.when(F.col("record_id") % 10 == 0, 1000).alias("new_up"), F.when(F.col("record_id") % 15 == 0, 2000).alias("new_down"))
    return claims.join(over, "record_key", "left").select("record_key", F.coalesce("new_up", "up_id").alias("up_id"), F.coalesce("new_down", "down_id").alias("down_id"))


@query("synthesis_blocks", "claims", sql="""WITH r AS (SELECT up_id, down_id, concat_ws(' | ', doi, essentiality, quantitative) AS body, row_number() OVER (PARTITION BY up_id, down_id ORDER BY lower(doi) NULLS FIRST, record_id, record_key, concat_ws(' | ', doi, essentiality, quantitative)) AS k FROM claims)
    SELECT up_id, down_id, string_agg('[' || k || '] ' || body, chr(10) ORDER BY k) AS prompt FROM r GROUP BY up_id, down_id""")
def synthesis_blocks(claims: DataFrame) -> DataFrame:
    return blocks_by(claims, "up_id", "down_id")


def blocks_by(claims: DataFrame, *keys: str) -> DataFrame:
    """One prompt for each key: numbered claims in a fixed order."""
    body = F.concat_ws(" | ", "doi", "essentiality", "quantitative")
    order = Window.partitionBy(*keys).orderBy(F.lower("doi"), "record_id", "record_key", body)
    rows = claims.select(*keys, F.row_number().over(order).alias("k"), body.alias("body"))
    blocks = F.transform(F.sort_array(F.collect_list(F.struct("k", "body"))), lambda s: F.concat(F.lit("["), s["k"].cast("string"), F.lit("] "), s["body"]))
    return rows.groupBy(*keys).agg(F.array_join(blocks, "\n").alias("prompt"))


@query("scan_spans_citation", "claims", sql="SELECT record_key, concat_ws(' — ', coalesce(doi, filename), 'p. ' || n_spans) AS citation, n_verified = n_spans AS verified FROM claims")
def scan_spans_citation(claims: DataFrame) -> DataFrame:
    return claims.select("record_key", F.concat_ws(" — ", F.coalesce("doi", "filename"), F.concat(F.lit("p. "), "n_spans")).alias("citation"), (F.col("n_verified") == F.col("n_spans")).alias("verified"))


@query("unverified_quotes", "claims", sql="SELECT record_key, doi, n_spans - n_verified AS n_unverified FROM claims WHERE n_verified < n_spans")
def unverified_quotes(claims: DataFrame) -> DataFrame:
    return claims.where("n_verified < n_spans").select("record_key", "doi", (F.col("n_spans") - F.col("n_verified")).alias("n_unverified"))


@query("qc_per_paper", "claims", sql="SELECT run_id, doi, count(*) AS n_claims, CAST(sum(n_spans) AS BIGINT) AS n_spans, round(100 * sum(n_verified) / nullif(sum(n_spans), 0), 1) AS verified_pct FROM claims GROUP BY ALL")
def qc_per_paper(claims: DataFrame) -> DataFrame:
    return claims.groupBy("run_id", "doi").agg(F.count("*").alias("n_claims"), F.sum("n_spans").alias("n_spans"), F.round(100 * F.sum("n_verified") / F.nullif(F.sum("n_spans"), F.lit(0)), 1).alias("verified_pct"))


@query("resolve_both_ends", "claims", "canonical", sql="SELECT record_key, coalesce(u.canonical_name, up_name) AS up, coalesce(d.canonical_name, down_name) AS down, u.canonical_id AS up_canonical, coalesce(d.level, down_level) AS down_level FROM claims LEFT JOIN canonical u ON u.canonical_id = up_id * 20 LEFT JOIN canonical d ON d.canonical_id = down_id * 40")
def resolve_both_ends(claims: DataFrame, canonical: DataFrame) -> DataFrame:
    u, d = (canonical.select(*(F.col(c).alias(f"{p}_{c}") for c in ("canonical_id", "canonical_name", "level"))) for p in ("u", "d"))
    joined = claims.join(u, F.col("u_canonical_id") == F.col("up_id") * 20, "left").join(d, F.col("d_canonical_id") == F.col("down_id") * 40, "left")
    return joined.select("record_key", F.coalesce("u_canonical_name", "up_name").alias("up"), F.coalesce("d_canonical_name", "down_name").alias("down"), F.col("u_canonical_id").alias("up_canonical"), F.coalesce("d_level", "down_level").alias("down_level"))
