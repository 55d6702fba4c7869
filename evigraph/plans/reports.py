"""Queries for reports and exports: quality of runs, decisions, table counts, registries, graphs as rows of JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import claims as C
from evigraph.functions.vocabulary import norm_event
from evigraph.operators import edges as E
from evigraph.plans.edge_sql import CANONICAL_KEY, NARROW
from evigraph.plans.registry import query

# From when on a run's figures are worth a word.
LEAST_VERIFIED, MOST_REPAIRED = 0.40, 0.10
RUNS = """runs AS (SELECT run_id, count(*) AS n_claims, CAST(sum(n_spans) AS BIGINT) AS n_spans, CAST(sum(n_verified) AS BIGINT) AS n_verified, count(*) FILTER (contradicts) AS repairs, count(DISTINCT doi) AS n_papers FROM claims GROUP BY run_id)"""


def runs(claims: DataFrame) -> DataFrame:
    return claims.groupBy("run_id").agg(F.count("*").alias("n_claims"), F.sum("n_spans").alias("n_spans"), F.sum("n_verified").alias("n_verified"), F.count(F.when(F.col("contradicts"), 1)).alias("repairs"), F.countDistinct("doi").alias("n_papers"))


@query("qc_flags", "claims", sql=f"""WITH {RUNS} SELECT run_id, list_filter([CASE WHEN n_spans = 0 AND n_claims > 0 THEN 'no quotations at all' WHEN n_verified / n_spans < 0.72 THEN 'only ' || CAST(round(100 * n_verified / n_spans) AS INT) || ' % of quotations located' END,
    CASE WHEN repairs / n_claims > 0.1 THEN CAST(round(100 * repairs / n_claims) AS INT) || ' % of replies repaired' END, CASE WHEN run_id % 7 = 0 THEN 'no code version recorded' END], lambda m: m IS NOT NULL) AS flags FROM runs""")
def qc_flags(claims: DataFrame) -> DataFrame:
    """Reasons to distrust each run, in the order of weight; the stand-in's threshold of verification is 0.72 so that some runs fall short."""
    return flagged(runs(claims), 0.72).select("run_id", "flags")


def flagged(figures: DataFrame, least_verified: float = LEAST_VERIFIED) -> DataFrame:
    share = lambda a, b: F.round(100 * F.col(a) / F.col(b)).cast("int").cast("string")
    rules = (
        F.when((F.col("n_spans") == 0) & (F.col("n_claims") > 0), "no quotations at all").when(F.col("n_verified") / F.nullif(F.col("n_spans"), F.lit(0)) < least_verified, F.concat(F.lit("only "), share("n_verified", "n_spans"), F.lit(" % of quotations located"))),
        F.when(F.col("repairs") / F.nullif(F.col("n_claims"), F.lit(0)) > MOST_REPAIRED, F.concat(share("repairs", "n_claims"), F.lit(" % of replies repaired"))), F.when(F.col("run_id") % 7 == 0, "no code version recorded"))
    return figures.withColumn("flags", F.filter(F.array(*rules), lambda m: m.isNotNull()))


@query("qc_markdown", "claims")
def qc_markdown(claims: DataFrame) -> DataFrame:
    """The lines of a quality report in Markdown, a section for each run."""
    made = flagged(runs(claims), 0.72)
    bullets = F.transform("flags", lambda f: F.concat(F.lit("- "), f))
    head = F.array(F.concat(F.lit("## Run "), F.col("run_id")), F.concat(F.lit("| claims | "), "n_claims", F.lit(" |")), F.concat(F.lit("| papers | "), "n_papers", F.lit(" |")), F.concat(F.lit("| quotations | "), "n_spans", F.lit(" |")))
    return made.select("run_id", F.posexplode(F.concat(head, bullets)).alias("line_no", "line")).orderBy("run_id", "line_no")


@query("stage_report", "claims", "workflow_log")
def stage_report(claims: DataFrame, log: DataFrame) -> DataFrame:
    """The lines of a report in Markdown: corpus, states, outstanding work."""
    sections = (
        ("1 corpus", claims.agg(F.concat(F.lit("- claims: "), F.count("*")).alias("line"))), ("1 corpus", claims.agg(F.concat(F.lit("- papers: "), F.countDistinct("doi")).alias("line"))),
        ("2 states", log.groupBy("state").agg(F.count("*").alias("n")).select(F.concat(F.lit("- "), "state", F.lit(": "), "n").alias("line"))),
        ("3 outstanding", claims.where("n_verified < n_spans").agg(F.concat(F.lit("- claims with quotations to check: "), F.count("*")).alias("line"))))
    return reduce(DataFrame.unionByName, (f.select(F.lit(name).alias("section"), "line") for name, f in sections)).orderBy("section", "line")


@query("decisions_union", "workflow_log", "claims", "roles", sql="""SELECT 'curation decision' AS section, CAST(target_id AS VARCHAR) AS subject, state AS detail, '' AS classification, note AS curator, '' AS rationale, CAST(log_id AS VARCHAR) AS at FROM workflow_log WHERE state = 'curated'
    UNION ALL SELECT 'approval', target_type || ' ' || target_id, 'curated -> ' || state, '', note, '', CAST(log_id AS VARCHAR) FROM workflow_log WHERE state = 'approved'
    UNION ALL SELECT DISTINCT 'developer assessment', up_id || '->' || down_id, 'not assessed', '', '', '', '' FROM claims UNION ALL SELECT 'pathway endpoint', event, role, '', '', '', '' FROM roles""")
def decisions_union(log: DataFrame, claims: DataFrame, roles: DataFrame) -> DataFrame:
    """All decisions of four kinds as one flat table of fixed columns."""
    blank, when = F.lit(""), F.col("log_id").cast("string")
    row = lambda frame, section, subject, detail, curator=blank, at=blank: frame.select(F.lit(section).alias("section"), subject.alias("subject"), detail.alias("detail"), blank.alias("classification"), curator.alias("curator"), blank.alias("rationale"), at.alias("at"))
    parts = (
        row(log.where("state = 'curated'"), "curation decision", F.col("target_id").cast("string"), F.col("state"), F.col("note"), when),
        row(log.where("state = 'approved'"), "approval", F.concat_ws(" ", "target_type", "target_id"), F.concat(F.lit("curated -> "), "state"), F.col("note"), when),
        row(claims.select("up_id", "down_id").distinct(), "developer assessment", F.concat_ws("->", "up_id", "down_id"), F.lit("not assessed")), row(roles, "pathway endpoint", F.col("event"), F.col("role")))
    return reduce(DataFrame.unionByName, parts)


@query("table_counts", "claims", "canonical", "alias", "workflow_log", sql="SELECT 'claims' AS name, count(*) AS n FROM claims UNION ALL SELECT 'canonical', count(*) FROM canonical UNION ALL SELECT 'alias', count(*) FROM alias UNION ALL SELECT 'workflow_log', count(*) FROM workflow_log")
def table_counts(*frames: DataFrame) -> DataFrame:
    names = ("claims", "canonical", "alias", "workflow_log")
    return reduce(DataFrame.unionByName, (f.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, f in zip(names, frames, strict=True)))


@query("synth_run_left_join", "claims", "telemetry", sql=f"WITH s AS (SELECT DISTINCT {CANONICAL_KEY} AS ker_key, CASE WHEN up_id % 4 > 0 THEN up_id END AS run_id FROM claims), r AS (SELECT run_id, min(ts) AS started FROM telemetry GROUP BY 1) SELECT ker_key, s.run_id, started, r.run_id IS NOT NULL AS documented FROM s LEFT JOIN r ON r.run_id = s.run_id")
def synth_run_left_join(claims: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Every stored synthesis with the run that made it; those without a recorded run are listed, too."""
    made = claims.select("up_id", "down_id").distinct().select(F.concat(F.lit("canon::"), "up_id", F.lit("::"), "down_id").alias("ker_key"), F.when(F.col("up_id") % 4 > 0, F.col("up_id")).alias("run_id"))
    known = telemetry.groupBy("run_id").agg(F.min("ts").alias("started")).withColumn("documented", F.lit(True))
    return made.join(known, "run_id", "left").select("ker_key", "run_id", "started", F.coalesce("documented", F.lit(False)).alias("documented"))


@query("csv_scrub", "documents", sql=r"SELECT doc_id, md5(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) AS text_digest, lang, source FROM documents")
def csv_scrub(docs: DataFrame) -> DataFrame:
    return scrubbed(docs).select("doc_id", F.md5("text").alias("text_digest"), "lang", "source")


def scrubbed(frame: DataFrame) -> DataFrame:
    """A frame without control characters in its text columns, but tabs and line ends."""
    return frame.withColumns({f.name: F.regexp_replace(f.name, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "") for f in frame.schema if f.dataType.simpleString() == "string"})


def write_csv(frame: DataFrame, path: str, notice: str | None = None) -> None:
    """Write a scrubbed frame as CSV with a header; a notice goes beside it, as every part of a distributed file would have to bear it."""
    scrubbed(frame).write.mode("overwrite").option("header", True).csv(path)
    if notice:
        frame.sparkSession.createDataFrame([(line,) for line in notice.splitlines()], "line string").coalesce(1).write.mode("overwrite").text(f"{path}.notice")


@query("graph_json", "claims", sql=f"""{NARROW} SELECT 'edge' AS kind, ker_key AS id, to_json({{'from': upstream_name, 'to': downstream_name, 'papers': n_papers_total, 'direction': direction}}) AS body FROM edges
    UNION ALL SELECT 'node', event, to_json({{'name': event, 'edges': count(*)}}) FROM (SELECT upstream_name AS event FROM edges UNION ALL SELECT downstream_name FROM edges) GROUP BY event""")
def graph_json(claims: DataFrame) -> DataFrame:
    """The graph as JSON, one row for each node and edge."""
    edges = E.canonical_edges(claims, "upstream_name", "downstream_name")
    body = F.struct(F.col("upstream_name").alias("from"), F.col("downstream_name").alias("to"), F.col("n_papers_total").alias("papers"), "direction")
    lines = edges.select(F.lit("edge").alias("kind"), F.col("ker_key").alias("id"), F.to_json(body).alias("body"))
    nodes = edges.select(F.explode(F.array("upstream_name", "downstream_name")).alias("event")).groupBy("event").agg(F.count("*").alias("n"))
    return lines.unionByName(nodes.select(F.lit("node").alias("kind"), F.col("event").alias("id"), F.to_json(F.struct(F.col("event").alias("name"), F.col("n").alias("edges"))).alias("body")))


@query("approved_payload", "claims", "workflow_log", sql=f"""WITH s AS (SELECT target_id, arg_max(state, (logged_at, log_id)) IN ('approved', 'synthesized') AS ok FROM workflow_log GROUP BY 1), e AS (SELECT DISTINCT up_id, down_id FROM claims)
    SELECT up_id, down_id, to_json({{'source': up_id, 'target': down_id}}) AS edge FROM e JOIN s u ON u.target_id = up_id AND u.ok JOIN s d ON d.target_id = down_id AND d.ok""")
def approved_payload(claims: DataFrame, log: DataFrame) -> DataFrame:
    """Edges whose two events are approved, as JSON."""
    passed = log.groupBy("target_id").agg(F.max_by("state", F.struct("logged_at", "log_id")).alias("state")).where("state IN ('approved', 'synthesized')").select("target_id")
    edges = claims.select("up_id", "down_id").distinct()
    for end in ("up_id", "down_id"):
        edges = edges.join(passed.withColumnRenamed("target_id", end), end, "left_semi")
    return edges.select("up_id", "down_id", F.to_json(F.struct(F.col("up_id").alias("source"), F.col("down_id").alias("target"))).alias("edge"))


@query("replicate_report", "telemetry", sql="""WITH v AS (SELECT run_id % 20 AS paper, event_id % 4 AS replicate, bool_or(event_type = 'purchase') AS found FROM telemetry GROUP BY 1, 2), k AS (SELECT paper, count(*) AS n_replicates, round(avg(CASE WHEN found THEN 1.0 ELSE 0.0 END), 4) AS rate FROM v GROUP BY paper)
    SELECT paper, n_replicates, rate, CASE WHEN rate IN (0, 1) THEN 'unanimous' ELSE 'split' END AS vote FROM k WHERE n_replicates = 4""")
def replicate_report(events: DataFrame) -> DataFrame:
    """How often repeated runs agree on a paper; papers that some replicate lacks are left out."""
    votes = events.groupBy((F.col("run_id") % 20).alias("paper"), (F.col("event_id") % 4).alias("replicate")).agg(F.bool_or(F.col("event_type") == "purchase").alias("found"))
    rates = votes.groupBy("paper").agg(F.count("*").alias("n_replicates"), F.round(F.avg(F.col("found").cast("int")), 4).alias("rate")).where("n_replicates = 4")
    return rates.withColumn("vote", F.when(F.col("rate").isin(0.0, 1.0), "unanimous").otherwise("split"))


@query("path_direction", "claims", sql="""WITH s AS (SELECT run_id, up_id, CASE WHEN bool_or(direction NOT IN ('positive', 'negative')) THEN 'unclear' WHEN count(*) FILTER (direction = 'negative') % 2 = 1 THEN 'negative' ELSE 'positive' END AS sign, count(*) AS n_steps FROM claims GROUP BY 1, 2) SELECT * FROM s""")
def path_direction(claims: DataFrame) -> DataFrame:
    """The sign of a path: that of the product of its steps', unclear if any step's is."""
    unsigned = F.bool_or(~F.col("direction").isin("positive", "negative"))
    odd = F.count(F.when(F.col("direction") == "negative", 1)) % 2 == 1
    return claims.groupBy("run_id", "up_id").agg(F.when(unsigned, "unclear").when(odd, "negative").otherwise("positive").alias("sign"), F.count("*").alias("n_steps"))


@query("indirect_row", "claims", sql="""WITH s AS (SELECT *, CASE evidence_type WHEN 'rescue' THEN 5 WHEN 'perturbation' THEN 4 WHEN 'common_stressor' THEN 3 WHEN 'correlation' THEN 2 WHEN 'reverse_only' THEN 1 ELSE 0 END AS e, row_number() OVER w AS k, row_number() OVER (PARTITION BY run_id ORDER BY record_id DESC, record_key DESC) AS z FROM claims WINDOW w AS (PARTITION BY run_id ORDER BY record_id, record_key))
    SELECT run_id, max(CASE WHEN k = 1 THEN up_id END) AS up_id, max(CASE WHEN z = 1 THEN down_id END) AS down_id, ['not_stated', 'reverse_only', 'correlation', 'common_stressor', 'perturbation', 'rescue'][min(e) + 1] AS evidence_type, bool_or(contradicts) AS contradicts, 'Non-adjacent' AS adjacency FROM s GROUP BY run_id""")
def indirect_row(claims: DataFrame) -> DataFrame:
    """A path of steps as one indirect claim: its ends, the weakest evidence, and whether any step contradicts."""
    at = F.struct("record_id", "record_key")
    names = F.array(*(F.lit(e) for e in reversed(E.EVIDENCE_TYPES)))
    return claims.groupBy("run_id").agg(
        F.min_by("up_id", at).alias("up_id"), F.max_by("down_id", at).alias("down_id"), F.element_at(names, F.min(C.evidence_rank(F.col("evidence_type"))) + 1).alias("evidence_type"), F.bool_or("contradicts").alias("contradicts"), F.lit("Non-adjacent").alias("adjacency"))


@query("pathway_steps", "claims", sql="SELECT run_id, up_id, down_id, min(record_key) AS first_key, count(*) AS n_copies FROM claims WHERE up_id <> down_id AND n_spans > 0 GROUP BY 1, 2, 3")
def pathway_steps(claims: DataFrame) -> DataFrame:
    """The steps of a paper's pathway, each once: with a quotation, and from one event to another."""
    return claims.where("up_id <> down_id AND n_spans > 0").groupBy("run_id", "up_id", "down_id").agg(F.min("record_key").alias("first_key"), F.count("*").alias("n_copies"))


@query("pathway_rows", "claims", sql="""WITH s AS (SELECT DISTINCT run_id, up_id, down_id FROM claims WHERE up_id <> down_id AND n_spans > 0) SELECT run_id, up_id, down_id, 'step' AS kind FROM s
    UNION ALL SELECT a.run_id, a.up_id, b.down_id, 'indirect' FROM s a JOIN s b ON a.run_id = b.run_id AND a.down_id = b.up_id AND a.up_id <> b.down_id LEFT JOIN s c ON c.run_id = a.run_id AND c.up_id = a.up_id AND c.down_id = b.down_id WHERE c.run_id IS NULL GROUP BY ALL""")
def pathway_rows(claims: DataFrame) -> DataFrame:
    """The steps, and an indirect row for every two that meet where the paper has no direct one."""
    steps = pathway_steps(claims).select("run_id", "up_id", "down_id")
    a, b = steps.toDF("run_id", "up_id", "middle"), steps.toDF("run_id", "middle", "down_id")
    across = a.join(b, ["run_id", "middle"]).where("up_id <> down_id").select("run_id", "up_id", "down_id").distinct()
    inferred = across.join(steps, ["run_id", "up_id", "down_id"], "left_anti")
    return steps.withColumn("kind", F.lit("step")).unionByName(inferred.withColumn("kind", F.lit("indirect")))


@query("band_for", "claims", sql=f"SELECT record_key, CASE WHEN up_id % 9 = 0 THEN 'MIE' WHEN up_id % 9 = 1 THEN 'AO' WHEN n_spans <= 1 THEN 'Intermediate' WHEN n_verified / n_spans <= 0.34 THEN 'Early' WHEN n_verified / n_spans <= 0.67 THEN 'Intermediate' ELSE 'Late' END AS band FROM claims")
def band_for(claims: DataFrame) -> DataFrame:
    from evigraph.operators.layout import band_for as band

    role = F.when(F.col("up_id") % 9 == 0, "MIE").when(F.col("up_id") % 9 == 1, "AO").otherwise("KE")
    return claims.select("record_key", band(F.col("n_verified"), F.col("n_spans"), role).alias("band"))


_NAME = "CASE canonical_id % 3 WHEN 0 THEN lower(canonical_name) WHEN 1 THEN lower(canonical_name) || ' level' ELSE substr(lower(canonical_name), 1, length(canonical_name) - 1) END"


@query("fuzzy_title_lookup", "canonical", sql=f"""WITH n AS (SELECT canonical_id AS key, {_NAME} AS name FROM canonical), g AS (SELECT lower(canonical_name) AS title, min(canonical_id) AS ke_id FROM canonical WHERE canonical_id % 2 = 0 GROUP BY 1),
    m AS (SELECT key, ke_id, row_number() OVER (PARTITION BY key ORDER BY title = name DESC, abs(length(title) - length(name)), ke_id) AS k FROM n JOIN g ON contains(name, title) OR contains(title, name)) SELECT key, ke_id FROM m WHERE k = 1""")
def fuzzy_title_lookup(canonical: DataFrame) -> DataFrame:
    """The registry's event for a name: the same title, else one that holds the name or is held by it, the closest in length."""
    names = canonical.select(F.col("canonical_id").alias("key"), F.expr(_NAME).alias("name"))
    titles = canonical.where("canonical_id % 2 = 0").select(F.col("canonical_id").alias("ke_id"), F.lower("canonical_name").alias("title"))
    return closest_titles(names, titles)


def closest_titles(names: DataFrame, titles: DataFrame) -> DataFrame:
    """(key, ke_id) of names (key, name) in a registry (ke_id, title).

    Different names and titles meet once: what one holds of another is decided per pair of texts, of which there are
    few against rows; the registry is broadcast only as far as Spark finds it small.
    """
    texts, known = names.select("name").distinct(), titles.groupBy("title").agg(F.min("ke_id").alias("ke_id"))
    same = texts.join(known, texts["name"] == known["title"]).select("name", "ke_id")
    rest = texts.join(same.select("name"), "name", "left_anti")
    held = rest.join(known, F.contains("name", "title") | F.contains("title", "name"))
    best = held.groupBy("name").agg(F.min_by("ke_id", F.struct(F.abs(F.length("title") - F.length("name")), "ke_id")).alias("ke_id"))
    return names.join(same.unionByName(best), "name").select("key", "ke_id")


@query("enrich_ker", "claims", "part", sql="""WITH e AS (SELECT DISTINCT up_id, down_id FROM claims), r AS (SELECT p_partkey % 97 AS u, p_partkey % 101 AS d, min(p_partkey) AS ker_id, string_agg(DISTINCT 'Aop:' || p_size, '; ' ORDER BY 'Aop:' || p_size) AS aops FROM part GROUP BY 1, 2)
    SELECT up_id, down_id, ker_id, coalesce(aops, '') AS aops, CASE WHEN ker_id IS NULL THEN 'novel' ELSE 'existing' END AS status FROM e LEFT JOIN r ON u = up_id AND d = down_id""")
def enrich_ker(claims: DataFrame, part: DataFrame) -> DataFrame:
    """Edges with the registry's id, the pathways that have them, and whether they are known."""
    registry = part.groupBy((F.col("p_partkey") % 97).alias("up_id"), (F.col("p_partkey") % 101).alias("down_id")).agg(F.min("p_partkey").alias("ker_id"), F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("Aop:"), "p_size"))), "; ").alias("aops"))
    edges = claims.select("up_id", "down_id").distinct().join(registry, ["up_id", "down_id"], "left")
    return edges.select("up_id", "down_id", "ker_id", F.coalesce("aops", F.lit("")).alias("aops"), F.when(F.col("ker_id").isNull(), "novel").otherwise("existing").alias("status"))


@query("backfill_canonical_ids", "claims", "alias", sql="""WITH a AS (SELECT lower(trim('increased event ' || canonical_id % 97)) AS label, min(canonical_id) AS id FROM alias WHERE canonical_id % 3 > 0 GROUP BY 1) SELECT record_key, u.id AS up_canonical, d.id AS down_canonical FROM claims LEFT JOIN a u ON u.label = lower(trim(up_name)) LEFT JOIN a d ON d.label = lower(trim(down_name))""")
def backfill_canonical_ids(claims: DataFrame, alias: DataFrame) -> DataFrame:
    """Both ends of claims resolved by their labels, after the dimension of events was rebuilt; unknown labels have none."""
    known = alias.where("canonical_id % 3 > 0").groupBy(F.concat(F.lit("increased event "), F.col("canonical_id") % 97).alias("label")).agg(F.min("canonical_id").alias("id"))
    for end in ("up", "down"):
        own = known.select(F.col("label").alias(f"{end}_label"), F.col("id").alias(f"{end}_canonical"))
        claims = claims.withColumn(f"{end}_label", F.lower(F.trim(f"{end}_name"))).join(own, f"{end}_label", "left")
    return claims.select("record_key", "up_canonical", "down_canonical")


@query("event_roster", "canonical", "alias", "claims", sql="""WITH c AS (SELECT event, count(*) AS n_claims, count(DISTINCT doi) AS n_papers FROM (SELECT up_id AS event, doi FROM claims UNION ALL SELECT down_id, doi FROM claims) GROUP BY 1), a AS (SELECT canonical_id, count(*) AS n_labels, CAST(sum(n_uses) AS BIGINT) AS n_uses FROM alias GROUP BY 1)
    SELECT canonical_id, canonical_name, coalesce(n_labels, 0) AS n_labels, coalesce(n_uses, 0) AS n_uses, coalesce(n_claims, 0) AS n_claims, coalesce(n_papers, 0) AS n_papers FROM canonical LEFT JOIN a USING (canonical_id) LEFT JOIN c ON c.event = canonical_id""")
def event_roster(canonical: DataFrame, alias: DataFrame, claims: DataFrame) -> DataFrame:
    labels = alias.groupBy("canonical_id").agg(F.count("*").alias("n_labels"), F.sum("n_uses").alias("n_uses"))
    seen = claims.select(F.explode(F.array("up_id", "down_id")).alias("canonical_id"), "doi").groupBy("canonical_id").agg(F.count("*").alias("n_claims"), F.countDistinct("doi").alias("n_papers"))
    joined = canonical.join(labels, "canonical_id", "left").join(seen, "canonical_id", "left").fillna(0, ["n_labels", "n_uses", "n_claims", "n_papers"])
    return joined.select("canonical_id", "canonical_name", "n_labels", "n_uses", "n_claims", "n_papers")


@query("choose_name", "alias", "canonical", sql="""WITH g AS (SELECT canonical_id % 50 AS grp, raw_label, CAST(sum(n_uses) AS BIGINT) AS n FROM alias GROUP BY 1, 2), t AS (SELECT grp, sum(n) AS total, count(*) AS n_labels, max(n) AS top, arg_min(raw_label, (-n, -length(raw_label), raw_label)) AS label FROM g GROUP BY 1)
    SELECT grp, CASE WHEN grp % 5 = 0 AND n_labels > 2 AND top / total < 0.6 THEN 'term ' || grp ELSE label END AS name FROM t""")
def choose_name(alias: DataFrame, canonical: DataFrame) -> DataFrame:
    """The name of a group of labels: the most used, or the ontology's where that is sure and no label prevails."""
    counted = alias.groupBy((F.col("canonical_id") % 50).alias("grp"), "raw_label").agg(F.sum("n_uses").alias("n"))
    rank = F.struct(-F.col("n"), -F.length("raw_label"), "raw_label")
    groups = counted.groupBy("grp").agg(F.sum("n").alias("total"), F.count("*").alias("n_labels"), F.max("n").alias("top"), F.min_by("raw_label", rank).alias("label"))
    sure = (F.col("grp") % 5 == 0) & (F.col("n_labels") > 2) & (F.col("top") / F.col("total") < 0.6)
    return groups.select("grp", F.when(sure, F.concat(F.lit("term "), "grp")).otherwise(F.col("label")).alias("name"))


@query("er_rule_curie", "records", sql="""WITH c AS (SELECT key, upper(curie) AS curie, CASE WHEN label LIKE 'Increased%' THEN 1 WHEN label LIKE 'decrease%' THEN -1 ELSE 0 END AS p FROM records WHERE curie IS NOT NULL AND n_source_rows % 10 < 8), a AS (SELECT curie, min(key) AS anchor, arg_min(p, key) AS ap FROM c GROUP BY 1)
    SELECT key, anchor FROM c JOIN a USING (curie) WHERE key <> anchor AND p * ap >= 0""")
def er_rule_curie(records: DataFrame) -> DataFrame:
    """Records joined to the first one of the same ontology term, if both matched it surely and don't point opposite ways."""
    sign = F.when(F.col("label").startswith("Increased"), 1).when(F.col("label").startswith("decrease"), -1).otherwise(0)
    sure = records.where("curie IS NOT NULL AND n_source_rows % 10 < 8").select("key", F.upper("curie").alias("curie"), sign.alias("p"))
    anchors = sure.groupBy("curie").agg(F.min("key").alias("anchor"), F.min_by("p", "key").alias("ap"))
    return sure.join(anchors, "curie").where("key <> anchor AND p * ap >= 0").select("key", "anchor")


@query("ontology_rank", "records")
def ontology_rank(records: DataFrame) -> DataFrame:
    """Candidates for each label by likeness to it and a little for their own order; exact ones first, obsolete ones dropped."""
    from evigraph.functions.similarity import sequence_ratio

    docs = records.select("key", F.lower("label").alias("query"), F.posexplode(F.array(F.lower("label"), F.concat(F.lower("label"), F.lit(" process")), F.reverse(F.lower("label")))).alias("rank", "label")).where("(key + rank) % 7 <> 0")
    words = lambda c: F.array_distinct(F.split(F.col(c), " "))
    overlap = F.size(F.array_intersect(words("query"), words("label"))) / F.size(F.array_union(words("query"), words("label")))
    held = F.when(F.contains("label", "query") | F.contains("query", "label"), 1.0).otherwise(0.0)
    lexical = F.when(F.col("query") == F.col("label"), 1.0).otherwise(F.round(0.45 * sequence_ratio("query", "label") + 0.40 * overlap + 0.15 * held, 4))
    scored = docs.withColumns({"score": F.round(F.least(F.lit(1.0), lexical + 0.08 / (1 + F.col("rank"))), 4), "is_exact": F.col("query") == F.col("label")})
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("is_exact"), F.desc("score"), "rank"))).select("key", "label", "score", "is_exact", "place")


TERMS = "tree AS (SELECT p_partkey AS term, p_partkey // 3 AS parent FROM part WHERE p_partkey >= 3)"


@query("ontology_ancestors", "part", sql=f"WITH RECURSIVE {TERMS}, up(term, ancestor) AS (SELECT term, parent FROM tree UNION SELECT up.term, tree.parent FROM up JOIN tree ON tree.term = up.ancestor) SELECT term, ancestor FROM up")
def ontology_ancestors(part: DataFrame) -> DataFrame:
    """All ancestors of every term, by joins that double the distance in each round."""
    from evigraph.operators.graphs import stored

    known = stored(part.where("p_partkey >= 3").select(F.col("p_partkey").alias("term"), F.floor(F.col("p_partkey") / 3).alias("ancestor")))
    size = known.count()
    while True:
        further = known.join(known.toDF("ancestor", "beyond"), "ancestor").select("term", F.col("beyond").alias("ancestor"))
        known = stored(known.union(further).distinct())
        if known.count() == size:
            return known
        size = known.count()


@query("gene_cascade", "tokens", "part", sql="""WITH q AS (SELECT DISTINCT lower(trim(token)) AS query FROM tokens), g AS (SELECT lower(p_brand) AS a, lower(p_name) AS b, lower(split_part(p_name, ' ', 1)) AS c, p_partkey AS gene FROM part),
    s AS (SELECT a AS query, min(gene) AS gene, 1 AS k FROM g GROUP BY 1 UNION ALL SELECT b, min(gene), 2 FROM g GROUP BY 1 UNION ALL SELECT c, min(gene), 3 FROM g GROUP BY 1)
    SELECT query, arg_min(gene, k) AS gene, CASE min(k) WHEN 1 THEN 'symbol' WHEN 2 THEN 'alias' WHEN 3 THEN 'previous' END AS matched_by FROM q LEFT JOIN s USING (query) GROUP BY query""")
def gene_cascade(tokens: DataFrame, part: DataFrame) -> DataFrame:
    """The gene that a word names: by symbol, else by alias, else by an earlier symbol."""
    asked = tokens.select(F.lower(F.trim("token")).alias("query")).distinct()
    fields = (("symbol", F.lower("p_brand")), ("alias", F.lower("p_name")), ("previous", F.lower(F.split_part("p_name", F.lit(" "), F.lit(1)))))
    names = part.select("p_partkey", F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.lit(n).alias("matched_by"), c.alias("query")) for i, (n, c) in enumerate(fields)))).alias("f")).select("p_partkey", "f.*")
    best = names.groupBy("query").agg(F.min(F.struct("k", "p_partkey", "matched_by")).alias("b"))
    return asked.join(best, "query", "left").select("query", F.col("b.p_partkey").alias("gene"), F.col("b.matched_by").alias("matched_by"))


@query("xml_index", "pages")
def xml_index(pages: DataFrame) -> DataFrame:
    """Titles of elements in stored XML, by id: what a registry's dump is looked up by."""
    made = F.concat(F.lit('<ke id="'), "page_id", F.lit('"><title>'), F.regexp_replace("url", "[&<>]", " "), F.lit("</title></ke>"))
    return pages.select(F.xpath_string(made, F.lit("/ke/@id")).cast("bigint").alias("ke_id"), F.xpath_string(made, F.lit("/ke/title")).alias("title"))


@query("pubmed_xml_parse", "documents", sql="SELECT doc_id, CAST(doc_id AS VARCHAR) AS pmid, source AS title, CASE doc_id % 4 WHEN 0 THEN 2001 WHEN 1 THEN 1998 WHEN 2 THEN 2015 END AS year FROM documents")
def pubmed_xml_parse(docs: DataFrame) -> DataFrame:
    """Records out of a literature service's XML: the year of the first date that has one, or the digits that begin a free date."""
    k = F.col("doc_id") % 4
    date = F.when(k == 0, "<PubDate><Year>2001</Year></PubDate>").when(k == 1, "<PubDate><MedlineDate>1998 Nov-Dec</MedlineDate></PubDate>").when(k == 2, "<ArticleDate><Year>2015</Year></ArticleDate>").otherwise("<PubDate/>")
    xml = F.concat(F.lit("<a><PMID>"), "doc_id", F.lit("</PMID><ArticleTitle>"), "source", F.lit("</ArticleTitle>"), date, F.lit("</a>"))
    read = lambda path: F.nullif(F.xpath_string(xml, F.lit(path)), F.lit(""))
    year = F.coalesce(read("/a/PubDate/Year"), read("/a/ArticleDate/Year"), F.nullif(F.regexp_extract(F.coalesce(read("/a/PubDate/MedlineDate"), F.lit("")), r"^(\d{4})", 1), F.lit("")))
    return docs.select("doc_id", read("/a/PMID").alias("pmid"), read("/a/ArticleTitle").alias("title"), year.cast("int").alias("year"))


@query("order_independence", "claims")
def order_independence(claims: DataFrame) -> DataFrame:
    """(seed, digest) of the edges made of differently ordered claims: one digest if order doesn't count."""
    def digest(rows: DataFrame, seed: int) -> DataFrame:
        made = E.canonical_edges(rows, "upstream_name", "all_dois", "confidence_score")
        line = F.xxhash64(*(F.col(c) for c in ("ker_key", "n_papers_total", "direction", "evidence_type", "confidence_score", "upstream_name", "all_dois")))
        return made.agg(F.bit_xor(line).alias("digest"), F.count("*").alias("n_edges")).select(F.lit(seed).alias("seed"), "digest", "n_edges")

    return reduce(DataFrame.unionByName, (digest(claims.orderBy(F.rand(seed)), seed) for seed in (1, 2)))


@query("targeted_claim", "claims", sql="""SELECT record_key, CASE WHEN evidence_type = 'rescue' THEN 'Adjacent' WHEN evidence_type = 'perturbation' THEN 'Non-adjacent' ELSE adjacency END AS adjacency, evidence_type = 'correlation' OR contradicts AS contradicts,
    CASE WHEN up_change IN ('increased', 'decreased') AND d = 'no change' THEN 'none' WHEN up_change NOT IN ('increased', 'decreased') OR d NOT IN ('increased', 'decreased') THEN 'unclear' WHEN up_change = d THEN 'positive' ELSE 'negative' END AS direction
    FROM (SELECT *, CASE record_id % 3 WHEN 0 THEN 'increased' WHEN 1 THEN 'decreased' ELSE 'no change' END AS d FROM claims)""")
def targeted_claim(claims: DataFrame) -> DataFrame:
    """A claim about a relationship that was asked for: the gate's verdict overrides adjacency and contradiction, and how the two
    events moved gives the sign."""
    down = F.when(F.col("record_id") % 3 == 0, "increased").when(F.col("record_id") % 3 == 1, "decreased").otherwise("no change")
    kind = F.col("evidence_type")
    return claims.select(
        "record_key", F.when(kind == "rescue", "Adjacent").when(kind == "perturbation", "Non-adjacent").otherwise(F.col("adjacency")).alias("adjacency"), ((kind == "correlation") | F.col("contradicts")).alias("contradicts"),
        C.derive_coupling(F.col("up_change"), down).alias("direction"))


@query("assemble_claims", "claims", sql="SELECT record_key, max(CASE WHEN step = 'classify' THEN v END) AS level, max(CASE WHEN step = 'evidence' THEN v END) AS evidence, count(*) AS n_steps FROM (SELECT record_key, 'classify' AS step, up_level AS v FROM claims UNION ALL SELECT record_key, 'evidence', evidence_type FROM claims WHERE n_spans > 1) GROUP BY record_key")
def assemble_claims(claims: DataFrame) -> DataFrame:
    """Claims put together from the replies of several steps, which come as rows of their own; a step may be missing."""
    replies = claims.select("record_key", F.explode(F.array(F.struct(F.lit("classify").alias("step"), F.col("up_level").alias("v")), F.when(F.col("n_spans") > 1, F.struct(F.lit("evidence").alias("step"), F.col("evidence_type").alias("v"))))).alias("r")).where("r IS NOT NULL").select("record_key", "r.*")
    step = lambda name: F.max(F.when(F.col("step") == name, F.col("v")))
    return replies.groupBy("record_key").agg(step("classify").alias("level"), step("evidence").alias("evidence"), F.count("*").alias("n_steps"))


@query("canonical_anchor", "claims", sql="""SELECT record_key, CASE WHEN up_id IN (3, 11) AND NOT (up_id = 11 AND l = 'hepatocyte') THEN 'anchor ' || up_id ELSE 'increased event ' || up_id END AS event FROM (SELECT *, CASE WHEN cell_type LIKE 'Brand#1%' THEN 'hepatocyte' WHEN cell_type IS NULL THEN 'unspecified' ELSE 'neuron' END AS l FROM claims)""")
def canonical_anchor(claims: DataFrame) -> DataFrame:
    """Events of steps under the name of the anchor that they are, unless the cells that a step was seen in are of another lineage
    than the anchor's; the first anchor is of no lineage, the second of neurons."""
    cells = F.when(F.col("cell_type").startswith("Brand#1"), "hepatocyte").when(F.col("cell_type").isNull(), "unspecified").otherwise("neuron")
    steps = claims.select("record_key", F.lower(F.trim("up_name")).alias("event"), cells.alias("lineage"))
    anchors = {"increased event 3": ("anchor 3", None), "Increased  event-11": ("anchor 11", "neuron")}
    return steps.select("record_key", anchored(F.col("event"), F.col("lineage"), anchors).alias("event"))


def anchored(event: F.Column, lineage: F.Column, anchors: dict[str, tuple[str, str | None]]) -> F.Column:
    """The anchor's name for an event that is written like it, if the lineages don't contradict; silence contradicts nothing."""
    out = event
    for written, (name, own) in anchors.items():
        same = norm_event(event) == norm_event(F.lit(written))
        fits = F.lit(True) if own is None else (lineage == own) | (lineage == "unspecified")
        out = F.when(same & fits, name).otherwise(out)
    return out


def wrapped(label: F.Column, width: int = 22, lines: int = 3) -> F.Column:
    """A label in lines of a width for drawing, the last one marked where something is left out."""
    step = lambda acc, w: F.when(F.size(acc) == 0, F.array(w)).when(F.length(F.element_at(acc, -1)) + F.length(w) < width, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", F.element_at(acc, -1), w)))).otherwise(F.concat(acc, F.array(w)))
    made = F.aggregate(F.split(label, " "), F.array().cast("array<string>"), step)
    return F.when(F.size(made) <= lines, F.array_join(made, "\n")).otherwise(F.concat(F.array_join(F.slice(made, 1, lines), "\n"), F.lit("…")))


def shown(value: F.Column, dash: str = "—") -> F.Column:
    """A value for display: a dash for nothing, with bars and line ends that would break a table escaped."""
    text = F.regexp_replace(F.regexp_replace(value.cast("string"), r"\|", r"\\|"), r"\s*\n\s*", " ")
    return F.when(C.is_missing(value.cast("string")), dash).otherwise(text)


def tooltip(edges: DataFrame) -> DataFrame:
    """(ker_key, text): what is told of an edge (ker_key, ker_name, direction, confidence_score, n_papers_supporting, n_papers_contradicting) beside its arrow."""
    contra = F.when(F.col("n_papers_contradicting") > 0, F.concat(F.lit("contradicted by "), "n_papers_contradicting"))
    return edges.select("ker_key", F.concat_ws("\n", "ker_name", F.concat(F.lit("direction: "), "direction"), F.concat(F.lit("papers: "), "n_papers_supporting"), contra, F.concat(F.lit("confidence: "), "confidence_score")).alias("text"))
