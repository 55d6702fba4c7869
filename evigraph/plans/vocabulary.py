"""Queries over names: cells and their lineages, genes, organs, ontology terms, citations, coerced values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph import schemas as S
from evigraph.functions import claims as C
from evigraph.functions import text as T
from evigraph.functions import vocabulary as V
from evigraph.operators.edges import Text, ranked_items
from evigraph.plans.registry import query


def _case(column: str, cases: tuple, rest: str = "NULL") -> str:
    """SQL for the value of the first (pattern, value) found in a column."""
    return "CASE " + " ".join(f"WHEN regexp_matches(coalesce({column}, ''), '(?i){p}') THEN '{v}'" for p, v in cases) + f" ELSE {rest} END"


LINEAGE = f"CASE WHEN trim(coalesce(cell_type, '')) = '' THEN 'unspecified' ELSE {_case('cell_type', tuple((p, n) for n, p in V.CELL_PATTERNS), repr(V.UNRESOLVED))} END"
_SUFFIX = "CASE lineage " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.SUFFIXES.items()) + " ELSE 'in ' || lineage END"


@query("lineage", "cells", sql=f"WITH l AS (SELECT row_id, {LINEAGE} AS lineage FROM cells) SELECT row_id, lineage, {_SUFFIX} AS suffix FROM l")
def lineage(cells: DataFrame) -> DataFrame:
    found = cells.select("row_id", V.lineage(F.col("cell_type")).alias("lineage"))
    return found.withColumn("suffix", V.suffix_for(F.col("lineage")))


@query("distinct_lineages", "cells", sql=f"SELECT event, list_sort(list_distinct(list({LINEAGE}) FILTER (({LINEAGE}) NOT IN ('unspecified', 'unresolved')))) AS lineages FROM cells GROUP BY event HAVING count(*) FILTER (({LINEAGE}) NOT IN ('unspecified', 'unresolved')) > 0")
def distinct_lineages(cells: DataFrame) -> DataFrame:
    placed = cells.select("event", V.lineage(F.col("cell_type")).alias("l")).where(~F.col("l").isin(V.UNSPECIFIED, V.UNRESOLVED))
    return placed.groupBy("event").agg(F.array_sort(F.collect_set("l")).alias("lineages"))  # a closed vocabulary


@query("unresolved_cells", "cells", sql=f"SELECT DISTINCT trim(cell_type) AS cell_type FROM cells WHERE {LINEAGE} = 'unresolved'")
def unresolved_cells(cells: DataFrame) -> DataFrame:
    return cells.where(V.lineage(F.col("cell_type")) == V.UNRESOLVED).select(F.trim("cell_type").alias("cell_type")).distinct()


@query("lineage_conflicts", "cells", sql=f"""WITH l AS (SELECT DISTINCT event, {LINEAGE} AS lineage, trim(cell_type) AS cell FROM cells WHERE {LINEAGE} NOT IN ('unspecified', 'unresolved')), e AS (SELECT event, lineage, list_sort(list(cell))[1:3] AS examples, count(DISTINCT lineage) OVER (PARTITION BY event) AS n FROM l GROUP BY event, lineage)
    SELECT event, lineage, examples FROM e QUALIFY count(*) OVER (PARTITION BY event) >= 2""")
def lineage_conflicts(cells: DataFrame) -> DataFrame:
    """Events seen in two lineages or more, with up to three examples of cells of each."""
    placed = cells.select("event", V.lineage(F.col("cell_type")).alias("lineage"), F.trim("cell_type").alias("cell")).where(~F.col("lineage").isin(V.UNSPECIFIED, V.UNRESOLVED)).distinct()
    first = placed.withColumn("k", F.row_number().over(Window.partitionBy("event", "lineage").orderBy("cell"))).where("k <= 3")
    each = first.groupBy("event", "lineage").agg(F.sort_array(F.collect_list("cell")).alias("examples"))
    return each.withColumn("n", F.count("*").over(Window.partitionBy("event"))).where("n >= 2").drop("n")


@query("lineage_policy", "cells", sql="SELECT row_id, CASE p WHEN 0 THEN 'hepatocyte' WHEN 1 THEN 'macrophage' WHEN 2 THEN 'neuronal / axonal' WHEN 3 THEN 'epithelial' END AS lineage FROM (SELECT row_id, row_id % 5 AS p FROM cells)")
def lineage_policy(cells: DataFrame) -> DataFrame:
    """The lineage that the ancestors of a resolved cell decide: the policy's order counts, not that of the ancestors."""
    above = F.when(F.col("row_id") % 5 == 0, F.array(F.lit("epithelial cell"), F.lit("Hepatocyte"))).when(F.col("row_id") % 5 == 1, F.array(F.lit("leukocyte"), F.lit("macrophage"))).when(F.col("row_id") % 5 == 2, F.array(F.lit("neuron")))
    return cells.select("row_id", V.lineage_by_policy(F.coalesce(above.when(F.col("row_id") % 5 == 3, F.array(F.lit(" epithelial cell "))), F.array(F.lit("cell")))).alias("lineage"))


_ONE = "arg_min({0}, (-k, length({0}) * -1, {0}))"


@query("propose_names", "cells", sql=f"""WITH l AS (SELECT event, label, lower(trim(target)) AS target, lower(change) AS change, {LINEAGE} AS lineage FROM cells),
    u AS (SELECT event, min(label) AS label, count(DISTINCT target) AS nt, min(target) AS target, count(DISTINCT change) AS nc, min(change) AS change, count(DISTINCT lineage) FILTER (lineage NOT IN ('unspecified', 'unresolved')) AS nl, min(lineage) FILTER (lineage NOT IN ('unspecified', 'unresolved')) AS lineage FROM l GROUP BY event)
    SELECT event, label, concat_ws(' ', CASE WHEN nc = 1 THEN change END, target, CASE WHEN nl = 1 THEN {_SUFFIX} END) AS proposed FROM u WHERE nt = 1""")
def propose_names(cells: DataFrame) -> DataFrame:
    """A more specific name for each event whose claims agree on the target; change and lineage are named where all agree on them too."""
    read = cells.select("event", "label", F.lower(F.trim("target")).alias("target"), F.lower("change").alias("change"), V.lineage(F.col("cell_type")).alias("l"))
    read = read.withColumn("l", F.when(~F.col("l").isin(V.UNSPECIFIED, V.UNRESOLVED), F.col("l")))
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    agreed = read.groupBy("event").agg(F.min("label").alias("label"), one("target"), one("change"), one("l")).where("target IS NOT NULL")
    return agreed.select("event", "label", F.concat_ws(" ", "change", "target", F.when(F.col("l").isNotNull(), V.suffix_for(F.col("l")))).alias("proposed"))


@query("lineage_split", "cells", sql=f"""WITH l AS (SELECT row_id, event, {LINEAGE} AS lineage FROM cells), s AS (SELECT event FROM l WHERE lineage NOT IN ('unspecified', 'unresolved') GROUP BY event HAVING count(DISTINCT lineage) >= 2)
    SELECT row_id, CASE WHEN s.event IS NOT NULL AND lineage NOT IN ('unspecified', 'unresolved') THEN 'increased event ' || l.event || ' ' || {_SUFFIX} ELSE 'increased event ' || l.event END AS name FROM l LEFT JOIN s ON s.event = l.event""")
def lineage_split(cells: DataFrame) -> DataFrame:
    """Rows of events with two lineages or more go to an event of their lineage; rows that state none stay."""
    read = cells.select("row_id", "event", "label", V.lineage(F.col("cell_type")).alias("lineage"))
    placed = read.where(~F.col("lineage").isin(V.UNSPECIFIED, V.UNRESOLVED))
    split = placed.groupBy("event").agg(F.countDistinct("lineage").alias("n")).where("n >= 2").select("event", F.lit(True).alias("split"))
    moves = F.coalesce("split", F.lit(False)) & ~F.col("lineage").isin(V.UNSPECIFIED, V.UNRESOLVED)
    return read.join(split, "event", "left").select("row_id", F.when(moves, F.concat_ws(" ", "label", V.suffix_for(F.col("lineage")))).otherwise(F.col("label")).alias("name"))


_NOT = ", ".join(f"'{w}'" for w in V.NOT_SYMBOLS)


@query("gene_symbol_filter", "tokens", sql=f"""SELECT token_id, length(t) BETWEEN 2 AND 15 AND lower(t) NOT IN ({_NOT}) AND regexp_matches(t, '{V.SYMBOL}') AND (regexp_matches(t, '[0-9]') OR length(regexp_replace(t, '[^A-Z]', '', 'g')) >= greatest(2, length(t) - 2)) AS is_symbol FROM (SELECT token_id, trim(token) AS t FROM tokens)""")
def gene_symbol_filter(tokens: DataFrame) -> DataFrame:
    return tokens.select("token_id", V.is_gene_symbol(F.col("token")).alias("is_symbol"))


@query("strong_match", "tokens", sql="SELECT token_id, coalesce(matched_by = 'symbol', false) OR regexp_matches(token, '[0-9]') OR length(trim(token)) >= 4 AS strong FROM tokens")
def strong_match(tokens: DataFrame) -> DataFrame:
    return tokens.select("token_id", V.is_strong_match(F.col("token"), F.col("matched_by")).alias("strong"))


_STEM = "CASE " + " ".join(f"WHEN w LIKE '%{e}' AND length(w) >= {V.LEAST_STEM + len(e)} THEN w[:-{len(e) + 1}]" for e in V.ENDINGS) + " ELSE w END"


@query("stem", "tokens", sql=f"SELECT token_id, w AS word, {_STEM} AS stem FROM (SELECT token_id, lower(trim(token)) AS w FROM tokens)")
def stem(tokens: DataFrame) -> DataFrame:
    word = F.lower(F.trim("token"))
    return tokens.select("token_id", word.alias("word"), V.stem(word).alias("stem"))


@query("sanitise_query", "tokens", sql=r"""SELECT token_id, trim(regexp_replace(regexp_replace(phrase, '[+\-!(){}\[\]^"~*?:\\/&|]', ' ', 'g'), '\s+', ' ', 'g')) AS query, trim(regexp_replace(regexp_replace(regexp_replace(phrase, '\([^)]*\)|\[[^\]]*\]', ' ', 'g'), '[+\-!(){}\[\]^"~*?:\\/&|]', ' ', 'g'), '\s+', ' ', 'g')) AS shorter FROM tokens""")
def sanitise_query(tokens: DataFrame) -> DataFrame:
    return tokens.select("token_id", V.sanitise_query(F.col("phrase")).alias("query"), V.without_asides(F.col("phrase")).alias("shorter"))


@query("term_union", "part", sql="SELECT p_brand, list_transform(list_sort(list(DISTINCT (-length(p_type), p_type)) ), lambda s: s[2]) AS terms FROM part GROUP BY p_brand")
def term_union(part: DataFrame) -> DataFrame:
    """The terms of a brand, the longest first, spellings of any case once."""
    both = F.array_union(F.array_sort(F.collect_set("p_type")), F.array_sort(F.collect_set(F.concat(F.lit(" "), F.upper("p_type")))))  # p_type is a closed vocabulary
    return part.groupBy("p_brand").agg(V.by_length(both).alias("t")).select("p_brand", F.transform(F.sort_array(F.transform("t", lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"]).alias("terms"))


@query("parse_terms", "tokens", sql="SELECT token_id, [trim(token), 'b b', 'C'] AS terms FROM tokens WHERE lower(trim(token)) NOT IN ('b b', 'c')")
def parse_terms(tokens: DataFrame) -> DataFrame:
    text = F.concat(F.lit(" "), "token", F.lit(",b   b;\n, C\nB b;c"))
    return tokens.where(~F.lower(F.trim("token")).isin("b b", "c")).select("token_id", V.parse_terms(text).alias("terms"))


@query("vocabulary_union", "tokens", sql="SELECT term, min(source) AS source, count(*) AS n FROM (SELECT lower(trim(token)) AS term, '1 label' AS source FROM tokens UNION ALL SELECT lower(trim(token)) || 's', '2 plural' FROM tokens UNION ALL SELECT lower(matched_by), '3 gene' FROM tokens WHERE matched_by IS NOT NULL) GROUP BY term")
def vocabulary_union(tokens: DataFrame) -> DataFrame:
    """Terms of several sources, each once, with the first source that gave it."""
    word = F.lower(F.trim("token"))
    given = tokens.select(F.explode(F.array(F.struct(word.alias("term"), F.lit("1 label").alias("source")), F.struct(F.concat(word, F.lit("s")).alias("term"), F.lit("2 plural").alias("source")), F.struct(F.lower("matched_by").alias("term"), F.lit("3 gene").alias("source")))).alias("g")).select("g.*")
    return given.where("term IS NOT NULL").groupBy("term").agg(F.min("source").alias("source"), F.count("*").alias("n"))


@query("anatomy_hint", "alias", sql=f"SELECT canonical_id, raw_label, {_case('x', V.ANATOMY)} AS organ FROM (SELECT canonical_id, raw_label, raw_label || CASE canonical_id % 5 WHEN 0 THEN ' hepatic' WHEN 1 THEN ' of the renal cortex' WHEN 2 THEN ' in bone' ELSE '' END AS x FROM alias)")
def anatomy_hint(alias: DataFrame) -> DataFrame:
    k = F.col("canonical_id") % 5
    text = F.concat("raw_label", F.when(k == 0, " hepatic").when(k == 1, " of the renal cortex").when(k == 2, " in bone").otherwise(""))
    return alias.select("canonical_id", "raw_label", V.anatomy_hint(text).alias("organ"))


CURIES = "curies AS (SELECT canonical_id, canonical_name, level, CASE canonical_id % 6 WHEN 0 THEN 'UBERON:' || canonical_id WHEN 1 THEN 'cl:' || canonical_id WHEN 2 THEN curie WHEN 3 THEN 'nothing' WHEN 4 THEN ':5' END AS curie FROM canonical)"


def curies(canonical: DataFrame) -> DataFrame:
    k = F.col("canonical_id") % 6
    own = F.when(k == 0, F.concat(F.lit("UBERON:"), "canonical_id")).when(k == 1, F.concat(F.lit("cl:"), "canonical_id")).when(k == 2, F.col("curie")).when(k == 3, "nothing").when(k == 4, ":5")
    return canonical.select("canonical_id", "canonical_name", "level", own.alias("curie"))


@query("anatomy_curie", "canonical", sql=f"WITH {CURIES} SELECT canonical_id, coalesce(lower(split_part(curie, ':', 1)) IN ('uberon', 'cl', 'ma', 'emapa', 'fma'), false) AS is_anatomy FROM curies")
def anatomy_curie(canonical: DataFrame) -> DataFrame:
    return curies(canonical).select("canonical_id", V.is_anatomy(F.col("curie")).alias("is_anatomy"))


@query("curie_iri", "canonical", sql=f"WITH {CURIES} SELECT canonical_id, CASE WHEN contains(curie, ':') AND split_part(curie, ':', 1) <> '' AND split_part(curie, ':', 2) <> '' THEN 'http://purl.obolibrary.org/obo/' || upper(split_part(curie, ':', 1)) || '_' || split_part(curie, ':', 2) END AS iri FROM curies")
def curie_iri(canonical: DataFrame) -> DataFrame:
    return curies(canonical).select("canonical_id", V.iri_for(F.col("curie")).alias("iri"))


# Maps, the ontologies that each accepts, and the addresses of its pages.
PROVIDERS = (
    ("bgee", ("uberon",), "https://www.bgee.org/search/anatomical-homology?ids={curie}"), ("cl", ("cl",), "https://www.ebi.ac.uk/ols4/ontologies/cl/classes/{iri}"),
    ("ontobee", ("uberon", "cl"), "https://ontobee.org/ontology/UBERON?iri={iri}"), ("uberon", ("uberon",), "https://www.ebi.ac.uk/ols4/ontologies/uberon/classes/{iri}"))


def provider_table(spark, providers=PROVIDERS) -> DataFrame:  # noqa: ANN001
    """Providers as a table; it takes any list of (key, accepted ontologies, template), so providers are added and removed by rows."""
    return spark.createDataFrame([(k, list(a), t) for k, a, t in providers], "provider string, accepts array<string>, template string")


def links(events: DataFrame, providers: DataFrame, levels: tuple[str, ...] = ("Tissue", "Organ")) -> DataFrame:
    """(canonical_id, provider, curie, url): pages of the maps that show the anatomy of events (canonical_id, canonical_name, level, curie)."""
    ontology = F.lower(F.substring_index("curie", ":", 1))
    placed = events.where(F.col("level").isin(*levels) & V.is_anatomy(F.col("curie"))).withColumn("iri", V.iri_for(F.col("curie"))).where("iri IS NOT NULL")
    met = placed.join(F.broadcast(providers), F.array_contains("accepts", ontology))  # a few providers, a row each
    return met.select("canonical_id", "provider", "curie", V.build_url(F.col("template"), F.col("curie"), F.col("iri"), F.col("canonical_name")).alias("url"))


_ENC = "replace(replace('http://purl.obolibrary.org/obo/' || upper(split_part(curie, ':', 1)) || '_' || split_part(curie, ':', 2), ':', '%3A'), '/', '%2F')"
LINKS = f"""links AS (SELECT canonical_id, provider, curie, CASE provider WHEN 'bgee' THEN 'https://www.bgee.org/search/anatomical-homology?ids=' || replace(curie, ':', '%3A') WHEN 'cl' THEN 'https://www.ebi.ac.uk/ols4/ontologies/cl/classes/' || {_ENC}
    WHEN 'ontobee' THEN 'https://ontobee.org/ontology/UBERON?iri=' || {_ENC} ELSE 'https://www.ebi.ac.uk/ols4/ontologies/uberon/classes/' || {_ENC} END AS url
    FROM curies, (VALUES ('bgee', 'uberon'), ('cl', 'cl'), ('ontobee', 'uberon'), ('ontobee', 'cl'), ('uberon', 'uberon')) p(provider, o) WHERE level IN ('Tissue', 'Organ') AND lower(split_part(curie, ':', 1)) = o)"""


@query("provider_links", "canonical", sql=f"WITH {CURIES}, {LINKS} SELECT * FROM links")
def provider_links(canonical: DataFrame) -> DataFrame:
    return links(curies(canonical), provider_table(canonical.sparkSession))


@query("build_url", "canonical", sql=f"WITH {CURIES}, {LINKS} SELECT canonical_id, url FROM links WHERE provider = 'bgee'")
def build_url(canonical: DataFrame) -> DataFrame:
    return provider_links(canonical).where("provider = 'bgee'").select("canonical_id", "url")


@query("links_by_event", "canonical", sql=f"WITH {CURIES}, {LINKS} SELECT canonical_id, list(provider ORDER BY provider) AS providers, count(*) AS n FROM links GROUP BY canonical_id")
def links_by_event(canonical: DataFrame) -> DataFrame:
    return provider_links(canonical).groupBy("canonical_id").agg(F.sort_array(F.collect_list("provider")).alias("providers"), F.count("*").alias("n"))  # one row per provider


@query("anatomy_coverage", "canonical", sql=f"WITH {CURIES}, {LINKS} SELECT (SELECT count(*) FROM canonical WHERE level IN ('Tissue', 'Organ')) AS n_eligible, (SELECT count(DISTINCT canonical_id) FROM links) AS n_linked")
def anatomy_coverage(canonical: DataFrame) -> DataFrame:
    linked = provider_links(canonical).select("canonical_id").distinct().withColumn("linked", F.lit(1))
    return canonical.where("level IN ('Tissue', 'Organ')").join(linked, "canonical_id", "left").agg(F.count("*").alias("n_eligible"), F.count("linked").alias("n_linked"))


@query("coerce_enum", "cells", sql="SELECT row_id, CASE lower(trim(change)) WHEN 'increased' THEN 'Increased' WHEN 'decreased' THEN 'unclear' END AS value FROM cells")
def coerce_enum(cells: DataFrame) -> DataFrame:
    return cells.select("row_id", V.coerce_enum(F.concat(F.lit(" "), F.upper("change")), ("Increased", "None"), "unclear").alias("value"))


@query("coerce_bool", "events", sql="SELECT event_id, event_id % 6 IN (0, 1, 2) AS value FROM events")
def coerce_bool(events: DataFrame) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, (" TRUE", "1", "Yes ", "false", "y", "0"))), (F.col("event_id") % 6 + 1).cast("int"))
    return events.select("event_id", V.coerce_bool(said).alias("value"))


# Tokens that a step of extraction may write, and the least of any.
BUDGETS = {"pathway": 16000, "list_ker_pairs": 5000, "classify": 2500, "evidence": 5000, "applicability": 2500, "quantitative": 4000, "study_meta": 1200}
OTHER_BUDGET, LEAST_BUDGET, LEAST_SCALE = 1024, 256, 0.1


def step_budget_of(step: F.Column, scale: F.Column) -> F.Column:
    base = F.lit(OTHER_BUDGET)
    for name, n in BUDGETS.items():
        base = F.when(step == name, n).otherwise(base)
    return F.greatest(F.lit(LEAST_BUDGET), F.bround(base * F.greatest(F.lit(LEAST_SCALE), scale)).cast("int"))


@query("step_budget", "events", sql="SELECT event_id, greatest(256, CAST(round_even(CASE event_id % 4 WHEN 0 THEN 16000 WHEN 1 THEN 2500 WHEN 2 THEN 1200 ELSE 1024 END * greatest(0.1::DOUBLE, (event_id % 7) / 4.0::DOUBLE), 0) AS INT)) AS budget FROM events")
def step_budget(events: DataFrame) -> DataFrame:
    step = F.element_at(F.array(*map(F.lit, ("pathway", "classify", "study_meta", "other"))), (F.col("event_id") % 4 + 1).cast("int"))
    return events.select("event_id", step_budget_of(step, F.col("event_id") % 7 / 4.0).alias("budget"))


@query("norm_event", "tokens", sql="SELECT token_id, trim(regexp_replace(lower(phrase), '[^a-z0-9]+', ' ', 'g')) AS event FROM tokens")
def norm_event(tokens: DataFrame) -> DataFrame:
    return tokens.select("token_id", V.norm_event(F.col("phrase")).alias("event"))


@query("anchored_step", "claims", sql="SELECT record_key, up_id = 3 AND down_id % 10 = 4 AS anchored FROM claims")
def anchored_step(claims: DataFrame) -> DataFrame:
    """Whether a step runs between two given events, however they are written."""
    same = lambda c, name: V.norm_event(F.col(c)) == V.norm_event(F.lit(name))
    ends = same("up_name", "INCREASED  event-3") & (V.norm_event(F.col("down_name")).endswith("4"))
    return claims.select("record_key", ends.alias("anchored"))


@query("build_query", "events", sql="""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE '(' || event_type || ') AND ("' || CASE WHEN event_id % 3 = 1 THEN 2000 + event_id % 20 ELSE 1000 END || '"[Date - Publication] : "' || CASE WHEN event_id % 3 = 2 THEN 2010 + event_id % 9 ELSE 3000 END || '"[Date - Publication])' END AS query FROM events""")
def build_query(events: DataFrame) -> DataFrame:
    """A search with a range of years; an open end gets the first or last year that there is (fixed values 1000 and 3000)."""
    k = F.col("event_id") % 3
    first, last = F.when(k == 1, 2000 + F.col("event_id") % 20), F.when(k == 2, 2010 + F.col("event_id") % 9)
    dated = F.concat(F.lit("("), "event_type", F.lit(') AND ("'), F.coalesce(first, F.lit(1000)).cast("string"), F.lit('"[Date - Publication] : "'), F.coalesce(last, F.lit(3000)).cast("string"), F.lit('"[Date - Publication])'))
    return events.select("event_id", F.when(first.isNull() & last.isNull(), F.col("event_type")).otherwise(dated).alias("query"))


DATE_FIELDS = ("issued", "published-print", "published-online", "published", "created")


@query("citation_year", "citations", sql="SELECT doi, CASE WHEN CAST(split_part(doi, '/', 2) AS INT) % 3 = 0 THEN 1990 ELSE 2000 END + CAST(split_part(doi, '/', 2) AS INT) % 5 AS year FROM citations")
def citation_year(citations: DataFrame) -> DataFrame:
    """The year of the first date that a citation's record has."""
    each = (F.get_json_object("message", f"$['{f}']['date-parts'][0][0]").try_cast("int") for f in DATE_FIELDS)
    return citations.select("doi", F.coalesce(*each).alias("year"))


def letters(number: F.Column) -> F.Column:
    """1 to a, 26 to z, 27 to aa and so on."""
    digit = lambda n: F.char(F.lit(97) + F.pmod(n - 1, F.lit(26)))
    higher = lambda n: F.floor((n - 1) / 26)
    out, rest = digit(number), higher(number)
    for _ in range(4):  # half a million papers of one key
        out = F.concat(F.when(rest > 0, digit(rest)).otherwise(F.lit("")), out)
        rest = F.when(rest > 0, higher(rest)).otherwise(F.lit(0))
    return out


_BASE = "CASE WHEN NOT resolved OR year IS NULL THEN doi WHEN n_authors >= 3 THEN first_author || ' et al., ' || year WHEN n_authors = 2 THEN first_author || ' & ' || second_author || ', ' || year ELSE first_author || ', ' || year END"


@query("citation_keys", "citations", sql=f"""WITH b AS (SELECT doi, {_BASE} AS base FROM citations), r AS (SELECT doi, base, row_number() OVER (PARTITION BY base ORDER BY doi) AS k, count(*) OVER (PARTITION BY base) AS n FROM b)
    SELECT doi, base || CASE WHEN n = 1 THEN '' WHEN k <= 26 THEN chr(CAST(96 + k AS INT)) ELSE chr(CAST(96 + (k - 1) // 26 AS INT)) || chr(CAST(97 + (k - 1) % 26 AS INT)) END AS key FROM r""")
def citation_keys(citations: DataFrame) -> DataFrame:
    """How papers are cited: authors and year, with letters in the order of DOIs where several would be cited alike."""
    unknown = ~F.col("resolved") | F.col("first_author").isNull() | F.col("year").isNull()
    year = F.concat(F.lit(", "), F.col("year").cast("string"))
    base = F.when(unknown, F.col("doi")).when(F.col("n_authors") >= 3, F.concat("first_author", F.lit(" et al."), year)).when((F.col("n_authors") == 2) & F.col("second_author").isNotNull(), F.concat("first_author", F.lit(" & "), "second_author", year)).otherwise(F.concat("first_author", year))
    numbered = citations.select("doi", base.alias("base")).withColumns({"k": F.row_number().over(Window.partitionBy("base").orderBy("doi")), "n": F.count("*").over(Window.partitionBy("base"))})
    return numbered.select("doi", F.concat("base", F.when(F.col("n") > 1, letters(F.col("k"))).otherwise("")).alias("key"))


@query("cache_misses", "claims", "citations", sql="SELECT DISTINCT lower(trim(doi)) AS doi FROM claims WHERE doi IS NOT NULL AND lower(trim(doi)) NOT IN (SELECT doi FROM citations WHERE resolved OR n_authors = 1)")
def cache_misses(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """DOIs that no earlier look-up answered, failures counting as answers."""
    asked = claims.select(T.norm_doi(F.col("doi")).alias("doi")).where("doi <> ''").distinct()
    return asked.join(citations.where("resolved OR n_authors = 1").select("doi"), "doi", "left_anti")


@query("resolved_change", "cells", sql="SELECT event, mark, ruling, CASE ruling WHEN 'increased' THEN '↑' WHEN 'decreased' THEN '↓' ELSE mark END AS shown FROM (SELECT event, CASE WHEN bool_or(lower(change) = 'increased') AND bool_or(change = 'decreased') THEN '±' WHEN bool_or(change = 'decreased') THEN '↓' ELSE '↑' END AS mark, CASE event % 4 WHEN 0 THEN 'increased' WHEN 1 THEN 'conflicted' WHEN 2 THEN 'decreased' END AS ruling FROM cells GROUP BY event)")
def resolved_change(cells: DataFrame) -> DataFrame:
    """The arrow of each event after a curator's ruling; that papers do conflict is a ruling, too, and changes nothing."""
    observed = marks(cells)
    k = F.col("event") % 4
    ruling = F.when(k == 0, "increased").when(k == 1, "conflicted").when(k == 2, "decreased")
    ruled = observed.withColumn("ruling", ruling)
    return ruled.select("event", "mark", "ruling", F.when(F.col("ruling") == "increased", "↑").when(F.col("ruling") == "decreased", "↓").otherwise(F.col("mark")).alias("shown"))


def marks(rows: DataFrame) -> DataFrame:
    """(event, label, mark): the arrow that all changes of an event agree on, or that they conflict."""
    sign = C.sign_of(F.col("change"))
    found = rows.groupBy("event").agg(F.min("label").alias("label"), F.bool_or(sign == "↑").alias("u"), F.bool_or(sign == "↓").alias("d"))
    return found.select("event", "label", F.when(F.col("u") & F.col("d"), "±").when(F.col("u"), "↑").when(F.col("d"), "↓").otherwise("").alias("mark"))


@query("flagged_events", "cells", sql="""WITH m AS (SELECT event, min(label) AS label, CASE WHEN bool_or(lower(change) = 'increased') AND bool_or(change = 'decreased') THEN '±' WHEN bool_or(change = 'decreased') THEN '↓' ELSE '↑' END AS derived FROM cells GROUP BY event)
    SELECT event, label, CASE WHEN derived = '±' THEN '±' ELSE '⚠' END AS mark, CASE event % 4 WHEN 0 THEN 'increased' WHEN 1 THEN 'conflicted' WHEN 2 THEN 'decreased' ELSE '' END AS ruled FROM m WHERE derived IN ('±', '↓')""")
def flagged_events(cells: DataFrame) -> DataFrame:
    """Events whose claims conflict, or whose name says the opposite of them; those without a ruling first."""
    from evigraph.functions import labels as L

    derived = resolved_change(cells).join(marks(cells).select("event", "label"), "event")
    stated, seen = L.polarity(F.col("label")), F.when(F.col("mark") == "↑", 1).when(F.col("mark") == "↓", -1).otherwise(0)
    flag = F.when(F.col("mark") == "±", "±").when(stated * seen < 0, "⚠")
    flagged = derived.select("event", "label", flag.alias("mark"), F.coalesce("ruling", F.lit("")).alias("ruled")).where("mark IS NOT NULL")
    return flagged.orderBy(F.col("ruled") != "", "label")


_ALLOWED = {"up_level": (S.LEVELS, "Molecular"), "adjacency": (S.ADJACENCY, "Adjacent"), "sex": (S.SEXES, "Not specified"), "study_design": (S.STUDY_DESIGNS, "In vivo"), "confidence": (S.CONFIDENCES, "Low"), "direction": (S.DIRECTIONS, "unclear"), "relation_kind": (S.RELATION_KINDS, "causal"), "evidence_type": (S.EVIDENCE_TYPES, "not_stated")}


@query("assemble_defaults", "claims", sql="""SELECT record_key, trim(up_name) AS up_name, coalesce(ker_name, trim(up_name) || ' leads to ' || trim(down_name)) AS ker_name, coalesce(ker_description, 'Relationship between ' || trim(up_name) || ' and ' || trim(down_name) || '.') AS ker_description, up_level,
    adjacency, coalesce(sex, 'Not specified') AS sex, study_design, confidence, direction, relation_kind, evidence_type, essentiality, contradicts FROM claims""")
def assemble_defaults(claims: DataFrame) -> DataFrame:
    """Claims out of the replies of several steps: closed values coerced, blanks dropped, defaults where a step said nothing."""
    replied = claims.withColumns({c: F.upper(c) for c in _ALLOWED} | {"contradicts": F.when(F.col("contradicts"), "Yes").otherwise("no"), "essentiality": F.coalesce("essentiality", F.lit(" None "))})
    up, down = F.trim("up_name"), F.trim("down_name")
    told = lambda c: F.when(~F.lower(F.trim(c)).isin("null", "none", ""), F.trim(c))
    return replied.select(
        "record_key", up.alias("up_name"), F.coalesce("ker_name", F.concat(up, F.lit(" leads to "), down)).alias("ker_name"), F.coalesce("ker_description", F.concat(F.lit("Relationship between "), up, F.lit(" and "), down, F.lit("."))).alias("ker_description"),
        *(V.coerce_enum(F.col(c), values, rest).alias(c) for c, (values, rest) in _ALLOWED.items()), told("essentiality").alias("essentiality"), V.coerce_bool(F.col("contradicts")).alias("contradicts"))


@query("gate_verdict", "claims", sql="""SELECT record_key, CASE WHEN v IN ('direct', 'indirect') AND n_verified = 0 THEN 'none' ELSE v END AS verdict, CASE WHEN v IN ('direct', 'indirect') AND n_verified = 0 THEN v END AS downgraded_from,
    coalesce(v = 'contradicts' AND up_change IN ('increased', 'decreased') AND up_change = d, false) AS check_by_hand FROM (SELECT *, CASE evidence_type WHEN 'rescue' THEN 'direct' WHEN 'perturbation' THEN 'indirect' WHEN 'correlation' THEN 'contradicts' ELSE 'none' END AS v, CASE record_id % 2 WHEN 0 THEN 'increased' ELSE 'decreased' END AS d FROM claims)""")
def gate_verdict(claims: DataFrame) -> DataFrame:
    """Whether a paper speaks of a relationship: a verdict without a located quotation counts as none, and a
    contradiction of two events that move together is to be checked by hand."""
    said = F.when(F.col("evidence_type") == "rescue", "direct").when(F.col("evidence_type") == "perturbation", "indirect").when(F.col("evidence_type") == "correlation", "contradicts").otherwise("none")
    down = F.when(F.col("record_id") % 2 == 0, "increased").otherwise("decreased")
    bare = said.isin("direct", "indirect") & (F.col("n_verified") == 0)
    moved = F.col("up_change").isin("increased", "decreased") & (F.col("up_change") == down)
    return claims.select("record_key", F.when(bare, "none").otherwise(said).alias("verdict"), F.when(bare, said).alias("downgraded_from"), F.coalesce((said == "contradicts") & moved, F.lit(False)).alias("check_by_hand"))


@query("classify_drift", "claims", sql="""WITH l AS (SELECT up_id, list(DISTINCT stressor ORDER BY stressor) AS a FROM claims GROUP BY up_id), d AS (SELECT up_id, a, CASE up_id % 3 WHEN 0 THEN list_reverse(a) WHEN 1 THEN a[1:3] ELSE list_concat(a[1:2], ['new']) END AS b FROM l)
    SELECT up_id, CASE WHEN list_sort(a) = list_sort(b) THEN 'REORDERED' WHEN len(list_intersect(a, b)) = least(len(a), len(b)) THEN 'TRUNCATED' ELSE 'REPLACED' END AS drift FROM d""")
def classify_drift(claims: DataFrame) -> DataFrame:
    """How two versions of a list differ: in order, in length, or in what they list."""
    ranked = ranked_items(claims, ["up_id"], {"s": Text(("stressor",), None, False)}).groupBy("up_id").agg(F.array_sort(F.collect_list("item")).alias("a"))
    k = F.col("up_id") % 3
    both = ranked.withColumn("b", F.when(k == 0, F.reverse("a")).when(k == 1, F.slice("a", 1, 3)).otherwise(F.concat(F.slice("a", 1, 2), F.array(F.lit("new")))))
    return both.select("up_id", drift_of(F.col("a"), F.col("b")).alias("drift"))


def drift_of(a: F.Column, b: F.Column) -> F.Column:
    held = F.size(F.array_intersect(a, b)) == F.least(F.size(a), F.size(b))
    return F.when(F.array_sort(a) == F.array_sort(b), "REORDERED").when(held, "TRUNCATED").otherwise("REPLACED")


# Parts of a licence's address, the category and the name of the licence; the first that fits counts.
LICENCES = (
    ("creativecommons.org/publicdomain/zero", "OPEN", "CC0"), ("creativecommons.org/publicdomain/mark", "OPEN", "Public domain"), ("creativecommons.org/licenses/by-nc-nd", "OPEN-CONDITIONS", "CC BY-NC-ND"),
    ("creativecommons.org/licenses/by-nc-sa", "OPEN-CONDITIONS", "CC BY-NC-SA"), ("creativecommons.org/licenses/by-nd", "OPEN-CONDITIONS", "CC BY-ND"), ("creativecommons.org/licenses/by-nc", "OPEN-CONDITIONS", "CC BY-NC"),
    ("creativecommons.org/licenses/by-sa", "OPEN-CONDITIONS", "CC BY-SA"), ("creativecommons.org/licenses/by", "OPEN", "CC BY"))
_URL = "CASE page_id % 9 WHEN 0 THEN 'https://CreativeCommons.org/licenses/by/4.0/' WHEN 1 THEN 'http://creativecommons.org/licenses/by-nc/3.0' WHEN 2 THEN 'https://creativecommons.org/licenses/by-nc-nd/4.0' WHEN 3 THEN 'https://creativecommons.org/publicdomain/zero/1.0' WHEN 4 THEN url WHEN 5 THEN 'https://creativecommons.org/licenses/by-sa/4.0' WHEN 6 THEN NULL WHEN 7 THEN 'https://creativecommons.org/licenses/by-nc-sa/4.0' ELSE 'https://creativecommons.org/licenses/by-nd/2.0' END"


@query("licence_class", "pages", sql=f"SELECT page_id, CASE {' '.join(f'WHEN contains(u, {chr(39)}{p}{chr(39)}) THEN {chr(39)}{c}{chr(39)}' for p, c, _ in LICENCES)} END AS category, CASE {' '.join(f'WHEN contains(u, {chr(39)}{p}{chr(39)}) THEN {chr(39)}{n}{chr(39)}' for p, _, n in LICENCES)} END AS licence FROM (SELECT page_id, lower({_URL}) AS u FROM pages)")
def licence_class(pages: DataFrame) -> DataFrame:
    """The category and name of the licence that an address is of; both null for addresses of no known licence."""
    url = F.lower(F.expr(_URL))
    pick = lambda at: V._first(F.coalesce(url, F.lit("")), tuple((p.replace(".", r"\."), row[at]) for row in LICENCES for p in row[:1]), "")
    return pages.select("page_id", pick(1).alias("category"), pick(2).alias("licence"))


@query("screening_policy", "documents", "labels", sql="""WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'maybe' ELSE 'maybe' END AS said, CASE WHEN doc_id % 3 = 0 THEN 'rule ' || doc_id % 5 END AS inc, CASE WHEN doc_id % 2 = 0 THEN 'rule x' END AS exc FROM documents)
    SELECT doc_id, CASE WHEN inc IS NOT NULL AND exc IS NOT NULL THEN 'no' ELSE said END AS decision, inc IS NOT NULL AND exc IS NOT NULL AS conflict, CASE WHEN inc IS NOT NULL AND exc IS NOT NULL THEN 'exclusion_wins' END AS policy FROM r""")
def screening_policy(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return screened(docs).select("doc_id", "decision", "conflict", "policy")


# Decisions that there are, and what a policy decides where rules for and against both apply.
DECISIONS, POLICIES = ("yes", "no", "maybe"), {"exclusion_wins": "no", "inclusion_wins": "yes", "flag_maybe": "maybe"}


def screened(docs: DataFrame, policy: str = "exclusion_wins") -> DataFrame:
    """Screening decisions out of replies: unknown ones are maybe, and a conflict of rules is decided by the policy and nothing else."""
    said = F.element_at(F.array(*map(F.lit, (" YES ", "No", "maybe", "who knows"))), (F.col("doc_id") % 4 + 1).cast("int"))
    inc, exc = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("rule "), F.col("doc_id") % 5)), F.when(F.col("doc_id") % 2 == 0, "rule x")
    read = docs.withColumns({"said": V.coerce_enum(said, DECISIONS, "maybe"), "inclusion": inc, "exclusion": exc})
    clash = F.col("inclusion").isNotNull() & F.col("exclusion").isNotNull()
    return read.withColumns({"conflict": clash, "decision": F.when(clash, POLICIES[policy]).otherwise(F.col("said")), "policy": F.when(clash, policy)})


EXPORT = ("query", "inclusion_criteria", "exclusion_criteria", "screening_decision", "rationale", "evidence_quote", "triggered_inclusion_rule", "triggered_exclusion_rule", "criteria_conflict", "conflict_policy", "PMID", "DOI", "first_author", "year", "journal", "title", "abstract")


@query("screening_export", "documents", sql="""WITH r AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'maybe' END AS said, CASE WHEN doc_id % 3 = 0 THEN 'rule ' || doc_id % 5 END AS inc, CASE WHEN doc_id % 2 = 0 THEN 'rule x' END AS exc FROM documents)
    SELECT 'q' AS query, '' AS inclusion_criteria, 'none of x' AS exclusion_criteria, CASE WHEN inc IS NOT NULL AND exc IS NOT NULL THEN 'no' ELSE said END AS screening_decision, lang || ' text' AS rationale, '' AS evidence_quote, coalesce(inc, '') AS triggered_inclusion_rule, coalesce(exc, '') AS triggered_exclusion_rule,
        inc IS NOT NULL AND exc IS NOT NULL AS criteria_conflict, CASE WHEN inc IS NOT NULL AND exc IS NOT NULL THEN 'exclusion_wins' ELSE '' END AS conflict_policy, CAST(doc_id AS VARCHAR) AS PMID, CASE WHEN doc_id % 5 = 0 THEN '' ELSE '10.9/' || doc_id END AS DOI, '' AS first_author, CAST(2000 + doc_id % 20 AS VARCHAR) AS year,
        source AS journal, substr(text, 1, 40) AS title, md5(text) AS abstract FROM r""")
def screening_export(docs: DataFrame) -> DataFrame:
    """Records and decisions as one flat table of fixed columns, in which nothing is null; abstracts are digested here."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    made = {
        "query": F.lit("q"), "inclusion_criteria": F.lit(""), "exclusion_criteria": F.lit("none of x"), "screening_decision": F.col("decision"), "rationale": F.concat("lang", F.lit(" text")), "evidence_quote": F.lit(""), "triggered_inclusion_rule": blank(F.col("inclusion")),
        "triggered_exclusion_rule": blank(F.col("exclusion")), "criteria_conflict": F.col("conflict"), "conflict_policy": blank(F.col("policy")), "PMID": F.col("doc_id").cast("string"), "DOI": blank(F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("10.9/"), "doc_id"))), "first_author": F.lit(""),
        "year": (2000 + F.col("doc_id") % 20).cast("string"), "journal": F.col("source"), "title": F.substring("text", 1, 40), "abstract": F.md5("text")}
    return screened(docs).select(*(made[c].alias(c) for c in EXPORT))
