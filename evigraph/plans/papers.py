"""Queries over papers, passages and replies: sections, identifiers, vocabulary, chunks, quotations, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions import salvage, text as T
from evigraph.operators import documents as D
from evigraph.plans.registry import query
from evigraph.plans.text_sql import plain_sql

LINES = "lines AS (SELECT doc_id, i - 1 AS pos, trim(l[i]) AS line, l[i] AS whole FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM papers))"
_KINDS = " ".join(f"WHEN regexp_matches(line, '(?i){T.HEADING_PREFIX}{p}') THEN '{k}'" for k, p in T.HEADINGS)
KIND_SQL = f"""CASE WHEN line = '' OR length(line) > 90 OR (regexp_matches(line, '[,;:]$') AND length(line) > 40) THEN NULL {_KINDS} WHEN regexp_matches(line, '{T.NUMBERED_HEADING}') THEN 'other'
    WHEN length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) BETWEEN 3 AND 60 AND upper(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) = regexp_replace(line, '[^\\p{{L}}]', '', 'g') AND lower(line) <> line THEN 'other' END"""


@query("classify_heading", "papers", sql=f"WITH {LINES} SELECT doc_id, pos, line AS heading, {KIND_SQL} AS kind FROM lines WHERE ({KIND_SQL}) IS NOT NULL")
def classify_heading(papers: DataFrame) -> DataFrame:
    read = D.lines(papers, "doc_id").select("doc_id", "pos", F.trim("line").alias("heading"), T.heading_kind(F.col("line")).alias("kind"))
    return read.where("kind IS NOT NULL")


_TAIL = T.DOI_TAIL.replace("'", "''")


@query("find_doi", "papers", sql=f"""SELECT doc_id, nullif(lower(regexp_replace(coalesce(nullif(regexp_extract(text, '(?i)(?:https?://(?:dx\\.)?doi\\.org/|doi\\s*[:=]\\s*)({T.DOI})', 1), ''), regexp_extract(text, '(?i)\\b({T.DOI})', 1)), '{_TAIL}', '')), '') AS doi FROM papers""")
def find_doi(papers: DataFrame) -> DataFrame:
    return papers.select("doc_id", T.find_doi(F.col("text")).alias("doi"))


@query("doi_detect", "papers", sql="SELECT doc_id, '10.' || (1000 + doc_id % 9000) || '/ab.' || doc_id AS doi, 'first lines' AS found_in FROM papers")
def doi_detect(papers: DataFrame) -> DataFrame:
    """The DOI of a paper: from its source's name, then its first lines, then its last ones; where it was found."""
    parts = F.split("text", "\n")
    places = {"metadata": F.col("source"), "first lines": F.array_join(F.slice(parts, 1, 40), "\n"), "last lines": F.array_join(F.slice(F.reverse(parts), 1, 40), "\n")}
    found = papers.select("doc_id", *(T.find_doi(F.coalesce(text, F.lit(""))).alias(name) for name, text in places.items()))
    where = F.lit(None).cast("string")
    for name in reversed(list(places)):
        where = F.when(F.col(name).isNotNull(), name).otherwise(where)
    return found.select("doc_id", F.coalesce(*places).alias("doi"), where.alias("found_in"))


@query("norm_doi", "claims", sql="SELECT record_key, CASE WHEN doi IS NULL THEN '' ELSE rtrim(lower(doi), '.') END AS doi FROM claims")
def norm_doi(claims: DataFrame) -> DataFrame:
    k = F.col("record_id") % 4
    dressed = F.when(k == 0, F.concat(F.lit(" https://doi.org/"), "doi", F.lit(". "))).when(k == 1, F.concat(F.lit("DOI: "), "doi")).when(k == 2, F.concat(F.lit("http://dx.doi.org/"), "doi", F.lit(".."))).otherwise(F.coalesce("doi", F.lit(" NaN ")))
    return claims.select("record_key", T.norm_doi(dressed).alias("doi"))


@query("strip_references", "papers", sql=rf"""WITH {LINES}, c AS (SELECT doc_id, min(pos) AS cut FROM lines WHERE regexp_matches(whole, '{T.REFERENCE_HEADER}') OR (pos > 10 AND (regexp_matches(whole, '{T.CITATION_LINE}') OR regexp_matches(whole, '{T.URL_LINE}'))) GROUP BY doc_id),
    k AS (SELECT doc_id, string_agg(whole, chr(10) ORDER BY pos) AS body FROM lines JOIN c USING (doc_id) WHERE pos < cut GROUP BY doc_id)
    SELECT doc_id, md5(CASE WHEN cut IS NULL THEN text ELSE regexp_replace(coalesce(body, ''), '^\s+|\s+$', '', 'g') END) AS digest FROM papers LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)""")
def strip_references(papers: DataFrame) -> DataFrame:
    return papers.select("doc_id", F.md5(T.without_references(F.col("text"))).alias("digest"))


def _hits_sql(terms: tuple[tuple[str, float], ...]) -> str:
    each = (f"CASE WHEN len(regexp_extract_all(text, '(?i){p}')) > 0 THEN {w}::DOUBLE * (1 + ln(len(regexp_extract_all(text, '(?i){p}'))) / ln(4)) ELSE 0 END" for p, w in terms)
    return " + ".join(each)


@query("weighted_hits", "passages", sql=f"SELECT passage_id, round({_hits_sql(T.CAUSAL)}, 6) AS causal, round({_hits_sql(T.BIOLOGY)}, 6) AS biology, round({_hits_sql(T.QUANTITY)}, 6) AS quantity FROM passages")
def weighted_hits(passages: DataFrame) -> DataFrame:
    return passages.select("passage_id", *(F.round(T.weighted_hits(F.col("text"), terms), 6).alias(n) for n, terms in (("causal", T.CAUSAL), ("biology", T.BIOLOGY), ("quantity", T.QUANTITY))))


_PRIOR = "CASE section_kind " + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in T.SECTION_PRIOR.items()) + " ELSE 1 END"


@query("chunk_density", "passages", sql=f"""SELECT passage_id, round((2.0::DOUBLE * ({_hits_sql(T.CAUSAL)}) + 1.5::DOUBLE * ({_hits_sql(T.BIOLOGY)}) + ({_hits_sql(T.QUANTITY)})) / greatest(0.5::DOUBLE, length(text) / 1000) * {_PRIOR}
    * CASE WHEN regexp_matches(text, '(?m)^\\s*\\[TABLE\\]') OR regexp_matches(text, '(?i)supplementary\\s+(table|figure|material)') THEN 0.7::DOUBLE ELSE 1 END
    * (0.15::DOUBLE + 1.85::DOUBLE * (least((CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])oxidative stresss?([^a-z0-9]|$)') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])ross?([^a-z0-9]|$)') THEN 1 ELSE 0 END) / 2, 1)
        + least((CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])dose[- ]dependents?([^a-z0-9]|$)') THEN 1 ELSE 0 END) / 2, 1)) / 2), 6) AS density FROM passages""")
def chunk_density(passages: DataFrame) -> DataFrame:
    sides = [F.array(F.lit("oxidative stress"), F.lit("ROS")), F.array(F.lit("dose-dependent"))]
    return passages.select("passage_id", F.round(T.density(F.col("text"), F.col("section_kind"), sides), 6).alias("density"))


@query("term_match", "passages", sql="SELECT passage_id, regexp_matches(lower(text), '(^|[^a-z0-9])brand#12s?([^a-z0-9]|$)') AS has_brand, regexp_matches(lower(text), '(^|[^a-z0-9])dose[- ]dependents?([^a-z0-9]|$)') AS has_dose, regexp_matches(lower(text), '(^|[^a-z0-9])3[- ]folds?([^a-z0-9]|$)') AS has_fold FROM passages")
def term_match(passages: DataFrame) -> DataFrame:
    asked = {"has_brand": "Brand#12", "has_dose": "dose-dependent", "has_fold": "3-fold"}
    return passages.select("passage_id", *(T.matches_term(F.lower("text"), F.lit(t)).alias(n) for n, t in asked.items()))


_STOP = ", ".join(f"'{w}'" for w in T.TARGET_STOPWORDS)


@query("target_terms", "alias", sql=f"SELECT canonical_id, raw_label, list_sort(list_transform(list_distinct(list_filter(regexp_split_to_array(lower(raw_label), '[^a-z0-9]+'), lambda w: length(w) > 3 AND w NOT IN ({_STOP}))), lambda w: (-length(w), w))).list_transform(lambda s: s[2]) AS terms FROM alias")
def target_terms(alias: DataFrame) -> DataFrame:
    return alias.select("canonical_id", "raw_label", T.target_terms(F.col("raw_label")).alias("terms"))


@query("reduction_pct", "passages", sql="SELECT section_kind, round(100 * (1 - sum(CASE WHEN length(text) > 150 THEN length(text) ELSE 0 END) / sum(length(text))), 3) AS reduction_pct FROM passages GROUP BY section_kind")
def reduction_pct(passages: DataFrame) -> DataFrame:
    size = F.length("text")
    return passages.groupBy("section_kind").agg(F.round(100 * (1 - F.sum(F.when(size > 150, size).otherwise(0)) / F.sum(size)), 3).alias("reduction_pct"))


SAID = """said AS (SELECT passage_id, section_kind, CASE WHEN passage_id LIKE '%1' THEN '"However, notably: ' || text || '" ' WHEN passage_id LIKE '%2' THEN '[c001 | section: x] ' || text ELSE '  ' || replace(text, '. ', '.  ') END AS quote FROM passages)"""


def said(passages: DataFrame) -> DataFrame:
    """Passages as they are quoted, with marks, headers and lead-ins."""
    ends = F.col("passage_id")
    quote = F.when(ends.endswith("1"), F.concat(F.lit('"However, notably: '), "text", F.lit('" '))).when(ends.endswith("2"), F.concat(F.lit("[c001 | section: x] "), "text")).otherwise(F.concat(F.lit("  "), F.replace("text", F.lit(". "), F.lit(".  "))))
    return passages.select("passage_id", "section_kind", quote.alias("quote"))


CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(trim(quote), '^["“”‘’]+|["“”‘’]+$', '', 'g'), '^\s*\[[^\]]{0,60}\]\s*', ''), '\s+', ' ', 'g'))"""
PRINT = rf"""substr(trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(trim(quote), '{T.LEAD_INS}', ''), '{T.LEAD_INS}', '')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), 1, 160)"""


@query("clean_quote", "passages", sql=f"WITH {SAID} SELECT passage_id, {CLEAN} AS quote FROM said")
def clean_quote(passages: DataFrame) -> DataFrame:
    return said(passages).select("passage_id", T.clean_quote(F.col("quote")).alias("quote"))


@query("quote_fingerprint", "passages", sql=f"WITH {SAID}, c AS (SELECT passage_id, {CLEAN} AS quote FROM said) SELECT passage_id, {PRINT} AS fingerprint FROM c")
def quote_fingerprint(passages: DataFrame) -> DataFrame:
    return said(passages).select("passage_id", T.quote_fingerprint(T.clean_quote(F.col("quote"))).alias("fingerprint"))


@query("span_dedup", "passages", sql=f"""WITH {SAID}, c AS (SELECT passage_id, section_kind AS field, {CLEAN} AS quote, passage_id LIKE '%3' AS verified FROM said), p AS (SELECT *, {PRINT} AS k FROM c)
    SELECT k AS fingerprint, arg_min(passage_id, (NOT verified, passage_id)) AS kept, bool_or(verified) AS verified, count(*) AS n_copies, array_to_string(list_sort(list_distinct(list(field))), ', ') AS fields FROM p GROUP BY k""")
def span_dedup(passages: DataFrame) -> DataFrame:
    """Quotations once each: a verified copy is kept if there is one, and the fields of all copies."""
    spans = said(passages).select("passage_id", F.col("section_kind").alias("field"), T.clean_quote(F.col("quote")).alias("quote"), F.col("passage_id").endswith("3").alias("verified"))
    keyed = spans.withColumn("fingerprint", T.quote_fingerprint(F.col("quote")))
    # Fields are a closed vocabulary, so their set is bounded.
    return keyed.groupBy("fingerprint").agg(
        F.min_by("passage_id", F.struct(~F.col("verified"), "passage_id")).alias("kept"), F.bool_or("verified").alias("verified"), F.count("*").alias("n_copies"), F.array_join(F.array_sort(F.collect_set("field")), ", ").alias("fields"))


@query("page_label", "claims", sql="SELECT record_key, CASE WHEN n_verified = n_spans THEN 'p. ' || n_verified ELSE 'pp. ' || n_verified || '–' || n_spans END AS label FROM claims")
def page_label(claims: DataFrame) -> DataFrame:
    return claims.select("record_key", T.page_label(F.col("n_verified"), F.col("n_spans")).alias("label"))


@query("format_table", "part", sql="SELECT p_brand, string_agg(p_name || ' | ' || p_size || ' | ' || CASE WHEN p_size % 7 = 0 THEN '' ELSE p_type END, chr(10) ORDER BY p_partkey) AS table_text FROM part GROUP BY p_brand")
def format_table(part: DataFrame) -> DataFrame:
    """Tables as text: cells parted by bars, a row a line; empty cells stay."""
    cells = F.array(F.col("p_name"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 7 != 0, F.col("p_type")))
    row = F.array_join(F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit("")))), " | ")
    rows = F.sort_array(F.collect_list(F.struct("p_partkey", row.alias("r"))))
    return part.groupBy("p_brand").agg(F.array_join(F.transform(rows, lambda s: s["r"]), "\n").alias("table_text"))


@query("chunk_build", "papers")
def chunk_build(papers: DataFrame) -> DataFrame:
    return D.build_chunks(papers, "doc_id").select("doc_id", "chunk", "section", "section_kind", "char_start", "n_chars", F.md5("text").alias("digest"))


@query("chunk_select", "papers")
def chunk_select(papers: DataFrame) -> DataFrame:
    scored = D.score_chunks(D.build_chunks(papers, "doc_id", target=900, least=100), "doc_id")
    return D.select_chunks(scored, "doc_id", budget=3000, min_score=0.0, most=6).select("doc_id", "chunk", "section_kind", "n_chars", "score", "selected")


@query("chunk_concat", "papers")
def chunk_concat(papers: DataFrame) -> DataFrame:
    scored = D.score_chunks(D.build_chunks(papers, "doc_id", target=900, least=100), "doc_id")
    return D.chunk_text(D.select_chunks(scored, "doc_id", budget=3000, min_score=0.0), "doc_id").select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query("document_struct", "papers")
def document_struct(papers: DataFrame) -> DataFrame:
    """Papers as one nested row each: title, DOI, and their chunks."""
    chunks = D.build_chunks(papers, "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "section", "section_kind", "char_start", "n_chars"))).alias("chunks"))
    title = F.get(F.filter(F.transform(F.slice(F.split("text", "\n"), 1, 12), lambda x: F.trim(x)), lambda x: F.length(x).between(20, 250) & ~x.rlike(f"(?i){T.DOI}") & ~F.lower(x).rlike("^(doi|http|www|received|accepted)")), 0)
    return papers.select("doc_id", title.alias("title"), T.find_doi(F.col("text")).alias("doi"), F.length("text").alias("n_chars")).join(chunks, "doc_id", "left")


ASKED = "asked AS (SELECT item_id AS quote_id, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN upper(substr(text, 1, 90)) ELSE replace(substr(text, 10, 60), ' ', '') END AS quote FROM benchmark)"


def asked(benchmark: DataFrame) -> DataFrame:
    """Quotations as they are asked for: whole, in part and in capitals, or without their blanks."""
    k, text = F.col("item_id") % 3, F.col("text")
    return benchmark.select(F.col("item_id").alias("quote_id"), F.when(k == 0, text).when(k == 1, F.upper(F.substring(text, 1, 90))).otherwise(F.replace(F.substring(text, 10, 60), F.lit(" "), F.lit(""))).alias("quote"))


LOCATED = f"""q AS (SELECT quote_id, {plain_sql('quote')} AS needle FROM asked), d AS (SELECT doc_id, {plain_sql("coalesce(text, '')")} AS hay FROM documents),
    x AS (SELECT quote_id, doc_id FROM q JOIN d ON contains(hay, needle) WHERE length(needle) >= 15),
    y AS (SELECT quote_id, doc_id FROM q JOIN d ON contains(replace(hay, ' ', ''), replace(needle, ' ', '')) WHERE length(replace(needle, ' ', '')) >= 15 AND quote_id NOT IN (SELECT quote_id FROM x))"""


@query("locate_quote", "documents", "benchmark", sql=f"WITH {ASKED}, {LOCATED} SELECT quote_id, doc_id, 1.0::DOUBLE AS ratio FROM x UNION ALL SELECT quote_id, doc_id, 0.99::DOUBLE FROM y")
def locate_quote(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return D.locate_quotes(docs, asked(benchmark))


@query("locate_in_chunks", "papers")
def locate_in_chunks(papers: DataFrame) -> DataFrame:
    """Sentences of papers, some garbled, looked up in the papers' own chunks."""
    chunks = D.build_chunks(papers, "doc_id", target=900, least=100).select("doc_id", F.col("chunk").alias("chunk_id"), "text")
    k = F.col("doc_id") % 3
    part = F.substring("text", 120, 80)
    quotes = papers.select(F.col("doc_id").alias("quote_id"), "doc_id", F.when(k == 0, part).when(k == 1, F.replace(part, F.lit("e"), F.lit("o"))).otherwise(F.concat(part, F.lit(" and more that no text has, not at all, never"))).alias("quote"))
    return D.locate_in_chunks(chunks, quotes)


@query("locate_fuzzy", "papers")
def locate_fuzzy(papers: DataFrame) -> DataFrame:
    """Those of the sentences that only fit in part."""
    return locate_in_chunks(papers).where("NOT verified AND chunk_id IS NOT NULL")


@query("evidence_spans", "papers")
def evidence_spans(papers: DataFrame) -> DataFrame:
    """Up to three different quotations of 25 characters or more for each paper, with the chunk that each stands in."""
    chunks = D.build_chunks(papers, "doc_id", target=900, least=100).select("doc_id", F.col("chunk").alias("chunk_id"), "text")
    raw = papers.select("doc_id", F.posexplode(F.array(F.substring("text", 100, 60), F.concat(F.lit("However, "), F.substring("text", 100, 60)), F.substring("text", 300, 70), F.lit("too short"), F.substring("text", 400, 50))).alias("place", "quote"))
    tidy = raw.withColumn("quote", T.clean_quote(F.col("quote"))).where(F.length("quote") >= 25)
    first = tidy.withColumn("print", T.quote_fingerprint(F.col("quote"))).groupBy("doc_id", "print").agg(F.min(F.struct("place", "quote")).alias("q"))
    kept = first.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_list("q")), 1, 3).alias("q")).select("doc_id", F.explode("q").alias("q"))  # five at most
    quotes = kept.select(F.concat_ws("-", "doc_id", "q.place").alias("quote_id"), "doc_id", F.col("q.quote").alias("quote"))
    return quotes.join(D.locate_in_chunks(chunks, quotes), "quote_id").select("quote_id", "doc_id", "quote", "chunk_id", "ratio", "verified")


@query("span_location", "documents", sql="""WITH l AS (SELECT doc_id, i AS chunk, l[i] AS line, coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x) + 1)), 0) AS char_start FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
    s AS (SELECT doc_id, k, length(text) * k // 4 AS a, least(length(text) * k // 4 + 90, length(text)) AS b FROM documents, range(4) r(k)),
    c AS (SELECT s.doc_id, k, max(chunk) AS chunk FROM s JOIN l ON l.doc_id = s.doc_id AND l.char_start <= a GROUP BY ALL)
    SELECT s.doc_id || '-' || s.k AS span_id, c.chunk, 'line ' || c.chunk AS section, CAST(a // 1800 + 1 AS BIGINT) AS page_start, CAST(greatest(a, b - 1) // 1800 + 1 AS BIGINT) AS page_end FROM s JOIN c ON c.doc_id = s.doc_id AND c.k = s.k""")
def span_location(docs: DataFrame) -> DataFrame:
    """Four spans of every document by line and page, a page having 1,800 characters."""
    size = F.length("text")
    spans = docs.select("doc_id", size.alias("size"), F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    start = F.floor(F.col("size") * F.col("k") / 4).cast("bigint")
    spans = spans.select(F.concat_ws("-", "doc_id", "k").alias("span_id"), "doc_id", start.alias("char_start"), F.least(start + 90, "size").alias("char_end"))
    chunks = D.lines(docs, "doc_id").select("doc_id", (F.col("pos") + 1).cast("bigint").alias("chunk"), F.concat(F.lit("line "), F.col("pos") + 1).alias("section"), "char_start", (F.col("char_start") + F.length("line") + 1).alias("char_end"))
    pages = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(1800))).alias("char_start"))
    pages = pages.select("doc_id", F.col("char_start").cast("bigint").alias("char_start"), (F.floor(F.col("char_start") / 1800) + 1).alias("page"))
    return D.span_location(spans, chunks, pages)


@query("json_repair", "replies")
def json_repair(replies: DataFrame) -> DataFrame:
    return replies.select("event_id", salvage.salvaged(F.col("reply")).alias("s")).select("event_id", "s.*")


@query("coerce_quotes", "events", sql="SELECT event_id, CASE event_id % 4 WHEN 0 THEN ['one'] WHEN 1 THEN ['a', 'b' || event_id] WHEN 2 THEN ['x', 'y'] ELSE [] END AS quotes FROM events")
def coerce_quotes(events: DataFrame) -> DataFrame:
    k = F.col("event_id") % 4
    shape = F.when(k == 0, F.lit('"one"')).when(k == 1, F.concat(F.lit('{"quotes": ["a", {"text": "b'), "event_id", F.lit('"}, 7]}'))).when(k == 2, F.lit('[{"quote": "x"}, "y", {"other": 1}]')).otherwise(F.lit('{"none": []}'))
    return events.select("event_id", salvage.quotations(shape).alias("quotes"))
