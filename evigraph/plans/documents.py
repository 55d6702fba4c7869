"""Queries over document text: chunks, offsets, quotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.functions.salvage import salvaged
from evigraph.operators.documents import locate_quotes
from evigraph.plans.registry import query
from evigraph.plans.text_sql import plain_sql

LINES = "lines AS (SELECT doc_id, i - 1 AS pos, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"


def lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query("page_offsets", "documents", sql=f"WITH {LINES} SELECT doc_id, pos, coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM lines")
def page_offsets(docs: DataFrame) -> DataFrame:
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return lines(docs).select("doc_id", "pos", F.coalesce(F.sum(F.length("line") + 2).over(before), F.lit(0)).cast("bigint").alias("char_start"))


@query("chunk_search", "documents", sql=f"WITH {LINES} SELECT doc_id, pos FROM lines WHERE contains(lower(line), 'token =')")
def chunk_search(docs: DataFrame) -> DataFrame:
    return lines(docs.where(F.lower("text").contains("token ="))).where(F.lower("line").contains("token =")).select("doc_id", "pos")


@query("chunk_coverage", "documents", sql=f"WITH {LINES} SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(line)) AS BIGINT) AS n_chars, count(*) FILTER (length(line) > 200) AS n_selected FROM lines GROUP BY doc_id")
def chunk_coverage(docs: DataFrame) -> DataFrame:
    return lines(docs).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("line")).alias("n_chars"), F.count(F.when(F.length("line") > 200, 1)).alias("n_selected"))


@query("chunks_dedup", "documents", sql=f"WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id DESC, pos DESC) AS k FROM lines) SELECT doc_id, pos, line FROM r WHERE k = 1")
def chunks_dedup(docs: DataFrame) -> DataFrame:
    last = lines(docs).groupBy("line").agg(F.max(F.struct("doc_id", "pos")).alias("at"))
    return last.select("at.*", "line")


@query("match_normalise", "documents", sql=f"SELECT doc_id, md5({plain_sql('text')}) AS digest FROM documents")
def match_normalise(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.md5(T.plain(F.col("text"))).alias("digest"))


@query("strip_control", "documents", sql=r"SELECT doc_id, md5(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) AS digest FROM documents")
def strip_control(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.md5(F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")).alias("digest"))


@query("truncate_budget", "documents", sql="SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE substr(text, 1, 800) || ' [...] ' || right(text, 200) END AS text FROM documents")
def truncate_budget(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.when(F.length("text") <= 1000, F.col("text")).otherwise(F.concat(F.substring("text", 1, 800), F.lit(" [...] "), F.right("text", F.lit(200)))).alias("text"))


@query("locate_exact", "documents", "benchmark", sql=f"WITH q AS (SELECT item_id, {plain_sql('text')} AS needle FROM benchmark), d AS (SELECT doc_id, {plain_sql('text')} AS hay FROM documents) SELECT doc_id, item_id, 1.0::DOUBLE AS ratio FROM d JOIN q ON contains(hay, needle) WHERE length(needle) >= 15")
def locate_exact(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """Quotations that stand in a document word for word."""
    return locate_quotes(docs, quotes.select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))).where("ratio = 1").select("doc_id", F.col("quote_id").alias("item_id"), "ratio")


@query("guess_title", "documents", sql=f"WITH {LINES} SELECT doc_id, arg_min(trim(line), pos) AS title FROM lines WHERE pos < 12 AND length(trim(line)) BETWEEN 20 AND 250 AND NOT regexp_matches(line, '10\\.[0-9]{{4,9}}/') AND NOT regexp_matches(lower(trim(line)), '^(doi|http|www|received|accepted)') GROUP BY doc_id")
def guess_title(docs: DataFrame) -> DataFrame:
    unlike = lambda x: ~x.rlike(T.DOI) & ~F.lower(F.trim(x)).rlike("^(doi|http|www|received|accepted)")
    fits = F.filter(F.slice(F.split("text", "\n"), 1, 12), lambda x: F.length(F.trim(x)).between(20, 250) & unlike(x))
    return docs.select("doc_id", F.trim(F.get(fits, 0)).alias("title")).where("title IS NOT NULL")


@query("chunk_peak_norm", "documents", sql=f"WITH {LINES} SELECT doc_id, pos, round(length(line) / nullif(max(length(line)) OVER (PARTITION BY doc_id), 0), 6) AS score FROM lines")
def chunk_peak_norm(docs: DataFrame) -> DataFrame:
    peak = F.max(F.length("line")).over(Window.partitionBy("doc_id"))
    return lines(docs).select("doc_id", "pos", F.round(F.length("line") / F.nullif(peak, F.lit(0)), 6).alias("score"))


@query("json_lenient", "events", sql="SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_lenient(events: DataFrame) -> DataFrame:
    """A number out of replies that are fenced or have prose around them."""
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("Sure: "), "props", F.lit(" as asked")))
    return events.select("event_id", F.get_json_object(salvaged(fenced)["value"], "$.k").cast("bigint").alias("k"))
