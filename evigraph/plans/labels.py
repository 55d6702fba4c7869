"""Queries over labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions import labels as L
from evigraph.plans.registry import query


def _re(column: str, pattern: str) -> str:
    return f"regexp_matches(coalesce({column}, ''), '(?i){pattern}')"


def normalise_sql(column: str) -> str:
    """SQL for ``labels.normalise``."""
    text = f"regexp_replace(lower(trim(coalesce({column}, ''))), '{L.COMPOUND}', '\\1\\2', 'g')"
    for pattern, words in (*L.PHRASES, *L.ABBREVIATIONS.items(), (L.SETTING, " "), ("-", " "), (r"[^a-z0-9\s]", " ")):
        text = f"regexp_replace({text}, '{pattern}', '{words.replace('$1', chr(92) + '1')}', 'g')"
    table = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in L.SYNONYMS.items()) + "}"
    drop = ", ".join(f"'{w}'" for w in ("", *L.STOPWORDS, *L.CONTEXT_WORDS, *L.MODIFIERS))
    kept = f"list_filter(list_transform(string_split(trim(regexp_replace({text}, '\\s+', ' ', 'g')), ' '), lambda w: coalesce({table}[w], w)), lambda w: w NOT IN ({drop}))"
    return f"(SELECT array_to_string(list_filter(k, lambda w, i: i = 1 OR k[i - 1] <> w), ' ') FROM (SELECT {kept} AS k))"


def polarity_sql(column: str) -> str:
    flat = f"replace(regexp_replace(lower(coalesce({column}, '')), '{L.COMPOUND}', '\\1\\2', 'g'), '-', ' ')"
    up, down = (f"regexp_matches({flat}, '{p}')" for p in (L.POSITIVE, L.NEGATIVE))
    return f"CASE WHEN {up} AND NOT {down} THEN 1 WHEN {down} AND NOT {up} THEN -1 ELSE 0 END"


NO_CHANGE, UP, DOWN, BROKEN, MENDED = (_re("raw_label", p) for p in (L.NO_CHANGE, L.INCREASE, L.DECREASE, L.DISRUPTION, L.RESTORATION))


@query("normalise_label", "labels_", sql=f"SELECT label, level, {normalise_sql('label')} AS normal FROM labels_")
def normalise_label(labels: DataFrame) -> DataFrame:
    return labels.select("label", "level", L.normalise(F.col("label")).alias("normal"))


@query("polarity", "alias", sql=f"SELECT raw_label, {polarity_sql('raw_label')} AS polarity FROM alias")
def polarity(alias: DataFrame) -> DataFrame:
    return alias.select("raw_label", L.polarity(F.col("raw_label")).alias("polarity"))


@query("token_key", "labels_", sql=f"SELECT label, array_to_string(list_sort(list_distinct(string_split({normalise_sql('label')}, ' '))), ' ') AS token_key FROM labels_")
def token_key(labels: DataFrame) -> DataFrame:
    return labels.select("label", L.token_key(L.normalise(F.col("label"))).alias("token_key"))


@query("is_key_event", "alias", sql=f"SELECT raw_label, trim(raw_label) <> '' AND NOT {NO_CHANGE} AS is_event FROM alias")
def is_key_event(alias: DataFrame) -> DataFrame:
    return alias.select("raw_label", L.is_event_label(F.col("raw_label")).alias("is_event"))


STATE = f"s AS (SELECT canonical_id, raw_label, {NO_CHANGE} AS nc, {UP} AS up, {DOWN} AS down, {BROKEN} AS broken, {MENDED} AS mended FROM alias)"


@query("read_state", "alias", sql=f"""WITH {STATE} SELECT canonical_id, raw_label, NOT nc AND up AS increase, NOT nc AND down AS decrease, NOT nc AND broken AS disruption, NOT nc AND mended AS restoration, nc AS no_change,
    CASE WHEN nc THEN 0 WHEN up AND NOT down THEN 1 WHEN down AND NOT up THEN -1 WHEN mended AND NOT broken THEN 1 WHEN broken AND NOT mended THEN -1 ELSE 0 END AS sign,
    CASE WHEN nc THEN 'none' WHEN broken OR mended THEN 'integrity' WHEN up OR down THEN 'quantity' END AS axis FROM s""")
def read_state(alias: DataFrame) -> DataFrame:
    read = alias.select("canonical_id", "raw_label", L.state(F.col("raw_label")).alias("s"))
    return read.select("canonical_id", "raw_label", "s.*", L.state_sign(F.col("s")).alias("sign"), L.state_axis(F.col("s")).alias("axis"))


@query("object_type", "alias", sql=f"SELECT raw_label, CASE WHEN trim(raw_label) = '' THEN 'unknown' WHEN {NO_CHANGE} THEN 'observation' WHEN {UP} OR {DOWN} OR {BROKEN} OR {MENDED} OR {_re('raw_label', L.UNSIGNED)} OR {_re('raw_label', L.PROCESS)} THEN 'event' ELSE 'entity' END AS object_type FROM alias")
def object_type(alias: DataFrame) -> DataFrame:
    return alias.select("raw_label", L.object_type(F.col("raw_label")).alias("object_type"))


@query("name_problems", "alias", sql=f"SELECT raw_label, CASE WHEN {NO_CHANGE} THEN 'reports no change' ELSE 'names a thing, not an event' END AS problem FROM alias WHERE {NO_CHANGE} OR NOT ({UP} OR {DOWN} OR {BROKEN} OR {MENDED} OR {_re('raw_label', L.UNSIGNED)} OR {_re('raw_label', L.PROCESS)})")
def name_problems(alias: DataFrame) -> DataFrame:
    typed = alias.select("raw_label", L.object_type(F.col("raw_label")).alias("t")).where("t IN ('entity', 'observation')")
    return typed.select("raw_label", F.when(F.col("t") == "observation", "reports no change").otherwise("names a thing, not an event").alias("problem"))


SUBTYPE_SQL = "CASE " + " ".join(f"WHEN {_re('x', p)} THEN '{c}'" for p, c in L.SUBTYPES) + " END"


@query("subtype_class", "part", sql=f"WITH n AS (SELECT p_partkey, concat('NaV1.', p_size % 9, ' or GluN', p_size % 3, p_brand) AS x FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, p_name FROM part WHERE p_size % 2 = 1) SELECT p_partkey, {SUBTYPE_SQL} AS subtype FROM n")
def subtype_class(part: DataFrame) -> DataFrame:
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("NaV1."), F.col("p_size") % 9, F.lit(" or GluN"), F.col("p_size") % 3, "p_brand")).otherwise(F.col("p_name"))
    return part.select("p_partkey", L.subtype_class(text).alias("subtype"))


_MOVES = "|".join(p.removeprefix(r"\b").removesuffix(r"\b") for p in (L.INCREASE, L.DECREASE, L.DISRUPTION, L.RESTORATION))


def participants_sql(column: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({normalise_sql(column)}, ' '), lambda w: length(w) > 1 AND NOT regexp_full_match(w, '{_MOVES}'))))"


@query("participants", "labels_", sql=f"SELECT label, {participants_sql('label')} AS participants FROM labels_")
def participants(labels: DataFrame) -> DataFrame:
    return labels.select("label", L.participants(F.col("label")).alias("participants"))


@query("mentions", "labels_", sql=f"SELECT label, len(list_intersect(string_split({normalise_sql('label')}, ' '), ['steel', 'brushed', 'level'])) >= 2 AS mentions_steel FROM labels_")
def mentions(labels: DataFrame) -> DataFrame:
    return labels.select("label", L.mentions(L.normalise(F.col("label")), F.lit("steel of brushed level")).alias("mentions_steel"))


@query("bare_tokens", "labels_", sql=f"""SELECT label, list_sort(list_distinct(list_transform(list_filter(string_split({normalise_sql('label')}, ' '), lambda w: w NOT IN ({', '.join(repr(w) for w in ('', *L.STOPWORDS))})), lambda w: CASE WHEN length(w) > 4 AND w LIKE '%s' THEN w[:-2] ELSE w END))) AS tokens FROM labels_""")
def bare_tokens(labels: DataFrame) -> DataFrame:
    return labels.select("label", L.bare_tokens(L.normalise(F.col("label"))).alias("tokens"))


BUCKETS = f"b AS (SELECT {normalise_sql('label')} AS normal, level, wiki_id, label FROM labels_)"


@query("er_buckets", "labels_", sql=f"WITH {BUCKETS} SELECT normal, count(*) AS n_labels, count(DISTINCT level) AS n_levels, min(wiki_id) AS wiki_id FROM b GROUP BY normal")
def er_buckets(labels: DataFrame) -> DataFrame:
    return labels.select(L.normalise(F.col("label")).alias("normal"), "level", "wiki_id").groupBy("normal").agg(F.count("*").alias("n_labels"), F.countDistinct("level").alias("n_levels"), F.min("wiki_id").alias("wiki_id"))


@query("er_rule_wiki", "labels_", sql=f"WITH {BUCKETS}, w AS (SELECT wiki_id, min(normal) AS anchor FROM b WHERE wiki_id IS NOT NULL GROUP BY 1) SELECT DISTINCT b.normal, w.anchor FROM b JOIN w USING (wiki_id) WHERE b.normal <> w.anchor")
def er_rule_wiki(labels: DataFrame) -> DataFrame:
    rows = labels.select(L.normalise(F.col("label")).alias("normal"), "wiki_id").where("wiki_id IS NOT NULL")
    return rows.join(rows.groupBy("wiki_id").agg(F.min("normal").alias("anchor")), "wiki_id").where("normal <> anchor").select("normal", "anchor").distinct()


@query("er_rule_tokens", "labels_", sql=f"WITH {BUCKETS}, k AS (SELECT DISTINCT normal, array_to_string(list_sort(list_distinct(string_split(normal, ' '))), ' ') AS k FROM b), a AS (SELECT k, min(normal) AS anchor FROM k GROUP BY 1) SELECT normal, anchor FROM k JOIN a USING (k) WHERE normal <> anchor")
def er_rule_tokens(labels: DataFrame) -> DataFrame:
    rows = labels.select(L.normalise(F.col("label")).alias("normal")).distinct().withColumn("k", L.token_key(F.col("normal")))
    return rows.join(rows.groupBy("k").agg(F.min("normal").alias("anchor")), "k").where("normal <> anchor").select("normal", "anchor")


@query("majority_polarity", "alias", sql=f"SELECT canonical_id, CAST(sign(sum(({polarity_sql('raw_label')}) * n_uses)) AS INT) AS polarity FROM alias GROUP BY 1")
def majority_polarity(alias: DataFrame) -> DataFrame:
    return alias.groupBy("canonical_id").agg(F.signum(F.sum(L.polarity(F.col("raw_label")) * F.col("n_uses"))).cast("int").alias("polarity"))


@query("compression_pct", "labels_", sql=f"WITH {BUCKETS} SELECT count(DISTINCT label) AS n_raw, count(DISTINCT normal) AS n_canonical, round(100 * (1 - count(DISTINCT normal) / count(DISTINCT label)), 1) AS compression_pct FROM b")
def compression_pct(labels: DataFrame) -> DataFrame:
    counted = labels.agg(F.countDistinct("label").alias("n_raw"), F.countDistinct(L.normalise(F.col("label"))).alias("n_canonical"))
    return counted.withColumn("compression_pct", F.round(100 * (1 - F.col("n_canonical") / F.col("n_raw")), 1))
