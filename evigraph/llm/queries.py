"""The queries that apply the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import decontaminate, quality, secrets
from evigraph.llm.exact_dedup import exact_dedup
from evigraph.llm.hmm import lm_scores
from evigraph.llm.line_dedup import line_marks
from evigraph.llm.near_dedup import near_duplicates
from evigraph.llm.sentencepiece_codec import sentencepiece_tokens
from evigraph.llm.sharding import kd_shards
from evigraph.llm.url_filter import judge_urls

#: Rules of op5: host and path prefix, and whether the rule blocks.
URL_RULES = [("com/en/", True), ("example.com/en/7", False), ("net/de/", False), ("example.net/de/8", True), ("org/es/", True)]
SHARDS = 40
#: The SentencePiece model; the driver reads it, executors get it broadcast.
PIECES = os.environ.get("EVIGRAPH_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_tokens(table(spark, sf_dir, "documents"), PIECES)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"), SHARDS)


def op7_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_marks(table(spark, sf_dir, "documents")).withColumn("removed", F.array_join("removed", ","))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.span_digest(secrets.scan_secrets(docs, secrets.fit(docs)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_hidden_markov": op3_hidden_markov,
    "op4_decontamination": op4_decontamination,
    "op5_url_filter": op5_url_filter,
    "op6_kd_sharding": op6_kd_sharding,
    "op7_hyperminhash": op7_hyperminhash,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality": op9_quality,
    "op10_secrets": op10_secrets,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "op4_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bm AS (SELECT item_id, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0),
        g AS (SELECT DISTINCT item_id, m, list_aggregate(w[i:i + m - 1], 'string_agg', ' ') AS k FROM (SELECT item_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM bm)),
        dg AS (SELECT doc_id, m, i, list_aggregate(w[i:i + m - 1], 'string_agg', ' ') AS k
               FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bm) WHERE len(w) >= m)),
        h AS (SELECT dg.doc_id, g.item_id, dg.i, g.m FROM dg JOIN g USING (m, k)),
        n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id),
        -- Proximity: all words of a window within 20 words of one occurrence of its rarest.
        ot AS (SELECT DISTINCT unnest(w) AS term FROM bm),
        tk AS (SELECT doc_id, pos, term FROM (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM d) SEMI JOIN ot USING (term)),
        oc AS (SELECT ot.term, count(tk.pos) AS often FROM ot LEFT JOIN tk USING (term) GROUP BY ot.term),
        wn AS (SELECT DISTINCT item_id, w[i:i + m - 1] AS win FROM (SELECT item_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM bm)),
        wi AS (SELECT win, row_number() OVER (ORDER BY win) AS wid FROM (SELECT DISTINCT win FROM wn)),
        wt AS (SELECT wid, unnest(win) AS term, unnest(range(1, len(win) + 1)) AS place FROM wi),
        ld AS (SELECT wid, arg_min(term, (often, place)) AS lead FROM wt JOIN oc USING (term) GROUP BY wid),
        sz AS (SELECT wid, count(DISTINCT term) AS n FROM wt GROUP BY wid),
        cl AS (SELECT ld.wid, tk.doc_id, tk.pos FROM ld JOIN tk ON tk.term = ld.lead),
        ok AS (SELECT wid, doc_id, pos FROM (SELECT DISTINCT cl.wid, cl.doc_id, cl.pos, o.term FROM cl JOIN (SELECT DISTINCT wid, term FROM wt) v USING (wid) JOIN tk o ON o.doc_id = cl.doc_id AND o.term = v.term AND abs(o.pos - cl.pos) <= 20)
               JOIN sz USING (wid) GROUP BY wid, doc_id, pos, n HAVING count(*) = n),
        nr AS (SELECT doc_id, count(DISTINCT item_id) AS n_near_items FROM ok JOIN wi USING (wid) JOIN wn USING (win) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_near_items, 0) AS n_near_items, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN nr ON nr.doc_id = d.doc_id""",
    "op5_url_filter": r"""
        WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        r(h, q, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        m AS (SELECT page_id, host, path, h || q AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC NULLS LAST) AS k
              FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1""",
    "op7_hyperminhash": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, list_aggregate(w[i:i + 2], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT i.a, i.b FROM i JOIN n na ON na.doc_id = i.a JOIN n nb ON nb.doc_id = i.b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
        r(id, upto) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.upto),
        c AS (SELECT id, min(upto) AS component_id FROM r GROUP BY id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.id = d.doc_id""",
    # Lines as sets of words; pairs that share two words of prefixes by exact document frequency (one, where both are one word).
    "op8_line_dedup": r"""
        WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS LAST) AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        p AS (SELECT r, doc_id, i - 1 AS pos, lower(ls[i]) AS line FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM o)),
        q AS (SELECT r, pos, list_sort(list_distinct(regexp_extract_all(line, '[^ 	-
]+'))) AS ws FROM p),
        k AS (SELECT r, pos, ws, len(ws) AS n, row_number() OVER (PARTITION BY ws ORDER BY r, pos) AS again, first_value((r, pos)) OVER (PARTITION BY ws ORDER BY r, pos) AS head FROM q WHERE len(ws) > 0),
        u AS (SELECT r, pos, n, ws FROM k WHERE again = 1),
        w AS (SELECT r, pos, n, unnest(ws) AS word FROM u),
        f AS (SELECT word, count(*) AS often FROM w GROUP BY word),
        x AS (SELECT r, pos, n, word FROM (SELECT w.*, row_number() OVER (PARTITION BY r, pos ORDER BY often, word) AS place FROM w JOIN f USING (word)) WHERE place <= n - CAST(ceil(0.8 * n) AS INT) + 2),
        c AS (SELECT a.r AS ar, a.pos AS ap, b.r AS br, b.pos AS bp FROM x a JOIN x b ON a.word = b.word AND (a.r, a.pos) < (b.r, b.pos) AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
              GROUP BY ALL HAVING count(*) >= 2 OR max(a.n + b.n) <= 2),
        g AS (SELECT DISTINCT br, bp FROM c JOIN u a ON a.r = ar AND a.pos = ap JOIN u b ON b.r = br AND b.pos = bp WHERE 9 * len(list_intersect(a.ws, b.ws)) >= 4 * (a.n + b.n)),
        m AS (SELECT k.r, k.pos FROM k WHERE again > 1 OR (k.r, k.pos) IN (SELECT (br, bp) FROM g)),
        s AS (SELECT r, count(*) AS n_removed, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS removed FROM m GROUP BY r)
        SELECT o.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed FROM o LEFT JOIN s USING (r)""",
}
