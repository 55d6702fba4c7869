"""Exact duplicates by distributed most-significant-digit radix partitioning.

Texts are compared as the UTF-8 bytes that remain after deleting ASCII white space.  Every round takes
the next run of bytes of the texts that are still undecided as one digit, counts (class, digit) with
map-side combining, and splits each class by digit.  A class of one member is done, and so is a class
whose members have all ended; only the rest go into the next round.  Digits grow from 64 bytes by a factor of four
and are never wider than 64 KB, so no key is longer than that, and a text of any length is read in as many
digits as it needs.  Equality is established byte by byte and no digest takes part in it.  A class that holds a
third of the rows is never brought together: its size and survivor are aggregates, and the join that hands them to
its members is a plain equi-join of two stored tables, whose hot partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.workspace import ROW_KEY, Workspace, filed, kept_rows, keyed, located

#: Bytes of the first digit and of the widest, and the factor by which each round's digit is wider than the last.
FIRST_DIGIT, LAST_DIGIT, GROWTH = 64, 64 << 10, 4


def without_whitespace(text: Column) -> Column:
    """The text without space, tab, line feed, vertical tab, form feed and carriage return."""
    for blank in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def without_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns and no others.

    Nulls, empty texts, repeats and ties are treated as by ``exact_dedup``; an empty table gives an empty result.
    """
    docs = filed(docs, Workspace(docs.sparkSession, "copies"))
    rows, key = keyed(docs, None)
    kept = exact_dedup(docs, id_col, text_col, carry=True).where("kept")
    return kept_rows(rows, kept.select(*(F.col(a).alias(b) for a, b in zip(ROW_KEY, key, strict=True))), key)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and with ``carry`` ROW_KEY.

    Of equal texts the row with the most code points stays, then the smallest id (a null id comes last), then the
    first row in the order of the table's files.  Null and empty texts, and texts of white space alone, are all
    equal to each other.  An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    space = Workspace(docs.sparkSession, "radix")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = located(filed(docs, space), F.col(id_col).alias("doc_id"), F.length(text).alias("n_cp"), without_whitespace(text).cast("binary").alias("rest"))
    rows = rows.select("doc_id", "n_cp", *ROW_KEY, F.lit(None).cast("bigint").alias("cls"), F.sha2("rest", 256).alias("text_sha256"), "rest")
    width, done, number = FIRST_DIGIT, [], 0
    best = F.struct((-F.col("n_cp")).alias("fewer"), F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), *ROW_KEY)
    while True:
        ended = F.octet_length("rest") <= width
        classed = rows.select("*", F.coalesce("cls", F.lit(0)).alias("k_cls"), F.substring("rest", 1, width).alias("k_digit"), ended.alias("k_ended"))
        counted = classed.groupBy("k_cls", "k_digit", "k_ended").agg(F.count("*").alias("n"), F.min(best).alias("best")).where("n > 1")
        # A number for each class that stays open; it only has to be unique within the stored table.
        classes = space.put(counted.withColumn("next_cls", F.monotonically_increasing_id()), f"classes{number}")
        rest = F.when(F.col("n").isNotNull() & ~F.col("k_ended"), F.expr(f"substring(rest, {width + 1})"))
        alone, own = F.col("n").isNull(), F.lit(True)
        for name in ROW_KEY:
            own &= F.col(name) == F.col(f"best.{name}")
        # Always the same join: one that turned from broadcast to shuffle at some size would hide its growth.
        split = classed.join(classes.hint("merge"), ["k_cls", "k_digit", "k_ended"], "left").select(
            "doc_id", "n_cp", *ROW_KEY, "text_sha256", F.coalesce("n", F.lit(1)).alias("group_size"), F.col("next_cls").alias("cls"), F.when(alone, F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"),
            (alone | own).alias("kept"), (alone | F.col("k_ended")).alias("over"), rest.alias("rest"))
        stored = space.put(split, f"round{number}")
        done.append(stored.where("over").select("doc_id", "keep_id", "group_size", "kept", "text_sha256", *(ROW_KEY if carry else ())))
        rows = stored.where("not over").select("doc_id", "n_cp", *ROW_KEY, "cls", "text_sha256", "rest")
        space.drop(f"classes{number}")
        if rows.isEmpty():
            break
        width, number = min(width * GROWTH, LAST_DIGIT), number + 1
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result
