"""Entity resolution: labels to events, by the rules for registry ids, ontology terms, token order and similarity, in the order of their authority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions import labels as L
from evigraph.functions.similarity import WEIGHTS, label_similarity, word_overlap
from evigraph.operators.graphs import components, stored


def buckets(labels: DataFrame) -> DataFrame:
    """One row per normal form of ``labels`` (label, level, wiki_id, and perhaps normal, curie and match, how sure the term is)."""
    for name, kind in (("curie", "string"), ("match", "double")):
        if name not in labels.columns:
            labels = labels.withColumn(name, F.lit(None).cast(kind))
    if "normal" not in labels.columns:
        labels = labels.withColumn("normal", L.normalise(F.col("label")))
    rows = labels.where("normal <> ''")
    surest = F.max_by(F.upper("curie"), F.struct("match", F.upper("curie")))
    return rows.groupBy("normal").agg(F.min("level").alias("level"), F.min("wiki_id").alias("wiki_id"), surest.alias("curie"), F.max("match").alias("match"), F.min(L.polarity(F.col("label"))).alias("polarity"), F.count("*").alias("n_labels"))


#: How sure a term must be for labels to be joined by it (fixed value).
SURE_TERM = 0.75


def curie_links(forms: DataFrame) -> DataFrame:
    """(a, b): forms and the first form of the same ontology term, if both are sure and don't point opposite ways."""
    sure = forms.where((F.col("curie").isNotNull()) & (F.col("match") >= SURE_TERM))
    anchors = sure.groupBy("curie").agg(F.min("normal").alias("b"), F.min_by("polarity", "normal").alias("p"))
    return sure.join(anchors, "curie").where((F.col("normal") != F.col("b")) & (F.col("polarity") * F.col("p") >= 0)).select(F.col("normal").alias("a"), "b")


def fuzzy_pairs(forms: DataFrame, threshold: float = 0.86) -> DataFrame:
    """(a, b, score) of forms of one level and no opposite polarity that are similar enough.

    Pairs are looked for among forms that share a word: without one the score is 0.6 at most.  The words of a
    form that are rare among all forms come first, and only as many as a match needs are used, so that a
    common word doesn't bring all forms together.
    """
    if threshold <= 0.6:
        raise ValueError("below 0.6 forms without a common word could match")
    words = forms.select("normal", F.explode(F.array_distinct(F.split("normal", " "))).alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("n"))
    ranked = words.join(often, "word").groupBy("normal").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("w"))
    # A Jaccard index of j needs a common word among the first size - ceil(j * size) + 1.
    least = (threshold - 0.6) / 0.4
    prefix = F.slice("w", 1, F.size("w") - F.ceil(F.size("w") * F.lit(least)).cast("int") + 1)
    posted = ranked.select("normal", F.explode(F.transform(prefix, lambda s: s["word"])).alias("word")).join(forms.select("normal", "level", "polarity"), "normal")
    a, b = posted.alias("a"), posted.alias("b")
    met = a.join(b, (F.col("a.word") == F.col("b.word")) & (F.col("a.level") == F.col("b.level")) & (F.col("a.normal") < F.col("b.normal")) & (F.col("a.polarity") * F.col("b.polarity") >= 0))
    pairs = met.select(F.col("a.normal").alias("a"), F.col("b.normal").alias("b")).distinct()
    shared, held = word_overlap("a", "b")
    best = WEIGHTS["sequence"] + WEIGHTS["jaccard"] * shared + WEIGHTS["containment"] * held  # if all matches in order
    return pairs.where(best >= threshold - 1e-4).withColumn("score", label_similarity("a", "b")).where(F.col("score") >= threshold)


def canonical_events(labels: DataFrame, threshold: float = 0.86) -> DataFrame:
    """(label, normal, event, basis): the event of each label, and the first rule that joined it to another form.

    Labels are read and brought to normal form once; every rule and round starts from stored forms.
    """
    rows = stored(labels.withColumn("normal", L.normalise(F.col("label"))))
    forms = stored(buckets(rows))
    anchored = lambda key: forms.where(f"{key} IS NOT NULL").join(forms.groupBy(key).agg(F.min("normal").alias("b")), key).where("normal <> b").select(F.col("normal").alias("a"), "b")
    forms = forms.withColumn("tokens", L.token_key(F.col("normal")))
    same_tokens = forms.groupBy("tokens", "level", "polarity").agg(F.min("normal").alias("b"))
    by_tokens = forms.join(same_tokens, ["tokens", "level", "polarity"]).where("normal <> b").select(F.col("normal").alias("a"), "b")
    rules = (anchored("wiki_id"), curie_links(forms), by_tokens, fuzzy_pairs(forms, threshold).select("a", "b"))
    links = stored(reduce(DataFrame.union, (pairs.withColumn("rule", F.lit(i)) for i, pairs in enumerate(rules, 1))))
    comps = components(forms.select(F.col("normal").alias("node")), links)
    touched = links.select(F.explode(F.array("a", "b")).alias("normal"), "rule").groupBy("normal").agg(F.min("rule").alias("rule"))
    basis = F.lit("own_group")
    for i, name in enumerate(("registry", "term", "token_order", "similar"), 1):
        basis = F.when(F.col("rule") == i, name).otherwise(basis)
    return rows.join(comps.toDF("normal", "event"), "normal").join(touched, "normal", "left").select("label", "normal", "event", basis.alias("basis"))
