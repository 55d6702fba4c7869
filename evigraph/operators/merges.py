"""Whether two records name the same event: seven checks, a verdict, and pairs worth a look.

Checks are column expressions over what is known of each record, computed once per record and not once per pair.  Pairs
are looked for among records that share a word, as others can't reach the floor of similarity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import labels as L
from evigraph.functions.similarity import label_similarity

# Verdicts by how firmly they are held, and the similarity from which wording alone decides.
PRECEDENCE = {"contradictory_or_incompatible": 5, "narrower_than": 4, "broader_than": 4, "related_but_distinct": 3, "uncertain": 1, "equivalent": 0}
EQUIVALENT_FROM = 0.80
CONTRADICTORY, NARROWER, BROADER, RELATED, UNCERTAIN, EQUIVALENT = PRECEDENCE
CHECKS = ("object_type", "entity_vs_event", "participants", "direction", "level", "ontology", "entailment")
# Bounds for suggestions of merges, and shares of words.
REVIEW_FLOOR, REVIEW_CEILING, CONTAINMENT_FLOOR = 0.55, 0.86, 0.70


def described(records: DataFrame) -> DataFrame:
    """``records`` (key, label, level, curie) with what the checks need to know of each label."""
    label = F.col("label")
    state = L.state(label)
    read = records.withColumns({"normal": L.normalise(label), "type": L.object_type(label), "state": state, "participants": L.participants(label), "subtype": L.subtype_class(label), "names_class": L.names_class(label)})
    tidy = F.nullif(F.upper(F.trim(F.coalesce("curie", F.lit("")))), F.lit(""))
    return read.withColumns({"sign": L.state_sign(F.col("state")), "axis": L.state_axis(F.col("state")), "words": F.array_distinct(F.filter(F.split("normal", " "), lambda w: w != "")), "tokens": L.token_key(F.col("normal")), "curie": tidy})


def _side(records: DataFrame, side: str) -> DataFrame:
    return records.select(*(F.col(c).alias(f"{side}_{c}") for c in records.columns))


def _check(outcome: Column, verdict: Column) -> Column:
    return F.struct(outcome.alias("outcome"), verdict.alias("verdict"))


def _cases(*cases: tuple[Column, str, str | None], rest: tuple[str, str | None]) -> Column:
    """(outcome, verdict) of the first condition that holds."""
    value = lambda v: F.lit(v).cast("string")
    pick = lambda at: reduce(lambda found, c: F.when(c[0], value(c[at])).otherwise(found), reversed(cases), value(rest[at - 1]))
    return _check(pick(1), pick(2))


def checks(a: str = "a", b: str = "b", ancestors: bool = False) -> dict[str, Column]:
    """The seven checks of a pair as (outcome, verdict): ``pass``, ``fail`` or ``unknown``, and what a failure says.

    With ``ancestors`` the pair has columns ``b_above_a`` and ``a_above_b`` from an ontology.
    """
    x, y = (lambda c: F.col(f"{a}_{c}")), (lambda c: F.col(f"{b}_{c}"))
    either = lambda c, v: (x(c) == v) | (y(c) == v)
    both = lambda c: x(c).isNotNull() & y(c).isNotNull()
    shared, union = F.size(F.array_intersect(x("participants"), y("participants"))), F.size(F.array_union(x("participants"), y("participants")))
    no_level = (F.coalesce(x("level"), F.lit("")) == "") | (F.coalesce(y("level"), F.lit("")) == "")
    more = lambda p, q: F.array_except(p("words"), q("words"))
    only_qualified = lambda p, q: (F.size(more(q, p)) == 0) & (F.size(more(p, q)) > 0) & (F.size(q("words")) > 0) & F.forall(more(p, q), lambda w: w.isin(*L.QUALIFIERS))
    above = [(F.col("b_above_a"), "fail", NARROWER), (F.col("a_above_b"), "fail", BROADER)] if ancestors else []
    return {
        "object_type": _cases((either("type", "observation"), "fail", CONTRADICTORY), (either("type", "unknown"), "unknown", None), (x("type") != y("type"), "fail", RELATED), rest=("pass", None)),
        "entity_vs_event": _cases((((x("type") == "entity") & (y("type") == "event")) | ((x("type") == "event") & (y("type") == "entity")), "fail", RELATED), rest=("pass", None)),
        "participants": _cases(((F.size(x("participants")) == 0) | (F.size(y("participants")) == 0), "unknown", None), (shared * 2 >= union, "pass", None), rest=("fail", RELATED)),
        "direction": _cases(
            (x("state.no_change") != y("state.no_change"), "fail", CONTRADICTORY), (x("sign") * y("sign") < 0, "fail", CONTRADICTORY), (both("axis") & (x("axis") != y("axis")), "fail", RELATED),
            (x("axis").isNull() | y("axis").isNull(), "unknown", None), rest=("pass", None)),
        "level": _cases((no_level, "unknown", None), (x("level") == y("level"), "pass", None), rest=("fail", RELATED)),
        "ontology": _cases((~both("curie"), "unknown", None), (x("curie") == y("curie"), "pass", None), *above, rest=("fail", RELATED)),
        "entailment": _cases(
            (x("subtype").isNotNull() & y("subtype").isNull() & L.mentions(y("normal"), x("subtype")), "fail", NARROWER), (y("subtype").isNotNull() & x("subtype").isNull() & L.mentions(x("normal"), y("subtype")), "fail", BROADER),
            (F.coalesce(x("subtype") == y("subtype"), F.lit(False)) & (x("normal") != y("normal")), "fail", RELATED), (only_qualified(x, y), "fail", NARROWER), (only_qualified(y, x), "fail", BROADER),
            (x("names_class") & ~y("names_class") & (shared > 0), "fail", BROADER), (y("names_class") & ~x("names_class") & (shared > 0), "fail", NARROWER), rest=("pass", None))}


def severity(verdict: Column) -> Column:
    """How firmly a verdict objects to a merge."""
    return reduce(lambda rest, v: F.when(verdict == v, PRECEDENCE[v]).otherwise(rest), PRECEDENCE, F.lit(None).cast("int"))


def classify(records: DataFrame, pairs: DataFrame, ancestors: DataFrame | None = None) -> DataFrame:
    """``pairs`` (a, b) of keys of ``records`` (key, label, level, curie), with relationship, similarity, mergeable, explanation and checks.

    ``ancestors`` (curie, ancestor) is the closure of an ontology; without it the hierarchy isn't asked.  The firmest
    verdict of all checks counts, of equally firm ones the first.  Pairs with an unknown key are left out.
    """
    known = described(records)
    joined = pairs.join(_side(known, "a"), F.col("a") == F.col("a_key")).join(_side(known, "b"), F.col("b") == F.col("b_key"))
    if ancestors is not None:
        above = ancestors.select(F.upper("curie").alias("c"), F.upper("ancestor").alias("p")).distinct()
        for low, high in (("a", "b"), ("b", "a")):
            joined = joined.join(above.select(F.col("c").alias(f"{low}_curie"), F.col("p").alias(f"{high}_curie"), F.lit(True).alias(f"{high}_above_{low}")), [f"{low}_curie", f"{high}_curie"], "left")
        joined = joined.fillna(False, ["b_above_a", "a_above_b"])
    made = checks(ancestors=ancestors is not None)
    joined = joined.withColumns({f"c_{n}": c for n, c in made.items()}).withColumn("similarity", label_similarity("a_normal", "b_normal"))
    objections = F.filter(F.array(*(F.struct((-severity(F.col(f"c_{n}.verdict"))).alias("softer"), F.lit(i).alias("i"), F.col(f"c_{n}.verdict").alias("verdict")) for i, n in enumerate(CHECKS))), lambda o: o["verdict"].isNotNull())
    firm = F.get(F.sort_array(objections), 0)["verdict"]
    same = (F.col("c_ontology.outcome") == "pass") | (F.col("a_normal") == F.col("b_normal")) | (F.col("a_tokens") == F.col("b_tokens"))
    earned = F.when(same | ((F.col("similarity") >= EQUIVALENT_FROM) & (F.col("c_direction.outcome") == "pass")), EQUIVALENT).otherwise(UNCERTAIN)
    failed = F.get(F.filter(F.array(*(F.when(F.col(f"c_{n}.outcome") == "fail", F.lit(n)) for n in CHECKS)), lambda c: c.isNotNull()), 0)
    verdict = F.coalesce(firm, earned)
    why = F.concat(F.lit("“"), "a_label", F.lit("” and “"), "b_label", F.lit("”: "), F.replace(verdict, F.lit("_"), F.lit(" ")), F.coalesce(F.concat(F.lit("; decided by "), failed), F.lit("; no check failed")))
    return joined.select("a", "b", verdict.alias("relationship"), "similarity", (verdict == EQUIVALENT).alias("mergeable"), why.alias("explanation"), *(F.col(f"c_{n}.outcome").alias(f"check_{n}") for n in CHECKS))


def similar_pairs(records: DataFrame, floor: float, same_level: bool = False) -> DataFrame:
    """(a, b) of keys, a before b, whose normal forms may reach a similarity of ``floor``, which is above 0.45.

    Without a word in common only one form that holds the other can: sequences alone give 0.45.  Forms are joined on the
    beginnings of their words, and short ones, which may stand inside a word of another, on runs of three letters.
    """
    if floor <= 0.45:
        raise ValueError("below 0.45 forms that share nothing but letters could match")
    base = records.select("key", "level", L.normalise(F.col("label")).alias("normal")).where("normal <> ''").withColumn("words", F.split("normal", " "))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length("normal") - 2, F.lit(1))), lambda i: F.concat(F.lit("~"), F.substr(F.col("normal"), i, F.lit(3))))
    begins = F.transform("words", lambda w: F.substring(w, 1, 4))
    stems = base.select("key", "level", F.explode(F.array_distinct(F.when(F.size("words") <= 2, F.concat(begins, runs)).otherwise(begins))).alias("stem"))
    on = ["stem", "level"] if same_level else ["stem"]
    a, b = stems.alias("a"), stems.alias("b")
    cond = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on]) & (F.col("a.key") < F.col("b.key"))
    return a.join(b, cond).select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct()


def suggest_merges(canonical: DataFrame, floor: float = REVIEW_FLOOR, ceiling: float = REVIEW_CEILING, same_level: bool = True, respect_polarity: bool = True) -> DataFrame:
    """(source_id, source_name, target_id, target_name, level, similarity): pairs of events to look at, the smaller into the larger.

    ``canonical`` has (canonical_id, canonical_name, level, n_source_rows).  A pair qualifies by similarity, or when most of
    the words of one name are in the other's.  Pairs from the ceiling on are merged anyway.
    """
    rows = canonical.select("canonical_id", "canonical_name", F.coalesce("level", F.lit("")).alias("level"), F.coalesce("n_source_rows", F.lit(0)).alias("n"), L.normalise(F.col("canonical_name")).alias("normal"))
    rows = rows.withColumns({"polarity": L.polarity(F.col("canonical_name")), "bare": L.bare_tokens(F.col("normal"))})
    pairs = similar_pairs(canonical.select(F.col("canonical_id").alias("key"), F.col("canonical_name").alias("label"), F.coalesce("level", F.lit("")).alias("level")), floor, same_level)
    met = pairs.join(_side(rows, "a"), F.col("a") == F.col("a_canonical_id")).join(_side(rows, "b"), F.col("b") == F.col("b_canonical_id"))
    if respect_polarity:
        met = met.where(F.col("a_polarity") * F.col("b_polarity") >= 0)
    overlap = F.size(F.array_intersect("a_bare", "b_bare"))
    contained = F.coalesce(overlap / F.nullif(F.least(F.size("a_bare"), F.size("b_bare")), F.lit(0)), F.lit(0.0))
    scored = met.withColumn("contained", contained).withColumn("similarity", label_similarity("a_normal", "b_normal"))
    fits = scored.where((F.col("similarity") < ceiling) & ((F.col("similarity") >= floor) | (F.col("contained") >= CONTAINMENT_FLOOR)))
    small = F.col("a_n") <= F.col("b_n")
    pick = lambda c, first: F.when(small == first, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    return fits.select(
        pick("canonical_id", True).alias("source_id"), pick("canonical_name", True).alias("source_name"), pick("canonical_id", False).alias("target_id"), pick("canonical_name", False).alias("target_name"),
        F.col("a_level").alias("level"), F.round("similarity", 3).alias("similarity"))


def ranked(classified: DataFrame, score: Column | None = None) -> DataFrame:
    """Mergeable pairs first, then by an outside score, then by similarity; a score never makes a pair mergeable."""
    own = F.coalesce(score, F.lit(0.0)) if score is not None else F.lit(0.0)
    return classified.withColumn("rank_score", own).orderBy(F.desc("mergeable"), F.desc("rank_score"), F.desc("similarity"), "a", "b")


def group_verdict(members: DataFrame, classified: DataFrame) -> DataFrame:
    """(grp, relationship, n_pairs): the firmest verdict among the pairs within each group of ``members`` (grp, key)."""
    a, b = members.select("grp", F.col("key").alias("a")), members.select("grp", F.col("key").alias("b"))
    inside = classified.join(a, "a").join(b, ["grp", "b"])
    rank = F.struct(severity(F.col("relationship")), "relationship")
    return inside.groupBy("grp").agg(F.max_by("relationship", rank).alias("relationship"), F.count("*").alias("n_pairs"))


def summary(classified: DataFrame) -> DataFrame:
    """(relationship, n) for all relationships, those that don't occur included."""
    every = F.array(*map(F.lit, PRECEDENCE))
    names = classified.sparkSession.range(1).select(F.explode(every).alias("relationship"))
    return names.join(classified.groupBy("relationship").agg(F.count("*").alias("n")), "relationship", "left").fillna(0, ["n"])
