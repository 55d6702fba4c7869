"""Workflow states, fingerprints, histories and merges as pure functions of append-only logs.

Nothing is updated in place: the present state of a target is a fold of its log, a merge is a row of the decision log, and an
undone merge is a row that says so.  A table is made anew from what it was and the decisions that hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.operators.graphs import stored
from evigraph.schemas import STATES

# States that a record may go forward to; backward moves are always allowed.
FORWARD = {"raw": ("normalized", "curated"), "normalized": ("curated",), "curated": ("approved",), "approved": ("synthesized",), "synthesized": ()}
APPROVED = STATES.index("approved")


def rank(state: Column) -> Column:
    return reduce(lambda rest, s: F.when(state == s, STATES.index(s)).otherwise(rest), STATES, F.lit(None).cast("int"))


def allowed(before: Column, after: Column) -> Column:
    """Whether a record may go from one state to another."""
    forward = reduce(lambda rest, s: F.when(before == s, after.isin(*FORWARD[s]) if FORWARD[s] else F.lit(False)).otherwise(rest), FORWARD, F.lit(False))
    return F.coalesce((rank(after) <= rank(before)) | forward, F.lit(False))


def transitions(requests: DataFrame, *target: str) -> DataFrame:
    """``requests`` (target, log_id, logged_at, state) with from_state, accepted and invalidates, in the order of each target's log.

    Every target begins as raw.  A request that skips a step is refused and changes nothing.  One that drops a
    record below approval invalidates what was built on it.
    """
    entry = F.struct("logged_at", "log_id", "state")
    start = F.struct(F.lit(STATES[0]).alias("now"), F.array().cast("array<struct<log_id:bigint,from_state:string,accepted:boolean>>").alias("steps"))

    def step(acc: Column, e: Column) -> Column:
        ok = allowed(acc["now"], e["state"])
        done = F.struct(e["log_id"].cast("bigint").alias("log_id"), acc["now"].alias("from_state"), ok.alias("accepted"))
        return F.struct(F.when(ok, e["state"]).otherwise(acc["now"]).alias("now"), F.concat(acc["steps"], F.array(done)).alias("steps"))

    folded = requests.groupBy(*target).agg(F.aggregate(F.sort_array(F.collect_list(entry)), start, step, lambda acc: acc["steps"]).alias("steps"))  # the log of one target
    taken = folded.select(*target, F.explode("steps").alias("s")).select(*target, "s.*")
    full = requests.join(taken, [*target, "log_id"])
    return full.withColumn("invalidates", F.col("accepted") & (rank(F.col("from_state")) >= APPROVED) & (rank(F.col("state")) < APPROVED))


def present(taken: DataFrame, *target: str) -> DataFrame:
    """(target, state, since): the last accepted state of each target."""
    last = F.struct("logged_at", "log_id")
    return taken.where("accepted").groupBy(*target).agg(F.max_by("state", last).alias("state"), F.max("logged_at").alias("since"))


def event_hash(canonical: DataFrame, alias: DataFrame) -> DataFrame:
    """(canonical_id, hash): what an approval of an event rests on: its name, level, term, registry id, and its labels."""
    labels = alias.groupBy("canonical_id").agg(F.array_join(F.sort_array(F.collect_list("raw_label")), ";").alias("labels"))  # labels of one event
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    text = F.concat_ws("|", *(blank(c) for c in ("canonical_name", "level", "curie", "wiki_id", "labels")))
    return canonical.join(labels, "canonical_id", "left").select("canonical_id", fingerprint(text).alias("hash"))


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def edge_hash(edges: DataFrame, hashes: DataFrame) -> DataFrame:
    """(ker_key, hash) of edges (ker_key, up_id, down_id): an edge changes when either of its events does."""
    up, down = hashes.select(F.col("canonical_id").alias("up_id"), F.col("hash").alias("u")), hashes.select(F.col("canonical_id").alias("down_id"), F.col("hash").alias("d"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return edges.join(up, "up_id", "left").join(down, "down_id", "left").select("ker_key", fingerprint(F.concat_ws("|", "ker_key", blank("u"), blank("d"))).alias("hash"))


def effective(states: DataFrame, hashes: DataFrame, key: str) -> DataFrame:
    """``states`` (key, state, approved_hash) with hash, drifted and effective_state: approved, but what was approved has changed."""
    joined = states.join(hashes, key, "left")
    drifted = (rank(F.col("state")) >= APPROVED) & F.col("approved_hash").isNotNull() & F.col("hash").isNotNull() & (F.col("approved_hash") != F.col("hash"))
    joined = joined.withColumn("drifted", F.coalesce(drifted, F.lit(False)))
    return joined.withColumn("effective_state", F.when(F.col("drifted"), "curated").otherwise(F.col("state")))


def invalidated(syntheses: DataFrame, retracted: DataFrame) -> DataFrame:
    """``syntheses`` (up_id, down_id, stale, ...) with stale and reason after events (event_id, reason) were retracted: those on either end."""
    ends = syntheses.select("up_id", "down_id", F.explode(F.array_distinct(F.array("up_id", "down_id"))).alias("event_id"))
    why = ends.join(retracted, "event_id").groupBy("up_id", "down_id").agg(F.min("reason").alias("reason"))
    return syntheses.join(why, ["up_id", "down_id"], "left").withColumn("stale", F.col("stale") | F.col("reason").isNotNull())


def versions(updates: DataFrame, key: str, order: list[str], *fields: str) -> DataFrame:
    """A slowly changing history of ``updates``: (key, version, fields, valid_from, valid_to, is_current); what changes nothing makes no version."""
    by = Window.partitionBy(key).orderBy(*order)
    value = F.struct(*fields)
    first = F.row_number().over(by) == 1
    changed = updates.withColumn("changed", first | ~value.eqNullSafe(F.lag(value).over(by))).where("changed")
    return changed.select(key, F.row_number().over(by).alias("version"), *fields, F.col(order[0]).alias("valid_from"), F.lead(order[0]).over(by).alias("valid_to"), F.lead(order[-1]).over(by).isNull().alias("is_current"))


def survivors(decisions: DataFrame) -> DataFrame:
    """(member, survivor): where each merged event has gone, by the merges (decision_id, member, survivor, reverted) that hold.

    A later merge of an event overrides an earlier one, and a survivor that was itself merged passes its members on.
    """
    held = decisions.where("NOT reverted AND member <> survivor")
    mapping = stored(held.groupBy("member").agg(F.max_by("survivor", "decision_id").alias("survivor")))
    while True:
        on = mapping.toDF("survivor", "further")
        moved = stored(mapping.join(on, "survivor", "left").select("member", F.coalesce("further", "survivor").alias("survivor")).where("member <> survivor"))
        if moved.join(mapping.withColumnRenamed("survivor", "before"), "member", "left").where("before IS NULL OR before <> survivor").isEmpty():
            return moved
        mapping = moved


def remapped(table: DataFrame, mapping: DataFrame, *columns: str) -> DataFrame:
    """``table`` with the ids in ``columns`` replaced by their survivors."""
    for c in columns:
        table = table.join(mapping.select(F.col("member").alias(c), F.col("survivor").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return table


def merged_events(canonical: DataFrame, mapping: DataFrame) -> DataFrame:
    """The events that are left, with the source rows of those merged into them."""
    into = canonical.join(mapping.withColumnRenamed("member", "canonical_id"), "canonical_id").groupBy(F.col("survivor").alias("canonical_id")).agg(F.sum("n_source_rows").alias("more"), F.count("*").alias("n_merged"))
    left = canonical.join(mapping.select(F.col("member").alias("canonical_id")), "canonical_id", "left_anti").join(into, "canonical_id", "left")
    return left.withColumn("n_source_rows", F.col("n_source_rows") + F.coalesce("more", F.lit(0))).withColumn("n_merged", F.coalesce("n_merged", F.lit(0))).drop("more")


def merge_conflicts(events: DataFrame, members: DataFrame) -> DataFrame:
    """(grp, conflicts): what speaks against merging the events of a group: members (grp, canonical_id) that differ in sign, level or term."""
    met = members.join(events, "canonical_id")
    differ = lambda c, name: F.when(F.countDistinct(c) > 1, F.lit(name))
    both = (F.max("sign") > 0) & (F.min("sign") < 0)
    found = met.groupBy("grp").agg(F.filter(F.array(F.when(both, F.lit("opposite signs")), differ("level", "different levels"), differ("curie", "different terms")), lambda c: c.isNotNull()).alias("conflicts"))
    return found


def merge_allowed(relationship: Column, conflicts: Column, coarsen: bool = False) -> Column:
    """Whether a group may be merged: equivalent records without conflicts; into a broader event also others, unless they contradict."""
    if coarsen:
        return (relationship != "contradictory_or_incompatible") & ~F.array_contains(conflicts, "opposite signs")
    return (relationship == "equivalent") & (F.size(conflicts) == 0)
