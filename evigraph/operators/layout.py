"""Drawings of edge graphs: levels in lanes, depth in columns, rows by the mean place of neighbours, and the backbone.

Events are few against claims, but nothing here collects them: places are window ranks within a lane or column, and
each sweep is one join with the neighbours' places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.operators.graphs import depth, stored

#: Sweeps in either direction, and distances in a drawing (fixed values).
SWEEPS, LANE_WIDTH, ROW_HEIGHT = 6, 260.0, 110.0


def band_for(depths: Column, deepest: Column, role: Column) -> Column:
    """Which of five bands an event is drawn in: by its role, else by how deep it is."""
    share = depths / deepest
    return F.when(role.isin("MIE", "AO"), role).when(deepest <= 1, "Intermediate").when(share <= 0.34, "Early").when(share <= 0.67, "Intermediate").otherwise("Late")


def barycentre(nodes: DataFrame, edges: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """(node, lane, place): the order of nodes (node, lane) within lanes after sweeps, forward and backward in turn.

    In a forward sweep a node goes to the mean place of the nodes that lead to it, in a backward one to that of those it leads to;
    nodes without such neighbours keep their place.  Ties go by name.
    """
    order = Window.partitionBy("lane")
    current = stored(nodes.select("node", "lane", (F.row_number().over(order.orderBy("node")) - 1).alias("place")))
    links = stored(edges.select("a", "b").where("a <> b").distinct())
    for turn in range(sweeps):
        here, there = ("b", "a") if turn % 2 == 0 else ("a", "b")
        mean = links.join(current.select(F.col("node").alias(there), "place"), there).groupBy(F.col(here).alias("node")).agg(F.avg("place").alias("mean"))
        moved = current.join(mean, "node", "left").withColumn("wish", F.coalesce("mean", F.col("place").cast("double")))
        current = stored(moved.select("node", "lane", (F.row_number().over(order.orderBy("wish", "node")) - 1).alias("place")))
    return current


def layered_positions(placed: DataFrame, saved: DataFrame) -> DataFrame:
    """(node, x, y) of nodes (node, lane, place); saved places (node, x, y) win."""
    x, y = F.col("lane") * LANE_WIDTH, F.col("place") * ROW_HEIGHT
    kept = saved.select("node", F.col("x").alias("sx"), F.col("y").alias("sy"))
    return placed.join(kept, "node", "left").select("node", F.coalesce("sx", x).alias("x"), F.coalesce("sy", y).alias("y"))


def causal_layout(edges: DataFrame, roles: DataFrame) -> DataFrame:
    """(node, column, place, band): columns by depth, with initiating events first and outcomes last; rows by the mean place to the left.

    ``edges`` (a, b) have no cycle, ``roles`` (node, role) may leave nodes out.
    """
    deep = depth(edges)
    deepest = deep.agg(F.max("depth").alias("deepest"))  # one row
    nodes = deep.join(roles, "node", "left").crossJoin(F.broadcast(deepest)).withColumn("role", F.coalesce("role", F.lit("KE")))
    column = F.when(F.col("role") == "MIE", 0).when(F.col("role") == "AO", F.col("deepest")).otherwise(F.col("depth"))
    nodes = stored(nodes.select("node", column.alias("lane"), band_for(F.col("depth"), F.col("deepest"), F.col("role")).alias("band")))
    placed = barycentre(nodes.select("node", "lane"), edges, sweeps=1)
    return placed.join(nodes.select("node", "band"), "node").select("node", F.col("lane").alias("column"), "place", "band")


def backward_edges(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """Edges that point to the left in a drawing (node, column)."""
    at = lambda end: placed.select(F.col("node").alias(end), F.col("column").alias(f"column_{end}"))
    return edges.join(at("a"), "a").join(at("b"), "b").where("column_b < column_a").select("a", "b", "column_a", "column_b")


def backbone(edges: DataFrame, most: int = 64) -> DataFrame:
    """(node, weight, previous): the heaviest path to each node of acyclic edges (a, b, weight), by rounds of relaxation.

    A path's weight is the sum of its edges'; ``previous`` is the node before on it, of equally heavy ones the last by name.
    """
    links = stored(edges.groupBy("a", "b").agg(F.max("weight").alias("w")))
    best = stored(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.lit(0.0).alias("weight"), F.lit(None).cast(edges.schema["a"].dataType).alias("previous")))
    for _ in range(most):
        reached = links.join(best.select(F.col("node").alias("a"), F.col("weight").alias("so_far")), "a").select(F.col("b").alias("node"), (F.col("so_far") + F.col("w")).alias("weight"), F.col("a").alias("previous"))
        rank = F.struct("weight", "previous")
        heavier = stored(best.unionByName(reached).groupBy("node").agg(F.max("weight").alias("weight"), F.max_by("previous", rank).alias("previous")))
        if heavier.join(best.withColumnRenamed("weight", "before"), "node").where("weight > before + 1e-9").isEmpty():
            return heavier
        best = heavier
    raise ValueError("the graph has a cycle or longer paths than allowed")


def shortest_path(edges: DataFrame, most: int = 12) -> DataFrame:
    """(grp, path): a shortest path between the anchors of each group of ``edges`` (grp, a, b, start, stop), of equally short ones the first.

    Breadth first, one round of a join for all groups; each round keeps one path to each node.
    """
    links = stored(edges.select("grp", "a", "b").where("a <> b").distinct())
    ends = edges.groupBy("grp").agg(F.min("start").alias("start"), F.min("stop").alias("stop"))
    reached = stored(ends.select("grp", F.col("start").alias("node"), F.array("start").alias("path")))
    edge = reached
    for _ in range(most):
        grown = edge.join(links.withColumnRenamed("a", "node"), ["grp", "node"]).select("grp", F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        fresh = stored(grown.groupBy("grp", "node").agg(F.min("path").alias("path")).join(reached.select("grp", "node"), ["grp", "node"], "left_anti"))
        if fresh.isEmpty():
            break
        reached, edge = stored(reached.unionByName(fresh)), fresh
    return reached.join(ends.select("grp", F.col("stop").alias("node")), ["grp", "node"]).select("grp", "path")
