"""Quality of partitions, each a small aggregate over joins. ``assign`` has id and block; ``edges`` both directions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph


def edge_cut(edges: DataFrame, assign: DataFrame, weighted: bool = True) -> DataFrame:
    """Weight (or number) of edges between blocks: half of that of the arcs, rounded down."""
    w = F.col("weight") if weighted else F.lit(1)
    cut = F.coalesce(F.sum(F.when(F.col("own") != F.col("other"), w)), F.lit(0))
    return graph.with_blocks(edges, assign).agg(F.floor(cut / 2).cast("long").alias("edge_cut"))


def pairwise_cut(edges: DataFrame, assign: DataFrame, lhs: int, rhs: int) -> DataFrame:
    """Weight of the arcs from block lhs to block rhs."""
    return graph.with_blocks(edges, assign).agg(F.coalesce(F.sum(F.when((F.col("own") == lhs) & (F.col("other") == rhs), F.col("weight"))), F.lit(0)).cast("long").alias("cut"))


def block_cut(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """Per block, the weight of its arcs to other blocks."""
    return graph.with_blocks(edges, assign).where("own <> other").groupBy(F.col("own").alias("block")).agg(F.sum("weight").alias("cut"))


def cut_ratio(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """Number of cut edges over number of edges, null without edges."""
    counts = graph.with_blocks(edges, assign).agg(F.sum(F.when(F.col("own") != F.col("other"), 1).otherwise(0)).alias("c"), F.count(F.lit(1)).alias("m"))
    return counts.select(F.round(F.when(F.col("m") > 0, F.col("c") / F.col("m")), 6).alias("cut_ratio"))


def balance(assign: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Largest load over the even share, rounded up."""
    return graph.block_table(assign, nodes, k).agg((F.max("load") / F.ceil(F.sum("load") / F.lit(float(k)))).alias("balance"))


def balance_edges(edges: DataFrame, assign: DataFrame, k: int) -> DataFrame:
    """Largest number of arcs that start in a block over the even share, rounded up."""
    per = graph.with_blocks(edges, assign).groupBy("own").agg(F.count(F.lit(1)).alias("arcs"))
    return per.agg((F.max("arcs") / F.ceil(F.sum("arcs") / F.lit(float(k)))).alias("balance"))


def communication_volume(edges: DataFrame, assign: DataFrame, k: int) -> DataFrame:
    """block, volume: over its vertices, the number of different foreign blocks next to each."""
    foreign = graph.with_blocks(edges, assign).where("own <> other").select("src", "own", "other").distinct()
    every = assign.sparkSession.range(k).select(F.col("id").cast("int").alias("block"))
    return every.join(foreign.groupBy(F.col("own").alias("block")).agg(F.count(F.lit(1)).alias("volume")), "block", "left").na.fill(0, ["volume"])


def communication_summary(edges: DataFrame, assign: DataFrame, k: int) -> DataFrame:
    return communication_volume(edges, assign, k).agg(F.max("volume").alias("max_volume"), F.min("volume").alias("min_volume"), F.sum("volume").alias("total_volume"))


def boundary_nodes(edges: DataFrame, assign: DataFrame) -> DataFrame:
    return graph.boundary(edges, assign).agg(F.count(F.lit(1)).alias("boundary_nodes"))


def separator_weight(assign: DataFrame, nodes: DataFrame, separator: int) -> DataFrame:
    w = nodes.select(F.col("node_id").alias("id"), "weight")
    return assign.where(F.col("block") == separator).join(w, "id").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("separator_weight"))


def separator_balance(assign: DataFrame, nodes: DataFrame, k: int, separator: int) -> DataFrame:
    """Largest load outside of the separator over the even share of all vertices among the k - 1 other blocks."""
    return graph.block_table(assign, nodes, k).agg((F.max(F.when(F.col("block") != separator, F.col("load"))) / F.ceil(F.sum("load") / F.lit(float(k - 1)))).alias("balance"))


def edge_partition_metrics(edge_blocks: DataFrame, n: int, k: int) -> DataFrame:
    """Of edges (u, v, block): vertex_cut, replicas, replication_factor (over all n vertices), balance."""
    ends = edge_blocks.select("block", F.explode(F.array("u", "v")).alias("node_id")).distinct().groupBy("node_id").agg(F.count(F.lit(1)).alias("b"))
    per = edge_blocks.groupBy("block").agg(F.count(F.lit(1)).alias("m")).agg(F.max("m").alias("most"), F.sum("m").alias("m"))
    spread = ends.agg(F.sum(F.when(F.col("b") > 1, 1).otherwise(0)).alias("vertex_cut"), F.sum(F.col("b") - 1).alias("replicas"), (F.sum("b") / F.lit(float(n))).alias("replication_factor"))
    one = F.lit(1).alias("one")  # one row each
    return spread.select("*", one).join(per.select("*", one), "one").select("vertex_cut", "replicas", "replication_factor", (F.col("most") / F.ceil(F.col("m") / F.lit(float(k)))).alias("balance"))


def fennel_objective(edges: DataFrame, nodes: DataFrame, assign: DataFrame, k: int, ag: float, fennel_weight: float = 1.0) -> DataFrame:
    """Half of the penalties of all loads less the weight of inner arcs, as a whole number."""
    one = F.lit(1).alias("one")
    pen = graph.block_table(assign, nodes, k).agg((F.sum(F.lit(ag) * F.col("load") * F.sqrt("load")) * fennel_weight).alias("p"), one)
    inner = graph.with_blocks(edges, assign).agg(F.coalesce(F.sum(F.when(F.col("own") == F.col("other"), F.col("weight"))), F.lit(0)).alias("i"), one)
    return pen.join(inner, "one").select(((F.col("p") - F.col("i")) / 2).cast("long").alias("objective"))


def has_all_blocks(assign: DataFrame, k: int) -> DataFrame:
    return assign.agg((F.count_distinct("block") == k).alias("every_block_used"))


def components_of_blocks(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """node_id, component: parts that are connected inside of their block; an isolated vertex is its own."""
    from .connectivity import components

    inner = graph.with_blocks(edges, assign).where("own = other and src < dst").select("src", "dst")
    found = components(inner, "src", "dst")
    return assign.select(F.col("id").alias("node_id")).join(found, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def penalised_cut(edges: DataFrame, assign: DataFrame, k: int) -> DataFrame:
    """The cut; where the blocks aren't connected (not k parts in all), the weight of all edges times the number of parts is added."""
    one = F.lit(1).alias("one")
    parts = components_of_blocks(edges, assign).agg(F.count_distinct("component").alias("parts"), one)
    total = edges.agg(F.floor(F.coalesce(F.sum("weight"), F.lit(0)) / 2).alias("total"), one)
    both = edge_cut(edges, assign).select("*", one).join(parts, "one").join(total, "one")
    return both.select((F.col("edge_cut") + F.when(F.col("parts") != k, F.col("total") * F.col("parts")).otherwise(0)).cast("long").alias("edge_cut"))


def objective(edges: DataFrame, assign: DataFrame, k: int, kind: str = "cut") -> DataFrame:
    """The objective asked for: cut, connected (penalised cut) or volume (largest communication volume)."""
    if kind == "volume":
        return communication_summary(edges, assign, k).select(F.col("max_volume").alias("objective"))
    return (penalised_cut(edges, assign, k) if kind == "connected" else edge_cut(edges, assign)).select(F.col("edge_cut").alias("objective"))


def even_share(total: int, k: int) -> int:
    return math.ceil(total / k)
