"""Scores of the stream on a snapshot: buffer priorities and block scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from ..plans.config import PartitionConfig


def load_penalty(load: Column, weight: Column | float, ag: float) -> Column:
    return F.lit(ag) * F.sqrt(load) * weight


def assignment_score(gain: Column, load: Column, weight: Column | float, ag: float, fennel_weight: float = 1.0) -> Column:
    return gain - fennel_weight * load_penalty(load, weight, ag)


def lightest_block(blocks: DataFrame) -> DataFrame:
    """block: the lightest with room (load < cap), the lower on a tie, 0 if none has room."""
    best = F.min_by("block", F.struct("load", "block")).alias("b")
    return blocks.where("load < cap").agg(best).select(F.coalesce("b", F.lit(0)).alias("block"))


def neighbour_blocks(edges: DataFrame, assign: DataFrame, ghost_weight: float = 0.2) -> DataFrame:
    """src, block, gain: how many neighbours lie in each block; those with a ghost label count ``ghost_weight``."""
    a = assign.select(F.col("id").alias("dst"), "block", "status")
    one = F.when(F.col("status") == "ghost", F.lit(ghost_weight)).otherwise(F.lit(1.0))
    return edges.join(a, "dst").where(F.col("status").isin("assigned", "ghost")).groupBy("src", "block").agg(F.sum(one).alias("gain"))


def best_blocks(nodes: DataFrame, gains: DataFrame, blocks: DataFrame, ag: float) -> DataFrame:
    """node_id, block: for fixed loads the block of highest score with room, the lower on a tie, 0 if every block is full.

    A vertex is joined with the blocks of its neighbours and with the lightest block only: no other block can win, so rows made are those of ``gains`` plus one per vertex.
    """
    room = blocks.where("load < cap").select("block", "load")
    near = gains.join(room, "block").select(F.col("src").alias("node_id"), "block", "gain", "load")
    light = room.agg(F.min_by(F.struct("block", "load"), F.struct("load", "block")).alias("l"))
    alone = nodes.select("node_id").join(light).select("node_id", F.col("l.block").alias("block"), F.lit(0.0).alias("gain"), F.col("l.load").alias("load"))  # one row on the right
    offers = near.unionByName(alone).groupBy("node_id", "block").agg(F.max("gain").alias("gain"), F.max("load").alias("load"))
    score = assignment_score(F.col("gain"), F.col("load"), 1.0, ag)
    return offers.groupBy("node_id").agg(F.max_by("block", F.struct(score.alias("s"), (-F.col("block")).alias("b"))).alias("block")).select("node_id", F.coalesce("block", F.lit(0)).alias("block"))


def buffer_scores(edges: DataFrame, nodes: DataFrame, assign: DataFrame, cfg: PartitionConfig) -> DataFrame:
    """node_id, degree, assigned, buffered, ghosts, score, bucket: priority of each vertex under cfg.score, given what is assigned, queued or ghosted."""
    a = assign.select(F.col("id").alias("dst"), "block", "status")
    counts = edges.join(a, "dst", "left").groupBy(F.col("src").alias("node_id")).agg(
        F.count(F.lit(1)).alias("degree"), F.count_if(F.col("status") == "assigned").alias("assigned"), F.count_if(F.col("status") == "queued").alias("buffered"), F.count_if(F.col("status") == "ghost").alias("ghosts"))
    s = nodes.select("node_id").join(counts, "node_id", "left").na.fill(0)
    d, x, limit = F.col("degree").cast("double"), F.col("assigned").cast("double"), min(cfg.degree_limit, 10000)
    part = lambda v: F.when(d > 0, v / d).otherwise(F.lit(0.0))
    f = F.least(d / limit, F.lit(1.0))
    if cfg.score == "cms":
        same = edges.join(a.where("status = 'assigned'"), "dst").groupBy(F.col("src").alias("node_id"), "block").count().groupBy("node_id").agg(F.max("count").alias("same"))
        s = s.join(same, "node_id", "left").na.fill(0, ["same"])
    ghost = cfg.ghost_weight * F.col("ghosts") if cfg.ghosts else F.lit(0.0)
    score = {
        "anr": part(x), "haa": F.pow(f, cfg.haa_beta) + cfg.theta * (1 - f) * part(x + ghost), "nss": part(x + F.col("buffered")),
        "cbs": f + cfg.cbs_theta * part(x), "cbsq": F.least(F.pow(d / limit, cfg.haa_beta), F.lit(1.0)) + cfg.cbs_theta * part(x), "cms": part(F.col("same")) if cfg.score == "cms" else F.lit(0.0),
    }[cfg.score]
    return s.withColumn("score", score).select("node_id", "degree", "assigned", "buffered", "ghosts", "score", bucket(F.col("score"), cfg.disc_factor).alias("bucket"))


def bucket(score: Column, disc_factor: int) -> Column:
    """Priority bucket: the score in steps of 1 / disc_factor, halves away from zero."""
    return F.floor(score * disc_factor + 0.5).cast("int")


def top_batch(scores: DataFrame, batch_size: int) -> DataFrame:
    """A static batch: the ``batch_size`` vertices of highest bucket, ids first on ties (a report; the stream re-ranks after every vertex)."""
    return scores.orderBy(F.desc("bucket"), "node_id").limit(batch_size).select("node_id", "bucket", "score")


def running_load(assign: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, block, load of the block after the vertex was placed, in order of ids: sums within ranges of ids, and those of the ranges before, a row per block and range."""
    rows = assign.join(nodes.select(F.col("node_id").alias("id"), "weight"), "id").withColumn("range", F.floor(F.col("id") / graph.RANGE))
    own = F.sum("weight").over(Window.partitionBy("block", "range").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum("w").over(Window.partitionBy("block").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = rows.groupBy("block", "range").agg(F.sum("weight").alias("w")).select("block", "range", before.alias("before"))
    return rows.withColumn("own", own).join(ranges, ["block", "range"]).select("id", "block", (F.col("own") + F.col("before")).alias("load"))
