"""Edge ratings: each one projection over edges joined with both ends' weights and degrees.

w is the edge's weight; cu, cv the ends' weights; du, dv their degrees; su, sv their weighted degrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from ..functions.tables import settle

c = F.col


def _table() -> dict[str, Column]:
    w, cu, cv, du, dv, su, sv = (c(x).cast("double") for x in ("weight", "cu", "cv", "du", "dv", "su", "sv"))
    return {
        "expansion_star": w / (cu * cv),
        "expansion_star_2": w * w / (cu * cv),
        "inner_outer": w / (su + sv - w),
        "pseudogeom": w * (1 / F.sqrt(cu) + 1 / F.sqrt(cv)) * (F.lit(0.6) + 0.4 * graph.fnv32(F.least("src", "dst") * (1 << 32) + F.greatest("src", "dst")) / float(1 << 32)),
        "addx": 1 / (du + dv),
        "multx": 1 / F.sqrt(du * dv),
        "max": 1 / F.greatest(du, dv),
        "log": F.when(du * dv == 1, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), F.log(du * dv))),
        "r1": 1 / (du * dv),
        "r2": 1 / (du * dv * cu * cv),
        "r3": 1 / (du + dv + cu + cv),
        "r4": du * dv / (cu * cv),
        "r5": (du + dv) / (cu + cv),
        "r6": 1 / ((du + dv) * (cu + cv)),
        "r7": w / (du * dv * cu * cv),
        "r8": w * du * dv / (cu * cv),
        "realweight": w,
    }


NAMES = ("expansion_star", "expansion_star_2", "expansion_star_2_algdist", "inner_outer", "pseudogeom", "addx", "multx", "max", "log", "r1", "r2", "r3", "r4", "r5", "r6", "r7", "r8", "realweight")


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ends = graph.degrees(edges, nodes).join(nodes, "node_id")
    a = ends.select(c("node_id").alias("src"), c("weight").alias("cu"), c("degree").alias("du"), c("weighted_degree").alias("su"))
    b = ends.select(c("node_id").alias("dst"), c("weight").alias("cv"), c("degree").alias("dv"), c("weighted_degree").alias("sv"))
    return edges.join(a, "src").join(b, "dst")


def rate(edges: DataFrame, nodes: DataFrame, names: tuple[str, ...] = ("expansion_star_2",), seed: int = 0) -> DataFrame:
    """src, dst, weight and the ratings asked for (pseudogeom's factor in [0.6, 1) is a hash of the pair)."""
    unknown = set(names) - set(NAMES)
    if unknown:
        raise ValueError(f"no such rating: {', '.join(sorted(unknown))}")
    table, rows = _table(), with_ends(edges, nodes)
    if "expansion_star_2_algdist" in names:
        rows = rows.join(algebraic_distance(edges, nodes, seed=seed), ["src", "dst"])
        table["expansion_star_2_algdist"] = c("weight").cast("double") ** 2 / (c("cu") * c("cv") * c("distance"))
    return rows.select("src", "dst", "weight", *[table[n].alias(n) for n in names])


def algebraic_distance(edges: DataFrame, nodes: DataFrame, starts: int = 3, sweeps: int = 7, seed: int = 0) -> DataFrame:
    """src, dst, distance: from random starts, damped averaging over neighbours (half old, half weighted mean); how far ends stay apart, over the sweeps, plus 1e-4.

    Starts are hashes of (seed, start, vertex) in [-0.5, 0.5), so that reruns agree.
    """
    start = F.array(*[graph.fnv32((seed * starts + s) * (1 << 40) + c("node_id")) / float(1 << 32) - 0.5 for s in range(starts)])
    x = nodes.select("node_id", start.alias("x"))
    for _ in range(sweeps):
        near = edges.join(x.select(c("node_id").alias("dst"), "x"), "dst").groupBy(c("src").alias("node_id")).agg(*[(F.sum(c("x")[s] * c("weight")) / F.sum("weight")).alias(f"m{s}") for s in range(starts)])
        x = settle(x.join(near, "node_id", "left").select("node_id", F.array(*[0.5 * c("x")[s] + 0.5 * F.coalesce(f"m{s}", c("x")[s]) for s in range(starts)]).alias("x")))
    a, b = x.select(c("node_id").alias("src"), c("x").alias("a")), x.select(c("node_id").alias("dst"), c("x").alias("b"))
    apart = F.aggregate(F.zip_with("a", "b", lambda p, q: F.abs(p - q)), F.lit(0.0), lambda t, d: t + d)
    return edges.join(a, "src").join(b, "dst").select("src", "dst", (apart / float(sweeps) + 1e-4).alias("distance"))


def by_rating(edges: DataFrame, nodes: DataFrame, name: str = "expansion_star_2") -> DataFrame:
    """Undirected pairs by falling rating, then ids."""
    return rate(edges, nodes, (name,)).where("src < dst").orderBy(F.desc(name), "src", "dst")
