"""Algorithms by mode: prepare, run, evaluate and report are plain functions; users may register their own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import metrics
from . import edge, node
from .config import PartitionConfig


@dataclass(frozen=True)
class Algorithm:
    """run(edges, nodes, cfg) -> assignment; evaluate(assignment, edges, nodes, cfg) -> one row of metrics. A ``progressive`` one takes a folder too, in which blocks appear batch by batch."""

    run: Callable[..., DataFrame]
    evaluate: Callable[[DataFrame, DataFrame, DataFrame, PartitionConfig], DataFrame]
    progressive: bool = False


def evaluate_nodes(assign: DataFrame, edges: DataFrame, nodes: DataFrame, cfg: PartitionConfig) -> DataFrame:
    from pyspark.sql import functions as F

    one = F.lit(1).alias("one")
    cut, ratio, bal = metrics.edge_cut(edges, assign), metrics.cut_ratio(edges, assign), metrics.balance(assign, nodes, cfg.k)
    return cut.select("*", one).join(ratio.select("*", one), "one").join(bal.select("*", one), "one").drop("one")


def evaluate_edges(assign: DataFrame, edges: DataFrame, nodes: DataFrame, cfg: PartitionConfig) -> DataFrame:
    return metrics.edge_partition_metrics(assign, nodes.count(), cfg.k)


_ALGORITHMS: dict[str, Algorithm] = {}


def register(mode: str, algorithm: Algorithm) -> None:
    _ALGORITHMS[mode] = algorithm


def create(mode: str) -> Algorithm:
    if mode not in _ALGORITHMS:
        raise KeyError(f"no algorithm {mode!r}; there are {', '.join(sorted(_ALGORITHMS))}")
    return _ALGORITHMS[mode]


register("node", Algorithm(node.partition, evaluate_nodes))
register("node_batched", Algorithm(node.partition_batched, evaluate_nodes, True))
register("node_distributed", Algorithm(node.partition_distributed, evaluate_nodes))
register("node_bisected", Algorithm(node.partition_bisected, evaluate_nodes))
register("edge", Algorithm(edge.partition, evaluate_edges))
register("edge_batched", Algorithm(edge.partition_batched, evaluate_edges, True))
