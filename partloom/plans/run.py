"""One run end to end: read, partition, evaluate, write, log."""

from __future__ import annotations

import json
import resource
import time

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import registry
from .config import PartitionConfig, alpha_gamma
from ..sources import metis, sinks

RUN_LOG = """graph struct<filename:string,num_nodes:bigint,num_edges:bigint>,
config struct<k:int,seed:bigint,stream_buffer:bigint,model_mode:int,alpha:double,batch_size:bigint,max_buffer_size:bigint,buffer_score_type:string,bq_disc_factor:int,haa_theta:double,cbs_theta:double,bb_ratio:int>,
runtime struct<io:double,partition:double,model:double,postprocess:double,buffer:double,total:double>, memory struct<max_rss:bigint>,
metrics struct<edge_cut:bigint,vertex_cut:bigint,replicas:bigint,replication_factor:double,balance:double>"""


def max_rss_kb() -> int:
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss


def base_name(path: str) -> str:
    """File name without folders and without its last extension."""
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name else name


def log_name(path: str, cfg: PartitionConfig) -> str:
    return "_".join([base_name(path), str(cfg.k), str(cfg.batch_size), *[str(cfg.buffer_size)] * (cfg.buffer_size > 1)])


def log_row(spark: SparkSession, name: str, n: int, m: int, cfg: PartitionConfig, times: dict[str, float], measured: dict) -> DataFrame:
    """The run log: one nested row."""
    row = Row(
        graph=Row(filename=name, num_nodes=n, num_edges=m),
        config=Row(k=cfg.k, seed=cfg.seed, stream_buffer=cfg.batch_size, model_mode=-1 if cfg.minimal_mode else cfg.past_subset_size, alpha=0.0 if cfg.batch_alpha else alpha_gamma(n, m, cfg.k) / 1.5, batch_size=cfg.batch_length(n), max_buffer_size=cfg.buffer_size, buffer_score_type=cfg.score, bq_disc_factor=cfg.disc_factor, haa_theta=cfg.theta, cbs_theta=cfg.cbs_theta, bb_ratio=cfg.bb_ratio),
        runtime=Row(**{k: float(times.get(k, 0.0)) for k in ("io", "partition", "model", "postprocess", "buffer", "total")}),
        memory=Row(max_rss=max_rss_kb()),
        metrics=Row(**{k: measured.get(k) for k in ("edge_cut", "vertex_cut", "replicas", "replication_factor", "balance")}),
    )
    return spark.createDataFrame([row], RUN_LOG)


def summary(log: DataFrame) -> DataFrame:
    """What a run prints: six decimals, n/a where there is no value."""
    six = lambda c: F.coalesce(F.format_string("%.6f", c), F.lit("n/a"))
    ratio = F.when(F.col("graph.num_edges") > 0, F.col("metrics.edge_cut") / F.col("graph.num_edges"))
    return log.select(F.col("graph.filename").alias("graph"), "graph.num_nodes", "graph.num_edges", "config.k", "metrics.edge_cut", F.when(ratio.isNull(), "n/a").otherwise(six(ratio)).alias("cut_ratio"), "metrics.vertex_cut", "metrics.replicas", F.when(F.col("metrics.replication_factor").isNull(), "n/a").otherwise(six(F.col("metrics.replication_factor"))).alias("replication_factor"), F.when(F.col("metrics.balance").isNull(), "n/a").otherwise(six(F.col("metrics.balance"))).alias("balance"), six(F.col("runtime.total")).alias("total_s"), "memory.max_rss")


def run_file(spark: SparkSession, path: str, mode: str, cfg: PartitionConfig, output: str | None = None, log_folder: str | None = None, evaluate: bool = True, progress: str | None = None, log_format: str = "json") -> tuple[DataFrame, DataFrame]:
    """(assignment, log) of a graph file. ``progress`` is a folder to which a batched mode writes the blocks of each batch as soon as it is solved; the log is text (json) or binary (parquet)."""
    begun = time.perf_counter()
    edges, nodes, header = metis.read_graph(spark, path, places=True)
    edges, nodes = edges.cache(), nodes.cache()
    read = time.perf_counter()
    algorithm = registry.create(mode)
    if progress and not algorithm.progressive:
        raise ValueError(f"{mode} solves the graph in one go and has no progress to write")
    assign = algorithm.run(edges, nodes, cfg, **({"folder": progress} if progress else {})).cache()
    assign.count()
    solved = time.perf_counter()
    measured = algorithm.evaluate(assign, edges, nodes, cfg).first().asDict() if evaluate else {}
    if output:
        sinks.write_partition(assign, output, "edge_id" if mode.startswith("edge") else "id")
    end = time.perf_counter()
    log = log_row(spark, base_name(path), header["nodes"], header["edges"], cfg, {"io": read - begun, "partition": solved - read, "postprocess": end - solved, "total": end - begun}, measured)
    if log_folder:
        log.write.mode("overwrite").format(log_format).save(f"{log_folder}/{log_name(path, cfg)}")
    return assign, log


def dumps(log: DataFrame) -> str:
    return json.dumps(log.first().asDict(recursive=True))
