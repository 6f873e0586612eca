"""Edge partitioning: every edge gets a block; vertices are replicated in the blocks of their edges.

``partition`` streams a whole graph through one task; ``partition_batched`` gives the same result with memory for one batch: ids and links are relations, written by batch, and what was
seen at vertices is a table that grows by a part a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import new_folder
from ..kernel import edges as kernel
from ..operators import graph
from .config import PartitionConfig, batch_slack, edge_alpha_gamma, model_bound, refinement_weight
from .node import as_rows, whole_graph


def run_kernel(g, cfg: PartitionConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = len(g.dst) // 2
    bound = lambda weight, assigned, in_batch, p: model_bound(weight, cfg.k, batch_slack(cfg, m, assigned, in_batch, p))
    return kernel.partition(g, cfg, bound, lambda split, left, spent: edge_alpha_gamma(g.n, m, cfg.k, cfg, split, left, spent), cfg.batch_length(g.n), lambda left: refinement_weight(cfg, left, m))


def partition(edges: DataFrame, nodes: DataFrame, cfg: PartitionConfig) -> DataFrame:
    """edge_id, u, v, block. Ids are in stream order and depend on the batch size, which belongs to the result; weights are not used."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, block = run_kernel(whole_graph(rows), cfg)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(u)), pa.int64()), pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(block, pa.int32())], ["edge_id", "u", "v", "block"])

    return as_rows(edges, nodes).mapInArrow(run, "edge_id long, u long, v long, block int")


SEEN = "node_id long, block int, edge_id long, pass int, batch int"
SOLVED = "edge_id long, u long, v long, block int, pass int, batch int"


def partition_batched(edges: DataFrame, nodes: DataFrame, cfg: PartitionConfig, folder: str | None = None) -> DataFrame:
    """As ``partition``, batch by batch; the driver holds a row of counts and k loads a batch, and the loop.

    ``folder`` (a new one in the shared folder by default) gets the edges and links by batch, each read once a pass, ``solved``, which grows by a part a batch as the run goes on,
    and ``seen``: a row per vertex and batch (last block) or per vertex, block and batch.  A batch looks its smaller ends up in it.
    """
    if cfg.passes > 1 and not cfg.minimal_mode:
        raise ValueError("several passes over edges need minimal_mode")
    spark, n, k = nodes.sparkSession, nodes.count(), cfg.k
    folder = folder or new_folder(spark, "edge-batches")
    ids = graph.edge_ids(graph.placed_pairs(edges) if "place" in edges.columns else graph.once(edges), cfg.batch_length(n))
    ids.repartition("batch").write.mode("overwrite").partitionBy("batch").parquet(f"{folder}/edges")
    places = ", pu int, pv int" if "place" in edges.columns else ""
    ids = spark.read.schema(f"edge_id long, u long, v long, owner long{places}, batch int").parquet(f"{folder}/edges")
    graph.split_links(ids).repartition("batch").write.mode("overwrite").partitionBy("batch").parquet(f"{folder}/links")
    links = spark.read.schema("lo long, hi long, weight long, batch int").parquet(f"{folder}/links")
    ends = ids.select("batch", F.explode(F.array("u", "v")).alias("x")).groupBy("batch", "x").count().groupBy("batch").agg(F.count_if(F.col("count") <= 2).alias("low"))
    linked = links.groupBy("batch").agg(F.sum("weight").alias("links"))
    counts = ids.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("edge_id").alias("first")).join(ends, "batch").join(linked, "batch", "left").orderBy("batch").collect()  # one row per batch
    m, loads = sum(r["n"] for r in counts), {}
    bound = lambda weight, assigned, in_batch, p: model_bound(weight, k, batch_slack(cfg, m, assigned, in_batch, p))
    for p in range(cfg.passes):
        done = spent = 0
        for r in counts:
            i, size, first = r["batch"], r["n"], r["first"]
            own = ids.where(f"batch = {i}").select("edge_id", "u", "v")
            none = F.lit(None).cast("long")
            start = spark.read.schema(SOLVED).parquet(f"{folder}/solved").where(f"pass = {p - 1} and batch = {i}").select("edge_id", F.col("block").cast("long").alias("start")) if p else None
            rows = (own.join(start, "edge_id") if p else own.withColumn("start", none)).select((F.col("edge_id") - first).alias("a"), F.col("u").alias("b"), F.col("v").alias("c"), "start")
            rows = rows.unionByName(links.where(f"batch = {i}").select((F.col("lo") - first).alias("a"), (F.col("hi") - first).alias("b"), (-F.col("weight")).alias("c"), none.alias("start")))
            if loads:
                seen = spark.read.schema(SEEN).parquet(f"{folder}/seen").where(f"pass >= {p - 1}").join(own.select(F.col("u").alias("node_id")).distinct(), "node_id", "left_semi")
                if cfg.minimal_mode:
                    seen = seen.groupBy("node_id").agg(F.max_by("block", F.struct("pass", "edge_id")).alias("block"))
                else:
                    seen = seen.select("node_id", "block").distinct()
                    if cfg.past_subset_size >= 0:
                        drawn = Window.partitionBy("node_id").orderBy(graph.sample_order(F.col("node_id"), F.col("block"), cfg.seed), "block")
                        seen = seen.withColumn("r", F.row_number().over(drawn)).where(F.col("r") <= cfg.past_subset_size)
                past = own.join(seen.select(F.col("node_id").alias("u"), "block"), "u").select((F.col("edge_id") - first).alias("a"), F.col("block").cast("long").alias("b"), none.alias("c"), none.alias("start"))
                rows = rows.unionByName(past)
            load = sum((loads[j] for j in loads if j != i), np.zeros(k, np.int64))
            spent += size + 2 * r["low"]
            ag = edge_alpha_gamma(n, m, k, cfg, r["links"] or 0, m - done, spent)

            def solve(batches: Iterator[pa.RecordBatch], size=size, first=first, load=load, p=p, ag=ag) -> Iterator[pa.RecordBatch]:
                t = pa.Table.from_batches([x for x in batches if x.num_rows])
                a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
                past = t.column("c").is_null().to_numpy()  # edges hold v, links their weight below 0, what was seen nothing
                c = t.column("c").fill_null(0).to_numpy()
                link = c < 0
                edge = ~past & ~link
                at = np.flatnonzero(edge)[np.argsort(a[edge])]
                begin = t.column("start").to_numpy()[at].astype(np.int64).tolist() if p else None
                order = np.lexsort((b[past], a[past]))
                out = kernel.solve(size, a[link], b[link], -c[link], a[past][order], b[past][order], load, cfg, bound, p, ag, refinement_weight(cfg, m - int(load.sum()), m), first, begin)
                yield pa.RecordBatch.from_arrays([pa.array(a[at] + first), pa.array(b[at]), pa.array(c[at]), pa.array(out, pa.int32())], ["edge_id", "u", "v", "block"])

            part = f"{folder}/solved/pass={p}/batch={i}"
            rows.repartition(1).mapInArrow(solve, "edge_id long, u long, v long, block int").write.mode("overwrite").parquet(part)
            solved = spark.read.parquet(part)
            new = graph.replicas(solved, minimal=False).select("node_id", F.explode("blocks").alias("block"), F.lit(0).cast("long").alias("edge_id"))
            if cfg.minimal_mode:
                new = solved.select("edge_id", "block", F.explode(F.array("u", "v")).alias("node_id")).groupBy("node_id").agg(F.max(F.struct("edge_id", "block")).alias("x")).select("node_id", "x.block", "x.edge_id")
            new.write.mode("overwrite").parquet(f"{folder}/seen/pass={p}/batch={i}")
            loads[i] = np.zeros(k, np.int64)
            for x in solved.groupBy("block").count().collect():  # k rows
                loads[i][x["block"]] = x["count"]
            done += size
    if not loads:
        return spark.createDataFrame([], "edge_id long, u long, v long, block int")
    return spark.read.schema(SOLVED).parquet(f"{folder}/solved").where(f"pass = {cfg.passes - 1}").select("edge_id", "u", "v", "block")
