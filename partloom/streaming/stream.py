"""Structured Streaming forms of the node stream.

* ``AdjacencyStream`` is a bounded source of adjacency lines in order: an offset is a line number and its place in the file, a trigger takes ``batch`` lines from there.
* ``run_batches`` solves each micro-batch as one plain batch with what earlier epochs assigned. An epoch owns a folder that it overwrites, so a repeated epoch is harmless.
* ``one_pass`` is the one-pass assignment as a stateful operator with a single key: loads and assignments are its state. The single key is what the order of the stream means; use
  ``plans.node.partition_distributed`` where that order doesn't matter.
* ``windowed_edges`` counts arrivals of pairs by event time with a watermark, for streams of events.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..kernel import batches
from ..kernel.csr import from_arcs
from ..plans.config import PartitionConfig, alpha_gamma, capacity, refinement_weight
from ..plans.node import bounds_of


class AdjacencyReader(SimpleDataSourceStreamReader):
    """Lines of a METIS file without weights, ``batch`` at a time."""

    def __init__(self, options: dict):
        self.path, self.batch = options["path"], int(options.get("batch", 1024))

    def initialOffset(self) -> dict:
        return {"line": 0, "byte": 0}

    def _lines(self, start: dict, hi: int) -> Iterator[tuple]:
        """(line, targets, place behind it) from an offset on. Place 0 is before the header."""
        fs, name = pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        with fs.open_input_file(name) as f:
            f.seek(start["byte"])
            at, n, rest = start["byte"], start["line"] - (start["byte"] == 0), b""
            while n < hi:
                chunk = f.read(1 << 20)
                lines = (rest + chunk).split(b"\n")
                rest = lines.pop() if chunk else b""
                for line in lines if chunk else [x for x in lines if x]:
                    at += len(line) + 1
                    if line.startswith(b"%"):
                        continue
                    if n >= start["line"]:
                        yield n, [int(x) - 1 for x in line.split()], at
                    n += 1
                    if n >= hi:
                        return
                if not chunk:
                    return

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = list(self._lines(start, start["line"] + self.batch))
        return iter([r[:2] for r in rows]), {"line": start["line"] + len(rows), "byte": rows[-1][2]} if rows else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return (r[:2] for r in self._lines(start, end["line"]))

    def commit(self, end: dict) -> None:
        pass


class AdjacencyStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "adjacency_stream"

    def schema(self) -> str:
        return "node_id bigint, targets array<bigint>"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return AdjacencyReader(self.options)


def read_stream(spark: SparkSession, path: str, batch: int) -> DataFrame:
    spark.dataSource.register(AdjacencyStream)
    return spark.readStream.format("adjacency_stream").option("path", path).option("batch", batch).load()


def solve_epoch(adj: DataFrame, epoch: int, cfg: PartitionConfig, n: int, m: int, folder: str) -> None:
    """One micro-batch (node_id, targets) as one batch; earlier epochs' folders hold what is assigned. Memory of the task: the batch's arcs and k anchors."""
    spark, k = adj.sparkSession, cfg.k
    ids = adj.agg(F.min("node_id").alias("lo"), F.max("node_id").alias("hi")).first()
    if ids["lo"] is None:  # an empty epoch has a folder too
        spark.createDataFrame([], "id long, block int").write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")
        return
    lo, hi = ids["lo"], ids["hi"] + 1
    arcs = adj.select(F.col("node_id").alias("src"), F.explode("targets").alias("dst"))
    local = arcs.where((F.col("dst") >= lo) & (F.col("dst") < F.col("src"))).select((F.col("src") - lo).alias("a"), (F.col("dst") - lo).alias("b"), F.lit(1).cast("long").alias("w"))
    load = np.zeros(k, np.int64)
    if epoch:
        past = spark.read.schema("id long, block int, epoch int").parquet(folder).where(f"epoch < {epoch}")
        for r in past.groupBy("block").count().collect():  # k rows
            load[r["block"]] = r["count"]
        anchored = arcs.where(F.col("dst") < lo).join(past.select(F.col("id").alias("dst"), "block"), "dst").groupBy("src", "block").count()
        local = local.unionByName(anchored.select((F.col("src") - lo).alias("a"), (F.lit(hi - lo) + F.col("block")).cast("long").alias("b"), F.col("count").alias("w")))
    size, ag, bounds = hi - lo, alpha_gamma(n, m, k), bounds_of(n, cfg)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [x for x in rows if x.num_rows]
        a, b, w = (np.concatenate([x.column(i).to_numpy() for x in found]) if found else np.empty(0, np.int64) for i in range(3))
        weights = np.concatenate([np.ones(size, np.int64), load])
        out = batches.solve(from_arcs(size + k, a, b, w, weights), k, bounds(float(weights.sum()), int(load.sum()), size, 0), ag, cfg, lo, None, refinement_weight(cfg, n - int(load.sum()), m))[:size]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), pa.array(out, pa.int32())], ["id", "block"])

    local.repartition(1).mapInArrow(run, "id long, block int").write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")


def run_batches(spark: SparkSession, path: str, cfg: PartitionConfig, n: int, m: int, folder: str, checkpoint: str) -> DataFrame:
    """id, block after the whole file has streamed by; n and m are known from its header."""
    size = cfg.batch_length(n)
    query = read_stream(spark, path, size).writeStream.foreachBatch(lambda df, epoch: solve_epoch(df, epoch, cfg, n, m, folder)).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.parquet(folder).select("id", "block")


class OnePass(StatefulProcessor):
    """Fennel assignment of vertices as they come. State: loads (a list) and the block of every vertex."""

    def __init__(self, cfg: PartitionConfig, n: int, m: int):
        self.k, self.ag, self.cap = cfg.k, alpha_gamma(n, m, cfg.k), capacity(n, cfg.k, cfg.imbalance, True)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.loads = handle.getValueState("loads", "load array<bigint>")
        self.blocks = handle.getMapState("blocks", "id bigint", "block int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        load = list(self.loads.get()[0]) if self.loads.exists() else [0] * self.k
        pdf = pd.concat(list(rows)).sort_values("node_id")
        here = set(pdf["node_id"].tolist())
        known = {}  # each earlier neighbour is looked up once
        for t in {int(t) for v, targets in zip(pdf["node_id"], pdf["targets"], strict=True) for t in targets if t < v} - here:
            if self.blocks.containsKey((t,)):
                known[t] = self.blocks.getValue((t,))[0]
        out = []
        for v, targets in zip(pdf["node_id"].tolist(), pdf["targets"].tolist(), strict=True):
            gain = [0.0] * self.k
            for t in targets:
                if t < v and int(t) in known:
                    gain[known[int(t)]] += 1
            free = [b for b in range(self.k) if load[b] < self.cap] or [0]
            block = min(free, key=lambda b: (-(gain[b] - self.ag * math.sqrt(load[b])), b))  # noqa: B023
            load[block] += 1
            known[v] = block
            self.blocks.updateValue((v,), (block,))
            out.append((v, block))
        self.loads.update((load,))
        yield pd.DataFrame(out, columns=["id", "block"])

    def close(self) -> None:
        pass


def one_pass(adj: DataFrame, cfg: PartitionConfig, n: int, m: int) -> DataFrame:
    """Streaming (id, block) of a streaming (node_id, targets)."""
    keyed = adj.withColumn("one", F.lit(0))
    return keyed.groupBy("one").transformWithStateInPandas(OnePass(cfg, n, m), "id long, block int", "Append", "None")


def windowed_edges(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Pairs (user_id, event_type) by event-time window, with late rows dropped after the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "user_id", "event_type").agg(F.count(F.lit(1)).alias("weight")).select(F.col("w.start").alias("start"), "user_id", "event_type", "weight")
