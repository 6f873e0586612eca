"""Binary compressed adjacency as a data source: three 64-bit numbers (version, vertices, arcs), n + 1 byte offsets, then 0-based targets."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADER = 24


def _open(path: str):
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(name)


def read_header(path: str) -> dict:
    with _open(path) as f:
        _, n, arcs = struct.unpack("<3Q", f.read(HEADER))
    return {"nodes": n, "edges": arcs // 2, "fmt": 0, "binary": True}


class NodeRange(InputPartition):
    def __init__(self, lo: int, hi: int):
        super().__init__((lo, hi))
        self.lo, self.hi = lo, hi


class BinaryGraphReader(DataSourceReader):
    """Each partition is a range of vertices: it reads their offsets, then their targets, nothing else."""

    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("rows", 1 << 20))
        self.lo, self.hi = int(options.get("from", 0)), options.get("to")

    def partitions(self) -> list[NodeRange]:
        n = read_header(self.path)["nodes"]
        hi = min(n, int(self.hi)) if self.hi is not None else n
        return [NodeRange(a, min(hi, a + self.step)) for a in range(self.lo, hi, self.step)]

    def read(self, partition: NodeRange) -> Iterator[pa.RecordBatch]:
        lo, hi = partition.lo, partition.hi
        with _open(self.path) as f:
            f.seek(HEADER + 8 * lo)
            at = np.frombuffer(f.read(8 * (hi - lo + 1)), "<u8").astype(np.int64)
            f.seek(int(at[0]))
            targets = np.frombuffer(f.read(int(at[-1] - at[0])), "<u8").astype(np.int64)
        offsets = pa.array(((at - at[0]) // 8).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), pa.ListArray.from_arrays(offsets, pa.array(targets))], ["node_id", "targets"])


class BinaryGraphSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "binary_graph"

    def schema(self) -> str:
        return "node_id bigint, targets array<bigint>"

    def reader(self, schema) -> DataSourceReader:
        return BinaryGraphReader(self.options)


def read_adjacency(spark: SparkSession, path: str, lo: int = 0, hi: int | None = None, rows: int = 1 << 20) -> DataFrame:
    """node_id, targets; only the vertices in [lo, hi) are read."""
    spark.dataSource.register(BinaryGraphSource)
    reader = spark.read.format("binary_graph").option("path", path).option("from", lo).option("rows", rows)
    return (reader if hi is None else reader.option("to", hi)).load()


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    adj = read_adjacency(spark, path)
    edges = adj.select(F.col("node_id").alias("src"), F.explode("targets").alias("dst")).withColumn("weight", F.lit(1).cast("long"))
    return edges, adj.select("node_id", F.lit(1).cast("long").alias("weight"))


def write_graph(path: str, adjacency: list[list[int]]) -> None:
    """A small graph in this format (fixtures)."""
    n, arcs = len(adjacency), sum(map(len, adjacency))
    sizes = np.cumsum([0, *map(len, adjacency)])
    with open(path, "wb") as f:
        f.write(struct.pack("<3Q", 3, n, arcs))
        f.write((HEADER + 8 * (n + 1) + 8 * sizes).astype("<u8").tobytes())
        f.write(np.array([t for x in adjacency for t in x], "<u8").tobytes())
