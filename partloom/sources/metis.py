"""METIS adjacency text, coordinate matrices, partition and vector files.

Lines are numbered without a global sort: a line's place is (file, start of its split, place within the split), and counts per split, one row each, give the rest.
The parts of a folder follow each other by their part numbers, other files by name.
"""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph


def check_input(path: str) -> None:
    """A local path that isn't there is an error before any job runs; other stores report their own."""
    if not path:
        raise FileNotFoundError("no input path")
    url = urlparse(path)
    if url.scheme in ("", "file") and not os.path.exists(url.path):
        raise FileNotFoundError(path)


def numbered_lines(spark: SparkSession, path: str, comment: str | None = "%") -> DataFrame:
    """line (from 0, comments not counted), value."""
    check_input(path)
    part = F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).try_cast("bigint")
    split = F.struct(F.coalesce(part, F.lit(-1)).alias("part"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select("value", split.alias("split"), F.monotonically_increasing_id().alias("place"))
    lines = lines.withColumn("value", F.regexp_replace("value", "\r$", ""))
    if comment:
        lines = lines.where(~F.col("value").startswith(comment))
    counts = lines.groupBy("split").count()
    before = counts.select("split", F.coalesce(F.sum("count").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("split").orderBy("place")) - 1
    return lines.withColumn("own", own).join(before, "split").select((F.col("before") + F.col("own")).alias("line"), "value")


def numbers(value: Column) -> Column:
    """Runs of digits as integers; anything else separates."""
    return F.transform(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("bigint"))


def read_header(spark: SparkSession, path: str) -> dict:
    """nodes, edges, fmt and whether the file is binary (by its suffix)."""
    check_input(path)
    if path.endswith((".bin", ".parhip")):
        from .binary_graph import read_header as binary

        return binary(path)
    first = spark.read.text(path).where(~F.col("value").startswith("%")).limit(1).select(numbers(F.col("value")).alias("x")).first()
    if first is None or len(first["x"]) < 2:
        raise ValueError(f"{path} has no header of two numbers")
    x = first["x"]
    return {"nodes": x[0], "edges": x[1], "fmt": x[2] if len(x) > 2 else 0, "binary": False}


def adjacency_of(line: Column, value: Column, fmt: int) -> list[Column]:
    """node_id, weight, nbrs of a body line. Targets become 0-based; fmt 1 has edge weights, 10 vertex weights, 11 both, anything else neither."""
    x = numbers(value)
    node_weighted, edge_weighted = fmt in (10, 11), fmt in (1, 11)
    weight = F.coalesce(F.get(x, 0), F.lit(1)) if node_weighted else F.lit(1)
    rest = F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))) if node_weighted else x
    if edge_weighted:
        pairs = F.transform(F.filter(rest, lambda v, i: i % 2 == 0), lambda v, i: F.struct((v - 1).alias("dst"), F.coalesce(F.get(rest, 2 * i + 1), F.lit(1)).alias("w")))
    else:
        pairs = F.transform(rest, lambda v: F.struct((v - 1).alias("dst"), F.lit(1).cast("bigint").alias("w")))
    return [line.cast("bigint").alias("node_id"), weight.cast("bigint").alias("weight"), pairs.alias("nbrs")]


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """node_id, weight, nbrs; an empty line is an isolated vertex. Loops raise an error."""
    header = read_header(spark, path)
    body = numbered_lines(spark, path).where((F.col("line") >= 1) & (F.col("line") <= header["nodes"]))
    adj = body.select(*adjacency_of(F.col("line") - 1, F.col("value"), header["fmt"]))
    loop = F.exists("nbrs", lambda x: x["dst"] == F.col("node_id"))
    return adj.withColumn("nbrs", F.when(loop, F.raise_error(F.lit("the graph has a self-loop"))).otherwise(F.col("nbrs")))


def read_graph(spark: SparkSession, path: str, validate: bool = False, places: bool = False) -> tuple[DataFrame, DataFrame, dict]:
    """(edges, nodes, header) of a text or binary file; ``validate`` holds the counts against the header, ``places`` keeps the order of the lists of a text file (binary ones are sorted)."""
    header = read_header(spark, path)
    if header["binary"]:
        from .binary_graph import read_graph as binary

        edges, nodes = binary(spark, path)
    else:
        edges, nodes = graph.from_adjacency(read_adjacency(spark, path), places)
    if validate:
        n, m = nodes.count(), edges.count()
        if n != header["nodes"] or m != 2 * header["edges"]:
            raise ValueError(f"{path}: {n} vertices and {m} arcs, the header says {header['nodes']} and {2 * header['edges']}")
    return edges, nodes, header


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The graph of a coordinate matrix file; values are ignored."""
    lines = numbered_lines(spark, path)
    rows, cols, _ = lines.where("line = 0").select(numbers(F.col("value")).alias("x")).first()["x"][:3]
    x = F.split(F.trim("value"), r"\s+")
    entries = lines.where("line > 0 and trim(value) <> ''").select(F.get(x, 0).cast("bigint").alias("i"), F.get(x, 1).cast("bigint").alias("j"))
    return graph.matrix_graph(entries, rows, cols)


def read_partition(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(id, block) of a partition file, and k, the largest block plus one."""
    assign = numbered_lines(spark, path, None).where("trim(value) <> ''").select(F.col("line").cast("bigint").alias("id"), F.trim("value").cast("int").alias("block"))
    return assign, (assign.agg(F.max("block")).first()[0] or 0) + 1


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    return numbered_lines(spark, path, None).where("trim(value) <> ''").select(F.col("line").cast("bigint").alias("id"), F.trim("value").cast("double").alias("value"))


def from_arrays(spark: SparkSession, xadj: list[int], adjncy: list[int], vwgt: list[int] | None = None, adjwgt: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of compressed arrays; weights default to 1."""
    import pandas as pd

    n = len(xadj) - 1
    src = [v for v in range(n) for _ in range(xadj[v], xadj[v + 1])]
    edges = spark.createDataFrame(pd.DataFrame({"src": src, "dst": adjncy, "weight": adjwgt or [1] * len(adjncy)}), "src long, dst long, weight long")
    return edges, spark.createDataFrame(pd.DataFrame({"node_id": range(n), "weight": vwgt or [1] * n}), "node_id long, weight long")
