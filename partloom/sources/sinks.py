"""Writers: one value per line in id order, METIS and hypergraph text, appended progress, snapshots.

A file of lines is written as range-sorted parts, whose numbers follow the order; ``single`` asks for one part, which one task writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _lines(df: DataFrame, order: list[str], path: str, single: bool = False) -> None:
    out = df.orderBy(*order)
    (out.coalesce(1) if single else out).select("value").write.mode("overwrite").text(path)


def write_partition(assign: DataFrame, path: str, id_col: str = "id", single: bool = False) -> None:
    """Block per line in order of ids."""
    _lines(assign.select(F.col(id_col).alias("i"), F.col("block").cast("string").alias("value")), ["i"], path, single)


def write_vector(values: DataFrame, path: str, single: bool = False) -> None:
    _lines(values.select(F.col("id").alias("i"), F.col("value").cast("string").alias("value")), ["i"], path, single)


def append_batch(assign: DataFrame, path: str, batch: int) -> None:
    """Blocks of one batch in a folder of its own; writing it again replaces it, so retries are safe."""
    assign.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def add_snapshot(assign: DataFrame, path: str, snapshot: int) -> None:
    assign.write.mode("overwrite").parquet(f"{path}/snapshot={snapshot}")


def write_metis(edges: DataFrame, nodes: DataFrame, path: str, weighted: bool = False) -> None:
    """Header and 1-based adjacency; with weights fmt 11."""
    n, m = nodes.count(), edges.count() // 2
    item = F.concat_ws(" ", (F.col("dst") + 1).cast("string"), F.col("weight").cast("string")) if weighted else (F.col("dst") + 1).cast("string")
    nbrs = edges.groupBy(F.col("src").alias("node_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("dst", item.alias("s")))), lambda x: x["s"]), " ").alias("s"))
    body = nodes.join(nbrs, "node_id", "left").select(F.col("node_id").alias("i"), (F.concat_ws(" ", F.col("weight").cast("string"), "s") if weighted else F.coalesce("s", F.lit(""))).alias("value"))
    head = nodes.sparkSession.createDataFrame([(-1, f"{n} {m} 11" if weighted else f"{n} {m}")], "i long, value string")
    _lines(head.unionByName(body), ["i"], path)


def write_hmetis(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """Each undirected edge as a hyperedge of two pins, 1-based."""
    once = edges.where("src > dst")
    head = nodes.sparkSession.createDataFrame([(-1, -1, f"{once.count()} {nodes.count()}")], "a long, b long, value string")
    body = once.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.concat_ws(" ", (F.col("src") + 1).cast("string"), (F.col("dst") + 1).cast("string")).alias("value"))
    _lines(head.unionByName(body), ["a", "b"], path)


def write_matrix_partition(assign: DataFrame, rows: int, cols: int, path: str) -> None:
    """Of a matrix graph's partition: nonzeros, inputs (columns) and outputs (rows), a file each."""
    for name, low, high in (("inputs", 0, cols), ("outputs", cols, cols + rows), ("nonzeros", cols + rows, None)):
        part = assign.where(F.col("id") >= low)
        write_partition(part if high is None else part.where(F.col("id") < high), f"{path}/{name}")
