"""Graphs derived from relational tables: uedges(u, v, weight) with u < v, nodes(node_id, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernel import pairs


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shifted(parts: DataFrame) -> int:
    """Ids of the second kind of vertex start after those of the first (one small aggregate)."""
    return parts.count()


def part_supplier(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts and suppliers, an edge for every pair in lineitem, weight the number of its lines; a part weighs its size, a supplier its nation's number plus one."""
    part, supplier = _read(spark, sf_dir, "part"), _read(spark, sf_dir, "supplier")
    shift = _shifted(part)
    u = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("u"), (F.col("l_suppkey") + shift).alias("v")).agg(F.count(F.lit(1)).alias("weight"))
    return u, part.select(F.col("p_partkey").alias("node_id"), F.col("p_size").cast("long").alias("weight")).unionAll(supplier.select((F.col("s_suppkey") + shift).alias("node_id"), (F.col("s_nationkey") + 1).cast("long").alias("weight")))


def customer_part(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customer, part = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "part")
    shift = _shifted(customer)
    lines = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    u = lines.groupBy(F.col("o_custkey").alias("u"), (F.col("l_partkey") + shift).alias("v")).agg(F.count(F.lit(1)).alias("weight"))
    nodes = customer.select(F.col("c_custkey").alias("node_id")).unionAll(part.select((F.col("p_partkey") + shift).alias("node_id")))
    return u, nodes.withColumn("weight", F.lit(1).cast("long"))


def supplier_supplier(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers with more parts in common than an average pair that has any."""
    lines = _read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").where("l_partkey is not null and l_suppkey is not null")
    lists = lines.repartition("l_partkey").groupBy("l_partkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("s"))
    # A supplier travels with those after it in a part's list, and pairs are made and counted where they meet: shuffled one by one they fill the disk, and a table of all of a task's
    # pairs its memory. So they are counted supplier by supplier, twice, as the mean must be known.
    after = lists.select("s", F.posexplode("s").alias("i", "u")).select("u", F.slice("s", F.col("i") + 2, F.size("s")).alias("v")).where("size(v) > 0").repartition("u")
    mean = after.sortWithinPartitions("u").mapInArrow(pairs.totals, "pairs long, every long").agg(F.try_divide(F.sum("every"), F.sum("pairs")).alias("mean"))  # one row
    u = after.join(F.broadcast(mean)).sortWithinPartitions("u").mapInArrow(pairs.above, "u long, v long, weight long")
    return u, _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node_id"), F.lit(1).cast("long").alias("weight"))
