"""Relational forms of the graph: both directions, degrees, batches, edge ids, subgraphs, contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def symmetrize(uedges: DataFrame) -> DataFrame:
    """src, dst, weight in both directions, from one pass over the edges."""
    both = F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))).alias("e")
    return uedges.select(both, "weight").select("e.src", "e.dst", "weight")


def merge_parallel(edges: DataFrame) -> DataFrame:
    """Parallel arcs added up; a self-loop is an error."""
    checked = edges.where(F.when(F.col("src") == F.col("dst"), F.raise_error(F.lit("the graph has a self-loop")).isNull()).otherwise(F.lit(True)))
    return checked.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def once(edges: DataFrame) -> DataFrame:
    """Each undirected pair once: u < v."""
    return edges.where("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v"), "weight")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, degree, weighted_degree of every vertex, isolated ones 0."""
    d = edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted_degree"))
    return nodes.select("node_id").join(d, "node_id", "left").na.fill(0, ["degree", "weighted_degree"])


def max_weighted_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return degrees(edges, nodes).agg(F.max("weighted_degree").alias("max_weighted_degree"))


def adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, weight, nbrs: arrays of (dst, w) in ascending order; isolated vertices have an empty one."""
    nbrs = edges.groupBy(F.col("src").alias("node_id")).agg(F.sort_array(F.collect_list(F.struct("dst", F.col("weight").alias("w")))).alias("nbrs"))
    empty = F.array().cast("array<struct<dst:bigint,w:bigint>>")
    return nodes.select("node_id", "weight").join(nbrs, "node_id", "left").withColumn("nbrs", F.coalesce("nbrs", empty))


def from_adjacency(adj: DataFrame, places: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of adjacency rows; with ``places`` each arc has its place in its source's list."""
    e = adj.select(F.col("node_id").alias("src"), F.posexplode("nbrs").alias("place", "x")).select("src", F.col("x.dst").alias("dst"), F.col("x.w").alias("weight"), *(["place"] if places else []))
    return e, adj.select("node_id", "weight")


def placed_pairs(edges: DataFrame) -> DataFrame:
    """Each undirected pair once, u < v, with pu, the place of v in u's list, and pv, that of u in v's."""
    u, v = F.least("src", "dst"), F.greatest("src", "dst")
    return edges.groupBy(u.alias("u"), v.alias("v")).agg(F.max(F.when(F.col("src") < F.col("dst"), F.col("weight"))).alias("weight"), F.max(F.when(F.col("src") < F.col("dst"), F.col("place"))).alias("pu"), F.max(F.when(F.col("src") > F.col("dst"), F.col("place"))).alias("pv"))


def batch_of(node: Column, batch_size: int) -> Column:
    return F.floor(node / batch_size).cast("int")


def classify(edges: DataFrame, batch_size: int) -> DataFrame:
    """Each arc as its source's batch sees it: local, quotient (to an earlier batch) or ghost (to a later one)."""
    b, o = batch_of(F.col("src"), batch_size), batch_of(F.col("dst"), batch_size)
    return edges.select("*", b.alias("batch"), F.when(o > b, "ghost").when(o < b, "quotient").otherwise("local").alias("kind"))


def classify_assigned(edges: DataFrame, assign: DataFrame, batch: DataFrame) -> DataFrame:
    """As ``classify`` for batches of any vertices: local if the target is in the same batch, quotient if it is assigned, else deferred."""
    b = batch.select(F.col("node_id").alias("dst"), F.col("batch").alias("dst_batch"))
    a = assign.select(F.col("id").alias("dst"), "block", "status")
    e = edges.join(batch.select(F.col("node_id").alias("src"), "batch"), "src").join(b, "dst", "left").join(a, "dst", "left")
    kind = F.when(F.col("batch") == F.col("dst_batch"), "local").when(F.col("status").isin("assigned", "ghost"), "quotient").otherwise("deferred")
    return e.select("src", "dst", "weight", "batch", "block", kind.alias("kind"))


def assign_blocks(nodes: DataFrame, block: Column) -> DataFrame:
    return nodes.select(F.col("node_id").alias("id"), block.cast("int").alias("block"))


def fnv32(value: Column) -> Column:
    """32-bit hash of the value's eight little-endian bytes, by arithmetic of built-ins."""
    h = F.lit(2166136261).cast("long")  # fixed values of the hash: basis here, prime below
    for i in range(8):
        byte = F.shiftrightunsigned(value.cast("long"), 8 * i).bitwiseAND(F.lit(255).cast("long"))
        h = (h.bitwiseXOR(byte) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long"))
    return h


def with_blocks(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """edges with own (block of src) and other (block of dst). Whether a side is broadcast is left to its measured size."""
    a = assign.select(F.col("id").alias("src"), F.col("block").alias("own"))
    b = assign.select(F.col("id").alias("dst"), F.col("block").alias("other"))
    return edges.join(a, "src").join(b, "dst")


def quotient_graph(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """lhs < rhs and the weight of the cut between them."""
    return with_blocks(edges, assign).where("own < other").groupBy(F.col("own").alias("lhs"), F.col("other").alias("rhs")).agg(F.sum("weight").alias("weight"))


def quotient_neighbours(edges: DataFrame, assign: DataFrame) -> DataFrame:
    return with_blocks(edges, assign).where("own <> other").select(F.col("own").alias("block"), F.col("other").alias("neighbour")).distinct()


def boundary(edges: DataFrame, assign: DataFrame, blocks: tuple[int, int] | None = None) -> DataFrame:
    """node_id and block of vertices with a neighbour in another block (of the given pair, if given)."""
    cut = with_blocks(edges, assign).where("own <> other")
    if blocks:
        cut = cut.where(F.col("own").isin(*blocks) & F.col("other").isin(*blocks))
    return cut.select(F.col("src").alias("node_id"), F.col("own").alias("block")).distinct()


def block_table(assign: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """block, load, n_nodes for every block, empty ones too."""
    every = assign.sparkSession.range(k).select(F.col("id").cast("int").alias("block"))
    w = nodes.select(F.col("node_id").alias("id"), "weight")
    loads = assign.join(w, "id").groupBy("block").agg(F.sum("weight").alias("load"), F.count(F.lit(1)).alias("n_nodes"))
    return every.join(loads, "block", "left").na.fill(0, ["load", "n_nodes"])


def contract(edges: DataFrame, nodes: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of the graph whose vertices are the clusters of mapping(node_id, cluster): weights add up, inner edges go."""
    a = mapping.select(F.col("node_id").alias("src"), F.col("cluster").alias("a"))
    b = mapping.select(F.col("node_id").alias("dst"), F.col("cluster").alias("b"))
    e = edges.join(a, "src").join(b, "dst").where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight"))
    return e, nodes.join(mapping, "node_id").groupBy(F.col("cluster").alias("node_id")).agg(F.sum("weight").alias("weight"))


RANGE = 65536


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with ``name``, their dense rank by a distinct whole-number key, without one window over all of them: ranks within ranges of the key, then the ranges' counts before."""
    ranged = rows.withColumn("__range", F.floor(F.col(key) / RANGE))
    counts = ranged.groupBy("__range").count()
    before = counts.select("__range", F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # one row per range
    own = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return ranged.withColumn("__own", own).join(before, "__range").withColumn(name, F.col("__own") + F.col("__before")).drop("__range", "__own", "__before")


def compact(mapping: DataFrame) -> DataFrame:
    """mapping with clusters renumbered densely by their least member."""
    first = mapping.groupBy("cluster").agg(F.min("node_id").alias("first"))
    return mapping.join(numbered(first, "first", "new_cluster").select("cluster", "new_cluster"), "cluster").select("node_id", F.col("new_cluster").cast("int").alias("cluster"))


def ensemble(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlay of two clusterings: together where both put them together."""
    both = a.join(b.select("node_id", F.col("cluster").alias("other")), "node_id")
    least = both.groupBy("cluster", "other").agg(F.min("node_id").alias("first"))
    return compact(both.join(least, ["cluster", "other"]).select("node_id", F.col("first").alias("cluster")))


def project(assign: DataFrame, mapping: DataFrame) -> DataFrame:
    """Blocks of coarse vertices carried to the vertices of their clusters."""
    return mapping.join(assign.select(F.col("id").alias("cluster"), "block"), "cluster").select(F.col("node_id").alias("id"), "block")


def project_separator(assign: DataFrame, mapping: DataFrame, separator: int = 2) -> tuple[DataFrame, DataFrame]:
    """(blocks of all vertices, the vertices of the separator) after projection to the finer graph."""
    fine = project(assign, mapping)
    return fine, fine.where(F.col("block") == separator).select(F.col("id").alias("node_id"))


def extract_blocks(edges: DataFrame, assign: DataFrame, blocks: list[int]) -> tuple[DataFrame, DataFrame]:
    """(edges, mapping): the subgraph of the given blocks, renumbered densely in id order; mapping has node_id, new_id, block."""
    inside = assign.where(F.col("block").isin(*blocks)).select(F.col("id").alias("node_id"), "block")
    mapping = numbered(inside, "node_id", "new_id").select("node_id", "new_id", "block")
    a = mapping.select(F.col("node_id").alias("src"), F.col("new_id").alias("a"))
    b = mapping.select(F.col("node_id").alias("dst"), F.col("new_id").alias("b"))
    return edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), mapping


def replicas(edge_blocks: DataFrame, minimal: bool = False) -> DataFrame:
    """Blocks seen at each vertex of an edge partition (edge_id, u, v, block): the set, or the last by edge id."""
    ends = edge_blocks.select("edge_id", "block", F.explode(F.array("u", "v")).alias("node_id"))
    if minimal:
        return ends.groupBy("node_id").agg(F.max_by("block", "edge_id").alias("block"))
    return ends.groupBy("node_id").agg(F.sort_array(F.collect_set("block")).alias("blocks"))


def edge_ids(uedges: DataFrame, batch_size: int) -> DataFrame:
    """edge_id, u, v, batch, owner: ids in stream order, 0-based; pu and pv too if ``uedges`` has them (see ``placed_pairs``).

    An edge belongs to the later batch of its ends; its owner there is the end that lies in that batch, the smaller if both do.  Order is (batch, owner, place of the other
    end in the owner's list, by default ascending).  The ranking is by batch (bounded by the batch's edges), then shifted by the edges of earlier batches, one row per batch.
    """
    bu, bv = batch_of(F.col("u"), batch_size), batch_of(F.col("v"), batch_size)
    owner, places = F.when(bu == bv, F.col("u")).otherwise(F.col("v")), ["pu", "pv"] if "pu" in uedges.columns else []
    at, to = ("pu", "pv") if places else ("v", "u")
    e = uedges.select("u", "v", *places, bv.alias("batch"), owner.alias("owner"), F.when(bu == bv, F.col(at)).otherwise(F.col(to)).alias("at"))
    before = e.groupBy("batch").count().select("batch", F.coalesce(F.sum("count").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("batch").orderBy("owner", "at")) - 1
    return e.withColumn("local", local).join(before, "batch").select((F.col("before") + F.col("local")).alias("edge_id"), "u", "v", "batch", "owner", *places)


def split_links(ids: DataFrame) -> DataFrame:
    """Links of the contracted split graph, batch by batch: around every vertex each edge is linked with its successor, cyclically; parallel links add up.

    lo < hi are edge ids; a vertex of degree 2 gives one link of weight 1.
    """
    # Around an end in the batch the order is its own list's, around an earlier one that of the stream.
    at_u, at_v = (F.when(F.col("owner") == F.col("u"), F.col("pu")).otherwise(F.col("v")), F.col("pv")) if "pu" in ids.columns else (F.col("v"), F.col("u"))
    both = F.explode(F.array(F.struct(F.col("u").alias("x"), at_u.cast("long").alias("at")), F.struct(F.col("v").alias("x"), at_v.cast("long").alias("at")))).alias("end")
    ends = ids.select("batch", "edge_id", both).select("batch", "edge_id", "end.x", "end.at")
    w = Window.partitionBy("batch", "x").orderBy("at")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ring = ends.select("batch", "edge_id", F.lead("edge_id").over(w).alias("next"), F.first("edge_id").over(whole).alias("first"), F.count(F.lit(1)).over(whole).alias("d"), F.row_number().over(w).alias("i"))
    links = ring.where((F.col("d") > 2) | ((F.col("d") == 2) & (F.col("i") == 1))).select("batch", "edge_id", F.coalesce("next", "first").alias("next"))
    return links.groupBy("batch", F.least("edge_id", "next").alias("lo"), F.greatest("edge_id", "next").alias("hi")).agg(F.count(F.lit(1)).alias("weight"))


def split_sizes(edges: DataFrame) -> DataFrame:
    """Split vertices (arcs) and edges of the split graph: 3 arcs less 2 for each vertex of degree 1 or 2."""
    d = edges.groupBy("src").count()
    return d.agg(F.sum("count").alias("split_nodes"), (3 * F.sum("count") - 2 * F.sum(F.when(F.col("count") <= 2, 1).otherwise(0))).alias("split_edges"))


def sample_order(node: Column, block: Column, seed: int) -> Column:
    """The seeded hash by which a vertex's blocks are drawn."""
    return fnv32(seed * (1 << 40) + node * 4096 + block)


def past_blocks(ids: DataFrame, replica_sets: DataFrame, sample: int | None = None, seed: int = 0) -> DataFrame:
    """edge_id, block: blocks seen before at the edge's smaller end; at most ``sample`` of them, by seeded hash order, if given (a sampling operator)."""
    e = ids.select("edge_id", F.least("u", "v").alias("node_id")).join(replica_sets.select("node_id", F.explode("blocks").alias("block")), "node_id")
    if sample is not None:
        w = Window.partitionBy("edge_id").orderBy(sample_order(F.col("node_id"), F.col("block"), seed), "block")
        e = e.withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample)
    return e.select("edge_id", "block")


def matrix_graph(entries: DataFrame, rows: int, cols: int) -> tuple[DataFrame, DataFrame]:
    """Graph of a sparse matrix (i, j 1-based): every entry, column and row is a vertex; an entry is linked with its column and its row.

    Ids: columns from 0, rows after them, entries after those in (i, j) order.
    """
    w = Window.partitionBy("i").orderBy("j")
    per_row = entries.groupBy("i").count().withColumn("range", F.floor(F.col("i") / RANGE))
    ranges = per_row.groupBy("range").agg(F.sum("count").alias("n")).select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # one row per range of rows
    own = F.coalesce(F.sum("count").over(Window.partitionBy("range").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = per_row.withColumn("own", own).join(ranges, "range").select("i", (F.col("base") + F.col("own")).alias("before"))
    e = entries.withColumn("own", F.row_number().over(w) - 1).join(before, "i").select((F.lit(rows + cols) + F.col("before") + F.col("own")).alias("x"), (F.col("j") - 1).alias("c"), (F.lit(cols) + F.col("i") - 1).alias("r"))
    links = e.select(F.explode(F.array(F.struct(F.col("c").alias("u"), F.col("x").alias("v")), F.struct(F.col("r").alias("u"), F.col("x").alias("v")))).alias("l")).select(F.col("l.u").cast("long").alias("u"), F.col("l.v").cast("long").alias("v"), F.lit(1).cast("long").alias("weight"))
    nodes = entries.sparkSession.range(rows + cols).select(F.col("id").alias("node_id")).unionAll(e.select(F.col("x").cast("long").alias("node_id")))
    return links, nodes.withColumn("weight", F.lit(1).cast("long"))


def degree_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Vertices by ascending degree, then id."""
    return degrees(edges, nodes).select("node_id", "degree").orderBy("degree", "node_id")


def shuffled(nodes: DataFrame, seed: int) -> DataFrame:
    """Vertices in a seeded random order that doesn't depend on partitioning."""
    return nodes.orderBy(F.xxhash64(F.lit(seed), "node_id"), "node_id")


def circular(nodes: DataFrame, n: int, shift: int) -> DataFrame:
    """A permutation without fixed points for 0 < shift < n: position p goes to (p + shift) mod n."""
    return nodes.select("node_id", F.pmod(F.col("node_id") + shift, F.lit(n)).alias("position"))
