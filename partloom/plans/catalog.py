"""Registered queries of the graph engine, and their SQL on the same tables.

Graphs: PS parts and suppliers, weighted by size and by nation, CP customers and parts, SS suppliers that share more parts than an average pair does. Partitions: id mod 4 unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import settle
from ..operators import connectivity, graph, metrics, ratings, scoring
from ..sources import tables
from . import edge, node
from .config import PartitionConfig, capacity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K = 4

PS = """uedges AS (SELECT l_partkey AS u, (SELECT count(*) FROM part) + l_suppkey AS v, count(*) AS w FROM lineitem GROUP BY 1, 2),
nodes AS (SELECT p_partkey AS node_id, p_size::BIGINT AS c FROM part UNION ALL SELECT (SELECT count(*) FROM part) + s_suppkey, s_nationkey + 1 FROM supplier),
edges AS (SELECT u AS src, v AS dst, w FROM uedges UNION ALL SELECT v, u, w FROM uedges),
ab AS (SELECT src, dst, w, src % 4 AS own, dst % 4 AS other FROM edges),
deg AS (SELECT n.node_id, count(e.src) AS d, coalesce(sum(e.w), 0) AS wd FROM nodes n LEFT JOIN edges e ON e.src = n.node_id GROUP BY 1),
eid AS (SELECT u, v, floor(v / 512.0)::INT AS batch, row_number() OVER (ORDER BY floor(v / 512.0), CASE WHEN floor(u / 512.0) = floor(v / 512.0) THEN u ELSE v END, CASE WHEN floor(u / 512.0) = floor(v / 512.0) THEN v ELSE u END) - 1 AS edge_id FROM uedges),
ep AS (SELECT u, v, edge_id, floor(edge_id * 4.0 / (SELECT count(*) FROM uedges))::INT AS block FROM eid)"""


def _fnv_sql(x: str) -> str:
    h = "2166136261::BIGINT"
    for i in range(8):
        h = f"((xor({h}, (({x})::BIGINT >> {8 * i}) & 255) * 16777619) & 4294967295)"
    return h


def query(sql: str | None = None, prelude: str = PS):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {prelude} {sql}" if prelude else sql
        return f

    return keep


class _Graph:
    def __init__(self, spark: SparkSession, sf_dir: str, kind=tables.part_supplier):
        self.uedges, self.nodes = kind(spark, sf_dir)
        self.edges = graph.symmetrize(self.uedges)
        self.assign = graph.assign_blocks(self.nodes, F.pmod("node_id", F.lit(K)))


def _chunked(g: _Graph, batch: int = 512) -> DataFrame:
    m = g.uedges.count()
    return graph.edge_ids(g.uedges, batch).withColumn("block", F.floor(F.col("edge_id") * float(K) / m).cast("int"))


# -- quality ------------------------------------------------------------------------------------------------------
@query("SELECT (sum(CASE WHEN own <> other THEN w ELSE 0 END) // 2)::BIGINT AS edge_cut FROM ab")
def edge_cut(spark, sf):
    g = _Graph(spark, sf)
    return metrics.edge_cut(g.edges, g.assign)


@query("SELECT (sum(CASE WHEN own <> other THEN 1 ELSE 0 END) // 2)::BIGINT AS edge_cut FROM ab")
def edge_cut_count(spark, sf):
    g = _Graph(spark, sf)
    return metrics.edge_cut(g.edges, g.assign, weighted=False)


@query("SELECT round(sum(CASE WHEN own <> other THEN 1 ELSE 0 END) / count(*), 6) AS cut_ratio FROM ab")
def cut_ratio(spark, sf):
    g = _Graph(spark, sf)
    return metrics.cut_ratio(g.edges, g.assign)


@query("SELECT coalesce(sum(CASE WHEN own = 1 AND other = 2 THEN w END), 0)::BIGINT AS cut FROM ab")
def pairwise_cut(spark, sf):
    g = _Graph(spark, sf)
    return metrics.pairwise_cut(g.edges, g.assign, 1, 2)


@query("SELECT own::INT AS block, sum(w)::BIGINT AS cut FROM ab WHERE own <> other GROUP BY 1")
def block_cut(spark, sf):
    g = _Graph(spark, sf)
    return metrics.block_cut(g.edges, g.assign)


@query("SELECT max(c) / ceil(sum(c) / 4.0) AS balance FROM (SELECT sum(c) AS c FROM nodes GROUP BY node_id % 4)")
def balance(spark, sf):
    g = _Graph(spark, sf)
    return metrics.balance(g.assign, g.nodes, K)


@query("SELECT max(c) / ceil(sum(c) / 4.0) AS balance FROM (SELECT count(*) AS c FROM ab GROUP BY own)")
def balance_edges(spark, sf):
    g = _Graph(spark, sf)
    return metrics.balance_edges(g.edges, g.assign, K)


_VOLUME = "vol AS (SELECT own, count(*) AS volume FROM (SELECT DISTINCT src, own, other FROM ab WHERE own <> other) GROUP BY 1), allv AS (SELECT b::INT AS block, coalesce(volume, 0)::BIGINT AS volume FROM range(4) t(b) LEFT JOIN vol ON own = b)"


@query("SELECT block, volume FROM allv", f"{PS}, {_VOLUME}")
def communication_volume(spark, sf):
    g = _Graph(spark, sf)
    return metrics.communication_volume(g.edges, g.assign, K)


@query("SELECT max(volume) AS max_volume, min(volume) AS min_volume, sum(volume)::BIGINT AS total_volume FROM allv", f"{PS}, {_VOLUME}")
def communication_summary(spark, sf):
    g = _Graph(spark, sf)
    return metrics.communication_summary(g.edges, g.assign, K)


@query("SELECT count(DISTINCT src) AS boundary_nodes FROM ab WHERE own <> other")
def boundary_nodes(spark, sf):
    g = _Graph(spark, sf)
    return metrics.boundary_nodes(g.edges, g.assign)


@query("SELECT DISTINCT src AS node_id, own::INT AS block FROM ab WHERE own <> other AND own IN (0, 1) AND other IN (0, 1)")
def boundary_around_blocks(spark, sf):
    g = _Graph(spark, sf)
    return graph.boundary(g.edges, g.assign, (0, 1))


@query("SELECT own::INT AS lhs, other::INT AS rhs, sum(w)::BIGINT AS weight FROM ab WHERE own < other GROUP BY 1, 2")
def quotient_graph(spark, sf):
    g = _Graph(spark, sf)
    return graph.quotient_graph(g.edges, g.assign)


@query("SELECT DISTINCT own::INT AS block, other::INT AS neighbour FROM ab WHERE own <> other")
def quotient_neighbours(spark, sf):
    g = _Graph(spark, sf)
    return graph.quotient_neighbours(g.edges, g.assign)


@query("SELECT (node_id % 4)::INT AS block, sum(c)::BIGINT AS load, count(*) AS n_nodes FROM nodes GROUP BY 1")
def block_loads(spark, sf):
    g = _Graph(spark, sf)
    return graph.block_table(g.assign, g.nodes, K)


@query("SELECT sum(c)::BIGINT AS separator_weight FROM nodes WHERE node_id % 4 = 3")
def separator_weight(spark, sf):
    g = _Graph(spark, sf)
    return metrics.separator_weight(g.assign, g.nodes, 3)


@query("SELECT max(CASE WHEN b <> 3 THEN c END) / ceil(sum(c) / 3.0) AS balance FROM (SELECT node_id % 4 AS b, sum(c) AS c FROM nodes GROUP BY 1)")
def separator_balance(spark, sf):
    g = _Graph(spark, sf)
    return metrics.separator_balance(g.assign, g.nodes, K, 3)


@query("SELECT trunc(((SELECT sum(0.01 * c * sqrt(c)) FROM (SELECT sum(c) AS c FROM nodes GROUP BY node_id % 4)) - (SELECT sum(w) FROM ab WHERE own = other)) / 2)::BIGINT AS objective")
def fennel_objective(spark, sf):
    g = _Graph(spark, sf)
    return metrics.fennel_objective(g.edges, g.nodes, g.assign, K, 0.01)


@query("SELECT count(DISTINCT node_id % 4) = 4 AS every_block_used FROM nodes")
def has_all_blocks(spark, sf):
    g = _Graph(spark, sf)
    return metrics.has_all_blocks(g.assign, K)


@query("""SELECT sum(CASE WHEN nb > 1 THEN 1 ELSE 0 END)::BIGINT AS vertex_cut, sum(nb - 1)::BIGINT AS replicas, round(sum(nb) / (SELECT count(*) FROM nodes), 9) AS replication_factor,
 (SELECT max(c) / ceil(sum(c) / 4.0) FROM (SELECT count(*) AS c FROM ep GROUP BY block)) AS balance FROM (SELECT n, count(*) AS nb FROM (SELECT u AS n, block FROM ep UNION SELECT v, block FROM ep) GROUP BY n)""")
def edge_partition_metrics(spark, sf):
    g = _Graph(spark, sf)
    return metrics.edge_partition_metrics(_chunked(g), g.nodes.count(), K).withColumn("replication_factor", F.round("replication_factor", 9))


# -- relations ----------------------------------------------------------------------------------------------------
@query("SELECT node_id, d AS degree, wd::BIGINT AS weighted_degree FROM deg")
def degrees(spark, sf):
    g = _Graph(spark, sf)
    return graph.degrees(g.edges, g.nodes)


@query("SELECT max(wd)::BIGINT AS max_weighted_degree FROM deg")
def max_weighted_degree(spark, sf):
    g = _Graph(spark, sf)
    return graph.max_weighted_degree(g.edges, g.nodes)


@query("SELECT src AS node_id, string_agg(dst || ':' || w, ' ' ORDER BY dst) AS nbrs FROM edges GROUP BY 1")
def adjacency(spark, sf):
    g = _Graph(spark, sf)
    return graph.adjacency(g.edges, g.nodes).where("size(nbrs) > 0").select("node_id", F.array_join(F.transform("nbrs", lambda x: F.concat_ws(":", x["dst"].cast("string"), x["w"].cast("string"))), " ").alias("nbrs"))


@query("SELECT floor(src / 512.0)::INT AS batch, CASE WHEN floor(dst / 512.0) > floor(src / 512.0) THEN 'ghost' WHEN floor(dst / 512.0) < floor(src / 512.0) THEN 'quotient' ELSE 'local' END AS kind, count(*) AS arcs FROM edges GROUP BY 1, 2")
def edge_classes(spark, sf):
    g = _Graph(spark, sf)
    return graph.classify(g.edges, 512).groupBy("batch", "kind").agg(F.count(F.lit(1)).alias("arcs"))


@query("""SELECT (src - lo)::BIGINT AS src, (dst - lo)::BIGINT AS dst, w::BIGINT AS weight FROM edges, win WHERE src >= lo AND dst >= lo AND dst < src
 UNION ALL SELECT src - lo, (-1 - dst % 4)::BIGINT, sum(w)::BIGINT FROM edges, win WHERE src >= lo AND dst < lo GROUP BY 1, 2""", PS + ", win AS (SELECT greatest(0, count(*) - 512) AS lo FROM nodes)")
def batch_model(spark, sf):
    """The last 512 vertices, which hold parts and suppliers."""
    g = _Graph(spark, sf)
    n = g.nodes.count()
    return node.batch_models(g.edges, g.assign, max(0, n - 512), n, False)


@query("SELECT edge_id, u, v, batch FROM eid")
def edge_ids(spark, sf):
    return graph.edge_ids(_Graph(spark, sf).uedges, 512).select("edge_id", "u", "v", "batch")


@query("""SELECT batch, least(edge_id, nx) AS lo, greatest(edge_id, nx) AS hi, count(*) AS weight FROM (
 SELECT batch, edge_id, coalesce(lead(edge_id) OVER w, first_value(edge_id) OVER w) AS nx, count(*) OVER (PARTITION BY batch, x) AS d, row_number() OVER w AS i
 FROM (SELECT batch, edge_id, u AS x, v AS o FROM eid UNION ALL SELECT batch, edge_id, v, u FROM eid) WINDOW w AS (PARTITION BY batch, x ORDER BY o)) WHERE d > 2 OR (d = 2 AND i = 1) GROUP BY 1, 2, 3""")
def split_links(spark, sf):
    return graph.split_links(graph.edge_ids(_Graph(spark, sf).uedges, 512))


@query("SELECT sum(d)::BIGINT AS split_nodes, (3 * sum(d) - 2 * sum(CASE WHEN d <= 2 THEN 1 ELSE 0 END))::BIGINT AS split_edges FROM deg WHERE d > 0")
def split_sizes(spark, sf):
    return graph.split_sizes(_Graph(spark, sf).edges)


@query("SELECT n AS node_id, string_agg(block::VARCHAR, ',' ORDER BY block) AS blocks FROM (SELECT u AS n, block FROM ep UNION SELECT v, block FROM ep) GROUP BY n")
def replicas_full(spark, sf):
    return graph.replicas(_chunked(_Graph(spark, sf))).select("node_id", F.array_join(F.transform("blocks", lambda b: b.cast("string")), ",").alias("blocks"))


@query("SELECT n AS node_id, arg_max(block, edge_id) AS block FROM (SELECT u AS n, block, edge_id FROM ep UNION ALL SELECT v, block, edge_id FROM ep) GROUP BY n")
def replicas_minimal(spark, sf):
    return graph.replicas(_chunked(_Graph(spark, sf)), minimal=True)


@query("SELECT e.edge_id, r.block FROM eid e JOIN (SELECT u AS n, block FROM ep UNION SELECT v, block FROM ep) r ON r.n = least(e.u, e.v)")
def past_blocks(spark, sf):
    e = _chunked(_Graph(spark, sf))
    return graph.past_blocks(e, graph.replicas(e))


@query(f"""SELECT edge_id, block FROM (SELECT e.edge_id, r.block, row_number() OVER (PARTITION BY e.edge_id ORDER BY {_fnv_sql("3 * 1099511627776 + r.n * 4096 + r.block")}, r.block) AS i
 FROM eid e JOIN (SELECT u AS n, block FROM ep UNION SELECT v, block FROM ep) r ON r.n = least(e.u, e.v)) WHERE i <= 2""")
def past_blocks_sampled(spark, sf):
    e = _chunked(_Graph(spark, sf))
    return graph.past_blocks(e, graph.replicas(e), sample=2, seed=3)


@query("SELECT (src // 7)::BIGINT AS src, (dst // 7)::BIGINT AS dst, sum(w)::BIGINT AS weight FROM edges WHERE src // 7 <> dst // 7 GROUP BY 1, 2")
def contraction(spark, sf):
    g = _Graph(spark, sf)
    return graph.contract(g.edges, g.nodes, g.nodes.select("node_id", F.floor(F.col("node_id") / 7).alias("cluster")))[0]


@query("SELECT (node_id // 7)::BIGINT AS node_id, sum(c)::BIGINT AS weight FROM nodes GROUP BY 1")
def contraction_nodes(spark, sf):
    g = _Graph(spark, sf)
    return graph.contract(g.edges, g.nodes, g.nodes.select("node_id", F.floor(F.col("node_id") / 7).alias("cluster")))[1]


@query("SELECT node_id, (dense_rank() OVER (ORDER BY f) - 1)::INT AS cluster FROM (SELECT node_id, min(node_id) OVER (PARTITION BY node_id % 5, node_id % 3) AS f FROM nodes)")
def ensemble_clustering(spark, sf):
    n = _Graph(spark, sf).nodes
    return graph.ensemble(n.select("node_id", F.pmod("node_id", F.lit(5)).alias("cluster")), n.select("node_id", F.pmod("node_id", F.lit(3)).alias("cluster")))


@query("SELECT node_id AS id, ((node_id // 7) % 4)::INT AS block FROM nodes")
def coarse_projection(spark, sf):
    n = _Graph(spark, sf).nodes
    mapping = n.select("node_id", F.floor(F.col("node_id") / 7).alias("cluster"))
    return graph.project(mapping.select(F.col("cluster").alias("id"), F.pmod("cluster", F.lit(K)).cast("int").alias("block")).distinct(), mapping)


@query("""SELECT a.i AS src, b.i AS dst, w::BIGINT AS weight FROM edges JOIN (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS i FROM nodes WHERE node_id % 4 IN (0, 1)) a ON a.node_id = src
 JOIN (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS i FROM nodes WHERE node_id % 4 IN (0, 1)) b ON b.node_id = dst""")
def block_pair_subgraph(spark, sf):
    g = _Graph(spark, sf)
    return graph.extract_blocks(g.edges, g.assign, [0, 1])[0]


@query(f"SELECT node_id, {_fnv_sql('node_id')} AS hash FROM nodes")
def fnv_hash(spark, sf):
    return _Graph(spark, sf).nodes.select("node_id", graph.fnv32(F.col("node_id")).alias("hash"))


@query("""SELECT u::BIGINT AS u, v::BIGINT AS v, 1::BIGINT AS weight FROM (SELECT j AS u, x AS v FROM e UNION ALL SELECT c + i, x FROM e)""",
       "m AS (SELECT DISTINCT l_suppkey AS i, l_partkey AS j FROM lineitem), c AS (SELECT (SELECT count(*) FROM part) AS c, (SELECT count(*) FROM supplier) AS r), e AS (SELECT i, j, c.c AS c, c.c + c.r + row_number() OVER (ORDER BY i, j) - 1 AS x FROM m, c)")
def matrix_graph(spark, sf):
    r = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    m = r("lineitem").select((F.col("l_suppkey") + 1).alias("i"), (F.col("l_partkey") + 1).alias("j")).distinct()
    return graph.matrix_graph(m, r("supplier").count(), r("part").count())[0]


# -- ratings ------------------------------------------------------------------------------------------------------
_RATING_SQL = {
    "expansion_star": "w / (cu * cv)", "expansion_star_2": "w * w / (cu * cv)", "inner_outer": "w / (su + sv - w)", "addx": "1 / (du + dv)", "multx": "1 / sqrt(du * dv)", "max": "1 / greatest(du, dv)", "log": "CASE WHEN du * dv = 1 THEN 'inf'::DOUBLE ELSE 1 / ln(du * dv) END",
    "pseudogeom": f"w * (1 / sqrt(cu) + 1 / sqrt(cv)) * (0.6::DOUBLE + 0.4::DOUBLE * {_fnv_sql('src * 4294967296 + dst')} / 4294967296)",
    "r1": "1 / (du * dv)", "r2": "1 / (du * dv * cu * cv)", "r3": "1 / (du + dv + cu + cv)", "r4": "du * dv / (cu * cv)", "r5": "(du + dv) / (cu + cv)", "r6": "1 / ((du + dv) * (cu + cv))", "r7": "w / (du * dv * cu * cv)", "r8": "w * du * dv / (cu * cv)", "realweight": "w",
}
_ENDS = "ends AS (SELECT d.*, n.c FROM deg d JOIN nodes n USING (node_id)), pairs AS (SELECT src, dst, w::DOUBLE AS w, a.d::DOUBLE AS du, b.d::DOUBLE AS dv, a.wd::DOUBLE AS su, b.wd::DOUBLE AS sv, a.c::DOUBLE AS cu, b.c::DOUBLE AS cv FROM edges JOIN ends a ON a.node_id = src JOIN ends b ON b.node_id = dst WHERE src < dst)"


def _ratings(name: str, kinds: tuple[str, ...]) -> None:
    """Ratings are symmetric, so each pair is shown once."""

    def run(spark, sf):
        g = _Graph(spark, sf)
        return ratings.rate(g.edges, g.nodes, kinds).where("src < dst").select("src", "dst", *[F.round(k, 9).alias(k) for k in kinds])

    run.__name__ = name
    query("SELECT src, dst, " + ", ".join(f"round(({_RATING_SQL[k]})::DOUBLE, 9) AS {k}" for k in kinds) + " FROM pairs", f"{PS}, {_ENDS}")(run)


_ratings("ratings_by_weight", ("expansion_star", "expansion_star_2", "inner_outer", "pseudogeom", "realweight", "r7", "r8"))
_ratings("ratings_by_degree", ("addx", "multx", "max", "log", "r1", "r2", "r3", "r4", "r5", "r6"))


def _algdist_sql() -> str:
    start = ", ".join(f"{_fnv_sql(f'{s} * 1099511627776 + node_id')} / 4294967296.0::DOUBLE - 0.5::DOUBLE AS x{s}" for s in range(3))
    steps = [f"x_0 AS MATERIALIZED (SELECT node_id, {start} FROM nodes)"]
    for i in range(7):
        mean = ", ".join(f"sum(x{s} * w) / sum(w) AS m{s}" for s in range(3))
        both = ", ".join(f"0.5::DOUBLE * x.x{s} + 0.5::DOUBLE * coalesce(m.m{s}, x.x{s}) AS x{s}" for s in range(3))
        steps.append(f"x_{i + 1} AS MATERIALIZED (SELECT x.node_id, {both} FROM x_{i} x LEFT JOIN (SELECT src, {mean} FROM edges JOIN x_{i} ON x_{i}.node_id = dst GROUP BY 1) m ON m.src = x.node_id)")
    return ", ".join(steps)


@query("SELECT src, dst, round(w * w / (cu * cv * ((abs(a.x0 - b.x0) + abs(a.x1 - b.x1) + abs(a.x2 - b.x2)) / 7 + 0.0001::DOUBLE)), 3) AS rating FROM pairs JOIN x_7 a ON a.node_id = src JOIN x_7 b ON b.node_id = dst", f"{PS}, {_ENDS}, {_algdist_sql()}")
def rating_algebraic_distance(spark, sf):
    g = _Graph(spark, sf)
    return ratings.rate(g.edges, g.nodes, ("expansion_star_2_algdist",)).where("src < dst").select("src", "dst", F.round("expansion_star_2_algdist", 3).alias("rating"))


# -- scores -------------------------------------------------------------------------------------------------------
def _snapshot(g: _Graph) -> DataFrame:
    """Vertices of id mod 3 = 0 are assigned (block id mod 4), of 1 queued, of 2 unseen."""
    r = F.pmod("node_id", F.lit(3))
    return g.nodes.where(r < 2).select(F.col("node_id").alias("id"), F.when(r == 0, F.pmod("node_id", F.lit(K)).cast("int")).alias("block"), F.when(r == 0, "assigned").otherwise("queued").alias("status"))


def _blocks(g: _Graph) -> DataFrame:
    """Loads of the snapshot; the heaviest block is full."""
    loads = graph.block_table(_snapshot(g).where("block is not null").select("id", "block"), g.nodes, K)
    return loads.join(loads.agg(F.max("load").alias("cap"))).select("block", "load", "cap")  # one row on the right


_SNAP = PS + ", s AS (SELECT src AS node_id, count(*)::DOUBLE AS d, sum(CASE WHEN dst % 3 = 0 THEN 1 ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN dst % 3 = 1 THEN 1 ELSE 0 END)::DOUBLE AS b FROM edges GROUP BY 1), mx AS (SELECT src AS node_id, max(c)::DOUBLE AS mx FROM (SELECT src, dst % 4, count(*) AS c FROM edges WHERE dst % 3 = 0 GROUP BY 1, 2) GROUP BY 1)"
_LOADS = PS + ", l AS (SELECT (node_id % 4)::INT AS b, sum(c)::BIGINT AS ld FROM nodes WHERE node_id % 3 = 0 GROUP BY 1), room AS (SELECT * FROM l WHERE ld < (SELECT max(ld) FROM l))"
_SCORE_SQL = {"anr": "a / d", "haa": "pow(least(d / 10000, 1), 2) + 0.75 * (1 - least(d / 10000, 1)) * a / d", "nss": "(a + b) / d", "cbs": "least(d / 10000, 1) + 2 * a / d", "cbsq": "least(pow(d / 10000, 2), 1) + 2 * a / d", "cms": "coalesce(mx, 0) / d"}


@query("SELECT node_id, " + ", ".join(f"round({x}, 9) AS {k}" for k, x in _SCORE_SQL.items()) + " FROM s LEFT JOIN mx USING (node_id)", _SNAP)
def buffer_scores(spark, sf):
    g, out = _Graph(spark, sf), None
    for kind in _SCORE_SQL:
        one = scoring.buffer_scores(g.edges, g.nodes, _snapshot(g), PartitionConfig(score=kind)).where("degree > 0").select("node_id", F.round("score", 9).alias(kind))
        out = one if out is None else out.join(one, "node_id")
    return out


@query("SELECT src, (dst % 4)::INT AS block, count(*)::DOUBLE AS gain FROM edges WHERE dst % 3 = 0 GROUP BY 1, 2")
def neighbour_blocks(spark, sf):
    g = _Graph(spark, sf)
    return scoring.neighbour_blocks(g.edges, _snapshot(g))


@query("""SELECT node_id, arg_max(block, (sc, -block))::INT AS block FROM (SELECT n.node_id, l.b AS block, coalesce(g.c, 0) - 0.9 * sqrt(l.ld) AS sc FROM nodes n CROSS JOIN room l
 LEFT JOIN (SELECT src, dst % 4 AS b, count(*) AS c FROM edges WHERE dst % 3 = 0 GROUP BY 1, 2) g ON g.src = n.node_id AND g.b = l.b) GROUP BY 1""", _LOADS)
def best_blocks(spark, sf):
    g = _Graph(spark, sf)
    return scoring.best_blocks(g.nodes, scoring.neighbour_blocks(g.edges, _snapshot(g)), _blocks(g), 0.9)


@query("SELECT arg_min(b, (ld, b))::INT AS block FROM room", _LOADS)
def lightest_block(spark, sf):
    return scoring.lightest_block(_blocks(_Graph(spark, sf)))


@query("SELECT node_id AS id, (node_id % 4)::INT AS block, (sum(c) OVER (PARTITION BY node_id % 4 ORDER BY node_id))::BIGINT AS load FROM nodes")
def running_load(spark, sf):
    g = _Graph(spark, sf)
    return scoring.running_load(g.assign, g.nodes)


# -- partitions ---------------------------------------------------------------------------------------------------
#: Suppliers, an edge where two share more parts than an average pair.
SS = """pr AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), pw AS MATERIALIZED (SELECT a.s AS u, b.s AS v, count(*) AS w FROM pr a JOIN pr b ON a.p = b.p AND a.s < b.s GROUP BY 1, 2),
ue AS MATERIALIZED (SELECT u, v, w FROM pw WHERE w > (SELECT avg(w) FROM pw))"""


def _one_pass_sql(score: str) -> str:
    """One vertex after the other by a recursive query: the block of highest score with room, the lighter, then the lower on a tie. g: neighbours in block t.b, l: its load."""
    return f"""RECURSIVE {SS}, n AS (SELECT count(*) AS n FROM supplier), par AS (SELECT n, 1.5 * (SELECT count(*) FROM ue) * 2 / pow(n, 1.5) AS ag, ceil(1.03 * n / 4.0) AS cap FROM n),
nb AS (SELECT v AS id, list(u) AS ns FROM ue GROUP BY v),
run(i, blk, ld) AS (SELECT 0, []::INT[], [0, 0, 0, 0] UNION ALL
 SELECT i + 1, list_append(blk, b), list_transform(ld, lambda x, j: x + CASE WHEN j = b + 1 THEN 1 ELSE 0 END) FROM (
  SELECT i, blk, ld, coalesce((SELECT arg_max(q.b, ({score}, -q.b)) FROM (SELECT t.b AS b, ld[t.b + 1] AS l, len(list_filter(coalesce(ns, []), lambda z: blk[z + 1] = t.b)) AS g FROM range(4) t(b)) q, par WHERE q.l < par.cap), 0)::INT AS b
  FROM run LEFT JOIN nb ON nb.id = run.i WHERE i < (SELECT n FROM n)))"""


_RUN = "SELECT (j - 1)::BIGINT AS id, blk[j] AS block FROM (SELECT blk FROM run ORDER BY i DESC LIMIT 1), range(1, (SELECT n + 1 FROM n)) t(j)"


def _suppliers(spark, sf) -> tuple[DataFrame, DataFrame]:
    u, nodes = tables.supplier_supplier(spark, sf)
    return graph.symmetrize(u), nodes


@query(_RUN, _one_pass_sql("q.g - par.ag * sqrt(q.l)"))
def direct_fennel(spark, sf):
    edges, nodes = _suppliers(spark, sf)
    return node.partition(edges.withColumn("weight", F.lit(1).cast("long")), nodes, PartitionConfig(k=K, batch_size=1))


@query(_RUN, _one_pass_sql("q.g, -q.l"))
def baseline_greedy(spark, sf):
    return node.baseline(*_suppliers(spark, sf), "greedy", K)


@query(_RUN, _one_pass_sql("q.g * (1 - q.l / par.cap), -q.l"))
def baseline_ldg(spark, sf):
    return node.baseline(*_suppliers(spark, sf), "ldg", K)


@query(f"SELECT node_id AS id, ({_fnv_sql('node_id')} % 4)::INT AS hashing, floor(node_id * 4 / (SELECT count(*) FROM nodes))::INT AS chunking, (node_id % 4)::INT AS balanced FROM nodes")
def baselines(spark, sf):
    g = _Graph(spark, sf)
    hashing, chunking, balanced = (node.baseline(g.edges, g.nodes, kind, K).withColumnRenamed("block", kind) for kind in ("hashing", "chunking", "balanced"))
    return hashing.join(chunking, "id").join(balanced, "id")


#: Plain and buffered partitions by name. No SQL gives their blocks, so a query shows what every one of them must hold; tests hold the kernels against hand-made cases and each other.
PLAIN = {
    "batches": (node.partition, {"batch_size": 512}), "restream": (node.partition, {"batch_size": 512, "passes": 2}),
    "model_ghosts": (node.partition, {"batch_size": 512, "model_ghosts": True}), "path_matching": (node.partition, {"batch_size": 512, "matcher": "paths", "improve_initial": True}), "bisected": (node.partition_bisected, {}),
}
BUFFERED = {s: {"score": s} for s in ("haa", "anr", "cms", "nss", "cbs", "cbsq")} | {"pulled": {"pull_neighbours": True}, "at_once": {"place_surrounded": True}, "soft_ghosts": {"ghosts": True}, "topless": {"batch_size": 1}}
EDGE_MODES = {"minimal": {}, "full": {"minimal_mode": False}, "sampled": {"minimal_mode": False, "past_subset_size": 2}, "restream": {"passes": 2}}


def _held(g: _Graph, runs: dict[str, tuple[Callable, dict]], unit: bool) -> DataFrame:
    """For each run: its vertices, how many are different, blocks used, whether every load is within the capacity and the cut is below that of hashed blocks.

    Runs in one task read the same packed graph. A vertex's blocks of all runs are one row, and one number beside an edge, so that edges meet their ends once for all runs.
    """
    edges = g.edges.withColumn("weight", F.lit(1).cast("long")) if unit else g.edges
    nodes = settle(g.nodes.withColumn("weight", F.lit(1).cast("long")) if unit else g.nodes)
    whole = (node.partition, node.partition_bisected)
    if packed := any(run in whole for run, _ in runs.values()):
        pieces = settle(node.as_pieces(edges, nodes))
    else:
        edges = settle(edges)
    names, assigned = ["hash", *runs], node.baseline(edges, nodes, "hashing", K).select(F.lit(0).alias("run"), "id", "block")
    for i, (run, options) in enumerate(runs.values(), 1):
        one = run(edges, nodes, PartitionConfig(k=K, **options), *([pieces] if packed and run in whole else []))
        assigned = assigned.unionByName(one.select(F.lit(i).alias("run"), "id", "block"))
    mine = [F.col("run") == i for i in range(len(names))]
    blocks = settle(assigned.repartition("id").groupBy("id").agg(*[F.max(F.when(m, F.col("block"))).alias(f"b{i}") for i, m in enumerate(mine)], *[F.count_if(m).alias(f"c{i}") for i, m in enumerate(mine)]))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("run"), F.col(f"b{i}").alias("block"), F.col(f"c{i}").alias("rows")) for i, name in enumerate(names) if i])).alias("e")
    placed = blocks.join(nodes.select(F.col("node_id").alias("id"), "weight"), "id").select("weight", each).select("weight", "e.*").where("rows > 0")
    loads = placed.groupBy("run", "block").agg(F.sum(F.col("weight") * F.col("rows")).alias("load"), F.sum("rows").alias("n"), F.count(F.lit(1)).alias("different"))
    # The blocks of all runs as the digits of a number; K stands for none.
    digit = lambda c, i: F.expr(f"{c} div {(K + 1) ** i} % {K + 1}")
    code = sum((F.coalesce(F.col(f"b{i}"), F.lit(K)).cast("long") * (K + 1) ** i for i in range(1, len(names))), F.coalesce(F.col("b0"), F.lit(K)).cast("long"))
    ends = lambda a, b: blocks.select(F.col("id").alias(a), code.alias(b))
    both = edges.where("src < dst").join(ends("src", "own"), "src").select("dst", "weight", "own").join(ends("dst", "other"), "dst")
    crosses = lambda i: (digit("own", i) != digit("other", i)) & (digit("own", i) < K) & (digit("other", i) < K)
    cut = both.agg(*[F.coalesce(F.sum(F.when(crosses(i), F.col("weight")).otherwise(0)), F.lit(0)).alias(f"cut{i}") for i in range(len(names))])  # one row
    cut = cut.select(F.col("cut0").alias("hashed"), F.explode(F.array(*[F.struct(F.lit(name).alias("run"), F.col(f"cut{i}").alias("cut")) for i, name in enumerate(names) if i])).alias("e")).select("hashed", "e.*")
    total = nodes.agg(F.sum("weight")).first()[0]
    return loads.groupBy("run").agg(F.sum("n").alias("vertices"), F.sum("different").alias("different"), F.count(F.lit(1)).alias("blocks"), (F.max("load") <= capacity(total, K, 3.0, True)).alias("within_capacity")).join(cut, "run").select("run", "vertices", "different", "blocks", "within_capacity", (F.col("cut") < F.col("hashed")).alias("below_hashed"))


def _held_sql(names) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"SELECT unnest([{listed}]) AS run, n AS vertices, n AS different, 4::BIGINT AS blocks, true AS within_capacity, true AS below_hashed FROM (SELECT count(*) AS n FROM nodes)"


@query(_held_sql(PLAIN))
def node_partitions(spark, sf):
    return _held(_Graph(spark, sf), PLAIN, True)


@query(_held_sql(["weighted", "weighted_restream"]))
def node_partitions_weighted(spark, sf):
    return _held(_Graph(spark, sf), {"weighted": (node.partition, {"batch_size": 512}), "weighted_restream": (node.partition, {"batch_size": 512, "passes": 2})}, False)


@query(_held_sql(BUFFERED))
def node_buffered(spark, sf):
    return _held(_Graph(spark, sf), {k: (node.partition, {"batch_size": 128, "buffer_size": 256} | v) for k, v in BUFFERED.items()}, True)


@query(_held_sql(["distributed"]))
def node_distributed(spark, sf):
    return _held(_Graph(spark, sf), {"distributed": (lambda e, n, c: node.partition_distributed(e, n, c, rounds=4), {})}, True)


@query("SELECT unnest(['balance_edges', 'model_ghosts', 'restream']) AS run, n AS vertices, n AS same FROM (SELECT count(*) AS n FROM nodes)")
def node_batches_joined(spark, sf):
    """Vertices to which the batch-wise form gives the block of the whole-graph stream."""
    g, out = _Graph(spark, sf), None
    edges, nodes = settle(g.edges), settle(g.nodes)
    for name, options in {"balance_edges": {"balance_edges": True}, "model_ghosts": {"model_ghosts": True}, "restream": {"passes": 2}}.items():
        cfg = PartitionConfig(k=K, batch_size=1024, **options)
        both = node.partition(edges, nodes, cfg).join(node.partition_batched(edges, nodes, cfg).withColumnRenamed("block", "joined"), "id")
        one = both.agg(F.lit(name).alias("run"), F.count(F.lit(1)).alias("vertices"), F.count_if(F.col("block") == F.col("joined")).alias("same"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT edge_id, u, v, true AS same_batched FROM eid")
def edge_batches_joined(spark, sf):
    """Every edge with its place in the stream, and whether the batch-wise form gives it the block of the whole-graph stream."""
    g = _Graph(spark, sf)
    edges, cfg = settle(g.edges), PartitionConfig(k=K, batch_size=512)
    joined = edge.partition_batched(edges, g.nodes, cfg).select("edge_id", F.col("block").alias("joined"))
    return edge.partition(edges, g.nodes, cfg).join(joined, "edge_id").select("edge_id", "u", "v", (F.col("block") == F.col("joined")).alias("same_batched"))


@query("SELECT unnest(['minimal', 'full', 'sampled', 'restream']) AS run, m AS edges, m AS in_order, 4::BIGINT AS blocks, true AS balanced FROM (SELECT count(*) AS m FROM eid)")
def edge_partitions(spark, sf):
    """For each mode: its edges, how many of them are at their place of the stream, blocks used, and whether the heaviest holds less than 1.3 times its share."""
    g, solved = _Graph(spark, sf), None
    edges, nodes = settle(g.edges), settle(g.nodes)
    for name, options in EDGE_MODES.items():
        one = edge.partition(edges, nodes, PartitionConfig(k=K, batch_size=512, **options)).withColumn("run", F.lit(name))
        solved = one if solved is None else solved.unionByName(one)
    ids = graph.edge_ids(g.uedges, 512).select("edge_id", F.col("u").alias("x"), F.col("v").alias("y"))
    per = settle(solved).join(ids, "edge_id").groupBy("run", "block").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("u") == F.col("x")) & (F.col("v") == F.col("y"))).alias("placed"))
    return per.groupBy("run").agg(F.sum("n").alias("edges"), F.sum("placed").alias("in_order"), F.count(F.lit(1)).alias("blocks"), (F.max("n") < 1.3 * F.sum("n") / K).alias("balanced"))


# -- connectivity -------------------------------------------------------------------------------------------------
_COMP = """RECURSIVE ue AS (SELECT DISTINCT s_suppkey AS u, (s_suppkey * 7 + 3) % n AS v FROM supplier, (SELECT count(*) AS n FROM supplier) WHERE s_suppkey % 4 < 2 AND s_suppkey <> (s_suppkey * 7 + 3) % n),
sy AS (SELECT u, v FROM ue UNION SELECT v, u FROM ue), r(x, y) AS (SELECT u, u FROM sy UNION SELECT r.x, sy.v FROM r JOIN sy ON sy.u = r.y)"""


@query("SELECT x AS node_id, min(y) AS component FROM r GROUP BY x", _COMP)
def components(spark, sf):
    """Every other pair of suppliers points at another one."""
    supplier = spark.read.parquet(f"{sf}/supplier.parquet")
    s, n = F.col("s_suppkey"), F.pmod(F.col("s_suppkey") * 7 + 3, F.lit(supplier.count()))
    return connectivity.components(supplier.where((s % 4 < 2) & (s != n)).select(s.alias("u"), n.alias("v")))


_REACH = """RECURSIVE a AS (SELECT s_suppkey AS u, s_suppkey // 3 AS v FROM supplier UNION SELECT s_suppkey, (2 * s_suppkey + 1) % n FROM supplier, (SELECT count(*) AS n FROM supplier) WHERE s_suppkey % 3 = 0),
ns AS (SELECT u AS x FROM a UNION SELECT v FROM a), r(x, y) AS (SELECT x, x FROM ns UNION SELECT r.x, a.v FROM r JOIN a ON a.u = r.y)"""


@query("SELECT p.x AS node_id, min(p.y) AS component FROM r p JOIN r q ON p.x = q.y AND p.y = q.x GROUP BY p.x", _REACH)
def strong_components(spark, sf):
    """Suppliers point up a tree, every third one elsewhere too."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey")
    up = s.select(F.col("s_suppkey").alias("src"), F.floor(F.col("s_suppkey") / 3).alias("dst"))
    return connectivity.strong_components(up.union(s.where("s_suppkey % 3 = 0").select("s_suppkey", F.pmod(2 * F.col("s_suppkey") + 1, F.lit(s.count())))), s.select(F.col("s_suppkey").alias("node_id")))


@query("SELECT (c + CASE WHEN parts <> 30 THEN total * parts ELSE 0 END)::BIGINT AS edge_cut FROM (SELECT sum(CASE WHEN u % 30 <> v % 30 THEN w ELSE 0 END) AS c, sum(w) AS total FROM ue), (SELECT count(DISTINCT root) AS parts FROM (SELECT x, min(y) AS root FROM r GROUP BY x))",
       f"RECURSIVE {SS}, inner_ AS (SELECT u, v FROM ue WHERE u % 30 = v % 30 UNION SELECT v, u FROM ue WHERE u % 30 = v % 30), r(x, y) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT r.x, i.v FROM r JOIN inner_ i ON i.u = r.y)")
def penalised_cut(spark, sf):
    """Thirty blocks of suppliers, most of them not connected."""
    edges, nodes = _suppliers(spark, sf)
    return metrics.penalised_cut(edges, graph.assign_blocks(nodes, F.pmod("node_id", F.lit(30))), 30)


@query("SELECT n_nationkey + 5 AS node_id, 1 AS layer FROM nation UNION ALL SELECT r_regionkey, 0 FROM region UNION ALL SELECT 30 + s_suppkey, 2 FROM supplier UNION ALL SELECT 30 + (SELECT count(*) FROM supplier) + c_custkey, 2 FROM customer", "")
def topological_layers(spark, sf):
    """Regions, their nations, and the suppliers and customers of these."""
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    shift = 30 + read("supplier").count()
    nation = read("nation").select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + 5).cast("long").alias("dst"))
    arcs = nation.union(read("supplier").select((F.col("s_nationkey") + 5).cast("long"), F.col("s_suppkey") + 30)).union(read("customer").select((F.col("c_nationkey") + 5).cast("long"), F.col("c_custkey") + shift))
    return connectivity.topological_layers(arcs, read("region").select(F.col("r_regionkey").cast("long").alias("node_id")).union(arcs.select("dst")))


@query("SELECT u::BIGINT AS u, v::BIGINT AS v, w::BIGINT AS weight FROM ue2", "ue2 AS (SELECT o_custkey AS u, (SELECT count(*) FROM customer) + l_partkey AS v, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)")
def customer_part_edges(spark, sf):
    u, _ = tables.customer_part(spark, sf)
    return u.select(F.col("u").cast("long"), F.col("v").cast("long"), "weight")


@query("SELECT date_trunc('day', ts) AS start, user_id, event_type, count(*) AS weight FROM events GROUP BY 1, 2, 3", "")
def windowed_event_edges(spark, sf):
    from ..streaming.stream import windowed_edges

    return windowed_edges(spark.read.parquet(f"{sf}/events.parquet"))
