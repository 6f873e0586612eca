"""Node partitioning. ``edges`` hold both directions (src, dst, weight), ids are dense from 0.

Three ways:

* ``partition`` streams a whole graph through one task: the order of the stream is part of the result's definition, so this is exact for every mode. For graphs whose vertices fit in a task;
  arcs come packed and lie on its disk.
* ``partition_batched`` gives the same result for plain batches with memory for one batch only: arcs are written once by batch, each batch reads its own part, its model is solved in one task
  of batch + k vertices, and its blocks are appended to a table. For large graphs, as far as batches one after the other can go.
* ``partition_distributed`` is capped label propagation in supersteps: parallel throughout, capacity is kept, results differ from the stream's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import new_folder, settle
from ..kernel import batches, fennel
from ..kernel.buffer import Stream
from ..kernel.csr import LISTED, Csr, Spool, Weights, from_arcs
from ..kernel.multilevel import recursive_bisection
from ..operators import graph, scoring
from .config import PartitionConfig, alpha_gamma, batch_slack, capacity, model_bound, refinement_weight


def caps_of(total: float, cfg: PartitionConfig) -> list[int]:
    return [capacity(total, cfg.k, cfg.imbalance, p == cfg.passes - 1) for p in range(cfg.passes)]


def bounds_of(n: int, cfg: PartitionConfig):
    return lambda weight, assigned, in_batch, p: model_bound(weight, cfg.k, batch_slack(cfg, n, assigned, in_batch, p))


def run_kernel(g: Csr, cfg: PartitionConfig) -> np.ndarray:
    """Blocks of all vertices, by the mode the configuration asks for."""
    n, m = g.n, int(len(g.dst) // 2)
    if n == 0:
        return np.empty(0, np.int32)
    ag = alpha_gamma(n, m, cfg.k)
    total = n + 2 * m if cfg.balance_edges else int(g.node_w.sum())
    if cfg.balance_edges:
        g = Csr(g.indptr, g.dst, g.w, g.node_w + np.diff(g.indptr))
    weight_of = lambda remaining: refinement_weight(cfg, remaining, m)
    mode = cfg.mode()
    if mode == "buffered":
        if not g.unit():
            raise ValueError("the priority buffer takes graphs without weights")
        stream = Stream(g.rows()[0], cfg, ag, caps_of(total, cfg), bounds_of(n, cfg), weight_of)
        size = cfg.batch_length(n)
        stream.first_pass(size)
        for p in range(1, cfg.passes):
            stream.later_pass(max(2, size), p)
        return np.array(stream.block, np.int32)
    if mode == "direct":
        return fennel.direct(g.rows()[0], g.node_w.tolist(), n, cfg.k, ag, caps_of(total, cfg), cfg.sqrt_mode, cfg.use_queue, cfg.ghost_weight, cfg.restream_all)[0]
    return batches.partition(g, cfg, ag, bounds_of(n, cfg), cfg.batch_length(n), weight_of)


#: A piece of a graph: vertices and lists as arrays, and the place of the first of them in the stream. ``dst`` is ``_short``.
PIECE = {"first": "long", "at": "long", "ids": "binary", "weights": "binary", "owners": "binary", "counts": "binary", "dst": "binary", "w": "binary"}
Arcs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: Vertices that go to one packing task together; no piece holds more of them. Few, so that tasks sort about as many arcs each where lists are long.
SPAN = 128


def _short(ends: np.ndarray) -> bytes:
    """The size of a number, then steps from each end to the next, compressed: a fourth of the plain numbers for long ascending lists, and all pieces meet in one task."""
    kind = np.dtype(np.int32 if not len(ends) or ends.max() <= np.iinfo(np.int32).max else np.int64)
    return bytes([kind.itemsize]) + pa.compress(np.diff(ends, prepend=0).astype(kind).tobytes(), codec="zstd", asbytes=True)


def _long(short: bytes, m: int) -> np.ndarray:
    """The ``m`` ends that were made short."""
    return np.cumsum(np.frombuffer(pa.decompress(short[1:], short[0] * m, codec="zstd"), f"i{short[0]}"), dtype=f"i{short[0]}")


def _merged(batches_in: Iterator[pa.RecordBatch]) -> Iterator[Arcs]:
    """(src, dst, weight, dst) of sorted rows, parallel arcs summed; the last one of a batch waits for its parallels."""
    held = None
    for b in batches_in:
        if not b.num_rows:
            continue
        src, at, w = (b.column(c).to_numpy() for c in ("src", "at", "weight"))
        if held is not None:
            src, at, w = (np.concatenate(x) for x in zip(held, (src, at, w), strict=True))
        first = np.flatnonzero(np.concatenate([[True], (src[1:] != src[:-1]) | (at[1:] != at[:-1])]))
        if np.any(at[first][np.diff(np.append(first, len(src))) > 1] < 0):
            raise ValueError("vertex ids must be dense from 0")
        src, at, w = src[first], at[first], np.add.reduceat(w, first)
        held = src[-1:], at[-1:], w[-1:]
        if len(src) > 1:
            yield src[:-1], at[:-1], w[:-1], at[:-1]
    if held is not None:
        yield *held, held[1]


def _pack(rows: Iterator[Arcs]) -> Iterator[pa.RecordBatch]:
    for whole in rows:
        if np.any(whole[0] == whole[3]):
            raise ValueError("the graph has a self-loop")
        cuts = np.flatnonzero(np.diff(whole[0] // SPAN)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(whole[0])], strict=True):
            src, at, w, dst = (x[lo:hi] for x in whole)
            node = dst < 0
            owner, d, arc_w = src[~node], dst[~node], w[~node]
            run = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
            plain = lambda x: np.ascontiguousarray(x).tobytes()
            cells = plain(src[node]), plain(w[node]), plain(owner[run]), plain(np.diff(np.append(run, len(owner)))), _short(d), plain(arc_w if np.any(arc_w != 1) else arc_w[:0])
            yield pa.RecordBatch.from_arrays([pa.array(src[:1]), pa.array(at[:1]), *(pa.array([x], pa.binary()) for x in cells)], list(PIECE))


def as_pieces(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Arcs and vertices, sorted and packed by many tasks. Lists ascend, parallel arcs are summed; a further column place keeps the order of lists and what they hold."""
    merge = "place" not in edges.columns
    arcs = edges.select(F.col("src").cast("long").alias("src"), F.col("dst" if merge else "place").cast("long").alias("at"), F.col("weight").cast("long").alias("weight"), *([] if merge else [F.col("dst").cast("long").alias("dst")]))
    none = F.lit(-1).cast("long")
    rows = arcs.unionByName(nodes.select(F.col("node_id").cast("long").alias("src"), none.alias("at"), F.col("weight").cast("long").alias("weight"), *([] if merge else [none.alias("dst")])))

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = (tuple(b.column(c).to_numpy() for c in ("src", "at", "weight", "dst")) for b in batches_in if b.num_rows)
        yield from _pack(_merged(batches_in) if merge else whole)

    return rows.repartition(F.floor(F.col("src") / SPAN)).sortWithinPartitions("src", "at").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in PIECE.items()))


def as_rows(edges: DataFrame, nodes: DataFrame, pieces: DataFrame | None = None) -> DataFrame:
    """A graph's pieces in the order of the stream, for one task. ``pieces``: settled ones, where several runs read one graph."""
    return (as_pieces(edges, nodes).repartition(1) if pieces is None else pieces.coalesce(1)).sortWithinPartitions("first", "at")


def whole_graph(batches_in: Iterator[pa.RecordBatch]) -> Csr:
    """The graph of pieces in order. Long arrays of arcs lie on the task's disk, so memory is needed for vertices only."""
    dst, w, cells = Spool(), Weights(), {c: [np.empty(0, np.int64)] for c in ("ids", "weights", "owners", "counts")}
    for b in batches_in:
        for i in range(b.num_rows):
            for c, kept in cells.items():
                kept.append(np.frombuffer(b.column(c)[i].as_py(), np.int64))
            m, weights = int(cells["counts"][-1].sum()), np.frombuffer(b.column("w")[i].as_py(), np.int64)
            w.add(weights if len(weights) else np.ones(m, np.int64))
            dst.add(_long(b.column("dst")[i].as_py(), m))
    ids, node_w, owners, counts = (np.concatenate(x) for x in cells.values())
    n, ends = len(ids), dst.whole()
    if not np.array_equal(ids, np.arange(n)):
        raise ValueError("vertex ids must be dense from 0")
    if any(len(x) and x[i : i + LISTED].max() >= n for x in (owners, ends) for i in range(0, len(x), LISTED)):
        raise ValueError("an arc ends at no vertex")
    indptr = np.zeros(n + 1, np.int64)
    np.add.at(indptr, owners + 1, counts)
    return Csr(np.cumsum(indptr), ends, w.whole(), node_w)


def partition(edges: DataFrame, nodes: DataFrame, cfg: PartitionConfig, pieces: DataFrame | None = None) -> DataFrame:
    """id, block of every vertex, exactly as the stream defines them."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = run_kernel(whole_graph(rows), cfg)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(block)), pa.int64()), pa.array(block, pa.int32())], ["id", "block"])

    return as_rows(edges, nodes, pieces).mapInArrow(run, "id long, block int")


def partition_bisected(edges: DataFrame, nodes: DataFrame, cfg: PartitionConfig, pieces: DataFrame | None = None) -> DataFrame:
    """id, block of every vertex by recursive bisection of the whole graph, in one task. For graphs whose vertices fit in a task."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = whole_graph(rows)
        cap = capacity(float(g.node_w.sum()), cfg.k, cfg.imbalance, True)
        block = recursive_bisection(g, cfg.k, cap, alpha_gamma, label_rounds=cfg.label_rounds, refine_rounds=cfg.refine_rounds, sqrt_mode=cfg.sqrt_mode, ties=cfg.ties, seed=cfg.seed, matcher=cfg.matcher, improve_initial=cfg.improve_initial)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(g.n), pa.int64()), pa.array(block, pa.int32())], ["id", "block"])

    return as_rows(edges, nodes, pieces).mapInArrow(run, "id long, block int")


def baseline(edges: DataFrame, nodes: DataFrame, kind: str, k: int, imbalance: float = 3.0) -> DataFrame:
    """id, block of a one-pass baseline; hashing, chunking and balanced are projections, greedy and LDG stream."""
    ids = nodes.select(F.col("node_id").alias("id"))
    if kind == "hashing":
        return ids.select("id", F.pmod(graph.fnv32(F.col("id")), F.lit(k)).cast("int").alias("block"))
    if kind == "balanced":
        return ids.select("id", F.pmod("id", F.lit(k)).cast("int").alias("block"))
    if kind == "chunking":
        return ids.select("id", F.floor(F.col("id") * k / nodes.count()).cast("int").alias("block"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = whole_graph(rows)
        block = fennel.baseline(kind, g.rows()[0], g.n, k, capacity(g.n, k, imbalance, True))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(g.n), pa.int64()), pa.array(block, pa.int32())], ["id", "block"])

    return as_rows(edges, nodes).mapInArrow(run, "id long, block int")


# -- batches from joins -------------------------------------------------------------------------------------------
def batch_models(edges: DataFrame, assign: DataFrame | None, lo: int, hi: int, again: bool, ghosts: bool = False) -> DataFrame:
    """Arcs of one batch's model: (src, dst, weight) local ids, anchors as -1 - block, with ``ghosts`` later vertices as their ids less lo. Local pairs once, arcs to placed vertices summed by block."""
    mine = edges.where((F.col("src") >= lo) & (F.col("src") < hi))
    local = mine.where((F.col("dst") >= lo) & (F.col("dst") < F.col("src"))).select((F.col("src") - lo).alias("src"), (F.col("dst") - lo).alias("dst"), "weight")
    if ghosts:
        local = local.unionByName(mine.where(F.col("dst") >= hi).select((F.col("src") - lo).alias("src"), (F.col("dst") - lo).alias("dst"), "weight"))
    if assign is None:
        return local
    outside = mine.where((F.col("dst") < lo) | ((F.col("dst") >= hi) if again else F.lit(False)))
    past = outside.join(assign.select(F.col("id").alias("dst"), "block"), "dst").groupBy("src", "block").agg(F.sum("weight").alias("weight"))
    return local.unionByName(past.select((F.col("src") - lo).alias("src"), (-1 - F.col("block")).cast("long").alias("dst"), "weight"))


ASSIGNED = "id long, block int, weight long, pass int, batch int"


def partition_batched(edges: DataFrame, nodes: DataFrame, cfg: PartitionConfig, folder: str | None = None) -> DataFrame:
    """As ``partition`` for plain batches, batch by batch; the driver holds k loads a batch and the loop.

    ``folder`` (a new one in the shared folder by default) gets the arcs and vertices by batch, each read once a pass, and ``assigned``, the table of blocks, which grows by a
    part a batch as the run goes on; a batch done again replaces its part.  A batch reads the blocks of the others, narrow rows, and no plan depends on how many there are.
    """
    if cfg.mode() != "batches":
        raise ValueError("partition_batched takes plain batches")
    spark, n, m, k = nodes.sparkSession, nodes.count(), edges.count() // 2, cfg.k
    ag, bounds, size = alpha_gamma(n, m, k), bounds_of(n, cfg), cfg.batch_length(n)
    folder = folder or new_folder(spark, "node-batches")
    if cfg.balance_edges:
        nodes = graph.degrees(edges, nodes).join(nodes, "node_id").select("node_id", (F.col("weight") + F.col("degree")).alias("weight"))
    for rows, key, name in ((edges.select("src", "dst", "weight"), "src", "arcs"), (nodes.select("node_id", "weight"), "node_id", "nodes")):
        rows.withColumn("batch", graph.batch_of(F.col(key), size)).repartition("batch").write.mode("overwrite").partitionBy("batch").parquet(f"{folder}/{name}")
    arcs_of, nodes_of = spark.read.schema("src long, dst long, weight long, batch int").parquet(f"{folder}/arcs"), spark.read.schema("node_id long, weight long, batch int").parquet(f"{folder}/nodes")
    total = int(nodes_of.agg(F.sum("weight")).first()[0] or 0)
    loads: dict[int, np.ndarray] = {}
    for p in range(cfg.passes):
        for i, lo in enumerate(range(0, n, size)):
            hi = min(n, lo + size)
            done = spark.read.schema(ASSIGNED).parquet(f"{folder}/assigned") if loads else None
            others = done.where(f"pass = {p} and batch < {i} or pass = {p - 1} and batch > {i}") if loads else None  # pruned to these parts
            load = sum((loads[j] for j in loads if j != i), np.zeros(k, np.int64))
            arcs = batch_models(arcs_of.where(f"batch = {i}"), others, lo, hi, p > 0, cfg.model_ghosts and p == 0).withColumn("start", F.lit(None).cast("int"))
            own = nodes_of.where(f"batch = {i}").select((F.col("node_id") - lo).alias("src"), F.lit(None).cast("long").alias("dst"), "weight")
            own = own.join(done.where(f"pass = {p - 1} and batch = {i}").select((F.col("id") - lo).alias("src"), F.col("block").alias("start")), "src") if p else own.withColumn("start", F.lit(None).cast("int"))

            def solve(rows: Iterator[pa.RecordBatch], size=hi - lo, lo=lo, load=load, p=p, i=i) -> Iterator[pa.RecordBatch]:
                t = pa.Table.from_batches([b for b in rows if b.num_rows])
                src, w, dst, start = t.column("src").to_numpy(), t.column("weight").to_numpy(), t.column("dst"), t.column("start")
                is_node = dst.is_null().to_numpy()
                d = dst.fill_null(0).to_numpy()
                node_w = np.ones(size, np.int64)
                node_w[src[is_node]] = w[is_node]
                begin = None
                if p:
                    begin = np.zeros(size, np.int64)
                    begin[src[is_node]] = start.fill_null(0).to_numpy()[is_node]
                    begin = begin.tolist()
                unseen, arc = ~is_node & (d >= size), ~is_node & (d < size)
                factor = 2 if cfg.model_ghosts else 1
                a, b, c = src[arc], np.where(d[arc] < 0, size - 1 - d[arc], d[arc]), w[arc] * factor
                model_w = node_w.copy()
                if cfg.model_ghosts and not p:
                    at = np.lexsort((d[unseen], src[unseen]))
                    x, y, z, heavier = batches.ghost_links(d[unseen][at] + lo, src[unseen][at], w[unseen][at], i + 1)
                    a, b, c = np.concatenate([a, x]), np.concatenate([b, y]), np.concatenate([c, z])
                    np.add.at(model_w, heavier, 1)
                weights = np.concatenate([model_w, load])
                out = batches.solve(from_arcs(size + k, a, b, c, weights), k, bounds(float(weights.sum()), int(load.sum()), size, p), ag, cfg, lo, begin, refinement_weight(cfg, total - int(load.sum()), m))[:size]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + size)), pa.array(out, pa.int32()), pa.array(node_w)], ["id", "block", "weight"])

            part = f"{folder}/assigned/pass={p}/batch={i}"
            arcs.unionByName(own).repartition(1).mapInArrow(solve, "id long, block int, weight long").write.mode("overwrite").parquet(part)
            loads[i] = np.zeros(k, np.int64)
            for r in spark.read.parquet(part).groupBy("block").agg(F.sum("weight").alias("w")).collect():  # k rows
                loads[i][r["block"]] = r["w"]
    if not loads:
        return spark.createDataFrame([], "id long, block int")
    return spark.read.schema(ASSIGNED).parquet(f"{folder}/assigned").where(f"pass = {cfg.passes - 1}").select("id", "block")


def partition_distributed(edges: DataFrame, nodes: DataFrame, cfg: PartitionConfig, rounds: int = 8) -> DataFrame:
    """id, block by supersteps from equal chunks: every vertex asks for its best block at the round's loads; a block takes as many as it has room for, by seeded hash."""
    n, m, k = nodes.count(), edges.count() // 2, cfg.k
    ag = alpha_gamma(n, m, k)
    spark, total = nodes.sparkSession, nodes.agg(F.sum("weight")).first()[0] or 0
    cap = capacity(total, k, cfg.imbalance, True)
    w = nodes.select(F.col("node_id").alias("id"), "weight")
    edges = settle(edges.select("src", "dst", "weight").repartition("src"))  # read again every round
    now = settle(nodes.select(F.col("node_id").alias("id"), F.least(F.floor(F.col("node_id") * k / max(n, 1)), F.lit(k - 1)).cast("int").alias("block")))
    loads_of = lambda a: {x["block"]: x["load"] for x in graph.block_table(a, nodes, k).collect()}  # k rows
    loads = loads_of(now)
    for r in range(rounds):
        blocks = spark.createDataFrame([(b, loads.get(b, 0), cap) for b in range(k)], "block int, load long, cap long")
        gains = scoring.neighbour_blocks(edges, now.withColumn("status", F.lit("assigned")))
        wish = scoring.best_blocks(nodes, gains, blocks, ag).select(F.col("node_id").alias("id"), F.col("block").alias("wish"))
        moves = settle(now.join(wish, "id").where("wish <> block").join(w, "id"))
        demand = {x["wish"]: x["w"] for x in moves.groupBy("wish").agg(F.sum("weight").alias("w")).collect()}  # k rows
        share = F.element_at(F.create_map(*[F.lit(x) for b in range(k) for x in (b, min(1.0, 0.9 * max(0, cap - loads.get(b, 0)) / max(1, demand.get(b, 0))))]), F.col("wish"))
        taken = moves.where(F.pmod(F.xxhash64(F.lit(cfg.seed), F.lit(r), "id"), F.lit(1 << 30)) / float(1 << 30) < share / 2 * (1 + F.lit(r % 2))).select("id", "wish")
        new = settle(now.join(taken, "id", "left").select("id", F.coalesce("wish", "block").alias("block")))
        then = loads_of(new)
        if max(then.values(), default=0) > max(cap, max(loads.values(), default=0)):
            continue
        if moves.isEmpty():
            break
        now, loads = new, then
    return now
