"""Whole graphs in one task: packed by many tasks, read in order, with memory for vertices and not for arcs."""

from __future__ import annotations

import re
import tracemalloc

import numpy as np
import pytest

from partloom.kernel import csr, fennel, multilevel
from partloom.kernel.csr import from_arcs
from partloom.operators import graph
from partloom.plans import node
from partloom.plans.config import PartitionConfig, alpha_gamma
from partloom.sources import tables


def frames(spark, n: int, m: int, weights=None):
    r = np.random.default_rng(3)
    u, v = r.integers(0, n, m), r.integers(0, n, m)
    u, v = np.minimum(u, v)[u != v], np.maximum(u, v)[u != v]
    w = np.ones(len(u), np.int64) if weights is None else r.integers(1, weights, len(u))
    rows = spark.createDataFrame(list(zip(u.tolist(), v.tolist(), w.tolist(), strict=True)), "u long, v long, weight long")
    return from_arcs(n, u, v, w), graph.symmetrize(rows), spark.range(n).selectExpr("id AS node_id", "1L AS weight")


@pytest.fixture
def small_limits(monkeypatch):
    """Graphs of some thousand arcs count as large."""
    for name, value in (("LISTED", 500), ("KEPT", 2000), ("SPOOLED", 1000)):
        monkeypatch.setattr(csr, name, value, raising=False)


def read(spark, edges, nodes) -> csr.Csr:
    """Packed by several tasks, each with stretches of ids that aren't next to each other."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return node.as_rows(edges, nodes).toArrow().to_batches()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("weights", [None, 9])
def test_pieces_are_the_graph(spark, small_limits, weights):
    g, e, n = frames(spark, 9000, 20000, weights)
    got = node.whole_graph(read(spark, e, n))
    assert (got.indptr == g.indptr).all() and (got.dst == g.dst).all() and (got.node_w == g.node_w).all() and got.n == 9000
    assert (got.w == g.w).all() and got.unit() == bool((g.w == 1).all())


def test_bad_graphs_are_told(spark):
    g, e, n = frames(spark, 50, 100)
    for edges, nodes in ((e, n.where("node_id <> 7")), (e, n.union(n.where("node_id = 3"))), (e.unionByName(e.limit(1).selectExpr("src", "src AS dst", "weight")), n)):
        with pytest.raises(Exception, match="dense from 0|self-loop"):
            node.whole_graph(read(spark, edges, nodes))


def peak(rows, run) -> tuple[float, np.ndarray]:
    """Bytes at most, and the result."""
    tracemalloc.start()
    try:
        out = run(node.whole_graph(rows))
        return tracemalloc.get_traced_memory()[1], out
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("options", [{"score": "haa"}, {"score": "nss"}, {"batch_size": 1}, {"pull_neighbours": True, "passes": 2}])
def test_buffered_memory_is_not_for_arcs(spark, small_limits, options):
    """F1."""
    g, e, n = frames(spark, 400, 60000)
    g.w[:] = 1
    cfg = PartitionConfig(k=4, **{"batch_size": 8, "buffer_size": 8} | options)
    one = graph.merge_parallel(e).selectExpr("src", "dst", "1L AS weight")
    used, blocks = peak(read(spark, one, n), lambda x: node.run_kernel(x, cfg))
    assert used < 8 * len(g.dst), used / len(g.dst)
    csr.LISTED = 1 << 20
    assert (blocks == node.run_kernel(g, cfg)).all()


def test_relabelled_is_the_graph_from_arcs(small_limits):
    """contraction and subgraphs some arcs at a time, clusters that are larger than that among them."""
    r = np.random.default_rng(5)
    g = from_arcs(700, *(lambda a, b: (a[a != b], b[a != b]))(r.integers(0, 700, 9000), r.integers(0, 700, 9000)))
    for ids in (r.integers(0, 40, 700), np.sort(r.integers(0, 3, 700)), r.permutation(700), np.zeros(700, np.int64)):
        n = int(ids.max()) + 1
        got = multilevel.contract(g, ids, n)
        src = np.repeat(np.arange(700), np.diff(g.indptr))
        cross = ids[src] != ids[g.dst]
        want = from_arcs(n, ids[src][cross], ids[g.dst][cross], g.w[cross], both=False)
        assert (got.indptr == want.indptr).all() and (got.dst == want.dst).all() and (got.w == want.w).all() and got.node_w.tolist() == np.bincount(ids, minlength=n).tolist()
    keep = r.integers(0, 3, 700) > 0
    got, new = multilevel.subgraph(g, keep), np.cumsum(keep) - 1
    inner = keep[src] & keep[g.dst]
    want = from_arcs(int(keep.sum()), new[src[inner]], new[g.dst[inner]], g.w[inner], both=False)
    assert (got.indptr == want.indptr).all() and (got.dst == want.dst).all() and (got.w == want.w).all()


@pytest.mark.parametrize("run", ["bisected", "batches", "restream", "model_ghosts"])
def test_partition_memory_is_not_for_arcs(spark, small_limits, run):
    """F2."""
    g, e, n = frames(spark, 400, 60000)
    g.w[:] = 1
    options = {"batches": {}, "restream": {"passes": 2}, "model_ghosts": {"model_ghosts": True}}.get(run, {})
    cfg = PartitionConfig(k=4, batch_size=8, **options)
    solve = (lambda x: multilevel.recursive_bisection(x, 4, 110, alpha_gamma)) if run == "bisected" else lambda x: node.run_kernel(x, cfg)
    one = graph.merge_parallel(e).selectExpr("src", "dst", "1L AS weight")
    used, blocks = peak(read(spark, one, n), solve)
    assert used < 10 * len(g.dst), used / len(g.dst)
    csr.LISTED = 1 << 20
    assert (blocks == solve(g)).all()


@pytest.mark.parametrize("options", [{}, {"passes": 2, "restream_all": True}])
def test_direct_memory_is_not_for_arcs(spark, small_limits, options):
    """F3."""
    g, e, n = frames(spark, 400, 60000)
    cfg = PartitionConfig(k=4, batch_size=1, **options)
    used, blocks = peak(read(spark, e, n), lambda x: node.run_kernel(x, cfg))
    assert used < 8 * len(g.dst), used / len(g.dst)
    csr.LISTED = 1 << 20
    assert (blocks == node.run_kernel(g, cfg)).all()


@pytest.mark.parametrize("kind", ["greedy", "ldg"])
def test_baseline_memory_is_not_for_arcs(spark, small_limits, kind):
    """F4."""
    g, e, n = frames(spark, 400, 60000)
    used, blocks = peak(read(spark, e, n), lambda x: fennel.baseline(kind, x.rows()[0], x.n, 4, 103))
    assert used < 8 * len(g.dst), used / len(g.dst)
    assert (blocks == fennel.baseline(kind, from_arcs(400, *np.nonzero(dense(g)), both=False).rows()[0], 400, 4, 103)).all()


def dense(g) -> np.ndarray:
    out = np.zeros((g.n, g.n), bool)
    out[np.repeat(np.arange(g.n), np.diff(g.indptr)), g.dst] = True
    return out


def test_pairs_of_suppliers_are_counted_where_they_are_made(spark, tmp_path):
    """no pair is shuffled by itself, repeated lines and rows without a key count for nothing."""
    lines = [(p, s) for p in range(12) for s in range(9) if (p * 5 + s * 3) % 4 < 2] * 2 + [(None, 1), (3, None), (11, 8)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(9).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    u, _ = tables.supplier_supplier(spark, str(tmp_path))
    have = {(p, s) for p, s in lines if p is not None and s is not None}
    shared = {(a, b): sum((p, a) in have and (p, b) in have for p in range(12)) for a in range(9) for b in range(a + 1, 9)}
    shared = {k: x for k, x in shared.items() if x}
    mean = sum(shared.values()) / len(shared)
    assert {(r["u"], r["v"]): r["weight"] for r in u.collect()} == {k: x for k, x in shared.items() if x > mean}
    plan = u._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(u#" in plan and not re.search(r"hashpartitioning\(\w+#\d+L?, v#", plan)


def test_pairs_are_counted_one_by_one(monkeypatch):
    """memory for one supplier's different ends, not for all of a task's pairs; lists that go on in the next batch and suppliers with many ends among them."""
    import pyarrow as pa

    from partloom.kernel import pairs

    monkeypatch.setattr(pairs, "HELD", 3000)
    monkeypatch.setattr(pairs, "GIVEN", 500)

    def rows():
        """Batches of 50 lists, 200 lists a supplier; supplier 3 has 2000."""
        own = np.repeat(np.arange(40), [2000 if u == 3 else 200 for u in range(40)])
        s = np.random.default_rng(8)
        for lo in range(0, len(own), 50):
            yield pa.RecordBatch.from_pydict({"u": pa.array(own[lo : lo + 50]), "v": pa.array([s.integers(100, 1100, 20) for _ in range(50)], pa.list_(pa.int64())), "mean": pa.array([4.0] * 50)})

    want: dict[tuple[int, int], int] = {}
    for b in rows():
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            for x in v:
                want[u, x] = want.get((u, x), 0) + 1
    assert pa.Table.from_batches(pairs.totals(rows())).to_pylist() == [{"pairs": len(want), "every": sum(want.values())}]
    tracemalloc.start()
    try:
        got = sum(b.num_rows for b in pairs.above(rows()))
        used = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert used < 8 * len(want), used / len(want)
    heavy = {k: n for k, n in want.items() if n > 4}
    assert got == len(heavy) and {(x["u"], x["v"]): x["weight"] for b in pairs.above(rows()) for x in b.to_pylist()} == heavy


def test_no_pairs_of_suppliers(spark, tmp_path):
    """parts with one supplier each, and no lines at all."""
    spark.range(9).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    for rows in ([(1, 1), (2, 2), (2, 2)], []):
        spark.createDataFrame(rows, "l_partkey long, l_suppkey long").write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
        assert tables.supplier_supplier(spark, str(tmp_path))[0].collect() == []


def test_pairs_of_suppliers_are_in_no_table(spark, tmp_path):
    """no aggregate by pairs, whose table holds all of a task's."""
    spark.createDataFrame([(p, s) for p in range(3) for s in range(4)], "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(4).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    plan = tables.supplier_supplier(spark, str(tmp_path))[0]._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Aggregate\(keys=\[u#\d+L?, v#", plan)


@pytest.mark.parametrize("top", [0, 5, 1 << 40])
def test_pieces_are_short(top):
    """arcs of long lists take few bytes on their way to the one task."""
    r = np.random.default_rng(9)
    ends = np.concatenate([np.sort(r.choice(60000, 2000, replace=False)) for _ in range(5)]) if top else np.empty(0, np.int64)
    ends = np.append(ends, [top, 0, 7]) if top else ends
    short = node._short(ends)
    assert node._long(short, len(ends)).tolist() == ends.tolist()
    assert top > 5 or len(short) < 2 * len(ends) + 30
