"""The graph engine: hand-made graph, SQL oracles, invariants, files, streams, negative cases."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from partloom.kernel import batches, buffer, edges, fennel, matching
from partloom.kernel.csr import from_arcs
from partloom.kernel.multilevel import Solver, contract, objective, recursive_bisection
from partloom.operators import connectivity, graph, metrics, ratings, scoring
from partloom.plans import catalog, edge, node, registry, run
from partloom.plans.config import PartitionConfig, alpha_gamma, capacity, dynamics_weight, edge_alpha_gamma
from partloom.sources import binary_graph, metis, sinks
from partloom.streaming import stream

SF = "/root/testdata/sf0.001"
# Two 4-cliques joined by one edge, and an isolated vertex; 1-based text.
G9 = "% made by hand\n9 13\n2 3 4\n1 3 4\n1 2 4\n% between\n1 2 3 5\n4 6  7 8\n5 7 8 \n5 6 8\r\n5 6 7\n\n"
PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (4, 7), (5, 6), (5, 7), (6, 7)]


@pytest.fixture
def g9(spark, tmp_path):
    p = tmp_path / "g9.graph"
    p.write_text(G9)
    e, n, header = metis.read_graph(spark, str(p), validate=True)
    assert header == {"nodes": 9, "edges": 13, "fmt": 0, "binary": False}
    return str(p), e.cache(), n.cache()


def one(df):
    return df.first()[0]


def blocks(df):
    return [r["block"] for r in df.orderBy("id").collect()]


def clique_split(spark):
    return spark.createDataFrame([(i, int(i > 3)) for i in range(9)], "id long, block int")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.ORACLES[name]).df()
    cols = sorted(want)
    assert sorted(got) == cols and len(got) == len(want)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert all((a[c].isna() & b[c].isna() | (a[c] == b[c])).all() for c in cols)


def test_hand_made_metrics(spark, g9):
    _, e, n = g9
    a = clique_split(spark)
    assert one(metrics.edge_cut(e, a)) == 1 and one(metrics.boundary_nodes(e, a)) == 2
    assert {r["block"]: r["volume"] for r in metrics.communication_volume(e, a, 2).collect()} == {0: 1, 1: 1}
    assert one(metrics.pairwise_cut(e, a, 0, 1)) == 1 and one(metrics.separator_weight(a, n, 1)) == 5
    assert one(metrics.objective(e, a, 2)) == 1 and one(metrics.objective(e, a, 2, "volume")) == 1
    assert one(metrics.objective(e, a, 2, "connected")) == 1 + 13 * 3  # the isolated vertex is a third part
    ids = graph.edge_ids(graph.once(e), 4)
    assert [(r["owner"], r["u"] + r["v"] - r["owner"]) for r in ids.orderBy("edge_id").collect()] == [*PAIRS[:6], (4, 3), *PAIRS[7:]]
    ids = graph.edge_ids(graph.once(e), 9).selectExpr("edge_id", "u", "v", "cast(floor(edge_id * 2 / 13) as int) as block")
    assert ids.orderBy("edge_id").select("u", "v").collect() == PAIRS
    m = metrics.edge_partition_metrics(ids, 9, 2).first()
    assert (m["vertex_cut"], m["replicas"], m["balance"]) == (1, 1, 1.0) and m["replication_factor"] == 1.0
    assert tuple(graph.split_sizes(e).first()) == (26, 78)


def test_hand_made_fennel(spark, g9):
    _, e, n = g9
    assert alpha_gamma(9, 13, 2) == pytest.approx(1.0213764617139023) and capacity(9, 2, 3, True) == 5
    for mode in ("exact", "fast"):
        a = node.partition(e, n, PartitionConfig(k=2, batch_size=1, sqrt_mode=mode))
        assert blocks(a) == [0, 1, 0, 0, 0, 1, 1, 1, 0]
    assert one(metrics.edge_cut(e, a)) == 6 and one(metrics.balance(a, n, 2)) == 1.0
    assert [round(fennel.fast_sqrt(x), 5) for x in (1, 2, 4, 100)] == pytest.approx([1.00169, 1.41457, 2.00339, 10.01555], abs=2e-5)
    assert [fennel.fnv32(i) for i in range(3)] == [2615243109, 1048580676, 1453600679]
    best = node.partition(e, n, PartitionConfig(k=2, batch_size=0, bb_ratio=0, cluster_factor=2).with_(batch_size=9))
    assert one(metrics.edge_cut(e, best)) <= 6


def test_hand_made_scores(spark, g9):
    _, e, n = g9
    a = spark.createDataFrame([(0, 0, "assigned")], "id long, block int, status string")
    s = {r["node_id"]: r["score"] for r in scoring.buffer_scores(e, n, a, PartitionConfig()).collect()}
    assert s[7] == pytest.approx(9.0e-8) and s[1] == pytest.approx(0.24992509) and s[4] == pytest.approx(1.6e-7) and s[3] == pytest.approx(0.18742516)


def check(assign, n, k, cap=None):
    rows = assign.collect()
    assert sorted(r["id"] for r in rows) == list(range(n)) and all(0 <= r["block"] < k for r in rows)
    if cap:
        load = np.bincount([r["block"] for r in rows], minlength=k)
        assert load.max() <= cap


def random_graph(n, m, seed):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return sorted(pairs)


def to_frames(spark, n, pairs):
    u = spark.createDataFrame([(a, b, 1) for a, b in pairs], "u long, v long, weight long")
    return graph.symmetrize(u).cache(), spark.createDataFrame([(i, 1) for i in range(n)], "node_id long, weight long").cache()


@pytest.mark.parametrize("options", [dict(batch_size=40), dict(batch_size=40, passes=3), dict(batch_size=1), dict(batch_size=1, passes=2), dict(batch_size=1, use_queue=False), *[dict(batch_size=20, buffer_size=50, score=s) for s in ("haa", "anr", "cms", "nss", "cbs", "cbsq")], dict(batch_size=1, buffer_size=30), dict(batch_size=20, buffer_size=50, ghosts=True), dict(batch_size=20, buffer_size=50, passes=2), dict(batch_size=40, model_ghosts=True), dict(batch_size=0), dict(batch_size=40, matcher="paths", improve_initial=True), dict(batch_size=40, passes=2, matcher="random"), dict(batch_size=20, buffer_size=50, pull_neighbours=True), dict(batch_size=40, order="random", ties="coin", ensembles=2, cycles=2), dict(batch_size=20, buffer_size=40, bb_ratio=4, d_max=5)])
def test_node_modes_hold_the_cap(options):
    pairs = random_graph(200, 700, 1)
    g = from_arcs(200, *zip(*pairs, strict=True))
    cfg = PartitionConfig(k=4, **options)
    b = node.run_kernel(g, cfg)
    assert len(b) == 200 and b.min() >= 0 and b.max() < 4
    assert np.bincount(b, minlength=4).max() <= (capacity(200, 4, 3, True) if cfg.mode() == "direct" else 1.25 * 50)
    assert (node.run_kernel(g, cfg) == b).all()


def test_queue_equals_full_look_and_batched_equals_whole(spark):
    pairs = random_graph(150, 400, 3)
    g = from_arcs(150, *zip(*pairs, strict=True))
    direct = [node.run_kernel(g, PartitionConfig(k=3, batch_size=1, use_queue=q)) for q in (True, False)]
    assert (direct[0] == direct[1]).all()
    e, n = to_frames(spark, 150, pairs)
    for passes in (1, 2):
        cfg = PartitionConfig(k=3, batch_size=60, passes=passes)
        assert blocks(node.partition_batched(e, n, cfg)) == node.run_kernel(g, cfg).tolist()


def test_distributed_keeps_the_cap_and_lowers_the_cut(spark):
    pairs = [(a, b) for c in range(4) for a, b in random_graph(50, 300, c) for a, b in [(4 * a + c, 4 * b + c)]]
    e, n = to_frames(spark, 200, pairs)
    a = node.partition_distributed(e, n, PartitionConfig(k=4, imbalance=10), rounds=6)
    check(a, 200, 4, capacity(200, 4, 10, True))
    chunks = node.baseline(e, n, "chunking", 4)
    assert one(metrics.edge_cut(e, a)) < one(metrics.edge_cut(e, chunks))


@pytest.mark.parametrize("options", [dict(), dict(passes=2), dict(minimal_mode=False), dict(minimal_mode=False, past_subset_size=1), dict(batch_alpha=False), dict(batch_alpha=False, dynamic_alpha=True), dict(num_split_edges=500)])
def test_edge_modes(options):
    pairs = random_graph(60, 200, 2)
    g = from_arcs(60, *zip(*pairs, strict=True))
    cfg = PartitionConfig(k=3, batch_size=16, **options)
    u, v, b = edge.run_kernel(g, cfg)
    assert sorted(zip(u.tolist(), v.tolist(), strict=True)) == pairs and 0 <= b.min() and b.max() < 3
    assert np.bincount(b, minlength=3).max() <= 1.3 * len(pairs) / 3


def test_edge_order_and_links_equal_the_relations(spark):
    pairs = random_graph(40, 120, 5)
    g, (e, _) = from_arcs(40, *zip(*pairs, strict=True)), to_frames(spark, 40, pairs)
    ids = graph.edge_ids(graph.once(e), 16)
    u, v, batch, pu, pv = edges.stream_order(g, 16)
    assert [(r["u"], r["v"], r["batch"]) for r in ids.orderBy("edge_id").collect()] == list(zip(u.tolist(), v.tolist(), batch.tolist(), strict=True))
    want = sorted((r["lo"], r["hi"], r["weight"]) for r in graph.split_links(ids).collect())
    got: dict = {}
    for b in set(batch.tolist()):
        at = np.flatnonzero(batch == b)
        for x, y in zip(*(z.tolist() for z in edges.links(u[at], v[at], pu[at], pv[at], int(at[0]))), strict=True):
            key = (min(x, y), max(x, y))
            got[key] = got.get(key, 0) + 1
    assert sorted((*k, w) for k, w in got.items()) == want


def test_restream_of_full_incidence_is_an_error():
    g = from_arcs(3, [0, 1], [1, 2])
    with pytest.raises(ValueError, match="minimal_mode"):
        edge.run_kernel(g, PartitionConfig(k=2, passes=2, minimal_mode=False))


def test_configuration_errors():
    for bad in (dict(score="gts"), dict(k=0), dict(score="x"), dict(dynamics="x"), dict(passes=0), dict(sqrt_mode="x")):
        with pytest.raises(ValueError):
            PartitionConfig(**bad)
    weighted = from_arcs(3, [0, 1], [1, 2], [2, 1])
    with pytest.raises(ValueError, match="without weights"):
        node.run_kernel(weighted, PartitionConfig(k=2, buffer_size=4, batch_size=2))
    with pytest.raises(ValueError, match="self-loop"):
        from_arcs(2, [0], [0])
    assert [dynamics_weight(k, 1, 4) for k in ("original", "double", "linear", "quadratic", "midlinear", "midquadratic", "midconstant", "edgecut")] == [1, 2, 0.5, 0.125, 1, 0.5, 0.5, 0]


def test_small_and_odd_graphs():
    empty, alone = from_arcs(0, [], []), from_arcs(5, [], [])
    for o in (dict(batch_size=1), dict(batch_size=2), dict(batch_size=2, buffer_size=3)):
        assert len(node.run_kernel(empty, PartitionConfig(k=2, **o))) == 0
        assert sorted(np.bincount(node.run_kernel(alone, PartitionConfig(k=2, **o)), minlength=2)) in ([2, 3], [1, 4])
        assert set(node.run_kernel(alone, PartitionConfig(k=1, **o))) == {0}
        assert node.run_kernel(alone, PartitionConfig(k=9, **o)).max() < 9
    star = from_arcs(30, [0] * 29, range(1, 30))
    assert len(node.run_kernel(star, PartitionConfig(k=3, batch_size=4, buffer_size=8, d_max=10, passes=2))) == 30
    assert len(edge.run_kernel(alone, PartitionConfig(k=2))[0]) == 0


def test_full_blocks():
    full = fennel.Loads(3, 1)
    for b in range(3):
        full.add(b, b + 1)
    assert fennel.choose({2: 5.0}, full, 0.1, math.sqrt, queue=True) == 0 and fennel.choose({2: 5.0}, full, 0.1, math.sqrt, queue=False) == 0
    full.add(0, 9)
    assert fennel.choose({2: 5.0}, full, 0.1, math.sqrt, queue=True) == 1 and full.place_alone() == 0


def test_bucket_queue_is_last_in_first_out():
    q = buffer.BucketQueue(1.0, 1000)
    for v, s in ((1, 0.5), (2, 0.5), (3, 0.2), (4, 2.5)):
        q.insert(v, s)
    assert q.top_bucket() == 2500 and q.pop() == 4
    q.change(3, 9.0)  # a change stops at the top bucket
    assert q.top_bucket() == 1000 and [q.pop() for _ in range(3)] == [3, 2, 1] and len(q) == 0
    assert buffer.lightest_first([7, 8, 9], [3, 0], [1] * 10, bound=2) == {7: 1, 8: 1} and buffer.lightest_first([7], [3, 4], [1] * 8, bound=9, targets=[4, 8]) == {7: 1}


def test_multilevel_parts():
    pairs = random_graph(60, 200, 9)
    g = from_arcs(60, *zip(*pairs, strict=True))
    s = Solver(3, 25, 0.3, anchors=False, cluster_factor=3)
    labels = s.coarse_ids(s.cluster(g, None), 60)
    sizes = np.bincount(labels)
    assert sizes.max() <= max(1, s.cluster_bound)
    c = contract(g, labels, len(sizes))
    assert c.node_w.sum() == 60 and c.w.sum() == sum(2 for a, b in pairs if labels[a] != labels[b])
    start = s.initial(g, None)
    better = s.refine(g, list(start))
    cut = lambda b: sum(b[x] != b[y] for x, y in pairs)
    assert cut(better) <= cut(start) and np.bincount(better).max() <= 25
    assert objective(g, np.array(better), 3, 0.3) == int((0.3 * sum(x * math.sqrt(x) for x in np.bincount(better)) - 2 * (len(pairs) - cut(better))) / 2)
    assert s.overlay([[0, 0, 1, 1], [5, 6, 6, 6]]) == [0, 1, 2, 2]


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8])
def test_bisection_halves_within_the_cap(k):
    pairs = [(8 * c + i, 8 * c + j) for c in range(8) for i in range(8) for j in range(i)] + [(8 * c, (8 * c + 8) % 64) for c in range(8)]
    g, cap = from_arcs(64, *zip(*pairs, strict=True)), capacity(64, k, 10.0, True)
    got = recursive_bisection(g, k, cap, alpha_gamma)
    sizes = np.bincount(got, minlength=k)
    assert len(sizes) == k and sizes.min() > 0 and sizes.max() <= cap
    assert k == 1 or sum(got[a] != got[b] for a, b in pairs) < len(pairs) * (1 - 1 / k)
    assert len(recursive_bisection(from_arcs(0, [], []), k, 1, alpha_gamma)) == 0


def test_improving_a_partition_keeps_the_cap_and_lowers_the_cut():
    pairs = [(a, b) for a in range(24) for b in range(a) if a // 8 == b // 8] + [(0, 8), (8, 16)]
    g, bad = from_arcs(24, *zip(*pairs, strict=True)), [v % 3 for v in range(24)]
    cut = lambda b: sum(b[x] != b[y] for x, y in pairs)
    for matcher in ("paths", "random"):
        s = Solver(3, 10, 0.3, anchors=False, cluster_factor=3, matcher=matcher)
        assert all(m == s.matched(g, bad)[m] and bad[m] == bad[v] for v, m in enumerate(s.matched(g, bad)))
    better = s.improve(g, list(bad))
    assert cut(better) <= cut(bad) and np.bincount(better).max() <= 10


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=10))
def test_path_matching_is_best(rs):
    best = max(sum(r for i, r in enumerate(rs) if mask >> i & 1) for mask in range(1 << len(rs)) if not mask & mask << 1)
    total, places = matching.best_on_path([float(r) for r in rs])
    assert total == best == sum(rs[i] for i in places) and all(b - a > 1 for a, b in zip(places, places[1:], strict=False))


def test_matchings_are_matchings():
    pairs = random_graph(50, 120, 4)
    rng = random.Random(1)
    nbrs = from_arcs(50, *zip(*pairs, strict=True)).rows()[0]
    for mate in (matching.random_matching(nbrs, [1] * 50, 2), matching.path_matching([(a, b, rng.random()) for a, b in pairs], 50, [1] * 50, 2)):
        assert all(mate[mate[v]] == v for v in range(50)) and all(mate[v] == v or tuple(sorted((v, mate[v]))) in pairs for v in range(50)) and sum(mate[v] != v for v in range(50)) >= 30
    cycle = matching.path_matching([(0, 1, 5.0), (1, 2, 4.0), (2, 3, 5.0), (3, 0, 4.0)], 4, [1] * 4, 2)
    assert cycle == [1, 0, 3, 2]


def test_max_flow():
    f = connectivity.FlowNetwork(4)
    for a, b, c in ((0, 1, 3), (0, 2, 2), (1, 2, 1), (1, 3, 2), (2, 3, 3)):
        f.add(a, b, c)
    assert f.solve(0, 3) == (5, [0])


def test_separator_projection_and_empty_epoch(spark, tmp_path):
    coarse = spark.createDataFrame([(0, 2), (1, 0)], "id long, block int")
    fine, inside = graph.project_separator(coarse, spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "node_id long, cluster long"))
    assert blocks(fine) == [2, 2, 0] and sorted(r["node_id"] for r in inside.collect()) == [0, 1]
    stream.solve_epoch(spark.createDataFrame([], "node_id long, targets array<long>"), 0, PartitionConfig(), 3, 2, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/epoch=0").count() == 0


def test_cycles_have_no_order(spark):
    with pytest.raises(ValueError, match="cycle"):
        connectivity.topological_layers(spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long"), spark.range(2).withColumnRenamed("id", "node_id"))


def test_all_ratings(spark, g9):
    _, e, n = g9
    r = ratings.rate(e, n, ratings.NAMES).toPandas()
    assert len(r) == 26 and set(ratings.NAMES) <= set(r) and r.pseudogeom.between(0.6 * 2, 2).all() and (r.expansion_star_2_algdist > 0).all()
    assert ratings.by_rating(e, n, "r4").count() == 13
    with pytest.raises(ValueError, match="no such rating"):
        ratings.rate(e, n, ("x",))


def test_metis_formats(spark, tmp_path):
    for fmt, body, weights, first in (("1", "2 7\n1 7 3 4\n2 4\n", [1, 1, 1], 7), ("10", "5 2\n6 1 3\n7 2\n", [5, 6, 7], 1), ("11", "5 2 7\n6 1 7 3 4\n7 2 4\n", [5, 6, 7], 7), ("100", "2\n1 3\n2\n", [1, 1, 1], 1)):
        p = tmp_path / f"w{fmt}.graph"
        p.write_text(f"3 2 {fmt}\n{body}")
        e, n, _ = metis.read_graph(spark, str(p), validate=True)
        assert [r["weight"] for r in n.orderBy("node_id").collect()] == weights and e.orderBy("src", "dst").first()["weight"] == first
    (tmp_path / "loop.graph").write_text("2 1\n1\n\n")
    with pytest.raises(Exception, match="self-loop"):
        metis.read_graph(spark, str(tmp_path / "loop.graph"))[0].collect()
    with pytest.raises(FileNotFoundError):
        metis.read_header(spark, str(tmp_path / "none"))
    (tmp_path / "bad.graph").write_text("3 9\n2\n1\n\n")
    with pytest.raises(ValueError, match="header says"):
        metis.read_graph(spark, str(tmp_path / "bad.graph"), validate=True)


def test_files_round_trip(spark, g9, tmp_path):
    path, e, n = g9
    want = sorted(map(tuple, e.collect()))
    for weighted in (False, True):
        out = f"{tmp_path}/out{weighted}"
        sinks.write_metis(e, n, out, weighted)
        assert sorted(map(tuple, metis.read_graph(spark, out)[0].collect())) == want
    binary_graph.write_graph(f"{tmp_path}/g.bin", [[b for a, b, _ in want if a == v] for v in range(9)])
    e2, n2, header = metis.read_graph(spark, f"{tmp_path}/g.bin", validate=True)
    assert header["binary"] and sorted(map(tuple, e2.collect())) == want and binary_graph.read_adjacency(spark, f"{tmp_path}/g.bin", 2, 5, rows=2).count() == 3
    a = clique_split(spark)
    sinks.write_partition(a, f"{tmp_path}/part")
    back, k = metis.read_partition(spark, f"{tmp_path}/part")
    assert k == 2 and blocks(back) == blocks(a)
    sinks.write_vector(spark.createDataFrame([(1, 2.5), (0, 1.5)], "id long, value double"), f"{tmp_path}/vec")
    assert [r["value"] for r in metis.read_vector(spark, f"{tmp_path}/vec").orderBy("id").collect()] == [1.5, 2.5]
    sinks.write_hmetis(e, n, f"{tmp_path}/h")
    assert spark.read.text(f"{tmp_path}/h").count() == 14
    for b in (0, 1, 1):
        sinks.append_batch(a.where(f"block = {b}"), f"{tmp_path}/steps", b)
        sinks.add_snapshot(a, f"{tmp_path}/shots", b)
    assert spark.read.parquet(f"{tmp_path}/steps").count() == 9 and spark.read.parquet(f"{tmp_path}/shots").count() == 18
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n2 3 3\n1 1 5.0\n2 3 1\n1 2 -1\n")
    u, nodes = metis.read_matrix(spark, f"{tmp_path}/m.mtx")
    assert sorted((r["u"], r["v"]) for r in u.collect()) == [(0, 5), (1, 6), (2, 7), (3, 5), (3, 6), (4, 7)] and nodes.count() == 8
    sinks.write_matrix_partition(nodes.selectExpr("node_id as id", "cast(node_id % 2 as int) as block"), 2, 3, f"{tmp_path}/spmv")
    assert [spark.read.text(f"{tmp_path}/spmv/{x}").count() for x in ("inputs", "outputs", "nonzeros")] == [3, 2, 3]
    e3, n3 = metis.from_arrays(spark, [0, 1, 3, 4], [1, 0, 2, 1])
    assert e3.count() == 4 and n3.count() == 3


def test_runs_and_log(spark, g9, tmp_path):
    path, _, _ = g9
    for mode, cfg in (("node", PartitionConfig(k=2, batch_size=4)), ("node_batched", PartitionConfig(k=2, batch_size=4)), ("edge", PartitionConfig(k=2, batch_size=4))):
        assign, log = run.run_file(spark, path, mode, cfg, f"{tmp_path}/{mode}", f"{tmp_path}/logs")
        row = log.first()
        assert row["graph"]["num_nodes"] == 9 and row["metrics"]["balance"] >= 1 and spark.read.text(f"{tmp_path}/{mode}").count() == (13 if mode == "edge" else 9)
        assert run.summary(log).first()["graph"] == "g9" and '"k": 2' in run.dumps(log)
    assert run.log_name(path, PartitionConfig(k=2, batch_size=4, buffer_size=9)) == "g9_2_4_9" and run.base_name("/a/b") == "b"
    with pytest.raises(KeyError):
        registry.create("none")
    registry.register("mine", registry.create("node"))
    assert registry.create("mine") is registry.create("node")


def test_stream_of_batches_equals_the_whole(spark, g9, tmp_path):
    path, _, _ = g9
    cfg = PartitionConfig(k=2, batch_size=4)
    got = blocks(stream.run_batches(spark, path, cfg, 9, 13, f"{tmp_path}/epochs", f"{tmp_path}/ck"))
    assert got == node.run_kernel(from_arcs(9, *zip(*PAIRS, strict=True)), cfg).tolist()


def test_stateful_one_pass(spark, g9, tmp_path):
    path, _, _ = g9
    out = stream.one_pass(stream.read_stream(spark, path, 4), PartitionConfig(k=2, batch_size=1), 9, 13)
    q = out.writeStream.format("memory").queryName("one_pass").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert blocks(spark.table("one_pass")) == [0, 1, 0, 0, 0, 1, 1, 1, 0]


def test_batch_model_counts():
    g = from_arcs(9, *zip(*PAIRS, strict=True))
    block, load = np.array([0, 0, 0, 0, -1, -1, -1, -1, -1]), np.array([4, 0])
    m = batches.batch_model(g, 4, 8, block, load, 2, 0)
    assert m.n == 6 and m.w.sum() == 2 * 7 and m.node_w.tolist() == [1, 1, 1, 1, 4, 0]


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1 and set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_options_change_what_they_name():
    g = from_arcs(400, *zip(*random_graph(400, 1200, 1), strict=True))
    for options, schedules in ((dict(batch_size=40), ("double", "linear", "edgecut")), (dict(batch_size=20, buffer_size=50), ("double", "edgecut"))):
        usual = node.run_kernel(g, PartitionConfig(k=4, **options)).tolist()
        assert all(node.run_kernel(g, PartitionConfig(k=4, dynamics=d, **options)).tolist() != usual for d in schedules)
    cfg = PartitionConfig(k=3, batch_alpha=False, dynamic_alpha=True)
    assert edge_alpha_gamma(60, 200, 3, cfg, 50, 120, 300) == 1.5 * (6 * 200 - 300) * 3**0.5 / 120**1.5


def test_cycles_keep_the_least_objective():
    for seed in range(12):
        pairs = random_graph(80, 240, seed)
        g = from_arcs(80, *zip(*pairs, strict=True))
        values = [objective(g, Solver(3, 30, 0.3, anchors=False, ties="coin", order="random", seed=seed).run(g, None, cycles), 3, 0.3) for cycles in (2, 3, 4, 5, 6)]
        assert values == sorted(values, reverse=True)


def test_isolated_vertices_wait_for_any_partner():
    g = from_arcs(102, [], [], None, np.array([9] * 100 + [1, 1], np.int64))
    s = Solver(2, 90, 0.3, anchors=False, cluster_factor=9)
    label = s.cluster(g, None)
    assert label[100] == label[0] and label[101] == label[1]


def test_files_of_many_parts_keep_their_ids(spark, tmp_path):
    rng = random.Random(3)
    want = [rng.randrange(9) for _ in range(5000)]
    a = spark.createDataFrame(list(enumerate(want)), "id long, block int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_partition(a, f"{tmp_path}/part")
        sinks.write_vector(a.select("id", F.col("block").cast("double").alias("value")), f"{tmp_path}/vector")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "part").glob("part-*"))) > 1
    got, k = metis.read_partition(spark, f"{tmp_path}/part")
    assert blocks(got) == want and k == 9
    assert [r["value"] for r in metis.read_vector(spark, f"{tmp_path}/vector").orderBy("id").collect()] == want


def shuffled_lists(n, pairs, seed):
    """Arcs (src, dst, place) whose lists are in no order."""
    rng, lists = random.Random(seed), [[] for _ in range(n)]
    for a, b in pairs:
        lists[a].append(b), lists[b].append(a)
    for x in lists:
        rng.shuffle(x)
    return [(v, t, i) for v, x in enumerate(lists) for i, t in enumerate(x)]


def stream_by_hand(n, arcs, size):
    """Edges in stream order and the links around their ends, by reading the lists as a stream does."""
    lists = [[] for _ in range(n)]
    for v, t, _ in arcs:
        lists[v].append(t)
    out, found = [], []
    for lo in range(0, n, size):
        hi, around, ids = min(n, lo + size), {}, {}
        for v in range(lo, hi):
            for t in lists[v]:
                if t < lo or v < t < hi:
                    ids[frozenset((v, t))] = len(out)
                    out.append((min(v, t), max(v, t), lo // size))
                if t < hi:
                    around.setdefault(v, []).append(t)
                if t < lo:
                    around.setdefault(t, []).append(v)
        for x, ts in around.items():
            e = [ids[frozenset((x, t))] for t in ts]
            found += [tuple(sorted((e[i], e[(i + 1) % len(e)]))) for i in range(len(e) if len(e) > 2 else len(e) - 1)]
    return out, sorted(found)


def test_edge_order_follows_the_lists(spark):
    arcs = shuffled_lists(40, random_graph(40, 130, 8), 4)
    src, dst, place = zip(*arcs, strict=True)
    g = from_arcs(40, src, dst, both=False, place=place)
    want, linked = stream_by_hand(40, arcs, 16)
    u, v, batch, pu, pv = edges.stream_order(g, 16)
    assert list(zip(u.tolist(), v.tolist(), batch.tolist(), strict=True)) == want
    got = []
    for b in set(batch.tolist()):
        at = np.flatnonzero(batch == b)
        got += [tuple(sorted(x)) for x in zip(*(z.tolist() for z in edges.links(u[at], v[at], pu[at], pv[at], int(at[0]))), strict=True)]
    assert sorted(got) == linked
    e = spark.createDataFrame([(a, b, 1, i) for a, b, i in arcs], "src long, dst long, weight long, place int")
    ids = graph.edge_ids(graph.placed_pairs(e), 16)
    assert [(r["u"], r["v"], r["batch"]) for r in ids.orderBy("edge_id").collect()] == want
    assert sorted((r["lo"], r["hi"]) for r in graph.split_links(ids).collect() for _ in range(r["weight"])) == linked


@pytest.mark.parametrize("options", [dict(), dict(passes=2), dict(minimal_mode=False), dict(minimal_mode=False, past_subset_size=1), dict(batch_alpha=False, dynamic_alpha=True)])
def test_batched_edges_equal_the_stream(spark, options):
    arcs = shuffled_lists(50, random_graph(50, 170, 6), 2)
    e = spark.createDataFrame([(a, b, 1, i) for a, b, i in arcs], "src long, dst long, weight long, place int")
    n, cfg = spark.range(50).select(F.col("id").alias("node_id"), F.lit(1).cast("long").alias("weight")), PartitionConfig(k=3, batch_size=16, **options)
    rows = lambda df: [tuple(r) for r in df.select("edge_id", "u", "v", "block").orderBy("edge_id").collect()]
    assert rows(edge.partition_batched(e, n, cfg)) == rows(edge.partition(e, n, cfg))


@pytest.mark.parametrize("options", [dict(balance_edges=True), dict(model_ghosts=True), dict(model_ghosts=True, passes=2)])
def test_batched_nodes_equal_the_stream(spark, options, tmp_path):
    rng = random.Random(5)
    pairs = random_graph(60, 200, 11)
    w = {p: rng.randint(1, 4) for p in pairs}
    e = spark.createDataFrame([(a, b, w[p]) for p in pairs for a, b in (p, p[::-1])], "src long, dst long, weight long")
    n, cfg = spark.createDataFrame([(v, rng.randint(1, 3)) for v in range(60)], "node_id long, weight long"), PartitionConfig(k=3, batch_size=16, **options)
    assert blocks(node.partition_batched(e, n, cfg, f"{tmp_path}/run")) == blocks(node.partition(e, n, cfg))
    assert spark.read.parquet(f"{tmp_path}/run/assigned").where("pass = 0").count() == 60  # the progress of the run


def test_surrounded_vertices_are_placed_at_once():
    pairs = [(a, b) for a in range(12) for b in range(a) if a // 6 == b // 6] + [(0, 6)]
    g = from_arcs(12, *zip(*pairs, strict=True))
    for size in (1, 4):
        cfg = PartitionConfig(k=2, batch_size=size, buffer_size=5, place_surrounded=True)
        b = node.run_kernel(g, cfg)
        assert b.min() >= 0 and np.bincount(b, minlength=2).max() <= capacity(12, 2, cfg.imbalance, True)
    stream_ = buffer.Stream(g.rows()[0], PartitionConfig(k=2, batch_size=1, buffer_size=12, place_surrounded=True), 0.5, [9.0], lambda *_: 9.0)
    placed = []
    commit = stream_.commit
    stream_.commit = lambda v, b, spread=True: (placed.append(v), commit(v, b, spread))
    stream_.first_pass(1)
    assert sorted(placed) == list(range(12)) and len(stream_.queue) == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 7), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(0, 9)), max_size=24))
def test_max_flow_equals_the_least_cut(n, arcs):
    arcs = [(a % n, b % n, c) for a, b, c in arcs if a % n != b % n]
    f = connectivity.FlowNetwork(n)
    for a in arcs:
        f.add(*a)
    cut = lambda side: sum(c for a, b, c in arcs if a in side and b not in side)
    best = min(cut({0, *(v for v in range(1, n - 1) if mask >> v & 1)}) for mask in range(1 << n))
    value, side = f.solve(0, n - 1)
    assert value == best == cut(set(side)) and 0 in side and n - 1 not in side


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from partloom.functions import tables as shared

    there = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://far:7077")
    with pytest.raises(ValueError, match="share"):
        shared.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=there))


def test_stream_goes_on_from_its_place(tmp_path):
    path = tmp_path / "g.metis"
    path.write_text("% a comment\n4 3\n2\n1 3\n% another\n2 4\n\n3")
    r = stream.AdjacencyReader({"path": str(path), "batch": "2"})
    a, at = r.read(r.initialOffset())
    b, end = r.read(at)
    c, last = r.read(end)
    assert (list(a), list(b), list(c), last["line"]) == ([(0, [1]), (1, [0, 2])], [(2, [1, 3]), (3, [])], [(4, [2])], 5)
    assert list(r.readBetweenOffsets(at, end)) == [(2, [1, 3]), (3, [])] and r.read(last)[1] == last
