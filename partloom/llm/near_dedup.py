"""Near-duplicate detection: MinHash with tensored banding, candidates verified on full shingle sets.

* Sketch.  A document's distinct five-word shingles become 64-bit hashes.  Two small collections of ``m`` keys, A and B, each key
  joining ``k`` minhashes, are computed: 2mk hash functions.  The tables are their tensor product: table (i, j) has the key
  (A_i, B_j), so m^2 tables of width 2k come from the hash work of 2m keys.  A pair of similarity s meets in some table
  with probability (1 - (1 - s^k)^m)^2; ``m`` is chosen so that a pair at the threshold is missed with probability ``miss``.
* Copies.  Documents with one set of shingles are one class from here on, so a hot text weighs as one node.
* Tables.  A pair that shares (A_i, B_j) shares A_i and B_j; keys that one class alone has are dropped from each collection before the product is formed, which
  for most documents leaves nothing to form.  In each table a class is linked to the table's least class only: a star, no pairs.
* Clusters.  Components of these stars are closed under meeting in a table, so all candidate pairs lie inside clusters.
* Verification.  A class counts as much as ``CHUNK_SHINGLES`` / ``chunk`` shingles at least, and as its shingles beyond that, so that a chunk is bounded in classes and in bytes.  In a cluster of more than a chunk each class is first compared in full with the stars it shares most tables with, in groups of bounded size.
  What these links connect is a part; the cluster's largest part needs no comparing within itself, which is all of the cluster if its texts are alike.
  The classes left over, with their full sets, are dealt to chunks by a hash, and so are those of the largest part; each pair of chunks of which one is left over is one task of bounded size.
  A task compares signatures (all candidates that could reach the threshold, five standard deviations allowed), then full sets, and skips what is
  already connected: it emits a spanning forest of the links it confirmed, which loses no connection.
* Components of the confirmed links are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.connectivity import components
from ._common import settle, shuffle_partitions, text_of

SHINGLE = 5
#: Classes of a chunk, and shingles (8 bytes each).
CHUNK = 1024
CHUNK_SHINGLES = 1 << 24
#: Stars that a class of a large cluster is compared with before the rest is compared exhaustively.
STARS = 4
_M64 = (1 << 64) - 1


def tables_for(threshold: float, k: int, miss: float) -> int:
    """Keys per collection such that a pair at the threshold is missed with probability ``miss`` at most."""
    return max(1, math.ceil(math.log(miss / 2) / math.log(1 - threshold**k)))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles. Words are hashed once per worker and kept in a table of bounded size."""

    def __init__(self, width: int = SHINGLE, most: int = 1_000_000):
        self.width, self.most, self.words = width, most, {}
        self.powers = _constants(width)[0]

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        found = text.encode().lower().split()  # bytes: ASCII letters and the six ASCII spaces only
        if not found:
            return np.empty(0, np.uint64)
        table = self.words
        if len(table) > self.most:
            table.clear()
        try:
            h = np.fromiter(map(table.__getitem__, found), np.uint64, len(found))
        except KeyError:
            for w in found:
                if w not in table:
                    table[w] = xxhash.xxh64_intdigest(w)
            h = np.fromiter(map(table.__getitem__, found), np.uint64, len(found))
        if len(h) < self.width:  # the whole sequence is the one shingle; its length is part of it
            x = np.array([len(h)], np.uint64)
            for i in range(len(h)):
                x = _mix(x * self.powers[:1] + h[i : i + 1])
            return x
        n = len(h) - self.width + 1
        x = np.zeros(n, np.uint64)
        for i, p in enumerate(self.powers):
            x += _mix(h[i : i + n] * p + np.uint64(i))
        return np.unique(_mix(x))


def signature(shingles: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Minima of the shingles under each hash function (multiply-add modulo 2^64, the high half compared)."""
    out = np.full(len(mul), np.uint64(_M64))
    step = max(1, 65536 // max(1, len(shingles)))
    for f in range(0, len(mul), step):
        block = shingles[None, :] * mul[f : f + step, None] + add[f : f + step, None]
        out[f : f + step] = block.min(axis=1)
    return out >> np.uint64(32)


def _digest(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else b""


def sketch(docs: DataFrame, id_col: str, text_col: str, k: int, m: int) -> DataFrame:
    """id, n_shingles, digest (of the whole set; null if empty), a_keys, b_keys. The whole text is read, no shuffle."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, (mul, add) = Shingler(), _constants(2 * m * k)
        fold = _constants(k)[0]
        for batch in batches:
            counts, digests, a_keys, b_keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingler(text)
                counts.append(len(s))
                if not len(s):
                    digests.append(None), a_keys.append(None), b_keys.append(None)
                    continue
                digests.append(_digest(s))
                sig = signature(s, mul, add).reshape(2 * m, k)
                keys = _mix((_mix(sig + fold) * fold).sum(axis=1, dtype=np.uint64)).view(np.int64)
                a_keys.append(keys[:m]), b_keys.append(keys[m:])
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(a_keys, lists), pa.array(b_keys, lists)], ["id", "n_shingles", "digest", "a_keys", "b_keys"])

    return docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("t")).mapInArrow(run, f"id {kind}, n_shingles long, digest binary, a_keys array<long>, b_keys array<long>")


def _shared(classes: DataFrame, column: str) -> DataFrame:
    """node and its keys (i, key) of one collection that some other class has too."""
    rows = classes.select("node", F.posexplode(column).alias("i", "key"))
    often = rows.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.struct("i", "key").alias("k"))
    return rows.withColumn("k", F.struct("i", "key")).join(often, "k", "left_semi").groupBy("node").agg(F.collect_list(F.struct("i", "key")).alias(column))


def candidate_stars(classes: DataFrame) -> DataFrame:
    """node, star, tables: in each table of the product in which a class meets another the table's least class is the star; tables counts those of a node and its star."""
    both = _shared(classes, "a_keys").join(_shared(classes, "b_keys"), "node")
    tables = both.select("node", F.explode("a_keys").alias("x"), "b_keys").select("node", "x", F.explode("b_keys").alias("y"))
    tables = tables.select("node", F.struct(F.xxhash64("x.i", "x.key", "y.i", "y.key").alias("k1"), F.xxhash64("y.key", "x.key", "y.i", "x.i").alias("k2")).alias("k"))
    stars = tables.groupBy("k.k1", "k.k2").agg(F.min("node").alias("star"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.struct("k1", "k2").alias("k"), "star")
    return tables.join(stars, "k").where("node <> star").groupBy("node", "star").agg(F.count(F.lit(1)).alias("tables"))


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.find(x)] = self.find(y)


def _alike(x: np.ndarray, y: np.ndarray, numerator: int, denominator: int) -> bool:
    """denominator * |both| >= numerator * |either|."""
    if denominator * min(len(x), len(y)) < numerator * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return denominator * both >= numerator * (len(x) + len(y) - both)


def confirm(nodes: list[bytes], sides: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], numerator: int, denominator: int, hashes: int = 64) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links in one task: pairs with denominator * |both| >= numerator * |either|.

    If both sides are present only pairs between them count (each chunk by itself is another task's). Classes of one part are connected already.
    Pairs are ruled out by size and by signature, then compared in full, most alike first.
    """
    n = len(nodes)
    t = numerator / denominator
    mul, add = _constants(4096)
    mul, add = mul[-hashes:], add[-hashes:]
    sizes = np.array([len(s) for s in sets])
    sig = np.stack([signature(s, mul, add) for s in sets]).astype(np.uint32)
    floor = max(0, math.floor(hashes * (t - 5 * math.sqrt(t * (1 - t) / hashes))))
    forest, out = _Forest(n), []
    two = bool(sides.min() != sides.max())
    order = np.argsort(sizes, kind="stable")
    sizes_in_order = sizes[order]
    found: list[np.ndarray] = []
    for r in range(n):
        i = order[r]
        # Partners at least as large, and not larger than size / t.
        end = int(np.searchsorted(sizes_in_order, sizes[i] / t + 1e-9, side="right"))
        others = order[r + 1 : end]
        if two:
            others = others[sides[others] != sides[i]]
        others = others[parts[others] != parts[i]]
        if not len(others):
            continue
        alike = (sig[others] == sig[i]).sum(axis=1)
        hit = np.flatnonzero(alike >= floor)
        if len(hit):
            found.append(np.stack([alike[hit], np.full(len(hit), i), others[hit]], axis=1))
        # Bounded memory: what has gathered is settled before more comes.
        if sum(map(len, found)) > 200_000:
            _settle(found, forest, out, nodes, sets, numerator, denominator)
            found = []
    _settle(found, forest, out, nodes, sets, numerator, denominator)
    return out


def _settle(found, forest, out, nodes, sets, numerator, denominator) -> None:
    if not found:
        return
    pairs = np.concatenate(found)
    for _, i, j in pairs[np.argsort(-pairs[:, 0], kind="stable")].tolist():
        if forest.find(i) == forest.find(j):
            continue
        if _alike(sets[i], sets[j], numerator, denominator):
            forest.join(i, j)
            out.append((nodes[i], nodes[j]))


def _full_sets(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, cluster, n and the whole set (sorted 64-bit hashes) of each class, from the text of one of its documents."""
    texts = docs.select(docs[id_col].alias("doc"), text_of(docs, text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            node, cluster, n, t = (c.to_pylist() for c in batch.columns)
            rows = [(x, c, k, s.tobytes()) for x, c, k, y in zip(node, cluster, n, t, strict=True) if _digest(s := shingler(y)) == x]  # else another document under this id
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.binary(), pa.binary(), pa.int64(), pa.binary()))], ["node", "cluster", "n", "shingles"])

    return texts.join(classes, texts["doc"].eqNullSafe(classes["id"])).select("node", "cluster", "n", "t").mapInArrow(run, "node binary, cluster binary, n long, shingles binary")


def _star_links(held: DataFrame, stars: DataFrame, numerator: int, denominator: int, chunk: int) -> DataFrame:
    """a, b: confirmed links between classes of large clusters and the ``STARS`` stars they share most tables with. A hot star's classes are dealt to groups of about ``chunk``."""
    spark = held.sparkSession
    best = stars.join(held.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("tables", "star")), asc=False), 1, STARS).alias("best"))
    pairs = settle(best.select("node", F.explode("best.star").alias("star")))
    groups = pairs.groupBy("star").agg(F.ceil(F.count(F.lit(1)) / float(chunk)).cast("int").alias("groups"))
    own = pairs.withColumn("k", F.struct("star")).join(groups.select(F.struct("star").alias("k"), "groups"), "k").select("star", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int").alias("group"), "node")
    heads = groups.select("star", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.col("star").alias("node"))
    rows = own.unionByName(heads).join(held.select("node", "shingles"), "node")
    rows = rows.repartition(shuffle_partitions(spark), "star", "group").select("star", "group", "node", "shingles", (F.col("node") != F.col("star")).alias("later")).sortWithinPartitions("star", "group", "later")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head, head_set = None, None, None
        for batch in batches:
            links = []
            for star, group, node, shingles in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                if (star, group) != key:
                    key, head, head_set = (star, group), node, np.frombuffer(shingles, np.uint64)
                elif node != head == star and _alike(head_set, np.frombuffer(shingles, np.uint64), numerator, denominator):
                    links.append((node, star))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], ["a", "b"])

    return rows.mapInArrow(check, "a binary, b binary")


def _dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Tasks of pairs of chunks. rows: node, cluster, part, main, shingles; sizes: cluster, rest, bulk (chunks of what is left over and of the largest part).

    A chunk of what is left over meets every chunk, one of the largest part those left over only.
    """
    at = rows.withColumn("k", F.struct("cluster")).join(sizes.select(F.struct("cluster").alias("k"), "rest", "bulk"), "k")
    h = F.xxhash64("node")
    at = at.withColumn("own", F.when(F.col("main"), F.col("rest") + F.pmod(h, F.greatest("bulk", F.lit(1)))).otherwise(F.pmod(h, F.greatest("rest", F.lit(1)))).cast("int"))
    at = at.where("rest > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rest") + F.when(F.col("main"), 0).otherwise(F.col("bulk")) - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    return at.select(F.xxhash64("cluster", lo, hi).alias("task"), "cluster", lo.alias("lo"), hi.alias("hi"), "own", "node", "part", "shingles")


def _verified(docs: DataFrame, members: DataFrame, stars: DataFrame, id_col: str, text_col: str, numerator: int, denominator: int, chunk: int) -> DataFrame:
    """a, b: confirmed links between classes. members: node, id (of one document of the class), n_shingles, cluster; stars: node, star, tables."""
    spark = docs.sparkSession
    members = members.withColumn("cost", F.greatest(F.lit(1), F.ceil(F.col("n_shingles") * float(chunk) / CHUNK_SHINGLES)).cast("long"))
    sizes = members.groupBy("cluster").agg(F.sum("cost").alias("n")).select(F.struct("cluster").alias("k"), "n")
    placed = settle(members.withColumn("k", F.struct("cluster")).join(sizes, "k").select("node", "id", "cluster", "cost", "n"))
    # A small cluster is one task.
    small = _full_sets(docs, placed.where(F.col("n") <= chunk), id_col, text_col)
    tasks = small.select(F.xxhash64("cluster", F.lit(0), F.lit(0)).alias("task"), "cluster", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("own"), "node", F.col("node").alias("part"), "shingles")
    large, first = placed.where(F.col("n") > chunk), None
    if not large.isEmpty():
        held = settle(_full_sets(docs, large, id_col, text_col))
        first = settle(_star_links(held, stars, numerator, denominator, chunk))
        roots = components(first, "a", "b").select(F.col("node_id").alias("x"), F.col("component").alias("root"))
        parts = large.select("node", "cluster", "cost").distinct().join(roots, F.col("node") == F.col("x"), "left").select("node", "cluster", "cost", F.coalesce("root", "node").alias("part"))
        parts = settle(parts)
        by_part = parts.groupBy("cluster", "part").agg(F.sum("cost").alias("n"))
        main = by_part.groupBy("cluster").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("n"))
        chunks = lambda x: F.ceil(x / float(chunk)).cast("int")
        main = settle(main.select("cluster", F.col("top.part").alias("largest"), chunks(F.col("n") - F.col("top.n")).alias("rest"), chunks(F.col("top.n")).alias("bulk")))
        # Clusters of one part are done.
        todo = parts.withColumn("k", F.struct("cluster")).join(main.where("rest > 0").select(F.struct("cluster").alias("k"), "largest"), "k").select(F.col("node").alias("x"), "part", (F.col("part") == F.col("largest")).alias("main"))
        tasks = tasks.unionByName(_dealt(held.join(todo, F.col("node") == F.col("x")).select("node", "cluster", "part", "main", "shingles"), main))
    tasks = tasks.repartition(shuffle_partitions(spark), "task").sortWithinPartitions("cluster", "lo", "hi", "node")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, {}

        def close() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                nodes = list(rows)
                parts = np.unique([rows[x][1].hex() for x in nodes], return_inverse=True)[1]
                links = confirm(nodes, np.array([rows[x][0] for x in nodes]), parts, [rows[x][2] for x in nodes], numerator, denominator)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            _, cluster, lo, hi, own, node, part, shingles = (c.to_pylist() for c in batch.columns)
            for c, x, y, o, n, p, s in zip(cluster, lo, hi, own, node, part, shingles, strict=True):
                if (c, x, y) != key:
                    yield from close()
                    key, rows = (c, x, y), {}
                rows[n] = (o, p, np.frombuffer(s, np.uint64))
        yield from close()

    links = tasks.mapInArrow(check, "a binary, b binary")
    return links if first is None else links.unionByName(first)


def near_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", numerator: int = 80, denominator: int = 100, k: int = 4, miss: float = 1e-5, chunk: int = CHUNK,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the least id reachable, its own included) and kept.

    Documents are linked when denominator * |intersection| >= numerator * |union| of their sets of five-word shingles, ASCII letters in lower case.  A text of
    one to four words is one shingle; without words or text the set is empty, and the document is linked with nothing.  Null ids are
    the largest; rows that repeat an id stand or fall together. Other columns are not read. An empty table gives no rows.
    """
    m = tables_for(numerator / denominator, k, miss)
    rows = settle(sketch(docs, id_col, text_col, k, m))
    classes = rows.where("digest is not null").groupBy(F.col("digest").alias("node")).agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("a_keys").alias("a_keys"), F.first("b_keys").alias("b_keys"))
    classes = settle(classes)
    stars = settle(candidate_stars(classes))
    clusters = components(stars, "node", "star")
    members = clusters.select(F.col("node_id").alias("node"), F.col("component").alias("cluster")).join(classes.select("node", "id", "n_shingles"), "node")
    links = settle(_verified(docs, members, stars, id_col, text_col, numerator, denominator, chunk))
    roots = components(links, "a", "b").select(F.col("node_id").alias("node"), F.col("component").alias("root"))
    labels = classes.select("node", "id").join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    labels = settle(labels)
    least = labels.groupBy("root").agg(F.min("id").alias("component_id")).select(F.struct("root").alias("k"), "component_id")
    labels = labels.withColumn("k", F.struct("root")).join(least, "k").select(F.struct("node").alias("k"), "component_id")
    out = rows.select("id", "n_shingles", F.struct(F.col("digest").alias("node")).alias("k")).join(labels, "k", "left")
    component = F.when(F.col("k.node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each group, all columns as they were."""
    gone = near_groups(docs, id_col=id_col, **options).where("not kept").select(F.col(id_col).alias("__gone"))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__gone"]), "left_anti")
