"""Connected and strongly connected components, topological layers and maximum flow."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import settle


def _pointed(sym: DataFrame) -> DataFrame:
    """src, dst, m with m the least of src and its neighbours; both join sides are dealt anew, so that a hot vertex's side can be split."""
    least = sym.groupBy("src").agg(F.min("dst").alias("m")).select(F.struct("src").alias("k"), F.least("src", "m").alias("m"))
    return sym.withColumn("k", F.struct("src")).join(least, "k").drop("k")


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """node_id, component (its least vertex) of every vertex with an edge to another, by alternating large-star and small-star steps. Ids may be of any ordered type; rows with a null end are ignored.

    Each round halves long paths at least; stars end in two.  Rounds write their edges to the shared folder and let go of the shuffle files of the round before.
    """
    ends = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src is not null and dst is not null")
    now = settle(ends.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct())
    mark = None
    while True:
        # Large star: what is greater than a vertex points at the least of its surroundings.
        both = F.explode(F.array(F.struct(F.col("src").alias("x"), F.col("dst").alias("y")), F.struct(F.col("dst").alias("x"), F.col("src").alias("y")))).alias("e")
        sym = now.select(both).select(F.col("e.x").alias("src"), F.col("e.y").alias("dst"))
        large = _pointed(sym).where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst")
        # Small star: a vertex and what it points at point at the least of these.
        small = _pointed(large).select(F.explode(F.array("src", "dst")).alias("x"), "m").where("x <> m").select(F.col("x").alias("src"), F.col("m").alias("dst")).distinct()
        now = settle(small)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    roots = now.select(F.col("src").alias("node_id"), F.col("dst").alias("component"))
    return roots.unionByName(now.select(F.col("dst").alias("node_id"), F.col("dst").alias("component")).distinct())


def strong_components(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, component of a directed graph (src, dst): rounds of forward colouring by the least id and backward search inside of each colour.

    A colour's root reaches everything of its colour; what also reaches the root is its component, and is taken out.
    """
    left = nodes.select("node_id")
    e = arcs.select("src", "dst").where("src <> dst").distinct()
    done: DataFrame | None = None
    while True:
        colour = _spread(e, left.select("node_id", F.col("node_id").alias("c")))
        inside = e.join(colour.select(F.col("node_id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node_id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst", "cs")
        inside = settle(inside)
        reached = settle(colour.where("node_id = c").select("node_id", "c"))
        front = reached
        while True:
            back = inside.join(front.select(F.col("node_id").alias("dst")), "dst").select(F.col("src").alias("node_id"), F.col("cs").alias("c")).distinct()
            front = settle(back.join(reached, "node_id", "left_anti"))
            if front.isEmpty():
                break
            reached = settle(reached.unionByName(front))
        found = reached.select("node_id", F.col("c").alias("component"))
        done = found if done is None else done.unionByName(found)
        left = settle(left.join(reached, "node_id", "left_anti"))
        if left.isEmpty():
            return done
        e = settle(e.join(left.select(F.col("node_id").alias("src")), "src", "left_semi").join(left.select(F.col("node_id").alias("dst")), "dst", "left_semi"))


def _spread(arcs: DataFrame, label: DataFrame) -> DataFrame:
    """The least label that reaches each vertex along arcs."""
    label = settle(label)
    while True:
        near = arcs.join(label.select(F.col("node_id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("node_id")).agg(F.min("c").alias("n"))
        new = settle(label.join(near, "node_id", "left").select("node_id", F.col("c").alias("old"), F.least("c", F.coalesce("n", "c")).alias("c")))
        if new.where("c <> old").isEmpty():
            return new.select("node_id", "c")
        label = new.select("node_id", "c")


def topological_layers(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, layer: vertices without predecessors are layer 0 and are peeled off, and so on; ordering by (layer, node_id) is topological. A cycle is an error."""
    left, e, done, layer = nodes.select("node_id"), arcs.select("src", "dst").distinct(), None, 0
    while True:
        sources = left.join(e.select(F.col("dst").alias("node_id")).distinct(), "node_id", "left_anti")
        found = settle(sources.withColumn("layer", F.lit(layer)))
        if found.isEmpty():
            if not left.isEmpty():
                raise ValueError("the graph has a cycle")
            return done if done is not None else found
        done = found if done is None else done.unionByName(found)
        left = settle(left.join(found, "node_id", "left_anti"))
        e = settle(e.join(found.select(F.col("node_id").alias("src")), "src", "left_anti"))
        layer += 1


class FlowNetwork:
    """Maximum flow on a bounded network by push and relabel: active vertices in first-in-first-out order, heights set anew by a search from the sink after every n relabels,
    vertices above a gap in the heights lifted past the source at once."""

    def __init__(self, n: int):
        self.n, self.to, self.cap, self.at = n, [], [], [[] for _ in range(n)]

    def add(self, a: int, b: int, capacity: int, back: int = 0) -> None:
        for x, y, c in ((a, b, capacity), (b, a, back)):
            self.at[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)

    def _distances(self, t: int, s: int) -> list[int]:
        """Arcs with room from each vertex to t; where there is no way n and those to the source, to which its excess goes back."""
        far = [2 * self.n] * self.n
        far[s] = self.n
        for end, base in ((t, 0), (s, self.n)):
            far[end], queue = base, deque([end])
            while queue:
                x = queue.popleft()
                for e in self.at[x]:
                    y = self.to[e]
                    if self.cap[e ^ 1] > 0 and far[y] == 2 * self.n:
                        far[y] = far[x] + 1
                        queue.append(y)
        return far

    def _lift(self, x: int, height: list[int], level: list[int]) -> None:
        """Relabel x; if its level empties, all below n and above it can't reach the sink any more."""
        old = height[x]
        new = min((height[self.to[e]] + 1 for e in self.at[x] if self.cap[e] > 0), default=2 * self.n)
        height[x] = min(new, 2 * self.n)
        level[old] -= 1
        level[height[x]] += 1
        if level[old] == 0 and old < self.n:
            for v in range(self.n):
                if old < height[v] < self.n:
                    level[height[v]] -= 1
                    height[v] = self.n + 1
                    level[self.n + 1] += 1

    def solve(self, s: int, t: int) -> tuple[int, list[int]]:
        """(value, source side of a least cut)."""
        n = self.n
        excess, turn, active, waits = [0] * n, [0] * n, deque(), [False] * n

        def levels() -> list[int]:
            out = [0] * (2 * n + 2)
            for h in height:
                out[h] += 1
            return out

        def push(e: int, x: int, amount: int) -> None:
            y = self.to[e]
            self.cap[e] -= amount
            self.cap[e ^ 1] += amount
            excess[x] -= amount
            excess[y] += amount
            if y not in (s, t) and not waits[y]:
                waits[y] = True
                active.append(y)

        for e in self.at[s]:
            if self.cap[e] > 0:
                push(e, s, self.cap[e])
        height = self._distances(t, s)
        level, lifted = levels(), 0
        while active:
            x = active.popleft()
            waits[x] = False
            while excess[x] > 0 and height[x] < 2 * n:
                if turn[x] == len(self.at[x]):
                    self._lift(x, height, level)
                    turn[x], lifted = 0, lifted + 1
                    continue
                e = self.at[x][turn[x]]
                if self.cap[e] > 0 and height[x] == height[self.to[e]] + 1:
                    push(e, x, min(excess[x], self.cap[e]))
                else:
                    turn[x] += 1
            if lifted >= n:  # never lower than before
                height = [max(a, b) if b < 2 * n else a for a, b in zip(height, self._distances(t, s), strict=True)]
                level, turn, lifted = levels(), [0] * n, 0
        side, queue = {s}, deque([s])
        while queue:
            for e in self.at[queue.popleft()]:
                if self.cap[e] > 0 and self.to[e] not in side:
                    side.add(self.to[e])
                    queue.append(self.to[e])
        return excess[t], sorted(side)
