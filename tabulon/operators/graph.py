"""Edge-list analytics (Q13): edge count, degrees, density, degree histogram,
shortest path.

The graph is undirected and simple: an edge list ``(source, target)`` is
normalised to unordered pairs and de-duplicated.  Degrees are one
``explode`` + ``groupBy``; the shortest path is a breadth-first search from both
ends, where each round is a join of the frontiers with the edges and with the last
two levels of each side -- the loop runs once for every two levels of the distance, never
per row, and each round is one job that writes its level to the shared checkpoint folder, to
keep the plan short and to survive lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tabulon.session import materialized

#: A frontier that is larger than the other by this factor is not expanded.
UNEVEN = 8


def simple_edges(edges: DataFrame, src: str = "source", dst: str = "target") -> DataFrame:
    """Unordered, de-duplicated pairs ``(a, b)`` with a <= b; self-loops kept once."""
    s, d = F.col(src).cast("string"), F.col(dst).cast("string")
    return (edges.where(s.isNotNull() & d.isNotNull())
            .select(F.least(s, d).alias("a"), F.greatest(s, d).alias("b")).distinct())


def degrees(edges: DataFrame, src: str = "source", dst: str = "target") -> DataFrame:
    """``(node, degree)``; a self-loop adds 2, as in graph theory."""
    e = simple_edges(edges, src, dst)
    return (e.select(F.explode(F.array("a", "b")).alias("node"))
            .groupBy("node").agg(F.count(F.lit(1)).alias("degree")))


def graph_summary(edges: DataFrame, src: str = "source", dst: str = "target") -> DataFrame:
    """One row: ``(n_edges, n_nodes, density, average_degree, max_degree_node,
    max_degree)``; ties for the top degree go to the smallest node name."""
    e = simple_edges(edges, src, dst)
    deg = (e.select(F.explode(F.array("a", "b")).alias("node"))
           .groupBy("node").agg(F.count(F.lit(1)).alias("degree")))
    # every edge adds 2 to the degree sum, so one aggregate gives both counts
    nd = deg.agg((F.sum("degree") / 2).cast("long").alias("n_edges"),
                 F.count(F.lit(1)).alias("n_nodes"),
                 F.min(F.struct((-F.col("degree")).alias("neg"), F.col("node"))).alias("top"))
    v, m = F.col("n_nodes").cast("double"), F.col("n_edges").cast("double")
    return nd.select(
        F.coalesce("n_edges", F.lit(0).cast("long")).alias("n_edges"), "n_nodes",
        F.when(v > 1, 2 * m / (v * (v - 1))).alias("density"),
        F.when(v > 0, 2 * m / v).alias("average_degree"),
        F.col("top.node").alias("max_degree_node"),
        (-F.col("top.neg")).alias("max_degree"))


def degree_histogram(edges: DataFrame, src: str = "source", dst: str = "target") -> DataFrame:
    """``(degree, nodes)``."""
    return degrees(edges, src, dst).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


class _Side:
    """Levels of one search: (node, parent) tables and the rows of the last one."""

    def __init__(self, spark, node: str):
        self.levels = [spark.createDataFrame([(node, None)], "node string, parent string")]
        self.last = 1

    def depth(self) -> int:
        return len(self.levels) - 1

    def add(self, level: DataFrame, rows: int) -> None:
        self.levels.append(level)
        self.last = rows


def _next_level(both: DataFrame, forward: _Side, backward: _Side, sides: list[str]) -> tuple[DataFrame, dict]:
    """The next level of the given sides in one job: (node, pf, pb, f_last, b_last) with the
    smallest parent on either side (null: not of that side's next level), and how
    many rows it has of each side, on the other side's last level, and on both new ones."""
    spark = both.sparkSession
    front = known = None
    for name, side in (("f", forward), ("b", backward)):
        if name in sides:
            own = side.levels[-1].select(F.col("node").alias("a"), F.lit(name).alias("side"))
            front = own if front is None else front.union(own)
        # a neighbour of a level is in the one before, in it or in the next
        for back, level in enumerate(side.levels[:-3:-1]):
            own = level.select("node", F.lit(name).alias("side"), F.lit(back == 0).alias("last"))
            known = own if known is None else known.union(own)
    of = lambda name, col: F.when(F.col("side") == name, F.col(col))
    near = front.join(both, "a").groupBy(F.col("b").alias("node")).agg(
        F.min(of("f", "a")).alias("pf"), F.min(of("b", "a")).alias("pb"))
    known = known.groupBy("node").agg(
        F.max(of("f", "last")).alias("f_last"), F.max(of("b", "last")).alias("b_last"))
    nxt = near.join(known, "node", "left").select(
        "node", F.when(F.col("f_last").isNull(), F.col("pf")).alias("pf"),
        F.when(F.col("b_last").isNull(), F.col("pb")).alias("pb"),
        F.coalesce("f_last", F.lit(False)).alias("f_last"), F.coalesce("b_last", F.lit(False)).alias("b_last")) \
        .where("pf is not null or pb is not null")
    seen = Observation()
    nxt = nxt.observe(seen, F.count("pf").alias("f"), F.count("pb").alias("b"),
                      F.count_if((F.col("pf").isNotNull() & F.col("b_last"))
                                 | (F.col("pb").isNotNull() & F.col("f_last"))).alias("one"),
                      F.count_if(F.col("pf").isNotNull() & F.col("pb").isNotNull()).alias("two"))
    return materialized(nxt), seen.get


def shortest_path(edges: DataFrame, start: str, goal: str, src: str = "source",
                  dst: str = "target", max_depth: int | None = None) -> DataFrame:
    """``(step, node)`` of one shortest path from ``start`` to ``goal``
    (empty when unreachable).  Among equal-length paths, each node's parent
    is the smallest name, so the answer is deterministic.

    The search goes from both ends and meets in the middle.  A round is one job: it
    expands both frontiers, or only the smaller one where the other has over
    ``UNEVEN`` times its nodes.
    """
    spark = edges.sparkSession
    none = spark.createDataFrame([], "step int, node string")
    if start == goal:
        return spark.createDataFrame([(0, start)], "step int, node string")
    e = simple_edges(edges, src, dst)
    # built once (the de-duplication is a shuffle) and reused by every level
    both = materialized(e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    forward, backward = _Side(spark, start), _Side(spark, goal)
    while True:
        left = None if max_depth is None else max_depth - forward.depth() - backward.depth()
        if left is not None and left < 1:
            return none
        small, large = sorted([("f", forward.last), ("b", backward.last)], key=lambda p: p[1])
        sides = [small[0]] if left == 1 or large[1] > UNEVEN * small[1] else ["f", "b"]
        level, seen = _next_level(both, forward, backward, sides)
        if not all(seen[s] for s in sides):
            return none
        f = level.where("pf is not null").select("node", F.col("pf").alias("parent"))
        b = level.where("pb is not null").select("node", F.col("pb").alias("parent"))
        if "f" in sides:
            forward.add(f, seen["f"])
        if "b" in sides and not (seen["one"] and "f" in sides):  # the forward step alone met
            backward.add(b, seen["b"])
        if seen["one"]:
            met = level.where("pf is not null and b_last" if "f" in sides else "pb is not null and f_last")
            break
        if seen["two"]:
            met = level.where("pf is not null and pb is not null")
            break
    # towards the goal: of the backward levels only what lies on a shortest path
    onward = [materialized(met.select("node", F.lit(None).cast("string").alias("parent")))]
    for level in backward.levels[-2::-1]:
        onward.append(materialized(
            onward[-1].select(F.col("node").alias("a")).join(both, "a").groupBy(F.col("b").alias("node"))
            .agg(F.min("a").alias("parent")).join(level.select("node"), "node", "left_semi")))
    path = [goal]  # walk back: one row of each level
    for level in [*onward[:0:-1], *forward.levels[:0:-1]]:
        path.append(level.where(F.col("node") == path[-1]).first()["parent"])
    return spark.createDataFrame(list(enumerate(reversed(path))), "step int, node string")
