"""Problem 2: consolidating pairwise matches into groups.

Method: degree-one vertices are stripped again and again, runs of degree-two vertices are contracted by list
ranking (pointer jumping), the reduced core is solved by alternating large-star and small-star steps, and the
removed vertices get their labels back in the reverse order of removal.

Every step is a DataFrame job on keys of vertices, cut by a table in the shared folder. A hub of any degree only
meets partial aggregates and joins that adaptive execution may split; no vertex's neighbours are ever gathered.

Defined cases: null ends give no link; a self link only makes its vertex known; repeated and reversed links count
once; a vertex without links is its own group; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presq.plans.shared import drop_table, materialize

#: Stripping goes on to chain compression once a pass removes less than this share of the edges.
WORTHWHILE = 0.1
#: Reductions end when the core has this many edges at most; star steps solve what can't be reduced.
SMALL_CORE = 0


def _simple(edges: DataFrame) -> DataFrame:
    """Distinct edges u < v."""
    return (
        edges.where(F.col("u") != F.col("v"))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )


def _both(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, from one scan."""
    return edges.select(
        F.explode(
            F.array(
                F.struct(F.col("u").alias("x"), F.col("v").alias("y")),
                F.struct(F.col("v").alias("x"), F.col("u").alias("y")),
            )
        ).alias("e")
    ).select("e.x", "e.y")


def _strip(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(child, parent) of every degree-one vertex, and the edges left. Of a lone edge the greater end is the child.

    Both are read from one table: each edge with the vertex that leaves by it, if any.
    """
    leaves = _both(edges).groupBy("x").agg(F.count("*").alias("n")).where("n = 1").select("x", F.lit(True).alias("leaf"))
    at = lambda end: leaves.select(F.col("x").alias(end), F.col("leaf").alias(f"leaf_{end}"))
    tagged = edges.join(at("u"), "u", "left").join(at("v"), "v", "left")
    u, v = F.col("leaf_u").isNotNull(), F.col("leaf_v").isNotNull()
    tagged = tagged.select("u", "v", F.when(v, F.col("v")).when(u, F.col("u")).alias("child"), F.when(v, F.col("u")).when(u, F.col("v")).alias("parent"))
    tagged = materialize(tagged, "p2-stripped")
    return tagged.where(F.col("child").isNotNull()).select("child", "parent"), tagged.where(F.col("child").isNull()).select("u", "v")


def _compress(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contracts every run of degree-two vertices; (child, parent) of the removed vertices, and the edges left.

    Arc (x, y) runs from a run's vertex x through its neighbour y; while y has degree two too, the arc jumps to
    where the arc at y ends: after r rounds it spans 2^r vertices. Arcs that never leave belong to a pure cycle.
    """
    arcs = _both(edges)
    deg = arcs.groupBy("x").agg(F.count("*").alias("n"), F.min("y").alias("a"), F.max("y").alias("b"))
    two = materialize(deg.where("n = 2").select("x", "a", "b"), "p2-two")
    n = two.count()
    if n == 0:
        return two.select(F.col("x").alias("child"), F.col("x").alias("parent")).limit(0), edges
    # each vertex has arc 0 (through a) and arc 1 (through b)
    arc = two.select("x", F.explode(F.array(F.struct(F.lit(0).alias("d"), F.col("a").alias("y"), F.col("b").alias("back")), F.struct(F.lit(1).alias("d"), F.col("b").alias("y"), F.col("a").alias("back")))).alias("e")).select("x", "e.d", "e.y")
    step = two.select(F.col("x").alias("y"), F.col("a").alias("ya"), F.col("b").alias("yb"))
    # at y, go on by the arc that doesn't lead back to x; nd is that arc's number
    arc = arc.join(step, "y", "left").select(
        "x", "d", F.col("y").alias("far"),
        F.when(F.col("ya").isNull(), None).when(F.col("ya") == F.col("x"), 1).otherwise(0).alias("nd"),
        F.least("x", "y").alias("low"),
    )
    arc = materialize(arc, "p2-arcs")
    span = 1
    # nd null: the arc has reached its anchor
    while span <= n and not arc.where("nd is not null").isEmpty():
        nxt = arc.select(F.col("x").alias("far"), F.col("d").alias("nd"), F.col("far").alias("far2"), F.col("nd").alias("nd2"), F.col("low").alias("low2"))
        moved = arc.join(nxt, ["far", "nd"], "left").select(
            "x", "d",
            F.when(F.col("nd").isNull(), F.col("far")).otherwise(F.col("far2")).alias("far"),
            F.when(F.col("nd").isNull(), None).otherwise(F.col("nd2")).alias("nd"),
            F.when(F.col("nd").isNull(), F.col("low")).otherwise(F.least("low", "low2")).alias("low"),
        )
        moved = materialize(moved, "p2-arcs")
        drop_table(arc)
        arc, span = moved, span * 2
    runs = arc.groupBy("x").agg(
        F.min(F.when(F.col("nd").isNull(), F.col("far"))).alias("p"),
        F.max(F.when(F.col("nd").isNull(), F.col("far"))).alias("q"),
        F.min("low").alias("low"),
    )
    runs = materialize(runs, "p2-runs")
    # a cycle's least vertex stays as the parent of the others
    gone = runs.select(F.col("x").alias("child"), F.coalesce("p", "low").alias("parent")).where(F.col("child") != F.col("parent"))
    ids = two.select("x")
    left = edges.join(ids.withColumnRenamed("x", "u"), "u", "left_anti")
    left = left.join(ids.withColumnRenamed("x", "v"), "v", "left_anti").select("u", "v")
    left = left.unionByName(runs.where(F.col("p").isNotNull()).select(F.col("p").alias("u"), F.col("q").alias("v")))
    return materialize(gone, "p2-chained"), _simple(left)


def _stars(edges: DataFrame) -> DataFrame:
    """(x, label) of every vertex of the core: alternating large-star and small-star until nothing changes."""
    edges = materialize(edges, "p2-core")
    before = None
    while True:
        arcs = _both(edges)
        low = arcs.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = arcs.join(low, "x").where(F.col("y") > F.col("x")).select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = materialize(small.where("u != v").distinct(), "p2-core")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("x"), F.col("v").alias("label"))
    return materialize(stars.union(edges.select("v", "v")).distinct(), "p2-labels")


def components(links: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, group_id) for every end of links(a, b) and every id of vertices(id); group_id is the group's least id."""
    ends = links.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.col("a").alias("u"), F.col("b").alias("v"))
    known = ends.select(F.explode(F.array("u", "v")).alias("id"))
    if vertices is not None:
        known = known.union(vertices.where(F.col("id").isNotNull()).select("id"))
    known = known.distinct()

    edges = materialize(_simple(ends), "p2-edges")
    count, removed = edges.count(), []
    while count > SMALL_CORE:
        gone, left = _strip(edges)
        after = left.count()
        removed.append(gone)
        slow = count - after < WORTHWHILE * count
        edges, count = left, after
        if slow and count > SMALL_CORE:
            chained, left = _compress(edges)
            left = materialize(left, "p2-edges")
            after = left.count()
            removed.append(chained)
            gain, edges, count = count - after, left, after
            if gain < WORTHWHILE * count:
                break
    labels = _stars(edges)
    for gone in reversed(removed):
        found = gone.withColumnRenamed("parent", "x").join(labels, "x", "left")
        # a parent without a label of its own is the last vertex of its tree: it becomes the label
        found = found.select("child", "x", F.coalesce("label", "x").alias("label"))
        roots = found.where(F.col("label") == F.col("x")).select("x", "label")
        labels = labels.union(found.select(F.col("child").alias("x"), "label")).union(roots).distinct()
        labels = materialize(labels, "p2-labels")
    least = labels.groupBy("label").agg(F.min("x").alias("group_id"))
    named = labels.join(least, "label").select(F.col("x").alias("id"), "group_id")
    return known.join(named, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


def group_sizes(groups: DataFrame) -> DataFrame:
    """Members per group."""
    return groups.groupBy("group_id").agg(F.count("*").alias("members"))


__all__ = ["components", "group_sizes"]
