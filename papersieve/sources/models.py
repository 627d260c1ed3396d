"""Model tables from elsewhere (S8): trees given as arrays of children, or as
node tables with ids of any order and no depth.

:func:`adopt` finds each tree's root, checks that it is a tree, and numbers its
nodes from the root (children of i are 2i + 1 and 2i + 2) with their depth, by a
recursive query; walks, closures and explanations then work as on a tree fitted
here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREE = ["run_id", "tree_id"]
#: Deepest level that a heap number holds.
DEEPEST = 61


def nodes_from_arrays(trees: DataFrame, features: list[str]) -> DataFrame:
    """Node rows of trees written as arrays, one row a tree: run_id, tree_id,
    children_left, children_right (equal at a leaf), feature (index into
    ``features``), threshold, n0, n1 (class counts of each node)."""
    node = F.posexplode(F.arrays_zip("children_left", "children_right", "feature", "threshold", "n0", "n1"))
    rows = trees.select(*TREE, node.alias("node_id", "x")).select(*TREE, "node_id", "x.*")
    inner = F.col("children_left") != F.col("children_right")
    n = F.col("n0") + F.col("n1")
    names = F.array(*[F.lit(f) for f in features])
    share0, share1 = F.try_divide("n0", n), F.try_divide("n1", n)
    return rows.select(
        *TREE, "node_id", F.when(inner, F.element_at(names, F.col("feature") + 1)).alias("feature"),
        F.when(inner, F.col("threshold")).alias("threshold"),
        F.when(inner, F.col("children_left")).otherwise(-1).alias("left_id"),
        F.when(inner, F.col("children_right")).otherwise(-1).alias("right_id"),
        F.col("n0").cast("double").alias("n0"), F.col("n1").cast("double").alias("n1"),
        (1 - share0 * share0 - share1 * share1).alias("impurity"),
        n.cast("long").alias("n_samples"))


def adopt(nodes: DataFrame) -> DataFrame:
    """``nodes`` (run_id, tree_id, node_id, left_id, right_id: below 0 at a leaf,
    and any others) renumbered from each root, with ``depth``.

    Raises unless every tree has one root, every child exists and has one
    parent, and every node is reached; a tree deeper than DEEPEST raises too."""
    spark = nodes.sparkSession
    nodes = nodes.drop("depth")
    total = nodes.count()
    edges = nodes.where("left_id >= 0").select(
        *TREE, F.col("node_id").alias("parent"),
        F.inline(F.array(F.struct(F.lit(1).alias("side"), F.col("left_id").alias("node_id")),
                         F.struct(F.lit(2).alias("side"), F.col("right_id").alias("node_id")))))
    # a walk down from nothing but roots reaches each node of a tree once
    reached = spark.sql(f"""
        WITH RECURSIVE walk(run_id, tree_id, node_id, heap_id, depth)
          MAX RECURSION LEVEL {DEEPEST + 2} AS (
          SELECT n.run_id, n.tree_id, n.node_id, CAST(0 AS BIGINT), 0
          FROM {{nodes}} n LEFT ANTI JOIN {{edges}} e
            ON n.run_id = e.run_id AND n.tree_id = e.tree_id AND n.node_id = e.node_id
          UNION ALL
          SELECT e.run_id, e.tree_id, e.node_id, 2 * w.heap_id + e.side, w.depth + 1
          FROM walk w JOIN {{edges}} e
            ON w.run_id = e.run_id AND w.tree_id = e.tree_id AND w.node_id = e.parent
          WHERE w.depth <= {DEEPEST})
        SELECT * FROM walk""", nodes=nodes, edges=edges)
    from ..config import cut_lineage
    reached = cut_lineage(reached)
    own = nodes.join(reached, [*TREE, "node_id"])
    facts = reached.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(*TREE, "node_id").alias("distinct"),
                        F.max("depth").alias("deep"), F.sum((F.col("depth") == 0).cast("long")).alias("roots"),
                        F.countDistinct(*TREE).alias("trees")).first()
    n_trees = nodes.select(*TREE).distinct().count()
    known = nodes.select(*TREE, "node_id").distinct().count()
    if not (facts["n"] == facts["distinct"] == total == known == own.count()
            and facts["roots"] == facts["trees"] == n_trees):
        raise ValueError("not trees: a node is missing, shared, repeated or not reached from one root")
    if (facts["deep"] or 0) > DEEPEST:
        raise ValueError(f"deeper than {DEEPEST} levels")
    inner = F.col("left_id") >= 0
    left = F.when(inner, 2 * F.col("heap_id") + 1).otherwise(-1)
    right = F.when(inner, 2 * F.col("heap_id") + 2).otherwise(-1)
    put = {"node_id": F.col("heap_id"), "left_id": left, "right_id": right}
    return own.select(*[put.get(c, F.col(c)).alias(c) for c in nodes.columns], "depth")
