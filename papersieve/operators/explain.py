"""Explanations over node tables and feature tables.

Node tables are models (size bounded by the tree), so closures over them
are small level loops of joins; nothing here scales with the paper count
except the pattern aggregation that feeds it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import cut_lineage


def mutual_info(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Discrete mutual information (nats) of each feature with the
    label, sorted descending; empty cells contribute nothing."""
    u = df.select(F.col(label).alias("y"), F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])))
    c = u.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("nxy"))
    wf = Window.partitionBy("feature")
    c = (c.withColumn("n", F.sum("nxy").over(wf))
         .withColumn("nx", F.sum("nxy").over(Window.partitionBy("feature", "x")))
         .withColumn("ny", F.sum("nxy").over(Window.partitionBy("feature", "y"))))
    term = (F.col("nxy") / F.col("n")) * F.log((F.col("nxy") * F.col("n")) / (F.col("nx") * F.col("ny")))
    return (c.groupBy("feature").agg(F.round(F.sum(term), 12).alias("mutual_info"))
            .orderBy(F.col("mutual_info").desc(), F.col("feature")))


def is_heap(nodes: DataFrame) -> bool:
    """True when the node table numbers nodes as a heap (children of i are
    2i+1 and 2i+2, as every trained tree here does) and carries depth."""
    if "depth" not in nodes.columns:
        return False
    off = nodes.where((F.col("left_id") >= 0) & ((F.col("left_id") != 2 * F.col("node_id") + 1)
                                                 | (F.col("right_id") != 2 * F.col("node_id") + 2)))
    return off.isEmpty()


def heap_ancestors(nodes: DataFrame) -> DataFrame:
    """Ancestors of heap-numbered nodes by arithmetic, one generator, no
    joins: with j = node_id + 1, the ancestor d levels up is (j >> d) - 1,
    and the node descends from its left child when j >> (d - 1) is even."""
    x = nodes.where(F.col("depth") >= 1).select(
        "run_id", "tree_id", "node_id", (F.col("node_id").cast("long") + 1).alias("_j"),
        F.explode(F.sequence(F.lit(1), F.col("depth").cast("int"))).alias("_d"))
    return x.select("run_id", "tree_id",
                    F.expr("shiftright(_j, _d) - 1").alias("ancestor_id"), "node_id",
                    F.expr("CASE WHEN shiftright(_j, _d - 1) % 2 = 0 THEN 'left' ELSE 'right' END")
                    .alias("side"))


def ancestors(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(run_id, tree_id, node_id, ancestor_id, side) for every proper
    ancestor; ``side`` is 'left'/'right' = which child of the ancestor the
    node descends from.  A level loop of joins over the (small) model."""
    k = ["run_id", "tree_id"]
    if is_heap(nodes):
        return heap_ancestors(nodes)
    edges = (nodes.where(F.col("left_id") >= 0)
             .select(*k, F.col("node_id").alias("ancestor_id"),
                     F.inline(F.array(F.struct(F.col("left_id").alias("node_id"), F.lit("left").alias("side")),
                                      F.struct(F.col("right_id").alias("node_id"), F.lit("right").alias("side"))))))
    if max_depth is None:
        max_depth = nodes.agg(F.max("depth")).first()[0] or 0
    closure = edges
    frontier = edges
    for _ in range(max_depth):
        # extend: ancestor of my ancestor, keeping my side w.r.t. the older one
        nxt = (frontier.alias("f").join(edges.alias("e"), [F.col("f.run_id") == F.col("e.run_id"),
                                                          F.col("f.tree_id") == F.col("e.tree_id"),
                                                          F.col("f.ancestor_id") == F.col("e.node_id")])
               .select(F.col("f.run_id"), F.col("f.tree_id"), F.col("f.node_id"),
                       F.col("e.ancestor_id"), F.col("e.side")))
        frontier = cut_lineage(nxt)
        if frontier.isEmpty():
            break
        closure = closure.unionByName(frontier)
    return closure


def leaf_depth(nodes: DataFrame) -> DataFrame:
    """Depth of every leaf (from the node table)."""
    return nodes.where(F.col("left_id") < 0).select("run_id", "tree_id", "node_id", "depth")


def mean_leaf_depth(nodes: DataFrame) -> DataFrame:
    """Mean depth of each tree's leaves."""
    return leaf_depth(nodes).groupBy("run_id", "tree_id").agg(
        F.round(F.avg("depth"), 9).alias("mean_leaf_depth"), F.count(F.lit(1)).alias("n_leaves"))


def subtree_leaf_counts(nodes: DataFrame, samples: str | None = None) -> DataFrame:
    """Per inner node and side, samples in the side's leaves by the
    leaves' predicted class (larger count, tie -> class 0)."""
    s = F.col(samples) if samples else (F.col("n0") + F.col("n1"))
    leaves = nodes.where(F.col("left_id") < 0).select(
        "run_id", "tree_id", "node_id", s.alias("samples"),
        F.when(F.col("n1") > F.col("n0"), 1).otherwise(0).alias("leaf_class"))
    anc = ancestors(nodes)
    return (anc.join(leaves, ["run_id", "tree_id", "node_id"])
            .groupBy("run_id", "tree_id", "ancestor_id", "side")
            .agg(F.sum(F.when(F.col("leaf_class") == 0, F.col("samples")).otherwise(0)).alias("class0"),
                 F.sum(F.when(F.col("leaf_class") == 1, F.col("samples")).otherwise(0)).alias("class1"))
            .withColumnRenamed("ancestor_id", "node_id"))


def critical_nodes(nodes: DataFrame, threshold: float = 0.9, samples: str | None = None) -> DataFrame:
    """Risk if answered 0 (left) / 1 (right) = share of that side's
    samples ending in class-0 leaves; critical when either exceeds the
    threshold (strictly)."""
    c = subtree_leaf_counts(nodes, samples)
    risk = F.when(F.col("class0") + F.col("class1") > 0,
                  F.col("class0") / (F.col("class0") + F.col("class1"))).otherwise(0.0)
    r = c.withColumn("risk", risk).groupBy("run_id", "tree_id", "node_id").agg(
        F.max(F.when(F.col("side") == "left", F.col("risk"))).alias("risk_if_0"),
        F.max(F.when(F.col("side") == "right", F.col("risk"))).alias("risk_if_1"))
    feat = nodes.select("run_id", "tree_id", "node_id", "feature")
    return (r.join(feat, ["run_id", "tree_id", "node_id"])
            .withColumn("is_critical", (F.col("risk_if_0") > threshold) | (F.col("risk_if_1") > threshold)))


def leaf_paths(nodes: DataFrame, features: list[str]) -> DataFrame:
    """Per leaf: the path as array<struct<fi, go_left, ratio>> where ratio
    is child cover / parent cover (n0 + n1), plus the leaf share p1."""
    cover = nodes.select("run_id", "tree_id", "node_id", (F.col("n0") + F.col("n1")).alias("cover"))
    fpos = F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f), F.lit(i))])
    anc = ancestors(nodes)
    par = nodes.select("run_id", "tree_id", F.col("node_id").alias("ancestor_id"),
                       F.element_at(fpos, F.col("feature")).alias("fi"),
                       F.col("threshold"), F.col("left_id"), F.col("right_id"),
                       (F.col("n0") + F.col("n1")).alias("pcover"))
    kid = cover.select("run_id", "tree_id", F.col("node_id").alias("kid"), F.col("cover").alias("kcover"))
    steps = (anc.join(par, ["run_id", "tree_id", "ancestor_id"])
             .withColumn("kid", F.when(F.col("side") == "left", F.col("left_id")).otherwise(F.col("right_id")))
             .join(kid, ["run_id", "tree_id", "kid"])
             .select("run_id", "tree_id", "node_id", F.struct(
                 F.col("fi"), (F.col("side") == "left").alias("go_left"),
                 F.col("threshold"), (F.col("kcover") / F.col("pcover")).alias("ratio")).alias("st")))
    leaves = nodes.where(F.col("left_id") < 0).select(
        "run_id", "tree_id", "node_id", (F.col("n1") / (F.col("n0") + F.col("n1"))).alias("p1"))
    return leaves.join(steps.groupBy("run_id", "tree_id", "node_id")
                       .agg(F.collect_list("st").alias("path")),  # one path: <= depth steps
                       ["run_id", "tree_id", "node_id"], "left")


def shap_values(pats: DataFrame, nodes: DataFrame, features: list[str]) -> DataFrame:
    """Exact path-dependent Shapley values per distinct pattern, averaged
    over the trees of ``nodes``.

    A leaf's share p1 counts as far as the pattern follows its path (1 or 0)
    for known features and by the cover ratio for unknown ones, so each leaf is
    a game over its path's own features alone; the sum over coalitions is the
    product of (ratio + follows * t) over the other features, its coefficients
    weighted by |S|!(d-|S|-1)!/d!.  Work is patterns x leaves x d^3, d the
    features of a path: no list of coalitions.  The leaves are the model; they
    go to the tasks with the function, in whose batches patterns are vectors.
    Returns pattern features, base_value, prediction, phi_<feature>."""
    import numpy as np
    n_trees = nodes.select("run_id", "tree_id").distinct().count()
    games = []
    for r in leaf_paths(nodes, features).toLocalIterator():
        box: dict[int, list[float]] = {}
        for st in r["path"] or []:
            lo, hi, z = box.get(st["fi"], (-np.inf, np.inf, 1.0))
            lo, hi = (lo, min(hi, st["threshold"])) if st["go_left"] else (max(lo, st["threshold"]), hi)
            box[st["fi"]] = (lo, hi, z * st["ratio"])
        games.append((float(r["p1"]) / n_trees, box))
    weights = [[math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)]
               for d in range(len(features) + 1)]
    base = sum(p1 * math.prod(z for _lo, _hi, z in box.values()) for p1, box in games)

    def explain(batches):
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=float)
            phi, full = np.zeros((len(x), len(features))), np.zeros(len(x))
            for p1, box in games:
                at = list(box)
                on = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float)
                      for f, (lo, hi, _z) in box.items()]
                z = [v[2] for v in box.values()]
                full += p1 * np.prod(on, axis=0) if at else p1
                for i, f in enumerate(at):
                    poly = [np.ones(len(x))]
                    for j in range(len(at)):
                        if j != i:
                            poly = [(poly[k] * z[j] if k < len(poly) else 0.0)
                                    + (poly[k - 1] * on[j] if k else 0.0)
                                    for k in range(len(poly) + 1)]
                    phi[:, f] += p1 * (on[i] - z[i]) * sum(
                        w * c for w, c in zip(weights[len(at)], poly, strict=True))
            out = pdf[features].copy()
            out["base_value"], out["prediction"] = base, full
            for i, f in enumerate(features):
                out["phi_" + f] = phi[:, i]
            yield out

    p = pats.select(*features).distinct()
    from pyspark.sql import types as T
    schema = T.StructType([*p.schema.fields, *[T.StructField(c, T.DoubleType()) for c in (
        "base_value", "prediction", *["phi_" + f for f in features])]])
    return p.mapInPandas(explain, schema)


def shap_summary(rows: DataFrame, shap: DataFrame, features: list[str]) -> DataFrame:
    """Mean |phi| per feature over rows (patterns joined back, broadcast)."""
    from ..config import bounded_broadcast
    j = rows.select(*features).join(bounded_broadcast(shap), features)
    return j.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"),
                                                F.abs(F.col("phi_" + f)).alias("a")) for f in features]))) \
            .groupBy("feature").agg(F.avg("a").alias("mean_abs_shap"))

