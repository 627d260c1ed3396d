"""Decision trees and forests trained as relational, level-wise aggregates
(M3, M4, M5, M6, M10, M11).

Why not MLlib: MLlib merges sibling leaves that predict the same class, which
erases exactly the probability differences a recall-first threshold sweep
needs.  So trees are grown here as DataFrame aggregations:

1. rows collapse to weighted class counts per feature pattern
   (``patterns``): a partial aggregate, so the row count never reaches the
   level loop; with 8 yes/no questions there are at most 256 patterns;
2. every fit (grid configuration x fold x tree) is a ``run_id``/``tree_id``
   key of ONE state table, so thousands of fits are one job per level;
3. per level: unpivot features -> class counts per (fit, node, feature,
   value) -> cumulative left/right counts over sorted values (window over a
   handful of values) -> gain -> constraints -> best split per node
   (row_number) -> children.  Each level's state is checkpointed to the
   shared folder (reliable, survives executor loss).

Node ids are heap ids (children of i are 2i+1, 2i+2) for the first HEAP_LEVELS
levels.  A fit grows until no node can be split.  Ties in gain are broken by
feature order, then threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import cut_lineage
from .grow import GROUP_ROWS, fit_sizes, grown, walked

# Levels numbered as a heap (children of i are 2i+1, 2i+2).  Deeper nodes get
# ids from DEEP_ID on, by their rank in the level, so depth has no limit.
HEAP_LEVELS = 60
DEEP_ID, DEEP_STEP = 1 << 62, 1 << 42
#: Features whose masks fit one number; with more, the level loop grows all fits.
MOST_MASKED = 52

CONFIG_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("criterion", T.StringType()),
    T.StructField("max_depth", T.IntegerType()),
    T.StructField("min_samples_split", T.IntegerType()),
    T.StructField("min_samples_leaf", T.IntegerType()),
    T.StructField("max_features", T.StringType()),
    T.StructField("seed", T.IntegerType()),
])


def configs_df(spark: SparkSession, rows: list[dict]) -> DataFrame:
    def norm(r):
        return (str(r["run_id"]), r.get("criterion", "gini"), r.get("max_depth"),
                int(r.get("min_samples_split", 2)), int(r.get("min_samples_leaf", 1)),
                r.get("max_features") or "all", int(r.get("seed", 42)))
    return spark.createDataFrame([norm(r) for r in rows], CONFIG_SCHEMA)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """M3: 'balanced' weights n / (k * n_c) per class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    return c.select(label, (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c")))
                    .alias("class_weight"))


def patterns(df: DataFrame, features: list[str], label: str = "label",
             keys: list[str] | tuple = (), weight: str | None = None) -> DataFrame:
    """Collapse rows to (keys, features) -> n (samples), w0, w1 (weighted
    class counts).  A partial aggregate: skew-proof and tiny."""
    w = F.col(weight) if weight else F.lit(1.0)
    y = F.col(label)
    return df.groupBy(*keys, *features).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(y == 0, w).otherwise(0.0)).cast("double").alias("w0"),
        F.sum(F.when(y == 1, w).otherwise(0.0)).cast("double").alias("w1"))


def _impurity(w0: F.Column, w1: F.Column, crit: F.Column) -> F.Column:
    n = w0 + w1
    p0 = F.when(n > 0, w0 / n).otherwise(0.0)
    p1 = F.when(n > 0, w1 / n).otherwise(0.0)
    gini = 1.0 - p0 * p0 - p1 * p1
    ent = -(F.when(p0 > 0, p0 * F.log2(p0)).otherwise(0.0)
            + F.when(p1 > 0, p1 * F.log2(p1)).otherwise(0.0))
    return F.when(crit == "gini", gini).otherwise(ent)


def _k_features(max_features: F.Column, n_features: int) -> F.Column:
    return (F.when(max_features == "sqrt", F.lit(max(1, int(math.sqrt(n_features)))))
            .when(max_features == "log2", F.lit(max(1, int(math.log2(n_features)))))
            .otherwise(F.lit(n_features)))


def fit_trees(pats: DataFrame, configs: DataFrame, features: list[str],
              run_keys: tuple = ("run_id", "tree_id"), checkpoint: bool = True) -> DataFrame:
    """M4 + M5 (+ M6 when ``pats`` carries many tree_id): grow every fit in
    ``pats`` (keys run_id, tree_id) under its configuration row.  A configuration
    with ``masked`` (an array of features) grows without these (P9).

    Returns the node table: run_id, tree_id, node_id, depth, feature,
    threshold, left_id, right_id, n0, n1, impurity, n_samples."""
    keys = list(run_keys)
    if "tree_id" not in pats.columns:
        pats = pats.withColumn("tree_id", F.lit(0))
    cfg = F.broadcast(configs)  # one row per run: bounded by the grid
    fidx = {f: i for i, f in enumerate(features)}
    state = (pats.join(cfg, "run_id").withColumn("node_id", F.lit(0).cast("long"))
             .withColumn("depth", F.lit(0)))
    if checkpoint:
        state = cut_lineage(state)
    cfg_cols = [c for c in configs.columns if c != "run_id"]
    state_cols = state.columns
    levels = []
    # every expression below references columns by name only: build once
    nk = keys + ["node_id"]
    crit = F.col("criterion")
    node_aggs = [F.sum("n").alias("ns"), F.sum("w0").alias("nw0"), F.sum("w1").alias("nw1")]
    node_imp = _impurity(F.col("nw0"), F.col("nw1"), crit).alias("imp")
    unpivot = F.inline(F.array(*[
        F.struct(F.lit(i).alias("fi"), F.lit(f).alias("feature"),
                 F.col(f).cast("double").alias("value")) for f, i in fidx.items()]))
    fv_aggs = [F.sum("n").alias("vn"), F.sum("w0").alias("vw0"), F.sum("w1").alias("vw1")]
    wv = Window.partitionBy(*nk, "fi").orderBy("value")
    cum = wv.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wall = Window.partitionBy(*nk, "fi")
    # node totals come from the same (fit, node, feature) partition as the
    # cumulative counts: no separate aggregate or join in the level's job
    cand_cols = [*nk, "depth", *cfg_cols, "fi", "feature",
                 ((F.col("value") + F.lead("value").over(wv)) / 2.0).alias("threshold"),
                 F.sum("vn").over(cum).alias("ln"), F.sum("vw0").over(cum).alias("lw0"),
                 F.sum("vw1").over(cum).alias("lw1"), F.sum("vn").over(wall).alias("ns"),
                 F.sum("vw0").over(wall).alias("nw0"), F.sum("vw1").over(wall).alias("nw1")]
    rn_, rw0, rw1 = (F.col("ns") - F.col("ln"), F.col("nw0") - F.col("lw0"),
                     F.col("nw1") - F.col("lw1"))
    wl, wr, wt = F.col("lw0") + F.col("lw1"), rw0 + rw1, F.col("nw0") + F.col("nw1")
    gain = (F.col("imp") - (wl / wt) * _impurity(F.col("lw0"), F.col("lw1"), crit)
            - (wr / wt) * _impurity(rw0, rw1, crit))
    ok = ((F.col("ln") >= F.col("min_samples_leaf")) & (rn_ >= F.col("min_samples_leaf"))
          & (F.col("ns") >= F.col("min_samples_split")) & (F.col("imp") > 1e-12)
          & (F.col("max_depth").isNull() | (F.col("depth") < F.col("max_depth"))))
    if "masked" in configs.columns:
        ok = ok & ~F.array_contains("masked", F.col("feature"))
    # max_features: a seeded subset of the features that can split here
    feat_rank = F.dense_rank().over(Window.partitionBy(*nk).orderBy(
        F.md5(F.concat_ws("-", F.col("seed").cast("string"),
                          *[F.col(k).cast("string") for k in nk], F.col("feature")))))
    c_cols = [*nk, "fi", "feature", "threshold", "max_features",
              F.round(gain, 12).alias("gain"), feat_rank.alias("_fr")]
    k_ok = F.col("_fr") <= _k_features(F.col("max_features"), len(features))
    best_rank = F.row_number().over(Window.partitionBy(*nk).orderBy(
        F.col("gain").desc(), F.col("fi"), F.col("threshold"))).alias("_r")
    has = F.col("feature").isNotNull()
    lvl_cols = [F.col("run_id"), F.col("tree_id").cast("int"), F.col("node_id"),
                F.col("depth").cast("int"), "feature", "threshold",
                F.when(has, F.col("left_id")).otherwise(-1).cast("long").alias("left_id"),
                F.when(has, F.col("left_id") + 1).otherwise(-1).cast("long").alias("right_id"),
                F.col("nw0").alias("n0"), F.col("nw1").alias("n1"),
                F.col("imp").alias("impurity"), F.col("ns").cast("long").alias("n_samples")]
    pick = F.lit(None).cast("double")
    for f, i in fidx.items():
        pick = F.when(F.col("fi") == i, F.col(f).cast("double")).otherwise(pick)
    nxt = F.when(pick <= F.col("threshold"), F.col("left_id")).otherwise(F.col("left_id") + 1)
    next_cols = [nxt.alias("node_id") if x == "node_id" else
                 (F.col("depth") + 1).alias("depth") if x == "depth" else F.col(x)
                 for x in state_cols]
    level = 0
    while True:
        largest, rows = fit_sizes(state)
        if largest <= GROUP_ROWS and len(features) <= MOST_MASKED:
            levels.append(grown(state, features, rows, _k_features(F.col("max_features"), len(features)),
                                HEAP_LEVELS, DEEP_ID, DEEP_STEP, level))
            break
        node = state.groupBy(*nk, "depth", *cfg_cols).agg(*node_aggs).select("*", node_imp)
        fv = state.select(*nk, "depth", *cfg_cols, "n", "w0", "w1", unpivot).groupBy(
            *nk, "depth", *cfg_cols, "fi", "feature", "value").agg(*fv_aggs)
        cand = (fv.select(*cand_cols).where(F.col("threshold").isNotNull())
                .select("*", _impurity(F.col("nw0"), F.col("nw1"), crit).alias("imp")))
        c = cand.where(ok).select(*c_cols).where(k_ok)
        best = c.select(*nk, "feature", "fi", "threshold", best_rank).where("_r = 1").drop("_r")
        if level < HEAP_LEVELS:
            left = 2 * F.col("node_id") + 1
        else:  # nodes of one level of one tree, ranked: bounded by the model
            rank = F.row_number().over(Window.partitionBy(*keys).orderBy("node_id")) - 1
            left = F.lit(DEEP_ID + (level - HEAP_LEVELS) * DEEP_STEP) + 2 * rank
        best = best.withColumn("left_id", left.cast("long"))
        # node rows of this level are derived from the (checkpointed) state
        # of this level; all levels are computed together in the final job
        levels.append(node.join(best, nk, "left").select(*lvl_cols))
        state = state.join(best, nk).select(*next_cols)
        if checkpoint:
            state = cut_lineage(state)  # the one job of this level
        level += 1
    out = levels[0]
    for lvl in levels[1:]:
        out = out.unionByName(lvl)
    return out


def predict_patterns(pats: DataFrame, nodes: DataFrame, features: list[str],
                     keys: tuple = ("run_id", "tree_id")) -> DataFrame:
    """M10 on patterns: walk each (fit, pattern) to its leaf by threshold
    (value <= threshold goes left); adds leaf_id, probability.  Groups of fits
    are walked inside tasks; where a fit has more than ``grow.GROUP_ROWS``
    patterns or nodes, levels are joined."""
    keys = list(keys)
    n = nodes.select(*keys, "node_id", "feature", "threshold", "left_id", "right_id",
                     (F.col("n1") / (F.col("n0") + F.col("n1"))).alias("p1"))
    pats = cut_lineage(pats)
    if keys == ["run_id", "tree_id"]:
        (most, rows), (nodes_most, node_rows) = fit_sizes(pats), fit_sizes(n)
        if max(most, nodes_most) <= GROUP_ROWS:
            return walked(pats, n, features, rows + node_rows)
    max_depth = nodes.agg(F.max("depth")).first()[0] or 0
    state = pats.withColumn("node_id", F.lit(0).cast("long"))
    pick_expr = None
    for f in features:
        pick_expr = (F.when(F.col("feature") == f, F.col(f).cast("double")) if pick_expr is None
                     else pick_expr.when(F.col("feature") == f, F.col(f).cast("double")))
    cols = state.columns
    for _ in range(max_depth):
        j = state.join(n, keys + ["node_id"], "left")
        nxt = (F.when(F.col("feature").isNull(), F.col("node_id"))
               .when(pick_expr <= F.col("threshold"), F.col("left_id"))
               .otherwise(F.col("right_id")))
        state = j.select(*[nxt.alias("node_id") if c == "node_id" else F.col(c) for c in cols])
    j = state.join(n.select(*keys, "node_id", "p1"), keys + ["node_id"], "left")
    return j.withColumnRenamed("node_id", "leaf_id").withColumnRenamed("p1", "probability")


def cv_scores(pred: DataFrame, group: list[str], threshold: float = 0.5) -> DataFrame:
    """Confusion per group from pattern predictions weighted by the
    pattern's class counts (w0, w1 are held-out sample counts)."""
    p = (F.col("probability") >= F.lit(threshold))
    agg = pred.groupBy(*group).agg(
        F.sum(F.when(p, F.col("w1")).otherwise(0.0)).alias("tp"),
        F.sum(F.when(~p, F.col("w1")).otherwise(0.0)).alias("fn"),
        F.sum(F.when(p, F.col("w0")).otherwise(0.0)).alias("fp"),
        F.sum(F.when(~p, F.col("w0")).otherwise(0.0)).alias("tn"))
    cols = ["tp", "fn", "fp", "tn"]
    agg = agg.select(*group, *[F.col(c).cast("long").alias(c) for c in cols])
    from .metrics import metric_columns
    return agg.select(*group, *cols, *metric_columns())
