"""Trees as node tables, and walking papers down them.

Node table (one row per node, a forest is many ``tree_id``):
    run_id, tree_id, node_id, depth, feature, threshold, left_id, right_id,
    n0, n1, impurity
``enrich_nodes`` adds p1 (F11), is_leaf, left_p1, right_p1 and unsure_id.

Walking (C2 / M10) is a level loop on the driver; each level is one
broadcast hash join of the paper frontier with the node table, so a whole
walk of depth D is D+1 map-side joins in ONE stage: no shuffle, and the
paper table never leaves its partitions.  The node table is a model: its
size is bounded by the tree, and it is broadcast only behind that check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import bounded_broadcast
from ..constants import FIXTURE_TREE
from ..functions.answers import positive_share

NODE_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("tree_id", T.IntegerType()),
    T.StructField("node_id", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("feature", T.StringType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("left_id", T.IntegerType()),
    T.StructField("right_id", T.IntegerType()),
    T.StructField("n0", T.DoubleType()),
    T.StructField("n1", T.DoubleType()),
    T.StructField("impurity", T.DoubleType()),
])

def trace_step(id_type: T.DataType) -> T.StructType:
    """A step of a trace, its node id of the node table's type."""
    return T.StructType([
        T.StructField("step", T.IntegerType()),
        T.StructField("node_id", id_type),
        T.StructField("question_id", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("inclusion_score", T.DoubleType()),
    ])


TRACE_STEP = trace_step(T.IntegerType())


def _gini(n0: float, n1: float) -> float:
    n = n0 + n1
    return 0.0 if n == 0 else 1.0 - (n0 / n) ** 2 - (n1 / n) ** 2


def fixture_nodes(spark: SparkSession, run_id: str = "fixture") -> DataFrame:
    """The hand-made node table of FIXTURES.md C.1."""
    depth = {0: 0}
    for node, _f, left, right, _n0, _n1 in FIXTURE_TREE:
        if left >= 0:
            depth[left] = depth[node] + 1
            depth[right] = depth[node] + 1
    rows = [(run_id, 0, node, depth[node], feat, 0.5 if feat else None, left, right,
             float(n0), float(n1), _gini(n0, n1))
            for node, feat, left, right, n0, n1 in FIXTURE_TREE]
    return spark.createDataFrame(rows, NODE_SCHEMA)


def enrich_nodes(nodes: DataFrame) -> DataFrame:
    """Add p1, is_leaf, child shares and the UNSURE child (higher positive
    share goes left only when strictly higher; a tie goes right)."""
    base = nodes.withColumn("p1", positive_share("n0", "n1")) \
                .withColumn("is_leaf", F.col("feature").isNull())
    kids = base.select("run_id", "tree_id", "node_id", "p1")
    lk = kids.select("run_id", "tree_id", F.col("node_id").alias("left_id"),
                     F.col("p1").alias("left_p1"))
    rk = kids.select("run_id", "tree_id", F.col("node_id").alias("right_id"),
                     F.col("p1").alias("right_p1"))
    out = (base.join(lk, ["run_id", "tree_id", "left_id"], "left")
               .join(rk, ["run_id", "tree_id", "right_id"], "left"))
    unsure = F.when(F.col("is_leaf"), F.lit(None)) \
              .when(F.col("left_p1") > F.col("right_p1"), F.col("left_id")) \
              .otherwise(F.col("right_id"))
    return out.withColumn("unsure_id", unsure)


# a model up to this many nodes is materialised once as a local relation
LOCAL_MODEL_MAX_NODES = 200_000


def materialize_model(nodes: DataFrame, known_rows: int | None = None) -> DataFrame:
    """Compute a (small, bounded) model table once instead of re-planning its
    lineage at every walk level: a local relation when it is small, else a
    reliable checkpoint in the shared checkpoint folder."""
    n = known_rows if known_rows is not None else nodes.count()
    if n <= LOCAL_MODEL_MAX_NODES:
        return nodes.sparkSession.createDataFrame(nodes.collect(), nodes.schema)
    from ..config import cut_lineage
    return cut_lineage(nodes)


def _walk_nodes(nodes: DataFrame, known_rows: int | None) -> DataFrame:
    cols = ["tree_id", "node_id", "feature", "threshold", "left_id", "right_id",
            "unsure_id", "left_p1", "right_p1", "p1", "is_leaf"]
    n = nodes.select(*cols)
    n = n.select(*[F.col(c).alias("_n_" + c) for c in cols])
    return bounded_broadcast(n, known_rows=known_rows)


def walk(df: DataFrame, nodes: DataFrame, values_col: str = "answers",
         mode: str = "answers", max_depth: int | None = None,
         trace: bool = True, node_rows: int | None = None,
         evidence_fn=None) -> DataFrame:
    """Walk every row of ``df`` down the tree(s) in ``nodes``.

    mode="answers" (C2): ``values_col`` is map<question, answer> or
    map<question, struct<answer, evidence>>; NO goes left, YES right, UNSURE
    to ``unsure_id``.  ``evidence_fn(question_col, answer_col)`` supplies
    evidence for plain answer maps: once, after the walk, for the steps taken
    (and not at all where nothing reads the trace).
    mode="encoded" (M10): ``values_col`` is map<question, double>; value <=
    threshold goes left.  A missing answer stops the walk with status
    'unanswered' and a null probability.

    Adds: leaf_id, probability, path_len, status, and trace (C2 only).
    ``df`` may carry ``tree_id`` (forest); otherwise the single tree's id.
    Node ids keep the type that they have in ``nodes`` (int or long).
    """
    id_type = nodes.schema["node_id"].dataType
    nodes = enrich_nodes(nodes) if "p1" not in nodes.columns else nodes
    if max_depth is None or node_rows is None:
        stats = nodes.agg(F.max("depth").alias("d"), F.count(F.lit(1)).alias("n")).first()
        max_depth = stats["d"] if max_depth is None else max_depth
        node_rows = stats["n"] if node_rows is None else node_rows
    nodes = materialize_model(nodes, node_rows)
    nb = _walk_nodes(nodes, node_rows)
    if "tree_id" not in df.columns:
        tids = sorted(r[0] for r in nodes.select("tree_id").distinct().collect())
        df = df.select("*", F.explode(F.array(*[F.lit(t) for t in tids])).alias("tree_id"))
    state = (df.withColumn("_node", F.lit(0).cast(id_type))
               .withColumn("status", F.lit("walking"))
               .withColumn("path_len", F.lit(0)))
    if trace and mode == "answers":
        state = state.withColumn("trace", F.array().cast(T.ArrayType(trace_step(id_type))))
    base_cols = state.columns
    on = ["tree_id", "_node"]
    vtype = df.schema[values_col].dataType.valueType if mode == "answers" else None
    structured = isinstance(vtype, T.StructType)
    for step in range(max_depth):
        j = state.join(nb.withColumnRenamed("_n_tree_id", "tree_id")
                         .withColumnRenamed("_n_node_id", "_node"), on, "left")
        walking = (F.col("status") == "walking") & ~F.col("_n_is_leaf")
        if mode == "answers":
            a = F.try_element_at(F.col(values_col), F.col("_n_feature"))
            ans = a.getField("answer") if structured else a
            ev = a.getField("evidence") if structured else F.lit(None).cast("string")
            nxt = (F.when(ans == "NO", F.col("_n_left_id"))
                    .when(ans == "YES", F.col("_n_right_id"))
                    .when(ans == "UNSURE", F.col("_n_unsure_id")))
        else:
            x = F.try_element_at(F.col(values_col), F.col("_n_feature"))
            nxt = F.when(x.isNull(), F.lit(None).cast(id_type)) \
                   .when(x <= F.col("_n_threshold"), F.col("_n_left_id")) \
                   .otherwise(F.col("_n_right_id"))
        moved = walking & nxt.isNotNull()
        upd = {
            "_node": F.when(moved, nxt).otherwise(F.col("_node")),
            "status": F.when(walking & nxt.isNull(), F.lit("unanswered"))
                       .otherwise(F.col("status")),
            "path_len": F.when(moved, F.col("path_len") + 1).otherwise(F.col("path_len")),
        }
        if trace and mode == "answers":
            score = F.when(nxt == F.col("_n_left_id"), F.col("_n_left_p1")) \
                     .otherwise(F.col("_n_right_p1"))
            item = F.struct(F.lit(step).alias("step"), F.col("_node").alias("node_id"),
                            F.col("_n_feature").alias("question_id"),
                            ans.alias("answer"), ev.alias("evidence"),
                            score.alias("inclusion_score"))
            upd["trace"] = F.when(moved, F.array_append(F.col("trace"), item)) \
                            .otherwise(F.col("trace"))
        state = j.select(*[upd.get(c, F.col(c)).alias(c) for c in base_cols])
    j = state.join(nb.withColumnRenamed("_n_tree_id", "tree_id")
                     .withColumnRenamed("_n_node_id", "_node"), on, "left")
    done = (F.col("status") == "walking") & F.col("_n_is_leaf")
    carried = [F.col(c) for c in base_cols if c not in ("_node", "status")]
    if evidence_fn is not None and not structured and "trace" in base_cols:
        said = F.transform("trace", lambda s: s.withField(
            "evidence", evidence_fn(s["question_id"], s["answer"])))
        carried = [said.alias("trace") if c == "trace" else F.col(c)
                   for c in base_cols if c not in ("_node", "status")]
    out = j.select(
        *carried,
        F.when(F.col("status") == "unanswered", F.lit(None).cast(id_type))
         .otherwise(F.col("_node")).alias("leaf_id"),
        F.when(done, F.col("_n_p1")).alias("probability"),
        F.when(done, F.lit("done")).otherwise(
            F.when(F.col("status") == "walking", F.lit("too_deep"))
             .otherwise(F.col("status"))).alias("status"),
    )
    return out


def leaf_assign(scored: DataFrame, nodes: DataFrame, node_rows: int | None = None) -> DataFrame:
    """Each row joined to its leaf's facts (support, class counts,
    impurity); the node table is broadcast behind its size check."""
    leaf = nodes.select("tree_id", F.col("node_id").alias("leaf_id"),
                        (F.col("n0") + F.col("n1")).alias("leaf_support"),
                        F.col("n0").alias("leaf_n0"), F.col("n1").alias("leaf_n1"),
                        F.col("impurity").alias("leaf_impurity"))
    return scored.join(bounded_broadcast(leaf, known_rows=node_rows), ["tree_id", "leaf_id"], "left")


def nodes_by_support(nodes: DataFrame, n_samples: float) -> DataFrame:
    """Nodes whose training support equals ``n_samples``, with their
    class distribution."""
    return (nodes.where((F.col("n0") + F.col("n1")) == F.lit(float(n_samples)))
            .select("run_id", "tree_id", "node_id", "feature", "n0", "n1",
                    positive_share("n0", "n1").alias("p1")))
