"""Lazy asking: only the questions on each paper's path (C3), with the
exclusion pre-check staged first (C1), against an answer store (J3).

Per level of the tree the driver issues one plan step:
  frontier x node table (broadcast) -> the one question each paper needs
  -> store lookup (hit) / provider (miss) -> next node.
A native provider (rules) answers in-row, so a miss costs no shuffle; any
other provider gets the distinct missing (paper, question) pairs, with the
question's text, as a request table.  Its answers are checkpointed to the
shared folder before anything else reads them, so each pair is asked once
whatever the plan does later and whatever executor is lost; each level's
state is checkpointed as well (``materialize``, always on for such a provider).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import cut_lineage
from ..constants import EXCLUSION_REASONS
from ..operators.tree import _walk_nodes, enrich_nodes, materialize_model
from .precheck import ask, of_mode, precheck, question_text

LAZY_STEP = T.StructType([
    T.StructField("step", T.IntegerType()),
    T.StructField("node_id", T.IntegerType()),
    T.StructField("question_id", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("inclusion_score", T.DoubleType()),
    T.StructField("asked", T.BooleanType()),
])


def _store_side(store: DataFrame | None) -> DataFrame | None:
    store = of_mode(store, "single")
    if store is None:
        return None
    return store.select(F.col("paper_id").alias("_s_pid"), F.col("question_id").alias("_s_q"),
                        F.col("answer").alias("_s_a"), F.col("evidence").alias("_s_e"))


def lazy_walk(prepared: DataFrame, nodes: DataFrame, provider, store: DataFrame | None = None,
              status_col: str | None = None, materialize: bool = False,
              text_col: str = "text") -> DataFrame:
    """Walk asking only path questions.  ``prepared`` has paper_id and text;
    rows whose ``status_col`` is not 'walking' are carried through untouched.
    Adds leaf_id, probability, path_len, n_asked, n_hits, status, trace."""
    nodes = enrich_nodes(nodes) if "p1" not in nodes.columns else nodes
    stats = nodes.agg(F.max("depth").alias("d"), F.count(F.lit(1)).alias("n")).first()
    nodes = materialize_model(nodes, stats["n"])
    nb = (_walk_nodes(nodes, stats["n"]).withColumnRenamed("_n_tree_id", "tree_id")
          .withColumnRenamed("_n_node_id", "_node"))
    tids = sorted(r[0] for r in nodes.select("tree_id").distinct().collect())
    state = (prepared.select("*", F.explode(F.array(*[F.lit(t) for t in tids])).alias("tree_id"))
             if "tree_id" not in prepared.columns else prepared)
    status0 = F.col(status_col) if status_col else F.lit("walking")
    state = (state.withColumn("_node", F.lit(0)).withColumn("status", status0)
             .withColumn("path_len", F.lit(0)).withColumn("n_asked", F.lit(0))
             .withColumn("n_hits", F.lit(0))
             .withColumn("trace", F.array().cast(T.ArrayType(LAZY_STEP))))
    base = state.columns
    side = _store_side(store)
    native = hasattr(provider, "answer_for")
    materialize = materialize or not native
    text = F.col(text_col)
    if native:  # one branch a question of the tree
        from .screen import asked_questions
        qids = asked_questions(nodes, provider)
    for step in range(stats["d"]):
        j = state.join(nb, ["tree_id", "_node"], "left")
        need = (F.col("status") == "walking") & ~F.col("_n_is_leaf")
        if side is not None:
            j = j.join(side, (j["paper_id"] == side["_s_pid"]) & (j["_n_feature"] == side["_s_q"]),
                       "left")
            hit = need & F.col("_s_a").isNotNull()
            s_a, s_e = F.col("_s_a"), F.col("_s_e")
        else:
            hit = F.lit(False)
            s_a = s_e = F.lit(None).cast("string")
        if native:
            p_a, p_e = provider.answer_for(text, F.col("_n_feature"), qids), F.lit(None).cast("string")
        else:
            got = ask(provider, j.where(need & ~hit).select(
                "paper_id", F.col("_n_feature").alias("question_id"),
                F.col("title_clean").alias("title"), F.col("abstract_clean").alias("abstract"),
                question_text(F.col("_n_feature")).alias("question"),
                F.lit("single").alias("mode")))
            j = j.join(got, (j["paper_id"] == got["_r_pid"]) & (j["_n_feature"] == got["_r_q"]),
                       "left")
            p_a, p_e = F.col("_r_a"), F.col("_r_e")
        asked = need & ~hit
        ans = F.when(hit, s_a).when(asked, p_a)
        ev = F.when(hit, s_e).when(asked, p_e)
        nxt = (F.when(ans == "NO", F.col("_n_left_id")).when(ans == "YES", F.col("_n_right_id"))
                .when(ans == "UNSURE", F.col("_n_unsure_id")))
        moved = need & nxt.isNotNull()
        score = F.when(nxt == F.col("_n_left_id"), F.col("_n_left_p1")).otherwise(F.col("_n_right_p1"))
        item = F.struct(F.lit(step).alias("step"), F.col("_node").alias("node_id"),
                        F.col("_n_feature").alias("question_id"), ans.alias("answer"),
                        ev.alias("evidence"), score.alias("inclusion_score"),
                        asked.alias("asked"))
        upd = {
            "_node": F.when(moved, nxt).otherwise(F.col("_node")),
            "status": F.when(need & nxt.isNull(), F.lit("unanswered")).otherwise(F.col("status")),
            "path_len": F.col("path_len") + moved.cast("int"),
            "n_asked": F.col("n_asked") + asked.cast("int"),
            "n_hits": F.col("n_hits") + hit.cast("int"),
            "trace": F.when(moved, F.array_append(F.col("trace"), item)).otherwise(F.col("trace")),
        }
        state = j.select(*[upd.get(c, F.col(c)).alias(c) for c in base])
        if materialize:
            state = cut_lineage(state)
    j = state.join(nb, ["tree_id", "_node"], "left")
    done = (F.col("status") == "walking") & F.col("_n_is_leaf")
    if native:  # evidence once, for the steps asked
        j = j.withColumn("trace", F.transform("trace", lambda s: s.withField("evidence", F.when(
            s["asked"], provider.evidence_of(text, s["question_id"], s["answer"], qids))
            .otherwise(s["evidence"]))))
    return j.select(
        *[c for c in base if c not in ("_node", "status")],
        F.when(done, F.col("_node")).alias("leaf_id"),
        F.when(done, F.col("_n_p1")).alias("probability"),
        F.when(done, F.lit("done")).otherwise(F.col("status")).alias("status"))


def new_answers(walked: DataFrame) -> DataFrame:
    """Answers a lazy walk obtained from the provider (to append to the store)."""
    return (walked.select("paper_id", F.inline("trace")).where("asked")
            .select("paper_id", "question_id", "answer", "evidence"))


def native_precheck(prepared: DataFrame, provider, reasons) -> DataFrame:
    """C1 of a native provider, in-row: every reason answered, selected where
    YES or UNSURE, confirmed where YES."""
    rq = F.array(*[F.lit(r) for r in reasons])
    d = prepared.withColumn("_reasons", F.array(
        *[provider.answer_for(F.col("text"), F.lit(r), [r]) for r in reasons]))
    candidates = F.filter(F.sequence(F.lit(0), F.lit(len(reasons) - 1)),
                          lambda i: F.element_at(F.col("_reasons"), i + 1).isin("YES", "UNSURE"))
    d = d.withColumn("exclusion_candidates", candidates)
    confirmed = F.transform(d["exclusion_candidates"],
                            lambda i: F.element_at(F.col("_reasons"), i + 1) == "YES")
    pos = F.array_position(confirmed, True)  # 1-based, 0 when none
    return (d.withColumn("_pos", pos)
            .withColumn("excluded_by", F.when(F.col("_pos") > 0, F.element_at(
                rq, F.element_at(F.col("exclusion_candidates"), F.col("_pos").cast("int")) + 1)))
            .withColumn("n_exclusion_calls", 1 + F.when(F.col("_pos") > 0, F.col("_pos"))
                        .otherwise(F.size("exclusion_candidates")))
            .withColumn("n_exclusion_hits", F.lit(0))
            .withColumn("exclusion_status", F.when(F.col("_pos") > 0, F.lit("excluded"))
                        .otherwise(F.lit("pass")))
            .drop("_pos", "_reasons"))


def lazy_screen(prepared: DataFrame, nodes: DataFrame, provider,
                store: DataFrame | None = None, reasons=EXCLUSION_REASONS,
                materialize: bool = False) -> DataFrame:
    """C1 staged before C3: one multi-select over the reasons, then
    confirmations in order until the first YES (excluded: no walk), then the
    lazy walk.  ``n_asked`` counts provider calls: 1 + confirmations + steps
    that the store did not answer; ``n_hits`` those that it did."""
    if hasattr(provider, "answer_for"):
        d = native_precheck(prepared, provider, reasons)
    else:
        d = prepared.join(cut_lineage(precheck(prepared, provider, reasons, store)), "paper_id")
    d = d.withColumn("_st", F.when(F.col("exclusion_status") == "pass", F.lit("walking"))
                     .otherwise(F.col("exclusion_status")))
    w = lazy_walk(d, nodes, provider, store, status_col="_st", materialize=materialize)
    excluded = F.col("status") == "excluded"
    return w.select(
        "paper_id", "status", "excluded_by", "leaf_id",
        F.when(excluded, F.lit(0.0)).otherwise(F.col("probability")).alias("probability"),
        "path_len", (F.col("n_exclusion_hits") + F.col("n_hits")).alias("n_hits"),
        (F.col("n_exclusion_calls") + F.col("n_asked")).alias("n_asked"),
        "trace")
