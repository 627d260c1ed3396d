"""Screening flows: text preparation, exclusion pre-check (C1), eager tree
walk (C2), full screen (C4).

The eager screen with a native provider is ONE stage per partition of
papers: clean text (Arrow batch), rule answers (codegen), exclusion (array
higher-order functions), walk (broadcast joins).  Nothing shuffles; at 100 TB
the job is scan-bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ARROW_BYTES, short_batches, spread
from ..constants import DECISION_THRESHOLD, DEFAULT_MODEL_NAME, EXCLUSION_REASONS
from ..functions.answers import decide
from ..functions.text import clean_text
from ..operators.rules import RuleProvider, paper_text
from ..operators.tree import walk


def prepare(papers: DataFrame) -> DataFrame:
    """F1 -> F2 on title and abstract; ``text`` is what providers read.  Texts go
    to Python in short batches, so a worker's memory does not grow with the input."""
    short_batches(papers.sparkSession, ARROW_BYTES)
    return (spread(papers).withColumn("title_clean", clean_text("title"))
                  .withColumn("abstract_clean", clean_text("abstract"))
                  .withColumn("text", paper_text("title_clean", "abstract_clean")))


def asked_questions(nodes: DataFrame, provider: RuleProvider, reasons=()) -> list[str]:
    """The questions that the tree and the reasons use (distinct features of
    the model: bounded by the bank)."""
    used = {r[0] for r in nodes.where("feature IS NOT NULL").select("feature").distinct().collect()}
    return [q for q in provider.question_ids if q in used or q in reasons]


def with_answers(prepared: DataFrame, provider: RuleProvider | None = None,
                 qids=None, col: str = "answers") -> DataFrame:
    provider = provider or RuleProvider()
    return prepared.withColumn(col, provider.answers_map(F.col("text"), qids))


def exclusion_columns(answers: Column, confirm: Column | None = None,
                      reasons=EXCLUSION_REASONS, candidates: Column | None = None,
                      evidence_fn=None) -> list[Column]:
    """C1 in-row: candidates = reasons answered YES or UNSURE (or an external
    multi-select's ids, in its order); confirmed = first candidate whose
    confirmation answer is YES.  An out-of-range id is ``invalid``."""
    confirm = confirm if confirm is not None else answers
    rq = F.array(*[F.lit(r) for r in reasons])
    n = len(reasons)
    if candidates is None:
        candidates = F.filter(
            F.sequence(F.lit(0), F.lit(n - 1)),
            lambda i: F.try_element_at(answers, F.element_at(rq, i + 1))
                       .isin("YES", "UNSURE"))
    invalid = F.exists(candidates, lambda i: (i < 0) | (i >= n))
    confirmed = F.filter(
        candidates,
        lambda i: ((i >= 0) & (i < n)) &
        (F.try_element_at(confirm, F.try_element_at(rq, i + 1)) == "YES"))
    first = F.try_element_at(confirmed, F.lit(1))
    qid = F.try_element_at(rq, first + 1)
    return [
        candidates.alias("exclusion_candidates"),
        F.when(invalid, F.lit("invalid")).when(first.isNotNull(), F.lit("excluded"))
         .otherwise(F.lit("pass")).alias("exclusion_status"),
        first.alias("excluded_reason"),
        qid.alias("excluded_by"),
        (evidence_fn(qid) if evidence_fn is not None else F.lit(None).cast("string"))
        .alias("exclusion_evidence"),
    ]


def exclusion_check(prepared: DataFrame, provider: RuleProvider | None = None,
                    reasons=EXCLUSION_REASONS) -> DataFrame:
    provider = provider or RuleProvider()
    d = prepared.withColumn("_ex", provider.answers_map(F.col("text"), reasons))
    ev = lambda q: provider.evidence_of(F.col("text"), q, F.lit("YES"), reasons)
    return d.select("*", *exclusion_columns(F.col("_ex"), reasons=reasons,
                                            evidence_fn=ev)).drop("_ex")


def tree_walk(papers: DataFrame, nodes: DataFrame, provider: RuleProvider | None = None,
              qids=None, trace: bool = True) -> DataFrame:
    """C2 eager: every question of the tree answered in-row, then walked."""
    provider = provider or RuleProvider()
    qids = list(qids or asked_questions(nodes, provider))
    d = with_answers(prepare(papers), provider, qids)
    return walk(d, nodes, "answers", trace=trace,
                evidence_fn=lambda q, a: provider.evidence_of(F.col("text"), q, a, qids))


def screen(papers: DataFrame, nodes: DataFrame, provider: RuleProvider | None = None,
           reasons=EXCLUSION_REASONS, threshold: float = DECISION_THRESHOLD,
           model: str = DEFAULT_MODEL_NAME, qids=None) -> DataFrame:
    """C4: clean -> exclusion pre-check -> walk -> decision -> response.

    An excluded paper gets probability 0 and a one-step trace naming the
    reason; everything else gets the walk's leaf share and trace.  Each pattern
    of a question is tried once a paper; evidence is extracted after the walk,
    for the steps taken and only where the trace is read."""
    provider = provider or RuleProvider()
    qids = list(qids or asked_questions(nodes, provider, reasons))
    d = prepare(papers).withColumn("answers", provider.answers_map(F.col("text"), qids))
    text = F.col("text")
    d = d.select("*", *exclusion_columns(
        F.col("answers"), reasons=reasons,
        evidence_fn=lambda q: provider.evidence_of(text, q, F.lit("YES"), list(reasons))))
    w = walk(d, nodes, "answers", trace=True,
             evidence_fn=lambda q, a: provider.evidence_of(text, q, a, qids))
    excluded = F.col("exclusion_status") == "excluded"
    ex_trace = F.array(F.struct(
        F.lit(0).alias("step"), F.lit(None).cast("int").alias("node_id"),
        F.col("excluded_by").alias("question_id"), F.lit("YES").alias("answer"),
        F.col("exclusion_evidence").alias("evidence"),
        F.lit(0.0).alias("inclusion_score"))).cast(w.schema["trace"].dataType)
    prob = F.when(excluded, F.lit(0.0)).otherwise(F.col("probability"))
    status = F.when(F.col("exclusion_status") == "invalid", F.lit("invalid")) \
              .when(excluded, F.lit("excluded")).otherwise(F.col("status"))
    return w.select(
        "paper_id",
        F.struct(F.col("title_clean").alias("title"),
                 F.col("abstract_clean").alias("abstract")).alias("payload"),
        status.alias("status"),
        F.col("excluded_by"),
        F.when(excluded, F.lit(None)).otherwise(F.col("leaf_id")).alias("leaf_id"),
        prob.alias("probability"),
        decide(prob, threshold).alias("prediction"),
        F.lit(0).cast("long").alias("input_tokens"),
        F.lit(0).cast("long").alias("output_tokens"),
        F.when(excluded, ex_trace).otherwise(F.col("trace")).alias("extracted_features"),
        F.lit(model).alias("llm"),
        F.when(excluded, F.lit(1)).otherwise(F.col("path_len")).alias("n_steps"),
    )
