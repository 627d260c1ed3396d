"""C1 with any provider: one multi-select a paper, then confirmations.

A paper is asked once for the ids of all exclusion reasons that hold (mode
``exclusion``, an array-valued reply).  Each selected reason is then asked by
itself (mode ``confirm``), in the order of the reply, until one is confirmed:
round k asks the k-th reason of every paper that no earlier round has confirmed.
Rounds are a frontier of (paper, position); answered requests are checkpointed,
so none is sent twice, and a round moves only the papers still open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import cut_lineage
from ..constants import EXCLUSION_REASONS
from ..functions.answers import reason_list
from ..sources.questions import question_rows

REQUEST = ["paper_id", "question_id", "title", "abstract", "question", "mode"]
CHECKED = "paper_id long, position int, question_id string, answer string, evidence string, asked boolean"

SELECTION = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())),
                          T.StructField("evidence", T.StringType())])


def parse_selection(payload) -> Column:
    """F8 for a multi-select reply: JSON text to (ids, evidence); null where the
    text is malformed or has no list of ids."""
    parsed = F.from_json(F.col(payload) if isinstance(payload, str) else payload, SELECTION)
    return F.when(parsed["ids"].isNotNull() & ~F.exists(parsed["ids"], lambda i: i.isNull()), parsed)


def question_text(qid) -> Column:
    """The bank's text of a question id (the bank is a fixed small list)."""
    bank = F.create_map(*[F.lit(x) for q, text, _c, _i in question_rows() for x in (q, text)])
    return F.try_element_at(bank, qid)


def ask(provider, requests: DataFrame) -> DataFrame:
    """Answers of an external provider to distinct requests, asked once: the
    table is checkpointed before it is used."""
    got = provider.answer_requests(requests.select(*REQUEST).distinct())
    return cut_lineage(got.select(
        F.col("paper_id").alias("_r_pid"), F.col("question_id").alias("_r_q"),
        F.col("answer").alias("_r_a"), F.col("evidence").alias("_r_e")))


def of_mode(store: DataFrame | None, mode: str) -> DataFrame | None:
    """The store's answers given in a mode; a store without modes holds answers
    to single questions."""
    if store is None or ("mode" not in store.columns and mode != "single"):
        return None
    return store.where(F.col("mode") == mode) if "mode" in store.columns else store


def selected(prepared: DataFrame, provider, reasons) -> DataFrame:
    """paper_id, ids (distinct, in the reply's order; null: no reply), evidence."""
    asked = prepared.select(
        "paper_id", F.lit(None).cast("string").alias("question_id"),
        F.col("title_clean").alias("title"), F.col("abstract_clean").alias("abstract"),
        reason_list(F.array(*[question_text(F.lit(r)) for r in reasons])).alias("question"),
        F.lit("exclusion").alias("mode"))
    return cut_lineage(provider.select_requests(asked).select(
        "paper_id", F.array_distinct(F.col("ids").cast("array<int>")).alias("ids"), "evidence"))


def confirmations(prepared: DataFrame, chosen: DataFrame, provider, reasons,
                  store: DataFrame | None = None) -> DataFrame:
    """CHECKED rows: every confirmation that was needed, in rounds."""
    names = F.array(*[F.lit(r) for r in reasons])
    side = of_mode(store, "confirm")
    open_, rounds = chosen, []
    for position in range(len(reasons)):
        frontier = open_.where(F.size("ids") > position).select(
            "paper_id", F.element_at(names, F.get("ids", F.lit(position)) + 1).alias("question_id"))
        if frontier.isEmpty():
            break
        if side is not None:
            known = side.select("paper_id", "question_id", F.col("answer").alias("_s_a"),
                                F.col("evidence").alias("_s_e"))
            frontier = frontier.join(known, ["paper_id", "question_id"], "left")
        else:
            frontier = frontier.withColumns({c: F.lit(None).cast("string") for c in ("_s_a", "_s_e")})
        miss = frontier.where("_s_a IS NULL").select("paper_id", "question_id")
        got = ask(provider, prepared.join(miss, "paper_id").select(
            "paper_id", "question_id", F.col("title_clean").alias("title"),
            F.col("abstract_clean").alias("abstract"),
            question_text(F.col("question_id")).alias("question"), F.lit("confirm").alias("mode")))
        answered = frontier.join(got, (frontier["paper_id"] == got["_r_pid"])
                                 & (frontier["question_id"] == got["_r_q"]), "left").select(
            "paper_id", F.lit(position).alias("position"), "question_id",
            F.coalesce("_s_a", "_r_a").alias("answer"),
            F.when(F.col("_s_a").isNotNull(), F.col("_s_e")).otherwise(F.col("_r_e")).alias("evidence"),
            F.col("_s_a").isNull().alias("asked"))
        answered = cut_lineage(answered)
        rounds.append(answered)
        # confirmed papers leave; so do those whose confirmation failed
        open_ = cut_lineage(open_.join(answered.where("answer IN ('NO', 'UNSURE')").select("paper_id"),
                                       "paper_id", "left_semi"))
    if not rounds:
        return prepared.sparkSession.createDataFrame([], CHECKED)
    return reduce(DataFrame.unionByName, rounds)


def precheck(prepared: DataFrame, provider, reasons=EXCLUSION_REASONS,
             store: DataFrame | None = None) -> DataFrame:
    """One row a paper: exclusion_candidates (ids as replied), exclusion_status,
    excluded_reason, excluded_by, exclusion_evidence, n_exclusion_calls (1 and
    the confirmations asked), n_exclusion_hits (confirmations the store had).

    Status: ``excluded`` (a reason was confirmed), ``pass``, ``invalid`` (an id
    outside the reasons; nothing is confirmed then), ``unanswered`` (no reply, or
    a confirmation without an answer before any was confirmed).  No failure ends
    the job.  paper_id is unique."""
    n = len(reasons)
    chosen = selected(prepared, provider, reasons)
    bad = F.exists("ids", lambda i: i.isNull() | (i < 0) | (i >= n))
    checked = confirmations(prepared, chosen.where(~bad), provider, reasons, store)
    per = checked.groupBy("paper_id").agg(
        F.sum(F.col("asked").cast("int")).alias("_asked"),
        F.sum((~F.col("asked")).cast("int")).alias("_hits"),
        # one YES at most: later rounds leave confirmed papers out
        F.max(F.when(F.col("answer") == "YES", F.struct("position", "question_id", "evidence")))
        .alias("_yes"),
        F.max(F.col("answer").isNull().cast("int")).alias("_failed"))
    status = (F.when(F.col("ids").isNull(), "unanswered").when(bad, "invalid")
              .when(F.col("_yes").isNotNull(), "excluded")
              .when(F.col("_failed") == 1, "unanswered").otherwise("pass"))
    return chosen.join(per, "paper_id", "left").select(
        "paper_id", F.col("ids").alias("exclusion_candidates"), status.alias("exclusion_status"),
        F.get("ids", F.col("_yes.position")).alias("excluded_reason"),
        F.col("_yes.question_id").alias("excluded_by"),
        F.col("_yes.evidence").alias("exclusion_evidence"),
        (1 + F.coalesce("_asked", F.lit(0))).cast("int").alias("n_exclusion_calls"),
        F.coalesce("_hits", F.lit(0)).cast("int").alias("n_exclusion_hits"))
