"""The answer store: memoised answers with an expiry.

The store is an ordinary table (parquet in the shared folder, partitioned by
question_id when written with ``write_store``) of writes:
    answer_key, paper_id, question_id, model, mode, answered_at, payload
"Newest write wins" is a ``max_by`` aggregate, not a window: the partial
aggregate collapses each key map-side, so a key holding a third of all
writes never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ANSWER_TTL_SECONDS
from ..functions.answers import parse_payload, valid_answer

STORE_KEY = ["paper_id", "question_id", "model", "mode"]


def parse_log(log: DataFrame) -> DataFrame:
    """F8 over the log: typed answer, evidence, tokens and a validity flag
    (a malformed or out-of-vocabulary payload is a miss)."""
    p = parse_payload("payload")
    return log.withColumn("_p", p).select(
        "*",
        F.col("_p.answer.answer").alias("answer"),
        F.col("_p.answer.evidence").alias("evidence"),
        F.col("_p.prompt_tokens").alias("prompt_tokens"),
        F.col("_p.completion_tokens").alias("completion_tokens"),
        valid_answer(F.col("_p")).alias("valid"),
    ).drop("_p")


def latest_writes(log: DataFrame, key=STORE_KEY, order=("answered_at", "event_id")) -> DataFrame:
    """Newest write per key (ties broken by the second order column)."""
    cols = [c for c in log.columns if c not in key]
    ordering = F.struct(*[F.col(c) for c in order if c in log.columns])
    return (log.groupBy(*key)
            .agg(F.max_by(F.struct(*cols), ordering).alias("_w"))
            .select(*key, "_w.*"))


def live_answers(log: DataFrame, asof: Column, ttl_seconds: int = ANSWER_TTL_SECONDS,
                 key=STORE_KEY) -> DataFrame:
    """The newest write per key, if it is younger than the TTL at
    ``asof`` (an answer exactly TTL old is gone) and carries a valid answer."""
    latest = latest_writes(parse_log(log), key)
    fresh = F.col("answered_at") > asof - F.make_dt_interval(secs=F.lit(ttl_seconds))
    return latest.where(fresh & F.col("valid"))


def token_usage(answers: DataFrame, by: str = "paper_id") -> DataFrame:
    """A10: input and output tokens summed per paper."""
    return answers.groupBy(by).agg(
        F.sum("prompt_tokens").cast("long").alias("input_tokens"),
        F.sum("completion_tokens").cast("long").alias("output_tokens"),
        F.count(F.lit(1)).alias("n_answers"))


def answer_completeness(answers: DataFrame, questions: list[str], by: str = "paper_id") -> DataFrame:
    """A paper is complete only when every required question has an
    answer; any gap aborts its extraction."""
    need = len(questions)
    got = F.count_distinct(F.when(F.col("question_id").isin(*questions), F.col("question_id")))
    return (answers.groupBy(by).agg(got.alias("n_answered"))
            .withColumn("n_required", F.lit(need))
            .withColumn("status", F.when(F.col("n_answered") == need, F.lit("complete"))
                        .otherwise(F.lit("incomplete"))))


def cache_hits(requests: DataFrame, store: DataFrame, on=("paper_id", "question_id")) -> DataFrame:
    """J3 hit: requests that the store answers (semi join, one key once)."""
    return requests.join(store.select(*on).distinct(), list(on), "left_semi")


def cache_misses(requests: DataFrame, store: DataFrame, on=("paper_id", "question_id")) -> DataFrame:
    """J3 miss: distinct requests the store cannot answer (anti join), so
    each key goes to the provider once per batch."""
    return requests.select(*on).distinct().join(store.select(*on), list(on), "left_anti")


def write_store(answers: DataFrame, path: str, buckets: int | None = None,
                mode: str = "append") -> None:
    """Append answers to the store; partitioned by question so lookups for
    one level's question prune files."""
    w = answers.repartition(buckets, "paper_id") if buckets else answers
    w.write.mode(mode).partitionBy("question_id").parquet(path)
