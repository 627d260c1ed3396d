"""Structured Streaming: continuous screening (T1), expiring memo (T2) and
bounded provider parallelism (T3).

T1 runs the batch screen inside ``foreachBatch``; each micro-batch writes
its own ``batch_id=N`` folder with overwrite, so a replayed batch (after a
driver or executor failure) replaces its own output: idempotent on
(batch_id, paper_id).  T2 keeps the first write of each (paper, question)
for the TTL with ``dropDuplicatesWithinWatermark``; its state is bounded by
the watermark, not by the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import scratch_path
from ..constants import ANSWER_TTL_SECONDS, EXCLUSION_REASONS
from ..operators.rules import RuleProvider
from ..plans.screen import screen
from ..operators.store import parse_log
from ..sources.tables import events_to_log

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])
EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def stream_table(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A streaming scan of one table in a folder, a file or a directory of files
    (named by a pattern: a stream takes a plain path for a directory)."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 100)
            .parquet(f"{folder.rstrip('/')}/{name}.{{parquet}}"))


def flat_screen(papers: DataFrame, nodes: DataFrame, provider=None,
                reasons=EXCLUSION_REASONS) -> DataFrame:
    s = screen(papers, nodes, provider or RuleProvider(), reasons)
    return s.select("paper_id", "status", "excluded_by", "leaf_id", "probability",
                    "prediction", "n_steps")


def stream_screen(spark: SparkSession, folder: str, nodes: DataFrame, out: str | None = None,
                  checkpoint: str | None = None, provider=None) -> str:
    """Screen every document arriving in ``folder``; returns the sink
    folder (parquet, partitioned by batch_id).  Runs with availableNow."""
    out = out or scratch_path(spark, "screen-out")
    checkpoint = checkpoint or scratch_path(spark, "screen-ckpt")
    # the model is computed once for all batches (a local relation only when
    # its node count is under the bound, else a checkpoint)
    from ..operators.tree import materialize_model
    nodes_local = materialize_model(nodes)
    docs = stream_table(spark, folder, "documents", DOC_SCHEMA).select(
        F.col("doc_id").alias("paper_id"), F.lit("").alias("title"), F.col("text").alias("abstract"))

    def each(batch: DataFrame, batch_id: int):
        flat_screen(batch, nodes_local, provider).write.mode("overwrite") \
            .parquet(f"{out}/batch_id={batch_id}")

    q = (docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def stream_dedupe(spark: SparkSession, folder: str, ttl_seconds: int = ANSWER_TTL_SECONDS,
                  out: str | None = None, checkpoint: str | None = None) -> str:
    """Answer writes from the event stream; a (paper, question) answered
    again within the TTL (event time, from first sight) is dropped.  A
    malformed write is no answer: it is dropped before it could hide one."""
    out = out or scratch_path(spark, "dedupe-out")
    checkpoint = checkpoint or scratch_path(spark, "dedupe-ckpt")
    log = parse_log(events_to_log(stream_table(spark, folder, "events", EVENT_SCHEMA))) \
        .where("valid")
    d = (log.withWatermark("answered_at", f"{ttl_seconds} seconds")
         .dropDuplicatesWithinWatermark(["paper_id", "question_id"]))
    q = (d.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out
