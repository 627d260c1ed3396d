"""Logical tables built from the driver's parquet tables.

| logical      | built from | rule                                             |
| papers       | documents  | paper_id = doc_id, title = '', abstract = text    |
| html_papers  | pages      | paper_id = page_id, title = <title>, abstract = html |
| labels       | labels     | label = toxic (rare positive); quality kept      |
| answer_log   | events     | see ``answer_log``                               |

Every reader selects only the columns it needs so the parquet scan prunes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEFAULT_MODEL_NAME, FEATURE_ORDER
from ..functions.answers import cache_payload
from ..functions.text import html_title

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 batch intake: one row per paper (paper_id, title, abstract)."""
    return (table(spark, sf_dir, "documents")
            .select(F.col("doc_id").alias("paper_id"), F.lit("").alias("title"),
                    F.col("text").alias("abstract")))


def html_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw web pages as papers: title from <title>, abstract = the markup."""
    return (table(spark, sf_dir, "pages")
            .select(F.col("page_id").alias("paper_id"),
                    html_title(F.col("html")).alias("title"),
                    F.col("html").alias("abstract")))


def labels(spark: SparkSession, sf_dir: str, label: str = "toxic") -> DataFrame:
    """Labelled corpus, pruned and renamed (paper_id, label)."""
    return (table(spark, sf_dir, "labels")
            .select(F.col("doc_id").alias("paper_id"), F.col(label).cast("int").alias("label")))


def read_papers(spark: SparkSession, path: str, fmt: str = "parquet",
                streaming: bool = False, schema=None) -> DataFrame:
    """Paper intake from files (batch or stream)."""
    from pyspark.sql import types as T
    schema = schema or T.StructType([
        T.StructField("paper_id", T.LongType()), T.StructField("title", T.StringType()),
        T.StructField("abstract", T.StringType())])
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).format(fmt).load(path)


# FIXED VALUES: event type -> stored answer (error = malformed payload)
EVENT_ANSWER = {"click": "YES", "purchase": "YES", "view": "NO", "signup": "UNSURE"}


def answer_log(spark: SparkSession, sf_dir: str, model: str = DEFAULT_MODEL_NAME) -> DataFrame:
    """S3: the long answer log, one write per event.

    paper_id = user_id; question = FEATURE_ORDER[$.k mod 8]; answered_at = ts
    (TIMESTAMP_NTZ cast to TIMESTAMP); click/purchase = YES, view = NO,
    signup = UNSURE, error = a malformed payload; tokens = floor(value).
    """
    return events_to_log(table(spark, sf_dir, "events"), model)


def events_to_log(events: DataFrame, model: str = DEFAULT_MODEL_NAME) -> DataFrame:
    """The event -> answer-write mapping (batch or streaming input)."""
    ev = events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("long")
    qid = F.element_at(F.array(*[F.lit(q) for q in FEATURE_ORDER]),
                       (F.pmod(k, F.lit(len(FEATURE_ORDER))) + 1).cast("int"))
    mapping = F.create_map(*[x for kv in EVENT_ANSWER.items() for x in map(F.lit, kv)])
    ans = F.element_at(mapping, F.col("event_type"))
    tokens = F.floor("value").cast("long")
    payload = F.when(ans.isNull(), F.lit('{"answer": ')).otherwise(
        cache_payload(ans, F.concat(F.lit("event "), F.col("event_id").cast("string")),
                      tokens, F.lit(0)))
    return ev.select(
        F.col("event_id"),
        F.col("user_id").alias("paper_id"),
        qid.alias("question_id"),
        F.lit(model).alias("model"),
        F.lit("single").alias("mode"),
        F.col("ts").cast("timestamp").alias("answered_at"),
        payload.alias("payload"),
    )


def selection_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of multi-select replies, one per event: paper_id, event_id,
    answered_at, payload (JSON text of ids and evidence).

    With k the number of the event's properties, the ids are the first k mod 4
    of k mod 9, (k + 4) mod 9 and 2k mod 10 (so one may lie outside the nine
    reasons, or come twice); an error event has a malformed payload."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    ids = F.slice(F.array(F.pmod(k, F.lit(9)), F.pmod(k + 4, F.lit(9)), F.pmod(2 * k, F.lit(10))),
                  F.lit(1), F.pmod(k, F.lit(4)))
    reply = F.to_json(F.struct(ids.alias("ids"), F.concat(
        F.lit("event "), F.col("event_id").cast("string")).alias("evidence")))
    return ev.select(F.col("user_id").alias("paper_id"), "event_id",
                     F.col("ts").cast("timestamp").alias("answered_at"),
                     F.when(F.col("event_type") == "error", F.lit('{"ids": [')).otherwise(reply)
                     .alias("payload"))


def reply_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of all-at-once replies, one per event: paper_id, event_id,
    answered_at, payload (JSON text).

    With k the number of the event's properties, a reply answers question
    FEATURE_ORDER[k mod 8] (spelled in lower case) by the event's type and, for
    even k, question 5 (spelled I5, as an object) with UNSURE; it also names a
    question that does not exist and gives E2 a word outside the vocabulary.  For
    k divisible by 3 it is a list of objects.  An error event's is malformed."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    qid = F.lower(F.element_at(F.array(*map(F.lit, FEATURE_ORDER)), F.pmod(k, F.lit(len(FEATURE_ORDER))) + 1))
    mapping = F.create_map(*[x for kv in EVENT_ANSWER.items() for x in map(F.lit, kv)])
    ans = F.element_at(mapping, F.col("event_type"))
    five = F.when(k % 2 == 0, F.lit('"I5":{"answer":"UNSURE","evidence":"five"},')).otherwise(F.lit(""))
    words = F.format_string('{"%s":"%s",%s"X1":"YES","E2":"maybe"}', qid, ans, five)
    five = F.when(k % 2 == 0, F.lit('{"id":"I5","answer":"UNSURE"},')).otherwise(F.lit(""))
    listed = F.format_string('[{"id":"%s","answer":"%s"},%s{"id":"X1","answer":"YES"},7]', qid, ans, five)
    payload = F.when(ans.isNull(), F.lit('{"i01":')).when(k % 3 == 0, listed).otherwise(words)
    return ev.select(F.col("user_id").alias("paper_id"), "event_id",
                     F.col("ts").cast("timestamp").alias("answered_at"), payload.alias("payload"))
