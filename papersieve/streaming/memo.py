"""T2 + J3 on a stream: every request answered from the memo, or asked.

A request (paper, question) at a time finds the newest answer written for it:
younger than the TTL it is a ``hit`` and comes out with the stored answer; else
the request's own reply is its answer and, if valid, is written: ``expired``
where an answer was written less than twice the TTL ago, ``miss`` where none
was.  A hit does not renew an answer; a malformed reply writes nothing.

The memo is a value state of ``transformWithState``, one answer a key, in event
time: a timer drops a key's answer two TTLs after it was written, once the
watermark has passed, so state is bounded by the keys written in that time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import scratch_path
from ..constants import ANSWER_TTL_SECONDS
from ..operators.store import parse_log
from ..sources.tables import events_to_log
from .stream import EVENT_SCHEMA, stream_table

KEYS = ["paper_id", "question_id"]
STATE = "answer string, evidence string, at long"
OUT = T.StructType([
    T.StructField("paper_id", T.LongType()), T.StructField("question_id", T.StringType()),
    T.StructField("event_id", T.LongType()), T.StructField("outcome", T.StringType()),
    T.StructField("answer", T.StringType()), T.StructField("evidence", T.StringType())])
OUTCOME = Row(*OUT.fieldNames())
STORE = ("spark.sql.streaming.stateStore.providerClass",
         "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class AnswerMemo(StatefulProcessor):
    """The memo of one (paper, question).  A batch's requests of a key are
    handled in the order of (time, event_id)."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memo = handle.getValueState("memo", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        asked = sorted(rows, key=lambda r: (r["at"] is None, r["at"] or 0, r["event_id"] is None,
                                            r["event_id"] or 0))
        known = first = self.memo.get()
        out = []
        for r in asked:
            age = None if known is None else r["at"] - known[2]
            if age is not None and age < self.ttl:
                said = ("hit", known[0], known[1])
            else:
                valid = r["valid"]
                said = ("expired" if age is not None and age < 2 * self.ttl else "miss",
                        r["answer"] if valid else None, r["evidence"] if valid else None)
                if valid:
                    known = (r["answer"], r["evidence"], r["at"])
            out.append(OUTCOME(*key, r["event_id"], *said))
        if known is not first:
            self.memo.update(known)
            if first is not None:
                self.handle.deleteTimer(first[2] + 2 * self.ttl)
            self.handle.registerTimer(known[2] + 2 * self.ttl)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.memo.clear()
        return iter([])

    def close(self) -> None:
        pass


def memoised(requests: DataFrame, ttl_seconds: int = ANSWER_TTL_SECONDS,
             late_seconds: int | None = None) -> DataFrame:
    """A stream of requests (paper_id, question_id, event_id, answered_at,
    answer, evidence, valid: the reply each gets if it is asked) to their
    outcomes.  Requests up to ``late_seconds`` (default: the TTL) out of order
    are taken."""
    requests.sparkSession.conf.set(*STORE)
    asked = (requests.withWatermark("answered_at", f"{late_seconds or ttl_seconds} seconds")
             .select(*KEYS, "event_id", "answered_at",
                     F.unix_millis("answered_at").alias("at"), "valid", "answer", "evidence"))
    return asked.groupBy(*KEYS).transformWithState(
        statefulProcessor=AnswerMemo(ttl_seconds * 1000), outputStructType=OUT,
        outputMode="Append", timeMode="EventTime")


def stream_memo(spark: SparkSession, folder: str, ttl_seconds: int, out: str | None = None,
                checkpoint: str | None = None) -> str:
    """Every event of the stream as a request for its paper's question, with the
    event as the reply; returns the sink folder.  Runs with availableNow."""
    out = out or scratch_path(spark, "memo-out")
    checkpoint = checkpoint or scratch_path(spark, "memo-ckpt")
    log = parse_log(events_to_log(stream_table(spark, folder, "events", EVENT_SCHEMA)))
    q = (memoised(log, ttl_seconds).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out
