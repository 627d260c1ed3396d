"""The streaming memo against plain Python, in one batch and in many."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from papersieve.streaming import memo as MS

from .conftest import SF001

DAY = 86_400


def plain(rows, ttl):
    """rows: (event_id, at seconds, key, answer or None)."""
    out, memo = {}, {}
    for e, at, key, answer in sorted(rows, key=lambda r: (r[1], r[0])):
        known = memo.get(key)
        age = None if known is None else at - known[1]
        if age is not None and age < ttl:
            out[e] = ("hit", known[0])
            continue
        out[e] = ("expired" if age is not None and age < 2 * ttl else "miss", answer)
        if answer is not None:
            memo[key] = (answer, at)
    return out


def as_log(rows, t0):
    return pd.DataFrame({
        "event_id": [r[0] for r in rows], "answered_at": [t0 + dt.timedelta(seconds=r[1]) for r in rows],
        "paper_id": [r[2][0] for r in rows], "question_id": [r[2][1] for r in rows],
        "answer": [r[3] for r in rows], "evidence": ["e" if r[3] else None for r in rows],
        "valid": [r[3] is not None for r in rows]})


@pytest.mark.parametrize("files", [1, 4])
def test_stream_equals_plain_python(spark, tmp_path, files):
    draw = random.Random(3)
    ttl, t0 = 10 * DAY, dt.datetime(2024, 1, 1)
    rows = [(i, draw.randrange(60) * DAY, (draw.randrange(6), "I01"),
             draw.choice(["YES", "NO", "UNSURE", None])) for i in range(150)]
    rows += [(1000, 0, (99, "I01"), "YES"), (1001, ttl, (99, "I01"), "NO"),  # exactly TTL old: gone
             (1002, ttl + 1, (99, "I01"), "YES")]
    rows.sort(key=lambda r: (r[1], r[0]))
    step = -(-len(rows) // files)
    schema = ("event_id long, answered_at timestamp, paper_id long, question_id string, answer string, "
              "evidence string, valid boolean")
    for i in range(files):
        path = tmp_path / "in" / f"{i}.parquet"
        path.parent.mkdir(exist_ok=True)
        log = as_log(rows[i * step:(i + 1) * step], t0)
        log["answered_at"] = log["answered_at"].astype("datetime64[us]").dt.tz_localize("UTC")
        log.to_parquet(path)
        import os
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = (MS.memoised(stream, ttl, late_seconds=100 * DAY).writeStream.format("parquet")
         .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.event_id: (r.outcome, r.answer) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == plain(rows, ttl)
    assert got[1001] == ("expired", "NO") and got[1002] == ("hit", "NO")


def test_every_event_comes_out_once(spark):
    out = spark.read.parquet(MS.stream_memo(spark, SF001, 5 * DAY))
    n = spark.read.parquet(f"{SF001}/events.parquet").count()
    assert out.count() == n == out.select("event_id").distinct().count()
    assert out.where(F.col("outcome").isin("hit") & F.col("answer").isNull()).count() == 0


def test_streams_read_tables_of_many_files(spark, tmp_path):
    """A table may be a directory of files, as well as one file."""
    from papersieve.operators.tree import fixture_nodes
    from papersieve.streaming.stream import stream_screen
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    parts = spark.read.parquet(stream_screen(spark, str(tmp_path), fixture_nodes(spark)))
    whole = spark.read.parquet(stream_screen(spark, SF001, fixture_nodes(spark)))
    assert parts.count() == docs.count()
    assert parts.exceptAll(whole.select(parts.columns)).count() == 0


def test_memo_handles_rows_not_frames():
    """A key's requests come as rows: no pandas frame a key."""
    class State:
        value, kept = None, []

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def registerTimer(self, at):
            self.kept.append(at)

        def deleteTimer(self, at):
            self.kept.remove(at)
    memo = MS.AnswerMemo(100)
    memo.memo = memo.handle = state = State()
    row = MS.Row("event_id", "at", "valid", "answer", "evidence")
    asked = [row(2, 50, True, "NO", "b"), row(1, 0, True, "YES", "a"), row(3, 150, True, "NO", "c")]
    out = list(memo.handleInputRows((7, "I01"), iter(asked), None))
    assert [(r.event_id, r.outcome, r.answer) for r in out] == [
        (1, "miss", "YES"), (2, "hit", "YES"), (3, "expired", "NO")]
    assert state.value == ("NO", "c", 150) and state.kept == [350]
