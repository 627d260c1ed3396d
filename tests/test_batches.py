"""Texts reach Python workers in short batches whatever the number of rows."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from papersieve.config import ARROW_BYTES, ARROW_BYTES_KEY, ARROW_ROWS, ARROW_ROWS_KEY
from papersieve.functions import text
from papersieve.plans import catalog as C
from papersieve.plans.screen import prepare


def batch_sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])


def test_cleaning_reads_short_batches(spark):
    s = spark.newSession()
    for key in (ARROW_ROWS_KEY, ARROW_BYTES_KEY):
        s.conf.unset(key)
    papers = s.range(12_000, numPartitions=1).select(
        F.col("id").alias("paper_id"), F.lit("").alias("title"), F.repeat(F.lit("<b>x</b> &amp; "), 100)
        .alias("abstract"))
    cleaned = prepare(papers)
    assert cleaned.where("trim(text) <> trim(repeat('x & ', 100))").count() == 0
    sizes = cleaned.select("abstract").mapInArrow(batch_sizes, "n long, size long").agg(
        F.sum("n"), F.max("n"), F.max("size")).first()
    assert sizes[0] == 12_000 and sizes[1] <= ARROW_ROWS and sizes[2] <= 2 * ARROW_BYTES


def test_cleaning_function_gets_short_batches_of_long_texts(spark):
    s = spark.newSession()
    for key in (ARROW_ROWS_KEY, ARROW_BYTES_KEY):
        s.conf.unset(key)
    size = 20_000
    papers = s.range(3_000, numPartitions=1).select(
        F.col("id").alias("paper_id"), F.lit("").alias("title"), F.repeat(F.lit("x"), size).alias("abstract"))

    @F.arrow_udf("struct<n: long, size: long>")
    def batch(texts: pa.Array) -> pa.Array:
        return pa.array([{"n": len(texts), "size": texts.nbytes}] * len(texts))
    # a function of the cleaned texts, run as the cleaning is, a batch at a time
    got = prepare(papers).select(batch("abstract").alias("b"), F.length("text").alias("length")).agg(
        F.count("*"), F.max("b.n"), F.max("b.size"), F.min("length")).first()
    assert got[0] == 3_000 and got[1] <= ARROW_ROWS and got[2] <= 2 * ARROW_BYTES and got[3] >= size


#: What cleans the texts of each query: itself, or the step before its fit.
CLEANING = {
    "replayed_precheck": C.q_replayed_precheck,
    "lazy_screen": C.q_lazy_screen,
    "predict_proba": C.encoded_split,
    "trained_screen": C.screened,
}


def corpus(s, path):
    """Documents for two full batches a core, all labelled, each with an event."""
    n = 2 * ARROW_ROWS * s.sparkContext.defaultParallelism
    ids = s.range(n, numPartitions=1).withColumnRenamed("id", "doc_id")
    ids.select("doc_id", F.concat(F.lit("<b>machine</b> &amp; café "), "doc_id").alias("text")) \
       .write.parquet(f"{path}/documents.parquet")
    ids.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")).write.parquet(f"{path}/labels.parquet")
    ids.select(F.col("doc_id").alias("event_id"), F.current_timestamp().alias("ts"), F.col("doc_id").alias("user_id"),
               F.lit("view").alias("event_type"), F.lit(1.0).alias("value"),
               F.format_string('{"k": %d}', F.col("doc_id") % 8).alias("props")).write.parquet(f"{path}/events.parquet")
    return n


@pytest.mark.parametrize("name", CLEANING)
def test_queries_clean_in_short_batches(spark, tmp_path, monkeypatch, name):
    s = spark.newSession()
    for key in (ARROW_ROWS_KEY, ARROW_BYTES_KEY):
        s.conf.unset(key)
    n, seen = corpus(s, str(tmp_path)), tmp_path / "seen"
    seen.mkdir()
    told = str(seen)

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        import uuid
        open(f"{told}/{len(texts)}-{uuid.uuid4().hex}", "w").close()
        return text._fold_array(text._unescape_array(texts))
    monkeypatch.setattr(text, "_unescape_fold_udf", cleaned)
    assert CLEANING[name](s, str(tmp_path)).count() == n
    sizes = [int(f.name.split("-")[0]) for f in seen.iterdir()]
    assert sum(sizes) >= n and max(sizes) <= ARROW_ROWS
