"""The quality rules' target covers every trusted document."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from papersieve.llm import quality


def test_every_trusted_document_counts(spark):
    docs = spark.range(60_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "aaaaa").otherwise("bbbbb").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    ratio, threshold = quality.fit(docs, labels)
    assert not ratio.any()  # all documents are trusted, so target and raw are equal
    assert threshold == -quality.SLACK


def test_nth_smallest_is_exact(spark):
    draw = random.Random(4)
    values = [draw.randrange(-30 * 10**9, 30 * 10**9) for _ in range(400)] + [-5, -5, 0, 7]
    keys = spark.createDataFrame([(v,) for v in values], "key long")
    for n in (0, 1, 57, 203, 403):
        assert quality.nth_smallest(keys, n) == sorted(values)[n]


def test_threshold_is_the_percentile_of_all_trusted(spark):
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choice(["alpha", "beta", "#$%", "zzz"]) for _ in range(30))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 900, 2)], "doc_id long, quality int")
    ratio, threshold = quality.fit(docs, labels)
    scores = [quality.ngram_scores(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), ratio)[0]
              for i, t in rows if i % 2 == 0]
    assert threshold == pytest.approx(min(np.percentile(scores, 100 * quality.TAIL), 0) - quality.SLACK, abs=1e-12)
