"""The question bank (CSV with quoted, multi-line, doubled-quote fields)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.answers import norm_qid

QUESTION_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("include_exclude", T.StringType()),
    T.StructField("notes", T.StringType()),
])

BANK_PATH = os.path.join(os.path.dirname(os.path.dirname(__file__)), "data", "questions.csv")


def question_rows(path: str = BANK_PATH) -> list[tuple[str, str, str, str]]:
    """The bank as plain rows (question_id, question, category, include_exclude)
    for building literal side tables and oracle SQL; 29 rows."""
    import csv
    out = []
    with open(path, newline="", encoding="utf-8") as fh:
        for r in csv.DictReader(fh):
            qid = r["id"][0].upper() + r["id"][1:].zfill(2)
            out.append((qid, r["question"], r["category"], r["include_exclude"]))
    return out
