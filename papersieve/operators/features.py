"""Feature tables: long to wide (A1), encoding (F3), label join (J1),
column selection (P1, P9), profiles (A2, A17) and pattern probes (P6)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FEATURE_ORDER
from ..functions.answers import encode_answer

_FEATURE_RE = re.compile(r"^[IE]\d+$")


def feature_columns(df: DataFrame, only: list[str] | None = None) -> list[str]:
    """Question columns (I01.., E01..).  The bare I/E prefix would also
    catch unrelated columns, so the name must be a letter and digits."""
    cols = [c for c in df.columns if _FEATURE_RE.match(c)]
    return [c for c in only if c in cols] if only else cols


def drop_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """Question ablation."""
    return df.drop(*cols)


def pivot_answers(answers: DataFrame, questions: list[str] = FEATURE_ORDER,
                  value: str = "answer", key: str = "paper_id") -> DataFrame:
    """A1: one row per paper, one column per question (explicit pivot values:
    no extra job to discover them).  A duplicate (paper, question) raises
    inside the same job instead of being hidden by ``first``."""
    per = answers.groupBy(key, "question_id").agg(
        F.first(value, ignorenulls=True).alias("_v"), F.count(F.lit(1)).alias("_n"))
    checked = per.withColumn("_v", F.when(F.col("_n") > 1, F.raise_error(F.concat(
        F.lit("duplicate answer for paper "), F.col(key).cast("string"),
        F.lit(" question "), F.col("question_id")))).otherwise(F.col("_v")))
    return checked.groupBy(key).pivot("question_id", list(questions)).agg(F.first("_v"))


def complete_rows(wide: DataFrame, questions: list[str]) -> DataFrame:
    """Papers with every question answered (a gap makes a paper incomplete)."""
    return wide.where(reduce(lambda a, b: a & b, [F.col(q).isNotNull() for q in questions]))


def encode_features(wide: DataFrame, questions: list[str], policy: str = "include_aware",
                    on_bad: str = "raise") -> DataFrame:
    """F3 on every question column."""
    return wide.select(*[c for c in wide.columns if c not in questions],
                       *[encode_answer(F.col(q), F.lit(q), policy, on_bad).alias(q)
                         for q in questions])


def labelled_features(wide: DataFrame, labels: DataFrame, key: str = "paper_id") -> DataFrame:
    """Inner equi-join of features and labels."""
    return wide.join(labels, key, "inner")


def class_dist(df: DataFrame, label: str = "label") -> DataFrame:
    """A2: normalised class counts, rounded to 2 decimals."""
    total = F.sum("n").over(Window.partitionBy())  # over the 2 class rows only
    return (df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("share", F.round(F.col("n") / total, 2)))


def dataset_profile(df: DataFrame, label: str = "label") -> DataFrame:
    """Feature count and names, rows and columns."""
    feats = feature_columns(df)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"),
        F.lit(len(feats)).alias("n_features"),
        F.lit(",".join(feats)).alias("features"))


def pattern_probe(df: DataFrame, conditions: dict[str, float], label: str = "label") -> DataFrame:
    """Rows matching a conjunction of feature values: count and labels."""
    cond = reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in conditions.items()])
    return df.where(cond).agg(F.count(F.lit(1)).alias("n"),
                              F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("long")
                              .alias("n_positive"),
                              F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).cast("long")
                              .alias("n_negative"))
