"""Contradictory labels: identical answers, different labels (A3, A4, A5).

Feature patterns are heavily skewed (one pattern can hold a third of the
rows), so nothing is windowed by pattern: a partial aggregate collapses rows
to per-pattern label counts map-side, the small pattern table is broadcast
behind its size check, and rows are filtered against it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import bounded_broadcast


def pattern_labels(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Per feature pattern: rows, positives, negatives, majority (tie -> 1)."""
    agg = df.groupBy(*features).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(label).cast("long")).alias("n1"))
    return (agg.withColumn("n0", F.col("n") - F.col("n1"))
            .withColumn("majority_label", F.when(F.col("n1") >= F.col("n0"), 1).otherwise(0))
            .withColumn("conflict", (F.col("n1") > 0) & (F.col("n0") > 0))
            .withColumn("tie", F.col("conflict") & (F.col("n1") == F.col("n0"))))


def _renamed(pats: DataFrame, features: list[str]) -> DataFrame:
    return pats.select(*[F.col(c).alias("_p_" + c) if c in features else F.col(c)
                         for c in pats.columns])


def _on(df: DataFrame, features: list[str]):
    cond = None
    for f in features:
        c = df[f].eqNullSafe(F.col("_p_" + f))
        cond = c if cond is None else cond & c
    return cond


def conflicts_majority(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """A3: keep rows whose label is their pattern's majority (tie -> 1)."""
    pats = _renamed(pattern_labels(df, features, label).select(*features, "majority_label"),
                    features)
    j = df.join(bounded_broadcast(pats), _on(df, features), "inner")
    return (j.where(F.col(label) == F.col("majority_label"))
            .select(*[df[c] for c in df.columns]))


def conflicts_remove(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """A4: keep only patterns with a single distinct label."""
    pats = _renamed(pattern_labels(df, features, label).where(~F.col("conflict"))
                    .select(*features), features)
    return df.join(bounded_broadcast(pats), _on(df, features), "left_semi")


def conflict_report(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """A5: patterns, patterns in conflict, ties, rows each strategy drops."""
    p = pattern_labels(df, features, label)
    minority = F.when(F.col("majority_label") == 1, F.col("n0")).otherwise(F.col("n1"))
    return p.agg(
        F.count(F.lit(1)).alias("patterns"),
        F.sum(F.col("conflict").cast("long")).alias("patterns_in_conflict"),
        F.sum(F.col("tie").cast("long")).alias("ties"),
        F.sum(F.when(F.col("conflict"), minority).otherwise(0)).cast("long").alias("dropped_majority"),
        F.sum(F.when(F.col("conflict"), F.col("n")).otherwise(0)).cast("long").alias("dropped_remove"),
        F.sum("n").cast("long").alias("rows"))
