"""Confusion metrics, threshold sweep and threshold pick (A7, A8, W3, A11,
A12, P5, J7, J8, M11).

Every metric is a conditional sum with a partial (map-side) aggregate, so
the shuffle carries one row per group and partition.  The sweep first
collapses predictions to (probability, label) counts -- a tree has few
distinct probabilities -- and only then crosses the 10 thresholds, so the
fan-out is over distinct probabilities, never over papers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import (DECISION_THRESHOLD, SWEEP_START, SWEEP_STEP, SWEEP_STEPS,
                         TARGET_RECALL)


def _ratio(num: Column, den: Column, empty) -> Column:
    return F.when(den == 0, F.lit(empty).cast("double")).otherwise(
        num.cast("double") / den.cast("double"))


def metric_columns(tp="tp", fn="fn", fp="fp", tn="tn") -> list[Column]:
    """recall and precision are 0 on an empty denominator; specificity null."""
    tp, fn, fp, tn = (F.col(c) for c in (tp, fn, fp, tn))
    return [
        _ratio(tp, tp + fn, 0.0).alias("recall"),
        _ratio(tp, tp + fp, 0.0).alias("precision"),
        _ratio(tp + tn, tp + tn + fp + fn, None).alias("accuracy"),
        _ratio(tn, tn + fp, None).alias("specificity"),
    ]


def confusion_aggs(label: Column, pred: Column, weight: Column | None = None) -> list[Column]:
    w = weight if weight is not None else F.lit(1)
    return [
        F.sum(F.when((label == 1) & (pred == 1), w).otherwise(0)).cast("long").alias("tp"),
        F.sum(F.when((label == 1) & (pred == 0), w).otherwise(0)).cast("long").alias("fn"),
        F.sum(F.when((label == 0) & (pred == 1), w).otherwise(0)).cast("long").alias("fp"),
        F.sum(F.when((label == 0) & (pred == 0), w).otherwise(0)).cast("long").alias("tn"),
    ]


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction",
              group_cols: list[str] | tuple = ()) -> DataFrame:
    """Tp, fn, fp, tn and the four metrics, per group."""
    agg = (df.groupBy(*group_cols) if group_cols else df.groupBy()) \
        .agg(*confusion_aggs(F.col(label), F.col(pred)))
    return agg.select(*group_cols, "tp", "fn", "fp", "tn", *metric_columns())


def metrics_at(df: DataFrame, threshold: float = DECISION_THRESHOLD,
               prob: str = "probability", label: str = "label") -> DataFrame:
    pred = (F.col(prob) >= F.lit(float(threshold))).cast("int")
    return confusion(df.withColumn("prediction", pred), label, "prediction")


def threshold_grid(start: float = SWEEP_START, step: float = SWEEP_STEP,
                   n: int = SWEEP_STEPS):
    """The grid as a literal array<struct<i, threshold>> (a generator, no join)."""
    return F.array(*[F.struct(F.lit(i).alias("i"),
                              (F.lit(float(start)) + F.lit(float(i)) * F.lit(float(step)))
                              .alias("threshold")) for i in range(n)])


def threshold_sweep(df: DataFrame, prob: str = "probability", label: str = "label",
                    group_cols: list[str] | tuple = ()) -> DataFrame:
    """Metrics at each threshold of the grid (J7 over pre-aggregated
    probabilities)."""
    counts = df.groupBy(*group_cols, F.col(prob).alias("_p"), F.col(label).alias("_y")) \
               .agg(F.count(F.lit(1)).alias("_n"))
    x = counts.select("*", F.inline(threshold_grid()))
    pred = (F.col("_p") >= F.col("threshold")).cast("int")
    agg = x.groupBy(*group_cols, "i", "threshold").agg(
        *confusion_aggs(F.col("_y"), pred, F.col("_n")))
    return agg.select(*group_cols, "i", "threshold", "tp", "fn", "fp", "tn", *metric_columns())


def best_threshold(sweep: DataFrame, fallback: str = "max_recall",
                   target: float = TARGET_RECALL,
                   group_cols: list[str] | tuple = ()) -> DataFrame:
    """The highest threshold whose recall reaches ``target``; otherwise
    the last row (``fallback="last"``) or the first row of maximum recall
    (``fallback="max_recall"``)."""
    if fallback not in ("last", "max_recall"):
        raise ValueError("fallback must be 'last' or 'max_recall'")
    ok = (F.col("recall") >= F.lit(target)).cast("int")
    if fallback == "last":
        order = [ok.desc(), F.col("i").desc()]
    else:
        order = [ok.desc(), F.when(ok == 1, F.col("i")).desc_nulls_last(),
                 F.col("recall").desc(), F.col("i").asc()]
    w = Window.partitionBy(*group_cols).orderBy(*order) if group_cols else Window.orderBy(*order)
    return (sweep.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk")
            .withColumn("meets_target", ok))


def purity_metrics(df: DataFrame, threshold: float = DECISION_THRESHOLD,
                   prob: str = "probability", label: str = "label",
                   impurity: str = "leaf_impurity") -> DataFrame:
    """Metrics for rows in pure leaves, impure leaves, and all rows
    (GROUPING SETS); a subset with one class reports specificity null."""
    pred = (F.col(prob) >= F.lit(float(threshold))).cast("int")
    subset = F.when(F.col(impurity) == 0, F.lit("pure")).otherwise(F.lit("impure"))
    d = df.withColumn("prediction", pred).withColumn("subset", subset)
    agg = d.rollup("subset").agg(F.count(F.lit(1)).alias("n"),
                                 *confusion_aggs(F.col(label), F.col("prediction")))
    return agg.select(F.coalesce("subset", F.lit("all")).alias("subset"), "n",
                      "tp", "fn", "fp", "tn", *metric_columns())


def leaf_recall(df: DataFrame, threshold: float = DECISION_THRESHOLD,
                prob: str = "probability", label: str = "label") -> DataFrame:
    """Per leaf with at least one positive: recall and the leaf's
    training support."""
    pred = (F.col(prob) >= F.lit(float(threshold))).cast("int")
    agg = df.withColumn("prediction", pred).groupBy("leaf_id", "leaf_support").agg(
        F.count(F.lit(1)).alias("n"), *confusion_aggs(F.col(label), F.col("prediction")))
    return (agg.where((F.col("tp") + F.col("fn")) > 0)
            .select("leaf_id", "leaf_support", "n", "tp", "fn",
                    (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("recall")))


def false_negatives(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """P5: labelled 1, predicted 0."""
    return df.where((F.col(label) == 1) & (F.col(pred) == 0))


def eval_sample(df: DataFrame, n: int | None = None, order_col: str = "paper_id") -> DataFrame:
    """All rows, or the first n by id where the caller sets that cap."""
    return df if n is None else df.orderBy(order_col).limit(n)
