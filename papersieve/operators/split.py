"""Exact stratified split and folds.

Each row gets a seeded rank inside its class: order by md5(seed-id), then
id.  Ranking a whole class in one window would put a class (half the data)
in one task, so the rank is computed inside md5-prefix buckets (uniform by
construction) and offset by the bucket counts of a tiny (class x bucket)
table.  Bucket order is md5 order, so the rank is exact, identical on any
partitioning, and reproducible in SQL with a plain row_number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import N_FOLDS, RANDOM_STATE

BUCKET_HEX = 2  # 256 buckets per class


def seeded_key(id_col: str = "paper_id", seed: int = RANDOM_STATE):
    return F.md5(F.concat(F.lit(str(seed)), F.lit("-"), F.col(id_col).cast("string")))


def class_rank(df: DataFrame, label: str = "label", id_col: str = "paper_id",
               seed: int = RANDOM_STATE) -> DataFrame:
    """Adds ``_rank`` (0-based, exact within class) and ``_n_class``."""
    d = (df.withColumn("_key", seeded_key(id_col, seed))
           .withColumn("_bucket", F.substring("_key", 1, BUCKET_HEX)))
    counts = d.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_nb"))
    wc = Window.partitionBy(label).orderBy("_bucket")
    offs = (counts.withColumn("_off", F.sum("_nb").over(wc) - F.col("_nb"))
            .withColumn("_n_class", F.sum("_nb").over(Window.partitionBy(label)))
            .select(label, "_bucket", "_off", "_n_class"))
    # (classes x 16^BUCKET_HEX) rows: bounded by construction
    w = Window.partitionBy(label, "_bucket").orderBy("_key", id_col)
    return (d.join(F.broadcast(offs), [label, "_bucket"])
            .withColumn("_rank", F.col("_off") + F.row_number().over(w) - 1)
            .drop("_key", "_bucket", "_off"))


def stratified_split(df: DataFrame, label: str = "label", id_col: str = "paper_id",
                     test_size: float = 0.2, val_size: float = 0.25,
                     seed: int = RANDOM_STATE, n_folds: int = N_FOLDS) -> DataFrame:
    """W1 + W2: split in {train, val, test} and a ``fold`` for train rows.

    Per class of n rows: the first ceil(n*test_size) ranks are test, the next
    ceil((n - n_test)*val_size) are val, the rest train; train rows take
    fold = (rank among train) mod n_folds.  60/20/20 with the defaults;
    (0.4, 0.5) gives the second variant."""
    r = class_rank(df, label, id_col, seed)
    n_test = F.ceil(F.col("_n_class") * F.lit(test_size))
    n_val = F.ceil((F.col("_n_class") - n_test) * F.lit(val_size))
    split = (F.when(F.col("_rank") < n_test, F.lit("test"))
             .when(F.col("_rank") < n_test + n_val, F.lit("val")).otherwise(F.lit("train")))
    fold = F.when(split == "train",
                  F.pmod(F.col("_rank") - n_test - n_val, F.lit(n_folds)).cast("int"))
    return r.withColumn("split", split).withColumn("fold", fold).drop("_rank", "_n_class")


def split_filter(df: DataFrame, split: str) -> DataFrame:
    """P2."""
    return df.where(F.col("split") == split)


def train_val_union(df: DataFrame) -> DataFrame:
    """Train + validation rows for the final fit."""
    return split_filter(df, "train").unionByName(split_filter(df, "val"))


def split_summary(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows, positives and positive percent per split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(label).cast("long")).alias("n_positive")).withColumn(
        "pct_positive", F.col("n_positive") * 100.0 / F.col("n"))
