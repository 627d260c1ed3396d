"""Sinks and model IO."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tree import NODE_SCHEMA


def write_model(nodes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The node table as parquet, partitioned by run_id (a forest is
    many tree_id of one run)."""
    cols = [f.name for f in NODE_SCHEMA.fields]
    extra = [c for c in nodes.columns if c not in cols]
    nodes.select(*cols, *extra).write.mode(mode).partitionBy("run_id").parquet(path)


def read_model(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Read a node table back (partition pruning on run_id)."""
    df = spark.read.parquet(path)
    if run_id is not None:
        df = df.where(F.col("run_id") == run_id)
    return df


def write_scores(scored: DataFrame, path: str, run_ts: str, fmt: str = "json",
                 mode: str = "append") -> None:
    """Scored records, one folder per run timestamp."""
    scored.withColumn("run_ts", F.lit(run_ts)).write.mode(mode).partitionBy("run_ts") \
          .format(fmt).save(path)
