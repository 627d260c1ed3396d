"""Trees on rows of any numbers: histogram splits (M5, M6 after M1).

Oversampling by interpolation gives fractional answers, so rows no longer fall
into few patterns.  Each feature is cut into at most ``n_bins`` bins from
mergeable aggregates: its distinct values where there are that few, else
quantiles of a sketch.  Rows become patterns of bins; trees are then grown from
class counts per (fit, node, feature, bin) by :func:`train.fit_trees`.

A bin is named by its upper value.  A model is its node table and its bin
table: papers to score are binned alike, so each lies on the side of a split
that its bin was trained on.  With as many bins as values this is plain CART.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import cut_lineage
from .train import patterns

N_BINS = 32
#: Accuracy of the quantile sketch (its relative error is 1 / ACCURACY).
ACCURACY = 10_000

BIN_SCHEMA = "feature string, bin int, upper double"


def bin_table(rows: DataFrame, features: list[str], n_bins: int = N_BINS) -> DataFrame:
    """feature, bin, upper: at most ``n_bins`` rows a feature.  The quantile and
    distinct-count sketches are partial aggregates of one pass over the rows;
    values themselves are collected for features of few values only.  Null
    answers belong to no bin."""
    long = rows.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    ).where("value IS NOT NULL")
    shares = [i / n_bins for i in range(1, n_bins)]
    per = long.groupBy("feature").agg(
        F.approx_count_distinct("value").alias("_about"), F.max("value").alias("_top"),
        F.percentile_approx("value", shares, ACCURACY).alias("_cuts"))
    per = cut_lineage(per)  # one row a feature
    few = (long.join(F.broadcast(per.where(F.col("_about") <= 2 * n_bins).select("feature")), "feature")
           .groupBy("feature", "value").count().groupBy("feature")
           .agg(F.sort_array(F.collect_list("value")).alias("_values")))
    whole = F.size("_values") <= n_bins  # null where there are many
    return (per.join(few, "feature", "left").select("feature", F.when(whole, F.col("_values")).otherwise(
        F.array_distinct(F.concat("_cuts", F.array("_top")))).alias("_uppers"))
        .select("feature", F.posexplode("_uppers").alias("bin", "upper")))


def bin_lists(bins: DataFrame) -> dict[str, list[float]]:
    """The bin table as lists: a part of the model, ``n_bins`` numbers a feature."""
    out: dict[str, list[float]] = {}
    for r in bins.orderBy("feature", "bin").collect():
        out.setdefault(r["feature"], []).append(r["upper"])
    return out


def binned(value: Column, uppers: list[float]) -> Column:
    """The upper value of the bin that holds ``value``; the last bin is open."""
    edges = F.array(*[F.lit(float(u)) for u in uppers])
    below = F.size(F.filter(edges, lambda e: e < value))
    return F.when(value.isNotNull(), F.element_at(
        edges, F.least(below, F.lit(len(uppers) - 1)) + 1))


def quantize(rows: DataFrame, bins: dict[str, list[float]]) -> DataFrame:
    """``rows`` with every feature of the bin table replaced by its bin."""
    return rows.withColumns({f: binned(F.col(f).cast("double"), u) for f, u in bins.items()})


def binned_patterns(rows: DataFrame, features: list[str], bins: dict[str, list[float]],
                    label: str = "label") -> DataFrame:
    """``train.patterns`` of the binned rows: features, n, w0, w1."""
    return patterns(quantize(rows, bins), features, label)
