"""Histogram splits and the forest flow on oversampled rows."""

import random

import pytest
from pyspark.sql import functions as F

from papersieve.constants import FEATURE_ORDER as FE
from papersieve.operators import histogram as H
from papersieve.operators.split import stratified_split
from papersieve.operators.train import configs_df, fit_trees, predict_patterns
from papersieve.plans import training as TRN

from .brute import cart_brute

NAMES = ["a", "b", "c"]


def fractional(n=160, seed=2):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        x = [draw.choice([0.0, 1.0, round(draw.random(), 2)]) for _ in NAMES]
        rows.append((i, *x, int(x[0] + x[1] * draw.random() > .9)))
    return rows


def test_as_many_bins_as_values_is_plain_cart(spark):
    rows = fractional()
    df = spark.createDataFrame(rows, ["paper_id", *NAMES, "label"])
    bins = H.bin_lists(H.bin_table(df, NAMES, 200))
    assert {f: u for f, u in bins.items()} == {
        f: sorted({r[i + 1] for r in rows}) for i, f in enumerate(NAMES)}
    pats = H.binned_patterns(df, NAMES, bins).withColumn("run_id", F.lit("r"))
    got = {r["node_id"]: (r["feature"], r["threshold"], r["n0"], r["n1"]) for r in
           fit_trees(pats, configs_df(spark, [{"run_id": "r"}]), NAMES).collect()}
    want = cart_brute([({f: r[i + 1] for i, f in enumerate(NAMES)}, r[-1]) for r in rows], NAMES,
                      "gini", None, 2, 1)
    assert got == want


@pytest.mark.parametrize("parts", [1, 7])
def test_few_bins_hold_like_shares_and_bin_alike(spark, parts):
    draw = random.Random(5)
    values = [draw.gauss(0, 1) for _ in range(4000)] + [None] * 10
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)
    bins = H.bin_lists(H.bin_table(df, ["x"], 8))
    assert len(bins["x"]) == 8 and bins["x"][-1] == max(values[:4000])
    got = {r["x"]: r["n"] for r in H.quantize(df, bins).groupBy("x").agg(F.count("*").alias("n")).collect()}
    assert got.pop(None) == 10 and all(400 < n < 600 for n in got.values())
    out = spark.createDataFrame([(-99.0,), (99.0,)], "x double")
    assert [r.x for r in H.quantize(out, bins).orderBy("x").collect()] == [bins["x"][0], bins["x"][-1]]


def test_binned_tree_scores_its_own_rows_as_trained(spark):
    df = spark.createDataFrame(fractional(400, 3), ["paper_id", *NAMES, "label"])
    bins = H.bin_lists(H.bin_table(df, NAMES, 6))
    pats = H.binned_patterns(df, NAMES, bins).withColumn("run_id", F.lit("r"))
    nodes = fit_trees(pats, configs_df(spark, [{"run_id": "r", "min_samples_leaf": 3}]), NAMES)
    leaves = {r["node_id"]: (r["n0"], r["n1"]) for r in nodes.where("feature IS NULL").collect()}
    seen = predict_patterns(pats.withColumn("tree_id", F.lit(0)), nodes, NAMES).groupBy("leaf_id").agg(
        F.sum("w0").alias("n0"), F.sum("w1").alias("n1")).collect()
    assert {r.leaf_id: (r.n0, r.n1) for r in seen} == leaves


def test_forest_flow_on_smote_rows(spark):
    draw = random.Random(9)
    rows = []
    for i in range(300):
        x = [float(draw.random() < .3) for _ in FE]
        y = int(x[0] + x[3] + (draw.random() < .1) >= 2)
        rows.append((i, y, *x))
    df = stratified_split(spark.createDataFrame(rows, ["paper_id", "label", *FE]))
    configs = [{"config_id": 0, "n_estimators": 8, "max_depth": 3, "min_samples_leaf": 2,
                "bootstrap": True},
               {"config_id": 1, "n_estimators": 5, "max_depth": 3, "min_samples_leaf": 3,
                "bootstrap": False}]
    sweep = TRN.smote_forest_sweep(df, FE, configs).orderBy("i").collect()
    assert len(sweep) == 10 and sum(r.chosen for r in sweep) == 1
    n_test = df.where("split = 'test'").count()
    assert all(r.tp + r.fn + r.fp + r.tn == n_test for r in sweep)
    best = next(r for r in sweep if r.chosen)
    assert best.recall >= 0.7 and best.specificity >= 0.7
    nodes, bins = TRN.fit_smote_forest(df.where("split <> 'test'"), FE, configs[0])
    assert nodes.select("tree_id").distinct().count() == 8
    assert any(len(u) > 2 for u in bins.values())  # SMOTE made fractions
    scored = TRN.forest_scores(df, nodes, bins, FE)
    assert scored.where("probability IS NULL").count() == 0
    assert scored.count() == df.count()
